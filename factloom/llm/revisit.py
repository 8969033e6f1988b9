"""WARC: resolution of not-modified revisits to the latest earlier full response of the same URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import UPPER, partitions, staged

#: Header fields of a 304 response that replace the stored ones (RFC 9110 15.4.5, RFC 9111 3.2).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary"]


def canonical_url(url: Column) -> Column:
    """Host A-Z lower-cased without www. and default port, path or /, query without utm_ parameters in sorted
    order; scheme and fragment dropped. Null, or no ://: null."""
    at = F.instr(url, "://")
    scheme = F.translate(F.substr(url, F.lit(1), at - 1), UPPER, UPPER.lower())
    rest = F.regexp_extract(F.substr(url, at + 3), r"^[^#]*", 0)
    host = F.translate(F.regexp_extract(rest, r"^[^/?]*", 0), UPPER, UPPER.lower())
    port = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.array_join(F.sort_array(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    out = F.concat(F.regexp_replace(port, r"^www\.", ""), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(F.coalesce(at, F.lit(0)) > 0, out)


def merged_headers(stored: Column, fresh: Column, permitted: list[str] = PERMITTED) -> Column:
    """stored with the permitted fields of fresh in place of its own; names in lower case."""
    fresh = F.map_filter(F.coalesce(fresh, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(permitted))
    kept = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(fresh, k))
    return F.map_concat(kept, fresh)


def resolve(captures: DataFrame) -> DataFrame:
    """Each revisit with the response it stands for.

    captures: record_id bigint, kind ('response', 'revisit', others are ignored), url string, ts bigint, headers
    map<string,string> with names in lower case, locator string (where the payload lies). Returns, for each
    revisit, record_id, url_key, ts, outcome, refers_to, locator and headers (merged). outcome:
    'resolved': the latest response of the canonical url with ts below the revisit's (ties: largest record_id)
    has the same entity tag, or, if either has none, the same last-modified; 'changed': it has another validator;
    'no_validator': nothing to compare; 'no_response': there is none earlier, or the url is null or not
    absolute, or ts is null. refers_to, locator and headers are null unless resolved. Repeated rows are resolved
    one by one; extra columns are not read.

    The records are ranged over all tasks by (url, ts), so one URL may fill many of them; each range then looks
    back inside itself, and to the last response of the ranges before where it has none.
    """
    spark = captures.sparkSession
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    c = captures.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", canonical_url(F.col("url")).alias("url_key"), "ts", "headers", "locator",
    )
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    # At one ts revisits come first, so a response of the same moment is not earlier.
    order = ["ts", F.when(F.col("kind") == "revisit", 0).otherwise(1), "record_id"]
    c = c.withColumn("rank", order[1])
    ranged = staged(c.where(usable).repartitionByRange(partitions(spark), "url_key", "ts", "rank", "record_id").withColumn("part", F.spark_partition_id()))
    response = F.when(F.col("kind") == "response", F.struct("record_id", "headers", "locator"))
    inside = W.partitionBy("url_key", "part").orderBy("ts", "rank", F.col("record_id")).rowsBetween(W.unboundedPreceding, -1)
    last = ranged.where("kind = 'response'").groupBy("url_key", "part").agg(F.max_by(F.struct("record_id", "headers", "locator"), F.struct("ts", "record_id")).alias("last"))
    parts = ranged.select("url_key", "part").distinct().join(last, ["url_key", "part"], "left")
    before = W.partitionBy("url_key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = staged(parts.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("carried is not null").select(F.col("url_key").alias("_u"), F.col("part").alias("_p"), "carried"))
    looked = ranged.withColumn("near", F.last(response, ignorenulls=True).over(inside)).where("kind = 'revisit'")
    j = looked.join(carried, (F.col("url_key") == F.col("_u")) & (F.col("part") == F.col("_p")), "left").withColumn("full", F.coalesce("near", "carried"))
    tag, stored_tag = weak(F.col("headers")["etag"]), weak(F.col("full.headers")["etag"])
    date, stored_date = F.col("headers")["last-modified"], F.col("full.headers")["last-modified"]
    by_tag = tag.isNotNull() & stored_tag.isNotNull()
    by_date = date.isNotNull() & stored_date.isNotNull()
    outcome = (
        F.when(F.col("full").isNull(), "no_response").when(by_tag, F.when(tag == stored_tag, "resolved").otherwise("changed"))
        .when(by_date, F.when(date == stored_date, "resolved").otherwise("changed")).otherwise("no_validator")
    )
    j = j.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    found = j.select("record_id", "url_key", "ts", "outcome", F.when(good, F.col("full.record_id")).alias("refers_to"), F.when(good, F.col("full.locator")).alias("locator"), F.when(good, merged_headers(F.col("full.headers"), F.col("headers"))).alias("headers"))
    rest = c.where(~usable & (F.col("kind") == "revisit")).select("record_id", "url_key", "ts", F.lit("no_response").alias("outcome"), F.lit(None).cast("bigint").alias("refers_to"), F.lit(None).cast("string").alias("locator"), F.lit(None).cast("map<string,string>").alias("headers"))
    return found.unionByName(rest)


def captures_of_pages(pages: DataFrame, url_col: str = "url", id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A capture log made of a table of pages, to run resolve() on: each page is a response at ts = 10 * id; one
    with an id divisible by 7 is only revisited. Later it is revisited twice, once with the response's entity
    tag and once, where the id is odd, with another, else with only the date of change. A page without an id has
    the two revisits alone, of null record_id, ts and locator, so they resolve to 'no_response'."""
    pid = F.col(id_col)
    tag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col(html_col), F.lit(""))), F.lit('"'))
    modified = pid.cast("string")
    text = lambda x: F.lit(x)
    record = lambda i, kind, ts, headers: F.struct((pid * 3 + i).alias("record_id"), F.lit(kind).alias("kind"), ts.alias("ts"), headers.alias("headers"))
    full = F.create_map(text("etag"), tag, text("last-modified"), modified, text("content-type"), text("text/html"), text("content-length"), F.octet_length(F.coalesce(F.col(html_col), F.lit(""))).cast("string"), text("date"), (pid * 10).cast("string"))
    same = F.create_map(text("etag"), F.concat(F.lit("W/"), tag), text("date"), (pid * 10 + 5).cast("string"), text("cache-control"), text("max-age=60"), text("content-length"), text("0"))
    other = F.when(F.coalesce(pid, F.lit(0)) % 2 == 1, F.create_map(text("etag"), text('"other"'))).otherwise(F.create_map(text("last-modified"), modified, text("expires"), text("0")))
    log = F.filter(F.array(record(0, "response", pid * 10, full), record(1, "revisit", pid * 10 + 5, same), record(2, "revisit", pid * 10 + 7, other)), lambda r: (pid % 7 != 0) | (r["kind"] == "revisit"))
    return pages.select(F.col(url_col).alias("url"), F.concat(F.lit("page:"), pid.cast("string")).alias("locator"), F.explode(log).alias("r")).select("url", "locator", "r.*")
