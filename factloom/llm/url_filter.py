"""URL block and allow rules: host-suffix and path-prefix expressions joined on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import COMMON_RECORDS, UPPER, meet, staged

#: Rules up to this number are broadcast; beyond it both sides are dealt by salted hash prefix.
BROADCAST_RULES = 100_000
#: Shares into which a common hash prefix is split when rules are not broadcast.
SALTS = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or end, A-Z lower-cased; path: then up to ? # or end.
    Null, or a url without ://, has both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule, verdict added; every row stays once.

    rules: host, path, action. A rule fits its host and all subdomains when the url's path starts with the
    rule's path; of several the longest host and path together decide, then the longest host, then block. No
    rule: rule null, verdict default. Rules with a null part, or an empty host, fit nothing. Columns of pages
    named host, path, rule or verdict are replaced.

    Each host and path, once, makes one expression for each suffix of the host and each length of the path that
    some rule has (host suffixes only up to the longest rule's labels), so expressions grow with the rules' shapes,
    not with their number. Expressions meet rules on four bytes of their digest; the full digest then has to agree.
    Rows get their verdict by host and path; those that very many rows have, with a rule or none, are broadcast.
    """
    spark = pages.sparkSession
    r = rules.where("host is not null and path is not null and host <> ''").select(
        F.translate("host", UPPER, UPPER.lower()).alias("rhost"), F.col("path").alias("rpath"), F.col("action").alias("raction")
    ).groupBy("rhost", "rpath").agg(F.max_by("raction", F.when(F.col("raction") == "block", 1).otherwise(0)).alias("raction"))
    digest = _digest(F.col("rhost"), F.col("rpath"))
    r = r.select("rhost", "rpath", "raction", digest.alias("rdigest"), F.substring(digest, 1, 8).alias("rprefix"))
    shape = r.agg(F.collect_set(F.length("rpath")).alias("lengths"), F.max(F.size(F.split("rhost", r"\."))).alias("labels"), F.count("*").alias("n")).first()
    # A row travels as one struct, so its columns may have any names.
    host, path = host_and_path(F.col("row").getField(url_col))
    base = pages.select(F.struct("*").alias("row")).select("row", host.alias("h"), path.alias("p"))
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    kept = [F.col("row").getField(c).alias(c) for c in names]
    if not shape["n"]:
        return base.select(*kept, F.col("h").alias("host"), F.col("p").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    places = staged(base.groupBy("h", "p").agg(F.count("*").alias("c")))
    labels = F.split("h", r"\.")
    depth = F.least(F.size(labels), F.lit(shape["labels"]))
    suffixes = F.when(F.col("h") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(labels, -k, k), ".")))
    lengths = F.filter(F.array(*[F.lit(x) for x in sorted(shape["lengths"])]), lambda n: n <= F.length("p"))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(lengths, lambda n: F.struct(h.alias("h"), F.substring(F.col("p"), F.lit(1), n).alias("p")))))
    e = places.withColumn("e", F.explode(expressions)).select("h", "p", "c", F.col("e.h").alias("eh"), F.col("e.p").alias("ep")).withColumn("digest", _digest(F.col("eh"), F.col("ep")))
    e = e.withColumn("prefix", F.substring("digest", 1, 8))
    if shape["n"] <= BROADCAST_RULES:
        hit = e.join(F.broadcast(r), F.col("prefix") == F.col("rprefix"))
    else:
        salted = r.withColumn("rsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = e.withColumn("salt", F.pmod(F.hash("h", "p"), F.lit(SALTS))).join(salted, (F.col("prefix") == F.col("rprefix")) & (F.col("salt") == F.col("rsalt")))
    hit = hit.where((F.col("digest") == F.col("rdigest")) & (F.col("eh") == F.col("rhost")) & (F.col("ep") == F.col("rpath")))
    rank = F.struct((F.length("rhost") + F.length("rpath")).alias("a"), F.length("rhost").alias("b"), F.concat("rhost", "rpath").alias("rule"), F.col("raction").alias("action"))
    best = hit.groupBy("h", "p").agg(F.max(rank).alias("best"))
    total = places.agg(F.sum("c").alias("n")).first()["n"] or 0
    # Common places without a rule are records too, so that their rows aren't dealt out either.
    found = staged(places.join(best, ["h", "p"], "left").where(F.col("best").isNotNull() | (F.col("c") * COMMON_RECORDS > total)))
    judged = meet(base, found, ["h", "p"], "c", total, "left")
    return judged.select(*kept, F.col("h").alias("host"), F.col("p").alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
