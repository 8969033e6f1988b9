"""Queries of sources and sinks: files are written from the tables into the shared folder and read by the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import compare, extract, facts
from ..operators.staging import new_path
from ..sources import captures, sinks
from . import mapping as m
from .comparison import _CELLS
from .registry import query, table
from .texts import _PLACED

_CAPTURES = """c AS (SELECT 'p' || page_id || '-' || k AS source_id, 'v' || page_id % 3 AS version_id, 'example.org/' || page_id % 100 AS url_key, CAST(1 + page_id % 5 AS INTEGER) AS tier, CASE WHEN page_id % 7 = 0 AND k = 1 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_days(CAST((page_id * 13 + k * 40) % 90 AS INTEGER)) END AS captured, CAST(strlen(html) + k AS BIGINT) AS bytes FROM pages, range(2) AS r(k))"""


def _tree(spark, sf_dir):
    """A capture of every page, twice, as JSON files of their own form."""
    k = F.col("k")
    p = table(spark, sf_dir, "pages").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 13 + k * 40, F.lit(90)).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = p.select(
        F.concat_ws("-", F.concat(F.lit("p"), F.col("page_id").cast("string")), k.cast("string")).alias("source_id"), F.concat(F.lit("v"), F.pmod("page_id", F.lit(3)).cast("string")).alias("version_id"),
        F.concat(F.lit("https://www.Example.org/"), F.pmod("page_id", F.lit(100)).cast("string"), F.lit("/?utm_source=x#top")).alias("url_final"), F.lit(200).alias("http_status"), (1 + F.pmod("page_id", F.lit(5))).cast("int").alias("tier"),
        F.lit("page").alias("kind"), F.lit("ok").alias("status"), F.when((F.pmod("page_id", F.lit(7)) == 0) & (k == 1), "soon").otherwise(day).alias("captured_at"), (F.octet_length("html") + k).cast("long").alias("bytes"))
    path = new_path(spark)
    rows.write.json(path)
    return captures.captures(spark, path, "*.json", multi_line=False)


@query(f"WITH {_CAPTURES} SELECT source_id, version_id, url_key, tier, strftime(captured, '%Y-%m-%d') AS captured, bytes FROM c")
def captured_pages(spark, sf_dir):
    """Every capture of a tree, with its key and time; a time that can't be read is null."""
    return _tree(spark, sf_dir).select("source_id", "version_id", "url_key", "tier", F.date_format("captured", "yyyy-MM-dd").alias("captured"), "bytes")


@query(f"WITH {_CAPTURES} SELECT url_key, source_id FROM c QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY captured DESC NULLS LAST, tier NULLS LAST, bytes DESC NULLS LAST, source_id) = 1")
def best_captures(spark, sf_dir):
    """One capture of each address: the newest, then the better tier, then the longer text."""
    return captures.best_captures(_tree(spark, sf_dir)).select("url_key", "source_id")


@query(f"WITH {_CAPTURES} SELECT source_id, tier, strftime(captured, '%Y-%m-%d') AS captured FROM c WHERE version_id = 'v1'")
def captures_of_version(spark, sf_dir):
    """The captures of one version, the best source first."""
    return captures.captures_of(_tree(spark, sf_dir), "v1").select("source_id", "tier", F.date_format("captured", "yyyy-MM-dd").alias("captured"))


@query("SELECT 's' || s_suppkey AS source_id, 'https://s' || s_suppkey || '.example' AS url, CAST(1 + s_suppkey % 5 AS INTEGER) AS tier, CASE WHEN s_acctbal < 0 THEN 'blocked' ELSE 'ok' END AS status FROM supplier")
def registered_sources(spark, sf_dir):
    """The sources of registry files, one file a nation; those that are blocked stay known."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.struct(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("url"), (1 + F.pmod("s_suppkey", F.lit(5))).cast("int").alias("tier"),
        F.lit("shop").alias("kind"), F.when(F.col("s_acctbal") < 0, "blocked").otherwise("ok").alias("status")).alias("s"))
    path = new_path(spark)
    s.groupBy("s_nationkey").agg(F.collect_list("s").alias("sources")).select("sources").write.option("maxRecordsPerFile", 1).json(path)
    return captures.registry(spark, path).select("source_id", "url", "tier", "status")


@query("SELECT item_id, sha256(text || chr(10)) AS text_sha256 FROM benchmark WHERE text IS NOT NULL")
def texts_by_folder(spark, sf_dir):
    """Whole text files with the folder that they lie in."""
    path = new_path(spark)
    table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.col("text").alias("value")).write.option("maxRecordsPerFile", 1).partitionBy("item_id").text(path)
    found = captures.source_texts(spark, path, "*.txt")
    return found.select(F.regexp_extract("folder", "item_id=([0-9]+)$", 1).cast("bigint").alias("item_id"), F.sha2("text", 256).alias("text_sha256"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 5 = 0 THEN 'empty: p_name,p_size' WHEN p_partkey % 7 = 0 THEN 'empty: p_name' WHEN p_partkey % 5 = 0 THEN 'empty: p_size' END AS reason FROM part")
def imported_rows(spark, sf_dir):
    """Rows of a CSV file with caveats, the good ones and the bad ones with their reason."""
    k = F.col("p_partkey")
    path = new_path(spark)
    sinks.write_csv(table(spark, sf_dir, "part").select("p_partkey", F.when(k % 7 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("p_name"), F.when(k % 5 != 0, F.col("p_size")).alias("p_size")), path, ["sizes are rounded"])
    good, bad = captures.import_table(spark, f"{path}/rows", ["p_partkey", "p_name", "p_size"])
    out = good.select("p_partkey", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("p_partkey", "reason"))
    return out.withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query("SELECT p_name AS name, CAST(1990 + p_size AS INTEGER) AS year, CAST(floor(p_retailprice) AS BIGINT) AS price, 'http://x/' || p_partkey AS url, 'Line-up of ' || p_brand AS header FROM part")
def lineup_tables(spark, sf_dir):
    """Versions of a line-up's pipe tables: texts of a brand, each of at most a thousand rows."""
    row = F.concat_ws(" | ", F.lit("|"), "p_name", (1990 + F.col("p_size")).cast("string"), F.concat(F.lit("R$ "), text.thousands(F.floor("p_retailprice"))), F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string")), F.lit("|"))
    t = table(spark, sf_dir, "part").select("p_brand", F.floor(F.col("p_partkey") / 1000).alias("page"), F.regexp_replace(row, r"^\| \|", "|").alias("row")).groupBy("p_brand", "page").agg(F.array_join(F.collect_list("row"), "\n").alias("rows"))
    head = F.concat(F.lit("Line-up of "), F.col("p_brand"), F.lit("\n\n| name | year | price | url |\n|---|---|---|---|\n"), F.col("rows"))
    return captures.lineup(t.select(head.alias("text")))


@query("""SELECT p_partkey, 'c-' || p_partkey AS code, CAST(floor(p_retailprice) AS BIGINT) AS price, CASE WHEN p_size % 3 <> 0 THEN 'maio de ' || (1990 + p_size) END AS month FROM part""")
def price_replies(spark, sf_dir):
    """What a price service's replies say."""
    body = F.to_json(F.struct(F.concat(F.lit("c-"), F.col("p_partkey").cast("string")).alias("code"), F.concat(F.lit("R$ "), text.thousands(F.floor("p_retailprice")), F.lit(",00")).alias("price"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("maio de "), (1990 + F.col("p_size")).cast("string"))).alias("month")))
    return table(spark, sf_dir, "part").select("p_partkey", captures.price_reply(body).alias("r")).select("p_partkey", "r.code", "r.price", "r.month")


@query("SELECT p_partkey, p_size + 0.5::DOUBLE AS urban, p_size + 2::DOUBLE AS highway FROM part")
def consumption_pairs(spark, sf_dir):
    """Consumption in town and on the road, as sentences say it."""
    size = F.col("p_size").cast("string")
    said = F.concat(F.lit("Faz "), size, F.lit(",5 km/l na cidade e "), (F.col("p_size") + 2).cast("string"), F.lit(" km/l na estrada."))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(captures.consumption_sentences(said)))


@query("SELECT page_id, sha256(CASE WHEN page_id % 2 = 0 THEN replace(html, 'charset=\"utf-8\"', 'charset=\"iso-8859-1\"') ELSE html END) AS html_sha256 FROM pages WHERE html IS NOT NULL")
def decoded_pages(spark, sf_dir):
    """Bytes of pages as text: by the charset that they declare, by what they are where they declare none."""
    western = F.regexp_replace("html", 'charset="utf-8"', 'charset="iso-8859-1"')
    content = F.when(F.pmod("page_id", F.lit(2)) == 0, F.encode(western, "iso-8859-1")).otherwise(F.encode("html", "utf-8"))
    return table(spark, sf_dir, "pages").where("html is not null").select("page_id", F.sha2(captures.decoded_html(content), 256).alias("html_sha256"))


@query("SELECT doc_id, lang AS version_id, sha256(text) AS sha256, CAST(strlen(text) AS INTEGER) AS bytes FROM documents WHERE text IS NOT NULL")
def stored_captures(spark, sf_dir):
    """Texts stored with digest and size, a folder for each version."""
    path = new_path(spark)
    sinks.write_captures(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("lang").alias("version_id"), "text"), path)
    return spark.read.parquet(path).select("doc_id", "version_id", "sha256", "bytes")


@query(f"WITH {m.FACTS} SELECT entity, {_CELLS} AS cell FROM fact WHERE field = 'price'")
def stored_long_table(spark, sf_dir):
    """One field of a long table stored by field: only its folder is read."""
    path = new_path(spark)
    sinks.write_long(compare.export_long(m.long_facts(spark, sf_dir)), path)
    return spark.read.parquet(path).where("field = 'price'").select("entity", "cell")


@query("""SELECT 'events_total{day="' || strftime(ts, '%Y-%m-%d') || '",type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY strftime(ts, '%Y-%m-%d'), event_type""")
def metric_lines(spark, sf_dir):
    """Counters by labels as lines of a metrics page."""
    c = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return sinks.exposition(c.select(F.create_map(F.lit("type"), F.col("event_type"), F.lit("day"), F.col("day")).alias("labels"), F.col("n").alias("value")), "events_total")


@query(f"WITH {m.FACTS} SELECT entity, field, CASE WHEN field IN ('price', 'flags') THEN {_CELLS} ELSE 'not verified' END AS cell FROM fact")
def requested_fields(spark, sf_dir):
    """Facts of the fields asked for; others keep their rows without a value."""
    return compare.export_long(facts.requested(m.long_facts(spark, sf_dir), ["price", "flags"])).select("entity", "field", "cell")


@query(f"WITH {m.SHEET}, {m.PAIRS} SELECT home, competitor, h.flags = c.flags AS same, CASE len(c.flags) WHEN 1 THEN c.flags[1] WHEN 2 THEN c.flags[1] || ' and ' || c.flags[2] WHEN 3 THEN c.flags[1] || ', ' || c.flags[2] || ' and ' || c.flags[3] END AS shown FROM pair JOIN sheet h ON h.p_partkey = home JOIN sheet c ON c.p_partkey = competitor")
def same_items(spark, sf_dir):
    """Whether two lists have the same items, and a few of them in words."""
    s = m.sheet(spark, sf_dir).select("p_partkey", "flags")
    side = lambda name: s.select(F.col("p_partkey").alias(name), F.col("flags").alias(f"{name}_flags"))
    j = m.pairs(spark, sf_dir).join(side("home"), "home").join(side("competitor"), "competitor")
    turned = F.concat(F.reverse("home_flags"), F.slice("home_flags", 1, 1))
    return j.select("home", "competitor", text.same_items(turned, F.col("competitor_flags")).alias("same"), text.examples(F.col("competitor_flags")).alias("shown"))


@query(f"WITH {_PLACED} SELECT doc_id, rule, value, count(*) AS n_found FROM f GROUP BY ALL")
def quoted_values(spark, sf_dir):
    """Each value of a document once, with its best quote and how often it was found."""
    best = extract.best_quote(extract.facts(table(spark, sf_dir, "documents")))
    return best.where(F.contains("quote", F.col("value"))).select("doc_id", "rule", "value", "n_found")
