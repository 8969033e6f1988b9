"""What a text names: known names found in it, requests resolved to one entity, ids inferred, a document's scope."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import split_year
from ..functions.text import fold, tokens, version_name
from .spelling import candidates

#: Most names of one automaton; more are sought in several, each over all texts.
MOST_NAMES = 100_000
RESOLVED, MUST_CHOOSE, NOT_UNDERSTOOD = "resolved", "must_choose", "not_understood"


def plain_words(text: Column) -> Column:
    """Folded letters and digits, all else as single spaces, one at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " ")), F.lit(" "))


@lru_cache(maxsize=2)
def _automaton(names: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for n in names:
        a.add_word(n, n)
    a.make_automaton()
    return a


def find_names(docs: DataFrame, names: DataFrame, name_col: str = "name", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, name, start, stop) of every known name in every text, as plain_words(): whole words, case, marks on
    letters and punctuation apart. start and stop are places in that form of the text. Of names inside a longer one
    at the same place only the longest counts.

    One automaton of all names passes over each text once, whatever their number; it is sent to the workers with at
    most MOST_NAMES names, counted first, and beyond that names are parted into several. Texts do not travel. Ids are
    unique; blank names are found nowhere."""
    spark = docs.sparkSession
    known = names.select(plain_words(F.col(name_col)).alias("n")).where("trim(n) <> ''").distinct()
    parts = max(1, -(-known.count() // MOST_NAMES))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), plain_words(F.col(text_col)).alias("t"))
    kind = texts.schema["id"].dataType.simpleString()

    def found(part: int) -> DataFrame:
        rows = known.where(F.pmod(F.xxhash64("n"), F.lit(parts)) == part).collect()
        sent = spark.sparkContext.broadcast(tuple(sorted(r["n"] for r in rows)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = _automaton(sent.value)
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    b = batch.slice(i, 256)
                    hits = [(k, n, end - len(n) + 2, end) for k, t in enumerate(b.column("t").to_pylist()) for end, n in (a.iter(t) if len(a) else ())]
                    at = pa.array([h[0] for h in hits], pa.int32())
                    yield pa.record_batch([b.column("id").take(at), *(pa.array([h[j] for h in hits], t) for j, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64())))], names=["id", "name", "start", "stop"])

        return texts.mapInArrow(run, f"id {kind}, name string, start bigint, stop bigint")

    hits = reduce(DataFrame.unionByName, [found(k) for k in range(parts)])
    past = W.partitionBy("id").orderBy("start", F.desc("stop")).rowsBetween(W.unboundedPreceding, -1)
    hits = hits.withColumn("_far", F.max("stop").over(past)).where(F.col("_far").isNull() | (F.col("stop") > F.col("_far")))
    return hits.select(F.col("id").alias(id_col), F.trim("name").alias("name"), "start", "stop")


def identify(requests: DataFrame, catalogue: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """(id_col, outcome, entity, choices, year) of requests in free words: resolved where the names in it name one
    entity, must_choose where they name several, each shown, not_understood where there is none. catalogue: name,
    entity; a name of two entities is a choice, never broken. year: the last one that the request says."""
    hits = find_names(requests, catalogue, "name", text_col, id_col).select(F.col(id_col).alias("_id"), F.col("name").alias("_n")).distinct()
    owners = catalogue.select(F.trim(plain_words(F.col("name"))).alias("_n"), "entity").distinct()
    named = hits.join(owners, "_n").groupBy("_id").agg(F.sort_array(F.collect_set("entity")).alias("choices"))
    out = requests.select(F.col(id_col), split_year(F.coalesce(F.col(text_col), F.lit("")))["year"].alias("year")).join(named, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    n = F.coalesce(F.size("choices"), F.lit(0))
    outcome = F.when(n == 1, RESOLVED).when(n > 1, MUST_CHOOSE).otherwise(NOT_UNDERSTOOD)
    return out.select(id_col, outcome.alias("outcome"), F.when(n == 1, F.get("choices", F.lit(0))).alias("entity"), "choices", "year")


def explicit_request(text: Column, brands: dict[str, str]) -> Column:
    """struct(brand, model, version, year) of a request that says all of brand, model and version in this order: a
    brand's name, one word, the rest; a year anywhere is taken out. Null where it doesn't. brands: name -> brand, the
    longest name that fits counts."""
    p = split_year(text)
    rest = F.trim(F.regexp_replace(p["rest"], r"\s+", " "))
    out = F.lit(None).cast("struct<brand: string, model: string, version: string, year: int>")
    for name, brand in sorted(brands.items(), key=lambda x: len(x[0])):
        size = len(name.split())
        words = F.split(rest, " ")
        hit = (fold(F.array_join(F.slice(words, 1, size), " ")) == fold(F.lit(name))) & (F.size(words) >= size + 2)
        said = F.struct(F.lit(brand).alias("brand"), F.get(words, F.lit(size)).alias("model"), F.array_join(F.slice(words, F.lit(size + 2), F.size(words)), " ").alias("version"), p["year"].alias("year"))
        out = F.when(hit, said).otherwise(out)
    return out


def likely_id(requests: DataFrame, ids: DataFrame, request_col: str, id_col: str, aliases: dict[str, str] = {}, least: float = 0.75) -> DataFrame:  # noqa: B006
    """(request_col, id_col, coverage): for each request the id, words joined by _, of whose words it has the greatest
    share, near spellings too; null where that is below least or two ids share it. aliases: word -> word that stands
    for it on both sides."""
    swap = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    words = lambda c: F.array_join(F.transform(F.split(fold(F.translate(c, "_", " ")), " "), lambda w: F.coalesce(swap[w], w) if aliases else w), " ")
    r = requests.select(request_col, words(F.col(request_col)).alias("_r")).distinct()
    i = ids.select(id_col, words(F.col(id_col)).alias("_i")).distinct()
    c = candidates(i.select(F.col("_i").alias("ask")), r.select(F.col("_r").alias("name"))).join(i, F.col("ask") == F.col("_i"))
    top = c.groupBy("name", "coverage").agg(F.count("*").alias("n"), F.min(id_col).alias(id_col)).groupBy("name").agg(F.max(F.struct("coverage", "n", id_col)).alias("b"))
    top = top.select(F.col("name").alias("_r"), "b.*")
    sure = (F.col("coverage") >= least) & (F.col("n") == 1)
    return r.join(top, "_r", "left").select(request_col, F.when(sure, F.col(id_col)).alias(id_col), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def document_scope(kind: Column, url: Column, version: Column, own_kinds: list[str]) -> Column:
    """'version' where a document's kind is one of a version's own, or the last part of its address has a word of the
    version's name; else 'line': it speaks of the whole line-up."""
    last = F.regexp_extract(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), r"([^/]*)/*$", 1)
    shared = F.arrays_overlap(tokens(version_name(F.translate(last, "-", " ")), []), tokens(version_name(version), []))
    return F.when(F.coalesce(kind.isin(own_kinds), F.lit(False)) | F.coalesce(shared, F.lit(False)), "version").otherwise("line")
