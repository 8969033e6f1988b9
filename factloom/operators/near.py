"""Values near what they belong to: places of anchors and values in a text, and the nearest anchor on either side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import parse_number

#: A blank line ends a subject: nothing belongs to an anchor beyond it.
BLANK = r"\n\s*\n"
#: Characters of a quote on either side of its value, and no further than the next value of its field.
ROUND = 80


def paragraphs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, part, body): the stretches of each text between blank lines, from 0. Null texts have none."""
    return docs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), BLANK)).alias("part", "body"))


def places(parts: DataFrame, patterns: list[tuple[str, str, int]], id_col: str = "doc_id", body: str = "body") -> DataFrame:
    """(id_col, part, name, k, value, hit, start, stop, quote) of every match of the patterns (name, pattern, group of
    the value), which never match nothing: its place in its part in code points, from 0, and the text round it.

    A part is cut once by each pattern; places are running sums of the pieces' lengths, so they take time in
    proportion to the text and its matches. Ids are unique; only matches travel, texts don't."""
    cut = parts.select(id_col, "part", *[c for i, (_, pattern, group) in enumerate(patterns) for c in (
        F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias(f"_hit{i}"), F.regexp_extract_all(body, F.lit(pattern), F.lit(group)).alias(f"_value{i}"), F.split(body, pattern, -1).alias(f"_piece{i}"))])

    def found(i: int, name: str):
        one = lambda hit, k: F.struct(
            F.lit(name).alias("name"), k.alias("k"), F.get(f"_value{i}", k).alias("value"), hit.alias("hit"), F.length(F.get(f"_piece{i}", k)).alias("gap"),
            F.concat(F.right(F.get(f"_piece{i}", k), F.lit(ROUND)), hit, F.left(F.get(f"_piece{i}", k + 1), F.lit(ROUND))).alias("quote"))
        return F.transform(f"_hit{i}", one)

    out = cut.select(id_col, "part", F.explode(F.concat(*[found(i, p[0]) for i, p in enumerate(patterns)])).alias("f")).select(id_col, "part", "f.*")
    past = W.partitionBy(id_col, "part", "name").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    out = out.repartition(id_col, "part").withColumn("stop", F.sum(F.col("gap") + F.length("hit")).over(past))
    return out.withColumn("start", F.col("stop") - F.length("hit")).select(id_col, "part", "name", "k", "value", "hit", "start", "stop", "quote")


def values_by_anchor(docs: DataFrame, rules: list[tuple[str, str, str, int, float, float]], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, part, field, value, num, start, anchor, distance, side, quote): values of each field with the nearest
    of its anchors in the same paragraph, before or behind, in the line or in another.

    rules: field, pattern of its anchors, pattern of its values with the number as group 1, most characters between
    the two, least and greatest plausible number. Patterns have no other capturing groups. One window of each
    paragraph and field, in order of place, sees the last anchor before and the first behind; of two as near the one
    before counts. An anchor that overlaps the value is at distance 0. side: before or behind, where the anchor is."""
    patterns = [p for field, anchor, value, *_ in rules for p in ((f"a:{field}", anchor, 0), (f"v:{field}", value, 1))]
    p = places(paragraphs(docs, text_col, id_col), patterns, id_col)
    p = p.withColumn("is_anchor", F.col("name").startswith("a:")).withColumn("field", F.substring("name", 3, 1_000))
    by = W.partitionBy(id_col, "part", "field").orderBy("start", "is_anchor")
    anchor = F.when(F.col("is_anchor"), F.struct("start", "stop", "hit"))
    p = p.withColumn("a", F.last(anchor, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))).withColumn("b", F.first(anchor, ignorenulls=True).over(by.rowsBetween(0, W.unboundedFollowing)))
    p = p.where(~F.col("is_anchor")).withColumn("num", F.get(F.transform(F.array("value"), parse_number), F.lit(0)))
    far = F.lit(2**31 - 1)
    before = F.when(F.col("a").isNull(), far).otherwise(F.greatest(F.lit(0), F.col("start") - F.col("a.stop")))
    behind = F.when(F.col("b").isNull(), far).otherwise(F.greatest(F.lit(0), F.col("b.start") - F.col("stop")))
    p = p.withColumn("distance", F.least(before, behind)).withColumn("side", F.when(before <= behind, "before").otherwise("behind"))
    limit = lambda k: F.create_map(*[F.lit(x) for r in rules for x in (r[0], r[k])])[F.col("field")]
    p = p.where((F.col("distance") <= limit(3)) & F.col("num").between(limit(4), limit(5)))
    return p.select(id_col, "part", "field", "value", "num", F.col("start").cast("bigint").alias("start"), F.when(F.col("side") == "before", F.col("a.hit")).otherwise(F.col("b.hit")).alias("anchor"), F.col("distance").cast("bigint").alias("distance"), "side", "quote")


def nearest_by_value(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each text, field and number: the value nearest to its anchor, then the first; n_found counts all."""
    best = F.min_by(F.struct("part", "start", "value", "anchor", "distance", "side", "quote"), F.struct("distance", "part", "start"))
    return found.groupBy(id_col, "field", "num").agg(best.alias("b"), F.count("*").alias("n_found")).select(id_col, "field", "num", "n_found", "b.*")
