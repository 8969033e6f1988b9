"""Names under near spellings: words meet through pieces that a near word must keep, names through near words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import likeness, set_likeness
from ..functions.numbers import split_year
from ..functions.text import fold
from .tables import top_k

#: Likeness in per cent from which two words are near: 100 * 2 * common subsequence / both lengths.
NEAR = 85


def _words(text: Column) -> Column:
    return F.filter(F.split(fold(text), " "), lambda w: w != "")


def _other_lengths(n: Column, least: int) -> Column:
    """Lengths that a word near one of n characters can have."""
    off = 100 - least
    return F.sequence(F.ceil(n * (100 - off) / (100 + off)).cast("int"), F.floor(n * (100 + off) / (100 - off)).cast("int"))


def near_words(asked: DataFrame, known: DataFrame, least: int = NEAR) -> DataFrame:
    """(asked, known, likeness): every word of asked (column word) with each word of known that is equal or near.

    Two words are near with at most `off` insertions and deletions, a share of both lengths. Of off + 1 pieces of one
    word, one stands unbroken in the other, at most `off` places away. So a word is listed once for each length of its
    partner, piece and place, the other under all its pieces of such lengths: they meet by equality, and only such
    pairs are compared. No word meets all others. least is 70 or more, else pieces would be empty."""
    if least < 70:
        raise ValueError("near words are at least 70 % alike")
    spare = lambda n, m: F.floor((100 - least) * (n + m) / 100).cast("int")
    cut = lambda i, n, k: F.floor(i * n / (k + 1)).cast("int")
    q = asked.select(F.col("word").alias("asked")).where("asked <> ''").distinct().withColumn("n", F.length("asked")).withColumn("m", F.explode(_other_lengths(F.col("n"), least)))
    q = q.withColumn("k", spare(F.col("n"), F.col("m"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    q = q.withColumn("a", cut(F.col("i"), F.col("n"), F.col("k"))).withColumn("size", cut(F.col("i") + 1, F.col("n"), F.col("k")) - F.col("a"))
    q = q.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("a") - F.col("k")), F.least(F.col("m") - F.col("size"), F.col("a") + F.col("k")))))
    q = q.select("asked", "m", "at", F.substring(F.col("asked"), F.col("a") + 1, F.col("size")).alias("piece"))
    sizes = lambda n: F.transform(_other_lengths(n, least), lambda o: F.sequence(F.floor(o / (spare(o, n) + 1)).cast("int"), F.ceil(o / (spare(o, n) + 1)).cast("int")))
    c = known.select(F.col("word").alias("known")).where("known <> ''").distinct().withColumn("m", F.length("known"))
    c = c.withColumn("size", F.explode(F.array_distinct(F.flatten(sizes(F.col("m")))))).where("size between 1 and m").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("size"))))
    c = c.select("known", "m", "at", F.substring(F.col("known"), F.col("at") + 1, F.col("size")).alias("piece"))
    pairs = q.join(c, ["m", "at", "piece"]).select("asked", "known").distinct()
    score = F.when(F.col("asked") == F.col("known"), 100.0).otherwise(likeness(F.col("asked"), F.col("known")))
    return pairs.withColumn("likeness", score).where(F.col("likeness") >= least)


def candidates(asked: DataFrame, names: DataFrame, within: list[str] = [], least: int = NEAR) -> DataFrame:  # noqa: B006
    """(ask, name, *within, coverage): names that have a word equal or near to one of the text asked for, with the
    share of its words for which they have one. asked: ask; names: name; both may have columns `within`, in which
    they must agree. Names meet texts through near words alone."""
    a = asked.select("ask", *within).distinct().select("ask", *within, F.size(_words(F.col("ask"))).alias("_of"), F.posexplode(_words(F.col("ask"))).alias("_i", "_asked"))
    n = names.select("name", *within).distinct().select("name", *within, F.explode(F.array_distinct(_words(F.col("name")))).alias("_known"))
    near = near_words(a.select(F.col("_asked").alias("word")), n.select(F.col("_known").alias("word")), least).select(F.col("asked").alias("_asked"), F.col("known").alias("_known"))
    hits = a.join(near, "_asked").join(n, ["_known", *within]).groupBy("ask", "name", *within, "_of").agg(F.count_distinct("_i").alias("_n"))
    return hits.select("ask", "name", *within, F.round(F.col("_n") / F.col("_of"), 4).alias("coverage"))


def _scored(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", F.when(fold(F.col("ask")) == fold(F.col("name")), 100.0).otherwise(set_likeness(F.col("ask"), F.col("name"))))


def resolve(queries: DataFrame, catalogue: DataFrame, query: str, name: str, least_coverage: float = 0.75, least_score: float = 85.0, within: list[str] = []) -> DataFrame:  # noqa: B006
    """(query, *within, outcome, name, coverage, score): the one catalogue name that fits a query, or why there is none.

    The greatest coverage of the query's words wins, then the greatest score; a tie is ambiguous, a coverage or score
    below the least is unknown, and neither picks a name. Where no name has a word near one of the query's, coverage
    is 0 and the score null. within: columns in which name and query must agree, such as a brand or a year."""
    asked = queries.select(F.col(query).alias("ask"), *within).distinct()
    pairs = candidates(asked, catalogue.select(F.col(name).alias("name"), *within), within)
    most = pairs.groupBy("ask", *within).agg(F.max("coverage").alias("coverage"))
    best = _scored(pairs.join(most, ["ask", *within, "coverage"])).groupBy("ask", *within, "coverage", "score").agg(F.count("*").alias("_n"), F.min("name").alias("_name"))
    top = best.groupBy("ask", *within, "coverage").agg(F.max(F.struct("score", "_n", "_name")).alias("b")).select("ask", *within, "coverage", "b.*")
    same = asked.alias("q").join(top.alias("t"), [F.col(f"q.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("ask", *within)], "left")
    weak = F.coalesce((F.col("coverage") < least_coverage) | (F.col("score") < least_score), F.lit(True))
    outcome = F.when(weak, "unknown").when(F.col("_n") > 1, "ambiguous").otherwise("found")
    return same.select(F.col("q.ask").alias("query"), *[F.col(f"q.{c}").alias(c) for c in within], outcome.alias("outcome"), F.when(outcome == "found", F.col("_name")).alias("name"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "score")


def suggest_near(asked: DataFrame, ask: str, names: DataFrame, name: str, most: int, year: str | None = None) -> DataFrame:
    """(ask, name, [year,] coverage, score, place, tied): the best `most` names for each text typed, near spellings too.

    By the share of its words that a name has, then, where names have a year and the text ends in one, that year's,
    then by likeness, then by name (and year). tied: another name is as good but for its name. A year in a text is
    no word of the name sought."""
    parts = split_year(F.col(ask)) if year else F.struct(F.col(ask).alias("rest"), F.lit(None).cast("int").alias("year"))
    typed = asked.select(F.col(ask).alias("_typed"), parts.alias("_p")).select("_typed", F.col("_p.rest").alias("ask"), F.col("_p.year").alias("_year")).distinct()
    found = _scored(candidates(typed.select("ask"), names.select(F.col(name).alias("name"))))
    rows = typed.join(found, "ask")
    if year:
        rows = rows.join(names.select(F.col(name).alias("name"), F.col(year).alias(year)).distinct(), "name")
    own = F.coalesce(F.col(year) == F.col("_year"), F.lit(False)) if year else F.lit(False)
    rows = rows.withColumn("_own", own).drop("ask").withColumnRenamed("_typed", ask)
    order = [F.desc("coverage"), F.desc("_own"), F.desc("score"), F.col("name"), *([F.desc(year)] if year else [])]
    ties = rows.groupBy(ask, "coverage", "_own", "score").agg((F.count_distinct("name") > 1).alias("tied"))
    out = top_k(rows, [ask], order, most).join(ties, [ask, "coverage", "_own", "score"])
    return out.select(ask, F.col("name").alias(name), *([year] if year else []), "coverage", "score", "place", "tied")
