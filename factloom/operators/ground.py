"""Grounding: a value counts only where its quote stands in the stored source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fuzzy import locate_fuzzy
from ..functions.numbers import parse_number, whole_tokens
from ..functions.text import fold, squeeze

#: Words of a quote that seed the search; the first and the last word may be cut in the text, so they don't.
SEED = 4
EXACT, FOLDED, FUZZY, FAILED = "exact", "folded", "fuzzy", "failed"
#: Stated quote sets up to this number are broadcast; larger ones meet the texts by a shuffled join.
BROADCAST_QUOTES = 50_000


def locate_everywhere(quotes: DataFrame, docs: DataFrame, quote_id: str = "item_id", quote_col: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(quote_id, id_col, mode, at): every document in which a quote stands as it is, or but for marks on letters.

    Each document lists hashes of its runs of SEED words once; they meet the quotes' seeds by equality, and only
    those pairs are searched, so the work grows with the text and the matches, not with quotes times documents.
    Quotes too short for a seed are searched in every document. Blank quotes are found nowhere.
    """
    hashes = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - (SEED - 1)), lambda i: F.xxhash64(F.array_join(F.slice(ws, i, F.lit(SEED)), " ")))
    q = quotes.select(F.col(quote_id).alias("_q"), squeeze(F.col(quote_col)).alias("_qs"), fold(F.col(quote_col)).alias("_qf")).where("_qf <> ''").withColumn("_w", F.split("_qf", " "))
    long = F.size("_w") >= SEED + 2
    d = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_t"))
    seeds = q.where(long).select("_q", "_qs", "_qf", F.xxhash64(F.array_join(F.slice("_w", 2, SEED), " ")).alias("_h"))
    few = quotes.limit(BROADCAST_QUOTES + 1).count() <= BROADCAST_QUOTES
    # The words are bound once, as the one item of an array: an expression inside a lambda runs for every item.
    listed = F.transform(F.array(F.split(fold(F.col("_t")), " ")), lambda ws: F.when(F.size(ws) >= SEED, hashes(ws)))
    runs = d.select("_d", F.explode(F.array_distinct(F.get(listed, F.lit(0)))).alias("_h"))
    pairs = runs.join(F.broadcast(seeds) if few else seeds, "_h").select("_q", "_d", "_qs", "_qf").join(d, "_d")
    brief = q.where(~long).select("_q", "_qs", "_qf")
    short = d.join(F.broadcast(brief) if few else brief, F.contains(fold(F.col("_t")), F.col("_qf")))
    both = pairs.unionByName(short.select("_q", "_d", "_qs", "_qf", "_t"))
    exact, folded = F.instr(squeeze(F.col("_t")), F.col("_qs")), F.instr(fold(F.col("_t")), F.col("_qf"))
    both = both.withColumn("_e", exact).withColumn("_f", folded).where("_f > 0")
    return both.select(F.col("_q").alias(quote_id), F.col("_d").alias(id_col), F.when(F.col("_e") > 0, EXACT).otherwise(FOLDED).alias("mode"), F.when(F.col("_e") > 0, F.col("_e")).otherwise(F.col("_f")).alias("at"))


def locate(claims: DataFrame, quote: str = "quote", text: str = "source_text") -> DataFrame:
    """claims with mode and score. Exact and folded matches are settled by Columns; only what is left over goes
    through Python."""
    c = claims.withColumn("_m", F.when(F.coalesce(F.trim(F.col(quote)), F.lit("")) == "", "no_quote").when(F.coalesce(F.col(text), F.lit("")) == "", "no_text")
        .when(F.contains(squeeze(F.col(text)), squeeze(F.col(quote))), EXACT).when(F.contains(fold(F.col(text)), fold(F.col(quote))), FOLDED))
    # One pass: rows that are settled go by with nulls, so what made the claims is not worked out twice.
    ask = lambda x: F.when(F.col("_m").isNull(), F.col(x))
    c = c.withColumn("_l", locate_fuzzy(ask(quote), ask(text)))
    return c.withColumn("mode", F.coalesce("_m", "_l.mode")).withColumn("score", F.when(F.col("_m").isin(EXACT, FOLDED), 100.0).when(F.col("_m").isNotNull(), 0.0).otherwise(F.col("_l.score"))).drop("_m", "_l")


def most_literal(found: DataFrame, keys: list[str]) -> DataFrame:
    """Of several places of a quote the most literal, then the smallest document."""
    order = F.when(F.col("mode") == EXACT, 0).when(F.col("mode") == FOLDED, 1).otherwise(2)
    return found.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order, "doc_id"))).where("_n = 1").drop("_n")


def number_proven(value: Column, quote: Column, factors: list[float] = [1.0], tol_rel: float = 0.005) -> Column:  # noqa: B006
    """Whether a number of the quote, times one of the units' factors, is the value."""
    near = lambda x: F.abs(x - value) <= tol_rel * F.abs(value)
    return F.exists(whole_tokens(quote), lambda t: F.coalesce(F.exists(F.array(*map(F.lit, factors)), lambda f: near(parse_number(t) * f)), F.lit(False)))


def unsupported_numbers(text: Column, sources: Column) -> Column:
    """Numbers of a text that none of the sources (array<string>) has: what a written argument may not say."""
    return F.array_except(F.array_distinct(whole_tokens(text)), F.flatten(F.transform(sources, whole_tokens)))

