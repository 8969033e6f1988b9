"""Comparison of entities: parity, comparability, matrices, scenarios, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import close, within_pct
from ..functions.text import fold, tokens
from .facts import ABSENT_STATES, as_text, blank
from .tables import latest, top_k

ADVANTAGE, PARITY, GAP, UNKNOWN = "advantage", "parity", "gap", "unknown"
_VALUE = ("num", "flag", "items", "txt", "status")


def align(facts: DataFrame, pairs: DataFrame, spec: DataFrame) -> DataFrame:
    """Each pair (home, competitor, ...) with each field of spec and both sides' values, prefixed h_ and c_.
    A field that a side lacks keeps its row, with nulls. spec is a table of constants."""
    rows = pairs.crossJoin(spec)
    for prefix, side in (("h_", "home"), ("c_", "competitor")):
        values = facts.select(F.col("entity").alias(side), "field", *[F.col(v).alias(prefix + v) for v in _VALUE])
        rows = rows.join(values, [side, "field"], "left")
    return rows


def _missing(p: str) -> Column:
    c = lambda v: F.col(p + v)
    return blank(c("num"), c("flag"), c("items"), c("txt")) | F.coalesce(c("status").isin(ABSENT_STATES), F.lit(False))


def _verdict() -> Column:
    """struct(state, reason) of an aligned row."""
    out = lambda state, reason: F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))
    h, c = (lambda v: F.col("h_" + v)), (lambda v: F.col("c_" + v))
    more, less = F.size(F.array_except(h("items"), c("items"))) > 0, F.size(F.array_except(c("items"), h("items"))) > 0
    listed = (
        F.when(~more & ~less, out(PARITY, "")).when(more & ~less, out(ADVANTAGE, "")).when(less & ~more, out(GAP, ""))
        .otherwise(out(UNKNOWN, "crossing_sets"))
    )
    better = F.when(F.col("direction") == "low", h("num") < c("num")).otherwise(h("num") > c("num"))
    number = F.when(close(h("num"), c("num"), F.col("tol_abs"), F.col("tol_rel")), out(PARITY, "")).when(better, out(ADVANTAGE, "")).otherwise(out(GAP, ""))
    flag = (
        F.when(h("flag") == c("flag"), out(PARITY, "")).when(F.col("has_is_better") & h("flag"), out(ADVANTAGE, ""))
        .when(F.col("has_is_better"), out(GAP, "")).otherwise(out(UNKNOWN, "no_order_of_merit"))
    )
    text = lambda p: fold(as_text(F.col(p + "num"), F.col(p + "flag"), F.col(p + "items"), F.col(p + "txt")))
    same = F.when(text("h_") == text("c_"), out(PARITY, "")).otherwise(out(UNKNOWN, "no_order_of_merit"))
    return (
        F.when(_missing("h_") & _missing("c_"), out(UNKNOWN, "no_data_on_both"))
        .when(_missing("h_"), out(UNKNOWN, "no_data_home")).when(_missing("c_"), out(UNKNOWN, "no_data_competitor"))
        .when((F.col("kind") == "list") & F.col("orderable"), listed).when(F.col("kind") == "bool", flag)
        .when((F.col("kind") == "number") & F.col("direction").isNotNull(), number).otherwise(same)
    )


def parity(aligned: DataFrame) -> DataFrame:
    """aligned with state, reason and difference (home less competitor, of numbers with a direction)."""
    known = (F.col("kind") == "number") & F.col("direction").isNotNull() & ~_missing("h_") & ~_missing("c_")
    out = aligned.withColumn("_v", _verdict()).withColumn("difference", F.when(known, F.round(F.col("h_num") - F.col("c_num"), 4)))
    return out.withColumn("state", F.col("_v.state")).withColumn("reason", F.col("_v.reason")).drop("_v")


def state_counts(parities: DataFrame, *by: str) -> DataFrame:
    """Counts of the four states, and comparable, the denominator that leaves the unknown out."""
    n = lambda s: F.count_if(F.col("state") == s).alias(f"n_{s}")
    out = parities.groupBy(*by).agg(n(ADVANTAGE), n(PARITY), n(GAP), n(UNKNOWN), F.count("*").alias("n_fields"))
    return out.withColumn("comparable", F.col("n_fields") - F.col("n_unknown"))


def set_relation(a: Column, b: Column) -> Column:
    """equal, superset, subset or crossing; missing if either is null."""
    more, less = F.size(F.array_except(a, b)) > 0, F.size(F.array_except(b, a)) > 0
    return F.when(a.isNull() | b.isNull(), "missing").when(~more & ~less, "equal").when(~less, "superset").when(~more, "subset").otherwise("crossing")


def comparability(pairs: DataFrame, criteria: list[tuple], least: int = 4) -> DataFrame:
    """pairs with met, evaluable, total, unmet, no_data, comparable.

    criteria: (name, kind, home column, competitor column, per cent, eliminatory), kind one of equal, band, shared.
    A criterion without data leaves the denominator; `least` criteria met make a pair comparable unless an
    eliminatory one fails.
    """
    checks = []
    for name, kind, h, c, pct, must in criteria:
        a, b = F.col(h), F.col(c)
        ok = {"equal": a == b, "band": within_pct(b, a, pct or 0), "shared": F.arrays_overlap(a, b)}[kind]
        checks.append(F.struct(F.lit(name).alias("name"), ok.alias("ok"), F.lit(must).alias("must")))
    out = pairs.withColumn("_c", F.array(*checks))
    pick = lambda f: F.transform(F.filter("_c", f), lambda x: x["name"])
    unmet, empty = pick(lambda x: ~x["ok"]), pick(lambda x: x["ok"].isNull())
    out = out.withColumn("met", F.size(pick(lambda x: x["ok"])).cast("bigint")).withColumn("evaluable", (F.lit(len(criteria)) - F.size(empty)).cast("bigint")).withColumn("total", F.lit(len(criteria)).cast("bigint"))
    out = out.withColumn("unmet", F.array_join(unmet, ",")).withColumn("no_data", F.array_join(empty, ","))
    failed = F.exists("_c", lambda x: x["must"] & F.coalesce(~x["ok"], F.lit(False)))
    return out.withColumn("comparable", (F.col("met") >= least) & ~failed).drop("_c")


def best_match(scored: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The best scored candidate of each group."""
    return latest(scored, by, order)


#: Largest change of an override in per cent.
MOST_PCT = 50


def override_faults(overrides: DataFrame, fields: list[str]) -> DataFrame:
    """overrides (entity, field, pct, value, remove) with fault, the first of: not_one_form (pct, value or remove, just
    one), unknown_field, beyond_range; null for a sound one."""
    forms = F.col("pct").isNotNull().cast("int") + F.col("value").isNotNull().cast("int") + F.coalesce("remove", F.lit(False)).cast("int")
    fault = F.when(forms != 1, "not_one_form").when(~F.coalesce(F.col("field").isin(fields), F.lit(False)), "unknown_field").when(F.abs("pct") > MOST_PCT, "beyond_range")
    return overrides.withColumn("fault", fault)


def largest_override(overrides: DataFrame, by: list[str]) -> DataFrame:
    """The sound override of the largest change of each group; ties by field."""
    order = F.struct(F.abs("pct").alias("size"), F.col("field").alias("f"))
    return overrides.where("fault is null and pct is not null").groupBy(*by).agg(F.max_by(F.struct("field", "pct"), order).alias("o")).select(*by, "o.field", "o.pct")


def overlay(facts: DataFrame, overrides: DataFrame) -> DataFrame:
    """facts under overrides (entity, field, pct, value): a value, or a change by per cent of at most MOST_PCT. Others
    and fields without a number stay (override_faults names the reason); nothing is written."""
    o = overrides.where((F.col("pct").isNull() != F.col("value").isNull()) & F.coalesce(F.abs("pct") <= MOST_PCT, F.lit(True)))
    o = o.select("entity", "field", F.col("pct").alias("_pct"), F.col("value").alias("_value"))
    num = F.coalesce(F.col("_value"), F.round(F.col("num") * (1 + F.col("_pct") / 100), 2), F.col("num"))
    return facts.join(o, ["entity", "field"], "left").withColumn("num", num).drop("_pct", "_value")


def changed_states(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose parity state differs between two runs."""
    a = before.select(*keys, F.col("state").alias("state_before"))
    b = after.select(*keys, F.col("state").alias("state_after"))
    return a.join(b, keys).where("state_before <> state_after")


def differs(a: Column, b: Column, tol_abs: Column, tol_rel: Column) -> Column:
    """Whether two numbers differ beyond tolerance; one missing side is a difference, two are none."""
    return F.when(a.isNull() & b.isNull(), F.lit(False)).when(a.isNull() | b.isNull(), F.lit(True)).otherwise(~close(a, b, tol_abs, tol_rel))


def export_long(facts: DataFrame) -> DataFrame:
    """(entity, field, cell, label): cell is the value's text or, where there is none, its status in words."""
    words = F.when(F.col("status") == "declared_absent", "not available").when(F.col("status") == "not_found", "not found").when(F.col("status") == "unverified", "not verified").otherwise("no data")
    text = as_text(F.col("num"), F.col("flag"), F.col("items"), F.col("txt"))
    return facts.select("entity", "field", F.coalesce(text, words).alias("cell"), F.when(text.isNull(), "no data").otherwise("fact").alias("label"))


def matrix(long: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each key and one column for each field, none blank."""
    return long.groupBy(key).pivot("field", fields).agg(F.first("cell"))


def share_of_states(parities: DataFrame, by: list[str]) -> DataFrame:
    """Each state's share of a group's comparable fields."""
    n = parities.where(F.col("state") != UNKNOWN).groupBy(*by, "state").agg(F.count("*").alias("n"))
    return n.withColumn("of", F.sum("n").over(W.partitionBy(*by)))


def suggest(asked: DataFrame, ask_col: str, names: DataFrame, name_col: str, most: int) -> DataFrame:
    """(ask_col, name_col, coverage, score, place): the best `most` names of each text asked for that share a word
    with it: by the share of its words, then by likeness of the two sets of words, then by name. They meet word by
    word, so names without a common word are never looked at."""
    split = lambda df, c, n: df.select(c, F.size(F.array_distinct(tokens(F.col(c), []))).alias(n), F.explode(F.array_distinct(tokens(F.col(c), []))).alias("_w"))
    hits = split(asked, ask_col, "_a").join(split(names, name_col, "_b"), "_w").groupBy(ask_col, name_col, "_a", "_b").agg(F.count("*").alias("_n"))
    scored = hits.withColumn("coverage", F.col("_n") / F.col("_a")).withColumn("score", 2.0 * F.col("_n") / (F.col("_a") + F.col("_b")))
    return top_k(scored, [ask_col], [F.desc("coverage"), F.desc("score"), F.col(name_col)], most).drop("_a", "_b", "_n")


def declared_tags(versions: DataFrame, declared: DataFrame, name: str = "version") -> DataFrame:
    """versions with tags (array, sorted): those declared under the very name, else under its folded form, else none.

    declared: (version, tag), a row a tag. Tags are never inferred from facts: an empty array says that nobody
    declared any, and a criterion on them has no data. A null tag under a name declares the name without tags."""
    d = declared.select(F.col("version").alias("_v"), "tag")
    exact = d.groupBy("_v").agg(F.array_sort(F.collect_set("tag")).alias("_exact"))
    near = d.groupBy(fold(F.col("_v")).alias("_k")).agg(F.array_sort(F.collect_set("tag")).alias("_near"))
    j = versions.withColumn("_k", fold(F.col(name))).join(exact, F.col(name) == F.col("_v"), "left").join(near, "_k", "left")
    return j.withColumn("tags", F.coalesce("_exact", "_near", F.array().cast("array<string>"))).drop("_k", "_v", "_exact", "_near")
