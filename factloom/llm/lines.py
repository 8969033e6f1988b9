"""Line deduplication as an exact set-similarity join on the words of lines, in DataFrame operations alone."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import meet, partitions, row_key, staged

#: Buckets of the count of words, and so ranks of rarity that a word can have.
RANKS = 32768
#: Most words of 64 bits in the bit table that finds lines again; it is broadcast, so this bounds its size.
BIT_WORDS = 1 << 20
_LOW = (1 << 48) - 1
#: Sets of up to so many words are told apart by size, modulo 64, when a list says which sizes it holds.
SHORT = 100
_LAST = (1 << 63) - 1


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 49).cast("int")


def _lines(text: Column) -> Column:
    """The lines of a text, their other white space as spaces; null for null."""
    other = reduce(or_, [F.contains(text, F.lit(c)) for c in "\t\x0b\f\r"])
    return F.split(F.when(other, F.translate(text, "\t\x0b\f\r", "    ")).otherwise(text), "\n")


def rarity(texts: DataFrame, col: str) -> DataFrame:
    """One row, ranks array<bigint>: for each of RANKS buckets of word hashes its rank by how many words of all texts
    fall into it, moved to the high bits. Written to the shared folder once; plans name it as a subquery."""
    lines = texts.select(F.explode(_lines(F.col(col))).alias("line"))
    w = lines.select(F.explode(F.split("line", " ")).alias("w")).where("w <> ''").select(_bucket(F.xxhash64("w")).alias("b"))
    counts = w.groupBy("b").agg(F.count("*").alias("c"))
    every = texts.sparkSession.range(RANKS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    ranked = every.select("b", (F.row_number().over(W.orderBy(F.coalesce("c", F.lit(0)), "b")) - 1).cast("long").alias("r"))
    in_order = F.array_sort(F.collect_list(F.struct("b", "r")))
    return staged(ranked.agg(F.transform(in_order, lambda x: F.call_function("shiftleft", x["r"], F.lit(48))).alias("ranks")))


def with_tokens(lines: DataFrame, ranks: DataFrame) -> DataFrame:
    """lines with tokens: the distinct words of the column line (see _lines) as numbers, rarest first: rank of the
    word's bucket, then its hash."""
    hashes = F.array_distinct(F.transform(F.array_remove(F.split("line", " "), ""), lambda w: F.xxhash64(w)))
    number = lambda h: F.get("_ranks", _bucket(h)).bitwiseOR(h.bitwiseAND(F.lit(_LOW)))
    return lines.withColumn("_ranks", ranks.scalar()).withColumn("tokens", F.sort_array(F.transform(hashes, number))).drop("_ranks")


def lines_of(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))


def _largest(share: int) -> Column:
    """The most words that a partner of a row (n, i) can have, met at its place i: the common words begin there."""
    return F.floor((100 + share) * (F.col("n") - F.col("i")) / share) - F.col("n")


def _possible(share: int) -> Column:
    """Length, positional and parity filters on a row (n, i, sig) joined to another (xn, xi, xsig)."""
    c = F.col
    need = F.ceil(share * (c("n") + c("xn")) / (100 + share))
    return (
        (share * F.greatest("n", "xn") <= 100 * F.least("n", "xn")) & (F.least(c("n") - c("i"), c("xn") - c("xi")) >= need)
        & (F.bit_count(c("sig").bitwiseXOR(c("xsig"))) <= c("n") + c("xn") - 2 * need)
    )


def _marked(df: DataFrame, col: str, wanted: DataFrame) -> DataFrame:
    """Rows of df whose 64-bit col is in wanted (one bigint column), and a few others: a bit for each wanted number
    in a table of at most BIT_WORDS words is broadcast, so df stays where it is. Where the table would be full, df
    meets the wanted numbers by a shuffle."""
    w = F.col(wanted.columns[0])
    if wanted.select(F.approx_count_distinct(w)).first()[0] > 8 * BIT_WORDS:
        return df.join(wanted.select(w.alias("_w")).distinct(), F.col(col) == F.col("_w"), "left_semi")
    word = lambda h: F.pmod(F.shiftright(h, 6), F.lit(BIT_WORDS))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    bits = wanted.groupBy(word(w).alias("_word")).agg(F.bit_or(bit(w)).alias("_bits"))
    return df.withColumn("_word", word(F.col(col))).join(F.broadcast(bits), "_word").where(F.col("_bits").bitwiseAND(bit(F.col(col))) != 0).drop("_word", "_bits")


def _candidates(sets: DataFrame, share: int, only: DataFrame | None = None) -> DataFrame:
    """(fp, xfp, quick): sets that may reach the share, x not later than the other by document; quick where any list
    was cut to x alone.

    Each set is listed under its rarest words, apart by size. All lists are dealt out once. In a list, a set that
    has the same next word as an earlier one that the filters let pass meets that one alone (quick), so a group of
    near copies gives pairs in proportion to its size; others meet every set of the list that is not later.
    only: fp of the sets to look up, none of them quick.
    """
    half = lambda n: F.floor(F.log2(n) * 2).cast("int")
    entries = F.transform("prefix", lambda t, i: F.struct(i.alias("i"), t.alias("token"), F.hash(F.get("prefix", i + 1)).alias("follows")))

    def lists(of: DataFrame) -> DataFrame:
        # The condition on fp holds always: a join would add it to one of its sides, and the sides would differ.
        rows = of.where("prefix is not null and fp is not null").select("fp", "n", "sig", F.coalesce("id", F.lit(_LAST)).alias("id"), F.explode(entries).alias("e"))
        rows = rows.withColumn("size", F.explode(F.sequence(half(F.col("n")), half(F.floor(F.col("n") * 100 / share)))))
        return rows.select(F.xxhash64("e.token", "size").alias("list"), "e.follows", "e.i", "fp", "n", "sig", "id")

    listed = lists(sets)
    columns = ("follows", "fp", "n", "sig", "id", "i")
    other = lambda df: df.select("list", *[F.col(c).alias("x" + c) for c in columns])
    if only is None:
        listed = listed.repartition(partitions(sets.sparkSession), "list")
        x = other(listed)
        head = F.first(F.struct(*columns)).over(W.partitionBy("list", "follows").orderBy("id", "fp"))
        # A set that fits shorter ones alone looks for partners only where its list holds one that it fits.
        whole = W.partitionBy("list")
        least, most, bit = F.col("n") + 1, _largest(share), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(k, F.lit(64)).cast("int"))
        ones = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.lit(63), F.greatest(F.lit(0), most - F.col("n"))).cast("int")) - 1
        turned = F.call_function("shiftleft", ones, F.pmod(least, F.lit(64)).cast("int")).bitwiseOR(F.call_function("shiftrightunsigned", ones, F.pmod(-least, F.lit(64)).cast("int")))
        longer = F.when(F.col("n") > SHORT, -1).when(most <= F.col("n"), 0).otherwise(turned)
        y = listed.withColumn("h", head).withColumn("all", F.count("*").over(whole)).withColumn("held", F.bit_or(longer).over(whole))
        y = y.where((F.col("all") > 1) & ((most >= F.col("n")) | (F.col("held").bitwiseAND(bit(F.col("n"))) != 0)))
        y = y.select("list", *columns, *[F.col(f"h.{c}").alias("x" + c) for c in columns])
        y = y.withColumn("head", F.when((F.col("xid") < F.col("id")) & _possible(share), F.col("xfp"))).select("list", *columns, "head")
    else:
        y = staged(lists(sets.join(only, "fp", "left_semi"))).withColumn("head", F.lit(None).cast("long"))
        x = other(_marked(listed, "list", y.select("list")))
    meets = F.when(F.col("head").isNotNull(), F.col("xfp") == F.col("head")).otherwise((F.col("xid") <= F.col("id")) & _possible(share))
    # The last term holds always: with it both sides have the same columns, so the lists are dealt out once.
    pairs = y.join(x, "list").where((F.col("fp") != F.col("xfp")) & meets & (F.greatest("follows", "xfollows") >= -(1 << 31)))
    return staged(pairs.groupBy("fp", "xfp").agg(F.bool_or(F.col("head").isNotNull()).alias("quick")))


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str, id_col: str, ranks: DataFrame, share: int) -> DataFrame:
    """pairs with late, the fp of the later set where the whole sets reach the share, else null.

    The documents, then the lines that pairs name are found again by tables of bits, so texts stay where they are
    and only those lines' words travel.
    """
    named = pairs.select("fp").union(pairs.select(F.col("xfp").alias("fp"))).distinct().join(sets.select("fp", "id", "key", "pos"), "fp")
    named = staged(named.withColumn("h", F.xxhash64("key", "pos")))
    every = _marked(docs.select(F.col(text_col).alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("key")), "key", named.select("key"))
    every = every.select("key", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).withColumn("h", F.xxhash64("key", "pos"))
    found = with_tokens(_marked(every, "h", named.select("h")), ranks).select("h", "key", "pos", "tokens")
    at = F.struct(F.col("id").isNull().alias("null"), "id", "key", "pos").alias("at")
    whole = staged(named.select("fp", "h", "id", F.col("key").alias("nkey"), F.col("pos").alias("npos")).join(found, "h").where("key = nkey and pos = npos").select("fp", at, "tokens").dropDuplicates(["fp"]))
    both = pairs.join(whole, "fp").join(whole.select(F.col("fp").alias("xfp"), F.col("at").alias("xat"), F.col("tokens").alias("xtokens")), "xfp")
    common = F.size(F.array_intersect("tokens", "xtokens"))
    good = 100 * common >= share * (F.size("tokens") + F.size("xtokens") - common)
    return staged(both.select("fp", "quick", F.when(good, F.when(F.col("at") > F.col("xat"), F.col("fp")).otherwise(F.col("xfp"))).alias("late")))


def removed_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", share: int = 90) -> DataFrame:
    """(key, pos) of every line that goes; key is row_key(id_col, text_col), pos counts from 0. No row comes twice
    but for rows that repeat both id and text.

    A line is removed when an earlier line, by (id, position) with null ids last, has a set of distinct words
    with 100 * intersection >= share * union. Lines without words stay. All lines are judged on the input. Null
    texts have no lines. Rows that repeat both id and text count as one document. Extra columns are not read.

    Equal sets meet by hash first. Different sets reach the share only with at least ceil(share / (100 - share))
    words; each of these is listed under its rarest words (prefix filter). Sizes, places in the prefix and the
    parity of 64 bits rule pairs out in the join; the rest are verified on whole sets.
    """
    ranks = rarity(docs, text_col)
    n = F.size("tokens")
    least = -(-share // (100 - share)) if share < 100 else 1 << 30
    parity = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))))
    lines = staged(with_tokens(lines_of(docs, text_col, id_col), ranks).select(
        "id", "key", "pos", n.alias("n"), F.xxhash64("tokens").alias("fp"), F.when(n >= least, parity).alias("sig"),
        F.when(n >= least, F.slice("tokens", F.lit(1), n - F.ceil(n * share / 100).cast("int") + 1)).alias("prefix"),
    ))
    at = F.struct(F.col("id").isNull().alias("null"), "id", "key", "pos")
    sets = lines.where("n > 0").groupBy("fp").agg(F.min(at).alias("first"), F.count("*").alias("c"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("prefix").alias("prefix"))
    sets = staged(sets.select("fp", "first.id", "first.key", "first.pos", "c", "n", "sig", "prefix"))
    judged = _verified(_candidates(sets, share), sets, docs, text_col, id_col, ranks, share)
    late = judged.where("late is not null").select(F.col("late").alias("fp")).distinct()
    # Sets whose one quick partner fell through in the check: they meet their whole lists.
    missed = staged(judged.where("quick and late is null").select("fp").distinct().join(late, "fp", "left_anti"))
    if not missed.isEmpty():
        more = _verified(_candidates(sets, share, missed), sets, docs, text_col, id_col, ranks, share)
        late = late.union(more.where("late is not null").select(F.col("late").alias("fp"))).distinct()
    firsts = sets.select("fp", "c", F.col("key").alias("fkey"), F.col("pos").alias("fpos")).join(late.withColumn("late", F.lit(True)), "fp", "left")
    firsts = staged(firsts.where("c > 1 or late").select("fp", "c", "fkey", "fpos", F.coalesce("late", F.lit(False)).alias("late")))
    met = meet(lines.where("n > 0").select("key", "pos", "fp"), firsts, ["fp"], "c", lines.count())
    return met.where("late or key <> fkey or pos <> fpos").select("key", "pos")


def _by_document(removed: DataFrame) -> DataFrame:
    return removed.groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def line_report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", share: int = 90) -> DataFrame:
    """(id_col, n_lines, n_removed, removed): removed lists line numbers from 0, joined by commas. One row for each
    row of docs, repeated rows once for each; null texts have no lines."""
    n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(F.col(text_col), "\n")))
    rows = docs.select(F.col(id_col), row_key(F.col(id_col), F.col(text_col)).alias("key"), n.cast("long").alias("n_lines"))
    out = rows.join(_by_document(removed_lines(docs, text_col, id_col, share)), "key", "left")
    return out.select(id_col, "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))


def without_repeated_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", share: int = 90) -> DataFrame:
    """docs with removed lines taken out of the text; documents of which no line is left go. Texts without a
    removed line stay as they are, null and empty ones too."""
    marks = staged(_by_document(removed_lines(docs, text_col, id_col, share)))
    # A row travels as one struct, so its columns may have any names.
    rows = docs.select(F.struct("*").alias("row"), row_key(F.col(id_col), F.col(text_col)).alias("at"))
    out = rows.join(marks.hint("shuffle_hash"), F.col("at") == F.col("key"), "left")
    text = F.col("row").getField(text_col)
    every = F.split(text, "\n")
    kept = F.array_join(F.filter(every, lambda x, i: ~F.array_contains("gone", i)), "\n")
    out = out.where(F.col("gone").isNull() | (F.size("gone") < F.size(every)))
    new = F.when(F.col("gone").isNull(), text).otherwise(kept)
    return out.select(*[(new if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
