"""Which section of a document a quote stands in: sections of versions and of options, and the innermost one of a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold, once
from .identity import VERSIONS, named_in, versions_named

#: A heading of options, and words by which a version's heading says that it is one of options.
OPTIONS, OPTION_KIT = r"^(?:kit|pacote)s? (?:de )?opciona(?:l|is)[: ]*$", r"\b(?:kit|pacote) opciona[li]"
#: Longest line that is a version's heading.
HEADING = 160


_HEADS = "array<struct<at:bigint,level:int,option:boolean,kit:boolean,names:array<string>>>"


def _folded_lines(text: Column) -> Column:
    """array<struct<line, f>>: the lines that are not blank, as they are and folded."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), fold(x).alias("f"))), lambda x: x["f"] != "")


def _heads(lines: Column, names: list[str], options: str) -> Column:
    """The headings among _folded_lines() in order; a line that is none costs the tests that say so, and no more."""
    def judged(line: Column, bare: Column) -> Column:
        dated = bare.rlike(r"\b20[0-9]{2}\b") | bare.rlike(r"(?<![0-9.,])[1-8][.,][0-9](?![0-9.,])")
        option = bare.rlike(options)
        named = F.when(~option & (F.length(bare) < HEADING) & dated, named_in(bare, names))
        return F.struct(F.nullif(F.length(F.regexp_extract(line, r"^\s*(#{1,6})\s", 1)), F.lit(0)).alias("level"), option.alias("option"), F.when(F.size(named) > 0, named).alias("names"))

    def step(past: Column, x: Column) -> Column:
        def seen(o: Column) -> Column:
            head = lambda j: F.struct(past["at"].alias("at"), j["level"].alias("level"), j["option"].alias("option"), o["bare"].rlike(OPTION_KIT).alias("kit"), j["names"].alias("names"))
            kept = lambda j: j["level"].isNotNull() | j["option"] | j["names"].isNotNull()
            return once(judged(x["line"], o["bare"]), lambda j: F.when(kept(j), F.concat(past["heads"], F.array(head(j)))).otherwise(past["heads"]))

        bare = F.struct(F.regexp_replace(x["f"], r"^[#* |\-]+|[#* |\-]+$", "").alias("bare"))
        return F.struct((past["at"] + F.length(x["f"]) + 1).alias("at"), once(bare, seen).alias("heads"))

    return F.aggregate(lines, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_HEADS).alias("heads")), step, lambda past: past["heads"])


def headings(docs: DataFrame, names: list[str] = VERSIONS, options: str = OPTIONS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, heads): the headings of each text in order, array<struct<at, level, option, kit, names>>, empty for a
    text without.

    Lines count that are not blank, folded and joined by one space: at is a heading's place in that text, level its
    number of # signs, null without. option: a heading of options. names: versions that a short line with a year or an
    engine size names, null where it is no version's heading; other lines with # only end sections. A text is read
    inside its row: its lines meet no shuffle."""
    return docs.select(F.col(id_col), _heads(_folded_lines(F.col(text_col)), names, options).alias("heads"))


def _option_spans(heads: Column) -> Column:
    """Stretches under headings of options: up to the next other heading of the same level or a higher one; a heading
    without level holds up to the next version or options."""
    never = F.lit(1 << 62)

    def stop(h: Column) -> Column:
        later = F.filter(heads, lambda x: (x["at"] > h["at"]) & F.when(h["level"].isNull(), x["option"] | x["names"].isNotNull()).otherwise(~x["option"] & F.coalesce(x["level"] <= h["level"], F.lit(False))))
        return F.coalesce(F.get(later, F.lit(0))["at"], never)

    return F.transform(F.filter(heads, lambda h: h["option"]), lambda h: F.struct(h["at"].alias("a"), stop(h).alias("b")))


def _reason(p: Column, heads: Column, spans: Column, wanted: Column, asks: Column) -> Column:
    """struct(known, reason) of place p: known where a section is open before it or was."""
    past = F.filter(heads, lambda h: h["at"] <= p)
    closed = F.filter(spans, lambda s: s["b"] <= p)
    first = F.array_min(F.transform(F.filter(spans, lambda s: (s["a"] <= p) & (p < s["b"])), lambda s: s["a"]))

    def judge(o: Column) -> Column:
        mine = F.filter(o["past"], lambda h: h["names"].isNotNull() & (o["first"].isNull() | (h["at"] >= o["first"])) & ~F.exists(o["closed"], lambda s: (s["a"] <= h["at"]) & (h["at"] < s["b"])))
        known = F.exists(o["past"], lambda h: h["option"] | h["names"].isNotNull())
        return once(F.try_element_at(mine, F.lit(-1)), lambda v: F.struct(known.alias("known"), F.coalesce(
            F.when((F.size(wanted) > 0) & (v["names"] != wanted), "other_version_section"), F.when(~asks & (o["first"].isNotNull() | F.coalesce(v["kit"], F.lit(False))), "option_section")).alias("reason")))

    return once(F.struct(past.alias("past"), closed.alias("closed"), first.alias("first")), judge)


def _places(text: Column, quote: Column) -> Column:
    """array<int>: where a quote stands in a text, from 0, one behind the other."""
    def before(pieces: Column, k: Column) -> Column:
        return F.aggregate(F.slice(pieces, F.lit(1), k + 1), F.lit(0), lambda a, x: a + F.length(x)) + k * F.length(quote)

    pieces = F.split(text, F.concat(F.lit("\\Q"), quote, F.lit("\\E")), -1)
    return F.when(quote != "", once(pieces, lambda x: F.transform(F.slice(x, F.lit(2), F.size(x)), lambda _, k: before(x, k))))


def claim_scope(claims: DataFrame, docs: DataFrame, names: list[str] = VERSIONS, options: str = OPTIONS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """claims (id_col, version, quote, asks_option, ...) with refused, why a quote is not of the version asked for:

    - other_version: the quote itself names versions, and not just that one;
    - other_version_section: it stands under another version's heading;
    - option_section: it stands among options, and none are asked for;

    else null. A quote that also stands where it may is not refused, nor is one before any such heading, in no
    document or nowhere in it. Claims meet the text and the headings of their document alone."""
    # Lines are folded once for the text and its headings; stretches are worked out for a document, not for each claim.
    d = docs.select(F.col(id_col), _folded_lines(F.col(text_col)).alias("_lines"))
    d = d.select(id_col, F.array_join(F.transform("_lines", lambda x: x["f"]), " ").alias("_text"), _heads(F.col("_lines"), names, options).alias("heads"))
    d = d.withColumn("_spans", _option_spans(F.col("heads")))
    j = claims.join(d, id_col, "left")
    wanted, said = versions_named(F.col("version"), names), versions_named(F.col("quote"), names)
    j = j.withColumn("_wanted", wanted).withColumn("_said", said).withColumn("_at", _places(F.col("_text"), fold(F.coalesce("quote", F.lit("")))))
    found = F.filter(F.transform("_at", lambda p: _reason(p, F.col("heads"), F.col("_spans"), F.col("_wanted"), F.coalesce("asks_option", F.lit(False)))), lambda c: c["known"])
    j = j.withColumn("_c", found)
    quoted = F.when((F.size("_wanted") > 0) & (F.size("_said") > 0) & (F.col("_wanted") != F.col("_said")), "other_version")
    placed = F.when((F.size("_c") > 0) & F.forall("_c", lambda c: c["reason"].isNotNull()), F.get("_c", F.lit(0))["reason"])
    return j.withColumn("refused", F.coalesce(quoted, placed)).select(*claims.columns, "refused")
