"""From raw text to lines, chunks and candidate facts."""

from __future__ import annotations

from functools import reduce
from html.parser import HTMLParser
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import negated

#: Line rules in order: the first that a line meets names why it goes.
LINE_RULES = [
    ("legal", r"(?i)(copyright|all rights reserved|licen[cs]e|©)"),
    ("contact", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"),
    ("social", r"(?i)(facebook|twitter|instagram|subscribe|newsletter|cookie)"),
    ("promo", r"(?i)(click here|buy now|sign up|free trial)"),
    ("symbols", r"^[^A-Za-zÀ-ÿ0-9]+$"),
]
#: Extraction rules: name, pattern, group of the value.
FACT_RULES = [
    ("email", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]", 0),
    ("address", r"https?://[^ \"'<>]+", 0),
    ("network", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0),
    ("amount", r"(?:R\$|US\$|\$|€) ?([0-9][0-9.,]*[0-9]|[0-9])", 1),
    ("year", r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1),
]
#: For these rules, texts of which each match holds one; only lines with one of them are searched.
HELD = dict(zip([p for _, p, _ in FACT_RULES], [["@"], ["://"], ["."], ["$", "€"], ["19", "20"]], strict=True))

#: Most words of a quote, white space, and what words are made of.
QUOTE_WORDS = 25
_GAP, _INK = r"[ \t\x0B\f\r]", r"[^ \t\x0B\f\r]"


def lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    return docs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))


def judged_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: list[tuple[str, str]] = LINE_RULES) -> DataFrame:
    """(id_col, pos, line, rule): rule is null for a line that stays, so what went can be audited."""
    rule = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        rule = F.when(F.col("line").rlike(pattern), name).otherwise(rule)
    return lines(docs, text_col, id_col).withColumn("rule", rule)


def cleaned(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: list[tuple[str, str]] = LINE_RULES) -> DataFrame:
    """(id_col, text, n_removed) without a shuffle: lines are filtered inside each row."""
    bad = lambda line: reduce(or_, [line.rlike(p) for _, p in rules], F.lit(False))
    every = F.split(F.col(text_col), "\n")
    kept = F.filter(every, lambda x: ~bad(x))
    return docs.select(F.col(id_col), F.array_join(kept, "\n").alias("text"), (F.size(every) - F.size(kept)).cast("bigint").alias("n_removed"))


def chunks(docs: DataFrame, most: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, chunk, n_lines, n_chars): whole lines in chunks; a line opens the chunk in which its first
    character falls when a text's characters are cut every `most`."""
    n = F.length("line") + 1
    by = W.partitionBy(id_col).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    at = lines(docs, text_col, id_col).withColumn("_before", F.coalesce(F.sum(n).over(by), F.lit(0)))
    return at.groupBy(id_col, F.floor(F.col("_before") / most).cast("bigint").alias("chunk")).agg(F.count("*").alias("n_lines"), F.sum(n).cast("bigint").alias("n_chars"))


def quote_round(line: Column, value: Column, at: Column, words: int = QUOTE_WORDS) -> Column:
    """The stretch of a line that holds the value at a 1-based place: the line where it has at most `words` words,
    else so many from half of them before the value; more only where the value itself has more."""
    first = lambda text, n: F.regexp_extract(text, f"^{_INK}*(?:{_GAP}+{_INK}+){{0,{n}}}", 0)
    # Read from its end, so a long line is not searched from every place.
    left = F.reverse(first(F.reverse(F.substring(line, F.lit(1), at - 1)), words // 2))
    least = F.concat(left, value)
    cut = first(F.concat(least, F.substring(line, at + F.length(value), F.length(line))), words - 1)
    cut = F.when(F.length(cut) < F.length(least), least).otherwise(cut)
    bare = F.regexp_replace(line, f"^{_GAP}+|{_GAP}+$", "")
    return F.when(first(bare, words - 1) == bare, bare).otherwise(cut)


def facts(docs: DataFrame, rules: list[tuple[str, str, int]] = FACT_RULES, text_col: str = "text", id_col: str = "doc_id", places: bool = True) -> DataFrame:
    """(id_col, pos, rule, nth, value, at, line, quote): every match of every rule in every line, with the 1-based
    place of the value in the line and the words round it as its quote. All rules run in one pass over the lines;
    their patterns never match nothing. places=False leaves at and quote out, and the work for them."""
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  each pattern cuts a line once

    def matches(name: str, pattern: str, group: int) -> Column:
        found = lambda g: F.regexp_extract_all("line", F.lit(pattern), F.lit(g))
        one = lambda v, i, *at: F.struct(F.lit(name).alias("rule"), i.alias("nth"), v.alias("value"), *at)
        may = reduce(or_, [F.contains("line", F.lit(x)) for x in HELD.get(pattern, [""])])
        if not places:
            return F.when(may, F.transform(found(group), lambda v, i: one(v, i)))
        size = lambda parts: F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))
        # What lies before a match: the pieces between the matches so far, and these.
        before = lambda c, i: size(F.slice(c["pieces"], F.lit(1), i + 1)) + size(F.slice(c["whole"], F.lit(1), i))
        cut = F.struct(F.split("line", pattern).alias("pieces"), found(0).alias("whole"), found(group).alias("values"))
        placed = once(cut, lambda c: F.transform(c["values"], lambda v, i: one(v, i, (before(c, i) + F.instr(F.get(c["whole"], i), v)).alias("at"))))
        return F.when(may & F.col("line").rlike(pattern), placed)

    found = [matches(*rule) for rule in rules]
    every = F.flatten(F.array_compact(F.array(*found)))
    out = lines(docs, text_col, id_col).select(id_col, "pos", "line", F.explode(every).alias("f"))
    if not places:
        return out.select(id_col, "pos", "f.rule", F.col("f.nth").cast("int").alias("nth"), "f.value", "line")
    out = out.select(id_col, "pos", "f.rule", F.col("f.nth").cast("int").alias("nth"), "f.value", "f.at", "line")
    return out.withColumn("quote", quote_round(F.col("line"), F.col("value"), F.col("at")))


def without_negated(found: DataFrame) -> DataFrame:
    """Facts whose value no negation governs at its place in its line."""
    return found.where(~negated(F.col("line"), F.col("at")))


def best_quote(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One quote for each value: the longest, then the earliest."""
    return found.groupBy(id_col, "rule", "value").agg(F.max_by("quote", F.struct(F.length("quote").alias("n"), (-F.col("pos")).alias("p"))).alias("quote"), F.count("*").alias("n_found"))


def labelled(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, pos, label, value) of lines 'Label: value'."""
    part = lambda i: F.regexp_extract("line", r"^ *([^:\n]{2,40}): +([^ ].*)$", i)
    return lines(docs, text_col, id_col).select(id_col, "pos", part(1).alias("label"), part(2).alias("value")).where("label <> ''")


def columns_of_line(line: Column) -> Column:
    """Cells of a line set in columns: parted by tabs or at least two spaces."""
    return F.filter(F.split(line, r" {2,}|\t+"), lambda x: F.trim(x) != "")


def is_table_text(text: Column, least: int = 20) -> Column:
    """Whether more than 5 % of at least `least` non-blank lines are set in columns."""
    every = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    wide = F.filter(every, lambda x: F.size(columns_of_line(x)) >= 2)
    return (F.size(every) >= least) & (F.size(wide) * 20 > F.size(every))


class _Text(HTMLParser):
    SKIP = frozenset(("script", "style", "noscript", "template", "svg", "head"))
    BREAK = frozenset(("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "section", "article", "nav"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        if tag in self.BREAK:
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append("\t")

    def handle_endtag(self, tag):
        self.skip -= tag in self.SKIP and self.skip > 0
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def _html_text(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    rows = ("".join(p.out)).split("\n")
    return "\n".join(x for x in ("\t".join(" ".join(c.split()) for c in r.split("\t")).strip() for r in rows) if x)


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and heads dropped, blocks on lines of their own, table cells behind tabs. Rows go
    to Python a hundred at a time, not as Arrow batches of ten thousand pages that a worker would hold several times."""
    return F.udf(_html_text, T.StringType(), useArrow=False)(html)
