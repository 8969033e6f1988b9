"""Connectors: what saved pages of makers, price tables, third-party sheets and warranty papers say.

A connector is a set of declared rules; Spark's own readers fetch the pages, so any store that Spark reads will do, and
Columns do the reading. Every value comes with the words that it was read from, every page without a value with the
reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import parse_price
from ..functions.text import fold, host, under
from .captures import consumption_sentences, price_reply

#: Characters behind a name in which its price may stand.
PRICE_REACH = 240
#: Words that may follow a label in a version's name.
NAME_WORDS = 7


@dataclass(frozen=True)
class LineUp:
    """A maker's rules: labels that begin the names of its versions, the prices that are plausible, and whether a
    label stands for one version (a page of one model) or several (a page that compares)."""
    brand: str
    labels: tuple[str, ...]
    least: int = 50_000
    most: int = 2_000_000
    one_for_each_label: bool = True


def visible(page: Column) -> Column:
    """A page's text: tags are spaces, white space is one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(page, F.lit("")), r"<[^>]+>", " "), r"\s+", " "))


def versions(pages: DataFrame, rules: LineUp, id_col: str = "page_id", text_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """(versions, rejected) of line-up pages.

    versions: (id_col, brand, name, year, price, quote). A name begins with a label, goes on for at most NAME_WORDS
    words and ends before a year 20xx; its price stands in the PRICE_REACH characters behind, null where none is
    plausible. Of equal names (but for case) of a page the first with a price stays, else the first; of those that share
    a label, where the rules say so, the one of the latest year, then of most words, then the first.
    rejected: (id_col, reason) of pages without a version: blank, no_label or no_year. Null pages are blank; repeated
    rows of a page count once."""
    each = "|".join(sorted(rules.labels, key=lambda x: (-len(x), x)))
    found = rf"\b((?:{each})(?!\s+(?:{each})\b)(?: [\w.,ªºÀ-ÿ-]+){{0,{NAME_WORDS}}}?) (20[0-9]{{2}})\b(?=(.{{0,{PRICE_REACH}}}))"
    t = pages.select(id_col, visible(F.col(text_col)).alias("_t")).distinct()
    group = lambda i: F.regexp_extract_all("_t", F.lit(found), F.lit(i))
    rows = t.select(id_col, F.posexplode(F.arrays_zip(group(1).alias("name"), group(2).alias("year"), group(3).alias("behind"))).alias("_at", "_v"))
    rows = rows.select(id_col, "_at", F.regexp_replace("_v.name", r"^[ ,.-]+|[ ,.-]+$", "").alias("name"), F.col("_v.year").cast("int").alias("year"), F.regexp_extract("_v.behind", r"R\$ ?([0-9.]{6,12})", 0).alias("_p"))
    price = parse_price(F.col("_p")).cast("long")
    rows = rows.where(F.length("name") >= 3).withColumn("price", F.when(price.between(rules.least, rules.most), price))
    quote = F.concat_ws(" ", "name", F.col("year").cast("string"), F.when(F.col("price").isNotNull(), F.col("_p")))
    named = rows.withColumn("quote", quote).groupBy(id_col, F.lower("name").alias("_k")).agg(
        F.min_by(F.struct("name", "year", "price", "quote"), F.struct(F.col("price").isNull(), "_at")).alias("v"), F.min("_at").alias("_at"))
    if rules.one_for_each_label:
        order = F.struct(F.col("v.year"), F.size(F.split("v.name", " ")), -F.col("_at"))
        named = named.groupBy(id_col, F.substring_index("_k", " ", 1).alias("_l")).agg(F.max_by("v", order).alias("v"))
    good = named.select(id_col, F.lit(rules.brand).alias("brand"), "v.*")
    why = F.when(F.col("_t") == "", "blank").when(~F.col("_t").rlike(rf"\b(?:{each})\b"), "no_label").otherwise("no_year")
    bad = t.join(good.select(id_col).distinct(), id_col, "left_anti").select(id_col, why.alias("reason"))
    return good, bad


def read(spark: SparkSession, path: str, rules: LineUp, pattern: str = "*.html") -> tuple[DataFrame, DataFrame]:
    """versions() of all pages under path; file is the id."""
    pages = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("html"))
    return versions(pages, rules, "file", "html")


def price_page(text: Column, url: Column) -> Column:
    """struct(code, price, month, year, fuel, model, quote, reason) of a saved price page or a price service's reply.

    A page writes `label: value` lines; nothing is taken from its title. The reply's own form wins where there is one.
    The quote is the price as written. reason says what is lacking: price, month, or both; null where both are there."""
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  an expression bound once, not written out at each use
    line = lambda label: rf"(?im)\b{label}(?: [a-z]+)?[ \t]*:[ \t]*"
    written = line("pre[cç]o") + r"(R\$ ?[0-9.,]*[0-9])"

    def parts(t: Column) -> Column:
        got = lambda pattern, i=1: F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))
        return F.struct(
            price_reply(F.regexp_extract(t, r"(?s)(\{.*\})", 1)).alias("reply"), got(line("c[oó]digo") + "([0-9]{6}-[0-9])").alias("code"), parse_price(got(written)).alias("price"),
            got(line("refer[eê]ncia") + "([a-zç]+(?: de)? ?/? ?20[0-9]{2})").alias("month"), got(line("ano") + r"((?:19|20)[0-9]{2})\b").cast("int").alias("year"),
            F.lower(got(line("ano") + r"(?:19|20)[0-9]{2}[ \t]+([\p{L}]+)")).alias("fuel"), F.trim(got(line("modelo") + r"([^\n]+)")).alias("model"), got(written, 0).alias("quote"))

    def whole(p: Column) -> Column:
        both = {c: F.coalesce(p["reply"][c], p[c]) for c in ("code", "price", "month", "quote")}
        lacking = F.concat_ws(",", F.when(both["price"].isNull(), "price"), F.when(both["month"].isNull(), "month"))
        return F.struct(*[c.alias(n) for n, c in both.items()], p["year"].alias("year"), p["fuel"].alias("fuel"), p["model"].alias("model"), F.nullif(lacking, F.lit("")).alias("reason"), url.alias("url"))

    return once(once(F.coalesce(text, F.lit("")), parts), whole)


def sheet_pairs(pages: DataFrame, domain: str, year: Column, id_col: str = "page_id", text_col: str = "text", url_col: str = "url", within: int = 3000) -> tuple[DataFrame, DataFrame]:
    """(pairs, rejected) of third-party sheets: (id_col, label, value, line) of the cells of pipe tables, read two by
    two, for pages that are under the domain and state the year asked for.

    rejected: (id_col, reason): foreign_address or year_not_stated; the year must stand in a line behind the word ano
    that begins in the first `within` characters, where such a sheet names its subject. Cells without label or value, or whose value is a dash, are no
    pairs. A caller judges model and version by identity.identity(). Null texts and years state nothing."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    states = F.regexp_like(F.substring(t, 1, within), F.concat(F.lit(r"(?i)\bano\b[^\n]*\b"), year.cast("string"), F.lit(r"\b")))
    here = under(host(F.col(url_col)), F.lit(domain))
    why = F.when(~F.coalesce(here, F.lit(False)), "foreign_address").when(~F.coalesce(states, F.lit(False)), "year_not_stated")
    judged = pages.withColumn("_why", why)
    rows = judged.where("_why is null").select(id_col, F.posexplode(F.split(t, "\n")).alias("line", "_l")).where(F.col("_l").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace("_l", r"^\|+|[|\s]+$", ""), r"\|"), lambda x: F.trim(F.regexp_replace(x, r"\*\*|\s+", " ")))
    pair = lambda c: F.transform(F.sequence(F.lit(0), F.floor(F.size(c) / 2).cast("int") - 1), lambda i: F.struct(F.get(c, 2 * i).alias("label"), F.get(c, 2 * i + 1).alias("value")))
    rows = rows.withColumn("_c", cells).where(F.size("_c") >= 2).select(id_col, "line", F.explode(pair(F.col("_c"))).alias("p")).select(id_col, "p.label", "p.value", "line")
    good = rows.where((F.col("label") != "") & (F.col("value") != "") & ~F.col("value").isin("-", "–", "—"))
    return good, judged.where("_why is not null").select(id_col, F.col("_why").alias("reason"))


def warranty(papers: DataFrame, proofs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(claims, rejected) of warranty papers.

    papers: id_col, text, model, year; proofs: (id_col, sha256), the digest under which a paper was registered.
    claims: (id_col, months, quote) of every line that names warranty, model and year, in any order before a number of
    years; equal quotes of a paper count once. rejected: (id_col, reason): no_proof, changed (another digest) or
    no_clause. A paper's text counts whole; no default is ever assumed."""
    j = papers.join(proofs, id_col, "left")
    good = j.where(F.sha2(F.col(text_col), 256) == F.col("sha256"))
    lines = good.select(id_col, "model", "year", F.explode(F.array_distinct(F.split(text_col, "\n"))).alias("_l")).withColumn("_f", fold(F.col("_l")))
    word = lambda x: F.concat(F.lit("(?<![0-9a-z])"), F.regexp_replace(x, r"([^\p{Alnum} ])", r"\\$1"), F.lit("(?![0-9a-z])"))
    span = r"(?i)\bgarantia\b[^\n]*?\b([1-9][0-9]?)[ \t]+anos?\b"
    hits = lines.where(F.col("_l").rlike(span) & F.regexp_like("_f", word(fold(F.col("model")))) & F.regexp_like("_f", word(F.col("year").cast("string"))))
    claims = hits.select(id_col, (F.regexp_extract("_l", span, 1).cast("int") * 12).alias("months"), F.trim("_l").alias("quote")).distinct()
    why = F.when(F.col("sha256").isNull(), "no_proof").when(F.coalesce(F.sha2(F.col(text_col), 256) != F.col("sha256"), F.lit(True)), "changed").otherwise("no_clause")
    return claims, j.join(claims.select(id_col).distinct(), id_col, "left_anti").select(id_col, why.alias("reason"))


def service_claims(replies: DataFrame, consumption: DataFrame, prices: DataFrame, id_col: str = "entity") -> DataFrame:
    """(id_col, field, num, unit, quote, stage, tier): claims of the three services, each with its own literal words.

    replies: id_col, body (price service, tier 2); consumption: id_col, text (register of consumption, tier 2); prices:
    id_col, price, quote (the maker's line-up, tier 1). What a service does not say is no claim."""
    said = lambda df, *claims: df.select(id_col, F.inline(F.array(*claims)))
    claim = lambda field, num, unit, quote, stage, tier: F.struct(F.lit(field).alias("field"), num.cast("double").alias("num"), F.lit(unit).alias("unit"), quote.alias("quote"), F.lit(stage).alias("stage"), F.lit(tier).alias("tier"))
    r = replies.withColumn("_r", price_reply(F.col("body")))
    sentence = F.regexp_extract("text", r"[^.;\n]*?[0-9]+(?:[.,][0-9]+)? ?km/l[^.;\n]{0,60}?[0-9]+(?:[.,][0-9]+)? ?km/l", 0)
    c = consumption.withColumn("_c", F.get(consumption_sentences(F.col("text")), F.lit(0))).withColumn("_q", F.trim(sentence))
    out = said(r, claim("market_price", F.col("_r.price"), "BRL", F.col("_r.quote"), "commercial", 2))
    out = out.unionByName(said(c, claim("urban", F.col("_c.urban"), "km/l", F.col("_q"), "consumption", 2), claim("highway", F.col("_c.highway"), "km/l", F.col("_q"), "consumption", 2)))
    return out.unionByName(said(prices, claim("list_price", F.col("price"), "BRL", F.col("quote"), "list_price", 1))).where("num is not null and coalesce(quote, '') <> ''")
