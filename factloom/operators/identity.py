"""Whether a document, a quote or a price record speaks of the entity that is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import distinctive, fold, host, once, tokens

COMPATIBLE, INCOMPATIBLE, INSUFFICIENT = "compatible", "incompatible", "insufficient"
#: Version names, a longer one before those it holds.
VERSIONS = ["limited plus", "limited", "extreme", "comfortline", "highline", "raptor", "high country", "trail boss", "srx plus", "srx", "srv", "xls", "xlt", "xl", "tremor", "wildtrak", "black"]
#: Signs of a home and of a foreign market, and words by which a gearbox and driven wheels are named.
HOME, HOME_HOST = r"\bbra[sz]il\b|\bmercado brasileiro\b", ".com.br"
FOREIGN, FOREIGN_HOSTS = r"\b(?:mercado|market) ?(?:de|:)? ?(?:united states|usa|australia|south africa|argentina)\b", [".com.au", ".co.za", ".com.ar"]
AUTOMATIC, MANUAL = r"\b(?:at|aut|automatic[ao])\b", r"\b(?:mt|manual)\b"
FOUR, TWO = r"\b(?:4wd|4x4|awd|4motion|integral)\b", r"\b(?:4x2|2wd|traseira|dianteira)\b"
#: Words behind which a year is a day of capture, not a model's year.
CAPTURED = r"\b(?:captura|publicado|copyright)\b"


def engines(text: Column) -> Column:
    """array<string>: engine sizes in litres, once each, with a point."""
    return F.array_distinct(F.regexp_extract_all(F.translate(fold(text), ",", "."), F.lit(r"(?<![0-9.])([1-8]\.[0-9])(?![0-9.])"), F.lit(1)))


def _plain(text: Column) -> Column:
    """Words of folded text, one space between and round them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")), F.lit(" "))


def _has(text: Column, word: Column) -> Column:
    """Whether folded text has word as whole words; a word that is null or blank is in every text."""
    return F.contains(_plain(text), _plain(fold(F.coalesce(word, F.lit("")))))


def versions_named(text: Column, names: list[str] = VERSIONS) -> Column:
    """array<string>, sorted: the names that a text has as whole words, from left to right, the longest first."""
    return named_in(fold(F.coalesce(text, F.lit(""))), names)


def named_in(folded: Column, names: list[str] = VERSIONS) -> Column:
    """versions_named() of a text that is folded already."""
    longest = "|".join(sorted(names, key=lambda x: (-len(x), x)))
    return F.sort_array(F.array_distinct(F.regexp_extract_all(folded, F.lit(rf"\b({longest})\b"), F.lit(1))))


def claim_refused(version: Column, quote: Column, names: list[str] = VERSIONS) -> Column:
    """other_version where a quote names versions and not just the one asked for; else null."""
    want, got = versions_named(version, names), versions_named(quote, names)
    return F.when((F.size(want) > 0) & (F.size(got) > 0) & (want != got), "other_version")


def model_years(text: Column, model: Column) -> Column:
    """array<int>, sorted: years of lines that name the model or say model year; what follows a word of capture in a
    line does not count."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(fold(x), rf"{CAPTURED}.*$", ""))
    told = F.filter(lines, lambda x: _has(x, model) | x.rlike(r"\b(?:ano[ -]?modelo|modelo|linha|my) ?[: -]? ?20[0-9]{2}\b"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(told, lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"\b(20[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))))))


def identity(text: Column, url: Column, brand: Column, model: Column, version: Column, year: Column) -> Column:
    """struct(state, reasons): incompatible with every contradiction found, insufficient with what the text leaves
    out, else compatible. Missing knowledge is never taken for agreement; a url may refuse, but proves no year."""
    asked = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(url, F.lit("")).alias("url"), brand.alias("brand"), model.alias("model"), F.coalesce(version, F.lit("")).alias("version"), year.alias("year"))
    return once(once(asked, _read), _judged)


def _read(p: Column) -> Column:
    """What identity() reads from a text and a request, each thing once."""
    words = F.filter(distinctive(p["version"]), lambda w: w.rlike("^[a-z]{2,}$") & ~w.isin("turbo", "aut"))
    return F.struct(
        fold(p["text"]).alias("body"), _plain(fold(p["text"])).alias("plain"), host(p["url"]).alias("host"), p["url"].alias("url"), p["brand"].alias("brand"), p["model"].alias("model"), p["year"].alias("year"), fold(p["version"]).alias("want"),
        engines(p["version"]).alias("wanted"), engines(p["text"]).alias("seen"), model_years(p["text"], p["model"]).alias("years"), words.alias("words"),
        claim_refused(p["version"], F.get(F.split(p["text"], "\n"), F.lit(0))).isNotNull().alias("other"))


def _judged(p: Column) -> Column:
    """identity()'s struct from what _read() gives."""
    body, where, year, years, want = p["body"], p["host"], p["year"], p["years"], p["want"]
    foreign = body.rlike(FOREIGN)
    for end in FOREIGN_HOSTS:
        foreign = foreign | where.endswith(end)
    home = body.rlike(HOME) | where.endswith(HOME_HOST) | F.contains(p["url"], F.lit("/br/"))
    gear, drive = (F.regexp_extract(body, rf"\b(?:{w}) ?[:|=-]? ?([a-z0-9]+)", 1) for w in ("cambio|transmissao", "tracao"))
    said = F.array_contains(years, year)
    against = [
        (foreign, "market"), ((F.size(p["wanted"]) > 0) & (F.size(p["seen"]) > 0) & ~F.arrays_overlap(p["wanted"], p["seen"]), "engine"),
        ((want.rlike(AUTOMATIC) & gear.rlike(MANUAL)) | (want.rlike(MANUAL) & gear.rlike(AUTOMATIC)), "gearbox"),
        ((want.rlike(FOUR) & drive.rlike(TWO)) | (want.rlike(TWO) & drive.rlike(FOUR)), "driven_wheels"),
        (year.isNotNull() & (F.size(years) > 0) & ~said, "year"), (year.isNotNull() & (F.size(years) > 1) & said, "several_years"), (p["other"], "version"),
    ]
    has = lambda word: F.contains(p["plain"], _plain(fold(F.coalesce(word, F.lit("")))))
    without = [
        (~has(p["brand"]), "brand"), (~has(p["model"]), "model"), (~home & ~foreign, "market"), ((F.size(p["wanted"]) > 0) & (F.size(p["seen"]) == 0), "engine"),
        (year.isNotNull() & (F.size(years) == 0), "year"), (~F.forall(p["words"], has), "version"),
    ]
    listed = lambda rules: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for c, name in rules]))
    state = lambda name, reasons: F.struct(F.lit(name).alias("state"), reasons.alias("reasons"))
    told = lambda r: F.when(F.size(r["bad"]) > 0, state(INCOMPATIBLE, r["bad"])).when(F.size(r["lack"]) > 0, state(INSUFFICIENT, r["lack"])).otherwise(state(COMPATIBLE, r["lack"]))
    return once(F.struct(listed(against).alias("bad"), listed(without).alias("lack")), told)


def record_refused(record: Column, record_brand: Column, record_year: Column, brand: Column, model: Column, version: Column, year: Column) -> Column:
    """Why a price record is not the entity's: no_name, engine, model, brand, version or year; null where it is."""
    have, of_model = tokens(record, []), tokens(model, [])
    a, b = engines(version), engines(record)
    own = F.array_except(distinctive(version), of_model)
    telling = F.filter(own, lambda w: ~w.rlike(r"^v?[0-9.]+$"))
    need = F.when(F.size(telling) > 0, telling).otherwise(own)
    lacks = lambda x: F.size(F.array_except(x, have)) > 0
    return (
        F.when(F.coalesce(F.trim(record), F.lit("")) == "", "no_name").when((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), "engine").when((F.size(of_model) == 0) | lacks(of_model), "model")
        .when((F.coalesce(record_brand, F.lit("")) != "") & ~F.arrays_overlap(tokens(record_brand, []), tokens(brand, [])), "brand").when(lacks(need), "version").when(year.isNotNull() & ~record_year.eqNullSafe(year), "year")
    )


def mentions(model: Column, *places: Column) -> Column:
    """Whether an address, title or excerpt has the model's letters and digits in a row; a blank model is nowhere."""
    squash = lambda x: F.regexp_replace(fold(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "")
    hit = F.lit(False)
    for p in places:
        hit = hit | F.contains(squash(p), squash(model))
    return (squash(model) != "") & hit


def fields_by_version(found: DataFrame, source: str, field: str, owner: str, least: int = 2) -> DataFrame:
    """(source, field, n_versions) of the fields that a source states under at least so many versions' headings."""
    one = found.where(F.col(owner).isNotNull()).groupBy(source, field, owner).agg(F.count("*").alias("_n"))
    return one.groupBy(source, field).agg(F.count("*").alias("n_versions")).where(F.col("n_versions") >= least)
