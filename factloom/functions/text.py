"""Text, URL, JSON and array helpers as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and the letters they fold to, position by position.
MARKED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"
#: Words that say a thing is absent.
ABSENT = ["-", "–", "n/d", "nd", "n/a", "na", "não disponível", "nao disponivel", "indisponível", "not available"]
#: Words that negate what follows them in the same sentence.
NEGATION = r"(?:^|[^a-z])(não|nao|sem|not|no|without|kein|keine|ohne|sin|sans|pas)(?:[^a-z]|$)"
STOP = ["de", "do", "da", "e", "o", "a", "the", "of", "and", "com", "para"]


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x worked out once however often f names it: a fold over nothing, whose last step is f. To take it out
    of an array instead would work out the type of all of f for every row."""
    return F.aggregate(F.array(), x, lambda a, _: a, f)


#: Quotes and hyphens of other kinds and those they become, position by position.
QUOTES, HYPHENS = "“”„«»", "‐‑‒–—"


def _spaced(text: Column, marked: str, plain: str) -> Column:
    """Lower case, marked letters as plain ones, runs of white space as one space. Texts of as many bytes as characters
    hold no mark, so those are not read for any; a single space is left alone."""
    low = F.lower(text)
    t = F.when(F.octet_length(text) == F.char_length(text), low).otherwise(F.translate(low, marked, plain))
    return F.trim(F.regexp_replace(t, r"[\t\n\x0B\f\r\xA0][ \t\n\x0B\f\r\xA0]*| [ \t\n\x0B\f\r\xA0]+", " "))


def squeeze(text: Column) -> Column:
    """Lower case, quotes and hyphens of one kind, runs of white space as one space."""
    return _spaced(text, QUOTES + HYPHENS, '"' * len(QUOTES) + "-" * len(HYPHENS))


def fold(text: Column) -> Column:
    """squeeze() without the marks of Latin letters."""
    return _spaced(text, QUOTES + HYPHENS + MARKED, '"' * len(QUOTES) + "-" * len(HYPHENS) + PLAIN)


def slug(text: Column) -> Column:
    """Letters a-z and digits, all else as one _; never empty: x stands for nothing."""
    return slug_of(fold(text))


def slug_of(folded: Column) -> Column:
    """slug() of a text that is folded already."""
    return once(F.btrim(F.regexp_replace(folded, "[^a-z0-9]+", "_"), F.lit("_")), lambda s: F.when(s == "", F.lit("x")).otherwise(s))


def label(text: Column) -> Column:
    """fold() without what stands in brackets."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(text), r"\([^)]*\)", " "), " +", " "))


def tokens(text: Column, stop: list[str] = STOP) -> Column:
    """Words without stop words; all words where nothing else is left."""
    return tokens_of(fold(text), stop)


def tokens_of(folded: Column, stop: list[str] = STOP) -> Column:
    """tokens() of a text that is folded already."""
    every = F.filter(F.split(folded, "[^a-z0-9]+"), lambda w: w != "")
    if not stop:
        return every
    return once(every, lambda e: once(F.filter(e, lambda w: ~w.isin(stop)), lambda kept: F.when(F.size(kept) == 0, e).otherwise(kept)))


#: Words of a version's name that tell no version from another.
IGNORED = ["at", "mt", "4x4", "4x2", "4wd", "2wd", "awd", "automatico", "automatica", "manual"]
#: Words that distinguish nothing in a consumption table, and abbreviations used there.
GENERIC = [
    "diesel", "gasolina", "flex", "automatico", "manual", "at", "mt", "cabine", "dupla", "simples", "4x4", "4x2", "4wd", "2wd", "awd", "4", "wide", "tread", "power", "pack", "e", "de", "da", "do", "com",
    "km", "l",
]
SHORT = {"ltd+": "limited plus", "ltd": "limited", "hc": "high country", "h.country": "high country", "p-up": "pick-up", "cd": "cabine dupla", "cs": "cabine simples", "ch": "chassi"}


def version_name(text: Column) -> Column:
    """A version's name folded, its words, figures and points alone, without words that distinguish nothing; in order."""
    words = F.split(F.regexp_replace(F.translate(fold(text), "×", "x"), r"[^a-z0-9_.]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(IGNORED)), " ")


def distinctive(text: Column) -> Column:
    """array<string>: the words that tell a name from others, abbreviations written out, once each."""
    full = fold(text)
    for short, long in SHORT.items():
        literal = "".join("\\" + c if c in "+.-" else c for c in short)
        full = F.regexp_replace(full, rf"(?<![\w.]){literal}(?![\w])", long)
    return F.array_distinct(F.filter(F.split(full, "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(GENERIC)))


def canonical_version(model: Column, name: Column) -> Column:
    """A version's name without its model's words at the head; the whole name where nothing else is left."""
    m, n = tokens(model, []), tokens(name, [])
    same = F.transform(n, lambda w, i: F.coalesce(w == F.get(m, i), F.lit(False)))
    head = F.array_position(F.array_append(same, F.lit(False)), F.lit(False)) - 1
    rest = F.slice(n, head.cast("int") + 1, F.greatest(F.lit(1), F.size(n)))
    return F.array_join(F.when(F.size(rest) == 0, n).otherwise(rest), " ")


#: Words by which a source says that it measured a value, or that a maker states it; the first kind
#: that stands in a text decides.
MEASURED = ["medimos", "medido", "medida", "mediu", "medição", "medicao", "teste", "testes", "cronometr[a-zà-ÿ]*", "apurou", "registrou", "aferi[a-zà-ÿ]*"]
DECLARED = [
    "declara", "declarado", "declarada", "declaram", "declaração", "declaracao", "segundo [ao] fabricante", "segundo [ao] montadora", "segundo [ao] marca", "informa", "informado", "informada", "informações",
    "informacoes", "promete", "de fábrica", "de fabrica", "dados? oficial", "dados? oficiais", "ficha técnica", "ficha tecnica",
]
CLAIMS = [(kind, rf"(?i)(?:^|[^\p{{L}}0-9_])({'|'.join(words)})(?:[^\p{{L}}0-9_]|$)") for kind, words in (("measured", MEASURED), ("declared", DECLARED))]


def claim(raw: Column, quote: Column) -> Column:
    """struct(kind, term): measured, declared or null with the words that say so; the raw value counts before its quote."""
    kind, term = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in (quote, raw):
        for name, pattern in reversed(CLAIMS):
            hit = F.coalesce(text.rlike(pattern), F.lit(False))
            kind, term = F.when(hit, name).otherwise(kind), F.when(hit, F.regexp_extract(text, pattern, 1)).otherwise(term)
    return F.struct(kind.alias("kind"), term.alias("term"))


def split_list(text: Column) -> Column:
    """Items between , ; + and the word e, of two characters or more, in order and once each."""
    items = F.transform(F.split(F.lower(text), r"[,;+]| e "), lambda x: F.trim(x))
    return F.array_distinct(F.filter(items, lambda x: F.length(x) > 1))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def same_items(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def is_absent(text: Column) -> Column:
    """A declared absence, not a missing value."""
    return F.coalesce(F.lower(F.trim(text)).isin(ABSENT), F.lit(False))


def negated(text: Column, start: Column, reach: int = 80) -> Column:
    """Whether a negation stands within reach before a 1-based place, in the same sentence."""
    left = F.substring(text, F.greatest(F.lit(1), start - reach), F.least(F.lit(reach), start - 1))
    return F.regexp_replace(F.lower(left), r"(?s)^.*[.!?\n]", "").rlike(NEGATION)


def line_at(text: Column, start: Column, most: int = 200) -> Column:
    """The line that holds a 1-based place, cut to `most` characters."""
    before = F.substring_index(F.substring(text, F.lit(1), start - 1), "\n", -1)
    after = F.substring_index(F.substring(text, start, F.length(text)), "\n", 1)
    return F.substring(F.concat(before, after), 1, most)


def host(url: Column) -> Column:
    """Host in lower case without www.; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"://([^/?#:]*)", 1)), r"^www\.", "")


def url_key(url: Column) -> Column:
    """Scheme, www., fragment, trackers and a closing slash dropped; other query parts in order."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"^[A-Za-z]+://", ""), r"^www\.", "")
    path = F.regexp_replace(F.substring_index(bare, "?", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_|gclid|fbclid)")), "&")
    return F.lower(F.when(kept == "", path).otherwise(F.concat(path, F.lit("?"), kept)))


def under(domain: Column, suffix: Column) -> Column:
    """Whether domain is suffix or lies below it, label by label."""
    return (domain == suffix) | F.endswith(domain, F.concat(F.lit("."), suffix))


def registrable(domain: Column) -> Column:
    """The label before the public suffix; com.br and its like count as one suffix."""
    parts = F.split(domain, r"\.")
    two = F.element_at(parts, -2).isin("com", "co", "org", "net", "gov") & (F.length(F.element_at(parts, -1)) == 2)
    return F.when(F.size(parts) < 2, domain).when(two & (F.size(parts) >= 3), F.get(parts, F.size(parts) - 3)).otherwise(F.get(parts, F.size(parts) - 2))


def json_pair(body: Column, key: str) -> Column:
    """The pair "key": value as it stands in a JSON text, for quoting."""
    return F.nullif(F.regexp_extract(body, rf'"{key}"\s*:\s*("[^"]*"|[^,}}\]]+)', 0), F.lit(""))


def block_id(pos: Column, block: Column) -> Column:
    """position:digest, so that repeated blocks of a text have names of their own."""
    return F.concat_ws(":", pos.cast("string"), F.sha2(F.coalesce(block, F.lit("")), 256))


def thousands(value: Column) -> Column:
    """A whole number with points between thousands."""
    return F.translate(F.format_number(value, 0), ",", ".")


def examples(items: Column, most: int = 3) -> Column:
    """The first items, the last joined by 'and'."""
    few = F.slice(items, 1, most)
    n = F.size(few)
    return F.when(n <= 1, F.array_join(few, "")).otherwise(F.concat(F.array_join(F.slice(few, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(few, -1)))
