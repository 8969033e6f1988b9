"""Whether a quote can carry a value at all: reasons to refuse it, items it affirms, dates it binds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import MONTHS, iso_date
from ..functions.text import fold

#: Fields, what a quote says that refuses them, what takes the refusal back, and the reason.
REFUSALS = [
    (["suggested_price"], r"fixar veiculo", None, "listing_price"),
    (["tyre_use"], r"\d{3}[/ ]\d{2}\s*r\d{2}", r"\b(?:at|mt|ht|all.?terrain|mud.?terrain|highway.?terrain)\b", "size_is_no_use"),
    (["rim_inches"], r"sync|carplay|multimidia|touchscreen", r"aro|rodas|pneu", "screen_is_no_rim"),
    (["width_mm"], r"com espelhos", None, "width_with_mirrors"),
    (["towing_kg"], r"sem freio", None, "unbraked_towing"),
    (["power"], r"combinada", None, "combined_power"),
    (["displacement"], r"oleo|lubrificante|arrefecimento", None, "fluid_capacity"),
    (["rim_inches", "rim_material", "tyre", "tyre_use", "assistance", "camera_360", "paddles"], r"acessorio|opcional|vendido separadamente", None, "optional_item"),
    (["warranty_months"], r"bateria|pintura|corrosao|pecas", None, "component_warranty"),
    (["suggested_price"], r"entrada|parcelas|taxista|pcd|cnpj", None, "conditional_offer"),
]
#: What negates an item before it, and behind it, in the same clause.
NOT_BEFORE = r"(?:^| )(?:nao (?:tem|possui|oferece|inclui)|sem) (?:.{0,160})$"
NOT_BEHIND = r"^ *(?:nao (?:disponivel|possui|tem|equipado)|ausente)(?: |$)"
#: What binds a date to a price, and what makes a date another thing's.
BINDS = {
    "price_date": r"\b(?:data (?:do )?preco|preco data|(?:precos?|ofertas?) (?:sugeridos? )?(?:vigentes?|valid[oa]s?|atualizad[oa]s?|em\b|de referencia)|vigencia (?:d[oa]s? )?(?:precos?|ofertas?))\b",
    "reference_month": r"\b(?:mes (?:de )?referencia|referencia(?: fipe)?|tabela fipe)\b",
}
OTHER_DATES = r"\b(?:copyright|captur|colet|acess|consultad|publica|published|postad|artigo|noticia|ultima atualizacao)|©"
_LINK = r"https?://[^\s)]+"


#: What the address of a shop of accessories has, whose pages offer options.
OPTIONS_URL = "acessorios."


def refusal(field: Column, quote: Column, rules: list[tuple] = REFUSALS, url: Column | None = None) -> Column:
    """Why a quote cannot carry a field's value: the first rule that fits, else null. On pages of accessories every item
    is an option, whatever the quote says."""
    t, out = fold(quote), None
    shop = F.contains(F.lower(F.coalesce(url, F.lit(""))), F.lit(OPTIONS_URL)) if url is not None else F.lit(False)
    for fields, says, unless, reason in rules:
        hit = field.isin(fields) & (t.rlike(says) | shop if reason == "optional_item" else t.rlike(says))
        hit = hit & ~t.rlike(unless) if unless else hit
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return out


def items_affirmed(items: Column, quote: Column, names: dict[str, list[str]] | None = None) -> Column:
    """Whether a quote says of every item, by its own or another of its names, that it is there: in some clause the
    name stands in whole words, not negated before or behind it. No item: true; a null quote affirms nothing."""
    plain = lambda x: F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(x), "[^a-z0-9]+", " ")), F.lit(" "))
    clauses = F.transform(F.split(F.coalesce(quote, F.lit("")), r"[.](?![A-Za-z0-9])|[;\n]|(?i)\b(?:mas|por[eé]m|contudo)\b"), plain)
    other = F.create_map(*[c for k, v in (names or {"": []}).items() for c in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])

    def says(clause: Column, name: Column) -> Column:
        pieces = F.split(clause, F.concat(F.lit("\\Q"), F.rtrim(name), F.lit("\\E(?= )")))
        place = lambda i: ~F.concat(F.array_join(F.slice(pieces, F.lit(1), i), " x"), F.lit(" ")).rlike(NOT_BEFORE) & ~F.get(pieces, i).rlike(NOT_BEHIND)
        return (F.size(pieces) > 1) & F.exists(F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(F.array(F.lit(0))), place)

    known = lambda item: F.concat(F.array(item), F.coalesce(other[fold(item)], F.array().cast("array<string>")))
    return F.coalesce(F.forall(items, lambda item: F.exists(known(item), lambda n: F.exists(clauses, lambda c: says(c, plain(n))))), F.lit(True))


def date_bound(field: str, value: Column, quote: Column) -> Column:
    """Whether a quote binds this date (price_date: a day, reference_month: a month) to its field: the date stands
    behind the field's words, in a clause that speaks of nothing else. Days that no calendar has bind nothing."""
    months = "|".join(MONTHS)
    date = rf"(?<![\w/-])(?:[0-9]{{4}}-[0-9]{{2}}(?:-[0-9]{{2}})?|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{1,2}}/[0-9]{{4}}|(?:[0-9]{{1,2}}(?:º|°)? (?:de )?)?(?:{months}) (?:de )?[0-9]{{4}})(?![\w/-])"
    clauses = F.split(F.regexp_replace(F.coalesce(quote, F.lit("")), _LINK, ""), r"[;!?]|[.,](?![0-9])")
    behind = lambda c: F.when(~fold(c).rlike(OTHER_DATES), F.regexp_extract(fold(c), rf"(?s){BINDS[field]}(.*)$", 1)).otherwise("")
    # fold() takes the mark off março, so its plain spelling is read as well.
    pattern = date.replace("março", "mar[cç]o")
    dates = F.flatten(F.transform(clauses, lambda c: F.regexp_extract_all(behind(c), F.lit(pattern), F.lit(0))))

    def whole(x: Column) -> Column:
        x = F.regexp_replace(x, "marco", "março")
        short = F.regexp_extract(x, r"^([0-9]{1,2})/([0-9]{4})$", 2)
        month = F.when(short != "", F.concat_ws("-", short, F.lpad(F.regexp_extract(x, r"^([0-9]{1,2})/", 1), 2, "0"))).when(x.rlike(r"^[0-9]{4}-[0-9]{2}$"), x)
        month = F.when(F.substring(month, 6, 2).between("01", "12"), month)
        day, rest = F.regexp_extract(x, r"^([0-9]{1,2})(?:º|°)? (?:de )?[a-zç]", 1), F.regexp_replace(x, r"^[0-9]{1,2}(?:º|°)? (?:de )?", "")
        named = F.when(day != "", F.date_format(F.try_to_date(F.concat_ws("-", iso_date(rest), F.lpad(day, 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")).otherwise(iso_date(x))
        return F.coalesce(month, named)

    form, cut = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", 10) if field == "price_date" else (r"^[0-9]{4}-[0-9]{2}$", 7)
    return value.rlike(form) & F.coalesce(F.exists(dates, lambda x: F.coalesce(F.substring(whole(x), 1, cut) == value, F.lit(False))), F.lit(False))
