from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from factloom.functions import fuzzy, numbers, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "value"), [
    ("1.234,5", 1234.5), ("1.234", 1234.0), ("5.8", 5.8), ("12.3456", 12.3456), ("1.234.567", 1234567.0), ("R$ 499.000", 499000.0), ("R$ 499.0002", 499.0002),
    ("none", None), ("", None), (None, None), ("-5,5", -5.5), ("397 cv", 397.0), ("1234.567", 1234.567), ("1.234.56", 1234.0),
])
def test_locale_numbers(spark, raw, value):
    assert one(spark, numbers.parse_number(F.lit(raw).cast("string"))) == value


def test_units_and_flags(spark):
    n = lambda v, u, d: one(spark, numbers.convert(F.lit(float(v)), F.lit(u), d))
    assert (n(258, "hp", "power"), n(190, "kW", "power"), n(4.8, "m", "length"), n(5354, "m", "length"), n(1, "parsec", "length")) == (262, 258, 4800, 5354, None)
    assert one(spark, numbers.cylinders(F.lit("V6"))) == 6 and one(spark, numbers.cylinders(F.lit("many"))) is None
    assert [one(spark, numbers.parse_flag(F.lit(x).cast("string"))) for x in ("sim", "não", "sport", " ", None)] == [True, False, True, None, None]
    assert one(spark, numbers.tyre(F.lit("285/70 R17"))).asDict() == {"width": 285, "profile": 70, "rim": 17}
    assert one(spark, numbers.parse_price(F.lit("R$ 499.000 reais"))) == 499000


def test_dates(spark):
    d = lambda x: one(spark, numbers.iso_date(F.lit(x)))
    assert (d("5/3/2024"), d("2024-03-05T10:00"), d("Março de 2024"), d("31/02/2024"), d("soon")) == ("2024-03-05", "2024-03-05", "2024-03", None, None)
    assert one(spark, numbers.year_in_path(F.lit("https://a.b/2019/x/2024?y=2050"))) == 2024


def test_tolerance(spark):
    c = lambda a, b, t, r: one(spark, numbers.close(F.lit(a), F.lit(b), F.lit(t).cast("double"), F.lit(r).cast("double")))
    assert c(397.0, 398.0, 1.0, None) and not c(397.0, 399.0, 1.0, None) and c(100.0, 101.0, None, 0.01) and not c(1.0, 1.1, None, None)


def test_confidence(spark):
    c = lambda t, n, d: one(spark, numbers.confidence(F.lit(t), F.lit(n), F.lit(d)))
    assert (c(1, 3, False), c(2, 3, False), c(3, 9, False), c(2, 3, True)) == (1.0, 0.95, 0.6, 0.85)


def test_text(spark):
    assert one(spark, text.slug(F.lit("Potência – Máxima!"))) == "potencia_maxima" and one(spark, text.slug(F.lit("***"))) == "x"
    assert one(spark, text.url_key(F.lit("https://www.A.org/x/?utm_source=f&p=2#top"))) == "a.org/x?p=2"
    assert one(spark, text.under(F.lit("a.b"), F.lit("b"))) and not one(spark, text.under(F.lit("fakeb"), F.lit("b")))
    assert one(spark, text.negated(F.lit("It has no sunroof."), F.lit(11))) and not one(spark, text.negated(F.lit("No. It has a sunroof."), F.lit(14)))
    assert one(spark, text.line_at(F.lit("ab\ncd ef\ngh"), F.lit(6))) == "cd ef"
    assert one(spark, text.is_absent(F.lit(" N/D "))) and not one(spark, text.is_absent(F.lit("0")))
    assert one(spark, text.split_list(F.lit("ABS, airbag e  rodas;x; ABS"))) == ["abs", "airbag", "rodas"]
    assert one(spark, text.examples(F.array(*map(F.lit, "abcd")))) == "a, b and c"
    assert one(spark, text.registrable(F.lit("shop.maker.com.br"))) == "maker"
    assert one(spark, text.json_pair(F.lit('{"a": 1, "b": "x"}'), "b")) == '"b": "x"'


def test_ratio():
    assert fuzzy.ratio("abc", "abc") == 100 and fuzzy.ratio("abc", "abd") == pytest.approx(200 * 2 / 6)
    assert fuzzy.best_stretch("bcd", "abcde", 92.0) == (100.0, 1) and fuzzy.locate("zzabcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyy")[0] == "fuzzy"
    assert fuzzy.locate("torque of 900 nm at the rear axle", "a torque of 583 nm at the rear axle here")[0] == "failed"
    assert fuzzy.locate("torque of 583 nm at the rear axle", "a torqve of 583 nm at the rear axle here")[0] == "fuzzy"


def slow_stretch(short, text, least):
    """The best stretch by looking at all."""
    n = len(short)
    scores = [100.0 * fuzzy.common(short, text[i : i + n]) / n for i in range(len(text) - n + 1)] if n else []
    best = max(scores, default=0.0)
    return (best, scores.index(best)) if scores and best >= least else (0.0, -1)


def test_best_stretch_is_that_of_the_whole_scan():
    r = random.Random(2)
    for k in range(900):
        alphabet = "ab" if k % 3 == 0 else "abcdefgh "
        text = "".join(r.choices(alphabet, k=r.randrange(0, 160)))
        n = r.randrange(0, 50)
        at = r.randrange(0, max(1, len(text) - n))
        short = list(text[at : at + n])
        for _ in range(r.randrange(0, 5)):
            if short:
                i = r.randrange(len(short))
                short[i : i + r.randrange(2)] = r.choices(alphabet, k=r.randrange(2))
        for least in (92.0, 80.0, 99.0):
            assert fuzzy.best_stretch("".join(short), text, least) == slow_stretch("".join(short), text, least)


def test_a_long_text_is_searched_in_no_time():
    r = random.Random(3)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randrange(2, 9))) for _ in range(400)]
    text = " ".join(r.choices(words, k=180_000))[:1_000_000]
    quote = text[700_000:700_197]
    bad = quote[:50] + "#" + quote[51:120] + "##" + quote[121:]
    start = time.perf_counter()
    assert fuzzy.locate(bad, text)[0] == "fuzzy" and abs(fuzzy.best_stretch(bad[:197], text, 92.0)[1] - 700_000) <= 15
    assert fuzzy.locate("x".join(quote[::2]), text)[0] == "failed"
    assert time.perf_counter() - start < 6


def test_common_is_a_longest_common_subsequence():
    import random

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = 0
            for j, y in enumerate(b):
                old, row[j + 1] = row[j + 1], old + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choices("abc", k=r.randrange(12))) for _ in range(2))
        assert fuzzy.common(a, b) == slow(a, b)


def test_names_claims_and_years(spark):
    t = lambda f, x: one(spark, f(F.lit(x)))
    assert t(text.version_name, "SRX Plus AT") == "srx plus" and t(text.version_name, "Raptor 3.0 V6 Bi-turbo 4WD AT") == "raptor 3.0 v6 bi turbo"
    assert t(text.distinctive, "Ranger Ltd+ CD 4x4 Diesel") == ["ranger", "limited", "plus"] and t(text.distinctive, "HC p-up") == ["high", "country", "pick", "up"]
    claim = lambda raw, quote: tuple(one(spark, text.claim(F.lit(raw), F.lit(quote))))
    assert claim("", "A Ford declara que vai de 0 a 100 em 5,8 segundos") == ("declared", "declara")
    assert claim("6,5 s (teste Autoesporte)", "a marca declara 5,8") == ("measured", "teste") and claim(None, "0-100 km/h: 5,8 s") == (None, None)
    year = lambda x: tuple(one(spark, numbers.split_year(F.lit(x))))
    assert year("ranger 2025 xl 2026") == ("ranger 2025 xl", 2026) and year("2026") == ("", 2026) and year("f-150 12026") == ("f-150 12026", None)
    assert [t(numbers.display_date, x) for x in ("2026-09-10", "2026-09", "soon")] == ["10/09/2026", "09/2026", "soon"]


def test_every_unit_of_torque(spark):
    """A hundred of each unit in newton metres, half-even."""
    got = {u: one(spark, numbers.convert(F.lit(100.0), F.lit(u), "torque")) for u in ("Nm", "n·m", "kgfm", "kgf.m", "kgf·m", "kgm", "mkgf", "m.kgf", "lb-ft", "lbft", "lb.ft", "lbf.ft", "hp")}
    assert got == {"Nm": 100, "n·m": 100, "kgfm": 981, "kgf.m": 981, "kgf·m": 981, "kgm": 981, "mkgf": 981, "m.kgf": 981, "lb-ft": 136, "lbft": 136, "lb.ft": 136, "lbf.ft": 136, "hp": None}
