"""Fuzzy text similarity, for what exact and folded comparison leave over."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _pair(a: str, kind: T.DataType, b: str) -> T.StructType:
    return T.StructType([T.StructField(a, kind), T.StructField(b, T.DoubleType())])


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & place.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 * common / (len(a) + len(b)); two empty texts are alike."""
    return 100.0 * 2 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def best_stretch(short: str, text: str, least: float) -> tuple[float, int]:
    """(score, start) of the stretch of text, as long as short, that is most like it: 100 * common / len(short); the
    first of several, (0, -1) where none reaches least.

    A stretch that reaches it lacks at most `spare` characters of short and has as many others, so of 2 * spare + 1
    pieces of short one stands in it unbroken, at most `spare` places off: only there stretches are compared. One
    place further on, the common subsequence is at most one longer, so places that cannot do better are skipped."""
    n = len(short)
    need = -int(-least * n // 100)
    spare = n - need
    if not n or len(text) < n:
        return 0.0, -1
    if not spare:
        at = text.find(short)
        return (100.0, at) if at >= 0 else (0.0, -1)
    starts = []
    for i in range(2 * spare + 1):
        a, b = i * n // (2 * spare + 1), (i + 1) * n // (2 * spare + 1)
        at = text.find(short[a:b])
        while at >= 0:
            starts.append(at - a)
            at = text.find(short[a:b], at + 1)
    place: dict[str, int] = {}
    for i, c in enumerate(short):
        place[c] = place.get(c, 0) | 1 << i
    full, best, found, at = (1 << n) - 1, need - 1, -1, 0
    for s in sorted(starts):
        at = max(at, s - spare)
        while at <= min(s + spare, len(text) - n):
            row = full
            for c in text[at : at + n]:
                u = row & place.get(c, 0)
                row = (row + u | row - u) & full
            common = n - row.bit_count()
            if common > best:
                best, found = common, at
                if common == n:
                    return 100.0, at
            at += best + 1 - common
    return (100.0 * best / n, found) if found >= 0 else (0.0, -1)


def folded(text: str) -> str:
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).lower())
    return re.sub(r"\s+", " ", "".join(c for c in t if not unicodedata.combining(c))).strip()


#: Characters round a match in which the quote's numbers must stand, and the least score of a match.
ROUND, LEAST = 300, 92.0
_NUMBER = re.compile(r"\d[\d.,/]*")


def locate(quote: str, text: str) -> tuple[str, float]:
    """(mode, score): fuzzy where a stretch of the text is alike enough and all numbers of the quote stand round it,
    else failed; the score is 0 where no stretch is. Numbers are what values are, so a number that the source lacks
    refuses the match whatever the score. A text shorter than the quote is sought in the quote."""
    q, t = folded(quote), folded(text)
    if not q or not t:
        return "failed", 0.0
    score, at = best_stretch(q, t, LEAST) if len(q) <= len(t) else best_stretch(t, q, LEAST)
    if at < 0:
        return "failed", 0.0
    near = t[max(0, at - ROUND) : at + len(q) + ROUND] if len(q) <= len(t) else t
    lacking = [n for n in (m.rstrip(".,/") for m in _NUMBER.findall(q)) if n not in near]
    return ("failed" if lacking else "fuzzy"), round(score, 2)


@F.pandas_udf(_pair("mode", T.StringType(), "score"))
def locate_fuzzy(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([locate(q or "", t or "") for q, t in zip(quote, text, strict=True)], columns=["mode", "score"])


def coverage(query: list[str], candidate: list[str], least: float = 85.0) -> float:
    """Share of the query's tokens that a token of the candidate equals or nearly equals."""
    if not query:
        return 0.0
    return sum(any(q == c or ratio(q, c) >= least for c in candidate) for q in query) / len(query)


def set_ratio(a: str, b: str) -> float:
    """ratio of two texts' words, folded, in order and once each; two digits."""
    return round(ratio(*(" ".join(sorted(set(folded(x).split()))) for x in (a, b))), 2)


@F.pandas_udf(T.DoubleType())
def set_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([set_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """ratio of two texts, null where one is."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark lacks."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))
