"""Items of two lists matched one to one by likeness."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fuzzy import folded, ratio

#: Likeness of two items' sets of words from which they may be the same item.
LEAST_ITEM = 72.0


def token_set_ratio(a: str, b: str) -> float:
    """Likeness of two texts as sets of words: the words in common against these with either's own; 100 where one
    has all words of the other."""
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    first, second = (f"{both} {' '.join(sorted(own))}".strip() for own in (x - y, y - x))
    return max(ratio(first, second), *((ratio(both, first), ratio(both, second)) if both else ()), 0.0)


def alike(a: str, b: str, least: float = LEAST_ITEM) -> bool:
    """Whether two folded items may be one: one holds the other, or their words are alike. A blank one is none."""
    return bool(a and b) and (a in b or b in a or token_set_ratio(a, b) >= least)


def assign(edges: list[list[int]], n_right: int) -> list[int]:
    """For each left item the right one it gets, or -1, as many as can be: while a left item has a path to a free
    right one over items that can make way, all on it move up."""
    owner, got = [-1] * n_right, [-1] * len(edges)
    for first in range(len(edges)):
        came: dict[int, int] = {}
        queue = deque([first])
        free = -1
        while queue and free < 0:
            i = queue.popleft()
            for j in edges[i]:
                if j not in came:
                    came[j] = i
                    if owner[j] < 0:
                        free = j
                        break
                    queue.append(owner[j])
        while free >= 0:
            i = came[free]
            owner[free] = i
            free, got[i] = got[i], free
    return got


def match(expected: list[str], got: list[str], least: float = LEAST_ITEM) -> tuple[list[tuple[str, str]], list[str], list[str]]:
    """(pairs, missing, extra) of two lists, items folded and once each. Equal items are paired first: no likeness
    takes an item from its equal."""
    a, b = (list(dict.fromkeys(x for x in map(folded, items) if x)) for items in (expected, got))
    same = set(a) & set(b)
    left, right = [x for x in a if x not in same], [x for x in b if x not in same]
    where = assign([[j for j, y in enumerate(right) if alike(x, y, least)] for x in left], len(right))
    pairs = [(x, x) for x in a if x in same] + [(x, right[j]) for x, j in zip(left, where, strict=True) if j >= 0]
    return pairs, [x for x, j in zip(left, where, strict=True) if j < 0], [y for j, y in enumerate(right) if j not in set(where)]


_MATCH = T.StructType([T.StructField("equal", T.BooleanType()), T.StructField("pairs", T.ArrayType(T.StringType())), T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("extra", T.ArrayType(T.StringType()))])


@F.pandas_udf(_MATCH)
def match_lists(expected: pd.Series, got: pd.Series, least: pd.Series) -> pd.DataFrame:
    """struct(equal, pairs 'expected = got', missing, extra); a null list counts as empty."""
    rows = []
    for e, g, n in zip(expected, got, least, strict=True):
        pairs, missing, extra = match([x for x in (e if e is not None else []) if x], [x for x in (g if g is not None else []) if x], float(n))
        rows.append((not missing and not extra, [f"{x} = {y}" for x, y in pairs], missing, extra))
    return pd.DataFrame(rows, columns=["equal", "pairs", "missing", "extra"])
