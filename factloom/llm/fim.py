"""Fill in the middle: texts cut at ranked token offsets, parts put in another order behind marks, and put back."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens are runs of letters and any other single character.
PATTERN = "[A-Za-z]+|[^A-Za-z]"
#: Marks of prefix, suffix and middle; a text that holds one stays plain.
MARKS = ("<P>", "<S>", "<M>")
#: Code points given to the pre-tokenizer at once, about: it makes an object for each token.
PIECE = 65_536
#: Rows handed on at once.
ROWS = 256

_other = re.compile("[^A-Za-z]")


@lru_cache(maxsize=1)
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(PATTERN), behavior="isolated")


def token_ends(text: str) -> np.ndarray:
    """int64: the code point at which each token of text ends, from the offsets of the Split pre-tokenizer.

    Long texts go through it in pieces cut behind a character that is a token of its own, where no token is parted."""
    split, ends, at = _splitter().pre_tokenize_str, [], 0
    while at < len(text):
        cut = _other.search(text, at + PIECE - 1)
        to = cut.end() if cut else len(text)
        ends.append(np.fromiter((end for _, (_, end) in split(text[at:to])), np.int64) + at)
        at = to
    return np.concatenate(ends) if ends else np.empty(0, np.int64)


def draws(key: Column, n: int, seed: int = 1) -> list[Column]:
    """n numbers from 0 to 2**32 - 1 of a key (null: as an empty one): 8-digit groups of the hex SHA-256 of `seed:key`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(n)]


def cut(text: str, first: int, second: int, plain: bool, spm: bool) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of prefix and of middle, output) of one text."""
    ends = token_ends(text)
    n = len(ends)
    if plain or not text or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = sorted((first % (n + 1), second % (n + 1)))
    p, m = (int(ends[k - 1]) if k else 0 for k in (a, b))
    prefix, middle, suffix = text[:p], text[p:m], text[m:]
    pre, suf, mid = MARKS
    if spm:
        return n, "spm", p, m - p, f"{suf}{suffix}{pre}{prefix}{mid}{middle}"
    return n, "psm", p, m - p, f"{pre}{prefix}{suf}{suffix}{mid}{middle}"


def transform(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output), one row for each row of docs, without a shuffle.

    The cuts of a text of n tokens lie behind two draws from 0 to n tokens. plain_percent of the texts stay plain, as
    do empty texts (null: empty) and those that hold a mark; of the others spm_percent have the suffix first (spm),
    the rest the prefix (psm). Draws come from seed and id, so reruns and repeated rows agree; a null id draws as an
    empty one. prefix_chars and middle_chars are null where plain. Extra columns are not read.
    """
    h1, h2, h3, h4 = draws(F.col(id_col), 4, seed)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), h1.alias("h1"), h2.alias("h2"), (h3 % 100 >= 100 - plain_percent).alias("plain"), (h4 % 100 < spm_percent).alias("spm"))
    types = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                b = batch.slice(i, ROWS)
                got = [cut(*row) for row in zip(*(b.column(c).to_pylist() for c in ("text", "h1", "h2", "plain", "spm")), strict=True)]
                yield pa.record_batch([b.column("id"), *(pa.array([g[k] for g in got], t) for k, (_, t) in enumerate(types))], names=["id", *(name for name, _ in types)])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from. The parts hold no mark, so they are what lies between."""
    part = F.split(output, "|".join(MARKS), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
