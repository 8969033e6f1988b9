"""Substring deduplication: documents meet on winnowed anchors, matches are extended on words, maximal repeats kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import postings
from .common import list_column, mix, ngrams, partitions, row_key, staged, word_hashes, words

#: Words hashed at once in a map task.
SLICE = 1_500_000
#: Occurrences of a seed in a list, about.
LIST = 4096
_NONE32, _NONE64 = np.empty(0, np.int32), np.empty(0, np.int64)


def winnow(w: np.ndarray, offs: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, hash) of each anchor: every run of `window` words picks the smallest
    hash among its runs of `seed` words, the rightmost of ties, so equal windows pick equal anchors."""
    lens = np.diff(offs)
    n = len(w) - window + 1
    if n <= 0:
        return (_NONE64, _NONE64, _NONE64, np.empty(0, np.uint64))
    h = ngrams(w, seed)
    wide = window - seed + 1
    best = np.arange(len(h))
    span = 1

    def join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(h[y] <= h[x], y, x)

    while 2 * span <= wide:
        best = join(best[:-span], best[span:])
        span *= 2
    if span < wide:
        best = join(best[: n], best[wide - span : wide - span + n])
    best = best[:n]
    doc = np.repeat(np.arange(len(lens)), lens)[:n]
    starts = np.arange(n)
    ok = starts + window <= offs[doc + 1]
    starts, doc, best = starts[ok], doc[ok], best[ok]
    if not len(starts):
        return (_NONE64, _NONE64, _NONE64, np.empty(0, np.uint64))
    new = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])])
    return doc[new], starts[new] - offs[doc[new]], np.diff(np.r_[new, len(starts)]), h[best[new]]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        key = batch.column("key").to_numpy()
        vals, offs = list_column(batch.column("h"))
        i = 0
        while i < len(key):
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE, side="right")) - 1)
            yield batch, i, j, key[i:j], vals[offs[i] : offs[j]].view(np.uint64), offs[i : j + 1] - offs[i]
            i = j


def _packed(hashes, doc, key, pay, buckets: int, known: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    is_hot, count = postings.apart(hashes, known)
    none = np.zeros(len(key), np.int32)
    if (cold := ~is_hot).any():
        yield postings.pack((hashes[cold] % np.uint64(buckets)).astype(np.int64), doc[cold], key, none, [hashes[cold], _NONE32, pay[cold]])
    if is_hot.any():
        to = (key.view(np.uint64) % np.uint64(buckets)).astype(np.int64)[doc[is_hot]]
        yield postings.pack(to, doc[is_hot], key, none, [hashes[is_hot], count[is_hot], pay[is_hot]])


def _often(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, key, w, offs in _slices(batches):
            yield postings.often(winnow(w, offs, window, seed)[3], len(key))

    return run


def _seeds(window: int, seed: int, buckets: int, known: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, key, w, offs in _slices(batches):
            doc, first, count, h = winnow(w, offs, window, seed)
            if len(h):
                yield from _packed(h, doc, key, (first << 20) | count, buckets, known)

    return run


def _spans(keys, sizes, starts, counts, hashes, dfs, pay):
    part = lambda x, kind: pa.array([x[i : i + c].astype(kind).tobytes() for i, c in zip(starts, counts, strict=True)], pa.binary())
    return pa.record_batch([pa.array(keys, pa.int64()), part(pay, np.int64), part(hashes, np.uint64), part(dfs, np.int32)], names=["key", "places", "seeds", "dfs"])


#: An occurrence of a seed: the document, its first window's place, how many windows picked the seed, and their words.
_OCCURRENCE = "at int, list bigint, often boolean, key bigint, first int, count int, words string"


def _occurrences(window: int, buckets: int):
    """Seeds found elsewhere with the words of all windows that picked them. A seed of many occurrences is dealt
    in lists of about LIST by document and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for key, text, *packed in zip(*(batch.column(c).to_pylist() for c in ("key", "words", "places", "seeds", "dfs")), strict=True):
                places, seeds, dfs = (np.frombuffer(x, k) for x, k in zip(packed, (np.int64, np.uint64, np.int32), strict=True))
                first, count = places >> 20, (places & ((1 << 20) - 1)).astype(np.int64)
                lists = -(-dfs.astype(np.int64) // LIST)
                salt = mix(mix(first.astype(np.uint64)) + np.uint64(key & (2**64 - 1))) % lists.astype(np.uint64)
                ids = mix(seeds + salt).view(np.int64)
                for f, c, i, many in zip(first.tolist(), count.tolist(), ids.tolist(), (lists > 1).tolist(), strict=True):
                    row = (i % buckets, i, many, key, f, c, " ".join(text[f : f + c + window - 1]))
                    for col, x in zip(cols, row, strict=True):
                        col.append(x)
                if len(cols[0]) >= 20_000:
                    yield _rows(cols)
                    cols = [[], [], [], [], [], [], []]
            yield _rows(cols)

    return run


def _rows(cols: list[list]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.string())
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["at", "list", "often", "key", "first", "count", "words"])


class Extender:
    """Matches among the occurrences of one seed, found on words and extended both ways as far as they go."""

    def __init__(self, window: int):
        self.window, self.seen, self.held = window, {}, []

    def add(self, key: int, first: int, count: int, words: list[str]) -> list[tuple]:
        """(key, start, end, other, other_start): what this occurrence's words repeat, and what it makes repeated in
        occurrences before it."""
        w, seen, mine, out = self.window, self.seen, len(self.held), []
        mark = bytearray(count)
        self.held.append((key, first, words, mark))
        i = 0
        while i < count:
            hit = seen.setdefault(tuple(words[i : i + w]), (mine, i))
            if hit == (mine, i):
                i += 1
                continue
            other, j = hit
            okey, ofirst, there, omark = self.held[other]
            n = 1
            # To the left the walk has looked already: a window one place earlier would have met this one's.
            while i + n < count and j + n < len(omark) and words[i + n + w - 1] == there[j + n + w - 1]:
                n += 1
            out.append((key, first + i, first + i + n + w - 1, okey, ofirst + j))
            if not all(omark[j : j + n]):
                out.append((okey, ofirst + j, ofirst + j + n + w - 1, key, first + i))
                omark[j : j + n] = b"\1" * n
            mark[i : i + n] = b"\1" * n
            i += n
        return out

    def distinct(self) -> Iterator[tuple]:
        """(key, place, words) of the first of each run of equal windows."""
        for words, (i, j) in self.seen.items():
            yield self.held[i][0], self.held[i][1] + j, words


#: A match, or (list not null) the first of equal windows in one of the lists of a seed that has several.
_MATCH = "key bigint, start int, end int, other bigint, other_start int, at int, list bigint, often boolean, first int, count int, words string"


def _extended(window: int, buckets: int):
    """Rows of _OCCURRENCE sorted by list to matches, one list after the other."""

    def done(now: Extender, many: bool, out: list[tuple]) -> None:
        if many:
            for key, first, words in now.distinct():
                at = hash_words(words)
                out.append((key, None, None, None, None, at % buckets, at, False, first, 1, " ".join(words)))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = dict(key=pa.int64(), start=pa.int32(), end=pa.int32(), other=pa.int64(), other_start=pa.int32(), at=pa.int32(), list=pa.int64(), often=pa.bool_(), first=pa.int32(), count=pa.int32(), words=pa.string())
        cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, many, out = Extender(window), None, False, []
        for batch in batches:
            for i, often, key, first, count, words in zip(*(batch.column(c).to_pylist() for c in ("list", "often", "key", "first", "count", "words")), strict=True):
                if i != at:
                    done(now, many, out)
                    now, at = Extender(window), i
                many = often
                out += [(*m, None, None, None, None, None, None) for m in now.add(key, first, count, words.split(" "))]
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
        done(now, many, out)
        yield batch_of(out)

    return run


def hash_words(words: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest(), "little", signed=True)


def matches(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = 35, seed: int = 12) -> DataFrame:
    """(key, start, end, other, other_start): words start to end (exclusive) of a document, window or more of them,
    that also stand at other_start of the document other. key and other are row_key(id_col, text_col).

    Every window of the corpus that starts at two or more places, the same document included, lies whole in a match
    of each of those places; every match is compared word by word. A match ends where the windows that picked its
    seed end: the next seed's match goes on from there (see repeats). Null and short texts have none. Rows that
    repeat both id and text repeat each other's windows. Extra columns are not read.

    Seeds that occur once are dropped by packed lists of hashes; seeds that very many documents hold are found
    first and go round that step. The words around each of the others then meet in lists by seed. A list holds
    about LIST occurrences; a more frequent seed has several, and the distinct windows of each meet once more in
    lists by the window's words, a row for each list.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    docs = docs.select(row_key(F.col(id_col), text).alias("key"), text.alias("text"))
    size = docs.agg(F.sum(F.length("text")).alias("c"), F.count("*").alias("n")).first()
    parts = partitions(spark, size["c"] or 0, 32_000_000)
    hashed = docs.select("key", word_hashes(F.col("text")).alias("h"))
    known = postings.sorted_hot(postings.hot(hashed.mapInArrow(_often(window, seed), "h bigint, c bigint"), size["n"]))
    spans = postings.shared(hashed.mapInArrow(_seeds(window, seed, parts, known), postings.CHUNK), parts, _spans, "key bigint, places binary, seeds binary, dfs binary", distinct_keys=False)
    # The texts' side streams; the spans' side, a fraction of it, is built into a table of each task.
    around = docs.join(spans.hint("shuffle_hash"), "key").select("key", words(F.col("text")).alias("words"), "places", "seeds", "dfs")
    lists = around.mapInArrow(_occurrences(window, parts), _OCCURRENCE)

    def extended(rows: DataFrame) -> DataFrame:
        return staged(rows.repartitionById(parts, F.col("at")).sortWithinPartitions("list").mapInArrow(_extended(window, parts), _MATCH))

    found = extended(lists)
    out = found.where("list is null")
    again = found.where("list is not null").select("at", "list", "often", "key", "first", "count", "words")
    if not again.isEmpty():
        out = out.unionByName(extended(again))
    return out.select("key", "start", "end", "other", "other_start")


def _joined(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans of the same `by` that touch or overlap, as one."""
    order = W.partitionBy(*by).orderBy("start")
    far = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.when(F.col("start") <= far, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    return runs.groupBy(*by, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def repeats(found: DataFrame, window: int = 35) -> DataFrame:
    """(key, other, shift, start, end): maximal repeats of matches(): the matches of two documents at one distance
    (other_start - start) that overlap in all but a word are one."""
    by = ["key", "other", "shift"]
    # Windows that follow each other share all words but one; spans of windows touch, so the last window - 1 words go.
    whole = found.select("key", "other", (F.col("other_start") - F.col("start")).alias("shift"), "start", (F.col("end") - (window - 1)).alias("end"))
    return _joined(whole, by).withColumn("end", F.col("end") + (window - 1))


def repeated_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = 35, seed: int = 12) -> DataFrame:
    """(key, spans): for each document with a repeat the words that repeats cover, as array<struct<start, end>> in
    order, end exclusive, apart from each other; key is row_key(id_col, text_col)."""
    found = matches(docs, text_col, id_col, window, seed)
    covered = _joined(repeats(found, window).select("key", "start", "end"), ["key"])
    return covered.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = 35, seed: int = 12) -> DataFrame:
    """docs' id with words, kept (array<string>): its words, and those that no repeat covers.

    One row for each row of docs, in no order. Null texts have no words.
    """
    spans = staged(repeated_words(docs, text_col, id_col, window, seed))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("at"))
    out = text.join(spans.hint("shuffle_hash"), F.col("at") == F.col("key"), "left").select("id", words(F.col("text")).alias("words"), "spans")
    # What lies between one span's end and the next one's start.
    ends, n = F.transform("spans", lambda s: s["end"]), F.size("spans")
    starts = F.array_append(F.transform("spans", lambda s: s["start"]), F.size("words"))
    gaps = F.zip_with(F.array_prepend(ends, F.lit(0)), starts, lambda a, b: F.slice("words", a + 1, b - a))
    return out.select(F.col("id").alias(id_col), "words", F.when(n > 0, F.flatten(gaps)).otherwise(F.col("words")).alias("kept"))
