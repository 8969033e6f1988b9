"""Packed inverted lists: which keys of a document occur elsewhere, told back to each document.

Map tasks pack (hash, document) postings into one binary row for each bucket of hashes; a bucket's task
sorts its hashes and keeps those found at least twice; what it keeps goes back, packed again, to a task
for each share of the documents. Postings cross the network at about nine bytes each, not as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = "bucket int, keys binary, sizes binary, counts binary, hashes binary, dfs binary, pay binary"


def pack(bucket: np.ndarray, doc: np.ndarray, keys: np.ndarray, sizes: np.ndarray, cols: list[np.ndarray], schema: pa.Schema | None = None) -> pa.RecordBatch:
    """One row for each bucket. doc: index into keys and sizes, ascending. cols: hashes, dfs, pay (empty arrays: absent)."""
    small = bucket.astype(np.uint16) if len(bucket) == 0 or int(bucket.max()) < 65536 else bucket
    order = np.argsort(small, kind="stable")
    b, d = bucket[order], doc[order]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.empty(0, np.int64)
    ends = np.r_[cuts[1:], len(b)] if len(b) else cuts
    new = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (d[1:] != d[:-1])]) if len(b) else cuts
    held = np.diff(np.r_[new, len(b)]).astype(np.int32)
    hk, hs = keys[d[new]], sizes[d[new]].astype(np.int32)
    at = np.searchsorted(new, np.r_[cuts, len(b)])
    sorted_cols = [c[order] if len(c) else c for c in cols]
    part = lambda x, i, j: x[i:j].tobytes()
    n = range(len(cuts))
    return pa.record_batch({
        "bucket": pa.array(b[cuts].astype(np.int32) if len(b) else [], pa.int32()),
        "keys": pa.array([part(hk, at[i], at[i + 1]) for i in n], pa.binary()),
        "sizes": pa.array([part(hs, at[i], at[i + 1]) for i in n], pa.binary()),
        "counts": pa.array([part(held, at[i], at[i + 1]) for i in n], pa.binary()),
        **{name: pa.array([part(c, cuts[i], ends[i]) if len(c) else b"" for i in n], pa.binary()) for name, c in zip(("hashes", "dfs", "pay"), sorted_cols, strict=True)},
    })


def note(bucket: int, keys: np.ndarray, sizes: np.ndarray, pay: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
    """A row about documents that travels with the postings and reaches the last step unchanged."""
    one = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
    none = pa.array([b""], pa.binary())
    return pa.record_batch([pa.array([bucket], pa.int32()), one(keys, np.int64), one(sizes, np.int32), none, none, one(flags, np.int32), one(pay, np.int64)], names=["bucket", "keys", "sizes", "counts", "hashes", "dfs", "pay"])


#: A hash is hot when it has more postings than 1 for COMMON documents, counted in the map slices that hold it often.
COMMON = 3000
#: Postings of a hash in a slice that are enough to name it, at least.
OFTEN = 8


def often(h: np.ndarray, docs: int) -> pa.RecordBatch:
    """The hashes that a slice of some documents holds often, with how often; h: its postings."""
    least = max(OFTEN, docs // COMMON)
    s = np.sort(h)
    # In sorted order the item `least` places on is still the same only inside such runs.
    far = s[: max(0, len(s) - least + 1)]
    value = np.unique(far[far == s[least - 1 :]]) if len(far) else far
    runs = np.searchsorted(s, value, side="right") - np.searchsorted(s, value)
    return pa.record_batch([pa.array(value.view(np.int64)), pa.array(runs.astype(np.int64))], names=["h", "c"])


def hot(counts: DataFrame, docs: int) -> dict[int, int]:
    """Hashes with more postings than 1 for COMMON documents, with their counts in the slices that named them.

    counts: h, c from often(). At most COMMON times the mean number of postings of a document come back, whatever
    the number of documents: this bounds what is sent to tasks."""
    found = counts.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") > max(OFTEN, docs // COMMON))
    return {r["h"]: r["c"] for r in found.collect()}


def apart(h: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(whether a posting's hash is hot, its count or 0). known: the hot hashes sorted, their counts."""
    if not len(known[0]):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int32)
    at = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
    is_hot = known[0][at] == h
    return is_hot, np.where(is_hot, known[1][at], 0).astype(np.int32)


def sorted_hot(found: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    h = np.array(list(found), np.int64).view(np.uint64)
    by = np.argsort(h)
    return h[by], np.minimum(np.array(list(found.values()), np.int64)[by], 2**31 - 1)


def _notes(batches: Iterator[pa.RecordBatch], out: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches without notes; notes, and postings that are counted already, are put into out."""
    for batch in batches:
        is_note = pc.or_(pc.equal(pc.binary_length(batch.column("hashes")), 0), pc.greater(pc.binary_length(batch.column("dfs")), 0))
        if pc.any(is_note).as_py():
            out.append(batch.filter(is_note))
            batch = batch.filter(pc.invert(is_note))
        yield batch


def _gather(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    kinds = {"keys": np.int64, "sizes": np.int32, "counts": np.int32, "hashes": np.uint64, "dfs": np.int32, "pay": np.int64}
    parts: dict[str, list[np.ndarray]] = {k: [] for k in kinds}
    for batch in batches:
        for k, kind in kinds.items():
            parts[k] += [np.frombuffer(x, kind) for x in batch.column(k).to_pylist()]
    out = {k: np.concatenate(v) if v else np.empty(0, kinds[k]) for k, v in parts.items()}
    return out if len(out["hashes"]) else None


def shared(chunks: DataFrame, buckets: int, finish: Callable, schema: str, distinct_keys: bool, finish_note: Callable | None = None) -> DataFrame:
    """Postings whose hash occurs at least twice, gathered for each key.

    chunks: rows of CHUNK from pack(). finish(keys, sizes, starts, counts, hashes, dfs, pay) -> RecordBatch of
    schema gets all documents of a task at once, postings of a document together. distinct_keys: a hash counts
    once for each key; else each posting counts. Rows of chunks that have dfs go to their documents uncounted:
    postings of hot hashes, which would fill one task of the counting step; such rows stand in the bucket of
    their key. finish_note(row of CHUNK as a dict) -> RecordBatch of schema.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes: list[pa.RecordBatch] = []
        g = _gather(_notes(batches, notes))
        yield from notes
        if g is None:
            return
        doc = np.repeat(np.arange(len(g["keys"]), dtype=np.int32), g["counts"])
        h = g["hashes"]
        order = np.argsort(h)
        s = h[order]
        same = s[1:] == s[:-1]
        order = order[np.r_[same, False] | np.r_[False, same]]
        if not len(order):
            return
        if distinct_keys:
            k, s = g["keys"][doc[order]], h[order]
            by = np.lexsort((k, s))
            order, k, s = order[by], k[by], s[by]
            order = order[np.r_[True, (s[1:] != s[:-1]) | (k[1:] != k[:-1])]]
        s = h[order]
        new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        runs = np.diff(np.r_[new, len(s)])
        df = np.repeat(runs, runs)
        order, df = order[df > 1], df[df > 1].astype(np.int32)
        by = np.argsort(doc[order], kind="stable")
        order, df = order[by], df[by]
        pay = g["pay"][order] if len(g["pay"]) else g["pay"]
        to = (g["keys"].view(np.uint64) % np.uint64(buckets)).astype(np.int64)[doc[order]]
        step = 4_000_000
        for i in range(0, len(order), step):
            j = slice(i, i + step)
            yield pack(to[j], doc[order[j]], g["keys"], g["sizes"], [h[order[j]], df[j], pay[j] if len(pay) else pay])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes: list[pa.RecordBatch] = []

        def postings() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                is_note = pc.equal(pc.binary_length(batch.column("hashes")), 0)
                if pc.any(is_note).as_py():
                    notes.append(batch.filter(is_note))
                    batch = batch.filter(pc.invert(is_note))
                yield batch

        g = _gather(postings())
        for batch in notes:
            for row in batch.to_pylist():
                yield finish_note(row)
        if g is None:
            return
        own = np.repeat(g["keys"], g["counts"])
        order = np.argsort(own, kind="stable")
        k = own[order]
        size = np.repeat(g["sizes"], g["counts"])[order]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        counts = np.diff(np.r_[starts, len(k)])
        yield finish(k[starts], size[starts], starts, counts, g["hashes"][order], g["dfs"][order], g["pay"][order] if len(g["pay"]) else g["pay"])

    by_hash = chunks.repartitionById(buckets, chunks.bucket).mapInArrow(count, CHUNK)
    return by_hash.repartitionById(buckets, by_hash.bucket).mapInArrow(back, schema)
