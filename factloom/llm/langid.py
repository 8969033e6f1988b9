"""Language identification: blended-spectrum presence kernels, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of text turned into n-grams at once.
SLICE = 4_000_000
#: Rows of the presence matrix at once.
ROWS = 64
CODES = 256**3


class Kernel:
    """Presence of all byte runs of one to three letters, blended; landmarks are texts' own sets.

    The feature space is what the texts of the fit hold: k(x, y) = |x and y| / sqrt(|x| |y|) over the runs that
    occur in some of them. Runs of three bytes or fewer are numbered exactly, so nothing is hashed.
    """

    def __init__(self, texts: list[bytes]):
        seen = np.zeros((CODES + 2 * 65536), bool)
        for t in texts:
            for codes in _codes(fold(np.frombuffer(t, np.uint8))):
                seen[codes] = True
        self.vocabulary = np.flatnonzero(seen).astype(np.int32)
        self._number()

    def _number(self) -> None:
        self.number = np.zeros(CODES + 2 * 65536, np.int32)
        self.number[self.vocabulary] = np.arange(1, len(self.vocabulary) + 1)

    def __getstate__(self):
        return {"vocabulary": self.vocabulary}

    def __setstate__(self, state):
        self.vocabulary = state["vocabulary"]
        self._number()

    def presence(self, text: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Rows of 0 and 1, one for each text of a buffer of UTF-8 bytes."""
        out = np.zeros((len(offs) - 1, len(self.vocabulary) + 1), np.float32)
        folded = fold(text)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        for size, codes in zip((1, 2, 3), _codes(folded), strict=True):
            d = doc[: len(codes)]
            inside = d == doc[size - 1 : size - 1 + len(codes)]
            out[d[inside], self.number[codes[inside]]] = 1
        return out[:, 1:]


#: Bytes that count: letters of any script; ASCII others become a space. A-Z are lower-cased.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def fold(text: np.ndarray) -> np.ndarray:
    return _FOLD[text]


def _codes(b: np.ndarray) -> list[np.ndarray]:
    x = b.astype(np.int32)
    two = x[:-1] << 8 | x[1:]
    return [x + CODES, two + (CODES + 65536), two[:-1] << 8 | x[2:]]


def shares(labels: list[str], n: int) -> list[int]:
    """Places of n labels, or one of each where that is more: the first of each label, the second of each, and so on."""
    met: dict[str, int] = {}
    turn = []
    for label in labels:
        met[label] = met.get(label, 0) + 1
        turn.append(met[label])
    return sorted(sorted(range(len(labels)), key=lambda i: (turn[i], i))[: max(n, len(met))])


class Classifier:
    """One-versus-rest kernel ridge regression on Nyström features; scores are products with one matrix."""

    def __init__(self, texts: list[bytes], labels: list[str], landmarks: int, ridge: float):
        self.labels = sorted(set(labels))
        self.kernel = Kernel(texts)
        marks = self._unit(self._all([texts[i] for i in shares(labels, landmarks)]))
        # A few texts at a time, so the driver never holds all of them over the whole feature space.
        knm = np.vstack([self._unit(self._all(texts[i : i + 256])) @ marks.T for i in range(0, len(texts), 256)])
        kmm = marks @ marks.T
        values, vectors = np.linalg.eigh(kmm.astype(np.float64))
        good = values > 1e-6 * values[-1]
        half = vectors[:, good] / np.sqrt(values[good])
        z = np.hstack([knm @ half, np.ones((len(texts), 1))])
        y = np.where(np.array(labels)[:, None] == np.array(self.labels)[None, :], 1.0, -1.0)
        w = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ y)
        # (presence @ marks.T) @ half @ w, with the products of the fixed matrices taken first.
        self.weights = (marks.T @ (half @ w[:-1])).astype(np.float32)
        self.bias = w[-1]

    def _all(self, texts: list[bytes]) -> np.ndarray:
        return np.vstack([self.kernel.presence(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts])

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    def scores(self, text: np.ndarray, offs: np.ndarray) -> np.ndarray:
        x = self.kernel.presence(text, offs)
        return (x @ self.weights) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1)) + self.bias


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text is a multiple of 5. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", per_lang: int = 300, max_bytes: int = 4_000_000, landmarks: int = 256, ridge: float = 1.0) -> Classifier | None:
    """Fit on at most per_lang rows of each language of together max_bytes bytes, or one row (both bound what the
    driver holds; languages are taken to be few). Rows that are not held out come in the order of a hash, those of
    more than a hundredth of max_bytes last, so a language of long texts alone is learned from them. Rows equal in
    id and text count once. Null texts, texts without a letter and rows of null id or language teach nothing. None
    without a labelled row.

    Hashes and sizes alone settle which rows these are; their texts are read whole in a second pass, so what tasks
    send doesn't grow with their number."""
    lang, text = F.col(lang_col), F.col(text_col)
    train = docs.where(lang.isNotNull() & text.isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & text.rlike(r"\p{L}"))
    train = train.select(lang.alias("lang"), F.xxhash64(F.col(id_col), text, F.lit(11)).alias("h"), F.octet_length(text).alias("bytes"), text.alias("text"))
    order = [F.col("bytes") > max_bytes // 100, "h"]
    first = train.select("lang", "h", "bytes").withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("n") <= per_lang)
    sums = W.partitionBy("lang").orderBy("n")
    first = first.withColumn("sum", F.sum("bytes").over(sums)).where((F.col("sum") <= max_bytes) | (F.col("n") == 1))
    chosen = first.select(F.col("lang").alias("l"), F.col("h").alias("k")).distinct()
    # At most per_lang short rows a language.
    found = train.join(F.broadcast(chosen), (F.col("lang") == F.col("l")) & (F.col("h") == F.col("k")))
    rows = sorted(tuple(r) for r in found.dropDuplicates(["lang", "h"]).select("h", "lang", "text").collect())
    return Classifier([r[2].encode() for r in rows], [r[1] for r in rows], landmarks, ridge) if rows else None


def identify(docs: DataFrame, model: Classifier | None, text_col: str = "text", id_col: str = "doc_id", passing: list[str] | None = None) -> DataFrame:
    """(id_col, lang_pred, score, *passing) for every row of docs; whole texts are scored.

    A text that is null or has no letter (and any text without a model) is `und` with score 0. score is the
    share of the best language in a softmax of the regressions' outputs, 0 to 1. Other columns are not read.
    """
    passing = passing or []
    cols = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_ok"), *passing)
    fields = [f for f in cols.schema if f.name not in ("_id", "_t", "_ok")]
    schema = ", ".join(["_id bigint", "lang_pred string", "score double", *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Large offsets, as one batch may hold more than 2 GB of text.
            text = batch.column("_t").fill_null("").cast(pa.large_binary())
            ok = batch.column("_ok").to_numpy(zero_copy_only=False)
            offs = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            lang = np.full(len(text), "und", object)
            score = np.zeros(len(text))
            i = 0
            while model is not None and i < len(text):
                j = min(i + ROWS, max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE, side="right")) - 1))
                s = model.scores(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) * 4
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                use = ok[i:j]
                lang[i:j][use] = np.array(model.labels, object)[best[use]]
                score[i:j][use] = p.max(axis=1)[use]
                i = j
            yield pa.record_batch([batch.column("_id"), pa.array(lang, pa.string()), pa.array(score), *(batch.column(f.name) for f in fields)], names=["_id", "lang_pred", "score", *(f.name for f in fields)])

    return cols.withColumn("_id", F.col("_id").cast("bigint")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)
