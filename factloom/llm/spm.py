"""SentencePiece merge-type models: exact encoding by backtracking over longest matches, and decoding.

Pieces never hold a space mark after another character, so a text falls apart before each run of space marks
and its parts are encoded alone; each worker remembers parts it has met. Within a part an Aho-Corasick
automaton gives the longest piece at a place; the walk takes it if its pair with the piece before survives
merging again, else the next shorter piece, else it steps back and marks the place as failed. The encoding
by merges is the only sequence of pieces in which every pair of neighbours survives.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Bytes of parts, about, and pairs of pieces that a worker remembers; older ones are forgotten and worked out anew.
PARTS, PAIRS = 192_000_000, 500_000
#: Longest part that is remembered, and about the bytes that a short one takes besides its characters.
LONG, ENTRY = 200, 320


class Model:
    """The pieces of a merge-type model file with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix or not m.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with identity normalisation, dummy prefix and byte fallback")
        # Space marks are written as spaces from here on: a text's own marks count as spaces too.
        normal = {i: p.piece.replace(MARK, " ") for i, p in enumerate(m.pieces) if p.type == 1}
        self.ids = {x: i for i, x in normal.items()}
        self.score = {x: m.pieces[i].score for i, x in normal.items()}
        self.pieces = [normal.get(i, p.piece) for i, p in enumerate(m.pieces)]
        self.byte, self.byte_of = [0] * 256, {}
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.byte[int(p.piece[1:-1], 16)] = i
                self.byte_of[i] = int(p.piece[1:-1], 16)
        self.chars = {p for p in self.ids if len(p) == 1}
        if any(c not in self.chars for p in self.ids for c in p) or any(re.search("[^ ] ", p) for p in self.ids):
            raise ValueError("a piece holds a character that is no piece, or an inner space mark")
        if "\n" in self.chars:
            raise ValueError("newline is a piece")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), None) for p in self.ids}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.held = 0
        self.longest = max(map(len, self.ids))
        self.known = re.compile("[" + re.escape("".join(sorted(self.chars))) + "]+|.", re.S)

    def merge(self, text: str) -> list[str]:
        """Plain merging: the pair whose join scores best, the leftmost of ties, until none is a piece."""
        parts = list(text)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i] + parts[j], j))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, joined, j = heapq.heappop(heap)
            if not parts[i] or not parts[j] or right[i] != j or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p]

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the characters of a and b again gives just a and b."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return known

    def walk(self, text: str) -> list[str]:
        """Pieces of a run of known characters without repeated spaces."""
        shorter, fits, reach = self.shorter, self.fits, self.longest
        # The automaton takes a copy of what it is given: of a long text it gets no more than a piece can need.
        longest = self.automaton.iter_long
        out: list[str] = []
        last, at, end = "", 0, len(text)
        failed = bytearray(end // 8 + 1)  # bit i: no way on from place i
        piece = next(longest(text[:reach]))[1]
        while at < end:
            while piece is not None and (failed[at + len(piece) >> 3] >> (at + len(piece) & 7) & 1 or not fits(last, piece)):
                piece = shorter[piece]
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else ""
                piece = shorter[piece]
            else:
                out.append(piece)
                last = piece
                at += len(piece)
                if at < end:
                    piece = next(longest(text[at : at + reach]))[1]
        return out

    def part(self, text: str) -> tuple[str, str]:
        """(ids joined by commas, text decoded from them) of one part."""
        if self.chars.issuperset(text) and not text.startswith("  "):
            out = self.walk(text)
            ids, again = [self.ids[p] for p in out], "".join(out)
        else:
            ids = []
            for run in self.known.findall(text):
                if run[0] not in self.chars:
                    ids += [self.byte[b] for b in run.encode()]
                else:
                    # Pieces of spaces alone share one score, so ties count: merge them plainly.
                    ids += [self.ids[p] for p in (self.merge(run) if run.startswith("  ") else self.walk(run))]
            again = self.decode(ids)
        return ",".join(map(str, ids)), text if again == text else again

    def decode(self, ids: list[int]) -> str:
        """Text of ids, runs of byte pieces as UTF-8; the dummy prefix stays."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.pieces[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def encode(self, text: str) -> tuple[str, str]:
        """(ids joined by commas, text decoded from them)."""
        if not text:
            return "", ""
        got = []
        for p in _PARTS.findall(" " + text.replace(MARK, " ")):
            r = self.parts.get(p)
            if r is None:
                r = self.older.get(p) or self.part(p)
                if len(p) <= LONG:
                    self.held += ENTRY + len(p) + len(r[0]) + len(r[1])
                    if self.held > PARTS // 2:
                        self.older, self.parts, self.held = self.parts, {}, 0
                    self.parts[p] = r
            got.append(r)
        return ",".join([r[0] for r in got]), "".join([r[1] for r in got])[1:]


#: A run of spaces with what follows; newlines alone.
_PARTS = re.compile(r" *[^ \n]+| +|\n+")


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """(id_col, n_tokens, [ids string,] ids_sha256, decoded, decoded_sha256) of every text; null counts as empty.

    ids: decimal piece ids joined by commas, as the sentencepiece library encodes without begin and end pieces;
    decoded: the text made from them again. path: the model file, on every executor. keep_ids=False leaves the
    columns ids and decoded out. Repeated rows are encoded alike; extra columns are not read.
    """
    names = ["id", "n_tokens", *(["ids", "decoded"] if keep_ids else []), "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                got = [m.encode(t or "") for t in b.column("text").to_pylist()]
                cols = {"n_tokens": [g[0].count(",") + bool(g[0]) for g in got], "ids": [g[0] for g in got], "decoded": [g[1] for g in got], "ids_sha256": [sha(g[0]) for g in got], "decoded_sha256": [sha(g[1]) for g in got]}
                yield pa.record_batch([b.column("id"), *(pa.array(cols[n], pa.int64() if n == "n_tokens" else pa.string()) for n in names[1:])], names=names)

    schema = ", ".join(f"{n} {'bigint' if n in ('id', 'n_tokens') else 'string'}" for n in names)
    out = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
