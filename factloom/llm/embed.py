"""Near-duplicate vectors by cosine: tiles in the order of principal axes with suffix-norm bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged
from .graph import components

#: Most vectors on each side of a tile.
SIDE = 1024
#: Dimensions that get principal axes of their own; vectors of other sizes keep their axes, which only costs time.
AXES = 8
#: Leading axes that cut vectors into leaves; the norm of the rest is one more side of a leaf's box.
LEAD = 8
#: Levels of the tree of leaves; each halves its nodes along one axis.
DEPTH = 40
_BOX = [f"p{k}" for k in range(LEAD + 1)]


def _axes(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rotation to principal axes, and the spread along each, for the commonest vector sizes, from the second moments
    of all unit vectors."""
    sizes = [r["dim"] for r in vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(AXES).collect()]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            vecs = b.column("vec").to_pylist()
            for d in set(dims.tolist()) & set(sizes):
                x = np.array([vecs[i] for i in np.flatnonzero(dims == d)], np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            i, j = np.indices(m.shape)
            yield pa.record_batch([pa.array(np.full(m.size, d), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(m.ravel())], names=["dim", "i", "j", "v"])

    total = vectors.select("dim", "vec").mapInArrow(moments, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    out = {d: np.zeros((d, d)) for d in sizes}
    for d, i, j, v in total.collect():
        out[d][i, j] = v
    found = {}
    for d, m in out.items():
        values, rotation = np.linalg.eigh((m + m.T) / 2)
        found[d] = rotation[:, ::-1].copy(), np.sqrt(np.maximum(values[::-1], 0) / max(np.trace(m), 1e-300))
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tile_links(left: np.ndarray, right: np.ndarray, axes: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) with cosine >= threshold.

    Products are summed over the leading axes first; what the rest can add is at most the product of the norms
    left, so pairs that cannot reach the threshold stop there. Those left are computed on the vectors as given.
    """
    u, v = _unit(left), _unit(right)
    a, b = (u, v) if axes is None else (u @ axes, v @ axes)
    d = a.shape[1]
    tail = lambda x: np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], 0))
    ta, tb = np.hstack([tail(a), np.zeros((len(a), 1))]), np.hstack([tail(b), np.zeros((len(b), 1))])
    slack = 1e-9
    cut = min(d, max(4, d // 4))
    s = a[:, :cut] @ b[:, :cut].T
    i, j = np.nonzero(s + ta[:, cut][:, None] * tb[:, cut][None, :] >= threshold - slack)
    s = s[i, j]
    while cut < d and len(i):
        if len(i) > 0.1 * len(a) * len(b):  # most go on: whole products are cheaper
            s = (a @ b.T)[i, j]
            cut = d
        else:
            new = min(d, 2 * cut)
            s = s + np.einsum("ij,ij->i", a[i, cut:new], b[j, cut:new])
            cut = new
        ok = s + ta[i, cut] * tb[j, cut] >= threshold - slack
        i, j, s = i[ok], j[ok], s[ok]
    ok = np.einsum("ij,ij->i", u[i], v[j]) >= threshold
    return i[ok], j[ok]


def leaf_codes(lead: np.ndarray, spread: np.ndarray, depth: int) -> np.ndarray:
    """One integer of depth bits for each row: halves along each axis in turn, cut where a normal distribution of
    that spread would be halved. Other distributions make uneven leaves, never wrong ones."""
    k = lead.shape[1]
    bits = -(-depth // k)
    share = 1 / (1 + np.exp(-1.702 * np.clip(lead / np.maximum(spread, 1e-9), -30, 30)))
    steps = np.minimum((share * 2.0**bits).astype(np.int64), 2**bits - 1)
    code = np.zeros(len(lead), np.int64)
    for t in range(depth):
        code = code << 1 | steps[:, t % k] >> (bits - 1 - t // k) & 1
    return code


def _place(axes: dict[int, tuple[np.ndarray, np.ndarray]], depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            vecs = b.column("vec").to_pylist()
            box = np.zeros((len(dims), LEAD + 1))
            codes = np.zeros(len(dims), np.int64)
            raw: list[bytes] = [b""] * len(dims)
            for d in set(dims.tolist()):
                at = np.flatnonzero(dims == d)
                x = np.array([vecs[i] for i in at], np.float64)
                rotation, spread = axes.get(d, (None, np.full(d, d**-0.5)))
                u = _unit(x) if rotation is None else _unit(x) @ rotation
                k = min(d, LEAD)
                box[at, :k] = u[:, :k]
                box[at, LEAD] = np.linalg.norm(u[:, k:], axis=1)
                codes[at] = leaf_codes(u[:, :k], spread[:k], depth)
                for i, r in zip(at, x, strict=True):
                    raw[i] = r.tobytes()
            yield pa.record_batch([*(b.column(c) for c in ("key", "label", "dim", "copies")), pa.array(raw, pa.binary()), pa.array(codes), *map(pa.array, np.ascontiguousarray(box.T))], names=["key", "label", "dim", "copies", "raw", "code", *_BOX])

    return run


def _near(a: str, b: str, radius: float):
    """Whether two boxes are no farther apart than radius."""
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"{a}.low.{c}") - F.col(f"{b}.high.{c}"), F.col(f"{b}.low.{c}") - F.col(f"{a}.high.{c}"))
    return sum((gap(c) * gap(c) for c in _BOX[1:]), gap(_BOX[0]) * gap(_BOX[0])) <= radius * radius


def _leaves(placed: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """(label, dim, code -> leaf, parts) and the pairs (a, b) of leaves that may hold a link.

    Nodes of more than SIDE vectors are cut level by level. Then pairs of nodes go down the same tree from the root
    of each label: a pair whose boxes are farther apart than radius is dropped with all that lies below it, so leaves
    are never all held against each other. A leaf of the last level that is still too large has several parts.
    """
    low, high = F.struct(*[F.min(c).alias(c) for c in _BOX]).alias("low"), F.struct(*[F.max(c).alias(c) for c in _BOX]).alias("high")
    codes = staged(placed.groupBy("label", "dim", "code").agg(F.count("*").alias("n"), low, high))
    merged = [F.struct(*[f(F.col(f"{side}.{c}")).alias(c) for c in _BOX]).alias(side) for side, f in (("low", F.min), ("high", F.max))]
    prefix = lambda depth: F.shiftright("code", DEPTH - depth).alias("prefix")
    name = lambda depth, at: F.concat_ws("/", F.lit(depth), at, "dim", "label")
    steps, homes, pairs = [], [], []
    active, depth = codes, 0
    while True:
        nodes = active.groupBy("label", "dim", prefix(depth)).agg(F.sum("n").alias("n"), *merged)
        up = name(depth - 1, F.shiftright("prefix", 1)) if depth else F.lit(None).cast("string")
        leaf = (F.col("n") <= SIDE) if depth < DEPTH else F.lit(True)
        nodes = staged(nodes.select("label", "dim", "prefix", "n", "low", "high", name(depth, F.col("prefix")).alias("node"), up.alias("up"), leaf.alias("leaf")))
        step = lambda d, from_: d.select(from_.alias("from"), F.struct("node", "leaf", "low", "high").alias("to"))
        steps.append(step(nodes.where("leaf"), F.col("node")))
        if depth:
            steps.append(step(nodes, F.col("up")))
        here = nodes.where("leaf").select("label", "dim", "prefix", F.col("node").alias("leaf"), F.ceil(F.col("n") / SIDE).cast("int").alias("parts"))
        homes.append(active.select("label", "dim", "code", prefix(depth)).join(here, ["label", "dim", "prefix"]).drop("prefix"))
        if not depth:
            roots = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), "leaf")
        inner = nodes.where("not leaf").select("label", "dim", "prefix")
        if inner.isEmpty():
            break
        active = codes.withColumn("prefix", prefix(depth)).join(inner, ["label", "dim", "prefix"], "left_semi").drop("prefix")
        depth += 1
    down = steps[0]
    for s in steps[1:]:
        down = down.unionAll(s)
    pairs.append(roots.where("leaf").select("a", "b"))
    going = roots.where("not leaf").select("a", "b")
    for _ in range(depth):
        both = going.join(down.select(F.col("from").alias("a"), F.col("to").alias("x")), "a").join(down.select(F.col("from").alias("b"), F.col("to").alias("y")), "b")
        kept = both.where(((F.col("a") != F.col("b")) | (F.col("x.node") <= F.col("y.node"))) & _near("x", "y", radius))
        kept = staged(kept.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), (F.col("x.leaf") & F.col("y.leaf")).alias("leaf")))
        pairs.append(kept.where("leaf").select("a", "b"))
        going = kept.where("not leaf").select("a", "b")
    home, pair = homes[0], pairs[0]
    for h in homes[1:]:
        home = home.unionAll(h)
    for p in pairs[1:]:
        pair = pair.unionAll(p)
    return staged(home), pair


def _compare(axes: dict[int, np.ndarray], threshold: float):
    def links(rows: list[tuple]) -> pa.RecordBatch:
        side = np.array([r[4] for r in rows])
        key = np.array([r[1] for r in rows], np.int64)
        copies = np.array([r[3] for r in rows], np.int64)
        x = np.stack([np.frombuffer(r[2], np.float64) for r in rows])
        li, ri = np.flatnonzero(side != "right"), np.flatnonzero(side != "left")
        none = pa.record_batch([pa.array([], pa.int64())] * 4, names=["key", "links", "a", "b"])
        if not len(li) or not len(ri):
            return none
        i, j = tile_links(x[li], x[ri], axes.get(x.shape[1]), threshold)
        i, j = li[i], ri[j]
        once = (side[i] != "both") | (key[i] < key[j])  # a part against itself: each pair comes up twice
        i, j = i[once], j[once]
        n = np.zeros(len(rows), np.int64)
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        root = {}

        def top(k: int) -> int:
            while (p := root.get(k, k)) != k:
                root[k] = root.get(p, p)
                k = p
            return k

        a, b = [], []
        for p, q in zip(key[i].tolist(), key[j].tolist(), strict=True):
            if (tp := top(p)) != (tq := top(q)):
                root[max(tp, tq)] = min(tp, tq)
                a.append(p)
                b.append(q)
        at = np.flatnonzero(n)
        return pa.record_batch([pa.array([*key[at].tolist(), *[None] * len(a)], pa.int64()), pa.array([*n[at].tolist(), *[None] * len(a)], pa.int64()), pa.array([None] * len(at) + a, pa.int64()), pa.array([None] * len(at) + b, pa.int64())], names=["key", "links", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now = [], None
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("tile", "key", "raw", "copies", "side")), strict=True):
                if r[0] != now and rows:
                    yield links(rows)
                    rows = []
                now = r[0]
                rows.append(r)
        if rows:
            yield links(rows)

    return run


def near_vectors(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row.

    Two vectors link when their labels are equal and not null, their sizes are equal, and their cosine in double
    precision is at least threshold. Vectors that are null, empty, zero or hold null or non-finite parts link
    with nothing. n_links counts the other rows linked directly, component_id is the smallest id reachable,
    kept says whether that is the row's own. Extra columns are not read.

    Equal vectors are one vector with a number of copies. A tree along the leading principal axes cuts each label's
    vectors into leaves; unit vectors that link are no farther apart than sqrt(2 - 2 threshold), so only leaves whose
    boxes (leading coordinates and norm of the rest) are that near meet, in tiles of bounded size, before any vector
    is copied. Tasks return counts and a spanning forest, never all pairs.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    sound = F.col("label").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    v = v.withColumn("key", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("label", F.transform("vec", lambda x: x + 0.0))))
    whole = staged(v.where("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("id").alias("least")).withColumn("dim", F.size("vec")))
    axes = _axes(whole)
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    label_type = whole.schema["label"].dataType.simpleString()
    placed = staged(whole.select("key", "label", "dim", "copies", "vec").mapInArrow(_place(axes, DEPTH), f"key bigint, label {label_type}, dim int, copies bigint, raw binary, code bigint, {', '.join(f'{c} double' for c in _BOX)}"))
    home, pairs = _leaves(placed, width)
    rows = placed.select("key", "label", "dim", "copies", "raw", "code").join(home, ["label", "dim", "code"])
    rows = staged(rows.select("key", "copies", "raw", "leaf", F.pmod(F.xxhash64("key", F.lit(1)), "parts").cast("int").alias("part")))
    size = lambda c: home.select(F.col("leaf").alias(c), F.col("parts").alias(f"{c}_parts")).distinct()
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(f"{c}_parts") - 1))
    tiles = pairs.join(size("a"), "a").join(size("b"), "b").withColumn("i", every("a")).withColumn("j", every("b")).where("a <> b or i <= j")
    tiles = staged(tiles.select(F.concat_ws("//", "i", "j", "a", "b").alias("tile"), "a", "i", "b", "j", ((F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))).alias("own")))
    one = tiles.select("tile", F.col("a").alias("leaf"), F.col("i").alias("part"), F.when(F.col("own"), "both").otherwise("left").alias("side"))
    two = tiles.where("not own").select("tile", F.col("b").alias("leaf"), F.col("j").alias("part"), F.lit("right").alias("side"))
    tiles = rows.join(one.unionAll(two), ["leaf", "part"]).select("tile", "key", "raw", "copies", "side", F.xxhash64("tile").alias("at"))
    parts = partitions(spark)
    found = staged(tiles.repartitionById(parts, F.pmod("at", F.lit(parts)).cast("int")).sortWithinPartitions("tile").mapInArrow(_compare({d: rotation for d, (rotation, _) in axes.items()}, threshold), "key bigint, links bigint, a bigint, b bigint"))
    links = found.where("key is not null").groupBy(F.col("key").alias("lkey")).agg(F.sum("links").alias("links"))
    roots = components(found.where("a is not null").select("a", "b"))
    facts = whole.select("key", "copies", "least").join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    facts = staged(facts.join(links, F.col("key") == F.col("lkey"), "left").select("key", "copies", "least", "root", F.coalesce("links", F.lit(0)).alias("links")))
    ids = facts.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    facts = staged(facts.join(ids, F.col("root") == F.col("r")).select(F.col("key").alias("k"), (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"))
    out = v.select("id", "key").join(facts, F.col("key") == F.col("k"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
