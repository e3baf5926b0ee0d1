"""Embedding near-dedup: PCA-ordered tiled comparison.

Vectors are turned onto the principal axes of all of them (by descending
variance), so that the leading dimensions say most. Strips of vectors near each
other in the leading dimensions are compared tile by tile: the products of the
first dimensions are accumulated, what the rest can add is at most the product
of the two suffix norms, and a pair is left as soon as its cosine cannot reach
the threshold. What reaches it is decided by the given vectors in double
precision wherever the turned ones are within ``SLACK`` of it.

Strips meet only if the boxes around them are near enough, which an equality
join on cells of the first axis finds; no table of strips is crossed. Equal
vectors are one class with a count, and a meeting of two strips returns at most
one row for each vector: how many it links with, and the smallest member of its
local group. So a large group of copies makes no pairs.

Defined results: a vector that is null, empty, zero, or holds null or non-finite
components links with nothing; vectors of different lengths don't link; rows
that share an id are vectors of their own; a null id counts as the last in
order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolith.llm.common import quoted
from mnemolith.llm.components import connected_components
from mnemolith.session import bounded_batches, cut

SLACK = 1e-9
#: Leading dimensions that a box is kept of.
BOX = 8


def usable(vector: Column) -> Column:
    """Whether a vector may link: some component isn't zero and all are finite."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, sound) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of one length, as doubles, each scaled by a power of two (which is exact) so that no square overflows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    _, power = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -power[:, None])


def _lengths(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by the length of their vectors."""
    n = np.asarray(pc.list_value_length(batch.column(at)))
    for dims in np.unique(n):
        yield int(dims), batch if (n == dims).all() else batch.filter(pa.array(n == dims))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sum of outer products of unit vectors, a row for each row of the matrix."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for dims, b in _lengths(batch, 0):
            x = _matrix(b.column(0), dims)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            held[dims] = held.get(dims, 0) + x.T @ x
    for dims, m in held.items():
        yield pa.record_batch([pa.array([dims] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=["dims", "i", "m"])


def axes(vectors: DataFrame, column: str = "vector") -> dict[int, np.ndarray]:
    """For each length of vectors, the principal axes of their directions as columns, by descending variance about the origin."""

    def added(key, rows):
        dims, i = (k.as_py() for k in key)
        m = np.sum(rows["m"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), axis=0)
        return pa.table({"dims": pa.array([dims], pa.int32()), "i": pa.array([i], pa.int32()), "m": pa.array([m], pa.list_(pa.float64()))})

    schema = "dims int, i int, m array<double>"
    rows = vectors.select(column).mapInArrow(_moments, schema).groupBy("dims", "i").applyInArrow(added, schema).collect()  # dims rows of dims numbers
    whole: dict[int, np.ndarray] = {}
    for r in rows:
        whole.setdefault(r.dims, np.zeros((r.dims, r.dims)))[r.i] = r.m
    return {dims: np.ascontiguousarray(np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]) for dims, m in whole.items()}


def _turned(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn


class Strip:
    """Vectors that a task compares: as given (scaled), turned, and the norms of what follows each step's leading dimensions."""

    def __init__(self, ids: bytes, counts: bytes, vectors: bytes, turn: np.ndarray, steps: list[int]):
        self.ids, self.counts = np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int64)
        self.given = np.frombuffer(vectors, np.float64).reshape(len(self.ids), -1)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.given, self.given))
        self.turned = _turned(self.given, turn)
        self.rest = [np.sqrt(np.einsum("ij,ij->i", self.turned[:, k:], self.turned[:, k:])) for k in steps]


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def linked(x: Strip, i: slice, y: Strip, j: slice, steps: list[int], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in x, in y) of the pairs of a tile whose cosine is ``least`` or more."""
    a, b, from_ = x.turned[i], y.turned[j], 0
    part: np.ndarray | None = None
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    for k, to in enumerate(steps):
        if pairs is None:  # whole tiles, as long as many pairs are left
            add = a[:, from_:to] @ b[:, from_:to].T
            part = add if part is None else part + add
            able = part + np.multiply.outer(x.rest[k][i], y.rest[k][j]) >= least - SLACK
            n = int(np.count_nonzero(able))
            if not n:
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if n * 16 < able.size or k == len(steps) - 1:
                pairs = np.nonzero(able)
                part = part[pairs]
        else:
            p, q = pairs
            part = part + np.einsum("ij,ij->i", a[p, from_:to], b[q, from_:to])
            able = part + x.rest[k][i][p] * y.rest[k][j][q] >= least - SLACK
            pairs, part = (p[able], q[able]), part[able]
        from_ = to
    p, q = pairs[0] + i.start, pairs[1] + j.start
    unsure = np.flatnonzero(part < least + SLACK)
    sure = np.ones(len(p), np.bool_)
    sure[unsure] = np.einsum("ij,ij->i", x.given[p[unsure]], y.given[q[unsure]]) / (x.norms[p[unsure]] * y.norms[q[unsure]]) >= least
    return p[sure], q[sure]


def compare(x: Strip, y: Strip | None, steps: list[int], least: float, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, number of vectors it links with, smallest class of its local group) of all classes of the strips that link; y None: within x."""
    same, other = y is None, x if y is None else y
    n = len(x.ids) + (0 if same else len(other.ids))
    shift = 0 if same else len(x.ids)
    links, ends = np.zeros(n, np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for s in range(0, len(x.ids), tile):
        for t in range(s if same else 0, len(other.ids), tile):
            p, q = linked(x, slice(s, min(s + tile, len(x.ids))), other, slice(t, min(t + tile, len(other.ids))), steps, least)
            if same and s == t:
                p, q = p[p < q], q[p < q]
            if len(p):
                q = q + shift
                links += np.bincount(p, other.counts[q - shift], n).astype(np.int64) + np.bincount(q, x.counts[p], n).astype(np.int64)
                ends.append((p, q))
                if sum(len(e[0]) for e in ends) > 8 * n + (1 << 18):  # a forest of them says the same
                    root = _smallest(n, np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]))
                    ends = [(np.arange(n), root)]
    root = _smallest(n, np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]))
    ids = x.ids if same else np.concatenate([x.ids, other.ids])
    # the smallest class id of each local group, whatever the order of positions
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, root, ids)
    out = np.flatnonzero(links)
    return ids[out], links[out], low[root[out]]


def near_vectors(vectors: DataFrame, least: float = 0.95, rows: int = 4096, tile: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row. ``rows``: vectors of a strip at most; ``tile``: of a tile."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    plain = vectors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("vector"))
    plain = plain.withColumn("usable", usable(F.col("vector")))
    able = cut(plain.where("usable").select("id", "vector", F.unhex(F.sha2(F.col("vector").cast("string").cast("binary"), 256)).alias("sha")))
    # equal vectors: one class; the sums meet in the map tasks, so a hot vector sends a row from each
    classes = able.groupBy("sha").agg(F.first("vector").alias("vector"), F.count("*").alias("n"), F.min("id").alias("id"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    turns = axes(classes)
    shared = spark.sparkContext.broadcast(turns)  # a matrix of dims x dims for each length of vectors

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, b in _lengths(batch, 2):
                lead = _turned(_matrix(b.column(2), dims), shared.value[dims])[:, :2]
                yield pa.record_batch([*b.columns, pa.array([dims] * len(b), pa.int32()), pa.array(lead[:, 0]), pa.array(lead[:, -1])], names=["cls", "n", "vector", "dims", "c1", "c2"])

    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK  # how far unit vectors of such a cosine can be apart
    led = classes.select("cls", "n", "vector").mapInArrow(leading, "cls long, n long, vector array<double>, dims int, c1 double, c2 double")
    led = led.withColumn("slice", F.floor(F.col("c1") / (reach / 2)).cast("int"))
    count = classes.count()
    # as many tasks as strips, however many ranges a session makes, so that strips are full
    strips_ = max(1, -(-count // rows))
    ordered = led.repartitionByRange(strips_, "dims", "slice", "c2", "cls").coalesce(strips_).sortWithinPartitions("dims", "slice", "c2", "cls")

    def stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def strip() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            dims = t["dims"][0].as_py()
            x = _matrix(t["vector"].combine_chunks(), dims)
            lead = _turned(x, shared.value[dims])[:, :BOX]
            columns = {"strip": pa.array([t["cls"][0].as_py()]), "dims": pa.array([dims], pa.int32()), "low": pa.array([lead.min(axis=0)], pa.list_(pa.float64())), "high": pa.array([lead.max(axis=0)], pa.list_(pa.float64()))}
            columns |= {"ids": pa.array([t["cls"].to_numpy().astype(np.int64).tobytes()], pa.binary()), "counts": pa.array([t["n"].to_numpy().astype(np.int64).tobytes()], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary())}
            yield from pa.table(columns).to_batches()

        size = 0
        for batch in batches:
            for dims, b in _lengths(batch, 2):
                if held and held[0].column("dims")[0].as_py() != dims:
                    yield from strip()
                    held, size = [], 0
                while len(b):
                    take = b.slice(0, rows - size)
                    held.append(take)
                    size, b = size + len(take), b.slice(len(take))
                    if size == rows:
                        yield from strip()
                        held, size = [], 0
        if held:
            yield from strip()

    strips = cut(ordered.select("cls", "n", "vector", "dims").mapInArrow(stripped, "strip long, dims int, low array<double>, high array<double>, ids binary, counts binary, vectors binary"))
    # strips whose boxes are near enough: by cells of the first axis, then by the boxes' distance
    box = strips.select("strip", "dims", "low", "high")
    cell = lambda x: F.floor(x / F.lit(reach)).cast("int")
    a = box.select("dims", F.col("strip").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"), F.explode(F.sequence(cell(F.col("low")[0] - reach), cell(F.col("high")[0] + reach))).alias("cell"))
    b = box.select("dims", F.col("strip").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"), F.explode(F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0]))).alias("cell"))
    first = F.greatest(cell(F.col("la")[0] - reach), cell(F.col("lb")[0]))  # of the cells that two strips share
    gaps = F.transform(F.arrays_zip("la", "ha", "lb", "hb"), lambda z: F.greatest(F.lit(0.0), z["lb"] - z["ha"], z["la"] - z["hb"]))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    meets = a.join(b, ["dims", "cell"]).where((F.col("a") <= F.col("b")) & (F.col("cell") == first)).where(apart <= reach * reach).select("dims", "a", "b")
    blobs = strips.select("strip", "ids", "counts", "vectors")
    one = lambda end: blobs.select(F.col("strip").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("ids", "counts", "vectors")])
    paired = cut(meets).join(one("a"), "a").join(one("b"), "b").select("dims", F.col("a") == F.col("b"), "ids_a", "counts_a", "vectors_a", "ids_b", "counts_b", "vectors_b")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                dims, same, *raw = (c[k].as_py() for c in batch.columns)
                steps = sorted({min(dims, max(8, dims // 4)), min(dims, max(8, dims // 2)), dims})
                turn = shared.value[dims]
                found = compare(Strip(*raw[:3], turn, steps), None if same else Strip(*raw[3:], turn, steps), steps, least, tile)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in found], names=["cls", "links", "root"])

    found = cut(paired.mapInArrow(compared, "cls long, links long, root long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("cls", "root"), "cls", "root").select(F.col("node").alias("cls"), "root")
    whole = classes.select("sha", "cls", "n", "id").join(links, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least_id = whole.groupBy("root").agg(F.min("id").alias("component_id"))
    done = cut(whole.join(least_id, "root").select("sha", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    shared.destroy()  # all that used it is written
    # both sides are written, so that Spark can split a hot vector's rows
    out = able.select("id", "sha").join(done, "sha").select("id", "n_links", "component_id")
    alone = plain.where(~F.col("usable")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
