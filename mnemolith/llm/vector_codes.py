"""Vector code compression: a codebook for each part of the vectors, by k-means in integers with Exponion search.

Components become integers floor(scale x); a vector is cut into equal parts,
each with a codebook of its own. Every round assigns each part to its nearest
entry and moves each entry to the floor of its parts' mean. The search starts at
the part's previous entry, whose distance is u: a nearer entry lies within 2u of
that entry (by the triangle inequality, in squares: at most 4u^2), so only the
head of the entry's neighbour list, sorted by distance, is scanned. All
distances are exact integers; of equal distances the lower index wins.

Rows are written once for each round with their codes of the round before; the
codebooks (256 entries a part) are all that the driver and every task hold, and
the sums and counts of a task's parts are merged by Spark in pieces.

Defined results: rows whose vector is null or empty or holds null or non-finite
components are dropped; so are vectors of another length than that of the
smallest id that stays. A length that the parts don't divide, or an integer
beyond +-2^26 (whose squared distances could leave a long), is an error. Of rows
that share an id each has its own code, and in the first codebooks they count by
id, then vector; a null id comes last; fewer than 256 rows make fewer entries; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.llm.common import quoted
from mnemolith.session import bounded_batches, cut

#: Integers up to here are multiplied in doubles without rounding: 64 dimensions a part of products up to 2^44, times four.
IN_DOUBLES, LARGEST = 1 << 22, 1 << 26
#: The sums of a task's parts are merged in so many pieces for each codebook.
PIECES = 16
#: Parts searched at once.
CHUNK = 512


class Book:
    """A codebook with each entry's other entries sorted by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # int64, one row each
        self.small = not entries.size or int(np.abs(entries).max()) <= IN_DOUBLES
        gap = entries[:, None, :] - entries[None, :, :]
        apart = np.einsum("ijk,ijk->ij", gap, gap)
        self.order = np.argsort(apart, axis=1, kind="stable")  # an entry is the first of its own list, or equal to it
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of ``x``, the search beginning at its entry ``start``."""
        at = x - self.entries[start]
        u = np.einsum("ij,ij->i", at, at)
        code, best = start.astype(np.int64), u.copy()
        for entry in np.unique(start):
            mine = np.flatnonzero(start == entry)
            # all entries within twice the distance, the farthest such included
            reach = np.searchsorted(self.apart[entry], 4 * u[mine], side="right")
            order = np.argsort(reach, kind="stable")
            mine, reach = mine[order], reach[order]
            for k in range(0, len(mine), CHUNK):
                rows, near = mine[k : k + CHUNK], self.order[entry, : reach[min(k + CHUNK, len(mine)) - 1]]
                if len(near) > 1:
                    near = np.sort(near)  # so that the first least is the lowest index
                    d = self._distances(x[rows], self.entries[near])
                    first = d.argmin(axis=1)
                    code[rows], best[rows] = near[first], d[np.arange(len(rows)), first]
        return code, best

    def _distances(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        kind = np.float64 if self.small and x.shape[1] <= 64 and (not x.size or int(np.abs(x).max()) <= IN_DOUBLES) else np.int64
        x, c = x.astype(kind), c.astype(kind)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def _ints(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def integers(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, x): usable rows with integer components."""
    v = F.col(quoted(vector_col)).cast("array<double>")
    sound = F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf")))
    fits = lambda a: F.when(F.abs(a) <= LARGEST, a.cast("int")).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST} once it is an integer")).cast("int"))
    x = F.transform(v, lambda a: fits(F.floor(F.lit(float(scale)) * a).cast("double")))
    return vectors.where(F.coalesce((F.size(v) > 0) & sound, F.lit(False))).select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).alias("label"), x.alias("x"))


def _assigned(books: list[np.ndarray], first: bool):
    """Codes of a batch: from the first entry, or from the codes of the round before."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Book(b) for b in books]
        for b in batches:
            if not len(b):
                continue
            x = np.split(_ints(b.column("x")), len(held), axis=1)
            before = np.zeros((len(b), len(held)), np.int64) if first else _ints(b.column("code"))
            found = [book.nearest(p, before[:, k]) for k, (book, p) in enumerate(zip(held, x))]
            code = np.stack([f[0] for f in found], axis=1).astype(np.int32)
            error = np.sum([f[1] for f in found], axis=0)
            yield pa.record_batch([b.column("id"), b.column("label"), b.column("x"), pa.FixedSizeListArray.from_arrays(pa.array(code.ravel()), len(held)).cast(pa.list_(pa.int32())), pa.array(error)], names=["id", "label", "x", "code", "error"])

    return assign


def _sums(parts: int, entries: list[int], width: int):
    """Counts and sums of the parts of each entry: the task's, then those of all tasks, as blobs of so many entries."""
    step = [-(-n // PIECES) for n in entries]

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((n, 1 + width), np.int64) for n in entries]
        for b in batches:
            x, code = _ints(b.column("x")), _ints(b.column("code"))
            for k in range(parts):
                held[k][:, 0] += np.bincount(code[:, k], minlength=entries[k])
                order = np.argsort(code[:, k], kind="stable")
                at, starts = np.unique(code[order, k], return_index=True)
                if len(at):
                    held[k][at, 1:] += np.add.reduceat(x[order, k * width : (k + 1) * width], starts, axis=0)
        rows = [(k, p, held[k][p * step[k] : (p + 1) * step[k]].tobytes()) for k in range(parts) for p in range(-(-entries[k] // step[k]))]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], names=["part", "piece", "sums"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for k, p, raw in zip(*(c.to_pylist() for c in b.columns)):
                s = np.frombuffer(raw, np.int64)
                held[k, p] = held[k, p] + s if (k, p) in held else s
        if held:
            yield pa.record_batch([pa.array([k for k, _ in held], pa.int32()), pa.array([p for _, p in held], pa.int32()), pa.array([s.tobytes() for s in held.values()], pa.binary())], names=["part", "piece", "sums"])

    return mine, merged, step


def moved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks with each used entry at the floor of its parts' mean."""
    width, schema = books[0].shape[1], "part int, piece int, sums binary"
    mine, merged, step = _sums(len(books), [len(b) for b in books], width)
    sums = rows.select("x", "code").mapInArrow(mine, schema).repartition("part", "piece").mapInArrow(merged, schema)
    out = [b.copy() for b in books]
    for r in sums.collect():  # as many numbers as the codebooks hold
        s = np.frombuffer(r.sums, np.int64).reshape(-1, 1 + width)
        used = np.flatnonzero(s[:, 0])
        out[r.part][r.piece * step[r.part] + used] = s[used, 1:] // s[used, :1]
    return out


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code array, error long) of every row that stays, the codebooks)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = cut(integers(vectors, scale, id_col, vector_col, label_col))
    head = rows.orderBy(F.col("id").isNull(), "id", "x").select("x").limit(1).collect()
    dims = len(head[0].x) if head else parts
    if dims % parts or not dims:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("x") == dims)
    seeds = rows.orderBy(F.col("id").isNull(), "id", "x").select("x").limit(entries).collect()
    start = np.array([r.x for r in seeds], np.int64).reshape(-1, dims)
    books = np.split(start, parts, axis=1)
    kind = f"id {dict(rows.dtypes)['id']}, label {dict(rows.dtypes)['label']}, x array<int>, code array<int>, error long"
    for turn in range(rounds + 1):
        rows = cut(rows.mapInArrow(_assigned(books, turn == 0), kind))
        if turn < rounds and len(start):
            books = moved(rows, books)
    return rows.drop("x"), books


def code_report(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", **given) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every row that stays."""
    rows, books = encode_vectors(vectors, id_col=id_col, label_col=label_col, **given)
    parts = len(books)
    sums = cut(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    code = F.concat(*[F.lower(F.lpad(F.hex(F.col("code")[k]), 2, "0")) for k in range(parts)])
    both = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return both.select(F.col("id").alias(id_col), code.alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
