"""Best-fit packing of token sequences by linear grouping.

1. Count the pieces of each length: at most ``capacity`` counts, whatever the
   corpus, so the plan is made on the driver from a bounded table.
2. Large lengths (over ``capacity * small``) go, longest first, into groups of
   equal cardinality; each is rounded up to the longest of its group.
3. The few rounded sizes make a cutting-stock problem. Its configurations come
   from column generation (revised simplex, knapsack pricing); their counts
   are rounded down and what is left is filled by the best configuration again.
4. Actual pieces replace the rounded sizes, group by group in their order. What
   they leave free is known exactly, since a run of sequences with the same
   lengths is planned as one.
5. Small lengths are put by best fit into what is free, again run by run.

The plan is a list of runs (length, first rank, last rank, first sequence,
offset). Spark ranks the pieces of each length without a shuffle of the hot
ones: a piece's rank is its task's count so far plus the counts of the tasks
before, and looks its run up in the broadcast plan.

Defined results: a null text counts as empty (one end token); only documents
longer than ``capacity`` are cut; repeated rows and ids are packed as often as
they occur; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolith.llm.common import Memo, quoted, text_or_empty
from mnemolith.session import bounded_batches, cut

#: Share of what a sequence holds above which a length is large.
SMALL = 0.125
#: Numbers of groups of large lengths that are tried; the plan with the fewest sequences is taken.
GROUPS = (12, 20, 40)


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (how many of each size) and how often each is used, covering ``demand`` exactly."""
    m = len(sizes)
    left = np.array(demand, dtype=np.int64)
    out: list[tuple[tuple[int, ...], int]] = []
    if m:
        patterns = np.diag([capacity // s for s in sizes]).astype(float)
        x = left / np.diag(patterns)
        for _ in range(rounds):
            inverse = np.linalg.inv(patterns)
            duals = inverse.sum(axis=0)
            value, best = _knapsack(sizes, duals, capacity)
            if value <= 1 + 1e-7:
                break
            step = inverse @ best
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(step > 1e-9, x / step, np.inf)
            out_of = int(np.argmin(ratio))
            theta = ratio[out_of]
            x = x - theta * step
            x[out_of] = theta
            patterns[:, out_of] = best
        for j in range(m):
            p = patterns[:, j].astype(np.int64)
            if (used := int(np.floor(x[j] + 1e-9))) > 0:
                used = min([used, *(left[p > 0] // p[p > 0]).tolist()])
                if used:
                    out.append((tuple(p.tolist()), used))
                    left -= used * p
    while left.any():  # fill what rounding down left, fullest configuration first
        p = _fill(sizes, left, capacity)
        used = int((left[p > 0] // p[p > 0]).min())
        out.append((tuple(p.tolist()), used))
        left -= used * p
    return out


def _knapsack(sizes: list[int], value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration with any number of each size; level by level, one more item each."""
    best, levels = np.zeros(capacity + 1), []
    for _ in range(capacity // min(sizes)):
        new, took = best.copy(), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            more = best[: capacity + 1 - s] + value[i]
            better = more > new[s:] + 1e-12
            new[s:][better], took[s:][better] = more[better], i
        levels.append(took)
        best = new
    counts, at = np.zeros(len(sizes)), capacity
    for took in reversed(levels):
        if took[at] >= 0:
            counts[took[at]] += 1
            at -= sizes[took[at]]
    return float(best[capacity]), counts


def _fill(sizes: list[int], left: np.ndarray, capacity: int) -> np.ndarray:
    """The fullest configuration that the remaining counts allow."""
    last = np.full(capacity + 1, -1)  # the size that made each total first
    reached = np.zeros(capacity + 1, np.bool_)
    reached[0] = True
    for i, s in enumerate(sizes):
        for _ in range(min(int(left[i]), capacity // s)):
            new = np.flatnonzero(reached[: capacity + 1 - s] & ~reached[s:]) + s
            if not len(new):
                break
            reached[new], last[new] = True, i
    total = int(np.flatnonzero(reached)[-1])
    p = np.zeros(len(sizes), np.int64)
    while total:
        p[last[total]] += 1
        total -= sizes[last[total]]
    return p


def plan(counts: dict[int, int], capacity: int, small: float = SMALL, groups: tuple[int, ...] = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset); depends on the counts alone."""
    return min((_plan(counts, capacity, small, g) for g in groups), key=lambda runs: max((r[3] + r[2] for r in runs), default=0))


def _plan(counts: dict[int, int], capacity: int, small: float, groups: int) -> list[tuple[int, int, int, int, int]]:
    runs: list[tuple[int, int, int, int, int]] = []
    large = sorted((s for s in counts if s > capacity * small), reverse=True)
    total = sum(counts[s] for s in large)
    # groups of equal cardinality; a length may be shared by two of them
    of: list[list[list[int]]] = []  # group -> [length, first rank, number]
    room = size = max(1, -(-total // groups))
    for s in large:
        rank, n = 0, counts[s]
        while n:
            if not of or room == 0:
                of.append([])
                room = size
            took = min(n, room)
            of[-1].append([s, rank, took])
            rank, n, room = rank + took, n - took, room - took
    sizes, demand, queues = [], [], []
    for g in of:  # groups that were rounded up to one length are one size
        if sizes and sizes[-1] == g[0][0]:
            demand[-1] += sum(x[2] for x in g)
            queues[-1] += g
        else:
            sizes.append(g[0][0])
            demand.append(sum(x[2] for x in g))
            queues.append(list(g))
    free: dict[int, list[tuple[int, int]]] = {}  # tokens left -> [(first sequence, number)]
    sequence = 0
    for pattern, used in configurations(sizes, demand, capacity):
        segments = [(sequence, used, 0)]  # first sequence, number, filled
        for i, times in enumerate(pattern):
            for _ in range(times):
                after = []
                for first, n, filled in segments:
                    while n:
                        x = queues[i][0]
                        took = min(n, x[2])
                        runs.append((x[0], x[1], took, first, filled))
                        after.append((first, took, filled + x[0]))
                        x[1], x[2] = x[1] + took, x[2] - took
                        if not x[2]:
                            queues[i].pop(0)
                        first, n = first + took, n - took
                segments = after
        for first, n, filled in segments:
            free.setdefault(capacity - filled, []).append((first, n))
        sequence += used
    open_ = sorted(free)
    for s in sorted((s for s in counts if s <= capacity * small), reverse=True):
        rank, n = 0, counts[s]
        while n:
            at = bisect_left(open_, s)
            if at == len(open_):  # new sequences, each to hold as many of this length as it can
                new = -(-n // (capacity // s))
                first, room_, m = sequence, capacity, new
                sequence += new
            else:
                room_ = open_[at]
                first, m = free[room_].pop()
                if not free[room_]:
                    del free[room_], open_[at]
            took = min(n, m)
            runs.append((s, rank, took, first, capacity - room_))
            rank, n = rank + took, n - took
            for r, f, k in ((room_ - s, first, took), (room_, first + took, m - took)):
                if k and r:
                    if r not in free:
                        free[r] = []
                        insort(open_, r)
                    free[r].append((f, k))
    return runs


@lru_cache(maxsize=2)  # a worker keeps what it knows from task to task
def word_ids(tokenizer_path: str, end_id: int) -> Callable[[str], np.ndarray]:
    """Token ids of a text, then the end id.

    The tokenizer splits at white space before it merges, so a text's ids are
    those of its ASCII-blank-separated parts in turn; each part is encoded by
    the library once and remembered (in bounded memory). Whether this tokenizer
    does so is tried on samples of blanks; if not, whole texts are encoded.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    known, end = Memo(), np.array([end_id], "<u4").tobytes()

    def encoded(x: str) -> list[int]:
        return tokenizer.encode(x, add_special_tokens=False).ids

    tried = [f"one{b}two,{b}{b}Three.{b}" for b in " \t\n\v\f\r"]
    splits = all(encoded(x) == [i for p in x.split() for i in encoded(p)] for x in (*tried, " ".join(tried)))

    def whole(text: str) -> np.ndarray:
        return np.array([*encoded(text), end_id], "<u4")

    def ids(text: str) -> np.ndarray:
        parts = text.encode("utf-8", "surrogatepass").split()
        known.room()
        new = [p for p in dict.fromkeys(parts) if p not in known]
        if new:
            known.learn((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(new, tokenizer.encode_batch([p.decode("utf-8", "surrogatepass") for p in new], add_special_tokens=False)))
        return np.frombuffer(b"".join([*map(known.__getitem__, parts), end]), "<u4")

    return ids if splits else whole


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32) with the task and the rank in it among pieces of the same length."""
    bounded_batches(docs.sparkSession)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of, task = word_ids(tokenizer_path, end_id), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = ids_of(text)
                for k in range(0, len(ids), capacity):
                    x = ids[k : k + capacity]
                    rows.append((doc, k // capacity, k, len(x), zlib.crc32(x.tobytes()), task, int(ranks[len(x)])))
                    ranks[len(x)] += 1
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc"), text_or_empty(text_col).alias("text")).mapInArrow(cut_up, "doc long, piece int, start long, length long, ids_crc32 long, task int, rank long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with sequence_id and offset; every sequence is filled gapless from 0."""
    spark = docs.sparkSession
    cut_pieces = cut(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    by_task = cut_pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs = sorted(plan(counts, capacity))
    starts = np.array([(r[0], r[1]) for r in runs], np.int64).reshape(-1, 2)
    keys, values = starts[:, 0] * (1 << 48) + starts[:, 1], np.array([(r[1], r[3], r[4]) for r in runs], np.int64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast((keys, values))  # runs: bounded by lengths and configurations

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = shared.value
        for b in batches:
            n = {c: b.column(c).to_numpy() for c in ("length", "rank", "before")}
            rank = n["rank"] + n["before"]
            found = values[np.searchsorted(keys, n["length"] * (1 << 48) + rank, side="right") - 1] if len(rank) else np.empty((0, 3), np.int64)
            yield pa.record_batch([*(b.column(c) for c in ("doc", "piece", "start", "length", "ids_crc32")), pa.array(found[:, 1] + rank - found[:, 0]), pa.array(np.ascontiguousarray(found[:, 2]))], names=["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = by_task.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    placed = cut_pieces.join(before, ["task", "length"]).select("doc", "piece", "start", "length", "ids_crc32", "rank", "before").mapInArrow(place, "doc long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("doc", id_col)
