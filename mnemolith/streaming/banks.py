"""Banks: memories of bounded numbers of slots and records that are written a window at a time.

Events: (stream, layer, grp, win, seq, op, vector, value, source). All of a
window's reads come before its writes. A bank of kind

- ``records`` keeps each write as a record of its own, in slots found by a von
  Mises-Fisher posterior. A window is written in chunks: a chunk is scored
  against the slots as they were before it and committed at once. Slots and
  records have budgets of their own; a slot that is taken loses its records, a
  record that is taken leaves its slot's sum;
- ``means`` keeps one key and one value in a slot. All writes of a window that
  are familiar (cosine above ``threshold``) are merged into their slots at once,
  as means weighted by counts; the others take slots.

Places are taken in the order: free ones, then those not touched in this window
from the longest idle, then the rest; ties by number.

State is typed: a map of slots, a map of records, a list of the rows of the
window that isn't over, and totals. A window is over when a row of a later one
comes; a row of a window that is over is late and changes nothing. Only what a
window changed is written back. The batch runner streams a key's sorted rows
through one task and holds one window of them, beside the bank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mnemolith.functions.vector import sphere_log_density, vmf_densities

KEY = ["stream", "layer", "grp"]
ROW = "win long, seq long, op string, vector array<double>, value array<double>, source string"
OUT = "stream string, layer int, grp string, win long, seq long, op string, slot long, created boolean, score double, p_new double, results array<string>, value array<double>"
SLOT, RECORD = "sum array<double>, value array<double>, records long, touched long", "slot long, key array<double>, value array<double>, source string, touched long"
TOTALS = "win long, created long, assigned long, lost_records long, lost_slots long, dims long, value_dims long"


@dataclass(frozen=True)
class BankPolicy:
    """``slots`` and ``records``: budgets; ``chunk``: writes committed at once; ``route_k``: slots that are looked at; the rest as in the posterior."""

    kind: str = "records"
    slots: int = 10_000
    records: int = 10_000
    threshold: float = 0.93
    route_k: int = 4
    chunk: int = 32
    alpha: float = 0.1
    tau_new: float = 0.5
    count_exponent: float = 0.5
    prior_mass: float = 1.0
    largest_kappa: float = 1000.0


def _units(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    if not np.isfinite(n).all() or not n.all():
        raise ValueError("vector must be finite and non-zero")
    return v / n


class Bank:
    """A key's slots and records as arrays, of as many places as were ever in use."""

    def __init__(self, policy: BankPolicy, dims: int, value_dims: int):
        self.policy, self.dims, self.value_dims = policy, dims, value_dims
        # records: a sum of unit vectors; means: the mean key, with its mean value
        self.sums, self.means = np.zeros((0, dims)), np.zeros((0, value_dims))
        self.counts, self.touched = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.keys, self.values = np.zeros((0, dims)), np.zeros((0, value_dims))
        self.owner, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64)  # a record's slot (-1: a free place) and last window
        self.sources: list[str | None] = []
        self.created = self.assigned = self.lost_records = self.lost_slots = 0
        self.changed: tuple[set[int], set[int]] = (set(), set())  # slots, records

    def slot_room(self, n: int) -> None:
        if (more := min(self.policy.slots, n) - len(self.counts)) > 0:
            self.sums, self.means = np.vstack([self.sums, np.zeros((more, self.dims))]), np.vstack([self.means, np.zeros((more, self.value_dims))])
            self.counts, self.touched = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.counts, self.touched))

    def record_room(self, n: int) -> None:
        if (more := min(self.policy.records, n) - len(self.owner)) > 0:
            self.keys, self.values = np.vstack([self.keys, np.zeros((more, self.dims))]), np.vstack([self.values, np.zeros((more, self.value_dims))])
            self.owner, self.used = np.concatenate([self.owner, np.full(more, -1)]), np.concatenate([self.used, np.zeros(more, np.int64)])
            self.sources += [None] * more

    def cosines(self, units: np.ndarray) -> np.ndarray:
        """To each slot; minus infinity to free ones."""
        c = units @ self.sums.T / np.maximum(np.linalg.norm(self.sums, axis=1), 1e-12)
        c[:, self.counts == 0] = -np.inf
        return c

    def nearest(self, cos: np.ndarray) -> np.ndarray:
        """The ``route_k`` slots of each row by cosine, ties by number."""
        return np.argsort(-cos, axis=1, kind="stable")[:, : self.policy.route_k]

    def read(self, vectors: np.ndarray, k: int) -> list[tuple[int, float, list[str], np.ndarray | None]]:
        """(best slot, its cosine, sources of the ``k`` best records of the slots routed to, the first one's value)."""
        if not (self.counts > 0).any():
            return [(-1, 0.0, [], None)] * len(vectors)
        cos = self.cosines(_units(vectors))
        out = []
        for v, c, route in zip(vectors, cos, self.nearest(cos)):
            best = int(route[0])
            if self.policy.kind == "means":
                out.append((best, float(c[best]), [], self.means[best].copy()))
                continue
            held = np.flatnonzero(np.isin(self.owner, route[np.isfinite(c[route])]))
            order = held[np.argsort(-(self.keys[held] @ v), kind="stable")][:k]
            out.append((best, float(c[best]), [self.sources[i] for i in order], self.values[order[0]].copy()))
        return out

    def write(self, win: int, vectors: np.ndarray, values: np.ndarray, sources: list[str]) -> list[tuple[int, bool, float, float]]:
        """(slot, created, cosine to the nearest slot, probability of a new one) of each write of a window."""
        if self.policy.kind == "means":
            return self._merge(win, vectors, values)
        size, out = min(self.policy.chunk, self.policy.slots, self.policy.records), []
        for k in range(0, len(vectors), size):
            out += self._chunk(win, vectors[k : k + size], values[k : k + size], sources[k : k + size])
        return out

    def _posterior(self, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of a new slot, likeliest slot) of each row."""
        p, n = self.policy, len(cos)
        if not cos.shape[1]:
            return np.ones(n), np.zeros(n, np.int64)
        near = self.nearest(cos)
        c, count = np.take_along_axis(cos, near, 1), self.counts[near].astype(float)
        r = np.minimum(1 - 1e-9, np.linalg.norm(self.sums, axis=1)[near] / (count + p.prior_mass))
        kappa = np.clip(r * (self.dims - r * r) / (1 - r * r), 0, p.largest_kappa)
        able = np.isfinite(c)
        log = np.full((n, 1 + near.shape[1]), -np.inf)
        log[:, 0] = math.log(p.alpha) + sphere_log_density(self.dims)
        log[:, 1:][able] = p.count_exponent * np.log(count[able]) + vmf_densities(c[able], kappa[able], self.dims)
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        return np.where(able.any(axis=1), post[:, 0], 1.0), near[np.arange(n), post[:, 1:].argmax(axis=1)]

    @staticmethod
    def _order(held: np.ndarray, touched: np.ndarray, win: int) -> np.ndarray:
        """The order in which places are taken."""
        kind = np.where(~held, 0, np.where(touched < win, 1, 2))
        return np.lexsort((np.arange(len(held)), np.where(held, touched, 0), kind))

    def _chunk(self, win: int, vectors: np.ndarray, values: np.ndarray, sources: list[str]) -> list[tuple[int, bool, float, float]]:
        units = _units(vectors)
        cos = self.cosines(units)
        p_new, slot = self._posterior(cos)
        best = cos.max(axis=1, initial=-np.inf)
        new = (p_new > self.policy.tau_new) | ~np.isfinite(best)
        near = np.where(np.isfinite(best), best, 0.0)
        self.slot_room(len(self.counts) + int(new.sum()))
        taken = self._order(self.counts > 0, self.touched, win)[: int(new.sum())]
        slot[new] = taken
        evicted = taken[self.counts[taken] > 0]
        orphans = np.flatnonzero(np.isin(self.owner, evicted))
        self.owner[orphans] = -1
        self.sums[taken], self.counts[taken] = 0, 0
        # places of records, whose old ones leave their slots
        self.record_room(len(self.owner) + len(vectors))
        places = self._order(self.owner >= 0, self.used, win)[: len(vectors)]
        old = places[self.owner[places] >= 0]
        left = self.owner[old]
        np.subtract.at(self.sums, left, _units(self.keys[old]) if len(old) else self.keys[old])
        np.subtract.at(self.counts, left, 1)
        self.sums[self.counts == 0] = 0
        np.add.at(self.sums, slot, units)
        np.add.at(self.counts, slot, 1)
        self.touched[slot] = win
        self.keys[places], self.values[places], self.owner[places], self.used[places] = vectors, values, slot, win
        for i, s in zip(places, sources):
            self.sources[i] = s
        self.created += int(new.sum())
        self.assigned += int((~new).sum())
        self.lost_slots += len(evicted)
        self.lost_records += len(orphans) + len(old)
        self.changed[0].update(map(int, np.concatenate([taken, left, slot])))
        self.changed[1].update(map(int, np.concatenate([orphans, places])))
        return [(int(s), bool(n), float(c), float(p)) for s, n, c, p in zip(slot, new, near, p_new)]

    def _merge(self, win: int, vectors: np.ndarray, values: np.ndarray) -> list[tuple[int, bool, float, float]]:
        cos = self.cosines(_units(vectors))
        best = cos.max(axis=1, initial=-np.inf)
        slot = cos.argmax(axis=1) if cos.shape[1] else np.zeros(len(vectors), np.int64)
        known = best > self.policy.threshold
        at, which, n = np.unique(slot[known], return_inverse=True, return_counts=True)
        for mean, new in ((self.sums, vectors), (self.means, values)):
            total = mean[at] * self.counts[at, None]
            np.add.at(total, which, new[known])
            mean[at] = total / (self.counts[at] + n)[:, None]
        self.counts[at] += n
        self.touched[at] = win
        novel = np.flatnonzero(~known)
        self.slot_room(len(self.counts) + len(novel))
        while len(novel):
            order = self._order(self.counts > 0, self.touched, win)
            rows, novel = novel[: len(order)], novel[len(order) :]
            taken = order[: len(rows)]
            self.lost_slots += int((self.counts[taken] > 0).sum())
            self.sums[taken], self.means[taken], self.counts[taken], self.touched[taken] = vectors[rows], values[rows], 1, win
            slot[rows] = taken
        self.created += int((~known).sum())
        self.assigned += int(known.sum())
        self.changed[0].update(map(int, slot), map(int, at))
        return [(int(s), not k, float(c) if np.isfinite(c) else 0.0, 0.0 if k else 1.0) for s, k, c in zip(slot, known, best)]


def _window(bank: Bank, win: int, rows: pd.DataFrame, top_k: int) -> list[tuple]:
    """A window's events: reads of the bank as it is, then its writes."""
    out = []
    reads, writes = rows[rows["op"] == "read"], rows[rows["op"] == "write"]
    if len(reads):
        for seq, (slot, score, found, value) in zip(reads["seq"], bank.read(np.stack(reads["vector"].to_list()), top_k)):
            out.append((win, int(seq), "read", slot, False, score, 0.0, found, value))
    if len(writes):
        done = bank.write(win, np.stack(writes["vector"].to_list()), np.stack(writes["value"].to_list()), writes["source"].to_list())
        out += [(win, int(seq), "write", slot, new, score, p, [], None) for seq, (slot, new, score, p) in zip(writes["seq"], done)]
    return out


def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["win", "seq", "op", "slot", "created", "score", "p_new", "results", "value"])
    return out.assign(stream=key[0], layer=key[1], grp=key[2])[[*KEY, *out.columns]]


def _dims(rows: pd.DataFrame) -> tuple[int, int]:
    values = rows["value"].dropna()
    return len(rows["vector"].iloc[0]), len(values.iloc[0]) if len(values) else 0


def run_batch(events: DataFrame, policy: BankPolicy, top_k: int = 1) -> DataFrame:
    """One row for each event; all windows are over at the end."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = bank = held = None

        def close() -> Iterator[pd.DataFrame]:
            nonlocal bank
            if held is not None and len(held):
                bank = bank or Bank(policy, *_dims(held))
                yield _frame(key, _window(bank, int(held["win"].iloc[0]), held, top_k))
                bank.changed[0].clear(), bank.changed[1].clear()

        for frame in frames:
            for (*its, _), rows in frame.groupby([*KEY, "win"], sort=False):
                its = tuple(its)
                if its == key and rows["win"].iloc[0] == held["win"].iloc[0]:
                    held = pd.concat([held, rows])
                    continue
                yield from close()
                bank = bank if its == key else None
                key, held = its, rows
        yield from close()

    # a key's rows are a sequence, each window depending on those before
    ordered = events.repartition(*KEY).sortWithinPartitions(*KEY, "win", "seq")
    return ordered.select(*KEY, "win", "seq", "op", "vector", "value", "source").mapInPandas(each, OUT)


class BankProcessor(StatefulProcessor):
    """The same with typed state, between micro-batches."""

    def __init__(self, policy: BankPolicy, top_k: int = 1):
        self.policy, self.top_k = policy, top_k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "place long", SLOT)
        self.records = handle.getMapState("records", "place long", RECORD)
        self.pending = handle.getListState("pending", ROW)
        self.totals = handle.getValueState("totals", TOTALS)

    def _load(self, totals) -> Bank:
        bank = Bank(self.policy, int(totals[5]), int(totals[6]))
        _, bank.created, bank.assigned, bank.lost_records, bank.lost_slots, *_ = (int(x) for x in totals)
        slots = sorted((int(k[0]), v) for k, v in self.slots.iterator())
        bank.slot_room(1 + max((k for k, _ in slots), default=-1))
        for k, (total, value, n, touched) in slots:
            bank.sums[k], bank.counts[k], bank.touched[k] = total, n, touched
            if self.policy.kind == "means":
                bank.means[k] = value
        records = sorted((int(k[0]), v) for k, v in self.records.iterator())
        bank.record_room(1 + max((k for k, _ in records), default=-1))
        for k, (slot, vector, value, source, used) in records:
            bank.keys[k], bank.values[k], bank.owner[k], bank.used[k], bank.sources[k] = vector, value, slot, used, source
        return bank

    def _save(self, bank: Bank, win: int) -> None:
        for k in sorted(bank.changed[0]):
            if bank.counts[k]:
                value = bank.means[k].tolist() if self.policy.kind == "means" else []
                self.slots.updateValue((k,), (bank.sums[k].tolist(), value, int(bank.counts[k]), int(bank.touched[k])))
            elif self.slots.containsKey((k,)):
                self.slots.removeKey((k,))
        for k in sorted(bank.changed[1]):
            if bank.owner[k] >= 0:
                self.records.updateValue((k,), (int(bank.owner[k]), bank.keys[k].tolist(), bank.values[k].tolist(), bank.sources[k], int(bank.used[k])))
            elif self.records.containsKey((k,)):
                self.records.removeKey((k,))
        self.totals.update((win, bank.created, bank.assigned, bank.lost_records, bank.lost_slots, bank.dims, bank.value_dims))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ROW.split(", ")]
        came = pd.concat([*rows])[columns]
        totals, out = self.totals.get(), []
        over = int(totals[0]) if totals is not None else None
        if over is not None:
            late = came["win"] <= over
            out += [(int(r.win), int(r.seq), "late", -1, False, 0.0, 0.0, [], None) for r in came[late].itertuples()]
            came = came[~late]
        before = [tuple(r) for r in self.pending.get()]
        held = pd.concat([pd.DataFrame(before, columns=columns), came]) if before else came
        wins = sorted(held["win"].unique())
        if len(wins) > 1:
            bank = self._load(totals) if totals is not None else Bank(self.policy, *_dims(held))
            for win in wins[:-1]:
                out += _window(bank, int(win), held[held["win"] == win].sort_values("seq"), self.top_k)
            self._save(bank, int(wins[-2]))
        if wins:
            last = held[held["win"] == wins[-1]]
            # null stays null in the list
            self.pending.put([(int(r.win), int(r.seq), r.op, [float(x) for x in r.vector], None if r.value is None else [float(x) for x in r.value], r.source) for r in last.itertuples()])
        yield _frame(tuple(key), out)

    def close(self) -> None:
        pass


def run_stream(events: DataFrame, policy: BankPolicy, top_k: int = 1) -> DataFrame:
    """The same over a streaming DataFrame; needs the RocksDB state store. The last window stays pending until a later one begins."""
    return events.groupBy(*KEY).transformWithStateInPandas(BankProcessor(policy, top_k), OUT, "Append", "None")


def snapshot(spark: SparkSession, checkpoint: str, variable: str = "slots", batch: int | None = None) -> DataFrame:
    """The bank's slots or records as a batch of the stream left them, read from its state store: key, place, and the typed columns."""
    reader = spark.read.format("statestore").option("stateVarName", variable)
    state = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    return state.select("key.*", F.col("user_map_key.place").alias("place"), "user_map_value.*")


def counters(slots: DataFrame, records: DataFrame) -> DataFrame:
    """(stream, layer, grp, slots, records, longest_idle) of snapshots."""
    s = slots.groupBy(*KEY).agg(F.count("*").alias("slots"), (F.max("touched") - F.min("touched")).alias("longest_idle"))
    r = records.groupBy(*KEY).agg(F.count("*").alias("records"))
    return s.join(r, KEY, "left").withColumn("records", F.coalesce("records", F.lit(0)))
