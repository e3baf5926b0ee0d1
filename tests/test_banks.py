"""Banks against plain lists; budgets; the stream and its snapshots against the batch."""

import math
import random

import numpy as np
import pytest

from mnemolith.functions.vector import sphere_log_density, vmf_density
from mnemolith.streaming import banks
from mnemolith.streaming.banks import Bank, BankPolicy

EVENTS = "stream string, layer int, grp string, win long, seq long, op string, vector array<double>, value array<double>, source string"


def made(windows=14, most=9, dims=6, seed=4, keys=2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for w in range(windows):
        for s in range(keys):
            for i in range(rng.randrange(1, most)):
                v = [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]
                rows.append((f"s{s}", 0, "g", w, i, "read" if rng.random() < 0.3 else "write", v, [float(w), float(i)], f"{s}-{w}-{i}"))
    rng.shuffle(rows)
    return rows


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def taken(places, win):
    """The order of places: (held, last window) each."""
    return sorted(range(len(places)), key=lambda i: (0, 0, i) if not places[i][0] else ((1 if places[i][1] < win else 2), places[i][1], i))


class Plain:
    """Slots and records as lists of all places; every sum is made anew from the records it stands for."""

    def __init__(self, p):
        self.p, self.records, self.touched = p, [None] * p.records, [-1] * p.slots
        self.used = [-1] * p.records
        self.kept = {}  # means: slot -> (key, value, count)

    def members(self, s):
        return [r for r in self.records if r and r["slot"] == s]

    def centre(self, s):
        if self.p.kind == "means":
            return self.kept[s][0] if s in self.kept else None
        m = self.members(s)
        return [sum(c) for c in zip(*(unit(r["key"]) for r in m))] if m else None

    def route(self, v):
        cos = {s: dot(unit(c), unit(v)) for s in range(self.p.slots) if (c := self.centre(s))}
        return cos, sorted(cos, key=lambda s: (-round(cos[s], 12), s))[: self.p.route_k]

    def read(self, v):
        cos, near = self.route(v)
        if not near:
            return -1, [], None
        if self.p.kind == "means":
            return near[0], [], self.kept[near[0]][1]
        r = max((r for r in self.records if r and r["slot"] in near), key=lambda r: dot(r["key"], v))
        return near[0], [r["source"]], r["value"]

    def write(self, win, rows):
        out = []
        if self.p.kind == "means":
            found = []
            for v, value, _ in rows:
                cos, near = self.route(v)
                found.append(near[0] if near and cos[near[0]] > self.p.threshold else None)
            for s in set(found) - {None}:
                mine = [r for r, f in zip(rows, found) if f == s]
                key, value, n = self.kept[s]
                self.kept[s] = tuple([(a * n + sum(c)) / (n + len(mine)) for a, c in zip(old, zip(*(m[k] for m in mine)))] for k, old in ((0, key), (1, value))) + (n + len(mine),)
                self.touched[s] = win
            novel = [i for i, f in enumerate(found) if f is None]
            while novel:
                order = taken([(s in self.kept, self.touched[s]) for s in range(self.p.slots)], win)
                for i, s in zip(novel, order):
                    self.kept[s], self.touched[s], found[i] = (rows[i][0], rows[i][1], 1), win, s
                novel = novel[len(order) :]
            return found
        size = min(self.p.chunk, self.p.slots, self.p.records)
        for k in range(0, len(rows), size):
            chunk = rows[k : k + size]
            plan = []
            for v, *_ in chunk:
                cos, near = self.route(v)
                logs = [math.log(self.p.alpha) + sphere_log_density(len(v))]
                for s in near:
                    n, c = len(self.members(s)), self.centre(s)
                    r = min(1 - 1e-9, math.sqrt(dot(c, c)) / (n + self.p.prior_mass))
                    logs.append(self.p.count_exponent * math.log(n) + vmf_density(cos[s], min(self.p.largest_kappa, r * (len(v) - r * r) / (1 - r * r)), len(v)))
                top = max(logs)
                new = not near or math.exp(logs[0] - top) / sum(math.exp(x - top) for x in logs) > self.p.tau_new
                plan.append(None if new else near[logs[1:].index(max(logs[1:]))])
            order = iter(taken([(bool(self.members(s)), self.touched[s]) for s in range(self.p.slots)], win))
            fresh = [s if s is not None else next(order) for s in plan]
            for s, old in zip(fresh, plan):
                if old is None:
                    self.records = [None if r and r["slot"] == s else r for r in self.records]
            places = taken([(bool(r), self.used[i]) for i, r in enumerate(self.records)], win)
            for i, s, (v, value, source) in zip(places, fresh, chunk):
                self.records[i], self.used[i], self.touched[s] = {"slot": s, "key": v, "value": value, "source": source}, win, win
            out += fresh
        return out


def plain(rows, p):
    out = {}
    for stream in {r[0] for r in rows}:
        bank = Plain(p)
        for win in sorted({r[3] for r in rows}):
            mine = sorted((r for r in rows if r[0] == stream and r[3] == win), key=lambda r: r[4])
            for r in mine:
                if r[5] == "read":
                    slot, found, value = bank.read(r[6])
                    out[stream, win, r[4]] = (slot, found, value and [round(x, 9) for x in value])
            writes = [r for r in mine if r[5] == "write"]
            for r, s in zip(writes, bank.write(win, [(r[6], r[7], r[8]) for r in writes])):
                out[stream, win, r[4]] = (s, [], None)
    return out


def shape(rows):
    return {(r.stream, r.win, r.seq): (r.slot, list(r.results), None if r.value is None else [round(x, 9) for x in r.value]) for r in rows}


POLICIES = [
    BankPolicy(slots=40, records=60), BankPolicy(slots=40, records=60, chunk=1, alpha=1e-3), BankPolicy(slots=3, records=7, chunk=4), BankPolicy(slots=6, records=4, chunk=3, tau_new=0.9),
    BankPolicy("means", slots=40, threshold=0.8), BankPolicy("means", slots=3, threshold=0.9), BankPolicy("means", slots=2, threshold=0.99),
]


@pytest.mark.parametrize("policy", POLICIES)
def test_against_plain_lists(spark, policy):
    rows = made()
    assert shape(banks.run_batch(spark.createDataFrame(rows, EVENTS).repartition(3), policy).collect()) == plain(rows, policy)


def test_chunks_of_one_equal_single_writes():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 8))
    p = BankPolicy(slots=6, records=12, chunk=1)
    whole, single = Bank(p, 8, 1), Bank(p, 8, 1)
    assert whole.write(0, v[:4], v[:4, :1], ["a"] * 4) == [single.write(0, v[k : k + 1], v[k : k + 1, :1], ["a"])[0] for k in range(4)]
    np.testing.assert_array_equal(whole.sums, single.sums)
    np.testing.assert_array_equal(whole.owner, single.owner)


@pytest.mark.parametrize("chunk", [1, 7, 32])
def test_budgets_hold_after_many_writes(chunk):
    rng = np.random.default_rng(1)
    p = BankPolicy(slots=50, records=200, chunk=chunk)
    bank, writes = Bank(p, 16, 2), 100_000 if chunk == 32 else 5_000
    centres = rng.normal(size=(400, 16))
    for w in range(writes // 100):
        v = centres[rng.integers(0, 400, 100)] + rng.normal(size=(100, 16)) * 0.2
        bank.write(w, v, v[:, :2], [str(w)] * 100)
        assert len(bank.counts) <= 50 and len(bank.owner) <= 200 == max(200, len(bank.sources))
        assert bank.counts.sum() == (bank.owner >= 0).sum() == bank.created + bank.assigned - bank.lost_records
        bank.changed[0].clear(), bank.changed[1].clear()
    assert bank.created + bank.assigned == writes
    # sums are those of the records that are there
    for s in np.flatnonzero(bank.counts):
        k = bank.keys[bank.owner == s]
        np.testing.assert_allclose(bank.sums[s], (k / np.linalg.norm(k, axis=1, keepdims=True)).sum(axis=0), atol=1e-6)


def test_grouped_means():
    """Two writes near one slot in a window make the exact weighted mean of three."""
    bank = Bank(BankPolicy("means", slots=3, threshold=0.93), 32, 1)
    e = np.eye(32)
    bank.write(0, e[:1], np.array([[3.0]]), ["a"])
    bank.write(1, np.array([0.99 * e[0] + 0.01 * e[1], 0.98 * e[0] + 0.02 * e[1]]), np.array([[6.0], [9.0]]), ["b", "c"])
    assert bank.counts.tolist() == [3] and bank.means[0, 0] == 6.0
    assert abs(bank.sums[0, 0] - (1 + 0.99 + 0.98) / 3) < 1e-12
    bank.write(2, e[5:8], np.ones((3, 1)), ["d"] * 3)  # two free places, then the oldest
    assert (bank.counts > 0).sum() == 3 and bank.lost_slots == 1


@pytest.mark.parametrize("policy", [POLICIES[2], POLICIES[5]])
def test_stream_and_snapshot_equal_batch(spark, tmp_path, policy):
    rows = made(windows=10) + [(f"s{s}", 0, "g", 99, 0, "read", [1.0] * 6, None, "end") for s in range(2)]
    rows.sort(key=lambda r: (r[3], r[4]))
    late = ("s0", 0, "g", 0, 77, "write", [1.0] * 6, [0.0, 0.0], "late")
    cuts = [0, 23, 24, 51, len(rows)]  # windows lie across micro-batches
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = rows[a:b] + ([late] if k == 3 else [])
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = banks.run_stream(events, policy).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert [(r.stream, r.win, r.seq) for r in got if r.op == "late"] == [("s0", 0, 77)]
        wanted = plain(rows, policy)
        assert shape(r for r in got if r.op != "late") == {k: v for k, v in wanted.items() if k[1] != 99}
        # the state store, read as a table
        slots = {(r.stream, r.place): r for r in banks.snapshot(spark, str(tmp_path / "state")).collect()}
        records = banks.snapshot(spark, str(tmp_path / "state"), "records")
        for s in range(2):
            bank = Plain(policy)
            for win in range(10):
                writes = sorted((r for r in rows if r[0] == f"s{s}" and r[3] == win and r[5] == "write"), key=lambda r: r[4])
                bank.write(win, [(r[6], r[7], r[8]) for r in writes])
            for k in range(policy.slots):
                centre = bank.centre(k)
                assert (centre is None) == ((f"s{s}", k) not in slots)
                if centre:
                    np.testing.assert_allclose(slots[f"s{s}", k]["sum"], centre, atol=1e-9)
            assert sorted(r.source for r in records.where(f"stream = 's{s}'").collect()) == sorted(r["source"] for r in bank.records if r)
        c = banks.counters(banks.snapshot(spark, str(tmp_path / "state")), records).collect()
        assert all(r.slots <= policy.slots and r.records <= policy.records for r in c) and len(c) == 2
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
