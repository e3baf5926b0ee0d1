"""Upkeep of a memory against plain dictionaries, round by round, and the stream against the batch."""

import math
import random

import pytest

from mnemolith.operators import upkeep
from mnemolith.operators.upkeep import Memory, Upkeep

WRITE = "stream string, record_id long, vector array<double>, value array<double>, write_time double, gain double, supersedes long, size long"


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def length(v):
    return math.sqrt(dot(v, v))


def unit(v):
    return [x / length(v) for x in v]


def total(pairs):
    return [sum(w * x for w, x in zip([p[0] for p in pairs], c)) for c in zip(*(p[1] for p in pairs))]


class Plain:
    """One stream: records by id, nodes by id."""

    def __init__(self, u, records, nodes):
        self.u, self.cost = u, 0.0
        self.records = {r["record_id"]: dict(r) for r in records}
        self.nodes = {n["node"]: dict(n) for n in nodes}

    def weight(self, r, now):
        if r["superseded_by"] is not None:
            return 0.0
        age, idle = max(0, now - r["write_time"]), max(0, now - (r["last_used"] if r["last_used"] is not None else r["write_time"]))
        return math.exp(-self.u.age_decay * age) * math.exp(-self.u.idle_decay * idle) * (1e-6 + max(0, r["gain"])) ** self.u.gain_power

    def members(self, slot):
        return sorted((r for r in self.records.values() if r["slot"] == slot), key=lambda r: r["record_id"])

    def children(self, node):
        return [n for n, x in self.nodes.items() if x["parent"] == node]

    def size(self):
        d = max((len(r["vector"]) for r in self.records.values()), default=0)
        return sum(r["size"] + 8 for r in self.records.values()) + sum(192 + 8 * d if x["leaf"] else 160 + 8 * (d + len(self.children(n))) for n, x in self.nodes.items())

    def statistics(self, slot, now):
        m = self.members(slot)
        w = [self.weight(r, now) for r in m]
        res, mass = total([(a, r["vector"]) for a, r in zip(w, m)]), sum(w)
        some = [(a, unit(r["value"])) for a, r in zip(w, m) if a > 0 and length(r["value"]) > 0]
        conflict = max(0, min(1, 1 - length(total(some)) / sum(a for a, _ in some))) if some else 0.0
        return m, w, res, mass, mass - length(res), conflict

    def prune(self):
        while gone := [n for n, x in self.nodes.items() if (not self.members(n) if x["leaf"] else not self.children(n))]:
            for n in gone:
                del self.nodes[n]

    def halves(self, m, w):
        if len(m) < 2:
            return None
        centre = total([(1, r["vector"]) for r in m])
        far = lambda c, rows: min(rows, key=lambda r: (round(dot(r["vector"], c), 12), r["record_id"]))
        a = far(centre, m)
        b = far(a["vector"], [r for r in m if r is not a])
        c, sides = [a["vector"], b["vector"]], None
        for _ in range(50):
            new = [1 if round(dot(r["vector"], c[1]), 12) > round(dot(r["vector"], c[0]), 12) else 0 for r in m]
            if new == sides:
                break
            sides = new
            if len(set(sides)) < 2:
                return None
            for k in (0, 1):
                t = total([(x, r["vector"]) for x, r, s in zip(w, m, sides) if s == k])
                c[k] = unit(t) if length(t) > 1e-15 else next(r["vector"] for r, s in zip(m, sides) if s == k)
        return sides

    def split(self, now):
        out, top = [], max(self.nodes, default=0)
        plans = []
        for slot in sorted(n for n, x in self.nodes.items() if x["leaf"]):
            node = self.nodes[slot]
            if node["cooldown_until"] > now:
                continue
            m, w, res, mass, j1, conflict = self.statistics(slot, now)
            sides = self.halves(m, w)
            if sides is None:
                node["pending"] = 0
                continue
            parts = [[(x, r) for x, r, s in zip(w, m, sides) if s == k] for k in (0, 1)]
            sums = [total([(x, r["vector"]) for x, r in p]) for p in parts]
            masses = [sum(x for x, _ in p) for p in parts]
            j2 = sum(a - length(s) for a, s in zip(masses, sums))
            gain = (j1 - j2) / j1 if j1 > 1e-15 else 0.0
            u = self.u
            due = (length(res) / mass if mass > 0 else 0) < u.split_least_resultant or gain > u.split_least_gain or node["regret"] > u.split_most_regret or conflict > u.split_most_conflict
            valid = due and min(masses) >= u.least_child_mass and j1 - j2 > u.slot_penalty
            node["pending"] = node["pending"] + 1 if valid else 0
            if not valid or node["pending"] < u.patience:
                continue
            before = sum(1 - dot(r["vector"], unit(res)) for r in m)
            after = sum(1 - dot(r["vector"], unit(s)) for p, s in zip(parts, sums) for _, r in p)
            if after / len(m) < before / len(m) - 1e-12:
                plans.append((slot, parts))
        for k, (slot, parts) in enumerate(plans):
            new = top + 1 + 2 * k
            self.nodes[slot] |= {"leaf": False, "pending": 0, "cooldown_until": now + self.u.split_cooldown}
            for side in (0, 1):
                self.nodes[new + side] = {"node": new + side, "parent": slot, "leaf": True, "pending": 0, "cooldown_until": now + self.u.split_cooldown, "regret": 0.0}
                for _, r in parts[side]:
                    r["slot"] = new + side
            out.append(("split", slot, new))
        return out

    def merge(self, now):
        s, u = {}, self.u
        for n, x in self.nodes.items():
            if x["leaf"] and x["cooldown_until"] <= now and x["regret"] <= u.merge_most_regret:
                m, w, res, mass, j, conflict = self.statistics(n, now)
                if conflict <= u.merge_most_conflict and length(res) > 1e-15:
                    s[n] = res
        pairs = []
        for a in s:
            for b in s:
                both = [x + y for x, y in zip(s[a], s[b])]
                if a < b and self.nodes[a]["parent"] == self.nodes[b]["parent"] and length(both) > 1e-15:
                    sim = round(dot(unit(s[a]), unit(s[b])), 12)
                    crossed = any(self.records[r["superseded_by"]]["slot"] == o for x, o in ((a, b), (b, a)) for r in self.members(x) if r["superseded_by"] in self.records)
                    if sim >= u.merge_least_similarity and length(s[a]) + length(s[b]) - length(both) < u.slot_penalty and not crossed:
                        pairs.append((-sim, a, b))
        used, out, top = set(), [], max(self.nodes, default=0)
        young = []
        for _, a, b in sorted(pairs):
            if not used & {a, b}:
                used |= {a, b}
                new = top + 1 + len(out)
                self.nodes[new] = {"node": new, "parent": self.nodes[a]["parent"], "leaf": True, "pending": 0, "cooldown_until": now + u.merge_cooldown, "regret": 0.0}
                for r in self.members(a) + self.members(b):
                    r["slot"] = new
                del self.nodes[a], self.nodes[b]
                out.append(("merge", a, b))
                young.append(new)
        for new in young:
            p = self.nodes[new]["parent"]
            if p is not None and self.children(p) == [new]:
                mine = self.members(new)
                self.nodes[p] = self.nodes.pop(new) | {"node": p, "parent": self.nodes[p]["parent"]}
                for r in mine:
                    r["slot"] = p
        return out

    def maintain(self, now):
        u, out = self.u, []
        for r in list(self.records.values()):
            if now - r["write_time"] >= u.protection and self.weight(r, now) < u.least_weight:
                out.append(("expired", r["record_id"], None))
                del self.records[r["record_id"]]
        if u.budget is not None and self.records:
            self.cost = max(0.0, self.cost + u.budget_step * (self.size() - u.budget))
            worth = {}
            for r in self.records.values():
                if now - r["write_time"] >= u.protection:
                    idle, age = max(0, now - (r["last_used"] if r["last_used"] is not None else r["write_time"])), now - r["write_time"]
                    worth[r["record_id"]] = (r["reads"] + 1) / (age + r["reads"] + 1) * math.exp(-u.idle_decay * idle) * max(0, r["gain"]) / max(1, r["size"])
            for i in sorted(worth, key=lambda i: (worth[i], i)):
                if self.size() <= u.budget and worth[i] > self.cost:
                    break
                out.append(("evicted", i, None))
                del self.records[i]
        self.prune()
        out += self.split(now)
        out += self.merge(now)
        self.prune()
        return out


def made(seed, streams="ab", n=40):
    rng = random.Random(seed)
    records, nodes = [], []
    for s in streams:
        centres = [unit([rng.gauss(0, 1) for _ in range(5)]) for _ in range(6)]
        tree = [(1, None, False), (2, 1, True), (3, 1, True), (4, None, True), (5, None, False), (6, 5, True), (7, 5, True), (8, None, True)]
        nodes += [dict(stream=s, node=i, parent=p, leaf=leaf, pending=rng.randrange(2), cooldown_until=float(rng.choice([-5, 0, 12])), regret=rng.random()) for i, p, leaf in tree]
        for i in range(n):
            c = rng.randrange(6)
            v = unit([x + rng.gauss(0, 0.25) for x in centres[c]])
            slot = [2, 3, 4, 6, 7, 7][c] if rng.random() < 0.8 else rng.choice([2, 3, 4, 6, 7])
            value = [0.0, 0.0] if rng.random() < 0.1 else [rng.gauss(0, 1), rng.gauss(0, 1)]
            records.append(dict(stream=s, record_id=i, slot=slot, vector=v, value=value, write_time=float(rng.randrange(9)), last_used=float(rng.randrange(5, 10)) if rng.random() < 0.4 else None, reads=rng.randrange(4), gain=rng.random(), superseded_by=i + 1 if rng.random() < 0.1 and i + 1 < n else None, size=rng.randrange(100, 300)))
    return records, nodes


RULES = [
    Upkeep(split_least_gain=0.1, least_child_mass=1.0, slot_penalty=1.5, patience=2, split_cooldown=2.0, merge_least_similarity=0.4, merge_cooldown=1.0),
    Upkeep(age_decay=0.1, idle_decay=0.02, gain_power=0.5, protection=4.0, least_weight=0.15, budget=8_000, budget_step=1e-9, split_most_conflict=0.5, least_child_mass=0.2, merge_least_similarity=0.2, slot_penalty=0.5, merge_most_regret=0.95),
    Upkeep(protection=2.0, budget=8_000, budget_step=1e-7, split_least_resultant=0.9, least_child_mass=0.5, merge_least_similarity=0.0, slot_penalty=0.4, merge_most_conflict=0.95),
]


@pytest.mark.parametrize("u", RULES)
def test_rounds_against_plain_dictionaries(spark, u):
    records, nodes = made(RULES.index(u) + 1)
    m = Memory(spark.createDataFrame(records, upkeep.RECORD), spark.createDataFrame(nodes, upkeep.NODE), spark.createDataFrame([], upkeep.COST))
    p = {s: Plain(u, [r for r in records if r["stream"] == s], [n for n in nodes if n["stream"] == s]) for s in "ab"}
    seen = set()
    for now in (10.0, 13.0, 16.0):
        m, report = upkeep.maintain(m, now, u)
        wanted = sorted((s, *x) for s in p for x in p[s].maintain(now))
        assert sorted(((r.stream, r.what, r.id, r.other) for r in report.collect()), key=str) == sorted(wanted, key=str)
        seen |= {x[1] for x in wanted}
        assert {(r.stream, r.record_id): r.slot for r in m.records.collect()} == {(s, i): r["slot"] for s in p for i, r in p[s].records.items()}
        got = {(n.stream, n.node): (n.parent, n.leaf, n.pending, n.cooldown_until) for n in m.nodes.collect()}
        assert got == {(s, i): (n["parent"], n["leaf"], n["pending"], n["cooldown_until"]) for s in p for i, n in p[s].nodes.items()}
        for r in m.costs.collect():
            assert abs(r.cost - p[r.stream].cost) < 1e-12
    assert seen >= [{"split", "merge"}, {"expired", "evicted", "split", "merge"}, {"evicted", "split"}][RULES.index(u)]
    for r in upkeep.snapshot(m, 16.0, u).collect():
        rows, _, res, mass, j, conflict = p[r.stream].statistics(r.slot, 16.0)
        assert (r.records, round(r.mass, 9), round(r.scatter, 9), round(r.conflict, 9)) == (len(rows), round(mass, 9), round(j, 9), round(conflict, 9))
    assert {r.stream: (r.records, r.leaves, r.parents) for r in upkeep.counts(m).collect()} == {s: (len(x.records), sum(n["leaf"] for n in x.nodes.values()), sum(not n["leaf"] for n in x.nodes.values())) for s, x in p.items()}


def test_expiry_spares_the_young_and_budget_the_useful(spark):
    """A superseded record goes once it isn't protected; of two records over the budget the one that was read stays."""
    base = dict(stream="s", vector=[1.0, 0.0], value=[1.0], last_used=None, gain=1.0, superseded_by=None, size=500)
    rows = [dict(base, record_id=1, slot=1, write_time=0.0, reads=0, superseded_by=2), dict(base, record_id=2, slot=1, write_time=9.0, reads=0), dict(base, record_id=3, slot=1, write_time=0.0, reads=9), dict(base, record_id=4, slot=1, write_time=0.0, reads=0)]
    nodes = [dict(stream="s", node=1, parent=None, leaf=True, pending=0, cooldown_until=0.0, regret=0.0)]
    m = Memory(spark.createDataFrame(rows, upkeep.RECORD), spark.createDataFrame(nodes, upkeep.NODE), spark.createDataFrame([], upkeep.COST))
    m, report = upkeep.maintain(m, 10.0, Upkeep(protection=5.0, least_weight=0.5, budget=192 + 16 + 2 * 508))
    assert [(r.what, r.id) for r in report.collect()] == [("expired", 1), ("evicted", 4)]
    assert sorted(r.record_id for r in m.records.collect()) == [2, 3]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(3)]
    rows = [(s, i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], [1.0], float(i), 1.0, i - 3 if i % 11 == 10 else None, 100) for i in range(30) for s in "ab"]
    u, batches = Upkeep(age_decay=0.05, least_weight=0.5, merge_least_similarity=0.5, slot_penalty=1.0), [rows[:14], rows[14:40], rows[40:]]
    for k, b in enumerate(batches):
        df = spark.createDataFrame(b, WRITE).coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
        m = upkeep.advance(spark, str(tmp_path / "batch"), k, df, 0.7, 8.0, u)
    q = upkeep.live(spark.readStream.schema(WRITE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "stream"), 0.7, 8.0, u)
    q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(300)
    again = Memory(*[spark.read.parquet(f"{tmp_path}/stream/2/{t}") for t in Memory._fields])
    for a, b in zip(m, again):
        assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)
    assert m.records.count() < len(rows) and m.nodes.where("leaf").count() >= 2
    reports = [spark.read.parquet(f"{tmp_path}/stream/{k}/report").count() for k in range(3)]
    assert reports[0] == 0 and sum(reports) > 0
    # each write is where its nearest leaf was, or alone
    first = Memory(*[spark.read.parquet(f"{tmp_path}/batch/0/{t}") for t in Memory._fields])
    assert first.nodes.count() == 14
