"""Clustered memories against plain lists, and the streaming runner against the batch one."""

import math
import random

import pytest

from mnemolith.streaming import memory

EVENTS = "stream string, layer int, grp string, seq long, op string, time double, vector array<double>, source string, conflict_group string, top_k int"


def made(n=120, dims=6, seed=2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, 0.4) for x in c]
        rows.append((f"s{i % 2}", 0, "g", i, "read" if i % 5 == 4 else "write", float(i), v, f"r{i}", f"c{rng.randrange(12)}", 3))
    rows.append(("s0", 0, "g", n, "write", 3.0, [1.0] * dims, "late", None, 3))  # behind its stream's clock, so late
    return rows


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def plain(rows, p):
    """One list of slots, each with all its unit vectors."""
    out = {}
    for stream in sorted({r[0] for r in rows}):
        slots, seen, current, stale, clock = [], [], {}, set(), -math.inf
        for _, _, _, seq, op, time, vector, source, group, k in sorted((r for r in rows if r[0] == stream), key=lambda r: r[3]):
            if time < clock:
                out[stream, seq] = ("late", -1, [])
                continue
            clock, v = time, unit(vector)
            cos = [dot(unit([sum(c) for c in zip(*(x for _, x in s["m"]))]), v) for s in slots]
            if op == "read":
                route = sorted(range(len(slots)), key=lambda i: -cos[i])[: p.route_k]
                found = sorted(((dot(x, v), -n, src) for n, (src, x) in enumerate(m for i in route for m in slots[i]["m"]) if src not in stale), reverse=True)
                out[stream, seq] = ("read", route[0] if route else -1, [s for _, _, s in found[:k]])
                continue
            new = not slots
            if slots:
                near, least = max(cos), p.threshold
                if p.kind == "quantile" and len(seen) >= p.warm_up:
                    ordered, at = sorted(seen), (len(seen) - 1) * p.quantile
                    low = int(at)
                    least = ordered[low] + (at - low) * (ordered[min(low + 1, len(seen) - 1)] - ordered[low])
                new = near <= least if p.strict else near < least
                seen = [*seen, near][-p.history :]
            if new:
                slots.append({"m": []})
                slot = len(slots) - 1
            else:
                slot = cos.index(max(cos))
            slots[slot]["m"].append((source, v))
            if p.temporal and group is not None:
                if group in current:
                    stale.add(current[group])
                current[group] = source
            out[stream, seq] = ("write", slot, [])
    return out


@pytest.mark.parametrize("policy", [memory.Policy(threshold=0.6), memory.Policy(threshold=0.6, strict=True), memory.Policy("quantile", threshold=0.6), memory.Policy(threshold=0.6, temporal=True)])
def test_against_plain_lists(spark, policy):
    rows = made()
    # late is what comes behind in (time, seq) order only within a run, so the plain version sorts by seq alone
    batch = [r for r in rows if r[7] != "late"]
    got = {(r.stream, r.seq): (r.op, r.slot, list(r.results)) for r in memory.run_batch(spark.createDataFrame(batch, EVENTS), policy).collect()}
    assert got == plain(batch, policy)


def test_vmf_makes_the_centres(spark):
    rows = [r for r in made(200, dims=40) if r[7] != "late"]
    done = memory.run_batch(spark.createDataFrame(rows, EVENTS), memory.Policy("vmf")).where("op = 'write'").collect()
    assert 2 <= len({(r.stream, r.slot) for r in done}) < len(done)
    assert all(0 <= r.p_new <= 1 for r in done)


def test_bounds(spark):
    rows = [r for r in made(200) if r[7] != "late"]
    done = memory.run_batch(spark.createDataFrame(rows, EVENTS), memory.Policy(threshold=0.99, slots=3, records=2)).collect()
    assert max(r.slot for r in done) == 2


def test_stream_equals_batch(spark, tmp_path):
    rows, policy = made(), memory.Policy(threshold=0.6, temporal=True)
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k : k + 40], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = memory.run_stream(events, policy).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.stream, r.seq): (r.op, r.slot, list(r.results)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == plain(rows, policy)
    assert got["s0", 120] == ("late", -1, [])


def test_what_is_known_of_records_is_bounded():
    """Many more sources and conflict groups than the memory has room for."""
    from types import SimpleNamespace

    rng, s, p = random.Random(5), memory.State(), memory.Policy(threshold=0.99, temporal=True, slots=4, records=3)
    for i in range(3000):
        memory.write(s, p, SimpleNamespace(vector=[rng.gauss(0, 1) for _ in range(4)], source=f"r{i}", conflict_group=f"c{rng.randrange(400)}" if i % 2 else f"own{i}", time=float(i)))
        held = {m[0] for members in s.members for m in members}
        assert len(held) <= 12 and s.stale <= held and set(s.current.values()) <= held


def plain_vmf(rows, p):
    """Every write's posterior from all unit vectors of each slot."""
    from mnemolith.functions.vector import sphere_log_density, vmf_density

    out = {}
    for stream in sorted({r[0] for r in rows}):
        slots = []
        for _, _, _, seq, op, _, vector, *_ in sorted((r for r in rows if r[0] == stream and r[4] == "write"), key=lambda r: r[3]):
            v, d = unit(vector), len(vector)
            logs = [math.log(p.alpha) + sphere_log_density(d)]
            for members in slots:
                total = [sum(c) for c in zip(*members)]
                r = min(1, math.sqrt(dot(total, total)) / (len(members) + p.prior_mass))
                kappa = min(p.largest_kappa, r * (d - r * r) / max(1 - r * r, 1e-12))
                logs.append(p.count_exponent * math.log(len(members)) + vmf_density(dot(unit(total), v), kappa, d))
            top = max(logs)
            p_new = math.exp(logs[0] - top) / sum(math.exp(x - top) for x in logs)
            if not slots or p_new > p.tau_new:
                slots.append([v])
                slot = len(slots) - 1
            else:
                slot = logs[1:].index(max(logs[1:]))
                slots[slot].append(v)
            out[stream, seq] = (slot, round(p_new, 9))
    return out


@pytest.mark.parametrize("dims", [6, 40])
def test_vmf_writes_against_plain_sums(spark, dims):
    rows = [r for r in made(160, dims=dims) if r[7] != "late"]
    p = memory.Policy("vmf")
    got = {(r.stream, r.seq): (r.slot, round(r.p_new, 9)) for r in memory.run_batch(spark.createDataFrame(rows, EVENTS), p).where("op = 'write'").collect()}
    assert got == plain_vmf(rows, p)
