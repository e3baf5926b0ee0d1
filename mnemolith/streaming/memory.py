"""Clustered memories as stateful operators over ordered events.

An event is a write or a read (op, seq, vector, value, source, conflict_group,
time, top_k). A key (stream, layer, group) has one memory; its events are
applied in the order of (time, seq), reads after the writes before them. The
batch runner deals keys over tasks; the streaming runner keeps the same state
between micro-batches. Memories are bounded: ``slots`` at most, of which the one
that was idle longest is replaced, and the last ``records`` of each slot; what a
record superseded, and whose conflict group's last it was, is forgotten with it.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from mnemolith.functions.vector import vmf_densities, vmf_density

OUT = "stream string, layer int, grp string, seq long, op string, slot long, created boolean, score double, p_new double, results array<string>"


@dataclass(frozen=True)
class Policy:
    """How a write finds its slot.

    kind: ``threshold`` joins the nearest slot at ``threshold`` or more (``strict``: only above it);
    ``quantile`` takes the threshold from the last ``history`` nearest similarities once there are ``warm_up``;
    ``vmf`` makes a slot if its posterior probability exceeds ``tau_new``. With ``temporal``
    a write supersedes the last one of its conflict group and reads see current sources only.
    """

    kind: str = "threshold"
    threshold: float = 0.9
    strict: bool = False
    quantile: float = 0.1
    warm_up: int = 16
    history: int = 256
    alpha: float = 0.1
    tau_new: float = 0.5
    count_exponent: float = 0.5
    prior_mass: float = 1.0
    largest_kappa: float = 1000.0
    temporal: bool = False
    slots: int = 10_000
    records: int = 1024
    route_k: int = 4


@dataclass
class State:
    """Arrays have room for more slots than the ``n`` there are."""

    n: int = 0
    sums: np.ndarray | None = None  # of a slot's unit vectors
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the sums
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    touched: np.ndarray = field(default_factory=lambda: np.zeros(0))
    members: list = field(default_factory=list)  # of each slot, (source, unit vector, conflict group)
    current: dict = field(default_factory=dict)  # conflict group -> last source
    stale: set = field(default_factory=set)
    seen: deque = field(default_factory=deque)  # nearest similarities
    clock: float = -math.inf

    def place(self, dims: int) -> int:
        """Room for one more slot."""
        if self.sums is None or self.n == len(self.sums):
            room = max(16, 2 * self.n)
            grown = np.zeros((room, dims))
            if self.n:
                grown[: self.n] = self.sums
            self.sums = grown
            self.lengths, self.counts, self.touched = (np.concatenate([x, np.zeros(room - len(x), x.dtype)]) for x in (self.lengths, self.counts, self.touched))
        self.members.append(deque())
        self.n += 1
        return self.n - 1


def _unit(v) -> np.ndarray:
    v = np.asarray(v, float)
    n = np.linalg.norm(v)
    if not n or not np.isfinite(n):
        raise ValueError("vector must be finite and non-zero")
    return v / n


def forget(s: State, slot: int) -> None:
    """A slot's oldest record goes, with what is known of it."""
    source, _, group = s.members[slot].popleft()
    s.stale.discard(source)
    if group is not None and s.current.get(group) == source:
        del s.current[group]


def write(s: State, p: Policy, e) -> tuple[int, bool, float, float]:
    """Applies a write: (slot, created, similarity to the nearest, probability of a new slot)."""
    v = _unit(e.vector)
    slot, created, near, p_new = -1, True, 0.0, 1.0
    if s.n:
        lengths = s.lengths[: s.n]
        cos = s.sums[: s.n] @ v / np.maximum(lengths, 1e-12)
        slot, near = int(cos.argmax()), float(cos.max())
        if p.kind == "vmf":
            counts, d = s.counts[: s.n].astype(float), len(v)
            r = np.minimum(1, lengths / (counts + p.prior_mass))
            kappa = np.clip(r * (d - r * r) / np.maximum(1 - r * r, 1e-12), 0, p.largest_kappa)
            log = np.concatenate([[math.log(p.alpha) + vmf_density(0, 0, d)], p.count_exponent * np.log(counts) + vmf_densities(cos, kappa, d)])
            post = np.exp(log - log.max())
            post /= post.sum()
            p_new, slot = float(post[0]), int(post[1:].argmax())
            created = p_new > p.tau_new
        else:
            least = p.threshold
            if p.kind == "quantile" and len(s.seen) >= p.warm_up:
                least = float(np.quantile(list(s.seen), p.quantile))
            created = near <= least if p.strict else near < least
            s.seen.append(near)
            if len(s.seen) > p.history:
                s.seen.popleft()
    if created:
        if s.n >= p.slots:
            slot = int(np.argmin(s.touched[: s.n]))
            while s.members[slot]:
                forget(s, slot)
        else:
            slot = s.place(len(v))
        s.sums[slot], s.counts[slot] = v, 1
    else:
        s.sums[slot] += v
        s.counts[slot] += 1
    s.lengths[slot] = np.linalg.norm(s.sums[slot])
    s.touched[slot] = e.time
    s.members[slot].append((e.source, v, e.conflict_group))
    if len(s.members[slot]) > p.records:
        forget(s, slot)
    if p.temporal and e.conflict_group is not None:
        if (old := s.current.get(e.conflict_group)) is not None:
            s.stale.add(old)
        s.current[e.conflict_group] = e.source
    return slot, created, near, p_new


def read(s: State, p: Policy, e) -> tuple[int, float, list[str]]:
    """(best slot, its similarity, sources of the ``top_k`` nearest records of the ``route_k`` nearest slots)."""
    if not s.n:
        return -1, 0.0, []
    v = _unit(e.vector)
    cos = s.sums[: s.n] @ v / np.maximum(s.lengths[: s.n], 1e-12)
    route = np.argsort(-cos, kind="stable")[: p.route_k]
    held = [m for slot in route for m in s.members[slot]]
    found = [(float(x @ v), -k, src) for k, (src, x, _) in enumerate(held) if src not in s.stale]
    return int(route[0]), float(cos[route[0]]), [src for _, _, src in sorted(found, reverse=True)[: int(e.top_k)]]


def apply(s: State, p: Policy, events: pd.DataFrame) -> list[tuple]:
    """Applies a key's events in order; one before the clock is late and changes nothing."""
    out = []
    for e in events.sort_values(["time", "seq"]).itertuples(index=False):
        if e.time < s.clock:
            out.append((e.seq, "late", -1, False, 0.0, 0.0, []))
            continue
        s.clock = e.time
        if e.op == "write":
            slot, created, near, p_new = write(s, p, e)
            out.append((e.seq, "write", slot, created, near, p_new, []))
        else:
            slot, near, found = read(s, p, e)
            out.append((e.seq, "read", slot, False, near, 0.0, found))
    return out


def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["seq", "op", "slot", "created", "score", "p_new", "results"])
    return out.assign(stream=key[0], layer=key[1], grp=key[2])[["stream", "layer", "grp", "seq", "op", "slot", "created", "score", "p_new", "results"]]


def _in_order(events: DataFrame, policy_of: Callable[[str], Policy]) -> DataFrame:
    """Every key's events in order, streamed through one task beside the memory: a sequence, each step depending on those before."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = s = None
        for frame in frames:
            for its, rows in frame.groupby(["stream", "layer", "grp"], sort=False):
                if its != key:
                    key, s = its, State()
                yield _frame(its, apply(s, policy_of(its[0]), rows))

    ordered = events.repartition("stream", "layer", "grp").sortWithinPartitions("stream", "layer", "grp", "time", "seq")
    return ordered.mapInPandas(each, OUT)


def run_batch(events: DataFrame, policy: Policy) -> DataFrame:
    """One row for each event."""
    return _in_order(events, lambda _: policy)


def run_stream(events: DataFrame, policy: Policy) -> DataFrame:
    """The same over a streaming DataFrame; the memory is kept in the state store between micro-batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = pickle.loads(state.get[0]) if state.exists else State()
        yield _frame(key, apply(s, policy, pd.concat(list(frames))))
        state.update((pickle.dumps(s),))

    return events.groupBy("stream", "layer", "grp").applyInPandasWithState(step, OUT, "memory binary", "append", GroupStateTimeout.NoTimeout)


def sweep(events: DataFrame, policies: dict[str, Policy]) -> DataFrame:
    """Every policy over the same events, in parallel: adds ``config`` to the stream's name and back."""
    from pyspark.sql import functions as F

    names = F.array(*[F.lit(n) for n in policies])
    grid = events.withColumn("config", F.explode(names)).withColumn("stream", F.concat_ws("|", "config", "stream"))

    done = _in_order(grid, lambda stream: policies[stream.split("|", 1)[0]])
    return done.withColumns({"config": F.split("stream", r"\|", 2)[0], "stream": F.split("stream", r"\|", 2)[1]})
