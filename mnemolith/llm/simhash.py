"""SimHash near-dedup with pigeonring filtering.

A fingerprint's bits are dealt to ``segments`` segments on a ring. If two
fingerprints differ in at most t bits, then some segment starts a chain all of
whose prefixes of l segments differ in at most floor(l * t / segments) bits.
For the first (segments - 1) // t segments that budget is 0, so they are the
key of an equi-join; the longer prefixes' budgets prune in the join condition
before the full Hamming check.

Equal fingerprints are one class before any join, so copies make no pairs. A
key with more than ``crowd`` classes (a large group of near copies) is not
paired: there the chain must hold to all but its last segment, which is an
equi-join again, of the exact chain with the chain or one of its one-bit
variants. So no bucket makes all its pairs and no link is lost.

``near_groups`` decides by the similarity of shingle sets (five words, 0.8).
Whole-document fingerprints of such pairs differ in up to 17 of 64 bits, where
no chain has a prefix without differences; so each document also gets
fingerprints of ``samples`` hash-chosen samples of its shingles, which are
equal if the samples are. Either kind of link is confirmed by the exact
similarity of the two shingle sets.

Defined results: a null text counts as empty; no words give fingerprint zero,
which links like any other; fewer words than a shingle make one shingle of all
of them; repeated rows give repeated rows; a null id takes part but is never a
component's id unless there is no other; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolith.llm.common import packed, quoted, tasks_for, text_or_empty, unpacked
from mnemolith.llm.components import connected_components
from mnemolith.llm.exact_dedup import bloom_filter, filter_test, in_filter
from mnemolith.session import bounded_batches, cut

BITS = 64
#: Bytes of a row's sketch, and the estimate below which a pair isn't compared in full: 0.3 under
#: 0.8, six standard deviations of an estimate from so many bytes.
SKETCH, SURE = 64, 0.5
#: Places in classes that one task takes.
PLACES = 200_000


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the lower-cased (A-Z) text, repeats included."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(parts), len(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1)
    k = min(words, n)
    first = np.concatenate([[0], ends[: n - k]]).tolist()
    hash_of = xxhash.xxh64_intdigest
    return np.array([hash_of(joined[a:b], 42) for a, b in zip(first, (ends[k - 1 :] - 1).tolist())], np.uint64)


def fingerprint(text: str, words: int = 3) -> int:
    """64 bits, each 1 if it is set in over half the shingle hashes."""
    return majority(shingle_hashes(text, words))


def majority(h: np.ndarray) -> int:
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 8192):
        total += np.unpackbits(h[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def sample_prints(h: np.ndarray, samples: int, size: int) -> np.ndarray:
    """SimHash of the ``size`` shingles that come first in each of ``samples`` seeded orders of the distinct hashes ``h``."""
    out = np.zeros(samples, np.uint64)
    for i in range(samples):
        key = (h ^ np.uint64((i * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
        first = h[np.argpartition(key, size - 1)[:size]] if len(h) > size else h
        total = np.unpackbits(first.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
        out[i] = np.packbits(total * 2 > len(first), bitorder="little").view("<u8")[0]
    return out


def sketch(h: np.ndarray) -> bytes:
    """One byte (1 to 255) of the least hash in each of ``SKETCH`` ranges of the mixed distinct hashes; 0 for an empty range."""
    x = np.sort(h * np.uint64(0x9E3779B97F4A7C15))
    at = np.searchsorted(x, np.arange(SKETCH, dtype=np.uint64) << np.uint64(58))
    out = np.zeros(SKETCH, np.uint8)
    some = at < len(x)
    least = x[at[some]]
    own = (least >> np.uint64(58)) == np.arange(SKETCH, dtype=np.uint64)[some]
    out[np.flatnonzero(some)[own]] = ((least[own] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(quoted(id_col)).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(each, "id long, fp long")


def _turned(fp: Column, bits: int) -> Column:
    return fp if not bits else F.shiftrightunsigned(fp, bits).bitwiseOR(F.shiftleft(fp, BITS - bits))


def _low(bits: int) -> int:
    return (1 << bits) - 1


def links(classes: DataFrame, max_distance: int = 2, segments: int = 8, crowd: int = 64) -> DataFrame:
    """Distinct pairs (a, b), a < b, of the column fp of ``classes`` that differ in at most ``max_distance`` bits."""
    width, exact = BITS // segments, (segments - 1) // max_distance
    if exact < 1 or BITS % segments:
        raise ValueError("segments must divide 64 and exceed max_distance")
    # ring: the fingerprint turned so that the chain's start is its lowest segment
    chains = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("start"), _turned(F.col("fp"), i * width).alias("ring")) for i in range(segments)])).alias("c")).select("fp", "c.start", "c.ring")
    chains = cut(chains.withColumn("key", F.col("ring").bitwiseAND(F.lit(_low(exact * width)))))
    crowded = chains.groupBy("start", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("start", "key")
    few = chains.join(crowded.hint("merge"), ["start", "key"], "left_anti")
    many = chains.join(crowded.hint("merge"), ["start", "key"], "left_semi")

    def within(x: Column) -> Column:
        ok = F.bit_count(x) <= max_distance
        for n in range(exact + 1, segments):
            ok = (F.bit_count(x.bitwiseAND(F.lit(_low(n * width)))) <= n * max_distance // segments) & ok
        return ok

    a, b = few.alias("a"), few.alias("b")
    near = a.join(b, (F.col("a.start") == F.col("b.start")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & within(F.col("a.ring").bitwiseXOR(F.col("b.ring")))).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    # the chain of all but the last segment, whose budget is below max_distance:
    # one side exact, the other with up to that many bits turned over
    reach, budget = (segments - 1) * width, (segments - 1) * max_distance // segments
    flips = [0]
    for _ in range(budget):
        flips = sorted({f ^ (1 << bit) if bit >= 0 else f for f in flips for bit in (-1, *range(exact * width, reach))})
    chain = F.col("ring").bitwiseAND(F.lit(_low(reach)))
    index = many.select("start", chain.alias("chain"), F.col("fp").alias("b"))
    probe = many.select("start", F.col("fp").alias("a"), F.explode(F.transform(F.lit(flips).cast("array<bigint>"), lambda f: chain.bitwiseXOR(f))).alias("chain"))
    dense = probe.join(index, ["start", "chain"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)).select("a", "b")
    return near.unionByName(dense).distinct()


def near_components(docs: DataFrame, words: int = 3, max_distance: int = 2, segments: int = 8, crowd: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    prints = cut(fingerprints(docs, words, id_col, text_col))
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected_components(links(classes, max_distance, segments, crowd))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(key, row, id, text), and whether keys are distinct: the key is the id if ids are there and distinct, else a hash of id and text (rows equal in both are one)."""
    id_, text = F.col(quoted(id_col)), text_or_empty(text_col)
    ids = docs.select(id_.cast("long").alias("id"))
    plain = ids.groupBy("id").count().where("id IS NULL OR count > 1").limit(1).count() == 0
    return packed(docs, key=id_.cast("long") if plain else F.xxhash64(F.coalesce(id_.cast("string"), F.lit("-")), text), id=id_, text=text), plain


def near_roots(rows: DataFrame, words: int = 5, similarity: float = 0.8, max_distance: int = 2, segments: int = 8, crowd: int = 64, samples: int = 16, sample_size: int = 4, distinct: bool = False) -> DataFrame:
    """(node, root) of rows (row, text) that links of ``similarity`` or more between sets of shingles lead to a smaller row.

    Links inside a component may go uncompared, never one between two.
    Candidates meet by their class (equal fingerprints of the whole text or of
    the same sample). Rounds compare leaders of each class with all its other
    members; two members are left uncompared only once both are of one
    component. The first leader of a class is its smallest row; a row meets that of
    its largest class first, and then those it isn't linked with. What is left apart
    then is put into new classes by rare shingles (the prefix filter, which loses
    no pair), so that texts that share a passage only are compared no more. What is
    apart even then is compared by how it differs from the member of its class that
    has the most links so far (``by_differences``, which loses no pair either).

    With ``distinct`` no two rows share a key. A pair's short sketches meet first.
    Sets of shingles are made and moved only for pairs that the sketches leave,
    and compared row by row in the JVM.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every, sizes, short = [], [], []
            for t in b.column(1).to_pylist():
                h = shingle_hashes(t, words)
                distinct = np.unique(h)
                every.append(np.concatenate([np.array([majority(h)], np.uint64), sample_prints(distinct, samples, sample_size)]) if len(h) else np.zeros(2, np.uint64))
                sizes.append(len(distinct))
                short += [sketch(distinct), *[None] * (len(every[-1]) - 1)]
            lengths = np.fromiter(map(len, every), np.int64, len(every))
            kinds, values = (np.concatenate(x) if every else np.empty(0, k) for x, k in (([np.arange(n) for n in lengths], np.int64), (every, np.uint64)))
            yield pa.record_batch([pa.array(np.repeat(b.column(0).to_numpy(), lengths)), pa.array(kinds.astype(np.int32)), pa.array(values.view(np.int64)), pa.array(np.repeat(np.array(sizes, np.int32), lengths)), pa.array(short, pa.binary())], names=["row", "kind", "fp", "size", "sketch"])

    bounded_batches(rows.sparkSession)
    made = cut(rows.select("row", "text").mapInArrow(prints, "row long, kind int, fp long, size int, sketch binary"))
    # what follows is of at most so many rows, so it needs no more tasks than these
    tasks = tasks_for(rows.sparkSession, made.count(), PLACES)
    sketches = made.where("kind = 0").select("row", "size", "sketch")
    sketches = cut(sketches if distinct else sketches.dropDuplicates(["row"]))
    firsts = cut(made.where("kind = 0").groupBy("fp").agg(F.min("row").alias("row")))
    linked = links(firsts.select("fp"), max_distance, segments, crowd)
    near = linked.join(firsts.select(F.col("fp").alias("a"), F.col("row").alias("u")).hint("merge"), "a").join(firsts.select(F.col("fp").alias("b"), F.col("row").alias("v")).hint("merge"), "b").select("u", "v")
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.maximum(b.column(2).to_numpy(), b.column(3).to_numpy())
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (4, 5))
            some, same = ((x > 0) | (y > 0)).sum(axis=1), ((x == y) & (x > 0)).sum(axis=1)
            yield b.select(["u", "v"]).take(pa.array(np.flatnonzero((n < 2 * SKETCH) | (same >= SURE * some))))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(row, hashes) of the rows named; a Bloom filter of them is broadcast, so others may come too."""
        packed_, bits, k = bloom_filter(wanted.select(F.xxhash64("row")), max(1, wanted.count()), 1)
        shared = rows.sparkSession.sparkContext.broadcast(packed_)

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                b = b.filter(pa.array(in_filter(shared.value, bits, k, b.column(2).to_numpy())))
                h = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in b.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, h)]).astype(np.int32)
                yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*h, np.empty(0, np.int64)])))], names=["row", "hashes"])

        hashes = rows.select("row", "text", F.xxhash64("row").alias("h")).mapInArrow(sets, "row long, hashes array<long>")
        hashes = cut(hashes if distinct else hashes.dropDuplicates(["row"]))
        shared.destroy()  # the sets are written
        return hashes

    def confirmed(pairs: DataFrame, known: DataFrame | None = None, hashes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The pairs that aren't among the ``known`` ones, and those of them that are alike, by the sets given or by new ones."""
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        pairs = cut((pairs.join(known.hint("merge"), ["u", "v"], "left_anti") if known is not None else pairs).coalesce(tasks))
        if pairs.isEmpty():
            return pairs, pairs
        first, second = (sketches.select(F.col("row").alias(k), F.col("size").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")).hint("merge") for k in "uv")
        left = cut(pairs.join(first, "u").join(second, "v").select("u", "v", "nu", "nv", "su", "sv").mapInArrow(close, "u long, v long"))
        if hashes is None:
            hashes = sets_of(cut(left.select(F.explode(F.array("u", "v")).alias("row")).distinct()))
        both = left.join(hashes.select(F.col("row").alias("v"), F.col("hashes").alias("hv")), "v").join(hashes.select(F.col("row").alias("u"), F.col("hashes").alias("hu")), "u")
        n = F.size(F.array_intersect("hu", "hv"))
        return pairs, cut(both.where(n >= similarity * (F.size("hu") + F.size("hv") - n)).select("u", "v"))

    def named(places: DataFrame, *key: str) -> DataFrame:
        """(class, row, size, leader) of the rows that share a key; classes of the same rows are one."""
        mark = [F.count("*").alias("n"), F.min("row").alias("leader"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")]
        classes = places.groupBy(*key).agg(*mark).where("n > 1").groupBy("n", "leader", "x", "y").agg(F.min(F.struct(*key)).alias("c")).select("c.*", "leader", "n")
        return cut(places.join(classes.hint("merge"), list(key)).select(F.xxhash64(*key).alias("class"), "row", "size", "leader", "n").distinct().coalesce(tasks))

    def shared_shingles(sets: DataFrame) -> DataFrame:
        """(row, size, hashes) of sets: the shingles that other sets have too, the rarest first."""
        each = cut(sets.select("row", F.size("hashes").alias("size"), F.explode("hashes").alias("h")))
        often = cut(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
        shared = each.join(often.hint("merge"), "h").groupBy("row").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "h"))).alias("s"))
        return cut(shared.select("row", "size", F.col("s.h").alias("hashes")))

    def by_rare_shingles(shared: DataFrame) -> DataFrame:
        """The places (h, row, size) of rows: their rarest shingles, so many that rows alike share one (the prefix filter)."""
        prefix = F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1
        # shingles that no other row has come first
        rest = F.greatest(prefix - (F.col("size") - F.size("hashes")), F.lit(0)).cast("int")
        return shared.select(F.explode(F.slice("hashes", F.lit(1), rest)).alias("h"), "row", "size")

    def sized(pairs: DataFrame) -> DataFrame:
        return pairs.where((F.least("size", "lead_size") >= similarity * F.greatest("size", "lead_size")) & (F.col("row") != F.col("lead"))).select(F.col("row").alias("u"), F.col("lead").alias("v"))

    def meetings(members: DataFrame, roots: DataFrame | None) -> DataFrame:
        """The members of classes with their leaders, of those that aren't of one component."""
        ends = members.where("row = leader").select("class", F.col("row").alias("lead"), F.col("size").alias("lead_size"))
        if roots is None:
            return sized(members.join(ends.hint("merge"), "class"))
        own = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root")).hint("merge")
        ends = ends.join(own("lead"), "lead", "left").withColumn("lead_root", F.coalesce("lead_root", "lead"))
        state = members.join(own("row"), "row", "left").withColumn("row_root", F.coalesce("row_root", "row"))
        return sized(state.join(ends.hint("merge"), "class").where("row_root <> lead_root"))

    def starred(members: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(compared, found, roots) once every member is compared with its classes' leaders, or of one component with them.

        Each row meets the leader of its largest class first. That links most rows of a large group, however many classes
        they share, so that few are left to meet the leaders of the others.
        """
        largest = members.where("row <> leader").groupBy("row").agg(F.max_by(F.struct("class", "size", "leader", "n"), F.struct("n", "class")).alias("m")).select("m.class", "row", "m.size", "m.leader", "m.n")
        first, found = confirmed(meetings(cut(largest.coalesce(tasks).unionByName(members.where("row = leader"))), None).unionByName(more), None)
        roots = connected_components(found, "u", "v")
        second, rest = confirmed(meetings(members, roots), first)
        return first.unionByName(second), found.unionByName(rest), grown(roots, rest)

    def grown(roots: DataFrame, links_: DataFrame) -> DataFrame:
        """The components so far and the new links, which join roots: only those are put together anew."""
        if links_.isEmpty():
            return roots
        ends = links_
        for k in "uv":
            ends = ends.join(roots.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root")).hint("merge"), k, "left").withColumn(k, F.coalesce(f"{k}_root", k)).select("u", "v")
        new = connected_components(ends, "u", "v")
        moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")).hint("merge"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        return cut(moved.unionByName(new))

    def apart(members: DataFrame, roots: DataFrame) -> DataFrame:
        """(class, row, root) of members beside the leaders, of classes in which those aren't of one component."""
        own = roots.withColumnRenamed("node", "row").hint("merge")
        state = cut(members.where("row <> leader").join(own, "row", "left").select("class", "row", F.coalesce("root", "row").alias("root")).coalesce(tasks))
        opened = cut(state.groupBy("class").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("class").coalesce(tasks))
        return cut(state.join(opened.hint("merge"), "class").coalesce(tasks))

    members = named(made.select("kind", "fp", "row", "size"), "kind", "fp")
    compared, found, roots = starred(members, near)
    if not (left := apart(members, roots)).limit(1).count():
        return roots
    # what shares a sample and is still apart mostly shares a passage: classes of rare shingles take the place of those
    wanted = cut(left.select("row").distinct())
    sets = cut(sets_of(wanted).join(wanted.hint("merge"), "row", "left_semi"))
    shared = shared_shingles(sets)
    members = named(by_rare_shingles(shared), "h")
    seen, more = confirmed(meetings(members, roots), compared, sets)
    compared, found, roots = compared.unionByName(seen), found.unionByName(more), grown(roots, more)
    if not (left := apart(members, roots)).limit(1).count():
        return roots
    # a class's centre is its member with the most links: classes of one group mostly have the same
    degrees = found.select(F.explode(F.array("u", "v")).alias("row")).groupBy("row").agg(F.count("*").alias("degree"))
    # the classes are written, so Spark can split a large one
    opened = cut(left.select("class").distinct().coalesce(tasks))
    ranked = members.join(opened.hint("merge"), "class", "left_semi").join(degrees.hint("merge"), "row", "left")
    centres = cut(ranked.groupBy("class").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)), F.xxhash64("row"), "row")).alias("m")).select("class", F.col("m.row").alias("centre")).coalesce(tasks))
    centres = centres.join(roots.select(F.col("node").alias("centre"), F.col("root").alias("centre_root")).hint("merge"), "centre", "left").withColumn("centre_root", F.coalesce("centre_root", "centre"))
    places = cut(left.join(centres.hint("merge"), "class").where("row <> centre").select("centre", "centre_root", "row", "root").distinct().coalesce(tasks))
    linked, pairs = by_differences(places, shared, similarity)
    return grown(roots, cut(linked.unionByName(confirmed(pairs, compared, sets)[1])))


def by_differences(places: DataFrame, shared: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) of rows with their centre, and pairs (u, v) of a centre's rows that aren't of one component and may be alike.

    ``places`` has (centre, centre_root, row, root), ``shared`` each row's size and
    its shingles that others have too, the rarest first. Sets differ from each other as their
    differences from the same centre do, and near copies of one text have little in
    common in these: each has edits of its own. Rows alike the centre are of
    its component. Of any other pair one row at least is not alike the centre, so its
    difference is above ``far`` times both sizes; for the pair to be alike the two
    differences must then share so many shingles that their first ones in an order
    (the row's own, those beside the centre's by how rare they are, the centre's by
    how common) have one in common, with enough of both left behind it.
    """
    far = (1 - similarity) / (1 + similarity)
    of_centre = shared.select(F.col("row").alias("centre"), F.col("size").alias("centre_size"), F.col("hashes").alias("centre_hashes"))
    both = places.join(shared.hint("merge"), "row").join(of_centre.hint("merge"), "centre")
    both = both.select("centre", "row", "root", "size", "centre_size", (F.col("root") == F.col("centre_root")).alias("near"), (F.col("size") - F.size("hashes")).alias("own"), (F.col("centre_size") - F.size("centre_hashes")).alias("centre_own"), F.array_except("hashes", "centre_hashes").alias("more"), F.reverse(F.array_except("centre_hashes", "hashes")).alias("less"))
    n = F.col("size") - F.col("own") - F.size("more")
    both = cut(both.withColumn("alike", n >= similarity * (F.col("size") + F.col("centre_size") - n)))
    # the centre's own shingles, which all others lack, come last: the first stands for all
    order = F.concat("more", "less", F.when(F.col("centre_own") > 0, F.array(F.xxhash64("centre"))).otherwise(F.expr("array()").cast("array<bigint>")))
    d = both.select("centre", "row", "root", "size", "own", (~F.col("near") & ~F.col("alike")).alias("out"), "centre_size", order.alias("order"), (F.col("own") + F.size("more") + F.size("less") + F.col("centre_own")).alias("d"))
    least = lambda x: F.greatest(F.ceil(x - 1e-9), F.lit(1))
    # what a row shares with a row that isn't alike the centre, and what such a one shares with any
    with_out, with_any = least((F.col("d") + far * (F.col("centre_size") - F.col("size"))) / 2), least((F.col("d") - far * (F.col("size") + F.col("centre_size"))) / (1 + far))
    first = lambda x: F.greatest(F.col("d") - x + 1 - F.col("own"), F.lit(0)).cast("int")
    d = d.withColumns({"short": first(F.when(F.col("out"), F.greatest(with_out, with_any)).otherwise(with_out)), "long": first(with_any)})
    firsts = d.select("centre", "row", "root", "size", "out", "d", "short", (F.col("d") - F.col("own")).alias("rest"), F.posexplode(F.slice("order", F.lit(1), F.when(F.col("out"), F.greatest("short", "long")).otherwise(F.col("short")))).alias("at", "h"))
    firsts = cut(firsts.withColumn("rest", F.col("rest") - F.col("at")))
    a, b = firsts.where("out").alias("a"), firsts.where("at < short").alias("b")
    enough = (F.col("a.d") + F.col("b.d") - far * (F.col("a.size") + F.col("b.size"))) / 2 - 1e-9 <= F.least("a.rest", "b.rest")
    once = ~F.col("b.out") | (F.col("a.at") < F.col("a.short")) & (F.col("a.row") < F.col("b.row"))
    pairs = a.join(b.hint("merge"), (F.col("a.centre") == F.col("b.centre")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.root") != F.col("b.root")) & once & enough).select(F.col("a.row").alias("u"), F.col("b.row").alias("v"))
    return both.where("alike AND NOT near").select(F.col("row").alias("u"), F.col("centre").alias("v")), pairs


def drop_near(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of near copies, the one with the smallest id; columns as they are.

    Rows without words are one group (their sets are equal); rows equal in id and text are copies.
    """
    spark = docs.sparkSession
    rows, plain = keyed(docs, id_col, text_col)
    roots = near_roots(rows.select(F.col("key").alias("row"), "text"), words, similarity, distinct=plain, **how)
    members = cut(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
    test = filter_test(spark, *bloom_filter(members.select(F.xxhash64("node")), max(1, members.count()), 1))
    tested = rows.withColumn("maybe", test(F.xxhash64("key")))
    maybe = tested.where("maybe").select("row", "id", "key")
    # by id: a component's row with the smallest id stays (a null id last)
    ids = maybe.select("key", "id").join(members, F.col("key") == F.col("node"))
    kept = ids.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("m")).select(F.col("m.key").alias("node"))
    gone = cut(members.select("node").join(kept, "node", "left_anti"))
    stay = maybe.join(gone, F.col("key") == F.col("node"), "left_anti")
    out = tested.where("not maybe").select("row", "key").unionByName(stay.select("row", "key"))
    if not plain:
        twice = cut(rows.groupBy("key").count().where("count > 1").select("key"))
        out = out.join(twice, "key", "left_anti").select("row", "key").unionByName(out.join(twice, "key", "left_semi").dropDuplicates(["key"]).select("row", "key"))
    return unpacked(out, docs.columns)
