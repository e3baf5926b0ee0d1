"""Document fingerprints: a Merkle tree over sections and paragraphs.

A section ends with an empty line, a paragraph with a line break; a paragraph's
leaves are its sentences (a sentence over 256 bytes is cut each 256). A node's
digest is the XXH64 of its children's digests. The fingerprint is the root in
16 hex digits, then the tree: sections joined by ``/``, paragraphs by ``.``,
each with 6 digits of every leaf. Equal roots mean equal texts; where they
differ, ``differing`` walks down the branches that differ.

Likeness is Dice's coefficient over the leaves, repeats included: twice the
shared leaves over all leaves (1 for equal fingerprints).

``with_edits`` pairs each document with the next one by descending id. Ids
alone are sorted (by range, over all tasks); texts move once by id, compressed,
and of the next document only the part that the edit needs.

Defined results: a null text counts as empty; an empty text's fingerprint has
no leaves and is alike (1) only to another of them; a null id comes after all
others; of rows that share an id, the next document is the one with the
smallest text; a single document is next to itself; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolith.llm.common import quoted, text_or_empty
from mnemolith.session import bounded_batches, cut

LEAF, SHOWN = 256, 6
#: Stands for a null id within the joins.
NO_ID = -(1 << 63)


def fingerprint(text: str) -> str:
    digest = xxhash.xxh64_digest
    root, sections = [], []
    nodes: list[bytes] = []
    paragraphs: list[str] = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n") if text else ():
        leaves = [digest(s) if len(s) <= LEAF else b"".join(digest(s[k : k + LEAF]) for k in range(0, len(s), LEAF)) for s in line.split(b". ")] if line else []
        all_leaves = b"".join(leaves)
        nodes.append(digest(all_leaves))
        shown = all_leaves.hex()
        paragraphs.append("".join([shown[k : k + SHOWN] for k in range(0, len(shown), 16)]))
        if not line:
            root.append(digest(b"".join(nodes)))
            sections.append(".".join(paragraphs))
            nodes, paragraphs = [], []
    if nodes:
        root.append(digest(b"".join(nodes)))
        sections.append(".".join(paragraphs))
    return digest(b"".join(root)).hex() + ":" + "/".join(sections)


def leaves(print_: str) -> list[str]:
    return [p[k : k + SHOWN] for s in print_[17:].split("/") for p in s.split(".") for k in range(0, len(p), SHOWN)]


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of the branches that differ, by position; none if the roots are equal."""
    if a[:16] == b[:16]:
        return []
    out = []
    sa, sb = a[17:].split("/"), b[17:].split("/")
    for i in range(max(len(sa), len(sb))):
        x, y = (s[i] if i < len(s) else None for s in (sa, sb))
        if x != y:
            px, py = (z.split(".") if z is not None else [] for z in (x, y))
            out += [(i, j) for j in range(max(len(px), len(py))) if px[j : j + 1] != py[j : j + 1]]
    return out


def pack(text: str) -> bytes:
    """Compressed, for the way between tasks."""
    return zstandard.compress(text.encode("utf-8", "surrogatepass"), 1)


def unpack(raw: bytes) -> str:
    """A text of any length is held whole by its own task only."""
    return zstandard.decompress(raw).decode("utf-8", "surrogatepass")


def likeness(a: str, b: str) -> float:
    if a[:16] == b[:16]:
        return 1.0
    x, y = Counter(leaves(a)), Counter(leaves(b))
    total = x.total() + y.total()
    return 2 * (x & y).total() / total if total else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""
    bounded_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.string())], names=["id", "fingerprint"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(each, "id long, fingerprint string").withColumnRenamed("id", id_col)


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next) for distinct ids in descending order, the last followed by the first."""
    ranged = cut(ids.select("id").repartitionByRange(F.desc("id")).withColumn("part", F.spark_partition_id()))
    tops = sorted((r.part, r.top) for r in ranged.groupBy("part").agg(F.max("id").alias("top")).collect())  # one row for each partition
    after = {p: tops[(k + 1) % len(tops)][1] for k, (p, _) in enumerate(tops)}
    edge = F.create_map(*[F.lit(x) for kv in after.items() for x in kv])[F.col("part")] if after else F.lit(None).cast("long")
    return ranged.select("id", F.coalesce(F.lead("id").over(Window.partitionBy("part").orderBy(F.desc("id"))), edge).alias("next"))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    bounded_batches(docs.sparkSession)
    def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.record_batch([b.column(0), pa.array([pack(t) for t in texts], pa.binary())], names=["id", "text"])

    plain = docs.select(F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(NO_ID)).alias("id"), text_or_empty(text_col).alias("text"))
    rows = plain.mapInArrow(packed_texts, "id long, text binary")
    ids = cut(plain.groupBy("id").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("rows")))
    many = ids.where("rows > 1").limit(1).count() > 0
    # who each document is next to, and how much of it that edit needs
    wanted = next_ids(ids).join(ids, "id").select(F.col("next").alias("id"), F.col("id").alias("to"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    wanted = cut(wanted)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [unpack(t) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([pack(t[:n]) for t, n in zip(texts, b.column(1).to_pylist())], pa.binary()), pa.array([pack(fingerprint(t)) for t in texts], pa.binary()), *([pa.array(texts, pa.string())] if many else [])], names=["to", "head", "print", *(["whole"] if many else [])])

    sent = rows.join(wanted, "id").select("to", "need", "text").mapInArrow(heads, "to long, head binary, print binary" + ", whole string" * many)
    if many:
        sent = sent.groupBy("to").agg(F.min(F.struct("whole", "head", "print")).alias("s")).select("to", "s.head", "s.print")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, raw, head, other in zip(*(c.to_pylist() for c in b.columns)):
                t = unpack(raw)
                half = len(t) // 2
                edited, other = t[: len(t) - half] + unpack(head)[:half], unpack(other)
                own, new = fingerprint(t), fingerprint(edited)
                out.append((None if i == NO_ID else i, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, new, likeness(own, new), likeness(own, other)))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    paired = rows.join(sent, F.col("id") == F.col("to")).select("id", "text", "head", "print")
    return paired.mapInArrow(edit, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
