"""SentencePiece encoding and decoding by a streaming Viterbi.

The best segmentation of a text into the model's pieces (highest sum of piece
scores; a character without a piece falls back to its bytes at a penalty).
That is what a unigram model means by encoding. A BPE model's scores are the
ranks of its merges, and its own encoding applies those one by one: for such a
model the result is another valid segmentation that decodes to the same text,
but not the library's ids. The columns are therefore named ``best_``; counts
and ids as a BPE model gives them are those of the token-count operator.

The search keeps a window of best scores and back pointers no longer than the
longest piece. Whenever all surviving back pointer paths meet in one boundary,
what lies before it is final: its ids are committed and forgotten. So memory
doesn't grow with a text.

A run of spaces and what follows it is such a unit if no piece of the model
has a space after another character; units are committed one by one, and
those met before are remembered (in bounded memory).

Decoding turns ids into their pieces (bytes for byte pieces) and marks into
spaces, and drops the one space that encoding puts in front.

Defined results: a null text counts as empty and has no ids; decoding gives
the text back, but U+2581, the model's own mark for a space, comes back as a
space; repeated rows are encoded alike; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.llm.common import Memo, quoted, text_or_empty
from mnemolith.session import bounded_batches

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
#: Below the least piece score: what a character without a piece costs.
PENALTY = 10.0
#: Characters of a unit that is searched at once and remembered, at most.
SHORT = 64
NEVER = float("-inf")


@lru_cache(maxsize=2)
def codec_of(path: str) -> PieceCodec:
    """A worker keeps its codec, and what it knows, from task to task."""
    return PieceCodec(path)


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in every]
        self.byte = {int(self.pieces[i][3:-1], 16): i for i in every if model.is_byte(i)}
        self.raw = {i: bytes([b]) for b, i in self.byte.items()}
        self.unknown = model.unk_id()
        self.skip = {i for i in every if model.is_control(i)}
        self.score = {self.pieces[i]: (model.get_score(i), i) for i in every if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))}
        self.longest = max(map(len, self.score))
        # pieces by their characters in turn: (what may follow, score and id of the piece that ends here or None)
        self.tree: dict[str, tuple] = {}
        for p, (value, i) in sorted(self.score.items()):  # beginnings come first
            kids = self.tree
            for c in p[:-1]:
                kids = kids.setdefault(c, ({}, None, None))[0]
            kids[p[-1]] = ({}, value, i)
        self.bytes_of = [b"" if i in self.skip else self.raw.get(i, p.encode()) for i, p in enumerate(self.pieces)]
        self.floor = min(s for s, _ in self.score.values()) - PENALTY
        self.by_unit = not any(MARK in p.lstrip(MARK) for p in self.score)
        self.known = Memo()

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of a marked text, in runs as they are committed."""
        score, longest, n = self.score, self.longest, len(text)
        best = {0: 0.0}  # end -> score, for the ends that a piece may still start from
        back: dict[int, tuple[int, int]] = {}  # end -> (start, id), since the last commit
        done = 0
        for at in range(n):
            here = best.pop(at)
            for end in range(at + 1, min(n, at + longest) + 1):
                if found := score.get(text[at:end]):
                    value = here + found[0]
                    if end not in best or value > best[end]:
                        best[end], back[end] = value, (at, found[1])
            if text[at] not in score and (at + 1 not in best or here + self.floor > best[at + 1]):
                best[at + 1], back[at + 1] = here + self.floor, (at, self.unknown)
            if at + 1 < n and (len(best) == 1 or (at + 1) % longest == 0):
                # follow the survivors back until they are one
                alive = set(best)
                while len(alive) > 1:
                    last = max(alive)
                    alive.discard(last)
                    alive.add(back[last][0])
                meet = alive.pop()
                if meet > done:
                    yield self._path(text, back, done, meet)
                    back = {e: x for e, x in back.items() if e > meet}
                    done = meet
        if n > done:
            yield self._path(text, back, done, n)

    def short(self, text: str) -> list[int]:
        """Ids of a short marked text: the same search, with nothing to commit before its end."""
        tree, floor, n = self.tree, self.floor, len(text)
        best: list[float] = [0.0, *[NEVER] * n]
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        for at, here in enumerate(best):  # which is final when it is met
            kids, one = tree, False
            for end in range(at, n):
                node = kids.get(text[end])
                if node is None:  # no piece begins like this
                    break
                kids, score, i = node
                if score is not None:
                    one = one or end == at
                    if (value := here + score) > best[end + 1]:
                        best[end + 1], back[end + 1] = value, (at, i)
            if not one and at < n and here + floor > best[at + 1]:
                best[at + 1], back[at + 1] = here + floor, (at, self.unknown)
        return self._path(text, back, 0, n)

    def _path(self, text: str, back: dict[int, tuple[int, int]] | list[tuple[int, int]], first: int, end: int) -> list[int]:
        out: list[int] = []
        while end > first:
            start, i = back[end]
            if i == self.unknown and self.byte:
                out += [self.byte[b] for b in reversed(text[start:end].encode("utf-8", "surrogatepass"))]
            else:
                out.append(i)
            end = start
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if not self.by_unit:
            return [i for run in self.stream(marked) for i in run]
        known = self.known
        known.room()
        units = UNIT.findall(marked)
        new = [u for u in dict.fromkeys(units) if u not in known]
        known.learn((u, array("I", self.short(u) if len(u) <= SHORT else [i for run in self.stream(u) for i in run]).tobytes()) for u in new)
        ids = np.frombuffer(b"".join(map(known.__getitem__, units)), "<u4").tolist()
        for u in new:
            if len(u) > SHORT:
                known.forget(u)
        return ids

    def decode(self, ids: list[int]) -> str:
        marked = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        text = marked.replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, n_chars, best_pieces (their number), best_ids_crc32 (little-endian unsigned 32-bit ids), round_trip (decoding gives the text back); with ``keep_ids`` the ids too."""
    bounded_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = []
            for t in texts:
                ids = codec.encode(t)
                rows.append((len(t), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), codec.decode(ids) == t.replace(MARK, " "), *([ids] if keep_ids else [])))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()))
                yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["id", "n_chars", "best_pieces", "best_ids_crc32", "round_trip", "ids"][: 6 if keep_ids else 5])

    schema = "id long, n_chars long, best_pieces long, best_ids_crc32 long, round_trip boolean" + ", ids array<int>" * keep_ids
    return docs.select(F.col(quoted(id_col)).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(each, schema).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from a table with a column ids; null ids give the empty text."""
    bounded_batches(encoded.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([codec.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return encoded.select(F.col(quoted(id_col)).cast("long").alias("id"), "ids").mapInArrow(each, "id long, text string").withColumnRenamed("id", id_col)
