"""Tokenizers by name: each makes of a text column an array of (id, start, end), with character offsets.

``blank`` (runs of what isn't white space; an id is 28 bits of the word's MD5)
and ``file:PATH`` (a tokenizers file) run in Arrow batches; ``chars`` (an id is
10 more than the code point) stays in the JVM. Another one is a function from a
column to such an array, added by ``register``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolith.session import bounded_batches, cut

Tokenizer = Callable[[Column], Column]
PIECES = "array<struct<id:int,start:int,end:int>>"
#: What a role's line looks like where no model's template is given.
TURN = "{role}: {content}"
#: A word: the white space that parts words is that of Java's \s.
WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
#: Characters of texts that are cut into words at once, words of a run, and the ids that a worker keeps.
CHUNK, RUN, MOST_KNOWN = 1 << 20, 1 << 16, 1 << 18
KNOWN: dict[str, int] = {}


def word_ids(words: list[str]) -> np.ndarray:
    """The words' ids; a worker keeps those that it has met until there are too many."""
    new = set(words).difference(KNOWN)
    if len(KNOWN) + len(new) > MOST_KNOWN:
        KNOWN.clear()
        new = set(words)
    for w in new:
        KNOWN[w] = int.from_bytes(hashlib.md5(w.encode("utf-8", "surrogatepass")).digest()[:4], "big") >> 4
    return np.fromiter(map(KNOWN.__getitem__, words), np.int32, len(words))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, starts and ends of all words of the texts, and how many each text has: what is white space is found in all texts at once."""
    text = "\n".join(texts)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = (points != 32) & ((points < 9) | (points > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    sizes = np.diff(np.searchsorted(starts, begins))
    # the words themselves are objects only for a run at a time
    found = [word_ids(WORD.findall(text, int(starts[i]), int(ends[i : i + RUN][-1]))) for i in range(0, len(starts), RUN)]
    before = np.repeat(begins[:-1], sizes)
    return np.concatenate([np.empty(0, np.int32), *found]), (starts - before).astype(np.int32), (ends - before).astype(np.int32), sizes


def blank(text: Column) -> Column:
    """Words with their offsets; one pass over a text, however long it is."""

    @F.arrow_udf(PIECES)
    def words(texts: pa.Array) -> pa.Array:
        each, chunk, chars_ = [], [], 0
        for t in texts.to_pylist():
            chunk.append(t or "")
            if (chars_ := chars_ + len(chunk[-1])) > CHUNK:
                each.append(words_of(chunk))
                chunk, chars_ = [], 0
        each.append(words_of(chunk))
        *columns, sizes = (np.concatenate(x) for x in zip(*each))
        ends = np.cumsum([0, *sizes])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in columns], names=["id", "start", "end"]), mask=texts.is_null())

    return words(text)


def chars(text: Column) -> Column:
    each = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(each, lambda c, i: F.struct((F.ascii(c) + 10).alias("id"), i.alias("start"), (i + 1).alias("end")))


def from_file(path: str) -> Tokenizer:
    @F.pandas_udf(PIECES)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer as Library

        model = Library.from_file(path)
        for texts in batches:
            found = model.encode_batch(texts.tolist(), add_special_tokens=False)
            yield pd.Series([[{"id": i, "start": a, "end": b} for i, (a, b) in zip(e.ids, e.offsets)] for e in found])

    return lambda text: pieces(F.coalesce(text, F.lit("")))


REGISTRY: dict[str, Tokenizer] = {"blank": blank, "chars": chars}


def register(name: str, tokenizer: Tokenizer) -> None:
    REGISTRY[name] = tokenizer


def tokenizer(name: str) -> Tokenizer:
    if name.startswith("file:"):
        return from_file(name.removeprefix("file:"))
    if name not in REGISTRY:
        raise KeyError(f"no tokenizer {name!r}; there are {sorted(REGISTRY)} and file:PATH")
    return REGISTRY[name]


def ids(pieces: Column) -> Column:
    return F.transform(pieces, lambda p: p["id"])


def rendered(messages: Column) -> Column:
    """Messages (role, content) as lines."""
    role, content = TURN.split("{role}")[1].split("{content}")[0], TURN.split("{content}")[1]
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(role), m["content"], F.lit(content))), "\n")


def load_sequences(rows: DataFrame, make: Tokenizer, most_tokens: int | None = None) -> DataFrame:
    """(sequence_id, token_ids, metadata) of rows with token_ids, messages or text, the first that is there and not null.

    Every row is tokenised once and cut at ``most_tokens``; ``metadata`` is JSON of all other columns and of
    ``tokenization_source``. A row that has none of the three, a table without rows, and ids that aren't distinct are errors.
    """
    bounded_batches(rows.sparkSession)
    has = lambda c: F.col(c).isNotNull() if c in rows.columns else F.lit(False)
    column = lambda c, f, kind: f(F.col(c)) if c in rows.columns else F.lit(None).cast(kind)
    given = F.when(has("token_ids"), "provided_token_ids").when(has("messages"), "chat_template").when(has("text"), "text")
    text = F.when(has("messages"), column("messages", rendered, "string")).otherwise(column("text", lambda c: c, "string"))
    provided = column("token_ids", lambda c: c.cast("array<int>"), "array<int>")
    none = F.raise_error(F.concat(F.lit("no token_ids, messages or text in row "), F.coalesce(F.col("sequence_id").cast("string"), F.lit("without id"))))
    made = rows.withColumn("tokenization_source", F.coalesce(given, none.cast("string")))
    tokens = F.when(has("token_ids"), provided).otherwise(ids(make(F.when(~has("token_ids"), text))))
    rest = [c for c in made.columns if c not in ("sequence_id", "token_ids", "messages", "text")]
    out = made.select(F.col("sequence_id").cast("string").alias("sequence_id"), (F.slice(tokens, 1, most_tokens) if most_tokens else tokens).alias("token_ids"), F.to_json(F.struct(*rest)).alias("metadata"))
    out = cut(out)
    twice = out.groupBy("sequence_id").count().where("count > 1").orderBy("sequence_id").limit(1).collect()
    if twice:
        raise ValueError(f"sequence_id {twice[0].sequence_id} comes {twice[0]['count']} times")
    if not out.limit(1).count():
        raise ValueError("no sequences")
    return out
