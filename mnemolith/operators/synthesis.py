"""Long sequences of an exact number of tokens: a question, its evidence far away, and other conversations in between.

Examples: (example_id, question, answer, evidence, conversation). What lies
between are the conversations of other examples that don't hold the answer,
read in one seeded order of all of them from a place of the target's own, as
often as needed, and cut to the exact length.

Reading on never compares every target with every conversation: a target takes
as many places of the order as its need is likely to take, meets them by their
numbers, and reads eight times as far only where too few were fit. An answer that
hardly a conversation is free of would make each of its targets read far: those
without it are listed once for all of them, and its targets read on in that list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolith.functions.hashing import seeded_order
from mnemolith.functions.text import token_span
from mnemolith.functions.tokens import Tokenizer, ids
from mnemolith.operators.lm_eval import global_offsets
from mnemolith.operators.prepare import fill_sizes, stratified_start, union_all
from mnemolith.session import bounded_batches, cut

#: The texts around a question, a conversation, a piece of memory.
TASK = "Use the conversation memory to answer the final question. Return only the answer.\n\n"
EARLIER = "Relevant earlier conversation:\n"
BETWEEN = ("\n\nIntervening conversation:\n", "\n")
MEMORY = ("\n\nMemory conversation:\n", "\n")
#: Bytes of a place that is asked for, beside its answer; and so many bytes of them that go to all tasks at most.
ROW, SMALL = 64, 4 << 20
#: How many times as far a target reads in its next stretch; so few answers are listed as soon as most are done; texts that show of most answers that there is a text without them.
WIDER, FEW, SHORTEST = 8, 256, 16


def ordered(texts: DataFrame, key: str, seed: int) -> tuple[DataFrame, int]:
    """Adds ``place``, from 0, in the seeded order of ``key``; and how many there are."""
    hashed = texts.withColumn("__o", F.concat(seeded_order(F.col(key), seed), F.lit(":"), F.col(key).cast("string")))
    out = cut(global_offsets(hashed, "__o", F.lit(1).cast("long")).withColumnRenamed("offset", "place").drop("__o"))
    return out, out.count()


def start_of(key: Column, n: int, seed: int) -> Column:
    """Where in an order of ``n`` a target begins."""
    return F.pmod(F.conv(F.substring(seeded_order(F.concat(F.lit("start:"), key.cast("string")), seed), 1, 12), 16, 10).cast("long"), F.lit(n))


def _sound(texts: DataFrame) -> DataFrame:
    return texts.where("text_id IS NOT NULL AND text IS NOT NULL AND size > 0").select("text_id", "text", F.xxhash64("text").alias("__h"), F.col("size").cast("long").alias("size"))


def _walk(left: DataFrame, order: DataFrame, fits: Callable[[DataFrame, int], DataFrame], far: Callable[[DataFrame, int], DataFrame | None]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Targets (target_id, answer, need) read on in ``order`` (place, text_id, size), stretch by stretch, each from ``begin`` of the ``of`` places that follow ``base``.

    Gives the texts (target_id, text_id, k, size) that ``fits`` leaves of what was asked, and the targets that ``far`` takes out after a round.
    """
    found, out, rounds = [], [], 0
    left = cut(left.withColumns({"from": F.lit(0).cast("long"), "got": F.lit(0).cast("long")}))
    while left.limit(1).count():
        likely = F.ceil(F.col("need") / F.col("mean") * 1.25) + 1
        spans = left.withColumn("till", F.least("of", F.when(F.col("from") == 0, likely).otherwise(F.col("from") * WIDER)))
        bytes_ = spans.agg(F.sum((F.col("till") - F.col("from")) * (F.octet_length("answer") + ROW))).first()[0]
        places = spans.select("target_id", "answer", "begin", "base", "of", F.explode(F.sequence("from", F.col("till") - 1)).alias("k"))
        places = places.select("target_id", "answer", "k", (F.col("base") + (F.col("begin") + F.col("k")) % F.col("of")).alias("place"))
        asked = places.join(order, "place").where(F.col("text_id").cast("string") != F.col("target_id").cast("string"))
        found.append(fit := cut(fits(asked, bytes_).select("target_id", "text_id", "k", "size")))
        more = fit.groupBy("target_id").agg(F.sum("size").alias("more"))
        left = spans.join(more, "target_id", "left").withColumns({"from": F.col("till"), "got": F.col("got") + F.coalesce("more", F.lit(0))})
        left, rounds = cut(left.where((F.col("got") < F.col("need")) & (F.col("from") < F.col("of"))).drop("till", "more")), rounds + 1
        if (gone := far(left, rounds)) is not None:
            out.append(gone := cut(gone.select("target_id", "answer")))
            left = cut(left.join(gone.select("answer").distinct(), "answer", "left_anti"))
    return found, out


def _lists(answers: DataFrame, sound: DataFrame, pool: DataFrame) -> DataFrame:
    """(answer, place, text_id, size) of all places whose texts don't hold the answer: the answers go to the texts, which stay where they are."""
    lower = sound.select("text_id", "__h", F.lower("text").alias("text"))
    free = lower.join(F.broadcast(answers), ~F.contains("text", F.col("answer"))).select("answer", "text_id", "__h")
    return cut(free.join(pool, ["text_id", "__h"]).select("answer", "place", "text_id", "size"))


def _begun(targets: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists of all answers end to end as one order (place, text_id, size), and for each target where its own answer's list begins, how long it is, and where in it the target begins."""
    rows = lists.select("answer", "place", F.lit(1).alias("listed"), "text_id", "size")
    asks = targets.select("answer", F.col("begin").alias("place"), F.lit(0).alias("listed"), "target_id", "need")
    # a target stands before what is listed at its own place, so its offset is that of the first text it reads
    both = rows.unionByName(asks, allowMissingColumns=True).withColumn("__o", F.struct("answer", "place", "listed"))
    both = cut(global_offsets(both, "__o", F.col("listed").cast("long")).drop("__o"))
    order = both.where("listed = 1").select("answer", F.col("offset").alias("place"), "text_id", "size")
    whole = order.groupBy("answer").agg(F.min("place").alias("base"), F.count("*").alias("of"), F.avg("size").alias("mean"))
    begun = both.where("listed = 0").select("target_id", "answer", "need", "offset").join(F.broadcast(whole), "answer")
    return order.drop("answer"), begun.withColumn("begin", F.col("offset") - F.col("base")).drop("offset")


def read_on(targets: DataFrame, texts: DataFrame, seed: int = 0) -> DataFrame:
    """(target_id, text_id, rank, size): for each target (target_id, answer, need), texts (text_id, text, size) in order until their sizes reach its need.

    A target's own id and texts that hold its answer (compared in lower case) aren't taken; nor are nulls. If all of the order
    isn't enough, all that is fit comes once. Only ids, hashes and sizes are put in order; a text is read where a place of it is
    asked for: it stays where it is if what is asked takes few bytes, else it moves once for each stretch. Of answers that most
    texts hold, the texts without them are listed once, and all targets of such an answer read on in its list.
    """
    sound = _sound(texts)
    pool, n = ordered(sound.select("text_id", "__h", "size"), "text_id", seed)
    if not n:
        return targets.join(texts.select("text_id", F.col("size").cast("long").alias("size")), F.lit(False)).select("target_id", "text_id", F.lit(0).alias("rank"), "size")
    if pool.groupBy("text_id", "__h").count().where("count > 1").limit(1).count():  # equal rows have a place each, but one text
        sound = sound.dropDuplicates(["text_id", "__h"])
    sound = sound.select("text_id", "__h", "text")
    mean = float(pool.agg(F.avg("size")).first()[0])
    wanted = targets.where("target_id IS NOT NULL AND answer IS NOT NULL AND need > 0").select("target_id", F.lower("answer").alias("answer"), F.col("need").cast("long").alias("need"))
    wanted = cut(wanted.withColumn("begin", start_of(F.col("target_id"), n, seed)))
    key = ["text_id", "__h"]

    def free(asked: DataFrame, bytes_: int) -> DataFrame:
        if bytes_ <= SMALL:
            return sound.join(asked.hint("broadcast"), key).where(~F.contains(F.lower("text"), F.col("answer")))
        return sound.withColumn("text", F.lower("text")).join(asked, key).where(~F.contains("text", F.col("answer")))

    def costly(left: DataFrame, rounds: int) -> DataFrame | None:
        """Targets of answers whose next stretches have more than an eighth of all places; of all answers, if few are left when ten times what is likely has been read."""
        each = left.groupBy("answer").agg(F.sum(F.least("of", F.col("from") * WIDER) - F.col("from")).alias("next"))
        every, many = each.agg(F.count("*"), F.count_if(F.col("next") * 8 >= n)).first()
        if rounds > 1 and 0 < every <= FEW:
            return left
        return left.join(each.where(F.col("next") * 8 >= n), "answer", "left_semi") if many else None

    found, hard = _walk(wanted.withColumns({"base": F.lit(0).cast("long"), "of": F.lit(n).cast("long"), "mean": F.lit(mean)}), pool, free, costly)
    if hard:
        ids_ = union_all(hard)
        lists = _lists(ids_.select("answer").distinct(), sound, pool)
        order, begun = _begun(wanted.join(ids_.select("target_id").distinct(), "target_id", "left_semi"), lists)
        found = [x.join(ids_.select("target_id").distinct(), "target_id", "left_anti") for x in found]
        found += _walk(begun, order, lambda asked, _: asked, lambda left, _: None)[0]
    if not found:
        return read_on(targets, texts.where("false"), seed)
    w = Window.partitionBy("target_id").orderBy("k")
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = union_all(found).withColumns({"rank": F.row_number().over(w), "before": before}).join(targets.select("target_id", "need"), "target_id")
    return ranked.where(F.col("before") < F.col("need")).select("target_id", "text_id", "rank", "size")


def answerable(targets: DataFrame, texts: DataFrame) -> DataFrame:
    """The targets (target_id, answer) for which ``read_on`` finds a text at all.

    A few of the shortest texts show it of most answers; only the answers that all but one of those hold go to all texts.
    """
    lower = _sound(texts).select(F.col("text_id").cast("string").alias("text_id"), F.lower("text").alias("text"))
    named = targets.where("target_id IS NOT NULL AND answer IS NOT NULL").withColumn("__a", F.lower("answer"))
    ends = [F.min("text_id").alias("least"), F.max("text_id").alias("most")]
    short = lower.orderBy(F.octet_length("text"), "text_id").limit(SHORTEST)
    seen = cut(named.select("__a").distinct().join(F.broadcast(short), ~F.contains("text", F.col("__a")), "left").groupBy("__a").agg(*ends))
    clear = F.coalesce(F.col("least") != F.col("most"), F.lit(False))
    rest = lower.join(F.broadcast(seen.where(~clear).select("__a")), ~F.contains("text", F.col("__a"))).groupBy("__a").agg(*ends)
    own = F.col("target_id").cast("string")
    return named.join(seen.where(clear).unionByName(rest), "__a").where((F.col("least") != own) | (F.col("most") != own)).drop("__a", "least", "most")


def _takes(needs: DataFrame, pool: DataFrame, seed: int) -> DataFrame:
    """(target_id, round, rank, text_id, take): how many tokens of which pieces (text_id, text, size) make exactly ``need`` of each target (target_id, answer, need)."""
    near = read_on(needs, pool, seed).join(needs.select("target_id", "need"), "target_id")
    return fill_sizes(near.select(F.col("target_id").alias("key"), "rank", "text_id", F.col("size").alias("n"), "need"), F.col("need"), "text_id").withColumnRenamed("key", "target_id")


def _filled(sides: list[DataFrame], pieces: DataFrame) -> DataFrame:
    """(target_id, tokens_0, tokens_1, ..., texts): what each of the sides takes of the pieces (text_id, token_ids), whose tokens move to their targets once."""
    takes = union_all([x.withColumn("side", F.lit(i)) for i, x in enumerate(sides)])
    part = F.struct("side", "round", "rank", F.expr("slice(token_ids, 1, take)").alias("t"))
    # a sequence's own pieces, of exactly ``need`` tokens a side
    whole = takes.join(pieces, "text_id").groupBy("target_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    of = lambda i: F.flatten(F.transform(F.filter("parts", lambda x: x["side"] == i), lambda x: x["t"])).alias(f"tokens_{i}")
    return whole.select("target_id", *[of(i) for i in range(len(sides))], F.size("parts").alias("texts"))


def long_sequences(examples: DataFrame, make: Tokenizer, length: int, count: int | None = None, placement: str = "fixed_start", bins: int = 4, block: int = 64, local: int = 256, most_answer: int = 64, horizon: int = 16, end_id: int = 1, seed: int = 13) -> DataFrame:
    """Sequences of exactly ``length`` tokens, one for each example that fits (the first ``count`` by seeded order, or all).

    ``fixed_start``: the evidence stands in the prompt before the other conversations. ``stratified``: it is one piece of memory
    among others, begins at a block's start, in the next one of ``bins`` equal ranges of places, and ends before the last
    ``local`` tokens. An example doesn't fit if its answer is empty or too long, nothing remains for other conversations, none is
    free of the answer, or it has fewer places than bins. The answer's tokens and one ``end_id`` come last.
    """
    if placement not in ("fixed_start", "stratified"):
        raise ValueError("placement must be fixed_start or stratified")
    fixed = placement == "fixed_start"
    asked = F.concat(F.lit("Question: "), F.col("question"))
    head = F.concat(F.lit(TASK), *([F.lit(EARLIER), F.col("evidence"), F.lit("\n\n")] if fixed else []))
    wrap = BETWEEN if fixed else MEMORY
    around = lambda c: F.concat(F.lit(wrap[0]), F.col(c), F.lit(wrap[1]))
    bounded_batches(examples.sparkSession)
    p = examples.select("example_id", "answer", "conversation", "evidence", F.char_length(head).alias("q0"), F.char_length(asked).alias("qn"), F.concat(head, asked, F.lit("\n")).alias("prompt"))
    p = p.withColumns({"p": make(F.col("prompt")), "a": ids(make(F.col("answer"))), "piece": ids(make(around("conversation"))), "chunk": make(around("evidence"))})
    p = p.withColumn("q", token_span(F.col("p"), F.col("q0"), F.col("q0") + F.col("qn")))
    e0 = F.lit(len(TASK) + len(EARLIER)) if fixed else F.lit(len(MEMORY[0]))
    p = p.withColumn("e", token_span(F.col("p") if fixed else F.col("chunk"), e0, e0 + F.char_length("evidence")))
    p = cut(p.select("example_id", "answer", "conversation", ids(F.col("p")).alias("p"), "a", "piece", ids(F.col("chunk")).alias("chunk"), "q", "e"))
    pool = p.select(F.col("example_id").alias("text_id"), F.col("conversation").alias("text"), F.size("piece").alias("size"))
    pieces = p.select(F.col("example_id").alias("text_id"), F.col("piece").alias("token_ids"))
    prompt_end = length - F.size("a") - 1
    p = p.drop("conversation", "piece").withColumns({"prompt_end": prompt_end, "memory": prompt_end - F.size("p"), "own": F.lit(0) if fixed else F.size("chunk")})
    fit = p.where((F.size("a") > 0) & (F.size("a") <= most_answer) & (F.col("memory") > F.col("own")) & F.col("e.first").isNotNull())
    if not fixed:  # enough places for all bins
        latest = F.floor((F.col("prompt_end") - 1 - local) / block) * block
        first = F.ceil(F.col("q.first") / block) * block
        fit = fit.withColumn("latest", latest).where(F.floor((latest - F.size("chunk") - first) / block) + 1 >= bins)
    # before the numbers are dealt: is there a conversation without the answer at all
    able = answerable(fit.select(F.col("example_id").alias("target_id"), "answer"), pool).select(F.col("target_id").alias("example_id"))
    dealt, _ = ordered(able if count is None else able.orderBy(seeded_order(F.col("example_id"), seed), "example_id").limit(count), "example_id", seed)
    fit = fit.join(dealt, "example_id")
    if fixed:
        needs = cut(fit.select(F.col("example_id").alias("target_id"), "answer", F.col("memory").alias("need")))
        filled = _filled([_takes(needs, pool, seed)], pieces).withColumnsRenamed({"target_id": "example_id", "tokens_0": "tokens"})
        done = fit.join(filled, "example_id").withColumns({"before": F.col("memory"), "chunk_start": F.lit(None).cast("long"), "bin": F.lit(None).cast("long"), "tokens_after": F.array().cast("array<int>")})
        evidence = [F.col("e.first"), F.col("e.end")]
    else:
        bin_ = F.col("place") % bins
        fit = fit.withColumns({"bin": bin_, "chunk_start": stratified_start(F.col("q.first"), F.size("chunk"), F.col("latest"), block, bins, bin_, F.col("example_id"), seed)})
        fit = cut(fit.withColumn("before", F.col("chunk_start") - F.col("q.first")).withColumn("after", F.col("memory") - F.col("before") - F.size("chunk")).where("after >= 0"))
        needs = {side: fit.select(F.col("example_id").alias("target_id"), "answer", F.col(side).alias("need")).where("need > 0") for side in ("before", "after")}
        filled = _filled([_takes(needs[side], pool, seed + extra) for side, extra in (("before", 1), ("after", 2))], pieces)
        none = F.array().cast("array<int>")
        done = fit.join(filled.withColumnRenamed("target_id", "example_id"), "example_id", "left")
        done = done.withColumns({"tokens": F.coalesce("tokens_0", none), "tokens_after": F.coalesce("tokens_1", none), "texts": F.coalesce("texts", F.lit(0))})
        evidence = [F.col("chunk_start") + F.col("e.first"), F.col("chunk_start") + F.col("e.end")]
    split_at = F.col("q.first")
    own = F.array().cast("array<int>") if fixed else F.col("chunk")
    tokens = F.concat(F.slice("p", F.lit(1), split_at), "tokens", own, "tokens_after", F.slice("p", split_at + 1, F.size("p")), "a", F.array(F.lit(end_id)))
    size = F.size("a")
    return done.select(
        "example_id", F.col("place").alias("sequence_index"), tokens.alias("token_ids"), F.col("prompt_end").cast("long").alias("answer_start"), (F.col("prompt_end") + size).cast("long").alias("answer_end"),
        evidence[0].cast("long").alias("evidence_start"), evidence[1].cast("long").alias("evidence_end"), (F.col("q.first") + F.col("memory")).cast("long").alias("question_start"), (F.col("q.end") + F.col("memory")).cast("long").alias("question_end"),
        F.col("q.first").cast("long").alias("memory_start"), "chunk_start", F.when(F.col("chunk_start").isNotNull(), F.col("chunk_start") + F.size("chunk")).cast("long").alias("chunk_end"), F.col("bin").cast("long").alias("bin"),
        (F.size("tokens") + F.size("tokens_after")).cast("long").alias("distractor_tokens"), F.col("texts").cast("long").alias("distractor_texts"), (F.col("prompt_end") - evidence[1]).cast("long").alias("distance"),
        (F.col("prompt_end") - 2).cast("long").alias("retrieval_position"), F.least(F.lit(horizon), size).cast("long").alias("future_horizon"),
    )
