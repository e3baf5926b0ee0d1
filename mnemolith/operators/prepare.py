"""Corpora into articles, conversations, prompts and sequences of exact length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolith.functions.hashing import row_split, seeded_order
from mnemolith.functions.text import capitalised, heading, short_sha1, turn_order

# The synthetic facts' entities and colours, and the notes put before them.
ENTITIES = ("Alice", "Ben", "Carla", "Dev", "Eve", "Finn", "Gina", "Hana", "Ivan", "Jules", "Kira", "Liam")
COLORS = ("blue", "green", "red", "yellow", "purple", "silver", "orange", "white", "black", "teal", "pink", "gold")
NOTES = (
    "",
    "Irrelevant note: the meeting starts at 9 and the ticket is X4.",
    "Archive: Nina's color is blue. Omar's color is green. Ignore archive entries unless named.",
)

# The canonical question, and the templates of prompts.
CANONICAL = "Task: recall_fact\nEntity: {e}\nAttribute: color\nPolicy: current\nQuestion: Return the value only."

#: condition, task, prompt id, fact's value, answer, prompt without and with its canonical form; {e} entity, {v} value, {o} another value, {q} the question.
TEMPLATES = (
    ("same_entity_different_value", "recall_color", "different_value", "o", "{o}", "Fact: {e}'s color is {o}.\n{q}"),
    ("different_task_same_target", "verify_color", "verify", "v", "yes", "Fact: {e}'s color is {v}.\nQuestion: Is {e}'s color {v}? Answer yes or no."),
    ("conflict_latest", "latest_color", "conflict", "o", "{o}", "Earlier: {e}'s color is {v}.\nLater: {e}'s color is {o}.\nQuestion: What is {e}'s latest color? Return only the color."),
)


def _filled(template: Column) -> Column:
    for mark, value in (("{q}", "question"), ("{e}", "entity"), ("{v}", "first_value"), ("{o}", "other_value")):
        template = F.replace(template, F.lit(mark), F.col(value))
    return template


def synthetic_prompts(spark: SparkSession, max_facts: int = 12, modes: tuple[str, ...] = ("natural", "canonical"), seed: int = 13) -> DataFrame:
    """Facts by modes by seven templates, in seeded order: three notes, absent, another value, verify, conflict."""
    n = len(COLORS)
    facts = spark.createDataFrame([(i, e, c, COLORS[(i + 3) % n]) for i, (e, c) in enumerate(list(zip(ENTITIES, COLORS))[:max_facts])], "fact int, entity string, first_value string, other_value string")
    mode = spark.createDataFrame([(m,) for m in modes], "mode string")
    rows = [(f"noise_{k}", "recall_color", f"noise_{{i}}_{k}", "v", "{v}", f"{note}\nFact: {{e}}'s color is {{v}}.\n{{q}}".strip(), True, False) for k, note in enumerate(NOTES)]
    rows.append(("absent", "absent_color", "absent_{i}", "v", "unknown", "{absent}", False, False))
    rows += [(c, t, f"{p}_{{i}}", w, a, x, True, c == "conflict_latest") for c, t, p, w, a, x in TEMPLATES]
    templates = spark.createDataFrame(rows, "condition_id string, task_id string, name string, which string, answer_template string, template string, has_fact boolean, conflict boolean")
    grid = facts.crossJoin(mode).crossJoin(templates)
    canonical = F.replace(F.lit(CANONICAL), F.lit("{e}"), F.col("entity"))
    plain = F.concat(F.lit("What is "), "entity", F.lit("'s color? Return only the color."))
    grid = grid.withColumn("question", F.when(F.col("mode") == "canonical", canonical).otherwise(plain))
    absent = F.when(F.col("mode") == "canonical", canonical).otherwise(F.concat(F.lit("No color is given for "), "entity", F.lit(". "), plain))
    value = F.when(F.col("which") == "o", F.col("other_value")).otherwise(F.col("first_value"))
    out = grid.select(
        F.concat("mode", F.lit("_"), F.replace("name", F.lit("{i}"), F.col("fact").cast("string"))).alias("prompt_id"), "task_id", F.concat(F.lower("entity"), F.lit("_color_"), value).alias("target_fact_id"), "condition_id", "mode", "entity", F.lit("color").alias("attribute"),
        value.alias("value"), _filled(F.col("answer_template")).alias("answer"), "has_fact", "conflict", F.when(F.col("template") == "{absent}", absent).otherwise(_filled(F.col("template"))).alias("prompt"),
    )
    return out.orderBy(seeded_order(F.col("prompt_id"), seed), "prompt_id")


def condition_plan(spark: SparkSession, gaps: tuple[int, ...], shifts: tuple[int, ...], control_gap: int) -> DataFrame:
    """One row for each gap from position 0, then one for each shift with the control gap."""
    if control_gap < 0:
        raise ValueError("control_gap must not be negative")
    rows = [("distance_sweep", 0, g) for g in gaps] + [("joint_shift_control", s, control_gap) for s in shifts]
    return spark.createDataFrame(rows, "condition string, history_start_position long, requested_gap long")


def articles(lines: DataFrame, source: str = "source") -> DataFrame:
    """(source, article_index, title, text) from ordered lines (source, row, line): from each level-one heading to the next.

    Lines before a source's first heading are dropped.
    """
    w = Window.partitionBy(source).orderBy("row")
    title = heading(F.col("line"))
    numbered = lines.withColumn("title", title).withColumn("article_index", F.sum(F.when(F.col("title").isNotNull(), 1).otherwise(0)).over(w) - 1).where("article_index >= 0")
    parts = F.sort_array(F.collect_list(F.struct("row", "line")))
    return numbered.groupBy(source, "article_index").agg(F.max("title").alias("title"), F.array_join(F.transform(parts, lambda p: p["line"]), "").alias("text"))


def exact_sequences(texts: DataFrame, tokens: Column, length: int, most: int, order: str, stride: int = 1, seed: int = 0) -> DataFrame:
    """The first ``most`` rows by ``order`` with ``length`` tokens, cut to that; of every ``stride`` the same one by seed. Too few is an error."""
    long = texts.where(F.pmod(F.col(order), F.lit(stride)) == seed % stride).withColumn("token_ids", tokens).where(F.size("token_ids") >= length)
    first = long.orderBy(order).limit(most).withColumn("token_ids", F.slice("token_ids", 1, length))
    got = first.count()
    if got < most:
        raise ValueError(f"only {got} of {most} sequences have {length} tokens")
    return first


def clean_messages(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) of known roles with content; role and text trimmed."""
    role, text = F.lower(F.trim("role")), F.trim("text")
    return messages.withColumns({"role": role, "text": text}).where(F.col("role").isin("system", "user", "assistant") & (F.col("text") != ""))


def long_conversations(messages: DataFrame, split: str, min_turns: int, seed: int = 13) -> DataFrame:
    """(conv_id, split, messages, n_messages, text): conversations of a split with so many turns (pairs of messages)."""
    clean = clean_messages(messages)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))), lambda m: m["line"]), "\n")
    conv = clean.groupBy("conv_id").agg(F.count("*").alias("n_messages"), joined.alias("text"))
    return conv.withColumn("split", row_split(F.col("conv_id"), seed)).where((F.col("split") == split) & (F.floor(F.col("n_messages") / 2) >= min_turns))


def evidence_window(messages: Column, evidence: Column, most: int) -> Column:
    """Slice of a message array around those that hold an evidence text, widened on both sides to ``most``, inside the array."""
    at = F.filter(F.transform(messages, lambda m, i: F.when(F.exists(evidence, lambda e: F.contains(m, e)), i)), lambda i: i.isNotNull())
    n, first, last = F.size(messages), F.coalesce(F.array_min(at), F.lit(0)), F.coalesce(F.array_max(at), F.size(messages) - 1)
    spare = F.greatest(F.lit(0), most - (last - first + 1))
    start = F.greatest(F.lit(0), F.least(first - F.floor(spare / 2).cast("int"), n - most))
    return F.slice(messages, start + 1, F.lit(most))


def evidence_prompts(qa: DataFrame, turns: DataFrame, recent: int = 24, noise: int = 6) -> DataFrame:
    """Three prompts for each question: its evidence alone, the turns up to it, and late distractors before it.

    qa: (index, user_name, conversation_id, question, answer, evidence_turn_ids); turns: (user_name, turn_id, role, content).
    """
    asked = qa.where(F.size("evidence_turn_ids") > 0)
    said = F.concat(capitalised(F.col("role")), F.lit(": "), F.col("content"))
    each = asked.select("index", "user_name", "evidence_turn_ids").join(turns.select("user_name", "turn_id", turn_order(F.col("turn_id")).alias("o"), said.alias("line")), "user_name")
    each = each.withColumn("rank", F.array_position("evidence_turn_ids", F.col("turn_id")))
    latest = F.max(F.when(F.col("rank") > 0, F.col("o"))).over(Window.partitionBy("index"))
    each = each.withColumn("latest", latest).where("latest IS NOT NULL")
    late = Window.partitionBy("index").orderBy(F.desc("o"), F.desc("turn_id"))
    each = each.withColumns({"before": F.row_number().over(Window.partitionBy("index", F.col("o") <= F.col("latest")).orderBy(F.desc("o"), F.desc("turn_id"))), "other": F.sum(F.when(F.col("rank") == 0, 1).otherwise(0)).over(late)})

    def joined(keep: Column, *order: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct(*order, "line")))), lambda x: x["line"]), "\n")

    own, far = F.col("rank") > 0, (F.col("rank") == 0) & (F.col("other") <= noise)
    context = each.groupBy("index").agg(
        joined(own, F.col("rank").alias("k")).alias("evidence_only"),
        joined((F.col("o") <= F.col("latest")) & (F.col("before") <= recent), F.col("o").alias("k"), F.col("turn_id").alias("t")).alias("recent_context"),
        joined(own | far, own.alias("e"), F.when(own, F.col("rank")).otherwise(0).alias("k"), F.col("o").alias("oo"), F.col("turn_id").alias("t")).alias("noisy_context"),
    )
    rows = asked.join(context, "index").selectExpr("*", "stack(3, 'evidence_only', evidence_only, 'recent_context', recent_context, 'noisy_context', noisy_context) AS (condition_id, context)")
    question, answer = F.trim("question"), F.trim("answer")
    return rows.select(
        F.format_string("lufy_%04d_%s", F.col("index"), F.col("condition_id")).alias("prompt_id"), F.lit("lufy_shift").alias("suite"), F.concat_ws("_", "user_name", "conversation_id", F.array_join("evidence_turn_ids", "_"), short_sha1(F.col("answer"))).alias("target_fact_id"),
        "condition_id", F.col("user_name").alias("entity"), answer.alias("answer"), F.concat(F.lit("Conversation evidence:\n"), "context", F.lit("\n\nMemory request: "), question, F.lit("\nQuestion: "), question).alias("prompt"),
    )


def keep_first(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def fill_exactly(pieces: DataFrame, budget: Column) -> DataFrame:
    """Of ordered pieces (key, rank, token_ids), repeated in turn as often as needed, exactly ``budget`` tokens: (key, round, rank, take)."""
    return fill_sizes(pieces.withColumn("n", F.size("token_ids")), budget)


def fill_sizes(pieces: DataFrame, budget: Column, *keep: str) -> DataFrame:
    """``fill_exactly`` by the pieces' sizes (key, rank, n), whose tokens may be elsewhere; columns to ``keep`` come last."""
    sized = pieces.withColumn("all", F.sum("n").over(Window.partitionBy("key"))).where("n > 0")
    rounds = sized.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((budget - 1) / F.col("all")))))
    before = F.col("round") * F.col("all") + F.coalesce(F.sum("n").over(Window.partitionBy("key", "round").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rounds.withColumn("take", F.least(F.col("n"), budget - before)).where("take > 0").select("key", "round", "rank", F.col("take").cast("int").alias("take"), *keep)


def stratified_start(insertion: Column, target: Column, latest_end: Column, block: int, bins: int, bin_index: Column, key: Column, seed: int) -> Column:
    """A block-aligned start for a target, in one of equal bins of those possible, drawn by hash; null if there are fewer starts than bins."""
    first = F.floor((insertion + block - 1) / block) * block
    n = F.floor((latest_end - target - first) / block) + 1
    low, high = F.floor(n * bin_index / bins), F.floor(n * (bin_index + 1) / bins)
    drawn = low + F.pmod(F.conv(F.substring(seeded_order(key, seed), 1, 12), 16, 10).cast("long"), high - low)
    return F.when(n >= bins, first + drawn * block).cast("long")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def key_faults(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, fault): keys that are missing and keys that weren't expected."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return union_all([a.join(b, key, "left_anti").withColumn("fault", F.lit("missing")), b.join(a, key, "left_anti").withColumn("fault", F.lit("unexpected"))])


def with_whole_evidence(qa: DataFrame, turns: DataFrame, key: str = "index") -> DataFrame:
    """Questions all of whose evidence turns are there; qa: (index, user_name, evidence_turn_ids), turns: (user_name, turn_id)."""
    each = qa.select(key, "user_name", F.explode("evidence_turn_ids").alias("turn_id"))
    lacking = each.join(turns, ["user_name", "turn_id"], "left_anti").select(key).distinct()
    return qa.where(F.size("evidence_turn_ids") > 0).join(lacking, key, "left_anti")


def paired_rows(rows: DataFrame, most: int) -> DataFrame:
    """Of facts with both a fact_reference and a question_query, the first ``most`` by id: both rows, and the query's as history_answer with its history prompt. Too few is an error."""
    both = rows.where(F.col("condition_id").isin("fact_reference", "question_query"))
    whole = both.groupBy("target_fact_id").agg(F.count_distinct("condition_id").alias("n")).where("n = 2").orderBy("target_fact_id").limit(most).select("target_fact_id")
    if (got := whole.count()) < most:
        raise ValueError(f"only {got} of {most} facts have both rows")
    kept = both.join(F.broadcast(whole), "target_fact_id", "left_semi")
    history = kept.where("condition_id = 'question_query'").withColumns({"prompt_id": F.replace("prompt_id", F.lit("question_query"), F.lit("history_answer")), "condition_id": F.lit("history_answer"), "prompt": F.col("history_prompt")})
    return kept.unionByName(history)


def prompt_faults(rows: DataFrame, suite: str = "convomem_query_to_fact", needed: tuple[str, ...] = ("fact_reference", "question_query")) -> DataFrame:
    """(prompt_id, fault) of rows that a prompt-free search can't take; a condition that no row has is a fault without a prompt."""
    tests = {"suite": F.col("suite") != suite, "instructed": F.coalesce("knowledge_prompt", F.lit(False))}
    bad = rows.withColumn("fault", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()])))).select("prompt_id", "fault")
    there = rows.agg(F.collect_set(F.when(F.col("condition_id").isin(*needed), F.col("condition_id"))).alias("c"))
    lacking = there.select(F.lit(None).cast("string").alias("prompt_id"), F.explode(F.array_except(F.lit(list(needed)), "c")).alias("fault"))
    return bad.unionByName(lacking)


def corpus_tokens(docs: DataFrame, most: int, bos: str = "<bos>", eos: str = "<eos>") -> DataFrame:
    """(position, token) of texts (offset, tokens) laid end to end behind one ``bos``, an ``eos`` after each, cut at ``most`` tokens.

    ``offset`` counts each text before and its end; a text beyond the cut makes no row.
    """
    each = docs.where(F.col("offset") + 1 < most).select("offset", F.posexplode(F.concat("tokens", F.array(F.lit(eos)))).alias("i", "token"))
    placed = each.select((F.col("offset") + F.col("i") + 1).alias("position"), "token").where(F.col("position") < most)
    return placed.unionByName(docs.sparkSession.createDataFrame([(0, bos)], "position long, token string"))


def repeated_questions(records: DataFrame, most: int, seed: int = 13, each: int = 4) -> DataFrame:
    """Records of questions that have two different answers or more: groups in seeded order, ``each`` at most of a group, ``most`` in all.

    Within a group an answer's first record (by file and place) counts; adds group_rank and rank.
    """
    key, first = ["category", "question_key"], Window.partitionBy("category", "question_key", "answer_key").orderBy("source_file", "source_item_index")
    one = records.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    whole = Window.partitionBy(*key)
    one = one.withColumn("answers", F.count("*").over(whole)).where("answers >= 2")
    one = one.withColumn("rank", F.row_number().over(whole.orderBy(seeded_order(F.col("target_fact_id"), seed), "target_fact_id"))).where(F.col("rank") <= each)
    groups = one.groupBy(*key).agg(F.count("*").alias("n")).withColumn("o", seeded_order(F.concat_ws(":", *key), seed)).orderBy("o", *key).limit(most)  # most groups hold two records each
    upto = Window.orderBy("o", *key)
    ranked = groups.withColumn("group_rank", F.row_number().over(upto)).withColumn("room", most - (F.sum("n").over(upto) - F.col("n"))).where("room >= 2")
    return one.join(F.broadcast(ranked.select(*key, "group_rank", "room")), key).where(F.col("rank") <= F.col("room")).drop("room", "answers")


def fact_prompts(records: DataFrame, most: int, seed: int = 13) -> DataFrame:
    """Two prompts, fact_reference and question_query, of the first ``most`` records by seeded order; the history prompt is the one with the other."""
    from mnemolith.functions.text import specific_question

    chosen = records.withColumn("o", seeded_order(F.col("target_fact_id"), seed)).orderBy("o", "target_fact_id").limit(most)
    asked = specific_question(F.col("profile"), F.col("question"))
    fact = F.concat(F.lit("User profile: "), "profile", F.lit("\nConversation evidence:\n"), "evidence_context")
    query_ = F.concat(F.lit("User profile: "), "profile", F.lit("\n\nQuestion: "), asked)
    rows = chosen.withColumns({"specific_question": asked, "fact_prompt": fact, "query_prompt": query_, "history_prompt": F.concat(fact, F.lit("\n\nQuestion: "), asked)})
    both = rows.withColumn("c", F.explode(F.array(F.struct(F.lit("fact_reference").alias("condition_id"), F.col("fact_prompt").alias("prompt")), F.struct(F.lit("question_query").alias("condition_id"), F.col("query_prompt").alias("prompt")))))
    return both.select(
        F.concat_ws("_", F.lit("convomem"), "target_fact_id", "c.condition_id").alias("prompt_id"), F.lit("convomem_query_to_fact").alias("suite"), "target_fact_id", "c.condition_id", "question_key", "specific_question", "entity",
        F.col("category").alias("attribute"), "answer", (F.col("category") == "changing_evidence").alias("conflict"), "c.prompt", "history_prompt", F.lit(False).alias("knowledge_prompt"),
    )


def with_metadata(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, and all others as one JSON column ``metadata``."""
    return rows.select(*keep, F.to_json(F.struct(*[c for c in rows.columns if c not in keep]), {"ignoreNullFields": "false"}).alias("metadata"))


def prefixed(rows: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """All columns but ``keep`` get a prefix."""
    return rows.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in rows.columns])


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 12), 16, 10).cast("long") / float(1 << 48)


def synthetic_samples(spark: SparkSession, samples: int, dims: int, least: int, most: int, seed: int = 0) -> DataFrame:
    """(sample_id, cand_index, vector, mass): samples of ``least`` to ``most`` blocks each; vectors and the blocks' shares of mass are drawn by hash."""
    each = spark.range(samples).select(F.col("id").alias("sample_id"), (least + F.floor(uniform(F.lit(seed), F.col("id"), F.lit("n")) * (most - least + 1))).cast("int").alias("n"))
    blocks = each.select("sample_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("cand_index"))
    vector = F.array(*[uniform(F.lit(seed), F.col("sample_id"), F.col("cand_index"), F.lit(d)) * 2 - 1 for d in range(dims)])
    drawn = blocks.select("sample_id", "cand_index", vector.alias("vector"), (uniform(F.lit(seed), F.col("sample_id"), F.col("cand_index"), F.lit("m")) + 0.01).alias("m"))
    return drawn.withColumn("mass", F.col("m") / F.sum("m").over(Window.partitionBy("sample_id"))).drop("m")
