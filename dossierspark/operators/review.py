"""Review operators: support summaries, status gates, aggregates, board lists and orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import STATUSES, SUPPORT_STATUSES, SYSTEM_ONLY_STATUSES


def support_summary(segments: Column) -> Column:
    """struct<counts, substantive, supported, needs_attention, score> of array<struct<kind, support_status>>."""
    of = lambda test: F.size(F.filter(segments, test))
    substantive = of(lambda s: s["kind"] == "substantive")
    supported = of(lambda s: (s["kind"] == "substantive") & (s["support_status"] == "supported"))
    with_status = lambda v: of(lambda s: s["support_status"] == v)
    counts = F.map_from_arrays(F.array(*[F.lit(v) for v in SUPPORT_STATUSES]), F.array(*[with_status(v) for v in SUPPORT_STATUSES]))
    return F.struct(
        counts.alias("counts"),
        substantive.alias("substantive"),
        supported.alias("supported"),
        (substantive - supported).alias("needs_attention"),
        F.when(substantive > 0, supported / substantive).alias("score"),
    )


def still_needs_review(flag: Column, segments: Column) -> Column:
    """The flag, cleared when no substantive segment is weak or unsupported."""
    return flag & F.exists(segments, lambda s: (s["kind"] == "substantive") & s["support_status"].isin("weak", "unsupported"))


def cites(segments: Column, source_type: str, source_id: Column) -> Column:
    return F.exists(segments, lambda s: F.exists(s["sources"], lambda x: (x["source_type"] == source_type) & (x["source_id"] == source_id)))


def attention_indices(segments: Column) -> Column:
    wanted = lambda s: s["support_status"].isin("weak", "unsupported", "human_authored") | s["dispute"].isNotNull()
    return F.transform(F.filter(segments, wanted), lambda s: s["index"])


def next_attention(indices: Column, last: Column) -> Column:
    """The first index after `last`, else the first of all."""
    return F.coalesce(F.array_min(F.filter(indices, lambda i: i > last)), F.array_min(indices))


def blockers(status: str, has_answer: Column, segments: Column, needs_review: Column, gaps: Column, acknowledged: Column) -> Column:
    """array<string> of what forbids a person's move to a status; empty: allowed."""
    if status in SYSTEM_ONLY_STATUSES:
        return F.array(F.lit("system_only"))
    none = F.array(F.lit("no_answer"))
    if status == "writer_edited":
        return F.when(has_answer, F.array().cast("array<string>")).otherwise(none)
    open_segments = F.transform(
        F.filter(segments, lambda s: (s["kind"] == "substantive") & (s["support_status"] != "supported")),
        lambda s: F.concat(F.lit("segment:"), s["index"].cast("string")),
    )
    parts = [open_segments, F.when(needs_review, F.array(F.lit("needs_review"))).otherwise(F.array().cast("array<string>"))]
    if status == "approved":
        parts.append(F.transform(F.array_except(gaps, acknowledged), lambda g: F.concat(F.lit("gap:"), g)))
    return F.when(has_answer, F.concat(*parts)).otherwise(none)


def allowed_transitions(questions: DataFrame) -> DataFrame:
    """question_id, to, allowed, blockers for every status.

    questions: question_id, has_answer, segments, needs_review, gaps, acknowledged (normalised texts).
    """
    args = [F.col(c) for c in ("has_answer", "segments", "needs_review", "gaps", "acknowledged")]
    moves = F.array(*[F.struct(F.lit(s).alias("to"), blockers(s, *args).alias("blockers")) for s in STATUSES])
    return questions.select("question_id", F.explode(moves).alias("m")).select(
        "question_id", F.col("m.to").alias("to"), (F.size("m.blockers") == 0).alias("allowed"), F.col("m.blockers").alias("blockers")
    )


def pack_aggregates(packs: DataFrame, questions: DataFrame) -> DataFrame:
    """Counts and sums by pack, zero for packs without questions; only sums cross the shuffle.

    questions: pack_id, status, word_limit, words (of the current answer), class, mandatory, needs_review.
    """
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = questions.groupBy("pack_id").agg(
        F.count("*").alias("n_questions"),
        yes(F.col("status") == "approved").alias("n_approved"),
        F.sum("word_limit").alias("word_limit"),
        F.sum(F.when(F.col("status") == "approved", F.col("words"))).alias("approved_words"),
        yes(F.col("class") == "C").alias("n_class_c"),
        yes(F.col("mandatory") & F.col("class").isNull()).alias("n_mandatory_unclassified"),
        yes(F.col("needs_review")).alias("n_needs_review"),
    )
    names = [c for c in sums.columns if c != "pack_id"]
    return packs.select("pack_id").join(sums, "pack_id", "left").select("pack_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def requirement_summary(requirements: DataFrame) -> DataFrame:
    """pack_id and counts by rating. requirements: pack_id, rating, suggestion."""
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0))
    colours = {"green": F.col("rating") == "A", "amber": F.col("rating") == "B", "red": F.col("rating") == "C", "unrated": F.col("rating").isNull()}
    return requirements.groupBy("pack_id").agg(
        F.count("*").alias("total"),
        *[yes(c).alias(n) for n, c in colours.items()],
        yes(F.col("rating").isNull() & F.col("suggestion").isNotNull()).alias("suggested_unrated"),
    )


def count_pivot(rows: DataFrame, group: str, kind: str, kinds: list[str]) -> DataFrame:
    """One column of counts for each kind, zero-filled."""
    return rows.groupBy(group).agg(*[F.sum(F.when(F.col(kind) == k, 1).otherwise(0)).alias(f"n_{k.lower()}") for k in kinds])


def current_answers(answers: DataFrame) -> DataFrame:
    """The row of the highest version of each question."""
    names = [c for c in answers.columns if c != "question_id"]
    return answers.groupBy("question_id").agg(F.max_by(F.struct(*names), "version").alias("a")).select("question_id", "a.*")


def board_list(questions: DataFrame, answers: DataFrame, threads: DataFrame) -> DataFrame:
    """Questions with their current answer and thread, if any; the right sides are filtered before the join."""
    current = answers.where("is_current").select("question_id", "answer_id", "version")
    return questions.join(current, "question_id", "left").join(threads.select("question_id", "thread_id"), "question_id", "left")


PLACEHOLDER = "[No approved answer]"


def export_rows(questions: DataFrame, answers: DataFrame, mode: str) -> DataFrame:
    """Rows of an export: submission shows approved answers only, review any current one.

    A submission with a question that needs review is refused.
    """
    if mode == "submission" and questions.where("needs_review").limit(1).count():
        raise ValueError("a question needs review")
    current = answers.where("is_current").select("question_id", "answer_text")
    shown = F.col("answer_text") if mode == "review" else F.when(F.col("status") == "approved", F.col("answer_text"))
    return questions.join(current, "question_id", "left").withColumn("shown", F.coalesce(shown, F.lit(PLACEHOLDER))).drop("answer_text")


def in_scope(scope: str) -> Column:
    """Questions that a triage run takes."""
    return {"unknown": F.col("coverage") == "unknown", "not_started": F.col("status") == "not_started"}[scope]


def eligible_for_draft(questions: DataFrame, human_versions: DataFrame, include_new: bool = False) -> DataFrame:
    wanted = ["covered", "partial"] + ["new"] * include_new
    able = questions.where((F.col("status") == "not_started") & F.col("coverage").isin(wanted) & ~F.col("pricing"))
    return able.join(human_versions.select("question_id").distinct(), "question_id", "left_anti")


def search_questions(questions: DataFrame, text: str | None = None, **equal: str) -> DataFrame:
    """Case-insensitive substring over number, section and text; status 'unapproved' and assignee '-' are special."""
    out = questions
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "number", "section", "text")), F.lit(text.lower())))
    for name, value in equal.items():
        if name == "status" and value == "unapproved":
            out = out.where(F.col("status") != "approved")
        elif name == "assignee" and value == "-":
            out = out.where(F.col("assignee").isNull())
        else:
            out = out.where(F.col(name) == value)
    return out


def status_rank(c: Column) -> Column:
    rank = F.create_map(*[x for i, s in enumerate(STATUSES) for x in (F.lit(s), F.lit(i))])
    return F.try_element_at(rank, c)


def nulls_last(c: Column, descending: bool = False) -> Column:
    """Nulls last whichever way."""
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def urgency(deadline: Column, weight: Column, index: Column) -> list[Column]:
    return [deadline.asc_nulls_last(), F.coalesce(weight, F.lit(0)).desc(), index.asc()]


def page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """One page of 1 to 2000 rows."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(2000, max(1, size)))


def grouped_with_empty(rows: DataFrame, groups: list[str], key: str) -> DataFrame:
    """Counts of every group of the list, empty ones too, in list order."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(g, i) for i, g in enumerate(groups)], f"{key} string, place int")
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counts, key, "left").select(key, "place", F.coalesce("n", F.lit(0)).alias("n"))


def with_segment(segments: Column, index: Column, field: str, value: Column) -> Column:
    """One segment's field replaced."""
    return F.transform(segments, lambda s: F.when(s["index"] == index, s.withField(field, value)).otherwise(s))


def joined_answer(segments: Column) -> Column:
    """Sentences joined by a space within a paragraph, paragraphs by a blank line."""
    numbers = F.array_sort(F.array_distinct(F.transform(segments, lambda s: s["paragraph"])))
    part = lambda p: F.array_join(F.transform(F.filter(segments, lambda s: s["paragraph"] == p), lambda s: s["text"]), " ")
    return F.array_join(F.transform(numbers, part), "\n\n")


def task_for(owner: Column, sme: Column, approver: Column, status: Column) -> Column:
    """Who has to act next: owner until written, then expert, then approver."""
    return (
        F.when(status.isin("not_started", "ai_draft"), owner)
        .when(status == "writer_edited", F.coalesce(sme, approver))
        .when(status == "sme_verified", approver)
    )


def last_message(messages: DataFrame, thread: str, order: str) -> DataFrame:
    """The latest message of each thread."""
    names = [c for c in messages.columns if c != thread]
    return messages.groupBy(thread).agg(F.max_by(F.struct(*names), F.col(order)).alias("m")).select(thread, "m.*")


def merged_turns(messages: DataFrame, thread: str = "conv_id", order: str = "turn") -> DataFrame:
    """Runs of one role joined by a blank line; system turns and what stands before the first user turn go."""
    w = Window.partitionBy(thread).orderBy(order)
    spoken = messages.where(F.col("role") != "system")
    started = spoken.withColumn("begun", F.max((F.col("role") == "user").cast("int")).over(w)).where("begun = 1")
    runs = started.withColumn("new", (~F.col("role").eqNullSafe(F.lag("role").over(w))).cast("int")).withColumn("run", F.sum("new").over(w))
    texts = F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda t: t["text"])
    return runs.groupBy(thread, "run").agg(F.first("role").alias("role"), F.array_join(texts, "\n\n").alias("text"))


def nested_messages(messages: DataFrame, thread: str, order: str, *fields: str) -> DataFrame:
    """thread, messages: the thread's messages as structs in order."""
    return messages.groupBy(thread).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias("messages"))
