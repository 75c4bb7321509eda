"""Versions of answers and what people do to them, as recomputation over tables of requests.

A request that is not allowed changes nothing and says why in `outcome`. Segments are
array<struct<index, paragraph, text, kind, support_status, sources array<string>, dispute string>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .listing import place_of
from .review import joined_answer, still_needs_review
from ..functions.text import normalised_ascii, strip, word_count
from ..settings import STATUSES

# Statuses of sentences that may be attested.
ATTESTABLE = ["unsupported", "weak", "human_authored"]
ATTESTATION = "human_attestation:"


def next_versions(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """question_id, version: one more than the highest, 1 for a question without answers."""
    highest = answers.groupBy("question_id").agg(F.max("version").alias("highest"))
    return questions.select("question_id").join(highest, "question_id", "left").select("question_id", (F.coalesce("highest", F.lit(0)) + 1).alias("version"))


def displaces(status: Column, confirmed: Column) -> Column:
    """Whether a new draft has to be confirmed first: the question is past a draft of the model."""
    return (place_of(status, STATUSES) > STATUSES.index("ai_draft")) & ~F.coalesce(confirmed, F.lit(False))


def with_current(answers: DataFrame, added: DataFrame) -> DataFrame:
    """All versions with is_current: the added one of a question takes the place of any other."""
    both = answers.select("question_id", "answer_id", "version", "is_current", F.lit(False).alias("added")).unionByName(
        added.select("question_id", "answer_id", "version", F.lit(True).alias("is_current"), F.lit(True).alias("added"))
    )
    fresh = F.max("added").over(Window.partitionBy("question_id"))
    return both.withColumn("is_current", F.when(fresh, F.col("added")).otherwise(F.col("is_current"))).drop("added")


def version_history(answers: DataFrame) -> DataFrame:
    """Versions of each question, newest first, with their place."""
    return answers.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("version"))))


def act(answers: DataFrame, actions: DataFrame) -> DataFrame:
    """Attestations and disputes of current answers: answer_id, segments, needs_review, events.

    answers: answer_id, segments, needs_review. actions: answer_id, index, action (attest or dispute),
    actor, note; the first request of a sentence by (action, actor, note) counts. An attested sentence is
    supported and its dispute ends; a disputed one is unsupported and its answer needs review. An
    attestation wants an unsupported, weak or human-authored sentence, a dispute a supported one and a
    note. events: array<struct<index, action, outcome>>, in the order of the sentences.
    """
    one = actions.groupBy("answer_id", "index").agg(F.min(F.struct("action", "actor", "note")).alias("a"))
    asked = one.groupBy("answer_id").agg(F.map_from_entries(F.collect_list(F.struct("index", "a"))).alias("asked"))
    a = lambda s: F.try_element_at(F.col("asked"), s["index"])
    attests = lambda s: (a(s)["action"] == "attest") & s["support_status"].isin(ATTESTABLE)
    noted = lambda s: strip(F.coalesce(a(s)["note"], F.lit(""))) != ""
    disputes = lambda s: (a(s)["action"] == "dispute") & (s["support_status"] == "supported") & noted(s)

    def changed(s: Column) -> Column:
        by = F.concat(F.lit(ATTESTATION), a(s)["actor"])
        attested = s.withField("sources", F.concat(s["sources"], F.array(by))).withField("support_status", F.lit("supported")).withField("dispute", F.lit(None).cast("string"))
        disputed = s.withField("support_status", F.lit("unsupported")).withField("dispute", F.concat_ws(": ", a(s)["actor"], strip(a(s)["note"])))
        return F.when(attests(s), attested).when(disputes(s), disputed).otherwise(s)

    def event(s: Column) -> Column:
        outcome = F.when(attests(s), "attested").when(disputes(s), "disputed").otherwise("refused")
        return F.struct(s["index"].alias("index"), a(s)["action"].alias("action"), outcome.alias("outcome"))

    joined = answers.join(asked, "answer_id")
    marked = joined.select(
        "answer_id",
        F.transform("segments", changed).alias("segments"),
        (F.coalesce("needs_review", F.lit(False)) | F.exists("segments", lambda s: F.coalesce(disputes(s), F.lit(False)))).alias("flag"),
        F.transform(F.filter("segments", lambda s: a(s).isNotNull()), event).alias("events"),
    )
    return marked.select("answer_id", "segments", still_needs_review(F.col("flag"), F.col("segments")).alias("needs_review"), "events")


def acknowledge(answers: DataFrame, requests: DataFrame, normal=normalised_ascii) -> DataFrame:
    """question_id, gap, accepted: a gap is acknowledged where it equals one of the answer's in normal form.

    answers: question_id, gaps. requests: question_id, gap.
    """
    joined = requests.join(answers.select("question_id", "gaps"), "question_id", "left")
    known = F.exists("gaps", lambda g: normal(g) == normal(F.col("gap")))
    return joined.select("question_id", "gap", F.coalesce(known, F.lit(False)).alias("accepted"))


def judge_edits(questions: DataFrame, answers: DataFrame, edits: DataFrame) -> DataFrame:
    """question_id, outcome, version: whether each edit is saved (and as which version), stale or empty.

    answers: question_id, answer_id, version, is_current. edits: question_id, base_id, text. Of several
    edits of one question the first by text counts, the others are stale: they know another current version.
    """
    current = answers.where("is_current").select("question_id", F.col("answer_id").alias("current_id"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("_rank", "text"))
    joined = edits.join(current, "question_id", "left").join(next_versions(questions, answers), "question_id")
    empty = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")) == ""
    fits = F.col("base_id").eqNullSafe(F.col("current_id"))
    ranked = joined.withColumn("_rank", F.when(fits & ~empty, 0).otherwise(1)).withColumn("_place", place)
    outcome = F.when(~fits | ((F.col("_rank") == 0) & (F.col("_place") > 1)), "stale").when(empty, "empty").otherwise("saved")
    return ranked.select("question_id", "text", outcome.alias("outcome"), F.when(outcome == "saved", F.col("version")).alias("version"))


def answers_from_messages(messages: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """message_id, outcome, version, text, words: messages of a thread saved as an answer.

    messages: message_id, question_id, role, segments, confirmed. questions: question_id, status, pricing.
    Refused: messages of users or without segments, threads without a question, pricing questions, and
    questions past a draft without confirmation. The first message of a question by id gets the next version.
    """
    joined = messages.join(questions.select("question_id", "status", "pricing"), "question_id", "left").join(next_versions(questions, answers), "question_id", "left")
    outcome = (
        F.when((F.col("role") != "assistant") | F.col("segments").isNull(), "not_saveable")
        .when(F.col("status").isNull(), "no_question")
        .when(F.col("pricing"), "pricing")
        .when(displaces(F.col("status"), F.col("confirmed")), "confirm_first")
        .otherwise("saved")
    )
    rows = joined.withColumn("outcome", outcome)
    nth = F.row_number().over(Window.partitionBy("question_id", "outcome").orderBy("message_id"))
    text = joined_answer(F.col("segments"))
    saved = F.col("outcome") == "saved"
    return rows.select(
        "message_id", "question_id", "outcome", F.when(saved, F.col("version") + nth - 1).alias("version"),
        F.when(saved, text).alias("text"), F.when(saved, word_count(text)).alias("words"),
    )


def rate_requirements(requirements: DataFrame, patches: DataFrame) -> DataFrame:
    """Requirements after their patch, with what an event would say: previous and changed.

    patches: requirement_id, new_class, sets_class, new_date, sets_date, actor. A changed class stamps who
    rated, a cleared one clears the stamp; moving to A or C clears compliant_by unless the patch sets it.
    """
    joined = requirements.join(patches, "requirement_id", "left")
    changed = F.coalesce("sets_class", F.lit(False)) & ~F.col("new_class").eqNullSafe(F.col("compliance_class"))
    own = F.when(F.coalesce("sets_date", F.lit(False)), F.col("new_date"))
    kept = F.when(changed & F.coalesce(F.col("new_class").isin("A", "C"), F.lit(False)), F.lit(None)).otherwise(F.col("compliant_by"))
    return joined.select(
        "requirement_id",
        F.col("compliance_class").alias("previous"),
        F.when(changed, F.col("new_class")).otherwise(F.col("compliance_class")).alias("compliance_class"),
        F.when(F.coalesce("sets_date", F.lit(False)), own).otherwise(kept).alias("compliant_by"),
        F.when(changed, F.when(F.col("new_class").isNotNull(), F.col("actor"))).otherwise(F.col("rated_by")).alias("rated_by"),
        changed.alias("changed"),
    )


def promote(questions: DataFrame, answers: DataFrame, promoted: DataFrame, stored: DataFrame) -> DataFrame:
    """Library items of approved answers that are not in the library yet, one for each answer version.

    questions: question_id, pack_id, section, number, text, status, order_index. answers: question_id,
    answer_id, answer_text, is_current. promoted: answer_id. stored: pack_id, order_index of sections that
    the pack's promotion document has. The section is the heading, the question, a blank line and the
    answer; spans are known from how it is built. Order indices follow the highest stored one.
    """
    current = answers.where("is_current").where(strip(F.coalesce("answer_text", F.lit(""))) != "").select("question_id", "answer_id", "answer_text")
    new = questions.where("status = 'approved'").join(current, "question_id").join(promoted.select("answer_id").distinct(), "answer_id", "left_anti")
    last = stored.groupBy("pack_id").agg(F.max("order_index").alias("last"))
    heading = strip(F.concat_ws(" ", "section", "number"))
    built = new.join(last, "pack_id", "left").withColumn("heading", heading).withColumn(
        "section_text", F.concat("heading", F.lit("\n"), "text", F.lit("\n\n"), "answer_text")
    )
    place = F.row_number().over(Window.partitionBy("pack_id").orderBy("order_index", "question_id"))
    size = lambda c: F.length(c)
    return built.select(
        "pack_id", "question_id", "answer_id", "heading", "section_text",
        (F.coalesce("last", F.lit(-1)) + place).alias("order_index"),
        (size("heading") + 1).alias("question_start"), (size("heading") + 1 + size("text")).alias("question_end"),
        (size("section_text") - size("answer_text")).alias("answer_start"), size("section_text").alias("answer_end"),
    )
