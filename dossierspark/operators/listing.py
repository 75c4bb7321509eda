"""Filters, lookups and orders of lists: library items, facts, requirements, questions, tasks, threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import COVERAGES, STATUSES

# Orders of enumerations in sorted lists.
RATINGS_FIRST_RED = ["red", "unrated", "amber", "green"]
PRIORITIES = ["must", "should", "could"]


def place_of(value: Column, order: list[str]) -> Column:
    """The place of a value in a fixed order; null for one that is not in it."""
    at = F.array_position(F.array(*[F.lit(v) for v in order]), value)
    return F.when(at > 0, at - 1)


def eligible(items: DataFrame) -> DataFrame:
    """Items that retrieval may rank: verified and not excluded. Both tests reach the scan."""
    return items.where("text_verified and not excluded")


def library_page(
    items: DataFrame, item_type: str | None = None, document_id=None, verified: bool | None = None, canonical_only: bool = False, offset: int = 0, size: int = 50
) -> DataFrame:
    """One page of the library list, newest first, then by id."""
    for name, value in (("item_type", item_type), ("document_id", document_id), ("text_verified", verified)):
        if value is not None:
            items = items.where(F.col(name) == value)
    if canonical_only:
        items = items.where("is_canonical")
    return items.orderBy(F.desc("created_at"), "item_id").offset(max(0, offset)).limit(size)


def fact_page(facts: DataFrame, is_current: Column, current_only: bool, offset: int, size: int) -> DataFrame:
    """One page of facts; `current_only` acts after the page is cut, so such a page may be short."""
    page = facts.orderBy(F.desc("created_at"), "fact_id").offset(max(0, offset)).limit(size)
    return page.where(is_current) if current_only else page


def rating(compliance_class: Column) -> Column:
    return F.when(compliance_class == "A", "green").when(compliance_class == "B", "amber").when(compliance_class == "C", "red").otherwise("unrated")


def needs_attention(compliance_class: Column, priority: Column) -> Column:
    """Red, or an unrated must."""
    colour = rating(compliance_class)
    return (colour == "red") | ((colour == "unrated") & F.coalesce(priority == "must", F.lit(False)))


def filter_requirements(rows: DataFrame, search: str = "", colour: str = "", priority: str = "", attention: bool = False) -> DataFrame:
    """Requirements by rating, priority ('-': none), attention, and a substring of what the row shows."""
    if colour:
        rows = rows.where(rating(F.col("compliance_class")) == colour)
    if priority:
        rows = rows.where(F.coalesce("priority", F.lit("")) == "" if priority == "-" else F.col("priority") == priority)
    if attention:
        rows = rows.where(needs_attention(F.col("compliance_class"), F.col("priority")))
    wanted = search.strip().lower()
    if wanted:
        shown = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("ref", "text", "comment", "owner", "document")])
        rows = rows.where(F.contains(F.lower(shown), F.lit(wanted)))
    return rows


def requirement_key_of(key: str) -> Column:
    return {
        "order": F.col("order_index"),
        "priority": place_of(F.col("priority"), PRIORITIES),
        "rating": place_of(rating(F.col("compliance_class")), RATINGS_FIRST_RED),
        "owner": F.lower(F.nullif(F.col("owner"), F.lit(""))),
    }[key]


def question_key_of(key: str) -> Column:
    """The sort value of a question: one of the seven columns of the table."""
    return {
        "order": F.col("order_index"),
        "weighting": F.col("weighting"),
        "coverage": place_of(F.col("coverage"), COVERAGES),
        "assignee": F.lower(F.nullif(F.col("assignee"), F.lit(""))),
        "status": place_of(F.col("status"), STATUSES),
        "support": F.col("support_score"),
        "words": F.coalesce("word_count", F.lit(0)) / F.nullif(F.col("word_limit"), F.lit(0)),
    }[key]


def sorted_by(value: Column, descending: bool) -> list[Column]:
    """An order by one column: missing values last either way, ties in the buyer's order."""
    return [value.desc_nulls_last() if descending else value.asc_nulls_last(), F.col("order_index").asc()]


def sections_in_order(questions: DataFrame) -> DataFrame:
    """section, first: each section once, by its first question."""
    return questions.groupBy("section").agg(F.min("order_index").alias("first"))


def highlight(text: Column, start: Column, end: Column) -> Column:
    """The marked part of a section; null where the span is not a valid one."""
    valid = (start >= 0) & (start < end) & (end <= F.length(text))
    return F.when(valid, F.substring(text, start + 1, end - start))


def attached_facts(items: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of the sections of each query's ranked items: item order, newest date, id; each fact once a query.

    items: query_id, rank, section_id.
    """
    near = items.groupBy("query_id", "section_id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank", F.col("effective_date").desc_nulls_last(), "fact_id")
    return facts.join(near, "section_id").withColumn("place", F.row_number().over(w))


def with_documents(rows: DataFrame, documents: DataFrame, *columns: str) -> DataFrame:
    """Rows with columns of their document, null where it is unknown."""
    return rows.join(documents.select("document_id", *columns), "document_id", "left")


def requirement_sources(requirements: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Requirements with document and section; those without either are left out."""
    return requirements.join(documents, "document_id").join(sections, ["document_id", "section_id"])


def evidence_documents(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    return evidence.join(documents, "document_id")


def with_visible_messages(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Threads that have a message which is not hidden."""
    return threads.join(messages.where("not hidden").select("thread_id"), "thread_id", "left_semi")


def active_reviewers(reviewers: DataFrame, profiles: DataFrame, memberships: DataFrame) -> DataFrame:
    """Reviewers with their profile who are active members of the workspace."""
    active = memberships.where("status = 'active'").select("workspace_id", "user_id")
    return reviewers.join(profiles, "user_id").join(active, ["workspace_id", "user_id"])


def threads_with_messages(threads: DataFrame, messages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Threads with who resolved them, if anyone, and their messages in order."""
    nested = messages.groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("position", "body"))).alias("messages"))
    names = profiles.select(F.col("user_id").alias("resolved_by"), F.col("name").alias("resolver"))
    return threads.join(names, "resolved_by", "left").join(nested, "thread_id", "left")


def waiting_on(status: Column, needs_review: Column, attention: Column, n_sme: Column, n_approver: Column) -> Column:
    """struct<who, reason>: who a question waits for, and why."""
    s = lambda who, reason: F.struct(F.lit(who).alias("who"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    sentences = F.concat(attention.cast("string"), F.when(attention == 1, " sentence needs").otherwise(" sentences need"), F.lit(" a source or confirmation"))
    return (
        F.when(status == "not_started", s("owner", "Write or generate the answer"))
        .when(needs_review, s("owner", "Resolve the items marked as needing review"))
        .when(status.isin("ai_draft", "writer_edited") & (n_sme > 0), s("sme", "Verify the answer as SME reviewer"))
        .when(status == "ai_draft", s("owner", "Review and edit the AI draft"))
        .when((status == "writer_edited") & (attention > 0), s("owner", sentences))
        .when(status.isin("writer_edited", "sme_verified") & (n_approver > 0), s("approver", "Approve the answer"))
        .when(status == "writer_edited", s("owner", "Move the answer on for approval"))
        .when(status == "sme_verified", s("owner", "Approve the answer"))
        .otherwise(s("owner", "Approved"))
    )


def days_remaining(deadline: Column, today: Column) -> Column:
    """Whole days by date."""
    return F.datediff(F.to_date(deadline), today)


def days_until(deadline: Column, now: Column) -> Column:
    """Days by the clock, begun ones count."""
    return F.ceil((F.unix_micros(deadline) - F.unix_micros(now)) / 86_400_000_000)


def rounded(value: Column, digits: int) -> Column:
    """Half to even on the exact value of the double: 2.675 is a little less than its decimal form and gives 2.67.

    The product with the power of ten is taken as two doubles, what is rounded and what rounding leaves, so
    ties are told exactly. Numbers of 2**52 and more at that scale, infinities, NaN and null stay as they are.
    """
    power, cut = 10.0**digits, 134217729.0  # 2**27 + 1 parts a double into two halves of 26 bits
    p_high = power * cut - (power * cut - power)
    p_low = power - p_high
    x = value.cast("double")
    high = x * cut - (x * cut - x)
    low, whole = x - high, x * power
    rest = ((high * p_high - whole) + high * p_low + low * p_high) + low * p_low
    below = F.floor(whole).cast("double")
    over = whole - below - 0.5
    up = (over > 0) | ((over == 0) & ((rest > 0) | ((rest == 0) & (below % 2 != 0))))
    return F.when(F.coalesce(F.abs(whole) < 2.0**52, F.lit(False)), (below + F.when(up, 1.0).otherwise(0.0)) / power).otherwise(x)


def unread_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"), F.count("*").alias("total"))


def call_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("name").agg(F.count("*").alias("calls"))


def ingestion_counts(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: documents by state, facts, and those superseded."""
    d = documents.agg(F.count("*").alias("documents"), F.count_if(F.col("ingest_status") == "ready").alias("ready"), F.count_if(F.col("ingest_status") == "failed").alias("failed"))
    f = facts.agg(F.count("*").alias("facts"), F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"))
    return d.withColumn("_one", F.lit(1)).join(f.withColumn("_one", F.lit(1)), "_one").drop("_one")


def export_values(rows: DataFrame, placeholder: str) -> DataFrame:
    """The six columns of a sheet. rows: section, number, text, answer_text (null: none), status, word_count."""
    label = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])
    other = F.concat(F.upper(F.substring("status", 1, 1)), F.substring(F.lower(F.replace("status", F.lit("_"), F.lit(" "))), 2, 1000))
    return rows.select(
        "section", "number", F.col("text").alias("question"), F.coalesce("answer_text", F.lit(placeholder)).alias("answer"),
        F.coalesce(F.try_element_at(label, F.col("status")), other).alias("status"), F.when(F.col("answer_text").isNotNull(), F.col("word_count")).alias("words"),
    )


# How statuses are shown.
STATUS_LABELS = {"not_started": "Not started", "ai_draft": "AI draft", "writer_edited": "Writer edited", "sme_verified": "SME verified", "approved": "Approved"}


def form_fills(targets: DataFrame, most: int = 32_767) -> DataFrame:
    """Which cells of a form are filled: empty or placeholder-like ones without a formula, text cut to a cell's size.

    targets: label, existing (null: no such cell), formula, text. Adds fill (null: skipped) and reason.
    """
    empty = F.col("existing").rlike(PLACEHOLDER_LIKE)
    reason = (
        F.when(F.col("existing").isNull(), "missing")
        .when(F.coalesce("formula", F.lit(False)), "formula")
        .when(~empty, F.concat(F.lit("occupied: "), F.substring("existing", 1, 60)))
    )
    return targets.withColumn("reason", reason).withColumn("fill", F.when(F.col("reason").isNull(), F.substring("text", 1, most)))


# Fixed value: what an empty answer cell may hold.
PLACEHOLDER_LIKE = r"(?i)^\s*(\[[^\]]{0,60}\]|\(?(supplier|bidder|tenderer) to (complete|respond)\)?|n/?a|-+|\.{3,}|_+)?\s*$"


def paragraphs_with_comments(answers: DataFrame, comment) -> DataFrame:
    """answer_id, position, paragraph, text, opens (first of its paragraph), comment: one row a sentence, for a document.

    answers: answer_id, segments. comment: a function from a segment column to its comment.
    """
    rows = answers.select("answer_id", F.posexplode("segments").alias("position", "s"))
    before = F.lag("s.paragraph").over(Window.partitionBy("answer_id").orderBy("position"))
    return rows.select(
        "answer_id", "position", F.col("s.paragraph").alias("paragraph"), F.col("s.text").alias("text"),
        F.coalesce(before != F.col("s.paragraph"), F.lit(True)).alias("opens"), comment(F.col("s")).alias("comment"),
    )


def report_lines(metrics: DataFrame) -> DataFrame:
    """A report table as text rows, one for each metric: section, place, line."""
    shown = F.when(F.col("value").isNull(), "n/a").otherwise(F.format_string("%.4f", F.col("value")))
    return metrics.select("section", "place", F.format_string("| %s | %s |", F.col("name"), shown).alias("line"))
