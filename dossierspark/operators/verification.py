"""Verification of cited sentences, fact checklists, invalidation effects, and the resolution of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import find_span, normalised, sentences
from ..functions.text import content_words, strip, strip_leading_number
from .review import still_needs_review

#: Content words that a sentence shares with what it cites, for the heuristic judge to call it supported.
SHARED_WORDS = 2


def located_sources(cited: DataFrame, items: DataFrame, facts: DataFrame) -> DataFrame:
    """cited rows with found, start, end, tier, span_text, its content words (span_words) and is_current.

    cited: source_type, source_id, quote and any other columns. items: item_id, text, base. facts:
    fact_id, statement, section_text, is_current. A quote of an item is looked for in the item's text, one
    of a fact in its statement where that stands in its section; a fact whose quote is a paraphrase is
    found by its statement. Unknown ids are not found.
    """
    i = items.select(F.col("item_id").alias("source_id"), F.col("text").alias("_text"), F.col("base").alias("_base"), F.lit("knowledge_item").alias("source_type"))
    f = facts.select(F.col("fact_id").alias("source_id"), "statement", F.col("section_text").alias("_section"), "is_current", F.lit("fact").alias("source_type"))
    f = f.withColumn("_whole", find_span(F.col("statement"), F.col("_section")))
    # many rows cite the same words: each quote is looked for once in its source
    named = ["source_type", "source_id", "quote"]
    rows = cited.select(*named).distinct().join(i, ["source_type", "source_id"], "left").join(f, ["source_type", "source_id"], "left")
    stated = F.substring("_section", F.col("_whole.start") + 1, F.col("_whole.end") - F.col("_whole.start"))
    rows = rows.withColumn("_in", F.coalesce("_text", stated)).withColumn("_hit", find_span(F.col("quote"), F.col("_in")))
    base = F.when(F.col("_text").isNotNull(), F.col("_base")).otherwise(F.col("_whole.start"))
    by_quote, by_fact = F.col("_hit.start").isNotNull(), F.col("_whole.start").isNotNull()
    start = F.when(by_quote, base + F.col("_hit.start")).when(by_fact, F.col("_whole.start"))
    end = F.when(by_quote, base + F.col("_hit.end")).when(by_fact, F.col("_whole.end"))
    span = F.when(by_quote, F.substring("_in", F.col("_hit.start") + 1, F.col("_hit.end") - F.col("_hit.start"))).when(by_fact, stated)
    tier = F.coalesce("_hit.tier", "_whole.tier")
    known = rows.select(
        *[F.col(c).alias(f"_{c}") for c in named], "is_current", (by_quote | by_fact).alias("found"), start.alias("start"), end.alias("end"), span.alias("span_text"), tier.alias("tier")
    ).withColumn("span_words", content_words(F.col("span_text")))
    same = F.lit(True)
    for c in named:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return cited.join(known, same).drop(*[f"_{c}" for c in named])


def entailed(words: Column, span_words: Column) -> Column:
    """The heuristic judge: supported where the sentence shares enough content words with a span, else weak."""
    shared = F.exists(span_words, lambda s: F.size(F.array_intersect(words, s)) >= SHARED_WORDS)
    return F.when(F.coalesce(shared, F.lit(False)), "supported").otherwise("weak")


def verify_segments(segments: DataFrame, cited: DataFrame, items: DataFrame, facts: DataFrame, judge=entailed) -> DataFrame:
    """answer_id, index, support_status, n_found for every segment.

    segments: answer_id, index, kind, text. cited: answer_id, index, source_type, source_id, quote.
    Connective sentences stay connective; an attestation supports; nothing found is unsupported; else the
    judge decides from the content words of the sentence and of each span, and a sentence that rests on a fact which is no longer current is weak at best.
    """
    found = located_sources(cited, items, facts).groupBy("answer_id", "index").agg(
        F.max((F.col("source_type") == "human_attestation").cast("int")).alias("attested"),
        F.count_if("found").alias("n_found"),
        F.collect_list(F.when(F.col("found"), F.col("span_words"))).alias("spans"),
        F.min(F.when(F.col("found"), F.coalesce("is_current", F.lit(True)))).alias("current"),
    )
    rows = segments.join(found, ["answer_id", "index"], "left")
    status = (
        F.when(F.col("kind") == "connective", "connective")
        .when(F.col("attested") == 1, "supported")
        .when(F.coalesce("n_found", F.lit(0)) == 0, "unsupported")
        .when(~F.col("current"), "weak")
        .otherwise(judge(content_words(F.col("text")), F.col("spans")))
    )
    return rows.select("answer_id", "index", status.alias("support_status"), F.coalesce("n_found", F.lit(0)).alias("n_found"))


def checklist_status(facts: DataFrame, today: Column) -> Column:
    """superseded, expired, current or unverified, in that order. facts: superseded_by, document_superseded_by,
    expired_at, expires_on, stands (whether the statement was found in its section)."""
    gone = F.col("superseded_by").isNotNull() | F.col("document_superseded_by").isNotNull()
    over = F.col("expired_at").isNotNull() | F.coalesce(F.col("expires_on") < today, F.lit(False))
    return F.when(gone, "superseded").when(over, "expired").when(F.coalesce("stands", F.lit(False)), "current").otherwise("unverified")


def fact_checklist(named: DataFrame, facts: DataFrame, today: Column) -> DataFrame:
    """answer_id, fact_id, status, place: each named fact once, in the order given; unknown ones are left out.

    named: answer_id, position, fact_id. facts: fact_id, statement, section_text and the columns of checklist_status.
    """
    first = named.groupBy("answer_id", "fact_id").agg(F.min("position").alias("position"))
    checked = facts.withColumn("stands", find_span(F.col("statement"), F.col("section_text"))["start"].isNotNull())
    w = Window.partitionBy("answer_id").orderBy("position", "fact_id")
    return first.join(checked, "fact_id").select("answer_id", "fact_id", checklist_status(facts, today).alias("status"), F.row_number().over(w).alias("place"))


def verbatim_segments(items: DataFrame) -> DataFrame:
    """item_id, index, paragraph, text, start, end: the sentences of an item's answer, supported by the item itself.

    items: item_id, text, base (where the answer starts in its section).
    """
    rows = items.select("item_id", "base", F.posexplode(sentences(F.col("text"))).alias("index", "s"))
    return rows.select("item_id", "index", "s.paragraph", "s.text", (F.col("base") + F.col("s.start")).alias("start"), (F.col("base") + F.col("s.end")).alias("end"))


# What a checklist says after an invalidation for each reason.
CHECKLIST_AFTER = {"superseded": "superseded", "expired": "expired", "removed": "unverified"}
# Reasons by precedence.
REASONS = ["removed", "superseded", "expired"]


def _stale(stale: DataFrame) -> DataFrame:
    """source (type:id) and reason, the first of REASONS where there are several; an id without a type is a fact's."""
    kind = F.coalesce("source_type", F.lit("fact")) if "source_type" in stale.columns else F.lit("fact")
    place = F.array_position(F.lit(REASONS), F.col("reason"))
    return stale.groupBy(F.concat_ws(":", kind, "source_id").alias("source")).agg(F.min_by("reason", place).alias("reason"))


def _typed(source: Column) -> Column:
    return F.when(F.contains(source, F.lit(":")), source).otherwise(F.concat(F.lit("fact:"), source))


def invalidation_effects(answers: DataFrame, stale: DataFrame, in_place: bool = False) -> DataFrame:
    """Answers that a stale source changes: segments, checklist, needs_review, and what the event says.

    answers: answer_id, question_id, needs_review, segments array<struct<index, kind, support_status,
    sources array<string>>>, checklist array<struct<fact_id, status>>; a source is type:id, or the bare id of a
    fact. stale: source_id, reason (of several the first of REASONS counts) and maybe source_type. Cited
    substantive segments that are not weak yet become weak, the checklist entries of a cited fact get its
    status, and an answer where anything changed needs review. With `in_place`, entries of facts that no
    segment cites get their status too, which asks for no review. Answers where nothing changes are left
    out, so a second run finds none.
    """
    sources = F.array_distinct(F.flatten(F.transform("segments", lambda s: F.transform(s["sources"], _typed))))
    listed = F.transform("checklist", lambda c: F.concat(F.lit("fact:"), c["fact_id"]))
    named = F.array_distinct(F.concat(sources, listed)) if in_place else sources
    hits = answers.select("answer_id", F.explode(named).alias("source")).join(_stale(stale), "source")
    hits = hits.groupBy("answer_id").agg(F.map_from_entries(F.collect_list(F.struct("source", "reason"))).alias("gone"))
    after = F.create_map(*[F.lit(x) for kv in CHECKLIST_AFTER.items() for x in kv])
    cited = lambda s: F.coalesce(F.arrays_overlap(F.transform(s["sources"], _typed), F.map_keys("gone")), F.lit(False))
    weak = lambda s: cited(s) & (s["kind"] == "substantive") & (s["support_status"] != "weak")
    fact = lambda c: F.concat(F.lit("fact:"), c["fact_id"])
    wanted = lambda c: F.coalesce(F.try_element_at(after, F.try_element_at(F.col("gone"), fact(c))), c["status"])
    rows = answers.join(hits, "answer_id").withColumn("cited", sources).withColumn("changed", F.transform(F.filter("segments", weak), lambda s: s["index"]))
    moved = F.filter("checklist", lambda c: wanted(c) != c["status"])
    rows = rows.withColumn("n_checklist", F.size(moved)).withColumn("n_cited", F.size(F.filter(moved, lambda c: F.array_contains("cited", fact(c)))))
    rows = rows.where((F.size("changed") > 0) | (F.col("n_checklist") > 0))
    rows = rows.withColumn("segments", F.transform("segments", lambda s: F.when(weak(s), s.withField("support_status", F.lit("weak"))).otherwise(s)))
    rows = rows.withColumn("checklist", F.transform("checklist", lambda c: c.withField("status", wanted(c))))
    told = (F.size("changed") > 0) | (F.col("n_cited") > 0)
    flag = F.when(told, still_needs_review(F.lit(True), F.col("segments"))).otherwise(F.coalesce("needs_review", F.lit(False)))
    return rows.select("answer_id", "question_id", "segments", "checklist", flag.alias("needs_review"), "changed", "n_checklist")


def revalidate(answers: DataFrame, saved: DataFrame, stale: DataFrame) -> DataFrame:
    """invalidation_effects on the versions just saved from messages (answer_id): what went stale since they were written."""
    return invalidation_effects(answers.join(saved.select("answer_id").distinct(), "answer_id", "left_semi"), stale, in_place=True)


# How a question was matched, best first.
METHODS = ["equality", "equality_without_number", "span_verbatim", "span_near", "section"]


def resolve_questions(queries: DataFrame, pairs: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """query_id, item_id, method: the pair of the same document that a question means.

    By the normal form of the question, without its leading number, verbatim in a stored question, near one
    (best ratio), and at last by the section where it stands: of the sections that hold it in their order, the first
    with a pair whose question span holds the start of the match, or whose answer is there. queries: query_id,
    document, text. pairs: item_id, document, place, question, section_id (of the answer) and maybe
    question_section_id (null: section_id), question_start, question_end. sections: document, section_id,
    place, text. Within a method the first pair by place counts.
    """
    q = queries.withColumn("wanted", normalised(F.col("text"))).where("wanted <> ''")
    p = pairs.withColumn("own", normalised(F.coalesce("question", F.lit("")))).withColumn("plain", normalised(strip_leading_number(F.coalesce("question", F.lit("")))))
    both = q.join(p.select("item_id", "document", F.col("place").alias("place"), "own", "plain", "question"), "document")
    equal = both.where("wanted = own or wanted = plain").select(
        "query_id", "item_id", F.when(F.col("wanted") == F.col("own"), 0).otherwise(1).alias("m"), F.lit(0.0).alias("behind"), "place"
    )
    open_ = both.join(equal.select("query_id").distinct(), "query_id", "left_anti").withColumn("hit", find_span(F.col("text"), F.col("question")))
    near = open_.where("hit.start is not null").select(
        "query_id", "item_id", F.when(F.col("hit.tier") == "verbatim", 2).otherwise(3).alias("m"), (1 - F.col("hit.ratio")).alias("behind"), "place"
    )
    found = equal.unionByName(near)
    if sections is not None:
        rest = q.join(found.select("query_id").distinct(), "query_id", "left_anti")
        at = rest.join(sections.select("document", "section_id", F.col("place").alias("at"), F.col("text").alias("body")), "document")
        at = at.withColumn("hit", find_span(F.col("text"), F.col("body"))).where("hit.start is not null").select("query_id", "document", "section_id", "at", "hit.start")
        known = {c: F.col(c) if c in pairs.columns else F.lit(None) for c in ("question_section_id", "question_start", "question_end")}
        own = pairs.select("item_id", "document", F.col("place").alias("place"), "section_id", *[v.alias(c) for c, v in known.items()])
        asked = own.where("question_start is not null and question_end is not null").withColumn("section_id", F.coalesce("question_section_id", "section_id"))
        spanned = at.join(asked, ["document", "section_id"]).where("question_start <= start and start < question_end")
        there = spanned.select("query_id", "item_id", "at", F.lit(0).alias("k"), "place").union(at.join(own, ["document", "section_id"]).select("query_id", "item_id", "at", F.lit(1), "place"))
        first = there.groupBy("query_id").agg(F.min(F.struct("at", "k", "place", "item_id")).alias("s"))
        found = found.unionByName(first.select("query_id", "s.item_id", F.lit(4).alias("m"), F.lit(0.0).alias("behind"), "s.place"))
    best = found.groupBy("query_id").agg(F.min(F.struct("m", "behind", "place", "item_id")).alias("b"))
    return best.select("query_id", F.col("b.item_id").alias("item_id"), F.element_at(F.array(*[F.lit(m) for m in METHODS]), F.col("b.m") + 1).alias("method"))


def truth_with_runs(truth: DataFrame, runs: DataFrame) -> DataFrame:
    """Truth rows with the run of the same section and number, both trimmed; runs without truth are left out."""
    key = lambda d: d.withColumn("section", strip(F.col("section"))).withColumn("number", strip(F.col("number").cast("string")))
    return key(truth).join(key(runs), ["section", "number"], "left")


def labelled_pairs(labels: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Spot-check labels joined to pairs by keys in normal form (X1); each label row of a key meets each pair of it.

    The sides are sorted and merged: Spark takes the normal forms for no larger than the columns that they
    are made of, and would broadcast tables that no driver holds. The second coalesce says that they are never
    null, or they would be made once more to test for it.
    """
    form = lambda k: F.coalesce(normalised(F.coalesce(k, F.lit(""))), F.lit(""))
    named = lambda d: d.select("*", *[form(k).alias(f"_{k}") for k in keys])
    return named(labels).drop(*keys).join(named(pairs).hint("merge"), [f"_{k}" for k in keys]).drop(*[f"_{k}" for k in keys])
