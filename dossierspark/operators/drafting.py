"""Drafts: the query of a turn, sentences copied from ranked candidates, and the lines that a model streams back.

A draft is one row of its question: its candidates are at most the few that retrieval keeps and its facts those
chosen for them, so both travel as arrays, and everything that follows is Column expressions over these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import normalised
from ..functions.text import content_words, simple_sentences, strip
from ..settings import GENERIC_STOPWORDS, LEXICAL_STOPWORDS

# Parts of words that make a turn an instruction about the draft, and those that ask for a short one.
INSTRUCTION_WORDS = ["short", "bullet", "tone", "reword", "rewrite", "formal", "concise", "expand", "longer", "paragraph", "tighten", "simplif"]
SHORT_WORDS = ["short", "concise"]
# Sentences of a draft.
PRICING_GAP = "Pricing is human-only and is never drafted."
NOTHING_RETRIEVED = "No library material was retrieved for this question."
#: Sentences taken from the best candidate, from it in a short draft, and from the second; words that a gap names.
FIRST, FIRST_SHORT, SECOND, NAMED = 6, 4, 2, 6

SOURCE = "struct<source_type:string,source_id:string,quote:string>"


def _holds(text: Column, parts: list[str]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(parts)), F.lit(False))


def rewritten_query(turn: Column, question: Column) -> Column:
    """What a turn retrieves with: the question for an instruction about the draft, else the turn itself.

    A null turn is empty; without a question (null or blank) the turn stays.
    """
    said, asked = strip(F.coalesce(turn, F.lit(""))), strip(F.coalesce(question, F.lit("")))
    return F.when((asked != "") & _holds(said, INSTRUCTION_WORDS), asked).otherwise(said)


def _uncovered(question: Column, covered: Column) -> Column:
    """The words of a question, as they stand, whose content word is not among the covered ones; the first of each."""
    stop = sorted({*GENERIC_STOPWORDS, *LEXICAL_STOPWORDS})
    words = F.filter(F.split(F.lower(F.coalesce(question, F.lit(""))), "[^a-z0-9]+"), lambda w: ((F.length(w) >= 3) | w.rlike("^[0-9]+$")) & ~w.isin(stop))
    named = F.transform(words, lambda w: F.struct(w.alias("word"), content_words(w)[0].alias("stem")))
    seen = F.transform(named, lambda n: n["stem"])
    firsts = F.filter(named, lambda n, i: (F.array_position(seen, n["stem"]) == i + 1) & ~F.array_contains(covered, n["stem"]))
    return F.transform(firsts, lambda n: n["word"])


def _planned(short: Column) -> Column:
    """Segments before facts are looked at: paragraph, item_id, text. The second and third sentence of the best
    candidate share a segment where there are three at least."""
    first, second = F.try_element_at("ranked", F.lit(1)), F.try_element_at("ranked", F.lit(2))
    chosen = F.slice(first["sentences"], 1, F.when(short, FIRST_SHORT).otherwise(FIRST))
    merged = F.concat(F.slice(chosen, 1, 1), F.array(F.concat_ws(" ", chosen[1], chosen[2])), F.slice(chosen, 4, FIRST))
    texts = F.when(F.size(chosen) >= 3, merged).otherwise(chosen)
    # a question with one candidate has no second
    more = F.when(short | second.isNull(), F.array().cast("array<string>")).otherwise(F.slice(second["sentences"], 1, SECOND))
    part = lambda c, p: lambda t: F.struct(F.lit(p).alias("paragraph"), c["item_id"].cast("string").alias("item_id"), t.alias("text"))
    return F.concat(F.transform(texts, part(first, 0)), F.transform(more, part(second, 1)))


def synthesised(questions: DataFrame, candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """question_id, segments, gaps, fact_ids: a draft of each question from its best candidates.

    questions: question_id, text, instruction, response_type, buyer. candidates: question_id, rank, item_id, text.
    facts: question_id, position, fact_id, kind, statement, expired. segments: array<struct<index, paragraph, kind,
    text, sources>>, a connective opener first. A sentence cites its item and every current fact that it states.
    One that states a fact which is no longer current gives way to the current fact of that kind, or goes, and the
    gap says so. Gaps also name words of the question that no candidate has. Pricing questions have a gap alone.
    Blank statements state nothing; equal ranks and positions go by id; a null instruction is none.
    """
    none = F.array().cast("array<string>")
    # a candidate's first sentences and its words are all that a draft needs of it: texts stay in their rows
    complete = F.slice(simple_sentences(F.coalesce("text", F.lit("")), complete_only=True), 1, FIRST)
    read = candidates.select("question_id", "rank", "item_id", complete.alias("sentences"), content_words(F.col("text")).alias("words"))
    ranked = read.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "sentences", "words"))).alias("ranked"))
    stated = facts.withColumn("norm", normalised(F.coalesce(strip(F.col("statement")), F.lit(""))))
    known = stated.where("norm <> ''").groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("position", F.col("fact_id").cast("string").alias("fact_id"), "kind", strip(F.col("statement")).alias("statement"), "norm", F.coalesce("expired", F.lit(False)).alias("expired")))).alias("facts")
    )
    rows = questions.join(ranked, "question_id", "left").join(known, "question_id", "left").withColumn("pricing", F.coalesce(F.col("response_type") == "pricing", F.lit(False)))
    rows = rows.withColumn("short", _holds(F.col("instruction"), SHORT_WORDS)).withColumn("planned", F.coalesce(_planned(F.col("short")), F.array().cast("array<struct<paragraph:int,item_id:string,text:string>>")))

    # a sentence a row: what it states is judged on its folded form
    parts = rows.where("not pricing").select("question_id", "facts", F.posexplode("planned").alias("seg", "p"))
    again = F.when(F.size(simple_sentences(F.col("p.text"))) > 0, simple_sentences(F.col("p.text"))).otherwise(F.array("p.text"))
    lines = parts.select("question_id", "facts", "seg", "p.paragraph", "p.item_id", F.posexplode(again).alias("at", "sentence"))
    lines = lines.withColumn("norm", normalised(F.col("sentence")))
    of = lambda f: F.coalesce(F.contains("norm", f["norm"]), F.lit(False))
    lines = lines.withColumn("stale", F.try_element_at(F.filter("facts", lambda f: f["expired"] & of(f)), F.lit(1)))
    lines = lines.withColumn("instead", F.try_element_at(F.filter("facts", lambda f: ~f["expired"] & f["kind"].eqNullSafe(F.col("stale.kind"))), F.lit(1)))
    source = lambda kind, i, q: F.struct(F.lit(kind).alias("source_type"), i.alias("source_id"), q.alias("quote"))
    own = F.array(source("knowledge_item", F.col("item_id"), F.col("sentence")))
    cites = F.transform(F.coalesce(F.filter("facts", lambda f: ~f["expired"] & of(f)), F.filter("facts", lambda f: F.lit(False))), lambda f: source("fact", f["fact_id"], f["statement"]))
    kept = F.when(F.col("stale").isNull(), F.col("sentence")).otherwise(F.col("instead.statement"))
    sources = F.when(F.col("stale").isNull(), F.concat(own, F.coalesce(cites, F.array().cast(f"array<{SOURCE}>")))).when(F.col("instead").isNotNull(), F.array(source("fact", F.col("instead.fact_id"), F.col("instead.statement"))))
    gone = F.when(F.col("stale").isNotNull() & F.col("instead").isNull(), F.coalesce("stale.kind", F.lit("fact")))
    lines = lines.select("question_id", "seg", "at", "paragraph", kept.alias("kept"), sources.alias("sources"), gone.alias("gone"))
    told = lines.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("seg", "at", "paragraph", "kept", "sources", "gone"))).alias("told"))

    rows = rows.join(told, "question_id", "left").withColumn("told", F.coalesce("told", F.filter("told", lambda t: F.lit(False))))
    stays = F.filter("told", lambda t: t["kept"].isNotNull())
    rows = rows.withColumn("stays", F.coalesce(stays, F.array().cast(f"array<struct<seg:int,at:int,paragraph:int,kept:string,sources:array<{SOURCE}>,gone:string>>")))
    numbers = F.array_distinct(F.transform("stays", lambda t: t["seg"]))
    of_segment = lambda n: F.filter("stays", lambda t: t["seg"] == n)
    body = F.transform(numbers, lambda n, i: F.struct(
        (i + 1).alias("index"), of_segment(n)[0]["paragraph"].alias("paragraph"), F.lit("substantive").alias("kind"),
        F.array_join(F.transform(of_segment(n), lambda t: t["kept"]), " ").alias("text"), F.flatten(F.transform(of_segment(n), lambda t: t["sources"])).alias("sources"),
    ))
    buyer = strip(F.coalesce("buyer", F.lit("")))
    opener = F.concat(F.lit("We set out below how we meet this requirement"), F.when(buyer != "", F.concat(F.lit(" for "), buyer)).otherwise(""), F.lit(", drawing on our current submissions."))
    head = F.array(F.struct(F.lit(0).alias("index"), F.lit(0).alias("paragraph"), F.lit("connective").alias("kind"), opener.alias("text"), F.array().cast(f"array<{SOURCE}>").alias("sources")))
    segments = F.filter(F.concat(head, body), lambda s: ~F.col("pricing"))
    covered = F.coalesce(F.flatten(F.transform("ranked", lambda c: c["words"])), none)
    missing = F.slice(_uncovered(F.col("text"), covered), 1, NAMED)
    words = F.when(F.size(missing) > 0, F.concat(F.lit("The question also asks about "), F.array_join(missing, ", "), F.lit(", which no candidate or fact covers.")))
    kinds = F.array_distinct(F.filter(F.coalesce(F.transform("told", lambda t: t["gone"]), none), lambda k: k.isNotNull()))
    stale = F.transform(kinds, lambda k: F.concat(F.lit("A current "), k, F.lit(" fact: the only one on file is no longer current.")))
    gaps = F.concat(F.array_compact(F.array(words, F.when(F.col("ranked").isNull(), NOTHING_RETRIEVED))), stale)
    cited = F.array_distinct(F.transform(F.filter(F.flatten(F.transform(segments, lambda s: s["sources"])), lambda s: s["source_type"] == "fact"), lambda s: s["source_id"]))
    return rows.select("question_id", segments.alias("segments"), F.when(F.col("pricing"), F.array(F.lit(PRICING_GAP))).otherwise(gaps).alias("gaps"), cited.alias("fact_ids"))


# Kinds of line, of segment and of source.
LINE_TYPES = ["segment", "gaps", "fact_checklist"]
SEGMENT_KINDS = ["substantive", "connective"]
SOURCE_TYPES = ["knowledge_item", "fact"]
WHOLE_NUMBER = r"\A\s*[+-]?\d+(\.0+)?\s*\z"


def _get(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _is(v: Column, kind: str) -> Column:
    """Whether a variant is of the kind; false for a missing one."""
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _absent_or(v: Column, good: Column) -> Column:
    return v.isNull() | F.coalesce(good, F.lit(False))


def _texts(v: Column, name: str) -> tuple[Column, Column]:
    """A list of texts (empty where missing), and whether it is one."""
    parts = _get(v, name, "array<variant>")
    good = _absent_or(_get(v, name), _is(_get(v, name), "ARRAY") & F.forall(parts, lambda p: _is(p, "STRING")))
    return F.coalesce(_get(v, name, "array<string>"), F.array().cast("array<string>")), good


def _line(v: Column, kind: Column) -> Column:
    """A struct of the fields of a line of this kind, with its problem."""
    text, place, role = _get(v, "text"), _get(v, "paragraph"), _get(v, "kind")
    number = F.try_variant_get(place, "$", "double")
    whole = (F.schema_of_variant(place).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)") & (number == F.floor(number))) | (_is(place, "STRING") & F.try_variant_get(place, "$", "string").rlike(WHOLE_NUMBER))
    named = F.try_variant_get(role, "$", "string")
    sources = _get(v, "sources", "array<variant>")
    source = lambda s: _is(s, "OBJECT") & _is(_get(s, "source_id"), "STRING") & F.coalesce(_get(s, "source_type", "string").isin(SOURCE_TYPES), F.lit(False)) & _absent_or(_get(s, "quote"), _is(_get(s, "quote"), "STRING"))
    cited = F.transform(sources, lambda s: F.struct(_get(s, "source_type", "string").alias("source_type"), _get(s, "source_id", "string").alias("source_id"), F.coalesce(_get(s, "quote", "string"), F.lit("")).alias("quote")))
    gaps, gaps_good = _texts(v, "gaps")
    facts, facts_good = _texts(v, "fact_ids")
    good_segment = (
        _is(text, "STRING") & _absent_or(place, whole) & _absent_or(role, _is(role, "STRING") & named.isin(SEGMENT_KINDS))
        & _absent_or(_get(v, "sources"), _is(_get(v, "sources"), "ARRAY") & F.forall(sources, source))
    )
    good = F.when(kind == "segment", good_segment).when(kind == "gaps", gaps_good).when(kind == "fact_checklist", facts_good)
    problem = F.when(v.isNull(), "not json").when(~F.coalesce(kind.isin(LINE_TYPES), F.lit(False)), "unknown type").when(~F.coalesce(good, F.lit(False)), "bad field")
    segment = problem.isNull() & (kind == "segment")
    return F.struct(
        F.when(problem.isNull(), kind).alias("type"), problem.alias("problem"), F.when(segment, F.try_variant_get(text, "$", "string")).alias("text"),
        F.when(segment, F.coalesce(number, F.lit(0)).cast("int")).alias("paragraph"), F.when(segment, F.coalesce(named, F.lit("substantive"))).alias("kind"),
        F.when(segment, F.coalesce(cited, F.array().cast(f"array<{SOURCE}>"))).alias("sources"),
        F.when(problem.isNull() & (kind == "gaps"), gaps).alias("gaps"), F.when(problem.isNull() & (kind == "fact_checklist"), facts).alias("fact_ids"),
    )


def _own_kind(v: Column) -> Column:
    return F.when(_is(_get(v, "type"), "STRING"), _get(v, "type", "string"))


def _whole_lines(body: Column) -> Column:
    """The lines that one JSON document holds: the objects of an array, or the segments, gaps and facts of an object."""
    pair = lambda v, kind: F.struct(v.alias("v"), kind.alias("kind"))
    objects = lambda parts: F.filter(F.coalesce(parts, F.array().cast("array<variant>")), lambda p: _is(p, "OBJECT"))
    listed = F.transform(objects(F.try_variant_get(body, "$", "array<variant>")), lambda p: pair(p, _own_kind(p)))
    segments = F.transform(objects(_get(body, "segments", "array<variant>")), lambda p: pair(p, F.lit("segment")))
    gaps = F.when(_is(_get(body, "gaps"), "ARRAY"), F.array(pair(body, F.lit("gaps"))))
    checklist = F.coalesce(_get(body, "fact_checklist"), _get(body, "fact_ids"))
    ids = F.transform(F.try_variant_get(checklist, "$", "array<variant>"), lambda e: F.when(_is(e, "OBJECT"), _get(e, "fact_id", "string")).otherwise(F.try_variant_get(e, "$", "string")))
    made = F.try_parse_json(F.to_json(F.struct(F.filter(ids, lambda i: i.isNotNull() & (i != "")).alias("fact_ids"))))
    facts = F.when(_is(checklist, "ARRAY"), F.array(pair(made, F.lit("fact_checklist"))))
    none = F.filter(listed, lambda p: F.lit(False))
    return F.when(_is(body, "ARRAY"), listed).when(_is(body, "OBJECT"), F.concat(segments, F.coalesce(gaps, none), F.coalesce(facts, none))).otherwise(none)


def streamed_lines(chunks: DataFrame) -> DataFrame:
    """stream_id, place, whole, type, problem, text, paragraph, kind, sources, gaps, fact_ids: the lines of each stream.

    chunks: stream_id, position, chunk. A stream is one answer of a model and one row once its chunks are joined;
    a null chunk is empty, equal positions go by text. Each line is a JSON object whose type says which fields it has.
    Blank lines and code fences are passed over. A line that is not JSON, of no known type or with a field of the
    wrong kind is a row with a problem beside the good ones. A stream without any good line is read once more as one
    JSON document, maybe in a code fence (whole is true); its good entries then stand for it, else the problems stay.
    JSON is what VARIANT accepts: an object with a key twice is not JSON.
    """
    streams = chunks.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("position", F.coalesce("chunk", F.lit("")).alias("chunk")))).alias("c"))
    streams = streams.select("stream_id", F.array_join(F.transform("c", lambda c: c["chunk"]), "").alias("body"))
    parts = F.transform(F.split("body", "\n"), lambda x, i: F.struct(i.alias("place"), strip(x).alias("raw")))
    parts = F.filter(parts, lambda p: (p["raw"] != "") & ~F.startswith(p["raw"], F.lit("```")))
    # parsed once, in a step of its own: within one lambda every use of a line would parse it again
    parsed = F.transform(F.transform(parts, lambda p: F.struct(p["place"].alias("place"), F.try_parse_json(p["raw"]).alias("v"))), lambda p: p.withField("kind", _own_kind(p["v"])))
    lines = F.transform(parsed, lambda p: F.struct(p["place"].alias("place"), F.lit(False).alias("whole"), _line(p["v"], p["kind"]).alias("line")))
    read = streams.select("stream_id", "body", lines.alias("lines")).withColumn("some", F.exists("lines", lambda x: x["line"]["problem"].isNull()))
    # the second reading is worked out only for streams without a good line
    bare = strip(F.col("body"))
    inner = F.when(F.startswith(bare, F.lit("```")), strip(F.regexp_replace(F.regexp_replace(bare, r"\A[^\n]*(\n|\z)", ""), r"```\z", ""))).otherwise(bare)
    entries = F.transform(_whole_lines(F.try_parse_json(inner)), lambda p, i: F.struct(i.alias("place"), F.lit(True).alias("whole"), _line(p["v"], p["kind"]).alias("line")))
    good = F.filter(entries, lambda x: x["line"]["problem"].isNull())
    read = read.withColumn("good", F.when(~F.col("some"), good))
    rows = read.select("stream_id", F.explode(F.when(F.coalesce(F.size("good"), F.lit(0)) > 0, F.col("good")).otherwise(F.col("lines"))).alias("x"))
    return rows.select("stream_id", "x.place", "x.whole", "x.line.*")
