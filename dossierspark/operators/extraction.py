"""From sections to pairs, items, facts and requirements.

The layouts of a submission are rules over one window of sections: cells side by side, a numbered heading
with its answer beneath, and labelled questions whose answers follow in rows of their own. All of these are
Column expressions; the queue of labelled questions that wait for an answer is a running maximum, so no
row is visited in Python. Resolution of pairs into spans carries a cursor from pair to pair, which is state
within one window; there sections and pairs are sorted by window and folded by batches.

sections: document_id long, order_index int, text, cell_ref (null for prose), heading_path array<string>.
Null and blank texts have no pairs, questions or requirements. Section ids are order_index as text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import spans
from ..functions import text as T
from ..settings import DEFAULTS, TOPICS
from .batching import token_windows
from .components import in_order

QUESTION_LABEL = r"(?U)\AQuestion \d+(?:\.\d+)*\z"
NUMBERED_HEADING = r"(?U)\A\d+(?:\.\d+)+\s+\S"
OBLIGATION = r"(?iU)\b(must|shall|should|could|required)\b"
LEADING_REF = r"(?U)\A((?:[A-Z]{1,4}[- ]?)?\d+(?:\.\d+)*)[.):]?\s+"
REF_CELL = r"(?U)\A(?:[A-Z]{1,4}[- ]?)?\d+(?:\.\d+)*\z"
# Priority words of requirement rows, response types and columns of a question sheet, words of an instruction.
ROW_PRIORITIES = {
    "must": "must", "shall": "must", "required": "must", "mandatory": "must", "essential": "must", "m": "must",
    "should": "should", "desirable": "should", "s": "should",
    "could": "could", "optional": "could", "c": "could",
}
RESPONSE_TYPES = {"free text": "free_text", "yes/no": "yes_no", "attachment": "attachment", "table": "table", "pricing": "pricing", "other": "other"}
PACK_COLUMNS = ["section", "number", "question", "word limit", "weighting", "response type", "mandatory"]
INSTRUCTION_WORDS = ["short", "bullet", "tone", "reword", "rewrite", "formal", "concise", "expand", "longer", "paragraph", "tighten", "simplif"]


def windowed(sections: DataFrame, limit: int = DEFAULTS.pair_window_tokens) -> DataFrame:
    """sections with their window, the last of a window in the next one too."""
    at = token_windows(sections.withColumn("tokens", T.estimate_tokens(F.coalesce("text", F.lit("")))), limit)
    return at.join(sections, ["document_id", "order_index"])


def _cells(c: Column) -> Column:
    return F.transform(F.split(c, r" \| "), T.strip)


def _labelled(lines: Column) -> Column:
    """The lines that follow a question label, of the lines that are not blank."""
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        taken = F.struct(F.lit(False).alias("open"), F.concat(acc["found"], F.array(line)).alias("found"))
        return F.when(acc["open"], taken).otherwise(F.struct(line.rlike(QUESTION_LABEL).alias("open"), acc["found"].alias("found")))

    return F.aggregate(F.filter(lines, lambda x: x != ""), start, step, lambda acc: acc["found"])


def pair_events(sections: DataFrame) -> DataFrame:
    """What a section says, in order: whole pairs, questions that wait, answers on their own."""
    text = T.strip(F.coalesce("text", F.lit("")))
    kept = sections.select("document_id", "window", "order_index", "cell_ref", text.alias("text")).where("text <> ''")
    kept = kept.withColumn("cells", _cells(F.col("text"))).withColumn("lines", F.transform(F.split("text", "\n"), T.strip))
    event = lambda kind, q, a: F.struct(F.lit(kind).alias("kind"), q.cast("string").alias("question"), a.cast("string").alias("answer"))
    none = F.lit(None)
    first, last, n = F.element_at("cells", 1), F.element_at("cells", -1), F.size("cells")
    row = F.when((n >= 2) & (first != "") & (last != ""), event("pair", first, last)).otherwise(event("answer", none, F.col("text")))
    below = T.strip(F.array_join(F.slice("lines", 2, F.greatest(F.lit(1), F.size("lines"))), "\n"))
    headed = (F.size("lines") > 1) & F.element_at("lines", 1).rlike(NUMBERED_HEADING) & (below != "")
    asked = F.transform(_labelled(F.col("lines")), lambda q: event("question", q, none))
    events = (
        F.when(F.col("cell_ref").isNotNull(), F.array(row))
        .when(F.exists("lines", lambda x: x.rlike(QUESTION_LABEL)), asked)
        .when(headed, F.array(event("pair", F.element_at("lines", 1), below)))
    )
    return kept.select("document_id", "window", "order_index", F.posexplode(events).alias("sub", "e")).select("document_id", "window", "order_index", "sub", "e.*")


def extracted_pairs(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, fragments) of each window (document_id, window), numbered by seq in reading order.

    An answer on its own takes the window's oldest question that still waits. With a answers and q questions
    read so far, u = the greatest a - q at any point so far (0 at least) answers found none waiting; so an
    answer that does not raise u takes question number a - u.
    """
    within = Window.partitionBy("document_id", "window").orderBy("order_index", "sub")
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).over(within)
    numbered = pair_events(sections).withColumn("q", count("question")).withColumn("a", count("answer"))
    numbered = numbered.withColumn("u", F.greatest(F.lit(0), F.max(F.col("a") - F.col("q")).over(within)))
    numbered = numbered.withColumn("alone", F.col("u") > F.coalesce(F.lag("u").over(within), F.lit(0)))
    met = F.when(F.col("kind") == "question", F.col("q")).when((F.col("kind") == "answer") & ~F.col("alone"), F.col("a") - F.col("u"))
    side = F.struct("order_index", "sub", "question", "answer")
    both = numbered.withColumn("k", met).where("k is not null").groupBy("document_id", "window", "k").agg(
        F.max(F.when(F.col("kind") == "question", side)).alias("asked"), F.max(F.when(F.col("kind") == "answer", side)).alias("said")
    )
    direct = numbered.where("kind = 'pair'").select("document_id", "window", "order_index", "sub", F.col("order_index").alias("question_at"), "question", "answer")
    queued = both.where("said is not null").select("document_id", "window", "said.order_index", "said.sub", F.col("asked.order_index").alias("question_at"), "asked.question", "said.answer")
    q, a = F.col("question"), F.col("answer")
    pairs = direct.union(queued).select(
        "document_id",
        "window",
        F.row_number().over(within).alias("seq"),
        F.col("question_at").cast("string").alias("question_section"),
        F.col("order_index").cast("string").alias("answer_section"),
        T.first_words(q).alias("question_first"),
        T.last_words(q).alias("question_last"),
        T.first_words(a).alias("answer_first"),
        T.last_words(a).alias("answer_last"),
        q.alias("question_copy"),
        a.alias("answer_copy"),
        T.topics_for(F.concat_ws(" ", q, a)).alias("topics"),
        T.facts_of_text(a).alias("facts"),
    )
    spare = both.where("said is null").select("document_id", "window", F.lit("question").alias("role"), "asked.order_index", "asked.sub", F.col("asked.question").alias("text"))
    orphans = numbered.where("kind = 'answer' and alone").select("document_id", "window", F.lit("answer").alias("role"), "order_index", "sub", F.col("answer").alias("text"))
    fragments = spare.union(orphans).select(
        "document_id", "window", "role", F.row_number().over(Window.partitionBy("document_id", "window").orderBy("role", "order_index", "sub")).alias("seq"), F.col("order_index").cast("string").alias("section"), "text"
    )
    return pairs, fragments


def pack_questions(sections: DataFrame) -> DataFrame:
    """One question for each row of a question sheet; cells by the header in the heading path, else by place."""
    header = F.transform("heading_path", lambda p: F.lower(p))
    place = lambda name: F.array_position("header", name)
    rows = sections.where(F.col("cell_ref").isNotNull() & F.contains(F.col("text"), F.lit(" | "))).withColumn("cells", _cells(F.col("text"))).withColumn("header", header)
    offset = F.greatest(place("section"), F.lit(1))

    def cell(name: str) -> Column:
        at = F.when(place(name) > 0, place(name) - offset).otherwise(PACK_COLUMNS.index(name))
        return F.when(at >= 0, F.coalesce(F.get("cells", at.cast("int")), F.lit(""))).otherwise("")

    number = lambda c: F.when(c.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), c.try_cast("double"))
    kind = F.lower(cell("response type"))
    limit = number(cell("word limit"))
    kept = rows.select(
        "document_id",
        "order_index",
        F.when(cell("section") != "", cell("section")).otherwise(F.coalesce(F.get("heading_path", F.lit(0)), F.lit(""))).alias("section"),
        cell("number").alias("number"),
        cell("question").alias("text"),
        F.when(limit != 0, F.floor(F.abs(limit)) * F.signum(limit)).cast("int").alias("word_limit"),
        number(cell("weighting")).alias("weighting"),
        F.coalesce(*[F.when(kind == k, v) for k, v in RESPONSE_TYPES.items()], F.lit("free_text")).alias("response_type"),
        (F.lower(cell("mandatory")) == "yes").alias("mandatory"),
    ).where((F.col("text") != "") & (F.lower("text") != "question"))
    at = F.row_number().over(Window.partitionBy("document_id").orderBy("order_index")) - 1
    return kept.withColumn("place", at).withColumn("topics", T.topics_for(F.concat_ws(" ", "section", "text")))


def extracted_requirements(sections: DataFrame) -> DataFrame:
    """Obligations of rows and sentences with reference, priority and topics; question sheets are passed over.

    sub is the place within the section: 0 in a row, else the number of the sentence.
    """
    sheet = F.exists("heading_path", lambda p: F.lower(T.strip(p)) == "question")
    kept = sections.where(~F.coalesce(sheet, F.lit(False)))
    priorities = F.create_map(*[F.lit(x) for kv in ROW_PRIORITIES.items() for x in kv])
    word = lambda c: F.regexp_extract(c, OBLIGATION, 1)
    cells = kept.where(F.col("cell_ref").isNotNull()).withColumn("cells", _cells(T.strip(F.coalesce("text", F.lit("")))))
    cells = cells.withColumn("ref", F.get(F.filter("cells", lambda c: c.rlike(REF_CELL)), F.lit(0)))
    cells = cells.withColumn("level_at", F.array_position(F.transform("cells", lambda c: F.lower(c).isin(list(ROW_PRIORITIES))), True))
    said = F.filter("cells", lambda c, i: (i != F.col("level_at") - 1) & c.rlike(OBLIGATION) & ~F.endswith(c, F.lit("?")))
    level = F.when(F.col("level_at") > 0, F.get("cells", (F.col("level_at") - 1).cast("int")))
    rows = cells.withColumn("said", F.get(said, F.lit(0))).where("said is not null").select(
        "document_id", "order_index", F.lit(0).alias("sub"), "ref", F.col("said").alias("text"), priorities[F.lower(F.coalesce(level, word(F.col("said"))))].alias("priority")
    )
    prose = kept.where(F.col("cell_ref").isNull()).select("document_id", "order_index", F.posexplode(T.simple_sentences(F.coalesce("text", F.lit("")))).alias("sub", "s"))
    prose = prose.where(F.col("s").rlike(OBLIGATION) & ~F.endswith(F.col("s"), F.lit("?")))
    prose = prose.select(
        "document_id",
        "order_index",
        "sub",
        F.nullif(F.regexp_extract("s", LEADING_REF, 1), F.lit("")).alias("ref"),
        T.strip(F.regexp_replace("s", LEADING_REF, "")).alias("text"),
        priorities[F.lower(word(F.col("s")))].alias("priority"),
    ).where("text <> ''")
    return rows.union(prose).withColumn("topics", T.topics_for(F.col("text")))


def classified(docs: DataFrame) -> DataFrame:
    """doc_type, doc_kind, effective_date, buyer of a document's text (document_id, text)."""
    text, low = F.col("text"), F.lower("text")
    buyer = T.strip(F.regexp_extract(text, r"(?m)^Buyer: (.+)$", 1))
    sent = T.british_date(F.regexp_extract(text, rf"Submitted by .+? on ({T.DATE})\.", 1))
    past = (buyer != "") & sent.isNotNull()
    issued = T.british_date(F.regexp_extract(text, T.CERTIFICATE_ISSUED, 1))
    has = lambda *words: _any(low, words)
    kind = (
        F.when(has("certificate") & has("iso/iec 27001", "iso 27001"), "iso_27001")
        .when(has("cyber essentials") & has("certificate"), "cyber_essentials_plus")
        .when(has("data security and protection toolkit"), "dspt_confirmation")
        .when(has("clinical safety case", "hazard log"), "clinical_safety_case")
        .when(has("policy"), "information_security_policy")
        .otherwise("other")
    )
    return docs.select(
        "document_id",
        F.when(past, "past_submission").otherwise("reference").alias("doc_type"),
        F.when(~past, kind).alias("doc_kind"),
        F.when(past, sent).otherwise(issued).alias("effective_date"),
        F.when(past, buyer).alias("buyer"),
    )


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def rewritten_query(latest: Column, tender_question: Column) -> Column:
    """The latest turn; for an instruction about the draft the tender question, where there is one."""
    told = _any(F.lower(latest), tuple(INSTRUCTION_WORDS)) & (F.coalesce(T.strip(tender_question), F.lit("")) != "")
    return F.when(told, T.strip(tender_question)).otherwise(T.strip(latest))


RESOLVED = (
    "document_id long, window int, seq int, answer_section string, answer_start int, answer_end int, by_anchors boolean, answer_text string, "
    "question_section string, question_start int, question_end int, question_text string, verified boolean, answer_key string"
)


class _Resolver:
    """Reads a window's sections, then its pairs in order; holds the sections, each folded once, and a cursor for each."""

    def __init__(self):
        self.texts: dict[str, str] = {}
        self.forms: dict[str, tuple] = {}
        self.window: list[str] = []
        self.cursors: dict[str, int] = {}
        self.nowhere: set[str] = set()

    def eval(self, row: dict) -> tuple | None:
        """The item of a pair; None for a section, or a pair whose answer is nowhere."""
        if row["kind"] == 0:
            self.texts[row["section"]] = row["text"] or ""
            if row["in_window"]:
                self.window.append(row["section"])
            return None
        copy = row["answer_copy"] or ""
        section, span = self.place(row["answer_section"], row["answer_first"], row["answer_last"], copy)
        text = self.texts[section][span["start"] : span["end"]] if span else copy.strip()
        if section is None or not text.strip():
            return None
        copy = row["question_copy"] or ""
        asked, at = self.place(row["question_section"], row["question_first"], row["question_last"], copy)
        question = self.texts[asked][at["start"] : at["end"]] if at else copy.strip()
        for s, found in ((section, span), (asked, at)):
            if found:
                self.cursors[s] = max(self.cursors.get(s, 0), found["end"])
        apart = asked is not None and asked != section
        key = f"{span['start']}-{span['end']}" if span else "copy:" + spans.folded_text(text)
        return (
            row["document_id"], row["window"], row["seq"], section, span["start"] if span else 0, span["end"] if span else 0, bool(span and span["by_anchors"]), text,
            asked if apart else None, at["start"] if at else None, at["end"] if at else None, question or None, span is not None, key,
        )

    def form(self, section: str) -> tuple:
        if section not in self.forms:
            self.forms[section] = spans.folded(self.texts[section])
        return self.forms[section]

    def place(self, name: str | None, first: str | None, last: str | None, copied: str) -> tuple[str | None, dict | None]:
        """The section a pair names and the span in it; for an unknown name the window's first section with the copy."""
        name = (name or "").strip()
        copied = spans.folded_text(copied)
        if name in self.texts:
            return name, spans.anchored_folded(*self.form(name), spans.folded_text(first or ""), spans.folded_text(last or ""), copied, self.cursors.get(name, 0))
        if copied and copied not in self.nowhere:
            for section in self.window:
                found = spans.locate_folded(copied, *self.form(section))
                if found:
                    return section, {"start": found["start"], "end": found["end"], "by_anchors": False}
            self.nowhere.add(copied)
        return None, None


def _resolved():
    """The items of rows that come sorted by window, sections before pairs."""
    schema = to_arrow_schema(_parse_datatype_string(RESOLVED))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, _Resolver()
        for batch in batches:
            items = []
            for row in batch.to_pylist():
                if (row["document_id"], row["window"]) != now:
                    now, held = (row["document_id"], row["window"]), _Resolver()
                item = held.eval(row)
                if item:
                    items.append(item)
            columns = zip(*items) if items else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return fold


PAIR = "answer_section answer_first answer_last answer_copy question_section question_first question_last question_copy".split()


def resolved_pairs(sections: DataFrame, pairs: DataFrame) -> DataFrame:
    """Items: pairs with their spans; pairs whose answer is nowhere are dropped, repeats in the overlap collapsed.

    sections: as windowed() gives them. pairs: document_id, window, seq and the columns of PAIR, as a model or
    extracted_pairs() gives them. A section that a pair names counts wherever in the document it stands; for an
    unknown name the window's sections are searched in order. Of equal answer spans (or, where none is found,
    equal normal forms) of a document the first by window and seq stays.
    """
    texts = sections.select("document_id", "window", F.col("order_index").cast("string").alias("section"), "order_index", "text")
    named = pairs.select("document_id", "window", F.explode(F.array("answer_section", "question_section")).alias("section"))
    named = named.select("document_id", "window", T.strip(F.col("section")).alias("section")).distinct()
    far = named.join(texts.dropDuplicates(["document_id", "section"]).drop("window"), ["document_id", "section"]).join(texts.select("document_id", "window", "section"), ["document_id", "window", "section"], "left_anti")
    blank = [F.lit(None).cast("string").alias(c) for c in PAIR]
    near = texts.select("document_id", "window", F.lit(0).alias("kind"), F.col("order_index").alias("seq"), "section", F.lit(True).alias("in_window"), "text", *blank)
    far = far.select("document_id", "window", F.lit(0).alias("kind"), F.col("order_index").alias("seq"), "section", F.lit(False).alias("in_window"), "text", *blank)
    asked = pairs.select("document_id", "window", F.lit(1).alias("kind"), "seq", F.lit(None).cast("string").alias("section"), F.lit(False).alias("in_window"), F.lit(None).cast("string").alias("text"), *PAIR)
    items = in_order(near.union(far).union(asked), ["document_id", "window"], "kind", "seq").mapInArrow(_resolved(), RESOLVED)
    first = F.row_number().over(Window.partitionBy("document_id", "answer_section", "answer_key").orderBy("window", "seq"))
    return items.withColumn("n", first).where("n = 1").drop("n")


def item_topics_and_facts(items: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics of each item, facts with a known kind, statement and value) from the pairs the items came from."""
    own = items.select("document_id", "window", "seq", "answer_section").join(pairs.select("document_id", "window", "seq", "topics", "facts"), ["document_id", "window", "seq"])
    topics = own.select("document_id", "window", "seq", T.clean_topics(F.col("topics"), TOPICS, lower=False, most=None).alias("topics"))
    facts = own.select("document_id", "window", "seq", F.col("answer_section").alias("section"), F.posexplode("facts").alias("place", "f"))
    facts = facts.select(
        "document_id", "window", "seq", "section", "place", T.strip(F.col("f.statement")).alias("statement"), "f.fact.kind",
        T.fact_key(F.col("f.fact.kind"), F.col("f.fact.key")).alias("key"), T.strip(F.col("f.fact.value")).alias("value"), "f.fact.effective_date", "f.fact.expires_on",
    )
    return topics, facts.where("kind is not null and statement <> '' and value <> ''")


def resolved_fragments(sections: DataFrame, fragments: DataFrame) -> DataFrame:
    """Fragments of known sections, once for each section and normal form, with their spans where they are found."""
    texts = sections.select("document_id", F.col("order_index").cast("string").alias("section"), F.col("text").alias("body")).dropDuplicates(["document_id", "section"])
    said = fragments.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).where("text <> ''").withColumn("section", T.strip(F.col("section")))
    said = said.join(texts, ["document_id", "section"]).withColumn("normal", spans.normalised("text"))
    first = F.row_number().over(Window.partitionBy("document_id", "section", "normal").orderBy("window", "seq"))
    said = said.withColumn("n", first).where("n = 1").withColumn("at", spans.find_span("text", "body"))
    length = F.col("at.end") - F.col("at.start")
    return said.select(
        "document_id", "section", "role", F.coalesce(F.substring(F.col("body"), F.col("at.start") + 1, length), F.col("text")).alias("text"), "at.start", "at.end"
    )
