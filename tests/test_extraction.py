"""Pairs, items, questions and requirements of sectioned documents against plain loops."""

import random
import re

from pyspark.sql import functions as F

from dossierspark.functions import spans
from dossierspark.operators import extraction as E

SECTIONS = "document_id long, order_index int, text string, cell_ref string, heading_path array<string>"


def loop_windows(rows, limit):
    out, current, used = [], [], 0
    for r in rows:
        cost = max(1, len(r[2] or "") // 4) + 30
        if current and used + cost > limit:
            out.append(current)
            current, used = [current[-1]], max(1, len(current[-1][2] or "") // 4) + 30
        current = [*current, r]
        used += cost
    return [*out, current] if current else out


def loop_pairs(window):
    pairs, fragments, waiting = [], [], []
    for _, at, text, ref, _ in window:
        text = (text or "").strip()
        if not text:
            continue
        lines = [x.strip() for x in text.split("\n")]
        if ref is not None:
            cells = [c.strip() for c in text.split(" | ")]
            if len(cells) > 1 and cells[0] and cells[-1]:
                pairs.append((at, at, cells[0], cells[-1]))
            elif waiting:
                q_at, q = waiting.pop(0)
                pairs.append((q_at, at, q, text))
            else:
                fragments.append(("answer", at, text))
        elif any(re.match(r"^Question \d+(?:\.\d+)*$", x) for x in lines):
            rest = [x for x in lines if x]
            while rest:
                x = rest.pop(0)
                if re.match(r"^Question \d+(?:\.\d+)*$", x) and rest:
                    waiting.append((at, rest.pop(0)))
        elif len(lines) > 1 and re.match(r"^\d+(?:\.\d+)+\s+\S", lines[0]):
            answer = "\n".join(lines[1:]).strip()
            if answer:
                pairs.append((at, at, lines[0], answer))
    return pairs, [*fragments, *(("question", at, q) for at, q in waiting)]


def layout(seed, n):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice("alpha beta gamma delta Über-\nlang epsilon, zeta. Eta".split(" ")) for _ in range(rng.randrange(1, k)))
    rows, doc = [], 0
    for i in range(n):
        kind = rng.randrange(8)
        text, ref = {
            0: (f"{say(9)} | x | {say(30)}", f"A{i}"),
            1: (f"{say(20).replace(' | ', ' ')}", f"B{i}"),
            2: (f"Question {i}\n\n{say(9)}\nnoise\n Question {i}.2 \nQuestion 9\n{say(7)}\nQuestion 4", None),
            3: (f"{i}.1 {say(6)}\n{say(40)}\n\n{say(5)}  ", None),
            4: (say(30), None),
            5: (rng.choice([None, "", " \n "]), rng.choice([None, "C1"])),
            6: (f"3.1 heading alone\n \n", None),
            7: (f" | {say(9)}", "D1"),
        }[kind]
        doc += rng.random() < 0.04
        rows.append((doc, i, text, ref, ["Sheet"]))
    return rows


def windows_of(rows, limit):
    docs = {}
    for r in rows:
        docs.setdefault(r[0], []).append(r)
    return {(d, w): window for d, own in docs.items() for w, window in enumerate(loop_windows(own, limit))}


def test_windows_pairs_and_fragments(spark):
    rows = layout(1, 700)
    sections = E.windowed(spark.createDataFrame(rows, SECTIONS), 400)
    want = windows_of(rows, 400)
    got = {}
    for r in sections.select("document_id", "window", "order_index").collect():
        got.setdefault((r[0], r[1]), []).append(r[2])
    assert {k: sorted(v) for k, v in got.items()} == {k: [r[1] for r in v] for k, v in want.items()}
    pairs, fragments = E.extracted_pairs(sections)
    found = {}
    for r in pairs.orderBy("document_id", "window", "seq").collect():
        found.setdefault((r["document_id"], r["window"]), []).append((int(r["question_section"]), int(r["answer_section"]), r["question_copy"], r["answer_copy"]))
    assert found == {k: v for k, w in want.items() if (v := loop_pairs(w)[0])}
    spare = sorted((r["document_id"], r["window"], r["role"], int(r["section"]), r["text"]) for r in fragments.collect())
    assert spare == sorted((*k, *f) for k, w in want.items() for f in loop_pairs(w)[1])
    assert sum(f[2] == "question" for f in spare) > 20 and sum(f[2] == "answer" for f in spare) > 20


def loop_items(windows, pairs):
    out, seen = [], set()
    texts = {(d, str(r[1])): r[2] or "" for (d, _), w in windows.items() for r in w}
    for (d, w), window in sorted(windows.items()):
        cursors = {}

        def place(name, first, last, copy):
            name = name.strip()
            if (d, name) in texts:
                return name, spans.locate_anchored(texts[d, name], first, last, copy, cursors.get(name, 0))
            for r in window if copy.strip() else []:
                found = spans.locate(copy, r[2] or "")
                if found:
                    return str(r[1]), {**found, "by_anchors": False}
            return None, None

        for seq, p in enumerate(pairs.get((d, w), []), 1):
            section, span = place(p["answer_section"], p["answer_first"], p["answer_last"], p["answer_copy"])
            text = texts[d, section][span["start"] : span["end"]] if span else p["answer_copy"].strip()
            if section is None or not text.strip():
                continue
            asked, at = place(p["question_section"], p["question_first"], p["question_last"], p["question_copy"])
            for s, f in ((section, span), (asked, at)):
                if f:
                    cursors[s] = max(cursors.get(s, 0), f["end"])
            key = (d, section, (span["start"], span["end"]) if span else spans.folded_text(text))
            if key in seen:
                continue
            seen.add(key)
            question = texts[d, asked][at["start"] : at["end"]] if at else p["question_copy"].strip()
            out.append((d, w, seq, section, span["start"] if span else 0, span["end"] if span else 0, bool(span and span["by_anchors"]), text, question or None, span is not None))
    return sorted(out)


def damaged(rng, p):
    p = dict(p)
    kind = rng.randrange(8)
    if kind == 0:
        p["answer_section"] = "none"
    elif kind == 1:
        p["answer_section"], p["answer_copy"] = "none", "words that stand nowhere at all"
    elif kind == 2:
        p["answer_first"] = "not there"
    elif kind == 3:
        p["answer_first"], p["answer_copy"] = "not there", " nor this "
    elif kind == 4:
        p["question_section"], p["question_copy"] = " x ", p["question_copy"].upper()
    elif kind == 5:
        p["answer_copy"] = " "
        p["answer_first"] = ""
    return p


def test_items_equal_a_plain_loop(spark):
    rows = layout(2, 300)
    sections = E.windowed(spark.createDataFrame(rows, SECTIONS), 400)
    pairs = E.extracted_pairs(sections)[0].drop("topics", "facts")
    rng, own = random.Random(5), {}
    for r in pairs.orderBy("document_id", "window", "seq").collect():
        p = damaged(rng, r.asDict())
        own.setdefault((r["document_id"], r["window"]), []).append(p)
        if rng.random() < 0.3:  # the same pair again, and one that names a section of another window
            own[r["document_id"], r["window"]].append({**p, "answer_section": rng.choice([p["answer_section"], "3", "40"])})
    flat = [{**p, "seq": i} for v in own.values() for i, p in enumerate(v, 1)]
    kinds = "document_id long, window int, seq int, " + ", ".join(f"{c} string" for c in E.PAIR)
    given = spark.createDataFrame([tuple(p[c.split()[0]] for c in kinds.split(", ")) for p in flat], kinds)
    got = E.resolved_pairs(sections, given)
    names = ["document_id", "window", "seq", "answer_section", "answer_start", "answer_end", "by_anchors", "answer_text", "question_text", "verified"]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == loop_items(windows_of(rows, 400), own)


def test_cursor_moves_from_pair_to_pair(spark):
    """Three answers with equal first words: each is searched behind the one before it."""
    body = "We hold it now. One done. We hold it now. Two done. We hold it now. Three done."
    rows = [(1, 0, body, None, []), (1, 1, body, None, [])]
    sections = E.windowed(spark.createDataFrame(rows, SECTIONS))
    copies = ["We hold it now. One done.", "We hold it now. Two done.", "We hold it now. Three done."]
    given = [(1, 0, i, "0", "We hold it", c.split(". ")[1], c, "1", "We hold it", c.split(". ")[1], c) for i, c in enumerate(copies, 1)]
    kinds = "document_id long, window int, seq int, " + ", ".join(f"{c} string" for c in E.PAIR)
    got = E.resolved_pairs(sections, spark.createDataFrame(given, kinds)).orderBy("seq").collect()
    assert [r["answer_text"] for r in got] == copies == [r["question_text"] for r in got] and all(r["by_anchors"] for r in got)
    assert [(r["answer_start"], r["question_start"]) for r in got] == [(0, 0), (26, 26), (52, 52)]


def test_question_sheet(spark):
    head = ["Pack", "Section", "Number", "Question", "Word limit", "Mandatory"]
    rows = [
        (1, 0, "Safety | 1.1 | Who signs? | 250 | YES", "A1", head),
        (1, 1, "Section | Number | Question | Word limit | Mandatory", "A2", head),
        (1, 2, " | 2 | What now? | n/a | no", "A3", head),
        (1, 3, "no bar", "A4", head),
        (1, 4, "S | 3 | Priced? | 1e2 | 7.5 | Pricing | yes", "A5", None),
        (2, 0, "S | 3 | Fourth | 0 | 10", "A1", ["Only"]),
        (2, 1, "prose | with | bars", None, head),
    ]
    got = E.pack_questions(spark.createDataFrame(rows, SECTIONS)).orderBy("document_id", "order_index").drop("topics").collect()
    assert [tuple(r) for r in got] == [
        (1, 0, "Safety", "1.1", "Who signs?", 250, None, "free_text", True, 0),
        (1, 2, "Pack", "2", "What now?", None, None, "free_text", False, 1),
        (1, 4, "S", "3", "Priced?", 100, 7.5, "pricing", True, 2),
        (2, 0, "S", "3", "Fourth", None, 10.0, "free_text", False, 0),
    ]


def test_requirements(spark):
    rows = [
        (1, 0, "R1 | The system must scale. | Should", "A1", ["Spec"]),
        (1, 1, "Ref | Requirement | Priority", "A2", ["Spec"]),
        (1, 2, "What must hold? | It shall hold", "A3", []),
        (1, 3, "Must | It required nothing", "A4", None),
        (1, 4, "The supplier must act.", "A5", ["Pack", " Question "]),
        (1, 5, "2.1) Staff shall be trained. Must they? It could help.\nNo duty here. A-3 Should log.\nB 4: must", None, ["Spec"]),
        (1, 6, None, None, None),
    ]
    got = E.extracted_requirements(spark.createDataFrame(rows, SECTIONS)).orderBy("order_index", "sub").drop("topics").collect()
    assert [tuple(r)[1:] for r in got] == [
        (0, 0, "R1", "The system must scale.", "should"),
        (2, 0, None, "It shall hold", "must"),
        (3, 0, None, "It required nothing", "must"),
        (5, 0, "2.1", "Staff shall be trained.", "must"),
        (5, 2, None, "It could help.", "could"),
        (5, 4, "A-3", "Should log.", "should"),
        (5, 5, "B 4", "must", "must"),
    ]


def test_classification_and_rewrites(spark):
    texts = [
        "Buyer: A Trust\nSubmitted by Us Ltd on 3 March 2024.", "ISO 27001 certificate\nCertificate issued 1 May 2023", "Cyber Essentials certificate",
        "Data Security and Protection Toolkit", "Hazard log", "A policy", "nothing",
    ]
    got = E.classified(spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")).orderBy("document_id").collect()
    assert [(r["doc_type"], r["doc_kind"], r["effective_date"] and r["effective_date"].isoformat(), r["buyer"]) for r in got] == [
        ("past_submission", None, "2024-03-03", "A Trust"), ("reference", "iso_27001", "2023-05-01", None), ("reference", "cyber_essentials_plus", None, None),
        ("reference", "dspt_confirmation", None, None), ("reference", "clinical_safety_case", None, None), ("reference", "information_security_policy", None, None), ("reference", "other", None, None),
    ]
    said = spark.createDataFrame([("Make it SHORTER ", " What is it?\n"), ("more", "Q"), ("reword", None)], "a string, b string")
    assert [r[0] for r in said.select(E.rewritten_query(F.col("a"), F.col("b"))).collect()] == ["What is it?", "more", "reword"]


def test_empty(spark):
    sections = E.windowed(spark.createDataFrame([], SECTIONS))
    pairs, fragments = E.extracted_pairs(sections)
    assert pairs.count() == 0 and fragments.count() == 0 and E.resolved_pairs(sections, pairs).count() == 0


def test_pairs_are_resolved_over_batch_borders(spark):
    word = lambda n: "abcdefgh"[n] * 12
    kinds = "document_id long, window int, seq int, " + ", ".join(f"{c} string" for c in E.PAIR)
    sections = spark.createDataFrame([(d, 0, i, f"Question {d}, {word(i)}? Answer é {word(i + 4)} {d}.") for d in range(5) for i in range(4)], "document_id long, window int, order_index int, text string")
    given = [(d, 0, i, "none" if i % 2 else str(i), "not", "there", f"Answer É {word(i + 4)} {d}.", "none", "x", "y", f"question {d}, {word(i)}?") for d in range(5) for i in range(4)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        items = E.resolved_pairs(sections, spark.createDataFrame(given, kinds))
        got = sorted((r["document_id"], r["answer_section"], r["answer_text"], r["question_text"], r["verified"]) for r in items.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(d, str(i), f"Answer é {word(i + 4)} {d}.", f"Question {d}, {word(i)}?", True) for d in range(5) for i in range(4)]
    assert "UDTF" not in items._jdf.queryExecution().toString()
