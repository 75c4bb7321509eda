import random

from pyspark.sql import functions as F

from dossierspark.operators import answers as A
from dossierspark.operators import listing as L
from dossierspark.operators import verification as V


def test_verbatim_segments_stand_where_they_say(spark):
    text = "One sentence here. Another one!\n\nA new paragraph."
    rows = V.verbatim_segments(spark.createDataFrame([(1, text, 7), (2, None, 0), (3, "", 0)], "item_id long, text string, base int")).collect()
    assert [(r["item_id"], r["index"], r["paragraph"], text[r["start"] - 7 : r["end"] - 7]) for r in rows] == [
        (1, 0, 0, "One sentence here."), (1, 1, 0, "Another one!"), (1, 2, 1, "A new paragraph."),
    ]


def test_sources_are_located(spark):
    cited = spark.createDataFrame([(1, "knowledge_item", 5, "an “exact” quote"), (2, "knowledge_item", 5, " "), (3, "fact", 8, "a paraphrase of sorts"), (4, "fact", 9, "gone"), (5, "human_attestation", None, None)], "n int, source_type string, source_id long, quote string")
    items = spark.createDataFrame([(5, 'With an "exact"  quote inside.', 30)], "item_id long, text string, base int")
    facts = spark.createDataFrame([(8, "We employ 9 staff.", "Intro. We employ 9 staff. End.", False), (9, "Nowhere to be found at all.", "Other.", True)], "fact_id long, statement string, section_text string, is_current boolean")
    found = {r["n"]: (r["found"], r["start"], r["end"], r["span_text"]) for r in V.located_sources(cited, items, facts).collect()}
    assert found == {1: (True, 35, 52, 'an "exact"  quote'), 2: (False, None, None, None), 3: (True, 7, 25, "We employ 9 staff."), 4: (False, None, None, None), 5: (False, None, None, None)}


def test_a_quote_is_looked_for_once_in_its_source(spark, tmp_path):
    cited = spark.range(600).selectExpr("id as n", "case when id % 3 = 2 then 'other' else 'knowledge_item' end as source_type", "id % 2 as source_id", "case when id % 5 > 0 then 'b c' end as quote")
    items = spark.createDataFrame([(0, "a B  c d", 10), (1, "no", 0)], "item_id long, text string, base int")
    facts = spark.createDataFrame([], "fact_id long, statement string, section_text string, is_current boolean")
    located = V.located_sources(cited, items, facts)
    rows = located.collect()
    assert len(rows) == 600 and all(r["found"] == (r["n"] % 3 < 2 and r["n"] % 2 == 0 and r["n"] % 5 > 0) for r in rows)
    assert {(r["start"], r["end"], r["span_text"]) for r in rows if r["found"]} == {(12, 16, "B  c")}
    plan = located._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("ArrowEvalPython") :]  # below the search: cited quotes, once each


def test_a_second_invalidation_finds_nothing(spark):
    seg = "array<struct<index:int,kind:string,support_status:string,sources:array<string>>>"
    answers = spark.createDataFrame(
        [(1, 1, False, [(0, "substantive", "supported", ["f"]), (1, "connective", "connective", ["f"])], [("f", "current")]), (2, 2, False, [(0, "substantive", "supported", ["g"])], [])],
        f"answer_id int, question_id int, needs_review boolean, segments {seg}, checklist array<struct<fact_id:string,status:string>>",
    )
    stale = spark.createDataFrame([("f", "expired"), ("f", "superseded")], "source_id string, reason string")
    once = V.invalidation_effects(answers, stale)
    row = once.collect()
    assert [(r["answer_id"], r["changed"], r["n_checklist"], r["needs_review"], r["checklist"][0]["status"]) for r in row] == [(1, [0], 1, True, "superseded")]
    assert V.invalidation_effects(once.select(*answers.columns), stale).count() == 0


def test_attested_disputes_end(spark):
    seg = "array<struct<index:int,paragraph:int,text:string,kind:string,support_status:string,sources:array<string>,dispute:string>>"
    answers = spark.createDataFrame([(1, [(0, 0, "x", "substantive", "unsupported", ["a"], "bob: no"), (1, 0, "y", "substantive", "supported", ["b"], None)], None)], f"answer_id int, segments {seg}, needs_review boolean")
    actions = spark.createDataFrame([(1, 0, "attest", "ann", None), (1, 1, "dispute", "ann", " why "), (1, 9, "attest", "ann", None)], "answer_id int, index int, action string, actor string, note string")
    r = A.act(answers, actions).first()
    assert [(s["support_status"], s["sources"], s["dispute"]) for s in r["segments"]] == [("supported", ["a", "human_attestation:ann"], None), ("unsupported", ["b"], "ann: why")]
    assert r["needs_review"] and [(e["index"], e["outcome"]) for e in r["events"]] == [(0, "attested"), (1, "disputed")]


def test_rounding_equals_round(spark):
    rng = random.Random(7)
    values = [0.125, 0.375, 2.5, 2.675, 0.285, 1.005, -2.675, -0.125, 0.0, -0.0, 1e300, 1e-300, 0.5, 1.5, 123456789.125, 2.0**51 + 0.5, None]
    values += [rng.randrange(10**6) / 1000 for _ in range(3000)] + [rng.uniform(-1e6, 1e6) for _ in range(1000)] + [rng.randrange(-4000, 4000) / 16 for _ in range(1000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", *[L.rounded(F.col("x"), n).alias(f"d{n}") for n in (0, 1, 2, 4)]).collect()
    assert [(r["x"], n, r[f"d{n}"]) for r in rows for n in (0, 1, 2, 4)] == [(v, n, None if v is None else round(v, n)) for v in values for n in (0, 1, 2, 4)]


def test_near_spans_are_compared_once(monkeypatch):
    from dossierspark.functions import spans

    met, whole = [], spans.SequenceMatcher.ratio
    monkeypatch.setattr(spans.SequenceMatcher, "ratio", lambda m: met.append(m.a) or whole(m))
    found = spans.locate("describe how customer 7 is served in every region of the country", "describe how customer 7 is served in every region of the county")
    assert found["tier"] == "near" and len(met) == len(set(met)) > 0


def test_labelled_pairs_are_never_broadcast_by_a_guessed_size(spark):
    labels = spark.createDataFrame([(1, "File  7", None), (2, "file 7", ""), (3, "other", None), (4, None, " ")], "label_id long, a string, d string")
    pairs = spark.createDataFrame([(10, "file 7", None), (11, "FILE 7", ""), (12, "none", None), (13, "", "")], "pair_id long, a string, d string")
    got = V.labelled_pairs(labels, pairs, ["a", "d"])
    assert sorted(map(tuple, got.select("label_id", "pair_id").collect())) == [(1, 10), (1, 11), (2, 10), (2, 11), (4, 13)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "isnotnull(pythonUDF" not in plan
