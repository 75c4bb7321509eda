import datetime
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossierspark.functions import spans as S
from dossierspark.functions import text as T

TEXT = st.text(alphabet="aB é-\n\r\t.!?…’“”ﬁ½\xad​(1)•;:Dr", max_size=80)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_columns(spark):
    q = F.lit("Please describe the Safety-case approach, or the safety plan.")
    assert one(spark, T.lexical_query(q)) == "the or safety or case or or or plan"
    assert one(spark, T.excerpt(F.lit("  abcdef gh "), 8)) == "abcdef…"
    assert one(spark, T.strip_leading_number(F.lit("Q 3.2) What?"))) == "What?"
    assert one(spark, T.priority(F.lit("This item is Mandatory."))) == "must"
    assert one(spark, T.priority(F.lit("C"))) == "could" and one(spark, T.priority(F.lit(" . "))) is None
    assert one(spark, T.fact_key(F.lit("insurance_cover"), F.lit("  cyber \n cover "))) == "cyber cover"
    assert one(spark, T.fact_key(F.lit("headcount"), F.lit("x"))) is None
    topics = F.array(*map(F.lit, [" Social_Value ", "nope", "social_value", "interoperability", "service_levels", "clinical_safety"]))
    assert one(spark, T.clean_topics(topics)) == ["social_value", "interoperability", "service_levels"]
    assert one(spark, T.edit_share(F.lit(""), F.lit(""))) == 0 and one(spark, T.edit_share(F.lit("abcd"), F.lit("abxd"))) == 0.25
    assert one(spark, T.word_share(T.content_words(F.lit("audit logs reports")), T.content_words(F.lit("log the report")))) == 2 / 3
    assert one(spark, T.simple_sentences(F.lit("One. Two? three\nFour")))== ["One.", "Two? three", "Four"]
    assert one(spark, T.first_words(F.lit("a b c"), 2)) == "a b" and one(spark, T.last_words(F.lit(" a b c "), 2)) == "b c"
    assert one(spark, T.british_date(F.lit("on 14 June 2024."))) == datetime.date(2024, 6, 14) and one(spark, T.british_date(F.lit("-"))) is None
    assert one(spark, T.interval_share(*map(F.lit, (0, 10, 5, 15)))) == 5 / 15
    assert one(spark, T.topics_for(F.lit("Carbon and net zero; FHIR"))) == ["social_value", "interoperability"]
    assert one(spark, T.topics_for(F.lit("nothing"))) == ["clinical_safety"]
    assert one(spark, T.mentioned_names(F.lit("hi @ann lee, @Ann and @bob!"), F.array(*map(F.lit, ["Ann", "Ann Lee", "Bo"])))) == ["ann lee", "Ann"]
    facts = one(spark, T.facts_in(F.lit("We employ 42 staff under company number 123.")))
    assert [(f["kind"], f["value"]) for f in facts] == [("headcount", "42"), ("company_registration", "123")]


def test_facts(spark):
    one_cover = "We hold public liability insurance of £5 million."
    all_covers = "We hold public liability insurance of £5 million, professional indemnity insurance of £2.5 million, employer's liability insurance of £10 million and cyber insurance of £1 million."
    assert one(spark, T.facts_in(F.lit(one_cover))) == []
    covers = one(spark, T.facts_in(F.lit(all_covers)))
    assert [(f["key"], f["value"]) for f in covers] == [("public liability", "£5 million"), ("professional indemnity", "£2.5 million"), ("employer's liability", "£10 million"), ("cyber", "£1 million")]
    toolkit = "We completed the 2024/25 Data Security and Protection Toolkit assessment with an outcome of Standards Met, published on 3 June 2025 under ODS code AB12."
    assert tuple(one(spark, T.facts_in(F.lit(toolkit)))[0]) == ("dspt_status", "AB12", "2024/25 Standards Met", datetime.date(2025, 6, 3), None)
    text = "About ISO 27001.\nCertificate number IS-77.\nCertificate issued 1 May 2024, valid until 30 April 2027.\nWe employ 7 staff."
    found = [(f["statement"], *f["fact"]) for f in one(spark, T.facts_of_text(F.lit(text)))]
    assert found == [
        ("Certificate number IS-77.", "iso_27001", None, "IS-77", datetime.date(2024, 5, 1), datetime.date(2027, 4, 30)),
        ("We employ 7 staff.", "headcount", None, "7", None, None),
    ]


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_folded_places(text):
    norm, at = S.folded(text)
    assert len(norm) == len(at) and all(0 <= i < len(text) for i in at) and (np.diff(at) >= 0).all()
    assert norm == norm.strip() and "  " not in norm


def test_folded_cases():
    assert S.folded("Infor-\n mation  “ﬁne” – A​B")[0] == 'information "fine" - ab'
    assert S.folded("well-known 3-\n4")[0] == "well-known 3- 4"
    assert S.folded("")[0] == "" and S.folded(" \n")[0] == ""


def test_locate():
    text = "We hold  the “Gold” certificate.\nIt was re-\nnewed in 2024."
    found = S.locate('the "gold" certificate', text)
    assert text[found["start"] : found["end"]] == "the “Gold” certificate" and found["tier"] == "verbatim"
    near = S.locate("it was renewed in march 2024", "before. It was renewed in  2024. after", 0.8)
    assert near["tier"] == "near" and "renewed" in "before. It was renewed in  2024. after"[near["start"] : near["end"]]
    assert S.locate("nothing like it", text) is None and S.locate("", text) is None and S.locate("x", None) is None
    a = S.locate_anchored("one two three four five", "two three", "four", "two three four")
    assert (a["start"], a["end"], a["by_anchors"]) == (4, 18, True)
    assert S.locate_anchored("one two three", "two", "nine", "two three")["by_anchors"] is False


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_sentences_slice_back(text):
    made = S.sentences_of(text)
    assert all(text[s["start"] : s["end"]] == s["text"] and s["text"].strip() == s["text"] for s in made)
    assert "".join("".join(s["text"].split()) for s in made) == "".join(text.split())


def test_sentence_rules():
    said = lambda t: [s["text"] for s in S.sentences_of(t)]
    assert said("See e.g. Dr. A. Smith. Next one! (Yes.) ok") == ["See e.g. Dr. A. Smith.", "Next one!", "(Yes.)", "ok"]
    assert said("Wait... and go. Wait... And go.") == ["Wait... and go.", "Wait...", "And go."]
    assert said("1. First point. More\n2. Second") == ["1. First point.", "More", "2. Second"]
    assert [s["paragraph"] for s in S.sentences_of("a\nb\n\nc\n \nd")] == [0, 0, 1, 2]
    assert S.is_terminal("Done.") and S.is_terminal('He said "yes."') and not S.is_terminal("etc.") and not S.is_terminal("The stages are: 1.") and not S.is_terminal("open")


@settings(max_examples=100, deadline=None)
@given(TEXT, st.integers(8, 40))
def test_chunks_cover_the_text(text, target):
    made = S.chunks_of(text, target)
    assert "".join("".join(text[c["start"] : c["end"]].split()) for c in made) == "".join(text.split())
    assert all(a["end"] <= b["start"] for a, b in zip(made, made[1:]))
    assert all(c["end"] - c["start"] <= max(target * 1.5, target * 1.25 + 1) for c in made)


def test_realigned():
    old = [{"index": 0, "text": "We hold the gold certificate."}, {"index": 1, "text": "It lasts for three years in all cases."}, {"index": 2, "text": "Gone."}]
    rows = S.realigned(old, "We hold  the GOLD certificate. It lasts for four years in all cases. Brand new text.")
    assert [(r["change"], r["old_index"]) for r in rows] == [("kept", 0), ("edited", 1), ("new", None)]


def test_vector_diff_anchor(spark):
    v = np.array(S.hashed_vector("red blue red", 32))
    assert abs(v @ v - 1) < 1e-12 and S.hashed_vector("", 4) == [1.0, 0, 0, 0]
    assert "".join(d["text"] for d in S.word_diff("a b c", "a x c") if d["kind"] != "removed") == "a x c"
    assert S.nearest_occurrence("ab", "ab ab ab", 4) == 3 and S.nearest_occurrence("z", "ab", 0) is None
    S.register(spark)
    assert spark.sql("select doc_normalise(' A  b ') x").first()["x"] == "a b"
    row = spark.sql("select doc_find_span('b c', 'a B  c d') s").first()["s"]
    assert (row["start"], row["end"]) == (2, 6)


def test_results_become_arrow_by_few_rows(spark):
    from dossierspark.functions import spans

    texts = [None, "", "One. Two here.\n\n- three"] * (spans.ROWS + 7)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(1).select("id", spans.sentences("text").alias("s"), spans.normalised("text").alias("n"))
    for r in rows.collect():
        assert [x.asDict() for x in r["s"]] == spans.sentences_of(texts[r["id"]])
        assert r["n"] == (None if texts[r["id"]] is None else spans.folded(texts[r["id"]])[0])


def test_texts_that_are_not_ascii_are_folded_by_arrays(monkeypatch):
    rng = random.Random(5)
    signs = ["a", "B", "é", "Σ", "ß", "…", "ﬁ", "-", "–", "“", " ", "\n", "\u00a0", "\u2028", "\u00ad", "-\n", "½", "日", "🙂", "\ud800", "Ⅳ"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(400)] + ["\u00ad", "é", "é ", " É  é-\n É"]
    fast = [S.folded(t) for t in texts]
    monkeypatch.setattr(S, "_folded_even", lambda text, chars: None)
    assert any(S.folded(t) is None for t in texts)
    # each of these has one character that is lowered to two, so it is folded one by one
    for t, (form, at) in zip(texts, fast):
        slow, places = S.folded(t + " 1 \u0130")
        assert slow[: -len("1 i\u0307")].rstrip() == form and places[: len(form)].tolist() == at.tolist()


def test_hashed_vectors_equal_a_plain_loop(spark, monkeypatch):
    import re
    from hashlib import blake2b

    texts = [None, "", "É!", "One two one two, TWO-one", "\u212aelvin \u0130st a\u00e9b x9", "same words " * 40, *(f"t{i} t{i % 3} z" for i in range(30))]

    def plain(text):
        words, v = re.findall("[a-z0-9]+", (text or "").lower()), np.zeros(16)
        for weight, terms in ((1.0, words), (0.5, [f"{a} {b}" for a, b in zip(words, words[1:])])):
            for t in terms:
                h = int.from_bytes(blake2b(t.encode(), digest_size=8).digest(), "big")
                v[h % 16] += weight if h >> 63 else -weight
        length = np.sqrt((v * v).sum())
        return (v / length).tolist() if length else [1.0] + [0.0] * 15

    hashed = []
    monkeypatch.setattr(S, "blake2b", lambda t, **k: hashed.append(t) or blake2b(t, **k))
    assert S.hashed_vectors(pa.array(texts, pa.string()), 16).to_pylist() == [plain(t) for t in texts]
    assert len(hashed) == len(set(hashed))  # each term once
    assert S.hashed_vectors(pa.array([None, "É"], pa.string()), 2).to_pylist() == [[1.0, 0.0]] * 2 and S.hashed_vectors(pa.array([], pa.string()), 2).to_pylist() == []
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", S.hash_embedding("text", 16).alias("v")).collect()
    assert {r["n"]: r["v"] for r in rows} == {n: plain(t) for n, t in enumerate(texts)}
