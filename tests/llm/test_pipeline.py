"""Each stage against a plain version on its own input."""

import re

import corpus_pipeline as P
import pytest

from dossierspark.llm import quality
from dossierspark.llm.queries import QUERIES, oracle_sql

from .test_decontaminate import brute as leaks
from .test_ngram_join import brute as near
from .test_token_files import brute as tokens

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        made = P.written(stage(spark, docs, SF), "test-stage")
        out.append((docs, made))
        docs = made
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality(spark, stages):
    before, after = stages[0]
    want = quality.score_quality(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
    assert sorted(d for d, _ in pairs(after)) == sorted(r["doc_id"] for r in want.collect())


def test_near_copies(stages):
    before, after = stages[1]
    want = [d for d, _, c in near(pairs(before), 5, 80, 100) if d == c]
    assert sorted(d for d, _ in pairs(after)) == sorted(want)


def test_leaks(spark, stages):
    before, after = stages[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    text = "\n".join(" ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) for _, t in pairs(before))
    some = [d for d in pairs(before) if hash(d[0]) % 9 == 0]
    want = [d[0] for d in leaks(some, items) if not d[5]]
    kept = {d for d, _ in pairs(after)}
    assert text and sorted(want) == sorted(d for d, _ in some if d in kept)


def test_mix_and_tokens(stages):
    before, after = stages[3]
    assert {d for d, _ in pairs(after)} <= {d for d, _ in pairs(before)}
    docs, made = stages[4]
    assert sorted(map(tuple, made.collect())) == sorted(tokens(pairs(docs)))


def test_registered():
    assert [q.split("_")[0] for q in QUERIES] == [*(f"op{n}" for n in range(1, 14)), "pipeline"]
    assert set(oracle_sql()) <= set(QUERIES) and P.ORACLE_SQL is None


DOCS = "doc_id long, text string, lang string, source string, n_chars long, pattern string, doc_key long, blob string, score int"


def run(spark, folder, docs, labels=(), items=()):
    spark.createDataFrame(list(docs), DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return P.run(spark, str(folder))


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path, []).count() == 0


def test_nulls_repeats_and_clashing_columns_without_labels(spark, tmp_path):
    """Nothing is learnt and nothing leaks; of rows with equal id and text one stays, unlike texts of one id are two documents."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, text(i), "en", "s", 1) for i in range(12)] + [(3, text(3), "en", "s", 1), (4, text(40), "en", "s", 1), (None, text(50), None, None, None), (20, None, None, None, None), (21, "", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, "p", 7, "b", 5) for r in rows], DOCS)
    kept = docs
    for name, stage in P.STAGES[1:4]:
        before, kept = kept, P.written(stage(spark, kept, str(_no_items(spark, tmp_path))), "test-stage")
        assert kept.columns == docs.columns, name
        if name.startswith("n-gram"):
            assert sorted(pairs(kept), key=str) == sorted({(r[0], r[1]) for r in rows}, key=str)
        elif name.startswith("benchmark"):
            assert sorted(pairs(kept), key=str) == sorted(pairs(before), key=str)
        else:
            assert {p for p in pairs(kept)} <= {p for p in pairs(before)}
    out = P.STAGES[4][1](spark, kept, "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((d is None, d or 0) for d, _ in pairs(kept))
    made = run(spark, tmp_path, [(*r, "p", 7, "b", 5) for r in rows])
    assert {r["doc_id"] for r in made.collect()} <= {r[0] for r in rows}


def _no_items(spark, folder):
    path = folder / "none"
    if not path.exists():
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path
