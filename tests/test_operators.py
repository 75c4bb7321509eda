import datetime
import io
import random
import zipfile

import numpy as np
from pyspark.sql import functions as F

from dossierspark.operators import batching, components, lineage, merging, retrieval, review, verification
from dossierspark.operators.sections import sections, text_blocks
from dossierspark.sources import blocks, sinks
from dossierspark.streaming import conformer


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()
    want = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


def test_fusion_by_hand(spark):
    a = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.8)], "query_id long, item_id long, rank int, score double")
    b = spark.createDataFrame([(1, 11, 1, 0.7), (1, 12, 2, 0.6)], "query_id long, item_id long, rank int, score double")
    fused = retrieval.fuse({"a": a, "b": b})
    got = {r["item_id"]: r["fused"] for r in fused.collect()}
    assert got == {10: 1 / 61, 11: 1 / 62 + 1 / 61, 12: 1 / 62}
    kept = retrieval.collapse(fused.withColumn("cluster_id", F.when(F.col("item_id") > 10, 1).otherwise(0)))
    assert [(r["item_id"], r["rank"]) for r in kept.orderBy("rank").collect()] == [(11, 1), (10, 2)]
    order = spark.createDataFrame([(1, 10, 0), (1, 99, 1)], "query_id long, item_id long, position int")
    assert [r["item_id"] for r in retrieval.reranked(kept, order).orderBy("rank").collect()] == [10, 11]


def test_weights_of_lexical_hits(spark):
    items = spark.createDataFrame([(1, "alpha", "x y"), (2, "x", "alpha y"), (3, "alpha", "beta x")], "item_id long, question string, answer string")
    q = spark.createDataFrame([(1, "describe alpha or beta"), (2, "or please")], "query_id long, text string")
    assert [(r["query_id"], r["item_id"]) for r in retrieval.lexical_list(items, q).orderBy("rank").collect()] == [(1, 3), (1, 1), (1, 2)]


def test_triage(spark):
    best = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.9), (4, 0.9)], "query_id long, best double")
    judged = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.2)], "query_id long, share double")
    got = {r["query_id"]: (r["coverage"], r["label_source"]) for r in retrieval.triage(best, judged).collect()}
    assert got == {1: ("covered", "judge"), 2: ("new", "floor"), 3: ("partial", "judge"), 4: ("new", "judge")}
    classes = {r["query_id"]: r["suggested_class"] for r in retrieval.suggest_class(best, judged).collect()}
    assert classes == {1: "A", 2: None, 3: None, 4: None}


def test_leader_clusters_equal_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8, 6))
    x = base[rng.integers(0, 8, 60)] + rng.normal(size=(60, 6)) * 0.25
    rows = [(i, i % 2, x[i].tolist(), bool(i % 5 == 0), datetime.date(2020, 1, 1 + int(i) % 9) if i % 4 else None, datetime.datetime(2021, 1, 1, int(i) % 7)) for i in range(60)]
    items = spark.createDataFrame(rows, "item_id long, grp int, vector array<double>, promoted boolean, effective_date date, created_at timestamp")
    got = {r["item_id"]: r["canonical_id"] for r in lineage.leader_clusters(items).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    key = lambda i: (not rows[i][3], -(rows[i][4] or datetime.date.min).toordinal(), rows[i][5], i)
    want = {}
    for g in (0, 1):
        clusters = []
        for i in sorted((i for i in range(60) if i % 2 == g), key=lambda i: (rows[i][5], i)):
            near = max(((unit[i] @ unit[c[0]], c) for c in clusters), key=lambda t: t[0], default=(0, None))
            if near[0] >= 0.9:
                near[1].append(i)
                near[1].sort(key=key)
            else:
                clusters.append([i])
        want |= {m: c[0] for c in clusters for m in c}
    assert got == want and len(set(want.values())) < 60


def test_leader_clusters_over_batch_and_block_borders(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(7, 6))[rng.integers(0, 7, 90)] + rng.normal(size=(90, 6)) * 0.2
    rows = [(i, i % 2, x[i].tolist(), None if i % 3 else True, datetime.date(2020, 1, 1 + i % 9) if i % 4 else None, datetime.datetime(2021, 1, 1, i % 7) if i % 10 else None) for i in range(90)]
    items = spark.createDataFrame(rows, "item_id long, grp int, vector array<double>, promoted boolean, effective_date date, created_at timestamp")
    whole = sorted(map(tuple, lineage.leader_clusters(items).collect()))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = {(i, j) for i in range(90) for j in range(i + 1, 90) if i % 2 == j % 2 and unit[i] @ unit[j] >= 0.9}
    monkeypatch.setattr(lineage, "BLOCK", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        pairs = lineage.similar_pairs(items)
        assert sorted(map(tuple, pairs.collect())) == sorted(near)
        found = lineage.leader_clusters(items)
        assert sorted(map(tuple, found.collect())) == whole and len({c for _, c in whole}) < 90
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Pandas" not in found._jdf.queryExecution().toString()


def test_invalidation_and_gates(spark):
    seg = "array<struct<index:int,kind:string,support_status:string,sources:array<string>>>"
    rows = [(1, [(0, "substantive", "supported", ["a"]), (1, "connective", "connective", ["a"]), (2, "substantive", "weak", ["a"])]), (2, [(0, "substantive", "supported", ["b"])])]
    answers = spark.createDataFrame(rows, f"answer_id long, segments {seg}")
    full = answers.withColumn("question_id", F.col("answer_id")).withColumn("needs_review", F.lit(False)).withColumn("checklist", F.expr("cast(array() as array<struct<fact_id:string,status:string>>)"))
    out = verification.invalidation_effects(full, spark.createDataFrame([("a", "removed"), ("a", "removed")], "source_id string, reason string")).collect()
    assert [(r["answer_id"], r["changed"]) for r in out] == [(1, [0])] and [s["support_status"] for s in out[0]["segments"]] == ["weak", "connective", "weak"]
    q = answers.select(F.col("answer_id").alias("question_id"), F.lit(True).alias("has_answer"), "segments", F.lit(False).alias("needs_review"), F.array(F.lit("g")).alias("gaps"), F.array().cast("array<string>").alias("acknowledged"))
    got = {(r["question_id"], r["to"]): r["blockers"] for r in review.allowed_transitions(q).collect()}
    assert got[2, "sme_verified"] == [] and got[2, "approved"] == ["gap:g"] and got[1, "sme_verified"] == ["segment:2"] and got[1, "ai_draft"] == ["system_only"]


def test_supersession_with_human_decisions(spark):
    d = datetime.date
    rows = [(i, 1, "reference", "iso_27001", True, d(2020, 1, i), "stated") for i in (1, 2, 3)]
    docs = spark.createDataFrame(rows, "document_id long, org_id int, doc_type string, doc_kind string, confirmed boolean, effective_date date, date_source string")
    plain = {r["document_id"]: r["superseded_by"] for r in lineage.document_supersession(docs).collect()}
    assert plain == {1: 3, 2: 3, 3: None}
    kept = spark.createDataFrame([(1, 3, None), (3, 2, 2)], "a_id long, b_id long, newer_id long")
    got = {r["document_id"]: r["superseded_by"] for r in lineage.document_supersession(docs, kept).collect()}
    assert got == {1: 2, 2: None, 3: 2}


def test_requirements_match_greedily(spark):
    old = spark.createDataFrame([(1, "s", "k1", 0, 10), (2, "s", "k2", 20, 30), (3, "t", "k3", 0, 10)], "old_id long, section_id string, key string, start long, end long")
    new = spark.createDataFrame([(11, "s", "k2", 0, 10, 0), (12, "s", "n", 1, 10, 1), (13, "s", "m", 0, 9, 2), (14, "t", "o", 50, 60, 3)], "new_id long, section_id string, key string, start long, end long, position long")
    assert {(r["new_id"], r["old_id"]) for r in merging.match_requirements(old, new).collect()} == {(11, 2), (12, 1), (13, None), (14, None)}


def test_requirements_match_over_batch_borders(spark):
    spans = "section_id string, key string, start long, end long"
    old, new, want = [], [], set()
    for n in range(40):
        name = None if n == 0 else f"s{n}"
        old += [(n * 10, name, f"{n}a", 0, 100), (n * 10 + 1, name, f"{n}b", 0, 100), (n * 10 + 2, name, f"{n}c", None, 9)]
        new += [(n * 10, name, f"{n}x", 10, 110, n * 10), (n * 10 + 1, name, f"{n}c", 7, 9, n * 10 + 1), (n * 10 + 2, name, f"{n}x", 0, 100, n * 10 + 2), (n * 10 + 3, name, f"{n}a", 0, 100, n * 10 + 3)]
        want |= {(n * 10, n * 10), (n * 10 + 1, n * 10 + 2), (n * 10 + 3, n * 10 + 1)}
    old, new = spark.createDataFrame(old, f"old_id long, {spans}"), spark.createDataFrame(new, f"new_id long, {spans}, position long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        found = merging.match_requirements(old, new)
        assert sorted(map(tuple, found.collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "UDTF" not in found._jdf.queryExecution().toString()


def test_windows_overlap(spark):
    rows = [(1, i, t) for i, t in enumerate([40, 40, 40, 200, 10])]
    s = spark.createDataFrame(rows, "document_id long, order_index int, tokens int")
    got = sorted((r["window"], r["order_index"]) for r in batching.token_windows(s, limit=150).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 4)]


def test_windows_are_folded_by_batches(spark):
    rows = [(None if d == 3 else d, i, (d * 37 + i * i * 11) % 90 + (500 if i % 13 == 5 else 0)) for d in range(6) for i in range(d * d * 3)]
    want = []
    for d in {r[0] for r in rows}:
        window, used, last = 0, 0, None
        for _, at, tokens in (r for r in rows if r[0] == d):
            cost = tokens + 30
            if last and used + cost > 300:
                window, used = window + 1, last[1]
                want.append((d, window, last[0]))
            want.append((d, window, at))
            used, last = used + cost, (at, cost)
    s = spark.createDataFrame(rows, "document_id long, order_index int, tokens int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = batching.token_windows(s, limit=300)
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
        alone = batching.token_windows(s, limit=300, overlap=False).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(str((r[0], r[2])) for r in alone) == sorted(str((r[0], r[1])) for r in rows)
    assert "UDTF" not in found._jdf.queryExecution().toString()


def test_text_sections(spark):
    text = "intro line\nsecond\n\n# One #\npara a\n\npara b\n## Two\n\n# Three\n"
    files = spark.createDataFrame([(1, text), (2, ""), (3, None)], "document_id long, text string")
    got = [(r["order_index"], r["heading_path"], r["text"]) for r in sections(text_blocks(files)).orderBy("order_index").collect()]
    assert got == [(0, [], "intro line\nsecond"), (1, ["One"], "One\npara a\npara b"), (2, ["One", "Two"], "Two"), (3, ["Three"], "Three")]


def test_html_tables(spark):
    html = "<h1>Top</h1><p>a</p><table><tr><th>Q</th><th>A</th></tr><tr><td>1</td><td>x<br>y</td></tr><tr><td></td></tr></table><p>b</p><script>no()</script>"
    pages = spark.createDataFrame([(1, html)], "document_id long, html string")
    got = [(r["heading_path"], r["cell_ref"], r["text"]) for r in sections(blocks.html_blocks(pages)).orderBy("order_index").collect()]
    assert got[0] == (["Top"], None, "Top\na\nb") and got[1][:2] == (["Top", "Q", "A"], "T1:R2")


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr>{s}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in (["Q", "A"], ["one", "two"])) + "</w:tbl>"
    heading = p("Head", '<w:pStyle w:val="Heading1"/>')
    (tmp_path / "a.docx").write_bytes(_zip(**{"word__document.xml": f"<w:document {w}><w:body>{heading}{p('text')}{table}</w:body></w:document>"}))
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = f'<worksheet {s}><sheetData><row r="1">{cell("A1", "Q")}{cell("B1", "N")}</row><row r="3">{cell("A3", "why")}<c r="B3"><v>4.0</v></c></row></sheetData></worksheet>'
    (tmp_path / "b.xlsx").write_bytes(_zip(**{"xl__workbook.xml": f'<workbook {s}><sheets><sheet name="S"/></sheets></workbook>', "xl__worksheets__sheet1.xml": sheet}))
    (tmp_path / "c.md").write_text("# T\nbody")
    (tmp_path / "d.txt").write_text("")
    files = blocks.read_files(spark, str(tmp_path))
    got = {(tuple(r["heading_path"]), r["cell_ref"], r["text"]) for r in sections(blocks.file_blocks(files)).collect()}
    assert got == {(("Head",), None, "Head\ntext"), (("Head", "Q", "A"), "T1:R2", "one | two"), (("S", "Q", "N"), "S!3", "why | 4"), (("T",), None, "T\nbody")}
    assert {r["problem"] for r in blocks.file_problems(files).collect()} == {"empty"}


def test_bad_files_stop_nothing(spark, tmp_path):
    """One problem row for each broken, empty, oversized and unknown file; the good one is read."""
    for name, data in {"a.docx": b"no zip", "b.xlsx": _zip(other="x"), "c.pdf": b"%PDF", "d": b"x", "e.TXT": b"", "f.md": b"y" * 3000, "g.txt": b"fine", "h.docx": _zip(**{"word__document.xml": "<broken"})}.items():
        (tmp_path / name).write_bytes(data)
    files = blocks.read_files(spark, str(tmp_path), most_bytes=2000)
    named = {r["document_id"]: r["path"].rsplit("/", 1)[1] for r in files.collect()}
    got = sorted((named[r["document_id"]], r["problem"]) for r in blocks.file_problems(files).collect())
    assert got == [
        ("a.docx", "unreadable: BadZipFile"), ("b.xlsx", "unreadable: KeyError"), ("c.pdf", "unknown_type"), ("d", "unknown_type"),
        ("e.TXT", "empty"), ("f.md", "too_large"), ("h.docx", "unreadable: ParseError"),
    ]
    assert [r["text"] for r in blocks.file_blocks(files).collect()] == ["fine"]


SEG = "struct<text:string,paragraph:int,kind:string,sources:array<struct<source_type:string,source_id:string>>>"


def stream_rows():
    src = lambda *i: [("document", x) for x in i]
    runs = {
        1: [("One sentence. Half of", 0, "substantive", src("a")), ("another one. Tail", 0, "connective", src("b", "a")), ("New paragraph.", 1, "substantive", src("c"))],
        2: [("", 0, "substantive", []), ("open end", 0, "substantive", src("z"))],
    }
    return [(r, i, s, i == len(segs) - 1) for r, segs in runs.items() for i, s in enumerate(segs)]


WANT = {
    (1, 0, "One sentence.", 0, "substantive", ("a",)),
    (1, 1, "Half of another one.", 0, "substantive", ("a", "b")),
    (1, 2, "Tail", 0, "connective", ("b", "a")),
    (1, 3, "New paragraph.", 1, "substantive", ("c",)),
    (2, 0, "open end", 0, "substantive", ("z",)),
}


def _shape(rows):
    return {(r["run_id"], r["index"], r["text"], r["paragraph"], r["kind"], tuple(s["source_id"] for s in r["sources"])) for r in rows}


def test_conformer_batch_and_stream_agree(spark, tmp_path):
    df = spark.createDataFrame(stream_rows(), f"run_id long, seq int, segment {SEG}, last boolean")
    assert _shape(conformer.conform_batch(df).collect()) == WANT
    for k in range(3):
        df.where(F.col("seq") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = conformer.conform_stream(stream).writeStream.format("memory").queryName("conformed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert _shape(spark.table("conformed").collect()) == WANT


def test_expiry_sweep_stream(spark, tmp_path):
    facts = spark.createDataFrame([(1, datetime.date(2000, 1, 1), None), (2, datetime.date(9999, 1, 1), None)], "fact_id long, expires_on date, expired_at timestamp")
    facts.write.parquet(str(tmp_path / "facts"))
    stream = spark.readStream.schema(facts.schema).parquet(str(tmp_path / "facts"))
    conformer.sweep_expired(stream, str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination()
    assert [r["fact_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "é")], "a long, b string")
    sinks.write_ndjson(rows, str(tmp_path / "nd"))
    back, bad = blocks.read_json_rows(spark, str(tmp_path / "nd"), "a long, b string")
    assert {tuple(r) for r in back.collect()} == {(1, None), (2, "é")} and bad.count() == 0
    source = "struct<source_type:string,document_title:string,doc_type:string,doc_kind:string,effective_date:date,quote:string,attested_by:string,at:string,note:string,locator:struct<page:int,table:int,cell_ref:string,heading_path:array<string>,start:int,end:int>>"
    schema = f"segment struct<kind:string,support_status:string,dispute:struct<disputed_by:string,at:string,note:string>,sources:array<{source}>>"
    doc = ("document", "Doc", "reference", None, datetime.date(2024, 1, 2), "words", None, None, None, (3, None, None, ["A", "B"], 1, 2))
    data = [(("substantive", "weak", ("Ann", None, "no"), [doc]),), (("connective", "connective", None, []),), (("substantive", "unsupported", None, []),)]
    got = [r[0] for r in spark.createDataFrame(data, schema).select(sinks.source_comment(F.col("segment"))).collect()]
    assert got[0] == "Support: weak\nDisputed by Ann: no\n\n1. Source: Doc (reference)\nEffective 2024-01-02\nLocation: page 3, section A > B\n“words”"
    assert got[1] is None and got[2] == "Support: unsupported\nNo source located for this sentence."
