import random
import re

import pytest

from dossierspark.llm import mixing as M


#: Texts that end in characters which some patterns take for line ends; they are no spaces here.
LINE_ENDS = ["a b \x85", "a b \u2028", "a b \u2029", "a \r\x85", "a \n", "a\u2028", " \x85 "]


def docs_of(seed=1, n=400):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "é", "Z", None]), 1) for i in range(n)]
    return rows + [(n, None, "b", 1), (n + 1, "", "b", 1), (n + 2, "\x85 x\ty\x0b z", "b", 1), (7, "same id again", "a", 1), (7, "same id again", "a", 1), (None, "no id", "a", 1), (n + 3, "big " * 900, "b", 1), (n + 4, "", "empty source", 1)] + [(n + 5 + i, t, "b", 1) for i, t in enumerate(LINE_ENDS)]


def test_report(spark):
    rows = docs_of()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target long")
    out = M.mix_report(df).toPandas()
    assert len(out) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(out["size"]) == sorted(size(r[1]) for r in rows)
    totals = {}
    for _, t, s, _ in rows:
        totals[s] = totals.get(s, 0) + size(t)
    want = M.targets(totals, {s: i % 3 + 1 for i, s in enumerate(M.in_order(totals))})
    assert abs(sum(want.values()) - sum(totals.values())) < 1e-6 and all(want[s] <= 3 * totals[s] + 1e-9 for s in totals)
    assert (out["taken"] <= 3 * out["size"]).all()
    for source_size, target, taken in out.groupby(["source_size", "target"])["taken"].sum().reset_index().itertuples(index=False):
        assert abs(taken - target) <= max(12, 0.02 * target), (source_size, target, taken)
    again = M.mix_report(df.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert again[key].sort_values(key).values.tolist().__repr__() == out[key].sort_values(key).values.tolist().__repr__()


def test_documents_repeat_as_reported(spark):
    rows = [r for r in docs_of(2, 150) if r[0] is not None and r[0] != 7]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    report = {r["doc_id"]: r["taken"] for r in M.mix_report(df).collect()}
    mixed = M.mixed_documents(df)
    assert mixed.columns == df.columns
    words = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert {d: t for d, t in report.items() if t} == {d: w for d, w in words.items() if w}


def test_columns_that_clash(spark):
    rows = [(i, "w " * (i % 9), "ab"[i % 2], f"p{i}", i, f"q{i}", "x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, pattern string, times int, _mix_pattern string, _mix_cut string")
    kept = {tuple(r) for r in M.mixed_documents(df).collect()}
    assert kept and kept <= set(rows)


@pytest.mark.parametrize("most", [1, 3])
def test_patterns_in_blocks(spark, monkeypatch, most):
    """With many blocks of patterns each source still comes near its target, and no block goes beyond three times."""
    monkeypatch.setattr(M, "PATTERNS", most)
    df = spark.createDataFrame([r for r in docs_of(3) if r[0] is not None], "doc_id long, text string, source string, target long")
    out = M.mix_report(df).toPandas()
    assert (out["taken"] <= 3 * out["size"]).all()
    for target, taken in out.groupby(["source_size", "target"])["taken"].sum().reset_index()[["target", "taken"]].itertuples(index=False):
        assert abs(taken - target) <= max(12, 0.02 * target)


def test_overlapping_sources_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 30), rng.sample("abcde", rng.randint(1, 3))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, size long, members array<string>")
    whole = M.plan_mix(df).plan.count()
    monkeypatch.setattr(M, "PATTERNS", 4)
    mix = M.plan_mix(df)
    assert mix.plan.count() == whole and not mix.small
    out = mix.times(df.withColumn("p", M.pattern_of(df["members"])), "p", "n").toPandas()
    assert out["n"].between(0, 3).all() and abs((out["n"] * out["size"]).sum() - sum(t for _, t in mix.by_source.values())) < 0.05 * (out["size"]).sum()


def test_choice_follows_the_hash(spark):
    """Within a source, documents taken once more than the others are the first by hash, and a few that fill the gap."""
    df = spark.createDataFrame([r for r in docs_of(5) if r[0] is not None], "doc_id long, text string, source string, x int").dropDuplicates(["doc_id"])
    out = M.mix_report(df).join(df.select("doc_id", "source", M.order_key(11).alias("u")), "doc_id").where("size > 0").toPandas()
    for source, own in out.groupby("source", dropna=False):
        times = own["taken"] // own["size"]
        extra = own.assign(more=times > times.min()).sort_values("u")
        if extra["more"].any() and not extra["more"].all():
            head = int((~extra["more"]).to_numpy().argmax())
            behind = extra.iloc[head:]
            assert behind["more"].sum() <= M.FILL * 12 and times.max() == times.min() + 1, source
            gap = own["target"].iloc[0] - (own["size"] * times.min()).sum() - extra["size"].iloc[:head].sum()
            assert behind.loc[behind["more"], "size"].sum() <= gap + 1, source


def test_empty(spark):
    assert M.mix_report(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_targets_reshare():
    assert M.targets({"a": 100, "b": 10, None: 0}, {"a": 1, "b": 2, None: 3}) == {"a": 80.0, "b": 30.0, None: 0.0}
    assert M.targets({}, {}) == {}


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_maximal_and_cheapest(seed):
    """Against a linear search over unit flows: Bellman-Ford augmentations on the whole network."""
    rng = random.Random(seed)
    sources = "abc"
    members = [sorted(rng.sample(sources, rng.randint(1, 3))) for _ in range(4)]
    capacity, quota = [rng.randint(0, 4) for _ in members], {s: rng.randint(0, 9) for s in sources}
    flow = M.route(capacity, members, quota)
    used = [sum(f.values()) for f in flow]
    into = {s: sum(f.get(s, 0) for f in flow) for s in sources}
    assert all(u <= 3 * c for u, c in zip(used, capacity)) and all(into[s] <= quota[s] for s in sources)
    cost = lambda us: sum(max(0, u - c) + 2 * max(0, u - 2 * c) for u, c in zip(us, capacity))

    edges = []  # (a, b, capacity, cost)
    for p, c in enumerate(capacity):
        edges += [("S", p, c, k) for k in (0, 1, 3)] + [(p, s, 99, 0) for s in members[p]]
    edges += [(s, "T", q, 0) for s, q in quota.items()]
    left = {(i, d): (e[2] if d else 0) for i, e in enumerate(edges) for d in (True, False)}
    total = price = 0
    while True:
        best = {"S": (0, None)}
        for _ in range(12):
            for i, (a, b, _, k) in enumerate(edges):
                for x, y, d, w in ((a, b, True, k), (b, a, False, -k)):
                    if x in best and left[i, d] > 0 and best[x][0] + w < best.get(y, (1e9,))[0]:
                        best[y] = (best[x][0] + w, (x, i, d))
        if "T" not in best:
            break
        at = "T"
        while at != "S":
            x, i, d = best[at][1]
            left[i, d] -= 1
            left[i, not d] += 1
            at = x
        total, price = total + 1, price + best["T"][0]
    assert sum(used) == total and cost(used) == price
