"""Requirements merged with deletes, and the log of events, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dossierspark.operators import events as E
from dossierspark.operators import merging as M
from dossierspark.operators.components import scratch

STORED = "requirement_id long, tender_id long, section_id string, key string, start int, end int, text string, compliance_class string, compliant_by date, owner string, rated_at timestamp, comment string, extra int"
FOUND = "new_id long, tender_id long, position int, section_id string, key string, start int, end int, text string"


def share(a, b, c, d):
    hull = max(b, d) - min(a, c)
    return max(0, min(b, d) - max(a, c)) / hull if hull > 0 else 0


def loop(stored, found, covered):
    by_key = {r[3]: r for r in stored}
    taken, out, written = set(), [], set()
    for n in sorted(found, key=lambda r: r[2]):
        key, start, end = n[4:7]
        if key in written:
            continue
        row = by_key.get(key)
        if row is None and start is not None and end is not None:
            best = None
            for r in sorted(stored):
                if r[0] in taken or r[2] != n[3] or r[4] is None or r[5] is None:
                    continue
                s = share(r[4], r[5], start, end)
                if s >= 0.6 and (best is None or s > best[0]):
                    best = (s, r)
            row = best and best[1]
        if row is not None:
            taken.add(row[0])
            by_key.pop(row[3], None)
        written.add(key)
        out.append((row and row[0], key, n[7], row and row[9], len(written) - 1, "updated" if row else "created"))
    for r in stored:
        if r[0] not in taken:
            fine = r[2] in covered and all(x is None for x in r[7:11]) and not r[11]
            out.append((r[0], r[3], r[6], r[9], None, "deleted" if fine else "kept"))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    sections = [f"s{i}" for i in range(12)]
    span = lambda: rng.choice([(None, None)] + [(a, a + rng.randrange(5, 40)) for a in rng.sample(range(200), 8)])
    name = lambda s, a, b: f"{s}:{a}-{b}" if a is not None else f"{s}:t:{rng.randrange(6)}"
    stored, keys = [], set()
    for i in range(200):
        s, (a, b) = rng.choice(sections), span()
        if (k := name(s, a, b)) not in keys:
            keys.add(k)
            stored.append((i, 1, s, k, a, b, f"old {i}", *[rng.choice([None] * 5 + ["A"]), None, rng.choice([None] * 5 + ["ann"]), None, rng.choice([None, "", "said"])], i))
    found = []
    for i in range(260):
        s, (a, b) = rng.choice(sections), span()
        if rng.random() < 0.5:
            r = rng.choice(stored)
            s, a, b = r[2], r[4], r[5]
            if a is not None and rng.random() < 0.7:
                a, b = a + rng.randrange(-3, 4), b + rng.randrange(-3, 4)
        found.append((1000 + i, 1, i, s, name(s, a, b), a, b, f"new {i}"))
    covered = sections[:8]
    out = M.merge_requirements(spark.createDataFrame(stored, STORED), spark.createDataFrame(found, FOUND), spark.createDataFrame([(s,) for s in covered], "section_id string"))
    got = sorted(((r["requirement_id"], r["key"], r["text"], r["owner"], r["order_index"], r["state"]) for r in out.collect()), key=str)
    assert got == loop(stored, found, covered) and {g[-1] for g in got} == {"created", "updated", "kept", "deleted"}


AT = dt.datetime(2024, 1, 1)


def test_log_has_no_gaps_and_survives_replays(spark):
    rng, path, want = random.Random(4), scratch(spark, "test-log"), {}
    batches, used = [], []
    for b in range(4):
        rows = []
        for i in range(60):
            key = f"{b}-{i}"
            rows.append((rng.choice(["question", "answer"]), str(rng.randrange(9)), "attested", rng.choice([" ann ", "system"]), key, AT + dt.timedelta(rng.randrange(3)), None))
        rows += [rows[0], *(rng.sample(used, 5) if used else [])]
        used += rows
        batches.append(rows)
    for b, rows in enumerate(batches):
        df = spark.createDataFrame(rows, E.EVENT)
        E.append(df, path, b)
        E.append(df.repartition(3), path, b)
        for r in sorted({r[4]: r for r in rows if r[4].startswith(f"{b}-")}.values(), key=lambda r: (r[5], r[4])):
            own = want.setdefault(r[:2], [])
            own.append((len(own) + 1, r[4], b))
    got = {}
    for r in E.read_log(spark, path).orderBy("seq").collect():
        got.setdefault((r["entity_type"], r["entity_id"]), []).append((r["seq"], r["key"], r["batch"]))
        assert r["actor"] in ("ann", "system")
    assert got == want


def test_what_is_no_event_is_refused(spark):
    path = scratch(spark, "test-log")
    for bad in (("question", "1", "attested", " \n", "k", AT, None), ("planet", "1", "attested", "a", "k", AT, None), ("question", "1", "exploded", "a", "k", AT, None), ("question", None, "attested", "a", "k", AT, None)):
        with pytest.raises(ValueError, match="not an event"):
            E.append(spark.createDataFrame([("answer", "1", "attested", "a", "z", AT, None), bad], E.EVENT), path, 0)
    assert not E._there(spark, f"{path}/log")


def test_a_stream_appends(spark, tmp_path):
    path = scratch(spark, "test-log")
    source = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([("fact", "7", "fact_expired", "system", f"k{i}", AT, "{}")], E.EVENT).coalesce(1).write.mode("append").parquet(source)
        E.append_stream(spark.readStream.schema(E.EVENT).parquet(source), path, str(tmp_path / "check")).awaitTermination()
    assert [(r["seq"], r["key"]) for r in E.read_log(spark, path).orderBy("seq").collect()] == [(1, "k0"), (2, "k1"), (3, "k2")]


def test_operators_as_events(spark):
    acted = spark.createDataFrame([(1, [(0, "attest", "attested"), (1, "dispute", "refused")])], "answer_id int, events array<struct<index:int,action:string,outcome:string>>")
    actions = spark.createDataFrame([(1, 0, "attest", "ann", None), (1, 1, "dispute", "bob", None)], "answer_id int, index int, action string, actor string, note string")
    at = F.lit(AT)
    assert [(r["entity_id"], r["event_type"], r["actor"]) for r in E.of_actions(acted, actions, at).collect()] == [("1", "attested", "ann")]
    changed = spark.createDataFrame([(1, 5, [2], 0), (2, 6, [], 0)], "answer_id int, question_id int, changed array<int>, n_checklist int")
    assert [(r["entity_id"], r["payload"]) for r in E.of_invalidations(changed, at).collect()] == [("5", '{"answer_id":1,"segment_indices":[2]}')]
