"""Supersession to a fixed point against a plain loop; a second run changes nothing."""

import datetime as dt
import random

import pytest

from dossierspark.operators import supersession as S

DOCS = "document_id long, org_id long, doc_type string, doc_kind string, confirmed boolean, effective_date date, date_source string, date_changed_at timestamp, superseded_by long"
DECISIONS = "a_id long, b_id long, doc_kind string, newer_id long, decided_at timestamp"
DAY = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
AT = lambda i: dt.datetime(2024, 6, 1) + dt.timedelta(i)


def able(d):
    return d["doc_type"] == "reference" and d["doc_kind"] in ("iso_27001", "information_security_policy", "dspt_confirmation") and d["confirmed"]


def loop(docs, decisions):
    """(pointers, states by pair): live documents from the latest date down, one at a time."""
    by, last = {d["document_id"]: d for d in docs}, {}
    for x in decisions:
        pair = frozenset(x[:2])
        if None not in pair and len(pair) == 2 and (pair not in last or x[4] >= last[pair][4]):
            last[pair] = x
    states = {}
    for pair, (a, b, kind, newer, at) in last.items():
        x, y = by.get(a), by.get(b)
        fine = x and y and able(x) and able(y) and x["org_id"] == y["org_id"] and x["doc_kind"] == y["doc_kind"] == kind and newer in (None, a, b)
        late = fine and any(d["date_changed_at"] and d["date_changed_at"] > at for d in (x, y))
        states[pair] = "removed" if not fine else "reset" if late else "stands"
    stands = {p: last[p][3] for p, s in states.items() if s == "stands"}
    date = lambda i: by[i]["effective_date"] or dt.date.min
    pointers = {}
    for p, newer in stands.items():
        if newer is not None:
            (older,) = p - {newer}
            pointers[older] = max(pointers.get(older, newer), newer, key=lambda i: (date(i), i))
    auto = [d for d in docs if able(d) and d["doc_kind"] != "dspt_confirmation" and d["effective_date"] and d["date_source"] != "upload_time" and d["document_id"] not in pointers]
    live = []
    for d in sorted(auto, key=lambda d: d["effective_date"], reverse=True):
        over = [e for e in live if e["org_id"] == d["org_id"] and e["doc_kind"] == d["doc_kind"] and e["effective_date"] > d["effective_date"] and frozenset((d["document_id"], e["document_id"])) not in stands]
        if over:
            pointers[d["document_id"]] = max(over, key=lambda e: (e["effective_date"], e["document_id"]))["document_id"]
        else:
            live.append(d)
    return pointers, states


def made(seed, n=260):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        docs.append(
            {
                "document_id": i, "org_id": rng.randrange(3), "doc_type": rng.choice(["reference"] * 9 + ["past_submission"]),
                "doc_kind": rng.choice(["iso_27001"] * 3 + ["information_security_policy", "dspt_confirmation", "other"]), "confirmed": rng.random() < 0.9,
                "effective_date": rng.choice([None, *map(DAY, range(12))]), "date_source": rng.choice(["stated"] * 6 + ["upload_time"]),
                "date_changed_at": rng.choice([None, None, None, AT(5)]), "superseded_by": rng.choice([None, None, rng.randrange(n)]),
            }
        )
    decisions = []
    for k in range(3 * n):
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b:
            decisions.append((a, b, docs[a]["doc_kind"], rng.choice([None, None, a, b]), AT(rng.randrange(10) + k / 1e4)))
    for x in rng.sample(range(n), 20):  # documents kept beside all the latest ones
        decisions += [(x, y, docs[x]["doc_kind"], None, AT(20 + i)) for i, y in enumerate(range(n)) if y != x and docs[y]["effective_date"] and docs[y]["effective_date"] >= DAY(9)]
    _, states = loop(docs, decisions)
    for pair, state in states.items():  # pointers that go back to a decision
        a, b = pair
        if state != "removed" or rng.random() < 0.02:
            docs[a]["superseded_by"] = b
    items = [(100 * i + k, i, rng.choice([True, False, None])) for i in range(n) for k in range(rng.randrange(4))]
    facts = [(100 * i + k, i, rng.random() < 0.7) for i in range(n) for k in range(rng.randrange(3))]
    return docs, decisions, items, facts


def run(spark, docs, decisions, items, facts):
    names = [c.split()[0] for c in DOCS.split(", ")]
    return S.supersede(
        spark.createDataFrame([tuple(d[c] for c in names) for d in docs], DOCS), spark.createDataFrame(decisions, DECISIONS),
        spark.createDataFrame(items, "item_id long, document_id long, excluded boolean"), spark.createDataFrame(facts, "fact_id long, document_id long, current boolean"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_loop_and_rests(spark, seed):
    docs, decisions, items, facts = made(seed)
    out = run(spark, docs, decisions, items, facts)
    pointers, states = loop(docs, decisions)
    got = {r[0]: r[1] for r in out.pointers.collect()}
    assert {k: v for k, v in got.items() if v is not None} == pointers and len(got) == len(docs)
    kept = out.decisions.collect()
    assert {frozenset((r["a_id"], r["b_id"])): r["state"] for r in kept} == states and set(states.values()) == {"stands", "reset", "removed"}
    events = {r["document_id"]: r for r in out.events.collect()}
    hidden = {r["item_id"]: r["excluded"] for r in out.items.collect()}
    reasons = set()
    for d in docs:
        i, before, after = d["document_id"], d["superseded_by"], pointers.get(d["document_id"])
        own = [(x[0], bool(x[2])) for x in items if x[1] == i]
        if after is None and before is not None:
            e, state = events.pop(i), states.get(frozenset((i, before)))
            want = {"stands": "keep_both", "reset": "date_changed", "removed": "decision_removed", None: "re_evaluated"}[state]
            assert (e["event"], e["reason"], e["n_items"], e["n_facts"]) == ("supersession_reversed", want, sum(x for _, x in own), 0)
            assert not any(hidden[k] for k, _ in own)
            reasons.add(want)
        elif after is not None and before is None:
            e = events.pop(i)
            assert (e["event"], e["superseded_by"], e["n_items"]) == ("document_superseded", after, sum(not x for _, x in own))
            assert e["n_facts"] == sum(f[1] == i and f[2] for f in facts)
        if after is not None:
            assert all(hidden[k] for k, _ in own)
        elif before is None:
            assert all(hidden[k] == x for k, x in own)
    assert not events and reasons == {"keep_both", "date_changed", "decision_removed", "re_evaluated"}
    again = [{**d, "superseded_by": got[d["document_id"]]} for d in docs]
    left = [(r["a_id"], r["b_id"], r["doc_kind"], r["newer_id"], r["decided_at"]) for r in kept if r["state"] == "stands"]
    second = run(spark, again, left, [(r[0], r[1], r[2]) for r in out.items.collect()], facts)
    assert second.events.count() == 0 and {r[0]: r[1] for r in second.pointers.collect()} == got
    assert {r["item_id"]: r["excluded"] for r in second.items.collect()} == hidden


def test_ties_and_chains_of_kept_documents(spark):
    """Two latest ones stand side by side; one kept beside both is live itself and supersedes an older one kept beside both."""
    doc = lambda i, day, by=None: dict(document_id=i, org_id=1, doc_type="reference", doc_kind="iso_27001", confirmed=True, effective_date=DAY(day), date_source=None, date_changed_at=None, superseded_by=by)
    docs = [doc(1, 9), doc(2, 9), doc(3, 5), doc(4, 3), doc(5, 1)]
    keep = [(3, 1, "iso_27001", None, AT(0)), (2, 3, "iso_27001", None, AT(0)), (4, 1, "iso_27001", None, AT(0)), (4, 2, "iso_27001", None, AT(0)), (5, 2, "iso_27001", None, AT(0))]
    out = run(spark, docs, keep, [], [])
    assert {r[0]: r[1] for r in out.pointers.collect()} == {1: None, 2: None, 3: None, 4: 3, 5: 1} == {i: loop(docs, keep)[0].get(i) for i in range(1, 6)}


def test_empty(spark):
    out = run(spark, [], [], [], [])
    assert out.pointers.count() == out.events.count() == out.items.count() == 0
