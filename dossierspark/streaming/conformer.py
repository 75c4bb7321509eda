"""Segments of a running draft to one segment a sentence: a batch fold, and the same fold as a stream.

Input rows: run_id, seq, segment struct<text, paragraph, kind, sources array<struct<source_type,
source_id>>>. A sentence that is not ended is held and joined with the next segment of its paragraph; it
leaves when the next paragraph begins or the run is over. Only a sentence made of both texts has the
sources of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.spans import is_terminal, sentences_of

OUT = "run_id long, index int, paragraph int, text string, kind string, sources array<struct<source_type:string,source_id:string>>"
STATE = "next_index int, text string, paragraph int, kind string, types array<string>, ids array<string>"
_NAMES = [c.split()[0] for c in OUT.split(", ")][:6]


def _sources(value) -> list[dict]:
    """Sources as plain dicts, one for each type and id."""
    rows = [] if value is None else [dict(x) if isinstance(x, dict) else x.asDict() for x in value]
    first: dict = {}
    for x in rows:
        first.setdefault((x["source_type"], x["source_id"]), x)
    return list(first.values())


def fold(held: dict | None, segment: dict) -> tuple[list[dict], dict | None]:
    """Finished sentences after one more segment, and what is held now."""
    text = segment["text"] or ""
    if not text.strip():
        return [], held
    now = {"paragraph": int(segment["paragraph"] or 0), "kind": "connective" if segment["kind"] == "connective" else "substantive", "sources": _sources(segment["sources"])}
    done = []
    if held and now["paragraph"] > held["paragraph"]:
        done, held = [held], None
    size = 0
    if held:
        size, text = len(held["text"]), f"{held['text']} {text.strip()}"
    both = held and {
        "paragraph": held["paragraph"],
        "kind": "substantive" if "substantive" in (held["kind"], now["kind"]) else "connective",
        "sources": _sources(held["sources"] + now["sources"]),
    }
    made = [{**(now if s["start"] >= size else held if s["end"] <= size else both), "text": s["text"]} for s in sentences_of(text)]
    if made and not is_terminal(made[-1]["text"]):
        return done + made[:-1], made[-1]
    return done + made, None


def conform_batch(stream: DataFrame) -> DataFrame:
    """The sentences of every run; a run's segments are folded in order of seq."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held, out = None, []
        for s in rows.sort_values("seq")["segment"]:
            done, held = fold(held, s if isinstance(s, dict) else s.asDict())
            out += done
        return _frame(rows["run_id"].iloc[0], 0, out + ([held] if held else []))

    return stream.groupBy("run_id").applyInPandas(run, OUT)


def _frame(run_id, start: int, made: list[dict]) -> pd.DataFrame:
    rows = [{"run_id": run_id, "index": start + i, **{k: m[k] for k in ("paragraph", "text", "kind", "sources")}} for i, m in enumerate(made)]
    return pd.DataFrame(rows, columns=_NAMES)


def conform_stream(stream: DataFrame) -> DataFrame:
    """The same over a streaming DataFrame with a boolean column `last` on the final row of a run.

    The state is one held sentence and the next index; rows of one micro-batch are folded by seq.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        index, held = 0, None
        if state.exists:
            index, text, paragraph, kind, types, ids = state.get
            held = None if text is None else {"text": text, "paragraph": paragraph, "kind": kind, "sources": [{"source_type": t, "source_id": i} for t, i in zip(types, ids)]}
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for s in rows["segment"]:
            done, held = fold(held, s if isinstance(s, dict) else s.asDict())
            out += done
        if bool(rows["last"].any()):
            out, held = out + ([held] if held else []), None
            state.remove()
        else:
            h = held or {"text": None, "paragraph": None, "kind": None, "sources": []}
            state.update((index + len(out), h["text"], h["paragraph"], h["kind"], [x["source_type"] for x in h["sources"]], [x["source_id"] for x in h["sources"]]))
        yield _frame(key[0], index, out)

    return stream.groupBy("run_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def last_events(events: DataFrame) -> DataFrame:
    """The state of every (run, index) after its last segment event; `done` events replace what came before.

    events: run_id, seq, type, index, payload. Works on a stream (update mode) and on a table.
    """
    return events.where(F.col("type").isin("segment", "support")).groupBy("run_id", "index").agg(F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"))


def sweep_expired(facts: DataFrame, checkpoint: str, path: str, every: str | None = None):
    """A query that appends the facts expired on the day of each batch to `path`; by default it runs once."""
    from ..operators.lineage import expired

    def each(batch: DataFrame, _: int) -> None:
        expired(batch, F.current_date()).select("fact_id").write.mode("append").parquet(path)

    writer = facts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by type and hour over a stream with late rows."""
    return events.withWatermark("ts", late).groupBy("event_type", F.window("ts", size)).agg(F.count("*").alias("n"))
