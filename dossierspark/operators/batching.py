"""Windows over ordered rows with resets: extraction windows, row batches, even samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS
from .components import in_order


def _token_windows(limit: int, overlap: bool):
    """The windows of sections that come sorted by document; between batches only the last section and the tokens so far are held."""
    back = int(overlap)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            known, ids = batch["document_id"].is_valid().to_numpy(False), pc.fill_null(batch["document_id"], 0).to_numpy()
            at, cost = batch["order_index"].to_numpy(), batch["tokens"].to_numpy().astype(np.int64) + DEFAULTS.label_tokens
            more = held is not None and (held["known"], held["id"]) == (known[0], ids[0])
            if more:  # the section before the batch stands in front of it once more
                known, ids = np.r_[held["known"], known], np.r_[held["id"], ids]
                at, cost = np.r_[held["at"], at].astype(at.dtype), np.r_[held["cost"], cost]
            n = len(ids)
            opens = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])])
            ends, total, place = np.append(opens[1:], n), np.append(0, np.cumsum(cost)), np.arange(n)
            # the section that is too much for a window which holds these tokens less
            over = lambda before: np.searchsorted(total, before + limit, side="right") - 1
            first = np.maximum(opens + 1, over(total[opens]))
            if more:
                first[0] = max(1, over(cost[0] - held["used"]))
            following = np.maximum(place + 1, over(total[np.maximum(place - back, 0)])).tolist()
            cuts = []
            for cut, end in zip(first.tolist(), ends.tolist()):
                while cut < end:
                    cuts.append(cut)
                    cut = following[cut]
            cuts = np.array(cuts, np.int64)
            window = np.zeros(n, np.int64)
            window[cuts] = 1
            window = np.cumsum(window)
            window -= np.repeat(window[opens], ends - opens)
            if more:
                window[: ends[0]] += held["window"]
            if len(cuts) and cuts[-1] >= opens[-1]:
                used = total[n] - total[cuts[-1] - back]
            else:
                used = total[n] - total[opens[-1]] + (held["used"] - cost[0] if more and len(opens) == 1 else 0)
            held = {"known": known[-1], "id": ids[-1], "at": at[-1], "cost": cost[-1], "used": used, "window": window[-1]}
            again = cuts[: len(cuts) * back]
            rows, sections = np.r_[place[int(more) :], again], np.r_[at[int(more) :], at[again - 1]]
            columns = [pa.array(ids[rows], pa.int64(), mask=~known[rows]), pa.array(window[rows], pa.int32()), pa.array(sections, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["document_id", "window", "order_index"])

    return fold


def token_windows(sections: DataFrame, limit: int = DEFAULTS.pair_window_tokens, overlap: bool = True) -> DataFrame:
    """document_id, window, order_index: sections in windows of about `limit` tokens.

    A window closes before the section that would exceed the limit; with overlap its last section opens
    the next one. Sections are sorted by document and folded by batches, so a document of any length takes
    bounded memory. sections: document_id, order_index, tokens.
    """
    rows = sections.select(F.col("document_id").cast("long").alias("document_id"), "order_index", "tokens")
    return in_order(rows, ["document_id"], "order_index").mapInArrow(_token_windows(limit, overlap), "document_id long, window int, order_index int")


def row_batches(sections: DataFrame, size: int = DEFAULTS.row_batch) -> DataFrame:
    """Adds batch (from 0): prose is a batch of its own, runs of table rows are cut by `size`; blank ones go.

    sections: document_id, order_index, text, is_row.
    """
    w = Window.partitionBy("document_id").orderBy("order_index")
    kept = sections.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    runs = kept.withColumn("island", F.sum(F.when(F.col("is_row") & F.coalesce(F.lag("is_row").over(w), F.lit(False)), 0).otherwise(1)).over(w))
    at = F.row_number().over(Window.partitionBy("document_id", "island").orderBy("order_index")) - 1
    opens = runs.withColumn("opens", (at % size == 0).cast("int"))
    return opens.withColumn("batch", F.sum("opens").over(w) - 1).drop("island", "opens")


def spread_sample(rows: DataFrame, group: str, order: str, head: int = 12, more: int = 8) -> DataFrame:
    """The first `head` rows of each group and `more` evenly spaced ones of the rest."""
    w = Window.partitionBy(group)
    numbered = rows.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    rest = F.col("n") - head
    spaced = F.transform(F.sequence(F.lit(0), F.lit(more - 1)), lambda k: (F.lit(head) + F.floor(k * rest / more)).cast("long"))
    return numbered.where((F.col("i") < head) | F.when(rest <= more, True).otherwise(F.array_contains(spaced, F.col("i").cast("long")))).drop("i", "n")


def unpaired_queue(items: DataFrame, fragments: DataFrame) -> DataFrame:
    """Unverified items and unresolved fragments in one list."""
    a = items.where(~F.col("verified")).withColumn("queue", F.lit("item"))
    b = fragments.where(~F.col("resolved")).withColumn("queue", F.lit("fragment"))
    return a.unionByName(b, allowMissingColumns=True)
