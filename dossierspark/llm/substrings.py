"""Substring dedup: passages of WINDOW words that a document of smaller id has too are taken out.

Suffixes of the corpus are compared in subtrees that each fit into memory. A suffix tree needs one suffix for each
window only: among the GRAM-word beginnings inside a window the one of least hash is its anchor, and equal windows
have equal anchors at equal places. So suffixes begin at anchors alone (about one word in eighteen), each with the
words before it that its windows reach back to.

1. Texts: one row for each document (word count, anchors), one for each distinct text with its smallest id.
   Of a text's other documents all words go, as a whole window of theirs is in the first.
2. Prefixes: suffixes are split by their first GRAM words, their number and the smallest and greatest id counted.
   A prefix of one id alone holds no repeat and ends here. A prefix of more than GROUP suffixes is dealt out by
   text into parts of about that size.
3. Subtrees: texts with open prefixes give their suffixes to the parts. A task takes whole parts, sorts their
   suffixes, and reads the internal nodes from the common prefixes of neighbours; a window that begins o words before
   its anchor is a repeat where a node WINDOW - o deep and a node o deep of the reversed left contexts meet, and it is
   removed unless it has the smallest id there.
4. Dealt-out prefixes go on by their longest prefix, the window itself: of each part only windows that are first there
   are left, and those of equal words meet in one aggregate.
5. Removed windows are joined to their texts; words are dropped and the rest hashed.

Nulls: a null text has no words; a null doc_id counts as one id, smaller than all others (and equal to the
least long). Texts of fewer than WINDOW words lose nothing. Very long texts are one row, their suffixes are spread
over the parts. Ties: documents of equal id take nothing from each other, whatever their texts. Repeated rows
give repeated results. An empty table gives none. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded_batches, gives_back, mix64, utf8, written

WINDOW = 50
#: Words of the first prefix; a window has WINDOW - GRAM + 1 places for it.
GRAM = 15
PLACES = WINDOW - GRAM + 1
#: Suffixes of one part at most, more or less; a task holds as many at a time.
GROUP = 8192
STEP = np.uint64(0x9E3779B97F4A7C15)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def word_hashes(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter((memo[w] for w in words), np.uint64, len(words))


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, place, first window, last window) of each anchor; every window has one, the first of its least grams."""
    n = len(hashes)
    if n < WINDOW:
        none = np.zeros(0, np.int64)
        return none.view(np.int64), none, none, none
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for j in range(GRAM):
        grams = grams * STEP + hashes[j : n - GRAM + 1 + j]
    grams = mix64(grams)
    place = np.lib.stride_tricks.sliding_window_view(grams, PLACES).argmin(axis=1) + np.arange(n - WINDOW + 1)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:] - 1, len(place) - 1]
    return grams[place[first]].view(np.int64), place[first], first, last


FACTS = "doc_id long, doc_key long, blob binary, n_words long, kept_sha256 string, grams array<long>, places array<int>, firsts array<int>, lasts array<int>"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Memo(xxhash.xxh3_64_intdigest)
    for batch in batches:
        n_words, shas, found = [], [], []
        for text in batch["text"]:
            words = utf8(text.as_py()).split()
            n_words.append(len(words))
            shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
            found.append(anchors(word_hashes(words, memo)))
        offsets = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
        lists = [
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found]) if found else [], kind))
            for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))
        ]
        columns = [batch["doc_id"], batch["doc_key"], batch["blob"], pa.array(n_words, pa.int64()), pa.array(shas, pa.string()), *lists]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FACTS.split(", ")])


SUFFIXES = "gram long, part int, hot boolean, doc_key long, blob binary, first int, before int, starts int, words binary"


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each anchor: the words its windows cover, and where in them it stands."""
    names = [c.split()[0] for c in SUFFIXES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        for text, blob, key, marks in zip(batch["text"], batch["blob"].to_pylist(), batch["doc_key"].to_pylist(), batch["marks"]):
            words = utf8(text.as_py()).split()
            rows = [
                (m["gram"], m["part"], m["hot"], key, blob, m["first"], m["place"] - m["first"], m["last"] - m["first"] + 1, b" ".join(words[m["first"] : m["last"] + WINDOW]))
                for m in marks.as_py()
            ]
            for lo in range(0, len(rows), GROUP):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + GROUP]), kinds)], names)


class Subtrees:
    """Suffixes sorted by their symbols; nodes are runs of neighbours with long common prefixes."""

    def __init__(self, symbols: np.ndarray):
        n, width = symbols.shape
        keys = np.ascontiguousarray(symbols, ">u4").view(f"V{4 * width}").ravel()
        self.order = np.argsort(keys, kind="stable")
        s = symbols[self.order]
        unlike = s[1:] != s[:-1]
        self.common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)

    def nodes(self, depth: int) -> np.ndarray:
        """For each suffix the topmost node that is at least `depth` symbols deep."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.r_[0, np.cumsum(self.common < depth)] if len(self.order) else 0
        return out


def repeats(texts: list[bytes], before: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """flags[e, s]: window s of suffix e has the words of a window of smaller key."""
    n = len(texts)
    right, left = np.zeros((n, WINDOW), np.uint32), np.zeros((n, PLACES - 1), np.uint32)
    ids: dict[bytes, int] = {}
    for e, (text, b) in enumerate(zip(texts, before.tolist())):
        codes = [ids.setdefault(w, len(ids) + 1) for w in text.split(b" ")]
        right[e, : len(codes) - b] = codes[b:]
        left[e, :b] = codes[:b][::-1]
    after, ahead = Subtrees(right), Subtrees(left)
    flags = np.zeros((n, PLACES), bool)
    for o in range(PLACES):
        here = np.flatnonzero((before >= o) & (before - o < starts))
        if len(here) < 2:
            continue
        node = after.nodes(WINDOW - o)[here] * n + ahead.nodes(o)[here]
        order = np.lexsort((keys[here], node))
        node, key = node[order], keys[here][order]
        head = np.r_[True, node[1:] != node[:-1]]
        least = key[head][np.cumsum(head) - 1]
        gone = here[order[key > least]]
        flags[gone, before[gone] - o] = True
    return flags


FOUND = "blob binary, doc_key long, first int, last int, window binary"


def _whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole parts (rows come sorted by gram and part), of GROUP rows or a few more where they can be."""
    rest: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        rest.append(batch)
        held += len(batch)
        if held < GROUP:
            continue
        rows = pa.Table.from_batches(rest)
        gram, part = rows["gram"].to_numpy(), rows["part"].to_numpy()
        cut = np.flatnonzero((gram[1:] != gram[:-1]) | (part[1:] != part[:-1]))
        if len(cut):
            at = int(cut[-1]) + 1
            yield rows.slice(0, at)
            rows = rows.slice(at)
        rest, held = rows.combine_chunks().to_batches(), len(rows)
    if held:
        yield pa.Table.from_batches(rest)


@gives_back
def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed windows as ranges; of parts of dealt-out prefixes also each window that is first there."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    for rows in _whole_parts(batches):
        first, before, starts, keys = (rows[c].to_numpy() for c in ("first", "before", "starts", "doc_key"))
        texts, blobs, hot = rows["words"].to_pylist(), rows["blob"].combine_chunks(), rows["hot"].to_numpy()
        flags = repeats(texts, before, starts, keys)
        edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (e, lo), (_, hi) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        if len(e):
            columns = [blobs.take(pa.array(e)), pa.array(keys[e]), pa.array((first[e] + lo).astype(np.int32)), pa.array((first[e] + hi - 1).astype(np.int32)), pa.nulls(len(e), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
        for e in np.flatnonzero(hot):
            words = texts[e].split(b" ")
            at = np.flatnonzero(~flags[e, : starts[e]])
            if len(at):
                own = [hashlib.blake2b(b" ".join(words[s : s + WINDOW]), digest_size=16).digest() for s in at]
                place = pa.array((first[e] + at).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([blobs[e].as_py()] * len(at), pa.binary()), pa.array([keys[e]] * len(at)), place, place, pa.array(own, pa.binary())], names)


KEPT = "blob binary, n_removed long, kept_sha256 string"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, shas = [], []
        for text, spans in zip(batch["text"], batch["spans"]):
            words = utf8(text.as_py()).split()
            edge = np.zeros(len(words) + 1, np.int64)
            ranges = np.array([(s["first"], s["last"] + WINDOW) for s in spans.as_py()])
            np.add.at(edge, ranges[:, 0], 1)
            np.add.at(edge, ranges[:, 1], -1)
            keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            removed.append(len(words) - len(keep))
            shas.append(hashlib.sha256(b" ".join([words[i] for i in keep])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch["blob"], pa.array(removed, pa.int64()), pa.array(shas, pa.string())], [c.split()[0] for c in KEPT.split(", ")])


def removed_windows(docs: DataFrame, firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts with open prefixes, their removed windows (blob, first, last))."""
    suffixes = firsts.select("blob", F.col("least").alias("doc_key"), F.expr("inline(arrays_zip(grams, places, firsts, lasts))")).toDF(
        "blob", "doc_key", "gram", "place", "first", "last"
    )
    # written: a join of two plain shuffles is one whose hot keys Spark splits
    prefixes = written(
        suffixes.groupBy("gram")
        .agg(F.count("*").alias("n"), F.min("doc_key").alias("lo"), F.max("doc_key").alias("hi"))
        .where("lo < hi")
        .select("gram", (F.col("n") > GROUP).alias("hot"), F.ceil(F.col("n") / F.lit(GROUP / 2)).cast("int").alias("parts")),
        "substring-prefixes",
    )
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("blob"), F.col("parts")).cast("int")).otherwise(0)
    marks = (
        suffixes.join(prefixes, "gram")
        .groupBy("blob", "doc_key")
        .agg(F.collect_list(F.struct("gram", part.alias("part"), "hot", "place", "first", "last")).alias("marks"))
    )
    texts = written(docs.join(marks, ["blob", "doc_key"]).select("blob", "doc_key", "text", "marks"), "substring-texts")
    found = written(
        texts.mapInArrow(_suffixes, SUFFIXES).repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(_subtrees, FOUND),
        "substring-found",
    )
    open_ = found.where("window is not null")
    least = written(open_.groupBy("window").agg(F.min("doc_key").alias("lo"), F.max("doc_key").alias("hi")).where("lo < hi"), "substring-least")
    late = open_.join(least, "window").where("doc_key > lo").select("blob", "first", "last")
    return texts, found.where("window is null").select("blob", "first", "last").union(late)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 of the words that stay."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_key"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"),
        text.alias("text"),
    )
    facts = written(rows.mapInArrow(_facts, FACTS), "substring-facts")
    firsts = written(
        facts.groupBy("blob").agg(
            F.min("doc_key").alias("least"), F.min_by(F.struct("grams", "places", "firsts", "lasts"), "doc_key").alias("a")
        ).select("blob", "least", "a.*"),
        "substring-firsts",
    )
    texts, spans = removed_windows(rows.select("blob", "doc_key", "text"), firsts)
    spans = spans.groupBy("blob").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    less = texts.select("blob", "text").join(spans, "blob").mapInArrow(_kept, KEPT).dropDuplicates(["blob"])
    less = firsts.select("blob", "least").join(less.withColumnRenamed("kept_sha256", "less_sha256"), "blob", "left")
    copy = (F.col("doc_key") > F.col("least")) & (F.col("n_words") >= WINDOW)
    own = F.col("doc_key") == F.col("least")
    return facts.select("doc_id", "doc_key", "blob", "n_words", "kept_sha256").join(less, "blob").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).when(own, F.coalesce("less_sha256", "kept_sha256")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
