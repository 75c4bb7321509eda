"""Operator 5: benchmark decontamination through an FM-index of each training shard.

Words are runs of digits, letters and non-ASCII characters with A-Z lowered. Test phrases are all
windows of 10 consecutive words of an item (a shorter item is one window). Each task gathers its
documents into shards, keeps the runs of words that occur in any test phrase and are long enough to
hold one (nothing else can be part of an occurrence), and indexes them: suffix order by prefix
doubling, Burrows-Wheeler transform, wavelet matrix for ranks, and sampled suffix positions. All
phrases are searched backwards at once; occurrences are located by walking to a sampled position, and
their spans are merged into removal spans.

Phrases reach the tasks in blocks of bounded size (ITEMS_BLOCK items, CHARS_BLOCK characters, checked
by counts), one pass over the documents for each block. Null, empty and word-less texts have no words
and are clean; null or word-less items have no windows. An item without an id counts like any other (all
such items as one), only the list of ids can't name it. Repeated rows give repeated results, a very long
text is searched as a whole, equal windows of several items count for each, and an empty table on either
side gives no hits. Other columns are kept by clean_documents() and left aside by the reports.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, utf8

WINDOW = 10
ITEMS_BLOCK, CHARS_BLOCK = 20_000, 16 << 20
SHARD_WORDS = 400_000
SAMPLE = 16
#: Lower-case A-Z; all ASCII but letters and digits parts words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(WORD_BYTES).split()


class Phrases:
    """The distinct windows of a block of items, and the items of each window."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        wins: dict[tuple, int] = {}
        owners: list[dict[int, None]] = []
        self.ids = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for j in range(max(1, len(codes) - window + 1) if codes else 0):
                at = wins.setdefault(tuple(codes[j : j + window]), len(wins))
                if at == len(owners):
                    owners.append({})
                owners[at][k] = None
        self.lengths = np.array([len(w) for w in wins], np.int64)
        self.shortest = int(self.lengths.min()) if len(wins) else 0
        #: Column j: the j-th symbol from the end; 0 beyond the phrase's start.
        self.back = np.zeros((len(wins), window), np.int64)
        for i, w in enumerate(wins):
            self.back[i, : len(w)] = w[::-1]
        self.owner_starts = np.r_[0, np.cumsum([len(o) for o in owners])].astype(np.int64)
        self.owners = np.array([k for o in owners for k in o], np.int64)


class WaveletMatrix:
    """Ranks of any symbol at any place; one table of ones before each place for every bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often symbol occurs before place."""
        start, end = np.zeros_like(place), place.copy()
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            s, e = self.ones[level][start], self.ones[level][end]
            start = np.where(one, self.zeros[level] + s, start - s)
            end = np.where(one, self.zeros[level] + e, end - e)
        return end - start


class FMIndex:
    """Index of runs of symbols (1..vocabulary), each run closed by a separator of its own."""

    def __init__(self, text: np.ndarray, vocabulary: int):
        #: text: 0 stands for a separator; the last symbol is one.
        n = len(text)
        seps = text == 0
        rank = np.where(seps, np.cumsum(seps) - 1, text + (int(seps.sum()) - 1)).astype(np.int64)
        order, width = np.argsort(rank, kind="stable"), 1
        while True:
            after = np.zeros(n, np.int64)
            after[:-width] = rank[width:] + 1
            both = rank * (int(rank.max()) + 2) + after
            order = np.argsort(both, kind="stable")
            step = np.r_[0, (np.diff(both[order]) != 0).astype(np.int64)]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step)
            width *= 2
            if step.sum() == n - 1 or width >= n:
                break
        bwt = text[order - 1]
        self.bwt = bwt.astype(np.int64)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=vocabulary + 1))].astype(np.int64)
        self.tree = WaveletMatrix(self.bwt, max(1, int(vocabulary).bit_length()))
        #: Sampled by position, and wherever a run starts, so that no walk leaves its run.
        self.sampled = (order % SAMPLE == 0) | (self.bwt == 0)
        self.sample_rank = np.r_[0, np.cumsum(self.sampled)]
        self.positions = order[self.sampled]
        self.n = n

    def search(self, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For phrases given from their end: the ranges of suffixes that they start."""
        lo, hi = np.zeros(len(back), np.int64), np.full(len(back), self.n, np.int64)
        for j in range(back.shape[1]):
            live = np.flatnonzero((back[:, j] > 0) & (lo < hi))
            if not len(live):
                continue
            c = back[live, j]
            lo[live] = self.first[c] + self.tree.rank(c, lo[live])
            hi[live] = self.first[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while len(live := np.flatnonzero(~self.sampled[rows])):
            r = rows[live]
            c = self.bwt[r]
            rows[live] = self.first[c] + self.tree.rank(c, r)
            steps[live] += 1
        return self.positions[self.sample_rank[rows]] + steps


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... counts[i] of them, for every i in turn."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def shard_hits(codes: list[np.ndarray], phrases: Phrases) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document of a shard: merged spans of hit words (start, end by rows), and item numbers."""
    none = (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    out = [none] * len(codes)
    runs, doc_of, place_of = [], [], []
    for d, c in enumerate(codes):
        known = np.r_[0, (c > 0).astype(np.int8), 0]
        edge = np.flatnonzero(np.diff(known))
        for s, e in zip(edge[::2], edge[1::2]):
            if e - s >= phrases.shortest:
                runs += [c[s:e], np.zeros(1, c.dtype)]
                doc_of.append(np.full(e - s + 1, d))
                place_of.append(np.arange(s, e + 1))
    if not runs:
        return out
    index = FMIndex(np.concatenate(runs).astype(np.int64), len(phrases.vocabulary))
    doc_of, place_of = np.concatenate(doc_of), np.concatenate(place_of)
    lo, hi = index.search(phrases.back)
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return out
    times = hi[hit] - lo[hit]
    window = np.repeat(hit, times)
    at = index.locate(spread(lo[hit], times))
    docs, starts = doc_of[at], place_of[at]
    ends = starts + phrases.lengths[window]
    owned = np.unique(docs * len(phrases.lengths) + window)
    owner_doc, owner_win = np.divmod(owned, len(phrases.lengths))
    n = phrases.owner_starts[owner_win + 1] - phrases.owner_starts[owner_win]
    pairs = np.unique(np.repeat(owner_doc, n) * (len(phrases.ids) + 1) + phrases.owners[spread(phrases.owner_starts[owner_win], n)])
    pair_doc, pair_item = np.divmod(pairs, len(phrases.ids) + 1)
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order], ends[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(docs)) + 1, len(docs)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        reach = np.maximum.accumulate(ends[a:b])
        new = np.flatnonzero(np.r_[True, starts[a + 1 : b] > reach[:-1]])
        d = docs[a]
        i, j = np.searchsorted(pair_doc, [d, d + 1])
        out[d] = (np.column_stack([starts[a:b][new], reach[np.r_[new[1:] - 1, b - a - 1]]]), pair_item[i:j])
    return out


def merged(spans: list) -> list[list[int]]:
    """Spans [start, end) merged where they touch or overlap, in order."""
    out: list[list[int]] = []
    for s, e in sorted((int(s), int(e)) for s, e in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


FOUND = "doc_id long, text_hash binary, n_words long, spans array<array<long>>, items array<string>"


def _scan(docs: DataFrame, phrases: Phrases) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        get = p.vocabulary.get
        names = ["doc_id", "text_hash", "n_words", "spans", "items"]

        def flush(ids, hashes, codes):
            hits = shard_hits(codes, p) if len(p.lengths) else [(np.zeros((0, 2), np.int64), np.zeros(0, np.int64))] * len(codes)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(hashes, pa.binary()),
                    pa.array([len(c) for c in codes], pa.int64()),
                    pa.array([s.tolist() for s, _ in hits], pa.list_(pa.list_(pa.int64()))),
                    pa.array([[p.ids[k] for k in i] for _, i in hits], pa.list_(pa.string())),
                ],
                names,
            )

        ids, hashes, codes, held = [], [], [], 0
        for batch in batches:
            for i, t in zip(batch["doc_id"], batch["text"]):
                t = t.as_py()
                words = words_of(t)
                ids.append(i.as_py())
                hashes.append(hashlib.blake2b(utf8(t), digest_size=16).digest())
                codes.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
                held += len(words)
                if held >= SHARD_WORDS:
                    yield flush(ids, hashes, codes)
                    ids, hashes, codes, held = [], [], [], 0
        if ids:
            yield flush(ids, hashes, codes)

    return docs.mapInArrow(scan, FOUND)


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW) -> Iterator[Phrases]:
    """The test phrases in blocks whose size has been checked; one block at least."""
    bounded_batches(benchmark.sparkSession)
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // ITEMS_BLOCK), -(-size["chars"] // CHARS_BLOCK))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        own = [(r["item_id"], r["text"]) for r in items.where(block == b).toLocalIterator()]
        yield Phrases(sorted(own, key=lambda r: (r[0] is not None, r[0] or "", r[1])), window)


def find_phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (merged, in words) and items of every document row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scans = [_scan(docs, p) for p in phrase_blocks(benchmark, window)]
    if len(scans) == 1:
        return scans[0].select("doc_id", "n_words", "spans", "items")
    all_found = scans[0].withColumn("b", F.lit(0))
    for b, s in enumerate(scans[1:], 1):
        all_found = all_found.unionByName(s.withColumn("b", F.lit(b)))
    merge = F.udf(lambda spans: merged(spans), "array<array<long>>")  # only where several blocks hit
    per_row = all_found.groupBy("doc_id", "text_hash").agg(
        F.first("n_words").alias("n_words"),
        F.sum(F.when(F.col("b") == 0, 1).otherwise(0)).alias("copies"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    return per_row.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "n_words", F.when(F.size("spans") > 0, merge("spans")).otherwise(F.col("spans")).alias("spans"), "items"
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The report: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_phrases(docs, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def cut_spans(text: str | None, spans: list) -> str | None:
    """The text without the words in spans (and what stands between them); a blank line marks each cut."""
    if text is None or not len(spans):
        return text
    data = utf8(text)
    plain = np.frombuffer(data.translate(WORD_BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[0, plain.astype(np.int8), 0]))
    starts, ends, out, at = edge[::2], edge[1::2], [], 0
    for s, e in spans:
        out.append(data[at : starts[s]])
        at = ends[e - 1]
    return b"\n\n".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no test phrase occurs, with all their columns; no shuffle, and texts stay in the JVM."""
    for phrases in phrase_blocks(benchmark, window):
        if len(phrases.lengths):
            docs = docs.where(is_clean(docs, phrases)("text"))
    return docs


def is_clean(docs: DataFrame, phrases: Phrases):
    """Whether a text holds none of the phrases, as a UDF."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        p = shared.value
        get = p.vocabulary.get
        out, codes, held = [], [], 0
        for t in text:
            words = words_of(t.as_py())
            codes.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
            held += len(words)
            if held >= SHARD_WORDS:
                out += [not len(spans) for spans, _ in shard_hits(codes, p)]
                codes, held = [], 0
        out += [not len(spans) for spans, _ in shard_hits(codes, p)]
        return pa.array(out, pa.bool_())

    return clean
