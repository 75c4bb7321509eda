"""Operator 7: exact Jaccard join of word-shingle sets over count vectors in R-trees.

1. Every text becomes a set of 64-bit shingle hashes; equal sets are one *set class*.
2. Shingles are hashed into groups. Two sets whose Jaccard similarity reaches num/den differ in at
   most d = (|A|+|B|)(den-num)/(den+num) shingles, so with more than d groups some are equal in both.
   A window of set sizes fixes the number of groups, and the hash of a group's content is the key that
   brings possible partners together (see Bands and keys_of_sets). Nothing is cut: no link can be missed.
   Shingles that many texts share make no key on their own, or a few lines would chain most texts to one
   family; which these are is learnt from one set in SHOWN and chooses among keys, never among sets.
   A task joins the sets of one key among its own rows first, so a key that very many sets share leaves
   a task once. Keys travel packed by bucket (their first bits, so many buckets that one fits a task).
3. Classes joined by keys of one window form families. In a family the counts of shingles by group are
   points of a packed R-tree; the number of groups grows with the set. For a query set the sum of coordinate minima with a node's upper corner
   bounds the overlap with all below. Count vectors alone leave the classes with a partner that the bound
   lets through; only the texts of those travel, and surviving pairs are verified exactly.
4. A family beyond one block of bounded size is split into blocks. Each block is a cell of its own; then
   one set of each part that a block's links made meets those of the other blocks; only what is still
   apart is compared block by block, sets of one part being passed over. A large group of near copies
   thus sends each of its texts once, and no pair of sets is left out.
5. Connected components of the links give the classes' component, and documents take it from there.

Nulls, empty and blank texts have the empty set and link with nothing. A text with fewer words than
the shingle width is one shingle of its whole sequence. Very long texts are read as a whole. Rows with
equal doc_id are rows of their own, whatever their texts, and so are repeated rows; a null doc_id never
is the smallest id of a component that has others. An empty table gives an empty one. Columns other than
id and text are left aside, one_of_each() keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Forest, bounded_batches, connected_components, fresh, gives_back, mix64, sorted_groups, written

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Coordinates of a count vector at least, and shingles for each at most: the bound of a long set would say
#: nothing otherwise. Runs of FOLD coordinates are summed for the upper levels of the tree.
COORDINATES, SHARE, FOLD = 256, 8, 8
LEAF, FANOUT = 32, 16
#: A cell holds two blocks at most; bounds on a block's texts and shingles.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20
#: A block of count vectors alone may be larger: so many of COORDINATES, fewer of longer ones.
BLOCK_COUNTS = 8192
#: Families of more blocks than one are sent to the tasks up to this number (16 bytes each), else joined.
LARGE_FAMILIES = 100_000
#: Keys that a task holds before it sends what it has joined, and keys of a bucket on average. Keys and nodes travel
#: as so many bytes; a key has the bits of its bucket besides. Names that clash make a family larger, no more.
TASK_KEYS, BUCKET_KEYS, PACKED_BYTES = 1 << 20, 1 << 19, 6
#: More groups than needed, as a share of the shingles that may differ; the largest share of weak groups.
SLACK, WEAK_SHARE = 0.15, 0.1
#: The filter of ids whose texts go to their families: 8 MB at most.
FILTER_BITS, FILTER_HASHES = 1 << 26, 3
#: About so many bytes of text become sets at once. Words of more bytes than LONG_WORD are hashed one by one.
SHINGLE_BYTES, LONG_WORD = 1 << 18, 64
_LOWER, _BLANK = np.frombuffer(LOWER, np.uint8), np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True
#: One of so many sets, chosen by its hash, shows its shingles, if these are no more than SHOWN_MOST. A shingle that
#: COMMON of them hold is common; with more than MOST_COMMON of those, COMMON rises. Common ones are a table of bits.
SHOWN, SHOWN_MOST, COMMON, MOST_COMMON, COMMON_BITS = 64, 1 << 16, 2, 1 << 20, 24
#: Cells of so many numbers (sets by sets by coordinates) are compared at once, without a tree. Rows of links sent at once.
SMALL_CELL, LINK_ROWS = 1 << 20, 1 << 16
#: The first 0 to 8 bytes of eight.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Shingler:
    """Texts to sorted sets of distinct shingle hashes, by arrays of bytes."""

    def __init__(self, width: int):
        self.width = width
        self.lengths = np.arange(width + 1, dtype=np.uint64) * GOLDEN
        self.factors = mix64(self.lengths[1:]) | np.uint64(1)

    def __call__(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The sets of texts end to end, and their bounds. A null text has the empty set."""
        h, words = word_hashes(texts)
        lows, found = words[:-1], np.diff(words)
        out, whole = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
        n = len(h) - self.width + 1
        if n > 0:
            out[:n] = self.lengths[self.width]
            for j in range(self.width):
                out[:n] += h[j : j + n] * self.factors[j]
            whole[:n] = np.arange(self.width, len(h) + 1) <= np.repeat(words[1:], found)[:n]
        for width in range(1, self.width):  # fewer words: one shingle of them all
            at = lows[found == width]
            out[at] = self.lengths[width]
            for j in range(width):
                out[at] += h[at + j] * self.factors[j]
            whole[at] = True
        flat = mix64(out[whole])
        bounds = np.r_[0, np.cumsum(whole)][words]
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            flat[lo:hi].sort()
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        new[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        return flat[new], np.r_[0, np.cumsum(new)][bounds]

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The sets of texts as (number of the first, sets, bounds), some SHINGLE_BYTES of text at once."""
        texts = texts.cast(pa.large_string())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(texts):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + SHINGLE_BYTES, "right")))
            yield lo, *self(texts.slice(lo, hi - lo))
            lo = hi


def word_hashes(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts (see plain_words) end to end, and the bounds of each text's words.

    A word is hashed by eight bytes at once, those of all texts side by side; one beyond LONG_WORD on its own.
    """
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    n = int(bounds[-1] - bounds[0])
    data = np.zeros(n + 8, np.uint8)
    if n:
        data[:n] = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    cut, blank = np.zeros(n + 1, bool), _BLANK[data[:n]]
    cut[bounds] = True
    cut[1:] |= blank
    starts = np.flatnonzero(~blank & cut[:n])
    cut[:n] |= blank
    ends = np.flatnonzero(~blank & cut[1:]) + 1
    length = ends - starts
    eights = np.ndarray(n + 1, "<u8", data, strides=(1,))
    h = mix64(eights[starts] & _FIRST_BYTES[np.minimum(length, 8)] ^ length.astype(np.uint64) * GOLDEN)
    at, done = np.flatnonzero((length > 8) & (length <= LONG_WORD)), 8
    while len(at):
        h[at] = mix64(h[at] ^ eights[starts[at] + done] & _FIRST_BYTES[np.minimum(length[at] - done, 8)])
        done += 8
        at = at[length[at] > done]
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return h, np.searchsorted(starts, bounds)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between bounds, modulo 2**64."""
    return np.diff(np.r_[np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)][bounds])


def set_hashes(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set (as a signed long)."""
    return (segment_sums(mix64(sets ^ GOLDEN), bounds) + np.diff(bounds).astype(np.uint64) * GOLDEN).view(np.int64)


def places(lows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each low the numbers low, low + 1, ..., as many as its count, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lows - ends + counts, counts)


class Bands:
    """Bands of set sizes, a band's sizes within one similarity ratio, and the groups of each band.

    Window b compares sets of band b with each other and with those of the next band that are near
    enough in size (guests). Two linked sets of a window differ in at most `differ` shingles, so of
    `groups` groups at least groups - differ are equal in both. Groups of at most `weak` shingles are
    weak: unrelated sets may share them by a common line, or by being empty.
    """

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        lows = [1]
        while lows[-1] < largest:
            lows.append(max(lows[-1] + 1, -(-lows[-1] * den // num)))
        self.lows = np.array(lows[:-1])
        ups = [x - 1 for x in lows[1:]]
        guests = [up * den // num for up in ups]
        differ = [(up + g) * (den - num) // (den + num) for up, g in zip(ups, guests)]
        groups = [d + 1 + max(1, round(SLACK * d)) for d in differ]
        weak = [self._weak(lo / g) for lo, g in zip(lows, groups)]
        self.guests, self.differ, self.groups, self.weak = map(np.array, (guests, differ, groups, weak))
        self._names: dict[int, np.ndarray] = {}

    @staticmethod
    def _weak(mean: float) -> int:
        """The largest group size that at most WEAK_SHARE of the groups stay below or at (Poisson), 0 at least."""
        size, term = -1, float(np.exp(-mean))
        total = term
        while total <= WEAK_SHARE:
            size += 1
            term *= mean / (size + 1)
            total += term
        return max(0, size)

    def of(self, n: int) -> list[int]:
        """The windows of a set of n shingles; none where only equal sets can link."""
        return self.windows(np.array([n]))[1].tolist()

    def windows(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the set, window) of sets of these sizes, in order of the sets."""
        own = np.searchsorted(self.lows, sizes, "right") - 1
        both = np.column_stack([own, own - 1])
        fits = (both >= 0) & (self.differ[both] > 0)
        fits[:, 1] &= sizes <= self.guests[own - 1]
        sets, which = np.nonzero(fits)
        return sets, both[sets, which]

    def names(self, b: int) -> np.ndarray:
        """A name for each group of window b."""
        if b not in self._names:
            self._names[b] = mix64((np.arange(self.groups[b], dtype=np.uint64) + np.uint64(b << 44)) * GOLDEN)
        return self._names[b]


def node_names(h: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Set classes, each in one of its windows, as longs of PACKED_BYTES."""
    w = windows.astype(np.uint64) + np.uint64(1)
    return (mix64(h.view(np.uint64) ^ (w * GOLDEN)) >> np.uint64(64 - 8 * PACKED_BYTES)).astype(np.int64)


def group_keys(s: np.ndarray, bands: Bands, b: int) -> np.ndarray:
    """The keys of one set in window b (see keys_of_sets)."""
    return keys_of_sets(s, np.array([0, len(s)]), bands, np.zeros(1, np.int64), np.array([b]))[1]


def keys_of_sets(
    flat: np.ndarray, bounds: np.ndarray, bands: Bands, sets: np.ndarray, windows: np.ndarray, common: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(place in `sets`, key): the keys of sets in windows. Two linked sets of a window have one in common for certain.

    Of `groups` groups `certain` ones at least are equal in both. If one of them is strong, its content is
    the common key. If all are weak, both sets have `certain` weak groups or more: those are dealt to
    certain - 1 bins by place, two equal ones fall into one bin, and every pair of a bin is a key. So no
    weak group is a key on its own. Sets that differ by one shingle at most need no groups: the whole set
    and the set without each of its shingles are the keys. Common shingles don't count for a group's strength, so
    a line that many texts share makes a strong group with other shingles alone.
    """
    names, sizes = mix64(flat ^ GOLDEN), np.diff(bounds)
    near = bands.differ[windows] == 1
    owners, keys = [], []
    at = np.flatnonzero(near)
    if len(at):
        whole = segment_sums(names, bounds)[sets[at]]
        place = np.array([bands.names(b)[0] for b in windows[at].tolist()], np.uint64)
        n = sizes[sets[at]]
        but_one = np.repeat(whole, n) - names[places(bounds[sets[at]], n)]
        owners += [np.repeat(at, n), at]
        keys += [mix64(but_one ^ np.repeat(place, n)), mix64(whole ^ place)]
    at = np.flatnonzero(~near)
    if len(at):
        n, g = sizes[sets[at]], bands.groups[windows[at]]
        base = np.cumsum(g) - g
        taken = places(bounds[sets[at]], n)
        group = (((flat[taken] >> np.uint64(32)) * np.repeat(g.astype(np.uint64), n)) >> np.uint64(32)).astype(np.int64) + np.repeat(base, n)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        content = np.zeros(int(g.sum()), np.uint64)
        content[group[first]] = np.add.reduceat(names[taken], first)
        content = mix64(content ^ np.concatenate([bands.names(b) for b in windows[at].tolist()]))
        told = group if common is None else group[~common[taken]]
        weak = np.bincount(told, minlength=len(content)) <= np.repeat(bands.weak[windows[at]], g)
        strong = np.flatnonzero(~weak)
        owner = np.repeat(np.arange(len(at)), g)
        owners.append(at[owner[strong]])
        keys.append(content[strong])
        certain = g - bands.differ[windows[at]]
        many = np.add.reduceat(weak, base, dtype=np.int64) >= certain
        if many.any():
            weak = np.flatnonzero(weak & np.repeat(many, g))
            bin_ = (weak - base[owner[weak]]) % (certain[owner[weak]] - 1) + base[owner[weak]]  # fewer bins than groups
            weak = weak[np.argsort(bin_, kind="stable")]
            bin_.sort()
            last = np.searchsorted(bin_, bin_, "right")
            others = last - np.arange(len(weak)) - 1
            i, j = np.repeat(weak, others), weak[places(np.arange(1, len(weak) + 1), others)]
            owners.append(at[owner[i]])
            keys.append(mix64(content[i] * GOLDEN + content[j]))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(keys).view(np.int64)


def common_shingles(shown: DataFrame) -> np.ndarray | None:
    """A table of bits by the first COMMON_BITS bits of a shingle, set where many of the sets (h, shown) hold one; None if there is none.

    It chooses among ways to make keys: whatever it holds, linked sets have a key in common.
    """
    one = shown.where("shown is not null").groupBy("h").agg(F.first("shown").alias("shown"))
    held = one.select(F.explode("shown").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    held = written(held, "common")
    counts = held.groupBy(F.least("n", F.lit(255)).alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("n")).collect()
    if not counts:
        return None
    least, rows = counts[0]["n"], 0
    for r in counts:
        rows += r["rows"]
        if rows <= MOST_COMMON:
            least = r["n"]
    bits = (
        held.where(F.col("n") >= least)
        .select(F.shiftrightunsigned("s", 64 - COMMON_BITS).alias("place"))
        .groupBy(F.shiftright("place", 3).alias("byte"))
        .agg(F.bit_or(F.expr("shiftleft(1, cast(place % 8 as int))")).alias("bits"))
        .toArrow()
    )
    table = np.zeros(1 << (COMMON_BITS - 3), np.uint8)
    table[bits["byte"].to_numpy()] = bits["bits"].to_numpy()
    return table


def is_common(shingles: np.ndarray, table: np.ndarray) -> np.ndarray:
    place = shingles >> np.uint64(64 - COMMON_BITS)
    return (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def stars_of_keys(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, in order, its smallest node, and an edge (node, smallest node) for every other node of it."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    least = np.minimum.reduceat(nodes, first) if len(first) else nodes
    centre = np.repeat(least, np.diff(np.r_[first, len(keys)]))
    apart = nodes != centre
    return keys[first], least, once(nodes[apart], centre[apart])


def once(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The different pairs (a, b), in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.column_stack([a[new], b[new]])


def packed(values: np.ndarray) -> np.ndarray:
    """The last PACKED_BYTES bytes of each 64-bit value, a row of bytes for each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PACKED_BYTES]


def unpacked(rows: np.ndarray) -> np.ndarray:
    """The values whose last bytes are the rows."""
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :PACKED_BYTES] = rows
    return out.view("<u8").ravel()


def joined_in_task(keys: np.ndarray, nodes: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows (bucket, names, edges): keys with their smallest nodes by bucket, and what the task has joined.

    A bucket is the first `bits` bits of a key. Names are the last bytes of key and node in turn; edges are
    pairs of nodes, under the bucket that the centre's bits give.
    """
    keys, nodes, edges = stars_of_keys(keys.view(np.uint64), nodes)
    names = np.hstack([packed(keys), packed(nodes)])
    by_centre = edges[np.argsort(edges[:, 1], kind="stable")]
    columns, shift = [[], [], []], np.uint64(64 - bits)
    for at, (where, rows) in enumerate([(keys >> shift, names), (by_centre[:, 1] >> (8 * PACKED_BYTES - bits), by_centre.astype("<i8"))]):
        cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(where) else np.zeros(0, np.int64)
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(where)]):
            columns[0].append(int(where[lo]))
            columns[1 + at].append(rows[lo:hi].tobytes())
            columns[2 - at].append(b"")
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["bucket", "names", "edges"])


def together(links: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
    """Links as rows (a, b), LINK_ROWS or more at once and each once among these."""
    held, rows = [], 0
    for pairs in links:
        held.append(pairs)
        rows += len(pairs)
        if rows >= LINK_ROWS:
            yield pd.DataFrame(once(*np.concatenate(held).T), columns=["a", "b"])
            held, rows = [], 0
    if rows:
        yield pd.DataFrame(once(*np.concatenate(held).T), columns=["a", "b"])


def joined_in_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (a, b) of the nodes that share a key, from the rows of joined_in_task sorted by bucket."""
    return together(_of_buckets(batches))


def _of_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    for bucket in sorted_groups(batches, ["bucket"]):
        names = np.frombuffer(b"".join(bucket["names"]), np.uint8).reshape(-1, 2 * PACKED_BYTES)
        known = np.frombuffer(b"".join(bucket["edges"]), "<i8").reshape(-1, 2)
        edges = stars_of_keys(unpacked(names[:, :PACKED_BYTES]), unpacked(names[:, PACKED_BYTES:]).astype(np.int64))[2] if len(names) else known
        yield np.concatenate([known, edges])


def coordinates(n: int) -> int:
    """Coordinates of the count vector of a set of n shingles, a power of two; less than n / 4 beyond COORDINATES."""
    return max(COORDINATES, 1 << max(0, -(-n // SHARE) - 1).bit_length())


def count_vector(s: np.ndarray, width: int) -> np.ndarray:
    """Shingles of a set by group (coordinate); width is a power of two."""
    return np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width).astype("<u4")


def of_one_width(vectors: list[bytes]) -> np.ndarray:
    """Count vectors as one matrix, longer ones folded to the shortest."""
    width = min(map(len, vectors)) // 4
    return np.array([np.frombuffer(v, "<u4").reshape(-1, width).sum(axis=0, dtype="<u4") for v in vectors])


class CountTree:
    """Packed R-tree over count vectors: an array of upper corners and least sizes for each level.

    Inner levels and a first look at the points use the folded vectors, survivors the full ones.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        folded = counts.reshape(len(counts), -1, FOLD).sum(axis=2, dtype=np.int64)
        widest = int(folded.var(axis=0).argmax())
        slab = np.argsort(sizes, kind="stable")
        tile = np.empty(len(sizes), np.int64)
        tile[slab] = np.arange(len(sizes)) // (LEAF * FANOUT)
        self.order = np.lexsort((folded[:, widest], tile))
        self.counts, self.folded = counts, folded
        tops, low, step = folded[self.order], sizes[self.order], LEAF
        self.points, self.point_sizes, self.levels = tops, low, []
        while len(tops) > 1:
            at = np.arange(0, len(tops), step)
            tops, low = np.maximum.reduceat(tops, at), np.minimum.reduceat(low, at)
            self.levels.append((tops, low, step))
            step = FANOUT

    def search(self, q: int, size: int, num: int, den: int, wanted: np.ndarray) -> np.ndarray:
        """Numbers of the wanted points whose overlap with point q may reach the similarity."""
        least, own = -(-num * size // den), self.folded[q]
        nodes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, low, step = self.levels[depth]
            nodes = nodes[self._may(own, size, tops[nodes], np.maximum(low[nodes], least), num, den)]
            below = len(self.levels[depth - 1][0]) if depth else len(self.points)
            nodes = (nodes[:, None] * step + np.arange(step)).ravel()
            nodes = nodes[nodes < below]
        s = self.point_sizes[nodes]
        keep = (s >= least) & (s * num <= size * den) & wanted[self.order[nodes]]
        nodes, s = nodes[keep], s[keep]
        keep = self._may(own, size, self.points[nodes], s, num, den)
        found, s = self.order[nodes[keep]], s[keep]
        return found[self._may(self.counts[q], size, self.counts[found], s, num, den)]

    @staticmethod
    def _may(q, size, tops, sizes, num, den, axis=1):
        return np.minimum(q, tops).sum(axis=axis, dtype=np.int64) * (num + den) >= num * (size + sizes)


class CountPairs:
    """What CountTree finds, for few points: the bound of all pairs at once."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, num: int, den: int):
        self.may = CountTree._may(counts[:, None], sizes[:, None], counts[None], sizes, num, den, 2)

    def search(self, q: int, size: int, num: int, den: int, wanted: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.may[q] & wanted)


def cell_links(
    sizes: np.ndarray, counts: np.ndarray, sides: np.ndarray | None, num: int, den: int, sets: list | None = None, parts: np.ndarray | None = None
) -> np.ndarray:
    """A spanning star of each part that a cell's links make, as pairs of set numbers.

    With sets, links are verified; without, pairs that the bound lets through count as links.
    sides: for a cell of two blocks, the block of each set; only pairs across are compared.
    parts: what is known to hang together; sets of one part are not compared.
    """
    forest, n = Forest(len(sizes)), len(sizes)
    tree = CountPairs(counts, sizes, num, den) if n * counts.size <= SMALL_CELL else CountTree(counts, sizes)
    if parts is not None:
        forest.root = np.unique(parts, return_index=True)[1][np.unique(parts, return_inverse=True)[1]]
    if sets is not None:
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        starts = np.r_[0, np.cumsum(sizes)]
        flags = np.zeros(int(codes.max()) + 1, bool)
    for q in range(n):
        wanted = forest.root != forest.root[q]
        wanted &= np.arange(n) > q if sides is None else sides > sides[q]
        if not wanted.any():
            continue
        linked = found = tree.search(q, int(sizes[q]), num, den, wanted)
        if sets is not None and len(found):
            own = codes[starts[q] : starts[q + 1]]
            flags[own] = True
            if sizes[found].sum() * 4 > starts[-1]:
                overlap = np.add.reduceat(flags[codes].astype(np.int64), starts[:-1])[found]
            else:
                overlap = np.array([np.count_nonzero(flags[codes[starts[p] : starts[p + 1]]]) for p in found])
            flags[own] = False
            linked = found[den * overlap >= num * (sizes[q] + sizes[found] - overlap)]
        if len(linked):
            forest.join(q, linked)
    return forest.tree()


def possibly_among(keys: DataFrame, most_bits: int = FILTER_BITS, key: str = "row"):
    """A test of the row keys in column `key` (as a UDF) that holds for all of `keys` (row) and few others.

    A Bloom filter of bounded size.

    It spares rows that nobody asks for the way to a join. With more keys than the bits can hold apart it
    lets more through; the join that follows decides.
    """
    n = keys.count()
    bits = min(most_bits, max(1 << 10, 1 << (12 * n).bit_length()))
    at = F.explode(F.array(*[F.pmod(F.xxhash64("row", F.lit(k)), F.lit(bits)) for k in range(FILTER_HASHES)]))
    words = (
        keys.select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
        .toArrow()
    )
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def known(*places: pd.Series) -> pd.Series:
        out = np.ones(len(places[0]), bool)
        for p in places:
            p = p.to_numpy()
            out &= (shared.value[p >> 6] >> (p & 63)) & 1 == 1
        return pd.Series(out)

    return known(*[F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) for k in range(FILTER_HASHES)])


def row_key(id_col: str, text_col: str):
    """A 64-bit name of a row by its id and whole text; rows that agree in both share it."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def _blocked(members: DataFrame, blocks) -> DataFrame:
    """members (family, h, ...) with the number of blocks of their family, and their block."""
    large = written(members.groupBy("family").agg(blocks.cast("int").alias("blocks")).where("blocks > 1"), "large")
    few = large.count() <= LARGE_FAMILIES
    known = members.join(F.broadcast(large) if few else large, "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return known.withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))


def _pairs_of_blocks(members: DataFrame, inside: bool) -> DataFrame:
    """members with lo and hi: a cell for every two blocks of a family, and with `inside` for each block."""
    rows = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows if inside else rows.where("block <> other")
    return rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other")


def _parts(members: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """members with the part that they belong to by the links so far."""
    found = connected_components(links, tag).select(F.col("node").alias("h"), F.col("root").alias("part"))
    return members.drop("part").join(found, "h", "left").withColumn("part", F.coalesce("part", "h"))


def _apart(members: DataFrame) -> DataFrame:
    """The members of families that are of more parts than one."""
    split = members.groupBy("family").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("family")
    return members.join(split, "family")


def _classes(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """sets: doc_id, row, n, h of every row; and linked: h, root of every set class that has a link."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row"))

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, bands = Shingler(width), Bands(num, den)
        for batch in batches:
            for lo, flat, bounds in shingle.batches(batch["text"]):
                n, h = np.diff(bounds), set_hashes(flat, bounds)
                owners, windows = bands.windows(n)
                at = np.searchsorted(owners, np.arange(len(n) + 1))
                nodes = pa.ListArray.from_arrays(at.astype(np.int32), node_names(h[owners], windows))
                counts = [count_vector(flat[i:j], coordinates(j - i)).tobytes() if known else None for i, j, known in zip(bounds.tolist(), bounds[1:].tolist(), np.diff(at).tolist())]
                chosen = (mix64(h.view(np.uint64)) % np.uint64(SHOWN) == 0) & (n > 0) & (n <= SHOWN_MOST)
                shown = [flat[bounds[i] : bounds[i + 1]].view(np.int64) if c else None for i, c in enumerate(chosen.tolist())]
                columns = [pa.array(n, pa.int64()), pa.array(h, pa.int64()), nodes, pa.array(counts, pa.binary()), pa.array(shown, pa.list_(pa.int64()))]
                rows = batch.slice(lo, len(n))
                yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["row"], *columns], ["doc_id", "row", "n", "h", "nodes", "counts", "shown"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, bands, seen = Shingler(width), Bands(num, den), set()
        ks, nodes, held = [], [], 0
        for batch in batches:
            for _, flat, bounds in shingle.batches(batch["text"]):
                h = set_hashes(flat, bounds)
                new = np.zeros(len(h), bool)
                for i, name in enumerate(h.tolist()):
                    new[i] = name not in seen
                    if len(seen) < 200_000:  # saves rows only: a class that comes twice does no harm
                        seen.add(name)
                owners, windows = bands.windows(np.where(new, np.diff(bounds), 0))
                common = is_common(flat, shared.value) if shared else None
                of, found = keys_of_sets(flat, bounds, bands, owners, windows, common)
                ks.append(found)
                nodes.append(node_names(h[owners], windows)[of])
                held += len(found)
                if held >= TASK_KEYS:
                    yield joined_in_task(np.concatenate(ks), np.concatenate(nodes), bits)
                    ks, nodes, held = [], [], 0
        if held:
            yield joined_in_task(np.concatenate(ks), np.concatenate(nodes), bits)

    sets = written(texts.mapInArrow(gives_back(classes), "doc_id long, row long, n long, h long, nodes array<long>, counts binary, shown array<long>"), "sets")
    common = common_shingles(sets.select("h", "shown"))
    shared = None if common is None else docs.sparkSession.sparkContext.broadcast(common)
    # a set has about so many groups in each window; buckets by the first bits of a key, as many as hold them
    shown = sets.agg(F.sum(F.size("nodes") * F.col("n"))).first()[0] or 0
    bits = max(1, (shown * 2 * (den - num) // den // BUCKET_KEYS).bit_length())
    stars = (
        texts.select("text")
        .mapInArrow(gives_back(keys), "bucket long, names binary, edges binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInPandas(gives_back(joined_in_buckets), "a long, b long")
    )
    # what each class may meet: families of nodes; only narrow rows until it is known who has one
    families = connected_components(stars, "families").select("node", F.col("root").alias("family"))
    narrow = sets.where(F.size("nodes") > 0).groupBy("h").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("nodes").alias("nodes"))
    members = narrow.withColumn("node", F.explode("nodes")).join(families, "node").select("family", "h", "row", "n")
    widest = F.greatest(F.lit(COORDINATES), F.col("n") / (SHARE // 2))
    members = written(_blocked(members, F.ceil(F.sum(widest) / (BLOCK_COUNTS * COORDINATES))), "members")

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for cell in sorted_groups(batches, ["family", "lo", "hi"]):
            if len(cell) < 2:
                continue
            counts = of_one_width(cell["counts"].tolist())
            across = cell["lo"].iloc[0] != cell["hi"].iloc[0]
            yield cell["h"].to_numpy()[cell_links(cell["n"].to_numpy(), counts, cell["block"].to_numpy() if across else None, num, den)]

    # the bound decides which classes stay; the counts of those with a family alone travel
    counts = sets.select("row", "h", "counts").where(possibly_among(members)).groupBy("row", "h").agg(F.first("counts").alias("counts"))
    survivors = (
        _pairs_of_blocks(members.join(counts, ["row", "h"]), inside=True)
        .repartition("family", "lo", "hi")
        .sortWithinPartitions("family", "lo", "hi", "h")
        .select("family", "lo", "hi", "block", "h", "n", "counts")
        .mapInPandas(gives_back(lambda batches: together(bounded(batches))), "a long, b long")
    )
    groups = connected_components(survivors, "bounded").select(F.col("node").alias("h"), F.col("root").alias("family"))
    kept = members.groupBy("h").agg(F.min(F.struct("row", "n")).alias("m")).join(groups, "h").select("family", "h", "m.row", "m.n")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    kept = written(_blocked(written(kept, "groups"), blocks), "survivors")

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        shingle = Shingler(width)
        for cell in sorted_groups(batches, ["family", "lo", "hi"]):
            sets, own = [], []
            for _, flat, bounds in shingle.batches(pa.array(cell["text"], pa.large_string())):
                sets += np.split(flat, bounds[1:-1])
                own.append(set_hashes(flat, bounds))
            names = cell["h"].to_numpy()
            # rows of one key have one id and text, but for clashing hashes: the set decides, then each class counts once
            right = (np.concatenate(own) == names) & np.array([len(s) > 0 for s in sets])
            right[right] = ~pd.Series(names[right]).duplicated().to_numpy()
            sets, names = [s for s, r in zip(sets, right) if r], names[right]
            if len(sets) < 2:
                continue
            across = cell["lo"].iloc[0] != cell["hi"].iloc[0]
            sizes = np.array([len(s) for s in sets])
            shared = coordinates(int(sizes.mean()))
            counts = np.array([count_vector(s, shared) for s in sets])
            yield names[cell_links(sizes, counts, cell["block"].to_numpy()[right] if across else None, num, den, sets, cell["part"].to_numpy()[right])]

    def linked(cells: DataFrame, rows: DataFrame, tag: str) -> DataFrame:
        """Verified links within cells (family, lo, hi, block, part, h, row) of rows."""
        found = (
            cells.join(texts.where(possibly_among(rows)).select("row", "text"), "row")
            .repartition("family", "lo", "hi")
            .sortWithinPartitions("family", "lo", "hi", "h")
            .select("family", "lo", "hi", "block", "part", "h", "text")
            .mapInPandas(gives_back(lambda batches: together(links(batches))), "a long, b long")
        )
        return written(found, tag)

    def alone(rows: DataFrame) -> DataFrame:
        return rows.withColumn("lo", F.col("block")).withColumn("hi", F.col("block"))

    found = linked(alone(kept.withColumn("part", F.col("h"))), kept, "inside")
    split = kept.where("blocks > 1")
    if not split.isEmpty():
        # one of each part of a block meets those of the other blocks, then what is still apart meets block by block
        one = F.min(F.struct("h", "row", "n")).alias("m")
        heads = _apart(_parts(split, found, "inside")).groupBy("family", "block", "part").agg(one).select("family", "part", "m.*")
        heads = written(_blocked(written(heads, "heads"), blocks), "heads")
        found = written(found.union(linked(alone(heads), heads, "heads")), "found")
        rest = written(_apart(_parts(split, found, "heads")), "rest")
        found = found.union(linked(_pairs_of_blocks(rest, inside=False), rest, "across"))
    return sets.select("doc_id", "row", "n", "h"), connected_components(found, "links").select(F.col("node").alias("h"), "root")


def _components(sets: DataFrame, linked: DataFrame) -> DataFrame:
    """h, least (smallest doc_id) and head (the row that stands for it) of the component of every class.

    Rows come together by class first, classes by component then: no row of a document is shuffled by component.
    """
    least = [F.min("least").alias("least"), F.min("head").alias("head")]
    own = sets.where("n > 0").groupBy("h").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "row")).alias("head"))
    rooted = linked.join(own, "h")
    joined = rooted.select("h", "root").join(rooted.groupBy("root").agg(*least), "root").select("h", "least", "head")
    return own.join(linked, "h", "left_anti").unionByName(joined)


def jaccard_components(
    docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    sets, linked = _classes(docs, width, num, den, id_col, text_col)
    return sets.join(_components(sets, linked).select("h", "least"), "h", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component: the one of smallest id (null first).

    Rows without words link with nothing and all stay. Of rows that agree in id and text one stays, that
    of the smallest hash over all columns. Only rows that may go are shuffled (see possibly_among).
    """
    sets, linked = _classes(docs, width, num, den, id_col, text_col)
    heads = _components(sets, linked).select("h", F.col("head.row").alias("head"))
    # rows that may go: not the head of their component, or one of several rows of one key. All others pass as they are.
    counted = sets.where("n > 0").groupBy("h", "row").agg(F.count("*").alias("rows"))
    named = counted.join(heads, "h").select("row", "rows", (F.col("row") == F.col("head")).alias("stays"))
    doubtful = written(named.where("not stays or rows > 1").groupBy("row").agg(F.max("stays").alias("stays")), "doubtful")
    key, stays, number = fresh(docs, "row"), fresh(docs, "stays"), fresh(docs, "number")
    marked = docs.withColumn(key, row_key(id_col, text_col))
    suspect = possibly_among(doubtful, key=key)
    looked_at = marked.where(suspect).join(doubtful.select(F.col("row").alias(key), F.col("stays").alias(stays)), key, "left")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map" not in f.dataType.simpleString()]
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*hashed)))
    names = [F.col(f"`{c}`") for c in docs.columns]
    chosen = looked_at.withColumn(number, turn).where(F.col(stays).isNull() | (F.col(stays) & (F.col(number) == 1)))
    return marked.where(~suspect).select(*names).unionByName(chosen.select(*names))
