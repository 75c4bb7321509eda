"""Operator 3: token ids as files with Elias-Fano document boundaries.

Documents are range-partitioned and sorted by id (ties by the text's hash), tokenised, and packed into segments.
A segment is one row of a table in shared storage:

    part, seq      its place: files in order of part, segments in order of seq
    first          number of ids before it within its part
    boundaries     Elias-Fano code of the document ends (see EliasFano)
    ids            the ids end to end, unsigned 16-bit, or 32-bit where the vocabulary needs it (width)
    doc_ids        the documents' ids, signed 64-bit, with a mask of nulls

Elias-Fano keeps n ends below u in about n(2 + log2(u/n)) bits; select(i) gives the i-th end without a
table of 64-bit offsets, and every offset that is read back comes from it. Null texts count as empty and
have the end id alone. Very long texts stay whole, in a segment of their own if need be. Repeated rows
stay, each with its own span; null ids come first; an empty table gives no segments and no rows. Columns
other than doc_id and text are left aside, whatever their names.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, gives_back, quiet_threads, scratch

SEGMENT_IDS = 1 << 20
#: About so many bytes of text are parted at once; distinct pieces are looked up once for a batch.
ENCODE_BYTES = 1 << 20
END_ID = 2


class EliasFano:
    """A sorted list of integers: low bits packed, high bits in unary, and the place of every STEP-th one.

    select() answers from these alone: it goes to the sampled one before and counts on from there by
    bytes. Nothing is unpacked, and no list of 64-bit values is kept or rebuilt.
    """

    STEP = 64
    HEAD = struct.Struct("<QQQB")
    #: For a byte and k: the place of its k-th one.
    _IN_BYTE = np.array([[*(b for b in range(8) if x >> b & 1), *[0] * 8][:8] for x in range(256)], np.int64)

    def __init__(self, n: int, low_bits: int, samples: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.samples, self.low, self.high = n, low_bits, samples, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        unary = np.zeros(n + (top >> low_bits) + 1, np.uint8)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary[ones] = 1
        return cls(n, low_bits, ones[:: cls.STEP].astype("<u4"), low, np.packbits(unary, bitorder="little"))

    def select(self, i):
        """The i-th value; for an array of places, the array of their values."""
        at = np.atleast_1d(np.asarray(i, np.int64))
        sampled = self.samples[at // self.STEP].astype(np.int64)
        byte, left = sampled >> 3, at % self.STEP
        word = self.high[byte] & (0xFF << (sampled & 7)).astype(np.uint8)
        ones = np.bitwise_count(word).astype(np.int64)
        while len(walk := np.flatnonzero(ones <= left)):
            left[walk] -= ones[walk]
            byte[walk] += 1
            word[walk] = self.high[byte[walk]]
            ones[walk] = np.bitwise_count(word[walk])
        upper = byte * 8 + self._IN_BYTE[word, left] - at
        value = upper << self.low_bits
        for bit in range(self.low_bits):
            place = at * self.low_bits + bit
            value |= ((self.low[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(np.int64) << bit
        return value if np.ndim(i) else int(value[0])

    def to_bytes(self) -> bytes:
        head = self.HEAD.pack(self.n, len(self.samples), len(self.low), self.low_bits)
        return head + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, n_samples, low_len, low_bits = cls.HEAD.unpack_from(data)
        body = np.frombuffer(data, np.uint8, offset=cls.HEAD.size)
        low = 4 * n_samples
        return cls(n, low_bits, body[:low].view("<u4"), body[low : low + low_len], body[low + low_len :])


#: What a byte of text is to the tokenizer's pattern: a letter, a digit, a mark or white space; ODD is left to the tokenizer.
LETTER, DIGIT, MARK, BLANK, ODD = range(5)
_BLANKS = "\t\n\x0b\x0c\r "
_KIND, _LOW = np.full(256, ODD, np.uint8), np.arange(256, dtype=np.uint8)
_KIND[0x21:0x7F] = MARK
_KIND[0x30:0x3A] = DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = LETTER
_KIND[list(_BLANKS.encode())] = BLANK
_LOW[0x41:0x5B] += 32
#: The same for the byte after 0xC3: \u00c0 to \u00ff without the two signs among them.
_KIND_C3, _LOW_C3 = np.full(256, ODD, np.uint8), np.arange(256, dtype=np.uint8)
_KIND_C3[0x80:0xC0] = LETTER
_KIND_C3[[0x97, 0xB7]] = ODD
_LOW_C3[0x80:0x9F] += 32
#: Pieces for the tokenizer as it is: white space beyond ASCII, other scripts, marks of special tokens.
_ODD_PIECE = re.compile("<\\||[^!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
#: Room behind the last text, so that a look ahead ends in white space.
_AHEAD = 3


def parted(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The lower-cased pieces of texts end to end, white space among them, and the first piece of each text.

    A piece is a run of letters or marks, a digit, or an apostrophe with one of the endings s, t, m, d,
    re, ve, ll: the tokenizer's pattern, fixed value. A word with an odd byte is one piece, as it stands.
    """
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.full(bounds[-1] - bounds[0] + _AHEAD, 32, np.uint8)
    if len(data) > _AHEAD:
        data[:-_AHEAD] = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    opens = np.zeros(len(data), bool)
    opens[0] = opens[bounds[:-1]] = True

    kind, low = _KIND[data], _LOW[data]
    lead = np.flatnonzero(data == 0xC3)
    kind[lead], after = LETTER, data[lead + 1]
    kind[lead + 1], low[lead + 1] = _KIND_C3[after], _LOW_C3[after]
    bar = np.flatnonzero(data == ord("|"))
    kind[bar[(data[bar - 1] == ord("<")) & ~opens[bar]]] = ODD

    cut = opens | (kind == DIGIT)
    cut[1:] |= kind[1:] != kind[:-1]
    quote = np.flatnonzero(low == ord("'"))
    quote = quote[cut[quote] & ~opens[quote + 1]]
    one = quote[np.isin(low[quote + 1], list(b"stmd"))]
    pair = low[quote + 1] * np.int64(256) + low[quote + 2]
    two = quote[np.isin(pair, [a * 256 + b for a, b in (b"re", b"ve", b"ll")]) & ~opens[quote + 2]]
    cut[one + 1] = cut[two + 1] = False
    cut[one + 2] = cut[two + 3] = True

    if (odd := kind == ODD).any():
        edge = opens.copy()
        edge[1:] |= (kind[1:] == BLANK) != (kind[:-1] == BLANK)
        run = np.cumsum(edge)
        whole = np.zeros(run[-1] + 1, bool)
        whole[run[odd]] = True
        whole = whole[run]
        cut = np.where(whole, edge, cut)
        low = np.where(whole, data, low)

    at = np.flatnonzero(cut)
    ends = np.r_[at, len(data)]
    pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(low))
    return pieces, np.searchsorted(at, bounds)


def dealt(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs data[starts[i] : starts[i] + sizes[i]], end to end."""
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class WordTokens:
    """The tokenizer's ids of texts, by columns of pieces.

    The tokenizer parts texts at white space and then into letters, digits and marks before anything
    else, and never looks across, so the ids of a text are those of its pieces in turn. A column of texts
    becomes a dictionary of pieces; pieces met for the first time are encoded in one call and parted again
    at the ids that end a word. Odd pieces are whole words for the tokenizer as it is: those with characters
    beyond Latin-1 letters and printable ASCII, or with the marks of special tokens.
    """

    #: Pieces that are kept; a piece has no more than LONGEST characters, so this bounds the bytes, too.
    PIECES, LONGEST = 300_000, 64

    def __init__(self, vocabulary: str):
        quiet_threads()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        # pieces need no normaliser and no pattern: the same model behind a split at spaces
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        known = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if len(known) <= 1 << 16 else "<u4")
        self.ends_word = np.zeros(max(known.values()) + 1, bool)
        self.ends_word[[i for w, i in known.items() if w.endswith("</w>")]] = True
        self._keep(pa.array([], pa.large_string()), np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _keep(self, pieces: pa.LargeStringArray, ids: np.ndarray, sizes: np.ndarray, uses: np.ndarray) -> None:
        """Know these pieces and no others; their ids lie end to end."""
        self.pieces, self.ids, self.sizes, self.uses = pieces, ids, sizes, uses
        self.starts = np.cumsum(sizes) - sizes

    def _forget(self) -> None:
        """Long pieces go; of too many pieces those stay that were met again, or none where these are many, too."""
        stay = pc.binary_length(self.pieces).to_numpy() <= self.LONGEST
        uses = self.uses
        if len(stay) > self.PIECES:
            stay &= uses > 1
            stay &= np.count_nonzero(stay) <= self.PIECES // 2
            uses = np.zeros_like(uses)
        if not stay.all():
            ids = dealt(self.ids, self.starts[stay], self.sizes[stay])
            self._keep(self.pieces.filter(pa.array(stay)), ids, self.sizes[stay], uses[stay])

    def _whole(self, pieces: list[str]) -> list[np.ndarray]:
        # encode_batch_fast keeps no offsets
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain pieces end to end, and how many each has."""
        if not pieces:
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        ids = np.array(self.bare.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, self.kind)
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        if len(stops) == len(pieces) and stops[-1] == len(ids):
            return ids, np.diff(stops, prepend=0)
        found = self._whole(pieces)
        return np.concatenate(found), np.array([len(i) for i in found])

    def _learn(self, new: pa.LargeStringArray) -> np.ndarray:
        """Their places among the known ones from now on."""
        # to_numpy makes strings several times faster than to_pylist
        names = new.to_numpy(zero_copy_only=False).tolist()
        group = np.array([0 if p[0] in _BLANKS else 2 if _ODD_PIECE.search(p) else 1 for p in names], np.int8)
        turn = np.argsort(group, kind="stable")
        blank, plain, odd = ([names[i] for i in np.flatnonzero(group == g).tolist()] for g in range(3))
        ids, sizes = self._plain(plain)
        whole = self._whole(odd)
        places = np.empty(len(new), np.int64)
        places[turn] = len(self.pieces) + np.arange(len(new))
        self._keep(
            pa.concat_arrays([self.pieces, new.take(pa.array(turn))]),
            np.concatenate([self.ids, ids, *whole]),
            np.r_[self.sizes, np.zeros(len(blank), np.int64), sizes, np.array([len(i) for i in whole], np.int64)],
            np.r_[self.uses, np.zeros(len(new), np.int64)],
        )
        return places

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.fill_null("").cast(pa.large_string())
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(pc.binary_length(texts)) // ENCODE_BYTES)) + 1).tolist(), len(texts)]
        parts = [parted(texts[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
        coded = pa.chunked_array([pieces for pieces, _ in parts]).dictionary_encode()
        distinct = coded.chunk(0).dictionary
        found = pc.index_in(distinct, self.pieces)
        known = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            known[known < 0] = self._learn(distinct.filter(found.is_null()))
        self.uses[known] += 1
        out = []
        for chunk, (_, first) in zip(coded.chunks, parts):
            place = known[chunk.indices.to_numpy()]
            sizes = self.sizes[place]
            data = dealt(self.ids, self.starts[place], sizes)
            stops = np.r_[0, np.cumsum(sizes)][first].tolist()
            out += [data[s:e] for s, e in zip(stops, stops[1:])]
        self._forget()
        return out


@functools.lru_cache(maxsize=1)
def word_tokens(vocabulary: str) -> WordTokens:
    """Kept for the worker's life: its next task finds the pieces of the one before."""
    return WordTokens(vocabulary)


SEGMENT = "part int, seq int, first long, n_ids long, width int, boundaries binary, doc_ids binary, null_ids binary, ids binary"
_NAMES = [c.split()[0] for c in SEGMENT.split(", ")]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def encoded(batches: Iterator[pa.RecordBatch], tokens: WordTokens) -> Iterator[tuple]:
    """(doc_id, ids) of every document in turn."""
    for batch in batches:
        yield from zip(batch["doc_id"].to_pylist(), tokens(batch["text"]))


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode docs (doc_id, text) and write the segments to `path` in ascending order of doc_id."""
    bounded_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(vocabulary)
        end = np.array([end_id], tokens.kind)
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        names, pieces, ends, held = [], [], [], 0

        def segment():
            row = [
                part,
                seq,
                first,
                held,
                tokens.kind.itemsize,
                EliasFano.of(np.array(ends)).to_bytes(),
                np.array([n or 0 for n in names], "<i8").tobytes(),
                np.packbits([n is None for n in names]).tobytes(),
                np.concatenate(pieces).tobytes(),
            ]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS)], _NAMES)

        for name, ids in encoded(batches, tokens):
            n = len(ids) + 1
            if names and held + n > segment_ids:
                yield segment()
                seq, first = seq + 1, first + held
                names, pieces, ends, held = [], [], [], 0
            held += n
            names.append(name)
            pieces += [ids, end]
            ends.append(held)
        if names:
            yield segment()

    # ties of one id are parted by the text's hash, so that an id which repeats is not one task
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
        .mapInArrow(gives_back(pack), SEGMENT)
        .write.parquet(path)
    )


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    # one row for each part, not each segment or document
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                boundaries = EliasFano.from_bytes(r["boundaries"])
                ends = boundaries.select(np.arange(boundaries.n))
                starts = np.r_[0, boundaries.select(np.arange(boundaries.n - 1))]
                ids = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")
                crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, ends)]
                null = np.unpackbits(np.frombuffer(r["null_ids"], np.uint8), count=len(ends)).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=null),
                        pa.array([r["part"]] * len(ends), pa.int32()),
                        pa.array(starts + r["first"]),
                        pa.array(ends - starts),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "part", "start", "n_tokens", "ids_crc32"],
                )

    read = segments.mapInArrow(gives_back(unpack), "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    return read.join(parts, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the files and read them back."""
    path = scratch(docs.sparkSession, "tokens")
    write_token_files(docs, vocabulary, path)
    return read_token_files(docs.sparkSession, path)
