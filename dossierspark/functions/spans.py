"""Text functions that built-ins can't express, as Arrow UDFs around small helpers.

Offsets are code points of the raw text, end exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..settings import DEFAULTS

# Characters that are written as another after NFKC, and those that are dropped.
AS_QUOTE, AS_DOUBLE, AS_DASH = "‘’‚‛′", "“”„‟″«»", "‐‑‒–—―−"
DROPPED = "­​‌‍﻿"
_MAP = {**{c: "'" for c in AS_QUOTE}, **{c: '"' for c in AS_DOUBLE}, **{c: "-" for c in AS_DASH}, **{c: "" for c in DROPPED}}
_SPLIT_WORD = re.compile(r"(?<=[^\W\d_])-(?=\s*[\n\r\x0b\x0c\x85  ])\s+(?=[^\W\d_])")


def folded(text: str) -> tuple[str, np.ndarray]:
    """The normal form of a text, and for each of its characters the place it came from.

    Compatibility forms, quotes, dashes and spaces are made plain, words parted by a hyphen and a line
    end are joined, white space collapses to one space (placed at the run's start), letters are lowered.
    """
    if text.isascii():
        return _folded_ascii(text)
    chars = text.translate(_PLAIN)
    if all(len(c.lower()) == 1 for c in set(chars)):
        return _folded_even(text, chars)
    parts = [_PLAIN[ord(ch)] for ch in text]
    chars, origin = "".join(parts), np.repeat(np.arange(len(text)), [len(p) for p in parts])
    keep, lead = np.ones(len(chars), bool), None
    for m in _SPLIT_WORD.finditer(chars):
        keep[m.start() : m.end()] = False
    chars, origin = "".join(c for c, k in zip(chars, keep) if k), origin[keep]
    out, at = [], []
    for m in re.finditer(r"\S+", chars):
        if out:
            out.append(" ")
            at.append(origin[lead : lead + 1])
        word = [c.lower() for c in m.group()]
        out += word
        at.append(np.repeat(origin[m.start() : m.end()], [len(w) for w in word]))
        lead = m.end()
    return "".join(out), np.concatenate(at) if at else np.zeros(0, np.int64)


# ASCII characters that are white space, and what each becomes.
_SPACE = np.array([chr(c).isspace() for c in range(128)])
_FOLDED = np.array([32 if _SPACE[c] else ord(chr(c).lower()) for c in range(128)], np.uint8)


def _folded_ascii(text: str) -> tuple[str, np.ndarray]:
    """folded of ASCII text, where every character stands for one."""
    data = np.frombuffer(text.encode(), np.uint8)
    kept, origin = _kept(text, _SPACE[data], np.arange(len(text)))
    return _FOLDED[data[kept]].tobytes().decode(), origin


def _folded_even(text: str, chars: str) -> tuple[str, np.ndarray]:
    """folded of text whose plain characters are lowered to one each."""
    raw, data = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (text, chars))
    length = np.ones(len(raw), np.int64)
    for c in set(text):
        if len(_PLAIN[ord(c)]) != 1:
            length[raw == ord(c)] = len(_PLAIN[ord(c)])
    codes, at = np.unique(data, return_inverse=True)
    space = np.array([chr(c).isspace() for c in codes.tolist()], bool)
    low = np.array([32 if blank else ord(chr(c).lower()) for c, blank in zip(codes.tolist(), space.tolist())], np.uint32)
    kept, origin = _kept(chars, space[at], np.repeat(np.arange(len(raw)), length))
    return low[at[kept]].tobytes().decode("utf-32-le", "surrogatepass"), origin


def _kept(chars: str, space: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the characters that stay, the first of each run of white space between words too, and where they came from."""
    place = np.arange(len(chars))
    cut = [np.arange(*m.span()) for m in _SPLIT_WORD.finditer(chars)] if "-" in chars else []
    if cut:
        place = np.delete(place, np.concatenate(cut))
        space = space[place]
    after = np.ones(len(space), bool)
    after[1:] = space[:-1]
    kept = np.flatnonzero(~(space & after))
    if len(kept) and space[kept[-1]]:
        kept = kept[:-1]
    return place[kept], origin[place[kept]]


class _Plain(dict):
    """What a character becomes before words are parted and lowered, worked out once for each."""

    def __missing__(self, c: int) -> str:
        self[c] = "".join(_MAP.get(x, x) for x in unicodedata.normalize("NFKC", chr(c)))
        return self[c]


_PLAIN = _Plain()


def folded_text(text: str) -> str:
    """The normal form alone: folded(text)[0], without the places."""
    chars = text if text.isascii() else text.translate(_PLAIN)
    chars = " ".join((_SPLIT_WORD.sub("", chars) if "-" in chars else chars).split())
    return chars.lower() if chars.isascii() else "".join(map(str.lower, chars))


def _closest(quote: str, text: str, tries: int = 5, steps: int = 64) -> tuple[int, int, float]:
    """The span of whole words of text nearest to quote by matching-block ratio."""
    matcher = SequenceMatcher(None, "", quote, autojunk=False)

    known: dict[tuple[int, int], float] = {}

    def ratio(s: int, e: int, floor: float = -1.0) -> float:
        """The span's ratio, or -1 where it can't be above the floor; spans that several climbs meet are compared once."""
        if (s, e) not in known:
            matcher.set_seq1(text[s:e])
            if matcher.real_quick_ratio() <= floor or matcher.quick_ratio() <= floor:
                return -1.0
            known[s, e] = matcher.ratio()
        return known[s, e]

    top: list[tuple[float, int, int]] = []
    for s in [0, *(m.end() for m in re.finditer(" (?=.)", text, re.S))]:
        e = min(s + len(quote), len(text))
        r = ratio(s, e, -top[-1][0] if len(top) == tries else -1.0)
        if r >= 0:
            top = sorted([*top, (-r, s, e)])[:tries]
    best = (2.0, 0, 0)
    for neg, s, e in top:
        r = -neg
        for _ in range(steps):
            before = r
            after_first, before_last = text.find(" ", s, e) + 1, text.rfind(" ", s, e)
            nearby = [(after_first, e)] if 0 < after_first < e else []
            nearby += [(s, before_last)] if before_last > s else []
            nearby += [(text.rfind(" ", 0, max(s - 1, 0)) + 1, e)] if s else []
            if e < len(text):
                stop = text.find(" ", e + (text[e] == " "))
                nearby.append((s, len(text) if stop < 0 else stop))
            for a, b in nearby:
                if b > a and (x := ratio(a, b, r + 1e-12)) > r + 1e-12:
                    s, e, r = a, b, x
            if r == before:
                break
        best = min(best, (-r, s, e))
    return best[1], best[2], -best[0]


def locate(quote: str | None, text: str | None, least: float = DEFAULTS.span_match_min) -> dict | None:
    """Where a quote stands in a text: verbatim after folding, else the nearest words if near enough."""
    return locate_folded(folded_text(quote or ""), *folded(text or ""), least)


def locate_folded(q: str, t: str, at: np.ndarray, least: float = DEFAULTS.span_match_min) -> dict | None:
    """locate with a quote and a text that are folded already; at: the places of the text's characters."""
    if not q or not t:
        return None
    s = t.find(q)
    if s >= 0:
        return {"start": int(at[s]), "end": int(at[s + len(q) - 1]) + 1, "tier": "verbatim", "ratio": 1.0}
    if not may_stand(q, t, least):
        return None
    s, e, r = _closest(q, t)
    return {"start": int(at[s]), "end": int(at[e - 1]) + 1, "tier": "near", "ratio": r} if r >= least else None


def may_stand(quote: str, text: str, least: float = DEFAULTS.span_match_min) -> bool:
    """Whether locate may find a folded quote in a folded text; never wrongly false.

    A span with the ratio r to a quote of n characters shares at most n with it and leaves at most
    2 n (1 - r) / r characters of both over. The fewest that any span leaves over are worked out by
    rows, a row for each character of the quote.
    """
    if len(text) * (2 - least) < len(quote) * least:  # no span of it is long enough
        return False
    t, at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), np.arange(len(text) + 1, dtype=np.int32)
    left, same, most = np.zeros(len(text) + 1, np.int32), {}, 2 * len(quote) * (1 - least) / least + 1e-6
    for i, c in enumerate(quote, 1):
        if c not in same:
            same[c] = (t != ord(c)).astype(np.int32) * 2
        new = left + 1
        np.minimum(new[1:], left[:-1] + same[c], out=new[1:])
        left = np.minimum.accumulate(new - at) + at
        if i % 16 == 0 and left.min() > most:  # later rows have no fewer
            return False
    return bool(left.min() <= most)


def locate_anchored(text: str, first: str, last: str, copied: str, after: int = 0) -> dict | None:
    """By the copied words' first and last words, if the length fits within a quarter; else by all of them."""
    return anchored_folded(*folded(text or ""), *(folded_text(x or "") for x in (first, last, copied)), after)


def anchored_folded(t: str, at: np.ndarray, a: str, b: str, c: str, after: int = 0) -> dict | None:
    """locate_anchored with texts that are folded already."""
    if t and a and b and c:
        s = t.find(a, int(np.searchsorted(at, after)) if after > 0 else 0)
        e = t.find(b, s) if s >= 0 else -1
        if e >= 0 and abs(e + len(b) - s - len(c)) * 4 <= len(c):
            return {"start": int(at[s]), "end": int(at[e + len(b) - 1]) + 1, "by_anchors": True}
    found = locate_folded(c, t, at)
    return found and {"start": found["start"], "end": found["end"], "by_anchors": False}


# Abbreviations whose full stop ends no sentence, and marks around sentence ends.
ABBREVIATIONS = [
    "e.g.", "i.e.", "etc.", "cf.", "viz.", "vs.", "al.", "approx.", "no.", "nos.", "fig.", "ref.", "para.", "sec.", "vol.",
    "pp.", "dr.", "mr.", "mrs.", "ms.", "prof.", "rev.", "hon.", "jr.", "sr.", "st.", "ltd.", "inc.", "co.", "corp.", "plc.",
    "dept.", "est.", "govt.", "u.k.", "u.s.", "n.b.", "p.s.",
]
CLOSERS, OPENERS = "\"'”’)]»", "(\"'“‘[«"
MARKER = r"(?:[-*•‣◦▪–—]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)]|\d{1,3}(?:\.\d{1,3})+\.?)"
_END = re.compile(r"([.!?…]+)[\"'”’)\]»]*(?=\s+\S)")


def _abbreviated(before: str) -> bool:
    words = before.split()
    word = words[-1].lstrip(OPENERS).rstrip(CLOSERS) if words else ""
    return word.lower() in ABBREVIATIONS or bool(re.match(r"[A-Za-z]\.$", word))


def sentences_of(text: str | None) -> list[dict]:
    """Sentences with paragraph, offsets and whether they open a list item; lines are hard borders."""
    out, paragraph, blank = [], -1, True
    for line in re.finditer(r"[^\n]+", text or ""):
        body = line.group().strip()
        # a blank line stands between where the gap since the last line holds two line ends or only spaces
        if not body:
            blank = True
            continue
        if blank or "\n\n" in (text[max(0, line.start() - 2) : line.start()] if line.start() > 1 else ""):
            paragraph += 1
        blank = False
        base = line.start() + len(line.group()) - len(line.group().lstrip())
        marker = re.match(MARKER + r"(?=\s)", body)
        cuts = [0]
        for m in _END.finditer(body, marker.end() if marker else 0):
            rest = body[m.end() :].lstrip()
            dots = "…" in m[1] or m[1].count(".") >= 3
            if not _abbreviated(body[: m.end()]) and not (dots and not (rest[:1].isupper() or rest[:1].isdigit() or rest[:1] in OPENERS)):
                cuts.append(m.end())
        for s, e in zip(cuts, [*cuts[1:], len(body)]):
            piece = body[s:e].strip()
            if piece:
                start = base + body.index(piece, s)
                out.append({"text": piece, "paragraph": paragraph, "start": start, "end": start + len(piece), "list_item": bool(marker) and s == 0})
    return out


def is_terminal(text: str) -> bool:
    """Whether a sentence ends at the end of text."""
    body = text.rstrip().rstrip(CLOSERS).strip()
    words = body.split()
    if not words or re.fullmatch(MARKER, body) or body[-1] not in ".!?…" or _abbreviated(body):
        return False
    item = re.fullmatch(r"\(?(?:\d{1,3}|[a-zA-Z])[.)]", words[-1].lstrip(OPENERS))
    return not (item and (len(words) == 1 or words[-2].endswith((":", ";"))))


def chunks_of(text: str | None, target: int = DEFAULTS.chunk_tokens * 4) -> list[dict]:
    """Slices of about `target` characters that end at a line, a sentence, a space, or at 1.25 targets."""
    text, target, at, out = text or "", max(target, 8), 0, []
    while at < len(text):
        at += len(text[at:]) - len(text[at:].lstrip()) if text[at].isspace() else 0
        end = len(text)
        if at >= end:
            break
        if end - at > int(target * 1.5):
            low, high = at + int(target * 0.5), min(end, at + int(target * 1.25))
            window = text[low:high]
            stops = [m.end() for m in re.finditer(r"[.!?…][\"'”’)\]]*\s", window)]
            cut = window.rfind("\n") + 1 if window.rfind("\n") > 0 else stops[-1] if stops else window.rfind(" ") + 1 if window.rfind(" ") > 0 else high - low
            end = low + cut
        body = text[at:end].rstrip()
        if body:
            out.append({"start": at, "end": at + len(body)})
        at = end
    return out


# Bytes of lowered words stay, all others part them (of other letters every byte does).
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The words [0-9a-z]+ of lowered texts in order, and the row of each."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _IN_WORD[data]
    opens = inside & ~np.r_[False, inside[:-1]][: len(inside)]
    border = ends[(ends > 0) & (ends < len(data))]
    opens[border] = inside[border]
    starts, chars = np.flatnonzero(opens), data[inside]
    offsets = np.append(np.cumsum(inside, dtype=np.int32)[starts] - 1, len(chars)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(chars))
    return np.searchsorted(ends, starts, side="right") - 1, words.dictionary_encode()


#: Bytes of texts whose words are hashed at once.
HASHED_BYTES = 1 << 21


def hashed_vectors(texts: pa.Array, width: int) -> pa.Array:
    """Unit vectors from hashed words (1) and word pairs (1/2), signed by the hash's top bit; each term of these texts is hashed once."""
    n = len(texts)
    row, words = words_of(pa.array([(t or "").lower() for t in texts.to_pylist()], pa.string()))
    code, names = words.indices.to_numpy().astype(np.int64), [w.encode() for w in words.dictionary.to_pylist()]
    beside = row[1:] == row[:-1]
    pairs, at = np.unique(code[:-1][beside] * len(names) + code[1:][beside], return_inverse=True)
    first, second = (x.tolist() for x in np.divmod(pairs, max(1, len(names))))
    terms = [*names, *[names[a] + b" " + names[b] for a, b in zip(first, second)]]
    h = np.frombuffer(b"".join([blake2b(t, digest_size=8).digest() for t in terms]), ">u8").astype(np.uint64)
    sign, bucket = np.where(h >> np.uint64(63), 1.0, -1.0), (h % np.uint64(width)).astype(np.int64)
    at += len(names)
    v = np.bincount(row * width + bucket[code], sign[code], n * width)
    v += np.bincount(row[1:][beside] * width + bucket[at], sign[at] / 2, n * width)  # sums of halves are exact in any order
    v = v.astype(np.float64).reshape(n, width)  # whole numbers where no text has a word
    length = np.sqrt((v * v).sum(axis=1))
    v /= np.where(length > 0, length, 1.0)[:, None]
    v[length == 0, 0] = 1.0
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(v.ravel()))


def hashed_vector(text: str | None, width: int) -> list[float]:
    return hashed_vectors(pa.array([text], pa.string()), width)[0].as_py()


def word_diff(a: str | None, b: str | None) -> list[dict]:
    """Runs of words that stay, go or come between two texts."""
    x, y = (re.findall(r"\s+|\S+", t or "") for t in (a, b))
    out = []
    for tag, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if tag == "equal":
            out.append({"kind": "same", "text": "".join(x[i:j])})
            continue
        out += [{"kind": "removed", "text": "".join(x[i:j])}] * (j > i) + [{"kind": "added", "text": "".join(y[k:m])}] * (m > k)
    return out


def nearest_occurrence(quote: str | None, text: str | None, old: int) -> int | None:
    """The start of the quote's occurrence closest to where it was (the earlier of two)."""
    if not quote or not text:
        return None
    starts = [m.start() for m in re.finditer(f"(?={re.escape(quote)})", text)]
    return min(starts, key=lambda s: (abs(s - old), s), default=None)


def realigned(old: list[dict], text: str | None, least: float = DEFAULTS.realign_min) -> list[dict]:
    """An edited answer's sentences, each with the old segment it keeps or comes from.

    change: kept (equal after folding), edited (paired at `least` or more within a replaced run, best
    pairs first), or new. old_index is null for new ones.
    """
    new = sentences_of(text)
    a, b = [folded(s["text"])[0] for s in old], [folded(s["text"])[0] for s in new]
    origin: dict[int, tuple[str, int]] = {}
    for tag, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            origin |= {k + d: ("kept", i + d) for d in range(m - k)}
        elif tag == "replace":
            pairs = sorted((-SequenceMatcher(None, a[p], b[q], autojunk=False).ratio(), q, p) for p in range(i, j) for q in range(k, m))
            used: set[int] = set()
            for neg, q, p in pairs:
                if -neg >= least and q not in origin and p not in used:
                    origin[q] = ("edited", p)
                    used.add(p)
    rows = []
    for q, s in enumerate(new):
        change, p = origin.get(q, ("new", None))
        rows.append({"index": q, "paragraph": s["paragraph"], "text": s["text"], "change": change, "old_index": None if p is None else old[p]["index"]})
    return rows


#: Rows whose results exist as Python objects at once.
ROWS = 256


def _each(f, returns: str):
    """A vectorised UDF that applies a helper to every row of its column; made when it is called.

    Results become Arrow by ROWS rows: as Python objects those of a whole batch take many times their bytes.
    """

    def on(column):
        kind = to_arrow_type(_parse_datatype_string(returns))

        @F.arrow_udf(returns)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for rows in batches:
                parts = [pa.array([f(x) for x in rows.slice(lo, ROWS).to_pylist()], kind) for lo in range(0, len(rows), ROWS)]
                yield pa.concat_arrays(parts) if parts else pa.array([], kind)

        return run(column)

    return on


normalised = _each(lambda t: None if t is None else folded_text(t), "string")
sentences = _each(sentences_of, "array<struct<text:string,paragraph:int,start:int,end:int,list_item:boolean>>")
chunks = _each(chunks_of, "array<struct<start:int,end:int>>")
terminal = _each(lambda t: None if t is None else is_terminal(t), "boolean")


def hash_embedding(column, width: int):
    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // HASHED_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
            yield pa.concat_arrays([hashed_vectors(texts.slice(lo, hi - lo), width) for lo, hi in zip(cuts, cuts[1:])])

    return run(column)


def diff(a, b):
    @F.pandas_udf("array<struct<kind:string,text:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([word_diff(x, y) for x, y in zip(a, b)], dtype=object)

    return run(a, b)


def _find(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
    pairs = list(zip(quote, text))
    once = {p: locate(*p) or {} for p in dict.fromkeys(pairs)}  # many rows cite the same words
    found = [once[p] for p in pairs]
    return pd.DataFrame({c: pd.Series([f.get(c) for f in found], dtype=object) for c in ("start", "end", "tier", "ratio")})


def find_span(quote, text):
    return F.pandas_udf(_find, "struct<start:int,end:int,tier:string,ratio:double>")(quote, text)


def register(spark) -> None:
    """The functions by name for SQL: doc_normalise, doc_terminal, doc_find_span."""

    def rows(f, returns):
        def run(s: pd.Series) -> pd.Series:
            return pd.Series([f(x) for x in s], dtype=object)

        return F.pandas_udf(run, returns)

    spark.udf.register("doc_normalise", rows(lambda t: None if t is None else folded(t)[0], "string"))
    spark.udf.register("doc_terminal", rows(lambda t: None if t is None else is_terminal(t), "boolean"))
    spark.udf.register("doc_find_span", F.pandas_udf(_find, "struct<start:int,end:int,tier:string,ratio:double>"))
