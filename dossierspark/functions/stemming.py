"""English words to their stems (Snowball's English stemmer), and the stop list of Postgres."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

# Lists that the stemmer and the text search configuration are made of.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now""".split()
)
_FORMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_FORMS |= {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = dict(
    p.split(":")
    for p in """tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al
aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble ogi:og fulli:ful lessli:less li:""".split()
)
_STEP3 = dict(p.split(":") for p in "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:".split())
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
_V, _C = "[aeiouy]", "[^aeiouy]"


def _ending(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


def _short(w: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(re.search(f"(?:{_C}{_V}[^aeiouywxY]|^{_V}{_C})$", w))


@lru_cache(1 << 18)
def stem_of(w: str) -> str:
    """The stem of a lowered ASCII word."""
    if len(w) <= 2 or w in _FORMS:
        return _FORMS.get(w, w)
    w = re.sub(f"(^|{_V})y", r"\1Y", w)
    m = re.match("gener|commun|arsen", w) or re.search(f"{_V}{_C}", w)
    r1 = m.end() if m else len(w)
    m = re.compile(f"{_V}{_C}").search(w, r1)
    r2 = m.end() if m else len(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_V, w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    e = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        w = w[: -len(e)] + "ee" if len(w) - len(e) >= r1 else w
    elif e and re.search(_V, w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and re.match(_C, w[-2]):
        w = w[:-1] + "i"
    e = _ending(w, _STEP2)
    at = len(w) - len(e or "")
    if e and at >= r1 and (e != "ogi" or w[at - 1] == "l") and (e != "li" or w[at - 1] in "cdeghkmnrt"):
        w = w[:at] + _STEP2[e]
    e = _ending(w, _STEP3)
    at = len(w) - len(e or "")
    if e and at >= (r2 if e == "ative" else r1):
        w = w[:at] + _STEP3[e]
    e = _ending(w, _STEP4)
    at = len(w) - len(e or "")
    if e and at >= r2 and (e != "ion" or w[at - 1] in "st"):
        w = w[:at]
    if w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.lower()


def stems(words: Column) -> Column:
    """The stems of an array of lowered words, repeated as they stand; stop words are left out."""

    @F.arrow_udf("array<string>")
    def run(rows: pa.Array) -> pa.Array:
        flat = rows.flatten().dictionary_encode()
        stem = pa.array([None if w in STOP else stem_of(w) for w in flat.dictionary.to_pylist()], pa.string())
        ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.list_value_length(rows), 0).cast(pa.int32()))
        return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), stem.take(flat.indices))

    return F.filter(run(words), lambda w: w.isNotNull())
