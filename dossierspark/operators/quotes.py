"""Where a whole table of quotes stands in a whole table of texts."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import folded_text, locate, may_stand
from ..settings import DEFAULTS

#: Quotes that one pass over the texts looks for; more quotes make more passes.
QUOTE_BLOCK = 4096
#: Words in a row that a near passage must share with its quote; quotes of fewer than FEW words need none.
SEED, FEW = 3, 6


class Finder:
    """Looks for many quotes in one text after another."""

    def __init__(self, quotes: list[tuple[int, str]]):
        self.quotes, self.folds = quotes, [folded_text(q) for _, q in quotes]
        self.reach = [int(len(f) * (2 - DEFAULTS.span_match_min) / DEFAULTS.span_match_min) + 1 for f in self.folds]
        self.exact, same = ahocorasick.Automaton(), defaultdict(list)
        self.seeds, self.always = defaultdict(set), []
        for j, fold in enumerate(self.folds):
            if fold:
                same[fold].append(j)
                words = re.findall(r"\w+", fold)
                if len(words) < FEW:
                    self.always.append(j)
                for seed in zip(*(words[i:] for i in range(SEED))):
                    self.seeds[seed].add(j)
        for fold, own in same.items():
            self.exact.add_word(fold, own)
        if same:
            self.exact.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        """query_id, start, tier of every quote that locate finds in the text."""
        fold = folded_text(text)
        if not fold or not len(self.exact):
            return []
        there = {j for _, own in self.exact.iter(fold) for j in own}
        words = re.findall(r"\w+", fold)
        near = [(j, 0, len(fold)) for j in self.always if j not in there]
        if not self.seeds.keys().isdisjoint(zip(*(words[i:] for i in range(SEED)))):
            at = [m.span() for m in re.finditer(r"\w+", fold)]
            for k, seed in enumerate(zip(*(words[i:] for i in range(SEED)))):
                for j in self.seeds.get(seed, ()):
                    if j not in there:
                        near.append((j, max(0, at[k][0] - self.reach[j]), at[k + SEED - 1][1] + self.reach[j]))
        for j, lo, hi in near:
            if j not in there and may_stand(self.folds[j], fold[lo:hi]):
                there.add(j)
        found = [(self.quotes[j][0], locate(self.quotes[j][1], text)) for j in sorted(there)]
        return [(q, f["start"], f["tier"]) for q, f in found if f]


def quote_places(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """query_id, item_id, start, tier: every quote in every text that holds it, at its first place.

    Verbatim places are exact over the whole folded texts. Texts without one are searched for near words
    if such words can stand around SEED words in a row that text and quote share, which is worked out
    first; a near passage without SEED whole words in a row is missed.
    texts: item_id, text. quotes: query_id, text.
    """
    given = quotes.where("text is not null")
    blocks, found = max(1, -(-given.count() // QUOTE_BLOCK)), None
    for b in range(blocks):
        own = given.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "text").toPandas()
        shared = texts.sparkSession.sparkContext.broadcast(list(zip(own["query_id"].tolist(), own["text"].tolist())))

        def places(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            finder = Finder(shared.value)
            for pdf in batches:
                rows = [(q, i, s, t) for i, text in zip(pdf["item_id"], pdf["text"]) for q, s, t in finder(text)]
                yield pd.DataFrame(rows, columns=["query_id", "item_id", "start", "tier"])

        part = texts.where("text is not null").select("item_id", "text").mapInPandas(places, "query_id long, item_id long, start int, tier string")
        found = part if found is None else found.union(part)
    return found
