"""Quotes over whole tables of texts."""

import random

from dossierspark.functions import spans as S
from dossierspark.operators.quotes import quote_places

QUOTE = "The service desk answers every call of the trust within four working hours of its receipt."


def test_every_text_that_holds_a_quote(spark):
    common = "the of the trust within every call of the " * 60  # many words of the quote, not the quote
    border = "Filler words stand here. " * 62 + QUOTE + " And more follows. " * 80  # over the end of a chunk
    texts = [(1, common), (2, border), (3, QUOTE.upper().replace(" ", "\n")), (4, "before " + QUOTE), (4, "other"), (5, None)]
    texts += [(6, "So: " + QUOTE.replace("working", "office")), (7, "Вот цитата без латинских букв, целиком.")]
    quotes = [(1, QUOTE), (2, "цитата без латинских букв"), (3, QUOTE), (4, None), (5, " ")]
    got = quote_places(spark.createDataFrame(texts, "item_id long, text string"), spark.createDataFrame(quotes, "query_id long, text string")).collect()
    want = [(q, i, s, t) for q in (1, 3) for i, s, t in ((2, border.index(QUOTE), "verbatim"), (3, 0, "verbatim"), (4, 7, "verbatim"), (6, 4, "near"))]
    assert sorted(tuple(r) for r in got) == sorted([*want, (2, 7, 4, "verbatim")])


def test_near_is_never_ruled_out():
    r = random.Random(7)
    for _ in range(60):
        quote = " ".join("".join(r.choices("abe", k=r.randint(1, 5))) for _ in range(8))
        edited = "".join(r.choice(["", c + "a", "b"]) if r.random() < 0.12 else c for c in quote)
        text = f"{''.join(r.choices('abe ', k=30))} {edited} {''.join(r.choices('abe ', k=30))}"
        q, t = S.folded_text(quote), S.folded_text(text)
        assert t == S.folded(text)[0] and (S.locate(quote, text) is None or S.may_stand(q, t))
    assert not S.may_stand("nothing like it at all", "xyz " * 50)
    odd = "Ａ–b ‘Q’ soft­ly trans-\n port ΑΣ İx y"
    assert S.folded_text(odd) == S.folded(odd)[0]
