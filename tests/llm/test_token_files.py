import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from dossierspark.llm import token_files
from dossierspark.llm.common import scratch
from dossierspark.llm.token_files import EliasFano, WordTokens, read_token_files, token_table, word_tokens, write_token_files

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*"aAbzZ'sStTdmrevl.,!?<|>0129éÉßŸÿ\t\n\r\x0b\x0c\x1c\x85\xa0  İΣσς²½ªµ£中あ😀́", "<|endoftext|>", " 's", "'ll", "don't"]


@pytest.mark.parametrize("values", [[], [0], [5], [1, 1, 1], list(range(300)), [3, 70, 70, 9_000_000_000], sorted(random.Random(1).choices(range(10**6), k=777))])
def test_elias_fano(values):
    code = EliasFano.from_bytes(EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert [code.select(i) for i in range(len(values))] == values
    assert code.select(np.arange(len(values))[::-1]).tolist() == values[::-1]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 50_000))
    assert len(EliasFano.of(ends).to_bytes()) * 8 < 50_000 * (2 + np.log2(1000) + 1.2)


def test_tokens_equal_the_tokenizer():
    rng, tokens, plain = random.Random(2), WordTokens(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["a" * 5000, " ".join(["word"] * 3000)]
    got = tokens(pa.array([*texts, None]))
    assert got.pop().tolist() == [] and tokens(pa.array([], pa.string())) == []
    assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_end_with_their_text(monkeypatch):
    plain = Tokenizer.from_file(VOCABULARY)
    texts = ["it'", "s", "'", "re", "'r", "e", "", "'", None, "ve", "<", "|endoftext|>", "é", "a\u0301'S", "\u0301b", "!", "'s", "x''s 5'll's", "1", "2", "\xc3", "×", "a×'s b", "'"]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (1 << 20, 1):
        monkeypatch.setattr(token_files, "ENCODE_BYTES", size)
        tokens = WordTokens(VOCABULARY)
        for kind in (pa.string(), pa.large_string()):
            assert [g.tolist() for g in tokens(pa.array(["before'", *texts], kind)[1:])] == want


def test_pieces_are_encoded_once_for_all_tasks(monkeypatch):
    asked = []
    monkeypatch.setattr(WordTokens, "_plain", lambda self, pieces, f=WordTokens._plain: asked.extend(pieces) or f(self, pieces))
    words = [f"piece{chr(97 + i)}" for i in range(26)]
    for k in range(3):
        word_tokens(VOCABULARY)(pa.array([" ".join(words[k:]), f"{words[3]}, {words[4]}!"]))
    assert sorted(p for p in asked if p.startswith("piece")) == words


def test_pieces_that_are_met_again_stay(monkeypatch):
    monkeypatch.setattr(WordTokens, "PIECES", 40)
    monkeypatch.setattr(WordTokens, "LONGEST", 8)
    tokens, plain = WordTokens(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for k in range(30):
        texts = [f"again and {chr(97 + k % 26)}x{chr(97 + k // 5)} é{'z' * k}", "中" * k + " again"]
        assert [g.tolist() for g in tokens(pa.array(texts))] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        kept = tokens.pieces.to_pylist()
        assert len(kept) <= 40 and {"again", "and"} <= set(kept) and max(len(p.encode()) for p in kept) <= 8
        assert len(kept) == len(tokens.sizes) == len(tokens.uses) and tokens.sizes.sum() == len(tokens.ids)


def brute(docs):
    plain, start, out = Tokenizer.from_file(VOCABULARY), 0, []
    tie = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1]), r[1] or "")):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_read_back(spark):
    docs = [(9, "later text"), (1, None), (2, ""), (5, "Some words, here!\nAnd more."), (5, "again 123"), (5, "again 123"), (None, "no id"), (-3, "é" * 2000), (7, "x y " * 20_000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, start long, ids string")
    assert sorted(map(tuple, token_table(df, VOCABULARY).collect()), key=str) == sorted(brute(docs), key=str)


def test_offsets_come_from_select(spark, monkeypatch):
    df = spark.createDataFrame([(i, "word " * i) for i in range(40)], "doc_id long, text string").coalesce(1)
    path = scratch(spark, "test-tokens")
    write_token_files(df, VOCABULARY, path)
    places = []
    monkeypatch.setattr(EliasFano, "select", lambda self, i: places.append(len(np.atleast_1d(i))) or np.zeros(np.shape(i), np.int64))
    code = EliasFano.from_bytes(spark.read.parquet(path).first()["boundaries"])
    assert code.select(np.arange(code.n)).tolist() == [0] * code.n and places == [code.n]
    assert not hasattr(code, "values")


def test_segments_are_split(spark):
    docs = [(i, "some words here " * (i % 7)) for i in range(200)]
    path = scratch(spark, "test-tokens")
    write_token_files(spark.createDataFrame(docs, "doc_id long, text string"), VOCABULARY, path, segment_ids=100)
    assert spark.read.parquet(path).count() > 20
    assert sorted(map(tuple, read_token_files(spark, path).collect())) == brute(docs)


def test_no_documents(spark):
    assert token_table(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
