import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm.helpers import awkward, clashing, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm.packing import WordIds, best_fit, improve, pack_documents, pack_lengths
from pairloom.llm.pieces import PieceModel, decode_pieces, encode_pieces, piece_digests
from pairloom.llm.token_rollups import change, commit_batch, totals, word_tokens
from pairloom.session import scratch_path

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n=400):
    rand = random.Random(2)
    fixed = ["", " ", "\n", "▁", "a▁ b", "<s> </s> <0x0A>", "\t\n  x", "é 漢字 😀", "it's, WE'LL’, x’s", "<|endoftext|> a<|endoftext|>b", "ΑΣ. ²,Ⅷ,x", "\x1ca\x1d,b", "a" * 300]
    return fixed + ["".join(rand.choice(" ab\n▁é漢<>0x1\t.,'sS|²\xa0") for _ in range(rand.randint(0, 60))) for _ in range(n)]


def test_agenda_equals_library():
    model, library = PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = odd_texts()
    for text, encoded in zip(texts, model.encode_batch(texts)):
        assert [i for ids, _ in encoded for i in ids] == library.encode(text)
    for chunk in ("▁worthless", "thing" * 30, "▁▁▁x"):  # the heap and the joint agendas agree
        assert tuple(model.ids_of(chunk)) == model.merge_many([chunk])[0]


def test_memory_bound_changes_nothing():
    small, large = PieceModel(PIECES, remembered=50), PieceModel(PIECES)
    texts = odd_texts(100)
    assert [small.encode_batch([t]) for t in texts] == [large.encode_batch([t]) for t in texts]


@pytest.mark.parametrize("again", [False, True])
def test_slice_beyond_the_memory_bound(again):
    """More distinct chunks than are remembered, in a batch after a first one, with or without chunks met before."""
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    small, first = PieceModel(PIECES, remembered=50), "some words met before"
    small.encode_batch([first])
    texts = [" ".join(f"id{i * 7919 % 1000}x" for i in range(k, k + 60)) for k in (0, 40, 80)] + [first] * again
    for _ in range(2):
        assert [[i for ids, _ in e for i in ids] for e in small.encode_batch(texts)] == [library.encode(t) for t in texts]


def test_piece_digests(spark):
    rows = awkward()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(i), len(ids := library.encode(t or "")), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, t in rows)
    got = piece_digests(clashing(table(spark, rows)), PIECES).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert piece_digests(table(spark, []), PIECES).count() == 0


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts(50)) if "▁" not in t]
    back = decode_pieces(encode_pieces(table(spark, rows), PIECES), PIECES).collect()
    assert {r.doc_id: r.text for r in back} == dict(rows)


def test_word_ids_equal_the_tokenizer():
    encoder, tokenizer = WordIds(WORDS, remembered=200), Tokenizer.from_file(WORDS)
    texts = odd_texts()
    for text, ids in zip(texts, encoder.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(spark, capacity):
    rows = awkward()
    tokenizer = Tokenizer.from_file(WORDS)
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            want.append((str(i), piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = pack_documents(clashing(table(spark, rows)), WORDS, capacity, block_rows=30).collect()
    assert sorted((str(r.doc_id), *r[1:5]) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(w[3] for w in want) // capacity)
    assert least <= len(bins) <= least * 1.1 + 4
    assert pack_documents(table(spark, []), WORDS).count() == 0


def test_local_search_empties_bins():
    rand = random.Random(4)
    lengths = [rand.randint(300, 700) for _ in range(600)]
    first = best_fit(lengths, 2048)
    better = improve([list(b) for b in first], lengths, 2048)
    assert len(better) < len(first) and sorted(i for b in better for i in b) == list(range(600))
    assert max(sum(lengths[i] for i in b) for b in better) <= 2048
    assert pack_lengths([], 10) == [] and pack_lengths([10, 10], 10) == [[0], [1]]


def test_rollups(spark):
    store = scratch_path(spark, "rollup-test")
    versions = {"words": word_tokens(F.col("text"))}
    docs = spark.createDataFrame([(1, "a b c", "en", "s"), (2, "d", "fr", None), (None, "x y", "en", "s"), (2, "d", "fr", None)], "doc_id long, text string, lang string, source string")
    found = lambda: sorted(tuple(map(str, r)) for r in totals(spark, store).collect())
    assert found() == []
    assert commit_batch(spark, store, "a", change(docs, "insert", versions)) and not commit_batch(spark, store, "a", change(docs, "insert", versions))
    assert found() == [("None", "fr", "words", "2", "2"), ("s", "en", "words", "2", "5")]
    moved = spark.createDataFrame([(1, "a b c d e", "de", "t"), (9, "new", "en", "s"), (None, "q", "en", "s")], docs.schema)
    assert commit_batch(spark, store, "b", change(moved, "revise", versions))
    assert found() == [("None", "fr", "words", "2", "2"), ("s", "en", "words", "2", "3"), ("t", "de", "words", "1", "5")]
    assert commit_batch(spark, store, "c", change(docs.where("doc_id = 2"), "delete", versions))
    assert commit_batch(spark, store, "d", change(docs.where("false"), "delete", versions)) and not commit_batch(spark, store, "d", change(docs, "insert", versions))
    assert found() == [("s", "en", "words", "2", "3"), ("t", "de", "words", "1", "5")]


def test_uncommitted_batch_is_not_read_and_is_replaced(spark):
    store = scratch_path(spark, "rollup-test")
    docs = spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    versions = {"words": word_tokens(F.col("text"))}
    commit_batch(spark, store, "a", change(docs, "insert", versions))
    half = [(7, "s", "en", "words", 1, 50)]  # a try that was lost before its commit
    spark.createDataFrame(half, "doc_id long, source string, lang string, tokenizer_version string, docs long, tokens long").write.parquet(f"{store}/ledger/batch=b")
    assert [r.n_tokens for r in totals(spark, store).collect()] == [2]
    commit_batch(spark, store, "b", change(docs, "insert", versions))
    assert [r.n_tokens for r in totals(spark, store).collect()] == [4]
