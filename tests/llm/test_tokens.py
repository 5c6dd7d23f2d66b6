"""Packing, token counts and sentence pieces against the tokenizers themselves."""

import random
import zlib

import numpy as np
import plain
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.llm.packing import best_fit, packed_documents, packed, pieces, token_sequences
from skyloom.llm.query_op1 import vocabulary
from skyloom.llm.query_op2 import pieces_file
from skyloom.llm.sentence_pieces import MARKER, Vocabulary, decoded, encoded
from skyloom.llm.token_counts import Rollup, deleted, inserted, revised, token_counts
from skyloom.llm.tokens import encoder, special_tokens
from skyloom.session import new_table_path

ODD = ["", " ", "  ", "a", " a", "a ", "  a  b", "a \n b", "x\n \ny", "x   ", "don't  stop", "é漢 字😀", "<|endoftext|>", "a <|endoftext|> b", "a\u00a0 \u2003b", "\x1c \x1d", "1 23", "\t\t x"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def ids_of(texts):
    lengths, ids = encoder(vocabulary(), special_tokens(vocabulary())).encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids.flat(), np.cumsum(lengths)[:-1])]


def test_ids_are_the_tokenizers(whole, small):
    texts = ODD + [t for _, t in small]
    assert ids_of(texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab1.'s\u00a0\u3000é漢", max_size=24), min_size=1, max_size=5))
def test_ids_of_any_white_space(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    assert ids_of(texts) == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_fit_fills_bins():
    rng = random.Random(1)
    sizes = np.array([rng.randint(1, 1024) for _ in range(5000)])
    bins, offsets, fills = best_fit(sizes, 1024)
    for b in range(len(fills)):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == [0, *np.cumsum(sizes[own])[:-1].tolist()] and sizes[own].sum() == fills[b] <= 1024
    assert len(fills) <= 1.02 * sizes.sum() / 1024 + 1


def checked(rows, whole, placed):
    """Every document's pieces are whole, and sequences are gapless; returns the number of sequences."""
    by_doc, by_sequence = {}, {}
    for r in placed:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {d for d, _ in rows}
    for doc, text in rows:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 1024)
        assert all(r["length"] == 1024 for r in own[1:]) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return len(by_sequence), sum(r["length"] for r in placed)


def test_packed_documents(documents, small, whole):
    rows = small + [(-1, None), (-2, ""), (-3, "word " * 5000)]
    n, tokens = checked(rows, whole, packed_documents(documents(rows), vocabulary()).collect())
    assert n <= 1.02 * tokens / 1024 + 1


def test_packing_over_many_groups(documents, small, whole):
    cut = pieces(documents(small).repartition(5), vocabulary())
    n, tokens = checked(small, whole, packed(cut, group=20).collect())
    assert n <= 1.1 * tokens / 1024 + 1


def test_sequences_hold_their_tokens(documents, small, whole):
    got = token_sequences(documents(small[:50]), vocabulary()).collect()
    assert max(len(r["ids"]) for r in got) <= 1024
    want = [i for _, t in small[:50] for i in [*whole.encode(t, add_special_tokens=False).ids, 2]]
    assert sorted(i for r in got for i in r["ids"]) == sorted(want)


def test_packing_of_nothing(documents):
    assert packed_documents(documents([]), vocabulary()).count() == 0


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(pieces_file())


def test_paths_are_the_best(vocab, small):
    words = list(dict.fromkeys(w for _, t in small[:40] for w in t.split()))[:800] + ["漢字ça", "😀x", "a\nb", "\x00"]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces_file())
    table = {model.id_to_piece(i).encode(): (i, vocab.scores[i]) for i in range(259, model.get_piece_size())}
    for word, ids in zip(words, vocab.segmented([MARKER + w for w in words])):
        raw = (MARKER + word).encode()
        assert b"".join(bytes([vocab.surface[vocab.surface_at[i]]]) if model.is_byte(i) else model.id_to_piece(i).encode() for i in ids) == raw
        bare = sum(1 for i in ids if model.is_byte(i))
        if not bare:
            assert sum(vocab.scores[i] for i in ids) == plain.best_path(raw, table, vocab.unknown)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=" ab\né漢😀", max_size=30), min_size=1, max_size=6))
def test_decoding_gives_texts_back(texts):
    vocab = Vocabulary.__dict__.get("shared") or Vocabulary(pieces_file())
    Vocabulary.shared = vocab
    assert vocab.decode(vocab.encode(pa.array(texts, pa.string()))) == texts


def test_sentence_pieces_edge_cases(spark, documents, vocab):
    rows = documents([(1, None), (2, ""), (3, "a▁b"), (4, "  two  spaces "), (5, "long" * 20_000), (None, "x")])
    got = {r["doc_id"]: r["decoded"] for r in decoded(encoded(rows, pieces_file()), pieces_file()).collect()}
    assert got == {1: "", 2: "", 3: "a b", 4: "  two  spaces ", 5: "long" * 20_000, None: "x"}
    assert vocab.decode(pa.array([None, [], [-1, 0, 1, 99_999], [int(vocab.byte_ids[0xFF])]], pa.list_(pa.int32()))) == ["", "", "", "\ufffd"]


def test_rollup_commits(spark, documents):
    rows = spark.createDataFrame([(1, "a b", "en", "s", 0), (2, None, None, None, 0), (3, "c", "en", "s", 0), (3, "c", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    counts = token_counts(rows, vocabulary(), "v1")
    rollup = Rollup(spark, new_table_path(spark, "test-rollup"))
    rollup.commit("1", inserted(counts))
    rollup.commit("1", inserted(counts))
    total = lambda: {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}
    assert total() == {("s", "en"): (3, 4), (None, None): (1, 0)}
    one = counts.filter("doc_id = 1")
    rollup.commit("2", revised(one, one.withColumn("n_tokens", one["n_tokens"] * 5)))
    rollup.commit("3", deleted(counts.filter("doc_id <> 1")))
    rollup.commit("4", inserted(counts.limit(0)))
    assert total() == {("s", "en"): (1, 10)}


def test_folds_and_later_commits(spark):
    """Totals are those of the last commit of every batch, wherever folds fall, and a commit that failed leaves nothing."""
    schema = "doc_id long, source string, lang string, tokenizer string, n_tokens long, docs string"
    counts = lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], schema)
    a = [(1, "s", "en", "v", 10), (1, "s", "en", "v", 10), (None, None, "en", "v", 3)]
    b = [(2, "s", "en", "v", 7), (3, "t", None, "v", 0)]
    rollup = Rollup(spark, new_table_path(spark, "test-folds"))
    total = lambda: sorted(((r["source"], r["lang"], r["docs"], r["tokens"]) for r in rollup.totals().collect()), key=str)
    assert total() == []
    rollup.fold()
    rollup.commit("a", inserted(counts(a)))
    rollup.fold()
    rollup.commit("b", inserted(counts(b)))
    want = sorted([("s", "en", 3, 27), (None, "en", 1, 3), ("t", None, 1, 0)], key=str)
    assert total() == want
    rollup.commit("a", inserted(counts(a[:1])))  # after it was folded
    less = sorted([("s", "en", 2, 17), ("t", None, 1, 0)], key=str)
    assert total() == less
    rollup.fold()
    rollup.fold()
    assert total() == less and len(rollup._published()) == 1
    rollup.commit("a", inserted(counts(a)))
    assert total() == want
    with pytest.raises(Exception):
        rollup.commit("c", inserted(counts(b)).withColumn("docs", F.raise_error(F.lit("lost")).cast("int")))
    assert total() == want
    rollup.commit("d", deleted(counts(a + b)))
    assert total() == []
