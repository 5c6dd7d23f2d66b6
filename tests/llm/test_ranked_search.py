"""Ranked lexical search against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from skyloom.llm import ranked_search
from skyloom.llm.ranked_search import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    big_n, big_l = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(t for t in terms(text) if t in df)
        found = []
        for d, c, n in held:
            m = 100 - 75 + (75 * n * big_n) // big_l
            score = sum(q * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def rows(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n long, codes string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank long")
    return sorted(map(tuple, ranked(d, i).collect()), key=str)


def test_odd_rows(spark):
    docs = [(i, f"common word{i % 7} Word{i % 3} É{i % 5} " * (1 + i % 4)) for i in range(60)]
    docs += [(None, "common word1 rare"), (None, ""), (3, "word1 word1 rare-rare"), (3, "word1 word1 rare-rare"), (100, None), (101, " -- "), (102, "rare " * 50_000)]
    items = [(1, "Common WORD1, rare rare"), (2, None), (3, ""), (4, "unknown"), (None, "É1 é1 word2"), (1, "common"), (5, "word1 word2 word3 word0 common")]
    assert rows(spark, docs, items) == plain(docs, items)


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "same text of all") for i in reversed(range(40))] + [(i, "other") for i in range(40, 90)]
    got = rows(spark, docs, [(1, "text same")])
    assert got == plain(docs, [(1, "text same")]) and {r[2] for r in got} == set(range(10))


def test_empty_tables(spark):
    assert rows(spark, [], [(1, "a")]) == [] and rows(spark, [(1, "a")], []) == [] and rows(spark, [(1, None)], [(1, "a")]) == []


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 3)
    docs = [(i, f"a{i % 5} b{i % 7} c{i % 11}") for i in range(80)]
    items = [(i, f"a{i} b{i} c{i} b{i}") for i in range(9)]
    assert rows(spark, docs, items) == plain(docs, items)


@pytest.mark.parametrize("seed", range(4))
def test_stops_early_and_is_exact(seed):
    """Over skewed lists the best documents are those of a full scan, and few positions are read."""
    rng = np.random.default_rng(seed)
    n, terms_ = 4000, 12
    owner, code = np.nonzero(rng.random((n, terms_)) < rng.uniform(0.02, 0.9, terms_))
    tf = rng.zipf(1.6, len(owner)).clip(1, 400)
    lengths = rng.integers(30, 400, n)
    shard = ranked_search._Shard(rng.permutation(n), lengths, owner, code.astype(np.int32), tf)
    weights = rng.integers(1, 5000, terms_)
    read = []
    direct = shard.direct
    shard.direct = lambda c, d: (read.append(len(d)), direct(c, d))[1]
    none = np.zeros(0, np.int64)
    scores, ids = shard.best(np.arange(terms_), weights, 10, none, none)
    total = np.zeros(n, np.int64)
    np.add.at(total, owner, weights[code] * ((10**9 * tf) // (1000 * tf + 8 * lengths[owner])))
    order = np.lexsort((shard.ids, -total))[:10]
    assert (scores == total[order]).all() and (ids == shard.ids[order]).all()
    assert not shard.seen.any() and sum(read) < n


def test_equal_hashes_are_not_equal_terms(monkeypatch):
    from skyloom.llm.words import Words

    data = ranked_search._TERM_BYTES[np.frombuffer(b"abc abd abc", np.uint8)]
    words = Words(data, np.array([0, 11]))
    vocabulary = ranked_search._Vocabulary([b"abc"])
    words.hashes[:] = vocabulary.hashes[0]
    assert vocabulary.found(words, data)[0].tolist() == [0, 2]


def test_whole_table(spark, sf, small):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows(spark, small, items) == plain(small, items)
