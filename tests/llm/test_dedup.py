"""Exact, near and substring deduplication against plain Python, and their edge cases."""

import random

import plain
from pyspark.sql import functions as F

from skyloom.llm import near_dedup
from skyloom.llm.components import components
from skyloom.llm.exact_dedup import CHUNK, drop_exact_copies, exact_groups
from skyloom.llm.near_dedup import drop_near_copies, near_groups
from skyloom.llm.substring_dedup import removed_words, without_repeats

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "one "), (6, None), (None, "one"), (None, "lone"), (7, "w" * 50_000)]


def exact(rows, **kw):
    return sorted((tuple(r) for r in exact_groups(rows, **kw).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)


def test_exact_edge_cases(documents):
    got = exact(documents(ODD))
    assert (1, 1, 3, True) in got and (2, 1, 3, False) in got and (6, 1, 3, False) in got
    assert (3, 3, 1, True) in got and (5, 5, 1, True) in got  # a space stays a space
    assert got.count((4, 4, 3, True)) == 2 and (None, 4, 3, False) in got and (None, None, 1, True) in got


def test_exact_rows_that_stay(documents):
    kept = [(r["doc_id"], r["text"]) for r in drop_exact_copies(documents(ODD)).collect()]
    assert sorted(kept, key=str) == sorted([(1, None), (3, " \t\n"), (4, "one"), (5, "one "), (None, "lone"), (7, "w" * 50_000)], key=str)
    assert drop_exact_copies(documents([])).count() == 0


def test_exact_with_clashing_identifiers(documents):
    """With three identifiers for all chunks, only the contents tell texts apart."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcde fghij") for _ in range(n)) for n in (10, 700, 3000, 3000, 9000)]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    got = exact(documents(rows), hash_of=lambda c: F.pmod(F.xxhash64(c), F.lit(3)))
    assert got == sorted(((i, i % 5, 2, i < 5) for i in range(10)), key=str)


def test_chunks_give_the_text_back(spark, documents):
    rows = documents([(1, "ab c" * 5000), (2, "漢字" * 3000), (3, "x"), (4, "é" * 1024)])
    cut = rows.select("text", F.concat_ws("", F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0))).alias("again"))
    assert all(r["text"] == r["again"] for r in cut.collect())


def near(rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_groups(rows).collect()}


def test_near_groups_match(documents, small):
    assert near(documents(small)) == plain.near_groups(small)


def family(rng, base, copies, edits):
    words = [f"w{rng.randrange(10_000)}" for _ in range(base)]
    out = [" ".join(words)]
    for _ in range(copies):
        own = list(words)
        for _ in range(rng.randint(1, edits)):
            own[rng.randrange(base)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(own))
    return out


def test_near_groups_of_large_nodes(documents, monkeypatch):
    """Copies linked through one text only, in more nodes, blocks and clusters than fit the small bounds."""
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 12)
    monkeypatch.setattr(near_dedup, "HUBS", 2)
    monkeypatch.setattr(near_dedup, "CLUSTER", 3000)
    monkeypatch.setattr(near_dedup, "CENTRAL", 3)
    monkeypatch.setattr(near_dedup, "LEVELS", 2)
    rng = random.Random(11)
    rows = list(enumerate(family(rng, 200, 70, 4) + family(rng, 120, 40, 3) + family(rng, 30, 5, 1)))
    rng.shuffle(rows)
    assert near(documents(rows)) == plain.near_groups(rows)


def test_pipeline_drops_copies_from_080(documents, monkeypatch):
    """The stage links from 0.80 up, the query from 0.85 up, also in nodes and clusters over the bounds."""
    rng = random.Random(19)
    words = [f"p{i}" for i in range(104)]
    pair = [(1000, " ".join(words)), (1001, " ".join(["x", *words[1:50], "y", *words[51:100], *"abcd"]))]
    assert plain.near_groups(pair, 80)[1001][1] == 1000 and plain.near_groups(pair)[1001][1] == 1001
    assert [r["doc_id"] for r in drop_near_copies(documents(pair)).collect()] == [1000]
    for bound, value in {"SMALL": 8, "BLOCK": 12, "HUBS": 2, "CLUSTER": 3000, "CENTRAL": 3, "LEVELS": 2}.items():
        monkeypatch.setattr(near_dedup, bound, value)
    rows = [*enumerate(family(rng, 200, 60, 5) + family(rng, 120, 40, 3) + family(rng, 60, 20, 2)), *pair]
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_groups(documents(rows), 80).collect()}
    assert got == plain.near_groups(rows, 80) != plain.near_groups(rows)


def test_near_edge_cases(documents):
    rows = [(1, None), (2, " "), (3, "a b"), (4, "A\tb"), (5, "a b c"), (6, "a b c d e"), (7, "A B C D E"), (None, "a b"), (8, "q " * 30_000), (9, "q " * 100)]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_groups(documents(rows)).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (6, 1, 6, True), (7, 1, 6, False)} <= got
    assert (None, 1, None, True) in got and (9, 1, 8, False) in got
    assert near_groups(documents([])).count() == 0
    assert {r["doc_id"] for r in drop_near_copies(documents(rows)).collect()} == {1, 2, 3, 5, 6, 8, None}


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}
    assert components(edges.limit(0)).count() == 0


def removed(rows):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in removed_words(rows).collect()}


def test_removed_words_match(documents, small):
    assert removed(documents(small)) == plain.without_repeats(small)


def test_removed_words_of_overlapping_passages(documents):
    rng = random.Random(3)
    source = [f"w{rng.randrange(500)}" for _ in range(400)]
    rows = [(0, " ".join(source)), (1, " ".join(source[:49])), (2, "x " + " ".join(source[10:60]) + "\ny"), (3, " ".join(source[20:160] + source[100:250])),
            (4, "same " * 300), (5, "same " * 60), (6, "other " + "same " * 49), (7, None), (8, "")]
    rows += [(9 + i, " ".join(source[a : a + n] + [f"z{i}"] + source[b : b + n])) for i, (a, b, n) in enumerate((rng.randrange(300), rng.randrange(300), rng.randrange(30, 90)) for _ in range(40))]
    assert removed(documents(rows)) == plain.without_repeats(rows)


def test_cleaned_rows(documents):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = documents([(1, f"first  {passage}"), (2, f"second {passage}  end"), (3, passage), (None, passage), (4, "as  it is"), (5, None), (6, "")])
    got = {r["doc_id"]: r["text"] for r in without_repeats(rows.withColumn("factors", F.lit(1))).collect()}
    assert got == {1: f"first  {passage}", 2: "second end", None: passage, 4: "as  it is", 5: None, 6: ""}
    assert without_repeats(documents([])).count() == 0


def test_repeated_ids_do_not_clean_each_other(documents):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = documents([(1, passage), (1, passage + " x"), (2, passage)])
    assert sorted((r["doc_id"], r["n_removed"]) for r in removed_words(rows).collect()) == [(1, 0), (1, 0), (2, 60)]
