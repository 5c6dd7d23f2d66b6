"""Language identification, URL rules, tool calls, top-k search and the pipeline."""

import base64
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import QUERIES, topk_search
from skyloom.llm.language_id import drop_unknown, fit, held_out, identified, predict
from skyloom.llm.tool_calls import linked
from skyloom.llm.topk_search import top_k
from skyloom.llm.url_filter import judged


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = docs.join(QUERIES["op8_language_id"](spark, sf), "doc_id").filter("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("hit"))
    row = got.agg(F.avg("hit"), F.count("hit")).first()
    assert row[1] > 250 and row[0] > 0.98


def test_language_edge_cases(documents):
    learn = [(i, "the cat and the dog " * 3, "en") for i in range(60)] + [(100 + i, "der hund und die katze " * 3, "de") for i in range(60)]
    odd = [(300, None, "en"), (301, "12 !!", "de"), (302, "", None), (None, "und der hund", None), (303, "the dog", None), (303, "the dog", None), (304, "die katze " * 20_000, None)]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in identified(documents(learn + odd)).collect()]
    by = {d: p for d, p, _ in got}
    assert by[300] == by[301] == by[302] == "und" and by[None] == "de" and by[303] == "en" and by[304] == "de"
    assert len(got) == 127 and all(0 <= s <= 1 for _, _, s in got)
    assert {p for _, p, _ in [(r["doc_id"], r["lang_pred"], 0) for r in identified(documents([(1, "abc", None)])).collect()]} == {"und"}
    assert identified(documents([])).count() == 0 and drop_unknown(documents([])).count() == 0
    kept = drop_unknown(documents(learn + odd).withColumn("score", F.lit("mine")))
    assert kept.filter("doc_id >= 300").count() == 3 and kept.columns[-1] == "score"
    assert fit(documents([(1, "abc", None)])) is None and predict(documents([(1, "x")]), None).first()["lang_pred"] == "und"


def test_languages_of_long_texts_only(documents):
    """A language is learned whatever the length of its texts, and without labels nothing that has a letter goes."""
    long = [(i, f"the cat and the dog number {i} " * 1200, "en") for i in range(30)] + [(100 + i, f"der hund und die katze {i} " * 3, "de") for i in range(30)]
    asked = [(200, "the dog and the cat", None), (201, "die katze und der hund", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in identified(documents(long + asked)).collect()}
    assert got[200] == "en" and got[201] == "de"
    alone = {r["doc_id"]: r["lang_pred"] for r in identified(documents(long[:30] + asked)).collect()}
    assert set(alone.values()) == {"en"}
    unlabelled = documents([(1, "anything", None), (2, "12", None), (3, None, None), (None, "also", None)])
    assert {r["doc_id"] for r in drop_unknown(unlabelled).collect()} == {1, None}


def test_a_repeated_id_does_not_swell_the_sample(documents):
    """Rows of one id are drawn each by itself, and equal rows are one: the model is that of the different rows."""
    rows = [(7, f"the cat {i} and the dog", "en") for i in range(400)] + [(i, f"der hund {i} und die katze", "de") for i in range(400)]
    once = fit(documents(rows), landmarks=40, sample=60)
    often = fit(documents(rows + rows[:1] * 3000), landmarks=40, sample=60)
    assert len(once.codes) > 50 and (once.codes == often.codes).all() and np.allclose(once.weights, often.weights)


FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由，在尊严和权利上一律平等。",
    base64.b64encode(random.Random(3).randbytes(600)).decode(), "qwrtz psdfg hjklx cvbnm " * 20,
]


@pytest.mark.parametrize("languages", [("en",), ("en", "fr"), ("de", "en", "es", "fr")])
def test_foreign_texts_go(spark, documents, languages):
    """Whatever the number of languages, what is foreign to all of them goes and clean documents that were held out stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("lang").isin(*languages))
    foreign = documents([(-1 - i, t) for i, t in enumerate(FOREIGN)]).select(*docs.columns)
    kept = {r["doc_id"] for r in drop_unknown(docs.unionByName(foreign)).select("doc_id").collect()}
    assert not {d for d in kept if d < 0}
    assert docs.filter(held_out()).count() == docs.filter(held_out() & F.col("doc_id").isin(*kept)).count()


def verdicts(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in judged(pages, listed).orderBy("page_id").collect()]


def test_url_rules(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/es/", "allow"), ("b.org", "", "block"), ("a.b.org", "/x", "allow"), ("b.org", "/xyz", "block")]
    urls = [None, "", "org/", "http://ORG/", "http://org", "ftp://www.Example.ORG/es/1?x#y", "http://notexample.org/es/", "http://b.org?q=/x", "http://a.b.org/xyz", "x://y://b.org/", "http://example.org/ES/"]
    assert verdicts(spark, urls, rules) == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "/", "org/", "allow"), ("org", "", None, "allow"),
        ("www.example.org", "/es/1", "example.org/es/", "block"), ("notexample.org", "/es/", "org/", "allow"), ("b.org", "", "b.org", "block"),
        ("a.b.org", "/xyz", "a.b.org/x", "allow"), ("y:", "//b.org/", None, "allow"), ("example.org", "/ES/", "org/", "allow"),
    ]
    assert verdicts(spark, ["http://a/" + "p" * 10_000], [])[0][2:] == (None, "allow")
    assert verdicts(spark, [], rules) == []


def test_url_rules_from_a_long_list(spark):
    rng = random.Random(4)
    rules = [(f"h{rng.randrange(900)}.com", f"/{rng.randrange(9)}", rng.choice(["allow", "block"])) for _ in range(3000)]
    best = {}
    for h, p, v in rules:
        best[h, p] = max(v, best.get((h, p), ""))
    urls = [f"https://www.h{rng.randrange(1200)}.com/{rng.randrange(12)}/x" for _ in range(500)]
    got = verdicts(spark, urls, rules)
    for (host, path, rule, verdict) in got:
        key = (host.removeprefix("www."), path[:2])
        assert (rule, verdict) == ((key[0] + key[1], best[key]) if key in best else (None, "allow"))


SCHEMAS = {"f": {"a": ("integer", True), "b": ("string", False)}}


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, 0, "x", "f", '{"b":"é\\n","a":1}', None), (1, 2, "y", "f", '{"a":true}', "x"), (1, 4, "z", "f", "{}", "y"), (1, 5, "x", "f", "{}", None),
         (1, 6, "p", "f", '{"a":1}', "q"), (1, 7, "q", "f", '{"a":1}', "p"), (1, 8, "r", "g", "[1]", "nobody"), (2, 0, "s", "f", '{"a":1,"c":2}', "s"), (None, 0, "n", "f", None, None), (3, 0, "t", "g", "{}", None)],
        "conv_id long, turn long, call_id string, name string, arguments string, after string",
    )
    results = spark.createDataFrame([(1, 1, "x", "one"), (1, 3, "y", None), (1, 9, "x", "late"), (1, 10, "none", "lost"), (None, 1, "n", "null")], "conv_id long, turn long, call_id string, content string")
    got = {(r["conv_id"], r["turn"], r["call_id"]): r for r in linked(calls, results, SCHEMAS).collect()}
    short = {k: (r["level"], r["status"], r["problem"]) for k, r in got.items()}
    assert short == {
        (1, 0, "x"): (0, "linked", None), (1, 2, "y"): (1, "linked", "a: no integer"), (1, 4, "z"): (2, "open", "a: missing"), (1, 5, "x"): (None, "repeated", "a: missing"),
        (1, 6, "p"): (None, "open", "circular dependency"), (1, 7, "q"): (None, "open", "circular dependency"), (1, 8, "r"): (0, "open", "unknown dependency"),
        (2, 0, "s"): (None, "open", "circular dependency"), (None, 0, "n"): (None, "open", "arguments: no object"), (3, 0, "t"): (0, "open", "unknown tool"),
        (1, 9, "x"): (None, "repeated", None), (1, 10, "none"): (None, "orphan", None), (None, 1, "n"): (None, "orphan", None),
    }
    assert got[1, 0, "x"]["line"] == '{"arguments":{"a":1,"b":"é\\n"},"call":"x","conversation":1,"level":0,"name":"f","result":"one","turn":0}'
    assert all(json.dumps(json.loads(r["line"]), sort_keys=True, ensure_ascii=False, separators=(",", ":")) == r["line"] for r in got.values())
    assert linked(calls.limit(0), results.limit(0), SCHEMAS).count() == 0


def test_long_chains_of_calls(spark):
    n = 70
    calls = spark.createDataFrame([(1, i, f"c{i}", "f", '{"a":1}', f"c{i - 1}" if i else None) for i in range(n)], "conv_id long, turn long, call_id string, name string, arguments string, after string")
    none = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    assert {r["turn"]: r["level"] for r in linked(calls, none, SCHEMAS).collect()} == {i: i for i in range(n)}


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD", 40)
    monkeypatch.setattr(topk_search, "BLOCK", 7)
    rng = random.Random(2)
    vectors = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.random()]) for _ in range(12)]) for i in range(300)]
    vectors += [(300 + i, vectors[5][1]) for i in range(15)]
    odd = [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (404, [2.0]), (405, []), (None, [1.0] * 12), (406, [1e6] * 12)]
    rows = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>")
    import math

    whole = {i: [math.floor(1024 * x) for x in v] for i, v in [*vectors, *[o for o in odd if o[0] in (404, 405, 406)]]}
    got = {}
    for r in top_k(rows, rows.filter("vec_id % 30 = 0 or vec_id > 399"), 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {i for i in whole if i % 30 == 0 or i > 399}
    for q, best in got.items():
        scores = sorted(((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q))[:10]
        assert [best[k] for k in range(1, 11)] == [(i, -s) for s, i in scores]
    few = rows.filter("vec_id < 3")
    assert top_k(few, few).count() == 6 and top_k(few, few.limit(0)).count() == 0 and top_k(few.limit(0), few).count() == 0


def test_pipeline(spark, sf):
    """Every stage's decisions as plain Python takes them from the stage's own input."""
    import plain
    import re

    import corpus_pipeline as p
    from skyloom.llm import near_dedup

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = p.language_id(spark, docs, sf).cache()
    dropped = docs.join(known, "doc_id", "left_anti").collect()
    assert known.columns == docs.columns and len(dropped) < 0.02 * docs.count()
    once = p.exact_dedup(spark, known, sf).cache()
    first = {}
    for r in sorted(known.collect()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), r)
    assert sorted(once.collect()) == sorted(first.values())
    apart = p.near_dedup(spark, once, sf).cache()
    rows = [(r["doc_id"], r["text"]) for r in once.collect()]
    assert {r["doc_id"] for r in apart.collect()} == {d for d, (_, c) in plain.near_groups(rows, near_dedup.STAGE_PERCENT).items() if d == c}
    clean = p.substring_dedup(spark, apart, sf).cache()
    want = plain.without_repeats([(r["doc_id"], r["text"]) for r in apart.collect()])
    got = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == docs.columns and set(got) == {d for d, (n, k, _) in want.items() if not n or k < n}
    assert all(len(plain.WORD.findall(got[d])) == want[d][0] - want[d][1] for d in got)
    placed = p.best_fit_packing(spark, clean, sf).collect()
    assert {r["doc_id"] for r in placed} == set(got)
    assert len(p.STAGES) == 5 and sorted(tuple(r) for r in p.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect()) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in placed)
    for frame in (known, once, apart, clean):
        frame.unpersist()


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op5_url_filter", "op7_tool_calls", "op9_topk_search"])
def test_query_matches_sql(spark, sf, name):
    from compare import compare, connect

    from skyloom.llm import ORACLES

    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) is None


def test_token_totals(spark, sf):
    """The maintained totals are those of the tidied documents that were not withdrawn."""
    import re
    from collections import Counter

    from tokenizers import Tokenizer

    from skyloom.llm.query_op1 import vocabulary

    tok, marks = Tokenizer.from_file(vocabulary()), {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs, tokens = Counter(), Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        mark = marks.get(r["doc_id"])
        if mark and mark["toxic"] == 1:
            continue
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]) if mark and mark["quality"] == 0 else r["text"]
        docs[r["source"], r["lang"]] += 1
        tokens[r["source"], r["lang"]] += len(tok.encode(text, add_special_tokens=False).ids)
    got = QUERIES["op6_token_counts"](spark, sf).collect()
    assert {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in got} == {k: (docs[k], tokens[k]) for k in docs}
