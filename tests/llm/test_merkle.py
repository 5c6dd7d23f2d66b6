"""The Merkle manifest against plain Python."""

import hashlib
import string
import zlib

from skyloom.llm.merkle import FAN, Forest, Manifest, append_log, height, node_digest, position

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(leaves):
    """All levels of a tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain(rows):
    """One result tuple for each (doc_id, source, lang, n_chars, text) row."""
    sources = {}
    for row in rows:
        sources.setdefault((row[1] is not None, (row[1] or "").encode()), []).append(row)
    keys = sorted(sources)
    trees, order = {}, {}
    for k in keys:
        order[k] = sorted(sources[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[k] = tree([leaf(*r) for r in order[k]])
    top = tree([trees[k][-1][0] for k in keys])
    out = []
    for place, k in enumerate(keys):
        for i, row in enumerate(order[k]):
            path, digest = [], leaf(*row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                digest = leaf(*row[:4], None if row[4] is None else row[4].translate(LOWER))
            for levels, at in ((trees[k], i), (top, place)):
                for level in levels[:-1]:
                    run = level[at // 16 * 16 : at // 16 * 16 + 16]
                    path += run[: at % 16] + run[at % 16 + 1 :]
                    digest = sha("".join(run[: at % 16]) + digest + "".join(run[at % 16 + 1 :]))
                    at //= 16
            out.append((row[0], leaf(*row), trees[k][-1][0], top[-1][0], sha("".join(path)), digest, digest == top[-1][0]))
    return sorted(out, key=str)


def checked(spark, rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.withColumns({"leaf": F.lit(1), "tree": F.lit("x"), "place": F.lit(0)})  # names that the operator uses itself
    altered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return sorted(map(tuple, Manifest(docs, F.when(altered, lowered).otherwise(F.col("text"))).checked().collect()), key=str)


def test_positions():
    for leaves in (1, 2, 15, 16, 17, 255, 256, 257, 4096, 5000):
        log = append_log([str(i) for i in range(leaves)], height(leaves))
        levels, places = [[str(i) for i in range(leaves)]], []
        for level in range(height(leaves) + 1):
            for i, digest in enumerate(levels[-1]):
                places.append(position(level, i, leaves))
                assert log[places[-1]] == digest
            levels.append([node_digest("".join(levels[-1][i : i + FAN])) for i in range(0, len(levels[-1]), FAN)])
        assert sorted(places) == list(range(len(log)))


def test_odd_rows(spark):
    """Nulls everywhere, repeated ids and rows, empty and long texts, sources of one row, not ASCII."""
    rows = [(i, ["a", "b", None, "Zé", ""][i % 5], None if i % 7 else "en", i if i % 3 else None, f"Text {i} É") for i in range(300)]
    rows += [(None, "a", None, None, None), (None, "a", None, None, None), (7, None, None, None, ""), (7, None, None, None, ""), (8, "one", "en", 3, "ABC"), (9, "long", "en", 3, "Wörd " * 200_000)]
    got = checked(spark, rows)
    assert got == plain(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_several_rounds(spark):
    """A source beyond one builder, and more sources than a run has."""
    rows = [(i, "hot", "en", i, f"T{i}") for i in range(4500)] + [(i, f"s{i}", "en", i, f"T{i}") for i in range(40)]
    assert checked(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert checked(spark, []) == []


def test_whole_log(spark):
    """The log's positions are gapless and hold every level of every tree."""
    from pyspark.sql import functions as F

    leaves = spark.range(4200).select(F.lit("t").alias("tree"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"), "id")
    rows = Forest(leaves, ["id"]).log().orderBy("position").collect()
    want = tree([sha(str(i)) for i in range(4200)])
    assert [r["position"] for r in rows] == list(range(sum(map(len, want))))
    assert {(r["level"], r["index"]): r["digest"] for r in rows} == {(k, i): d for k, level in enumerate(want) for i, d in enumerate(level)}
