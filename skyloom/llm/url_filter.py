"""URL rules through a blocked Bloom filter and an exact hash join.

A rule lists a host and the beginning of a path with a verdict.  It fits a
canonical URL if the URL's host is the rule's or lies below it and the path
begins with the rule's, so the keys a URL can hit are its host and the host's
parents, each with the beginnings of its path that are as long as some rule's.
A blocked Bloom filter of the listed keys, one word of 64 bits for each block,
lets few keys pass that are not listed; those that pass are joined with the
rules by equality, which removes the false ones.  The longest rule wins.  Where
no rule fits, the verdict is the filter's own: a URL that no list names is
allowed.

The filter's size is a parameter, and so is the number of rules that make it
useful; larger lists only let more keys through to the join, which is exact.

Defined results
    null url, or no ``://``   empty host and path, no rule
    equal rules               the blocking one
    equally long rules        the one with the longer host
    repeated rows, null ids   judged row by row
    very long urls            read whole; keys are made only for lengths that rules have
    extra columns             ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.rows import bounded
from skyloom.llm.words import mixed
from skyloom.session import materialise

ALLOW, BLOCK = "allow", "block"
#: Blocks of the filter, each a 64-bit word: half a megabyte, which every task gets.  Bits set for a key.
BLOCKS, BITS = 1 << 16, 4


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z as a-z; empty if there is none."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block and bit mask of each 64-bit key."""
    again = mixed(keys)
    mask = np.zeros(len(keys), np.uint64)
    for i in range(BITS):
        mask |= np.uint64(1) << ((again >> np.uint64(6 * i)) & np.uint64(63))
    return (mixed(again ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(BLOCKS)).astype(np.int64), mask


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        block, mask = _bits(batch.column("key").to_numpy().view(np.uint64))
        yield pa.record_batch([pa.array(block), pa.array(mask.view(np.int64))], names=["block", "mask"])


def bloom(keys: DataFrame) -> np.ndarray:
    """The filter's words; what comes to the driver is one word for each block at most."""
    words = np.zeros(BLOCKS, np.uint64)
    rows = keys.mapInArrow(_blocks_of, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).collect()
    for r in rows:
        words[r["block"]] = np.uint64(r["mask"] & (2**64 - 1))
    return words


def _possible(words: np.ndarray):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, mask = _bits(batch.column("key").to_numpy().view(np.uint64))
            yield batch.filter(pa.array((words[block] & mask) == mask))

    return keep


def _key(host: str, path: str) -> Column:
    return F.xxhash64(host, path)


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; ``rules`` has host, path and verdict."""
    urls = materialise(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "urls")
    listed = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block comes after allow
    listed = materialise(listed, "rules")
    words = bloom(listed.select(_key("host", "path").alias("key")))
    # lengths of paths in the rules: no more than a URL has characters
    lengths = [r["n"] for r in listed.select(F.length("path").alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(ALLOW).alias("verdict"))

    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    named = urls.groupBy("host", "path").agg(F.lit(1).alias("one")).select("host", "path")
    hosts = named.select("host", "path", F.explode(parents).alias("rule_host"), fitting.alias("lengths"))
    keys = hosts.select("host", "path", "rule_host", F.explode("lengths").alias("n"))
    keys = keys.withColumn("rule_path", F.substring("path", F.lit(1), F.col("n"))).withColumn("key", _key("rule_host", "rule_path"))
    keys = keys.select("host", "path", "rule_host", "rule_path", "key")
    possible = keys.mapInArrow(_possible(words), keys.schema)
    exact = listed.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    small = bounded(exact)
    hits = possible.join(exact.hint("shuffle_hash") if small is exact else small, ["rule_host", "rule_path"])
    length = F.length("rule_host") + F.length("rule_path")
    found = F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    best = hits.groupBy("host", "path").agg(F.max_by(found, F.struct(length, F.length("rule_host"))).alias("best"))
    ruled = urls.join(materialise(best, "ruled"), ["host", "path"], "left")
    return ruled.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(ALLOW)).alias("verdict"))
