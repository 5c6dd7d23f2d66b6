"""Token counts as rollups that signed deltas maintain.

A change of the corpus is an insert, a delete or a revised count of one
document.  Changes become signed numbers, are added up per key before anything
is shuffled, and are committed as one batch under an identifier.

A commit writes its deltas to a folder of their own and then publishes them by
one small file, renamed into place, that names batch and folder.  Readers see a
batch as it was or as it is, never half of it, and a commit that failed leaves
nothing behind that counts.  Of several commits of a batch the last one counts,
so a retry changes nothing.  ``fold`` adds the committed batches up into a table
of totals; ``totals`` reads that table and the batches committed since, and
takes back what a folded batch said where the batch was committed again.

Defined results
    null text            zero tokens, counted as a document
    null source or lang  keys of their own
    repeated rows        each row counts; changes compare sums of equal doc_ids
    deletes of what is not there   taken as they are: changes are not looked up, so counts may fall below zero
    empty table, empty batch       no rows, no change
    extra columns        ignored
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.tokens import encoder, special_tokens
from skyloom.llm.words import slices

KEYS = ["source", "lang", "tokenizer"]
_COUNTS = "doc_id long, source string, lang string, n_tokens long"
_DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"


def _counted(path: str):
    special = special_tokens(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, special).encode
        for batch in batches:
            for at, end, _, _ in slices(batch.column("text")):
                part = batch.slice(at, end - at)
                total, _ = encode(part.column("text"))
                yield pa.record_batch([*(part.column(c) for c in ("doc_id", "source", "lang")), pa.array(total)], names=["doc_id", "source", "lang", "n_tokens"])

    return count


def token_counts(docs: DataFrame, path: str, version: str) -> DataFrame:
    """doc_id, source, lang, tokenizer and n_tokens of every row."""
    return docs.select("doc_id", "source", "lang", "text").mapInArrow(_counted(path), _COUNTS).withColumn("tokenizer", F.lit(version))


def inserted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).alias("docs"), F.col("n_tokens").alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).alias("docs"), (-F.col("n_tokens")).alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Takes the old counts of the revised documents back and puts the new ones in their place."""
    return deleted(old).unionByName(inserted(new))


class Rollup:
    """Additive totals in a folder that all executors share: ``data`` holds deltas, ``log`` what was published, in order."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _files(self):
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(conf), path

    def _names(self) -> list[str]:
        """The log's entries in order, as number, kind and a random part."""
        files, path = self._files()
        log = path(f"{self.path}/log")
        names = [s.getPath().getName() for s in files.listStatus(log)] if files.exists(log) else []
        return sorted(n for n in names if not n.startswith("."))

    def _published(self) -> list[dict]:
        """The records from the last fold on, oldest first."""
        names = self._names()
        last = max((i for i, n in enumerate(names) if n.split("-")[1] == "fold"), default=0)
        if not names:
            return []
        read = self.spark.read.text([f"{self.path}/log/{n}" for n in names[last:]], wholetext=True)
        rows = read.select("value", F.col("_metadata.file_name").alias("name")).collect()
        return [json.loads(r["value"]) for r in sorted(rows, key=lambda r: r["name"])]

    def _publish(self, kind: str, record: dict) -> None:
        """Write a record under a hidden name and rename it to the next place of the log."""
        files, path = self._files()
        files.mkdirs(path(f"{self.path}/log"))
        name = f"{len(self._names()) + 1:012d}-{kind}-{uuid.uuid4().hex}"
        hidden = path(f"{self.path}/log/.{name}")
        out = files.create(hidden)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        if not files.rename(hidden, path(f"{self.path}/log/{name}")):
            raise OSError(f"could not publish {name}")

    def _written(self, deltas: DataFrame) -> str:
        folder = uuid.uuid4().hex
        deltas.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Add a batch of signed changes; the same batch again takes the place of what it said before."""
        deltas = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        self._publish("batch", {"batch": batch, "folder": self._written(deltas)})

    def _state(self) -> tuple[str | None, dict[str, str], list[str], list[str]]:
        """The folded table, what it holds by batch, the folders to add to it, and those to take back."""
        fold, held, current = None, {}, {}
        for record in self._published():
            if "fold" in record:
                fold, held = record["fold"], record["held"]
            else:
                current[record["batch"]] = record["folder"]
        add = [f for b, f in current.items() if held.get(b) != f]
        back = [f for b, f in held.items() if current.get(b, f) != f]
        return fold, held | current, add, back

    def _sum(self, fold: str | None, add: list[str], back: list[str]) -> DataFrame:
        def read(folders: list[str]) -> DataFrame:
            paths = [f"{self.path}/data/{f}" for f in folders]
            return self.spark.read.schema(_DELTAS).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTAS)

        taken = read(back).withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")})
        rows = read([*([fold] if fold else []), *add]).unionByName(taken)
        total = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return total.filter("docs <> 0 or tokens <> 0")

    def fold(self) -> None:
        """Add up what is committed, so that later readers start from there."""
        fold, held, add, back = self._state()
        if add or back:
            self._publish("fold", {"fold": self._written(self._sum(fold, add, back)), "held": held})

    def totals(self) -> DataFrame:
        """docs and tokens of every key; keys that come to nothing are left out."""
        fold, _, add, back = self._state()
        return self._sum(fold, add, back)
