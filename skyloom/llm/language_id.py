"""Language identification with a string kernel.

The kernel of two texts is the number of byte n-grams (one to three bytes, all
lengths blended) that both hold, over the root of the product of how many each
holds.  A Nyström map over landmark texts makes it a bounded number of features,
on which one ridge regression per language is fitted, that language against the
rest.  Since presence enters linearly, landmarks, map and regressions fold into
one weight per n-gram and language, so a batch of texts is scored by one matrix
product of its presence matrix.

Fitting reads all labelled rows for the number of different ones and keeps a
bounded sample: about ``LANDMARKS`` landmarks and ``SAMPLE`` fitting rows in all,
dealt evenly to the languages and drawn by a hash of id and text, whatever the
size of the table and the length of its texts.  Rows that are equal in both are
one row of the sample, so a repeated id or row cannot swell it, and the n-grams
of a landmark are bounded by the alphabet.
Prediction reads whole texts and nothing but texts.

The filter does not look at scores, which mean something else for every number of
languages.  It rejects a text of which too small a share of its distinct n-grams
is known: less than ``LEAST_SHARE`` of what the predicted language's own landmarks
reach, each held against all other landmarks, but for the lowest ``ODD`` of them.

Defined results
    null text, or no letter   ``und`` with score 0
    null lang                 not learned from, predicted like all others
    no labelled row           every text is ``und``; the filter then rejects only texts without a letter
    repeated rows, null ids   predicted row by row
    ties                      the language first in the alphabet
    very long texts           read whole
    extra columns             ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.words import slices

#: Landmark texts and fitting rows, about, over all languages; at least these many for each language.
LANDMARKS, SAMPLE, LEAST_LANDMARKS, LEAST_SAMPLE = 256, 4000, 8, 32
RIDGE = 0.1
UNKNOWN = "und"
LETTER = r"\p{L}"
#: Share of a language's usual known n-grams that a text has at least to pass the filter; part of the landmarks that may fall below the usual.
LEAST_SHARE, ODD = 0.8, 0.05

#: A blank for all ASCII but a-z, the letters, and the bytes of other characters: the alphabet of the n-grams.
_SIZE = 1 + 26 + 128
_ALPHABET = np.zeros(256, np.int32)
_ALPHABET[ord("a") : ord("z") + 1] = np.arange(1, 27)
_ALPHABET[128:] = np.arange(27, _SIZE)
_CODES = _SIZE**3 + _SIZE**2 + _SIZE


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """Codes of the n-grams that begin at each byte of lower-cased text, for n of 3, 2 and 1."""
    x = _ALPHABET[data]
    two = x[:-1] * _SIZE + x[1:]
    three = two[:-1] * _SIZE + x[2:]
    return [three, two + _SIZE**3, x + (_SIZE**3 + _SIZE**2)]


@dataclass
class Model:
    """Weights of the known n-grams; ``codes`` is sorted, ``weights`` has a row for each code and a column for each language.

    ``least`` is the share of known n-grams from which a language accepts a text.
    """

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    least: np.ndarray

    def table(self) -> np.ndarray:
        """Index of every possible code, the number of known codes for those not known; built once in a worker."""
        key = hash((self.codes.tobytes(), len(self.codes)))
        if key not in _TABLES:
            _TABLES.clear()
            table = np.full(_CODES, len(self.codes), np.int32)
            table[self.codes] = np.arange(len(self.codes), dtype=np.int32)
            _TABLES[key] = table
        return _TABLES[key]

    def presence(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One row of zeros and ones for each text of a slice, divided by the root of its sum, and the share of its n-grams that are known."""
        table, known = self.table(), len(self.codes)
        seen = np.zeros((len(offsets) - 1, known + 1), np.float32)
        strange = np.zeros(len(offsets) - 1)
        found = [(g, table[g]) for g in _grams(data)] if len(data) else []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            for short, (code, g) in enumerate(found):
                own = slice(a, max(a, b - 2 + short))
                seen[i, g[own]] = 1
                strange[i] += len(np.unique(code[own][g[own] == known]))
        seen = seen[:, :known]
        n = seen.sum(1)
        return seen / np.sqrt(np.maximum(n[:, None], 1)), n / np.maximum(n + strange, 1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores by language, and the share of known n-grams."""
        seen, share = self.presence(data, offsets)
        return seen @ self.weights + self.bias, share


_TABLES: dict[int, np.ndarray] = {}
#: Texts in one presence matrix.
_ROWS = 64


def _few(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for at, end, data, offsets in slices(texts):
        for a in range(0, end - at, _ROWS):
            b = min(a + _ROWS, end - at)
            yield at + a, at + b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _landmark_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, data, offsets in slices(batch.column("text")):
            sets = [np.unique(np.concatenate(_grams(data[a:b]))).astype(np.int32).tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            part = batch.slice(at, end - at)
            yield pa.record_batch([part.column("draw"), part.column("lang"), pa.array(sets, pa.binary())], names=["draw", "lang", "grams"])


def _presence_of(model: Model):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in _few(batch.column("text")):
                values = (model.presence(data, offsets)[0] @ model.weights).astype(np.float64)
                part = batch.slice(at, end - at)
                rows = pa.array([v.tobytes() for v in values], pa.binary())
                yield pa.record_batch([part.column("draw"), part.column("lang"), rows], names=["draw", "lang", "kernel"])

    return read


def _clean(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(LETTER), F.lit(False))


def fit(labelled: DataFrame, landmarks: int = LANDMARKS, sample: int = SAMPLE) -> Model | None:
    """A model of the languages in ``labelled`` (doc_id, text, lang); None if there is nothing to learn from."""
    rows = labelled.filter(has_letter(F.col("text")) & F.col("lang").isNotNull())
    rows = rows.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text", F.lit("draw")), F.lit(1 << 40)).alias("draw"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)

    def drawn(wanted: int, least: int) -> DataFrame:
        """Different rows whose draw is below what lets about as many of their language pass."""
        each = max(least, wanted // len(languages))
        limit = F.create_map(*[F.lit(x) for lang in languages for x in (lang, int((1 << 40) * min(1.0, each / max(counts[lang], 1))))])
        picked = rows.filter(F.col("draw") < limit[F.col("lang")]).dropDuplicates(["lang", "draw"])
        return picked.select("draw", "lang", _clean(F.col("text")).alias("text"))

    found = sorted(tuple(r) for r in drawn(landmarks, LEAST_LANDMARKS).mapInArrow(_landmark_grams, "draw long, lang string, grams binary").collect())
    sets = [np.frombuffer(grams, np.int32) for _, _, grams in found]
    if not sets:
        return None
    codes, holders = np.unique(np.concatenate(sets), return_counts=True)
    spectrum = np.zeros((len(codes), len(sets)))
    for i, own in enumerate(sets):
        spectrum[np.searchsorted(codes, own), i] = 1 / np.sqrt(len(own))
    elsewhere = np.array([(holders[np.searchsorted(codes, own)] > 1).mean() for own in sets])
    spoken = np.array([lang for _, lang, _ in found])
    least = np.array([LEAST_SHARE * np.quantile(elsewhere[spoken == lang], ODD) if (spoken == lang).any() else 0.0 for lang in languages])
    values, vectors = np.linalg.eigh(spectrum.T @ spectrum)
    good = values > 1e-9 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    # the kernel values with all landmarks, mapped, are the features
    features = Model(languages, codes, (spectrum @ root).astype(np.float32), np.zeros(root.shape[1]), least)
    got = sorted(tuple(r) for r in drawn(sample, LEAST_SAMPLE).mapInArrow(_presence_of(features), "draw long, lang string, kernel binary").collect())
    x = np.stack([np.frombuffer(k, np.float64) for _, _, k in got])
    y = np.where(np.array([lang for _, lang, _ in got])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    middle, level = x.mean(0), y.mean(0)
    solved = np.linalg.solve((x - middle).T @ (x - middle) + RIDGE * np.eye(x.shape[1]), (x - middle).T @ (y - level))
    return Model(languages, codes, (features.weights @ solved).astype(np.float32), level - middle @ solved, least)


def _predicted(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages)
        for batch in batches:
            for at, end, data, offsets in _few(batch.column("read")):
                part = batch.slice(at, end - at)
                scores, share = model.scores(data, offsets)
                best = scores.argmax(1)
                top = np.clip((scores[np.arange(len(best)), best] + 1) / 2, 0, 1)
                known = part.column("known").to_numpy(zero_copy_only=False)
                rest = {c: part.column(c) for c in batch.schema.names if c not in ("read", "known")}
                rest["lang_pred"] = pa.array(np.where(known, names[best], UNKNOWN).tolist(), pa.string())
                rest["score"] = pa.array(np.where(known, top, 0.0))
                rest["accepted"] = pa.array(known & (share >= model.least[best]))
                yield pa.record_batch(list(rest.values()), names=list(rest))

    return predict


def predict(texts: DataFrame, model: Model | None) -> DataFrame:
    """``texts`` (doc_id and text) with lang_pred and score, without the text."""
    if model is None:
        return texts.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = texts.select("doc_id", _clean(F.col("text")).alias("read"), has_letter(F.col("text")).alias("known"))
    return rows.mapInArrow(_predicted(model), "doc_id long, lang_pred string, score double, accepted boolean").drop("accepted")


def held_out() -> Column:
    """True for the rows that no model may learn from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows that are not held out."""
    model = fit(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def drop_unknown(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text some language accepts, with all their columns.

    Rejected are texts without a letter and texts that hold too many n-grams
    which no landmark has.  Where nothing is labelled no n-gram counts as strange.
    """
    model = fit(docs.filter(~held_out()))
    if model is None:
        return docs.filter(has_letter(F.col("text")))
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*rest, _clean(F.col("text")).alias("read"), has_letter(F.col("text")).alias("known"))
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    kept = rows.mapInArrow(_predicted(model), schema).filter("accepted")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
