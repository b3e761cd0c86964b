"""Quality classifier by compression (operator 9).

Two zstandard dictionaries are trained, one from good and one from bad labelled texts. A text is compressed with both,
in chunks of some kilobytes (in a longer chunk the text itself takes the dictionary's place). The difference of the
sizes is normalised by their sum and by the text's size; the compressed share of the text tells how much such a
difference means (a text of one repeated word hardly differs). Logistic regression of these on labelled texts that the
dictionaries haven't seen calibrates the score.

Training takes bounded samples (``Bounds``) in order of a hash of the ids; scoring maps over whole texts, no shuffle.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, unpacked, whole_row, with_id


@dataclass(frozen=True)
class Bounds:
    """What training reads at most, and sizes."""

    rows: int = 3_000  #: labelled rows of each class for the dictionaries, and twice as many for calibration
    pieces: int = 8  #: of a text that dictionaries are trained on, evenly spread over it; calibration reads whole texts
    piece_chars: int = 2_048
    dictionary_bytes: int = 112 << 10
    chunk_bytes: int = 2_048
    level: int = 3


@dataclass(frozen=True)
class Model:
    bad: bytes
    good: bytes
    weights: tuple[float, ...]
    bounds: Bounds

    def compressors(self):
        found = []
        for d in (self.bad, self.good):
            own = zstandard.ZstdCompressionDict(d) if d else None
            if own:
                own.precompute_compress(level=self.bounds.level)
            found.append(zstandard.ZstdCompressor(level=self.bounds.level, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
        return found

    def features(self, compressors, text: bytes) -> tuple[float, float, float]:
        """Difference over sum, sum over text, difference over text; zeros for an empty text."""
        sizes = [0, 0]
        for at in range(0, len(text), self.bounds.chunk_bytes):
            chunk = text[at : at + self.bounds.chunk_bytes]
            for k, c in enumerate(compressors):
                sizes[k] += len(c.compress(chunk))
        difference, total, n = sizes[0] - sizes[1], sum(sizes), max(1, len(text))
        return difference / max(1, total), min(1.0, total / 2 / n), difference / n


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _logit(weights, x: np.ndarray) -> np.ndarray:
    return weights[0] + x @ np.array(weights[1:])


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's steps, slightly ridged; without both classes the smoothed share of good ones."""
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return float(np.log(share / (1 - share))), 0.0, 0.0, 0.0
    rows, w, ridge = np.c_[np.ones(len(x)), x], np.zeros(4), np.diag([1e-6, 1e-3, 1e-3, 1e-3])
    for _ in range(60):
        p = _sigmoid(rows @ w)
        v = p * (1 - p) + 1e-9
        w = w + np.linalg.solve(rows.T @ (rows * v[:, None]) + ridge, rows.T @ (y - p) - ridge @ w)
    return tuple(map(float, w))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: they themselves are the content
        return b"".join(samples)[-size:]


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", bounds: Bounds = Bounds()) -> Model:
    """Learns from labelled rows only: fold 0 for dictionaries, fold 2 for calibration, where a row's fold is CRC-32 of its
    id's text modulo 3; fold 1 is held out. Dictionaries are cut from pieces of their texts (see Bounds); calibration compresses
    whole texts, on the executors, as scoring does. Labels other than 0 and 1 and null ids are ignored; an id labelled twice
    counts once (label 1 first). Null and empty texts count as texts of no size; repeated rows count each; texts may be of any
    length. Other columns are left out, whatever their names. Without labelled rows all scores are 0.5."""
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label"))
    marked = marked.withColumn("__fold", F.crc32(F.col("__id").cast("string")) % 3)
    order = [F.xxhash64("__id"), F.col("__id")]
    part = [marked.filter((F.col("__fold") == 0) & (F.col("__label") == k)).orderBy(*order).limit(bounds.rows) for k in (0, 1)]
    part.append(marked.filter(F.col("__fold") == 2).orderBy(*order).limit(2 * bounds.rows))
    text = F.col("text")
    n = F.least(F.lit(bounds.pieces), F.ceil(F.length(text) / bounds.piece_chars)).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.substring(text, (k * F.length(text) / F.greatest(n, F.lit(1))).cast("int") + 1, F.lit(bounds.piece_chars)))
    learned = docs.join(F.broadcast(part[0].unionByName(part[1])), F.col("id") == F.col("__id"))  # 2 * bounds.rows ids at most
    rows = sorted(learned.select("__id", F.col("__label").alias("label"), spread.alias("pieces")).collect(), key=lambda r: (str(r["__id"]), r["pieces"]))
    training = {k: [p.encode() for r in rows if r["label"] == k for p in r["pieces"]] for k in (0, 1)}
    for samples in training.values():  # the training is sensitive to order: shuffle, but always alike
        samples.sort(key=zlib.crc32)
    model = Model(_dictionary(training[0], bounds.dictionary_bytes), _dictionary(training[1], bounds.dictionary_bytes), (0.0,) * 4, bounds)
    found = _calibration(docs, part[2], model)
    if not found:  # no row in that fold: those of the dictionaries have to do
        found = _calibration(docs, part[0].unionByName(part[1]), model)
    x, y = np.array([r[1:] for r in found], float).reshape(-1, 3), np.array([r[0] for r in found], float)
    return Model(model.bad, model.good, _fit(x, y), bounds)


def _calibration(docs: DataFrame, sample: DataFrame, model: Model) -> list[tuple]:
    """(label, features of the whole text) of the sample's rows, three numbers each, in a fixed order."""
    rows = docs.join(F.broadcast(sample), F.col("id") == F.col("__id"))  # 2 * bounds.rows ids at most
    held = docs.sparkSession.sparkContext.broadcast((model.bad, model.good))
    w, bounds = model.weights, model.bounds

    def run(batches):
        own = Model(*held.value, w, bounds)
        c = own.compressors()
        for b in batches:
            x = np.array([own.features(c, t) for t in b.column(1).cast(pa.binary()).to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[:, k]) for k in range(3)]], names=["label", "a", "b", "c"])

    return sorted(map(tuple, rows.select(F.col("__label").cast("int").alias("label"), "text").mapInArrow(run, "label int, a double, b double, c double").collect()))


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, score) of whole texts; null counts as empty, and an empty text gets the score of no difference. One row per
    row, repeated or null ids too; an empty table gives none. Texts may be of any length. ``id_col`` may be a struct that
    carries other columns; the others are left out, whatever their names."""
    held = docs.sparkSession.sparkContext.broadcast((model.bad, model.good))
    w, bounds = model.weights, model.bounds

    def run(batches):
        own = Model(*held.value, w, bounds)
        c = own.compressors()
        for b in batches:
            x = np.array([own.features(c, t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_sigmoid(_logit(w, x)), pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, with_id(docs, id_col, "score double"))


def keep_good(docs: DataFrame, model: Model, text_col="text", threshold=0.5) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` at least, with all their columns, whatever their names. Nulls, empty and
    long texts, repeated rows and empty tables are as score says."""
    rows = docs.select(whole_row(docs), F.col(text_col).alias("text"))
    return unpacked(score(rows, model, "row", "text").filter(F.col("score") >= threshold), docs.columns, "id")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
