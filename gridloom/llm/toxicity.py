"""Toxicity by a chain of linear classifiers (operator 6).

Categories are predicted one after the other; each logistic model sees the features of the text and the probabilities
of the categories before it. Those are out-of-fold in training, so that a later model learns from predictions as good as
the ones that it will get; for each fold the features are chosen anew. Features are counts of words and of the starts of words (for languages that compound),
absolute and per word; those that don't go with any category in the sample are left out.

Training takes a bounded sample of labelled rows (``ROWS``), in order of a hash of their ids, whose texts are reduced to
counts on the executors; scoring maps over whole texts, no shuffle.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .decontaminate import split_words

ROWS = 9_000
MIN_ROWS = 4  # a feature must be in as many rows of the sample
KEPT = 256  # features of a model at most: of those found in the bounded sample; a parameter of ``train``
STARTS = (4, 5, 6, 7, 8)  # bytes of a word
FOLDS, HELD = 3, 10
#: Words by which the query's weak categories are told apart among rows labelled toxic.
INSULTS = ("idiot", "moron", "clown", "loser", "stupid", "fool", "dumb")
CONTEMPT = ("trash", "scum", "worthless", "pathetic", "disgusting", "garbage", "vermin")


def features_of(word: bytes) -> list[bytes]:
    return [b"=" + word, *[word[:k] for k in STARTS if len(word) > k]]


def distinct_features(words) -> set[bytes]:
    return {f for w in words for f in features_of(w)}


def feature_counts(words: dict[bytes, int], at: dict[bytes, int], known: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(places of a row's features, how often it has them); ``known`` holds the places of words seen before."""
    own: Counter = Counter()
    for w, k in words.items():
        ids = known.get(w)
        if ids is None:
            ids = known[w] = [at[f] for f in features_of(w) if f in at]
        for j in ids:
            own[j] += k
    return np.fromiter(own.keys(), np.int32, len(own)), np.fromiter(own.values(), np.int32, len(own))


def counts(text: bytes) -> tuple[Counter, int]:
    words = split_words(text)
    return Counter(words), len(words)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights with the intercept last, by damped Newton steps; a class that is missing gives its smoothed prior."""
    n, m = x.shape
    w = np.zeros(m + 1)
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if len(set(y.tolist())) < 2:
        return w
    x1 = np.c_[x, np.ones(n)]
    penalty = np.r_[np.full(m, ridge), 1e-6]

    def loss(w):
        z = x1 @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * w * w).sum()

    now = loss(w)
    for _ in range(30):
        p = _sigmoid(x1 @ w)
        step = np.linalg.solve(x1.T @ (x1 * (p * (1 - p) + 1e-9)[:, None]) + np.diag(penalty), x1.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-5 * abs(before):
            break
    return w


class Chain:
    def __init__(self, categories, vocabulary: dict[bytes, int], weights: list[np.ndarray]):
        self.categories, self.vocabulary, self.weights = categories, vocabulary, weights

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        for w in self.weights:
            x = np.c_[x, _sigmoid(x @ w[:-1] + w[-1])]
        return x[:, x.shape[1] - len(self.weights) :]


def rows_to_matrix(rows: list[tuple[dict, int]], vocabulary: dict[bytes, int], known: dict[bytes, list[int]]) -> np.ndarray:
    """log(1 + count) and log(1 + 200 count / words) of each feature."""
    m = len(vocabulary)
    x = np.zeros((len(rows), 2 * m))
    for i, (words, n) in enumerate(rows):
        row = x[i]
        for w, k in words.items():
            ids = known.get(w)
            if ids is None:
                ids = known[w] = [vocabulary[f] for f in features_of(w) if f in vocabulary]
            for j in ids:
                row[j] += k
        row[m:] = np.log1p(row[:m] * (200 / max(1, n)))
        np.log1p(row[:m], out=row[:m])
    return x


class Features:
    """Features of the sample's rows, as far as enough rows with a category have them (the others speak against all of them): which
    row has which how often, and each row's number of words."""

    def __init__(self, names: list[bytes], rows: list[tuple[np.ndarray, np.ndarray, int]], labels: np.ndarray):
        """``rows``: places in ``names``, counts, words."""
        self.names, self.labels, self.marked = names, labels, labels.any(1)
        join = lambda k, kind: np.concatenate([np.empty(0, kind), *(r[k] for r in rows)]).astype(kind)
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
        self.feature, self.count = join(0, np.int32), join(1, np.float32)
        self.words = np.array([max(1, r[2]) for r in rows], float)

    @classmethod
    def of(cls, rows: list[tuple[dict, int]], labels: np.ndarray) -> Features:
        first: Counter = Counter()
        for (words, _), hit in zip(rows, labels.any(1)):
            if hit:
                first.update(distinct_features(words))
        names = sorted(f for f, k in first.items() if k >= MIN_ROWS)
        at, known = {f: k for k, f in enumerate(names)}, {}
        return cls(names, [(*feature_counts(words, at, known), n) for words, n in rows], labels)

    def choose(self, inside: np.ndarray, kept: int) -> np.ndarray:
        """The ``kept`` features at most that, in the rows ``inside``, go most clearly with a category."""
        here = inside[self.row]
        row, feature, m = self.row[here], self.feature[here], len(self.names)
        labels, total = self.labels[inside], max(1, int(inside.sum()))
        size = labels.sum(0)
        with_it = np.array([np.bincount(feature, self.labels[row, k], m) for k in range(self.labels.shape[1])]).reshape(self.labels.shape[1], m).T
        share = np.bincount(feature, minlength=m)[:, None] / total
        z = np.abs(with_it - share * size) / np.sqrt(np.maximum(1e-9, share * (1 - share) * size * (1 - size / total)) + 0.3)
        best = np.where(np.bincount(feature, self.marked[row].astype(float), m) >= MIN_ROWS, z.max(1, initial=0), 0)
        return np.array(sorted(np.flatnonzero(best > 3.5).tolist(), key=lambda i: (-best[i], self.names[i]))[:kept], np.int64)

    def matrix(self, chosen: np.ndarray) -> np.ndarray:
        """As rows_to_matrix, of all rows."""
        m, column = len(chosen), np.full(len(self.names), -1)
        column[chosen] = np.arange(m)
        here = column[self.feature] >= 0 if len(self.feature) else np.empty(0, bool)
        x = np.zeros((len(self.words), 2 * m))
        x[self.row[here], column[self.feature[here]]] = self.count[here]
        x[:, m:] = np.log1p(x[:, :m] * (200 / self.words)[:, None])
        x[:, :m] = np.log1p(x[:, :m])
        return x


def train_chain(rows: list[tuple[dict, int]], labels: np.ndarray, folds: np.ndarray, categories, kept: int = KEPT) -> Chain:
    """The models of the chain, from (counts of words, words) of each row."""
    return fit_chain(Features.of(rows, labels), folds, categories, kept)


def fit_chain(found: Features, folds: np.ndarray, categories, kept: int = KEPT) -> Chain:
    """The models of the chain. Out-of-fold probabilities come from models whose features, too, were chosen without the fold. One
    matrix, of all rows of the sample and twice ``kept`` columns, is held at a time."""
    labels, n = found.labels, len(found.words)
    chosen, parts = found.choose(np.ones(n, bool), kept), []
    for f in range(FOLDS):
        rest = folds != f if (folds != f).any() else np.ones(n, bool)
        parts.append((rest, folds == f, found.choose(rest, kept)))
    weights, before = [], np.empty((n, 0))  # out-of-fold probabilities of the categories so far
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        weights.append(_fit(np.c_[found.matrix(chosen), before], y))
        out_of_fold = np.zeros(len(y))
        for rest, here, own in parts:
            own = np.c_[found.matrix(own), before]
            w = _fit(own[rest], y[rest])
            out_of_fold[here] = _sigmoid(own[here] @ w[:-1] + w[-1])
        before = np.c_[before, out_of_fold]
    return Chain(list(categories), {found.names[i]: k for k, i in enumerate(chosen)}, weights)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col="doc_id", text_col="text", kept: int = KEPT) -> Chain:
    """Learns from at most ROWS labelled rows, of which a third at most have a category. ``labels`` has the id and one 0/1 column
    per category, in the order of the chain, the overall one last; rows with a null in it or a null id are left out, other nulls
    count as 0, repeated ids count once (1 first). Null texts have no words; texts may be of any
    length; other columns of ``docs`` are left out, whatever their names. Without labelled rows all probabilities are a half."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = [F.max(F.coalesce(F.col(c), F.lit(0)).cast("int")).alias(f"__{c}") for c in categories]
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(categories[-1]).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(*marks)
    order = [F.xxhash64("__id"), F.col("__id")]
    some = reduce(lambda a, b: a | b, [F.col(f"__{c}") > 0 for c in categories])
    sample = marked.filter(some).orderBy(*order).limit(ROWS // 3).unionByName(marked.filter(~some).orderBy(*order).limit(ROWS - ROWS // 3))
    rows = docs.join(F.broadcast(sample), F.col("id") == F.col("__id")).select(F.xxhash64("__id").alias("h"), "text", *[F.col(f"__{c}").alias(c) for c in categories])

    rows = written(rows, "sample")  # ROWS at most
    texts = lambda b: [counts(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]

    def first(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([f for words, _ in texts(b) for f in distinct_features(words)], pa.binary())], names=["f"])

    marked = rows.filter(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in categories]))
    names = marked.mapInArrow(first, "f binary").groupBy("f").count().filter(F.col("count") >= MIN_ROWS)
    names = sorted(bytes(r["f"]) for r in names.select("f").collect())  # those that MIN_ROWS of ROWS / 3 texts share
    held = docs.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def reduce_texts(batches):
        known: dict[bytes, list[int]] = {}
        for b in batches:
            found = [(*feature_counts(words, held.value, known), n) for words, n in texts(b)]
            columns = [pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary()), pa.array([f[2] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, *[b.column(k) for k in range(2, b.num_columns)]], names=["__h", "__ids", "__counts", "__n", *categories])

    got = rows.mapInArrow(reduce_texts, "__h long, __ids binary, __counts binary, __n long, " + ", ".join(f"{c} int" for c in categories)).collect()
    got.sort(key=lambda r: (r["__h"], bytes(r["__ids"])))
    y = np.array([[r[c] for c in categories] for r in got], float).reshape(len(got), len(categories))
    own = [(np.frombuffer(r["__ids"], np.int32), np.frombuffer(r["__counts"], np.int32), r["__n"]) for r in got]
    return fit_chain(Features(names, own, y), np.array([r["__h"] % FOLDS for r in got]), categories, kept)


def score(docs: DataFrame, chain: Chain, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, one probability per category) of whole texts, of any length. Null and empty texts get the probabilities of no
    words; ids may be null or repeated, repeated rows give the same; an empty table gives no rows. Other columns are left
    out, whatever their names."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast((chain.categories, chain.vocabulary, chain.weights))

    def run(batches):
        categories, vocabulary, weights = held.value
        own, known = Chain(categories, vocabulary, weights), {}
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for at in range(0, len(texts), 500):
                part = texts[at : at + 500]
                if len(known) > 1 << 20:
                    known.clear()
                p = own.probabilities(rows_to_matrix([counts(t) for t in part], vocabulary, known))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), *[pa.array(p[:, k]) for k in range(len(categories))]], names=["id", *categories])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} double" for c in chain.categories))


def weak_categories(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> DataFrame:
    """At most ROWS labels, those with the least hashes of each kind, with columns insult and contempt: rows labelled toxic
    whose text has such a word."""

    def has(words) -> Column:
        return F.lower(F.coalesce(F.col(text_col), F.lit(""))).rlike(r"\b(" + "|".join(words) + r")\b").cast("int")

    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("toxic"))
    order = [F.xxhash64(id_col), F.col(id_col)]
    some = marked.filter("toxic = 1").orderBy(*order).limit(ROWS // 3)
    marked = some.unionByName(marked.filter("toxic = 0").orderBy(*order).limit(ROWS - ROWS // 3))
    docs = docs.select(id_col, text_col)
    found = docs.join(F.broadcast(some.select(F.col(id_col).alias("__id"))), F.col(id_col) == F.col("__id"), "left_semi")  # ROWS / 3 ids
    found = found.groupBy(id_col).agg(F.max(has(INSULTS)).alias("insult"), F.max(has(CONTEMPT)).alias("contempt"))
    return marked.join(found, id_col, "left").select(id_col, F.coalesce("insult", F.lit(0)).alias("insult"), F.coalesce("contempt", F.lit(0)).alias("contempt"), "toxic")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Rows whose crc32(doc_id as text) mod HELD is HELD - 1 are held out: the chain learns nothing from them."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % HELD == HELD - 1, F.lit(False))
    found = score(docs, train(docs, weak_categories(docs, labels.filter(~held_out("doc_id"))), ["insult", "contempt", "toxic"]))
    return found.select(F.col("id").alias("doc_id"), "insult", "contempt", F.col("toxic").alias("score"), (F.col("toxic") >= 0.5).alias("toxic"), held_out("id").alias("held_out"))
