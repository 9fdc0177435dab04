"""Toxicity by a classifier chain of sparse linear models.

The categories are predicted one after another. Each model sees the telling words and stems of a document and the
probabilities of all earlier categories; for fitting, those come from models that did not see the row
(out of fold), so that later models learn from probabilities like those they get later on. Copies of one text count as one
row and stay in one fold; else a mislabelled text with many copies would teach its own words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linear import Sparse, fit_logistic, groups_of_copies, sigmoid, telling
from .runtime import pieces, small_batches, texts_of
from .samples import labelled_features, sample_of
from .words import ALNUM_FOLDED, _groups, distinct

#: Labelled rows that the chain is fitted on, at most (about; see samples.sample_of).
SAMPLE_ROWS = 6000
FOLDS = 4
#: Features are whole words and their first so many bytes.
STEMS = (4, 6)
#: A category's words are those that so many documents (copies count once) have and that are telling, with so many expected by chance.
LEAST_DOCS, CHANCE = 4.0, 0.5
#: Parts of the vocabulary (a power of two) that are counted one after another, and words that are looked up at a time.
PARTS, STEP = 8, 1 << 19


@dataclass
class Chain:
    categories: list[str]
    words: np.ndarray  # sorted hashes of the telling words
    weights: list[np.ndarray]  # of category k: words, earlier categories, intercept
    base: list[float]

    def to_dict(self) -> dict:
        bits = np.zeros(1 << 20, bool)
        bits[self.words >> np.uint64(44)] = True
        return {"words": self.words, "weights": self.weights, "bits": bits}


def word_features(texts: list[bytes]) -> list[bytes]:
    """The distinct hashes of each text's words and stems."""
    out = []
    for h, cut in _groups(texts, ALNUM_FOLDED, STEMS):
        out += [distinct(h[:, cut[i] : cut[i + 1]].ravel()).tobytes() for i in range(len(cut) - 1)]
    return out


def fit_chain(words: list[np.ndarray], marks: np.ndarray, y: np.ndarray, categories: list[str]) -> Chain:
    """Fit on rows of distinct word hashes; y has a 0/1 column for each category."""
    return fit_flat(np.array([len(w) for w in words], np.int64), np.concatenate([*words, np.empty(0, np.uint64)]), marks, y, categories)


def fit_flat(sizes: np.ndarray, every: np.ndarray, marks: np.ndarray, y: np.ndarray, categories: list[str]) -> Chain:
    """Fit on the rows' words one after another, so many of each row."""
    n = len(sizes)
    if not n:
        return Chain(categories, np.empty(0, np.uint64), [np.zeros(k + 1) - np.append(np.zeros(k), 40.0) for k in range(len(categories))], [0.0] * len(categories))
    group = groups_of_copies(marks)
    _, inverse, size = np.unique(group, return_inverse=True, return_counts=True)
    weight = 1.0 / size[inverse]
    fold = ((group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(FOLDS)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    stats = [np.empty((0, 1 + len(categories)))]
    vocabulary = [np.empty(0, np.uint64)]
    for part in range(PARTS):  # words by the upper bits of their hashes, so that little is sorted at a time
        mine = (every >> np.uint64(64 - PARTS.bit_length() + 1)) == part
        own, column = np.unique(every[mine], return_inverse=True)
        w = weight[row[mine]]
        have = np.bincount(column, w, len(own))
        often = have >= LEAST_DOCS
        vocabulary.append(own[often])
        stats.append(np.stack([have, *[np.bincount(column, w * y[row[mine], k], len(own)) for k in range(len(categories))]], 1)[often])
    vocabulary, stats = np.concatenate(vocabulary), np.concatenate(stats)
    keep = np.stack([telling(stats[:, 0], stats[:, 1 + k], weight.sum(), (weight * y[:, k]).sum(), CHANCE) for k in range(len(categories))])
    any_ = keep.any(0)
    keep, vocabulary = keep[:, any_], vocabulary[any_]
    rows, columns = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for start in range(0, len(every) if len(vocabulary) else 0, STEP):
        own = every[start : start + STEP]
        at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
        hit = vocabulary[at] == own
        rows.append(row[start : start + STEP][hit].astype(np.int64)), columns.append(at[hit])
    x = Sparse(np.concatenate(rows), np.concatenate(columns), n, len(vocabulary))
    del row, every, rows, columns
    earlier, weights, base = np.empty((n, 0)), [], []
    for k in range(len(categories)):
        own, out = x.columns(keep[k]), np.zeros(n)
        for f in range(FOLDS):
            test = fold == f
            train = ~test
            if test.any() and train.any():
                w = fit_logistic(own.rows(train), earlier[train], y[train, k], weight[train])
                part = own.rows(test)
                out[test] = sigmoid(part.dot(w[: own.n_columns]) + np.hstack([earlier[test], np.ones((int(test.sum()), 1))]) @ w[own.n_columns :])
        w = fit_logistic(own, earlier, y[:, k], weight)
        full = np.zeros(x.n_columns)
        full[keep[k]] = w[: own.n_columns]
        weights.append(np.concatenate([full, w[own.n_columns :]]))
        base.append(float((weight * y[:, k]).sum() / weight.sum()))
        earlier = np.hstack([earlier, out[:, None]])
    return Chain(categories, vocabulary, weights, base)


def _probabilities(chain: dict, texts: list[bytes]) -> np.ndarray:
    """A row of probabilities, in chain order, for each text."""
    words, bits, weights = chain["words"], chain["bits"], chain["weights"]
    found: list[np.ndarray] = []
    for h, cut in _groups(texts, ALNUM_FOLDED, STEMS):
        at, place = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for row in h if len(words) else ():
            maybe = np.flatnonzero(bits[row >> np.uint64(44)])
            where = np.minimum(np.searchsorted(words, row[maybe]), len(words) - 1)
            hit = words[where] == row[maybe]
            at.append(maybe[hit]), place.append(where[hit])
        at, place = np.concatenate(at), np.concatenate(place)
        order = np.argsort(at, kind="stable")
        at, place = at[order], place[order]
        split = np.searchsorted(at, cut)
        found += [np.unique(place[split[i] : split[i + 1]]) for i in range(len(cut) - 1)]
    out = np.zeros((len(texts), len(weights)))
    row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    column = np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)
    for k, w in enumerate(weights):
        own, after = w[: len(words)], w[len(words) :]
        out[:, k] = sigmoid(np.bincount(row, own[column], len(texts)) + out[:, :k] @ after[:-1] + after[-1])
    return out


class ToxicityChain:
    """Fits a chain on labelled documents and scores whole tables with it.

    ``categories`` names 0/1 columns of the labels in chain order; ``reject`` names the one that decides, and
    documents whose probability reaches ``limit`` are rejected. ``scores`` gives a row per document row: id,
    p_<category> of each, ``toxic`` (rejected) and ``kept``. ``clean`` gives the documents kept, columns
    unchanged. Null, empty and wordless texts score what the intercepts say (they are kept as long as the
    category is rare). Labels without a document, null ids and null labels are not learned from; without any
    label nothing is rejected. Of several labels of an id the largest count; its type may differ from that of the documents' id.
    Whole texts are scored, whatever their length; a probability equal to the limit rejects. Repeated rows score alike;
    further columns are ignored or carried; an empty table gives no rows.
    """

    def __init__(self, categories: list[str], reject: str, limit: float = 0.5, sample_rows: int = SAMPLE_ROWS):
        self.categories, self.reject, self.limit, self.sample_rows = categories, reject, limit, sample_rows

    def fit(self, docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text") -> Chain:
        chosen = sample_of(labels, id_, self.categories, self.sample_rows)
        at, marks, sizes, found = labelled_features(docs, chosen, id_, text, word_features)
        y = np.stack([chosen.column(c).to_numpy()[at] for c in self.categories], 1).astype(float).clip(0, 1) if len(at) else np.empty((0, len(self.categories)))
        return fit_flat(sizes // 8, found.view(np.uint64), marks, y, self.categories)

    def scores(self, docs: DataFrame, chain: Chain, id_: str = "doc_id", text: str = "text") -> DataFrame:
        spark = docs.sparkSession
        small_batches(spark)
        names = [f"p_{c}" for c in self.categories]
        held, limit, k = spark.sparkContext.broadcast(chain.to_dict()), self.limit, self.categories.index(self.reject)

        def run(batches):
            for batch in pieces(batches):
                p = _probabilities(held.value, texts_of(batch, "text"))
                toxic = p[:, k] >= limit
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, j]) for j in range(p.shape[1])], pa.array(toxic), pa.array(~toxic)], [id_, *names, "toxic", "kept"])

        schema = T.StructType([T.StructField(id_, docs.schema[id_].dataType), *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("toxic", T.BooleanType()), T.StructField("kept", T.BooleanType())])
        return docs.select(F.col(id_), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)

    def clean(self, docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
        spark = docs.sparkSession
        small_batches(spark)
        held, limit, k = spark.sparkContext.broadcast(chain.to_dict()), self.limit, self.categories.index(self.reject)

        def run(batches):
            for batch in pieces(batches):
                yield batch.filter(pa.array(_probabilities(held.value, texts_of(batch, text))[:, k] < limit))

        return docs.mapInArrow(run, docs.schema)


def categories_of(labels: DataFrame, quality: Column | None = None, toxic: Column | None = None) -> DataFrame:
    """The three categories that a table of quality and toxic labels gives, from broad to severe."""
    quality = F.col("quality") if quality is None else quality
    toxic = F.col("toxic") if toxic is None else toxic
    return labels.select("doc_id", (quality == 0).cast("int").alias("junk"), (toxic == 1).cast("int").alias("toxic"), ((toxic == 1) & (quality == 0)).cast("int").alias("severe"))


def standard_chain() -> ToxicityChain:
    """The chain of the query and the pipeline."""
    return ToxicityChain(["junk", "toxic", "severe"], "toxic", 0.3)
