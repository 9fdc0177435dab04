"""Language identification by prediction by partial matching.

Each language has context trees over bytes of orders 0 to ``ORDER``. A byte's probability is that of the
longest context seen in the language: n / (N + q) for a byte seen n times there (N bytes, q different ones
followed the context), else the escape q / (N + q) times the probability under the next shorter context; below
order 0 all bytes are equally likely. The statistics are frozen after learning, so a text's code length under
a language is an exact sum over its bytes, and the language with the shortest code is predicted.

For scoring, all languages share one table for each order: a gram's row has its log-probability under every
language, and a context's row the logs of its escapes, so one look-up of a gram serves all languages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import pieces, small_batches, texts_of

ORDER = 4
#: Bytes of text that a language is learned from, and all languages together, at most (about).
LEARN_BYTES, LEARN_TOTAL = 1 << 20, 1 << 25
#: Languages that can be learned at a time; more are refused.
MOST_LANGUAGES = LEARN_TOTAL >> 12
#: Longer texts (bytes) are cut into spans of so many characters, which are chosen one by one.
LEARN_LONGEST, LEARN_SPAN = 1 << 17, 1 << 14
#: Bytes that are scored at a time.
PIECE = 1 << 17
_START = b"\n" * ORDER
_SIEVE = 1 << 30
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _grams(raw: np.ndarray) -> np.ndarray:
    """At each byte, it and the ORDER bytes before it (the nearest in the low bits after it); zeros before the start."""
    out = np.zeros(len(raw), np.uint64)
    for j in range(min(ORDER + 1, len(raw))):
        out[j:] |= raw[: len(raw) - j].astype(np.uint64) << np.uint64(8 * j)
    return out


def _mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << (8 * n_bytes)) - 1)


class Lookup:
    """Places of sorted keys, found by hashing with linear probing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.slots[slot] = left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        at = self._home(keys)
        out = self.slots[at]
        if not len(self.keys):
            return out
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = self.slots[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[out[todo]] != keys[todo])]
        return out


def learn(samples: dict[str, list[bytes]]) -> dict:
    """Frozen statistics of the languages: for each order the grams and, by gram and language, logs of probability and escape."""
    languages = sorted(samples)
    counts = []  # by language, by order: (grams, counts)
    for name in languages:
        buffer = np.frombuffer(b"".join(_START + t for t in samples[name]), np.uint8)
        inside = np.ones(len(buffer), bool)
        at = 0
        for t in samples[name]:
            inside[at : at + ORDER] = False
            at += ORDER + len(t)
        g = _grams(buffer)[inside]
        counts.append([np.unique(g & _mask(k + 1), return_counts=True) for k in range(ORDER + 1)])
    orders, lower = [], None
    for k in range(ORDER + 1):
        grams = np.unique(np.concatenate([c[k][0] for c in counts])) if counts else np.empty(0, np.uint64)
        contexts = np.unique(grams >> np.uint64(8))
        log_p, escape = np.zeros((len(grams), len(languages))), np.zeros((len(contexts), len(languages)))
        for j, c in enumerate(counts):
            seen, n = c[k]
            own, first = np.unique(seen >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(first, n, len(own)), np.bincount(first, minlength=len(own))
            row = np.searchsorted(contexts, own)
            escape[row, j] = np.log(kinds / (total + kinds))
            below = np.full(len(grams), -np.log(256.0)) if lower is None else lower[1][np.searchsorted(lower[0], grams & _mask(k)), j]
            log_p[:, j] = below + escape[np.searchsorted(contexts, grams >> np.uint64(8)), j]
            log_p[np.searchsorted(grams, seen), j] = np.log(n / (total + kinds)[first])
        orders.append({"grams": grams, "log_p": log_p.astype(np.float32), "contexts": contexts, "escape": escape.astype(np.float32)})
        lower = (grams, log_p)
    return {"languages": languages, "orders": orders}


class Scorer:
    def __init__(self, model: dict):
        self.languages, self.orders = model["languages"], model["orders"]
        self.grams = [Lookup(o["grams"]) for o in self.orders]
        self.contexts = [Lookup(o["contexts"]) for o in self.orders]
        self.piece = max(1 << 12, PIECE // max(1, len(self.languages) // 4))

    def _logs(self, grams: np.ndarray) -> np.ndarray:
        """Log-probability, by position and language, of the last byte of each gram after the others."""
        out = np.zeros((len(grams), len(self.languages)), np.float32)
        todo = np.arange(len(grams))
        for k in range(ORDER, -1, -1):
            key = grams[todo] & _mask(k + 1)
            place = self.grams[k].find(key)
            hit = place >= 0
            out[todo[hit]] += self.orders[k]["log_p"][place[hit]]
            todo, key = todo[~hit], key[~hit]
            if not len(todo):
                return out
            context = self.contexts[k].find(key >> np.uint64(8))
            known = context >= 0
            out[todo[known]] += self.orders[k]["escape"][context[known]]
        out[todo] -= np.float32(np.log(256.0))
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in nats, by text and language, of whole texts."""
        out = np.zeros((len(texts), len(self.languages)))
        group, size = [], 0
        for i, text in enumerate(texts):
            for a in range(0, len(text), self.piece):
                group.append((i, (_START + text[: self.piece]) if not a else text[a - ORDER : a + self.piece]))
                size += len(group[-1][1])
                if size >= self.piece:
                    self._add(out, group)
                    group, size = [], 0
        if group:
            self._add(out, group)
        return out

    def _add(self, out: np.ndarray, group: list[tuple[int, bytes]]) -> None:
        begin = np.cumsum([0] + [len(t) for _, t in group])
        g = _grams(np.frombuffer(b"".join(t for _, t in group), np.uint8))
        inside = np.ones(len(g), bool)
        for j in range(ORDER):
            inside[begin[:-1] + j] = False
        logs = self._logs(g[inside])
        start = begin[:-1] - ORDER * np.arange(len(group))
        sums = np.add.reduceat(logs, start, axis=0, dtype=np.float64)
        for (i, _), s in zip(group, sums, strict=True):
            out[i] -= s


class LanguageId:
    """Learns languages from labelled texts and predicts the language of whole texts.

    ``learn`` takes rows with a text and a language; a language is learned from about ``LEARN_BYTES`` of its
    different texts, chosen by a hash of the text, and of spans of long ones, so texts of all lengths are learned from; copies
    count once, and more than ``MOST_LANGUAGES`` languages raise ValueError. ``predict`` gives a row per row: id, further columns named in ``keep``,
    ``lang_pred`` and ``score``: the best language's share of exp(-code length / sqrt(bytes)). A text that is null or has no
    letter is ``und`` with score 0, and so is every text if nothing was learned. Ties go to the first language by
    name. Whole texts are scored, whatever their length. Repeated rows are alike; other columns are ignored; an empty table gives no rows.
    """

    def learn(self, labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict:
        rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
        rows = rows.withColumn("bytes", F.octet_length("text")).where("bytes > 0").withColumn("hash", F.xxhash64("text"))
        different = rows.groupBy("lang", "hash").agg(F.max("bytes").alias("bytes"))
        totals = {r["lang"]: r["bytes"] for r in different.groupBy("lang").agg(F.sum("bytes").alias("bytes")).limit(MOST_LANGUAGES + 1).collect()}
        if not totals:
            return learn({})
        if len(totals) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        most = min(LEARN_BYTES, LEARN_TOTAL // len(totals))
        limit = F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(int(_SIEVE * min(1.0, most / v))))])
        rows = rows.withColumn("limit", F.try_element_at(limit, F.col("lang"))).where("limit is not null")
        spans = F.sequence(F.lit(0), F.ceil(F.char_length("text") / LEARN_SPAN).cast("int") - 1)
        spans = F.filter(spans, lambda k: F.pmod(F.xxhash64("hash", k), F.lit(_SIEVE)) < F.col("limit"))
        whole = F.when(F.pmod("hash", F.lit(_SIEVE)) < F.col("limit"), F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
        rows = rows.withColumn("spans", F.when(F.col("bytes") <= LEARN_LONGEST, whole).otherwise(spans)).where("size(spans) > 0")
        pieces = F.transform("spans", lambda k: F.when(k < 0, F.col("text")).otherwise(F.substring("text", k * LEARN_SPAN + 1, F.lit(LEARN_SPAN))))
        one = rows.select("lang", "hash", pieces.alias("pieces")).groupBy("lang", "hash").agg(F.first("pieces").alias("pieces"))
        chosen = one.select("lang", F.explode("pieces").alias("text")).orderBy("lang", "text").toArrow()
        samples: dict[str, list[bytes]] = {}
        for name, value in zip(chosen.column("lang").to_pylist(), chosen.column("text").to_pylist(), strict=True):
            samples.setdefault(name, []).append(value.encode())
        return learn(samples)

    def predict(self, docs: DataFrame, model: dict, id_: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
        spark = docs.sparkSession
        small_batches(spark)
        held = spark.sparkContext.broadcast(model)
        value = F.col(text).cast("string")
        rows = docs.select(value.alias("text"), F.coalesce(value.rlike(r"\p{L}"), F.lit(False)).alias("letter"), *[F.col(c) for c in (id_, *keep)])

        def run(batches):
            scorer = Scorer(held.value)
            for batch in pieces(batches):
                texts, letter = texts_of(batch, "text"), batch.column(1).to_pylist()
                known = [bool(ok and scorer.languages) for ok in letter]
                lengths = scorer.lengths([t if ok else b"" for t, ok in zip(texts, known, strict=True)])
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
                if scorer.languages:
                    best = lengths.argmin(1)
                    spread = np.sqrt(np.maximum(1, [len(t) for t in texts]))[:, None]
                    share = 1.0 / np.exp(np.clip((lengths.min(1, keepdims=True) - lengths) / spread, -700, 0)).sum(1)
                    names = [scorer.languages[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
                    scores = np.where(known, share, 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[2:], "lang_pred", "score"])

        schema = T.StructType([*[rows.schema[c] for c in rows.columns[2:]], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
        return rows.mapInArrow(run, schema)
