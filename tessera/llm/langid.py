"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text is lower-cased, runs of ASCII characters other than letters become spaces, and its byte n-grams are hashed into
`BUCKETS` rows of an embedding table; their average goes through a linear softmax. The model is fitted on at most
`TRAIN_ROWS` labelled documents, those of least hash of doc_id, half of them in proportion to the languages and half in equal parts, so that rare languages are
learned too; their n-gram counts (at most `BUCKETS` each) meet in one task. A fifth of each language's is held
back to fit the temperature and the rejection threshold: the score below which no more than `REJECT_QUANTILE` of rightly labelled
documents fall. Scoring runs over whole texts; since embedding and softmax are linear before the
exponential, each bucket is folded to one row of class logits and a text costs one gather per n-gram.

Defined cases: null text and text without a letter are `und` with score 0, rejected. Where no labelled row exists every row is
`und`. Labels that are null are not learned. Rows that repeat are scored alike. Extra columns of whatever name are kept by `identify`. An empty table gives no model and an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

BUCKETS = 1 << 15
DIMS = 16
GRAMS = (2, 3, 4)
TRAIN_ROWS = 3000
EPOCHS = 6
RATE = 20.0
REJECT_QUANTILE = 0.001

_ASCII = np.full(256, 32, np.uint8)
_ASCII[97:123] = np.arange(97, 123)
_ASCII[128:] = np.arange(128, 256)


def _grams(texts: list[str | None]):
    """Per chunk of texts: first row, end row, positions where rows start, and the bucket of every n-gram of each size."""
    at = 0
    while at < len(texts):
        parts, starts, size, end = [], [], 0, at
        while end < len(texts) and (end == at or size < C.CHUNK_BYTES):
            raw = b"    " + (texts[end] or "").lower().encode("utf-8", "replace") + b"    "
            parts.append(raw), starts.append(size)
            size += len(raw)
            end += 1
        # The last text is followed by spaces as the others are, so that a text's n-grams do not depend on where it stands.
        data = _ASCII[np.frombuffer(b"".join([*parts, b" " * max(GRAMS)]), np.uint8)].astype(np.uint32)
        sizes = []
        for n in GRAMS:
            h = np.full(size, n, np.uint32)
            for j in range(n):
                h = (h ^ data[j : j + len(h)]) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            sizes.append((h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64))
        yield at, end, np.asarray(starts), sizes
        at = end


def _counts(batches):
    """(lang, doc_id, place, text_hash, buckets, weights) of each row."""
    for batch in batches:
        langs, ids, places, hashes, texts = (batch.column(i).to_pylist() for i in range(5))
        buckets, weights = [], []
        for text in texts:
            for _, _, _, sizes in _grams([text]):
                b, n = np.unique(np.concatenate(sizes), return_counts=True)
                buckets.append(b.astype(np.int32)), weights.append((n / n.sum()).astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(hashes, pa.int64()), pa.array(buckets, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))], names=["lang", "doc_id", "place", "text_hash", "buckets", "weights"])


class LanguageModel:
    """labels, class logits per bucket, temperature and rejection threshold."""

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0) -> None:
        self.labels, self.table, self.bias, self.temperature, self.threshold = labels, table, bias, temperature, threshold

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated class probabilities of each text."""
        out = np.zeros((len(texts), len(self.labels)), np.float64)
        for at, end, starts, sizes in _grams(texts):
            total = np.zeros((len(starts), len(self.labels)))
            for buckets in sizes:
                for c in range(len(self.labels)):
                    total[:, c] += np.add.reduceat(self.table[c][buckets], starts, dtype=np.float64)
            length = np.diff(np.r_[starts, len(sizes[0])]) * len(GRAMS)
            out[at:end] = total / length[:, None] + self.bias
        z = out / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        # Sums depend on the batch in their last digits.
        return np.round(z / z.sum(axis=1, keepdims=True), 9)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 5) -> LanguageModel | None:
    """Fit on (label, buckets, weights), every fifth row of a label held back for calibration."""
    if not rows:
        return None
    labels = sorted({r[0] for r in rows})
    place = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    seen, own, held = dict.fromkeys(labels, 0), [], []
    for r in rows:
        seen[r[0]] += 1
        (own if seen[r[0]] % 5 else held).append(r)
    held = held or rows
    emb = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    out = np.zeros((DIMS, len(labels)), np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    bias = np.zeros(len(labels), np.float32)

    def stack(part):
        buckets = np.concatenate([r[1] for r in part])
        weights = np.concatenate([r[2] for r in part])
        starts = np.cumsum([0, *(len(r[1]) for r in part[:-1])])
        return buckets, weights, starts

    def forward(part):
        buckets, weights, starts = stack(part)
        mean = np.add.reduceat(emb[buckets] * weights[:, None], starts)
        return buckets, weights, mean, mean @ out + bias

    for epoch in range(EPOCHS):
        order, rate = rng.permutation(len(own)), RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), 16):
            part = [own[i] for i in order[at : at + 16]]
            buckets, weights, mean, z = forward(part)
            delta = _softmax(z)
            delta[np.arange(len(part)), [place[r[0]] for r in part]] -= 1
            delta /= len(part)
            back = delta @ out.T
            out -= 0.1 * rate * mean.T @ delta
            bias -= 0.01 * rate * delta.sum(0)
            grad = np.repeat(back, [len(r[1]) for r in part], axis=0) * weights[:, None]
            sort = np.argsort(buckets, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(buckets[sort]) != 0])
            emb[buckets[sort][first]] -= rate * np.add.reduceat(grad[sort], first)
    z, truth = forward(held)[3].astype(np.float64), np.array([place[r[0]] for r in held])

    def loss(t: float) -> float:
        # One wrong label more than was seen, or classes told apart without error would drive all scores to 1.
        p, miss = np.log(_softmax(z / t) + 1e-12), 1 / (len(z) + 1)
        return -((1 - miss) * p[np.arange(len(z)), truth] + miss * p.mean(1)).mean()

    temperature = min(np.geomspace(0.05, 5, 60), key=loss)
    p = _softmax(z / temperature)
    right = p.argmax(1) == truth
    # A little lower, so that rounding decides about no document.
    threshold = np.floor(np.quantile(p.max(1)[right], REJECT_QUANTILE, method="lower") * 1e5) / 1e5 if right.any() else 0.0
    return LanguageModel(labels, np.ascontiguousarray((emb @ out).T), bias.astype(np.float64), float(temperature), float(threshold))


def _sample(labelled: DataFrame, rows: int) -> DataFrame:
    """About `rows` documents by a hash of doc_id: half in proportion to the languages, half in equal parts."""
    sizes = labelled.groupBy("lang").count().collect()  # one row per class of the model
    n = sum(r["count"] for r in sizes)
    shares = [(r["lang"], min(1.0, rows / 2 * (1 / n + 1 / len(sizes) / r["count"]))) for r in sizes]
    place = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30))
    shared = labelled.join(F.broadcast(labelled.sparkSession.createDataFrame(shares, "lang string, _share double")), "lang")  # a row per class
    return shared.withColumn("place", place).where(F.col("place") < F.col("_share") * (1 << 30)).select("lang", "doc_id", "place", F.xxhash64("text").alias("text_hash"), "text")


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel | None:
    """Train on a bounded sample of documents with a label, those with crc32(doc_id as text) mod 4 = 2 apart. Null where there is none.

    The rows of least hash are taken, in a fixed order, so the same table gives the same model however it is partitioned.
    """
    labelled = docs.where("lang is not null and text is not null and doc_id is not null and crc32(cast(doc_id as string)) % 4 != 2").select("lang", "doc_id", "text")
    drawn = _sample(labelled, rows).orderBy("place", "doc_id", "text_hash", "lang").limit(rows + rows // 20)
    counted = drawn.mapInArrow(_counts, "lang string, doc_id long, place long, text_hash long, buckets array<int>, weights array<float>")
    # The sample meets in one task, which hands back the folded table alone; the driver holds no training rows.
    got = counted.repartition(1).mapInArrow(_trained, "labels array<string>, table binary, bias binary, temperature double, threshold double").first()
    if got is None:
        return None
    table = np.frombuffer(got["table"], np.float32).reshape(len(got["labels"]), BUCKETS)
    return LanguageModel(got["labels"], table, np.frombuffer(got["bias"], np.float64), got["temperature"], got["threshold"])


def _trained(batches):
    found = pa.Table.from_batches(list(batches), pa.schema([("lang", pa.string()), ("doc_id", pa.int64()), ("place", pa.int64()), ("text_hash", pa.int64()), ("buckets", pa.list_(pa.int32())), ("weights", pa.list_(pa.float32()))]))
    found = found.sort_by([(c, "ascending") for c in ("place", "doc_id", "text_hash", "lang")])
    buckets, weights = (found.column(c).combine_chunks() for c in ("buckets", "weights"))
    numbers = [(a.values.to_numpy(), a.offsets.to_numpy()) for a in (buckets, weights)]
    model = train([(lang, *(x[o[i] : o[i + 1]] for x, o in numbers)) for i, lang in enumerate(found.column("lang").to_pylist())])
    if model is not None:
        yield pa.RecordBatch.from_arrays([pa.array([model.labels]), pa.array([model.table.astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias.tobytes()], pa.binary()), pa.array([model.temperature]), pa.array([model.threshold])], names=["labels", "table", "bias", "temperature", "threshold"])


def identify(docs: DataFrame, model: LanguageModel | None, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with the predicted language, its score (calibrated probability) and whether it is rejected. Columns of docs of these names are replaced."""
    columns = [c for c in docs.columns if c not in names]
    kept = C.carried(docs.drop(*names), "text")

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            pred, score, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            some = [i for i, t in enumerate(texts) if model is not None and t and any(map(str.isalpha, t))]
            if some:
                p = model.scores([texts[i] for i in some])
                best = p.argmax(1)
                score[some] = p.max(1)
                out[some] = score[some] < model.threshold
                for i, b in zip(some, best):
                    pred[i] = model.labels[b]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(out)], names=[*batch.schema.names, *names])

    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType())))])
    done = kept.mapInArrow(run, schema)
    return done.select(*C.restored(done, columns, "text"), *names)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identify(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
