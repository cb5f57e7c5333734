"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import values, written

TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]+")


@dataclass(frozen=True)
class Settings:
    """bits: size of the hashed feature space, which bounds the model. shards x shard_rows bounds the labelled rows
    that are learnt from, and shard_bytes what a shard holds of their features, after which it takes no more rows. Each
    shard is learnt in one task, and the models of all shards are averaged; there are no more shards than it takes to hold
    the labelled rows, so a small sample is learnt as one. A shard is gone over until about `updates` rows were used,
    three times at least and 60 at most."""

    bits: int = 18
    shards: int = 4
    shard_rows: int = 8000
    shard_bytes: int = 256 << 20
    updates: int = 24_000
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.0001
    l2: float = 0.00001


class _Hashes(dict):
    """Hash of each word met so far; it is emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = crc32(word)
        return value


_HASHES = _Hashes()
_REPEAT = crc32(b"the word before, again")


def features(text: bytes | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a whole text's word 1- and 2-grams, hashed; values are square roots of counts, scaled to
    length 1. Words are runs of letters and digits, or of other marks; a word that repeats the one before it counts
    as a repeat whatever it is. A text without words has only the constant feature, index 0."""
    words = np.fromiter(map(_HASHES.__getitem__, TOKEN.findall(text or b"")), dtype=np.uint64)
    if not len(words):
        return np.zeros(1, dtype=np.int64), np.ones(1)
    ones = words.copy()
    ones[1:][words[1:] == words[:-1]] = _REPEAT
    twos = (ones[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (ones[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    hashed = np.concatenate([ones * np.uint64(0x165667B19E3779F9), twos]) >> np.uint64(20)
    index, count = np.unique(hashed % np.uint64((1 << bits) - 1), return_counts=True)
    value = np.sqrt(count)
    return np.concatenate([[0], index.astype(np.int64) + 1]), np.concatenate([[1.0], value / np.sqrt((value**2).sum())])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> np.ndarray:
    """Weights by follow-the-regularised-leader with per-coordinate rates, over the rows in the order given."""
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2))

    for _ in range(min(60, max(3, -(-s.updates // max(1, len(rows)))))):
        for index, value, label in rows:
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha * w
            n[index] = ni + g * g
    return weights(z, n)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", s: Settings = Settings()) -> DataFrame:
    """Model (index, weight) learnt from the labelled rows of docs that are not held out (CRC of the id mod 5 is not 0).

    The sample is chosen on the ids of the labels, before any text is read: they go to shards by the CRC of the id, and
    each shard takes the smallest MD5s of its ids up to about shard_rows (never more than shard_rows texts). So the
    chosen ids are bounded and can be sent to all tasks, and the same rows give the same model however they are stored.
    Labels with a null id or label are left out; of an id with several labels the largest counts, and of one with several
    texts the smallest. Without labelled rows the model is empty.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc % 5 != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    shards = min(s.shards, max(1, -(-ids.count() // s.shard_rows)))
    ids = ids.select("doc_id", "label", (F.floor(crc / 5) % shards).cast("int").alias("shard"), F.md5(F.col("doc_id").cast("string")).alias("place"))
    sizes = ids.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    near = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / float(1 << 32)
    chosen = ids.join(F.broadcast(sizes), "shard").where(near <= F.lit(1.05 * s.shard_rows) / F.col("n")).drop("n")
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "shard", "place", "label").agg(F.min("text").alias("text"))
    ordered = texts.repartition(shards, "shard").sortWithinPartitions("shard", "place").select("shard", "label", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, rows = None, 0, []

        def model() -> pa.RecordBatch:
            w = ftrl(rows, s)
            index = np.flatnonzero(w)  # -1 counts the models
            return pa.RecordBatch.from_arrays([pa.array([-1, *index.tolist()], pa.int64()), pa.array([1.0, *w[index].tolist()])], names=["index", "weight"])

        for batch in batches:
            for shard, label, text in zip(*(values(c) for c in batch.columns)):
                if shard != at:
                    if rows:
                        yield model()
                    at, held, rows = shard, 0, []
                if len(rows) < s.shard_rows and held < s.shard_bytes:
                    index, value = features(text, s.bits)
                    rows.append((index, value, int(label)))
                    held += index.nbytes + value.nbytes
        if rows:
            yield model()

    parts = written(ordered.mapInArrow(learn, "index long, weight double"), "models")
    models = parts.agg(F.coalesce(F.sum(F.when(F.col("index") == -1, F.col("weight"))), F.lit(1.0)).alias("models"))  # one row
    return parts.where("index >= 0").groupBy("index").agg(F.sum("weight").alias("weight")).crossJoin(F.broadcast(models)).select("index", (F.col("weight") / F.col("models")).alias("weight"))


def _load(model: DataFrame, bits: int) -> np.ndarray:
    """The model as one array; it has 2 ** bits weights at most, whatever the corpus holds."""
    weights = np.zeros(1 << bits)
    table = model.toPandas()
    weights[table["index"].to_numpy(dtype=np.int64)] = table["weight"].to_numpy()
    return weights


def score(docs: DataFrame, model: DataFrame, keys: list[str], text: str = "text", s: Settings = Settings()) -> DataFrame:
    """keys and score (0 to 1, higher: label 1 likelier) of every row of docs, from the whole text alone.

    Empty and null texts have the score of the constant feature; an empty model gives 0.5 to all.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_load(model, s.bits))
    schema = docs.select(*keys).schema.add("score", "double")

    def run(batches):
        weights = shared.value
        for batch in batches:
            scores = []
            for body in values(batch.column("_body")):
                index, value = features(body, s.bits)
                scores.append(1 / (1 + np.exp(-np.clip(weights[index] @ value, -35, 35))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(scores, type=pa.float64())], names=[*keys, "score"])

    return docs.select(*keys, F.col(text).cast("binary").alias("_body")).mapInArrow(run, schema)


def quality_digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; a null id is not held out."""
    scored = score(docs, train(docs, labels), ["doc_id"])
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary")) % 5
    held = (fold == 0) & F.col("doc_id").isNotNull()
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score at least threshold, with their columns as they are, whatever their names.

    The text goes through Arrow once and comes back with its score, so no join has to bring the two together. Null and
    empty texts have the score of the constant feature; null ids and repeated rows are scored like any other; an empty
    table gives an empty result, and without labels all rows score 0.5 and stay.
    """
    s = Settings()
    shared = docs.sparkSession.sparkContext.broadcast(_load(train(docs, labels, s=s), s.bits))
    at = docs.columns.index("text")

    def run(batches):
        weights = shared.value
        for batch in batches:
            keep = []
            for body in values(batch.column(at).cast(pa.binary())):
                index, value = features(body, s.bits)
                keep.append(bool(1 / (1 + np.exp(-np.clip(weights[index] @ value, -35, 35))) >= threshold))
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
