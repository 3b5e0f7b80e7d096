"""Language identification: averaged embeddings of hashed subwords and a linear softmax, with calibrated rejection.

A text's subwords are its byte runs of lengths GRAMS (letters in lower case, ASCII non-letters as spaces), hashed
into BUCKETS rows of an embedding table. Their mean goes through a linear softmax. Embeddings and softmax are trained
together by stochastic gradient descent in numpy on a bounded sample of labelled rows; a part of the sample that
training doesn't see sets a temperature, so that scores are probabilities of being right, and a prediction below
REJECT_BELOW is rejected. Prediction reads every whole text and shuffles nothing.

The sample holds about PER_LANGUAGE rows of each label, or an even share of SAMPLE_ROWS where labels are many, chosen
by a hash of doc_id. It is bounded in rows by SAMPLE_ROWS and in bytes of subword counts, which are all that comes to
the driver, by SAMPLE_BYTES. Each label's first row in hash order goes before all others, so no label is left out
while there are no more labels than rows in the bound.

Defined results: a null text, or one without any letter, is `und` with score 0 and rejected; without labelled rows
all texts are; a null or blank lang is no label; repeated rows are predicted each, and trained on once a doc_id and lang
(by the smallest text); of equal scores, the label first in order wins; texts of any length are read whole; a null
doc_id is never trained on and is held out = false; an empty table gives no rows; further columns pass through :func:`filter_accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import textkit
from tidelog.llm.common import frugal

GRAMS = (3, 4)
BUCKETS, DIM = 1 << 15, 16
PER_LANGUAGE, SAMPLE_ROWS, SAMPLE_BYTES = 400, 20_000, 128 << 20
#: Rows of one label are joined with its count in so many groups.
SALTS = 64
EPOCHS, RATE = 6, 4.0
REJECT_BELOW = 0.5
UNKNOWN = "und"

_PLAIN = np.full(256, 32, dtype=np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray  # BUCKETS x DIM
    weights: np.ndarray  # DIM x languages
    bias: np.ndarray
    temperature: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def subwords(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each length of GRAMS a bucket per byte; BUCKETS where the run would leave its text."""
    plain, n = _PLAIN[raw].astype(np.uint32), len(raw)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    for k in GRAMS:
        code = np.zeros(n, dtype=np.uint32)
        for j in range(k):
            code[: n - j] = code[: n - j] * np.uint32(0x01000193) + plain[j:]
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        bucket = (code >> np.uint32(17)).astype(np.int64)
        bucket[left < k] = BUCKETS
        yield bucket


def _features(rows: DataFrame) -> DataFrame:
    """(lang, part, buckets, counts) of each row: its subwords as a sparse vector."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = textkit.text_bytes(batch.column(2))
            found = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                total = np.zeros(BUCKETS + 1, dtype=np.int64)
                for bucket in subwords(raw[a:b], np.array([0, b - a])):
                    total += np.bincount(bucket, minlength=BUCKETS + 1)
                at = np.flatnonzero(total[:BUCKETS])
                found.append((at.astype(np.uint16).tobytes(), total[at].astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["lang", "part", "buckets", "counts"])

    return rows.select("lang", "part", "text").mapInArrow(count, "lang string, part bigint, buckets binary, counts binary")


def sample(docs: DataFrame) -> DataFrame:
    """(lang, part, text): the bounded sample of labelled rows that aren't held out; part is a hash."""
    labelled = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and trim(lang) <> ''").where(~held_out(F.col("doc_id")))
    spread = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30))
    rows = labelled.select("doc_id", "lang", spread("sample").alias("chance"), spread("part").alias("part"), F.least(F.lit(6 * BUCKETS), 6 * len(GRAMS) * F.octet_length("text")).alias("bytes"))
    labels = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("chance").alias("first"))
    per = F.least(F.lit(PER_LANGUAGE), F.floor(SAMPLE_ROWS / F.greatest(labels.agg(F.count("*")).scalar(), F.lit(1))))
    salted = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    picked = rows.withColumn("salt", F.col("part") % SALTS).join(salted, ["lang", "salt"]).withColumn("lead", F.col("chance") == F.col("first")).where(F.col("lead") | (F.col("chance") * F.col("n") < per * (1 << 30)))
    rank = [F.desc("lead"), F.asc("part"), F.asc("lang"), F.asc("doc_id")]
    few = picked.groupBy("doc_id", "lang", "part", "lead").agg(F.max("bytes").alias("bytes")).orderBy(*rank).limit(SAMPLE_ROWS)
    running = F.sum("bytes").over(Window.orderBy(*rank))
    ids = few.withColumn("sent", running).where(F.col("sent") <= SAMPLE_BYTES).select("doc_id", "lang", "part")
    return labelled.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang", "part").agg(F.min("text").alias("text")).select("lang", "part", "text")


def train(rows: list, epochs: int = EPOCHS, rate: float = RATE) -> Model | None:
    """Fits a model to rows (lang, part, buckets, counts). Rows of a fifth of the parts only calibrate."""
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    number = {x: i for i, x in enumerate(languages)}
    data = []
    for r in sorted(rows, key=lambda r: (r["part"], r["lang"])):
        at, counts = np.frombuffer(r["buckets"], np.uint16).astype(np.int64), np.frombuffer(r["counts"], np.float32)
        if len(at):
            data.append((at, counts / counts.sum(), number[r["lang"]], r["part"] % 5 == 0))
    fit, rest = [d for d in data if not d[3]] or data, [d for d in data if d[3]] or data
    rng = np.random.default_rng(7)
    embeddings = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights = np.zeros((DIM, len(languages)), dtype=np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)

    def logits(d) -> np.ndarray:
        return (d[1] @ embeddings[d[0]]) @ weights + bias

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max())
        return e / e.sum()

    steps = max(1, epochs * len(fit))
    for step in range(epochs * len(fit)):
        if step % len(fit) == 0:
            order = rng.permutation(len(fit))
        at, share, label, _ = fit[order[step % len(fit)]]
        now = rate * (1 - step / steps)
        hidden = share @ embeddings[at]
        slope = softmax(hidden @ weights + bias)
        slope[label] -= 1
        back = weights @ slope
        weights -= (now / 10) * np.outer(hidden, slope)
        bias -= (now / 100) * slope
        embeddings[at] -= now * len(at) ** 0.5 * np.outer(share, back)
    scores = np.array([logits(d) for d in rest]) if rest else np.zeros((0, len(languages)))
    labels = np.array([d[2] for d in rest], dtype=np.int64)

    def loss(t: float) -> float:
        z = scores / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]).mean()) if len(z) else 0.0

    return Model(languages, embeddings, weights, bias, min((0.1, 0.15, 0.25, 0.4, 0.6, 0.8, 1.0, 1.25, 1.5, 2.0, 3.0, 5.0), key=loss))


def fit(docs: DataFrame) -> Model | None:
    return train(_features(sample(docs)).collect())


def _scoring_table(model: Model | None) -> np.ndarray | None:
    """What is added up for each subword: a row per language, or per dimension where languages are more."""
    if not model:
        return None
    inner = model.embeddings @ model.weights if len(model.languages) <= DIM else model.embeddings
    return np.ascontiguousarray(np.vstack([inner, np.zeros((1, inner.shape[1]), np.float32)]).T)


def _predict(column: pa.Array, model: Model | None, table: np.ndarray | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores and acceptance of a column of texts."""
    texts = column.to_pylist()
    letters = np.fromiter((t is not None and any(map(str.isalpha, t)) for t in texts), bool, len(texts))
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model and letters.any():
        raw, offsets = textkit.text_bytes(column)
        for a, b in textkit.chunks(offsets):
            part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            sizes = np.diff(at)
            some = np.flatnonzero(sizes)
            if not len(some):
                continue
            sums = np.zeros((b - a, len(table)))
            for bucket in subwords(part, at):
                for c, values in enumerate(table):
                    sums[some, c] += np.add.reduceat(values[bucket], at[:-1][some], dtype=np.float64)
            runs = sum(np.maximum(sizes - k + 1, 0) for k in GRAMS)
            mean = sums / np.maximum(runs, 1)[:, None]
            z = ((mean if len(model.languages) <= DIM else mean @ model.weights) + model.bias) / model.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for i in np.flatnonzero(letters[a:b]):
                names[a + i], scores[a + i] = model.languages[best[i]], min(1.0, float(p[i, best[i]]))
    return names, scores, letters & (scores >= REJECT_BELOW)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and accepted of every row. Only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _scoring_table(shared.value)
        for batch in batches:
            names, scores, accepted = _predict(batch.column(1), shared.value, table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(accepted)], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, accepted boolean")


def filter_accepted(docs: DataFrame) -> DataFrame:
    """The rows whose prediction is accepted, with their columns, by a model fitted to the same table."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    at = docs.columns.index("text")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _scoring_table(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(_predict(batch.column(at), shared.value, table)[2]))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of every row, by a model fitted to the same table."""
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
