"""Quality classifier by positive-unlabelled learning.

A linear model on surface statistics of a text (see features) is fitted to trusted positives (documents marked 1)
and unlabelled web text (all documents, whatever they are), by the non-negative unbiased risk
pi E_p[l(f)] + max(0, E_u[l(-f)] - pi E_p[l(-f)]) with the logistic loss l; where the second part falls below zero,
a step goes back up along it.  Labels of 0 are never used.

The class prior pi is estimated from positives and unlabelled texts alone: a first linear model tells the two apart;
whatever threshold it is used at, the share of unlabelled texts above it is at least pi times that of positives, so
pi is the least ratio of the two shares over all thresholds that keep half of the positives.  Positives are halved, to
fit that model and to measure with.

Every document is unlabelled text: each task fits to all of its own documents, and Spark averages the tasks' weights, by their numbers of documents.  Positives are a sample of stated size, the labelled
documents with the least hashes of their doc_id.  Every document is scored.  Null texts count as empty.  Without any
positive the score is 0.5 everywhere.  Repeated doc_ids are scored row by row; as positives the row with the greatest
features counts.  A doc_id with labels of both kinds counts as positive.  Labels other than 1 are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotline.llm import words

BYTES = 256
N_FEATURES = BYTES + 12
#: Documents that a task fits to at least, where there are as many: small parts are read together.
DOCS_A_TASK = 8192


def remainder(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def features(texts: pa.Array) -> np.ndarray:
    """A row for each text: square roots of the shares of its bytes, then twelve statistics of its length, words and lines."""
    raw, offsets = words.text_bytes(texts)
    out = np.zeros((len(offsets) - 1, N_FEATURES), dtype=np.float32)
    for a, b in words.groups(offsets):
        buf, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        n, size = b - a, np.diff(at)
        row = np.repeat(np.arange(n), size)
        share = np.bincount(row * BYTES + buf, minlength=n * BYTES).reshape(n, BYTES)
        lines = share[:, 10] + 1
        starts, ends = words.find_words(buf, at)
        own = np.searchsorted(at[1:], starts, "right")
        count = np.bincount(own, minlength=n)
        length = np.bincount(own, weights=ends - starts, minlength=n)
        h = words.hash_spans(buf, starts, ends)
        again = np.zeros(len(h), dtype=bool)
        again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
        again = np.bincount(own, weights=again, minlength=n) / np.maximum(count, 1)
        _, kind_row = words.distinct(h, own)
        kinds = np.bincount(kind_row, minlength=n)
        chars = np.maximum(size, 1)
        stats = [
            np.log1p(size) / 10, np.log1p(count) / 10, length / np.maximum(count, 1) / 10, kinds / np.maximum(count, 1),
            kinds / np.maximum(np.sqrt(count), 1) / 20, count / lines / 50, length / chars, share[:, 65:91].sum(1) / chars,
            share[:, 48:58].sum(1) / chars, (size == 0).astype(float),
            again, np.sqrt(again),
        ]
        out[a:b, :BYTES] = np.sqrt(share / chars[:, None])
        out[a:b, BYTES:] = np.stack(stats, axis=1)
    return out


def pu_risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of a linear model w on positives p and unlabelled u, and the direction of its next step.

    That is the gradient, or, while the negative part is below zero, the one that raises this part.
    """
    fp, fu = p @ w, u @ w
    pull = -prior * (p.T @ _sigmoid(-fp)) / len(p)  # of positives towards 1
    push = u.T @ _sigmoid(fu) / len(u) - prior * (p.T @ _sigmoid(fp)) / len(p)
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    positive = prior * np.logaddexp(0, -fp).mean()
    return (float(positive + negative), pull + push) if negative >= 0 else (float(positive), -push)


def apart(w: np.ndarray, p: np.ndarray, u: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic risk of telling p from u, both weighing the same, and its gradient."""
    fp, fu = p @ w, u @ w
    return float(np.logaddexp(0, -fp).mean() + np.logaddexp(0, fu).mean()), u.T @ _sigmoid(fu) / len(u) - p.T @ _sigmoid(-fp) / len(p)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, risk: Callable, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights of a linear model of features, the bias last: Adam on risk over all rows."""
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-2
    p, u = (np.hstack([(x - mean) / scale, np.ones((len(x), 1))]).astype(np.float32) for x in (positive, unlabelled))
    w, m, v = np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1)
    for step in range(1, steps + 1):
        grad = risk(w.astype(np.float32), p, u)[1] + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    raw = w[:-1] / scale
    return np.append(raw, w[-1] - raw @ mean)


def _positives(docs: DataFrame, ids: DataFrame, n: int) -> np.ndarray:
    """Features of the documents of at most n ids, in order of id: a bounded array on the driver."""
    few = ids.orderBy(F.xxhash64("id", F.lit(4)), "id").limit(n)

    def run(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted:
            yield pa.record_batch([batch.column("id"), pa.array([x.tobytes() for x in features(batch.column("text"))], pa.binary())], ["id", "f"])

    texts = docs.select("id", "text").join(F.broadcast(few), "id", "left_semi")
    found = texts.mapInArrow(run, "id long, f binary").groupBy("id").agg(F.max("f").alias("f")).orderBy("id").toArrow().column("f")
    return np.array([np.frombuffer(x.as_py(), dtype=np.float32) for x in found]).reshape(-1, N_FEATURES)


def _averaged(docs: DataFrame, positive: np.ndarray, risk: Callable) -> np.ndarray:
    """Weights fitted in each task to all its documents, averaged."""
    sent = docs.sparkSession.sparkContext.broadcast(positive)

    def run(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [features(b.column("text")) for b in parted if b.num_rows]
        if own:
            u = np.concatenate(own)
            w = fit(sent.value, u, risk)
            yield pa.record_batch({"i": pa.array(np.arange(len(w), dtype=np.int32)), "w": pa.array(w), "n": pa.array(np.full(len(w), float(len(u))))})

    tasks = max(1, docs.count() // DOCS_A_TASK)
    table = docs.select("text").coalesce(tasks).mapInArrow(run, "i int, w double, n double").groupBy("i").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w")).toArrow()
    out = np.zeros(N_FEATURES + 1)
    out[np.asarray(table.column("i"))] = np.asarray(table.column("w"))
    return out


BINS = 1000


def _bins(w: np.ndarray, f: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(_sigmoid(f @ w[:-1] + w[-1]) * BINS, BINS - 1).astype(np.int64), minlength=BINS)


def class_prior(docs: DataFrame, positive: np.ndarray) -> float:
    """The share of good documents among all, from positives and unlabelled texts."""
    fitting, measuring = positive[::2], positive[1::2] if len(positive) > 1 else positive
    w = _averaged(docs, fitting, apart)

    def run(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, dtype=np.int64)
        for b in parted:
            total += _bins(w, features(b.column("text")))
        yield pa.record_batch({"bin": pa.array(np.arange(BINS, dtype=np.int32)), "n": pa.array(total)})

    table = docs.select("text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    unlabelled = np.zeros(BINS)
    unlabelled[np.asarray(table.column("bin"))] = np.asarray(table.column("n"))
    return least_ratio(_bins(w, measuring), unlabelled)


def least_ratio(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """From counts by bin of the score: the least ratio of the shares above a threshold that keeps half of the positives."""
    p, u = (np.cumsum(x[::-1])[::-1] / max(1, x.sum()) for x in (positive, unlabelled))
    keep = p >= 0.5
    return float(np.clip((u[keep] / p[keep]).min() if keep.any() else 0.5, 0.01, 0.99))


def train(docs: DataFrame, labels: DataFrame, sample: int = 4_096) -> dict[str, np.ndarray]:
    """Fit the model; docs: (id, text), labels: (id, label) to learn from; sample: positives at most."""
    known = labels.filter("id is not null and label = 1").select("id").distinct()
    positive = _positives(docs, known, sample)
    if not len(positive):
        return {"w": np.zeros(N_FEATURES), "b": np.zeros(1)}
    prior = class_prior(docs, positive)
    w = _averaged(docs, positive, lambda w, p, u: pu_risk(w, p, u, prior))
    return {"w": w[:-1], "b": w[-1:], "prior": np.array([prior])}


def score(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", out: str = "score") -> DataFrame:
    """docs with a column out instead of the column of texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in rest]

    def run(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in parted:
            z = features(batch.column(text)) @ m["w"] + m["b"][0]
            yield pa.record_batch([*(batch.column(x) for x in names), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], [*names, out])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{out}` double"]))
