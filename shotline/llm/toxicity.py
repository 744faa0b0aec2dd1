"""Toxicity by a classifier chain.

Categories are predicted in a stated order by linear models on counts of words and word beginnings; each model
also gets the probabilities of the categories before it.  When a later model learns, these probabilities come from
folds that left the document out, so that it sees what it will see in use.  Each model picks the features with the
largest chi-squared statistic in its training rows and fits logistic regression with an L1 penalty to them.

The model learns from a sample of stated size, the labelled documents with the least hashes of their doc_id; every
document is scored on its whole text.  Folds follow a hash of the doc_id.  Null or empty texts have no words: the bias and the chain decide.  Repeated
doc_ids are scored row by row; to learn from, the row with the greatest features counts, and the greatest label.  Null labels count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotline.llm import words

DIM = 1 << 20
#: Bytes of a word's beginning that count as a feature of their own.
STEMS = (4, 5, 6, 7)
FOLDS = 5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the words and word beginnings, sorted by row."""
    rows, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for b in words.batches(texts):
        found_here, rows_here = [b.hash], [b.row]
        for size in STEMS:
            long = b.ends - b.starts > size
            stem = words.hash_spans(b.buf, b.starts[long], b.starts[long] + size)
            found_here.append(words.mix(stem + np.uint64(size)))
            rows_here.append(b.row[long])
        h, row = np.concatenate(found_here) % np.uint64(DIM), np.concatenate(rows_here)
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
        rows.append(row + b.first)
        found.append(h.astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


def _fit(row: np.ndarray, feature: np.ndarray, extra: np.ndarray, y: np.ndarray, keep: int, steps: int, penalty: float) -> dict[str, np.ndarray]:
    """One category's model: chosen features, their weights, weights of the earlier probabilities, bias."""
    n, ones = len(y), max(1.0, float(y.sum()))
    total = np.bincount(feature, minlength=DIM)
    hits = np.bincount(feature, weights=y[row], minlength=DIM)
    expected = total * ones / n
    gap = (hits - expected) ** 2 / np.maximum(expected * (1 - ones / n) * (1 - total / n), 1e-9)
    gap[total < 3] = 0
    chosen = np.sort(np.argsort(-gap, kind="stable")[:keep])
    chosen = chosen[gap[chosen] > 0]
    where = np.full(DIM, -1, dtype=np.int64)
    where[chosen] = np.arange(len(chosen))
    own = where[feature] >= 0
    cell = row[own].astype(np.int64) * len(chosen) + where[feature[own]]
    x = np.bincount(cell, minlength=n * len(chosen)).astype(np.float32).reshape(n, -1)  # at most the sample's documents by keep features
    w, e, b = np.zeros(len(chosen)), np.zeros(extra.shape[1]), float(np.log(ones / max(1.0, n - ones)))
    gw, ge, gb = np.full(len(chosen), 1e-8), np.full(extra.shape[1], 1e-8), 1e-8
    for _ in range(steps):
        z = x @ w.astype(np.float32) + extra @ e + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        dw, de, db = error.astype(np.float32) @ x, extra.T @ error, float(error.sum())
        gw, ge, gb = gw + dw * dw, ge + de * de, gb + db * db
        step = 0.6 / np.sqrt(gw)
        w = w - step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        e, b = e - 0.3 * de / np.sqrt(ge), b - 0.3 * db / np.sqrt(gb)
    live = w != 0
    return {"feature": chosen[live], "w": w[live], "extra": e, "b": np.array([b])}


def _predict(model: dict[str, np.ndarray], row: np.ndarray, feature: np.ndarray, extra: np.ndarray, n: int) -> np.ndarray:
    at = np.searchsorted(model["feature"], feature)
    own = at < len(model["feature"])
    own[own] = model["feature"][at[own]] == feature[own]
    z = np.bincount(row[own], weights=model["w"][at[own]], minlength=n) + extra @ model["extra"] + model["b"][0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(row: np.ndarray, feature: np.ndarray, labels: np.ndarray, fold: np.ndarray, keep: int = 1000, steps: int = 400, penalty: float = 1e-4) -> list[dict[str, np.ndarray]]:
    """A model for each column of labels (documents x categories), in order; fold: of each document."""
    n = len(labels)
    extra, out = np.zeros((n, 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(np.float64)
        out.append(_fit(row, feature, extra, y, keep, steps, penalty))
        held = np.zeros(n)
        for j in range(FOLDS if k + 1 < labels.shape[1] else 0):
            own = fold != j
            number = np.cumsum(own) - 1
            part = own[row]
            m = _fit(number[row[part]], feature[part], extra[own], y[own], keep, steps, penalty)
            held[~own] = _predict(m, row, feature, extra, n)[~own]
        extra = np.hstack([extra, held[:, None]])
    return out


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = 8_000) -> list[dict[str, np.ndarray]]:
    """docs: (id, text); labels: id and a 0/1 column for each category; sample: documents to learn from at most."""
    known = labels.filter("id is not null").groupBy("id").agg(*[F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(c) for c in categories])
    few = known.orderBy(F.xxhash64("id", F.lit(6)), "id").limit(sample)

    def run(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted:
            row, feature = features(batch.column("text"))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            own = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([batch.column("id"), pa.array(own, pa.binary()), *(batch.column(c) for c in categories)], ["id", "f", *categories])

    found = docs.join(F.broadcast(few), "id").select("id", "text", *categories)
    rows = found.mapInArrow(run, "id long, f binary, " + ", ".join(f"`{c}` int" for c in categories))
    table = rows.groupBy("id").agg(F.max("f").alias("f"), *[F.max(c).alias(c) for c in categories]).orderBy("id").toArrow()
    sets = [np.frombuffer(x.as_py(), dtype=np.int32) for x in table.column("f")]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    y = np.stack([np.asarray(table.column(c)) for c in categories], axis=1) if sets else np.zeros((0, len(categories)))
    if not len(sets):
        return [{"feature": np.zeros(0, dtype=np.int64), "w": np.zeros(0), "extra": np.zeros(k), "b": np.array([-30.0])} for k in range(len(categories))]
    fold = (words.mix(np.asarray(table.column("id")).view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    return fit_chain(row.astype(np.int32), np.concatenate(sets), y, fold)


def score(docs: DataFrame, models: list[dict[str, np.ndarray]], categories: list[str]) -> DataFrame:
    """(id, p_<category> ...) of documents (id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted:
            n = batch.num_rows
            row, feature = features(batch.column("text"))
            extra = np.zeros((n, 0))
            for m in sent.value:
                extra = np.hstack([extra, _predict(m, row, feature, extra, n)[:, None]])
            yield pa.record_batch([batch.column("id"), *(pa.array(extra[:, k]) for k in range(extra.shape[1]))], ["id", *(f"p_{c}" for c in categories)])

    return docs.mapInArrow(run, "id long, " + ", ".join(f"`p_{c}` double" for c in categories))
