"""Columns that need Python: Unicode normal form, caption similarity, and the hook for callers' own scoring."""

from __future__ import annotations

import difflib
import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from shotline.functions import vectors as V


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters of two captions."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def ocr_text(boxes: Column) -> Column:
    """The texts of array<struct<text, ...>> in order, without empty ones, in normal form C."""
    texts = F.filter(F.transform(boxes, lambda b: F.trim(b["text"])), lambda t: F.coalesce(t, F.lit("")) != "")
    return nfc(F.array_join(texts, " "))


def object_labels(dets: Column) -> Column:
    """Distinct labels of detections, sorted."""
    return F.array_sort(F.array_distinct(F.transform(dets, lambda d: d["label"])))


def merged_attributes(attrs: Column, dets: Column) -> Column:
    """The attributes (a struct) with objects, the distinct labels of the detections, and the detections themselves."""
    return attrs.withField("objects", object_labels(dets)).withField("detected_objects", dets)


def on_frame(region: Column, dets: Column, w: Column, h: Column) -> Column:
    """Detections of a region [x1, y1, x2, y2] in the frame's coordinates, moved by the corner of the region.

    The region is cut to whole pixels within the frame; one that has no area then gives no detections.
    """
    hold = lambda v, most: F.least(F.greatest(v.cast("int"), F.lit(0)), most.cast("int"))
    x, y = F.greatest(region[0].cast("int"), F.lit(0)), F.greatest(region[1].cast("int"), F.lit(0))
    area = (hold(region[2], w) > x) & (hold(region[3], h) > y)
    moved = F.transform(dets, lambda d: d.withField("bbox", F.array(d["bbox"][0] + x, d["bbox"][1] + y, d["bbox"][2] + x, d["bbox"][3] + y)))
    return F.when(area, moved).otherwise(F.slice(moved, 1, 0))


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """U1's default: a unit vector of token counts by hash, so that text queries work without a model."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    at = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
    return V.normalise(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(at, lambda p: p == i)).cast("double")))


def score_with(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], name: str = "score") -> DataFrame:
    """A column from the caller's function of a batch."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            yield pdf.assign(**{name: scorer(pdf)})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{name}` double"])
    return df.mapInPandas(run, schema)


def batch_model(load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = 256) -> Callable[[Column], Column]:
    """U1 in batches: a column of vectors from a model that load makes, once a worker; it takes an array of batch inputs and returns a row for each.

    A null input reaches the model as None.
    """
    return predict_batch_udf(load, return_type=ArrayType(DoubleType()), batch_size=batch)


#: Words whose digits a worker keeps at hand.
WORDS = 1 << 16


def word_digits() -> Callable[[np.ndarray], np.ndarray]:
    """A model that needs no file: a text's words counted by the first digit of their MD5, of unit length; without words all zeros."""

    @functools.lru_cache(maxsize=WORDS)  # kept as long as the worker
    def digit(word: str) -> int:
        return int(hashlib.md5(word.encode()).hexdigest()[0], 16)

    def predict(texts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), 16))
        for row, text in enumerate(texts):
            for w in re.findall(r"\w+", (text or "").lower()):
                out[row, digit(w)] += 1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)

    return predict
