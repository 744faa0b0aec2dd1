"""Text columns: search text, tokens, coercion of raw values, model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that a clarification answer's tokens leave out, English, then Vietnamese without and with marks.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "is", "are",
    "was", "were", "it", "its", "this", "that", "with", "for", "co",
    "la", "va", "cua", "duoc", "thi", "ma", "cac", "nhung", "mot", "cai",
    "dang", "o", "voi", "cho", "roi", "thay",
    "có", "là", "và", "của", "được", "thì", "mà", "các", "những", "một",
    "cái", "đang", "ở", "với", "cho", "rồi", "thấy",
]

# Metadata keys whose values are searched, in this order.
METADATA_KEYS = ["title", "name", "description", "keywords", "category", "categories"]

# Answers that mean there is none, in upper case.
NO_ANSWER = ["UNKNOWN", "N/A", "NA", "NONE", "NULL"]


def join_parts(parts: list[Column], separator: str = " . ") -> Column:
    """Non-empty parts joined."""
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def metadata_text(meta: Column, keys: list[str] | None = None) -> Column:
    """Values of the keys (METADATA_KEYS) in order, joined by " . "; keys that are missing or empty are left out."""
    return join_parts([F.element_at(meta, F.lit(k)) for k in (METADATA_KEYS if keys is None else keys)])


def candidate_text(text_blob: Column, caption: Column, narrative: Column, ocr: Column, actions: Column, dets: Column) -> Column:
    """The search text, or else caption, narrative, OCR, actions (an array) and labels of detections; in lower case."""
    none = F.array().cast("array<string>")
    labels = F.filter(F.transform(dets, lambda d: d["label"]), lambda x: F.coalesce(x, F.lit("")) != "")
    parts = join_parts([caption, narrative, ocr, F.array_join(F.coalesce(actions, none), " "), F.array_join(F.coalesce(labels, none), " ")], " ")
    return F.lower(F.coalesce(F.nullif(text_blob, F.lit("")), parts))


def words(text: Column) -> Column:
    """Words of two letters or more, in lower case, as often as they occur."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    return F.filter(found, lambda w: F.length(w) >= 2)


def tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Distinct words of two letters or more that aren't stop words."""
    stop = STOP_WORDS if stop is None else stop
    if not stop:
        return F.array_distinct(words(text))
    return F.array_except(words(text), F.array(*[F.lit(w) for w in stop]))  # a set already


def frame_name(frame_idx: Column, timestamp: Column) -> Column:
    """frame_idx, or else the timestamp."""
    return F.coalesce(frame_idx.cast("string"), timestamp.cast("string"))


def frame_index(raw: Column) -> Column:
    """A finite, whole, non-negative number; anything else, true and false included, is null."""
    n = raw.cast("string").try_cast("double")
    good = (n >= 0) & (n < 9e15) & (n == F.floor(n)) & ~F.isnan(n)
    return F.when(good, n.cast("long"))


def seconds(raw: Column, other: Column | None = None) -> Column:
    """A finite, non-negative number of seconds; where raw is null, other counts."""
    raw = raw if other is None else F.coalesce(raw.cast("string"), other.cast("string"))
    n = raw.cast("string").try_cast("double")
    return F.when((n >= 0) & ~F.isnan(n) & (n < float("inf")), n)


def unfenced(raw: Column) -> Column:
    """A model response without a code fence: its first line goes if it opens one, and a closing one at the end."""
    opened = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```[^\n]*\n", ""), "^```", "")
    return F.trim(F.regexp_replace(opened, "```$", ""))


def first_score(raw: Column) -> Column:
    """The first number of a response, if it lies in [0, 1]."""
    n = F.regexp_extract(F.coalesce(raw, F.lit("")), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    return F.when((n >= 0) & (n <= 1), n)


def grounded(raw: Column) -> Column:
    """struct<valid, answer, confidence, reason> of a response that has to be a JSON object with found, answer, confidence.

    The first of these that applies is the reason: malformed_response, answer_not_found, missing_answer,
    unknown_answer, invalid_confidence, confidence_out_of_range; a valid response has none.
    """
    v = F.try_parse_json(unfenced(raw))
    kind = F.schema_of_variant(v)
    found = F.when(F.schema_of_variant(F.try_variant_get(v, "$.found", "variant")) == "BOOLEAN", F.try_variant_get(v, "$.found", "boolean"))
    text = F.when(F.schema_of_variant(F.try_variant_get(v, "$.answer", "variant")) == "STRING", F.trim(F.try_variant_get(v, "$.answer", "string")))
    has_bool = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.confidence", "variant")) == "BOOLEAN", F.lit(False))
    number = F.when(~has_bool, F.try_variant_get(v, "$.confidence", "string").try_cast("double"))
    reason = (
        F.when(v.isNull() | ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "malformed_response")
        .when(~F.coalesce(found, F.lit(False)), "answer_not_found")
        .when(F.coalesce(text, F.lit("")) == "", "missing_answer")
        .when(F.upper(text).isin(*NO_ANSWER), "unknown_answer")
        .when(number.isNull(), "invalid_confidence")
        .when(F.isnan(number) | (number < 0) | (number > 1), "confidence_out_of_range")
    )
    good = reason.isNull()
    return F.struct(good.alias("valid"), F.when(good, text).alias("answer"), F.when(good, number).otherwise(0.0).alias("confidence"), reason.alias("reason"))


def string_list(raw: Column, key: str, fallback: Column) -> Column:
    """The list of strings under key in a JSON response, without blanks; [fallback] if there is none."""
    found = F.from_json(unfenced(raw), f"struct<`{key}`: array<string>>")[key]
    kept = F.filter(found, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    return F.when(F.size(F.coalesce(kept, F.array().cast("array<string>"))) > 0, kept).otherwise(F.array(fallback))


def exactly(raw: Column, n: int) -> Column:
    """The non-blank strings under questions in a JSON response if there are exactly n, or else an empty list."""
    listed = F.try_variant_get(F.try_parse_json(unfenced(raw)), "$.questions", "array<variant>")
    text = F.transform(listed, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.trim(F.try_variant_get(x, "$", "string"))))
    kept = F.filter(text, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.size(kept) == n, kept).otherwise(F.array().cast("array<string>"))


def event_lists(raw: Column) -> Column:
    """P25: struct<actions, ordered_events> of a JSON response; what is missing or no list is empty.

    Actions are strings, events struct<action, time_sec>; entries of other kinds are null.
    """
    v = F.try_parse_json(unfenced(raw))
    listed = lambda key, kind: F.coalesce(F.try_variant_get(v, f"$.{key}", f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
    events = F.transform(listed("ordered_events", "variant"), lambda e: F.struct(F.try_variant_get(e, "$.action", "string").alias("action"), F.try_variant_get(e, "$.time_sec", "double").alias("time_sec")))
    return F.struct(listed("actions", "string").alias("actions"), events.alias("ordered_events"))


def public_payload(payload: Column) -> Column:
    """P10: a payload (map of strings) without local paths; frame_idx and timestamp in plain form, or left out if malformed."""
    idx, at = frame_index(payload["frame_idx"]).cast("string"), seconds(payload["timestamp"]).cast("string")
    kept = F.map_filter(payload, lambda k, _: ~k.isin("keyframe_path", "frame_path", "frame_idx", "timestamp"))
    own = lambda name, value: F.when(value.isNotNull(), F.create_map(F.lit(name), value)).otherwise(F.create_map().cast("map<string,string>"))
    return F.map_concat(kept, own("frame_idx", idx), own("timestamp", at))
