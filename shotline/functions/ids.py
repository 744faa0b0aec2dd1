"""Stable identifiers: the same video and shot or frame always get the same UUID (version 5, URL namespace)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def shot_key(video: Column, scene: Column, official: Column | None = None) -> Column:
    """video:official, or else video:shot:000000."""
    own = F.format_string("shot:%06d", scene.cast("int"))
    return F.concat_ws(":", video, own if official is None else F.coalesce(F.nullif(official, F.lit("")), own))


def frame_key(video: Column, frame_idx: Column, timestamp: Column, ordinal: Column) -> Column:
    """video:frame index, or else video:timestamp:ordinal."""
    return F.concat_ws(":", video, F.coalesce(frame_idx.cast("string"), F.format_string("%.6f:%d", timestamp, ordinal)))


def uuid5(name: Column) -> Column:
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "utf-8"))), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
