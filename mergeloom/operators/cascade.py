"""The verification cascade: cheap tests on metadata first, comparison of contents on what is left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two equally long arrays."""
    n = F.size(a)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x) / n


def shrink(values: Column, blocks: int, width: int) -> Column:
    """Means of ``blocks`` consecutive runs of ``width`` values."""
    return F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.aggregate(F.slice(values, i * width + 1, width), F.lit(0.0), lambda acc, x: acc + x.cast("double")) / width)


def worst_tile(a: Column, b: Column, tiles: int, width: int) -> Column:
    """The largest mean absolute difference of any tile: a local change that the whole would average away."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda i: mean_difference(F.slice(a, i * width + 1, width), F.slice(b, i * width + 1, width))))


def deviation(values: Column) -> Column:
    """Population standard deviation of an array."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double")) / n
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x.cast("double") - mean) * (x.cast("double") - mean)) / n)


def strict_outcome(moment_a: Column, moment_b: Column, shape_a: Column, shape_b: Column, flat: Column, hi: Column, lo: Column, slope_limit: float, near: float, shape_limit: float = 0.02) -> Column:
    """confirm, review, reject, burst or unverifiable for a pair of stills, by the guards in order.

    Two different moments are a burst. Shapes that differ are rejected; unknown ones don't object. A featureless
    picture without a moment can't be verified. Detail that vanishes when both are shrunk (slope) is another
    picture; a small difference at full size confirms, a larger one is for a person."""
    ratio = F.abs(shape_a - shape_b) / F.greatest(shape_a, shape_b)
    return (
        F.when(moment_a.isNotNull() & moment_b.isNotNull() & (moment_a != moment_b), "burst")
        .when(F.coalesce(ratio > shape_limit, F.lit(False)), "reject")
        .when(flat & (moment_a.isNull() | moment_b.isNull()), "unverifiable")
        .when(hi.isNull(), "unverifiable")
        .when(hi - lo > slope_limit, "reject")
        .when(hi <= near, "confirm")
        .otherwise("review")
    )


def lenient_outcome(gap_hours: Column, distance_km: Column, same_camera: Column, gap_seconds: Column, same_shape: Column, likeness: Column, flat: Column, tile: Column, close_hash: Column, inliers: Column) -> Column:
    """CONFIRM, BURST, REVIEW or REJECT of a pair by the wider cascade; likeness, tile and inliers are features, null if unreadable."""
    shape = F.coalesce(same_shape, F.lit(False))
    fingerprint = F.coalesce(same_camera & (gap_seconds <= 2), F.lit(False))
    return (
        F.when(F.coalesce(gap_hours > 24, F.lit(False)) | F.coalesce(distance_km > 5, F.lit(False)), "REJECT")
        .when(fingerprint & shape, F.when(likeness.isNull(), "REVIEW").when(likeness >= 0.985, "CONFIRM").otherwise("BURST"))
        .when(F.coalesce(flat, F.lit(False)), F.when(tile.isNull(), "REVIEW").when(tile > 10, "REJECT").otherwise("CONFIRM"))
        .when(shape & (likeness >= 0.95), "CONFIRM")
        .when((~shape | close_hash) & (inliers >= 30), F.when(shape, "CONFIRM").otherwise("REVIEW"))
        .when(likeness >= 0.95, "REVIEW")
        .otherwise("REJECT")
    )


def recording_outcome(stream_a: Column, stream_b: Column, frames_a: Column, frames_b: Column, limit: int = 8) -> Column:
    """confirm, review or reject of a pair of recordings: equal streams, else frames at most ``limit`` bits apart, one by one."""
    far = F.array_max(F.zip_with(frames_a, frames_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))))
    readable = (F.size(frames_a) > 0) & (F.size(frames_a) == F.size(frames_b))
    return F.when(stream_a == stream_b, "confirm").when(~F.coalesce(readable, F.lit(False)), "review").when(far <= limit, "confirm").otherwise("reject")
