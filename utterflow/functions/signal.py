"""Sample arrays, vectors, frames and seconds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SAMPLE_RATE


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine in double precision; 0 where a vector has no length. Norms may be given, computed once per vector."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def to_unit_score(s: Column) -> Column:
    return F.least(F.greatest((s + 1) / 2, F.lit(0.0)), F.lit(1.0))


def center(x: Column, mean: Column, std: Column) -> Column:
    moved = F.zip_with(x, mean, lambda a, m: a.cast("double") - m)
    return F.zip_with(moved, std, lambda a, s: a / (s + F.lit(1e-12)))


def length_normalise(x: Column) -> Column:
    n = norm(x)
    return F.when(n > 0, F.transform(x, lambda v: v.cast("double") / n)).otherwise(x.cast("array<double>"))


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def right_pad(x: Column, width: Column, value: Column) -> Column:
    return F.concat(x, F.array_repeat(value, F.greatest(width - F.size(x), F.lit(0)).cast("int")))


def seconds(frames: Column, rate: int = SAMPLE_RATE) -> Column:
    return frames / F.lit(float(rate))


def hours(frames: Column, rate: int = SAMPLE_RATE) -> Column:
    return seconds(frames, rate) / F.lit(3600.0)


def frame_span(start_s: Column, end_s: Column, rate: int = SAMPLE_RATE) -> Column:
    """First frame and end frame of a time span."""
    return F.struct(F.floor(start_s * rate).alias("start_frame"), F.ceil(end_s * rate).alias("end_frame"))


def span_in_audio(start_frame: Column, end_frame: Column, num_frames: Column) -> Column:
    return F.coalesce((start_frame >= 0) & (end_frame > start_frame) & (end_frame <= num_frames), F.lit(False))


def loss_weights(losses: list[Column], kind: str = "min") -> list[Column]:
    """Each loss's factor that brings it to the least ("min") or greatest ("max") of them."""
    if kind not in ("min", "max"):
        raise ValueError(f"unknown kind {kind}")
    level = (F.least if kind == "min" else F.greatest)(*losses)
    return [level / x for x in losses]
