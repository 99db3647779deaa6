"""Column functions: geometry, labels, scores.  All are built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def scale_state(area: Column) -> Column:
    """Size class of a target by its share of the image; edges belong to the larger class."""
    return F.when(area < 0.01, "tiny").when(area < 0.03, "small").when(area < 0.1, "medium").otherwise("large")


def box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def box_iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Overlap over union of two boxes; 0 if the union is empty."""
    over = box_area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    return F.coalesce(F.try_divide(over, box_area(*a) + box_area(*b) - over), F.lit(0.0))


def pad_box(b: Sequence[Column], width: Column, height: Column, share: float = 0.05) -> list[Column]:
    """The box grown by ``share`` of its sides on each side and clipped to the frame."""
    dx, dy = (b[2] - b[0]) * share, (b[3] - b[1]) * share
    return [F.greatest(F.lit(0.0), b[0] - dx), F.greatest(F.lit(0.0), b[1] - dy), F.least(width, b[2] + dx), F.least(height, b[3] + dy)]


def third(c: Column, names: Sequence[str]) -> Column:
    """The third of the frame that a centre lies in."""
    return F.when(c < 1 / 3, names[0]).when(c < 2 / 3, names[1]).otherwise(names[2])


def eligible(row: Mapping[str, Column], min_confidence: float, min_area: float) -> Column:
    """A box that may be a target: confident, single, real, seen from outside, large enough."""
    return (row["confidence"] >= min_confidence) & ~row["is_group"] & ~row["is_depiction"] & ~row["is_inside"] & (box_area(row["x0"], row["y0"], row["x1"], row["y1"]) >= min_area)


def state_match(field: Column, op: str, value) -> Column:
    """``lt``, ``eq`` or ``contains`` (an element of a JSON list, else a part of the text)."""
    if op == "lt":
        return field < value
    if op == "eq":
        return field == value
    if op == "contains":
        return F.coalesce(F.array_contains(F.from_json(field, "array<string>"), value), F.contains(field, F.lit(value)))
    raise ValueError(f"unknown operator {op}")


def slices(conditions: Mapping[str, Column]) -> Column:
    """Names of the conditions that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def parse_values(c: Column) -> Column:
    """An empty, single or JSON list value as an array of strings; bad JSON gives an empty array."""
    none = F.array().cast("array<string>")
    return F.when(c.isNull() | (F.trim(c) == ""), none).when(F.startswith(F.trim(c), F.lit("[")), F.coalesce(F.from_json(c, "array<string>"), none)).otherwise(F.array(c))


def canonical_set(values: Column) -> Column:
    return F.concat_ws("|", F.array_sort(F.array_distinct(values)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; two empty sets are equal."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(1.0))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Probabilities, shifted by the largest logit."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    e = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def argmax(values: Column) -> Column:
    """Place of the first largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def deepgini(p: Column) -> Column:
    return 1 - F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x)


def mapped(value: Column, points: Mapping[str, float], unknown: Sequence[str] = ("unknown",)) -> Column:
    """Points of a value; unknown is null; a value outside the map is an error."""
    out = F.when(value.isNull() | value.isin(*unknown), F.lit(None).cast("double"))
    for k, v in points.items():
        out = out.when(value == k, F.lit(float(v)))
    return out.otherwise(F.raise_error(F.concat(F.lit("value without points: "), value)).cast("double"))


def interval(parts: Sequence[tuple[Column, float]], low: float = 0.0, high: float = 1.0) -> Column:
    """Weighted lower, upper and midpoint of scores in [low, high]; an unknown part spans all of it."""
    total = sum(w for _, w in parts)
    lower = sum((F.coalesce(v, F.lit(low)) * w for v, w in parts), F.lit(0.0)) / total
    upper = sum((F.coalesce(v, F.lit(high)) * w for v, w in parts), F.lit(0.0)) / total
    known = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts), F.lit(0.0)) / total
    return F.struct(lower.alias("lower"), upper.alias("upper"), ((lower + upper) / 2).alias("midpoint"), known.alias("known"))


def wilson(errors: Column, n: Column) -> Column:
    """95 % interval of a rate, clipped to [0, 1]; null without observations."""
    p, z2 = F.try_divide(errors.cast("double"), n), Z95 * Z95
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def sign_bits(v: Column, n: int = 64) -> Column:
    """The signs of the first ``n`` numbers as one whole number; the first is the lowest bit."""
    out = F.lit(0).cast("long")
    for i in range(n):
        out = out.bitwiseOR(F.shiftleft(F.when(v[i] > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"), i))
    return out
