"""Expressions over array columns, Column in, Column out."""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from affinity.schemas import DAYS, HOURS


UNROLLED = 16


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def one_hot_parts(idx: Column, n: int) -> list[Column]:
    """The cells of ``one_hot`` as three arrays to concatenate: zeros, the 1.0 if there is one, zeros."""
    inside, at = F.coalesce(idx.between(0, n - 1), F.lit(False)), idx.cast("int")
    before = F.when(inside, at).otherwise(F.lit(n))
    after = F.when(inside, F.lit(n - 1) - at).otherwise(F.lit(0))
    return [
        F.array_repeat(F.lit(0.0), before), F.array_repeat(F.lit(1.0), inside.cast("int")),
        F.array_repeat(F.lit(0.0), after)]


def one_hot(idx: Column, n: int) -> Column:
    """F1: ``n`` cells with 1.0 at ``idx``; all zero when ``idx`` is null or outside."""
    return F.concat(*one_hot_parts(idx, n))


def multi_hot(idxs: Column, n: int, value: Column | float = 1.0) -> Column:
    """``n`` cells holding ``value`` at each position listed in ``idxs``."""
    cell = value if isinstance(value, Column) else F.lit(float(value))
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.when(F.array_contains(idxs, i), cell).otherwise(F.lit(0.0)),
    )
    return F.when(F.size(idxs) > 0, cells).otherwise(zeros(n))


def time_blocks(day: Column, hour: Column) -> Column:
    """seven day cells (Monday first) followed by 24 hour cells."""
    return F.concat(one_hot(day, DAYS), one_hot(hour, HOURS))


def one_hot_position(features: Column, start: int, n: int) -> Column:
    """P5: position of the 1.0 within ``features[start, start+n)``; null if there is none."""
    if start == 0:  # nothing to cut off before it, so no cell is copied
        found = F.array_position(features, F.lit(1.0))
        return F.when(found.between(1, n), (found - 1).cast("int"))
    found = F.array_position(F.slice(features, start + 1, n), F.lit(1.0))
    return F.when(found > 0, (found - 1 + start).cast("int"))


def dot(x: Column, y: Column, size: int | None = None) -> Column:
    """scalar product.

    With a known small ``size`` the sum is written out term by term, which stays inside
    whole-stage codegen; a longer sum would outgrow what the JVM compiles, so it is a
    fold over the zipped arrays. A vector of another length than ``size`` is an error.
    """
    if size is not None and size <= UNROLLED:
        terms = [F.get(x, F.lit(i)).cast("double") * F.get(y, F.lit(i)).cast("double")
                 for i in range(size)]
        total = reduce(lambda a, b: a + b, terms, F.lit(0.0))
        other = F.when(F.size(x) == size, F.size(y)).otherwise(F.size(x))
        wrong = F.raise_error(F.concat(F.lit(f"expected {size}, got "), other.cast("string"), F.lit(" components")))
        fits = (F.size(x) == size) & (F.size(y) == size)
        return F.when(x.isNull() | y.isNull(), None).when(fits, total).otherwise(wrong)
    products = F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def magnitude(x: Column, size: int | None = None) -> Column:
    return F.sqrt(dot(x, x, size))


def cosine(x: Column, y: Column, size: int | None = None) -> Column:
    """cosine similarity; null when either side is the zero vector."""
    return F.try_divide(dot(x, y, size), magnitude(x, size) * magnitude(y, size))


def split_list(text: Column, sep: str, kind: str = "string") -> Column:
    """F8: ``a:b:c`` to an array of ``kind``; cells that do not parse become null."""
    parts = F.split(text, re.escape(sep))
    if kind == "string":
        return parts
    return F.transform(parts, lambda p: F.trim(p).try_cast(kind))


def join_list(values: Column, sep: str = ",") -> Column:
    """F8: array to one string."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), sep)


def zip_pairs(left: Column, right: Column, names=("user", "item")) -> Column:
    """Pair two lists by position, cut to the shorter; an array of structs."""
    n = F.least(F.size(left), F.size(right))
    return F.zip_with(
        F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n),
        lambda a, b: F.struct(a.alias(names[0]), b.alias(names[1])),
    )
