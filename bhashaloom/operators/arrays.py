"""Arithmetic on numeric arrays: checks, summaries, softmax, top-k, loss and draws."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def total(values: Column) -> Column:
    """Sum; 0 of an empty array."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def invalid_count(values: Column) -> Column:
    """Elements that are null, NaN or infinite."""
    return F.size(F.filter(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def gather(values: Column, positions: Column) -> Column:
    """The elements at some positions, from 0, in their order; null where there is none."""
    return F.transform(positions, lambda i: F.get(values, i))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A value by name within an expression, so that it is worked out once for each row and not for each element."""
    return F.transform(F.array(value), body)[0]


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def deviation(values: Column) -> Column:
    """Sample standard deviation."""
    squares = let(F.struct(values.alias("v"), mean(values).alias("m")), lambda s: total(F.transform(s["v"], lambda x: (x - s["m"]) * (x - s["m"]))))
    return F.sqrt(squares / (F.size(values) - 1))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities; the largest logit is taken off first. Minus infinity gives 0."""
    with_largest = F.struct(logits.alias("v"), F.array_max(logits).alias("m"))
    powers = let(with_largest, lambda s: F.transform(s["v"], lambda x: F.exp((x - s["m"]) / temperature)))
    return let(powers, lambda p: let(F.struct(p.alias("p"), total(p).alias("t")), lambda s: F.transform(s["p"], lambda x: x / s["t"])))


def top_k_mask(logits: Column, k: int) -> Column:
    """Logits below the k-th largest as minus infinity; ties with it stay."""
    bound = F.element_at(F.sort_array(logits, asc=False), F.least(F.lit(k), F.size(logits)))
    both = F.struct(logits.alias("v"), bound.alias("b"))
    return let(both, lambda s: F.transform(s["v"], lambda x: F.when(x < s["b"], F.lit(float("-inf"))).otherwise(x)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Negative log-probability of the target; null where the target is -1, which means to ignore."""
    with_largest = F.struct(logits.alias("v"), F.array_max(logits).alias("m"))
    log_sum = let(with_largest, lambda s: F.ln(total(F.transform(s["v"], lambda x: F.exp(x - s["m"])))) + s["m"])
    return F.when(target != -1, log_sum - F.element_at(logits, (target + 1).cast("int")))


def draw(probabilities: Column, uniform: Column) -> Column:
    """Position, from 0, whose band of the running sum holds a uniform number."""
    folded = F.aggregate(
        probabilities,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at")),
        lambda a, p: F.struct((a["sum"] + p).alias("sum"), F.when(a["sum"] + p <= uniform, a["at"] + 1).otherwise(a["at"]).alias("at")),
    )
    return F.least(folded["at"], F.size(probabilities) - 1)
