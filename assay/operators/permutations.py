"""Orders of options by number, and answers brought back to the question's own order. Array expressions only.

An order of k options is a number below k! in mixed radix (a Lehmer code): each digit says which of the
options that are left comes next. 0 is the order as it stands.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import prob

from .resample import seeded

#: Factorials of more options don't fit 48 bits of a hash.
MOST = 15


def order_of(code: Column, k: Column) -> Column:
    """The options (from 0) in the order that ``code`` numbers; ``k`` is 1 at least."""
    all_ = F.sequence(F.lit(0), k.cast("int") - 1)
    start = F.struct(all_.alias("rest"), F.array().cast("array<int>").alias("out"), code.cast("bigint").alias("n"))

    def step(a, _):
        left = F.size(a["rest"])
        digit = F.pmod(a["n"], left).cast("int")
        rest = F.filter(a["rest"], lambda _, j: j != digit)
        return F.struct(rest.alias("rest"), F.concat(a["out"], F.array(F.get(a["rest"], digit))).alias("out"), F.floor(a["n"] / left).cast("bigint").alias("n"))

    return F.aggregate(all_, start, step, lambda a: a["out"])


def other_code(seed: str, k: Column, *parts: Column | str) -> Column:
    """A seeded number of an order other than the one as it stands; 0 for fewer than two options, null beyond ``MOST``."""
    orders = F.element_at(F.array(*[F.lit(math.factorial(i)) for i in range(1, MOST + 1)]), k.cast("int"))
    number = F.conv(F.substring(seeded(seed, *parts), 1, 12), 16, 10).cast("bigint")
    return F.when(k < 2, 0).when(k <= MOST, 1 + F.pmod(number, orders - 1))


def presented(values: Column, order: Column) -> Column:
    """Values of options in the order in which they are shown."""
    return F.transform(order, lambda o: F.get(values, o))


def realigned(shown: Column, order: Column) -> Column:
    """Values of shown options back in the question's own order: the inverse of ``presented``."""
    return F.transform(order, lambda _, i: F.get(shown, (F.array_position(order, i.cast("int")) - 1).cast("int")))


def sensitivity(rows: DataFrame, by: str, base: str = "p", other: str = "q") -> DataFrame:
    """(by, n, flips, flip_rate, mean_tv, large_changes) of realigned answers against those to the order as it stands."""
    p, q = F.col(base), F.col(other)
    flip = prob.argmax(p) != prob.argmax(q)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(flip).alias("flips"), (F.count_if(flip) / F.count("*")).alias("flip_rate"), F.avg(prob.total_variation(p, q)).alias("mean_tv"), F.count_if(prob.drift(p, q) > 0.5).alias("large_changes"))
