"""Cells of a plan with many axes, drawn by hash: no product of axes is ever made.

A row's hash is read in mixed radix, two digits for each axis: one picks a column of the axis's alias table, the
other tells whether the column's own value or its alias is taken. Weights are whole numbers and tables are exact,
so values come in the declared shares but for the hash's own chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resample import seeded

#: Digits read from one hash multiply to this at most: 60 bits are drawn, so that no value gains more than 2 ** -16 of its share.
RADIX = 1 << 44


def alias_table(weights: list[int]) -> tuple[list[int], list[int]]:
    """(own, alias) for each column: below ``own``, of as many as all weights sum to, the column's own value is taken."""
    if not weights or min(weights) < 0 or not sum(weights):
        raise ValueError("weights: whole numbers, none negative, one positive at least")
    total, own, alias = sum(weights), [w * len(weights) for w in weights], list(range(len(weights)))
    small, large = [i for i, w in enumerate(own) if w < total], [i for i, w in enumerate(own) if w > total]
    while small:
        i, j = small.pop(), large[-1]
        alias[i] = j
        own[j] -= total - own[i]
        if own[j] <= total:
            large.pop()
            if own[j] < total:
                small.append(j)
    return own, alias


def digits(radices: list[int]) -> list[tuple[int, int, int]]:
    """(hash, divisor, radix) of each digit: which hash it is read from, and what was read before it."""
    out, number, before = [], 0, 1
    for r in radices:
        if before > 1 and before * r > RADIX:
            number, before = number + 1, 1
        out.append((number, before, r))
        before *= r
    return out


def draw(rows: DataFrame, id_col: str, axes: dict[str, dict[str, int]], seed: str = "42") -> DataFrame:
    """``rows`` with a column for each axis: one of its values, in the declared weights, by seed and id alone.

    Rows that share an id get the same cell; a null id is one id.
    """
    tables = {name: (list(values), *alias_table(list(values.values()))) for name, values in axes.items()}
    read = digits([r for values in axes.values() for r in (len(values), sum(values.values()))])
    number = lambda n: F.conv(F.substring(seeded(seed, F.lit(str(n)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")
    hashes: dict[int, Column] = {n: number(n) for n in {d[0] for d in read}}
    digit = lambda d: F.pmod(F.call_function("div", hashes[d[0]], F.lit(d[1])), F.lit(d[2]))
    columns = {}
    for i, (name, (values, own, alias)) in enumerate(tables.items()):
        at, coin = digit(read[2 * i]).cast("int"), digit(read[2 * i + 1])
        lits = lambda xs: F.array(*[F.lit(x) for x in xs])
        taken = F.when(coin < F.get(lits(own), at), at).otherwise(F.get(lits(alias), at))
        columns[name] = F.get(lits(values), taken)
    return rows.withColumns(columns)

