"""Exact quantiles of many columns without gathering any of them.

A sketch brackets each wanted rank; what lies below the bracket is counted, and the distinct values inside come with
their counts. A bracket with too many values is narrowed by the next sketch, so what reaches the driver is bounded
and no task holds a column, however long it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Error of the sketches as a share of the rows that they see, distinct values of a bracket that are looked at one by one, and times
#: that a bracket with more of them is narrowed: each leaves some 4 / ACCURACY of its values, so four times are enough for any table.
ACCURACY, FEW, TIMES = 1000, 20_000, 4


def exact_quantiles(df: DataFrame, values: dict[str, Column], shares: tuple[float, ...]) -> dict[str, tuple[int, list[float | None]]]:
    """For each name: how many values there are, and its quantiles, interpolated linearly between neighbouring ranks.

    Nulls and NaN count for nothing; without any value all quantiles are null. Columns of FEW distinct values or fewer
    are settled by one more pass, in which tasks count these; the others by brackets.
    """
    names = list(values)
    number = {c: F.nanvl(values[c].cast("double"), F.lit(None).cast("double")) for c in names}
    reach = [max(0.0, min(1.0, s + d)) for s in shares for d in (-2 / ACCURACY, 2 / ACCURACY)]
    first = df.agg(*[x for i, c in enumerate(names) for x in (F.count(number[c]).alias(f"n{i}"), F.percentile_approx(number[c], reach, ACCURACY).alias(f"q{i}"), F.min(number[c]).alias(f"a{i}"), F.max(number[c]).alias(f"b{i}"), F.approx_count_distinct(number[c]).alias(f"k{i}"))]).first()
    # a task for each rank that is wanted: column, rank, bracket
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], tuple[float, float]] = {}
    for i, c in enumerate(names):
        n = first[f"n{i}"]
        for k, s in enumerate(shares if n else ()):
            low = first[f"a{i}"] if s <= 2 / ACCURACY else first[f"q{i}"][2 * k]
            high = first[f"b{i}"] if s >= 1 - 2 / ACCURACY else first[f"q{i}"][2 * k + 1]
            for rank in {math.floor(s * (n - 1)), math.ceil(s * (n - 1))}:
                open_[c, rank] = (low, high)
    few = [(c, rank) for c, rank in open_ if first[f"k{names.index(c)}"] <= FEW]
    if few:
        # the value at a rank is the first up to which there are so many
        at = [F.expr(f"percentile_disc({(rank + 0.5) / first[f'n{names.index(c)}']!r}D) WITHIN GROUP (ORDER BY v{names.index(c)})").alias(f"x{j}") for j, (c, rank) in enumerate(few)]
        told = df.select(*[number[c].alias(f"v{i}") for i, c in enumerate(names)]).agg(*at).first()
        for j, key in enumerate(few):
            found[key] = told[f"x{j}"]
            del open_[key]
    turn = 0
    while open_:
        turn += 1
        wanted = {(c, *bracket) for (c, _), bracket in open_.items()}
        keys = sorted(wanted)
        inside = lambda key: number[key[0]].between(key[1], key[2])
        counts = df.agg(*[x for j, key in enumerate(keys) for x in (F.count_if(number[key[0]] < key[1]).alias(f"b{j}"), F.count_if(inside(key)).alias(f"n{j}"))]).first()
        many = [j for j, key in enumerate(keys) if key[1] < key[2] and counts[f"n{j}"] > FEW]
        kinds = df.agg(*[F.approx_count_distinct(F.when(inside(keys[j]), number[keys[j][0]])).alias(f"d{j}") for j in many]).first() if many else {}
        small = [j for j, key in enumerate(keys) if key[1] < key[2] and (j not in many or kinds[f"d{j}"] <= FEW or turn > TIMES)]
        held: dict[int, list[tuple[float, int]]] = {j: [(key[1], counts[f"n{j}"])] for j, key in enumerate(keys) if key[1] == key[2]}
        if small:
            rows = F.array_compact(F.array(*[F.when(inside(keys[j]), F.struct(F.lit(j).alias("j"), number[keys[j][0]].alias("x"))) for j in small]))
            any_inside = F.coalesce(*[F.when(inside(keys[j]), True) for j in small], F.lit(False))
            some = df.filter(any_inside).select(F.explode(rows).alias("r")).groupBy("r.j", "r.x").agg(F.count(F.lit(1)).alias("n"))
            held |= {j: [] for j in small}
            for r in some.collect():  # FEW for each task at most
                held[r["j"]].append((r["x"], r["n"]))
        large = [j for j in range(len(keys)) if j not in held]
        if large:
            asked = {j: [min(1.0, max(0.0, (rank - counts[f"b{j}"] + 0.5) / counts[f"n{j}"] + d)) for (c, rank), b in open_.items() if (c, *b) == keys[j] for d in (-2 / ACCURACY, 2 / ACCURACY)] for j in large}
            sketch = df.agg(*[F.percentile_approx(F.when(inside(keys[j]), number[keys[j][0]]), asked[j], ACCURACY).alias(f"q{j}") for j in large]).first()
        left = {}
        for (c, rank), bracket in open_.items():
            j = keys.index((c, *bracket))
            if j not in held:
                at = [rank_ for (c_, rank_), b in open_.items() if (c_, *b) == keys[j]].index(rank)
                low, high = sketch[f"q{j}"][2 * at : 2 * at + 2]
                left[c, rank] = (bracket[0] if asked[j][2 * at] == 0 else low, bracket[1] if asked[j][2 * at + 1] == 1 else high)
                continue
            ahead = counts[f"b{j}"]
            for x, n in sorted(held[j]):
                if ahead <= rank < ahead + n:
                    found[c, rank] = x
                ahead += n
            if (c, rank) not in found:  # the sketch erred by more than it promises: look at everything on that side
                i = names.index(c)
                left[c, rank] = (first[f"a{i}"], bracket[0]) if rank < counts[f"b{j}"] else (bracket[1], first[f"b{i}"])
        open_ = left
    out = {}
    for i, c in enumerate(names):
        n, own = first[f"n{i}"], []
        for s in shares:
            at = s * (n - 1)
            own.append(found[c, math.floor(at)] + (at - math.floor(at)) * (found[c, math.ceil(at)] - found[c, math.floor(at)]) if n else None)
        out[c] = (n, own)
    return out
