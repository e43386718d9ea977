"""Nearest neighbours in the plane: a pyramid of grid cells with counts, searched from coarse to fine within a distance bound.

A cell knows how many targets it holds and the box they fill. The far corner of any such box bounds a point's
distance, and a cell whose box begins beyond the bound is left alone; what is left is divided by sixteen, until a
cell holds few targets. Points and cells meet by equality, level by level, so neither far points nor crowded places
make all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Targets of a cell that is not divided, cells along a side that a cell is divided into, and levels at most.
FEW, SIDE, DEPTH = 32, 4, 14


def _placed(x: str, y: str) -> Column:
    return F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)


def _same(keys: Sequence[str], other: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, other)], F.lit(True))


def nearest(points: DataFrame, targets: DataFrame, keys: Sequence[str], ids: Sequence[str], px: str, py: str, carried: Sequence[str], tx: str, ty: str, few: int = FEW) -> DataFrame:
    """``keys, ids, d2`` and the ``carried`` columns of the nearest target with the same keys; of equal ones the least.

    Rows of ``points`` that repeat are one. Points and targets without coordinates, and points whose keys have no
    target, are not in the result. Targets that all lie in one place are one cell and are compared together.
    """
    p = points.where(_placed(px, py)).select(*keys, *ids, F.col(px).cast("double").alias("_px"), F.col(py).cast("double").alias("_py")).distinct()
    t = targets.where(_placed(tx, ty)).select(*keys, F.struct(*carried).alias("_t"), F.col(tx).cast("double").alias("_x"), F.col(ty).cast("double").alias("_y"))
    box = t.groupBy(*keys).agg(F.min("_x").alias("_x0"), F.min("_y").alias("_y0"), F.greatest(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y")).alias("_w"))
    live = cut_lineage(t.join(box, list(keys)) if keys else t.crossJoin(F.broadcast(box)))  # without keys the box is one row
    pairs = p.join(box.select(*keys), list(keys)) if keys else p
    pairs = cut_lineage(pairs.withColumns({"_cx": F.lit(0).cast("long"), "_cy": F.lit(0).cast("long"), "_bound": F.lit(float("inf"))}))
    point = [*keys, *ids, "_px", "_py"]
    held, reached = [], []
    for level in range(DEPTH + 1):
        step = F.greatest(F.col("_w"), F.lit(1e-300)) / float(SIDE**level)
        place = lambda c, c0: F.least(F.floor((F.col(c) - F.col(c0)) / step), F.lit(SIDE**level - 1)).cast("long")
        live = live.withColumns({"_cx": place("_x", "_x0"), "_cy": place("_y", "_y0")})
        cells = live.groupBy(*keys, "_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"_{n}{c[1]}") for c in ("_x", "_y") for f, n in ((F.min, "lo"), (F.max, "hi"))])
        whole = (F.col("_n") <= few) | ((F.col("_lox") == F.col("_hix")) & (F.col("_loy") == F.col("_hiy"))) | F.lit(level == DEPTH)
        cells = cut_lineage(cells.withColumn("_leaf", whole))
        parents = cells.withColumns({"_ux": F.floor(F.col("_cx") / SIDE), "_uy": F.floor(F.col("_cy") / SIDE)}) if level else cells.withColumns({"_ux": F.col("_cx"), "_uy": F.col("_cy")})
        met = pairs.withColumnsRenamed({"_cx": "_ux", "_cy": "_uy"}).join(parents, [*keys, "_ux", "_uy"])
        outside = lambda p, c: F.greatest(F.col(f"_lo{c}") - F.col(p), F.col(p) - F.col(f"_hi{c}"), F.lit(0.0))
        across = lambda p, c: F.greatest(F.abs(F.col(f"_lo{c}") - F.col(p)), F.abs(F.col(f"_hi{c}") - F.col(p)))
        from_, upto = (F.pow(f("_px", "x"), 2) + F.pow(f("_py", "y"), 2) for f in (outside, across))
        met = met.withColumns({"_from": from_, "_upto": upto})
        bounds = met.groupBy(*point).agg(F.least(F.min("_bound"), F.min("_upto")).alias("_new"))
        # a hair of room, as the bound and the distance are rounded apart
        near = met.join(bounds.withColumnsRenamed({c: f"_{c}_" for c in point}), _same(point, [f"_{c}_" for c in point])).where(F.col("_from") <= F.col("_new") * (1 + 1e-12))
        near = cut_lineage(near.select(*point, "_cx", "_cy", F.col("_new").alias("_bound"), "_from", "_leaf"))
        reached.append(near.where("_leaf").select(*point, F.lit(level).alias("_level"), "_cx", "_cy", "_bound", "_from"))
        flags = cells.select(*keys, "_cx", "_cy", "_leaf")
        live = live.join(flags, [*keys, "_cx", "_cy"])
        held.append(live.where("_leaf").select(*keys, F.lit(level).alias("_level"), "_cx", "_cy", "_t", "_x", "_y"))
        pairs = near.where("not _leaf").select(*point, "_cx", "_cy", "_bound")
        if pairs.isEmpty():
            break
        live = cut_lineage(live.where("not _leaf").drop("_leaf"))
    asked = cut_lineage(reduce(DataFrame.unionByName, reached))
    last = asked.groupBy(*point).agg(F.min("_bound").alias("_last"))
    asked = asked.join(last.withColumnsRenamed({c: f"_{c}_" for c in point}), _same(point, [f"_{c}_" for c in point])).where(F.col("_from") <= F.col("_last") * (1 + 1e-12))
    found = asked.select(*point, "_level", "_cx", "_cy").join(reduce(DataFrame.unionByName, held), [*keys, "_level", "_cx", "_cy"])
    d2 = F.pow(F.col("_px") - F.col("_x"), 2) + F.pow(F.col("_py") - F.col("_y"), 2)
    best = found.groupBy(*point).agg(F.min(F.struct(d2.alias("d2"), F.col("_t").alias("t"))).alias("_b"))
    return best.select(*keys, *ids, F.col("_b.d2").alias("d2"), "_b.t.*")
