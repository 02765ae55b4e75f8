"""Exact quantiles of any number of distinct values: histograms narrow each rank's range, so no task holds the values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_statistics(df: DataFrame, column: str, ranks: list[int], bins: int = 1024) -> dict[int, float]:
    """The values at some ranks (from 0), all narrowed in the same passes; a pass gives back ``bins`` rows a rank at most."""
    value = F.col(column).cast("double")
    rows = df.select(value.alias("x")).filter("x is not null")
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    # range -> (values below it, ranks in it)
    active: dict[tuple[float, float], tuple[int, list[int]]] = {(low, high): (0, sorted(set(ranks)))}
    found: dict[int, float] = {}
    while active:
        place = F.lit(None).cast("struct<r: int, b: int>")
        spans = list(active)
        for i, (lo, hi) in enumerate(spans):
            width = (hi - lo) / bins
            b = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).cast("int") if width > 0 and lo + width > lo else F.when(F.col("x") == lo, 0).otherwise(1)
            place = F.when((F.col("x") >= lo) & (F.col("x") <= hi), F.struct(F.lit(i).alias("r"), b.alias("b"))).otherwise(place)
        counted = rows.select("x", place.alias("p")).filter("p is not null").groupBy("p.r", "p.b").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        following: dict[tuple[float, float], tuple[int, list[int]]] = {}
        for i, span in enumerate(spans):
            below, wanted = active[span]
            for c in sorted((c for c in counted if c["r"] == i), key=lambda c: c["lo"]):
                inside = [k for k in wanted if below <= k < below + c["n"]]
                if inside and c["lo"] == c["hi"]:
                    found |= dict.fromkeys(inside, c["lo"])
                elif inside:
                    following[c["lo"], c["hi"]] = (below, inside)
                below += c["n"]
        active = following
    return found


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Quantiles with values between two ranks interpolated; None without values. Nulls don't count."""
    n = df.filter(F.col(column).isNotNull()).count()
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    known = order_statistics(df, column, sorted({r for x in at for r in (math.floor(x), math.ceil(x))}))
    return [known[math.floor(x)] + (x - math.floor(x)) * (known[math.ceil(x)] - known[math.floor(x)]) for x in at]
