"""Temporal splits, expanding folds and repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.functions.scalar import HOUR_US, micros
from vigia.operators.ordered import ordered_counts, rows_at, rows_at_places


def temporal_split(df: DataFrame, time: str = "Fim", train: float = 0.70, val: float = 0.15, embargo_hours: float = 4.0, times: DataFrame | None = None) -> DataFrame:
    """Rows with ``split``: train, val, test, or null for the embargo before a boundary and rows without a time.

    Boundaries are the times of the rows at the two shares, exact order statistics; rows at a boundary's time are on
    its right side. ``times`` is a table with the times of the same rows that is cheaper to read.
    """
    given = df if times is None else times
    n, found = rows_at(ordered_counts(given.select(micros(given, time).alias("us")), ["us"]), ["us"], [train, train + val])
    if not n:
        raise ValueError("there are no rows with a time")
    (first,), (second,) = found
    us, gap = micros(df, time), int(embargo_hours * HOUR_US)
    label = (
        F.when(us < first - gap, "train")
        .when((us >= first) & (us < second - gap), "val")
        .when(us >= second, "test")
    )
    return df.withColumn("split", label)


def split_metadata(split: DataFrame, time: str = "Fim") -> DataFrame:
    """``split, rows, start, end``; ``embargo`` has the dropped rows. Raises if a split is empty."""
    out = split.where(F.col(time).isNotNull()).groupBy(F.coalesce("split", F.lit("embargo")).alias("split")).agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("start"), F.max(time).alias("end"))
    missing = {"train", "val", "test"} - {r["split"] for r in out.select("split").collect()}
    if missing:
        raise ValueError(f"empty splits: {sorted(missing)}; use a smaller embargo or more data")
    return out


def backtest_folds(df: DataFrame, time: str = "Fim", folds: int = 3, start: float = 0.50, val: float = 0.10, test: float = 0.10, embargo_hours: float = 4.0) -> DataFrame:
    """Expanding folds: rows with ``fold`` and ``split``; a row may be in several folds.

    Parts are cut at places in order of time and ``Id``; a tie at a cut is parted by ``Id``.
    """
    keyed, us = df.where(F.col(time).isNotNull()), micros(df, time)
    counts = ordered_counts(keyed.select(us.alias("us"), "Id"), ["us", "Id"])
    n = counts.agg(F.max("total")).first()[0] or 0
    if n < 30:
        raise ValueError("too few rows for backtesting")
    step = (1.0 - start - val - test) / max(folds - 1, 1)
    n_val, n_test = max(int(n * val), 1), max(int(n * test), 1)
    cuts = []
    for k in range(folds):
        a = int(n * (start + k * step))
        b = min(a + n_val, n - n_test)
        c = min(b + n_test, n)
        if 0 < a < b < c <= n:
            cuts.append((k, a, b, c))
    if not cuts:
        raise ValueError("no fold is possible")
    places = sorted({p for cut in cuts for p in cut[1:] if p < n})
    bounds = dict(zip(places, rows_at_places(counts, ["us", "Id"], places), strict=True))

    def before(place: int) -> Column:
        if place >= n:
            return F.lit(True)
        t, i = bounds[place]
        return (us < t) | ((us == t) & (F.col("Id") < i))

    gap = int(embargo_hours * HOUR_US)
    out = None
    for k, a, b, c in cuts:
        label = F.when(before(a), F.when(us < bounds[a][0] - gap, "train")).when(before(b), F.when(us < bounds[b][0] - gap, "val")).when(before(c), "test")
        fold = keyed.withColumns({"fold": F.lit(k), "split": label}).where("split is not null")
        out = fold if out is None else out.unionByName(fold)
    return out


def repeatable_sample(df: DataFrame, rows: int, seed: int = 42, key: str = "Id") -> DataFrame:
    """At most so many rows, the same ones each time: those with the smallest hash of key and seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(rows)
