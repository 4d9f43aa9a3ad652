"""Encodings of categories that are fitted on training rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigia.functions.scalar import micros
from vigia.operators.ordered import ordered_counts, rows_at_places

TARGET = "target_4h"
ONE_HOT = ("Frota", "Tipo")
#: Lookup tables with more rows than this are joined by a shuffle.
MAX_SENT_ROWS = 200_000


def frequencies(train: DataFrame, column: str) -> DataFrame:
    """``value, freq``: share of each value among rows where the column isn't null."""
    known = train.where(F.col(column).isNotNull())
    counted = known.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(known.agg(F.count(F.lit(1)).alias("all")))).select("value", (F.col("n") / F.col("all")).alias("freq"))


def target_means(train: DataFrame, column: str = "Classe") -> DataFrame:
    """``value, enc``: mean target of each value; null is a value of its own."""
    return train.groupBy(F.col(column).alias("value")).agg(F.avg(TARGET).alias("enc"))


def fit_encoder(train: DataFrame) -> dict[str, DataFrame]:
    """Lookup tables: frequencies of tag and operator, target means of the class with the global mean, categories."""
    operator = "Matricula_Operador_Hash"
    tables = {"Tag_freq": frequencies(train, "Tag"), "Classe_target_enc": target_means(train), "global": train.agg(F.avg(TARGET).alias("mean"))}
    if operator in train.columns:
        tables["Operador_freq"] = frequencies(train, operator)
    found = [train.where(F.col(c).isNotNull()).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")).distinct() for c in ONE_HOT]
    tables["categories"] = found[0].unionByName(found[1])
    return tables


def encoder_summary(encoder: dict[str, DataFrame]) -> DataFrame:
    """Number of fitted values for each table, and the global mean."""
    mean = encoder["global"].select(F.lit("global").alias("tabela"), F.lit(1).cast("long").alias("valores"), F.round("mean", 6).alias("media"))
    for name, column in (("Tag_freq", "freq"), ("Classe_target_enc", "enc")):
        mean = mean.unionByName(encoder[name].agg(F.lit(name).alias("tabela"), F.count(F.lit(1)).alias("valores"), F.round(F.avg(column), 6).alias("media")).select("tabela", "valores", "media"))
    return mean


def _look_up(df: DataFrame, table: DataFrame, column: str, value: str, name: str, default: Column) -> DataFrame:
    table = table.select(F.col("value").alias("_value"), F.col(value).alias("_found"))
    table = F.broadcast(table) if table.count() <= MAX_SENT_ROWS else table
    joined = df.join(table, df[column].eqNullSafe(F.col("_value")), "left")
    return joined.withColumn(name, F.coalesce("_found", default)).drop("_value", "_found")


def transform(df: DataFrame, encoder: dict[str, DataFrame]) -> DataFrame:
    """Rows with the fitted encodings: unseen tags and operators get 0, unseen classes the global mean.

    One-hot columns are those of the training categories; an unseen category has all of them false.
    """
    mean = encoder["global"].first()["mean"]
    out = _look_up(df, encoder["Tag_freq"], "Tag", "freq", "Tag_freq", F.lit(0.0))
    if "Operador_freq" in encoder and "Matricula_Operador_Hash" in df.columns:
        out = _look_up(out, encoder["Operador_freq"], "Matricula_Operador_Hash", "freq", "Operador_freq", F.lit(0.0))
    else:
        out = out.withColumn("Operador_freq", F.lit(0.0))
    out = _look_up(out, encoder["Classe_target_enc"], "Classe", "enc", "Classe_target_enc", F.lit(float(mean or 0.0)))
    # The categories make columns, so they come to the driver: one name for each column of the result.
    for row in encoder["categories"].orderBy("column", "category").collect():
        out = out.withColumn(f"{row['column']}_{row['category']}", F.coalesce(F.col(row["column"]).cast("string") == row["category"], F.lit(False)))
    return out


def transform_if_needed(batch: DataFrame, encoder: dict[str, DataFrame]) -> DataFrame:
    """A batch with raw categories is encoded; one that has the encodings stays as it is."""
    return batch if "Classe_target_enc" in batch.columns else transform(batch, encoder)


def time_blocks(df: DataFrame, time: str, blocks: int) -> DataFrame:
    """``block`` from 1: equal numbers of rows in order of time and ``Id``, earlier blocks one longer if need be.

    The first row of each block is an exact order statistic, so rows are only compared with as many bounds as there
    are blocks. ``Id`` tells rows of one time apart.
    """
    us = micros(df, time)
    counts = ordered_counts(df.select(us.alias("us"), "Id"), ["us", "Id"])
    n = counts.agg(F.max("total")).first()[0] or 0
    # The first n % blocks blocks have one row more; of empty blocks there is no row.
    firsts = [k * (n // blocks) + min(k, n % blocks) for k in range(1, blocks)]
    places = [p for p in firsts if p < n]
    bounds = rows_at_places(counts, ["us", "Id"], places) if places else []
    block = F.lit(1)
    for t, i in bounds:
        block = block + ((us > t) | ((us == t) & (F.col("Id") >= i))).cast("int")
    return df.withColumn("block", F.coalesce(block, F.lit(1)).cast("int"))


def out_of_fold_target(train: DataFrame, time: str = "Fim", blocks: int = 5, column: str = "Classe") -> DataFrame:
    """``Classe_target_enc`` from earlier blocks only: a value new to them gets their mean, the first block 0."""
    rows = time_blocks(train, time, blocks)
    value = F.coalesce(F.col(column), F.lit("nan"))
    per = rows.groupBy("block", value.alias("_v")).agg(F.sum(TARGET).alias("s"), F.count(F.lit(1)).alias("n"))
    numbers = per.select("block").distinct().withColumnRenamed("block", "b")
    earlier = per.join(F.broadcast(numbers), F.col("block") < F.col("b"))
    seen = earlier.groupBy("b", "_v").agg((F.sum("s") / F.sum("n")).alias("_enc"))
    history = earlier.groupBy("b").agg((F.sum("s") / F.sum("n")).alias("_history"))
    joined = _with_history(rows.withColumn("_v", value), seen, history)
    return joined.withColumn("Classe_target_enc", F.coalesce("_enc", "_history", F.lit(0.0))).drop("_v", "_enc", "_history")


def _with_history(rows: DataFrame, seen: DataFrame, history: DataFrame) -> DataFrame:
    rows = rows.join(seen.withColumnRenamed("b", "block"), ["block", "_v"], "left")
    return rows.join(F.broadcast(history.withColumnRenamed("b", "block")), "block", "left")


def expanding_target(df: DataFrame, time: str = "Fim", column: str = "Classe") -> DataFrame:
    """Mean target of the class over earlier rows, by time and ``Id``; without any, that of all earlier rows, or 0.

    The running sums, of all rows and of a class, come from running sums inside days and the totals of the days before,
    so no task sees more than a day.
    """
    us = micros(df, time)
    keyed = df.withColumns({"_us": us, "_day": F.floor(us / 86_400_000_000), "_v": F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))})
    totals = keyed.groupBy("_v", "_day").agg(F.sum(TARGET).alias("s"), F.count(F.lit(1)).alias("n"))
    earlier = lambda by: W.partitionBy(*by).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    before = lambda name, by: F.coalesce(F.sum(name).over(earlier(by)), F.lit(0))
    of_class = totals.select("_v", "_day", before("s", ["_v"]).alias("_cs0"), before("n", ["_v"]).alias("_cn0"))
    days = totals.groupBy("_day").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("_one", F.lit(0))
    of_all = days.select("_day", before("s", ["_one"]).alias("_s0"), before("n", ["_one"]).alias("_n0"))
    inside = lambda by: W.partitionBy(*by).orderBy("_us", "Id").rowsBetween(W.unboundedPreceding, -1)
    target, one = lambda by: F.coalesce(F.sum(TARGET).over(inside(by)), F.lit(0)), F.count(F.lit(1))
    out = keyed.withColumns({"_s": target(["_day"]), "_n": one.over(inside(["_day"])), "_cs": target(["_v", "_day"]), "_cn": one.over(inside(["_v", "_day"]))})
    out = out.join(of_all, "_day", "left").join(of_class, ["_v", "_day"], "left")
    mean = lambda s, n: F.try_divide((F.col(f"{s}0") + F.col(s)).cast("double"), F.col(f"{n}0") + F.col(n))
    return out.select(*df.columns, F.coalesce(mean("_cs", "_cn"), mean("_s", "_n"), F.lit(0.0)).alias("Classe_target_enc"))


def align_columns(df: DataFrame, reference: list[str]) -> DataFrame:
    """Missing one-hot columns are added as false, other missing columns as 0.0."""
    add = {c: F.lit(False) if c.split("_")[0] in ONE_HOT else F.lit(0.0) for c in reference if c not in df.columns}
    return df.withColumns(add) if add else df
