"""Contracts on columns and values, and data-quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigia.functions.scalar import micros, safe_percent, utc_time
from vigia.operators.ordered import quantiles

REQUIRED = ["Tag", "Frota", "Tipo", "Inicio", "Fim"]
# Columns that say something about the label, and columns that aren't modelled for other reasons.
LEAKAGE = {"Id", "Inicio", "Fim", "Tag", "Classe", "next_critical_event_time", "tte_horas", "target_4h"}
NOT_MODELLED = {"mes", "hora", "dia_semana", "n_precondicoes_satisfeitas_4h"}


def require_columns(df: DataFrame, columns: list[str] = REQUIRED) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return df


def normalize_times(df: DataFrame, columns: tuple[str, ...] = ("Inicio", "Fim"), zone: str = "America/Sao_Paulo") -> DataFrame:
    """Text times to UTC; what can't be read, and local times that don't exist or exist twice, become null."""
    return df.withColumns({c: utc_time(c, zone) for c in columns if df.schema[c].dataType == T.StringType()})


def quality_report(df: DataFrame, required: list[str] = REQUIRED, start: str = "Inicio", end: str = "Fim", max_hours: float = 24.0, keys: tuple[str, ...] = ("Tag", "Inicio", "Fim")) -> DataFrame:
    """One row: nulls of the required columns and their share, duplicates, and durations out of bounds.

    Duplicates are rows beyond the first of each group; groups are counted on the map side first.
    """
    minutes = (micros(df, end) - micros(df, start)) / 60e6
    nulls = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in required]
    base = df.agg(F.count(F.lit(1)).alias("rows"), *nulls, F.count_if(minutes < 0).alias("negative_duration"), F.count_if(minutes > max_hours * 60).alias("over_max_duration"), F.count_if(minutes.isNull()).alias("missing_duration"))
    extra = lambda columns, name: df.groupBy(*columns).agg((F.count(F.lit(1)) - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)).alias(name))
    out = base.join(F.broadcast(extra(df.columns, "duplicate_rows"))).join(F.broadcast(extra(keys, "duplicate_keys")))
    return out.withColumns({f"null_pct_{c}": safe_percent(F.col(f"nulls_{c}"), F.col("rows")) for c in required})


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric and boolean columns that neither leak the label nor are left out of modelling."""
    kinds = (T.NumericType, T.BooleanType)
    found = [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in LEAKAGE | NOT_MODELLED]
    if not found:
        raise ValueError("no numeric feature to train on")
    return found


def feature_coverage(columns: list[str], expected: list[str]) -> tuple[list[str], list[str]]:
    """Expected columns that are missing, and columns that aren't expected."""
    return sorted(set(expected) - set(columns)), sorted(set(columns) - set(expected))


def align_features(df: DataFrame, expected: list[str], allow_missing: bool = False) -> DataFrame:
    """The expected features in their order; missing ones fail, or are 0.0 if allowed."""
    missing, _ = feature_coverage(df.columns, expected)
    if missing and not allow_missing:
        raise ValueError(f"features missing: {missing}")
    others = [c for c in df.columns if c not in expected]
    return df.select(*others, *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in expected])


def broken_rules(batch: DataFrame):
    """A column with the ``column, check, failure_case`` of each rule of the contract that a row breaks."""
    rules = [("Tag", "not_null", F.col("Tag").isNull()), ("Fim", "not_null", F.col("Fim").isNull()), ("Fim", "year_2000_2100", ~F.year("Fim").between(2000, 2100))]
    for name, low, high in (("duracao_ciclo_min", 0, None), ("n_alertas_4h", 0, None), ("dias_desde_ultimo_alerta", 0, 3650)):
        if name in batch.columns:
            value = F.col(name).cast("double")
            rules.append((name, f"in_range_{low}_{high if high is not None else 'inf'}", (value < low) | (value > high) if high is not None else value < low))
    return F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(c).alias("column"), F.lit(check).alias("check"), F.col(c).cast("string").alias("failure_case"))) for c, check, bad in rules]))


def violations(batch: DataFrame) -> DataFrame:
    """``column, check, failure_case`` for each value of an inference batch that breaks the contract."""
    return batch.select(F.explode(broken_rules(batch)).alias("v")).select("v.*")


def validate_batch(batch: DataFrame) -> DataFrame:
    """The batch, or an error with its first ten violations."""
    require_columns(batch, ["Tag", "Fim"])
    found = violations(batch).limit(10).collect()
    if found:
        raise ValueError("batch breaks the contract: " + "; ".join(f"{r['column']} {r['check']} {r['failure_case']}" for r in found))
    return batch


def schema_profile(df: DataFrame) -> DataFrame:
    """``coluna, tipo, nulos, null_pct, distintos`` for each column.

    Values are counted by column and value on the map side, so rows aren't copied for each column's distinct count.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "coluna", "valor")
    counted = texts.groupBy("coluna", "valor").agg(F.count(F.lit(1)).alias("n"))
    per = counted.groupBy("coluna").agg(F.coalesce(F.sum(F.when(F.col("valor").isNull(), F.col("n"))), F.lit(0)).alias("nulos"), F.sum("n").alias("n"), F.count("valor").alias("distintos"))
    names = F.create_map(*[F.lit(x) for item in kinds.items() for x in item])
    return per.select("coluna", names[F.col("coluna")].alias("tipo"), "nulos", safe_percent(F.col("nulos"), F.col("n")).alias("null_pct"), "distintos")


def numeric_describe(df: DataFrame) -> DataFrame:
    """``coluna, n, media, desvio, minimo, q1, mediana, q3, maximo`` of each numeric column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    long = df.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "coluna", "valor").where("valor is not null")
    base = long.groupBy("coluna").agg(F.count(F.lit(1)).alias("n"), F.avg("valor").alias("media"), F.stddev_samp("valor").alias("desvio"), F.min("valor").alias("minimo"), F.max("valor").alias("maximo"))
    q = quantiles(long, "valor", [0.25, 0.5, 0.75], ["coluna"])
    return base.join(F.broadcast(q), "coluna").select("coluna", "n", "media", "desvio", "minimo", *[F.get("q", F.lit(k)).alias(x) for k, x in enumerate(("q1", "mediana", "q3"))], "maximo")


def excluded_columns(df: DataFrame) -> DataFrame:
    """``grupo, colunas, n``: columns that aren't modelled, by the reason."""
    modelled = set(feature_columns(df))
    group = lambda c: "vazamento" if c in LEAKAGE else "nao_modelavel" if c in NOT_MODELLED else "nao_numerica"
    rows = [(group(c), c) for c in df.columns if c not in modelled]
    found = df.sparkSession.createDataFrame(rows, "grupo string, coluna string")
    return found.groupBy("grupo").agg(F.array_join(F.sort_array(F.collect_list("coluna")), ",").alias("colunas"), F.count(F.lit(1)).alias("n"))


def temporal_profile(df: DataFrame, time: str = "Fim", tag: str = "Tag") -> DataFrame:
    """Mean number of rows a day, an hour and a tag, and duplicates by tag and time."""
    mean = lambda column, name: df.groupBy(column).agg(F.count(F.lit(1)).alias("c")).agg(F.avg("c").alias(name))
    twice = df.groupBy(tag, time).agg((F.count(F.lit(1)) - 1).alias("c")).agg(F.sum("c").alias("duplicados"))
    out = mean(F.to_date(time), "media_dia").join(F.broadcast(mean(F.date_trunc("hour", time), "media_hora")))
    return out.join(F.broadcast(mean(F.col(tag), "media_tag"))).join(F.broadcast(twice))
