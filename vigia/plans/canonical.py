"""The fleet tables as projections of the test tables, in DataFrame form and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.functions.scalar import shift_of
from vigia.operators.features import calendar_features
from vigia.operators.labeling import label_cycles
from vigia.operators.scorecard import scored_frame
from vigia.operators.splits import temporal_split

RULES = [
    ("ALARME OEM", "error", "Mediante alarme nivel 3", "Muito Alto"),
    ("ALARME OEM", "purchase", "Critico", "Muito Alto"),
    ("ALARME OEM", "click", "Critico", "Medio"),
    ("ALARME OEM", "error", "Mediante alarme nivel 3", "Muito Alto"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("Id"),
        F.expr("timestampadd(SECOND, -cast(round(value * 60) as bigint), ts)").alias("Inicio"),
        F.col("ts").alias("Fim"),
        F.concat(F.lit("CA"), "user_id").alias("Tag"),
        F.concat(F.lit("F"), F.col("user_id") % 5).alias("Frota"),
        F.when(F.col("user_id") % 2 == 1, "Caminhao").otherwise("Carregadeira").alias("Tipo"),
        F.col("event_type").alias("Classe"),
        F.when(F.col("event_id") % 11 > 0, F.concat(F.lit("OP"), F.col("event_id") % 37)).alias("Matricula_Operador_Hash"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    third = F.col("event_id") % 3 == 0
    return e.select(
        F.concat(F.lit(" ca"), "user_id").alias("TAG"),
        F.col("ts").alias("Data_Evento"),
        F.col("event_type").alias("Alarme"),
        F.lit("Alarme OEM").alias("Tipo"),
        F.when(third, "Muito Alto").alias("Criticidade"),
        F.when(third, F.when(F.col("event_type") == "error", "Mediante alarme nivel 3").otherwise("Critico")).alias("Situacao"),
        (F.col("value") > 150).cast("int").alias("Is_Dont_Go"),
    )


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "TIPO string, EVENTO string, SITUACAO string, NIVEL string")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical events in their simple form."""
    return table(spark, sf_dir, "events").where(F.col("event_type") == "error").select(F.concat(F.lit("CA"), "user_id").alias("TAG"), F.col("ts").alias("EVENT_TIME"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase"))
    kind = F.when(F.col("event_type") == "purchase", "corretiva").otherwise("preventiva")
    return e.select(F.concat(F.lit("CA"), "user_id").alias("Tag"), F.col("ts").alias("data_manutencao"), kind.alias("tipo"))


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_cycles(cycles(spark, sf_dir), errors(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labeled(spark, sf_dir).withColumn("turno", shift_of(F.hour("Fim")))
    return temporal_split(scored_frame(rows, (F.col("Id") * 7919 % 10007) / 10007, 0.5), times=cycles(spark, sf_dir))


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar_features(labeled(spark, sf_dir))


#: The same tables for DuckDB, as common table expressions.
SQL = """
WITH cycles AS (SELECT event_id AS Id, ts - to_seconds(CAST(round(value * 60) AS BIGINT)) AS Inicio, ts AS Fim, 'CA' || user_id AS Tag, 'F' || (user_id % 5) AS Frota,
  CASE WHEN user_id % 2 = 1 THEN 'Caminhao' ELSE 'Carregadeira' END AS Tipo, event_type AS Classe, CASE WHEN event_id % 11 > 0 THEN 'OP' || (event_id % 37) END AS Matricula_Operador_Hash FROM events),
errors AS (SELECT 'CA' || user_id AS TAG, ts AS EVENT_TIME FROM events WHERE event_type = 'error'),
mnt AS (SELECT 'CA' || user_id AS Tag, ts AS data_manutencao, CASE WHEN event_type = 'purchase' THEN 'corretiva' ELSE 'preventiva' END AS tipo FROM events WHERE event_type IN ('signup', 'purchase')),
labeled AS (SELECT c.*, e.EVENT_TIME AS next_critical_event_time, (epoch_us(e.EVENT_TIME) - epoch_us(c.Fim)) / 3600000000.0::DOUBLE AS tte_horas,
  CASE WHEN epoch_us(e.EVENT_TIME) - epoch_us(c.Fim) <= 14400000000 THEN 1 ELSE 0 END AS target_4h
  FROM cycles c ASOF LEFT JOIN errors e ON c.Tag = e.TAG AND c.Fim < e.EVENT_TIME),
profiled AS (SELECT *, hour(Fim) AS hora, (isodow(Fim) - 1) AS dia_da_semana, month(Fim) AS mes, (epoch_us(Fim) - epoch_us(Inicio)) / 60e6 AS duracao_ciclo_min,
  CASE WHEN hour(Fim) BETWEEN 6 AND 13 THEN 'manha' WHEN hour(Fim) BETWEEN 14 AND 21 THEN 'tarde' ELSE 'noite' END AS turno FROM labeled),
cuts AS (SELECT max(CASE WHEN k = CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN Fim END) AS a, max(CASE WHEN k = CAST(floor(n * 0.85::DOUBLE) AS BIGINT) THEN Fim END) AS b
  FROM (SELECT Fim, row_number() OVER (ORDER BY Fim) - 1 AS k, count(*) OVER () AS n FROM cycles)),
scored AS (SELECT p.*, ((Id * 7919) % 10007) / 10007.0::DOUBLE AS score, 0.5::DOUBLE AS threshold, CASE WHEN ((Id * 7919) % 10007) / 10007.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS prediction,
  CASE WHEN Fim < a - INTERVAL 4 HOUR THEN 'train' WHEN Fim >= a AND Fim < b - INTERVAL 4 HOUR THEN 'val' WHEN Fim >= b THEN 'test' END AS split FROM profiled p, cuts),
panel AS (SELECT Fim::DATE AS data, Tag, max(score) AS score, max(target_4h) AS target_4h, count(*) AS ciclos FROM scored GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY data ORDER BY score DESC, Tag) AS rank FROM panel)
"""
