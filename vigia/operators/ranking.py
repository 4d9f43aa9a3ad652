"""The daily list of tags to inspect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigia.operators.scorecard import with_segments

# Texts of the list.
REASONS = {
    "n4": "alertas recentes na janela de 4h",
    "n24": "historico recente de alertas em 24h",
    "last": "alerta critico observado no ultimo dia",
    "delta": "aumento recente na duracao do ciclo",
    "freq": "Tag com alta recorrencia operacional",
    "score": "maior score diario do modelo",
}
BANDS = ["alto_acima_threshold", "alto_por_ranking", "medio_por_ranking", "monitorar_por_ranking"]
ACTIONS = ["inspecionar primeiro e registrar achado operacional", "verificar na ronda diaria e acompanhar tendencia", "monitorar no painel e reavaliar no proximo ciclo"]


def _or_zero(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def priority_reason(df: DataFrame) -> Column:
    """The first signal present; an unknown or zero time since the last alert counts as long ago."""
    days = F.coalesce(F.nullif(_or_zero(df, "dias_desde_ultimo_alerta"), F.lit(0.0)), F.lit(9999.0))
    return (
        F.when(_or_zero(df, "n_alertas_4h") > 0, REASONS["n4"])
        .when(_or_zero(df, "n_alertas_24h") > 0, REASONS["n24"])
        .when(days <= 1.0, REASONS["last"])
        .when(_or_zero(df, "delta_duracao_ciclo_4h_24h") > 0, REASONS["delta"])
        .when(_or_zero(df, "Tag_freq") >= 0.03, REASONS["freq"])
        .otherwise(REASONS["score"])
    )


def risk_band(score: Column, threshold: Column, rank: Column) -> Column:
    return F.when(score >= threshold, BANDS[0]).when(rank <= 5, BANDS[1]).when(rank <= 10, BANDS[2]).otherwise(BANDS[3])


def recommended_action(band: Column) -> Column:
    return F.when(band.isin(BANDS[:2]), ACTIONS[0]).when(band == BANDS[2], ACTIONS[1]).otherwise(ACTIONS[2])


def daily_priority(scored: DataFrame, top_k: int = 15, by: list[str] | None = None) -> DataFrame:
    """The top K tags of each UTC day (and each value of ``by``), each with its best row of the day.

    Of equal scores the row with the smallest ``Id`` counts, and the tag that comes first. The best row is
    found by a partial aggregation, so a tag with many rows a day costs no more than others.
    """
    rows = with_segments(scored, ("Frota", "Tipo", "turno")).withColumn("motivo_principal", priority_reason(scored))
    rows = rows.withColumn("data", F.to_date("Fim")).where("data is not null and Tag is not null and score is not null")
    by = by or []
    kept = F.struct("threshold", "Frota", "Tipo", "turno", "motivo_principal")
    best = rows.groupBy(*by, "data", "Tag").agg(F.max_by(F.struct("score", kept.alias("r")), F.struct("score", -F.col("Id"))).alias("b")).select(*by, "data", "Tag", "b.score", "b.r.*")
    top = best.withColumn("rank", F.row_number().over(W.partitionBy(*by, "data").orderBy(F.desc("score"), "Tag"))).where(F.col("rank") <= top_k)
    band = risk_band(F.col("score"), F.col("threshold"), F.col("rank"))
    top = top.withColumn("risco_segmento", band).withColumn("acao_recomendada", recommended_action(F.col("risco_segmento")))
    return top.select(*by, "data", "rank", "Tag", F.round("score", 6).alias("score"), "Frota", "Tipo", "turno", "motivo_principal", "risco_segmento", "acao_recomendada")
