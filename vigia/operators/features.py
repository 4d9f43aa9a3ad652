"""Calendar, rolling and alert-history features that look back only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigia.functions.scalar import DAY_US, HOUR_US, micros, safe_divide, shift_of, tag_key
from vigia.operators.asof import Layout, before_row, checked_widths, edge_values, interval_counts, nearest, with_halo

WINDOWS_HOURS = (4, 8, 24)


def calendar_features(cycles: DataFrame, time: str = "Fim") -> DataFrame:
    """Hour, weekday (Monday is 0), month, shift, weekend, and the duration in minutes."""
    hour, weekday = F.hour(time), F.weekday(time)
    return cycles.withColumns(
        {
            "hora": hour,
            "hora_do_dia": hour,
            "dia_semana": weekday,
            "dia_da_semana": weekday,
            "mes": F.month(time),
            "turno": shift_of(hour),
            "is_fim_de_semana": (weekday >= 5).cast("int"),
            "duracao_ciclo_min": (micros(cycles, "Fim") - micros(cycles, "Inicio")) / 60e6,
        }
    )


def cycle_rolling(cycles: DataFrame, time: str = "Fim", hours: tuple[int, ...] = WINDOWS_HOURS) -> DataFrame:
    """Count, mean and deviation of durations, distinct classes and the share of the own class in ``[t - h, t)`` of the tag.

    Cycles with the same time never see each other. An empty window has null counts and means and a share of 0;
    fewer than two durations have a null deviation; a duration that isn't a number counts as none. Cycles without a time or
    tag have nulls.

    All of it comes from one shuffle by tag and day and from sums that only grow: windows are differences of running sums at
    their two edges, of whole microseconds, so that they are exact. A class is in a window while one of its cycles is no
    older than the window's length; such times of presence that meet are one, and their starts and ends are summed.
    """
    widths = {h: h * HOUR_US for h in hours}
    checked_widths(list(widths.values()))
    wide = "decimal(38,0)"
    us = F.round(F.nanvl(F.col("duracao_ciclo_min").cast("double"), F.lit(None)) * 60e6).cast("long")
    keyed = cycles.select(F.struct(*cycles.columns).alias("_row"), F.col("Tag").alias("_tag"), micros(cycles, time).alias("_us"), us.alias("_d"), F.coalesce("Classe", F.lit("nan")).alias("_class"))
    names = [f"{stem}_{h}h" for h in hours for stem in ("n_ciclos", "duracao_media_ciclo", "duracao_std_ciclo", "n_classes_distintas")] + [f"freq_classe_atividade_{h}h" for h in hours]
    spread = with_halo(keyed, "_us").withColumn("_row", F.when(F.col("_own"), F.col("_row")))
    # A class enters the windows of a width with a cycle that has none so close before, and leaves them after one that has none so close behind.
    # All windows below are parts of a tag and bucket, so rows are shuffled once.
    same = W.partitionBy("_tag", "_bucket", "_class").orderBy("_us")
    spread = spread.repartition("_tag", "_bucket").withColumns({"_gap": F.col("_us") - F.lag("_us").over(same), "_next": F.lead("_us").over(same) - F.col("_us")})
    alone = lambda c, w: F.coalesce(F.col(c) > w, F.lit(True))
    none, marks = F.lit(None).cast("long"), [f"_m{h}" for h in hours]
    kind = lambda us, at, edge, n, changes: F.struct(us.alias("us"), at.alias("at"), F.lit(edge).cast("long").alias("edge"), n.alias("n"), *[F.lit(c).cast("int").alias(m) if isinstance(c, int) else c.alias(m) for m, c in zip(marks, changes, strict=True)])
    own_end = kind(F.col("_us"), F.when(F.col("_own"), F.col("_us")), 0, F.lit(1).cast("long"), [alone("_gap", w).cast("int") for w in widths.values()])
    starts = [F.when(F.col("_own"), kind(F.col("_us") - w, F.col("_us"), w, none, [0] * len(hours))) for w in widths.values()]
    leaves = [F.when(alone("_next", w), kind(F.col("_us") + w, none, -1, none, [-1 if x == w else 0 for x in widths.values()])) for w in widths.values()]
    rows = spread.select("_tag", "_bucket", "_class", "_d", "_row", F.explode(F.array_compact(F.array(own_end, *starts, *leaves))).alias("_x"))
    rows = rows.select("_tag", "_bucket", "_class", F.col("_x.us").alias("_us"), F.col("_x.at").alias("_at"), F.col("_x.edge").alias("_edge"), F.col("_x.n").alias("_n"), F.when(F.col("_x.n") == 1, F.col("_d")).alias("_d"), F.when(F.col("_x.edge") == 0, F.col("_row")).alias("_row"), *[F.col(f"_x.{m}").alias(m) for m in marks])
    before, mine = before_row("_us"), before_row("_us", "_class")
    rows = rows.withColumns(
        {
            "_sn": F.sum("_n").over(before),
            "_sd": F.count("_d").over(before),
            "_s1": F.sum("_d").over(before).cast(wide),
            "_s2": F.sum((F.col("_d").cast("decimal(19,0)") * F.col("_d").cast("decimal(19,0)")).cast("decimal(28,0)")).over(before).cast(wide),
            **{m: F.sum(m).over(before) for m in marks},
            "_sc": F.sum("_n").over(mine),
        }
    ).where("_row is not null or _at is not null")
    at_edges = {}
    for stem in ("_sn", "_sd", "_s1", "_s2", "_sc"):
        at_edges |= edge_values({f"{stem}{h}": w for h, w in widths.items()}, stem, *(["_class"] if stem == "_sc" else []))
    out = rows.withColumns(at_edges).where("_row is not null")
    for h, mark in zip(hours, marks, strict=True):
        n, nd, s1, s2 = (F.col(f"{stem}{h}") for stem in ("_sn", "_sd", "_s1", "_s2"))
        spread_us = F.sqrt((nd.cast("decimal(10,0)") * s2 - s1 * s1).cast("double") / (nd * (nd - 1)))
        out = out.withColumns(
            {
                f"n_ciclos_{h}h": F.nullif(n, F.lit(0)).cast("double"),
                f"duracao_media_ciclo_{h}h": F.when(nd > 0, s1.cast("double") / nd / 60e6),
                f"duracao_std_ciclo_{h}h": F.when(nd > 1, spread_us / 60e6),
                f"n_classes_distintas_{h}h": F.coalesce(F.col(mark), F.lit(0)).cast("double"),
            }
        )
    for h in hours:
        out = out.withColumn(f"freq_classe_atividade_{h}h", safe_divide(F.col(f"_sc{h}"), F.col(f"n_ciclos_{h}h")))
    timed = F.col("_us").isNotNull() & F.col("_tag").isNotNull()
    return out.select("_row.*", *[F.when(timed, F.col(c)).alias(c) for c in names])


def alert_history(cycles: DataFrame, events: DataFrame, time: str = "Fim", hours: tuple[int, ...] = WINDOWS_HOURS, layout: Layout | None = None) -> DataFrame:
    """Alerts in ``[t - h, t)``, alerts an hour, days since the last alert, and the two columns derived from them.

    With a ``layout`` both tables are stored by tag and day, cycles by ``time`` and events by theirs; the result stays placed like that.
    """
    keyed = cycles if layout else cycles.withColumn("_key", tag_key("Tag"))
    counted = interval_counts(keyed, events, time, "EVENT_TIME", {f"n_alertas_{h}h": h * HOUR_US for h in hours}, tag="_key", right_tag="TAG", layout=layout)
    near = nearest(counted, events, time, "EVENT_TIME", tag="_key", right_tag="TAG", after=False, name="_last", layout=layout)
    out = near.withColumn("dias_desde_ultimo_alerta", (micros(near, time) - F.col("_last.us")) / F.lit(DAY_US)).drop("_last", "_key")
    for h in hours:
        out = out.withColumn(f"alertas_por_hora_{h}h", F.col(f"n_alertas_{h}h") / F.lit(float(h)))
    return out.withColumns({"n_precondicoes_satisfeitas_4h": F.col("n_alertas_4h"), "nivel_maximo_evento_recente": F.when(F.col("n_alertas_24h") > 0, 4).otherwise(0)})


def degradation(features: DataFrame) -> DataFrame:
    """Differences and ratios of the last 4 to the last 24 hours; nulls and divisions by 0 give 0."""
    zero = F.lit(0.0)
    diff = lambda a, b: F.coalesce(F.col(a).cast("double") - F.col(b), zero)
    ratio = lambda a, b: safe_divide(F.col(a), F.col(b))
    return features.withColumns(
        {
            "delta_duracao_ciclo_4h_24h": diff("duracao_media_ciclo_4h", "duracao_media_ciclo_24h"),
            "ratio_duracao_ciclo_4h_24h": ratio("duracao_media_ciclo_4h", "duracao_media_ciclo_24h"),
            "delta_alertas_por_hora_4h_24h": diff("alertas_por_hora_4h", "alertas_por_hora_24h"),
            "ratio_alertas_4h_24h": ratio("n_alertas_4h", "n_alertas_24h"),
            "delta_n_ciclos_4h_24h_norm": F.coalesce(F.col("n_ciclos_4h") / 4.0 - F.col("n_ciclos_24h") / 24.0, zero),
            "delta_freq_classe_4h_24h": diff("freq_classe_atividade_4h", "freq_classe_atividade_24h"),
            "delta_classes_distintas_4h_24h": diff("n_classes_distintas_4h", "n_classes_distintas_24h"),
        }
    )


def maintenance_history(cycles: DataFrame, orders: DataFrame, time: str = "Fim", recent_days: int = 7) -> DataFrame:
    """Days since the tag's last maintenance, and 1.0 if that was corrective and within the last days.

    Of orders at the same instant the one whose type sorts last counts. Without history: null and 0.0.
    """
    near = nearest(cycles, orders, time, "data_manutencao", after=False, payload=["tipo"], name="_last")
    days = (micros(near, time) - F.col("_last.us")) / F.lit(DAY_US)
    out = near.withColumn("dias_desde_ultima_manutencao", days)
    recent = (F.col("_last.tipo") == "corretiva") & (F.col("dias_desde_ultima_manutencao") <= recent_days)
    return out.withColumn("manutencao_corretiva_7d", F.coalesce(recent, F.lit(False)).cast("double")).drop("_last")


def null_profile(df: DataFrame, top: int) -> DataFrame:
    """Columns with the largest share of nulls: ``coluna, null_pct``."""
    wide = df.agg(*[F.round(F.avg(F.col(f"`{c}`").isNull().cast("double")) * 100, 4).alias(c) for c in df.columns])
    return wide.unpivot([], [F.col(f"`{c}`") for c in df.columns], "coluna", "null_pct").orderBy(F.desc_nulls_last("null_pct"), "coluna").limit(top)


def build_features(labeled: DataFrame, events: DataFrame) -> DataFrame:
    """All features of labeled cycles in one plan."""
    return degradation(alert_history(cycle_rolling(calendar_features(labeled)), events))
