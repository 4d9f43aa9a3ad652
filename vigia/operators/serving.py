"""Queries of the operations board as DataFrame functions: filters, pages, work log, overview, equipment view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigia.functions.scalar import day_key, micros
from vigia.operators.ordered import quantiles

HIGH = ["alto_acima_threshold", "alto_por_ranking"]
OPEN = ["pendente", "em_inspecao", "em_andamento"]
STATUSES = [*OPEN, "concluido", "descartado"]
# Labels of the risk bands.
LABELS = {"alto_acima_threshold": "Alto · acima do limiar", "alto_por_ranking": "Alto · ranking", "medio_por_ranking": "Medio · ranking", "monitorar_por_ranking": "Monitorar"}


def risk_label(band: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for item in LABELS.items() for x in item])[band], band)


def cycles_view(cycles: DataFrame) -> DataFrame:
    """Cycles with their day and duration in minutes."""
    return cycles.withColumns({"data": day_key("Fim"), "duracao_ciclo_min": (micros(cycles, "Fim") - micros(cycles, "Inicio")) / 60e6})


def events_view(events: DataFrame) -> DataFrame:
    out = events.withColumnRenamed("TAG", "Tag") if "TAG" in events.columns else events
    return out.withColumn("data", day_key("EVENT_TIME"))


def filtered(df: DataFrame, query: str | None = None, **equal: object) -> DataFrame:
    """Rows that meet all given conditions; ``query`` is looked for in the tag as plain text, whatever its case."""
    for name, value in equal.items():
        if value is not None and name in df.columns:
            df = df.where(F.col(name) == value)
    return df.where(F.lower("Tag").contains(query.strip().lower())) if query else df


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """Page ``number`` from 1 of 1 to 200 rows, with the total of all rows in ``total``."""
    size, number = min(max(size, 1), 200), max(number, 1)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total))


def latest_actions(log: DataFrame) -> DataFrame:
    """The last entry of each key in an append-only work log."""
    newest = F.row_number().over(W.partitionBy("key").orderBy(F.desc("updated_at"), F.desc("status")))
    return log.withColumn("_k", newest).where("_k = 1").drop("_k")


def upserted(log: DataFrame, action: DataFrame) -> DataFrame:
    """The log with an action added; a status that isn't known is refused."""
    bad = action.where(~F.col("status").isin(STATUSES)).limit(1).count()
    if bad:
        raise ValueError(f"status not among {STATUSES}")
    return latest_actions(log.unionByName(action, allowMissingColumns=True))


def priority_board(priority: DataFrame, log: DataFrame, **filters: object) -> DataFrame:
    """The list with each item's key, label and latest action; items without one are pending."""
    rows = filtered(priority, **filters).withColumn("action_key", F.concat_ws(":", F.lit("priority"), F.col("data").cast("string"), F.col("Tag")))
    actions = latest_actions(log).select(F.col("key").alias("action_key"), "status", "note")
    joined = rows.join(actions, "action_key", "left")
    return joined.withColumns({"status": F.coalesce("status", F.lit("pendente")), "note": F.coalesce("note", F.lit("")), "risco_rotulo": risk_label(F.col("risco_segmento"))})


def risk_counts(board: DataFrame) -> DataFrame:
    return board.groupBy(F.coalesce("risco_rotulo", F.lit("indefinido")).alias("risco_rotulo")).agg(F.count(F.lit(1)).alias("n"))


def overview(priority: DataFrame, cycles: DataFrame, events: DataFrame, log: DataFrame, day: str) -> DataFrame:
    """Key figures of a day in one row."""
    a = priority.where(F.col("data").cast("string") == day).agg(F.count(F.lit(1)).alias("priority_count"), F.count_if(F.col("risco_segmento").isin(HIGH)).alias("high_risk_count"))
    kinds = cycles.select("Tag", "Frota").unpivot([], ["Tag", "Frota"], "column", "value").distinct()
    kinds = kinds.agg(*[F.count_if((F.col("column") == x) & F.col("value").isNotNull()).alias(name) for x, name in (("Tag", "unique_tags"), ("Frota", "unique_fleets"))])
    c = cycles.agg(F.count_if(F.col("data") == day).alias("cycle_count"), F.coalesce(F.sum(F.when(F.col("data") == day, F.col("target_4h"))), F.lit(0)).alias("positive_count")).join(F.broadcast(kinds))
    e = events.where(F.col("data") == day).agg(F.count(F.lit(1)).alias("critical_events"))
    o = latest_actions(log).agg(F.count_if(F.col("status").isin(OPEN)).alias("open_actions"))
    out = c.join(F.broadcast(a)).join(F.broadcast(e)).join(F.broadcast(o))
    return out.withColumn("positive_rate", F.coalesce(F.try_divide(F.col("positive_count").cast("double"), F.col("cycle_count")), F.lit(0.0)))


def processing(cycles: DataFrame, day: str | None = None, top_classes: int = 12) -> DataFrame:
    """``grupo, chave, ciclos, positivos``: by fleet, by the most frequent classes, and by all 24 hours."""
    rows = cycles.where(F.col("data") == day) if day else cycles
    measures = [F.count(F.lit(1)).alias("ciclos"), F.sum("target_4h").alias("positivos")]
    fleet = rows.groupBy(F.col("Frota").alias("chave")).agg(*measures).select(F.lit("frota").alias("grupo"), "chave", "ciclos", "positivos")
    kind = rows.groupBy(F.col("Classe").alias("chave")).agg(*measures).orderBy(F.desc("ciclos"), "chave").limit(top_classes).select(F.lit("classe").alias("grupo"), "chave", "ciclos", "positivos")
    hour = rows.groupBy(F.hour("Fim").alias("h")).agg(*measures)
    hours = rows.sparkSession.range(24).select(F.col("id").cast("int").alias("h")).join(F.broadcast(hour), "h", "left")
    hours = hours.select(F.lit("hora").alias("grupo"), F.col("h").cast("string").alias("chave"), F.coalesce("ciclos", F.lit(0)).alias("ciclos"), F.coalesce("positivos", F.lit(0)).alias("positivos"))
    return fleet.unionByName(kind).unionByName(hours)


def duration_quantiles(cycles: DataFrame) -> DataFrame:
    return quantiles(cycles, "duracao_ciclo_min", [0.5, 0.95]).select(F.get("q", F.lit(0)).alias("mediana"), F.get("q", F.lit(1)).alias("p95"))


def latest_rows(df: DataFrame, time: str, n: int, tie: str) -> DataFrame:
    """The last ``n`` rows of each tag, numbered from the newest."""
    return df.withColumn("posicao", F.row_number().over(W.partitionBy("Tag").orderBy(F.desc(time), F.desc(tie)))).where(F.col("posicao") <= n)


def equipment(cycles: DataFrame, events: DataFrame, priority: DataFrame, hotspots: DataFrame) -> DataFrame:
    """One row for each tag of any table: totals, latest fleet and type, best rank, and days selected."""
    c = cycles.groupBy("Tag").agg(F.count(F.lit(1)).alias("cycles"), F.sum("target_4h").alias("positives"), F.max_by("Frota", F.struct("Fim", "Id")).alias("Frota"), F.max_by("Tipo", F.struct("Fim", "Id")).alias("Tipo"))
    e = events.groupBy("Tag").agg(F.count(F.lit(1)).alias("alerts"))
    p = priority.groupBy("Tag").agg(F.count(F.lit(1)).alias("ranked_days"), F.min("rank").alias("best_rank"))
    h = hotspots.select("Tag", "selected_days")
    out = c.join(e, "Tag", "full").join(p, "Tag", "full").join(h, "Tag", "full")
    return out.na.fill(0, ["cycles", "positives", "alerts", "ranked_days", "selected_days"])


def equipment_slices(cycles: DataFrame, events: DataFrame, priority: DataFrame, n: int = 40, n_ranked: int = 30) -> DataFrame:
    """One row for each tag of any table: its last cycles, events and rankings as arrays, the newest first."""

    def slices(rows: DataFrame, name: str, time: str, k: int, tie: str, columns: list[str]) -> DataFrame:
        newest = latest_rows(rows, time, k, tie)
        listed = F.sort_array(F.collect_list(F.struct("posicao", *columns)))
        return newest.groupBy("Tag").agg(listed.alias(name))

    c = slices(cycles, "cycles", "Fim", n, "Id", ["Id", "Fim", "Classe", "target_4h"])
    e = slices(events, "events", "EVENT_TIME", n, "Tag", ["EVENT_TIME"])
    p = slices(priority, "rankings", "data", n_ranked, "rank", ["data", "rank", "score"])
    return c.join(e, "Tag", "full").join(p, "Tag", "full")


def filter_values(cycles: DataFrame, columns: list[str]) -> DataFrame:
    """``filtro, valor``: distinct values for each filter."""
    return cycles.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "filtro", "valor").where("valor is not null").distinct()


def available_dates(*tables: DataFrame) -> DataFrame:
    """Days that any of the tables has."""
    out = tables[0].select(F.col("data").cast("string").alias("data"))
    for t in tables[1:]:
        out = out.union(t.select(F.col("data").cast("string")))
    return out.where("data is not null").distinct()


def performance(topk: DataFrame, budgets: DataFrame, hotspots: DataFrame, thresholds: DataFrame | None = None, dedup: DataFrame | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """One row: ``model_id, threshold, rule`` of the manifest, the metric tables as sorted arrays, and the first twenty hotspots.

    Tables that aren't given have no column. Metric tables have a row for each split and K or budget, so arrays stay small.
    """
    rows = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
    first = hotspots.orderBy(F.desc("positive_days"), "Tag").limit(20)
    parts = [rows(topk, "topk"), rows(budgets, "budgets")]
    parts += [rows(df, name) for df, name in ((thresholds, "thresholds"), (dedup, "dedup")) if df is not None]
    parts.append(rows(first, "hotspots"))
    if manifest is not None:
        parts.insert(0, manifest.select(F.col("model_name").alias("model_id"), "threshold", F.col("selection_rule").alias("rule")).limit(1))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part))
    return out
