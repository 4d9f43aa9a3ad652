"""Operational scorecards: tag-day panels, top-K and budget metrics, segments, hotspots and alert cooldown."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigia.functions.scalar import DAY_US, HOUR_US, UNKNOWN, micros, safe_divide, safe_percent
from vigia.operators.metrics import binary_metrics, score_counts
from vigia.operators.ordered import ordered_counts, quantiles

TARGET = "target_4h"
TOP_K = (3, 5, 10, 15, 20)
SEGMENTS = ("Classe", "turno", "Frota", "Tipo")
BUDGETS = (0.01, 0.02, 0.05, 0.10, 0.20, 0.30)
# Status and recommendation texts of the segment tables.
LOW_SAMPLE, LOW_PREVALENCE, OK = "inconclusivo_baixa_amostra", "inconclusivo_baixa_prevalencia", "ok"
THRESHOLD_ADVICE = {OK: "manter threshold global e monitorar", LOW_SAMPLE: "coletar mais dados antes de decidir por segmento", LOW_PREVALENCE: "avaliar regra heuristica ou janela de avaliacao maior"}
TOPK_ADVICE = {OK: "usar TopK como canal principal", LOW_SAMPLE: "coletar mais dias de observacao", LOW_PREVALENCE: "tratar segmento em trilha separada"}


def scored_frame(df: DataFrame, score: Column, threshold: float, split: str | None = None) -> DataFrame:
    """``score``, ``threshold`` and ``prediction``; a score that isn't a number is null and predicts 0."""
    value = F.nanvl(score.cast("double"), F.lit(None).cast("double"))
    out = df.withColumns({"score": value, "threshold": F.lit(float(threshold))})
    out = out.withColumn("prediction", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)).cast("int"))
    return out.withColumn("split", F.lit(split)) if split else out


def decode_one_hot(df: DataFrame, prefix: str) -> Column:
    """The category of the first true column ``prefix_category``, or unknown."""
    columns = [c for c in df.columns if c.startswith(f"{prefix}_")]
    return F.coalesce(*[F.when(F.col(c).cast("boolean"), F.lit(c[len(prefix) + 1 :])) for c in columns], F.lit(UNKNOWN))


def with_segments(df: DataFrame, segments: tuple[str, ...] = SEGMENTS) -> DataFrame:
    """Segment columns as text, from the column itself or its one-hot columns, unknown where there is no value."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) if c in df.columns else decode_one_hot(df, c) for c in segments})


def tag_day_panel(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row for each UTC day and tag: largest score and target, and the number of cycles."""
    return scored.groupBy(*(by or []), F.to_date("Fim").alias("data"), "Tag").agg(F.max("score").alias("score"), F.max(TARGET).alias(TARGET), F.count(F.lit(1)).alias("ciclos"))


def segment_panel(scored: DataFrame, segments: tuple[str, ...] = SEGMENTS) -> DataFrame:
    """The panel for each value of each segment column."""
    long = scored.select("Fim", "Tag", "score", TARGET, *segments).unpivot(["Fim", "Tag", "score", TARGET], list(segments), "segment_col", "segment_value")
    return tag_day_panel(long, ["segment_col", "segment_value"])


def ranked(panel: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``rank`` in each day: highest score first, then by tag."""
    return panel.withColumn("rank", F.row_number().over(W.partitionBy(*(by or []), "data").orderBy(F.desc_nulls_last("score"), "Tag")))


def topk_metrics(panel: DataFrame, by: list[str] | None = None, ks: tuple[int, ...] = TOP_K) -> DataFrame:
    """Selection quality of each day's top K tags, for each K."""
    by = by or []
    sums = []
    for k in ks:
        top = F.col("rank") <= k
        sums += [F.count_if(top).alias(f"n{k}"), F.sum(F.when(top, F.col(TARGET)).otherwise(0)).alias(f"p{k}")]
    wide = ranked(panel, by).groupBy(*by).agg(F.count(F.lit(1)).alias("tag_days"), F.countDistinct("data").alias("days"), F.sum(TARGET).alias("total_positives"), F.avg(F.col(TARGET).cast("double")).alias("tag_day_prevalence"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("top_k_tags_per_day"), F.col(f"n{k}").alias("selected_alerts"), F.col(f"p{k}").alias("positives_captured")) for k in ks])).alias("m")
    long = wide.select(*by, "tag_days", "days", "total_positives", "tag_day_prevalence", each).select(*by, "tag_days", "days", "total_positives", "tag_day_prevalence", "m.*")
    out = long.withColumns({"alerts_per_day": safe_divide(F.col("selected_alerts"), F.col("days")), "precision_at_k": safe_divide(F.col("positives_captured"), F.col("selected_alerts")), "recall_at_k": safe_divide(F.col("positives_captured"), F.col("total_positives"))})
    return out.withColumn("lift_vs_random", safe_divide(F.col("precision_at_k"), F.col("tag_day_prevalence")))


def _advised(df: DataFrame, rows: str, min_rows: int, positives: Column, min_positives: int, advice: dict[str, str]) -> DataFrame:
    status = F.when(F.col(rows) < min_rows, LOW_SAMPLE).when(positives < min_positives, LOW_PREVALENCE).otherwise(OK)
    out = df.withColumn("status", status)
    return out.withColumn("recommendation", F.create_map(*[F.lit(x) for item in advice.items() for x in item])[F.col("status")])


def topk_by_segment(scored: DataFrame, segments: tuple[str, ...] = SEGMENTS, ks: tuple[int, ...] = (3, 5, 10, 15), min_tag_days: int = 20, min_positives: int = 10) -> DataFrame:
    found = topk_metrics(segment_panel(scored, segments), ["segment_col", "segment_value"], ks)
    return _advised(found, "tag_days", min_tag_days, F.col("total_positives"), min_positives, TOPK_ADVICE)


def threshold_by_segment(scored: DataFrame, segments: tuple[str, ...] = SEGMENTS, min_rows: int = 50, min_positives: int = 10) -> DataFrame:
    kept = ["score", "threshold", TARGET]
    long = scored.select(*kept, *segments).unpivot(kept, list(segments), "segment_col", "segment_value")
    found = binary_metrics(long, ["segment_col", "segment_value"])
    found = found.withColumn("predicted_positive_rate", safe_divide(F.col("predicted_positive"), F.col("rows")))
    return _advised(found, "rows", min_rows, F.col("true_positive") + F.col("false_negative"), min_positives, THRESHOLD_ADVICE)


def primary_by_split(topk: DataFrame, k: int = 15) -> DataFrame:
    """The metrics of one K as columns prefixed by their split."""
    names = ["precision_at_k", "recall_at_k", "lift_vs_random"]
    return topk.where(F.col("top_k_tags_per_day") == k).groupBy().pivot("split", ["train", "val", "test"]).agg(*[F.first(n).alias(f"top{k}_{n}") for n in names])


def tag_hotspots(scored: DataFrame, top_k: int = 15, min_tag_days: int = 5) -> DataFrame:
    """Tags with enough days: scores, positive, selected, true, false and missed days."""
    panel = ranked(tag_day_panel(scored)).withColumn("selected", F.col("rank") <= top_k)
    y = F.col(TARGET) == 1
    found = panel.groupBy("Tag").agg(F.count(F.lit(1)).alias("tag_days"), F.avg("score").alias("avg_score"), F.max("score").alias("max_score"), F.count_if(y).alias("positive_days"), F.count_if("selected").alias("selected_days"), F.count_if(F.col("selected") & y).alias("true_positive_days"), F.count_if(F.col("selected") & ~y).alias("false_positive_days"), F.count_if(~F.col("selected") & y).alias("missed_positive_days"))
    out = found.where(F.col("tag_days") >= min_tag_days)
    return out.withColumns({"selected_precision": safe_divide(F.col("true_positive_days"), F.col("selected_days")), "positive_day_rate": safe_divide(F.col("positive_days"), F.col("tag_days"))})


def span_days(df: DataFrame, time: str = "Fim") -> Column:
    """Whole days from the first to the last time, plus 1."""
    us = micros(df, time)
    return F.greatest(F.floor((F.max(us) - F.min(us)) / DAY_US) + 1, F.lit(1))


def budget_metrics(scored: DataFrame, budgets: tuple[float, ...] = BUDGETS) -> DataFrame:
    """Quality of the best-scored share of each split's rows; ties at the cut go by ``Id``.

    Cuts are exact order statistics, so no task sorts a split: rows above the cut's score count, and of those
    at it as many as are missing, in order of ``Id``.
    """
    usable = scored.where(F.col("score").isNotNull())
    totals = usable.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(TARGET).alias("total_positives"), F.avg(F.col(TARGET).cast("double")).alias("prevalence"), span_days(usable).alias("days"))
    cuts = totals.select("*", F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget_pct"))
    cuts = cuts.withColumn("selected_rows", F.greatest(F.ceil(F.col("n") * F.col("budget_pct")), F.lit(1)))
    cum = score_counts(usable, ["split"]).select("split", "score", "n", "pos", "cum_n", "cum_pos")
    cut = cum.withColumnRenamed("n", "at_n").join(F.broadcast(cuts.select("split", "budget_pct", "selected_rows")), "split").where((F.col("cum_n") >= F.col("selected_rows")) & (F.col("cum_n") - F.col("at_n") < F.col("selected_rows")))
    cut = cut.select("split", "budget_pct", F.col("score").alias("cut"), (F.col("cum_pos") - F.col("pos")).alias("above"), (F.col("selected_rows") - F.col("cum_n") + F.col("at_n")).alias("missing"))
    # Most rows may be tied at a cut, which budgets may share: their places are counted once, in ranges of ``Id``.
    tied = usable.join(F.broadcast(cut.select("split", F.col("cut").alias("score")).distinct()), ["split", "score"]).select("split", F.col("score").alias("cut"), "Id", F.col(TARGET).cast("long").alias("_y"))
    places = ordered_counts(tied, ["Id", "_y"], ["split", "cut"])
    first = F.col("missing") - F.col("upto") + F.col("n")
    tied = places.join(F.broadcast(cut.select("split", "budget_pct", "cut", "missing")), ["split", "cut"]).where(first > 0)
    tied = tied.groupBy("split", "budget_pct").agg(F.sum(F.col("_y") * F.least(F.col("n"), first)).alias("at_cut"))
    out = cuts.join(cut, ["split", "budget_pct"]).join(tied, ["split", "budget_pct"], "left")
    out = out.withColumn("positives_captured", F.col("above") + F.coalesce("at_cut", F.lit(0)))
    out = out.withColumns({"alerts_per_day": F.col("selected_rows") / F.col("days"), "precision_at_budget": safe_divide(F.col("positives_captured"), F.col("selected_rows")), "recall_at_budget": safe_divide(F.col("positives_captured"), F.col("total_positives"))})
    return out.select("split", "budget_pct", F.col("selected_rows").cast("long").alias("selected_rows"), "alerts_per_day", "precision_at_budget", "recall_at_budget", safe_divide(F.col("precision_at_budget"), F.col("prevalence")).alias("lift_vs_random"), "positives_captured", "total_positives")


def cooldown_dedup(scored: DataFrame, hours: float = 4.0) -> DataFrame:
    """Predicted alerts of each tag at least so long after the last kept one, in order of time and ``Id``.

    Whether an alert is kept depends on all kept before. A pause of the whole cooldown ends a run of alerts, and
    the alert after it is kept whatever came before, so runs are independent groups, known by their first time. They
    are found by windows inside a tag and a day, with one row for each tag and day carried over the days, and the
    greedy pass runs inside each, over sorted rows as they stream by.
    """
    wait = int(hours * HOUR_US)
    alerts = scored.where((F.col("prediction") == 1) & F.col("Fim").isNotNull() & F.col("Tag").isNotNull())
    us = micros(alerts, "Fim")
    keyed = alerts.withColumns({"_us": us, "_day": F.floor(us / DAY_US)})
    order, days = W.partitionBy("Tag", "_day").orderBy("_us", "Id"), W.partitionBy("Tag").orderBy("_day")
    # The last alert of the tag's day before this one that has any.
    ends = keyed.groupBy("Tag", "_day").agg(F.max("_us").alias("_end")).select("Tag", "_day", F.lag("_end").over(days).alias("_last"))
    gap = F.col("_us") - F.coalesce(F.lag("_us").over(order), F.col("_last"))
    starts = keyed.join(ends, ["Tag", "_day"]).withColumn("_start", F.when(F.coalesce(gap >= wait, F.lit(True)), F.col("_us"))).drop("_last")
    carried = starts.groupBy("Tag", "_day").agg(F.max("_start").alias("_latest"))
    carried = carried.select("Tag", "_day", F.last("_latest", ignorenulls=True).over(days.rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    inside = F.max("_start").over(order.rowsBetween(W.unboundedPreceding, 0))
    runs = starts.withColumn("_in", inside).join(carried, ["Tag", "_day"]).withColumn("_run", F.coalesce("_in", "_before")).drop("_start", "_in", "_before", "_day")
    names = alerts.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in alerts.schema.fields)

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        for frame in frames:
            chosen = []
            for tag, run, us in zip(frame["Tag"], frame["_run"], frame["_us"], strict=True):
                kept = last is None or last[:2] != (tag, run) or us - last[2] >= wait
                chosen.append(kept)
                if kept:
                    last = (tag, run, us)
            yield frame[chosen][names]

    dealt = runs.repartition("Tag", "_run").sortWithinPartitions("Tag", "_run", "_us", "Id")
    return dealt.mapInPandas(keep, kinds)


def dedup_summary(scored: DataFrame, split: str = "test", hours: float = 4.0) -> DataFrame:
    """Raw and deduplicated alerts of a split, a day, their precision, and the share of positives they keep."""
    rows = scored.where(F.col("split") == split)
    kept = cooldown_dedup(rows, hours).agg(F.count(F.lit(1)).alias("deduplicated_alerts"), F.coalesce(F.sum(TARGET), F.lit(0)).alias("tp"))
    totals = rows.agg(F.sum("prediction").alias("raw_predicted_positive"), F.sum(TARGET).alias("positives"), span_days(rows).alias("days"))
    n = F.col("deduplicated_alerts")
    return totals.join(F.broadcast(kept)).select(F.lit(split).alias("split"), F.lit(float(hours)).alias("cooldown_hours"), "raw_predicted_positive", n, (n / F.col("days")).alias("deduplicated_alerts_per_day"), safe_divide(F.col("tp"), n).alias("deduplicated_precision"), safe_divide(F.col("tp"), F.col("positives")).alias("row_positive_capture_after_dedup"))


def extreme_false_negatives(scored: DataFrame, split: str = "test", percentile: float = 0.10) -> DataFrame:
    """Positives scored at or below the given percentile of positives, counted by fleet, type and class."""
    positives = with_segments(scored.where((F.col("split") == split) & (F.col(TARGET) == 1)), ("Frota", "Tipo", "Classe"))
    mark = quantiles(positives, "score", [percentile]).select(F.get("q", F.lit(0)).alias("mark"))
    return positives.join(F.broadcast(mark), F.col("score") <= F.col("mark")).groupBy("Frota", "Tipo", "Classe").agg(F.count(F.lit(1)).alias("count"))


def weakest_and_strongest(topk: DataFrame, k: int = 15, n: int = 10) -> DataFrame:
    """``lista``: segments inconclusive at K, and the weakest and strongest ones, numbered."""
    at = topk.where(F.col("top_k_tags_per_day") == k)
    name = ["segment_col", "segment_value"]

    def take(lista: str, rows: DataFrame, *order: Column) -> DataFrame:
        first = rows.orderBy(*order, *name).limit(n)
        return first.select(F.lit(lista).alias("lista"), F.row_number().over(W.orderBy(*order, *name)).alias("posicao"), *name, "recall_at_k", "precision_at_k", "lift_vs_random", "status")

    out = take("inconclusivos", at.where(F.col("status").startswith("inconclusivo")))
    out = out.unionByName(take("mais_fracos", at, F.asc("recall_at_k"), F.asc("precision_at_k")))
    return out.unionByName(take("mais_fortes", at, F.desc("lift_vs_random"), F.desc("precision_at_k")))


def error_analysis(scored: DataFrame, top: int = 12) -> DataFrame:
    """Missed positives by tag, fleet, type and class, the most frequent first."""
    missed = with_segments(scored, ("Frota", "Tipo", "Classe")).where((F.col(TARGET) == 1) & (F.col("prediction") == 0))
    return missed.groupBy("Tag", "Frota", "Tipo", "Classe").agg(F.count(F.lit(1)).alias("fn")).orderBy(F.desc("fn"), "Tag", "Frota", "Tipo", "Classe").limit(top)


def error_totals(scored: DataFrame) -> DataFrame:
    """``split, linhas, fn, fp, fn_pct, fp_pct``: missed positives and false alarms, and their shares of positives and of alarms."""
    y, hit = F.col(TARGET) == 1, F.col("prediction") == 1
    counted = scored.groupBy("split").agg(F.count(F.lit(1)).alias("linhas"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & hit).alias("fp"), F.count_if(y).alias("_y"), F.count_if(hit).alias("_p"))
    return counted.select("split", "linhas", "fn", "fp", safe_percent(F.col("fn"), F.col("_y")).alias("fn_pct"), safe_percent(F.col("fp"), F.col("_p")).alias("fp_pct"))


def random_baseline(panel: DataFrame, k: int = 15) -> DataFrame:
    """Positives that a random choice of K tags a day would capture on average, and what the ranking captures."""
    top = ranked(panel).groupBy("data").agg(F.count(F.lit(1)).alias("n"), F.sum(TARGET).alias("p"), F.sum(F.when(F.col("rank") <= k, F.col(TARGET)).otherwise(0)).alias("model"))
    return top.agg(F.count(F.lit(1)).alias("days"), F.sum("p").alias("positives"), F.sum(F.col("p") * F.least(F.lit(1.0), F.lit(float(k)) / F.col("n"))).alias("random_captures"), F.sum("model").alias("model_captures"))
