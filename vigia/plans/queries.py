"""The registered queries of the fleet operators and the SQL that they are compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigia.operators import contract, drift, drift_parts, encoding, features, governance, labeling, metrics, profile, ranking, scorecard, serving, splits
from vigia.operators.ordered import scratch_root
from vigia.plans import canonical as c
from vigia.sources import layout

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def normalized(df: DataFrame) -> DataFrame:
    """Whole numbers as long, others rounded to 6 places, times without zone: one form for comparing results."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegralType):
            col = col.cast("long")
        elif isinstance(f.dataType, T.FractionalType):
            # The small addend keeps exact halves, which engines round differently, off the edge.
            col = F.round(col.cast("double") + 1e-10, 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            col = col.cast("timestamp_ntz")
        out.append(col.alias(f.name))
    return df.select(*out)


def query(name: str, body: str | None = None, longs: str = "", doubles: str = ""):
    """Register a query and, with ``body``, its SQL over the canonical tables; the named columns get one form."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: normalized(build(spark, sf_dir))
        if body:
            casts = [f"CAST({x} AS BIGINT) AS {x}" for x in longs.split()] + [f"round(CAST({x} AS DOUBLE) + 1e-10, 6) + 0.0 AS {x}" for x in doubles.split()]
            replace = f" REPLACE ({', '.join(casts)})" if casts else ""
            ORACLES[name] = f"{c.SQL}, result AS ({body})\nSELECT *{replace} FROM result"
        return build

    return add


# --- contract and quality


_DIRTY = "(SELECT * REPLACE (CASE WHEN Id % 17 > 0 THEN Frota END AS Frota, CASE WHEN Id % 23 > 0 THEN Inicio END AS Inicio) FROM cycles)"


@query("e1_quality_report", f"""SELECT count(*) AS rows, {", ".join(f"count(*) FILTER ({n} IS NULL) AS nulls_{n}" for n in ("Tag", "Frota", "Tipo", "Inicio", "Fim"))}, count(*) FILTER (Fim < Inicio) AS negative_duration,
  count(*) FILTER (epoch_us(Fim) - epoch_us(Inicio) > 3600000000) AS over_max_duration, count(*) FILTER (Fim IS NULL OR Inicio IS NULL) AS missing_duration,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_DIRTY})) AS duplicate_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT Tag, Inicio, Fim FROM {_DIRTY})) AS duplicate_keys,
  {", ".join(f"round(100.0 * count(*) FILTER ({n} IS NULL) / count(*), 4) AS null_pct_{n}" for n in ("Tag", "Frota", "Tipo", "Inicio", "Fim"))} FROM {_DIRTY}""",
       "rows nulls_Tag nulls_Frota nulls_Tipo nulls_Inicio nulls_Fim negative_duration over_max_duration missing_duration duplicate_rows duplicate_keys", "null_pct_Tag null_pct_Frota null_pct_Tipo null_pct_Inicio null_pct_Fim")
def _(spark, sf):
    rows = contract.require_columns(c.cycles(spark, sf))
    rows = rows.withColumns({"Frota": F.when(F.col("Id") % 17 > 0, F.col("Frota")), "Inicio": F.when(F.col("Id") % 23 > 0, F.col("Inicio"))})
    return contract.quality_report(rows, max_hours=1.0)


@query("e1_duplicate_orders", "SELECT count(*) - count(DISTINCT (o_custkey, o_orderdate)) AS duplicate_keys FROM orders", "duplicate_keys")
def _(spark, sf):
    o = c.table(spark, sf, "orders").groupBy("o_custkey", "o_orderdate").agg((F.count(F.lit(1)) - 1).alias("x"))
    return o.agg(F.sum("x").alias("duplicate_keys"))


@query("c2_utc_times", """SELECT event_id AS Id, ts + INTERVAL 3 HOUR AS utc FROM events""")
def _(spark, sf):
    e = c.table(spark, sf, "events").select(F.col("event_id").alias("Id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"))
    # The same instant whatever the session's zone is.
    from vigia.functions.scalar import utc_time

    return e.select("Id", utc_time("t").alias("utc"))


@query("c4_prepared_events", """SELECT 'CA' || user_id AS TAG, ts AS EVENT_TIME, lower(event_type) AS EVENTO, 'alarme oem' AS TIPO,
  CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_type = 'error' THEN 'mediante alarme nivel 3' ELSE 'critico' END ELSE '' END AS SITUACAO,
  CASE WHEN event_id % 3 = 0 THEN 'muito alto' ELSE '' END AS NIVEL, CASE WHEN value > 150 THEN 1 ELSE 0 END AS IS_DONT_GO FROM events""", "IS_DONT_GO")  # fmt: skip
def _(spark, sf):
    return labeling.prepare_events(c.telemetry(spark, sf))


@query("c5_calendar_features", """SELECT Id, hora, hora AS hora_do_dia, dia_da_semana AS dia_semana, dia_da_semana, mes, turno, CASE WHEN dia_da_semana >= 5 THEN 1 ELSE 0 END AS is_fim_de_semana, duracao_ciclo_min FROM profiled""",
       "hora hora_do_dia dia_semana dia_da_semana mes is_fim_de_semana", "duracao_ciclo_min")
def _(spark, sf):
    return features.calendar_features(c.cycles(spark, sf)).select("Id", "hora", "hora_do_dia", "dia_semana", "dia_da_semana", "mes", "turno", "is_fim_de_semana", "duracao_ciclo_min")


@query("c12_batch_violations", """SELECT 'duracao_ciclo_min' AS "column", 'in_range_0_inf' AS "check", count(*) AS n FROM profiled WHERE duracao_ciclo_min - 30 < 0""", "n")
def _(spark, sf):
    batch = c.profiled(spark, sf).withColumn("duracao_ciclo_min", F.col("duracao_ciclo_min") - 30)
    return contract.violations(batch).groupBy("column", "check").agg(F.count(F.lit(1)).alias("n"))


@query("e40_schema_profile", " UNION ALL ".join(f"SELECT '{n}' AS coluna, count(*) - count({n}) AS nulos, round((count(*) - count({n})) * 100.0 / count(*), 4) AS null_pct, count(DISTINCT {n}) AS distintos FROM orders" for n in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")), "nulos distintos", "null_pct")
def _(spark, sf):
    return contract.schema_profile(c.table(spark, sf, "orders")).drop("tipo")


@query("e40_numeric_describe", " UNION ALL ".join(f"SELECT '{n}' AS coluna, count({n}) AS n, avg({n}) AS media, stddev_samp({n}) AS desvio, min({n}) AS minimo, quantile_cont({n}, 0.25) AS q1, quantile_cont({n}, 0.5) AS mediana, quantile_cont({n}, 0.75) AS q3, max({n}) AS maximo FROM lineitem" for n in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), "n", "media desvio minimo q1 mediana q3 maximo")
def _(spark, sf):
    return contract.numeric_describe(c.table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"))


@query("e41_temporal_profile", """SELECT (SELECT avg(n) FROM (SELECT count(*) AS n FROM cycles GROUP BY Fim::DATE)) AS media_dia, (SELECT avg(n) FROM (SELECT count(*) AS n FROM cycles GROUP BY date_trunc('hour', Fim))) AS media_hora,
  (SELECT avg(n) FROM (SELECT count(*) AS n FROM cycles GROUP BY Tag)) AS media_tag, (SELECT sum(n) FROM (SELECT count(*) - 1 AS n FROM cycles GROUP BY Tag, Fim)) AS duplicados""", "duplicados", "media_dia media_hora media_tag")  # fmt: skip
def _(spark, sf):
    return contract.temporal_profile(c.cycles(spark, sf))


# --- critical events and labels

_FLAGGED = """SELECT *, (sit <> '' AND niv <> '' AND ev IN ('error', 'purchase') AND sit = CASE ev WHEN 'error' THEN 'mediante alarme nivel 3' ELSE 'critico' END) AS r, ((sit = '' OR niv = '') AND ev IN ('error', 'purchase')) AS a, value > 150 AS f
  FROM (SELECT 'CA' || user_id AS TAG, ts, event_type AS ev, value, CASE WHEN event_id % 3 <> 0 THEN '' WHEN event_type = 'error' THEN 'mediante alarme nivel 3' ELSE 'critico' END AS sit, CASE WHEN event_id % 3 = 0 THEN 'muito alto' ELSE '' END AS niv FROM events)"""


def _flagged(spark, sf):
    return labeling.flag_events(labeling.prepare_events(c.telemetry(spark, sf)), labeling.critical_rules(c.rules(spark)))


@query("d1_d2_critical_events", f"SELECT DISTINCT TAG, ts AS EVENT_TIME FROM ({_FLAGGED}) WHERE r OR a OR f")
def _(spark, sf):
    return labeling.critical_events(_flagged(spark, sf))


@query("a5_event_audit", f"SELECT count(*) AS rows, count(*) FILTER (r) AS rule_matches, count(*) FILTER (a) AS event_matches, count(*) FILTER (f) AS flag_matches, count(*) FILTER (r OR a OR f) AS critical_rows FROM ({_FLAGGED})", "rows rule_matches event_matches flag_matches critical_rows")
def _(spark, sf):
    return labeling.event_audit(_flagged(spark, sf))


@query("d3_labeled_cycles", "SELECT Id, next_critical_event_time, tte_horas, target_4h FROM labeled", "target_4h", "tte_horas")
def _(spark, sf):
    return c.labeled(spark, sf).select("Id", "next_critical_event_time", "tte_horas", "target_4h")


@query("e2_label_summary", "SELECT count(*) AS rows, sum(target_4h) AS positives, avg(target_4h) AS positive_rate, min(next_critical_event_time) AS first_event, max(next_critical_event_time) AS last_event FROM labeled", "rows positives", "positive_rate")
def _(spark, sf):
    return labeling.label_summary(c.labeled(spark, sf))


@query("h2_common_tags", "SELECT count(*) AS common_tags FROM (SELECT Tag FROM cycles INTERSECT SELECT TAG FROM errors)", "common_tags")
def _(spark, sf):
    return labeling.common_tags(c.cycles(spark, sf), c.errors(spark, sf))


@query("e52_daily_episodes", "SELECT TAG, EVENT_TIME::DATE AS dia, max(EVENT_TIME) AS EVENT_TIME FROM errors GROUP BY 1, 2")
def _(spark, sf):
    return labeling.daily_episodes(c.errors(spark, sf))


# --- features

_ROLLING = ", ".join(
    f"""nullif(count(*) OVER w{h}, 0) AS n_ciclos_{h}h, avg(duracao_ciclo_min) OVER w{h} AS duracao_media_ciclo_{h}h, stddev_samp(duracao_ciclo_min) OVER w{h} AS duracao_std_ciclo_{h}h, count(DISTINCT Classe) OVER w{h} AS n_classes_distintas_{h}h,
  coalesce(count(*) OVER k{h} / nullif(count(*) OVER w{h}, 0)::DOUBLE, 0) AS freq_classe_atividade_{h}h"""
    for h in (4, 8, 24)
)
_WINDOWS = ", ".join(f"w{h} AS (PARTITION BY Tag ORDER BY epoch_us(Fim) RANGE BETWEEN {h * 3600000000} PRECEDING AND 1 PRECEDING), k{h} AS (PARTITION BY Tag, Classe ORDER BY epoch_us(Fim) RANGE BETWEEN {h * 3600000000} PRECEDING AND 1 PRECEDING)" for h in (4, 8, 24))
_ROLLING_COLUMNS = " ".join(f"{n}_{h}h" for h in (4, 8, 24) for n in ("n_ciclos", "duracao_media_ciclo", "duracao_std_ciclo", "n_classes_distintas", "freq_classe_atividade"))


@query("f1_f3_cycle_rolling", f"SELECT Id, {_ROLLING} FROM profiled WINDOW {_WINDOWS}", "", _ROLLING_COLUMNS)
def _(spark, sf):
    return features.cycle_rolling(features.calendar_features(c.cycles(spark, sf))).select("Id", *_ROLLING_COLUMNS.split())


_ALERTS = "SELECT c.Id, " + ", ".join(f"count(e.EVENT_TIME) FILTER (epoch_us(c.Fim) - epoch_us(e.EVENT_TIME) <= {h * 3600000000}) AS n_alertas_{h}h" for h in (4, 8, 24)) + ", (epoch_us(c.Fim) - epoch_us(max(e.EVENT_TIME))) / 86400e6 AS dias_desde_ultimo_alerta FROM cycles c LEFT JOIN errors e ON c.Tag = e.TAG AND e.EVENT_TIME < c.Fim GROUP BY c.Id, c.Fim"


@query("d4_d5_alert_history", f"SELECT *, n_alertas_4h / 4.0 AS alertas_por_hora_4h, n_alertas_24h / 24.0 AS alertas_por_hora_24h, CASE WHEN n_alertas_24h > 0 THEN 4 ELSE 0 END AS nivel_maximo_evento_recente FROM ({_ALERTS})", "n_alertas_4h n_alertas_8h n_alertas_24h nivel_maximo_evento_recente", "dias_desde_ultimo_alerta alertas_por_hora_4h alertas_por_hora_24h")
def _(spark, sf):
    return features.alert_history(c.cycles(spark, sf), c.errors(spark, sf)).select("Id", "n_alertas_4h", "n_alertas_8h", "n_alertas_24h", "dias_desde_ultimo_alerta", "alertas_por_hora_4h", "alertas_por_hora_24h", "nivel_maximo_evento_recente")


@query("b1_stored_alert_history", f"SELECT a.*, l.target_4h, l.tte_horas FROM ({_ALERTS}) a JOIN labeled l USING (Id)", "n_alertas_4h n_alertas_8h n_alertas_24h target_4h", "dias_desde_ultimo_alerta tte_horas")
def _(spark, sf):
    stored, run = {}, uuid.uuid4().hex
    for name, table, time, tag in (("cycles", c.cycles(spark, sf), "Fim", "Tag"), ("events", c.errors(spark, sf), "EVENT_TIME", "TAG")):
        by = layout.write_tag_days(table, f"tag_days_{name}_{run}", time, tag, path=f"{scratch_root(spark)}/tag-days-{name}-{run}")
        stored[name] = layout.read_tag_days(spark, f"tag_days_{name}_{run}")
    labeled = labeling.label_cycles(stored["cycles"], stored["events"], layout=by)
    return features.alert_history(labeled, stored["events"], layout=by).select("Id", "n_alertas_4h", "n_alertas_8h", "n_alertas_24h", "dias_desde_ultimo_alerta", "target_4h", "tte_horas")


@query("c7_degradation", f"""SELECT r.Id, coalesce(duracao_media_ciclo_4h - duracao_media_ciclo_24h, 0) AS delta_duracao_ciclo_4h_24h, coalesce(duracao_media_ciclo_4h / nullif(duracao_media_ciclo_24h, 0), 0) AS ratio_duracao_ciclo_4h_24h,
  n_alertas_4h / 4.0 - n_alertas_24h / 24.0 AS delta_alertas_por_hora_4h_24h, coalesce(n_alertas_4h / nullif(n_alertas_24h, 0)::DOUBLE, 0) AS ratio_alertas_4h_24h, coalesce(n_ciclos_4h / 4.0 - n_ciclos_24h / 24.0, 0) AS delta_n_ciclos_4h_24h_norm,
  freq_classe_atividade_4h - freq_classe_atividade_24h AS delta_freq_classe_4h_24h, n_classes_distintas_4h - n_classes_distintas_24h AS delta_classes_distintas_4h_24h
  FROM (SELECT Id, {_ROLLING} FROM profiled WINDOW {_WINDOWS}) r JOIN ({_ALERTS}) a USING (Id)""", "", "delta_duracao_ciclo_4h_24h ratio_duracao_ciclo_4h_24h delta_alertas_por_hora_4h_24h ratio_alertas_4h_24h delta_n_ciclos_4h_24h_norm delta_freq_classe_4h_24h delta_classes_distintas_4h_24h")  # fmt: skip
def _(spark, sf):
    f = features.build_features(c.labeled(spark, sf), c.errors(spark, sf))
    return f.select("Id", *[n for n in f.columns if n.startswith(("delta_", "ratio_"))])


@query("d6_maintenance_history", """SELECT c.Id, (epoch_us(c.Fim) - epoch_us(m.data_manutencao)) / 86400e6 AS dias_desde_ultima_manutencao, CASE WHEN m.tipo = 'corretiva' AND epoch_us(c.Fim) - epoch_us(m.data_manutencao) <= 7 * 86400000000 THEN 1.0 ELSE 0.0 END AS manutencao_corretiva_7d
  FROM cycles c ASOF LEFT JOIN mnt m ON c.Tag = m.Tag AND c.Fim > m.data_manutencao""", "", "dias_desde_ultima_manutencao manutencao_corretiva_7d")  # fmt: skip
def _(spark, sf):
    return features.maintenance_history(c.cycles(spark, sf), c.orders(spark, sf)).select("Id", "dias_desde_ultima_manutencao", "manutencao_corretiva_7d")


_LABELED = ("Id", "Inicio", "Fim", "Tag", "Frota", "Tipo", "Classe", "Matricula_Operador_Hash", "next_critical_event_time", "tte_horas", "target_4h")


@query("e3_null_profile", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS coluna, round(100.0 * avg(({n} IS NULL)::INT), 4) AS null_pct FROM labeled" for n in _LABELED) + ") ORDER BY null_pct DESC, coluna LIMIT 5", "", "null_pct")
def _(spark, sf):
    return features.null_profile(c.labeled(spark, sf), 5)


# --- splits and encodings


@query("i1_split_metadata", "SELECT coalesce(split, 'embargo') AS split, count(*) AS rows, min(Fim) AS start, max(Fim) AS \"end\" FROM scored GROUP BY 1", "rows")
def _(spark, sf):
    return splits.split_metadata(c.scored(spark, sf))


_FOLD_ROWS = """SELECT f.fold, p.Fim, p.Tag, p.score, p.target_4h, CASE WHEN k < a THEN CASE WHEN epoch_us(p.Fim) < ta - 14400000000 THEN 'train' END WHEN k < b THEN CASE WHEN epoch_us(p.Fim) < tb - 14400000000 THEN 'val' END WHEN k < e THEN 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY Fim, Id) - 1 AS k FROM scored) p, (SELECT fold, a, b, e, (SELECT epoch_us(Fim) FROM (SELECT Fim, row_number() OVER (ORDER BY Fim, Id) - 1 AS k FROM labeled) WHERE k = a) AS ta, (SELECT epoch_us(Fim) FROM (SELECT Fim, row_number() OVER (ORDER BY Fim, Id) - 1 AS k FROM labeled) WHERE k = b) AS tb
  FROM (SELECT fold, a, least(a + v, n - v) AS b, least(least(a + v, n - v) + v, n) AS e FROM (SELECT x.fold, n, CAST(floor(n * (0.5::DOUBLE + x.fold * ((1.0::DOUBLE - 0.5 - 0.1 - 0.1) / 2))) AS BIGINT) AS a, CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS v FROM (SELECT count(*) AS n FROM labeled), (VALUES (0), (1), (2)) AS x(fold)))) f"""
_FOLDS = f"""SELECT fold, split, count(*) AS rows, min(Fim) AS start, max(Fim) AS "end" FROM ({_FOLD_ROWS}) WHERE split IS NOT NULL GROUP BY 1, 2"""


@query("i2_backtest_folds", _FOLDS, "fold rows")
def _(spark, sf):
    return splits.backtest_folds(c.labeled(spark, sf)).groupBy("fold", "split").agg(F.count(F.lit(1)).alias("rows"), F.min("Fim").alias("start"), F.max("Fim").alias("end"))


@query("i3_repeatable_sample")
def _(spark, sf):
    return splits.repeatable_sample(c.cycles(spark, sf), 500)


@query("d7_encoded", """SELECT s.Id, coalesce(t.f, 0) AS Tag_freq, coalesce(o.f, 0) AS Operador_freq, coalesce(k.m, g.m) AS Classe_target_enc, Tipo = 'Caminhao' AS Tipo_Caminhao, Frota = 'F0' AS Frota_F0 FROM scored s
  LEFT JOIN (SELECT Tag, count(*) / (SELECT count(*) FROM scored WHERE split = 'train')::DOUBLE AS f FROM scored WHERE split = 'train' GROUP BY 1) t ON s.Tag = t.Tag
  LEFT JOIN (SELECT Matricula_Operador_Hash AS op, count(*) / (SELECT count(Matricula_Operador_Hash) FROM scored WHERE split = 'train')::DOUBLE AS f FROM scored WHERE split = 'train' AND op IS NOT NULL GROUP BY 1) o ON s.Matricula_Operador_Hash = o.op
  LEFT JOIN (SELECT Classe, avg(target_4h) AS m FROM scored WHERE split = 'train' GROUP BY 1) k ON s.Classe IS NOT DISTINCT FROM k.Classe, (SELECT avg(target_4h) AS m FROM scored WHERE split = 'train') g WHERE s.split IN ('val', 'test')""", "", "Tag_freq Operador_freq Classe_target_enc")  # fmt: skip
def _(spark, sf):
    s = c.scored(spark, sf)
    enc = encoding.fit_encoder(s.where("split = 'train'"))
    return encoding.transform_if_needed(s.where("split in ('val', 'test')"), enc).select("Id", "Tag_freq", "Operador_freq", "Classe_target_enc", "Tipo_Caminhao", "Frota_F0")


@query("e4_tag_frequency", "SELECT Tag AS value, count(*) / sum(count(*)) OVER ()::DOUBLE AS freq FROM cycles GROUP BY 1", "", "freq")
def _(spark, sf):
    return encoding.frequencies(c.cycles(spark, sf), "Tag")


@query("e5_class_target", "SELECT Classe AS value, avg(target_4h) AS enc FROM labeled GROUP BY 1", "", "enc")
def _(spark, sf):
    return encoding.target_means(c.labeled(spark, sf))


@query("f6_out_of_fold_target", """SELECT Id, b AS block, coalesce((SELECT avg(target_4h) FROM n m WHERE m.b < n.b AND m.Classe = n.Classe), (SELECT avg(target_4h) FROM n m WHERE m.b < n.b), 0) AS Classe_target_enc
  FROM n""".replace("FROM n m", "FROM blocks m").replace("\n  FROM n", "\n  FROM blocks n"), "block", "Classe_target_enc")  # fmt: skip
def _(spark, sf):
    return encoding.out_of_fold_target(c.labeled(spark, sf)).select("Id", "block", "Classe_target_enc")


ORACLES["f6_out_of_fold_target"] = ORACLES["f6_out_of_fold_target"].replace(
    ", result AS (SELECT Id", """, blocks AS (SELECT *, ntile(5) OVER (ORDER BY Fim, Id) AS b FROM labeled), sums AS (SELECT b, Classe, sum(target_4h) AS s, count(*) AS c FROM blocks GROUP BY 1, 2),
own AS (SELECT DISTINCT x.b, x.Classe, (SELECT sum(s) / sum(c)::DOUBLE FROM sums y WHERE y.b < x.b AND y.Classe = x.Classe) AS o, (SELECT sum(s) / sum(c)::DOUBLE FROM sums y WHERE y.b < x.b) AS h FROM sums x), result AS (SELECT Id""").replace("coalesce((SELECT avg(target_4h) FROM blocks m WHERE m.b < n.b AND m.Classe = n.Classe), (SELECT avg(target_4h) FROM blocks m WHERE m.b < n.b), 0)", "coalesce(o, h, 0)").replace("SELECT Id, b AS block", "SELECT Id, n.b AS block").replace("FROM blocks n)", "FROM blocks n JOIN own ON n.b = own.b AND n.Classe = own.Classe)")  # fmt: skip


@query("f7_expanding_target", """SELECT Id, coalesce(avg(target_4h) OVER (PARTITION BY Classe ORDER BY Fim, Id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), avg(target_4h) OVER (ORDER BY Fim, Id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS Classe_target_enc FROM labeled""", "", "Classe_target_enc")
def _(spark, sf):
    return encoding.expanding_target(c.labeled(spark, sf)).select("Id", "Classe_target_enc")


# --- metrics

_COUNTS = "SELECT split, score, count(*) AS n, sum(target_4h) AS p, sum(count(*)) OVER (PARTITION BY split ORDER BY score DESC) AS cn, sum(sum(target_4h)) OVER (PARTITION BY split ORDER BY score DESC) AS cp, sum(count(*)) OVER (PARTITION BY split) AS tn, sum(sum(target_4h)) OVER (PARTITION BY split) AS tp FROM scored WHERE split IS NOT NULL GROUP BY 1, 2"


def _known(spark, sf):
    return c.scored(spark, sf).where("split is not null")


@query("e6_e8_threshold_metrics", """SELECT *, CASE WHEN prevalence > 0 THEN precision / prevalence ELSE 0 END AS lift_vs_random FROM (SELECT split, count(*) AS rows, avg(target_4h) AS prevalence, count(*) FILTER (prediction = 1) AS predicted_positive, count(*) FILTER (prediction = 1 AND target_4h = 1) AS true_positive, count(*) FILTER (prediction = 1 AND target_4h = 0) AS false_positive,
  count(*) FILTER (prediction = 0 AND target_4h = 1) AS false_negative, count(*) FILTER (prediction = 1 AND target_4h = 1) / count(*) FILTER (prediction = 1)::DOUBLE AS precision, count(*) FILTER (prediction = 1 AND target_4h = 1) / count(*) FILTER (target_4h = 1)::DOUBLE AS recall,
  2.0 * count(*) FILTER (prediction = 1 AND target_4h = 1) / (count(*) FILTER (prediction = 1) + count(*) FILTER (target_4h = 1)) AS f1 FROM scored WHERE split IS NOT NULL GROUP BY 1)""", "rows predicted_positive true_positive false_positive false_negative", "prevalence precision recall f1 lift_vs_random")  # fmt: skip
def _(spark, sf):
    return metrics.binary_metrics(_known(spark, sf), ["split"])


@query("e7_ranking_metrics", f"SELECT split, sum(p / tp::DOUBLE * cp / cn) AS auc_pr, sum(p * ((tn - cn) - (tp - cp) + 0.5 * (n - p))) / (max(tp) * (max(tn) - max(tp)))::DOUBLE AS auc_roc FROM ({_COUNTS}) GROUP BY 1", "", "auc_pr auc_roc")
def _(spark, sf):
    return metrics.ranking_metrics(_known(spark, sf), ["split"])


_MARKS = "SELECT DISTINCT unnest(quantile_cont(score, [" + ", ".join(repr(k / 100) for k in range(101)) + "])) AS threshold FROM scored"
_CURVE = f"SELECT m.threshold, count(*) AS predicted_positive, count(*) / (SELECT count(*) FROM scored)::DOUBLE AS predicted_positive_rate, sum(target_4h) / count(*)::DOUBLE AS precision, sum(target_4h) / (SELECT sum(target_4h) FROM scored)::DOUBLE AS recall, 2.0 * sum(target_4h) / (count(*) + (SELECT sum(target_4h) FROM scored)) AS f1, count(*) - sum(target_4h) AS false_positive, (SELECT sum(target_4h) FROM scored) - sum(target_4h) AS false_negative FROM scored JOIN ({_MARKS}) m ON score >= m.threshold GROUP BY 1"


@query("e19_threshold_curve", _CURVE, "predicted_positive false_positive false_negative", "threshold predicted_positive_rate precision recall f1")
def _(spark, sf):
    return metrics.threshold_curve(c.scored(spark, sf))


@query("e18_calibrated_threshold", f"SELECT threshold, 0.8 AS target_recall, recall AS achieved_recall, precision AS achieved_precision, predicted_positive_rate AS alert_rate, recall >= 0.8 AS target_met, predicted_positive_rate >= 0.99 AS degenerate FROM ({_CURVE}) ORDER BY recall >= 0.8 DESC, CASE WHEN recall >= 0.8 THEN precision ELSE recall END DESC, threshold LIMIT 1", "", "threshold target_recall achieved_recall achieved_precision alert_rate")
def _(spark, sf):
    return metrics.calibrated_threshold(c.scored(spark, sf))


@query("e20_calibration_error", "SELECT sum(n * abs(s - y)) / sum(n) AS ece FROM (SELECT least(floor(score * 10), 9) AS b, count(*) AS n, avg(score) AS s, avg(target_4h) AS y FROM scored GROUP BY 1)", "", "ece")
def _(spark, sf):
    return metrics.calibration_error(c.scored(spark, sf))


@query("e45_curve_points", f"SELECT split, score, cp / cn::DOUBLE AS precision, cp / tp::DOUBLE AS recall, (cn - cp) / (tn - tp)::DOUBLE AS fpr FROM ({_COUNTS})", "", "score precision recall fpr")
def _(spark, sf):
    return metrics.curve_points(_known(spark, sf), ["split"])


@query("e45_trapezoid_areas", f"SELECT split, sum((cp - pp) / tp::DOUBLE * (cp / cn::DOUBLE + CASE WHEN pn > 0 THEN pp / pn::DOUBLE ELSE 1 END) / 2) AS area_pr, sum(((cn - cp) - (pn - pp)) / (tn - tp)::DOUBLE * (cp + pp) / tp / 2) AS area_roc FROM (SELECT *, cn - n AS pn, cp - p AS pp FROM ({_COUNTS})) GROUP BY 1", "", "area_pr area_roc")
def _(spark, sf):
    return metrics.trapezoid_areas(_known(spark, sf), ["split"])


@query("e46_closest_point", f"SELECT * FROM ({_CURVE}) ORDER BY abs(threshold - 0.4122), threshold LIMIT 1", "predicted_positive false_positive false_negative", "threshold predicted_positive_rate precision recall f1")
def _(spark, sf):
    return metrics.closest_point(metrics.threshold_curve(c.scored(spark, sf)), 0.4122)


# --- scorecards


@query("e10_tag_day_panel", "SELECT * FROM panel", "target_4h ciclos", "score")
def _(spark, sf):
    return scorecard.tag_day_panel(c.scored(spark, sf))


_SPLIT_PANEL = "SELECT split, data, Tag, score, target_4h, row_number() OVER (PARTITION BY split, data ORDER BY score DESC, Tag) AS rank FROM (SELECT split, Fim::DATE AS data, Tag, max(score) AS score, max(target_4h) AS target_4h FROM scored WHERE split IS NOT NULL GROUP BY 1, 2, 3)"


def _topk_sql(by: str, panel: str, ks: str) -> str:
    return f"""SELECT {by}, tag_days, days, total_positives, tag_day_prevalence, top_k_tags_per_day, selected_alerts, positives_captured, selected_alerts / days::DOUBLE AS alerts_per_day, positives_captured / selected_alerts::DOUBLE AS precision_at_k, coalesce(positives_captured / nullif(total_positives, 0)::DOUBLE, 0) AS recall_at_k,
  coalesce(positives_captured / selected_alerts::DOUBLE / nullif(tag_day_prevalence, 0), 0) AS lift_vs_random FROM (SELECT {by}, k AS top_k_tags_per_day, count(*) AS tag_days, count(DISTINCT data) AS days, sum(target_4h) AS total_positives, avg(target_4h) AS tag_day_prevalence, count(*) FILTER (rank <= k) AS selected_alerts, coalesce(sum(target_4h) FILTER (rank <= k), 0) AS positives_captured
  FROM ({panel}), (VALUES {ks}) AS ks(k) GROUP BY {by}, k)"""


_TOPK_LONGS, _TOPK_DOUBLES = "tag_days days total_positives top_k_tags_per_day selected_alerts positives_captured", "tag_day_prevalence alerts_per_day precision_at_k recall_at_k lift_vs_random"
_TOPK = _topk_sql("split", _SPLIT_PANEL, "(3), (5), (10), (15), (20)")


@query("e12_daily_topk", _TOPK, _TOPK_LONGS, _TOPK_DOUBLES)
def _(spark, sf):
    return scorecard.topk_metrics(scorecard.tag_day_panel(_known(spark, sf), ["split"]), ["split"])


@query("e12_daily_topk_orders", _topk_sql("1 AS one", "SELECT o_orderdate::DATE AS data, o_custkey AS Tag, score, target_4h, row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY score DESC, o_custkey) AS rank FROM (SELECT o_orderdate, o_custkey, max(floor(o_totalprice / 50000)) AS score, max(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS target_4h FROM orders GROUP BY 1, 2)", "(3), (5)").replace("GROUP BY 1 AS one, k", "GROUP BY k").replace("SELECT 1 AS one, tag_days", "SELECT tag_days"), _TOPK_LONGS, _TOPK_DOUBLES)
def _(spark, sf):
    o = c.table(spark, sf, "orders").select(F.col("o_orderdate").alias("Fim"), F.col("o_custkey").alias("Tag"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("score"), F.col("o_orderpriority").startswith("1").cast("int").alias("target_4h"))
    return scorecard.topk_metrics(scorecard.tag_day_panel(o), ks=(3, 5))


_SEGMENTS = " UNION ALL ".join(f"SELECT '{s}' AS segment_col, {s} AS segment_value, * FROM scored" for s in ("Classe", "turno", "Frota", "Tipo"))
_SEGMENT_PANEL = f"SELECT *, row_number() OVER (PARTITION BY segment_col, segment_value, data ORDER BY score DESC, Tag) AS rank FROM (SELECT segment_col, segment_value, Fim::DATE AS data, Tag, max(score) AS score, max(target_4h) AS target_4h FROM ({_SEGMENTS}) GROUP BY 1, 2, 3, 4)"
_SEGMENT_TOPK = f"SELECT *, CASE WHEN tag_days < 20 THEN 'inconclusivo_baixa_amostra' WHEN total_positives < 10 THEN 'inconclusivo_baixa_prevalencia' ELSE 'ok' END AS status, CASE WHEN tag_days < 20 THEN 'coletar mais dias de observacao' WHEN total_positives < 10 THEN 'tratar segmento em trilha separada' ELSE 'usar TopK como canal principal' END AS recommendation FROM ({_topk_sql('segment_col, segment_value', _SEGMENT_PANEL, '(3), (5), (10), (15)')})"


@query("e13_topk_by_segment", _SEGMENT_TOPK, _TOPK_LONGS, _TOPK_DOUBLES)
def _(spark, sf):
    return scorecard.topk_by_segment(scorecard.with_segments(c.scored(spark, sf)))


@query("e9_threshold_by_segment", f"""SELECT *, CASE WHEN prevalence > 0 THEN precision / prevalence ELSE 0 END AS lift_vs_random, predicted_positive / rows::DOUBLE AS predicted_positive_rate, CASE WHEN rows < 50 THEN 'inconclusivo_baixa_amostra' WHEN true_positive + false_negative < 10 THEN 'inconclusivo_baixa_prevalencia' ELSE 'ok' END AS status,
  CASE WHEN rows < 50 THEN 'coletar mais dados antes de decidir por segmento' WHEN true_positive + false_negative < 10 THEN 'avaliar regra heuristica ou janela de avaliacao maior' ELSE 'manter threshold global e monitorar' END AS recommendation FROM (SELECT segment_col, segment_value, count(*) AS rows, avg(target_4h) AS prevalence, count(*) FILTER (prediction = 1) AS predicted_positive, count(*) FILTER (prediction = 1 AND target_4h = 1) AS true_positive,
  count(*) FILTER (prediction = 1 AND target_4h = 0) AS false_positive, count(*) FILTER (prediction = 0 AND target_4h = 1) AS false_negative, coalesce(count(*) FILTER (prediction = 1 AND target_4h = 1) / nullif(count(*) FILTER (prediction = 1), 0)::DOUBLE, 0) AS precision, coalesce(count(*) FILTER (prediction = 1 AND target_4h = 1) / nullif(count(*) FILTER (target_4h = 1), 0)::DOUBLE, 0) AS recall,
  coalesce(2.0 * count(*) FILTER (prediction = 1 AND target_4h = 1) / nullif(count(*) FILTER (prediction = 1) + count(*) FILTER (target_4h = 1), 0), 0) AS f1 FROM ({_SEGMENTS}) GROUP BY 1, 2)""", "rows predicted_positive true_positive false_positive false_negative", "prevalence precision recall f1 lift_vs_random predicted_positive_rate")  # fmt: skip
def _(spark, sf):
    return scorecard.threshold_by_segment(scorecard.with_segments(c.scored(spark, sf)))


@query("e14_primary_topk", f"SELECT * FROM (SELECT max(CASE WHEN split = 'train' THEN precision_at_k END) AS train_top15_precision_at_k, max(CASE WHEN split = 'val' THEN precision_at_k END) AS val_top15_precision_at_k, max(CASE WHEN split = 'test' THEN recall_at_k END) AS test_top15_recall_at_k, max(CASE WHEN split = 'test' THEN lift_vs_random END) AS test_top15_lift_vs_random FROM ({_TOPK}) WHERE top_k_tags_per_day = 15)", "", "train_top15_precision_at_k val_top15_precision_at_k test_top15_recall_at_k test_top15_lift_vs_random")
def _(spark, sf):
    t = scorecard.topk_metrics(scorecard.tag_day_panel(_known(spark, sf), ["split"]), ["split"])
    return scorecard.primary_by_split(t).select("train_top15_precision_at_k", "val_top15_precision_at_k", "test_top15_recall_at_k", "test_top15_lift_vs_random")


_HOTSPOTS = "SELECT *, coalesce(true_positive_days / nullif(selected_days, 0)::DOUBLE, 0) AS selected_precision, positive_days / tag_days::DOUBLE AS positive_day_rate FROM (SELECT Tag, count(*) AS tag_days, avg(score) AS avg_score, max(score) AS max_score, sum(target_4h) AS positive_days, count(*) FILTER (rank <= 15) AS selected_days, count(*) FILTER (rank <= 15 AND target_4h = 1) AS true_positive_days, count(*) FILTER (rank <= 15 AND target_4h = 0) AS false_positive_days, count(*) FILTER (rank > 15 AND target_4h = 1) AS missed_positive_days FROM ranked GROUP BY 1 HAVING count(*) >= 5)"


@query("e15_tag_hotspots", _HOTSPOTS, "tag_days positive_days selected_days true_positive_days false_positive_days missed_positive_days", "avg_score max_score selected_precision positive_day_rate")
def _(spark, sf):
    return scorecard.tag_hotspots(c.scored(spark, sf))


@query("g2_budget_metrics", """SELECT split, budget_pct, selected_rows, selected_rows / days AS alerts_per_day, tp / selected_rows AS precision_at_budget, tp / total_positives::DOUBLE AS recall_at_budget, tp / selected_rows / prevalence AS lift_vs_random, tp AS positives_captured, total_positives FROM (SELECT split, b AS budget_pct, greatest(ceil(n * b), 1) AS selected_rows, any_value(d) AS days, any_value(prev) AS prevalence, any_value(total) AS total_positives, sum(target_4h) FILTER (r <= greatest(ceil(n * b), 1)) AS tp
  FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY score DESC, Id) AS r, count(*) OVER (PARTITION BY split) AS n, avg(target_4h) OVER (PARTITION BY split) AS prev, sum(target_4h) OVER (PARTITION BY split) AS total, floor((epoch_us(max(Fim) OVER (PARTITION BY split)) - epoch_us(min(Fim) OVER (PARTITION BY split))) / 86400e6) + 1 AS d FROM scored WHERE split IS NOT NULL),
  (VALUES (0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) AS bs(b) GROUP BY 1, 2, 3)""", "selected_rows positives_captured total_positives", "budget_pct alerts_per_day precision_at_budget recall_at_budget lift_vs_random")  # fmt: skip
def _(spark, sf):
    return scorecard.budget_metrics(_known(spark, sf))


_KEPT = """(WITH RECURSIVE a AS (SELECT Tag, Id, epoch_us(Fim) AS us, target_4h FROM {rows} WHERE prediction = 1), k AS (SELECT Tag, min(us) AS us FROM a GROUP BY 1 UNION ALL SELECT k.Tag, (SELECT min(us) FROM a WHERE a.Tag = k.Tag AND a.us >= k.us + 14400000000) FROM k WHERE k.us IS NOT NULL)
  SELECT a.Tag, min(a.Id) AS Id, a.us, arg_min(target_4h, a.Id) AS target_4h FROM k JOIN a ON a.Tag = k.Tag AND a.us = k.us GROUP BY 1, 3)"""


@query("f5_cooldown_dedup", "SELECT Tag, Id, make_timestamp(us) AS Fim FROM " + _KEPT.format(rows="scored"))
def _(spark, sf):
    return scorecard.cooldown_dedup(c.scored(spark, sf)).select("Tag", "Id", "Fim")


@query("e16_dedup_summary", "SELECT 'test' AS split, 4.0 AS cooldown_hours, raw AS raw_predicted_positive, n AS deduplicated_alerts, n / days AS deduplicated_alerts_per_day, tp / n::DOUBLE AS deduplicated_precision, tp / pos::DOUBLE AS row_positive_capture_after_dedup FROM (SELECT sum(prediction) AS raw, sum(target_4h) AS pos, floor((epoch_us(max(Fim)) - epoch_us(min(Fim))) / 86400e6) + 1 AS days FROM scored WHERE split = 'test'), (SELECT count(*) AS n, sum(target_4h) AS tp FROM " + _KEPT.format(rows="(SELECT * FROM scored WHERE split = 'test')") + ")", "raw_predicted_positive deduplicated_alerts", "cooldown_hours deduplicated_alerts_per_day deduplicated_precision row_positive_capture_after_dedup")
def _(spark, sf):
    return scorecard.dedup_summary(c.scored(spark, sf))


@query("e17_extreme_false_negatives", "SELECT Frota, Tipo, Classe, count(*) AS count FROM scored WHERE split = 'test' AND target_4h = 1 AND score <= (SELECT quantile_cont(score, 0.1) FROM scored WHERE split = 'test' AND target_4h = 1) GROUP BY 1, 2, 3", "count")
def _(spark, sf):
    return scorecard.extreme_false_negatives(c.scored(spark, sf))


@query("e44_error_analysis", "SELECT Tag, Frota, Tipo, Classe, count(*) AS fn FROM scored WHERE target_4h = 1 AND prediction = 0 GROUP BY 1, 2, 3, 4 ORDER BY fn DESC, Tag, Frota, Tipo, Classe LIMIT 12", "fn")
def _(spark, sf):
    return scorecard.error_analysis(c.scored(spark, sf))


@query("e44_error_totals", """SELECT split, count(*) AS linhas, count(*) FILTER (target_4h = 1 AND prediction = 0) AS fn, count(*) FILTER (target_4h = 0 AND prediction = 1) AS fp,
  round(coalesce(100.0 * fn / nullif(count(*) FILTER (target_4h = 1), 0), 0), 4) AS fn_pct, round(coalesce(100.0 * fp / nullif(count(*) FILTER (prediction = 1), 0), 0), 4) AS fp_pct FROM scored GROUP BY split""", "linhas fn fp", "fn_pct fp_pct")  # fmt: skip
def _(spark, sf):
    return scorecard.error_totals(c.scored(spark, sf))


@query("e51_random_baseline", "SELECT count(*) AS days, sum(p) AS positives, sum(p * least(1.0, 15.0 / n)) AS random_captures, sum(m) AS model_captures FROM (SELECT data, count(*) AS n, sum(target_4h) AS p, coalesce(sum(target_4h) FILTER (rank <= 15), 0) AS m FROM ranked GROUP BY 1)", "days positives model_captures", "random_captures")
def _(spark, sf):
    return scorecard.random_baseline(scorecard.tag_day_panel(c.scored(spark, sf)))


@query("g5_segment_lists", f"""SELECT 'mais_fracos' AS lista, row_number() OVER (ORDER BY recall_at_k, precision_at_k, segment_col, segment_value) AS posicao, segment_col, segment_value, recall_at_k, precision_at_k, lift_vs_random, status FROM (SELECT * FROM ({_SEGMENT_TOPK}) WHERE top_k_tags_per_day = 15) QUALIFY posicao <= 10
  UNION ALL SELECT 'mais_fortes', row_number() OVER (ORDER BY lift_vs_random DESC, precision_at_k DESC, segment_col, segment_value) AS posicao, segment_col, segment_value, recall_at_k, precision_at_k, lift_vs_random, status FROM (SELECT * FROM ({_SEGMENT_TOPK}) WHERE top_k_tags_per_day = 15) QUALIFY posicao <= 10
  UNION ALL SELECT 'inconclusivos', row_number() OVER (ORDER BY segment_col, segment_value) AS posicao, segment_col, segment_value, recall_at_k, precision_at_k, lift_vs_random, status FROM (SELECT * FROM ({_SEGMENT_TOPK}) WHERE top_k_tags_per_day = 15 AND status LIKE 'inconclusivo%') QUALIFY posicao <= 10""", "posicao", "recall_at_k precision_at_k lift_vs_random")  # fmt: skip
def _(spark, sf):
    return scorecard.weakest_and_strongest(scorecard.topk_by_segment(scorecard.with_segments(c.scored(spark, sf))))


# --- ranking

_PRIORITY = """SELECT data, rank, Tag, round(score, 6) AS score, Frota, Tipo, turno, motivo_principal, risco_segmento, CASE WHEN risco_segmento LIKE 'alto%' THEN 'inspecionar primeiro e registrar achado operacional' WHEN risco_segmento LIKE 'medio%' THEN 'verificar na ronda diaria e acompanhar tendencia' ELSE 'monitorar no painel e reavaliar no proximo ciclo' END AS acao_recomendada FROM (
  SELECT *, CASE WHEN score >= threshold THEN 'alto_acima_threshold' WHEN rank <= 5 THEN 'alto_por_ranking' WHEN rank <= 10 THEN 'medio_por_ranking' ELSE 'monitorar_por_ranking' END AS risco_segmento FROM (SELECT *, row_number() OVER (PARTITION BY data ORDER BY score DESC, Tag) AS rank FROM (
  SELECT s.*, Fim::DATE AS data, CASE WHEN n_alertas_4h > 0 THEN 'alertas recentes na janela de 4h' WHEN n_alertas_24h > 0 THEN 'historico recente de alertas em 24h' WHEN dias_desde_ultimo_alerta > 0 AND dias_desde_ultimo_alerta <= 1 THEN 'alerta critico observado no ultimo dia' ELSE 'maior score diario do modelo' END AS motivo_principal
  FROM scored s JOIN (""" + _ALERTS + """) a ON s.Id = a.Id QUALIFY row_number() OVER (PARTITION BY data, Tag ORDER BY score DESC, s.Id) = 1)) WHERE rank <= 15)"""  # fmt: skip


def _priority(spark, sf):
    return ranking.daily_priority(features.alert_history(c.scored(spark, sf), c.errors(spark, sf)))


@query("g1_daily_priority", _PRIORITY, "rank", "score")
def _(spark, sf):
    return _priority(spark, sf)


# --- drift


def _halves(spark, sf):
    rows = c.profiled(spark, sf).join(scorecard.scored_frame(c.labeled(spark, sf), (F.col("Id") * 7919 % 10007) / 10007, 0.5).select("Id", "score", "prediction"), "Id")
    return rows.where("Fim < '2024-01-16'"), rows.where("Fim >= '2024-01-16'")


_FEATURES = ["duracao_ciclo_min", "hora", "dia_da_semana", "score"]
_PSI = """WITH q AS (SELECT f, v, h FROM (SELECT unnest(['duracao_ciclo_min', 'hora', 'dia_da_semana', 'score']) AS f, unnest([duracao_ciclo_min, hora::DOUBLE, dia_da_semana::DOUBLE, score]) AS v, CASE WHEN Fim < '2024-01-16' THEN 0 ELSE 1 END AS h FROM scored)),
  e AS (SELECT f, CASE WHEN count(DISTINCT v) <= 25 THEN list_transform(generate_series(1, count(DISTINCT v) - 1), lambda i: (list_sort(list(DISTINCT v))[i] + list_sort(list(DISTINCT v))[i + 1]) / 2) ELSE quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) END AS edges FROM q WHERE h = 0 GROUP BY f),
  b AS (SELECT q.f, h, len(list_filter(edges, lambda x: x <= v)) AS bin, count(*) AS c FROM q JOIN e ON q.f = e.f GROUP BY 1, 2, 3),
  g AS (SELECT e.f, unnest(generate_series(0, len(edges))) AS bin FROM e),
  p AS (SELECT g.f, g.bin, greatest(coalesce(r.c, 0) / (SELECT sum(c) FROM b WHERE b.f = g.f AND h = 0)::DOUBLE, 1e-6) AS r, greatest(coalesce(k.c, 0) / (SELECT sum(c) FROM b WHERE b.f = g.f AND h = 1)::DOUBLE, 1e-6) AS k FROM g LEFT JOIN b r ON r.f = g.f AND r.bin = g.bin AND r.h = 0 LEFT JOIN b k ON k.f = g.f AND k.bin = g.bin AND k.h = 1)
  SELECT f AS feature, sum((k - r) * ln(k / r)) AS psi, CASE WHEN sum((k - r) * ln(k / r)) < 0.1 THEN 'estavel' WHEN sum((k - r) * ln(k / r)) < 0.25 THEN 'moderado' ELSE 'significativo' END AS faixa FROM p GROUP BY 1"""


@query("e21_e25_feature_drift", _PSI, "", "psi")
def _(spark, sf):
    a, b = _halves(spark, sf)
    return drift.feature_drift(b, drift.reference_profile(a, _FEATURES))


@query("e24_merged_profile", """SELECT 'hora' AS feature, row_number() OVER (ORDER BY hora) - 1 AS bin, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM profiled GROUP BY hora
  UNION ALL SELECT 'dia_da_semana', row_number() OVER (ORDER BY dia_da_semana) - 1, count(*)::DOUBLE / sum(count(*)) OVER () FROM profiled GROUP BY dia_da_semana""", "bin", "p")  # fmt: skip
def _(spark, sf):
    rows = c.profiled(spark, sf).withColumn("dia", F.to_date("Fim"))
    parts = drift_parts.feature_parts(rows, ["hora", "dia_da_semana"], "dia")
    months = drift_parts.merge_features(parts, F.substring("periodo", 1, 7))
    return drift_parts.profile_of(months).select("feature", F.posexplode("proportions").alias("bin", "p"))


@query("e24_merged_alerts", "SELECT strftime(Fim, '%Y-%m') AS mes, count(*) AS linhas, sum(prediction) AS alertas FROM scored GROUP BY 1", "linhas alertas")
def _(spark, sf):
    parts = drift_parts.alert_parts(c.scored(spark, sf).withColumn("dia", F.to_date("Fim")), "dia")
    return parts.groupBy(F.substring("periodo", 1, 7).alias("mes")).agg(F.sum("linhas").alias("linhas"), F.sum("alertas").alias("alertas"))


@query("e24_merged_categories", "SELECT segmento, categoria, count(*) AS n FROM (SELECT unnest(['Frota', 'turno', 'Classe']) AS segmento, unnest([Frota, turno, Classe]) AS categoria FROM scored) WHERE categoria IS NOT NULL GROUP BY 1, 2", "n")
def _(spark, sf):
    parts = drift_parts.category_parts(c.scored(spark, sf).withColumn("dia", F.to_date("Fim")), ["Frota", "turno", "Classe"], "dia")
    return parts.groupBy("segmento", "categoria").agg(F.sum("n").alias("n"))


@query("e25_alert_volume", "SELECT a AS esperado, b AS observado, abs(b - a) / a AS variacao_relativa, abs(b - a) / a > 0.5 AS fora_da_tolerancia FROM (SELECT avg(prediction) FILTER (Fim < '2024-01-16') AS a, avg(prediction) FILTER (Fim >= '2024-01-16') AS b FROM scored)", "", "esperado observado variacao_relativa")
def _(spark, sf):
    a, b = _halves(spark, sf)
    return drift.alert_volume(a.agg(F.avg("prediction")).first()[0], b)


@query("h3_segment_drift", "SELECT 'Tag' AS segmento, Tag AS categoria, 'nova' AS estado FROM (SELECT DISTINCT Tag FROM cycles WHERE Fim >= '2024-01-02' EXCEPT SELECT DISTINCT Tag FROM cycles WHERE Fim < '2024-01-02') UNION ALL SELECT 'Tag', Tag, 'ausente' FROM (SELECT DISTINCT Tag FROM cycles WHERE Fim < '2024-01-02' EXCEPT SELECT DISTINCT Tag FROM cycles WHERE Fim >= '2024-01-02')")
def _(spark, sf):
    rows = c.cycles(spark, sf)
    return drift.segment_drift(rows.where("Fim < '2024-01-02'"), rows.where("Fim >= '2024-01-02'"), ["Tag", "Frota"])


_REASONS = f"""SELECT f, s, v, k FROM (SELECT count(*) FILTER (feature <> 'score' AND faixa = 'significativo') > 3 AS f, count(*) FILTER (feature = 'score' AND faixa = 'significativo') > 0 AS s FROM ({_PSI})),
  (SELECT abs(b - a) / a > 0.5 AS v FROM (SELECT avg(prediction) FILTER (Fim < '2024-01-16') AS a, avg(prediction) FILTER (Fim >= '2024-01-16') AS b FROM scored)),
  (SELECT count(*) > 0 AS k FROM (SELECT DISTINCT unnest(['Frota', 'turno']) AS s, unnest([Frota, turno]) AS x FROM scored WHERE Fim >= '2024-01-16' EXCEPT SELECT DISTINCT unnest(['Frota', 'turno']), unnest([Frota, turno]) FROM scored WHERE Fim < '2024-01-16'))"""


@query("e26_retrain_reasons", f"SELECT f OR s OR v OR k AS retreinar, array_to_string(list_filter([CASE WHEN f THEN 'features' END, CASE WHEN s THEN 'score' END, CASE WHEN v THEN 'volume' END, CASE WHEN k THEN 'categorias' END], lambda x: x IS NOT NULL), ',') AS motivos FROM ({_REASONS})")
def _(spark, sf):
    a, b = _halves(spark, sf)
    found = drift.feature_drift(b, drift.reference_profile(a, _FEATURES))
    rate = a.agg(F.avg("prediction")).first()[0]
    return drift.retrain_reasons(found.where("feature <> 'score'"), found.where("feature = 'score'"), drift.alert_volume(rate, b), drift.segment_drift(a, b, ["Frota", "turno"]))


# --- governance

_FOLD_PANEL = f"SELECT *, row_number() OVER (PARTITION BY fold, data ORDER BY score DESC, Tag) AS rank FROM (SELECT fold, Fim::DATE AS data, Tag, max(score) AS score, max(target_4h) AS target_4h FROM ({_FOLD_ROWS}) WHERE split = 'test' GROUP BY 1, 2, 3)"
_BACKTEST = f"(SELECT fold, precision_at_k AS p, recall_at_k AS r, lift_vs_random AS l FROM ({_topk_sql('fold', _FOLD_PANEL, '(15)')}))"
_STABILITY = f"SELECT count(*) AS folds, stddev_pop(r) AS recall_std, stddev_pop(p) AS precision_std, stddev_pop(r) <= 0.1 AND stddev_pop(p) <= 0.1 AS passed FROM {_BACKTEST}"


def _backtest(spark, sf):
    folds = splits.backtest_folds(c.scored(spark, sf).drop("split"))
    t = scorecard.topk_metrics(scorecard.tag_day_panel(folds.where("split = 'test'"), ["fold"]), ["fold"]).where("top_k_tags_per_day = 15")
    return t.select("fold", F.col("precision_at_k").alias("test_top15_precision_at_k"), F.col("recall_at_k").alias("test_top15_recall_at_k"), F.col("lift_vs_random").alias("test_top15_lift_vs_random"))


@query("e27_stability_gate", _STABILITY, "folds", "recall_std precision_std")
def _(spark, sf):
    return governance.stability_gate(_backtest(spark, sf))


_CRITERIA = f"""SELECT 'test_top15_precision_at_k' AS criterio, p AS observado, 0.6 AS limite, '>=' AS comparacao, p >= 0.6 AS aprovado FROM {_BACKTEST} WHERE fold = 0 UNION ALL SELECT 'test_top15_recall_at_k', r, 0.7, '>=', r >= 0.7 FROM {_BACKTEST} WHERE fold = 0
  UNION ALL SELECT 'test_top15_lift_vs_random', l, 1.9, '>=', l >= 1.9 FROM {_BACKTEST} WHERE fold = 0 UNION ALL SELECT 'threshold_degenerado', 0, 0, '<=', true UNION ALL SELECT 'estabilidade', passed::INT, 1, '>=', passed FROM ({_STABILITY})"""


@query("e28_promotion_gate", f"SELECT *, (SELECT bool_and(aprovado) FROM ({_CRITERIA})) AS veredito FROM ({_CRITERIA})", "", "observado limite")
def _(spark, sf):
    rows = _backtest(spark, sf)
    return governance.promotion_gate(rows.orderBy("fold").limit(1), governance.stability_gate(rows))


@query("e53_fold_summary", f"SELECT 'test_top15_precision_at_k' AS metrica, avg(p) AS media, stddev_pop(p) AS desvio FROM {_BACKTEST} UNION ALL SELECT 'test_top15_recall_at_k', avg(r), stddev_pop(r) FROM {_BACKTEST}", "", "media desvio")
def _(spark, sf):
    return governance.fold_summary(_backtest(spark, sf), ["test_top15_precision_at_k", "test_top15_recall_at_k"])


_BINARY = "precision recall f1".split()


@query("e54_metric_comparison", "SELECT m AS metrica, a AS base, b AS novo, b - a AS ganho FROM (SELECT unnest(['precision', 'recall']) AS m, unnest([p0, r0]) AS a, unnest([p1, r1]) AS b FROM (SELECT sum(target_4h) FILTER (prediction = 1 AND split = 'val') / sum(prediction) FILTER (split = 'val')::DOUBLE AS p0, sum(target_4h) FILTER (prediction = 1 AND split = 'val') / sum(target_4h) FILTER (split = 'val')::DOUBLE AS r0, sum(target_4h) FILTER (prediction = 1 AND split = 'test') / sum(prediction) FILTER (split = 'test')::DOUBLE AS p1, sum(target_4h) FILTER (prediction = 1 AND split = 'test') / sum(target_4h) FILTER (split = 'test')::DOUBLE AS r1 FROM scored))", "", "base novo ganho")
def _(spark, sf):
    m = metrics.binary_metrics(_known(spark, sf), ["split"])
    return governance.compare(m.where("split = 'val'"), m.where("split = 'test'"), ["precision", "recall"])


@query("e54_goals", "SELECT m AS metrica, v AS valor, g AS meta, v >= g AS atingida FROM (SELECT unnest(['precision', 'recall']) AS m, unnest([sum(target_4h) FILTER (prediction = 1) / sum(prediction)::DOUBLE, sum(target_4h) FILTER (prediction = 1) / sum(target_4h)::DOUBLE]) AS v, unnest([0.3, 0.4]) AS g FROM scored WHERE split = 'test')", "", "valor meta")
def _(spark, sf):
    m = metrics.binary_metrics(c.scored(spark, sf).where("split = 'test'"))
    return governance.against_goals(m, {"precision": 0.3, "recall": 0.4})


@query("e56_fingerprint")
def _(spark, sf):
    return governance.fingerprint(c.cycles(spark, sf))


@query("g4_model_choice", "SELECT Frota AS model_name, sum(target_4h) FILTER (prediction = 1) / sum(prediction)::DOUBLE AS val_auc_pr FROM scored WHERE split = 'val' GROUP BY 1 ORDER BY val_auc_pr DESC, model_name LIMIT 1", "", "val_auc_pr")
def _(spark, sf):
    m = metrics.binary_metrics(c.scored(spark, sf).where("split = 'val'"), ["Frota"])
    return governance.select_model(m.select(F.col("Frota").alias("model_name"), F.col("precision").alias("val_auc_pr"), F.col("recall").alias("val_recall"), F.lit(True).alias("eligible_for_selection"))).select("model_name", "val_auc_pr")


# --- profiles


@query("e29_summary", "SELECT count(*) AS ciclos, count(DISTINCT Tag) AS tags, count(DISTINCT Frota) AS frotas, count(DISTINCT Classe) AS classes, sum(target_4h) AS positivos, avg(target_4h) AS taxa_positiva, min(Fim) AS inicio, max(Fim) AS fim, avg(duracao_ciclo_min) AS duracao_media, quantile_cont(duracao_ciclo_min, 0.5) AS duracao_mediana, quantile_cont(duracao_ciclo_min, 0.95) AS duracao_p95 FROM profiled", "ciclos tags frotas classes positivos", "taxa_positiva duracao_media duracao_mediana duracao_p95")
def _(spark, sf):
    return profile.summary(c.profiled(spark, sf))


@query("e30_rate_by_category", "SELECT Tag AS categoria, count(*) AS linhas, avg(target_4h) AS taxa FROM labeled GROUP BY 1 HAVING count(*) >= 20 ORDER BY taxa DESC, categoria LIMIT 15", "linhas", "taxa")
def _(spark, sf):
    return profile.rate_by_category(c.labeled(spark, sf), "Tag")


@query("e42_risk_by_category", "SELECT Frota AS categoria, count(*) AS ciclos, sum(target_4h) AS positivos, avg(target_4h) AS taxa FROM labeled GROUP BY 1 ORDER BY positivos DESC, categoria LIMIT 12", "ciclos positivos", "taxa")
def _(spark, sf):
    return profile.risk_by_category(c.labeled(spark, sf), "Frota")


@query("e31_value_counts", "SELECT n_name AS valor, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, valor LIMIT 15", "n")
def _(spark, sf):
    joined = c.table(spark, sf, "customer").join(F.broadcast(c.table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return profile.value_counts(joined, "n_name")


@query("e32_hourly_counts", "SELECT h AS hora, count(Id) AS ciclos FROM range(24) AS r(h) LEFT JOIN cycles ON hour(Fim) = h GROUP BY 1", "hora ciclos")
def _(spark, sf):
    return profile.hourly_counts(c.cycles(spark, sf))


@query("e33_f8_daily_series", "SELECT *, avg(taxa) OVER (ORDER BY dia ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS media_movel FROM (SELECT Fim::DATE AS dia, count(*) AS ciclos, avg(target_4h) AS taxa FROM labeled GROUP BY 1)", "ciclos", "taxa media_movel")
def _(spark, sf):
    return profile.moving_average(profile.daily_series(c.labeled(spark, sf)))


@query("e34_weekday_hour", "SELECT dia_da_semana, " + ", ".join(f"coalesce(avg(target_4h) FILTER (hora = {h}), 0) AS h{h}" for h in range(24)) + " FROM profiled GROUP BY 1", "dia_da_semana", " ".join(f"h{h}" for h in range(24)))
def _(spark, sf):
    return profile.weekday_hour_matrix(c.profiled(spark, sf))


@query("e35_duration_histogram", "SELECT r.b AS bin, lo + r.b * w AS inicio, count(p.b) AS n FROM (SELECT range AS b FROM range(60)) r CROSS JOIN (SELECT min(duracao_ciclo_min) AS lo, (max(duracao_ciclo_min) - min(duracao_ciclo_min)) / 60 AS w FROM profiled) LEFT JOIN (SELECT least(floor((duracao_ciclo_min - lo) / w), 59) AS b FROM profiled, (SELECT min(duracao_ciclo_min) AS lo, (max(duracao_ciclo_min) - min(duracao_ciclo_min)) / 60 AS w FROM profiled)) p ON p.b = r.b GROUP BY 1, 2", "bin n", "inicio")
def _(spark, sf):
    return profile.histogram(c.profiled(spark, sf), "duracao_ciclo_min")


@query("e35_lead_time_histogram", "SELECT r.b AS bin, r.b / 6.0 AS inicio, count(p.b) AS n FROM (SELECT range AS b FROM range(24)) r LEFT JOIN (SELECT least(floor(least(tte_horas, 4) / (4.0::DOUBLE / 24)), 23) AS b FROM labeled WHERE tte_horas IS NOT NULL) p ON p.b = r.b GROUP BY 1, 2", "bin n", "inicio")
def _(spark, sf):
    return profile.histogram(c.labeled(spark, sf), "tte_horas", 24, 0.0, 4.0)


@query("e36_box_stats", "SELECT p.Classe, q1, q2, q3, min(duracao_ciclo_min) AS bigode_min, max(duracao_ciclo_min) AS bigode_max FROM profiled p JOIN (SELECT Classe, quantile_cont(duracao_ciclo_min, 0.25) AS q1, quantile_cont(duracao_ciclo_min, 0.5) AS q2, quantile_cont(duracao_ciclo_min, 0.75) AS q3 FROM profiled GROUP BY 1 ORDER BY count(*) DESC, Classe LIMIT 8) q ON p.Classe = q.Classe WHERE duracao_ciclo_min BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1, 2, 3, 4", "", "q1 q2 q3 bigode_min bigode_max")
def _(spark, sf):
    return profile.box_stats(c.profiled(spark, sf))


@query("c24_outliers", "SELECT o_orderkey FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) WHERE o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)")
def _(spark, sf):
    return profile.outliers(c.table(spark, sf, "orders"), "o_totalprice").select("o_orderkey")


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("e39_pearson", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM lineitem" for k, a in enumerate(_NUMBERS) for b in _NUMBERS[k + 1 :]), "", "corr")
def _(spark, sf):
    return profile.pearson_pairs(c.table(spark, sf, "lineitem"), _NUMBERS)


@query("e39_top_correlated", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS feature, corr({a}, target_4h) AS corr FROM profiled" for a in ("hora", "dia_da_semana", "duracao_ciclo_min")) + ") ORDER BY abs(corr) DESC, feature LIMIT 20", "", "corr")
def _(spark, sf):
    return profile.top_correlated(c.profiled(spark, sf), ["hora", "dia_da_semana", "duracao_ciclo_min"])


def _rank(column: str) -> str:
    return f"(rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0)"


@query("e38_spearman", f"SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(x, y) AS corr FROM (SELECT {_rank('l_quantity')} AS x, {_rank('l_extendedprice')} AS y FROM lineitem)", "", "corr")
def _(spark, sf):
    return profile.spearman_pairs(c.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("f9_pareto", "SELECT *, sum(pct) OVER (ORDER BY n DESC, categoria) AS pct_acumulado FROM (SELECT Tag AS categoria, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS pct FROM cycles GROUP BY 1 ORDER BY n DESC, categoria LIMIT 15)", "n", "pct pct_acumulado")
def _(spark, sf):
    return profile.pareto(c.cycles(spark, sf), "Tag")


@query("e43_alert_profile", "SELECT 'Alarme OEM' AS Tipo, CASE WHEN event_id % 3 = 0 THEN 'Muito Alto' END AS Criticidade, count(*) AS eventos, count(DISTINCT user_id) AS tags, min(ts) AS primeiro, max(ts) AS ultimo FROM events WHERE value > 150 GROUP BY 2", "eventos tags")
def _(spark, sf):
    return profile.alert_profile(c.telemetry(spark, sf))


@query("e43_alert_tags", "SELECT 'CA' || user_id AS tag, count(*) AS eventos, round(100.0 * count(*) / (SELECT count(*) FROM events WHERE value > 150), 4) AS pct FROM events WHERE value > 150 GROUP BY 1 ORDER BY eventos DESC, tag LIMIT 12", "eventos", "pct")
def _(spark, sf):
    return profile.alert_tags(c.telemetry(spark, sf))


@query("e43_alert_period", "SELECT count(*) AS eventos, count(DISTINCT user_id) AS tags, min(ts) AS primeiro, max(ts) AS ultimo FROM events WHERE value > 150", "eventos tags")
def _(spark, sf):
    return profile.alert_period(c.telemetry(spark, sf))


@query("e47_family_importance")
def _(spark, sf):
    f = features.build_features(c.labeled(spark, sf), c.errors(spark, sf))
    names = contract.feature_columns(f)
    found = profile.top_correlated(f, names, top=len(names)).select("feature", F.abs(F.coalesce("corr", F.lit(0.0))).alias("importance"))
    return profile.family_importance(found)


# --- serving


def _log(spark, sf):
    """A work log made of the events: an entry for each tag and day of an error, some of them more than once."""
    e = c.table(spark, sf, "events").where("event_type = 'error'")
    key = F.concat_ws(":", F.lit("priority"), F.date_format("ts", "yyyy-MM-dd"), F.concat(F.lit("CA"), "user_id"))
    return e.select(key.alias("key"), F.when(F.col("event_id") % 2 == 0, "em_inspecao").otherwise("concluido").alias("status"), F.concat(F.lit("n"), "event_id").alias("note"), F.col("ts").alias("updated_at"))


_LOG = "SELECT key, status, note, updated_at FROM (SELECT 'priority:' || strftime(ts, '%Y-%m-%d') || ':CA' || user_id AS key, CASE WHEN event_id % 2 = 0 THEN 'em_inspecao' ELSE 'concluido' END AS status, 'n' || event_id AS note, ts AS updated_at FROM events WHERE event_type = 'error') QUALIFY row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, status DESC) = 1"


@query("b12_latest_actions", _LOG)
def _(spark, sf):
    return serving.latest_actions(_log(spark, sf))


@query("d8_priority_board", f"SELECT p.data, p.rank, p.Tag, 'priority:' || strftime(p.data, '%Y-%m-%d') || ':' || p.Tag AS action_key, coalesce(l.status, 'pendente') AS status, coalesce(l.note, '') AS note FROM ({_PRIORITY}) p LEFT JOIN ({_LOG}) l ON l.key = 'priority:' || strftime(p.data, '%Y-%m-%d') || ':' || p.Tag WHERE p.Frota = 'F1'", "rank")
def _(spark, sf):
    return serving.priority_board(_priority(spark, sf), _log(spark, sf), Frota="F1").select("data", "rank", "Tag", "action_key", "status", "note")


@query("e50_risk_counts", f"SELECT CASE risco_segmento WHEN 'alto_acima_threshold' THEN 'Alto · acima do limiar' WHEN 'alto_por_ranking' THEN 'Alto · ranking' WHEN 'medio_por_ranking' THEN 'Medio · ranking' ELSE 'Monitorar' END AS risco_rotulo, count(*) AS n FROM ({_PRIORITY}) GROUP BY 1", "n")
def _(spark, sf):
    return serving.risk_counts(serving.priority_board(_priority(spark, sf), _log(spark, sf)))


@query("e48_overview", f"SELECT (SELECT count(*) FROM cycles WHERE Fim::DATE = '2024-01-10') AS cycle_count, (SELECT sum(target_4h) FROM labeled WHERE Fim::DATE = '2024-01-10') AS positive_count, (SELECT count(DISTINCT Tag) FROM cycles) AS unique_tags, (SELECT count(DISTINCT Frota) FROM cycles) AS unique_fleets, (SELECT count(*) FROM ({_PRIORITY}) WHERE data = '2024-01-10') AS priority_count, (SELECT count(*) FROM ({_PRIORITY}) WHERE data = '2024-01-10' AND risco_segmento LIKE 'alto%') AS high_risk_count, (SELECT count(*) FROM errors WHERE EVENT_TIME::DATE = '2024-01-10') AS critical_events, (SELECT count(*) FROM ({_LOG}) WHERE status = 'em_inspecao') AS open_actions, (SELECT avg(target_4h) FROM labeled WHERE Fim::DATE = '2024-01-10') AS positive_rate", "cycle_count positive_count unique_tags unique_fleets priority_count high_risk_count critical_events open_actions", "positive_rate")
def _(spark, sf):
    return serving.overview(_priority(spark, sf), serving.cycles_view(c.labeled(spark, sf)), serving.events_view(c.errors(spark, sf)), _log(spark, sf), "2024-01-10")


@query("e49_processing", "SELECT 'frota' AS grupo, Frota AS chave, count(*) AS ciclos, sum(target_4h) AS positivos FROM labeled GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'classe', Classe, count(*) AS k, sum(target_4h) FROM labeled GROUP BY 2 ORDER BY k DESC, Classe LIMIT 12) UNION ALL SELECT 'hora', h::VARCHAR, count(Id), coalesce(sum(target_4h), 0) FROM range(24) AS r(h) LEFT JOIN labeled ON hour(Fim) = h GROUP BY 2", "ciclos positivos")
def _(spark, sf):
    return serving.processing(serving.cycles_view(c.labeled(spark, sf)))


@query("d10_equipment", f"SELECT Tag, count(*) AS cycles, sum(target_4h) AS positives, arg_max(Frota, Fim) AS Frota, arg_max(Tipo, Fim) AS Tipo, (SELECT count(*) FROM errors e WHERE e.TAG = l.Tag) AS alerts, coalesce((SELECT count(*) FROM ({_PRIORITY}) p WHERE p.Tag = l.Tag), 0) AS ranked_days, (SELECT min(rank) FROM ({_PRIORITY}) p WHERE p.Tag = l.Tag) AS best_rank, coalesce((SELECT selected_days FROM ({_HOTSPOTS}) h WHERE h.Tag = l.Tag), 0) AS selected_days FROM labeled l GROUP BY Tag", "cycles positives alerts ranked_days best_rank selected_days")
def _(spark, sf):
    return serving.equipment(serving.cycles_view(c.labeled(spark, sf)), serving.events_view(c.errors(spark, sf)), _priority(spark, sf), scorecard.tag_hotspots(c.scored(spark, sf)))


@query("g3_page", "SELECT Id, Tag, Fim, (SELECT count(*) FROM cycles WHERE lower(Tag) LIKE '%ca1%') AS total FROM cycles WHERE lower(Tag) LIKE '%ca1%' ORDER BY Fim DESC, Id LIMIT 50 OFFSET 50", "total")
def _(spark, sf):
    rows = serving.filtered(c.cycles(spark, sf), query=" Ca1 ").select("Id", "Tag", "Fim")
    return serving.page(rows, [F.desc("Fim"), F.asc("Id")], 2, 50)


@query("g6_latest_cycles", "SELECT Tag, Id, posicao FROM (SELECT *, row_number() OVER (PARTITION BY Tag ORDER BY Fim DESC, Id DESC) AS posicao FROM cycles) WHERE posicao <= 40", "posicao")
def _(spark, sf):
    return serving.latest_rows(c.cycles(spark, sf), "Fim", 40, "Id").select("Tag", "Id", "posicao")


@query("h4_filter_values", "SELECT DISTINCT unnest(['Tag', 'Frota', 'Classe']) AS filtro, unnest([Tag, Frota, Classe]) AS valor FROM cycles")
def _(spark, sf):
    return serving.filter_values(c.cycles(spark, sf), ["Tag", "Frota", "Classe"])


@query("h4_available_dates", "SELECT DISTINCT strftime(Fim, '%Y-%m-%d') AS data FROM cycles UNION SELECT strftime(EVENT_TIME, '%Y-%m-%d') FROM errors")
def _(spark, sf):
    return serving.available_dates(serving.cycles_view(c.cycles(spark, sf)), serving.events_view(c.errors(spark, sf)))


@query("h6_melted_metrics", "SELECT split, unnest(['precision_at_k', 'recall_at_k']) AS metrica, unnest([precision_at_k, recall_at_k]) AS valor FROM (" + _TOPK + ") WHERE top_k_tags_per_day = 15", "", "valor")
def _(spark, sf):
    t = scorecard.topk_metrics(scorecard.tag_day_panel(_known(spark, sf), ["split"]), ["split"]).where("top_k_tags_per_day = 15")
    return t.unpivot(["split"], ["precision_at_k", "recall_at_k"], "metrica", "valor")
