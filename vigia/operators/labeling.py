"""Critical events by rule, and labels by the next event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.functions.scalar import HOUR_US, micros, tag_key, text_key, utc_time
from vigia.operators.asof import Layout, nearest

CRITICAL_LEVEL = "muito alto"
RULE_COLUMNS = ["TIPO", "EVENTO", "SITUACAO", "NIVEL"]
# Names under which a source may carry each logical column of the telemetry.
ALIASES = {
    "TAG": ["TAG", "Tag"],
    "EVENT_TIME": ["DATA_EVENTO", "EVENT_TIME"],
    "EVENTO": ["ALARME", "EVENTO"],
    "TIPO": ["TIPO"],
    "SITUACAO": ["SITUACAO"],
    "NIVEL": ["CRITICIDADE", "NIVEL"],
    "IS_DONT_GO": ["IS_DONT_GO"],
}
DEFAULTS = {"TIPO": "ALARME OEM", "SITUACAO": None, "NIVEL": None, "IS_DONT_GO": 0}
#: Rules up to this number are sent to all executors.
MAX_SENT_RULES = 50_000


def critical_rules(rules: DataFrame, level: str = CRITICAL_LEVEL) -> DataFrame:
    """Distinct normalized rules of the level; if none has it exactly, those whose level contains it."""
    missing = set(RULE_COLUMNS) - set(rules.columns)
    if missing:
        raise ValueError(f"rule columns missing: {sorted(missing)}")
    keys = rules.select(*[text_key(c).alias(c) for c in RULE_COLUMNS])
    exact = keys.agg(F.max((F.col("NIVEL") == level).cast("int")).alias("any_exact"))
    chosen = keys.join(F.broadcast(exact)).where(F.when(F.col("any_exact") == 1, F.col("NIVEL") == level).otherwise(F.col("NIVEL").contains(level)))
    return chosen.select(*RULE_COLUMNS).distinct()


def resolve_column(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate that a table has, whatever its case."""
    by_name = {c.lower(): c for c in reversed(columns)}
    return next((by_name[c.lower()] for c in candidates if c.lower() in by_name), None)


def prepare_events(telemetry: DataFrame, zone: str = "UTC", keep: list[str] | None = None) -> DataFrame:
    """Telemetry under its logical names with normalized keys; optional columns take defaults.

    A text time is read as local time of ``zone``; times that can't be read become null. Columns in ``keep`` stay.
    """
    chosen: list[Column] = []
    for logical, candidates in ALIASES.items():
        name = resolve_column(telemetry.columns, candidates)
        if name is None and logical not in DEFAULTS:
            raise ValueError(f"no column for {logical}; looked for {candidates}")
        chosen.append((F.col(name) if name else F.lit(DEFAULTS[logical])).alias(logical))
    raw = telemetry.select(*chosen, *(keep or []))
    time = F.col("EVENT_TIME") if raw.schema["EVENT_TIME"].dataType.typeName().startswith("timestamp") else utc_time("EVENT_TIME", zone)
    keys = {c: text_key(F.col(c).cast("string")) for c in ("EVENTO", "TIPO", "SITUACAO", "NIVEL")}
    return raw.withColumns({"TAG": tag_key(F.col("TAG").cast("string")), "EVENT_TIME": time, "IS_DONT_GO": F.coalesce(F.col("IS_DONT_GO").try_cast("int"), F.lit(0)), **keys})


def flag_events(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Prepared events with ``by_rule`` (all four keys match), ``by_event`` (event alone, without context) and ``by_flag``."""
    small = rules.count() <= MAX_SENT_RULES
    send = F.broadcast if small else (lambda df: df)
    full = send(rules.select(*RULE_COLUMNS).distinct().withColumn("_full", F.lit(True)))
    alone = send(rules.select("EVENTO").distinct().withColumn("_alone", F.lit(True)))
    context = (F.length("SITUACAO") > 0) & (F.length("NIVEL") > 0)
    hit = events.join(full, RULE_COLUMNS, "left").join(alone, "EVENTO", "left")
    return hit.withColumns({"by_rule": context & F.col("_full").isNotNull(), "by_event": ~context & F.col("_alone").isNotNull(), "by_flag": F.col("IS_DONT_GO") == 1}).drop("_full", "_alone")


def critical_events(flagged: DataFrame) -> DataFrame:
    """Distinct ``TAG, EVENT_TIME`` of flagged events with a tag and a time."""
    return flagged.where((F.col("by_rule") | F.col("by_event") | F.col("by_flag")) & F.col("EVENT_TIME").isNotNull() & (F.col("TAG") != "")).select("TAG", "EVENT_TIME").distinct()


def event_audit(flagged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of rows and matches by rule, event and flag, in all or for each file."""
    critical = (F.col("by_rule") | F.col("by_event") | F.col("by_flag")) & F.col("EVENT_TIME").isNotNull() & (F.col("TAG") != "")
    return flagged.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("by_rule").alias("rule_matches"),
        F.count_if("by_event").alias("event_matches"),
        F.count_if("by_flag").alias("flag_matches"),
        F.count_if(critical).alias("critical_rows"),
    )


def label_cycles(cycles: DataFrame, events: DataFrame, time: str = "Fim", horizon_hours: float = 4.0, layout: Layout | None = None) -> DataFrame:
    """Cycles with the next critical event strictly after ``time``, hours to it and the target within the horizon.

    A cycle without a time, or without a later event, has nulls and the target 0. With a ``layout`` both tables are stored by
    tag and day, cycles by ``time`` and events by theirs; the result stays placed like that.
    """
    keyed = cycles if layout else cycles.withColumn("_key", tag_key("Tag"))
    near = nearest(keyed, events, time, "EVENT_TIME", tag="_key", right_tag="TAG", payload=["EVENT_TIME"], name="_next", layout=layout)
    hours = (F.col("_next.us") - micros(near, time)) / F.lit(HOUR_US)
    near = near.withColumns({"next_critical_event_time": F.col("_next.EVENT_TIME"), "tte_horas": hours})
    return near.withColumn("target_4h", F.coalesce(F.col("tte_horas") <= horizon_hours, F.lit(False)).cast("int")).drop("_next", "_key")


def label_summary(labeled: DataFrame) -> DataFrame:
    """Rows, positives, positive rate, and first and last next event."""
    return labeled.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("target_4h").alias("positives"),
        F.round(F.avg("target_4h"), 6).alias("positive_rate"),
        F.min("next_critical_event_time").alias("first_event"),
        F.max("next_critical_event_time").alias("last_event"),
    )


def common_tags(cycles: DataFrame, events: DataFrame) -> DataFrame:
    """Number of tags that both tables have."""
    return cycles.select(tag_key("Tag").alias("t")).intersect(events.select(F.col("TAG").alias("t"))).agg(F.count(F.lit(1)).alias("common_tags"))


def daily_episodes(events: DataFrame) -> DataFrame:
    """Bursts collapsed: one episode for each tag and UTC day, at its latest event."""
    return events.groupBy("TAG", F.to_date("EVENT_TIME").alias("dia")).agg(F.max("EVENT_TIME").alias("EVENT_TIME"))
