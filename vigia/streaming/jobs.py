"""Streaming forms of the event, cooldown, panel, batch-scoring and drift jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from vigia.functions.scalar import HOUR_US
from vigia.operators import drift
from vigia.operators.labeling import flag_events, prepare_events

TARGET = "target_4h"


def stream_critical_events(telemetry: DataFrame, rules: DataFrame, late: str = "1 hour") -> DataFrame:
    """Critical events of a telemetry stream, each tag and time once within the watermark."""
    flagged = flag_events(prepare_events(telemetry), rules)
    found = flagged.where("(by_rule or by_event or by_flag) and EVENT_TIME is not null and TAG <> ''")
    return found.select("TAG", F.col("EVENT_TIME").cast("timestamp").alias("EVENT_TIME")).withWatermark("EVENT_TIME", late).dropDuplicatesWithinWatermark(["TAG", "EVENT_TIME"])


class Cooldown(StatefulProcessor):
    """Keeps an alert if it is the whole cooldown after the last kept one of its tag.

    Alerts wait in the state, by the minute, until the watermark has passed their minute, and leave in order of time and
    ``Id``. There is a timer for each minute that has any, so each alert is read once.
    """

    MINUTE_US = 60_000_000

    def __init__(self, wait_us: int):
        self.wait_us = wait_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")
        self.waiting = handle.getMapState("waiting", "minute long", "alerts string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[str]] = {}
        for frame in rows:
            for us, i in zip(frame["us"], frame["Id"], strict=True):
                new.setdefault(int(us) // self.MINUTE_US, []).append(f"{int(us)}:{int(i)}")
        for minute, alerts in new.items():
            if self.waiting.containsKey((minute,)):
                alerts.insert(0, self.waiting.getValue((minute,))[0])
            else:
                self.handle.registerTimer((minute + 1) * 60_000)
            self.waiting.updateValue((minute,), (",".join(alerts),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        minute = expiredTimerInfo.getExpiryTimeInMs() // 60_000 - 1
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for us, i in sorted(tuple(map(int, a.split(":"))) for a in self.waiting.getValue((minute,))[0].split(",")):
            if last is None or us - last >= self.wait_us:
                kept.append((key[0], i, pd.Timestamp(us, unit="us")))
                last = us
        if kept:
            self.last.update((last,))
        self.waiting.removeKey((minute,))
        yield pd.DataFrame(kept, columns=["Tag", "Id", "Fim"])

    def close(self) -> None:
        pass


def stream_cooldown(scored: DataFrame, hours: float = 4.0, late: str = "1 hour") -> DataFrame:
    """``Tag, Id, Fim`` of kept alerts; equal to the batch form when no row is later than the watermark."""
    alerts = scored.where("prediction = 1 and Fim is not null").select("Tag", "Id", F.col("Fim").cast("timestamp").alias("Fim")).withWatermark("Fim", late)
    keyed = alerts.withColumn("us", F.unix_micros("Fim"))
    return keyed.groupBy("Tag").transformWithStateInPandas(Cooldown(int(hours * HOUR_US)), "Tag string, Id long, Fim timestamp", "Append", "EventTime")


def stream_tag_day_panel(scored: DataFrame, late: str = "1 hour") -> DataFrame:
    """The panel over tumbling days."""
    rows = scored.withColumn("Fim", F.col("Fim").cast("timestamp")).withWatermark("Fim", late)
    panel = rows.groupBy(F.window("Fim", "1 day").alias("w"), "Tag").agg(F.max("score").alias("score"), F.max(TARGET).alias(TARGET), F.count(F.lit(1)).alias("ciclos"))
    return panel.select(F.to_date("w.start").alias("data"), "Tag", "score", TARGET, "ciclos")


def score_drops(batches: DataFrame, score: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Each drop of files is scored once by ``score``, which writes by ``batch_id``, so a repeated drop changes nothing."""
    return batches.writeStream.foreachBatch(lambda df, _: score(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_drift(stream: DataFrame, profile: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The drift of each micro-batch against a stored profile, one partition ``lote`` each, which a repeated batch replaces."""

    def check(df: DataFrame, number: int) -> None:
        found = drift.feature_drift(df, profile).withColumn("lote", F.lit(number))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lote").parquet(path)

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
