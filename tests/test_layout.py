"""Tables stored by tag and day: the joins give the same rows and shuffle no cycle."""

import datetime as dt
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from vigia.operators.features import alert_history
from vigia.operators.labeling import label_cycles
from vigia.sources.layout import read_tag_days, write_tag_days

START = dt.datetime(2025, 3, 1, tzinfo=dt.UTC)
PARTITIONS = 6


def rows_of(spark, n, seed, name, kind):
    draw = random.Random(seed)
    # One tag has a third of all rows.
    tags = ["A", "a ", "B", "C", "D", None]
    at = lambda: None if draw.random() < 0.05 else START + dt.timedelta(minutes=draw.randrange(0, 6 * 1440, 15))
    return spark.createDataFrame([(k, draw.choice(tags), at()) for k in range(n)], f"{kind} long, {name} string, {'Fim' if name == 'Tag' else 'EVENT_TIME'} timestamp")


@pytest.fixture
def stored(spark, tmp_path):
    cycles = rows_of(spark, 500, 1, "Tag", "Id")
    events = rows_of(spark, 200, 2, "TAG", "Nr").select(F.upper(F.trim("TAG")).alias("TAG"), "EVENT_TIME").where("TAG is not null")
    names = [f"{n}_{uuid.uuid4().hex}" for n in ("cycles", "events")]
    layout = write_tag_days(cycles, names[0], "Fim", path=f"{tmp_path}/cycles", partitions=PARTITIONS)
    assert layout == write_tag_days(events, names[1], "EVENT_TIME", tag="TAG", path=f"{tmp_path}/events", partitions=PARTITIONS)
    yield cycles, events, read_tag_days(spark, names[0]), read_tag_days(spark, names[1]), layout
    for name in names:
        spark.sql(f"drop table {name}")


def shuffled_keys(df):
    """What each exchange of the plan carries, by the columns of its input."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [m for m in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", text)]


def both_steps(cycles, events, layout=None):
    return alert_history(label_cycles(cycles, events, layout=layout), events, layout=layout)


def test_stored_tables_give_the_same_rows(stored):
    cycles, events, kept_cycles, kept_events, layout = stored
    want = both_steps(cycles, events)
    got = both_steps(kept_cycles, kept_events, layout).drop(layout.tag, layout.bucket)
    assert got.columns == want.columns
    key = lambda r: r["Id"]
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert got.count() == 500


def test_no_cycle_is_shuffled(stored):
    cycles, events, kept_cycles, kept_events, layout = stored
    carried = shuffled_keys(both_steps(kept_cycles, kept_events, layout))
    assert carried and not any("_row" in c for c in carried), carried
    # Without the layout each of the three joins shuffles them.
    assert sum("_row" in c for c in shuffled_keys(both_steps(cycles, events))) >= 3


def test_days_of_a_hot_tag_are_dealt_to_all_buckets(spark, stored):
    kept, layout = stored[2], stored[4]
    hot = kept.where(F.col(layout.tag) == "A")
    assert hot.select(layout.bucket).distinct().count() > 1
    assert len({f for f in hot.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}) > 1


def test_empty_table_and_clashing_names(spark, tmp_path):
    cycles = rows_of(spark, 0, 1, "Tag", "Id")
    name = f"none_{uuid.uuid4().hex}"
    layout = write_tag_days(cycles, name, "Fim", path=f"{tmp_path}/none", partitions=2)
    kept = read_tag_days(spark, name)
    assert both_steps(kept, kept.select(F.col("Tag").alias("TAG"), F.col("Fim").alias("EVENT_TIME"), layout.tag, layout.bucket), layout).count() == 0
    spark.sql(f"drop table {name}")
    with pytest.raises(ValueError, match="tag_day"):
        write_tag_days(cycles.withColumn("tag_day", F.lit(1)), name, "Fim", path=f"{tmp_path}/other")
