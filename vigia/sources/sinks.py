"""Sinks: tables, splits, scores, rankings, reports, profiles, encoders, models and the work log."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

MANIFEST_KEYS = ["model_name", "threshold", "feature_columns"]


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_partitioned(df: DataFrame, path: str, *columns: str) -> None:
    """Splits, or scores by model and split; only the partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def write_batch_scores(scored: DataFrame, path: str) -> None:
    """Scores by ``batch_id``: running a batch again replaces its own partition only."""
    write_partitioned(scored, path, "batch_id")


def write_scores(scored: DataFrame, path: str) -> None:
    """Parquet or CSV, by the end of the name."""
    if path.endswith(".csv"):
        scored.write.mode("overwrite").option("header", True).csv(path)
    else:
        write_table(scored, path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(row: DataFrame, path: str) -> None:
    """A report of one row as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)


def write_encoder(encoder: dict[str, DataFrame], path: str) -> None:
    for name, table in encoder.items():
        write_table(table, f"{path}/{name}")


def read_encoder(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a fitted encoder, that of operators if it has one; an empty one is refused."""
    out = {n: spark.read.parquet(f"{path}/{n}") for n in ("Tag_freq", "Classe_target_enc", "global", "categories")}
    try:
        out["Operador_freq"] = spark.read.parquet(f"{path}/Operador_freq")
    except AnalysisException:  # the training rows had no operator
        pass
    empty = [n for n, t in out.items() if t.isEmpty()]
    if empty:
        raise ValueError(f"empty encoder tables: {empty}")
    return out


def write_model(model: PipelineModel, manifest: DataFrame, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    write_report(manifest, f"{path}/manifest")


def read_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """Model and manifest; a manifest that lacks a key is refused."""
    manifest = spark.read.json(f"{path}/manifest").first().asDict(recursive=True)
    missing = [k for k in MANIFEST_KEYS if manifest.get(k) is None]
    if missing:
        raise ValueError(f"the manifest lacks {missing}")
    return PipelineModel.load(f"{path}/model"), manifest


def archive(spark: SparkSession, folder: str, verdict: DataFrame, out: str) -> DataFrame:
    """Move the batch files of a verdict (``batch_id, accepted``) to ``processed`` or ``rejected``; an older file of the name goes.

    The files are renamed one by one where they lie, so no data pass through the driver.
    """
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    rows = []
    for r in verdict.select("batch_id", "accepted").toLocalIterator():
        target = f"{out}/{'processed' if r['accepted'] else 'rejected'}"
        source, end = place(f"{folder}/{r['batch_id']}"), place(f"{target}/{r['batch_id']}")
        system = source.getFileSystem(hadoop)
        if system.exists(source):
            system.mkdirs(place(target))
            system.delete(end, True)
            system.rename(source, end)
            rows.append((r["batch_id"], f"{target}/{r['batch_id']}"))
    return spark.createDataFrame(rows, "batch_id string, arquivado_em string")
