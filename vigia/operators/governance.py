"""Gates on stability and promotion, model choice, comparisons and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIMARY_K = 15
FLOORS = {f"test_top{PRIMARY_K}_precision_at_k": 0.60, f"test_top{PRIMARY_K}_recall_at_k": 0.70, f"test_top{PRIMARY_K}_lift_vs_random": 1.90}
SELECTION = [f"val_top{PRIMARY_K}_recall_at_k", f"val_top{PRIMARY_K}_precision_at_k", f"val_top{PRIMARY_K}_lift_vs_random", "val_auc_pr"]


def stability_gate(backtest: DataFrame, max_recall_std: float = 0.10, max_precision_std: float = 0.10, min_folds: int = 3) -> DataFrame:
    """Population deviations of recall and precision over folds, and whether both are small enough."""
    names = [f"test_top{PRIMARY_K}_recall_at_k", f"test_top{PRIMARY_K}_precision_at_k"]
    if not set(names) <= set(backtest.columns):
        names = ["test_recall", "test_precision"]
    folds = backtest.count()
    if folds < min_folds:
        raise ValueError(f"too few folds: {folds} < {min_folds}")
    out = backtest.agg(F.count(F.lit(1)).alias("folds"), F.stddev_pop(names[0]).alias("recall_std"), F.stddev_pop(names[1]).alias("precision_std"))
    return out.withColumn("passed", (F.col("recall_std") <= max_recall_std) & (F.col("precision_std") <= max_precision_std))


def promotion_gate(selected: DataFrame, stability: DataFrame | None = None, degenerate: bool = False, floors: dict[str, float] = FLOORS) -> DataFrame:
    """``criterio, observado, limite, comparacao, aprovado`` for each criterion, and ``veredito`` over all."""
    missing = set(floors) - set(selected.columns)
    if missing:
        raise ValueError(f"metrics missing: {sorted(missing)}")
    row = lambda name, seen, limit, sign, ok: F.struct(F.lit(name).alias("criterio"), seen.cast("double").alias("observado"), F.lit(float(limit)).alias("limite"), F.lit(sign).alias("comparacao"), ok.alias("aprovado"))
    rows = [row(n, F.col(n), limit, ">=", F.col(n) >= limit) for n, limit in floors.items()]
    rows.append(row("threshold_degenerado", F.lit(float(degenerate)), 0.0, "<=", F.lit(not degenerate)))
    base = selected
    if stability is not None:
        base = base.join(F.broadcast(stability.select(F.col("passed").alias("_stable"))))
        rows.append(row("estabilidade", F.col("_stable").cast("int"), 1.0, ">=", F.col("_stable")))
    table = base.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return table.join(F.broadcast(table.agg(F.bool_and("aprovado").alias("veredito"))))


def select_model(summary: DataFrame) -> DataFrame:
    """The best eligible model by the policy's metrics in order; a missing metric ranks last."""
    names = SELECTION if set(SELECTION) <= set(summary.columns) else ["val_auc_pr", "val_recall"]
    return summary.where("eligible_for_selection").orderBy(*[F.desc_nulls_last(n) for n in names], "model_name").limit(1)


def fold_summary(backtest: DataFrame, metrics: list[str]) -> DataFrame:
    """``metrica, media, desvio`` over folds."""
    long = backtest.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metrica", "valor")
    return long.groupBy("metrica").agg(F.avg("valor").alias("media"), F.stddev_pop("valor").alias("desvio"))


def compare(a: DataFrame, b: DataFrame, metrics: list[str]) -> DataFrame:
    """``metrica, base, novo, ganho`` of two metric rows."""
    long = lambda df, name: df.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metrica", name)
    return long(a, "base").join(long(b, "novo"), "metrica").withColumn("ganho", F.col("novo") - F.col("base"))


def against_goals(row: DataFrame, goals: dict[str, float]) -> DataFrame:
    """``metrica, valor, meta, atingida``."""
    long = row.select(*[F.col(m).cast("double").alias(m) for m in goals]).unpivot([], list(goals), "metrica", "valor")
    goal = F.create_map(*[F.lit(x) for item in goals.items() for x in item])[F.col("metrica")]
    return long.withColumn("meta", goal).withColumn("atingida", F.col("valor") >= F.col("meta"))


def same_rows(a: DataFrame, b: DataFrame, time: str = "Fim") -> bool:
    """Whether two test sets have the same number of rows and the same first and last time."""
    key = lambda df: tuple(df.agg(F.count(F.lit(1)), F.min(time), F.max(time)).first())
    return key(a) == key(b)


def fingerprint(df: DataFrame) -> DataFrame:
    """``rows`` and ``digest`` of a table as a multiset: whatever the order of its rows, and with each repeat counted.

    The digest is two sums of seeded hashes, so equal rows add up instead of cancelling out. Hashes pass over nulls, so which
    columns are null is hashed as well; the columns' names and order count too.
    """
    names = F.lit(",".join(df.columns))
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in df.columns])
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), names, nulls, *[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))
    sums = df.agg(F.count(F.lit(1)).alias("rows"), total(17).alias("a"), total(9001).alias("b"))
    return sums.select("rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string")), 256).alias("digest"))


def config_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """SHA-256 of the JSON of the given columns."""
    return df.withColumn("config_sha256", F.sha2(F.to_json(F.struct(*columns)), 256))


def flatten(df: DataFrame, structs: list[str]) -> DataFrame:
    """Struct columns as columns prefixed by their name."""
    plain = [c for c in df.columns if c not in structs]
    return df.select(*plain, *reduce(lambda a, b: a + b, [[F.col(f"{s}.{f.name}").alias(f"{s}_{f.name}") for f in df.schema[s].dataType.fields] for s in structs], []))
