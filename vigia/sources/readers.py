"""Sources: cycle tables, telemetry folders, rule catalogues, batches, reports."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from vigia.operators.ordered import written
from vigia.operators.labeling import critical_events, critical_rules, event_audit, flag_events, prepare_events

CYCLES = T.StructType(
    [
        T.StructField("Id", T.LongType()),
        T.StructField("Inicio", T.StringType()),
        T.StructField("Fim", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in ("Tag", "Frota", "Tipo", "Classe", "Nome_Operador_Anon", "Matricula_Operador_Hash")],
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet or CSV table, by the end of its name or of the names in the folder; CSV has a header and reads as text without a schema."""
    name = path.rstrip("/").lower()
    csv = lambda p: (spark.read.option("header", True).schema(schema) if schema else spark.read.option("header", True)).csv(p)
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith((".csv", ".csv.gz")):
        return csv(path)
    for kind, read in (("*.parquet", spark.read.parquet), ("*.csv*", csv)):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{kind}")
        found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
        if found:
            return read(path)
    raise ValueError(f"neither Parquet nor CSV: {path}")


def find_cycles(spark: SparkSession, folder: str, pattern: str = "*apontamentos*") -> DataFrame:
    """The cycle files below a folder: Parquet if there are any, else CSV."""
    for kind in ("parquet", "csv"):
        reader = spark.read.option("pathGlobFilter", f"{pattern}.{kind}").option("recursiveFileLookup", True)
        try:
            found = reader.parquet(folder) if kind == "parquet" else reader.option("header", True).schema(CYCLES).csv(folder)
        except AnalysisException:
            continue
        if kind == "parquet" or found.inputFiles():
            return found
    raise FileNotFoundError(f"no cycle file below {folder}")


def read_telemetry(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """All monthly telemetry files in one scan, with the columns asked for and each row's ``arquivo``."""
    found = spark.read.option("pathGlobFilter", "telemetry_*.parquet").parquet(folder)
    kept = existing(found, columns) if columns else found
    return kept.withColumn("arquivo", F.col("_metadata.file_name")) if not columns else found.select(*kept.columns, F.col("_metadata.file_name").alias("arquivo"))


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that the table has."""
    return df.select(*[c for c in columns if c in df.columns])


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return critical_rules(read_table(spark, path))


def critical_events_from(spark: SparkSession, folder: str, rules: DataFrame, zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """Distinct critical events of a telemetry folder, and the audit of each file; one scan, no loop over files."""
    flagged = flag_events(prepare_events(read_telemetry(spark, folder), zone, keep=["arquivo"]), rules)
    return critical_events(flagged), event_audit(flagged, ["arquivo"])


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """``arquivo, linhas`` of each Parquet file below a folder."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)
    return found.groupBy(F.col("_metadata.file_name").alias("arquivo")).agg(F.count(F.lit(1)).alias("linhas"))


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a table partitioned by ``split``; the others' files aren't read."""
    return spark.read.parquet(path).where(F.col("split") == split)


#: Files whose headers are read at a time.
PROBES = 8


def list_batches(spark: SparkSession, folder: str) -> list[str]:
    """Names of the pending batch files in a folder in stable order; files that are neither Parquet nor CSV, and hidden ones, are left alone."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
    return sorted(n for n in names if n.lower().endswith((".parquet", ".csv")) and not n.startswith((".", "_")))


def _open(spark: SparkSession, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema else reader
    return reader.option("header", True).csv(paths) if paths[0].lower().endswith(".csv") else reader.parquet(*paths)


def read_batches(spark: SparkSession, folder: str, types: dict[str, str] | None = None, names: list[str] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Pending batch files as one table with ``batch_id``, the file's name, and ``batch_id, motivo`` of those that can't be read.

    A bad file costs itself only. The headers tell the schemas; files of one kind and schema are read in one scan, which
    is written to scratch, so that a file counts as whole or not at all. Where that fails, the scan's files are halved until the bad ones
    are alone. Columns in ``types`` are cast, what isn't of the type becoming null, so that CSV and Parquet agree;
    a file whose other columns differ in type from those before has them as text. Null stands for no table at all.
    """
    names = list_batches(spark, folder) if names is None else sorted(names)
    types = types or {}
    bad: list[tuple[str, str]] = []
    root = folder.rstrip("/")

    def schema_of(name: str) -> tuple[str, T.StructType | None, str]:
        try:
            return name, _open(spark, [f"{root}/{name}"]).schema, ""
        except Exception as error:  # whatever the reader makes of the bytes
            return name, None, type(error).__name__

    with ThreadPoolExecutor(PROBES) as pool:
        probed = list(pool.map(inheritable_thread_target(spark)(schema_of), names))
    groups: dict[tuple[bool, str], list[str]] = {}
    schemas: dict[tuple[bool, str], T.StructType] = {}
    for name, schema, why in probed:
        if schema is None or not schema.fields:
            bad.append((name, f"ilegivel: {why or 'vazio'}"))
            continue
        key = (name.lower().endswith(".csv"), schema.json())
        groups.setdefault(key, []).append(name)
        schemas[key] = schema

    def whole(key: tuple[bool, str], files: list[str]) -> list[DataFrame]:
        found = _open(spark, [f"{root}/{n}" for n in files], schemas[key])
        kept = [F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in found.columns if c != "batch_id"]
        try:
            return [written(found.select(*kept, F.col("_metadata.file_name").alias("batch_id")), "batches")]
        except Exception as error:
            if len(files) == 1:
                bad.append((files[0], f"ilegivel: {type(error).__name__}"))
                return []
            middle = len(files) // 2
            return whole(key, files[:middle]) + whole(key, files[middle:])

    parts = [part for key, files in groups.items() for part in whole(key, files)]
    rejected = spark.createDataFrame(bad, "batch_id string, motivo string")
    if not parts:
        return None, rejected
    kinds: dict[str, set[str]] = {}
    for part in parts:
        for f in part.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    alike = [part.select(*[F.col(f"`{c}`").cast("string").alias(c) if len(kinds[c]) > 1 else F.col(f"`{c}`") for c in part.columns]) for part in parts]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), alike), rejected


def read_priority(spark: SparkSession, path: str) -> DataFrame:
    """A ranking written as CSV, newest day first; numbers that can't be read become null."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumns({"data": F.col("data").try_cast("date"), "rank": F.col("rank").try_cast("int"), "score": F.col("score").try_cast("double")}).orderBy(F.desc("data"), "rank")


def read_backtest(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """The backtest report, one row for each fold, from CSV: columns that are numbers throughout are read as numbers.

    Metrics that it must have and hasn't, and a report without folds, raise an error.
    """
    found = spark.read.option("header", True).option("inferSchema", True).csv(path)
    missing = [c for c in required or [] if c not in found.columns]
    if missing:
        raise ValueError(f"the backtest report lacks {missing}")
    if found.isEmpty():
        raise ValueError("the backtest report has no folds")
    return found


def read_report(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A JSON report; fields (dotted names) that it must have and hasn't raise an error."""
    report = spark.read.option("multiLine", True).json(path)
    missing = []
    for name in required:
        try:
            report.select(name)
        except AnalysisException:
            missing.append(name)
    if missing:
        raise ValueError(f"the report lacks {missing}")
    return report
