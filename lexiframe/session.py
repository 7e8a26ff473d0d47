"""Session, table and scratch-table helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(cpus: int = 8, app: str = "lexiframe", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="lexiframe-")) / "lexiframe_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))


def _plain_unions(spark: SparkSession) -> None:
    """Spark 4.1 keeps the partitioning of a union's sides and then gives wrong rows where the union is
    broadcast (layers.nearest over texts shuffled by their id); without it the union is shuffled as ever."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; a file or a folder of part files."""
    ship(spark)
    _plain_unions(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local mode, where it may be unset, one of our own."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        d = _own_dirs.get(app) or "file://" + tempfile.mkdtemp(prefix="lexiframe-")
        _own_dirs[app] = d
    return d.rstrip("/")


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an action in it are deleted when it ends, not when the driver happens to collect
    its garbage: for plans that are made and run once, such as the evaluations of an objective."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


@contextmanager
def few_rows(spark: SparkSession, rows: int = 4) -> Iterator[None]:
    """Plans made and run in it read Parquet and send rows to Python a few at a time: for rows of some MB."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    old = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, str(rows))
    try:
        yield
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Ends a lineage: writes df as a Parquet table in the shared folder and reads it back.

    Unlike a cached or locally checkpointed frame it survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiframe/{uuid.uuid4().hex}"
    with passing(spark):
        df.write.mode("error").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexiframe_path = path
    return out


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut(), and the number of rows as the writing job itself saw it."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def release(df: DataFrame | None) -> None:
    """Deletes the table behind a frame that cut() gave and that no later plan reads."""
    path = getattr(df, "_lexiframe_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def grows(df: DataFrame) -> DataFrame:
    """Says that df grows with the data: its joins are sort-merge joins, whatever size Spark takes it for.

    Spark measures files and shuffles compressed, so a side far below spark.sql.autoBroadcastJoinThreshold
    may be many times that in the driver, which builds the table of every broadcast. What aggregates or
    explodes df keeps this; the result of a join has to be said again."""
    return df.hint("merge")


def parts(spark: SparkSession) -> int:
    """The partitions of spread()."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Partitions by cols into as many parts as the session shuffles to, for costly work per row.

    The number is stated, so small data isn't gathered into a few tasks after the shuffle.
    """
    spark = df.sparkSession
    _plain_unions(spark)
    return df.repartition(parts(spark), *cols)
