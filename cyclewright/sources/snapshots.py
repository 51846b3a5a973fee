"""Time-stamped snapshots of result tables as partitioned Parquet."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "run_ts"
PERIOD_DATASETS = ["consensus_periods", "feature_periodicity", "periodicity_results"]
TIMELINE_DATASETS = ["timeline_with_features", "timeline"]


def shared_folder(spark: SparkSession) -> str:
    """Folder of this session in ``spark.checkpoint.dir``, which all executors see.

    On one machine, as in tests, a temporary folder is set where none is named; a
    cluster has to name one.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or posixpath.join(tempfile.gettempdir(), "checkpoints"))
    return context.getCheckpointDir()


def save_snapshot(df: DataFrame, root: str, dataset: str, run_ts: str) -> str:
    """Adds one run of a dataset, in its own partition."""
    path = posixpath.join(root, dataset)
    df.withColumn(RUN, F.lit(run_ts)).write.mode("append").partitionBy(RUN).parquet(path)
    return path


def newest_run(df: DataFrame, run: str = RUN) -> DataFrame:
    """Rows of the newest run of a table."""
    newest = df.agg(F.max(run)).scalar()
    return df.where(F.col(run) == newest)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders of a folder; none where it doesn't exist."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def runs_of(spark: SparkSession, path: str) -> list[str]:
    """Run stamps of a dataset, from the names of its folders; no file is opened."""
    names = names_in(spark, path)
    return [n.removeprefix(f"{RUN}=") for n in names if n.startswith(f"{RUN}=")]


def load_newest(spark: SparkSession, root: str, dataset: str) -> DataFrame | None:
    """Newest run of a dataset, or None when it was never written."""
    path = posixpath.join(root, dataset)
    runs = runs_of(spark, path)
    return spark.read.parquet(posixpath.join(path, f"{RUN}={max(runs)}")) if runs else None


def save_bucketed(
    df: DataFrame, root: str, dataset: str, run_ts: str, key: str, buckets: int
) -> str:
    """Adds one run of a dataset in a layout for joins: dealt to buckets by ``key`` and sorted by it.

    The layout is part of the folder's name, so that any session can use it.
    """
    path = posixpath.join(root, f"{dataset}.by.{key}.{buckets}", f"{RUN}={run_ts}")
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    name = f"written_{uuid.uuid4().hex}"
    writer.format("parquet").option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"drop table {name}")  # its files stay
    return path


def load_bucketed(spark: SparkSession, root: str, dataset: str, key: str) -> DataFrame | None:
    """Newest run of a bucketed dataset, or None; joins by ``key`` need no exchange of its rows.

    The joins of ``anchors`` use the layout with ``by_layout=True``. A user is then one
    task's work, however many rows it has.
    """
    found = [
        (run, name)
        for name in names_in(spark, root)
        if name.startswith(f"{dataset}.by.{key}.")
        for run in runs_of(spark, posixpath.join(root, name))
    ]
    if not found:
        return None
    run, name = max(found)
    path = posixpath.join(root, name, f"{RUN}={run}")
    table = f"read_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(
        f"create table {table} ({columns}) using parquet clustered by (`{key}`) sorted by (`{key}`)"
        f" into {name.rsplit('.', 1)[1]} buckets location '{path}'"
    )
    return spark.table(table)


def load_first_available(
    spark: SparkSession, root: str, datasets: list[str], exclude: str | None = None
) -> DataFrame | None:
    """Newest run of the first dataset that exists; names holding ``exclude`` are passed over."""
    for name in datasets:
        if exclude and exclude in name:
            continue
        found = load_newest(spark, root, name)
        if found is not None:
            return found
    return None


def export_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """CSV folder with a header; text is quoted and quotes are escaped by a backslash."""
    df.write.mode("overwrite").options(
        header=True,
        escape="\\",
        quoteAll=False,
        compression=compression,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)
