"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Day arithmetic is in UTC; skewed shuffle partitions are split at run time; Arrow batches are small."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    small_batches(spark)
    return spark


def at_most(spark: SparkSession, name: str, most: int) -> None:
    """Lowers a setting in rows or bytes to ``most``; a smaller one stays."""
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    value = spark.conf.get(name).strip().lower()
    number = value.rstrip("bkmgt")
    unit = value[len(number) :].removesuffix("b") or "b"
    if not number.isdigit() or not 0 < int(number) * units[unit] <= most:
        spark.conf.set(name, str(most))


def small_batches(spark: SparkSession) -> None:
    """Python tasks get at most BATCH_ROWS rows, or BATCH_BYTES bytes and a row, at a time: rows hold texts or series."""
    at_most(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    at_most(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def local_session(cpus: int | str = "*", memory: str = "16g") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    partitions = "8" if cpus == "*" else str(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cyclewright")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
