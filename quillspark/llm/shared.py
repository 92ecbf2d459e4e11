"""What the operators of this subpackage share: the work folder, cut lineage, two-level running sums."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the contracts: space and \t to \r. bytes.split() and bytes.strip() use the same six.
ASCII_SPACE = b" \t\n\r\x0b\x0c"
WORD = r"[^\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written tables and files: spark.checkpoint.dir of the session.

    Only where that is unset (a local session in tests) a temporary folder is made, set and removed at exit.
    """
    for conf in (lambda: spark.conf.get("spark.checkpoint.dir", None), lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        if found := conf():
            return found.rstrip("/")
    own = tempfile.mkdtemp(prefix="quillspark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def carry_modules(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, whatever folder the driver was started in.

    It is one more entry on their path; a cluster that installs the package or sets PYTHONPATH does not need it.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in [*paths, root] if p)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def free_name(name: str, columns: list[str]) -> str:
    """name, or name behind as many underscores as no column has (letter case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: While a table is written: bytes of the Arrow batches that Python workers get, whatever the length of texts, and rows that the
#: Parquet reader decodes at once. Buffers of many MB stay with an executor's allocator and heap after they are freed.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: what follows no longer depends on executors' files."""
    spark = df.sparkSession
    path, was = new_path(spark, name), {k: spark.conf.get(k, None) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Running totals per keys in the order of (bucket, order), without ever bringing all rows of a key together.

    bucket must not decrease along the order. sums: new column -> column to add up; the new column holds the
    total of all rows before this one. Totals per (keys, bucket) are added up first, then rows inside each bucket.
    """
    at = [*keys, bucket]
    totals = df.groupBy(*at).agg(*(F.sum(c).alias(f"_t_{new}") for new, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(c).alias(f"_k_{c}") for c in at), *(F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_o_{new}") for new in sums))
    joined = df.join(offsets.hint("merge"), [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in at]).drop(*(f"_k_{c}" for c in at))
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumns({new: F.col(f"_o_{new}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for new, c in sums.items()}).drop(*(f"_o_{new}" for new in sums))
