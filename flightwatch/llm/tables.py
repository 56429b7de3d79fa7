"""Reading tables, and writing stage results where every executor sees them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes that are handed to Python at a time. A batch lies in the memory of both sides, outside the heap, several
#: times while it is made: with Spark's 10,000 rows one batch holds all texts of a task.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile hands rows to Python in batches of BATCH_LIMITS at most; lower limits of the session stay."""
    before = {k: spark.conf.get(k, None) for k in BATCH_LIMITS}
    try:
        for k, most in BATCH_LIMITS.items():
            now = before[k]
            if not now or not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
                spark.conf.set(k, str(most))
        yield
    finally:
        for k, value in before.items():
            if value is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: computed once, with a short
    lineage, and still there when an executor is lost."""
    path = f"{shared_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_settled(spark: SparkSession) -> None:
    """Remove this application's stage tables, once results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches, *columns: str, rows: int = 256):
    """Python lists of ``columns``, a bounded number of rows of an Arrow batch at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield tuple(part.column(c).to_pylist() for c in columns)


def arrow_schema(ddl: str):
    """The Arrow form of a schema given as text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))
