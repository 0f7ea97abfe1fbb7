"""What the driver and the executors share: the package itself and a folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix="kindred-", suffix=".zip", delete=False) as f:
        with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*")):
                if p.suffix in (".py", ".csv", ".json", ".txt"):
                    z.write(p, p.relative_to(top.parent))
    context.addPyFile(f.name)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder that the driver and all executors share.

    That is ``spark.checkpoint.dir``, or a checkpoint folder set on the context. Where neither is set, a session on
    one machine, as in tests, sets a temporary folder; on a cluster that is an error, as executors would write what
    others can't see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif context.master.split("[")[0] == "local":
            base = tempfile.mkdtemp(prefix="kindred-")
            context.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Spark's own setting: shuffle files go when the query that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a DataFrame as Parquet in the shared folder and read it again, which cuts its lineage.

    The shuffle files of the write go with it, as nothing else reads them.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark, purpose), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
