"""Making this package importable in Spark's Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def is_local(spark: SparkSession) -> bool:
    """Whether all runs in one process; ``local-cluster`` has executors of its own."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession) -> None:
    """Let workers import this package: by its path where they see it, else by a zip that Spark sends them."""
    sc = spark.sparkContext
    known = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if str(_ROOT) not in known:
        sc.environment["PYTHONPATH"] = os.pathsep.join([str(_ROOT), *filter(None, known)])
    if is_local(spark) or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    path = os.path.join(tempfile.mkdtemp(prefix="longview-"), "longview_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in (_ROOT / "longview").rglob("*.py"):
            z.write(f, f.relative_to(_ROOT))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; set to a local one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="longview-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back, so that it is computed once and its lineage ends."""
    path = f"{shared_dir(df.sparkSession)}/longview/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
