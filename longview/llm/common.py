"""Written tables, joins and session settings used by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from longview.session import shared_dir

#: Rows up to which the small side of a join is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000
#: The same for a table of one number a row.
BROADCAST_KEYS = 1_000_000
#: Rows in an Arrow batch: documents can be long, so batches are kept short.
ARROW_ROWS = 512


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/longview/{name}-{uuid.uuid4().hex}"


#: Spark deletes a query's shuffle files when it has ended; stages of a running one can still be repeated.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: it is computed once and its
    lineage ends at files that outlive any executor. The shuffle files that this took are deleted."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if "/longview/" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of documents small, whatever the session's setting.

    It stays so, as a plan that is returned runs later."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` (settled, so that counting is cheap) has at most ``limit`` rows."""
    return df.limit(limit + 1).count() <= limit


def lookup(left: DataFrame, right: DataFrame, on: list[str], salt_by: str, how: str = "left", salts: int = 16) -> DataFrame:
    """Join ``left`` with ``right``, which has one row for each key and is settled.

    ``right`` is broadcast where its counted rows are few. Else both are shuffled, with the keys
    salted by the hash of ``left``'s column ``salt_by`` so that a key with a third of all rows is
    spread over ``salts`` tasks. Keys match null with null.
    """
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]
    if is_small(right):
        out = left.join(F.broadcast(r), same, how)
    else:
        left = left.withColumn("__salt", F.pmod(F.xxhash64(F.col(salt_by)), F.lit(salts)).cast("int"))
        r = r.withColumn("__rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = left.join(r, [*same, F.col("__salt") == F.col("__rsalt")], how).drop("__salt", "__rsalt")
    return out.drop(*[f"__r_{c}" for c in on])
