"""Tables in files, lagged frames by horizon, and models as tables of pickles."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.models import AggregateModel, ForecastModel, PandasModel
from ..plans.spec import LaggedFrame


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | StructType | None = None, null_value: str = "NA") -> DataFrame:
    """Read Parquet, ORC or JSON, or CSV with a header, where ``null_value`` stands for null."""
    if kind == "csv":
        reader = spark.read.option("header", True).option("nullValue", null_value).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").option("mode", "FAILFAST")
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if kind not in ("parquet", "orc", "json"):
        raise ValueError("kind is parquet, orc, json or csv")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.format(kind).load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", null_value: str = "NA", partition_by: tuple[str, ...] = ()) -> None:
    """Write what :func:`read_table` reads."""
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).option("nullValue", null_value).csv(path)
    else:
        writer.format(kind).save(path)


def _folder(key) -> str:
    return "horizon_" + "_".join(map(str, key if isinstance(key, tuple) else (key,)))


def write_frames(lagged: LaggedFrame, path: str, mode: str = "errorifexists") -> None:
    """Each horizon's frame in a folder of its own: their columns differ."""
    for key, frame in lagged.frames.items():
        frame.write.mode(mode).parquet(f"{path}/{_folder(key)}")


def read_frames(lagged: LaggedFrame, path: str) -> LaggedFrame:
    """``lagged`` (for its plan) with the frames read from ``path``, so that features are made once."""
    frames = {k: f.sparkSession.read.schema(f.schema).parquet(f"{path}/{_folder(k)}") for k, f in lagged.frames.items()}
    return replace(lagged, frames=frames)


def write_models(models: ForecastModel, path: str, mode: str = "errorifexists") -> None:
    """The model table: pickles of a pandas model, parameters of an aggregate model."""
    if not isinstance(models.model, (PandasModel, AggregateModel)):
        raise ValueError("save Spark ML models with their own writers")
    models.table.write.mode(mode).parquet(path)


def read_models(models: ForecastModel, spark: SparkSession, path: str) -> ForecastModel:
    """``models`` (for its plan) with the table, and parameters, read from ``path``."""
    table = spark.read.parquet(path)
    params = {}
    for key, p in models.params.items():
        horizons = ", ".join(map(str, key)) if isinstance(key, tuple) else str(key)
        params[key] = table.filter(F.col("horizons") == horizons).select(*p.columns)
    return replace(models, table=table, params=params)
