"""The series that the queries use, in Spark and as SQL.

Money is summed in whole cents, so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.gaps import fill_gaps
from ..plans.spec import SeriesSpec

USERS = SeriesSpec("y", date="day", frequency="1 day", groups=("user_id",))
TYPES = SeriesSpec("y", date="day", frequency="1 day", groups=("event_type",))
MONTHS = SeriesSpec("y", date="month", frequency="1 month")
NATIONS = SeriesSpec("y", date="month", frequency="1 month", groups=("c_nationkey",), static=("n_regionkey",))


def _cents(c: str):
    return (F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / 100).alias("y")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("month", F.trunc(F.to_date("o_orderdate"), "month"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily value and number of events of each user, with gaps."""
    return _events(spark, sf_dir).groupBy("user_id", "day").agg(_cents("value"), F.count(F.lit(1)).alias("n_events"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without gaps."""
    return fill_gaps(user_days(spark, sf_dir), USERS)


def type_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily value of each event type; it has no gaps."""
    return _events(spark, sf_dir).groupBy("event_type", "day").agg(_cents("value"))


def order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value and number of orders: one series."""
    return _orders(spark, sf_dir).groupBy("month").agg(_cents("o_totalprice"), F.count(F.lit(1)).alias("n_orders"))


def nation_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value by nation, with its region."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    df = _orders(spark, sf_dir).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    df = df.groupBy("c_nationkey", "month").agg(_cents("o_totalprice"))
    return df.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_nationkey", "month", "y", "n_regionkey")


def segment_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value by market segment."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    return _orders(spark, sf_dir).join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "month").agg(_cents("o_totalprice"))


_Y = "CAST(sum(CAST(round({} * 100) AS BIGINT)) AS DOUBLE) / 100 AS y"
USER_DAYS = f"user_days AS (SELECT user_id, CAST(ts AS DATE) AS day, {_Y.format('value')}, count(*) AS n_events FROM events GROUP BY 1, 2)"
SQL_USERS = f"""{USER_DAYS},
user_grid AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT user_id, min(day) AS lo FROM user_days GROUP BY 1), (SELECT max(day) AS hi FROM user_days)),
users AS (SELECT g.user_id, g.day, u.y, u.n_events, row_number() OVER (PARTITION BY g.user_id ORDER BY g.day) AS row_index FROM user_grid g LEFT JOIN user_days u ON g.user_id = u.user_id AND g.day = u.day)"""
SQL_TYPES = f"types AS (SELECT event_type, day, y, row_number() OVER (PARTITION BY event_type ORDER BY day) AS row_index FROM (SELECT event_type, CAST(ts AS DATE) AS day, {_Y.format('value')} FROM events GROUP BY 1, 2))"
SQL_MONTHS = f"months AS (SELECT month, y, n_orders, row_number() OVER (ORDER BY month) AS row_index FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, {_Y.format('o_totalprice')}, count(*) AS n_orders FROM orders GROUP BY 1))"
SQL_NATIONS = f"nations AS (SELECT c_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, {_Y.format('o_totalprice')}, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey, 2, n_regionkey)"
SQL_SEGMENTS = f"segments AS (SELECT c_mktsegment, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, {_Y.format('o_totalprice')} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
