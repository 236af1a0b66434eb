"""An hourly load series and a weather table made from the order tables.

Every row of both tables is used. About 20,000 line items make one series, so the number of
series, and with it all later work, grows with the tables. Prices are the noise around a daily, a
weekly and a yearly course of load, and around a daily and a yearly one of temperature. The clock
mapping leaves a 3-hour and a 30-hour hole in the load and a missing hour in every 37 of the
weather; a few readings are scaled or negated, like a faulty meter's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_LOAD = """
    SELECT concat('S', lpad(CAST(l_orderkey DIV 5000 AS STRING), 8, '0')) AS series,
           TIMESTAMP_NTZ '2016-01-01 00:00:00' + make_dt_interval(0, CAST(h AS INT)) AS wall,
           CASE WHEN l_orderkey % 641 = 0 THEN 12 ELSE IF(l_orderkey % 643 = 1, -1, 1) END * (
             24000 + 4500 * sin(2 * pi() * (h % 24 - 9) / 24) + IF((h DIV 24 + 4) % 7 >= 5, -1500, 0)
             + 2500 * cos(2 * pi() * (h - 480) / 8766) + 20 * sqrt(l_extendedprice)) AS load
    FROM (SELECT l_orderkey, l_extendedprice, h + IF(h >= 3123, 3, 0) + IF(h >= 6165, 30, 0) AS h
          FROM (SELECT *, (l_orderkey * 7 + l_linenumber * 1237) % 9600 AS h FROM {lineitem}))
"""
RAW_WEATHER = """
    SELECT TIMESTAMP_NTZ '2016-01-01 00:00:00' + make_dt_interval(0, CAST(h AS INT)) AS datetime_utc,
           12 - 13 * cos(2 * pi() * (h - 360) / 8766) + 4 * sin(2 * pi() * (h % 24 - 14) / 24)
             + sqrt(o_totalprice) / 45 - 5 AS temp_c, o_orderkey AS tiebreak
    FROM (SELECT o_orderkey, o_totalprice, o_orderkey % 9600 + o_orderkey % 9600 DIV 36 AS h FROM {orders})
"""


def raw_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW_LOAD, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def raw_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW_WEATHER, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def weather_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON payload per order: its lines' load hours and readings as parallel arrays."""
    return spark.sql(
        """
        SELECT chunk, to_json(struct(struct(
                 transform(lines, x -> translate(CAST(x.wall AS STRING), ' ', 'T')) AS time,
                 transform(lines, x -> x.reading) AS temperature_2m) AS hourly)) AS payload
        FROM (SELECT l_orderkey AS chunk,
                     array_sort(collect_list(struct(l_linenumber AS pos,
                       TIMESTAMP_NTZ '2016-01-01 00:00:00' + make_dt_interval(0,
                         CAST((l_orderkey * 7 + l_linenumber * 1237) % 9600 AS INT)) AS wall,
                       l_quantity / 2 - 5 AS reading))) AS lines
              FROM {lineitem} GROUP BY l_orderkey)
        """,
        lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"),
    )
