"""Readers of the raw inputs and readers/writers of the stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOAD_CSV = "Datetime STRING, load DOUBLE"
WEATHER_CSV = "datetime_utc STRING, temp_c DOUBLE"
WEATHER_JSON = "hourly STRUCT<time: ARRAY<STRING>, temperature_2m: ARRAY<DOUBLE>>"


def _number(c: str):
    """Missing as NULL, never NaN."""
    return F.when(~F.isnan(c), F.col(c)).alias(c)


def read_load_csv(spark: SparkSession, path, series: str | None = None, schema=LOAD_CSV) -> DataFrame:
    """Raw load: text wall clock plus reading. `series` names the rows if the file has no key."""
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    if series is not None:
        raw = raw.withColumn("series", F.lit(series))
    return load_from_text(raw)


def load_from_text(raw: DataFrame) -> DataFrame:
    wall = F.to_timestamp_ntz("Datetime", F.lit("yyyy-MM-dd HH:mm:ss"))
    return raw.select("series", wall.alias("wall"), _number("load"))


def read_weather_csv(spark: SparkSession, path) -> DataFrame:
    """Weather rows; a stamp without a zone is UTC, one with a zone is converted to it."""
    raw = spark.read.schema(WEATHER_CSV).option("header", True).csv(path)
    return raw.select(utc_stamp(F.col("datetime_utc")).alias("datetime_utc"), _number("temp_c"))


def utc_stamp(text):
    """Parse a stamp to UTC wall time without reading the session zone.

    Takes the offset off as a number, because casting through TIMESTAMP would apply the session's.
    """
    bare = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    offset = F.regexp_extract(text, r"T?\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?([+-]\d{2}:?\d{2})$", 1)
    digits = F.regexp_replace(offset, "[^0-9]", "")
    minutes = (
        F.when(digits == "", F.lit(0))
        .otherwise(
            F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
        )
        * F.when(offset.startswith("-"), -1).otherwise(1)
    )
    return bare.cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def flatten_weather_json(payloads: DataFrame, body: str = "payload", order: str = "chunk") -> DataFrame:
    """Weather payloads with parallel arrays to one row per stamp, first payload wins."""
    rows = payloads.select(
        order, F.from_json(F.col(body), WEATHER_JSON).alias("p")
    ).select(
        order,
        F.posexplode(F.arrays_zip(F.col("p.hourly.time"), F.col("p.hourly.temperature_2m"))).alias(
            "pos", "hour"
        ),
    )
    rows = rows.select(
        utc_stamp(F.col("hour.time")).alias("datetime_utc"),
        F.col("hour.temperature_2m").alias("temp_c"),
        F.struct(order, "pos").alias("seen"),
    )
    return rows.groupBy("datetime_utc").agg(F.min_by("temp_c", "seen").alias("temp_c"))


def weather_request_window(raw: DataFrame) -> DataFrame:
    """Dates of weather a load table needs, padded by a day on both sides."""
    return raw.agg(
        F.date_sub(F.to_date(F.min("wall")), 1).alias("start_date"),
        F.date_add(F.to_date(F.max("wall")), 1).alias("end_date"),
    )


def weather_request_chunks(window: DataFrame, years: int = 5) -> DataFrame:
    """Cut a request window into blocks of whole years, clipped to the window."""
    first, last = F.year("start_date"), F.year("end_date")
    return window.select(
        "start_date", "end_date", F.explode(F.sequence(first, last, F.lit(years))).alias("y0")
    ).select(
        F.greatest("start_date", F.make_date("y0", F.lit(1), F.lit(1))).alias("chunk_start"),
        F.least("end_date", F.make_date(F.col("y0") + (years - 1), F.lit(12), F.lit(31))).alias(
            "chunk_end"
        ),
    )


def raw_profile(raw: DataFrame, weather: DataFrame) -> DataFrame:
    """Rows, date span and value span of both raw tables."""

    def profile(df, name, stamp, value):
        return df.agg(
            F.lit(name).alias("source"),
            F.count(F.lit(1)).alias("n_rows"),
            F.to_date(F.min(stamp)).alias("first_date"),
            F.to_date(F.max(stamp)).alias("last_date"),
            F.min(value).alias("min_value"),
            F.max(value).alias("max_value"),
        )

    return profile(raw, "load", "wall", "load").unionByName(
        profile(weather, "weather", "datetime_utc", "temp_c")
    )


def write_table(df: DataFrame, path: str, partition_by=()) -> None:
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """One folder per (protocol, model); a model that was never run has no folder.

    Writing again replaces the folders that the results have rows for, and no others.

    Rebalancing gathers a folder's rows and splits large folders into files of like size.
    """
    balanced = results.hint("rebalance", "protocol", "model")
    balanced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("protocol", "model").parquet(path)


def read_results(spark: SparkSession, path: str, models=None, protocol: str = "weekly") -> DataFrame:
    """Stored results of the named models; names without a folder are just absent."""
    df = spark.read.parquet(path).where(F.col("protocol") == protocol)
    return df.where(F.col("model").isin(*models)) if models is not None else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
