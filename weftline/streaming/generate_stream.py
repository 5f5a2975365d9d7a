"""Generated rows as a stream: the same cells as in a batch, by row number, from a rate source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.generate import Generator
from weftline.plans.model import Plan


def row_stream(spark: SparkSession, rows_per_second: int) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def generated(rows: DataFrame, plan: Plan, table: str) -> DataFrame:
    """The cells of a table without foreign keys for rows(value: row number, timestamp), streaming or not. Without state: a
    restarted stream gives the same rows again."""
    engine = Generator(rows.sparkSession, plan)
    cells = {c: engine.value(table, c, f, F.col("__row"), {}) for c, f in plan.tables[table].fields.items()}
    return rows.withColumnRenamed("value", "__row").withColumns(cells).select("timestamp", *cells)


def unique_within(rows: DataFrame, columns: list[str], late: str = "10 minutes") -> DataFrame:
    """Of rows that repeat the columns within the watermark only the first; the state is as large as that time's keys."""
    return rows.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(columns)


def counts_by_time(rows: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Rows by window of event time: progress that late rows still reach."""
    return rows.withWatermark("timestamp", late).groupBy(F.window("timestamp", width)).agg(F.count("*").alias("rows"))
