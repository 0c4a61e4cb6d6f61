"""The text format of specific strings: name or * (the same read as above), start, length and tag, by tabs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .reports import write_lines


def parse_strings(lines: DataFrame) -> DataFrame:
    """lines: ord and value. A name that comes again starts that read's list anew: the last run of a name counts.

    ord is that of monotonically_increasing_id, whose upper bits number the partition. Names are filled within each
    partition; what a partition's first lines refer to is carried over from those before by a table of one row each.
    """
    parts = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    rows = lines.select("ord", F.shiftright("ord", 33).alias("part"), parts.alias("p")).where(F.size("p") >= 3)
    named = rows.withColumn("name", F.when(F.col("p")[0] != "*", F.col("p")[0])).withColumn("begins", F.when(F.col("name").isNotNull(), F.col("ord")))
    last = named.groupBy("part").agg(F.max_by("name", "begins").alias("name"), F.max("begins").alias("begins"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("part", F.last("name", ignorenulls=True).over(before).alias("carried_name"), F.last("begins", ignorenulls=True).over(before).alias("carried_run"))
    w = Window.partitionBy("part").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    # a row for each input split: bounded by their number
    filled = named.join(F.broadcast(carried), "part").select(
        "p", F.coalesce(F.last("name", ignorenulls=True).over(w), "carried_name").alias("qname"), F.coalesce(F.last("begins", ignorenulls=True).over(w), "carried_run").alias("run")
    )
    kept = filled.withColumn("last_run", F.max("run").over(Window.partitionBy("qname"))).where(F.col("run") == F.col("last_run"))
    return kept.select("qname", F.col("p")[1].cast("int").alias("qs"), F.col("p")[2].cast("int").alias("l"), F.coalesce(F.try_element_at("p", F.lit(4)).cast("int"), F.lit(0)).alias("htag"))


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    return parse_strings(spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()))


def string_lines(strings: DataFrame) -> DataFrame:
    """qname, k and value: the lines of each read in order, the name on its first only."""
    w = Window.partitionBy("qname").orderBy("qs", "l")
    k = strings.withColumn("k", F.row_number().over(w))
    name = F.when(F.col("k") == 1, F.col("qname")).otherwise("*")
    return k.select("qname", "k", F.concat_ws("\t", name, F.col("qs").cast("string"), F.col("l").cast("string"), F.col("htag").cast("string"), F.lit("")).alias("value"))


def write_strings(strings: DataFrame, path: str) -> None:
    write_lines(string_lines(strings), ["qname", "k"], path)
