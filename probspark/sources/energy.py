"""Two-dimensional energy densities on a grid, and samples of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform


def _w1(x: Column) -> Column:
    return F.sin(x * (math.pi / 2))


def _w2(x: Column) -> Column:
    return 3 * F.exp(-0.5 * ((x - 1) / 0.6) ** 2)


def _w3(x: Column) -> Column:
    return 3 / (1 + F.exp(-(x - 1) / 0.3))


def moons(x: Column, y: Column) -> Column:
    norm = F.sqrt(x * x + y * y)
    e = 0.5 * ((norm - 2) / 0.4) ** 2 - F.ln(F.exp(-0.5 * ((x - 2) / 0.6) ** 2) + F.exp(-0.5 * ((x + 2) / 0.6) ** 2))
    return F.exp(-e)


def waves(x: Column, y: Column) -> Column:
    return F.exp(-0.5 * ((y - _w1(x)) / 0.4) ** 2)


def split(x: Column, y: Column) -> Column:
    return F.exp(-0.5 * ((y - _w1(x)) / 0.35) ** 2) + F.exp(-0.5 * ((y - _w1(x) + _w2(x)) / 0.35) ** 2)


def nails(x: Column, y: Column) -> Column:
    return F.exp(-0.5 * ((y - _w1(x)) / 0.4) ** 2) + F.exp(-0.5 * ((y - _w1(x) + _w3(x)) / 0.35) ** 2)


DENSITIES = {"moons": moons, "waves": waves, "split": split, "nails": nails}


def grid(spark: SparkSession, steps: int = 64, low: float = -4.0, high: float = 4.0) -> DataFrame:
    """cell, x, y over a square; made from one range, so no join."""
    width = (high - low) / (steps - 1)
    return spark.range(steps * steps).select(F.col("id").alias("cell"), (F.lit(low) + (F.col("id") % steps) * width).alias("x"), (F.lit(low) + F.floor(F.col("id") / steps) * width).alias("y"))


def density_grid(spark: SparkSession, name: str, steps: int = 64) -> DataFrame:
    """cell, x, y, p with p summing to 1."""
    g = grid(spark, steps).withColumn("p", DENSITIES[name](F.col("x"), F.col("y")))
    total = g.agg(F.sum("p")).first()[0]
    return g.withColumn("p", F.col("p") / F.lit(total))


def density_at(spark: SparkSession, name: str, x: Column, y: Column, steps: int = 64) -> Column:
    """The grid's density at a point of one's own table."""
    total = grid(spark, steps).agg(F.sum(DENSITIES[name](F.col("x"), F.col("y")))).first()[0]
    return DENSITIES[name](x, y) / F.lit(total)


def samples(spark: SparkSession, name: str, n: int, **options) -> DataFrame:
    """id, x, y of n samples."""
    return samples_for(spark.range(n), "id", name, **options).select("id", "x", "y")


def samples_for(df: DataFrame, key: str, name: str, steps: int = 64, noise: float = 0.05, seed: int = 42) -> DataFrame:
    """key, x, y: one sample for each row, by its key: cells by inverse distribution over the bounded grid, with Gaussian
    noise."""
    spark = df.sparkSession
    cum = density_grid(spark, name, steps).withColumn("high", F.sum("p").over(Window.orderBy("cell"))).withColumn("low", F.col("high") - F.col("p"))
    rows = df.select(key).withColumn("u", uniform(seed, key, F.lit("cell")))
    # cells meet rows in equal buckets of the unit interval
    slots = steps * steps
    slot = lambda c: F.floor(c * slots)
    cells = cum.withColumn("slot", F.explode(F.sequence(slot(F.col("low")), slot(F.col("high")))))
    hit = rows.withColumn("slot", slot(F.col("u"))).join(F.broadcast(cells), "slot").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    r = F.sqrt(-2 * F.ln(1 - uniform(seed, key, F.lit("r")))) * noise
    a = 2 * math.pi * uniform(seed, key, F.lit("a"))
    return hit.select(key, (F.col("x") + r * F.cos(a)).alias("x"), (F.col("y") + r * F.sin(a)).alias("y"))
