"""Circuits over streams. Scoring is a projection without state, so it works on streaming frames as it is; stepwise
learning takes one EM step for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.inference import log_likelihood
from ..operators.learn import em_statistics, em_step
from ..plans.nodes import Node, number


def score_stream(stream: DataFrame, root: Node, names: dict[int, str], out: str = "ll") -> DataFrame:
    """Adds log likelihoods to a streaming (or any) frame."""
    return log_likelihood(stream, root, names, out, lowering="columns")


def windowed_score(stream: DataFrame, root: Node, names: dict[int, str], time: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """window start, n, mean_ll over event-time windows with a watermark: drift of the data against the circuit."""
    scored = score_stream(stream.withWatermark(time, late), root, names)
    return scored.groupBy(F.window(time, window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("ll").alias("mean_ll")).select(F.col("w.start").alias("start"), "n", "mean_ll")


def learn_stream(stream: DataFrame, root: Node, names: dict[int, str], step: float = 0.1, checkpoint: str | None = None):
    """Starts a query that moves the circuit by one EM step per micro-batch; returns the query."""
    number(root)

    def update(batch: DataFrame, _: int) -> None:
        sums = {r["name"]: r["value"] for r in em_statistics(batch, root, names).collect()}
        if sums:
            em_step(root, sums, step)

    writer = stream.writeStream.foreachBatch(update)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
