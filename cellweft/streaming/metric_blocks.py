"""Block means of a metric stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The blocks of a run that are not out yet, its last step, and the first block that is not out.
STATE = "blocks array<bigint>, sums array<double>, counts array<bigint>, last bigint, open bigint"


def block_means(stream: DataFrame, ts: str, value: str, block: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean of the metric per block of event time; a block is out once the watermark has passed it."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, block))
        .agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("block_start"), "mean_value", "n")
    )


def step_means(stream: DataFrame, run: str, step: str, value: str, log_interval: int, late: int = 0) -> DataFrame:
    """(run, block, mean_value, n): the mean of a metric over each block of `log_interval` steps of a run; steps count from 1.

    Blocks are those of embeddings.running_loss_mean: a block is out as soon as its last step, or a later one, has come, with
    gaps or without; the last one stays open until then.  With `late` a block waits for so many steps more; what comes after it is out
    is dropped.  Null values count as no step's value, rows without a step are dropped.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        blocks, sums, counts, last, first = state.get if state.exists else ([], [], [], 0, 0)
        held = {b: [s, n] for b, s, n in zip(blocks, sums, counts, strict=True)}
        for frame in frames:
            frame = frame.dropna(subset=["step"])
            if frame.empty:
                continue
            last = max(last, int(frame["step"].max()))
            found = frame["value"].groupby((frame["step"] - 1) // log_interval).agg(["sum", "count"])
            for block, total, n in zip(found.index, found["sum"], found["count"], strict=True):
                if block >= first:
                    own = held.setdefault(int(block), [0.0, 0])
                    own[0], own[1] = own[0] + float(total), own[1] + int(n)
        upto = max(first, (last - late) // log_interval)  # the first block that is not over
        done = sorted(b for b in held if b < upto)
        out = [(key[0], b, held[b][0] / held[b][1] if held[b][1] else None, held[b][1]) for b in done]
        left = sorted(b for b in held if b >= upto)
        state.update((left, [held[b][0] for b in left], [held[b][1] for b in left], last, upto))
        yield pd.DataFrame(out, columns=["run", "block", "mean_value", "n"])

    rows = stream.select(F.col(run).alias("run"), F.col(step).cast("bigint").alias("step"), F.col(value).cast("double").alias("value"))
    kind = rows.schema["run"].dataType.simpleString()
    means = rows.groupBy("run").applyInPandasWithState(
        update, f"run {kind}, block bigint, mean_value double, n bigint", STATE, "append", GroupStateTimeout.NoTimeout
    )
    return means.withColumnRenamed("run", run)
