"""Scoring of predictions as they arrive.

The batch functions apply to streams unchanged; what a stream adds is here: one prediction per id inside a watermark,
and running summaries per window of event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.answers import rel_error, score


def score_stream(preds: DataFrame, gold: DataFrame, key: str, pred: str, truth: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """Arriving predictions (repeats of an id within ``delay`` dropped) with error and score; ``gold`` is a static table."""
    first = preds.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return first.join(gold, key).withColumn("rel_error", rel_error(pred, truth)).withColumn("score", score("rel_error"))


def score_last_stream(preds: DataFrame, gold: DataFrame, key: str, pred: str, truth: str, time: str, gap: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """As ``score_stream``, but of the predictions of an id that follow one another within ``gap`` the last counts, as in batch.

    A prediction leaves once the watermark has passed the gap behind it: no later one can take its place then.
    """
    last = preds.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.max_by(F.struct(*(F.col(c) for c in preds.columns if c != key)), time).alias("__p"))
    return last.select(key, "__p.*").join(gold, key).withColumn("rel_error", rel_error(pred, truth)).withColumn("score", score("rel_error"))


def windowed_summary(scored: DataFrame, time: str, kind: str, width: str = "5 minutes") -> DataFrame:
    """Rows, total and mean error per window of event time and kind; a window is final once the watermark passed it."""
    w = F.window(time, width)
    return scored.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.sum("score").alias("raw_score"), F.avg("rel_error").alias("rel_error_mean")).select(F.col("w.start").alias("start"), kind, "n", "raw_score", "rel_error_mean")


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there to a Parquet log, once, and can go on from its checkpoint."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
