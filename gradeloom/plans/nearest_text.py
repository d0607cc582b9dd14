"""The largest sequence similarity of a text to any text of its group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence

#: Texts of one group that a block holds.
BLOCK = 64


def packed(df: DataFrame, group: str, text: str, name: str) -> DataFrame:
    """Different texts of each group in blocks of about ``BLOCK``: group, number of the block, texts.

    Each text goes to its block by hash, so a group of any size is spread over its blocks without being gathered.
    """
    texts = df.select(F.col(group).alias("group"), F.col(text).alias("text")).where(F.col("group").isNotNull() & F.col("text").isNotNull()).distinct()
    sizes = texts.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = texts.join(sizes.withColumnRenamed("group", "__g"), F.col("group") == F.col("__g"))
    return dealt.groupBy("group", F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int").alias("block")).agg(F.collect_list("text").alias(name))


def best_in_group(df: DataFrame, train: DataFrame, group: str, text: str) -> DataFrame:
    """(group, text, similarity): the largest similarity of each different text of ``df`` to one of its group in ``train``.

    Blocks of texts meet blocks of the same group; inside a pair of blocks only pairs that can still be the best are scored.
    """
    mine, theirs = packed(df, group, text, "texts"), packed(train, group, text, "others")
    pairs = mine.select("group", "texts").join(theirs.select(F.col("group").alias("__g"), "others"), F.col("group") == F.col("__g")).drop("__g")
    schema = f"group {df.schema[group].dataType.simpleString()}, text string, similarity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts = batch.column("texts")[i].as_py()
                best = sequence.best_of(texts, batch.column("others")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("group")[i].as_py()] * len(texts), batch.schema.field("group").type), pa.array(texts), pa.array(best)], names=["group", "text", "similarity"])

    return pairs.mapInArrow(run, schema).groupBy("group", "text").agg(F.max("similarity").alias("similarity"))
