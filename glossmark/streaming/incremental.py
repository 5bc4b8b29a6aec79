"""Scoring of arriving records as a stream: keyed state knows what was scored, so a batch's work doesn't follow the history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from glossmark.operators.scores import ScorerFactory, scored
from glossmark.sources.store import KEYS

SEGMENT = "item_id string, translator string, seg_id int, src_en string, hyp_bn string, seg_mismatch int"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_segments(rows: DataFrame) -> DataFrame:
    """The first row of every key that has ever come. The state holds keys alone, on local disk with changes in the checkpoint."""
    return rows.dropDuplicates(KEYS)


def score_stream(spark: SparkSession, source: str, results: str, checkpoint: str, name: str, factory: ScorerFactory, available_now: bool = True) -> StreamingQuery:
    """Reads long-table files from ``source`` as they come and appends item_id, translator, seg_id and the score to the Parquet table ``results``.

    Each segment is scored once, restarts and repeated files included: its key is in the state of the query, and the sink's log names
    the files of whole batches, so a batch that is repeated after a failure leaves no row twice. Read ``results`` with Spark.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    rows = new_segments(spark.readStream.schema(SEGMENT).parquet(source))
    found = scored(rows, name, factory).select(*KEYS, name)
    stream = found.writeStream.format("parquet").outputMode("append").option("path", results).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
