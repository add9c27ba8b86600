"""Incremental ingestion, upserts, progress and conversation state as Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager
from heapq import nlargest
from itertools import chain
from operator import itemgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shelfspark.operators.keyed import keep_first, upsert
from shelfspark.sources import files
from shelfspark.sources.sinks import append_new


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A query over what is available ends with its data; clearing expired state would call for another batch for ever.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def _state_on_disk(spark: SparkSession):
    """Queries started inside keep their state in the state store on disk, not in executor memory."""
    before = {key: spark.conf.get(key, None) for key in _STORE}
    for key, value in _STORE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def ingest_new(stream: DataFrame, target: str, checkpoint: str, key: str = "id", order: str | None = None) -> StreamingQuery:
    """Append records whose key was not seen before.

    The seen keys are the query's state, so a batch looks up its own keys only, and the
    file sink commits a batch once. With ``order`` the first record of a batch per key counts; the
    stored keys are then looked up in the target, in the parts that the batch touches.
    """
    if order is None:
        with _state_on_disk(stream.sparkSession):
            return (stream.dropDuplicates([key]).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
                    .outputMode("append").trigger(availableNow=True).start())

    def batch(df: DataFrame, epoch: int) -> None:
        append_new(keep_first(df, [key], [F.col(order)]), target, key)

    return (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


#: Parts of a state table; a batch rewrites the parts that its keys fall into. Choose it so that
#: a part is written by one task in reasonable time.
BUCKETS = 32


def _replace(new: DataFrame, target: str, epoch: int, key: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int) -> None:
    """Merge a batch into the parts of the state that it touches and write these as version
    ``epoch``. A version counts once its ``_SUCCESS`` mark is there, so a batch that broke off
    is never read and its repetition overwrites it. Parts older than the one replaced go."""
    spark = new.sparkSession
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
    touched = [r["bucket"] for r in new.select(part.alias("bucket")).distinct().collect()]
    if not touched:
        return
    versions = _versions(spark, target, before=epoch)
    stored = [f"{target}/v={versions[b][-1]}/bucket={b}" for b in touched if b in versions]
    merged = merge(spark.read.parquet(*stored) if stored else None, new)
    merged.withColumn("bucket", part).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={epoch}")
    for b in touched:
        for old in versions.get(b, [])[:-1]:
            files.delete(spark, f"{target}/v={old}/bucket={b}")


def _versions(spark: SparkSession, target: str, before: int | None = None) -> dict[int, list[int]]:
    """Finished versions of every part, oldest first."""
    out: dict[int, list[int]] = {}
    for v in sorted(int(n[2:]) for n in files.names(spark, target) if n.startswith("v=")):
        inside = files.names(spark, f"{target}/v={v}")
        if "_SUCCESS" in inside and (before is None or v < before):
            for n in inside:
                if n.startswith("bucket="):
                    out.setdefault(int(n[7:]), []).append(v)
    return out


def _latest(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest finished version of every part."""
    paths = [f"{target}/v={v[-1]}/bucket={b}" for b, v in sorted(_versions(spark, target).items())]
    return spark.read.parquet(*paths) if paths else None


def ingest_upsert(stream: DataFrame, target: str, checkpoint: str, key: str = "id", version: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the last write per key (the highest ``version``, however late older ones arrive)."""
    def merge(previous: DataFrame | None, df: DataFrame) -> DataFrame:
        return upsert(df.limit(0) if previous is None else previous, df, key, version)

    def batch(df: DataFrame, epoch: int) -> None:
        _replace(df, target, epoch, key, merge, buckets)

    return (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_upserted(spark: SparkSession, target: str) -> DataFrame | None:
    return _latest(spark, target)


def track_progress(stream: DataFrame, target: str, checkpoint: str, by: str) -> StreamingQuery:
    """Progress table: finished units (category, query) with their counts, one part per batch."""
    def batch(df: DataFrame, epoch: int) -> None:
        (df.groupBy(by).agg(F.count(F.lit(1)).alias("count")).withColumn("epoch", F.lit(epoch))
         .write.mode("overwrite").parquet(f"{target}/epoch={epoch}"))

    return (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


#: Conversations go to the state processor in this many blocks by the hash of their id: a frame per block costs a fraction of
#: one per conversation. What is stored stays per conversation. The number is part of a checkpoint.
BLOCKS = 4096


class _Window(StatefulProcessor):
    """Messages of a conversation so far and the last ``keep`` of them with their sizes."""

    def __init__(self, conv: str, turn: str, keep: int, expire_ms: int | None):
        self.conv, self.turn, self.keep, self.expire_ms = conv, turn, keep, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("conversation", f"{self.conv} string", _STATE, self.expire_ms)

    def handleInputRows(self, key, rows, timerValues):
        for batch in rows:  # a conversation of any length goes through in batches
            said: dict = {}
            for conv, turn, size in zip(*(batch[c].tolist() for c in (self.conv, self.turn, "size"))):
                said.setdefault(conv, []).append((turn, size))
            for conv, new in said.items():
                n, turns, sizes = self.state.getValue((conv,)) or (0, (), ())
                last = nlargest(self.keep, chain(zip(turns, sizes), new), key=itemgetter(0))  # of equal turns the first
                self.state.updateValue((conv,), (n + len(new), [t for t, _ in last], [s for _, s in last]))
        return iter(())  # the state is the answer

    def close(self) -> None:
        pass


_STATE = "n long, turns array<long>, sizes array<long>"


def track_conversations(stream: DataFrame, target: str, checkpoint: str, keep: int = 10, conv: str = "conv_id", turn: str = "turn",
                        text: str = "text", expire_ms: int | None = None) -> StreamingQuery:
    """State per conversation: messages so far, how many left the window, characters in it.

    Kept in the state store of the query, below ``checkpoint`` (``target`` names it for readers); a
    batch touches the conversations it brings, and holds the last ``keep`` messages of each.
    ``expire_ms`` forgets a conversation so long after its last message.
    """
    kind = stream.schema[conv].dataType.simpleString()
    # No null among the numbers: pandas would make floats of a whole batch. A null turn is older than all, a null text empty.
    sized = stream.select(F.pmod(F.xxhash64(conv), F.lit(BLOCKS)).alias("block"), F.col(conv).cast("string").alias(conv),
                          F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 63))).alias(turn), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("size"))
    told = sized.groupBy("block").transformWithStateInPandas(
        _Window(conv, turn, keep, expire_ms), f"{conv} string", "Update", "None" if expire_ms is None else "ProcessingTime")
    files.write_text(stream.sparkSession, f"{target}/state.json", json.dumps({"checkpoint": checkpoint, "conv": conv, "kind": kind}))
    with _state_on_disk(stream.sparkSession):
        return told.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_conversations(spark: SparkSession, target: str) -> DataFrame:
    """The latest state of every conversation, read from the state store."""
    made = json.loads(files.read_text(spark, f"{target}/state.json"))
    state = spark.read.format("statestore").option("stateVarName", "conversation").load(made["checkpoint"])
    value = F.col("user_map_value")
    if "ttlExpirationMs" in state.schema["user_map_value"].dataType.fieldNames():
        state = state.filter(value["ttlExpirationMs"] > F.unix_millis(F.current_timestamp()))
        value = value["value"]
    total = F.aggregate(value["sizes"], F.lit(0).cast("long"), lambda a, x: a + x)
    return state.select(F.col(f"user_map_key.{made['conv']}").cast(made["kind"]).alias(made["conv"]), value["n"].alias("n_messages"), (value["n"] - F.size(value["sizes"])).alias("summarized_idx"),
                        total.alias("window_chars"))
