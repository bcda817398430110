"""Streams: NDJSON event ingestion and an incremental sink that resumes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from partloom.sources.schemas import EVENT


def read_events(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """A stream of JSON lines; lines that don't parse keep their text in ``bad``."""
    lines = spark.readStream.format("text").load(path)
    parsed = lines.select("value", F.from_json("value", schema).alias("e"))
    empty = F.to_json("e") == "{}"
    return parsed.select("e.*", F.when(F.col("e").isNull() | empty, F.col("value")).alias("bad"))


def run_resumable(rows: DataFrame, score, out: str, checkpoint: str, key: str = "sample_id") -> StreamingQuery:
    """Scores arriving rows whose key isn't in ``out`` yet and appends them; replayed input adds nothing.

    Keys already seen are the stream's state, kept in the checkpoint, so a batch costs what its own rows cost,
    however long the stream has run (keep the state in RocksDB for many keys:
    spark.sql.streaming.stateStore.providerClass). A restart goes on where the checkpoint ends; a batch that is run
    again overwrites its own folder. With a new checkpoint over earlier output, what lies there when the stream
    starts is skipped by an anti-join with those folders only, and this stream's folders get names of their own.
    """
    spark = rows.sparkSession
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    mark = f"{checkpoint}/partloom-run"
    known = fs.exists(path(mark))
    if not known:  # a new stream: what is there now was written by others
        earlier = sorted(str(s.getPath()) for s in fs.listStatus(path(out)) if s.isDirectory() and s.getPath().getName().startswith("epoch=")) if fs.exists(path(out)) else []
        spark.createDataFrame([(uuid.uuid4().hex[:8], earlier)], "run string, earlier array<string>").coalesce(1).write.json(mark)
    run, earlier = spark.read.schema("run string, earlier array<string>").json(mark).first()

    def sink(batch: DataFrame, epoch: int) -> None:
        fresh = batch
        if earlier:
            fresh = fresh.join(batch.sparkSession.read.parquet(*earlier).select(key), key, "left_anti")
        score(fresh).write.mode("overwrite").parquet(f"{out}/epoch={epoch:08d}-{run}")

    return rows.dropDuplicates([key]).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
