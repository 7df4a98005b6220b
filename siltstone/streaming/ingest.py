"""Structured Streaming: bounded, resumable builds, and searches over arriving documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import lines, without_cr
from ..plans.pattern import plan
from ..shared import Store
from ..sources.corpus import from_table
from ..sources.store import Index


def table_stream(spark: SparkSession, path: str, max_files: int = 4000, max_bytes: str | None = None) -> DataFrame:
    """A Parquet table (a file or a folder of files) as a stream of bounded batches."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxBytesPerTrigger", max_bytes) if max_bytes else reader.option("maxFilesPerTrigger", max_files)
    folder, _, name = path.rstrip("/").rpartition("/")
    store = Store(spark, folder)
    if store._fs.getFileStatus(store._path(path)).isFile():
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def index_stream(docs: DataFrame, index: Index, checkpoint: str, key: str = "doc_id", text: str = "text", stream: str = "stream") -> StreamingQuery:
    """Build an index batch by batch; each batch is a generation that is named when whole.

    After a failure the checkpoint replays the last batch under its old number, so finished
    batches are not done again and none counts twice. Streams with checkpoints of their own
    need names of their own.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        index.append(from_table(batch, key, text), batch_id, stream)

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing_search(docs: DataFrame, pattern: str, ignore_case: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Hits (key, lineno, line) of a stream of documents, as they arrive; no state is kept."""
    java = plan(pattern, ignore_case, docs.sparkSession).java
    rows = docs.select(F.col(key), F.posexplode(lines(F.col(text))).alias("pos", "line")).filter(F.col("line").rlike(java))
    return rows.select(key, (F.col("pos") + 1).alias("lineno"), without_cr(F.col("line")).alias("line"))


def hits_stream(hits: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append hits to a Parquet folder until the input there is now has been read."""
    return hits.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
