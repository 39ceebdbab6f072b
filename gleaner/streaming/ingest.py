"""Incremental ingestion: new documents of a folder become chunks exactly once (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.chunking import chunk_documents
from gleaner.operators.numbering import numbered
from gleaner.schemas import RAW
from gleaner.sources.corpus import documents

#: Bits of ``seq`` that tell the chunks of a batch apart; the batch's number stands above them.
PLACES = 40


def chunk_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Chunk JSON lines (id, title, type, content) that appear in folder into Parquet under out/batch=<n>.

    ``seq`` is the batch's number and a chunk's place in it, so it is unique and later batches come
    later.  A batch overwrites its own folder, so a replay after a failure leaves each chunk once.
    """
    lines = spark.readStream.schema(RAW).json(folder)

    def write(batch: DataFrame, number: int) -> None:
        # a document's chunks are kept together and in order by its id and a hash of what it holds
        docs = documents(batch.withColumn("seq", F.xxhash64("id", "title", "content")))
        placed = numbered(chunk_documents(docs), "document_id", "place", name="at")
        chunks = placed.withColumn("seq", F.lit(number << PLACES) + F.col("at")).drop("place", "at")
        chunks.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
