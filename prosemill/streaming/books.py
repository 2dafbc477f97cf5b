"""Streaming: new books of a folder are segmented as they arrive; the checkpoint is the restart log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.operators import segment as S
from prosemill.sources.corpus import PATTERN, _decoded

_FILES = "path string, modificationTime timestamp, length long, content binary"


def book_stream(spark: SparkSession, root: str, pattern: str = PATTERN) -> DataFrame:
    """(path, text, bytes, error) of files as they come."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return _decoded(files)


def segment_stream(spark: SparkSession, root: str, out: str, checkpoint: str, pattern: str = PATTERN, once: bool = True):
    """Appends sentences of new books to Parquet at ``out``; a batch that is run again replaces its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        S.segment(batch.where("text is not null"), ("path",)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = book_stream(spark, root, pattern).writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()


def sentence_stream(docs: DataFrame, id_cols=("doc_id",), text_col="text") -> DataFrame:
    """Sentences of a stream of documents: the same plan as in batch, with no state."""
    return S.sentences(docs, id_cols, text_col)


def running_totals(docs: DataFrame, by: str, text_col="text") -> DataFrame:
    """Sentences and characters by group so far, for complete or update mode."""
    n = S.sentence_count(text_col)
    return docs.select(by, n.alias("n"), F.length(text_col).alias("c")).groupBy(by).agg(F.sum("n").alias("sentences"), F.sum("c").alias("chars"))
