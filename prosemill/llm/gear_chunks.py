"""Substring dedup by content-defined chunks cut with a gear rolling hash.

Over a text's UTF-8 bytes runs the gear hash h = 2h + G[byte] (32 bits, so the last 32
bytes count). A chunk ends after a byte where the hash's top ``MASK_BITS`` bits are
zero, once it has ``SHORTEST`` bytes, and at ``LONGEST`` bytes in any case. Since cuts
depend on nearby bytes alone, an insertion shifts only the chunks that it touches.
Chunks are deduplicated by a 96-bit digest over the whole table; stretches of adjacent
chunks that occur more than once and make up at least ``RUN`` bytes are reported.

Defined results: null and empty texts have no chunks; a repeat within one document
counts as well as one across documents; rows that repeat a document id are one
document each, and their equal chunks at equal places count as repeats, listed once. The first
occurrence by (document, offset) of each chunk is the one that stays, the others may
go. Rows with a null id are not looked at, nor are other columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosemill.llm._text import SpanHasher, buffers, byte_table, row_blocks

MASK_BITS = 4
SHORTEST = 16
LONGEST = 256
RUN = 100


def gear(data):
    """The rolling hash after each byte, by doubling: the hash over 2m bytes from two over m."""
    h = (byte_table(31) >> np.uint64(32)).astype(np.uint32)[data]
    m = 1
    while m < 32:
        h[m:] += h[:-m] << np.uint32(m) if len(h) > m else h[:0]
        m *= 2
    return h


def cuts(data, off, shortest=SHORTEST, longest=LONGEST, bits=MASK_BITS):
    """Chunk ends of each row's text in ``data``, which begin at the row's start; a row's hash starts fresh."""
    h = gear(data)
    # Bytes before a row's start must not count: the first 31 of each row are hashed on their own.
    for s, e in zip(off[:-1], off[1:]):
        h[s : min(e, s + 31)] = gear(data[s : min(e, s + 31)])
    marks = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    marks = marks.tolist()
    ends, n, k = [], len(marks), 0
    add = ends.append
    for s, e in zip(off[:-1].tolist(), off[1:].tolist()):
        while s < e:
            least, most = s + shortest, s + longest
            while k < n and marks[k] < least:
                k += 1
            s = marks[k] if k < n and marks[k] <= most else most
            if s > e:
                s = e
            add(s)
    return np.array(ends, np.int64)


def chunk(batches):
    """(id, off, len, d1, d2) of every chunk."""
    one, two = SpanHasher(32), SpanHasher(33)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, off = buffers(batch.column(1))
        for i, j in row_blocks(off):
            block, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
            if not len(block):
                continue
            end = cuts(block, at)
            start = np.concatenate(([0], end[:-1]))
            row = np.searchsorted(at, start, side="right") - 1
            d1 = one.load(block).spans(start, end)
            d2 = two.load(block).spans(start, end) >> np.uint64(32)
            yield pa.record_batch([pa.array(ids[i:j][row]), pa.array((start - at[row]).astype(np.int64)), pa.array((end - start).astype(np.int32)), pa.array(d1.view(np.int64)), pa.array(d2.astype(np.uint32).view(np.int32))], ["id", "off", "len", "d1", "d2"])


def repeated_chunks(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, off, len, n, first: struct<id, off>) of every chunk that occurs more than once.

    Counts are combined before they are shuffled and the chunks then joined with the
    repeated digests, so a chunk that half of the corpus shares is no single task's work.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    chunks = src.mapInArrow(chunk, "id long, off long, len int, d1 long, d2 int")
    repeated = chunks.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "off")).alias("first")).where("n > 1")
    return chunks.join(repeated.hint("shuffle_hash"), ["d1", "d2"]).select("id", "off", "len", "n", "first")


def repeated_passages(docs: DataFrame, id_col="doc_id", text_col="text", run=RUN) -> DataFrame:
    """(doc_id, start, end, chunks, removable_bytes, first_doc_id): stretches, as byte offsets of the text in UTF-8.

    ``removable_bytes`` are those of chunks whose first occurrence is elsewhere;
    ``first_doc_id`` is the least document that has the stretch's first chunk.
    """
    by = Window.partitionBy("id").orderBy("off")
    c = repeated_chunks(docs, id_col, text_col).repartition("id").groupBy("id", "off").agg(F.max("len").alias("len"), F.min("first").alias("first"))
    c = c.withColumn("new", (F.coalesce(F.lag(F.col("off") + F.col("len")).over(by), F.lit(-1)) != F.col("off")).cast("int")).withColumn("g", F.sum("new").over(by))
    spans = c.groupBy("id", "g").agg(
        F.min("off").alias("start"),
        F.max(F.col("off") + F.col("len")).alias("end"),
        F.count(F.lit(1)).alias("chunks"),
        F.sum(F.when(F.col("first") == F.struct("id", "off"), 0).otherwise(F.col("len"))).alias("removable_bytes"),
        F.min(F.struct("off", F.col("first.id").alias("d"))).alias("f"),
    )
    return spans.where(F.col("end") - F.col("start") >= run).select(F.col("id").alias("doc_id"), "start", "end", "chunks", "removable_bytes", F.col("f.d").alias("first_doc_id"))


def op5_gear_chunks(spark, sf_dir):
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
