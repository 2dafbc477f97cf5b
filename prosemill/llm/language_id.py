"""Language identification by compression.

A text is encoded once per language by zstandard, each time with a raw-content
dictionary of that language; the language whose encoding is smallest is chosen,
and none where the runner-up is nearly as small. Texts are lower-cased and ASCII
non-letters dropped first; each block of ``BLOCK`` bytes is encoded on its own,
so that a long text, which explains itself, still leans on the dictionary from
end to end. All blocks of all texts are encoded.

Defined results: a null, empty or letterless text, and a tie, has no language
(margin 0). Rows are judged one by one, so repeated rows agree and an empty table
gives an empty one. Other columns are not looked at; a column named like a result
is replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of each language's dictionary: a fixed model size.
DICTIONARY = 1 << 16
#: Labelled documents per language that dictionaries are made of: the bound of the training sample.
SAMPLE = 64
#: Bytes encoded at a time.
BLOCK = 4096
#: The runner-up must be larger by this share of the smallest encoding.
MARGIN = 0.01

_DROP = bytes(i for i in range(128) if not (chr(i).isalpha() or chr(i) in " \t\n"))
_MAP = bytes(32 if i in (9, 10) else i for i in range(256))


def normalise(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_MAP, _DROP).split())


def encoder(content: bytes):
    import zstandard as zs

    p = zs.ZstdCompressionParameters(format=zs.FORMAT_ZSTD1_MAGICLESS, window_log=18, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=0, strategy=zs.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zs.ZstdCompressor(dict_data=d, compression_params=p)


def train(docs: DataFrame, id_col="doc_id", text_col="text", label_col="lang", sample=SAMPLE, size=DICTIONARY) -> dict[str, bytes]:
    """A dictionary per label from at most ``sample`` documents of it, those with the least hash of their id.

    Rows with a null id, text or label teach nothing. Of documents in one language's sample, the last fills the dictionary's front.
    """
    w = Window.partitionBy("lab").orderBy("h", "id")
    known = docs.select(F.col(id_col).alias("id"), F.col(label_col).alias("lab"), F.col(text_col).alias("t")).where("id is not null and lab is not null and t is not null")
    picked = known.select("id", "lab", F.xxhash64("id").alias("h")).distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= sample).select("id", "lab", "n")
    rows = known.join(F.broadcast(picked), ["id", "lab"]).select("lab", "n", "t").collect()  # picked: sample ids a label
    out: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r.lab, r.n, r.t)):
        if len(have := out.get(r.lab, b"")) < size:
            out[r.lab] = (have + b" " + normalise(r.t))[:size]
    return {k: v for k, v in out.items() if len(v) >= 8}


def classifier(model: dict[str, bytes], margin=MARGIN, block=BLOCK):
    """A column function: text -> struct<lang, nearest, margin, n_bytes>; lang is null where rejected."""
    names = sorted(model)

    def judge(texts):
        encoders = [encoder(model[x]).compress for x in names]
        for col in texts:
            out = []
            for t in col.to_pylist():
                b = normalise(t) if t else b""
                if not b or not names:
                    out.append((None, None, 0.0, len(b)))
                    continue
                parts = [b[i : i + block] for i in range(0, len(b), block)] if len(b) > block else [b]
                sizes = sorted((sum(len(e(p)) for p in parts), x) for e, x in zip(encoders, names))
                m = (sizes[1][0] - sizes[0][0]) / sizes[0][0] if len(sizes) > 1 else 1.0
                out.append((sizes[0][1] if m >= margin else None, sizes[0][1] if m else None, m, len(b)))
            lang, near, m, n = zip(*out) if out else ((), (), (), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(near, pa.string()), pa.array(m, pa.float64()), pa.array(n, pa.int64())], ["lang", "nearest", "margin", "n_bytes"])

    from collections.abc import Iterator

    judge.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(judge, "lang string, nearest string, margin double, n_bytes long")


def identify(docs: DataFrame, model: dict[str, bytes], id_col="doc_id", text_col="text", margin=MARGIN) -> DataFrame:
    """(id, detected_lang, nearest_lang, margin, n_bytes) for every row."""
    v = classifier(model, margin)
    return docs.select(F.col(id_col), v(F.col(text_col)).alias("_v")).select(id_col, F.col("_v.lang").alias("detected_lang"), F.col("_v.nearest").alias("nearest_lang"), F.col("_v.margin").alias("margin"), F.col("_v.n_bytes").alias("n_bytes"))


def keep_identified(docs: DataFrame, model: dict[str, bytes], text_col="text", margin=MARGIN) -> DataFrame:
    """The rows of ``docs`` whose text has a language; all their columns, unchanged."""
    return docs.where(classifier(model, margin)(F.col(text_col)).getField("lang").isNotNull())


def op8_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
