"""Operator 4: byte-pair encoding and decoding of whole documents.

``encode_documents`` adds nothing and drops nothing: one row per input row, the
ids of the whole text and the text decoded from those ids.  A null or empty
text has no ids and decodes to the empty string; repeated rows give repeated
rows; an empty table gives no rows; columns other than the two named are ignored;
ids are integers.  The ids are those of the tokenizers library for the same file, special strings
in the text becoming special ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_maps import map_texts
from .encoder import blocks, encoder


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` array<int>, ``decoded`` string."""
    key = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        enc = encoder(vocab_path)
        ids = [x for s, e in blocks(texts) for x in enc.encode(texts[s:e])]
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<i4")
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), flat)
        decoded = [enc.bpe.decode(np.frombuffer(x, "<i4")).decode("utf-8", "replace") for x in ids]
        return {"doc_id": batch.column("doc_id"), "ids": lists, "decoded": pa.array(decoded, pa.string())}

    return map_texts(key, "_text", "doc_id long, ids array<int>, decoded string", work).withColumnRenamed("doc_id", id_col)


def digest_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, with digests in place of the ids and the text, so that neither leaves the worker.

    ``id_col``, ``n_tokens`` long, ``ids_sha256`` (ids as little-endian unsigned
    32-bit integers), ``decoded_sha256`` (UTF-8), both lowercase hex.
    """
    key = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        enc = encoder(vocab_path)
        count, ids_hex, text_hex = [], [], []
        for s, e in blocks(texts):
            for ids in enc.encode(texts[s:e]):
                count.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(enc.bpe.decode(np.frombuffer(ids, "<i4"))).hexdigest())
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": pa.array(count, pa.int64()),
            "ids_sha256": pa.array(ids_hex, pa.string()),
            "decoded_sha256": pa.array(text_hex, pa.string()),
        }

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(key, "_text", schema, work).withColumnRenamed("doc_id", id_col)
