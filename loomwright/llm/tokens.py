"""BPE encoding and decoding of documents with the tokenization automaton (operator 9)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import encoder_for
from .common import in_pieces, text_or_empty


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def texts_in(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def _encoded(texts: list[str], data: bytes):
    """Yields (begin, end, ids, offsets) for runs of the texts."""
    encoder, at = encoder_for(data), 0
    for n, ids, counts in encoder.encode(texts):
        yield at, at + n, ids, np.concatenate(([0], np.cumsum(counts)))
        at += n


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of each row's whole text; a null text counts as empty and has no ids. Row by row, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        for batch in batches:
            texts, out = texts_in(batch), []
            for _, _, ids, to in _encoded(texts, shared.value):
                out += [ids[a:b] for a, b in zip(to[:-1], to[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype(np.int32) for x in out], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(in_pieces(run), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that the labels of ``ids`` spell; bytes that are no UTF-8 become U+FFFD; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        for batch in batches:
            automaton = encoder_for(shared.value).automaton
            out = [automaton.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(in_pieces(run), "doc_id long, text string")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's whole text, encoded and decoded in one pass.

    Null and empty texts have no tokens; repeated rows give repeated results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        for batch in batches:
            texts, n, ids_hash, text_hash = texts_in(batch), [], [], []
            labels, label_at = encoder_for(shared.value).labels_table()
            sizes = np.diff(label_at)
            for _, _, ids, to in _encoded(texts, shared.value):
                raw = ids.astype("<u4").tobytes()
                size = sizes[ids]
                end = np.cumsum(size)
                total = int(end[-1]) if len(end) else 0
                spelled = labels[np.repeat(label_at[ids] - (end - size), size) + np.arange(total)].tobytes()
                byte_to = np.concatenate(([0], end))[to]
                for k in range(len(to) - 1):
                    n.append(int(to[k + 1] - to[k]))
                    ids_hash.append(hashlib.sha256(raw[4 * to[k] : 4 * to[k + 1]]).hexdigest())
                    text = spelled[byte_to[k] : byte_to[k + 1]].decode("utf-8", "replace")
                    text_hash.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(in_pieces(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
