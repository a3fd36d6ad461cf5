"""BPE encoding and decoding of whole texts (operator 9).

``encode_decode`` keeps every row.  Null and empty texts have no ids and decode
to the empty text; null identifiers and repeated rows stay as they are; extra
columns are passed by unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import documents, light, prepare


def encode_decode(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ids (array<int>) and decoded (string) of each text."""
    prepare(docs.sparkSession)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, words = bpe.backtracking_encoder(vocabulary), bpe.vocabulary(vocabulary)
        for batch in batches:
            ids = [np.frombuffer(encoder.encode(t), encoder.dtype) for t in batch.column(len(keep)).to_pylist()]
            sizes = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, encoder.dtype)]).astype(np.int32)
            decoded = [words.decode(x).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.ListArray.from_arrays(sizes, flat), pa.array(decoded, pa.string())],
                names=[*keep, "ids", "decoded"],
            )

    return docs.select(*[F.col(f"`{c}`") for c in keep], "text").mapInArrow(light(run), f"{fields}, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, words = bpe.backtracking_encoder(vocabulary), bpe.vocabulary(vocabulary)
        decimal = words.decimal
        for batch in batches:
            n, by_ids, by_text = [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(encoder.encode(text), encoder.dtype)
                n.append(len(ids))
                by_ids.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                decoded = words.decode(ids).decode("utf-8", "replace")
                by_text.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        light(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import VOCABULARY

    return digests(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
