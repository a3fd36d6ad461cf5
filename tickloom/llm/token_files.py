"""Token ids as flat binary files (operator 2).

Layout of a written folder:

* ``ids-NNNNN.bin``: the part's token ids, flat little-endian unsigned integers
  (16 bits if every id of the vocabulary fits, else 32), an end id after each
  document;
* ``len-NNNNN.bin``: 64-bit lengths, one for each document (with the end id),
  followed by the 64-bit doc_ids and one byte each that marks a null doc_id;
* ``off-NNNNN.bin``: 64-bit offsets of the documents over *all* parts, one more
  than there are documents.  A part's base is the prefix sum of the sizes of
  the parts before it.

Parts are in ascending doc_id order (nulls first; repeated ids keep all rows).
Null and empty texts are documents of the end id alone.  Files are written
under a name of their own and moved, so that a task may run twice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import documents, memory_map, new_folder, partitions, prepare, publish

#: Bytes of ids that a writing task holds before it hands them to the file.
BUFFER = 8 << 20


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> list[tuple[int, int, int, int]]:
    """Write the files; returns (part, base, tokens, documents) of each part."""
    spark = docs.sparkSession
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.library_encoder(vocabulary)
        part, end = TaskContext.get().partitionId(), np.asarray([end_id], encoder.dtype).tobytes()
        width, names, lengths = encoder.dtype.itemsize, [], []

        def ids(out) -> None:
            held, size = [], 0
            for batch in batches:
                names.append(batch.column(0))
                for text in batch.column(1).to_pylist():
                    one = encoder.encode(text) + end
                    lengths.append(len(one) // width)
                    held.append(one)
                    size += len(one)
                    if size >= BUFFER:
                        out.write(b"".join(held))
                        held, size = [], 0
            out.write(b"".join(held))

        def sizes(out) -> None:
            own = pa.chunked_array(names, pa.int64()).combine_chunks()
            out.write(np.asarray(lengths, "<i8").tobytes())
            out.write(np.asarray(own.fill_null(0), "<i8").tobytes())
            out.write(np.asarray(own.is_null(), "u1").tobytes())

        first = next(batches, None)
        if first is None:
            return
        batches = _chain(first, batches)
        publish(folder, f"ids-{part:05d}.bin", ids)
        publish(folder, f"len-{part:05d}.bin", sizes)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part]), "tokens": pa.array([sum(lengths)]), "docs": pa.array([len(lengths)])})

    parts = partitions(spark)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = ordered.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    done = ordered.mapInArrow(run, "part long, tokens long, docs long").collect()  # one row a file
    base, out = 0, []
    for part, tokens, n in sorted(map(tuple, done)):
        out.append((part, base, tokens, n))
        base += tokens
    return out


def _chain(first, rest):
    yield first
    yield from rest


def read_token_files(spark: SparkSession, folder: str, parts: list[tuple[int, int, int, int]], vocabulary: str) -> DataFrame:
    """Map the files: doc_id, start, n_tokens, ids_crc32 of every document.

    Writes each part's 64-bit offset file from its base on the way, then reads
    ids through it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype("<u2" if bpe.vocabulary_size(vocabulary) <= 1 << 16 else "<u4")
        for batch in batches:
            for part, base, _, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes = memory_map(folder, f"len-{part:05d}.bin")
                lengths = np.frombuffer(sizes, "<i8", n)
                names = np.frombuffer(sizes, "<i8", n, 8 * n)
                missing = np.frombuffer(sizes, "u1", n, 16 * n).astype(bool)
                offsets = np.concatenate([[base], base + np.cumsum(lengths)]).astype("<i8")
                publish(folder, f"off-{part:05d}.bin", lambda out, x=offsets: out.write(x.tobytes()))
                offsets = np.frombuffer(memory_map(folder, f"off-{part:05d}.bin"), "<i8")
                ids = np.frombuffer(memory_map(folder, f"ids-{part:05d}.bin"), dtype)
                crc = [zlib.crc32(ids[a - base : b - base].astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64(), mask=missing), pa.array(offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    schema = "part long, base long, tokens long, docs long"
    listed = spark.createDataFrame(parts, schema)
    listed = listed.repartitionByRange(max(1, len(parts)), "part")
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import VOCABULARY

    path, folder = public_tokenizers.path(VOCABULARY), new_folder(spark, "token-files")
    parts = write_token_files(documents(spark, sf_dir), folder, path, end_id=2)
    return read_token_files(spark, folder, parts, path)
