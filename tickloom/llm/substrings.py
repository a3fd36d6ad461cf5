"""Repeated byte strings by distributed bucket-pointer refinement (operator 8).

A byte goes if a ``LENGTH``-byte string that covers it also starts earlier
(smaller doc_id, or the same document and an earlier start).  All suffixes of a
corpus do not fit a shuffle, so the buckets are built where the texts are and
only bucket identifiers travel:

1. *q-gram buckets.*  Each position's ``Q``-gram has a 64-bit bucket identifier
   (a mixed polynomial hash).  The anchor of a window, that is of a
   ``LENGTH``-byte string, is its q-gram with the least identifier, leftmost
   of equals: equal windows have equal anchors at equal offsets.  Consecutive
   windows with one anchor form a run; the hash of a run's text is its context.
2. *First refinement.*  Runs are grouped by anchor, first inside a task, then
   over all tasks.  Runs with a context that was seen earlier go as a whole.  An
   anchor with one context is finished.  Runs of anchors with several contexts
   are refined further.  A task sends at most one record for each anchor it
   holds, so an anchor that a third of all rows share is a few records.
3. *Second refinement.*  The windows of those runs are sorted by the bucket
   identifiers at offsets 0, Q and LENGTH - Q, which together cover a window;
   the identifiers of step 1 are used again.  All but the earliest window of an
   equal set go.  Here too a task sends one record for each distinct window.
4. The removed windows of a document are joined to its text.

Buckets are 64-bit hashes; different strings share one with a probability of
n^2 / 2^65 for n windows that reach the same step.

Rows: null texts count as empty; texts of fewer than ``LENGTH`` bytes keep all
bytes; null doc_ids come after all others and rows of equal doc_id by their
place in the input.  Extra columns pass by; empty tables give no rows.
"""

from __future__ import annotations

import gc
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, light, partitions, prepare, store
from .exact import located, plain

#: Bytes of a repeated string and of a bucket's q-gram.
LENGTH, Q = 100, 40
#: Bytes that are hashed at once (longer texts in overlapping pieces).
BLOCK = 1 << 18
#: Records that a task groups before it sends them on.
FLUSH = 1 << 20

_U = np.uint64
_GOLD, _M1, _M2 = (_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.RandomState(11).randint(0, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_powers: list[np.ndarray] = []

#: What a task gives on, in blobs for a shard: records of keys (again is null),
#: or verdicts on documents, which are dealt by document.
MIXED = "shard int, again boolean, keys binary, tags binary, ords binary, starts binary, counts binary"
VERDICT = "shard int, again boolean, ords binary, starts binary, counts binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + (BLOCK >> 1))
        _powers[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(size, b)])) for b in (_GOLD, _INVERSE)]
    return _powers[0], _powers[1]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE[raw] * _power(len(raw))[0][: len(raw)], out=out[1:])
    return out


def buckets(prefix: np.ndarray) -> np.ndarray:
    """Bucket identifier of the q-gram at each position."""
    n = len(prefix) - Q
    return _mix((prefix[Q:] - prefix[:-Q]) * _power(n)[1][:n]) if n > 0 else np.zeros(0, _U)


def runs(raw: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor, context, first window and number of windows of each run.

    ``raw``: texts one after the other; ``doc``: each byte's text; ``ends``: where each text ends.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none.astype(_U), none.astype(_U), none, none
    prefix = prefix_hash(raw)
    bucket = buckets(prefix)
    low = _U((1 << 24) - 1)
    least = (bucket & ~low) | np.arange(len(bucket), dtype=_U)
    width, done = LENGTH - Q + 1, 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if width > done:
        least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
    at = np.arange(len(least))
    own = doc[: len(least)]
    valid = at + LENGTH <= ends[own]
    at, anchor, own = at[valid], (least[valid] & low).astype(np.int64), own[valid]
    if not len(at):
        return none.astype(_U), none.astype(_U), none, none
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    a, b = at[first], at[last]
    context = _mix((prefix[b + LENGTH] - prefix[a]) * _power(len(raw))[1][a] + (b - a).astype(_U) * _M2)
    return bucket[anchor[first]], context | _U(1), a, b - a + 1


def pieces(rows: Iterator[tuple[int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(ord, offset, bytes) in blocks; a long text in pieces that share LENGTH - 1 bytes."""
    block, size = [], 0
    for o, raw in rows:
        for at in range(0, max(1, len(raw) - LENGTH + 1), BLOCK):
            part = raw[at : at + BLOCK + LENGTH - 1]
            block.append((o, at, part))
            size += len(part)
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def grouped(columns: list[np.ndarray]):
    """Order key, tag, ord, start and n (the list is emptied); marks the first of each key and of each (key, tag)."""
    order = np.lexsort(columns[3::-1])
    for i in range(5):
        columns[i] = columns[i][order]
    key, tag, o, s, n = columns
    columns.clear()
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new_tag = new_key.copy()
    new_tag[1:] |= tag[1:] != tag[:-1]
    group = np.cumsum(new_key) - 1
    several = np.bincount(group, new_tag)[group] > 1 if len(key) else np.zeros(0, bool)
    return key, tag, o, s, n, new_key, new_tag, several


def _dealt(shard: np.ndarray, columns: list[np.ndarray], shards: int) -> Iterator[list]:
    """(shard, blob of each column) of the rows of every shard."""
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        i = order[bounds[k] : bounds[k + 1]]
        yield [k, *(c[i].tobytes() for c in columns)]


def _batches(rows: Iterator[list], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [c.split(" ") for c in schema.split(", ")]
    while held := list(itertools.islice(rows, 64)):
        columns = zip(*held, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def verdicts(o: np.ndarray, s: np.ndarray, n: np.ndarray, again: bool, shards: int) -> Iterator[list]:
    """Windows that go, or that are looked at again, in one row for each shard of documents."""
    shard = (_mix(o.astype(_U)) % _U(shards)).astype(np.int64)
    for k, *blobs in _dealt(shard, [o.astype("<i8"), s.astype("<u4"), n.astype("<u2")], shards):
        yield [k, again, *blobs]


def send(parts: list[tuple[np.ndarray, ...]], shards: int) -> Iterator[pa.RecordBatch]:
    """Group a task's records; give on local verdicts and one record for each key."""
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    parts.clear()
    key, tag, o, s, n, new_key, new_tag, several = grouped(columns)
    for mask, again in ((~new_tag, False), (new_tag & several, True)):
        yield from _batches(([k, a, None, None, *blobs] for k, a, *blobs in verdicts(o[mask], s[mask], n[mask], again, shards)), MIXED)
    tag = np.where(several, _U(0), tag)  # tag 0: the key has several tags, nothing of this task is open
    columns = [c[new_key] for c in (key, tag, o.astype("<i8"), s.astype("<u4"), n.astype("<u2"))]
    shard = (columns[0] >> _U(33)).astype(np.int64) % shards
    yield from _batches(([k, None, *blobs] for k, *blobs in _dealt(shard, columns, shards)), MIXED)


def receive(shards: int):
    """Holds the tasks' records against one another; passes their verdicts on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (_U, _U, "<i8", "<u4", "<u2")
        parts: list[tuple[np.ndarray, ...]] = []
        names = [c.split(" ")[0] for c in VERDICT.split(", ")]
        for batch in batches:
            done = batch.column(1).is_valid()
            rest = batch.filter(done)
            if rest.num_rows:
                yield pa.RecordBatch.from_arrays([*rest.columns[:2], *rest.columns[4:]], names=names)
            for row in zip(*(c.to_pylist() for c in batch.filter(pa.compute.invert(done)).columns[2:]), strict=True):
                parts.append(tuple(np.frombuffer(x, t) for x, t in zip(row, types, strict=True)))
        if not parts:
            return
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        parts.clear()
        key, tag, o, s, n, _, new_tag, several = grouped(columns)
        open_ = tag != 0
        for mask, again in ((~new_tag & open_, False), (new_tag & several & open_, True)):
            yield from _batches(verdicts(o[mask], s[mask], n[mask], again, shards), VERDICT)

    return run


def by_document(rows: DataFrame) -> DataFrame:
    """ord, s, n: one row for each document that the verdicts name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                parts.append(tuple(np.frombuffer(x, t) for x, t in zip(row, ("<i8", "<u4", "<u2"), strict=True)))
        if not parts:
            return
        o, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((s, o))
        o, s, n = o[order], s[order].astype(np.int32), n[order].astype(np.int32)
        new = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        bounds = np.append(new, len(o))
        for low in range(0, len(new), 1024):
            high = min(low + 1024, len(new))
            a, b = bounds[low], bounds[high]
            offsets = (bounds[low : high + 1] - a).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[a:b])) for x in (s, n)]
            yield pa.RecordBatch.from_arrays([pa.array(o[new[low:high]]), *lists], names=["ord", "s", "n"])

    return rows.repartitionById(partitions(rows.sparkSession), "shard").mapInArrow(light(run), "ord long, s array<int>, n array<int>")


def ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``whole`` (all columns) of the rows, with ``ord``, a number without repeats in the order of doc_id."""
    docs = plain(docs).select("doc_id", "text", F.struct("*").alias("whole"))
    ids = F.col("doc_id").cast("long")
    odd = docs.groupBy(ids.alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    if odd.isEmpty():
        return docs.select("*", ids.alias("ord"))
    rows = located(docs)
    places = rows.select(ids.isNull().alias("absent"), ids.alias("id"), "locator").orderBy("absent", "id", "locator")
    numbered = places.select("locator").rdd.zipWithIndex().map(lambda x: (x[0][0]["file"], x[0][0]["row"], x[1]))
    numbered = store(docs.sparkSession.createDataFrame(numbered, "file string, row long, ord long"), "order")
    numbered = numbered.select(F.struct("file", "row").alias("locator"), "ord")
    return rows.join(numbered, "locator").drop("locator")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of what is done."""
    gc.collect()
    spark._jvm.System.gc()


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def first_verdicts(rows: DataFrame) -> DataFrame:
    shards = partitions(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), strict=True)

        parts, size = [], 0
        for block in pieces(texts()):
            raw = np.frombuffer(b"".join(b for _, _, b in block), np.uint8)
            sizes = np.array([len(b) for _, _, b in block])
            ends = np.cumsum(sizes)
            doc = np.repeat(np.arange(len(block)), sizes)
            anchor, context, at, n = runs(raw, ends, doc)
            own = doc[at] if len(at) else at
            ords, offsets = np.array([o for o, _, _ in block]), np.array([x for _, x, _ in block])
            parts.append((anchor, context, ords[own], (at - (ends - sizes)[own] + offsets[own]).astype("<u4"), n.astype("<u2")))
            size += len(anchor)
            if size >= FLUSH:
                yield from send(parts, shards)
                size = 0
        if parts:
            yield from send(parts, shards)

    sent = rows.select("ord", "text").mapInArrow(light(run), MIXED)
    return store(sent.repartitionById(shards, "shard").mapInArrow(light(receive(shards)), VERDICT), "verdicts")


def second_verdicts(rows: DataFrame, verdict: DataFrame) -> DataFrame:
    shards = partitions(rows.sparkSession)
    look = by_document(verdict.where("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for o, raw, s, n in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, n = np.array(s, np.int64), np.array(n, np.int64)
                at = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                b = buckets(prefix_hash(np.frombuffer(raw, np.uint8)))
                key = _mix(_mix(b[at] * _GOLD + b[at + Q]) * _GOLD + b[at + LENGTH - Q])
                parts.append((key, np.ones(len(at), _U), np.full(len(at), o), at.astype("<u4"), np.ones(len(at), "<u2")))
                size += len(at)
                if size >= FLUSH:
                    yield from send(parts, shards)
                    size = 0
        if parts:
            yield from send(parts, shards)

    sent = rows.select("ord", "text").join(look, "ord").mapInArrow(light(run), MIXED)
    return store(sent.repartitionById(shards, "shard").mapInArrow(light(receive(shards)), VERDICT), "verdicts")


def removed_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes, first and last (byte spans that go) and kept (remaining bytes)."""
    spark = docs.sparkSession
    prepare(spark)
    rows = ordered(docs)
    one = first_verdicts(rows)
    release(spark)
    two = second_verdicts(rows, one)
    release(spark)
    gone = by_document(one.where("not again").unionByName(two))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, firsts, lasts, kept = [], [], [], []
            for raw, s, n in zip(_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                edge = np.zeros(len(raw) + 1, np.int64)
                if s is not None:
                    s = np.array(s, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + np.array(n) - 1 + LENGTH, -1)
                covered = np.cumsum(edge[:-1]) > 0
                change = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
                sizes.append(len(raw))
                firsts.append(np.flatnonzero(change == 1).tolist())
                lasts.append(np.flatnonzero(change == -1).tolist())
                kept.append(np.frombuffer(raw, np.uint8)[~covered].tobytes())
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[3:], pa.array(sizes, pa.int64()), pa.array(firsts, kind), pa.array(lasts, kind), pa.array(kept, pa.binary())],
                names=[*keep, "n_bytes", "first", "last", "kept"],
            )

    joined = rows.select("ord", "text", F.struct(*[F.col(f"whole.`{c}`") for c in keep]).alias("kept")).join(gone, "ord", "left")
    joined = joined.select("text", "s", "n", "kept.*")
    return joined.mapInArrow(light(run), f"{fields}, n_bytes long, first array<int>, last array<int>, kept binary")


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed_spans(documents(spark, sf_dir))
    size = F.aggregate(F.zip_with("first", "last", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("first").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
