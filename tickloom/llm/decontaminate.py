"""Benchmark decontamination by a distributed positional inverted index (operator 1).

*Index.*  Each task turns its documents into segments of up to ``SEGMENT_WORDS``
words (a longer document is a segment of its own).  A segment holds its sorted
terms, for each term the ascending positions of its postings, and the documents'
identifiers and first positions.  One position between documents stays free, so
no phrase crosses documents.  Segments are rows of a Parquet table in the shared
folder: the index is sharded by document, so a term that a third of all rows
hold is spread over all segments and nothing is shuffled.

*Search.*  Queries go to all segments in blocks of at most ``BLOCK_BYTES`` of
query text.  In a segment a phrase starts from its rarest term's list, moved
back by the term's offset, and is intersected with the other offset-adjusted
lists from rare to frequent, until it is empty; windows with a term that the
segment lacks are ruled out together beforehand.  Proximity search
(``match_near``) starts from the rarest term, rules out what has another term too
far away, and gives the spans of ``slop`` words of a document that hold all terms.

Words: A-Z lower-cased, runs of ASCII letters and digits and of all characters
beyond ASCII.  A window is ``window`` consecutive words of an item; a shorter
item that has words is one window.

Rows: null texts have no words; every document row gives one result row
(repeated and null doc_ids too); rows of items with null item_id mark words but
are not counted or listed; repeated item_ids count once.  Empty tables work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, light, prepare, store, table, without_places
from .exact import located, plain

#: Words of a segment.
SEGMENT_WORDS = 1 << 18
#: Query text that one pass over the index takes.
BLOCK_BYTES = 16 << 20

# Byte table: A-Z to lower case, other bytes that are no word characters to a space.
_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Words of a text, as UTF-8."""
    return text.encode().translate(_BYTES).split() if text else []


class Numbers(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


INDEX = "segment string, doc_ids binary, doc_nulls binary, starts binary, terms binary, offsets binary, positions binary"


def build_index(docs: DataFrame, name: str = "postings") -> DataFrame:
    """Segments of the index, stored in the shared folder."""
    prepare(docs.sparkSession)

    def segment(name: str, ids: list[int | None], texts: list[np.ndarray], number: Numbers) -> pa.RecordBatch:
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=starts[1:])  # one free position
        coded = np.concatenate(texts)
        position = np.arange(len(coded)) + np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        ordered = sorted(number)
        rank = np.empty(len(ordered), np.int32)
        rank[np.fromiter(map(number.__getitem__, ordered), np.int32, len(ordered))] = np.arange(len(ordered))
        coded = rank[coded]
        order = np.argsort(coded, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(coded, minlength=len(ordered)))])
        columns = [
            np.asarray([i or 0 for i in ids], "<i8"), np.asarray([i is None for i in ids], "u1"), starts.astype("<i8"),
            b"\n".join(ordered), offsets.astype("<u4"), position[order].astype("<u4"),
        ]
        blobs = [pa.array([c if isinstance(c, bytes) else c.tobytes()], pa.binary()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([name]), *blobs], names=[c.split()[0] for c in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[np.ndarray] = []
        number = Numbers()
        size, n, part = 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words(text)
                if size and size + len(own) > SEGMENT_WORDS:
                    yield segment(f"{part}-{n}", ids, texts, number)
                    ids, texts, number, size, n = [], [], Numbers(), 0, n + 1
                ids.append(doc)
                texts.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
                size += len(own) + 1
        if ids:
            yield segment(f"{part}-{n}", ids, texts, number)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return store(rows.mapInArrow(light(run), INDEX), name)


class Segment:
    """A segment's postings and the searches over them."""

    def __init__(self, name, doc_ids, doc_nulls, starts, terms, offsets, positions):
        self.name = name
        self.doc_ids, self.doc_nulls = np.frombuffer(doc_ids, "<i8"), np.frombuffer(doc_nulls, "u1")
        self.starts = np.frombuffer(starts, "<i8")
        self.offsets, self.positions = np.frombuffer(offsets, "<u4"), np.frombuffer(positions, "<u4")
        listed = terms.split(b"\n") if terms else []
        self.number = dict(zip(listed, range(len(listed)), strict=True))

    def postings(self, term: bytes) -> np.ndarray:
        i = self.number.get(term)
        return self.positions[:0] if i is None else self.positions[self.offsets[i] : self.offsets[i + 1]]

    def phrase(self, terms: list[bytes]) -> np.ndarray:
        """Positions at which the terms follow one another."""
        lists = []
        for offset, term in enumerate(terms):
            i = self.number.get(term)
            if i is None:
                return self.positions[:0]
            lists.append((int(self.offsets[i + 1] - self.offsets[i]), i, offset))
        lists.sort()
        found = None
        for _, i, offset in lists:
            own = self.positions[self.offsets[i] : self.offsets[i + 1]]
            if found is None:
                found = own[own >= offset].astype(np.int64) - offset
            else:
                at = np.searchsorted(own, found + offset)
                at[at == len(own)] = 0
                found = found[own[at] == found + offset]
            if not len(found):
                break
        return found

    def near(self, terms: list[bytes], slop: int) -> np.ndarray:
        """Where, at one of the terms, ``slop`` words of one document begin that hold all of them."""
        lists = sorted((self.postings(t) for t in set(terms)), key=len)
        if not lists or not len(lists[0]):
            return self.positions[:0]
        rare = lists[0].astype(np.int64)
        for own in lists[1:]:  # each other term no farther than a span on either side
            at = np.searchsorted(own, rare - slop + 1)
            ok = at < len(own)
            ok[ok] = own[at[ok]] < rare[ok] + slop
            rare = rare[ok]
        spans = np.unique((rare[:, None] - np.arange(slop)).ravel())
        doc = np.searchsorted(self.starts, spans, "right") - 1
        end = np.minimum(spans + slop, self.starts[np.minimum(doc + 1, len(self.starts) - 1)] - 1)
        begins = np.zeros(len(spans), bool)
        keep = spans >= 0
        for own in lists:
            at = np.searchsorted(own, spans)
            ok = at < len(own)
            ok[ok] = own[at[ok]] < end[ok]
            keep &= ok
            begins[ok] |= own[at[ok]] == spans[ok]
        return spans[keep & begins]


def blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The query set in blocks of at most BLOCK_BYTES of text."""
    block, size = [], 0
    for item, text in items.select("item_id", "text").where("text is not null").toLocalIterator():
        if block and size + len(text) * 4 > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text) * 4
    if block:
        yield block


MATCHES = "segment string, ordinal long, doc_id long, n_words long, first array<int>, last array<int>, items array<long>"


def match_items(index: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """For every document: merged hit spans (word positions, ends exclusive) and items found."""
    spark = index.sparkSession

    def search(block: list[tuple[int | None, str]], whole: bool) -> DataFrame:
        held = spark.sparkContext.broadcast(block)  # at most BLOCK_BYTES of text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = Asked(held.value, window)
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield answer(Segment(*row), asked, whole)

        return index.mapInArrow(light(run), MATCHES)

    found = [search(b, i == 0) for i, b in enumerate(blocks(items))] or [search([], True)]
    return found[0] if len(found) == 1 else merge(found)


class Asked:
    """The distinct windows of a block of items, by the numbers of their terms."""

    def __init__(self, block: list[tuple[int | None, str]], window: int):
        number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in block:
            own = [number.setdefault(w, len(number)) for w in words(text)]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[i : i + window]), set()).add(item)
        self.terms, self.owners = list(number), list(found.values())
        by: dict[int, list[int]] = {}
        windows = list(found)
        for i, w in enumerate(windows):
            by.setdefault(len(w), []).append(i)
        self.by_size = [(np.array(at), np.array([windows[i] for i in at], np.int32)) for at in by.values()]

    def possible(self, segment: Segment) -> Iterator[tuple[list[bytes], set]]:
        """Windows all of whose terms the segment holds, and whose they are."""
        held = np.fromiter(map(segment.number.__contains__, self.terms), bool, len(self.terms))
        for at, numbers in self.by_size:
            ok = np.flatnonzero(held[numbers].all(1))
            for i, own in zip(at[ok].tolist(), numbers[ok].tolist(), strict=True):
                yield [self.terms[k] for k in own], self.owners[i]


def answer(segment: Segment, asked: Asked, whole: bool) -> pa.RecordBatch:
    """A segment's documents (``whole``: all, else those with hits) with their hits."""
    n = len(segment.doc_ids)
    hit = np.zeros(segment.starts[-1] + 1, np.int32)
    items: list[set] = [set() for _ in range(n)]
    for terms, owners in asked.possible(segment):
        found = segment.phrase(terms)
        if len(found):
            np.add.at(hit, found, 1)
            np.add.at(hit, found + len(terms), -1)
            for d in np.unique(np.searchsorted(segment.starts, found, "right") - 1).tolist():
                items[d] |= owners
    edge = np.diff(np.concatenate([[0], (np.cumsum(hit) > 0).astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(segment.starts, first, "right") - 1
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)
    base = segment.starts[doc]
    listed = [sorted(x for x in s if x is not None) for s in items]
    out = pa.RecordBatch.from_arrays(
        [
            pa.array([segment.name] * n, pa.string()), pa.array(np.arange(n), pa.int64()),
            pa.array(segment.doc_ids, pa.int64(), mask=segment.doc_nulls.astype(bool)), pa.array(np.diff(segment.starts) - 1, pa.int64()),
            pa.ListArray.from_arrays(bounds, pa.array((first - base).astype(np.int32))),
            pa.ListArray.from_arrays(bounds, pa.array((last - base).astype(np.int32))), pa.array(listed, pa.list_(pa.int64())),
        ],
        names=[c.split()[0] for c in MATCHES.split(", ")],
    )
    return out if whole else out.filter(pa.array(np.diff(bounds) > 0))


def merge(found: list[DataFrame]) -> DataFrame:
    """Several blocks' answers as one: spans joined where they meet or overlap."""
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    rows = rows.groupBy("segment", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("first", "last")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = F.expr("""
        aggregate(spans, cast(array() as array<struct<first: int, last: int>>), (done, x) ->
          CASE WHEN size(done) > 0 AND x.first <= element_at(done, -1).last
          THEN concat(slice(done, 1, size(done) - 1), array(named_struct(
            'first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, x.last))))
          ELSE concat(done, array(x)) END)""")
    rows = rows.withColumn("spans", joined)
    return rows.select("segment", "ordinal", "doc_id", "n_words", F.col("spans.first").alias("first"), F.col("spans.last").alias("last"), "items")


NEAR = "segment string, ordinal long, doc_id long, item_id long, positions array<int>"


def match_near(index: DataFrame, items: DataFrame, slop: int = 20) -> DataFrame:
    """Proximity matches: documents and items all of whose distinct words stand within ``slop`` words.

    ``positions``: the words of the document at which such a span begins (with
    one of the item's words).  Items without words match nothing; each row of
    ``items`` answers for itself.
    """
    spark = index.sparkSession

    def search(block: list[tuple[int | None, str]]) -> DataFrame:
        held = spark.sparkContext.broadcast(block)  # at most BLOCK_BYTES of text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = [(item, list(dict.fromkeys(words(text)))) for item, text in held.value]
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    segment, out = Segment(*row), []
                    for item, terms in asked:
                        found = segment.near(terms, slop) if terms and all(t in segment.number for t in terms) else ()
                        if not len(found):
                            continue
                        doc = np.searchsorted(segment.starts, found, "right") - 1
                        for d in np.unique(doc).tolist():
                            own = None if segment.doc_nulls[d] else int(segment.doc_ids[d])
                            out.append((segment.name, d, own, item, (found[doc == d] - segment.starts[d]).tolist()))
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                    columns = zip(*out, strict=True) if out else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in NEAR.split(", ")])

        return index.mapInArrow(light(run), NEAR)

    rows = None
    for found in [search(b) for b in blocks(items)] or [search([])]:
        rows = found if rows is None else rows.unionByName(found)
    return rows


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans and items of each document."""
    found = match_items(build_index(docs), items, window)
    size = F.aggregate(F.zip_with("first", "last", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    listed = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", size.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (size > 0).alias("contaminated"),
        F.arrays_zip("first", "last").alias("spans"), "items",
    )


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` without a hit, all their columns.

    The index holds each row's place in the input instead of its doc_id, so
    repeated and null doc_ids are told apart.
    """
    docs = plain(docs)
    place = F.xxhash64("locator")
    hit = match_items(build_index(located(docs.select("text")).select(place.alias("doc_id"), "text")), items, window)
    hit = hit.where(F.size("first") > 0).select("doc_id").distinct()
    gone = located(docs.select("text")).select("locator", place.alias("doc_id")).join(hit, "doc_id")
    return without_places(docs, gone.select("locator.file", "locator.row"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.drop("spans", "items")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), q AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM q
), p AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), sizes
  WHERE i + n - 1 <= len(w)
), m AS (
  SELECT p.doc_id, p.i, p.n, q.item_id FROM p JOIN q ON p.win = q.win AND p.n = q.n
), h AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id
), x AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(x.n_items, 0) AS n_items,
       sha256(coalesce(x.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)
"""
