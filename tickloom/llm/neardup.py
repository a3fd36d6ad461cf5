"""Near-duplicate documents by fast similarity sketching (operator 5).

*Sets.*  A document's set holds its distinct ``shingle``-word shingles (A-Z
lower-cased, words between ASCII white space) as 64-bit hashes; fewer words make
one shingle, no words the empty set, which is linked with nothing.

*Classes.*  Rows with equal sets form a class (equal by a 128-bit set hash); all
further work is on classes.  The class's 64-bit number is checked to be unique.

*Sketches.*  Round i hashes every element to a random bin and a value; a bin
keeps the least (round, value).  After as many rounds as there are bins, round
i fills bin i from all elements, so every coordinate of a non-empty set fills.
Rounds stop as soon as all bins are full.  Coordinates agree with the
probability of the Jaccard similarity and concentrate like independent ones.

*Bands.*  ``BANDS`` groups of ``ROWS`` coordinates are bucket keys.  A pair at
similarity 0.8 shares no bucket with probability (1 - 0.8^5)^40 = 1.3e-7.

*Links.*  Buckets are not expanded into pairs.  First each member is held against
the least leader (smallest class number) of its buckets; a leader's text is dealt
to one salt per ``CHUNK`` members.  Buckets whose members are still in several
components are then looked at as wholes: those that have most members in the same
component are one *group*, so a class is in few groups although it is in many
buckets.  A group is dealt to blocks of about ``BLOCK_CLASSES`` classes and
``BLOCK_SHINGLES`` shingles, and one task holds two blocks: for each member
outside the largest component it looks up the rarest fifth of the shingles (a
link shares one of them) in an inverted list and counts the exact intersection
with what it finds.  Only links that join two components leave the task.  All
pairs that share a bucket and are not in one component are tested; none is
dropped.  A group of g classes is g * g / ``BLOCK_CLASSES`` rows of texts, which is
g for a group within a block.
Every link is confirmed on the shingles themselves, not on their hashes.

*Components.*  Each node points to its least neighbour; edges are contracted to
the pointed nodes, again and again, until none is left.

Rows: null and empty texts, null doc_ids (after all others) and repeated rows
give a row each.  A component's kept row is the one with the smallest doc_id,
and of those the first by place in the input.  Extra columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, at_places, documents, light, partitions, prepare, store, without_places, write_sides
from .exact import located, plain

#: Bands and coordinates of a band.
BANDS, ROWS = 40, 5
#: Similarity of a link, in hundredths.
LEAST = 80
#: Members that share one copy of their leader's text.
CHUNK = 200
#: Classes and shingles of a block of a group.
BLOCK_CLASSES, BLOCK_SHINGLES = 2000, 1 << 20

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_GOLD, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _times(i: int) -> np.uint64:
    return np.uint64((i * int(_GOLD)) & int(_FULL))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    own = words(text)
    if not own:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    k = min(size, len(own))
    out = np.full(len(own) - k + 1, np.uint64(len(own) if k < size else 0))
    for j in range(k):
        out = _mix(out * _GOLD + hashes[j : len(own) - k + 1 + j])
    return np.unique(out)


def sketch(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Sketches of several non-empty sets at once: one row of ``bins`` values each."""
    n = len(sets)
    out = np.full(n * bins, _FULL)
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    for i in range(2 * bins):
        if not len(element):
            break
        x = _mix(element + _times(i + 1))
        place = (((x >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64) if i < bins else i - bins
        value = _mix(x ^ _M2) >> np.uint64(1)  # never the value of an empty bin
        fresh = np.full(n * bins, _FULL)
        np.minimum.at(fresh, owner * bins + place, value)
        empty = out == _FULL
        out[empty] = fresh[empty]
        open_ = (out == _FULL).reshape(n, bins).any(1)
        if not open_.all():
            keep = open_[owner]
            element, owner = element[keep], owner[keep]
    return out.reshape(n, bins)


def bands(sketches: np.ndarray, count: int, rows: int) -> np.ndarray:
    parts = sketches.reshape(len(sketches), count, rows)
    key = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64) * _M1, parts.shape[:2]).copy()
    for j in range(rows):
        key = _mix(key * _GOLD + parts[:, :, j])
    return key


def _set_hash(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """Order-free hash of each set (wrapping sums of mixed elements)."""
    return np.array([_mix(_mix(s + _times(seed)).sum(dtype=np.uint64)[None] + np.uint64(len(s)))[0] for s in sets], np.uint64)


def sketched(docs: DataFrame, shingle: int, seed: int, scratch: Scratch) -> DataFrame:
    """locator, doc_id, n (set size), cid and check (set hashes), bands of every row."""
    prepare(docs.sparkSession)
    rows = located(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("locator", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, shingle) for t in batch.column(2).to_pylist()]
            full = [s for s in sets if len(s)]
            keys = bands(sketch(full, BANDS * ROWS), BANDS, ROWS).astype(np.int64) if full else np.zeros((0, BANDS), np.int64)
            counts = np.array([BANDS if len(s) else 0 for s in sets])
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(_set_hash(sets, 2 * seed + 1).astype(np.int64)), pa.array(_set_hash(sets, 2 * seed + 2).astype(np.int64)),
                    pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1))),
                ],
                names=["locator", "doc_id", "n", "cid", "check", "bands"],
            )

    schema = "locator struct<file: string, row: bigint>, doc_id long, n long, cid long, `check` long, bands array<long>"
    return scratch.store(rows.mapInArrow(light(run), schema), "sketches")


def classes_of(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row a class: cid, its first row (absent, doc_id, locator), bands."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "locator", "bands")).alias("first")
    out = rows.where("n > 0").groupBy("cid").agg(first, F.min("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
    return scratch.store(out, "classes")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node -> root (the least node) of its component, for all nodes of ``edges`` (a, b)."""
    levels = []
    edges = scratch.store(edges.select("a", "b").where("a <> b"), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = scratch.store(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"), "pointers")
        levels.append(to)
        left = edges.join(to.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        right = left.join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = right.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = scratch.store(edges, "edges")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = levels[0]
    for to in levels[1:]:
        found = found.join(to.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
        found = found.select("node", F.coalesce("next", "root").alias("root"))
    return scratch.store(found, "components")


def full_set(text: str, size: int) -> set[bytes]:
    """A text's shingles as they are (words hold no spaces)."""
    own = words(text)
    k = min(size, len(own))
    return {b" ".join(own[i : i + k]) for i in range(len(own) - k + 1)}


def linked(one: set, other: set) -> bool:
    both = len(one & other)
    return 100 * both >= LEAST * (len(one) + len(other) - both)


def star_links(pairs: DataFrame, texts: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) among (leader, member) pairs."""
    count = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("salts"))
    leaders = scratch.store(count.join(texts.withColumnRenamed("cid", "leader"), "leader"), "leaders")
    members = pairs.join(leaders.select("leader", "salts"), "leader").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int"))
    members = members.drop("salts").join(texts.select(F.col("cid").alias("member"), "text"), "member")
    leaders = leaders.select("leader", F.col("text").alias("lead_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = members.join(leaders, ["leader", "salt"]).select("leader", "member", "lead_text", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, whole = None, None, None
        for batch in batches:
            good = []
            for leader, lead_text, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if leader != held:
                    held, own, whole = leader, shingles(lead_text, shingle), None
                other = shingles(text, shingle)
                same = len(np.intersect1d(own, other, assume_unique=True))
                near = 100 * same >= LEAST * (len(own) + len(other) - same)
                if near:
                    whole = full_set(lead_text, shingle) if whole is None else whole
                    near = linked(whole, full_set(text, shingle))
                good.append(near)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return scratch.store(rows.mapInArrow(light(run), "a long, b long"), "star-links")


def joining_links(texts: list[str], roots: list[int], blocks: list[int], shingle: int) -> list[tuple[int, int]]:
    """Links between components, as pairs of roots: enough of them to join all that links join.

    With members of two blocks, pairs inside one block are left to other tasks.
    """
    block = np.array(blocks)
    two = len(np.unique(block)) > 1
    names, comp = np.unique(np.array(roots, np.int64), return_inverse=True)
    if len(names) == 1:
        return []
    sets = [shingles(t, shingle) for t in texts]
    sizes = np.array([len(s) for s in sets])
    _, token, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    first = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(token, kind="stable")]
    posting = np.concatenate([[0], np.cumsum(freq)])
    largest = np.bincount(comp).argmax()
    mark = np.zeros(len(freq), np.int64)
    whole: dict[int, set] = {}
    out = []
    for x in np.flatnonzero(comp != largest).tolist():
        own = token[first[x] : first[x + 1]]
        need = -(-LEAST * len(own) // 100)
        rare = own[np.argsort(freq[own], kind="stable")[: len(own) - need + 1]]
        near = [owner[posting[t] : posting[t + 1]] for t in rare.tolist() if freq[t] > 1]
        if not near:
            continue
        near = np.unique(np.concatenate(near))
        near = near[(comp[near] != comp[x]) & (100 * np.minimum(sizes[near], len(own)) >= LEAST * np.maximum(sizes[near], len(own)))]
        if two:
            near = near[block[near] != block[x]]
        if not len(near):
            continue
        mark[own] = 1
        n = sizes[near]
        ends = np.cumsum(n)
        flat = token[np.repeat(first[near] - (ends - n), n) + np.arange(ends[-1])]
        both = np.add.reduceat(mark[flat], ends - n)
        mark[own] = 0
        for y in near[100 * both >= LEAST * (len(own) + n - both)].tolist():
            if comp[y] == comp[x]:
                continue
            for z in (x, y):
                if z not in whole:
                    whole[z] = full_set(texts[z], shingle)
            if linked(whole[x], whole[y]):
                out.append((roots[x], roots[y]))
                comp[comp == comp[y]] = comp[x]
        if len(whole) > 512:
            whole.clear()
    return out


def group_links(groups: DataFrame, texts: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """Links (a, b: roots) between components within groups (g, cid, root, n)."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    sizes = groups.groupBy("g").agg(blocks)
    rows = groups.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rows = rows.select("g", "cid", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "root", "cid")
    rows = rows.join(texts, "cid").select("g", "i", "j", "block", "root", "text")
    rows = rows.repartition(partitions(rows.sparkSession), "g", "i", "j").sortWithinPartitions("g", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(held):
            block, root, text = zip(*held, strict=True)
            found = joining_links(list(text), list(root), list(block), shingle)
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        at, held = None, []
        for batch in batches:
            for g, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, i, j) != at and held:
                    yield answer(held)
                    held = []
                at = (g, i, j)
                held.append(row)
        if held:
            yield answer(held)

    return scratch.store(rows.mapInArrow(light(run), "a long, b long"), "group-links")


def linked_classes(docs: DataFrame, classes: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """cid -> root, for classes that share a bucket with another."""
    members = classes.select("cid", "n", F.explode("first.bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("cid").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = scratch.store(members.join(buckets.select("key", "leader"), "key"), "placed")
    wanted = placed.groupBy("cid").agg(F.min("leader").alias("leader"))
    wanted = scratch.store(wanted, "wanted")
    sides = scratch.folder("candidate-places")
    write_sides(wanted.join(classes, "cid").select("first.locator.file", "first.locator.row", F.col("cid").alias("value")), sides)
    texts = scratch.store(at_places(docs.select("text"), sides, "cid"), "candidates")

    roots = components(star_links(wanted.where("leader <> cid").select("leader", F.col("cid").alias("member")), texts, shingle, scratch), scratch)
    named = placed.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = scratch.store(named.select("key", "cid", "n", "root"), "named")
    # A bucket in several components belongs to the group of the one that most of its members are in.
    share = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("members"))
    open_ = share.groupBy("key").agg(F.max(F.struct("members", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    groups = named.join(open_.select("key", F.col("most.root").alias("g")), "key").select("g", "cid", "root", "n").distinct()
    more = components(group_links(scratch.store(groups, "groups"), texts, shingle, scratch), scratch)
    known = wanted.select("cid").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    known = known.join(more.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
    return known.select("cid", F.coalesce("next", "root").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """locator, doc_id, n_shingles, component_id, kept of every row."""
    docs = plain(docs.select("doc_id", "text"))
    with Scratch(docs.sparkSession) as scratch:
        return _near_duplicates(docs, shingle, scratch)


def _near_duplicates(docs: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    for seed in range(8):
        rows = sketched(docs, shingle, seed, scratch)
        classes = classes_of(rows, scratch)
        if classes.where("low <> high").isEmpty():
            break
    else:
        raise RuntimeError("set hashes collide under every seed")
    roots = linked_classes(docs, classes, shingle, scratch)
    named = classes.select("cid", "first.absent", "first.doc_id", "first.locator").join(roots, "cid", "left")
    named = scratch.store(named.withColumn("root", F.coalesce("root", "cid")), "rooted")
    keep = named.groupBy("root").agg(F.min(F.struct("absent", "doc_id", "locator")).alias("keep"))
    named = scratch.store(named.select("cid", "root").join(keep, "root").select("cid", "keep"), "kept")
    some = rows.where("n > 0").select("locator", "doc_id", "n", "cid").join(named, "cid").select(
        "locator", "doc_id", F.col("n").alias("n_shingles"), F.col("keep.doc_id").alias("component_id"),
        (F.col("locator") == F.col("keep.locator")).alias("kept"),
    )
    none = rows.where("n = 0").select("locator", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return store(some.unionByName(none), "near-duplicates")


def without_near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, all their columns.

    Rows without words stay.  The decisions go to the rows in side files, so
    texts are not shuffled for them; the files stay until the session's end.
    """
    docs = plain(docs)
    gone = near_duplicates(docs, shingle).where("not kept")
    return without_places(docs, gone.select("locator.file", "locator.row"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=2).select("doc_id", "n_shingles", "component_id", "kept")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) = 1 THEN [w[1]]
         ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w
), e AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s
), c AS (
  SELECT g, count(*) AS f FROM e GROUP BY g
), r AS (
  -- Prefix filter: of two sets with similarity 0.8 the rarest fifths share an element.
  SELECT e.doc_id, e.n, e.g, row_number() OVER (PARTITION BY e.doc_id ORDER BY c.f, e.g) AS k FROM e JOIN c USING (g)
), pre AS (
  SELECT doc_id, n, g FROM r WHERE k <= n - CAST(ceil(n * 8 / 10.0) AS BIGINT) + 1
), cand AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb
  FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), link AS (
  SELECT a, b FROM (
    SELECT cand.a, cand.b, cand.na, cand.nb, len(list_intersect(x.g, y.g)) AS i
    FROM cand JOIN s x ON x.doc_id = cand.a JOIN s y ON y.doc_id = cand.b)
  WHERE 100 * i >= 80 * (na + nb - i)
), reach AS (
  SELECT doc_id AS a, doc_id AS c FROM s
  UNION
  SELECT l.t, reach.c FROM reach JOIN (SELECT a AS f, b AS t FROM link UNION ALL SELECT b, a FROM link) l ON l.f = reach.a
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = s.doc_id AS kept
FROM s JOIN (SELECT a, min(c) AS c FROM reach GROUP BY a) m ON m.a = s.doc_id
"""
