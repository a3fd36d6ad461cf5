"""Quality by an interpolated modified Kneser-Ney model (operator 6).

The model predicts a text's UTF-8 bytes from the ``ORDER - 1`` bytes before
them.  It is trained on trusted text: the documents that ``labels`` marks with
quality 1, but for one fold in ``FOLDS`` (by a hash of doc_id), which sets the
thresholds.  n-grams are counted inside the tasks first, then over all; a gram is
its bytes as one number, so no two grams are confused.

*Model.*  Lower orders have continuation counts (in how many ways a gram goes on
to the left); grams at the start of a text have raw counts, as nothing precedes
them.  Discounts are the modified Kneser-Ney ones (D1, D2, D3+ of each order
from its counts of counts).  The lowest order is interpolated with the uniform
model.  Context totals and the lower order's probability meet in joins on
context and suffix.

*Scores.*  Documents fall into blocks of about ``BLOCK_ROWS`` rows (chunks of files,
dealt by hash).  A task sends the distinct grams of its part of a block, not one
row a position; most grams of a large block are the same ones again.  The
grams of all blocks meet the counts in joins sharded by gram, order by order
(an unseen gram takes the weight of its context times its suffix), and each
block's log-probabilities come back as files in the shared folder.  A second
reading of the texts adds them up.  Neither the model nor the texts' grams are
ever in one place, and texts are not shuffled.

*Thresholds.*  A document is kept if its perplexity, exp(-log-likelihood /
bytes), is within the ``QUANTILE`` of those of held-out trusted documents in its
language, however few they are (of all held-out ones where the language has none).

Rows: null and empty texts have perplexity 1 and are kept; null doc_ids are never
trusted; repeated rows are scored each; a null language is a language of its own.
Without trusted text the model is uniform; without held-out text everything is
kept.  Very long texts go through in pieces of ``PIECE`` bytes.  Empty tables
give no rows; extra columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Sides, at_places, documents, filesystem, open_input, partitions, prepare, publish, run_through, store, table, write_sides
from .exact import plain

#: Bytes of an n-gram (at most 7: a gram is a long).
ORDER = 6
#: Quantile of held-out trusted documents' perplexity that is still kept.
QUANTILE = 0.995
#: One of so many parts of the trusted documents is held out.
FOLDS = 5
#: Rows whose grams are looked up together, and rows of a file that stay together.
BLOCK_ROWS, CHUNK_ROWS = 1 << 20, 1 << 17
#: Files of a block, by the low bits of a gram (a power of two).
BLOCK_FILES = 64
#: Bytes that a task turns into grams at once.
PIECE = 1 << 19
#: Grams that a task holds before it sends them on, so that two tasks fit beside an executor's heap.
HELD = 3 << 20
#: Languages whose thresholds may be broadcast.
SMALL = 10_000


def grams(raws: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte's gram of full order (texts begin after zero bytes), and its text."""
    pad = b"\0" * (order - 1)
    flat = np.frombuffer(b"".join(pad + r for r in raws), np.uint8).astype(np.int64)
    gram = np.zeros(max(0, len(flat) - order + 1), np.int64)
    for j in range(order):
        gram = (gram << 8) | flat[j : len(gram) + j]
    sizes = np.array([len(r) for r in raws], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + order - 1)[:-1]]).astype(np.int64)
    own = np.repeat(np.arange(len(raws)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
    return gram[at], own


def pieces(raw: bytes, order: int) -> Iterator[tuple[bytes, int]]:
    """A text in pieces of PIECE bytes, each after the ``order - 1`` bytes before it; their number goes along."""
    for at in range(0, max(1, len(raw)), PIECE):
        low = max(0, at - order + 1)
        yield raw[low : at + PIECE], at - low


def text_grams(raws: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams of the texts, and whose they are, for at most about PIECE bytes at a time."""
    held, size = [], 0
    for i, raw in enumerate(raws):
        if len(raw) <= PIECE:
            held.append((i, raw))
            size += len(raw)
            if size >= PIECE:
                gram, own = grams([r for _, r in held], order)
                yield gram, np.array([j for j, _ in held])[own]
                held, size = [], 0
            continue
        for part, known in pieces(raw, order):
            gram, own = grams([part], order)
            yield gram[known:], np.full(len(gram) - known, i)
    if size:
        gram, own = grams([r for _, r in held], order)
        yield gram, np.array([j for j, _ in held])[own]


def _raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def held_out(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FOLDS)) == 0


class Counter:
    """Distinct numbers with counts, merged now and then."""

    def __init__(self):
        self.parts, self.size, self.merged = [], 0, 0

    def add(self, gram: np.ndarray, count: np.ndarray | None = None) -> None:
        if count is None:
            gram, count = np.unique(gram, return_counts=True)
        self.parts.append((gram, count))
        self.size += len(gram)
        if self.size > 2 * self.merged + (1 << 20):
            self.result()

    def full(self) -> bool:
        """Whether there are many grams although equal ones are merged."""
        if self.size > HELD:
            self.result()
        return self.size > HELD // 2

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            gram, count = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            gram, at = np.unique(gram, return_inverse=True)
            self.parts = [(gram, np.bincount(at, count, len(gram)).astype(np.int64))]
        self.size = self.merged = sum(len(g) for g, _ in self.parts)
        return self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, c: counts of full order over all texts."""
    prepare(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            for gram, _ in text_grams(_raw(batch.column(0)), order):
                counter.add(gram)
            if counter.full():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in counter.result()], names=["gram", "c"])
                counter = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in counter.result()], names=["gram", "c"])

    return texts.select("text").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(n: dict[int, int]) -> list[float]:
    """D1, D2, D3+ from the numbers of grams that were counted once, twice, ..."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    cut = [1 - 2 * y * n2 / n1 if n1 else 0.0, 2 - 3 * y * n3 / n2 if n2 else 0.0, 3 - 4 * y * n4 / n3 if n3 else 0.0]
    return [float(min(max(d, 0.1), i - 0.1)) for i, d in zip((1, 2, 3), cut, strict=True)]


def low_bytes(gram: str, k: int) -> Column:
    return F.col(gram).bitwiseAND((1 << 8 * k) - 1)


def merge(df: DataFrame) -> DataFrame:
    """Joined by a shuffle at every size: the model grows with the corpus."""
    return df.hint("merge")


def fit(counted: DataFrame, scratch: Scratch, order: int = ORDER) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each order the grams' probabilities (gram, p) and the contexts' weights of the lower order (context, weight)."""
    counts = {order: scratch.store(counted, "grams")}
    for k in range(order - 1, 0, -1):
        ways = F.when(F.shiftright(low_bytes("gram", k), 8 * (k - 1)) == 0, F.sum("c")).otherwise(F.count(F.lit(1)))
        counts[k] = scratch.store(counts[k + 1].groupBy(low_bytes("gram", k).alias("gram")).agg(ways.alias("c")), "grams")
    out, lower = {}, None
    for k in range(1, order + 1):
        rows = counts[k]
        cut = discounts({r["c"]: r["count"] for r in rows.where("c <= 4").groupBy("c").count().collect()})  # at most four rows
        d = F.when(F.col("c") == 1, cut[0]).when(F.col("c") == 2, cut[1]).otherwise(cut[2])
        rows = rows.select("gram", "c", d.alias("d"), F.shiftright("gram", 8).alias("context"))
        contexts = rows.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("weight"))
        contexts = scratch.store(contexts, "contexts")
        rows = rows.join(merge(contexts), "context")
        if lower is None:
            rows = rows.withColumn("low", F.lit(1 / 256))
        else:
            rows = rows.withColumn("suffix", low_bytes("gram", k - 1)).join(merge(lower), "suffix")
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("weight") * F.col("low")
        rows = scratch.store(rows.select("gram", p.alias("p")), "model")
        lower = rows.select(F.col("gram").alias("suffix"), F.col("p").alias("low"))
        out[k] = (rows, contexts.select("context", "weight"))
    return out


def probabilities(wanted: DataFrame, model: dict, scratch: Scratch, order: int = ORDER) -> DataFrame:
    """gram, p of distinct grams."""
    known, weights = model[order]
    met = wanted.join(merge(known), "gram", "left")
    if order == 1:
        return met.join(merge(weights.where("context = 0").select(F.col("weight"))).withColumn("one", F.lit(0)), F.lit(0) == F.col("one"), "left").select(
            "gram", F.coalesce("p", F.coalesce("weight", F.lit(1.0)) / 256).alias("p")
        )
    met = scratch.store(met, "met")
    rest = met.where("p is null").select("gram", F.shiftright("gram", 8).alias("context"), low_bytes("gram", order - 1).alias("suffix"))
    rest = scratch.store(rest.join(merge(weights), "context", "left").select("gram", "suffix", F.coalesce("weight", F.lit(1.0)).alias("weight")), "unseen")
    lower = probabilities(rest.select(F.col("suffix").alias("gram")).distinct(), model, scratch, order - 1)
    lower = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("low"))
    rest = rest.join(merge(lower), "suffix").select("gram", (F.col("weight") * F.col("low")).alias("p"))
    return scratch.store(met.where("p is not null").unionByName(rest), "probabilities")


def _places(docs: DataFrame, blocks: int, *columns: str) -> DataFrame:
    """file, row, name (of the block) and columns of every row."""
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    name = F.pmod(F.xxhash64(file, F.floor(row / CHUNK_ROWS).cast("long")), F.lit(blocks)).cast("long")
    return docs.select(file.alias("file"), row.alias("row"), name.alias("name"), *[F.col(f"`{c}`") for c in columns])


def _stretches(names: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(name, first, end) of the stretches of one name."""
    cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(names)]
    return ((int(names[low]), low, high) for low, high in zip(bounds[:-1], bounds[1:], strict=True) if low < high)


def block_grams(docs: DataFrame, blocks: int, order: int = ORDER) -> DataFrame:
    """name, gram: what each block has to look up (a task's part of a block once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(name, counter):
            gram = counter.result()[0]
            for low in range(0, len(gram), 1 << 16):
                own = gram[low : low + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), name)), pa.array(own)], names=["name", "gram"])

        at, counter = None, Counter()
        for batch in batches:
            raws = _raw(batch.column(1))
            for name, low, high in _stretches(batch.column(0).to_numpy()):
                if name != at or counter.full():
                    if at is not None:
                        yield from sent(at, counter)
                    at, counter = name, Counter()
                for gram, _ in text_grams(raws[low:high], order):
                    counter.add(gram)
        if at is not None:
            yield from sent(at, counter)

    prepare(docs.sparkSession)
    return _places(docs, blocks, "text").select("name", "text").mapInArrow(run, "name long, gram long")


def write_blocks(rows: DataFrame, folder: str) -> None:
    """Files with the grams and log-probabilities of each block (rows: name, gram, p), a file for each low bits of a gram."""
    low = F.col("gram").bitwiseAND(BLOCK_FILES - 1)
    rows = rows.select("name", "gram", "p").repartition(partitions(rows.sparkSession), "name", low).sortWithinPartitions("name", low, "gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(key, held):
            gram, p = (np.concatenate(x) for x in zip(*held, strict=True))
            publish(folder, f"{key[0]}-{key[1]}", lambda f: f.write(gram.astype("<i8").tobytes() + np.log(p).astype("<f8").tobytes()))

        at, held, n = None, [], 0
        for batch in batches:
            name, gram, p = (c.to_numpy() for c in batch.columns)
            part = gram & (BLOCK_FILES - 1)
            for _, low, high in _stretches(name * BLOCK_FILES + part):
                key = (int(name[low]), int(part[low]))
                if key != at and held:
                    put(at, held)
                    held = []
                at = key
                held.append((gram[low:high], p[low:high]))
                n += 1
        if held:
            put(at, held)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    run_through(rows.mapInArrow(run, "n long"))


def read_block(folder: str, name: int) -> tuple[np.ndarray, np.ndarray]:
    fs, base = filesystem(folder)
    grams_, logs = [np.zeros(0, np.int64)], [np.zeros(0)]
    for part in range(BLOCK_FILES):
        if fs.get_file_info(f"{base}/{name}-{part}").type != pafs.FileType.NotFound:
            with open_input(folder, f"{name}-{part}") as f:
                raw = f.read()
            grams_.append(np.frombuffer(raw[: len(raw) // 2], "<i8"))
            logs.append(np.frombuffer(raw[len(raw) // 2 :], "<f8"))
    return np.concatenate(grams_), np.concatenate(logs)


class Block:
    """A block's grams in a hash table with linear probing: a look-up is about one access, not a search."""

    def __init__(self, gram: np.ndarray, log: np.ndarray):
        self.shift = np.uint64(64 - max(1, (2 * len(gram)).bit_length()))
        slot = self._slot(gram)
        order = np.argsort(slot, kind="stable")
        count = np.arange(len(gram))
        slot = count + np.maximum.accumulate(slot[order] - count)  # each at its slot, or after the one before it
        size = max(1 << (64 - int(self.shift)), int(slot[-1]) + 1 if len(slot) else 0)
        self.keys, self.logs = np.full(size, -1, np.int64), np.zeros(size)
        self.keys[slot], self.logs[slot] = gram[order], log[order]

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, gram: np.ndarray) -> np.ndarray:
        """Log-probabilities of grams that the block holds."""
        at = self._slot(gram)
        rest = np.flatnonzero(self.keys[at] != gram)
        while len(rest):
            at[rest] += 1
            rest = rest[self.keys[at[rest]] != gram[rest]]
        return self.logs[at]


def score(docs: DataFrame, model: dict, keep: tuple[str, ...], scratch: Scratch, sides: str, order: int = ORDER) -> DataFrame:
    """``keep`` columns, n_bytes, log_likelihood and role (the side file's number, 0 without) of every row of ``docs`` (with file places)."""
    blocks = max(1, -(-docs.count() // BLOCK_ROWS))
    named = scratch.store(block_grams(docs, blocks, order).distinct(), "wanted")
    p = probabilities(named.select("gram").distinct(), model, scratch, order)
    folder = scratch.folder("block-files")
    write_blocks(named.join(merge(p), "gram"), folder)
    rows = _places(docs, blocks, *keep, "text")
    kept = len(keep)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, None
        roles = Sides(sides)
        for batch in batches:
            raws = _raw(batch.column(kept + 3))
            total = np.zeros(len(raws))
            for name, low, high in _stretches(batch.column(2).to_numpy()):
                if name != at:
                    at = name
                    known = Block(*read_block(folder, name))
                for gram, text in text_grams(raws[low:high], order):
                    total[low:high] += np.bincount(text, known.find(gram), high - low)
            _, role = roles.find(batch.column(0), batch.column(1).to_numpy())
            sizes = pa.array([len(r) for r in raws], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[3 : kept + 3], sizes, pa.array(total), pa.array(role)], names=[*keep, "n_bytes", "log_likelihood", "role"]
            )

    return scratch.store(rows.mapInArrow(run, f"{fields}, n_bytes long, log_likelihood double, role long"), "scored")


def trusted_places(docs: DataFrame, labels: DataFrame, folder: str) -> None:
    """Side files of trusted rows: 1 for training, 2 for what is held out."""
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct()
    rows = _places(docs, 1, "doc_id").withColumn("id", F.col("doc_id").cast("long")).where("id is not null")
    role = F.when(held_out("id"), 2).otherwise(1).cast("long").alias("value")
    write_sides(rows.join(merge(trusted), "id").select("file", "row", role), folder)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, log_likelihood, perplexity, threshold, kept of every row."""
    docs = plain(docs.select("doc_id", "text", "lang"))
    with Scratch(docs.sparkSession) as scratch:
        sides = scratch.folder("trusted-places")
        trusted_places(docs, labels, sides)
        training = at_places(docs.select("text"), sides, "role").where("role = 1")
        model = fit(count_grams(training), scratch)
        scored = score(docs, model, ("doc_id", "lang"), scratch, sides)
        scored = scored.withColumn("perplexity", F.exp(-F.col("log_likelihood") / F.greatest(F.lit(1), "n_bytes")))
        known = scored.where("role = 2 and n_bytes > 0")
        cut = lambda rows: rows.agg(F.percentile_approx("perplexity", QUANTILE, 10000).alias("cut"))
        whole = cut(known.groupBy()).first()["cut"]
        by_lang = scratch.store(cut(known.groupBy(F.col("lang").alias("own"))), "cuts")
        by_lang = F.broadcast(by_lang) if by_lang.count() <= SMALL else by_lang
        found = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("own")), "left")
        found = found.withColumn("threshold", F.coalesce("cut", F.lit(whole).cast("double")))
        kept = (F.col("n_bytes") == 0) | F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))
        found = found.select("doc_id", "lang", "n_bytes", "log_likelihood", "perplexity", "threshold", kept.alias("kept"))
        return store(found, "quality")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", "kept")
