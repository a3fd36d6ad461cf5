"""Toxicity by compression distance (operator 7).

A text's windows are its lower-cased words between white space, without the
marks around them.  Each window is compressed twice, with a zstandard dictionary
trained on ordinary text and with one trained on toxic text; the difference of
the two lengths is how much nearer the window is to toxic text, and it is taken
against the length that ordinary text needs.  Windows are short, so a fixed
``LEAD`` that both dictionaries hold goes before each of them: both frames then
pay for a compressed block, and lengths differ by what the window costs.  The
toxic dictionary's content follows that of the ordinary one, so that a match in
ordinary text is open to both.

A document's features are its largest relative differences and how many windows
reach certain differences; a logistic calibration on labelled documents turns
them into a score, and ``score >= 0.5`` is the threshold.

Training takes a bounded sample of labelled rows, in the order of a hash of
doc_id: at most ``TOXIC_SAMPLE`` toxic and ``ORDINARY_SAMPLE`` ordinary texts,
each whole; near copies of a sampled text are left out.  Half of them train the dictionaries, the other half calibrates, so
that the calibration sees texts that the dictionaries have not seen.  The toxic
dictionary is trained on those windows of toxic texts that are typical of them
(their document frequency is far above that in ordinary texts), joined text by
text; the ordinary dictionary on ordinary texts.

Rows: null and empty texts have no windows and get the score of a text without
any; null doc_ids are never used for training; every row gives one row.  Without
labelled rows of both classes nothing tells them apart: all scores are 0 and
nothing is rejected.  Scores never use labels, language, source or doc_id.  Empty
tables give no rows; extra columns pass by.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import documents, light, prepare, table

#: Bounds of the labelled sample, in texts.
TOXIC_SAMPLE, ORDINARY_SAMPLE = 4000, 6000
#: Bytes of a trained dictionary.
DICTIONARY = 16 << 10
#: Goes before each window, and into both dictionaries.
LEAD = b"<<window of a text>>"
#: Windows longer than this many bytes are compressed in pieces of this size.
WINDOW = 64
#: Marks around a window.
MARKS = ".,;:!?*#%&$@()[]{}<>/=+-_|~^\"'"
#: Near copies: so many of this many sketch values agree.
ALIKE, SKETCH = 5, 16
#: Standard deviations by which a typical window is over-represented.
TYPICAL = 6.0
#: Remembered windows of a worker.
CACHE = 400_000
#: Relative differences whose counts are features.
STEPS = (0.3, 0.4, 0.5, 0.6)


def windows(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def bare(window: str) -> str:
    return window.strip(MARKS)


def held_out_column(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


class Model:
    """Two trained dictionaries and a calibration."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: list[float] | None):
        self.toxic, self.ordinary, self.weights = toxic, ordinary, weights
        self._distance: _Distances | None = None

    def __getstate__(self):
        return (self.toxic, self.ordinary, self.weights)

    def __setstate__(self, state):
        self.__init__(*state)

    def features(self, text: str | None) -> list[float]:
        if self._distance is None:
            self._distance = _Distances(self.toxic, self.ordinary)
        found = np.fromiter(map(self._distance.__getitem__, windows(text)), np.float32)
        if len(found) > 4:
            top = np.sort(np.partition(found, len(found) - 4)[-4:])[::-1]
        else:
            top = np.sort(found)[::-1]
        top = [float(x) for x in top] + [0.0] * (4 - len(top))
        return [*top, *(math.log1p(int((found >= s).sum())) for s in STEPS), math.log1p(len(found))]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        *w, bias = self.weights
        z = bias + sum(a * b for a, b in zip(w, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


class _Distances(dict):
    """Window -> what the toxic dictionary saves, of what ordinary text needs."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        ordinary = LEAD + ordinary
        self.ordinary, self.toxic = compressor(ordinary), compressor(ordinary + toxic)
        self.base = len(self.ordinary(LEAD + LEAD))

    def __missing__(self, window: str) -> float:
        raw = b" " + bare(window).encode() + b" "
        far = 0.0
        for i in range(0, len(raw), WINDOW):
            piece = LEAD + raw[i : i + WINDOW] + LEAD
            usual = len(self.ordinary(piece))
            far = max(far, (usual - len(self.toxic(piece))) / max(4, usual - self.base))
        if len(self) >= CACHE:
            self.clear()
        if len(window) <= WINDOW:
            self[window] = far
        return far


def compressor(content: bytes):
    """Compression of short windows against a dictionary's content."""
    settings = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=16, search_log=6, min_match=4, target_length=64,
        strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    kept.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=kept).compress


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; too little text for training is the dictionary itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY:]


def typical(toxic: list[str], ordinary: list[str]) -> set[str]:
    """Windows far more frequent in toxic texts than in ordinary ones."""
    seen = Counter(w for t in toxic for w in set(map(bare, windows(t))) if w)
    seen = Counter({w: n for w, n in seen.items() if n >= 2})
    other = Counter(w for t in ordinary for w in seen.keys() & set(map(bare, windows(t))))
    n, m = len(toxic), len(ordinary)
    out = set()
    for w, a in seen.items():
        b = other[w]
        p = (a + b + 0.5) / (n + m)
        if (a / n - b / m) / math.sqrt(p * (1 - min(p, 0.999)) * (1 / n + 1 / m)) >= TYPICAL:
            out.add(w)
    return out


def ordinary_samples(ordinary: list[str]) -> list[bytes]:
    """All windows of the texts, in pieces of 12."""
    return [(" " + " ".join(own[i : i + 12]) + " ").encode() for t in ordinary for own in [windows(t)] for i in range(0, len(own), 12)]


def distinct_texts(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Rows without empty texts and near copies of a text before them."""
    factors = (np.random.RandomState(0).randint(1, 1 << 61, SKETCH) * 2 + 1).astype(np.uint64)
    seen: dict[tuple[int, int], list[int]] = {}
    out = []
    for i, (text, label) in enumerate(rows):
        hashes = np.array([zlib.crc32(w.encode()) for w in set(windows(text))], np.uint64)
        if not len(hashes):
            continue
        sketch = list(enumerate((((hashes * np.uint64(0x9E3779B97F4A7C15))[:, None] * factors) >> np.uint64(20)).min(0).tolist()))
        alike = Counter(j for v in sketch for j in seen.get(v, ()))
        if alike and max(alike.values()) >= ALIKE:
            continue
        for v in sketch:
            seen.setdefault(v, []).append(i)
        out.append((text, label))
    return out


def train(rows: list[tuple[str, int]]) -> Model:
    """From (text, toxic) rows in an order that does not depend on the label."""
    rows = distinct_texts(rows)
    by = [[t for t, y in rows if y == c] for c in (0, 1)]
    if min(map(len, by)) < 2:
        return Model(b"", b"", None)
    (ordinary, ordinary2), (toxic, toxic2) = [(x[::2], x[1::2]) for x in by]
    chosen = typical(toxic, ordinary)
    samples = [(" " + " ".join(own) + " ").encode() for t in toxic if (own := [w for w in map(bare, windows(t)) if w in chosen])]
    model = Model(train_dictionary(samples or [t.encode() for t in toxic]), train_dictionary(ordinary_samples(ordinary)), None)
    x = np.array([model.features(t) for t in [*ordinary2, *toxic2, ""]])
    y = np.array([0.0] * len(ordinary2) + [1.0] * len(toxic2) + [0.0])
    model.weights = calibrate(x, y)
    return model


def calibrate(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton's method; weights, then bias."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / sd, np.ones(len(x))]
    ridge = np.full(a.shape[1], 1.0)
    ridge[-1] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return [*(w[:-1] / sd).tolist(), float(w[-1] - (w[:-1] * mean / sd).sum())]


def labelled_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """At most the documented number of labelled texts outside the held-out fold.

    The sample is drawn on the labels' identifiers, before any text is read; it
    is a bounded set of rows, so its identifiers may be broadcast.
    """
    prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1)").where(~held_out_column())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("place", F.xxhash64("doc_id"))
    few = [known.where(F.col("toxic") == c).orderBy("place", "doc_id").limit(n) for c, n in ((0, ORDINARY_SAMPLE), (1, TOXIC_SAMPLE))]
    few = few[0].unionByName(few[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    rows = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("place").alias("place"))
    return [(r["text"], r["toxic"]) for r in rows.orderBy("place", "doc_id").select("text", "toxic").toLocalIterator()]


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the score of every row."""
    spark = docs.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY bytes
    schema = StructType([*(docs.schema[c] for c in keep), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            found = pa.array([m.score(t) for t in batch.column(len(keep)).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], found], names=[*keep, "score"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], "text").mapInArrow(light(run), schema)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, all their columns."""
    whole = docs.select(F.struct("*").alias("whole"), "text")
    return score(whole, model, ("whole",)).where("score < 0.5").select("whole.*")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(labelled_sample(docs, table(spark, sf_dir, "labels")))
    return score(docs, model).select(
        "doc_id", held_out_column().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
