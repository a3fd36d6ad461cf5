"""Lexicon sentiment, in DataFrame functions and over Arrow batches.

A lexicon is a table (word, tone, valence): tone +1 or -1 for the balance-sheet
lists, valence a real number, either may be null.  Tokens meet it in a join on
the word (``score_tokens``) or where their texts are read (``scored``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Context
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Weights, normalisation, negation and label limits.
TONE_WEIGHT, VALENCE_WEIGHT = 0.5, 0.5
VALENCE_NORM, NEGATION = 15.0, -0.74
POSITIVE_ABOVE, NEGATIVE_BELOW = 0.05, -0.05
# Decimals of a sum of valences, and bytes of texts that are looked at together.
VALENCE_DIGITS, SLICE = 15, 1 << 22
NEGATORS = ["not", "no", "never", "without", "lacks", "lacking", "fails", "failed", "cannot", "cant", "isnt", "wont"]


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and apostrophes."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z']+"), lambda x: x != "")


def scored_text(title: Column, summary: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")))


def read_words(spark: SparkSession, path: str, tone: int) -> DataFrame:
    """A word list, one word a line."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").select("word", F.lit(tone).alias("tone"), F.lit(None).cast("double").alias("valence"))


def read_valence(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table word, valence, ..."""
    rows = spark.read.option("sep", "\t").csv(path, schema="word string, valence double, spread double, ratings string")
    return rows.select("word", F.lit(None).cast("int").alias("tone"), "valence")


def lexicon(*tables: DataFrame) -> DataFrame:
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy("word").agg(F.max("tone").alias("tone"), F.max("valence").alias("valence"))


def exact_sum(x: Column, digits: int = 17, whole: bool = False) -> Column:
    """A grouped sum to so many decimals, the same in every order of the rows; ``whole``: to be added up further."""
    total = F.sum(x.cast(f"decimal(30,{digits})"))
    return total if whole else total.cast("double")


def score_tokens(rows: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """Per ``key``: n_tokens, tone, valence, score, hit; ``rows`` has ``key`` and ``tokens``.

    Tokens are exploded, met with the lexicon where they are (word lists are
    short, so it is broadcast) and summed up per key before the shuffle.  Sums of
    valences are decimal: they do not depend on the order of the words.
    """
    each = rows.select(key, "tokens", F.posexplode_outer("tokens").alias("at", "word"))
    each = each.withColumn("negated", F.coalesce(F.get("tokens", F.col("at") - 1).isin(NEGATORS), F.lit(False))).drop("tokens")
    met = each.join(F.broadcast(words), "word", "left")
    value = F.col("valence") * F.when(F.col("negated"), NEGATION).otherwise(1.0)
    sums = met.groupBy(key).agg(
        F.count("word").alias("n_tokens"), F.coalesce(F.sum("tone"), F.lit(0)).alias("_tone"),
        F.coalesce(exact_sum(value, VALENCE_DIGITS), F.lit(0.0)).alias("_valence"),
        F.coalesce(F.bool_or(F.col("tone").isNotNull() | F.col("valence").isNotNull()), F.lit(False)).alias("hit"),
    )
    return with_scores(sums)


def scored(rows: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """``rows`` without the column ``text``, with what ``score_tokens`` finds in it.

    Texts are read once and none of their tokens leaves the batch.  The lexicon
    (short, each word once) goes to the tasks; valences are whole numbers of
    10^-15, so their sums are those of ``score_tokens``.
    """
    unit = lambda x: int(x.scaleb(VALENCE_DIGITS, Context(60))) if x is not None else 0
    value = lambda by: (F.col("valence") * by).cast(f"decimal(30,{VALENCE_DIGITS})")
    lexicon = words.select("word", "tone", value(1.0), value(NEGATION)).collect()  # word lists are short
    known, negators, split = [r[0] for r in lexicon], NEGATORS, 10**8
    tones = np.array([r[1] or 0 for r in lexicon], np.int64)
    units = [[unit(r[k]) for r in lexicon] for k in (2, 3)]
    high, low = (np.array([[f(x, split) for x in u] for u in units], np.int64) for f in (int.__floordiv__, int.__mod__))

    # Nested, so that they travel whole: workers need not have this package.
    def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The tokens of all texts, and the place of each one's text; as ``tokens`` finds them."""
        lower = np.zeros(256, np.uint8)
        lower[ord("'")] = ord("'")
        lower[ord("a") : ord("z") + 1] = lower[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
        # Two other letters have lower-case forms with ASCII letters.
        texts = pc.replace_substring(pc.replace_substring(texts, "\u212a", "k"), "\u0130", "i\u0307")
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        text = lower[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
        ends = ends - ends[0]
        inside = text != 0
        change = np.ones(len(text) + 1, bool)  # where a run may begin or end
        change[1:-1] = inside[1:] != inside[:-1]
        change[ends] = True
        change = np.flatnonzero(change)
        begins = change[:-1][inside[change[:-1]]]
        sizes = np.diff(change)[inside[change[:-1]]]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(text[inside]))
        return words, np.searchsorted(ends, begins, "right") - 1

    def sums(texts: pa.Array) -> list[pa.Array]:
        found, at = words_of(texts)
        number = pc.fill_null(pc.index_in(found, value_set=pa.array(known, found.type)), -1).to_numpy()
        after = np.zeros(len(found), np.int64)
        after[1:] = pc.is_in(found, value_set=pa.array(negators, found.type)).to_numpy(zero_copy_only=False)[:-1] & (at[1:] == at[:-1])
        hits = np.flatnonzero(number >= 0)
        number, after = number[hits], after[hits]
        bounds = np.searchsorted(at[hits], np.arange(len(texts) + 1))
        each = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
        valence = [(int(h) * split + int(x)) / 10**VALENCE_DIGITS for h, x in zip(each(high[after, number]), each(low[after, number]), strict=True)]
        return [pa.array(np.bincount(at, minlength=len(texts))), pa.array(each(tones[number])), pa.array(valence, pa.float64()), pa.array(np.diff(bounds) > 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
            ends, kept, begin = np.cumsum(pc.binary_length(texts).to_numpy()), batch.drop_columns([text]), 0
            while begin < len(texts):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE, "right")))
                own = kept.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*own.columns, *sums(texts.slice(begin, end - begin))], names=[*own.schema.names, "n_tokens", "_tone", "_valence", "hit"])
                begin = end

    schema = rows.drop(text).schema
    for name, kind in (("n_tokens", "long"), ("_tone", "long"), ("_valence", "double"), ("hit", "boolean")):
        schema = schema.add(name, kind)
    return with_scores(rows.mapInArrow(run, schema))


def with_scores(sums: DataFrame) -> DataFrame:
    tone = F.when(F.col("n_tokens") > 0, F.col("_tone") / F.sqrt(F.col("n_tokens").cast("double"))).otherwise(0.0)
    valence = F.col("_valence") / F.sqrt(F.col("_valence") * F.col("_valence") + VALENCE_NORM)
    mixed = TONE_WEIGHT * F.col("tone") + VALENCE_WEIGHT * F.col("valence")
    rows = sums.withColumn("tone", tone).withColumn("valence", valence).drop("_tone", "_valence")
    return rows.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mixed)))


def label(score: Column) -> Column:
    return F.when(score > POSITIVE_ABOVE, "positive").when(score < NEGATIVE_BELOW, "negative").otherwise("neutral")


def expected_valence(total: float) -> float:
    return total / math.sqrt(total * total + VALENCE_NORM) if total else 0.0


def word_files(folder: str) -> list[Path]:
    return sorted(Path(folder).glob("*.txt"))
