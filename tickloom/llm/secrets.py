"""Secret scans with character Markov models (operator 4).

DataFrame and SQL functions only.  Three base patterns (assignments, access
keys, hexadecimal strings) are found as leftmost non-overlapping matches; those
that are too short are dropped.  Two first-order Markov models over the
characters of ``ALPHABET`` then compare random strings with ordinary
identifiers.  A run of such characters outside the base spans becomes a further
span (kind markov) if it has at least ``CANDIDATE`` characters and its
log-likelihood ratio reaches ``THRESHOLD`` in all and ``PER_PAIR`` for each pair.
Of any other run the parts that reach both do, so a secret stays visible beside
a name or a path: for each start the end that exceeds the thresholds most, where
a start one further on would not do better; parts that touch are one span.

The models are trained on labelled samples: the distinct values of base matches
are labelled random, distinct runs of texts without their base matches are
labelled ordinary.  Both samples are bounded: at most ``SAMPLE`` documents with
a base match, and ``SAMPLE`` of any, in the order of a hash of doc_id.  A pair's
share backs off to the character's own, which starts from one count each, so a
model without samples is uniform.  What reaches the driver is one
number for each pair of characters.

Positions are code points, ends exclusive.  Between matches the text is cut with
the same pattern, so the lengths of pieces and matches give the positions.

Rows: null and empty texts have no spans; null doc_ids are not sampled; every row
gives one row, repeated ones too.  Extra columns pass by.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# The base patterns, by kind, and the least length of what counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6
KINDS = ["assign", "access", "hex", "markov"]

#: Characters of the models.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A candidate: a run of at least this many characters of the alphabet.
CANDIDATE = 16
RUN = "[A-Za-z0-9+/_=-]"
#: Least log-likelihood ratio, in nats, in total and for each pair of characters.
THRESHOLD, PER_PAIR = 16.0, 0.7
#: Most pairs of a part that is scored by itself: a longer one that reaches both
#: has a half that does.
LONGEST = 2 * math.ceil(THRESHOLD / PER_PAIR)
#: Weight of a character's own frequency in the estimate of what follows another.
BACKOFF = 8.0
#: Matches that are placed together.
CHUNK = 256
#: Documents of each labelled sample.
SAMPLE = 2000

NO_SPANS = "cast(array() AS array<struct<start: int, kind: int, end: int>>)"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def spans(text: str, pattern: str, kind: int, keep: str = "true") -> str:
    """SQL for an array of (start, kind, end) of the matches m for which ``keep`` holds."""
    p = _quoted(pattern)
    found = f"""zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (p, m) -> named_struct(
      'p', length(p), 'm', coalesce(length(m), 0), 'keep', m IS NOT NULL AND {keep}))"""
    chunks = f"""transform(array({found}), f -> transform(sequence(0, (size(f) - 1) DIV {CHUNK}), i -> slice(f, i * {CHUNK} + 1, {CHUNK})))[0]"""
    # Where each chunk begins, then the matches inside of each: no list longer than a chunk (or than there are chunks) is ever extended.
    begins = """aggregate(c, named_struct('at', 0, 'out', cast(array() AS array<int>)),
      (s, x) -> named_struct('at', s.at + aggregate(x, 0, (n, y) -> n + y.p + y.m), 'out', concat(s.out, array(s.at))), s -> s.out)"""
    inside = f"""aggregate(x, named_struct('at', b, 'out', {NO_SPANS}),
      (s, y) -> named_struct('at', s.at + y.p + y.m, 'out', CASE WHEN y.keep
        THEN concat(s.out, array(named_struct('start', s.at + y.p, 'kind', {kind}, 'end', s.at + y.p + y.m))) ELSE s.out END),
      s -> s.out)"""
    return f"""
    CASE WHEN {text} RLIKE {p}
    THEN transform(array({chunks}), c -> flatten(zip_with(c, {begins}, (x, b) -> {inside})))[0]
    ELSE {NO_SPANS} END"""


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and the sorted base spans."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    long_enough = f"length(regexp_extract(m, {_quoted(ASSIGN)}, 2)) >= {ASSIGN_VALUE}"
    found = [spans("text", ASSIGN, 0, long_enough), spans("text", ACCESS, 1), spans("text", HEX, 2)]
    return rows.withColumn("base", F.expr(f"array_sort(concat({', '.join(found)}))"))


def pair_counts(tokens: DataFrame) -> DataFrame:
    """Counts of neighbouring characters over the distinct values of ``token``."""
    pairs = tokens.select("token").distinct().selectExpr(
        "explode(transform(array(split(token, '')), c -> zip_with(c, slice(c, 2, size(c)), (a, b) -> concat(a, b)))[0]) AS pair"
    )
    return pairs.where("length(pair) = 2").groupBy("pair").count()


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each pair of the alphabet."""
    rows = docs.where("doc_id IS NOT NULL")
    anywhere = f"coalesce(text, '') RLIKE {_quoted('|'.join((ASSIGN, ACCESS, HEX)))}"
    sample = lambda d: d.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()
    secret = with_base(rows.where(anywhere).join(F.broadcast(sample(rows.where(anywhere))), "doc_id", "left_semi"))
    values = secret.selectExpr(
        f"explode(transform(base, x -> CASE WHEN x.kind = 0 THEN regexp_extract(substr(text, x.start + 1, x.end - x.start), {_quoted(ASSIGN)}, 2)"
        " ELSE substr(text, x.start + 1, x.end - x.start) END)) AS value"
    ).selectExpr(f"explode(regexp_extract_all(value, r'{RUN}+', 0)) AS token")
    usual = rows.join(F.broadcast(sample(rows)), "doc_id", "left_semi").selectExpr(
        f"regexp_replace(coalesce(text, ''), {_quoted('|'.join((ASSIGN, ACCESS, HEX)))}, ' ') AS text"
    ).selectExpr(f"explode(regexp_extract_all(text, r'{RUN}{{4,}}', 0)) AS token")
    counts = pair_counts(values).withColumn("kind", F.lit(0)).unionByName(pair_counts(usual).withColumn("kind", F.lit(1)))
    seen = {(r["kind"], r["pair"]): r["count"] for r in counts.collect()}  # at most two for each pair of characters
    return ratios(seen)


def ratios(seen: dict[tuple[int, str], int]) -> list[float]:
    total = {(k, a): sum(seen.get((k, a + b), 0) for b in ALPHABET) for k in (0, 1) for a in ALPHABET}
    whole = {k: sum(total[k, a] for a in ALPHABET) for k in (0, 1)}
    usual = {(k, b): (sum(seen.get((k, a + b), 0) for a in ALPHABET) + 1) / (whole[k] + len(ALPHABET)) for k in (0, 1) for b in ALPHABET}
    share = lambda k, a, b: (seen.get((k, a + b), 0) + BACKOFF * usual[k, b]) / (total[k, a] + BACKOFF)
    return [round(math.log(share(0, a, b) / share(1, a, b)), 4) for a in ALPHABET for b in ALPHABET]


def ratios_of(run: str, table: str) -> str:
    """SQL for the log-likelihood ratios of a run's pairs."""
    return f"""transform(array(transform(split({run}, ''), c -> instr('{ALPHABET}', c) - 1)), c ->
      zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (a, b) -> element_at({table}, a * {len(ALPHABET)} + b + 1)))[0]"""


def random_parts(d: str, at: str) -> str:
    """SQL for the spans of a run whose pairs have the ratios ``d`` and that begins at ``at``."""
    span = lambda a, b: f"named_struct('start', {at} + {a}, 'kind', 3, 'end', {at} + {b})"
    enough = lambda n: f"greatest({THRESHOLD}D, {PER_PAIR}D * ({n}))"
    over = f"s.sum + r - {enough('s.n + 1')}"
    better = f"s.n + 1 >= {CANDIDATE - 1} AND {over} > s.over"
    ends = f"""transform(sequence(0, size({d}) - {CANDIDATE - 1}), i -> aggregate(slice({d}, i + 1, {LONGEST}),
      named_struct('n', 0, 'sum', 0D, 'over', -1e9D, 'to', 0),
      (s, r) -> named_struct('n', s.n + 1, 'sum', s.sum + r, 'over', CASE WHEN {better} THEN {over} ELSE s.over END, 'to', CASE WHEN {better} THEN s.n + 1 ELSE s.to END),
      s -> named_struct('over', s.over, 'from', i, 'to', i + s.to + 1)))"""
    own = f"""transform(array({ends}), e -> filter(e, (x, i) -> x.over >= 0 AND x.over >= coalesce(get(e, i + 1).over, x.over)))[0]"""
    merged = f"""aggregate({own}, named_struct('from', -1, 'to', -1, 'out', {NO_SPANS}),
      (s, x) -> CASE WHEN x.from <= s.to THEN named_struct('from', s.from, 'to', greatest(s.to, x.to), 'out', s.out)
        ELSE named_struct('from', x.from, 'to', x.to, 'out', CASE WHEN s.to < 0 THEN s.out ELSE concat(s.out, array({span('s.from', 's.to')})) END) END,
      s -> CASE WHEN s.to < 0 THEN s.out ELSE concat(s.out, array({span('s.from', 's.to')})) END)"""
    total = f"aggregate({d}, 0D, (sum, r) -> sum + r)"
    return f"CASE WHEN {total} >= {enough(f'size({d})')} THEN array({span('0', f'size({d}) + 1')}) ELSE {merged} END"


def scan(docs: DataFrame, model: list[float]) -> DataFrame:
    """doc_id, text, base spans and all spans (base and Markov) of every row."""
    table = f"from_json('{json.dumps(model)}', 'array<double>')"
    pattern = f"{RUN}{{{CANDIDATE},}}"
    # Base spans become spaces, so that runs end at them; positions stay.
    rest = "aggregate(base, text, (t, b) -> concat(substr(t, 1, b.start), repeat(' ', b.end - b.start), substr(t, b.end + 1)))"
    rows = with_base(docs).withColumn("rest", F.expr(f"CASE WHEN text RLIKE {_quoted(pattern)} THEN {rest} ELSE '' END"))
    rows = rows.withColumn("runs", F.expr(spans("rest", pattern, 3)))
    scored = f"transform(runs, r -> named_struct('at', r.start, 'd', {ratios_of('substr(rest, r.start + 1, r.end - r.start)', table)}))"
    random = f"flatten(transform({scored}, own -> {random_parts('own.d', 'own.at')}))"
    rows = rows.withColumn("spans", F.expr(f"CASE WHEN size(runs) = 0 THEN base ELSE array_sort(concat(base, {random})) END"))
    return rows.drop("rest", "runs")


def listed(column: str) -> Column:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({column}, x -> concat(element_at(array({kinds}), x.kind + 1), ':', x.start, ':', x.end)), ',')")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = scan(docs, train(docs))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"),
    )
