"""The training-data operators against brute force on small, odd tables."""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import bpe, codec, decontaminate, exact, neardup, perplexity, secrets, substrings, token_files, toxicity, warc
from tickloom.llm.common import Scratch, new_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, locator string, digest string"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim".split()


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


LONG = sentence(1, 4000)
BASE = sentence(2, 60)
NEAR = BASE.replace(BASE.split()[30], "changed", 1)
TEXTS = [
    (1, BASE), (2, BASE.replace(" ", "  \n", 3)), (3, NEAR), (4, None), (5, ""), (6, "one"), (7, "ONE"), (8, LONG), (9, "é日本 😀 <|endoftext|> it's  x"), (10, " \t "),
    (11, sentence(3, 40) + " " + BASE), (None, BASE), (12, sentence(4, 30)), (12, sentence(4, 30)), (13, "token=abcdef12 password: 'hunter22' secret=token:abcdefgh"),
]


def table(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en", "s", 0, "own", "own") for i, t in rows], DOCS)


def stored(spark, rows=TEXTS):
    path = new_folder(spark, "docs")
    table(spark, rows).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


# 9, 2: tokens -------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(alphabet=" \n\tabAB'.,é1<|>endoftx", max_size=60))
def test_encoders_agree_with_the_library(text):
    from tokenizers import Tokenizer

    own = test_encoders_agree_with_the_library.__dict__.setdefault("t", Tokenizer.from_file(PATH))
    want = own.encode(text, add_special_tokens=False).ids
    for make in (bpe.backtracking_encoder, bpe.library_encoder):
        e = make(PATH)
        assert np.frombuffer(e.encode(text), e.dtype).tolist() == want
    assert bpe.vocabulary(PATH).decode(np.array(want, np.int64)).decode("utf-8", "replace") == own.decode(want, skip_special_tokens=False)


def test_codec_keeps_every_row(spark, library):
    rows = codec.digests(table(spark), PATH).collect()
    assert len(rows) == len(TEXTS)
    want = sorted((str(i), hashlib.sha256(",".join(map(str, library.encode(t or "", add_special_tokens=False).ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in TEXTS)
    assert sorted((str(r["doc_id"]), r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want


def test_token_files_round_trip(spark, library):
    folder = new_folder(spark, "tokens")
    parts = token_files.write_token_files(table(spark), folder, PATH, 2)
    rows = sorted(token_files.read_token_files(spark, folder, parts, PATH).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:]) and len(ids) == len(TEXTS)
    at, texts = 0, dict(TEXTS)
    for r in rows:
        want = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    empty = token_files.write_token_files(table(spark, []), new_folder(spark, "tokens"), PATH, 2)
    assert empty == [] and token_files.read_token_files(spark, folder, empty, PATH).count() == 0


# 3: exact copies ------------------------------------------------------------------


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    key = lambda x: (x is None, x or 0)
    return sorted((str(i), str(min(g, key=key)), len(g)) for g in groups.values() for i in g)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_checks_bytes(spark, weak):
    digest = (lambda t: F.substring(exact.sha256(t), 1, 1)) if weak else exact.sha256
    rows = exact.assign(stored(spark), digest=digest).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in rows) == brute_exact(TEXTS)
    assert sum(r["kept"] for r in rows) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in TEXTS})


def test_exact_dedup_of_derived_and_empty_tables(spark):
    kept = exact.deduplicate(table(spark))
    assert kept.columns == table(spark).columns and kept.where("doc_id = 12").count() == 1
    assert exact.assign(table(spark, [])).count() == 0


def test_exact_dedup_reads_on_from_its_state(spark):
    folder = new_folder(spark, "state")
    runs = [[(1, "x y"), (2, "x y"), (3, "q")], [(4, "x  y"), (5, "new"), (6, "q"), (0, "q")], [(7, "new"), (9, "z"), (8, "z"), (10, None), (11, "x y")]]
    seen, first = {}, {}
    for rows in runs:
        for i, t in rows:
            seen.setdefault(exact_form(t), []).append(i)
        for i, t in sorted(rows):
            first.setdefault(exact_form(t), i)  # a row of an earlier run stays
        found = exact.assign(spark.createDataFrame(rows, "doc_id long, text string"), state_dir=folder).collect()
        want = sorted((i, first[exact_form(t)], len(seen[exact_form(t)]), first[exact_form(t)] == i) for i, t in rows)
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found) == want


def exact_form(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# 1: decontamination -----------------------------------------------------------------

ITEMS = [(1, " ".join(BASE.split()[5:25])), (2, "ONE"), (3, None), (4, "..."), (None, "one"), (1, " ".join(BASE.split()[5:25])), (10, " ".join(LONG.split()[50:62]).upper())]


def brute_contamination(rows, items, k=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    out = []
    for i, t in rows:
        w, hit, found = low(t), set(), set()
        for item, q in items:
            q = low(q)
            for a in range(max(1, len(q) - k + 1) if q else 0):
                win = q[a : a + k]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found.add(item)
        listed = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((str(i), len(w), len(hit), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [16 << 20, 100])
def test_decontamination_in_one_block_and_in_many(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")
    rows = decontaminate.contamination(table(spark), items).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items_sha256"], r["contaminated"]) for r in rows) == brute_contamination(TEXTS, ITEMS)
    clean = decontaminate.without_contaminated(table(spark), items)
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(x[0] for x in brute_contamination(TEXTS, ITEMS) if not x[4])


def test_index_without_items_and_proximity(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontaminate.contamination(table(spark), none).collect())
    segment = decontaminate.Segment(*decontaminate.build_index(spark.createDataFrame([(1, "a b c d e"), (2, "e x x x a")], "doc_id long, text string").coalesce(1)).first())
    assert segment.near([b"a", b"c"], 3).tolist() == [0] and segment.near([b"a", b"e"], 4).tolist() == [] and segment.near([b"a", b"e"], 5).tolist() == [0, 6]
    assert segment.phrase([b"e", b"e"]).tolist() == []


def test_proximity_against_brute_force(spark):
    rows = [(1, "alpha x x beta y y gamma"), (2, "gamma x x x x x alpha beta"), (None, "beta alpha gamma"), (4, None), (5, "alpha beta"), (6, "gamma. x alpha x x BETA")]
    items = [(1, "alpha beta gamma"), (2, ""), (None, "alpha beta"), (3, None), (4, "alpha missing")]
    index = decontaminate.build_index(table(spark, rows))
    word = re.compile(r"[A-Za-z]+")
    for slop in (1, 2, 3, 6, 7, 50):
        found = decontaminate.match_near(index, spark.createDataFrame(items, "item_id long, text string"), slop).collect()
        want = {}
        for i, t in rows:
            w = [x.lower() for x in word.findall(t or "")]
            for item, q in items:
                q = set(word.findall(q or ""))
                if begins := [p for p, x in enumerate(w) if x in q and q <= set(w[p : p + slop])]:
                    want[i, item] = begins
        assert {(r["doc_id"], r["item_id"]): r["positions"] for r in found} == want
    assert decontaminate.match_near(index, spark.createDataFrame([], "item_id long, text string")).count() == 0


# 5: near copies ---------------------------------------------------------------------


def brute_near(rows, k):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    key = lambda x: (x is None, x or 0)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), d), d, key=key)
    return sorted((str(d), len(sets[i]), str(best[find(i)])) for i, (d, _) in enumerate(rows))


def edited(seed: int, base: str, edits: int) -> str:
    r, w = random.Random(seed), base.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_lose_no_link(spark):
    rows = TEXTS + [(100 + i, edited(i, BASE if i % 2 else LONG[:900], i % 7)) for i in range(60)]
    found = neardup.near_duplicates(stored(spark, rows), 2).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found) == brute_near(rows, 2)
    assert sum(r["kept"] for r in found) == len({r["component_id"] for r in found}) or any(r["component_id"] is None for r in found)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(table(spark, [])).count() == 0
    assert neardup.without_near_duplicates(table(spark, [(1, None), (2, "a b c")])).count() == 2


def test_sketches_estimate_similarity():
    a = np.unique(np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    b = np.concatenate([a[:900], a[:100] + np.uint64(1)])
    s = neardup.sketch([a, b, a[:1]], 200)
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.12 and (s[2] != np.uint64(2**64 - 1)).all()


# 4: secrets ----------------------------------------------------------------------------


def test_base_spans_and_models(spark):
    key = "AKIA" + "ABCD1234EFGH5678"
    rows = TEXTS + [(20, f"😀 {key} x API-key = \"{'z' * 6}\" apikey:abc {'0f' * 13}"), (21, "kX9qZ2vB7nM4pL8wR3tY6u and loremipsumdolorsit")]
    r = random.Random(5)
    labelled = [(1000 + i, "token=" + "".join(r.choice("ABCDEFGHKLMNPQRSTUVWXYZabcdefghikmnopqrstuvwxyz0123456789") for _ in range(40))) for i in range(150)]
    found = {r["doc_id"]: r for r in secrets.scan(table(spark, rows), secrets.train(table(spark, TEXTS + labelled))).select("doc_id", "text", "base", secrets.listed("spans").alias("spans")).collect()}
    assign = re.compile(secrets.ASSIGN.replace("(?i:", "(?:"), re.I | re.A)
    for i, t in rows:
        if i is None:
            continue
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [tuple(x) for x in found[i]["base"]] == sorted(want), i
    assert "markov:0:22" in found[21]["spans"] and found[21]["spans"].count(":") == 2
    assert secrets.scan(table(spark, []), [0.0] * len(secrets.ALPHABET) ** 2).count() == 0


def test_secrets_beside_names_and_base_spans(spark):
    r = random.Random(6)
    draw = lambda n: "".join(r.choice("ABCDEFGHKLMNPQRSTUVWXYZabcdefghikmnopqrstuvwxyz0123456789") for _ in range(n))
    name = lambda: "".join(r.choice(WORDS) for _ in range(8))
    labelled = [(1000 + i, f"token={draw(40)} {name()} {name()}/{name()}") for i in range(150)]
    secrets_ = [draw(24) for _ in range(40)]
    rows = [(i, f"é {name()}={s}/{name()} {name()}") for i, s in enumerate(secrets_)]
    rows += [(100 + i, f"{name()}/{s}_{name()}-{draw(24)}-{name()}") for i, s in enumerate(secrets_)]
    rows += [(200 + i, f"path/{'0f' * 20}/{s}") for i, s in enumerate(secrets_)] + [(300 + i, f"{name()}/{name()}_{name()}") for i in range(40)]
    found = {}
    for x in secrets.scan(table(spark, rows), secrets.train(table(spark, labelled))).select("doc_id", "text", "spans").collect():
        found[x["doc_id"]] = x["text"], [(a, b) for a, kind, b in x["spans"] if kind == 3]
        bare = sorted((a, b) for a, kind, b in x["spans"])
        assert all(p[1] <= q[0] for p, q in zip(bare, bare[1:]))
    for first in (0, 100, 200):
        covered = 0
        for i, s in enumerate(secrets_):
            text, parts = found[first + i]
            covered += any(min(b, text.index(s) + 24) - max(a, text.index(s)) >= 16 for a, b in parts)
        assert covered >= 38, first
    assert sum(bool(found[300 + i][1]) for i in range(40)) == 0


def test_long_texts_with_many_matches(spark):
    import time

    r = random.Random(7)
    labelled = [(i, "token=" + "".join(r.choice(secrets.ALPHABET[:62]) for _ in range(40)) + " " + sentence(i, 20)) for i in range(80)]
    model = secrets.train(table(spark, labelled))
    texts = [(1, "token=abcdefgh1 " * 100_000), (2, "".join(r.choice(secrets.ALPHABET[:62]) for _ in range(1_000_000))), (3, "a" * 1_000_000)]
    begin = time.monotonic()
    found = {x["doc_id"]: x["spans"] for x in secrets.scan(table(spark, texts), model).select("doc_id", "spans").collect()}
    assert len(found[1]) == 100_000 and found[1][-1][2] == 16 * 100_000 - 1 and found[2] == [(0, 3, 1_000_000)]
    assert time.monotonic() - begin < 240


# 6, 7: models ------------------------------------------------------------------------------


def brute_kneser_ney(raws, order):
    """gram -> probability, by the definition: lower orders count left extensions, but raw at the start of a text."""
    counts = {k: {} for k in range(1, order + 1)}
    for raw in raws:
        padded = bytes(order - 1) + raw
        for i in range(len(raw)):
            g = padded[i : i + order]
            counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        for g, c in counts[k + 1].items():
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + (c if g[1] == 0 else 1)

    def p(g):
        if not g:
            return 1 / 256
        own = counts[len(g)]
        n = {i: sum(c == i for c in own.values()) for i in (1, 2, 3, 4)}
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        cuts = [max(0.1, min(i - 0.1, i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.0)) for i in (1, 2, 3)]
        following = [c for x, c in own.items() if x[:-1] == g[:-1]]
        if not following:
            return p(g[1:])
        d = lambda c: cuts[min(c, 3) - 1]
        c = own.get(g, 0)
        return ((c - d(c)) if c else 0.0) / sum(following) + sum(map(d, following)) / sum(following) * p(g[1:])

    return p


def trained(spark, raws, order, scratch):
    texts = spark.createDataFrame([(r.decode(),) for r in raws], "text string")
    return perplexity.fit(perplexity.count_grams(texts, order), scratch, order)


def test_kneser_ney_against_its_definition(spark):
    raws, order = [b"abracadabra", b"abba abra", b"banana", b"abracadabra", b"cab"], 3
    p = brute_kneser_ney(raws, order)
    asked = [bytes([a, b, c]) for a in b"\0abrz" for b in b"\0abr " for c in b"abcdrnz"]
    with Scratch(spark) as scratch:
        wanted = spark.createDataFrame([(int.from_bytes(g, "big"),) for g in asked], "gram long").distinct()
        found = {r["gram"]: r["p"] for r in perplexity.probabilities(wanted, trained(spark, raws, order, scratch), scratch, order).collect()}
    assert len(found) == len(set(asked))
    assert all(abs(found[int.from_bytes(g, "big")] - p(g)) < 1e-12 for g in asked)
    for context in (b"ab", b"zz", b"\0\0"):
        assert abs(sum(p(context + bytes([c])) for c in range(256)) - 1) < 1e-9


def quality_rows(n=40):
    rows = [(i, sentence(100 + i, 40)) for i in range(n)]
    return [*rows, (100, "zq#x!! " * 30), (101, None), (102, ""), (None, sentence(5, 30)), (103, rows[0][1]), (103, rows[0][1])]


def test_quality_scores_each_row(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "PIECE", 100)  # most texts go through in pieces
    rows = quality_rows()
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100, 0), (None, 1)], "doc_id long, quality int")
    found = perplexity.quality(stored(spark, rows), labels).collect()
    assert len(found) == len(rows)
    one = {r["doc_id"]: r for r in found}
    assert not one[100]["kept"] and one[101]["kept"] and one[102]["perplexity"] == 1.0
    held = {r["doc_id"] for r in spark.createDataFrame([(i,) for i in range(40)], "doc_id long").where(perplexity.held_out("doc_id")).collect()}
    p = brute_kneser_ney([t.encode() for i, t in rows if i is not None and i < 40 and i not in held], perplexity.ORDER)
    for i in (100, 3):
        raw = dict(rows)[i].encode()
        padded = bytes(perplexity.ORDER - 1) + raw
        want = sum(math.log(p(padded[k : k + perplexity.ORDER])) for k in range(0, len(raw)))
        assert abs(one[i]["log_likelihood"] - want) < 1e-6
    limit = max(one[i]["perplexity"] for i in held)
    assert all(abs(r["threshold"] - limit) < 1e-9 for r in found)


def test_quality_of_odd_tables(spark):
    docs, labels = table(spark, quality_rows(3)), spark.createDataFrame([], "doc_id long, quality int")
    bare = perplexity.quality(docs, labels).collect()
    assert len(bare) == 9 and all(r["kept"] and r["threshold"] is None for r in bare)
    assert perplexity.quality(table(spark, []), labels).count() == 0


def test_languages_have_their_own_thresholds(spark):
    docs = table(spark, quality_rows()).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "xx").when(F.col("doc_id") % 3 == 1, F.lit(None)).otherwise("yy"))
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    found = perplexity.quality(docs, labels).collect()
    assert len({r["threshold"] for r in found}) == 3 and len({(r["lang"], r["threshold"]) for r in found}) == 3


def test_toxicity_on_held_out_texts():
    bad = ["rascal", "scoundrel", "villain", "blackguard", "wretch"]
    texts = []
    for i in range(400):
        w = sentence(1000 + i, 80).split()
        if i % 4 == 0:
            for k in range(4):
                w[7 + 17 * k] = bad[(i // 4 + k) % len(bad)]
        texts.append((" ".join(w), int(i % 4 == 0)))
    model = toxicity.train(texts[:300])
    right = sum((model.score(t) >= 0.5) == bool(y) for t, y in texts[300:])
    assert right >= 98
    assert 0 <= model.score(None) < 0.5 and model.score("") == model.score(None) and 0 <= model.score("w" * 100_000) <= 1
    assert toxicity.train([]).score("x") == 0.0


def test_ordinary_dictionary_sees_whole_texts(monkeypatch):
    texts, given_ = [(sentence(i, 150), int(i % 3 == 0)) for i in range(30)], []
    monkeypatch.setattr(toxicity, "train_dictionary", lambda samples: given_.append(samples) or b"\n".join(samples)[-5000:])
    toxicity.train(texts)
    ordinary = [t for t, y in toxicity.distinct_texts(texts) if not y][::2]
    assert b" ".join(given_[1]).split() == " ".join(ordinary).encode().split()


def test_toxicity_keeps_columns_and_rows(spark):
    model = toxicity.train([])
    assert toxicity.score(table(spark), model).count() == len(TEXTS)
    assert toxicity.without_toxic(table(spark), model).columns == table(spark).columns


def test_toxicity_with_one_class_or_clashing_names(spark):
    model = toxicity.train([("all bad words", 1), ("more bad ones", 1)])
    docs = table(spark).withColumn("score", F.lit(0.9)).withColumn("whole", F.lit(1))
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
    assert toxicity.without_toxic(table(spark, []), model).count() == 0


# 8: repeated strings -------------------------------------------------------------------------


def brute_repeats(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(b[s : s + length])
        out.append((str(i), len(b), int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out)


@pytest.mark.parametrize(("block", "flush"), [(1 << 20, 1 << 20), (700, 50)])
def test_repeated_strings(spark, monkeypatch, block, flush):
    monkeypatch.setattr(substrings, "BLOCK", block)
    monkeypatch.setattr(substrings, "FLUSH", flush)
    rows = [*TEXTS, (30, "ab" * 200), (31, "x" * 99 + "ab" * 60), (32, LONG[100:900] + "é" * 80 + LONG[500:1500]), (33, BASE + BASE)]
    rows = [r for r in rows if r[0] != 12] + [(12, sentence(4, 30))]
    found = substrings.removed_spans(stored(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], sum(b - a for a, b in zip(r["first"], r["last"], strict=True)), bytes(r["kept"])) for r in found) == brute_repeats(rows)


def test_repeated_strings_of_nothing(spark):
    assert substrings.removed_spans(table(spark, [])).count() == 0


# 10: WARC ------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    long = "é" * 300
    pages = [(1, "u", long), (2, "v\r\nX: 1", long), (3, "w", "short"), (4, "x", "short"), (5, None, None), (None, "n", long), (6, "y", "z" * 100_000), (6, "y", "z" * 100_000), (7, "", "\r\n\r\n")]
    rows = spark.createDataFrame([(i, u, h, 1) for i, u, h in pages], "page_id long, url string, html string, digest int")
    folder = new_folder(spark, "warc")
    parts = [r["part"] for r in warc.write_archives(rows, folder).collect()]
    found = warc.read_archives(spark, folder, parts).collect()
    assert len(found) == len(pages)
    by = {}
    for r in found:
        by.setdefault(r["page_id"], []).append((r["payload_bytes"], r["record_type"], r["refers_to"]))
    assert by[1] == [(600, "response", None)] and by[2] == [(600, "revisit", 1)] and by[None] == [(600, "revisit", 1)]
    assert by[3] == by[4] == [(5, "response", None)] and by[5] == [(0, "response", None)]
    assert sorted(by[6], key=str) == sorted([(100_000, "response", None), (100_000, "revisit", 6)], key=str)
    assert {r["payload_digest"] for r in found if r["page_id"] == 1} == {hashlib.sha256(long.encode()).hexdigest()}


def test_warc_reader_refuses_damage():
    good = warc.page_record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), False, None)
    assert [x[0] for x in warc.read_records(io.BytesIO(good + good))] == [1, 1]
    assert gzip.decompress(good).startswith(b"WARC/1.1\r\n")
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(good[:-12])))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(gzip.compress(gzip.decompress(good).replace(b"payload", b"paYload")))))


def warc_record(kind, http, payload, **fields):
    listed = [("WARC-Type", kind), *((k.replace("_", "-"), v) for k, v in fields.items())]
    return warc.record(listed, http + b"\r\n\r\n" + payload)


def test_warc_reader_takes_the_usual_forms():
    import base64

    raw, head = b"<p>payload</p>", b"HTTP/1.1 200 OK\r\nServer: x"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
    good = warc_record("response", head, raw, WARC_Payload_Digest=sha1) + warc_record("response", head, raw)
    good += warc_record("revisit", head, b"", WARC_Payload_Digest=sha1) + warc_record("response", head, raw, WARC_Payload_Digest="other:1")
    want = (None, len(raw), hashlib.sha256(raw).hexdigest(), "response", None, raw)
    found = list(warc.read_records(io.BytesIO(good)))
    assert found == [want, want, (None, None, sha1, "revisit", None, None), want]
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(warc_record("response", head, b"other", WARC_Payload_Digest=sha1))))


# The pipeline ----------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = [r for r in TEXTS if r[0] is not None and r[0] != 12] + [(40 + i, edited(i, BASE, i % 3)) for i in range(6)]
    data = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, " ".join(LONG.split()[50:62]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    texts = dict(rows)
    kept = [r for r in rows if str(r[0]) in {x[0] for x in brute_exact(rows) if x[0] == x[1]}]
    kept = [(int(i), texts[int(i)]) for i, _, c in brute_near(kept, 5) if i == c]
    clean = {int(x[0]) for x in brute_contamination(kept, items) if not x[4]}
    assert found == {i: texts[i] or "" for i in clean}
