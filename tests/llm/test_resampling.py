"""Importance resampling against brute force: nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from postloom.llm import importance, words

RNG = random.Random(11)
WORDS = ["alpha", "Beta", "x1", "émile", "don't", "日本", "of", "THE", "a", "Été", "q\x00r", "s_t"]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


DOCS = [(i, sentence(RNG.randint(0, 70))) for i in range(120)]
DOCS += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, sentence(40_000)), (505, "ñ" * 300_000), (7, DOCS[7][1]), (7, DOCS[7][1]), (None, sentence(30))]
TARGET = [(1, "alpha of the x1 alpha of"), (2, None), (3, ""), (4, sentence(50))]


def words_in(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def runs(text):
    w = words_in(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def buckets(texts):
    return Counter(crc32(f.encode()) % 10_000 for t in texts for f in runs(t))


def brute(docs, target):
    s, t = buckets([x for _, x in docs]), buckets([x for _, x in target])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for i, text in docs:
        own = [crc32(f.encode()) % 10_000 for f in runs(text)]
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_in(text))])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = {id(r): k for k, r in enumerate(able[: 5 * len(able) // 100], 1)}
    return Counter((*r[:4], drawn.get(id(r))) for r in out)


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.createDataFrame([(i, t, "k", 3) for i, t in DOCS], "doc_id long, text string, rank string, weight long").repartition(5)
    return docs, spark.createDataFrame(TARGET, "item_id long, text string")


def test_against_brute_force(frames):
    got = importance.resample(*frames)
    rows = got.collect()
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows) == brute(DOCS, TARGET)
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 5 * sum(r["n_words"] >= 20 for r in rows) // 100 + 1))


def test_repeated_rows_each_have_a_rank(spark, frames):
    docs = spark.createDataFrame([(7, DOCS[7][1] + sentence(20))] * 100 + [(i, "z") for i in range(20)], "doc_id long, text string")
    ranks = [r["rank"] for r in importance.resample(docs, frames[1]).collect()]
    assert sorted(r for r in ranks if r) == [1, 2, 3, 4, 5] and len(ranks) == 120


def test_empty_tables(frames):
    docs, target = frames
    assert importance.resample(docs.limit(0), target).count() == 0
    got = importance.resample(docs, target.limit(0)).collect()
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got) == brute(DOCS, [])


def test_pieces_of_a_long_text_join_up():
    text = sentence(3000)
    whole = [Counter(np.concatenate([x for m, x in importance.features(text.encode(), piece=p) if m == n]).tolist()) for p in (50, 1 << 20) for n in (1, 2, 3)]
    assert whole[:3] == whole[3:]
    assert [w.decode() for part in words.words_of(text.encode(), 64) for w in part] == words_in(text)
