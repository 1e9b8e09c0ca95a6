"""Benchmark search against brute force: short items, overlaps, whole words, long texts, several passes."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from postloom.llm import decontamination as dc
from postloom.llm.queries import op13_benchmark_decontamination

RNG = random.Random(3)
VOCAB = [f"w{i}" for i in range(40)] + ["É", "日本", "Don't", "a_b"]


def sentence(n, vocab=VOCAB):
    return " ".join(RNG.choice(vocab) for _ in range(n))


ITEMS = [(i, sentence(RNG.randint(11, 60))) for i in range(30)]
ITEMS += [(100, "W1 w2"), (101, "Unique"), (102, None), (103, ""), (104, "...!"), (105, sentence(9)), (106, sentence(10)), (5, "w3 w4 w5"), (None, "null item here"), (107, ITEMS[0][1]), (108, "z z z z z z z z z z z z")]
DOCS = [(i, sentence(RNG.randint(0, 80))) for i in range(60)]
for i in range(60, 110):
    t = RNG.choice([x for _, x in ITEMS if x]).split()
    lo = RNG.randint(0, max(0, len(t) - 9))
    DOCS.append((i, f"{sentence(RNG.randint(0, 30))} {' '.join(t[lo : lo + RNG.randint(5, 30)]).upper()}, {sentence(5)}"))
DOCS += [(200, None), (201, ""), (202, "unique"), (203, "uniquely un-unique"), (204, "w1,w2"), (205, "w1 w22"), (206, "z " * 40), (207, sentence(60_000) + " " + ITEMS[3][1] + " " + sentence(20)), (208, "null ITEM  here"), (61, DOCS[61][1]), (None, ITEMS[1][1])]


def words(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + m]), set()).add("" if i is None else str(i))
    lengths = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, own = words(t), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if (x := tuple(w[k : k + m])) in wins:
                    hit |= set(range(k, k + m))
                    own |= wins[x]
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def digests(found):
    return Counter((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r["spans"])) for r in found.collect())


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in DOCS], "doc_id long, text string, items string, h int").repartition(3)
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("pass_words", [1 << 18, 60])
def test_against_brute_force(frames, pass_words):
    assert digests(dc.find_benchmarks(*frames, pass_words=pass_words)) == brute(DOCS, ITEMS)


def test_passes_give_the_same_spans(frames):
    key = lambda r: (r["doc_id"] or -1, r["n_words"], r["spans"], r["items"])
    one, many = (sorted(map(key, dc.find_benchmarks(*frames, pass_words=n).collect())) for n in (1 << 18, 60))
    assert one == many


def test_empty_tables(frames):
    docs, items = frames
    assert dc.find_benchmarks(docs.limit(0), items).count() == 0
    assert digests(dc.find_benchmarks(docs, items.limit(0))) == brute(DOCS, [])


def test_shifts_never_pass_an_occurrence():
    rng = np.random.default_rng(0)
    for m in (1, 2, 3, 10):
        words_ = rng.integers(0, 4, 5000).astype(np.int32)
        patterns = rng.integers(1, 4, (30, m)).astype(np.int32)
        table = dc.Patterns(patterns, np.arange(30))
        ends, which = table.search(words_, np.array([0, 0, 17, 18, 2600, 5000]))
        bounds = [0, 0, 17, 18, 2600, 5000]
        want = {(e, tuple(p)) for p in patterns.tolist() for a, b in zip(bounds, bounds[1:]) for e in range(a + m - 1, b) if words_[e - m + 1 : e + 1].tolist() == p}
        assert {(e, tuple(table.patterns[p].tolist())) for e, p in zip(ends.tolist(), which.tolist())} == want


def test_query(spark, tmp_path, frames):
    frames[0].drop("items", "h").write.parquet(f"{tmp_path}/documents.parquet")
    frames[1].write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op13_benchmark_decontamination(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert Counter(tuple(r) for r in got.collect()) == brute(DOCS, ITEMS)
