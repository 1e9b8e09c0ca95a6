"""Each language with enough labelled rows keeps its own sample and threshold."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import quality


def test_rare_language_keeps_its_threshold(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat"]) for _ in range(20)), "en") for i in range(2000)]
    rows += [(i, " ".join(rng.choice(["kissa", "istui", "matolla", "hyvin", "kauan"]) for _ in range(20)), "fi") for i in range(2000, 2150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    sample = {r["label_id"]: r["fit"] for r in quality.trusted_sample(labels, docs, 120).collect()}
    assert Counter("fi" if i >= 2000 else "en" for i in sample) == {"en": 120, "fi": 120}
    got = quality.score_quality(docs, labels, fit_rows=120).collect()
    held = {lang: [r["perplexity"] for r in got if r["lang"] == lang and sample.get(r["doc_id"]) is False] for lang in ("en", "fi")}
    wide = np.quantile([p / np.median(x) for x in held.values() for p in x], 0.995)
    for lang, x in held.items():
        want = (len(x) * np.quantile(x, 0.995) + quality.POOLED_ROWS * np.median(x) * wide) / (len(x) + quality.POOLED_ROWS)
        assert next(r for r in got if r["lang"] == lang)["threshold"] == pytest.approx(1.05 * want)


def test_thresholds_of_few_rows(spark):
    rows = [(i, "a", 10.0 + i % 5) for i in range(200)] + [(300, "b", 50.0), (301, "b", 52.0), (302, "b", 52.0)]
    got = {r["lang"]: (r["t"], r["t_all"]) for r in quality.thresholds(spark.createDataFrame(rows, "doc_id long, lang string, perplexity double"), 0.995).collect()}
    assert 13.9 < got["a"][0] < 14.5 and 52 < got["b"][0] < 65 and got["a"][1] == got["b"][1]


def slow_scores(trusted, asked, order):
    """Perplexity under interpolated modified Kneser-Ney by definition, of texts as bytes."""
    grams = lambda t: [(b"\xff" * (order - 1) + t)[i : i + order] for i in range(len(t))]
    counts = {order: Counter(g for t in trusted for g in grams(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    heads, off = {}, {}
    for k, c in counts.items():
        n = [sum(v == m for v in c.values()) for m in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        off[k] = [min(max((m - (m + 1) * y * n[m] / n[m - 1]) if n[m - 1] else 0.5 * m, 0.05 * m), 0.95 * m) for m in (1, 2, 3)]
        heads[k] = {}
        for g, v in c.items():
            total, freed = heads[k].get(g[:-1], (0, 0.0))
            heads[k][g[:-1]] = (total + v, freed + off[k][min(v, 3) - 1])

    def p(g):
        if not g:
            return 1 / 256
        k, lower = len(g), p(g[1:])
        if g[:-1] not in heads[k]:
            return lower
        total, freed = heads[k][g[:-1]]
        own = counts[k].get(g, 0)
        return ((own - off[k][min(own, 3) - 1] if own else 0) + freed * lower) / total

    return [math.exp(-sum(math.log(p(g)) for g in grams(t)) / len(t)) if t else None for t in asked]


def test_perplexities_and_thresholds_by_definition(spark):
    rng = random.Random(8)
    words = {"en": ["the", "cat", "sat", "on", "a", "mat"], "fi": ["kissa", "istui", "matolla"], "": ["x", "yz"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(12)), lang or None) for i, lang in enumerate(["en", "fi", ""] * 20)]
    rows += [(i, text, "en") for i, text in enumerate(["", None, "zq 9# zq", "the cat sat " * 400, "kissa"], 100)]
    docs = spark.createDataFrame([(*r, 1.0, True) for r in rows], "doc_id long, text string, lang string, perplexity double, fit boolean").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(41, 0, 0), (42, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    sample = {r["label_id"]: r["fit"] for r in quality.trusted_sample(labels, docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))).collect()}
    assert set(sample) == set(range(40))
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    text = {i: (t or "").encode() for i, t, _ in rows}
    want = dict(zip(text, slow_scores([text[i] for i, fit in sample.items() if fit], text.values(), quality.ORDER), strict=True))
    assert all(got[i]["perplexity"] == (pytest.approx(want[i]) if want[i] else None) for i in text)
    lang = {i: x or "" for i, _, x in rows}
    held = {x: [want[i] for i, fit in sample.items() if not fit and lang[i] == x] for x in words}
    wide = np.quantile([p / np.median(x) for x in held.values() for p in x], 0.995)
    for i, x in lang.items():
        n, own = len(held[x]), np.quantile(held[x], 0.995)
        limit = 1.05 * (n * own + 40 * np.median(held[x]) * wide) / (n + 40)
        assert got[i]["threshold"] == pytest.approx(limit)
        assert got[i]["accepted"] == (want[i] is not None and want[i] <= limit * (1 + 1e-12))
