"""Near-duplicates of the pipeline are proposed by SimHash: fingerprints, probes and links by definition, recall by similarity."""

import corpus_pipeline
import numpy as np
import pytest

from postloom.llm import set_simhash, shingles

P, MISS = set_simhash.differing(0.8), 4e-4


def pair(rng, n, e):
    """Two sets of n with e of each replaced: similarity (n - e) / (n + e)."""
    a = rng.integers(0, 1 << 64, n, np.uint64)
    return a, np.concatenate((a[e:], rng.integers(0, 1 << 64, e, np.uint64)))


def by_definition(grams, words, seed=42):
    turn, times, again = ([int(x) for x in c[:, 0]] for c in set_simhash._turns(words, seed))
    out, low = [], (1 << 64) - 1
    for w in range(words):
        hashes = []
        for h in grams.tolist():
            x = ((h ^ turn[w]) * times[w]) & low
            x = ((x ^ (x >> 32)) * again[w]) & low
            hashes.append(x ^ (x >> 32))
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 700])
def test_fingerprint(n):
    grams = np.random.default_rng(n).integers(0, 1 << 64, n, np.uint64)
    assert set_simhash.fingerprint(grams, 3).tolist() == by_definition(grams, 3)


@pytest.mark.parametrize("n", [250, 41_000, 205_000, 12_000_000])
def test_probes_find_the_similarity(n):
    words, parts = set_simhash.width_for(n, P, MISS)
    both = np.full((words, 64, 64), n * 0.25)
    for w in range(words):
        np.fill_diagonal(both[w], n * 0.5)
    probes = set_simhash.choose_probes(n, both, parts, P, MISS)
    word, mask = np.array([w for w, m in probes for _ in m]), np.array([x for _, m in probes for x in m], np.uint64)
    rng, missed = np.random.default_rng(5), 0
    for _ in range(300):
        x, y = (set_simhash.fingerprint(s, words) for s in pair(rng, 180, 20))
        shares = bool((((x[word] ^ y[word]) & mask) == 0).any())
        missed += not (shares and set_simhash.apart(x[0], x[1], y[0], y[1]) <= set_simhash.radius_of(P))
    assert missed <= 2


def test_stars():
    rng = np.random.default_rng(2)
    f, g = rng.integers(0, 1 << 64, (2, 600), np.uint64)
    for k in range(1, 300):  # chains and groups, some longer than a step
        at = int(rng.integers(0, k))
        f[k] = f[at] ^ np.uint64(1 << int(rng.integers(0, 64))) if k % 5 else f[k]
        g[k] = g[at] if k % 5 else g[k]
    node = rng.permutation(600) - 300
    near = set_simhash.apart(f[:, None], g[:, None], f[None], g[None]) <= 3
    for side in (np.zeros(600, int), rng.integers(0, 2, 600)):
        label, asked = np.arange(600), near & ((side[:, None] != side[None]) | (not side.any()))
        for _ in range(600):
            new = np.array([min(label[asked[i]].min(initial=label[i]), label[i]) for i in range(600)])
            if (new == label).all():
                break
            label = new
        want = {int(node[label == x].min()): set(node[label == x].tolist()) for x in set(label.tolist()) if (label == x).sum() > 1}
        got = {}
        for a, b in set_simhash.stars(node, f, g, side, 3, step=64):
            got.setdefault(a, {a}).add(b)
        assert got == want


def test_stage_links_by_simhash(spark, monkeypatch):
    asked, links = [], shingles.candidate_links
    monkeypatch.setattr(shingles, "candidate_links", lambda *a, **b: asked.append(1) or links(*a, **b))
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(reversed(words)), " ".join(words[:30])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2, 3]
    assert asked == [1]
