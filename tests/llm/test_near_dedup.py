"""Near-duplicates at a shingle similarity of 0.8 against brute force."""

import random

import corpus_pipeline
import pytest

from postloom.llm.shingles import shingle_duplicates

RNG = random.Random(3)


def grams(text):
    parts = (text or "").lower().split()
    return {" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def brute(rows):
    """The smallest id of every row's component by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or (a | b and len(a & b) / len(a | b) >= 0.8):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def edited(words, edits):
    words = list(words)
    for _ in range(edits):
        words[RNG.randrange(len(words))] = f"new{RNG.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    out = [None, "", " \n", "one two", "One  two", "one two three"]
    for _ in range(40):
        base = [f"w{RNG.randrange(5000)}" for _ in range(RNG.randint(60, 400))]
        out += [" ".join(base), *(edited(base, RNG.randint(1, max(2, len(base) // 40))) for _ in range(3))]
    base = [f"w{RNG.randrange(5000)}" for _ in range(150)]
    out += [edited(base, RNG.randint(1, 5)) for _ in range(80)]  # one large group, in part only linked through others
    RNG.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("block", "rounds"), [(2048, (1, 4, 16)), (7, (1,))])
def test_components(spark, rows, block, rounds):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in shingle_duplicates(docs, block=block, rounds=rounds).collect()}
    assert got == brute(rows)
    assert shingle_duplicates(docs.limit(0)).count() == 0


def test_stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect())
    assert got == sorted(set(brute(rows).values()))
