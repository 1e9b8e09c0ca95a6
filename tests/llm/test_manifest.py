"""Merkle manifests against a plain tree: groups of many sizes, nulls, repeats, tampering, proofs."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postloom.llm import manifest
from postloom.llm.queries import op12_merkle_manifest

RNG = random.Random(5)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """The root and for each leaf its path of (before, after)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for p, k in zip(paths, at, strict=True):
            p.append(("".join(runs[k // 3][: k % 3]), "".join(runs[k // 3][k % 3 + 1 :])))
        level, at = [H(*r) for r in runs], [k // 3 for k in at]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        subs[s] = (own, *tree([leaf(*r) for r in own]))
    root, ups = tree([subs[s][1] for s in order])
    out = []
    for s, up in zip(order, ups, strict=True):
        own, sub, paths = subs[s]
        for r, p in zip(own, paths, strict=True):
            bad = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            done = leaf(*r[:4], r[4].replace("\n", "")) if bad else leaf(*r)
            for b, a in p + up:
                done = H(b, done, a)
            out.append((r[0], leaf(*r), sub, root, H(*(b + a for b, a in p + up)), done, done == root))
    return Counter(out)


SIZES = {"a": 1, "b": 2, "c": 3, "d": 4, "é": 9, None: 10, "": 28, "f": 82, "Z": 700}


def make(sizes):
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            text = RNG.choice([None, "", "one\ntwo", "plain", "日本\n\n" * 5])
            rows.append((i, s, RNG.choice(["en", None]), RNG.choice([None, 5, -1]), text))
            i += RNG.choice([1, 7])
    return rows


def frame(spark, rows, n=4):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, g int").repartition(n)


def digests(docs, **sizes):
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = manifest.manifest(docs, other={"tampered": {"text": changed}}, **sizes)
    out = out.withColumn("back", manifest.folded(F.col("tampered"), F.col("path"))).withColumn("proof", F.sha2(manifest.siblings(F.col("path")), 256))
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"], r["back"], r["back"] == r["root"]) for r in out.collect())


@pytest.mark.parametrize(("part_rows", "chunk_rows"), [(1 << 18, 1 << 14), (100, 7), (40, 1)])
def test_against_a_plain_tree(spark, part_rows, chunk_rows):
    rows = make(SIZES)
    rows += rows[5:8] + [rows[-1]] * 30 + [(None, "f", "en", 1, "no\nid"), (None, None, None, None, None)]
    assert digests(frame(spark, rows), part_rows=part_rows, chunk_rows=chunk_rows) == brute(rows)


def test_several_hops_of_levels(spark, monkeypatch):
    """With two levels a task, ragged nodes climb in several hops."""
    monkeypatch.setattr(manifest, "LEVELS", 2)
    rows = make({"hot": 900, **{f"s{k:03}": 1 + k % 3 for k in range(60)}})
    assert digests(frame(spark, rows), part_rows=90, chunk_rows=11) == brute(rows)


def test_one_row_and_none(spark):
    rows = [(1, "s", None, 2, "t\n")]
    assert digests(frame(spark, rows)) == brute(rows)
    assert manifest.manifest(frame(spark, rows).limit(0)).count() == 0


def test_query(spark, tmp_path):
    rows = make({"s1": 40, "s2": 5, None: 3})
    frame(spark, rows).drop("leaf", "g").write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)
