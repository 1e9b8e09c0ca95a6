"""Every stage on a table of nulls, repeats, long texts, clashing names, and on an empty one."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from test_near_dedup import brute
from tokenizers import Tokenizer

from postloom.llm.mixing import resharing
from postloom.llm.queries import tokenizer_file

CLASH = ("mix_size", "mix_copy", "mix_copies", "gone_id", "gone_h", "key", "h", "kept", "row", "size", "pattern", "a.b")
RNG = random.Random(11)
WORDS = ["the", "cat", "sat", "on", "a", "mat", "and", "looked", "at", "all", "of", "them"]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = [prose(RNG.randint(20, 60)) for _ in range(30)]
    near = [t + " " + prose(2) for t in base[:6]]
    texts = [*base, *near, *base[:5], None, "", " \t", "few words", prose(4000), "long " * 3000]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 4 % 3], i) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], rows[31], (None, base[7], "en", "s1", 1), (None, None, None, None, None), (4, "another text under one id", "en", "s2", 0)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASH)
    return spark.createDataFrame([(*r, *(k * 100 if r[0] is None or k % 2 else None for k in range(len(CLASH)))) for r in rows], kinds).repartition(3).cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, 1, 0) for i in range(36)] + [(None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def counted(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_keeps_columns_and_rows(spark, docs, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    none = stage(spark, docs.limit(0), folder)
    out = stage(spark, docs, folder)
    assert none.count() == 0 and none.columns == out.columns
    if name == "best_fit_packing":
        return packed(docs, out)
    assert out.columns == docs.columns
    before, after = counted(docs), counted(out)
    assert all(n <= (2 if name == "mix_sources" else 1) * before[r] for r, n in after.items())
    rows = [(r[0], r[1]) for r in before.elements()]
    if name == "quality_classifier":
        assert all(r[1] for r in after) and len(rows) > sum(after.values()) > 0.6 * len(rows)
        assert all(after[r] in (0, n) for r, n in before.items())
    if name == "exact_dedup":
        keep = {}
        for i, t in rows:
            keep[t or ""] = max(keep.get(t or "", (False, 0)), (i is not None, i or 0))
        assert Counter((t or "", i) for i, t, *_ in after.elements()) == Counter({(t, i if ok else None): 1 for t, (ok, i) in keep.items()})
    if name == "near_dedup":
        ids = {}
        for i, t in rows:  # rows are known by id and text, a null id is the least
            ids.setdefault((-1 if i is None else i, t), len(ids))
        order = {k: n for n, k in enumerate(sorted(ids, key=lambda x: (x[0], x[1] is not None, x[1] or "")))}
        least = brute([(order[k], k[1]) for k in order])
        groups = defaultdict(set)
        for k, n in order.items():
            groups[least[n]].add(k)
        kept = {(-1 if i is None else i, t) for i, t, *_ in after}
        for group in groups.values():
            assert [i for i, _ in group & kept] == [min(i for i, _ in group)]
        assert all(after[r] in (0, n) for r, n in before.items())
    if name == "mix_sources":
        size = lambda r: len((r[1] or "").split())
        of = defaultdict(int)
        for r, n in before.items():
            of[r[3]] += n * size(r)
        names = sorted(of, key=lambda s: (s is None, s))
        targets = dict(zip(names, resharing([of[s] for s in names], [3.0, 1.0, 2.0]), strict=True))
        for s, target in targets.items():
            taken = sum(n * size(r) for r, n in after.items() if r[3] == s)
            base = int(target // of[s])
            left = [size(r) for r, n in before.items() if r[3] == s and size(r) and after[r] < (base + 1) * n]
            assert abs(taken - target) <= max(min(left, default=0) / 2, 3)


def packed(docs, out):
    tok = Tokenizer.from_file(tokenizer_file())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(r["doc_id"], k // 2048, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))] += 1
    rows = out.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 2048
