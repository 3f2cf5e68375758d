import random

import numpy as np
import pytest

from graphlode.llm import spans
from graphlode.llm.components import connected_components


def brute(texts, least):
    seen = {}
    for i, t in texts.items():
        for k in range(len(t or "") - least + 1):
            seen.setdefault(t[k : k + least], set()).add(i)
    shared = {w for w, ids in seen.items() if len(ids) > 1}
    out = {}
    for i, t in texts.items():
        cover = set()
        for k in range(len(t or "") - least + 1):
            if t[k : k + least] in shared:
                cover |= set(range(k, k + least))
        if cover:
            out[i] = len(cover)
    return out


def corpus(seed, alphabet="abcdefghij ", n=30):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    common = [word(r.randrange(20, 120)) for _ in range(5)]
    texts = {}
    for i in range(n):
        parts = [r.choice(common) if r.random() < 0.4 else word(r.randrange(5, 90)) for _ in range(r.randrange(0, 5))]
        texts[i] = "".join(parts)
    texts |= {100: texts[3], 101: texts[3], 102: "", 103: None, 104: "é" * 70, 105: "日本" + "é" * 61, 106: common[0][:40] if len(common[0]) >= 40 else common[0]}
    return texts


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot", [2, 4096])
def test_spans_match_brute_force(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(spans, "HOT_TEXTS", hot)
    texts = corpus(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumnsRenamed({})
    want = brute(texts, 40)
    assert {r["doc_id"] for r in spans.found(df, least=40, shingle=13).collect()} == set(want)
    if seed == 0:
        got = spans.spans(df, least=40, shingle=13).toPandas()
        assert dict(zip(got.doc_id, got.shared_chars)) == want
        assert set(got[got.doc_id.isin([100, 101])].share) == {1.0}


@pytest.mark.parametrize("hot", [2, 4096])
def test_links_count_every_other_text(spark, hot, monkeypatch):
    monkeypatch.setattr(spans, "HOT_TEXTS", hot)
    texts = corpus(0)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    least = 40
    stretches = {i: {t[k : k + least] for k in range(len(t) - least + 1)} for i, t in texts.items() if t and len(t) >= least}
    want = {i: len({texts[j] for j in stretches if texts[j] != texts[i] and stretches[i] & stretches[j]}) for i in brute(texts, least)}
    assert max(want.values()) > 2
    assert {r["doc_id"]: r["links"] for r in spans.spans(df, least=least, shingle=13).collect()} == want


def test_without_shuffle_limit_of_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spans, "BROADCAST_SIGNATURES", 0)
    texts = corpus(7)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in spans.found(df, least=40, shingle=13).collect()} == set(brute(texts, 40))


def test_edge_cases(spark):
    schema = "doc_id long, text string, signature long, w1 long"
    assert spans.found(spark.createDataFrame([], schema)).count() == 0
    r = random.Random(1)
    long = "".join(r.choice("abc def") for _ in range(200_000))
    rows = [(1, "x" * 500, 1, 1), (2, "y" + "x" * 230, 1, 1), (3, "x" * 199, 1, 1), (4, None, None, None), (None, "x" * 300, 1, 1), (5, long, 1, 1), (6, "q" + long[1000:1200] + "q", 1, 1), (7, "q" + long[5000:5199] + "#", 1, 1), (8, "q" * 250, 1, 1), (8, "q" * 250, 1, 1), (9, "z" * 100_000, 1, 1), (10, "z" * 220, 1, 1)]
    assert {r["doc_id"] for r in spans.found(spark.createDataFrame(rows, schema)).collect()} == {1, 2, 5, 6, 9, 10}
    with pytest.raises(ValueError):
        spans.found(spark.createDataFrame([], schema), least=10, shingle=20)


def test_components(spark):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, r.randrange(101, 200)) for _ in range(150)] + [(300, 300), (None, 4), (401, 400)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == {x: find(x) for x in list(parent)}
    assert connected_components(df.limit(0)).count() == 0


def test_equal_hashes_are_no_equal_text():
    """Stretches whose hashes agree are told apart by their characters."""
    texts = ["abcdefgh", "xabcdey", "abcdzfgh"]
    row = np.array([i for i, t in enumerate(texts) for _ in range(len(t) - 3)])
    offset = np.array([k for t in texts for k in range(len(t) - 3)])
    number = {}
    true = np.array([number.setdefault(texts[i][o : o + 4], len(number)) for i, o in zip(row, offset)], np.uint64)
    sign = np.zeros(len(row), np.int64)
    assert spans.same_characters(texts, sign, true, row, offset, 4)
    assert not spans.same_characters(texts, sign, np.zeros(len(row), np.uint64), row, offset, 4)
    wrong = true.copy()
    wrong[-1] = true[0]
    assert not spans.same_characters(texts, sign, wrong, row, offset, 4)
    assert spans.same_characters(texts, np.arange(len(row)), np.zeros(len(row), np.uint64), row, offset, 4)  # other signatures are other groups
    assert spans.same_characters([], sign[:0], true[:0], row[:0], offset[:0], 4)
