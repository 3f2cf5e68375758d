import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphlode.llm import packing, tokens

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def public():
    with open(tokens.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = ["", None, " ", "\n\n", "it's 'tis  '  's 'S\n's \n 's x'll''re '''ve'v", "a　 b\n\n c", "\r\n'll", "'", "x'", "x'l", "x'lls's't", "<|endoftext|>", "日本語の文 です。", "é́ 👩‍👩‍👧 ½ ² Ⅷ", "x" * 60_000, " " * 5_000 + "y", "\x1c\x1d\x85  z", "1 22 333", "don't  stop\t\tnow"]


def test_hard_texts(public):
    counts, ids = tokens.encode_texts(HARD, tokens.default_vocabulary())
    at = 0
    for text, n in zip(HARD, counts):
        assert ids[at : at + n].tolist() == public.encode_ordinary(text or "")
        assert tokens.decode_ids(ids[at : at + n].tolist()) == (text or "")
        at += n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tstrevlldm's1."), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_any_texts(texts):
    with open(tokens.default_vocabulary(), "rb") as f:
        pass
    public = any_public()
    counts, ids = tokens.encode_texts(texts, tokens.default_vocabulary())
    assert ids.tolist() == [i for t in texts for i in public.encode_ordinary(t)] and counts.tolist() == [len(public.encode_ordinary(t)) for t in texts]


_cache = []


def any_public():
    if not _cache:
        with open(tokens.default_vocabulary(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _cache.append(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return _cache[0]


def test_merges_follow_the_ranks(public):
    """The cached merges against a plain merge of the least-ranked pair."""
    with open(tokens.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    def merge(piece):
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    cache = tokens.pieces_of(tokens.default_vocabulary())
    for piece in (" tokenizer", "antidisestablishmentarianism", " 0x7f", "日本", "''''", " qwxzjk"):
        at = cache[piece]
        flat, length, offset = cache.arrays()
        assert flat[offset[at] : offset[at] + length[at]].tolist() == merge(piece.encode())


def test_operator_keeps_rows_and_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a b", [9]), (1, "a b", [9]), (2, None, None), (None, "x", None), (4, "", None)], "doc_id long, text string, ids array<int>")
    got = sorted(((r["doc_id"], list(r["ids"])) for r in tokens.encode(df).collect()), key=str)
    assert len(got) == 5 and (2, []) in got and (4, []) in got and [x for x in got if x[0] == 1][0] == [x for x in got if x[0] == 1][1]
    assert tokens.encode(df.limit(0)).count() == 0 and tokens.count_tokens(df).where("n_tokens = 0").count() == 2


@pytest.mark.parametrize("seed", range(60))
def test_packing_is_whole_and_tight(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 20, 50, 2048])
    have = {}
    for _ in range(r.randrange(0, 300)):
        s = r.choice([r.randrange(1, capacity), r.randrange(1, max(2, capacity // 5))])
        have[s] = have.get(s, 0) + r.choice([1, 1, 5, 100])
    plan, n = packing.solve(dict(have), capacity)
    load, spans = [0] * n, {}
    for size, a, b, first, copies in plan.tolist():
        spans.setdefault(size, []).append((a, b))
        for rank in range(a, b):
            load[first + (rank - a) // copies] += size
    assert all(0 < x <= capacity for x in load)
    for size, count in have.items():
        runs = sorted(spans[size])
        assert runs[0][0] == 0 and runs[-1][1] == count and all(x[1] == y[0] for x, y in zip(runs, runs[1:]))
    # first fit decreasing of the same items never needs fewer
    room = []
    for s in sorted((s for s, c in have.items() for _ in range(c)), reverse=True)[:3000]:
        k = next((i for i, x in enumerate(room) if x >= s), None)
        room.append(capacity - s) if k is None else room.__setitem__(k, room[k] - s)
    if sum(have.values()) <= 3000:
        assert n <= len(room) + 1


def test_exact_pairs_are_fixed():
    have = {3: 2, 7: 5, 5: 3, 9: 1}
    fixed = packing.reduce_instance(have, 10)
    assert ({3: 1, 7: 1}, 2) in [(p.items, p.count) for p in fixed] and ({5: 2}, 1) in [(p.items, p.count) for p in fixed] and ({9: 1}, 1) in [(p.items, p.count) for p in fixed]


def test_pack_rows(spark):
    rows = [(i, "a b c " * n) for i, n in enumerate([1, 2, 3, 50, 0, 7])] + [(90, None), (91, ""), (None, "x y")] + [(i, "same text") for i in range(100, 140)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("container", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("q"))
    got = packing.pack(df, capacity=20).toPandas()
    assert set(got.doc_id) == {r[0] for r in rows if r[0] is not None}
    assert got.groupby("container").n_tokens.sum().max() <= 20
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df.where("doc_id is not null")).collect()}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == counts
    split = got[got.doc_id == 3].sort_values("piece")
    assert list(split.first_token) == [20 * i for i in range(len(split))] and (got[~got.doc_id.isin([3, 5])].groupby("doc_id").size() == 1).all()
    assert packing.pack(df.limit(0)).count() == 0
