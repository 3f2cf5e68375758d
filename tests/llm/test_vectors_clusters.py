import datetime as dt
import math
import random

import numpy as np
import pytest

from graphlode.llm import clusters, vectors

DIM = 16
SCHEMA = "id string, embedding array<float>, indexed_at timestamp, vec string, cell int, place int"


def sample(seed=0, groups=25, n=6, noise=0.12):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        c = rng.normal(size=DIM)
        c /= np.linalg.norm(c)
        for k in range(rng.integers(1, n)):
            rows.append((f"g{g:03d}_{k}", (c + rng.normal(size=DIM) * noise / 2) * rng.uniform(0.1, 9)))
    rows += [(f"r{k:03d}", rng.normal(size=DIM)) for k in range(60)]
    rows += [(f"same{k:02d}", np.ones(DIM) * (k + 1)) for k in range(12)]
    return {a: np.asarray(b, np.float32) for a, b in rows}


def frame(spark, data):
    t = dt.datetime(2025, 1, 1)
    old = dt.datetime(2020, 1, 1)
    rows = [(k, [float(x) for x in v], t, "x", 1, 2) for k, v in data.items()]
    rows += [(k, [float(x) for x in -v], old, "x", 1, 2) for k, v in list(data.items())[:5]]  # older states
    rows += rows[:3]
    rows += [("null", None, t, "x", 1, 2), ("empty", [], t, "x", 1, 2), ("short", [1.0], t, "x", 1, 2), ("zero", [0.0] * DIM, t, "x", 1, 2), ("nan", [math.nan] * DIM, t, "x", 1, 2), (None, [1.0] * DIM, t, "x", 1, 2)]
    return spark.createDataFrame(rows, SCHEMA)


def cosines(data):
    ids = sorted(data)
    x = np.array([data[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    return ids, s


def unions(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        p[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 40])
def test_clusters_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    data = sample()
    ids, s = cosines(data)
    label = unions(len(ids), zip(*np.nonzero(np.triu(s >= 0.8))))
    want = {(ids[label[i]], ids[i]) for i in range(len(ids)) if label.count(label[i]) >= 3}
    members, points = clusters.cluster_vectors(frame(spark, data), dim=DIM)
    assert {tuple(r) for r in members.collect()} == want
    d = {r["cluster_key"]: r for r in clusters.describe_vectors(members, points, DIM).collect()}
    assert sum(r["size"] for r in d.values()) == len(want)
    key = next(k for k in d if d[k]["size"] >= 3 and not k.startswith("same"))
    own = [ids.index(m) for k, m in want if k == key]
    mean = {i: np.mean([s[i, j] for j in own if j != i]) for i in own}
    assert d[key]["medoids"][0] == ids[max(own, key=lambda i: (round(mean[i], 6), -i))]


@pytest.mark.parametrize("block", [4096, 40])
def test_neighbours_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    data = sample(3)
    ids, s = cosines(data)
    got = {}
    for r in vectors.most_similar(frame(spark, data), k=3, dim=DIM).collect():
        got.setdefault(r["id"], []).append((r["place"], r["other"]))
    hit = total = 0
    for i, name in enumerate(ids):
        best = [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-round(s[i, j], 6), ids[j]))[:3]]
        mine = [o for _, o in sorted(got.get(name, []))]
        assert len(mine) == 3 and name not in mine
        hit += len(set(best) & set(mine))
        total += 3
    assert hit / total >= 0.9
    assert [o for _, o in sorted(got["same05"])] == ["same00", "same01", "same02"] and [o for _, o in sorted(got["same00"])] == ["same01", "same02", "same03"]


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.CellIndex(x, 6000 * 60)
    assert len(index.centroids) > 4 * 32
    best, _ = index.search(index.reduce(x[:500]))
    true = (index.reduce(x[:500]) @ index.centroids.T).argmax(1)
    assert (best[:, 0] == true).mean() >= 0.9


@pytest.mark.parametrize("every", [False, True])
def test_no_number_of_lists_is_a_limit(every):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9000, 96)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.CellIndex(x, 9000 * 256)
    assert len(index.centroids) > 1000
    far = rng.normal(size=(300, 96)).astype(np.float32)
    d2 = np.maximum(0, 2 - 2 * index.reduce(far) @ index.centroids.T)
    within = np.sqrt(d2 / np.maximum(d2.min(1, keepdims=True), 1e-6)) <= 1.3
    row, cell, _, _ = index.lists(far, vectors.Reach(1.3, 1, every=every))
    assert within.sum(1).max() > 32
    assert set(zip(row.tolist(), cell.tolist())) >= set(zip(*(v.tolist() for v in np.nonzero(within & (within.sum(1) > 64)[:, None]))))
    if every:
        assert set(zip(row.tolist(), cell.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(within))))


def test_cells_with_lists_of_their_own(spark, monkeypatch):
    """A cell over the limit is split, and a split list over the block size is cut: the same clusters, recall over 0.9."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vectors, "LIST_ROWS", 16)
    data = sample(5, groups=60, n=9)
    ids, s = cosines(data)
    label = unions(len(ids), zip(*np.nonzero(np.triu(s >= 0.8))))
    want = {(ids[label[i]], ids[i]) for i in range(len(ids)) if label.count(label[i]) >= 3}
    members, _ = clusters.cluster_vectors(frame(spark, data), dim=DIM, split=50)
    assert {tuple(r) for r in members.collect()} == want
    near = vectors.most_similar(frame(spark, data), k=3, dim=DIM, split=50).collect()
    got = {(r["id"], r["other"]) for r in near}
    best = {(ids[i], ids[j]) for i in range(len(ids)) if not ids[i].startswith("same") for j in sorted(range(len(ids)), key=lambda j: (-round(s[i, j], 6), ids[j]))[:3]}
    assert len(best & got) / len(best) >= 0.9


def test_empty_and_tiny_tables(spark):
    empty = frame(spark, {}).where("id in ('null', 'zero')")
    assert vectors.most_similar(empty, dim=DIM).count() == 0 and clusters.cluster_vectors(empty, dim=DIM)[0].count() == 0
    one = frame(spark, {"a": np.ones(DIM, np.float32)})
    assert vectors.most_similar(one, dim=DIM).count() == 0
    two = frame(spark, {"a": np.ones(DIM, np.float32), "b": np.ones(DIM, np.float32)})
    assert {(r["id"], r["other"]) for r in vectors.most_similar(two, dim=DIM).collect()} == {("a", "b"), ("b", "a")}
    assert clusters.cluster_vectors(spark.createDataFrame([], SCHEMA), dim=DIM)[0].count() == 0


@pytest.mark.parametrize("block", [4096, 5])
def test_sets_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", block)
    r = random.Random(2)
    base = [[f"m{r.randrange(400)}" for _ in range(r.randrange(2, 12))] for _ in range(25)]
    rows = []
    for i in range(160):
        m = list(r.choice(base))
        for _ in range(r.randrange(0, 4)):
            m[r.randrange(len(m))] = f"m{r.randrange(400)}"
        r.shuffle(m)
        rows.append((f"c{i:03d}", m + m[:1] + [None], "x"))
    rows += [("null", None, "x"), ("empty", [], "x"), ("blank", [None], "x"), (None, ["m1"], "x"), rows[0], ("one1", ["z"], "x"), ("one2", ["z", "z"], "x"), ("one3", ["z"], "x")]
    sets = {i: {x for x in m if x} for i, m, _ in rows if i and m and any(m)}
    ids = sorted(sets)
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if 2 * len(sets[ids[a]] & sets[ids[b]]) >= len(sets[ids[a]] | sets[ids[b]])]
    label = unions(len(ids), pairs)
    want = {(ids[label[i]], ids[i]) for i in range(len(ids)) if label.count(label[i]) >= 3}
    df = spark.createDataFrame(rows, "id string, members array<string>, cell string")
    got = clusters.cluster_sets(df)
    assert {tuple(x) for x in got.collect()} == want
    d = clusters.describe_sets(got, df).collect()
    assert sum(x["size"] for x in d) == len(want) and all(x["medoids"] for x in d)
    assert clusters.cluster_sets(df.limit(0)).count() == 0
