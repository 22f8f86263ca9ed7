import math

import numpy as np
import pytest

from tessera.llm import embeddings


def brute(rows, threshold=0.9):
    """Row by row: links and component by all pairs in double precision."""
    def unit(v):
        if not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            return None
        x = np.array(v, float)
        x = x / np.abs(x).max()
        return x / np.sqrt((x * x).sum())

    units = [unit(v) for _, v in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in range(n)]
    root = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([root[i], *(root[j] for j in near[i])])
            if low < root[i]:
                root[i], changed = low, True
    return sorted((rows[i][0], len(near[i]), root[i]) for i in range(n))


@pytest.mark.parametrize("block", [1024, 8])
def test_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "MISS", 1e-6)
    rng = np.random.default_rng(7)
    base = rng.standard_normal((6, 16))
    rows = [(i, (base[i % 6] + rng.standard_normal(16) * (0.02 + 0.12 * (i % 5))).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(60)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, [2 * x for x in rows[0][1]]), (303, None), (304, []), (305, [0.0] * 16), (306, [float("nan")] * 16), (307, [None, *rows[0][1][1:]])]
    rows += [(308, [float("inf"), *rows[0][1][1:]]), (309, rows[0][1][:8]), (310, [1e30] + [0.0] * 15), (311, [1e-30] + [0.0] * 15), (300, rows[0][1])]
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, label int, id int, w int")
    got = embeddings.near_duplicates(df.repartition(3)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_recall_planned():
    for rows in (1, 1000, 10**6, 10**10):
        bits, tables = embeddings.shape(rows, 0.9)
        assert (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables <= embeddings.MISS


def test_repeated_ids(spark):
    """One id on several vectors: links and components by row, as by all pairs."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((5, 16))
    rows = []
    for k in range(120):
        v = base[k % 5] + rng.standard_normal(16) * 0.05 if k % 3 else rng.standard_normal(16)
        rows.append((int(rng.integers(0, 12)), v.astype(np.float32).tolist()))
    rows += [rows[0], (3, rows[1][1]), (4, None)]
    numbered = brute([(n, v) for n, (_, v) in enumerate(rows)])
    least = {}
    for n, _, c in numbered:
        least[c] = min(least.get(c, 99), rows[n][0])
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "vec_id bigint, embedding array<float>")
    got = embeddings.near_duplicates(df.repartition(3)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None) == sorted((rows[n][0], k, least[c]) for n, k, c in numbered)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


def test_screen():
    """Sketches let pairs at the threshold pass."""
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((2, 4000, 64))
    a = embeddings.unit(a)
    b = embeddings.unit(b - (a * b).sum(1, keepdims=True) * a)
    x = np.concatenate([a, 0.9 * a + math.sqrt(1 - 0.81) * b])
    s = embeddings.signs(x, embeddings.SIGNS, 2)
    apart = (s[:4000] != s[4000:]).sum(1)
    assert (apart > embeddings.most_apart(0.9)).mean() < 0.004
