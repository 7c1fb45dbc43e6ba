import math
import random

from orogen.llm import topk


def plain(rows, k, every):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in kept if i % every == 0}):
        own = min(v for i, v in kept if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in kept if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "SHARD", 2)
    r = random.Random(1)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + r.gauss(0, 0.2) for c in r.choice(centres)]) for i in range(150)]
    rows += [(i, [0.5] * 6) for i in range(200, 240)]  # ties
    rows += [(300, None), (301, [None] * 6), (302, [float("nan")] + [0.0] * 5), (304, [float("inf")] * 6), (None, [1.0] * 6), (3, [9.0] * 6), (3, [9.0] * 6), (20, [0.0] * 6), (400, [1.0, 2.0]), (401, []), (420, [3e6] * 6), (421, [2e6] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = sorted(tuple(x) for x in topk.top_k(df, 5, 20).collect())
    assert got == plain(rows, 5, 20)
    assert topk.top_k(df.limit(0), 5, 20).count() == 0
    assert topk.top_k(df.where("vec_id = 40"), 5, 20).count() == 0


def test_blocks_below_the_kth_score_are_not_scored(monkeypatch):
    import numpy as np

    own = [topk._pack(np.arange(10) + 10 * b, np.full((10, 4), v)) for b, v in enumerate((50, 1, -3, 2))]
    seen = []
    unpack = topk.products
    monkeypatch.setattr(topk, "products", lambda a, b: seen.append(int(b[0, 0])) or unpack(a, b))
    found = topk.search_shard(np.array([[1, 1, 1, 1]]), np.array([1000]), own, 5)
    assert seen == [50] and found[0][0].tolist() == [0, 1, 2, 3, 4] and found[0][1].tolist() == [200] * 5


def test_ties_of_negative_and_of_very_large_scores(spark, monkeypatch):
    """The kth score equals the bounds of blocks that come later; their smaller ids must still win."""
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "SHARD", 64)
    near = [(10_001 + i, [-1000.0, 5.0]) for i in range(60) if (10_001 + i) % 20] + [(1 + i, [-1000.0, -5.0]) for i in range(60) if (1 + i) % 20]
    for query in ([1000.0, 0.0], [-1000.0, 0.0], [2.0**40, 0.0], [-(2.0**40), 2.0**40 + 1]):
        rows = [(20, query), *near]
        got = sorted(tuple(x) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 20).collect())
        assert got == plain(rows, 20, 20)


def test_bounds_hold():
    import numpy as np

    r = np.random.default_rng(3)
    for scale in (1, 1 << 10, 1 << 20, 1 << 27):
        q, block = r.integers(-scale, scale + 1, (9, 6)), r.integers(-scale, scale + 1, (30, 6))
        bounds = topk._bounds(q, block.max(axis=0)[None], block.min(axis=0)[None])[:, 0]
        exact = [sum(max(int(x) * int(h), int(x) * int(low)) for x, h, low in zip(row, block.max(axis=0), block.min(axis=0))) for row in q]
        assert all(b >= e for b, e in zip(bounds, exact))
