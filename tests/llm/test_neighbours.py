"""Nearest neighbours by the forest against brute force."""

import numpy as np
import pytest

from spanloom.llm.neighbours import fit, nearest

WANTED = "id % 20 = 0"


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(y) for y in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")


def brute(ids, x, k):
    out = {}
    for i, v in zip(ids, x):
        if i % 20 == 0:
            near = sorted((-float((v * w).sum()), int(j)) for j, w in zip(ids, x) if j != i)[:k]
            out[int(i)] = [(j, -s) for s, j in near]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("options", [{}, {"cell_rows": 100, "cell_queries": 7}, {"sample": 60, "leaf_rows": 30, "cell_rows": 50, "cell_queries": 5}, {"trees": 1, "k": 3}])
def test_all_leaves_give_the_exact_result(spark, options):
    """With a queue that takes every leaf nothing is lost: neither by cells, chunks and salts, nor among ties and copies."""
    rnd = np.random.default_rng(3)
    x = rnd.integers(-2, 3, (400, 6)).astype(float)  # many equal scores
    x[100:300] = x[100]  # half of all are copies
    x[(x == 0).all(1)] = 1
    ids = rnd.permutation(400)
    k = options.get("k", 20)
    got, want = found(nearest(table(spark, ids, x), WANTED, candidates=10 ** 9, **options)), brute(ids, x, k)
    assert got == want


def test_recall_on_uniform_vectors(spark):
    rnd = np.random.default_rng(4)
    x = rnd.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    got, want = found(nearest(table(spark, range(4000), x), WANTED, candidates=0)), brute(range(4000), x, 20)
    hits = [len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]
    assert got.keys() == want.keys() and np.mean(hits) > 0.9
    scores = {(q, j): s for q in got for j, s in got[q]}
    assert all(abs(s - float(x[q] @ x[j])) < 1e-12 for (q, j), s in scores.items())


def test_clustered_vectors_need_a_fixed_number_of_candidates(spark):
    """Forty clusters: a hundredth of the rows of each tree is enough, by ``candidates`` alone."""
    rnd = np.random.default_rng(5)
    x = np.repeat(rnd.standard_normal((40, 16)) * 5, 100, axis=0) + rnd.standard_normal((4000, 16)) * 0.3
    x /= np.linalg.norm(x, axis=1)[:, None]
    got, want = found(nearest(table(spark, range(4000), x), WANTED, share=0, candidates=800)), brute(range(4000), x, 20)
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]) > 0.9


def test_the_queue_is_shared_and_in_order():
    rnd = np.random.default_rng(6)
    x = rnd.standard_normal((500, 8))
    forest = fit(x, 3, 4)
    q = x[:5]
    margin = np.einsum("qd,tnd->qtn", q, forest.normal) - forest.offset
    cost = np.zeros((5, 3, 16))
    for leaf in range(16):
        node = leaf + 15
        while node:
            above = (node - 1) // 2
            m = margin[:, :, above]
            cost[:, :, leaf] += np.where((m > 0) != (node == 2 * above + 2), m * m, 0)
            node = above
    for i, taken in enumerate(forest.search(q, 20)):
        assert len(set(taken)) == 20
        assert np.allclose(np.sort(cost[i].reshape(-1))[:20], cost[i].reshape(-1)[taken])
