"""Cross-validated machines against plain Python: sums of losses and gradients, optima, scores of folds."""

import random

import numpy as np
import pytest

from reviewloom.operators import model as M


def table(spark, n=60, terms=9, seed=1):
    rng = random.Random(seed)
    weights = {(d, f"t{j}"): round(rng.uniform(0.1, 1), 3) for d in range(n) for j in range(terms) if rng.random() < 0.4 and d != 5}
    labels = {d: int(sum(w for (e, t), w in weights.items() if e == d and t in ("t0", "t3")) + rng.uniform(-0.3, 0.3) > 0.4) for d in range(n)}
    frames = (
        spark.createDataFrame([(d, t, w) for (d, t), w in weights.items()] + [(999, "t1", 0.5)], "doc_id long, term string, w double"),
        {"a": spark.createDataFrame([(f"t{j}", j + 1) for j in range(terms)], "term string, rank int"), "b": spark.createDataFrame([(f"t{j}", terms - j) for j in range(terms)] + [("none", 99)], "term string, rank int")},
        spark.createDataFrame(list(labels.items()), "doc_id long, cls int"),
    )
    return weights, labels, frames


def dense(weights, docs, order):
    return np.array([[weights.get((d, t), 0.0) for t in order] + [1.0] for d in docs])


@pytest.fixture(scope="module")
def small(spark):
    weights, labels, (w, rankings, y) = table(spark)
    rows = M.prefix_rows(w, list(rankings.values()), M.folds(y, 3), 6)
    return weights, labels, rows.cache(), (w, rankings, y)


def plain_rows(weights, rows):
    docs = [(r.doc_id, r.cls, r.fold) for r in rows.collect()]
    orders = [[f"t{j}" for j in range(6)], [f"t{j}" for j in range(8, 2, -1)]]
    return docs, [dense(weights, [d for d, _, _ in docs], o) for o in orders]


def test_sums_over_blocks(small):
    weights, _, rows, _ = small
    docs, xs = plain_rows(weights, rows)
    assert {(d, c) for d, c, _ in docs} == set(small[1].items()) and {f for _, _, f in docs} == {0, 1, 2}
    y, fold = np.array([2 * c - 1 for _, c, _ in docs]), np.array([f for _, _, f in docs])
    rng = np.random.default_rng(3)
    models, out = [rng.normal(size=(7, 5)), rng.normal(size=(7, 3))], [np.array([0, 1, 2, 0, 1]), np.array([2, 2, 0])]
    for x, w, held, (losses, gradients) in zip(xs, models, out, M.summed(M._blocks(rows.repartition(3), 2), models, out), strict=True):
        for m in range(w.shape[1]):
            loss, grad = 0.0, np.zeros(7)
            for i in range(len(docs)):
                if fold[i] != held[m]:
                    short = 1 - y[i] * (x[i] @ w[:, m])
                    loss += 0 if short <= 0 else short - 0.05 if short > 0.1 else short**2 / 0.2
                    grad -= 0 if short <= 0 else y[i] * x[i] * min(1, short / 0.1)
            assert losses[m] == pytest.approx(loss, rel=1e-4) and gradients[:, m] == pytest.approx(grad, rel=1e-3, abs=1e-3)


def test_models_settle_at_the_optimum(small):
    weights, _, rows, _ = small
    docs, xs = plain_rows(weights, rows)
    y, fold = np.array([2.0 * c - 1 for _, c, _ in docs]), np.array([f for _, _, f in docs])

    def sums(models, held):
        out = []
        for x, w, h in zip(xs, models, held, strict=True):
            loss, slope = M.hinge(y[:, None] * (x @ w))
            train = fold[:, None] != h[None, :]
            out.append(((loss * train).sum(axis=0), x.T @ (slope * train * y[:, None])))
        return out

    free = np.ones((7, 4))
    free[3:6, 2:] = 0
    held = np.array([0, 1, 2, 0])
    found = M.fitted(sums, [free, free], [held, held], 1.0, 300, 1e-4)
    for w, x in zip(found, xs, strict=True):
        assert (w[3:6, 2:] == 0).all()
        for m in range(4):
            train, v = fold != held[m], np.zeros(7)

            def value(v, x=x, train=train):
                return (v[:6] ** 2).sum() / 2 + M.hinge(y[train] * (x[train] @ v))[0].sum()

            for step in range(20000):  # plain descent
                grad = np.r_[v[:6], 0] + x[train].T @ (M.hinge(y[train] * (x[train] @ v))[1] * y[train])
                v -= 0.002 * grad * free[:, m]
            assert value(w[:, m]) == pytest.approx(value(v), rel=1e-4)


def test_scores_of_folds(spark):
    rng = random.Random(5)
    rows = [(0, k, f, rng.randint(0, 1), rng.choice([-100.0, -0.5, 0.0, 0.25, 0.2501, 3.0, 90.0, rng.uniform(-1, 1)])) for k in (1, 2) for f in range(3) for _ in range(40)]
    rows += [(1, 1, 0, 1, 0.5), (1, 1, 0, 1, -0.5), *[(1, 2, 0, c, 0.1) for c in (0, 1, 1)]]
    got = {(r.ranking, r.k, r.fold): (r.accuracy, r.balanced_accuracy, r.roc_auc) for r in M.fold_scores(spark.createDataFrame(rows, "ranking int, k int, fold int, cls int, margin double")).collect()}
    assert len(got) == 8 and got[(1, 1, 0)] == (0.5, 0.5, None) and got[(1, 2, 0)][2] == 0.5
    for key, (acc, bal, auc) in got.items():
        own = [(m, c) for r, k, f, c, m in rows if (r, k, f) == key]
        hits = [((m > 0) == (c == 1), c) for m, c in own]
        assert acc == pytest.approx(sum(h for h, _ in hits) / len(hits))
        pos, neg = [m for m, c in own if c], [m for m, c in own if not c]
        if neg:
            assert bal == pytest.approx((sum(h for h, c in hits if c) / len(pos) + sum(h for h, c in hits if not c) / len(neg)) / 2)
            assert auc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))


def test_whole_grid(small):
    _, _, _, (w, rankings, y) = small
    got = {(r.ranking, r.k): (r.accuracy, r.balanced_accuracy, r.roc_auc) for r in M.cross_validated(w, rankings, y, [1, 4, 6], n_folds=3).collect()}
    assert set(got) == {(n, k) for n in "ab" for k in (1, 4, 6)}
    assert got[("a", 4)][2] > 0.85 and got[("a", 4)][2] > got[("b", 4)][2]  # t0 and t3 decide
    with pytest.raises(ValueError):
        M.prefix_rows(w, list(rankings.values()), y, 10**6)


def test_sums_of_shallow_models(small):
    """Terms below a model's depth are not multiplied; losses and the gradients of its own terms are the same."""
    blocks, rng = M._blocks(small[2].repartition(3), 2), np.random.default_rng(5)
    depths, out = np.array([1, 6, 3, 2, 6]), np.array([0, 1, 2, 0, 1])
    kept = np.vstack([depths[None, :] > np.arange(6)[:, None], np.ones((1, 5), bool)])
    w = rng.normal(size=(7, 5)) * kept
    whole, cut = M.summed(blocks, [w, w], [out, out]), M.summed(blocks, [w, w], [out, out], [depths, depths])
    for (losses, gradients), (want, slopes) in zip(cut, whole, strict=True):
        assert np.allclose(losses, want, rtol=1e-5) and np.allclose(gradients, slopes * kept, rtol=1e-4, atol=1e-4)
