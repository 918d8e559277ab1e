"""Mixtures of several groups at once against one plain loop each, and clusters inside clusters."""

import math

import numpy as np

from tessera.operators import mixtures, themes


def plain(x, k, full, seed):
    """Expectation and maximisation by the formulas, one component and row after the other."""
    m = mixtures.start(np.array(sorted(x.tolist())), k, full, seed)
    weights, means, cov, before = m.weights, m.means, m.covariances, -math.inf
    width = x.shape[1]
    for _ in range(mixtures.STEPS + 1):
        dens = np.zeros((len(x), k))
        for j in range(k):
            c = cov[j] if full else np.diag(cov[j])
            d = x - means[j]
            dens[:, j] = weights[j] * np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(c), d)) / math.sqrt((2 * math.pi) ** width * np.linalg.det(c))
        likelihood = np.log(dens.sum(axis=1)).mean()
        free = k - 1 + k * width + k * (width * (width + 1) // 2 if full else width)
        bic = free * math.log(len(x)) - 2 * likelihood * len(x)
        if abs(likelihood - before) < mixtures.LEAST_GAIN:
            break
        before = likelihood
        p = dens / dens.sum(axis=1, keepdims=True)
        n = p.sum(axis=0)
        weights, means = n / n.sum(), (p.T @ x) / n[:, None]
        cov = np.stack([np.cov(x.T, aweights=p[:, j], ddof=0) if full else np.average((x - means[j]) ** 2, axis=0, weights=p[:, j]) for j in range(k)])
        cov = cov + mixtures.FLOOR * (np.eye(width) if full else 1)
    return bic, means, dens / dens.sum(axis=1, keepdims=True)


def test_mixtures_of_groups_are_those_of_plain_loops(spark):
    r = np.random.default_rng(1)
    groups = {g: np.concatenate([r.normal(size=(40, 3)) * 0.3 + r.normal(size=3) * 2 for _ in range(g + 2)]) for g in (0, 1, 2)} | {7: r.normal(size=(2, 3))}
    rows = spark.createDataFrame([(g, v.tolist(), 1000 * g + i) for g, x in groups.items() for i, v in enumerate(x)], "g int, x array<double>, id long")
    for full in (True, False):
        found = mixtures.fitted(rows, dict.fromkeys(groups, 5), full, seed=4)
        assert set(found) == {0, 1, 2}
        said = {(x.g, x.id, x.component): x.weight for x in mixtures.members(rows, found, 0.1).collect()}
        for g in found:
            each = {k: plain(groups[g], k, full, 4) for k in range(2, 6)}
            k = min(each, key=lambda k: each[k][0])
            assert len(found[g].means) == k and np.allclose(found[g].means, each[k][1], atol=1e-6)
            want = {(g, 1000 * g + i, j): w for i, row in enumerate(each[k][2]) for j, w in enumerate(row) if w >= 0.1}
            own = {x: w for x, w in said.items() if x[0] == g}
            assert own.keys() == want.keys() and all(abs(own[x] - want[x]) < 1e-6 for x in want)


def test_axes_of_groups_match_numpy(spark):
    r = np.random.default_rng(2)
    groups = {g: r.normal(size=(60, 5)) * [4, 2, 1, 0.5, 0.2] + g for g in (3, 4)}
    rows = spark.createDataFrame([(g, v.tolist(), i) for g, x in groups.items() for i, v in enumerate(x)], "g int, x array<double>, id long")
    along = mixtures.axes(rows, 2)
    flat = {(x.g, x.id): x.x for x in mixtures.projected(rows, along).collect()}
    for g, x in groups.items():
        _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        assert np.allclose(np.abs(along[g][1] @ vt[:2].T), np.eye(2), atol=1e-6)
        assert np.allclose([flat[g, i] for i in range(60)], (x - x.mean(axis=0)) @ along[g][1].T)


def test_large_components_are_split_again(spark):
    r = np.random.default_rng(3)
    axes = np.eye(12)
    # two subjects far apart, one of them in three parts near each other
    rows = [axes[0] * 3 + axes[3 + i % 3] * 0.9 + r.normal(size=12) * 0.05 for i in range(180)] + [axes[1] * 3 + r.normal(size=12) * 0.05 for _ in range(40)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(900, None)], "id long, v array<double>")
    found = themes.soft_clusters(table, "id", "v", themes.Settings(axes=1, most=2, target=50)).collect()
    of = {}
    for x in found:
        if x.weight > 0.5:
            of.setdefault(x.id, set()).add(x.cluster)
    assert set(of) == set(range(220))
    parts = [{c for i in range(k, 180, 3) for c in of[i]} for k in range(3)] + [{c for i in range(180, 220) for c in of[i]}]
    assert all(not parts[a] & parts[b] for a in range(4) for b in range(a)) and len(parts[3]) == 1
