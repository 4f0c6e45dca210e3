"""Hand-computed cases of the study operators."""

import math
from decimal import Decimal
from fractions import Fraction
from functools import reduce
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from optiloom.functions import exact
from optiloom.functions.ordered import running, with_position
from optiloom.functions.schema import StudySchema, with_feasibility
from optiloom.operators import cluster, export, filters, forest, history, kriging, mcdm, pareto, pdp, sensitivity

TWO = StudySchema((), ("a", "b"), ("minimize", "minimize"))


def frame(spark, rows, names="trial_id long, a double, b double"):
    return spark.createDataFrame(rows, names)


def points(spark, rows):
    return frame(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate(rows)])


def ranks(spark, rows, directions=("minimize", "minimize")):
    found = pareto.ranks(points(spark, rows), StudySchema((), ("a", "b"), directions))
    return [r.rank for r in found.orderBy("trial_id").collect()]


def test_ranks(spark):
    assert ranks(spark, [(1, 1), (2, 2), (3, 3), (4, 4)]) == [1, 2, 3, 4]
    assert ranks(spark, [(1, 4), (2, 3), (3, 2), (4, 1)]) == [1, 1, 1, 1]
    assert ranks(spark, [(1, 1)] * 3) == [1, 1, 1]
    assert ranks(spark, [(1, 3), (2, 2), (3, 1)], ("maximize", "minimize")) == [3, 2, 1]
    assert ranks(spark, [(1, 1), (math.nan, 0), (2, 2)]) == [1, 3, 2]


def dominates(a, b):
    return all(x <= y for x, y in zip(a, b)) and any(x < y for x, y in zip(a, b))


def ranks_by_hand(rows):
    found = {}

    def rank(p):
        if p not in found:
            found[p] = 1 + max((rank(q) for q in set(rows) if dominates(q, p)), default=0)
        return found[p]

    return [rank(p) for p in sorted(set(rows))] and [found[p] for p in rows]


@pytest.mark.parametrize("m, block", [(2, 8192), (2, 11), (3, 17), (4, 40)])
def test_ranks_of_blocks(spark, monkeypatch, m, block):
    """Ranked in one block or in many, with ties and repeated vectors."""
    monkeypatch.setattr(pareto, "RANKED", block)
    rows = [tuple(map(float, r)) for r in np.random.default_rng(m).integers(0, 9, (150, m))]
    names = [f"o{k}" for k in range(m)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "trial_id long, " + ", ".join(f"{n} double" for n in names))
    schema = StudySchema((), tuple(names), ("minimize",) * m)
    want = ranks_by_hand(rows)
    assert [r["rank"] for r in pareto.ranks(df, schema).orderBy("trial_id").collect()] == want
    assert [r["rank"] for r in pareto.ranks(df, schema, max_rank=2).orderBy("trial_id").collect()] == [min(w, 3) for w in want]


@pytest.mark.parametrize("part", [16_384, 12])
def test_front_of_many_parts(spark, monkeypatch, part):
    """Five costs, so that most rows survive; repeated rows, NaN left out."""
    monkeypatch.setattr(pareto, "MERGED", part)
    rows = [tuple(map(float, r)) for r in np.random.default_rng(21).integers(0, 6, (200, 5))]
    rows[3] = (math.nan, *rows[3][1:])
    names = [f"o{k}" for k in range(5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "trial_id long, " + ", ".join(f"{n} double" for n in names)).repartition(6)
    want = [i for i, p in enumerate(rows) if i != 3 and not any(dominates(q, p) for k, q in enumerate(rows) if k != 3)]
    found = pareto.front(df, StudySchema((), tuple(names), ("minimize",) * 5))
    assert sorted(r.trial_id for r in found.collect()) == want and found.columns == df.columns
    assert pareto.front(df.limit(0), StudySchema((), tuple(names))).count() == 0


def test_ranks_of_many_objectives():
    points = np.array([[1, 1, 1, 1], [1, 2, 1, 2], [2, 2, 2, 2.0]])
    assert pareto.chain_ranks(points, np.zeros(3)).tolist() == [1, 2, 3] and pareto.chain_ranks(points, np.array([4, 0, 0])).tolist() == [5, 6, 7]
    chain = np.repeat(np.arange(1200.0)[:, None], 2, axis=1)
    assert pareto.chain_ranks(chain, np.zeros(1200)).tolist() == list(range(1, 1201))


def test_hypervolume_steps():
    steps = pareto.Staircase((5, 5))
    for p in ((1, 4), (2, 2), (3, 1.0), (3, 3), (9, 0)):
        steps.add(p)
    assert steps.area == pytest.approx(12)


def strips(points, ref):
    """The literal sum over a list in the order of arrival."""
    inside = sorted((p for p in points if p[0] < ref[0] and p[1] < ref[1]), key=lambda p: p[0])
    ends = [p[0] for p in inside[1:]] + [ref[0]]
    return sum((e - p[0]) * (ref[1] - p[1]) for p, e in zip(inside, ends))


@pytest.mark.parametrize("m, bits", [(2, 16), (2, 3), (3, 16), (3, 4)])
def test_hypervolume_history(spark, monkeypatch, m, bits):
    """Two series in one block or in many, against a loop over the rows; NaN rows repeat the value before."""
    monkeypatch.setattr(pareto, "HISTORY_BITS", bits)
    rng = np.random.default_rng(m + bits)
    rows = [(s, i, *map(float, rng.integers(0, 30, m))) for s, n in (("a", 90), (None, 25), ("nan", 2)) for i in range(n)]
    rows = [(s, i, math.nan, *rest[1:]) if i in (0, 7) or s == "nan" else (s, i, *rest) for s, i, *rest in rows]
    names = [f"o{k}" for k in range(m)]
    df = spark.createDataFrame(rows, "s string, trial_id long, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    schema = StudySchema((), tuple(names), ("maximize",) + ("minimize",) * (m - 1))
    got = {(r.s, r.trial_id): r.hv for r in pareto.hypervolume_history(df, schema, ("s",)).collect()}
    area = {(r.s, r.trial_id): r.hv for r in pareto.hypervolume_history(df, schema, ("s",), true_area=True).collect()}
    assert len(got) == len(rows)
    for s in ("a", None, "nan"):
        own = [(-r[2], *r[3:]) for r in rows if r[0] == s]
        good = [p for p in own if not any(map(math.isnan, p))]
        ref = [max(c) + 0.1 * abs(max(c) - min(c)) + 1 for c in zip(*good)]
        front, steps, value = [], pareto.Staircase(ref or [0, 0]), 0.0
        for i, p in enumerate(own):
            if p in good:
                if not any(dominates(q, p) for q in front):
                    front = [q for q in front if not dominates(p, q)] + [p]
                value = strips(front, ref)
                steps.add(p)
            assert got[s, i] == pytest.approx(value) and area[s, i] == pytest.approx(steps.area)
    one = pareto.hypervolume_history(df.where("s = 'a'"), schema).orderBy("trial_id").collect()
    assert [r.hv for r in one] == pytest.approx([got["a", i] for i in range(90)])
    assert {r.hv for r in pareto.hypervolume_history(df, StudySchema((), ("o0",))).collect()} == {0.0}
    assert pareto.hypervolume_history(df.limit(0), schema).count() == 0


def test_hypervolume_of_three_costs(spark):
    """Front rows that dominate each other in the first two costs: strips as they are, or the true area."""
    df = spark.createDataFrame([(0, 1.0, 1.0, 9.0), (1, 2.0, 3.0, 1.0), (2, 2.0, 2.0, 2.0)], "trial_id long, a double, b double, c double")
    schema = StudySchema((), ("a", "b", "c"), ("minimize",) * 3)
    ref = (2 + 0.1 + 1, 3 + 0.2 + 1)
    assert pareto.hypervolume(df, schema).first().hv == pytest.approx(strips([(1, 1), (2, 3), (2, 2)], ref))
    assert pareto.hypervolume(df, schema, true_area=True).first().hv == pytest.approx((ref[0] - 1) * (ref[1] - 1))


def test_hypervolume_needs_two_front_rows(spark):
    assert pareto.hypervolume(points(spark, [(1, 1), (2, 2)]), TWO).first().hv is None


def test_chebyshev(spark):
    found = mcdm.chebyshev(points(spark, [(1, 4), (2, 2), (4, 1)]), TWO, [0.5, 0.5])
    assert mcdm.top(found, 1, "trial_id", ascending=True).first().trial_id == 1


def test_topsis(spark):
    one = mcdm.topsis(points(spark, [(3, 4)]), TWO, [0.5, 0.5]).first().score
    assert one == 0.5
    df = points(spark, [(1, 5), (5, 1)])
    for weights, best in (([0.9, 0.1], 0), ([0.1, 0.9], 1)):
        assert mcdm.top(mcdm.topsis(df, TWO, weights), 1, "trial_id").first().trial_id == best
    with pytest.raises(ValueError):
        mcdm.topsis(df, TWO, [1.0])


def test_range_filter(spark):
    df = frame(spark, [(i, v, 0.0) for i, v in enumerate((1.0, 3.0, 5.0, 7.0, math.nan))])
    ids = lambda r: [x.trial_id for x in filters.range_filter(df, r).orderBy("trial_id").collect()]
    assert ids({"a": (3, 7)}) == [1, 2, 3]
    assert ids({"a": (None, 5)}) == [0, 1, 2]
    assert ids({"a": (None, None)}) == [0, 1, 2, 3]
    assert ids({}) == [0, 1, 2, 3, 4]
    assert ids({"nope": (0, 1)}) == ids({"a": (2, 1)}) == []
    assert ids("not json") == [0, 1, 2, 3, 4]


def test_ranges_of_odd_forms(spark):
    rows = spark.createDataFrame([(i, Decimal(i) / 4, i % 2 == 0, str(i), float("nan") if i == 3 else 1.0) for i in range(6)], "trial_id long, `unit price` decimal(10,2), flag boolean, t string, y double")
    ids = lambda r: [x.trial_id for x in filters.range_filter(rows, r).orderBy("trial_id").collect()]
    assert ids({"unit price": (0.25, 1)}) == ids('{"unit price": {"min": 0.25, "max": 1}}') == [1, 2, 3, 4]
    assert ids({"unit price": (Decimal("0.5"), None)}) == [2, 3, 4, 5]
    assert ids('{"unit price": {"min": "a", "max": true}}') == [0, 1, 2, 3, 4, 5]
    assert ids('{"trial_id": 5, "unit price": {"max": 0.5}}') == [0, 1, 2] and ids('{"y": []}') == [0, 1, 2, 4, 5]
    assert ids('{"flag": {"min": 0}}') == ids('{"t": {}}') == [] and ids("[1]") == ids("3") == [0, 1, 2, 3, 4, 5]


def test_ranges_that_cover_their_column_are_no_filter(spark):
    df = frame(spark, [(0, 1.0, 5.0), (1, 2.0, math.nan), (2, 3.0, 7.0)])
    got = filters.effective_ranges(df, {"a": (1.0, 3.0), "b": (5.0, 6.9), "trial_id": (1.0, 9.0)})
    assert got == {"b": (5.0, 6.9), "trial_id": (1.0, 9.0)}


def test_alpha_of_points(spark):
    df = frame(spark, [(0, 1.0, 5.0), (1, 2.0, math.nan), (2, 3.0, 7.0)])
    got = filters.selected_points(df, ["a", "b"], F.col("a") > 1, full=0.9, dimmed=0.05).orderBy("a").collect()
    assert [(r.a, r.alpha) for r in got] == [(1.0, 0.05), (3.0, 0.9)]


def test_feasibility(spark):
    df = spark.createDataFrame([([-0.5, 0.3],), ([-1.0, -0.5, 0.0],), ([],), (None,)], "constraints array<double>")
    got = [(r.is_feasible, round(r.constraint_sum, 9)) for r in with_feasibility(df).collect()]
    assert got == [(0.0, -0.2), (1.0, -1.5), (1.0, 0.0), (1.0, 0.0)]


def test_positions_and_running(spark):
    rng = np.random.default_rng(1)
    v = rng.permutation(500).tolist()
    df = spark.createDataFrame([(int(o), float(x)) for o, x in enumerate(v)], "o long, v double").repartition(7)
    assert [r.row_idx for r in with_position(df, "o").orderBy("o").collect()] == list(range(500))
    assert [r.m for r in running(df, "o", F.col("v"), F.min, "m").orderBy("o").collect()] == np.minimum.accumulate(v).tolist()


def test_history(spark):
    df = spark.createDataFrame([(i, "s", float(v)) for i, v in enumerate((5, 3, 4, 1))], "t long, s string, v double")
    assert [r.best for r in history.best_so_far(df, "t", "v", True, ("s",)).orderBy("t").collect()] == [5, 3, 3, 1]
    assert [r.t for r in history.record_trials(df, "t", "v", ("s",)).orderBy("t").collect()] == [0, 1, 3]
    assert history.convergence(df, "t", "v", ("s",)).first().verdict == "insufficient"


def test_spearman(spark):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(range(1, 7), (4, 1, 2, 5, 6, 3)))]
    found = sensitivity.spearman_matrix(frame(spark, rows), StudySchema(("a",), ("b",)))
    assert found.first().rho == pytest.approx(13 / 35)


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    y = x @ [2.0, -1.0] + 0.1 * rng.normal(size=60)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "trial_id long, p double, q double, y double")
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert sensitivity.ridge_fits(df, ["p", "q"], ["y"])[0].beta == pytest.approx(want)


def test_sobol_bounds(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(a), float(b), float(3 * a + 0.1 * b)) for i, (a, b) in enumerate(rng.random((50, 2)))], "trial_id long, a double, b double, y double")
    rows = {r.param: r for r in sensitivity.sobol(df, StudySchema(("a", "b"), ("y",)), 256).collect()}
    assert rows["a"].s1 > 0.8 > 0.2 > rows["b"].s1 and all(0 <= r.st <= 1 for r in rows.values())


def test_sobol_equals_plain_numpy(spark):
    """Surrogate, design and indices written out on one array: all draws of the generator, quadratic ridge, Saltelli sums."""
    rng = np.random.default_rng(12)
    x = rng.random((40, 2)) * [3, 1]
    y = x[:, 0] ** 2 + x[:, 1] - 0.5 * x[:, 0] * x[:, 1]
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "trial_id long, a double, b double, y double").repartition(4)
    n, state, draws = 64, 0xDEADBEEF12345678, []
    for _ in range(2 * n * 2):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        draws.append((state >> 11) / 2**53)
    low, high = x.min(0), x.max(0)
    a, b = (low + (high - low) * np.array(d).reshape(n, 2) for d in (draws[: 2 * n], draws[2 * n :]))

    def terms(v):
        z = (v - x.mean(0)) / x.std(0)
        return np.column_stack([z, z**2, z[:, 0] * z[:, 1]])

    q = terms(x)
    scaled = (q - q.mean(0)) / q.std(0)
    beta = np.linalg.solve(scaled.T @ scaled + np.eye(5), scaled.T @ (y - y.mean()))
    value = lambda v: y.mean() + (terms(v) - q.mean(0)) / q.std(0) @ beta
    fa, fb = value(a), value(b)
    for k, r in enumerate(sensitivity.sobol(df, StudySchema(("a", "b"), ("y",)), n).orderBy("param").collect()):
        mixed = a.copy()
        mixed[:, k] = b[:, k]
        fm = value(mixed)
        s1, st = (fb * (fm - fa)).mean() / fa.var(), ((fa - fm) ** 2).mean() / (2 * fa.var())
        assert (r.s1, r.st) == pytest.approx((min(max(s1, 0), 1), min(max(st, 0), 1)))


def test_pca_and_kmeans(spark):
    rng = np.random.default_rng(5)
    data = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "i long, x double, y double")
    projected, values, _ = cluster.pca(df, ["x", "y"], 2)
    assert values.sum() == pytest.approx(np.trace(np.cov(data.T)))
    assert projected.agg(F.var_samp("pc1")).first()[0] == pytest.approx(values[0])
    labelled, centers, wcss = cluster.kmeans(df, ["x", "y"], 3, "i")
    groups = [{r.label for r in labelled.where(F.col("i").between(a, a + 29)).collect()} for a in (0, 30, 60)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3 and wcss < 10
    sums, best = cluster.elbow(df, ["x", "y"], "i", 4)
    assert sums == sorted(sums, reverse=True) and best in (2, 3, 4)


def lloyd(x, k):
    """(labels, sum of squares) by the rules of ``kmeans`` on one array."""
    centers = [x[len(x) // 2]]
    for c in range(1, k):
        total = np.cumsum(((x[:, None] - np.array(centers)) ** 2).sum(2).min(1))
        centers.append(x[min(int(np.searchsorted(total, total[-1] / (k - c + 1))), len(x) - 1)])
    centers, before = np.array(centers, float), None
    while True:
        d = ((x[:, None] - centers) ** 2).sum(2)
        label = d.argmin(1)
        if before is not None and (label == before).all():
            return label, d.min(1).sum()
        before = label
        for j in np.unique(label):
            centers[j] = x[label == j].mean(0)


@pytest.mark.parametrize("sections, fetched", [(512, 1024), (4, 5)])
def test_kmeans_equals_plain_lloyd(spark, monkeypatch, sections, fetched):
    """Whether seeds are found in one step or by sections of sections."""
    monkeypatch.setattr(cluster, "SECTIONS", sections)
    monkeypatch.setattr(cluster, "FETCHED", fetched)
    x = np.random.default_rng(8).integers(0, 40, (150, 3)).astype(float)
    df = spark.createDataFrame([(1000 - i, *map(float, r)) for i, r in enumerate(x[::-1])], "i long, x double, `a b` double, label double").repartition(6)
    found = cluster.clusterings(df, ["x", "a b", "label"], [2, 3, 7, 200, 0], "i")
    for k in (2, 3, 7):
        assert found[k][1] == pytest.approx(lloyd(x, k)[1])
    assert found[200][1] == found[0][1] == 0.0 and not len(found[200][0])
    labels = [r.label for r in cluster.kmeans(df, ["x", "a b", "label"], 7, "i")[0].orderBy("i").select("label").collect()]
    assert labels == lloyd(x, 7)[0].tolist()
    assert {r.label for r in cluster.kmeans(df, ["x"], 151, "i")[0].collect()} == {0}


def exact_seed(x, centers, parts):
    """Row at which the running sum of squared distances reaches its share, in fractions."""
    upto = list(accumulate(map(Fraction, cluster._nearest(x.T, centers)[1].tolist())))
    return next(i for i, v in enumerate(upto) if v * parts >= upto[-1])


@pytest.mark.parametrize("sections, fetched", [(512, 1024), (4, 5)])
def test_seeds_of_repeated_rows(spark, monkeypatch, sections, fetched):
    """Where a table holds equal blocks of rows the share is met at a block's end, to the last bit."""
    monkeypatch.setattr(cluster, "SECTIONS", sections)
    monkeypatch.setattr(cluster, "FETCHED", fetched)
    for seed in range(4):
        x = np.tile(np.random.default_rng(seed).lognormal(0, 3, (37, 2)), (6, 1))
        rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_idx long, v array<double>").repartition(5)
        first = np.array([x[len(x) // 2]])
        found = cluster._next_centers(rows, len(x), {2: first, 3: first, 6: first})
        for k, row in found.items():
            assert row.tolist() == x[exact_seed(x, first, k)].tolist()


def test_exact_sums():
    rng = np.random.default_rng(4)
    d = np.concatenate([10.0 ** rng.uniform(-320, 308, 3000), rng.random(3000), [0.0, 5e-324, 1.7976931348623157e308] * 2])
    cell = rng.integers(0, 7, len(d))
    whole = [sum(Fraction(v) * 2**1126 for v in d[cell == c].tolist()) for c in range(7)]
    parts = [exact.state(cell[at], d[at], 7) for at in np.array_split(rng.permutation(len(d)), 9)] + [exact.state(cell[:0], d[:0], 7), exact.state(cell[:1], np.zeros(1), 7)]
    for order in (parts, parts[::-1]):
        assert exact.sums(reduce(lambda a, b: exact.merged(a, b, 7), order), 7) == whole
    assert sum(exact.whole(d)) == sum(whole)
    odd = exact.sums(exact.state(np.arange(4), np.array([math.nan, math.inf, 1e308, 0.0]), 4), 4)
    assert odd[0] >= exact.NAN > odd[1] >= exact.INF > odd[2] > odd[3] == 0


def test_moments_merge_without_loss(spark):
    """Means of 1e9 with deviations of 1, over many partitions, rows with a null or NaN left out."""
    x = np.random.default_rng(9).normal(size=(500, 3)) + [1e9, 0, -1e9]
    rows = [tuple(map(float, r)) for r in x] + [(None, 1.0, 1.0), (math.nan, 1.0, 1.0), (1.0, math.inf, 1.0)]
    for parts in (1, 40):
        m = sensitivity.moments(spark.createDataFrame(rows, "a double, b double, c double").repartition(parts), ["a", F.col("b"), "c"])
        assert m.n == 500 and m.mean == pytest.approx(x.mean(0)) and m.cross / 499 == pytest.approx(np.cov(x.T), rel=1e-6)
    assert sensitivity.moments(spark.createDataFrame([], "a double"), ["a"]).n == 0


def test_cluster_view(spark):
    rng = np.random.default_rng(10)
    data = np.concatenate([rng.normal(c, 0.2, (40, 3)) for c in (0, 4)])
    df = spark.createDataFrame([(i, "t", *map(float, r)) for i, r in enumerate(data)], "trial_id long, t string, p double, q double, y double")
    labelled, stats = cluster.cluster_view(df, StudySchema(("p", "q", "t"), ("y",)), "all", 2)
    halves = [{r.label for r in labelled.where(c).collect()} for c in ("trial_id < 40", "trial_id >= 40")]
    assert sorted(map(len, halves)) == [1, 1] and halves[0] != halves[1]
    assert {(r.name, r.size) for r in stats.collect()} == {(n, 40) for n in ("p", "q", "y")} and all(r.significant for r in stats.collect())
    with pytest.raises(ValueError):
        cluster.cluster_view(df.limit(1), StudySchema(("p",), ()), "param", 2)


def test_forest_and_kriging():
    x = np.linspace(0, 1, 40)[:, None]
    y = (x[:, 0] > 0.5).astype(float)
    nodes = forest.grow(x, y)
    assert nodes[0][1] == pytest.approx(0.5, abs=0.02)
    assert set(forest.predict([nodes], x)) == {0.0, 1.0}
    theta, target = np.array([0.1, 0.2, -1.0]), np.sin(6 * x[:, 0])
    _, grad = kriging.objective(theta, x, target)
    for k in range(3):
        step = np.eye(3)[k] * 1e-5
        slope = (kriging.objective(theta + step, x, target)[0] - kriging.objective(theta - step, x, target)[0]) / 2e-5
        assert grad[k] == pytest.approx(slope, rel=1e-3, abs=1e-5)
    assert np.abs(kriging.fit(x, target).predict(x) - target).max() < 0.1


@pytest.mark.parametrize("limit", [100_000, 2000])
def test_forest_uses_all_rows(spark, monkeypatch, limit):
    """A step in 30 of 7,000 rows, none of them among the 5,000 of least id hash; nodes split in tasks or over all of them."""
    monkeypatch.setattr(forest, "NODE_ROWS", limit)
    ids = [r.id for r in spark.range(7000).orderBy(F.xxhash64("id"), "id").collect()]
    late = set(ids[-30:])
    rows = [(i, 1.0 if i in late else 0.0, float(i % 3), 100.0 if i in late else 0.0) for i in ids]
    df = spark.createDataFrame(rows, "trial_id long, a double, b double, y double")
    found = pdp.surface(df, StudySchema(("a", "b"), ("y",)), "a", "b", "y", 2, "random_forest").collect()
    assert len(found) == 4 and all((r.z > 90) == (r.x == 1) and r.r2 > 0.95 for r in found)


def test_forests_do_not_depend_on_partitions_or_limits(spark, monkeypatch):
    """Integer targets, so that sums are exact: the same trees over 1 and 50 partitions, grown in tasks and by levels."""
    rng = np.random.default_rng(11)
    rows = [(int(h), float(a), float(b), float(y)) for h, a, b, y in zip(rng.integers(-(2**62), 2**62, 400), rng.integers(0, 30, 400), rng.integers(0, 400, 400), rng.integers(0, 9, 400))]
    df = spark.createDataFrame(rows, "h long, x0 double, x1 double, y double")
    one = forest.fit(df.repartition(1), 2, trees=3)
    assert forest.fit(df.repartition(50), 2, trees=3) == one
    monkeypatch.setattr(forest, "NODE_ROWS", 60)
    split = forest.fit(df, 2, trees=3)
    x = np.array([r[1:3] for r in rows])
    assert forest.predict(split, x) == pytest.approx(forest.predict(one, x))
    assert forest.r_squared_over(df, 2, one) == pytest.approx(forest.r_squared(np.array([r[3] for r in rows]), forest.predict(one, x)))
    for t in range(3):  # each tree equals the plain one over its draws
        w = forest.draws(np.array([r[0] for r in rows]), t)
        data = sorted((r, k) for r, k in zip(rows, w.tolist()) if k)
        plain = forest.grow(np.array([r[1:3] for r, _ in data]), np.array([r[3] for r, _ in data]), np.array([float(k) for _, k in data]))
        assert forest.predict([one[t]], x) == pytest.approx(forest.predict([plain], x))
    assert 0.9 < np.mean([forest.draws(np.arange(5000), t).mean() for t in range(5)]) < 1.1


def test_linspace_and_labels():
    assert pdp.linspace(0, 4, 1) == [2] and pdp.linspace(0, 4, 3) == [0, 2, 4]
    assert [pdp.quality_label(v) for v in (0.9, 0.6, 0.1)] == ["Good", "Caution", "Not Recommended"]


def test_csv(spark):
    df = frame(spark, [(0, 1.5, 0.1 + 0.2), (5, 10.0, math.nan)]).withColumn("t", F.lit('x,"y"')).withColumn("row_idx", F.col("trial_id"))
    assert export.csv_text(df, ["trial_id", "a", "b", "t", "none"], [5, 0, 9]) == 'trial_id,a,b,t,none\n5,10,,"x,""y""",\n0,1.5,0.3,"x,""y""",\n'


def test_session_round_trip():
    text = export.session_document({"a": {"min": 1}}, [1, 2], range(40))
    assert len(export.load_session(text)["pinnedTrials"]) == 20
    with pytest.raises(ValueError):
        export.load_session('{"version": "9"}')


def test_dominance_ratio(spark):
    got = pareto.dominance_ratio(points(spark, [(1, 4), (5, 5)]), points(spark, [(2, 2)]), TWO).first()
    assert (got.main_pct, got.other_pct) == (50, 50)
    assert pareto.comparison(points(spark, []), points(spark, []), TWO, ("minimize", "maximize"))[0]
    other = (points(spark, [(2, 2)]), ("minimize", "minimize"))
    found = pareto.comparisons(points(spark, [(1, 4), (5, 5)]), TWO, {"x": other, "y": (other[0], ("minimize",))})
    assert found["x"][1].first().main_pct == 50 and found["y"][0]
    with pytest.raises(ValueError):
        pareto.comparisons(other[0], TWO, dict.fromkeys("abcde", other))
