"""DuckDB SQL of the registered queries."""

from __future__ import annotations

_SUMS = "sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)))::DOUBLE AS revenue, round(sum(CAST(l_discount AS DECIMAL(18,4)))::DOUBLE / count(*), 9) AS discount, sum(l_quantity) AS quantity"
PART = f"part_study AS (SELECT p_partkey AS trial_id, p_size::DOUBLE AS p_size, p_retailprice, p_brand, p_type, revenue, discount, quantity FROM part JOIN (SELECT l_partkey, {_SUMS} FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)"
SUPPLIER = f"supplier_study AS (SELECT s_suppkey AS trial_id, s_nationkey::DOUBLE AS s_nationkey, s_acctbal AS balance, revenue, discount, quantity FROM supplier JOIN (SELECT l_suppkey, {_SUMS} FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey)"
EVENTS = "e AS (SELECT event_id AS trial_id, event_type, value FROM events)"
_NUMBER = "CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.10f', {x}), '\\.?0+$', '') END"
_INDEXED = "i AS (SELECT *, row_number() OVER (ORDER BY trial_id) - 1 AS row_idx FROM part_study)"


def _spearman(columns: dict[str, str]) -> str:
    """CTE ``rho`` of param, objective and rank correlation over the part study."""
    names = [*columns, "revenue", "discount"]
    exprs = {**columns, "revenue": "revenue", "discount": "discount"}
    ranked = ", ".join(f"rank() OVER (ORDER BY {exprs[n]}) + (count(*) OVER (PARTITION BY {exprs[n]}) - 1) / 2.0 AS r_{n}" for n in names)
    cells = " UNION ALL ".join(f"SELECT '{p}' AS param, '{o}' AS objective, corr(r_{p}, r_{o}) AS rho FROM ranked" for p in columns for o in ("revenue", "discount"))
    return f"{PART}, first AS (SELECT p_brand AS b, min(trial_id) AS f FROM part_study GROUP BY p_brand), codes AS (SELECT b, row_number() OVER (ORDER BY f) - 1 AS code FROM first), coded AS (SELECT s.*, code FROM part_study s JOIN codes ON b = p_brand), ranked AS (SELECT {ranked} FROM coded), rho AS ({cells})"


_COLUMNS = {"p_size": "p_size", "p_retailprice": "p_retailprice", "p_brand": "code"}


def _ridge(objective: str) -> str:
    """CTEs for the closed form of two standardized inputs with penalty 1."""
    return f"""m AS (SELECT count(*) AS n, avg(p_size) AS m1, avg(p_retailprice) AS m2, stddev_pop(p_size) AS s1, stddev_pop(p_retailprice) AS s2, covar_pop(p_size, p_retailprice) AS c12,
 covar_pop(p_size, {objective}) AS c1y, covar_pop(p_retailprice, {objective}) AS c2y, var_pop({objective}) AS vy, avg({objective}) AS my, min(p_size) AS a1, max(p_size) AS b1, min(p_retailprice) AS a2, max(p_retailprice) AS b2 FROM part_study),
g AS (SELECT *, n + 1 AS d, n * c12 / (s1 * s2) AS o, n * c1y / s1 AS y1, n * c2y / s2 AS y2, n * vy AS st FROM m),
f AS (SELECT *, (d * y1 - o * y2) / (d * d - o * o) AS beta1, (d * y2 - o * y1) / (d * d - o * o) AS beta2 FROM g),
fit AS (SELECT *, greatest(0, 1 - (st - 2 * (beta1 * y1 + beta2 * y2) + n * beta1 * beta1 + n * beta2 * beta2 + 2 * o * beta1 * beta2) / st) AS r2 FROM f)"""


def _ridge_table() -> str:
    parts = [f"(WITH {_ridge(o)} SELECT * FROM (SELECT 'p_size' AS param, '{o}' AS objective, round(beta1, 4) AS beta, round(r2, 4) AS r2 FROM fit UNION ALL SELECT 'p_retailprice', '{o}', round(beta2, 4), round(r2, 4) FROM fit))" for o in ("revenue", "discount")]
    return f"WITH {PART} " + " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)


def _selected() -> str:
    """Rank correlation and ridge of the rows with p_size above 20."""
    rho = _spearman({"p_size": "p_size", "p_retailprice": "p_retailprice"}).replace("FROM coded)", "FROM coded WHERE p_size > 20)")
    fits = [f"(WITH part_study AS (SELECT * FROM part_rows WHERE p_size > 20), {_ridge(o)} SELECT '{p}' AS param, '{o}' AS objective, round({b}, 4) AS beta, round(r2, 4) AS r2 FROM fit)" for o in ("revenue", "discount") for p, b in (("p_size", "beta1"), ("p_retailprice", "beta2"))]
    return f"WITH {rho}, part_rows AS (SELECT * FROM part_study), fits AS ({' UNION ALL '.join(f'SELECT * FROM {f}' for f in fits)}) SELECT param, objective, round(rho, 4) AS rho, beta, r2 FROM rho JOIN fits USING (param, objective)"


def _dominated(a: str, b: str, costs: list[str]) -> str:
    """``b`` dominates ``a``."""
    le = " AND ".join(c.format(b) + " <= " + c.format(a) for c in costs)
    lt = " OR ".join(c.format(b) + " < " + c.format(a) for c in costs)
    return f"{le} AND ({lt})"


_PART_COSTS = ["-{0}.revenue", "{0}.discount"]
_SUP3, _SUP2 = ["-{0}.balance", "{0}.discount", "-{0}.quantity"], ["-{0}.balance", "{0}.discount"]
_FRONT = f"front AS (SELECT * FROM part_study a WHERE NOT EXISTS (SELECT 1 FROM part_study b WHERE {_dominated('a', 'b', _PART_COSTS)}))"


def _ranks(costs: list[str]) -> str:
    return f"""WITH RECURSIVE {SUPPLIER}, edge AS (SELECT b.trial_id AS u, a.trial_id AS v FROM supplier_study a JOIN supplier_study b ON {_dominated('a', 'b', costs)}),
chain(id, l) AS (SELECT trial_id, 1 FROM supplier_study UNION SELECT v, l + 1 FROM chain JOIN edge ON u = id) SELECT id AS trial_id, max(l)::INTEGER AS rank FROM chain GROUP BY id"""


def _topsis(source: str, objectives: list[tuple[str, bool]], weights: list[float]) -> str:
    aggs = ", ".join(f"sqrt(sum({o} * {o})) AS n_{o}, min({o}) AS a_{o}, max({o}) AS b_{o}" for o, _ in objectives)
    term = lambda o, w, end: f"pow(({o} - {end}_{o}) * {w!r} / n_{o}, 2)"
    plus = " + ".join(term(o, w, "b" if big else "a") for (o, big), w in zip(objectives, weights, strict=True))
    minus = " + ".join(term(o, w, "a" if big else "b") for (o, big), w in zip(objectives, weights, strict=True))
    return f"SELECT trial_id, round(sqrt({minus}) / (sqrt({plus}) + sqrt({minus})), 8) AS score FROM {source}, (SELECT {aggs} FROM {source})"


def _pca(vectors: str, squarings: int = 18) -> str:
    """CTE ``pc`` of the two leading components of ``vectors`` (vec_id, embedding), by repeated squaring of the covariance matrix, the second after deflation."""
    steps = [
        f"u AS MATERIALIZED (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM {vectors})",
        "m AS MATERIALIZED (SELECT i, avg(x) AS m, count(*) AS n FROM u GROUP BY i)",
        "z AS MATERIALIZED (SELECT vec_id, i, x - m AS x, n FROM u JOIN m USING (i))",
        "c1 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) / (any_value(a.n) - 1) AS c FROM z AS a JOIN z AS b USING (vec_id) GROUP BY a.i, b.i)",
    ]
    for k in (1, 2):
        for t in range(squarings + 1):
            rows = f"SELECT i, j, c FROM c{k}" if t == 0 else f"SELECT a.i, b.j, sum(a.c * b.c) AS c FROM p{k}_{t - 1} AS a JOIN p{k}_{t - 1} AS b ON a.j = b.i GROUP BY a.i, b.j"
            steps.append(f"p{k}_{t} AS MATERIALIZED (SELECT i, j, c / sum(c) FILTER (WHERE i = j) OVER () AS c FROM ({rows}))")
        last = f"p{k}_{squarings}"
        steps.append(f"w{k} AS MATERIALIZED (SELECT i, c / sqrt((SELECT max(c) FROM {last} WHERE i = j)) AS w FROM {last} WHERE j = (SELECT arg_max(i, c) FROM {last} WHERE i = j))")
        if k == 1:
            steps.append("c2 AS MATERIALIZED (SELECT c.i, c.j, c.c - (SELECT sum(a.w * q.c * b.w) FROM c1 AS q JOIN w1 AS a ON a.i = q.i JOIN w1 AS b ON b.i = q.j) * a.w * b.w AS c FROM c1 AS c JOIN w1 AS a ON a.i = c.i JOIN w1 AS b ON b.i = c.j)")
    steps.append("pc AS MATERIALIZED (SELECT vec_id, sum(x * w1.w) AS pc1, sum(x * w2.w) AS pc2 FROM z JOIN w1 USING (i) JOIN w2 USING (i) GROUP BY vec_id)")
    return ", ".join(steps)


def _kmeans(k: int, rounds: int = 40) -> str:
    """CTEs of seeding and Lloyd rounds; ``l{k}`` holds rows with their labels and squared distances, settled by the last round."""
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [f"s{k}_1 AS MATERIALIZED (SELECT 0 AS j, x FROM v WHERE i = (SELECT count(*) // 2 FROM v))"]
    for c in range(1, k):
        steps.append(f"d{k}_{c} AS MATERIALIZED (SELECT i, sum(d) OVER (ORDER BY i) AS upto, sum(d) OVER () / {k - c + 1} AS goal FROM (SELECT v.i, min({far}) AS d FROM v, s{k}_{c} AS c GROUP BY v.i))")
        steps.append(f"s{k}_{c + 1} AS MATERIALIZED (SELECT j, x FROM s{k}_{c} UNION ALL SELECT {c}, x FROM v WHERE i = (SELECT min(i) FROM d{k}_{c} WHERE upto >= goal))")
    centers = f"s{k}_{k}"
    for t in range(rounds + 1):
        steps.append(f"a{k}_{t} AS MATERIALIZED (SELECT v.i, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min(struct_pack(d := {far}, j := c.j)) AS m FROM v, {centers} AS c GROUP BY v.i)")
        steps.append(f"c{k}_{t} AS MATERIALIZED (SELECT c.j, coalesce(n.x, c.x) AS x FROM {centers} AS c LEFT JOIN (SELECT j, list(x ORDER BY g) AS x FROM (SELECT j, g, avg(x) AS x FROM (SELECT m.j AS j, unnest(x) AS x, generate_subscripts(x, 1) AS g FROM a{k}_{t}) GROUP BY j, g) GROUP BY j) AS n USING (j))")
        centers = f"c{k}_{t}"
    steps.append(f"l{k} AS MATERIALIZED (SELECT vec_id, m.j AS label, m.d AS d FROM a{k}_{rounds})")
    return ", ".join(steps)


_VECTORS = "v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, embedding::DOUBLE[] AS x FROM embeddings)"


def _cluster_view() -> str:
    """Components of four columns of the part study, three clusters of them, statistics of the columns."""
    names = ("p_size", "p_retailprice", "revenue", "discount")
    rows = " UNION ALL ".join(f"SELECT label, '{n}' AS name, {n} AS value FROM part_study JOIN l3 ON vec_id = trial_id" for n in names)
    return f"""WITH {PART}, e AS (SELECT trial_id AS vec_id, [{", ".join(names)}] AS embedding FROM part_study), {_pca("e")},
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, [pc1, pc2] AS x FROM pc), {_kmeans(3)}, r AS MATERIALIZED ({rows}),
g AS (SELECT name, avg(value) AS gm, var_samp(value) AS gv, count(*) AS gn FROM r GROUP BY name), o AS (SELECT label, name, count(*) AS size, avg(value) AS mean, coalesce(var_samp(value), 0) AS var FROM r GROUP BY label, name)
SELECT label::INTEGER AS label, name, size, round(mean, 4) AS mean, round(sqrt(var), 4) AS std, abs(mean - gm) > 3 * sqrt(var / size + gv / gn) AS significant FROM o JOIN g USING (name)"""


def _elbow(top: int = 10) -> str:
    sums = " UNION ALL ".join(f"SELECT {k} AS k, sum(d) AS w FROM l{k}" for k in range(2, top + 1))
    return f"""WITH {_VECTORS}, {", ".join(_kmeans(k) for k in range(2, top + 1))}, w AS MATERIALIZED ({sums}),
b AS (SELECT k, lag(w) OVER (ORDER BY k) - 2 * w + lead(w) OVER (ORDER BY k) AS bend FROM w)
SELECT k, round(w, 4) AS wcss, k = (SELECT k FROM b WHERE bend IS NOT NULL ORDER BY bend DESC, k DESC LIMIT 1) AS recommended FROM w"""


_BEST = f"{EVENTS}, b AS (SELECT *, min(value) OVER (PARTITION BY event_type ORDER BY trial_id ROWS UNBOUNDED PRECEDING) AS best FROM e)"
_JOURNAL = f"{PART}, {_INDEXED}, j AS (SELECT * FROM i WHERE row_idx % 10 <> 9)"
_STATS = ["p_size", "p_retailprice", "revenue", "quantity"]

_STRIPS = "lead(x, 1, r0) OVER ({0} ORDER BY x, trial_id) - x AS w"
_FRONT3 = f"front AS (SELECT trial_id, -balance AS x, discount AS y FROM supplier_study a WHERE NOT EXISTS (SELECT 1 FROM supplier_study b WHERE {_dominated('a', 'b', _SUP3)}))"
_REF = "max(x) + 0.1 * abs(max(x) - min(x)) + 1 AS r0, max(y) + 0.1 * abs(max(y) - min(y)) + 1 AS r1"

SQL = {
    "range_filter": f"WITH {PART} SELECT trial_id, p_size, p_retailprice FROM part_study WHERE p_size BETWEEN 10 AND 30 AND p_retailprice BETWEEN 950 AND 1500",
    "open_range_filter": f"WITH {PART} SELECT trial_id, quantity, discount FROM part_study WHERE quantity >= 800 AND discount <= 0.05",
    "unknown_column_filter": "SELECT p_partkey AS trial_id FROM part WHERE false",
    "decimal_range_filter": f"WITH {PART} SELECT trial_id, p_retailprice::DECIMAL(12,2)::DOUBLE AS price FROM part_study WHERE p_retailprice::DECIMAL(12,2) BETWEEN 950.5 AND 1500",
    "row_positions": f"WITH {PART}, {_INDEXED} SELECT trial_id, row_idx FROM i",
    "trials_batch": f"WITH {PART}, {_INDEXED}, w AS (SELECT * FROM (VALUES (0::BIGINT, 5), (1, 3), (2, 1000000000), (3, 0), (4, 7)) t(ordinal, p)) SELECT ordinal, row_idx, trial_id FROM i JOIN w ON p = row_idx",
    "all_trials": f"WITH {PART} SELECT trial_id, p_size, 0.0::DOUBLE AS p_brand, revenue AS v0 FROM part_study",
    "point_positions": f"WITH {SUPPLIER} SELECT trial_id, balance AS x, discount AS y, quantity AS z FROM supplier_study",
    "single_positions": "SELECT o_orderkey AS trial_id, round((row_number() OVER (ORDER BY o_orderkey) - 1) / greatest(count(*) OVER () - 1, 1), 9) AS x, o_totalprice AS y, 0.0::DOUBLE AS z FROM orders",
    "axis_extents": f"WITH {PART}, r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, min({c}) AS low, max({c}) AS high FROM part_study" for c in ("p_size", "p_retailprice", "revenue")) + ") SELECT name, low, high FROM r",
    "slice_points": f"WITH {PART} SELECT p_size, revenue, p_size > 25 AS selected, CASE WHEN p_size > 25 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS alpha FROM part_study",
    "contour_points": f"WITH {PART} SELECT p_size, p_retailprice, revenue, revenue > 100000 AS selected, CASE WHEN revenue > 100000 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS alpha FROM part_study",
    "scatter_color": f"WITH {PART} SELECT trial_id, round((revenue - min(revenue) OVER ()) / (max(revenue) OVER () - min(revenue) OVER ()), 6) AS color FROM part_study",
    "detail_table": f"WITH {PART} SELECT trial_id, CAST(CAST(p_size AS BIGINT) AS VARCHAR) AS p_size, p_brand, printf('%.4f', revenue) AS revenue FROM part_study",
    "colormap": f"WITH {PART}, c AS (SELECT trial_id, lpad(lower(to_hex(CAST(round(255 * p_size / 64) AS INTEGER))), 2, '0') AS h FROM part_study) SELECT trial_id, '#' || h || h || h AS shade FROM c",
    "scatter_cells": "SELECT a.n AS x, b.n AS y FROM (VALUES ('p_size'), ('p_retailprice'), ('revenue'), ('discount')) a(n), (VALUES ('p_size'), ('p_retailprice'), ('revenue'), ('discount')) b(n)",
    "objective_pairs": "SELECT a.n AS x, b.n AS y FROM (VALUES ('balance'), ('discount'), ('quantity')) a(n), (VALUES ('balance'), ('discount'), ('quantity')) b(n)",
    "report_stats": f"WITH {PART} " + " UNION ALL ".join(f"SELECT '{c}' AS name, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, count(*) AS count FROM part_study" for c in _STATS),
    "csv_rows": f"WITH {PART} SELECT trial_id AS ordinal, concat_ws(',', trial_id::VARCHAR, {_NUMBER.format(x='p_size')}, {_NUMBER.format(x='p_retailprice')}, p_brand, '') AS line FROM part_study",
    "best_so_far": "SELECT o_orderkey AS trial_id, o_totalprice, min(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS best FROM orders",
    "best_so_far_by_type": f"WITH {EVENTS} SELECT event_type, trial_id, max(value) OVER (PARTITION BY event_type ORDER BY trial_id ROWS UNBOUNDED PRECEDING) AS best FROM e",
    "moving_avg5": f"WITH {EVENTS} SELECT event_type, trial_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY trial_id ROWS 4 PRECEDING), 6) AS moving_avg FROM e",
    "improvement_rate": f"WITH {_BEST}, p AS (SELECT *, lag(best) OVER (PARTITION BY event_type ORDER BY trial_id) AS prev FROM b) SELECT event_type, trial_id, best, round(CASE WHEN prev IS NULL OR prev = 0 THEN 0 ELSE abs((prev - best) / prev) * 100 END, 6) AS improvement FROM p",
    "phase_counts": "WITH p AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) / count(*) OVER () AS t FROM orders) SELECT CASE WHEN t < 0.3 THEN 'exploration' WHEN t < 0.7 THEN 'exploitation' ELSE 'convergence' END AS phase, count(*) AS n FROM p GROUP BY 1",
    "best_trials": f"WITH {EVENTS}, p AS (SELECT *, min(value) OVER (PARTITION BY event_type ORDER BY trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e) SELECT event_type, trial_id, value FROM p WHERE before IS NULL OR value < before",
    "convergence": f"WITH {_BEST}, i AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY trial_id) - 1 AS i FROM b), s AS (SELECT event_type, max(n) AS n, max(best) FILTER (WHERE i = floor(n * 0.8)) AS first, max(best) FILTER (WHERE i = n - 1) AS last FROM i GROUP BY event_type), r AS (SELECT *, CASE WHEN first = 0 THEN abs(first - last) ELSE abs((first - last) / first) END AS rate FROM s) SELECT event_type, n, round(rate, 9) AS rate, CASE WHEN n < 10 THEN 'insufficient' WHEN rate < 0.001 THEN 'converged' WHEN rate < 0.01 THEN 'converging' ELSE 'not_converged' END AS verdict FROM r",
    "edf": "SELECT o_orderkey AS trial_id, o_totalprice, round(row_number() OVER (ORDER BY o_totalprice, o_orderkey) / count(*) OVER (), 9) AS y FROM orders",
    "pareto_front": f"WITH {PART}, {_FRONT} SELECT trial_id FROM front",
    "nd_ranks": _ranks(_SUP3),
    "nd_ranks_2d": _ranks(_SUP2),
    "hv_2d": f"WITH {PART}, {_FRONT}, r AS (SELECT max(-revenue) + 0.1 * abs(max(-revenue) - min(-revenue)) + 1 AS r0, max(discount) + 0.1 * abs(max(discount) - min(discount)) + 1 AS r1, count(*) AS n FROM front), s AS (SELECT -revenue AS x, discount AS y, r0, r1, n, lead(-revenue, 1, r0) OVER (ORDER BY -revenue, discount) - (-revenue) AS w FROM front, r) SELECT CASE WHEN max(n) >= 2 THEN round(sum(w * (r1 - y)), 3) END AS hv FROM s",
    "hv_history": f"WITH {SUPPLIER}, c AS (SELECT trial_id, -balance AS x, discount AS y FROM supplier_study), r AS (SELECT max(x) + 0.1 * abs(max(x) - min(x)) + 1 AS r0, max(y) + 0.1 * abs(max(y) - min(y)) + 1 AS r1 FROM c), p AS (SELECT b.trial_id AS t, a.x, a.y, r0, r1 FROM c a JOIN c b ON a.trial_id <= b.trial_id, r), m AS (SELECT t, x, r0, r1, min(y) OVER (PARTITION BY t ORDER BY x, y ROWS UNBOUNDED PRECEDING) AS low, lead(x, 1, r0) OVER (PARTITION BY t ORDER BY x, y) - x AS w FROM p) SELECT t AS trial_id, round(sum(w * (r1 - low)), 4) AS hv FROM m GROUP BY t",
    "hv_3d": f"WITH {SUPPLIER}, {_FRONT3}, r AS (SELECT {_REF}, count(*) AS n FROM front), s AS (SELECT n, r1, y, {_STRIPS.format('')} FROM front, r) SELECT CASE WHEN max(n) >= 2 THEN round(sum(w * (r1 - y)), 4) END AS hv FROM s",
    "hv_history_3d": f"WITH {SUPPLIER}, r AS (SELECT {_REF} FROM (SELECT -balance AS x, discount AS y FROM supplier_study)), p AS (SELECT t.trial_id AS t, a.trial_id, -a.balance AS x, a.discount AS y FROM supplier_study t JOIN supplier_study a ON a.trial_id <= t.trial_id WHERE NOT EXISTS (SELECT 1 FROM supplier_study b WHERE b.trial_id <= t.trial_id AND {_dominated('a', 'b', _SUP3)})), s AS (SELECT t, r1, y, {_STRIPS.format('PARTITION BY t')} FROM p, r) SELECT t AS trial_id, round(sum(w * (r1 - y)), 4) AS hv FROM s GROUP BY t",
    "chebyshev_rank": f"WITH {PART}, s AS (SELECT trial_id, round(greatest(abs(-revenue - min(-revenue) OVER ()) * 0.4, abs(discount - min(discount) OVER ()) * 0.6), 6) AS score FROM part_study) SELECT trial_id, score FROM s ORDER BY score, trial_id LIMIT 50",
    "topsis_rank": f"WITH {PART} " + _topsis("part_study", [("revenue", True), ("discount", False)], [0.5, 0.5]),
    "topsis_top10": f"WITH {SUPPLIER} SELECT * FROM ({_topsis('supplier_study', [('balance', True), ('discount', False), ('quantity', True)], [1 / 3] * 3)}) ORDER BY score DESC, trial_id LIMIT 10",
    "dominance_ratio": f"WITH {PART}, {_FRONT}, n AS (SELECT count(*) FILTER (WHERE p_size <= 25) AS m, count(*) FILTER (WHERE p_size > 25) AS o FROM front) SELECT round(100 * m / (m + o))::INTEGER AS main_pct, round(100 * o / (m + o))::INTEGER AS other_pct, 0 AS non_dominated FROM n",
    "spearman_matrix": f"WITH {_spearman(_COLUMNS)} SELECT param, objective, round(rho, 6) AS rho FROM rho",
    "ridge_two_param": _ridge_table(),
    "sensitivity_selected": _selected(),
    "importance": f"WITH {_spearman(_COLUMNS)} SELECT param, round(avg(abs(rho)), 6) AS importance FROM rho GROUP BY param",
    "heatmap_threshold": f"WITH {_spearman(_COLUMNS)} SELECT param, objective, round(CASE WHEN max(abs(rho)) OVER (PARTITION BY param) < 0.02 THEN 0 ELSE rho END, 6) AS rho FROM rho",
    "label_encode": f"WITH {PART}, first AS (SELECT p_brand AS b, min(trial_id) AS f FROM part_study GROUP BY p_brand), codes AS (SELECT b, (row_number() OVER (ORDER BY f) - 1)::DOUBLE AS code FROM first) SELECT trial_id, code FROM part_study JOIN codes ON b = p_brand",
    "cluster_stats": "WITH v AS (SELECT label, 'e' || i AS name, embedding[i + 1]::DOUBLE AS value FROM embeddings, range(0, 64) t(i)), g AS (SELECT name, avg(value) AS gm, var_samp(value) AS gv, count(*) AS gn FROM v GROUP BY name), o AS (SELECT label, name, count(*) AS size, avg(value) AS mean, coalesce(var_samp(value), 0) AS var FROM v GROUP BY label, name) SELECT label, name, size, round(mean, 6) AS mean, round(sqrt(var), 6) AS std, abs(mean - gm) > 3 * sqrt(var / size + gv / gn) AS significant FROM o JOIN g USING (name)",
    "pdp_1d_ridge": f"WITH {PART}, {_ridge('revenue')} SELECT round(a1 + (b1 - a1) * i / 19, 3) AS x, round(my + beta1 * (a1 + (b1 - a1) * i / 19 - m1) / s1, 3) AS y FROM fit, range(0, 20) t(i)",
    "pdp_2d_ridge": f"WITH {PART}, {_ridge('revenue')} SELECT round(a1 + (b1 - a1) * i / 14, 3) AS x, round(a2 + (b2 - a2) * j / 14, 3) AS y, round(my + beta1 * (a1 + (b1 - a1) * i / 14 - m1) / s1 + beta2 * (a2 + (b2 - a2) * j / 14 - m2) / s2, 3) AS z FROM fit, range(0, 15) t(i), range(0, 15) u(j)",
    "constraint_feasibility": f"WITH {PART}, c AS (SELECT trial_id, round(discount - 0.05, 9) AS c1, round(0.01 - discount, 9) AS c2 FROM part_study) SELECT trial_id, CASE WHEN c1 <= 0 AND c2 <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_feasible, round(c1 + c2, 6) AS constraint_sum FROM c",
    "selection_rows": f"WITH {PART}, {_INDEXED} SELECT 'ranged' AS selection, trial_id FROM i WHERE p_size BETWEEN 10 AND 20 UNION ALL SELECT 'none', trial_id FROM i WHERE p_size BETWEEN 10 AND 20 AND revenue <= 0 UNION ALL SELECT 'brushed', trial_id FROM i WHERE row_idx IN (1, 5) UNION ALL SELECT 'narrowed', trial_id FROM i WHERE p_size BETWEEN 10 AND 20 AND revenue BETWEEN 50000 AND 90000",
    "single_trial": f"WITH {PART}, {_INDEXED} SELECT trial_id, p_size, revenue AS v0, discount AS v1 FROM i WHERE row_idx = 7",
    "effective_ranges": f"WITH {PART} SELECT trial_id, 'p_retailprice' AS axes FROM part_study WHERE p_retailprice BETWEEN 930 AND 975.5",
    "front_line": f"WITH {PART}, {_FRONT} SELECT trial_id, row_number() OVER (ORDER BY revenue, trial_id) - 1 AS place, revenue FROM front",
    "drawn_front": f"WITH {PART}, g AS (SELECT * FROM part_study WHERE p_size <> 7) SELECT trial_id FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE {_dominated('a', 'b', _PART_COSTS)}) UNION ALL SELECT trial_id FROM part_study WHERE p_size = 7",
    "ranks_with_gaps": f"""WITH RECURSIVE {SUPPLIER}, g AS (SELECT * FROM supplier_study WHERE s_nationkey % 5 <> 0), edge AS (SELECT b.trial_id AS u, a.trial_id AS v FROM g a JOIN g b ON {_dominated('a', 'b', _SUP2)}),
chain(id, l) AS (SELECT trial_id, 1 FROM g UNION SELECT v, l + 1 FROM chain JOIN edge ON u = id), k AS (SELECT id AS trial_id, max(l)::INTEGER AS rank FROM chain GROUP BY id),
f AS (SELECT trial_id, -balance AS x, discount AS y FROM g JOIN k USING (trial_id) WHERE rank = 1), r AS (SELECT {_REF}, count(*) AS n FROM f), s AS (SELECT n, r1, y, {_STRIPS.format('')} FROM f, r), h AS (SELECT CASE WHEN max(n) >= 2 THEN round(sum(w * (r1 - y)), 4) END AS hv FROM s)
SELECT trial_id, coalesce(rank, (SELECT max(rank) + 1 FROM k))::INTEGER AS rank, coalesce(rank = 1, false) AS front, hv FROM supplier_study LEFT JOIN k USING (trial_id), h""",
    "edf_objectives": f"WITH {PART}, v AS (SELECT 'revenue' AS objective, trial_id, revenue AS value FROM part_study UNION ALL SELECT 'discount', trial_id, discount FROM part_study) SELECT objective, trial_id, value, round(row_number() OVER (PARTITION BY objective ORDER BY value, trial_id) / count(*) OVER (PARTITION BY objective), 9) AS y FROM v",
    "csv_quoted": f"WITH {PART}, t AS (SELECT trial_id, discount, p_brand || CASE WHEN p_size > 25 THEN ', \"large\"' ELSE '' END AS note FROM part_study) SELECT trial_id AS ordinal, CASE WHEN note LIKE '%,%' OR note LIKE '%\"%' THEN '\"' || replace(note, '\"', '\"\"') || '\"' ELSE note END || ',' || {_NUMBER.format(x='discount')} AS line FROM t",
    "compared_studies": f"WITH {PART}, o AS (SELECT * FROM part_study WHERE p_type IN ('ECONOMY', 'PROMO')), pool AS (SELECT t.p_type AS study, true AS main, revenue, discount FROM part_study s, (SELECT DISTINCT p_type FROM o) t WHERE p_size <= 25 UNION ALL SELECT p_type, false, revenue, discount FROM o), f AS (SELECT study, main FROM pool a WHERE NOT EXISTS (SELECT 1 FROM pool b WHERE b.study = a.study AND {_dominated('a', 'b', _PART_COSTS)})), n AS (SELECT study, count(*) FILTER (WHERE main) AS m, count(*) FILTER (WHERE NOT main) AS o FROM f GROUP BY study) SELECT study, NULL::VARCHAR AS message, round(100 * m / (m + o))::INTEGER AS main_pct, round(100 * o / (m + o))::INTEGER AS other_pct FROM n UNION ALL SELECT 'other way', 'The studies optimize in different directions.', NULL, NULL",
    "journal_studies": f"WITH {_JOURNAL} SELECT 0::BIGINT AS study_id, 'study' AS name, 'maximize,minimize' AS directions, (SELECT count(*) FROM j) AS completed_trials, (SELECT count(*) FROM i) AS total_trials, 'p_retailprice,p_size' AS params, 'obj0,obj1' AS objectives, 'key,tag' AS attrs, true AS has_constraints",
    "journal_trials": f"WITH {_JOURNAL} SELECT row_idx AS trial_id, p_size, revenue, trial_id AS key, 'x' AS tag, CASE WHEN discount - 0.05 <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_feasible FROM j",
    "journal_study_table": f"WITH {_JOURNAL} SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, row_idx AS trial_id, p_size, revenue AS obj0, -1.0::DOUBLE AS c2, CASE WHEN discount - 0.05 <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_feasible FROM j",
    "journal_mixed": f"WITH {PART}, {_INDEXED} SELECT row_idx AS trial_id, 1::BIGINT AS study_id, 1 + 2 * p_size AS n, round(p_retailprice, 6) AS price, (row_idx % 4)::DOUBLE AS brand, CASE WHEN row_idx % 4 = 1 THEN 2.5::DOUBLE END AS w, CASE WHEN row_idx % 8 = 1 THEN 1.0::DOUBLE WHEN row_idx % 4 = 1 THEN 0.0::DOUBLE END AS c_index, CASE row_idx % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS brand_label, CASE WHEN row_idx % 8 = 1 THEN 'B' WHEN row_idx % 4 = 1 THEN 'A' END AS c_label, discount AS disc, revenue AS rev, 0::INTEGER AS n_attrs FROM i",
    "journal_mixed_studies": f"WITH {PART} SELECT 0::BIGINT AS study_id, 'empty' AS name, 0::BIGINT AS completed_trials, 0::BIGINT AS total_trials, 'minimize' AS directions, '' AS param_names, '' AS label_names, '' AS objective_names UNION ALL SELECT 1, 'mixed', count(*), count(*), 'minimize,maximize', 'brand,c,n,price,w', 'brand,c', 'disc,rev' FROM part_study",
    "live_replay": f"WITH {_JOURNAL} SELECT 0::BIGINT AS study_id, row_idx AS trial_id, p_size, revenue FROM j",
    "pca_projection": f"WITH {_pca('embeddings')} SELECT vec_id, round(pc1, 5) AS pc1, round(pc2, 5) AS pc2 FROM pc",
    "cluster_view": _cluster_view(),
    "kmeans": f"WITH {_VECTORS}, {_kmeans(4)} SELECT vec_id, label::INTEGER AS label FROM l4",
    "elbow": _elbow(),
}
