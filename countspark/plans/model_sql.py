"""SQL for fitted models: one common table expression for each level of a tree or round of boosting.

Each function continues a WITH clause that has train and test, with the features of a spec and the label y, and gives the
text of a whole query: keys, risk, pred.
"""

from __future__ import annotations

from countspark.plans.spec import DatasetSpec

RISK_PRED = "round({risk}, 6) + 0.0 AS risk, CAST({risk} >= {threshold} AS INTEGER) AS pred"


def _names(features: list[str]) -> str:
    return ", ".join(f'"{f}"' for f in features)


def _domain(name: str, spec: DatasetSpec, features: list[str]) -> str:
    rows = [(f, v) for f in features for v in spec.domains[f]]
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(f'({f!r}, {v!r}, {i})' for i, (f, v) in enumerate(rows))}) AS t(feature, value, col_idx))"


def _cube(spec: DatasetSpec) -> str:
    return f"cube AS MATERIALIZED (SELECT {_names(spec.features)}, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM train GROUP BY ALL), numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM test)"


def _is(features: list[str], split: str, row: str) -> str:
    """Whether a row has the value that a split names, false for null."""
    return f"coalesce(CASE {split}.feature " + " ".join(f"WHEN '{f}' THEN {row}.\"{f}\"" for f in features) + f" END = {split}.value, false)"


def _gini(a: str, b: str) -> str:
    n = f"({a} + {b})::DOUBLE"
    return f"(1 - ({a} / {n}) * ({a} / {n}) - ({b} / {n}) * ({b} / {n}))"


def _tree(t: str, spec: DatasetSpec, features: list[str], max_depth: int, k_min: int) -> list[str]:
    """Expressions that end in {t}_leaf (rows of numbered, risk)."""
    names, parts = _names(features), [_domain(f"{t}_dom", spec, features), f"{t}_c0 AS (SELECT *, 1::BIGINT AS node FROM cube)", f"{t}_x0 AS (SELECT *, 1::BIGINT AS node FROM numbered)"]
    allowed = f" AND (lp = 0 OR lp >= {k_min}) AND (p - lp = 0 OR p - lp >= {k_min})" if k_min else ""
    size = "(p + n)::DOUBLE"
    gain = f"{_gini('p', 'n')} - ((lp + ln) / {size} * {_gini('lp', 'ln')} + (p + n - lp - ln) / {size} * {_gini('(p - lp)', '(n - ln)')})"
    move = lambda x: f"CASE WHEN b.node IS NULL THEN {x}.node WHEN {_is(features, 'b', x)} THEN 2 * {x}.node ELSE 2 * {x}.node + 1 END AS node"
    for d in range(max_depth):
        parts += [
            f"{t}_h{d} AS (SELECT node, feature, value, sum(n_pos) AS lp, sum(n_neg) AS ln FROM (UNPIVOT (SELECT node, n_pos, n_neg, {names} FROM {t}_c{d}) ON {names} INTO NAME feature VALUE value) GROUP BY ALL)",
            f"{t}_n{d} AS (SELECT node, sum(n_pos) AS p, sum(n_neg) AS n FROM {t}_c{d} GROUP BY node HAVING sum(n_pos) > 0 AND sum(n_neg) > 0)",
            f"{t}_g{d} AS (SELECT h.node, h.feature, h.value, col_idx, {gain} AS gain FROM {t}_h{d} h JOIN {t}_n{d} m ON h.node = m.node JOIN {t}_dom o ON o.feature = h.feature AND o.value = h.value WHERE lp + ln > 0 AND lp + ln < p + n{allowed})",
            f"{t}_b{d} AS MATERIALIZED (SELECT node, feature, value FROM {t}_g{d} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 12) DESC, col_idx) = 1)",
            f"{t}_c{d + 1} AS MATERIALIZED (SELECT c.* EXCLUDE (node), {move('c')} FROM {t}_c{d} c LEFT JOIN {t}_b{d} b ON b.node = c.node)",
            f"{t}_x{d + 1} AS (SELECT x.* EXCLUDE (node), {move('x')} FROM {t}_x{d} x LEFT JOIN {t}_b{d} b ON b.node = x.node)",
        ]
    ends = f"SELECT node, sum(n_pos) / sum(n_pos + n_neg)::DOUBLE AS risk FROM {t}_c{max_depth} GROUP BY node"
    return [*parts, f"{t}_leaf AS (SELECT x.*, e.risk FROM {t}_x{max_depth} x JOIN ({ends}) e ON e.node = x.node)"]


def forest(base: str, spec: DatasetSpec, keys: list[str], subsets: list[list[str]], max_depth: int = 3, k_min: int = 0, threshold: float = 0.5) -> str:
    """The mean risk of one tree for each subset of features."""
    parts = [p for i, s in enumerate(subsets) for p in _tree(f"t{i}", spec, s, max_depth, k_min)]
    key = ", ".join(keys)
    every = " UNION ALL ".join(f"SELECT rid, {key}, risk FROM t{i}_leaf" for i in range(len(subsets)))
    mean = f"sum(risk) / {len(subsets)}"
    return f"WITH {base}, {_cube(spec)}, {', '.join(parts)} SELECT {key}, {RISK_PRED.format(risk=mean, threshold=threshold)} FROM ({every}) GROUP BY rid, {key}"


def _boosted(base: str, spec: DatasetSpec, keys: list[str], start: str, rounds: list[str], risk: str) -> str:
    """rounds end in b{r}(feature, value, at, off): what a stump adds to the score s of rows with its value and of others."""
    parts = [_cube(spec), _domain("bdom", spec, spec.features), f"c0 AS (SELECT *, {start} AS s FROM cube)"]
    for r, step in enumerate(rounds):
        parts += [
            step,
            f"c{r + 1} AS MATERIALIZED (SELECT c.* EXCLUDE (s), c.s + coalesce(CASE WHEN {_is(spec.features, 'b', 'c')} THEN b.at ELSE b.off END, 0) AS s FROM c{r} c LEFT JOIN b{r} b ON true)",
        ]
    steps = " UNION ALL ".join(f"SELECT {r} AS r, * FROM b{r}" for r in range(len(rounds)))
    score = f"{start} + coalesce(sum(CASE WHEN {_is(spec.features, 'b', 'x')} THEN b.at ELSE b.off END), 0)"
    key = ", ".join(f"x.{k}" for k in keys)
    scored = f"SELECT {key}, {score} AS s FROM numbered x LEFT JOIN ({steps}) b ON true GROUP BY x.rid, {key}"
    return f"WITH {base}, {', '.join(parts)} SELECT {', '.join(keys)}, {RISK_PRED.format(risk=risk, threshold=0.5)} FROM ({scored})"


def adaboost(base: str, spec: DatasetSpec, keys: list[str], n_estimators: int = 10) -> str:
    rounds = []
    for r in range(n_estimators):
        used = " UNION ALL ".join(f"SELECT feature, value FROM b{q}" for q in range(r))
        fresh = f" AND NOT EXISTS (SELECT 1 FROM ({used}) u WHERE u.feature = e.feature AND u.value = e.value)" if used else ""
        tall = f"(UNPIVOT (SELECT c.* EXCLUDE (s), n_pos * exp(-s) AS w_pos, n_neg * exp(s) AS w_neg FROM c{r} c) ON {_names(spec.features)} INTO NAME feature VALUE value)"
        wrong = "CASE WHEN says THEN wn ELSE wp END + CASE WHEN other THEN twn - wn ELSE twp - wp END"
        rounds.append(
            f"w{r} AS (SELECT feature, value, sum(n_pos) AS p, sum(n_neg) AS n, sum(w_pos) AS wp, sum(w_neg) AS wn FROM {tall} GROUP BY ALL), "
            f"a{r} AS (SELECT sum(n_pos) AS tp, sum(n_neg) AS tn, sum(n_pos * exp(-s)) AS twp, sum(n_neg * exp(s)) AS twn FROM c{r}), "
            f"e{r} AS (SELECT w.feature, w.value, col_idx, says, ({wrong}) / (twp + twn) AS error FROM (SELECT *, wp >= wn AS says, twp - wp >= twn - wn AS other FROM w{r} CROSS JOIN a{r}) w "
            f"JOIN bdom o ON o.feature = w.feature AND o.value = w.value WHERE p + n > 0 AND p + n < tp + tn AND says <> other), "
            f"b{r} AS MATERIALIZED (SELECT feature, value, CASE WHEN says THEN alpha ELSE -alpha END AS at, CASE WHEN says THEN -alpha ELSE alpha END AS off FROM "
            f"(SELECT *, 0.5 * ln((1 - greatest(error, 1e-12)) / greatest(error, 1e-12)) AS alpha FROM e{r} e WHERE true{fresh} ORDER BY round(error, 12), col_idx LIMIT 1) WHERE error < 0.5)"
        )
    return _boosted(base, spec, keys, "0::DOUBLE", rounds, "(1 / (1 + exp(-2 * s)))")


def boosted_regression(base: str, spec: DatasetSpec, keys: list[str], n_estimators: int = 10, rate: float = 0.3) -> str:
    rounds = []
    for r in range(n_estimators):
        moments = "n_pos - (n_pos + n_neg) / (1 + exp(-s)) AS g, (n_pos + n_neg) / (1 + exp(-s)) * (1 - 1 / (1 + exp(-s))) AS h"
        tall = f"(UNPIVOT (SELECT c.*, {moments} FROM c{r} c) ON {_names(spec.features)} INTO NAME feature VALUE value)"
        gain = "lg * lg / (lh + 1) + (g - lg) * (g - lg) / (h - lh + 1)"
        rounds.append(
            f"w{r} AS (SELECT feature, value, sum(g) AS lg, sum(h) AS lh FROM {tall} GROUP BY ALL), a{r} AS (SELECT sum(g) AS g, sum(h) AS h FROM (SELECT {moments} FROM c{r})), "
            f"b{r} AS MATERIALIZED (SELECT w.feature, w.value, {rate} * lg / (lh + 1) AS at, {rate} * (g - lg) / (h - lh + 1) AS off FROM w{r} w CROSS JOIN a{r} "
            f"JOIN bdom o ON o.feature = w.feature AND o.value = w.value ORDER BY round({gain}, 9) DESC, col_idx LIMIT 1)"
        )
    start = "(SELECT ln(count(*) FILTER (WHERE y = 1) / (count(*) FILTER (WHERE y = 0))::DOUBLE) FROM train)"
    return _boosted(base, spec, keys, start, rounds, "(1 / (1 + exp(-s)))")


def k_modes(base: str, spec: DatasetSpec, start: list[dict[str, str]], rounds: int = 10) -> str:
    """Sizes of the clusters (cluster, cnt)."""
    fs, n = spec.features, len(start)
    parts = [_cube(spec), "m0 AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {f!r}, {c[f]!r})" for k, c in enumerate(start) for f in fs) + ") AS t(cluster, feature, value))"]
    for r in range(rounds + 1):
        apart = ", ".join(" + ".join(f"(c.\"{f}\" IS DISTINCT FROM (SELECT value FROM m{r} WHERE cluster = {k} AND feature = '{f}'))::INTEGER" for f in fs) for k in range(n))
        parts.append(f"k{r} AS MATERIALIZED (SELECT *, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS cluster FROM (SELECT c.*, [{apart}] AS d FROM cube c))")
        if r < rounds:
            tall = f"(UNPIVOT (SELECT cluster, n_pos + n_neg AS n, {_names(fs)} FROM k{r}) ON {_names(fs)} INTO NAME feature VALUE value)"
            new = f"SELECT cluster, feature, value FROM (SELECT cluster, feature, value, sum(n) AS n FROM {tall} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cluster, feature ORDER BY n DESC, value) = 1"
            parts.append(f"m{r + 1} AS MATERIALIZED (SELECT m.cluster, m.feature, coalesce(w.value, m.value) AS value FROM m{r} m LEFT JOIN ({new}) w ON w.cluster = m.cluster AND w.feature = m.feature)")
    return f"WITH {base}, {', '.join(parts)} SELECT cluster, CAST(sum(n_pos + n_neg) AS BIGINT) AS cnt FROM k{rounds} GROUP BY cluster"


def fisher(base: str) -> str:
    """From marg and tot of the base: the sum over all tables with the same margins that are no likelier."""
    choose = lambda x, k: f"(lgamma({x} + 1) - lgamma({k} + 1) - lgamma({x} - {k} + 1))"
    log = lambda k: f"({choose('cols', k)} + {choose('(p + n - cols)', f'(rows - {k})')} - {choose('(p + n)', 'rows')})"
    cells = "SELECT m.feature, m.value, m.n_pos::DOUBLE AS a, (m.n_pos + m.n_neg)::DOUBLE AS rows, s.p::DOUBLE AS cols, s.p::DOUBLE AS p, s.n::DOUBLE AS n FROM marg m JOIN (SELECT feature, sum(n_pos) AS p, sum(n_neg) AS n FROM marg GROUP BY 1) s ON s.feature = m.feature"
    every = f"SELECT *, unnest(range(greatest(0, rows + cols - p - n)::BIGINT, least(rows, cols)::BIGINT + 1))::DOUBLE AS k FROM ({cells})"
    return f"WITH {base}, cells AS ({every}), lls AS (SELECT feature, value, {log('k')} AS l, {log('a')} AS l0 FROM cells) SELECT feature, value, round(least(1.0, sum(CASE WHEN l <= l0 + 1e-9 * greatest(1.0, abs(l0)) THEN exp(l) ELSE 0 END)), 6) + 0.0 AS p_value FROM lls GROUP BY 1, 2"


def _det(rows: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def discriminant(base: str, keys: list[str], columns: tuple[str, ...]) -> str:
    """Three columns: Cramer's rule on the pooled covariance."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    cov = lambda i, j: f"c{min(i, j)}{max(i, j)}"
    stats = ", ".join([f"avg({c}) AS m{i}" for i, c in enumerate(columns)] + [f"covar_pop({columns[i]}, {columns[j]}) AS c{i}{j}" for i, j in pairs])
    pooled = ", ".join(f"(a.k * a.{cov(i, j)} + b.k * b.{cov(i, j)}) / (a.k + b.k) + {1e-9 if i == j else 0} AS {cov(i, j)}" for i, j in pairs)
    means = ", ".join(f"a.m{i} - b.m{i} AS d{i}, (a.m{i} + b.m{i}) / 2 AS h{i}" for i in range(3))
    matrix = [[cov(i, j) for j in range(3)] for i in range(3)]
    weight = lambda k: f"{_det([[f'd{i}' if j == k else matrix[i][j] for j in range(3)] for i in range(3)])} / {_det(matrix)}"
    z = " + ".join(f"w{i} * (x.{c} - h{i})" for i, c in enumerate(columns))
    risk = f"(1 / (1 + exp(-({z} + bias))))"
    return (
        f"WITH {base}, st AS (SELECT y, count(*)::DOUBLE AS k, {stats} FROM train GROUP BY y), "
        f"pl AS (SELECT ln(a.k / b.k) AS bias, {pooled}, {means} FROM st a JOIN st b ON a.y = 1 AND b.y = 0), "
        f"wt AS (SELECT *, {', '.join(f'{weight(k)} AS w{k}' for k in range(3))} FROM pl) "
        f"SELECT {', '.join(f'x.{k}' for k in keys)}, {RISK_PRED.format(risk=risk, threshold=0.5)} FROM test x CROSS JOIN wt"
    )


# ---- linear models


def _solved(name: str, matrix: str, size: int) -> str:
    """name(i, v): the solution, by elimination on the diagonal, of the equations that matrix(i, j, v) holds, the right-hand side as column `size`."""
    lists = f"SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM {matrix} GROUP BY i)"
    step = "list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = k THEN v / m[k][k] ELSE v - r[k] * m[k][j] / m[k][k] END))"
    return (
        f"{name}_e(k, m) AS (SELECT 1::BIGINT, m FROM ({lists}) UNION ALL SELECT k + 1, {step} FROM {name}_e WHERE k <= {size}), "
        f"{name} AS MATERIALIZED (SELECT unnest(range({size})) AS i, unnest(list_transform(m, lambda r: r[{size + 1}])) AS v FROM {name}_e WHERE k = {size + 1})"
    )


def _design(spec: DatasetSpec, index: list[tuple[str, str]]) -> str:
    """cells(cid, n_pos, n_neg) and design(cid, i): the dummies that are one in a cell of the cube, the intercept being 0."""
    names = _names(spec.features)
    places = ", ".join(f"({f!r}, {v!r}, {i + 1})" for i, (f, v) in enumerate(index))
    return (
        f"{_cube(spec)}, cells AS MATERIALIZED (SELECT *, row_number() OVER () AS cid FROM cube), places AS (SELECT * FROM (VALUES {places}) AS t(feature, value, i)), "
        f"design AS MATERIALIZED (SELECT cid, i FROM (UNPIVOT (SELECT cid, {names} FROM cells) ON {names} INTO NAME feature VALUE value) JOIN places USING (feature, value) UNION ALL SELECT cid, 0 FROM cells), "
        f"grid AS (SELECT a.i, b.i AS j FROM range({len(index) + 1}) a(i) CROSS JOIN range({len(index) + 2}) b(i))"
    )


def _normal(name: str, source: str, weight: str, right: str, size: int, ridge: float) -> str:
    """name(i, j, v): sums of weight over pairs of dummies and, as column `size`, of right; source has them by cell."""
    return (
        f"{name}_s AS (SELECT a.i, b.i AS j, sum({weight}) AS v FROM {source} s JOIN design a ON a.cid = s.cid JOIN design b ON b.cid = s.cid GROUP BY 1, 2 "
        f"UNION ALL SELECT a.i, {size}, sum({right}) FROM {source} s JOIN design a ON a.cid = s.cid GROUP BY 1), "
        f"{name} AS MATERIALIZED (SELECT g.i, g.j, coalesce(s.v, 0)::DOUBLE + CASE WHEN g.i = g.j THEN {ridge} ELSE 0 END AS v FROM grid g LEFT JOIN {name}_s s ON s.i = g.i AND s.j = g.j)"
    )


def _suppressed_normal(name: str, size: int, ridge: float, k: int, middle: int) -> str:
    """As _normal() with weight 1, from counts of values below k as the midpoint and of pairs as independence gives them."""
    shown = lambda c: f"CASE WHEN i > 0 AND {c} BETWEEN 1 AND {k - 1} THEN {middle} ELSE {c} END"
    return (
        f"{name}_r AS (SELECT a.i, b.i AS j, sum(n_pos) AS p, sum(n_neg) AS n FROM cells s JOIN design a ON a.cid = s.cid JOIN design b ON b.cid = s.cid GROUP BY 1, 2), "
        f"{name}_o AS (SELECT i, {shown('p')} AS p, {shown('n')} AS n FROM {name}_r WHERE i = j), "
        f"{name}_s AS (SELECT r.i, r.j, CASE WHEN r.i = r.j OR r.i = 0 OR r.j = 0 THEN CASE WHEN r.i = 0 THEN b.p + b.n ELSE a.p + a.n END "
        f"WHEN r.p + r.n < {k} THEN (a.p + a.n) * (b.p + b.n) / (t.p + t.n)::DOUBLE ELSE r.p + r.n END AS v FROM {name}_r r JOIN {name}_o a ON a.i = r.i JOIN {name}_o b ON b.i = r.j CROSS JOIN tot t "
        f"UNION ALL SELECT i, {size}, p FROM {name}_o), "
        f"{name} AS MATERIALIZED (SELECT g.i, g.j, coalesce(s.v, 0)::DOUBLE + CASE WHEN g.i = g.j THEN {ridge} ELSE 0 END AS v FROM grid g LEFT JOIN {name}_s s ON s.i = g.i AND s.j = g.j)"
    )


def linear(base: str, spec: DatasetSpec, keys: list[str], index: list[tuple[str, str]], ridge: float = 0.01, balanced: bool = False, newton: int = 0, use_sigmoid: bool = True, k: int = 0, middle: int = 0) -> str:
    """Least squares of the label on dummies, then so many Newton steps of the logistic likelihood. tot of the base has the class totals."""
    size, own = len(index) + 1, "(s.n_pos * wp + s.n_neg * wn)"
    weigh = "(p + n) / (2 * p)::DOUBLE AS wp, (p + n) / (2 * n)::DOUBLE AS wn" if balanced else "1::DOUBLE AS wp, 1::DOUBLE AS wn"
    plain = _normal("g0", "weighed", f"CASE WHEN a.i = b.i OR a.i = 0 OR b.i = 0 THEN {own} ELSE (s.n_pos + s.n_neg) * (wp + wn) / 2 END", "s.n_pos * wp", size, ridge)
    parts = [
        _design(spec, index), f"weighed AS (SELECT c.*, {weigh} FROM cells c CROSS JOIN tot)",
        _suppressed_normal("g0", size, ridge, k, middle) if k > 1 else plain, _solved("beta0", "g0", size),
    ]
    for r in range(1, newton + 1):
        z = f"SELECT c.cid, any_value(n_pos) AS n_pos, any_value(n_pos + n_neg) AS n, sum(b.v) AS z FROM cells c JOIN design d ON d.cid = c.cid JOIN beta{r - 1} b ON b.i = d.i GROUP BY c.cid"
        parts += [
            f"at{r} AS MATERIALIZED (SELECT *, 1 / (1 + exp(-z)) AS mu FROM ({z}))",
            _normal(f"g{r}", f"at{r}", "s.n * mu * (1 - mu)", "s.n * mu * (1 - mu) * z + s.n_pos - s.n * mu", size, ridge), _solved(f"beta{r}", f"g{r}", size),
        ]
    names = _names(spec.features)
    tall = f"(UNPIVOT (SELECT rid, {names} FROM numbered) ON {names} INTO NAME feature VALUE value)"
    z = f"SELECT rid, sum(v) AS z FROM (SELECT rid, v FROM {tall} JOIN places USING (feature, value) JOIN beta{newton} b USING (i) UNION ALL SELECT rid, v FROM numbered CROSS JOIN beta{newton} b WHERE b.i = 0) GROUP BY rid"
    risk = "(1 / (1 + exp(-z)))" if use_sigmoid else "greatest(0, least(1, z))"
    return f"WITH RECURSIVE {base}, {', '.join(parts)} SELECT {', '.join(keys)}, {RISK_PRED.format(risk=risk, threshold=0.5)} FROM numbered JOIN ({z}) USING (rid)"


def platt(base: str, points: str, steps: int = 15) -> str:
    """(a, b) by Newton steps from (1, 0); points(s, p, n) has the positives and others at each score."""
    parts = ["ab0 AS (SELECT 1::DOUBLE AS a, 0::DOUBLE AS b)"]
    for r in range(steps):
        at = f"SELECT s, p, p + n AS n, 1 / (1 + exp(-(a * s + b))) AS mu, a, b FROM {points} CROSS JOIN ab{r}"
        sums = f"SELECT any_value(a) AS a, any_value(b) AS b, sum((n * mu - p) * s) AS u, sum(n * mu - p) AS v, sum(n * mu * (1 - mu) * s * s) + 1e-9 AS x, sum(n * mu * (1 - mu) * s) AS y, sum(n * mu * (1 - mu)) + 1e-9 AS w FROM ({at})"
        clip = lambda e: f"greatest(-10, least(10, {e}))"
        parts.append(f"ab{r + 1} AS MATERIALIZED (SELECT a - {clip('(u * w - v * y) / (x * w - y * y)')} AS a, b - {clip('(v * x - u * y) / (x * w - y * y)')} AS b FROM ({sums}))")
    return f"WITH {base}, {', '.join(parts)} SELECT round(a, 4) + 0.0 AS a, round(b, 4) + 0.0 AS b FROM ab{steps}"


def principal_components(table: str, columns: list[str], steps: int = 200) -> str:
    """Three columns: two by power iteration, the second on what the first leaves, the third at a right angle to both."""
    at = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    dot = lambda i: " + ".join(f"{at(i, j)} * v{j}" for j in range(3))
    norm = "sqrt(n0 * n0 + n1 * n1 + n2 * n2)"

    def largest(name: str, matrix: str) -> str:
        turned = f"SELECT k, {', '.join(f'{dot(i)} AS n{i}' for i in range(3))} FROM {name}_p CROSS JOIN {matrix} WHERE k < {steps}"
        value = " + ".join(f"v{i} * ({dot(i)})" for i in range(3))
        return (
            f"{name}_p(k, v0, v1, v2) AS (SELECT 0, 1::DOUBLE, 1::DOUBLE, 1::DOUBLE UNION ALL SELECT k + 1, {', '.join(f'n{i} / {norm}' for i in range(3))} FROM ({turned})), "
            f"{name} AS MATERIALIZED (SELECT v0, v1, v2, {value} AS l FROM {name}_p CROSS JOIN {matrix} WHERE k = {steps})"
        )

    cross = ", ".join(f"a.v{i} * b.v{j} - a.v{j} * b.v{i}" for i, j in ((1, 2), (2, 0), (0, 1)))
    sign = "CASE WHEN abs(v0) > 1e-12 THEN sign(v0) WHEN abs(v1) > 1e-12 THEN sign(v1) ELSE sign(v2) END"
    return (
        f"WITH RECURSIVE m AS MATERIALIZED (SELECT {', '.join(f'covar_pop({columns[i]}, {columns[j]}) AS {at(i, j)}' for i, j in pairs)} FROM {table}), {largest('c1', 'm')}, "
        f"rest AS MATERIALIZED (SELECT {', '.join(f'{at(i, j)} - l * v{i} * v{j} AS {at(i, j)}' for i, j in pairs)} FROM m CROSS JOIN c1), {largest('c2', 'rest')}, "
        f"every(component, l, v0, v1, v2) AS (SELECT 0, l, v0, v1, v2 FROM c1 UNION ALL SELECT 1, l, v0, v1, v2 FROM c2 UNION ALL SELECT 2, m.a00 + m.a11 + m.a22 - a.l - b.l, {cross} FROM m CROSS JOIN c1 a CROSS JOIN c2 b) "
        f"SELECT CAST(component AS INTEGER) AS component, round(l, 4) + 0.0 AS variance, {', '.join(f'round(v{i} * {sign}, 4) + 0.0 AS w{i}' for i in range(3))} FROM every"
    )
