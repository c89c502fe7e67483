"""What each registered query must return, as SQL over the same tables (DuckDB dialect)."""

from __future__ import annotations

BUCKETS = {
    "daily": ("CAST(d AS DATE)", "INTERVAL 1 DAY"),
    "weekly": ("CAST(date_trunc('week', d) AS DATE)", "INTERVAL 7 DAY"),
    "monthly": ("CAST(date_trunc('month', d) AS DATE)", "INTERVAL 1 MONTH"),
}
H, LATEST, WINDOW = 20, 8, 6
W = "PARTITION BY priority ORDER BY date"


def rd(expr: str, digits: int = 4) -> str:
    return f"ROUND({expr}, {digits}) + 0"


def revenue(level: str = "weekly") -> str:
    """CTE list: raw, revenue."""
    expr, _ = BUCKETS[level]
    return f"""raw AS (SELECT o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS d,
      CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders),
    revenue AS (SELECT priority, {expr} AS date, CAST(SUM(v) AS DOUBLE) AS y, CAST(COUNT(*) AS DOUBLE) AS x
      FROM raw GROUP BY 1, 2)"""


def gappy(level: str = "daily") -> str:
    step = BUCKETS[level][1]
    return f"""{revenue(level)},
    ends AS (SELECT priority, MIN(date) AS a, MAX(date) AS b FROM revenue GROUP BY 1),
    spine AS (SELECT priority, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), {step})) AS DATE)
      AS date FROM ends),
    gappy AS (SELECT s.priority, s.date, r.y, r.x FROM spine s LEFT JOIN revenue r
      ON r.priority = s.priority AND r.date = s.date)"""


def complete(level: str = "weekly") -> str:
    return f"""{gappy(level)},
    complete AS (SELECT priority, date, COALESCE(y, 0) AS y, COALESCE(x, 0) AS x FROM gappy),
    placed AS (SELECT *, ROW_NUMBER() OVER ({W}) AS rn, COUNT(*) OVER (PARTITION BY priority) AS n FROM complete)"""


BASE_MODELS = ("last", "mean_latest", "mean_all", "weight_last", "median_latest", "median")


def baselines(level: str = "weekly", source: str = "placed", k: int = LATEST) -> str:
    """CTE list ending in preds(priority, step, date, y, model, pred)."""
    recent = f"({W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    past = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""forecast AS (SELECT priority, date, y, rn, n,
        LAG(y) OVER ({W}) AS last,
        AVG(y) OVER {recent} AS mean_latest,
        AVG(y) OVER {past} AS mean_all,
        (SUM(y * rn) OVER {recent} - (MIN(rn) OVER {recent} - 1) * SUM(y) OVER {recent})
          / (COUNT(*) OVER {recent} * (COUNT(*) OVER {recent} + 1) / 2.0) AS weight_last,
        MEDIAN(y) OVER {recent} AS median_latest,
        MEDIAN(y) OVER {past} AS median
      FROM {source}),
    wide AS (SELECT *, CAST(rn - (n - {H}) - 1 AS INTEGER) AS step FROM forecast WHERE rn > n - {H}),
    preds AS (UNPIVOT (SELECT priority, step, date, y, last, mean_latest, mean_all, weight_last, median_latest, median
        FROM wide) ON last, mean_latest, mean_all, weight_last, median_latest, median INTO NAME model VALUE pred)"""


# declared order: family "ts" first, then "baseline"
LABELLED = """labelled AS (SELECT p.*, l.family, l.ord FROM preds p JOIN (VALUES
      ('last', 'ts', 0), ('mean_latest', 'ts', 1), ('weight_last', 'ts', 2),
      ('mean_all', 'baseline', 3), ('median_latest', 'baseline', 4), ('median', 'baseline', 5)) l(model, family, ord)
      ON l.model = p.model)"""

SELECTION = f"""scored AS (SELECT *, AVG(ABS(pred - y)) OVER (PARTITION BY priority, model ORDER BY step
      ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING) AS window_mae FROM labelled),
    ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY priority, step ORDER BY window_mae, ord) AS place
      FROM scored WHERE step >= {WINDOW}),
    selection AS (SELECT priority, step, date, y, model, pred, window_mae FROM ranked WHERE place = 1)"""


def metric_list(digits: int = 3) -> str:
    e = "(y - pred)"
    parts = {
        "Rms": f"SQRT(AVG({e} * {e}))",
        "Mae": f"AVG(ABS({e}))",
        "Mdn": f"MEDIAN(ABS({e}))",
        "Mp": f"AVG(ABS({e} / NULLIF(y, 0))) * 100",
        "Hbb": f"AVG(CASE WHEN ABS({e}) <= 1 THEN {e} * {e} / 2 ELSE ABS({e}) - 0.5 END)",
        "Q25": f"AVG(GREATEST(0.25 * {e}, -0.75 * {e}))",
        "Q75": f"AVG(GREATEST(0.75 * {e}, -0.25 * {e}))",
        "Me": "AVG(pred - y)",
    }
    return ", ".join(f'{rd(v, digits)} AS "{k}"' for k, v in parts.items())


METRIC_NAMES = ("Rms", "Mae", "Mdn", "Mp", "Hbb", "Q25", "Q75", "Me")
ALL_PREDS = f"{complete()}, {baselines()}, {LABELLED}"

# US national holidays 1995-2001 with observed days (day, and how a weekend date moves).
HOLIDAYS = """years AS (SELECT CAST(unnest(range(1994, 2003)) AS INTEGER) AS yr),
    first_days AS (SELECT yr, m, make_date(yr, m, 1) AS f FROM years, (SELECT unnest(range(1, 13)) AS m)),
    -- weekday of the n-th kind: isodow 1 = Monday, 4 = Thursday
    floating AS (
      SELECT f + CAST(((1 - isodow(f) + 7) % 7) + 14 AS INTEGER) AS date FROM first_days WHERE m IN (1, 2)
      UNION ALL SELECT f + CAST(((1 - isodow(f) + 7) % 7) AS INTEGER) FROM first_days WHERE m = 9
      UNION ALL SELECT f + CAST(((1 - isodow(f) + 7) % 7) + 7 AS INTEGER) FROM first_days WHERE m = 10
      UNION ALL SELECT f + CAST(((4 - isodow(f) + 7) % 7) + 21 AS INTEGER) FROM first_days WHERE m = 11
      UNION ALL SELECT f + 30 - CAST((isodow(f + 30) - 1) AS INTEGER) FROM first_days WHERE m = 5),
    fixed AS (SELECT make_date(yr, h.m, h.dd) AS date FROM years, (VALUES (1, 1), (7, 4), (11, 11), (12, 25)) h(m, dd)),
    observed AS (SELECT CASE isodow(date) WHEN 6 THEN date - 1 WHEN 7 THEN date + 1 END AS date FROM fixed
      WHERE isodow(date) >= 6),
    holidays AS (SELECT DISTINCT CAST(date AS DATE) AS date FROM (SELECT date FROM floating UNION ALL
      SELECT date FROM fixed UNION ALL SELECT date FROM observed) WHERE year(date) BETWEEN 1995 AND 2001)"""


def _lags(cols: dict[str, int]) -> str:
    return ", ".join(f"LAG({v}, {i}) OVER ({W}) AS lag_{v}_{i}" for v, n in cols.items() for i in range(1, n + 1))


def _erf_cdf(x: str) -> str:
    z = f"(ABS({x}) / SQRT(2.0))"
    t = f"(1 / (1 + 0.3275911 * {z}))"
    poly = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))))"
    erf = f"(1 - {poly} * EXP(-{z} * {z}))"
    return f"(CASE WHEN {x} >= 0 THEN 0.5 * (1 + {erf}) ELSE 0.5 * (1 - {erf}) END)"


def _decompose(level: str, p: int) -> str:
    half = p // 2
    if p % 2:
        total = f"SUM(y) OVER ({W} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) / {p}"
    else:
        total = (f"(SUM(y) OVER ({W} ROWS BETWEEN {half - 1} PRECEDING AND {half - 1} FOLLOWING)"
                 f" + 0.5 * (LAG(y, {half}) OVER ({W}) + LEAD(y, {half}) OVER ({W}))) / {p}")
    return f"""WITH {complete(level)},
    t AS (SELECT priority, date, y AS observed, (rn - 1) % {p} AS phase,
        CASE WHEN rn > {half} AND rn <= n - {half} THEN {total} END AS trend FROM placed WHERE n >= {2 * p}),
    m AS (SELECT priority, phase, AVG(observed - trend) AS pm FROM t GROUP BY 1, 2),
    c AS (SELECT priority, AVG(pm) AS centre FROM m GROUP BY 1)
    SELECT t.priority, t.date, t.observed, {rd('t.trend')} AS trend, {rd('m.pm - c.centre')} AS seasonal,
        {rd('t.observed - t.trend - (m.pm - c.centre)')} AS resid
    FROM t JOIN m ON m.priority = t.priority AND m.phase = t.phase JOIN c ON c.priority = t.priority"""


def _one_regressor() -> str:
    past = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    forms = {
        "linear": "sxy / sxx",
        "ridge": "sxy / (sxx + 1e12)",
        "lasso": "SIGN(sxy) * GREATEST(ABS(sxy / m) - 1e10, 0) / (sxx / m)",
        "elastic": "SIGN(sxy) * GREATEST(ABS(sxy / m) - 0.25, 0) / (sxx / m + 0.25)",
    }
    rows = " UNION ALL ".join(
        f"SELECT priority, step, date, '{k}' AS model, {rd(f'my + ({v}) * (x1 - mx)', 1)} AS pred FROM cells"
        for k, v in forms.items()
    )
    return f"""WITH {complete()},
    pairs AS (SELECT priority, date, y, rn, n, LAG(y) OVER ({W}) AS x1 FROM placed),
    ok AS (SELECT * FROM pairs WHERE x1 IS NOT NULL),
    cells AS (SELECT priority, date, CAST(rn - (n - {H}) - 1 AS INTEGER) AS step, x1,
        REGR_COUNT(y, x1) OVER {past} AS m, REGR_AVGX(y, x1) OVER {past} AS mx, REGR_AVGY(y, x1) OVER {past} AS my,
        REGR_SXX(y, x1) OVER {past} AS sxx, REGR_SXY(y, x1) OVER {past} AS sxy, rn, n FROM ok
      QUALIFY rn > n - {H})
    {rows}"""


def _two_regressors() -> str:
    past = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""WITH {complete()},
    lagged AS (SELECT priority, date, y, rn, n, {_lags({'y': 2})} FROM placed),
    ok AS (SELECT priority, date, y, rn, n, lag_y_1 AS a, lag_y_2 AS b FROM lagged WHERE lag_y_2 IS NOT NULL),
    cells AS (SELECT priority, date, CAST(rn - (n - {H}) - 1 AS INTEGER) AS step, a, b,
        AVG(y) OVER {past} AS my, AVG(a) OVER {past} AS ma, AVG(b) OVER {past} AS mb,
        REGR_SXX(y, a) OVER {past} AS saa, REGR_SXX(y, b) OVER {past} AS sbb, REGR_SXY(b, a) OVER {past} AS sab,
        REGR_SXY(y, a) OVER {past} AS say, REGR_SXY(y, b) OVER {past} AS sby, rn, n FROM ok
      QUALIFY rn > n - {H}),
    solved AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS wa,
        (sby * saa - say * sab) / (saa * sbb - sab * sab) AS wb FROM cells)
    SELECT priority, step, date, 'linear' AS model, {rd('my + wa * (a - ma) + wb * (b - mb)', 1)} AS pred FROM solved"""


def _knn() -> str:
    past = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""WITH {complete()},
    f AS (SELECT priority, date, y, rn, n, {_lags({'y': 3})} FROM placed),
    h AS (SELECT * FROM f WHERE lag_y_3 IS NOT NULL),
    o AS (SELECT priority, date, rn, lag_y_1 AS a, lag_y_2 AS b, lag_y_3 AS c,
        CAST(rn - (n - {H}) - 1 AS INTEGER) AS step FROM h WHERE rn > n - {H}),
    pairs AS (SELECT o.priority, o.step, o.date, h.y, h.rn,
        ABS(h.lag_y_1 - a) + ABS(h.lag_y_2 - b) + ABS(h.lag_y_3 - c) AS d1,
        SQRT((h.lag_y_1 - a) * (h.lag_y_1 - a) + (h.lag_y_2 - b) * (h.lag_y_2 - b) + (h.lag_y_3 - c) * (h.lag_y_3 - c)) AS d2
      FROM o JOIN h ON h.priority = o.priority AND h.rn < o.rn),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY priority, step ORDER BY d1, rn) AS r1,
        ROW_NUMBER() OVER (PARTITION BY priority, step ORDER BY d2, rn) AS r2 FROM pairs)
    SELECT priority, step, date, 'knn_uniform' AS model, {rd('AVG(y)', 2)} AS pred FROM r WHERE r1 <= 5 GROUP BY 1, 2, 3
    UNION ALL
    SELECT priority, step, date, 'knn_distance',
        {rd('CASE WHEN COUNT(*) FILTER (d2 = 0) > 0 THEN AVG(y) FILTER (d2 = 0) '
            'ELSE SUM(y / NULLIF(d2, 0)) / SUM(1 / NULLIF(d2, 0)) END', 2)}
    FROM r WHERE r2 <= 5 GROUP BY 1, 2, 3"""


def _holt() -> str:
    return f"""WITH RECURSIVE {complete('monthly')},
    grid AS (SELECT a, b, ROW_NUMBER() OVER (ORDER BY a, b) AS g FROM (VALUES (0.2), (0.5), (0.8)) x(a),
        (VALUES (0.1), (0.6)) z(b)),
    run AS (
      SELECT p.priority, CAST(2 AS BIGINT) AS rn, g, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b,
          p.y AS level, p.y - q.y AS trend, CAST(0 AS DOUBLE) AS sse
      FROM placed p JOIN placed q ON q.priority = p.priority AND q.rn = 1, grid WHERE p.rn = 2
      UNION ALL
      SELECT r.priority, p.rn, g, a, b, a * p.y + (1 - a) * (level + trend),
          b * (a * p.y + (1 - a) * (level + trend) - level) + (1 - b) * trend,
          sse + (p.y - (level + trend)) * (p.y - (level + trend))
      FROM run r JOIN placed p ON p.priority = r.priority AND p.rn = r.rn + 1),
    ahead AS (SELECT p.priority, p.date, CAST(p.rn - (p.n - {H}) - 1 AS INTEGER) AS step, r.level + r.trend AS pred,
        ROW_NUMBER() OVER (PARTITION BY p.priority, p.rn ORDER BY r.sse, r.g) AS place
      FROM placed p JOIN run r ON r.priority = p.priority AND r.rn = p.rn - 1 WHERE p.rn > p.n - {H})
    SELECT priority, step, date, 'holt' AS model, {rd('pred', 2)} AS pred FROM ahead WHERE place = 1"""


def _acf() -> str:
    return f"""{complete()},
    c AS (SELECT priority, rn, n, y - AVG(y) OVER (PARTITION BY priority) AS c FROM placed),
    lags AS (SELECT CAST(unnest(range(0, 21)) AS INTEGER) AS lag),
    acf AS (SELECT a.priority, l.lag, ANY_VALUE(a.n) AS n,
        SUM(a.c * b.c) / ANY_VALUE(v.v) AS acf
      FROM lags l, c a JOIN c b ON b.priority = a.priority
      JOIN (SELECT priority, SUM(c * c) AS v FROM c GROUP BY 1) v ON v.priority = a.priority
      WHERE b.rn = a.rn - l.lag GROUP BY 1, 2)"""


def _pacf() -> str:
    """Durbin-Levinson over the autocorrelations held as one list per key."""
    return f"""WITH RECURSIVE {_acf()},
    r AS (SELECT priority, LIST(acf ORDER BY lag) AS r, ANY_VALUE(n) AS n FROM acf GROUP BY 1),
    dl AS (
      SELECT priority, 0 AS k, CAST([] AS DOUBLE[]) AS phi, CAST(NULL AS DOUBLE) AS f FROM r
      UNION ALL
      SELECT priority, k, list_append(list_transform(range(1, k), lambda j: phi[j] - f * phi[k - j]), f), f
      FROM (SELECT d.priority, d.k + 1 AS k, d.phi,
          (r.r[d.k + 2] - COALESCE(list_sum(list_transform(range(1, d.k + 1), lambda j: d.phi[j] * r.r[d.k + 2 - j])), 0))
          / (1 - COALESCE(list_sum(list_transform(range(1, d.k + 1), lambda j: d.phi[j] * r.r[j + 1])), 0)) AS f
        FROM dl d JOIN r ON r.priority = d.priority WHERE d.k < 20))
    SELECT dl.priority, CAST(k AS INTEGER) AS lag, {rd('f', 6)} AS pacf, {rd('1.96 / SQRT(r.n)', 6)} AS bound
    FROM dl JOIN r ON r.priority = dl.priority WHERE k > 0"""


def _unit_root() -> str:
    tau = "tau"
    low = f"(2.1659 + 1.4412 * {tau} + 0.038269 * {tau} * {tau})"
    high = f"(1.7339 + 0.93202 * {tau} - 0.12745 * {tau} * {tau} - 0.010368 * {tau} * {tau} * {tau})"
    return f"""WITH {complete('monthly')},
    p AS (SELECT priority, n, y - LAG(y) OVER ({W}) AS dy, LAG(y) OVER ({W}) AS y1 FROM placed),
    s AS (SELECT priority, ANY_VALUE(n) AS nobs, REGR_SLOPE(dy, y1) AS b, REGR_COUNT(dy, y1) AS m,
        REGR_SXX(dy, y1) AS sxx, REGR_SYY(dy, y1) AS syy, REGR_SXY(dy, y1) AS sxy FROM p GROUP BY 1),
    t AS (SELECT priority, nobs, b / SQRT((syy - sxy * sxy / sxx) / (m - 2) / sxx) AS tau FROM s)
    SELECT priority, {rd('tau', 5)} AS stat, nobs, {rd(
        f'CASE WHEN tau < -18.83 THEN 0 WHEN tau <= -1.61 THEN {_erf_cdf(low)} WHEN tau <= 2.74 THEN {_erf_cdf(high)} '
        'ELSE 1 END', 5)} AS p_value FROM t"""


def _scaled(loc: str, scale: str) -> str:
    cols = ", ".join(
        f"{rd(f'({c} - {loc.format(c=c)}) / NULLIF({scale.format(c=c)}, 0)', 6)} AS {c}" for c in ("y", "x")
    )
    return f"WITH {complete()} SELECT priority, date, {cols} FROM complete"


def _over(fn: str) -> str:
    return f"{fn} OVER (PARTITION BY priority)"


def _fold() -> str:
    base, extra, pos = "(n // 3)", "(n % 3)", "(rn - 1)"
    return (f"CAST(CASE WHEN {pos} < {extra} * ({base} + 1) THEN {pos} // ({base} + 1) "
            f"ELSE {extra} + ({pos} - {extra} * ({base} + 1)) // {base} END AS INTEGER)")


def _undo() -> str:
    return f"""WITH {complete()},
    d AS (SELECT priority, rn, n, y, LAG(y, 1) OVER ({W}) AS y1, LAG(y, 2) OVER ({W}) AS y2, LAG(y, 3) OVER ({W}) AS y3
      FROM placed)
    SELECT priority, CAST(rn - (n - {H}) - 1 AS INTEGER) AS step,
        ((y1 - y2) - (y2 - y3)) + (y1 - y2) + y1 AS from_second, (y1 - y2) + y1 AS from_first
    FROM d WHERE rn > n - {H}"""


def _carried(direction: str) -> str:
    frame = {
        "ffill": ("LAST_VALUE", "UNBOUNDED PRECEDING AND CURRENT ROW"),
        "bfill": ("FIRST_VALUE", "CURRENT ROW AND UNBOUNDED FOLLOWING"),
    }[direction]
    cols = ", ".join(f"{frame[0]}({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN {frame[1]}) AS {c}" for c in ("y", "x"))
    return f"WITH {gappy()} SELECT priority, date, {cols} FROM gappy"


def filled(level: str = "daily") -> str:
    """CTE list ending in filled: gaps interpolated by row position, leading nulls kept, trailing ones repeated."""
    back = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = f"({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    ends = ", ".join(
        f"LAST_VALUE({c} IGNORE NULLS) OVER {back} AS p{c}, FIRST_VALUE({c} IGNORE NULLS) OVER {ahead} AS n{c}"
        for c in ("y", "x", "spot")
    )
    line = ", ".join(
        f"COALESCE({c}, p{c} + (n{c} - p{c}) * (rn - pspot) / (nspot - pspot), p{c}) AS {c}" for c in ("y", "x")
    )
    return f"""{gappy(level)},
    numbered AS (SELECT *, ROW_NUMBER() OVER ({W}) AS rn FROM gappy),
    marked AS (SELECT *, CASE WHEN y IS NOT NULL THEN rn END AS spot FROM numbered),
    ended AS (SELECT *, {ends} FROM marked),
    filled AS (SELECT priority, date, {line} FROM ended)"""


# --- least squares in SQL -----------------------------------------------------------------------------------------


def expanding_cells(p: int) -> str:
    """CTE cells(priority, step, i, j, s): z'[z, y] over the rows before each origin, from
    design(priority, rn, n, y, z) whose rows are complete. Position p + 1 stands for y."""
    return f"""zy AS (SELECT priority, CASE WHEN rn > n - {H} THEN rn - (n - {H}) ELSE 0 END AS block,
        list_append(z, y) AS v FROM design),
    sums AS (SELECT priority, block, i, j, SUM(v[i] * v[j]) AS s
      FROM zy, (SELECT unnest(range(1, {p + 2})) AS i), (SELECT unnest(range(1, {p + 2})) AS j) GROUP BY ALL),
    cells AS (SELECT * FROM (SELECT priority, CAST(block AS INTEGER) AS step, i, j,
        SUM(s) OVER (PARTITION BY priority, i, j ORDER BY block) AS s FROM sums) WHERE step < {H})"""


def fixed_cells(ids: str, p: int) -> str:
    """CTE cells(ids, i, j, s) over all rows of design(ids, y, z)."""
    return f"""cells AS (SELECT {ids}, i, j, SUM(list_append(z, y)[i] * list_append(z, y)[j]) AS s
      FROM design, (SELECT unnest(range(1, {p + 2})) AS i), (SELECT unnest(range(1, {p + 2})) AS j) GROUP BY ALL)"""


def gauss(ids: str, p: int, source: str = "cells", extra: str = "0", name: str = "") -> str:
    """CTE beta(ids, b): solves the normal equations in `source` by elimination. `extra` is added to the diagonal
    (a ridge penalty, or 1 for a column that is switched off). The last list entry is the solution for the second
    unit vector's own place, i.e. the inverse's (2, 2) cell."""
    return f"""dense{name} AS (SELECT {ids}, i, j, s + CASE WHEN i = j THEN {extra} ELSE 0 END AS s FROM {source} WHERE i <= {p}
      UNION ALL SELECT DISTINCT {ids}, i, {p + 2}, CASE WHEN i = 2 THEN 1.0 ELSE 0.0 END FROM {source} WHERE i <= {p}),
    lines{name} AS (SELECT {ids}, i, LIST(s ORDER BY j) AS r FROM dense{name} GROUP BY ALL),
    start{name} AS (SELECT {ids}, LIST(r ORDER BY i) AS m FROM lines{name} GROUP BY ALL),
    steps{name} AS (SELECT {ids}, 1 AS k, m FROM start{name}
      UNION ALL SELECT {ids}, k + 1, list_transform(range(1, {p + 1}), lambda i: CASE WHEN i = k
          THEN list_transform(m[k], lambda v: v / m[k][k])
          ELSE list_transform(range(1, {p + 3}), lambda j: m[i][j] - m[i][k] / m[k][k] * m[k][j]) END)
        FROM steps{name} WHERE k <= {p}),
    beta{name} AS (SELECT {ids}, list_transform(range(1, {p + 1}), lambda i: m[i][{p + 1}]) AS b, m[2][{p + 2}] AS inv
      FROM steps{name} WHERE k = {p + 1})"""


def dot(a: str, b: str, p: int) -> str:
    return f"list_sum(list_transform(range(1, {p + 1}), lambda i: {a}[i] * {b}[i]))"


def _centred(cols: list[str]) -> str:
    return ", ".join(f"{c} - AVG({c}) OVER (PARTITION BY priority)" for c in cols)


def _many_regressors() -> str:
    names = ["lag_y_1", "lag_y_2", "lag_y_3", "lag_y_4", "mean_y", "yr", "wk"]
    p = len(names) + 1
    parts = []
    for model, extra, tag in (("linear", "0", "_a"), ("ridge", "CASE WHEN i > 1 THEN 1.0 ELSE 0 END", "_b")):
        parts.append((model, tag, gauss("priority, step", p, extra=extra, name=tag)))
    rows = " UNION ALL ".join(
        f"""SELECT o.priority, o.step, o.date, '{model}' AS model, {rd(dot('b.b', 'o.z', p), 0)} AS pred
        FROM origin o JOIN beta{tag} b ON b.priority = o.priority AND b.step = o.step""" for model, tag, _ in parts
    )
    return f"""WITH RECURSIVE {complete()},
    f AS (SELECT priority, date, y, rn, n, {_lags({'y': 4})},
        AVG(y) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 2 PRECEDING) AS mean_y, year(date) AS yr,
        CASE WHEN week(date) >= 52 AND month(date) = 1 THEN 0 ELSE week(date) END AS wk FROM placed),
    design AS (SELECT priority, date, y, rn, n, [1.0, {_centred(names)}] AS z FROM f WHERE lag_y_4 IS NOT NULL),
    origin AS (SELECT *, CAST(rn - (n - {H}) - 1 AS INTEGER) AS step FROM design WHERE rn > n - {H}),
    {expanding_cells(p)}, {', '.join(g for _, _, g in parts)}
    {rows}"""


def _ar_order(top: int = 12) -> str:
    p = top + 1
    lags = ", ".join(f"LAG(y, {i}) OVER ({W}) AS l{i}" for i in range(1, top + 1))
    z = ", ".join(f"CASE WHEN o.o >= {i} THEN l{i} - mu ELSE 0 END" for i in range(1, top + 1))
    return f"""WITH RECURSIVE {complete()},
    f AS (SELECT priority, rn, y, AVG(y) OVER (PARTITION BY priority) AS mu, {lags} FROM placed),
    design AS (SELECT priority, o.o, y - mu AS y, [1.0, {z}] AS z FROM f,
        (SELECT CAST(unnest(range(1, {top + 1})) AS INTEGER) AS o) o WHERE rn > o.o),
    {fixed_cells('priority, o', p)}, {gauss('priority, o', p, extra='CASE WHEN i > o + 1 THEN 1.0 ELSE 0 END')},
    e AS (SELECT d.priority, d.o, COUNT(*) AS m, SUM(POWER(d.y - {dot('b.b', 'd.z', p)}, 2)) AS sse
      FROM design d JOIN beta b ON b.priority = d.priority AND b.o = d.o GROUP BY ALL),
    s AS (SELECT *, m * (LN(2 * PI() * sse / m) + 1) + 2 * (o + 2) * LN(LN(m)) AS score FROM e)
    SELECT priority, o AS lag_order FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY priority ORDER BY score, o) = 1"""


def _unit_root_augmented(series: str, keys: str, top: int) -> str:
    """CTE list ending in tests(keys, stat, used_lag, nobs); `series` is a CTE with keys, date and y."""
    w = f"PARTITION BY {keys} ORDER BY date"
    p = top + 2
    lags = ", ".join(f"LAG(d, {i}) OVER ({w}) AS d{i}" for i in range(1, top + 1))
    on = " AND ".join(f"{{a}}.{k.strip()} = {{b}}.{k.strip()}" for k in keys.split(","))
    ids = f"{keys}, o"

    def z(limit: str) -> str:
        return ", ".join(f"CASE WHEN {limit} >= {i} THEN d{i} ELSE 0 END" for i in range(1, top + 1))

    off = "CASE WHEN i > o + 2 THEN 1.0 ELSE 0 END"
    return f"""a AS (SELECT {keys}, date, y - LAG(y) OVER ({w}) AS d, LAG(y) OVER ({w}) AS y1,
        COUNT(y) OVER (PARTITION BY {keys}) AS nobs FROM {series} WHERE y IS NOT NULL),
    c AS (SELECT {keys}, date, d, y1 - AVG(y1) OVER (PARTITION BY {keys}) AS y1, nobs,
        CAST(LEAST(CEIL(12 * POWER(nobs / 100.0, 0.25)), nobs // 2 - 2) AS INTEGER) AS cap,
        ROW_NUMBER() OVER ({w}) - 1 AS r, {lags} FROM a WHERE d IS NOT NULL),
    design AS (SELECT {keys}, o.o, d AS y, [1.0, y1, {z('o.o')}] AS z FROM c,
        (SELECT CAST(unnest(range(0, {top + 1})) AS INTEGER) AS o) o WHERE o.o <= cap AND r >= cap),
    {fixed_cells(ids, p)}, {gauss(ids, p, extra=off)},
    e AS (SELECT {', '.join('g.' + k.strip() for k in keys.split(','))}, g.o, COUNT(*) AS m,
        SUM(POWER(g.y - {dot('b.b', 'g.z', p)}, 2)) AS sse
      FROM design g JOIN beta b ON {on.format(a='b', b='g')} AND b.o = g.o GROUP BY ALL),
    chosen AS (SELECT {keys}, o FROM e
      QUALIFY ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY m * (LN(2 * PI() * sse / m) + 1) + 2 * (o + 2), o) = 1),
    final AS (SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, h.o, nobs, d AS y, [1.0, y1, {z('h.o')}] AS z
      FROM c JOIN chosen h ON {on.format(a='h', b='c')} WHERE r >= h.o),
    {fixed_cells(ids, p).replace('cells AS', 'cells2 AS').replace('FROM design', 'FROM final')},
    {gauss(ids, p, source='cells2', extra=off, name='2')},
    tests AS (SELECT {', '.join('g.' + k.strip() for k in keys.split(','))}, ANY_VALUE(g.nobs) AS nobs, g.o AS used_lag,
        ANY_VALUE(b.b[2]) / SQRT(SUM(POWER(g.y - {dot('b.b', 'g.z', p)}, 2)) / (COUNT(*) - g.o - 2) * ANY_VALUE(b.inv))
        AS stat
      FROM final g JOIN beta2 b ON {on.format(a='b', b='g')} GROUP BY {', '.join('g.' + k.strip() for k in keys.split(','))}, g.o)"""


def p_value(tau: str) -> str:
    low = f"(2.1659 + 1.4412 * {tau} + 0.038269 * {tau} * {tau})"
    high = f"(1.7339 + 0.93202 * {tau} - 0.12745 * {tau} * {tau} - 0.010368 * {tau} * {tau} * {tau})"
    return (f"CASE WHEN {tau} < -18.83 THEN 0 WHEN {tau} <= -1.61 THEN {_erf_cdf(low)} "
            f"WHEN {tau} <= 2.74 THEN {_erf_cdf(high)} ELSE 1 END")


def _difference_choice(top: int = 17) -> str:
    names = (("y", "p_level"), ("f", "p_first"), ("g", "p_second"))
    wide = ", ".join(f"MAX(CASE WHEN kind = '{k}' THEN {p_value('stat')} END) AS {name}" for k, name in names)
    return f"""WITH RECURSIVE {complete()},
    diffs AS (SELECT priority, date, y, y - LAG(y) OVER ({W}) AS f,
        y - 2 * LAG(y) OVER ({W}) + LAG(y, 2) OVER ({W}) AS g FROM placed),
    kinds AS (SELECT priority, 'y' AS kind, date, y FROM diffs UNION ALL SELECT priority, 'f', date, f FROM diffs
      UNION ALL SELECT priority, 'g', date, g FROM diffs),
    {_unit_root_augmented('kinds', 'priority, kind', top)},
    w AS (SELECT priority, {wide} FROM tests GROUP BY 1)
    SELECT priority, {rd('p_level', 5)} AS p_level, {rd('p_first', 5)} AS p_first, {rd('p_second', 5)} AS p_second,
      CAST(CASE WHEN p_level < 0.05 THEN 0 WHEN p_first < 0.05 THEN 1 WHEN p_second < 0.05 THEN 2 ELSE 0 END AS INTEGER)
      AS diff_order FROM w"""


def _arma(max_p: int = 4, max_q: int = 4, exogenous: bool = False, name: str = "arima_eda") -> str:
    long = max_p + max_q + 4
    e = int(exogenous)
    p1, p2 = long + 1 + e, max_p + max_q + 1 + e
    x = ", x0" if exogenous else ""
    ls = ", ".join(f"LAG(v, {i}) OVER ({W}) AS l{i}" for i in range(1, long + 1))
    es = ", ".join(f"LAG(e, {i}) OVER ({W}) AS e{i}" for i in range(1, max_q + 1))
    z1 = ", ".join(f"l{i}" for i in range(1, long + 1)) + x
    z2 = ", ".join([f"l{i}" for i in range(1, max_p + 1)] + [f"e{i}" for i in range(1, max_q + 1)]) + x
    used = f"({{c}} <= 1 + p OR ({{c}} > {1 + max_p} AND {{c}} <= {1 + max_p} + q) OR {{c}} > {1 + max_p + max_q})"
    return f"""WITH RECURSIVE {complete()},
    level AS (SELECT priority, AVG(y) AS mu FROM placed GROUP BY 1),
    v AS (SELECT priority, date, rn, n, y - mu AS v, LAG(x) OVER ({W}) AS x0 FROM placed JOIN level USING (priority)),
    lagged AS (SELECT *, {ls} FROM v),
    first_design AS (SELECT priority, rn, n, v AS y, [1.0, {z1}] AS z FROM lagged WHERE l{long} IS NOT NULL),
    {fixed_cells('priority', p1).replace('cells AS', 'cells1 AS')
        .replace('FROM design', f'FROM (SELECT * FROM first_design WHERE rn <= n - {H})')},
    {gauss('priority', p1, source='cells1', name='1')},
    resid AS (SELECT l.*, l.v - {dot('b.b', f'[1.0, {z1}]', p1)} AS e FROM lagged l JOIN beta1 b
        ON b.priority = l.priority WHERE l{long} IS NOT NULL),
    with_e AS (SELECT *, {es} FROM resid),
    design AS (SELECT priority, date, rn, n, v AS y, [1.0, {z2}] AS z FROM with_e WHERE e{max_q} IS NOT NULL),
    origin AS (SELECT *, CAST(rn - (n - {H}) - 1 AS INTEGER) AS step FROM design WHERE rn > n - {H}),
    {expanding_cells(p2)},
    orders AS (SELECT p, q FROM (SELECT CAST(unnest(range(0, {max_p + 1})) AS INTEGER) AS p),
        (SELECT CAST(unnest(range(0, {max_q + 1})) AS INTEGER) AS q)),
    tried AS (SELECT priority, step, p, q, i, j, CASE WHEN {used.format(c='i')} AND {used.format(c='j')} THEN s
        WHEN i = j THEN 1.0 ELSE 0.0 END AS s FROM cells, orders),
    {gauss('priority, step, p, q', p2, source='tried', name='2')},
    fits AS (SELECT b.*, m.s AS m, yy.s - list_sum(list_transform(range(1, {p2 + 1}), lambda i: b.b[i] * cy.c[i])) AS sse
      FROM beta2 b JOIN cells m ON m.priority = b.priority AND m.step = b.step AND m.i = 1 AND m.j = 1
      JOIN cells yy ON yy.priority = b.priority AND yy.step = b.step AND yy.i = {p2 + 1} AND yy.j = {p2 + 1}
      JOIN (SELECT priority, step, p, q, LIST(s ORDER BY i) AS c FROM tried WHERE j = {p2 + 1} GROUP BY ALL) cy
        ON cy.priority = b.priority AND cy.step = b.step AND cy.p = b.p AND cy.q = b.q),
    best AS (SELECT * FROM fits QUALIFY ROW_NUMBER() OVER (PARTITION BY priority, step
      ORDER BY m * (LN(2 * PI() * sse / m) + 1) + 2 * (p + q + {e} + 2), p, q) = 1)
    SELECT o.priority, o.step, o.date, '{name}' AS model, {rd(f"{dot('b.b', 'o.z', p2)} + l.mu", 0)} AS pred
    FROM origin o JOIN best b ON b.priority = o.priority AND b.step = o.step JOIN level l ON l.priority = o.priority"""


def _additive(hinges: int = 3, weekly: int = 3) -> str:
    """Daily series: trend with hinges, weekly waves, holiday and day-after marks; ridge with a noise level from a
    first, lightly penalised fit."""
    hinge = [f"GREATEST(t - {0.8 * j / hinges}, 0)" for j in range(1, hinges + 1)]
    day = "date_diff('day', DATE '1970-01-01', date)"
    waves = [f"{fn}({day} * (2 * PI() / 7.0) * {k})" for k in range(1, weekly + 1) for fn in ("SIN", "COS")]
    p = 2 + len(hinge) + len(waves) + 2
    weights = [0.0, 0.0] + [1 / 0.05**2] * hinges + [1 / 10.0**2] * (len(waves) + 2)
    scale = "[" + ", ".join(str(w) for w in weights) + "]"
    mix = f"list_sum(list_transform(range(1, {p + 1}), lambda i: b.b[i] * {{o}}[i]))"
    return f"""WITH RECURSIVE {complete('daily')}, {HOLIDAYS},
    core AS (SELECT priority, MIN(date) AS first, MAX(date) FILTER (rn <= n - {H}) AS last,
        MAX(ABS(y)) FILTER (rn <= n - {H}) AS size FROM placed GROUP BY 1),
    f AS (SELECT p.priority, p.date, p.rn, p.n, p.y / c.size AS y, c.size,
        date_diff('day', c.first, p.date) / CAST(date_diff('day', c.first, c.last) AS DOUBLE) AS t,
        CAST(a.date IS NOT NULL AS DOUBLE) AS h0, CAST(b.date IS NOT NULL AS DOUBLE) AS h1
      FROM placed p JOIN core c ON c.priority = p.priority LEFT JOIN holidays a ON a.date = p.date
      LEFT JOIN holidays b ON b.date = p.date - 1),
    design AS (SELECT priority, date, rn, n, size, y, [1.0, t, {', '.join(hinge + waves)}, h0, h1] AS z FROM f),
    origin AS (SELECT *, CAST(rn - (n - {H}) - 1 AS INTEGER) AS step FROM design WHERE rn > n - {H}),
    {expanding_cells(p)},
    sizes AS (SELECT priority, step, s AS m FROM cells WHERE i = 1 AND j = 1),
    light AS (SELECT c.priority, c.step, i, j, s + CASE WHEN i = j AND i <= {p} AND {scale}[i] > 0 THEN 1e-6 * m ELSE 0 END AS s
      FROM cells c JOIN sizes z ON z.priority = c.priority AND z.step = c.step),
    {gauss('priority, step', p, source='light', name='1')},
    misfit AS (SELECT c.priority, c.step, GREATEST(SUM(s * CASE WHEN i = {p + 1} THEN 1 ELSE -b.b[i] END
          * CASE WHEN j = {p + 1} THEN 1 ELSE -b.b[j] END) / (ANY_VALUE(m) - {p - 1} - 1), 1e-12) AS noise
      FROM cells c JOIN beta1 b ON b.priority = c.priority AND b.step = c.step
      JOIN sizes z ON z.priority = c.priority AND z.step = c.step GROUP BY 1, 2),
    ridge AS (SELECT c.priority, c.step, i, j, s + CASE WHEN i = j AND i <= {p} THEN noise * {scale}[i] ELSE 0 END AS s
      FROM cells c JOIN misfit z ON z.priority = c.priority AND z.step = c.step),
    {gauss('priority, step', p, source='ridge', name='2')}
    SELECT o.priority, o.step, o.date, 'prophet' AS model, {rd(mix.format(o='o.z') + ' * o.size', 0)} AS pred
    FROM origin o JOIN beta2 b ON b.priority = o.priority AND b.step = o.step"""


def _harmonic(level: str = "daily", periods=(7, 30), top: int = 3, memory: int = 2) -> str:
    waves = []
    for period in periods:
        for k in range(1, min(top, period // 2) + 1):
            for fn in ("SIN", "COS"):
                waves.append((k, f"{fn}(rn * (2 * PI() * {k} / {period}))"))
    p = 2 + len(waves) + memory
    ls = ", ".join(f"LAG(y, {i}) OVER ({W}) AS l{i}" for i in range(1, memory + 1))
    z = ", ".join(["CAST(rn AS DOUBLE) / n - 0.5", *[w for _, w in waves],
                   *[f"l{i} - mu" for i in range(1, memory + 1)]])
    orders = "[" + ", ".join(["0", "0", *[str(k) for k, _ in waves], *["-1"] * memory, "0"]) + "]"
    keep = "(CASE WHEN kinds[{c}] = -1 THEN memory = 1 ELSE kinds[{c}] <= harmonics END)"
    used = f"len(list_filter(kinds, lambda k: CASE WHEN k = -1 THEN memory = 1 ELSE k <= harmonics END)) - 2"
    return f"""WITH RECURSIVE {complete(level)},
    f AS (SELECT priority, date, y, rn, n, AVG(y) OVER (PARTITION BY priority) AS mu, {ls} FROM placed),
    design AS (SELECT priority, date, rn, n, y - mu AS y, mu, [1.0, {z}] AS z FROM f WHERE l{memory} IS NOT NULL),
    origin AS (SELECT *, CAST(rn - (n - {H}) - 1 AS INTEGER) AS step FROM design WHERE rn > n - {H}),
    {expanding_cells(p)},
    designs AS (SELECT harmonics, memory, {orders} AS kinds, harmonics * 2 + (1 - memory) AS o
      FROM (SELECT CAST(unnest(range(0, {top + 1})) AS INTEGER) AS harmonics), (VALUES (1), (0)) t(memory)),
    tried AS (SELECT priority, step, o, i, j, CASE WHEN {keep.format(c='i')} AND {keep.format(c='j')} THEN s
        WHEN i = j THEN 1.0 ELSE 0.0 END AS s FROM cells, designs),
    {gauss('priority, step, o', p, source='tried', name='2')},
    fits AS (SELECT b.*, m.s AS m, {used} AS k,
        yy.s - list_sum(list_transform(range(1, {p + 1}), lambda i: b.b[i] * cy.c[i])) AS sse
      FROM beta2 b JOIN designs d ON d.o = b.o
      JOIN cells m ON m.priority = b.priority AND m.step = b.step AND m.i = 1 AND m.j = 1
      JOIN cells yy ON yy.priority = b.priority AND yy.step = b.step AND yy.i = {p + 1} AND yy.j = {p + 1}
      JOIN (SELECT priority, step, o, LIST(s ORDER BY i) AS c FROM tried WHERE j = {p + 1} GROUP BY ALL) cy
        ON cy.priority = b.priority AND cy.step = b.step AND cy.o = b.o),
    best AS (SELECT * FROM fits QUALIFY ROW_NUMBER() OVER (PARTITION BY priority, step
      ORDER BY m * (LN(2 * PI() * sse / m) + 1) + 2 * (k + 2), o) = 1)
    SELECT o.priority, o.step, o.date, 'tbats' AS model, {rd(f"{dot('b.b', 'o.z', p)} + o.mu", 0)} AS pred
    FROM origin o JOIN best b ON b.priority = o.priority AND b.step = o.step"""


def _stacked() -> str:
    return f"""WITH RECURSIVE {ALL_PREDS},
    c AS (SELECT *, pred - AVG(pred) OVER (PARTITION BY priority, model) AS cp FROM labelled),
    design_all AS (SELECT priority, family, step, ANY_VALUE(y) AS y, list_prepend(1.0, LIST(cp ORDER BY ord)) AS z,
        AVG(pred) AS mean FROM c GROUP BY ALL),
    design AS (SELECT o.priority, o.family, o.step, d.y, d.z FROM design_all o JOIN design_all d
        ON d.priority = o.priority AND d.family = o.family AND d.step < o.step WHERE o.step >= 6),
    {fixed_cells('priority, family, step', 4)}, {gauss('priority, family, step', 4)}
    SELECT o.priority, o.step, CASE o.family WHEN 'ts' THEN 'ts_wavg' ELSE 'bsln_wavg' END AS model,
        {rd(f"CASE WHEN o.step < 6 THEN o.mean ELSE {dot('b.b', 'o.z', 4)} END", 1)} AS pred
    FROM design_all o LEFT JOIN beta b ON b.priority = o.priority AND b.family = o.family AND b.step = o.step"""


def _penalised(alpha: str = "2e10", rounds: int = 900) -> str:
    """Lasso and elastic net on three lags by coordinate steps, one coordinate per round."""
    p = 3
    return f"""WITH RECURSIVE {complete()},
    f AS (SELECT priority, date, y, rn, n, {_lags({'y': 3})} FROM placed),
    design AS (SELECT priority, date, y, rn, n, [1.0, {_centred(['lag_y_1', 'lag_y_2', 'lag_y_3'])}] AS z FROM f
      WHERE lag_y_3 IS NOT NULL),
    origin AS (SELECT *, CAST(rn - (n - {H}) - 1 AS INTEGER) AS step FROM design WHERE rn > n - {H}),
    {expanding_cells(p + 1)},
    lines AS (SELECT priority, step, i, LIST(s ORDER BY j) AS r FROM cells GROUP BY ALL),
    g AS (SELECT priority, step, LIST(r ORDER BY i) AS g FROM lines GROUP BY ALL),
    s AS (SELECT priority, step, model, l1, l2, g[1][1] AS m, list_transform(range(2, 5), lambda i: g[1][i] / g[1][1]) AS mx,
        g[1][5] / g[1][1] AS my,
        list_transform(range(2, 5), lambda i: list_transform(range(2, 6), lambda j:
          (g[i][j] - g[1][i] * g[1][j] / g[1][1]) / g[1][1])) AS a
      FROM g, (VALUES ('lasso', CAST({alpha} AS DOUBLE), 0.0), ('elastic', 0.3, 0.7)) t(model, l1, l2)),
    cd AS (SELECT *, 0 AS k, CAST([0, 0, 0] AS DOUBLE[]) AS w FROM s
      UNION ALL SELECT priority, step, model, l1, l2, m, mx, my, a, k + 1, list_transform(range(1, 4), lambda i: CASE WHEN i = k % 3 + 1
          THEN SIGN(a[i][4] - list_sum(list_transform(range(1, 4), lambda j: CASE WHEN j = i THEN 0 ELSE a[i][j] * w[j] END)))
            * GREATEST(ABS(a[i][4] - list_sum(list_transform(range(1, 4), lambda j: CASE WHEN j = i THEN 0 ELSE a[i][j] * w[j] END)))
            - l1, 0) / (a[i][i] + l2) ELSE w[i] END) FROM cd WHERE k < {rounds})
    SELECT o.priority, o.step, o.date, model,
        {rd('my + list_sum(list_transform(range(1, 4), lambda i: w[i] * (o.z[i + 1] - mx[i])))', 0)} AS pred
    FROM origin o JOIN cd ON cd.priority = o.priority AND cd.step = o.step WHERE k = {rounds}"""


def _knn_search() -> str:
    return f"""WITH {complete()},
    f AS (SELECT priority, y, rn, n, {_lags({'y': 2})} FROM placed),
    member AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY priority ORDER BY rn) - 1 AS pos, COUNT(*) OVER (PARTITION BY priority)
      AS m FROM f WHERE lag_y_2 IS NOT NULL AND rn < n),
    folds AS (SELECT priority, y, rn, lag_y_1 AS a, lag_y_2 AS b, CASE WHEN pos < (m % 3) * (m // 3 + 1)
      THEN pos // (m // 3 + 1) ELSE (m % 3) + (pos - (m % 3) * (m // 3 + 1)) // (m // 3) END AS fold FROM member),
    pairs AS (SELECT v.priority, v.rn AS vr, v.y AS vy, v.fold, t.rn, t.y, pw.p, CASE pw.p WHEN 1
        THEN ABS(v.a - t.a) + ABS(v.b - t.b) ELSE SQRT((v.a - t.a) * (v.a - t.a) + (v.b - t.b) * (v.b - t.b)) END AS d
      FROM folds v JOIN folds t ON t.priority = v.priority AND t.fold <> v.fold, (VALUES (1), (2)) pw(p)),
    near AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY priority, p, vr ORDER BY d, rn) AS place FROM pairs
      QUALIFY place <= 9),
    tried AS (SELECT priority, p, vr, fold, ANY_VALUE(vy) AS vy, c.i, c.k, c.w, CASE c.w WHEN 'uniform' THEN AVG(y)
        ELSE CASE WHEN COUNT(*) FILTER (d = 0) > 0 THEN AVG(y) FILTER (d = 0)
          ELSE SUM(y / NULLIF(d, 0)) / SUM(1 / NULLIF(d, 0)) END END AS pred
      FROM near JOIN (VALUES (0, 3, 'uniform'), (1, 3, 'distance'), (2, 5, 'uniform'), (3, 5, 'distance'),
        (4, 9, 'uniform'), (5, 9, 'distance')) c(i, k, w) ON place <= c.k GROUP BY priority, p, vr, fold, c.i, c.k, c.w),
    mse AS (SELECT priority, p, i, k, w, fold, AVG((vy - pred) * (vy - pred)) AS e FROM tried GROUP BY ALL),
    mean AS (SELECT priority, p, i, k, w, AVG(e) AS e FROM mse GROUP BY ALL)
    SELECT priority, CAST(k AS INTEGER) AS n_neighbors, w AS weights, CAST(p AS INTEGER) AS p FROM mean
    QUALIFY ROW_NUMBER() OVER (PARTITION BY priority ORDER BY e, i, p) = 1"""


def _seasonal(m: int = 4) -> str:
    """Four trend/season candidates of one period over a 2 x 2 x 2 weight grid."""
    ahead = "(CASE WHEN tk = 'add' THEN level + trend ELSE level * trend END)"
    season = f"season[CAST((k % {m}) AS INTEGER) + 1]"
    full = f"(CASE WHEN sk = 'add' THEN {ahead} + {season} ELSE {ahead} * {season} END)"
    bare = f"(CASE WHEN sk = 'add' THEN v - {season} ELSE v / NULLIF({season}, 0) END)"
    new = f"(a * {bare} + (1 - a) * {ahead})"
    grown = f"(CASE WHEN tk = 'add' THEN {new} - level ELSE {new} / NULLIF(level, 0) END)"
    fresh = f"(CASE WHEN sk = 'add' THEN g * (v - {ahead}) ELSE g * (v / NULLIF({ahead}, 0)) END + (1 - g) * {season})"
    return f"""WITH RECURSIVE {complete()},
    grid AS (SELECT a, b, g, tk, sk, ROW_NUMBER() OVER (ORDER BY tk, sk) AS cand, ROW_NUMBER() OVER (ORDER BY a, b, g) AS pt FROM
      (VALUES (CAST(0.1 AS DOUBLE)), (0.5)) x1(a), (VALUES (CAST(0.1 AS DOUBLE)), (0.5)) x2(b),
      (VALUES (CAST(0.1 AS DOUBLE)), (0.5)) x3(g), (VALUES ('add'), ('mul')) x4(tk), (VALUES ('add'), ('mul')) x5(sk)),
    lists AS (SELECT priority, LIST(y ORDER BY rn) AS ys, ANY_VALUE(n) AS n FROM placed GROUP BY 1),
    init AS (SELECT *, list_avg(ys[1:{m}]) AS f1, list_avg(ys[{m + 1}:{2 * m}]) AS f2 FROM lists WHERE n >= {2 * m}),
    scan AS (
      SELECT priority, n, a, b, g, tk, sk, pt, CAST(0 AS BIGINT) AS k, f1 AS level,
        CASE WHEN tk = 'add' THEN (f2 - f1) / {m} ELSE POWER(f2 / f1, 1.0 / {m}) END AS trend,
        list_transform(ys[1:{m}], lambda v: CASE WHEN sk = 'add' THEN v - f1 ELSE v / f1 END) AS season,
        CAST(0 AS DOUBLE) AS sse FROM init, grid
      UNION ALL
      SELECT priority, n, a, b, g, tk, sk, pt, k + 1, {new}, b * {grown} + (1 - b) * trend,
        list_transform(range(1, {m + 1}), lambda i: CASE WHEN i = k % {m} + 1 THEN {fresh} ELSE season[i] END),
        sse + (v - {full}) * (v - {full})
      FROM (SELECT s.*, l.ys[k + 1] AS v FROM scan s JOIN lists l USING (priority) WHERE k < s.n - 1)),
    ahead AS (SELECT priority, n, k, tk, sk, pt, sse, {full} AS pred FROM scan WHERE k >= n - {H} AND k >= {2 * m}),
    dead AS (SELECT priority, MIN(rn) AS first_zero FROM placed WHERE y <= 0 GROUP BY 1),
    live AS (SELECT a.* FROM ahead a LEFT JOIN dead d USING (priority)
      WHERE (tk = 'add' AND sk = 'add') OR first_zero IS NULL OR first_zero > k),
    points AS (SELECT * FROM live QUALIFY ROW_NUMBER() OVER (PARTITION BY priority, k, tk, sk ORDER BY sse, pt) = 1),
    best AS (SELECT * FROM points QUALIFY ROW_NUMBER() OVER (PARTITION BY priority, k
      ORDER BY k * LN(sse / k) + 2 * {5 + m}, tk, sk) = 1)
    SELECT p.priority, p.date, CAST(p.rn - (p.n - {H}) - 1 AS INTEGER) AS step, 'exp_smooth' AS model, {rd('b.pred', 1)} AS pred
    FROM placed p LEFT JOIN best b ON b.priority = p.priority AND b.k = p.rn - 1 WHERE p.rn > p.n - {H}"""


_CORR_COLS = ("y", "x", "lag_y_1", "lag_y_2")

ORACLES: dict[str, str] = {
    "read_csv_typed": """SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_orderpriority, o_totalprice FROM orders""",
    "read_parquet_table": "SELECT c_mktsegment, COUNT(*) AS customers FROM customer GROUP BY 1",
    "split_reader": """SELECT CAST(o_orderkey AS VARCHAR) AS "key", o_orderpriority AS priority,
        o_orderstatus AS status FROM orders""",
    "split_text_file": 'SELECT CAST(c_custkey AS VARCHAR) AS "key", c_mktsegment AS segment FROM customer',
    "drop_header_rows": """SELECT event_id, CAST(value AS VARCHAR) AS reading FROM events WHERE event_type <> 'error'""",
    "european_number": "SELECT o_orderkey, o_totalprice AS price FROM orders",
    "percent_number": f"""SELECT l_orderkey, l_linenumber, {rd('(ROUND(l_discount * 100) + 0.5) / 100', 6)} AS pct
        FROM lineitem""",
    "safe_numeric": """SELECT CAST(o_orderkey AS DOUBLE) AS id, CAST(o_custkey AS DOUBLE) AS cust,
        CASE WHEN o_orderstatus = 'F' THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS mixed, o_orderpriority FROM orders""",
    "column_roles": """SELECT CAST(l_shipdate AS DATE) AS l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax
        FROM lineitem""",
    "write_and_read_results": f"WITH {complete('monthly')} SELECT * FROM complete",
    "parse_dates": """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day,
        CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_orderdate AS DATE) AS slashed FROM orders""",
    "parse_timestamps": """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END AS day FROM events""",
    "parse_short_years": """SELECT o_orderkey, make_date(CASE WHEN o_custkey % 100 <= 30 THEN 2000 ELSE 1900 END
        + o_custkey % 100, month(o_orderdate), 1) AS month FROM orders""",
    "bucket_daily": f"WITH {revenue('daily')} SELECT * FROM revenue",
    "bucket_weekly": f"WITH {revenue('weekly')} SELECT * FROM revenue",
    "bucket_monthly": f"WITH {revenue('monthly')} SELECT * FROM revenue",
    "bucket_means_and_sums": f"""SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, {rd('AVG(l_quantity)')} AS qty,
        CAST(SUM(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE) AS price FROM lineitem GROUP BY 1""",
    "bucket_none": """SELECT l_returnflag, CAST(l_shipdate AS DATE) AS date,
        CAST(SUM(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE) AS price FROM lineitem GROUP BY l_returnflag, l_shipdate""",
    "bucket_keyed_first": f"""SELECT l_returnflag, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
        {rd('AVG(l_quantity)')} AS qty, CAST(SUM(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE) AS price,
        FIRST(l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) FILTER (l_linestatus = 'O') AS supplier
        FROM lineitem GROUP BY 1, 2""",
    "date_ranges": f"WITH {revenue('daily')} SELECT priority, MIN(date) AS min_date, MAX(date) AS max_date FROM revenue GROUP BY 1",
    "gap_spine_daily": f"WITH {gappy('daily')} SELECT * FROM gappy",
    "gap_spine_weekly": f"WITH {gappy('weekly')} SELECT * FROM gappy",
    "gap_spine_monthly": f"WITH {gappy('monthly')} SELECT * FROM gappy",
    "drop_null": f"WITH {gappy()} SELECT * FROM gappy WHERE y IS NOT NULL AND x IS NOT NULL",
    "fill_const": f"WITH {gappy()} SELECT priority, date, COALESCE(y, 7) AS y, COALESCE(x, 7) AS x FROM gappy",
    "fill_mean": f"""WITH {gappy()} SELECT priority, date, {rd(f"COALESCE(y, {_over('AVG(y)')})")} AS y,
        {rd(f"COALESCE(x, {_over('AVG(x)')})")} AS x FROM gappy""",
    "fill_median": f"""WITH {gappy()} SELECT priority, date, COALESCE(y, {_over('MEDIAN(y)')}) AS y,
        COALESCE(x, {_over('MEDIAN(x)')}) AS x FROM gappy""",
    "fill_carry_forward": _carried("ffill"),
    "fill_take_next": _carried("bfill"),
    "interpolate_linear": f"""WITH {filled()} SELECT priority, date, {rd('y')} AS y, {rd('x')} AS x FROM filled""",
    "divide_by_constant": f"WITH {complete()} SELECT priority, date, y / 8 AS y, x FROM complete",
    "shift_exogenous": f"WITH {complete()} SELECT priority, date, y, LAG(x) OVER ({W}) AS x FROM complete",
    "cut_extremes": f"WITH {complete()} SELECT priority, date, y, x FROM placed WHERE rn > 1 AND rn < n",
    "differences": f"""WITH {complete()} SELECT priority, date, y, x, y - LAG(y) OVER ({W}) AS difference,
        y - 2 * LAG(y) OVER ({W}) + LAG(y, 2) OVER ({W}) AS secdifference FROM complete""",
    "difference_evolution": f"""WITH {complete('daily')} SELECT priority, date, y - LAG(y) OVER ({W}) AS difference,
        y - 2 * LAG(y) OVER ({W}) + LAG(y, 2) OVER ({W}) AS secdifference FROM complete""",
    "lag_block": f"WITH {complete()} SELECT priority, date, y, x, {_lags({'y': 4, 'x': 4})} FROM complete",
    "lag_block_by_key": f"""WITH {complete()}, l AS (SELECT *, CAST(LENGTH(priority) % 3 + 1 AS INTEGER) AS k,
        LAG(y, 1) OVER ({W}) AS l1, LAG(y, 2) OVER ({W}) AS l2, LAG(y, 3) OVER ({W}) AS l3 FROM complete)
        SELECT priority, date, y, x, k, l1 AS lag_y_1, CASE WHEN k >= 2 THEN l2 ELSE 0 END AS lag_y_2,
        CASE WHEN k >= 3 THEN l3 ELSE 0 END AS lag_y_3 FROM l""",
    "newest_rows": f"WITH {complete()} SELECT priority, date, y, x FROM placed WHERE rn > n - 5",
    "oldest_rows": f"WITH {complete()} SELECT priority, date, y, x FROM placed WHERE rn <= 5",
    "single_row_back": f"WITH {complete()} SELECT priority, date, y, x FROM placed WHERE rn = n - 3",
    "wide_to_long": f"""WITH {complete('monthly')} SELECT priority, date, 'y' AS name, y AS value FROM complete
        UNION ALL SELECT priority, date, 'x', x FROM complete""",
    "long_to_wide": f"""WITH {revenue('monthly')} SELECT date, {', '.join(
        f'MAX(x) FILTER (priority = {chr(39)}{p}{chr(39)}) AS "{p}"'
        for p in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'))} FROM revenue GROUP BY date""",
    "stack_tables": f"""WITH {revenue('monthly')}, w AS (SELECT priority, CAST(date_trunc('week', d) AS DATE) AS date,
        CAST(SUM(v) AS DOUBLE) AS y FROM raw GROUP BY 1, 2)
        SELECT priority, date, y, 'monthly' AS level FROM revenue UNION ALL SELECT priority, date, y, 'weekly' FROM w""",
    "zip_tables": f"""WITH {complete()} SELECT priority, CAST(rn - (n - {H}) - 1 AS INTEGER) AS step, y, x
        FROM placed WHERE rn > n - {H}""",
    "norm_minmax": _scaled(_over("MIN({c})"), f"({_over('MAX({c})')} - {_over('MIN({c})')})"),
    "norm_zscore": _scaled(_over("AVG({c})"), _over("STDDEV_POP({c})")),
    "norm_robust": _scaled(
        _over("MEDIAN({c})"), f"({_over('QUANTILE_CONT({c}, 0.75)')} - {_over('QUANTILE_CONT({c}, 0.25)')})"
    ),
    "norm_parameters": f"""WITH {complete()} SELECT priority, 'y' AS "column", 'z' AS method, {rd('AVG(y)')} AS p1,
        {rd('STDDEV_POP(y)')} AS p2 FROM complete GROUP BY 1 UNION ALL
        SELECT priority, 'x', 'z', {rd('AVG(x)')}, {rd('STDDEV_POP(x)')} FROM complete GROUP BY 1""",
    "norm_train_only": f"""WITH {complete()}, s AS (SELECT priority, MIN(y) AS lo, MAX(y) AS hi FROM placed
        WHERE rn <= n - {H} GROUP BY 1)
        SELECT c.priority, date, {rd('(y - lo) / NULLIF(hi - lo, 0)', 6)} AS y FROM complete c
        JOIN s ON s.priority = c.priority""",
    "norm_round_trip": f"WITH {complete()} SELECT * FROM complete",
    "roll_mean": f"""WITH {complete()} SELECT priority, date, y, x,
        {rd(f'AVG(y) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 2 PRECEDING)')} AS mean_y_1_10,
        {rd(f'AVG(x) OVER ({W} ROWS BETWEEN 13 PRECEDING AND 13 PRECEDING)')} AS mean_x_12_13 FROM complete""",
    "roll_median": f"""WITH {complete()} SELECT priority, date, y, x,
        MEDIAN(y) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 2 PRECEDING) AS median_y_1_10,
        MEDIAN(x) OVER ({W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS median_x_0_4 FROM complete""",
    "roll_weighted_mean": f"""WITH {complete()}, f AS (SELECT *,
        LIST(y) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 2 PRECEDING) AS ys FROM complete)
        SELECT priority, date, y, x, {rd('list_sum(list_transform(range(1, len(ys) + 1), lambda i: i * ys[i]))'
        ' / (len(ys) * (len(ys) + 1) / 2.0)')} AS mean_weighted_y_1_10 FROM f""",
    "calendar_weekly": f"""WITH {complete()} SELECT priority, date, CAST(year(date) AS INTEGER) AS "Year",
        CAST(CASE WHEN week(date) >= 52 AND month(date) = 1 THEN 0 ELSE week(date) END AS INTEGER) AS "Week" FROM complete""",
    "calendar_monthly": f"""WITH {complete('monthly')} SELECT priority, date, CAST(year(date) AS INTEGER) AS "Year",
        CAST(month(date) AS INTEGER) AS "Month" FROM complete""",
    "calendar_daily": f"""WITH {complete('daily')} SELECT priority, date, CAST(year(date) AS INTEGER) AS "Year",
        CAST(month(date) AS INTEGER) AS "Month", CAST(day(date) AS INTEGER) AS "Day" FROM complete""",
    "holiday_flag": f"""WITH {complete('daily')}, {HOLIDAYS} SELECT c.priority, c.date,
        CAST(h.date IS NOT NULL AS INTEGER) AS holidays_fe FROM complete c LEFT JOIN holidays h ON h.date = c.date""",
    "holiday_week": f"""WITH {complete('weekly')}, {HOLIDAYS}, b AS (SELECT CAST(date_trunc('week', date) AS DATE) AS date,
        COUNT(*) AS c FROM holidays GROUP BY 1) SELECT s.priority, s.date, CAST(COALESCE(c, 0) AS INTEGER) AS holidays_fe
        FROM complete s LEFT JOIN b ON b.date = s.date""",
    "holiday_month": f"""WITH {complete('monthly')}, {HOLIDAYS}, b AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date,
        COUNT(*) AS c FROM holidays GROUP BY 1) SELECT s.priority, s.date, CAST(COALESCE(c, 0) AS INTEGER) AS holidays_fe
        FROM complete s LEFT JOIN b ON b.date = s.date""",
    "constant_columns": f"""WITH {complete()} SELECT priority, 'y' AS "column", COUNT(DISTINCT y) <= 1 AS is_constant
        FROM complete GROUP BY 1 UNION ALL SELECT priority, 'x', COUNT(DISTINCT x) <= 1 FROM complete GROUP BY 1
        UNION ALL SELECT priority, 'flat', TRUE FROM complete GROUP BY 1""",
    "corr_matrix": f"WITH {complete()}, l AS (SELECT *, {_lags({'y': 2})} FROM complete) " + " UNION ALL ".join(
        f"SELECT priority, '{a}' AS a, '{b}' AS b, {rd(f'CORR({a}, {b})', 6)} AS corr FROM l GROUP BY 1"
        for a in _CORR_COLS for b in _CORR_COLS
    ),
    "binned_counts": f"""WITH {complete('daily')}, e AS (SELECT priority, MIN(y) AS y0, MAX(y) AS y1, MIN(x) AS x0,
        MAX(x) AS x1 FROM complete GROUP BY 1)
        SELECT c.priority, CAST(LEAST(FLOOR(COALESCE((y - y0) / NULLIF(y1 - y0, 0), 0) * 20), 19) AS INTEGER) AS bin_x,
        CAST(LEAST(FLOOR(COALESCE((x - x0) / NULLIF(x1 - x0, 0), 0) * 20), 19) AS INTEGER) AS bin_y, COUNT(*) AS rows
        FROM complete c JOIN e ON e.priority = c.priority GROUP BY 1, 2, 3""",
    "corr_matrix_wide": f"""WITH {complete()}, l AS (SELECT priority, rn, y, x, {_lags({'y': 11, 'x': 11})} FROM placed),
        long AS (UNPIVOT l ON COLUMNS(* EXCLUDE (priority, rn)) INTO NAME a VALUE v)
        SELECT s.priority, s.a, t.a AS b, {rd('CORR(s.v, t.v)', 6)} AS corr
        FROM long s JOIN long t ON t.priority = s.priority AND t.rn = s.rn GROUP BY 1, 2, 3""",
    "hexagon_bins": f"""WITH {complete('daily')}, e AS (SELECT priority, MIN(y) AS y0, MAX(y) AS y1, MIN(x) AS x0,
        MAX(x) AS x1 FROM complete GROUP BY 1),
        s AS (SELECT e.*, COALESCE((y - y0) / NULLIF(y1 - y0, 0), 0) * 20 AS u, COALESCE((x - x0) / NULLIF(x1 - x0, 0), 0) * 11 AS v
          FROM complete c JOIN e ON e.priority = c.priority),
        h AS (SELECT *, FLOOR(u + 0.5) AS a, FLOOR(v + 0.5) AS b, LEAST(FLOOR(u), 19) + 0.5 AS c,
          LEAST(FLOOR(v), 10) + 0.5 AS d FROM s),
        n AS (SELECT *, (u - a) * (u - a) + 3 * (v - b) * (v - b) < (u - c) * (u - c) + 3 * (v - d) * (v - d) AS straight FROM h),
        p AS (SELECT *, CAST(2 * CASE WHEN straight THEN a ELSE c END AS INTEGER) AS hex_x,
          CAST(2 * CASE WHEN straight THEN b ELSE d END AS INTEGER) AS hex_y FROM n)
        SELECT priority, hex_x, hex_y, {rd('ANY_VALUE(y0 + (y1 - y0) * hex_x / 40.0)', 4)} AS mid_x,
        {rd('ANY_VALUE(x0 + (x1 - x0) * hex_y / 22.0)', 4)} AS mid_y, COUNT(*) AS rows FROM p GROUP BY 1, 2, 3""",
    "decompose_weekly": _decompose("weekly", 52),
    "rolling_six": f"""WITH {complete()} SELECT priority, date, y,
        {rd(f'CASE WHEN rn >= 6 THEN AVG(y) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END')} AS rolling_mean,
        {rd(f'CASE WHEN rn >= 6 THEN STDDEV_SAMP(y) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END')} AS rolling_std
        FROM placed""",
    "autocorrelation": f"""WITH {_acf()} SELECT priority, lag, {rd('acf', 6)} AS acf, {rd('1.96 / SQRT(n)', 6)} AS bound
        FROM acf""",
    "partial_autocorrelation": _pacf(),
    "decompose_monthly": _decompose("monthly", 12),
    "decompose_daily": _decompose("daily", 7),
    "most_frequent_value": f"""WITH {complete('daily')}, c AS (SELECT priority, x, COUNT(*) AS t FROM complete GROUP BY 1, 2)
        SELECT priority, x AS mode FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY priority ORDER BY t DESC, x) = 1""",
    "unit_root_simple": _unit_root(),
    "ar_order_one_score": f"""WITH {complete()}, p AS (SELECT priority, y, LAG(y) OVER ({W}) AS y1 FROM placed),
        s AS (SELECT priority, REGR_COUNT(y, y1) AS m, REGR_SYY(y, y1) - REGR_SXY(y, y1) * REGR_SXY(y, y1)
        / REGR_SXX(y, y1) AS sse FROM p GROUP BY 1)
        SELECT priority, CAST(1 AS INTEGER) AS lags, {rd('m * (LN(2 * PI() * sse / m) + 1) + 3 * LN(m)')} AS score,
        CAST(m AS BIGINT) AS nobs FROM s""",
    "backtest_origins": f"""WITH {complete()} SELECT priority, date, CAST(rn - (n - {H}) - 1 AS INTEGER) AS step,
        CAST(rn - 1 AS INTEGER) AS train_rows, y FROM placed WHERE rn > n - {H}""",
    "undo_differences": _undo(),
    "contiguous_folds": f"WITH {complete()} SELECT priority, date, {_fold()} AS fold FROM placed",
    "expanding_cutoffs": f"""WITH {complete('daily')}, e AS (SELECT priority, MIN(date) AS a, MAX(date) AS b FROM complete
        GROUP BY 1), k AS (SELECT priority, a, b, unnest(range(0, 1000)) AS i FROM e)
        SELECT priority, b - CAST(120 + 60 * i AS INTEGER) AS cutoff FROM k
        WHERE b - CAST(120 + 60 * i AS INTEGER) >= a + 1500""",
    "baselines": f"""WITH {complete()}, {baselines()} SELECT priority, step, date, model, {rd('pred')} AS pred FROM preds""",
    "baselines_key_window": f"""WITH {complete()}, k AS (SELECT *, LENGTH(priority) % 3 + 2 AS k FROM placed),
        j AS (SELECT o.priority, o.date, o.n, o.rn, o.k, h.y, h.rn - (o.rn - o.k) + 1 AS i FROM k o
          JOIN k h ON h.priority = o.priority AND h.rn < o.rn AND h.rn >= o.rn - o.k WHERE o.rn > o.n - {H}),
        a AS (SELECT priority, date, CAST(rn - (n - {H}) - 1 AS INTEGER) AS step, AVG(y) AS mean_latest,
          MEDIAN(y) AS median_latest, SUM(i * y) / SUM(i) AS weight_last FROM j GROUP BY 1, 2, 3)
        SELECT priority, step, date, 'mean_latest' AS model, {rd('mean_latest')} AS pred FROM a UNION ALL
        SELECT priority, step, date, 'median_latest', {rd('median_latest')} FROM a UNION ALL
        SELECT priority, step, date, 'weight_last', {rd('weight_last')} FROM a""",
    "linear_one_regressor": _one_regressor(),
    "linear_two_regressors": _two_regressors(),
    "knn_forecast": _knn(),
    "holt": _holt(),
    "family_averages": f"""WITH {ALL_PREDS} SELECT priority, step,
        CASE family WHEN 'ts' THEN 'ts_avg' ELSE 'bsln_avg' END AS model, {rd('AVG(pred)')} AS pred, ANY_VALUE(y) AS y
        FROM labelled GROUP BY priority, step, family""",
    "stacked_one_model": f"""WITH {complete()}, {baselines()}, s AS (SELECT *,
          REGR_SLOPE(y, pred) OVER e AS b, REGR_INTERCEPT(y, pred) OVER e AS c FROM preds
          WHERE model IN ('mean_all', 'weight_last')
          WINDOW e AS (PARTITION BY priority, model ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT priority, step, CASE model WHEN 'mean_all' THEN 'ts_wavg' ELSE 'bsln_wavg' END AS model,
          {rd('CASE WHEN step < 4 THEN pred ELSE c + b * pred END', 1)} AS pred FROM s""",
    "selector": f"""WITH {ALL_PREDS}, {SELECTION} SELECT priority, step, date, y, model, {rd('pred')} AS pred,
        {rd('window_mae')} AS window_mae FROM selection""",
    "selector_with_exclusions": f"""WITH {complete()}, {baselines()}, {LABELLED.replace('labelled AS', 'all_labelled AS')},
        labelled AS (SELECT * FROM all_labelled WHERE model <> 'last'), {SELECTION}
        SELECT priority, step, model, {rd('pred')} AS pred FROM selection""",
    "selector_counts": f"WITH {ALL_PREDS}, {SELECTION} SELECT model, COUNT(*) AS times FROM selection GROUP BY 1",
    "selector_share": f"""WITH {ALL_PREDS}, {SELECTION} SELECT priority,
        {rd("AVG(CASE WHEN model IN ('mean_all', 'median_latest', 'median') THEN 0.0 ELSE 1.0 END) * 100")}
        AS non_baseline_pct FROM selection GROUP BY 1""",
    "best_model_per_key": f"""WITH {ALL_PREDS}, m AS (SELECT priority, model, ord, AVG(ABS(pred - y)) AS mae FROM labelled
        GROUP BY 1, 2, 3) SELECT priority, model, {rd('mae')} AS mae FROM m
        QUALIFY ROW_NUMBER() OVER (PARTITION BY priority ORDER BY mae, ord) = 1""",
    "mean_error_of_models": f"""WITH {ALL_PREDS}, m AS (SELECT priority, model, AVG(ABS(pred - y)) AS mae FROM labelled
        GROUP BY 1, 2) SELECT priority, {rd('AVG(mae)')} AS mean_mae FROM m GROUP BY 1""",
    "closest_to_zero": f"""WITH {complete()}, d AS (SELECT priority, date, y - LAG(y) OVER ({W}) AS f,
        y - 2 * LAG(y) OVER ({W}) + LAG(y, 2) OVER ({W}) AS s FROM complete)
        SELECT priority, date, CASE WHEN s IS NOT NULL AND ABS(s) < ABS(f) THEN s ELSE f END AS closest FROM d""",
    "row_minimum": f"""WITH {complete()}, l AS (SELECT *, {_lags({'y': 2})} FROM complete)
        SELECT priority, date, LEAST(y, lag_y_1, lag_y_2) AS row_min FROM l""",
    "metric_table": f"""WITH {ALL_PREDS} SELECT priority, family, model, {metric_list()} FROM labelled
        WHERE step >= {WINDOW} GROUP BY 1, 2, 3""",
    "metric_rows": f"""WITH {ALL_PREDS}, m AS (SELECT priority, model, {metric_list()} FROM labelled
        WHERE step >= {WINDOW} GROUP BY 1, 2)
        UNPIVOT m ON "Rms", "Mae", "Mdn", "Mp", "Hbb", "Q25", "Q75", "Me" INTO NAME metric VALUE value""",
    "metric_matrix": f"""WITH {ALL_PREDS}, m AS (SELECT priority, model, {metric_list()} FROM labelled
        WHERE step >= {WINDOW} GROUP BY 1, 2),
        u AS (UNPIVOT m ON "Rms", "Mae", "Mdn", "Mp", "Hbb", "Q25", "Q75", "Me" INTO NAME "Metric" VALUE value)
        SELECT priority, "Metric", """ + ", ".join(
        f"MAX(value) FILTER (model = '{m}') AS {m}" for m in BASE_MODELS) + " FROM u GROUP BY 1, 2",
    "adjusted_r2": f"""WITH {ALL_PREDS}, s AS (SELECT priority, model, COUNT(*) AS n, SUM((y - pred) * (y - pred)) AS sse,
        VAR_POP(y) * COUNT(*) AS sst FROM labelled GROUP BY 1, 2)
        SELECT priority, model, {rd('1 - (sse / sst) * (n - 1) / (n - 2)', 6)} AS adj_r2 FROM s""",
    "summary": f"""WITH {ALL_PREDS}, m AS (SELECT priority, family, model, ord, AVG(ABS(y - pred)) AS "Mae",
        AVG(ABS((y - pred) / NULLIF(y, 0))) * 100 AS "Mp" FROM labelled WHERE step >= {WINDOW} GROUP BY 1, 2, 3, 4),
        u AS (UNPIVOT m ON "Mae", "Mp" INTO NAME metric VALUE value)
        SELECT priority, metric, family, model, {rd('value', 3)} AS value FROM u
        QUALIFY ROW_NUMBER() OVER (PARTITION BY priority, metric, family ORDER BY value, ord) = 1""",
    "revenue_model_comparison": f"""WITH {filled('monthly')},
        placed AS (SELECT *, ROW_NUMBER() OVER ({W}) AS rn, COUNT(*) OVER (PARTITION BY priority) AS n FROM filled),
        {baselines()},
        labelled AS (SELECT p.*, 'baseline' AS family, l.ord FROM preds p JOIN (VALUES ('last', 0), ('mean_latest', 1),
          ('mean_all', 2), ('weight_last', 3), ('median_latest', 4), ('median', 5)) l(model, ord) ON l.model = p.model),
        {SELECTION},
        every AS (SELECT priority, model, pred, y FROM labelled WHERE step >= {WINDOW}
          UNION ALL SELECT priority, 'mdl_slct_pred', pred, y FROM selection)
        SELECT priority, model, {metric_list()} FROM every GROUP BY 1, 2""",
    "linear_many_regressors": _many_regressors(),
    "penalised_three_lags": _penalised(),
    "ar_order_choice": _ar_order(),
    "unit_root_augmented": f"""WITH RECURSIVE {complete()}, {_unit_root_augmented('placed', 'priority', 17)}
        SELECT priority, {rd('stat', 5)} AS stat, CAST(used_lag AS INTEGER) AS used_lag, nobs,
        {rd(p_value('stat'), 5)} AS p_value FROM tests""",
    "difference_choice": _difference_choice(),
    "arima_fixed_order": _arma(),
    "arima_exogenous_fixed_order": _arma(3, 2, True, "arima_exo_eda"),
    "harmonic": _harmonic(),
    "additive_weekly": _additive(),
    "stacked_averages": _stacked(),
    "knn_grid_search": _knn_search(),
    "seasonal_smoothing": _seasonal(),
}


def _alone(sql: str) -> str:
    """The same statement for all orders as one series: a constant stands for the key and is left out at the end."""
    return f"SELECT * EXCLUDE (priority) FROM ({sql.replace('o_orderpriority AS priority', chr(39) + 'all' + chr(39) + ' AS priority')})"


ORACLES |= {
    "single_gap_spine": _alone(ORACLES["gap_spine_daily"]),
    "single_interpolate": _alone(ORACLES["interpolate_linear"]),
    "single_differences": _alone(ORACLES["differences"]),
    "single_lag_block": _alone(ORACLES["lag_block"]),
    "single_unit_root": _alone(ORACLES["unit_root_simple"]),
    "single_ar_order_score": _alone(ORACLES["ar_order_one_score"]),
    "single_baselines": _alone(ORACLES["baselines"]),
    "single_linear": _alone(ORACLES["linear_one_regressor"]),
    "single_knn": _alone(ORACLES["knn_forecast"]),
    "single_selector": _alone(ORACLES["selector"]),
    "single_metric_table": _alone(ORACLES["metric_table"]),
    "linear_large_offset": f"SELECT * FROM ({ORACLES['linear_one_regressor']}) WHERE model = 'linear'",
    "unbucketed_events": f"""SELECT event_type, CAST(ts AS DATE) AS date, {rd('AVG(value)', 8)} AS value FROM events
        GROUP BY event_type, CAST(ts AS DATE)""",
}

# Facts of fitted models that SQL cannot state: a forecast for each of the newest H rows that have one before them.
ORACLES |= {
    f"{name}_facts": f"""WITH {complete()} SELECT priority, '{model}' AS model, LEAST({H}, ANY_VALUE(n) - 1) AS forecasts,
        CAST(0 AS BIGINT) AS missing, TRUE AS inside FROM placed GROUP BY priority"""
    for name, model in (("random_forest", "rf"), ("boosted_trees", "xgb"), ("support_vector", "svr"),
                        ("harmonic_power", "tbats_ml"), ("arima_likelihood", "arima_ml"), ("arima_exogenous_likelihood", "arima_exo_ml"))
}
ORACLES["additive_large_offset"] = f"""WITH {complete()} SELECT priority, LEAST({H}, ANY_VALUE(n) - 1) AS forecasts, TRUE AS same FROM placed GROUP BY priority"""
# Refined weights start from the best point of the grid: their errors can only fall.
ORACLES |= {
    f"{name}_refined_facts": f"""WITH {complete('monthly')} SELECT priority, CAST(0 AS BIGINT) AS missing, TRUE AS never_worse,
        TRUE AS somewhere_better FROM placed GROUP BY priority"""
    for name in ("holt", "seasonal")
}
# With one regressor the sum of squared residuals is syy - sxy^2 / sxx; of unit geometric mean, powers compare by it alone.
ORACLES["power_of_trend"] = f"""WITH {complete('monthly')},
    early AS (SELECT priority, y, rn / n AS t FROM placed WHERE rn <= n - LEAST({H}, n - 1)),
    whole AS (SELECT priority, MIN(y) > 0 AS able, EXP(AVG(CASE WHEN y > 0 THEN LN(y) END)) AS g, COUNT(*) AS n FROM early GROUP BY priority),
    scaled AS (SELECT priority, able, t, CASE WHEN able THEN y / g ELSE y END AS u FROM early JOIN whole USING (priority) WHERE n > 4),
    tried AS (SELECT priority, power, t, CASE WHEN power = 1 THEN u - 1 WHEN power = 0 THEN LN(u) ELSE (POW(u, power) - 1) / power END AS z
      FROM scaled, (SELECT unnest(range(0, 21)) / 20.0::DOUBLE AS power) WHERE able OR power = 1),
    errors AS (SELECT priority, power, REGR_SYY(z, t) - REGR_SXY(z, t) * REGR_SXY(z, t) / REGR_SXX(z, t) AS e FROM tried GROUP BY priority, power)
    SELECT priority, ARG_MIN(power, e) AS power, 0 AS harmonics FROM errors GROUP BY priority"""
ORACLES["quantiles_of_long_keys"] = f"""SELECT l_returnflag, COUNT(l_extendedprice) AS n, {', '.join(
    rd(f"QUANTILE_CONT(CAST(l_extendedprice AS DOUBLE), {p})") + f' AS {c}'
    for p, c in ((0.01, 'p01'), (0.25, 'q25'), (0.5, 'median'), (0.75, 'q75'), (0.99, 'p99')))}
    FROM lineitem GROUP BY l_returnflag"""
# Easter Sundays 1994-2002, and the national holidays of Australia (days moved from a weekend to the next free weekday).
ORACLES["holiday_flag_aus"] = f"""WITH {complete('daily')},
    easter AS (SELECT CAST(unnest(['1994-04-03', '1995-04-16', '1996-04-07', '1997-03-30', '1998-04-12', '1999-04-04', '2000-04-23',
      '2001-04-15', '2002-03-31']) AS DATE) AS e),
    fixed AS (SELECT make_date(yr, m, dd) AS d, lieu, sunday FROM (SELECT CAST(unnest(range(1994, 2003)) AS INTEGER) AS yr),
      (VALUES (1, 1, TRUE, 1), (1, 26, TRUE, 1), (4, 25, FALSE, 0), (12, 25, TRUE, 2), (12, 26, TRUE, 2)) v(m, dd, lieu, sunday)),
    days AS (SELECT e - 2 AS d FROM easter UNION ALL SELECT e + 1 FROM easter UNION ALL SELECT d FROM fixed
      UNION ALL SELECT d + CASE isodow(d) WHEN 6 THEN 2 ELSE sunday END FROM fixed WHERE lieu AND isodow(d) >= 6),
    holidays AS (SELECT DISTINCT CAST(d AS DATE) AS date FROM days)
    SELECT c.priority, c.date, CAST(h.date IS NOT NULL AS INTEGER) AS holidays_fe FROM complete c LEFT JOIN holidays h ON h.date = c.date"""
_LAGGED = ("y", "lag_y_1", "lag_y_2", "lag_y_3", "lag_y_4")
ORACLES["lag_correlation_report"] = f"""WITH {complete()}, l AS (SELECT *, {_lags({'y': 4})} FROM complete), pairs AS (""" + " UNION ALL ".join(
    f"SELECT priority, '{a}' AS a, '{b}' AS b, {rd(f'CORR({a}, {b})', 6)} AS corr FROM l GROUP BY 1" for a in _LAGGED for b in _LAGGED
) + ") SELECT * FROM pairs WHERE corr IS NOT NULL AND NOT isnan(corr)"
