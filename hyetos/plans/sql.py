"""Pieces of the DuckDB SQL that the queries are held against."""

from __future__ import annotations

from collections.abc import Sequence

GRID = """grid AS (
  SELECT l_suppkey AS px, CAST(l_suppkey // 10 AS INTEGER) AS lat_i, CAST(l_suppkey % 10 AS INTEGER) AS lon_i,
         (l_suppkey // 10) * 0.5::DOUBLE - 10 AS lat, (l_suppkey % 10) * 0.5::DOUBLE + 95 AS lon, CAST(l_shipdate AS DATE) AS time,
         CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, CAST(least((day(l_shipdate) + 9) // 10, 3) AS INTEGER) AS dekad,
         sum(l_quantity) AS ref, sum(l_extendedprice) / 1511 AS test
  FROM lineitem GROUP BY ALL
)"""

STATION = """sdays AS (
  SELECT DISTINCT user_id AS station_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS time
  FROM events, (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events)
), swide AS (
  SELECT user_id AS station_id, CAST(ts AS DATE) AS time, sum(value) FILTER (WHERE event_type = 'view') AS v, sum(value) FILTER (WHERE event_type = 'click') AS c,
         sum(value) FILTER (WHERE event_type = 'purchase') AS p, sum(value) FILTER (WHERE event_type = 'signup') AS s FROM events GROUP BY ALL
), station AS (
  SELECT station_id, time, coalesce(v, 0) AS ref, coalesce(c, 0) AS test, coalesce(p, 0) AS purchase, coalesce(s, 0) AS signup FROM sdays LEFT JOIN swide USING (station_id, time)
), products AS (
  SELECT station_id, time, ref, 'click' AS product, test FROM station UNION ALL SELECT station_id, time, ref, 'purchase', purchase FROM station
  UNION ALL SELECT station_id, time, ref, 'signup', signup FROM station
)"""

META = """meta AS (
  SELECT s_suppkey AS station_id, s_name AS station, n_name AS province, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def metrics(pairs: str, keys: Sequence[str], threshold: float = 1.0, name: str = "m") -> str:
    """CTEs up to `name`: the metrics without the p-value, of the CTE `pairs`."""
    k = ", ".join(keys)
    q = ", ".join(f"quantile_cont({s}, {p}) AS p{round(100 * p)}_{s}" for p in PERCENTILES for s in ("ref", "test"))
    pq = ", ".join(f"CASE WHEN n >= 2 THEN p{round(100 * p)}_{s} END AS p{round(100 * p)}_{s}" for p in PERCENTILES for s in ("ref", "test"))
    spell = lambda s: f"""{name}_{s}0 AS (  -- rows with the number of their run
  SELECT {k}, {s} < {threshold} AS dry, row_number() OVER (PARTITION BY {k} ORDER BY time) - row_number() OVER (PARTITION BY {k}, {s} < {threshold} ORDER BY time) AS run FROM {name}_v
), {name}_{s} AS (
  SELECT {k}, max(n) AS dsl_{s} FROM (SELECT {k}, run, count(*) AS n FROM {name}_{s}0 WHERE dry GROUP BY {k}, run) GROUP BY {k}
)"""  # noqa: E731
    return f"""{name}_v AS (SELECT * FROM {pairs} WHERE ref IS NOT NULL AND test IS NOT NULL
), {name}_b AS (
  SELECT {k}, count(*) AS n, sum(ref) AS r, sum(test) AS t, avg((test - ref) * (test - ref)) AS mse, avg(abs(test - ref)) AS mae, stddev_samp(ref) AS sr, stddev_samp(test) AS st,
         var_pop(ref) AS vr, var_pop(test) AS vt, covar_pop(ref, test) AS cov, max(ref) > min(ref) AS dr, max(test) > min(test) AS dt,
         count(*) FILTER (WHERE ref >= {threshold} AND test >= {threshold}) AS h, count(*) FILTER (WHERE ref >= {threshold} AND test < {threshold}) AS mi,
         count(*) FILTER (WHERE ref < {threshold} AND test >= {threshold}) AS fa, avg(ref) FILTER (WHERE ref >= {threshold}) AS wr, avg(test) FILTER (WHERE test >= {threshold}) AS wt, {q}
  FROM {name}_v GROUP BY {k}
), {spell("ref")}, {spell("test")}, {name}_k AS (
  SELECT {k}, max(abs(gap)) AS gap FROM (
    SELECT {k}, sum(s) OVER (PARTITION BY {k} ORDER BY x RANGE UNBOUNDED PRECEDING) AS gap
    FROM (SELECT {k}, ref AS x, 1 AS s FROM {name}_v UNION ALL SELECT {k}, test, -1 FROM {name}_v)) GROUP BY {k}
), {name} AS (
  SELECT {k}, n, CASE WHEN n >= 2 AND r <> 0 THEN (t - r) / r END AS relative_bias, CASE WHEN n >= 2 AND dr AND dt THEN greatest(-1, least(1, cov / sqrt(vr * vt))) END AS pearson_correlation,
         CASE WHEN n >= 2 THEN sqrt(mse) END AS rmse, CASE WHEN n >= 2 THEN mae END AS mae, sr AS ref_stdev, st AS test_stdev, CASE WHEN dr THEN st / sr END AS stdev_ratio,
         CASE WHEN n >= 2 THEN coalesce(h / nullif(h + mi, 0), 0) END AS pod, CASE WHEN n >= 2 THEN coalesce(fa / nullif(h + fa, 0), 0) END AS far,
         CASE WHEN n >= 2 THEN coalesce(h / nullif(h + mi + fa, 0), 0) END AS csi, CASE WHEN n >= 2 THEN 100 * (h + mi) / n END AS fpd_ref, CASE WHEN n >= 2 THEN 100 * (h + fa) / n END AS fpd_test,
         CASE WHEN n >= 2 THEN wr END AS mdwp_ref, CASE WHEN n >= 2 THEN wt END AS mdwp_test, CASE WHEN n >= 2 AND dr THEN 1 - mse / vr END AS nse,
         CASE WHEN n >= 2 THEN coalesce(dsl_ref, 0)::DOUBLE END AS dsl_ref, CASE WHEN n >= 2 THEN coalesce(dsl_test, 0)::DOUBLE END AS dsl_test, CASE WHEN n >= 2 THEN gap / n END AS ks_stat, {pq}
  FROM {name}_b LEFT JOIN {name}_ref USING ({k}) LEFT JOIN {name}_test USING ({k}) JOIN {name}_k USING ({k})
)"""


def clip(x: str, a: float = 0, b: float = 1) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest({a}, least({b}, {x})) END)"


def close(p: int) -> str:
    return f"(1 - CASE WHEN p{p}_test IS NOT NULL THEN least(abs(p{p}_test - p{p}_ref) / (p{p}_ref + 0.1::DOUBLE), 1) END)"


def quality(source: str, name: str = "q") -> str:
    """CTEs up to `name`: the scores of `source`, which has ks_pvalue."""
    bias = "(CASE WHEN relative_bias IS NOT NULL THEN greatest(1 - abs(relative_bias), 0) END)"
    ratio = "(1 - CASE WHEN stdev_ratio IS NOT NULL THEN least(abs(1 - stdev_ratio), 1) END)"
    spell = "(1 - least(abs(coalesce(dsl_test, 0) - coalesce(dsl_ref, 0)) / (coalesce(dsl_ref, 0) + 1e-6), 1))"
    extreme, general = f"(0.3::DOUBLE * {close(90)} + 0.3::DOUBLE * {close(95)} + 0.4::DOUBLE * {close(99)})", f"(0.3::DOUBLE * {close(25)} + 0.4::DOUBLE * {close(50)} + 0.3::DOUBLE * {close(75)})"
    parts = f"[x FOR x IN [{bias}, {clip('nse')}, pod, 1 - far] IF x IS NOT NULL]"
    return f"""{name}_s AS (
  SELECT *, CAST(0.3::DOUBLE * {bias} + 0.3::DOUBLE * exp(-rmse / 5) + 0.4::DOUBLE * {clip('nse')} AS FLOAT) AS basic_statistical_quality,
         CAST(0.45::DOUBLE * {extreme} + 0.25::DOUBLE * {general} + 0.15::DOUBLE * {ratio} + 0.15::DOUBLE * {clip('ks_pvalue')} AS FLOAT) AS distribution_quality,
         CAST(0.4::DOUBLE * {clip('csi')} + 0.3::DOUBLE * (0.6::DOUBLE * pod + 0.4::DOUBLE * (1 - far)) + 0.3::DOUBLE * {spell} AS FLOAT) AS temporal_quality, {parts} AS parts
  FROM {source}
), {name}_c AS (
  SELECT *, CAST(0.4::DOUBLE * basic_statistical_quality + 0.3::DOUBLE * distribution_quality + 0.3::DOUBLE * temporal_quality AS FLOAT) AS continuous_quality, list_avg(parts) AS mean_part FROM {name}_s
), {name} AS (
  SELECT *, CAST(CASE WHEN continuous_quality IS NULL THEN -9999 WHEN continuous_quality >= 0.8::FLOAT THEN 4 WHEN continuous_quality >= 0.6::FLOAT THEN 3
         WHEN continuous_quality >= 0.4::FLOAT THEN 2 ELSE 1 END AS INTEGER) AS categorical_quality,
         CAST(0.6::DOUBLE * (1 - sqrt(list_avg([(x - mean_part) * (x - mean_part) FOR x IN parts]))) + 0.4::DOUBLE * {clip('ks_pvalue')} AS FLOAT) AS confidence_level
  FROM {name}_c
)"""


def taylor_sums(pairs: str, keys: Sequence[str], name: str = "s") -> str:
    return f"""{name} AS (SELECT {", ".join(keys)}, count(*) AS n, sum(ref) AS so, sum(test) AS sp, sum(ref * ref) AS soo, sum(test * test) AS spp, sum(ref * test) AS sop
  FROM {pairs} WHERE ref >= 0 AND test >= 0 GROUP BY {", ".join(keys)})"""


def taylor_stats(sums: str, keys: Sequence[str], name: str = "t", min_n: int = 2) -> str:
    vo, vp = "greatest(soo / n - so / n * (so / n), 0)", "greatest(spp / n - sp / n * (sp / n), 0)"
    so, sp = "(soo - so * so / n)", "(spp - sp * sp / n)"
    made = {
        "r": f"CASE WHEN {so} > 0 AND {sp} > 0 THEN greatest(-1, least(1, (sop - so * sp / n) / sqrt({so} * {sp}))) END", "sigma_o": f"sqrt({vo})", "sigma_p": f"sqrt({vp})",
        "rmse": "sqrt(greatest((soo + spp - 2 * sop) / n, 0))", "crmse": f"sqrt(greatest({vo} + {vp} - 2 * (sop / n - so / n * (sp / n)), 0))", "bias": "(sp - so) / n",
    }
    return f"{name} AS (SELECT {', '.join(keys)}, n, " + ", ".join(f"CASE WHEN n >= {min_n} THEN {x} END AS {k}" for k, x in made.items()) + f" FROM {sums})"


def medians(table: str, keys: Sequence[str], name: str, each: bool = False) -> str:
    """As `taylor.median_over`, or with `each` as `taylor.median_each`."""
    k = ", ".join(keys)
    m = lambda xs: ", ".join(f"quantile_cont({x}, 0.5) AS {x}" for x in xs)
    if each:
        return f"{name} AS (SELECT {k}, {m(('r', 'sigma_o', 'sigma_p', 'rmse', 'crmse', 'bias'))} FROM {table} GROUP BY {k})"
    return f"""{name}_0 AS (SELECT {k}, {m(('r', 'sigma_o', 'sigma_p', 'bias'))}, count(r) AS n_rows FROM {table} GROUP BY {k}
), {name}_1 AS (SELECT *, sqrt(greatest(sigma_o * sigma_o + sigma_p * sigma_p - 2 * sigma_o * sigma_p * r, 0)) AS crmse FROM {name}_0
), {name} AS (SELECT *, sqrt(crmse * crmse + bias * bias) AS rmse FROM {name}_1)"""


def scores(table: str, name: str, min_events: int = 10) -> str:
    """Scores of the CTE `table` (a, b, c, d, n)."""
    ch = "((a + c) * (a + b)::DOUBLE / n)"
    gate = lambda x: f"CASE WHEN a + c >= {min_events} THEN {x} END"
    made = {
        "pod": gate("a / nullif(a + c, 0)"), "far": gate("b / nullif(a + b, 0)"), "csi": gate("a / nullif(a + b + c, 0)"), "fbi": gate("(a + b) / nullif(a + c, 0)"),
        "ets": gate(f"(a - {ch}) / nullif(a + b + c - {ch}, 0)"), "hss": gate("2 * (a * d - b * c)::DOUBLE / nullif((a + c) * (c + d) + (a + b) * (b + d), 0)"),
        "hk": gate("a / nullif(a + c, 0) - b / nullif(b + d, 0)"), "freq_obs": "100 * (a + c) / n", "freq_prd": "100 * (a + b) / n",
    }
    return f"{name} AS (SELECT *, " + ", ".join(f"{x} AS {k}" for k, x in made.items()) + f", a + c AS n_events FROM {table})"


def contingency(pairs: str, keys: Sequence[str], thresholds: Sequence[float], name: str) -> str:
    k = ", ".join(keys)
    f = lambda a, b: f"count(*) FILTER (WHERE ref {a} threshold AND test {b} threshold)"
    return f"""{name} AS (SELECT {k}, threshold, {f('>=', '>=')} AS a, {f('<', '>=')} AS b, {f('>=', '<')} AS c, {f('<', '<')} AS d, count(*) AS n
  FROM {pairs}, (SELECT unnest({[float(x) for x in thresholds]}::DOUBLE[]) AS threshold) WHERE ref IS NOT NULL AND test IS NOT NULL GROUP BY {k}, threshold)"""
