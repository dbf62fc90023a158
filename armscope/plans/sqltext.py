"""Pieces of ANSI SQL for the SQL twins of the catalogue queries."""

from __future__ import annotations

import math

from armscope.functions.tails import TAIL_DENOMINATOR, TAIL_NUMERATOR, TAIL_SWITCH


def r(expr: str, digits: int = 6) -> str:
    """Rounded double; adding 0 turns a negative zero into zero."""
    return f"(round(cast({expr} as double), {digits}) + 0.0)"


def rs(*pairs: str) -> str:
    """``"alias=expr"`` pairs as rounded select items; a bare name rounds the column of that name."""
    items = []
    for pair in pairs:
        alias, _, expr = pair.partition("=")
        items.append(f"{r(expr or alias)} AS {alias.strip()}")
    return ", ".join(items)


def hashed(text: str) -> str:
    return f"cast('0x' || substr(md5({text}), 1, 8) as bigint)"


def arm(unit: str, salt: str = "'exp1'") -> str:
    return f"CASE WHEN {hashed(f'{salt} || chr(58) || {unit}')} % 2 = 0 THEN 'control' ELSE 'treatment' END"


def _horner(x: str, coefficients: list[float]) -> str:
    out = repr(coefficients[0]) + "::double"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::double)"
    return out


def tail(x: str) -> str:
    """P(Z > x), x >= 0; ``x`` should be a plain column."""
    near = f"exp(-{x}*{x}/2) * {_horner(x, TAIL_NUMERATOR)} / {_horner(x, TAIL_DENOMINATOR)}"
    far = f"exp(-{x}*{x}/2) / ({x} * {math.sqrt(2 * math.pi)!r}) * (1 - 1/({x}*{x}))"
    return f"(CASE WHEN {x} < {TAIL_SWITCH} THEN {near} WHEN {x} >= {TAIL_SWITCH} THEN {far} END)"


def p_two(z: str) -> str:
    return f"(2 * {tail(f'abs({z})')})"


def cdf(z: str) -> str:
    return f"(CASE WHEN {z} < 0 THEN {tail(f'abs({z})')} ELSE 1 - {tail(f'abs({z})')} END)"


def div(a: str, b: str) -> str:
    return f"(cast({a} as double) / nullif(cast({b} as double), 0))"


ORDERS_LOG = f"""
log AS (
  SELECT 'orders' AS experiment, o_orderkey AS seq, o_custkey AS user_id, o_orderdate AS ts, arm,
         CASE WHEN (arm = 'treatment') <> (o_orderkey % 73 = 0) THEN 'new_page' ELSE 'old_page' END AS page,
         cast(o_orderstatus = 'F' as int) AS converted, o_totalprice AS amount
  FROM (SELECT *, {arm('o_custkey')} AS arm FROM orders)
)"""
COUNTRIES = """
dim AS (
  SELECT c_custkey AS user_id, r_name AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
WRONG = "((arm = 'control' AND page = 'new_page') OR (arm = 'treatment' AND page = 'old_page'))"
ORDERS_UNITS = f"""{ORDERS_LOG}, {COUNTRIES},
firsts AS (
  SELECT * FROM log WHERE NOT {WRONG}
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) = 1
),
u AS (SELECT firsts.*, dim.country FROM firsts JOIN dim USING (user_id))"""
FLEET_UNITS = f"""{COUNTRIES},
log AS (
  SELECT experiment, o_orderkey AS seq, o_custkey AS user_id, o_orderdate AS ts, arm,
         CASE WHEN (arm = 'treatment') <> (o_orderkey % 73 = 0) THEN 'new_page' ELSE 'old_page' END AS page,
         cast(o_orderstatus = 'F' as int) AS converted, o_totalprice AS amount
  FROM (SELECT *, o_orderpriority AS experiment, {arm('o_custkey', 'o_orderpriority')} AS arm FROM orders)
),
firsts AS (
  SELECT * FROM log WHERE NOT {WRONG}
  QUALIFY row_number() OVER (PARTITION BY experiment, user_id ORDER BY ts, seq) = 1
),
u AS (SELECT firsts.*, dim.country FROM firsts JOIN dim USING (user_id))"""
EVENTS_LOG = f"""
log AS (
  SELECT *, CASE WHEN (arm = 'treatment') <> (k = 0) THEN 'new_page' ELSE 'old_page' END AS page
  FROM (
    SELECT 'events' AS experiment, event_id AS seq, user_id, ts, {arm('user_id')} AS arm,
           cast(event_type = 'purchase' as int) AS converted, event_type, value,
           cast(json_extract(props, '$.k') as int) AS k,
           extract(minute FROM ts) * 60 + extract(microseconds FROM ts) / 1e6 AS time_seconds
    FROM events
  )
)"""
EVENTS_ROWS = f"""{EVENTS_LOG}, {COUNTRIES},
e AS (SELECT log.*, dim.country FROM log JOIN dim USING (user_id) WHERE NOT {WRONG})"""
PREPOST = f"""{COUNTRIES},
units AS (
  SELECT user_id, coalesce(sum(value) FILTER (ts < '2024-01-16'), 0) AS pre,
         coalesce(sum(value) FILTER (ts >= '2024-01-16'), 0) AS post,
         count(*) FILTER (ts >= '2024-01-16') AS n_events,
         count(*) FILTER (ts >= '2024-01-16' AND event_type = 'purchase') AS purchases,
         count(*) FILTER (ts >= '2024-01-16' AND event_type = 'error') AS errors
  FROM events GROUP BY user_id
),
pp AS (SELECT 'events' AS experiment, units.*, dim.country, {arm('user_id')} AS arm FROM units JOIN dim USING (user_id))"""


def paired(source: str, metric: str, by: str = "", where: str = "true") -> str:
    """Select of control and treatment n, total, mean and sample variance per ``by`` cell."""
    by = f", {by}" if by else ""
    parts = []
    for suffix, name in (("c", "control"), ("t", "treatment")):
        cond = f"FILTER (arm = '{name}' AND {where})"
        parts.append(
            f"count({metric}) {cond} AS n_{suffix}, coalesce(sum({metric}) {cond}, NULL) AS total_{suffix}, "
            f"avg({metric}) {cond} AS mean_{suffix}, var_samp({metric}) {cond} AS var_{suffix}"
        )
    return f"SELECT experiment{by}, 'treatment' AS treatment, {', '.join(parts)} FROM {source} GROUP BY experiment{by}"


def z_test(cells: str) -> str:
    """CTE chain computing the pooled z test on ``paired`` rows; ends in ``zt``."""
    return f"""
z0 AS (
  SELECT *, {div('total_c', 'n_c')} AS p_c, {div('total_t', 'n_t')} AS p_t,
         {div('total_c + total_t', 'n_c + n_t')} AS p_pool
  FROM {cells}
),
z1 AS (
  SELECT *, p_c - p_t AS diff, sqrt(p_pool * (1 - p_pool) * ({div('1', 'n_c')} + {div('1', 'n_t')})) AS se_pooled,
         sqrt({div('p_c * (1 - p_c)', 'n_c')} + {div('p_t * (1 - p_t)', 'n_t')}) AS se_diff
  FROM z0
),
z2 AS (
  SELECT *, {div('diff', 'se_pooled')} AS z, diff - 1.96 * se_diff AS ci_low, diff + 1.96 * se_diff AS ci_high
  FROM z1
),
z3 AS (SELECT *, {p_two('z')} AS p_value FROM z2),
zt AS (
  SELECT *, CASE WHEN p_value < 0.05 THEN 'significant' WHEN p_value >= 0.05 THEN 'not_significant' END AS verdict,
         CASE WHEN p_c > p_t THEN 'control_higher' WHEN p_c <= p_t THEN 'treatment_higher' END AS direction,
         p_value >= 0.05 AND ci_high * 100 < 0.1 AS negligible,
         p_value >= 0.05 AND -ci_low * 100 < 0.1 AS gain_negligible
  FROM z3
)"""


def mid_ranked(source: str, value: str, by: str = "", first: str = "arm = 'control'") -> str:
    """CTE chain for the rank-sum test of ``first`` rows against the others; ends in ``mw``."""
    by_item = f", {by}" if by else ""
    return f"""
v0 AS (
  SELECT experiment{by_item}, {value} AS value, count(*) FILTER ({first}) AS c1,
         count(*) FILTER (NOT ({first})) AS c2, count(*) AS c
  FROM {source} WHERE {value} IS NOT NULL GROUP BY experiment{by_item}, {value}
),
v1 AS (
  SELECT *, coalesce(sum(c) OVER (PARTITION BY experiment{by_item} ORDER BY value
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM v0
),
v2 AS (
  SELECT experiment{by_item}, cast(sum(c1) as bigint) AS n1, cast(sum(c2) as bigint) AS n2,
         sum(c1 * (before + (c + 1) / 2.0)) AS rank_sum,
         sum(cast(c as double) * c * c - c) AS ties
  FROM v1 GROUP BY experiment{by_item}
),
v3 AS (
  SELECT *, cast(rank_sum as double) - n1 * (n1 + 1) / 2.0 AS u,
         sqrt(cast(n1 as double) * n2 / 12 * ((n1 + n2 + 1) - {div('ties', 'cast(n1 + n2 as double) * (n1 + n2 - 1)')})) AS sigma
  FROM v2
),
v4 AS (SELECT *, {div('greatest(abs(u - cast(n1 as double) * n2 / 2) - 0.5, 0)', 'sigma')} AS z FROM v3),
mw AS (SELECT *, CASE WHEN z IS NOT NULL THEN least({p_two('z')}, 1.0) END AS p_value FROM v4)"""


def student_p(t: str, df: str, steps: int = 4000) -> str:
    """Two-sided Student-t p by Simpson's rule on the angle; needs DuckDB's list functions and lgamma.

    With x = sqrt(df) tan(a) the density becomes a power of cos(a), smooth on [0, atan(t/sqrt(df))].
    """
    top = f"atan(abs({t}) / sqrt({df}))"
    node = f"power(cos({top} * i / {steps}), {df} - 1)"
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = f"(SELECT sum({weight} * {node}) FROM range(0, {steps + 1}) AS nodes(i)) * {top} / {3 * steps}"
    scale = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi())"
    return f"(1 - 2 * {scale} * {area})"


def glm(source: str, y: str, xs: list[str], family: str = "binomial", offset: str = "0", rounds: int = 8) -> str:
    """CTE chain fitting a logit or Poisson regression by Newton steps, unrolled.

    Each step sums the gradient and the information matrix over all rows and eliminates the one-row
    system; ends in ``glm(term, coef, se)``.
    """
    names = ["intercept", *xs]
    k = len(names)
    x = ["1.0::double", *[f"{c}::double" for c in xs]]
    start = "0.0::double" if family == "binomial" else f"(SELECT ln(sum({y}) / sum(exp({offset}))) FROM {source})"
    out = [
        "glm_0 AS MATERIALIZED (SELECT "
        + ", ".join(f"{start if i == 0 else '0.0::double'} AS b{i}" for i in range(k))
        + ")"
    ]

    def sums(step: int) -> str:
        eta = " + ".join([f"({offset})", *[f"b{i} * x{i}" for i in range(k)]])
        mean, weight = ("1 / (1 + exp(-eta))", "mu * (1 - mu)") if family == "binomial" else ("exp(eta)", "mu")
        cells = [f"sum(w * x{i} * x{j}) AS a{i}_{j}" for i in range(k) for j in range(i, k)]
        grads = [f"sum((y - mu) * x{i}) AS a{i}_{k}" for i in range(k)]
        betas = [f"any_value(b{i}) AS b{i}" for i in range(k)]
        return (
            f"SELECT {', '.join(cells + grads + betas)} FROM (SELECT *, {weight} AS w FROM (SELECT *, {mean} AS mu FROM "
            f"(SELECT *, {eta} AS eta FROM (SELECT {y}::double AS y, {offset} AS off, "
            + ", ".join(f"{x[i]} AS x{i}" for i in range(k))
            + f" FROM {source}), glm_{step})))"
        ).replace(f"({offset}) +", "off +")

    def eliminate(tag: str, first: str, width: int) -> str:
        # Sums hold the upper triangle only; the first step mirrors it.
        previous, steps = first, []
        for pivot in range(k):
            cols = []
            for i in range(k):
                for j in range(width):
                    if i == pivot:
                        cols.append(f"a{pivot}_{j} / a{pivot}_{pivot} AS a{i}_{j}")
                    else:
                        cols.append(f"a{i}_{j} - a{i}_{pivot} / a{pivot}_{pivot} * a{pivot}_{j} AS a{i}_{j}")
            keep = ", ".join(f"b{i}" for i in range(k))
            steps.append(f"{tag}_{pivot} AS MATERIALIZED (SELECT {', '.join(cols)}, {keep} FROM {previous})")
            previous = f"{tag}_{pivot}"
        return ", ".join(steps)

    mirror = [f"a{min(i, j)}_{max(i, j)} AS a{i}_{j}" for i in range(k) for j in range(k)]
    keep = [f"b{i}" for i in range(k)]
    for step in range(rounds):
        grads = [f"a{i}_{k}" for i in range(k)]
        out.append(f"sum_{step} AS MATERIALIZED ({sums(step)})")
        out.append(f"sys_{step} AS MATERIALIZED (SELECT {', '.join(mirror + grads + keep)} FROM sum_{step})")
        out.append(eliminate(f"el_{step}", f"sys_{step}", k + 1))
        moved = ", ".join(f"b{i} + a{i}_{k} AS b{i}" for i in range(k))
        out.append(f"glm_{step + 1} AS MATERIALIZED (SELECT {moved} FROM el_{step}_{k - 1})")
    unit = [f"{float(i == j)}::double AS a{i}_{k + j}" for i in range(k) for j in range(k)]
    out.append(f"sum_{rounds} AS MATERIALIZED ({sums(rounds)})")
    out.append(f"sys_{rounds} AS MATERIALIZED (SELECT {', '.join(mirror + unit + keep)} FROM sum_{rounds})")
    out.append(eliminate("inv", f"sys_{rounds}", 2 * k))
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS term, b{i} AS coef, sqrt(a{i}_{k + i}) AS se FROM inv_{k - 1}" for i, n in enumerate(names)
    )
    return ", ".join(out) + f", glm AS ({rows})"


def cross_fit(source: str, d: int, ridge: float = 0.0, folds: int = 5) -> str:
    """CTE chain: ``source`` (fold, y, x: list of ``d`` numbers) with ``score``, the prediction by the normal equations
    of all other folds, eliminated row by row; ends in ``cf``. Needs WITH RECURSIVE."""
    return f"""
cf_a AS MATERIALIZED (SELECT fold, i, j, sum(x[i] * x[j]) AS v FROM {source}, range(1, {d + 1}) t(i), range(1, {d + 1}) u(j) GROUP BY ALL),
cf_b AS MATERIALIZED (SELECT fold, i, {d + 1} AS j, sum(x[i] * y) AS v FROM {source}, range(1, {d + 1}) t(i) GROUP BY ALL),
cf_left AS (SELECT k, i, j, sum(v) + CASE WHEN i = j AND i > 1 THEN {ridge} ELSE 0 END AS v
  FROM (SELECT * FROM cf_a UNION ALL SELECT * FROM cf_b), range(0, {folds}) f(k) WHERE fold <> k GROUP BY k, i, j),
cf_rows AS (SELECT k, i, list(v ORDER BY j) AS line FROM cf_left GROUP BY ALL),
cf_sys AS MATERIALIZED (SELECT k, list(line ORDER BY i) AS m FROM cf_rows GROUP BY k),
cf_step(k, p, m) AS (
  SELECT k, 1, m FROM cf_sys
  UNION ALL
  SELECT k, p + 1, list_transform(m, lambda line, i: list_transform(line, lambda v, j:
    CASE WHEN i = p THEN v / m[p][p] ELSE v - line[p] / m[p][p] * m[p][j] END))
  FROM cf_step WHERE p <= {d}
),
cf_fit AS MATERIALIZED (SELECT k, list_transform(m, lambda line: line[{d + 1}]) AS beta FROM cf_step WHERE p = {d + 1}),
cf AS MATERIALIZED (SELECT s.*, list_inner_product(beta, x) AS score FROM {source} s JOIN cf_fit ON k = fold)"""
