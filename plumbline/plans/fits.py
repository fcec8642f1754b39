"""Logistic regression as SQL, for comparison: Newton's method from zero, in named tables of (row or column, value)."""

from __future__ import annotations


def logistic_sql(view: str, names: list[str], label: str = "wrong", balanced: bool = False, key: str = "chain_id", steps: int = 8, tag: str = "lr") -> str:
    """Named tables, the last of which (``tag``) holds means m0.., deviations s0.., coefficients b0.. and the offset b of the fit on ``view``.

    The sum of the log losses and half of the squared coefficients is least. Column p is the offset's, column p + 1 the
    gradient; the equations are solved by Gauss and Jordan, a named table a pivot.
    """
    p, t = len(names), tag
    each = lambda f: " UNION ALL ".join(f(i, n) for i, n in enumerate(names))
    weight = f"CASE WHEN {label} = 1 THEN tn / (2.0::DOUBLE * tw) ELSE tn / (2.0::DOUBLE * (tn - tw)) END" if balanced else "1.0::DOUBLE"
    out = [f"{t}_m AS MATERIALIZED (" + each(lambda i, n: f"SELECT {i} AS i, coalesce(avg({n}), 0.0) AS m, CASE WHEN coalesce(stddev_pop({n}), 0.0) < 1e-8 THEN 1.0 ELSE stddev_pop({n}) END AS s FROM {view}") + ")",
           f"{t}_y AS MATERIALIZED (SELECT {key} AS r, {label}::DOUBLE AS y, {weight} AS w FROM {view}, (SELECT count(*) AS tn, count(CASE WHEN {label} = 1 THEN 1 END) AS tw FROM {view}))",
           f"{t}_x AS MATERIALIZED (" + each(lambda i, n: f"SELECT {key} AS r, {i} AS i, (coalesce({n}, 0.0)::DOUBLE - m) / s AS x FROM {view}, {t}_m WHERE i = {i}") + f" UNION ALL SELECT {key}, {p}, 1.0::DOUBLE FROM {view})",
           f"{t}_b0 AS (SELECT CAST(range AS INTEGER) AS i, 0.0::DOUBLE AS b FROM range({p + 1}))"]
    for k in range(1, steps + 1):
        b = f"{t}_b{k - 1}"
        out += [f"{t}_q{k} AS MATERIALIZED (SELECT r, y, w, q FROM {t}_y JOIN (SELECT r, 1.0::DOUBLE / (1.0 + exp(-sum(x * b))) AS q FROM {t}_x JOIN {b} USING (i) GROUP BY r) USING (r))",
                f"""{t}_g{k}_0 AS MATERIALIZED (SELECT a.i, c.i AS j, sum(w * q * (1 - q) * a.x * c.x) + max(CASE WHEN a.i = c.i AND a.i < {p} THEN 1.0 ELSE 0.0 END) AS v FROM {t}_x a JOIN {t}_x c USING (r) JOIN {t}_q{k} USING (r) GROUP BY ALL
 UNION ALL SELECT i, {p + 1}, sum(w * (q - y) * x) + max(CASE WHEN i < {p} THEN b ELSE 0.0 END) FROM {t}_x JOIN {t}_q{k} USING (r) JOIN {b} USING (i) GROUP BY i)"""]
        for c in range(p + 1):
            out.append(f"""{t}_g{k}_{c + 1} AS MATERIALIZED (SELECT i, j, CASE WHEN i = {c} THEN v / vp ELSE v - vi * vj / vp END AS v FROM (SELECT *, max(CASE WHEN i = {c} AND j = {c} THEN v END) OVER () AS vp,
 max(CASE WHEN j = {c} THEN v END) OVER (PARTITION BY i) AS vi, max(CASE WHEN i = {c} THEN v END) OVER (PARTITION BY j) AS vj FROM {t}_g{k}_{c}))""")
        out.append(f"{t}_b{k} AS MATERIALIZED (SELECT i, b - v AS b FROM {b} JOIN {t}_g{k}_{p + 1} USING (i) WHERE j = {p + 1})")
    wide = lambda c, n: ", ".join(f"max(CASE WHEN i = {i} THEN {c} END) AS {c}{i}" for i in range(n))
    out.append(f"{t} AS MATERIALIZED (SELECT * FROM (SELECT {wide('m', p)}, {wide('s', p)} FROM {t}_m), (SELECT {wide('b', p)}, max(CASE WHEN i = {p} THEN b END) AS b FROM {t}_b{steps}))")
    return ", " + ",\n".join(out) + "\n"


def risk_sql(names: list[str]) -> str:
    """Probability of a row beside the fit's one row."""
    return "(1.0::DOUBLE / (1.0 + exp(-(b" + "".join(f" + (coalesce({n}, 0.0) - m{i}) / s{i} * b{i}" for i, n in enumerate(names)) + "))))"
