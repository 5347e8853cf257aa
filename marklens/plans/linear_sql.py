"""Ridge systems in SQL: sums of products per fit, then Gauss-Jordan steps as a recursion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def ridge_ctes(source: str, fits: Mapping[str, tuple[str, str]], features: Sequence[str], weighted: Mapping[str, bool] | None = None, scale: bool = True, tag: str = "") -> str:
    """CTEs up to ``gj`` and ``co`` (fit, alpha, i, b) ``lin`` (fit, alpha, b, mx, sx, my, mz): needs ``al`` (alpha).

    ``fits`` maps a name to target and row condition.  Weighted fits take the inverse root of their truth band's size.
    """
    p, g = len(features), tag
    parts = []
    for name, (target, cond) in fits.items():
        w = "1.0::DOUBLE"
        if weighted and weighted.get(name):
            band = f"CASE WHEN {target} <= 2.5 THEN 0 WHEN {target} <= 3.5 THEN 1 ELSE 2 END"
            w = f"1/sqrt(count(*) OVER (PARTITION BY {band}))"
        parts.append(f"SELECT '{name}' AS fit, [{', '.join(f'{f}::DOUBLE' for f in features)}] AS x, {target}::DOUBLE AS y, {w} AS w0 FROM {source} WHERE {cond}")
    mean = ", ".join(f"avg(x[{i + 1}])" for i in range(p))
    sd = ", ".join(f"stddev_pop(x[{i + 1}])" if scale else "1.0" for i in range(p))
    zed = ", ".join(f"(x[{i + 1}]-mx[{i + 1}])/sx[{i + 1}]" for i in range(p))
    return f"""rx{g} AS MATERIALIZED ({' UNION ALL '.join(parts)}), s0{g} AS (SELECT fit, [{mean}] AS mx, [{sd}] AS sx, avg(w0) AS mw FROM rx{g} GROUP BY fit),
z0{g} AS (SELECT fit, [{zed}] AS z, y, w0/mw AS w FROM rx{g} JOIN s0{g} USING (fit)),
s1{g} AS (SELECT fit, sum(w*y)/sum(w) AS my, [{', '.join(f'sum(w*z[{i + 1}])/sum(w)' for i in range(p))}] AS mz FROM z0{g} GROUP BY fit),
zc{g} AS MATERIALIZED (SELECT fit, w, [{', '.join(f'z[{i + 1}]-mz[{i + 1}]' for i in range(p))}, y-my] AS z FROM z0{g} JOIN s1{g} USING (fit)),
en{g} AS (SELECT fit, i, j, sum(w*z[i]*z[j]) AS v FROM zc{g}, (SELECT unnest(generate_series(1, {p}))::INT AS i), (SELECT unnest(generate_series(1, {p + 1}))::INT AS j) GROUP BY ALL),
m0{g} AS (SELECT fit, alpha, i, list(CASE WHEN i = j THEN v+alpha ELSE v END ORDER BY j) AS r FROM en{g}, al GROUP BY fit, alpha, i),
gj{g} AS (SELECT fit, alpha, 0 AS k, i, r FROM m0{g} UNION ALL
  SELECT a.fit, a.alpha, a.k+1, a.i, CASE WHEN a.i = a.k+1 THEN list_transform(a.r, lambda v: v/a.r[a.k+1]) ELSE list_transform(list_zip(a.r, q.r), lambda v: v[1]-a.r[a.k+1]/q.r[a.k+1]*v[2]) END
  FROM gj{g} a JOIN gj{g} q ON q.fit = a.fit AND q.alpha = a.alpha AND q.k = a.k AND q.i = a.k+1 WHERE a.k < {p}),
co{g} AS (SELECT fit, alpha, list(r[{p + 1}] ORDER BY i) AS b FROM gj{g} WHERE k = {p} GROUP BY fit, alpha),
lin{g} AS (SELECT fit, alpha, b, mx, sx, my, mz FROM co{g} JOIN s0{g} USING (fit) JOIN s1{g} USING (fit))"""


def line_sql(features: Sequence[str]) -> str:
    """The value of the joined line of ``lin`` at the columns of a row."""
    return "(my + " + " + ".join(f"b[{i + 1}]*(({f}::DOUBLE-mx[{i + 1}])/sx[{i + 1}]-mz[{i + 1}])" for i, f in enumerate(features)) + ")"
