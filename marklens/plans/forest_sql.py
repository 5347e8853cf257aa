"""The forests of ``operators.forests`` as SQL: the same hashed weights and tries, level after level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from marklens.functions.draws import poisson_law, uniform_sql
from marklens.operators.forests import CUTS


def _weight(u: str) -> str:
    """Poisson(1) count at ``u``."""
    _, before = poisson_law(1)
    return "(" + "+".join(f"({u} >= {b!r}::DOUBLE)::INT" for b in before[1:].tolist() if b < 1.0) + ")"


def forest_ctes(
    source: str, fits: Mapping[str, tuple[str, str, str]], features: Sequence[str], tried: int, trees: int = 300, depth: int = 10, leaf: int = 2, seed: int = 42,
) -> str:
    """CTEs with ``lv`` (fit, tree, key, value), the leaf value of every predicted item in every tree, and ``gn`` (fit, tree, f, gain).

    ``fits`` maps a name to its target, the condition of the rows it learns from and that of the rows it predicts.
    ``source`` has item_no and the features.
    """
    parts = []
    for name, (target, learns, predicts) in fits.items():
        edges = ", ".join(f"list_sort(list_distinct(quantile_cont({f}, [{', '.join(repr(i / (CUTS + 1)) for i in range(1, CUTS + 1))}]))) AS e{j}" for j, f in enumerate(features))
        binned = ", ".join(f"len(list_filter(e{j}, lambda e: e < {f}))" for j, f in enumerate(features))
        parts.append(
            f"SELECT '{name}' AS fit, item_no AS key, coalesce({learns}, false) AS learns, coalesce({predicts}, false) AS predicts, {target}::DOUBLE AS y, [{binned}] AS b "
            f"FROM {source}, (SELECT {edges} FROM {source} WHERE {learns}) AS ed WHERE coalesce({learns}, false) OR coalesce({predicts}, false)"
        )
    ctes = [
        "it AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")",
        f"tu AS (SELECT fit, key, y, learns, tree, {uniform_sql('key', 'tree', seed)} FROM it, (SELECT unnest(generate_series(1, {trees}))::BIGINT AS tree) WHERE learns OR predicts)",
        f"l0 AS MATERIALIZED (SELECT fit, tree, key, 1::BIGINT AS node, CASE WHEN learns THEN {_weight('u')} ELSE 0 END AS w, y FROM tu)",
    ]
    tries = ", ".join(str(j) for j in range(len(features)))
    for k in range(depth + 1):
        ctes.append(f"t{k} AS MATERIALIZED (SELECT fit, tree, node, sum(w)::DOUBLE AS n, sum(w*y) AS s FROM l{k} WHERE w > 0 GROUP BY ALL)")
        if k == depth:
            ctes.append(f"v{k} AS (SELECT fit, tree, key, s/n AS value FROM l{k} JOIN t{k} USING (fit, tree, node))")
            break
        ctes += [
            f"f{k} AS (SELECT fit, tree, node, f FROM (SELECT fit, tree, node, f, row_number() OVER (PARTITION BY fit, tree, node ORDER BY u, f) AS place FROM "
            f"(SELECT fit, tree, node, f, {uniform_sql('(node*1009+f)', 'tree', seed + 1)} FROM t{k}, (SELECT unnest([{tries}])::BIGINT AS f))) WHERE place <= {tried})",
            f"h{k} AS (SELECT fit, tree, node, f, b[f+1] AS bin, sum(w)::DOUBLE AS n, sum(w*l.y) AS s FROM (SELECT * FROM l{k} WHERE w > 0) l JOIN it USING (fit, key) JOIN f{k} USING (fit, tree, node) GROUP BY ALL)",
            f"c{k} AS (SELECT fit, tree, node, f, bin, sum(n) OVER d AS nl, sum(s) OVER d AS sl, sum(n) OVER a AS n, sum(s) OVER a AS s FROM h{k} "
            "WINDOW d AS (PARTITION BY fit, tree, node, f ORDER BY bin), a AS (PARTITION BY fit, tree, node, f))",
            f"g{k} AS (SELECT *, sl*sl/nl + (s-sl)*(s-sl)/(n-nl) AS score, s*s/n AS base FROM c{k} WHERE nl >= {leaf} AND n-nl >= {leaf})",
            f"s{k} AS MATERIALIZED (SELECT fit, tree, node, f, bin, score-base AS gain FROM (SELECT *, row_number() OVER (PARTITION BY fit, tree, node ORDER BY score DESC, f, bin) AS place FROM g{k}) WHERE place = 1 AND score > base*(1+1e-12::DOUBLE))",
            f"v{k} AS (SELECT fit, tree, key, s/n AS value FROM l{k} JOIN t{k} USING (fit, tree, node) ANTI JOIN s{k} USING (fit, tree, node))",
            f"l{k + 1} AS MATERIALIZED (SELECT l.fit, l.tree, l.key, 2*l.node + (it.b[s.f+1] > s.bin)::BIGINT AS node, l.w, l.y FROM l{k} l JOIN s{k} s USING (fit, tree, node) JOIN it USING (fit, key))",
        ]
    whole = " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(depth + 1))
    ctes.append(f"lv AS (SELECT v.fit, v.tree, v.key, v.value FROM ({whole}) v JOIN it USING (fit, key) WHERE predicts)")
    gains = " UNION ALL ".join(f"SELECT fit, tree, f, gain FROM s{k}" for k in range(depth))
    ctes.append(f"gn AS ({gains})")
    return ",\n".join(ctes)


def predictions(spread: bool = False) -> str:
    """CTE ``pr`` (fit, key, p): the mean over the trees, and their population standard deviation."""
    return f"pr AS (SELECT fit, key, avg(value) AS p{', stddev_pop(value) AS sd' if spread else ''} FROM lv GROUP BY fit, key)"
