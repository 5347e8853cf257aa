"""Scored-item views over the star-schema tables, with the same arithmetic as SQL text.

All model-like scores are multiples of 1/64, so sums are exact in double in any row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklens.operators import signals
from marklens.operators.order import widen
from marklens.session import small_batches


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """All document columns, for work that is heavy per text."""
    small_batches(spark)
    return widen(table(spark, sf, "documents"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for work that is heavy per text."""
    small_batches(spark)
    return widen(table(spark, sf, "documents").select("doc_id", "text"))


_KEYS = {
    "k": "o_orderkey",
    "c": "o_custkey",
    "prompt_id": "o_orderpriority",
    "cluster": "n_name",
    "segment": "c_mktsegment",
    "status": "o_orderstatus",
}
_CODES = {"g": "(7*k + 3*c) % 9", "h": "(5*k + 11*c) % 9"}
_SCORED = {
    "item_id": "CAST(k AS {string})",
    "item_no": "k",
    "prompt_id": "prompt_id",
    "cluster": "cluster",
    "segment": "segment",
    "status": "status",
    "word_count": "CAST(50 + (37*k + 19*c) % 1200 AS {double})",
    "y_v": "1 + g/2",
    "y_g": "1 + h/2",
    "lin_v": "3 + (g-4)/4 + ((13*k + 29*c) % 65 - 32)/64",
    "for_v": "3 + (g-4)/4 + ((37*k + 11*c) % 65 - 32)/64",
    "lin_g": "3 + (h-4)/4 + ((17*k + 7*c) % 65 - 32)/64",
    "for_g": "3 + (h-4)/4 + ((23*k + 5*c) % 65 - 32)/64",
    "split": "CASE WHEN k % 10 < 4 THEN 'official_test' WHEN k % 10 = 4 THEN 'validation' ELSE 'model_train' END",
    "cv_fold": "CASE WHEN k % 10 > 4 THEN CAST(FLOOR(k/10) % 5 AS INT) END",
    "privacy_review_status": "CASE WHEN k % 47 = 0 THEN 'flagged' WHEN k % 331 = 1 THEN 'unresolved_raw_id_link' "
    "ELSE 'not_flagged' END",
    "r1_v": "CAST(1 + (3*k + c) % 5 AS INT)",
    "r2_v": "CAST(LEAST(5, GREATEST(1, 1 + (3*k + c) % 5 + k % 3 - 1)) AS INT)",
    "r1_g": "CAST(1 + (2*k + 3*c) % 5 AS INT)",
    "r2_g": "CAST(LEAST(5, GREATEST(1, 1 + (2*k + 3*c) % 5 + (k + c) % 3 - 1)) AS INT)",
}


def _list(exprs: dict[str, str], string: str = "STRING", double: str = "DOUBLE") -> list[str]:
    return [f"{e.format(string=string, double=double) if '{' in e else e} AS {n}" for n, e in exprs.items()]


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: ids, groups, truths, two models' predictions, split, fold, privacy status."""
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    base = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    base = base.selectExpr(*[f"{e} AS {n}" for n, e in _KEYS.items()])
    return base.selectExpr("*", *_list(_CODES)).selectExpr(*_list(_SCORED))


def _sql_list(exprs: dict[str, str]) -> str:
    return ", ".join(_list(exprs, "VARCHAR", "DOUBLE"))


CTES = {
    "scored": (
        f"SELECT {_sql_list(_SCORED)} FROM (SELECT *, {_sql_list(_CODES)} FROM (SELECT {_sql_list(_KEYS)} FROM orders "
        "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) AS a) AS b"
    ),
    "long": " UNION ALL ".join(
        f"SELECT item_id, prompt_id, cluster, segment, split, cv_fold, word_count, '{t}' AS target, '{m}' AS model, "
        f"y_{t.lower()} AS truth, {m[:3]}_{t.lower()} AS prediction FROM scored"
        for t in ("V", "G")
        for m in ("linear", "forest")
    ),
    "signals": (
        "SELECT *, abs(for_v-y_v) AS err_v, abs(for_g-y_g) AS err_g, greatest(abs(for_v-y_v), abs(for_g-y_g)) AS max_err, "
        "greatest(abs(for_v-y_v), abs(for_g-y_g)) >= 1.0 AS large, abs(for_v-lin_v) AS d_v, abs(for_g-lin_g) AS d_g, "
        "greatest(abs(for_v-lin_v), abs(for_g-lin_g)) AS d_max, (abs(for_v-lin_v) + abs(for_g-lin_g))/2 AS d_mean FROM scored"
    ),
    "ratings": (
        "SELECT item_id, prompt_id, split, word_count, y_v, for_v, 'V' AS target, r1_v AS r1, r2_v AS r2, for_v AS prediction, "
        "(r1_v + r2_v)/2 AS human FROM scored UNION ALL SELECT item_id, prompt_id, split, word_count, y_v, for_v, 'G', r1_g, r2_g, "
        "for_g, (r1_g + r2_g)/2 FROM scored"
    ),
}
_NEEDS = {"long": ["scored"], "signals": ["scored"], "ratings": ["scored"]}


def with_views(names: str, body: str) -> str:
    """``WITH ... body`` for the named views and everything they rest on."""
    order: list[str] = []

    def need(n: str) -> None:
        for d in _NEEDS.get(n, []):
            need(d)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    ctes = ",\n".join(f"{n} AS (\n{CTES[n]})" for n in order)
    body = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{ctes},\n{body[len(start):]}"
    return f"WITH {ctes}\n{body}"


def long_scores(spark: SparkSession, sf: str) -> DataFrame:
    keep = ["item_id", "prompt_id", "cluster", "segment", "split", "cv_fold", "word_count"]
    return signals.long_predictions(scored(spark, sf), keep)


def with_signals(spark: SparkSession, sf: str) -> DataFrame:
    return signals.add_signals(scored(spark, sf))


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select(
        "item_id", "prompt_id", "split", "word_count", "y_v", "for_v",
        F.expr("stack(2, 'V', r1_v, r2_v, for_v, 'G', r1_g, r2_g, for_g) AS (target, r1, r2, prediction)"),
    ).withColumn("human", (F.col("r1") + F.col("r2")) / 2)
