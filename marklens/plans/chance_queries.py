"""Section K: exact tests, random references and bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from marklens.functions import draws as D
from marklens.functions import scalars as S
from marklens.operators import bootstrap as B
from marklens.operators import chance as X
from marklens.operators import queues as Q
from marklens.operators.order import queue, with_row
from marklens.plans import sqltext as Z
from marklens.plans.metric_queries import _STRATS, _ranked_strategies
from marklens.plans.registry import query
from marklens.plans.sqltext import n_if, r, rounded
from marklens.plans.views import scored, with_signals, with_views
from marklens.session import materialise

c = F.col
DRAWS, REPS, SEED = 1000, 2000, 42


def _choose(a: str, b: str) -> str:
    return f"(lgamma(({a})+1.0)-lgamma(({b})+1.0)-lgamma(({a})-({b})+1.0))"


def _pmf_sql(n: str, pos: str, k: str, x: str) -> str:
    return f"exp({_choose(pos, x)}+{_choose(f'{n}-{pos}', f'{k}-{x}')}-{_choose(n, k)})"


def _captures_sql(counts: str) -> str:
    """CTE ``ds`` (key, draw, captured) from counts (key, n, positives, k): the inverse of each law at a hashed uniform."""
    return (
        f"hs AS (SELECT *, unnest(generate_series(greatest(0, k+positives-n)::BIGINT, least(k, positives)::BIGINT)) AS x FROM {counts}), hp AS (SELECT key, x, {_pmf_sql('n', 'positives', 'k', 'x')} AS p FROM hs), "
        "hc AS (SELECT key, x, coalesce(sum(p) OVER (PARTITION BY key ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)/sum(p) OVER (PARTITION BY key) AS before FROM hp), "
        f"du AS (SELECT c.*, draw, {D.uniform_sql('key', 'draw', SEED)} FROM {counts} c, (SELECT unnest(generate_series(1, {DRAWS}))::BIGINT AS draw)), "
        "ds AS (SELECT du.key, n, positives, k, draw::INT AS draw, x AS captured FROM du ASOF JOIN hc ON du.key = hc.key AND du.u >= hc.before)"
    )


def _drawn_sql(by: str, source: str) -> str:
    """CTE ``ds`` (by..., draw, n, positives, k, captured): in every draw the items of the smallest uniforms are the queue."""
    part = f"PARTITION BY {by}draw"
    return (
        f"du AS (SELECT s.*, draw, {D.uniform_sql('item_no', 'draw', SEED)} FROM (SELECT * FROM {source}) s, (SELECT unnest(generate_series(1, {DRAWS}))::BIGINT AS draw)), "
        f"dp AS (SELECT {by}draw, large, row_number() OVER ({part} ORDER BY u, item_no) <= ceil(count(*) OVER ({part})*0.2::DOUBLE) AS drawn FROM du), "
        f"ds AS (SELECT {by}draw::INT AS draw, count(*) AS n, {n_if('large')} AS positives, {n_if('drawn')} AS k, {n_if('large AND drawn')} AS captured FROM dp GROUP BY {by}draw)"
    )


_K1 = _drawn_sql("", "(SELECT item_no, large FROM signals)")
_ALL = f"qc AS (SELECT 0::BIGINT AS key, count(*) AS n, {n_if('large')} AS positives, ceil(count(*)*0.2::DOUBLE)::BIGINT AS k FROM signals)"
_K2 = f"{_ALL}, {_captures_sql('qc')}"


def _draws(spark, sf):
    s = with_signals(spark, sf).select("item_no", "large")
    return X.draw_metrics(X.drawn_captures(s, X.queue_counts(s, 0.2), DRAWS, SEED)).drop("key")


@query("k1_random_queues", with_views("signals", f"WITH {_K1} SELECT draw, k AS selected_count, captured, n, positives, {r('captured/positives', 'capture_rate')}, {r('captured/k', 'precision')}, {r('(captured::DOUBLE*n)/(k::DOUBLE*positives)', 'lift')} FROM ds"))
def _k1(spark, sf):
    return rounded(_draws(spark, sf))


@query("k2_draw_summary", with_views("signals", f"WITH {_K2} SELECT {r('avg(captured/positives)', 'mean')}, {r('quantile_cont(captured/positives, 0.025)', 'low')}, {r('quantile_cont(captured/positives, 0.975)', 'high')}, count(*) AS valid, 0::BIGINT AS skipped FROM ds"))
def _k2(spark, sf):
    draws = X.random_captures(X.queue_counts(with_signals(spark, sf).select("item_id", "large"), 0.2), DRAWS, SEED)
    return rounded(X.intervals(X.draw_metrics(draws), "capture_rate"))


_FOLDQ = """fq AS (SELECT cv_fold, large, row_number() OVER (PARTITION BY cv_fold ORDER BY d_max DESC, item_id) <= ceil(count(*) OVER (PARTITION BY cv_fold)*0.2::DOUBLE) AS sel FROM signals WHERE cv_fold IS NOT NULL),
fc AS (SELECT cv_fold, count(*) AS n, count(*) FILTER (WHERE large) AS positives, count(*) FILTER (WHERE sel) AS k, count(*) FILTER (WHERE large AND sel) AS caught FROM fq GROUP BY cv_fold)"""


def _fold_rows(spark, sf):
    s = with_signals(spark, sf).where(c("cv_fold").isNotNull()).select("item_id", "cv_fold", "d_max", "large")
    return queue(s, [F.desc("d_max"), "item_id"], 0.2, ["cv_fold"])


@query("k3_expected_capture", with_views("signals", f"""WITH {_FOLDQ}, u AS (SELECT CAST(cv_fold AS VARCHAR) AS scope, n, positives, k, caught, k*positives/n AS expected FROM fc
UNION ALL SELECT 'pooled', sum(n), sum(positives), sum(k), sum(caught), sum(k*positives/n) FROM fc)
SELECT scope, CAST(n AS BIGINT) AS n, CAST(positives AS BIGINT) AS positives, CAST(k AS BIGINT) AS k, CAST(caught AS BIGINT) AS caught, {r('expected', 'expected')}, {r('caught/positives', 'capture')}, {r('caught/k', 'precision')}, {r('caught/expected', 'lift')} FROM u"""))
def _k3(spark, sf):
    return rounded(X.expected_capture(X.fold_counts(_fold_rows(spark, sf), ["cv_fold"]), "cv_fold"))


@query("k4_hypergeometric_tail", with_views("signals", f"""WITH {_STRATS}, m AS (SELECT strategy, count(*) AS n, {n_if('large')} AS positives, {n_if('rank<=ceil(n_all*0.2::DOUBLE)')} AS k, {n_if('large AND rank<=ceil(n_all*0.2::DOUBLE)')} AS caught FROM rk GROUP BY strategy),
e AS (SELECT *, unnest(generate_series(caught, least(k, positives))) AS x FROM m)
SELECT strategy, n, positives, k, caught, round(sum({_pmf_sql('n', 'positives', 'k', 'x')}), 7) AS tail_p FROM e GROUP BY ALL"""))
def _k4(spark, sf):
    m = X.fold_counts(Q.select_budget(_ranked_strategies(spark, sf)), ["strategy"])
    return rounded(X.hypergeometric_tail(m, "n", "positives", "k", "caught"), 7)


def _conv(folds: int = 5) -> str:
    """CTEs ``c0`` to the last fold's: laws of forty standard deviations around their modes, from ratios of neighbours."""
    pm = (
        "fm AS (SELECT *, greatest(0, k+positives-n)::BIGINT AS least_x, least(k, positives)::BIGINT AS most_x, "
        f"floor({X._REACH}*sqrt(greatest(k*(positives/n)*(1-positives/n)*(n-k)/greatest(n-1, 1), 0))+{X._REACH})::BIGINT+1 AS far FROM fc), "
        "fw AS (SELECT *, least(greatest((k+1)*(positives+1)//(n+2), least_x), most_x) AS mode FROM fm), "
        "fx AS (SELECT *, unnest(generate_series(greatest(least_x, mode-far), least(most_x, mode+far))) AS x FROM fw), "
        "fl AS (SELECT cv_fold, x, coalesce(sum(CASE WHEN x > greatest(least_x, mode-far) THEN ln(positives-x+1)+ln(k-x+1)-ln(x)-ln(n-positives-k+x) END) OVER (PARTITION BY cv_fold ORDER BY x ROWS UNBOUNDED PRECEDING), 0) AS l FROM fx), "
        "fe AS (SELECT cv_fold, x, exp(l-max(l) OVER (PARTITION BY cv_fold)) AS e FROM fl), pm AS (SELECT cv_fold, x, e/sum(e) OVER (PARTITION BY cv_fold) AS p FROM fe)"
    )
    steps = ["c0 AS (SELECT x, p FROM pm WHERE cv_fold=0)"]
    for i in range(1, folds):
        steps.append(f"c{i} AS (SELECT a.x+b.x AS x, sum(a.p*b.p) AS p FROM c{i - 1} a JOIN pm b ON b.cv_fold={i} WHERE b.p > 0 AND a.p > 0 GROUP BY 1)")
    return pm + ", " + ", ".join(steps)


@query("k5_pooled_tail", with_views("signals", f"""WITH {_FOLDQ}, {_conv()}, o AS (SELECT CAST(sum(caught) AS BIGINT) AS caught, sum(k*positives/n) AS expected FROM fc)
SELECT 'disagreement' AS signal, caught, {r('expected', 'expected')}, round(least(1, coalesce(sum(p), 0)), 7) AS tail_p FROM o LEFT JOIN c4 ON x>=caught GROUP BY caught, expected"""))
def _k5(spark, sf):
    f = X.fold_counts(_fold_rows(spark, sf), ["cv_fold"]).withColumn("signal", F.lit("disagreement"))
    out = X.pooled_tail(f, ["signal"])
    return out.select("signal", "caught", F.round("expected", 9).alias("expected"), F.round("tail_p", 7).alias("tail_p"))


_K6 = f"""{_drawn_sql('cv_fold, ', '(SELECT cv_fold, item_no, large FROM signals WHERE cv_fold IS NOT NULL)')}, js AS (SELECT draw, sum(captured) AS captured FROM ds GROUP BY draw)"""


@query("k6_joint_draw_tail", with_views("signals", f"""WITH {_FOLDQ}, {_K6}, o AS (SELECT CAST(sum(caught) AS BIGINT) AS observed FROM fc)
SELECT observed, {n_if('captured>=observed')} AS at_least, count(*) AS draws, {r('avg((captured>=observed)::INT)', 'p')} FROM js, o GROUP BY observed"""))
def _k6(spark, sf):
    s = with_signals(spark, sf).where(c("cv_fold").isNotNull()).select("item_no", "cv_fold", "large")
    joint = X.drawn_captures(s, X.queue_counts(s, 0.2, ["cv_fold"]), DRAWS, SEED, ["cv_fold"]).groupBy("draw").agg(F.sum("captured").alias("captured"))
    seen = X.fold_counts(_fold_rows(spark, sf), ["cv_fold"]).agg(F.sum("caught").alias("observed"))
    return rounded(X.empirical_tail(joint, seen))


@query("k7_empirical_tail", with_views("signals", f"""WITH {_K1}, o AS (SELECT {n_if('large AND rank<=ceil(n_all*0.2::DOUBLE)')} AS observed FROM (SELECT large, row_number() OVER (ORDER BY d_max DESC, item_id) AS rank, count(*) OVER () AS n_all FROM signals))
SELECT observed, {n_if('captured>=observed')} AS at_least, count(*) AS draws, {r('avg((captured>=observed)::INT)', 'p')} FROM ds, o GROUP BY observed"""))
def _k7(spark, sf):
    s = with_signals(spark, sf).select("item_id", "d_max", "large")
    seen = queue(s, [F.desc("d_max"), "item_id"], 0.2).agg(F.count_if(c("large") & c("selected")).alias("observed"))
    return rounded(X.empirical_tail(_draws(spark, sf), seen))


# ---- bootstraps: Poisson weights of cells from the same hashed uniforms in both engines ------------


def _cells_sql(columns: dict[str, str], source: str) -> str:
    """CTEs of the weighted cells of ``source``: ``rw`` with the columns, rep and w; replicate 0 is the sample."""
    cols = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return D.weights_sql(f"SELECT {', '.join(columns)}, count(*) AS m, min(item_no)::BIGINT AS key FROM (SELECT item_no, {cols} FROM {source}) GROUP BY ALL", REPS, SEED)


def _est(v: str) -> str:
    of = lambda f, *more: f"{f}({', '.join([v, *more])}) FILTER (WHERE rep > 0)"
    return (
        f"{r(f'max({v}) FILTER (WHERE rep = 0)', 'estimate')}, {r(of('avg'), 'mean')}, {r(of('quantile_cont', '0.025'), 'low')}, {r(of('quantile_cont', '0.975'), 'high')}, "
        f"count({v}) FILTER (WHERE rep > 0) AS valid, count(*) FILTER (WHERE rep > 0)-count({v}) FILTER (WHERE rep > 0) AS skipped"
    )


def _auroc_sql(rows: str, by: str) -> str:
    """CTE ``au`` (by..., rep, auroc) from rows (by..., rep, score, large, w)."""
    return f"""av AS (SELECT {by}, rep, score, coalesce(sum(w) FILTER (WHERE large), 0) AS pos, coalesce(sum(w) FILTER (WHERE NOT large), 0) AS neg FROM {rows} GROUP BY ALL),
ac AS (SELECT *, sum(neg) OVER (PARTITION BY {by}, rep ORDER BY score) AS cn FROM av), au AS (SELECT {by}, rep, sum(pos*(cn-neg/2))/nullif(sum(pos)::DOUBLE*sum(neg), 0) AS auroc FROM ac GROUP BY ALL)"""


_AB = f"""{_cells_sql({'large': 'large', 'd': 'd_max', 'words': 'word_count'}, 'signals')},
sg AS (SELECT rep, w, large, 'disagreement' AS signal, d AS score FROM rw UNION ALL SELECT rep, w, large, 'negative_words', -words FROM rw), {_auroc_sql('sg', 'signal')}"""


def _auroc_draws(spark, sf):
    s = with_signals(spark, sf).select("item_no", "large", "d_max", "word_count")
    return B.auroc_bootstrap(s, {"disagreement": c("d_max"), "negative_words": -c("word_count")}, REPS, SEED)


@query("k8_auroc_bootstrap", with_views("signals", f"WITH {_AB} SELECT signal, {_est('auroc')} FROM au GROUP BY signal"))
def _k8(spark, sf):
    return rounded(B.estimates(_auroc_draws(spark, sf), "auroc", ["signal"]))


_DELTAS = ("delta_caught", "delta_capture", "new_excess", "old_excess", "auroc_old", "auroc_new", "delta_auroc")
_K9 = f"""qd AS (SELECT item_no, cv_fold, large, d_max, d_mean, row_number() OVER (PARTITION BY cv_fold ORDER BY d_max DESC, item_id) <= ceil(count(*) OVER (PARTITION BY cv_fold)*0.2::DOUBLE) AS old,
row_number() OVER (PARTITION BY cv_fold ORDER BY d_mean DESC, item_id) <= ceil(count(*) OVER (PARTITION BY cv_fold)*0.2::DOUBLE) AS new, ceil(count(*) OVER (PARTITION BY cv_fold)*0.2::DOUBLE)/count(*) OVER (PARTITION BY cv_fold) AS rate FROM signals WHERE cv_fold IS NOT NULL),
{_cells_sql({n: n for n in ('cv_fold', 'large', 'old', 'new', 'rate', 'd_max', 'd_mean')}, 'qd')},
sc AS (SELECT *, unnest(['fold' || cv_fold, 'pooled']) AS scope FROM rw),
bt AS (SELECT scope, rep, coalesce(sum(w) FILTER (WHERE large AND old), 0) AS co, coalesce(sum(w) FILTER (WHERE large AND new), 0) AS cn, coalesce(sum(w) FILTER (WHERE large), 0) AS pk, coalesce(sum(w*rate) FILTER (WHERE large), 0) AS ex FROM sc GROUP BY ALL),
sg AS (SELECT scope, rep, w, large, 'old' AS signal, d_max AS score FROM sc UNION ALL SELECT scope, rep, w, large, 'new', d_mean FROM sc), {_auroc_sql('sg', 'scope, signal')},
ar AS (SELECT scope, rep, max(auroc) FILTER (WHERE signal = 'old') AS ao, max(auroc) FILTER (WHERE signal = 'new') AS an FROM au GROUP BY ALL),
bj AS (SELECT bt.*, ao, an FROM bt JOIN ar USING (scope, rep)),
lg AS ({' UNION ALL '.join(f"SELECT scope, rep, '{m}' AS metric, {e} AS v FROM bj" for m, e in zip(_DELTAS, ('(cn-co)::DOUBLE', '(cn-co)/nullif(pk, 0)', 'round(cn-ex, 9)', 'round(co-ex, 9)', 'ao', 'an', 'an-ao')))})"""
_SIGNS = f"{{w}}, {n_if('rep > 0 AND v>0')} AS positive, {n_if('rep > 0 AND v=0')} AS zero, {n_if('rep > 0 AND v<0')} AS negative, round(avg((v>0)::INT) FILTER (WHERE rep > 0), 9) AS share_positive"
_WIDTH = r("quantile_cont(v, 0.975) FILTER (WHERE rep > 0)-quantile_cont(v, 0.025) FILTER (WHERE rep > 0)", "width")


@query("k9_queue_difference_bootstrap", with_views("signals", f"""WITH {_K9} SELECT scope, metric, {_est('v')}, {_SIGNS.format(w=_WIDTH)} FROM lg GROUP BY scope, metric"""))
def _k9(spark, sf):
    s = with_signals(spark, sf).where(c("cv_fold").isNotNull()).select("item_id", "item_no", "cv_fold", "large", "d_max", "d_mean")
    a = queue(s, [F.desc("d_max"), "item_id"], 0.2, ["cv_fold"])
    a = a.select("item_id", "item_no", "cv_fold", "large", "d_max", "d_mean", c("selected").alias("old"), (c("queue_size") / c("group_n")).alias("rate"))
    both = queue(a, [F.desc("d_mean"), "item_id"], 0.2, ["cv_fold"]).withColumnRenamed("selected", "new")
    boot = B.queue_difference_bootstrap(both, c("d_max"), c("d_mean"), REPS, SEED)
    return rounded(B.sign_shares(boot, _DELTAS, ["scope"]))


def _ci(value: str) -> str:
    return f"{r(f'avg({value})', 'mean')}, {r(f'quantile_cont({value}, 0.025)', 'low')}, {r(f'quantile_cont({value}, 0.975)', 'high')}, count({value}) AS valid, count(*)-count({value}) AS skipped"


# clusters are drawn with replacement from the same md5 uniforms in both engines
_PICK = "(('0x' || substr(md5('42:' || rep || ':' || idx), 1, 8))::BIGINT/4294967296.0::DOUBLE)"


@query("k10_cluster_bootstrap", with_views("signals", f"""WITH qd AS (SELECT cluster, large, row_number() OVER (ORDER BY d_max DESC, item_id) <= ceil(count(*) OVER ()*0.2::DOUBLE) AS old, row_number() OVER (ORDER BY d_mean DESC, item_id) <= ceil(count(*) OVER ()*0.2::DOUBLE) AS new FROM signals),
cl AS (SELECT cluster, {n_if('large AND new')}-{n_if('large AND old')} AS delta, {n_if('large')} AS positives FROM qd GROUP BY cluster), ix AS (SELECT *, row_number() OVER (ORDER BY cluster) AS idx, count(*) OVER () AS c FROM cl),
sl AS (SELECT rep, CAST(floor({_PICK}*c) AS BIGINT)+1 AS pick FROM (SELECT idx, c, unnest(generate_series(1, {REPS}))::INT AS rep FROM ix)),
bt AS (SELECT rep, CAST(sum(delta) AS DOUBLE) AS delta, sum(delta)/nullif(sum(positives), 0) AS delta_capture FROM sl JOIN ix ON ix.idx=sl.pick GROUP BY rep),
lg AS (SELECT 'delta' AS metric, delta AS v FROM bt UNION ALL SELECT 'delta_capture', delta_capture FROM bt)
SELECT metric, {_ci('v')}, {r('quantile_cont(v, 0.975)-quantile_cont(v, 0.025)', 'width')}, {n_if('v>0')} AS positive, {n_if('v=0')} AS zero, {n_if('v<0')} AS negative, {r('avg((v>0)::INT)', 'share_positive')} FROM lg GROUP BY metric"""))
def _k10(spark, sf):
    s = with_signals(spark, sf).select("item_id", "cluster", "large", "d_max", "d_mean")
    a = queue(s, [F.desc("d_max"), "item_id"], 0.2).select("item_id", "cluster", "large", "d_mean", c("selected").alias("old"))
    both = queue(a, [F.desc("d_mean"), "item_id"], 0.2)
    hit = lambda q: (c("large") & c(q)).cast("bigint")
    sums = {"delta": hit("selected") - hit("old"), "positives": c("large").cast("bigint")}
    boot = B.cluster_bootstrap(both, "cluster", sums, REPS, SEED)
    boot = boot.withColumn("delta_capture", F.try_divide(c("delta").cast("double"), c("positives").cast("double")))
    return rounded(B.sign_shares(boot, ["delta", "delta_capture"]).drop("estimate"))


_WCORR = "(sum(w*a*b)-sum(w*a)*sum(w*b)/sum(w))/sqrt(nullif((sum(w*a*a)-sum(w*a)*sum(w*a)/sum(w))*(sum(w*b*b)-sum(w*b)*sum(w*b)/sum(w)), 0))"


def _ranks_sql(columns: tuple[str, ...]) -> str:
    """CTE ``rk``: the rows of ``rw`` with the centred average rank ``k_x`` of every column under multiplicities."""
    tables = ", ".join(
        f"n_{x} AS (SELECT rep, {x}, sum(w) AS n FROM rw GROUP BY ALL), q_{x} AS (SELECT rep, {x}, (sum(n) OVER (PARTITION BY rep ORDER BY {x}) - n/2 - sum(n) OVER (PARTITION BY rep)/2)::DOUBLE AS k_{x} FROM n_{x})" for x in columns
    )
    return f"{tables}, rk AS (SELECT * FROM rw {' '.join(f'JOIN q_{x} USING (rep, {x})' for x in columns)})"


def _corr_sql(a: str, b: str) -> str:
    return _WCORR.replace("*a", f"*{a}").replace("*b", f"*{b}")


@query("k11_spearman_bootstrap", with_views("signals", f"""WITH {_cells_sql({'d': 'd_max', 'e': 'max_err', 'words': 'word_count'}, 'signals')}, {_ranks_sql(('d', 'e', 'words'))},
s AS (SELECT rep, {_corr_sql('k_d', 'k_e')} AS de, {_corr_sql('k_words', 'k_e')} AS we FROM rk GROUP BY rep),
lg AS (SELECT rep, 'd_error' AS pair, de AS v FROM s UNION ALL SELECT rep, 'words_error', we FROM s UNION ALL SELECT rep, 'difference', de-we FROM s)
SELECT pair, {_est('v')} FROM lg GROUP BY pair"""))
def _k11(spark, sf):
    s = with_signals(spark, sf).select("item_no", "d_max", "max_err", "word_count")
    boot = materialise(B.spearman_bootstrap(s, {"d_error": (c("d_max"), c("max_err")), "words_error": (c("word_count"), c("max_err"))}, REPS, SEED), "spearman")
    at = lambda p: F.max(F.when(c("pair") == p, c("spearman")))
    diff = boot.groupBy("rep").agg((at("d_error") - at("words_error")).alias("spearman"))
    rows = boot.unionByName(diff.select(F.lit("difference").alias("pair"), "rep", "spearman"))
    return rounded(B.estimates(rows, "spearman", ["pair"]))


_SAMPLES = ("pooled", "model_train", "validation", "official_test")


def _k12_sql() -> str:
    """Each sample group on its own, as one statement per group."""
    whole = []
    for i, g in enumerate(_SAMPLES):
        src = f"(SELECT * FROM scored{'' if g == 'pooled' else f" WHERE split = '{g}'"})"
        ctes = f"""{_cells_sql({'a': 'r1_v::DOUBLE', 'b': 'r2_v::DOUBLE'}, src)}, {_ranks_sql(('a', 'b'))},
        s AS (SELECT rep, {_corr_sql('k_a', 'k_b')} AS rho, sum(w*a)/sum(w) AS ma, sum(w*b)/sum(w) AS mb, {_WCORR} AS r FROM rk GROUP BY rep),
        md AS (SELECT rep, quantile_cont(a, 0.5) AS da, quantile_cont(b, 0.5) AS db FROM (SELECT rep, a, b, unnest(generate_series(1, w)) FROM rw) GROUP BY rep),
        lg AS ({' UNION ALL '.join(f"SELECT rep, '{m}' AS metric, {e} AS v FROM s JOIN md USING (rep)" for m, e in zip(B.AGREEMENT, ('ma', 'mb', 'abs(mb-ma)', 'mb/nullif(ma, 0)', 'r', 'rho', 'da', 'db')))})"""
        whole.append(f"SELECT '{g}' AS sample, * FROM (WITH {ctes} SELECT metric, {_est('v')} FROM lg GROUP BY metric) AS g{i}")
    return " UNION ALL ".join(whole)


@query("k12_agreement_bootstrap", with_views("scored", _k12_sql()))
def _k12(spark, sf):
    s = scored(spark, sf).select("item_no", "split", "r1_v", "r2_v")
    parts = []
    for g in _SAMPLES:
        boot = B.agreement_bootstrap(s if g == "pooled" else s.where(c("split") == g), "r1_v", "r2_v", REPS, SEED)
        parts.append(boot.select("rep", F.lit(g).alias("sample"), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), c(m).alias("v")) for m in B.AGREEMENT]))))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rounded(B.estimates(rows, "v", ["sample", "metric"]))


@query("k13_slope_bootstrap", with_views("scored", f"""WITH {_cells_sql({'y': 'for_v-y_v', 'x': 'lin_v-for_v'}, 'scored')},
s AS (SELECT rep, (sum(w*x*y)-sum(w*x)*sum(w*y)/sum(w))/nullif(sum(w*x*x)-sum(w*x)*sum(w*x)/sum(w), 0) AS v FROM rw GROUP BY rep) SELECT {_est('v')} FROM s"""))
def _k13(spark, sf):
    boot = B.slope_bootstrap(scored(spark, sf), c("for_v") - c("y_v"), c("lin_v") - c("for_v"), REPS, SEED)
    return rounded(B.estimates(boot, "slope"))


_ERRS = {"lin_v": "lin_v-y_v", "for_v": "for_v-y_v", "lin_g": "lin_g-y_g", "for_g": "for_g-y_g"}


def _k14_sql() -> str:
    names = list(_ERRS)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    cols = ", ".join(f"{_corr_sql(a, b)} AS p{i}, {_corr_sql('k_' + a, 'k_' + b)} AS s{i}" for i, (a, b) in enumerate(pairs))
    rows = " UNION ALL ".join(f"SELECT rep, '{a}' AS model_a, '{b}' AS model_b, '{m}' AS method, {m[0]}{i} AS v FROM bt" for i, (a, b) in enumerate(pairs) for m in ("pearson", "spearman"))
    return f"""WITH {_cells_sql({n: f'({e})' for n, e in _ERRS.items()}, 'scored')}, {_ranks_sql(tuple(names))}, bt AS (SELECT rep, {cols} FROM rk GROUP BY rep), lg AS ({rows}),
    es AS (SELECT model_a, model_b, method, {_est('v')} FROM lg GROUP BY ALL) SELECT *, estimate<0.95 AS below_limit, high<0.95 AS interval_below_limit FROM es"""


@query("k14_error_correlations", with_views("scored", _k14_sql()))
def _k14(spark, sf):
    s = scored(spark, sf).select("item_no", *[F.expr(e).alias(f"_{k}") for k, e in _ERRS.items()])
    return rounded(B.error_correlations(s, {k: c(f"_{k}") for k in _ERRS}, REPS, SEED))


@query("k15_intervals", with_views("signals", f"""WITH {_AB}, d AS (SELECT rep, max(auroc) FILTER (WHERE signal='disagreement')-max(auroc) FILTER (WHERE signal='negative_words') AS v FROM au WHERE rep > 0 GROUP BY rep) SELECT {{ci}} FROM d""".replace("{ci}", "round(avg(v), 9) AS mean, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high, count(v) AS valid, count(*)-count(v) AS skipped")))
def _k15(spark, sf):
    at = lambda p: F.max(F.when(c("signal") == p, c("auroc")))
    d = _auroc_draws(spark, sf).where("rep > 0").groupBy("rep").agg((at("disagreement") - at("negative_words")).alias("v"))
    return rounded(X.intervals(d, "v"))


@query("c24_evidence_class", with_views("signals", f"""WITH {_STRATS}, m AS (SELECT strategy, {n_if('large AND rank<=ceil(n_all*0.2::DOUBLE)')}/{n_if('large')} AS cap, ceil(max(n_all)*0.2::DOUBLE)/max(n_all) AS rnd FROM rk GROUP BY strategy),
w AS (SELECT max(cap) FILTER (WHERE strategy='disagreement') AS d, max(rnd) AS rm, max(cap) FILTER (WHERE strategy='shortest_first') AS s, max(cap) FILTER (WHERE strategy='extremity') AS e FROM m)
SELECT {r('d', 'disagreement')}, {r('rm', 'random_mean')}, CASE WHEN d>greatest(rm, s, e) THEN 'A. Supports added value of disagreement' WHEN d<least(rm, s, e) THEN 'C. Worse than simpler baselines'
WHEN d>=rm AND d BETWEEN least(s, e) AND greatest(s, e) THEN 'B. Comparable to simpler baselines' ELSE 'D. Mixed / inconclusive' END AS evidence FROM w"""))
def _c24(spark, sf):
    m = Q.queue_metrics(Q.select_budget(_ranked_strategies(spark, sf)), ["strategy"])
    at = lambda s: F.max(F.when(c("strategy") == s, c("capture_rate")))
    w = m.agg(at("disagreement").alias("disagreement"), F.max(c("selected_count") / c("n")).alias("random_mean"),
              at("shortest_first").alias("s"), at("extremity").alias("e"))
    out = w.withColumn("evidence", S.evidence_class(c("disagreement"), c("random_mean"), c("s"), c("e")))
    return rounded(out.drop("s", "e"))
