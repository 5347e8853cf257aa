"""Sections A, B and G: sources and sinks, contracts, joins."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marklens.functions import metrics as M
from marklens.functions import scalars as S
from marklens.operators import contracts as K
from marklens.operators import evaluation as E
from marklens.operators import joins as J
from marklens.operators import profile as P
from marklens.operators import queues as Q
from marklens.operators.order import queue, rank_rows
from marklens.plans import sqltext as Z
from marklens.plans.registry import query
from marklens.plans.sqltext import n_if, r, rounded
from marklens.plans.views import long_scores, scored, table, with_signals, with_views
from marklens.session import materialise, scratch_dir
from marklens.sources import resume as R
from marklens.sources import tables as IO

c = F.col


def _path(spark, label: str) -> str:
    return f"{scratch_dir(spark)}/marklens-{label}-{uuid.uuid4().hex}"


# ---- A: sources and sinks -----------------------------------------------------------------------

@query("a1_read_renamed_csv", "SELECT CAST(doc_id AS VARCHAR) AS item_id, text, CAST(quality AS DOUBLE) AS y_v, CAST(toxic AS DOUBLE) AS y_g FROM documents JOIN labels USING (doc_id)")
def _a1(spark, sf):
    raw = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        c("doc_id").alias("text_id"), c("text").alias("full_text"), c("quality").alias("Vocabulary"), c("toxic").alias("Grammar")
    )
    path = _path(spark, "csv")
    raw.write.option("header", True).option("escape", '"').csv(path)
    schema = T.StructType([
        T.StructField("text_id", T.StringType()), T.StructField("full_text", T.StringType()),
        T.StructField("Vocabulary", T.DoubleType()), T.StructField("Grammar", T.DoubleType()),
    ])
    return IO.read_csv(spark, path, schema, {"text_id": "item_id", "full_text": "text", "Vocabulary": "y_v", "Grammar": "y_g"})


def _written_by_split(spark, sf):
    path = _path(spark, "split")
    scored(spark, sf).select("item_id", "split", "y_v", "for_v").write.partitionBy("split").parquet(path)
    return path


@query("a2_read_partitions", with_views("scored", "SELECT split, count(*) AS rows, sum(y_v) AS total FROM scored GROUP BY split"))
def _a2(spark, sf):
    path = _written_by_split(spark, sf)
    parts = [IO.read_partition(spark, path, p) for p in ("train", "val", "test")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("y_v").alias("total"))


@query("a3_pruned_columns", "SELECT doc_id, n_chars FROM documents")
def _a3(spark, sf):
    return IO.read_columns(spark, f"{sf}/documents.parquet", ["doc_id", "n_chars"], deny=["text"])


@query("a4_allow_listed", with_views("scored", "SELECT item_id, r1_v, r2_v FROM scored WHERE privacy_review_status='not_flagged' AND split<>'official_test'"))
def _a4(spark, sf):
    s = scored(spark, sf)
    allowed = s.where("privacy_review_status = 'not_flagged' AND split <> 'official_test'").select("item_id")
    forbidden = s.where("split = 'official_test'").select("item_id")
    return IO.allow_listed(s.select("item_id", "r1_v", "r2_v"), allowed, "item_id", forbidden)


@query("a5_corpus_writer", """WITH u AS (SELECT doc_id, text, 'documents' AS source_partition FROM documents UNION ALL SELECT -item_id-1, text, 'benchmark' FROM benchmark)
SELECT source_partition, CASE WHEN source_partition='benchmark' THEN 'official_test' ELSE 'model_train' END AS split, count(*) AS rows, CAST(sum(length(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS BIGINT) AS chars FROM u GROUP BY ALL""")
def _a5(spark, sf):
    docs = table(spark, sf, "documents").select(c("doc_id").alias("item_id"), S.clean_text(c("text")).alias("clean_text"))
    bench = table(spark, sf, "benchmark").select((-c("item_id") - 1).alias("item_id"), S.clean_text(c("text")).alias("clean_text"))
    manifest = docs.select("item_id", F.lit("model_train").alias("split")).unionByName(bench.select("item_id", F.lit("official_test").alias("split")))
    path = _path(spark, "corpus")
    IO.write_corpus({"documents": docs, "benchmark": bench}, manifest, "item_id", path, ["item_id", "clean_text"])
    out = spark.read.parquet(path)
    return out.groupBy("source_partition", c("split").cast("string").alias("split")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("clean_text")).alias("chars")
    )


@query("a6_numeric_csv_sink", with_views("scored", """SELECT item_id, printf('%.12g', lin_v::DOUBLE) AS lin_v, printf('%.12g', lin_v/3) AS third,
    printf('%.12g', lin_v/7e6) AS small, printf('%.12g', lin_v*1234567890123.4567) AS large FROM scored"""))
def _a6(spark, sf):
    path = _path(spark, "numbers")
    wide = scored(spark, sf).select("item_id", c("lin_v").cast("double"), (c("lin_v") / 3).alias("third"), (c("lin_v") / 7e6).alias("small"), (c("lin_v") * 1234567890123.4567).alias("large"))
    IO.write_numeric_csv(wide, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in wide.columns])
    return IO.read_csv(spark, path, schema)


_DOC_WORDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("words", T.LongType())])
_WORDS_SQL = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[''’-][\p{L}\p{N}_]+)*'))"


@query("a7_resumable_extraction", f"SELECT doc_id, {_WORDS_SQL} AS words FROM documents")
def _a7(spark, sf):
    docs = table(spark, sf, "documents")
    path = _path(spark, "resume")
    work = lambda d: d.select("doc_id", S.word_count(c("text")).cast("bigint").alias("words"))
    R.run_pending(docs.where("lang = 'en'"), path, _DOC_WORDS, ["doc_id"], work)
    return R.run_pending(docs, path, _DOC_WORDS, ["doc_id"], work)


@query("a8_config_keyed_counts", f"SELECT doc_id, sha256('window=150') AS config_sha, {_WORDS_SQL} AS words FROM documents")
def _a8(spark, sf):
    docs = table(spark, sf, "documents")
    path = _path(spark, "counts")
    schema = T.StructType([*_DOC_WORDS.fields, T.StructField("config_sha", T.StringType())])
    work = lambda d: d.select("doc_id", S.word_count(c("text")).cast("bigint").alias("words"), "config_sha")
    R.run_pending(docs.where("lang = 'de'"), path, schema, ["doc_id"], work, "window=100")
    return R.run_pending(docs, path, schema, ["doc_id"], work, "window=150")


_INV = {"documents": 5, "labels": 3, "benchmark": 2, "conversations": 4}


@query("a9_file_inventory", " UNION ALL ".join(
    f"SELECT '{t}' AS source, count(*) AS rows, {n}::INT AS columns, {n_if(cond)} AS complete_rows FROM {t}" for (t, n), cond in zip(_INV.items(), (
        "doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL", "doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL",
        "item_id IS NOT NULL AND text IS NOT NULL", "conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL"))))
def _a9(spark, sf):
    return P.file_inventory({t: table(spark, sf, t) for t in _INV})


@query("a9_file_bytes")
def _a9b(spark, sf):
    files = [IO.file_bytes(spark, f"{sf}/{t}.parquet").withColumn("source", F.lit(t)) for t in _INV]
    return reduce(DataFrame.unionByName, files)


_DIG = ["('0x' || substr(md5(concat_ws('|', 'v' || CAST(doc_id AS VARCHAR), 'v' || text, 'v' || lang)), {}, 8))::BIGINT".format(8 * i + 1) for i in range(4)]


@query("a10_table_fingerprint", f"SELECT count(*) AS rows, concat_ws(':', {', '.join(f'CAST(sum({d}) AS VARCHAR)' for d in _DIG)}) AS digest_sum, concat({', '.join(f'lpad(lower(to_hex(bit_xor({d}))), 8, chr(48))' for d in _DIG)}) AS digest_xor FROM documents")
def _a10(spark, sf):
    return IO.table_fingerprint(table(spark, sf, "documents"), ["doc_id", "text", "lang"])


@query("a11_ordered_id_digest", with_views("scored", """WITH RECURSIVE z AS (SELECT greatest(0, ceil(log2(max(n)/1024.0)/4))::BIGINT AS digits FROM (SELECT count(*) AS n FROM scored WHERE cv_fold IS NOT NULL GROUP BY cv_fold)),
b AS (SELECT cv_fold, substr(md5(item_id), 1, digits) AS b, sha256(string_agg(item_id, chr(10) ORDER BY item_id)) AS d, count(*)::BIGINT AS n, digits, greatest(1, (digits+1)//2) AS steps FROM scored, z WHERE cv_fold IS NOT NULL GROUP BY ALL),
t AS (SELECT * FROM b UNION ALL SELECT cv_fold, substr(b, 1, greatest(0, digits-2)), sha256(string_agg(d, chr(10) ORDER BY b)), sum(n)::BIGINT, greatest(0, digits-2), steps-1 FROM t WHERE steps > 0 GROUP BY cv_fold, substr(b, 1, greatest(0, digits-2)), digits, steps)
SELECT cv_fold, n AS ids, d AS digest FROM t WHERE steps = 0"""))
def _a11(spark, sf):
    return IO.ordered_id_digest(scored(spark, sf).where(c("cv_fold").isNotNull()), "item_id", ["cv_fold"])


# ---- B: contracts -------------------------------------------------------------------------------

@query("b1_items_report", """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE k IS NULL), 0) AS BIGINT) AS null_ids, CAST(coalesce(sum(n-1) FILTER (WHERE k IS NOT NULL), 0) AS BIGINT) AS repeated_ids, 0::BIGINT AS blank_texts,
CAST(sum(bp) AS BIGINT) AS bad_l_extendedprice FROM (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS k, count(*) AS n, count(*) FILTER (WHERE l_extendedprice IS NULL) AS bp FROM lineitem GROUP BY 1)""")
def _b1(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("line_id", F.concat_ws("-", c("l_orderkey").cast("string"), c("l_linenumber").cast("string")))
    return K.items_report(li, "line_id", None, ["l_extendedprice"])


@query("b1_texts_report", """SELECT lang, count(*) AS rows, count(*) FILTER (WHERE doc_id IS NULL) AS null_ids, count(*)-count(DISTINCT doc_id) AS repeated_ids, count(*) FILTER (WHERE trim(text)='') AS blank_texts, count(*) FILTER (WHERE n_chars IS NULL) AS bad_n_chars FROM documents GROUP BY lang""")
def _b1b(spark, sf):
    return K.items_report(table(spark, sf, "documents"), "doc_id", "text", ["n_chars"], ["lang"])


@query("b2_split_gate", with_views("scored", "SELECT split, count(*) AS rows, split='validation' AS allowed FROM scored GROUP BY split"))
def _b2(spark, sf):
    return K.split_gate(scored(spark, sf), ["validation"])


@query("b3_population_report", with_views("scored", f"""SELECT count(*) AS ids, 0::BIGINT AS ids_not_everywhere, 0::BIGINT AS repeated_ids, {n_if('NOT (y_v BETWEEN 1 AND 5) OR NOT (lin_v BETWEEN 1 AND 5)')} AS rows_out_of_range, {n_if("privacy_review_status='not_flagged'")} AS eligible FROM scored"""))
def _b3(spark, sf):
    s = scored(spark, sf)
    return K.population_report(
        s.select("item_id", "word_count"), s.select("item_id", "y_v", "lin_v"), s.select("item_id", "privacy_review_status"),
        "item_id", ["y_v", "lin_v"], "privacy_review_status", "not_flagged",
    )


@query("b4_metadata_report", with_views("scored", """SELECT count(*) AS common, count(*) FILTER (WHERE a.split IS DISTINCT FROM b.split) AS differs_split, count(*) FILTER (WHERE a.cv_fold IS DISTINCT FROM b.cv_fold) AS differs_cv_fold
FROM scored a JOIN (SELECT item_id, split, CASE WHEN cv_fold<>4 THEN cv_fold END AS cv_fold FROM scored) b ON a.item_id=b.item_id"""))
def _b4(spark, sf):
    s = scored(spark, sf).select("item_id", "split", "cv_fold")
    return K.metadata_report(s, s.withColumn("cv_fold", F.when(c("cv_fold") != 4, c("cv_fold"))), "item_id", ["split", "cv_fold"])


@query("b5_fold_report", with_views("scored", f"""SELECT count(DISTINCT CASE WHEN split='model_train' THEN cv_fold END) AS folds_in_train, {n_if("split='model_train' AND (cv_fold IS NULL OR cv_fold NOT BETWEEN 0 AND 4)")} AS bad_train_folds,
{n_if("split<>'model_train' AND cv_fold IS NOT NULL")} AS folds_outside_train, 0::BIGINT AS ids_in_two_splits FROM scored"""))
def _b5(spark, sf):
    return K.fold_report(scored(spark, sf), 5, "item_id")


@query("b6_status_counts", with_views("scored", "SELECT split, privacy_review_status, count(*) AS rows, privacy_review_status='not_flagged' AS kept FROM scored GROUP BY ALL"))
def _b6(spark, sf):
    return K.status_counts(scored(spark, sf), "not_flagged")


_HASH = "sha256(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss'))"


@query("b7_leakage_report", f"""WITH d AS (SELECT doc_id, {_HASH} AS h, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'validation' ELSE 'model_train' END AS split FROM documents)
SELECT (SELECT count(*) FROM (SELECT doc_id FROM d GROUP BY doc_id HAVING count(DISTINCT split)>1)) AS ids_in_two_splits, (SELECT count(*) FROM (SELECT h FROM d GROUP BY h HAVING count(DISTINCT split)>1)) AS contents_in_two_splits""")
def _b7(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", S.text_hash(c("text")).alias("h"),
        F.when(c("source").isin("src0", "src1", "src2", "src3"), "validation").otherwise("model_train").alias("split"),
    )
    return K.leakage_report(d, "doc_id", c("h"), "split")


@query("b8_group_composition", with_views("scored", """WITH p AS (SELECT cv_fold, cluster, count(*) AS held_out FROM scored WHERE cv_fold IS NOT NULL GROUP BY ALL), t AS (SELECT cluster, sum(held_out) AS n FROM p GROUP BY cluster)
SELECT cv_fold, p.cluster, held_out, CAST(n-held_out AS BIGINT) AS in_training, n=held_out AS disjoint FROM p JOIN t ON p.cluster=t.cluster"""))
def _b8(spark, sf):
    return K.group_composition(scored(spark, sf).where(c("cv_fold").isNotNull()), "cv_fold", "cluster")


@query("b9_tolerance_report", with_views("scored", f"""SELECT 'lin_v' AS "column", 0::BIGINT AS unmatched, max(abs(lin_v-for_v)) AS max_difference, {n_if('abs(lin_v-for_v)>0.5')} AS beyond_tolerance FROM scored UNION ALL
SELECT 'lin_g', 0, max(abs(lin_g-for_g)), {n_if('abs(lin_g-for_g)>0.5')} FROM scored"""))
def _b9(spark, sf):
    s = scored(spark, sf)
    return K.tolerance_report(s.select("item_id", "lin_v", "lin_g"), s.select("item_id", "for_v", "for_g"), ["item_id"], {"lin_v": "for_v", "lin_g": "for_g"}, 0.5)


@query("b10_range_flag", with_views("scored", "SELECT item_id, CASE WHEN (lin_v-1)/4 BETWEEN 0 AND 1 AND (lin_g-1)/4 BETWEEN 0 AND 1 AND (for_v-1)/4 BETWEEN 0 AND 1 THEN 'pass' ELSE 'fail' END AS range_check FROM scored"))
def _b10(spark, sf):
    return scored(spark, sf).select("item_id", S.ratios_in_range((c("lin_v") - 1) / 4, (c("lin_g") - 1) / 4, (c("for_v") - 1) / 4).alias("range_check"))


@query("b11_scientific_ids", "SELECT count(*) AS rows, count(*) FILTER (WHERE regexp_matches(CASE WHEN o_orderstatus='P' THEN CAST(o_orderkey AS VARCHAR) || 'E+12' ELSE CAST(o_orderkey AS VARCHAR) END, '(?i)^[0-9.]+E\\+[0-9]+$')) AS scientific_ids FROM orders")
def _b11(spark, sf):
    o = table(spark, sf, "orders")
    key = F.when(c("o_orderstatus") == "P", F.concat(c("o_orderkey").cast("string"), F.lit("E+12"))).otherwise(c("o_orderkey").cast("string"))
    return K.scientific_ids(o.select(key.alias("key")), "key")


@query("b12_form_errors", """WITH f AS (SELECT event_id, event_type, CASE WHEN value>=0 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS n, CAST(user_id AS VARCHAR) AS codes, ts AS started, CASE WHEN event_type='purchase' THEN ts - INTERVAL 1 DAY ELSE ts + INTERVAL 5 MINUTE END AS ended FROM events)
SELECT event_id, concat_ws(',', CASE WHEN NOT coalesce(regexp_matches(n, '^[0-9]+$'), false) THEN 'count' END, CASE WHEN NOT coalesce(regexp_matches(codes, '^[1-8](,[1-8])*$'), false) THEN 'codes' END,
CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'category' END, CASE WHEN NOT ended>=started THEN 'times' END) AS errors FROM f""")
def _b12(spark, sf):
    f = table(spark, sf, "events").select(
        "event_id", "event_type", F.when(c("value") >= 0, F.floor("value").cast("string")).alias("n"), c("user_id").cast("string").alias("codes"),
        c("ts").alias("started"), F.when(c("event_type") == "purchase", c("ts") - F.expr("INTERVAL 1 DAY")).otherwise(c("ts") + F.expr("INTERVAL 5 MINUTES")).alias("ended"),
    )
    errors = K.form_errors({
        "count": c("n").rlike("^[0-9]+$"), "codes": c("codes").rlike("^[1-8](,[1-8])*$"),
        "category": c("event_type").isin("view", "click", "purchase"), "times": c("ended") >= c("started"),
    })
    return f.select("event_id", F.array_join(errors, ",").alias("errors"))


@query("b13_stored_metrics", with_views("long", """SELECT 'mae' AS "column", 0::BIGINT AS unmatched, 0.25::DOUBLE AS max_difference, 1::BIGINT AS beyond_tolerance, 0::BIGINT AS repeated_keys UNION ALL SELECT 'rmse', 0, 0.0, 0, 0"""))
def _b13(spark, sf):
    fresh = E.metric_table(long_scores(spark, sf)).select("target", "model", F.round("mae", 9).alias("mae"), F.round("rmse", 9).alias("rmse"))
    wrong = (c("target") == "V") & (c("model") == "linear")
    stored = materialise(fresh.withColumn("mae", F.when(wrong, c("mae") + 0.25).otherwise(c("mae"))), "stored")
    return rounded(K.stored_metrics_report(stored, fresh, ["target", "model"], ["mae", "rmse"], 1e-8))


# ---- G: joins and set operations ----------------------------------------------------------------

@query("g1_status_left_join", "SELECT doc_id, CASE WHEN toxic=1 THEN 'flagged' WHEN labels.doc_id IS NOT NULL THEN 'not_flagged' ELSE 'unresolved_raw_id_link' END AS privacy_review_status FROM documents LEFT JOIN labels USING (doc_id)")
def _g1(spark, sf):
    return J.with_status(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", ["toxic"])


@query("g2_one_to_one", with_views("scored", "SELECT item_id, y_v, for_v FROM scored"))
def _g2(spark, sf):
    s = scored(spark, sf)
    return J.one_to_one(s.select("item_id", "y_v"), s.select("item_id", "for_v"), "item_id", ["y_v", "for_v"])


@query("g2_key_report", """WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1), j AS (SELECT a.n AS x, b.n AS y FROM a FULL JOIN b ON a.k=b.k)
SELECT count(x) AS left_ids, count(y) AS right_ids, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS common, count(*) FILTER (WHERE y IS NULL) AS only_left, count(*) FILTER (WHERE x IS NULL) AS only_right, count(*) FILTER (WHERE x>1) AS repeated_left, count(*) FILTER (WHERE y>1) AS repeated_right FROM j""")
def _g2b(spark, sf):
    return J.key_report(table(spark, sf, "lineitem").select(c("l_orderkey").alias("k")), table(spark, sf, "orders").select(c("o_orderkey").alias("k")), "k")


@query("g3_left_complete", with_views("scored", "SELECT item_id, split, y_v, word_count FROM scored"))
def _g3(spark, sf):
    s = scored(spark, sf)
    return J.left_complete(s.select("item_id", "split", "y_v"), s.select("item_id", "split", "word_count"), ["item_id", "split"], ["word_count"])


@query("g3_left_gaps", "SELECT count(*) AS rows, count(*) FILTER (WHERE q IS NULL) AS unmatched FROM documents LEFT JOIN (SELECT doc_id, quality AS q FROM labels) l USING (doc_id)")
def _g3b(spark, sf):
    return J.left_gaps(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@query("g4_prepare_training", with_views("scored", "SELECT split, cv_fold, count(*) AS rows, sum(for_v) AS total FROM scored WHERE split<>'official_test' AND privacy_review_status='not_flagged' GROUP BY ALL"))
def _g4(spark, sf):
    s = scored(spark, sf)
    features = s.select("item_id", "split", "cv_fold", "word_count", "for_v")
    train, val = J.prepare_training(features, s.select("item_id", "split", "cv_fold", "privacy_review_status"), "item_id", ["word_count", "for_v"])
    return train.unionByName(val).groupBy("split", "cv_fold").agg(F.count(F.lit(1)).alias("rows"), F.sum("for_v").alias("total"))


@query("g5_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _g5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query("g6_anti_join", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _g6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("g7_suffixed_join", with_views("scored", "SELECT item_id, y_v AS y_v_left, y_v AS y_v_right, lin_v AS p_left, for_v AS p_right FROM scored"))
def _g7(spark, sf):
    s = scored(spark, sf)
    return J.suffixed(s.select("item_id", "y_v", c("lin_v").alias("p")), s.select("item_id", "y_v", c("for_v").alias("p")), "item_id", ["y_v", "p"])


@query("g8_lookup_rank", with_views("signals", "SELECT item_id, d_max, row_number() OVER (ORDER BY word_count, item_id) AS length_rank FROM signals"))
def _g8(spark, sf):
    s = with_signals(spark, sf)
    ranks = rank_rows(s.select("item_id", "word_count"), ["word_count", "item_id"], rank="length_rank", size=None)
    return s.select("item_id", "d_max").join(ranks.select("item_id", "length_rank"), "item_id", "left")


@query("g9_union_sources", "SELECT 'documents' AS source_name, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents UNION ALL SELECT 'benchmark', count(*), CAST(sum(length(text)) AS BIGINT) FROM benchmark UNION ALL SELECT 'conversations', count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations")
def _g9(spark, sf):
    parts = [table(spark, sf, t).select(F.lit(t).alias("source_name"), "text") for t in ("documents", "benchmark", "conversations")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("source_name").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"))


@query("g10_id_sets", """SELECT count(a) AS left_ids, count(b) AS right_ids, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS common, count(*) FILTER (WHERE b IS NULL) AS only_left, count(*) FILTER (WHERE a IS NULL) AS only_right, 0::BIGINT AS repeated_left, 0::BIGINT AS repeated_right
FROM (SELECT d.doc_id AS a, l.doc_id AS b FROM documents d FULL JOIN labels l ON d.doc_id=l.doc_id)""")
def _g10(spark, sf):
    return J.key_report(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


_TWO = "qd AS (SELECT *, row_number() OVER (ORDER BY d_max DESC, item_id) <= ceil(count(*) OVER ()*0.2::DOUBLE) AS a, row_number() OVER (ORDER BY d_mean DESC, item_id) <= ceil(count(*) OVER ()*0.2::DOUBLE) AS b FROM signals)"


@query("g11_queue_overlap", with_views("signals", f"""WITH {_TWO} SELECT segment, {n_if('a AND b')} AS both, {r(n_if('a AND b') + '/nullif(' + n_if('a') + ', 0)', 'fraction_of_a')}, {r(n_if('a AND b') + '/nullif(' + n_if('a OR b') + ', 0)', 'jaccard')},
{n_if('a AND b AND large')} AS positives_both, {n_if('a AND NOT b AND large')} AS positives_only_a, {n_if('NOT a AND b AND large')} AS positives_only_b, {n_if('NOT a AND NOT b AND large')} AS positives_neither FROM qd GROUP BY segment"""))
def _g11(spark, sf):
    s = with_signals(spark, sf).select("item_id", "segment", "large", "d_max", "d_mean")
    a = queue(s, [F.desc("d_max"), "item_id"], 0.2).select("item_id", "segment", "large", "d_mean", c("selected").alias("a"))
    b = queue(a, [F.desc("d_mean"), "item_id"], 0.2)
    return rounded(b.groupBy("segment").agg(*Q.overlap(b, c("a"), c("selected"), c("large"))))


_LIN = "greatest(abs(lin_v-y_v), abs(lin_g-y_g))"


@query("g12_anchor_overlap", with_views("signals", f"SELECT split, {n_if('large')} AS first, {n_if(f'{_LIN}>=1')} AS second, {n_if(f'large AND {_LIN}>=1')} AS both, {n_if(f'large OR {_LIN}>=1')} AS either, {n_if(f'large AND {_LIN}<1')} AS only_first, {n_if(f'NOT large AND {_LIN}>=1')} AS only_second FROM signals GROUP BY split"))
def _g12(spark, sf):
    lin = F.greatest(F.abs(c("lin_v") - c("y_v")), F.abs(c("lin_g") - c("y_g"))) >= 1
    return with_signals(spark, sf).groupBy("split").agg(*J.anchor_overlap(c("large"), lin))


_NEW = "greatest(abs((lin_v+for_v)/2-y_v), abs((lin_g+for_g)/2-y_g))"


@query("g13_fixed_by_new", with_views("signals", f"""WITH o AS (SELECT cv_fold, {_NEW} AS e FROM signals WHERE cv_fold IS NOT NULL AND large AND {_LIN}>=1), u AS (SELECT CAST(cv_fold AS VARCHAR) AS scope, e FROM o UNION ALL SELECT 'pooled', e FROM o)
SELECT scope, count(*) AS old_shared, {n_if('e>1')} AS still_wrong, {n_if('e<1')} AS fixed, {n_if('e=1')} AS at_threshold FROM u GROUP BY scope"""))
def _g13(spark, sf):
    s = with_signals(spark, sf).where(c("cv_fold").isNotNull())
    lin = F.greatest(F.abs(c("lin_v") - c("y_v")), F.abs(c("lin_g") - c("y_g"))) >= 1
    new = F.greatest(F.abs((c("lin_v") + c("for_v")) / 2 - c("y_v")), F.abs((c("lin_g") + c("for_g")) / 2 - c("y_g")))
    return J.fixed_by_new(s, "cv_fold", c("large") & lin, new, 1.0)
