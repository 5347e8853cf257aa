import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marklens.llm import bytetext as bt, packing
from marklens.llm.packing import pack
from marklens.llm.subwords import Subwords

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "\n\t", "it's we'll don't 'S 'T '", "a<|endoftext|>, b <|startoftext|>x|", "x.,!?", '"!!" foo"!! 7!! é!! É.', "ÀÉÎ ß straße İx Σας ΑΣ", "日本語 テスト。1234 ½ ٣",
    "a b　c", "éa ́", "THE,!! the,!! The", "😀😀 x😀.", "x" * 5000, "a.b.c ... #1 $5% &amp;", " x\u0085y",
]


def test_units_equal_whole_texts():
    whole = Tokenizer.from_file(PATH)
    import pyarrow as pa

    data, bounds = bt.raw(pa.array(ODD * 2))
    ids, cut = Subwords(PATH).ids(data, bounds)
    for k, text in enumerate(ODD * 2):
        assert ids[cut[k] : cut[k + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = [(i, t, "odd") for i, t in enumerate(ODD)] + [(900, None, None), (900, None, None), (901, "word " * 20000, "long")]
    real = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id") + 1000, "text", "source")
    return spark.createDataFrame(rows, "doc_id long, text string, source string").union(real).withColumn("row", F.lit(1)).withColumn("ids", F.lit(2)).repartition(5)


def test_pieces(spark, docs):
    got = pack(docs, PATH).toPandas()
    whole = Tokenizer.from_file(PATH)
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(whole.encode(r.text or "", add_special_tokens=False).ids + [2])
    by_doc = got.sort_values(["doc_id", "start"]).groupby("doc_id")
    assert set(by_doc.groups) == set(want)
    for k, g in by_doc:
        ids = np.concatenate([np.frombuffer(b, "<u4") for b in g["ids"]])
        assert sorted(ids.tolist()) == sorted(sum(want[k], []))
        if len(want[k]) == 1:
            assert ids.tolist() == want[k][0] and (g["start"].to_numpy() == np.r_[0, np.cumsum(g["length"])[:-1]]).all()
            assert (g["doc_tokens"] == len(ids)).all()
    total = int(got["length"].sum())
    padding = 0
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.r_[0, np.cumsum(g["length"])[:-1]]).all()
        used = int(g["length"].sum())
        assert used <= 4096 and (g["sequence_length"] == used).all() and (used & (used - 1)) == 0
        padding += 0 if used & (used - 1) == 0 else 4096 - used
    assert padding == 0
    assert sorted(got["sequence_id"].unique()) == list(range(got["sequence_id"].nunique()))
    share = got.assign(source=got["source"].fillna("?")).groupby("source")["length"].sum() / total
    full = got[got["sequence_length"] == 4096].assign(source=lambda d: d["source"].fillna("?"))
    mixed = full.groupby(["sequence_id", "source"])["length"].sum().unstack(fill_value=0) / 4096
    for s in share.index:  # every source, in every full window
        assert (mixed.get(s, 0) - share[s]).abs().max() <= 0.02
    assert zlib.crc32(got["ids"].iloc[0]) >= 0


def test_empty_and_width(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert pack(none, PATH).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    r = pack(one, PATH).collect()[0]
    assert (r.start, r.length, r.doc_tokens, r.sequence_id, r.offset, r.sequence_length) == (0, 1, 1, 0, 0, 1)
    with pytest.raises(ValueError):
        pack(one, PATH, window=1000)


def _round_robin(sizes, weights, window):
    """Plain deficit round-robin, one round per window: tokens that each queue sends in each round."""
    left, deficit, out = dict(sizes), dict.fromkeys(sizes, 0.0), []
    while any(left.values()):
        room, sent = float(window), dict.fromkeys(sizes, 0)
        while room > 1e-9 and any(left[s] - sent[s] > deficit[s] + 1e-9 for s in sizes):
            live = [s for s in sizes if left[s] - sent[s] > deficit[s] + 1e-9]
            whole = sum(weights[s] for s in live)
            step = min(room / whole, min((left[s] - sent[s] - deficit[s]) / weights[s] for s in live))
            for s in live:
                deficit[s] += weights[s] * step
            room -= whole * step
        for s in sizes:
            n = min(left[s], int(deficit[s] + 1e-6)) if room <= 1e-9 else left[s]
            sent[s], deficit[s] = n, max(0.0, deficit[s] - n)
            left[s] -= n
        out.append(sent)
    return out


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 5.0, "b": 1.0, "c": 30.0}])
def test_targets_against_a_plain_round_robin(spark, weights):
    counts = {"a": 2600, "b": 900, "c": 333}
    rows = [(i, "word " * (i % 37), s) for s, n in counts.items() for i in range(n)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6), PATH, window=1024, targets=weights).toPandas()
    sizes = got.groupby("source")["length"].sum().to_dict()
    want = _round_robin(sizes, weights or sizes, 1024)
    full = got[got.sequence_length == 1024]
    mixed = full.groupby(["sequence_id", "source"])["length"].sum().unstack(fill_value=0)
    assert len(mixed) == sum(sizes.values()) // 1024
    for r in range(len(mixed)):
        for s in sizes:
            assert abs(mixed.loc[r, s] - want[r][s]) <= 40, (r, s)


def test_many_small_sources_take_turns(spark):
    rows = [(i, "word " * 20, f"s{i % 150}") for i in range(6000)] + [(i, "word " * 200, "big") for i in range(600)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), PATH).toPandas()
    share = got.groupby("source")["length"].sum() / got["length"].sum()
    mixed = got[got.sequence_length == 4096].groupby(["sequence_id", "source"])["length"].sum().unstack(fill_value=0) / 4096
    assert (mixed - share).abs().max().max() <= 0.1 and (mixed.drop(columns="big") - share.drop("big")).abs().max().max() <= 0.02
    assert got["length"].median() >= 16


def test_targets_name_every_source(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "a", None)], "doc_id long, text string, source string")
    for bad in ({"x": 1.0}, {"x": 1.0, None: 0.0}):
        with pytest.raises(ValueError):
            pack(df, PATH, targets=bad)
    assert pack(df, PATH, targets={"x": 1.0, None: 2.0, "unused": 5.0}).agg(F.sum("length")).first()[0] == 5


def test_tasks_follow_the_tokens_and_keep_no_tokenizer(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 97}" for k in range(50)), f"s{i % 3}") for i in range(400)], "doc_id long, text string, source string")
    monkeypatch.setattr(packing, "TASK_TOKENS", 500)
    out = pack(docs, PATH)
    total = out.agg(F.sum("length")).first()[0]
    assert out.select(F.spark_partition_id()).distinct().count() >= total // 500 // 2
    Subwords.of(PATH)
    list(packing._cut(iter([])))
    assert not Subwords._open
