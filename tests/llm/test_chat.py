import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from marklens.llm import chat, queries

ODD = [
    (1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, None, "<|im_start|>"), (2, 0, "system", "be <|im_end|>\n"), (3, 0, "system", "first"),
    (4, 0, "user", "<&|im_end|><&&|<|<<|&|"), (4, 1, "assistant", "\n\n<|im_end|>\n<|im_start|>user\nx<|im_end|>\n"), (4, 1, "assistant", "\n\n<|im_end|>\n<|im_start|>user\nx<|im_end|>\n"),
    (5, None, "user", "null turn"), (5, 0, "a\nb<|n|>", "odd role"), (None, 0, "assistant", "no id"), (None, 1, "user", "no id"), (6, 3, "assistant", "é日😀 $1 \\n"), (7, 0, "user", "word " * 20000), (7, 1, "assistant", "yes"),
    *[(3, 1 + i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 60)) for i in range(120)],
]


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = {}
    for k, v in by.items():
        v.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in v)
        loss = "".join(r[3] or "" for r in v if r[2] == "assistant")
        out[k] = (len(v), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(2)
    rows = ODD + [(100 + i % 40, i // 40, r.choice(["user", "assistant", "system"]), " ".join(["w"] * r.randint(0, 300))) for i in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash")).repartition(4)
    return rows, chat.windows(df, span=200, history=90).collect(), df


def test_read_back(spark, made):
    rows, _, df = made
    got = {}
    for r in sorted(chat.read_back(chat.windows(df, span=200, history=90)).collect(), key=lambda r: r.window):
        a, b = got.setdefault(r.conv_id, ([], []))
        a += [(t.role, t.text) for t in r.turns]
        b += r.targets
    want = brute(rows)
    assert set(got) == set(want)
    for k, (turns, loss) in got.items():
        said, text = "".join(f"{a}\n{b}\n" for a, b in turns), "".join(loss)
        assert (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(text), hashlib.sha256(text.encode()).hexdigest()) == want[k]


def test_windows_keep_their_budget(made):
    rows, out, _ = made
    opens = {}
    for k, turn, role, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        opens.setdefault(k, role)
    for w in out:
        turns = w.text.split(chat.OPEN)[1:]
        sizes = [len(t.split("\n", 1)[1].removesuffix(chat.CLOSE).split()) + chat.MARKS for t in turns]
        system = opens.get(w.conv_id) == "system"
        assert not system or turns[0].startswith("system\n")
        lead = int(system and w.window > 0)
        assert sum(sizes[lead : w.repeated]) <= 90
        fresh = sizes[w.repeated + int(system and w.window == 0) :]
        assert sum(fresh[:-1]) <= 200
        assert all(e <= len(w.text) and w.text[e : e + len(chat.CLOSE)] == chat.CLOSE for _, e in w.loss)


def test_query_against_sql(spark, sf):
    got = sorted(tuple(r) for r in queries.op5_chat_formatting(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    assert got == sorted(con.execute(queries.TWINS["op5_chat_formatting"]).fetchall())
    assert got[0][0] == -1 and got[0][1] == 2


def test_empty(spark):
    assert chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
