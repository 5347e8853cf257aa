"""Queries over texts against their SQL twins where some texts are blank or missing."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_point
from check import rows_of

DOCS = [
    (0, "One  two.\tThree", "en"), (1, "", "en"), (2, " \n\t ", "de"), (3, None, "de"), (4, "é " * 300, "fr"), (5, "", "es"), (6, "  a  ", "de"),
]


@pytest.mark.parametrize("name", ["c3_clean_text", "c7_non_ascii", "d23_truncation_audit"])
def test_blank_texts(spark, tmp_path, name):
    rows = [(i, t, lang, "src0", len(t or "")) for i, t, lang in DOCS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = entry_point.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())
