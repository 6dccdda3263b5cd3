"""Registered queries against their DuckDB SQL on whole tables."""

from pathlib import Path

import duckdb
import pytest

from framemill.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_ngram_jaccard", "op7_curriculum_mix", "op9_decontaminate"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    got, want = QUERIES[name](spark, SF), con.execute(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got.toPandas(), want))
    assert len(a) == len(b)
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
    kinds = {c: str(t) for c, t in zip(want.columns, want.dtypes)}
    assert all(kinds[c] == str(a[c].dtype) for c in cols)


def test_sql_of_odd_rows(spark, tmp_path):
    """Null, empty, short and repeated texts, equal items and one without words."""
    texts = [None, "", " .. ", "one", "one two", "One TWO", *["a b c d e f g h i j k l m n"] * 2, "x a b c d e f g h i j k l m n y", "é𝄞 é𝄞 z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = [("p", "a b c d e f g h i j k l m n o"), ("q", "A b, c d e f g h i j k l m"), ("r", "é𝄞"), ("s", "--"), ("t", None), ("u", "é𝄞")]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("op2_ngram_jaccard", "op9_decontaminate"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(SQL[name])
        at = [[d[0] for d in want.description].index(c) for c in got.columns]
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
