"""Queries over sources against their SQL on texts that the given tables do not hold."""

from __future__ import annotations

import duckdb
import pytest

from lodestar import catalog
from tests.test_oracles import rows_of

TEXTS = ["", "  ", "\n\t", " a  b ", "a\vb\fc", "a & b", "x" * 400, "w " * 200]


@pytest.mark.parametrize("name", ["src_atom_feed", "src_channel_html"])
def test_odd_texts(spark, tmp_path, name):
    rows = [(i, TEXTS[i % len(TEXTS)], "en", "web", 0) for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    rel = duckdb.connect().execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'").sql(catalog.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())
