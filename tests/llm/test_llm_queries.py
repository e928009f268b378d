"""Queries with SQL against DuckDB, and every query and stage on tables with nulls, repeats and clashing columns."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from trawlix.llm import common, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
#: Names that the operators use inside or add.
NAMES = """_id _hash _row _key _order _range _tie _n _salt _pick _learn _calibrate _source _shuffled _through _at root fp text_hash component_id fingerprint size source_size
target taken score held_out lang_pred ambiguous spans items n_words stats x y host path rule verdict key n rank cell walk depth status copies position json content _block _allow _number _part _group _on bucket asks cells g ids held""".split()


def normal(frame):
    columns = sorted(frame.columns)
    text = lambda v: "null" if pd.isna(v) else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)), columns


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    assert normal(queries.QUERIES[name](spark, SF).toPandas()) == normal(db.execute(queries.ORACLE_SQL[name]).df())


def test_rules_of_the_url_query():
    wanted = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert ", ".join(f"{action} {host}{path}" for host, path, action in queries.URL_RULES) == wanted


def worn(df):
    """The table with a null in a third of its rows, repeated rows, rows of nulls, and columns of clashing names."""
    columns = df.columns
    at = F.pmod(F.xxhash64(*columns), F.lit(3 * len(columns)))
    holed = df.select(*[F.when(at == i, F.lit(None)).otherwise(F.col(c)).alias(c) for i, c in enumerate(columns)])
    nulls = df.limit(2).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns])
    return holed.unionByName(holed.limit(10)).unionByName(nulls).withColumns({c: F.lit(1) for c in NAMES if c not in columns})


@pytest.fixture(params=["worn", "empty"])
def tables(request, monkeypatch):
    change = worn if request.param == "worn" else lambda df: worn(df).limit(0)
    changed = lambda spark, sf_dir, name: change(common.table(spark, sf_dir, name))
    monkeypatch.setattr(queries, "table", changed)
    monkeypatch.setattr(pipe, "table", changed)
    return changed


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_worn_and_empty_tables(spark, tables, name):
    whole = {"op2_url_filter": "pages", "op8_main_text": "pages"}.get(name, "documents")
    got = queries.QUERIES[name](spark, SF).count()
    if name not in ("op4_nearest", "op9_tool_calls"):
        assert got == tables(spark, SF, whole).count()


def test_stages_on_worn_and_empty_tables(spark, tables):
    docs = tables(spark, SF, "documents")
    n = docs.count()
    for _, stage in pipe.STAGES:
        assert stage(spark, docs, SF).count() <= n
