"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from trawlix.operators import extract
from trawlix.plans import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def normal(frame):
    columns = sorted(frame.columns)
    text = lambda v: "null" if pd.isna(v) else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)), columns


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, db, name):
    got = core.QUERIES[name](spark, SF).toPandas()
    if name in core.ORACLE_SQL:
        assert normal(got) == normal(db.execute(core.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_extraction_stats_on_odd_pages(spark, tmp_path):
    """Pages at the threshold by their markup, and broken ones: each page's count, and so the sum, is the SQL's."""
    words, n = "w" * 49, 1_000_000
    pages = [
        f"<article><h1>{words}</h1><p><b>{words}<br></article>", f"<article>{words}</h1>\n{words}</article>", "<article>" + "&amp;" * 21 + "</article>", "<article><script>" + "x" * 101 + "</script></article>",
        "<div>" + "x" * 200 + "</div>", "<ARTICLE>" + "x" * 200 + "</ARTICLE>", "<article>" + "x" * 200, "<articles a='>" + "x" * 101 + "</article>", f"<article>{words}</article>{words}<article>x</article>",
        "<article>" + "x" * 100 + "<b</article>", "<article>" + "x" * 100 + "\u00a0\u3000</article>", "<article>" + "x" * 100 + "\n</article>", "<article>" + "\U0001f600" * 51 + "</article>", None, "",
        "<article>" + "<" * n + "</article>", "<article>" * (n // 9), "<article>x" + "<p>" * (n // 3) + "x</article>",
    ]
    pd.DataFrame({"page_id": range(len(pages)), "url": "u", "html": pages}).to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    good = []
    for i in range(len(pages)):
        con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet') WHERE page_id = {i}")
        good += [i] if con.execute(core.ORACLE_SQL["extraction_stats"]).fetchone()[1] else []
    assert {0, 2, 3, 7} <= set(good) and not {1, 4, 5, 6, 10, 12, 13, 14, 16} & set(good)
    elements = extract.article_elements(spark.read.parquet(f"{tmp_path}/pages.parquet"), ["page_id"])
    assert sorted(r.page_id for r in extract.succeeded(elements).select("page_id").collect()) == good
    assert tuple(core.QUERIES["extraction_stats"](spark, str(tmp_path)).first()) == (len(pages), len(good), len(pages) - len(good))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
