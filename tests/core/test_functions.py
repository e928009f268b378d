import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trawlix.functions import ids, simhash64, urls

#: URLs and the keys they have.
KEYS = {
    "http://Ex.org": "http://ex.org/", "HTTP://ex.org:80/a//": "http://ex.org/a/", "https://ex.org:443/a/#x": "https://ex.org/a", "https://ex.org:8443/A/": "https://ex.org:8443/A", "http://ex.org/?": "http://ex.org/",
    "http://ex.org/p?b=2&a=1&a=0": "http://ex.org/p?a=1&a=0&b=2", "http://ex.org/p?b&a": "http://ex.org/p?a=&b=", "http://ex.org/p?q=a%20b": "http://ex.org/p?q=a+b", "mailto:a@b.c": "mailto:a@b.c", "not a url": "not a url", "": "",
}
DOMAINS = {"https://WWW.Ex.org:81/a": "www.ex.org", "http://u:p@ex.org/": "ex.org", "mailto:a@b.c": "", "no url": "no url", "ftp://f.org": "f.org"}
SLUGS = {"https://tokio.rs/a-b?x=1": "https_tokio_rs_a_b_x_1", "日本語": "_", "A" * 99: "a" * 60, "": ""}


def values(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("v")).collect()
    return {texts[r.i]: r.v for r in rows}


def test_url_keys(spark):
    assert values(spark, list(KEYS), urls.normalize_url) == KEYS
    # One slash goes at a time, so a key that ends in one is no fixed point; the others are.
    fixed = [k for k in KEYS.values() if not k.endswith("a/")]
    assert values(spark, fixed, urls.normalize_url) == {k: k for k in fixed}
    assert values(spark, [None], urls.normalize_url) == {None: None}


def test_domains_and_slugs(spark):
    assert values(spark, list(DOMAINS), urls.extract_domain) == DOMAINS
    assert values(spark, list(SLUGS), ids.slug) == SLUGS
    assert values(spark, ["Some Query!"], lambda c: ids.node_id("query", c)) == {"Some Query!": "q:some_query_"}


def plain_hash(token):
    h = 0
    units = np.frombuffer(token.encode("utf-16-le", "surrogatepass"), np.uint16)
    for u in units.tolist():
        h = (h * 31 + u) % 2**64
    return h


def plain_simhash(text):
    tokens, word = [], ""
    for c in text.lower() + " ":
        if c in simhash64.SPACES:
            if len(word.encode("utf-16-le", "surrogatepass")) > 2:
                tokens.append(word)
            word = ""
        else:
            word += c
    return sum(1 << i for i in range(64) if sum(1 if plain_hash(t) >> i & 1 else -1 for t in tokens) > 0) if tokens else 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB cé\t 　日😀ßx\n")), max_size=80))
def test_simhash_matches_its_definition(text):
    assert np.int64(simhash64.simhash_text(text)).view(np.uint64) == plain_simhash(text)


def test_simhash_in_spark(spark):
    texts = ["", "a b c", "one two three", "One  two three", "w" * 5000]
    got = values(spark, texts, lambda c: simhash64.simhash(c))
    assert got[""] == got["a b c"] == 0 and got["one two three"] == got["One  two three"] and got["w" * 5000] == simhash64.simhash_text("w" * 5000)
    assert values(spark, ["One a two  b3"], simhash64.tokens) == {"One a two  b3": ["one", "two", "b3"]}
    row = spark.range(1).select(simhash64.similarity(F.lit(-1), F.lit(0)).alias("a"), simhash64.is_duplicate(F.lit(0), F.lit(511)).alias("b"), simhash64.is_duplicate(F.lit(0), F.lit(1023)).alias("c")).first()
    assert (row.a, row.b, row.c) == (0.0, True, False)


@pytest.mark.parametrize("n", [1, 7])
def test_positions(spark, n):
    from trawlix.operators.ordering import with_positions

    rows = [(i % 3, "hot" if i % 2 else "x", i) for i in range(100)]
    got = with_positions(spark.createDataFrame(rows, "a int, b string, c int").repartition(n), [F.col("b"), F.col("c")]).collect()
    assert [(r.b, r.c) for r in sorted(got, key=lambda r: r.pos)] == sorted((b, c) for _, b, c in rows) and sorted(r.pos for r in got) == list(range(100))


@pytest.mark.parametrize("n", [1, 3, 9])
def test_positions_in_groups_over_ranges(spark, n):
    from trawlix.operators.ordering import with_positions

    rows = [(None if i % 7 == 3 else ("big" if i % 3 else f"g{i % 5}"), (i * 37) % 101) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(n)
    got = with_positions(df, [F.col("v")], group=[F.col("g")]).collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine = sorted((r.pos, r.v) for r in got if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(r[1] for r in rows if r[0] == g)


def test_spent_checkpoints_go(spark):
    from trawlix.operators.ordering import cut

    where = lambda df: df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    first = cut(spark.range(10))
    assert os.path.isdir(where(first))
    second = cut(first.where("id > 3"), spent=first)
    assert not os.path.exists(where(first)) and second.count() == 6


def test_a_join_whose_keys_are_split(spark):
    from trawlix.operators.ordering import split_join

    rows = spark.createDataFrame([(i % 3, i) for i in range(50)], "k int, v int")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k int, s string")
    got = split_join(rows, small, ["k"], "left", F.col("v")).collect()
    assert sorted((r.v, r.s) for r in got) == [(i, {0: "a", 1: "b"}.get(i % 3)) for i in range(50)]
