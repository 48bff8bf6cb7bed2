"""Vector searches, URL filters, quotation linking and the pipeline on small fixtures."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ember.llm import bloom_cascade, nn_descent, pivot_index, quotes
from ember.llm.queries import LISTED, RULES

VECTORS = "vec_id bigint, embedding array<float>, id string, cell int, v int"


def vectors(spark, n=700, size=12):
    """Unit vectors with a large group of near copies, exact ties, and rows that take no part."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, size))
    x[100:300] = x[100] + rng.normal(size=(200, size)) * 0.02
    x[300:330] = x[300]
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    rows = [(i, [float(v) for v in row], "c", 1, 2) for i, row in enumerate(x)]
    odd = [(n, None), (n + 1, [float("nan")] * size), (n + 2, [float("inf")] * size), (n + 3, [None] * size), (n + 4, [0.0] * size), (n + 5, []), (n + 6, [1.0]), (None, [0.5] * size)]
    return spark.createDataFrame(rows + [(*o, "c", 1, 2) for o in odd], VECTORS), x.astype(np.float64)


@pytest.mark.parametrize("shape", [(32, 8), (3, 2)])
def test_pivot_index_is_exact(spark, shape):
    df, x = vectors(spark)
    zero = len(x) + 4  # the zero vector may score
    whole = np.vstack([np.floor(256 * x), np.zeros((1, x.shape[1]))]).astype(np.int64)
    ids = np.append(np.arange(len(x)), zero)
    got = collections.defaultdict(list)
    for r in pivot_index.top_inner_products(df, F.col("vec_id") % 50 == 0, 5, pivots=shape[0], rings=shape[1]).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ids if i % 50 == 0}
    for q, found in got.items():
        score = whole @ whole[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:5]
        assert sorted(found) == [(k + 1, ids[i], score[i]) for k, i in enumerate(order)]


def test_pivot_index_edges(spark):
    df, _ = vectors(spark)
    assert pivot_index.top_inner_products(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    two = df.where("vec_id in (0, 1)")
    assert [(r.query_id, r.rank, r.vec_id) for r in pivot_index.top_inner_products(two, F.col("vec_id") == 0, 5).collect()] == [(0, 1, 1)]
    huge = spark.createDataFrame([(0, [1e7, 3.0]), (1, [2e6, 1.0]), (2, [-1e6, 0.5])], "vec_id bigint, embedding array<double>")
    got = [(r.vec_id, r.score) for r in pivot_index.top_inner_products(huge, F.col("vec_id") == 1, 2).orderBy("rank").collect()]
    w = np.floor(256 * np.array([[1e7, 3.0], [2e6, 1.0], [-1e6, 0.5]])).astype(np.int64)
    assert got == [(0, int(w[0] @ w[1])), (2, int(w[2] @ w[1]))]


def test_nn_descent_recall(spark):
    df, x = vectors(spark, 1500)
    hits = []
    for q, rows in _grouped(nn_descent.nearest(df, F.col("vec_id") % 25 == 0, 10, degree=12, rounds=4, beam=120)).items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        assert [r.rank for r in rows] == list(range(1, 11))
        assert all(r.score == pytest.approx(d[r.vec_id], abs=1e-12) for r in rows)
        hits.append(np.mean([d[r.vec_id] <= d[order[-1]] + 1e-12 for r in rows]))
    assert len(hits) == 60 and np.mean(hits) >= 0.95


def _grouped(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append(r)
    return out


def test_nn_descent_edges(spark):
    df, x = vectors(spark)
    assert nn_descent.nearest(df.limit(0), F.col("vec_id") == 0, 10).count() == 0
    few = df.where("vec_id < 4")
    rows = nn_descent.nearest(few.unionByName(few), F.col("vec_id") == 0, 10).orderBy("rank").collect()
    assert sorted(r.vec_id for r in rows) == [1, 2, 3]


def test_nn_descent_gives_every_query_its_rows(spark):
    """Opposite vectors never share a cell; an outlier among crowded clusters may share none."""
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [-1.0, -2.0])], "vec_id bigint, embedding array<double>")
    assert sorted((r.query_id, r.vec_id) for r in nn_descent.nearest(two, F.col("vec_id") > 0, 10).collect()) == [(1, 2), (2, 1)]
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(size=(1, 12)) + rng.normal(size=(600, 12)) * 0.01, rng.normal(size=(40, 12)) * 9])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = _grouped(nn_descent.nearest(df, F.col("vec_id") >= 600, 10))
    assert len(got) == 40 and all([r.rank for r in rows] == list(range(1, 11)) for rows in got.values())


def test_scan_is_exact(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 5))
    nodes = nn_descent._packed(spark.createDataFrame([(i, True, r.tolist()) for i, r in enumerate(x)], "id bigint, is_query boolean, v array<double>"), "<f8", 1, 5)
    found = collections.defaultdict(list)
    for r in nn_descent._scan(nodes.where("id < 5").select(F.col("id").alias("q")), nodes, "<f8", 300, 10).orderBy("q", "d").collect():
        found[r.q].append(r.v)
    for q in range(5):
        d = ((x - x[q]) ** 2).sum(axis=1)
        assert found[q] == [i for i in np.argsort(d) if i != q][:10]


def test_nn_descent_of_near_and_equal_copies(spark):
    """Copies closer than 1/127 of a component, and many equal ones: the true ten, ties by id."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(3000, 12))
    x[:1000] = x[0] + rng.normal(size=(1000, 12)) * 1e-5
    x[1000:1400] = x[1000]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    hits = []
    for q, rows in _grouped(nn_descent.nearest(df, F.col("vec_id") % 50 == 0, 10)).items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        if 1000 <= q < 1400:
            assert [r.vec_id for r in rows] == order
        hits.append(len({r.vec_id for r in rows} & set(order)) / 10)
    assert len(hits) == 60 and np.mean(hits) > 0.98


def test_url_rules_and_cascade(spark):
    urls = [
        "https://a.example.com/en/1", "http://WWW.Example.com/en/x?q", "https://www.example.com/de/", "http://x.net/es/1#t", "http://x.net/fr", "http://x.net/fr/9", None, "no scheme",
        "ftp://free-bets.org?x", "http://m.casino-win.org/en", "http://casino-win.org.uk/", "http://com/", "http://com", "http://notexample.com/en/", "//x", "http://", "http://a.net?u=http://b.net/es/",
    ]
    pages = spark.createDataFrame([(i, u, "h", "k", True) for i, u in enumerate(urls)], "page_id bigint, url string, host string, key string, listed boolean")
    listed = F.col("key").rlike(r"(^|\.)(" + "|".join(LISTED) + r")\.")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in bloom_cascade.filter_urls(pages, RULES, listed).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("www.example.com", "/de/", "com/", "allow")
    assert got[3] == ("x.net", "/es/1", "net/es/", "block")
    assert got[4] == ("x.net", "/fr", None, "allow")
    assert got[5] == ("x.net", "/fr/9", "net/fr/", "block")
    assert got[6] == got[7] == got[14] == ("", "", None, "allow")
    assert got[8] == ("free-bets.org", "", None, "block")
    assert got[9] == ("m.casino-win.org", "/en", None, "block")
    assert got[10] == ("casino-win.org.uk", "/", None, "block")
    assert got[11] == ("com", "/", "com/", "allow") and got[12] == ("com", "", None, "allow")
    assert got[13][2] == "com/" and got[15] == ("", "", None, "allow") and got[16] == ("a.net", "", None, "allow")
    assert bloom_cascade.filter_urls(pages.limit(0), RULES, listed).count() == 0


@pytest.mark.parametrize("share,most", [(0.02, 64 << 20), (0.5, 64 << 20), (0.0, 64 << 20), (1.0, 64 << 20), (0.3, 100)])
def test_cascade_is_exact_on_its_universe(spark, share, most):
    keys = spark.range(4000).select(F.concat(F.lit("host"), F.col("id")).alias("key"), (F.pmod(F.hash("id"), F.lit(1000)) < share * 1000).alias("listed"))
    universe = keys.unionByName(spark.createDataFrame([(None, False)], "key string, listed boolean"))
    cascade = bloom_cascade.build_cascade(universe, rate=0.2, max_bytes=most)
    assert (cascade is None) == (most == 100)
    rows = bloom_cascade.is_listed(universe, "key", universe, cascade, "found").collect()
    assert len(rows) == 4001 and all(r.found == r.listed for r in rows)
    if cascade is not None and 0 < share < 1:
        assert len(cascade.levels) > 1


def test_quote_levels_and_links(spark):
    rows = [
        ("a", 1, "Shall we meet on Monday?\nBring the plans."),
        ("b", 2, "> Shall we meet  on monday?\n> Bring the plans.\nYes, at nine in the hall."),
        ("c", 3, "I cannot.\n> > Shall we meet on Monday?\n> > Bring the plans.\n> Yes, at nine in the hall."),
        ("d", 4, "> a line nobody ever wrote\nhello"),
        ("e", 5, None),
        ("f", 6, ""),
        ("g", 7, "> Shall we meet on Monday?"),
        ("h", 0, "> Yes, at nine in the hall.\nsent before its source"),
        ("i", 8, ">>> \n> \nonly marks"),
        (None, 9, "no id"),
        ("b", 99, "repeated id"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "msg_id string, position bigint, text string, hash string, level int")
    got = {r.msg_id: r for r in quotes.thread(quotes.link_quotations(df)).collect()}
    assert set(got) == set("abcdefghi")
    assert got["b"].own_text == "Yes, at nine in the hall." and got["b"].parent_id == "a"
    assert (got["c"].parent_id, got["c"].quote_levels, got["c"].n_quotes, got["c"].n_linked) == ("b", 2, 2, 2)
    assert got["c"].own_text == "I cannot."
    assert got["d"].parent_id is None and got["d"].n_quotes == 1 and got["d"].own_text == "hello"
    assert got["g"].parent_id == "a"  # one line of a longer message
    assert got["h"].parent_id is None and got["i"].own_text == "only marks"
    assert [(got[m].root_id, got[m].depth, got[m].reply_order) for m in "abgc"] == [("a", 0, 1), ("a", 1, 2), ("a", 1, 3), ("a", 2, 4)]
    assert got["e"].own_text == "" and got["f"].own_text == ""
    assert quotes.thread(quotes.link_quotations(df.limit(0))).count() == 0


def test_long_reply_chain(spark):
    texts = [f"message number {i} says something" for i in range(130)]
    rows = [(f"m{i:03}", i, texts[i] + (f"\n> {texts[i - 1]}" if i else "")) for i in range(130)]
    got = quotes.thread(quotes.link_quotations(spark.createDataFrame(rows, "msg_id string, position bigint, text string"))).collect()
    assert all(r.root_id == "m000" and r.depth == r.position and r.reply_order == r.position + 1 for r in got)


def test_repeated_and_null_turns(spark):
    rows = [(1, 0, "first words of all"), (1, 0, "first words of all"), (1, 1, "second words here"), (None, 0, "x"), (2, None, "y")]
    mail = quotes.as_mail(spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string"))
    got = {r.msg_id: r.parent_id for r in quotes.link_quotations(mail, group="conv_id").collect()}
    assert got == {"1-0": None, "1-1": "1-0"}


def test_pipeline_stages(spark):
    """Every stage on the smallest tables, against plain restatements of what it decides."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "mix", "encode"]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    kept = corpus_pipeline.quality(spark, docs, d)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert np.mean([i in ids for i in clean]) > 0.95
    assert not any(i in ids for i, r in labels.items() if r.toxic == 1)
    once = corpus_pipeline.near_dedup(spark, docs, d)
    from test_text_operators import classes_by_hand

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = classes_by_hand(rows)
    assert sorted(r.doc_id for r in once.collect()) == sorted({want[i] for i in range(len(rows))})
    assert corpus_pipeline.mix(spark, once, d).columns == docs.columns
    assert corpus_pipeline.run(spark, d).columns == ["doc_id", "n_tokens", "ids"]


def test_entry_registers_the_eleven(spark):
    import __spark_entry__ as entry

    found = [q for q in entry.queries() if q.startswith("op") and q[2].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in found) == list(range(1, 11))
    assert "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_short_turns_are_linked_inside_their_conversation(spark):
    """Two characters name an original in its own conversation, not in any other."""
    turns = [(1, 1, "Shall we meet at noon by the gate?"), (1, 2, "Yes."), (1, 3, "Then bring the maps."), (2, 1, "Yes."), (2, 2, "Good, see you there."), (2, 3, "")]
    mail = quotes.as_mail(spark.createDataFrame(turns, "conv_id bigint, turn int, text string"))
    got = {r.msg_id: r for r in quotes.thread(quotes.link_quotations(mail, group="conv_id")).collect()}
    assert [got[m].parent_id for m in ("1-1", "1-2", "1-3", "2-1", "2-2", "2-3")] == [None, "1-1", "1-2", None, "2-1", "2-2"]
    assert got["1-3"].n_quotes == got["1-3"].n_linked == 2 and got["2-2"].root_id == "2-1"
    free = {r.msg_id: r for r in quotes.link_quotations(mail.drop("conv_id")).collect()}
    assert free["2-2"].parent_id is None and free["1-2"].parent_id == "1-1"
