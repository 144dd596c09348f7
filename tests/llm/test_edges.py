"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: every operator and every stage."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from trailgraph.llm import decontaminate, html_text, mixing, near_copies, quality, search, sharding, simhash, token_counts, url_filter

from ..conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, in both cases of letters.
CLASHES = ("_k", "_key", "_least", "_i", "_score", "_s", "_goal", "_row", "_copies", "_copy", "_need", "_cut", "_whole", "_best", "_place", "_Hash", "size", "shard", "slot", "term", "fp", "findings", "a b.c`d")


def clashing(df):
    for name in CLASHES:
        df = df.withColumn(name, F.lit(name))
    return df


def table(spark):
    """Rows with nulls in each column, empty and long texts, ties, repeated rows."""
    prose = "The river rose in spring and the fields by the mill stood under water for a week. "
    rows = [(i, f"{prose * 3}Number {i} of the set says more than {i * 7} words.", "en", "a", 1) for i in range(40)]
    rows += [(None, "A text without an id that stands for itself, as some do.", "en", "a", 1), (50, None, None, None, None), (51, "", "en", None, 0), (52, " \n\t", "en", "b", 3), (53, "long " * 60_000, "en", "b", 300_000)]
    rows += [(7, rows[7][1], "en", "a", 1)] * 3 + [(None, None, None, None, None)] * 2 + [(8, "Another text under an id that is there already.", "fr", "b", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return corpus_pipeline.STAGES


def test_every_stage_says_what_it_does(stages):
    assert [n for n, _ in stages] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    assert all("Defined cases" in f.__doc__ for _, f in stages)


@pytest.mark.parametrize("place", range(5))
def test_stages(spark, stages, place):
    name, stage = stages[place]
    plain = table(spark)
    own = stage(spark, plain, SMALL)
    base = [c for c in own.columns if c in plain.columns]
    assert base == plain.columns and (own.columns == plain.columns or place == 4)
    got = sorted(map(repr, own.select(*plain.columns).collect()))
    rows = Counter(map(repr, plain.collect()))
    assert set(got) <= set(rows)
    wide = stage(spark, clashing(plain), SMALL)
    assert sorted(map(repr, wide.select(*plain.columns).collect())) == got
    kept = [c for c in CLASHES if place < 4 or c != "shard"]
    assert wide.select(*(F.col("`" + c.replace("`", "``") + "`") for c in kept)).distinct().collect() == ([tuple(kept)] if got else [])
    empty = stage(spark, plain.limit(0), SMALL)
    assert empty.columns == own.columns and empty.count() == 0
    if name in ("quality", "decontamination"):
        assert all(n == rows[r] for r, n in Counter(got).items())  # repeated rows share their fate
    if name == "near_dedup":
        assert len(got) == len(set(got))
    if name == "sharding":
        assert Counter(got) == rows and {r.shard for r in own.collect()} <= set(range(24))


def test_operators_with_clashing_columns(spark):
    wide = clashing(table(spark))
    items = spark.createDataFrame([(1, "the fields by the mill stood under water for a week")], "item_id long, text string")
    n = wide.count()
    assert decontaminate.scan(wide, items).count() == n
    assert simhash.components(wide).count() == n
    assert mixing.plan(wide).count() == n
    assert sharding.assign(wide)[0].count() == n
    assert quality.score(wide, quality.train(wide, spark.createDataFrame([], "doc_id long, quality int"))).count() == n
    assert simhash.keep_one(wide).columns == near_copies.keep_one(wide).columns == wide.columns
    pages = wide.select(F.col("doc_id").alias("page_id"), F.lit("http://a.net/x").alias("url"), F.col("text").alias("html"), *(F.col("`" + c.replace("`", "``") + "`") for c in CLASHES))
    assert html_text.extract(pages).count() == url_filter.judge(pages).count() == n
    assert search.top_k(wide, wide.select(F.col("doc_id").alias("query_id"), "text", "size")).where("query_id is null").count() == 0


# ---------------------------------------------------------------- single operators


def test_mixing_spreads_rows_without_ids(spark):
    """One source of many rows with null ids, equal or not in text, still comes to its target."""
    for text in (F.lit("w w w w w"), F.concat(F.lit("w w w w "), F.col("id").cast("string"))):
        hot = spark.range(0, 1000, 1, 5).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"), F.lit("b").alias("source"))
        other = spark.range(0, 400, 1, 3).select(F.col("id").alias("doc_id"), F.lit("x x x x x").alias("text"), F.lit("a").alias("source"))
        both = hot.unionByName(other).withColumns({"lang": F.lit("en"), "n_chars": F.lit(1)})
        planned = mixing.plan(both).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
        assert {r.source for r in planned} == {"a", "b"} and all(abs(r.target - r.taken) <= 5 for r in planned)
        mixed = {r.source: r["count"] * 5 for r in mixing.mix(both).groupBy("source").count().collect()}
        assert mixed == {r.source: r.taken for r in planned}


def test_mixing_many_sources(spark):
    """Sources as numerous as domains, many of them clamped."""
    rows = [(i, "w " * (1 + i * i % 97), f"s{i % 300:03d}") for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from .test_corpus_ops import slow_targets

    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target = slow_targets(sizes)
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(target)
    assert mixing.plan(frame).count() == 900


def test_sharding_spreads_repeated_rows(spark):
    """One id on half of the rows, under different texts and under one and the same."""
    for text in (F.concat(F.lit("x " * 100), F.col("id").cast("string")), F.lit("x " * 100)):
        hot = spark.range(0, 3000, 1, 4).select(F.lit(1).cast("long").alias("doc_id"), text.alias("text"))
        both = hot.unionByName(spark.range(10, 3010).select(F.col("id").alias("doc_id"), F.concat(F.lit("y " * 100), F.col("id").cast("string")).alias("text")))
        placed = sharding.assign(both)[0].toPandas()
        loads = placed.groupby("shard")["size"].sum()
        assert len(loads) == 24 and loads.max() - loads.min() <= 0.03 * loads.mean()
        assert all(sorted(own.slot) == list(range(len(own))) for _, own in placed.groupby("shard"))
        attached = sharding.attach(both).groupBy("shard").agg(F.sum(F.octet_length("text") + 8)).collect()
        assert sorted(r[1] for r in attached) == pytest.approx(sorted(loads.tolist()), rel=0.03)


def test_sharding_edits_a_stored_map(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("z"), (F.col("id") % 90).cast("int")).alias("text"))
    path = f"{tmp_path}/maps"
    first, one = sharding.assign(docs, 8, path=path)
    again, same = sharding.assign(docs, 8, path=path)
    assert one == same and one.version == 1
    grown, two = sharding.assign(docs, 9, path=path)
    assert two.version == 2 and sharding.load_map(spark, path) == two
    moved = first.select("doc_id", F.col("shard").alias("old")).join(grown, "doc_id").where("old <> shard")
    assert moved.where("shard <> 8").count() == 0 and 0 < moved.count() < 4000 / 9 * 1.3


def test_search_repeated_and_null_ids(spark):
    rows = [(1, "apple pear plum"), (1, "apple pear plum"), (None, "apple apple"), (2, "pear"), (3, None), (4, ""), (5, "plum " * 20_000)]
    rows += [(i, " ".join(f"common{j}" for j in range(i % 9)) + " filler") for i in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = spark.createDataFrame([(9, "apple pear"), (8, "common1 common2 pear pear")], "query_id long, text string")
    twice = spark.createDataFrame([(9, "apple"), (9, "pear"), (8, "common1 pear"), (8, "common2 pear"), (None, "apple"), (7, None)], "query_id long, text string")
    want = sorted(map(tuple, search.top_k(docs, once, 5).collect()))
    for size, queries in ((1 << 25, 1 << 25), (300, 1 << 25), (300, 1)):
        assert sorted(map(tuple, search.top_k(docs, twice, 5, size, queries).collect())) == want
    assert [r.doc_id for r in search.top_k(docs, once, 5).where("query_id = 9").orderBy("rank").collect()][:2] == [1, 1]


def test_decontaminate_long_items(spark, monkeypatch):
    """Items in parts, passes that are released, nothing lost at the seams."""
    from .test_text_ops import brute

    monkeypatch.setattr(decontaminate, "BLOCKS_PER_PASS", 2)
    own = [f"w{i}" for i in range(200)]
    items = [("1", " ".join(own)), ("2", "a b c"), ("3", " ".join(own[50:61]))]
    assert [len(p.split()) for p in decontaminate.parts(items[0][1], 10, 64)] == [73, 73, 72]  # the last 8 words are in the third part already
    texts = [" ".join(own[i : i + 12]) for i in range(0, 190, 7)] + ["x " + items[0][1] + " y", "a b c", None]
    parts = decontaminate.parts
    monkeypatch.setattr(decontaminate, "parts", lambda text, window, n=0: parts(text, window, 16))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(int(i), t) for i, t in items], "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.scan(frame, benchmark, block_bytes=40).collect()}
    assert got == {i: brute(t, items) for i, t in enumerate(texts)}
    assert sorted(r.doc_id for r in decontaminate.clean(frame, benchmark, block_bytes=40).collect()) == sorted(i for i, t in enumerate(texts) if not brute(t, items)[4])


def test_quality_learns_from_one_text_of_a_repeated_id(spark):
    rows = [(1, "good text here", 1), (1, "other text", 1), (3, "bad stuff !!!", 0), (5, "fine prose again", 1), (6, "$$$ buy", 0)]
    frame, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    machines = [quality.train(frame.repartition(n), labels) for n in (1, 3, 7)]
    assert all((m.linear == machines[0].linear).all() and (m.factors == machines[0].factors).all() for m in machines)


def test_token_batches(spark, tmp_path):
    vocabulary = {"byte_bpe_50k": token_counts.load_vocabulary("byte_bpe_50k")}
    rollup = token_counts.Rollup(spark, str(tmp_path), vocabulary)
    schema = "op string, doc_id long, text string, source string, lang string, seq long"

    def commit(name, *rows):
        rollup.commit(name, spark.createDataFrame([(*r, "a", "en", s) for *r, s in rows], schema))
        return [(r.docs, r.tokens) for r in rollup.totals().collect()]

    assert commit("1", ("insert", 1, "one", 0), ("insert", 1, "one", 0), ("delete", 2, None, 0), ("insert", 2, "gone", 0)) == [(2, 2)]
    assert commit("2", ("revise", 1, "one two", 0), ("revise", 1, "one two", 0)) == [(1, 2)]  # a repeated revision counts once
    assert commit("3", ("revise", 1, "one two three", 2), ("delete", 1, None, 1)) == [(1, 3)]  # the last change decides
    assert commit("4", ("insert", 1, "x", 2), ("delete", 1, None, 1)) == [(1, 1)]
    assert commit("5", ("delete", 1, None, 0), ("delete", 1, None, 0), ("other", 9, "z", 0)) == []
    assert commit("6", ("insert", 1, "one two", 0), ("insert", 4, "one", 0)) == [(2, 3)]
    for _ in range(2):  # folding the batches changes nothing, nor does folding again
        rollup.compact()
        assert [(r.docs, r.tokens) for r in rollup.totals().collect()] == [(2, 3)] and rollup.committed() == list("123456")
        assert len(rollup._ledger()) == 1
    assert commit("6", ("insert", 1, "one two", 0)) == [(2, 3)]
    assert commit("7", ("delete", 1, None, 0)) == [(1, 1)]
    rollup.compact()
    assert commit("8", ("revise", 4, "one two", 0)) == [(1, 2)] and rollup.committed() == list("12345678")


def test_url_rules_by_join(spark):
    rules = url_filter.HOST_RULES + url_filter.PATTERN_RULES + (url_filter.Rule("bet*win", "block"),)
    urls = [f"http://{h}{p}" for h in ("a.b", "Ads.a", "www.casino.b", "net", "q.example.net", "m.org") for p in ("/c", "/betXwin", "/en/x.exe", "/en/", "/fr/z", "", "/" + "x/" * 5000)] + [None, "", "nothing"]
    frame = clashing(spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls)], "page_id long, url string"))
    plain = url_filter.judge(frame, rules).select("page_id", "host", "path", "rule", "verdict")
    joined = url_filter.judge(frame, rules, max_index_bytes=10).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, joined.collect()))


@pytest.mark.parametrize("page", ["<div>x" * 60_000, "<b>" * 30_000 + "<div>x</div>" * 30_000, "<div>" * 30_000 + "</x>" * 30_000 + "hi", "<p a=\">y" * 40_000, "".join(f"<div class='n{i}'>x" for i in range(20_000)), "<" * 200_000])
def test_html_in_linear_time(page):
    import time

    start = time.perf_counter()
    html_text.main_text(page, html_text.trained())
    assert time.perf_counter() - start < 20


def test_html_keeps_formulas_and_fallbacks():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> hold, co<wbr>operate.</p><p>A <noscript>fallback</noscript> <svg><text>label</text></svg> <object>stands</object> here<br>now.</p></article>"
    assert html_text.main_text(page, html_text.trained()) == "Let x=1 hold, cooperate.\n\nA fallback label stands here now."
