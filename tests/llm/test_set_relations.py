"""Collocations, periodic runs and set joins: against brute force, over odd rows, and where their switches matter."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trailgraph.llm import collocations, periodic, queries, set_join

from ..conftest import SMALL, canonical
from .test_edges import clashing
from .test_edges import table as odd_table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "a", len(t or "")) for i, t, lang in rows], DOCS)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", ["op11_collocations", "op12_periodic_runs", "op13_set_join"])
def test_queries_match_their_sql(spark, duck, name):
    got, expected = queries.QUERIES[name](spark, SMALL).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert canonical(got) == canonical(expected) and len(got)


# ------------------------------------------------------------------ collocations


def slow_collocations(rows, least, most, inside, top):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        pieces, own = [], ""
        for c in lower(text):
            if c in ".,;:!?\n\x0b\x0c\r":
                pieces, own = [*pieces, own], ""
            else:
                own += c
        for piece in [*pieces, own]:
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    long = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    found = {}
    for (lang, w), a in long.items():
        if any(o == lang and len(v) > len(w) and 100 * b >= inside * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (o, v), b in long.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, r + 1, p.decode(), -a, left, right, n[lang], -score) for lang, own in found.items() for r, (score, a, p, left, right) in enumerate(sorted(own)[:top]))


def phrase_rows(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É x", "a\x00b", "x\x1cy", "한"]
    fixed = ["Blue Moon RIVER bank", "one two one two one", "x x x x"]
    rows = []
    for i in range(120):
        own = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 60))]
        rows.append(("".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "\x0b", "!", " ? "]) for w in own), rng.choice(["en", "de", None, "und", ""])))
    return [*rows, (None, "en"), ("", None), ("...\n", "fr"), rows[0], rows[0]]


@pytest.mark.parametrize(("most", "top", "buckets"), [(3, 2000, None), (3, 7, 1 << 11), (4, 50, 1 << 14), (2, 2000, 1 << 11)])
def test_collocations_against_brute_force(spark, monkeypatch, most, top, buckets):
    """Few buckets let more phrases through and change nothing; texts are cut into chunks between pieces, counts leave a task in many batches."""
    monkeypatch.setattr(collocations, "_TEXT", 64)
    monkeypatch.setattr(collocations, "_HELD", 20)
    rows = phrase_rows()
    table = docs(spark, [(i, t, lang) for i, (t, lang) in enumerate(rows)])
    got = sorted(tuple(r) for r in collocations.collocations(clashing(table), 10, most, 50, top, buckets).collect())
    assert got == slow_collocations(rows, 10, most, 50, top) and len(got) > 5


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    cases = [(10**15 - 1, 10**15 + 7, 10**15 + 9), (9_999_999_999_999_999, 9_999_999_999_999_999, 9_999_999_999_999_999), (10, 11, 13)]
    got = spark.createDataFrame(cases, "a long, l long, r long").select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [r[0] for r in got] == [10**6 * a * a // (x * y) for a, x, y in cases]


def test_pruning_counts_few_phrases(spark, tmp_path):
    """The second and third pass count little that is not frequent."""
    rng = random.Random(6)
    rows = [(i, " ".join(["the mill stands"] + [f"u{rng.randrange(10**6)}" for _ in range(30)]), "en") for i in range(60)]
    texts = docs(spark, rows).select("lang", "text")
    first = collocations._pass(texts, 1, False, 10, 1 << 16, None)
    full = collocations.bitmap(first.where("chunk IS NOT NULL").select("chunk", "data"), 10, 1 << 16)
    assert 2 <= int(np.unpackbits(full).sum()) <= 4
    words = first.where("gram IS NOT NULL").groupBy("lang", "gram").sum("n").where("`sum(n)` >= 10").select("lang", "gram")
    maps = spark.sparkContext.broadcast((collocations.bitmap(collocations._set_bits(words, 1 << 16), 1, 1 << 16), full))
    second = collocations._pass(texts, 2, True, 10, 1 << 16, maps).where("gram IS NOT NULL").select("gram").distinct().collect()
    assert {bytes(r.gram) for r in second} == {b"the mill", b"mill stands"}


# ---------------------------------------------------------------- periodic runs


def slow_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            own = (i, j - i + q)
            if own[1] >= max(6, 4 * q) and j > i and not any(r[:2] == own for r in found):
                found.append((*own, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeating(rng, n, kinds):
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 10:
            first, q = rng.randrange(n), rng.randrange(1, 12)
            for i in range(first + q, min(n, first + q * rng.randrange(3, 9) + rng.randrange(q))):
                words[i] = words[i - q]
    return words


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        words = repeating(rng, rng.randrange(150), rng.choice([1, 2, 3, 5, 30]))
        ids = np.array(words, dtype=np.int32)
        assert periodic.runs_of(ids) == slow_runs(words)
        if len(words) > 8:
            for heavy in (2, 5, 1000):  # all by FFT, some, none
                counts = periodic.lag_counts(ids, len(ids) // 4, heavy)
                assert [counts[q] for q in range(1, len(ids) // 4 + 1)] == [(ids[q:] == ids[:-q]).sum() for q in range(1, len(ids) // 4 + 1)]


def test_highest_is_exact():
    assert periodic.highest([(0, 40, 10), (50, 401, 100), (460, 401, 100), (3, 12, 3)]) == (50, 401, 100)
    assert periodic.highest([(5, 12, 3), (5, 8, 2), (9, 16, 4)]) == (5, 8, 2) and periodic.highest([]) is None


@pytest.mark.parametrize("ids", [np.zeros(400_000, dtype=np.int32), np.tile(np.array([0, 0, 1], dtype=np.int32), 130_000), np.tile(np.arange(5000, dtype=np.int32), 40)])
def test_long_repetitions_take_few_scans(ids, monkeypatch):
    scanned = []
    islands = periodic._islands
    monkeypatch.setattr(periodic, "_islands", lambda ids, lag, known: scanned.append(len(ids) / lag) or islands(ids, lag, known))
    assert len(periodic.runs_of(ids)) == 1 and sum(scanned) < 20 * len(ids)


def test_odd_rows_of_runs(spark):
    table = odd_table(spark)
    got = periodic.detect(clashing(table)).collect()
    assert sorted((repr(r.doc_id), r.n_words) for r in got) == sorted((repr(r.doc_id), len((r.text or "").encode().split())) for r in table.collect())
    long = next(r for r in got if r.doc_id == 53)
    assert long.best == (0, 60_000, 1) and long.collapsed == "long" and len(long.runs) == 1
    for r in got:
        if r.doc_id in (50, 51, 52):
            assert (r.n_words, r.runs, r.best, r.collapsed) == (0, [], None, "")
    assert periodic.detect(table.limit(0)).count() == 0


def test_planted_repetitions(spark):
    """The query's digests, row by row, over documents of which a tenth repeat their words."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    assert sum(r.n_runs > 0 for r in got.values()) > 10
    for doc_id, text in rows:
        words = queries.planted(doc_id, (text or "").encode().split())
        if len(words) < 2000:
            runs, gone = slow_runs(words), set()
            for start, length, period in runs:
                gone |= set(range(start + period, start + length))
            kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
            digest = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
            assert (got[doc_id].n_runs, got[doc_id].runs_sha256, got[doc_id].collapsed_sha256) == (len(runs), hashlib.sha256(digest).hexdigest(), hashlib.sha256(kept).hexdigest())


# ---------------------------------------------------------------------- set join


def slow_sets(rows, size):
    sets = []
    for _, t, _ in rows:
        own = lower(t).encode().split()
        sets.append({tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set())
    return sets


def slow_components(rows, measure):
    sets, parent = slow_sets(rows, measure.shingle), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and measure.of * len(x & sets[j]) >= measure.similar * len(x | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _, _) in enumerate(rows)), key=repr)


def near_rows(seed, bases=10, copies=12, sizes=(25, 60, 150, 400)):
    """Chains and stars of copies at similarities on both sides of the bound, under passages that many share."""
    rng, rows = random.Random(seed), []
    shared = [f"common{i}" for i in range(25)]
    for _ in range(bases):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice(sizes))] + shared
        rows.append(base)
        for _ in range(copies):
            own = list(rng.choice([base, rows[-1]]))
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            rows.append(own[rng.randint(0, 3) :])
    rows = [" ".join(r) for r in rows] + ["one two", "ONE\ttwo", "one two three", "", " \n", None, "x", "X"]
    rng.shuffle(rows)
    rows = [(i, t, "en") for i, t in enumerate(rows)]
    return [*rows, *rows[:5], (None, rows[7][1], "en"), (None, "alone without an id here", "en")]


@pytest.mark.parametrize(("measure", "part", "list_"), [(set_join.Measure(3, 9, 10), 8, 1 << 15), (set_join.Measure(3, 9, 10), 1, 2), (set_join.Measure(5, 4, 5), 1, 1), (set_join.Measure(2, 1, 2), 8, 1 << 15)])
def test_components_against_brute_force(spark, monkeypatch, measure, part, list_):
    """Whole lists and lists in many parts, for three measures."""
    monkeypatch.setattr(set_join, "PART", part)
    monkeypatch.setattr(set_join, "LIST", list_)
    rows = near_rows(part + measure.shingle)
    assert sorted((tuple(r) for r in set_join.components(clashing(docs(spark, rows)), measure).collect()), key=repr) == slow_components(rows, measure)


def test_odd_rows_of_joins(spark):
    measure = set_join.Measure(3, 9, 10)
    table = odd_table(spark)
    got = sorted((tuple(r) for r in set_join.components(table, measure).collect()), key=repr)
    assert got == slow_components([(r.doc_id, r.text, r.lang) for r in table.collect()], measure)
    assert set_join.components(table.limit(0), measure).count() == 0


def lists(rows, cuts):
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[3], r[2], r[4]))
    edges, names = [0, *cuts, len(rows)], ["key", "part", "n", "i", "s"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    for a, b in zip(edges, edges[1:], strict=False):
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a:b]], type=k) for c, k in enumerate(kinds)], names=names)


def test_guides_do_not_depend_on_batches():
    """Every set of a list with several comes out once, under the first set where its block leaves room."""
    rng, measure = random.Random(2), set_join.Measure(3, 9, 10)
    rows = [(rng.randrange(12), rng.randrange(2), rng.choice([10, 40, 42, 44, 60]), rng.randrange(6), k) for k in range(80)]
    expected, lists_ = [], {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[2], r[4])):
        lists_.setdefault(r[:2], []).append(r)
    for own in lists_.values():
        guide = own[0]
        for r in own:
            fits = r is not guide and measure.room(r[2], r[3], guide[2], guide[3]) and 9 * max(r[2], guide[2]) <= 10 * min(r[2], guide[2])
            if len(own) > 1 or r[1]:
                expected.append((*r, guide[4] if fits else None))
    for _ in range(30):
        cuts = sorted(rng.sample(range(81), rng.randrange(12)))
        got = [tuple(r.values()) for b in set_join.guided(measure, lists(rows, cuts)) for r in b.to_pylist()]
        assert got == expected


def test_derived_answers_are_those_of_whole_sets():
    """Differences from guides give the same answers as the sets themselves."""
    rng, measure = np.random.default_rng(3), set_join.Measure(3, 9, 10)

    def near(x):
        keep = np.delete(x, rng.choice(len(x), rng.integers(0, 6), replace=False))
        return np.unique(np.r_[keep, rng.integers(0, 400, rng.integers(0, 6)).astype(np.uint64)])

    for _ in range(200):
        base = np.unique(rng.integers(0, 400, 90).astype(np.uint64))
        x, y = near(base), near(base)
        rows, expected = [dict(ga=1, gb=2, asks=False, x=x.tobytes(), y=y.tobytes())], []
        for k in range(5):
            s, t = near(x), near(y)
            diff = dict(more_a=np.setdiff1d(s, x).tobytes(), less_a=np.setdiff1d(x, s).tobytes(), more_b=np.setdiff1d(t, y).tobytes(), less_b=np.setdiff1d(y, t).tobytes())
            rows.append(dict(ga=1, gb=2, asks=True, a=k, b=9, n=len(s), m=len(t), **diff))
            if 10 * len(np.intersect1d(s, t)) >= 9 * len(np.union1d(s, t)):
                expected.append(k)
        schema = pa.schema([("ga", pa.int64()), ("gb", pa.int64()), ("asks", pa.bool_()), ("x", pa.binary()), ("y", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), *((c, pa.binary()) for c in ("more_a", "less_a", "more_b", "less_b"))])
        batch = pa.RecordBatch.from_pylist([{c: r.get(c) for c in schema.names} for r in rows], schema=schema)
        got = [a for b in set_join.answers(measure, iter([batch.slice(0, 2), batch.slice(2)])) for a in b.column("a").to_pylist()]
        assert got == expected
