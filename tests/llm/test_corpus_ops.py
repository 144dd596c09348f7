"""Near-duplicates, quality, search, mixing, sharding, pipeline: against brute force and on edge cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from trailgraph.llm import mixing, quality, search, sharding, simhash
from trailgraph.llm.decontaminate import words

from ..conftest import SMALL, canonical

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


# -------------------------------------------------------------------- simhash


def slow_fingerprint(text):
    own = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not own:
        return 0
    shingles = [b" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "A b C d", "x " * 50, "ä\u00a0ö ü\x0bß\x1cq", " ".join(map(str, range(5000)))])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def components(values, radius=2):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    v = np.array(values, dtype=np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(v))]


def family(rng, n, centre=None, flips=3):
    centre = rng.getrandbits(64) if centre is None else centre
    return {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, flips))) for _ in range(n)}


def star_components(spark, values):
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.a: r.b for r in simhash.stars(simhash.links(frame)).collect()}
    roots = [found.get(v, v) for v in signed]
    return [roots.index(r) for r in roots]


def test_links_and_components_against_brute_force(spark):
    rng = random.Random(1)
    values = sorted({rng.getrandbits(64) for _ in range(400)} | family(rng, 300) | family(rng, 40) | {0, 1, 3, 7, 15, (1 << 64) - 1, 1 << 63})
    expected = components(values)
    got = star_components(spark, values)
    assert [expected.index(e) for e in expected] == got


@pytest.mark.parametrize("run", [1, 8, 60])
def test_full_keys_are_filed_again(spark, monkeypatch, run):
    rng = random.Random(2)
    dense = {rng.getrandbits(6) | 5 << 30 | rng.getrandbits(3) << 61 for _ in range(150)}
    values = sorted(family(rng, 200) | family(rng, 30) | dense | {rng.getrandbits(64) for _ in range(100)})
    expected = components(values)
    monkeypatch.setattr(simhash, "RUN", run)
    assert star_components(spark, values) == [expected.index(e) for e in expected]


def test_bit_sliced_distances():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 130, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 130).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 130).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 8, 130).astype(np.uint64))
    for radius in (0, 1, 2, 3, 5):
        assert (simhash.near_pairs(a, b, radius) == (np.bitwise_count(a ^ b) <= radius)).all()
        bits = np.unpackbits(simhash.near(a, simhash.planes_of(b), radius).view(np.uint8), axis=1, bitorder="little")[:, :130].astype(bool)
        assert (bits == (np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)).all()


def test_components_and_keep_one(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base, "a"), (3, base, "b"), (9, base.replace("word7 ", "other "), "a"), (1, "entirely different text here now", "a"), (8, None, "a"), (7, "", None), (None, base, "a"), (3, base, "b"), (None, "alone " * 9, "a"), (2, " ", "a")]
    table = docs(spark, rows).withColumn("fp", __import__("pyspark").sql.functions.lit(1))
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.components(table).collect()}
    expected = components([slow_fingerprint(t) for _, t, _ in rows])
    for i, (doc_id, text, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if expected[j] == expected[i] and rows[j][0] is not None]
        assert got[(doc_id, f"{slow_fingerprint(text):016x}")] == min(members, default=None)
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "None"] + (["9"] if expected[2] != expected[0] else []))
    assert simhash.components(table.limit(0)).count() == simhash.keep_one(table.limit(0)).count() == 0


# -------------------------------------------------------------------- quality


def test_sum_of_squares_identity():
    rng = np.random.default_rng(3)
    linear, factors = rng.normal(size=50), rng.normal(size=(50, 4))
    rows = [(np.array([1, 4, 4, 9]), np.array([0.5, 1.0, 2.0, -1.0])), (np.array([7]), np.array([3.0]))]
    got = quality._margin(linear, factors, *quality._flat(rows))[0]
    for (index, value), m in zip(rows, got):
        pairs = sum(factors[index[i]] @ factors[index[j]] * value[i] * value[j] for i in range(len(index)) for j in range(i))
        assert m == pytest.approx(linear[index] @ value + pairs)


def test_quality_learns_and_ignores_metadata(spark):
    from pyspark.sql import functions as F

    table, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    machine = quality.train(table, labels)
    scored = quality.score(table, machine)
    assert scored.count() == table.count()
    larger = "/root/testdata/sf0.01"
    own, known = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    joined = quality.score(own, quality.train(own, known)).join(known, "doc_id").where("held_out").toPandas()
    assert (joined.predicted == joined.quality).mean() > 0.95  # held-out accuracy
    moved = table.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("z"), "doc_id": F.col("doc_id") + 1000})
    assert sorted(r.score for r in quality.score(moved, machine).collect()) == sorted(r.score for r in scored.collect())
    assert quality.accept(table, machine).columns == table.columns


def test_quality_edges(spark):
    rows = [(None, None, "s"), (1, "", "s"), (1, "", "s"), (2, "a" * 100_000, "s")]
    table = docs(spark, rows)
    for labels in ([], [(1, None, 0)], [(1, 1, 0), (1, 0, 0), (2, 1, 0)]):
        machine = quality.train(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        got = quality.score(table, machine).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.score(table.limit(0), machine).count() == 0


# --------------------------------------------------------------------- search


def test_search_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 80))) for _ in range(500)] + [None, "", "w1 w2", "w1 w2"]
    table = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    queries = spark.createDataFrame([(i, texts[i]) for i in (0, 7, 500, 501, 502)] + [(99, "nothingknown")], "query_id long, text string")
    for size, block in ((1 << 30, 1 << 20), (4000, 1 << 20), (8000, 400), (1, 1)):  # one shard and many, one block of queries and several
        got = {}
        for r in search.top_k(table, queries, 5, size, block).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, r.score)
        own = [Counter(words(t)) for t in texts]
        lengths = [sum(c.values()) for c in own]
        mean, df = sum(lengths) / len(texts), Counter(w for c in own for w in c)
        for q in (0, 7, 502):
            scores = []
            for i, c in enumerate(own):
                s = sum(n * math.log1p((len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * lengths[i] / mean)) for w, n in own[q].items() if c[w])
                if s > 0:
                    scores.append((-round(s, 6), i))
            best = [(i, -s) for s, i in sorted(scores)[:5]]
            mine = [got[q][k] for k in sorted(got[q])]
            assert [i for i, _ in mine] == [i for i, _ in best]
            assert [s for _, s in mine] == pytest.approx([s for _, s in best], abs=2e-6)
        assert not {500, 501, 99} & set(got)
    assert search.top_k(table.limit(0), queries).count() == search.top_k(table, queries.limit(0)).count() == 0


# --------------------------------------------------------------------- mixing


def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 20, 300])), rng.choice(["a", "a", "a", "b", "c", "d", None, "é"])) for i in range(800)] + [(None, None, "a"), (4, "dup", "b"), (4, "dup", "b")]
    table = docs(spark, rows).withColumn("size", __import__("pyspark").sql.functions.lit("x"))
    got = mixing.plan(table).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target, taken = slow_targets(sizes), Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 300
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    copies = Counter((r.doc_id, r.source) for r in mixed.collect())
    for r in got:
        if r.doc_id not in (4, None):
            assert copies[(r.doc_id, r.source)] == r.copies
    assert canonical(mixing.plan(table.repartition(7)).toPandas()) == canonical(mixing.plan(table).toPandas())
    assert mixing.plan(table.limit(0)).count() == mixing.mix(table.limit(0)).count() == 0
    assert [r.taken for r in mixing.plan(docs(spark, [(1, None, None), (2, "", None)])).collect()] == [0, 0]


# ------------------------------------------------------------------- sharding


def test_sharding(spark):
    import zlib

    rows = [(i, "x" * (i % 37) + "ä", "s") for i in range(3000)] + [(None, None, "s"), (None, "", "s"), (5, "dup", "s"), (5, "dup", "s")]
    table = docs(spark, rows)
    placed, slot_map = sharding.assign(table, 24)
    got = placed.toPandas()
    assert len(got) == len(rows)
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() <= 0.02 * loads.mean()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert Counter(zip(got["size"], got.text_crc32)) == Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    attached = sharding.attach(table, slot_map=slot_map)
    assert attached.columns == [*table.columns, "virtual_slot", "shard"]
    assert sharding.assign(table.limit(0), 24)[0].count() == 0


def test_slot_maps(spark, tmp_path):
    rng = random.Random(6)
    sizes = {s: rng.randint(1, 1000) for s in range(0, 8192, 3)}
    first = sharding.pack(sizes, 24)
    grown = sharding.rebalance(first, sizes, 25)
    assert grown.version == 2 and max(grown.loads(sizes)) <= 1.02 * sum(sizes.values()) / 25
    moved = [s for s in sizes if first.owner[s] != grown.owner[s]]
    assert sum(sizes[s] for s in moved) <= 1.1 * sum(sizes.values()) / 25
    sharding.save_map(spark, first, str(tmp_path))
    sharding.save_map(spark, grown, str(tmp_path))
    assert sharding.load_map(spark, str(tmp_path)) == grown and sharding.load_map(spark, str(tmp_path), 1) == first
    with pytest.raises(ValueError):
        sharding.rebalance(first, sizes, 3)


# ------------------------------------------------------- registered queries


def test_registered_sql(spark, duck):
    from trailgraph.llm import queries

    for name, sql in queries.ORACLE_SQL.items():
        assert canonical(queries.QUERIES[name](spark, SMALL).toPandas()) == canonical(duck.sql(sql).df()), name


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as pipeline

    def text_rows(df):
        return {r.doc_id: r.text for r in df.collect()}

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    accepted = pipeline.quality_stage(spark, table, SMALL).cache()
    assert 0.6 * table.count() < accepted.count() < table.count()
    single = pipeline.dedup_stage(spark, accepted, SMALL).cache()
    from .test_near_copies import brute as near_brute

    assert sorted(text_rows(single)) == near_brute(sorted(text_rows(accepted).items()))
    clean = pipeline.decontamination_stage(spark, single, SMALL).cache()
    from .test_text_ops import brute

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert sorted(text_rows(clean)) == sorted(i for i, t in text_rows(single).items() if not brute(t, items)[4])
    mixed = pipeline.mixing_stage(spark, clean, SMALL).cache()
    expected = {r.doc_id: r.copies for r in mixing.plan(clean).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == expected
    sharded = pipeline.sharding_stage(spark, mixed, SMALL)
    assert sharded.count() == mixed.count() and {r.shard for r in sharded.collect()} <= set(range(24))
    for df in (accepted, single, clean, mixed):
        assert df.columns == table.columns
        df.unpersist()
    assert pipeline.run(spark, SMALL).count() == mixed.count()
