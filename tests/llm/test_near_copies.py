"""The near-copy stage against brute force: every pair with a five-word Jaccard of 0.8 is one component."""

import random

from trailgraph.llm import near_copies, set_join

from ..conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], DOCS)


def slow_set(text):
    own = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def brute(rows):
    """The ids that stay: the least of each component over all pairs."""
    sets, parent = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


def planted(seed=3, bases=12, copies=8):
    """Texts and copies of them at similarities around 0.8, up to 0.95."""
    rng, rows = random.Random(seed), []
    line = [f"common{i}" for i in range(15)]
    for b in range(bases):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400]))] + line
        rows.append(base)
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 35))):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            rows.append(own)
    rows = [" ".join(r) for r in rows] + ["one two", "ONE\ttwo", "one two three", "", " \n", None]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_planted_near_copies(spark):
    import corpus_pipeline

    rows = planted()
    sets = [slow_set(t) for _, t in rows]
    near = sum(0.8 <= len(x & y) / max(1, len(x | y)) < 0.95 for i, x in enumerate(sets) for y in sets[:i])
    assert near > 30
    table = docs(spark, rows)
    kept = corpus_pipeline.dedup_stage(spark, table, SMALL)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == brute(rows)
    assert near_copies.keep_one(table.limit(0)).count() == 0


def test_documents_against_brute_force(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    kept = sorted(r.doc_id for r in near_copies.keep_one(table).collect())
    assert kept == brute(rows) and not {145, 177} & set(kept)


def test_a_passage_that_many_texts_share(spark, monkeypatch):
    """Texts of one passage and some words of their own, of sizes and similarities on both sides of the bound: all copies found, no pair per pair of texts made."""
    rng = random.Random(4)
    passage = " ".join(f"shared{i}" for i in range(50))
    rows = [f"{' '.join(f'own{rng.randrange(10**6)}' for _ in range(rng.randint(1, 12)))} {passage}" for _ in range(150)]
    rows += [r + " end" for r in rows[:20]] + [" ".join(r.split()[1:]) for r in rows[20:40]]
    rows = list(enumerate(rows))
    met = []
    candidates = set_join.candidates
    monkeypatch.setattr(set_join, "candidates", lambda measure, mixed: met.append(candidates(measure, mixed)) or met[-1])
    assert sorted(r.doc_id for r in near_copies.keep_one(docs(spark, rows)).collect()) == brute(rows)
    monkeypatch.setattr(set_join, "PART", 1)  # every text is read for the order, so that the passage comes last
    assert sorted(r.doc_id for r in near_copies.keep_one(docs(spark, rows)).collect()) == brute(rows)
    assert met[-1].distinct().count() < len(rows) * 2
