"""The registered queries that SQL cannot express, against brute force on the smallest tables."""

import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from trailgraph.llm import html_text, licenses, quality, queries, token_counts
from trailgraph.llm.decontaminate import words

from ..conftest import SMALL
from .test_corpus_ops import components, slow_fingerprint


@pytest.fixture(scope="module")
def table(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def rows(spark, name):
    return queries.QUERIES[name](spark, SMALL).collect()


def slow_scores(query, texts):
    """BM25 of every text, straight from the formula."""
    own = [Counter(words(t)) for t in texts]
    lengths = [sum(c.values()) for c in own]
    mean, df = sum(lengths) / len(texts), Counter(w for c in own for w in c)
    made = []
    for i, c in enumerate(own):
        s = sum(n * math.log1p((len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * lengths[i] / mean)) for w, n in query.items() if c[w])
        if s > 0:
            made.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(made)]


def test_op2_search(spark, table):
    got = {}
    for r in rows(spark, "op2_search"):
        got.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, r.score)
    asked = [d for d in table if d["doc_id"] % 100 == 0]
    assert set(got) == {d["doc_id"] for d in asked if words(d["text"])}
    texts = [d["text"] for d in table]
    for d in asked:
        best = slow_scores(Counter(words(d["text"])), texts)[:10]
        mine = [got[d["doc_id"]][k + 1] for k in range(len(best))]
        assert [i for i, _ in mine] == [table[i]["doc_id"] for i, _ in best]
        assert [s for _, s in mine] == pytest.approx([s for _, s in best], abs=2e-6)


def slow_findings(text, model):
    """Families of a text's paragraphs (None: not confirmed), from the words of all its lines, in Python."""
    own, templates = (text or "").split("\n"), [tuple(licenses.words(t)) for f in licenses.TEMPLATES.values() for t in f]
    known, short = {t[k : k + 3] for t in templates for k in range(len(t) - 2)}, {t for t in templates if len(t) < 3}
    placed, marked = [(w, i) for i, line in enumerate(own) for w in licenses.words(line)], set()
    for k in range(len(placed) - 2):
        if tuple(w for w, _ in placed[k : k + 3]) in known:
            marked |= {i for _, i in placed[k : k + 3]}
    for i, line in enumerate(own):
        w = tuple(licenses.words(line))
        after = tuple(licenses.words(own[i + 1])) if i + 1 < len(own) else ()
        marked |= ({i} if w in short else set()) | ({i, i + 1} if len(w) == len(after) == 1 and w + after in short else set())
    found, run, last = [], [], None
    for i in sorted(marked):
        if run and (i != last + 1 or re.search(r"[.!?:;][\s\"')]*$", run[-1])):
            found.append(" ".join(run))
            run = []
        run.append(own[i])
        last = i
    found += [" ".join(run)] if run else []
    result = []
    for paragraph in found:
        p, own = model.probabilities(paragraph), set(licenses.shingle_hashes(licenses.words(paragraph)))
        family = licenses.FAMILIES[int(p.argmax())]
        similar = max((len(own & set(t)) / max(1, min(len(own), len(t))) for t in (licenses.shingle_hashes(licenses.words(x)) for x in licenses.TEMPLATES.get(family, ()))), default=0)
        result.append(family if p.max() >= licenses.MIN_PROBABILITY and similar >= licenses.MIN_SIMILARITY else None)
    return result


def test_op3_licenses(spark, table):
    model = licenses.trained()
    got = {r.doc_id: (r.n_paragraphs, r.n_confirmed, r.families) for r in rows(spark, "op3_licenses")}
    expected = {d["doc_id"]: slow_findings(d["text"], model) for d in table}
    assert sum(map(len, expected.values())) > 3
    assert got == {i: (len(f), sum(x is not None for x in f), ",".join(sorted({x for x in f if x}))) for i, f in expected.items()}


def test_op5_simhash(spark, table):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op5_simhash")}
    prints = [slow_fingerprint(d["text"]) for d in table]
    roots = components(prints)
    least = {}
    for d, r in zip(table, roots):
        least[r] = min(d["doc_id"], least.get(r, d["doc_id"]))
    assert got == {d["doc_id"]: (f"{p:016x}", least[r]) for d, p, r in zip(table, prints, roots)}


def test_op6_sharding(spark, table):
    import hashlib

    got = {r.doc_id: (r["size"], r.text_crc32, r.shard, r.virtual_slot) for r in rows(spark, "op6_sharding")}
    slots, sizes = {}, Counter()
    for d in table:
        text = d["text"] or ""
        slots[d["doc_id"]] = int(hashlib.md5(f"{d['doc_id']}:{text}".encode()).hexdigest()[:15], 16) % 8192
        sizes[slots[d["doc_id"]]] += len(text.encode()) + 8
    loads, owner = [0] * 24, {}
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        owner[slot] = loads.index(min(loads))
        loads[owner[slot]] += sizes[slot]
    assert got == {d["doc_id"]: (len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode()), owner[slots[d["doc_id"]]], slots[d["doc_id"]]) for d in table}


def test_op7_quality(spark, table):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    machine = quality.train(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    own = [d for d in table if d["doc_id"] in labels and zlib.crc32(str(d["doc_id"]).encode()) % 3 != 1]
    own.sort(key=lambda d: (zlib.crc32(str(d["doc_id"]).encode()), str(d["doc_id"])))
    same = quality.fit([quality.features(d["text"]) for d in own], [labels[d["doc_id"]] for d in own])
    assert (same.linear == machine.linear).all() and (same.factors == machine.factors).all()
    got = {r.doc_id: r for r in rows(spark, "op7_quality")}
    for d in table:
        index, value = quality.features(d["text"])
        spread = machine.factors[index] * value[:, None]
        gram = spread @ spread.T  # every pair by itself
        z = machine.bias + machine.linear[index] @ value + np.triu(gram, 1).sum()
        r = got.pop(d["doc_id"])
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1)
    assert not got


def test_op8_token_counts(spark, table):
    expected = Counter()
    for name in queries.TOKENIZERS:
        encode = token_counts.encoding(name, token_counts.load_vocabulary(name)).encode_ordinary
        for d in table:
            expected[d["source"], d["lang"], name, "docs"] += 1
            expected[d["source"], d["lang"], name, "tokens"] += len(encode(d["text"] or ""))
    got = Counter()
    for r in rows(spark, "op8_token_counts"):
        got[r.source, r.lang, r.tokenizer, "docs"] += r.docs
        got[r.source, r.lang, r.tokenizer, "tokens"] += r.tokens
    assert got == expected


def test_op10_html_text(spark):
    field = html_text.trained()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got, tried = {r.page_id: (r.text, r.n_chars) for r in rows(spark, "op10_html_text")}, 0
    assert set(got) == set(pages)
    for page_id, page in pages.items():
        chain = html_text.blocks(page)
        at = field.potentials(html_text.features(chain))
        assert got[page_id][1] == len(got[page_id][0])
        if len(chain) > 14:
            continue
        tried += 1

        def value(y, at=at):
            return sum(at[i][v] for i, v in enumerate(y)) + sum(field.step[a][b] for a, b in zip(y, y[1:]))

        best = max(product((0, 1), repeat=len(chain)), key=value)
        assert got[page_id][0] == "\n\n".join(b.text for b, y in zip(chain, best) if y)
    assert tried > 5


@pytest.mark.parametrize("ids", [[3, -3, 7], [3, 23, -17, None, 3], [(1 << 63) - 1, -(1 << 63), 3, 7], [(1 << 63) - 5, 3]])
def test_op8_totals_for_any_ids(spark, tmp_path, ids):
    """The query's own copies and corrections never meet a row of the table."""
    spark.createDataFrame([(i, "some words here", "a", "en") for i in ids], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.QUERIES["op8_token_counts"](spark, str(tmp_path)).collect():
        assert (r.docs, r.tokens) == (len(ids), 3 * len(ids))
