"""Licence scans find every template, short ones and wrapped ones included."""

from trailgraph.llm import licenses

SCHEMA = "doc_id long, text string"


def findings(spark, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return [[(f.paragraph, f.family) for f in r.findings if f.confirmed] for r in licenses.scan(frame).orderBy("doc_id").collect()]


def test_scan_confirms_every_template(spark):
    lines = [(f, t) for f, family in licenses.TEMPLATES.items() for t in family]
    assert min(len(licenses.words(t)) for _, t in lines) == 1
    assert findings(spark, *(f"Some prose.\n{t}" for _, t in lines)) == [[(1, f)] for f, _ in lines]


def test_wrapped_notices_are_one_paragraph(spark):
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            own = t.split()
            if len(own) < 24 or "." in t[:-1] or ":" in t[:-1]:
                continue
            wrapped = "\n".join(" ".join(own[i : i + 8]) for i in range(0, len(own) - len(own) % 8, 8))
            assert findings(spark, f"Some prose here\n\n{wrapped}\n\nMore prose") == [[(2, family)]], t


def wrapped(text, width):
    own = text.split()
    return "\n".join(" ".join(own[i : i + width]) for i in range(0, len(own), width))


def test_notices_in_short_lines(spark):
    """However few words a line has, a notice is found as if its lines were joined."""
    texts = ["All rights\nreserved.", "Released\nunder\nCC0\n1.0.", "Licensed under\nthe Apache\nLicense, Version\n2.0.", "MIT\nLicense", "Some prose of mine\nand more.\n\nMIT\nLicense\n\nMore prose"]
    families = ["proprietary", "cc", "apache", "mit", "mit"]
    got = findings(spark, *texts)
    assert [[f for _, f in own] for own in got[:1] + got[2:]] == [[f] for f in families[:1] + families[2:]] and len(got[1]) == 1
    whole = [t for own in licenses.TEMPLATES.values() for t in own if not any(w[-1] in ".:;!?" for w in t.split()[:-1])]
    assert len(whole) > 20
    for width in (1, 2, 3):
        assert [[f for _, f in own] for own in findings(spark, *(wrapped(t, width) for t in whole))] == [[f for _, f in own] for own in findings(spark, *whole)]


def test_other_lines(spark):
    texts = ["SPDX-License-Identifier: EPL-2.0", "Fishing License", "She renewed her driving licence.", "All rights reserved.\nAll rights reserved.", "MIT License\n\nApache License", "", None, "\n\n", "mit"]
    assert findings(spark, *texts) == [[], [], [], [(0, "proprietary"), (1, "proprietary")], [(0, "mit"), (2, "apache")], [], [], [], []]


def test_extra_columns_and_long_texts(spark):
    frame = spark.createDataFrame([(1, "w " * 200_000 + "\nMIT License", "x"), (2, "All rights reserved.\n" * 3000, "y")], "doc_id long, text string, findings string")
    got = {r.doc_id: r.findings for r in licenses.scan(frame).collect()}
    assert [f.family for f in got[1]] == ["mit"] and len(got[2]) == 3000
