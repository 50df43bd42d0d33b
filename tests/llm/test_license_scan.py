"""License scans against loops over words, on notices whole, altered and repeated, and on odd rows."""

import re

import pytest
from pyspark.sql import functions as F

from metaspan.llm import license_scan as ls

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(doc_id, text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    base, spans = [], []
    for phrase, label in ls.BASE:
        v = phrase.split()
        base += [(p, label) for p in range(len(w)) if w[p : p + len(v)] == v]
    for notice, label in ls.TEMPLATES:
        v = notice.split()
        grams = {}
        for q in range(len(v) - 4):
            grams.setdefault(tuple(v[q : q + 5]), []).append(q)
        votes = sorted((p - q, q) for p in range(len(w)) for q in grams.get(tuple(w[p : p + 5]), ()))
        groups = []
        for diagonal, q in votes:
            if groups and diagonal - groups[-1][-1][0] <= ls.SLACK:
                groups[-1].append((diagonal, q))
            else:
                groups.append([(diagonal, q)])
        for g in groups:
            coverage = len({q for _, q in g}) / (len(v) - 4)
            if coverage >= ls.COVERAGE:
                spans.append((label, coverage))
    join = lambda x: ",".join(sorted(set(x)))
    return (
        doc_id, len(w), len(base), min((p for p, _ in base), default=None), max((p for p, _ in base), default=None), join(x for _, x in base), join([x for _, x in base] + [x for x, _ in spans]),
        max([c for _, c in spans] + [1.0] * bool(base), default=0.0),
    )


MIT, GPL = ls.TEMPLATES[0][0], ls.TEMPLATES[7][0]
EDITED = MIT.replace("software and associated", "software, its examples and associated").replace("without limitation ", "")
CASES = [
    (1, MIT), (2, "x " * 40 + GPL.upper() + "! y"), (3, EDITED), (4, MIT[:120]), (5, "Released under the MIT\n-- License. Apache License; MIT license"), (6, None), (7, ""), (7, ""),
    (8, "the mit licenses; mit, licence; general public"), (None, "GNU General Public License"), (None, "GNU General Public License"), (9, " ".join([EDITED] * 3)), (10, "é1 " * 60_000 + "mit license"),
    (11, "mİt license miKt license apache LICENSEK"), (12, "mit license " * 5000), (13, "..!"), (14, "MIT license mit MIT LICENSE general public general public license"),
]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_cases_equal_plain_loops(spark):
    found = ls.scan_documents(spark.createDataFrame(CASES, "doc_id long, text string"))
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert rows(found) == sorted((plain(*c) for c in CASES), key=repr)
    by = {r[0]: r for r in rows(found)}
    assert by[1][5:7] == ("", "mit") and by[3][6] == "mit" and 0.7 <= by[3][7] < 1 and by[4][6] == "" and by[2][6] == "gpl"


def test_spans_of_edited_copies(spark):
    found = ls.scan(spark.createDataFrame([(1, "start here " + EDITED + " end")], "doc_id long, text string")).first().found
    # two inserted words and two lost ones leave one copy, from its first to its last word
    assert [(s.label, s.base, s.first, s.last) for s in found] == [("mit", False, 2, 2 + len(EDITED.replace(",", "").split()) - 1)]


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame(CASES, "doc_id long, text string")
    more = df.withColumns({c: F.lit("x") for c in ("words", "row", "at", "w1", "gram", "template", "label", "base", "hash")})
    assert rows(ls.scan_documents(more)) == sorted((plain(*c) for c in CASES), key=repr)
    assert rows(ls.scan_documents(df.limit(0))) == []


def test_templates_fit_their_bit_set():
    for text, _ in ls.TEMPLATES:
        assert ls.WORDS <= len(text.split()) <= 63 + ls.WORDS - 1 and re.fullmatch("[a-z0-9 ]+", text)


def test_no_python_in_the_plan(spark, capsys):
    ls.scan_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


@pytest.mark.parametrize("name", ["sf0.001"])
def test_documents_equal_plain_loops(spark, name):
    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    assert rows(ls.scan_documents(docs)) == sorted((plain(r.doc_id, r.text) for r in docs.collect()), key=repr)
