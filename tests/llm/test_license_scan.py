import math
import re

from gridspark.llm.license_scan import needed_words, scan, size_bounds, template_parts
from gridspark.llm.license_templates import TEMPLATES


def grams(text):
    w = re.sub(r"[\W_]+", " ", text.lower()).split()
    return {" ".join(p) for p in zip(w, w[1:])} or set(w)


def brute(docs, templates, threshold):
    parts = [(n, p, set(g)) for n, p, g in template_parts(templates)]
    out = set()
    for key, text in docs:
        if text is None:
            continue
        paragraphs = re.split(r"\n[ \t\x0b\f\r]*\n", text)
        units = [("line", i, x) for i, x in enumerate(text.split("\n"))]
        units += [("paragraph", i, x) for i, x in enumerate(paragraphs) if "\n" in x]
        units += [("text", 0, text)] if len(paragraphs) > 1 else []
        for kind, i, x in units:
            g = grams(x)
            best = min(((-2.0 * len(g & t) / (len(g) + len(t)), n, p) for n, p, t in parts if g), default=(0, "", 0))
            if -best[0] >= threshold:
                out.add((key, kind, i, best[1], best[2], -best[0]))
    return out


def run(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    return [tuple(r) for r in scan(df, **kw).collect()]


def test_matches_brute_force(spark):
    mit = dict(TEMPLATES[4:5])["MIT"]
    wrapped = "\n".join(mit[i:i + 60] for i in range(0, len(mit), 60))
    docs = [(i, r.text) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())]
    docs += [(1000, mit), (1001, "Title\n \t\n" + wrapped + "\n\nrest"), (1002, "released UNDER the mit-license"), (1003, None),
             (1004, ""), (1005, "\n\n \n"), (1006, "This work is licensed under the GNU General Public License, version 2."),
             (1007, "mit " * 20_000), (1008, "É " + TEMPLATES[0][1] + " ñ")]
    got = run(spark, docs)
    assert len(got) == len(set(got)) and set(got) == brute(docs, TEMPLATES, 0.8)
    assert {r[3] for r in got if r[0] == 1000} == {"MIT"} and sum(r[0] == 1000 for r in got) >= 3


def test_size_bounds_are_exact():
    for n in range(1, 60):
        for t in (0.5, 0.8, 1.0):
            ok = [m for m in range(1, 300) if 2 * min(m, n) / (m + n) >= t - 1e-12]
            assert (ok[0], ok[-1]) == size_bounds(n, t) and math.isfinite(ok[-1])


def test_every_match_holds_a_needed_word():
    parts = template_parts(TEMPLATES)
    for t in (0.5, 0.8, 1.0):
        words = set(needed_words(parts, t))
        for _, _, g in parts:
            without = [x for x in g if not words & set(x.split(" "))]
            # the best unit without any of the words is those bigrams alone
            assert 2 * len(without) / (len(without) + len(g)) < t


def test_repeats_null_ids_clashing_columns_and_empty(spark):
    line = "Licensed under CC BY-NC 4.0."
    df = spark.createDataFrame([(None, line, 1, "a"), (2, line, 1, "a"), (2, line, 1, "a"), (2, line + "\nx", 1, "a")],
                               "doc_id long, text string, size int, license string")
    got = sorted((tuple(r) for r in scan(df).collect()), key=repr)
    assert [r[:4] for r in got] == [(2, "line", 0, "CC-BY-NC-4.0")] * 2 + [(2, "paragraph", 0, "CC-BY-NC-4.0")] + [(None, "line", 0, "CC-BY-NC-4.0")]
    assert scan(df.limit(0)).count() == 0 and run(spark, [(1, line)], templates=[]) == []


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


def test_whole_licences_in_comments_are_found(spark):
    docs, want = [], {}
    for n, (name, body) in enumerate(t for t in TEMPLATES if "\n\n" in t[1]):
        for k, sign in enumerate(("# ", " * ", "// ")):
            rows = [row for p in body.split("\n\n") for row in [*re.findall(r".{1,70}(?: |$)", p), ""]]
            docs.append((3 * n + k, "\n".join(sign + row for row in ["Copyright 2020 Some Author", "", *rows])))
            want[3 * n + k] = name
    found = {(r[0], r[3]) for r in run(spark, docs) if r[1] == "paragraph"}
    assert found == set(want.items())


def test_disclaimers_are_found(spark):
    bodies = {name: body for name, body in TEMPLATES if "\n\n" in body}
    docs = [(i, bodies[name].split("\n\n")[-1]) for i, name in enumerate(("ISC", "BSD-3-Clause"))]
    assert all("AS IS" in text for _, text in docs)
    assert {(r[0], r[3], r[5]) for r in run(spark, docs)} == {(0, "ISC", 1.0), (1, "BSD-3-Clause", 1.0)}
