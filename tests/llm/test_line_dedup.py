import hashlib
from collections import defaultdict

from hypothesis import HealthCheck, given, settings, strategies as st

from gridspark.llm.line_dedup import drop_shared_lines

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_length, min_docs):
    def key(line):
        return line.strip(" \t\n\v\f\r").translate(UP)
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_length:
                held[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        gone = [len(s := held.get(key(x), ())) >= min_docs and i != max(s, key=lambda v: (v is not None, v or 0))
                for x in lines]
        out.append((i, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return sorted(out, key=repr)


def run(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((tuple(r) for r in drop_shared_lines(df, **kw).collect()), key=repr)


LINE = st.sampled_from(["aaaa", " AAAA\t", "bbbb", "É long line", "é long line", "", "x", "aaaa \r", "  "])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.lists(LINE, max_size=5).map("\n".join)), max_size=7))
def test_matches_brute_force(spark, texts):
    docs = list(enumerate(texts)) + [(None, "aaaa\nq")] * (len(texts) % 2)
    assert run(spark, docs, min_length=4, min_docs=3) == brute(docs, 4, 3)


def test_repeated_rows_count_as_one_document(spark):
    docs = [(1, "same line\nb"), (1, "same line\nb"), (2, "same line")]
    assert run(spark, docs, min_length=4, min_docs=3) == brute(docs, 4, 3)
    docs.append((3, "same line"))
    assert run(spark, docs, min_length=4, min_docs=3) == [(1, "b", 2, 1), (1, "b", 2, 1), (2, "", 1, 1), (3, "same line", 1, 0)]


def test_empty_table_clashing_columns_and_long_text(spark):
    assert run(spark, [], min_docs=3) == []
    df = spark.createDataFrame([(i, "n", "the same long line here\n" * 3000 + str(i), 7, "h") for i in range(3)],
                               "doc_id long, n_lines string, text string, _text_hash int, pos string")
    out = drop_shared_lines(df)
    assert out.columns == ["doc_id", "text", "_text_hash", "pos", "n_lines", "n_dropped"]
    rows = {r.doc_id: r for r in out.collect()}
    assert [rows[i].n_dropped for i in range(3)] == [3000, 3000, 0]
    assert rows[0].text == "0" and rows[2]._text_hash == 7
    assert hashlib.sha256(rows[2].text.encode()).hexdigest()


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = drop_shared_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
