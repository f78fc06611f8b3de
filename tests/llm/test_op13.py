"""Fill-in-middle against a version that cuts lists of units in Python."""

import hashlib
import re

from pyspark.sql import functions as F

from weftgraph.llm import op13_infill as infill

MARKERS = ("<P>", "<S>", "<M>")
ODD = ["\u0001", "\u0002", "\u0002\u0001a", "a\u00020\u00021b", "\u0001\u0001\u0002\u0002", "x<P>y", "<S", "<M>", "<<P<", "S><M", "P>", "😀é日\n\r\n\tz", "$0 \\1 $", "ab" * 5000 + " ", ". \u0085."]


def expected(key, text, changed=90, suffix_first=20):
    text = text or ""
    u = re.findall(r"(?s)[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in MARKERS) or h[2] % 100 >= changed:
        return len(u), "plain", None, None, None, text
    if h[3] % 100 < suffix_first:
        return len(u), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def key_of(row):
    return repr(row)


def test_against_lists(spark, docs_with_odd_rows):
    rows = [(r.doc_id, r.text) for r in docs_with_odd_rows.collect()]
    rows += [(1000 + 20 * i + k, t) for i, t in enumerate(ODD) for k in range(20)] + [(None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for changed, suffix_first in ((90, 20), (100, 50)):
        made = infill.transformed(docs, changed=changed, suffix_first=suffix_first)
        got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
        assert all(r.back == (r.text or "") for r in got)
        assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in got), key=key_of) == sorted(((i, t, *expected(i, t, changed, suffix_first)) for i, t in rows), key=key_of)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_names_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("a", "one two", 1, 2, 3)], "doc_id string, text string, `__text` int, form int, `__h` int")
    out = infill.transformed(docs)
    assert out.columns == ["doc_id", "text", "__text", "__h", "n", "form", "prefix", "middle", "suffix", "output"]
    r = out.first()
    assert (r.n, r.form, r.prefix, r.middle, r.suffix, r.output) == expected("a", "one two")
    assert infill.transformed(docs.limit(0)).collect() == []


def test_query_stays_in_the_jvm(spark):
    plan = infill.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert plan.count("regexp_replace") == 1
