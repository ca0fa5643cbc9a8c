"""Licence passages beyond the openings, own templates, and chained spans."""

from trendloom.llm import licenses


def spans(spark, text, **more):
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), **more).head()
    return r, {(s.template, s.start, s.end, s.covered, round(s.coverage, 4)) for s in r.spans}


def test_later_part_of_a_whole_licence(spark):
    words = licenses.whole_texts()["apache-2.0"].split()
    r, got = spans(spark, "intro words " + " ".join(words[900:1000]) + " tail")
    assert ("apache-2.0", 2, 102, 100, round(100 / len(words), 4)) in got and "apache-2.0" in r.labels.split(",") and r.score == 1.0
    assert {"mpl-2.0", "gpl-3", "bsd", "mit"} <= set(licenses.whole_texts())


def test_own_templates_chain_by_template(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(20)]
    own = {"one": " ".join(a), "two": " ".join(b + a[10:30])}
    text = a[:20] + ["x"] * 3 + a[25:45] + ["y"] * 30 + b[:10] + ["z"] + a[30:40]
    r, got = spans(spark, " ".join(text), templates=own)
    assert got == {("one", 0, 43, 40, round(40 / 60, 4)), ("one", 84, 94, 10, round(10 / 60, 4)), ("two", 10, 20, 10, 0.25), ("two", 73, 83, 10, 0.25)}
    assert r.labels == "one,two" and r.base_labels == ""


def test_order_of_the_template_counts(spark):
    a = [f"a{i}" for i in range(60)]
    _, got = spans(spark, " ".join(a[40:60] + a[:20]), templates={"one": " ".join(a)})
    assert got == {("one", 0, 20, 20, round(20 / 60, 4)), ("one", 20, 40, 20, round(20 / 60, 4))}
