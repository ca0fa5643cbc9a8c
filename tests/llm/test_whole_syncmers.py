"""Syncmers against a plain function, over texts of every short length."""

from trendloom.llm import syncmers


def test_anchors_by_brute_force(spark):
    texts = {(n, v): " ".join(f"v{v}n{n}w{j * 7 % 5 if v == 3 else j}" for j in range(n)) for n in range(0, 41) for v in range(6)}
    df = spark.createDataFrame([(n, v, t) for (n, v), t in texts.items()], "n int, v int, t string")
    df = syncmers.anchors(df, "t", "fp").selectExpr("*", "transform(filter(split(t, ' '), x -> x != ''), x -> xxhash64(x)) w", "transform(filter(split(t, ' '), x -> x != ''), x -> hash(xxhash64(x))) single")
    df = df.selectExpr("*", "transform(sequence(0, greatest(n - 2, 0)), i -> xxhash64(get(w, i), get(w, i + 1))) m")
    df = df.selectExpr("*", "transform(sequence(0, greatest(n - 5, 0)), i -> hash(get(m, i), get(m, i + 3), get(m, i + 2))) kmer")
    for r in df.collect():
        if r.n < 5:
            want = list(enumerate(r.single))
        else:
            want = [(i, r.kmer[i]) for i in range(r.n - 4) if min(r.m[i], r.m[i + 3]) <= min(r.m[i + 1:i + 3])]
            want = want or [min((h, i) for i, h in enumerate(r.kmer[:r.n - 4]))[::-1]]
        assert [(x.at, x.h) for x in r.fp] == want and bool(r.fp) == (r.n > 0)


def test_short_and_moved_texts(spark):
    def text(a, b):
        return " ".join(f"word{j}" for j in range(a, b))

    rows = [(100 - n, " ".join(f"x{n}y{j}" for j in range(n))) for n in range(1, 13)]
    got = syncmers.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.fingerprint and r.near_next == 0 for r in got) and all(r.near_edited > 0 for r in got if r.doc_id in (97, 96))
    pair = spark.createDataFrame([(text(0, 200), "new start of it " + text(0, 90) + " other middle words " + text(95, 200), " ".join(reversed(text(0, 200).split())))], "a string, b string, c string")
    for c in "abc":
        pair = syncmers.anchors(pair, c, f"f{c}").withColumn(f"k{c}", syncmers.matches(f"f{c}"))
    near, far = pair.select(syncmers.likeness("ka", "kb"), syncmers.likeness("ka", "kc")).head()
    assert near > 0.8 and far < 0.05
