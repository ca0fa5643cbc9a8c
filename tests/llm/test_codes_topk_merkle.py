"""Vector codes, exact top-k and the Merkle manifest against plain versions, and their defined cases."""

import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.llm import merkle, norm_buckets, vector_codes


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Vector codes

@pytest.mark.parametrize("spread", [2, 600, 1 << 24])
def test_tree_finds_the_nearest_of_lowest_index(spread):
    rng = np.random.default_rng(spread)
    points = rng.integers(-spread, spread + 1, (256, 6))
    points[40:60] = points[7]  # equal entries
    q = np.r_[rng.integers(-spread, spread + 1, (500, 6)), points]
    d = ((q[:, None] - points[None]) ** 2).sum(2)
    tree = vector_codes.Gnat(points)
    index, d2 = tree.nearest(q)
    assert (index == d.argmin(1)).all() and (d2 == d.min(1)).all()
    assert vector_codes.Gnat(points[:1]).nearest(q)[0].max() == 0


def test_tree_leaves_out_whole_subtrees():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (16, 8))
    points = (centres[:, None] + rng.integers(-20, 20, (16, 16, 8))).reshape(-1, 8)
    tree = vector_codes.Gnat(points)
    q = points + 1
    index, d2 = tree.nearest(q)
    d = ((q[:, None] - points[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (d2 == d.min(1)).all()
    assert tree.measured < 0.25 * len(q) * len(points)


def plain_codes(rows, entries=256, rounds=4):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max([4, *(-(-len(v) // 4) * 4 for _, v, _ in kept)])
    kept = [(i, v + [0] * (dim - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    w = dim // 4
    books = [[r[1][p * w : p * w + w] for r in first] for p in range(4)]

    def near(p, v):
        d = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(4):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[near(p, v[p * w : p * w + w])[0]].append(v[p * w : p * w + w])
            for e, vs in own.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
    out, per = [], defaultdict(int)
    for i, v, label in kept:
        found = [near(p, v[p * w : p * w + w]) for p in range(4)]
        out.append((i, "".join(f"{f[0]:02x}" for f in found), sum(f[1] for f in found), label))
        per[label] += out[-1][2]
    digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, per[label], digest) for i, c, e, label in out), key=str)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8)], int(i) % 3) for i in range(300)]
    rows += [(i, rows[0][1], None) for i in range(300, 400)]  # one vector a third of all
    rows += [(None, rows[1][1], 1), (7, rows[2][1], None), (7, rows[2][1], None), (401, None, 1), (402, [None] * 8, 1), (403, [float("nan")] * 8, 1), (404, [float("inf")] + [0.0] * 7, 1), (405, [1.0, 2.0, 3.0], 2), (406, [], 2), (407, [0.0] * 8, 2)]
    return rows


KIND = "vec_id long, embedding array<float>, label int"


def test_codes(spark, vectors):
    df = spark.createDataFrame(vectors, KIND)
    got = values(vector_codes.encode(df))
    assert got == plain_codes(vectors) and len(got) == len(vectors) - 4
    extra = df.select("*", *[F.lit("x").alias(c) for c in ("v", "code", "error", "label_error", "_salt", "e", "part", "entry", "n", "s")])
    assert values(vector_codes.encode(extra)) == got
    assert values(vector_codes.encode(df.limit(0))) == []
    few = vectors[:5]
    assert values(vector_codes.encode(spark.createDataFrame(few, KIND))) == plain_codes(few)


def test_codes_hold_huge_components(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0], 1), (2, [-1e30, 0.0, 0.0, 0.0], 1)], KIND)
    assert [r.error for r in vector_codes.encode(df).collect()] == [0, 0]


# Exact top-k

def plain_topk(rows, every, k):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for qid in sorted({i for i, _ in kept if i % every == 0}):
        q = min(v for i, v in kept if i == qid)
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in kept if i != qid)[:k]
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket,queries,first", [(4096, 16384, 1024), (32, 4, 3)])
def test_topk(spark, vectors, bucket, queries, first):
    df = spark.createDataFrame(vectors, KIND)
    got = values(norm_buckets.search(df, 50, 5, bucket=bucket, queries=queries, first=first))
    assert got == plain_topk(vectors, 50, 5)
    extra = df.select("*", *[F.lit("x").alias(c) for c in ("v", "norm", "h", "group", "bucket", "share", "kind", "bound", "query_id", "rank", "score")])
    assert values(norm_buckets.search(extra, 50, 5, bucket=bucket)) == got
    assert values(norm_buckets.search(df.limit(0))) == []
    assert values(norm_buckets.search(df.filter("vec_id in (0, 1, 2)"))) == plain_topk(vectors[:3], 50, 5)


def test_topk_of_uneven_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 5) * rng.lognormal(0, 1)], 0) for i in range(3000)]
    got = values(norm_buckets.search(spark.createDataFrame(rows, KIND), 50, 5, bucket=100))
    assert got == plain_topk(rows, 50, 5)


def test_every_kind_of_pruning_is_used_and_exact():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (2000, 4))
    x = np.floor(x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(900, 1000, (2000, 1))).astype(np.int64)  # a bucket: like lengths
    q = np.floor(rng.normal(0, 200, (200, 4))).astype(np.int64)
    b, ids = norm_buckets.Bucket(np.arange(2000), x), np.arange(5000, 5200)
    truth = q @ x.T
    for bounds in ([None] * 200, [int(t) for t in np.sort(truth, 1)[:, -5]], [int(t) for t in np.linalg.norm(q, axis=1) * 1100 + 1], [-(10**9)] * 200):
        found = {int(i): (list(map(int, r)), list(map(int, s))) for i, r, s in b.search(ids, q, bounds, 5)}
        for i in range(200):
            want = sorted(((-int(s), j) for j, s in enumerate(truth[i]) if bounds[i] is None or s >= bounds[i]))[:5]
            assert found.get(5000 + i, ([], [])) == ([j for _, j in want], [-s for s, _ in want])
    assert all(b.chosen.values()) and b.chosen["coordinate"] > 50


# Merkle manifest

def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def leaf(r):
        return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))

    def proofs(nodes):
        """The root, and for every node its levels: nodes to the left and to the right in its run."""
        way, spots = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            groups = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
            for j, s in enumerate(spots):
                way[j].append((groups[s // 3][: s % 3], groups[s // 3][s % 3 + 1 :]))
            nodes, spots = [h(*g) for g in groups], [s // 3 for s in spots]
        return nodes[0], way

    by = defaultdict(list)
    for r in rows:
        doc_id, text, lang, source, n_chars = r
        own = (doc_id, source, lang, n_chars, text)
        bare = own if doc_id is None or text is None or zlib.crc32(str(doc_id).encode()) % 2 else (*own[:4], text.replace("\n", ""))
        by[source].append((doc_id is not None, doc_id or 0, leaf(own), leaf(bare), doc_id))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [(sorted(by[s]), *proofs([x[2] for x in sorted(by[s])])) for s in order]
    root, upper = proofs([t[1] for t in trees])
    out = []
    for (nodes, subroot, ways), above in zip(trees, upper):
        for (_, _, own, now, doc_id), way in zip(nodes, ways):
            way = way + above
            for left, right in way:
                now = h(*left, now, *right)
            out.append((doc_id, own, subroot, root, h(*(x for left, right in way for x in left + right)), now, now == root))
    return sorted(out, key=str)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_manifest_of_long_and_many_sources(spark):
    rows = [(i, f"text\n{i}", "en", "hot", i) for i in range(2300)] + [(10_000 + i, "a\nb" if i % 2 else None, None, f"s{i}", None) for i in range(800)] + [(20_000 + i, "x\n", "en", "three", 1) for i in range(3)]
    got = values(merkle.manifest(spark.createDataFrame(rows, DOCS)))
    assert got == plain_manifest(rows)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_defined_cases(spark):
    rows = [(None, None, None, None, None), (None, "\n", "en", None, 1), (1, "a", "en", "é", 1), (1, "a", "en", "é", 1), (1, "b\n", "en", "é", 1), (2, "", "", "", 0), (5, "日本\n" * 50000, "ja", "z", 150000), (-4, "neg\n", "en", "z", 1), (6, "\U0001f600\n", "en", "￿", 1), (8, "y", "en", "\U0001f600", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = values(merkle.manifest(df))
    assert got == plain_manifest(rows)
    extra = df.select("*", *[F.lit("x").alias(c) for c in ("g", "leaf", "tampered", "idx", "n", "digest", "_u", "_part", "chunk", "top", "children", "path", "root", "subroot")])
    assert values(merkle.manifest(extra)) == got
    assert values(merkle.manifest(df.limit(0))) == []
    assert values(merkle.manifest(df.limit(1).select(*df.columns))) == plain_manifest(rows[:1])


def test_descent_follows_the_digits():
    leaves = [h(str(i)) for i in range(20)]
    store, level = {}, leaves
    while len(level) > 1:
        level = [store.setdefault(h(*level[i : i + 3]), level[i : i + 3]) and h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    for i, leaf in enumerate(leaves):
        way, node = merkle.segment(store, level[0], i, merkle.depth(20))
        assert node == leaf and merkle.read_path(merkle.written_path(way)) == way
