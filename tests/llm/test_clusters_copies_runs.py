"""Dual-tree clustering, exact dedup and periodic runs against brute force, by function and as registered."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebed.llm import dual_tree, exact, periodic, queries

SPACE = r"[\x20\x09-\x0D]"


# -- exact dedup ----------------------------------------------------------------------------------------------------

def copies():
    long = " ".join(f"w{i}" for i in range(20_000))
    same_begin = "b" * 300
    out = [(i, "hot  text\n") for i in range(100, 160)]  # a third of all rows and more
    out += [(1, "a b c"), (2, "ab\tc"), (3, "abc "), (4, "a  b  c"), (5, None), (6, ""), (7, " \n\x0b"), (8, "abd"), (9, "xyz")]
    out += [(10, long), (11, long + " "), (12, long[:-1] + "9"), (13, same_begin + "x"), (14, same_begin + "y"), (15, same_begin + "x")]
    return [*out, (16, "é e"), (17, "é e"), (3, "abc "), (3, "abc "), (None, "abc "), (None, "alone of its kind"), (None, None)]


def same_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(SPACE, "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, own in groups.items():
        first = min(own, key=lambda x: x[:3])
        kept = False
        for x in sorted(own, key=lambda x: x[:3]):
            out.append((x[3], first[3], len(own), x[:3] == first[:3] and not kept, hashlib.sha256(norm.encode()).hexdigest()))
            kept = True
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Written tables, as the registered forms read them, with columns of clashing names."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(copies() + texts(), "doc_id long, text string")
    docs.withColumns({c: F.lit(c) for c in ("length", "whole", "row", "kept", "norm", "runs", "h", "same")}).write.parquet(f"{d}/documents.parquet")
    vectors = [(i, [float(x) for x in v], "x") for i, v in enumerate(points(700))]
    vectors += [(None, vectors[3][1], "x"), (5, vectors[5][1], "x"), (900, None, "x"), (901, vectors[0][1][:63], "x"), (902, [float("nan")] + vectors[0][1][1:], "x"), (903, [None] + vectors[0][1][1:], "x")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, cluster string").write.parquet(f"{d}/embeddings.parquet")
    return d


def test_exact_groups(spark):
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x"))
    docs = docs.withColumn("row", F.sha2(exact.normalised(F.col("text")), 256)).repartition(3)
    got = exact.exact_groups(docs, carry=["row"])
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "row"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == same_groups(rows)
    assert exact.exact_groups(docs.where("false")).count() == 0


def test_exact_groups_where_every_slot_is_shared(spark, monkeypatch):
    """The filters let all rows pass when they are full; heavy and light groups give the same."""
    monkeypatch.setattr(exact, "FILTER_ROWS", 1)
    rows = [(i, f"text {i % 40}" if i % 3 else "hot") for i in range(300)]
    for share in (0.0, 1 / 1000, 1.0):
        monkeypatch.setattr(exact, "HEAVY", share)
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.sha2(exact.normalised(F.col("text")), 256))
        assert sorted((tuple(r) for r in exact.exact_groups(docs, carry=["h"]).collect()), key=repr) == same_groups(rows)


def test_exact_dedup_as_registered(spark, tables):
    got = queries.QUERIES["op12_exact_dedup"](spark, tables).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == same_groups(copies() + texts())


# -- periodic runs --------------------------------------------------------------------------------------------------

def slow_runs(words):
    """All runs by trying every lag and place."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def texts():
    rng = np.random.default_rng(5)
    say = lambda n, k: [f"v{x}" for x in rng.integers(0, k, n)]
    long = say(9000, 4000) + say(7, 100) * 50 + say(11000, 4000)
    return [
        (200, " ".join(long)),
        (201, "a " * 6),
        (202, "a b " * 4),
        (203, "a b " * 3),
        (204, "a a a a a a b " * 9),
        (205, "x " + "a b c " * 5 + "a q " + "q " * 7),
        (206, None),
        (207, "\n"),
        (208, "É é  " * 12),
        (None, "n n n n n n n"),
        (209, "a b " * 5),
        (209, "a b " * 5),
        *[(300 + i, " ".join(say(60, 2))) for i in range(40)],
        *[(400 + i, " ".join(say(3, 9) * 9 + say(2, 2) * 20)) for i in range(40)],
    ]


def test_runs_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(400):
        words = rng.integers(0, rng.integers(1, 4), rng.integers(0, 70)).tolist()
        if rng.random() < 0.5:
            words = words[:9] * int(rng.integers(1, 8)) + words
        assert periodic.find_runs(words) == slow_runs(words)


def test_long_runs_and_least_values():
    words = [f"w{i}" for i in range(5000)] * 4 + ["end"]
    assert periodic.find_runs(words) == [(0, 20_000, 5000)]
    assert periodic.find_runs(list("abcabc"), least_periods=2) == [(0, 6, 3)]
    assert periodic.find_runs(list("abcabc")) == [] and periodic.find_runs([]) == []


def run_rows(rows, planted=False):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if planted and h % 10 == 0 and w:
            a, g, n = h // 10 % len(w), h // 10, len(w)
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = slow_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        out.append((i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_periodic_runs(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").withColumns({"runs": F.lit(1), "n_words": F.lit("x")})
    got = periodic.periodic_runs(docs)
    assert sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got.collect()), key=repr) == sorted(run_rows(texts()), key=repr)
    assert periodic.periodic_runs(docs.where("false")).count() == 0


def test_periodic_runs_as_registered(spark, tables):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, _, runs, kept in run_rows(copies() + texts(), planted=True):
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        four = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        want.append((i, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept)))
    got = queries.QUERIES["op13_periodic_runs"](spark, tables)
    assert got.columns[1:6] == ["n_runs", "start", "length", "period", "exponent_milli"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert any(w[1] for w in want if w[0] is not None and zlib.crc32(str(w[0]).encode()) % 10 == 0)


# -- clustering -----------------------------------------------------------------------------------------------------

def points(n, spread=0.05, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(9, 64))[rng.integers(0, 9, n)] * 0.2 + rng.normal(size=(n, 64)) * spread
    x[: n // 3] = x[0]  # a third of all rows are equal
    return x.astype(np.float32)


def slow_clusters(rows, k=8, rounds=10):
    rows = [(i, [int(v) for v in np.floor(np.array(x, float) * 1024).tolist()]) for i, x in rows]
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    x, c = np.array([r[1] for r in rows], object), np.array([r[1] for r in order[:k]], object)
    near = lambda: ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        own = np.array([min(range(len(c)), key=lambda j: (d[j], j)) for d in near()])
        for j in set(own.tolist()):
            c[j] = [int(s) // int((own == j).sum()) for s in x[own == j].sum(axis=0)]
    d = near()
    own = [min(range(len(c)), key=lambda j: (r[j], j)) for r in d]
    top = dual_tree.MOST_LONG
    total = [sum(int(d[i][j]) if d[i][j] < top else top for i in range(len(rows)) if own[i] == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, r.tolist())).encode()).hexdigest() for r in c]
    return sorted(((rows[i][0], own[i], min(int(d[i][own[i]]), top), min(total[own[i]], top), min(sum(total), top), sha[own[i]]) for i in range(len(rows))), key=repr)


def test_cover_tree():
    x = np.floor(points(600).astype(float) * 1024)
    t = dual_tree.cover_tree(x)
    assert sorted(t.order.tolist()) == list(range(600)) and (t.lo[0], t.hi[0]) == (0, 600)
    for node, kids in enumerate(t.kids):
        own = x[t.order[t.lo[node] : t.hi[node]]]
        assert np.sqrt(((own - x[t.centre[node]]) ** 2).sum(1)).max() <= t.radius[node] + 1e-9
        if kids:  # a node's points are its children's, and its own centre is one of theirs
            assert sorted((t.lo[k], t.hi[k]) for k in kids)[0][0] == t.lo[node] and sum(t.hi[k] - t.lo[k] for k in kids) == t.hi[node] - t.lo[node]
            assert t.centre[node] in [t.centre[k] for k in kids]
    one = dual_tree.cover_tree(np.zeros((50, 3)))
    assert one.kids == [[]] and one.hi == [50]


def test_pruning_leaves_few_exact_pairs():
    x = np.floor(points(2000, spread=0.02).astype(float) * 1024)
    t = dual_tree.cover_tree(x)
    c = x[:1]
    for _ in range(7):  # the vector farthest from those so far: clusters of their own
        c = np.vstack([c, x[((x[:, None] - c[None]) ** 2).sum(2).min(1).argmax()]])
    c = c.astype(np.int64)
    over = dual_tree.cover_tree(c.astype(float), leaf=1)
    number, compared = dual_tree.assign(x[t.order].astype(np.int64), x, t, c, c.astype(float), over)
    assert number.tolist() == dual_tree.exact_squares(x[t.order].astype(np.int64), c).argmin(1).tolist()
    assert compared < 0.5 * len(x) * len(c)


@pytest.mark.parametrize("size,scale", [(3, 1.0), (300, 1.0), (300, 1e30), (60, 1e12)])
def test_clusters(spark, size, scale):
    x = (points(size).astype(float) * scale).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = dual_tree.cluster(df, rounds=10 if scale == 1 else 3)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == slow_clusters(rows, rounds=10 if scale == 1 else 3)


def test_clusters_of_nothing(spark):
    assert dual_tree.cluster(spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_clusters_as_registered(spark, tables):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points(700))]
    rows += [(None, rows[3][1]), (5, rows[5][1])]
    got = queries.QUERIES["op11_dual_tree_lloyd"](spark, tables)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == slow_clusters(rows)
