"""The ten operators on small tables with nulls, empties, repeats and clashing columns, against brute force."""

import hashlib
import json
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebed.llm import ann, decontamination, kneser_ney, licenses, near, packing, quality, repeats, secret_scan, sharding, trees

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n).tolist())


def rows():
    base = text(1, 60)
    near_copy = base.split()
    near_copy[30] = "changed"
    out = [
        (1, base),
        (2, base),
        (3, " ".join(near_copy)),
        (4, "Lead in words here. " + base + " tail"),
        (5, text(5, 40)),
        (6, None),
        (7, ""),
        (8, " \t\n"),
        (9, "One"),
        (10, "one"),
        (11, "x" * 5000),
        (12, " ".join(["again"] * 300)),
        (13, "line one\n" * 40),
        (None, base),
        (5, text(5, 40)),
        (14, "ÉTÉ été \x1c b"),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    extra = "struct<a:int>"
    return spark.createDataFrame(rows(), "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("component", F.lit("c")).withColumn("shard", F.lit(None).cast(extra))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def lower(t):
    return (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def key(r):
    return tuple((x is None, x) for x in r)


def test_repeats(docs, none):
    low = {}
    for i, t in rows():
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            if i is not None:
                low[tuple(w[k : k + 13])] = min(low.get(tuple(w[k : k + 13]), i), i)
    want = []
    for i, t in rows():
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and low[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r)[:4] for r in repeats.remove_repeats(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] for r in got) > 100
    assert repeats.remove_repeats(none).count() == 0


def test_locate_against_brute_force():
    rng = np.random.default_rng(3)
    texts = [[b"%d" % x for x in rng.integers(0, 3, rng.integers(0, 80))] for _ in range(40)]
    passages = [(i, t) for i, t in enumerate(texts) if len(t) >= 5]
    got = repeats.locate(texts, list(range(40)), passages, 5)
    for i, t in enumerate(texts):
        earlier = {tuple(p[k : k + 5]) for d, p in passages if d < i for k in range(len(p) - 4)}
        want = bytearray(len(t))
        for k in range(len(t) - 4):
            if tuple(t[k : k + 5]) in earlier:
                want[k : k + 5] = b"\1" * 5
        assert got[i] == want


def test_sharding(docs, none, spark):
    d = docs.drop("shard")
    got = sharding.shard(d, F.col("text"), [F.col("doc_id"), F.col("text")], shards=5).collect()
    n = Counter(r["shard"] for r in got)
    assert len(got) == len(rows()) and max(n.values()) - min(n.values()) <= 1 and set(n) <= set(range(5))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(none.drop("shard"), F.col("text"), [F.col("doc_id")]).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    old, sharding.BLOCK_ROWS = sharding.BLOCK_ROWS, 100
    try:
        a = {r["doc_id"]: r["shard"] for r in sharding.shard(hot, F.col("k"), [F.col("doc_id")], shards=8).collect()}
        b = {r["doc_id"]: r["shard"] for r in sharding.shard(hot.where("doc_id < 2990"), F.col("k"), [F.col("doc_id")], shards=8).collect()}
    finally:
        sharding.BLOCK_ROWS = old
    assert set(Counter(a.values()).values()) == {375}
    assert sum(a[i] != b[i] for i in b) < 0.5 * len(b)


def test_arcs_overflow_clockwise():
    assert sharding.assign_arcs([5, 0, 1], [0, 1, 2], [2, 2, 2]) == [(0, 0, 2, 0, 0), (2, 0, 1, 2, 0), (0, 2, 4, 1, 0), (0, 4, 5, 2, 1)]


def shingles(t, k):
    w = lower(t).split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("k", "least", "bands", "band_rows"), [(3, (85, 100), 30, 5), (5, (80, 100), 30, 4)])
def test_near_duplicates(docs, none, k, least, bands, band_rows, spark):
    more = [(100 + i, " ".join(["common"] + [w if j % 17 != i % 17 else f"v{i}" for j, w in enumerate(text(9, 90).split())])) for i in range(30)]
    every = rows() + more
    sets = [(i, shingles(t, k)) for i, t in every if i is not None]
    pairs = [(a, b) for a, s in sets for b, z in sets if a < b and s and z and least[1] * len(s & z) >= least[0] * len(s | z)]
    want = components(pairs, {i for i, _ in sets})
    d = docs.select("doc_id", "text", "component").union(spark.createDataFrame(more, "doc_id long, text string").withColumn("component", F.lit("c")))
    got = near.near_duplicates(d, k, least, bands, band_rows).collect()
    assert len(got) == len(every)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
    assert near.near_duplicates(none, k, least, bands, band_rows).count() == 0


def test_signature_collision_rate():
    """Bins of two sets agree with about the probability of their similarity, with empty bins filled too."""
    rng, order = np.random.default_rng(0), near.probes(120)
    hits = []
    for _ in range(200):
        u = np.unique(rng.integers(0, 1 << 64, 30, dtype=np.uint64))
        a, b = np.sort(u[:27]), np.sort(u[3:])
        hits.append((near.signature(a, 120, order) == near.signature(b, 120, order)).mean())
    assert abs(np.mean(hits) - 24 / 30) < 0.02


def test_quality(spark, none):
    good = [(i, text(i, 50) + ".", 1) for i in range(150)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in text(i, 40).split()), 0) for i in range(75)] + [(2000 + i, " ".join(w + "###" for w in text(i, 40).split()), 0) for i in range(75)]
    d = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(5000, None), (5001, ""), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad] + [(1, None, 0), (None, 1, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(d, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(d, model).collect()}
    held = [(i, q) for i, _, q in good + bad if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 50 and np.mean([(got[i] >= 0.5) == (q == 1) for i, q in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 302
    untrained = quality.train(d, labels.where("false"))
    assert {r["score"] for r in quality.score(d, untrained).collect()} == {0.5}
    assert quality.score(none.drop("score"), model).count() == 0


def test_rules_and_their_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0) & (x[:, 1] <= 0.5)).astype(float)
    model = quality.fit_rules(x, y)
    assert ((model.predict(x) >= 0.5) == (y == 1)).mean() > 0.97
    df = spark.createDataFrame(x.tolist(), [f"c{i}" for i in range(x.shape[1])])
    got = np.array([r[0] for r in df.select(model.column([F.col(c) for c in df.columns])).collect()])
    assert np.allclose(got, model.predict(x))
    assert all(trees.holds(r, x).any() for r, _ in model.rules)


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, text(77, 20)), (2, text(78, 30)), (3, None), (4, "alpha beta"), (1, text(77, 20))], "item_id long, text string")
    changed = text(78, 30).split()
    changed[15] = "other"
    more = [(50, "Some words before, " + text(77, 20).upper() + "; and after"), (51, text(78, 30)), (52, " ".join(changed)), (53, text(77, 12)), (54, "alpha beta")]
    d = docs.select("doc_id", "text", "score").union(spark.createDataFrame(more, "doc_id long, text string").withColumn("score", F.lit(1)))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.leaks(d, items).collect()}
    assert set(got) == {(50, 1), (51, 2), (54, 4)} and all(math.isclose(v, 1) for v in got.values())
    left = {r["doc_id"] for r in decontamination.clean(d, items).collect()}
    assert left == ({i for i, _ in rows()} | {i for i, _ in more}) - {50, 51, 54}
    old, decontamination.MOST_LITERALS = decontamination.MOST_LITERALS, 5
    try:
        assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(d, items).collect()} == set(got)
    finally:
        decontamination.MOST_LITERALS = old
    assert decontamination.leaks(none, items).count() == 0 and decontamination.leaks(d, items.where("false")).count() == 0


def test_decontamination_beyond_the_radius_and_of_short_items(spark):
    of = lambda i: [f"w{x}" for x in np.random.default_rng(i).integers(0, 10**6, 50)]
    items = [(i, " ".join(of(i))) for i in range(300)] + [(901, "one"), (902, "Two three"), (903, "four five six seven"), (904, "Eight nine ten eleven twelve")]
    d = [(i, " ".join(["before", *of(i)[:25], "changed", *of(i)[26:], "after"])) for i in range(300)]
    d += [(1001, "there is one here"), (1002, "ten: two, THREE and four words"), (1003, "so four five six seven eight nine"), (1004, "two and three"), (1005, "eight nine ten eleven twelve."), (1006, "Two three"), (None, "just one")]
    d = spark.createDataFrame(d, "doc_id long, text string")
    got = decontamination.leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(i, i) for i in range(300)} | {(1001, 901), (1002, 902), (1003, 903), (1005, 904), (1006, 902), (None, 901)}
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert any(r["distance"] > 15 for r in got) and {r["first_shingle"] for r in got if r["doc_id"] == 1002} == {1}
    assert all(math.isclose(r["similarity"], 41 / 51 if r["n_shingles"] > 1 else 1) for r in got)


def test_licenses(spark, docs, none):
    more = [(60, "Under the MIT license, under THE mit License"), (61, "CC-BY-NC apache License, version 2.0"), (62, "under the mit licenses"), (63, "text\nReleased under the MIT License.\nmore"), (64, "This work is licensed under the GNU General Public License, version 3."), (60, "Under the MIT license, under THE mit License")]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = licenses.scan(d).collect()
    assert len(got) == len(rows()) + len(more)
    by = {r["doc_id"]: r for r in got}
    assert (by[60]["n_words"], by[60]["n_base"], by[60]["first_word"], by[60]["last_word"], by[60]["labels"]) == (8, 2, 0, 4, "mit")
    assert by[61]["base_labels"] == "apache-2,cc-by-nc" and by[62]["labels"] == "" and by[62]["first_word"] is None
    assert by[64]["labels"] == "gpl-3" and by[64]["base_labels"] == "" and by[64]["score"] == 1.0
    assert by[6]["n_words"] == 0 and by[14]["n_words"] == 3
    found = {(r["doc_id"], r["block"], r["label"]) for r in licenses.containment_join(d, ["doc_id"]).collect()}
    want = set()
    for i, t in rows() + more:
        for b, line in enumerate((t or "").split("\n")):
            own = set(licenses._words(line))
            for label, template in licenses.TEMPLATES:
                ws = set(licenses._words(template))
                if len(own & ws) >= 0.85 * len(ws):
                    want.add((i, b, label))
    assert found == want == {(63, 1, "mit"), (64, 0, "gpl-3")}
    assert licenses.scan(none).count() == 0


def test_wrapped_licenses(spark):
    of = dict(licenses.TEMPLATES)
    wrap = lambda t, n, mark: ("\n" + mark).join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    d = [(k * 100 + n, "Lead in.\n\n" + mark + wrap(t, n, mark) + ". Then\nmore words here.") for k, t in enumerate(of.values()) for n, mark in ((1, ""), (3, " * "), (8, "# "), (12, ""))]
    d += [(2001, "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the following conditions\r\nare met:")]
    d += [(2002, "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."), (2003, "mozilla public\n" + "far " * 60 + "\nThis Source Code Form is subject to the terms of the License v 2 0")]
    rng = np.random.default_rng(4)
    words = sorted({w for t in of.values() for w in licenses._words(t)}) + ["x"] * 9
    d += [(3000 + i, "".join(w + str(rng.choice([" ", "\n"], p=[0.8, 0.2])) for w in rng.choice(words, 300))) for i in range(20)]
    d += [(4000 + i, "".join(w + str(rng.choice([" ", "\n", "\n\n"], p=[0.7, 0.2, 0.1])) for w in ("a b " + t + " c").split() if rng.random() > 0.08)) for i in range(20) for t in of.values()]
    got = {(r["doc_id"], r["block"], r["label"], round(r["containment"], 9)) for r in licenses.containment_join(spark.createDataFrame(d, "doc_id long, text string"), ["doc_id"]).collect()}
    parts, reach = lambda t: [w for w in __import__("re").split(licenses.PARTING, t.lower()) if w], max(len(t.split()) for t in of.values())
    want = set()
    for i, t in d:
        ws = [(b, w) for b, line in enumerate(t.split("\n")) for w in parts(line)]
        blocks = [(b, {b: set(parts(line))}) for b, line in enumerate(t.split("\n"))]
        for j in range(1, len(ws)):
            if ws[j - 1][0] != ws[j][0]:
                by = defaultdict(set)
                for b, w in ws[max(0, j - reach) : j + reach]:
                    by[b].add(w)
                blocks.append((ws[j - 1][0], by))
        for label, template in licenses.TEMPLATES:
            own = set(licenses._words(template))
            for b, by in blocks:
                held = len(own & set().union(*by.values()))
                if held >= 0.85 * len(own) and (len(by) == 1 or held > max(len(own & x) for x in by.values())):
                    want.add((i, b, label, round(held / len(own), 9)))
    assert got == want
    by = {r["doc_id"]: (set(r["labels"].split(",")), r["score"]) for r in licenses.scan(spark.createDataFrame(d, "doc_id long, text string")).collect()}
    assert by[2001] == ({"bsd-3"}, 1.0) and by[2002] == ({"mpl-2"}, 1.0) and by[2003][1] < 1
    assert all(label in by[k * 100 + n][0] for k, label in enumerate(of) for n in (1, 3, 8, 12))


def test_nearest_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16))
    x = centres[rng.integers(0, 8, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    x[100:140] = x[100]
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [None] + [1.0] * 15)]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    q = d.where("vec_id % 20 = 0")
    got = defaultdict(list)
    for r in ann.search(d, q, k=20, centroids=16, probe=0.4, least=200).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for i in range(0, 1500, 20):
        s = (x * x[i]).sum(1)
        best = sorted((j for j in range(1500) if j != i), key=lambda j: (-s[j], j))[:20]
        assert len(got[i]) == 20 and i not in [v for v, _ in got[i]]
        assert all(math.isclose(s[v], c, rel_tol=1e-12) for v, c in got[i])
        assert [(-c, v) for v, c in got[i]] == sorted((-c, v) for v, c in got[i])
        hit += len({v for v, _ in got[i]} & set(best))
    assert hit / (75 * 20) >= 0.9 and set(got) == set(range(0, 1500, 20))
    few = ann.search(d.where("vec_id < 5"), q, k=20).collect()
    assert Counter(r["query_id"] for r in few)[0] == 4
    assert ann.search(d.where("false"), q).count() == 0 and ann.search(d, q.where("false")).count() == 0


@pytest.mark.parametrize("sigma", [0.5, 1.0])
def test_nearest_vectors_of_unequal_length(spark, sigma):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 32))
    x *= (np.exp(sigma * rng.normal(size=4000)) / np.sqrt((x**2).sum(1)))[:, None]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    short = F.transform("embedding", lambda v: v * 1e-3)
    q = d.where("vec_id % 80 = 0").withColumn("embedding", F.when(F.col("vec_id") % 160 == 0, short).otherwise(F.col("embedding")))
    got = defaultdict(set)
    for r in ann.search(d, q, k=20, probe=0.4, least=100).collect():
        got[r["query_id"]].add(r["vec_id"])
    best = {i: set(np.argsort(-np.where(np.arange(4000) == i, -np.inf, x @ x[i]))[:20].tolist()) for i in range(0, 4000, 80)}
    assert set(got) == set(best) and sum(len(got[i] & best[i]) for i in best) / (50 * 20) >= 0.9


def test_secrets(spark, docs, none):
    forest = secret_scan.train(spark)
    held = secret_scan.labelled_findings(600, seed=99)
    got = secret_scan.with_hits(spark.createDataFrame(held, "text string, label int"), "text", "h").select("label", F.explode("h.f").alias("f")).collect()
    p = forest.predict(np.array([r["f"] for r in got]))
    assert np.mean((p >= 0.5) == np.array([r["label"] for r in got])) > 0.93
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    line = f'é😀 see commit {secret} and token = "{secret}" end'
    d = docs.select("doc_id", "text", "score").union(spark.createDataFrame([(70, line, 1)], "doc_id long, text string, score int"))
    found = {(r["start"], r["is_secret"]) for r in secret_scan.scan(d, forest).where("doc_id = 70").collect()}
    second = line.rindex(secret)
    assert found == {(line.index(secret), False), (second, True)}
    out = {r["doc_id"]: r["text"] for r in secret_scan.redact(d, forest).collect()}
    assert out[70] == line[:second] + "[SECRET]" + line[second + 40 :]
    assert all(out[i] == t for i, t in rows() if i not in (None,)) and secret_scan.redact(d, forest).columns == d.columns
    assert secret_scan.scan(none, forest).count() == 0


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack_documents(docs, max_len=64).collect()
    pieces = packing.tokenize_pieces(docs, "word_bpe_49k.json", 64, with_ids=True).collect()
    want = Counter()
    for i, t in rows():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], "<u4").tobytes()
            want[i, k // 64, k, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert Counter((r["doc_id"], r["piece"], r["start"], len(r["ids"]) // 4, zlib.crc32(bytes(r["ids"]))) for r in pieces) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack_documents(none).count() == 0


def test_best_fit_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 8, 4, 2)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6), (2, 8)]
    bins = packing.BestFit(10, 2)
    assert [bins.put(n)[0] for n in (6, 7, 8, 3)] == [0, 1, 2, 0]  # bin 1, with 3 free, closed for the third


def test_kneser_ney(docs, none):
    seqs = [(i, [b"<s>", *lower(t).split(), b"</s>"]) for i, t in rows()]
    c, pairs = Counter(), Counter()
    for i, w in seqs:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w[1:])
            pairs.update(zip(w, w[1:], strict=False))
    n, v = sum(c.values()), len(c)
    cont, ctx, kinds = Counter(b for _, b in pairs), Counter(), defaultdict(lambda: [0, 0, 0])
    for (a, _), k in pairs.items():
        ctx[a] += k
        kinds[a][min(k, 3) - 1] += 1
    of = lambda x: kneser_ney.discounts([sum(y == k for y in x.values()) for k in (1, 2, 3, 4)])
    d1, d2 = of(cont), of(pairs)
    cut = lambda k, d: d[min(k, 3) - 1] if k else 0
    rest = sum(cut(k, d1) for k in cont.values()) / len(pairs)
    low = lambda w: (cont[w] - cut(cont[w], d1)) / len(pairs) + rest / (v + 1)

    def p(a, b):
        if not ctx[a]:
            return low(b)
        return (pairs[a, b] - cut(pairs[a, b], d2)) / ctx[a] + sum(x * y for x, y in zip(kinds[a], d2, strict=True)) / ctx[a] * low(b)

    want = sorted((i is None, i or 0, len(w) - 1, sum(c[x] > 0 for x in w[1:]), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w[1:]), 6), round(sum(math.log10(p(a, b)) for a, b in zip(w, w[1:], strict=False)), 6)) for i, w in seqs)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in kneser_ney.score_documents(docs).collect())
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], atol=1e-5)
    assert math.isclose(sum(p(b"<s>", w) for w in c) + sum(x * y for x, y in zip(kinds[b"<s>"], d2, strict=True)) / ctx[b"<s>"] * rest / (v + 1), 1)
    assert kneser_ney.score_documents(none).count() == 0
    unlearned = kneser_ney.score_documents(docs.where("doc_id is null")).collect()
    assert len(unlearned) == 1 and unlearned[0]["held_out"] and unlearned[0]["train_tokens"] == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    item = text(77, 20)
    clean = [(i, text(i, 60)) for i in range(40)]
    planted = [(100, clean[3][1]), (101, text(901, 40) + " " + item), (102, f'{text(900, 50)} token = "{secret}"'), (103, " ".join(w.upper() + "!!" for w in text(7, 50).split()))]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in text(i, 40).split())) for i in range(60)]
    every = clean + planted + bad
    frame = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in every], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in clean + bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == frame.columns
            docs.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    own = {i for i, _ in clean}
    assert own | {100, 101, 102} == kept[0] and kept[1] == own | {101, 102} and kept[2] == own | {102} == kept[3] == kept[4]
    masked = spark.read.parquet(f"{tmp_path}/3").where("doc_id = 102").first()
    assert secret not in masked["text"] and masked["n_chars"] == len(masked["text"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_texts_of_as_many_words_as_a_shingle(spark):
    """The one shingle of a three-word text is that of longer texts; fewer words are a shingle of their own kind."""
    d = spark.createDataFrame([(1, "again again again"), (2, " ".join(["again"] * 4)), (3, " ".join(["Again"] * 9)), (4, "again again"), (5, "again")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(d, 3, (85, 100), 30, 5).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
