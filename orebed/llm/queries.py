"""The registered queries of this subpackage: thin forms of the operators over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontamination, dual_tree, exact, kneser_ney, licenses, near, packing, periodic, quality, repeats, secret_scan, sharding
from .shared import let


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_documents(spark, sf_dir)).drop("spans", "kept")


def op2_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by their texts' places on the ring; copies lie together while their shard has room."""
    text = F.coalesce("text", F.lit(""))
    rows = _documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"))
    dealt = sharding.shard(rows, F.col("key"), [F.col("doc_id"), F.col("text_crc32")])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_minhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_documents(spark, sf_dir), shingle_words=3, least=(85, 100), bands=30, rows=5)


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out is true for a null doc_id, which has no label to learn from."""
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (~quality.training_row(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds: a row for each pair."""
    return decontamination.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return secret_scan.scan(docs, secret_scan.train(spark, corpus=docs))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_documents(_documents(spark, sf_dir))


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(exact.normalised(F.col("text")), 256))
    return exact.exact_groups(docs, carry=["text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), every tenth by crc32 of its id with the words from a place on repeated; a null id is left alone."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("h div 10")

    docs = docs.withColumn("h", h)
    split = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeat(words):
        n = F.size(words)
        a = (g % n).cast("int")
        period = F.floor((n - a) / (F.lit(3) + g % 8)).cast("int") + 1
        return let(F.struct(words.alias("w"), a.alias("a"), period.alias("p")), lambda x: F.array_join(F.transform(x["w"], lambda w, i: F.when(i < x["a"], w).otherwise(F.get(x["w"], x["a"] + (i - x["a"]) % x["p"]))), " "))

    changed = let(split, lambda words: F.when(F.size(words) > 0, repeat(words)))
    return docs.withColumn("text", F.when(F.col("h") % 10 == 0, changed).otherwise(F.col("text"))).drop("h")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(_documents(spark, sf_dir).select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.withColumns({"best": best, "n_runs": F.size("runs").cast("long"), "lines": F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")})
    return rows.select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * -best.l div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_repeated_phrases,
        op2_bounded_ring,
        op3_minhash_near,
        op4_rule_ensemble,
        op5_simhash_windows,
        op6_license_scan,
        op7_multi_index,
        op8_secret_scan,
        op9_best_fit_packing,
        op10_kneser_ney,
        op11_dual_tree_lloyd,
        op12_exact_dedup,
        op13_periodic_runs,
    )
}
WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _lloyd_sql(k: int = 8, rounds: int = 10) -> str:
    """Rounds as steps, each materialised."""
    away = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    steps = ["""x as materialized (select vec_id, list_transform(embedding, lambda e: cast(floor(1024 * e::double) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64)"""]
    steps.append(f"c0 as materialized (select row_number() over (order by h) - 1 as cluster, v as c from (select v, sha256('3:' || vec_id) as h from x order by h limit {k}))")
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select vec_id, v, cluster, d from (select x.vec_id, x.v, cluster, {away} as d, row_number() over (partition by x.vec_id order by {away}, cluster) as n from x, c{r}) where n = 1)")
        if r < rounds:
            steps.append(f"s{r} as (select cluster, i, cast(floor(sum(v[i]) / count(*)) as bigint) as m from a{r}, unnest(range(1, 65)) t(i) group by cluster, i), m{r} as (select cluster, list(m order by i) as c from s{r} group by cluster)")
            steps.append(f"c{r + 1} as materialized (select c{r}.cluster, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} using (cluster))")
    last = f"""select vec_id, cast(cluster as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(c, ',')) as centroid_sha256 from a{rounds} join c{rounds} using (cluster)"""
    return "with " + ",\n".join(steps) + "\n" + last


SQL: dict[str, str] = {
    "op1_repeated_phrases": f"""with w as (select doc_id, coalesce({WORDS}, []) as ws from documents), win as (select doc_id, i, array_to_string(ws[i + 1:i + 13], ' ') as s from w, unnest(range(0, len(ws) - 12)) t(i)),
firsts as (select s, min(doc_id) as first from win group by s), gone as (select distinct doc_id, unnest(range(i, i + 13)) as k from win join firsts using (s) where first < doc_id),
each as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as k from w),
kept as (select e.doc_id, count(g.k) as n_removed, string_agg(word, ' ' order by e.k) filter (where g.k is null) as text from each e left join gone g using (doc_id, k) group by e.doc_id)
select w.doc_id, len(ws) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept using (doc_id)""",
    "op3_minhash_near": f"""with recursive w as (select doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') as ws from documents),
sets as materialized (select doc_id, list_distinct(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as shingles from w),
each as (select doc_id, unnest(shingles) as s from sets), shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from each a join each b using (s) where a.doc_id <> b.doc_id group by 1, 2),
links as materialized (select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 85 * (len(x.shingles) + len(y.shingles) - n)),
reach as (select doc_id as node, doc_id as other from sets union select node, b from reach join links on a = other)
select doc_id, cast(len(shingles) as bigint) as n_shingles, component_id, component_id = doc_id as kept from sets join (select node as doc_id, min(other) as component_id from reach group by node) using (doc_id)""",
    "op11_dual_tree_lloyd": _lloyd_sql(),
    # crc32 bit by bit; islands of equal words q apart are runs, of one stretch the smallest q
    "op13_periodic_runs": f"""with d as (select doc_id, coalesce({WORDS}, []) as w, xor(list_reduce(range(0, 8 * length(doc_id::varchar)), lambda c, t:
    xor((case when t % 8 = 0 then xor(c, ascii(substr(doc_id::varchar, t // 8 + 1, 1))) else c end) >> 1, 3988292384 * ((case when t % 8 = 0 then xor(c, ascii(substr(doc_id::varchar, t // 8 + 1, 1))) else c end) & 1)), 4294967295::bigint), 4294967295) as h from documents),
p as (select doc_id, w, len(w) as n, h // 10 as g, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from d),
planted as (select doc_id, case when a is null then w else list_transform(range(0, n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) end as w from p),
each as materialized (select doc_id, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from planted),
same as (select x.doc_id, y.i - x.i as q, x.i from each x join each y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and y.i - x.i <= x.n // 4),
islands as (select doc_id, q, min(i) as start, count(*) + q as length from (select *, i - row_number() over (partition by doc_id, q order by i) as island from same) group by doc_id, q, island having count(*) + q >= greatest(6, 4 * q)),
runs as materialized (select doc_id, start, length, min(q) as period from islands group by doc_id, start, length),
best as (select doc_id, start, length, period from (select *, row_number() over (partition by doc_id order by length desc, start, period) as n from runs) where n = 1),
lines as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as said from runs group by doc_id),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
kept as (select e.doc_id, string_agg(word, ' ' order by e.i) as text from each e anti join gone using (doc_id, i) group by e.doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli, sha256(coalesce(said, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from d left join lines using (doc_id) left join best using (doc_id) left join kept using (doc_id)""",
    "op12_exact_dedup": """with d as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as norm from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size, row_number() over w = 1 as kept, sha256(norm) as text_sha256 from d
window w as (partition by norm order by length(text) desc, doc_id rows between unbounded preceding and unbounded following)""",
}
