"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeflow.llm import extraction, gif, jaccard, langid, licenses, line_dedup, merkle, mixing, packing, periodic, token_records, topk, toxicity
from routeflow.llm.storage import documents


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(gif.text_gifs(documents(spark, sf_dir)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(langid.crc_fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(langid.crc_fold(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.where(~held_out), labels.where(~held_out))
    out = toxicity.score(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])
    return out.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_records.write_records(documents(spark, sf_dir), vocabulary(), end_id=2)
    return token_records.read_records(manifest).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary(), end_id=0)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("templates")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extraction.extract(pages, extraction.fit(pages))


def _repeating(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text); one in ten gets a part that repeats, in place of its own words from there on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.when((h % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    rows = docs.select("doc_id", "text", words.alias("w"), F.size(words).cast("long").alias("n"), g.alias("g"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1).cast("int"))
    a, p = F.col("a").cast("int"), F.col("p")
    changed = F.array_join(F.transform("w", lambda w, i: F.when(i < a, w).otherwise(F.get("w", a + (i - a) % p))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.collapse_runs(_repeating(documents(spark, sf_dir).select("doc_id", "text")))
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(more(y, x), y).otherwise(x))  # runs come by start, then period
    line = lambda r: F.concat(*[x for c in ("start", "length", "period") for x in (F.lit(","), r[c])][1:], F.lit("\n"))
    found = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    names = ("doc_id", "source", "lang", "n_chars")
    digest = lambda text: merkle.leaf(*[F.col(c) for c in names], text)
    rows = docs.select("doc_id", "lang", digest(F.col("text")).alias("leaf"), F.when(langid.crc_fold(F.col("doc_id"), 3) == 0, digest(F.translate("text", line_dedup.UPPER, line_dedup.LOWER))).alias("tampered"))
    out = merkle.manifest(rows, "lang", "doc_id", "leaf", ["doc_id", "tampered"])
    found = out.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP1_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
m AS (SELECT k.doc_id, k.line, k.pos, f.first IS NOT NULL AND f.first <> k.doc_id AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w, source_size * 2 AS cap FROM s),
p AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
             sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM w),
c AS (SELECT *, (cap * ws)::DOUBLE <= (total - caps::DOUBLE) * w AS capped FROM p),
o AS (SELECT *, coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)::DOUBLE AS filled, sum(w) FILTER (WHERE NOT capped) OVER () AS open FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (total - filled) * w / open::DOUBLE END AS target,
             ('0x' || substr(md5('mix:' || coalesce(source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296::DOUBLE AS u FROM o),
r AS (SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS i
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(i * e + u) - floor((i - 1) * e + u)) * size)::BIGINT AS taken FROM r
"""


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


_DIGITS = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
#: CRC-32 of a decimal number: a byte goes in, then eight bits are shifted out.
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_DIGITS}), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes (lang, lvl, idx, d) of the trees over ``leaves``, and their siblings; a tree's top has none."""
    return f"""
{name}(lang, lvl, idx, d) AS (
  SELECT lang, 0, idx, d FROM {leaves}
  UNION ALL SELECT lang, lvl + 1, idx // 8, sha256(string_agg(d, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS k FROM {name}) WHERE k > 1 GROUP BY lang, lvl, idx // 8),
{name}_top AS (SELECT lang, max(lvl) AS lvl, arg_max(d, lvl) AS d FROM {name} GROUP BY lang),
{name}_sib AS (
  SELECT a.lang, a.lvl, a.idx, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {name} a JOIN {name}_top t ON a.lang IS NOT DISTINCT FROM t.lang AND a.lvl < t.lvl
  JOIN {name} b ON a.lang IS NOT DISTINCT FROM b.lang AND a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 GROUP BY ALL)"""


OP13_SQL = f"""
WITH RECURSIVE
x AS (SELECT doc_id, lang, {_leaf_sql("text")} AS d, CASE WHEN {_CRC} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, d) - 1 AS idx FROM x),{_tree_sql("n", "l")},
g AS (SELECT 0 AS lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS idx, d, lang AS of FROM n_top),{_tree_sql("u", "g")},
f(doc_id, lang, tree, idx, lvl, a, b, p) AS (
  SELECT doc_id, lang, 0, idx, 0, coalesce(tampered, d), d, '' FROM l
  UNION ALL SELECT f.doc_id, f.lang,
    CASE WHEN s.lvl IS NULL THEN f.tree + 1 ELSE f.tree END,
    CASE WHEN s.lvl IS NOT NULL THEN f.idx // 8 WHEN f.tree = 0 THEN g.idx ELSE 0 END,
    CASE WHEN s.lvl IS NULL THEN 0 ELSE f.lvl + 1 END,
    CASE WHEN s.lvl IS NULL THEN f.a ELSE sha256(s.l || f.a || s.r) END, CASE WHEN s.lvl IS NULL THEN f.b ELSE sha256(s.l || f.b || s.r) END, f.p || coalesce(s.l || s.r, '')
  FROM f JOIN g ON f.lang IS NOT DISTINCT FROM g.of
  LEFT JOIN (SELECT 0 AS tree, lang, lvl, idx, l, r FROM n_sib UNION ALL SELECT 1, g.of, u_sib.lvl, u_sib.idx, l, r FROM u_sib CROSS JOIN g) s
    ON s.tree = f.tree AND s.lang IS NOT DISTINCT FROM f.lang AND s.lvl = f.lvl AND s.idx = f.idx
  WHERE f.tree < 2)
SELECT f.doc_id, l.d AS leaf, n_top.d AS subroot, u_top.d AS root, sha256(f.p) AS proof_sha256, f.a AS folded_root, f.a = u_top.d AS verified
FROM f JOIN l ON f.doc_id IS NOT DISTINCT FROM l.doc_id JOIN n_top ON f.lang IS NOT DISTINCT FROM n_top.lang CROSS JOIN u_top WHERE f.tree = 2
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_merkle_manifest": OP13_SQL, "op1_line_dedup": OP1_SQL, "op8_source_mixing": OP8_SQL, "op9_exact_top_k": OP9_SQL}
