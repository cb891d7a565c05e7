"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import dialogue, hnsw, langid, licenses, linededup, lloyd, mixing, neardup, onlinepack, packing, quality, substrings, vectordup
from tidemark.llm.oracles import OP11_SQL, OP13_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.KEEP_FROM).cast("int").alias("predicted"))


def op2_vectordup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectordup.similar_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs)


#: The shares by largest remainder, one period of the schedule slot by slot, and every row's block, slot and place.
OP3_SQL = """
WITH RECURSIVE size AS (
  SELECT source, count(*) ** 0.5 AS w, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM documents GROUP BY source
), exact AS (
  SELECT source, i, greatest(0.0, w / sum(w) OVER () * greatest(1000, count(*) OVER ()) - 1) AS e, greatest(1000, count(*) OVER ()) - count(*) OVER () AS spare FROM size
), scaled AS (
  SELECT source, i, spare, e * spare / sum(e) OVER () AS e FROM exact
), got AS (
  SELECT source, i, floor(e) AS g, row_number() OVER (ORDER BY floor(e) - e, i) AS r, spare - sum(floor(e)) OVER () AS more FROM scaled
), share AS (
  SELECT source, i, CAST(g + 1 + CASE WHEN r <= more THEN 1 ELSE 0 END AS BIGINT) AS n FROM got
), plan AS (
  SELECT list(n ORDER BY i) AS n, CAST(sum(n) AS BIGINT) AS d FROM share
), step AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(n, lambda x: CAST(0 AS BIGINT)) AS c, CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS j FROM plan
  UNION ALL
  SELECT t + 1, list_transform(c, lambda x, k: x + CASE WHEN k = p THEN 1 ELSE 0 END), p, c[p]
  FROM (SELECT t, c, d, list_min(list_transform(range(1, len(n) + 1), lambda k:
          CASE WHEN c[k] < n[k] AND c[k] * d // n[k] <= t THEN ((c[k] + 1) * d + n[k] - 1) // n[k] * 100000 + k ELSE 1000000000000 END)) % 100000 AS p
        FROM step, plan WHERE t < d)
), slots AS (
  SELECT pick AS i, j, t - 1 AS at FROM step WHERE t > 0
), ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents
)
SELECT k.doc_id, k.source, k.r // 16 AS block, k.r // 16 // s.n * p.d + t.at AS slot, CAST(k.r % 16 AS INTEGER) AS place
FROM ranked k JOIN share s ON k.source IS NOT DISTINCT FROM s.source CROSS JOIN plan p JOIN slots t ON t.i = s.i AND t.j = k.r // 16 % s.n
"""


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree, source/lang/thousands/id, those under 1000 in source/lang; a notice in the first or last line speaks for the directory."""
    docs = table(spark, sf_dir, "documents")
    part = F.when(F.col("doc_id") >= 1000, F.floor(F.col("doc_id") / 1000).cast("string"))
    files = docs.select("doc_id", "text", F.concat_ws("/", F.col("source"), F.col("lang"), part, F.col("doc_id").cast("string")).alias("path"))
    heads = (F.col("line") == 0) | (F.col("line") == F.col("lines") - 1)
    found = licenses.inherit_licenses(licenses.detect_licenses(files, id_col="doc_id"), heads)
    return found.select(F.col("id").alias("doc_id"), "path", "own_license", "score", "line", "license", "license_path")


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train_language(docs)
    return langid.predict_language(docs, model).select("doc_id", quality.held_out().alias("held_out"), "lang_pred", "score")


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = linededup.dedup_lines(docs)
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = """
WITH line AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), win AS (
  SELECT doc_id, p AS pos, ls[p + 1] AS x, ls[p + 2] AS y, ls[p + 3] AS z
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS p FROM line WHERE len(ls) >= 3)
), rep AS (
  SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, pos) AS k
  FROM win WHERE trim(x, ' ') <> '' OR trim(y, ' ') <> '' OR trim(z, ' ') <> ''
), gone AS (
  SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM rep WHERE k > 1
), gone_of AS (
  SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id
)
SELECT d.doc_id,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS INTEGER) AS n_lines,
       CAST(coalesce(len(g.gone), 0) AS INTEGER) AS n_removed,
       sha256(CASE WHEN d.text IS NULL THEN '' WHEN g.gone IS NULL THEN d.text ELSE coalesce(array_to_string(
         list_transform(list_filter(range(0, len(string_split(d.text, chr(10)))), lambda i: NOT list_contains(g.gone, i)),
                        lambda i: string_split(d.text, chr(10))[i + 1]), chr(10)), '') END) AS kept_sha256
FROM documents d LEFT JOIN gone_of g USING (doc_id)
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_path())


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as they come to grief by crc32 of ``conv_id:turn`` modulo 20: 0 drops, 1 empties, 2 loses ends of sentences, 3 says twice, 4 becomes a user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return dialogue.with_all(dialogue.repair_report(dialogue.repair(damaged(told))), told)


def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = onlinepack.online_pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster_report(*lloyd.delta_lloyd(table(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_vectordup": op2_vectordup,
        "op3_mixing": op3_mixing,
        "op4_substrings": op4_substrings,
        "op5_neardup": op5_neardup,
        "op6_licenses": op6_licenses,
        "op7_hnsw": op7_hnsw,
        "op8_langid": op8_langid,
        "op9_linededup": op9_linededup,
        "op10_packing": op10_packing,
        "op11_dialogue": op11_dialogue,
        "op12_windows": op12_windows,
        "op13_centroids": op13_centroids,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op9_linededup": OP9_SQL, "op11_dialogue": OP11_SQL, "op13_centroids": OP13_SQL}
