"""The thin queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import common, decontaminate, language, minhash, piece_bpe, quality, sharding, token_files, toxicity, url_rules, vector_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated pairs only: clean documents have no row."""
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "n_covered", F.round("coverage", 6).alias("coverage"), F.size("tiles").alias("n_tiles"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(documents, _table(spark, sf_dir, "labels"))
    rows = toxicity.score(documents, lexicon)
    return rows.select("doc_id", F.coalesce(common.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", toxicity.predicted().alias("predicted"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    rows = language.identify(documents, language.fit(documents))
    return rows.select("doc_id", F.coalesce(common.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.stage_path(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = common.stage(token_files.digests(spark, path), "token-digests")
    return token_files.starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.link(_table(spark, sf_dir, "embeddings"))


def op9_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = piece_bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    rows = quality.score(documents, quality.fit(documents, _table(spark, sf_dir, "labels")))
    return rows.select("doc_id", F.coalesce(common.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", quality.predicted().alias("predicted"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_url_rules": op2_url_rules,
    "op3_minhash": op3_minhash,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_token_files": op7_token_files,
    "op8_vector_dedup": op8_vector_dedup,
    "op9_piece_bpe": op9_piece_bpe,
    "op10_quality": op10_quality,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _draw(children: str, weight: str, name: str) -> str:
    """The child (a list's element ``i``) with the shortest straw for ``key``."""
    u = f"((('0x' || substr(md5(key || '/{name}' || i), 1, 8))::BIGINT + 0.5) / 4294967296.0)"
    return f"list_sort(list_transform({children}, lambda i: {{'straw': -ln({u}) / ({weight}), 'i': i}}))[1].i"


ORACLE_SQL = {
    "op1_sharding": f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, coalesce(strlen(text), 0) + 16 AS size,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
k AS (SELECT doc_id, key, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32,
             ('0x' || substr(md5('slot/' || key), 1, 8))::BIGINT % 1024 AS bucket FROM d, crc),
r AS (SELECT *, {_draw("range(4)", "10.0", "region")} AS region, {_draw("range(5)", "CASE WHEN i < 4 THEN 10.0 ELSE 1.0 END", "region")} AS grown FROM k),
a AS (SELECT *, {_draw("[2 * region, 2 * region + 1]", "5.0", "rack")} AS rack FROM r),
s AS (SELECT *, {_draw("range(5 * rack, 5 * rack + 5)", "1.0", "shard")} AS shard FROM a)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, CASE WHEN grown = 4 THEN 40 ELSE shard END::INTEGER AS grown_shard FROM s""",
    "op3_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id""",
    "op8_vector_dedup": """
WITH RECURSIVE l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id
                     WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.98),
r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept FROM embeddings JOIN m ON node = vec_id LEFT JOIN n ON a = vec_id""",
    "op2_url_rules": """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut),
rules(h, p, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)""",
}
