"""Queries: text rules over documents and conversations, and files' terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import findings, records, research, subtasks
from tracewell.plans import store
from tracewell.plans.store import with_prelude
from tracewell.registry import query


@query("""
SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(p_name || '_' || p_type), '[^a-z0-9]+'), lambda w: w <> ''), ' ') AS words FROM part""")
def identifier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.lower(F.concat("p_name", F.lit("_"), "p_type"))
    return store.table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.words_of_identifier(joined), " ").alias("words"))


@query("""
WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{2,}') AS L FROM conversations)
SELECT conv_id, turn, len(L) AS tokens, len(list_distinct(L)) AS words FROM w""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = store.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("l"))
    return listed.select("conv_id", "turn", F.size("l").cast("long").alias("tokens"), F.size(F.array_distinct("l")).cast("long").alias("words"))


@query("""
WITH p AS (SELECT DISTINCT p_brand || '/' || p_type || '/' || p_name AS f, p_partkey FROM part)
SELECT p_partkey AS unit, f AS term FROM p UNION ALL SELECT p_partkey, split_part(f, '/', 1) || '/' FROM p UNION ALL SELECT p_partkey, split_part(f, '/', 1) || '/' || split_part(f, '/', 2) || '/' FROM p""")
def subtasks_file_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = store.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"), F.concat_ws("/", "p_brand", "p_type", "p_name").alias("artifact"))
    return subtasks.file_terms(files).select("unit", "term")


@query("SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS title FROM part")
def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles made of part names, a prefix, a number and marks, all of which are cleaned away."""
    title = F.concat(F.lit("fix(core): "), F.col("p_name"), F.lit(" [wip] (#"), F.col("p_partkey").cast("string"), F.lit(")."))
    return store.table(spark, sf_dir, "part").select("p_partkey", subtasks.clean_title(title).alias("title"))


@query(with_prelude("""
SELECT count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15' AND hit) AS before_with, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15' AND NOT hit) AS before_without,
       count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15' AND hit) AS after_with, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15' AND NOT hit) AS after_without
FROM (SELECT ts, coalesce(regexp_matches(text, 'password', 'i'), false) AS hit FROM messages LEFT JOIN documents ON doc_id * 10 = event_id)"""))
def norm_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.before_after(store.messages(spark, sf_dir, text=True), "password", "2024-01-15 00:00:00")


@query(with_prelude("""
WITH u AS (SELECT 'term' || (k % 25) AS term, * FROM messages),
x AS (SELECT u.term, m.author_id AS reader, min(epoch_ms(u.ts)) AS e FROM u JOIN messages m ON m.channel = u.channel AND m.author_id <> u.author_id AND abs(epoch_ms(m.ts) - epoch_ms(u.ts)) <= 7200000 GROUP BY 1, 2),
a AS (SELECT term, author_id AS reader, min(epoch_ms(ts)) AS a FROM u GROUP BY 1, 2),
b AS (SELECT x.*, a.a, greatest(0, floor((coalesce(a.a, 1706659200000) - e) / 604800000))::BIGINT AS last FROM x LEFT JOIN a USING (term, reader) WHERE a.a IS NULL OR a.a >= e),
w AS (SELECT unnest(range(0, last + 1)) AS week, last, a IS NOT NULL AS did FROM b)
SELECT week, count(*) AS at_risk, count(*) FILTER (WHERE did AND week = last) AS adopted FROM w GROUP BY 1"""))
def idea_weekly_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.functions.time import millis

    rows = store.messages(spark, sf_dir).withColumn("term", F.concat(F.lit("term"), (F.col("k") % 25).cast("string")))
    took = rows.groupBy("term", F.col("author_id").alias("reader")).agg(F.min(millis()).alias("adopted_at"))
    return research.weekly_hazard(research.exposures(rows, rows), took, 1706659200000).select("week", "at_risk", "adopted")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id LIMIT 25")
def findings_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.seeded(store.table(spark, sf_dir, "documents").select("doc_id"), 25, seed=7, id_col="doc_id")


@query("""
WITH n(name) AS (VALUES ('testdata:agent:7'), ('11'), ('nobody'))
SELECT name AS asked, CASE name WHEN 'nobody' THEN NULL WHEN '11' THEN 'testdata:agent:11' ELSE name END AS agent_id, CASE name WHEN 'nobody' THEN NULL WHEN '11' THEN 'suffix' ELSE 'id' END AS how FROM n""")
def agents_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster = store.agents(spark, sf_dir).select("agent_id", F.concat(F.lit("Agent number "), F.split_part("agent_id", F.lit(":"), F.lit(3))).alias("display_name"), F.array().cast("array<string>").alias("aliases"))
    names = spark.createDataFrame([("testdata:agent:7",), ("11",), ("nobody",)], "name string")
    return records.resolve_agents(names, roster).select("asked", "agent_id", "how")


@query(with_prelude("SELECT split_part(evidence_id, ':', 1) AS source, split_part(evidence_id, ':', 2) AS kind, count(*) AS n FROM (SELECT evidence_id FROM messages UNION ALL SELECT evidence_id FROM actions UNION ALL SELECT evidence_id FROM periods) GROUP BY 1, 2"))
def info_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = store.messages(spark, sf_dir).select("evidence_id").union(store.actions(spark, sf_dir).select("evidence_id")).union(store.periods(spark).select("evidence_id"))
    return ids.select(*records.split_evidence_id()).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


_WORDS = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^A-Za-z]+'), lambda w: length(w) > 2)"
_STEM = "CASE WHEN ends_with(w, 'ies') AND length(w) > 5 THEN left(w, length(w) - 3) || 'y' WHEN ends_with(w, 'ses') AND length(w) > 5 THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END"


@query(f"""
WITH t AS (SELECT p_partkey AS unit, 'fix(api): see https://x.example/' || p_partkey || ' #12 ' || p_name || ' PartTypes and classes of ' || p_type AS title FROM part),
w AS (SELECT unit, unnest({_WORDS.format("replace(title, 'fix(api): see https://x.example/' || unit || ' #12 ', 'see ')")}) AS w FROM t)
SELECT unit, {_STEM} AS term, count(*) AS n FROM w WHERE w NOT IN ({', '.join(f"'{x}'" for x in subtasks.TITLE_STOP)}) GROUP BY 1, 2""")
def subtasks_title_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names inside titles with a kind, an address and the number of an issue."""
    key = F.col("p_partkey").cast("string")
    title = F.concat(F.lit("fix(api): see https://x.example/"), key, F.lit(" #12 "), "p_name", F.lit(" PartTypes and classes of "), "p_type")
    units = store.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"), title.alias("title"))
    return subtasks.title_terms(units).groupBy("unit", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH c AS (SELECT p_partkey % 50 AS unit, 'src/' || replace(p_brand, '#', '') || '/PartIndex' || p_partkey || '.js' AS path, 'const ' || replace(p_name, ' ', 'Of_') || ' = getPart(\"' || p_type || '\")' AS line, './lib/' || replace(lower(p_type), ' ', '-') AS target FROM part),
i AS (SELECT unit, unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]{{2,}}')) AS ident FROM c),
w AS (SELECT unit, unnest({_WORDS.format('ident')}) AS w, 1 AS n, true AS code FROM i UNION ALL SELECT unit, unnest({_WORDS.format("replace(list_extract(string_split(path, '/'), -1), '.js', '')")}), 2, false FROM c
  UNION ALL SELECT unit, unnest({_WORDS.format("list_extract(string_split(target, '/'), -1)")}), 3, false FROM (SELECT DISTINCT unit, target FROM c))
SELECT unit, {_STEM} AS term, CAST(sum(n) AS BIGINT) AS n FROM w WHERE CASE WHEN code THEN w NOT IN ({', '.join(f"'{x}'" for x in subtasks.CODE_STOP)}) ELSE w NOT IN ('test', 'tests', 'index', 'spec') END GROUP BY 1, 2""".replace('\\"', '"'))
def subtasks_code_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as changes of fifty units, each with a file, a line and an import."""
    key = F.col("p_partkey")
    path = F.concat(F.lit("src/"), F.regexp_replace("p_brand", "#", ""), F.lit("/PartIndex"), key.cast("string"), F.lit(".js"))
    line = F.concat(F.lit("const "), F.regexp_replace("p_name", " ", "Of_"), F.lit(' = getPart("'), "p_type", F.lit('")'))
    target = F.concat(F.lit("./lib/"), F.regexp_replace(F.lower("p_type"), " ", "-"))
    changes = store.table(spark, sf_dir, "part").select((key % 50).alias("unit"), path.alias("artifact"), F.array(line).alias("lines"), F.array(target).alias("imports"))
    return subtasks.code_terms(changes).groupBy("unit", "term").agg(F.count(F.lit(1)).alias("n"))
