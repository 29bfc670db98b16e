"""Queries: context, artifact histories, arcs, plans and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import graph, views
from tracewell.plans import store
from tracewell.plans.typed import TYPED, typed_log
from tracewell.plans.q_recap import _SEGS, _mentions
from tracewell.plans.store import with_prelude
from tracewell.registry import query


def _touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = store.table(spark, sf_dir, "lineitem").join(store.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    op = F.when(F.col("l_linenumber") % 3 == 0, "create").when(F.col("l_linenumber") % 3 == 1, "modify").otherwise("read")
    return lines.select(F.col("o_orderkey").cast("string").alias("record_id"), F.col("l_partkey").alias("artifact_id"), op.alias("op"), F.col("o_orderdate").alias("ts"))


@query("""
SELECT l_partkey AS artifact_id, count(*) FILTER (WHERE l_linenumber % 3 = 0) AS creates, count(*) FILTER (WHERE l_linenumber % 3 = 1) AS modifies, count(*) FILTER (WHERE l_linenumber % 3 = 2) AS reads,
       min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def artifact_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.artifact_history(_touches(spark, sf_dir)).select("artifact_id", "creates", "modifies", "reads", "first_ts", "last_ts")


@query(with_prelude("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts, evidence_id) AS p FROM messages), a AS (SELECT evidence_id AS asked_id, channel AS c, p AS q, ts AS t FROM o)
SELECT asked_id, CASE WHEN p = q THEN 'record' ELSE 'neighbour' END AS role, evidence_id, (p - q)::VARCHAR AS detail FROM o JOIN a ON channel = c AND p BETWEEN q - 1 AND q + 1
UNION ALL SELECT asked_id, 'period', periods.evidence_id, label FROM a JOIN periods ON t >= start_ts AND (end_ts IS NULL OR t < end_ts)"""))
def records_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.messages(spark, sf_dir)
    none = spark.createDataFrame([], "record_id string, artifact_id string, op string")
    return views.in_context(rows, rows, none, store.periods(spark), 1, 1)


@query(with_prelude(f"""
WITH {_SEGS}, e AS (SELECT seg, author_id AS src, unnest(recipient_ids) AS dst FROM m),
c AS (SELECT seg, src, dst, count(*) AS n FROM e WHERE src <> dst AND src IN (SELECT agent_id FROM agents) AND dst IN (SELECT agent_id FROM agents) GROUP BY 1, 2, 3),
t AS (SELECT src, seg, sum(n) AS total, lag(seg) OVER (PARTITION BY src ORDER BY seg) AS prev, array_to_string((list(dst ORDER BY n DESC, dst))[1:3], ',') AS partners FROM c GROUP BY 1, 2),
p AS (SELECT t.src, t.seg, c.dst, c.n / total::DOUBLE AS a, 0.0 AS b FROM t JOIN c ON c.src = t.src AND c.seg = t.seg WHERE prev IS NOT NULL
      UNION ALL SELECT t.src, t.seg, c.dst, 0.0, c.n / u.total::DOUBLE FROM t JOIN t u ON u.src = t.src AND u.seg = t.prev JOIN c ON c.src = t.src AND c.seg = t.prev),
q AS (SELECT src, seg, dst, sum(a) AS a, sum(b) AS b FROM p GROUP BY 1, 2, 3),
d AS (SELECT src, seg, round(sqrt(greatest(0, sum(CASE WHEN a > 0 THEN 0.5 * a * log2(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN 0.5 * b * log2(b / ((a + b) / 2)) ELSE 0 END))), 6) AS change FROM q GROUP BY 1, 2)
SELECT t.src, t.seg, partners, change FROM t LEFT JOIN d ON d.src = t.src AND d.seg = t.seg"""))
def agent_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = views.agent_arc(_mentions(spark, sf_dir))
    return out.select("src", "seg", F.array_join("partners", ",").alias("partners"), F.round("change", 6).alias("change"))


@query(with_prelude("""
WITH e AS (SELECT author_id AS src, unnest(recipient_ids) AS dst FROM messages), c AS (SELECT src, dst FROM e WHERE src <> dst AND src IN (SELECT agent_id FROM agents) AND dst IN (SELECT agent_id FROM agents)),
k AS (SELECT agent_id, split_part(agent_id, ':', 3)::INT % 3 AS kind FROM agents)
SELECT count(*) AS weight, round(count(*) FILTER (WHERE a.kind = b.kind) / count(*)::DOUBLE, 6) AS same_kind FROM c JOIN k a ON a.agent_id = src JOIN k b ON b.agent_id = dst"""))
def graph_homophily(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = store.agents(spark, sf_dir)
    kinds = who.select(F.col("agent_id").alias("node"), (F.split_part("agent_id", F.lit(":"), F.lit(3)).cast("int") % 3).alias("kind"))
    out = views.homophily(graph.mention_edges(store.messages(spark, sf_dir), who), kinds)
    return out.select("weight", F.round("same_kind", 6).alias("same_kind"))


@query(with_prelude(f"""
WITH {TYPED}, k AS (SELECT c.sequence, c.ts, arg_max(l.outcome, l.sequence) AS o, arg_max(l.ts, l.sequence) AS t FROM typed c JOIN typed l ON l.artifact = c.artifact AND l.version = c.version AND l.sequence < c.sequence AND l.type = 'tool_result' AND l.outcome IN ('pass', 'fail')
  WHERE c.type = 'claim' GROUP BY 1, 2)
SELECT sequence FROM k WHERE o = 'fail' AND t >= ts - INTERVAL 96 HOUR"""))
def claims_worth_a_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.candidate_claims(typed_log(spark, sf_dir), 96).select("sequence")


@query(with_prelude("""
WITH s AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL (30 * i) MINUTE AS s FROM ev, range(8) t(i) WHERE event_type = 'error')
SELECT s AS "start", s + INTERVAL 4 HOUR AS "end", count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1"""))
def busiest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.busiest_window(store.events(spark, sf_dir).where("event_type = 'error'"))


@query(with_prelude("""
WITH s AS (SELECT user_id, ts AS a, ts + INTERVAL (k * 10) MINUTE AS b FROM ev), m AS (SELECT *, max(epoch_ms(b)) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s),
g AS (SELECT *, sum(CASE WHEN r IS NULL OR epoch_ms(a) - r > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, min(a) AS start_ts, max(b) AS end_ts, count(*) AS n FROM g GROUP BY user_id, run"""))
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = store.events(spark, sf_dir).select("user_id", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("make_dt_interval(0, 0, k * 10, 0)")).alias("end_ts"))
    return views.merged_spans(spans, "user_id", 3_600_000)


@query("""
WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || ':3'), doc_id) AS r FROM documents)
SELECT doc_id, source FROM s WHERE r <= 4""")
def judge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.stratified(store.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 4, seed=3, id_col="doc_id")


@query("""
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents)
SELECT doc_id, place // 20 AS batch FROM o UNION ALL SELECT doc_id, place // 20 + 1 FROM o WHERE place % 20 < 3""")
def judge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.batches(store.table(spark, sf_dir, "documents").select("doc_id"), 20, 3, order="doc_id")


@query(r"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '(^|[^\p{L}\p{N}])(the)($|[^\p{L}\p{N}])', '\1[agent]\3', 'gi'), '(^|[^\p{L}\p{N}])(the)($|[^\p{L}\p{N}])', '\1[agent]\3', 'gi') AS text FROM conversations")
def judge_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.table(spark, sf_dir, "conversations").select("conv_id", "turn", views.masked(F.col("text"), ["the"]).alias("text"))


@query("""
WITH a AS (SELECT c_custkey AS id, lower(c_mktsegment) || ' ' || c_custkey AS k FROM customer), b AS (SELECT s_suppkey AS id, lower('building') || ' ' || s_suppkey AS k FROM supplier),
x AS (SELECT k, min(id) AS left_id FROM a GROUP BY 1 HAVING count(*) = 1), y AS (SELECT k, min(id) AS right_id FROM b GROUP BY 1 HAVING count(*) = 1) SELECT left_id, right_id FROM x JOIN y USING (k)""")
def same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = store.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(F.concat_ws("-", "c_mktsegment", F.col("c_custkey").cast("string"))).alias("names"))
    b = store.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.concat_ws("_", F.lit("Building"), F.col("s_suppkey").cast("string"))).alias("names"))
    return views.same_names(a, b)


@query(with_prelude(f"WITH {TYPED} SELECT CAST((sequence - 1) * 4 // (SELECT max(sequence) FROM typed) AS BIGINT) AS part, count(*) AS n, count(*) FILTER (WHERE type = 'claim') AS claims FROM typed GROUP BY 1"))
def split_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.split_windows(typed_log(spark, sf_dir), 4)
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("type") == "claim", 1)).alias("claims"))


@query(with_prelude(f"""
WITH {TYPED}, p AS (SELECT *, CAST((sequence - 1) * 4 // (SELECT max(sequence) FROM typed) AS BIGINT) AS part FROM typed),
m AS (SELECT DISTINCT a.part, b.event_id FROM p a JOIN p b ON b.made_task = a.task AND b.part < a.part),
r AS (SELECT part, supersedes AS c FROM p WHERE supersedes IS NOT NULL UNION SELECT part, unnest(refs_claims) FROM p),
c AS (SELECT DISTINCT r.part, b.event_id FROM r JOIN p b ON b.claim_id = r.c AND b.part < r.part),
f AS (SELECT part, artifact, version, min(sequence) AS s FROM p WHERE type = 'claim' AND artifact IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT part, (SELECT max(x.sequence) FROM p x WHERE x.category = 'verification' AND x.artifact = f.artifact AND x.version = f.version AND x.sequence < f.s) AS s FROM f)
SELECT * FROM m UNION SELECT * FROM c UNION SELECT k.part, x.event_id FROM k JOIN p x ON x.sequence = k.s WHERE x.part < k.part"""))
def carried_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.carried_facts(typed_log(spark, sf_dir), 4)
