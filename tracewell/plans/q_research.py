"""Queries: redaction, mentions, sweeps, findings, subtasks, research and planted tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import names, redact, stats
from tracewell.functions.time import millis
from tracewell.operators import findings, research, subtasks
from tracewell.plans import store
from tracewell.plans.store import with_prelude
from tracewell.registry import query


@query()
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.redacted(store.table(spark, sf_dir, "documents"), "text", ["doc_id"])


@query(r"""
SELECT doc_id, len(h) AS emails FROM (SELECT doc_id, regexp_extract_all(text, '(^|[^A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@([A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}') AS h FROM documents) WHERE len(h) > 0""")
def redact_email_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses that redaction itself finds, with its other rules off."""
    active = tuple(r for r in redact.rules() if r.name == "email")
    out = redact.redacted(store.table(spark, sf_dir, "documents"), "text", ["doc_id"], active)
    return out.select("doc_id", F.get_json_object("counts", "$.email").cast("long").alias("emails")).where("emails > 0")


@query("SELECT doc_id, text AS redacted, '{}' AS counts FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '(?i)[@0-9=:]|bearer|authorization|private key|eyj')")
def redact_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold nothing any rule could start from come out as they went in."""
    rows = store.table(spark, sf_dir, "documents").where(~F.coalesce("text", F.lit("")).rlike("(?i)[@0-9=:]|bearer|authorization|private key|eyj"))
    return redact.redacted(rows, "text", ["doc_id"])


@query(r"""
WITH w AS (SELECT conv_id, turn, list_intersect(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), ['the', 'und', 'que', 'des']) AS hits FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(list_transform(hits, lambda h: CASE h WHEN 'the' THEN 'a1' WHEN 'und' THEN 'a2' WHEN 'que' THEN 'a3' ELSE 'a4' END)), ',') AS named FROM w WHERE len(hits) > 0""")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stand in for names, as the test texts name nobody."""
    aliases = {"the": "a1", "und": "a2", "que": "a3", "des": "a4"}
    rows = store.table(spark, sf_dir, "conversations").select("conv_id", "turn", names.mentions(F.col("text"), aliases).alias("m"))
    return rows.where(F.size("m") > 0).select("conv_id", "turn", F.array_join("m", ",").alias("named"))


_PRECISION = """
SELECT verdict, count(*) AS records, count(correct) AS labelled, count(*) FILTER (WHERE correct) AS correct,
       round(count(*) FILTER (WHERE correct) / nullif(count(correct), 0), 6) AS accuracy, round(count(*) * (count(*) FILTER (WHERE correct) / nullif(count(correct), 0)), 6) AS estimated
FROM (SELECT d.doc_id, CASE d.doc_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unclear' END AS verdict, CASE WHEN l.quality IS NULL THEN NULL ELSE (l.quality = 1) = (d.doc_id % 3 = 0) END AS correct
      FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1"""


@query(_PRECISION)
def sweep_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "labels")
    m = F.col("doc_id") % 3
    verdicts = docs.select(F.col("doc_id").alias("event_id"), F.when(m == 0, "yes").when(m == 1, "no").otherwise("unclear").alias("verdict"))
    judged = labels.select(F.col("doc_id").alias("event_id"), ((F.col("quality") == 1) == (m == 0)).alias("correct"))
    out = findings.precision(verdicts, judged)
    return out.select("verdict", "records", "labelled", "correct", F.round("accuracy", 6).alias("accuracy"), F.round("estimated", 6).alias("estimated"))


@query("""
WITH c AS (SELECT source, sum(toxic)::DOUBLE AS x, count(*)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1),
v AS (SELECT *, x / n AS p, 1 + 3.841458820694124 / n AS d, 1.959963984540054 * sqrt((x / n) * (1 - x / n) / n + 3.841458820694124 / (4 * n * n)) AS h FROM c)
SELECT source, x, n, round(greatest(0, (p + 3.841458820694124 / (2 * n)) / d - h / d), 6) AS low, round(least(1, (p + 3.841458820694124 / (2 * n)) / d + h / d), 6) AS high FROM v""")
def wilson_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.table(spark, sf_dir, "labels").join(store.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    counts = rows.groupBy("source").agg(F.sum("toxic").cast("double").alias("x"), F.count(F.lit(1)).cast("double").alias("n"))
    low, high = stats.wilson(F.col("x"), F.col("n"))
    return counts.select("source", "x", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("SELECT count(*) AS records, CAST(ceil((sum(length(text)) + count(*) * 24) / 4.0) AS BIGINT) AS tokens FROM conversations")
def sweep_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.estimate(store.table(spark, sf_dir, "conversations"), "Does this name anybody? ")


@query()
def sweep_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an offline scorer in place of a model."""
    rows = store.table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.lit("testdata:msg"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("evidence_id"), F.col("turn").alias("ts"), "text"
    )
    return findings.sweep(rows, "Does this ask?", lambda prompt: '{"verdict": "' + ("yes" if "?" in prompt[15:] else "no") + '", "confidence": 0.9}', cap=500)


_FINDINGS = """
f AS (SELECT 'f' || (event_id % 50) AS finding_id, event_id AS line, 'testdata:msg:' || (event_id * 300) AS evidence_id, CASE event_id % 4 WHEN 0 THEN 'rejected' ELSE 'open' END AS status FROM ev),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY line DESC) = 1)"""


def _findings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return store.events(spark, sf_dir).select(
        F.concat(F.lit("f"), (e % 50).cast("string")).alias("finding_id"), e.alias("line"),
        F.array(F.concat(F.lit("testdata:msg:"), (e * 300).cast("string"))).alias("evidence_ids"), F.when(e % 4 == 0, "rejected").otherwise("open").alias("status"),
    )


@query(with_prelude(f"WITH {_FINDINGS} SELECT finding_id, line, status FROM l"))
def findings_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.latest(_findings_log(spark, sf_dir)).select("finding_id", "line", "status")


@query(with_prelude(f"WITH {_FINDINGS} SELECT finding_id, 'missing' AS problem, evidence_id FROM l WHERE status <> 'rejected' AND evidence_id NOT IN (SELECT evidence_id FROM messages)"))
def findings_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.check(findings.latest(_findings_log(spark, sf_dir)), store.messages(spark, sf_dir))


_TERMS = """
t AS (SELECT p_partkey AS u, unnest(string_split(lower(p_name), ' ')) AS term FROM part UNION ALL SELECT p_partkey, lower(p_type) FROM part UNION ALL SELECT p_partkey, lower(p_brand) FROM part),
c AS (SELECT u, term, count(*) AS c FROM t GROUP BY 1, 2), n AS (SELECT count(DISTINCT u) AS n FROM c), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
r AS (SELECT u, term, (1 + ln(c)) * (ln((1 + n) / (1 + df)) + 1) * CASE WHEN df > 0.3 * n THEN 0.2 ELSE 1 END AS raw FROM c JOIN d USING (term), n),
v AS (SELECT u, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY u)) AS w FROM r)"""


def _part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.concat(F.split(F.lower("p_name"), " "), F.array(F.lower("p_type"), F.lower("p_brand")))
    return store.table(spark, sf_dir, "part").select(F.lit("title").alias("signal"), F.col("p_partkey").alias("unit"), F.explode(words).alias("term"))


@query(f"WITH {_TERMS} SELECT u AS unit, term, round(w, 6) AS weight FROM v")
def subtasks_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtasks.tf_idf(_part_terms(spark, sf_dir)).select("unit", "term", F.round("weight", 6).alias("weight"))


@query(f"""
WITH {_TERMS}, s AS (SELECT a.u AS a, b.u AS b, sum(a.w * b.w) AS sim FROM v a JOIN v b ON a.term = b.term AND a.u < b.u GROUP BY 1, 2),
e AS (SELECT a, b, sim FROM s UNION ALL SELECT b, a, sim FROM s), k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) <= 6)
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, round(sim, 6) AS sim FROM k""")
def subtasks_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = subtasks.neighbours(subtasks.nearest(subtasks.tf_idf(_part_terms(spark, sf_dir))))
    return near.select("a", "b", F.round("sim", 6).alias("sim"))


@query()
def subtasks_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = subtasks.neighbours(subtasks.nearest(subtasks.tf_idf(_part_terms(spark, sf_dir))))
    return subtasks.clusters(near.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "sim"))


@query(with_prelude("""
WITH t AS (SELECT o_orderkey AS unit, l_partkey AS artifact, o_orderdate AS ts, CASE WHEN l_linenumber % 2 = 0 THEN 'modify' ELSE 'read' END AS op FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
h AS (SELECT artifact, arg_min(unit, (ts, unit)) AS src FROM t GROUP BY 1 HAVING count(DISTINCT unit) <= greatest(4, 0.08 * (SELECT count(*) FROM orders))),
x AS (SELECT src, unit AS dst, artifact, CASE WHEN op = 'modify' THEN 'builds_on' ELSE 'integrates' END AS kind FROM t JOIN h USING (artifact) WHERE unit <> src)
SELECT src, dst, min(kind) AS kind, count(DISTINCT artifact) AS artifacts FROM x GROUP BY 1, 2"""))
def subtasks_handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = store.table(spark, sf_dir, "orders"), store.table(spark, sf_dir, "lineitem")
    touches = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("unit"), F.col("l_partkey").alias("artifact"), F.col("o_orderdate").alias("ts"), F.when(F.col("l_linenumber") % 2 == 0, "modify").otherwise("read").alias("op")
    )
    return subtasks.handoffs(touches, orders.select(F.col("o_orderkey").alias("unit"), F.lit("").alias("title")))


@query("""
WITH w AS (SELECT source, doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id % 1 = 0),
s AS (SELECT DISTINCT source, doc_id, s FROM (SELECT source, doc_id, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' '))) AS s FROM w WHERE len(w) >= 6)),
h AS (SELECT source, s, count(*) AS n FROM s GROUP BY 1, 2)
SELECT source, doc_id, count(*) AS shingles, count(*) FILTER (WHERE n > 1) AS shared FROM s JOIN h USING (source, s) GROUP BY 1, 2""".replace(" WHERE doc_id % 1 = 0", ""))
def shared_memory_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.shared_shingles(store.table(spark, sf_dir, "documents"), ["source"], "doc_id", "text")


@query(with_prelude("""
WITH u AS (SELECT 'term' || (k % 25) AS term, CAST(floor(date_diff('day', DATE '1970-01-05', CAST(ts AS DATE)) / 7) AS BIGINT) AS week FROM messages),
w AS (SELECT term, week, count(*) AS n FROM u GROUP BY 1, 2), x AS (SELECT *, sum(n) OVER (PARTITION BY term ORDER BY week RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS near FROM w)
SELECT term, round(max(near) / sum(n), 6) AS burstiness, CAST(sum(n) AS BIGINT) AS uses FROM x GROUP BY 1"""))
def idea_burstiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = research.burstiness(_uses(spark, sf_dir))
    return out.select("term", F.round("burstiness", 6).alias("burstiness"), "uses")


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.messages(spark, sf_dir).withColumn("term", F.concat(F.lit("term"), (F.col("k") % 25).cast("string")))


@query(with_prelude("""
WITH u AS (SELECT *, 'term' || (k % 25) AS term FROM messages), p AS (SELECT term, author_id, count(*) AS n, min((ts, evidence_id)) AS f FROM u GROUP BY 1, 2),
c AS (SELECT term, arg_min(author_id, f) AS coiner, min(f)[1] AS coined_ts FROM p GROUP BY 1), j AS (SELECT author_id, min(ts) AS joined_ts FROM messages GROUP BY 1)
SELECT c.term, coiner, coined_ts, count(p.author_id) AS adopters, count(*) FILTER (WHERE joined_ts > coined_ts) AS newcomers
FROM c LEFT JOIN p ON p.term = c.term AND p.author_id <> coiner AND n >= 2 LEFT JOIN j ON j.author_id = p.author_id GROUP BY 1, 2, 3""".replace("min(f)[1]", "min(f.ts)").replace("min((ts, evidence_id)) AS f", "min({'ts': ts, 'e': evidence_id}) AS f")))
def idea_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = store.messages(spark, sf_dir).groupBy("author_id").agg(F.min("ts").alias("joined_ts"))
    return research.adoption(_uses(spark, sf_dir), joined)


@query(with_prelude("""
WITH u AS (SELECT 'term' || (k % 25) AS term, * FROM messages)
SELECT u.term, m.author_id AS reader, min(epoch_ms(u.ts)) AS first_exposed FROM u JOIN messages m ON m.channel = u.channel AND m.author_id <> u.author_id AND abs(epoch_ms(m.ts) - epoch_ms(u.ts)) <= 7200000 GROUP BY 1, 2"""))
def idea_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.messages(spark, sf_dir)
    return research.exposures(_uses(spark, sf_dir), rows)


@query(with_prelude("""
WITH o AS (SELECT *, epoch_ms(ts) AS ms FROM messages),
x AS (SELECT a.evidence_id, a.author_id AS replier, arg_max(b.author_id, (b.ts, b.evidence_id)) AS asker, epoch_ms(a.ts) - max(epoch_ms(b.ts)) AS gap_ms
      FROM o a JOIN o b ON a.channel = b.channel AND a.author_id <> b.author_id AND (b.ts, b.evidence_id) < (a.ts, a.evidence_id) AND a.ms - b.ms <= 1800000 GROUP BY a.evidence_id, a.author_id, a.ts)
SELECT * FROM x"""))
def coherence_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.exchanges(store.messages(spark, sf_dir))


@query(r"""
SELECT role, count(*) AS messages, round(100.0 * count(*) FILTER (WHERE regexp_matches(text, '\bthe\b', 'i')) / count(*), 6) AS the, round(100.0 * count(*) FILTER (WHERE regexp_matches(text, '\bund\b', 'i')) / count(*), 6) AS und
FROM conversations GROUP BY 1""")
def cooperation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = research.marker_rates(store.table(spark, sf_dir, "conversations"), ["role"], {"the": r"\bthe\b", "und": r"\bund\b"}, "text")
    return out.select("role", "messages", F.round("the", 6).alias("the"), F.round("und", 6).alias("und"))


@query("""
WITH a AS (SELECT c_nationkey AS cell, c_custkey, c_acctbal AS x, count(o_orderkey)::DOUBLE AS y FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3),
r AS (SELECT cell, rank() OVER (PARTITION BY cell ORDER BY x) + (count(*) OVER (PARTITION BY cell, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY cell ORDER BY y) + (count(*) OVER (PARTITION BY cell, y) - 1) / 2.0 AS ry FROM a)
SELECT cell, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY 1 HAVING count(*) > 2""")
def scaling_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = research.spearman(_cells(spark, sf_dir), "x", "y", ["cell"])
    return out.where("n > 2").select("cell", F.round("rho", 6).alias("rho"), "n")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = store.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("y"))
    people = store.table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return people.select(F.col("c_nationkey").alias("cell"), "c_custkey", F.col("c_acctbal").alias("x"), F.coalesce("y", F.lit(0)).cast("double").alias("y"))


@query()
def scaling_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.permutation_test(_cells(spark, sf_dir), "x", "y", "cell")


@query("""
WITH l AS (SELECT quality AS a, toxic AS b FROM labels), c AS (SELECT a, b, count(*) AS n FROM l GROUP BY 1, 2),
s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM c) AS t, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS x, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS y, (SELECT sum(n) FROM c) AS m)
SELECT round((t - x * y / (m * (m - 1) / 2.0)) / ((x + y) / 2 - x * y / (m * (m - 1) / 2.0)), 6) AS adjusted_rand FROM s""")
def agreement_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.rand_index(store.table(spark, sf_dir, "labels"), "quality", "toxic").select(F.round("adjusted_rand", 6).alias("adjusted_rand"))


@query("""
WITH f AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0 OR toxic = 1), h AS (SELECT count(*) AS h FROM f JOIN t USING (doc_id))
SELECT round(h / (SELECT count(*) FROM f), 6) AS precision, round(h / (SELECT count(*) FROM t), 6) AS recall,
       round(2 * (h / (SELECT count(*) FROM f)) * (h / (SELECT count(*) FROM t)) / (h / (SELECT count(*) FROM f) + h / (SELECT count(*) FROM t)), 6) AS f1 FROM h""")
def bench_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = store.table(spark, sf_dir, "labels")
    out = research.scores(labels.where("toxic = 1"), labels.where("quality = 0 OR toxic = 1"), "doc_id")
    return out.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(with_prelude("""
WITH u AS (SELECT 'term' || (k % 25) AS term, * FROM messages), f AS (SELECT term, author_id, min(ts) AS first_ts, epoch_ms(min(ts)) AS t FROM u GROUP BY 1, 2)
SELECT f.term, f.author_id, first_ts, EXISTS (SELECT 1 FROM u b WHERE b.term = f.term AND b.author_id <> f.author_id AND epoch_ms(b.ts) < f.t AND (list_contains(b.recipient_ids, f.author_id)
  OR EXISTS (SELECT 1 FROM messages m WHERE m.author_id = f.author_id AND m.channel = b.channel AND epoch_ms(m.ts) >= f.t - 259200000 AND epoch_ms(m.ts) < f.t))) AS copier FROM f"""))
def bench_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.likely_copiers(_uses(spark, sf_dir), store.messages(spark, sf_dir))


@query(with_prelude("""
SELECT author_id, since, until FROM (SELECT author_id, lag(ts) OVER w AS since, ts AS until, epoch_ms(ts) - lag(epoch_ms(ts)) OVER w AS g FROM messages WINDOW w AS (PARTITION BY author_id ORDER BY ts)) WHERE g > 216000000"""))
def bench_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.silent_gaps(store.messages(spark, sf_dir), "author_id")


@query("""
WITH n AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Agent ' || (c_custkey % 40) WHEN 1 THEN 'AGENT-' || (c_custkey % 40) WHEN 2 THEN 'аgent_' || (c_custkey % 40) ELSE 'agent' || (c_custkey // 40) END AS name FROM customer),
k AS (SELECT *, regexp_replace(replace(lower(name), 'а', 'a'), '[ _.-]', '', 'g') AS skeleton FROM n)
SELECT skeleton, count(DISTINCT id) AS n, CASE WHEN bool_or(strlen(name) > length(name)) THEN 'homoglyph' ELSE 'case_or_spacing' END AS kind FROM k GROUP BY 1 HAVING count(DISTINCT name) > 1""")
def bench_confusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under four spellings, one of them with a Cyrillic first letter."""
    c = F.col("c_custkey")
    near = (c % 40).cast("string")
    name = F.when(c % 4 == 0, F.concat(F.lit("Agent "), near)).when(c % 4 == 1, F.concat(F.lit("AGENT-"), near)).when(c % 4 == 2, F.concat(F.lit("аgent_"), near)).otherwise(F.concat(F.lit("agent"), F.floor(c / 40).cast("string")))
    out = research.confusable_names(store.table(spark, sf_dir, "customer").select(name.alias("name"), c.alias("agent_id")))
    return out.select("skeleton", F.size("ids").cast("long").alias("n"), "kind")


@query(with_prelude("""
WITH t AS (SELECT 'talk:' || event_id AS talk_id, event_id // 2 * 2 AS message_id, CASE WHEN k % 5 = 0 THEN 'testdata:agent:0' ELSE author_id END AS speaker_id, event_id AS s FROM messages WHERE k % 7 > 0),
l AS (SELECT message_id, arg_max(talk_id, s) AS talk_id, arg_max(speaker_id, s) AS speaker_id FROM t GROUP BY 1)
SELECT m.evidence_id, CASE WHEN l.talk_id IS NULL THEN 'missing_event' ELSE 'speaker_mismatch' END AS issue, l.talk_id, author_id AS chat_speaker, l.speaker_id AS event_speaker FROM messages m LEFT JOIN l ON l.message_id = m.event_id WHERE l.speaker_id IS DISTINCT FROM author_id"""))
def bench_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, e, k = store.messages(spark, sf_dir), F.col("event_id"), F.col("k")
    talks = rows.where(k % 7 > 0).select(
        F.concat(F.lit("talk:"), e.cast("string")).alias("talk_id"), (F.floor(e / 2) * 2).alias("message_id"), F.when(k % 5 == 0, "testdata:agent:0").otherwise(F.col("author_id")).alias("speaker_id"), e.alias("sequence")
    )
    return research.attribution_issues(rows.select("evidence_id", e.alias("message_id"), "author_id"), talks)


@query(with_prelude("""
SELECT a.evidence_id AS asked, count(*) AS replies FROM messages a JOIN messages b ON a.channel = b.channel AND b.author_id <> a.author_id AND list_contains(b.recipient_ids, a.author_id)
  AND epoch_ms(b.ts) > epoch_ms(a.ts) AND epoch_ms(b.ts) - epoch_ms(a.ts) <= 600000 GROUP BY 1"""))
def bench_coordinators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies within ten minutes that name the author: the first half of the coordinator rule, which ``bench_coordinators_ranked`` holds whole."""
    rows, width = store.messages(spark, sf_dir), 600_000
    a = rows.select(F.col("evidence_id").alias("asked"), "channel", F.col("author_id").alias("dst"), millis().alias("t")).withColumn("b", F.explode(F.array(F.floor(F.col("t") / width), F.floor(F.col("t") / width) + 1)))
    b = rows.select("channel", "author_id", F.explode("recipient_ids").alias("dst"), millis().alias("u")).withColumn("b", F.floor(F.col("u") / width))
    met = a.join(b, ["channel", "dst", "b"]).where("author_id <> dst AND u > t AND u - t <= 600000")
    return met.groupBy("asked").agg(F.count(F.lit(1)).alias("replies"))


@query(with_prelude("""
WITH m AS (SELECT evidence_id, author_id, recipient_ids, epoch_us(ts) AS t FROM messages WHERE author_id NOT LIKE 'human:%'),
g AS (SELECT evidence_id, agent_id, 'testdata:agent:' || ((user_id + k) % 150) AS named, epoch_us(ts) AS t FROM actions WHERE user_id % 10 <> 0 AND k % 2 = 0),
x AS (SELECT m.author_id AS actor, m.evidence_id, m.t, (SELECT arg_min(n.evidence_id, (n.t, n.evidence_id)) FROM m n WHERE n.author_id <> m.author_id AND list_contains(n.recipient_ids, m.author_id)
        AND (n.t, n.evidence_id) > (m.t, m.evidence_id) AND n.t - m.t <= 600000000) AS reply,
        (SELECT arg_min(g.evidence_id, (g.t, g.agent_id, g.evidence_id)) FROM g WHERE g.agent_id <> m.author_id AND g.named = m.author_id AND g.t > m.t AND g.t - m.t <= 900000000) AS goal FROM m),
y AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY t, evidence_id) AS place FROM x WHERE reply IS NOT NULL AND goal IS NOT NULL)
SELECT actor, count(*) AS score, string_agg(evidence_id || ',' || reply || ',' || goal, ',' ORDER BY place) FILTER (WHERE place <= 3) AS example_ids FROM y GROUP BY 1 HAVING count(*) >= 2 ORDER BY score DESC, actor"""))
def bench_coordinators_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even numbered actions of agents stand in for session goals, and name whom the messages' rule names."""
    user, k = F.col("user_id"), F.col("k")
    named = F.array(F.concat(F.lit("testdata:agent:"), ((user + k) % 150).cast("string")))
    goals = store.actions(spark, sf_dir).where((user % 10 != 0) & (k % 2 == 0)).select("evidence_id", "agent_id", named.alias("named_ids"), "ts")
    out = research.coordinators(store.messages(spark, sf_dir).where("author_id NOT LIKE 'human:%'"), goals)
    return out.withColumn("example_ids", F.array_join("example_ids", ",")).orderBy(F.desc("score"), "actor")
