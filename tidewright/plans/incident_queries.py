"""Evidence, claims, questions and index health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import asking, graph, health, incidents
from tidewright.plans import graph_queries
from tidewright.plans.registry import Registry
from tidewright.session import table

registry = Registry()


@registry.add("SELECT conv_id, 'E' || row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS evidence_id, turn, role, length(text)::BIGINT AS n_chars FROM conversations")
def evidence_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as numbered evidence."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.char_length("text").cast("long").alias("n_chars"))
    return incidents.number_evidence(t, "conv_id", ["turn", "role"]).select("conv_id", "evidence_id", "turn", "role", "n_chars")


@registry.add("""WITH d AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS first_detected FROM conversations GROUP BY 1), a AS (SELECT conv_id, min(turn) AS first_answered FROM conversations JOIN d USING (conv_id) WHERE role = 'assistant' AND turn > first_detected GROUP BY 1)
SELECT conv_id, first_detected, first_answered, first_answered - first_detected AS gap FROM d LEFT JOIN a USING (conv_id)""")
def ack_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first question of a conversation to the first answer after it, in turns."""
    return incidents.acknowledged(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant")


CLAIMS_SQL = r"""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, 'part_' || l_partkey || ' of ' || CAST(l_quantity AS INTEGER) || ' pieces' AS body FROM lineitem),
e AS (SELECT 'E' || k || '-' || n AS evidence_id, body FROM l),
c AS (SELECT o_orderkey AS claim_id, 'sent ' || arg_max(body, (n, body)) AS text, CASE o_orderstatus WHEN 'P' THEN [] WHEN 'F' THEN ['E' || o_orderkey || '-1'] ELSE ['E' || o_orderkey || '-1', 'E' || o_orderkey || '-2'] END::VARCHAR[] AS cites FROM orders JOIN l ON k = o_orderkey GROUP BY o_orderkey, o_orderstatus),
x AS (SELECT claim_id, string_agg(body, chr(10) ORDER BY body) AS t, bool_or(body IS NULL) AS unknown FROM (SELECT claim_id, unnest(cites) AS evidence_id FROM c) LEFT JOIN e USING (evidence_id) GROUP BY 1)
SELECT claim_id, CASE WHEN t IS NULL OR unknown THEN 'dropped' WHEN len(list_filter(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*'), lambda n: NOT contains(t, n))) > 0 THEN 'dropped' WHEN len(list_filter(regexp_extract_all(text, '\b[a-z0-9]+(?:_[a-z0-9]+)+\b'), lambda n: NOT contains(t, n))) > 0 THEN 'warn' ELSE 'ok' END AS status FROM c LEFT JOIN x USING (claim_id)"""


@registry.add(CLAIMS_SQL)
def claim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim per order, about its last line, against the evidence that it cites: its first line,
    its first two, or none. What the first ones don't say is dropped."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.concat(F.lit("part_"), F.col("l_partkey").cast("string"), F.lit(" of "), F.col("l_quantity").cast("int").cast("string"), F.lit(" pieces")).alias("body"))
    name = lambda n: F.concat(F.lit("E"), F.col("k").cast("string"), F.lit("-"), n.cast("string"))
    last = li.groupBy("k").agg(F.concat(F.lit("sent "), F.max_by("body", F.struct("n", "body"))).alias("text"))
    cites = F.when(F.col("o_orderstatus") == "P", F.array().cast("array<string>")).when(F.col("o_orderstatus") == "F", F.array(name(F.lit(1)))).otherwise(F.array(name(F.lit(1)), name(F.lit(2))))
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus").join(last, "k").select(F.col("k").alias("claim_id"), "text", cites.alias("cites"))
    return incidents.check_claims(claims, li.select(name(F.col("n")).alias("evidence_id"), "body")).select("claim_id", "status")


@registry.add(r"""WITH n AS (SELECT conv_id, max(turn) AS n FROM conversations GROUP BY 1), a AS (SELECT conv_id, turn, left(text, 20) || CASE WHEN role = 'user' THEN '' ELSE ' [S' || turn || '] and [S' || (length(text) % 6) || ']' END AS t, n FROM conversations JOIN n USING (conv_id))
SELECT conv_id, turn, len(regexp_extract_all(t, '\[S([0-9]+)\]', 1)) > 0 AND len(list_filter(regexp_extract_all(t, '\[S([0-9]+)\]', 1), lambda x: x::INT < 1 OR x::INT > n)) = 0 AS cited_ok FROM a""")
def citation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers, the assistant's with two citations: those whose citations all exist among
    as many sources as the conversation has turns after its first."""
    t = table(spark, sf_dir, "conversations")
    n = t.groupBy("conv_id").agg(F.max("turn").alias("n"))
    cited = F.concat(F.lit(" [S"), F.col("turn").cast("string"), F.lit("] and [S"), (F.char_length("text") % 6).cast("string"), F.lit("]"))
    a = t.join(n, "conv_id").select("conv_id", "turn", F.concat(F.substring("text", 1, 20), F.when(F.col("role") == "user", "").otherwise(cited)).alias("text"), "n")
    return incidents.check_citations(a, "text", "n").select("conv_id", "turn", "cited_ok")


INTENTS = {"owner": ["what ", "who "], "impact": ["tion", "effect"], "status": ["is ", "was "], "cause": ["why"]}


@registry.add(r"""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'what ') OR contains(lower(text), 'who ') THEN 'owner' WHEN contains(lower(text), 'tion') OR contains(lower(text), 'effect') THEN 'impact' WHEN contains(lower(text), 'is ') OR contains(lower(text), 'was ') THEN 'status' WHEN contains(lower(text), 'why') THEN 'cause' ELSE 'search' END AS intent,
coalesce(regexp_matches(text, '(?i)\?|^(?:who|what|when|where|why|which|how|is|are|was|did|does)\b') OR len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) >= 5, false) AS looks_natural FROM conversations""")
def intent_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent of every turn, and whether it reads like a question."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", asking.intent("text", INTENTS).alias("intent"), asking.looks_natural("text").alias("looks_natural"))


@registry.add("""WITH i AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey) AS e FROM lineitem GROUP BY 1), x AS (SELECT k, unnest(e) AS e FROM i),
s AS (SELECT a.k AS a, b.k AS b, count(*) AS n_shared FROM x a JOIN x b ON a.e = b.e AND a.k < b.k GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT k AS a, k + 1 AS b FROM i WHERE k + 1 IN (SELECT k FROM i))
SELECT a, b, max(n) AS n_shared, bool_or(ref) AS referenced FROM (SELECT a, b, n_shared AS n, false AS ref FROM s UNION ALL SELECT a, b, 0, true FROM r) GROUP BY ALL""")
def similar_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as incidents that share two parts, or of which one names the other: each names the
    order after it."""
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_partkey").alias("e"))
    named = i.select(F.col("k").alias("src"), (F.col("k") + 1).alias("dst")).join(i.select(F.col("k").alias("dst")), "dst", "left_semi")
    return incidents.similar(i, "k", "e", 2, named)


@registry.add("""WITH p AS (SELECT event_id, (props::JSON->>'k')::INT AS k FROM events), a AS (SELECT event_id, ['a' || (k % 5), 'b' || (k % 7), 'z'] AS ok, ['a' || (k % 4), 'b' || (k % 7), 'z'] AS nk, k FROM p)
SELECT event_id, array_to_string(list_sort(list_filter(nk, lambda x: NOT list_contains(ok, x))), ',') AS added, array_to_string(list_sort(list_filter(ok, lambda x: NOT list_contains(nk, x))), ',') AS removed, CASE WHEN k % 2 = 1 THEN 'z' ELSE '' END AS changed FROM a""")
def map_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys added, removed and changed between two maps made of each event's properties."""
    k = F.get_json_object("props", "$.k").cast("int")
    key = lambda p, n: F.concat(F.lit(p), F.pmod(k, F.lit(n)).cast("string"))
    old = F.create_map(key("a", 5), F.lit("1"), key("b", 7), F.lit("1"), F.lit("z"), F.lit("0"))
    new = F.create_map(key("a", 4), F.lit("1"), key("b", 7), F.lit("1"), F.lit("z"), F.pmod(k, F.lit(2)).cast("string"))
    d = table(spark, sf_dir, "events").select("event_id", health.map_diff(old, new).alias("d"))
    return d.select("event_id", *(F.array_join(f"d.{c}", ",").alias(c) for c in ("added", "removed", "changed")))


NOW, DROP = "2024-02-01 12:00:00", 0.2


@registry.add(f"""WITH v AS (SELECT s_nationkey AS family, s_suppkey, 's-' || s_nationkey || '-' || s_suppkey AS index, TIMESTAMP '2024-01-01' + to_hours(CAST(s_suppkey % 744 AS INTEGER)) AS created, CAST(s_acctbal AS BIGINT) AS docs,
    CASE s_suppkey % 11 WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' ELSE 'green' END AS health FROM supplier),
n AS (SELECT family, max_by(index, (created, index)) AS newest, max_by(docs, (created, index)) AS n_docs FROM v GROUP BY 1),
c AS (SELECT v.* FROM v JOIN (SELECT family, min(s_suppkey) AS k FROM v GROUP BY 1) m ON v.family = m.family AND v.s_suppkey = m.k WHERE v.family % 5 <> 0),
f AS (SELECT n_nationkey AS family, CASE n_nationkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'success' ELSE 'running' END AS builder, n_nationkey % 4 = 0 AS paused, CASE WHEN n_nationkey % 7 = 0 THEN 'failed' ELSE 'success' END AS swapper FROM nation),
x AS (
  SELECT family, health = 'red' AS crit FROM v WHERE health <> 'green'
  UNION ALL SELECT f.family, true FROM f LEFT JOIN c USING (family) WHERE c.family IS NULL
  UNION ALL SELECT family, true FROM c WHERE date_diff('second', created, TIMESTAMP '{NOW}') / 3600.0 > 500
  UNION ALL SELECT family, false FROM c JOIN n USING (family) WHERE newest <> index
  UNION ALL SELECT family, true FROM c JOIN n USING (family) WHERE newest <> index AND docs > 0 AND 1 - n_docs::DOUBLE / docs > {DROP}
  UNION ALL SELECT family, builder = 'failed' FROM f WHERE builder <> 'success'
  UNION ALL SELECT family, false FROM f WHERE paused
  UNION ALL SELECT family, true FROM f WHERE swapper = 'failed')
SELECT 'n' || f.family AS family, CASE WHEN bool_or(crit) THEN 'crit' WHEN count(crit) > 0 THEN 'warn' ELSE 'ok' END AS level, count(crit) AS n_checks FROM f LEFT JOIN x USING (family) GROUP BY f.family""")
def index_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of each nation's family of indices, one index per supplier; the alias is at the
    supplier with the least key, where the nation has an alias."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    name = F.concat(F.lit("s-"), "s_nationkey", F.lit("-"), "s_suppkey")
    state = F.when(F.col("s_suppkey") % 11 == 0, "red").when(F.col("s_suppkey") % 11 == 1, "yellow").otherwise("green")
    created = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("s_suppkey") % 744).cast("int"))
    ix = s.select(name.alias("index"), created.alias("created"), F.col("s_acctbal").cast("decimal(20,0)").cast("long").alias("docs"), state.alias("health"), F.create_map().cast("map<string,string>").alias("mapping"))
    own = F.concat(F.lit("n"), "n_nationkey").alias("family")
    fam = n.select(own, F.concat(F.lit("s-"), "n_nationkey", F.lit("-*")).alias("pattern"), F.concat(F.lit("a"), "n_nationkey").alias("alias"), F.lit(500).alias("max_age_hours"))
    least = s.where("s_nationkey % 5 <> 0").groupBy("s_nationkey").agg(F.min_by(name, "s_suppkey").alias("index")).select(F.concat(F.lit("a"), "s_nationkey").alias("alias"), "index")
    run = F.element_at(F.array(F.lit("failed"), F.lit("success"), F.lit("running")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    builders = n.select(own, run.alias("builder_state"), (F.col("n_nationkey") % 4 == 0).alias("paused"))
    swappers = n.select(own, F.when(F.col("n_nationkey") % 7 == 0, "failed").otherwise("success").alias("swapper_state"))
    found = health.check_families(ix, fam, least, builders, F.lit(NOW).cast("timestamp_ntz"), DROP, swappers)
    return health.family_levels(fam, found)


@registry.add(f"""WITH {graph_queries.EDGES_SQL}, n AS (SELECT 'nation:' || n_nationkey AS id, n_name AS title FROM nation),
d AS (SELECT id, count(*) AS n_down FROM n JOIN f ON a = id GROUP BY 1), u AS (SELECT id, count(*) AS n_up FROM n JOIN f ON b = id GROUP BY 1)
SELECT id, title, coalesce(n_down, 0) AS n_down, coalesce(n_up, 0) AS n_up,
  coalesce((SELECT string_agg('INC-' || o_orderkey, ',' ORDER BY 'INC-' || o_orderkey) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' AND 'nation:' || c_nationkey = n.id), '') AS incidents,
  coalesce((SELECT string_agg(DISTINCT 'runbook:' || c_mktsegment, ',' ORDER BY 'runbook:' || c_mktsegment) FROM customer WHERE 'nation:' || c_nationkey = n.id), '') AS runbooks, title || ' affects ' || coalesce(n_down, 0) || ' entities [S1]' AS answer FROM n LEFT JOIN d USING (id) LEFT JOIN u USING (id)""".replace("d AS (SELECT id, count", "dn AS (SELECT id, count").replace("LEFT JOIN d USING", "LEFT JOIN dn USING"))
def context_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with what is one step from them, their customers' unfinished orders as incidents, their
    market segments as runbooks, and the rule answer about their impact."""
    f = graph.flow(graph_queries.edges(spark, sf_dir))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"), F.lit(None).cast("string").alias("team"), F.lit("ok").alias("status"))
    side = lambda at, to: f.join(n.select(F.col("id").alias(at)), at, "left_semi").select(F.col(at).alias("id"), F.col(to).alias("other"), F.lit(1).alias("distance"))
    c = table(spark, sf_dir, "customer").withColumn("id", F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")))
    stuck = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").join(c, F.col("o_custkey") == F.col("c_custkey"))
    gathered = lambda df, x: df.groupBy("id").agg(F.array_sort(F.collect_set(x)).alias("ids"))
    cases = gathered(stuck, F.concat(F.lit("INC-"), F.col("o_orderkey").cast("string")))
    b = asking.context_bundle(n, side("a", "b"), side("b", "a"), cases, gathered(c, F.concat(F.lit("runbook:"), "c_mktsegment")))
    asked = n.select(F.col("id").alias("qid"), F.lit("impact").alias("intent"), "id")
    counts = b.select("id", "title", F.size("downstream").cast("long").alias("n_down"), F.size("upstream").cast("long").alias("n_up"), F.array_join("incidents", ",").alias("incidents"), F.array_join("runbooks", ",").alias("runbooks"))
    return counts.join(asking.rule_answer(asked, b).select("id", "answer"), "id")
