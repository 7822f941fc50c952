"""Tokens, search, ranking, vectors and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import text as tx
from tidewright.operators import fielded, search
from tidewright.plans.registry import Registry
from tidewright.session import scratch, table

registry = Registry()

#: Questions of the search queries: literal rows.
QUERIES = [(1, "the eredion idiot"), (2, "token password clown"), (3, "heit ung lich"), (4, "ment de eaux"), (5, "licensed under apache license")]
SYNONYMS = [(1, "idiot"), (1, "moron"), (2, "license"), (2, "licence"), (2, "apache"), (3, "zzz"), (3, "token")]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "qid long, query string")


Q_SQL = f"q AS (SELECT qid::BIGINT AS qid, query FROM (VALUES {_values(QUERIES)}) v(qid, query))"


@registry.add("SELECT doc_id, len(t)::BIGINT AS n, len(list_distinct(t))::BIGINT AS n_distinct, list_aggregate(list_sort(t), 'max') AS last FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents)")
def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text."""
    d = table(spark, sf_dir, "documents").select("doc_id", tx.tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_max("t").alias("last"))


@registry.add(r"""WITH i AS (SELECT page_id, unnest(regexp_extract_all(lower(url), '[A-Za-z0-9][A-Za-z0-9_.\-]*')) AS x FROM pages),
u AS (SELECT page_id, regexp_replace(x, '[.-]', '_', 'g') AS t FROM i UNION ALL SELECT page_id, unnest(list_filter(regexp_split_to_array(x, '[._-]'), lambda p: p <> '')) FROM i)
SELECT page_id, string_agg(t, ' ' ORDER BY t) AS idents FROM u GROUP BY 1""")
def tokenize_idents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in page URLs, whole and in parts."""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(tx.ident_tokens("url")), " ").alias("idents"))


@registry.add("""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[à-ÿ]+')) AS r FROM documents), g AS (SELECT doc_id, unnest(CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END) AS g FROM r)
SELECT g AS bigram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY 1""")
def tokenize_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-letter pieces of runs of accented letters, over all texts."""
    g = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.bigrams("text", "[à-ÿ]")).alias("bigram"))
    return g.groupBy("bigram").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@registry.add("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), t AS (SELECT doc_id, array_to_string(list_transform(l, lambda x, i: CASE WHEN i % 4 = 3 THEN '## ' || x ELSE x END), chr(10)) AS t FROM l),
p AS (SELECT doc_id, string_split(t, chr(10) || '## ') AS p FROM t), s AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS k, len(p) AS n FROM p),
b AS (SELECT doc_id, k, CASE WHEN k = 1 THEN '' ELSE trim(split_part(x, chr(10), 1)) END AS section, CASE WHEN k = 1 THEN '' ELSE '## ' END || x || CASE WHEN k < n THEN chr(10) ELSE '' END AS body FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS chunk, section, length(body)::BIGINT AS n_chars, sha256(body)[1:12] AS hash FROM b WHERE trim(body, ' ' || chr(10) || chr(9) || chr(13)) <> ''""")
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, every fourth line a heading, in chunks by section, blank ones left out, numbered
    within their document."""
    headed = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 4 == 2, F.concat(F.lit("## "), x)).otherwise(x)), "\n")
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.sections(headed)).alias("k", "s"))
    return d.select("doc_id", (F.col("k") + 1).cast("long").alias("chunk"), "s.section", F.char_length("s.body").cast("long").alias("n_chars"), F.substring(F.sha2("s.body", 256), 1, 12).alias("hash"))


BM25_SQL = f"""{Q_SQL},
qt AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(query), '[\\p{{L}}0-9_]+')) AS term FROM q),
d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(source, '')), '[\\p{{L}}0-9_]+') AS ti, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}0-9_]+') AS bo FROM documents),
s AS (SELECT count(*) AS n_docs, avg(len(ti) + len(bo)) AS avg_len FROM d),
p AS (SELECT id, l, term, sum(w) AS wtf FROM (SELECT id, len(ti) + len(bo) AS l, unnest(ti) AS term, 3.0::DOUBLE AS w FROM d UNION ALL SELECT id, len(ti) + len(bo), unnest(bo), 1.0::DOUBLE FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
b AS (SELECT qid, id, sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * l / avg_len))) AS s FROM p JOIN qt USING (term) JOIN f USING (term), s GROUP BY ALL),
k AS (SELECT * FROM (SELECT qid, id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, id) AS rank FROM b) WHERE rank <= 100)"""


def _keyword(spark: SparkSession, sf_dir: str, allowed: Column | None = None) -> DataFrame:
    t = lambda c: tx.tokens(c, r"[\p{L}0-9_]+")
    terms = questions(spark).select("qid", F.explode(t("query")).alias("term"))
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", {"title": (t("source"), 3.0), "body": (t("text"), 1.0)}, terms, 100, allowed=allowed)


@registry.add(f"WITH {BM25_SQL} SELECT qid, id, score, rank FROM k WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each question by weighted BM25: a report of the top."""
    return _keyword(spark, sf_dir).where("rank <= 10")


@registry.add(f"""WITH {Q_SQL}, s AS (SELECT * FROM (VALUES {_values(SYNONYMS)}) v(gid, member)), c AS (SELECT DISTINCT qid, gid FROM q JOIN s ON contains(lower(query), member)),
x AS (SELECT qid, string_agg(member, ' ' ORDER BY gid, member) AS more FROM (SELECT DISTINCT qid, gid, member FROM c JOIN s USING (gid) JOIN q USING (qid) WHERE NOT contains(lower(query), member)) GROUP BY 1)
SELECT qid, query || ' ' || coalesce(more, '') AS expanded FROM q LEFT JOIN x USING (qid)""")
def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the synonyms that they call for."""
    return search.expand(questions(spark), spark.createDataFrame(SYNONYMS, "gid long, member string")).select("qid", "expanded")


VEC_SQL = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-9 AS n, label FROM embeddings),
vp AS (SELECT a.id AS qid, b.id, list_dot_product(a.e, b.e) / (a.n * b.n) AS s FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id),
vk AS (SELECT * FROM (SELECT qid, id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM vp) WHERE rank <= 10)"""


def _vectors(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    hits = search.cosine_top(e, asked, limit + 1).where("qid <> id")
    return hits.withColumn("_r", F.col("rank")).drop("rank").transform(lambda d: search.top(d, ["qid"], [F.asc("_r")], limit)).drop("_r")


@registry.add(f"WITH {VEC_SQL} SELECT qid, id, score, rank FROM vk")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth, exactly."""
    return _vectors(spark, sf_dir, 10)


@registry.add(f"""WITH {VEC_SQL}, r AS (SELECT a.id AS qid, b.id FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE a.id % 100 = 0),
n AS (SELECT qid, count(*) AS n_relevant FROM r GROUP BY 1), g AS (SELECT qid, count_if(rank <= 5) AS c, min(rank) AS f FROM vk JOIN r USING (qid, id) GROUP BY 1),
p AS (SELECT qid, coalesce(c, 0) / n_relevant AS recall, coalesce(1.0::DOUBLE / f, 0) AS rr FROM n LEFT JOIN g USING (qid))
SELECT count(*) AS queries, round(avg(round(recall, 6)), 6) AS recall, round(avg(round(rr, 6)), 6) AS mrr, 0.0::DOUBLE AS zero_rate, count_if(rr < 0.5)::BIGINT AS misses, false AS passed FROM p""")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval quality of the vector search with equal labels as relevance."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label")
    members = e.withColumnRenamed("vec_id", "id")
    return search.evaluation_summary(search.evaluate_groups(_vectors(spark, sf_dir, 10), members, asked))


FUSED_SQL = f"""{BM25_SQL}, l AS (SELECT qid, id, rank FROM k UNION ALL SELECT qid, id, rank FROM (SELECT qid, doc_id AS id, row_number() OVER (PARTITION BY qid ORDER BY n_chars DESC, doc_id) AS rank FROM q, documents WHERE lang = 'en') WHERE rank <= 50),
fu AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(rank) AS best FROM l GROUP BY ALL), fr AS (SELECT qid, id, round(s, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, best, id) AS rank FROM fu)"""
ENGLISH_SQL = FUSED_SQL.replace("FROM b) WHERE rank <= 100", "FROM b JOIN documents ON doc_id = id WHERE lang = 'en') WHERE rank <= 100")


def _fused(spark: SparkSession, sf_dir: str, allowed: Column | None = None) -> DataFrame:
    """Keyword hits fused with a list of the longest English documents (a stand-in for a vector
    list)."""
    longest = table(spark, sf_dir, "documents").where("lang = 'en'").orderBy(F.desc("n_chars"), "doc_id").limit(50).select(F.col("doc_id").alias("id"), "n_chars")
    second = search.top(longest.join(F.broadcast(questions(spark).select("qid")), F.lit(True)), ["qid"], [F.desc("n_chars"), F.asc("id")], 50).select("qid", "id", "rank")
    return search.fuse(_keyword(spark, sf_dir, allowed).select("qid", "id", "rank").unionByName(second))


@registry.add(f"WITH {FUSED_SQL} SELECT qid, id, score, rank FROM fr WHERE rank <= 10")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists fused: a report of the top."""
    return _fused(spark, sf_dir).where("rank <= 10")


@registry.add(f"""WITH {ENGLISH_SQL}, a AS (SELECT qid, CASE WHEN qid = 1 THEN 'src4' ELSE lower(query) END AS name FROM q),
e AS (SELECT DISTINCT qid, doc_id AS id FROM documents, a WHERE lang = 'en' AND (lower(source) = name OR doc_id::VARCHAR = name)),
h AS (SELECT fr.qid, fr.id, fr.rank FROM fr JOIN documents ON doc_id = id WHERE lang = 'en'),
m AS (SELECT coalesce(h.qid, e.qid) AS qid, coalesce(h.id, e.id) AS id, h.rank AS was, e.id IS NOT NULL AS exact FROM h FULL JOIN e ON h.qid = e.qid AND h.id = e.id)
SELECT qid, id, rank, exact FROM (SELECT qid, id, exact, row_number() OVER (PARTITION BY qid ORDER BY exact DESC, was NULLS LAST, id) AS rank FROM m) WHERE rank <= 8""")
def exact_promoted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused hits of a search in English documents, exact titles first: a report of the top."""
    asked = questions(spark).withColumn("query", F.when(F.col("qid") == 1, "src4").otherwise(F.col("query")))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "lang")
    return search.promoted(_fused(spark, sf_dir, F.col("lang") == "en"), docs, asked, 8, {"lang": "en", "title": None})


#: Fields of the search index with their boosts: all of the first add up, the best of the second
#: counts where enough of its terms are met (fixed values).
MOST, BEST = {"title": 3.0, "body": 1.0, "title.ident": 3.0, "body.ident": 1.5}, {"title.bigram": 0.6, "body.bigram": 0.2}


def _analysers(title: Column, body: Column) -> dict[str, Column]:
    """Tokens of each field: words, identifiers whole and in parts, two-character pieces."""
    kinds = {"": lambda c: tx.tokens(c, r"[\p{L}0-9_]+"), ".ident": tx.ident_terms, ".bigram": lambda c: tx.bigrams(F.lower(c), r"[\p{L}\p{Nd}]")}
    return {f"{name}{kind}": cut(c) for kind, cut in kinds.items() for name, c in (("title", title), ("body", body))}


def _fielded(spark: SparkSession, sf_dir: str, limit: int, allowed: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    source = {f: tx.tokens({"title": "source", "body": "text"}[f.split(".")[0]], r"[\p{L}\p{Nd}]+") if f in BEST else c for f, c in _analysers(F.col("source"), F.col("text")).items()}
    index = fielded.write_index(docs, "doc_id", source, scratch(spark, "index"), runs=tuple(BEST))
    asked = F.col("query")
    return fielded.search(index, fielded.question_terms(questions(spark), _analysers(asked, asked)), MOST, BEST, 0.6, limit, allowed)


FIELDED_SQL = rf"""{Q_SQL},
raw AS (SELECT doc_id AS id, 'title' AS f, source AS t FROM documents UNION ALL SELECT doc_id, 'body', text FROM documents),
qraw AS (SELECT qid AS id, f, query AS t FROM q, (VALUES ('title'), ('body')) v(f)),
tok AS (
  SELECT w, id, f || k AS field, unnest(CASE k
    WHEN '' THEN regexp_extract_all(t, '[\p{{L}}0-9_]+')
    WHEN '.ident' THEN flatten(list_transform(regexp_extract_all(t, '[a-z0-9][a-z0-9_.\-]*'), lambda x: list_concat([regexp_replace(x, '[.-]', '_', 'g')], list_filter(regexp_split_to_array(x, '[._-]'), lambda p: p <> ''))))
    ELSE flatten(list_transform(regexp_extract_all(t, '[\p{{L}}\p{{Nd}}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)) END) AS term
  FROM (SELECT 'd' AS w, id, f, lower(coalesce(t, '')) AS t FROM raw UNION ALL SELECT 'q', id, f, lower(t) FROM qraw), (VALUES (''), ('.ident'), ('.bigram')) kinds(k)),
lens AS (SELECT id, field, count(*) AS len FROM tok WHERE w = 'd' GROUP BY ALL),
st AS (SELECT field, count(*) AS n_docs, avg(len) AS avg_len FROM lens GROUP BY 1),
qt AS (SELECT DISTINCT id AS qid, field, term FROM tok WHERE w = 'q'),
po AS (SELECT id, field, term, count(*) AS tf FROM tok WHERE w = 'd' AND (field, term) IN (SELECT field, term FROM qt) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM po GROUP BY ALL),
bo AS (SELECT * FROM (VALUES {", ".join(f"('{f}', {b}::DOUBLE, {f in BEST})" for f, b in {**MOST, **BEST}.items())}) v(field, boost, late)),
per AS (SELECT qid, po.id, field, late, sum(boost * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score, count(*) AS matched
  FROM po JOIN qt USING (field, term) JOIN df USING (field, term) JOIN st USING (field) JOIN lens USING (id, field) JOIN bo USING (field) GROUP BY ALL),
need AS (SELECT qid, field, greatest(1, floor(count(*) * 0.6::DOUBLE)) AS need FROM qt GROUP BY ALL),
cl AS (SELECT qid, id, score FROM per WHERE NOT late UNION ALL SELECT qid, id, max(score) FROM per JOIN need USING (qid, field) WHERE late AND matched >= need GROUP BY ALL),
sc AS (SELECT qid, id, sum(score) AS score FROM cl GROUP BY ALL)"""


@registry.add(f"WITH {FIELDED_SQL} SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sc) WHERE rank <= 20")
def fielded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of each question in six fields of a written index: a report of the
    top."""
    return _fielded(spark, sf_dir, 20)


@registry.add(f"WITH {FIELDED_SQL} SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT sc.*, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sc JOIN documents ON doc_id = id WHERE lang = 'de') WHERE rank <= 20")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in German documents only: the filter applies before ranks are cut."""
    return _fielded(spark, sf_dir, 20, table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").alias("id")))


PLAIN_SQL = "text"
for _pattern, _by in tx.MARKUP:
    PLAIN_SQL = f"regexp_replace({PLAIN_SQL}, '{_pattern}', '{_by}', 'g')"


@registry.add(f"""WITH c AS (SELECT doc_id, trim({PLAIN_SQL}) AS t FROM documents), p AS (SELECT *, coalesce(nullif(instr(lower(t), 'license'), 0), nullif(instr(lower(t), 'li'), 0), nullif(instr(lower(t), 'mit'), 0), nullif(instr(lower(t), 'mi'), 0), 1) AS p FROM c), s AS (SELECT *, greatest(1, p - 30) AS st FROM p)
SELECT doc_id, CASE WHEN st > 1 THEN '…' ELSE '' END || substr(t, st, 90) || CASE WHEN st + 89 < length(t) THEN '…' ELSE '' END AS snippet FROM s""")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surroundings of a question's words in each text."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.snippet("text", "MIT license").alias("snippet"))


@registry.add("""WITH n AS (SELECT * FROM (VALUES ('licence:mit', 'MIT License'), ('licence:apache', 'Apache License'), ('licence:gpl', 'GNU General Public License'), ('word:idiot', 'idiot'), ('word:scum', 'scum'), ('word:ung', 'ung'), ('word:token', 'token')) v(entity, name))
SELECT doc_id AS id, entity, min(instr(lower(text), lower(name)))::BIGINT AS "at" FROM documents JOIN n ON regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])' || name || '($|[^A-Za-z0-9])') GROUP BY ALL""")
def dictionary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a dictionary in the texts, at word boundaries."""
    names = [("licence:mit", "MIT License"), ("licence:apache", "Apache License"), ("licence:gpl", "GNU General Public License"), ("word:idiot", "idiot"), ("word:scum", "scum"), ("word:ung", "ung"), ("word:token", "token")]
    found = search.dictionary_match(table(spark, sf_dir, "documents"), spark.createDataFrame(names, "entity string, name string"), "doc_id", "text")
    return found.withColumn("at", F.col("at").cast("long"))


@registry.add("""WITH n AS (SELECT DISTINCT p_name FROM part), g AS (SELECT * FROM (VALUES ('*red*'), ('b?ue*'), ('*small'), ('part*'), ('*er*')) v(pattern))
SELECT pattern, p_name FROM g JOIN n ON p_name GLOB pattern""")
def glob_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names that file-name patterns match."""
    patterns = spark.createDataFrame([("*red*",), ("b?ue*",), ("*small",), ("part*",), ("*er*",)], "pattern string")
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.join(F.broadcast(patterns), F.call_function("rlike", F.col("p_name"), tx.glob_regex(F.col("pattern")))).select("pattern", "p_name")


@registry.add("SELECT doc_id, sum(len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')))::BIGINT AS n_numbers, string_agg(regexp_extract(text, '[0-9]+(?:[.,][0-9]+)*'), '') AS first_number FROM documents WHERE regexp_matches(text, '[0-9]') GROUP BY 1")
def number_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the texts."""
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]"))
    return d.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(tx.NUMBER), F.lit(0))).cast("long").alias("n_numbers"), F.regexp_extract("text", tx.NUMBER, 0).alias("first_number"))
