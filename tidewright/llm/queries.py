"""The training-data operators as queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents under the 50k byte-level vocabulary."""
    import public_tokenizers

    from tidewright.llm.tokens import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens").withColumn("over_limit", F.col("n_tokens") > 1024)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every whole text of documents."""
    from tidewright.llm.decontam import find_leaks

    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("leaks.spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    found = found.select("doc_id", F.col("leaks.n_words").alias("n_words"), n_hit.alias("n_hit"), F.col("leaks.items").alias("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
il AS (SELECT item_id, w, least(len(w), 10) AS l FROM iw WHERE len(w) > 0),
iwin AS (SELECT DISTINCT item_id, l, g FROM (SELECT item_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS g FROM il)),
dpos AS (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM dw, (SELECT DISTINCT l FROM il) WHERE len(w) >= l),
hits AS (SELECT rid, p, d.l, item_id FROM (SELECT rid, l, p, array_to_string(w[p:p + l - 1], ' ') AS g FROM dpos) d JOIN iwin USING (l, g)),
hw AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + l)) AS q FROM hits) GROUP BY rid),
hi AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences that a document is, and those that its lines name."""
    from tidewright.llm.licenses import default_licenses, scan

    found = scan(table(spark, sf_dir, "documents"), default_licenses(spark))
    return found.select("doc_id", "license_id", F.array_join("notices", ",").alias("notices"), "n_notice_lines")


def op3_sql() -> str:
    """The same in DuckDB's SQL."""
    from tidewright.llm.license_texts import catalogue
    from tidewright.llm.licenses import COPYRIGHT_LINE, PUNCTUATION, SPELLINGS

    def canonical(x: str) -> str:
        x = f"regexp_replace(lower({x}), '{COPYRIGHT_LINE}', chr(10), 'g')"
        x = f"trim(regexp_replace({x}, '{PUNCTUATION}', ' ', 'g'))"
        for a, b in SPELLINGS:
            x = f"replace({x}, '{a}', '{b}')"
        return x

    values = ", ".join("('{}', '{}')".format(*(v.replace("'", "''") for v in row)) for row in catalogue())
    return f"""
WITH k AS (SELECT sha256(c) AS digest, min(license_id) AS license_id
           FROM (SELECT license_id, {canonical("t")} AS c FROM (VALUES {values}) v(license_id, t)) WHERE c <> '' GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
u AS (SELECT rid, true AS whole, text AS t FROM d UNION ALL SELECT rid, false, unnest(string_split(text, chr(10))) FROM d),
c AS (SELECT rid, whole, {canonical("t")} AS c FROM u WHERE t IS NOT NULL),
h AS (SELECT rid, whole, license_id FROM c JOIN k ON sha256(c) = digest WHERE c <> ''),
g AS (SELECT rid, min(license_id) FILTER (whole) AS license_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) FILTER (NOT whole) AS notices, count(*) FILTER (NOT whole) AS n FROM h GROUP BY rid)
SELECT doc_id, license_id, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notice_lines FROM d LEFT JOIN g USING (rid)
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of the rules."""
    from tidewright.llm.quality_rules import judge

    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *(F.col(f"quality.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op4_sql() -> str:
    """The same in DuckDB's SQL, windows compared by their words."""
    from tidewright.llm.quality_rules import RULES, STOP_WORDS

    rules = []
    for r in RULES:
        a, b = (f"{x.strip()}::DOUBLE" for x in r.value.split("/"))
        v = f"({a} / nullif({b}, 0))"
        inside = " AND ".join([f"{v} >= {r.least}"] * (r.least is not None) + [f"{v} <= {r.most}"] * (r.most is not None))
        rules.append(f"(coalesce({inside}, true) OR n_words < {r.from_words})")
    stops = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(w[i:i + 7], ' ')) AS n FROM p),
r AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS q FROM g WHERE n > 1) GROUP BY rid),
s AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(length(t) - length(translate(t, '!?', '')) AS BIGINT) AS n_marks, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop
  FROM l LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(rules)} AS kept
FROM b
"""


def _remainder(n: int):
    """crc32 of the doc_id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def quality_model(docs: DataFrame, spark: SparkSession, sf_dir: str):
    """The rule ensemble fitted to the labels that are not held out."""
    from tidewright.llm.rule_ensemble import learn

    return learn(docs, table(spark, sf_dir, "labels").where(_remainder(3) != 1), "quality")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a rule ensemble."""
    from tidewright.llm.rule_ensemble import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, quality_model(docs, spark, sf_dir))
    return scored.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by positive-unlabelled learning."""
    from tidewright.llm.toxicity import learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels").where(_remainder(5) != 0))
    return score(docs, model).select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the chunks and runs of lines that an earlier place has."""
    from tidewright.llm.line_dedup import remove_repeats

    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("clean.text").alias("text"), F.col("clean.n_chunks").alias("n_chunks"), F.col("clean.n_lines").alias("n_lines"), F.col("clean.first_ids").alias("first_ids"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from tidewright.llm.html_main import extract

    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from tidewright.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words, weighted by source, takes of each document."""
    from tidewright.llm.mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         ((coalesce(doc_id, 0) % 2147483647 + 2147483647) % 2147483647 * 48271) % 2147483647 AS stir
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_rows,
         row_number() OVER (ORDER BY source NULLS LAST) AS rnk
  FROM d GROUP BY source),
w AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(cap, max(level) OVER () * weight) AS target, CAST(ceil(source_size / 128.0) AS BIGINT) AS n_blocks, CAST(ceil(n_rows / 8192.0) AS BIGINT) AS n_buckets FROM l),
u AS (SELECT *, CASE WHEN n_blocks = 0 THEN 0 ELSE least(CAST(round(target / (source_size::DOUBLE / n_blocks)) AS BIGINT), 2 * n_blocks) END AS n_slots FROM t),
laps AS (SELECT rnk, n_blocks, n_slots, lap, (((7 + rnk * 7919 + lap * 104729) % 2147483647) * 48271) % 2147483647 AS draw FROM u, range(0, 2) r(lap) WHERE n_slots > lap * n_blocks),
steps AS (
  SELECT *, list_filter([1000003, 1000033, 1000037, 1000039, 1000081, 1000099, 1000117, 1000121, 1000133, 1000151, 1000159, 1000171, 1000183, 1000187, 1000193, 1000199], lambda p: n_blocks % p <> 0) AS primes
  FROM laps),
slots AS (SELECT rnk, n_blocks, draw, primes[draw % len(primes) + 1]::BIGINT AS step, unnest(range(0, least(n_blocks, n_slots - lap * n_blocks))) AS i FROM steps),
times AS (SELECT rnk, (step * i + draw) % n_blocks AS block, count(*) AS times FROM slots GROUP BY ALL),
p AS (
  SELECT d.doc_id, d.size, u.rnk, u.source_size, u.target,
         CAST(sum(d.size) OVER (PARTITION BY u.rnk ORDER BY d.stir % u.n_buckets, d.stir, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
b AS (SELECT *, unnest(range(start // 128, (start + size - 1) // 128 + 1)) AS block FROM p WHERE size > 0),
k AS (SELECT rnk, start, CAST(sum((least(start + size, (block + 1) * 128) - greatest(start, block * 128)) * coalesce(times, 0)) AS BIGINT) AS taken FROM b LEFT JOIN times USING (rnk, block) GROUP BY rnk, start)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE taken END AS taken
FROM p LEFT JOIN k ON p.rnk = k.rnk AND p.start = k.start AND p.size > 0
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of 2 to 5 words in all documents."""
    from tidewright.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, range(1, 6) s(size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE size > 1 AND f >= 100),
i AS (
  SELECT DISTINCT lang, phrase, a FROM (
    SELECT lang, array_to_string(w[x:x + s - 1], ' ') AS phrase, a FROM (
      SELECT lang, w, a, s, unnest(range(1, size - s + 2)) AS x FROM c, range(2, 5) r(s) WHERE s < size))),
k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)),
u AS (SELECT *, unnest(range(1, size)) AS cut FROM k),
s AS (
  SELECT u.lang, u.phrase, u.a, cut, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * u.a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM u JOIN t ON t.lang = u.lang
  JOIN f l ON l.lang = u.lang AND l.size = cut AND l.phrase = array_to_string(w[1:cut], ' ')
  JOIN f r ON r.lang = u.lang AND r.size = u.size - cut AND r.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY rank <= 2000
"""


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for each hundredth one, by integer inner product."""
    from tidewright.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


OP12_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 10
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, each opened by turns of the first one of its hundred."""
    from tidewright.llm.prefix_trie import numbered_turns, trie, with_openings

    turns = numbered_turns(table(spark, sf_dir, "conversations"))
    c = F.col("conv")
    return trie(*with_openings(turns, c - c % 100, F.crc32(c.cast("string")) % 6, 5))


#: CRC-32 is not a function of DuckDB: it is reduced byte by byte, bit by bit.
OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 64)) AS p,
         struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(k ORDER BY p) AS l FROM t GROUP BY c),
h AS (
  SELECT c, l, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
         lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: xor(a >> 1, 3988292384 * (a & 1))))) % 6 AS h
  FROM o),
b AS (SELECT h.c, list_concat(coalesce(o.l[1:h.h], []), h.l[h.h + 1:]) AS l FROM h LEFT JOIN o ON o.c = h.c - h.c % 100),
p AS (SELECT c, len(l) AS n, unnest(range(0, len(l) + 1)) AS d, l FROM b),
m AS (SELECT c, n, d, l[1:d] AS pre FROM p),
nodes AS (
  SELECT d, pre, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM m GROUP BY d, pre),
kids AS (SELECT d - 1 AS d, pre[1:d - 1] AS pre, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
base AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN nodes.d = 0 THEN 0 ELSE (n_convs - 1) * length(nodes.pre[nodes.d].t) END AS saves
  FROM nodes LEFT JOIN kids USING (d, pre)),
up AS (SELECT n_children, saves, pre[1:a] AS pre, a AS d FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM base)),
sums AS (SELECT d, pre, CAST(sum(saves) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY d, pre)
SELECT b.conv_id, CAST(b.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, b.n_convs, b.n_children, n_leaves, saved_tokens, b.ends_sha256
FROM base b JOIN sums USING (d, pre) LEFT JOIN nodes q ON b.d > 0 AND q.d = b.d - 1 AND q.pre = b.pre[1:b.d - 1]
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_decontaminate, op3_license_scan, op4_quality_rules, op5_quality_classifier, op6_toxicity, op7_line_dedup, op8_html_extraction, op9_simhash_near_duplicates, op10_mix_sources, op11_collocations, op12_top_k, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op3_license_scan": op3_sql(), "op4_quality_rules": op4_sql(), "op10_mix_sources": OP10_SQL, "op11_collocations": OP11_SQL, "op12_top_k": OP12_SQL, "op13_prefix_trie": OP13_SQL}
