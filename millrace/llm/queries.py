"""The registered queries of the operators: whole tables, production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import backoff, conversations, decontaminate, embeddings, html, huffman, language, mixing, pieces, repeats, runs, simhash, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return keep


#: CRC-32 of the ASCII text of column ``{0}``, unsigned.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda v, s: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"""
WORDS = "list_filter(regexp_split_to_array(coalesce({0}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query()
def op1_html_extraction(spark, sf_dir):
    return html.page_texts(table(spark, sf_dir, "pages"))


@query()
def op2_huffman_tokens(spark, sf_dir):
    return huffman.token_digest(table(spark, sf_dir, "documents"))


@query()
def op3_url_filter(spark, sf_dir):
    return urls.page_verdicts(table(spark, sf_dir, "pages"))


@query()
def op4_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query()
def op5_sentencepiece(spark, sf_dir):
    return pieces.round_trip(table(spark, sf_dir, "documents"))


@query(sql="""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS seq FROM w, unnest(range(1, len(words) - 48)) u(i)),
f AS (SELECT seq, min(doc_id) AS first FROM s GROUP BY seq),
r AS (SELECT doc_id, list(i) AS hits FROM s JOIN f USING (seq) WHERE first < doc_id GROUP BY doc_id),
gone AS (SELECT doc_id, count(DISTINCT k) AS n_removed, list(DISTINCT k) AS ks FROM r, unnest(hits) h(i), unnest(range(i, i + 50)) p(k) GROUP BY doc_id),
kept AS (SELECT w.doc_id, k, words[k] AS word FROM w, unnest(range(1, len(words) + 1)) u(k)),
keys AS (SELECT doc_id, unnest(ks) AS k FROM gone),
texts AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t FROM kept ANTI JOIN keys USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN texts USING (doc_id)""")
def op6_substring_dedup(spark, sf_dir):
    return repeats.digest(repeats.drop_repeats(table(spark, sf_dir, "documents")))


@query()
def op7_simhash(spark, sf_dir):
    return simhash.digest(simhash.near_copies(table(spark, sf_dir, "documents")))


@query()
def op9_decontamination(spark, sf_dir):
    return decontaminate.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op10_lm_scoring(spark, sf_dir):
    return backoff.document_scores(table(spark, sf_dir, "documents"))


@query()
def op8_embedding_near_dedup(spark, sf_dir):
    return embeddings.digest(embeddings.near_copies(table(spark, sf_dir, "embeddings")))


@query(sql=f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS.format("text")}) AS BIGINT) AS size,
  substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, 15) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS most, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
k AS (SELECT (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM w WINDOW before AS (ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), (SELECT max(level) FROM k) * weight) AS target FROM w),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN 2 * earlier + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r""")
def op11_source_mixing(spark, sf_dir):
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


@query(sql=f"""
WITH w0 AS (SELECT doc_id, {WORDS.format("text")} AS w, CAST({CRC32.format("doc_id")} AS BIGINT) AS h FROM documents),
w1 AS (SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g FROM w0),
w2 AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM w1),
w3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w2),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS words FROM w3),
f AS (SELECT doc_id, n, i, array_to_string(words[i + 1:i + 5], ' ') AS five FROM d, unnest(range(n - 4)) u(i)),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.five = y.five AND y.i > x.i AND (y.i - x.i) * 4 <= x.n),
b AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
c AS (SELECT doc_id, min(i) AS start, count(*) + 4 + q AS length, q AS period FROM b GROUP BY doc_id, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c s WHERE s.doc_id = c.doc_id AND s.period < c.period AND s.start <= c.start AND s.start + s.length >= c.start + c.length)),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
m AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS nr FROM r) WHERE nr = 1),
gone AS (SELECT DISTINCT doc_id, k FROM r, unnest(range(start + period, start + length)) u(k)),
kept AS (SELECT doc_id, string_agg(words[k + 1], ' ' ORDER BY k) AS t FROM (SELECT doc_id, words, k FROM d, unnest(range(n)) u(k)) ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def op12_periodic_runs(spark, sf_dir):
    return runs.digest(runs.find_runs(runs.with_planted_runs(table(spark, sf_dir, "documents")), "id", "text"))


@query(sql=f"""
WITH t0 AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS k,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, max(k) AS n, CAST({CRC32.format("c")} AS BIGINT) % 4 AS h, c - c % 20 AS base FROM t0 GROUP BY c),
l AS (SELECT s.*, least(h, coalesce((SELECT max(k) FROM t0 WHERE t0.c = s.base), 0)) AS got FROM s),
r AS (SELECT l.c, t0.k AS depth, role, text FROM l JOIN t0 ON t0.c = l.base AND t0.k <= l.h
  UNION ALL SELECT l.c, t0.k - h + got, role, text FROM l JOIN t0 ON t0.c = l.c AND t0.k > l.h),
p AS (SELECT c, depth, len({WORDS.format("text")}) AS words, list(struct_pack(role, text)) OVER (PARTITION BY c ORDER BY depth) AS seq FROM r
  UNION ALL SELECT c, 0, 0, [] FROM s),
q AS (SELECT c, depth, words, md5(CAST(seq AS VARCHAR) || len(seq)) AS key, depth = max(depth) OVER (PARTITION BY c) AS last FROM p),
v AS (SELECT depth, key, min(c) AS conv, count(*) AS n_convs, max(words) AS words, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last) AS ends FROM q GROUP BY depth, key),
o AS (SELECT v.*, u.key AS up, u.conv AS parent FROM v LEFT JOIN q ON q.c = v.conv AND q.depth = v.depth - 1 LEFT JOIN v u ON u.depth = q.depth AND u.key = q.key),
ch AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n FROM o WHERE depth > 0 GROUP BY ALL),
z AS (SELECT o.*, coalesce(n, 0) AS n_children FROM o LEFT JOIN ch USING (depth, key)),
st AS (SELECT q.depth, q.key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * z.words) AS saved FROM z JOIN q ON q.c = z.conv AND q.depth <= z.depth GROUP BY q.depth, q.key)
SELECT conv AS conv_id, depth, parent AS parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM z JOIN st USING (depth, key)""")
def op13_conversation_trie(spark, sf_dir):
    return conversations.digest(conversations.conversation_trie(table(spark, sf_dir, "conversations")))
