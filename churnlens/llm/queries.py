"""Registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import (collocations, flatgraph, htmltext, langid, lexical, linerules, mixing, packing, simhash,
                           tokencount, topk, urlrules, wavelet)
from churnlens.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS iv FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.iv, c.iv)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op1_exact_top_k", TOPK_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(read_table(spark, sf_dir, "embeddings"))


@query("op2_main_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(read_table(spark, sf_dir, "pages"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


URL_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest,
         CASE WHEN contains(url, '://') THEN split_part(url, '://', 1) ELSE '' END AS scheme FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
t AS (SELECT *, rest[length(raw) + 1:] AS tail FROM h),
p AS (SELECT page_id, scheme, tail, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(tail, '^[^?#]*') AS path FROM t),
k AS (
  SELECT page_id, host, path, list_sort(list_distinct(
    ['s:' || scheme]
    || list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x)
    || list_transform(list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: x <> ''),
                      lambda x: 'p:' || x)
    || list_transform(list_filter(string_split(regexp_extract(tail[length(path) + 1:], '^\?([^#]*)', 1), '&'),
                                  lambda x: x <> ''), lambda x: 'q:' || x)
    || list_filter(['f:' || regexp_extract(tail, '#((?s:.*))$', 1)], lambda x: x <> 'f:'))) AS tokens,
    try_cast(regexp_extract(path, '/([0-9]+)(?:[./][^/]*)?$', 1) AS BIGINT) AS doc
  FROM p),
l AS (SELECT doc_id, bool_or(coalesce(toxic = 1, false) OR coalesce(quality = 0, false)) AS blocked FROM labels
      WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY doc_id),
sets AS (SELECT DISTINCT tokens FROM k),
part AS (
  SELECT tokens, list_sort(list_filter(tokens, lambda x, i: (m >> (i - 1)::BIGINT) & 1 = 1)) AS items
  FROM (SELECT tokens, unnest(range(1, 1::BIGINT << len(tokens))) AS m FROM sets)),
labelled AS (SELECT k.tokens, l.blocked FROM k JOIN l ON k.doc = l.doc_id),
freq AS (SELECT items, count(*) AS n, count(*) FILTER (blocked) AS b FROM labelled JOIN part USING (tokens) GROUP BY items),
base AS (SELECT count(*) FILTER (blocked) / count(*)::DOUBLE AS p0 FROM labelled),
rules AS (
  SELECT items FROM (SELECT items, b, n::DOUBLE AS n, b / n::DOUBLE AS p FROM freq), base
  WHERE b >= 5 AND p >= 0.6
    AND (p + 16 / (2 * n) - 4 * sqrt(p * (1 - p) / n + 16 / (4 * n * n))) / (1 + 16 / n) > p0),
bad AS (SELECT DISTINCT tokens FROM part JOIN rules USING (items)),
listed(says, name, dir) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT k.host, k.path, max_by(says, length(name || dir)) AS says, max_by(name || dir, length(name || dir)) AS rule
  FROM (SELECT DISTINCT host, path FROM k) k JOIN listed
    ON (k.host = name OR ends_with(k.host, '.' || name)) AND starts_with(k.path, dir) GROUP BY ALL)
SELECT k.page_id, k.host, k.path, best.rule,
       coalesce(best.says, CASE WHEN bad.tokens IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM k LEFT JOIN best ON k.host = best.host AND k.path = best.path LEFT JOIN bad ON k.tokens = bad.tokens
"""


@query("op4_url_rules", URL_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    rules = urlrules.mine_rules(urlrules.labelled_urls(pages, read_table(spark, sf_dir, "labels")))
    return urlrules.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query("op5_token_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.corpus_ids(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 0)


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 2)


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


COPIES_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
                   WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id
JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = e.vec_id
"""


@query("op9_embedding_copies", COPIES_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatgraph.near_copies(read_table(spark, sf_dir, "embeddings"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS no
  FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS most, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(no % 3 + 1)::INT] AS wt FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(most) OVER (ORDER BY most / wt, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(wt) OVER (ORDER BY most / wt, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM w),
t AS (
  SELECT source, source_size, no,
         CASE WHEN most / wt <= lev THEN most
              ELSE (SELECT max(lev) FROM l WHERE most / wt > lev) * wt END AS target
  FROM l),
c AS (
  SELECT d.doc_id, d.key, d.size, t.no, t.source_size, t.target, k.copy,
         (k.copy * t.source_size + sum(d.size) OVER (PARTITION BY t.no, k.copy ORDER BY d.key, d.size))::DOUBLE
         / t.target AS finish
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) k(copy)
  WHERE d.size > 0),
q AS (SELECT *, sum(size) OVER (ORDER BY finish, no) AS upto FROM c),
n AS (SELECT doc_id, key, size, no, count(*) AS copies FROM q
      WHERE upto <= (SELECT 1.5::DOUBLE * sum(size) FROM d) GROUP BY ALL)
SELECT d.doc_id, d.size, t.source_size, t.target, (coalesce(n.copies, 0) * d.size)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN n ON n.doc_id IS NOT DISTINCT FROM d.doc_id AND n.size = d.size AND n.no = t.no
"""


@query("op10_mixing", MIX_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long"))


PHRASES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS pos FROM w, (VALUES (1), (2), (3), (4)) s(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, ws[pos:pos + k - 1] AS ph, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, ph, n AS a, unnest(range(1, k)) AS cut FROM f WHERE k >= 2),
s AS (SELECT c.lang, c.ph, c.a, c.cut, x.n AS l, y.n AS r, ((2000000::HUGEINT * c.a) // (x.n + y.n))::BIGINT AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.ph = c.ph[:c.cut] JOIN f y ON y.lang = c.lang AND y.ph = c.ph[c.cut + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, cut) = 1),
i AS (SELECT lang, n, ph, k, m, unnest(range(1, k - m + 2)) AS pos FROM f, (VALUES (2), (3)) q(m) WHERE k > m),
sub AS (SELECT lang, ph[pos:pos + m - 1] AS ph, max(n) AS longer FROM i GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN sub ON sub.lang = b.lang AND sub.ph = b.ph
      WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank FROM o)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, total.n, k.score FROM k JOIN total ON total.lang = k.lang WHERE k.rank <= 2000
"""


@query("op11_collocations", PHRASES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


LINES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
w AS (SELECT row, pos, ws[pos:pos + 2] AS win FROM (SELECT row, ws, unnest(range(1, len(ws) - 1)) AS pos FROM d)),
h AS (SELECT row, win FROM w GROUP BY ALL HAVING count(*) > 1),
z AS (SELECT row, count(DISTINCT pos + o)::BIGINT AS n FROM w JOIN h USING (row, win), (VALUES (0), (1), (2)) x(o) GROUP BY row),
c AS (
  SELECT d.row, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(z.n, 0)::BIGINT AS n_repeat_words,
         list_filter(ls, lambda x: NOT regexp_matches(x, '{closed}') OR len(regexp_extract_all(x, '{doubled}')) >= 3
                     OR len(regexp_extract_all(x, '{separator}')) >= 3 OR regexp_matches(x, '{menu}')
                     OR regexp_matches(x, '{boilerplate}')) AS bad
  FROM d LEFT JOIN z ON z.row = d.row),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         coalesce(list_sum(list_transform(bad, lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')))), 0)::BIGINT
           AS lost_chars FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost_chars <= 30 * word_chars AS kept, len(bad)::BIGINT AS n_failed_lines, lost_chars
FROM v
""".format(**{n.lower(): getattr(linerules, n).replace("'", "''")
            for n in ("CLOSED", "DOUBLED", "SEPARATOR", "MENU", "BOILERPLATE")})


@query("op12_line_rules", LINES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


LEXICAL_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, list_transform(
    regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ts
  FROM documents WHERE text IS NOT NULL),
e AS (SELECT * FROM d WHERE len(ts) > 0),
g AS (SELECT count(*) AS big_n, sum(len(ts))::BIGINT AS big_l FROM e),
q AS (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id),
qt AS (
  SELECT item_id, term, count(*) AS mult FROM (
    SELECT item_id, unnest(list_transform(
      regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
      lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM q) GROUP BY ALL),
known AS (SELECT DISTINCT term FROM qt),
dt AS (SELECT row, doc_id, len(ts) AS n, unnest(ts) AS term FROM e),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM dt SEMI JOIN known USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (
  SELECT qt.item_id, tf.row, tf.doc_id, sum(qt.mult * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT
           * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term), g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


@query("op13_lexical_search", LEXICAL_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                                    read_table(spark, sf_dir, "benchmark").select("item_id", "text"))
