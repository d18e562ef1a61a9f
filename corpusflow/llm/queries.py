"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import ann, bpe, chat, dedup, langid, lexical, linededup, mixing, quality, simhash, toxicity, trie, urlfilter
from corpusflow.llm.sampling import fold
from corpusflow.runtime import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(5) == 0)
    model = toxicity.train(docs.where("not held_out"), read(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(3) == 1)
    forest = quality.train(docs.where("not held_out"), read(spark, sf_dir, "labels"))
    out = quality.score(docs, forest)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(read(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return ann.nearest(rows.where("vec_id % 20 = 0"), rows, k=20)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return marked.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(read(spark, sf_dir, "conversations"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = fold(4) == 2
    model = langid.train(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.exact_groups(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode_decode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_shared_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(read(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_quality, op3_urlfilter, op4_mixing, op5_ann, op6_simhash, op7_chat, op8_langid, op9_exact_dedup, op10_bpe,
        op11_linededup, op12_lexical, op13_trie,
    )
}

_quoted = lambda p: p.replace("'", "''")
_TAG = _quoted(r"""(?is)<(?:link|meta|base)[\s/](?:[^>"']|"[^"]*"|'[^']*')*>""")
_ATTR = _quoted(urlfilter.ATTRIBUTE)
_REF = urlfilter.REFERENCE


def _value(name: str) -> str:
    return f"list_filter(a, lambda x: x.n = '{name}')[1].v"


def _plain(value: str) -> str:
    """A value with its character references decoded."""
    point = "CASE WHEN lower(substr(r, 3, 1)) = 'x' THEN ('0x' || substr(r, 4, length(r) - 4))::INT ELSE try_cast(substr(r, 3, length(r) - 3) AS INT) END"
    char = f"CASE r WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '\"' WHEN '&apos;' THEN chr(39) ELSE CASE WHEN {point} BETWEEN 1 AND 55295 OR {point} BETWEEN 57344 AND 1114111 THEN chr({point}) ELSE chr(65533) END END"
    chars = f"list_transform(regexp_extract_all({value}, '{_REF}'), lambda r: {char})"
    return f"array_to_string(list_transform(list_zip(string_split_regex({value}, '{_REF}'), {chars}), lambda z: z[1] || coalesce(z[2], '')), '')"


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _front(u: str) -> str:
    return f"regexp_extract({u}, '(?s)^(.*?://[^/?#]*)', 1)"


def _page(u: str) -> str:
    return f"regexp_replace(translate({_front(u)}, {_AZ}) || substr({u}, length({_front(u)}) + 1), '(?s)#.*$', '')"


def _seen_from(name: str, rows: str, to: str, base: str) -> str:
    """Tables ``name``: the ``rows`` with column ``u``, the URL that ``to`` means on the page ``base``."""
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*:"
    return rf"""{name}_1 AS (SELECT *, regexp_replace({to}, '(?s)#.*$', '') AS t, {_front(base)} AS o, regexp_extract({base}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS p FROM {rows}),
{name}_2 AS (SELECT * EXCLUDE (t, o, p), CASE WHEN regexp_matches(t, '{scheme}//') THEN t WHEN regexp_matches(t, '{scheme}') OR t = '' OR o = '' THEN NULL WHEN starts_with(t, '//') THEN split_part(o, '//', 1) || t
    WHEN starts_with(t, '/') THEN o || t WHEN starts_with(t, '?') THEN o || p || t ELSE o || CASE WHEN p = '' THEN '/' ELSE regexp_replace(p, '[^/]*$', '') END || t END AS j FROM {name}_1),
{name}_3 AS (SELECT *, {_front('j')} AS o, regexp_extract(j, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(j, '(?s)^.*?://[^/?#]*[^?#]*(.*)$', 1) AS q FROM {name}_2),
{name} AS (SELECT * EXCLUDE (j, o, p, q), CASE WHEN regexp_matches(p, '/\.\.?(/|$)') THEN o || '/' || array_to_string(list_concat(list_reduce(list_concat([[]::VARCHAR[]], list_transform(string_split(p, '/')[2:], lambda x: [x])),
    lambda a, x: CASE x[1] WHEN '..' THEN a[1:len(a) - 1] WHEN '.' THEN a ELSE list_concat(a, x) END), CASE WHEN regexp_matches(p, '/\.\.?$') THEN [''] ELSE [] END), '/') || q ELSE j END AS u FROM {name}_3)"""


ORACLE_SQL = {
    "op3_urlfilter": rf"""
WITH RECURSIVE rules(verdict, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
    ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
raw AS (SELECT page_id, url, {_page('url')} AS bare, html FROM pages),
split AS (SELECT url, row_number() OVER () AS n, regexp_extract_all(regexp_replace(html, '{_quoted(urlfilter.HIDDEN)}', ' ', 'g'), '{_TAG}') AS t FROM raw WHERE url IS NOT NULL AND html IS NOT NULL),
parts_of AS (SELECT n, url, unnest(t) AS t, generate_subscripts(t, 1) AS place FROM split),
tagged AS (SELECT n, url, place, lower(regexp_extract(t, '^<(\w+)', 1)) AS kind, list_transform(regexp_extract_all(regexp_replace(t, '^<\w+', ''), '{_ATTR}'),
    lambda m: {{'n': lower(regexp_extract(m, '{_ATTR}', 1)), 'v': regexp_extract(m, '{_ATTR}', 2) || regexp_extract(m, '{_ATTR}', 3) || regexp_extract(m, '{_ATTR}', 4)}}) AS a FROM parts_of),
href AS (SELECT *, trim({_value('href')}) AS h, {_value('content')} AS c FROM tagged),
aim AS (SELECT n, url, place, CASE WHEN kind = 'base' THEN {_plain('h')} END AS b,
    CASE WHEN kind = 'link' AND list_contains(string_split_regex(lower({_value('rel')}), '[\t\n\f\r ]+'), 'canonical') THEN {_plain('h')}
    WHEN kind = 'meta' AND lower(trim({_value('http-equiv')})) = 'refresh' THEN regexp_extract({_plain('c')}, '{_quoted(urlfilter.REFRESH)}', 1) END AS dest FROM href),
tags AS (SELECT url, dest, coalesce((SELECT arg_min(x.b, (x.place, x.b)) FROM aim x WHERE x.url = aim.url AND x.b <> ''), '') AS based FROM aim WHERE dest <> ''),
{_seen_from('bases', 'tags', 'based', 'url')},
aimed AS (SELECT url, dest, coalesce(u, url) AS base FROM bases WHERE dest <> ''),
{_seen_from('aims', 'aimed', 'dest', 'base')},
edges AS (SELECT DISTINCT {_page('url')} AS src, {_page('u')} AS dst FROM aims WHERE u IS NOT NULL),
both_ways AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
urls AS (SELECT DISTINCT u FROM (SELECT url AS u FROM raw UNION ALL SELECT b FROM reach)),
parts AS (SELECT u, coalesce(translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {_AZ}), '') AS host,
    coalesce(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM urls),
ruled AS (SELECT u, host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(verdict, length(rh || rp)) AS verdict
    FROM parts LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY u, host, path),
spread AS (SELECT a FROM reach LEFT JOIN ruled ON u = b GROUP BY a HAVING bool_or(coalesce(verdict, '') = 'block') AND NOT bool_or(coalesce(verdict, '') = 'allow'))
SELECT page_id, host, path, rule, CASE WHEN verdict IS NOT NULL THEN verdict WHEN bare IN (SELECT a FROM spread) THEN 'block' ELSE 'allow' END AS verdict
FROM raw LEFT JOIN ruled ON url IS NOT DISTINCT FROM u
""",
    "op4_mixing": r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM per),
c AS (SELECT *, sum(source_size) OVER o AS size_below, sum(weight) OVER o AS weight_below, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
    FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (all_size - 3 * (size_below - source_size))::DOUBLE / (all_weight - weight_below + weight)::DOUBLE AS level FROM c),
f AS (SELECT coalesce(min_by(level, weight_below), 0.0) AS level FROM l WHERE weight * level <= 3 * source_size),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * f.level) AS target FROM w, f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
    FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
""",
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY content) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size,
    row_number() OVER (PARTITION BY content ORDER BY doc_id ASC NULLS LAST) = 1 AS kept, sha256(content) AS text_sha256 FROM n
""",
    "op11_linededup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, pos, line, keep IS NOT NULL AND doc_id IS DISTINCT FROM keep AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
""",
    "op12_lexical": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
c AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS nn, sum(len(t))::BIGINT AS ll FROM d),
q AS (SELECT item_id, term, count(*) AS qn FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, nn),
s AS (SELECT item_id, doc_id, sum(qn * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
""",
    "op13_trie": r"""
WITH o AS (SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, octet_length(encode(coalesce(text, ''))) AS bytes, turn FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, k, bytes, row_number() OVER (PARTITION BY c ORDER BY turn ASC NULLS FIRST, k) AS pos FROM o),
h AS (SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 9 AS h FROM (SELECT DISTINCT c FROM o)),
u AS (SELECT h.c, 0 AS part, t.pos, k, bytes FROM h JOIN t ON t.c = h.c - h.c % 5 AND t.pos <= h.h UNION ALL SELECT h.c, 1, t.pos, k, bytes FROM h JOIN t ON t.c = h.c AND t.pos > h.h),
r AS (SELECT c, bytes, list(k) OVER w AS path FROM u WINDOW w AS (PARTITION BY c ORDER BY part, pos ROWS UNBOUNDED PRECEDING) UNION ALL SELECT c, 0, [] FROM h),
len AS (SELECT c, max(len(path)) AS d FROM r GROUP BY c),
n AS (SELECT path, len(path) AS depth, min(r.c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    coalesce(string_agg(r.c::VARCHAR, ',' ORDER BY r.c) FILTER (WHERE len(path) = len.d), '') AS ends FROM r JOIN len USING (c) GROUP BY path),
ch AS (SELECT path[1:len(path) - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (path)),
sub AS (SELECT path[1:up] AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM (SELECT *, unnest(range(depth + 1)) AS up FROM a) GROUP BY ALL)
SELECT a.conv_id, a.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM a JOIN sub USING (path) LEFT JOIN a p ON a.depth > 0 AND p.path = a.path[1:a.depth - 1]
""",
}
