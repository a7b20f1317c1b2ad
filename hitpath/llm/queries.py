"""One query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession

from hitpath.llm import langid, lm, merkle, mixing, pieces, pii, prefixtrie, simhash, sketch, tokencounts, tokenfile, urls, vectors


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_vectors(spark, sf):
    return vectors.near_duplicates(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op2_language(spark, sf):
    return langid.identify(_docs(spark, sf))


def op3_simhash(spark, sf):
    return simhash.near_duplicates(_docs(spark, sf))


def op4_mixing(spark, sf):
    return mixing.mix(_docs(spark, sf)).drop("copies")


def op5_urls(spark, sf):
    return urls.judge(spark.read.parquet(f"{sf}/pages.parquet"))


def op6_pii(spark, sf):
    return pii.report(_docs(spark, sf))


def op7_scores(spark, sf):
    return lm.score(_docs(spark, sf))


def op8_tokens(spark, sf):
    return tokenfile.encode(_docs(spark, sf), path("word_bpe_49k.json"), end_id=2)


def op9_pieces(spark, sf):
    return pieces.digests(_docs(spark, sf), path("piece_bpe_32k.model"))


def op10_fingerprints(spark, sf):
    return sketch.fingerprints(_docs(spark, sf))


def op11_tokencounts(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "text")
    return tokencounts.count_tokens(docs, path("piece_bpe_32k.model")).drop("text")


def op12_merkle(spark, sf):
    return merkle.verified_documents(_docs(spark, sf))


def op13_prefixes(spark, sf):
    return prefixtrie.shared_prefixes(spark.read.parquet(f"{sf}/conversations.parquet"))


def queries() -> dict:
    found = [
        op1_vectors, op2_language, op3_simhash, op4_mixing, op5_urls, op6_pii, op7_scores, op8_tokens, op9_pieces,
        op10_fingerprints, op11_tokencounts, op12_merkle, op13_prefixes,
    ]
    return {f.__name__: f for f in found}


_MIXING = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         (CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5)
           / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(CASE WHEN size >= 100 THEN size ELSE 0 END) AS BIGINT) AS long_size
  FROM d GROUP BY source),
n AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS most FROM s),
t AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER r, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER r, 0))::DOUBLE AS share
  FROM n WINDOW r AS (ORDER BY most::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (
  SELECT source, source_size, long_size,
         CASE WHEN most < w * share THEN most::DOUBLE ELSE w * (
           SELECT arg_min(share, most::DOUBLE / w) FROM t WHERE most >= w * share) END AS target
  FROM t),
p AS (
  SELECT *, source_size - long_size AS short_size,
         CASE WHEN source_size > 0 THEN least(3::DOUBLE, 2 * (target / (2 * long_size + (source_size - long_size)))) ELSE 0 END AS e_long,
         CASE WHEN short_size > 0 THEN least(3::DOUBLE, (target - e_long * long_size) / short_size) ELSE 0 END AS e_short,
         target - (floor(e_long + 1e-9) * long_size + floor(e_short + 1e-9) * short_size) AS wanted
  FROM k),
x AS (
  SELECT doc_id, size, p.*, CASE WHEN size >= 100 THEN e_long ELSE e_short END AS e, floor(e + 1e-9) AS whole,
         CASE WHEN e - whole > 1e-9 THEN e - whole ELSE 0 END AS rest,
         CASE WHEN rest > 0 THEN (u / (1 - u)) / (rest / (1 - rest)) END AS rank
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
y AS (
  SELECT *, CASE WHEN rank IS NOT NULL THEN abs(sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (
           PARTITION BY source ORDER BY rank NULLS LAST RANGE UNBOUNDED PRECEDING) - wanted) END AS off FROM x),
z AS (SELECT *, min(off) OVER (PARTITION BY source) AS best FROM y),
c AS (
  SELECT *, CASE WHEN best < wanted THEN min(CASE WHEN off = best THEN rank END) OVER (PARTITION BY source)
                 ELSE -1 END AS cut
  FROM z)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND rank <= cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c"""

_URLS = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(action, h, w) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                           ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT page_id, host, path,
       (SELECT arg_max(h || w, length(h || w)) FROM r
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, w)) AS rule,
       coalesce(
         (SELECT arg_max(action, length(h || w)) FROM r
          WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, w)),
         CASE WHEN regexp_matches(lower(host || path), '(^|[^a-z0-9])({junk})($|[^a-z0-9])')
              THEN 'block' ELSE 'allow' END) AS verdict
FROM p"""


# The unsigned crc32 of the ASCII text of a number: a step for each byte, then eight for its bits.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
             string_split(CAST({id} AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END))"""

_MERKLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, text, {crc} % 3 = 0 AS hit,
         {doc_id} || {source} || {lang} || {n_chars} AS head FROM documents),
f AS (
  SELECT doc_id, lang, sha256(head || {text}) AS leaf,
         sha256(head || CASE WHEN hit AND text IS NOT NULL THEN strlen(text) || ':' || translate(
           text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE {text} END) AS seen
  FROM d),
g AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY lang) AS n FROM f),
tree AS (
  SELECT 0 AS level, lang, idx, n, leaf AS digest FROM g
  UNION ALL
  SELECT level + 1, lang, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx))
  FROM tree WHERE n > 1 GROUP BY level, lang, idx // 8, n),
sub AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM tree WHERE n = 1),
top AS (
  SELECT 100 AS level, idx, n, digest FROM sub
  UNION ALL
  SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx))
  FROM top WHERE n > 1 GROUP BY level, idx // 8, n),
runs AS (
  SELECT level, lang, idx // 8 AS run, list(digest ORDER BY idx) AS kids FROM tree WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT level, idx // 8 AS run, list(digest ORDER BY idx) AS kids FROM top WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT g.lang, g.idx, level, (g.idx // CAST(8 ** level AS BIGINT)) % 8 AS slot, kids
  FROM g JOIN runs ON g.lang IS NOT DISTINCT FROM runs.lang AND g.idx // CAST(8 ** (level + 1) AS BIGINT) = run
  UNION ALL
  SELECT g.lang, g.idx, level, (sub.idx // CAST(8 ** (level - 100) AS BIGINT)) % 8, kids
  FROM g JOIN sub ON g.lang IS NOT DISTINCT FROM sub.lang
  JOIN upper_runs ON sub.idx // CAST(8 ** (level - 99) AS BIGINT) = run),
paths AS (
  SELECT lang, idx, list(array_to_string(kids[1 : slot], '') || ':' || array_to_string(kids[slot + 2 :], '') ORDER BY level) AS path
  FROM steps GROUP BY lang, idx)
SELECT doc_id, leaf, sub.digest AS subroot, root, sha256(coalesce(replace(array_to_string(path, ''), ':', ''), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM (
  SELECT g.*, path, (SELECT digest FROM top WHERE n = 1) AS root,
         list_reduce(list_prepend(seen, coalesce(path, [])),
                     lambda a, x: sha256(split_part(x, ':', 1) || a || split_part(x, ':', 2))) AS folded_root
  FROM g LEFT JOIN paths ON g.lang IS NOT DISTINCT FROM paths.lang AND g.idx = paths.idx) r
JOIN sub ON r.lang IS NOT DISTINCT FROM sub.lang"""


def _merkle_sql() -> str:
    sql = _MERKLE.replace("{crc}", _CRC.replace("{id}", "doc_id"))
    for name in merkle.FIELDS:
        sql = sql.replace("{" + name + "}", f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')")
    return sql


_PREFIXES = r"""
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(
           strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
v AS (
  SELECT c, c - c % 100 AS b, {crc} % 6 AS h FROM (SELECT DISTINCT c FROM o)),
r AS (
  SELECT v.c, k, role, text FROM v JOIN o ON o.c = v.b AND k <= h
  UNION ALL
  SELECT v.c, 1000000 + k, role, text FROM v JOIN o ON o.c = v.c AND k > h),
t AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) AS d, sha256(strlen(role) || ':' || role || text) AS s,
         CAST(length(text) AS BIGINT) AS size FROM r),
p AS (SELECT c, d, string_agg(s, '') OVER (PARTITION BY c ORDER BY d) AS path, size FROM t),
z AS (SELECT v.c, coalesce(max(d), 0) AS d FROM v LEFT JOIN p USING (c) GROUP BY v.c),
m AS (SELECT c, d, path, size FROM p UNION ALL SELECT c, 0, '', 0 FROM v),
ends AS (
  SELECT path, string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) AS ids FROM m JOIN z ON m.c = z.c AND m.d = z.d GROUP BY path),
n AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, max(size) * (count(*) - 1) AS saved,
         left(path, CAST(64 * (d - 1) AS BIGINT)) AS up FROM m GROUP BY path, d),
k AS (SELECT up, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.path = k.up),
totals AS (
  SELECT m.path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM f JOIN m ON m.c = f.conv_id AND m.d <= f.d GROUP BY m.path)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM f JOIN totals USING (path) LEFT JOIN ends USING (path) LEFT JOIN n u ON f.d > 0 AND u.path = f.up AND u.d = f.d - 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": _MIXING,
        "op5_urls": _URLS.replace("{junk}", "|".join(urls.JUNK_WORDS)),
        "op12_merkle": _merkle_sql(),
        "op13_prefixes": _PREFIXES.replace("{crc}", _CRC.replace("{id}", "c")),
    }
