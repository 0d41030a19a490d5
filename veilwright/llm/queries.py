"""Registered queries of the corpus operators, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilwright.llm import (
    edit_embedding,
    line_dedup,
    pii_crf,
    prefix_trie,
    quality_suffix,
    quality_vectors,
    sentencepiece_codec,
    simhash_dedup,
    source_mix,
    spelling_gram,
    token_counts,
    toxicity_gbt,
    url_filter,
)
from veilwright.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Host words that put a page's URL on the block list of op7.
SPAM_TERMS = ("casino", "pills", "bets", "spam", "poker", "viagra")
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 1024)


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    return url_filter.url_filter(pages, rules, url_filter.spam_listed(pages, SPAM_TERMS))


@query
def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents"), 3, 3)


ORACLE["op7_url_filter"] = r"""
WITH split AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), judged AS (
  SELECT *,
    host = 'org' OR ends_with(host, '.org') AS org,
    host = 'example.org' OR ends_with(host, '.example.org') AS example_org,
    host = 'com' OR ends_with(host, '.com') AS com
  FROM split
), ruled AS (
  SELECT page_id, host, path,
    CASE WHEN example_org AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN example_org AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN com AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN com AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN org AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM judged
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block'
       WHEN regexp_matches(host, '(^|[.-])(casino|pills|bets|spam|poker|viagra)([.-]|$)') THEN 'block'
       ELSE 'allow' END AS verdict
FROM ruled
"""


@query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.source_mix(table(spark, sf_dir, "documents"), (5, 2, 1), 1.5, 2.0, seed=8)


ORACLE["op8_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat_ws('|', '8', coalesce(CAST(doc_id AS VARCHAR), ''),
        CASE WHEN source IS NULL THEN 'n' ELSE concat('s', octet_length(encode(source)), ':', source) END, coalesce(text, ''))) AS row_key
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT *,
    (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER earlier, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM sources
  WINDOW earlier AS (ORDER BY source_size / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
    least(2.0 * source_size,
      weight * (SELECT level FROM filled WHERE level * weight <= 2.0 * source_size ORDER BY source_size / weight, source NULLS LAST LIMIT 1)) AS target
  FROM filled
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets
), ranked AS (
  SELECT doc_id, size, source_size, target, whole, row_key, s.source,
    target - whole * source_size AS rest,
    CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS p,
    (CAST('0x' || row_key[1:13] AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM sized s JOIN parts t ON s.source IS NOT DISTINCT FROM t.source
), running AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source
      ORDER BY CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END, row_key
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM ranked
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (whole + CASE WHEN p > 0 AND start + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running
"""


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_suffix.quality_rules(table(spark, sf_dir, "documents"))


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query
def op3_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.edited_neighbours(table(spark, sf_dir, "documents"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(documents, counts=("n_lines", "n_dropped"))


ORACLE["op4_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
  FROM documents
), occurrences AS (
  SELECT *, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM split
), lines AS (
  SELECT words, len(words) AS n, row_number() OVER (ORDER BY min((doc_id, line_no))) AS nr, min((doc_id, line_no)) AS place
  FROM occurrences WHERE len(words) > 0 GROUP BY words
), places AS (
  SELECT nr, n, words, unnest(range(1, n + 1)) AS pos FROM lines WHERE n >= 5
), variants AS (
  SELECT nr, n, pos, list_concat(words[1:pos - 1], words[pos + 1:]) AS variant FROM places
), near AS (
  SELECT DISTINCT nr FROM (
    SELECT nr, min(nr) OVER (PARTITION BY n, pos, variant) AS other FROM variants
    UNION ALL
    SELECT v.nr, l.nr FROM variants v JOIN lines l ON l.words = v.variant WHERE l.n >= 5
    UNION ALL
    SELECT l.nr, v.nr FROM variants v JOIN lines l ON l.words = v.variant WHERE l.n >= 5
  ) WHERE other < nr
), kept AS (
  SELECT o.doc_id, o.line_no, o.line, o.words,
    len(o.words) = 0 OR (l.place = (o.doc_id, o.line_no) AND l.nr NOT IN (SELECT nr FROM near)) AS stays
  FROM occurrences o LEFT JOIN lines l ON o.words = l.words
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (stays), '') AS text,
  count(*) FILTER (len(words) > 0) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped
FROM kept GROUP BY doc_id
"""


@query
def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find_pii(table(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_gbt.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_spelling_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_gram.spelling_variants(table(spark, sf_dir, "documents"))


#: DuckDB has no crc32: its 256 steps as a list, and a fold of them over a list named `bytes`.
CRC_STEPS = """steps AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS step
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
)"""
CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
    lambda c, b: xor(c >> 8, step[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295)"""

ORACLE["op12_spelling_gram"] = rf"""
WITH RECURSIVE {CRC_STEPS}, found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (
  SELECT run, count(*) AS k, flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
    lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), ord(x) - 64] END)) AS bytes
  FROM found WHERE length(run) >= 6 GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, {CRC} AS h FROM counted, steps
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
      ELSE run END AS word
    FROM hashed
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), shorter AS (
  SELECT word, n, pos, substr(word, 1, pos - 1) || substr(word, pos + 1) AS rest
  FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INT) AS pos FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.pos = b.pos AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
  UNION
  SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, min((-near_n, near)) AS least FROM near GROUP BY word
), judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -least[1] >= 5 * n THEN least[2] END AS form, CASE WHEN -least[1] >= 5 * n THEN -least[1] END AS form_n
  FROM words LEFT JOIN best USING (word)
), led AS (
  SELECT word, word AS root FROM judged WHERE form IS NULL
  UNION ALL
  SELECT j.word, led.root FROM led JOIN judged j ON j.form = led.word
)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN led USING (word)
"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), 20, 4)


ORACLE["op13_prefix_trie"] = rf"""
WITH {CRC_STEPS}, turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS k FROM (
    SELECT conv_id, turn, sha256(concat(octet_length(encode(coalesce(role, ''))), ':', role, text)) AS id,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL)
), ids AS (
  SELECT conv_id, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)) AS bytes
  FROM turns GROUP BY conv_id
), lent AS (
  SELECT conv_id, {CRC} % 4 AS h FROM ids, steps
), placed AS (
  SELECT l.conv_id, k, id, words FROM lent l JOIN turns t ON t.conv_id = l.conv_id - l.conv_id % 20 AND k <= h
  UNION ALL
  SELECT l.conv_id, k, id, words FROM lent l JOIN turns t ON t.conv_id = l.conv_id AND k > h
), members AS (
  SELECT conv_id, list(id) OVER before AS path, words FROM placed
  WINDOW before AS (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL
  SELECT conv_id, CAST([] AS VARCHAR[]), 0 FROM ids
), nodes AS (
  SELECT path, len(path) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM members GROUP BY path
), ends AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(path, len(path)) AS path FROM members GROUP BY conv_id) GROUP BY path
), children AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), full_nodes AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (path)
), below AS (
  SELECT path[1:top] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS top FROM full_nodes) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM full_nodes n JOIN below USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""


@query
def op11_quality_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_vectors.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.3)
