"""Registered queries of this subpackage: each applies one operator to whole tables and derives its digests."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.llm import (
    chat, decontaminate, line_align, line_quality, mixing, near_dedup, periodic_runs, rule_ensemble, suffix_dedup, token_store, url_filter,
    whitening, window_dedup,
)
from paperlode.llm.tables import new_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_WORDS = "coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), [])"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, i + o AS p FROM win JOIN rep USING (k), (SELECT unnest(range(35)) AS o)),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
kept AS (
  SELECT word.doc_id, count(*) FILTER (hit.p IS NOT NULL) AS gone,
         string_agg(w, ' ' ORDER BY word.p) FILTER (hit.p IS NULL) AS rest
  FROM word LEFT JOIN hit ON word.doc_id = hit.doc_id AND word.p = hit.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op8_count_min_windows", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.digests(window_dedup.dedup(table(spark, sf_dir, "documents")))


@query("op4_difference_cover_suffixes")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.dedup(table(spark, sf_dir, "documents")))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = f"coalesce(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_PLAIN} AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS k
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
hit AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op7_wu_manber", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digests(found)


_LOWER_WORDS = f"coalesce(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), [])"

OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 5, 0) + 2)) AS i FROM d WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh AS a JOIN sh AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN size AS x ON x.doc_id = a JOIN size AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT a, b FROM edge UNION SELECT r.doc_id, e.b FROM reach AS r JOIN edge AS e ON e.a = r.other),
low AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id),
out AS (
  SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(m, d.doc_id)) AS BIGINT) AS component_id
  FROM d LEFT JOIN size USING (doc_id) LEFT JOIN low USING (doc_id))
SELECT *, doc_id = component_id AS kept FROM out
"""


@query("op6_similarity_sketch", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.digests(near_dedup.near_duplicates(table(spark, sf_dir, "documents")))


@query("op10_wavelet_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-shards")
    token_store.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.documents(token_store.read(spark, path))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: translate(x, {_BLANK}, '') <> '') AS lines
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (doc_id, k)) GROUP BY doc_id),
line AS (
  SELECT doc_id, source, text, trim(regexp_replace(lower(l), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS l, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS n
  FROM (SELECT doc_id, source, text, unnest(lines) AS l FROM d)),
often AS (SELECT source, l FROM line GROUP BY source, l HAVING count(DISTINCT text) > 20),
gone AS (
  SELECT doc_id, sum(n) AS n FROM line JOIN often ON line.source IS NOT DISTINCT FROM often.source AND line.l = often.l GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(translate(text, {_BLANK}, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
         len(ws) - coalesce(gone.n, 0) AS rest
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rest >= 20 AND 2 * rest >= n_words AS kept
FROM judged
"""


@query("op2_line_frequency", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_quality.assess(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_splitting_tree_mix")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(*mixing.mix(table(spark, sf_dir, "documents")))


@query("op5_url_regression")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
t AS (
  SELECT *, 4 + length(role) + 2 + length(text) + 9 + length(text) - length(translate(text, '\\#<', ''))
         + length(role) - length(translate(role, '\\#<:', '')) AS chars FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op1_schema_fingerprint_chat", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(spoken).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.read_back(chat.format_turns(chat.canonical_turns(rows))))


@query("op9_patience_lines")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_align.digests(docs, line_align.align(docs))


@query("op11_rule_ensemble")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_sturm_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


# CRC-32 of the decimal id, byte by byte; runs are stretches of equal 5-word windows at one distance.
_CRC = (
    "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
    "lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), "
    "lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
)

OP13_SQL = f"""
WITH h AS (SELECT doc_id, text, {_WORDS} AS ws, {_CRC} AS h FROM documents),
g AS (SELECT doc_id, ws, h, h // 10 AS g, len(ws) AS n FROM h),
p AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM g),
d AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0
                      THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) ELSE ws END AS ws FROM p),
win AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 5], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(len(ws) - 4)) AS i FROM d WHERE len(ws) > 5)),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM win AS x JOIN win AS y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i),
island AS (
  SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 5 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM pair) GROUP BY doc_id, q, part),
run AS (SELECT doc_id, start, length, min(q) AS period FROM island WHERE length >= 6 AND length >= 4 * q GROUP BY doc_id, start, length),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
told AS (
  SELECT doc_id, count(*) AS n, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS digest FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS rest FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, coalesce(digest, sha256('')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op13_suffix_automaton_runs", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", periodic_runs.with_planted_tail(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic_runs.digests(periodic_runs.periodic_runs(planted))
