"""The queries of this subpackage and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import ann, bpe, conversation_trie, decontam, jaccard_join, lm_scoring, simhash, spelling, suffix_dedup, token_counts, token_store, toxicity, url_filters
from gridloom.llm.common import table

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
SUBWORD_RANKS = "byte_bpe_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"


def _hash_number(x, digits: int = 6):
    """A number from the first hex digits of an md5: the same in Spark and DuckDB."""
    return F.conv(F.substring(F.md5(x), 1, digits), 16, 10).cast("long")


def list_events(pages: DataFrame) -> DataFrame:
    """A dated block list over the hosts and parent domains that occur in ``pages``: each is added, removed and some added again."""
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    keys = hosts.select(F.explode(url_filters.host_suffixes(F.col("host"))).alias("key")).distinct()
    n = _hash_number(F.col("key"))
    name = F.element_at(F.array(*map(F.lit, ("adult", "malware", "spam"))), (n % 3 + 1).cast("int"))
    day = lambda d: F.date_add(F.lit("2024-01-01").cast("date"), d.cast("int"))
    events = F.array(
        F.struct(F.lit("add").alias("action"), day(n % 300).alias("at")),
        F.struct(F.lit("remove").alias("action"), day(n % 300 + n % 41 + 1).alias("at")),
        F.struct(F.when(n % 5 == 0, "add").otherwise("remove").alias("action"), day(n % 300 + n % 41 + 60).alias("at")),
    )
    return keys.select(name.alias("list_name"), "key", F.explode(events).alias("e")).select("list_name", "key", "e.action", "e.at")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")))
    return url_filters.filter_urls(captures, list_events(pages)).select(
        "page_id", "url", F.col("fetched_at").cast("string").alias("fetched_at"), "host", "matched_key", "list_name", F.col("listed_since").cast("string").alias("listed_since"), "blocked"
    )


OP1_SQL = r"""
WITH captures AS (
  SELECT page_id, url, date '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS fetched_at,
         nullif(regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '^www\.', ''), '') AS host
  FROM pages),
suffixes AS (
  SELECT host, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS key
  FROM (SELECT DISTINCT host FROM captures WHERE host IS NOT NULL) h, range(1, greatest(len(string_split(h.host, '.')) - 1, 1) + 1) r(i)),
keys AS (SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS n FROM (SELECT DISTINCT key FROM suffixes)),
events AS (
  SELECT key, ['adult', 'malware', 'spam'][n % 3 + 1] AS list_name, 'add' AS action, date '2024-01-01' + CAST(n % 300 AS INTEGER) AS dated FROM keys
  UNION ALL SELECT key, ['adult', 'malware', 'spam'][n % 3 + 1], 'remove', date '2024-01-01' + CAST(n % 300 + n % 41 + 1 AS INTEGER) FROM keys
  UNION ALL SELECT key, ['adult', 'malware', 'spam'][n % 3 + 1], CASE WHEN n % 5 = 0 THEN 'add' ELSE 'remove' END, date '2024-01-01' + CAST(n % 300 + n % 41 + 60 AS INTEGER) FROM keys),
settled AS (SELECT list_name, key, dated, max(action) AS action FROM events GROUP BY ALL),
latest AS (
  SELECT c.page_id, s.key, s.list_name, s.dated, s.action,
         row_number() OVER (PARTITION BY c.page_id, s.list_name, s.key ORDER BY s.dated DESC) AS rn
  FROM captures c JOIN suffixes x USING (host) JOIN settled s ON s.key = x.key AND s.dated <= c.fetched_at),
best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, dated DESC, list_name DESC, key DESC) AS place
  FROM latest WHERE rn = 1 AND action = 'add')
SELECT c.page_id, c.url, CAST(c.fetched_at AS VARCHAR) AS fetched_at, c.host, b.key AS matched_key, b.list_name, CAST(b.dated AS VARCHAR) AS listed_since, b.key IS NOT NULL AS blocked
FROM captures c LEFT JOIN best b ON b.page_id = c.page_id AND b.place = 1
"""


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(SUBWORD_RANKS))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


OP6_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def graded_labels(labels: DataFrame) -> DataFrame:
    """doc_id and grade by the labels alone: 0 clean, 1 toxic, 2 toxic and of poor quality. A null quality counts as good."""
    return labels.select("doc_id", (F.col("toxic") * (2 - F.coalesce("quality", F.lit(1)))).alias("grade"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, graded_labels(table(spark, sf_dir, "labels")), grade="grade")
    return toxicity.score(docs, model).select("doc_id", "severity", "p_toxic", "grade", "rejected")


def document_edits(text) -> F.Column:
    """Four edits of a text: a deletion, an insertion, a replacement and an addition, at places that depend on its length."""
    n = F.coalesce(F.char_length(text), F.lit(0))
    at = lambda part, of: F.floor(n * part / of).cast("int")
    edit = lambda start, end, new: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(new).alias("replacement"))
    return F.array(edit(at(1, 5), at(1, 5) + 40, ""), edit(at(2, 5), at(2, 5), " It's been revised,"), edit(at(3, 5), at(3, 5) + 10, "[redacted]"), edit(n, n, "\n\nEnd."))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", document_edits(F.col("text")))
    return token_counts.count_edited(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"]))).alias("item_ids"),
        F.array_min(F.transform("hits", lambda h: h["distance"])).alias("least_distance"), F.size("hits").cast("long").alias("n_spans"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(WORD_TOKENIZER))


#: Letters of ASCII, for SQL that lower-cases nothing else.
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text of code points under 256: one step for each bit, the byte joining before the first of its eight."""
    zeros = ", 0, 0, 0, 0, 0, 0, 0"
    one = f"CASE WHEN unicode(ch) < 128 THEN [unicode(ch){zeros}] ELSE [192 + unicode(ch) // 64{zeros}, 128 + unicode(ch) % 64{zeros}] END"
    bits = f"list_prepend(4294967295, CAST(flatten(list_transform(string_split({text}, ''), lambda ch: {one})) AS BIGINT[]))"
    return f"xor(list_reduce({bits}, lambda x, y: xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1))), 4294967295)"


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))


OP11_SQL = f"""
WITH RECURSIVE run AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
hashed AS (SELECT run, c, {_crc32("doc || ':' || run")} AS h FROM (SELECT doc, run, count(*) AS c FROM run GROUP BY ALL)),
garbled AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
vocab AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM garbled GROUP BY word HAVING length(word) >= 5 AND sum(c) >= 3),
less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM vocab, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, v.word FROM less l JOIN vocab v ON v.word = l.rest UNION SELECT v.word, l.word FROM less l JOIN vocab v ON v.word = l.rest),
ranked AS (SELECT x.word, x.other, v.n AS other_n, count(*) OVER (PARTITION BY x.word) AS n_near, row_number() OVER (PARTITION BY x.word ORDER BY v.n DESC, x.other) AS place FROM near x JOIN vocab v ON v.word = x.other),
formed AS (
  SELECT v.word, v.n, CAST(coalesce(r.n_near, 0) AS BIGINT) AS n_near, CASE WHEN r.other_n >= 2 * v.n THEN r.other END AS form, CASE WHEN r.other_n >= 2 * v.n THEN r.other_n END AS form_n
  FROM vocab v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1),
step AS (SELECT word, word AS root, 0 AS k FROM formed UNION ALL SELECT s.word, f.form, s.k + 1 FROM step s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(root, k) AS root FROM step GROUP BY word)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM formed f JOIN last l USING (word)
"""


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) END AS s FROM words),
held AS (SELECT doc_id, len(s) AS size, unnest(s) AS shingle FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.size + b.size AS sizes, count(*) AS met FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared WHERE 100 * met >= 90 * (sizes - met)),
way AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, w.b FROM reach r JOIN way w ON w.a = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.sequences(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(conversation_trie.with_family_heads(turns))


OP13_SQL = rf"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
built AS (SELECT o.conv_id, list_concat(coalesce(list_slice(b.turns, 1, o.h), []), list_slice(o.turns, o.h + 1, len(o.turns))) AS turns FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
member AS (SELECT conv_id, d, len(turns) = d AS ends, md5(CAST(list_slice(turns, 1, d) AS VARCHAR)) AS node, md5(CAST(list_slice(turns, 1, d - 1) AS VARCHAR)) AS up, turns FROM built, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
node AS (
  SELECT node, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(turns[d].text, '[^\x20\x09-\x0D]+')) END) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM member GROUP BY node, d),
kid AS (SELECT up AS node, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
below AS (SELECT DISTINCT m.node, m.d, b.node AS low, b.d AS low_d FROM member m JOIN member b ON b.conv_id = m.conv_id AND b.d >= m.d),
total AS (
  SELECT b.node, b.d, CAST(count(*) FILTER (WHERE k.node IS NULL) AS BIGINT) AS n_leaves, CAST(sum((x.n - 1) * x.words) AS BIGINT) AS saved_tokens
  FROM below b JOIN node x ON x.node = b.low AND x.d = b.low_d LEFT JOIN kid k ON k.node = b.low AND k.d = b.low_d GROUP BY ALL)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(k.n_children, 0) AS n_children, t.n_leaves, t.saved_tokens, x.ends_sha256
FROM node x JOIN total t ON t.node = x.node AND t.d = x.d LEFT JOIN kid k ON k.node = x.node AND k.d = x.d LEFT JOIN node p ON x.d > 0 AND p.node = x.up AND p.d = x.d - 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1,
        "op2_byte_bpe": op2,
        "op3_lm_scoring": op3,
        "op4_simhash": op4,
        "op5_suffix_dedup": op5,
        "op6_nearest_neighbours": op6,
        "op7_toxicity": op7,
        "op8_token_counts": op8,
        "op9_decontamination": op9,
        "op10_token_store": op10,
        "op11_spelling_variants": op11,
        "op12_jaccard_join": op12,
        "op13_conversation_trie": op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": OP1_SQL,
        "op6_nearest_neighbours": OP6_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op12_jaccard_join": OP12_SQL,
        "op13_conversation_trie": OP13_SQL,
    }
