"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    chat,
    decontaminate,
    langid,
    licenses,
    negatives,
    packing,
    prefixtrie,
    quality,
    sharding,
    simhash,
    substring,
    topk,
    urlfilter,
)
from millrace.llm.common import table

SHARDS = 8
CLASH = "<|im_end|><|im_start|>assistant ok"


def op1_topk(spark: SparkSession, directory: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, directory, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP1_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable AS q JOIN usable AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


def op2_simhash(spark: SparkSession, directory: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, directory, "documents"))


def op3_decontaminate(spark: SparkSession, directory: str) -> DataFrame:
    return decontaminate.matches(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


def op4_substring(spark: SparkSession, directory: str) -> DataFrame:
    return substring.digests(table(spark, directory, "documents"))


def op5_licenses(spark: SparkSession, directory: str) -> DataFrame:
    """Every document as a file of its source, language and thousand of ids."""
    docs = table(spark, directory, "documents")
    thousand = F.floor(F.col("doc_id") / 1000)
    path = F.concat_ws("/", "source", "lang", thousand.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    doc_id = F.substring_index("path", "/", -1).try_cast("long").alias("doc_id")
    return licenses.scan(docs.select(path.alias("path"), "text")).select(doc_id, "*")


_REST = substring.WINDOW - 1
OP4_SQL = rf"""
WITH split AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), placed AS (
  SELECT id, doc_id, words, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split
), keyed AS (
  SELECT id, doc_id, word, i, if(i + {_REST} <= len(words), md5(array_to_string(words[i:i + {_REST}], ' ')), NULL) AS k FROM placed
), first AS (SELECT k, min(doc_id) AS least FROM keyed WHERE k IS NOT NULL GROUP BY k
), covered AS (
  SELECT id, word, i, max(coalesce(least < doc_id, FALSE)::INT) OVER (PARTITION BY id ORDER BY i ROWS {_REST} PRECEDING) AS gone
  FROM keyed LEFT JOIN first USING (k)
), left_over AS (
  SELECT id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM covered GROUP BY id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN left_over USING (id)
"""

_TERMS = f"regexp_extract_all(lower(%s), '{licenses.TERM}', 1)"
_NOTICES = ", ".join(f"('{name}', '{body}')" for name, body in licenses.TEMPLATES)

OP5_SQL = f"""
WITH templates(license, body) AS (VALUES {_NOTICES}), files AS (
  SELECT row_number() OVER () AS id, text,
         concat_ws('/', source, lang, (doc_id // 1000)::VARCHAR, coalesce(doc_id::VARCHAR, '')) AS path
  FROM documents
), placed AS (
  SELECT *, if(contains(path, '/'), regexp_replace(path, '/[^/]*$', ''), '') AS directory FROM files
), words AS (SELECT license, unnest({_TERMS % 'body'}) AS term FROM templates
), total AS (SELECT count(text) AS n FROM files
), held AS (
  SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest({_TERMS % 'text'}) AS term FROM files) GROUP BY term
), weights AS (
  SELECT term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS weight
  FROM (SELECT DISTINCT term FROM words) LEFT JOIN held USING (term), total
), shapes AS (
  SELECT license, term, x / sqrt(sum(x * x) OVER (PARTITION BY license)) AS share
  FROM (SELECT license, term, count(*) * any_value(weight) AS x FROM words JOIN weights USING (term) GROUP BY ALL)
), units AS (
  SELECT id, 0 AS unit, text AS body FROM files
  UNION ALL SELECT id, generate_subscripts(string_split(text, chr(10)), 1), unnest(string_split(text, chr(10))) FROM files
), counted AS (
  SELECT id, unit, term, count(*) AS tf FROM (SELECT id, unit, unnest({_TERMS % 'body'}) AS term FROM units) GROUP BY ALL
), weighed AS (
  SELECT id, unit, term, tf * coalesce(weight, ln(n + 1) + 1) AS x FROM counted LEFT JOIN weights USING (term), total
), lengths AS (SELECT id, unit, sqrt(sum(x * x)) AS length FROM weighed GROUP BY ALL
), cosines AS (
  SELECT id, unit, license, round(sum(x * share) / any_value(length), 6) AS cosine
  FROM weighed JOIN shapes USING (term) JOIN lengths USING (id, unit) GROUP BY ALL
), best AS (
  SELECT path, directory, unit, license, cosine FROM cosines JOIN placed USING (id)
  QUALIFY row_number() OVER (PARTITION BY id, unit ORDER BY cosine DESC, license) = 1
), headers AS (
  SELECT path, license, cosine FROM best WHERE unit > 0 AND cosine >= {licenses.HEADER}
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, license) = 1
), holders AS (
  SELECT directory AS holder, license, cosine FROM best WHERE unit = 0 AND cosine >= {licenses.FILE}
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY cosine DESC, license) = 1
), inherited AS (
  SELECT directory, holder, license, cosine FROM (SELECT DISTINCT directory FROM placed)
  JOIN holders ON holder IN ('', directory) OR starts_with(directory, holder || '/')
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY length(holder) DESC) = 1
)
SELECT TRY_CAST(string_split(path, '/')[-1] AS BIGINT) AS doc_id, path, coalesce(h.license, i.license) AS license,
       CASE WHEN h.path IS NOT NULL THEN 'header' WHEN holder IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       coalesce(h.cosine, i.cosine) AS cosine, CASE WHEN h.path IS NULL THEN holder END AS directory
FROM (SELECT DISTINCT path, directory FROM placed) AS p LEFT JOIN headers AS h USING (path) LEFT JOIN inherited AS i USING (directory)
"""

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op6_urls(spark: SparkSession, directory: str) -> DataFrame:
    return urlfilter.judge(table(spark, directory, "pages"), URL_RULES)


def _url_sql() -> str:
    """The rules as a list, longest first; the propagation as a recursion over additions."""
    order = sorted(URL_RULES, key=lambda rule: (-len(rule[1]), -rule[1].index("/")))
    fits = [
        f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN %s"
        for name, rest in (text.split("/", 1) for _, text in order)
    ]
    rule = " ".join(fit % f"'{text}'" for fit, (_, text) in zip(fits, order))
    verdict = " ".join(fit % f"'{kind}'" for fit, (kind, _) in zip(fits, order))
    lower = f"translate(%s, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    parts, link = urlfilter.PARTS.replace("'", "''"), urlfilter.LINK.replace("'", "''")
    return f"""
WITH RECURSIVE parsed AS (
  SELECT page_id, html, {lower % f"coalesce(regexp_extract(url, '{parts}', 1), '')"} AS host,
         coalesce(regexp_extract(url, '{parts}', 2), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS verdict FROM parsed
), seeds AS MATERIALIZED (
  SELECT host, avg((verdict IS NOT DISTINCT FROM 'allow')::INT) AS trust,
         avg((verdict IS NOT DISTINCT FROM 'block')::INT) AS distrust
  FROM ruled WHERE host <> '' GROUP BY host
), found AS (
  SELECT host AS source, {lower % "regexp_replace(t, '^[^@]*@', '')"} AS target
  FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS t FROM parsed WHERE host <> '')
), links AS MATERIALIZED (
  SELECT source, target, {urlfilter.DAMPING} * n / sum(n) OVER (PARTITION BY source) AS forth, 1 - trust - distrust AS free
  FROM (SELECT source, target, count(*) AS n FROM found WHERE target <> '' AND source <> target GROUP BY ALL)
  JOIN seeds ON host = source
), additions AS (
  SELECT 0 AS round, host, trust, distrust FROM seeds WHERE trust > 0 OR distrust > 0
  UNION ALL
  SELECT round, host, sum(trust), sum(distrust) FROM (
    SELECT round + 1 AS round, target AS host, trust * forth AS trust, 0.0 AS distrust FROM additions JOIN links ON host = source
    UNION ALL
    SELECT round + 1, source, 0.0, distrust * forth * free FROM additions JOIN links ON host = target)
  WHERE (trust > 0 OR distrust > 0) AND round <= 150 GROUP BY round, host
), scores AS (
  SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM additions GROUP BY host
)
SELECT page_id, host, path, rule,
       coalesce(verdict, if(distrust - trust > {urlfilter.MARGIN + urlfilter.RESIDUAL}, 'block', 'allow')) AS verdict
FROM ruled LEFT JOIN scores USING (host)
"""


OP6_SQL = _url_sql()


def op7_chat(spark: SparkSession, directory: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CLASH).alias("text"),
    )
    turns = table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_conversations(turns.unionByName(extra)))


OP7_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, if(n = 0, 'user', 'assistant'), '{CLASH}' FROM range(2) AS r(n)
), shown AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body,
         replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|nl|>') AS head
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(head) + 1 + length(body) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
       count(*) FILTER (body <> text OR head <> role) AS n_escaped,
       TRUE AS identical
FROM shown GROUP BY conv_id
"""


def language_model(docs: DataFrame) -> langid.Model:
    """A model learned from the documents that are not held out."""
    return langid.train(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"))))


def op8_langid(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    predicted = langid.predictions(docs, language_model(docs))
    return predicted.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op9_shards(spark: SparkSession, directory: str) -> DataFrame:
    sharded = sharding.shard(table(spark, directory, "documents"), SHARDS)
    return sharded.select(
        F.col("record.doc_id").alias("doc_id"),
        sharding.text_bytes("record.text").alias("size"),
        F.crc32(F.encode(F.coalesce("record.text", F.lit("")), "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack_documents(table(spark, directory, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_negatives(spark: SparkSession, directory: str) -> DataFrame:
    """Labels of some rows are moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.labelled_vectors(table(spark, directory, "embeddings"), moved)
    return negatives.hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


OP11_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), single AS (
  SELECT vec_id, label, v FROM usable QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM single AS a JOIN single AS r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positive JOIN scored USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
) WHERE rank <= 5
"""


def op12_trie(spark: SparkSession, directory: str) -> DataFrame:
    own = prefixtrie.turn_sequences(table(spark, directory, "conversations"))
    return prefixtrie.prefix_trie(prefixtrie.shared_openings(own))


OP12_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), digested AS (
  SELECT conv_id, turn, role, sha256(length(role) || ':' || role || text) AS digest,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM turns
), own AS (
  SELECT conv_id, list({'digest': digest, 'words': words} ORDER BY turn NULLS FIRST, role, digest) AS l,
         -- CRC-32, bit by bit
         xor(4294967295::BIGINT, list_reduce([ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')],
           lambda c, byte: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT), xor(c, byte)),
           4294967295::BIGINT)) % 4 AS h
  FROM digested GROUP BY conv_id
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.l[1:o.h], []), o.l[o.h + 1:]) AS l
  FROM own AS o LEFT JOIN own AS b ON b.conv_id = o.conv_id - o.conv_id % 20
), members AS (
  SELECT conv_id, len(l) AS n, unnest(range(len(l) + 1)) AS depth, l FROM rebuilt
), named AS (
  SELECT conv_id, n, depth, array_to_string([x.digest FOR x IN l[1:depth]], '') AS node,
         CASE WHEN depth > 0 THEN l[depth].words ELSE 0 END AS words
  FROM members
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM named GROUP BY node, depth
), children AS (
  SELECT left(node, 64 * (depth - 1)) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)
), above AS (
  SELECT left(node, 64 * k) AS node, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS k FROM counted) GROUP BY 1
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, a.n_leaves::BIGINT AS n_leaves,
       a.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted AS c JOIN above AS a USING (node)
LEFT JOIN nodes AS p ON c.depth > 0 AND p.node = left(c.node, 64 * (c.depth - 1))
"""


def op13_quality(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    return quality.judged(docs, quality.train(docs, table(spark, directory, "labels")))


QUERIES = {"op1_topk": op1_topk, "op2_simhash": op2_simhash, "op3_decontaminate": op3_decontaminate, "op4_substring": op4_substring, "op5_licenses": op5_licenses, "op6_urls": op6_urls, "op7_chat": op7_chat, "op8_langid": op8_langid, "op9_shards": op9_shards, "op10_packing": op10_packing, "op11_negatives": op11_negatives, "op12_trie": op12_trie, "op13_quality": op13_quality}
ORACLES = {"op1_topk": OP1_SQL, "op4_substring": OP4_SQL, "op5_licenses": OP5_SQL, "op6_urls": OP6_SQL, "op7_chat": OP7_SQL, "op11_negatives": OP11_SQL, "op12_trie": OP12_SQL}
