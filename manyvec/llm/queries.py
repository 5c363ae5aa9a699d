"""The registered query of each corpus operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from manyvec.llm.common import table

BPE_RANKS, BPE_JSON = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from manyvec.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from manyvec.llm import pii

    return pii.find(table(spark, sf_dir, "documents"), pii.fitted())


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from manyvec.llm import ann

    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from manyvec.llm import substrings

    return substrings.digests(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from manyvec.llm import packing

    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, public_tokenizers.path(BPE_JSON), public_tokenizers.PATTERN))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from manyvec.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from manyvec.llm import suffixes

    return suffixes.digests(table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from manyvec.llm import jaccard

    return jaccard.classes(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from manyvec.llm import langid

    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from manyvec.llm import rules

    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from manyvec.llm import chat

    turns = chat.text_parts(table(spark, sf_dir, "conversations"))
    text = "</s>[INST] ok [/INST]"
    more = chat.text_parts(spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string"))
    return chat.conversations(chat.formatted(turns.unionByName(more)))


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from manyvec.llm import audit

    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from manyvec.llm import negatives

    return negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_ann": op3_ann,
    "op4_substrings": op4_substrings,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_suffixes": op7_suffixes,
    "op8_jaccard": op8_jaccard,
    "op9_langid": op9_langid,
    "op10_rules": op10_rules,
    "op11_chat": op11_chat,
    "op12_filters": op12_filters,
    "op13_negatives": op13_negatives,
}

OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
starts AS (
  SELECT doc_id, s, array_to_string(w[s:s + 12], chr(10)) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM words WHERE len(w) >= 13)
),
gone AS (
  SELECT doc_id, list(s) AS pos
  FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY win) AS first FROM starts) WHERE doc_id > first GROUP BY doc_id
),
covered AS (
  SELECT doc_id, list_distinct(flatten(list_transform(pos, lambda s: range(s, s + 13)))) AS c FROM gone
),
kept AS (
  SELECT words.doc_id, len(w) AS n, len(coalesce(c, [])) AS r,
         CASE WHEN c IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(c, i)) END AS k
  FROM words LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n AS n_words, r AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

OP7_SQL = r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, len(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
starts AS (
  SELECT doc_id, s, md5(substr(h, 2 * s + 1, 100)) AS win FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS s FROM bytes WHERE n >= 50)
),
gone AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY win) AS first FROM starts) WHERE doc_id > first
),
islands AS (
  SELECT doc_id, min(s) AS a, max(s) + 50 AS b
  FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g
        FROM (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS new FROM gone))
  GROUP BY doc_id, g
),
gaps AS (
  SELECT doc_id, count(*) AS k, sum(b - a) AS r, list(a ORDER BY a) AS begins, list(b ORDER BY a) AS ends FROM islands GROUP BY doc_id
)
SELECT bytes.doc_id, n AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(k, 0) AS n_spans,
       sha256(CASE WHEN k IS NULL THEN unhex(h) ELSE unhex(array_to_string(list_transform(range(0, k + 1),
         lambda i: substr(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE ends[i] END) + 1, 2 * ((CASE WHEN i = k THEN n ELSE begins[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE ends[i] END)))), '')) END) AS kept_sha256
FROM bytes LEFT JOIN gaps USING (doc_id)
"""

OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS i
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (SELECT x, y FROM pairs WHERE 100 * i >= 90 * (nx + ny - i)),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.r = links.x
)
SELECT sets.doc_id, len(s) AS n_shingles, min(r) AS component_id FROM sets JOIN reach USING (doc_id) GROUP BY sets.doc_id, len(s)
"""

#: Escaping and marks as the template of operator 11 has them.
OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)
),
escaped AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?SYS\]|/?INST\]|ANS\]|/?ROLE\]|IMG:|AUD:|DOC:|ATT:)', '\1\\\2\3', 'g') AS e,
    regexp_replace(role, '([<\[])(\\*)(/?s>|/?SYS\]|/?INST\]|ANS\]|/?ROLE\]|IMG:|AUD:|DOC:|ATT:)', '\1\\\2\3', 'g') AS r FROM turns
),
formatted AS (
  SELECT *, CASE role WHEN 'system' THEN '[SYS]' || e || '[/SYS]' WHEN 'user' THEN '[INST]' || e || '[/INST]'
    WHEN 'assistant' THEN '[ANS]' || e || '</s>' ELSE '[ROLE]' || r || '[/ROLE]' || e || '</s>' END AS segment FROM escaped
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, segment)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, segment) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(segment))::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM formatted GROUP BY conv_id
"""

OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
docs AS (
  SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM words
),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM docs GROUP BY ALL),
letters AS (SELECT substr('ABCDE', i, 1) AS f FROM range(1, 6) t(i)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f
),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
    list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65)))::INT AS b4 FROM orders, range(1, 6) t(step)
),
audit AS (
  SELECT part, filter_order, step::INT AS step, f, coalesce(sum(n) FILTER (mask & (coalesce(b4, 0) | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & coalesce(b4, 0) = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & coalesce(b4, 0) <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & coalesce(b4, 0) = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & coalesce(b4, 0) = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY ALL
)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM audit
"""

OP13_SQL = """
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.id % 100 = 0 AND a.id <> b.id
),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

#: DuckDB SQL for the operators that SQL can express.
ORACLES: dict[str, str] = {
    "op4_substrings": OP4_SQL,
    "op7_suffixes": OP7_SQL,
    "op8_jaccard": OP8_SQL,
    "op11_chat": OP11_SQL,
    "op12_filters": OP12_SQL,
    "op13_negatives": OP13_SQL,
}
