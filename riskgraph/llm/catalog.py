"""The numbered operators applied to the driver tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskgraph.llm import bytepair, conversations, decontaminate, language, licenses, minhash, mixing, phrases, pii, secrets, tokens, toxicity, vectors
from riskgraph.runtime import spread

#: Key of the pseudonyms in the registered query; a deployment passes its own.
PII_KEY = "riskgraph-demo-key"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(_table(spark, d, "documents").select("doc_id", "text", *columns))


def op1_decontamination(spark: SparkSession, d: str) -> DataFrame:
    """Every document and benchmark item of which it holds a copy."""
    return decontaminate.contaminated_passages(_documents(spark, d), _table(spark, d, "benchmark"))


def op2_language(spark: SparkSession, d: str) -> DataFrame:
    return language.language_id(_documents(spark, d, "lang"))


def op3_minhash(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, d), words=4, percent=80).drop("text_hash", "group")


def op4_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed_documents(_documents(spark, d, "source"))


def op5_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, d), _table(spark, d, "labels"))


def op6_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors.vector_duplicates(_table(spark, d, "embeddings"), cosine=0.98)


def op7_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.pii_report(_documents(spark, d), PII_KEY)


def op8_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.digest(secrets.secret_findings(_documents(spark, d)))


def op9_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(_documents(spark, d))


def op10_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.license_scan(_documents(spark, d))


def op11_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.repair_report(conversations.damaged(spread(_table(spark, d, "conversations"))))


def op12_phrases(spark: SparkSession, d: str) -> DataFrame:
    return phrases.collocations(_documents(spark, d, "lang"))


def op13_bytepair(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return bytepair.round_trip(_documents(spark, d), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_language, op3_minhash, op4_mixing, op5_toxicity, op6_vectors, op7_pii, op8_secrets, op9_tokens, op10_licenses,
        op11_conversations, op12_phrases, op13_bytepair,
    )
}

_REACHED = """
  reach(node, least) AS (
    SELECT a, b FROM link UNION SELECT b, a FROM link
    UNION
    SELECT r.node, e.b FROM reach r JOIN (SELECT a, b FROM link UNION SELECT b, a FROM link) e ON e.a = r.least)"""

SQL: dict[str, str] = {
    "op3_minhash": rf"""
WITH RECURSIVE lowered AS (
    SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  listed AS (SELECT doc_id, regexp_extract_all(coalesce(t, ''), '[^\x20\x09-\x0D]+') AS w FROM lowered),
  sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM listed),
  parts AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
  link(a, b) AS (
    SELECT x.doc_id, y.doc_id FROM parts x JOIN parts y ON x.g = y.g AND x.doc_id < y.doc_id
    GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),{_REACHED}
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(min(r.least), s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(min(r.least), s.doc_id)) AS kept
FROM sets s LEFT JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.s)""",
    "op6_vectors": rf"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  link(a, b) AS (
    SELECT x.vec_id, y.vec_id FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
    WHERE list_cosine_similarity(x.e, y.e) >= 0.98),{_REACHED}
SELECT m.vec_id, (SELECT count(*) FROM link WHERE a = m.vec_id OR b = m.vec_id) AS n_links,
  least(m.vec_id, coalesce(min(r.least), m.vec_id)) AS component_id,
  m.vec_id = least(m.vec_id, coalesce(min(r.least), m.vec_id)) AS kept
FROM embeddings m LEFT JOIN reach r ON r.node = m.vec_id GROUP BY m.vec_id""",
    "op11_conversations": r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS bytes FROM conversations),
  coded AS (
    SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)),
      lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))) % 20 AS k FROM keyed),
  present AS (
    SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
      CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM coded WHERE k <> 0),
  placed AS (
    SELECT *, left(role, 1) AS q, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS m FROM present),
  judged AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
      lag(q) OVER (PARTITION BY conv_id ORDER BY i) || q NOT IN ('su', 'ua', 'au') AS bad FROM placed),
  best(conv_id, j, b0, b1, b2, b3) AS (
    SELECT DISTINCT conv_id, m, {'c': 0, 'a': ''}, {'c': 10, 'a': 'II'}, {'c': 5, 'a': 'I'}, {'c': 0, 'a': ''} FROM judged
    UNION ALL
    SELECT conv_id, j - 1, list_sort([w0, {'c': v2.c + 5, 'a': 'I' || v2.a}])[1], list_sort([w1, {'c': v2.c + 5, 'a': 'I' || v2.a}])[1], v2, v3 FROM (
      SELECT *, list_sort([w2, {'c': w3.c + 5, 'a': 'I' || w3.a}])[1] AS v2, list_sort([w3, {'c': w2.c + 5, 'a': 'I' || w2.a}])[1] AS v3 FROM (
        SELECT b.conv_id, b.j,
          list_sort([{'c': b0.c + 2, 'a': 'D' || b0.a}, {'c': b1.c + x + IF(q = 's', 0, 1000000), 'a': 'K' || b1.a}, {'c': b2.c + x + IF(q = 'u', 0, 1000000), 'a': 'K' || b2.a}, {'c': b2.c + x + 1, 'a': 'R' || b2.a}])[1] AS w0,
          list_sort([{'c': b1.c + 2, 'a': 'D' || b1.a}, {'c': b2.c + x + IF(q = 'u', 0, 1000000), 'a': 'K' || b2.a}, {'c': b2.c + x + 1, 'a': 'R' || b2.a}])[1] AS w1,
          list_sort([{'c': b2.c + 2, 'a': 'D' || b2.a}, {'c': b3.c + x + IF(q = 'a', 0, 1000000), 'a': 'K' || b3.a}, {'c': b3.c + x + 1, 'a': 'R' || b3.a}])[1] AS w2,
          list_sort([{'c': b3.c + 2, 'a': 'D' || b3.a}, {'c': b2.c + x + IF(q = 'u', 0, 1000000), 'a': 'K' || b2.a}, {'c': b2.c + x + 1, 'a': 'R' || b2.a}])[1] AS w3
        FROM best b JOIN (SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000000 END AS x FROM judged) r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.j))),
  chosen AS (SELECT conv_id, b0.c AS cost, b0.a AS audit FROM best WHERE j = 0),
  letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS p FROM chosen WHERE audit <> ''),
  steps AS (
    SELECT *, count(*) FILTER (WHERE e <> 'I') OVER w AS i, count(*) FILTER (WHERE e <> 'D') OVER w AS o FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
  said AS (
    SELECT s.conv_id, s.o, s.e, CASE WHEN s.e = 'K' THEN r.role END AS role, CASE WHEN s.e = 'I' THEN '' ELSE r.text END AS text,
      coalesce(first_value(CASE WHEN s.e = 'K' THEN r.q END) OVER (PARTITION BY s.conv_id ORDER BY s.o), '') = 's' AS led
    FROM steps s LEFT JOIN judged r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i WHERE s.e <> 'D'),
  repaired AS (
    SELECT conv_id, sha256(string_agg(coalesce(role, CASE WHEN (o - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY o)) AS h FROM said GROUP BY conv_id),
  counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
      count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE bad) AS illegal FROM judged GROUP BY conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
  coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(h.cost, 0)::BIGINT AS cost, coalesce(h.audit, '') AS audit, coalesce(r.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM a.conv_id""",
    "op12_phrases": r"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
  piece AS (SELECT lang, unnest(pieces) AS p FROM texts),
  listed AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
  totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang),
  runs AS (SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) AS g FROM listed),
  f AS (SELECT lang, g, count(*)::HUGEINT AS f FROM runs GROUP BY lang, g HAVING count(*) >= 30),
  cuts AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
  scored AS (
    SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, (2000000 * c.a) // (x.f + y.f) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:]),
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
  inner_ AS (
    SELECT lang, f, unnest(flatten(list_transform(range(2, len(g)), lambda k: list_transform(range(1, len(g) - k + 2), lambda i: g[i:i + k - 1])))) AS g
    FROM f WHERE len(g) > 2),
  cover AS (SELECT lang, g, max(f) AS most FROM inner_ GROUP BY lang, g),
  kept AS (SELECT b.* FROM best b LEFT JOIN cover c ON c.lang = b.lang AND c.g = b.g WHERE c.most IS NULL OR 100 * c.most < 80 * b.a),
  ranked AS (
    SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
