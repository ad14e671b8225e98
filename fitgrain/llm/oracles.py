"""The numbered operators' queries in SQL, where DuckDB can say them."""

from __future__ import annotations

from fitgrain.llm.fill_in_middle import DIGESTS_SQL
from fitgrain.llm.merkle import manifest_sql

WORDS = r"""regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"""
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SUBSTRINGS = f"""
WITH texts AS (
  SELECT doc_id, {WORDS.format(text='''coalesce("text", '')''')} AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM texts
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS body FROM starts
), hits AS (
  SELECT doc_id, i FROM windows JOIN (SELECT body, min(doc_id) AS first FROM windows GROUP BY body)
  USING (body) WHERE first < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p, true AS removed FROM hits
), marked AS (
  SELECT t.doc_id, t.word, t.p, coalesce(g.removed, false) AS removed
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM texts) t
  LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.p = t.p
), kept AS (
  SELECT doc_id, count(*) FILTER (removed) AS n_removed,
    string_agg(word, ' ' ORDER BY p) FILTER (NOT removed) AS body
  FROM marked GROUP BY doc_id
)
SELECT t.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(k.body, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, {WORDS.format(text=f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')")} AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS body
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM texts WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), sized AS (
  SELECT * FROM shingles JOIN sizes USING (doc_id)
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM sized x JOIN sized y ON x.body = y.body AND x.doc_id <> y.doc_id
    AND 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM texts
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT t.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM texts t JOIN reached r USING (doc_id) LEFT JOIN sizes USING (doc_id)
GROUP BY t.doc_id
"""

#: A turn's escaped length: one character more for each of these.
_LONG = r"length({x}) + length(regexp_replace({x}, '[^\\<\[]', '', 'g'))"
CHATS = f"""
WITH given AS (
  SELECT conv_id, turn, role, "text" AS body FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT conv_id, turn, coalesce(body, '') AS body, CASE role WHEN 'human' THEN 'user'
    WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant'
    ELSE coalesce(role, '') END AS role
  FROM given
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
  coalesce(sum(length(body)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(body, '' ORDER BY turn, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_LONG.format(x='role')} + {_LONG.format(x='body')} + 23)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

SQL: dict[str, str] = {
    "op1_substring_dedup": SUBSTRINGS,
    "op6_jaccard_join": JACCARD,
    "op9_chat_format": CHATS,
    "op11_fill_in_middle": DIGESTS_SQL,
    "op12_merkle_manifest": manifest_sql(),
}
