"""The registered queries of the training-data operators: name -> query, name -> SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import ann, chat_format, conversation_repair, embedding_whitening, exact_dedup, html_extraction, mixing, packing, simhash, substring_dedup, token_counts, toxicity, warc

VOCABULARY = "byte_bpe_50k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), 512)


@_query
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@_query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


SQL["op3_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
"""


@_query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


@_query
def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


@_query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@_query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


SQL["op9_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM m
"""


@_query
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@_query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damage(conversations), conversations)


#: States 0 to 3: nothing, system, user, assistant. ``ins``: inserts before a turn; ``put``: what may be kept or written after a state.
SQL["op11_conversation_repair"] = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(k, '')])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT) % 20 AS d FROM src),
r AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE d <> 0),
o AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM r),
f AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS letter, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior,
    CASE WHEN e = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
ins(state, upto, paid, code, lines) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 2, 'I', 'user:' || chr(10)), (1, 2, 2, 'I', 'user:' || chr(10)), (3, 2, 2, 'I', 'user:' || chr(10)), (2, 3, 2, 'I', 'assistant:' || chr(10)),
  (0, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
  (3, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 2, 4, 'II', 'assistant:' || chr(10) || 'user:' || chr(10))),
put(upto, letter, next, role) AS (VALUES (0, 's', 1, NULL), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
ways AS (
  SELECT f.conv_id, f.i, ins.state, ins.upto AS next, paid + 3 AS cost, code || 'D' AS code, lines FROM f, ins
  UNION ALL SELECT f.conv_id, f.i, ins.state, put.next, paid + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, code || 'K', lines || f.role || ':' || f.text || chr(10) FROM f, ins JOIN put USING (upto) WHERE f.letter = put.letter AND fault IN ('', 'truncated')
  UNION ALL SELECT f.conv_id, f.i, ins.state, put.next, paid + 2 + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, code || 'R', lines || put.role || ':' || f.text || chr(10) FROM f, ins JOIN put USING (upto) WHERE put.role IS NOT NULL AND fault IN ('', 'truncated')),
best AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {'c': 0, 'a': '', 'l': ''} AS b FROM f
  UNION ALL
  SELECT conv_id, i, next, min({'c': c, 'a': a, 'l': l}) FROM (
    SELECT best.conv_id, ways.i, ways.next, b.c + ways.cost AS c, b.a || ways.code AS a, b.l || ways.lines AS l
    FROM best JOIN ways ON best.conv_id IS NOT DISTINCT FROM ways.conv_id AND best.i + 1 = ways.i AND best.state = ways.state) GROUP BY conv_id, i, next),
done AS (
  SELECT conv_id, min({'c': b.c + paid, 'a': b.a || code, 'l': b.l || lines}) AS b FROM best JOIN ins USING (state)
  WHERE ins.upto IN (0, 3) AND i = (SELECT max(i) FROM f WHERE f.conv_id IS NOT DISTINCT FROM best.conv_id) GROUP BY conv_id),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND prior || letter NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.l[:-2], '')) AS repaired_sha256
FROM ids LEFT JOIN n ON ids.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN done ON ids.conv_id IS NOT DISTINCT FROM done.conv_id
"""


@_query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(table(spark, sf_dir, "embeddings"))


@_query
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.round_trip(table(spark, sf_dir, "conversations"))


SQL["op13_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
m AS (SELECT * FROM (VALUES ('system', 15), ('user', 13), ('assistant', 7)) AS v(role, marks)),
e AS (SELECT c.*, marks, [length(regexp_replace(replace(x, '\', '\\'), '<<SYS>>|<</SYS>>|<s>|</s>|\[/?(INST|ROLE)\]|\[/TURN\]', '\\\0', 'g')) FOR x IN [c.text, c.role]] AS n FROM c LEFT JOIN m USING (role))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n[1] + coalesce(marks, 20 + n[2])) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
