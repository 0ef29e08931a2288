"""Registered queries of the text operators and their DuckDB text, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from riskloom.llm import chat, credentials, crosswalk, fingerprints, langid, lines, mixing, neighbours, pieces, recurrent, simhash, toxicity, whitening
from riskloom.llm.common import WORD, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op1_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.document_digests(table(spark, sf, "documents"))


def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    return langid.predictions(table(spark, sf, "documents"))


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


def op4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.digests(table(spark, sf, "documents"), PIECES)


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op6_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.line_report(table(spark, sf, "documents"))


def op7_chat(spark: SparkSession, sf: str) -> DataFrame:
    return chat.read_back(chat.formatted(chat.with_probe(table(spark, sf, "conversations"))))


def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.report(table(spark, sf, "documents"))


def op9_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.report(table(spark, sf, "documents"))


def op10_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"))


def op11_crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    return crosswalk.report(table(spark, sf, "documents"), BYTES, PIECES)


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(table(spark, sf, "embeddings"))


def op13_recurrent(spark: SparkSession, sf: str) -> DataFrame:
    return recurrent.scores(table(spark, sf, "documents"))


def _time_sql(share: str) -> str:
    """The inverse of the schedules' integrals, as in ``mixing.time_of``."""
    cases = []
    for k, knots in enumerate(mixing.SCHEDULES):
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        whole, done, arms = sum(areas), 0.0, []
        for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
            rest = f"({share} * {whole}::DOUBLE - {done}::DOUBLE)"
            t = f"least({t1}::DOUBLE, {t0}::DOUBLE + 2 * {rest} / ({w0}::DOUBLE + sqrt(greatest({w0 * w0}::DOUBLE + {2 * (w1 - w0) / (t1 - t0)}::DOUBLE * {rest}, 0))))"
            done += area
            arms.append(f"WHEN {share} <= {done / whole!r}::DOUBLE THEN {t}" if area is not areas[-1] or (t1, w1) != knots[-1] else f"ELSE {t}")
        cases.append(f"WHEN {k} THEN {'CASE ' + ' '.join(arms) + ' END' if len(arms) > 1 else arms[0].removeprefix('ELSE ')}")
    return f"CASE place % {len(mixing.SCHEDULES)} {' '.join(cases)} END"


OP3_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN {mixing.WEIGHTS[0]}::DOUBLE WHEN 1 THEN {mixing.WEIGHTS[1]}::DOUBLE ELSE {mixing.WEIGHTS[2]}::DOUBLE END AS weight, source_size * {float(mixing.MOST_PASSES)}::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
level AS (SELECT arg_min(level, cap / weight) AS level FROM levels WHERE level <= cap / weight),
targets AS (SELECT source, source_size, place, least(cap, weight * level.level) AS target FROM weighed, level),
placed AS (
  SELECT s.*, t.source_size, t.place, t.target, round(t.target)::BIGINT AS due,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY ord, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
took AS (
  SELECT *, CASE WHEN due > 0 AND start < due THEN least(1::DOUBLE, (start + greatest(0, least(size, due - start)) / 2::DOUBLE) / due) END AS share,
    {' + '.join(f'greatest(0, least(size, due - start - {k} * source_size))' for k in range(mixing.MOST_PASSES))} AS taken FROM placed)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target, taken::BIGINT AS taken, CASE WHEN share IS NOT NULL THEN round({_time_sql('share')}, 6) END AS first_position FROM took
"""

OP6_SQL = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{lines.UPPER}', '{lines.LOWER}') AS key FROM split),
firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= {lines.LEAST} GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id > f.first_doc, false) AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _chat_sql() -> str:
    t = chat.INSTRUCT
    marks = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b, _) in t.turns.items())
    controls = "|".join("".join("\\" + c if c in "[]" else c for c in x) for x in sorted(t.controls, key=len, reverse=True))
    own = f"'{chat.PROBE}'"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {own} UNION ALL SELECT -1, 1, 'assistant', {own})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  ({len(t.begin)} + sum(CASE role {marks} END + 2 * length(text) - length(replace(text, '\\', '')) + len(regexp_extract_all(text, '{controls}'))))::BIGINT AS formatted_chars,
  regexp_matches(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), '^s?u(au)*a?$') AS valid
FROM turns GROUP BY conv_id
"""


def _secrets_sql() -> str:
    assign = credentials.ASSIGN.replace("'", "''").replace("(?i:password", "(?i:password")
    kinds = ((0, assign, 1, "length(v) >= 8"), (1, credentials.ACCESS, 0, "true"), (2, credentials.HEX, 0, "true"), (3, "[A-Za-z0-9+/]+=?", 0, "length(m) = 40 AND NOT contains(m, '=') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')"), (4, credentials.ENDPOINT, 0, "true"))
    union = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, start, start + length(m) AS stop FROM (SELECT doc_id, m, v, sum(length(b)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT doc_id, unnest(b[1:len(m)]) AS b, unnest(m) AS m, unnest(v) AS v, generate_subscripts(m, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(t, '{p}') AS b, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {g}) AS v FROM texts)) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {cond}"
        for k, p, g, cond in kinds
    )
    names = "CASE k " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(credentials.KINDS)) + " END || ':' || start || ':' || stop"
    near = f"abs(a.start - s.start) <= {credentials.SCOPE}"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS MATERIALIZED (SELECT doc_id, k, start::BIGINT AS start, stop::BIGINT AS stop FROM ({union})),
keys AS (SELECT * FROM spans s WHERE k = 3 AND EXISTS (SELECT 1 FROM spans a WHERE a.doc_id = s.doc_id AND a.k IN (1, 4) AND {near})),
ends AS (SELECT * FROM spans s WHERE k = 4 AND EXISTS (SELECT 1 FROM spans a WHERE a.doc_id = s.doc_id AND a.k < 4 AND {near})),
kept AS (SELECT * FROM spans WHERE k < 3 UNION ALL SELECT * FROM keys UNION ALL SELECT * FROM ends),
by_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
    string_agg({names}, ',' ORDER BY start, k) FILTER (WHERE k < 3) AS base, string_agg({names}, ',' ORDER BY start, k) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN by_doc b ON d.doc_id = b.doc_id
"""


def runs() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> Spark plan builder."""
    found = (op1_fingerprints, op2_language, op3_mixing, op4_pieces, op5_toxicity, op6_lines, op7_chat, op8_simhash, op9_secrets, op10_neighbours, op11_crosswalk, op12_whitening, op13_recurrent)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def texts() -> dict[str, str]:
    """Name -> DuckDB text. The others are tested against brute force, round trips or held-out accuracy."""
    sql = {"op3_mixing": OP3_SQL, "op6_lines": OP6_SQL, "op7_chat": _chat_sql(), "op9_secrets": _secrets_sql()}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
