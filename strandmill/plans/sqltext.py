"""Pieces of the oracle SQL that several queries share (DuckDB)."""

from __future__ import annotations

TURNS = """
turns AS (
  SELECT 'conv:' || conv_id AS sample_id, 'conv:' || conv_id || ':turn:' || turn AS turn_id, 'D1:' || (turn + 1) AS evidence_id, turn AS turn_pos, role AS speaker, text
  FROM conversations
), records AS (
  SELECT sample_id, turn_id AS record_id, turn_pos AS pos, coalesce(text, '') AS text, speaker FROM turns
), questions AS (
  SELECT q.sample_id, q.sample_id || ':' || q.turn_pos AS question_id, q.turn_pos AS question_pos, coalesce(q.text, '') AS question, coalesce(a.text, '') AS reference,
         a.turn_id AS evidence, CASE q.turn_pos % 5 WHEN 0 THEN 'multi_hop' WHEN 1 THEN 'temporal' WHEN 2 THEN 'open_domain' WHEN 3 THEN 'single_hop' ELSE 'adversarial' END AS label
  FROM turns q JOIN turns a ON a.sample_id = q.sample_id AND a.turn_pos = q.turn_pos + 1 WHERE q.speaker = 'user' AND a.speaker = 'assistant'
)"""


def tokens(text: str) -> str:
    return f"regexp_extract_all(replace(lower({text}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_'']+')"


def words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+|[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+$', '', 'g')"


def bm25(name: str, questions: str, records: str, scope: str, query: str = "query", text: str = "text", okapi: bool = False, pos: bool = False) -> str:
    """CTEs that end in `name`: scope, question_id, record_id, score of all records in the question's scope."""
    make, on, by = (words if okapi else tokens), (f"USING ({scope}, term)" if scope else "USING (term)"), (f"{scope}, " if scope else "")
    q_by = by if scope != "question_id" else ""
    group = f"GROUP BY {scope}" if scope else ""
    join = lambda x: f"JOIN {x} USING ({scope})" if scope else f"CROSS JOIN {x}"
    idf = f"SELECT {by}term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * avg(raw) OVER ({f'PARTITION BY {scope}' if scope else ''}) ELSE raw END AS idf FROM {name}_raw" if okapi else f"SELECT {by}term, raw AS idf FROM {name}_raw"
    raw = "ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE)" if okapi else "ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"
    extra = ", r.pos" if pos else ""
    return f"""
{name}_t AS (SELECT {by}record_id, {make(text)} AS ts FROM {records}),
{name}_p AS (SELECT {by}record_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT {by}record_id, unnest(ts) AS term, len(ts) AS dl FROM {name}_t) GROUP BY {by}record_id, term),
{name}_n AS (SELECT {by}count(*) AS n, CASE WHEN avg(len(ts)) = 0 THEN 1.0 ELSE avg(len(ts)) END AS avgdl FROM {name}_t {group}),
{name}_df AS (SELECT {by}term, count(*) AS df FROM {name}_p GROUP BY {by}term),
{name}_raw AS (SELECT {by}term, {raw} AS raw FROM {name}_df {join(name + '_n')}),
{name}_idf AS ({idf}),
{name}_q AS (SELECT {q_by}question_id, term, count(*) AS qtf FROM (SELECT {q_by}question_id, unnest({make(query)}) AS term FROM {questions}) GROUP BY {q_by}question_id, term),
{name}_h AS (SELECT question_id, record_id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS s FROM {name}_q JOIN {name}_p {on} JOIN {name}_idf {on} {join(name + '_n')} GROUP BY question_id, record_id),
{name} AS (SELECT {', '.join(dict.fromkeys([*(['q.' + scope] if scope else []), 'q.question_id', 'r.record_id']))}{extra}, coalesce(round(s, 9), 0.0)::DOUBLE AS score FROM {questions} q {f'JOIN {records} r ON r.{scope} = q.{scope}' if scope else f'CROSS JOIN {records} r'} LEFT JOIN {name}_h h ON h.question_id = q.question_id AND h.record_id = r.record_id)"""


def topk(source: str, k: int | None, order: str = "score DESC, record_id", columns: str = "*") -> str:
    inner = f"SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {order}) AS rank FROM {source}"
    return f"SELECT {columns} FROM ({inner}) {f'WHERE rank <= {k}' if k else ''}"


def f1(p: str, r: str) -> str:
    dp, dr = f"list_distinct({tokens(p)})", f"list_distinct({tokens(r)})"
    c, n, m = f"len(list_intersect({dp}, {dr}))::DOUBLE", f"len({dp})", f"len({dr})"
    return f"CASE WHEN {n} = 0 OR {m} = 0 OR {c} = 0 THEN 0.0::DOUBLE ELSE 2 * ({c} / {n}) * ({c} / {m}) / ({c} / {n} + {c} / {m}) END"


def bleu1(p: str, r: str) -> str:
    tp, tr = tokens(p), tokens(r)
    clipped = f"coalesce(list_sum(list_transform(list_distinct({tp}), lambda t: least(len(list_filter({tp}, lambda x: x = t)), len(list_filter({tr}, lambda x: x = t))))), 0)::DOUBLE"
    n, m = f"len({tp})", f"len({tr})"
    return f"CASE WHEN {n} = 0 OR {m} = 0 THEN 0.0::DOUBLE ELSE (CASE WHEN {n} >= {m} THEN 1.0::DOUBLE ELSE exp(1.0::DOUBLE - {m}::DOUBLE / {n}) END) * {clipped} / {n} END"


def exact(p: str, r: str) -> str:
    fold = lambda x: f"replace(lower({strip(x)}), 'ß', 'ss')"
    return f"CASE WHEN {fold(p)} = {fold(r)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


LINKS = """
links AS (
  SELECT sample_id, turn_id AS record_id, k AS link_pos, CASE k WHEN 0 THEN (turn_pos - 1)::VARCHAR WHEN 1 THEN (turn_pos - 2)::VARCHAR ELSE (turn_pos + 100)::VARCHAR END AS link
  FROM turns, (VALUES (0), (1), (2)) v(k) WHERE (k = 0 AND turn_pos >= 1) OR (k = 1 AND turn_pos >= 2) OR (k = 2 AND turn_pos % 2 = 0)
), resolved AS (
  SELECT l.sample_id, l.record_id, row_number() OVER (PARTITION BY l.record_id ORDER BY l.link_pos) - 1 AS link_pos, coalesce(r.record_id, l.link) AS target_id
  FROM links l LEFT JOIN records r ON r.sample_id = l.sample_id AND r.pos::VARCHAR = l.link
)"""
