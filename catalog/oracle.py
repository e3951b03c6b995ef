"""SQL that gives the expected result of the registered queries, for DuckDB."""

from __future__ import annotations

from catalog.queries import CLOSING, INSTRUCTION_PROMPT, OPENING, SECTION_HEAD, SECTION_TAIL

AS_OF = "TIMESTAMP '2024-02-15 00:00:00'"


def _text(literal: str) -> str:
    return "'" + literal.replace("'", "''") + "'"


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def rate(kind: str) -> str:
    return (
        f"CASE {kind} WHEN 'preference' THEN 0.02e0 WHEN 'pattern' THEN 0.03e0 "
        "WHEN 'decision' THEN 0.05e0 WHEN 'bug_fix' THEN 0.08e0 ELSE 0.1e0 END"
    )


def days(ts: str) -> str:
    return f"((epoch_us({AS_OF}) - epoch_us({ts})) / 86400000000e0)"


def eff(rate_: str = "decay_rate", n: str = "access_count") -> str:
    return f"greatest(0e0, {rate_} - ln(1 + {n}) * 0.1e0)"


def current(score: str = "importance_score", ts: str = "last_accessed") -> str:
    return f"greatest(0e0, least(1e0, {score} * exp(-{eff()} * {days(ts)})))"


def action(score: str, cur: str) -> str:
    return (
        f"CASE WHEN {cur} < 0.05e0 THEN 'forget' "
        f"WHEN abs({cur} - {score}) > 0.001e0 THEN 'update' ELSE 'keep' END"
    )


def project(n: str) -> str:
    return f"CASE WHEN {n} % 4 <> 0 THEN concat('p', CAST({n} % 3 AS VARCHAR)) END"


def label_type(label: str) -> str:
    return (
        f"CASE {label} % 5 WHEN 0 THEN 'general' WHEN 1 THEN 'preference' "
        "WHEN 2 THEN 'decision' WHEN 3 THEN 'bug_fix' ELSE 'pattern' END"
    )


def total(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


X1 = f"""
x1 AS (
  SELECT id, user_id, project_id, content, memory_type, importance_score,
         {rate('memory_type')} AS decay_rate, access_count, ts AS created_at,
         ts AS last_accessed, emb
  FROM (SELECT n.id, n.id % 10 AS user_id, {project('n.id')} AS project_id,
               coalesce(d.text, concat('note ', CAST(n.id AS VARCHAR))) AS content,
               {label_type('coalesce(e.label, n.id % 10)')} AS memory_type,
               (n.id * 37 % 101) / 100e0 AS importance_score,
               CAST(n.id % 4 AS INT) AS access_count,
               coalesce(v.ts, TIMESTAMP '2024-01-01 00:00:00') AS ts,
               CAST(e.embedding AS DOUBLE[]) AS emb
        FROM (SELECT doc_id AS id FROM documents UNION SELECT vec_id FROM embeddings) n
        LEFT JOIN documents d ON d.doc_id = n.id LEFT JOIN embeddings e ON e.vec_id = n.id
        LEFT JOIN events v ON v.event_id = n.id))"""

X2 = f"""
x2 AS (
  SELECT *, {rate('memory_type')} AS decay_rate FROM (
    SELECT event_id AS id, user_id, {project('event_id')} AS project_id,
           concat('event ', CAST(event_id AS VARCHAR)) AS content,
           CASE event_type WHEN 'view' THEN 'general' WHEN 'click' THEN 'preference'
                           WHEN 'purchase' THEN 'decision' WHEN 'error' THEN 'bug_fix'
                           ELSE 'pattern' END AS memory_type,
           least(1e0, value / 200e0) AS importance_score,
           CAST(event_id % 4 AS INT) AS access_count, ts AS created_at, ts AS last_accessed
    FROM events))"""

SWEPT = f"""
swept AS (
  SELECT *, {current()} AS cur, {action('importance_score', current())} AS action FROM x2)"""

REQ = """
req AS (
  SELECT vec_id AS qid, vec_id % 10 AS user_id,
         CASE WHEN vec_id % 2 = 1 THEN concat('p', CAST(vec_id % 3 AS VARCHAR)) END AS project_id,
         CAST(embedding AS DOUBLE[]) AS emb
  FROM embeddings)"""

IN_PROJECT = "(coalesce(q.project_id, '') = '' OR m.project_id = q.project_id)"


def hits(scope: str = IN_PROJECT, where: str = "true") -> str:
    return f"""
pairs AS (
  SELECT q.qid, m.id, round(list_cosine_similarity(m.emb, q.emb), 12) AS similarity
  FROM req q JOIN x1 m ON m.user_id = q.user_id AND {scope}
  WHERE m.importance_score > 0 AND m.emb IS NOT NULL AND {where}),
hits AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS INTEGER) AS crank
                 FROM pairs) WHERE crank <= 20)"""


MISSING = "(h.qid % 3 = 0 OR m.memory_type = 'bug_fix')"


def found(
    relevance: str | None = f"CASE WHEN NOT {MISSING} THEN ((h.qid * 31 + h.id * 17) % 101) / 100e0 END",
    answered: str = "count(relevance) OVER (PARTITION BY qid) > 0",
) -> str:
    return f"""
scored AS (
  SELECT h.qid, h.id, h.similarity, h.crank, m.content, m.memory_type,
         {current('m.importance_score', 'm.last_accessed')} AS imp,
         {relevance or 'CAST(NULL AS DOUBLE)'} AS relevance
  FROM hits h JOIN x1 m ON m.id = h.id),
reranked AS (
  SELECT *, CASE WHEN {answered} THEN coalesce(relevance, 0e0)
                 ELSE 1e0 / count(*) OVER (PARTITION BY qid) END AS rerank
  FROM scored),
results AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, crank) AS INTEGER) AS rank
  FROM (SELECT *, coalesce(nullif(rerank, 0), similarity) * imp AS score FROM reranked))"""


#: What the stand-in rerank call answers.
CALLED = "CASE WHEN h.qid % 5 <> 0 AND length(m.content) % 4 <> 0 THEN (length(m.content) % 101) / 100e0 END"

SEARCH = f"WITH {X1}, {REQ}, {hits()}, {found()}"
SEARCH_COLUMNS = """qid, rank, id, round(imp, 6) AS importance_score, round(similarity, 6) AS similarity,
  round(rerank, 6) AS rerank_score, round(score, 6) AS score"""
TOPK = f"""WITH {X1}, {REQ}, {hits()}
SELECT qid, crank AS rank, id, round(similarity, 6) AS similarity FROM hits"""

PACK = f"""
WITH RECURSIVE {X1}, {REQ}, {hits()}, {found()},
ordered AS (
  SELECT *, length(content) // 4 AS cost,
         row_number() OVER (PARTITION BY qid ORDER BY rerank * imp DESC, rank) AS step
  FROM results WHERE rank <= 20),
walk AS (
  SELECT qid, step, id, memory_type, content, cost, cost <= 8000 AS taken,
         CASE WHEN cost <= 8000 THEN 8000 - cost ELSE 8000 END AS budget
  FROM ordered WHERE step = 1
  UNION ALL
  SELECT o.qid, o.step, o.id, o.memory_type, o.content, o.cost, o.cost <= w.budget,
         CASE WHEN o.cost <= w.budget THEN w.budget - o.cost ELSE w.budget END
  FROM walk w JOIN ordered o ON o.qid = w.qid AND o.step = w.step + 1),
packed AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY step) AS position FROM walk WHERE taken)"""

def mixed(base: str) -> str:
    weight = f"(0.60e0 + 0.05e0 * (({base} // 5) % 8))"
    return f"list_transform(list_zip(a, b), lambda t: {weight} * t[1] + (1e0 - {weight}) * t[2])"


#: Every vector beside the next one of its user, the last beside the first.
PAIRED = """
paired AS (
  SELECT a.vec_id, a.label, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b
  FROM (SELECT *, CASE WHEN vec_id = max(vec_id) OVER (PARTITION BY vec_id % 10)
                       THEN min(vec_id) OVER (PARTITION BY vec_id % 10) ELSE vec_id + 10 END AS next_id
        FROM embeddings) a JOIN embeddings b ON b.vec_id = a.next_id)"""

X3 = f"""{PAIRED},
x3 AS (
  SELECT vec_id * 2 + copy AS seq, vec_id % 10 AS user_id, {project('vec_id')} AS project_id,
         concat('note ', CAST(vec_id AS VARCHAR)) AS content, {label_type('label')} AS memory_type,
         (vec_id * 53 % 101) / 100e0 AS importance_score, {mixed('vec_id')} AS emb
  FROM (SELECT *, unnest([0, 1]) AS copy FROM paired))"""

NEAR = "round(list_cosine_similarity(m.emb, q.emb), 12)"


def stored_hits(incoming: str = "x3") -> str:
    return f"""
stored AS (
  SELECT seq, id, sim FROM (
    SELECT q.seq, m.id, {NEAR} AS sim,
           row_number() OVER (PARTITION BY q.seq ORDER BY {NEAR} DESC, m.id) AS r
    FROM {incoming} q JOIN x1 m ON m.user_id = q.user_id AND {IN_PROJECT}
    WHERE m.importance_score > 0 AND m.emb IS NOT NULL AND {NEAR} >= 0.93e0) WHERE r = 1)"""


def ordered_saves(incoming: str = "x3") -> str:
    return f"""
{stored_hits(incoming)},
fresh AS (SELECT * FROM {incoming} WHERE seq NOT IN (SELECT seq FROM stored)),
edges AS (
  SELECT q.seq, m.seq AS other, {NEAR} AS sim
  FROM {incoming} q JOIN fresh m ON m.user_id = q.user_id AND m.seq < q.seq AND {IN_PROJECT}
  WHERE m.importance_score > 0 AND {NEAR} >= 0.93e0),
queue AS (
  SELECT f.seq, f.user_id, f.importance_score,
         row_number() OVER (PARTITION BY f.user_id ORDER BY f.seq) AS step,
         coalesce(n.others, CAST([] AS BIGINT[])) AS others
  FROM fresh f LEFT JOIN (SELECT seq, list(other) AS others FROM edges GROUP BY seq) n ON n.seq = f.seq),
walk AS (
  SELECT user_id, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS kept
  FROM (SELECT DISTINCT user_id FROM queue)
  UNION ALL
  SELECT w.user_id, w.step + 1,
         CASE WHEN q.importance_score > 0 AND NOT list_has_any(w.kept, q.others)
              THEN list_append(w.kept, q.seq) ELSE w.kept END
  FROM walk w JOIN queue q ON q.user_id = w.user_id AND q.step = w.step + 1),
leaders AS (SELECT unnest(kept) AS seq FROM (
  SELECT kept FROM walk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY step DESC) = 1)),
batch AS (
  SELECT seq, other, sim FROM (
    SELECT e.*, row_number() OVER (PARTITION BY e.seq ORDER BY sim DESC, other) AS r
    FROM edges e WHERE other IN (SELECT seq FROM leaders) AND seq NOT IN (SELECT seq FROM leaders))
  WHERE r = 1),
decisions AS (
  SELECT i.seq,
         CASE WHEN s.seq IS NULL AND b.seq IS NULL THEN 'insert' ELSE 'reinforce' END AS action,
         CASE WHEN coalesce(b.sim, -2) > coalesce(s.sim, -2) THEN 'batch'
              WHEN s.seq IS NOT NULL THEN 'stored' END AS target,
         CASE WHEN coalesce(b.sim, -2) <= coalesce(s.sim, -2) THEN s.id END AS id,
         CASE WHEN coalesce(b.sim, -2) > coalesce(s.sim, -2) THEN b.other END AS target_seq,
         round(greatest(s.sim, b.sim), 6) AS similarity
  FROM {incoming} i LEFT JOIN stored s ON s.seq = i.seq LEFT JOIN batch b ON b.seq = i.seq)"""


SAVE_ORDERED = f"WITH RECURSIVE {X1}, {X3}, {ordered_saves()} SELECT * FROM decisions"

LOG = """
log AS (SELECT event_id // 8 AS memory_id, ts FROM events WHERE event_type IN ('click', 'view')),
rolled AS (SELECT memory_id AS id, count(*) AS recalls, max(ts) AS latest FROM log GROUP BY memory_id)"""

STATE = f"""id, round(importance_score, 6) AS importance_score, access_count,
  {stamp('last_accessed')} AS last_accessed"""


def touched(boost: bool) -> str:
    score = (
        "CASE WHEN r.id IS NULL THEN m.importance_score "
        "ELSE least(1e0, m.importance_score + 0.2e0 * r.recalls) END"
        if boost
        else "m.importance_score"
    )
    return f"""
touched AS (
  SELECT m.id, {score} AS importance_score,
         CAST(m.access_count + coalesce(r.recalls, 0) AS INT) AS access_count,
         greatest(m.last_accessed, r.latest) AS last_accessed
  FROM state m LEFT JOIN rolled r ON r.id = m.id)"""


def after_saves(decisions: str, batch_target: str) -> str:
    return f"""
state AS (
  SELECT id, importance_score, access_count, last_accessed FROM x1
  UNION ALL
  SELECT -(seq + 1), importance_score, 0, {AS_OF} FROM x3
  WHERE seq IN (SELECT seq FROM {decisions} WHERE action = 'insert')),
rolled AS (
  SELECT id, count(*) AS recalls, {AS_OF} AS latest
  FROM (SELECT coalesce(id, {batch_target}) AS id FROM {decisions} WHERE action = 'reinforce')
  GROUP BY id),
{touched(True)}
SELECT {STATE} FROM touched"""


def stats(group: str = "user_id") -> str:
    return f"""count(m.{group}) AS total_memories, round(avg(m.importance_score) + 1e-9, 6) AS avg_importance,
  {stamp('min(m.created_at)')} AS oldest_memory, {stamp('max(m.created_at)')} AS newest_memory,
  count(*) FILTER (WHERE m.importance_score < 0.2e0) AS memories_at_risk"""


DECISION = '\'"memory_type":"decision","importance_score":0.9\''
COMPLETIONS = f"""
shaped AS (
  SELECT conv_id * 1000 + turn AS completion_id, conv_id % 10 AS user_id,
         {project('conv_id')} AS project_id, text, (conv_id + turn) % 10 AS shape,
         concat('{{"content":', CAST(to_json(text) AS VARCHAR)) AS open
  FROM conversations),
completions AS (
  SELECT completion_id, user_id, project_id,
    CASE shape
      WHEN 0 THEN concat('[', open, ',', {DECISION}, '}}]')
      WHEN 1 THEN concat('```json', chr(10), '[', open, ',', {DECISION}, '}}]', chr(10), '```')
      WHEN 2 THEN '[]'
      WHEN 3 THEN text
      WHEN 4 THEN concat(open, '}}')
      WHEN 5 THEN concat('[', open, '}},', open, '}},', open, ',"memory_type":"other"}},',
                         open, '}},', open, '}},', open, '}},', open, '}}]')
      WHEN 6 THEN concat('[', open, ',"importance_score":1.7}},', open, ',', {DECISION}, '}}]')
      WHEN 7 THEN concat('[{{"memory_type":"pattern"}},{{"content":""}},', open, ',', {DECISION}, '}}]')
      WHEN 8 THEN concat('[', open, ',', {DECISION}, '}},17]')
      ELSE concat('[', open, ',"importance_score":"0.4"}},', open, ',', {DECISION}, '}}]')
    END AS raw
  FROM shaped),
bare AS (
  SELECT *, CASE WHEN starts_with(trim(raw, E' \\n\\t\\r'), '```')
                 THEN regexp_replace(split_part(trim(raw, E' \\n\\t\\r'), '```', 2), '^json', '')
                 ELSE trim(raw, E' \\n\\t\\r') END AS body
  FROM completions),
lists AS (
  SELECT completion_id, user_id, project_id, CAST(body AS JSON) AS j
  FROM bare WHERE json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body END) = 'ARRAY'),
items AS (
  SELECT completion_id, user_id, project_id, CAST(n - 1 AS INT) AS item_no,
         json_extract(j, '$[' || CAST(n - 1 AS VARCHAR) || ']') AS item
  FROM (SELECT *, unnest(range(1, 1 + CAST(least(5, json_array_length(j)) AS BIGINT))) AS n FROM lists)),
typed AS (
  SELECT completion_id, user_id, project_id, item_no, json_type(item) AS kind,
         json_extract_string(item, '$.content') AS content,
         coalesce(json_extract_string(item, '$.memory_type'), 'general') AS memory_type,
         CASE WHEN json_extract(item, '$.importance_score') IS NULL THEN 0.5e0
              ELSE TRY_CAST(json_extract_string(item, '$.importance_score') AS DOUBLE)
         END AS importance_score
  FROM items),
judged AS (
  SELECT *, CASE WHEN coalesce(content, '') = '' THEN 'content'
                 WHEN memory_type NOT IN ('general', 'preference', 'decision', 'bug_fix', 'pattern')
                 THEN 'memory_type'
                 WHEN importance_score IS NULL OR importance_score NOT BETWEEN 0 AND 1
                 THEN 'importance_score' END AS rejected_because,
         kind <> 'OBJECT' AS fatal,
         bool_or(kind <> 'OBJECT') OVER (PARTITION BY completion_id) AS spoiled
  FROM typed),
facts AS (SELECT * FROM judged WHERE rejected_because IS NULL AND NOT spoiled)"""

CALLS = f"""{PAIRED},
calls AS (
  SELECT e.vec_id AS request_id, e.vec_id % 10 AS user_id, {project('e.vec_id')} AS project_id,
         e.label, coalesce(d.text, concat('call ', CAST(e.vec_id AS VARCHAR))) AS text,
         CASE WHEN label IN (0, 6) THEN 'recall_project_context'
              WHEN label IN (1, 7, 9) THEN 'save_developer_insight'
              WHEN label IN (2, 8) THEN 'find_similar_problems'
              WHEN label IN (3, 5) THEN 'get_memory_health' ELSE 'drop_everything' END AS name,
         label = 1 AND e.vec_id % 7 = 3 AS numeric_insight,
         CASE WHEN label IN (0, 6) THEN 5 WHEN label = 2 THEN 3
              WHEN label = 8 THEN CASE e.vec_id % 6 WHEN 0 THEN 5 WHEN 1 THEN 20 WHEN 2 THEN -17 WHEN 5 THEN 1 END END AS top_k
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id),
judged_calls AS (
  SELECT *, CASE WHEN label = 5 THEN 'arguments are not a JSON object' WHEN label = 4 THEN 'no such tool: drop_everything'
                 WHEN label = 9 THEN 'invalid memory_type' WHEN numeric_insight THEN 'invalid content'
                 WHEN label = 8 AND top_k IS NULL THEN 'invalid top_k' END AS bad_args
  FROM calls),
call_vectors AS (
  SELECT request_id, emb FROM (
    SELECT unnest([vec_id, vec_id + 10]) AS request_id, {mixed('vec_id')} AS emb FROM paired WHERE vec_id // 10 % 2 = 0)
  WHERE request_id % 23 <> 0),
run AS (
  SELECT c.*, v.emb, coalesce(bad_args, CASE WHEN v.emb IS NULL AND name <> 'get_memory_health'
                                             THEN 'no embedding of the text' END) AS error
  FROM judged_calls c LEFT JOIN call_vectors v ON v.request_id = c.request_id),
x3 AS (SELECT request_id AS seq, user_id, project_id, text AS content,
              CASE label WHEN 1 THEN 'decision' ELSE 'pattern' END AS memory_type,
              CASE WHEN label = 7 THEN 0.9e0 ELSE 0.7e0 END AS importance_score, emb
       FROM run WHERE label IN (1, 7) AND error IS NULL)"""

#: Tool calls one after another: what each saw of the inserts and boosts before it.
TOOL_RUN = f"""{X1}, {CALLS}, {ordered_saves()},
inserted AS (SELECT x3.*, -(seq + 1) AS id FROM x3 WHERE seq IN (SELECT seq FROM decisions WHERE action = 'insert')),
boosts AS (SELECT seq, coalesce(id, -(target_seq + 1)) AS id FROM decisions WHERE action = 'reinforce'),
seen AS (
  SELECT id, user_id, project_id, content, memory_type, importance_score, decay_rate, access_count, created_at, last_accessed, emb,
         -1 AS seq FROM x1
  UNION ALL
  SELECT id, user_id, project_id, content, memory_type, importance_score, {rate('memory_type')}, 0, {AS_OF}, {AS_OF}, emb, seq
  FROM inserted),
req AS (SELECT request_id AS qid, user_id, CASE WHEN label = 6 THEN 'p1' WHEN label = 0 THEN project_id END AS project_id,
               top_k, emb FROM run WHERE label IN (0, 6, 2, 8) AND error IS NULL),
pairs AS (
  SELECT q.qid, m.id, {NEAR} AS similarity FROM req q JOIN seen m ON m.user_id = q.user_id AND {IN_PROJECT}
  WHERE m.importance_score > 0 AND m.emb IS NOT NULL AND m.seq < q.qid),
hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS crank FROM pairs)
  WHERE crank <= 20),
moved AS (
  SELECT h.*, m.content, m.memory_type, m.decay_rate,
         CASE WHEN n > 0 THEN least(1e0, m.importance_score + 0.2e0 * n) ELSE m.importance_score END AS importance_score,
         m.access_count + n AS access_count, CASE WHEN n > 0 THEN {AS_OF} ELSE m.last_accessed END AS last_accessed
  FROM (SELECT h.*, (SELECT count(*) FROM boosts b WHERE b.id = h.id AND b.seq < h.qid) AS n FROM hits h) h
  JOIN seen m ON m.id = h.id),
scored AS (
  SELECT qid, id, similarity, crank, content, {current()} AS imp,
         CASE WHEN NOT (qid % 3 = 0 OR memory_type = 'bug_fix') THEN ((qid * 31 + id * 17) % 101) / 100e0 END AS relevance
  FROM moved),
reranked AS (
  SELECT *, CASE WHEN count(relevance) OVER (PARTITION BY qid) > 0 THEN coalesce(relevance, 0e0)
                 ELSE 1e0 / count(*) OVER (PARTITION BY qid) END AS rerank FROM scored),
results AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, crank) AS rank, count(*) OVER (PARTITION BY qid) AS found
  FROM (SELECT *, coalesce(nullif(rerank, 0), similarity) * imp AS score FROM reranked)),
told AS (
  SELECT q.qid, md5(coalesce(string_agg(r.content, '|' ORDER BY r.rank), '')) AS outcome
  FROM req q LEFT JOIN results r ON r.qid = q.qid
    AND r.rank <= CASE WHEN q.top_k < 0 THEN r.found + q.top_k ELSE q.top_k END GROUP BY q.qid),
held AS (
  SELECT c.request_id, s.id, s.memory_type,
         CASE WHEN n > 0 THEN least(1e0, importance_score + 0.2e0 * n) ELSE importance_score END AS importance_score
  FROM run c JOIN seen s ON s.user_id = c.user_id AND s.seq < c.request_id
  LEFT JOIN LATERAL (SELECT count(*) AS n FROM boosts b WHERE b.id = s.id AND b.seq < c.request_id) ON true
  WHERE c.label = 3),
health AS (
  SELECT request_id, concat(count(*), '/', count(*) FILTER (WHERE importance_score < 0.2e0), '/',
         count(*) FILTER (WHERE memory_type = 'decision'), '/', CAST(floor(sum(importance_score) * 100 + 0.5e0) AS BIGINT)) AS outcome
  FROM held GROUP BY request_id)"""

FORGET = f"""
commands AS (
  SELECT vec_id AS command_id, vec_id % 10 AS user_id,
         CASE WHEN label IN (0, 1) THEN vec_id END AS memory_id,
         CASE WHEN label IN (0, 1) THEN 'delete'
              WHEN label = 2 AND vec_id % 10 < 4 THEN 'decay' ELSE 'error' END AS kind
  FROM embeddings),
sweeps AS (
  SELECT command_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY command_id) AS number
  FROM commands WHERE kind = 'decay'),
gone AS (SELECT memory_id, min(command_id) AS gone_at FROM commands WHERE kind = 'delete' GROUP BY memory_id),
rows AS (
  SELECT m.*, g.gone_at, (SELECT count(*) FROM sweeps s WHERE s.user_id = m.user_id AND s.command_id < coalesce(g.gone_at, 9e18)) AS times
  FROM x1 m LEFT JOIN gone g ON g.memory_id = m.id),
steps AS (
  SELECT id, user_id, decay_rate, access_count, last_accessed, gone_at, times, importance_score, 0 AS step, 0 AS fell FROM rows
  UNION ALL
  SELECT id, user_id, decay_rate, access_count, last_accessed, gone_at, times,
         CASE WHEN abs({current()} - importance_score) > 0.001e0 THEN {current()} ELSE importance_score END, step + 1,
         CASE WHEN {current()} < 0.05e0 THEN step + 1 ELSE 0 END
  FROM steps WHERE step < times AND fell = 0),
ended AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY id ORDER BY step DESC) = 1)"""

WINDOWS = f"""
SELECT {stamp("date_trunc('day', ts)")} AS start, user_id, count(*) AS created,
       round(avg(least(1e0, value / 200e0)) + 1e-9, 6) AS avg_importance
FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY
      <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
GROUP BY date_trunc('day', ts), user_id"""

FORGET_AT = f"""CASE WHEN importance_score < 0.05e0 THEN last_accessed
    WHEN {eff()} > 0 AND ln(greatest(importance_score, 1e-9) / 0.05e0) / {eff()} < 1000000
    THEN make_timestamp(CAST(epoch_us(last_accessed)
      + ceil(ln(importance_score / 0.05e0) / {eff()} * 86400000000e0) AS BIGINT)) END"""

INGEST = f"""{X1}, {COMPLETIONS}, known AS (
  SELECT c.text, arg_min(CAST(e.embedding AS DOUBLE[]), e.vec_id) AS emb FROM conversations c
  JOIN embeddings e ON e.vec_id = c.conv_id + c.conv_id % 2 * 5 GROUP BY c.text),
x3 AS (SELECT f.completion_id * 8 + f.item_no AS seq, f.user_id, f.project_id, f.importance_score, k.emb
  FROM facts f JOIN known k ON k.text = f.content), {ordered_saves()}"""

ORACLE: dict[str, str] = {
    "public_scan": f"""WITH {X2} SELECT id, user_id, project_id, content, CAST(NULL AS VARCHAR) AS summary,
        memory_type, round(importance_score, 6) AS importance_score, decay_rate, access_count,
        {stamp('created_at')} AS created_at, {stamp('last_accessed')} AS last_accessed FROM x2""",
    "column_defaults": f"""WITH {X2} SELECT id, user_id,
        CASE WHEN memory_type = 'pattern' THEN 'general' ELSE memory_type END AS memory_type,
        CASE WHEN importance_score = 1 THEN 0.5e0 ELSE round(importance_score, 6) END AS importance_score,
        0.1e0 AS decay_rate, 0 AS access_count, '{{}}' AS metadata,
        {stamp(AS_OF)} AS created_at, {stamp(AS_OF)} AS last_accessed FROM x2""",
    "validate_records": """SELECT event_id AS id, CASE WHEN event_type = 'error' OR props = '' THEN 'content'
        WHEN event_type = 'signup' THEN 'memory_type'
        WHEN value / 100e0 < 0 OR value / 100e0 > 1 THEN 'importance_score' END AS rejected_because
        FROM events""",
    "scope_keys": f"""WITH {X2} SELECT id, concat(CASE WHEN access_count = 1 THEN 'w1:' ELSE '' END,
        CAST(user_id AS VARCHAR), CASE WHEN project_id IS NULL THEN '' ELSE ':' || project_id END) AS scope_key
        FROM x2""",
    "session_ids": """SELECT event_id, CASE WHEN event_type = 'click' AND props <> '' THEN props
        ELSE sha256(concat(CAST(user_id AS VARCHAR), ':', CAST(event_id AS VARCHAR))) END AS session_id
        FROM events""",
    "vector_text": """SELECT vec_id, CAST(len(embedding) AS INT) AS dims,
        round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x, n: x * n)), 6) AS by_place FROM embeddings""",
    "embedding_attach": """WITH known AS (SELECT d.text, arg_min(e.embedding, e.vec_id) AS embedding
          FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.text)
        SELECT d.doc_id, CAST(len(k.embedding) AS INT) AS dims,
          round(list_sum(list_transform(CAST(k.embedding AS DOUBLE[]), lambda x, n: x * n)), 6) AS by_place
        FROM documents d LEFT JOIN known k ON k.text = d.text""",
    "embed_missing": """WITH store AS (SELECT text, -min(doc_id) - 1 AS first FROM documents WHERE doc_id % 3 = 0 GROUP BY text)
        SELECT d.doc_id, CASE WHEN s.text IS NOT NULL THEN CAST(s.first AS DOUBLE)
            WHEN length(d.text) <= 2000 AND contains(d.text, 'e') THEN CAST(length(d.text) AS DOUBLE) END AS first_value,
          CASE WHEN s.text IS NOT NULL THEN -1e0 WHEN length(d.text) <= 2000 AND contains(d.text, 'e')
            THEN CAST(length(d.text) - length(replace(d.text, 'e', '')) AS DOUBLE) END AS second_value,
          CASE WHEN s.text IS NOT NULL OR d.text IS NULL THEN NULL WHEN length(d.text) > 2000 THEN 'ValueError: text too long'
            WHEN NOT contains(d.text, 'e') THEN 'no vector' END AS reason
        FROM documents d LEFT JOIN store s ON s.text = d.text""",
    "missing_vectors": """SELECT d.doc_id % 10 AS user_id, count(*) FILTER (WHERE e.vec_id IS NULL) AS without_vector,
        count(*) AS total FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1""",
    "decay_importance": f"""WITH {X2} SELECT id, memory_type, decay_rate, round({days('last_accessed')}, 6) AS days,
        round({eff()}, 6) AS effective_rate, round({current()}, 6) AS current_importance,
        CAST(floor({current()} * 100 + 0.5e0) AS INT) AS percent, {current()} < 0.05e0 AS should_forget,
        round(least(1e0, importance_score + 0.2e0), 6) AS boosted FROM x2""",
    "decay_sweep": f"WITH {X2}, {SWEPT} SELECT id, user_id, round(cur, 6) AS current_importance, action FROM swept",
    "sweep_counts": f"WITH {X2}, {SWEPT} SELECT action, count(*) AS n FROM swept GROUP BY action",
    "sweep_result_table": f"""WITH {X2}, {SWEPT} SELECT id, user_id,
        round(CASE WHEN action = 'update' THEN cur ELSE importance_score END, 6) AS importance_score,
        {stamp('last_accessed')} AS last_accessed FROM swept WHERE action <> 'forget'""",
    "sweep_capped": f"""WITH {X2}, {SWEPT}, ranked AS (SELECT *, row_number() OVER (
          PARTITION BY user_id ORDER BY importance_score DESC, id) AS r FROM swept)
        SELECT id, user_id, CASE WHEN r <= 25 THEN action ELSE 'keep' END AS action FROM ranked""",
    "sweep_twice": f"""WITH {X2}, {SWEPT}, once AS (SELECT * REPLACE (
          CASE WHEN action = 'update' THEN cur ELSE importance_score END AS importance_score)
          FROM swept WHERE action <> 'forget'),
        again AS (SELECT id, importance_score, {current()} AS now FROM once)
        SELECT id, round(now, 6) AS current_importance, {action('importance_score', 'now')} AS action FROM again""",
    "forgotten_per_user": f"""WITH {X2}, {SWEPT} SELECT user_id,
        count(*) FILTER (WHERE action = 'forget') AS memories_forgotten FROM swept GROUP BY user_id""",
    "forget_times": f"""WITH {X2}, due AS (SELECT id, {FORGET_AT} AS forget_at FROM x2)
        SELECT id, strftime(date_trunc('second', forget_at), '%Y-%m-%d %H:%M:%S') AS forget_at
        FROM due WHERE forget_at <= {AS_OF}""",
    "memory_stats": f"""WITH {X2} SELECT c.c_custkey AS user_id, {stats()
        .replace("count(*) FILTER (WHERE m", "count(m.user_id) FILTER (WHERE m")},
        CASE WHEN avg(m.importance_score) IS NULL THEN '—' END AS no_average
        FROM customer c LEFT JOIN x2 m ON m.user_id = c.c_custkey GROUP BY c.c_custkey""",
    "memory_stats_by_type": f"WITH {X2} SELECT user_id, memory_type, count(*) AS cnt FROM x2 GROUP BY ALL",
    "memories_by_type_map": f"""WITH {X2} SELECT user_id, string_agg(memory_type || '=' || CAST(cnt AS VARCHAR), ','
        ORDER BY memory_type) AS by_type FROM (SELECT user_id, memory_type, count(*) AS cnt FROM x2 GROUP BY ALL)
        GROUP BY user_id""",
    "type_window_count": f"""WITH {X2} SELECT id, user_id, memory_type,
        count(*) OVER (PARTITION BY user_id, memory_type) AS cnt FROM x2""",
    "memory_stats_project": f"""WITH {X2}, keys AS (SELECT DISTINCT user_id, project_id FROM x2),
        per_key AS (SELECT k.user_id, k.project_id, {stats()} FROM keys k JOIN x2 m ON m.user_id = k.user_id
          AND (k.project_id IS NULL OR m.project_id = k.project_id) GROUP BY k.user_id, k.project_id)
        SELECT q.id AS qid, q.user_id, q.project_id, s.* EXCLUDE (user_id, project_id)
        FROM x2 q JOIN per_key s ON s.user_id = q.user_id AND s.project_id IS NOT DISTINCT FROM q.project_id""",
    "memory_health": f"""WITH {X2}, per_user AS (SELECT m.user_id AS u, {stats()},
          nullif(count(*) FILTER (WHERE m.memory_type = 'decision'), 0) AS decisions FROM x2 m GROUP BY m.user_id)
        SELECT e.event_id AS qid, e.user_id, s.* EXCLUDE (u) FROM events e JOIN per_user s ON s.u = e.user_id
        WHERE e.event_type = 'error'""",
    "at_risk": f"""WITH {X2} SELECT id, user_id, round(importance_score, 6) AS importance_score
        FROM x2 WHERE importance_score < 0.2e0""",
    "list_by_user": f"""WITH {X2} SELECT user_id, rank, id, importance_score FROM (SELECT user_id, id,
          round(importance_score, 6) AS importance_score,
          CAST(row_number() OVER (PARTITION BY user_id ORDER BY x2.importance_score DESC, id) AS INTEGER) AS rank FROM x2)
        WHERE rank <= 50""",
    "list_by_user_project": f"""WITH {X2} SELECT user_id, rank, id FROM (SELECT user_id, id,
          CAST(row_number() OVER (PARTITION BY user_id ORDER BY importance_score DESC, id) AS INTEGER) AS rank FROM x2
          WHERE project_id = 'p1') WHERE rank <= 50""",
    "point_lookup": f"""WITH {X1}, {LOG} SELECT id, user_id, memory_type FROM x1
        WHERE id IN (SELECT memory_id FROM log)""",
    "decay_chart_top8": f"""WITH {X1}, c AS (SELECT *, {current()} AS cur FROM x1),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY cur DESC, id) AS INTEGER) AS rank FROM c)
        SELECT user_id, rank, id, CASE WHEN length(content) > 28 THEN substring(content, 1, 28) || '…'
          ELSE content END AS label, memory_type, round(cur, 6) AS current_importance FROM r WHERE rank <= 8""",
    "cosine_similarity": """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),
        CAST(b.embedding AS DOUBLE[])), 6) AS similarity, true AS zero_is_null
        FROM (SELECT *, CASE WHEN vec_id = max(vec_id) OVER (PARTITION BY vec_id % 10)
          THEN min(vec_id) OVER (PARTITION BY vec_id % 10) ELSE vec_id + 10 END AS next_id FROM embeddings) a
        JOIN embeddings b ON b.vec_id = a.next_id""",
    "vector_topk_single": f"""WITH {X1}, q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS emb FROM embeddings
          ORDER BY vec_id LIMIT 1), s AS (SELECT m.id, round(list_cosine_similarity(m.emb, q.emb), 12) AS sim
          FROM x1 m JOIN q ON m.user_id = q.vec_id % 10 WHERE m.importance_score > 0)
        SELECT id, round(sim, 6) AS similarity FROM s ORDER BY sim DESC, id LIMIT 20""",
    "vector_topk": TOPK,
    "vector_topk_blocks": TOPK,
    "vector_topk_all_cells": TOPK,
    "vector_topk_approx": f"""WITH {X1}, {REQ}, {hits()}
        SELECT DISTINCT qid, true AS pairs_exact, true AS recall_reached FROM hits""",
    "vector_topk_cells": f"""WITH {X1}, {REQ}, {hits()}
        SELECT DISTINCT qid, true AS pairs_exact, true AS recall_reached FROM hits""",
    "rerank_answered_empty": f"""WITH {X1}, {REQ}, {hits()}, {found(CALLED, 'true')}
        SELECT {SEARCH_COLUMNS} FROM results WHERE rank <= 10""",
    "rerank_failed": f"""WITH {X1}, {REQ}, {hits()}, {found(CALLED, 'qid % 7 NOT IN (1, 2, 3)')}
        SELECT {SEARCH_COLUMNS} FROM results WHERE rank <= 10""",
    "rerank_scored_batches": f"""WITH {X1}, {REQ}, {hits()}, {found(
          "CASE WHEN length(m.content) % 5 <> 0 THEN ((length(m.content) * 7 + h.qid) % 101) / 100e0 END")}
        SELECT {SEARCH_COLUMNS} FROM results WHERE rank <= 10""",
    "search_answered": f"""WITH {X1}, {REQ}, {hits()}, {found(answered='qid % 4 <> 0')}
        SELECT {SEARCH_COLUMNS} FROM results WHERE rank <= 10""",
    "rerank_score_join": f"""WITH {X1}, {REQ}, {hits()}, s AS (SELECT qid, id, CASE WHEN qid % 3 <> 0 AND id % 7 <> 0
          THEN ((qid * 31 + id * 17) % 101) / 100e0 END AS relevance FROM hits)
        SELECT qid, id, round(CASE WHEN count(relevance) OVER (PARTITION BY qid) > 0 THEN coalesce(relevance, 0)
          ELSE 1e0 / count(*) OVER (PARTITION BY qid) END, 6) AS rerank_score FROM s""",
    "rerank_uniform_fallback": f"""WITH {X1}, {REQ}, {hits()}, {found(None)}
        SELECT {SEARCH_COLUMNS} FROM results WHERE rank <= 10""",
    "two_stage_search": f"{SEARCH} SELECT {SEARCH_COLUMNS} FROM results WHERE rank <= 10",
    "search_by_type": f"""WITH {X1}, {REQ}, {hits(where="m.memory_type IN ('decision', 'pattern')")}, {found()}
        SELECT {SEARCH_COLUMNS} FROM results WHERE rank <= 10""",
    "search_report": f"""{SEARCH} SELECT qid, rank, content, memory_type, round(imp, 6) AS importance_score,
        round(similarity, 6) AS similarity_score, round(rerank, 6) AS rerank_score FROM results WHERE rank <= 5""",
    "recall_project_context": f"""{SEARCH} SELECT qid, CAST(count(*) AS INT) AS n,
        md5(string_agg(content, '|' ORDER BY rank)) AS contents_md5 FROM results WHERE rank <= 5 GROUP BY qid""",
    "find_similar_problems": f"""WITH {X1}, {REQ}, {hits(scope='true')}, {found()}
        SELECT qid, CAST(count(*) AS INT) AS n, md5(string_agg(content, '|' ORDER BY rank)) AS contents_md5
        FROM results WHERE rank <= 3 GROUP BY qid""",
    "context_pack": f"{PACK} SELECT qid, CAST(position AS INT) AS position, id, CAST(cost AS INT) AS cost FROM packed",
    "context_prompt": f"""{PACK}, sections AS (SELECT qid, count(*) AS n, sum(cost) AS tokens,
          string_agg(concat(position, '. [', memory_type, '] ', content), chr(10) ORDER BY position) AS body
          FROM packed GROUP BY qid)
        SELECT q.qid, CAST(coalesce(s.n, 0) AS INT) AS n_used, CAST(coalesce(s.tokens, 0) AS INT) AS tokens_used,
          concat({_text(OPENING)}, CASE WHEN s.body IS NULL THEN '' ELSE
            concat({_text(SECTION_HEAD)}, s.body, {_text(SECTION_TAIL)}) END, {_text(CLOSING)}) AS context
        FROM req q LEFT JOIN sections s ON s.qid = q.qid""",
    "oversize_memories": f"""WITH {X1} SELECT id, user_id, CAST(length(content) // 4 AS INT) AS cost FROM x1
        WHERE length(content) // 4 > 8000""",
    "reinforce_after_search": f"""{SEARCH}, state AS (SELECT * FROM x1),
        rolled AS (SELECT id, count(*) AS recalls, {AS_OF} AS latest FROM results WHERE rank <= 5 GROUP BY id),
        {touched(True)} SELECT {STATE} FROM touched""",
    "user_upsert": f"""SELECT user_id, CASE WHEN bool_or(event_type = 'signup')
          THEN '2024-01-01 00:00:00.000000' ELSE {stamp(AS_OF)} END AS created_at FROM events GROUP BY user_id""",
    "memory_insert": f"""WITH {X1}, {X3} SELECT id, user_id, project_id, memory_type,
          round(importance_score, 6) AS importance_score, decay_rate, access_count,
          {stamp('created_at')} AS created_at FROM x1
        UNION ALL SELECT -(seq + 1), user_id, project_id, memory_type, round(importance_score, 6),
          {rate('memory_type')}, 0, {stamp(AS_OF)} FROM x3""",
    "access_log_rollup": f"WITH {LOG} SELECT id, recalls, {stamp('latest')} AS latest FROM rolled",
    "reinforce": f"WITH {X1}, {LOG}, state AS (SELECT * FROM x1), {touched(True)} SELECT {STATE} FROM touched",
    "access_touch": f"WITH {X1}, {LOG}, state AS (SELECT * FROM x1), {touched(False)} SELECT {STATE} FROM touched",
    "importance_update": f"""WITH {X1} SELECT m.id, round(coalesce(l.quality * 0.75e0, m.importance_score), 6)
        AS importance_score FROM x1 m LEFT JOIN labels l ON l.doc_id = m.id""",
    "delete_by_id": f"""WITH {X1} SELECT id, user_id FROM x1
        WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "delete_by_owner": f"""WITH {X1} SELECT id, user_id FROM x1 m WHERE NOT EXISTS (SELECT 1 FROM labels l
        WHERE l.toxic = 1 AND l.doc_id = m.id AND l.doc_id % 7 = m.user_id)""",
    "cascade_delete": f"""WITH {X2}, gone AS (SELECT user_id FROM events WHERE value > 300)
        SELECT user_id, count(*) AS memories FROM x2 WHERE user_id NOT IN (SELECT user_id FROM gone)
        GROUP BY user_id""",
    "split_state": f"""WITH {X1}, {X3}, {LOG}, state AS (SELECT * FROM x1), {touched(True)},
        whole AS (
          SELECT t.id, m.user_id, coalesce(l.quality * 0.75e0, t.importance_score) AS importance_score, t.access_count,
            t.last_accessed, m.content, m.emb
          FROM touched t JOIN x1 m ON m.id = t.id LEFT JOIN labels l ON l.doc_id = t.id
          WHERE t.id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
          UNION ALL SELECT -(seq + 1), user_id, importance_score, 0, {AS_OF}, content, emb FROM x3)
        SELECT id, user_id, round(importance_score, 6) AS importance_score, access_count,
          {stamp('last_accessed')} AS last_accessed, CAST(length(content) AS INT) AS letters, CAST(len(emb) AS INT) AS dims
        FROM whole""",
    "kept_stats": f"""WITH {X2}, {LOG}, state AS (SELECT * FROM x2), {touched(True)},
        scored AS (SELECT t.id, m.user_id, m.decay_rate, m.created_at, t.access_count, t.last_accessed,
            coalesce(l.quality * 0.75e0, t.importance_score) AS importance_score
          FROM touched t JOIN x2 m ON m.id = t.id LEFT JOIN labels l ON l.doc_id = t.id WHERE t.id % 11 <> 0),
        judged AS (SELECT *, {current()} AS cur, {action('importance_score', current())} AS action FROM scored),
        m AS (SELECT user_id, created_at, CASE WHEN action = 'update' THEN cur ELSE importance_score END AS importance_score
          FROM judged WHERE action <> 'forget')
        SELECT m.user_id, {stats()} FROM m GROUP BY m.user_id""",
    "save_snapshot": f"""WITH {X1}, {X3}, {stored_hits()} SELECT i.seq,
        CASE WHEN s.seq IS NULL THEN 'insert' ELSE 'reinforce' END AS action, s.id,
        round(s.sim, 6) AS similarity FROM x3 i LEFT JOIN stored s ON s.seq = i.seq""",
    "save_snapshot_table": f"""WITH {X1}, {X3}, {stored_hits()}, d AS (SELECT i.seq, s.id,
          CASE WHEN s.seq IS NULL THEN 'insert' ELSE 'reinforce' END AS action
          FROM x3 i LEFT JOIN stored s ON s.seq = i.seq), {after_saves('d', 'NULL')}""",
    "save_ordered": SAVE_ORDERED,
    "save_ordered_rounds": SAVE_ORDERED,
    "save_ordered_table": f"""WITH RECURSIVE {X1}, {X3}, {ordered_saves()},
        {after_saves('decisions', '-(target_seq + 1)')}""",
    "forget_commands": f"""WITH RECURSIVE {X1}, {FORGET}, counts AS (
          SELECT user_id, fell AS number, count(*) AS n FROM ended WHERE fell > 0 GROUP BY user_id, fell)
        SELECT c.command_id, c.user_id, c.kind, CAST(c.memory_id AS VARCHAR) AS memory_id,
          CASE WHEN c.kind = 'decay' THEN coalesce(n.n, 0) END AS forgotten_count,
          CASE WHEN c.kind = 'error' THEN 'Nothing to do: name a memory or ask for a decay run' END AS error
        FROM commands c LEFT JOIN sweeps s ON s.command_id = c.command_id
        LEFT JOIN counts n ON n.user_id = s.user_id AND n.number = s.number""",
    "forget_commands_table": f"""WITH RECURSIVE {X1}, {FORGET} SELECT id, round(importance_score, 6) AS importance_score
        FROM ended WHERE fell = 0 AND gone_at IS NULL""",
    "conversation_render": """SELECT conv_id, count(*) AS n_turns, string_agg(concat(upper(role), ': ', text), chr(10)
        ORDER BY turn) AS conversation FROM conversations GROUP BY conv_id""",
    "conversation_render_user": """SELECT conv_id, count(*) AS n_turns, string_agg(concat(upper(role), ': ', text),
        chr(10) ORDER BY turn) AS conversation FROM conversations WHERE role = 'user' GROUP BY conv_id""",
    "extraction_requests_conversation": f"""SELECT conv_id, concat({_text(INSTRUCTION_PROMPT)}, string_agg(
        concat(upper(role), ': ', text), chr(10) ORDER BY turn)) AS prompt FROM conversations GROUP BY conv_id""",
    "extraction_requests": f"""SELECT conv_id, turn, concat({_text(INSTRUCTION_PROMPT)}, 'USER: ', text) AS prompt
        FROM conversations WHERE role = 'user'""",
    "parse_completions": f"""WITH {COMPLETIONS} SELECT completion_id, user_id, project_id, item_no, content,
        memory_type, round(importance_score, 6) AS importance_score FROM facts""",
    "rejected_items": f"""WITH {COMPLETIONS} SELECT completion_id, item_no, rejected_because, fatal
        FROM judged WHERE rejected_because IS NOT NULL OR fatal""",
    "parse_tool_calls": f"""WITH {CALLS} SELECT request_id, request_id AS sequence, user_id,
        CASE WHEN name = 'find_similar_problems' THEN NULL WHEN label = 6 THEN 'p1' ELSE project_id END AS project_id,
        name AS tool, CASE WHEN label IN (0, 6, 2, 8) THEN text END AS query, top_k,
        CASE WHEN label IN (1, 7, 9) AND NOT numeric_insight THEN text END AS insight,
        CASE label WHEN 1 THEN 'decision' WHEN 7 THEN 'pattern' WHEN 9 THEN 'rumour' END AS memory_type,
        CASE WHEN label IN (1, 9) THEN 0.7e0 WHEN label = 7 THEN 0.9e0 END AS importance_score,
        bad_args AS error FROM judged_calls""",
    "tool_args_check": f"""WITH {CALLS} SELECT request_id, name, label IN (6, 1, 7, 2, 8, 3) AS as_declared
        FROM calls""",
    "daily_maintenance": f"""WITH {X2}, {SWEPT}, after AS (SELECT user_id, created_at,
          CASE WHEN action = 'update' THEN cur ELSE importance_score END AS importance_score
          FROM swept WHERE action <> 'forget'), s AS (SELECT m.user_id AS u, {stats()} FROM after m GROUP BY m.user_id)
        SELECT f.user_id, f.memories_forgotten, coalesce(s.total_memories, 0) AS total_memories, s.avg_importance,
          s.oldest_memory, s.newest_memory, coalesce(s.memories_at_risk, 0) AS memories_at_risk FROM (SELECT user_id,
          count(*) FILTER (WHERE action = 'forget') AS memories_forgotten FROM swept GROUP BY user_id) f
        LEFT JOIN s ON s.u = f.user_id""",
    "ingest_facts": f"WITH RECURSIVE {INGEST} SELECT * FROM decisions",
    "ingest_failed": f"""WITH {COMPLETIONS} SELECT completion_id, item_no, user_id, content, memory_type FROM facts
        WHERE content NOT IN (SELECT c.text FROM conversations c JOIN embeddings e ON e.vec_id = c.conv_id + c.conv_id % 2 * 5)""",
    "ingest_users": f"""WITH RECURSIVE {INGEST} SELECT DISTINCT user_id, CASE WHEN user_id < 5 THEN '2024-01-01 00:00:00.000000'
          ELSE {stamp(AS_OF)} END AS created_at FROM (SELECT user_id FROM x1 WHERE user_id < 5 UNION ALL
          SELECT user_id FROM x3 WHERE seq IN (SELECT seq FROM decisions WHERE action = 'insert'))""",
    "insert_users": f"""WITH {X1}, {X3}, whole AS (SELECT user_id FROM x1 UNION ALL SELECT user_id FROM x3)
        SELECT u.user_id, (SELECT count(*) FROM whole w WHERE w.user_id = u.user_id) AS memories
        FROM (SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 2 = 0 UNION SELECT user_id FROM x3) u""",
    "stream_ingest_table": f"WITH RECURSIVE {INGEST}, {after_saves('decisions', '-(target_seq + 1)')}",
    "stream_access_table": f"""WITH {X1}, {LOG}, state AS (SELECT * FROM x1), {touched(True)}
        SELECT {STATE} FROM touched""",
    "stream_access_replayed": f"""WITH {X1}, {LOG}, state AS (SELECT * FROM x1), {touched(True)}
        SELECT {STATE} FROM touched""",
    "stream_forget_timers": f"""WITH {X2}, due AS (SELECT id, {FORGET_AT} AS forget_at FROM x2)
        SELECT id, strftime(date_trunc('second', make_timestamp(CAST(ceil(epoch_us(forget_at) / 1000e0) AS BIGINT) * 1000)),
          '%Y-%m-%d %H:%M:%S') AS forget_at FROM due
        WHERE ceil(epoch_us(forget_at) / 1000e0) <= (SELECT epoch_ms(max(ts)) FROM events)""",
    "user_panels": f"""WITH {X2}, listed AS (SELECT *, row_number() OVER (PARTITION BY user_id
          ORDER BY importance_score DESC, id) AS r FROM x2),
        chart AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY cur DESC, id) AS INTEGER) AS rank
          FROM (SELECT *, {current()} AS cur FROM listed WHERE r <= 50)),
        s AS (SELECT user_id, count(*) AS total_memories,
          count(*) FILTER (WHERE importance_score < 0.2e0) AS memories_at_risk FROM x2 GROUP BY user_id)
        SELECT c.user_id, c.rank, c.id, c.content AS label, round(c.cur, 6) AS current_importance,
          s.total_memories, s.memories_at_risk FROM chart c JOIN s ON s.user_id = c.user_id WHERE rank <= 8""",
    "run_tool_calls": f"""WITH RECURSIVE {TOOL_RUN}
        SELECT c.request_id, c.name AS tool, coalesce(c.error, t.outcome, h.outcome,
          concat(d.action, ' ', coalesce(d.id, -(coalesce(d.target_seq, d.seq) + 1)))) AS outcome
        FROM run c LEFT JOIN told t ON t.qid = c.request_id LEFT JOIN decisions d ON d.seq = c.request_id
        LEFT JOIN health h ON h.request_id = c.request_id""",
    "run_tool_calls_table": f"""WITH RECURSIVE {TOOL_RUN},
        state AS (SELECT id, importance_score, access_count, last_accessed FROM seen),
        rolled AS (SELECT id, count(*) AS recalls, {AS_OF} AS latest FROM boosts GROUP BY id),
        {touched(True)} SELECT {STATE} FROM touched""",
    "run_tool_calls_users": f"""WITH RECURSIVE {TOOL_RUN} SELECT DISTINCT user_id FROM (
        SELECT user_id FROM x1 WHERE user_id < 5 UNION ALL SELECT user_id FROM inserted)""",
    "stream_user_stats": f"WITH {X2} SELECT m.user_id, {stats()} FROM x2 m GROUP BY m.user_id",
    "stream_access_counts": f"WITH {LOG} SELECT id, recalls, {stamp('latest')} AS latest FROM rolled",
    "stream_windowed_stats": WINDOWS,
}
