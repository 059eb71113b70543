"""DuckDB SQL fragments for the text functions, as used by the oracles. RE2's \\b is ASCII, as the results want it."""

from __future__ import annotations

SPACE = "\\x09-\\x0D\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
UUID = "(?i)\\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\b"
STAMP = "[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?"
MASKS = (
    (STAMP, "<ts>"),
    ("\\b[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?\\b", "<time>"),
    (UUID, "<uuid>"),
    ("(?i)\\b[0-9a-f]{7,64}\\b", "<hex>"),
    ("(?i)\\b[0-9]+(\\.[0-9]+)?[ \\t\\x{A0}]?(ms|us|[\\x{B5}\\x{3BC}\\x{39C}]s|ns|s|m|h|%|[KMGT]i?B)?\\b", "<n>"),
)
IMPORTANT = (
    "(?i)\\b([0-9A-Za-z_]*(error|exception)s?|err|warn(ing)?s?|fail(s|ed|ure|ures)?|panic(s|ked)?|fatal|critical|traceback|denied|refused|timeouts?|timed.?out"
    "|assert(s|ed|ion|ions)?|segfault(s|ed)?)\\b"
)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def trim(x: str) -> str:
    return sub(sub(x, f"^[{SPACE}]+", ""), f"[{SPACE}]+$", "")


def important(x: str) -> str:
    return f"regexp_matches({x}, {lit(IMPORTANT)})"


def mask(x: str) -> str:
    out = x
    for pattern, name in MASKS:
        out = sub(out, pattern, name)
    return out


def template(x: str) -> str:
    return f"array_to_string([CASE WHEN regexp_matches(w, '^[A-Za-z]+$') THEN w ELSE '<v>' END FOR w IN string_split_regex({x}, {lit(f'[{SPACE}]+')})], ' ')"


def tokens(x: str) -> str:
    gone = lambda c: f"length({x}) - length(regexp_replace({x}, '[{c}]', '', 'g'))"
    word = f"coalesce(list_sum([CASE WHEN length(r) <= 14 AND regexp_matches(r, '[aeiouyAEIOUY]') THEN length(r) ELSE 0 END FOR r IN regexp_extract_all({x}, '[A-Za-z]+')]), 0)"
    letters, digits, space = gone("A-Za-z"), gone("0-9"), gone(" \\t\\n\\r")
    return f"CAST((({word}) * 161 + (({letters}) - ({word})) * 1501 + ({digits}) * 807 + ({space}) * 428 + (length({x}) - ({letters}) - ({digits}) - ({space})) * 690 + 500) // 1000 AS BIGINT)"


def saved(a: str, b: str) -> str:
    return f"CAST(CASE WHEN ({a}) = 0 THEN 0 ELSE sign(({a}) - ({b})) * ((abs(({a}) - ({b})) * 200 + ({a})) // (({a}) * 2)) END AS BIGINT)"


#: Events as log lines of 50 documents: doc_id, pos, line.
LOG = """log AS (SELECT CAST(user_id % 50 AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) - 1 AS BIGINT) AS pos,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ' user=' || user_id || ' value=' || CAST(floor(value * 100) AS BIGINT) AS line FROM events)"""

PREPARED = f"rows0 AS (SELECT doc_id, pos, line, {mask('line')} AS masked, {important('line')} AS imp FROM log)"

_KS = range(1, 9)
#: Runs of repeated blocks: best at each line, then those met in walking down.
RUNS = f"""e AS (SELECT *, {', '.join(f'coalesce(lead(masked, {k}) OVER w = masked AND NOT lead(imp, {k}) OVER w, false) AS e{k}' for k in _KS)} FROM rows0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
l AS (SELECT doc_id, pos, coalesce(min(CASE WHEN imp THEN pos END) OVER f - pos, 1000000000) AS clear, {', '.join(f'coalesce(min(CASE WHEN NOT e{k} THEN pos END) OVER f - pos, 0) AS l{k}' for k in _KS)}
  FROM e WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS ({' UNION ALL '.join(f'SELECT doc_id, pos, {k} AS k, l{k} // {k} + 1 AS r FROM l WHERE clear >= {k} AND l{k} // {k} + 1 >= 3' for k in _KS)}),
best AS (SELECT doc_id, pos, k, r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY k * (r - 1) DESC, k) AS n FROM c) WHERE n = 1),
walk(doc_id, pos, k, r) AS (
  SELECT doc_id, pos, k, r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM best) WHERE n = 1
  UNION ALL
  SELECT doc_id, pos, k, r FROM (SELECT b.*, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.pos) AS n FROM walk JOIN best b ON b.doc_id = walk.doc_id AND b.pos >= walk.pos + walk.k * walk.r) WHERE n = 1)"""

COLLAPSED = """rows1 AS (
  SELECT doc_id, pos * 2 AS pos, line, masked, imp FROM rows0 x WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.doc_id = x.doc_id AND x.pos >= w.pos + w.k AND x.pos < w.pos + w.k * w.r)
  UNION ALL
  SELECT doc_id, (pos + k - 1) * 2 + 1, '   [×' || r || ' similar' || CASE WHEN k = 1 THEN ']' ELSE ' ' || k || '-line blocks]' END, NULL, false FROM walk)"""

TOLD = f"""p AS (SELECT *, imp OR masked IS NULL OR starts_with({trim('line')}, '[×') OR length({trim('line')}) < 4 AS passed FROM rows1),
k1 AS (SELECT *, CASE WHEN NOT passed THEN row_number() OVER (PARTITION BY doc_id, passed, CASE WHEN NOT passed THEN masked END ORDER BY pos) END AS rn,
  count(*) OVER (PARTITION BY doc_id, passed, CASE WHEN NOT passed THEN masked END) AS n FROM p),
k2 AS (SELECT *, coalesce(rn = 1, false) AS is_first, CASE WHEN rn = 1 THEN {template('masked')} END AS tpl FROM k1),
told AS (SELECT *, row_number() OVER (PARTITION BY doc_id, is_first, tpl ORDER BY pos) AS crn, count(*) OVER (PARTITION BY doc_id, is_first, tpl) AS cn FROM k2),
counts AS (SELECT doc_id, count(*) FILTER (masked IS NULL) AS collapsed_runs, count(*) FILTER (imp) AS important_kept, count(*) FILTER (NOT passed AND rn > 2) AS suppressed, count(*) FILTER (is_first AND crn > 3) AS template_suppressed FROM told GROUP BY doc_id),
reps AS (SELECT doc_id, n AS cnt, 'exact' AS kind, left({trim('line')}, 160) AS exemplar, pos FROM told WHERE is_first AND n > 2
  UNION ALL SELECT doc_id, cn, 'template', left({trim('line')}, 160), pos FROM told WHERE is_first AND crn = 1 AND cn > 3),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, kind, pos) AS rank FROM reps) WHERE rank <= 40)"""

OUT = f"""out0 AS (
  SELECT doc_id, 0 AS part, pos, line, imp FROM told WHERE passed OR (is_first AND crn <= 3) OR (NOT is_first AND rn <= 2)
  UNION ALL SELECT doc_id, 1, 0, line, {important('line')} FROM (SELECT doc_id, '── ' || (suppressed + template_suppressed) || ' repeated lines suppressed (' || suppressed || ' exact ×N, ' || template_suppressed || ' same-template; first occurrences kept above) ──' AS line FROM counts WHERE suppressed + template_suppressed > 0)
  UNION ALL SELECT doc_id, 2, rank, line, {important('line')} FROM (SELECT doc_id, rank, '  ×' || cnt || CASE WHEN kind = 'template' THEN ' (template)' ELSE '' END || '  ' || exemplar AS line FROM top SEMI JOIN (SELECT doc_id FROM counts WHERE suppressed + template_suppressed > 0) s USING (doc_id)))"""

DISTILLED = f"WITH RECURSIVE {LOG}, {PREPARED}, {RUNS}, {COLLAPSED}, {TOLD}, {OUT}"


def sliced(query: str) -> str:
    return f"""h AS (SELECT *, max(CAST(imp OR regexp_matches(line, {lit('(?i)' + query)}) AS INT)) OVER (PARTITION BY doc_id ORDER BY part, pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS keep FROM out0),
g AS (SELECT *, sum(CAST(keep AS INT)) OVER (PARTITION BY doc_id ORDER BY part, pos) AS gap FROM h),
out1 AS (SELECT doc_id, part, pos, line FROM g WHERE keep UNION ALL
  SELECT doc_id, min(part * 1000000000 + pos) // 1000000000, min(part * 1000000000 + pos) % 1000000000, '… ' || count(*) || ' lines omitted' FROM g WHERE NOT keep GROUP BY doc_id, gap)"""


def distilled(source: str) -> str:
    return f"""t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY part, pos) AS distilled, count(*) AS out_lines FROM {source} GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS orig_lines, CAST(strlen(string_agg(line, chr(10) ORDER BY pos)) AS BIGINT) AS orig_bytes FROM log GROUP BY doc_id)
SELECT doc_id, orig_lines, orig_bytes, out_lines, distilled, collapsed_runs, important_kept, suppressed, template_suppressed, CAST(strlen(distilled) AS BIGINT) AS out_bytes,
  {saved('orig_bytes', 'strlen(distilled)')} AS saved_pct FROM b JOIN t USING (doc_id) JOIN counts USING (doc_id)"""
