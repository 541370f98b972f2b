"""DuckDB SQL of the queries that have an oracle."""

from inkwell.operators.features import FEATURES
from inkwell.sources.pen import region_rows

POINTS = """
WITH e AS (
  SELECT user_id, epoch_us(ts) // 1000 AS t_ms, day(ts) AS dom, event_type, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn
  FROM events),
r AS (
  SELECT concat('s-', user_id) AS session_id, concat('u-', user_id) AS participant_id, concat('seg-', rn // 40) AS task_segment_id,
         CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat('pen-', user_id % 3) END AS device_id,
         CASE WHEN rn % 43 = 42 THEN NULL WHEN rn % 41 = 40 THEN 'page-unknown' ELSE concat('page-', dom // 10) END AS page_id,
         concat('pt-', user_id, '-', CASE WHEN rn % 23 = 22 THEN rn - 1 ELSE rn END) AS point_id,
         CAST(rn AS BIGINT) AS raw_order,
         CAST(CASE WHEN rn % 29 = 28 THEN rn - 2 ELSE rn END AS BIGINT) AS sequence,
         CASE WHEN rn % 31 = 30 THEN NULL ELSE t_ms END AS timestamp_ms,
         CASE WHEN rn % 37 = 36 THEN NULL ELSE value END AS x_raw, k AS y_raw,
         CASE WHEN rn % 19 = 18 THEN NULL ELSE value / 500 END AS xn, CASE WHEN rn % 19 = 18 THEN NULL ELSE k / 400 END AS yn,
         CASE event_type WHEN 'signup' THEN 'DOWN' WHEN 'purchase' THEN 'UP' WHEN 'error' THEN 'UNKNOWN' ELSE 'MOVE' END AS pen_state
  FROM e),
q AS (
  SELECT *, count(*) OVER (PARTITION BY session_id, point_id) AS copies,
         last_value(sequence IGNORE NULLS) OVER b AS pseq, last_value(timestamp_ms IGNORE NULLS) OVER b AS ptime,
         coalesce(xn NOT BETWEEN 0 AND 1 OR yn NOT BETWEEN 0 AND 1, false) OR (xn IS NULL) <> (yn IS NULL) AS bad
  FROM r WINDOW b AS (PARTITION BY session_id, page_id ORDER BY raw_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (
  SELECT session_id, participant_id, task_segment_id, device_id, page_id, point_id, raw_order, sequence, timestamp_ms, x_raw, y_raw, pen_state,
         CASE WHEN NOT bad THEN xn END AS x_norm, CASE WHEN NOT bad THEN yn END AS y_norm,
         list_filter([CASE WHEN x_raw IS NULL OR y_raw IS NULL THEN 'INVALID_COORDINATE' END, CASE WHEN timestamp_ms IS NULL THEN 'MISSING_TIMESTAMP' END,
           CASE WHEN page_id IS NULL THEN 'MISSING_PAGE' END, CASE WHEN copies > 1 THEN 'DUPLICATE_POINT' END,
           CASE WHEN coalesce(sequence < pseq, false) OR coalesce(timestamp_ms < ptime, false) THEN 'OUT_OF_ORDER' END,
           CASE WHEN bad THEN 'INVALID_NORM_COORDINATE' END], lambda x: x IS NOT NULL) AS flags
  FROM q)"""

STROKES = POINTS + """,
l AS (
  SELECT *, lag(raw_order) OVER w AS po, lag(participant_id) OVER w AS pp, lag(task_segment_id) OVER w AS ps, lag(page_id) OVER w AS pg, lag(device_id) OVER w AS pd,
         lag(timestamp_ms) OVER w AS pt, lag(x_norm) OVER w AS px, lag(y_norm) OVER w AS py, lag(pen_state) OVER w AS pen
  FROM p WINDOW w AS (PARTITION BY session_id ORDER BY raw_order)),
b AS (
  SELECT *, sqrt((x_norm - px) * (x_norm - px) + (y_norm - py) * (y_norm - py)) AS step,
         po IS NULL OR participant_id IS DISTINCT FROM pp OR task_segment_id IS DISTINCT FROM ps OR page_id IS DISTINCT FROM pg OR device_id IS DISTINCT FROM pd
           OR coalesce(abs(timestamp_ms - pt) > 86400000, false)
           OR coalesce(sqrt((x_norm - px) * (x_norm - px) + (y_norm - py) * (y_norm - py)) > 0.3, false)
           OR coalesce(pen_state = 'DOWN' AND pen = 'UP', false) AS starts
  FROM l),
i AS (SELECT *, sum(starts::INT) OVER (PARTITION BY session_id ORDER BY raw_order) AS ix, CASE WHEN NOT starts THEN step END AS inner_step FROM b),
s AS (
  SELECT session_id, ix, printf('stroke-%04d', CAST(ix AS BIGINT)) AS stroke_id, any_value(page_id) AS page_id, any_value(participant_id) AS participant_id, any_value(task_segment_id) AS task_segment_id,
         count(*) AS n_points, min(timestamp_ms) AS start_time_ms, max(timestamp_ms) AS end_time_ms, bool_or(timestamp_ms IS NULL) AS untimed,
         bool_or(x_norm IS NOT NULL) AS has_norm, sum(inner_step) AS length, list_distinct(flatten(list(flags))) AS flags,
         bool_and(x_norm IS NOT NULL OR x_raw IS NULL) AND bool_or(x_norm IS NOT NULL) AS all_norm, bool_and(x_raw IS NOT NULL OR x_norm IS NULL) AND bool_or(x_raw IS NOT NULL) AS all_raw,
         min(x_norm) AS nx1, max(x_norm) AS nx2, min(y_norm) AS ny1, max(y_norm) AS ny2,
         min(x_raw) FILTER (x_raw IS NOT NULL) AS rx1, max(x_raw) AS rx2, min(y_raw) FILTER (x_raw IS NOT NULL) AS ry1, max(y_raw) FILTER (x_raw IS NOT NULL) AS ry2,
         string_agg(point_id, ',' ORDER BY raw_order) AS by_input, string_agg(point_id, ',' ORDER BY timestamp_ms, sequence, raw_order) AS by_time
  FROM i GROUP BY session_id, ix)"""

def _distinct(flags: str) -> str:
    """A list's different values in order of first sight."""
    return f"list_filter({flags}, lambda x, i: list_position({flags}, x) = i)"


def _regions() -> str:
    """Regions and their sides as inline tables."""
    rows = region_rows()
    regions = ", ".join(f"('{r}', '{p}', '{q}', {n})" for r, p, q, n, _ in rows)
    sides = ", ".join(f"('{r}', {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for r, _, _, _, v in rows for a, b in zip(v, v[1:] + v[:1], strict=True))
    return f"reg(region_id, page_id, question_id, priority) AS (VALUES {regions}), side(region_id, sx, sy, ex, ey) AS (VALUES {sides})"


STROKE_FLAGS = """list_filter([CASE WHEN list_has_any(flags, ['INVALID_COORDINATE', 'MISSING_TIMESTAMP', 'MISSING_PAGE', 'MISSING_SEQUENCE']) THEN 'INCOMPLETE' END,
  CASE WHEN list_has_any(flags, ['DUPLICATE_POINT', 'OUT_OF_ORDER']) THEN 'PARTIAL_DATA' END], lambda x: x IS NOT NULL)"""

# Convex regions are clipped side ey side: a segment is inside between the last side that it enters ey and the first that it leaves ey.
MAPPED = STROKES + f""",
x AS (
  SELECT i.session_id, i.ix, i.raw_order, i.point_id,
         row_number() OVER (PARTITION BY i.session_id, i.ix ORDER BY CASE WHEN s.untimed THEN 0 ELSE i.timestamp_ms END, CASE WHEN s.untimed THEN 0 ELSE i.sequence END, i.raw_order) AS k,
         last_value(CASE WHEN y_norm IS NOT NULL THEN x_norm END) OVER d AS fx, last_value(CASE WHEN x_norm IS NOT NULL THEN y_norm END) OVER d AS fy,
         last_value(CASE WHEN y_raw IS NOT NULL THEN x_raw END) OVER d AS gx, last_value(CASE WHEN x_raw IS NOT NULL THEN y_raw END) OVER d AS gy,
         last_value(i.timestamp_ms) OVER d AS ft, last_value(i.flags) OVER d AS ff
  FROM i JOIN s ON s.session_id = i.session_id AND s.ix = i.ix
  WINDOW d AS (PARTITION BY i.session_id, i.point_id ORDER BY i.raw_order ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, lead(fx) OVER w AS tx, lead(fy) OVER w AS ty, lead(gx) OVER w AS ux, lead(gy) OVER w AS uy, lead(ft) OVER w AS tt FROM x WINDOW w AS (PARTITION BY session_id, ix ORDER BY k)),
{_regions()},
line AS (
  SELECT session_id, ix, count(*) AS n, bool_and(fx IS NOT NULL) AS whole_norm, bool_and(gx IS NOT NULL) AS whole_raw,
         sum(sqrt((tx - fx) * (tx - fx) + (ty - fy) * (ty - fy))) AS norm_length, sum(sqrt((ux - gx) * (ux - gx) + (uy - gy) * (uy - gy))) AS raw_length,
         min(fx) AS fx1, max(fx) AS fx2, min(fy) AS fy1, max(fy) AS fy2, min(gx) AS gx1, max(gx) AS gx2, min(gy) AS gy1, max(gy) AS gy2,
         bool_and(ft IS NOT NULL) AS timed, sum(greatest(0, tt - ft - 21600000)) AS idle, list_distinct(flatten(list(ff))) AS point_flags
  FROM g GROUP BY session_id, ix),
c AS (
  SELECT g.session_id, g.ix, g.k, r.region_id, sqrt((tx - fx) * (tx - fx) + (ty - fy) * (ty - fy)) AS len,
         max(CASE WHEN c1 > c0 THEN -c0 / (c1 - c0) ELSE 0 END) AS t0, min(CASE WHEN c1 < c0 THEN c0 / (c0 - c1) ELSE 1 END) AS t1, bool_and(c1 <> c0 OR c0 >= -1e-9) AS ok
  FROM g JOIN s ON s.session_id = g.session_id AND s.ix = g.ix JOIN reg r ON r.page_id = s.page_id JOIN side USING (region_id),
       LATERAL (SELECT (ex - sx) * (fy - sy) - (ey - sy) * (fx - sx) AS c0, (ex - sx) * (ty - sy) - (ey - sy) * (tx - sx) AS c1)
  WHERE fx IS NOT NULL AND tx IS NOT NULL GROUP BY ALL),
long AS (SELECT session_id, ix, region_id, sum(len) AS total, sum(CASE WHEN ok THEN greatest(0, least(1, t1) - greatest(0, t0)) * len ELSE 0 END) AS inside FROM c GROUP BY session_id, ix, region_id),
dots AS (
  SELECT session_id, ix, region_id, avg(CASE WHEN least_side >= -1e-9 THEN 1.0 ELSE 0.0 END) AS share
  FROM (SELECT g.session_id, g.ix, g.k, r.region_id, min((ex - sx) * (fy - sy) - (ey - sy) * (fx - sx)) AS least_side
        FROM g JOIN s ON s.session_id = g.session_id AND s.ix = g.ix JOIN reg r ON r.page_id = s.page_id JOIN side USING (region_id) WHERE fx IS NOT NULL GROUP BY ALL)
  GROUP BY session_id, ix, region_id),
cov AS (
  SELECT dots.session_id, dots.ix, region_id, question_id, priority, CASE WHEN total > 1e-12 THEN least(1.0, inside / total) ELSE share END AS share, CASE WHEN total > 1e-12 THEN 'ARC_LENGTH' ELSE 'POINT_FALLBACK' END AS method
  FROM dots LEFT JOIN long USING (session_id, ix, region_id) JOIN reg USING (region_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY session_id, ix ORDER BY share DESC, priority DESC, region_id DESC) AS pos FROM cov WHERE share >= 0.5),
v AS (
  SELECT s.*, {STROKE_FLAGS} AS stroke_flags, (SELECT any_value(device_id) FROM i WHERE i.session_id = s.session_id AND i.ix = s.ix) AS device_id FROM s),
m AS (
  SELECT v.session_id, v.ix, v.stroke_id, v.participant_id, v.task_segment_id, v.page_id, v.device_id, v.start_time_ms, v.end_time_ms, v.stroke_flags, v.all_norm, v.nx1, v.nx2, v.ny1, v.ny2, v.by_input,
         line.n, whole_norm, whole_raw, norm_length, raw_length, fx1, fx2, fy1, fy2, gx1, gx2, gy1, gy2, timed, idle, point_flags,
         CASE WHEN bad OR a.region_id IS NULL THEN 'UNKNOWN' WHEN unsure THEN 'AMBIGUOUS' ELSE 'MAPPED' END AS status,
         CASE WHEN NOT bad AND NOT unsure THEN a.question_id END AS question_id, CASE WHEN NOT bad AND NOT unsure THEN a.region_id END AS region_id,
         CASE WHEN NOT bad AND NOT unsure THEN a.share END AS confidence, CASE WHEN NOT bad AND NOT unsure THEN coalesce(a.method, 'UNKNOWN') ELSE 'UNKNOWN' END AS method,
         CASE WHEN bad THEN list_concat(v.stroke_flags, CASE WHEN v.page_id IS NULL THEN ['MISSING_PAGE'] ELSE [] END)
              WHEN a.region_id IS NULL THEN [CASE WHEN EXISTS (SELECT 1 FROM cov WHERE cov.session_id = v.session_id AND cov.ix = v.ix) THEN 'NO_REGION_MATCH' ELSE 'NO_NORMALIZED_COORDINATES' END]
              WHEN unsure THEN ['AMBIGUOUS_REGION'] ELSE v.stroke_flags END AS flags
  FROM v JOIN line ON line.session_id = v.session_id AND line.ix = v.ix
  LEFT JOIN best a ON a.session_id = v.session_id AND a.ix = v.ix AND a.pos = 1 LEFT JOIN best b ON b.session_id = v.session_id AND b.ix = v.ix AND b.pos = 2,
  LATERAL (SELECT list_contains(v.stroke_flags, 'PARTIAL_DATA') OR v.page_id IS NULL AS bad, coalesce(abs(a.share - b.share) <= 0.02 AND a.priority = b.priority, false) AS unsure))"""

EVENTS = MAPPED + f""",
k0 AS (
  SELECT *, status = 'MAPPED' AND question_id IS NOT NULL AS mapped,
         n >= 2 AND ((whole_norm AND coalesce(norm_length, 0) > 1e-12) OR (whole_raw AND coalesce(raw_length, 0) > 1e-12)) AS writes,
         coalesce(upper(trim(page_id)) NOT IN ('UNKNOWN', 'PAGE_UNKNOWN', 'PAGE-UNKNOWN'), false) AS known,
         CASE WHEN whole_norm THEN 'norm' WHEN whole_raw THEN 'raw' END AS space, CASE WHEN whole_norm THEN 'norm' WHEN whole_raw THEN coalesce('device:' || device_id, 'unknown') END AS domain,
         CASE WHEN whole_norm THEN fx1 ELSE gx1 END AS x1, CASE WHEN whole_norm THEN fx2 ELSE gx2 END AS x2, CASE WHEN whole_norm THEN fy1 ELSE gy1 END AS y1, CASE WHEN whole_norm THEN fy2 ELSE gy2 END AS y2,
         row_number() OVER (PARTITION BY session_id, participant_id, task_segment_id ORDER BY start_time_ms IS NULL, coalesce(start_time_ms, 0), stroke_id) AS pl
  FROM m),
k1 AS (
  SELECT *, last_value(CASE WHEN known THEN page_id END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was,
         coalesce(lag(mapped) OVER w, false) AS active, lag(stroke_id) OVER w AS a_stroke, lag(question_id) OVER w AS a_question, lag(page_id) OVER w AS a_page, lag(end_time_ms) OVER w AS a_end,
         lag(flags) OVER w AS a_flags, lag(task_segment_id) OVER w AS a_segment, lag(by_input) OVER w AS a_points, lead(stroke_id) OVER w IS NULL AS ends,
         row_number() OVER (PARTITION BY session_id, participant_id, task_segment_id, mapped, question_id ORDER BY pl) > 1 AS seen,
         mapped AND space IS NOT NULL AND page_id IS NOT NULL AND NOT (space = 'raw' AND domain = 'unknown') AS traced
  FROM k0 WINDOW w AS (PARTITION BY session_id, participant_id, task_segment_id ORDER BY pl)),
ov AS (
  SELECT DISTINCT b.session_id, b.ix
  FROM k1 b JOIN k1 a ON a.session_id = b.session_id AND a.participant_id IS NOT DISTINCT FROM b.participant_id AND a.task_segment_id IS NOT DISTINCT FROM b.task_segment_id AND a.question_id = b.question_id
       AND a.page_id = b.page_id AND a.space = b.space AND a.domain = b.domain AND a.pl < b.pl AND a.traced AND b.traced AND a.writes,
       LATERAL (SELECT greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS both_),
       LATERAL (SELECT (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - both_ AS either)
  WHERE CASE WHEN either <= 1e-12 THEN CASE WHEN a.x1 = b.x1 AND a.x2 = b.x2 AND a.y1 = b.y1 AND a.y2 = b.y2 THEN 1.0 ELSE 0.0 END ELSE both_ / either END >= 0.1),
k2 AS (
  SELECT k1.*, ov.ix IS NOT NULL AS laps, coalesce(start_time_ms - CASE WHEN active THEN a_end END >= 43200000, false) AS paused, coalesce(known AND page_id <> was, false) AS changed,
         active AND a_question = question_id AND NOT coalesce(known AND page_id <> was, false) AS again
  FROM k1 LEFT JOIN ov ON ov.session_id = k1.session_id AND ov.ix = k1.ix),
arrival AS (SELECT *, CASE WHEN seen AND (NOT active OR a_question <> question_id OR changed) THEN 'RETURN' ELSE 'QUESTION_VISIT' END AS kind FROM k2),
raw_events AS (
  SELECT arrival.*, z.e AS e FROM arrival, LATERAL (SELECT unnest([
    {{'c': changed, 'k': 1, 'r': 0, 't': 'PAGE_CHANGE', 'own': true, 'q': NULL, 'p': NULL, 'f': NULL, 'at': NULL, 'why': was || '>' || page_id}},
    {{'c': writes, 'k': 2, 'r': 1, 't': 'WRITING', 'own': true, 'q': CASE WHEN mapped THEN question_id END, 'p': NULL, 'f': NULL, 'at': NULL, 'why': NULL}},
    {{'c': NOT mapped AND active, 'k': 3, 'r': 2, 't': 'QUESTION_LEAVE', 'own': false, 'q': a_question, 'p': NULL, 'f': NULL, 'at': 'end', 'why': 'mapping_unavailable'}},
    {{'c': NOT mapped, 'k': 4, 'r': 5, 't': 'UNKNOWN', 'own': true, 'q': 'UNKNOWN', 'p': NULL, 'f': NULL, 'at': NULL, 'why': status}},
    {{'c': mapped AND NOT active, 'k': 5, 'r': 3, 't': kind, 'own': true, 'q': question_id, 'p': NULL, 'f': NULL, 'at': NULL, 'why': NULL}},
    {{'c': mapped AND again AND paused AND laps, 'k': 6, 'r': 4, 't': 'REVISION_CANDIDATE', 'own': true, 'q': question_id, 'p': NULL, 'f': NULL, 'at': NULL, 'why': 'prior_ink_pause_or_revisit_overlap'}},
    {{'c': mapped AND active AND NOT again, 'k': 7, 'r': 2, 't': 'QUESTION_LEAVE', 'own': false, 'q': a_question, 'p': NULL, 'f': question_id, 'at': 'end', 'why': NULL}},
    {{'c': mapped AND active AND NOT again, 'k': 8, 'r': 3, 't': kind, 'own': true, 'q': question_id, 'p': a_question, 'f': NULL, 'at': NULL, 'why': NULL}},
    {{'c': mapped AND active AND NOT again AND laps, 'k': 9, 'r': 4, 't': 'REVISION_CANDIDATE', 'own': true, 'q': question_id, 'p': NULL, 'f': NULL, 'at': NULL, 'why': 'reentry_overlap'}},
    {{'c': ends AND coalesce(1706659200000 - end_time_ms >= 259200000, false), 'k': 10, 'r': 6, 't': 'PROCESS_END', 'own': true, 'q': CASE WHEN mapped THEN question_id END, 'p': NULL, 'f': NULL, 'at': 'end', 'why': 'session_timeout'}}
  ]) AS e) z WHERE z.e.c),
e1 AS (
  SELECT session_id, participant_id, e.t AS event_type, e.q AS question_id, e.p AS previous_question_id, e.f AS next_question_id, e.why AS reason,
         CASE WHEN e.own THEN page_id ELSE a_page END AS page_id, CASE WHEN e.own THEN stroke_id ELSE a_stroke END AS stroke_ref, CASE WHEN e.own THEN by_input ELSE a_points END AS points,
         CASE WHEN e.own THEN task_segment_id ELSE a_segment END AS task_segment_id, CASE WHEN e.own THEN status ELSE 'MAPPED' END AS source_status,
         CASE WHEN e.at IS NULL THEN start_time_ms WHEN e.own THEN end_time_ms ELSE a_end END AS start_ms, CASE WHEN e.own THEN end_time_ms ELSE a_end END AS end_ms,
         list_concat(CASE WHEN e.own THEN flags ELSE a_flags END, CASE WHEN e.t = 'UNKNOWN' AND len(flags) = 0 THEN ['UNKNOWN_MAPPING'] ELSE [] END) AS own_flags,
         row_number() OVER (PARTITION BY session_id ORDER BY start_time_ms IS NULL, coalesce(start_time_ms, 0), coalesce(participant_id, '__unknown_participant__'), coalesce(task_segment_id, '__unknown_task_segment__'), stroke_id, e.r, e.k) - 1 AS sequence
  FROM raw_events),
ev AS (
  SELECT *, list_concat(own_flags, CASE WHEN (start_ms IS NULL OR end_ms IS NULL) AND NOT list_contains(own_flags, 'TIME_UNAVAILABLE') THEN ['TIME_UNAVAILABLE'] ELSE [] END) AS flags,
         printf('%s:event:%04d', session_id, CAST(sequence AS BIGINT)) AS event_id FROM e1),
events_ AS (SELECT *, CASE WHEN len(flags) > 0 OR source_status <> 'MAPPED' THEN 'DEGRADED' ELSE 'VALID' END AS quality_status FROM ev)"""

EPISODES = MAPPED + """,
h0 AS (
  SELECT *, status = 'MAPPED' AS mapped, CASE WHEN whole_norm THEN coalesce(norm_length, 0) END AS path, end_time_ms - start_time_ms AS dur,
         row_number() OVER (PARTITION BY session_id ORDER BY start_time_ms IS NULL, coalesce(start_time_ms, 0), stroke_id) - 1 AS episode_index FROM m),
h1 AS (
  SELECT *, last_value(end_time_ms IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY episode_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end,
         lag(question_id) OVER (PARTITION BY participant_id, task_segment_id, mapped ORDER BY session_id, episode_index) AS before_q,
         row_number() OVER (PARTITION BY participant_id, task_segment_id, mapped, question_id ORDER BY session_id, episode_index) AS visit,
         last_value(CASE WHEN whole_norm THEN [fx1, fy1, fx2, fy2] END IGNORE NULLS) OVER (PARTITION BY participant_id, task_segment_id, mapped, question_id, page_id ORDER BY session_id, episode_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ink
  FROM h0),
h2 AS (
  SELECT *, sum(CASE WHEN visit > 1 AND before_q <> question_id THEN 1 ELSE 0 END) OVER (PARTITION BY participant_id, task_segment_id, mapped, question_id ORDER BY session_id, episode_index) AS returns,
         greatest(0, least(fx2, ink[3]) - greatest(fx1, ink[1])) * greatest(0, least(fy2, ink[4]) - greatest(fy1, ink[2])) AS inter, (fx2 - fx1) * (fy2 - fy1) + (ink[3] - ink[1]) * (ink[4] - ink[2]) AS areas
  FROM h1),
ep AS (
  SELECT session_id || '::' || stroke_id AS episode_id, session_id, participant_id, stroke_id, question_id, page_id, status, episode_index, by_input, task_segment_id,
         dur / 1000.0 AS duration_s, path AS path_length_norm, CASE WHEN dur > 0 THEN path / (dur / 1000.0) END AS mean_speed_norm_per_s,
         CASE WHEN start_time_ms IS NOT NULL AND prev_end IS NOT NULL THEN greatest(0, start_time_ms - prev_end) / 1000.0 END AS pause_before_s, CASE WHEN n >= 2 AND timed THEN coalesce(idle, 0) / 1000.0 END AS pause_inside_s,
         CASE WHEN all_norm AND path IS NOT NULL THEN nx2 - nx1 END AS bbox_width_norm, CASE WHEN all_norm AND path IS NOT NULL THEN ny2 - ny1 END AS bbox_height_norm,
         CASE WHEN mapped THEN confidence END AS question_occupancy, CASE WHEN mapped THEN visit::DOUBLE END AS visit_index, CASE WHEN mapped THEN returns::DOUBLE END AS return_count,
         CASE WHEN mapped AND whole_norm AND ink IS NOT NULL THEN CASE WHEN areas - inter <= 0 THEN 0.0 ELSE inter / (areas - inter) END END AS previous_ink_iou,
         CASE WHEN mapped AND len(flags) + len(stroke_flags) + len(point_flags) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS quality_valid
  FROM h2)"""


def _split(groups: str) -> str:
    """place and split of group_id, within nothing or within the column w."""
    return f"""
so AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY sha256('20260930:' || group_id), group_id) - 1 AS place, count(*) OVER (PARTITION BY w) AS n FROM ({groups})),
sz AS (SELECT *, greatest(1, floor(n * 0.7::DOUBLE)) AS a0, greatest(1, floor(n * 0.15::DOUBLE)) AS b0, n * 0.7::DOUBLE - floor(n * 0.7::DOUBLE) AS fa, n * 0.15::DOUBLE - floor(n * 0.15::DOUBLE) AS fb FROM so),
sx AS (SELECT *, greatest(0, n - a0 - 2 * b0) AS spare, greatest(0, a0 + 2 * b0 - n) AS excess FROM sz),
sp AS (SELECT group_id, w, place, n, CASE WHEN place < a0 - excess + CASE WHEN fa >= fb THEN spare ELSE 0 END THEN 'train' WHEN place < a0 - excess + b0 + spare THEN 'validation' ELSE 'test' END AS split FROM sx)"""


SPLIT_EPISODES = EPISODES + "," + _split("SELECT DISTINCT concat('u-', user_id) AS group_id, 0 AS w FROM events") + ", es AS (SELECT ep.*, sp.split FROM ep JOIN sp ON sp.group_id = ep.participant_id)"

TRUTH = SPLIT_EPISODES + """,
tr AS (
  SELECT session_id, session_id || ':truth:' || raw_order AS event_id,
         ['WRITING', 'QUESTION_VISIT', 'QUESTION_LEAVE', 'RETURN', 'REVISION_CANDIDATE', 'PAGE_CHANGE', 'PROCESS_END', 'UNKNOWN'][(raw_order // 7) % 8 + 1] AS event_type,
         CASE WHEN raw_order % 3 > 0 THEN page_id END AS page_id, CASE WHEN raw_order % 2 = 1 THEN 'q' || (raw_order % 4 + 1) END AS question_id,
         CASE WHEN raw_order % 49 = 0 THEN ['none'] ELSE list_filter([point_id, after], lambda x: x IS NOT NULL) END AS ids
  FROM (SELECT *, lead(point_id) OVER (PARTITION BY session_id ORDER BY raw_order) AS after FROM p) WHERE raw_order % 7 = 0),
tc AS (
  SELECT DISTINCT tr.event_id, es.episode_id, es.episode_index, tr.page_id IS NOT NULL AND (es.page_id IS NULL OR es.page_id = tr.page_id) AS page_fits, tr.question_id IS NOT NULL AND (es.question_id IS NULL OR es.question_id = tr.question_id) AS question_fits
  FROM tr JOIN es ON es.session_id = tr.session_id AND list_has_any(string_split(es.by_input, ','), tr.ids)),
td AS (SELECT * FROM (SELECT *, bool_or(page_fits) OVER (PARTITION BY event_id) AS any_page FROM tc) WHERE page_fits OR NOT any_page),
te AS (SELECT * FROM (SELECT *, bool_or(question_fits) OVER (PARTITION BY event_id) AS any_question FROM td) WHERE question_fits OR NOT any_question),
tm AS (SELECT event_id, string_agg(episode_id, ',' ORDER BY episode_index) AS matched, count(*) AS n FROM te GROUP BY event_id),
al AS (SELECT tr.session_id, tr.event_id AS truth_event_id, event_type, coalesce(matched, '') AS matched, CASE coalesce(n, 0) WHEN 0 THEN 'UNMATCHED' WHEN 1 THEN 'ONE_TO_ONE' ELSE 'ONE_TO_MANY' END AS alignment_status FROM tr LEFT JOIN tm USING (event_id)),
ty(event_type, pos) AS (VALUES ('WRITING', 0), ('QUESTION_VISIT', 1), ('QUESTION_LEAVE', 2), ('RETURN', 3), ('REVISION_CANDIDATE', 4), ('PAGE_CHANGE', 5), ('PROCESS_END', 6), ('UNKNOWN', 7)),
lab AS (SELECT DISTINCT matched AS episode_id, event_type FROM al WHERE alignment_status = 'ONE_TO_ONE')"""

FRAMES = STROKES + """,
o AS (SELECT session_id, point_id, arg_min(printf('stroke-%04d', CAST(ix AS BIGINT)), ix) AS stroke_id FROM i GROUP BY session_id, point_id),
f AS (
  SELECT p.session_id, row_number() OVER (PARTITION BY p.session_id ORDER BY timestamp_ms NULLS LAST, sequence NULLS LAST, raw_order) - 1 AS frame_index, p.point_id, o.stroke_id, page_id
  FROM p LEFT JOIN o ON o.session_id = p.session_id AND o.point_id = p.point_id)"""

PREDICTIONS = """
WITH x AS (
  SELECT o_orderkey AS id, 'a' AS label, CAST(o_custkey % 3 = 0 AS INT) AS target, ((o_orderkey * 7919 + o_custkey % 3 * 211) % 1000) / 1000.0 AS score FROM orders
  UNION ALL SELECT o_orderkey, 'b', CAST(o_custkey % 7 < 2 AS INT), ((o_orderkey * 104729 - o_custkey % 7 * 31) % 500 + 500) % 500 / 500.0 FROM orders)"""


def _round(c: str) -> str:
    return f"floor(({c}) * 1000000 + 0.5) / 1000000"


ORACLES = {
    "parse_points": POINTS + f" SELECT session_id, point_id, raw_order, timestamp_ms, {_round('x_norm')} AS x_norm, {_round('y_norm')} AS y_norm, pen_state, array_to_string(flags, ',') AS flags FROM p",
    "flag_histogram": POINTS + " SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM p) GROUP BY flag",
    "export_eligible": POINTS + " SELECT session_id, count(*) AS n FROM p WHERE device_id IS NOT NULL AND page_id IS NOT NULL AND timestamp_ms IS NOT NULL AND x_raw IS NOT NULL AND y_raw IS NOT NULL GROUP BY session_id",
    "degraded_points": POINTS + " SELECT session_id, count(*) FILTER (len(flags) > 0) AS degraded, count(*) AS total FROM p GROUP BY session_id",
    "strokes_basic": STROKES + " SELECT session_id, stroke_id, page_id, n_points, start_time_ms, end_time_ms, end_time_ms - start_time_ms AS duration_ms FROM s",
    "strokes_path": STROKES + f" SELECT session_id, stroke_id, {_round('CASE WHEN n_points = 1 THEN CASE WHEN has_norm THEN 0.0 END ELSE length END')} AS path_length FROM s",
    "strokes_bbox": STROKES + f"""
SELECT session_id, stroke_id, CASE WHEN all_norm THEN 'norm' WHEN all_raw THEN 'raw' ELSE 'unavailable' END AS space,
  {_round("CASE WHEN all_norm THEN nx2 - nx1 WHEN all_raw THEN rx2 - rx1 ELSE 0 END")} AS width, {_round("CASE WHEN all_norm THEN ny2 - ny1 WHEN all_raw THEN ry2 - ry1 ELSE 0 END")} AS height FROM s""",
    "strokes_processed_order": STROKES + " SELECT session_id, stroke_id, CASE WHEN untimed THEN by_input ELSE by_time END AS processed_order FROM s",
    "stroke_quality": STROKES + """
SELECT session_id, stroke_id, array_to_string(list_filter([CASE WHEN list_has_any(flags, ['INVALID_COORDINATE', 'MISSING_TIMESTAMP', 'MISSING_PAGE', 'MISSING_SEQUENCE']) THEN 'INCOMPLETE' END,
  CASE WHEN list_has_any(flags, ['DUPLICATE_POINT', 'OUT_OF_ORDER']) THEN 'PARTIAL_DATA' END], lambda x: x IS NOT NULL), ',') AS flags FROM s""",
    "page_changes": STROKES + """,
k AS (
  SELECT *, coalesce(upper(trim(page_id)) NOT IN ('UNKNOWN', 'PAGE_UNKNOWN', 'PAGE-UNKNOWN'), false) AS known FROM s),
c AS (
  SELECT *, last_value(CASE WHEN known THEN page_id END IGNORE NULLS) OVER (PARTITION BY session_id, participant_id, task_segment_id ORDER BY start_time_ms IS NULL, coalesce(start_time_ms, 0), stroke_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM k)
SELECT session_id, stroke_id, was || '>' || page_id AS change FROM c WHERE known AND page_id <> was""",
    "replay_frames": FRAMES + " SELECT session_id, frame_index, point_id, stroke_id, page_id FROM f",
    "replay_page_order": FRAMES + """
SELECT session_id, page_id, min(frame_index) AS first_frame, row_number() OVER (PARTITION BY session_id ORDER BY min(frame_index)) - 1 AS place FROM f WHERE page_id IS NOT NULL GROUP BY session_id, page_id""",
    "group_split": "WITH " + _split("SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS group_id, 0 AS w FROM customer") + " SELECT group_id, place, split FROM sp",
    "nation_splits": "WITH " + _split("SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS group_id, c_nationkey AS w FROM customer") + " SELECT w AS nation, group_id, place, split FROM sp",
    "seed_derivation": "SELECT c_custkey AS participant, n_nationkey AS scenario, CAST('0x' || substr(sha256('20260929:' || c_custkey || ':' || n_nationkey), 1, 8) AS BIGINT) AS seed FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "leakage_audit": """
WITH x AS (SELECT CASE o_orderkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, CAST(o_custkey AS VARCHAR) AS customer, CAST(o_orderkey AS VARCHAR) AS "order" FROM orders)
SELECT field, value, count(DISTINCT split) AS n_splits FROM (SELECT split, 'customer' AS field, customer AS value FROM x UNION ALL SELECT split, 'order', "order" FROM x) GROUP BY field, value HAVING count(DISTINCT split) > 1""",
    "confusion": PREDICTIONS + f""",
c AS (SELECT label, count(*) FILTER (score >= 0.5 AND target = 1)::DOUBLE AS tp, count(*) FILTER (score >= 0.5 AND target = 0)::DOUBLE AS fp, count(*) FILTER (score < 0.5 AND target = 1)::DOUBLE AS fn, count(*) FILTER (score < 0.5 AND target = 0)::DOUBLE AS tn FROM x GROUP BY label)
SELECT label, tp, fp, fn, tn, {_round('tp / (tp + fp)')} AS "precision", {_round('tp / (tp + fn)')} AS recall, {_round('2 * tp / (2 * tp + fp + fn)')} AS f1,
  {_round('(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))')} AS mcc FROM c""",
    "ranking": PREDICTIONS + f""",
r AS (SELECT label, target, (rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0) AS ar FROM x),
u AS (SELECT label, (sum(ar) FILTER (target = 1) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * sum(1 - target)) AS roc_auc FROM r GROUP BY label),
d AS (SELECT label, score, sum(target) AS pos, count(*) AS n FROM x GROUP BY label, score),
v AS (SELECT label, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY label) AS p FROM d WINDOW w AS (PARTITION BY label ORDER BY score DESC)),
a AS (SELECT label, sum(pos * (tp::DOUBLE / seen)) / max(p) AS ap FROM v GROUP BY label)
SELECT u.label, {_round('roc_auc')} AS roc_auc, {_round('ap')} AS average_precision FROM u JOIN a USING (label)""",
    "stroke_mapping": MAPPED + f" SELECT session_id, stroke_id, question_id, region_id, status, method AS mapping_method, {_round('confidence')} AS confidence, array_to_string(flags, ',') AS flags FROM m",
    "mapping_status_counts": MAPPED + " SELECT status, method AS mapping_method, count(*) AS n FROM m GROUP BY status, method",
    "event_type_counts": EVENTS + " SELECT event_type, quality_status, count(*) AS n FROM events_ GROUP BY event_type, quality_status",
}

_EVENT = " SELECT event_id, event_type, session_id, sequence, question_id, previous_question_id, next_question_id, page_id, start_ms AS start_time_ms, end_ms AS end_time_ms, stroke_ref, quality_status, array_to_string(flags, ',') AS quality_flags, reason FROM events_"
for _name, _types in (("process_events", ()), ("writing_evidence", ("WRITING",)), ("visits_returns", ("QUESTION_VISIT", "RETURN")), ("question_leaves", ("QUESTION_LEAVE",)), ("revisions", ("REVISION_CANDIDATE",)), ("unknown_events", ("UNKNOWN",)), ("process_ends", ("PROCESS_END",))):
    ORACLES[_name] = EVENTS + _EVENT + (f" WHERE event_type IN ({', '.join(repr(t) for t in _types)})" if _types else "")

# Points but every 97th; without the later one of two points of one id, or with both.
_TRACE = """,
know AS (SELECT session_id, point_id FROM p WHERE raw_order % 97 <> 5 GROUP BY session_id, point_id),
twice AS (SELECT DISTINCT session_id FROM (SELECT session_id, point_id FROM p GROUP BY session_id, point_id HAVING count(*) > 1)),
ref AS (SELECT event_id, session_id, unnest(list_distinct(string_split(points, ','))) AS point_id FROM events_),
fnd AS (SELECT ref.event_id, count(know.point_id) AS n_points, count(*) FILTER (know.point_id IS NULL) AS lost FROM ref LEFT JOIN know USING (session_id, point_id) GROUP BY ref.event_id)"""
ORACLES["trace_resolution"] = EVENTS + _TRACE + " SELECT session_id, event_id, event_type, stroke_ref, n_points, CASE WHEN lost > 0 THEN 'MISSING_POINT' END AS error FROM events_ JOIN fnd USING (event_id)"
ORACLES["trace_errors"] = EVENTS + _TRACE + " SELECT events_.session_id, event_type, count(*) AS n, 'DUPLICATE_POINT_ID' AS error FROM events_ JOIN twice USING (session_id) GROUP BY events_.session_id, event_type"
_STATUS = EVENTS + _TRACE + """,
fl AS (
  SELECT session_id, 0 AS n, raw_order AS place, unnest(flags) AS flag, generate_subscripts(flags, 1) AS k FROM p
  UNION ALL SELECT session_id, 1, ix, unnest(stroke_flags), generate_subscripts(stroke_flags, 1) FROM m
  UNION ALL SELECT session_id, 2, ix, unnest(flags), generate_subscripts(flags, 1) FROM m
  UNION ALL SELECT session_id, 3, sequence, unnest(flags), generate_subscripts(flags, 1) FROM events_
  UNION ALL SELECT session_id, 4, ix, 'MAPPING_' || status, 1 FROM m WHERE status <> 'MAPPED'
  UNION ALL SELECT session_id, 5, sequence, 'UNKNOWN_EVENT', 1 FROM events_ WHERE event_type = 'UNKNOWN'
  UNION ALL SELECT session_id, 6, 0, 'TRACE_ERROR', 1 FROM events_ JOIN twice USING (session_id)),
fo AS (SELECT session_id, flag, min((n, place, k)) AS seen_at FROM fl GROUP BY session_id, flag),
fs AS (SELECT session_id, string_agg(flag, ',' ORDER BY seen_at) AS flags FROM fo GROUP BY session_id),
ses AS (SELECT DISTINCT session_id FROM p UNION ALL SELECT 's-none')"""
ORACLES["run_status"] = _STATUS + """
SELECT session_id, CASE WHEN session_id = 's-none' THEN 'INVALID' WHEN flags IS NULL THEN 'OK' ELSE 'DEGRADED' END AS quality_status, CASE WHEN session_id = 's-none' THEN 'EMPTY_INPUT' ELSE coalesce(flags, '') END AS quality_flags FROM ses LEFT JOIN fs USING (session_id)"""
_WIRE = """, wr AS (SELECT event_id, event_type, session_id, task_segment_id, participant_id, coalesce(question_id, 'UNKNOWN') AS question_id, sequence, start_ms, end_ms, points, stroke_ref, quality_status FROM events_)"""
ORACLES["wire_events"] = EVENTS + _WIRE + """
SELECT event_id, event_type, session_id, task_segment_id, participant_id, question_id, start_ms AS start_time_ms, end_ms AS end_time_ms, points AS point_refs, stroke_ref AS stroke_refs, quality_status, 'inkwell-event-1' AS algorithm_version,
  '{"dataset_type":"observed","generator_version":"1.2.0"}' AS provenance FROM wr"""
ORACLES["wire_violations"] = EVENTS + _WIRE + """
SELECT event_id, CASE WHEN sequence % 31 = 1 THEN 'TIME_ORDER' WHEN sequence % 31 = 2 THEN 'VALID_WITHOUT_TIME' WHEN sequence % 31 = 3 THEN 'MOVING_VERSION' WHEN sequence % 31 = 4 THEN 'EMPTY_REFERENCE' END AS rule
FROM wr WHERE sequence % 31 IN (1, 3, 4) AND start_ms IS NOT NULL AND end_ms IS NOT NULL OR sequence % 31 = 2 AND quality_status = 'VALID' OR sequence % 31 IN (3, 4) AND (start_ms IS NULL OR end_ms IS NULL)"""
ORACLES["wire_batches"] = EVENTS + _WIRE + """
SELECT 'r1-event-batch-v0.1' AS contract_version, session_id || ':' || task_segment_id AS batch_id, session_id, task_segment_id, 'v1' AS dataset_version, 'inkwell-event-1' AS algorithm_version, count(*) AS n_events, true AS one_version,
  string_agg(event_id, ',' ORDER BY event_id) AS event_ids FROM wr GROUP BY session_id, task_segment_id"""
ORACLES["wire_unresolved_refs"] = EVENTS + _WIRE + """,
lp AS (SELECT DISTINCT session_id, event_id, unnest(string_split(points, ',')) AS point_id FROM wr), kp AS (SELECT DISTINCT session_id, point_id FROM p WHERE raw_order % 97 <> 5),
mp AS (SELECT session_id, event_id, string_agg(point_id, ',' ORDER BY point_id) AS missing_points FROM lp ANTI JOIN kp USING (session_id, point_id) GROUP BY session_id, event_id),
ms AS (SELECT session_id, event_id, stroke_ref AS missing_strokes FROM wr WHERE stroke_ref IN (SELECT printf('stroke-%04d', x) FROM range(3, 1000, 10) t(x)))
SELECT session_id, event_id, coalesce(missing_points, '') AS missing_points, coalesce(missing_strokes, '') AS missing_strokes FROM mp FULL JOIN ms USING (session_id, event_id)"""
# The truth under review has every 11th type changed; a reviewer has labelled every third event.
_REVIEW = EVENTS + """,
rv AS (SELECT session_id, event_id, event_type AS predicted_event_type, CASE WHEN sequence % 11 = 10 THEN 'UNKNOWN' ELSE event_type END AS expected_event_type, CASE sequence % 3 WHEN 0 THEN CASE WHEN sequence % 11 = 10 THEN 'NO' ELSE 'YES' END ELSE 'UNCERTAIN' END AS label FROM events_)"""
ORACLES["review_template"] = _REVIEW + " SELECT session_id, event_id, predicted_event_type, expected_event_type, label FROM rv"
ORACLES["review_summary"] = _REVIEW + " SELECT count(*) AS total, count(*) FILTER (label = 'YES') AS yes, count(*) FILTER (label = 'NO') AS no, count(*) FILTER (label = 'UNCERTAIN') AS uncertain FROM rv"
ORACLES["integrity_audit"] = EVENTS + """,
kp AS (SELECT DISTINCT session_id, point_id FROM p WHERE raw_order % 97 <> 5),
sr AS (SELECT session_id, stroke_id, unnest(string_split(by_input, ',')) AS point_id FROM m), er AS (SELECT session_id, event_id, unnest(string_split(points, ',')) AS point_id FROM events_),
gone AS (SELECT session_id, stroke_id FROM m WHERE ix % 10 = 3)
SELECT DISTINCT 'STROKE_POINT_MISSING' AS rule, session_id, stroke_id AS id FROM sr ANTI JOIN gone USING (session_id, stroke_id) ANTI JOIN kp USING (session_id, point_id)
UNION ALL SELECT 'MAPPING_STROKE_MISSING', session_id, stroke_id FROM gone
UNION ALL SELECT DISTINCT 'EVENT_STROKE_MISSING', e.session_id, event_id FROM events_ e JOIN gone ON gone.session_id = e.session_id AND gone.stroke_id = e.stroke_ref
UNION ALL SELECT DISTINCT 'EVENT_POINT_MISSING', session_id, event_id FROM er ANTI JOIN kp USING (session_id, point_id)
UNION ALL SELECT 'DUPLICATE_CASE', 's-1', 's-1'"""
_VALUES = ", ".join(f"{_round(f)} AS {f}" if f not in ("visit_index", "return_count", "quality_valid") else f for f in FEATURES)
ORACLES["features_12"] = SPLIT_EPISODES + f" SELECT episode_id, session_id, participant_id, stroke_id, question_id, status, split, episode_index, {_VALUES} FROM es"
_LONG = SPLIT_EPISODES + ", lg AS (SELECT split, feature, value FROM (" + " UNION ALL ".join(f"SELECT split, '{f}' AS feature, {f}::DOUBLE AS value FROM es" for f in FEATURES) + "))"
ORACLES["features_missingness"] = _LONG + f" SELECT split, feature, count(value) AS observed, count(*) - count(value) AS missing, {_round('(count(*) - count(value))::DOUBLE / count(*)')} AS rate FROM lg GROUP BY split, feature"
ORACLES["normalizer_stats"] = _LONG + f" SELECT feature, {_round('avg(value)')} AS mean, {_round('CASE WHEN stddev_pop(value) > 1e-12 THEN stddev_pop(value) ELSE 1.0 END')} AS std, stddev_pop(value) <= 1e-12 AS constant FROM lg WHERE split = 'train' GROUP BY feature"
ORACLES["normalized_features"] = _LONG + """,
st AS (SELECT feature, avg(value) AS mean, CASE WHEN stddev_pop(value) > 1e-12 THEN stddev_pop(value) ELSE 1.0 END AS std FROM lg WHERE split = 'train' GROUP BY feature)
SELECT split, feature, count(*) AS n, count(value) AS known, floor(sum(coalesce((value - mean) / std, 0)) * 100 + 0.5) / 100 AS total FROM lg JOIN st USING (feature) GROUP BY split, feature"""
ORACLES["sequence_lengths"] = EPISODES + " SELECT n, count(*) AS cases FROM (SELECT session_id, count(*) AS n FROM ep GROUP BY session_id) GROUP BY n"
ORACLES["sequences"] = EPISODES + f""",
sq AS (SELECT *, concat_ws('|', {', '.join(f"CASE WHEN {f} IS NULL THEN '0' ELSE '1' END" for f in FEATURES)}) AS mask, {' + '.join(f'coalesce({f}, 0)' for f in FEATURES)} AS total FROM ep)
SELECT session_id, string_agg(episode_id, ',' ORDER BY episode_index) AS episode_ids, string_agg(mask, ',' ORDER BY episode_index) AS masks, floor(sum(total) * 100 + 0.5) / 100 AS total, count(*) AS n FROM sq GROUP BY session_id"""
ORACLES["sequence_ownership"] = EPISODES + """
SELECT CASE WHEN episode_index % 31 = 30 THEN 'EPISODE_UNKNOWN' WHEN episode_index % 23 = 22 THEN 'EPISODE_SPLIT' ELSE 'EPISODE_VALUES' END AS rule, session_id, episode_id AS id
FROM ep WHERE episode_index % 31 = 30 OR episode_index % 23 = 22 OR episode_index % 29 = 28"""
ORACLES["sequence_audit"] = EPISODES + f""",
n AS (SELECT session_id, count(*) AS n FROM ep GROUP BY session_id)
SELECT count(*) AS sequences, min(n) AS least, {_round('avg(n)')} AS mean, {_round('quantile_cont(n, 0.5)')} AS median, {_round('quantile_cont(n, 0.9)')} AS p90, max(n) AS greatest, count(*) FILTER (n >= 7) AS reaching FROM n"""
ORACLES["truth_alignment"] = TRUTH + " SELECT session_id, truth_event_id, event_type, matched, alignment_status FROM al"
ORACLES["alignment_audit"] = TRUTH + " SELECT alignment_status AS rule, session_id, truth_event_id AS id FROM al WHERE alignment_status <> 'ONE_TO_ONE'"
ORACLES["targets_multihot"] = TRUTH + """
SELECT es.episode_id, string_agg(CASE WHEN lab.event_type IS NULL THEN '0' ELSE '1' END, '' ORDER BY pos) AS target FROM es CROSS JOIN ty LEFT JOIN lab ON lab.episode_id = es.episode_id AND lab.event_type = ty.event_type GROUP BY es.episode_id"""
ORACLES["target_distribution"] = TRUTH + " SELECT ty.event_type, count(lab.episode_id) AS n FROM ty LEFT JOIN lab USING (event_type) GROUP BY ty.event_type"
ORACLES["target_cooccurrence"] = TRUTH + """
SELECT x.event_type AS first, z.event_type AS second, count(*) AS n FROM lab x JOIN ty a ON a.event_type = x.event_type JOIN lab z ON z.episode_id = x.episode_id JOIN ty b ON b.event_type = z.event_type WHERE a.pos < b.pos GROUP BY ALL"""
# Every 13th episode has a share above 1, every 17th a negative duration, every 19th half a quality.
ORACLES["feature_range_audit"] = EPISODES + """
SELECT episode_id, 'question_occupancy' AS feature, 1.5::DOUBLE AS value FROM ep WHERE episode_index % 13 = 12
UNION ALL SELECT episode_id, 'duration_s', -1.0::DOUBLE FROM ep WHERE episode_index % 17 = 16 UNION ALL SELECT episode_id, 'quality_valid', 0.5::DOUBLE FROM ep WHERE episode_index % 19 = 18"""
# Every 23rd episode has been put into the test split.
ORACLES["feature_split_audit"] = SPLIT_EPISODES + """,
mv AS (SELECT *, CASE WHEN episode_index % 23 = 22 THEN 'test' ELSE split END AS own FROM es)
SELECT 'EPISODE_SPLIT' AS rule, session_id, episode_id AS id FROM mv WHERE own <> split
UNION ALL SELECT 'CASE_SPLITS', session_id, session_id FROM mv GROUP BY session_id HAVING count(DISTINCT own) > 1
UNION ALL SELECT 'PARTICIPANT_SPLITS', NULL, participant_id FROM mv GROUP BY participant_id HAVING count(DISTINCT own) > 1"""
_CASES = "WITH " + _split("SELECT DISTINCT concat('u-', user_id) AS group_id, 0 AS w FROM events") + ", cs AS (SELECT DISTINCT concat('s-', user_id) AS case_id, concat('u-', user_id) AS participant_id, split FROM events JOIN sp ON sp.group_id = concat('u-', user_id))"
ORACLES["split_manifests"] = _CASES + " SELECT 'inkwell-split-1' AS split_version, 'group_id' AS group_field, split AS split_name, 'pen' AS dataset_id, '1.0.0' AS dataset_version, 20260930::BIGINT AS split_seed, string_agg(participant_id, ',' ORDER BY participant_id) AS participant_ids, string_agg(case_id, ',' ORDER BY case_id) AS case_ids, count(*) AS count FROM cs GROUP BY split"
ORACLES["split_counts"] = _CASES + " SELECT split, count(DISTINCT participant_id) AS participants, count(*) AS cases FROM cs GROUP BY split"
# The first train case (by id) has gone over to test in the labels.
ORACLES["split_audit"] = _CASES + """,
one AS (SELECT min(case_id) AS case_id, 'u-' || substr(min(case_id), 3) AS participant_id FROM cs WHERE split = 'train')
SELECT 'CASE_LABEL' AS rule, CAST(NULL AS VARCHAR) AS session_id, case_id AS id FROM one
UNION ALL SELECT 'LABELLED_COUNT', NULL, x FROM (VALUES ('train'), ('test')) t(x)"""
ORACLES["case_quality"] = EVENTS + """
SELECT session_id, CASE WHEN bool_or(bad) THEN 'DEGRADED' ELSE 'OK' END AS quality_status FROM (
  SELECT session_id, len(flags) > 0 AS bad FROM p UNION ALL SELECT session_id, len(stroke_flags) > 0 OR status <> 'MAPPED' FROM m UNION ALL SELECT session_id, quality_status <> 'VALID' FROM events_) GROUP BY session_id"""
_OVERALL = PREDICTIONS + """,
h AS (SELECT *, score >= 0.5 AS hit, target = 1 AS yes FROM x),
r AS (SELECT label, target, (rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0) AS ar FROM x),
u AS (SELECT label, (sum(ar) FILTER (target = 1) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * sum(1 - target)) AS auc FROM r GROUP BY label),
f AS (SELECT label, 2.0 * count(*) FILTER (hit AND yes) / (2 * count(*) FILTER (hit AND yes) + count(*) FILTER (hit <> yes)) AS f1 FROM h GROUP BY label),
d AS (SELECT label, score, sum(target) AS pos, count(*) AS n FROM x GROUP BY label, score),
v AS (SELECT label, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY label) AS p FROM d WINDOW w AS (PARTITION BY label ORDER BY score DESC)),
a AS (SELECT label, sum(pos * (tp::DOUBLE / seen)) / max(p) AS ap FROM v GROUP BY label)"""
ORACLES["overall_metrics"] = _OVERALL + f"""
SELECT {_round('(SELECT count(*) FILTER (hit AND yes)::DOUBLE / count(*) FILTER (hit) FROM h)')} AS micro_precision, {_round('(SELECT count(*) FILTER (hit AND yes)::DOUBLE / count(*) FILTER (yes) FROM h)')} AS micro_recall,
  {_round('(SELECT 2.0 * count(*) FILTER (hit AND yes) / (2 * count(*) FILTER (hit AND yes) + count(*) FILTER (hit <> yes)) FROM h)')} AS micro_f1, {_round('(SELECT avg(f1) FROM f)')} AS macro_f1, {_round('(SELECT avg(auc) FROM u)')} AS macro_roc_auc,
  {_round('(SELECT avg(ap) FROM a)')} AS macro_average_precision, 2::BIGINT AS evaluable_labels, {_round('(SELECT avg((hit <> yes)::INT) FROM h)')} AS hamming_loss,
  {_round('(SELECT avg(ok::INT) FROM (SELECT bool_and(hit = yes) AS ok FROM h GROUP BY id))')} AS subset_accuracy"""
ORACLES["metric_deltas"] = PREDICTIONS + f""",
t AS (SELECT label, 2.0 * count(*) FILTER (score >= 0.5 AND target = 1) / (2 * count(*) FILTER (score >= 0.5 AND target = 1) + count(*) FILTER ((score >= 0.5) <> (target = 1))) AS a,
      2.0 * count(*) FILTER (score >= 0.4 AND target = 1) / (2 * count(*) FILTER (score >= 0.4 AND target = 1) + count(*) FILTER ((score >= 0.4) <> (target = 1))) AS b FROM x GROUP BY label)
SELECT label, {_round('a - b')} AS f1 FROM t"""
ORACLES["stored_dataset"] = EVENTS + " SELECT 'points' AS \"table\", count(*) AS n FROM p UNION ALL SELECT 'mappings', count(*) FROM m UNION ALL SELECT 'events', count(*) FROM events_ UNION ALL SELECT 'episodes', count(*) FROM m"
ORACLES["payload_hash"] = POINTS + """
SELECT session_id, raw_order, sha256('{"device":' || coalesce('"' || device_id || '"', 'null') || ',"order":' || raw_order || ',"point":"' || point_id || '"}') AS payload_hash FROM p"""
# Planted: see the queries. Constants are written out here, so that a wrong one in the code shows.
ORACLES["lineage_changes"] = _CASES + """, c AS (SELECT case_id, CAST(substr(case_id, 3) AS BIGINT) AS k FROM cs)
SELECT 'CASE_HASH' AS rule, case_id AS name FROM c WHERE k % 17 = 3 OR k % 71 = 5 UNION ALL SELECT 'CONFIG_IDENTITY', case_id FROM c WHERE k % 71 = 5
UNION ALL VALUES ('CASES_ROOT', 'cases'), ('CONFIG_HASH', 'config'), ('SPLIT_HASH', 'train'), ('SPLIT_HASH', 'test'), ('AUDIT_RESULT', 'splits'), ('AUDIT_RESULT', 'leakage'), ('AUDIT_FAILS', 'splits')"""
ORACLES["case_lines"] = STROKES + """
SELECT session_id AS case_id, stroke_id, sha256('{"case_id":"' || session_id || '","stroke":{"n_points":' || n_points || ',"page_id":' || coalesce('"' || page_id || '"', 'null') || ',"point_refs":["' || replace(by_input, ',', '","') || '"],"start_time_ms":' ||
  coalesce(CAST(start_time_ms AS VARCHAR), 'null') || ',"stroke_id":"' || stroke_id || '"}}') AS line_hash FROM s"""
ORACLES["guarded_fields"] = """
SELECT event_id, field, path FROM events JOIN (VALUES (3, 'careless', 'metadata.list[1].careless'), (3, 'emotion', 'metadata.list[1].deep.emotion'), (5, 'attention_score', 'metadata.a.attention_score')) t(k, field, path) ON event_id % 13 = k"""
ORACLES["quarantined_lines"] = """
SELECT 'NOT_JSON' AS reason, '{"event_id": ' || event_id AS text FROM events WHERE event_id % 19 = 1
UNION ALL SELECT 'NOT_OBJECT', '[' || event_id || ']' FROM events WHERE event_id % 19 <> 1 AND event_id % 23 = 2"""
ORACLES["event_violations"] = EVENTS + """
SELECT session_id, event_id, CASE sequence % 37 WHEN 1 THEN 'TIME_ORDER' WHEN 2 THEN 'VALID_WITHOUT_TIME' WHEN 3 THEN 'QUESTION_MISSING' ELSE 'EMPTY_REFERENCE' END AS rule FROM events_
WHERE sequence % 37 = 1 AND start_ms IS NOT NULL AND end_ms IS NOT NULL OR sequence % 37 = 2 AND quality_status = 'VALID' OR sequence % 37 = 3 AND event_type IN ('QUESTION_VISIT', 'QUESTION_LEAVE', 'RETURN', 'REVISION_CANDIDATE') OR sequence % 37 = 4"""
ORACLES["stroke_violations"] = STROKES + """
SELECT session_id, stroke_id, CASE ix % 11 WHEN 1 THEN 'DURATION' WHEN 2 THEN 'NEGATIVE_DURATION' ELSE 'TIME_ORDER' END AS rule FROM s WHERE ix % 11 IN (1, 3) AND start_time_ms IS NOT NULL OR ix % 11 = 2"""
ORACLES["audit_summary"] = SPLIT_EPISODES + """,
mv AS (SELECT *, CASE WHEN episode_index % 23 = 22 THEN 'test' ELSE split END AS own FROM es),
bad AS (
  SELECT 'EPISODE_SPLIT' AS rule, count(*) AS n FROM mv WHERE own <> split UNION ALL SELECT 'CASE_SPLITS', count(*) FROM (SELECT session_id FROM mv GROUP BY session_id HAVING count(DISTINCT own) > 1)
  UNION ALL SELECT 'PARTICIPANT_SPLITS', count(*) FROM (SELECT participant_id FROM mv GROUP BY participant_id HAVING count(DISTINCT own) > 1))
SELECT 'inherited_splits' AS audit, CASE WHEN sum(n) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CAST(sum(n) AS BIGINT) AS violations, coalesce(string_agg(rule || '=' || n, ',' ORDER BY rule) FILTER (n > 0), '') AS rules FROM bad
UNION ALL SELECT a, 'PASS', 0, '' FROM (VALUES ('feature_ranges'), ('splits'), ('inputs')) t(a)"""
ORACLES["prediction_coverage"] = """
WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM orders)
SELECT split, count(*) AS rows, count(*) FILTER (id % 31 <> 7) + count(*) FILTER (id % 31 <> 7 AND id % 47 = 11) AS predicted, count(DISTINCT CASE WHEN id % 31 <> 7 THEN id END) AS distinct_ids, count(*) FILTER (id % 31 = 7) AS unpredicted FROM r GROUP BY split"""
ORACLES["differing_predictions"] = PREDICTIONS + " SELECT id, label FROM x WHERE id % 101 = 13 OR id % 89 = 5"
ORACLES["region_violations"] = """
SELECT 'r-' || p_partkey AS region_id, CASE WHEN p_partkey % 7 = 1 THEN 'TOO_FEW_CORNERS' WHEN p_partkey % 7 = 2 THEN 'RECTANGLE_CORNERS' ELSE 'OUT_OF_RANGE' END AS rule
FROM part WHERE p_partkey % 7 IN (1, 3) OR p_partkey % 7 = 2 AND p_partkey % 2 = 0"""
ORACLES["wire_export"] = EVENTS + _WIRE + """,
kp AS (SELECT DISTINCT session_id, point_id FROM p WHERE raw_order % 97 <> 5),
lost AS (SELECT DISTINCT session_id, event_id FROM (SELECT session_id, event_id, unnest(string_split(points, ',')) AS point_id FROM wr) ANTI JOIN kp USING (session_id, point_id))
SELECT wr.session_id || ':' || task_segment_id AS batch_id, wr.session_id, CASE WHEN count(lost.event_id) > 0 THEN 'REFUSED' ELSE 'EXPORTED' END AS status, count(lost.event_id) AS unresolved, count(*) AS n_events, CASE WHEN count(lost.event_id) > 0 THEN 0 ELSE count(*) END AS handed_on
FROM wr LEFT JOIN lost ON lost.session_id = wr.session_id AND lost.event_id = wr.event_id GROUP BY wr.session_id, task_segment_id"""
