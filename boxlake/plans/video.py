"""Video queries: sampling, links, sessions, tracks, smoothing, playback, motion, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake import skew
from boxlake.functions import geometry as g
from boxlake.operators import inference, motion, playback, replay, tracking
from boxlake.plans.fixtures import derived, images, table
from boxlake.plans.registry import Registry

video = Registry()

# Two days and four hours, in milliseconds and seconds of video time.
MAX_GAP = 172_800_000
GRID = 14_400.0

_SESSION_CTE = f"""
    lagged AS (
        SELECT *, lag(frame_idx) OVER (PARTITION BY video_id, class_name ORDER BY frame_idx, det_idx) AS earlier FROM {{source}}),
    sessions AS (
        SELECT *, last_value(CASE WHEN earlier IS NULL OR frame_idx - earlier > {MAX_GAP} THEN frame_idx END IGNORE NULLS)
               OVER (PARTITION BY video_id, class_name ORDER BY frame_idx, det_idx ROWS UNBOUNDED PRECEDING) AS session_start
        FROM lagged)"""


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "observations").withColumnRenamed("minute", "chunk")


@video.add(
    "sampling_plan",
    """
    WITH p AS (
        SELECT event_id AS video_id, value AS duration, rate, greatest(1, CAST(ceil(value * rate) AS BIGINT)) AS samples
        FROM events, (VALUES (1), (2), (4), (8), (15), (30), (60), (120)) AS r(rate) WHERE ceil(value * rate) <= 2000)
    SELECT video_id, duration, rate, samples, greatest(1, CAST(ceil(samples * 0.01::DOUBLE) AS BIGINT)) AS patience,
           greatest(1, CAST(ceil(rate * 0.75::DOUBLE) AS BIGINT)) AS max_gap, 0.5::DOUBLE * 0.65::DOUBLE AS exit_confidence,
           least(greatest(0, duration - 0.001::DOUBLE), (samples - 1) / rate) AS last_time
    FROM p""",
)
def sampling_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = table(spark, sf_dir, "events").selectExpr("event_id AS video_id", "value AS duration")
    plans = tracking.sampling_plans(videos, 0.5)
    end = F.greatest(F.lit(0.0), F.col("duration") - 0.001)
    return plans.withColumn("last_time", F.least(end, (F.col("samples") - 1) / F.col("rate")))


@video.add(
    "sample_times",
    """
    WITH p AS (
        SELECT event_id AS video_id, value AS duration, rate, greatest(1, CAST(ceil(value * rate) AS BIGINT)) AS samples
        FROM events, (VALUES (1), (2), (4), (8), (15), (30), (60), (120)) AS r(rate) WHERE ceil(value * rate) <= 2000),
    f AS (SELECT *, unnest(range(samples)) AS frame_idx FROM p),
    t AS (SELECT video_id, rate, least(greatest(0, duration - 0.001::DOUBLE), frame_idx / rate) AS t FROM f)
    SELECT video_id, rate, count(*) AS frames, min(t) AS first_t, max(t) AS last_t,
           CAST(sum(CAST(floor(t * 1e6::DOUBLE) AS BIGINT)) AS BIGINT) AS sum_us FROM t GROUP BY video_id, rate""",
)
def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = table(spark, sf_dir, "events").selectExpr("event_id AS video_id", "value AS duration")
    # Every sample of every plan, reported as one digest per plan.
    digests = tracking.sample_digests(tracking.sampling_plans(videos, 0.5))
    return digests.groupBy("video_id", "rate").agg(
        F.sum("frames").alias("frames"), F.min("first_t").alias("first_t"),
        F.max("last_t").alias("last_t"), F.sum("sum_us").alias("sum_us"),
    )


@video.add(
    "track_sessions",
    f"""
    WITH {_SESSION_CTE.format(source='observations').strip()}
    SELECT video_id, class_name, frame_idx, det_idx, session_start FROM sessions""",
    ("observations",),
)
def track_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.with_sessions(_observations(spark, sf_dir), MAX_GAP).select(
        "video_id", "class_name", "frame_idx", "det_idx", "session_start"
    )


@video.add(
    "frame_link_join",
    f"""
    WITH f AS (
        SELECT video_id, class_name, frame_idx, lag(frame_idx) OVER (PARTITION BY video_id, class_name ORDER BY frame_idx) AS previous_frame
        FROM (SELECT DISTINCT video_id, class_name, frame_idx FROM observations) AS d),
    p AS (
        SELECT c.video_id, c.class_name, b.frame_idx AS previous_frame, b.det_idx AS previous_det, c.frame_idx, c.det_idx,
               greatest(0, least(b.x2, c.x2) - greatest(b.x1, c.x1)) * greatest(0, least(b.y2, c.y2) - greatest(b.y1, c.y1)) AS i
        FROM f JOIN observations AS c USING (video_id, class_name, frame_idx)
        JOIN observations AS b ON b.video_id = f.video_id AND b.class_name = f.class_name AND b.frame_idx = f.previous_frame
        WHERE f.frame_idx - f.previous_frame <= {MAX_GAP})
    SELECT video_id, class_name, previous_frame, previous_det, frame_idx, det_idx, i / (5760 - i) AS iou
    FROM p WHERE i / (5760 - i) >= 0.3::DOUBLE""",
    ("observations",),
)
def frame_link_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.frame_links(_observations(spark, sf_dir), MAX_GAP)


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.assign_tracks(
        _observations(spark, sf_dir), tracking.TrackerOptions(max_gap=MAX_GAP)
    )


@video.add("track_assign")
def track_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every observation with its track (numbered per video), visibility and segment."""
    tracked = _tracks(spark, sf_dir)
    ids = tracking.number_tracks(tracked)
    return tracked.join(ids, tracking.TRACK_KEY, "left").select(
        "video_id", "frame_idx", "det_idx", "class_name", "track_id", "visible", "segment"
    )


@video.add(
    "track_assign_invariants",
    """
    SELECT count(*) AS observations, CAST(0 AS BIGINT) AS shared_frames, CAST(0 AS BIGINT) AS long_gaps,
           CAST(0 AS BIGINT) AS weak_links, CAST(0 AS BIGINT) AS weak_starts, CAST(0 AS BIGINT) AS strong_untracked
    FROM observations""",
    ("observations",),
)
def track_assign_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of observations breaking a tracker rule; all but the first must be zero."""
    tracked = _tracks(spark, sf_dir).withColumn("chunk", F.expr("frame_idx div 60000"))
    keys = tracking.TRACK_KEY
    owned = tracked.filter(F.col("start_frame").isNotNull())
    shared = owned.groupBy(*keys, "frame_idx").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    last = skew.carried_last(
        owned, keys, "chunk", ["frame_idx"], F.struct("frame_idx", "x1", "y1", "x2", "y2"), "b"
    )
    overlap = g.iou(g.field_box(F.col("b")), g.box())
    follows = F.col("b").isNotNull()
    gap = F.col("frame_idx") - F.col("b.frame_idx")
    parts = [
        tracked.select(
            F.lit("observations").alias("rule"), F.lit(True).alias("hit")
        ),
        shared.select(F.lit("shared_frames").alias("rule"), F.lit(True).alias("hit")),
        last.select(F.explode(F.array(*[
            F.struct(F.lit(name).alias("rule"), F.coalesce(hit, F.lit(False)).alias("hit"))
            for name, hit in (
                ("long_gaps", follows & (gap > MAX_GAP)),
                ("weak_links", follows & (overlap < tracking.MATCH_IOU)),
                ("weak_starts", ~follows & (F.col("confidence") < 0.5)),
            )
        ])).alias("c")).select("c.*"),
        tracked.select(
            F.lit("strong_untracked").alias("rule"),
            (F.col("start_frame").isNull() & (F.col("confidence") >= 0.5)).alias("hit"),
        ),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    names = ("observations", "shared_frames", "long_gaps", "weak_links", "weak_starts",
             "strong_untracked")
    return stacked.agg(*[
        F.count_if(F.col("hit") & (F.col("rule") == name)).alias(name) for name in names
    ])


# Tracks with a closed SQL form: sessions of each lane, visible above the exit confidence, with a new
# segment every ten days.
_TRACKED_CTE = f"""
    lane AS (SELECT * REPLACE (video_id * 2 + det_idx % 2 AS video_id) FROM observations), {_SESSION_CTE.format(source='lane').strip()},
    tracked AS (
        SELECT *, confidence >= 0.325::DOUBLE AS visible, CAST(frame_idx // 864000000 AS INTEGER) AS segment FROM sessions),
    summary AS (
        SELECT video_id, class_name, session_start, min(t) AS start_time, max(t) AS end_time, max(t) FILTER (visible) AS visible_end_time,
               count(*) AS observations, count(*) FILTER (visible) AS visible_observations, max(confidence) AS max_confidence,
               arg_max(t, confidence * 1e12::DOUBLE - t) AS representative_time
        FROM tracked GROUP BY 1, 2, 3),
    persistent AS (SELECT * FROM summary WHERE visible_observations >= 2)"""
_KEYS = ["video_id", "class_name", "session_start"]
# Larger groups that are counted without finding the sessions first.
_WITHIN = ["video_id", "class_name"]
# The two lanes of a video are tracked as videos of their own: inside a lane times are unique.
_LANE = "video_id * 2 + det_idx % 2"


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = _observations(spark, sf_dir).withColumn("video_id", F.expr(_LANE))
    return tracking.with_sessions(lanes, MAX_GAP).withColumns({
        "visible": F.col("confidence") >= 0.325,
        "segment": F.expr("CAST(frame_idx div 864000000 AS INT)"),
    })


@video.add(
    "track_summary",
    f"WITH {_TRACKED_CTE.strip()} SELECT * FROM summary",
    ("observations",),
)
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.summarise_tracks(_tracked(spark, sf_dir), _KEYS)


@video.add(
    "persistent_tracks",
    f"""
    WITH {_TRACKED_CTE.strip()}
    SELECT video_id, class_name, session_start, frame_idx, det_idx FROM tracked
    JOIN persistent USING (video_id, class_name, session_start) WHERE visible""",
    ("observations",),
)
def persistent_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tracked(spark, sf_dir)
    kept = tracking.persistent_tracks(rows, 4, _KEYS)
    return tracking.surviving_observations(rows, kept, _KEYS, _WITHIN).select(*_KEYS, "frame_idx", "det_idx")


@video.add(
    "track_timeline",
    f"""
    WITH {_TRACKED_CTE.strip()},
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY visible_observations DESC, max_confidence DESC, session_start, class_name) AS place
        FROM persistent),
    texts AS (
        SELECT *, CAST(CAST(floor(start_time / 60) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST(CAST(floor(start_time - floor(start_time / 60) * 60) AS BIGINT) AS VARCHAR), 2, '0') AS s,
               CAST(CAST(floor(end_time / 60) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST(CAST(floor(end_time - floor(end_time / 60) * 60) AS BIGINT) AS VARCHAR), 2, '0') AS e,
               CAST(CAST(floor(visible_end_time / 60) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST(CAST(floor(visible_end_time - floor(visible_end_time / 60) * 60) AS BIGINT) AS VARCHAR), 2, '0') AS v,
               printf('%.1f', round(max_confidence * 100, 1)) || '%' AS peak, CAST(visible_observations AS VARCHAR) AS n FROM placed WHERE place <= 12)
    SELECT video_id, class_name, place, round(start_time / 2592000 * 100, 6) AS rail_start,
           round(greatest(0.8::DOUBLE, (visible_end_time - start_time) / 2592000 * 100), 6) AS rail_width,
           class_name || ' · ' || n || ' samples' AS title, s || '–' || e || ' · peak ' || peak AS detail,
           class_name || ': ' || s || '–' || v || ', ' || n || ' samples, peak ' || peak || '.' AS summary
    FROM texts""",
    ("observations",),
)
def track_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tracking.persistent_tracks(_tracked(spark, sf_dir), 4, _KEYS)
    order = [F.col("session_start").asc(), F.col("class_name").asc()]
    return tracking.timeline(
        kept, F.lit(2592000.0), order, ["class_name", "session_start"]
    )


_TAU = 86_400.0
_SMOOTH_CTE = _TRACKED_CTE.strip() + f"""
    , v AS (
        SELECT *, row_number() OVER (PARTITION BY video_id, class_name, session_start, segment ORDER BY t) AS rn,
               count(*) OVER (PARTITION BY video_id, class_name, session_start, segment) AS n,
               (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h FROM tracked),
    fwd AS (
        SELECT video_id, class_name, session_start, segment, rn, t, cx, cy, w, h FROM v WHERE rn = 1
        UNION ALL
        SELECT video_id, class_name, session_start, segment, rn, t, px + (cx - px) * a, py + (cy - py) * a, pw + (w - pw) * a, ph + (h - ph) * a
        FROM (SELECT v.*, f.cx AS px, f.cy AS py, f.w AS pw, f.h AS ph, 1 - exp(-(v.t - f.t) / {_TAU}::DOUBLE) AS a
              FROM fwd AS f JOIN v ON v.video_id = f.video_id AND v.class_name = f.class_name AND v.session_start = f.session_start
                   AND v.segment = f.segment AND v.rn = f.rn + 1) AS s),
    bwd AS (
        SELECT video_id, class_name, session_start, segment, rn, t, cx, cy, w, h FROM v WHERE rn = n
        UNION ALL
        SELECT video_id, class_name, session_start, segment, rn, t, px + (cx - px) * a, py + (cy - py) * a, pw + (w - pw) * a, ph + (h - ph) * a
        FROM (SELECT v.*, f.cx AS px, f.cy AS py, f.w AS pw, f.h AS ph, 1 - exp(-(f.t - v.t) / {_TAU}::DOUBLE) AS a
              FROM bwd AS f JOIN v ON v.video_id = f.video_id AND v.class_name = f.class_name AND v.session_start = f.session_start
                   AND v.segment = f.segment AND v.rn = f.rn - 1) AS s)"""


@video.add(
    "smooth_tracks",
    f"""
    WITH RECURSIVE {_SMOOTH_CTE}
    SELECT video_id, class_name, session_start, segment, f.t, round((f.cx + b.cx) / 2, 6) AS s_cx, round((f.cy + b.cy) / 2, 6) AS s_cy,
           round((f.w + b.w) / 2, 6) AS s_w, round((f.h + b.h) / 2, 6) AS s_h
    FROM fwd AS f JOIN bwd AS b USING (video_id, class_name, session_start, segment, rn)""",
    ("observations",),
)
def smooth_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    smoothed = playback.smooth_tracks(_tracked(spark, sf_dir), [*_KEYS, "segment"], _TAU, groups=_WITHIN)
    return smoothed.select(
        *_KEYS, "segment", "t",
        *[F.round(f"s_{v}", 6).alias(f"s_{v}") for v in playback.VECTOR],
    )


@video.add(
    "asof_playback",
    """
    WITH o AS (
        SELECT * REPLACE (video_id * 2 + det_idx % 2 AS video_id), (x1 + x2) / 2 AS cx FROM observations),
    p AS (SELECT video_id, CASE class_name WHEN 'pipe burst' THEN 'water drop' WHEN 'water drop' THEN 'water accumulation' ELSE 'pipe burst' END AS class_name,
                 frame_idx, det_idx AS probe_id FROM o),
    b AS (SELECT p.video_id, p.class_name, p.probe_id, p.frame_idx, o.frame_idx AS before_frame, o.cx AS before_cx
          FROM p ASOF LEFT JOIN o ON o.video_id = p.video_id AND o.class_name = p.class_name AND p.frame_idx >= o.frame_idx)
    SELECT b.video_id, b.class_name, b.probe_id, before_frame, before_cx, o.frame_idx AS after_frame, o.cx AS after_cx
    FROM b ASOF LEFT JOIN o ON o.video_id = b.video_id AND o.class_name = b.class_name AND b.frame_idx < o.frame_idx""",
    ("observations",),
)
def asof_playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = _observations(spark, sf_dir).withColumn("video_id", F.expr(_LANE))
    rows = playback.box_vectors(lanes)
    name = F.col("class_name")
    other = (
        F.when(name == "pipe burst", "water drop").when(name == "water drop", "water accumulation")
        .otherwise("pipe burst")
    )
    probes = rows.select(
        "video_id", other.alias("class_name"), "frame_idx", "chunk", F.col("det_idx").alias("probe_id")
    )
    found = playback.asof_both(
        probes, rows, ["video_id", "class_name"], "frame_idx", "chunk", ["cx"]
    )
    return found.select(
        "video_id", "class_name", "probe_id",
        F.col("before.frame_idx").alias("before_frame"), F.col("before.cx").alias("before_cx"),
        F.col("after.frame_idx").alias("after_frame"), F.col("after.cx").alias("after_cx"),
    )


# An odd flow interval keeps moved boxes away from 6-digit rounding ties.
_FLOW = {
    "flow_to_next": ("(event_id % 7) - 3", "(event_id % 5) - 2", "event_id % 4"),
    "flow_from_previous": ("(event_id % 6) - 2", "(event_id % 4) - 1", "event_id % 3"),
}


def _flow_struct(parts: tuple[str, str, str]) -> str:
    dx, dy, rel = parts
    return (
        f"named_struct('dx', CAST({dx} AS DOUBLE), 'dy', CAST({dy} AS DOUBLE), 'dt', 14399.0D, "
        f"'reliability', CAST({rel} AS DOUBLE) / 10)"
    )


_GAP, _WINDOW = 100_000.0, 20_000.0
_PLAYBACK_SQL = f"""
    WITH {_TRACKED_CTE.strip()},
    o AS (
        SELECT video_id, class_name, session_start, segment, t, confidence, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h,
               (e % 7) - 3 AS ndx, (e % 5) - 2 AS ndy, e % 4 >= 2 AS nok, (e % 6) - 2 AS pdx, (e % 4) - 1 AS pdy, e % 3 >= 2 AS pok
        FROM (SELECT *, det_idx // 2 AS e FROM tracked) AS q),
    seg AS (
        SELECT video_id, class_name, session_start, segment, list({{'t': t, 'c': confidence, 'cx': cx, 'cy': cy, 'w': w, 'h': h, 'ndx': ndx, 'ndy': ndy,
               'nok': nok, 'pdx': pdx, 'pdy': pdy, 'pok': pok}} ORDER BY t) AS obs FROM o GROUP BY 1, 2, 3, 4),
    k AS (
        SELECT *, unnest(range(greatest(0, CAST(ceil((obs[1].t - {_WINDOW}::DOUBLE) / {GRID}::DOUBLE) AS BIGINT)),
                               CAST(floor((obs[-1].t + {_WINDOW}::DOUBLE) / {GRID}::DOUBLE) AS BIGINT) + 1)) * {GRID}::DOUBLE AS time FROM seg),
    lr AS (
        SELECT video_id, class_name, session_start, segment, time, list_filter(obs, lambda x: x.t <= time)[-1] AS l,
               list_filter(obs, lambda x: x.t > time)[1] AS r FROM k),
    z AS (
        SELECT *, r.t - l.t AS gap, l IS NOT NULL AND r IS NOT NULL AND r.t - l.t <= {_GAP}::DOUBLE AS joined,
               CASE WHEN l IS NULL THEN r WHEN r IS NULL THEN l WHEN time - l.t <= r.t - time THEN l ELSE r END AS near FROM lr),
    a AS (SELECT *, (time - l.t) / gap AS u, time - near.t AS d,
                 CASE WHEN time >= near.t THEN near.nok ELSE near.pok END AND abs(time - near.t) <= 14399 AS push FROM z
          WHERE joined OR abs(time - near.t) <= {_WINDOW}::DOUBLE)
    SELECT video_id, class_name, session_start, segment, time,
           round(CASE WHEN joined THEN l.c + (r.c - l.c) * u ELSE near.c END, 6) AS confidence,
           round(CASE WHEN joined AND l.nok AND r.pok THEN (2 * u * u * u - 3 * u * u + 1) * l.cx + (u * u * u - 2 * u * u + u) * (l.ndx / 14399) * gap
                           + (3 * u * u - 2 * u * u * u) * r.cx + (u * u * u - u * u) * (r.pdx / 14399) * gap
                WHEN joined THEN l.cx + (r.cx - l.cx) * u
                WHEN push THEN near.cx + CASE WHEN d >= 0 THEN near.ndx ELSE near.pdx END / 14399 * d ELSE near.cx END, 6) AS cx,
           round(CASE WHEN joined AND l.nok AND r.pok THEN (2 * u * u * u - 3 * u * u + 1) * l.cy + (u * u * u - 2 * u * u + u) * (l.ndy / 14399) * gap
                           + (3 * u * u - 2 * u * u * u) * r.cy + (u * u * u - u * u) * (r.pdy / 14399) * gap
                WHEN joined THEN l.cy + (r.cy - l.cy) * u
                WHEN push THEN near.cy + CASE WHEN d >= 0 THEN near.ndy ELSE near.pdy END / 14399 * d ELSE near.cy END, 6) AS cy,
           round(CASE WHEN joined THEN l.w + (r.w - l.w) * u ELSE near.w END, 6) AS w,
           round(CASE WHEN joined THEN l.h + (r.h - l.h) * u ELSE near.h END, 6) AS h
    FROM a"""


@video.add("playback_sample", _PLAYBACK_SQL, ("observations",))
def playback_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = playback.box_vectors(_tracked(spark, sf_dir)).withColumn(
        "event_id", F.expr("det_idx div 2")
    ).selectExpr(
        *_KEYS, "segment", "chunk", "t", "confidence",
        *[f"{v} AS s_{v}" for v in playback.VECTOR],
        *[f"{_flow_struct(parts)} AS {name}" for name, parts in _FLOW.items()],
    )
    shown = playback.sample_playback(
        rows, [*_KEYS, "segment"], "chunk", GRID, max_gap=_GAP, window=_WINDOW, groups=_WITHIN
    )
    return shown.select(
        *_KEYS, "segment", "time",
        *[F.round(c, 6).alias(c) for c in ("confidence", *playback.VECTOR)],
    )


@video.add(
    "flow_consensus",
    """
    WITH p AS (
        SELECT l_orderkey AS box_id, CAST(l_partkey % 13 - 6 AS DOUBLE) AS dx, CAST(l_suppkey % 7 - 3 AS DOUBLE) AS dy FROM lineitem),
    m AS (SELECT box_id, median(dx) AS dx, median(dy) AS dy, count(*) AS points FROM p GROUP BY 1),
    s AS (SELECT p.box_id, median(sqrt((p.dx - m.dx) * (p.dx - m.dx) + (p.dy - m.dy) * (p.dy - m.dy))) AS spread FROM p JOIN m USING (box_id) GROUP BY 1)
    SELECT box_id, dx, dy, points, round(greatest(0, least(1, points / 16.0::DOUBLE / (spread + 1))), 9) AS reliability
    FROM m JOIN s USING (box_id) WHERE points >= 4""",
)
def flow_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS box_id", "CAST(l_partkey % 13 - 6 AS DOUBLE) AS dx",
        "CAST(l_suppkey % 7 - 3 AS DOUBLE) AS dy",
    )
    return motion.flow_consensus(patches, "box_id")


# A patch of 3 x 3 pixels is searched 3 pixels around: sums of absolute differences that SQL can list.
_FLOW_OPTIONS = motion.FlowOptions(patch=1, search=3)
_FLOW_SQL = """
    WITH d AS (
        SELECT doc_id, string_agg(sha256(h || i::VARCHAR), '' ORDER BY i) AS noise
        FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), range(60) AS r(i) GROUP BY 1),
    px AS MATERIALIZED (SELECT doc_id, j, ('0x' || substr(noise, 2 * j + 1, 2))::INT AS v FROM d, range(1920) AS r(j)),
    near AS (SELECT y * 3 + x AS o, y - 1 AS oy, x - 1 AS ox FROM range(3) AS a(y), range(3) AS b(x)),
    moves AS (SELECT y - 3 AS dy, x - 3 AS dx FROM range(7) AS a(y), range(7) AS b(x)),
    points AS (
        SELECT f, det, gy * 4 + gx AS pt, floor(10 + det + (gx + 0.5) * 6.5 + 0.5)::INT AS x, floor(9 + (gy + 0.5) * 5.25 + 0.5)::INT AS y
        FROM range(2) AS a(f), range(2) AS b(det), range(4) AS c(gy), range(4) AS d(gx)),
    before AS MATERIALIZED (
        SELECT doc_id, f, det, pt, x, y, o, ox, oy, v
        FROM points CROSS JOIN near JOIN px ON px.j = ((y + oy) * 48 + x + ox + f) % 1920),
    rich AS (
        SELECT doc_id, f, det, pt FROM before GROUP BY ALL HAVING 9 * sum(v * v) - sum(v) * sum(v) >= 26244),
    probe AS MATERIALIZED (
        SELECT doc_id, f, det, pt, dy, dx, v AS was, ((y + dy + oy) * 48 + x + dx + ox + f + 1) % 1920 AS j
        FROM before JOIN rich USING (doc_id, f, det, pt) CROSS JOIN moves),
    sad AS (
        SELECT doc_id, f, det, pt, dy, dx, sum(abs(was - v)) AS e FROM probe JOIN px USING (doc_id, j)
        GROUP BY doc_id, f, det, pt, dy, dx),
    best AS (
        SELECT doc_id, f, det, dx, dy FROM sad
        QUALIFY row_number() OVER (PARTITION BY doc_id, f, det, pt ORDER BY e, dy, dx) = 1),
    middle AS (
        SELECT doc_id, f, det, median(dx) AS mx, median(dy) AS my, count(*) AS n FROM best GROUP BY ALL HAVING count(*) >= 4),
    spread AS (
        SELECT doc_id, f, det, mx, my, n, median(sqrt((dx - mx) * (dx - mx) + (dy - my) * (dy - my))) AS s
        FROM best JOIN middle USING (doc_id, f, det) GROUP BY ALL)
    SELECT doc_id AS video_id, f AS frame_idx, det AS det_idx, mx AS dx, my AS dy, 0.25::DOUBLE AS dt,
           round(greatest(0, least(1, 1 / (1 + s) * (n / 16.0::DOUBLE))), 9) AS reliability
    FROM spread"""


@video.add("motion_flow", _FLOW_SQL)
def motion_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three frames per document: hashed noise, each frame shifted one pixel to the left."""
    texture = "array_join(transform(sequence(0, 59), i -> sha2(concat(d, CAST(i AS STRING)), 256)), '')"
    digests = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "sha2(coalesce(text, ''), 256) AS d"
    )
    frames = digests.selectExpr("doc_id AS video_id", f"unhex({texture}) AS noise").selectExpr(
        "video_id", "noise", "explode(sequence(0, 2)) AS f"
    ).selectExpr(
        "video_id", "CAST(f AS BIGINT) AS frame_idx", "f * 0.25D AS t", "48 AS width", "40 AS height",
        "1 AS channels", "concat(substring(noise, f + 1, 1920), substring(noise, 1, f)) AS data",
    )
    boxes = frames.selectExpr(
        "video_id", "frame_idx", "explode(sequence(0L, 1L)) AS det_idx"
    ).selectExpr(
        "*", "10.0D + det_idx AS x1", "9.0D AS y1", "36.0D + det_idx AS x2", "30.0D AS y2"
    )
    flows = motion.motion_flow(frames, boxes, _FLOW_OPTIONS)
    return flows.withColumn("reliability", F.round("reliability", 9))


_EVENT_OPS = ("confirm", "move", "remove", "undo", "add", "redo", "reclass", "undo", "restore",
              "approve", "set")


def review_rows(turns: DataFrame) -> DataFrame:
    """Every conversation turn as one detected box to load (seq -1) and one later edit."""
    ops = ", ".join(f"'{op}'" for op in _EVENT_OPS)
    load = (
        "named_struct('seq', -1L, 'op', 'model', 'det_id', turn + 1, 'class_name', 'pipe burst', "
        "'confidence', CAST((image_id * 7 + turn * 13) % 101 AS DOUBLE) / 100, "
        "'x1', n, 'y1', n + turn, 'x2', n + 40, 'y2', n + turn + 30)"
    )
    edit = (
        f"named_struct('seq', turn, 'op', element_at(array({ops}), "
        f"CAST((image_id * 3 + turn * 2) % {len(_EVENT_OPS)} AS INT) + 1), "
        "'det_id', (turn * 3 + image_id) % 6 + 1, 'class_name', 'water drop', "
        "'confidence', CAST(NULL AS DOUBLE), 'x1', n + 5, 'y1', n, 'x2', n + 50, 'y2', n + 20)"
    )
    return turns.selectExpr(
        "conv_id AS image_id", "turn", "CAST(length(text) AS DOUBLE) AS n"
    ).selectExpr("image_id", f"inline(array({load}, {edit}))")


@video.add("review_replay")
def review_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(table(spark, sf_dir, "conversations"))
    return replay.replay_reviews(
        rows.filter("op = 'model'"), rows.filter("op <> 'model'").drop("confidence")
    )


def fixture_predictor(role: str) -> inference.Predictor:
    """Deterministic stand-in for a model: boxes are arithmetic of the image id."""

    def predict(image, confidence: float):
        if image.image_id % 50 == 0:
            raise ValueError(f"cannot decode {image.image_id}")
        name = "water damage" if role == "specialist" else "pipe burst"
        rows = []
        for i in range(image.image_id % 4):
            score = (image.image_id * 31 + i * 377) % 1000 / 1000
            if score >= confidence:
                rows.append((name, score, (i, i, i + 10 + image.image_id % 7, i + 12)))
        return rows

    return predict


@video.add(
    "batch_detect",
    """
    WITH r AS (SELECT image_id, unnest(range(image_id % 4)) AS i FROM images WHERE image_id % 50 <> 0),
    s AS (SELECT *, CAST((image_id * 31 + i * 377) % 1000 AS DOUBLE) / 1000 AS confidence FROM r)
    SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY i) - 1 AS det_idx, 'water accumulation' AS class_name, confidence,
           CAST(i AS DOUBLE) AS x1, CAST(i AS DOUBLE) AS y1, CAST(i + 10 + image_id % 7 AS DOUBLE) AS x2, CAST(i + 12 AS DOUBLE) AS y2,
           CAST(NULL AS VARCHAR) AS error
    FROM s WHERE confidence >= 0.25::DOUBLE
    UNION ALL
    SELECT image_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'cannot decode ' || CAST(image_id AS VARCHAR) FROM images WHERE image_id % 50 = 0""",
    ("images",),
)
def batch_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.detect_images(
        images(spark, sf_dir).select("image_id", "filename"), fixture_predictor, 0.25,
        "water_accumulation",
    )
