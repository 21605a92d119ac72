"""Plans and large-group paths of queries that have to grow no faster than their input."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlake import skew
from boxlake.operators import motion, tracking
from boxlake.plans.queries import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df) -> list[tuple]:
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_manifest_is_reconciled_without_broadcasts(spark, small):
    assert "Broadcast" not in _plan(QUERIES["manifest_reconcile"](spark, small))


def test_sample_digests_are_those_of_all_samples(spark, monkeypatch):
    monkeypatch.setattr(tracking, "SAMPLES_AT_ONCE", 700)
    values = [0.0, -1.0, 0.0004, 0.001, 1.0, 7.77, 66.66, *np.random.default_rng(1).uniform(0, 300, 40)]
    videos = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "video_id long, duration double")
    plans = tracking.sampling_plans(videos, 0.5)
    wanted = tracking.sample_times(plans).groupBy("video_id", "rate").agg(
        F.count(F.lit(1)).alias("frames"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.sum(F.floor(F.col("t") * 1e6).cast("long")).alias("sum_us"),
    )
    assert _rows(tracking.sample_digests(plans)) == _rows(wanted)
    assert _rows(tracking.sample_digests(plans.filter("false"))) == []


def test_sample_query_does_not_list_samples_as_rows(spark, small):
    plan = _plan(QUERIES["sample_times"](spark, small))
    assert "sequence(" not in plan


def test_ordinary_sessions_take_one_shuffle(spark, small):
    plan = _plan(QUERIES["track_sessions"](spark, small))
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize(
    "name", ["track_sessions", "persistent_tracks", "smooth_tracks", "playback_sample", "asof_playback", "frame_link_join"]
)
def test_groups_cut_at_chunks_give_the_same_rows(spark, skewed, monkeypatch, name):
    whole = _rows(QUERIES[name](spark, skewed))
    monkeypatch.setattr(skew, "WINDOW_ROWS", 20)
    monkeypatch.setattr(skew, "HOT_JOIN_ROWS", 20)
    assert _rows(QUERIES[name](spark, skewed)) == whole


def test_pairs_of_frames_are_matched_side_by_side(spark, monkeypatch):
    calls, rng = [], np.random.default_rng(3)
    frames = rng.integers(0, 256, (5, 40, 48), dtype=np.uint8)
    which = np.array([0, 3, 1, 1, 2, 3])
    boxes = np.column_stack([rng.uniform(0, 20, (6, 2)), rng.uniform(24, 47, (6, 2))])
    options = motion.FlowOptions(patch=1, search=3)
    single = np.concatenate([
        motion.box_flows(frames[f], frames[f + 1], boxes[i : i + 1], options) for i, f in enumerate(which)
    ])
    inner = motion._moves
    monkeypatch.setattr(motion, "_moves", lambda *a: calls.append(1) or inner(*a))
    together = motion.stack_flows(frames[:-1], frames[1:], which, boxes, options)
    np.testing.assert_array_equal(together, single)
    assert len(calls) == 1


def test_streamed_tracks_are_fed_and_given_as_rows():
    import pickle

    from pyspark.sql import Row

    from boxlake.streaming import jobs

    class Store:
        """Stands for handle, timers and state; counts what is asked."""

        asked, saved = 0, None

        def get(self):
            self.asked += 1
            return self.saved

        def update(self, saved):
            self.saved = saved

        def registerTimer(self, at):
            self.timer = at

        def getCurrentWatermarkInMs(self):
            return 15

    store = Store()
    job = jobs._StreamTracker(tracking.TrackerOptions(max_gap=100), 1.0)
    job.handle = job.state = store
    names = ["video_id", "class_name", "event_time", "event_ms", *tracking.Tracker.inputs]
    rows = [Row(*names)(1, "a", None, f, f, f / 10, f, 0.9, 0.0, 0.0, 9.0, 9.0, None, None, None) for f in (10, 12, 20)]
    done = list(job.handleInputRows((1, "a"), iter(rows), store))
    assert [(r.video_id, r.class_name, r.frame_idx, r.start_frame) for r in done] == [(1, "a", 10, 10), (1, "a", 12, 10)]
    assert store.asked == 1 and store.timer == 21
    assert [r[0] for r in pickle.loads(store.saved[0])[1]] == [20]
