"""Review edit replay with undo and redo, one state per image."""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.sequential import GROUP_LIMIT, fold_sorted

HISTORY_LIMIT = 100


@dataclass(frozen=True)
class ReviewBox:
    det_id: int
    class_name: str
    confidence: float
    box: tuple[float, float, float, float]
    confirmed: bool = False
    removed: bool = False
    source: str = "model"


@dataclass
class ReviewState:
    """Boxes are immutable and shared between snapshots, so history costs references only."""

    boxes: tuple[ReviewBox, ...] = ()
    past: list[tuple[ReviewBox, ...]] = field(default_factory=list)
    future: list[tuple[ReviewBox, ...]] = field(default_factory=list)
    edited: bool = False
    approved: bool = False
    loading: list[ReviewBox] = field(default_factory=list)
    last_seq: int = -1

    def load(self) -> None:
        """Append the boxes loaded since the last edit, in one step."""
        if self.loading:
            self.boxes, self.loading = (*self.boxes, *self.loading), []


OPS = (
    "model", "approve", "toggle", "undo", "redo", "add", "reset", "confirm", "remove", "restore",
    "reclass", "move", "resize", "set",
)
_CHANGES = {
    "confirm": lambda b, box, name: replace(b, confirmed=True),
    "remove": lambda b, box, name: replace(b, removed=True, confirmed=False),
    "restore": lambda b, box, name: replace(b, removed=False),
    "reclass": lambda b, box, name: replace(b, class_name=name, confirmed=False),
    "move": lambda b, box, name: replace(b, box=box, confirmed=False),
    "resize": lambda b, box, name: replace(b, box=box, confirmed=False),
    "set": lambda b, box, name: replace(b, box=box, confirmed=False),
}


def apply_event(
    state: ReviewState, op: str, det_id: int | None, box: tuple | None, name: str | None,
    confidence: float | None = None,
) -> None:
    """One event. `model` rows load detections; `reset` empties the review for a new detection;
    edits of unknown boxes and unknown operations are ignored (`unknown_events` lists the latter)."""
    if op == "model":
        state.loading.append(ReviewBox(det_id, name, confidence, box))
        return
    state.load()
    if op not in OPS:
        return
    if op == "reset":
        state.boxes, state.past, state.future = (), [], []
        state.edited = state.approved = False
        return
    if op in ("approve", "toggle"):
        state.approved = True if op == "approve" else not state.approved
        state.edited = True
        return
    if op == "undo":
        if not state.past:
            return
        state.future.insert(0, state.boxes)
        state.boxes = state.past.pop()
    elif op == "redo":
        if not state.future:
            return
        state.past.append(state.boxes)
        state.boxes = state.future.pop(0)
    else:
        if op == "add":
            new_id = max((b.det_id for b in state.boxes), default=0)
            added = ReviewBox(max(0, new_id) + 1, name, 1.0, box, confirmed=True, source="manual")
            after = (*state.boxes, added)
        else:
            change = _CHANGES[op]
            if all(b.det_id != det_id for b in state.boxes):
                return
            after = tuple(
                change(b, box, name) if b.det_id == det_id else b for b in state.boxes
            )
        state.past = [*state.past, state.boxes][-HISTORY_LIMIT:]
        state.future = []
        state.boxes = after
    state.edited, state.approved = True, False


class Replay:
    """Stepper: ordered events in, final boxes out."""

    inputs = ("seq", "op", "det_id", "class_name", "confidence", "x1", "y1", "x2", "y2")
    outputs = (
        ("det_id", "bigint"), ("class_name", "string"), ("confidence", "double"),
        ("x1", "double"), ("y1", "double"), ("x2", "double"), ("y2", "double"),
        ("confirmed", "boolean"), ("removed", "boolean"), ("source", "string"),
        ("edited", "boolean"), ("approved", "boolean"), ("undo_depth", "bigint"),
    )

    def begin(self) -> ReviewState:
        return ReviewState()

    def feed(self, state: ReviewState, row: tuple) -> list[tuple]:
        seq, op, det_id, name, confidence = row[:5]
        if seq >= 0:  # a number is applied once: edits may be delivered again
            if seq <= state.last_seq:
                return []
            state.last_seq = seq
        box = None if row[5] is None else tuple(row[5:9])
        apply_event(state, op, det_id, box, name, confidence)
        return []

    def finish(self, state: ReviewState) -> list[tuple]:
        state.load()
        tail = (state.edited, state.approved, len(state.past))
        return [
            (b.det_id, b.class_name, b.confidence, *b.box, b.confirmed, b.removed, b.source, *tail)
            for b in state.boxes
        ]

    def save(self, state: Any) -> bytes:
        return pickle.dumps(state)

    def load(self, saved: bytes) -> ReviewState:
        return pickle.loads(saved)


def unknown_events(events: DataFrame) -> DataFrame:
    """Events whose operation the replay does not know."""
    return events.filter(~F.coalesce(F.col("op").isin(*OPS), F.lit(False)))


def replay_reviews(
    detections: DataFrame, events: DataFrame, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """Final review boxes of every image.

    `detections` (image_id, det_id, class_name, confidence, box) load first, in `det_id` order;
    `events` (image_id, seq, op, det_id, class_name, box) follow in `seq` order; of several of one number
    the first counts.
    """
    loads = detections.select(
        "image_id", F.lit(-1).cast("long").alias("seq"), F.lit("model").alias("op"), "det_id",
        "class_name", "confidence", "x1", "y1", "x2", "y2",
    )
    edits = events.select(
        "image_id", F.col("seq").cast("long").alias("seq"), "op", "det_id", "class_name",
        F.lit(None).cast("double").alias("confidence"), "x1", "y1", "x2", "y2",
    )
    return fold_sorted(
        loads.unionByName(edits), ["image_id"], ["seq", "det_id"], Replay(), group_limit
    )
