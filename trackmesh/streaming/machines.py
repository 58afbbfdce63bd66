"""Machines for `fold`: ingest gate, frame queue, lifecycle, tracker, smoother, line and polygon zones, first hits."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from trackmesh.streaming.fold import runs_of

BOX = ["left", "top", "right", "bottom"]


def _opt(value):
    """None for a missing value."""
    return None if value is None or pd.isna(value) else value


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of a with every box of b; 0 where both have no area."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.clip(high - low, 0, None).prod(axis=2)
    size = lambda r: (r[:, 2:] - r[:, :2]).prod(axis=1)
    union = size(a)[:, None] + size(b)[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def as_tuples(columns: list) -> list[tuple]:
    """Rows of output columns, with None for what is missing."""
    return list(zip(*([None if v is pd.NA else v for v in c.tolist()] for c in columns), strict=True))


# --- ingest ---------------------------------------------------------------------------------------------------------------


@dataclass
class Gate:
    """Frames of a source in the order they came: accept, drop, reject_late or reject_out_of_order.

    A frame more than ``max_lateness_ns`` behind the watermark is late; one less far behind is out of order. The
    watermark is the time of the last accepted frame, so an accepted late frame moves it back. A row whose ``control``
    is 'added', 'removed', 'reconnected' or 'reset' clears it and has the decision 'control'.
    """

    late: str = "reject"
    out_of_order: str = "reject"
    max_lateness_ns: int = 0
    fields: str = "arrival long, pts_ns long, decision string, watermark_ns long"

    def start(self) -> dict:
        return {"high": None}

    def feed(self, state: dict, rows: pd.DataFrame) -> list[tuple]:
        out = []
        control = rows["control"] if "control" in rows else [None] * len(rows)
        for arrival, pts, event in zip(rows["arrival"], rows["pts_ns"], control, strict=True):
            if _opt(event) is not None:
                state["high"], decision = None, "control"
            else:
                decision = self.decide(state["high"], int(pts))
                if decision == "accept":
                    state["high"] = int(pts)
            out.append((int(arrival), int(pts), decision, state["high"]))
        return out

    def decide(self, high: int | None, pts: int) -> str:
        if high is None or pts >= high:
            return "accept"
        policy, name = (self.late, "reject_late") if high - pts > self.max_lateness_ns else (self.out_of_order, "reject_out_of_order")
        return name if policy == "reject" else policy


@dataclass
class Queue:
    """Pushes ('push') and drains ('drain', ``n`` frames, null for all) of a bounded queue in order; what becomes of each frame.

    When the queue is full, 'reject_new' and 'drop_newest' turn the new frame away, 'drop_oldest' the first one. A depth
    of 0 is no bound.
    """

    depth: int = 64
    policy: str = "reject_new"
    fields: str = "arrival long, outcome string, queued long"

    def start(self) -> list[int]:
        return []

    def feed(self, state: list[int], rows: pd.DataFrame) -> list[tuple]:
        out = []
        for arrival, action, n in zip(rows["arrival"], rows["action"], rows["n"], strict=True):
            if action == "drain":
                taken = state[: None if _opt(n) is None else int(n)]
                del state[: len(taken)]
                out += [(a, "drained", len(state)) for a in taken]
                continue
            if self.depth and len(state) >= self.depth:
                if self.policy != "drop_oldest":
                    out.append((int(arrival), "rejected" if self.policy == "reject_new" else "dropped", len(state)))
                    continue
                out.append((state.pop(0), "dropped", len(state) + 1))
            state.append(int(arrival))
            out.append((int(arrival), "queued", len(state)))
        return out


@dataclass
class FirstHits:
    """A cursor: every key (a subject of a source) is given once, with the first sample that showed it."""

    fields: str = "sample_id long"

    def start(self) -> list[bool]:
        return [False]

    def feed(self, state: list[bool], rows: pd.DataFrame) -> list[tuple]:
        known, state[0] = state[0], True
        return [] if known else [(int(rows["sample_id"].iloc[0]),)]


# --- tracking -------------------------------------------------------------------------------------------------------------

#: Fixed values of the motion model, in the order centre x, centre y, aspect, height, and their velocities. A first entry
#: multiplies the height (0 where the value does not scale with it), a second is a plain value.
FIRST_STD = np.array([(2, 0), (2, 0), (0, 1e-2), (2, 0), (10, 0), (10, 0), (0, 1e-5), (10, 0)], float)
STEP_VAR = np.array([(1, 0), (1, 0), (0, 1e-4), (1, 0), (1, 0), (1, 0), (0, 1e-8), (1, 0)], float)
SEEN_VAR = np.array([(0.01, 0), (0.01, 0), (0, 1e-2), (0.01, 0)], float)
LEAST_VAR, LEAST_SIDE = 1e-6, 1e-3
#: What a track is, in the order of preference on ties.
TRACKED, NEW, LOST = 0, 1, 2
#: Places of a track's values: mean and variance of the motion, then these.
MEAN, VAR, ID, PHASE, SCORE, CLS, IDLE, VALUES = slice(0, 8), slice(8, 16), 16, 17, 18, 19, 20, 21


@dataclass
class Tracks:
    """All live tracks of a source: a row for each value, a column for each track, in the order of their start; class -1 is none."""

    rows: np.ndarray = field(default_factory=lambda: np.zeros((VALUES, 0)))
    next_id: int = 1


def to_state(boxes: np.ndarray) -> np.ndarray:
    """Centre x, centre y, width by height, and height of boxes."""
    side = np.maximum(boxes[:, 2:] - boxes[:, :2], LEAST_SIDE)
    return np.column_stack([boxes[:, :2] + side / 2, side[:, 0] / side[:, 1], side[:, 1]])


def to_boxes(mean: np.ndarray) -> np.ndarray:
    h = np.maximum(np.abs(mean[:, 3]), LEAST_SIDE)
    half = np.column_stack([np.maximum(np.abs(mean[:, 2]), LEAST_SIDE) * h, h]) / 2
    return np.hstack([mean[:, :2] - half, mean[:, :2] + half])


def greedy_pairs(overlap: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """One-to-one rows and columns over the threshold, best first; ties go to the lower row, then column."""
    rows, cols = np.nonzero(overlap > threshold)
    if not len(rows):
        return [], []
    used_r, used_c = {}, set()
    for _, r, c in sorted(zip((-overlap[rows, cols]).tolist(), rows.tolist(), cols.tolist(), strict=True)):
        if r not in used_r and c not in used_c:
            used_r[r] = c
            used_c.add(c)
    return list(used_r), list(used_r.values())


class Seen:
    """The boxes of some frames, and what tracks take from each, made for all at once."""

    def __init__(self, boxes: np.ndarray, score: np.ndarray, cls: np.ndarray) -> None:
        self.boxes, self.area, self.score, self.cls = boxes.T.copy(), (boxes[:, 2:] - boxes[:, :2]).prod(axis=1), score, cls
        first = to_state(boxes)
        self.state = first.T.copy()
        self.spread = np.maximum(SEEN_VAR[:, 0] * first[:, 3:4] ** 2 + SEEN_VAR[:, 1], LEAST_VAR).T.copy()
        std = FIRST_STD[:, 0] * first[:, 3:4] + FIRST_STD[:, 1]
        self.born = np.zeros((VALUES, len(boxes)))
        self.born[:4], self.born[VAR], self.born[PHASE], self.born[SCORE], self.born[CLS] = self.state, np.maximum(std**2, LEAST_VAR).T, NEW, score, cls


@dataclass
class Tracker:
    """Two-stage association of boxes with constant-velocity tracks, frame by frame.

    Boxes of at least ``high`` are matched to all live tracks (confirmed, new, lost, in this order of preference on
    ties), those of at least ``low`` to what is left; an unmatched box of at least ``activate`` starts a track, given out
    at once. A lost track is forgotten after ``max_lost`` frames. A frame without boxes is a row of null sides.
    """

    high: float = 0.5
    activate: float = 0.6
    low: float = 0.1
    match: float = 0.8
    max_lost: int = 30
    class_aware: bool = False
    order_by: str = "frame_index"
    fields: str = "frame_index long, track_id long, left double, top double, right double, bottom double, score double, class_id int"

    def __post_init__(self) -> None:
        if not all(0 <= v <= 1 for v in (self.high, self.activate, self.low, self.match)) or self.low > self.high or self.max_lost < 1:
            raise ValueError("thresholds lie in 0 to 1, low is not over high, and max_lost is positive")

    def start(self) -> Tracks:
        return Tracks()

    def feed(self, state: Tracks, rows: pd.DataFrame) -> list[tuple]:
        return as_tuples(self.feed_columns(state, rows))

    def feed_columns(self, state: Tracks, rows: pd.DataFrame) -> list:
        frames, boxes, score = rows[self.order_by].to_numpy(np.int64), rows[BOX].to_numpy(float), rows["score"].to_numpy(float)
        cls = pd.to_numeric(rows["class_id"]).fillna(-1).to_numpy(np.int64)
        there = ~np.isnan(boxes).any(axis=1)
        starts = np.flatnonzero(np.diff(frames, prepend=frames[:1] - 1) != 0)
        upto = np.concatenate(([0], np.cumsum(there)))[[*starts.tolist(), len(frames)]].tolist()
        boxes, score, cls = boxes[there], score[there], cls[there]
        seen, strong, weak = Seen(boxes, score, cls), score >= self.high, (score < self.high) & (score >= self.low)
        starts_track, some_weak = score >= max(self.high, self.activate), bool(weak.any())
        none, out = np.zeros(0, np.int64), []
        for a, b in zip(upto[:-1], upto[1:], strict=True):
            out.append(self.step(state, seen, a + np.flatnonzero(strong[a:b]), a + np.flatnonzero(weak[a:b]) if some_weak else none, starts_track, a, b))
        told = np.concatenate(out, axis=1) if out else np.zeros((VALUES, 0))
        classes = told[CLS].astype(np.int64)
        return [np.repeat(frames[starts], [o.shape[1] for o in out]), told[ID].astype(np.int64), *to_boxes(told[:4].T).T, told[SCORE], pd.arrays.IntegerArray(classes, classes < 0)]

    def step(self, t: Tracks, seen: Seen, strong: np.ndarray, weak: np.ndarray, starts_track: np.ndarray, a: int, b: int) -> np.ndarray:
        """Go on by a frame, whose boxes are those from a to below b of seen; the columns of tracks to give out."""
        rows = t.rows
        rows[:4] += rows[4:8]
        tall = np.maximum(np.abs(rows[3]), 1.0) ** 2
        var = rows[VAR]
        var += STEP_VAR[:, :1] * tall + STEP_VAR[:, 1:]
        np.maximum(var, LEAST_VAR, out=var)
        rows[IDLE] += 1

        free = starts_track[a:b].copy()
        pool = np.argsort(rows[PHASE], kind="stable")
        matched, taken = self.associate(rows, pool, strong, seen)
        free[[i - a for i in taken]] = False
        if len(weak):
            left = np.ones(rows.shape[1], bool)
            left[matched] = False
            matched = [*matched, *self.associate(rows, pool[left[pool]], weak, seen)[0]]
        rows[PHASE] = LOST
        rows[PHASE, matched] = TRACKED

        if rows.shape[1] and rows[IDLE].max() > self.max_lost:
            rows = rows[:, rows[IDLE] <= self.max_lost]
        born = a + np.flatnonzero(free)
        if len(born):
            new = seen.born[:, born]
            new[ID] = t.next_id + np.arange(len(born))
            t.next_id += len(born)
            rows = np.concatenate((rows, new), axis=1)
        t.rows = rows
        return rows[:, rows[PHASE] != LOST]

    def associate(self, rows: np.ndarray, pool: np.ndarray, dets: np.ndarray, seen: Seen) -> tuple[list[int], list[int]]:
        """Match and correct tracks of the pool; returns them, and the boxes taken."""
        if not len(pool) or not len(dets):
            return [], []
        x, y, wide, tall = rows[:4, pool]
        tall = np.maximum(np.abs(tall), LEAST_SIDE)
        half_x, half_y = np.maximum(np.abs(wide), LEAST_SIDE) * tall / 2, tall / 2
        left, top, right, bottom = x - half_x, y - half_y, x + half_x, y + half_y
        box = seen.boxes[:, dets]
        across = np.minimum(right[:, None], box[2]) - np.maximum(left[:, None], box[0])
        down = np.minimum(bottom[:, None], box[3]) - np.maximum(top[:, None], box[1])
        inter = np.maximum(across, 0) * np.maximum(down, 0)
        union = ((right - left) * (bottom - top))[:, None] + seen.area[dets] - inter
        overlap = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
        if self.class_aware:
            overlap = np.where(rows[CLS, pool][:, None] == seen.cls[dets], overlap, -1.0)
        who, what = greedy_pairs(overlap, self.match)
        if not who:
            return [], []
        who, what = pool[who], dets[what]
        gap = seen.state[:, what] - rows[:4, who]
        var = rows[VAR, who]
        spread = var[:4] + seen.spread[:, what]
        gain = np.concatenate((var[:4] / spread, var[4:] / (var[4:] + spread)))
        rows[MEAN, who] += gain * np.concatenate((gap, gap))
        rows[VAR, who] = np.maximum((1 - gain) * var, LEAST_VAR)
        cls = seen.cls[what]
        rows[SCORE, who], rows[IDLE, who], rows[CLS, who] = seen.score[what], 0, np.where(cls >= 0, cls, rows[CLS, who])
        return who.tolist(), what.tolist()


@dataclass
class Smoother:
    """Exponentially smoothed boxes by track; a track that is missing stays for ``max_missed`` frames."""

    alpha: float = 0.5
    max_missed: int = 5
    fields: str = "frame_index long, track_id long, left double, top double, right double, bottom double, score double, class_id int"

    def start(self) -> dict:
        none = np.zeros(0, np.int64)
        return {"frames": 0, "track": none, "at": none, "cls": none, "box": np.zeros((0, 5))}

    def feed(self, state: dict, rows: pd.DataFrame) -> list[tuple]:
        return as_tuples(self.feed_columns(state, rows))

    def feed_columns(self, state: dict, rows: pd.DataFrame) -> list:
        """Tracks side by side: their first rows, then their second ones, and so on; frames are counted from the first of the source."""
        begin, kept = state["frames"], len(state["track"])
        frames = rows["frame_index"].to_numpy(np.int64)
        fresh = np.diff(frames, prepend=frames[:1] - 1) != 0
        at, names = begin + np.cumsum(fresh) - 1, frames[fresh]
        end = begin + len(names)
        ids, values = rows["track_id"].to_numpy(float, na_value=np.nan), rows[[*BOX, "score"]].to_numpy(float)
        seen = ~(np.isnan(ids) | np.isnan(values[:, :4]).any(axis=1))
        track = np.concatenate((state["track"], rows["track_id"].to_numpy()[seen].astype(np.int64)))
        at, box = np.concatenate((state["at"], at[seen])), np.concatenate((state["box"], values[seen]))
        cls = np.concatenate((state["cls"], pd.to_numeric(rows["class_id"]).fillna(-1).to_numpy(np.int64)[seen]))
        order = np.argsort(track, kind="stable")  # what is kept comes first, then rows in their order
        track, at, box, cls = track[order], at[order], box[order], cls[order]
        same = np.diff(track, prepend=track[:1] - 1) == 0
        follows = same & (np.diff(at, prepend=at[:1]) <= self.max_missed + 1)
        first = np.flatnonzero(~follows)
        turn = np.arange(len(track)) - np.repeat(first, np.diff(np.append(first, len(track))))
        by_turn = np.argsort(turn, kind="stable")
        bounds = np.searchsorted(turn[by_turn], np.arange(1, turn.max(initial=0) + 2)).tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            i = by_turn[a:b]
            box[i] = box[i - 1] * (1 - self.alpha) + box[i] * self.alpha
            cls[i] = np.where(cls[i] >= 0, cls[i], cls[i - 1])
        last = np.append(~same[1:], True)[: len(track)]
        until = np.minimum(at + self.max_missed + 1, end)
        until[:-1] = np.where(last[:-1], until[:-1], np.minimum(until[:-1], at[1:]))
        since = np.maximum(at, begin)
        n = np.maximum(until - since, 0)
        which = np.repeat(np.arange(len(track)), n)
        when = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + since[which]
        told = np.lexsort((track[which], when))
        which, when = which[told], when[told]
        on = last & (at + self.max_missed >= end - 1)
        state |= {"frames": end, "track": track[on], "at": at[on], "cls": cls[on], "box": box[on]}
        return [names[when - begin], track[which], *box[which].T, pd.arrays.IntegerArray(cls[which], cls[which] < 0)]


# --- zones ----------------------------------------------------------------------------------------------------------------


def _turn(a: tuple, b: tuple, p: tuple) -> int:
    """1 left of the line from a to b, -1 right of it, 0 on it."""
    v = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    return (v > 0) - (v < 0)


def _meet(a: tuple, b: tuple, c: tuple, d: tuple) -> bool:
    """Whether closed segments share a point."""
    s = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    if s[0] * s[1] < 0 and s[2] * s[3] < 0:
        return True
    between = lambda p, q, r: min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    ends = zip(s, ((a, b, c), (a, b, d), (c, d, a), (c, d, b)), strict=True)
    return any(side == 0 and between(*e) for side, e in ends)


@dataclass
class LineZone:
    """Crossings of a directed segment: the last side off the line changes, and the last step meets the segment."""

    start_point: tuple[float, float]
    end_point: tuple[float, float]
    fields: str = "sample_id long, track_id long, direction string"

    def start(self) -> dict[int, tuple]:
        return {}

    def feed(self, state: dict[int, tuple], rows: pd.DataFrame) -> list[tuple]:
        out = []
        for sample, track, x, y in zip(rows["sample_id"], rows["track_id"], rows["x"], rows["y"], strict=True):
            point = (float(x), float(y))
            side = _turn(self.start_point, self.end_point, point)
            before, last = state.get(int(track), (None, 0))
            if before is not None and side * last < 0 and _meet(self.start_point, self.end_point, before, point):
                out.append((int(sample), int(track), "left_to_right" if last > 0 else "right_to_left"))
            state[int(track)] = (point, side or last)
        return out


@dataclass
class ZoneAnalytics:
    """Entries and exits confirmed by streaks, dwell times and occupancy of a zone; rows tell whether they are ``inside``.

    A row whose ``inside`` is null is a missed frame of its track; each one beyond ``miss_tolerance`` in a row counts as
    outside.
    """

    enter_after: int = 1
    exit_after: int = 1
    miss_tolerance: int = 0
    class_filter: int | None = None
    fields: str = "sample_id long, track_id long, event string, duration_ns long, visits long, occupancy long"

    def start(self) -> dict:
        return {"tracks": {}, "occupancy": 0}

    def feed(self, state: dict, rows: pd.DataFrame) -> list[tuple]:
        out: list[tuple] = []
        classes = rows["class_id"] if self.class_filter is not None else [None] * len(rows)
        for sample, track, inside, now, cls in zip(rows["sample_id"], rows["track_id"], rows["inside"], rows["pts_ns"], classes, strict=True):
            if self.class_filter is not None and cls != self.class_filter:
                continue
            e = state["tracks"].setdefault(int(track), {"in": 0, "out": 0, "missed": 0, "since": None, "visits": 0})
            missing = _opt(inside) is None
            e["missed"] = e["missed"] + 1 if missing else 0
            if not missing or e["missed"] > self.miss_tolerance:
                e["in"], e["out"] = (e["in"] + 1, 0) if not missing and inside else (0, e["out"] + 1)
            at = (int(sample), int(track))
            if e["since"] is None and e["in"] >= self.enter_after:
                e["since"] = int(now)
                state["occupancy"] += 1
                out += [(*at, "entered", None, None, None), (*at, "dwell_started", None, None, None), (*at, "occupancy_changed", None, None, state["occupancy"])]
            elif e["since"] is not None and e["out"] >= self.exit_after:
                e["visits"] += 1
                state["occupancy"] -= 1
                ended = (*at, "dwell_ended", int(now) - e["since"], e["visits"], None)
                out += [(*at, "exited", None, None, None), ended, (*at, "occupancy_changed", None, None, state["occupancy"])]
                e["since"] = None
        return out
