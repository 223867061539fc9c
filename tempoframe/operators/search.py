"""The best sequence of beats of a curve, searched in blocks of frames.

A state is a frame and the interval (``LOW`` to ``HIGH`` frames) that led to it; a step to the next beat costs by how much the interval changes. For each
frame and next interval ``worth`` says what the best state there brings to a beat so much later, and ``came`` which it was; where a worth is not above zero the next beat
starts a sequence of its own. Scores are whole numbers, 2**-40 each, so that no sum depends on where a track is cut.

A long track is cut into blocks, each a task. What a block needs of those before it are the worths of the last ``HIGH`` frames. It begins with a guess: what a run over the
``warm`` frames before it gives from nothing. Paths soon forget how they began, so that the guess is right but for one number added to all worths, which changes no
choice as long as no worth changes its sign. Both is checked: the worths a block began with against those the block before ended with, relative to their largest, and the
number against the worths nearest to zero. Blocks that fail are run again from what the block before found, until all agree; the first that fails in a track is then exact, so that this ends.
For the path each block tells where the ways that leave it entered it; these are followed from the best block back, and each block on the way gives its own frames.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempoframe.operators.kernels import Arrays, per_group, per_track
from tempoframe.sources.folders import written

UNITS = 1 << 40
LOW, HIGH, RIGIDITY, DOWNBEAT = 8, 60, 12.0, 0.15
NEVER = -(1 << 61)  # no such frame
START = 255  # nothing came before
BLOCK_FRAMES, WARM_FRAMES = 16_384, 3072
STEPS = np.arange(LOW, HIGH + 1)
K = len(STEPS)


def costs(rigidity: float = RIGIDITY) -> np.ndarray:
    """Of a next interval (row) after one (column)."""
    return np.rint(rigidity * np.abs(np.log(STEPS[:, None] / STEPS[None, :])) * UNITS).astype(np.int64)


def rewards(beats: np.ndarray, downbeats: np.ndarray | None = None, floor: float = 0.0, level: float | None = None) -> np.ndarray:
    """What a beat at each frame earns: its value over the curve's mean (or a level) and the floor, and a share of the downbeat's."""
    x = np.rint(np.asarray(beats, float) * UNITS).astype(np.int64)
    mean = np.rint(float(x.sum()) / len(x) if level is None else level * UNITS).astype(np.int64) if len(x) or level is not None else 0
    extra = 0
    if downbeats is not None:
        down = np.asarray(downbeats, float)[: len(x)]
        extra = np.rint(np.pad(down, (0, len(x) - len(down))) * DOWNBEAT * UNITS).astype(np.int64)
    return x - mean - np.rint(floor * UNITS).astype(np.int64) + extra


def nothing() -> np.ndarray:
    return np.full((HIGH, K), NEVER)


def run(reward: np.ndarray, before: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Worths (those of ``before`` first), came and scores of the frames; ``LOW`` of them at once, as none can follow another."""
    n = len(reward)
    worth, came, score = np.concatenate((before, np.empty((n, K), np.int64))), np.empty((n, K), np.uint8), np.empty((n, K), np.int64)
    for t in range(0, n, LOW):
        some = np.arange(t, min(t + LOW, n))
        score[some] = reward[some, None] + np.maximum(worth[HIGH + some[:, None] - STEPS, np.arange(K)], 0)
        ways = score[some][:, None, :] - cost
        best = ways.argmax(axis=2)
        worth[HIGH + some] = value = np.take_along_axis(ways, best[:, :, None], axis=2)[:, :, 0]
        came[some] = np.where(value > 0, best, START)
    return worth, came, score


def entered(came: np.ndarray, first: bool) -> np.ndarray:
    """For each frame and next interval, behind those of the block before (which are themselves): the place there that its way came from, -1 if it began here."""
    n = len(came)
    out = np.concatenate((np.full((HIGH, K), -1) if first else np.arange(HIGH * K).reshape(HIGH, K), np.empty((n, K), np.int64)))
    for t in range(0, n, LOW):
        some = np.arange(t, min(t + LOW, n))
        own = came[some]
        step = np.minimum(own, K - 1)
        out[HIGH + some] = np.where(own == START, -1, out[HIGH + some[:, None] - STEPS[step], step])
    return out


def trace(came: np.ndarray, t: int, i: int) -> list[int]:
    """Frames of the block on the way back from state (t, i), latest first."""
    path = []
    while t >= 0:
        path.append(t)
        t -= STEPS[i]
        if t >= 0:
            i = came[t, i]
            if i == START:
                break
    return path


def best_path(beats: np.ndarray, downbeats: np.ndarray | None = None, rigidity: float = RIGIDITY, floor: float = 0.0, level: float | None = None) -> np.ndarray:
    """Frames of the best sequence of a whole curve."""
    if len(beats) <= LOW:
        return np.zeros(0, int)
    _, came, score = run(rewards(beats, downbeats, floor, level), nothing(), costs(rigidity))
    return np.array(trace(came, *np.unravel_index(int(np.argmax(score)), score.shape))[::-1], int)


class PathState:
    """The search while frames come in, over a given level: what no later frame can change is given out and forgotten.

    Ways that may still win are the best so far and those that a coming beat can follow. Where all of them lead through one state, the path up to it
    is settled. As long as a coming beat may as well start anew nothing is; once much has been earned no worth lies below zero, and what is kept
    stays as short as the time that ways take to meet. (Settled frames stay given out even if silence then uses up all that was earned and a new sequence wins.)
    """

    def __init__(self, rigidity: float = RIGIDITY):
        self.cost, self.worth = costs(rigidity), nothing()
        self.came, self.base = np.zeros((0, K), np.uint8), 0  # of the frames from ``base`` on
        self.root: tuple[int, int] | None = None  # the state through which all ways lead
        self.best: tuple[int, int, int] | None = None  # score, frame, interval

    def add(self, reward: np.ndarray) -> list[int]:
        """Frames that are settled now, in order."""
        if not len(reward):
            return []
        start = self.base + len(self.came)
        worth, came, score = run(np.asarray(reward, np.int64), self.worth, self.cost)
        self.worth, self.came = worth[-HIGH:], np.concatenate((self.came, came))
        at = int(np.argmax(score))
        if self.best is None or score.reshape(-1)[at] > self.best[0]:
            self.best = (int(score.reshape(-1)[at]), start + at // K, at % K)
        meeting = self._meeting()
        if meeting is None or meeting == self.root:
            return []
        out = self._back(*meeting)
        self.root = meeting
        self.came, self.base = self.came[meeting[0] - self.base :], meeting[0]
        return out

    def finish(self) -> list[int]:
        """The rest of the best path."""
        return self._back(*self.best[1:]) if self.best and self.base + len(self.came) > LOW and self.best[1:] != self.root else []

    def _before(self, t: int, i: int) -> tuple[int, int] | None:
        s = t - int(STEPS[i])
        if s < self.base or (f := int(self.came[s - self.base, i])) == START:
            return None
        return s, f

    def _back(self, t: int, i: int) -> list[int]:
        """The frames of the way to a state behind the root, in order."""
        out, at = [], (t, i)
        while at is not None and at != self.root:
            out.append(at[0])
            at = self._before(*at)
        return out[::-1]

    def _meeting(self) -> tuple[int, int] | None:
        now, alive = self.base + len(self.came), {self.best[1:]}
        for s in range(max(self.base, now - HIGH), now):
            coming = np.flatnonzero(STEPS + s >= now)
            ways = self.came[s - self.base, coming]
            if (ways == START).any():
                return None
            alive |= {(s, int(f)) for f in np.unique(ways)}
        while len(alive) > 1:  # the latest state gives way to the one before it
            last = max(alive)
            alive.remove(last)
            before = self._before(*last)
            if before is None:
                return None
            alive.add(before)
        return alive.pop()


# --- in blocks ---

DONE = "track_id long, block int, start_kind long, start_level long, end_kind long, end_level long, under long, over long, best long, best_at int, best_entry int, end binary, came binary, entry binary, frames binary"


def _kind(worth: np.ndarray) -> tuple[int, int]:
    """A number for the worths relative to their largest, and the largest."""
    level = int(worth.max()) if (worth != NEVER).any() else 0
    digest = hashlib.blake2b(np.where(worth == NEVER, NEVER, worth - level).tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True), level


def solved(f: Arrays, cost: np.ndarray) -> Arrays:
    """A block's line of DONE from rows by place: a state to begin with, or frames before the block, then its frames."""
    given = f["state"][0] is not None
    rows = slice(1, None) if given else slice(None)
    own = f["own"][rows]
    reward, first = f["reward"][rows].astype(np.int64), bool(f["place"][rows][own][0] == 0)
    if given:
        before = np.frombuffer(f["state"][0], np.int64).reshape(HIGH, K)
    else:
        before = run(reward[~own], nothing(), cost)[0][-HIGH:] if (~own).any() else nothing()
    worth, came, score = run(reward[own], before, cost)
    at = int(np.argmax(score))
    t, i = divmod(at, K)
    entry = entered(came, first)
    known = worth[worth != NEVER]
    under, over = known[known <= 0], known[known > 0]
    one = {
        "start_kind": _kind(before)[0], "start_level": _kind(before)[1], "end_kind": _kind(worth[-HIGH:])[0], "end_level": _kind(worth[-HIGH:])[1],
        "under": under.max(initial=NEVER), "over": over.min(initial=-NEVER), "best": score.reshape(-1)[at], "best_at": at, "best_entry": entry[HIGH + t - STEPS[i], i],
        "end": worth[-HIGH:].tobytes(), "came": came.tobytes(), "entry": entry[-HIGH:].astype(np.int32).tobytes(), "frames": f["frame"][rows][own].astype(np.int64).tobytes(),
    }
    return {k: np.array([v], dtype=object if isinstance(v, bytes) else None) for k, v in one.items()}


def checked(done: DataFrame) -> DataFrame:
    """``done`` with shift (what its numbers lack) and agrees: whether all it began with is what the block before ended with."""
    w = Window.partitionBy("track_id").orderBy("block")
    step = F.coalesce(F.lag("end_level").over(w) - F.col("start_level"), F.lit(0))
    rows = done.withColumn("shift", F.sum(step).over(w)).withColumn("same", F.coalesce(F.lag("end_kind").over(w) == F.col("start_kind"), F.lit(True)))
    signs = (F.col("under") + F.col("shift") <= 0) & (F.col("over") + F.col("shift") > 0)
    return rows.withColumn("agrees", F.col("same") & ((F.col("shift") == 0) | signs)).drop("same")


def blocked_path(rows: DataFrame, rigidity: float = RIGIDITY, block_frames: int = BLOCK_FRAMES, warm: int = WARM_FRAMES) -> tuple[DataFrame, int]:
    """rows: track_id, place (0, 1, ... in a track), frame, reward, n (frames of the track). (track_id, frame of the best path; rounds it took)."""
    spark, cost, size = rows.sparkSession, costs(rigidity), max(block_frames, HIGH)
    blocks = F.greatest(F.floor(F.col("n") / size), F.lit(1)).cast("int")  # the last one is longer
    own = F.least(F.floor(F.col("place") / size).cast("int"), blocks - 1)
    warms = (own + 1 < blocks) & (F.col("place") >= (own + 1) * size - warm)
    lines = rows.filter(F.col("n") > LOW).withColumn("of", own)
    lines = written(lines.withColumn("block", F.explode(F.when(warms, F.array("of", F.col("of") + 1)).otherwise(F.array("of")))).select("track_id", "block", "place", "frame", "reward", (F.col("block") == F.col("of")).alias("own")))
    state = F.lit(None).cast("binary").alias("state")
    kernel = lambda f: solved(f, cost)
    done, rounds = written(per_group(lines.select("*", state), ("track_id", "block"), kernel, DONE, "place")), 1
    while True:
        told = checked(done)
        wrong = written(_to_repeat(told))
        if wrong.isEmpty():
            break
        begin = wrong.select("track_id", "block", F.lit(-1).cast(lines.schema["place"].dataType).alias("place"), F.lit(-1).cast(lines.schema["frame"].dataType).alias("frame"), F.lit(0).cast("long").alias("reward"), F.lit(True).alias("own"), "state")
        again = lines.filter("own").join(wrong.select("track_id", "block"), ["track_id", "block"], "left_semi").select("*", state).unionByName(begin)
        fresh = per_group(again, ("track_id", "block"), kernel, DONE, "place")
        done, rounds = written(done.join(wrong.select("track_id", "block"), ["track_id", "block"], "left_anti").unionByName(fresh)), rounds + 1

    def ways(f: Arrays) -> Arrays:
        """From the best block back: the blocks that are met, and where."""
        best = int(np.argmax(f["best"] + f["shift"]))
        block, at, is_state, entry = [best], [int(f["best_at"][best])], [True], int(f["best_entry"][best])
        while entry >= 0:
            best -= 1
            block.append(best)
            at.append(entry)
            is_state.append(False)
            entry = int(np.frombuffer(f["entry"][best], np.int32)[entry])
        return {"block": np.array(block), "at": np.array(at), "is_state": np.array(is_state)}

    met = per_track(told.select("track_id", "block", "best", "shift", "best_at", "best_entry", "entry"), ways, "block int, at int, is_state boolean", "block")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for track, at, is_state, came, own in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                own, came = np.frombuffer(own, np.int64), np.frombuffer(came, np.uint8).reshape(-1, K)
                t, i = divmod(at, K)
                if not is_state:  # a place among the last frames, and the interval after it
                    t += len(own) - HIGH
                    i = came[t, i]
                path = own[trace(came, t, i)] if i != START else own[:0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(path), track)), pa.array(path.astype(np.int32))], ["track_id", "frame"])

    return met.join(done.select("track_id", "block", "came", "frames"), ["track_id", "block"]).select("track_id", "at", "is_state", "came", "frames").mapInArrow(frames, "track_id long, frame int"), rounds


def _to_repeat(told: DataFrame) -> DataFrame:
    """track_id, block, state: blocks that do not agree, and what the block before ended with by now."""
    w = Window.partitionBy("track_id").orderBy("block")
    lines = told.select("track_id", "block", "agrees", F.lag("end").over(w).alias("end"), F.lag("shift").over(w).alias("shift")).filter("NOT agrees")

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [np.frombuffer(e, np.int64) for e in b.column(2).to_pylist()]
            states = [np.where(e == NEVER, NEVER, e + s).tobytes() for e, s in zip(ends, b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(states, pa.binary())], ["track_id", "block", "state"])

    return lines.select("track_id", "block", "end", "shift").mapInArrow(shifted, "track_id long, block int, state binary")


def reward_rows(activation: DataFrame, floor: float = 0.0, downbeat: str | None = None, value: str = "x", level: float | None = None) -> DataFrame:
    """track_id, place, frame, reward, n of a curve: ``rewards`` as columns."""
    whole = Window.partitionBy("track_id")
    rows = activation.select("track_id", F.col("frame").cast("int").alias("frame"), F.rint(F.col(value).cast("double") * UNITS).cast("long").alias("x"), (F.rint(F.coalesce(F.col(downbeat).cast("double"), F.lit(0.0)) * DOWNBEAT * UNITS).cast("long") if downbeat else F.lit(0).cast("long")).alias("extra"))
    rows = rows.select("*", (F.row_number().over(whole.orderBy("frame")) - 1).alias("place"), F.count(F.lit(1)).over(whole).alias("n"), F.sum("x").over(whole).alias("total"))
    mean = F.rint(F.col("total").cast("double") / F.col("n")).cast("long") if level is None else F.lit(round(level * UNITS)).cast("long")
    return rows.select("track_id", "place", "frame", (F.col("x") - mean - F.lit(int(np.rint(floor * UNITS))).cast("long") + F.col("extra")).alias("reward"), "n")


def searched_path(activation: DataFrame, rigidity: float = RIGIDITY, floor: float = 0.0, downbeat: str | None = None, value: str = "x", level: float | None = None, block_frames: int = BLOCK_FRAMES, warm: int = WARM_FRAMES) -> DataFrame:
    """track_id, frame: the best sequence of beats of the whole curve, or of what exceeds a given ``level`` instead of its mean."""
    return blocked_path(reward_rows(activation, floor, downbeat, value, level), rigidity, block_frames, warm)[0]
