"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads words: the bytes of a word and one white space that closes it, in parts of at most ``LONGEST`` bytes. A gated
recurrent layer runs over them from either side, and the two states at a byte give the probabilities of the languages at this position.
A document's are the means over all its positions. Training is backpropagation through time, written in numpy, on words drawn from
all of the texts of a bounded sample of labelled rows: ``ROWS`` of each language, of the ``LANGUAGES`` most frequent, ``PIECES`` words or so in all.

What a word gives depends on its bytes alone, so that each worker keeps what it found in a table of fixed size, by the words' bytes;
words that are not in it are run through the network once a batch, many at a time. Every byte of every text counts.

Defined cases: ``und`` with score 0 where the text is null or has no letter, and for all documents where nothing can be learnt (no row with a
``doc_id``, a language and a text outside the held-out ones); a null ``doc_id`` is never held out and never learnt from; rows that repeat are learnt
once and predicted each; white space in a row is one position; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempoframe.llm.labelled import held_out
from tempoframe.llm.memo_tokens import LONGEST, PieceTable, leaders
from tempoframe.llm.shared import bounded_batches, staged, text_or_empty
from tempoframe.llm.words import eights

FOLDS, FOLD = 5, 0
LANGUAGES, ROWS, PIECES = 256, 400, 200_000
HIDDEN, STEPS, BATCH, RATE = 16, 400, 512, 0.01
#: Places among which the rows of a language are dealt before its sample is drawn.
SALTS = 64
#: Words that a worker remembers.
ENTRIES = 600_000
#: Bytes of text that are looked up at once, and words that the network reads at once.
BLOCK, TOGETHER = 1 << 20, 1024
UNKNOWN = "und"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


# --- words ---


def pieces(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in a row with plain white space, and start, end and text of each part of a word; nine bytes lie behind the last."""
    raw = b"".join(t + b" " for t in texts)
    data = np.frombuffer(raw, np.uint8).copy()
    space = _SPACE[data]
    data[space] = 32
    ends = np.flatnonzero(space)
    ends = ends[(ends > 0) & ~space[np.maximum(ends - 1, 0)]]
    begins = np.flatnonzero(~space & np.append(True, space[:-1])) if len(data) else ends
    size = ends - begins + 1
    parts = -(-size // LONGEST)
    word = np.repeat(np.arange(len(size)), parts)
    low = begins[word] + LONGEST * (np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts))
    high = np.minimum(low + LONGEST, ends[word] + 1)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return data.tobytes() + bytes(LONGEST + 9), low, high, np.searchsorted(starts, low, "right") - 1


def keys_of(data: bytes, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bytes of each part and their number, as whole numbers."""
    size = high - low
    keys = np.empty((len(low), LONGEST // 8 + 1), np.uint64)
    for k in range(LONGEST // 8):
        keys[:, k] = eights(data, low + 8 * k, np.clip(size - 8 * k, 0, 8))
    keys[:, -1] = size
    return keys


def bytes_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A line of bytes for each part, and their number."""
    return np.ascontiguousarray(keys[:, :-1]).view(np.uint8).reshape(len(keys), LONGEST), keys[:, -1].astype(np.int64)


# --- the network ---


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Sequences:
    """Parts of words by falling length: how many are left at each step, and where each step's positions lie."""

    def __init__(self, data: np.ndarray, size: np.ndarray):
        self.order = np.argsort(-size, kind="stable")
        self.data, self.size = data[self.order], size[self.order]
        self.offset = np.cumsum(self.size) - self.size
        self.total, self.longest = int(self.size.sum()), int(self.size[0]) if len(size) else 0
        self.alive = [int(np.searchsorted(-self.size, -t)) for t in range(self.longest)]  # longer than t

    def step(self, t: int, backwards: bool) -> tuple[int, np.ndarray, np.ndarray]:
        """How many read on, the bytes they read and the numbers of these positions."""
        n = self.alive[t]
        at = self.size[:n] - 1 - t if backwards else np.full(n, t)
        return n, self.data[np.arange(n), at], self.offset[:n] + at


class Network:
    """Weights by name: for either side ``x`` (a row for each byte: update, reset and new state), ``u`` (from the state); ``w``, ``c``: to the languages."""

    def __init__(self, languages: int, hidden: int = HIDDEN, seed: int = 11, weights: dict[str, np.ndarray] | None = None):
        rng, self.hidden = np.random.default_rng(seed), hidden
        self.weights = weights or {
            name: (rng.standard_normal(shape) * scale).astype(np.float32)
            for name, shape, scale in (("x0", (256, 3 * hidden), 0.3), ("x1", (256, 3 * hidden), 0.3), ("u0", (hidden, 3 * hidden), hidden**-0.5), ("u1", (hidden, 3 * hidden), hidden**-0.5), ("w", (2 * hidden, languages), 0.1), ("c", (languages,), 0.0))
        }

    def _side(self, s: Sequences, side: int, states: np.ndarray, tape: list | None) -> None:
        h, x, u = self.hidden, self.weights[f"x{side}"], self.weights[f"u{side}"]
        state = np.zeros((len(s.size), h), np.float32)
        for t in range(s.longest):
            n, byte, at = s.step(t, bool(side))
            before = state[:n]
            given, own = x[byte], before @ u
            gates = _sigmoid(given[:, : 2 * h] + own[:, : 2 * h])
            update, reset = gates[:, :h], gates[:, h:]
            new = np.tanh(given[:, 2 * h :] + reset * own[:, 2 * h :])
            after = new + update * (before - new)
            states[at, side * h : (side + 1) * h] = after
            if tape is not None:
                tape.append((n, byte, at, before.copy(), update, reset, new, own[:, 2 * h :]))
            state[:n] = after

    def states(self, s: Sequences, tapes: tuple[list, list] | None = None) -> np.ndarray:
        out = np.empty((s.total, 2 * self.hidden), np.float32)
        for side in (0, 1):
            self._side(s, side, out, tapes[side] if tapes else None)
        return out

    def labels(self, states: np.ndarray) -> np.ndarray:
        """Probabilities at each position."""
        out = states @ self.weights["w"] + self.weights["c"]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)

    def gradients(self, data: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients: backpropagation through time on both sides."""
        s, tapes, h = Sequences(data, size), ([], []), self.hidden
        states = self.states(s, tapes)
        p, truth = self.labels(states), np.repeat(label[s.order], s.size)
        rows = np.arange(s.total)
        loss = float(-np.log(np.maximum(p[rows, truth], 1e-30)).mean())
        p[rows, truth] -= 1
        p /= s.total
        out = {"w": states.T @ p, "c": p.sum(axis=0)}
        back = p @ self.weights["w"].T
        for side in (0, 1):
            u = self.weights[f"u{side}"]
            dx, du, carry = np.zeros_like(self.weights[f"x{side}"]), np.zeros_like(u), np.zeros((len(s.size), h), np.float32)
            for n, byte, at, before, update, reset, new, own in reversed(tapes[side]):
                d = carry[:n] + back[at, side * h : (side + 1) * h]
                d_new = d * (1 - update) * (1 - new * new)
                d_update = d * (before - new) * update * (1 - update)
                d_reset = d_new * own * reset * (1 - reset)
                given = np.concatenate((d_update, d_reset, d_new), axis=1)
                through = np.concatenate((d_update, d_reset, d_new * reset), axis=1)
                np.add.at(dx, byte, given)
                du += before.T @ through
                carry[:n] = d * update + through @ u.T
            out[f"x{side}"], out[f"u{side}"] = dx, du
        return loss, out

    def pooled(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sums of the probabilities over the positions of each part."""
        out = np.empty((len(size), len(self.weights["c"])), np.float32)
        for at in range(0, len(size), TOGETHER):
            s = Sequences(data[at : at + TOGETHER], size[at : at + TOGETHER])
            out[at + s.order] = np.add.reduceat(self.labels(self.states(s)), s.offset, axis=0)
        return out


def trained(keys: np.ndarray, label: np.ndarray, languages: int, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, hidden: int = HIDDEN, seed: int = 11) -> Network:
    """Adam on batches that hold all languages alike."""
    net, rng = Network(languages, hidden, seed), np.random.default_rng(seed)
    of = [np.flatnonzero(label == k) for k in range(languages)]
    of = [x for x in of if len(x)]
    first, second = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in range(2))
    for step in range(1, steps + 1):
        some = np.concatenate([x[rng.integers(0, len(x), max(1, batch // len(of)))] for x in of])
        _, slope = net.gradients(*bytes_of(keys[some]), label[some])
        now = rate * min(1.0, step / 20) * (1 - step / (steps + 1))
        for k, g in slope.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.005 * (g * g - second[k])
            net.weights[k] = (net.weights[k] - now * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
    return net


# --- on a table ---


def learnt_words(docs: DataFrame, rows: int = ROWS, languages: int = LANGUAGES, most: int = PIECES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, keys and language number of words of a bounded sample of the rows that may be learnt from."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    fair = named.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(FOLDS, FOLD))
    known = sorted(r["lang"] for r in fair.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect())
    fair = fair.filter(F.col("lang").isin(known)).withColumn("tid", F.xxhash64("text"))
    order = [F.xxhash64(F.lit(29), "doc_id", "tid"), F.col("doc_id"), F.col("tid")]
    chosen = fair.select("doc_id", "tid", "lang", F.pmod(F.xxhash64(F.lit(31), "doc_id", "tid"), F.lit(SALTS)).alias("salt"))
    for keys in (["lang", "salt"], ["lang"]):  # in many places first, so that a frequent language does not meet in one
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        chosen = chosen.withColumn("place", place).filter(F.col("place") <= rows).drop("place")
    chosen = staged(chosen.drop("salt").distinct())
    texts = fair.join(F.broadcast(chosen), ["doc_id", "tid", "lang"]).dropDuplicates(["doc_id", "tid", "lang"])  # rows * languages at most
    each = max(8, most // max(1, chosen.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, doc, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                data, low, high, _ = pieces([text.encode("utf-8", "surrogatepass")])
                if len(low) > each:  # from all of the text
                    some = np.sort(np.random.default_rng(doc & 0xFFFFFFFF).choice(len(low), each, replace=False))
                    low, high = low[some], high[some]
                keys = keys_of(data, low, high)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([k.tobytes() for k in keys], pa.binary())], ["lang", "key"])

    found = texts.select("lang", "doc_id", "text").mapInArrow(run, "lang string, key binary").toArrow()
    lang, key = found.column(0).to_pylist(), found.column(1).to_pylist()
    order = sorted(range(len(key)), key=lambda i: (lang[i], key[i]))
    number = {x: k for k, x in enumerate(known)}
    keys = np.frombuffer(b"".join(key[i] for i in order), np.uint64).reshape(len(order), LONGEST // 8 + 1)
    return known, keys, np.array([number[lang[i]] for i in order], np.int64)


class Reader:
    """A worker's network and what it has found so far."""

    def __init__(self, weights: dict[str, np.ndarray], entries: int):
        languages = len(weights["c"])
        self.net, self.table = Network(languages, len(weights["u0"]), weights=weights), PieceTable(entries)
        self.found = np.zeros((entries, languages), np.float32)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over the positions of each text; zeros for one without any."""
        out = np.zeros((len(texts), self.found.shape[1]))
        data, low, high, text = pieces(texts)
        if not len(low):
            return out
        keys = keys_of(data, low, high)
        entry = self.table.find(keys)
        missing, values = np.flatnonzero(entry < 0), np.empty((len(keys), out.shape[1]), np.float32)
        values[entry >= 0] = self.found[entry[entry >= 0]]
        if len(missing):
            lead, back = leaders(keys[missing])
            lead = missing[lead]
            fresh = self.net.pooled(*bytes_of(keys[lead]))
            at = self.table.count
            put = self.table.add(keys[lead], np.ones(len(lead), np.int64), np.zeros(len(lead), np.uint32))
            self.found[at : at + put] = fresh[:put]
            values[missing] = fresh[back]
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(text, weights=values[:, k], minlength=len(texts))
        return out / np.maximum(np.bincount(text, weights=high - low, minlength=len(texts)), 1)[:, None]


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size > BLOCK:
            yield some
            some, size = [], 0
    if some:
        yield some


def languages(docs: DataFrame, rows: int = ROWS, steps: int = STEPS, entries: int = ENTRIES) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Rows whose crc32(doc_id as text) mod 5 is 0 are held out."""
    bounded_batches(docs.sparkSession)
    known, keys, label = learnt_words(docs, rows)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(FOLDS, FOLD).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("told"), text_or_empty().alias("text"))
    if not len(keys):
        return columns.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    weights = docs.sparkSession.sparkContext.broadcast(trained(keys, label, len(known), steps).weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(weights.value, entries)
        for b in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column(3).to_pylist()]
            p = np.concatenate([np.zeros((0, len(known))), *(reader.documents(some) for some in _blocks(texts))])
            told = b.column(2).to_numpy(zero_copy_only=False)
            best = p.argmax(axis=1)
            names = [known[k] if yes else UNKNOWN for k, yes in zip(best.tolist(), told.tolist(), strict=True)]
            score = np.where(told, np.minimum(p[np.arange(len(p)), best], 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return columns.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
