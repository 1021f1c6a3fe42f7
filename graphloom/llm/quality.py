"""Quality of a text by a generalised additive model with pairwise interactions.

Every text becomes a few numbers that do not depend on its language: shares of kinds of characters, of repeated words and
lines, lengths. The model adds one looked-up value per number and one per chosen pair of numbers. The tables are learned by
cyclic boosting: each round fits a tree of a few leaves to the residuals along one number after the other, and adds it to
that number's table; then the pairs that explain most of what is left get trees of two cuts in the same way. So the whole
model is a set of tables, which can be read, and a batch of texts is scored by adding entries of them.

The numbers are taken from all texts in one pass of Spark tasks. The fit alone works on a bounded sample of labels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import write_table
from .common import map_batches, pieces

#: The fit takes about so many labelled documents (those with the smallest hashes of their ids), however many there are.
SAMPLE = 20_000
BINS, PAIR_BINS = 32, 8
LEAVES, PAIRS = 4, 8
ROUNDS, PAIR_ROUNDS, PATIENCE = 200, 60, 15
RATE, RIDGE, LEAST = 0.1, 1.0, 5.0
#: Characters that are looked at together; a window ends at white space.
WINDOW = 1 << 20
THRESHOLD = 0.3

NAMES = (
    "characters", "words", "word_length", "upper", "letters", "digits", "sentence_marks", "other_marks", "exclamations", "distinct",
    "said_again", "top_word", "no_letters", "capitalised", "sentence_length", "short", "ends_in_mark", "repeated_lines", "line_length", "beyond_ascii",
)
OTHER, LOWER, UPPER, DIGIT, SPACE, MARK = range(6)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Kind of each code point."""
    import unicodedata

    of = {"Ll": LOWER, "Lo": LOWER, "Lm": LOWER, "Lt": UPPER, "Lu": UPPER, "Mn": LOWER, "Mc": LOWER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT, "Zs": SPACE, "Zl": SPACE, "Zp": SPACE}
    out = np.array([of.get(unicodedata.category(chr(c)), OTHER) for c in range(0x110000)], np.uint8)
    out[[ord(c) for c in "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85"]] = SPACE
    out[[ord(c) for c in ".,;:?!'\"()-"]] = MARK
    return out


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2^64."""
    base, inverse = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    base[0] = inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


def windows(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > WINDOW:
        end = at + WINDOW
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def measure(text: str) -> list[float]:
    """The numbers of a whole text, in the order of NAMES; zeros for one without words."""
    seen = np.zeros(6, np.int64)
    hashes, totals = [], Counter()
    for part in windows(text):
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds()[code]
        seen += np.bincount(kind, minlength=6)
        word = kind != SPACE
        starts = np.flatnonzero(word & np.append(True, ~word[:-1]))
        if not len(starts):
            continue
        ends = np.flatnonzero(word & np.append(~word[1:], True))
        up, down = powers(max(1 << 16, 1 << (len(code) - 1).bit_length()))
        weighed = np.where(word, (code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], np.uint64(0))
        hashes.append(np.add.reduceat(weighed, starts) * down[starts])
        letter = (kind == LOWER) | (kind == UPPER)
        in_word = np.add.reduceat(letter.astype(np.int64), starts)
        totals["letters"] += int(letter.sum())
        totals["beyond"] += int((letter & (code > 127)).sum())
        totals["loud"] += int((code == ord("!")).sum())
        totals["stops"] += int(np.isin(code, [ord("."), ord("?"), ord("!")]).sum())
        totals["no_letters"] += int((in_word == 0).sum())
        totals["short"] += int(((in_word > 0) & (in_word < 4)).sum())
        totals["capitalised"] += int((kind[starts] == UPPER).sum())
        totals["ends_in_mark"] += int((kind[ends] == OTHER).sum())
    if not hashes:
        return [0.0] * len(NAMES)
    words = np.concatenate(hashes)
    n, counts = len(words), np.unique(words, return_counts=True)[1]
    lines = [x for x in text.split("\n") if x.strip()]
    solid, letters = int(seen.sum() - seen[SPACE]), max(totals["letters"], 1)
    return [
        np.log1p(len(text)), np.log1p(n), solid / n, seen[UPPER] / letters, totals["letters"] / solid, seen[DIGIT] / solid, seen[MARK] / n, seen[OTHER] / n,
        totals["loud"] / n, len(counts) / n, float((words[1:] == words[:-1]).sum()) / n, counts.max() / n, totals["no_letters"] / n, totals["capitalised"] / n,
        np.log1p(n / max(totals["stops"], 1)), totals["short"] / n, totals["ends_in_mark"] / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), totals["beyond"] / letters,
    ]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 5 is 0; false for a null id) and the numbers of every text, written once."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batch: pa.RecordBatch):
        for part in pieces(batch):
            found = [measure(t) for t in part.column("text").to_pylist()]
            yield {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "x": pa.array(found, pa.list_(pa.float32()))}

    return write_table(map_batches(rows, run, "doc_id long, held_out boolean, x array<float>"), "quality-measures")


def sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


@dataclass
class Additive:
    """The tables: one per number, by bin, and one per pair, by coarser bins of both."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]

    def add(self, bins: list[np.ndarray], n: int) -> np.ndarray:
        total = np.full(n, self.intercept)
        for b, t in zip(bins, self.tables, strict=True):
            total += t[b]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.add(self.bins(x), len(x)))


def worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """What the best cut of neighbouring bins into two gains, and the first bin of its right side (0: none)."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = np.where((left_h >= LEAST / 4) & (right_h >= LEAST / 4), worth(left_g, left_h) + worth(right_g, right_h) - worth(g.sum(), h.sum()), 0.0)
    at = int(gain.argmax()) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) and gain[at] > 0 else (0.0, 0)


def leaf(g: np.ndarray, h: np.ndarray) -> float:
    return RATE * float(g.sum() / (h.sum() + RIDGE))


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values by bin of a tree of at most LEAVES leaves, each a run of bins; the most useful cut is made first."""
    parts = [(0, len(g))]
    while len(parts) < LEAVES:
        gain, at, k = max((*best_cut(g[a:b], h[a:b]), k) for k, (a, b) in enumerate(parts))
        if not at:
            break
        a, b = parts[k]
        parts[k : k + 1] = [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = leaf(g[a:b], h[a:b])
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the better tree of one cut along a side, then one in each half along the other."""
    found = []
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        out, (gain, at) = np.zeros(a.shape), best_cut(a.sum(axis=1), b.sum(axis=1))
        for half in [slice(0, at), slice(at, None)] if at else [slice(None)]:
            more, cut = best_cut(a[half].sum(axis=0), b[half].sum(axis=0))
            gain += more
            for side in [slice(0, cut), slice(cut, None)] if cut else [slice(None)]:
                out[half, side] = leaf(a[half, side], b[half, side])
        found.append((gain, out.T if turned else out))
    return max(found, key=lambda f: f[0])


def learn(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Additive:
    """Tables from rows ``x`` with the share ``y`` of labels that are 1; the rows where ``fold`` is true only tell when to stop."""
    model = Additive()
    if not len(y):
        return model
    use = ~fold if (~fold).any() and fold.any() else np.ones(len(y), bool)
    rest = ~use
    mean = float(np.clip(y[use].mean(), 1e-3, 1 - 1e-3))
    model.intercept = float(np.log(mean / (1 - mean)))
    for k in range(x.shape[1]):
        model.edges.append(np.unique(np.quantile(x[use, k], np.arange(1, BINS) / BINS)))
        n = len(model.edges[k]) + 1
        model.tables.append(np.zeros(n))
        model.coarse.append(np.arange(n) * min(PAIR_BINS, n) // n)
    bins, total = model.bins(x), np.full(len(y), model.intercept)
    weight = use.astype(float)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(total)
        return weight * (y - p), weight * p * (1 - p)

    def loss() -> float:
        at = rest if rest.any() else use
        p = np.clip(sigmoid(total[at]), 1e-12, 1 - 1e-12)
        return float(-(y[at] * np.log(p) + (1 - y[at]) * np.log(1 - p)).mean())

    def boost(rounds: int, targets: list[np.ndarray], one_round) -> None:
        nonlocal total
        best, kept, since = loss(), [t.copy() for t in targets], 0
        at_best = total.copy()
        for _ in range(rounds):
            one_round()
            now = loss()
            if now < best - 1e-7:
                best, kept, at_best, since = now, [t.copy() for t in targets], total.copy(), 0
            elif (since := since + 1) >= PATIENCE:
                break
        for t, k in zip(targets, kept, strict=True):
            t[...] = k
        total = at_best

    def each_number() -> None:
        for b, t in zip(bins, model.tables, strict=True):
            g, h = residuals()
            step = shallow_tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)))
            t += step
            total[:] += step[b]

    boost(ROUNDS, model.tables, each_number)

    def grid(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = model.coarse[i][-1] + 1, model.coarse[j][-1] + 1
        cell = model.coarse[i][bins[i]] * shape[1] + model.coarse[j][bins[j]]
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    g, h = residuals()
    gains = sorted(((-pair_tree(*grid(i, j, g, h))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)))
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain < 0]
    model.pair_tables = [np.zeros((model.coarse[i][-1] + 1, model.coarse[j][-1] + 1)) for i, j in model.pairs]

    def each_pair() -> None:
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            step = pair_tree(*grid(i, j, *residuals()))[1]
            t += step
            total[:] += step[model.coarse[i][bins[i]], model.coarse[j][bins[j]]]

    boost(PAIR_ROUNDS, model.pair_tables, each_pair)
    for b, t in zip(bins, model.tables, strict=True):  # an entry says how far its bin lies from the mean
        shift = float(t[b[use]].mean())
        t -= shift
        model.intercept += shift
    return model


def fit(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Additive:
    """Learns from labels of 0 and 1 (others and nulls are no labels) of documents that are not held out.

    ``sample`` is a bound of the fit alone: of more labelled ids, those go whose hash is above the share that gives about as
    many, so that what is broadcast and collected does not grow. An id with several labels has their mean, one with
    several texts the least of their rows of numbers.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.avg("y").alias("y"))
    ids = ids.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    n = ids.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    taken = write_table(ids.where(place < F.lit((1 << 40) * min(sample, n) // max(n, 1))), "quality-labels")
    found = measured.where("not held_out").join(F.broadcast(taken), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    rows = sorted(found.select("doc_id", "y", "x").collect())
    x, y = np.array([r["x"] for r in rows], np.float32).reshape(-1, len(NAMES)), np.array([r["y"] for r in rows])
    return learn(x, y, np.array([r["doc_id"] % 5 == 0 for r in rows], bool))


def scored(measured: DataFrame, model: Additive) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``measured``; a model that learned nothing gives 0.5."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(NAMES))
            score = shared.value.score(x)
            yield {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

    return map_batches(measured, run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, model: Additive | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), predicted (1 from THRESHOLD on) for every row of ``docs``.

    A null text is empty; an empty text, whose numbers are all zero, is scored like any other. Only the text decides a score:
    repeated rows and copies under other ids score alike. Labels of ids that no document has teach nothing; without any label
    all scores are 0.5. Other columns are not read.
    """
    measured = measures(docs, id_col, text_col)
    return scored(measured, model or fit(measured, labels, id_col, label_col))
