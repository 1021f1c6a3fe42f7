"""Benchmark decontamination with SimHash over item-sized windows.

For an item of n words, each window of n words of a document has a weighted SimHash over its word shingles: those that
stand in any item weigh one, others nothing, so that edits take little from the likeness of a window to its item.
Multi-index Hamming blocks in two levels give all items of that size whose fingerprint is within the radius, and the
exact weighted-shingle similarity (shared shingles, repeats included, over the item's shingles) verifies these
candidates. A window in which fewer shingles stand in any item at all than the similarity needs cannot pass against one,
whichever it is; it gets no fingerprint, which drops no match.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, WordHashes, id_text, map_batches, mixed, pieces, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of a fingerprint. With edits that stand in no item, similarity 0.8 turns 57 of them on average, with a standard
#: deviation of 7; with edits that all stand in other items 79 and 8. Unlike windows differ in 192.
BITS = 384
RADIUS = 95
#: Two fingerprints within the radius differ in at most RADIUS // BLOCKS = 7 bits of some block of 32 and so in at most 3
#: of one of its halves. Items are filed under each half with up to one bit turned and asked for with up to two.
BLOCKS = 12
#: Items held by one task at once, by number and by bytes; more are taken in turns, each broadcast on its own.
ITEMS_AT_ONCE = 10_000
BYTES_AT_ONCE = 16_000_000
#: Windows fingerprinted at once.
WINDOWS = 4096

WORDS = re.compile(rb"[0-9A-Za-z_\x80-\xff]+").findall


def words_of(text: str) -> list[bytes]:
    return WORDS(text.lower().encode("utf-8", "surrogatepass"))


def bit_signs(h: np.ndarray) -> np.ndarray:
    """BITS signs for each hash, from as many 64-bit mixes of it as they take."""
    lanes = mixed(h[:, None] + np.arange(1, BITS // 64 + 1, dtype=np.uint64)[None, :] * P)
    return 2 * np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little").astype(np.int8) - 1


def packed(positive: np.ndarray) -> np.ndarray:
    return np.packbits(positive, axis=1, bitorder="little").view(np.uint64)


def window_prints(h: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Weighted SimHash of every window of ``size`` shingles, by rolling sums of the bits."""
    sums = np.zeros((len(h) + 1, BITS), np.int32)
    np.cumsum(bit_signs(h) * weight[:, None].astype(np.int8), axis=0, dtype=np.int32, out=sums[1:])
    return packed(sums[size:] > sums[:-size])


def within(bits: int, width: int = 16) -> np.ndarray:
    """All values of ``width`` bits with at most so many set."""
    return np.array([sum(1 << b for b in c) for k in range(bits + 1) for c in combinations(range(width), k)], np.uint16)


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, place) for every place of the ranges lo[k] to hi[k]."""
    n = hi - lo
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)


class BlockIndex:
    """Fingerprints filed under the halves of their blocks. Where there are fewer of them than a value has probes, their
    halves are compared with the value one by one, which finds the same."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius, self.half = prints, radius, radius // BLOCKS // 2
        self.blocks, self.halves = prints.view(np.uint32), prints.view(np.uint16)
        turned = within(self.half // 3)
        self.probes = within(self.half - self.half // 3)
        self.filed = None
        if len(prints) > len(self.probes):
            self.filed = []
            for of_half in self.halves.T:
                values = (of_half[:, None] ^ turned[None, :]).reshape(-1)
                order = np.argsort(values, kind="stable")
                self.filed.append((values[order], (order // len(turned)).astype(np.int32)))

    def _near_half(self, values: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(value, held) places of the pairs that are near in half ``b``, each once."""
        if self.filed is None:
            return np.nonzero(np.bitwise_count(values[:, None] ^ self.halves[None, :, b]) <= self.half)
        filed, items = self.filed[b]
        probes = (values[:, None] ^ self.probes[None, :]).reshape(-1)
        probe, place = spread(np.searchsorted(filed, probes), np.searchsorted(filed, probes, "right"))
        return np.divmod(np.unique(probe // len(self.probes) * len(self.prints) + items[place]), len(self.prints))

    def candidates(self, asked: np.ndarray) -> np.ndarray:
        """asked * held places, as one number, of the pairs of which some block is near, each once."""
        held, found = len(self.prints), [np.zeros(0, np.int64)]
        blocks = asked.view(np.uint32)
        for b, of_half in enumerate(asked.view(np.uint16).T):
            # windows that overlap share most of their values
            values, of = np.unique(of_half, return_inverse=True)
            value, item = self._near_half(values, b)
            if not len(value):
                continue
            order = np.argsort(of, kind="stable")
            ends = np.cumsum(np.bincount(of, minlength=len(values)))
            pair, place = spread(np.concatenate([[0], ends[:-1]])[value], ends[value])
            window, item = order[place], item[pair]
            near = np.bitwise_count(blocks[window, b // 2] ^ self.blocks[item, b // 2]) <= self.radius // BLOCKS
            found.append(window[near] * held + item[near])
        return np.unique(np.concatenate(found))

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asked, held) places of all pairs within the radius."""
        a, i = np.divmod(self.candidates(asked), max(1, len(self.prints)))
        ok = np.bitwise_count(asked[a] ^ self.prints[i]).sum(axis=1) <= self.radius
        return a[ok], i[ok]


class AllPairs:
    """Every pair, whatever its fingerprints: what tests hold the blocks against."""

    def __init__(self, prints: np.ndarray):
        self.held = len(prints)

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.divmod(np.arange(len(asked) * self.held), self.held)


class Items:
    """The benchmark: per item its shingles with counts, and per size (words) the block index over the fingerprints."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float = SIMILARITY, index=BlockIndex, bound: bool = True):
        self.similarity, self.bound = similarity, bound
        hashes = WordHashes()
        self.ids, self.shingles = [], []
        by_size: dict[int, list[int]] = {}
        for item, text in rows:
            words = words_of(text or "")
            if words:
                by_size.setdefault(len(words), []).append(len(self.ids))
                self.ids.append(item)
                self.shingles.append(np.unique(shingle_hashes(hashes.of(words), SHINGLE), return_counts=True))
        #: per shingle length the shingles of all items, with a 16-bit filter before the search among them
        self.known = {}
        for n in {min(size, SHINGLE) for size in by_size}:
            keys = np.unique(np.concatenate([self.shingles[i][0] for size, of in by_size.items() if min(size, SHINGLE) == n for i in of]))
            quick = np.zeros(1 << 16, bool)
            quick[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.known[n] = keys, quick
        self.sizes = []
        for size, of in sorted(by_size.items()):
            n = min(size, SHINGLE)
            total = size - n + 1
            prints = packed(np.array([(bit_signs(k) * c[:, None]).sum(axis=0) > 0 for k, c in (self.shingles[i] for i in of)]))
            self.sizes.append((n, total, max(1, int(np.ceil(similarity * total - 1e-9))), of, index(prints)))

    def matches(self, words: np.ndarray) -> list[tuple[int, int, float]]:
        return self.matches_of([words])[0]

    def matches_of(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, float]]]:
        """For each document, given as word hashes, (item, first word, similarity) of the best window of each item found
        in it. A document shorter than an item is one window."""
        best: list[dict[int, tuple[int, float]]] = [{} for _ in texts]
        for n, (keys, quick) in self.known.items():
            sides = []
            for t, words in enumerate(texts):
                if len(words) < n:
                    continue
                h = shingle_hashes(words, n)
                at = np.flatnonzero(quick[(h >> np.uint64(48)).astype(np.int64)])
                at = at[keys[np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)] == h[at]]
                if len(at) or not self.bound:
                    before = np.zeros(len(h) + 1, np.int64)  # known shingles before each place
                    before[at + 1] = 1
                    sides.append((best[t], h, np.cumsum(before), len(at)))
            for k, *size in self.sizes:
                if k == n:
                    self._search(sides, *size)
        return [[(self.ids[i], at, sim) for i, (at, sim) in sorted(b.items())] for b in best]

    def _search(self, sides: list, total: int, least: int, of: list[int], index) -> None:
        """Looks up the windows of one size, those of many documents at once."""
        enough = least if self.bound else 0
        asked, prints = [], []
        for found, h, before, known in sides:
            if known < enough:
                continue
            size = min(total, len(h))
            starts = np.flatnonzero(before[size:] - before[:-size] >= enough)
            for lo in range(0, len(starts), WINDOWS):
                some = starts[lo : lo + WINDOWS]
                for run in np.split(some, np.flatnonzero(np.diff(some) > 1) + 1):
                    first, end = int(run[0]), int(run[-1]) + size
                    prints.append(window_prints(h[first:end], np.diff(before[first : end + 1]), size))
                asked += [(found, h[w : w + size], w) for w in some.tolist()]
                if len(asked) >= WINDOWS:
                    self._verify(asked, np.concatenate(prints), total, least, of, index)
                    asked, prints = [], []
        if asked:
            self._verify(asked, np.concatenate(prints), total, least, of, index)

    def _verify(self, asked: list, prints: np.ndarray, total: int, least: int, of: list[int], index) -> None:
        for w, j in zip(*(x.tolist() for x in index.near(prints)), strict=True):
            found, part, at = asked[w]
            key, count = self.shingles[of[j]]
            spot = np.minimum(np.searchsorted(key, part), len(key) - 1)
            shared = int(np.minimum(np.bincount(spot[key[spot] == part], minlength=len(key)), count).sum())
            if shared >= least and shared / total > found.get(of[j], (0, 0.0))[1]:
                found[of[j]] = (at, shared / total)


def load_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The items in portions of a checked number, so that what is broadcast at once is bounded."""
    held: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").orderBy("i", "t").toLocalIterator():
        if held and (len(held) == ITEMS_AT_ONCE or size + len(row.t) > BYTES_AT_ONCE):
            yield Items(held)
            held, size = [], 0
        held.append((row.i, row.t))
        size += len(row.t)
    if held:
        yield Items(held)


_hashes = WordHashes()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, first_word, similarity: for each document and item found in it, its best window (first of equals).

    Words are runs of letters, digits and _, in lower case. Null and empty texts and items match nothing; an item under
    five words is one shingle of so many; a text shorter than an item is one window; equal items are all reported;
    repeated rows give repeated results; a null id stays null; empty tables give no rows; other columns are not read.
    """
    rows = id_text(docs, id_col, text_col)
    schema = "doc_id long, item_id long, first_word int, similarity double"
    out = None
    for items in load_items(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batch: pa.RecordBatch, shared=shared):
            for part in pieces(batch):
                matches = shared.value.matches_of([_hashes.of(words_of(t or "")) for t in part.column("text").to_pylist()])
                found = [(d, *m) for d, of in zip(part.column("doc_id").to_pylist(), matches, strict=True) for m in of]
                yield dict(zip(("doc_id", "item_id", "first_word", "similarity"), zip(*found, strict=True) if found else [[]] * 4, strict=True))

        one = map_batches(rows, run, schema)
        out = one if out is None else out.union(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, all columns as they are, without the documents that hold an item."""
    at = docs.columns.index(text_col)
    out = docs
    for items in load_items(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for batch in batches:
                for part in pieces(batch):
                    yield part.filter(pa.array([not m for m in shared.value.matches_of([_hashes.of(words_of(t or "")) for t in part.column(at).to_pylist()])], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
