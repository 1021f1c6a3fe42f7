"""Best-fit packing of token sequences, planned over the histogram of lengths.

Best fit is run over counts, not over documents: all bins with the same content are one group. Documents then take
the planned slots by their rank within their length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import write_table
from .common import id_text, map_batches, pieces
from .tokens import byte_letters, latin_classes

CAPACITY = 4096
END_ID = 1

class WordIds(dict):
    """Lower-case pre-token -> its ids as little-endian unsigned 32-bit bytes, from the library's model when first met.

    The dictionary is emptied when full. Text up to U+00FF is cut into pre-tokens here; the library encodes the other
    white-space words itself (pre-tokens never cross white space), and whole texts that hold special tokens or the
    separators that Python and the library hold to be white space differently.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        letters, numbers, spaces = latin_classes()
        self.find = re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{spaces}{letters}{numbers}]+").findall
        self.odd = re.compile("<\\||[\x1c-\x1f]").search
        self.high = re.compile("[^\x00-\xff]").search

    def __missing__(self, x: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[x] = ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(byte_letters(x))])
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, as the library gives them."""
        if self.odd(text):
            return self.whole(text)
        if self.high(text):
            return b"".join([self.whole(w) if self.high(w) else self.ids(w) for w in text.split()])
        return b"".join(map(self.__getitem__, self.find(text.lower())))


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One cache per worker."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, slots per bin, first bin, bins, offset) from best fit by decreasing length over counts.

    Within a row, rank r of the length goes to bin ``first bin + r // per bin`` at ``offset + (r % per bin) * length``.
    Rows number a few per length, however many documents there are.
    """
    free: list[tuple[int, int]] = []  # (space left, first bin), sorted
    bins: dict[tuple[int, int], int] = {}  # -> how many bins alike follow one another
    rows, next_bin = [], 0

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            insort(free, (space, first))
            bins[space, first] = n

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(free, (length, -1))
            if at == len(free):
                per = capacity // length
                space, first, n = capacity, next_bin, -(-left // per)
                next_bin += n
            else:
                space, first = free.pop(at)
                n = bins.pop((space, first))
                per = space // length
            full = min(n, left // per)
            if full:
                rows.append((length, rank, per, first, full, capacity - space))
                put(space - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if left and full < n:  # one more bin takes what is left
                rows.append((length, rank, left, first + full, 1, capacity - space))
                put(space - left * length, first + full, 1)
                put(space, first + full + 1, n - full - 1)
                left = 0
            elif not left and full < n:
                put(space, first + full, n - full)
    return rows


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces with their length, place and checksum, and their rank within their length in the task that made them."""

    def run(batches):
        words, seen = word_ids(path), {}
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in pieces(batch):
                out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "nth")}
                for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = words.ids(t or "") + END_ID.to_bytes(4, "little")
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        n = len(piece) // 4
                        seen[n] = seen.get(n, -1) + 1
                        for c, v in zip(out, (d, k, at // 4, n, zlib.crc32(piece), seen[n]), strict=True):
                            out[c].append(v)
                n = len(out["doc_id"])
                yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32", "nth")), pa.array([task] * n, pa.int32())], names=[*out, "task"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, task int")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of every row.

    A null or empty text is one piece that holds the end id alone. Repeated rows are packed each for itself, a null id
    stays null; other columns are not read; an empty table gives no rows. Pieces of one length are interchangeable:
    which takes which of the planned slots depends on how the input is partitioned, the plan does not.
    """
    made = write_table(pieces_of(docs, path, capacity, id_col, text_col), "pieces")
    by_task = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = by_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    histogram = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 6)
    slots = docs.sparkSession.sparkContext.broadcast(rows)
    ranked = made.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))

    def run(batch: pa.RecordBatch):
        rows = slots.value
        key = rows[:, 0] * (1 << 48) + rows[:, 1]
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        _, first_rank, per, first, _, offset = rows[np.searchsorted(key, length * (1 << 48) + rank, "right") - 1].T
        r = rank - first_rank
        same = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        yield same | {"sequence_id": pa.array(first + r // per), "offset": pa.array(offset + r % per * length)}

    return map_batches(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
