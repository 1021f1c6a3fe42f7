"""Substring deduplication by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last 32 bytes is the least within ``REACH`` places on either side, so a boundary
depends on the bytes around it alone: an insertion moves only the boundaries near it, and a passage that stands in two
texts is cut alike in both but for its ends. Chunks are deduplicated by digest: those of the document with the smallest
doc_id stay. Short phrases recur by chance, so a run of repeated chunks goes only from ``MIN_RUN`` bytes on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import write_table
from .common import id_text, join_by_count, map_batches, pieces, with_version

#: Chunks have more than REACH bytes, and 2 * REACH + 1 on average.
REACH = 16
MIN_RUN = 120


def _gear() -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


GEAR = _gear()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + GEAR[data[i]] modulo 2^32 for all i at once, by doubling the span summed."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        nxt = h.copy()
        nxt[s:] += h[:-s] << np.uint32(s)
        h = nxt
    return h


def sliding_least(h: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` values in a row, by doubling the span compared."""
    out, span = h, 1
    while span < size:
        step = min(span, size - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out


def boundaries(raw: bytes, reach: int = REACH) -> list[int]:
    """Ends of the chunks; cuts fall between characters. The top bits of the hash, which all 32 bytes reach, decide."""
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    if not n:
        return []
    h = gear_hash(data)
    # the first bytes of characters alone may begin a chunk
    h[:-1] |= np.where((data[1:] & 0xC0) == 0x80, np.uint32(0xFFFFFFFF), np.uint32(0))
    wide = np.full(n + 2 * reach, 0xFFFFFFFF, np.uint32)
    wide[reach : reach + n] = h
    least = sliding_least(wide, reach)  # least[k]: of wide[k .. k + reach - 1]
    cut = (h < least[:n]) & (h <= least[reach + 1 : reach + 1 + n]) & (h != 0xFFFFFFFF)
    cut[: min(reach, n)] = False  # too near to the start to be told from the middle of a text
    cut[-1] = True
    return (np.flatnonzero(cut) + 1).tolist()


def _chunk_rows(batch: pa.RecordBatch):
    digest = xxhash.xxh3_64_digest
    for part in pieces(batch, 256):
        ids, versions, rows, starts, sizes, prints = [], [], [], [], [], []
        for r, (d, t, v) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "v")), strict=True)):
            if d is None or not t:
                continue
            raw = t.encode("utf-8", "surrogatepass")
            ends = boundaries(raw)
            begin = [0, *ends[:-1]]
            ids += [d] * len(ends)
            versions += [v] * len(ends)
            rows += [r] * len(ends)
            starts += begin
            sizes += [z - a for a, z in zip(begin, ends, strict=True)]
            prints += [digest(raw[a:z]) for a, z in zip(begin, ends, strict=True)]
        h = np.frombuffer(b"".join(prints), np.int64)
        again = np.ones(len(h), bool)  # stands earlier in the same row
        again[np.unique(np.rec.fromarrays([np.array(rows, np.int64), h]), return_index=True)[1]] = False
        yield {"h": pa.array(h), "doc_id": pa.array(ids, pa.int64()), "v": pa.array(versions, pa.int64()), "start": pa.array(starts, pa.int32()), "size": pa.array(sizes, pa.int32()), "again": pa.array(again)}


def repeated_spans(rows: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, v, spans [(start, size)] in bytes of ``rows`` (doc_id, text, v): runs of chunks that stand in an earlier place as well."""
    chunks = write_table(map_batches(rows, _chunk_rows, "h long, doc_id long, v long, start int, size int, again boolean"), "chunks")
    again = chunks.where("again").select("doc_id", "v", "start", "size")
    once = chunks.where("not again").drop("again")
    firsts = once.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    firsts = write_table(firsts.where("least <> most").drop("most"), "repeated-chunks")
    later = again.unionByName(join_by_count(once, firsts, ["h"]).where("doc_id > least").select("doc_id", "v", "start", "size"))
    # different texts of one id, which are few: the one whose hash is least comes first
    versions = once.where("v <> 0")
    first = versions.groupBy("h", "doc_id").agg(F.min("v").alias("v0"))
    later = later.unionByName(versions.join(first, ["h", "doc_id"]).where("v > v0").select("doc_id", "v", "start", "size"))
    spans = later.groupBy("doc_id", "v").agg(F.collect_list(F.struct("start", "size")).alias("chunks"))

    def run(batch: pa.RecordBatch):
        for part in pieces(batch):
            out = []
            for d, v, chunks in zip(*(part.column(c).to_pylist() for c in ("doc_id", "v", "chunks")), strict=True):
                runs: list[list[int]] = []
                for a, n in sorted({(c["start"], c["size"]) for c in chunks}):
                    if runs and runs[-1][1] == a:
                        runs[-1][1] = a + n
                    else:
                        runs.append([a, a + n])
                if kept := [{"start": a, "size": z - a} for a, z in runs if z - a >= min_run]:
                    out.append((d, v, kept))
            yield {"doc_id": [d for d, _, _ in out], "v": [v for _, v, _ in out], "spans": [s for _, _, s in out]}

    return map_batches(spans, run, "doc_id long, v long, spans array<struct<start:int,size:int>>")


def without_spans(raw: bytes, spans: list) -> bytes:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        out.append(raw[at : s["start"]])
        at = s["start"] + s["size"]
    return b"".join([*out, raw[at:]])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, text without its repeated passages, n_removed (bytes), spans [(start, size)] for every row.

    Null text stays null, with nothing removed; an empty text stays empty; an exact copy of an earlier document becomes
    empty (where it has MIN_RUN bytes). Within a document, later repeats go too. Rows with one id and different texts are
    different documents, in the order of the hash of their texts, and what only one of them holds stays; rows that repeat
    both id and text are one document and give the same result. A row with a null id stays as it is and takes no part.
    Other columns are not read.
    """
    rows = with_version(id_text(docs, id_col, text_col))
    joined = rows.join(repeated_spans(rows, min_run), ["doc_id", "v"], "left").select("doc_id", "text", "spans")

    def run(batch: pa.RecordBatch):
        for part in pieces(batch):
            texts, spans = part.column("text").to_pylist(), part.column("spans").to_pylist()
            yield {
                "doc_id": part.column("doc_id"),
                "text": [without_spans(t.encode("utf-8", "surrogatepass"), s).decode("utf-8", "surrogatepass") if s and t else t for t, s in zip(texts, spans, strict=True)],
                "n_removed": [sum(x["size"] for x in s or ()) if t else 0 for t, s in zip(texts, spans, strict=True)],
                "spans": [s or [] for s in spans],
            }

    return map_batches(joined, run, "doc_id long, text string, n_removed int, spans array<struct<start:int,size:int>>")
