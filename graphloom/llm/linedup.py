"""Line deduplication over content-defined chunks of lines.

A rolling hash over the hashes of a line and the next has local minima; a chunk begins at each, so where it begins depends on
four lines around, and text put in before does not move it. Chunks have two lines at least, three or four as a rule, and
do not overlap. A chunk of at least MIN_BYTES that occurs elsewhere is removed, after a comparison of the bytes,
everywhere but at its first occurrence (smallest doc_id, then smallest line). So what goes stands in an earlier place as
a whole, and one copy of it always stays.

A document is an id with its text: rows with one id and different texts are different documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import write_table
from .common import P, id_text, join_by_count, map_batches, mixed, pieces, several_texts, with_version

#: Bytes other than white space that a chunk must have to be removed: brackets, blank lines and short calls recur in texts
#: that have nothing else in common.
MIN_BYTES = 64


def boundaries(lines: list[bytes]) -> list[int]:
    """First lines of the chunks, and the number of all lines: the local minima of the rolling hash, but not within two
    lines of the beginning and three of the end."""
    n = len(lines)
    h = np.fromiter((xxhash.xxh64_intdigest(x) for x in lines), np.uint64, n)
    r = mixed(h[:-1] * P + h[1:])
    least = np.flatnonzero((r[1:-1] < r[:-2]) & (r[1:-1] < r[2:])) + 1 if n > 3 else np.zeros(0, int)
    return [0, *least[least > 1].tolist(), n]


def chunks_of(text: str) -> list[tuple[int, int, bytes]]:
    """(first line, lines, bytes) of each chunk of several lines that is large enough."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    if len(lines) < 2:
        return []
    at = boundaries(lines)
    found = ((a, z - a, b"\n".join(lines[a:z])) for a, z in zip(at, at[1:]))
    return [c for c in found if len(c[2]) >= MIN_BYTES and sum(map(len, c[2].split())) >= MIN_BYTES]


def _chunk_rows(batch: pa.RecordBatch, digest_of):
    for part in pieces(batch):
        out: dict[str, list] = {k: [] for k in ("h1", "h2", "doc_id", "v", "line", "n_lines")}
        for d, t, v in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "v")), strict=True):
            if d is None or not t or "\n" not in t:
                continue
            for at, n, body in chunks_of(t):
                digest = digest_of(body)
                out["h1"].append(int.from_bytes(digest[:8], "little", signed=True))
                out["h2"].append(int.from_bytes(digest[8:], "little", signed=True))
                out["doc_id"].append(d)
                out["v"].append(v)
                out["line"].append(at)
                out["n_lines"].append(n)
        yield out


def _bodies(batch: pa.RecordBatch):
    for part in pieces(batch):
        out: dict[str, list] = {k: [] for k in ("h1", "h2", "doc_id", "v", "line", "n_lines", "body")}
        for d, t, v, wanted in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "v", "wanted")), strict=True):
            lines = t.encode("utf-8", "surrogatepass").split(b"\n")
            for w in wanted:
                for k in ("h1", "h2", "line", "n_lines"):
                    out[k].append(w[k])
                out["doc_id"].append(d)
                out["v"].append(v)
                out["body"].append(b"\n".join(lines[w["line"] : w["line"] + w["n_lines"]]))
        yield out


CHUNK = ["h1", "h2", "doc_id", "v", "line", "n_lines"]


def repeated_chunks(rows: DataFrame, digest=xxhash.xxh3_128_digest) -> DataFrame:
    """doc_id, v, line, n_lines of every chunk of ``rows`` (doc_id, text, v) that goes: its bytes stand in an earlier place as
    well. ``digest`` (16 bytes) only brings equal chunks together; the bytes decide."""
    schema = "h1 long, h2 long, doc_id long, v long, line int, n_lines int"
    chunks = write_table(map_batches(rows, lambda batch: _chunk_rows(batch, digest), schema), "line-chunks")
    place = F.struct("doc_id", "v", "line")
    repeats = write_table(chunks.groupBy("h1", "h2").agg(F.min(place).alias("at"), F.count("*").alias("n")).where("n > 1"), "line-repeats")
    found = write_table(join_by_count(chunks, repeats, ["h1", "h2"]).select(*CHUNK, (place == F.col("at")).alias("first")), "line-occurrences")

    def bodies(occurrences: DataFrame) -> DataFrame:
        wanted = occurrences.groupBy("doc_id", "v").agg(F.collect_set(F.struct("h1", "h2", "line", "n_lines")).alias("wanted"))
        return map_batches(rows.join(wanted, ["doc_id", "v"]), _bodies, schema + ", body binary")

    # one row a digest leaves each task, however many places hold it
    spread = bodies(found).groupBy("h1", "h2").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).where("lo <> hi")
    unequal = write_table(spread.select("h1", "h2"), "line-unequal")
    gone = found.where("not first").select(*CHUNK)
    if not unequal.isEmpty():  # one digest, different bytes: there the bytes themselves are the key
        held = write_table(bodies(found.join(unequal, ["h1", "h2"], "left_semi")), "line-bodies")
        first = held.groupBy("h1", "h2", "body").agg(F.min(place).alias("at"))
        again = held.join(first, ["h1", "h2", "body"]).where(place != F.col("at")).select(*CHUNK)
        gone = gone.join(unequal, ["h1", "h2"], "left_anti").unionByName(again)
    return gone.select("doc_id", "v", "line", "n_lines").distinct()


def lines_of(gone: list[tuple[int, int]]) -> set[int]:
    return {k for at, n in gone for k in range(at, at + n)}


def without_lines(text: str, gone: list[tuple[int, int]]) -> str:
    drop = lines_of(gone)
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)


def _spans(column: pa.Array) -> list[list[tuple[int, int]]]:
    return [[(g["line"], g["n_lines"]) for g in row or ()] for row in column.to_pylist()]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text without repeated chunks, n_removed (lines), removed [(line, n_lines)] for every row.

    Null text stays null; a text of one line has no chunk and stays whole; a document all of whose
    chunks stand elsewhere becomes empty. A row with a null id stays as it is and takes no part. Rows with one id and
    different texts are different documents, in the order of the hash of their texts, and a chunk that only one of them
    holds stays; rows that repeat both id and text are one document and give the same result. Lines are split at \\n
    only and compared as bytes. Other columns are not read.
    """
    rows = with_version(id_text(docs, id_col, text_col))
    gone = repeated_chunks(rows).groupBy("doc_id", "v").agg(F.sort_array(F.collect_list(F.struct("line", "n_lines"))).alias("gone"))
    joined = rows.join(gone, ["doc_id", "v"], "left").select("doc_id", "text", "gone")

    def run(batch: pa.RecordBatch):
        for part in pieces(batch):
            gone, texts = _spans(part.column("gone")), part.column("text").to_pylist()
            yield {
                "doc_id": part.column("doc_id"),
                "text": [without_lines(t, g) if g and t is not None else t for t, g in zip(texts, gone, strict=True)],
                "n_removed": [len(lines_of(g)) for g in gone],
                "removed": [[{"line": at, "n_lines": n} for at, n in g] for g in gone],
            }

    return map_batches(joined, run, "doc_id long, text string, n_removed int, removed array<struct<line:int,n_lines:int>>")


def replace_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with all their columns, whatever their names; the text lacks its repeated chunks and ``chars_col``, where there is
    one, is counted anew. A document of which nothing is left, as all of it stands in earlier ones, goes; one that was empty
    before stays. Documents are told apart as in ``dedup_lines``."""
    # the columns travel inside one, so that none of them can clash with the keys
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    several = several_texts(whole.select("doc_id", "text"))
    v = F.when(F.col("__several").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0)).cast("long")
    marked = whole.join(several, F.col("doc_id") == F.col("__several"), "left").select("row", "doc_id", "text", v.alias("v"))
    gone = repeated_chunks(marked.select("doc_id", "text", "v")).groupBy("doc_id", "v").agg(F.collect_list(F.struct("line", "n_lines")).alias("gone"))
    joined = marked.join(gone, ["doc_id", "v"], "left").select("row", "gone")
    text_at, schema = docs.columns.index(text_col), docs.schema
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                cols, gone = part.column("row").flatten(), _spans(part.column("gone"))
                texts = cols[text_at].to_pylist() if any(gone) else []
                if texts:
                    texts = [without_lines(t, g) if g and t is not None else t for t, g in zip(texts, gone, strict=True)]
                    cols[text_at] = pa.array(texts, cols[text_at].type)
                    if chars_at is not None:
                        cols[chars_at] = pa.array([len(t) if g and t is not None else n for t, g, n in zip(texts, gone, cols[chars_at].to_pylist(), strict=True)], cols[chars_at].type)
                out = pa.RecordBatch.from_arrays(cols, names=schema.names)
                yield out.filter(pa.array([not g or t != "" for t, g in zip(texts, gone, strict=True)], pa.bool_())) if texts else out

    return joined.mapInArrow(run, schema)
