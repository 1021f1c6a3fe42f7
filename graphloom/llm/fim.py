"""Fill-in-the-middle: a text is cut at two places into prefix, middle and suffix, which are put in another order.

A batch of texts is one pyarrow.compute pipeline. Its units (code points) become the items of a list array that points
into the bytes of the batch, the lists are flattened with the index of their parent, each unit gets its ordinal and by
it a role, the units of a role are filtered and rebuilt as lists, and ``binary_join`` makes a string of each list.
Nothing is shuffled: a row's cuts depend on its own id and length alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
PLAIN_FROM, SPM_BELOW = 90, 20
#: Bytes of text in one pipeline; a longer text is one by itself. Its units take some 30 bytes each.
BATCH_BYTES = 1 << 21


def units(texts: pa.Array) -> pa.ListArray:
    """Each text as the list of its code points. The items share the bytes of ``texts``; only their offsets are new."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2] or pa.py_buffer(b"")
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    starts = np.flatnonzero((body & 0xC0) != 0x80).astype(np.int32) + offsets[0]
    items = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, offsets[-1]).astype(np.int32)), data)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, offsets).astype(np.int32)), items)


def cut(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> list[pa.Array]:
    """prefix, middle and suffix of each text, which end after ``first``, ``second`` and all of its units."""
    lists = units(texts)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    begins = pa.array(lists.offsets.to_numpy()[:-1].astype(np.int64))
    ordinal = pc.subtract(pa.array(np.arange(len(flat), dtype=np.int64)), pc.take(begins, parent))
    in_prefix = pc.less(ordinal, pc.take(pa.array(first), parent))
    in_suffix = pc.greater_equal(ordinal, pc.take(pa.array(second), parent))
    n = pc.list_value_length(lists).to_numpy().astype(np.int64)
    roles = [(in_prefix, first), (pc.invert(pc.or_(in_prefix, in_suffix)), second - first), (in_suffix, n - second)]
    out = []
    for role, lengths in roles:
        rebuilt = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pc.filter(flat, role))
        out.append(pc.binary_join(rebuilt, ""))
    return out


def transform(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray, h4: np.ndarray) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of non-null ``texts``."""
    n = pc.utf8_length(texts).to_numpy().astype(np.int64)
    a, b = h1 % (n + 1), h2 % (n + 1)
    first, second = np.minimum(a, b), np.maximum(a, b)
    marked = np.zeros(len(n), bool)
    for m in MARKERS:
        marked |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h3 % 100 >= PLAIN_FROM)
    form = np.where(plain, "plain", np.where(h4 % 100 < SPM_BELOW, "spm", "psm"))
    prefix, middle, suffix = cut(texts, first, second)
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    output = pc.if_else(pa.array(plain), texts, pc.if_else(pa.array(form == "spm"), spm, psm))
    return {
        "n": pa.array(n),
        "form": pa.array(form.tolist(), pa.string()),
        "prefix_chars": pa.array(first, mask=plain),
        "middle_chars": pa.array(second - first, mask=plain),
        "output": output,
    }


def _slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for k, size in enumerate(sizes):
        if k > at and total + size > most:
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += size
    if at < batch.num_rows:
        yield batch.slice(at)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1") -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars, output for every row.

    A null text is empty; an empty text, one that holds a marker, and one in ten of the others stay ``plain``, without
    prefix_chars and middle_chars. The cuts come from the digest of ``seed``, a colon and the decimal id (a null id:
    nothing after the colon), so repeated rows are cut alike and a task that runs again gives the same rows. A text is
    cut whole, however long; other columns are not read.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select("doc_id", "text", *draws)

    def run(batch: pa.RecordBatch):
        for part in _slices(batch, "text"):
            h = [part.column(f"h{k}").to_numpy() for k in range(1, 5)]
            yield {"doc_id": part.column("doc_id")} | transform(part.column("text"), *h)

    return map_batches(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that gave ``output``. The parts hold no marker, so the first of each is the one that was put there."""
    width = len(PREFIX)  # all markers are as long
    at = F.when(form == "psm", F.locate(SUFFIX, output, 2)).otherwise(F.locate(PREFIX, output, 2))
    end = F.locate(MIDDLE, output)
    one, two = output.substr(F.lit(width + 1), at - width - 1), output.substr(at + width, end - at - width)
    middle = output.substr(end + width, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
