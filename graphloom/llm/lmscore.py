"""Stupid-backoff language-model scores, computed relationally.

Documents are dealt to pieces. A piece sends each of its distinct n-grams once, with its count there, to the partition
of the n-gram's hash; the count tables held there are joined to what the pieces sent and the counts go back, where the
scores are summed per document. N-grams travel as packed hashes, many to a row: exploded one to a row they would take
several times the input on disk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, WordHashes, id_text, mixed
from .decontam import words_of

ORDER = 2
BACKOFF = 0.4
#: Bytes of text in a piece, and for each partition of the count tables.
PIECE_BYTES = 2_000_000
BUCKET_BYTES = 4_000_000
START = np.uint64(0x53746172745F5F5F)
#: The key under which the number of all words is counted.
TOTAL = np.uint64(0x0123456789ABCDEF)
MASK = np.uint64((1 << 48) - 1)

_hashes = WordHashes(600_000)


def pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def pack_counts(n: np.ndarray) -> bytes:
    """One byte per count; 255 stands for a count that follows behind them in eight."""
    large = n >= 255
    return np.where(large, 255, n).astype(np.uint8).tobytes() + n[large].astype("<i8").tobytes()


def unpack_counts(raw: bytes, k: int) -> np.ndarray:
    out = np.frombuffer(raw[:k], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[k:], "<i8")
    return out


class Grams:
    """All n-grams of a piece: ``keys[k]`` has the hashes of the k-grams that end at each word, ``ok[k]`` where there is one."""

    def __init__(self, texts: list[str | None], order: int):
        parts = [_hashes.of(words_of(t or "")) for t in texts]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        start = np.array([START], np.uint64)
        seq = np.concatenate([x for p in parts for x in (start, p)]) if parts else start[:0]
        self.doc = np.repeat(np.arange(len(parts)), self.sizes + 1)
        place = np.arange(len(seq)) - np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]])[self.doc] if len(parts) else np.arange(0)
        self.word = place > 0
        self.keys, self.ok = {}, {}
        for k in range(1, order + 1):
            h = np.zeros(len(seq), np.uint64)
            for j in range(k):
                h[k - 1 :] = h[k - 1 :] * P + seq[j : len(seq) - (k - 1) + j]
            self.keys[k] = mixed(h + np.uint64(k))
            self.ok[k] = place >= k - 1

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of the piece in order, with their counts; the number of words is counted under TOTAL."""
        every = np.concatenate([self.keys[k][self.ok[k]] for k in self.keys])
        keys, n = np.unique(every, return_counts=True)
        at = np.searchsorted(keys, TOTAL)
        return np.insert(keys, at, TOTAL), np.insert(n, at, int(self.sizes.sum()))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def score_documents(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_score (sum of ln S over the words), mean_log_score (null without words) for every row.

    S(w | context) is c(context w) / c(context) if the corpus has the n-gram outside of the document, else ``backoff``
    times S with a shorter context, and in the end c(w) / N, with 1 for a word that no other document has. All counts
    are over all documents but the scored one itself. Words are runs of letters, digits and _, in lower case; texts
    start with a mark. Null and empty texts have no words and score 0. Repeated rows count and are scored each; a null
    id stays null; other columns are not read; an empty table gives no rows.
    """
    rows = id_text(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces, buckets = max(12, size // PIECE_BYTES), max(12, size // BUCKET_BYTES)
    # rows that are alike, however many, are dealt to pieces by where they stand as well
    dealt = rows.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(pieces)).cast("int").alias("piece")).repartition("piece")

    def ask(t: pa.Table) -> pa.Table:
        keys, n = Grams(t.column("text").to_pylist(), order).counted()
        bucket = bucket_of(keys, buckets)
        cut = np.flatnonzero(np.diff(bucket)) + 1
        spans = list(zip([0, *cut], [*cut, len(keys)], strict=True))
        return pa.table({
            "piece": pa.array([t.column("piece")[0].as_py()] * len(spans), pa.int32()),
            "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
            "keys": pa.array([pack48(keys[a:z]) for a, z in spans], pa.binary()),
            "counts": pa.array([pack_counts(n[a:z]) for a, z in spans], pa.binary()),
        })

    def answer(t: pa.Table) -> pa.Table:
        """Adds up a bucket's count table and looks up what each piece asked for."""
        keys = [unpack48(x) for x in t.column("keys").to_pylist()]
        counts = [unpack_counts(x, len(k)) for x, k in zip(t.column("counts").to_pylist(), keys, strict=True)]
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, np.concatenate(counts))
        back = np.split(total[which].astype(np.int64), np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"piece": t.column("piece"), "bucket": t.column("bucket"), "counts": pa.array([pack_counts(b) for b in back], pa.binary()), "n": pa.array([len(b) for b in back], pa.int32())})

    def score(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64()), "mean_log_score": pa.array([], pa.float64())})
        g = Grams(t.column("text").to_pylist(), order)
        keys, _ = g.counted()
        got = sorted(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist(), answers.column("n").to_pylist(), strict=True))
        total = np.concatenate([unpack_counts(raw, n) for _, raw, n in got])
        others, index = {}, {}
        for k in g.keys:
            index[k] = np.searchsorted(keys, g.keys[k])
            # less what the document itself has
            pair = g.doc * len(keys) + np.where(g.ok[k], index[k], 0)
            pair[~g.ok[k]] = -1
            _, which, own = np.unique(pair, return_inverse=True, return_counts=True)
            others[k] = np.where(g.ok[k], total[np.minimum(index[k], len(keys) - 1)] - own[which], 0)
        words = (total[np.searchsorted(keys, TOTAL)] - g.sizes)[g.doc].astype(float)
        s = np.maximum(others[1], 1) / np.maximum(words, 1)
        for k in range(2, order + 1):
            context = np.concatenate([[0], others[k - 1][:-1]])
            s = np.where((others[k] > 0) & (context > 0), others[k] / np.maximum(context, 1), backoff * s)
        logs = np.bincount(g.doc, np.where(g.word, np.log(s), 0.0), len(g.sizes))
        mean = pa.array(logs / np.maximum(g.sizes, 1), mask=g.sizes == 0)
        return pa.table({"doc_id": t.column("doc_id"), "n_words": pa.array(g.sizes), "log_score": pa.array(logs), "mean_log_score": mean})

    asked = dealt.groupBy("piece").applyInArrow(ask, "piece int, bucket int, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "piece int, bucket int, counts binary, n int")
    return dealt.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(score, "doc_id long, n_words long, log_score double, mean_log_score double")
