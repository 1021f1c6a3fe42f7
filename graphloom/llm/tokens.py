"""Token counts by a two-tier lookup on the map side.

A bounded table of the lengths of frequent pre-tokens is broadcast; what it lacks is encoded once per worker and
kept in that worker's cache. No pre-token is ever shuffled, and no result depends on what the table holds.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_batches, pieces


def latin_classes() -> tuple[str, str, str]:
    """Regular-expression classes of the letters, numbers and white space of Unicode up to U+00FF."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)
    return of("L"), of("N"), "\t\n\x0b\x0c\r \x85\xa0"


def _byte_table() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself where that is a visible character, else as the next one from U+0100."""
    visible = [c for c in range(256) if 0x21 <= c <= 0x7E or 0xA1 <= c <= 0xFF and c != 0xAD]
    hidden = [c for c in range(256) if c not in set(visible)]
    return {c: chr(c) for c in visible} | {c: chr(0x100 + k) for k, c in enumerate(hidden)}


BYTE_TABLE = _byte_table()


def byte_letters(text: str) -> str:
    return text if text.isascii() and text.isalnum() else text.encode().decode("latin-1").translate(BYTE_TABLE)


class Lengths(dict):
    """Pre-token -> its number of tokens: ``frequent`` is the broadcast tier, the dictionary itself the worker's cache.

    The cache is emptied when full. Text up to U+00FF is cut into pre-tokens here; of other texts the library encodes
    the runs with characters above, and whole texts that hold special tokens or the separators that Python and the
    library hold to be white space differently.
    """

    def __init__(self, path: str, frequent: dict[str, int] | None = None, most: int = 1_000_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most, self.frequent = Tokenizer.from_file(path), most, frequent or {}
        self.model = self.tokenizer.model
        letters, numbers, spaces = latin_classes()
        other = f"[^{spaces}{letters}{numbers}]"
        self.pre_tokens = re.compile(rf" ?[{letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[{numbers}]+| ?{other}+|[{spaces}]+(?![^{spaces}])|[{spaces}]+").findall
        self.runs = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
        self.odd = re.compile("<\\||[\x1c-\x1f]").search
        self.high = re.compile("[^\x00-\xff]").search
        self.update(self.frequent)

    def __missing__(self, x: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.frequent)
        self[x] = n = len(self.model.tokenize(byte_letters(x)))
        return n

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if self.odd(text):
            return self.whole(text)
        if self.high(text):
            return sum(self.whole(x) if self.high(x) else self.count(x) for x in self.runs(text))
        return sum(map(self.__getitem__, self.pre_tokens(text)))


_lengths: dict[tuple[str, int], Lengths] = {}


def frequent_lengths(docs: DataFrame, path: str, rows: int = 2000, chars: int = 2000, most: int = 32_768) -> dict[str, int]:
    """The broadcast tier: the pre-tokens met most often in a bounded sample (``rows`` rows, ``chars`` characters each,
    ``most`` entries). It only saves time: whatever it lacks is encoded by the workers."""
    lengths, seen = Lengths(path), Counter()
    for row in docs.select(F.substring("text", 1, chars).alias("text")).where("text is not null").take(rows):
        for run in lengths.runs(row.text):
            if max(run) <= "\xff":
                seen.update(lengths.pre_tokens(run))
    return {x: lengths[x] for x, n in seen.most_common(most) if n > 1 and len(x) <= 32}


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for every row; whole texts are counted.

    A null or empty text has no bytes and no tokens. Repeated rows give repeated results, a null id stays null, other
    columns are not read, an empty table gives no rows. A special token's string counts as the library has it.
    """
    rows = id_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(rows, path))

    def run(batch: pa.RecordBatch):
        key = (path, shared.id if hasattr(shared, "id") else 0)
        if key not in _lengths:
            _lengths.clear()
            _lengths[key] = Lengths(path, shared.value)
        count = _lengths[key].count
        for part in pieces(batch):
            texts = [t or "" for t in part.column("text").to_pylist()]
            n = [count(t) for t in texts]
            yield {"doc_id": part.column("doc_id"), "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_batches(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
