"""Language identification by cross-parsing entropy.

A suffix automaton is built from a bounded sample of labelled text per language. A text is
parsed greedily into the longest phrases that occur in the sample of a language; the language
that needs the fewest phrases, normalised by the length parsed, wins.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import drop_table, write_table
from .common import map_batches

#: The samples of all languages together have at most so many characters, which bounds what is broadcast (about 40 bytes each).
MOST_CHARS = 8_000_000
NOT_LETTERS = re.compile(r"[\W\d_]+")


def folded(text: str) -> str:
    """Lower case; every run of other characters than letters becomes one space."""
    return NOT_LETTERS.sub(" ", text.lower())


def has_letter(text: str) -> bool:
    """Whether any character is of a Unicode letter category; quick for the usual text."""
    for m in re.finditer(r"[^\W\d_]", text):
        if m[0].isalpha() and unicodedata.category(m[0])[0] == "L":
            return True
    return False


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``codes``: per state a dict from symbol to state. State 1 is the root, 0 is none."""
    nxt: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[cur] = clone
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
        last = cur
    return nxt


class Transitions:
    """Transitions in one array: that of state s under symbol c is in slot ``base[s] + c``, if the slot is owned by s.
    The rows of all states are laid over one another where they do not collide, whatever the size of the alphabet."""

    def __init__(self, states: list[dict[int, int]], symbols: int):
        edges = sum(map(len, states))
        used = bytearray(2 * symbols + edges)  # no slot below ``symbols``, so that no base is below 0
        used[:symbols] = b"\1" * symbols
        self.base = np.zeros(len(states), np.int32)
        placed, low, start = [], symbols, symbols
        for s in sorted(range(len(states)), key=lambda s: (-len(states[s]), s)):
            row = sorted(states[s])
            if not row:
                break
            low = used.find(0, low)
            at = tries = 0
            at = max(low, start) if len(row) > 1 else low
            while True:
                if at + row[-1] - row[0] >= len(used):
                    used.extend(bytes(symbols + len(used) // 4))
                if not any(used[at + c - row[0]] for c in row):
                    break
                at = used.find(0, at + 1)
                if at < 0:
                    at = len(used)
                tries += 1
            if tries > 64:
                start = at  # what lies before is too full for rows like this one
            self.base[s] = at - row[0]
            for c in row:
                used[at + c - row[0]] = 1
                placed.append((at + c - row[0], s, states[s][c]))
        size = max((k for k, _, _ in placed), default=0) + symbols + 1
        self.owner, self.target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        if placed:
            k, s, t = np.array(placed, np.int32).T
            self.owner[k], self.target[k] = s, t

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states, 0 where there is none."""
        slot = self.base[state] + symbol
        return np.where(self.owner[slot] == state, self.target[slot], 0)


class CrossParser:
    """One automaton per language over its sample. Every symbol of any sample has a code; others have 0 and match nothing."""

    def __init__(self, samples: dict[str, str], block: int = 256):
        self.langs = sorted(samples)
        self.block = block
        texts = {k: folded(samples[k]) for k in self.langs}
        self.symbols = sorted(set().union(*texts.values())) if texts else []
        code = {ch: k + 1 for k, ch in enumerate(self.symbols)}
        self.tables = [Transitions(suffix_automaton([code[ch] for ch in texts[k]]), len(self.symbols) + 1) for k in self.langs]
        self.lookup = None

    def codes(self, text: str) -> np.ndarray:
        if self.lookup is None:  # made where it is used, not sent
            self.lookup = np.zeros(0x110000, np.int32)
            self.lookup[[ord(ch) for ch in self.symbols]] = np.arange(1, len(self.symbols) + 1)
        return self.lookup[np.frombuffer(folded(text).encode("utf-32-le", "surrogatepass"), np.uint32)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases a text needs in each language. The parse starts anew at each block of ``block`` symbols, so that
        the blocks of all texts advance together; every symbol of every text is parsed."""
        coded = [self.codes(t) for t in texts]
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        b = self.block
        owner = np.repeat(np.arange(len(coded)), [-(-len(c) // b) for c in coded])
        if not len(owner):
            return out
        grid = np.zeros((len(owner), b), np.int32)
        size = np.zeros(len(owner), np.int64)
        at = 0
        for c in coded:
            n = -(-len(c) // b)
            if n:
                flat = grid[at : at + n].reshape(-1)
                flat[: len(c)] = c
                size[at : at + n] = b
                size[at + n - 1] = len(c) - (n - 1) * b
                at += n
        order = np.argsort(-size, kind="stable")
        grid, owner, size = np.ascontiguousarray(grid[order].T), owner[order], size[order]
        live = len(size) - np.searchsorted(size[::-1], np.arange(b), side="right")
        for k, table in enumerate(self.tables):
            root = 1
            first = table.step(np.full(len(self.symbols) + 1, root, np.int32), np.arange(len(self.symbols) + 1, dtype=np.int32))
            first[first == 0] = root  # a symbol the sample lacks is a phrase of its own
            state = np.full(len(size), root, np.int32)
            count = np.zeros(len(size), np.int32)
            for j in range(b):
                n = live[j]
                c = grid[j, :n]
                s = state[:n]
                t = table.step(s, c)
                ends = t == 0
                count[:n] += ends | (s == root)
                # the phrase ends before this symbol, which begins the next one
                stuck = np.flatnonzero(ends)
                t[stuck] = first[c[stuck]]
                state[:n] = t
            out[:, k] = np.bincount(owner, count, len(texts)).astype(np.int64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if known and self.langs:
            need = self.phrases([texts[i] for i in known])
            best = need.argmin(axis=1)
            low = need[np.arange(len(best)), best]
            other = need.copy()
            other[np.arange(len(best)), best] = np.iinfo(np.int64).max
            second = other.min(axis=1) if need.shape[1] > 1 else 2 * low
            for i, k, a, z in zip(known, best, low, second, strict=True):
                langs[i] = self.langs[k]
                scores[i] = float(z) / float(a + z)
        return langs, scores


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 48, chars_per_doc: int = 512) -> CrossParser:
    """Learns from a bounded sample of labelled rows: per language the ``docs_per_lang`` training rows with the
    smallest hash of their id, ``chars_per_doc`` characters each, and at most MOST_CHARS over all languages, which then
    get fewer characters a row (documented bounds of the fit alone). More than MOST_CHARS / 1000 values of lang fail."""
    train = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    # ranked before the texts are read in whole: a row carries the sample's few characters only
    cut = train.select("lang", F.substring("text", 1, chars_per_doc).alias("text"), F.xxhash64(F.col("doc_id")).alias("h"), "doc_id")
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    ranked = write_table(cut.withColumn("r", F.row_number().over(order)).where(F.col("r") <= docs_per_lang).select("lang", "r", "text"), "language-samples")
    langs = ranked.where("r = 1").count()
    if langs * 1000 > MOST_CHARS:
        raise ValueError(f"{langs} values of {lang_col}: too many for one model")
    chars = min(chars_per_doc, MOST_CHARS // (docs_per_lang * max(langs, 1)))
    samples: dict[str, str] = {}
    for row in sorted(ranked.select("lang", "r", F.substring("text", 1, chars).alias("text")).collect(), key=lambda x: (x.lang, x.r)):
        samples[row.lang] = samples.get(row.lang, "") + row.text + " \n"
    drop_table(ranked)
    return CrossParser(samples)


def language_id(docs: DataFrame, model: CrossParser | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; whole texts are parsed.

    A null text, an empty one or one without a letter gives ``und`` with score 0; a tie goes to the language first
    in order. ``score`` is second / (best + second) of the phrases needed: 0.5 when undecided, near 1 when sure.
    Repeated rows give repeated results; other columns are not read. No labelled row at all: every row is ``und``.
    """
    model = model or fit(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        for part in _by_size(batch):
            langs, scores = shared.value.predict(part.column("text").to_pylist())
            yield {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": langs, "score": scores}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: CrossParser | None = None, text_col: str = "text", lang_col: str = "lang", langs: list[str] | None = None) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or, if ``langs`` are stated, not among them; ``lang_col`` has the
    predicted language, the other columns are as they are. A model without languages (no labelled row to learn from)
    names none, so then only rows without a letter go and ``lang_col`` stays."""
    model = model or fit(docs, text_col=text_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, lang_at, names = docs.columns.index(text_col), docs.columns.index(lang_col), docs.columns

    def run(batches):
        for batch in batches:
            for part in _by_size(batch, at):
                texts = part.column(at).to_pylist()
                if not shared.value.langs:
                    yield part.filter(pa.array([bool(t) and has_letter(t) for t in texts], pa.bool_()))
                    continue
                found, _ = shared.value.predict(texts)
                cols = [pa.array(found, c.type) if k == lang_at else c for k, c in enumerate(part.columns)]
                kept = pa.array([x != "und" and (langs is None or x in langs) for x in found], pa.bool_())
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(kept)

    return docs.mapInArrow(run, docs.schema)


def _by_size(batch: pa.RecordBatch, column: int | str = "text", chars: int = 2_000_000):
    """Slices of about ``chars`` bytes of text, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
