"""The pipeline: its stages, and its rows against a brute-force version."""

from collections import Counter

import pytest

pytest.importorskip("graphloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from graphloom.llm import decontam, langid, linedup  # noqa: E402
from graphloom.llm.queries import vocabulary  # noqa: E402

from .test_operators import slow_lines  # noqa: E402


def test_stages_are_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]


def slow_shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_run_against_brute_force(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    kept = {k: t for k, t in rows.items() if t and langid.has_letter(t)}
    gone = {k: at for (k, _), at in slow_lines(sorted(kept.items())).items()}
    kept = {k: linedup.without_lines(t, gone[k]) for k, t in kept.items()}
    kept = {k: t for k, t in kept.items() if t or not gone[k]}
    sets = {k: slow_shingles(t) for k, t in kept.items()}
    root = {k: k for k in kept}
    for a in kept:
        for b in kept:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((root[a], root[b]))
                root = {k: x if r == y else r for k, r in root.items()}
    kept = {k: t for k, t in kept.items() if root[k] == k}

    def holds(text):
        w = decontam.words_of(text)
        for b in bench:
            iw = decontam.words_of(b.text)
            sh = lambda v: Counter(tuple(v[k : k + 5]) for k in range(len(v) - 4))
            s = sh(iw)
            all_of = sh(w)
            if sum((all_of & s).values()) < 0.8 * sum(s.values()):
                continue  # no window can have more than the whole text has
            if any(sum((sh(w[a : a + len(iw)]) & s).values()) >= 0.8 * sum(s.values()) for a in range(max(1, len(w) - len(iw) + 1))):
                return True
        return False

    kept = {k: t for k, t in kept.items() if not holds(t)}
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = Counter()
    for k, t in kept.items():
        n = len(tok.encode(t, add_special_tokens=False).ids) + 1
        for p, at in enumerate(range(0, n, 4096)):
            want[k, p, at, min(4096, n - at)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want


def test_stages_keep_columns_and_take_odd_rows(spark, sf):
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "words without an id", "en", "s", 19), (3, "a few words of text here", "en", "s", 24), (3, "a few words of text here", "en", "s", 24)], cols)
    empty = spark.createDataFrame([], cols)
    for docs in (odd, empty):
        out = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, sf)
            assert out.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, out, sf).count() == (0 if docs is empty else 2)  # the repeated row goes
