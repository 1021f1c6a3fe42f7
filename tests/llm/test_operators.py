"""Each operator against a brute-force version, and on nulls, empty, long, repeated and clashing rows."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

pytest.importorskip("graphloom.llm")
from graphloom.llm import ballsearch, common, decontam, htmlmain, langid, linedup, lmscore, packing, simhash, substrdedup, tokens  # noqa: E402
from graphloom.llm.queries import QUERIES, vocabulary  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, h long, fp string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = [words(60, k) for k in range(12)]
    t = {k: b for k, b in enumerate(base)}
    t[12] = base[3]  # a copy
    t[13] = base[4] + " extra"  # a near copy
    t[14] = ""
    t[15] = None
    t[16] = "one"
    t[17] = "É&!"
    t[18] = "\n".join(words(9, k) for k in range(40, 60))
    t[19] = "intro line\n" + t[18] + "\nlast line"
    t[20] = words(9000, 7)
    t[21] = base[0] + " " + base[5] + " " + base[1]
    return t


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, v, "xx" if k % 2 else "yy", 7, "c") for k, v in texts.items()] + [(None, "no id here", None, None, None), (3, texts[3], "xx", 7, "c")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_plan_places_every_length_once():
    r = random.Random(5)
    counts = {n: r.randint(1, 40) for n in r.sample(range(1, 101), 30)}
    rows = packing.plan(counts, 100)
    bins, ranks = {}, Counter()
    for length, rank, per, first, n, offset in rows:
        assert rank == ranks[length]
        ranks[length] += per * n
        for b in range(first, first + n):
            bins.setdefault(b, []).extend((offset + k * length, length) for k in range(per))
    assert ranks == counts
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 100
    assert sorted(bins) == list(range(len(bins)))
    assert len(bins) <= -(-sum(k * v for k, v in counts.items()) // 100) * 1.1 + 1


def test_pack(spark, docs, texts, none):
    path = vocabulary("word_bpe_49k.json")
    got = packing.pack(docs, path).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    want = []
    for k, t in [*texts.items(), (None, "no id here"), (3, texts[3])]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((k, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert Counter(want) == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("text", ["it's HE'LL 12 ½ x²  ª µ ß ÀÉ \x85 a\xa0b\x1c\x1d c 'S don't_x __ !!? ", "", "<|endoftext|> hi", "é a", "İstanbul Σας", "a\n\n  b \n c  d\t\te   ", "x  y z​q ­soft 日本語 テスト🎉🎉 a'sb 'dx"])
def test_ids_and_counts_are_the_library_s(text):
    w, n = packing.word_ids(vocabulary("word_bpe_49k.json")), tokens.Lengths(vocabulary("byte_bpe_50k.json"))
    assert w.ids(text) == w.whole(text)
    assert n.count(text) == n.whole(text)


def test_count_tokens(docs, texts, none):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in tokens.count_tokens(docs, path).collect()}
    for k, t in texts.items():
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 512)
    assert tokens.count_tokens(none, path).count() == 0


def slow_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, radius):
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_near_duplicates(docs, texts, none):
    got = simhash.near_duplicates(docs).collect()
    fps = {k: slow_fingerprint(t) for k, t in texts.items()}
    want = slow_components(fps, 4)
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(texts) + 2
    for k in texts:
        assert (by_id[k].fingerprint, by_id[k].component_id) == (f"{fps[k]:016x}", want[k])
    assert simhash.near_duplicates(none).count() == 0
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} >= {k for k in texts if want[k] == k}
    assert 12 not in {r.doc_id for r in simhash.keep_one(docs).collect()}


def test_keep_one_against_all_pairs_of_shingle_sets(spark):
    rng, texts = random.Random(8), {}
    for k in range(40):
        base = words(80, 500 + k).split()
        texts[5 * k] = base
        for n in (1, 2, 3, 4):  # so many words changed, five shingles each
            texts[5 * k + n] = [w if i not in range(6, 6 + 12 * n, 12) else "changed" + str(rng.random()) for i, w in enumerate(base)]
    shingles = {k: {tuple(v[i : i + 5]) for i in range(len(v) - 4)} for k, v in texts.items()}
    root = {k: k for k in texts}
    for a in texts:
        for b in range(a + 1, a - a % 5 + 5):
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                root = {k: min(root[a], root[b]) if r in (root[a], root[b]) else r for k, r in root.items()}
    rows = [(k, " ".join(v)) for k, v in texts.items()] + [(None, " ".join(texts[0])), (None, words(30, 77))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {k for k in texts if root[k] == k}
    assert len(want) == 160
    got = simhash.keep_one(df).collect()
    assert {r.doc_id for r in got if r.doc_id is not None} == want
    assert [r.text for r in got if r.doc_id is None] == [words(30, 77)]


def test_keep_one_in_a_crowd_of_texts_alike_but_below_the_similarity(spark, monkeypatch):
    """Many texts that share bands, of which few pairs reach the similarity: in one part and in several."""
    rng, base = random.Random(12), words(90, 31).split()
    texts = {k: [w if rng.random() > 0.025 else f"x{k}y{i}" for i, w in enumerate(base)] for k in range(70)}
    sets = {k: {tuple(v[i : i + 5]) for i in range(len(v) - 4)} for k, v in texts.items()}
    root = {k: k for k in texts}
    for a, b in itertools.combinations(texts, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = {k: x if r == y else r for k, r in root.items()}
    want = {k for k in texts if root[k] == k}
    assert 2 < len(want) < 70
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string").repartition(3)
    for part in (simhash.PART, 1000):
        monkeypatch.setattr(simhash, "PART", part)
        assert {r.doc_id for r in simhash.keep_one(df).collect()} == want


def test_links_of_a_dense_group_connect_what_all_pairs_do(spark):
    r = np.random.default_rng(3)
    centre = r.integers(0, 1 << 62, 40)
    fps = {int(c) ^ sum(1 << int(b) for b in r.choice(62, r.integers(0, 4), replace=False)) for c in centre for _ in range(12)}
    fps |= {int(x) for x in r.integers(0, 1 << 62, 200)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = slow_components({f: f for f in fps}, 4)
    for tree in (30_000, 8):  # whole shards, and shards split into many trees
        links = simhash.fingerprint_links(df, tree=tree)
        comp = {x.node: x.component for x in simhash.components(links).collect()}
        assert {f: comp.get(f, f) for f in fps} == want


def test_join_by_count_splits_hot_keys_and_loses_none(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 7 if k % 7 < 6 else None, k % 2, k) for k in range(60)] + [(3, 1, k) for k in range(60, 90)], "a long, b int, x long")
    counted = rows.groupBy("a", "b").count().withColumnRenamed("count", "n").where("a <> 5 or a is null")
    want = sorted(map(tuple, rows.join(counted, ["a", "b"]).collect()))
    for least in (1_000, 6, 0):  # no key is hot, one is, all are
        monkeypatch.setattr(common, "HOT_LEAST", least)
        assert sorted(map(tuple, common.join_by_count(rows, counted, ["a", "b"]).collect())) == want
    with pytest.raises(TypeError):
        common.join_by_count(rows, counted.withColumn("b", counted.b.cast("long")), ["a", "b"])


def test_components_against_union_find(spark):
    chance = np.random.default_rng(3)
    for links in ([], [(1, 1)], [(2, 1)], [(0, k) for k in range(1, 50)], [(50, k) for k in range(50)], chance.integers(-99, 99, (80, 2)).tolist(), chance.integers(0, 999, (700, 2)).tolist()):
        root = {}
        for a, b in links:
            if a != b:
                x, y = sorted((root.setdefault(a, a), root.setdefault(b, b)))
                root = {k: x if r == y else r for k, r in root.items()}
        got = simhash.components(spark.createDataFrame([tuple(e) for e in links], "a long, b long")).collect()
        assert sorted(map(tuple, got)) == sorted((k, r) for k, r in root.items() if k != r)


def test_components_of_a_long_chain(spark):
    links = spark.range(60).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in simhash.components(links).collect()} == {0}
    assert simhash.components(links.where("a < 0")).count() == 0


def test_decontamination_against_all_windows(spark, docs, texts, none):
    items = {1: " ".join(texts[0].split()[10:40]), 2: " ".join(texts[18].split()[3:40]), 3: words(30, 999), 4: "", 5: None, 6: "one", 7: " ".join([*texts[5].split()[:15], "zz", *texts[5].split()[16:40]]), 8: " ".join([*texts[20].split()[8100:8190], "zz"]), 9: " ".join([*words(50, 78).split(), "tail", "end"])}
    texts = texts | {22: words(50, 78)}
    docs = docs.union(spark.createDataFrame([(22, texts[22], "xx", 7, "c")], SCHEMA))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")

    sh = lambda v, n: Counter(tuple(v[k : k + n]) for k in range(len(v) - n + 1))

    def slow(text):
        w, found = decontam.words_of(text or ""), {}
        for i, t in items.items():
            iw = decontam.words_of(t or "")
            if not iw:
                continue
            n = min(5, len(iw))
            s = sh(iw, n)
            best = max(sum((sh(w[a : a + len(iw)], n) & s).values()) / sum(s.values()) for a in range(max(1, len(w) - len(iw) + 1)))
            if best >= 0.8:
                found[i] = best
        return found

    got = {}
    for r in decontam.contaminated(docs, bench).collect():
        got.setdefault(r.doc_id, {})[r.item_id] = r.similarity
    want = {k: slow(t) for k, t in texts.items()}
    assert want[20][8] > 0.9 and 0.8 <= want[22][9] < 1  # far into a long text; a text shorter than the item
    for k in texts:
        assert got.get(k, {}) == pytest.approx(want[k]), k
    assert decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(docs, bench.where("item_id < 0")).count() == 0
    kept = {r.doc_id for r in decontam.keep_clean(docs, bench).collect()}
    assert kept == {k for k in texts if not got.get(k)} | {None}


@pytest.mark.parametrize("items", [60, 300])  # fewer and more than a value has probes
def test_blocks_find_all_within_the_radius(items):
    r = np.random.default_rng(2)
    lanes = decontam.BITS // 64
    prints = r.integers(0, 1 << 63, (items, lanes), np.uint64)
    prints[40:50] = prints[7]  # equal items
    index = decontam.BlockIndex(prints)
    asked = np.concatenate([prints[: items // 3][::items // 60], prints[: items // 3][::items // 60], r.integers(0, 1 << 63, (20, lanes), np.uint64)])
    for row, turned in enumerate([decontam.RADIUS] * 20 + [decontam.RADIUS + 1] * 20):
        for bit in r.choice(decontam.BITS, turned, replace=False).tolist():
            asked[row, bit // 64] ^= np.uint64(1 << bit % 64)
    a, i = index.near(asked)
    want = {(x, y) for x in range(len(asked)) for y in range(len(prints)) if np.bitwise_count(asked[x] ^ prints[y]).sum() <= decontam.RADIUS}
    assert len(a) == len(want) >= 20 and set(zip(a.tolist(), i.tolist(), strict=True)) == want


def test_blocks_rule_out_nearly_all_unlike_pairs():
    r = np.random.default_rng(3)
    held, asked = (r.integers(0, np.iinfo(np.uint64).max, (1000, decontam.BITS // 64), np.uint64, endpoint=True) for _ in range(2))
    share = len(decontam.BlockIndex(held).candidates(asked)) / 1e6
    assert share < 0.02, share


def test_windows_within_the_similarity_are_found_but_for_few(spark, sf):
    """Recall of the radius: against all windows of all documents' words, without fingerprints and without the bound on
    known shingles. Edits are new words, or words and passages of other items."""
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    r = random.Random(6)
    near, unbound, every = decontam.Items(bench), decontam.Items(bench, bound=False), decontam.Items(bench, index=decontam.AllPairs, bound=False)
    hashes = decontam.WordHashes()
    every_word = [decontam.words_of(t) for _, t in bench]
    for kind in ("new words", "other items"):
        found = total = 0
        for n, (_, text) in enumerate(bench * 4):
            w = decontam.words_of(text)
            if kind == "new words":
                for k in r.sample(range(len(w)), max(1, len(w) // 25)):  # up to about a fifth of the shingles change
                    w[k] = b"zz%d" % k
            else:
                cut = len(w) * 17 // 20  # the item goes on as another item does
                w = w[:cut] + r.choice(every_word)[cut:]
            h = hashes.of([*decontam.words_of(words(30, r.random())), *w, *decontam.words_of(words(30, r.random()))])
            want = {m[0] for m in every.matches(h)}
            got = near.matches(h)
            assert n % 8 or got == unbound.matches(h)
            total += len(want)
            found += len(want & {m[0] for m in got})
        assert total > 50 and found >= 0.99 * total, (kind, found, total)


def test_many_items_of_one_size_against_all_pairs():
    texts = [words(80, 3000 + k) for k in range(200)]
    bench = [(k, " ".join(t.split()[20:50])) for k, t in enumerate(texts)]
    hashes = decontam.WordHashes()
    asked = [hashes.of(decontam.words_of(t)) for t in texts]
    items = decontam.Items(bench)
    assert items.sizes[0][4].filed is not None
    got = items.matches_of(asked)
    assert got == decontam.Items(bench, index=decontam.AllPairs).matches_of(asked)
    assert [[m[:2] for m in of] for of in got] == [[(k, 20)] for k in range(200)]


def test_top_k_against_all_pairs(spark):
    r = np.random.default_rng(1)
    rows = [(int(k), [float(np.float32(x)) for x in r.integers(-3, 4, 6) / 8], 1) for k in range(300)]
    rows += [(300, None, 1), (301, [float("nan")] * 6, 1), (302, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 1), (None, [1.0] * 6, 1), (40, rows[40][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score long")
    q = [(k, np.floor(64 * np.array(v)).astype(int)) for k, v, _ in [*rows[:300], rows[-1]]]  # the repeated row is one of its own
    want = Counter()
    for a, (k, v) in enumerate(q):
        if k % 20 == 0:
            best = sorted((-int(v @ w), j) for b, (j, w) in enumerate(q) if b != a)[:20]
            want.update((k, n + 1, j, -s) for n, (s, j) in enumerate(best))
    for shard, block in ((8192, 1024), (24, 4)):
        assert Counter(map(tuple, ballsearch.search(df, k=20, shard_rows=shard, query_rows=block).collect())) == want
    assert ballsearch.search(df.where("vec_id < 3")).count() == 2
    assert ballsearch.search(df.where("vec_id < 0")).count() == 0


def test_top_k_of_large_mixed_and_repeated_vectors(spark):
    r = np.random.default_rng(4)
    rows = [(k, [float(375 * k)] * 64) for k in range(41)]  # scores past 2^39
    rows += [(100 + k, [float(x) for x in r.integers(-9, 10, k % 7)]) for k in range(60)]  # lengths 0 to 6
    rows += [(200 + k, [float(x) for x in r.integers(-(1 << 40), 1 << 40, 5)]) for k in range(30)]  # sums past 2^53
    rows += [(300, [1e300, 1.0]), (301, [-1e300]), (302, [3e12, 4e12])]  # past a long
    rows += [(120, [5.0, 5.0]), (120, [-9.0, 1.0]), (120, [5.0, 5.0])]  # one id, different vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    cut = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    q = [(k, [cut(int(np.floor(64 * x))) for x in v]) for k, v in rows]
    want = Counter()
    for a, (k, v) in enumerate(q):
        if k % 20 == 0:  # every row asks, and all other rows, also those of its id, are candidates
            best = sorted((-max(cut(sum(x * y for x, y in zip(v, w))), -(1 << 63) + 1), j) for b, (j, w) in enumerate(q) if b != a)[:20]  # noqa: B905
            want.update((k, n + 1, j, -s) for n, (s, j) in enumerate(best))
    assert Counter(map(tuple, ballsearch.search(df, k=20, shard_rows=20, query_rows=3).collect())) == want


PAGE = '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>if(a<b){"</p>"}</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use</div><div class="wrap"><div class="sidebar"><p>side text side text side text</p></div><article class="post-%d"><h1>Head &amp; more</h1><p><b>One  two<br><p>Three&nbsp;four <a href="y">link</a>.</p><form><p>form</p></form><ul><li>a<li>b</ul><section class="comments"><p>bad</p></section></article></div><footer>&copy; f</footer></body></html>'
TEXT = "Head & more\nOne two\nThree four link.\na\nb"


def test_html_main_text(spark):
    rows = [(k, f"http://h.example/{k}", PAGE % k, "c") for k in range(5)]
    rows += [(5, "http://h.example/5", "", "c"), (6, None, None, "c"), (7, "http://o.example/", "<p>bare text of a page", "c"), (0, "http://h.example/0", PAGE % 0, "c"), (8, "http://h.example/8", "<div><p>other layout here</p></div>", "c"), (None, "x", PAGE % 3, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = htmlmain.extract(df).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for k in (0, 1, 2, 3, 4, None):
        assert (by_id[k].text, by_id[k].n_chars) == (TEXT, len(TEXT))
    assert (by_id[5].text, by_id[6].text, by_id[7].text, by_id[8].text) == ("", "", "bare text of a page", "other layout here")
    assert htmlmain.extract(df.where("page_id < 0")).count() == 0


def test_html_junk_by_class():
    page = "<body><div class='pageheader header'>top</div><article><div class='entry-header'><h1>Title</h1></div><p>Body text</p><ol class='commentlist'><li>bad</li></ol><div class='ad-box'>buy</div><div id='cookiebar'>ok?</div></article></body>"
    assert htmlmain.main_text(page, None) == "Title\nBody text"
    assert htmlmain.main_text("<p>cut off in a tag <a href='x", None) == "cut off in a tag"
    assert htmlmain.main_text("plain &am text &amp &lt;b&gt;", None) == "plain &am text & <b>"


PROSE = "A sentence of the article that is long enough to be told from a label or a button, with a full stop."


@pytest.mark.parametrize("name", ["related-work", "alert", "hidden-figures", "banner", "search-algorithms", "commentary", "adaptive", "formula", "notice-period", "menu-engineering"])
def test_html_words_that_may_name_a_part_of_an_article(name):
    page = f"<body><article><h1>T</h1><p>{PROSE}</p><section class='{name}'><p>Part. {PROSE}</p></section></article></body>"
    assert htmlmain.main_text(page, None) == htmlmain.main_text(page, ">article") == f"T\n{PROSE}\nPart. {PROSE}"
    links = f"<body><article><p>{PROSE}</p><ul class='related'><li><a href='x'>One more</a><li><a href='y'>Two more</a></ul></article></body>"
    assert htmlmain.main_text(links, None) == PROSE


def test_html_inline_elements_keep_their_text():
    page = f"<article><p>Press <button type=button>Go</button> for <math><mi>x</mi>=1</math>. {PROSE}</p><form><button>Send</button></form></article>"
    assert htmlmain.main_text(page, None) == f"Press Go for x=1. {PROSE}"


def test_html_text_in_sibling_containers():
    page = f"<body><div class=nav>menu</div><div class=page><div class=intro><p>Intro. {PROSE}</p></div><div class=text><p>{PROSE}</p><p>{PROSE}</p></div><div class=tags><a href=x>t</a></div></div></body>"
    assert htmlmain.main_text(page, None).startswith(f"Intro. {PROSE}\n{PROSE}\n{PROSE}")
    assert htmlmain.vote(page)[0] == ">div.page"
    two = f"<body><article><p>{PROSE}</p></article><p>x</p><article><p>Two. {PROSE} {PROSE}</p></article></body>"
    assert htmlmain.main_text(two, None) == htmlmain.main_text(two, ">article") == f"{PROSE}\nTwo. {PROSE} {PROSE}"


def test_html_long_page_and_ties(spark):
    long = "<article>" + "".join(f"<p>{k} {PROSE}</p>" for k in range(20_000)) + "</article>"
    assert htmlmain.main_text(long, None).count("\n") == 19_999
    a, b = f"<div class=b><p>{PROSE}</p></div>", f"<div class=a><p>{PROSE}</p></div>"
    df = spark.createDataFrame([(1, "http://t/1", a), (2, "http://t/2", b), (3, "http://t/3", a + "<p>x</p>" + b)], "page_id long, url string, html string")
    assert {r.host: r.path for r in htmlmain.host_paths(df.where("page_id < 3")).collect()} == {"t": ">div.a"}
    assert {r.page_id: r.text for r in htmlmain.extract(df).collect()}[3].count(PROSE) == 1 + (htmlmain.host_paths(df).first().path == "")


class SlowExtractor(__import__("html.parser").parser.HTMLParser):
    """The article's blocks without adverts, by the library's parser: a plain reading of the given pages."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.blocks, self.depth, self.skip, self.now = [], 0, 0, ""
        self.feed(page)
        self.cut()

    def cut(self):
        if self.now.split():
            self.blocks.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "a", "br", "meta"):
            self.cut()
        if tag == "br":
            self.now += " " if self.depth and not self.skip else ""
        self.depth += tag == "article"
        self.skip += tag == "div" and self.depth > 0 and (("class", "ad") in attrs or self.skip > 0)

    def handle_endtag(self, tag):
        if tag not in ("b", "a"):
            self.cut()
        self.depth -= tag == "article"
        self.skip -= tag == "div" and self.skip > 0

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.now += data


def test_html_of_the_given_pages_against_a_plain_parser(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op5_html"](spark, sf).collect()}
    assert len(got) == len(pages)
    for k, page in pages.items():
        want = "\n".join(SlowExtractor(page or "").blocks)
        assert (got[k].text, got[k].n_chars) == (want, len(want)), k


def test_host_path_outvotes_a_page():
    odd = "<body><div class='post'><p>short main</p></div><div class='other'><p>" + "long but not main " * 20 + "</p></div></body>"
    assert htmlmain.main_text(odd, ">div.post") == "short main"
    assert htmlmain.main_text(odd, ">div.absent").startswith("long")


def slow_phrases(text, sample):
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        at += k
        n += 1
    return n


def test_cross_parsing_counts_phrases():
    samples = {"aa": words(300, 1), "bb": words(300, 2).upper().replace("A", "K")}
    p = langid.CrossParser(samples, block=64)
    text = words(80, 3)
    coded = langid.folded(text)
    for k, lang in enumerate(p.langs):
        s = langid.folded(samples[lang])
        want = sum(slow_phrases(coded[a : a + 64], s) for a in range(0, len(coded), 64))
        assert p.phrases([text])[0][k] == want


def test_language_id(spark, docs, texts, none):
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    for k in texts:
        assert got[k].held_out == langid.crc_held_out(k)
        assert 0 <= got[k].score <= 1
        assert (got[k].lang_pred == "und") == (k in (14, 15))
    assert langid.language_id(none).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in texts if k not in (14, 15)} | {None}


def test_languages_of_many_scripts(spark):
    """A wide alphabet (thousands of ideographs), letters above U+FFFF and small scripts side by side."""
    r = random.Random(3)
    spans = {"en": (97, 122), "ru": (0x430, 0x44F), "el": (0x3B1, 0x3C9), "hi": (0x905, 0x939), "zh": (0x4E00, 0x5800), "got": (0x10330, 0x1034A)}
    lexicon = {k: ["".join(chr(r.randint(*s)) for _ in range(r.randint(1, 5))) for _ in range(400)] for k, s in spans.items()}
    samples = {k: " ".join(r.choice(v) for _ in range(2000)) for k, v in lexicon.items()}
    p = langid.CrossParser(samples)
    assert len(p.symbols) > 1000
    for k, v in lexicon.items():
        text = " ".join(r.choice(v) for _ in range(20))
        assert p.predict([text])[0] == [k]
        coded = langid.folded(text)
        for j, lang in enumerate(p.langs):
            assert p.phrases([text])[0][j] == slow_phrases(coded[:256], langid.folded(samples[lang])) + (slow_phrases(coded[256:], langid.folded(samples[lang])) if len(coded) > 256 else 0)
    assert p.predict(["\u05d0\u05d1"]) == ([p.langs[0]], [0.5])  # letters of no sample: a tie, first in order


def test_keep_identified_names_and_chooses_languages(spark):
    p = langid.CrossParser({"aa": words(300, 1), "bb": words(300, 2).translate(str.maketrans("abcdefghij", "klmnopqrst"))})
    df = spark.createDataFrame([(1, words(9, 5), "bb"), (2, "kl mno qrs", None), (3, "12", "aa")], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.lang) for r in langid.keep_identified(df, p).collect()) == [(1, "aa"), (2, "bb")]
    assert [r.doc_id for r in langid.keep_identified(df, p, langs=["bb"]).collect()] == [2]


def test_keep_identified_without_a_labelled_row(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, "", None), (3, None, None), (4, "12 !", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.keep_identified(df).collect()] == [1]


def test_language_id_is_right_on_held_out_rows(spark, sf):
    rows = QUERIES["op6_langid"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97


def slow_lm(texts, order=2, backoff=0.4):
    toks = {k: ["<s>", *[w.decode() for w in decontam.words_of(t or "")]] for k, t in texts}
    grams = {k: Counter(tuple(v[i - n + 1 : i + 1]) for n in range(1, order + 1) for i in range(n - 1, len(v))) for k, v in toks.items()}
    total = sum(grams.values(), Counter())
    words_all = sum(len(v) - 1 for v in toks.values())
    out = {}
    for k, v in toks.items():
        c = lambda g: total[g] - grams[k][g]  # noqa: E731, B023
        n, s = words_all - (len(v) - 1), 0.0
        for i in range(1, len(v)):
            p = max(c((v[i],)), 1) / max(n, 1)
            for m in range(2, order + 1):
                if i - m + 1 >= 0:
                    g = tuple(v[i - m + 1 : i + 1])
                    p = c(g) / c(g[:-1]) if c(g) > 0 and c(g[:-1]) > 0 else backoff * p
            s += np.log(p)
        out[k] = (len(v) - 1, s)
    return out


def test_lm_scores(spark, texts, none):
    rows = [(k, (t + " the cat sat on the mat the end" if t else t)) for k, t in texts.items()]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, piece string")
    got = {r.doc_id: r for r in lmscore.score_documents(df).collect()}
    for k, (n, s) in slow_lm(rows).items():
        assert got[k].n_words == n
        assert got[k].log_score == pytest.approx(s, abs=1e-6), k
        assert (got[k].mean_log_score is None) == (n == 0)
    assert lmscore.score_documents(none).count() == 0


def test_packed_counts_round_trip():
    n = np.array([0, 1, 254, 255, 256, 10**12])
    assert (lmscore.unpack_counts(lmscore.pack_counts(n), len(n)) == n).all()
    h = np.array([5, (1 << 48) - 1, (1 << 63) + 9], np.uint64)
    assert (lmscore.unpack48(lmscore.pack48(h)) == (h & lmscore.MASK)).all()


def slow_chunks(text):
    """(line, lines, chunk) of the chunks of a text, one line at a time."""
    lines = text.split("\n")
    h = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines]
    r = []
    for a, b in zip(h, h[1:]):
        x = (a * 0x9E3779B97F4A7C15 + b) % 2**64
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % 2**64
        r.append(x ^ (x >> 32))
    starts = [0] + [k for k in range(2, len(r) - 1) if r[k - 1] > r[k] < r[k + 1]] + [len(lines)]
    found = [(a, z - a, "\n".join(lines[a:z])) for a, z in zip(starts, starts[1:])]
    return [c for c in found if c[1] > 1 and len("".join(c[2].split()).encode("utf-8", "surrogatepass")) >= linedup.MIN_BYTES]


def slow_lines(rows):
    """rows: (id, text) in the order of the operator; per distinct row the (line, lines) of its chunks that go."""
    seen, out = {}, {}
    for k, t in rows:
        if (k, t) not in out:
            out[k, t] = [(at, n) for at, n, body in slow_chunks(t) if seen.setdefault(body, (k, t, at)) != (k, t, at)] if t and k is not None else []
    return out


def test_line_dedup(docs, texts, none):
    got = {r.doc_id: r for r in linedup.dedup_lines(docs).collect()}
    want = slow_lines(sorted(texts.items()))
    assert want[19, texts[19]] and not want[18, texts[18]]
    for k, t in texts.items():
        assert [(x.line, x.n_lines) for x in got[k].removed] == want[k, t]
        assert got[k].text == (linedup.without_lines(t, want[k, t]) if t is not None else None)
    assert linedup.dedup_lines(none).count() == 0
    again = {r.doc_id: r for r in linedup.replace_text(docs).collect()}
    assert again[19].text == got[19].text and again[19].h == 7


def test_line_chunks_stay_where_they_are():
    r = random.Random(1)
    lines = [words(8, k) for k in range(200)]
    cuts = linedup.boundaries([x.encode() for x in lines])
    sizes = [b - a for a, b in zip(cuts, cuts[1:])]
    assert min(sizes) >= 2 and 2.5 < sum(sizes) / len(sizes) < 4
    more = [words(8, 1000 + k) for k in range(r.randint(1, 30))]
    moved = {c - len(more) for c in linedup.boundaries([x.encode() for x in more + lines])}
    assert set(cuts[2:]) <= moved


def code(name, other):
    return "\n".join([f"def {name}() {{", f"  if ({other}) {{", f"    return {name[-1]};", "  }", "}", "", f"class {other.upper()} {{", f"  int {other};", "  }", "}", ""])


def test_line_dedup_leaves_ordinary_text(spark):
    """Brackets and blank lines recur, but are no passage; what no earlier text holds as a whole stays."""
    rows = [(k, code(f"f{k}", f"a{k}")) for k in range(6)] + [(10, "p\nq\nzzz"), (11, "q\nr\nyyy"), (12, "p\nq\nr")]
    p, q, r, y, z = (words(12, 90 + k) for k in range(5))
    rows += [(20, "\n".join([p, q, z])), (21, "\n".join([q, r, y])), (22, "\n".join([p, q, r])), (23, "\n".join([p, q, r]))]
    got = {x.doc_id: x for x in linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(got[k].text == t and got[k].n_removed == 0 for k, t in rows if k < 23)
    assert got[23].text == "" and [tuple(x) for x in got[23].removed] == [(0, 3)]  # 22 is the whole of it


def test_replace_text_takes_any_column_names(spark):
    passage = "\n".join(words(10, k) for k in range(8))
    names = "__several long, v int, text string, doc_id long, gone string, `row` string, __version int, __id int, n_chars long"
    rows = [(1, 2, t, k, "g", "r", 5, 6, len(t)) for k, t in ((1, passage), (2, "intro\n" + passage), (3, passage))]
    df = spark.createDataFrame(rows, names)
    out = linedup.replace_text(df)
    assert out.schema == df.schema
    got = {x.doc_id: x for x in out.collect()}
    assert set(got) == {1, 2} and got[1] == df.where("doc_id = 1").first()
    assert (got[2].gone, got[2]["row"], got[2].v, got[2].n_chars) == ("g", "r", 2, len(got[2].text)) and len(got[2].text) < len(passage) / 2


def in_order(spark, rows):
    """Rows by id, those of one id by the hash of their text, as the operators order them."""
    df = spark.createDataFrame([(k, t) for k, t in rows], "doc_id long, text string")
    return [(r.doc_id, r.text) for r in df.selectExpr("*", "xxhash64(text) as h").orderBy("doc_id", "h").collect()]


def two_texts_of_one_id():
    a, b, c = ("\n".join(words(9, 700 + 10 * k + j) for j in range(5)) for k in range(3))
    return [(1, a), (2, a), (2, b), (2, b), (3, b + "\n" + c), (3, c), (4, c), (4, ""), (4, None), (None, c), (None, c)]


def test_line_dedup_tells_texts_of_one_id_apart(spark):
    rows = two_texts_of_one_id()
    want = slow_lines(in_order(spark, rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.text, r.n_removed) for r in linedup.dedup_lines(df).collect())
    assert got == Counter((k, t and linedup.without_lines(t, want[k, t]), len(linedup.lines_of(want[k, t]))) for k, t in rows)
    assert got[2, rows[2][1], 0] == 2 and got[2, "", 5] == 1  # b stands nowhere before
    kept = Counter((r.doc_id, r.text) for r in linedup.replace_text(df).collect())
    assert kept == Counter((k, t and linedup.without_lines(t, want[k, t])) for k, t in rows if not (want[k, t] and len(linedup.lines_of(want[k, t])) == t.count("\n") + 1))


def test_line_dedup_compares_bytes(spark):
    rows = [(k, "\n".join(words(5, 50 + (k * j) % 7) for j in range(6))) for k in range(12)]
    want = slow_lines(rows)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, v long")
    got = {}
    for r in linedup.repeated_chunks(df, lambda body: bytes([len(body) % 2] * 16)).collect():  # nearly all digests meet
        got.setdefault(r.doc_id, []).append((r.line, r.n_lines))
    assert {k: sorted(v) for k, v in got.items()} == {k: at for (k, _), at in want.items() if at}


def test_keep_one_leaves_one_row_of_each_group(spark):
    rows = two_texts_of_one_id() + [(5, words(40, 3)), (5, words(40, 3)), (None, words(40, 4)), (None, words(40, 4)), (6, "é"), (6, "É a")]
    df = spark.createDataFrame([(*r, "s%d" % k) for k, r in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    root = list(range(len(rows)))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else frozenset() for _, t in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root = [root[j] if r == root[i] else r for r in root]
    got = simhash.keep_one(df).collect()
    groups = {}
    for r, (k, _) in zip(root, rows, strict=True):
        groups.setdefault(r, []).append(k)
    least = Counter(min((k for k in g if k is not None), default=None) for g in groups.values())
    assert Counter(r.doc_id for r in got) == least
    assert len({r.source for r in got}) == len(got) == len(groups)


def test_line_dedup_of_passages_inside_other_texts(spark):
    """Nothing goes that is not in the passages, and of these the more, the longer they are."""
    rng, rows, share = random.Random(4), {}, {}
    line = lambda: words(rng.randint(6, 14), rng.random())
    for n in (4, 8, 16, 32):
        for _ in range(40):
            p = [line() for _ in range(n)]
            for _ in range(2):
                before = [line() for _ in range(rng.randint(1, 9))]
                rows[len(rows)] = (n, len(before), before + p + [line() for _ in range(rng.randint(1, 9))])
    df = spark.createDataFrame([(k, "\n".join(v)) for k, (_, _, v) in rows.items()], "doc_id long, text string").repartition(3)
    for r in linedup.dedup_lines(df).collect():
        n, at, lines = rows[r.doc_id]
        gone = {k for x in r.removed for k in range(x.line, x.line + x.n_lines)}
        assert gone <= set(range(at, at + n)) and r.text == "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if r.doc_id % 2:
            share[n] = share.get(n, 0) + len(gone) / n / 40
        else:
            assert not gone
    print({n: round(x, 2) for n, x in share.items()})
    assert share.get(8, 0) > 0.3 and share[16] > 0.65 and share[32] > 0.8


def slow_spans(rows):
    seen, out = {}, {}
    for k, t in rows:
        if (k, t) in out or k is None:
            out.setdefault((k, t), [])
            continue
        raw = (t or "").encode()
        ends = substrdedup.boundaries(raw)
        runs = []
        for a, z in zip([0, *ends[:-1]], ends, strict=True) if ends else []:
            if raw[a:z] in seen:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = z
                else:
                    runs.append([a, z])
            seen.setdefault(raw[a:z], k)
        out[k, t] = [(a, z - a) for a, z in runs if z - a >= substrdedup.MIN_RUN]
    return out


def test_substring_dedup(docs, texts, none):
    got = {r.doc_id: r for r in substrdedup.dedup_substrings(docs).collect()}
    want = {k: v for (k, _), v in slow_spans(sorted(texts.items())).items()}
    assert want[12] and want[21] and want[19] and not want[0] and not want[3]
    for k, t in texts.items():
        assert [(s.start, s.size) for s in got[k].spans] == want[k]
        assert got[k].n_removed == sum(n for _, n in want[k])
        assert got[k].text is None if t is None else len(got[k].text.encode()) == len(t.encode()) - got[k].n_removed
    assert got[12].text == ""
    assert substrdedup.dedup_substrings(none).count() == 0


def test_substring_dedup_is_alike_with_hot_chunks(spark, monkeypatch):
    passage = words(60, 1234)
    rows = [(k, f"{words(20, 500 + k)} {passage} {words(20, 700 + k)}") for k in range(40)] + [(40, words(80, 77)), (41, words(80, 77))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, substrdedup.dedup_substrings(df).collect()))
    assert sum(n > 0 for _, _, n, _ in want) == 40
    monkeypatch.setattr(common, "HOT_LEAST", 10)  # the chunks of the passage are hot, those of the copy are not
    assert sorted(map(tuple, substrdedup.dedup_substrings(df).collect())) == want


def test_substring_dedup_tells_texts_of_one_id_apart(spark):
    rows = two_texts_of_one_id()
    want = slow_spans(in_order(spark, rows))
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = Counter((r.doc_id, r.text, r.n_removed) for r in substrdedup.dedup_substrings(df).collect())
        assert got == Counter((k, t and substrdedup.without_spans(t.encode(), [{"start": a, "size": n} for a, n in want[k, t]]).decode(), sum(n for _, n in want[k, t])) for k, t in rows)
    assert got[2, rows[2][1], 0] == 2


def test_substring_dedup_of_repeated_rows_in_one_partition(spark):
    text = words(60, 1)
    df = spark.createDataFrame([(3, text), (3, text), (4, words(60, 2) + " " + text)], "doc_id long, text string").coalesce(1)
    got = substrdedup.dedup_substrings(df).collect()
    assert [(r.text, r.n_removed) for r in got if r.doc_id == 3] == [(text, 0)] * 2
    assert [r.n_removed > 100 for r in got if r.doc_id == 4] == [True]


def test_gear_hash_rolls():
    raw = bytes(random.Random(1).randrange(256) for _ in range(200))
    h = 0
    for b in raw:
        h = ((h << 1) + int(substrdedup.GEAR[b])) & 0xFFFFFFFF
    assert h == substrdedup.gear_hash(np.frombuffer(raw, np.uint8))[-1]


def long(words_, k=10):
    return " ".join(f"{words_} number {j} of them." for j in range(k))


def test_forms_around_the_page_and_short_siblings():
    menu, form = "<ul><li><a href=a>Home page</a><li><a href=b>About us all</a></ul>", "<form action=s><p>Subscribe to our letters</p><input name=m></form>"
    asp = f"<body><form id='aspnetForm'>{menu}<article><h1>Title</h1><p>{long('A line')}</p></article><footer>Imprint</footer></form></body>"
    want = f"Title\n{long('A line')}"
    for path in (htmlmain.vote(asp)[0], None, ">div.other"):
        assert htmlmain.main_text(asp, path) == want
    bare = f"<body><form id=f><div class=text><p>{long('A line')}</p></div><input></form>{form}</body>"
    assert htmlmain.main_text(bare, htmlmain.vote(bare)[0]) == long("A line")
    end = f"<body><div class=one><p>{long('A line')}</p></div><div class=two>That is all.</div>{menu}{form}<div class=sidebar>Weather: fine</div></body>"
    both = f"<body>{menu}<div class=one><p>{long('A line')}</p></div><div class=two><p>{long('More of it')}</p><p>The end.</p></div><footer>Imprint</footer></body>"
    assert htmlmain.main_text(end, ">div.two") == "That is all."  # the host says so, and this page is unlike it
    for path in (">div.one", None, "", htmlmain.vote(end)[0]):
        assert htmlmain.main_text(end, path) == f"{long('A line')}\nThat is all."
    for path in (">div.one", ">div.two", None, "", htmlmain.vote(both)[0]):
        assert htmlmain.main_text(both, path) == f"{long('A line')}\n{long('More of it')}\nThe end."


@pytest.mark.parametrize("seed", range(6))
def test_pages_of_other_templates_against_what_was_put_in(spark, seed):
    """Pages without an article element, inside a form or not, their body in one container or in several."""
    r = random.Random(seed)
    rows, want = [], {}
    for k in range(12):
        parts = [long(f"Paragraph {k} {j}", r.randint(1, 6)) for j in range(r.randint(1, 5))]
        cuts = sorted(r.sample(range(len(parts) + 1), min(2, len(parts) + 1)))
        groups = [g for g in (parts[: cuts[0]], parts[cuts[0] : cuts[-1]], parts[cuts[-1] :]) if g]
        body = "".join(f"<div class='part{j}'>" + "".join(f"<p>{p}</p>" for p in g) + "</div>" for j, g in enumerate(groups))
        junk = ["<nav><a href=x>Start</a></nav>", "<div class=sidebar>Weather is fine today.</div>", "<form><label>Search all</label></form>", "<div class='cookie-notice'>We use cookies here.</div>", "<footer>Imprint and more.</footer>"]
        page = f"<div>{r.choice(junk)}</div>{r.choice(junk)}<section>{body}</section>{r.choice(junk)}"
        page = f"<form id=all>{page}<input type=hidden></form>" if seed % 2 else page
        rows.append((k, f"http://h{k % 2}/p", f"<html><head><title>t</title></head><body>{page}</body></html>"))
        want[k] = "\n".join(parts)
    got = htmlmain.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {x.page_id: x.text for x in got} == want


def test_near_dedup_links_by_fingerprints_first(spark, sf, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    asked, links = [], simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda *a, **k: asked.append(links(*a, **k)) or asked[-1])
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words), " ".join([*words[:299], "other"]), "a text of its own with a few words"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    signed = [(k, int(np.uint64(simhash.majority(simhash.shingle_set(t))).view(np.int64))) for k, t in enumerate(texts)]
    assert [tuple(r) for r in simhash.fingerprint_pairs(spark.createDataFrame(signed, "node long, fp long")).collect()] == [(0, 1)]
    assert len(asked) == 1
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, sf).collect()) == [0, 2]
    assert len(asked) == 2  # the stage links by them, too
