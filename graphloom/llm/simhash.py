"""SimHash near-duplicates: links by BK-trees over shards, then components.

Fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of the blocks that their bits are
cut into, so two of them always meet in a shard (a choice of blocks and their bits). Each shard has a BK-tree,
whose children are keyed by the integer Hamming distance to their parent; a lookup follows only the edges within
the radius of its own distance. A shard emits a spanning forest of its links, never all pairs.

``keep_one`` drops near copies by another rule, the similarity of their sets of shingles. The same fingerprints and trees
give the first candidates, MinHash bands those that lie further apart, and the sets themselves decide.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop_table, write_table
from .common import P, WordHashes, id_text, join_by_count, map_batches, mixed, pieces, shingle_hashes

RADIUS = 4
BLOCKS = 6
#: A tree has at most about so many nodes; a shard with more is split, and its members look into each part.
TREE = 30_000

#: Near copies that keep_one drops: Jaccard similarity over runs of so many words. The radius above
#: gives the first candidates for these.
COPY_WORDS = 5
COPY_SIMILARITY = 0.8
#: Two sets at similarity 0.8 share none of the bands with a chance of (1 - 0.8^4)^20, under 3 in 100,000.
BANDS = 20
BAND_ROWS = 4
#: Bands with many members: so many are compared with all others first, at most so many times.
HUBS = 4
HUB_TURNS = 1
#: Of a band with at most so many members the pairs are listed; the members of a larger one meet in one task instead,
#: PART shingles at a time.
CROWD = 16
PART = 200_000
SEEDS = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64)
SEEDS[1] |= np.uint64(1)

_hashes = WordHashes()


def fingerprint(text: str | None, n: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of the word shingles of ``text``: a bit is 1 if set in over half of the hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, and \x20 \x09-\x0D
    if not words:
        return 0
    n = min(n, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = (np.concatenate([[0], ends[:-1] + 1])[: len(words) - n + 1]).tolist()
    hashed, digest = ends[n - 1 :].tolist(), xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:z], seed) for a, z in zip(starts, hashed, strict=True)], np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) for every row."""

    def run(batch: pa.RecordBatch):
        for part in pieces(batch):
            fps = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
            yield {"doc_id": part.column("doc_id"), "fp": pa.array(fps)}

    return map_batches(id_text(docs, id_col, text_col), run, "doc_id long, fp long")


class BKForest:
    """BK-trees of many shards at once; ``shard`` has the shard of each fingerprint, which are distinct within it."""

    def __init__(self, shard: np.ndarray, fps: np.ndarray):
        self.fps = fps
        edge = [np.zeros(0, np.int64)] * 2
        waiting = np.arange(len(fps))
        self.roots, first = np.unique(shard, return_index=True)
        self.root_node = first
        at = np.zeros(len(fps), np.int64)  # the node that a waiting item is compared with
        at[:] = first[np.searchsorted(self.roots, shard)]
        waiting = waiting[at[waiting] != waiting]
        keys, nodes = [edge[0]], [edge[1]]
        while len(waiting):
            d = np.bitwise_count(fps[waiting] ^ fps[at[waiting]]).astype(np.int64)
            key = at[waiting] * 65 + d
            slots, first, which = np.unique(key, return_index=True, return_inverse=True)
            child = waiting[first]
            keys.append(slots)
            nodes.append(child)
            at[waiting] = child[which]
            waiting = waiting[at[waiting] != waiting]
        keys, nodes = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(keys, kind="stable")
        self.keys, self.nodes = keys[order], nodes[order]

    def pairs(self, shard: np.ndarray, queries: np.ndarray, radius: int, most: int = 400_000):
        """Yields (query, node) indices within ``radius``, in portions; a query looks into the tree of its shard."""
        has = np.searchsorted(self.roots, shard)
        ok = (has < len(self.roots)) & (self.roots[np.minimum(has, len(self.roots) - 1)] == shard)
        stack = [(np.flatnonzero(ok), self.root_node[has[ok]])]
        while stack:
            q, u = stack.pop()
            if len(q) > most:
                stack += [(q[most:], u[most:])]
                q, u = q[:most], u[:most]
            if not len(q):
                continue
            d = np.bitwise_count(queries[q] ^ self.fps[u]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], u[near]
            lo = np.searchsorted(self.keys, u * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, u * 65 + np.minimum(d + radius, 64), "right")
            n = hi - lo
            total = int(n.sum())
            if total:
                below = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
                stack.append((np.repeat(q, n), self.nodes[below]))


def unite(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a-b: the smallest index of each component."""
    while True:
        la, lb = lab[a], lab[b]
        m = la != lb
        if not m.any():
            return lab
        np.minimum.at(lab, np.maximum(la[m], lb[m]), np.minimum(la[m], lb[m]))
        while (nxt := lab[lab]).tobytes() != lab.tobytes():
            lab = nxt


def _shard_links(radius: int):
    def links(key: np.ndarray, part: np.ndarray, home: np.ndarray, asks: np.ndarray, fp: np.ndarray) -> dict:
        turn = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (part[1:] != part[:-1]))])  # rows are sorted by both
        value = fp.view(np.uint64)
        rows, ask = np.flatnonzero(home), np.flatnonzero(asks)
        tree = BKForest(turn[rows], value[rows])
        lab = np.arange(len(fp))
        for q, u in tree.pairs(turn[ask], value[ask], radius):
            lab = unite(lab, ask[q], rows[u])
        other = np.flatnonzero(lab != np.arange(len(lab)))
        return {"a": fp[lab[other]], "b": fp[other]}

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 150_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            keys, parts = t.column("key").to_numpy(), t.column("part").to_numpy()
            ends = np.flatnonzero((keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1]))
            cut = int(ends[-1]) + 1 if len(ends) else 0  # the last shard may go on
            if cut:
                yield from emit(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = t.num_rows - cut
        if size:
            yield from emit(pa.Table.from_batches(held))

    def emit(t: pa.Table):
        out = links(*(t.column(c).to_numpy() for c in ("key", "part", "home", "asks", "fp")))
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def shard_key(fp: F.Column, blocks: int, radius: int) -> F.Column:
    """The keys of all shards that a fingerprint is in: each choice of blocks - radius blocks, with their bits."""
    width = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
    low = [sum(width[:k]) for k in range(blocks)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << width[k]) - 1) << low[k] for k in chosen)
        bits = fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        keys.append(F.xxhash64(F.lit(n), bits))
    return F.array(*keys)


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree: int = TREE) -> DataFrame:
    """a, b: links that connect just what all pairs of ``distinct.fp`` within ``radius`` bits connect."""
    keyed = distinct.select("fp", F.explode(shard_key(F.col("fp"), blocks, radius)).alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > tree).select("key", F.ceil(F.col("count") / tree).cast("int").alias("parts"))
    placed = keyed.join(large, "key", "left").select("key", "fp", F.coalesce("parts", F.lit(1)).alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # parts i and j of a shard meet in one group: i's tree, j's lookups; so no group is larger than two parts
    rows = placed.withColumn("own", own).select("key", "fp", "parts", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("x"))
    pair = F.least("own", "x") * F.col("parts") + F.greatest("own", "x")
    rows = rows.select("key", pair.cast("long").alias("part"), (F.col("own") <= F.col("x")).alias("home"), (F.col("own") >= F.col("x")).alias("asks"), "fp")
    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(_shard_links(radius), "a long, b long")


def are_stars(edges: DataFrame) -> bool:
    """Whether no node of the distinct ``edges`` (a < b) is the larger end of two, or the larger of one and the smaller of
    another: then each ``a`` is the smallest node of its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("up")).union(edges.select("b", F.lit(1)))
    other = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups > 0 and least = 0)")
    return other.agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of ``links`` (a, b), by large and small stars.

    The edges are written to the shared folder after each round; only counts reach the driver.
    """
    edges = write_table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not are_stars(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = write_table(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "star-low")
        # the end of many edges is looked up where they are
        large = write_table(join_by_count(both.where("v > u"), low, ["u"]).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct(), "star-large")
        # small star: b is the larger end of an edge, and its smaller neighbours hang below the smallest of them
        least = write_table(large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n")), "star-least")
        small = join_by_count(large, least, ["b"]).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        nxt = write_table(small, "edges")
        for done in (edges, low, large, least):
            drop_table(done)
        edges = nxt
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) for every row.

    Null and empty texts, and those without a word, have fingerprint zero and link like any other. Repeated rows give
    repeated results. A row with a null id keeps a null doc_id and gets the smallest other id of its group, if any;
    it is never a group's id. Other columns are not read; an empty table gives no rows.
    """
    prints = write_table(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = write_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")  # copies meet here, before anything is paired
    linked = components(fingerprint_links(distinct.select("fp"), radius))
    named = named_groups(distinct.withColumnRenamed("fp", "node"), linked)
    of = write_table(distinct.join(named.select(F.col("node").alias("fp"), F.col("least").alias("component_id")), "fp").select("fp", "component_id", "n"), "named-fingerprints")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_by_count(prints, of, ["fp"]).select("doc_id", digits.alias("fingerprint"), "component_id")


def named_groups(distinct: DataFrame, linked: DataFrame) -> DataFrame:
    """node, least for every row of ``distinct`` (node, least): the smallest ``least`` of its component in ``linked``
    (node, component), where a component's own name may be left out; nodes without a link keep their own."""
    nodes = write_table(linked.union(linked.select("component", "component")).distinct(), "members")
    least = nodes.join(distinct.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("least"), F.count("*").alias("n"))
    joined = join_by_count(nodes, write_table(least, "groups"), ["component"]).select("node", "least")
    return joined.unionByName(distinct.join(nodes, "node", "left_anti").select("node", "least"))


def _signatures(batch: pa.RecordBatch):
    """A row's set of word shingles: its digest, its size, its SimHash, and the keys of its bands (none for a text without words)."""
    for part in pieces(batch):
        nodes, sizes, fps, bands = [], [], [], []
        for t in part.column("text").to_pylist():
            h = shingle_set(t)
            nodes.append(xxhash.xxh3_64_intdigest(h.tobytes()))
            sizes.append(len(h))
            fps.append(majority(h))
            bands.append(band_keys(h))
        yield {"doc_id": part.column("doc_id"), "tk": part.column("tk"), "node": pa.array(np.array(nodes, np.uint64).view(np.int64)), "n": sizes, "fp": pa.array(np.array(fps, np.uint64).view(np.int64)), "bands": bands}


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``COPY_WORDS`` words; fewer words are one run, no words none."""
    return np.unique(shingle_hashes(_hashes.of((text or "").encode("utf-8", "surrogatepass").lower().split()), COPY_WORDS))


def band_keys(h: np.ndarray) -> np.ndarray:
    """MinHash: one key a band, equal for two sets where all ``BAND_ROWS`` least values of the band are."""
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(h), 1024):
        least = np.minimum(least, ((h[None, at : at + 1024] ^ SEEDS[0, :, None]) * SEEDS[1, :, None]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BAND_ROWS, BANDS):
        key = mixed(key * P + row)
    return key.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``COPY_SIMILARITY`` or more."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")

    def run(batch: pa.RecordBatch):
        for part in pieces(batch):
            near = [jaccard(x.values.to_numpy(), y.values.to_numpy()) >= COPY_SIMILARITY - 1e-12 for x, y in zip(part.column("ha"), part.column("hb"), strict=True)]
            yield {c: part.column(c).filter(pa.array(near, pa.bool_())) for c in ("a", "b")}

    return map_batches(both.select("a", "b", "ha", "hb"), run, "a long, b long")


def fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """a, b: pairs of nodes of ``distinct`` (node, fp) that connect all nodes whose fingerprints the trees link: those of one
    fingerprint with the smallest of them, and the smallest ones of two linked fingerprints."""
    prints = write_table(distinct.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "set-fingerprints")
    same = join_by_count(distinct, prints, ["fp"]).select(F.col("least").alias("a"), F.col("node").alias("b"))
    end = lambda x: prints.select(F.col("fp").alias(x), F.col("least").alias("n" + x))
    near = fingerprint_links(prints.select("fp")).distinct().join(end("a"), "a").join(end("b"), "b")
    pairs = same.unionByName(near.select(F.col("na").alias("a"), F.col("nb").alias("b"))).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _crowds(members: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links that connect what the similar pairs within each band of ``members`` (key, node, c, shingles) connect.

    A band is cut into parts of about PART shingles, and two parts meet in a task, which counts the shingles that sets
    share along an index of them; no pair becomes a row but those that link.
    """
    parted = members.withColumn("parts", F.ceil(F.col("shingles") / PART).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = parted.select("key", "node", "c", "own", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("x"))
    met = met.select("key", "node", "c", "own", (F.least("own", "x") * F.col("parts") + F.greatest("own", "x")).alias("pair"), (F.col("own") <= F.col("x")).alias("home"), (F.col("own") >= F.col("x")).alias("asks"))

    def link(t: pa.Table) -> pa.Table:
        node, c = t.column("node").to_numpy(), t.column("c").to_numpy()
        held = [x.values.to_numpy() for chunk in t.column("h").chunks for x in chunk]
        size = np.array([len(x) for x in held])
        home, asks = np.flatnonzero(t.column("home").to_numpy()), np.flatnonzero(t.column("asks").to_numpy())
        key = np.concatenate([held[k] for k in home]) if len(home) else np.zeros(0, np.int64)
        owner = np.repeat(home, size[home])
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        root = np.unique(c, return_inverse=True)[1]  # labels of what is connected
        found: list[tuple[int, int]] = []
        for q in asks.tolist():
            lo, hi = np.searchsorted(key, held[q]), np.searchsorted(key, held[q], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(node))
            near = np.flatnonzero(shared >= COPY_SIMILARITY * (size + size[q] - shared) - 1e-9)
            for u in near[root[near] != root[q]].tolist():
                if root[u] != root[q]:
                    found.append((int(node[q]), int(node[u])))
                    root[root == root[u]] = root[q]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return met.join(sets, "node").groupBy("key", "pair").applyInArrow(link, "a long, b long")


def similar_groups(rows: DataFrame) -> DataFrame:
    """doc_id, tk, n (rows), least for every distinct (doc_id, tk) of ``rows`` (doc_id, text, tk): ``least`` (no_id, doc_id,
    tk) is the document of the group that comes first, those without an id last.

    Texts whose shingle sets have a Jaccard similarity of ``COPY_SIMILARITY`` or more are linked; equal sets are one
    node. Each link is verified on the whole sets. Candidates are first what the trees of fingerprints link, then, of what is not
    yet connected, sets that share a band, as fingerprints of sets at just that similarity differ by more than any tree's
    radius could take in. While a band has many pairs, its members are first compared with a few hubs each; at the end all members of a band that are not yet connected are
    compared, and none is left out: the pairs of small bands are listed, those of large ones are counted inside a task.
    """
    signed = write_table(map_batches(rows, _signatures, "doc_id long, tk long, node long, n int, fp long, bands array<long>"), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tk")
    distinct = signed.groupBy("node").agg(F.min(row).alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    distinct = write_table(distinct, "distinct-sets")
    keyed = distinct.select("node", "row", F.col("n").alias("size"), F.explode("bands").alias("key"))
    shared = write_table(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-bands")
    bands = write_table(join_by_count(keyed, shared, ["key"]).select("key", "node", "row", F.col("size").alias("n")), "bands")
    tried = write_table(fingerprint_pairs(distinct.where("n > 0").select("node", "fp")), "fingerprint-pairs")
    asked = bands.select("node").union(tried.select("a")).union(tried.select("b")).distinct()
    wanted = distinct.join(asked, "node").select("node", F.col("row.doc_id").alias("id"), F.col("row.tk").alias("tk"))
    found = rows.join(wanted, (rows.tk == wanted.tk) & rows.doc_id.eqNullSafe(wanted.id)).select(rows.text, "node").dropDuplicates(["node"])

    def hashes(batch: pa.RecordBatch):
        for part in pieces(batch):
            yield {"node": part.column("node"), "h": [shingle_set(t).view(np.int64) for t in part.column("text").to_pylist()]}

    sets = write_table(map_batches(found, hashes, "node long, h array<long>"), "sets")
    stars = components(write_table(_similar(tried, sets), "links"))
    linked = stars.union(stars.select("component", "component")).distinct()
    for turn in range(HUB_TURNS + 1):
        of = bands.select("key", "node", "n")
        of = of.join(linked, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c"))
        per = of.groupBy("key", "c").agg(F.count("*").alias("m"), F.sum("n").alias("shingles")).groupBy("key")
        sizes = write_table(per.agg((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("open"), F.sum("m").alias("members"), F.sum("shingles").alias("shingles")).where("open > 0").withColumn("n", F.col("members")), "band-sizes")
        open_ = write_table(join_by_count(of.withColumnRenamed("n", "size"), sizes, ["key"]).select("key", "node", F.col("size").alias("n"), "c", "open", "members", "shingles"), "open-bands")
        rows_left, all_pairs = open_.agg(F.count("*"), F.sum(F.col("open").cast("double") / 2)).first()
        if not rows_left:
            break
        last = turn == HUB_TURNS or all_pairs / BANDS <= HUBS * rows_left
        side = lambda df, x: df.select("key", F.col("node").alias(x), F.col("n").alias("n" + x), F.col("c").alias("c" + x))
        if last:
            few = open_.where(F.col("members") <= CROWD)
            met = side(few, "a").join(side(few, "b"), "key")
        else:
            chosen = [F.min_by(F.struct("node", "n", "c"), F.xxhash64("node", F.lit(turn * HUBS + k))) for k in range(HUBS)]
            hubs = write_table(open_.groupBy("key").agg(F.array_distinct(F.array(*chosen)).alias("hubs"), F.count("*").alias("n")), "hubs")
            met = join_by_count(side(open_, "a"), hubs, ["key"]).select("*", F.explode("hubs").alias("hub")).select("key", "a", "na", "ca", F.col("hub.node").alias("b"), F.col("hub.n").alias("nb"), F.col("hub.c").alias("cb"))
        # sets whose sizes differ by more cannot be so similar
        pairs = met.where(f"ca <> cb and least(na, nb) >= {COPY_SIMILARITY} * greatest(na, nb) - 1e-6" + (" and a < b" if last else ""))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = write_table(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        near = _similar(pairs, sets)
        near = write_table(near.unionByName(_crowds(open_.where(F.col("members") > CROWD), sets)) if last else near, "links")
        # what is connected so far stands for the links that connect it
        stars = components(near.union(stars.select(F.col("component").alias("a"), F.col("node").alias("b"))))
        linked = stars.union(stars.select("component", "component")).distinct()
        tried = tried.union(pairs)
        if last:
            break
    held = write_table(signed.groupBy("node", "doc_id", "tk").agg(F.count("*").alias("n")), "documents")
    per_node = held.groupBy("node").agg(F.min(row).alias("least"), F.count("*").alias("n"))
    of = write_table(per_node.select("node", "n").join(named_groups(per_node.select("node", "least"), linked), "node"), "named-sets")
    return join_by_count(held.withColumnRenamed("n", "rows"), of, ["node"]).select("doc_id", "tk", "rows", "least")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns as they are: of each group of near copies one row stays, of the document with the smallest id.

    Near copies share ``COPY_SIMILARITY`` of their runs of ``COPY_WORDS`` words (Jaccard). Null and empty texts, and
    those without a word, are copies of one another. Rows with one id and different texts are different documents, in
    the order of the hash of their texts; those with a null id come last in a group. Of rows that repeat both id and
    text the one whose columns have the smallest hash stays.
    """
    token, number = F.xxhash64(F.col(text_col).cast("string")), F.col(id_col).cast("long")
    groups = write_table(similar_groups(id_text(docs, id_col, text_col).withColumn("tk", F.xxhash64("text"))), "near-copies")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("tk") == F.col("least.tk"))
    key = [F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")]
    same = number.eqNullSafe(F.col("__id")) & (token == F.col("__tk"))
    twice = write_table(groups.where(stays & (F.col("rows") > 1)).select(*key), "repeated-rows")
    out = docs.join(groups.where(~stays | (F.col("rows") > 1)).select(*key), same, "left_anti")
    if twice.isEmpty():
        return out
    row = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    one = docs.join(twice, same).select("__id", "__tk", row).groupBy("__id", "__tk").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    return out.unionByName(one.select("__row.*"))
