"""Exact Jaccard join of word n-gram sets: pigeonhole signatures find blocks, a prefix tree joins each block."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch, words
from tidegrid.llm.components import components

MEMBERS, TOKENS = 1024, 2_000_000  # of a block held by one task; larger groups are split, see near_components


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_sets(column: pa.ListArray, n: int) -> Iterator[np.ndarray]:
    """For each list of word hashes its sorted distinct n-grams; with fewer words the whole sequence is the only one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    grams = np.zeros(max(len(flat) - n + 1, 0), np.uint64)
    for k in range(n):
        grams = _mix(grams * np.uint64(0x9E3779B97F4A7C15) + flat[k : len(flat) - n + 1 + k]) if len(grams) else grams
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in flat[a:b]:
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
            yield h
        else:
            yield np.zeros(0, np.uint64)


class Signatures:
    """Values of which two sets with Jaccard similarity of at least ``num / den`` share one.

    Sizes fall into classes with upper ends u[0] < u[1] < ...; a set and a larger one that may link are in the same or
    in neighbouring classes. For class c the symmetric difference of a link is at most
    ``d = 2 u[c] (den - num) / (den + num)``, so of ``d + s`` ranges of the hash space at least ``s`` hold the same
    n-grams in both sets. A signature is the content of one range. Ranges without n-grams are left out, unless a set has
    ``s`` of them or more: a link may then rest on empty ranges alone. ``s`` is chosen so that this hardly happens.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den, self.ends = num, den, [1]

    def of(self, grams: np.ndarray) -> np.ndarray:
        size = len(grams)
        while self.ends[-1] < size or len(self.ends) < 2 or self.ends[-2] < size:
            self.ends.append(max(self.ends[-1] + 1, self.ends[-1] * self.den // self.num))
        c = int(np.searchsorted(self.ends, size))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(grams), dtype=np.uint64)])
        return np.concatenate([self._of_class(grams, sums, k) for k in (c, c + 1)]).view(np.int64)

    def _of_class(self, grams: np.ndarray, sums: np.ndarray, c: int) -> np.ndarray:
        d = 2 * self.ends[c] * (self.den - self.num) // (self.den + self.num)
        if d == 0:
            return np.zeros(0, np.uint64)  # only equal sets link
        spare = self._spare(c, d)
        parts = d + spare
        cuts = np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)
        cuts = np.concatenate([[0], np.searchsorted(grams, cuts), [len(grams)]])
        count = np.diff(cuts)
        tag = (np.uint64(c) << np.uint64(32)) + np.arange(parts, dtype=np.uint64)
        out = _mix((sums[cuts[1:]] - sums[cuts[:-1]]) ^ _mix(tag + np.uint64(1)))
        return out if (count == 0).sum() >= spare else out[count > 0]

    def _spare(self, c: int, d: int) -> int:
        """More than the empty ranges that the smallest sets of the class are likely to have."""
        parts = 2 + 1.1 * d
        empty = parts * math.exp(-self.ends[c] * self.num**2 / self.den**2 / parts)
        return 2 + math.ceil(1.1 * empty + 1.5 * math.sqrt(empty))


def trie_links(sets: list[np.ndarray], stored: np.ndarray, probing: np.ndarray, comp: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between probing and stored sets that connect components; ``comp`` has each set's component at the start.

    n-grams are put in one order for the block (most frequent first), so that the stored sets share long prefixes. They
    are walked as a prefix tree: the overlap of every probe with the path so far is kept per branching node and shared
    by all sets below it. A probe is dropped below a node when its overlap and the longest remainder can't reach what
    the shortest set there asks for; a subtree without probes is not entered. Pairs inside a component are not asked for.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams, inverse, freq = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(grams), np.int64)
    rank[np.argsort(-freq, kind="stable")] = np.arange(len(grams))
    shared = freq[inverse] > 1  # the others only count as length
    ranks, owner = rank[inverse][shared], owner[shared]
    by_rank = np.lexsort((owner, ranks))
    post, starts = owner[by_rank], np.searchsorted(ranks[by_rank], np.arange(int(ranks.max()) + 2 if len(ranks) else 1))
    by_owner = np.lexsort((ranks, owner))
    own, bounds = ranks[by_owner], np.searchsorted(owner[by_owner], np.arange(len(sets) + 1))
    paths = [own[bounds[i] : bounds[i + 1]] for i in range(len(sets))]
    order = sorted((i for i in range(len(sets)) if stored[i]), key=lambda i: paths[i].tolist())
    comp, links, found = comp.copy(), [], len(sets)
    lcp = [0] * (len(order) + 1)
    for k in range(1, len(order)):
        a, b = paths[order[k - 1]], paths[order[k]]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        lcp[k] = int(differ[0]) if len(differ) else m

    def walk(overlap: np.ndarray, path: np.ndarray, a: int, b: int) -> np.ndarray:
        """``overlap`` after the n-grams a..b of the path."""
        if b - a == 0:
            return overlap
        s, e = starts[path[a:b]], starts[path[a:b] + 1]
        hits = np.concatenate([post[x:y] for x, y in zip(s, e, strict=True)])
        return overlap + np.bincount(hits, minlength=found)

    stack: list[tuple[int, np.ndarray]] = [(0, np.zeros(found, np.int64))]
    k = 0
    while k < len(order):
        i = order[k]
        while stack[-1][0] > lcp[k]:
            stack.pop()
        depth, overlap = stack[-1]
        if (fork := lcp[k + 1] if k + 1 < len(order) else 0) > depth:
            overlap = walk(overlap, paths[i], depth, fork)
            depth = fork
            stack.append((depth, overlap))
            last = k + 1
            while last + 1 < len(order) and lcp[last + 1] >= depth:
                last += 1
            below = sizes[order[k : last + 1]]
            least = -((-num * (below.min() + sizes)) // (den + num))  # overlap that a link asks for
            alive = probing & (overlap + np.minimum(sizes - overlap, below.max() - depth) >= least)
            if not alive.any():
                k = last + 1
                stack.pop()
                if k < len(order):
                    lcp[k] = min(lcp[k], stack[-1][0])
                continue
        at = walk(overlap, paths[i], depth, len(paths[i]))
        linked = probing & (den * at >= num * (sizes + sizes[i] - at)) & (comp != comp[i])
        for j in np.flatnonzero(linked):
            if comp[j] != comp[i]:
                links.append((i, int(j)))
                comp[comp == comp[j]] = comp[i]
        k += 1
    return links


def _blocks(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, block): the links inside each block."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        rows = list({(r[2], r[3], r[4]): r for r in rows}.values())  # a set may arrive more than once
        cls = [r[2] for r in rows]
        label = {r[5]: i for i, r in enumerate(rows)}
        comp = np.array([label[r[5]] for r in rows])
        found = trie_links([r[6] for r in rows], np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), comp, num, den)
        return [(cls[a], cls[b]) for a, b in found]

    now, rows = None, []
    for batch in batches:
        out: list[tuple[int, int]] = []
        grams = batch.column("grams")
        at, flat = grams.offsets.to_numpy(), grams.values.to_numpy(zero_copy_only=False).view(np.uint64)
        cols = [batch.column(c).to_pylist() for c in ("hub", "block", "cls", "stored", "probing", "comp")]
        for i, row in enumerate(zip(*cols, strict=True)):
            if row[:2] != now:
                out += links(rows) if len(rows) > 1 else []
                now, rows = row[:2], []
            rows.append((*row, flat[at[i] : at[i + 1]].copy()))
        yield _edges(out)
    yield _edges(links(rows) if len(rows) > 1 else [])


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def near_components(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, members: int = MEMBERS, tokens: int = TOKENS, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text).

    Documents link when the Jaccard similarity of their word n-gram sets is at least ``num / den``; component_id is the
    smallest doc_id reachable. Texts without words link with nothing and are their own component. NULL ids are kept
    (component_id is then the smallest id of the component, NULL if it has none); rows with the same set are one class.

    1. Each distinct set becomes a class, so copies are never paired. Its signatures (see ``Signatures``) are grouped;
       the smallest class of a group is its hub, and all classes that share a signature with a hub form the hub's block.
       Every pair that can link is in some block.
    2. Each block is joined exactly by ``trie_links``. Blocks over ``members`` sets or ``tokens`` n-grams are split by
       hash, with the hub's set in every part. What links to the hub is in one component, whatever part it is in; only
       the others are then held against every other part, again in pieces of bounded size.
    3. Links are joined to components; only links that connect something are ever written.
    """
    rows = _rooted(docs, n, num, den, members, tokens, scratch or Scratch(docs.sparkSession, "ngram-join"))
    low = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("low"))
    return rows.join(low, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))


def without_near_copies(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, members: int = MEMBERS, tokens: int = TOKENS, scratch: Scratch | None = None
) -> DataFrame:
    """The rows of ``docs``, exactly one of each component of ``near_components``: the least by doc_id, hash of the text, row.

    Rows, not ids, are judged: of repeated rows one stays, and a text isn't dropped for another text with its id. Rows
    without a doc_id and texts without words all stay.
    """
    scratch = scratch or Scratch(docs.sparkSession, "ngram-join")
    rows = _rooted(docs, n, num, den, members, tokens, scratch).filter("root IS NOT NULL AND doc_id IS NOT NULL")
    key = F.struct("doc_id", "text_key")
    first = rows.groupBy("root").agg(F.min(key).alias("first"))
    marked = scratch.keep(rows.join(first, "root").select("doc_id", "text_key", (key == F.col("first")).alias("stays")), "marked")
    drop = marked.filter("NOT stays").select("doc_id", "text_key")
    repeated = marked.filter("stays").groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("text_key"))  # the caller's columns apart
    if repeated.isEmpty():
        return keyed.join(drop, ["doc_id", "text_key"], "left_anti").select("row.*")
    once = keyed.join(drop.unionByName(repeated), ["doc_id", "text_key"], "left_anti").select("row.*")
    again = keyed.join(repeated, ["doc_id", "text_key"], "left_semi")
    # JSON orders rows of any types, maps too
    again = again.groupBy("doc_id", "text_key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return once.unionByName(again)


def _rooted(docs: DataFrame, n: int, num: int, den: int, members: int, tokens: int, scratch: Scratch) -> DataFrame:
    """(doc_id, text_key, n_shingles, root) per row: the hash of its text and the name of its component (NULL without words)."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), _second_key(F.col("text")).alias("text_key2"), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))

    ids = ["doc_id", "text_key", "text_key2"]

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures(num, den)
        for batch in batches:
            size, cls, sigs = [], [], []
            for grams in shingle_sets(batch.column("words"), n):
                size.append(len(grams))
                cls.append(_class(grams) if len(grams) else None)
                sigs.append(signatures.of(grams) if len(grams) else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sigs, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), lists], [*ids, "n", "cls", "sigs"])

    kind = dict(docs.dtypes)["doc_id"]
    base = scratch.keep(hashed.mapInArrow(classes, f"doc_id {kind}, text_key long, text_key2 long, n long, cls long, sigs array<long>"), "sets")
    sig = base.select("cls", F.explode("sigs").alias("sig")).repartition("sig")  # moved once, for the aggregate and the join
    shared = sig.groupBy("sig").agg(F.min("cls").alias("hub"), F.max("cls").alias("top")).filter("hub < top").select("sig", "hub")
    groups = scratch.keep(sig.join(shared, "sig").select("hub", "cls").distinct(), "groups")
    thin = scratch.keep(base.select("doc_id", "text_key", "text_key2", "n", "cls"), "classes")
    scratch.drop(base)
    base = thin
    one = base.filter("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("text_key", "text_key2")).alias("text"), F.min("n").alias("n"))
    sized = groups.join(one, "cls")
    parts = sized.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("n") / tokens)).alias("parts"))
    sized = sized.join(parts.filter("parts > 1"), "hub", "left").fillna(1, ["parts"])  # only few groups have more than one
    placed = sized.withColumn("block", F.pmod(F.xxhash64("cls", F.lit(3)), "parts"))
    placed = scratch.keep(placed.select("hub", "cls", "text", "parts", "block"), "placed")
    # the hub's set goes to each part of its group
    hubs = placed.filter("hub = cls AND parts > 1").select("hub", "cls", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("block"))
    yes = F.lit(True)
    first = placed.select("hub", "block", "cls", "text", yes.alias("stored"), yes.alias("probing"), F.col("cls").alias("comp"))
    first = first.unionByName(hubs.select("hub", "block", "cls", "text", yes.alias("stored"), yes.alias("probing"), F.col("cls").alias("comp"))).distinct()
    edges = scratch.keep(_joined(docs, first, n, num, den), "links")
    roots = components(edges, scratch)
    split = placed.filter("parts > 1")
    if not split.isEmpty():
        roots = scratch.keep(roots, "roots")
        known = split.join(roots, F.col("cls") == F.col("node"), "left").select(*split.columns, F.coalesce("root", "cls").alias("comp"))
        top = known.filter("hub = cls").select("hub", F.col("comp").alias("top"))
        known = scratch.keep(known.join(top, "hub"), "known")
        # the sets not joined to the hub so far, in pieces, against each part of their group
        open_ = known.filter("comp != top")
        meet = open_.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).filter("part != block")
        probes = meet.select("hub", F.xxhash64("part", "block").alias("cell"), "part", "cls", "text", "comp")
        cells = probes.select("hub", F.col("part").alias("block"), "cell").distinct()
        targets = known.join(cells, ["hub", "block"]).select("hub", "cell", "cls", "text", "comp")
        no = F.lit(False)
        more = probes.select("hub", F.col("cell").alias("block"), "cls", "text", no.alias("stored"), yes.alias("probing"), "comp")
        more = more.unionByName(targets.select("hub", F.col("cell").alias("block"), "cls", "text", yes.alias("stored"), no.alias("probing"), "comp"))
        edges = scratch.keep(edges.unionByName(_joined(docs, more, n, num, den)), "links")
        roots = components(edges, scratch)
    rows = base.join(roots, F.col("cls") == F.col("node"), "left")
    return rows.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("root", "cls").alias("root"))


def _second_key(text: Column) -> Column:
    return F.xxhash64(F.lit(7), text)


def _class(grams: np.ndarray) -> int:
    """A 64-bit name for a set's content."""
    mixed = _mix(grams + np.uint64(0x632BE59BD9B4E019))
    total = np.array([mixed.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed), len(grams)], np.uint64)
    out = np.zeros(1, np.uint64)
    for x in total:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + x)
    return int(out.view(np.int64)[0])


def _joined(docs: DataFrame, rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links inside the blocks of ``rows`` (hub, block, cls, text, stored, probing, comp).

    The n-grams of the few texts that are in a block are made anew: the sets of all documents would be twice as large as
    the input. Texts are told by 128 bits of hash, whatever their doc_id, and equal ones are one before they move.
    """
    place = F.struct("hub", "block", "stored", "probing", "comp")
    wanted = rows.groupBy("text.text_key", "text.text_key2", "cls").agg(F.collect_list(place).alias("places"))  # as many as a set has signatures
    texts = docs.select("text", F.xxhash64("text").alias("text_key"), _second_key(F.col("text")).alias("text_key2"))
    texts = texts.groupBy("text_key", "text_key2").agg(F.first("text").alias("text")).join(wanted, ["text_key", "text_key2"])
    hashed = texts.select("cls", "places", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("words"), n))
            same = [len(x) > 0 and _class(x) == c for x, c in zip(sets, batch.column("cls").to_pylist(), strict=True)]
            sets = [x for x, ok in zip(sets, same, strict=True) if ok]  # never a set of another class
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
            left = batch.filter(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays([left.column("cls"), left.column("places"), lists], ["cls", "places", "grams"])

    schema = "cls long, places array<struct<hub:long,block:long,stored:boolean,probing:boolean,comp:long>>, grams array<long>"
    spread = hashed.mapInArrow(grams_of, schema).select("cls", "grams", F.explode("places").alias("p")).select("p.*", "cls", "grams")
    sorted_rows = spread.repartition("hub", "block").sortWithinPartitions("hub", "block")
    return sorted_rows.mapInArrow(lambda batches: _blocks(batches, num, den), "a long, b long")
