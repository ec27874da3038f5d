"""Near-duplicate join by chosen paths: Jaccard of word shingles.

Every text becomes the set of its shingles and a sketch of ``coordinates``
min-hashes, each a sampled token that similar sets share with their similarity as
probability. Texts with one set are one class. The sets are split recursively:
a node of the tree picks some coordinates by a hash of its path, each with
probability 1 / (similarity * coordinates), and every set in it follows them to
the child of the token that it has there. Sets of a small node, of a node that
keeps most of its parent's sets, and of one most of whose sets resemble one of them
(in both they resemble each other and would not part) are compared with each other. Trees are added until a pair at the threshold
is found with the chance ``target``: what a tree brings depends on the deepest level
that its nodes have reached (``found``), so ``runs`` trees are grown first and as
many more as that level asks for.

A node compares sketches in memory and passes on a spanning forest of the pairs
that may be similar, not the pairs. The sets of each connected group are then
compared exactly, in blocks of ``block`` sets, which finds each pair once,
also those that no tree has brought together. Output is one row per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailglass.llm import textbytes as tb
from mailglass.llm.components import components
from mailglass.llm.shared import bloom_filtered, materialize, text_of


@dataclass(frozen=True)
class Settings:
    """``target``: recall of a pair whose similarity is ``similarity``, sketch filter
    included. ``runs``: trees grown first. ``small``: sets that a node compares without
    splitting further."""

    similarity: float = 0.8
    words: int = 5
    coordinates: int = 64
    runs: int = 12
    depth: int = 5
    small: int = 64
    target: float = 0.999
    block: int = 1024
    groups: int = 64
    seed: int = 17


def recall(s: Settings, similarity: float, levels: int) -> float:
    """Chance that a pair meets in at least one tree in which its node is ``levels`` deep."""
    miss, chosen = 0.0, 1 / (s.similarity * s.coordinates)
    for _ in range(levels):
        miss = (1 - chosen * similarity * (1 - miss)) ** s.coordinates
    return 1 - miss**s.runs


def _agreements(s: Settings) -> list[float]:
    """Chance that the sketches of a pair at the threshold agree in 0, 1, 2... coordinates."""
    return [comb(s.coordinates, k) * s.similarity**k * (1 - s.similarity) ** (s.coordinates - k) for k in range(s.coordinates + 1)]


def least_agreement(s: Settings) -> int:
    """Equal coordinates that the sketch filter asks for: half of what ``target`` leaves may be lost to it."""
    lost = 0.0
    for k, chance in enumerate(_agreements(s)):
        lost += chance
        if lost > (1 - s.target) / 2:
            return k
    return s.coordinates


def found(s: Settings, levels: int, runs: int) -> float:
    """Chance that a pair at the threshold passes the sketch filter and meets in one of ``runs`` trees
    in which its nodes are ``levels`` deep. All trees see one sketch, so this is a mean over what it may be."""
    chosen, total = 1 / (s.similarity * s.coordinates), 0.0
    for k, chance in enumerate(_agreements(s)):
        miss = 0.0
        for _ in range(levels):
            miss = (1 - chosen * (1 - miss)) ** k
        total += chance * (1 - miss**runs) * (k >= least_agreement(s))
    return total


def runs_for(s: Settings, levels: int) -> int:
    """Fewest trees that bring ``target`` where nodes are ``levels`` deep."""
    if not 0 < s.target < 1:
        raise ValueError(f"target {s.target} is not between 0 and 1")
    runs = 1
    while found(s, levels, runs) < s.target:
        runs += 1
    return runs


def shingles(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct shingle hashes row after row, how many each row has).

    A text of fewer words than a shingle has one shingle of all its words; one
    without words has none.
    """
    for first, data, bounds in tb.pieces(column):
        starts, ends = tb.runs(data, bounds)
        counts = tb.row_counts(starts, bounds)
        h = tb.hash_runs(data, starts, ends)
        grams, each = tb.ngrams(h, counts, words)
        for n in range(1, words):  # short texts
            short = counts == n
            if short.any():
                own, _ = tb.ngrams(h[np.repeat(short, counts)], counts[short], n)
                at = (np.cumsum(each) - each)[short]
                grams = np.insert(grams, at, own)
                each = each + short
        row = np.repeat(np.arange(len(each)), each)
        order = np.lexsort((grams, row))
        grams, row = grams[order], row[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        grams = grams[new]
        yield first, grams, np.bincount(row[new], minlength=len(each))


def _factors(s: Settings) -> np.ndarray:
    return np.random.default_rng(s.seed).integers(1, 1 << 63, s.coordinates, np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(documents: DataFrame, s: Settings, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, set key, sketch) of every row and its columns ``keep``; nulls for a text without words or a row without id."""
    factors = _factors(s)
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(c) for c in range(batch.num_columns - 1)]
            for first, grams, counts in shingles(batch.column(batch.num_columns - 1), s.words):
                full = np.flatnonzero(counts)
                bare = np.flatnonzero(counts == 0)
                if len(bare):
                    at = pa.array(first + bare)
                    yield pa.RecordBatch.from_arrays([*(c.take(at) for c in own), pa.nulls(len(bare), pa.binary()), pa.nulls(len(bare), pa.binary())], names=["doc_id", *keep, "key", "sketch"])
                if not len(full):
                    continue
                starts = (np.cumsum(counts) - counts)[full]
                sketch = np.empty((len(full), s.coordinates), np.uint32)
                for i, factor in enumerate(factors):
                    sketch[:, i] = np.minimum.reduceat(grams * factor, starts) >> np.uint64(32)
                at = pa.array(first + full)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(at) for c in own), _rows_of_bytes(_keys(grams, counts)[full]), _rows_of_bytes(sketch)], names=["doc_id", *keep, "key", "sketch"])

    text = F.when(F.col("doc_id").isNotNull(), text_of(documents)).otherwise("")
    kinds = dict(documents.dtypes)
    shape = ", ".join(["doc_id long", *(f"`{c}` {kinds[c]}" for c in keep), "key binary", "sketch binary"])
    return documents.select(F.col("doc_id").cast("long"), *keep, text.alias("text")).mapInArrow(run, shape)


def _keys(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set's key: its size and two sums of its mixed hashes. Rows without shingles have zeros."""
    out, full = np.zeros((len(counts), 3), np.uint64), counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        for k in (0, 1):
            out[full, k] = np.add.reduceat(tb.mix(grams ^ np.uint64(k + 1)), starts)
    out[:, 2] = counts
    return out


def _rows_of_bytes(a: np.ndarray) -> pa.Array:
    size = a.shape[1] * a.itemsize
    bounds = np.arange(len(a) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(a))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    data, _ = tb.text_bytes(column)
    return np.frombuffer(np.ascontiguousarray(data), np.uint32).reshape(-1, width)


def split(nodes: DataFrame, s: Settings, root: range | None = None) -> DataFrame:
    """Children of each (path, rep, sketch, size); of rows (rep, sketch) in the trees ``root``. (path, rep, sketch, size of the parent)."""
    bar = np.uint64(int(2**32 / (s.similarity * s.coordinates)))
    places = np.arange(s.coordinates, dtype=np.uint64)

    def children(path: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pick = (tb.mix(path[:, None] ^ (places * np.uint64(0x9E3779B97F4A7C15))[None, :]) >> np.uint64(32)) < bar
        row, at = np.nonzero(pick)
        child = tb.mix(tb.mix(path[row] + places[at] * np.uint64(0xA24BAED4963EE407)) ^ sketch[row, at].astype(np.uint64))
        return row, child

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                sketch = _matrix(batch.column("sketch"), s.coordinates)
                paths = [np.full(len(sketch), r + 1, np.uint64) for r in root] if root else [batch.column("path").to_numpy().view(np.uint64)]
                for path in paths:
                    row, child = children(path, sketch)
                    take = pa.array(row)
                    size = pa.array(np.full(len(row), -1)) if root else batch.column("size").take(take)
                    names, columns = ["path", "rep", "parent"], [pa.array(child.view(np.int64)), batch.column("rep").take(take), size]
                    if not root:
                        names, columns = [*names, "sketch"], [*columns, batch.column("sketch").take(take)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return nodes.mapInArrow(run, "path long, rep long, parent long" + ("" if root else ", sketch binary"))


def _with_sizes(nodes: DataFrame) -> DataFrame:
    sizes = nodes.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
    return nodes.join(sizes, "path")


def leaves(classes: DataFrame, s: Settings) -> DataFrame:
    """(path, rep, sketch, size) of all nodes whose sets are to be compared, of as many trees as ``target`` needs."""
    out, grown, needed, deepest = None, 0, s.runs, 1
    while grown < needed:
        own, level = _trees(classes, range(grown, needed), s)
        out = own if out is None else out.unionByName(own)
        deepest = max(deepest, level)
        grown, needed = needed, runs_for(s, deepest)
    return out


def _trees(classes: DataFrame, runs: range, s: Settings) -> tuple[DataFrame, int]:
    """The nodes to be compared of the trees ``runs``, and the deepest level reached."""
    nodes = materialize(_with_sizes(split(classes.select("rep", "sketch"), s, runs)))
    nodes = nodes.join(classes.select("rep", "sketch"), "rep")
    out = None
    for level in range(1, s.depth + 1):
        nodes = materialize(nodes.select("path", "rep", "sketch", "parent", "size"))
        alike = (F.col("parent") > 0) & (F.col("size") * 2 > F.col("parent"))
        ended = (F.col("size") <= s.small) | alike if level < s.depth else F.lit(True)
        own = nodes.filter(ended).select("path", "rep", "sketch", "size")
        out = own if out is None else out.unionByName(own)
        if level == s.depth:
            break
        wide = nodes.filter(~ended).select("path", "rep", "sketch", "size")
        if wide.isEmpty():
            break
        alike = _alike(wide, s)
        out = out.unionByName(wide.join(alike, "path", "left_semi"))
        # written, as both the sizes and the nodes are read from it
        nodes = _with_sizes(materialize(split(wide.join(alike, "path", "left_anti"), s)))
    return out, level


def _alike(nodes: DataFrame, s: Settings) -> DataFrame:
    """(path) of the nodes of which more than half of the sets resemble one of three: those with the
    smallest and largest rep and the smallest hash of it.

    Splitting such a node deals nearly all of its sets to every child.
    """
    own = F.struct("rep", "sketch")
    some = nodes.groupBy("path").agg(*(column["sketch"].alias(f"at{k}") for k, column in enumerate(
        (F.min(own), F.max(own), F.min(F.struct(F.xxhash64("rep", F.lit(s.seed)), "sketch"))))))
    need, near = least_agreement(s), [f"near{k}" for k in range(3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = _matrix(batch.column("sketch"), s.coordinates)
            equal = [(sketch == _matrix(batch.column(f"at{k}"), s.coordinates)).sum(1) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size"), *(pa.array(e >= need) for e in equal)], names=["path", "size", *near])

    judged = nodes.join(some, "path").select("path", "size", "sketch", "at0", "at1", "at2").mapInArrow(run, "path long, size long, " + ", ".join(f"{n} boolean" for n in near))
    most = judged.groupBy("path").agg(F.greatest(*(F.count_if(n) for n in near)).alias("most"), F.first("size").alias("size"))
    return materialize(most.filter("most * 2 > size").select("path"))


def _blocks(frame: DataFrame, key: str, size: str, s: Settings) -> DataFrame:
    """Deals a key's rows to blocks of about ``block`` rows and each pair of blocks to one place.

    Adds i, j (the blocks compared) and mine (the row's own). A key of up to ``block`` rows stays whole.
    """
    n = F.ceil(F.col(size) / s.block).cast("int")
    frame = frame.withColumn("_n", n).withColumn("mine", F.pmod(F.xxhash64("rep", F.lit(s.seed)), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    frame = frame.withColumn("_other", other)
    return frame.withColumn("i", F.least("mine", "_other")).withColumn("j", F.greatest("mine", "_other")).drop("_n", "_other")


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole stretches of equal keys from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        last = np.logical_and.reduce([c == c[-1] for c in columns])
        begin = batch.num_rows - (int(np.argmin(last[::-1])) if not last.all() else batch.num_rows)
        same = held and all(held[-1].column(k)[-1].as_py() == c[0] for k, c in zip(keys, columns))
        if begin == 0 and same:
            held.append(batch)
            continue
        if same or held:
            held.append(batch.slice(0, begin))
            yield pa.Table.from_batches(held)
        elif begin:
            yield pa.Table.from_batches([batch.slice(0, begin)])
        held = [batch.slice(begin)]
    if held:
        yield pa.Table.from_batches(held)


def _stretches(table: pa.Table, keys: list[str]) -> np.ndarray:
    columns = [table.column(k).to_numpy() for k in keys]
    new = np.ones(table.num_rows, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(np.flatnonzero(new), table.num_rows)


def forest(near: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Smallest index that each of n places reaches by the given pairs."""
    root = np.arange(n)
    pairs = [np.stack(p) for p in near]
    pairs = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int64)
    while True:
        low = np.minimum(root[pairs[0]], root[pairs[1]])
        now = root.copy()
        np.minimum.at(now, root[pairs[0]], low)
        np.minimum.at(now, root[pairs[1]], low)
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _similar_sketches(sketch: np.ndarray, left: np.ndarray, right: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places left x right whose sketches agree enough, a stretch of rows at a time."""
    need = least_agreement(s)
    for a in range(0, len(left), 64):
        rows = left[a : a + 64]
        if len(right) <= 64:
            equal = (sketch[rows][:, None, :] == sketch[right][None, :, :]).sum(2)
        else:
            equal = np.zeros((len(rows), len(right)), np.int32)
            for c in range(s.coordinates):
                equal += sketch[rows, c][:, None] == sketch[right, c][None, :]
        x, y = np.nonzero(equal >= need)
        keep = rows[x] != right[y]
        yield rows[x[keep]], right[y[keep]]


def candidates(ends: DataFrame, s: Settings) -> DataFrame:
    """(a, b): a spanning forest, per node, of the pairs with near sketches. a > b."""
    keys = ["path", "i", "j"]
    dealt = _blocks(ends, "path", "size", s).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, keys):
            cut = _stretches(table, keys)
            rep, mine, i, j = (table.column(c).to_numpy() for c in ("rep", "mine", "i", "j"))
            sketch = _matrix(table.column("sketch"), s.coordinates)
            out = []
            for a, z in zip(cut, cut[1:]):
                if z - a < 2:
                    continue
                own, side = rep[a:z], mine[a:z]
                order = np.argsort(own, kind="stable")
                own, side = own[order], side[order]
                left, right = np.flatnonzero(side == i[a]), np.flatnonzero(side == j[a])
                root = forest(_similar_sketches(sketch[a:z][order], left, right, s), z - a)
                linked = np.flatnonzero(root != np.arange(z - a))
                out.append(np.stack([own[linked], own[root[linked]]]))
            pairs = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return dealt.select("path", "i", "j", "mine", "rep", "sketch").mapInArrow(run, "a long, b long")


def common(grams: np.ndarray, counts: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left x right sets, by products of 0-1 matrices a slab of shingles at a time."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(grams, kind="stable")
    grams, row = grams[order], row[order]
    new = np.append(True, grams[1:] != grams[:-1]) if len(grams) else np.empty(0, bool)
    number = np.cumsum(new) - 1
    often = np.bincount(number)[number] > 1 if len(number) else np.empty(0, bool)
    row, number = row[often], number[often]
    number = np.unique(number, return_inverse=True)[1] if len(number) else number
    out = np.zeros((len(left), len(right)), np.float32)
    at_left, at_right = np.full(len(counts), -1), np.full(len(counts), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    columns, slab = (int(number[-1]) + 1 if len(number) else 0), 4096
    for c in range(0, columns, slab):
        a, z = np.searchsorted(number, [c, c + slab])
        sides = []
        for at, n in ((at_left, len(left)), (at_right, len(right))):
            m = np.zeros((n, min(slab, columns - c)), np.float32)
            own = at[row[a:z]]
            m[own[own >= 0], number[a:z][own >= 0] - c] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def exact_links(members: DataFrame, s: Settings) -> DataFrame:
    """(a, b, links): for each set a, how many texts of the compared block it links with, and the
    smallest set b that it reaches there.

    ``members`` has grp, size, rep, copies, key and text: the classes of each connected
    group. Rows whose text does not have the key (another text of the same doc_id) are
    left out, and repeated ones.
    """
    keys = ["grp", "i", "j"]
    dealt = _blocks(members, "grp", "size", s).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, keys):
            cut = _stretches(table, keys)
            rep, copies, mine, i, j = (table.column(c).to_numpy() for c in ("rep", "copies", "mine", "i", "j"))
            for a, z in zip(cut, cut[1:]):
                parts = list(shingles(table.column("text").slice(a, z - a), s.words))
                grams, counts = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
                keys_of = _matrix(table.column("key").slice(a, z - a), 6).view(np.uint64)
                true = np.flatnonzero((_keys(grams, counts) == keys_of).all(1))
                true = true[np.unique(rep[a:z][true], return_index=True)[1]]
                if len(true) < 2:
                    continue
                if len(true) < z - a:
                    chosen = np.zeros(z - a, bool)
                    chosen[true] = True
                    grams, counts = grams[np.repeat(chosen, counts)], counts[chosen]
                    true = np.flatnonzero(chosen)
                else:
                    true = np.arange(z - a)
                n, at = len(true), a + true
                own, times, side = rep[at], copies[at], mine[at]
                left, right = np.flatnonzero(side == i[a]), np.flatnonzero(side == j[a])
                both = common(grams, counts, left, right)
                union = counts[left][:, None] + counts[right][None, :] - both
                near = both >= s.similarity * union - 1e-9 * union
                near &= left[:, None] != right[None, :]
                links = np.zeros(n, np.int64)
                links[left] += near @ times[right]
                if i[a] != j[a]:
                    links[right] += near.T @ times[left]
                x, y = np.nonzero(near)
                order = np.argsort(own, kind="stable")
                place = np.empty(n, np.int64)
                place[order] = np.arange(n)
                root = forest(iter([(place[left[x]], place[right[y]])]), n)
                root = own[order][root[place]]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(root), pa.array(links)], names=["a", "b", "links"])

    return dealt.select("grp", "i", "j", "mine", "rep", "copies", "key", "text").mapInArrow(run, "a long, b long, links long")


def near_duplicates(documents: DataFrame, s: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """doc_id, class_id, component_id, n_links, kept for every row of ``documents``, and its columns ``keep``.

    class_id is the smallest doc_id with the same set of shingles; n_links counts the
    other rows whose sets have a Jaccard similarity of at least ``similarity``, exact
    copies included; component_id is the smallest doc_id reachable by links; kept is
    doc_id = component_id. A text without words (null, empty, blank) links with
    nothing and is kept; a row without doc_id has nulls, no links, and is kept.
    Rows that repeat a doc_id are rows of their own;
    equal ones are kept or dropped together.
    """
    own = materialize(sketches(documents, s, keep))
    first = F.min(F.struct("doc_id", "sketch"))
    classes = materialize(own.filter("key is not null").groupBy("key").agg(first.alias("m"), F.count("*").alias("copies")).select(
        "key", F.xxhash64("key").alias("rep"), F.col("m.doc_id").alias("class_id"), "copies", F.col("m.sketch").alias("sketch")))
    groups = components(candidates(leaves(classes, s), s))
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    grouped = groups.join(sizes, "root").select(F.col("node").alias("rep"), F.col("root").alias("grp"), "size").join(classes.select("rep", "class_id", "copies", "key"), "rep")
    texts = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("class_id"), text_of(documents).alias("text"))
    with bloom_filtered(documents.sparkSession):  # texts of no group are left out before they are moved
        members = materialize(grouped).filter("size > 1").join(texts, "class_id")
        found = materialize(exact_links(members, s))
    linked = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    table = classes.select("key", "rep", "class_id", "copies").join(linked, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    table = materialize(table.select("key", "class_id", "root", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    smallest = table.groupBy("root").agg(F.min("class_id").alias("component_id"))
    table = table.join(smallest, "root").drop("root")
    joined = own.select("doc_id", *(keep or []), "key").join(table, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", *(keep or []), F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
