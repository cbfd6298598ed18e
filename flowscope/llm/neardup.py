"""Near-duplicate documents by one-permutation hashing with optimal densification.

A document's set is the distinct hashes of its word shingles (A-Z in lower case). One hash function deals the set into
``BINS`` bins and keeps the least value of each; an empty bin takes the value of the bin that its own sequence of
hashes meets first among the full ones. ``ROWS`` bins form a band; documents with an equal band share a bucket.

Documents with equal sets are one node from the start, however many they are. In a bucket, edges go from one centre to
the other members only (a star), so their number follows the members', not its square; a node that meets many centres in
its buckets asks the first ``CENTRES`` of them, so a large group has no more edges a node than a small one. Each edge is
confirmed on the full sets, and confirmed edges join components. Further passes, ``PASSES`` in all, do the same in finer buckets of
three bands at a time (others in each pass, with other centres) for what is still in several components.

Two similar nodes can both be unlike every centre they met, so the passes alone would lose links. The rest is exact:
nodes that buckets with several components tie together form a family; a family's sets meet in one task, where shared
shingles are counted through posting lists for every node outside the family's largest component. That tests all pairs of
different components, in shared buckets or not; the task returns a spanning forest of the links it finds, never pairs.
Small families are packed into tasks by bytes, and each of their sets travels once. A family that is too large for a task is
dealt into blocks of bounded size, those of a large component apart from the others; two blocks that share a bucket
meet in a task of their own unless both are of one component. So no candidate is left untested, and no bucket, star,
family or component has a limit. At a similarity of 0.8 two documents miss each other in all 32 bands with a
probability below 1e-7.

Defined results: null, blank and empty texts have no set, are linked with nothing and form a component of their own;
a text with fewer words than a shingle has one shingle of all its words; rows that repeat an id are all kept if it is
the component's smallest; a row without id is kept if its component has no id at all, whose component id is null;
other columns are ignored, and kept as they are by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowscope.llm import tokens
from flowscope.llm.common import unused
from flowscope.operators.skew import BROADCAST_ROWS, attach, salted_join
from flowscope.session import materialized

BINS, ROWS = 128, 4
PASSES = 3
#: Centres that a node is compared with in a pass.
CENTRES = 4
SLICE_BYTES = 1_000_000
#: Mean size of the sets that meet in a task at the end, or of each of its two blocks, in bytes and in sets.
BLOCK_BYTES, BLOCK_SETS = 4_000_000, 2_000


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and where each text's begin."""
    words = tokens.words(texts, lower=True)
    at, hashes = words.windows(size)
    owner = words.texts()[at]
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = tokens.ranged(words.hashes, words.first[short], counts[short], tokens.WORD_BASE)
        owner, hashes = np.concatenate((owner, short)), np.concatenate((hashes, whole))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def donors() -> np.ndarray:
    """For each bin the order in which it asks other bins for a value: the same for all documents."""
    bins, tries = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(16 * BINS, dtype=np.uint64), indexing="ij")
    return (tokens.mixed(bins * np.uint64(1_000_003) + tries + np.uint64(1)) % np.uint64(BINS)).astype(np.int64)


def signatures(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Densified bins of every set; sets must not be empty."""
    n = len(begins) - 1
    owner = np.repeat(np.arange(n), np.diff(begins))
    place = owner * BINS + (hashes >> np.uint64(57)).astype(np.int64)  # 2**7 bins
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]  # sets are sorted: the first of a bin is its least
    out, full = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    out[place[first]], full[place[first]] = hashes[first], True
    order = donors()
    empty = np.flatnonzero(~full)
    for k in range(order.shape[1]):
        if not len(empty):
            break
        donor = empty // BINS * BINS + order[empty % BINS, k]
        found = full[donor]
        out[empty[found]] = out[donor[found]]
        empty = empty[~found]
    for at in empty.tolist():  # an order that misses every full bin: the next full one
        row = at // BINS * BINS
        out[at] = out[row + (np.flatnonzero(np.roll(full[row : row + BINS], -(at % BINS)))[0] + at) % BINS]
    return out.reshape(n, BINS)


def names(hashes: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """128 bits for each set; sets must not be empty."""
    counts = np.diff(begins).astype(np.uint64)
    one = np.add.reduceat(tokens.mixed(hashes), begins[:-1])
    two = np.add.reduceat(tokens.mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), begins[:-1])
    return [x.tobytes() for x in np.stack((tokens.mixed(one + counts), tokens.mixed(two)), 1)]


def sketched(size: int):
    """(id, text, text_hash) to (id, text_hash, n_shingles, node, bands): node is 128 bits of hash of the set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.sliced(whole, 1, SLICE_BYTES):
                hashes, begins = shingle_sets(batch.column(1), size)
                counts = np.diff(begins)
                some = np.flatnonzero(counts)
                nodes: list[bytes | None] = [None] * len(counts)
                bands: list[np.ndarray | None] = [None] * len(counts)
                if len(some):
                    edges = np.append(begins[some], len(hashes))
                    bins = signatures(hashes, edges)
                    starts = np.arange(0, BINS, ROWS) + np.arange(len(some))[:, None] * BINS
                    keys = tokens.ranged(bins.ravel(), starts.ravel(), ROWS, tokens.WORD_BASE).reshape(len(some), -1)
                    keys = tokens.mixed(keys + np.arange(BINS // ROWS, dtype=np.uint64)).astype(np.int64)
                    for i, name, key in zip(some.tolist(), names(hashes, edges), keys, strict=True):
                        nodes[i], bands[i] = name, key
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["id", "text_hash", "n_shingles", "node", "bands"],
                )

    return sketch


def set_rows(size: int):
    """(node, text, number) to (number, hashes), for the texts that have the node's set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.sliced(whole, 1, SLICE_BYTES):
                hashes, begins = shingle_sets(batch.column(1), size)
                some = np.flatnonzero(np.diff(begins))
                edges = np.append(begins[some], len(hashes))
                own = names(hashes, edges) if len(some) else []
                wanted, numbers = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                found = [
                    (numbers[i], hashes[a:b].tobytes())
                    for i, name, a, b in zip(some.tolist(), own, edges[:-1].tolist(), edges[1:].tolist(), strict=True)
                    if name == wanted[i]
                ]
                columns = [pa.array([n for n, _ in found], pa.int64()), pa.array([h for _, h in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["number", "hashes"])

    return rows


def similar(percent: int):
    """(a, b, hashes of a, hashes of b) to the pairs with 100 * intersection >= percent * union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                left, right = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                kept.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return confirm


def node_sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(number, hashes) of the wanted (number, node, id): the id is that of a row with the node's set."""
    owners = wanted.select("number", "node", F.col("id").alias("owner"))
    small = F.broadcast(owners) if owners.count() <= BROADCAST_ROWS else owners
    texts = rows.join(small, rows["id"].eqNullSafe(small["owner"])).select("node", "text", "number")
    found = texts.mapInArrow(tokens.releasing(set_rows(size)), "number bigint, hashes binary")
    return materialized(found.dropDuplicates(["number"]), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of numbers (a, b) whose sets are similar enough."""
    left = sets.select(F.col("number").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("number").alias("b"), F.col("hashes").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    return materialized(both.mapInArrow(similar(percent), "a bigint, b bigint"), "links")


def rooted(parents: DataFrame) -> DataFrame:
    """(node, to) with each node's last ancestor, of (node, to) with its parent: a root is its own. Pointers move to their
    pointers' pointers, so long paths take logarithmically many rounds."""
    while True:
        beyond = parents.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        moved = materialized(parents.join(beyond, "to").select("node", F.col("beyond").alias("to"), (F.col("to") != F.col("beyond")).alias("moved")), "moved")
        parents = moved.select("node", "to")
        if moved.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, to): the least node that each node of the links reaches. Each node points to its least neighbour; the trees so made
    become one node each, and only the edges between them go on to the next round, where their nodes are at most half."""
    edges = materialized(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialized(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("to", F.col("node")), "labels")
    while not edges.isEmpty():
        parents = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to"))
        roots = rooted(materialized(parents, "parents"))
        of_a, of_b = (roots.select(F.col("node").alias(x), F.col("to").alias(f"of_{x}")) for x in ("a", "b"))
        moved = roots.select(F.col("node").alias("to"), F.col("to").alias("root"))
        labels = materialized(labels.join(moved, "to", "left").select("node", F.coalesce("root", "to").alias("to")), "labels")
        apart = edges.join(of_a, "a").join(of_b, "b").where("of_a <> of_b")
        edges = materialized(apart.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct(), "edges")
    return labels


def bucketed(nodes: DataFrame, turn: int) -> DataFrame:
    """(key, number, comp) of a pass: a bucket for each band, in later passes for each band with two others, which lie
    ``turn`` and twice ``turn`` bands on."""
    bands = BINS // ROWS
    rows = nodes.select("number", "comp", "bands", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("at"))
    parts = [F.get("bands", (F.col("at") + k * turn) % bands) for k in range(3 if turn else 1)]
    return rows.select(F.xxhash64(*parts).alias("key"), "number", "comp")


def starred(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of numbers (a, b): in each bucket with several components, one node and those of other components. A node asks
    at most ``CENTRES`` of its buckets' centres, the first in the order that made them centres."""
    order = F.xxhash64("number", F.lit(turn))
    stars = members.groupBy("key").agg(
        F.min_by("number", order).alias("centre"), F.min_by("comp", order).alias("of_centre"), F.min("comp").alias("least"), F.max("comp").alias("most")
    )
    met = members.join(stars.where("least < most").select("key", "centre", "of_centre"), "key").where("comp <> of_centre")
    first = Window.partitionBy("number").orderBy(F.xxhash64("centre", F.lit(turn)), "centre")
    asked = met.select("number", "centre").distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= CENTRES)
    return asked.select(F.least("number", "centre").alias("a"), F.greatest("number", "centre").alias("b")).distinct()


def tied(active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, number) of the buckets that hold several components, and (number, family) of the nodes in them: a family
    is what such buckets tie together."""
    members = bucketed(active, 0)
    split = members.groupBy("key").agg(F.min("number").alias("head"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    members = materialized(members.join(split.where("least < most").select("key", "head"), "key"), "members")
    ties = members.where("number <> head").select(F.col("head").alias("a"), F.col("number").alias("b")).distinct()
    return members.select("key", "number"), components(ties).select(F.col("node").alias("number"), F.col("to").alias("family"))


def blocked(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(task, side, number) of the (number, comp, family, n) of families that one task can't hold. Blocks of a component that
    fills one are pure; two blocks meet in a task if they share a bucket, unless both are pure of one component."""
    fills = (F.col("sets") > BLOCK_SETS) | (8 * F.col("hashes") > BLOCK_BYTES)
    sums = [F.count("*").alias("sets"), F.sum("n").alias("hashes")]
    pure = rows.groupBy("family", "comp").agg(*sums).where(fills).select("family", "comp", F.col("comp").alias("pure"))
    dealt = rows.join(pure, ["family", "comp"], "left")
    parts = dealt.groupBy("family", "pure").agg(*sums)
    parts = parts.select(F.col("family").alias("of"), F.col("pure").alias("of_pure"), (1 + F.greatest(F.floor(8 * F.col("hashes") / BLOCK_BYTES), F.floor(F.col("sets") / BLOCK_SETS))).alias("parts"))
    dealt = dealt.join(parts, (F.col("family") == F.col("of")) & F.col("pure").eqNullSafe(F.col("of_pure")))
    block = F.xxhash64("family", "pure", F.pmod(F.xxhash64("number"), "parts"))
    dealt = materialized(dealt.select("number", "pure", block.alias("block")), "blocks")
    places = members.join(dealt, "number").select("key", "block", "pure").distinct()
    x, y = places.select("key", F.col("block").alias("x"), F.col("pure").alias("of_x")), places.select("key", F.col("block").alias("y"), F.col("pure").alias("of_y"))
    meet = (F.col("x") <= F.col("y")) & F.coalesce(F.col("of_x") != F.col("of_y"), F.lit(True))
    tasks = x.join(y, "key").where(meet).select("x", "y").distinct()
    sides = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("block"))))
    sides = sides.otherwise(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("block")) for i, c in enumerate("xy")]))
    tasks = tasks.select(F.xxhash64("x", "y").alias("task"), F.explode(sides).alias("of")).select("task", "of.side", "of.block")
    return tasks.join(dealt.select("block", "number"), "block").select("task", "side", "number")


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def forest(comps: list[int], sides: np.ndarray, hashes: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between components by all similar pairs of nodes of different components, or of the two sides if there are two: no
    more than a spanning forest."""
    parent = {c: c for c in comps}

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    links, sizes = [], np.array([len(x) for x in hashes])
    two = sides.min() != sides.max()
    if two:
        asking, asked = np.flatnonzero(sides == 0), sides == 1
    else:
        names, counts = np.unique(comps, return_counts=True)
        asking, asked = np.flatnonzero(np.array(comps) != names[counts.argmax()]), np.ones(len(comps), bool)
    # posting lists of the asked sets
    flat, owner = np.concatenate(hashes), np.repeat(np.arange(len(hashes)), sizes)
    shingle, place = np.unique(flat, return_inverse=True)
    of_asked = asked[owner]
    posted = owner[of_asked][np.argsort(place[of_asked], kind="stable")]
    counts = np.bincount(place[of_asked], minlength=len(shingle))
    begins, ends = np.cumsum(counts) - counts, np.cumsum(sizes)
    for i in asking.tolist():
        own = place[ends[i] - sizes[i] : ends[i]]
        both = np.bincount(posted[spread(begins[own], counts[own])], minlength=len(hashes))
        for j in np.flatnonzero((100 * both >= percent * (sizes[i] + sizes - both)) & asked).tolist():
            a, b = find(comps[i]), find(comps[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((comps[i], comps[j]))
    return links


def meeting(percent: int):
    """(task, side, family, comp, hashes) of a task to the links (a, b) between components, family by family."""

    def meet(rows: pa.Table) -> pa.Table:
        families = rows["family"].to_numpy()
        order = np.argsort(families, kind="stable")
        cuts = np.flatnonzero(np.diff(families[order])) + 1
        comps, sides = rows["comp"].to_pylist(), rows["side"].to_numpy()
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["hashes"]]
        links = []
        for part in np.split(order, cuts):
            links += forest([comps[i] for i in part], sides[part], [hashes[i] for i in part], percent)
        tokens.release()
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return meet


def rest(active: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) between the components of each family, by comparing all sets of different ones; None if no bucket holds
    several components."""
    members, families = tied(active)
    rows = materialized(active.select("number", "comp", F.col("n_shingles").alias("n")).join(families, "number"), "families")
    sums = [F.count("*").alias("sets"), F.sum("n").alias("hashes")]
    fits = (F.col("sets") <= BLOCK_SETS) & (8 * F.col("hashes") <= BLOCK_BYTES)
    sizes = materialized(rows.groupBy("family").agg(*sums).withColumn("fits", fits), "sizes")
    total = sizes.where("fits").agg(F.sum("sets").alias("sets"), F.sum("hashes").alias("hashes")).first()
    if rows.isEmpty():
        return None
    tasks = 1 + max(8 * (total.hashes or 0) // BLOCK_BYTES, (total.sets or 0) // BLOCK_SETS)
    rows = rows.join(sizes.select("family", "fits"), "family")
    packed = rows.where("fits").select(F.pmod(F.xxhash64("family"), F.lit(tasks)).alias("task"), F.lit(0).alias("side"), "number")
    if not sizes.where("not fits").isEmpty():
        packed = packed.union(blocked(rows.where("not fits").select("number", "comp", "family", "n"), members))
    met = packed.join(rows.select("number", "family", "comp"), "number").join(sets, "number")
    found = met.select("task", "side", "family", "comp", "hashes").groupBy("task").applyInArrow(meeting(percent), "a bigint, b bigint")
    return materialized(found, "rest")


def joined(active: DataFrame, links: DataFrame) -> DataFrame:
    """``active`` with the components that the links (a, b) between components join."""
    moved = components(links).select(F.col("node").alias("comp"), "to")
    names_ = [c for c in active.columns if c != "comp"]
    return materialized(attach(active, moved, ["comp"], ["number"]).select(*names_, F.coalesce("to", "comp").alias("comp")), "active")


def between(active: DataFrame, links: DataFrame) -> DataFrame:
    """The links (a, b) between nodes as links between their components."""
    of_a, of_b = (active.select(F.col("number").alias(x), F.col("comp").alias(f"of_{x}")) for x in ("a", "b"))
    return links.join(of_a, "a").join(of_b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))


def linked(docs: DataFrame, size: int = 4, percent: int = 80, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(id, text_hash, n_shingles, component_id, kept) of every document."""
    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    kind = rows.schema["id"].dataType.simpleString()
    sketch = f"id {kind}, text_hash bigint, n_shingles bigint, node binary, bands array<bigint>"
    sketches = materialized(rows.mapInArrow(tokens.releasing(sketched(size)), sketch), "sketches")
    full = sketches.where("node is not null")
    nodes = full.groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"))
    nodes = materialized(nodes.withColumn("number", F.monotonically_increasing_id()), "nodes")
    # the first pass goes over all nodes, the later ones over those that share a bucket with another
    every = nodes.withColumn("comp", F.col("number"))
    pairs = materialized(starred(bucketed(every, 0), 0), "pairs")
    met = pairs.select(F.col("a").alias("number")).union(pairs.select("b")).distinct()
    active = materialized(every.join(met, "number", "left_semi"), "active")
    sets = node_sets(rows, active, size)
    tested = pairs
    for turn in range(PASSES):
        if turn:
            pairs = materialized(starred(bucketed(active, turn), turn).join(tested, ["a", "b"], "left_anti"), "pairs")
            tested = tested.union(pairs)
        links = confirmed(pairs, sets, percent)
        if not links.isEmpty():
            active = joined(active, between(active, links))
    links = rest(active, sets, percent)
    if links is not None and not links.isEmpty():
        active = joined(active, links)

    smallest = active.groupBy("comp").agg(F.min("id").alias("smallest"))
    grouped = attach(active.select("number", "comp"), smallest, ["comp"], ["number"]).select("number", "smallest")
    parts = nodes.select("node", "number", "id").join(grouped, "number", "left").select("node", F.coalesce("smallest", "id").alias("least"))
    parts = materialized(parts, "parts")
    narrow = sketches.select("id", "text_hash", "n_shingles", "node")
    out = salted_join(narrow, parts, ["node"], ["id"], "left", hot_source=full.select("node"))
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least"))
    kept = F.coalesce(F.col("id") == component, component.isNull())
    return out.select("id", "text_hash", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One document of each component, all columns: the one with the smallest id. Of rows that repeat its id within
    the component, and of the rows of a component without ids, one stays for each text."""
    found = materialized(linked(docs, size, percent, text, ident), "linked")
    empty = F.col("n_shingles") == 0
    gone = found.where(~F.col("kept")).select("id", "text_hash").distinct()
    again = found.where(F.col("kept") & ~empty).groupBy("id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("id", "text_hash")
    hash_, own = unused(docs, "_text_hash"), docs.columns
    rows = docs.withColumn(hash_, F.xxhash64(F.col(text)))

    def met(side: DataFrame, how: str) -> DataFrame:
        side = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
        return rows.join(side, rows[ident].eqNullSafe(side["id"]) & (rows[hash_] == side["text_hash"]), how)

    again = materialized(again, "again")
    rows = met(materialized(gone, "gone"), "left_anti")
    if again.isEmpty():
        return rows.select(own)
    return met(again, "left_anti").select(own).union(met(again, "left_semi").dropDuplicates([ident, hash_]).select(own))
