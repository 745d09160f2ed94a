"""Exact n-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

Equal shingle sets are one set from the start. Sets meet where they share one of their rarest shingles: enough of them
that two linked sets must (prefix filter), rarest by counts of hashed shingles over the whole corpus, so a passage that
many documents share brings nobody together. Where sets meet, the bits in which two parity bitmaps differ bound their
overlap from above; what passes hangs together in clusters. Clusters are compared in tiles of one or two neighbouring
size bands: again by bitmaps, then by exact intersection of sorted arrays. Tiles return a spanning forest of their links,
never all pairs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolattice.llm.bytetext import BLANK, U, bound_batches, columns, flat, mix, shingle_hashes, slices, word_hashes
from aerolattice.llm.lookup import with_group
from aerolattice.operators import forest
from aerolattice.runtime import pinned, release, shuffle_width

#: Hash buckets in which shingles are counted over the corpus; the counts order shingles, so their size is fixed.
SKETCH_BITS = 20
SKETCH_CHUNKS = 16
#: Sets that meet at one shingle beyond which they are tied as they are and left to the tiles.
CROWDED = 4096
#: Sets in a block; a tile holds three blocks at most.
BLOCK = 512


def _sets(data: np.ndarray, places: np.ndarray, n: int) -> list[np.ndarray]:
    hashes, at = word_hashes(data, places, BLANK)
    shingles, at = shingle_hashes(hashes, at, n)
    return [np.unique(shingles[at[i] : at[i + 1]]) for i in range(len(places) - 1)]


class Rule:
    """Links where 100 * intersection >= percent * union, and the size bands that follow from it."""

    def __init__(self, percent: int):
        self.percent = percent
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
        self.edges = np.array(edges, np.int64)

    def band(self, size):
        return np.searchsorted(self.edges, size, "right") - 1

    def least_overlap(self, a, b):
        """The smallest intersection that links sets of these sizes."""
        return -(-(a + b) * self.percent // (100 + self.percent))


def _sketched(n: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            data, places = flat(batch.column(0))
            for _, _, part, at in slices(data, places):
                hashes, starts = word_hashes(part, at, BLANK)
                shingles, _ = shingle_hashes(hashes, starts, n)
                counts += np.bincount((shingles >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        parts = counts.reshape(SKETCH_CHUNKS, -1)
        blobs = [zlib.compress(x.astype("<i8").tobytes(), 1) for x in parts]
        yield pa.record_batch([pa.array(range(SKETCH_CHUNKS), pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "counts"])

    return count


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in table.column("counts").to_pylist())
    return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def sketch(texts: DataFrame, n: int) -> np.ndarray:
    """How often the shingles of each hash bucket occur in all texts, capped at 32 bits; 4 MB whatever the corpus."""
    partial = texts.mapInArrow(_sketched(n), "chunk int, counts binary")
    summed = partial.groupBy("chunk").applyInArrow(_add, "chunk int, counts binary").collect()
    found = [np.frombuffer(bytes(r[1]), "<i8") for r in sorted(summed, key=lambda r: r[0])]
    return np.minimum(np.concatenate([np.zeros(0, np.int64), *found]), (1 << 32) - 1).astype(np.uint32)


def _rarest(shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a sorted set in the order (count, hash): two sets that link share a shingle of their prefixes."""
    size = len(shingles)
    order = np.argsort(counts[(shingles >> U(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
    return shingles[order[: size - -(-size * percent // 100) + 1]]


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    """A shingle flips one bit, so two maps differ in no more bits than the sets have differences.

    A map folds to half its bits by xor of its halves.
    """
    out = np.zeros(bits // 64, np.uint64)
    place = mix(shingles + U(77)) & U(bits - 1)
    np.bitwise_xor.at(out, (place >> U(6)).astype(np.int64), U(1) << (place & U(63)))
    return out


def bits_for(size: int) -> int:
    """About as many bits as shingles: fewer would fill up before sets differ too much to link."""
    bits = 256
    while bits < size:
        bits *= 2
    return bits


SETS = "doc_id bigint, n_shingles bigint, digest binary, keys binary, bits binary"


def _set_maker(n: int, percent: int, counts: np.ndarray):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            data, places = flat(batch.column(1))
            sizes, digests, keys, maps = [], [], [], []
            named = batch.column(0).is_valid().to_pylist()
            for first, _, part, at in slices(data, places):
                for row, shingles in enumerate(_sets(part, at, n), first):
                    sizes.append(len(shingles))
                    digest = hashlib.sha256(shingles.tobytes()).digest()[:16] if len(shingles) else None
                    digests.append(digest)
                    new = digest is not None and named[row] and digest not in seen  # rows without id are dropped later
                    if new:
                        seen.add(digest)
                    keys.append(_rarest(shingles, counts, percent).tobytes() if new else None)  # once a task
                    maps.append(bitmap(shingles, bits_for(len(shingles))).tobytes() if new else None)
            out = [pa.array(sizes, pa.int64()), *[pa.array(x, pa.binary()) for x in (digests, keys, maps)]]
            yield pa.record_batch([batch.column(0), *out], names=["doc_id", "n_shingles", "digest", "keys", "bits"])

    return make


def _dealer(buckets: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys of many sets as one row per bucket of keys, so the shuffle moves arrays and not single keys."""
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            keys = np.frombuffer(b"".join(blobs), np.uint64)
            owner = np.repeat(batch.column(0).to_numpy(), [len(b) // 8 for b in blobs]).astype("<i8")
            bucket = ((mix(keys) >> U(32)) * U(buckets)) >> U(32)  # the rarest shingles may have small hashes
            order = np.argsort(bucket, kind="stable")
            keys, owner = keys[order], owner[order]
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            full = [i for i in range(buckets) if edge[i + 1] > edge[i]]
            yield pa.record_batch(
                [
                    pa.array(full, pa.int32()),
                    pa.array([keys[edge[i] : edge[i + 1]].tobytes() for i in full], pa.binary()),
                    pa.array([owner[edge[i] : edge[i + 1]].tobytes() for i in full], pa.binary()),
                ],
                names=["bucket", "keys", "sets"],
            )

    return deal


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of sets that share a key; a group found by many keys of the partition is told once."""
    keys, sets = [], []
    for batch in batches:
        keys += [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
        sets += [np.frombuffer(x, "<i8") for x in batch.column(2).to_pylist()]
    if not keys:
        return
    key, owner = np.concatenate(keys), np.concatenate(sets)
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    many = np.flatnonzero(np.diff(edge) > 1)
    groups: dict[bytes, np.ndarray] = {}
    for i in many.tolist():
        members = owner[edge[i] : edge[i + 1]]
        groups.setdefault(hashlib.sha256(members.tobytes()).digest()[:16], members)
    found = list(groups.items())
    for at in range(0, len(found), 2000):
        part = found[at : at + 2000]
        names = pa.array([g for g, _ in part], pa.binary())
        yield pa.record_batch([names, pa.array([m for _, m in part], pa.list_(pa.int64()))], names=["group", "members"])


def _overlap_bound(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
    """From above, by the bits in which maps of one length differ; `both` are the sizes of the two sets together."""
    return (both - np.bitwise_count(a ^ b).sum(1, dtype=np.int64)) // 2


def _folded(raw: bytes, bits: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint64)
    while len(out) * 64 > bits:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def group_ties(ids: np.ndarray, sizes: np.ndarray, raw: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a group whose sizes and bitmaps allow a link.

    A set is compared with those of about its size in as many bits as the smallest of them has, whatever else is in the
    group: folded to the bits of a much smaller set, maps of large ones would differ in too few bits to tell them apart.
    """
    rule = Rule(percent)
    order = np.lexsort((ids, sizes))
    ids, sizes, raw = ids[order], sizes[order], [raw[i] for i in order]
    firsts = np.searchsorted(sizes, -(-sizes * percent // 100))
    widths = np.array([len(x) * 8 for x in raw])[firsts]  # sizes ascend, so widths do
    label = np.arange(len(ids))
    ties = []
    for bits in np.unique(widths):
        these = np.flatnonzero(widths == bits)
        start = int(firsts[these[0]])
        maps = np.stack([_folded(x, int(bits)) for x in raw[start : these[-1] + 1]])
        for i in these.tolist():
            first = int(firsts[i])
            if first == i:
                continue
            both = sizes[first:i] + sizes[i]
            differ = maps[first - start : i - start]
            near = np.flatnonzero(_overlap_bound(differ, maps[i - start], both) >= rule.least_overlap(both, 0)) + first
            for other in np.unique(label[near]):
                ties.append((int(ids[near[label[near] == other][0]]), int(ids[i])))
            if len(near):
                label[np.isin(label[:i], label[near]).nonzero()[0]] = label[near].min()
                label[i] = label[near].min()
    return ties


def _tier(percent: int):
    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (group, set, n_shingles, bits) in order of their groups, which may go on from batch to batch."""
        name, rows = None, []

        def close() -> pa.RecordBatch:
            ties = group_ties(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows], percent)
            return pa.record_batch([pa.array([t[i] for t in ties], pa.int64()) for i in range(2)], names=["u", "v"])

        found = []
        for batch in batches:
            for group, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group != name:
                    if len(rows) > 1:
                        found.append(close())
                    name, rows = group, []
                rows.append(row)
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()
                found = []
        if len(rows) > 1:
            yield close()

    return tie


def candidate_ties(sets: DataFrame, percent: int) -> DataFrame:
    """u, v: pairs of sets(set, n_shingles, keys, bits) through which every two sets that may link hang together."""
    width = shuffle_width(sets.sparkSession)
    dealt = sets.where("keys IS NOT NULL").select("set", "keys").mapInArrow(_dealer(width), "bucket int, keys binary, sets binary")
    met = dealt.repartitionById(width, F.col("bucket")).mapInArrow(_meet, "group binary, members array<bigint>")
    groups = pinned(met.dropDuplicates(["group"]))
    crowd = groups.where(F.size("members") > CROWDED)
    star = crowd.select(F.col("members")[0].alias("u"), F.explode("members").alias("v")).where("u <> v")
    spread = groups.where(F.size("members") <= CROWDED).select("group", F.explode("members").alias("set"))
    facts = spread.join(sets.select("set", "n_shingles", "bits").hint("merge"), "set").select("group", "set", "n_shingles", "bits")
    ordered = facts.repartition(width, "group").sortWithinPartitions("group")
    ties = pinned(ordered.mapInArrow(_tier(percent), "u bigint, v bigint").unionByName(star).distinct())
    release(groups)
    return ties


def tile_links(ids: np.ndarray, sizes: np.ndarray, apart: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets of a tile.

    `apart` is how each set differs from a set that all of a tile are seen from, as a sorted array; two sets differ from
    each other where just one of their arrays has a shingle. Seen from the empty set, an array is the set itself.
    """
    rule = Rule(percent)
    order = np.lexsort((ids, sizes))
    ids, sizes, apart = ids[order], sizes[order], [apart[i] for i in order]
    bits = bits_for(max(map(len, apart), default=1))
    maps = np.stack([bitmap(x, bits) for x in apart])
    parent = np.arange(len(ids))
    links = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(len(ids)):
        end = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        if end <= i + 1:
            continue
        both = sizes[i + 1 : end] + sizes[i]
        near = _overlap_bound(maps[i + 1 : end], maps[i], both) >= rule.least_overlap(both, 0)
        for j in np.flatnonzero(near) + i + 1:
            a, b = root(i), root(int(j))
            if a != b:
                met = len(np.intersect1d(apart[i], apart[j], assume_unique=True))
                total = int(sizes[i] + sizes[j])
                common = (total - (len(apart[i]) + len(apart[j]) - 2 * met)) // 2
                if 100 * common >= percent * (total - common):
                    parent[max(a, b)] = min(a, b)
                    links.append((int(ids[i]), int(ids[j])))
    return links


def _text_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    data, places = flat(texts)
    return [x for _, _, part, at in slices(data, places) for x in _sets(part, at, n)]


LINKS = "u bigint, v bigint"


def _linked(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})


def _cluster_solver(n: int, percent: int):
    """Rows (set, text) of a cluster that is one tile. Texts travel, since they compress and hashes of words do not."""

    def solve(table: pa.Table) -> pa.Table:
        shingles = [x for part in table.column("text").chunks for x in _text_sets(part, n)]
        sizes = np.array([len(x) for x in shingles], np.int64)
        return _linked(tile_links(table.column("set").to_numpy(), sizes, shingles, percent))

    return solve


def _tile_solver(percent: int):
    def solve(table: pa.Table) -> pa.Table:
        apart = [np.frombuffer(x, np.uint64) for x in table.column("apart").to_pylist()]
        return _linked(tile_links(table.column("set").to_numpy(), table.column("size").to_numpy(), apart, percent))

    return solve


SEEN = "set bigint, size bigint, apart binary"


def _seen_from(n: int):
    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (set, text, base), in runs of one base, to SEEN: the shingles that just one of text and base has."""
        name, base = None, np.zeros(0, np.uint64)
        for batch in batches:
            sizes, apart = [], []
            for row, own in enumerate(_text_sets(batch.column(1), n)):
                if (other := batch.column(2)[row].as_py()) != name:
                    name, base = other, _text_sets(batch.column(2)[row : row + 1], n)[0]
                sizes.append(len(own))
                apart.append(np.setxor1d(own, base, assume_unique=True).tobytes())
            out = [pa.array(sizes, pa.int64()), pa.array(apart, pa.binary())]
            yield pa.record_batch([batch.column(0), *out], names=["set", "size", "apart"])

    return see


def _solved(arrays: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Links in the tiles of placed(set, tiles)."""
    spread = arrays.join(placed, "set").select(F.explode("tiles").alias("tile"), "set", "size", "apart")
    return pinned(spread.groupBy("tile").applyInArrow(_tile_solver(percent), LINKS))


def _labels(edges: DataFrame) -> DataFrame:
    """set, label for every set that has an edge."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("v")).distinct()
    return pinned(forest.components(ends, edges)).select(F.col("v").alias("set"), "label")


def _links(texts: DataFrame, sets: DataFrame, ties: DataFrame, n: int, percent: int) -> DataFrame:
    """Spanning links among the sets(set, n_shingles) that candidate ties hold together.

    A cluster of up to BLOCK sets is one tile. A larger one is cut into size bands and blocks of them; first every block
    meets its neighbours, in its band and the next. Sets that are then outside their cluster's largest class meet all
    blocks of their band and its neighbours, so no link between two classes is missed.
    """
    rule = Rule(percent)
    edges = F.array(*[F.lit(int(x)) for x in rule.edges if x < 1 << 31])
    band = F.size(F.filter(edges, lambda e: e <= F.col("n_shingles"))) - 1
    grouped = _labels(ties).withColumnRenamed("label", "cluster").join(sets, "set").withColumn("band", band)
    sizes = grouped.groupBy("cluster").agg(F.count("*").alias("members"))
    grouped = pinned(with_group(grouped, sizes, "cluster", "members"))
    # the texts of these sets move once; their list grows with the corpus, so it is not broadcast at any size
    asked = grouped.select("set", "cluster", "members").hint("merge")
    named = texts.withColumnRenamed("doc_id", "set")
    called = pinned(named.join(asked, "set").select("set", "text", "cluster", "members"))
    alone = called.where(F.col("members") <= BLOCK).select("cluster", "set", "text")
    small = pinned(alone.groupBy("cluster").applyInArrow(_cluster_solver(n, percent), LINKS))
    large = pinned(grouped.where(F.col("members") > BLOCK).select("set", "cluster", "band", "members"))
    release(grouped)
    if large.isEmpty():
        release(called)
        return small
    # members of a large cluster are much alike: they travel as what sets them apart from the cluster's first
    crowd = called.where(F.col("members") > BLOCK)
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    first_texts = crowd.where("set = cluster").groupBy("cluster").agg(F.min("text").alias("base"), F.max("members").alias("members"))
    bases = first_texts.select("cluster", "base", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    based = crowd.withColumn("part", F.pmod(F.xxhash64("set"), parts).cast("int")).join(bases, ["cluster", "part"]).sortWithinPartitions("cluster", "part")
    arrays = pinned(based.select("set", "text", "base").mapInArrow(_seen_from(n), SEEN))
    release(called)
    units = large.groupBy("cluster", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    here = F.broadcast(units)  # a row per BLOCK members at the most dense, a few bytes each
    before = F.broadcast(units.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("before")))
    after = F.broadcast(units.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("after")))
    blocked = (
        large.join(here, ["cluster", "band"])
        .join(before, ["cluster", "band"], "left")
        .join(after, ["cluster", "band"], "left")
        .withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    )

    def tile(band, first, other, second):
        return F.concat_ws(":", "cluster", band, first, other, second)

    down = F.expr("filter(sequence(0, before - 1), b -> b % blocks = block)")
    near = F.array_union(
        F.array(
            tile("band", "block", F.lit("same"), F.lit("")),
            tile("band", F.expr("greatest(block - 1, 0)"), F.lit("same"), F.lit("")),
            tile("band", "block", F.lit("next"), F.lit("")),
        ),
        F.when(F.col("before").isNull(), F.array().cast("array<string>")).otherwise(
            F.transform(down, lambda b: tile(F.col("band") - 1, b, F.lit("next"), F.lit("")))
        ),
    )
    first = _solved(arrays, blocked.select("set", near.alias("tiles")), percent)
    classes = large.join(_labels(first), "set", "left").withColumn("label", F.coalesce("label", "set"))
    counted = classes.groupBy("cluster", "label").agg(F.count("*").alias("held"))
    largest = counted.groupBy("cluster").agg(F.max(F.struct("held", "label"))["label"].alias("largest"))
    outside = pinned(
        with_group(classes, largest.withColumn("one", F.lit(1)), "cluster", "one").where("label <> largest").select("set")
    )
    if outside.isEmpty():
        release(arrays)
        return small.unionByName(first)
    apart = blocked.join(outside.withColumn("out", F.lit(True)), "set", "left")
    # the outside sets of a band in blocks of their own; every block of the band and its neighbours meets each of them
    rest = apart.where("out").groupBy("cluster", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rests"))
    around = rest.select("cluster", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), F.struct("band", "rests").alias("r"))
    around = F.broadcast(around.groupBy("cluster", "band").agg(F.collect_list("r").alias("near")))
    met = apart.join(around, ["cluster", "band"])
    as_block = F.flatten(
        F.transform(
            "near",
            lambda r: F.transform(F.sequence(F.lit(0), r["rests"] - 1), lambda b: tile("band", "block", r["band"], b)),
        )
    )
    own_rest = F.pmod(F.xxhash64("set", F.lit(3)), F.expr("filter(near, r -> r.band = band)[0].rests")).cast("int")
    blocks_near = F.expr(
        "array_union(transform(sequence(0, blocks - 1), b -> struct(band as o, b as p)), array_union("
        "if(before is null, array(), transform(sequence(0, before - 1), b -> struct(band - 1 as o, b as p))),"
        "if(after is null, array(), transform(sequence(0, after - 1), b -> struct(band + 1 as o, b as p)))))"
    )
    as_rest = F.transform(blocks_near, lambda x: tile(x["o"], x["p"], F.col("band"), F.col("own")))
    tiles = F.when(F.col("out"), F.array_union(as_block, as_rest)).otherwise(as_block)
    second = _solved(arrays, met.withColumn("own", own_rest).select("set", tiles.alias("tiles")), percent)
    release(arrays, outside)
    return small.unionByName(first).unionByName(second)


def jaccard_components(
    docs: DataFrame, n: int = 3, percent: int = 90, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A set holds the different n-word shingles of the text, lower-cased in A-Z; of fewer words the whole sequence is one
    shingle. Documents link when 100 * intersection >= percent * union; component_id is the smallest id reachable.
    Texts that are null, empty or without words have empty sets and link with nothing. Rows with a null id are given no
    links, since ids name the components, and keep a null component_id; rows that repeat an id with different texts are
    compared by each text and the id joins their components. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows = columns(docs, id_column, text)
    rows = rows.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = sketch(rows.select("text"), n)
    made = pinned(rows.mapInArrow(_set_maker(n, percent, counts), SETS)) if len(counts) else None
    if made is None:  # no partition, so no rows
        return rows.select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    full = made.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    sets = pinned(
        full.groupBy("digest").agg(
            F.min("doc_id").alias("set"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("keys", ignorenulls=True).alias("keys"),
            F.first("bits", ignorenulls=True).alias("bits"),
            F.count("*").alias("copies"),
        )
    )
    ties = candidate_ties(sets, percent)
    own = sets.select("set", "n_shingles")
    labels = _labels(_links(rows.where("doc_id IS NOT NULL"), own, ties, n, percent))
    groups = sets.select("digest", "set", "copies").join(labels, "set", "left")
    groups = groups.select("digest", "copies", F.coalesce("label", "set").alias("component_id"))
    found = with_group(made.select("doc_id", "n_shingles", "digest"), groups, "digest", "copies")
    known = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", known.alias("component_id"))
