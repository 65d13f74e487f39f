"""Near-duplicate texts by MinHash with tensored banding.

A text is the set of its distinct shingles of two words (the whole sequence, if it has fewer). Two
texts link when ``100 * intersection >= 80 * union``; texts joined by links are one class.

- *Tables.* There are ``collections`` small collections of ``hashes`` minhashes. A table key is made of
  two collections, so m collections give m * (m - 1) / 2 tables of ``2 * hashes`` minhashes each, while
  only m * hashes minhashes are computed: 60 instead of 1140 for the defaults. Two sets meet when they
  agree in two collections at least. At a similarity of s a collection agrees with p = s ** hashes,
  so a pair is missed with (1 - p) ** m + m * p * (1 - p) ** (m - 1): 1.2e-5 at 0.8, 8e-8 at 0.85.
  Everything after the tables is exact.
- *Comparing.* Equal sets are one set. In every table bucket with more than one class all sets are
  compared with one pivot, on their full sets; what links takes over its label, so a crowd of near
  copies costs one comparison each. This is done ``ROUNDS`` times with other pivots.
- *The rest.* Sets of buckets that still hold several classes are dealt into groups by collection
  key and met in blocks of ``BLOCK_ROWS``. A pair is looked at in the first collection it agrees in
  only, and goes on to the comparison when classes, sizes and a bound leave a link possible: the sets
  are held as parities of 2048 cells, and cells with other parities are never more than differing
  shingles. So pairs within a block stay numbers in an array, and no row is made for them.

No group is collected beyond a block, no pair that can link is dropped, and nothing is broadcast but
bitmaps that keep rows out of a shuffle, sized by the counted keys up to ``MAX_BITS`` (exact joins follow).

Defined results: a null, empty or blank text has no shingles, links with nothing and is kept; null
ids are rows like others (a class of null ids only has a null id, and all of it is kept); repeated
rows are equal sets, and rows that share the smallest id are all kept. Only the id and the text are
read, and results have their own columns, so no other column can clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm import bitmaps
from orrery.llm.jaccard import shingle_sets
from orrery.llm.parity import array_rows, binary_rows, groups, parities
from orrery.llm.words import blocks, mix, signed
from orrery.operators.graphs import connected_components
from orrery.session import cut, stored

SHINGLE = 2
HASHES = 3
COLLECTIONS = 20
ROUNDS = 2
BLOCK_ROWS = 512
TABLE_ROWS = 1 << 13
COMPARED_ROWS = 256
MAX_BITS = 28
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _bits(count: int) -> int:
    """Size of a bitmap in which one of sixteen bits is set by ``count`` keys."""
    return min(max(16, (16 * count).bit_length()), MAX_BITS)


def collection_keys(hashes: np.ndarray, starts: np.ndarray, each: int, collections: int) -> np.ndarray:
    """One key per set and collection, from ``each`` minhashes of the shingle hashes of non-empty sets."""
    seeds = mix(np.arange(1, each * collections + 1, dtype=np.uint64) * _ODD)
    keys = np.zeros((len(starts), collections), dtype=np.uint64)
    for i, seed in enumerate(seeds):
        ordered = (hashes ^ seed) * _ODD
        ordered ^= ordered >> np.uint64(32)
        least = np.minimum.reduceat(ordered, starts)
        keys[:, i // each] = mix(keys[:, i // each] * np.uint64(5) + least)
    return keys


def _names(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of the name of every set."""
    halves = []
    for salt in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D):
        total = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(mix(hashes ^ np.uint64(salt)), out=total[1:])
        halves.append(signed(mix(total[bounds[1:]] - total[bounds[:-1]])))
    return halves[0], halves[1]


def _signatures(documents: DataFrame, id_column: str, text_column: str, size: int, each: int, collections: int) -> DataFrame:
    """(id, n, a, b, c, d, keys) of every row: a, b name its set, c, d its text; no keys without shingles."""
    kind = documents.schema[id_column].dataType.simpleString()
    names = ["id", "c", "d", "n", "a", "b", "keys"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(3), lower=True):
                hashes, bounds = shingle_sets(block, size)
                n = np.diff(bounds)
                keys = np.zeros((block.rows, collections), dtype=np.uint64)
                if len(hashes):
                    keys[n > 0] = collection_keys(hashes, bounds[:-1][n > 0], each, collections)
                own = batch.slice(block.first, block.rows)
                a, b = _names(hashes, bounds)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), own.column(2), pa.array(n, pa.int64()), pa.array(a), pa.array(b), binary_rows(keys)], names)

    columns = documents.select(F.col(id_column).alias("id"), *_text_names(text_column), F.col(text_column).alias("text"))
    return stored(columns.mapInArrow(sign, f"id {kind}, c long, d long, n long, a long, b long, keys binary"), "signatures")


def _text_names(text_column: str):
    return F.xxhash64(text_column).alias("c"), F.xxhash64(F.lit(1), text_column).alias("d")


def _distinct(signatures: DataFrame) -> DataFrame:
    """(node, a, b, n, c, d, keys): one row per distinct set, numbered, with the name of one of its texts."""
    text = F.min(F.struct("c", "d")).alias("text")
    one = signatures.filter("n > 0").groupBy("a", "b", "n", "keys").agg(text)
    return stored(one.select(
        F.monotonically_increasing_id().alias("node"), "a", "b", "n", "text.c", "text.d", "keys"), "sets")


def _tables(sets: DataFrame, likely=None) -> DataFrame:
    """(bucket, node): the table keys of every set; with ``likely`` only those that may be shared."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                keys, nodes = array_rows(part.column(1), np.uint64), part.column(0).to_numpy()
                left, right = np.triu_indices(keys.shape[1], 1)
                # the number of the table is in the key, so tables do not meet each other
                table = mix(np.arange(1, len(left) + 1, dtype=np.uint64))
                buckets = signed(mix(keys[:, left] * np.uint64(3) + mix(keys[:, right] + table)))
                buckets, owner = buckets.ravel(), np.repeat(nodes, len(left))
                if likely is not None:
                    kept = bitmaps.holds(likely.value, buckets)
                    buckets, owner = buckets[kept], owner[kept]
                yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(owner)], ["bucket", "node"])

    return sets.select("node", "keys").mapInArrow(pairs, "bucket long, node long")


def _shared_tables(sets: DataFrame) -> DataFrame:
    """(bucket, node) of the buckets that hold two sets at least."""
    # few sets make many rows, so they are dealt out anew
    sets = sets.select("node", "keys").repartition(-(-max(sets.count(), 1) // TABLE_ROWS))
    shared = cut(_tables(sets).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"))
    likely = sets.sparkSession.sparkContext.broadcast(bitmaps.of(shared, _bits(shared.count())))
    return stored(_tables(sets, likely).join(shared, "bucket"), "buckets")


def _texts(documents: DataFrame, wanted: DataFrame, text_column: str) -> DataFrame:
    """(node, text): the packed text of every set in ``wanted`` (node, c, d)."""
    likely = documents.sparkSession.sparkContext.broadcast(bitmaps.of(wanted.select("c"), _bits(wanted.count())))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            names = batch.column(0).to_numpy()
            rows = []
            for i in np.flatnonzero(bitmaps.holds(likely.value, names)).tolist():
                if names[i] not in seen:  # a task sends one of its copies
                    seen.add(names[i])
                    rows.append(i)
            for low in range(0, len(rows), COMPARED_ROWS):
                own = batch.take(pa.array(rows[low : low + COMPARED_ROWS], pa.int64()))
                packed = [zlib.compress((text or "").encode(), 1) for text in own.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(packed, pa.binary())], ["c", "d", "text"])

    found = documents.select(*_text_names(text_column), F.col(text_column).alias("text"))
    found = found.mapInArrow(pack, "c long, d long, text binary")
    return stored(found.join(wanted, ["c", "d"]).select("node", "text").dropDuplicates(["node"]), "texts")


def _sets_of(packed: list[bytes], size: int) -> list[np.ndarray]:
    texts = pa.array([zlib.decompress(text).decode() for text in packed], pa.large_string())
    found = []
    for block in blocks(texts, lower=True):
        hashes, bounds = shingle_sets(block, size)
        found += np.split(hashes, bounds[1:-1])
    return found


def _linked(texts: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose full sets link."""
    def sides(nodes: pa.Array, packed: pa.Array) -> list[np.ndarray]:
        _, first, place = np.unique(nodes.to_numpy(), return_index=True, return_inverse=True)
        found = _sets_of(packed.take(pa.array(first)).to_pylist(), size)
        return [found[i] for i in place]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, COMPARED_ROWS):
                part = batch.slice(low, COMPARED_ROWS)
                links = []
                for x, y in zip(sides(part.column(0), part.column(2)), sides(part.column(1), part.column(3)), strict=True):
                    both = np.sort(np.concatenate([x, y]))
                    links.append(9 * np.count_nonzero(both[1:] == both[:-1]) >= 4 * (len(x) + len(y)))
                yield part.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    met = pairs.join(b, "b").join(a, "a").select("a", "b", "x", "y")
    return cut(met.mapInArrow(compare, "a long, b long"))


def _labelled(listed: DataFrame, links: DataFrame) -> DataFrame:
    """``listed`` with a label of every node; nodes of one label are in one class, but not the other way round.

    A node takes the name of its linked neighbour of lowest priority (or its own), and of that
    neighbour's in turn. This is enough to leave out most pairs within a class, in two shuffles.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.groupBy("a").agg(F.min(F.struct(_priority("b").alias("priority"), F.col("b").alias("b"))).alias("best"))
    once = best.select(F.col("a").alias("node"), F.when(_priority("a") < F.col("best.priority"), F.col("a")).otherwise(
        F.col("best.b")).alias("next"))
    onward = once.select(F.col("node").alias("next"), F.col("next").alias("component"))
    return _placed(listed, once.join(onward, "next").select("node", "component"))


def _placed(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """``nodes`` with their component; one that has none is its own."""
    return nodes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _priority(node: str, turn: int = 0):
    return F.xxhash64(node, F.lit(turn))


def _components(links: DataFrame) -> DataFrame:
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return cut(connected_components(ends, links).select(F.col("id").alias("node"), "component"))


def _against_pivots(placed: DataFrame, turn: int) -> DataFrame:
    """(a, b): in every bucket with several classes its pivot beside each set of another class."""
    pivot = F.min(F.struct(_priority("node", turn).alias("priority"), F.col("node").alias("pivot"), F.col("component").alias("its"))).alias("least")
    open_buckets = placed.groupBy("bucket").agg(
        pivot, F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    open_buckets = open_buckets.select("bucket", "least.pivot", "least.its")
    met = placed.join(open_buckets, "bucket").filter("component <> its")
    return cut(met.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct())


def _possible(keys: np.ndarray, n: np.ndarray, classes: np.ndarray, bits: np.ndarray, part: np.ndarray, at: int,
              across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of one block that may link and whose first common collection is ``at``."""
    order = np.argsort(n, kind="stable")
    keys, n, classes, bits, part = keys[order], n[order], classes[order], bits[order].view(np.uint64), part[order]
    found_i, found_j = [], []
    for i in range(len(n)):
        # sets are ordered by size, so those that can link with row i are a stretch after it
        stop = int(np.searchsorted(n, 5 * n[i] // 4, side="right"))
        near = slice(i + 1, max(stop, i + 1))
        fits = classes[near] != classes[i]
        if across:
            fits &= part[near] != part[i]
        j = np.flatnonzero(fits) + i + 1
        if not len(j):
            continue
        same = keys[j] == keys[i]
        j = j[(same.argmax(axis=1) == at) & same[:, at] & (same.sum(axis=1) > 1)]
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1)
        j = j[9 * apart.astype(np.int64) <= n[j] + n[i]]
        found_i.append(np.full(len(j), i))
        found_j.append(j)
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(found_i)], order[np.concatenate(found_j)]


def _in_blocks(placed: DataFrame, sets: DataFrame, texts: DataFrame, size: int, block_rows: int) -> DataFrame:
    """(a, b): pairs of different classes that agree in two collections and that no bound excludes."""
    # a bucket of two sets was decided by its pivot
    unsettled = placed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    unsettled = unsettled.filter("n > 2 and low < high").select("bucket")
    nodes = cut(placed.join(unsettled, "bucket").select("node", "component").distinct())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, COMPARED_ROWS):
                part = batch.slice(low, COMPARED_ROWS)
                keys = array_rows(part.column(3), np.uint64)
                bits = binary_rows(parities(_sets_of(part.column(4).to_pylist(), size)))
                own = [part.column(0), part.column(1), part.column(2), part.column(3), bits]
                for at in range(keys.shape[1]):
                    group = pa.array(signed(mix(keys[:, at] + np.uint64(at + 1) * _ODD)))
                    yield pa.RecordBatch.from_arrays([group, pa.array(np.full(len(keys), at, np.int32)), *own], names)

    names = ["group", "at", "node", "component", "n", "keys", "bits"]
    held = nodes.join(sets.select("node", "n", "keys"), "node").join(texts, "node")
    held = stored(held.select("node", "component", "n", "keys", "text").mapInArrow(
        spread, "group long, at int, node long, component long, n long, keys binary, bits binary"), "unsettled")
    parts = F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int")
    several = held.groupBy("group").agg(
        parts.alias("parts"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    dealt = held.join(several.select("group", "parts"), "group")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(
        "group", F.least("part", "other").cast("long").alias("i"), F.greatest("part", "other").cast("long").alias("j"),
        "at", "part", "node", "component", "n", "keys", "bits")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 3):
            if len(rows) < 2:
                continue
            rows = rows.combine_chunks()
            at, part, node, component, n = (rows.column(name).to_numpy() for name in ("at", "part", "node", "component", "n"))
            keys = array_rows(rows.column("keys").combine_chunks(), np.uint64)
            bits = array_rows(rows.column("bits").combine_chunks(), np.uint8)
            across = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
            i, j = _possible(keys, n, component, bits, part, int(at[0]), across)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

    grouped = dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    return cut(grouped.mapInArrow(meet, "a long, b long"))


def links(documents: DataFrame, sets: DataFrame, text_column: str = "text", size: int = SHINGLE,
          block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(node, component) by the links to pivots, and the other links (a, b) between those classes; all are
    verified, and together they join what all links between sets that share a table key join."""
    listed = _shared_tables(sets)
    wanted = cut(listed.select("node").distinct().join(sets.select("node", "c", "d"), "node"))
    texts = _texts(documents, wanted, text_column)
    found, placed = None, listed.withColumn("component", F.col("node"))
    for turn in range(ROUNDS):
        if turn:
            placed = cut(_labelled(listed, found))
        new = _linked(texts, _against_pivots(placed, turn), size)
        found = new if found is None else found.unionByName(new)
    # whole classes from here on, or a crowd of several labels would list the links between them
    joined = _components(found)
    placed = cut(_placed(listed, joined))
    late = _linked(texts, _in_blocks(placed, sets, texts, size, block_rows), size)
    return joined, late


def classes(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE,
            hashes: int = HASHES, collections: int = COLLECTIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row per row of ``documents``."""
    signatures = _signatures(documents, id_column, text_column, size, hashes, collections)
    sets = _distinct(signatures)
    joined, late = links(documents, sets, text_column, size, block_rows)
    for end in ("a", "b"):  # links between classes
        late = _placed(late.withColumnRenamed(end, "node"), joined).drop("node").withColumnRenamed("component", end)
    whole = _components(cut(late.distinct())).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    owner = _placed(sets.select("node", "a", "b"), joined).join(whole, "component", "left").select(
        "a", "b", F.coalesce("whole", "component").alias("component"))
    # copies are folded to one row per set before classes are put together
    least = signatures.filter("n > 0").groupBy("a", "b").agg(F.min("id").alias("first")).join(owner, ["a", "b"])
    smallest = least.groupBy("component").agg(F.min("first").alias("component_id"))
    named = cut(least.join(smallest, "component").select("a", "b", "component_id"))
    full = signatures.filter("n > 0").join(named, ["a", "b"]).select("id", "n", "component_id")
    empty = signatures.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.unionByName(empty).select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
