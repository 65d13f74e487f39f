"""Jaccard join of texts on word shingles, with skipping in the index and in the answers.

A text is the set of its distinct shingles of five words (the whole sequence, if it has fewer).
Two texts link when ``100 * intersection >= 80 * union``, and texts joined by links are one class.

- Equal sets are one set from the start.
- *Index.* Shingles have one global order: rare before frequent (by a sketch of all counts with a
  fixed number of cells), then by hash. Only the head of each set in that order is posted: two
  sets that link share a shingle there. A list is cut into blocks of like set size; only blocks
  whose sizes can link meet, and a pair is skipped when the places of the shared shingle leave too
  few shingles for a link. The order decides the work, never the answer.
- *Answers.* First every set is compared with one set only, the smallest of the lists it shares
  most. A set found similar takes over that set's class, so whatever is in the class already needs
  no comparison: a crowd of near copies costs one comparison each. Then the pairs of the lists
  whose classes still differ are met in blocks, and those that neither sizes, places nor parity
  sketches of the sets rule out are compared, all of them.

No list is collected, no pair inside a class is emitted, and links are compared on the whole sets as
64-bit shingle hashes; a set is named by 64 bits, a listed shingle by 58 behind its class of counts. Broadcast are the sketch (``cells`` bytes) and bitmaps of ``2 ** bitmaps.BITS`` bits that
keep rows which surely meet nothing out of the shuffle; their size is fixed, exact joins follow.

Defined results: a null, empty or blank text has no shingles and links with nothing; null ids are
kept (a class of null ids only has a null id); repeated rows are equal sets. Extra columns may have any
name: classes have their own columns, and kept rows come back with theirs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm import bitmaps
from orrery.llm.columns import unused
from orrery.llm.parity import array_rows, binary_rows, groups, parities
from orrery.llm.words import Block, blocks, mix, ngrams, ranges, signed
from orrery.operators.graphs import connected_components
from orrery.session import cut_to_size, stored

SHINGLE = 5
CELL_BITS = 20
COMPARED_ROWS = 256
BLOCK_ROWS = 512
PAIR_ROWS = 64
PAIRS_A_PART = 1024


def shingle_sets(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ascending, and the offsets per text."""
    words, offsets = block.word_hashes, block.word_offsets
    hashes, _, bounds = ngrams(words, offsets, size)
    length = np.diff(offsets)
    short = np.flatnonzero((length > 0) & (length < size))
    if len(short):
        total = length[short].astype(np.uint64)
        for j in range(size - 1):
            longer = length[short] > j
            total[longer] = mix(total[longer] + words[offsets[short[longer]] + j])
        hashes = np.insert(hashes, bounds[short], total)
        counts = np.diff(bounds)
        counts[short] = 1
        bounds = np.concatenate([[0], np.cumsum(counts)])
    _sort_each(hashes, bounds)
    new = np.ones(len(hashes) + 1, dtype=np.int64)
    new[1:-1] = hashes[1:] != hashes[:-1]
    new[bounds] = 1
    kept = new[:-1] > 0
    return hashes[kept], np.concatenate([[0], np.cumsum(kept)])[bounds]


def _sort_each(values: np.ndarray, bounds: np.ndarray) -> None:
    """Sort the values of every text in place."""
    cuts = bounds.tolist()
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        values[low:high].sort()


def _nodes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of every set; equal sets, equal name."""
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    return signed(mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))


def _sets(documents: DataFrame, id_column: str, text_column: str, size: int, cell_bits: int) -> tuple[DataFrame, DataFrame]:
    """(id, key, n, node) of every row, where ``key`` tells texts of one id apart, and from the same
    scan the counts of all shingles in ``2 ** cell_bits`` cells, as segments."""
    kind = documents.schema[id_column].dataType.simpleString()
    names = ["id", "key", "n", "node", "at", "cells"]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, types = np.zeros(1 << cell_bits, dtype=np.int64), None
        for batch in batches:
            types = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int64(), pa.int64()]
            for block in blocks(batch.column(2), lower=True):
                hashes, bounds = shingle_sets(block, size)
                cells += np.bincount((hashes >> np.uint64(64 - cell_bits)).astype(np.int64), minlength=1 << cell_bits)
                own = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(np.diff(bounds)), pa.array(_nodes(hashes, bounds)),
                     pa.nulls(block.rows, pa.int32()), pa.nulls(block.rows, pa.binary())], names)
        for part in bitmaps.segments(np.minimum(cells, 2**32 - 1)):
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, kind) for kind in types], *part.columns], names)

    columns = documents.select(F.col(id_column), F.xxhash64(text_column), F.col(text_column))
    both = stored(columns.mapInArrow(name, f"id {kind}, key long, n long, node long, at int, cells binary"), "sets")
    return both.filter("at is null").select("id", "key", "n", "node"), both.filter("at is not null").select("at", "cells")


def _sum(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum(x.astype(np.int64) + y, 2**32 - 1).astype(np.uint32)


def _frequencies(counts: DataFrame, cell_bits: int) -> np.ndarray:
    """The counts in all cells, each as its bit length."""
    cells = bitmaps.merged(counts, 1 << cell_bits, _sum)
    return np.ceil(np.log2(cells + 1.0)).astype(np.int8)


def _shared_shingles(documents: DataFrame, text_column: str, size: int, ranks) -> DataFrame:
    """Shingles that stand in the head of two rows at least."""
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), lower=True):
                hashes, bounds, _ = _heads(*shingle_sets(block, size), ranks.value)
                yield pa.RecordBatch.from_arrays([pa.array(signed(hashes))], ["shingle"])

    posted = documents.select(text_column).mapInArrow(heads, "shingle long")
    return posted.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("shingle")


def _heads(hashes: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first shingles of every set in the global order: (hashes, offsets per text, places)."""
    n = np.diff(bounds)
    shift = np.uint64(64 - (len(classes).bit_length() - 1))
    # the class of the count (6 bits) stands before the hash, so one sort gives the order
    ordered = (classes[(hashes >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (hashes >> np.uint64(6))
    _sort_each(ordered, bounds)
    length = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
    cuts = np.concatenate([[0], np.cumsum(length)])
    return ordered[ranges(bounds[:-1], length)], cuts, ranges(np.zeros(len(n), np.int64), length)


def _postings(documents: DataFrame, text_column: str, size: int, ranks, likely) -> DataFrame:
    """(node, n, at, shingle): the heads of all sets, but for shingles that surely stand in one row only."""
    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), lower=True):
                hashes, bounds = shingle_sets(block, size)
                names = _nodes(hashes, bounds)
                heads, cuts, at = _heads(hashes, bounds, ranks.value)
                owner = np.repeat(np.arange(block.rows), np.diff(cuts))
                kept = bitmaps.holds(likely.value, signed(heads))
                owner = owner[kept]
                yield pa.RecordBatch.from_arrays([
                    pa.array(names[owner]), pa.array(np.diff(bounds)[owner].astype(np.int32)),
                    pa.array(at[kept].astype(np.int32)), pa.array(signed(heads[kept]))], ["node", "n", "at", "shingle"])

    return documents.select(text_column).mapInArrow(head, "node long, n int, at int, shingle long")


def _texts(documents: DataFrame, nodes: DataFrame, text_column: str, size: int) -> DataFrame:
    """(node, text): one packed text (smaller than its set) of each set in ``nodes``, and of few others.

    Copies of a text are one row, so they multiply no pair; a task drops its own before the shuffle.
    """
    likely = documents.sparkSession.sparkContext.broadcast(bitmaps.of(nodes))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for block in blocks(batch.column(0), lower=True):
                names = _nodes(*shingle_sets(block, size))
                rows = []
                for i in np.flatnonzero(bitmaps.holds(likely.value, names)):
                    if names[i] not in seen:
                        seen.add(names[i])
                        rows.append(i)
                held = block.data.tobytes()
                packed = [zlib.compress(held[block.offsets[i] : block.offsets[i + 1]], 1) for i in rows]
                yield pa.RecordBatch.from_arrays([pa.array(names[rows], pa.int64()), pa.array(packed, pa.binary())], ["node", "text"])

    found = documents.select(text_column).mapInArrow(collect, "node long, text binary")
    kept = stored(found.dropDuplicates(["node"]), "texts")
    likely.destroy()
    return kept


def _verified(texts: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(a, b) of the distinct pairs that link, cut; only sets that are in a pair are shuffled."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    likely = texts.sparkSession.sparkContext.broadcast(bitmaps.of(wanted))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitmaps.holds(likely.value, batch.column(0).to_numpy())))

    def sets_of(nodes: pa.Array, packed: pa.Array) -> list[np.ndarray]:
        """The sets of all rows; a text that comes in many rows is taken apart once."""
        _, first, place = np.unique(nodes.to_numpy(), return_index=True, return_inverse=True)
        texts = pa.array([zlib.decompress(text).decode("utf-8") for text in packed.take(pa.array(first)).to_pylist()], pa.large_string())
        found = []
        for block in blocks(texts):
            hashes, bounds = shingle_sets(block, size)
            found += np.split(hashes, bounds[1:-1])
        return [found[i] for i in place]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COMPARED_ROWS):
                part = batch.slice(at, COMPARED_ROWS)
                linked = []
                sides = (sets_of(part.column(i), part.column(i + 2)) for i in (0, 1))
                for x, y in zip(*sides, strict=True):
                    both = np.sort(np.concatenate([x, y]))
                    shared = np.count_nonzero(both[1:] == both[:-1])
                    linked.append(9 * shared >= 4 * (len(x) + len(y)))
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    chosen = texts.mapInArrow(choose, "node long, text binary")
    a = chosen.select(F.col("node").alias("a"), F.col("text").alias("x"))
    b = chosen.select(F.col("node").alias("b"), F.col("text").alias("y"))
    met = pairs.join(b, "b").join(a, "a").select("a", "b", "x", "y")
    found, _ = cut_to_size(met.mapInArrow(compare, "a long, b long"))
    likely.destroy()
    return found


def _band(n):
    """Number of a block of set sizes; sizes that can link are in the same or in neighbouring blocks."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.2500001))).cast("int")


def links(documents: DataFrame, sets: DataFrame, counts: DataFrame, text_column: str = "text", size: int = SHINGLE,
          cell_bits: int = CELL_BITS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the sets that link with the one set they were compared with first, and
    (a, b) of the links between sets whose classes still differed; every link is verified."""
    context = documents.sparkSession.sparkContext
    ranks = context.broadcast(_frequencies(counts, cell_bits))
    shared, _ = cut_to_size(_shared_shingles(documents, text_column, size, ranks))
    likely = context.broadcast(bitmaps.of(shared))
    postings = _postings(documents, text_column, size, ranks, likely).join(shared, "shingle")
    listed = stored(postings.distinct(), "lists")
    for held in (ranks, likely):
        held.destroy()  # a copy of each is on the disk of every executor
    firsts, _ = cut_to_size(listed.groupBy("shingle").agg(F.min("node").alias("first"), F.max("node").alias("_last")).filter(
        "first < _last").select("shingle", "first"))
    votes = listed.join(firsts, "shingle").filter("node <> first").groupBy("node", "n", "first").agg(
        F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("node").agg(F.max(F.struct("votes", "first", "n")).alias("best"))
    # what two heads share and the longer of the rest bound the intersection
    sizes = sets.filter("n > 0").select(F.col("node").alias("a"), F.col("n").alias("m")).distinct()
    pairs = best.select(F.col("best.first").alias("a"), F.col("node").alias("b"), F.col("best.votes").alias("votes"), F.col("best.n").alias("n"))
    rest = F.greatest(F.expr("(4 * n + 4) div 5 - 1"), F.expr("(4 * m + 4) div 5 - 1"))
    pairs, _ = cut_to_size(
        pairs.join(sizes, "a").filter(9 * (F.col("votes") + rest) >= 4 * (F.col("n") + F.col("m"))).select("a", "b"), PAIRS_A_PART)
    # whoever is in any list with another set may be compared later
    texts = _texts(documents, listed.join(firsts, "shingle").select("node"), text_column, size)
    near = _verified(texts, pairs, size)
    found, _ = cut_to_size(_components(near))
    known = listed.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # lists that still hold more than one class
    open_lists = known.groupBy("shingle").agg(F.min("component").alias("c"), F.max("component").alias("d")).filter("c < d")
    open_lists, _ = cut_to_size(open_lists.select("shingle"))
    rest, _ = cut_to_size(known.join(open_lists, "shingle").select("shingle", "node", "n", "at", "component"))
    pairs, _ = cut_to_size(_possible(rest, texts, size, block_rows).distinct(), PAIRS_A_PART)
    return found, _verified(texts, pairs, size)


def _sketches(texts: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, bits): the parity sketches of the sets in ``nodes``."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, COMPARED_ROWS):
                part = batch.slice(low, COMPARED_ROWS)
                sets = []
                for block in blocks(pa.array([zlib.decompress(text).decode("utf-8") for text in part.column(1).to_pylist()], pa.large_string())):
                    hashes, bounds = shingle_sets(block, size)
                    sets += np.split(hashes, bounds[1:-1])
                yield pa.RecordBatch.from_arrays([part.column(0), binary_rows(parities(sets))], ["node", "bits"])

    return stored(texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(sketch, "node long, bits binary"), "sketches")


def _possible(rest: DataFrame, texts: DataFrame, size: int, block_rows: int) -> DataFrame:
    """(a, b): the pairs of the lists in ``rest`` that no bound rules out.

    A list is cut into blocks of like set size, and a large block into pieces, all pairs of which meet; inside
    a task sizes, classes, places and parity sketches leave pairs out before any of them is a row.
    """
    sketches = _sketches(texts, rest.select("node").distinct(), size)
    # a set is a probe in the block of its own size, and listed there and in the block above
    role = F.struct(F.lit(0).alias("listed"), _band(F.col("n")).alias("band"))
    index = [F.struct(F.lit(1).alias("listed"), (_band(F.col("n")) + up).alias("band")) for up in (0, 1)]
    roles = F.when(F.expr("at < n - (8 * n + 8) div 9 + 1"), F.array(role, *index)).otherwise(F.array(role))
    rows = rest.withColumn("role", F.explode(roles)).select("shingle", "role.band", "role.listed", "node", "n", "at", "component")
    several = rows.groupBy("shingle", "band").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("pieces"), F.min("component").alias("c"),
        F.max("component").alias("d"), F.min("listed").alias("low"), F.max("listed").alias("high")).filter("c < d and low < high")
    dealt = rows.join(several.select("shingle", "band", "pieces"), ["shingle", "band"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    probe = F.col("listed") == 0
    dealt = dealt.withColumn("i", F.when(probe, F.col("own")).otherwise(F.col("other")).cast("long")).withColumn(
        "j", F.when(probe, F.col("other")).otherwise(F.col("own")).cast("long"))
    dealt = dealt.select(
        "shingle", F.col("band").cast("long").alias("band"), "i", "j", "listed", "node", F.col("n").cast("long").alias("n"),
        F.col("at").cast("long").alias("at"), "component").join(sketches, "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 4):
            table = table.combine_chunks()
            listed, node, n, at, component = (table.column(name).to_numpy() for name in ("listed", "node", "n", "at", "component"))
            bits = array_rows(table.column("bits").combine_chunks(), np.uint64)
            x, y = np.flatnonzero(listed == 0), np.flatnonzero(listed == 1)
            for low in range(0, len(x), PAIR_ROWS):
                a = x[low : low + PAIR_ROWS, None]
                # of equal sizes the one with the larger name is the probe
                smaller = (n[y] < n[a]) | ((n[y] == n[a]) & (node[y] < node[a]))
                left_over = np.minimum(n[a] - at[a], n[y] - at[y])
                fits = smaller & (component[y] != component[a]) & (5 * n[y] >= 4 * n[a]) & (9 * left_over >= 4 * (n[a] + n[y]))
                i, j = np.nonzero(fits)
                i, j = a[i, 0], y[j]
                apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                i, j = (side[9 * apart <= n[i] + n[j]] for side in (i, j))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

    met = dealt.repartition("shingle", "band", "i", "j").sortWithinPartitions("shingle", "band", "i", "j")
    return met.select("shingle", "band", "i", "j", "listed", "node", "n", "at", "component", "bits").mapInArrow(meet, "a long, b long")


def _components(edges: DataFrame) -> DataFrame:
    """(node, component) of all ends of ``edges``."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return connected_components(ends, edges).select(F.col("id").alias("node"), "component")


def classes(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE,
            cell_bits: int = CELL_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document row: (id, key, n_shingles, component, component_id, class_rows)."""
    sets, counts = _sets(documents, id_column, text_column, size, cell_bits)
    found, late = links(documents, sets, counts, text_column, size, cell_bits, block_rows)
    for end in ("a", "b"):  # links between the classes of the first comparisons
        late = late.join(found.select(F.col("node").alias(end), F.col("component").alias("_of")), end, "left").withColumn(
            end, F.coalesce("_of", end)).drop("_of")
    onward = cut_to_size(_components(cut_to_size(late.distinct())[0]))[0].select(F.col("node").alias("component"), F.col("component").alias("_whole"))
    placed = sets.filter("n > 0").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed, _ = cut_to_size(placed.join(onward, "component", "left").select(
        "id", "key", "n", F.coalesce("_whole", "component").alias("component")))
    smallest, _ = cut_to_size(placed.groupBy("component").agg(
        F.min("id").alias("component_id"), F.count(F.lit(1)).alias("class_rows")))
    full = placed.join(smallest, "component").select(
        F.col("id").alias(id_column), "key", F.col("n").alias("n_shingles"), "component", "component_id", "class_rows")
    empty = sets.filter("n = 0").select(
        F.col("id").alias(id_column), "key", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id"),
        F.lit(1).cast("long").alias("class_rows"))
    return full.union(empty)


def keep_first(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE,
               cell_bits: int = CELL_BITS) -> DataFrame:
    """The rows of ``documents`` with the smallest id of each class; rows without shingles all stay."""
    found, _ = cut_to_size(classes(documents, id_column, text_column, size, cell_bits))
    full, empty = found.filter("n_shingles > 0"), found.filter("n_shingles = 0")
    least = F.min(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.col("key").alias("key")))
    kept, key, blank, own, turn = unused(documents, "_kept", "_key", "_empty", "_own", "_turn")
    chosen = full.groupBy("component").agg(least.alias("least")).select(
        F.col("least.id").alias(kept), F.col("least.key").alias(key), F.lit(False).alias(blank))
    without = empty.select(F.col(id_column).alias(kept), F.col("key").alias(key), F.lit(True).alias(blank)).distinct()
    keys = chosen.union(without)
    mine = documents.withColumn(own, F.xxhash64(text_column))
    joined = mine.join(keys, mine[id_column].eqNullSafe(keys[kept]) & (mine[own] == keys[key]))
    if not full.groupBy(id_column, "key").count().filter("count > 1").isEmpty():
        # of equal rows one stays, but for those without shingles
        number = F.when(F.col(blank), F.monotonically_increasing_id()).otherwise(F.lit(-1))
        joined = joined.withColumn(turn, number).dropDuplicates([id_column, own, turn])
    return joined.select(*documents.columns)
