"""Mixing sources to target weights: exact quotas, split among output shards, drawn as disjoint blocks.

Every text is cut into blocks of ``block_words`` words. The blocks of a source are put into one
random (hashed) order; the mix takes all of them as often as the target holds the source, and then
the head of the order up to the target. How many of a source's taken blocks an output shard gets
is drawn by a tree: the shards are halved again and again and each half's counts follow the
multivariate hypergeometric distribution, so the quotas are whole numbers that add up exactly. A
shard's share is a run of neighbouring places of the order: disjoint from all others. Rows are
then shuffled inside each shard.

Only sums per source reach the driver (a source is a label: one row each), never rows. Order and
places come from a range-partitioned layout, so a source of any size spans many tasks.

Defined results: a null or empty text has size 0, gives no block and is taken 0 times; null is a
source of its own, last; a null id is an id; repeated rows are each drawn; an empty table gives an
empty mix. The same rows and seed give the same draw. Extra columns may have any name; mixed rows come
back with theirs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from orrery.llm.columns import unused
from orrery.llm.words import blocks
from orrery.session import cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MAX_TIMES = 1.5, 2.0
BLOCK_WORDS = 256
SHARDS = 16
SEED = 17
BROADCAST_SOURCES = 100_000


def sizes(documents: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """(id, source, key, size): a hash of the text and the number of words of every row."""
    kinds = [documents.schema[c].dataType.simpleString() for c in (id_column, source_column)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64), *[np.diff(block.word_offsets) for block in blocks(batch.column(3))]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.concatenate(found), pa.int64())], ["id", "source", "key", "size"])

    return documents.select(id_column, source_column, F.xxhash64(text_column), text_column).mapInArrow(
        count, f"id {kinds[0]}, source {kinds[1]}, key long, size long")


def targets(source_sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            max_times: float = MAX_TIMES) -> list[float]:
    """Words of each source in the mix, sources in their order with ``weights`` repeating.

    ``share`` of all words are divided by weight; a target stops at ``max_times`` its source, and
    what is over is divided again among the rest.
    """
    size = np.array(source_sizes, dtype=np.float64)
    weight = np.array([weights[i % len(weights)] for i in range(len(size))], dtype=np.float64)
    cap = size * max_times
    target = np.zeros(len(size))
    fixed = np.zeros(len(size), dtype=bool)
    total = share * size.sum()
    while not fixed.all():
        rest = total - target[fixed].sum()
        target[~fixed] = rest * weight[~fixed] / weight[~fixed].sum()
        over = ~fixed & (target > cap)
        if not over.any():
            break
        target[over] = cap[over]
        fixed |= over
    return target.tolist()


def split_quotas(counts: Sequence[int], shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """(source, shard) block counts: rows sum to ``counts``, columns differ by one block at most.

    The mix of all sources is dealt to two halves of the shards, each half to its halves, and so
    on; a half's counts are a draw without replacement from what its parent holds.
    """
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    room = np.diff([total * i // shards for i in range(shards + 1)])
    result = np.zeros((len(counts), shards), dtype=np.int64)
    random = np.random.default_rng(seed)
    waiting = [(0, shards, counts)]
    while waiting:
        low, high, held = waiting.pop()
        if high - low == 1:
            result[:, low] = held
            continue
        middle = (low + high) // 2
        left = _draw(random, held, int(room[low:middle].sum()))
        waiting.append((middle, high, held - left))
        waiting.append((low, middle, left))
    return result


def _draw(random: np.random.Generator, held: np.ndarray, n: int) -> np.ndarray:
    """``n`` of all held blocks without replacement, as counts per source: one conditional draw each."""
    left = np.zeros_like(held)
    others = int(held.sum())
    for i, own in enumerate(held.tolist()):
        others -= own
        if n <= 0:
            break
        # the generator takes numbers below 10**9
        small = own + others < 10**9
        left[i] = (random.hypergeometric(own, others, n) if own else 0) if small else draw_large(random, own, others, n)
        n -= int(left[i])
    return left


def draw_large(random: np.random.Generator, own: int, others: int, n: int) -> int:
    """How many of ``n`` drawn without replacement are among ``own``, for counts of any size.

    By inversion around the mode: probabilities relative to it follow from ratios of neighbours. What is
    farther away than twelve deviations (and 64) has less than 1e-30 of all and is below a double's last digit.
    """
    low, high = max(0, n - others), min(own, n)
    whole = own + others
    mode = min(max((n + 1) * (own + 1) // (whole + 2), low), high)
    spread = (n * (own / whole) * (others / whole) * (max(whole - n, 0) / max(whole - 1, 1))) ** 0.5
    reach = int(12 * spread) + 64
    up = np.arange(mode, min(mode + reach, high), dtype=np.float64)  # ratios p(k + 1) / p(k)
    down = np.arange(mode, max(mode - reach, low), -1, dtype=np.float64)  # ratios p(k - 1) / p(k)
    rise = np.cumprod((own - up) * (n - up) / ((up + 1) * (others - n + up + 1)))
    fall = np.cumprod(down * (others - n + down) / ((own - down + 1) * (n - down + 1)))
    weights = np.concatenate([fall[::-1], [1.0], rise])
    totals = np.cumsum(weights)
    at = int(np.searchsorted(totals, random.random() * totals[-1], side="right"))
    return mode - len(fall) + min(at, len(weights) - 1)


def _in_order(pieces: DataFrame, order: Sequence[str]) -> DataFrame:
    """``pieces`` with the words and the rows before each in the whole order, from one range layout."""
    kinds = ", ".join(f"{name} {kind}" for name, kind in pieces.dtypes)
    at = pieces.columns.index("words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words, rows = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            own = batch.column(at).to_numpy()
            ends = words + np.cumsum(own)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ends - own), pa.array(np.arange(rows, rows + len(own))),
                 pa.array(np.full(len(own), part, np.int32))], [*batch.schema.names, "words_before", "rows_before", "part"])
            words, rows = (int(ends[-1]) if len(own) else words), rows + len(own)

    # checkpointed with its partition numbers: range bounds are sampled and must not be drawn twice
    laid = cut(pieces.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run, f"{kinds}, words_before long, rows_before long, part int"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy("part").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"))
    # one row per partition
    return laid.join(F.broadcast(offsets), "part").withColumns(
        {"words_before": F.col("words_before") + F.col("w"), "rows_before": F.col("rows_before") + F.col("n")}
    ).drop("part", "w", "n")


def _small(frame: DataFrame, rows: int) -> DataFrame:
    """One row per source: broadcast while the sources are few."""
    return F.broadcast(frame) if rows <= BROADCAST_SOURCES else frame


def plan(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_times: float = MAX_TIMES,
         block_words: int | None = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, id_column: str = "doc_id",
         source_column: str = "source", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, draws).

    ``rows``: (row, id, source, size, source_size, target) per document row. ``draws``: one line per
    taken block and pass: (row, id, key, block, words, pass, shard, place), ``place`` ordering a shard.
    With ``block_words`` None a block is a whole document.
    """
    spark = documents.sparkSession
    # checkpointed: the row numbers must not change when rows are read again
    rows = cut(sizes(documents, id_column, source_column, text_column).withColumn("row", F.monotonically_increasing_id()))
    width = F.lit(block_words) if block_words else F.greatest(F.col("size"), F.lit(1))
    count = F.ceil(F.col("size") / width)
    # one line per source: sources are labels, not rows
    facts = rows.groupBy("source").agg(F.sum("size").alias("size"), F.sum(count).alias("blocks")).collect()
    facts = sorted(facts, key=lambda r: (r.source is None, r.source or ""))
    goals = targets([r.size for r in facts], weights, share, max_times)
    passes = [int(goal // r.size) if r.size else 0 for goal, r in zip(goals, facts, strict=True)]
    words_first = np.concatenate([[0], np.cumsum([r.size for r in facts])]).tolist()
    rows_first = np.concatenate([[0], np.cumsum([r.blocks for r in facts])]).tolist()
    kind = documents.schema[source_column].dataType.simpleString()
    known = _small(spark.createDataFrame(
        [(i, r.source, int(r.size), int(r.blocks), goals[i], passes[i], float(goals[i] - passes[i] * r.size),
          int(words_first[i]), int(rows_first[i])) for i, r in enumerate(facts)],
        f"number int, _source {kind}, source_size long, blocks long, target double, passes int, rest double, "
        "words_first long, rows_first long"), len(facts))
    same = F.col("source").eqNullSafe(F.col("_source"))
    named = rows.join(known.select("_source", "number", "source_size", "target"), same).drop("_source")
    cuts = F.sequence(F.lit(0), (count - 1).cast("int"))
    pieces = named.filter("size > 0").select("number", "row", "id", "key", "size", F.explode(cuts).alias("block"))
    pieces = pieces.select(
        "number", F.xxhash64("id", "block", F.lit(seed)).alias("order"), "id", "key", "block", "size", "row",
        F.least(width, F.col("size") - F.col("block") * width).cast("long").alias("words"))
    laid = _in_order(pieces, ["number", "order", "id", "key", "block", "row"]).join(
        known.select("number", "blocks", "passes", "rest", "words_first", "rows_first"), "number")
    last = F.col("words_before") - F.col("words_first") + F.col("words") / 2 <= F.col("rest")
    laid = laid.withColumn("times", F.col("passes") + last.cast("int"))
    drawn = {r.number: r.n for r in laid.groupBy("number").agg(F.sum("times").alias("n")).collect()}
    quotas = split_quotas([drawn.get(i, 0) for i in range(len(facts))], shards, seed)
    ends = _small(spark.createDataFrame(
        [(i, np.cumsum(quota).tolist()) for i, quota in enumerate(quotas)], "number int, ends array<long>"), len(facts))
    copies = laid.filter("times > 0").join(ends, "number").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    place = F.col("pass") * F.col("blocks") + F.col("rows_before") - F.col("rows_first")
    draws = copies.select(
        "row", "id", "key", "block", "words", "pass", F.size(F.filter("ends", lambda end: end <= place)).alias("shard"),
        F.xxhash64("id", "block", "pass", F.lit(seed + 1)).alias("place"))
    return named.select("row", "id", "source", "size", "source_size", "target"), draws


def taken(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """``rows`` with the words the mix takes of each, repeats counted."""
    sums = draws.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_times: float = MAX_TIMES,
        shards: int = SHARDS, seed: int = SEED, id_column: str = "doc_id", source_column: str = "source",
        text_column: str = "text") -> DataFrame:
    """The mixed rows themselves, whole documents as blocks: a document may appear up to ``max_times``.

    Same columns as the input. Rows are laid out shard by shard, shuffled inside each.
    """
    rows, draws = plan(documents, weights, share, max_times, None, shards, seed, id_column, source_column, text_column)
    id_, key, shard, place, own = unused(documents, "_id", "_key", "_shard", "_place", "_own")
    wanted = draws.select(F.col("id").alias(id_), F.col("key").alias(key), F.col("shard").alias(shard), F.col("place").alias(place))
    # equal rows (same id and text) are copies of one row, which all their draws repeat
    keyed = documents.withColumn(own, F.xxhash64(text_column)).dropDuplicates([id_column, own])
    joined = keyed.join(wanted, keyed[id_column].eqNullSafe(wanted[id_]) & (keyed[own] == wanted[key]))
    return joined.repartitionByRange(shard, place).sortWithinPartitions(shard, place).select(*documents.columns)
