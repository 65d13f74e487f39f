"""Placement of rows on shards through a permutation-filled lookup table.

Every shard has a preference order of the slots of a prime-sized table, given by an offset and a
skip; the shards take turns claiming their next free slot until the table is full. A row goes to
the shard of slot ``hash(key) mod size``: constant time, within one slot per shard of even, and
few rows move when a shard joins or leaves. The table has ``size`` entries whatever the rows are,
so it is broadcast; placing is a map-side join without a shuffle.

Defined results: a null key hashes like the empty string; repeated rows go to the same shard; an
empty table gives an empty table; columns named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOTS = 2053
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[str]:
    """The shard of every slot. ``slots`` is prime and at least the number of shards."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} slots: the number must be prime")
    if not 1 <= len(set(shards)) == len(shards) <= slots:
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    offsets = [_number(f"{name}/offset") % slots for name in shards]
    skips = [_number(f"{name}/skip") % (slots - 1) + 1 for name in shards]
    upcoming = [0] * len(shards)
    owner: list[str | None] = [None] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while owner[slot := (offsets[i] + upcoming[i] * skips[i]) % slots] is not None:
            upcoming[i] += 1
        owner[slot] = shards[i]
        upcoming[i] += 1
    return owner  # type: ignore[return-value]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: eight hex digits of the MD5 of its text, modulo the size of the table."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    rows = ", ".join(f"({slot}, '{name}')" for slot, name in enumerate(lookup_table(shards, slots)))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(slot, shard)")


def place(rows: DataFrame, key_column: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Every row with ``slot`` and ``shard``."""
    table = table_frame(rows.sparkSession, shards, slots)
    own = rows.drop("slot", "shard")
    # ``slots`` rows, whatever the input
    return own.withColumn("slot", slot_of(F.col(key_column), slots)).join(F.broadcast(table), "slot").select(
        *own.columns, "slot", "shard")


def moved(before: Sequence[str], after: Sequence[str], slots: int = SLOTS) -> float:
    """Share of slots whose shard differs between two lists of shards, but for those that must move."""
    old, new = lookup_table(before, slots), lookup_table(after, slots)
    return sum(a != b and a in after for a, b in zip(old, new, strict=True)) / slots
