"""Sharding: a lookup table filled by permutations, as in consistent hashing for load balancers.

The table has a prime number of slots.  Every shard has its own order of preference over the slots (an offset and
a skip taken from a hash of its name); shards take turns, each claiming its most preferred slot that is still
free, until none is left.  So shards own equal numbers of slots, to within one, and few slots change hands when
a shard comes or goes.  A document goes to the slot that its key hashes to: one look-up in a broadcast array.

The table is a function of the shard names and the prime alone; its size is a parameter, never the data's.

Edge cases: the key is the document's id; rows without an id are placed by their text, so they spread too (both
null: slot of the empty key).  Repeated rows share a shard.  An empty table gives no rows.  One shard owns all
slots.  Input columns named like the new ones (slot, shard) are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.batches import table

SHARDS = [f"shard-{i:04d}" for i in range(64)]
SLOTS = 8209


def fill(shards: list[str], slots: int) -> list[int]:
    """The owner (index of a shard) of every slot."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(shards) <= slots:
        raise ValueError("at least one shard, and a slot for each")
    number = lambda name, part: int(hashlib.md5(f"{part}:{name}".encode()).hexdigest(), 16)
    at = [number(s, "offset") % slots for s in shards]
    skip = [number(s, "skip") % (slots - 1) + 1 for s in shards]
    owner, left = [-1] * slots, slots
    while left:
        for shard in range(len(shards)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % slots
            owner[at[shard]] = shard
            left -= 1
            if not left:
                break
    return owner


def slot_of(slots: int) -> Column:
    """Slot of a row: the first 15 hex digits of its key's MD5, modulo the table's size."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % slots


def place(docs: DataFrame, shards: list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` (long) and ``shard`` (name)."""
    owners = F.split(F.lit(",".join(shards[o] for o in fill(shards, slots))), ",")
    return docs.withColumn("slot", slot_of(slots)).withColumn("shard", F.get(owners, F.col("slot").cast("int")))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "slot", "shard")


def op6_sql() -> str:
    """The table of owners is a literal; the filling itself is tested against a plain version."""
    owners = ",".join(f"'{SHARDS[o]}'" for o in fill(SHARDS, SLOTS))
    return f"""
with placed as (
  select doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'text:' || coalesce(text, ''))), 1, 15) as bigint)
         % {SLOTS} as slot from documents),
owners as (select [{owners}] as names)
select doc_id, slot, names[slot + 1] as shard from placed, owners
"""
