"""Ids and keys of nodes, as expressions that stay in the JVM.

A key names a node; its id is a 52-bit hash of the key's UTF-8 bytes. 64-bit products are put together from 32-bit
halves, so that nothing overflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FNV-1a, 64 bits, in halves; ids keep 52 bits.
_BASIS_HIGH, _BASIS_LOW = 0xCBF29CE4, 0x84222325
_PRIME_HIGH, _PRIME_LOW = 0x100, 0x1B3
_HALF = (1 << 32) - 1
ID_BITS = 52


def hash_id(key: Column) -> Column:
    """A non-negative id of 52 bits; null for null."""
    hexes = F.hex(F.encode(key, "UTF-8"))
    bytes_ = F.when(F.length(key) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.length(hexes) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.conv(F.substring(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))
    )
    start = F.struct(F.lit(_BASIS_HIGH).cast("bigint").alias("h"), F.lit(_BASIS_LOW).cast("bigint").alias("l"))

    def step(a: Column, byte: Column) -> Column:
        low = a["l"].bitwiseXOR(byte)
        product = low * F.lit(_PRIME_LOW)
        high = a["h"] * F.lit(_PRIME_LOW) + low * F.lit(_PRIME_HIGH) + F.shiftright(product, 32)
        return F.struct(high.bitwiseAND(F.lit(_HALF)).alias("h"), product.bitwiseAND(F.lit(_HALF)).alias("l"))

    def fold(a: Column) -> Column:
        # the top 12 bits are folded down onto the lowest
        low = a["l"].bitwiseXOR(F.shiftright(a["h"], ID_BITS - 32))
        return F.shiftleft(a["h"].bitwiseAND(F.lit((1 << (ID_BITS - 32)) - 1)), 32).bitwiseOR(low)

    return F.when(key.isNotNull(), F.aggregate(bytes_, start, step, fold))


def node_key(repo: Column | str, kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(repo) if isinstance(repo, str) else repo, F.lit(f"|{kind}:"), F.concat_ws("#", *parts))


def repo_of(key: Column) -> Column:
    """What stands before a key's first bar; empty if it has none."""
    return F.when(F.contains(key, F.lit("|")), F.substring_index(key, "|", 1)).otherwise(F.when(key.isNotNull(), F.lit("")))


def repo_id(root: Column) -> Column:
    """A short id of a checkout: the id of its lower-cased path, in base 36."""
    path = F.lower(F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), "/$", ""))
    return F.lower(F.conv(hash_id(path).cast("string"), 10, 36))


def collisions(keys: DataFrame, key: str = "key") -> DataFrame:
    """(id, keys): ids that more than one key has."""
    found = keys.select(F.col(key).alias("key")).where("key is not null").distinct().withColumn("id", hash_id(F.col("key")))
    return found.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "keys")


def checked_ids(keys: DataFrame, key: str = "key") -> DataFrame:
    """`keys` with their ids in `id`; the query fails if two different keys have one id."""
    ids = keys.select(F.col(key).alias("_key")).distinct().withColumn("id", hash_id(F.col("_key")))
    unique = ids.groupBy("id").agg(F.min("_key").alias("_key"), F.max("_key").alias("_other"))
    apart = F.when(F.col("_key").eqNullSafe(F.col("_other")), F.col("id"))
    checked = unique.select("_key", F.coalesce(apart, F.raise_error(F.concat(F.lit("id collision: "), "_key", F.lit(" and "), "_other"))).alias("id"))
    return keys.join(checked, F.col(key) == F.col("_key")).drop("_key")
