"""Column functions that place a row: shard of an id, bucket of a term, and the parsing of routing entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SHARDS = 256


def shard_of(doc_id: Column, n_shards: int) -> Column:
    """First byte of the MD5 digest modulo ``n_shards``; everything is shard 0 when unsharded."""
    if not 0 <= n_shards <= MAX_SHARDS:
        raise ValueError("one digest byte can tell at most 256 shards apart")
    if n_shards == 0:
        return F.lit(0)
    return F.conv(F.substring(F.md5(doc_id), 1, 2), 16, 10).cast("int") % F.lit(n_shards)


def bucket_of(term: Column, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(n_buckets)).cast("int")


def slot_of(doc_id: Column, n_slots: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(n_slots)).cast("int")


def slice_number(doc_id: Column, shard: Column, per_shard: int) -> Column:
    """Slices cut shards by a hash of the id: slice ``shard * per_shard + k``."""
    return shard * F.lit(per_shard) + F.pmod(F.xxhash64(F.lit("slice"), doc_id), F.lit(per_shard)).cast("int")


def int_list(value: Column) -> Column:
    """``"0, 1,x"`` to ``[0, 1]``: split on commas, trim, ignore what is no integer."""
    # The pattern keeps out what SQL would cast but a plain integer parser would not, such as "1.0".
    parsed = F.transform(
        F.split(value, ","), lambda x: F.when(F.trim(x).rlike(r"^[+-]?[0-9]+$"), F.trim(x).try_cast("int"))
    )
    return F.filter(parsed, lambda x: x.isNotNull())


def path_parts(key: Column, prefix: str) -> Column:
    """The parts of a key below ``prefix``."""
    return F.split(F.substring(key, len(prefix) + 1, 1 << 30), "/")
