"""Splits that keep related records together (problem 3).

The ledger is a persisted table, kept in versions at a path of its own (``extend_stored_ledger``): ``(node, component, split, status)``, one row per record with relations, in which
``old_component`` and ``old_split`` keep what a quarantined record had before. A new batch
brings links; the components of old and new records are merged by label propagation with pointer jumping. A component
that already has a split keeps it, one without fills the split that lacks most, and one that joins components of
different splits is quarantined: it keeps its records' old splits on record but is offered to none until ``release``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkatlas.llm.components import connected_components
from inkatlas.operators.skew import lookup
from inkatlas.storage import Stored, cut

QUARANTINE = "quarantine"
#: Units above 1/LARGE of all rows are placed one by one, largest first; there are fewer than LARGE of them.
LARGE = 1000
#: Buckets of the running sum that lays the remaining units out along the deficits.
BUCKETS = 4096


def shared_key_links(records: DataFrame, node: str, keys: list[Column]) -> DataFrame:
    """Links ``(first, second)`` that connect all records which agree in one of ``keys``.

    Each record is linked to the smallest record of its key: as many links as rows, not as pairs. Null keys link nothing.
    """

    def star(key: Column) -> DataFrame:
        keyed = Stored(records.select(F.col(node).alias("first"), key.alias("_key")).where(F.col("_key").isNotNull())).df
        least = keyed.groupBy("_key").agg(F.min("first").alias("second"))
        return lookup(keyed, least, "_key", "inner").where("first <> second").select("first", "second")

    return reduce(DataFrame.unionByName, [star(k) for k in keys])


def place(units: DataFrame, targets: DataFrame, used: dict[str, float] | None = None) -> DataFrame:
    """Give each unit ``(unit, size)`` one split so that sizes approach the target shares; ``(unit, size, split)``.

    ``targets`` has one row per split: ``split_name`` and ``target_share``; ``used`` tells sizes placed earlier.
    Large units go, largest first, to the split with the largest deficit. All others are laid out in hash order along
    the remaining deficits, so each split ends within one such unit (at most 1/LARGE of all rows) of its target.
    The same units get the same splits on every run; without units the result is empty.
    """
    spark = units.sparkSession
    shares = {r["split_name"]: float(r["target_share"]) for r in targets.where("target_share > 0").collect()}  # one row per split
    if not shares:
        raise ValueError("no split has a positive share")
    names = sorted(shares, key=lambda s: (-shares[s], s))
    stored = Stored(units.select("unit", "size", F.pmod(F.xxhash64("unit"), F.lit(1 << 40)).alias("_h"))).df
    total = stored.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    used = used or {}
    whole = total + sum(used.get(s, 0) for s in names)
    deficit = {s: shares[s] / sum(shares.values()) * whole - used.get(s, 0) for s in names}
    bound = total / LARGE
    large = stored.where(F.col("size") > bound).orderBy(F.desc("size"), "unit").select("unit", "size").collect()  # fewer than LARGE
    chosen = []
    for unit, size in large:
        best = max(names, key=lambda s: (deficit[s], -names.index(s)))
        deficit[best] -= size
        chosen.append((unit, best))
    rest = stored.where(F.col("size") <= bound)
    lacking = {s: max(d, 0.0) for s, d in deficit.items()}
    if not any(lacking.values()):
        lacking = dict(shares)
    scale = sum(lacking.values())
    ends, upto = [], 0.0
    for s in names:
        upto += lacking[s] / scale
        ends.append((s, upto))
    bucket = F.floor(F.col("_h") / ((1 << 40) / BUCKETS)).cast("int")
    sums = dict(rest.groupBy(bucket.alias("b")).agg(F.sum("size").alias("s")).collect())  # at most BUCKETS rows
    before, running = [], 0
    for b in range(BUCKETS):
        before.append(running)
        running += sums.get(b, 0)
    starts = spark.createDataFrame(list(enumerate(before)), "_b int, _before bigint")
    order = Window.partitionBy("_b").orderBy("_h", "unit").rowsBetween(Window.unboundedPreceding, -1)
    at = (F.col("_before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2) / F.lit(float(max(running, 1)))
    split = F.lit(names[-1])
    for s, end in reversed(ends[:-1]):
        split = F.when(F.col("_at") <= end, F.lit(s)).otherwise(split)
    laid = rest.withColumn("_b", bucket).join(F.broadcast(starts), "_b").withColumn("_at", at).select("unit", "size", split.alias("split"))
    if not chosen:
        return laid
    single = spark.createDataFrame(chosen, f"unit {stored.schema['unit'].dataType.simpleString()}, split string")
    return laid.unionByName(stored.join(F.broadcast(single), "unit").select("unit", "size", "split"))


def extend_ledger(ledger: DataFrame | None, links: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Merge a batch into the ledger and return the new ledger, written to the shared folder.

    ``links``: ``(first, second)`` between records, old or new; ``sizes``: ``(node, size)`` of every record of the batch
    (0 or null sizes count nothing); records without a link form components of their own. Result:
    ``(node, component, size, split, status, old_component, old_split)``; status is ``kept`` (component had a split), ``new`` (it fills a deficit)
    or ``quarantined`` (it joins components of different splits; split is ``quarantine``, and stays so until released).
    The old columns are those a quarantined record had when it was last in a split, null for all others.
    A ledger of None or without rows starts afresh; an empty batch leaves the ledger as it is.
    """
    spark = sizes.sparkSession
    batch = sizes.groupBy("node").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    if ledger is None:
        ledger = spark.createDataFrame([], f"node {sizes.schema['node'].dataType.simpleString()}, component {sizes.schema['node'].dataType.simpleString()}, size bigint, split string, status string")
    for name, source in (("old_component", "component"), ("old_split", "split")):
        if name not in ledger.columns:  # a ledger written before these columns were kept
            ledger = ledger.withColumn(name, F.lit(None).cast(ledger.schema[source].dataType))
    old = Stored(ledger.select("node", "component", "size", "split", "old_component", "old_split")).df
    both = old.select("node", "component", "size", "split").unionByName(batch.select("node", F.lit(None).cast(old.schema["component"].dataType).alias("component"), F.col("size").cast("bigint").alias("size"), F.lit(None).cast("string").alias("split")))
    records = Stored(both.groupBy("node").agg(F.max("component").alias("was"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.max("split").alias("old_split"))).df
    kept_links = old.select(F.col("node").alias("first"), F.col("component").alias("second"))
    merged = connected_components(links.select("first", "second").unionByName(kept_links))
    placed = Stored(records.join(merged, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "size", "old_split")).df
    groups = Stored(
        placed.groupBy("component").agg(F.sum("size").alias("size"), F.min("old_split").alias("lo"), F.max("old_split").alias("hi"))
    ).df
    used = {r["lo"]: r["s"] for r in groups.where("lo IS NOT NULL AND lo = hi").groupBy("lo").agg(F.sum("size").alias("s")).collect()}  # one row per split
    fresh = place(groups.where("lo IS NULL").select(F.col("component").alias("unit"), "size"), targets, used)
    decided = (
        groups.where("lo IS NOT NULL")
        .select("component", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(QUARANTINE).alias("split"), F.when((F.col("lo") == F.col("hi")) & (F.col("lo") != QUARANTINE), "kept").otherwise("quarantined").alias("status"))
        .unionByName(fresh.select(F.col("unit").alias("component"), "split", F.lit("new").alias("status")))
    )
    now = lookup(placed, Stored(decided).df, "component").select("node", "component", "size", "split", "status")
    # What a record had is what it was given last, or for one quarantined earlier what was kept then.
    had_split = F.when(F.col("split") == QUARANTINE, F.col("old_split")).otherwise(F.col("split"))
    had_component = F.when(F.col("split") == QUARANTINE, F.col("old_component")).otherwise(F.col("component"))
    had = old.select("node", had_component.alias("_component"), had_split.alias("_split")).groupBy("node").agg(F.max("_component").alias("_component"), F.max("_split").alias("_split"))
    held = F.col("split") == QUARANTINE
    return cut(now.join(had, "node", "left").select("node", "component", "size", "split", "status", F.when(held, F.col("_component")).alias("old_component"), F.when(held, F.col("_split")).alias("old_split")))


_VERSION = "version={:09d}"


def ledger_versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions of the ledger kept at ``path``, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return sorted(n for n in names if n.startswith("version=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of the ledger at ``path``, None if there is none yet."""
    versions = ledger_versions(spark, path)
    return spark.read.parquet(f"{path}/{versions[-1]}") if versions else None


def store_ledger(spark: SparkSession, path: str, ledger: DataFrame) -> DataFrame:
    """Write ``ledger`` as the next version at ``path``, beside the older ones, and return it as read from there.

    A version counts once its write is committed, so a job that dies leaves the ledger as it was.
    """
    versions = ledger_versions(spark, path)
    number = int(versions[-1].partition("=")[2]) + 1 if versions else 1
    ledger.write.mode("overwrite").parquet(f"{path}/{_VERSION.format(number)}")
    return read_ledger(spark, path)


def extend_stored_ledger(path: str, links: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``extend_ledger`` of the ledger kept at ``path``: reads its newest version and writes the next one.

    ``path`` lies where its owner keeps tables; ``storage.clear`` does not touch it.
    """
    spark = sizes.sparkSession
    return store_ledger(spark, path, extend_ledger(read_ledger(spark, path), links, sizes, targets))


def release(ledger: DataFrame, components: list) -> DataFrame:
    """The ledger with the given quarantined components undone: their records get back their old component and split.

    Records that had none (they came with the wrong link) are left out; give them again in the next batch.
    """
    freed = F.col("component").isin(components) & (F.col("split") == QUARANTINE)
    kept = ledger.where(~freed | F.col("old_split").isNotNull())
    none = F.lit(None)
    changed = {"component": F.when(freed, F.col("old_component")).otherwise(F.col("component")), "split": F.when(freed, F.col("old_split")).otherwise(F.col("split")), "status": F.when(freed, "kept").otherwise(F.col("status")), "old_component": F.when(freed, none).otherwise(F.col("old_component")), "old_split": F.when(freed, none).otherwise(F.col("old_split"))}
    return cut(kept.select("node", "size", *[c.alias(n) for n, c in changed.items()]).select("node", "component", "size", "split", "status", "old_component", "old_split"))
