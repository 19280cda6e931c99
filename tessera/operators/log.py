"""Partitioned logs and consumer groups as functions over tables.

A log is a table with part, off and columns of its own; a group is a table of join, leave and heartbeat events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.running import numbered, running


def partition_of(key: Column, parts: int) -> Column:
    """Partition of a record key: the first 32 bits of its SHA-256, modulo the number of partitions. Null: partition 0."""
    return F.coalesce(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % parts, F.lit(0).cast("long"))


def record_hash(key: Column, value: Column, micros: Column) -> Column:
    """First eight hexadecimal digits of the SHA-256 over key, value and timestamp."""
    return F.substring(F.sha2(F.concat_ws("|", key.cast("string"), value.cast("string"), micros.cast("string")), 256), 1, 8)


def append(log: DataFrame | None, records: DataFrame, order: str) -> DataFrame:
    """log and the records behind it: offsets go on from each partition's end, in the given order."""
    new = numbered(records, ["part"], [order], "off")
    if log is None:
        return new
    end = log.groupBy("part").agg((F.max("off") + 1).alias("__end"))
    new = new.join(end, "part", "left").withColumn("off", F.col("off") + F.coalesce("__end", F.lit(0))).drop("__end")
    return log.unionByName(new)


def fetch(log: DataFrame, part: int, start: int, most: int) -> DataFrame:
    """At most `most` records of a partition from an offset on. Offsets have no gaps, so that this is a range filter."""
    return log.where((F.col("part") == part) & (F.col("off") >= start) & (F.col("off") < start + most))


def high_water(log: DataFrame, committed: Column) -> DataFrame:
    """log with hwm: the greatest committed offset up to each record, -1 before the first."""
    return running(log, ["part"], ["off"], F.when(committed, F.col("off")), "max", "hwm").withColumn("hwm", F.coalesce("hwm", F.lit(-1).cast("long")))


def truncate(log: DataFrame, ends: DataFrame) -> DataFrame:
    """log without records at or beyond each partition's end (part, end); partitions that ends lacks stay whole."""
    return log.join(ends, "part", "left").where(F.col("end").isNull() | (F.col("off") < F.col("end"))).drop("end")


def produced(records: DataFrame, acks: Column) -> DataFrame:
    """records with is_committed: acknowledged by the leader (1) or all replicas (-1); 0 waits for none."""
    return records.withColumn("is_committed", F.coalesce(acks != 0, F.lit(False)))


def marks(log: DataFrame, committed: Column) -> DataFrame:
    """part, log_end, hwm: one row a partition, aggregated before the shuffle."""
    return log.groupBy("part").agg((F.max("off") + 1).alias("log_end"), F.coalesce(F.max(F.when(committed, F.col("off"))), F.lit(-1).cast("long")).alias("hwm"))


def offsets(commits: DataFrame) -> DataFrame:
    """grp, part, committed: a commit never moves an offset back."""
    return commits.groupBy("grp", "part").agg(F.max("off").alias("committed"))


def lag(mark: DataFrame, committed: DataFrame) -> DataFrame:
    """grp, part, committed, hwm, lag: records up to the high-water mark that the group has not committed."""
    d = committed.join(mark.select("part", "hwm"), "part")
    return d.select("grp", "part", "committed", "hwm", F.greatest(F.col("hwm") - F.col("committed"), F.lit(0).cast("long")).alias("lag"))


def membership(events: DataFrame) -> DataFrame:
    """grp, generation, members, leader from events (grp, member, kind, at): joins of absent and leaves of present
    members each start a generation; the leader is the member that has been in longest. Empty groups are gone."""
    moves = events.where("kind IN ('join', 'leave')")
    w = Window.partitionBy("grp", "member").orderBy("at")
    effective = moves.withColumn("was", F.coalesce(F.lag("kind").over(w), F.lit("leave"))).where("kind <> was")
    last = effective.groupBy("grp", "member").agg(F.max_by("kind", "at").alias("kind"), F.max("at").alias("since"), F.count(F.lit(1)).alias("moves"))
    here = F.col("kind") == "join"
    groups = last.groupBy("grp").agg(F.sum("moves").alias("generation"), F.sum(here.cast("long")).alias("members"), F.min_by(F.when(here, F.col("member")), F.when(here, F.col("since"))).alias("leader"))
    return groups.where("members > 0")


def live(events: DataFrame, now: int, timeout: int, tie: str = "at") -> DataFrame:
    """grp, member, live: heard of (join or heartbeat) within the timeout before now; a member that left is not live."""
    d = events.where(F.col("at") <= now).groupBy("grp", "member").agg(F.max("at").alias("seen"), F.max_by("kind", F.struct("at", tie if tie != "at" else F.lit(0))).alias("last"))
    return d.select("grp", "member", ((F.col("last") != "leave") & (F.col("seen") >= now - timeout)).alias("live"))


def assign(members: DataFrame, parts: int, how: str = "range") -> DataFrame:
    """grp, member, part: partitions 0 to parts - 1 of each group's members (grp, member), in member order.

    range: runs of equal length, the first members one more; round_robin: one after the other.
    """
    m = numbered(members.select("grp", "member").distinct(), ["grp"], ["member"], "i")
    m = m.join(m.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "grp")
    size, rest = F.expr(f"{parts} div n"), F.lit(parts) % F.col("n")
    if how == "range":
        first = F.col("i") * size + F.least(F.col("i"), rest)
        count = size + (F.col("i") < rest).cast("long")
        own = F.when(count > 0, F.sequence(first, first + F.greatest(count, F.lit(1)) - 1)).otherwise(F.array().cast("array<bigint>"))
    else:
        own = F.when(F.col("i") < parts, F.sequence(F.col("i"), F.lit(parts - 1).cast("long"), F.col("n"))).otherwise(F.array().cast("array<bigint>"))
    return m.select("grp", "member", F.explode(own).alias("part"))
