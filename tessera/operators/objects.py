"""Objects as bytes: chunks, checksums, versions, content types, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Content types that are worth compressing, by their beginning.
COMPRESSIBLE = ("text/", "application/json", "application/xml", "application/javascript")


def chunks(objects: DataFrame, size: int, key: str = "object_id", data: str = "data") -> DataFrame:
    """key, sequence, size, checksum, data: byte slices of at most `size`; an empty or null object has none."""
    n = F.ceil(F.octet_length(data) / size).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    d = objects.select(key, F.explode(at).alias("i"), data).select(key, F.col("i").cast("long").alias("sequence"), F.substring(F.col(data), F.col("i") * size + 1, F.lit(size)).alias("data"))
    return d.select(key, "sequence", F.octet_length("data").cast("long").alias("size"), F.sha2("data", 256).alias("checksum"), "data")


def verify(chunk: DataFrame, key: str = "object_id") -> DataFrame:
    """key, intact: all chunks there, in sequence from 0, with their own checksums."""
    ok = F.min((F.sha2("data", 256) == F.col("checksum")) & (F.octet_length("data") == F.col("size")))
    return chunk.groupBy(key).agg((ok & (F.max("sequence") + 1 == F.count_distinct("sequence"))).alias("intact"))


def reassemble(chunk: DataFrame, key: str = "object_id") -> DataFrame:
    """key, data: chunks in order; an object with a hole gives null."""
    parts = F.array_sort(F.collect_list(F.struct("sequence", F.hex("data").alias("h"))))  # one object's bytes
    d = chunk.groupBy(key).agg(parts.alias("p"), (F.max("sequence") + 1 == F.count_distinct("sequence")).alias("whole"))
    return d.select(key, F.when(F.col("whole"), F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), ""))).alias("data"))


def compressible(content_type: Column) -> Column:
    hit = F.lit(False)
    for p in COMPRESSIBLE:
        hit = hit | F.lower(content_type).startswith(p)
    return F.coalesce(hit, F.lit(False))


def versions(puts: DataFrame, key: list[str], order: str) -> DataFrame:
    """puts with version (1, 2, ... in each key) and is_latest."""
    from tessera.operators.running import numbered

    d = numbered(puts, key, [order], "version").withColumn("version", F.col("version") + 1)
    top = d.groupBy(*key).agg(F.max("version").alias("__top"))
    return d.join(top, key).withColumn("is_latest", F.col("version") == F.col("__top")).drop("__top")


def identifier(kind: str, *parts: Column) -> Column:
    """node-x, group-x, g-consumer-i and the like: the kind between the parts."""
    return F.concat_ws("-", F.lit(kind), *parts) if len(parts) == 1 else F.concat_ws("-", parts[0], F.lit(kind), *parts[1:])


def canonical(fields: dict[str, Column]) -> Column:
    """One JSON text of the fields, names in order, no blanks; null is null, text is escaped by to_json."""
    one = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit(""))
    text = [F.concat(F.lit(f'"{k}":'), F.when(c.isNull(), F.lit("null")).otherwise(one(c))) for k, c in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *text), F.lit("}"))


def leaf(fields: dict[str, Column]) -> Column:
    """Hash of an audit record's canonical text."""
    return F.sha2(canonical(fields), 256)


def audit(kind: str, principal: Column, action: Column, resource: Column, result: str, at: Column, details: dict[str, Column] | None = None) -> Column:
    """An audit record (cert_issued, auth_allowed, auth_denied, ...) as a struct with its leaf hash."""
    fields = {"event_type": F.lit(kind), "principal_id": principal, "action": action, "resource_id": resource, "result": F.lit(result), "at": at, "details": canonical(details or {})}
    return F.struct(*[c.alias(k) for k, c in fields.items()], leaf(fields).alias("leaf_hash"))


def certificates(certs: DataFrame, now: Column, rotate_days: int = 7) -> DataFrame:
    """certs (cert_id, issuer_id, not_before, not_after, revoked) with state, days_left and rotate.

    revoked, pending, valid or expired at `now`; rotate: valid, and at most rotate_days are left.
    """
    state = F.when(F.col("revoked"), "revoked").when(now < F.col("not_before"), "pending").when(now <= F.col("not_after"), "valid").otherwise("expired")
    d = certs.withColumn("state", state).withColumn("days_left", F.greatest(F.datediff(F.col("not_after"), now), F.lit(0)).cast("long"))
    return d.withColumn("rotate", (F.col("state") == "valid") & (F.col("days_left") <= rotate_days))


def chains(states: DataFrame, most: int = 16) -> DataFrame:
    """cert_id, trusted: valid, and so are all issuers up to a root (issuer_id null); a loop or a missing issuer is not trusted.

    states: cert_id, issuer_id, state. One join a level of the chain, `most` levels at most.
    """
    from tessera.session import written

    base = written(states.select("cert_id", "issuer_id", (F.col("state") == "valid").alias("ok")), "certs")
    up = base.select(F.col("cert_id").alias("up"), F.col("issuer_id").alias("above"), F.col("ok").alias("up_ok"))
    at = base.select("cert_id", F.col("issuer_id").alias("next"), "ok")
    for _ in range(most):
        if at.where("ok AND next IS NOT NULL").isEmpty():
            break
        j = at.join(up, at["next"] == up["up"], "left")
        ok = F.when(F.col("next").isNull() | ~F.col("ok"), F.col("ok")).otherwise(F.coalesce("up_ok", F.lit(False)))
        at = written(j.select("cert_id", F.when(F.col("ok"), F.col("above")).alias("next"), ok.alias("ok")), "chain")
    return at.select("cert_id", (F.col("ok") & F.col("next").isNull()).alias("trusted"))
