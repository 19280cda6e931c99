"""Sequential placement and state machines: each depends on its earlier decisions, so a key is one ordered group."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship, written


def first_fit_decreasing(jobs: DataFrame, nodes: DataFrame, pool: str = "pool") -> DataFrame:
    """job_id, node_id (null: no node fits): in each pool the largest job first, on the first node with room."""

    def run(key, js: pd.DataFrame, ns: pd.DataFrame) -> pd.DataFrame:
        ns = ns.sort_values("node_id")
        free = [[n.node_id, n.cpu, n.memory] for n in ns.itertuples()]
        out = []
        for j in js.sort_values(["memory", "job_id"], ascending=[False, True]).itertuples():
            spot = next((n for n in free if n[1] >= j.cpu and n[2] >= j.memory), None)
            if spot:
                spot[1] -= j.cpu
                spot[2] -= j.memory
            out.append((j.job_id, spot[0] if spot else None))
        return pd.DataFrame(out, columns=["job_id", "node_id"])

    ship(jobs.sparkSession)
    return jobs.groupBy(pool).cogroup(nodes.groupBy(pool)).applyInPandas(run, "job_id long, node_id long")


def gang(jobs: DataFrame, devices: DataFrame, pool: str = "pool") -> DataFrame:
    """job_id, gpu_ids: in each pool, in order, all on one NUMA node that has enough free healthy devices, else over
    several where cross_numa allows; the first job that cannot be placed holds those behind it."""

    def run(key, js: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        free = {n: sorted(g["gpu_id"]) for n, g in ds[ds["healthy"]].groupby("numa")}
        out, held = [], False
        for j in js.sort_values("job_id").itertuples():
            got = None
            if not held:
                home = next((n for n in sorted(free) if len(free[n]) >= j.gpus), None)
                if home is not None:
                    got, free[home] = free[home][: j.gpus], free[home][j.gpus :]
                elif j.cross_numa and sum(map(len, free.values())) >= j.gpus:
                    got = []
                    for n in sorted(free):
                        take = j.gpus - len(got)
                        got, free[n] = got + free[n][:take], free[n][take:]
                held = got is None
            out.append((j.job_id, got))
        return pd.DataFrame(out, columns=["job_id", "gpu_ids"])

    ship(jobs.sparkSession)
    return jobs.groupBy(pool).cogroup(devices.groupBy(pool)).applyInPandas(run, "job_id long, gpu_ids array<long>")


def _in_turn(df: DataFrame, key: str, order: list[str], start, step, to: str, kind: str) -> DataFrame:
    """df with `to`: what step(state, row) gives for each row of a key in turn, the state going on from row to row.

    Each row depends on decisions about earlier ones, so a key stays in one task; rows are streamed through it in sorted
    batches, and one state is held, never the rows of a key. A null key is a key of its own.
    """

    def run(batches):
        last, state = object(), None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                k = getattr(r, key)
                k = None if k != k else k
                if k != last:
                    last, state = k, start
                state, got = step(state, r)
                out.append(got)
            yield b.assign(**{to: out})

    ship(df.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"{fields}, `{to}` {kind}")


def cooldown(events: DataFrame, key: str, micros: str, pause_micros: int) -> DataFrame:
    """events with fired: an event fires if the last one that fired for its key is at least the pause before it."""

    def step(last, r):
        t = getattr(r, micros)
        go = last is None or t - last >= pause_micros
        return (t if go else last), go

    return _in_turn(events, key, [micros, "event_id"], None, step, "fired", "boolean")


def segments(records: DataFrame, cap: int) -> DataFrame:
    """records (part, off, size_bytes) with segment_id: a segment closes when its bytes reach cap; the next starts at 0."""

    def step(state, r):
        seg, used = state[0], state[1] + r.size_bytes
        return ((seg + 1, 0) if used >= cap else (seg, used)), seg

    return _in_turn(records.select("part", "off", "size_bytes"), "part", ["off"], (0, 0), step, "segment_id", "long")


def erasure(shards: DataFrame) -> DataFrame:
    """object_id, data from shards (object_id, shard, is_parity, size, data): XOR parity restores one lost data shard.

    size is the object's length; more lost shards give null, never wrong bytes.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        data = {r.shard: r.data for r in p.itertuples() if not r.is_parity}
        parity = next((r.data for r in p.itertuples() if r.is_parity and r.data is not None), None)
        lost = [k for k, v in data.items() if v is None]
        if len(lost) == 1 and parity is not None:
            x = int.from_bytes(parity, "big")
            for v in data.values():
                if v is not None:
                    x ^= int.from_bytes(v, "big")
            data[lost[0]] = x.to_bytes(len(parity), "big")
            lost = []
        out = None if lost else b"".join(data[k] for k in sorted(data))[: int(p["size"].iloc[0])]
        return pd.DataFrame({"object_id": [p["object_id"].iloc[0]], "data": [out]})

    ship(shards.sparkSession)
    return shards.groupBy("object_id").applyInPandas(run, "object_id long, data binary")


def erasure_encode(objects: DataFrame, parts: int = 4, parity: int = 2) -> DataFrame:
    """objects (object_id, data) as equal data shards, null-padded, and parity copies of their XOR."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                d = bytes(r.data)
                n = max(1, -(-len(d) // parts))
                cut = [d[i * n : (i + 1) * n].ljust(n, b"\0") for i in range(parts)]
                x = 0
                for c in cut:
                    x ^= int.from_bytes(c, "big")
                out += [(r.object_id, i, False, len(d), c) for i, c in enumerate(cut)]
                out += [(r.object_id, parts + i, True, len(d), x.to_bytes(n, "big")) for i in range(parity)]
            yield pd.DataFrame(out, columns=["object_id", "shard", "is_parity", "size", "data"])

    ship(objects.sparkSession)
    return objects.select("object_id", "data").mapInPandas(run, "object_id long, shard int, is_parity boolean, size long, data binary")


#: Levels of a hash tree that one task folds: blocks of 2^FOLD leaves.
FOLD = 10


def _fold(leaves: DataFrame, levels: int) -> DataFrame:
    """idx, tree, n: each block of 2^levels consecutive nodes as its levels, nodes end to end, root last.

    A block has at most 2^levels nodes, so it is bounded; the last block is as high as the others, its unpaired nodes
    paired with themselves.
    """
    size = 1 << levels

    def run(p: pd.DataFrame) -> pd.DataFrame:
        nodes = p.sort_values("idx")["h"].tolist()
        n, tree = len(nodes), list(nodes)
        for _ in range(levels):
            nodes = [hashlib.sha256((nodes[i] + nodes[min(i + 1, len(nodes) - 1)]).encode()).hexdigest() for i in range(0, len(nodes), 2)]
            tree += nodes
        return pd.DataFrame([(int(p["b"].iloc[0]), tree, n)], columns=["idx", "tree", "n"])

    ship(leaves.sparkSession)
    return leaves.select("idx", "h", F.expr(f"idx div {size}").alias("b")).groupBy("b").applyInPandas(lambda p: run(p), "idx long, tree array<string>, n int")


def _heights(n: int) -> list[int]:
    """Levels to fold at each step, from n nodes to one."""
    out = []
    while n > 1:
        levels = min(FOLD, (n - 1).bit_length())
        out.append(levels)
        n = -(-n // (1 << levels))
    return out


def merkle_root(leaves: DataFrame) -> DataFrame:
    """h: the root of the hash tree over (idx, h), idx from 0 without gaps; one shuffle for each FOLD levels."""
    at = leaves.select("idx", "h")
    for levels in _heights(leaves.count()):
        at = _fold(at, levels).select("idx", F.element_at("tree", -1).alias("h"))
    return at.select("h")


def merkle_check(leaves: DataFrame, root: DataFrame | None = None, claims: DataFrame | None = None) -> DataFrame:
    """idx, ok: every leaf's proof followed to the root (h; the tree's own if none is given), within blocks.

    claims (idx, h): these are checked instead of the leaves themselves, each index once; one beyond the tree gives no row.

    Siblings of a leaf lie in its block, so that a step follows FOLD levels in one task; a block's own root is then a
    leaf of the next step, and its answer holds for the whole block.
    """
    steps, at = _heights(leaves.count()), leaves.select("idx", "h")
    found = []
    for levels in steps:
        trees = written(_fold(at, levels), "merkle")
        found.append((levels, trees))
        at = trees.select("idx", F.element_at("tree", -1).alias("h"))
    top = at.select(F.col("h").alias("root")) if root is None else root.select(F.col("h").alias("root"))
    good = at.join(F.broadcast(top)).select("idx", (F.col("h") == F.col("root")).alias("ok"))  # one row

    def follow(levels: int):
        def run(batches):
            for b in batches:
                for t in b.itertuples():
                    tree, n = list(t.tree), t.n
                    said = enumerate(tree[:n]) if t.said is None else ((int(x["i"]) % (1 << levels), x["h"]) for x in t.said)
                    out = []
                    for i, h in said:
                        pos, base, width = i, 0, n
                        for _ in range(levels):
                            mate = tree[base + min(pos ^ 1, width - 1)]
                            h = hashlib.sha256((mate + h if pos & 1 else h + mate).encode()).hexdigest()
                            base, width, pos = base + width, -(-width // 2), pos // 2
                        out.append((t.idx * (1 << levels) + i, bool(t.ok) and h == tree[-1]))
                    yield pd.DataFrame(out, columns=["idx", "ok"])

        return run

    ship(leaves.sparkSession)
    none = F.lit(None).cast("array<struct<i: bigint, h: string>>")
    for k, (levels, trees) in reversed(list(enumerate(found))):
        asked = trees.join(good, "idx")
        if k == 0 and claims is not None:
            once = claims.groupBy("idx").agg(F.min("h").alias("h")).select(F.expr(f"idx div {1 << levels}").alias("idx"), F.struct(F.col("idx").cast("long").alias("i"), "h").alias("c"))
            asked = asked.join(once.groupBy("idx").agg(F.collect_list("c").alias("said")), "idx")  # at most a block's leaves
        else:
            asked = asked.withColumn("said", none)
        good = asked.mapInPandas(follow(levels), "idx long, ok boolean")
    return good


def merkle_levels(leaves: DataFrame) -> list[DataFrame]:
    """Levels of the hash tree over (idx, h), leaves first; an unpaired last node is paired with itself.

    idx counts from 0 without gaps. Every sixth level is written, so that plans stay short.
    """
    out = [leaves]
    n = leaves.count()
    while n > 1:
        pair = out[-1].groupBy(F.expr("idx div 2").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "h"))).alias("p"))
        out.append(pair.select("idx", F.sha2(F.concat(F.col("p")[0]["h"], F.when(F.size("p") > 1, F.element_at("p", -1)["h"]).otherwise(F.col("p")[0]["h"])), 256).alias("h")))
        if len(out) % 6 == 0:
            out.append(written(out.pop(), "merkle"))
        n = (n + 1) // 2
    return out


def merkle_proof(leaves: DataFrame, idx: int) -> list[tuple[str, bool]]:
    """Siblings of a leaf upward, and whether each stands to the left; an unpaired node is its own sibling."""
    out = []
    for level in merkle_levels(leaves)[:-1]:
        got = {r.idx: r.h for r in level.where(F.col("idx").isin(idx, idx ^ 1)).collect()}
        out.append((got.get(idx ^ 1, got[idx]), bool(idx & 1)))
        idx //= 2
    return out


def merkle_verify(leaf: str, proof: list[tuple[str, bool]], root: str) -> bool:
    import hashlib

    for h, left in proof:
        leaf = hashlib.sha256((h + leaf if left else leaf + h).encode()).hexdigest()
    return leaf == root
