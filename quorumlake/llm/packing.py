"""Texts into containers of fixed capacity by sum-of-squares packing (problem 7).

A container that holds h tokens is at level h; N[h] counts the open containers at each level. A piece of size s goes where
the sum of N[h]^2 grows least: into a container at some level h <= capacity - s, or into a new one. A piece that fits
exactly closes its container. Texts longer than the capacity are cut into full containers and one rest, which is packed as
any other piece; no other text is split.

The rule is sequential, so texts are dealt into shards by a hash of their id, and each shard is packed by itself. What is
wasted are the containers left open, a fixed number for a given capacity and shard. They are then packed again, each as one
piece of its contents, in shards of their own, until one shard holds them all, so the waste doesn't grow with the shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.session import written

#: Texts per shard; a shard's ids and sizes (not the texts) are packed by one task, some MB.
SHARD = 100_000


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each piece (1 <= size <= capacity), in the order given, by the sum-of-squares rule.

    Of equally good levels the fullest is taken. `stacks` holds which containers are at each level."""
    n = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    made = 0
    for i, s in enumerate(sizes):
        s = int(s)
        room = capacity - s
        # Growth, halved: into level h it is N[h + s] - N[h] + 1; closing a container -N[room] + 1/2; a new one N[s] + 1/2.
        best, at = (n[s] + 0.5 if room else -0.5), 0
        if room:
            if n[room]:
                d = 0.5 - n[room]
                if d <= best:
                    best, at = d, room
            if room > 1:
                grow = n[s + 1 : capacity] - n[1:room] + 1
                open_ = n[1:room] > 0
                if open_.any():
                    g = np.where(open_, grow, 1 << 60)
                    k = len(g) - 1 - int(np.argmin(g[::-1]))
                    if g[k] < best or g[k] == best and not at:
                        best, at = g[k], k + 1
        if at:
            c = stacks[at].pop()
            n[at] -= 1
        else:
            c = made
            made += 1
        if at + s < capacity:
            stacks[at + s].append(c)
            n[at + s] += 1
        out[i] = c
    return out


def fill_containers(sizes: DataFrame, specs: DataFrame, *, key: str = "doc_id", shard: int = SHARD) -> DataFrame:
    """spec_id, capacity, key, piece_no, first_token, n_tokens, container: where each piece of each text lies.

    `sizes` has key and n_tokens, `specs` spec_id and capacity_tokens (a small table: one row per kind of container).
    Texts without tokens and null sizes need no container and don't come out; a null key is a key of its own. Repeated
    spec rows count once; capacities below 1 or null are left out. Pieces are numbered from 1; first_token counts from 0."""
    n = sizes.count()
    shards = max(1, -(-n // shard))
    kinds = specs.filter("capacity_tokens > 0 and spec_id is not null").groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity"))
    where = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
    pairs = sizes.filter("n_tokens > 0").select(key, "n_tokens", where.alias("shard"))
    listed = [
        F.struct(F.lit(r.spec_id).cast("int").alias("spec_id"), F.lit(r.capacity).cast("int").alias("capacity"))
        for r in kinds.collect()
    ]
    listed = F.array(*listed) if listed else F.lit(None).cast("array<struct<spec_id:int,capacity:int>>")
    each = pairs.withColumn("k", F.explode(listed)).select(key, "n_tokens", "shard", "k.spec_id", "k.capacity")
    kind = dict(sizes.dtypes)[key]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cap, spec, sh = int(pdf["capacity"].iloc[0]), int(pdf["spec_id"].iloc[0]), int(pdf["shard"].iloc[0])
        # The order of arrival: by a mix of the id's digits, the same on every run.
        order = pd.util.hash_array(pdf[key].to_numpy()).argsort(kind="stable")
        ids, size = pdf[key].to_numpy()[order], pdf["n_tokens"].to_numpy()[order]
        full, rest = size // cap, size % cap
        packed = pack(rest[rest > 0], cap)
        used = int(packed.max()) + 1 if len(packed) else 0
        whole = pd.DataFrame({key: np.repeat(ids, full), "n_tokens": cap})
        whole["piece_no"] = np.concatenate([np.arange(1, f + 1) for f in full] or [np.zeros(0, int)])
        whole["container"] = used + np.arange(len(whole))
        parts = pd.DataFrame({key: ids[rest > 0], "n_tokens": rest[rest > 0], "piece_no": full[rest > 0] + 1, "container": packed})
        out = pd.concat([whole, parts], ignore_index=True)
        out["first_token"] = (out["piece_no"] - 1) * cap
        out["spec_id"], out["capacity"] = spec, cap
        out["container"] = [f"{spec}-{sh}-{c}" for c in out["container"]]
        return out[["spec_id", "capacity", key, "piece_no", "first_token", "n_tokens", "container"]]

    shape = f"spec_id int, capacity int, {key} {kind}, piece_no int, first_token long, n_tokens int, container string"
    packed = each.groupBy("spec_id", "shard").applyInPandas(one, shape)
    return packed if shards == 1 else merge_open(written(packed, "p7-packed"), shard)


def merge_open(packed: DataFrame, shard: int = SHARD) -> DataFrame:
    """`packed` with the containers that aren't full put together: each is packed as one piece of its contents. Where more
    are open than a shard holds they are dealt into shards and what is left open then is packed again, while that saves at
    least a tenth of them."""

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("container")
        first = pdf["container"].to_numpy()
        got = pack(pdf["filled"].to_numpy(), int(pdf["capacity"].iloc[0]))
        # A new container has the name of the first that went into it.
        name = pd.Series(first).groupby(got).transform("first").to_numpy()
        return pdf[["spec_id", "container"]].assign(target=name)

    opened = packed.groupBy("spec_id", "capacity", "container").agg(F.sum("n_tokens").cast("int").alias("filled"))
    opened = written(opened.filter("filled < capacity"), "p7-open")
    moved = None
    n = opened.groupBy("spec_id").count().agg(F.max("count")).first()[0] or 0
    while n:
        shards = -(-n // shard)
        dealt = opened.withColumn("shard", F.pmod(F.xxhash64("container", F.lit(shards)), F.lit(shards)))
        step = dealt.groupBy("spec_id", "shard").applyInPandas(again, "spec_id int, container string, target string")
        step = written(step, "p7-moved")
        if moved is None:
            moved = step
        else:
            on = step.select("spec_id", F.col("container").alias("target"), F.col("target").alias("_next"))
            moved = written(moved.join(on, ["spec_id", "target"]).select("spec_id", "container", F.col("_next").alias("target")), "p7-moved")
        opened = opened.join(step, ["spec_id", "container"]).groupBy("spec_id", "capacity", F.col("target").alias("container")).agg(F.sum("filled").cast("int").alias("filled"))
        opened = written(opened, "p7-open")  # full ones stay: a piece of the whole capacity is a container by itself
        last, n = n, opened.groupBy("spec_id").count().agg(F.max("count")).first()[0]
        if shards == 1 or n > 0.9 * last:
            break
    if moved is None:
        return packed
    got = packed.join(moved, ["spec_id", "container"], "left").withColumn("container", F.coalesce("target", "container"))
    return got.select(*packed.columns)


def unused(packed: DataFrame) -> DataFrame:
    """spec_id, capacity, containers, tokens, unused_share of the whole room, and the least number of containers."""
    per = packed.groupBy("spec_id", "capacity", "container").agg(F.sum("n_tokens").alias("filled"))
    got = per.groupBy("spec_id", "capacity").agg(F.count("*").alias("containers"), F.sum("filled").alias("tokens"))
    room = F.col("containers") * F.col("capacity")
    return got.select(
        "*", (1 - F.col("tokens") / room).alias("unused_share"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers")
    )
