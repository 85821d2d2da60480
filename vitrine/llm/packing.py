"""Items packed into containers of fixed capacity: vector bin packing by the dot-product rule.

A container has limits on tokens, on segments and on loss-bearing tokens, all columns of the
limits. The container in hand takes the item that fits and whose demand has the largest dot
product with what is left of the limits, until none fits. Two weightings are tried on a part
of a block and the one with fewer containers packs it: the plain product, which prefers large items, and the
product of directions with each limit weighted by the demand that still waits for it, which
saves scarce room and mixes large items with small ones. Items come in blocks of bounded
size, spread by hash, so each block is packed in one task; a block leaves one container
part-filled, which the hundreds of containers of a block make a small share.

limits_for proposes segment and loss limits where the input has none: what a container of
average items needs, with some slack, so that each of the three binds where items are
uneven. Its averages are taken over all items.

Defined results: an item beyond the token capacity is cut into full containers and a rest
that is packed like any item, each part with the loss-bearing tokens that lie in it; an item
that fits is never cut; items without tokens are left out; an item that breaks another limit
on its own has a container to itself; repeated rows are items of
their own only if their ids differ; an empty table gives no rows; a null limit is no limit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.session import checkpointed

#: Containers that a block should fill, and bounds of its number of items: they bound a task's memory and the share of part-filled containers.
BLOCK_CONTAINERS, LEAST_ITEMS, MOST_ITEMS = 150, 600, 8_000
#: Items of a block on which the two weightings are compared; the better one packs the whole block.
TRIED = 400
#: Slack of the proposed segment and loss limits over what average items need.
SEGMENT_SLACK, LOSS_SLACK = 1.3, 1.15


def dot_product_pack(demand: np.ndarray, limits: np.ndarray, weighted: bool | None = None) -> np.ndarray:
    """The container number of each item; demand: items x limits. Equal items are handled as one kind. weighted: None takes the weighting that does better on the first TRIED items."""
    if weighted is None:
        tried = demand[:TRIED]
        both = [dot_product_pack(tried, limits, w) for w in (False, True)]
        better = int(both[0].max(initial=-1) + 1 > 0.98 * (both[1].max(initial=-1) + 1))
        return both[better] if len(tried) == len(demand) else dot_product_pack(demand, limits, bool(better))
    kinds, kind_of, left = np.unique(demand, axis=0, return_inverse=True, return_counts=True)
    kind_of = kind_of.reshape(-1)
    share = np.ascontiguousarray((kinds / limits).T)
    length = np.sqrt((share**2).sum(axis=0))
    waiting = (share * left).sum(axis=1)
    # items of a kind, in the order in which they will be handed out
    order = np.argsort(kind_of, kind="stable")
    next_of = np.concatenate([[0], np.cumsum(left)[:-1]])
    out, container = np.full(len(demand), -1, dtype=np.int64), 0

    def place(kind: int) -> None:
        out[order[next_of[kind]]] = container
        next_of[kind] += 1
        left[kind] -= 1

    alive, part = np.arange(len(kinds)), share
    while len(alive):
        room = np.ones(len(limits))
        open_to, fitting = alive, part
        while True:
            # room only shrinks, so what doesn't fit now never will
            fits = (fitting <= (room + 1e-9)[:, None]).all(axis=0)
            if not fits.all():
                open_to, fitting = open_to[fits], fitting[:, fits]
            if not len(open_to):
                break
            at = int(np.argmax((room * waiting) @ fitting / length[open_to] if weighted else room @ fitting))
            kind = open_to[at]
            place(kind)
            room, waiting = room - share[:, kind], waiting - share[:, kind]
            if not left[kind]:
                stay = np.ones(len(open_to), dtype=bool)
                stay[at] = False
                open_to, fitting = open_to[stay], fitting[:, stay]
        if room.min() == 1.0:  # nothing fits an empty container: the largest breaks a limit on its own
            place(alive[np.argmax(part.max(axis=0))])
        container += 1
        stay = left[alive] > 0
        if not stay.all():
            alive, part = alive[stay], part[:, stay]
    return out


def limits_for(sized: DataFrame, limits: DataFrame, segment_slack: float = SEGMENT_SLACK, loss_slack: float = LOSS_SLACK) -> DataFrame:
    """(limit_name, capacity_tokens, max_segments, max_loss): limits for the capacities given, from the averages of all items."""
    cap = F.col("capacity_tokens")
    # an item counts as the parts that its capacity cuts it into; a row a capacity comes out
    per = sized.filter("n_tokens > 0").crossJoin(F.broadcast(limits.select("limit_name", "capacity_tokens"))).groupBy("limit_name", "capacity_tokens").agg(
        F.sum("n_tokens").alias("tokens"), F.sum("n_loss").alias("loss"), F.sum(F.ceil(F.col("n_tokens") / cap)).alias("parts")
    )
    return per.select("limit_name", "capacity_tokens", F.ceil(segment_slack * cap * F.col("parts") / F.col("tokens")).cast("int").alias("max_segments"), F.least(cap, F.ceil(loss_slack * cap * F.col("loss") / F.col("tokens"))).cast("int").alias("max_loss"))


def _literal(limits: DataFrame):
    """The limits as one literal array: a fixed table of a few rows, whose number is checked."""
    have = set(limits.columns)
    rows = limits.select("limit_name", "capacity_tokens", *[F.col(c) if c in have else F.lit(None).cast("int").alias(c) for c in ("max_segments", "max_loss")]).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 limits: pack them in several calls")
    whole = lambda v: F.lit(None if v is None else int(v)).cast("long")
    made = [F.struct(F.lit(r[0]).alias("limit_name"), whole(r[1]).alias("cap"), whole(r[2]).alias("segments"), whole(r[3]).alias("loss")) for r in rows if r[1] is not None and r[1] > 0]
    return F.array(*made) if made else F.array().cast("array<struct<limit_name:string,cap:bigint,segments:bigint,loss:bigint>>")


def pack(sized: DataFrame, item: str, limits: DataFrame) -> DataFrame:
    """(limit_name, container_id, item, part_no, start_token, n_tokens, n_loss).

    sized: item, n_tokens, n_loss and, if there, loss_spans (without it the loss-bearing tokens are
    an item's last ones); limits: limit_name, capacity_tokens, max_segments, max_loss.
    """
    spans = F.col("loss_spans") if "loss_spans" in sized.columns else F.array(F.struct((F.col("n_tokens") - F.col("n_loss")).alias("a"), F.col("n_tokens").alias("b")))
    items = checkpointed(sized.filter("n_tokens > 0").select(F.col(item).alias("item"), F.col("n_tokens").cast("long").alias("size"), spans.alias("spans")))
    n, tokens = items.agg(F.count(F.lit(1)), F.sum("size")).first()
    both = items.select("item", "size", "spans", F.explode(_literal(limits)).alias("_l")).select("item", "size", "spans", "_l.*")
    # full containers of oversized items, then the rest
    cut = both.select("*", F.explode(F.expr("sequence(0L, (size - 1) div cap)")).alias("part_no")).withColumn("start_token", F.col("part_no") * F.col("cap"))
    cut = cut.withColumn("n_tokens", F.least(F.col("cap"), F.col("size") - F.col("start_token")))
    end = F.col("start_token") + F.col("n_tokens")
    inside = lambda s: F.greatest(F.lit(0).cast("long"), F.least(s["b"], end) - F.greatest(s["a"], F.col("start_token")))
    cut = cut.withColumn("n_loss", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + inside(s))).drop("spans", "size")
    out = ["limit_name", "container_id", "item", "part_no", "start_token", "n_tokens", "n_loss"]
    whole = cut.filter("n_tokens = cap").withColumn("container_id", F.concat_ws("-", F.lit("full"), "item", "part_no")).select(*out)
    # a block's items: enough for BLOCK_CONTAINERS containers of average items
    per_block = F.greatest(F.lit(LEAST_ITEMS), F.least(F.lit(MOST_ITEMS), F.ceil(BLOCK_CONTAINERS * F.col("cap") / F.lit(max((tokens or 0) / max(n, 1), 1.0)))))
    rest = cut.filter("n_tokens < cap").withColumn("block", F.pmod(F.xxhash64("item", "part_no"), F.ceil(F.lit(n) / per_block)))
    kind = sized.schema[item].dataType.simpleString()

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "part_no"])
        first = pdf.iloc[0]
        none = np.inf
        limit = np.array([first["cap"], none if pd.isna(first["segments"]) else max(1, first["segments"]), none if pd.isna(first["loss"]) else max(1, first["loss"])], dtype=float)
        demand = np.column_stack([pdf["n_tokens"], np.ones(len(pdf)), pdf["n_loss"]]).astype(float)
        at = dot_product_pack(demand, limit)
        return pdf.assign(container_id=[f"{first['block']}-{c}" for c in at])[out]

    packed = rest.groupBy("limit_name", "block").applyInPandas(place, f"limit_name string, container_id string, item {kind}, part_no long, start_token long, n_tokens long, n_loss long")
    return whole.unionByName(packed)


def report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: containers, tokens, the shares used of each of the three limits, in how many containers each one binds (less is left than an average segment takes), and items cut."""
    boxes = packed.groupBy("limit_name", "container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("segments"), F.sum("n_loss").alias("loss"), F.max("part_no").alias("part"))
    means = boxes.groupBy("limit_name").agg((F.sum("used") / F.sum("segments")).alias("_size"), (F.sum("loss") / F.sum("segments")).alias("_loss"))
    small = limits.select("limit_name", "capacity_tokens", "max_segments", "max_loss").join(means, "limit_name")  # a row a limit
    b = boxes.join(F.broadcast(small), "limit_name")
    full = lambda used, limit, typical: F.count_if(F.col(used) > F.col(limit) - typical)
    per = b.groupBy("limit_name", "capacity_tokens", "max_segments", "max_loss").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("most_tokens"), F.max("segments").alias("most_segments"), F.max("loss").alias("most_loss"),
        F.sum("segments").alias("_segments"), F.sum("loss").alias("_loss"), F.count_if(F.col("part") > 0).alias("n_with_cut_items"),
        full("used", "capacity_tokens", F.col("_size")).alias("n_token_full"), full("segments", "max_segments", F.lit(1)).alias("n_segment_full"), full("loss", "max_loss", b["_loss"]).alias("n_loss_full"),
    )
    share = lambda used, limit: F.col(used) / (F.col("n_containers") * F.col(limit))
    return per.withColumns({"fill_share": share("n_tokens", "capacity_tokens"), "segment_share": share("_segments", "max_segments"), "loss_share": share("_loss", "max_loss")}).drop("_segments", "_loss")
