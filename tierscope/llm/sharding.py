"""Balanced label propagation: linked documents move to their neighbours' shards.

Documents of a group (here: equal texts) are linked with each other. Members of a
group are interchangeable, so the state is one row per group and shard with a
count of members: at most ``n_shards`` rows a group, however large it is.

Start: a hash order deals documents to shards round robin, so counts differ by
one at most. Each round, Spark joins every group with its shards' counts to find
the shard most of its members are in (the shards, if they need several), and the
members elsewhere ask to move there. The requests are added up to an n_shards x n_shards matrix, which alone
reaches the driver. It grants what quotas allow: each shard takes in as many
documents as leave it, where documents without links may leave in exchange at no
cost. Spark then grants the requests with the largest gain first, and splits the
last one. So counts stay exactly as they were while cut links fall. Rounds go on
until one cuts no more requests than the one before it did.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tierscope.llm import common


def grant(asked: np.ndarray, loose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(moves, exchange): what of ``asked`` is granted, and the unlinked
    documents (at most ``loose`` of each shard) that move in exchange, so that
    every shard's count stays."""
    moves = asked.astype(np.int64).copy()
    np.fill_diagonal(moves, 0)
    while True:
        gain = moves.sum(0) - moves.sum(1)
        over = gain - loose
        if (over <= 0).all():
            break
        b = int(over.argmax())
        # take the excess back from those who come to b, in proportion
        come, cut = moves[:, b].copy(), int(over[b])
        less = np.minimum(come, come * cut // max(1, come.sum()))
        for a in np.argsort(-(come - less)):
            rest = cut - int(less.sum())
            if rest <= 0:
                break
            less[a] += min(rest, int(come[a] - less[a]))
        moves[:, b] -= less
    exchange = np.zeros_like(moves)
    gain = moves.sum(0) - moves.sum(1)
    give, take = np.maximum(gain, 0), np.maximum(-gain, 0)
    for a in np.flatnonzero(give):
        for b in np.flatnonzero(take):
            n = min(give[a], take[b])
            exchange[a, b], give[a], take[b] = n, give[a] - n, take[b] - n
    return moves, exchange


def propagate(cells: DataFrame, n_shards: int, rounds: int = 20) -> DataFrame:
    """Rounds over (g, shard, n): members of group g in a shard; sums to itself."""
    spark = cells.sparkSession
    cells = common.written(cells, "cells")
    sized = W.partitionBy("g")
    liked = sized.orderBy(F.col("n").desc(), F.xxhash64("g", "shard"), "shard")
    all_of = liked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    room = max(1, cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // n_shards)
    was = None
    for _ in range(rounds):
        # a group's homes: its fullest shards, as many as its members need
        state = cells.withColumns({"total": F.sum("n").over(sized), "i": F.row_number().over(liked) - 1, "at": F.collect_list(F.struct("shard", "n")).over(all_of)})
        home = F.element_at("at", (F.col("i") % F.least(F.ceil(F.col("total") / room), F.size("at"))).cast("int") + 1)
        state = state.select("g", "shard", "n", "total", home["shard"].alias("best"), home["n"].alias("most"))
        state = common.written(state, "state")
        asked, loose = np.zeros((n_shards, n_shards), np.int64), np.zeros(n_shards, np.int64)
        for a, b, alone, n in state.groupBy("shard", "best", (F.col("total") == 1).alias("alone")).agg(F.sum("n")).collect():  # n_shards² rows at most
            if alone:
                loose[a] += n
            elif a != b:
                asked[a, b] += n
        moves, exchange = grant(asked, loose)
        cut = int(asked.sum())
        if not moves.sum() or was is not None and cut >= was:
            common.forget(state)
            break
        was = cut
        listed = [(int(a), int(b), int(moves[a, b])) for a, b in zip(*np.nonzero(moves), strict=True)]
        quota = spark.createDataFrame(listed, "shard int, best int, quota long")
        linked = state.where("total > 1")
        ask = linked.where("shard <> best").join(F.broadcast(quota), ["shard", "best"])
        order = [F.col("n") - F.col("most"), F.xxhash64("g"), F.col("g")]
        queue = W.partitionBy("shard", "best").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        ask = ask.withColumn("before", F.coalesce(F.sum("n").over(queue), F.lit(0))).where("before < quota")
        ask = ask.withColumn("go", F.least(F.col("n"), F.col("quota") - F.col("before")))
        # unlinked documents in exchange: the first of each shard by a hash
        out = {a: np.cumsum(exchange[a]) for a in range(n_shards) if exchange[a].any()}
        swaps = spark.createDataFrame([(a, b, int(c[b] - exchange[a, b]), int(c[b])) for a, c in out.items() for b in np.flatnonzero(exchange[a]).tolist()], "shard int, target int, lo long, hi long")
        alone = common.ranked(state.where("total = 1").select("g", "shard"), ["shard"], ["g"], "r")
        swap = alone.join(F.broadcast(swaps), (alone["shard"] == swaps["shard"]) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))).select("g", alone["shard"], "target", F.lit(1).cast("long").alias("go"))
        moved = ask.select("g", "shard", F.col("best").alias("target"), "go").union(swap)
        deltas = moved.select("g", "shard", (-F.col("go")).alias("n")).union(moved.select("g", F.col("target").alias("shard"), F.col("go").alias("n")))
        new = cells.union(deltas.select("g", "shard", "n")).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0")
        new = common.written(new, "cells")
        common.forget(cells, state)
        cells = new
    return cells


def shard_documents(docs: DataFrame, n_shards: int = 40, rounds: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, links, cut_links for
    every row.

    Law ``rows``: the counts of any two shards differ by one at most. Links join
    equal texts; a group larger than a shard spreads over several. A null text
    has no bytes and is equal to the empty text. Repeated rows are documents of
    their own. links counts the other members of a row's group, cut_links those
    of them in other shards; half the sum of cut_links is the cut.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *common.text_hash())
    # a group's number: 64 bits of both hashes of its text
    src = src.select("doc_id", "size", "text_crc32", F.xxhash64("t1", "t2").alias("g"), F.monotonically_increasing_id().alias("uid"))
    src = common.written(src, "sharding")
    # hash order within parts that are as many as the shuffle is wide, dealt in turn
    n = common.salts(docs)
    h = F.xxhash64("uid", F.lit(11))
    part = F.pmod(h, F.lit(n)).cast("int")
    per = common.written(src.groupBy(part.alias("p")).agg(F.count("*").alias("c")), "parts")
    before = W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))  # n rows
    dealt = src.select("uid", "g", part.alias("p"), h.alias("h")).withColumn("r", F.row_number().over(W.partitionBy("p").orderBy("h", "uid")) - 1)
    dealt = dealt.join(F.broadcast(per), "p").select("uid", "g", ((F.col("r") + F.col("base")) % n_shards).cast("int").alias("shard"))
    cells = propagate(dealt.groupBy("g", "shard").agg(F.count("*").alias("n")), n_shards, rounds)
    # members of a group take its shards' places in turn; (group, salt) keeps hot groups apart
    spans = cells.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("cells"))
    ranked = common.ranked(src.select("uid", "g"), ["g"], ["uid"], "r")
    salted = ranked.withColumn("s", F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int"))
    parts = salted.groupBy("g", "s").agg(F.count("*").alias("_")).drop("_").join(spans, "g")
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("int").alias("shard"))

    def step(acc, c):
        end = acc["at"] + c["n"]
        here = (F.col("r") >= acc["at"]) & (F.col("r") < end)
        return F.struct(end.alias("at"), F.when(here, c["shard"]).otherwise(acc["shard"]).alias("shard"))

    placed = salted.join(parts, ["g", "s"]).select("uid", "cells", F.aggregate("cells", first, step, lambda a: a["shard"]).alias("shard"))
    members = lambda keep: F.aggregate(F.filter("cells", keep), F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
    placed = placed.select("uid", "shard", (members(lambda c: F.lit(True)) - 1).alias("links"), members(lambda c: c["shard"] != F.col("shard")).alias("cut_links"))
    placed = common.ranked(common.written(placed, "placed"), ["shard"], ["uid"], "slot")
    return src.join(placed, "uid").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "links", "cut_links")
