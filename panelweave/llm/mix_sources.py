"""Mixing sources to target weights: exact block quotas, dealt to output shards by a splitting tree."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.sources import stage

#: Weights of the sources in order, repeated as often as needed.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the input, and how often a source may be used up.
SHARE, REPEATS = 1.5, 2
#: Words of a block and of an output shard, on average.
BLOCK_WORDS, SHARD_WORDS = 50_000, 5_000_000
SEED = 17
#: Rounds in which documents are fitted into what a source still lacks.
FILLINGS = 3
#: A source is drawn again if it is off by more than this share of its target and by more than so many mean documents.
OFF_SHARE, OFF_DOCS = 0.01, 2
#: Orders of the large documents that are tried for a source that is drawn again.
ORDERS = 200


def _number(*columns) -> Column:
    """A number from 0 to 2^32 - 1 that MD5 gives for the columns; a missing one counts as ``~``."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) if isinstance(c, str) else c for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, repeats: int) -> DataFrame:
    """``target`` for every ``source`` of a table of their ``words``.

    All sources fill at the pace of their weights until some are full. They fill up in order of
    what they hold per weight, so running sums in that order give the pace of the ones left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    )
    known = sizes.select("source", "words", weight.alias("weight"))
    order = Window.orderBy(F.col("words") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum(F.col("words") * repeats).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("words").over(Window.partitionBy())
    paced = known.withColumn("pace", (F.lit(share) * whole - full) / left)
    fits = F.col("pace") <= F.col("words") * repeats / F.col("weight")
    pace = F.coalesce(F.min(F.when(fits, F.struct(F.col("words") / F.col("weight"), "pace"))).over(Window.partitionBy())["pace"], F.lit(float("inf")))
    return paced.select("source", "words", F.least((F.col("words") * repeats).cast("double"), pace * F.col("weight")).alias("target"))


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """How many of each source's blocks every shard gets: rows are shards, columns sources.

    A node halves its shards and draws the left half's blocks from its own without putting back
    (multivariate hypergeometric), so every source's quota is met exactly and every shard's size too.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    nodes = [(0, shards, quotas.astype(np.int64))]
    while nodes:
        low, high, pool = nodes.pop()
        if high - low == 1:
            out[low] = pool
            continue
        middle = (low + high) // 2
        total = int(pool.sum())
        draws = total * (middle - low) // (high - low)
        generator = np.random.Generator(np.random.PCG64([seed, low, high]))
        left = generator.multivariate_hypergeometric(pool, draws, method="marginals")
        nodes += [(low, middle, left), (middle, high, pool - left)]
    return out


def mix_plan(
    docs: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
    row: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: its ``size`` in words, its source's ``source_size`` and ``target``,
    how often it is taken (``copies``) and how many words that makes (``taken``).

    A source whose target is several times its size is taken that often as a whole. For the rest
    its blocks are drawn in an order that only the seed decides, until the next one is too large;
    of that one documents that fit follow in such an order, and at last the one that comes
    closest to the target. A source that is then off by over 1 percent and two mean documents is
    drawn again, its large documents first. Blocks depend on ids alone, so reruns agree; rows with one id and size share a block.

    ``row`` names a column that numbers the rows; without it they are numbered here.

    A missing text has no words; rows without words are never taken. Missing sources are one
    source, the last. An empty table gives an empty result.
    """
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = stage(
        docs.select(
            (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
            F.col(doc).alias("doc"),
            F.col(source).alias("source"),
            words.alias("size"),
        ),
        "sizes",
    )
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("words")), weights, share, repeats)
    goals = goals.withColumns(
        {
            "whole": F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("long"),
            "blocks": F.greatest(F.lit(1), F.ceil(F.col("words") / block_words)).cast("long"),
        }
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("words"))
    goals = goals.select(F.col("source").alias("_source"), "words", "target", "whole", "blocks", "rest")
    known = rows.join(goals, rows["source"].eqNullSafe(goals["_source"])).drop("_source")
    known = known.withColumn("key", _number(F.lit(str(seed)), "doc", "size")).withColumn(
        "block", F.pmod(_number(F.lit(str(seed + 1)), "doc", "size"), F.col("blocks"))
    )

    sums = known.groupBy("source", "block", "rest").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy(_number(F.lit(str(seed + 2)), "source", "block"), "block")
    drawn = sums.withColumn("upto", F.sum("words").over(order)).select(
        F.col("source").alias("_source"),
        F.col("block").alias("_block"),
        (F.col("upto") <= F.col("rest")).alias("inside"),
        # What is left for the one block that goes over the target.
        F.when((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")), F.col("rest") - F.col("upto") + F.col("words")).alias("room"),
    )
    placed = known.join(
        drawn, known["source"].eqNullSafe(drawn["_source"]) & (known["block"] == drawn["_block"])
    ).drop("_source", "_block")

    edge = placed.where("room is not null and size > 0").withColumns({"gap": F.col("room"), "extra": F.lit(False)})
    each = Window.partitionBy("source")
    for _ in range(FILLINGS):
        # Whoever fits behind the ones before it is taken; the gap that stays is filled likewise.
        free = F.when(~F.col("extra") & (F.col("size") <= F.col("gap")), F.col("size"))
        edge = edge.withColumn("upto", F.sum(free).over(each.orderBy("key", "doc", "row")))
        edge = edge.withColumn("fits", free.isNotNull() & (F.col("upto") <= F.col("gap")))
        edge = edge.withColumns(
            {
                "gap": F.col("gap") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))).over(each), F.lit(0)),
                "extra": F.col("extra") | F.col("fits"),
            }
        )
    off = F.abs(F.col("size") - F.col("gap"))
    last = (~F.col("extra")) & (F.row_number().over(each.orderBy("extra", off, "key", "doc", "row")) == 1) & (off < F.col("gap"))
    edge = edge.select(F.col("row").alias("_row"), (F.col("extra") | last).alias("extra"))

    done = placed.join(edge, placed["row"] == edge["_row"], "left")
    more = (F.col("inside") | F.coalesce("extra", F.lit(False))) & (F.col("size") > 0)
    copies = F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(0).cast("long")
    draw = done.select(
        "row",
        "doc",
        "source",
        "size",
        F.col("words").alias("source_size"),
        "target",
        "key",
        "block",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
    return _drawn_again(stage(draw, "draw"), seed).withColumnRenamed("doc", doc)


def choose_large(sizes: np.ndarray, keys: np.ndarray, rest: float, words: int, small: int, near: float, seed: int) -> np.ndarray:
    """Which large documents to take, so that ``small`` words of small ones can fill what ``rest`` lacks.

    In the order of their keys those are taken that a draw of ``rest`` of ``words`` would take; if the
    small ones are too few for the rest, others follow that fit, and at last one that comes closer.
    Other orders, the largest first among them, are tried until one comes ``near``.
    """
    orders, generator = [np.argsort(keys, kind="stable"), np.argsort(-sizes, kind="stable")], np.random.Generator(np.random.PCG64(seed))
    drawn = keys < rest / max(words, 1) * 2**32
    best, least = np.zeros(len(sizes), bool), float("inf")
    for turn in range(ORDERS):
        order = orders[turn] if turn < len(orders) else generator.permutation(len(sizes))
        taken, held = np.zeros(len(sizes), bool), 0
        for i in order.tolist() if turn else order[drawn[order]].tolist():
            if held + sizes[i] <= rest and (turn == 0 or held + small < rest):
                taken[i], held = True, held + int(sizes[i])
        for i in order.tolist():
            if not taken[i] and held + small < rest and held + sizes[i] <= rest:
                taken[i], held = True, held + int(sizes[i])
        gap = max(0.0, rest - held - small)
        others = np.flatnonzero(~taken)
        if gap and len(others):
            closest = others[np.argmin(np.abs(sizes[others] - gap))]
            if abs(sizes[closest] - gap) < gap:
                taken[closest], gap = True, abs(sizes[closest] - gap)
        if gap < least:
            best, least = taken, gap
        if least <= near:
            break
    return best


def _drawn_again(draw: DataFrame, seed: int) -> DataFrame:
    """The draw, with another for the sources that long documents keep far from their targets.

    Large documents of such a source (over half of what it may be off) are decided first, on the
    driver: their number is bounded by 200 times the source's size over its target. Small ones fill
    the rest in the seeded order of their blocks, of the block that goes over by running sums.
    """
    sums = draw.groupBy("source").agg(
        F.first("source_size").alias("words"), F.first("target").alias("target"), F.sum("taken").alias("taken"),
        F.count(F.when(F.col("size") > 0, 1)).alias("n"),
    )
    odd = {}
    for r in sums.where("words > 0").collect():
        may = max(OFF_SHARE * r["target"], OFF_DOCS * r["words"] / r["n"])
        if abs(r["taken"] - r["target"]) > may:
            whole = int(r["target"] // r["words"])
            odd[r["source"]] = (r["words"], whole, r["target"] - whole * r["words"], may / 2)
    if not odd:
        return draw
    session, kind = draw.sparkSession, draw.schema["source"].dataType.simpleString()
    goals = session.createDataFrame([(k, v[1], v[3]) for k, v in odd.items()], f"_source {kind}, whole long, most double")
    # One row for each source that is drawn again.
    rows = draw.join(F.broadcast(goals), draw["source"].eqNullSafe(goals["_source"]), "left").drop("_source")
    again = rows.where("whole is not null and size > 0")
    small = again.where("size <= most")
    blocks = small.groupBy("source", "block").agg(F.sum("size").alias("words"))
    held = {r["source"]: r["words"] for r in blocks.groupBy("source").agg(F.sum("words").alias("words")).collect()}
    large: dict = {k: [] for k in odd}
    for r in again.where("size > most").select("source", "row", "size", "key").orderBy("key", "size", "row").collect():
        large[r["source"]].append((r["row"], r["size"], r["key"]))
    chosen, rooms = [], []
    for name, (words, _, rest, near) in odd.items():
        ids, sizes, keys = np.array(large[name], np.int64).reshape(-1, 3).T
        taken = choose_large(sizes, keys, rest, words, held.get(name, 0), near, seed)
        chosen += [(i,) for i in ids[taken].tolist()]
        rooms.append((name, rest - int(sizes[taken].sum())))
    rooms = session.createDataFrame(rooms, f"_source {kind}, room double")
    order = Window.partitionBy("source").orderBy(_number(F.lit(str(seed + 2)), "source", "block"), "block")
    filled = blocks.join(F.broadcast(rooms), blocks["source"].eqNullSafe(rooms["_source"])).withColumn("upto", F.sum("words").over(order))
    filled = filled.where(F.col("upto") - F.col("words") < F.col("room")).select(
        "_source", F.col("block").alias("_block"), (F.col("upto") <= F.col("room")).alias("all"), (F.col("room") - F.col("upto") + F.col("words")).alias("left")
    )
    inside = small.join(filled, small["source"].eqNullSafe(filled["_source"]) & (small["block"] == filled["_block"]))
    within = Window.partitionBy("source").orderBy("key", "doc", "row")
    last = inside.where(~F.col("all")).withColumn("upto", F.sum("size").over(within)).where("upto <= left").select("row")
    more = session.createDataFrame(chosen, "row long").unionByName(inside.where("all").select("row")).unionByName(last)
    more = more.select(F.col("row").alias("_row"), F.lit(True).alias("more"))
    out = rows.join(more, rows["row"] == more["_row"], "left")
    redone = F.col("whole") + F.coalesce("more", F.lit(False)).cast("long")
    copies = F.when(F.col("whole").isNotNull() & (F.col("size") > 0), redone).otherwise(F.col("copies"))
    return stage(out.withColumns({"copies": copies, "taken": copies * F.col("size")}).select(draw.columns), "redraw")


def deal(plan: DataFrame, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """Every copy that a plan takes with its ``shard`` and its ``place`` there.

    Each (source, block, copy) is a unit. The splitting tree says how many units of each source
    every shard gets; a source's units, in a drawn order, are cut up by these numbers. One row per
    source comes to the driver, and nothing that grows with the documents. In a shard the
    documents are shuffled; a shard has a bounded size, their number grows.
    """
    taken = plan.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    units = taken.groupBy("source", "block", "copy").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("copy", _number(F.lit(str(seed + 3)), "source", "block", "copy"), "block")
    units = units.withColumn("nth", F.row_number().over(order) - 1)
    sources = units.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")).orderBy(F.col("source").asc_nulls_last()).collect()
    shards = 1 + sum(r["words"] for r in sources) // shard_words
    quotas = splitting_tree(np.array([r["n"] for r in sources], np.int64), shards, seed)
    ends = np.cumsum(quotas, axis=0)
    session = plan.sparkSession
    cuts = session.createDataFrame(
        [(r["source"], ends[:, i].tolist()) for i, r in enumerate(sources)], "_source string, ends array<long>"
    )
    sharded = units.join(cuts, units["source"].eqNullSafe(cuts["_source"])).select(
        F.col("source").alias("_source"),
        F.col("block").alias("_block"),
        F.col("copy").alias("_copy"),
        F.size(F.filter("ends", lambda end: end <= F.col("nth"))).cast("long").alias("shard"),
    )
    out = taken.join(
        sharded,
        taken["source"].eqNullSafe(sharded["_source"])
        & (taken["block"] == sharded["_block"])
        & (taken["copy"] == sharded["_copy"]),
    )
    within = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "key", "copy"), "row", "copy")
    return out.select("row", "copy", "shard", F.row_number().over(within).cast("long").alias("place"))


def mix_dealt(docs: DataFrame, shard_words: int = SHARD_WORDS, **options) -> DataFrame:
    """The plan's rows after dealing: ``copies``, ``taken`` and ``shards``, from the dealt copies.

    Every copy is dealt to its shard and place and written, and the copies written are counted.
    ``shards`` says in how many shards a row has copies. See ``mix_plan`` for the options and the cases.
    """
    plan = mix_plan(docs, **options)
    dealt = stage(deal(plan, shard_words), "mix-dealt")
    counts = dealt.groupBy(F.col("row").alias("_row")).agg(
        F.count(F.lit(1)).alias("_copies"), F.count_distinct("shard").alias("shards")
    )
    known = plan.drop("copies", "taken").join(counts, F.col("row") == F.col("_row"), "left")
    copies = F.coalesce("_copies", F.lit(0).cast("long"))
    return known.withColumns(
        {"copies": copies, "taken": copies * F.col("size"), "shards": F.coalesce("shards", F.lit(0).cast("long"))}
    ).drop("_row", "_copies")


def mix_sources(docs: DataFrame, shard_words: int = SHARD_WORDS, **options) -> DataFrame:
    """The mixed documents themselves: every taken copy with all columns, ``copy``, ``shard``, ``place``.

    The documents are written once with row numbers, so that sizes, draws and texts belong to
    the same rows whatever is recomputed. Columns of the documents that are called like one of
    the three give way. See ``mix_plan`` for the options and the cases.
    """
    numbered = stage(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "numbered")
    plan = mix_plan(numbered, row="_mix_row", **options)
    dealt = deal(plan, shard_words)
    texts = numbered.drop("copy", "shard", "place")
    return texts.join(dealt.withColumnRenamed("row", "_mix_row"), "_mix_row").drop("_mix_row")
