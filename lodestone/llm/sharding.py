"""Sharding by balanced label propagation.

Documents of equal text are linked.  Because the documents of one text in one
shard are alike, the propagation works on cells (text, shard, count).  Each
round joins every cell with its text's preferred shard, the one that holds most
of the neighbours among the shards with room, sums the wanted moves into a
shard-by-shard flow, and admits opposite flows in full and the rest as far as
there is room; a cell then moves the admitted share of its count.  Documents
without a link are ballast: they start evenly by hash and fill what the linked
ones leave.  At the end each shard keeps its first ``quota`` documents, linked
ones first, and what is over goes to the shards with gaps, so that the counts
differ by one at most (law ``rows``).

Only shard-by-shard tables reach the driver.  Ranks come from ``ranked_within``,
so that neither a shard nor a group of copies, nor of one id, is held in one task:
rows are dealt into cells by a number of their own, as many cells as keep a cell of
equal texts near ``CELL`` rows.

Defined cases.  Null and empty texts are the same text.  Repeated rows are
documents of their own.  Null ids are ordinary ids.  Further columns are
ignored.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked_within, saved

SPREAD = 997  # cells of a text at least
CELL = 50_000
ROUNDS = 6


def _u(*cols: Column | str) -> Column:
    """A number from 0 to 1 by hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 20)) / float(1 << 20)


def _propagate(cells: DataFrame, shards: int, quota: list[int]) -> DataFrame:
    """``cells`` (g1, g2, shard, n) after the rounds."""
    text = ["g1", "g2"]
    for turn in range(ROUNDS):
        load = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        free = [quota[s] - load.get(s, 0) for s in range(shards)]
        roomy = [s for s in range(shards) if free[s] > quota[s] // 200]
        weight = F.struct(F.col("n"), F.xxhash64("g1", "g2", "shard").alias("h"))
        goal = cells.where(F.col("shard").isin(roomy)).groupBy(*text).agg(F.max_by("shard", weight).alias("goal"), F.max(weight).alias("goal_weight"))
        moves = cells.join(goal, text, "left").withColumn("wants", F.coalesce((F.col("goal") != F.col("shard")) & (weight < F.col("goal_weight")), F.lit(False)))
        moves = saved(moves.select(*text, "shard", "n", "goal", "wants"))
        flow = {(r["shard"], r["goal"]): r["n"] for r in moves.where("wants").groupBy("shard", "goal").agg(F.sum("n").alias("n")).collect()}
        if not flow:
            break
        rest = {(i, j): n - min(n, flow.get((j, i), 0)) for (i, j), n in flow.items()}
        into = [sum(rest.get((i, j), 0) for i in range(shards)) for j in range(shards)]
        share = {(i, j): (n - rest[i, j] + rest[i, j] * min(1.0, max(0, free[j]) / max(1, into[j]))) / n for (i, j), n in flow.items()}
        table = F.create_map(*[F.lit(x) for (i, j), p in share.items() for x in (i * shards + j, float(p))])
        odds = F.coalesce(table[F.col("shard") * shards + F.col("goal")], F.lit(0.0))
        went = F.when(F.col("wants"), F.floor(F.col("n") * odds + _u("g1", "g2", "shard", F.lit(turn)))).otherwise(0).cast("long")
        moves = moves.withColumn("went", F.least("n", went))
        stay = moves.select(*text, "shard", (F.col("n") - F.col("went")).alias("n"))
        gone = moves.where("went > 0").select(*text, F.col("goal").alias("shard"), F.col("went").alias("n"))
        cells = saved(stay.where("n > 0").union(gone).groupBy(*text, "shard").agg(F.sum("n").alias("n")))
    return cells


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.concat(F.lit("#"), text)).alias("g2"),
    )
    # The row's number is written with it, so every later reading agrees on it.
    base = base.withColumn("row", F.monotonically_increasing_id())
    base = saved(base.withColumn("start", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")))
    total = base.count()
    spread = max(SPREAD, -(-total // CELL))
    quota = [total // shards + (s < total % shards) for s in range(shards)]

    cells = base.groupBy("g1", "g2", F.col("start").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    of_text = Window.partitionBy("g1", "g2")
    cells = saved(cells.withColumn("copies", F.sum("n").over(of_text)).where("copies > 1").drop("copies"))
    cells = _propagate(cells, shards, quota)

    # Ranges of ranks by shard for each linked text, put beside the offsets of
    # its spread cells: what is joined with the documents has no hot key.
    up_to = F.sum("n").over(of_text.orderBy("shard"))
    ends = cells.withColumn("end", up_to).groupBy("g1", "g2").agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("ends"))  # <= shards a text
    cell = F.pmod(F.xxhash64("doc_id", "row"), F.lit(spread)).cast("int")
    base = base.withColumn("cell", cell)
    sums = base.groupBy("g1", "g2", "cell").agg(F.count(F.lit(1)).alias("n_"))
    before = of_text.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("first", F.coalesce(F.sum("n_").over(before), F.lit(0))).drop("n_").join(ends, ["g1", "g2"])
    inside = Window.partitionBy("g1", "g2", "cell").orderBy("doc_id", "row")
    placed = base.join(sums, ["g1", "g2", "cell"], "left")
    rank = F.row_number().over(inside) - 1 + F.col("first")
    placed = placed.withColumn("rank", rank).withColumn("linked", F.col("ends").isNotNull())
    own = F.filter("ends", lambda e: e["end"] > F.col("rank"))[0]["shard"]
    placed = saved(placed.select("doc_id", "row", "size", "text_crc32", "cell", "linked", F.coalesce(F.when(F.col("linked"), own), F.col("start")).alias("wish")))

    turn = F.when(F.col("linked"), F.col("cell")).otherwise(F.col("cell") + spread)
    ranked = ranked_within(placed, ["wish"], [F.col("doc_id"), F.col("row")], turn, "rank")
    limit = F.element_at(F.array(*[F.lit(q).cast("long") for q in quota]), F.col("wish") + 1)
    ranked = saved(ranked.withColumn("over", F.col("rank") >= limit))
    counts = {r["wish"]: r["n"] for r in ranked.groupBy("wish").agg(F.count(F.lit(1)).alias("n")).collect()}
    gaps, seat = [], 0  # (end of the seats, shard, its first slot less the first seat)
    for s in range(shards):
        missing = quota[s] - min(quota[s], counts.get(s, 0))
        if missing:
            gaps.append((seat + missing, s, quota[s] - missing - seat))
            seat += missing
    keep = ranked.where(~F.col("over")).select("doc_id", "size", "text_crc32", F.col("wish").alias("shard"), F.col("rank").alias("slot"))
    if gaps:
        moved = ranked.where("over").drop("rank").withColumn("all", F.lit(0))
        moved = ranked_within(moved, ["all"], [F.col("wish"), F.col("doc_id"), F.col("row")], F.col("cell"), "seat")
        table = F.array(*[F.struct(F.lit(e).cast("long").alias("end"), F.lit(s).alias("shard"), F.lit(d).cast("long").alias("shift")) for e, s, d in gaps])
        gap = F.filter(table, lambda g: g["end"] > F.col("seat"))[0]
        moved = moved.withColumn("gap", gap)
        keep = keep.union(moved.select("doc_id", "size", "text_crc32", F.col("gap.shard"), (F.col("seat") + F.col("gap.shift")).alias("slot")))
    return keep.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
