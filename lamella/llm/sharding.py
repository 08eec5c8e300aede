"""Balanced label propagation of linked documents onto shards.

Documents with equal texts are linked through their text's key, so a group is a node
with its members' shards as votes (label propagation on the bipartite graph: no pair
of documents is ever formed).  Each round, in Spark, does the first of these that
brings groups closer together (the sum of squared holdings of (group, shard) grows, so
that the rounds end):

* to free room: a group ranks its shards by how many members could be together there,
  and asks for their room one after another until all members have a place, so that a
  group larger than a shard fills several in one round; shards admit members up to
  their room, larger requests first, by a running count over (shard, group) totals;
* exchange: a group asks for its largest holdings up to a full shard each, and two
  shards swap equal numbers of members that ask for the other one (or use what room
  there is), so that full shards take part as well.

The rounds go on until neither moves a member.  A group only moves to shards where it
has members already, and shards swap in pairs, not in longer cycles.  Then documents
without links fill the shards to exactly ``floor`` or ``ceil`` of rows / shards.  The
driver sees one row per shard only.  The rows of a hot text are split over tasks wherever they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import numbered
from .shared import split_join, tasks, written


def balanced_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """Returns ``id_col, size, text_crc32, law, shard, slot, grown_shard`` for each row.

    rounds: a caller may stop the propagation early; by default it runs until no member moves.

    size: UTF-8 bytes of the text plus 16.  The law is ``rows``: the shards' row counts
    differ by at most one.  slot counts 0, 1, .. within a shard in order of id.
    grown_shard is null under this law.

    Cases: a null text has size 16 and the crc of no bytes, 0; null texts
    are linked with each other, and so are empty ones.  Rows that repeat are rows of their own.  A null id is kept and
    sorts first.  An empty table gives an empty result.  A text's length does not matter beyond its
    size.  Other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    base = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("key"),
    )
    # a number per row, dense in the order of (key, id): a first cut into equal ranges keeps most groups whole
    rows = numbered(base.withColumn("__one", F.pmod(F.length("key"), F.lit(1))), "__one", ["key", "id", "size"], "n").drop("__one")
    rows = written(rows, "rows")
    total = rows.count()
    if not total:
        return docs.sparkSession.createDataFrame([], f"`{id_col}` long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
    low, extra = divmod(total, n_shards)
    capacity = [low + (s < extra) for s in range(n_shards)]
    # start: by hash, in the way a plain writer would place them
    sizes = rows.groupBy("key").agg(F.count("*").alias("members"), F.min("n").alias("n0"))
    linked = written(sizes.where("members > 1").withColumn("__n", F.col("members")), "linked")
    grouped = split_join(rows.select("key", "n"), linked.drop("n0"), ["key"], total, ["n"])
    # a row of votes per (group, shard); members of a group are told apart by their number only
    votes = written(grouped.groupBy("key", "members", F.pmod(F.xxhash64("n"), F.lit(n_shards)).cast("int").alias("shard")).agg(F.count("*").alias("held")), "votes")
    cap = _per_shard(capacity)

    used, together = _load(votes)
    turn = 0
    while rounds is None or turn < rounds:
        turn += 1
        room = _per_shard([max(0, capacity[s] - used.get(s, 0)) for s in range(n_shards)])
        # members of a whole group ask for nothing; ties between shards fall anew each round, so that requests go both ways
        split = votes.where("held < members").withColumn("room", room).withColumn("cap", F.greatest(cap, "held")).withColumn("tie", F.xxhash64("key", "shard", F.lit(turn)))
        for step in (_to_room, _exchanges):
            change = written(step(split), "moves")
            if not change.take(1):
                continue
            moved = votes.union(change.select("key", "members", "shard", "held")).groupBy("key", "members", "shard").agg(F.sum("held").alias("held")).where("held > 0")
            moved = written(moved, "votes")
            now_used, now_together = _load(moved)
            if now_together > together:
                votes, used, together = moved, now_used, now_together
                break
        else:
            break

    # shards that start over their capacity give up what is too much: smallest holdings first, back to the fillers
    over = _running_by(votes.withColumn("rank", -F.col("held")), "shard", ["rank", "key"], "held")
    final = written(over.select("key", "shard", F.greatest(F.lit(0), F.least(F.col("held"), cap - F.col("before"))).cast("long").alias("held")).where("held > 0"), "holdings")
    used = {r["shard"]: r["used"] for r in final.groupBy("shard").agg(F.sum("held").alias("used")).collect()}
    # members of a group by their number: first the largest holding, and so on
    runs = final.withColumn("start", F.sum("held").over(Window.partitionBy("key").orderBy(F.desc("held"), "shard")) - F.col("held"))
    spans = runs.join(linked.select("key", "n0"), "key").select("key", "shard", (F.col("n0") + F.col("start")).alias("a"), (F.col("n0") + F.col("start") + F.col("held")).alias("z"))
    spans = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("a", "z", "shard"))).alias("spans"))  # at most n_shards entries
    placed = split_join(rows, spans.join(linked.select("key", "__n"), "key"), ["key"], total, ["n"], "left").withColumn("hit", F.expr("try_element_at(filter(spans, s -> s.a <= n and n < s.z), 1).shard"))
    placed = written(placed.select("id", "size", "text_crc32", "key", "n", F.col("hit").alias("shard")), "placed")
    # the others fill what is free, in order
    gaps, edge = [], 0
    for s in range(n_shards):
        edge += capacity[s] - int(used.get(s, 0))
        gaps.append(edge)
    fill = numbered(placed.where("shard is null").withColumn("__one", F.pmod(F.col("n"), F.lit(1))), "__one", ["n"], "f")
    ends = F.array(*[F.lit(g).cast("long") for g in gaps])
    fill = fill.withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col("f"))).cast("int"))
    cols = ["id", "size", "text_crc32", "key", "n", "shard"]
    out = numbered(placed.where("shard is not null").select(*cols).union(fill.select(*cols)), "shard", ["id", "n"], "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _per_shard(values: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("shard") + 1)


def _load(votes: DataFrame) -> tuple[dict[int, int], int]:
    """Members in each shard, and the sum of squared holdings; at most one row per shard is collected."""
    square = F.col("held").cast("decimal(18,0)") * F.col("held").cast("decimal(18,0)")
    rows = votes.groupBy("shard").agg(F.sum("held").alias("used"), F.sum(square).alias("square")).collect()
    return {r["shard"]: r["used"] for r in rows}, sum(int(r["square"]) for r in rows)


def _upto(value: Column, most: Column | str) -> Column:
    return F.greatest(F.lit(0), F.least(value, F.col(most) if isinstance(most, str) else most)).cast("long")


def _to_room(split: DataFrame) -> DataFrame:
    """Changes of holdings (key, members, shard, held) by moves to shards with free room."""
    by = (F.desc(F.least(F.col("members") - F.col("held"), "room") + F.col("held")), F.desc("held"), "tie", "shard")
    order = Window.partitionBy("key").orderBy(*by)  # at most n_shards rows of a group
    ranked = split.withColumn("place", F.row_number().over(order)).withColumn("held_to", F.sum("held").over(order)).withColumn("room_to", F.sum("room").over(order))
    # what is left when the better shards keep their members and take as many as they have room
    asks = ranked.withColumn("want", _upto(F.col("members") - F.col("held_to") - (F.col("room_to") - F.col("room")), "room")).where("want > 0")
    before = _running_by(asks.select("key", "members", "shard", "want", "room", (-F.col("want")).alias("rank")), "shard", ["rank", "key"], "want")
    granted = written(before.select("key", "members", "shard", _upto(F.col("room") - F.col("before"), "want").alias("held")).where("held > 0"), "granted")
    # members leave the last places first, none of which asks
    leaving = ranked.join(granted.groupBy("key").agg(F.sum("held").alias("grant")), "key")
    gone = _upto(F.col("grant") - (F.col("members") - F.col("held_to")), "held")
    return granted.union(leaving.select("key", "members", "shard", (-gone).alias("held")).where("held < 0"))


def _exchanges(split: DataFrame) -> DataFrame:
    """Changes of holdings by swaps of equal size between two shards and by moves to free room, always to a holding that is not smaller."""
    order = Window.partitionBy("key").orderBy(F.desc("held"), "tie", "shard")  # at most n_shards rows of a group
    goal = split.withColumn("goal", _upto(F.col("members") - (F.sum("cap").over(order) - F.col("cap")), "cap")).withColumn("more", F.col("goal") - F.col("held"))
    goal = goal.withColumn("place", F.row_number().over(order))
    ends = lambda side: F.sum(F.abs("more")).over(Window.partitionBy("key").orderBy("place")).alias(side)
    asks = goal.where("more > 0").select("key", "members", "room", F.col("shard").alias("to"), F.col("more").alias("n_to"), ends("to_end"))
    gives = goal.where("more < 0").select("key", F.col("shard").alias("of"), (-F.col("more")).alias("n_of"), ends("of_end"))
    # asks and gives of a group, laid end to end, meet where they overlap
    overlap = F.least("to_end", "of_end") - F.greatest(F.col("to_end") - F.col("n_to"), F.col("of_end") - F.col("n_of"))
    flows = asks.join(gives, "key").withColumn("want", overlap).where("want > 0").select("key", "members", "of", "to", "room", "want", F.concat_ws(" ", "of", "to").alias("lane"))
    flows = written(flows, "flows")
    lanes = flows.groupBy("of", "to", "room", "lane").agg(F.sum("want").alias("there"))  # at most n_shards ** 2 rows
    back = lanes.select(F.col("to").alias("of"), F.col("of").alias("to"), F.col("there").alias("back"))
    lanes = lanes.join(back, ["of", "to"], "left").withColumn("swap", F.least("there", F.coalesce("back", F.lit(0)))).withColumn("rest", F.col("there") - F.col("swap"))
    earlier = F.sum("rest").over(Window.partitionBy("to").orderBy(F.desc("rest"), "of")) - F.col("rest")
    quota = lanes.select("lane", (F.col("swap") + _upto(F.col("room") - earlier, "rest")).alias("quota")).where("quota > 0")
    before = _running_by(flows.join(quota, "lane").withColumn("rank", -F.col("want")), "lane", ["rank", "key"], "want")
    granted = written(before.select("key", "members", "of", "to", _upto(F.col("quota") - F.col("before"), "want").alias("held")).where("held > 0"), "granted")
    return granted.select("key", "members", F.col("to").alias("shard"), "held").union(granted.select("key", "members", "of", -F.col("held")))


def _running_by(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the group's earlier rows, by partitions of ranges."""
    dealt = written(df.repartitionByRange(tasks(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    sums = dealt.groupBy(group, "__part").agg(F.sum(value).alias("__s"))
    offsets = sums.select(group, "__part", (F.sum("__s").over(Window.partitionBy(group).orderBy("__part")) - F.col("__s")).alias("__before"))
    inner = F.sum(value).over(Window.partitionBy("__part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return dealt.withColumn("__in", inner).join(offsets, [group, "__part"]).withColumn("before", F.col("__in") + F.col("__before")).drop("__part", "__in", "__before")
