"""Consistent-hash sharding with virtual nodes and bounded loads, in DataFrame operations only.

The ring has ``CELLS`` positions. Every shard owns the positions between its virtual nodes
and the ones before them; a key's home is the owner of its hash position. No shard takes
more than its quota: keys beyond it continue clockwise to the next virtual node whose shard
still has room.

All decisions are made on the ring's cells, a table of fixed size: rows are counted per cell
(combined map-side), running sums along the ring say how many rows of each cell stay at home,
and one fold over the virtual nodes hands the overflow on, first come first served. A row
then only needs its rank within its cell. No step gathers a shard or a hot key's rows in
memory, and the row-level shuffle carries ids, sizes and checksums, never texts.

With ``slack = 0`` the quotas add up to the row count, so any two shards differ by one row at
most (law ``rows``). With more slack a shard holds at most ``ceil((1 + slack) * rows / shards)``
and fewer rows move when shards are added.

Defined results: a null text counts as no bytes; a null id is a key like any other; repeated
rows are placed one by one; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

CELL_BITS = 16
CELLS = 1 << CELL_BITS
VNODES = 64


def ring(spark, n_shards: int, vnodes: int = VNODES) -> DataFrame:
    """Virtual nodes ``(cell, shard)``; where two fall on one cell, the smaller shard has it."""
    return (spark.range(n_shards * vnodes)
            .select((F.col("id") / vnodes).cast("int").alias("shard"), (F.col("id") % vnodes).alias("v"))
            .select("shard", F.pmod(F.xxhash64(F.lit("vnode"), "shard", "v"), F.lit(CELLS)).cast("int").alias("cell"))
            .groupBy("cell").agg(F.min("shard").alias("shard")))


def _owners(spark, vnodes: DataFrame) -> DataFrame:
    """``(cell, owner)`` for all CELLS positions: the next virtual node clockwise."""
    first = vnodes.agg(F.min(F.struct("cell", "shard")).alias("m")).select("m.shard")
    after = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    return (spark.range(CELLS).select(F.col("id").cast("int").alias("cell"))
            .join(F.broadcast(vnodes), "cell", "left")
            .select("cell", F.coalesce(F.last("shard", ignorenulls=True).over(after), first.scalar()).alias("owner")))


def _hand_on(vnodes: DataFrame, arrivals: DataFrame, quotas: DataFrame) -> DataFrame:
    """Walk the overflow clockwise (two laps reach every shard): rows ``(lo, hi, shard, slot)``
    say which stretch of the overflow, in ring order, each shard takes."""
    nodes = (vnodes.join(arrivals.withColumnRenamed("owner", "shard"), ["cell", "shard"], "left")
             .agg(F.array_sort(F.collect_list(F.struct("cell", "shard", F.coalesce("over", F.lit(0)).alias("over"))))
                  .alias("nodes")))                       # at most shards * virtual nodes entries
    room = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "quota", "home"))),
                                  lambda x: F.struct((x.quota - x.home).alias("free"), x.home.alias("next")))
                      .alias("room"))
    state = nodes.withColumn("room", room.scalar()).selectExpr("""
      aggregate(
        concat(transform(nodes, x -> struct(x.shard, x.over)), transform(nodes, x -> struct(x.shard, 0L AS over))),
        struct(room AS room, 0L AS queue, 0L AS done,
               CAST(array() AS array<struct<lo:bigint,hi:bigint,shard:int,slot:bigint>>) AS out),
        (s, x) -> named_struct(
          'room', transform(s.room, (r, i) -> named_struct(
             'free', r.free - IF(i = x.shard, least(r.free, s.queue + x.over), 0L),
             'next', r.next + IF(i = x.shard, least(r.free, s.queue + x.over), 0L))),
          'queue', s.queue + x.over - least(s.room[x.shard].free, s.queue + x.over),
          'done', s.done + least(s.room[x.shard].free, s.queue + x.over),
          'out', IF(least(s.room[x.shard].free, s.queue + x.over) > 0,
             concat(s.out, array(named_struct('lo', s.done, 'hi', s.done + least(s.room[x.shard].free, s.queue + x.over),
                                              'shard', x.shard, 'slot', s.room[x.shard].next))), s.out)),
        s -> s.out) AS parts""")
    return state


def shard_rows(rows: DataFrame, n_shards: int, key: str = "doc_id", tie: tuple[str, ...] = (),
               vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 in each shard) to narrow rows.

    ``tie`` names columns that order rows of one key. ``rows`` is read twice, so it should be
    a stored table."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "ring")
    keyed = rows.withColumn("__h", F.xxhash64(key)).withColumn(
        "__cell", F.shiftrightunsigned("__h", 64 - CELL_BITS).cast("int"))
    nodes = ring(spark, n_shards, vnodes)
    cells = (_owners(spark, nodes).join(keyed.groupBy(F.col("__cell").alias("cell")).agg(F.count("*").alias("n")),
                                        "cell", "left").select("cell", "owner", F.coalesce("n", F.lit(0)).alias("n")))
    cells = scratch.keep(cells)                                       # CELLS rows
    total = cells.agg(F.sum("n")).first()[0] or 0
    quota = (F.lit(total // n_shards) + (F.col("shard") < total % n_shards).cast("long") if slack <= 0
             else F.lit(-int(-total * (1 + slack) // n_shards)))
    before = Window.partitionBy("owner").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    quotas = spark.range(n_shards).select(F.col("id").cast("int").alias("shard")).withColumn("quota", quota)
    cells = (cells.join(F.broadcast(quotas.withColumnRenamed("shard", "owner")), "owner")
             .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
             .withColumn("home", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("base"))))
             .withColumn("over", F.col("n") - F.col("home")))
    # clockwise order from the first virtual node's arc, which begins beyond the last one
    beyond = F.col("cell") <= nodes.agg(F.max("cell")).scalar()
    along = Window.orderBy(beyond, "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("lo", F.coalesce(F.sum("over").over(along), F.lit(0)))
    cells = scratch.keep(cells)
    # the overflow of a cell passes the virtual node that ends its arc; beyond the last one, the first
    after = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    ends = (cells.select("cell", "owner", "over").join(F.broadcast(nodes.select(F.col("cell"), F.col("cell").alias("at"))),
                                                       "cell", "left")
            .withColumn("end", F.last("at", ignorenulls=True).over(after)))
    lap = nodes.agg(F.min("cell")).scalar()
    arrivals = (ends.groupBy(F.coalesce("end", lap).alias("cell"), "owner").agg(F.sum("over").alias("over")))
    home = quotas.join(cells.groupBy(F.col("owner").alias("shard")).agg(F.sum("home").alias("home")), "shard", "left") \
        .select("shard", "quota", F.coalesce("home", F.lit(0)).alias("home"))
    parts = _hand_on(nodes, arrivals, home)
    plan = scratch.keep(cells.withColumn("parts", parts.scalar())
            .withColumn("parts", F.expr("IF(over > 0, filter(parts, p -> p.hi > lo AND p.lo < lo + over), slice(parts, 1, 0))"))
            .select(F.col("cell").alias("__cell"), "owner", "base", "home", "lo", "parts"))
    inside = Window.partitionBy("__cell").orderBy("__h", key, *tie)
    placed = (keyed.join(F.broadcast(plan), "__cell")                 # CELLS rows
              .withColumn("__r", (F.row_number().over(inside) - 1).cast("long"))
              .withColumn("__o", F.col("lo") + F.col("__r") - F.col("home"))
              .withColumn("__p", F.expr("get(filter(parts, p -> __o >= p.lo AND __o < p.hi), 0)"))
              .withColumn("shard", F.when(F.col("__r") < F.col("home"), F.col("owner")).otherwise(F.col("__p.shard")))
              .withColumn("slot", F.when(F.col("__r") < F.col("home"), F.col("base") + F.col("__r"))
                          .otherwise(F.col("__p.slot") + F.col("__o") - F.col("__p.lo"))))
    return placed.select(*rows.columns, F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
                    vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` of every document.

    The narrow table (no texts) is written once to the shared folder."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = Scratch(docs.sparkSession, "shards").keep(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32")))
    return shard_rows(rows, n_shards, "doc_id", ("text_crc32", "size"), vnodes, slack)
