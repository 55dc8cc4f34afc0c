"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks.

The rows of a source, in a hashed order, form one stream of words that is cut into blocks of
``block`` words.  A slot of the schedule takes one block.  Slot t lies at the golden-ratio point
frac(t * phi); cumulative shares of the sources map the point to a source, so any stretch of the
schedule holds each source in proportion.  The r-th slot of a source takes the r-th block of its
stream, starting over at the end; the last slot takes only what the target still lacks.

Targets: sources sorted by code point, null last, weigh ``weights`` in turn and share all words.  A
target stops at ``most`` times its source's words; the excess goes to the others by weight.  That is
water-filling: target = min(most * size, level * weight), with the level read off the sources sorted
by size / weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK_WORDS = 256
GRID = 4096
SLOT_CHUNK = 1 << 16
SHUFFLE_BUCKETS = 4096
#: frac(phi) and frac(2**20 * phi) of the golden ratio phi
PHI, PHI_HIGH = 0.6180339887498949, 0.607787409740351


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null has none."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: sources keep their order, null comes last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), source.cast("string")))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(skey, source_size, target) from (skey, source_size): one row a source.

    The two windows run over the sources, of which there is one row each, not over documents.
    """
    order = Window.orderBy("skey")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("long")).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    by = Window.orderBy(F.col("source_size") / F.col("w"), "skey")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("left", F.col("total") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("wleft", F.sum("w").over(after))
    # the first source, in this order, whose cap the level does not reach; all before it stop at their caps
    level = F.when(F.col("left") * F.col("w") <= most * F.col("source_size") * F.col("wleft"), F.col("left") / F.col("wleft"))
    s = s.withColumn("level", F.first(level, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    cap = (most * F.col("source_size")).cast("double")
    return s.select("skey", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("w"), cap)).alias("target"))


def streams(rows: DataFrame, tie: str) -> DataFrame:
    """``rows`` (skey, size, ``tie``, …) of positive size plus ``start``: words before the row in its source's shuffled stream.

    The running sum is taken within hash buckets of a source and added to the sum of the buckets
    before, so a hot source is spread over many tasks.
    """
    h = rows.withColumn("h", F.md5(F.coalesce(F.col(tie).cast("string"), F.lit("")).cast("binary")))
    h = h.withColumn("bucket", (F.conv(F.substring("h", 1, 3), 16, 10)).cast("int"))
    per = h.groupBy("skey", "bucket").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("skey", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    w = Window.partitionBy("skey", "bucket").orderBy("h", tie, "size").rowsBetween(Window.unboundedPreceding, -1)
    run = h.withColumn("local", F.coalesce(F.sum("size").over(w), F.lit(0)))
    return run.join(per, ["skey", "bucket"]).withColumn("start", (F.col("before") + F.col("local")).cast("long")).drop("h", "bucket", "before", "local")


def plan(goal: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Sources with their number of blocks and of slots, from (skey, source_size, target)."""
    want = F.rint("target").cast("long")
    nb = F.ceil(F.col("source_size") / block).cast("long")
    g = goal.where("source_size > 0").withColumn("want", want).withColumn("blocks", nb)
    full = F.floor(F.col("want") / F.col("source_size")).cast("long")
    rest = F.col("want") - full * F.col("source_size")
    return g.withColumn("slots", full * F.col("blocks") + F.ceil(rest / block).cast("long"))


def schedule(plan_: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The schedule (slot, skey, rank, block, take): which block each slot takes, and how many of its words.

    Points fall into ``GRID`` equal cells, sources lie in the cells that their interval touches, and
    the two meet by an equi-join on the cell.  Ranks within a source are counted in chunks of slots.
    Slots of a source beyond its need are left out, and ranks that the points left open follow at the
    end, which the low discrepancy keeps to a few for each source.
    """
    spark = plan_.sparkSession
    total = plan_.agg(F.sum("slots")).first()[0] or 0
    by = Window.orderBy("skey")
    lines = plan_.withColumn("upto", F.sum("slots").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    lo, hi = (F.col("upto") - F.col("slots")) / F.lit(max(total, 1)), F.col("upto") / F.lit(max(total, 1))
    lines = lines.where("slots > 0").select("skey", "slots", lo.alias("lo"), hi.alias("hi"))
    lines = lines.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * GRID).cast("int"), F.least(F.lit(GRID - 1), F.floor(F.col("hi") * GRID).cast("int")))))
    t = F.col("id")
    x = F.floor(t / (1 << 20)) * F.lit(PHI_HIGH) + F.pmod(t, F.lit(1 << 20)) * F.lit(PHI)
    points = spark.range(total).select(t.alias("slot"), (x - F.floor(x)).alias("x"), F.floor(t / SLOT_CHUNK).cast("long").alias("chunk"))
    points = points.withColumn("cell", F.floor(F.col("x") * GRID).cast("int"))
    hit = points.join(lines, (points["cell"] == lines["cell"]) & (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select("slot", "chunk", "skey", "slots")
    counts = hit.groupBy("skey", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts_before = counts.select("skey", "chunk", before.alias("before"))
    local = hit.withColumn("r", F.row_number().over(Window.partitionBy("skey", "chunk").orderBy("slot")) - 1)
    got = local.join(counts_before, ["skey", "chunk"]).select("slot", "skey", (F.col("before") + F.col("r")).alias("rank")).join(plan_.select("skey", "slots"), "skey").where("rank < slots").drop("slots")
    have = counts.groupBy("skey").agg(F.sum("n").alias("have"))
    late = plan_.join(have, "skey", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < slots")
    late = late.select(F.lit(total).cast("long").alias("slot"), "skey", F.explode(F.sequence("have", F.col("slots") - 1)).alias("rank"))
    every = got.unionByName(late).join(plan_.select("skey", "source_size", "want", "blocks"), "skey")
    turn, k = F.floor(F.col("rank") / F.col("blocks")).cast("long"), F.pmod("rank", "blocks")
    every = every.withColumn("block", k)
    done = turn * F.col("source_size") + F.col("block") * block
    size = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    return every.select("slot", "skey", "rank", "block", F.least(size, F.col("want") - done).cast("long").alias("take"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *keep: str, weights: Sequence[int] = WEIGHTS, most: int = MOST, block: int = BLOCK_WORDS) -> DataFrame:
    """(id, *keep, size, source_size, target, taken, first_slot, slots) for each row of ``docs``.

    first_slot is the first slot of the schedule that takes words of the row, null
    if none does; rows in its order are the mix, in any stretch of which sources have their shares.
    taken counts the row's words in all slots of the schedule, repeats included, and never exceeds
    ``most`` times its size.  Null texts have size 0 and are never taken; a null source is a source,
    the last one; a null id is hashed as an empty one; repeated rows each have their own place in the
    stream.  The order depends on ids and sizes alone, so reruns agree.
    """
    names = [id_col, *keep]
    rows = cut(docs.select(*names, word_count(F.col(text_col)).alias("size"), source_key(F.col(source_col)).alias("skey")))
    sizes = rows.groupBy("skey").agg(F.sum("size").alias("source_size"))
    goal = cut(targets(sizes, weights, most))
    p = plan(goal, block)
    slots = schedule(p, block)
    # how often a block is taken whole, and how much of it the slot that ends a target takes
    width = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    uses = slots.join(p.select("skey", "source_size"), "skey").groupBy("skey", "block").agg(
        F.sum(F.when(F.col("take") >= width, 1).otherwise(0)).alias("whole"), F.max(F.when(F.col("take") < width, F.col("take"))).alias("part"),
        F.min(F.when(F.col("take") >= width, F.col("slot"))).alias("whole_slot"), F.min(F.when(F.col("take") < width, F.col("slot"))).alias("part_slot"),
        F.array_sort(F.collect_list("slot")).alias("slots"),  # no more than ``most`` and one
    )
    laid = streams(rows.where("size > 0"), id_col)
    end = F.col("start") + F.col("size")
    first = F.floor(F.col("start") / block)
    pieces = laid.withColumn("block", F.explode(F.sequence(first, F.floor((end - 1) / block))))
    a = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    b = F.least(end - F.col("block") * block, F.lit(block))
    pieces = pieces.select(*names, "size", "skey", "start", "block", a.alias("pa"), b.alias("pb"))
    cut_off = F.greatest(F.least(F.col("pb"), F.coalesce("part", F.lit(0))) - F.col("pa"), F.lit(0))
    words = F.coalesce("whole", F.lit(0)) * (F.col("pb") - F.col("pa")) + cut_off
    slot = F.least("whole_slot", F.when(cut_off > 0, F.col("part_slot")))
    taken = pieces.join(uses, ["skey", "block"], "left").groupBy(*names, "size", "skey", "start").agg(F.sum(words).cast("long").alias("taken"), F.min(slot).alias("first_slot"), F.min_by("slots", "block").alias("slots")).drop("start")
    none = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_slot", F.lit(None).cast("long")).withColumn("slots", F.lit(None).cast("array<long>"))
    return taken.unionByName(none).join(goal, "skey").select(*names, "size", "source_size", "target", "taken", "first_slot", "slots")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, columns unchanged, each as often as the mix takes it, in the order of the schedule.

    A row appears once for every time that the mix takes all of it, and once more if it takes half of
    it or more besides: a source misses its target by half of one row's words at most, as only the row
    at the end of its stream is taken in part.  Each repeat has the slot of its own pass.  Rows without
    words are not taken.
    """
    h = F.xxhash64(text_col)
    named = docs.select(F.col(id_col).alias("__gl_id"), F.col(text_col).alias("__gl_t"), F.col(source_col).alias("__gl_s"), h.alias("__gl_h"))
    found = mix(named, "__gl_id", "__gl_t", "__gl_s", "__gl_h", **how)
    # rows that repeat both id and text share what was taken of them
    times = found.groupBy("__gl_id", "__gl_h").agg(F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias("__gl_times"), F.min("slots").alias("__gl_slots")).where("__gl_times > 0")
    times = times.select(F.col("__gl_id").alias("__gl_i"), F.col("__gl_h").alias("__gl_kh"), "__gl_times", "__gl_slots")
    rows = docs.withColumn("__gl_h", h)
    out = rows.join(times, rows[id_col].eqNullSafe(times["__gl_i"]) & (rows["__gl_h"] == times["__gl_kh"]))
    out = out.withColumn("__gl_k", F.explode(F.sequence(F.lit(1), F.col("__gl_times"))))
    out = out.withColumn("__gl_slot", F.get("__gl_slots", F.least(F.col("__gl_k"), F.size("__gl_slots")) - 1))
    return out.repartitionByRange("__gl_slot", "__gl_h").sortWithinPartitions("__gl_slot", "__gl_h").select(*docs.columns)


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("slots")


_SQL = """
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'k' || source END AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, (row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS w, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, total - 3 * coalesce(sum(source_size) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
             sum(w) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wleft
      FROM w WINDOW b AS (ORDER BY CAST(source_size AS DOUBLE) / w, skey)),
l AS (SELECT max(CAST(lft AS DOUBLE) / wleft) AS level FROM (
        SELECT * FROM o WHERE lft * w <= 3 * source_size * wleft
        ORDER BY CAST(source_size AS DOUBLE) / w, skey LIMIT 1)),
g AS (SELECT skey, source_size, least(3.0::DOUBLE * source_size, coalesce(level * w, 3.0::DOUBLE * source_size)) AS target FROM o, l),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY skey ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
q AS (SELECT p.doc_id, p.skey, p.size, g.source_size, g.target, p.start, CAST(round_even(g.target, 0) AS BIGINT) AS want
      FROM p JOIN g USING (skey)),
n AS (SELECT skey, source_size, CAST(round_even(target, 0) AS BIGINT) AS want, CAST(ceil(source_size / 256) AS BIGINT) AS blocks FROM g WHERE source_size > 0),
pl AS (SELECT *, want // source_size * blocks + CAST(ceil((want % source_size) / 256) AS BIGINT) AS slots FROM n),
li AS (SELECT *, sum(slots) OVER (ORDER BY skey ROWS UNBOUNDED PRECEDING) AS upto, sum(slots) OVER () AS total FROM pl),
pt AS (SELECT t AS slot, floor(t / 1048576) * 0.607787409740351::DOUBLE + (t % 1048576) * 0.6180339887498949::DOUBLE AS y FROM range((SELECT CAST(coalesce(max(total), 0) AS BIGINT) FROM li)) r(t)),
hi AS (SELECT slot, skey, slots, row_number() OVER (PARTITION BY skey ORDER BY slot) - 1 AS rank FROM (SELECT slot, y - floor(y) AS x FROM pt) p
       JOIN li ON x >= CAST(upto - slots AS DOUBLE) / total AND x < CAST(upto AS DOUBLE) / total),
hv AS (SELECT skey, count(*) AS have FROM hi GROUP BY skey),
sl AS (SELECT slot, skey, rank FROM hi WHERE rank < slots UNION ALL
       SELECT total, skey, unnest(range(CAST(coalesce(have, 0) AS BIGINT), CAST(slots AS BIGINT))) FROM li LEFT JOIN hv USING (skey) WHERE coalesce(have, 0) < slots),
tk AS (SELECT slot, skey, rank % blocks AS block, least(256, source_size - rank % blocks * 256) AS width,
              least(least(256, source_size - rank % blocks * 256), want - (rank // blocks * source_size + rank % blocks * 256)) AS take FROM sl JOIN pl USING (skey)),
pc AS (SELECT p.skey, p.doc_id, p.size, p.start, unnest(range(CAST(start // 256 AS BIGINT), CAST((start + size - 1) // 256 + 1 AS BIGINT))) AS block FROM p WHERE size > 0),
fs AS (SELECT pc.skey, pc.doc_id, pc.size, pc.start, CAST(min(CASE WHEN take >= width OR take > greatest(start - pc.block * 256, 0) THEN slot END) AS BIGINT) AS first_slot
       FROM pc JOIN tk ON tk.skey = pc.skey AND tk.block = pc.block GROUP BY 1, 2, 3, 4)
SELECT q.doc_id, q.size, q.source_size, q.target,
       CASE WHEN q.size = 0 THEN 0 ELSE CAST((want // source_size) * q.size
            + greatest(0, least(q.size, want % source_size - q.start)) AS BIGINT) END AS taken, fs.first_slot
FROM q LEFT JOIN fs ON fs.doc_id IS NOT DISTINCT FROM q.doc_id AND fs.size = q.size AND fs.start = q.start AND fs.skey = q.skey
"""
SQL = {"op2_source_mix": _SQL}
