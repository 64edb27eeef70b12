"""Mixing sources to target weights by a low-discrepancy schedule.

Sources in the order of their names share a number of words by their weights; a source's target stops at a multiple of its size and
the excess is shared again by weight until none is above. A target makes a number of slots of BLOCK words. Points of the golden ratio's
sequence, one for each slot of the mix, are mapped through the sources' cumulative targets: that is the order in which sources take
turns. Slots are ranked within their source; the rank names the block of the source's words that fills the slot. A source's words are
its documents in the order of a hash, laid end to end, as often as the limit allows; a block is BLOCK words of that line, so a document may lie
in several blocks and in several passes. The points give a source a few slots too many or too few; those are left out, or follow
at the end, and the last block is cut, so that a source's taken words are its target, rounded.

All sums that run over rows are prefix sums over bounded groups (hash ranges of a source's documents, stretches of the schedule), then over
the groups' totals, so a source with most of the rows has no task of its own.

Defined results: null and empty texts have size 0 and are never taken; the null source comes last; rows of equal or null ids are documents
of their own; identical rows (id, source and text) share what is taken in an order of no meaning, so any run gives the same rows. Extra columns go; an empty
table gives no rows; without words all targets are 0. The result doesn't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fits_broadcast, looked_up, parts, staged, table

#: Weights of the sources in the order of their names, repeating; words of the mix as a share of all; the most passes over a source.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
#: Words of a slot; rows of a group whose running sums are made in one window; groups of a group of groups.
BLOCK, GROUP, GROUPS = 1024, 512, 1024
#: 2**31 over the golden ratio, to the nearest odd number: points n * GOLDEN modulo 2**31 meet every value once before they repeat.
GOLDEN, CIRCLE = 1327217885, 1 << 31
SPACES = r"\x20\x09-\x0D"


def size_of(text: str) -> Column:
    """Words of a text, counted without an array of them: each word with the space around it becomes one character."""
    one = F.regexp_replace(text, f"[{SPACES}]*+[^{SPACES}]++[{SPACES}]*+", "x")
    return F.when(F.col(text).rlike(f"[^{SPACES}]"), F.length(one)).otherwise(0).cast("long")


def before(groups: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """groups (key, group, value, at most a row for each) with `before`: the sum of value over the key's lesser groups. In two levels, so that a window stays short."""
    g = groups.withColumn("above", F.expr(f"{group} div {GROUPS}"))
    tops = g.groupBy(key, "above").agg(F.sum(value).alias("t"))
    by = W.partitionBy(key).orderBy("above").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(F.col(key).alias("k2"), F.col("above").alias("a2"), F.coalesce(F.sum("t").over(by), F.lit(0)).alias("base"))
    inner = W.partitionBy(key, "above").orderBy(group).rowsBetween(W.unboundedPreceding, -1)
    g = g.withColumn("part_sum", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return g.join(tops, (F.col(key) == F.col("k2")) & (F.col("above") == F.col("a2"))).withColumn("before", F.col("base") + F.col("part_sum")).drop("above", "k2", "a2", "base", "part_sum")


def _ordered(sources: DataFrame) -> DataFrame:
    """sources (source, source_size, c) with their number `i` from 0 in the order of names, null last, and the part of the range that they lie in."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.asc_nulls_last("source")
    ranged = staged(sources.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()))
    counts = before(ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0)), "all", "part", "n").select("part", "before")
    i = F.row_number().over(W.partitionBy("part").orderBy(order)) - 1 + F.col("before")
    return ranged.join(F.broadcast(counts), "part").withColumn("i", i.cast("long")).drop("before")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """sources (source, source_size, c) with i, target (double) and cap: what each source gives to the mix."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int"))
    s = staged(_ordered(sources).withColumn("w", w).withColumn("cap", passes * F.col("source_size")))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, closed = None, -1
    while True:
        # one number for each round: sources whose share at this level is above their cap give the cap, the others share the rest
        full = F.lit(False) if level is None else F.col("cap") < level * F.col("w")
        r = s.agg(F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("taken"), F.sum(F.when(full, 0).otherwise(F.col("w"))).alias("w"), F.count_if(full).alias("n")).first()
        if r.n == closed or not r.w:
            break
        level, closed = (share * total - r.taken) / r.w, r.n
    target = F.least(F.col("cap").cast("double"), F.lit(level or 0.0) * F.col("w"))
    return staged(s.withColumn("target", target).withColumn("words", F.round("target").cast("long")).withColumn("slots", F.ceil(F.col("words") / BLOCK)))


def schedule(s: DataFrame) -> DataFrame:
    """s (targets) -> (i, rank, slot): the slots of the mix in their order, each with its source and its rank among the source's."""
    spark = s.sparkSession
    n = int(s.agg(F.sum("slots")).first()[0] or 0)
    part = before(s.groupBy("part").agg(F.sum("slots").alias("t")).withColumn("all", F.lit(0)), "all", "part", "t").select("part", "before")
    inner = F.coalesce(F.sum("slots").over(W.partitionBy("part").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = s.filter("slots > 0").join(F.broadcast(part), "part").withColumn("from", F.col("before") + inner)
    # from slots to the circle: places of a source's share on it; cells of the circle hold about GROUP points each
    cells = 1 << max(0, (n // GROUP).bit_length() - 1)
    width = CIRCLE // cells if cells <= CIRCLE else 1
    on = lambda slot: F.floor(slot.cast("double") / max(n, 1) * CIRCLE).cast("long")
    spans = spans.select("i", on(F.col("from")).alias("a"), on(F.col("from") + F.col("slots")).alias("b")).filter("a < b")
    starts = spans.select(F.expr(f"a div {width}").alias("cell"), F.col("a").alias("at"), F.lit(0).alias("kind"), "i", F.lit(None).cast("long").alias("slot"))
    # a source whose share goes on into later cells stands at their beginnings too
    later = spans.select(F.explode(F.expr(f"if((b - 1) div {width} > a div {width}, sequence(a div {width} + 1, (b - 1) div {width}), array())")).alias("cell"), "i")
    later = later.select("cell", (F.col("cell") * width).alias("at"), F.lit(0).alias("kind"), "i", F.lit(None).cast("long").alias("slot"))
    point = (F.col("id") % CIRCLE) * GOLDEN % CIRCLE
    points = spark.range(n).select(F.expr("id").alias("slot"), point.alias("at"))
    points = points.select(F.expr(f"at div {width}").alias("cell"), "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("i"), "slot")
    by = W.partitionBy("cell").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    turns = starts.unionByName(later).unionByName(points).withColumn("i", F.last("i", ignorenulls=True).over(by)).filter("kind = 1")
    turns = staged(turns.select("i", "slot", F.expr(f"slot div {GROUP}").alias("stretch")))
    earlier = before(turns.groupBy("i", "stretch").agg(F.count(F.lit(1)).alias("n")), "i", "stretch", "n").select(F.col("i").alias("i2"), F.col("stretch").alias("s2"), "before")
    rank = F.row_number().over(W.partitionBy("i", "stretch").orderBy("slot")) - 1
    ranked = turns.withColumn("r", rank).join(earlier, (F.col("i") == F.col("i2")) & (F.col("stretch") == F.col("s2"))).select("i", (F.col("r") + F.col("before")).alias("rank"), "slot")
    wanted = s.select("i", "slots")
    # what the points leave over goes; what they lack follows at the end of the schedule
    had = turns.groupBy("i").agg(F.count(F.lit(1)).alias("had"))
    lacking = wanted.join(had, "i", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < slots")
    lacking = lacking.select("i", F.explode(F.sequence("had", F.col("slots") - 1)).alias("rank")).withColumn("slot", n + F.col("rank"))
    ranked = ranked.join(F.broadcast(wanted), "i") if fits_broadcast(wanted, 16) else looked_up(ranked, staged(wanted.withColumn("c", F.col("slots"))), ["i"], parts(turns))
    return ranked.filter("rank < slots").select("i", "rank", "slot").unionByName(lacking)


def _placed(d: DataFrame) -> DataFrame:
    """d (i, id, size, h, c rows that are alike, rows: of the source) with `at`: where the rows' words begin in their source's line."""
    groups = F.greatest(F.lit(1), F.expr(f"rows div {GROUP}"))
    d = d.withColumn("g", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2**32 * groups).cast("long")).withColumn("n", F.col("size") * F.col("c"))
    d = staged(d.drop("rows"))
    earlier = before(d.groupBy("i", "g").agg(F.sum("n").alias("t")), "i", "g", "t").select(F.col("i").alias("i2"), F.col("g").alias("g2"), "before")
    by = W.partitionBy("i", "g").orderBy("h", "id", "size", "task").rowsBetween(W.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("n").over(by), F.lit(0))
    return d.withColumn("inner", inner).join(earlier, (F.col("i") == F.col("i2")) & (F.col("g") == F.col("g2"))).withColumn("at", F.col("before") + F.col("inner")).drop("i2", "g2", "before", "inner", "n", "g")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix. documents: row, id, size, i, source_size, target of each row of docs; pieces: slot, row, first, last: the words of a
    document (end exclusive) that stand in a slot. Ordered by slot (and, within it, by place) the pieces are the mix."""
    key = F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(text_col, F.lit("")))), 1, 16)
    d = staged(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(size_of(text_col), F.lit(0)).cast("long").alias("size"), key.alias("h")))
    n_parts = parts(docs)
    sources = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("c"))
    s = targets(sources, weights, share, passes)
    # alike rows of one task are one run of copies
    d = d.withColumn("task", F.spark_partition_id())
    runs = d.groupBy("source", "id", "size", "h", "task").agg(F.count(F.lit(1)).alias("copies"))
    info = staged(s.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("nameless"), "i", "source_size", "target", "words", F.col("c").alias("rows"), "c"))
    runs = runs.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("nameless", F.col("source").isNull()).drop("source")
    runs = looked_up(runs, info, ["name", "nameless"], n_parts).drop("name", "nameless").withColumnRenamed("copies", "c")
    placed = _placed(runs)
    rows = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1))).withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
    rows = staged(rows.select("id", "size", "i", "source_size", "target", "words", "at", F.struct("i", "at", "id", "h", "task", "copy").alias("row")))
    # a document's words in each pass over its source, cut at the ends of blocks; beyond the target nothing is taken
    laid = rows.filter("size > 0").withColumn("pass", F.explode(F.array(*(F.lit(p).cast("long") for p in range(passes)))))
    laid = laid.withColumn("a", F.col("at") + F.col("pass") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), "words")).filter("a < b")
    cut = laid.withColumn("rank", F.explode(F.expr(f"sequence(a div {BLOCK}, (b - 1) div {BLOCK})")))
    first, last = F.greatest(F.col("a"), F.col("rank") * BLOCK) - F.col("a"), F.least(F.col("b"), (F.col("rank") + 1) * BLOCK) - F.col("a")
    pieces = cut.select("i", "rank", "row", F.col("a").alias("place"), first.alias("first"), last.alias("last")).join(schedule(s), ["i", "rank"])
    return rows.select("row", "id", "size", "i", "source_size", "target"), pieces.select("slot", "place", "row", "first", "last")


def taken(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """Per row of docs: id, size, source_size, target, taken: its words in the mix, repeats counted."""
    rows, pieces = mixed(docs, id_col=id_col, **how)
    got = pieces.groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    out = rows.join(got, F.equal_null(rows["row"], got["row"]), "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op13_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 16) as h from documents),
named as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as i from d group by source),
weighed as (select *, [3, 1, 2][i % 3 + 1] as w, 2 * source_size as cap, 1.5 * sum(source_size) over () as total from named),
sorted as (select *, sum(cap) over before as spent, sum(w) over rest as left_w from weighed
  window before as (order by cap / w, i rows between unbounded preceding and 1 preceding), rest as (order by cap / w, i rows between current row and unbounded following)),
level as (select coalesce(arg_min(l, (ratio, i)), 0) as l from (select i, cap / w as ratio, (total - coalesce(spent, 0)) / left_w as l from sorted) where ratio >= l),
aimed as (select source, i, source_size, least(cast(cap as double), l * w) as target, cast(round(least(cast(cap as double), l * w)) as bigint) as words from sorted, level),
laid as (select doc_id, size, source_size, target, words, coalesce(sum(size) over (partition by i order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) as place
  from d join aimed on d.source is not distinct from aimed.source)
select doc_id, size, source_size, target, cast(greatest(0, least(place + size, words) - place) + greatest(0, least(place + source_size + size, words) - place - source_size) as bigint) as taken from laid
"""
