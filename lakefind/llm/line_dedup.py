"""Line deduplication by a suffix array over line ids, built by distributed prefix doubling.

Positions are the non-blank lines of all distinct texts. A position's name at level k stands for its 2**k lines from there
on; names at level k + 1 come from the names at level k of the position and of the one 2**k lines on, so each round
doubles the depth. Positions of one name are an interval of the suffix array whose longest common prefix is 2**k lines or
more. Only positions whose name occurs again go on (the others are intervals of one suffix), until no name repeats.

The exact longest common prefixes follow from the levels, deepest first: in an interval of w common lines the first
positions of its sub-intervals are told apart by the names of the lines behind (w + 2**j of them, j falling to 0), so
that each position ends in the deepest interval in which it isn't the earliest one. The depth of that interval is the
length of the longest run that starts there and occurs earlier, by (document, line); runs that can't be extended to the
left either are the maximal repeated runs. A run is deleted as a later copy if it has `min_lines` lines, or has a line of
`min_chars` characters.

Copies of a whole text are settled first: all but the row of the least id are later copies from their first line on, so
large groups of copies never reach the rounds. Names that very many positions share are looked up from a broadcast of
bounded size, so no task gathers them.

Defined results: lines are split at \\n and compared without the white space around them (0x20, 0x09, 0x0B-0x0D); blank
lines are never counted nor deleted. Null text is empty. Rows with the same id and text are one document; a null id comes
before all others. Extra columns stay, but for the names __kept, __n_lines and __n_removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import looked_up, parts, staged, table, text_or_empty

KEY = ["id", "th"]
PLACE = [*KEY, "pos"]
NAME = ["n1", "n2"]
BLANKS = " \t\x0b\x0c\r"
#: Rows whose repeated names, half as many at most, are broadcast without being counted first.
SMALL = 1 << 17


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _place() -> Column:
    return F.struct(*PLACE)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    # the least number stands for a null id
    ident = F.coalesce(F.col(id_col), F.lit(-(2**63)).cast(dict(docs.dtypes)[id_col]))
    return docs.withColumns({"__id": ident, "__th": F.xxhash64(text), "__th2": F.xxhash64(F.lit(17), text), "__lines": F.split(text, "\n", -1)})


class Lines:
    """The lines of docs: `first` (id, th, pos, at, big, n1, n2), those of one row for each distinct text; `copies` (id, th, whole), the other rows."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, min_lines: int, min_chars: int):
        self.n_parts = parts(docs)
        each = F.filter(F.transform("__lines", lambda x, i: F.struct(i.alias("at"), _bare(x).alias("line"))), lambda s: s["line"] != "")
        hashed = F.transform(each, lambda s: F.struct(s["at"].alias("at"), (F.length(s["line"]) >= min_chars).alias("big"), F.xxhash64(s["line"]).alias("n1"), F.xxhash64(F.lit(29), s["line"]).alias("n2")))
        d = _keyed(docs, id_col, text_col).select(F.col("__id").alias("id"), F.col("__th").alias("th"), F.col("__th2").alias("th2"), hashed.alias("s"))
        d = staged(d)
        same = staged(d.groupBy("th", "th2").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("least")).filter("c > 1"))
        d = looked_up(d, same, ["th", "th2"], self.n_parts, "left")
        once = d.filter("least is null").unionByName(d.filter("id = least").dropDuplicates(KEY))
        self.first = staged(once.select("id", "th", F.posexplode("s").alias("pos", "s")).select("id", "th", "pos", "s.*"))
        self.copies = d.filter("id > least").select("id", "th", (F.exists("s", lambda x: x["big"]) | (F.size("s") >= min_lines)).alias("whole")).distinct()


def _hashed(*cols: str) -> list[Column]:
    return [F.xxhash64(*cols).alias("n1"), F.xxhash64(F.lit(31), *cols).alias("n2")]


def _firsts(names: DataFrame, small: bool, n_parts: int) -> DataFrame:
    """names (staged) with c, how many rows have the name, and first, the earliest place of them; null where the name occurs once."""
    first = names.groupBy(*NAME).agg(F.count(F.lit(1)).alias("c"), F.min(_place()).alias("first")).filter("c > 1")
    if small:  # at most SMALL / 2 rows
        return names.join(F.broadcast(first), NAME, "left")
    return looked_up(names, staged(first.withColumn("n", F.col("c"))), NAME, n_parts, "left").withColumnRenamed("n", "c")


def levels(first: DataFrame, n_parts: int) -> list[DataFrame]:
    """The intervals (place, n1, n2, first) of 1, 2, 4, … lines, up to the deepest that repeat."""
    out, names, rows = [], first.select(*PLACE, *NAME), first.count()
    while rows:
        found = staged(_firsts(staged(names), rows <= SMALL, n_parts).filter("c > 1").select(*PLACE, *NAME, "first"))
        rows = found.count()
        if rows:
            out.append(found)
        step = 1 << (len(out) - 1 if out else 0)
        on = F.first(F.struct(*NAME)).over(W.partitionBy(*KEY).orderBy("pos").rangeBetween(step, step))
        names = found.select(*PLACE, *NAME, on.alias("m")).filter("m is not null").select(*PLACE, *_hashed("n1", "n2", "m.n1", "m.n2"))
    return out


def longest(found: list[DataFrame], n_parts: int) -> DataFrame | None:
    """(place, w, first): for every position that occurs earlier, the lines of the longest run from there on that does, and its earliest place."""
    state = None
    for j in range(len(found) - 1, -1, -1):
        t = found[j]
        if state is not None:
            small = state.count() <= SMALL
            on = t.select(*KEY, F.col("pos").alias("to"), F.col("n1").alias("m1"), F.col("n2").alias("m2"))
            x = state.withColumn("to", F.col("pos") + F.col("w")).join(on, [*KEY, "to"], "left").drop("to")
            x = x.withColumnsRenamed({"n1": "c1", "n2": "c2", "first": "f"}).select("*", *_hashed("c1", "c2", "m1", "m2"))
            x = staged(x)
            x = _firsts(x.filter("m1 is not null"), small, n_parts).unionByName(x.filter("m1 is null"), allowMissingColumns=True)
            shared = F.coalesce(F.col("m1").isNotNull() & (F.col("c") > 1), F.lit(False))
            deeper = F.struct((F.col("w") + (1 << j)).alias("w"), *NAME, "first")
            # the first of each sub-interval stands for it
            same = F.struct("w", F.col("c1").alias("n1"), F.col("c2").alias("n2"), F.col("f").alias("first"))
            none = F.lit(None)
            both = F.array(F.when(shared, deeper).otherwise(none), F.when(shared & (_place() > F.col("first")), none).otherwise(same))
            state = x.select(*PLACE, F.explode(F.filter(both, lambda v: v.isNotNull())).alias("v")).select(*PLACE, "v.*")
        # positions that are the first of their interval one level deeper
        enter = t
        if j + 1 < len(found):
            enter = t.join(found[j + 1].filter(_place() > F.col("first")).select(*PLACE), PLACE, "left_anti")
        enter = enter.select(*PLACE, F.lit(1 << j).alias("w"), *NAME, "first")
        state = staged(enter if state is None else state.unionByName(enter))
    return None if state is None else state.filter(_place() > F.col("first")).select(*PLACE, "w", "first")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, pos, lines, first): the maximal runs of lines of each distinct text that occur earlier; pos counts non-blank lines."""
    x = Lines(docs, id_col, text_col, 1, 1)
    far = longest(levels(x.first, x.n_parts), x.n_parts)
    if far is None:
        return x.first.select(*PLACE, F.lit(0).alias("lines"), _place().alias("first")).limit(0)
    left = F.first("w").over(W.partitionBy(*KEY).orderBy("pos").rangeBetween(-1, -1))
    return far.withColumn("left", F.coalesce(left, F.lit(0))).filter("left <= w").select(*PLACE, F.col("w").alias("lines"), "first")


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, min_chars: int = 30) -> DataFrame:
    """(id, th, gone, whole): places of the lines of each document that are later copies; whole: all of its lines are."""
    x = Lines(docs, id_col, text_col, min_lines, min_chars)
    found = levels(x.first, x.n_parts)
    out = x.copies.filter("whole").select("id", "th", F.array().cast("array<int>").alias("gone"), "whole")
    far = longest(found, x.n_parts)
    if far is None:
        return out
    # lines of a repeated run are repeated themselves, so the first level holds them all
    rows = x.first.select(*PLACE, "at", "big").join(found[0].select(*PLACE), PLACE, "left_semi").join(far.select(*PLACE, "w"), PLACE, "left")
    by = W.partitionBy(*KEY)
    rows = rows.withColumn("next_big", F.min(F.when(F.col("big"), F.col("pos"))).over(by.orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)))
    end = F.col("pos") + F.col("w")
    enough = (F.col("w") >= min_lines) | (F.col("next_big") < end)
    rows = rows.withColumn("to", F.max(F.when(enough, end)).over(by.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    gone = rows.filter("to > pos").groupBy(*KEY).agg(F.collect_set("at").alias("gone"))
    return out.unionByName(gone.withColumn("whole", F.lit(False)))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, min_chars: int = 30) -> DataFrame:
    """docs with __kept (the text without later copies), __n_lines and __n_removed (non-blank lines)."""
    gone = later_copies(docs, id_col, text_col, min_lines, min_chars).select(F.col("id").alias("__gid"), F.col("th").alias("__gth"), F.col("gone").alias("__gone"), F.col("whole").alias("__whole"))
    d = _keyed(docs, id_col, text_col)
    d = d.join(gone, (F.col("__id") == F.col("__gid")) & (F.col("__th") == F.col("__gth")), "left")
    places = F.sequence(F.lit(0), F.size("__lines") - 1)
    full = F.filter(places, lambda i: _bare(F.get("__lines", i)) != "")
    d = d.withColumn("__gone", F.when(F.col("__whole"), full).otherwise(F.col("__gone")))
    left = F.array_except(places, "__gone")
    kept = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n"))
    return d.withColumns({"__kept": kept, "__n_lines": F.size(full).cast("long"), "__n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")}).drop("__id", "__th", "__th2", "__lines", "__gid", "__gth", "__gone", "__whole")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("__kept", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as idx from documents),
p as (
  select doc_id, idx, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as line, length(trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) >= 30 as big, row_number() over (partition by doc_id order by idx) as pos from l where trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
w as (
  select *, lead(line, 1) over d as l1, lead(line, 2) over d as l2, lead(big, 1) over d as b1, lead(idx, 1) over d as ia, lead(idx, 2) over d as ib
  from p window d as (partition by doc_id order by pos)),
r as (
  select *, row_number() over (partition by line order by doc_id, pos) > 1 as r1,
    l1 is not null and row_number() over (partition by line, l1 order by doc_id, pos) > 1 as r2,
    l2 is not null and row_number() over (partition by line, l1, l2 order by doc_id, pos) > 1 as r3 from w),
gone as (
  select doc_id, idx from r where r1 and big
  union select doc_id, unnest([idx, ia]) from r where r2 and (big or b1)
  union select doc_id, unnest([idx, ia, ib]) from r where r3),
kept as (
  select l.doc_id, string_agg(raw, chr(10) order by idx) as kept from l where not exists (select 1 from gone g where g.doc_id = l.doc_id and g.idx = l.idx) group by l.doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_lines, coalesce(g.n, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from documents d
left join (select doc_id, count(*) as n from p group by 1) n on n.doc_id = d.doc_id
left join (select doc_id, count(*) as n from gone group by 1) g on g.doc_id = d.doc_id
left join kept k on k.doc_id = d.doc_id
"""
