"""Secret scan: pattern spans, and random strings found by a battery of randomness tests.

Every candidate (a run of 20 or more encoded characters that no pattern span holds) gets an inferred encoding, the smallest
alphabet that has all its characters. Under that encoding three tests ask whether it may be random: chi-squared of the
counts in cells of the alphabet against their uniform shares, the runs test (lower and upper half of the alphabet) and the
lag-1 serial correlation; the battery's p-value is three times the least of theirs. The same chi-squared statistic is
measured against the opposite null, prose: with the cells' shares in prose it is noncentral, and the lower tail gives the
p-value of a string of that length and encoding being so near to uniform by chance.

Both decisions are made by Benjamini and Hochberg's procedure within each encoding and class of length, over all distinct
candidates of the corpus: strings that the battery rejects at level REJECT aren't random; of the others those are reported
that the prose null is rejected for at level Q, which bounds the expected share of prose among them. p-values are
counted in bins of a fixed number (their upper ends are used), so no list of candidates is sorted or gathered.

Defined results: null and empty texts have no spans; rows with equal ids are scanned each; extra columns go. Positions are
code points, the end exclusive. A random span may hold shorter pattern spans, none lies inside one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import looked_up, parts, staged, table, text_or_empty

#: Fixed patterns: what each kind matches, which group must be how long.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "maybe": CANDIDATE}
#: The last pattern's place: candidates.
MAYBE = 3
REJECT, Q = 0.01, 0.01
#: Bins of -log10(p), 20 to a decade; lengths in classes by powers of two.
BINS = 400
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Fixed cells of letters, from frequent in prose to rare.
LETTERS = ("etaoin", "shrdlu", "cmwfgypb", "vkjxqz")
#: Fixed table of encodings: pattern, alphabet in order, cells, shares of the cells in prose (of numbers for digits alone).
ENCODINGS = {
    10: (r"^[0-9]+$", DIGITS, ("0", "1", "2345", "6789"), (0.2, 0.2, 0.35, 0.25)),
    26: (r"^([a-z]+|[A-Z]+)$", LOWER, LETTERS, (0.51, 0.295, 0.172, 0.023)),
    16: (r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", ("01234", "56789", "abc", "def"), (0.05, 0.05, 0.45, 0.45)),
    32: (r"^[A-Z2-7]+$", LOWER + "234567", (*LETTERS, "234567"), (0.5, 0.29, 0.17, 0.02, 0.02)),
    36: (r"^([a-z0-9]+|[A-Z0-9]+)$", LOWER + DIGITS, (*LETTERS, DIGITS), (0.46, 0.265, 0.155, 0.02, 0.1)),
    52: (r"^[A-Za-z]+$", UPPER + LOWER, (*LETTERS, UPPER), (0.46, 0.265, 0.155, 0.02, 0.1)),
    62: (r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, (*LETTERS, UPPER, DIGITS), (0.43, 0.25, 0.145, 0.02, 0.08, 0.075)),
    64: (r"", UPPER + LOWER + DIGITS + "+/", (*LETTERS, UPPER, DIGITS, "+/"), (0.41, 0.235, 0.135, 0.02, 0.07, 0.05, 0.08)),
}
SPAN = "struct<s:int,e:int,m:string>"
#: Candidates are joined by 128 bits of their hash, whatever their length.
KEY = ["h1", "h2"]


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _found(text: str, pattern: str) -> Column:
    """array<struct<g, m>>: how many characters lie before each of the leftmost non-overlapping matches, since the one before, and the match; at last what follows them, without one."""
    gaps = F.transform(F.split(F.col(text), pattern, -1), F.length)
    return F.zip_with(gaps, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))


def _normal_sf(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17, relative error below 1e-3 where used)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _encodings() -> Column:
    """Map of an encoding's number to its alphabet, the cell and half of each of its characters, the cells' shares, and how far prose is from them."""

    def entry(k: int) -> Column:
        _, alphabet, cells, prose = ENCODINGS[k]
        cell = "".join(str(next(i for i, c in enumerate(cells) if x in c)) for x in alphabet)
        shares = [len(c) / len(alphabet) for c in cells]
        far = sum((p - u) ** 2 / u for p, u in zip(prose, shares, strict=True))
        half = "0" * ((len(alphabet) + 1) // 2) + "1" * (len(alphabet) // 2)
        values = {"ab": alphabet, "cell": cell, "half": half, "far": far, "df": float(len(cells) - 1)}
        return F.struct(*(F.lit(v).alias(n) for n, v in values.items()), F.array(*map(F.lit, shares)).alias("share"))

    return F.create_map(*(x for k in ENCODINGS for x in (F.lit(k), entry(k))))


def tested(c: DataFrame) -> DataFrame:
    """c (…, m: a candidate) with its encoding k, its length n, p_uniform, p_runs, p_serial, p_battery and p_prose."""
    k = F.lit(64)
    for kind in reversed(list(ENCODINGS)):
        if kind != 64:
            k = F.when(F.col("body").rlike(ENCODINGS[kind][0]), kind).otherwise(k)
    c = c.withColumn("body", F.regexp_replace("m", "=+$", "")).withColumn("k", k).withColumn("e", F.element_at(_encodings(), F.col("k")))
    c = c.withColumn("body", F.when(F.col("k").isin(10, 16, 26, 32, 36), F.lower("body")).when(F.col("k") == 64, F.translate("body", "-_", "+/")).otherwise(F.col("body")))
    c = c.withColumn("n", F.length("body").cast("double")).withColumn("cells", F.expr("translate(body, e.ab, e.cell)")).withColumn("halves", F.expr("translate(body, e.ab, e.half)"))
    # chi-squared of the counts in the cells against uniform shares; its tail by Wilson and Hilferty's cube root
    count = "(n - length(replace(cells, cast(i as string), '')) - n * u)"
    c = c.withColumn("chi", F.expr(f"aggregate(transform(e.share, (u, i) -> {count} * {count} / (n * u)), 0D, (a, x) -> a + x)"))
    df = F.col("e.df")
    uniform = (F.pow(F.col("chi") / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    # the lower tail of the noncentral chi-squared that the cells' shares in prose give, by the cube root of Abdel-Aty
    lam = F.col("n") * F.col("e.far")
    v = 2 * (1 + lam / (df + lam)) / (9 * (df + lam))
    prose = (1 - v - F.pow(F.col("chi") / (df + lam), F.lit(1 / 3))) / F.sqrt(v)
    up = F.length(F.replace("halves", F.lit("0"), F.lit("")))
    # no two places where 01 (or 10) stands overlap
    turns = (2 * F.length("halves") - F.length(F.replace("halves", F.lit("01"), F.lit(""))) - F.length(F.replace("halves", F.lit("10"), F.lit("")))) / 2
    c = c.withColumn("up", up.cast("double")).withColumn("runs", turns + 1)
    mu = 2 * F.col("up") * (F.col("n") - F.col("up")) / F.col("n") + 1
    var = (mu - 1) * (mu - 2) / (F.col("n") - 1)
    runs = F.when(var > 0, (F.col("runs") - mu) / F.sqrt(var)).otherwise(F.lit(99.0))
    c = c.withColumn("v", F.expr("transform(split(body, ''), x -> cast(locate(x, e.ab) as double))"))
    c = c.withColumn("mean", F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.col("n"))
    c = c.withColumn("ss", F.expr("aggregate(v, 0D, (a, x) -> a + (x - mean) * (x - mean))"))
    lag = F.expr("aggregate(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (x, y) -> (x - mean) * (y - mean)), 0D, (a, x) -> a + x)")
    serial = F.when(F.col("ss") > 0, F.abs(lag / F.col("ss") + 1 / F.col("n")) * F.sqrt("n")).otherwise(F.lit(99.0))
    c = c.withColumns({"z_uniform": uniform, "z_prose": prose, "z_runs": F.abs(runs), "z_serial": serial})
    c = c.withColumns({"p_uniform": _normal_sf(F.col("z_uniform")), "p_prose": _normal_sf(F.col("z_prose")), "p_runs": 2 * _normal_sf(F.col("z_runs")), "p_serial": 2 * _normal_sf(F.col("z_serial"))})
    scratch = ("body", "e", "cells", "halves", "chi", "up", "runs", "v", "mean", "ss", "z_uniform", "z_prose", "z_runs", "z_serial")
    return c.withColumn("p_battery", F.least(F.lit(1.0), 3 * F.least("p_uniform", "p_runs", "p_serial"))).drop(*scratch)


def _bin(p: str) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * 20), F.lit(BINS)).cast("int")


def _cut(c: DataFrame, bins: str, level: float) -> DataFrame:
    """(k, size, cut): the bin from which on Benjamini and Hochberg reject, for each encoding and class of length; a row for each at most."""
    hist = c.groupBy("k", "size", F.col(bins).alias("bin")).agg(F.sum("one").alias("c"))
    by = W.partitionBy("k", "size")
    hist = hist.withColumn("rank", F.sum("c").over(by.orderBy(F.desc("bin")))).withColumn("m", F.sum("c").over(by))
    return hist.filter(F.pow(F.lit(10.0), -F.col("bin") / 20) * F.col("m") <= level * F.col("rank")).groupBy("k", "size").agg(F.min("bin").alias("cut"))


def random_strings(candidates: DataFrame) -> DataFrame:
    """(h1, h2, c) of the distinct candidates (m, h1, h2, c) that are no prose and that the battery doesn't reject."""
    t = staged(tested(candidates).select(*KEY, "c", "k", F.floor(F.log2("n")).cast("int").alias("size"), _bin("p_battery").alias("battery"), _bin("p_prose").alias("prose"), F.lit(1).alias("one")))
    # a few dozen encodings and classes of length
    good = t.join(F.broadcast(_cut(t, "prose", Q)), ["k", "size"]).filter("prose >= cut").drop("cut")
    good = good.join(F.broadcast(_cut(t, "battery", REJECT)), ["k", "size"], "left").filter("cut is null or battery < cut")
    return good.select(*KEY, "c")


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: row (its number), id and what each pattern finds."""
    d = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    d = d.select("id", *(_found("text", p).alias(k) for k, p in PATTERNS.items()))
    return staged(d.withColumn("row", F.monotonically_increasing_id()))


def placed(found: DataFrame) -> DataFrame:
    """(row, kind, s, e, m) of the matches of scanned rows that count: base spans, and candidates that lie in none of them.

    Places are sums over a text's matches, taken row by row, so the work for a text is in proportion to its matches."""
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), F.col(k).alias("found")) for i, k in enumerate(PATTERNS)))
    each = found.select("row", F.explode(kinds).alias("k")).select("row", "k.kind", F.posexplode("k.found").alias("pos", "x")).filter("x.m is not null").select("row", "kind", "pos", "x.g", "x.m")
    so_far = W.partitionBy("row", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("e", F.sum(F.col("g") + F.length("m")).over(so_far).cast("int")).withColumn("s", F.col("e") - F.length("m"))
    short = (F.col("kind") == 0) & (F.length(F.regexp_extract("m", ASSIGN, 2)) < 12)
    # a pattern's own matches are found already
    plain = (F.col("kind") == MAYBE) & F.col("m").rlike(f"^({HEX}|{ACCESS})$")
    each = each.filter(~short & ~plain)
    # a candidate lies in a base span if one that doesn't begin after it has an end as far
    before = W.partitionBy("row").orderBy("s", "kind").rowsBetween(W.unboundedPreceding, 0)
    far = F.max(F.when(F.col("kind") < MAYBE, F.col("e"))).over(before)
    return each.withColumn("far", far).filter((F.col("kind") < MAYBE) | F.col("far").isNull() | (F.col("far") < F.col("e"))).select("row", "kind", "s", "e", "m")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, assign, access, hex and random spans (s, e, m)."""
    found = scanned(docs, id_col, text_col)
    empty = ~F.exists(F.array(*(F.size(k) > 1 for k in PATTERNS)), lambda x: x)
    # rows are known by their number in the scanned table, so a text isn't repeated with each of its matches
    each = staged(placed(found.filter(~empty)).withColumns({"h1": F.when(F.col("kind") == MAYBE, F.xxhash64("m")), "h2": F.when(F.col("kind") == MAYBE, F.xxhash64(F.lit(17), "m"))}))
    maybe = each.filter(F.col("kind") == MAYBE)
    good = staged(random_strings(maybe.groupBy(*KEY, "m").agg(F.count(F.lit(1)).alias("c"))))
    kept = each.filter(F.col("kind") < MAYBE).drop(*KEY).unionByName(looked_up(maybe, good, KEY, parts(docs)).drop(*KEY))
    names = ("assign", "access", "hex", "random")
    spans = [F.array_sort(F.collect_list(F.when(F.col("kind") == i, F.struct("s", "e", "m")))).alias(k) for i, k in enumerate(names)]
    out = found.filter(~empty).select("row", "id").join(kept.groupBy("row").agg(*spans), "row", "left").select("id", *(F.coalesce(k, _none()).alias(k) for k in names))
    out = out.unionByName(found.filter(empty).select("id", *(_none().alias(k) for k in names)))
    return out.withColumnRenamed("id", id_col)


def _joined(*kinds: str) -> Column:
    """kind:start:end of all spans by start, then kind as listed."""
    def named(i: int, k: str) -> Column:
        return F.transform(k, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string")).alias("t")))

    each = [named(i, k) for i, k in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: x["t"]), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents"))
    n = {f"n_{k}": F.size(k).cast("long") for k in ("assign", "access", "hex")}
    return d.select("doc_id", *(c.alias(k) for k, c in n.items()), F.sha2(_joined("assign", "access", "hex"), 256).alias("base_sha256"), _joined("assign", "access", "hex", "random").alias("spans"))
