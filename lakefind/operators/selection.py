"""What users choose: paths, ordered edits, formats, trees of folders, registration of libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import catalog

#: Fixed sets of formats: text, and those that need conversion.
TEXT, BINARY = ["md", "txt", "markdown"], ["pdf", "docx"]


def fault(text: Column | str) -> Column:
    return F.raise_error(F.lit(text) if isinstance(text, str) else text)


def path_fault(path: Column) -> Column:
    """Why a path can't be chosen, else null: absolute, of a drive or home, empty, or with blank or dotted parts."""
    p = F.translate(F.trim(F.coalesce(path, F.lit(""))), "\\", "/")
    parts = F.split(F.btrim(p, F.lit("/")), "/", -1)
    return F.when(p.rlike(r"^(/|~|[A-Za-z]:)"), "not relative").when(F.btrim(p, F.lit("/")) == "", "empty").when(F.exists(parts, lambda x: F.trim(x).isin("", ".", "..")), "blank or dotted part")


def chosen_path(path: Column) -> Column:
    """The path as it is kept: slashes, no blanks around its parts. Raises on paths that can't be chosen."""
    p = F.btrim(F.translate(F.trim(path), "\\", "/"), F.lit("/"))
    clean = F.array_join(F.transform(F.split(p, "/", -1), F.trim), "/")
    return F.when(path_fault(path).isNotNull(), fault(F.concat(path_fault(path), F.lit(": "), path)).cast("string")).otherwise(clean)


def applied(selection: DataFrame, changes: DataFrame) -> DataFrame:
    """(library_id, selection_in, selection_out) after changes (library_id, seq, path, action in/out/neutral): the last one of a path counts, new entries come last in their order."""
    c = changes.withColumn("path", chosen_path(F.col("path")))
    last = c.groupBy("library_id", "path").agg(F.max_by(F.struct("action", "seq"), "seq").alias("s")).select("library_id", "path", "s.*")
    put = last.groupBy("library_id").agg(F.collect_list("path").alias("__all"), *(F.transform(F.array_sort(F.collect_list(F.when(F.col("action") == a, F.struct("seq", "path")))), lambda s: s["path"]).alias(f"__{a}") for a in ("in", "out")))
    x = selection.join(put, "library_id", "left")
    none = F.array().cast("array<string>")
    for a in ("in", "out"):
        kept = F.filter(f"selection_{a}", lambda p: ~F.array_contains(F.coalesce("__all", none), p))
        x = x.withColumn(f"selection_{a}", F.concat(kept, F.coalesce(f"__{a}", none)))
    return x.drop("__all", "__in", "__out")


def blocked(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """Changes that would choose a path that is itself an excluded folder."""
    x = changes.filter("action = 'in'").join(rules.select("library_id", "exclude_dirs"), "library_id")
    return x.filter(F.exists("exclude_dirs", lambda e: F.btrim(F.translate(e, "\\", "/"), F.lit("/ ")) == F.col("path"))).drop("exclude_dirs")


def _of_format(path: Column, exts: Column) -> Column:
    return F.exists(exts, lambda e: F.endswith(F.lower(path), F.concat(F.lit("."), F.lower(F.ltrim(e, F.lit("."))))))


def formats_switched(selection: DataFrame, old: Column, new: Column) -> DataFrame:
    """selection after a change of formats: chosen files of a format that goes are left out, files left out of one that comes follow the default again. moved: entries touched."""
    gone, come = F.array_except(old, new), F.array_except(new, old)
    none = F.array().cast("array<string>")
    x = selection.withColumn("__m", F.filter("selection_in", lambda p: _of_format(p, gone)))
    out = F.concat("selection_out", F.array_except("__m", "selection_out"))
    x = x.withColumn("selection_in", F.filter("selection_in", lambda p: ~_of_format(p, gone))).withColumn("__out", out)
    x = x.withColumn("selection_out", F.filter("__out", lambda p: ~_of_format(p, come)))
    return x.withColumn("moved", F.size(F.coalesce("__m", none)) + F.size("__out") - F.size("selection_out")).drop("__m", "__out")


def allowed_extensions(agent: Column, enabled: Column) -> Column:
    """Formats that an agent may read: plain text, and the binary ones that are granted and on."""
    bare = lambda c: F.transform(c, lambda e: F.lower(F.ltrim(e, F.lit("."))))
    binary = F.array_intersect(F.array_intersect(bare(agent), bare(enabled)), F.array(*map(F.lit, BINARY)))
    return F.transform(F.array_union(F.array(F.lit("md"), F.lit("txt")), binary), lambda e: F.concat(F.lit("."), e))


def pending_formats(included: DataFrame, rules: DataFrame) -> DataFrame:
    """(library_id, ext, n): included files of binary formats that are on but not granted to agents. rules (library_id, agent_formats, enabled_extensions)."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    x = included.withColumn("ext", ext).filter(F.col("ext").isin(BINARY)).join(rules, "library_id")
    has = lambda c: F.exists(c, lambda e: F.lower(F.ltrim(e, F.lit("."))) == F.col("ext"))
    return x.filter(has("enabled_extensions") & ~has("agent_formats")).groupBy("library_id", "ext").agg(F.count(F.lit(1)).alias("n"))


def granted(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """rows (library_id, path, …) of the formats that are granted; allowed (library_id, ext)."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return rows.withColumn("__ext", ext).join(allowed.select("library_id", F.lower("ext").alias("__ext")).distinct(), ["library_id", "__ext"], "left_semi").drop("__ext")


def tree(files: DataFrame, rules: DataFrame, below: str = "") -> DataFrame:
    """(library_id, path, name, is_dir, state, files, chosen): files and folders one level below a folder.

    state: in or out if the path itself (or a folder above it) was chosen, else auto_in or auto_out; root if none is below.
    """
    d = catalog.decide(files.select("library_id", "path").distinct(), rules)
    under = d.filter(F.lit(below == "") | F.startswith("path", F.lit(below + "/"))).withColumn("__rest", F.substr("path", F.lit(len(below) + 2 if below else 1)))
    top = F.substring_index("__rest", "/", 1)
    x = under.withColumn("name", top).withColumn("is_dir", F.contains("__rest", F.lit("/")))
    g = x.groupBy("library_id", "name", "is_dir").agg(F.count(F.lit(1)).alias("files"), F.count_if("included").alias("chosen"))
    g = g.withColumn("path", F.concat(F.lit(below + "/" if below else ""), F.col("name"))).join(rules.select("library_id", "selection_in", "selection_out"), "library_id")
    parts = F.split("path", "/")
    up = F.reverse(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    near = F.get(F.filter(F.transform(up, lambda p: F.when(F.array_contains("selection_out", p), "out").when(F.array_contains("selection_in", p), "in")), lambda s: s.isNotNull()), F.lit(0))
    return g.withColumn("state", F.coalesce(near, F.when(F.col("chosen") > 0, "auto_in").otherwise("auto_out"))).drop("selection_in", "selection_out")


#: Fixed limits of a library's name: its length, characters that it can't have.
NAME_CHARS, NAME_BAD = 64, r'[\\/:*?"<>|\x00-\x1f]'


def registration_faults(libraries: DataFrame) -> DataFrame:
    """(library_id, fault) of libraries (library_id, name, root_path, enabled_extensions, agent_formats, exclude_dirs, selection_in) that can't be registered together."""
    x = libraries.withColumn("__root", F.rtrim(F.translate(F.lower("root_path"), "\\", "/"), F.lit("/")))
    for c in ("library_id", "__root"):
        x = x.withColumn(f"__n_{c}", F.count(F.lit(1)).over(W.partitionBy(c)))
    name = F.trim(F.coalesce("name", F.lit("")))
    grants = F.array_except(F.transform("agent_formats", lambda e: F.lower(F.ltrim(e, F.lit(".")))), F.transform("enabled_extensions", lambda e: F.lower(F.ltrim(e, F.lit(".")))))
    faults = F.array_compact(F.array(
        F.when((name == "") | name.rlike(NAME_BAD) | F.contains("library_id", F.lit(":")), "name"),
        F.when(F.length(name) > NAME_CHARS, "name too long"), F.when(F.col("__n_library_id") > 1, "id taken"), F.when(F.col("__n___root") > 1, "folder taken"),
        F.when(F.size(F.array_intersect("selection_in", "exclude_dirs")) > 0, "chosen and excluded"), F.when(F.size(grants) > 0, "grant of a format that is off"),
    ))
    return x.select("library_id", F.explode(faults).alias("fault"))


def migrated(old: DataFrame) -> DataFrame:
    """Old registry rows (name, path, seq, …) with library_id: a slug of the name, numbered where it is taken."""
    slug = F.btrim(F.regexp_replace(F.lower(F.trim(F.col("name"))), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))
    x = old.withColumn("__s", F.when(slug == "", "library").otherwise(slug))
    n = F.row_number().over(W.partitionBy("__s").orderBy("seq"))
    return x.withColumn("library_id", F.when(n == 1, F.col("__s")).otherwise(F.concat_ws("-", "__s", n.cast("string")))).drop("__s")
