"""Imports: listings, specifier resolution, layer boundaries, the file graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens import schema
from quarrylens.functions.text import contains_ci, normalize_path
from quarrylens.sources.facts import Facts

COLUMNS = ["file_path", "module", "site_line", "site_column"]


def deps(t: Facts, path: str) -> DataFrame:
    """What a file imports."""
    return t.imports.filter(F.col("file_path") == path).select(*COLUMNS).orderBy("site_line", "site_column", "module")


def rdeps(t: Facts, module: str) -> DataFrame:
    """Imports whose specifier contains the text."""
    return t.imports.filter(contains_ci("module", module)).select(*COLUMNS).orderBy("file_path", "site_line", "site_column")


def imports_under(t: Facts, prefix: str) -> DataFrame:
    """Imports of files whose path contains the text."""
    return t.imports.filter(contains_ci("file_path", prefix)).select(*COLUMNS)


def _tried(stem: F.Column) -> F.Column:
    ends = [*schema.IMPORT_SUFFIXES, *(f"/index{e}" for e in schema.IMPORT_SUFFIXES)]
    return F.array(*[F.concat(stem, F.lit(e)) for e in ends])


def _rust_tried(importer: F.Column, spec: F.Column) -> F.Column:
    """Files a Rust path may mean: the longest module prefix first, `x.rs` before `x/mod.rs`."""
    clean = F.rtrim(F.regexp_replace(F.split(spec, "\\{")[0], "[: ,]+$", ""))
    segs = F.filter(F.transform(F.split(clean, "::"), lambda s: F.trim(s)), lambda s: s != "")
    root = F.when(F.contains(importer, F.lit("/src/")), F.concat(F.substring_index(importer, "/src/", 1), F.lit("/src"))).when(F.startswith(importer, F.lit("src/")), F.lit("src"))
    rel = F.regexp_replace(F.substring(importer, F.length(root) + 2, F.length(importer)), "\\.rs$", "")
    own = F.split(rel, "/")
    own = F.when(F.element_at(own, -1).isin("lib", "main", "mod"), F.slice(own, F.lit(1), F.size(own) - 1)).otherwise(own)
    lead = F.size(segs) - F.size(F.aggregate(segs, F.array().cast("array<string>"), lambda acc, s: F.when((F.size(acc) == 0) & s.isin("self", "super"), acc).otherwise(F.concat(acc, F.array(s)))))
    ups = F.size(F.filter(F.slice(segs, F.lit(1), lead), lambda s: s == "super"))
    near = F.concat(F.slice(own, F.lit(1), F.greatest(F.size(own) - ups, F.lit(0))), F.slice(segs, lead + 1, F.size(segs)))
    base = F.when(segs[0] == "crate", F.slice(segs, F.lit(2), F.size(segs))).when(segs[0].isin("self", "super"), near)
    down = F.when(F.size(base) > 0, F.sequence(F.size(base), F.lit(1), F.lit(-1)))
    stem = lambda k: F.concat(root, F.lit("/"), F.array_join(F.slice(base, F.lit(1), k), "/"))
    return F.flatten(F.transform(down, lambda k: F.array(F.concat(stem(k), F.lit(".rs")), F.concat(stem(k), F.lit("/mod.rs")))))


def resolve(t: Facts, imports: DataFrame | None = None) -> DataFrame:
    """(file_path, module, target): the file each specifier means, null where none does; one row for each pair.

    imports: those to resolve, all where it is not given.

    `.` is relative to the importer; Rust importers resolve module paths; others go through the aliases in order.
    The first candidate that is a file wins; a file does not import itself.
    """
    pairs = (t.imports if imports is None else imports).select("file_path", "module").distinct()
    importer, spec = F.col("file_path"), F.col("module")
    folder = F.when(F.contains(importer, F.lit("/")), F.concat(F.regexp_replace(importer, "/[^/]*$", ""), F.lit("/"))).otherwise(F.lit(""))
    none = F.array().cast("array<string>")
    aliased = none
    for key, repl, wild in t.aliases:
        hit = F.startswith(spec, F.lit(key)) if wild else spec == key
        to = F.concat(F.lit(repl), F.substring(spec, len(key) + 1, 1 << 20)) if wild else F.lit(repl)
        aliased = F.concat(aliased, F.when(hit, _tried(normalize_path(to))).otherwise(none))
    tried = (
        F.when(F.startswith(spec, F.lit(".")), _tried(normalize_path(F.concat(folder, spec)))).when(F.endswith(importer, F.lit(".rs")), F.coalesce(_rust_tried(importer, spec), none)).otherwise(aliased)
    )
    asked = pairs.select("file_path", "module", F.posexplode(tried).alias("prio", "path"))
    hit = asked.join(t.files.select("path"), "path").groupBy("file_path", "module").agg(F.min_by("path", "prio").alias("target")).filter("target <> file_path")
    return pairs.join(hit, ["file_path", "module"], "left").select("file_path", "module", "target")


def file_graph(t: Facts) -> DataFrame:
    """Distinct (source, target) files of resolved imports."""
    return resolve(t).filter("target is not null").select(F.col("file_path").alias("source"), "target").distinct()


def external_count(t: Facts) -> DataFrame:
    """How many imports mean no file of the repository."""
    r = t.imports.join(resolve(t).filter("target is not null"), ["file_path", "module"], "left_anti")
    return r.agg(F.count(F.lit(1)).alias("external"))


def boundary(t: Facts, source: str, target: str) -> DataFrame:
    """Imports from one layer into another: by the specifier's text, or by the file it means.

    Repeats of (file, module, line) that the text finds stay; those only the resolver finds appear once.
    """
    under = imports_under(t, source)
    raw = under.filter(contains_ci("module", target))
    known = raw.select("file_path", "module", "site_line").distinct()
    means = resolve(t, under).filter(F.contains("target", F.lit(target)) & F.col("target").isNotNull())
    more = under.join(means, ["file_path", "module"], "left_semi").join(known, ["file_path", "module", "site_line"], "left_anti")
    more = more.groupBy("file_path", "module", "site_line").agg(F.min("site_column").alias("site_column"))
    return raw.unionByName(more).orderBy("file_path", "site_line")


def boundary_unresolved(t: Facts, source: str) -> DataFrame:
    """How many imports of the layer are neither relative nor resolved."""
    under = imports_under(t, source).filter(~F.startswith("module", F.lit(".")))
    lost = under.join(resolve(t, under).filter("target is not null"), ["file_path", "module"], "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("unresolved"))
