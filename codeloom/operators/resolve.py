"""Import resolution (R1-R9): ordered candidates per import, the first known path wins.

Candidates are arrays made of column functions; a join with the known paths and the
least position per import decide. No Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.plans import loops

_EMPTY = "array<string>"
#: Extensions in the order in which they are tried.
_JS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
_INDEX = (".ts", ".tsx", ".js", ".jsx")


def _none() -> Column:
    return F.array().cast(_EMPTY)


def _relative(spec: Column) -> Column:
    return spec.startswith("./") | spec.startswith("../")


def typescript(directory: Column, spec: Column) -> Column:
    """Relative specifiers: the path, the path with an extension, an index file in it."""

    def tried(base: Column) -> Column:
        ends = F.transform(F.array(F.lit(""), *[F.lit(e) for e in _JS]), lambda e: F.concat(base, e))
        indices = F.transform(F.array(*[F.lit("index" + e) for e in _INDEX]), lambda e: scalars.join_path(base, e))
        return F.concat(ends, indices)

    # the base is worked out once, however often it is used
    once = F.transform(F.array(scalars.normalize_path(scalars.join_path(directory, spec))), tried)[0]
    return F.when(_relative(spec), once).otherwise(_none())


def python(directory: Column, spec: Column) -> Column:
    """K leading dots go up k - 1 directories; a module file, else its package; no name: the package itself."""
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    name = F.replace(F.substr(spec, dots + 1), F.lit("."), F.lit("/"))
    up = F.array_join(F.array_repeat(F.lit(".."), dots - 1), "/")
    base = scalars.normalize_path(F.concat_ws("/", directory, up))
    module = scalars.join_path(base, name)
    package = F.array(scalars.join_path(base, F.lit("__init__.py")))
    inside = F.array(F.concat(module, F.lit(".py")), F.concat(module, F.lit("/__init__.py")))
    return F.when(dots > 0, F.when(name == "", package).otherwise(inside)).otherwise(_none())


def go(directory: Column, spec: Column) -> Column:
    """R8."""
    return F.when(_relative(spec), F.array(F.concat(scalars.normalize_path(scalars.join_path(directory, spec)), F.lit(".go")))).otherwise(_none())


def java(spec: Column) -> Column:
    """From the repository's root; wildcards stay unresolved."""
    return F.when(spec.endswith("*"), _none()).otherwise(F.array(F.concat(F.replace(spec, F.lit("."), F.lit("/")), F.lit(".java"))))


def _prefixes(base: Column, rest: Column) -> Column:
    """The longest prefix of segments first; for each a module file, then a module directory."""
    parts = F.split(rest, "::")

    def pair(n: Column) -> Column:
        path = scalars.join_path(base, F.array_join(F.slice(parts, 1, n), "/"))
        return F.array(F.concat(path, F.lit(".rs")), F.concat(path, F.lit("/mod.rs")))

    return F.flatten(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), pair))


def rust(directory: Column, spec: Column, crate_root: Column) -> Column:
    """./m, crate:: (null crate_root: unresolved), super:: (the directory above the file's), self::."""
    module = scalars.join_path(directory, F.substr(spec, F.lit(3)))
    return (
        F.when(spec.startswith("./"), F.array(F.concat(module, F.lit(".rs")), F.concat(module, F.lit("/mod.rs"))))
        .when(spec.startswith("crate::") & crate_root.isNotNull(), _prefixes(crate_root, F.substr(spec, F.lit(8))))
        .when(spec.startswith("super::"), _prefixes(scalars.parent_dir(directory), F.substr(spec, F.lit(8))))
        .when(spec.startswith("self::"), _prefixes(directory, F.substr(spec, F.lit(7))))
        .otherwise(_none())
    )


def ancestors(directory: Column) -> Column:
    """A directory and all above it, deepest first, '' last."""
    parts = F.split(directory, "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(above, F.array(F.lit(""))))


def crate_roots(dirs: DataFrame, known: DataFrame) -> DataFrame:
    """(directory) -> directory, crate_root: the nearest directory from it upwards that holds lib.rs or main.rs."""
    homes = known.filter(F.substring_index("path", "/", -1).isin("lib.rs", "main.rs")).select(scalars.parent_dir(F.col("path")).alias("crate_root")).distinct()
    climbed = dirs.select("directory", F.posexplode(ancestors(F.col("directory"))).alias("_up", "crate_root"))
    return climbed.join(homes, "crate_root").groupBy("directory").agg(F.min_by("crate_root", "_up").alias("crate_root"))


def candidates(language: Column, directory: Column, spec: Column, crate_root: Column) -> Column:
    return (
        F.when(language == "typescript", typescript(directory, spec))
        .when(language == "python", python(directory, spec))
        .when(language == "rust", rust(directory, spec, crate_root))
        .when(language == "go", go(directory, spec))
        .when(language == "java", java(spec))
        .otherwise(_none())
    )


def resolve_imports(imports: DataFrame, known: DataFrame) -> DataFrame:
    """imports (path, language, position, specifier, resolved_path, ...) with resolved_path filled where a candidate is known.

    known: (path). Imports that are resolved already stay as they are.
    """
    placed = imports.withColumn("_directory", scalars.parent_dir(F.col("path")))
    rust_dirs = placed.filter(F.col("language") == "rust").select(F.col("_directory").alias("directory")).distinct()
    roots = loops.small(loops.saved(crate_roots(rust_dirs, known), "roots"))  # imports needn't meet by directory, of which a few may hold most
    roots = roots.select(F.col("directory").alias("_directory"), F.col("crate_root").alias("_root"))
    placed = placed.join(roots, "_directory", "left")
    tried = F.when(F.col("resolved_path").isNull(), candidates(F.col("language"), F.col("_directory"), F.col("specifier"), F.col("_root")))
    each = placed.select("path", "position", F.posexplode(tried).alias("_at", "_candidate"))
    hits = each.join(known.select(F.col("path").alias("_candidate")).distinct(), "_candidate").groupBy("path", "position").agg(F.min_by("_candidate", "_at").alias("_found"))
    out = placed.join(hits, ["path", "position"], "left").withColumn("resolved_path", F.coalesce("resolved_path", "_found"))
    return out.select(imports.columns)


def listed(asts: DataFrame) -> DataFrame:
    """asts -> an import per row: _row (that of the file), path, language, position, specifier, resolved_path, _import."""
    each = asts.select("_row", "path", "language", F.posexplode("imports").alias("_i", "_import"))
    return each.select("_row", "path", "language", F.struct("_row", "_i").alias("position"), F.col("_import.specifier").alias("specifier"), F.col("_import.resolved_path").alias("resolved_path"), F.col("_import").alias("_import"))


def resolve_asts(asts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """asts with resolved_path set inside their imports; repeated rows are kept, and keep their order.

    Each row is given a number once, in a table, and meets its resolved imports by it.
    """
    rows = loops.saved(asts.withColumn("_row", F.monotonically_increasing_id()), "asts")
    known = (rows if known is None else known).select("path")  # the table's, so that nothing is parsed again
    done = resolve_imports(listed(rows), known)
    placed = done.select(F.col("position._row").alias("_row"), F.struct(F.col("position._i").alias("_i"), F.col("_import").withField("resolved_path", F.col("resolved_path")).alias("v")).alias("_e"))
    lists = placed.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list("_e")), lambda e: e["v"]).alias("_resolved"))
    return rows.join(lists, "_row", "left").withColumn("imports", F.coalesce("_resolved", "imports")).select(asts.columns)


def watched(asts: DataFrame) -> DataFrame:
    """(candidate, path): the paths whose coming or going can change how a file's imports resolve.

    These are the candidates of its imports, whether known or not, and for rust's
    crate:: paths the lib.rs and main.rs of all directories above.
    """
    flat = asts.select("path", "language", F.explode(F.transform("imports", lambda i: i["specifier"])).alias("specifier"))
    flat = flat.withColumn("_directory", scalars.parent_dir(F.col("path")))
    above = ancestors(F.col("_directory"))
    crate = (F.col("language") == "rust") & F.col("specifier").startswith("crate::")
    # any directory above may be the crate's root, now or later
    tried = F.when(crate, F.flatten(F.transform(above, lambda d: F.concat(F.array(scalars.join_path(d, F.lit("lib.rs")), scalars.join_path(d, F.lit("main.rs"))), _prefixes(d, F.substr(F.col("specifier"), F.lit(8)))))))
    plain = candidates(F.col("language"), F.col("_directory"), F.col("specifier"), F.lit(None).cast("string"))
    return flat.select(F.explode(F.coalesce(tried, plain)).alias("candidate"), "path").distinct()
