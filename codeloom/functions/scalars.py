"""Scalar functions, Column to Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File names that start a program.
ENTRY_POINTS = (
    "main.rs", "lib.rs", "mod.rs", "index.ts", "index.tsx", "index.js", "index.jsx",
    "main.ts", "main.js", "main.py", "__main__.py", "app.ts", "app.js",
)

#: File extensions of each language.
EXTENSIONS = {"typescript": ("ts", "tsx", "js", "jsx", "mjs", "cjs"), "python": ("py",), "rust": ("rs",), "go": ("go",), "java": ("java",)}

#: Display colours.
LANGUAGE_COLORS = {"typescript": "#3b82f6", "python": "#f97316", "rust": "#22c55e", "go": "#06b6d4", "java": "#ef4444"}
EDGE_COLORS = {"Import": "#64748b", "DynamicImport": "#64748b", "Call": "#3b82f6", "Inheritance": "#a855f7", "ReExport": "#94a3b8"}
DEFAULT_COLOR = "#6366f1"


def basename(path: Column) -> Column:
    """last segment, the whole path where that is empty."""
    last = F.substring_index(path, "/", -1)
    return F.when(last == "", path).otherwise(last)


def extension(path: Column) -> Column:
    """Extension of the file name; '' for none, and for names that only start with a dot."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"^.+\.([^.]+)$", 1)


def detect_language(path: Column) -> Column:
    """language by extension, case-sensitive; null for others."""
    ext = extension(path)
    out = None
    for language, names in EXTENSIONS.items():
        out = (F if out is None else out).when(ext.isin(*names), language)
    return out


def node_id(key: Column) -> Column:
    """first 16 hex digits of the key's digest."""
    return F.substring(F.sha2(key, 256), 1, 16)


def function_key(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit("::fn::"), name)


def class_key(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit("::class::"), name)


def is_entry_point(path: Column) -> Column:
    """F5."""
    return F.substring_index(path, "/", -1).isin(*ENTRY_POINTS)


def declared_loc(start: Column, end: Column) -> Column:
    """lines from start to end, 1 at least."""
    return F.greatest(end - start, F.lit(0)) + 1


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    """F7; the target of an unresolved edge is its specifier."""
    return F.concat(source, F.lit("→"), target, F.lit(":"), kind)


def unresolved(specifier: Column) -> Column:
    return F.concat(F.lit("unresolved:"), specifier)


def iso_seconds(ts: Column) -> Column:
    """F8: UTC seconds; the session's time zone is taken as UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parent_dir(path: Column) -> Column:
    """'' where there is no slash."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def directory(path: Column) -> Column:
    """'.' where there is no slash."""
    return F.when(F.instr(path, "/") > 0, parent_dir(path)).otherwise(F.lit("."))


def join_path(base: Column, name: Column) -> Column:
    """F11."""
    return F.when(base == "", name).otherwise(F.concat_ws("/", base, name))


def normalize_path(path: Column) -> Column:
    """drops empty segments and '.', resolves '..'; going above the root does nothing."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when((part == "") | (part == "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def strip_quotes(text: Column, quotes: str = "\"'`") -> Column:
    """one pair of equal quotes around the text."""
    return F.regexp_replace(text, f"(?s)^([{quotes}])(.*)\\1$", "$2")


def capitalize(text: Column) -> Column:
    """first ASCII letter in upper case, the rest as it is."""
    first = F.substring(text, 1, 1)
    return F.concat(F.when(first.rlike("^[a-z]$"), F.upper(first)).otherwise(first), F.substr(text, F.lit(2)))


def html_escape(text: Column) -> Column:
    """F15."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def matches(label: Column, path: Column, query: str) -> Column:
    """F16: query within label or path, in any case."""
    q = F.lower(F.lit(query))
    return F.contains(F.lower(label), q) | F.contains(F.lower(path), q)


def node_size(loc: Column) -> Column:
    """radius 8 to 32, logarithmic in the lines."""
    return F.when(loc > 0, F.least(F.greatest(8 + F.log(loc + F.lit(1.0)) / F.log(F.lit(2001.0)) * 24, F.lit(8.0)), F.lit(32.0))).otherwise(F.lit(8.0))


def lighten(color: Column, factor: float) -> Column:
    """a hex colour moved towards white."""

    def part(at: int) -> Column:
        value = F.conv(F.substring(color, at, 2), 16, 10).cast("double")
        return F.lpad(F.lower(F.hex(F.floor(value + (255 - value) * factor + 0.5).cast("long"))), 2, "0")

    return F.concat(F.lit("#"), part(2), part(4), part(6))


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def language_color(language: Column) -> Column:
    return _lookup(language, LANGUAGE_COLORS, DEFAULT_COLOR)


def edge_color(kind: Column) -> Column:
    return _lookup(kind, EDGE_COLORS, "#64748b")


def lattice(position: Column, count: Column) -> tuple[Column, Column]:
    """x and y of a position (from 0) on a Fibonacci lattice of count points."""
    import math

    turn = math.pi * (3 - math.sqrt(5))
    radius = F.greatest(F.lit(10.0), F.sqrt(count) * 2.5) * F.sqrt((position + 0.5) / count)
    return radius * F.cos(position * F.lit(turn)), radius * F.sin(position * F.lit(turn))


def snapshot_size(exports: Column) -> Column:
    return 4 + F.least(F.lit(8.0), F.size(F.coalesce(exports, F.array().cast("array<string>"))) * 0.5)


def relative_path(path: Column, root: str) -> Column:
    """F20."""
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(path)


def ring(position: Column, count: Column, x: Column, y: Column, radius: float = 80.0) -> tuple[Column, Column]:
    """places of children on a ring around their parent, from the top."""
    import math

    angle = position / count * F.lit(2 * math.pi) - F.lit(math.pi / 2)
    return x + radius * F.cos(angle), y + radius * F.sin(angle)


def child_size(kind: Column) -> Column:
    return F.when(kind == "Class", 10).otherwise(7)


def annotation_line(team: Column, domain: Column, status: Column, tags: Column) -> Column:
    """F25."""

    def named(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(name + "="), value))

    tag_text = F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, F.concat(F.lit("tags="), F.array_join(tags, ",")))
    return F.concat_ws("  ", named("team", team), named("domain", domain), named("status", status), tag_text)
