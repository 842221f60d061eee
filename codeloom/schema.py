"""Schemas of the graph tables, and the graph itself."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

METADATA = T.StructType([T.StructField("exports", T.ArrayType(T.StringType())), T.StructField("is_entry_point", T.BooleanType()), T.StructField("tags", T.ArrayType(T.StringType()))])
NODE_SCHEMA = T.StructType(
    [T.StructField("ord", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("id", "kind", "label", "path", "language")]
    + [T.StructField(n, T.IntegerType()) for n in ("line_start", "line_end", "loc")]
    + [T.StructField("metadata", METADATA)]
)
EDGE_SCHEMA = T.StructType([T.StructField("ord", T.LongType())] + [T.StructField(n, T.StringType()) for n in ("id", "source", "target", "kind", "symbol")] + [T.StructField("resolved", T.BooleanType())])

IMPORT = "struct<specifier:string,resolved_path:string,kind:string,symbols:array<string>,line:int>"
EXPORT = "struct<symbol:string,kind:string,line:int>"
CALL = "struct<callee:string,resolved_node_id:string,line:int>"
FUNCTION = f"struct<name:string,line_start:int,line_end:int,calls:array<{CALL}>,is_exported:boolean,is_async:boolean>"
CLASS = "struct<name:string,line_start:int,line_end:int>"
PARSED = f"imports array<{IMPORT}>, exports array<{EXPORT}>, functions array<{FUNCTION}>, classes array<{CLASS}>"
AST_SCHEMA = f"path string, language string, {PARSED}"

NODE_KINDS = ("File", "Module", "Function", "Class", "Interface")
EDGE_KINDS = ("Import", "DynamicImport", "Call", "Inheritance", "ReExport", "Contains")
IMPORTING = ("Import", "DynamicImport", "ReExport")
VERSION = 1


@dataclass(frozen=True)
class Graph:
    """An attributed directed multigraph: node and edge tables in the schemas above, and a header."""

    nodes: DataFrame
    edges: DataFrame
    header: dict = field(default_factory=dict)
