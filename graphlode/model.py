"""Labels, relations, keys and schemas of the property graph."""

from __future__ import annotations

from pyspark.sql import types as T

NODE_LABELS = (
    "Project", "Package", "Folder", "File", "Module", "Class", "Function", "Method", "Interface", "Enum", "Type", "Union",
    "ModuleInterface", "ModuleImplementation", "ExternalPackage", "Comment", "Literal", "Builtin", "Community", "Process",
)
RELATIONS = (
    "CONTAINS_PACKAGE", "CONTAINS_FOLDER", "CONTAINS_FILE", "CONTAINS_MODULE", "DEFINES", "DEFINES_METHOD", "IMPORTS", "EXPORTS",
    "EXPORTS_MODULE", "IMPLEMENTS_MODULE", "INHERITS", "IMPLEMENTS", "OVERRIDES", "CALLS", "DEPENDS_ON_EXTERNAL", "MEMBER_OF", "HAS_STEP",
)
#: The property that is unique within (project, label); every other label is keyed by qualified_name.
KEY_OF = {"Project": "name", "Folder": "path", "File": "path", "ExternalPackage": "name", "Community": "id", "Process": "id"}
CALLABLE = ("Function", "Method")
#: Labels of the file tree; a module has the same key as its file.
STRUCTURE = ("Project", "Package", "Folder", "File")
CODE_LABELS = ("Function", "Method", "Class", "Module", "Interface")

_S, _I, _L, _D, _B, _A = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.ArrayType(T.StringType())
NODES = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("project", _S), ("label", _S), ("key", _S), ("node_id", _L), ("qualified_name", _S), ("name", _S), ("path", _S), ("file_path", _S), ("local_name", _S),
        ("absolute_path", _S), ("extension", _S), ("start_line", _I), ("end_line", _I), ("parameters", _A), ("decorators", _A), ("docstring", _S), ("is_exported", _B),
        ("is_external", _B), ("text", _S), ("kind", _S), ("heuristic_label", _S), ("symbol_count", _L), ("cohesion", _D), ("entry_point_qn", _S), ("terminal_qn", _S),
        ("step_count", _I), ("trace", _A))]
)
EDGES = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("project", _S), ("rel_type", _S), ("src_label", _S), ("src_key", _S), ("dst_label", _S), ("dst_key", _S), ("confidence", _D), ("version_spec", _S), ("dev", _B),
        ("peer", _B), ("step_index", _I))]
)
VECTORS = T.StructType(
    [T.StructField(n, t) for n, t in (("id", _S), ("embedding", T.ArrayType(T.FloatType())), ("qualified_name", _S), ("file_path", _S), ("project", _S), ("node_type", _S), ("source_code", _S))]
)
FILE_HASHES = T.StructType([T.StructField(n, _S) for n in ("project", "path", "sha256")])
NODE_KEY = ("project", "label", "key")
EDGE_KEY = ("project", "rel_type", "src_label", "src_key", "dst_label", "dst_key")
