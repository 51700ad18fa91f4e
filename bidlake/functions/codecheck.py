"""Whether generated Python code may be run: its syntax tree is walked in Arrow batches, never executed."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# What generated code must define, and what it must not import or call.
REQUIRED = "scrape"
IMPORTS = frozenset(["subprocess", "ctypes", "socket", "multiprocessing"])
CALLS = frozenset(
    ["eval", "exec", "compile", "__import__", "os.system", "os.popen", "subprocess.run", "subprocess.Popen", "subprocess.call", "subprocess.check_call", "socket.socket", "shutil.rmtree"]
)


def called(node: ast.expr) -> str:
    """The dotted name of what is called; a chain that doesn't begin with a name has only its own parts."""
    names = []
    while isinstance(node, ast.Attribute):
        names.insert(0, node.attr)
        node = node.value
    return ".".join([node.id, *names] if isinstance(node, ast.Name) else names)


def offences(code: str) -> list[str]:
    """Why code is refused, in the order of its tree; nothing if it isn't."""
    try:
        nodes = list(ast.walk(ast.parse(code)))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [f"SyntaxError: {e}"]
    found = [] if any(isinstance(n, ast.FunctionDef) and n.name == REQUIRED for n in nodes) else [f"missing required function `{REQUIRED}(url, output_dir)`"]
    for n in nodes:
        match n:
            case ast.Import():
                found += [f"forbidden import: {a.name}" for a in n.names if a.name.partition(".")[0] in IMPORTS]
            case ast.ImportFrom(module=str(module)) if module.partition(".")[0] in IMPORTS:
                found.append(f"forbidden import-from: {module}")
            case ast.Call() if called(n.func) in CALLS:
                found.append(f"forbidden call: {called(n.func)}")
    return found


def checked_code(rows: DataFrame, code_col: str = "code", ok_col: str = "ok", errors_col: str = "errors") -> DataFrame:
    """All rows with whether their code may be run, and why not. Code that can't be parsed has one error; null is empty code; columns of these names are replaced."""
    kept = [c for c in rows.columns if c not in (ok_col, errors_col)]
    place = kept.index(code_col)
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField(ok_col, T.BooleanType()), T.StructField(errors_col, T.ArrayType(T.StringType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = [offences(x.as_py() or "") for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([not e for e in errors], pa.bool_()), pa.array(errors, pa.list_(pa.string()))], names=schema.names)

    return rows.select(*kept).mapInArrow(work, schema)
