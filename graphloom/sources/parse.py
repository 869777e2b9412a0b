"""Source text to rows: symbols, imports, references, base classes and errors.

A parser maps (path, text) to a ParseResult; a registry holds one for each language. Files are
parsed by ``mapInArrow``, one nested row a file, and exploded into the graph's tables. Ids
follow from the path, so that a file gives the same rows whenever it is parsed.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify


@dataclass
class ParseResult:
    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)
    inheritance: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


SYMBOL = "id string, name string, kind string, qualified_name string, start_line int, end_line int, parent_symbol_id string, signature string"
IMPORT = "module_name string, imported_name string, alias string, level int, ordinal bigint"
REFERENCE = "name string, line int, col int, qualified_name string, kind string, ordinal bigint"
BASE = "class_symbol_id string, name string, line int, col int, qualified_name string, ordinal bigint"
SCHEMA = f"file_id string, path string, symbols array<struct<{SYMBOL}>>, imports array<struct<{IMPORT}>>, refs array<struct<{REFERENCE}>>, bases array<struct<{BASE}>>, errors array<string>"


def dotted(node: ast.expr) -> str | None:
    """``a.b.c`` of a chain of attributes on a name."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """Positional arguments with annotations and defaults, ``*args``, keyword-only ones and ``**kwargs``; no return type and no bare marks."""
    a = node.args
    plain = [*a.posonlyargs, *a.args]
    without = len(plain) - len(a.defaults)
    every = [("", x, None if i < without else a.defaults[i - without], True) for i, x in enumerate(plain)]
    every += [("*", a.vararg, None, False)] if a.vararg else []
    every += [("", x, d, True) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    every += [("**", a.kwarg, None, False)] if a.kwarg else []

    def shown(mark: str, arg: ast.arg, default: ast.expr | None, whole: bool) -> str:
        kind = f": {ast.unparse(arg.annotation)}" if whole and arg.annotation else ""
        return f"{mark}{arg.arg}{kind}" + (f" = {ast.unparse(default)}" if default is not None else "")

    return f"{node.name}({', '.join(shown(*x) for x in every)})"


class PythonSource(ast.NodeVisitor):
    """Collects one module's rows in order of appearance."""

    def __init__(self, path: str):
        self.path, self.out, self.within = path, ParseResult(), []
        self.met: dict[tuple, int] = {}

    def _add(self, name: str, kind: str, node: ast.AST, qualified: str | None = None, text: str | None = None) -> str:
        full = qualified if qualified is not None else ".".join([*(n for n, _, _ in self.within), name])
        key = (kind, full, node.lineno)
        n = self.met[key] = self.met.get(key, -1) + 1
        own = f"symbol:{self.path}:{kind}:{full}:{node.lineno}:{n}"
        parent = self.within[-1][1] if self.within else None
        self.out.symbols.append({"id": own, "name": name, "kind": kind, "qualified_name": full, "start_line": node.lineno, "end_line": node.end_lineno or node.lineno, "parent_symbol_id": parent, "signature": text})
        return own

    def _inside(self, name: str, own: str, kind: str, node: ast.AST) -> None:
        self.within.append((name, own, kind))
        self.generic_visit(node)
        self.within.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        own = self._add(node.name, "class", node)
        for base in node.bases:
            full = dotted(base)
            if full is not None:
                self.out.inheritance.append({"class_symbol_id": own, "name": full.rpartition(".")[2], "line": base.lineno, "col": base.col_offset, "qualified_name": full, "ordinal": len(self.out.inheritance)})
        self._inside(node.name, own, "class", node)

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        kind = "method" if self.within and self.within[-1][2] == "class" else "function"
        self._inside(node.name, self._add(node.name, kind, node, text=signature(node)), kind, node)

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _assigned(self, target: ast.expr, node: ast.AST) -> None:
        if isinstance(target, ast.Name):
            self._add(target.id, "constant" if target.id.isupper() else "variable", node)

    def visit_Assign(self, node: ast.Assign) -> None:
        for target in node.targets:
            self._assigned(target, node)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._assigned(node.target, node)
        self.generic_visit(node)

    def _imported(self, node: ast.AST, module: str, name: str | None, alias: str | None, level: int, shown: str, full: str) -> None:
        self.out.imports.append({"module_name": module, "imported_name": name, "alias": alias, "level": level, "ordinal": len(self.out.imports)})
        self._add(shown, "import", node, qualified=full)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self._imported(node, a.name, None, a.asname, 0, a.asname or a.name, a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        for a in node.names:
            self._imported(node, module, a.name, a.asname, node.level, a.asname or a.name, f"{module}.{a.name}")

    def _refer(self, name: str, node: ast.expr, full: str | None) -> None:
        self.out.references.append({"name": name, "line": node.lineno, "col": node.col_offset, "qualified_name": full, "kind": "reference", "ordinal": len(self.out.references)})

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            self._refer(node.id, node, None)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        full = dotted(node)
        if full is not None:
            self._refer(node.attr, node, full)
        self.generic_visit(node)


def parse_python(path: str, text: str) -> ParseResult:
    """Rows of a Python module; one error row and nothing else where it doesn't parse."""
    try:
        tree = ast.parse(text)
    except SyntaxError as error:
        return ParseResult(errors=[f"{path}:{error.lineno or 0}:{error.offset or 0}: {error.msg}"])
    except (ValueError, RecursionError) as error:
        return ParseResult(errors=[f"{path}: {error}"])
    source = PythonSource(path)
    try:
        source.visit(tree)
    except RecursionError as error:
        return ParseResult(errors=[f"{path}: {error}"])
    return source.out


class Registry:
    """One parser a language."""

    def __init__(self, parsers: dict[str, Callable[[str, str], ParseResult]] | None = None):
        self.parsers: dict[str, Callable[[str, str], ParseResult]] = {}
        for language, parser in (parsers or {"python": parse_python}).items():
            self.register(language, parser)

    def register(self, language: str, parser: Callable[[str, str], ParseResult]) -> None:
        if language in self.parsers:
            raise ValueError(f"a parser for {language} is there already")
        if language == "unknown":
            raise ValueError("no parser can be for unknown files")
        self.parsers[language] = parser


def parse_files(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """``files`` (id, path, content) to one nested row each.

    Unknown languages give nothing; known ones without a parser give an error, as do bytes that
    are no UTF-8 or null content.
    """
    parsers = (registry or Registry()).parsers
    known = files.withColumn("language", classify.parser_language(F.col("path"))).where("language <> 'unknown'")

    def run(batches):
        for batch in batches:
            rows = []
            for own, path, content, language in zip(*(batch.column(c).to_pylist() for c in ("id", "path", "content", "language")), strict=True):
                if language not in parsers:
                    out = ParseResult(errors=[f"No parser available for {language}: {path}"])
                else:
                    try:
                        if content is None:
                            raise ValueError("no content")
                        out = parsers[language](path, content if isinstance(content, str) else content.decode())
                    except (UnicodeDecodeError, ValueError) as error:
                        out = ParseResult(errors=[f"{path}: {error}"])
                rows.append({"file_id": own, "path": path, "symbols": out.symbols, "imports": out.imports, "refs": out.references, "bases": out.inheritance, "errors": out.errors})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow())

    # Listings come in few partitions, small as their files are; parsing takes a task's time by the row, not by the byte.
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return known.select("id", "path", "content", "language").repartition(tasks, "id").mapInArrow(run, SCHEMA)


def _arrow() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    nested = lambda fields: pa.list_(pa.struct([(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))]))
    return pa.schema([("file_id", pa.string()), ("path", pa.string()), ("symbols", nested(SYMBOL)), ("imports", nested(IMPORT)), ("refs", nested(REFERENCE)), ("bases", nested(BASE)), ("errors", pa.list_(pa.string()))])


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """symbols, imports, references, inheritance and errors of parsed files; an ordinal is a place in its file
    above a hash of the path: within a file they rise, and (file_id, ordinal) names a row."""
    base = F.xxhash64("path").bitwiseAND(F.lit((1 << 42) - 1)) * F.lit(1 << 20)

    def of(column: str) -> DataFrame:
        return parsed.select("file_id", "path", F.explode(column).alias("x")).select("file_id", "path", "x.*")

    numbered = lambda df: df.withColumn("ordinal", base + F.col("ordinal")).drop("path")
    errors = parsed.select("path", F.posexplode("errors").alias("ordinal", "message")).select("message", (base + F.col("ordinal")).alias("ordinal"))
    return {"symbols": of("symbols").drop("path"), "imports": numbered(of("imports")), "references": numbered(of("refs")), "inheritance": numbered(of("bases")), "errors": errors}
