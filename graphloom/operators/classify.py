"""Directory and file types, languages, project type, package manager, frameworks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

# Names and extensions.
IGNORED_DIRECTORIES = (".git", ".venv", "__pycache__", ".pytest_cache", ".ruff_cache", ".mypy_cache", ".tox", ".nox", ".idea", ".vscode")
GENERATED = ("__pycache__", "build", "dist", ".eggs")
DIRECTORY_TYPES = [("generated", GENERATED), ("dependency", ("site-packages", "node_modules")), ("tests", ("test", "tests")), ("documentation", ("docs", "doc", "documentation")), ("configuration", ("config", "configs")), ("assets", ("assets", "static", "resources")), ("source", ("src", "lib", "app", "python"))]
DOC_EXTENSIONS = (".md", ".rst", ".txt")
CONFIG_EXTENSIONS = (".toml", ".ini", ".cfg", ".yaml", ".yml", ".json")
DATA_EXTENSIONS = (".csv", ".tsv", ".xml")
ASSET_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp")
DOC_NAMES, CONFIG_NAMES = ("readme", "license", "licence", "changelog"), (".gitignore", ".dockerignore")
CONFIGURATION_FILES = ("pyproject.toml", "package.json", "package-lock.json", "uv.lock", "Cargo.toml", "go.mod", "requirements.txt", "Makefile", ".gitignore")
LANGUAGES = {".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".java": "Java", ".cpp": "C++", ".cc": "C++", ".hpp": "C++", ".c": "C", ".h": "C", ".go": "Go", ".rs": "Rust", ".rb": "Ruby", ".swift": "Swift", ".kt": "Kotlin", ".php": "PHP"}
PARSER_LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp"}
PROJECT_TYPES = [("pyproject.toml", "python_project"), ("package.json", "javascript_project"), ("Cargo.toml", "rust_project"), ("go.mod", "go_project"), ("pom.xml", "java_project")]
PACKAGE_MANAGERS = [("uv.lock", "uv"), ("requirements.txt", "pip"), ("package-lock.json", "npm"), ("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("Cargo.toml", "cargo"), ("go.mod", "go")]
FRAMEWORKS = {"fastapi": "FASTAPI", "django": "Django", "flask": "Flask", "react": "React", "next": "Next.js"}


def _lookup(table: dict[str, str], key: Column, otherwise: Column | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if otherwise is None else F.coalesce(found, otherwise)


def directory_type(name: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(name).isin(*names), kind) for kind, names in DIRECTORY_TYPES], F.lit("unknown"))


def is_generated(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, GENERATED)))


def scanned_type(path: Column) -> Column:
    """The type that the scan gives a file."""
    name = F.lower(paths.name_of(path))
    suffix = paths.suffix_of(paths.name_of(path))
    return (
        F.when(is_generated(path), "generated").when(name.startswith("test_") | name.endswith("_test.py"), "test").when(suffix.isin(*DOC_EXTENSIONS) | name.isin(*DOC_NAMES), "documentation")
        .when(suffix.isin(*CONFIG_EXTENSIONS) | name.isin(*CONFIG_NAMES), "configuration").when(suffix.isin(*DATA_EXTENSIONS), "data").when(suffix.isin(*ASSET_EXTENSIONS), "asset").when(suffix.isin(".py", ".pyi"), "source")
        .when(F.arrays_overlap(F.split(path, "/"), F.array(F.lit("site-packages"), F.lit("node_modules"))), "dependency").otherwise("unknown")
    )


def file_type(path: Column) -> Column:
    """The type that the classifier gives; it replaces the scan's."""
    name, suffix = paths.name_of(path), paths.suffix_of(paths.name_of(path))
    in_tests = F.array_contains(F.split(path, "/"), "tests")
    return F.when(name.isin(*CONFIGURATION_FILES), "configuration").when(suffix.isin(*DOC_EXTENSIONS), "documentation").when(in_tests, "test").when(suffix.isin(*LANGUAGES), "source").otherwise("unknown")


def language(path: Column) -> Column:
    return _lookup(LANGUAGES, paths.suffix_of(paths.name_of(path)))


def parser_language(path: Column) -> Column:
    return _lookup(PARSER_LANGUAGES, paths.suffix_of(paths.name_of(path)), F.lit("unknown"))


def project(files: DataFrame) -> DataFrame:
    """One row: project_type, package_manager, languages."""
    first = lambda rules: F.coalesce(*[F.when(F.bool_or(F.col("name") == n), v) for n, v in rules])
    return files.agg(F.coalesce(first(PROJECT_TYPES), F.lit("unknown")).alias("project_type"), first(PACKAGE_MANAGERS).alias("package_manager"), F.array_sort(F.collect_set(language(F.col("path")))).alias("languages"))


def frameworks(sources: DataFrame) -> DataFrame:
    """(framework) whose import occurs in ``content`` of a Python file."""
    rows = sources.where(F.col("path").endswith(".py")).select(F.explode(F.array(*[F.when(F.contains(F.lower("content"), F.lit(f"import {k}")), v) for k, v in FRAMEWORKS.items()])).alias("framework"))
    return rows.where("framework is not null").distinct()
