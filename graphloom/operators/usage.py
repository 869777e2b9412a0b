"""Unused entities and test associations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import USAGE_TYPES, Graph
from ..session import checkpoint, few
from .order import first_within

# Files that start programs, and methods that the language calls.
KINDS = {"all": "all", "*": "all"} | {name: kind for kind in ("function", "method", "variable", "file", "symbol") for name in (kind, f"{kind}s")} | {"class": "class", "classes": "class"}
ENTRY_POINTS = "__init__.py __main__.py main.py conftest.py setup.py manage.py wsgi.py asgi.py".split()
MAIN_FILES = ("__main__.py", "main.py", "app.py", "manage.py", "cli.py")
DATA_MODEL_METHODS = (
    "__new__ __init__ __del__ __repr__ __str__ __bytes__ __format__ __lt__ __le__ __eq__ __ne__ __gt__ __ge__ __hash__ __bool__ __getattr__ __getattribute__ __setattr__ __delattr__ __dir__ __get__ __set__ __delete__ "
    "__set_name__ __init_subclass__ __class_getitem__ __mro_entries__ __len__ __length_hint__ __getitem__ __setitem__ __delitem__ __missing__ __iter__ __next__ __reversed__ __contains__ __call__ __enter__ __exit__ __aenter__ __aexit__ __aiter__ __anext__ "
    "__add__ __sub__ __mul__ __matmul__ __truediv__ __floordiv__ __mod__ __divmod__ __pow__ __lshift__ __rshift__ __and__ __xor__ __or__ __radd__ __rsub__ __rmul__ __rmatmul__ __rtruediv__ __rfloordiv__ __rmod__ __rdivmod__ __rpow__ __rlshift__ __rrshift__ __rand__ __rxor__ __ror__ "
    "__iadd__ __isub__ __imul__ __imatmul__ __itruediv__ __ifloordiv__ __imod__ __ipow__ __ilshift__ __irshift__ __iand__ __ixor__ __ior__ __neg__ __pos__ __abs__ __invert__ __complex__ __int__ __float__ __index__ __round__ __trunc__ __floor__ __ceil__ "
    "__post_init__ __copy__ __deepcopy__ __getstate__ __setstate__ __reduce__ __reduce_ex__"
).split()


def is_test_file(path: Column) -> Column:
    """A file of a test runner by its name or by lying under a test directory."""
    name = F.lower(paths.name_of(path))
    return name.rlike(r"^test_.*\.pyi?$|_test\.pyi?$") | (name == "conftest.py") | F.lower(path).rlike(r"(^|/)tests?/")


def is_changeset_test(path: Column) -> Column:
    """The predicate of change sets: name prefix or suffix, or a ``test`` or ``tests`` directory; upper and lower case count alike."""
    low = F.lower(path)
    return paths.name_of(low).rlike(r"^test_|_test\.py$") | low.rlike(r"(^|/)tests?(/|$)")


def is_runner_file(name: Column) -> Column:
    """The predicate of test runners: by the file's name alone."""
    return F.lower(name).rlike(r"^test_|_test\.py$")


def is_verification_test() -> Column:
    """The predicate of verification, on ``file_type`` and ``path`` of a file: its type, else as in change sets, or a name that ends in ``_test``."""
    low = F.lower("path")
    return (F.col("file_type") == "test") | is_changeset_test(F.col("path")) | low.endswith("_test")


def unused_symbols(graph: Graph) -> DataFrame:
    """id, name, kind, path, classification of symbols without a use from outside themselves.

    unused_candidate; or cannot_assess where the file is missing or has errors, lines are invalid, a use in
    the file has no line, a homonym may be meant, or convention calls it (data-model methods, entry points,
    tests). Used symbols are not listed. A use is a references, calls, inherits or depends_on edge, or a raw
    reference by name in the file outside the symbol's lines.
    """
    owners = graph.files.select(F.col("id").alias("file_id"), "path", F.col("name").alias("file_name"))
    rows = graph.symbols.where("kind <> 'import'").join(owners, "file_id", "left")
    uses = graph.edges.where(F.col("relationship_type").isin(*USAGE_TYPES)).select(F.col("target_id").alias("id"), "source_id", F.try_element_at("metadata", F.lit("line")).alias("at"))
    met = uses.join(rows.select("id", "file_id", "start_line", "end_line"), "id")
    digits = F.coalesce(F.col("at").rlike(r"^\d+$"), F.lit(False))
    line = F.col("at").try_cast("bigint")
    inside = line.between(F.col("start_line"), F.col("end_line"))
    own, local = F.col("source_id") == F.col("id"), F.col("source_id") == F.col("file_id")
    used = met.groupBy("id").agg(F.count_if(~own & (~local | (digits & ~inside))).alias("external"), F.count_if(own | (local & digits & inside)).alias("self_uses"), F.coalesce(F.bool_or(~own & local & ~digits), F.lit(False)).alias("no_line"))
    rows = rows.join(used, "id", "left").na.fill(0, ["external", "self_uses"]).na.fill(False, ["no_line"])
    homonyms = rows.groupBy("file_id", "name").agg((F.count("*") > 1).alias("several"))
    rows = rows.join(homonyms, ["file_id", "name"], "left")
    if graph.references is not None:
        raw = graph.references.select("file_id", "name", F.col("line").alias("l"), F.col("qualified_name").alias("q"))
        loose = rows.select("id", "file_id", "name", "qualified_name", "start_line", "end_line", "several").join(raw, ["file_id", "name"]).where("l < start_line or l > end_line")
        same = F.col("q").isNotNull() & (F.col("q") == F.col("qualified_name"))
        loose = loose.groupBy("id").agg(F.count_if(~F.col("several") | same).alias("by_name"), F.coalesce(F.bool_or(F.col("several") & F.col("q").isNull()), F.lit(False)).alias("homonym"))
        rows = rows.join(loose, "id", "left").na.fill(0, ["by_name"]).na.fill(False, ["homonym"])
    else:
        rows = rows.withColumns({"by_name": F.lit(0), "homonym": F.lit(False)})
    if graph.errors is not None:
        failed = file_errors(graph.files, graph.errors).select("path").distinct().withColumn("failed", F.lit(True))
        rows = rows.join(failed, "path", "left")
    else:
        rows = rows.withColumn("failed", F.lit(None).cast("boolean"))
    broken = F.col("path").isNull() | F.coalesce("failed", F.lit(False)) | (F.col("start_line") <= 0) | (F.col("end_line") < F.col("start_line"))
    discovered = (F.col("kind").isin("function", "method") & F.col("name").startswith("test_")) | ((F.col("kind") == "class") & F.col("name").startswith("Test"))
    called = F.col("name").isin(*DATA_MODEL_METHODS)
    convention = called | (is_changeset_test(F.col("path")) & discovered) | ((F.col("name") == "main") & F.col("file_name").isin(*MAIN_FILES))
    kind = (
        F.when(broken, "cannot_assess").when(F.col("external") > 0, "used").when(F.col("no_line"), "cannot_assess").when(F.col("by_name") > 0, "used")
        .when(F.col("homonym") | F.coalesce(convention, F.lit(False)), "cannot_assess").otherwise("unused_candidate")
    )
    return rows.withColumn("classification", kind).where("classification <> 'used'").select("id", "name", "kind", "path", "start_line", "self_uses", "classification")


def unused_files(graph: Graph) -> DataFrame:
    """id, path, classification of Python files that no other file imports and whose symbols nothing else uses."""
    rows = graph.files.where(F.col("path").rlike(r"\.pyi?$") & ~F.col("is_ignored") & ~F.col("is_generated"))
    imported = graph.edges.where("relationship_type = 'imports' and source_id <> target_id").select(F.col("target_id").alias("id"))
    uses = graph.edges.where(F.col("relationship_type").isin(*USAGE_TYPES)).select("source_id", "target_id").join(graph.symbols.select(F.col("id").alias("target_id"), "file_id"), "target_id")
    used = uses.where("source_id <> file_id").select(F.col("file_id").alias("id"))
    left = rows.join(imported, "id", "left_anti").join(used, "id", "left_anti")
    kind = F.when(F.col("name").isin(*ENTRY_POINTS) | is_test_file(F.col("path")), "cannot_assess").otherwise("unused_candidate")
    return left.select("id", "path", kind.alias("classification"))


def summary(items: DataFrame) -> DataFrame:
    return items.groupBy("kind", "classification").agg(F.count("*").alias("entities"))


def unused(graph: Graph, kind: str = "all") -> DataFrame:
    """Symbols and files that nothing uses, or that can't be judged: id, name, kind, path, start_line, classification.

    ``kind``: all, symbol, file, or one kind of symbol, in the singular or plural.
    """
    wanted = kind.strip().lower() or "all"
    if wanted not in KINDS:
        raise ValueError(f"unknown kind {kind}; kinds are {', '.join(sorted(set(KINDS.values())))}")
    wanted = KINDS[wanted]
    columns = ("id", "name", "kind", "path", "start_line", "classification")
    symbols = unused_symbols(graph).select(*columns) if wanted != "file" else None
    if symbols is not None and wanted not in ("all", "symbol"):
        symbols = symbols.where(F.lower("kind") == wanted)
    if wanted not in ("all", "file"):
        return symbols
    files = unused_files(graph).select("id", paths.name_of(F.col("path")).alias("name"), F.lit("file").alias("kind"), "path", F.lit(None).cast("int").alias("start_line"), "classification")
    return files if symbols is None else symbols.unionByName(files)


def listed(items: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of the candidates and of those that can't be judged, each by path, line, name and kind, with position and total."""
    order = ("path", F.coalesce("start_line", F.lit(0)), "name", "kind", "id")
    return first_within(items, "classification", *order, limit=limit)


def file_errors(files: DataFrame, errors: DataFrame) -> DataFrame:
    """(ordinal, message, path) of errors that name one file: at their start, else by its path, else by its name.

    Path tokens are cut at delimiters, so the join is by equality.
    """
    token = r"[^\s:'\"(),\[\]]+"
    words = errors.select("ordinal", "message", F.posexplode(F.regexp_extract_all("message", F.lit(token), F.lit(0))).alias("at", "token"))
    by_path = words.join(files.select(F.col("path").alias("token"), F.col("path")), "token").withColumn("rung", F.when(F.col("at") == 0, 0).otherwise(1))
    by_name = words.join(files.groupBy(F.col("name").alias("token")).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").drop("n"), "token").withColumn("rung", F.lit(2))
    hits = by_path.select("ordinal", "message", "rung", "path").unionByName(by_name.select("ordinal", "message", "rung", "path")).distinct()
    each = hits.groupBy("ordinal", "message", "rung").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path"))
    best = each.groupBy("ordinal", "message").agg(F.min_by(F.struct("n", "path"), "rung").alias("b"))
    return best.where("b.n = 1").select("ordinal", "message", F.col("b.path").alias("path"))


def test_edges(graph: Graph, targets: DataFrame, is_test: Column, types=None) -> DataFrame:
    """(test_path, target_id, relationship_type, direction): edges between tests and targets (target_id), either way."""
    tests = graph.files.where(is_test).select(F.col("id").alias("file_id"), F.col("path").alias("test_path"))
    ends = tests.select(F.col("file_id").alias("end_id"), "test_path").unionByName(graph.symbols.select(F.col("id").alias("end_id"), "file_id").join(tests, "file_id").select("end_id", "test_path"))
    # Tests are counted first: where they are few, no edge is shuffled to find its test.
    ends = checkpoint(ends)
    ends = few(ends, ends.count())
    edges = graph.edges if types is None else graph.edges.where(F.col("relationship_type").isin(*types))
    e = edges.select("source_id", "target_id", "relationship_type")
    out = e.select(F.col("source_id").alias("end_id"), F.col("target_id"), "relationship_type", F.lit("outgoing_from_test").alias("direction"))
    back = e.select(F.col("target_id").alias("end_id"), F.col("source_id").alias("target_id"), "relationship_type", F.lit("incoming_to_test").alias("direction"))
    met = out.unionByName(back).join(ends, "end_id").join(targets.select("target_id"), "target_id", "left_semi")
    return met.select("test_path", "target_id", "relationship_type", "direction")


def direct_tests(graph: Graph, targets: DataFrame, is_test: Column, types=None) -> DataFrame:
    """(test_path, target_id, types, directions): ``test_edges`` by test and target."""
    met = test_edges(graph, targets, is_test, types)
    return met.groupBy("test_path", "target_id").agg(F.array_join(F.array_sort(F.collect_set("relationship_type")), ", ").alias("types"), F.array_join(F.array_sort(F.collect_set("direction")), ", ").alias("directions"))


def named_tests(tests: DataFrame, targets: DataFrame, direct: DataFrame) -> DataFrame:
    """(test_path, target_id, evidence): ``test_x`` or ``x_test`` for a target whose stem is x; pairs in ``direct`` are left out.

    ``tests``: test_path; ``targets``: target_id, stem.
    """
    stem = F.lower(paths.stem_of(paths.name_of(F.col("test_path"))))
    key = F.when(stem.startswith("test_"), F.substr(stem, F.lit(6))).when(stem.endswith("_test"), F.regexp_replace(stem, "_test$", "")).otherwise(stem)
    met = tests.withColumn("stem", key).join(targets.withColumn("stem", F.lower("stem")), "stem").select("test_path", "target_id", F.lit("naming_convention").alias("evidence"))
    return met.join(direct.select("test_path", "target_id"), ["test_path", "target_id"], "left_anti")


def tests_by_symbol(named: DataFrame, targets: DataFrame) -> DataFrame:
    """(test_path, target_id, evidence, matched): tests that name a target, or hold a test of its name.

    ``named``: test_path and the names of a test file's symbols and references; ``targets``: target_id, name. Upper
    and lower case count alike; ``test_x`` names x.
    """
    key = F.lower("name")
    tests = named.select("test_path", F.col("name").alias("matched"), F.explode(F.array_distinct(F.array(key, F.regexp_replace(key, "^test_", "")))).alias("key"))
    met = tests.join(targets.select("target_id", key.alias("key")), "key")
    return met.groupBy("test_path", "target_id").agg(F.lit("symbol_name_match").alias("evidence"), F.min("matched").alias("matched"))


def names_in_tests(graph: Graph) -> DataFrame:
    """(test_path, name) of what test files define and refer to."""
    tests = graph.files.where(is_test_file(F.col("path"))).select(F.col("id").alias("file_id"), F.col("path").alias("test_path"))
    names = graph.symbols.select("file_id", "name")
    if graph.references is not None:
        names = names.unionByName(graph.references.select("file_id", "name"))
    return names.join(tests, "file_id").select("test_path", "name").distinct()


def untested(targets: DataFrame, *associations: DataFrame) -> DataFrame:
    for found in associations:
        targets = targets.join(found.select("target_id"), "target_id", "left_anti")
    return targets
