"""One object over a snapshot: every question as a method that returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import changes, freshness, history, lookup, search, structure, traverse, usage
from .plans import assurance, context, reports
from .schema import EXCERPT_LINES, IMPACT_DEPTH, IMPACT_TYPES, PATH_DEPTH, PATH_EXPANSIONS, REPORT_LIMIT, Graph, violations
from .session import checkpoint
from .sources import config, parse, runs, snapshot, tree
from .streaming import incremental


class AmbiguousTarget(LookupError):
    """A target that names several entities; ``candidates`` holds their ids."""

    def __init__(self, target: str, candidates: list[str]):
        super().__init__(f"{target} names {len(candidates)} entities")
        self.candidates = candidates


class Project:
    def __init__(self, spark: SparkSession, graph: Graph, root: str | None = None):
        self.spark, self.graph, self.root = spark, graph, root
        self.store: str | None = None

    @classmethod
    def analyse(cls, spark: SparkSession, root: str, store: str | None = None, registry: parse.Registry | None = None) -> Project:
        """Scans, parses and links ``root``; with a ``store`` the snapshot is saved there and read back."""
        graph = tree.analyse(spark, root, registry)
        if store is None:
            return cls(spark, graph, root)
        snapshot.save(spark, graph, store, tree.fingerprints(tree.contents(spark, root, graph.files)))
        return cls.load(spark, store, root)

    @classmethod
    def load(cls, spark: SparkSession, store: str, root: str | None = None) -> Project:
        graph = snapshot.load(spark, store)
        if graph is None:
            raise FileNotFoundError(f"no snapshot in {store}")
        out = cls(spark, graph, root)
        out.store = store
        return out

    def _kept(self) -> str:
        if self.store is None or self.root is None:
            raise ValueError("this needs a store and a tree")
        return self.store

    def _file_changes(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(directories, read files, changes by path) of the tree against the store's fingerprints."""
        directories, files = tree.scan(self.spark, self.root)
        read = tree.contents(self.spark, self.root, files)
        cached = snapshot.load_fingerprints(self.spark, self._kept())
        current = tree.fingerprints(read)
        return directories, read, changes.file_changes(current.where("false") if cached is None else cached, current)

    def status(self) -> DataFrame:
        """One row: state and reason of the store's snapshot against the tree as it is, and the numbers of changed files."""
        found = snapshot.manifest(self.spark, self._kept()) or {}
        _, _, changed = self._file_changes()
        n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
        row = changed.agg(n("modified", "deleted", "unchanged").alias("cached"), *(n(k).alias(k) for k in ("modified", "added", "deleted")))
        errors = self.spark.range(1).select(F.lit(0).alias("errors")) if self.graph.errors is None else self.graph.errors.agg(F.count("*").cast("int").alias("errors"))
        known = {"status": F.lit(self.graph.status), "schema_version": F.lit(found.get("schema_version")).cast("int"), "analyzer_version": F.lit(found.get("analyzer_version")).cast("string")}
        return freshness.ladder(row.crossJoin(errors).withColumns(known))

    def refresh(self) -> Project:
        """Parses the files that changed, links again what they concern and publishes the next version of the snapshot."""
        store = self._kept()
        directories, read, changed = self._file_changes()
        some = checkpoint(changed.where("change <> 'unchanged'").select("path"))
        if not some.isEmpty():
            versions = some.join(read.select("path", "content"), "path", "left").withColumn("at", F.current_timestamp())
            graph = incremental.apply_versions(self.graph, versions)
            graph.directories = directories
            snapshot.save(self.spark, graph, store, tree.fingerprints(read))
        return Project.load(self.spark, store, self.root)

    def cache(self) -> dict:
        """What the store holds: version, schema, analyzer, status, tables."""
        return snapshot.manifest(self.spark, self._kept()) or {}

    def history(self, limit: int = 10) -> DataFrame:
        """The latest recorded runs, newest first."""
        return history.recent_runs(history.latest_runs(runs.recorded(self.spark, self._kept())), limit=limit)

    def post_change(self, targets: list[str], config_path: str | None = None) -> dict[str, DataFrame]:
        """What to know after a change of ``targets``, with the rules and the package policy of a configuration file."""
        found = config.validate(config.load(config_path)) if config_path else {}
        state = self.status().first()["state"] if self.store and self.root else "current"
        return reports.after_change(self.graph, self._roots(targets), found.get("rules"), found.get("package_policy"), state)

    def inspect_change(self, target: str) -> dict[str, DataFrame]:
        """What to know before a change of ``target``."""
        return reports.pre_change(self.graph, self.contents(), target)

    def rule_report(self, config_path: str) -> DataFrame:
        """The structural rules of a configuration file, evaluated."""
        return self.rules(config.validate(config.load(config_path))["rules"])

    def freshness(self, store: str) -> str:
        """Whether the store's snapshot is current, stale, incomplete or indeterminate against the tree."""
        _, files = tree.scan(self.spark, self.root)
        reason = changes.cache_reason(snapshot.manifest(self.spark, store), snapshot.load_fingerprints(self.spark, store), tree.fingerprints(tree.contents(self.spark, self.root, files)))
        return reports.freshness(reason, self.graph.status, self.graph.errors is not None and not self.graph.errors.isEmpty())

    def register_views(self, prefix: str = "") -> None:
        """The tables as temporary views, for Spark SQL."""
        for name in snapshot.TABLES:
            if (df := getattr(self.graph, name)) is not None:
                df.createOrReplaceTempView(prefix + name)
        self.graph.vertices().createOrReplaceTempView(prefix + "vertices")

    def resolve(self, target: str) -> str:
        """The id that ``target`` names; LookupError where it names nothing, AmbiguousTarget where several."""
        row = lookup.resolve_targets(self.graph, self.spark.createDataFrame([(target,)], "target string")).first()
        if row["status"] == "ambiguous":
            raise AmbiguousTarget(target, row["candidate_ids"])
        if row["id"] is None:
            raise LookupError(f"{target} isn't in the snapshot")
        return row["id"]

    def _roots(self, targets: list[str], name: str = "root") -> DataFrame:
        return self.spark.createDataFrame([(self.resolve(t),) for t in targets], f"{name} string")

    def file(self, path: str) -> DataFrame:
        return lookup.files_by_path(self.graph.files, path, self.root)

    def symbols(self, **by: str) -> DataFrame:
        return lookup.symbols_by(self.graph.symbols, **by)

    def locate(self, name: str, **by: str) -> DataFrame:
        return lookup.locate_symbols(self.graph, name, **by)

    def search(self, query: str) -> DataFrame:
        return search.ranked(search.search(self.graph, query))

    def relationships(self, target: str, direction: str = "both", types=None) -> DataFrame:
        return lookup.edges_of(self.graph.edges, self._roots([target], "entity_id"), direction, types)

    def references(self, target: str) -> DataFrame:
        return lookup.reference_listing(self.graph, self._roots([target], "symbol_id"))

    def dependencies(self, target: str) -> DataFrame:
        return lookup.file_dependencies(self.graph, self.resolve(target), "outgoing")

    def dependents(self, target: str) -> DataFrame:
        return lookup.file_dependencies(self.graph, self.resolve(target), "incoming")

    def children(self, path: str) -> DataFrame:
        return lookup.children(self.graph, f"dir:{path}")

    def summary(self) -> DataFrame:
        return lookup.summary(self.graph)

    def traverse(self, target: str, max_depth: int = 1, types=None, direction: str = "both") -> DataFrame:
        return traverse.traverse(self.graph.edges, self._roots([target]), max_depth, types, direction)

    def direct_impact(self, target: str, direction: str = "both", types=IMPACT_TYPES) -> DataFrame:
        return traverse.direct_impact(self.graph, self._roots([target], "entity_id"), direction, types)

    def impact(self, target: str, max_depth: int = IMPACT_DEPTH, direction: str = "both", types=IMPACT_TYPES, kinds=None) -> DataFrame:
        return traverse.impact(self.graph, self._roots([target]), max_depth, direction, types, kinds)

    def changeset(self, targets: list[str], max_depth: int = IMPACT_DEPTH) -> DataFrame:
        return traverse.change_impact(self.graph, self._roots(targets), max_depth)

    def path(self, start: str, end: str, max_depth: int = PATH_DEPTH, max_expansions: int = PATH_EXPANSIONS, **how) -> dict:
        return traverse.find_path(self.graph, self.resolve(start), self.resolve(end), max_depth=max_depth, max_expansions=max_expansions, **how)

    def cycles(self) -> DataFrame:
        return traverse.cycles(reports.import_pairs(self.graph))

    def architecture(self, limit: int = REPORT_LIMIT) -> dict[str, DataFrame]:
        return reports.architecture(self.graph, limit)

    def health(self) -> DataFrame:
        return reports.health(self.graph)

    def integrity(self) -> DataFrame:
        return structure.integrity(self.graph)

    def violations(self) -> DataFrame:
        return violations(self.graph)

    def package_boundaries(self, rules: list[dict] | None = None, default: str = "unrestricted") -> DataFrame:
        """Cross-package patterns with the policy's decision."""
        of = structure.package_of(self.graph.files, structure.packages(self.graph.files)).select("id", "package")
        return structure.policy(structure.patterns(structure.endpoint_packages(self.graph, of)), rules or [], default)

    def rules(self, rules: list[dict]) -> DataFrame:
        return structure.evaluate_rules(self.graph, rules)

    def unused(self, limit: int = REPORT_LIMIT) -> dict[str, DataFrame]:
        cut = lambda df: structure.limited(df, ["path", "id"], limit, ["classification"])
        return {"symbols": cut(usage.unused_symbols(self.graph)), "files": cut(usage.unused_files(self.graph))}

    def assess(self, targets: list[str], max_depth: int = IMPACT_DEPTH, **how) -> dict[str, DataFrame]:
        """Tests, checklist, facts, concerns and gaps of a change of ``targets``; those that can't be resolved are told of, not refused."""
        asked = checkpoint(lookup.changeset_targets(self.graph, self.spark.createDataFrame([(t,) for t in targets], "path string"), self.root))
        state = self.status().first()["state"] if self.store and self.root else "current"
        roots = asked.where("status = 'resolved'").select(F.col("id").alias("root")).distinct()
        return assurance.assess(self.graph, roots, asked=asked, freshness=state, max_depth=max_depth, **how)

    def checklist(self, targets: list[str], max_depth: int = IMPACT_DEPTH) -> DataFrame:
        return self.assess(targets, max_depth)["checklist"].orderBy("rank", "item_id")

    def risk(self, targets: list[str], max_depth: int = IMPACT_DEPTH) -> DataFrame:
        return self.assess(targets, max_depth)["concerns"].orderBy("severity_rank", "category", "concern_id")

    def symbol(self, name: str) -> DataFrame:
        return lookup.memory_symbols(self.graph, name).orderBy("position")

    def contents(self) -> DataFrame:
        if self.root is None:
            raise ValueError("the project has no tree to read from")
        return tree.contents(self.spark, self.root, self.graph.files)

    def excerpt(self, target: str, max_lines: int = EXCERPT_LINES) -> DataFrame:
        return reports.pre_change(self.graph, self.contents(), target, max_lines)["source"]

    def context(self, task: str, **how) -> DataFrame:
        return context.package(self.graph, task, self.contents() if self.root else None, **how)

    def compare(self, before: Project) -> dict[str, DataFrame]:
        """What changed since ``before``: symbols and edges."""
        return {"symbols": changes.diff_symbols(before.graph, self.graph), "edges": changes.diff_edges(changes.keyed_edges(before.graph), changes.keyed_edges(self.graph))}

    def diagnostics(self) -> DataFrame:
        return history.parse_errors(self.graph.errors).orderBy(F.col("ordinal"))
