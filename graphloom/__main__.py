"""Command line: ``python -m graphloom STORE COMMAND [ARGUMENTS]`` prints rows as JSON lines.

``analyse ROOT`` makes the store and ``preflight ROOT`` says whether it can be made; all other commands are methods of Project.
Runs of analyse and refresh are recorded in the store.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame

from .plans import reports
from .project import AmbiguousTarget, Project
from .session import session, ship
from .sources import snapshot, tree
from .sources.runs import operational_log, recorded_run

COMMANDS = {
    "summary": [], "health": [], "diagnostics": [], "cycles": [], "integrity": [], "architecture": [], "unused": [], "package_boundaries": [],
    "search": ["query"], "symbol": ["name"], "file": ["path"], "locate": ["name"], "references": ["target"], "relationships": ["target"], "dependencies": ["target"], "dependents": ["target"],
    "traverse": ["target"], "direct_impact": ["target"], "impact": ["target"], "path": ["start", "end"], "context": ["task"], "excerpt": ["target"], "changeset": ["targets"], "checklist": ["targets"], "risk": ["targets"],
    "status": [], "refresh": [], "cache": [], "history": [], "rule_report": ["config_path"], "post_change": ["targets"], "inspect_change": ["target"],
}


def shown(result) -> list[str]:
    if isinstance(result, DataFrame):
        return list(result.toJSON().collect()) if hasattr(result, "toJSON") else [json.dumps(r.asDict(True), default=str) for r in result.collect()]
    if isinstance(result, dict) and any(isinstance(v, DataFrame) for v in result.values()):
        return [json.dumps({"section": k, **json.loads(line)}, default=str) for k, v in result.items() for line in shown(v)]
    return [json.dumps(result, default=str)]


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom")
    parser.add_argument("store")
    parser.add_argument("--root", help="the tree, for commands that read sources")
    parser.add_argument("--log", help="a folder for the driver's log of analyses")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("analyse").add_argument("tree")
    check = commands.add_parser("preflight")
    check.add_argument("tree")
    check.add_argument("--config", help="a configuration file to look at")
    for name, needs in COMMANDS.items():
        sub = commands.add_parser(name)
        for need in needs:
            sub.add_argument(need, nargs="+" if need == "targets" else None)
    given = parser.parse_args(arguments)
    spark = session()
    ship(spark)
    if given.command == "analyse":
        with recorded_run(spark, given.store, "analyse", given.tree), operational_log(given.log, given.tree) as counted:
            summary = Project.analyse(spark, given.tree, given.store).summary()
            counted.update({r["table"]: r["rows"] for r in summary.collect()})
            print("\n".join(shown(summary)))
        return 0
    if given.command == "preflight":
        found = reports.preflight(given.tree, lambda: tree.scan(spark, given.tree), given.config, analysed=snapshot.manifest(spark, given.store) is not None)
        print("\n".join(shown(found)))
        return 0 if found["ready"] else 1
    try:
        if given.command == "refresh":
            with recorded_run(spark, given.store, "refresh", given.root or ""):
                print("\n".join(shown(Project.load(spark, given.store, given.root).refresh().summary())))
            return 0
        project = Project.load(spark, given.store, given.root)
        print("\n".join(shown(getattr(project, given.command)(*[getattr(given, n) for n in COMMANDS[given.command]]))))
    except AmbiguousTarget as error:
        print(json.dumps({"error": str(error), "candidates": error.candidates}), file=sys.stderr)
        return 1
    except (LookupError, FileNotFoundError, ValueError) as error:
        print(json.dumps({"error": str(error)}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
