"""How work is spread, and what is left to the driver."""

import pytest
from pyspark.sql import functions as F
from graphloom.operators import link, order, traverse
from graphloom.schema import Graph
from graphloom.sources import parse

SF = "/root/testdata/sf0.001"


def test_parsing_is_spread_over_tasks(spark):
    # A listing of small rows comes in one partition; parsing it there took one core for all files.
    rows = [(f"file:m{i}.py", f"m{i}.py", f"x{i} = 1\n") for i in range(200)]
    files = spark.createDataFrame(rows, "id string, path string, content string").coalesce(1)
    parsed = parse.parse_files(files)
    filled = parsed.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(filled) == 200 and max(filled) < 60


def test_graph_queries_broadcast_by_measured_size(spark):
    import __spark_entry__ as entry

    # The planner takes both sides for small, as `part` is a small file; what is derived from it isn't.
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for name in ("errors_by_file", "linked_imports"):
        df = entry.queries()[name](spark, SF)
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    # The training-data operators have the session's own setting.
    entry.queries()["op7_quality"](spark, SF)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == was


def test_a_path_beyond_the_budget_is_found_without_one(spark):
    # 1,200 files next to the start, the end behind the last of them: the queue's budget of 1,000 runs out before it.
    name = lambda i: f"n{i:05d}"
    pairs = [("start", name(i)) for i in range(1200)] + [(name(1199), "end")]
    ids = ["start", "end", *(name(i) for i in range(1200))]
    files = spark.createDataFrame([(f, "d", f"{f}.py", f, ".py", "source", 1, False, False) for f in ids], "id string, directory_id string, path string, name string, extension string, file_type string, size bigint, is_generated boolean, is_ignored boolean")
    edges = spark.createDataFrame([(f"{a}>{b}", a, b, "imports", 1.0, {"line": "1"}) for a, b in pairs], "id string, source_id string, target_id string, relationship_type string, confidence double, metadata map<string,string>")
    none = lambda columns: spark.createDataFrame([], columns)
    graph = Graph(
        none("id string, path string, name string, parent_id string, depth int, directory_type string"), files,
        none("id string, file_id string, name string, kind string, qualified_name string, start_line int, end_line int, parent_symbol_id string, signature string"), edges,
    )
    assert traverse.find_path(graph, "start", "end", direction="outgoing")["status"] == "expansion_limited"
    got = traverse.find_path(graph, "start", "end", direction="outgoing", max_expansions=None)
    assert (got["status"], got["expansions"], [s["to_id"] for s in got["path"]]) == ("resolved", 1201, [name(1199), "end"])
    with pytest.raises(ValueError):
        traverse.find_path(graph, "start", "end", max_expansions=None, stored_in="/tmp/none")


@pytest.mark.parametrize("hops, missing, expected", [(10, False, ("resolved", 10)), (11, False, ("no_path_found", 0)), (10, True, ("no_path_found", 0))])
def test_shortest_path_is_asked_for_within_ten_hops(spark, tmp_path, hops, missing, expected):
    import duckdb
    from graphloom.plans import graph_queries

    # Suppliers in a row from 1 to 6, then on to 30; each names the next by a large item.
    row = [1, *range(7, 6 + hops), 6, *range(20, 30)]
    suppliers = [(k, f"Supplier#{k:09d}", 0, 1.0) for k in range(30) if not (missing and k == 6)]
    items = [(i, to, a, 1, 50.0, 0.0) for i, (a, to) in enumerate(zip(row, row[1:]))]
    tables = {
        "region": ([(0, "AFRICA")], "r_regionkey int, r_name string"), "nation": ([(0, "NATION_0", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": (suppliers, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
        "part": ([(0, "hot bolt", "Brand#1", "LARGE", 1, 1.0)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "lineitem": (items, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double"),
    }
    duck = duckdb.connect()
    for name, (rows, columns) in tables.items():
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in graph_queries.QUERIES["shortest_path"](spark, str(tmp_path)).collect()]
    assert got == duck.execute(graph_queries.SQL["shortest_path"]).fetchall() == [expected]


def test_walks_take_the_edges_of_their_nodes_alone(spark):
    import __spark_entry__ as entry
    from graphloom.plans.bindings import commerce

    entry.queries()["relation_expansion"](spark, SF)
    g = commerce(spark, SF)
    node = g.files.limit(1).select(F.col("id").alias("node")).first()[0]
    nodes = spark.createDataFrame([(node,)], "node string")
    whole = traverse.adjacency(g, "both", None)
    got = traverse.ways_from(g, "both", None)(nodes)
    asked = whole.where(F.col("from_id") == node)
    assert got.count() == asked.count() > 0 and got.exceptAll(asked).isEmpty()
    # The filter by the nodes comes below the look-up of the other ends.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("Join LeftSemi")


@pytest.mark.parametrize("hub", [0, 3, 200_000])
def test_places_within_keys_are_the_same_with_and_without_ranges(spark, hub):
    rows = [(None if i % 11 == 0 else f"k{i % 4}" if i % 2 else "hub", i * 37 % 101) for i in range(101)]
    got = order.positions_within(spark.createDataFrame(rows, "key string, v int"), "key", "v", hub=hub).collect()
    expected = {(k, v): sorted(x for q, x in rows if q == k).index(v) + 1 for k, v in rows}
    assert len(got) == 101 and all(r["position"] == expected[(r["key"], r["v"])] for r in got)


def test_places_within_small_keys_write_nothing_but_one_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 50).cast("string").alias("key"), "id")
    plan = order.positions_within(df, "key", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan


def test_references_without_a_qualified_name_are_spread(spark):
    symbols = spark.createDataFrame([("s1", "f1", "one", "function", "f.one")], "id string, file_id string, name string, kind string, qualified_name string")
    refs = spark.createDataFrame([(f"f{i}", "one", i, 0, "f.one" if i == 7 else None, "reference", i) for i in range(400)], "file_id string, name string, line int, col int, qualified_name string, kind string, ordinal bigint")
    imports = spark.createDataFrame([], "file_id string, module_name string, imported_name string, alias string, level int, ordinal bigint")
    got = link.reference_edges(symbols, refs, imports)
    assert got.count() == 400 and [r["source_id"] for r in got.where("confidence = 1").collect()] == ["f7"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_full" in plan and "Join LeftOuter, (qualified_name" not in plan


def test_symbols_are_derived_once_for_all_rungs(spark):
    from graphloom.operators import lookup
    from graphloom.plans.bindings import commerce

    g = commerce(spark, SF)
    plan = lookup.resolve_targets(g, g.symbols.select(F.col("name").alias("target")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_partkey") == 0


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_of_patterns_stand_in_no_hash_table(spark):
    import re

    import __spark_entry__ as entry
    from graphloom.operators import structure

    rows = [("a", "x", "imports"), ("a", "x", "imports"), ("b", "x", "imports"), ("a", "x", "references"), (None, "x", "imports"), (None, "x", "imports"), ("a", None, "imports")]
    edges = spark.createDataFrame(rows, "source_id string, target_id string, relationship_type string")
    found = [tuple(r) for r in structure.once(edges).collect()]
    assert len(found) == 5 and set(found) == set(rows)
    plan = _executed(entry.queries()["cross_package_patterns"](spark, SF))
    assert "Window" in plan and not re.search(r"HashAggregate\(keys=\[[^\]]*source_id", plan)


def test_edges_are_not_shuffled_for_few_tests(spark):
    from graphloom.operators import usage
    from graphloom.plans.bindings import commerce
    from graphloom.session import measured_broadcasts

    measured_broadcasts(spark)
    g = commerce(spark, SF)
    targets = g.files.select(F.col("id").alias("target_id"))
    assert "hashpartitioning(end_id" not in _executed(usage.test_edges(g, targets, F.col("name").endswith("1")))


def test_facts_join_paths_to_no_other_edges(spark):
    import re

    import __spark_entry__ as entry

    # Paths of all edges were joined, and what the change touches was looked up by them.
    assert not re.search(r"Join \[source_path", _executed(entry.queries()["risk_fact_list"](spark, SF)))
