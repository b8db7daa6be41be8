"""More queries over the test tables, each with its DuckDB SQL: sinks and what is read back, ledgers, plans, names, maps and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid import functions as fn
from varigrid import plans, sources, streaming
from varigrid.operators import checks, ledger, lineage, pipeline, summary, sweep, variants
from varigrid.plans import BranchPoint
from varigrid.queries import _GRID, FLAG, MIN_DISC, MIN_QTY, _edge_sql, _shipments, entity_edges, query, t
from varigrid.queries import _run_ledger as run_ledger


def place(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{sources.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def text(c: str):
    return F.col(c).cast("string")


_CELLS = "(SELECT l_returnflag || '.' || l_linestatus AS realization, count(*) AS n FROM lineitem GROUP BY 1)"


def _cells(spark, d) -> DataFrame:
    return t(spark, d, "lineitem").groupBy(F.concat_ws(".", "l_returnflag", "l_linestatus").alias("realization")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'count' AS task, realization, 1 AS version, n FROM {_CELLS} UNION ALL SELECT 'count', realization, 2, n + 1 FROM {_CELLS} WHERE realization LIKE '%F'")
def variant_store(spark, d):
    """Two versions of a step's rows written as partitions; writing one again replaces it alone."""
    path, rows = place(spark, "variants"), _cells(spark, d)
    sources.write_variants(rows.withColumn("n", F.lit(0).cast("long")), path, "count", 1)
    sources.write_variants(rows, path, "count", 1, "overwrite")
    sources.write_variants(rows.where("realization LIKE '%F'").withColumn("n", F.col("n") + 1), path, "count", 2, "overwrite")
    return spark.read.parquet(path).select("task", "realization", "version", "n")


@query(f"SELECT CASE WHEN realization LIKE 'R%' THEN 'attic' ELSE 'store' END AS place, realization, n FROM {_CELLS}")
def archived_store(spark, d):
    """One flag's partitions moved to the attic; the store is written anew without them."""
    path, attic, rows = place(spark, "variants"), place(spark, "attic"), _cells(spark, d)
    sources.write_variants(rows, path, "count", 1)
    keys = rows.where("realization LIKE 'R%'").select("realization")
    kept = sources.archive(spark.read.parquet(path), keys, path, attic)
    both = {"store": kept, "attic": spark.read.parquet(attic)}
    return sources.concat_sources(both).select(F.col("source_name").alias("place"), "realization", "n")


@query(f"SELECT node FROM (SELECT parent AS node FROM {_edge_sql()} UNION SELECT child FROM {_edge_sql()}) WHERE node NOT IN (WITH RECURSIVE e AS {_edge_sql()}, r AS (SELECT 'nation:4' AS node UNION SELECT child FROM r JOIN e ON parent = node) SELECT node FROM r)")
def purged(spark, d):
    """What is left without a nation and all that depends on it."""
    edges = entity_edges(spark, d)
    nodes = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    return sources.purge(nodes, lineage.dependents(edges, nodes.where("node = 'nation:4'")))


@query("SELECT n_name AS node, x AS invalidated FROM nation, (VALUES (false), (true)) v(x) WHERE NOT x OR n_regionkey = 2")
def invalidation_rows(spark, d):
    """The ledger of nations with rows appended for the invalidated ones."""
    nations = t(spark, d, "nation").select(F.col("n_name").alias("node"))
    return lineage.invalidated(nations, t(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_name").alias("node")))


@query("SELECT 'order' AS task, o_orderkey::VARCHAR AS realization, o_orderstatus AS status, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_inputs, (o_totalprice > 100000)::INT::BIGINT AS n_outputs, 1::BIGINT AS n_params FROM orders")
def ledger_round_trip(spark, d):
    """Ledger tables appended twice each, read back and assembled."""
    path, o, l = place(spark, "ledger"), t(spark, d, "orders"), t(spark, d, "lineitem")
    key = lambda c: [F.lit("order").alias("task"), text(c).alias("realization")]
    parts = {"tasks": o.select(*key("o_orderkey"), F.col("o_orderstatus").alias("status")), "inputs": l.select(*key("l_orderkey"), F.monotonically_increasing_id().alias("input_name")), "outputs": o.where("o_totalprice > 100000").select(*key("o_orderkey"), F.lit("total").alias("output_name")), "params": o.select(*key("o_orderkey"), F.lit("priority").alias("param_name"), F.col("o_orderpriority").alias("param_value"))}
    odd = F.col("realization").cast("long") % 2 == 1
    for some in (odd, ~odd):
        sources.ledger_append(path, **{k: v.where(some) for k, v in parts.items()})
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(f"n_{c}")
    got = sources.ledger_read(spark, path).join(parts["tasks"].select("task", "realization"), ["task", "realization"], "left_semi")
    return got.select("task", "realization", "status", *(F.greatest(n(c), F.lit(0)).alias(f"n_{c}") for c in ("inputs", "outputs", "params")))


@query("SELECT version, kind, list_sort(list(entry)) AS entries FROM (SELECT 1 AS version, 'package' AS kind, 'brand' || r_regionkey AS entry FROM region UNION ALL SELECT 1, 'todo', 'count/' || n_name || '/' || n_nationkey FROM nation UNION ALL SELECT 2, 'existing', 'count/' || n_name || '/' || n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY ALL")
def manifest_versions(spark, d):
    """Manifests of two versions written as text, read back, put together and listed by kind."""
    nation, path = t(spark, d, "nation"), place(spark, "manifest")
    none = F.lit(None).cast("string")
    result = lambda kind: [F.lit(kind).alias("kind"), F.lit("count").alias("name"), F.col("n_name").alias("realization"), F.col("n_nationkey").cast("int").alias("task_version"), none.alias("package_version"), F.array(F.lit("tool")).alias("packages")]
    tools = t(spark, d, "region").select(F.lit("package").alias("kind"), F.concat(F.lit("brand"), text("r_regionkey")).alias("name"), none.alias("realization"), F.lit(None).cast("int").alias("task_version"), F.lit("v1").alias("package_version"), F.lit(None).cast("array<string>").alias("packages"))
    sources.write_manifest(tools.unionByName(nation.select(*result("todo"))), f"{path}/1")
    sources.write_manifest(nation.where("n_regionkey < 3").select(*result("existing")), f"{path}/2")
    return ledger.version_report(sources.union_versions([sources.read_manifest(spark, f"{path}/{v}", v) for v in (1, 2)]))


@query("SELECT 'nation' AS file, line FROM (SELECT n_nationkey || ' ' || n_name AS line FROM nation) UNION ALL SELECT 'region', r_name FROM region")
def lines_and_globs(spark, d):
    """Text lines read back, and rows read by a glob with the name of their file."""
    path = place(spark, "lines")
    t(spark, d, "nation").select(F.concat_ws(" ", text("n_nationkey"), "n_name").alias("value")).write.text(path)
    lines = sources.read_lines(spark, path).select(F.lit("nation").alias("file"), "line")
    globbed = sources.read_glob(spark, f"{d}/reg*.parquet")
    return lines.unionByName(globbed.select(fn.basename(F.col("source_file"), ".parquet").alias("file"), F.col("r_name").alias("line")))


@query("SELECT l_returnflag, l_linestatus, count(*)::VARCHAR AS lines FROM lineitem GROUP BY ALL")
def summary_file(spark, d):
    """A summary written with a header and read back."""
    path = place(spark, "summary")
    sources.write_summary(t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("lines")), path)
    return spark.read.option("header", True).option("sep", "\t").csv(path)


@query("SELECT turn % 5 = 3 AS corrupt, count(*) AS n, (sum(turn) FILTER (turn % 5 <> 3))::BIGINT AS turns FROM conversations GROUP BY 1")
def history_lines(spark, d):
    """JSON lines of which every fifth is cut short; those are kept and counted apart."""
    path = place(spark, "history")
    whole = F.to_json(F.struct("conv_id", "turn", "role"))
    t(spark, d, "conversations").select(F.when(F.col("turn") % 5 == 3, F.concat(F.expr("substring_index(to_json(struct(conv_id, turn, role)), ',', 2)"), F.lit(',"role'))).otherwise(whole).alias("value")).write.text(path)
    rows, _ = sources.read_history(spark, path, "conv_id long, turn long, role string")
    corrupt = F.col("_corrupt_record").isNotNull()
    return rows.groupBy(corrupt.alias("corrupt")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~corrupt, F.col("turn"))).alias("turns"))


_STATES = "(SELECT user_id::VARCHAR AS task, CASE arg_max(event_type, event_id) WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'locked' WHEN 'view' THEN 'broken' WHEN 'error' THEN 'partial' ELSE 'fresh' END AS state, count(*)::INT AS n FROM events GROUP BY 1)"


@query(f"SELECT task, state, CASE WHEN state = 'complete' THEN n ELSE (SELECT max(n) + 1 FROM {_STATES}) END AS version, CASE WHEN state <> 'complete' THEN 'done' END AS status FROM {_STATES}")
def versions_marked(spark, d):
    """The next version for all results but complete ones, and rows that would mark the others done."""
    led = run_ledger(spark, d)
    got = ledger.classify(led.select("task", "realization"), led)
    given = ledger.assign_versions(got, ledger.next_version(led).first()[0])
    done = ledger.mark_done(got.select("task", "realization"), got.where("state = 'complete'")).select("task", "status")
    return given.select("task", "state", "version").join(done, "task", "left")


SIZE = BranchPoint("Size", {"small": {"low": 0.0, "mark": "s"}, "large": {"low": 250000.0, "mark": "l"}, "huge": {"low": 1e9, "mark": "h"}})
ROUND = BranchPoint("Round", {"one": 1, "two": 2})


@query("SELECT s AS bp_Size, r AS bp_Round, o_orderpriority, count(*) * w AS score, m AS mark, 'run7' AS run FROM orders JOIN (VALUES ('small', 0.0::DOUBLE, 's'), ('large', 250000.0::DOUBLE, 'l')) z(s, low, m) ON o_totalprice >= low, (VALUES ('one', 1), ('two', 2)) y(r, w) GROUP BY s, r, o_orderpriority, w, m")
def derived_steps(spark, d):
    """Two steps: branches with several values each, one left out; a second point; a plan clause; values of the run on every row."""
    orders = variants.variants(t(spark, d, "orders").select("o_orderpriority", "o_totalprice"))
    sized = variants.branch(orders, SIZE, into="value", pinned=["small", "large"])

    def count(v, params):
        df = v.df.where("o_totalprice >= low").groupBy(*v.columns, "o_orderpriority", "mark").agg(F.count(F.lit(1)).alias("n"))
        return variants.VariantFrame(df, v.points, v.masks)

    def score(v, params):
        df = variants.bind(v.df, "score", F.col("n") * F.col("Round") * params["unit"])
        return variants.VariantFrame(variants.with_globals(df, {"run": "run7"}), v.points, v.masks)

    steps = [pipeline.Step("count", count, {"orders": {}}), pipeline.Step("score", score, {"count": {}}, points=[ROUND], params={"unit": 1})]
    out = pipeline.derive(steps, {"orders": sized}, {"Size": "*", "Round": "*"})["score"].df
    return out.select("bp_Size", "bp_Round", "o_orderpriority", F.col("score").cast("long").alias("score"), "mark", "run")


@query("SELECT a.n_name AS left_name, r_name AS right_name FROM nation a, region")
def nothing_shared(spark, d):
    """Two frames without a common point combine freely."""
    left = variants.variants(t(spark, d, "nation").select(F.col("n_name").alias("left_name")))
    right = variants.variants(t(spark, d, "region").select(F.col("r_name").alias("right_name")))
    return variants.vjoin(left, right).df


@query("SELECT f.l_returnflag AS bp_Flag, g.l_returnflag AS other_flag, f.n, g.n AS n_open FROM (SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) f, (SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) g")
def own_point_beside_graft(spark, d):
    """A point chosen anew after it was pinned and hidden by a graft."""
    vf = _shipments(spark, d)
    n = lambda b, col, out: variants.graft(vf, Status=b).df.groupBy("bp_Flag").agg(F.count(F.lit(1)).alias(col)).withColumnRenamed("bp_Flag", out)
    left = variants.VariantFrame(n("F", "n", "bp_Flag"), {"Flag": FLAG}, frozenset([frozenset(["Flag"])]))
    return variants.vjoin(left, variants.VariantFrame(n("O", "n_open", "other_flag"), {})).df


@query("SELECT l_linenumber, string_agg(f || s || n, ' ' ORDER BY CASE f WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, CASE s WHEN 'O' THEN 1 ELSE 2 END) AS cell FROM (SELECT l_linenumber, l_returnflag AS f, l_linestatus AS s, count(*)::VARCHAR AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1")
def gather_two_points(spark, d):
    """All branches of two points gathered in branch order."""
    vf = _shipments(spark, d)
    cells = vf.df.groupBy("l_linenumber", "bp_Flag", "bp_Status").agg(F.concat("bp_Flag", "bp_Status", F.count(F.lit(1)).cast("string")).alias("cell"))
    return summary.gather(variants.VariantFrame(cells, vf.points, vf.masks), ["Flag", "Status"], "cell", " ", ["l_linenumber"])


@query(f"SELECT bp_MinQty, bp_MinDisc, (bp_MinQty <> 'lo')::INT + (bp_MinDisc <> 'd0')::INT <= 1 AS one_off, (bp_MinQty <> 'lo')::INT + (bp_MinDisc NOT IN ('d0', 'd9'))::INT <= 1 AS relaxed_off, bp_MinDisc = 'd9' AS relaxed, 'lo/d0' AS base, (SELECT count(*) FROM lineitem WHERE l_quantity >= q AND l_discount >= d) AS n FROM {_GRID} g")
def plan_predicates(spark, d):
    """Every realization with what the plan predicates say of it, by a sweep of one aggregate for each."""
    points = [MIN_QTY, MIN_DISC]
    rows = sweep.sweep_conditional(t(spark, d, "lineitem"), points, plans.cross(points), lambda r: (F.col("l_quantity") >= r["MinQty"]) & (F.col("l_discount") >= r["MinDisc"]), {"n": F.lit(1).cast("long")})
    base = plans.baselines(plans.dimension(spark, points)).groupBy().agg(F.array_join(F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("branch_point", "branch")))), lambda x: x["branch"]), "/").alias("base"))
    relax = {"MinDisc": ["d9"]}
    return rows.join(base).select("bp_MinQty", "bp_MinDisc", plans.is_one_off(points).alias("one_off"), plans.is_one_off(points, relax).alias("relaxed_off"), plans.is_relaxed(F.col("bp_MinDisc"), ["d9"]).alias("relaxed"), "base", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT DISTINCT o_orderpriority AS task, o_orderstatus AS realization FROM orders WHERE o_orderstatus IN ('F', 'O')")
def planned_only(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("realization"))
    return plans.list_realizations(plans.in_planned(rows, rows.where("realization IN ('F', 'O')").distinct()))


@query("SELECT p_brand AS package, list_sort(list(DISTINCT p_type)) AS versions, count(DISTINCT p_partkey) FILTER (p_size > 40)::BIGINT AS n_todo FROM part GROUP BY 1 HAVING count(*) FILTER (p_size > 40) > 0")
def tools_of_work(spark, d):
    """The packages that open work needs, their versions, and how many results need each."""
    p = t(spark, d, "part")
    todo = p.where("p_size > 40").select(text("p_partkey").alias("task"), F.lit(fn.BASELINE).alias("realization"))
    uses = p.select(text("p_partkey").alias("task"), F.col("p_brand").alias("package")).distinct()
    versions = ledger.versions_by_tool(p.select(F.col("p_brand").alias("package"), F.col("p_type").alias("version")))
    n = ledger.package_deps(todo, uses, versions).groupBy("package").agg(F.count_distinct("task").alias("n_todo"))
    return versions.join(ledger.tools_needed(todo, uses), "package", "left_semi").join(n, "package").select("package", "versions", "n_todo")


@query("SELECT 'nation' AS parent, 'customer' AS child, string_agg(DISTINCT c_mktsegment, chr(10) ORDER BY c_mktsegment) AS label FROM customer UNION ALL SELECT 'region', 'nation', string_agg(DISTINCT n_name, chr(10) ORDER BY n_name) FROM nation")
def edge_reports(spark, d):
    """Edges of results taken together as edges of steps, with their labels."""
    c = t(spark, d, "customer").select(F.concat(F.lit("nation/"), text("c_nationkey")).alias("parent"), F.concat(F.lit("customer/"), text("c_custkey")).alias("child"), F.col("c_mktsegment").alias("label"))
    n = t(spark, d, "nation").select(F.concat(F.lit("region/"), text("n_regionkey")).alias("parent"), F.concat(F.lit("nation/"), text("n_nationkey")).alias("child"), F.col("n_name").alias("label"))
    edges = c.union(n)
    step = lambda x: F.substring_index(x, "/", 1).alias(x)
    labels = lineage.edge_labels(edges.select(step("parent"), step("child"), "label"))
    return lineage.edge_list(edges, "task").join(labels, ["parent", "child"])


@query("SELECT 'root' AS kind, r_name AS node, 0 AS level FROM region UNION ALL SELECT 'goal', n_name, 1 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'first', r_name, 1 FROM region")
def roots_and_goals(spark, d):
    """Roots, goals and the first level in breadth-first order; an acyclic graph has no nodes on cycles."""
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    edges = n.select(F.col("r_name").alias("parent"), F.concat(F.lit("n:"), "n_name").alias("child"))
    kind = lambda df, k, level, c="node": df.select(F.lit(k).alias("kind"), F.col(c).alias("node"), F.lit(level).alias("level"))
    outputs, goals = n.select(text("n_regionkey").alias("task"), F.col("n_name").alias("output_name")), spark.range(1, 2).select(text("id").alias("task"))
    first = lineage.order_nodes(lineage.levels(edges)).where("level = 1").select("node")
    return kind(lineage.roots(edges), "root", 0).union(kind(lineage.goal_edges(outputs, goals), "goal", 1, "output_name")).union(kind(first, "first", 1)).union(kind(lineage.check_acyclic(edges), "cycle", 0))


@query("SELECT k, count(*) - (SELECT count(*) FROM orders WHERE o_custkey % 10 = k AND o_orderstatus = 'F') AS n FROM (SELECT o_custkey % 10 AS k FROM orders UNION ALL SELECT c_custkey % 10 FROM customer) GROUP BY 1")
def multiset_algebra(spark, d):
    """Orders and customers by last digit, less the filled orders, each as often as it occurs."""
    o = t(spark, d, "orders").select((F.col("o_custkey") % 10).alias("k"), "o_orderstatus")
    both = checks.multiset_union(o.select("k"), t(spark, d, "customer").select((F.col("c_custkey") % 10).alias("k")))
    return checks.multiset_minus(both, o.where("o_orderstatus = 'F'").select("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT p_partkey, CASE WHEN length(repeat(p_name, 20)) > 250 THEN upper(md5(repeat(p_name, 20))) ELSE repeat(p_name, 20) END AS short, p_type || '/' || p_brand AS before_last, p_name AS after_last, p_type || '/' || p_brand AS space, len(string_split(p_name, ' '))::INT AS n_words, sha1(p_name) AS sha, p_size::DECIMAL(38, 10) AS number, p_name AS base FROM part")
def name_functions(spark, d):
    """Names too long, cut at the last separator, split, digested and parsed."""
    full = F.concat_ws("/", "p_type", "p_brand", "p_name")
    return t(spark, d, "part").select("p_partkey", fn.short_name(F.repeat("p_name", F.lit(20))).alias("short"), fn.split_last(full, "/")[0].alias("before_last"), fn.split_last(full, "/")[1].alias("after_last"), fn.namespace(full)[0].alias("space"), F.size(fn.split_on(F.col("p_name"), " ")).alias("n_words"), fn.digest(F.col("p_name"), "sha1").alias("sha"), fn.parse_number(text("p_size")).alias("number"), fn.basename(F.concat(full, F.lit(".tar.gz")), ".gz", ".tar.gz").alias("base"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN event_type = 'view' THEN 'Baseline.baseline' ELSE 'Kind.' || event_type END || CASE WHEN user_id % 2 = 1 THEN CASE WHEN event_type = 'view' THEN '' ELSE '-Odd.yes' END ELSE '' END AS name FROM events WHERE NOT (event_type = 'view' AND user_id % 2 = 1) UNION ALL SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), 'Odd.yes' FROM events WHERE event_type = 'view' AND user_id % 2 = 1")
def separators_and_times(spark, d):
    """Realization names with a separator of one's own, and times as text."""
    points = {"Kind": F.col("event_type"), "Odd": F.when(F.col("user_id") % 2 == 1, "yes").otherwise("no")}
    return t(spark, d, "events").select("event_id", fn.format_ts(F.col("ts")).alias("at"), fn.realization(points, {"Kind": "view", "Odd": "no"}, "-").alias("name"))


@query("SELECT n_nationkey, n_regionkey::VARCHAR AS region, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'odd' END AS name, n_nationkey % 2 = 0 AS has_name, 1 AS n_left, true AS all_short, (n_nationkey % 2)::INT AS n_odd, n_name || '|' || n_nationkey || '|' || n_regionkey AS zipped FROM nation")
def branch_maps(spark, d):
    """Maps of branches merged, reduced, tested and counted."""
    m = lambda **k: F.create_map(*(x for a, b in k.items() for x in (F.lit(a), b)))
    even = F.col("n_nationkey") % 2 == 0
    rows = t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey", m(Region=text("n_regionkey"), Name=F.lit("odd")).alias("a"), F.when(even, m(Name=F.col("n_name"))).alias("b"))
    both = fn.merge_branches(F.col("a"), F.col("b"))
    zipped = fn.zip3(F.array("n_name"), F.array(text("n_nationkey")), F.array(text("n_regionkey")))
    return rows.select("n_nationkey", both["Region"].alias("region"), both["Name"].alias("name"), F.coalesce(fn.has_branch(F.col("b"), "Name"), F.lit(False)).alias("has_name"), F.size(fn.drop_branches(both, ["Name"])).alias("n_left"), fn.all_branches(both, lambda k, v: F.length(k) < 10).alias("all_short"), fn.count_where(F.array("n_nationkey"), lambda x: x % 2 == 1).alias("n_odd"), F.concat_ws("|", zipped[0].getField("0"), zipped[0].getField("1"), zipped[0].getField("2")).alias("zipped"))


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'completed' WHEN bool_or(event_type IN ('view', 'click')) THEN 'running' WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'other' END AS status FROM events GROUP BY 1")
def shown_status(spark, d):
    """The status shown for a user with several runs."""
    flag = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type").isin("view", "click"), "running").when(F.col("event_type") == "error", "failed").otherwise("skipped")
    return t(spark, d, "events").groupBy("user_id").agg(F.collect_set(flag).alias("flags")).select("user_id", streaming.display_status(F.col("flags")).alias("status"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def watched_files(spark, d):
    """New files read as a stream as far as there are any, kept in the shared folder, and counted."""
    path, table = place(spark, "watched"), t(spark, d, "events")
    stream, _ = streaming.watch_files(spark, d, table.schema, "parquet", glob="events.parquet")
    q = stream.select("event_type").writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("event_type string").parquet(f"{path}/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def first_events(spark, d):
    """The first row of each user."""
    return summary.first_row(t(spark, d, "events").select("user_id", "event_type", "event_id"), ["event_id"], ["user_id"])


@query("SELECT count(*) AS seen, count(*) FILTER (l_quantity > 25) AS accepted, count(*) FILTER (l_quantity <= 25) AS discarded FROM lineitem")
def observed_rows(spark, d):
    """Rows counted in passing, apart by whether a condition keeps them."""
    vf, seen = pipeline.observed(variants.variants(t(spark, d, "lineitem").select("l_quantity")), "lines", F.col("l_quantity") > 25)
    vf.df.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.range(1).select(*(F.lit(got[k]).cast("long").alias(k) for k in ("seen", "accepted", "discarded")))


@query("SELECT o_orderpriority AS task, o_orderstatus AS realization, count(*)::VARCHAR AS value FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2")
def completed_metrics(spark, d):
    """Metrics of complete results alone."""
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("realization"))
    metrics = summary.metric(o, ["task", "realization"], orders=F.count(F.lit(1)))
    return summary.completed_only(metrics, o.where("realization <> 'P'").distinct()).select("task", "realization", "value")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def constant_split(spark, d):
    """A point with one branch only is taken off the table and put beside it."""
    df = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("bp_Flag"), F.col("l_linestatus").alias("bp_Status")).agg(F.count(F.lit(1)).alias("n")).withColumn("bp_Run", F.lit("only"))
    rest, constant = summary.split_constant(df, ["bp_Flag", "bp_Status", "bp_Run"])
    if constant != ["bp_Run"]:
        raise ValueError(f"constant points are {constant}")
    return rest.select(F.col("bp_Flag").alias("l_returnflag"), F.col("bp_Status").alias("l_linestatus"), "n")

