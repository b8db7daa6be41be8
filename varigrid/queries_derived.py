"""Queries over plans with goals, arrivals, sweeps by cells, stores changed by partition, graphs and files, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid import functions as fn
from varigrid import plans, sources, streaming
from varigrid.operators import checks, ledger, lineage, pipeline, summary, sweep, variants
from varigrid.plans import BranchPoint
from varigrid.queries import _EDGES, FLAG, MIN_DISC, MIN_QTY, _shipments, entity_edges, query, t
from varigrid.queries_store import place

_BY_FLAG = "(SELECT l_returnflag AS f, m, count(*) AS n FROM lineitem JOIN (VALUES ('lo', 1), ('hi', 25)) q(m, v) ON l_quantity >= v GROUP BY ALL)"


@query(f"SELECT 'totals' AS step, f AS bp_Flag, m AS bp_MinQty, n, NULL::BIGINT AS base_n FROM {_BY_FLAG} WHERE f IN ('A', 'N') OR (f = 'R' AND m = 'lo') UNION ALL SELECT 'compare', a.f, a.m, a.n, b.n FROM {_BY_FLAG} a JOIN {_BY_FLAG} b ON b.f = 'N' AND a.m = b.m WHERE a.f = 'A'")
def planned_derivation(spark, d):
    """Two plans over steps given out of order. One reaches a comparison of flag A with flag N, which it grafts and no plan names; the other reaches
    the totals of flag R. The audit is no goal's input, and would fail if it were run."""
    lines = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("bp_Flag"), "l_quantity")
    source = variants.VariantFrame(lines, {"Flag": FLAG}, frozenset([frozenset(["Flag"])]))

    def totals(v, params):
        df = v.df.where("l_quantity >= MinQty").groupBy(*v.columns).agg(F.count(F.lit(1)).alias("n"))
        return variants.VariantFrame(df, v.points, v.masks)

    def audit(v, params):
        raise AssertionError("no plan needs the audit")

    steps = [
        pipeline.Step("compare", lambda v, params: v, {"totals": {}, "base": ("totals", {"Flag": "N"})}),
        pipeline.Step("audit", audit, {"totals": {}}),
        pipeline.Step("totals", totals, {"lines": {}}, points=[MIN_QTY]),
    ]
    both = [plans.Plan("filled", ["compare"], {"Flag": ["A"], "MinQty": "*"}), plans.Plan("returned", ["totals"], {"Flag": ["R"]})]
    out = pipeline.derive_planned(steps, {"lines": source}, both)
    rows = lambda s, base: out[s].df.select(F.lit(s).alias("step"), "bp_Flag", "bp_MinQty", "n", base.alias("base_n"))
    return rows("totals", F.lit(None).cast("long")).unionByName(rows("compare", F.col("base_n")))


@query("WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS half FROM events) SELECT v.user_id, v.half AS bp_Half, count(*) AS n, sum(v.event_id + 3 * c.event_id + 7 * p.event_id)::BIGINT AS total FROM e v JOIN e c ON v.user_id = c.user_id AND v.half = c.half JOIN e p ON v.user_id = p.user_id WHERE v.event_type = 'view' AND c.event_type = 'click' AND p.event_type = 'purchase' GROUP BY ALL")
def arrivals_join(spark, d):
    """Views and clicks of one half with purchases, per user, derived as the events come in four batches of a stream."""
    path, events = place(spark, "arrivals"), t(spark, d, "events").select("event_id", "user_id", "event_type")
    events.repartition(4, F.pmod(F.hash("event_id"), F.lit(4))).write.parquet(f"{path}/files")
    half = BranchPoint("Half", {"even": None, "odd": None})

    def take(kind: str, halved: bool):
        def rows(df: DataFrame) -> variants.VariantFrame:
            own = df.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(kind), *([F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("bp_Half")] if halved else []))
            return variants.VariantFrame(own, {"Half": half} if halved else {}, frozenset([frozenset(["Half"] if halved else [])]))

        return rows

    arrivals = streaming.Arrivals(f"{path}/state", {"view": take("view", True), "click": take("click", True), "purchase": take("purchase", False)}, ["user_id"])
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/files")
    stream.writeStream.foreachBatch(arrivals.add).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return arrivals.derived(spark).groupBy("user_id", "bp_Half").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("view") + 3 * F.col("click") + 7 * F.col("purchase")).alias("total"))


@query("SELECT bp_MinQty, bp_MinDisc, bp_Status, count(*) AS n, sum(l_partkey)::BIGINT AS parts, min(l_suppkey) AS low, max(l_extendedprice) AS high, count(DISTINCT l_partkey) AS kinds FROM lineitem JOIN (SELECT q::VARCHAR AS bp_MinQty, q FROM range(1, 51) x(q)) ON l_quantity >= q JOIN (SELECT 'd' || i AS bp_MinDisc, i / 50.0::DOUBLE AS m FROM range(5) y(i)) ON l_discount >= m JOIN (VALUES ('open', 'O'), ('any', 'O'), ('any', 'F')) s(bp_Status, v) ON l_linestatus = v GROUP BY ALL")
def sweep_by_cells(spark, d):
    """500 realizations of two thresholds and a set from one pass: sums, extremes and distinct counts."""
    quantity = BranchPoint("MinQty", {str(q): q for q in range(1, 51)})
    discount = BranchPoint("MinDisc", {f"d{i}": i / 50 for i in range(5)})
    status = BranchPoint("Status", {"open": {"O"}, "any": {"O", "F"}})
    points, on = [quantity, discount, status], {"MinQty": "l_quantity", "MinDisc": "l_discount", "Status": "l_linestatus"}
    sums = {"n": F.lit(1).cast("long"), "parts": F.col("l_partkey").cast("long")}
    return sweep.sweep_cells(t(spark, d, "lineitem"), points, plans.cross(points), on, sums, {"low": F.col("l_suppkey")}, {"high": F.col("l_extendedprice")}, {"kinds": F.col("l_partkey")})


@query("SELECT bp_MinQty, bp_MinDisc, count(*) AS n FROM lineitem JOIN (SELECT * FROM (VALUES ('lo', 1), ('hi', 25)) q(bp_MinQty, q), (VALUES ('d0', 0.0::DOUBLE), ('d5', 0.05::DOUBLE), ('d9', 0.09::DOUBLE)) d(bp_MinDisc, d)) ON l_quantity >= q AND l_discount >= d GROUP BY ALL")
def sweep_general(spark, d):
    """The general form: facts joined with the grid."""
    points = [MIN_QTY, MIN_DISC]
    return sweep.sweep(t(spark, d, "lineitem"), points, plans.cross(points), lambda: (F.col("l_quantity") >= F.col("val_MinQty")) & (F.col("l_discount") >= F.col("val_MinDisc")), [F.count(F.lit(1)).alias("n")])


@query("SELECT CASE WHEN o_orderstatus = 'P' OR o_orderpriority LIKE '1%' THEN 'attic' ELSE 'store' END AS place, o_orderstatus AS realization, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY ALL")
def archived_rows(spark, d):
    """One status's partitions are moved as they are, and of the others the rows of one priority, for which they are written anew."""
    path, attic = place(spark, "orders"), place(spark, "attic")
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderstatus").alias("realization"))
    sources.write_variants(rows, path, "orders", 1)
    store = spark.read.parquet(path)
    store = sources.archive(store, store.where("realization = 'P'").select("task", "realization").distinct(), path, attic)
    kept = sources.archive(store, store.where("o_orderpriority LIKE '1%'").select("o_orderpriority").distinct(), path, attic)
    both = sources.concat_sources({"store": kept, "attic": spark.read.schema(kept.schema).parquet(attic)})
    return both.groupBy(F.col("source_name").alias("place"), "realization").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query(f"WITH RECURSIVE e AS {_EDGES}, r AS (SELECT 'nation:4' AS node UNION SELECT child FROM r JOIN e ON parent = node) SELECT split_part(node, ':', 1) AS task, count(*) AS n FROM (SELECT parent AS node FROM e UNION SELECT child FROM e) WHERE node NOT IN (SELECT node FROM r) GROUP BY 1")
def purged_store(spark, d):
    """A nation and all that depends on it deleted from a store with a folder for each kind of node."""
    path, edges = place(spark, "nodes"), entity_edges(spark, d)
    nodes = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    nodes.withColumn("task", F.substring_index("node", ":", 1)).write.partitionBy("task").parquet(path)
    victims = lineage.dependents(edges, nodes.where("node = 'nation:4'"))
    return sources.purge_store(spark.read.parquet(path), victims, path, ["task"]).groupBy("task").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE regexp_full_match(p_name, '[m-s].*') AND regexp_full_match(p_type, '[!P]R.*')")
def glob_ranges(spark, d):
    """Ranges and sets of signs in globs; an exclamation mark in brackets is a sign like others."""
    return t(spark, d, "part").where(fn.match_name(F.col("p_name"), "[m-s]*") & fn.match_name(F.col("p_type"), "[!P]R*")).select("p_partkey", "p_name", "p_type")


@query("SELECT bp_Flag, bp_Status, pinned, (n * w)::BIGINT AS n FROM (SELECT l_returnflag AS bp_Flag, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), (VALUES ('O', 'one', 1), ('F', 'two', 2)) v(bp_Status, pinned, w)")
def branch_after_graft(spark, d):
    """A point pinned and hidden by a graft is chosen anew, with branches of its own."""
    status = BranchPoint("Status", {"O": {"pinned": "one", "w": 1}, "F": {"pinned": "two", "w": 2}})
    vf = variants.graft(_shipments(spark, d), Status="F")
    counted = variants.VariantFrame(vf.df.groupBy("bp_Flag").agg(F.count(F.lit(1)).alias("n")), vf.points, vf.masks)
    anew = variants.branch(counted, status)
    return anew.df.select("bp_Flag", "bp_Status", "pinned", (F.col("n") * F.col("w")).cast("long").alias("n"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def resolved_refs(spark, d):
    """Customers that orders name, each with exactly one definition."""
    refs = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("ref"))
    good, _ = checks.resolve_refs(refs, t(spark, d, "customer").select(F.col("c_custkey").alias("ref"), "c_name"), "ref")
    return good.select("o_orderkey", "c_name")


@query("SELECT event_id AS node, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS level FROM events")
def event_chain(spark, d):
    """The place of each event in its user's chain of events, which grows with the table."""
    from pyspark.sql.window import Window

    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    edges = t(spark, d, "events").select(before.alias("before"), "event_id", "user_id")
    start = -1 - F.col("user_id")
    rows = lineage.levels(edges.select(F.coalesce("before", start).alias("parent"), F.col("event_id").alias("child")))
    return rows.where("node >= 0").select("node", (F.col("level") - 1).alias("level"))


@query("SELECT event_id AS node, min(event_id) OVER (PARTITION BY user_id) AS component FROM events WHERE user_id % 2 = 0 QUALIFY count(*) OVER (PARTITION BY user_id) > 1")
def event_cycles(spark, d):
    """The events of users with an even number lead back from the last to the first. All chains run into that of the largest number, which
    is no cycle if odd, and the chains of odd numbers start at events of others: nodes between cycles that are on none."""
    from pyspark.sql.window import Window

    by = Window.partitionBy("user_id")
    e = t(spark, d, "events").select("user_id", "event_id", F.lead("event_id").over(by.orderBy("event_id")).alias("next"), F.min("event_id").over(by).alias("first"), F.max("event_id").over(by).alias("last"))
    edge = lambda df, a, b: df.select(F.col(a).alias("parent"), F.col(b).alias("child"))
    firsts = e.select("user_id", "first").distinct()
    odd = firsts.where("user_id % 2 = 1").select((F.col("user_id") - 1).alias("user_id"), F.col("first").alias("onto"))
    edges = edge(e.where("next IS NOT NULL"), "event_id", "next").union(edge(e.where("event_id = last AND user_id % 2 = 0 AND first < last"), "last", "first")).union(edge(firsts.join(odd, "user_id"), "first", "onto"))
    return lineage.cycles(edges)


@query(f"WITH RECURSIVE e AS {_EDGES}, r AS (SELECT DISTINCT parent AS node, 1 AS level FROM e WHERE parent NOT IN (SELECT child FROM e) UNION SELECT child, level + 1 FROM r JOIN e ON parent = node) SELECT node, max(level)::INT AS level, row_number() OVER (ORDER BY max(level), node) AS rank FROM r GROUP BY node")
def node_ranks(spark, d):
    """The place of each node in breadth-first order."""
    return summary.ranked(lineage.levels(entity_edges(spark, d)), [("level", "number", False), ("node", "text", False)])


_LINES = "(SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 7 = 0 THEN '# order ' || o_orderkey ELSE o_orderstatus || ' ' || floor(o_totalprice)::BIGINT || ' ' || o_orderkey END AS line FROM orders)"


@query(f"WITH l AS {_LINES}, h AS (SELECT min(pos) AS pos FROM l WHERE line NOT LIKE '#%') SELECT 'comment' AS part, row_number() OVER (ORDER BY pos) AS place, line FROM l WHERE line LIKE '#%' UNION ALL SELECT 'header', 1, line FROM l JOIN h USING (pos) UNION ALL SELECT 'row', row_number() OVER (ORDER BY split_part(line, ' ', 1), split_part(line, ' ', 2)::DOUBLE DESC, line), line FROM l WHERE line NOT LIKE '#%' AND pos <> (SELECT pos FROM h)")
def tabular_file(spark, d):
    """Lines of which some are comments: those stay in order, the first other line is the header, the rest is sorted by text, then by number."""
    line = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("# order "), F.col("o_orderkey").cast("string"))).otherwise(F.concat_ws(" ", "o_orderstatus", F.floor("o_totalprice").cast("string"), F.col("o_orderkey").cast("string")))
    return summary.tabular_lines(t(spark, d, "orders").select(F.col("o_orderkey").alias("at"), line.alias("line")), [(1, "text", False), (2, "number", True)])


@query("WITH f AS (SELECT 'mode' || (p_partkey % 20) AS name, p_partkey % 20 AS k, md5(string_agg(p_name || chr(10), '' ORDER BY p_partkey)) AS old, md5(string_agg(upper(p_name) || chr(10), '' ORDER BY p_partkey)) AS new FROM part GROUP BY ALL) SELECT name, 'changed' AS change, new AS digest FROM f WHERE k < 5 UNION ALL SELECT name, 'gone', old FROM f WHERE k = 19 UNION ALL SELECT 'new' || k, 'new', old FROM f WHERE k = 7")
def files_on_disk(spark, d):
    """Files of part names against a snapshot: some have other content, some were written anew with the same, one has gone and one is new."""
    path = place(spark, "files")

    def write(df: DataFrame, prefix: str = "mode") -> None:
        rows = df.select((F.col("p_partkey") % 20).alias("k"), "p_name", "p_partkey").repartition("k").sortWithinPartitions("k", "p_partkey")
        staged = f"{path}/staged-{prefix}"
        rows.select("k", "p_name").write.mode("overwrite").partitionBy("k").text(staged)
        for f in spark.read.text(staged).inputFiles():  # twenty files
            fs, a = sources.files(spark, f)
            b = sources.files(spark, f"{path}/now/{prefix}{f.split('/k=')[1].split('/')[0]}.txt")[1]
            fs.mkdirs(b.getParent())
            fs.delete(b, False)
            fs.rename(a, b)

    part = t(spark, d, "part")
    write(part)
    snapshot = sources.stored(ledger.file_digests(spark, f"{path}/now/*.txt"))
    k = F.col("p_partkey") % 20
    write(part.where(k < 5).withColumn("p_name", F.upper("p_name")))
    write(part.where(k.between(5, 9)))
    write(part.where(k == 7), "new")
    fs, last = sources.files(spark, f"{path}/now/mode19.txt")
    fs.delete(last, False)
    changed = ledger.changed_on_disk(spark, snapshot, f"{path}/now/*.txt")
    return changed.select(fn.basename(F.col("path"), ".txt").alias("name"), "change", "digest")


@query("SELECT version, kind, row_number() OVER (PARTITION BY version, kind ORDER BY entry)::INT AS place, entry FROM (SELECT o_orderdate::DATE::VARCHAR AS day, 1 AS version, CASE WHEN o_orderstatus = 'F' THEN 'existing' ELSE 'todo' END AS kind, 'order/' || o_orderstatus || '/' || o_orderkey AS entry FROM orders)")
def version_listing(spark, d):
    """The manifest of all orders listed as rows in order."""
    o = t(spark, d, "orders").select(F.lit(1).alias("version"), F.when(F.col("o_orderstatus") == "F", "existing").otherwise("todo").alias("kind"), F.lit("order").alias("name"), F.col("o_orderstatus").alias("realization"), F.col("o_orderkey").cast("int").alias("task_version"))
    return ledger.version_rows(o)


@query("SELECT 'order' AS task, o_orderkey::VARCHAR AS realization, kind, row_number() OVER (PARTITION BY o_orderkey, kind ORDER BY line)::INT AS place, line FROM (SELECT l_orderkey AS o_orderkey, 'inputs' AS kind, '{\"input_name\":\"' || l_linenumber || '/' || l_partkey || '\"}' AS line FROM lineitem UNION ALL SELECT o_orderkey, 'params', '{\"param_name\":\"priority\",\"param_value\":\"' || o_orderpriority || '\"}' FROM orders UNION ALL SELECT o_orderkey, 'outputs', '{\"output_name\":\"total\"}' FROM orders WHERE o_totalprice > 100000)")
def ledger_listing(spark, d):
    """Ledger tables kept in buckets, joined without a shuffle, and reported line by line."""
    import uuid

    key = lambda c: [F.lit("order").alias("task"), F.col(c).cast("string").alias("realization")]
    o, path, name = t(spark, d, "orders"), place(spark, "ledger"), f"ledger_{uuid.uuid4().hex}"
    inputs = t(spark, d, "lineitem").select(*key("l_orderkey"), F.concat_ws("/", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("input_name"))
    outputs = o.where("o_totalprice > 100000").select(*key("o_orderkey"), F.lit("total").alias("output_name"))
    params = o.select(*key("o_orderkey"), F.lit("priority").alias("param_name"), F.col("o_orderpriority").alias("param_value"))
    sources.ledger_save(name, path, 8, tasks=o.select(*key("o_orderkey")), inputs=inputs, outputs=outputs, params=params)
    return sources.status_lines(*(sources.ledger_table(spark, name, k) for k in ("tasks", "inputs", "outputs", "params"))).select("task", "realization", "kind", "place", "line")


def _in_rocks(spark, run):
    """Stateful processors keep their state in RocksDB; the setting is put back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


@query("SELECT 'order:' || l_orderkey AS child, count(*) AS n_parents FROM (SELECT l_orderkey, l_linenumber, bool_and(l_linestatus = 'F' AND l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING bool_and(ok)")
def ready_stream(spark, d):
    """Orders that can go on, sent as their lines are done: three batches of a stream that is stopped in between and goes on from its checkpoint."""
    path = place(spark, "ready")
    line = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    failed = F.max((F.col("l_returnflag") == "R").cast("int")) == 1
    done = F.min((F.col("l_linestatus") == "F").cast("int")) == 1
    lines = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.when(failed, "failed").when(done, "completed").otherwise("running").alias("status"), F.max("l_shipdate").alias("ts"))
    events = sources.stored(lines.select("ts", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event_id"), line.alias("parent"), "status", "l_linenumber"))
    edges = sources.stored(streaming.with_need(t(spark, d, "lineitem").select(line.alias("parent"), F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("child"))))
    rows = events.drop("l_linenumber")

    def send(some: DataFrame) -> None:
        some.select(rows.columns).write.mode("append").parquet(f"{path}/events")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/events")
        out = streaming.ready(stream, edges).writeStream.format("parquet").option("path", f"{path}/sent").option("checkpointLocation", f"{path}/checkpoint")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    third = F.pmod(F.hash("event_id"), F.lit(3))
    _in_rocks(spark, lambda: [send(events.where(third == i)) for i in range(3)])
    sources.discard(events, edges)
    return spark.read.schema("child string, n_parents long").parquet(f"{path}/sent")


@query("SELECT user_id::VARCHAR AS task, event_type AS realization, CASE event_type WHEN 'signup' THEN 'completed' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, max(event_id) AS event_id FROM events GROUP BY ALL")
def live_status_late(spark, d):
    """Last status of each user and kind from a stream in four batches whose events come out of order, with state that expires."""
    path = place(spark, "late")
    kind = F.create_map(*(F.lit(x) for kv in {"signup": "skip", "view": "begin", "click": "begin", "purchase": "succeed", "error": "fail"}.items() for x in kv))[F.col("event_type")]
    rows = t(spark, d, "events").select("ts", "event_id", F.col("user_id").cast("string").alias("task"), F.col("event_type").alias("realization"), kind.alias("event"))
    rows.repartition(4, F.pmod(F.hash("event_id"), F.lit(4))).write.parquet(f"{path}/events")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/events")
    span = rows.agg(F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))).first()[0] or 0
    changes = streaming.live_status_changes(stream, f"{span + 1} seconds", 2 * span + 2)

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")

    _in_rocks(spark, lambda: changes.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination())
    got = spark.read.schema(changes.schema).parquet(f"{path}/changes")
    return got.groupBy("task", "realization").agg(F.max_by(F.struct("status", "event_id"), F.struct("at", "event_id")).alias("s")).select("task", "realization", "s.status", "s.event_id")
