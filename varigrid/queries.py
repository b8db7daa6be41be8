"""The library's queries over the test tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid import functions as fn
from varigrid import plans, sources, streaming
from varigrid.operators import checks, ledger, lineage, summary, sweep, variants
from varigrid.plans import BranchPoint

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIN_QTY = BranchPoint("MinQty", {"lo": 1, "hi": 25})
MIN_DISC = BranchPoint("MinDisc", {"d0": 0.0, "d5": 0.05, "d9": 0.09})


def _sums() -> dict:
    return {"n_lines": F.lit(1).cast("long"), "revenue_cents": F.floor(F.col("l_extendedprice") * 100).cast("long")}


_GRID = "(SELECT * FROM (VALUES ('lo', 1), ('hi', 25)) q(bp_MinQty, q), (VALUES ('d0', 0.0::DOUBLE), ('d5', 0.05::DOUBLE), ('d9', 0.09::DOUBLE)) d(bp_MinDisc, d))"
_NAME = "coalesce(nullif(concat_ws('+', CASE WHEN bp_MinDisc <> 'd0' THEN 'MinDisc.' || bp_MinDisc END, CASE WHEN bp_MinQty <> 'lo' THEN 'MinQty.' || bp_MinQty END), ''), 'Baseline.baseline')"
_SWEEP = f"SELECT bp_MinQty, bp_MinDisc, {_NAME} AS realization, count(*) AS n_lines, sum(floor(l_extendedprice * 100)::BIGINT)::BIGINT AS revenue_cents FROM lineitem JOIN {_GRID} g ON l_quantity >= q AND l_discount >= d"


def _named(df: DataFrame, *points: BranchPoint) -> DataFrame:
    return df.withColumn("realization", fn.realization({p.name: F.col(p.column) for p in points}, {p.name: p.baseline for p in points}))


@query(f"{_SWEEP} WHERE (bp_MinQty <> 'lo')::INT + (bp_MinDisc <> 'd0')::INT <= 1 GROUP BY ALL")
def sweep_one_off(spark, d):
    """Line count and revenue with one threshold varied at a time."""
    points = [MIN_QTY, MIN_DISC]
    on = {"MinQty": "l_quantity", "MinDisc": "l_discount"}
    return _named(sweep.sweep_thresholds(t(spark, d, "lineitem"), points, plans.one_off(points), on, _sums()), *points)


@query(f"{_SWEEP} GROUP BY ALL")
def sweep_cross(spark, d):
    """All combinations, from one pass that reduces lines to threshold cells."""
    points = [MIN_QTY, MIN_DISC]
    on = {"MinQty": "l_quantity", "MinDisc": "l_discount"}
    return _named(sweep.sweep_thresholds(t(spark, d, "lineitem"), points, plans.cross(points), on, _sums()), *points)


@query("SELECT bp_MinDisc, count(*) AS n_lines FROM lineitem JOIN (VALUES ('0', 0.0::DOUBLE), ('0.02', 0.02::DOUBLE), ('0.04', 0.04::DOUBLE), ('0.06', 0.06::DOUBLE), ('0.08', 0.08::DOUBLE), ('0.1', 0.1::DOUBLE)) g(bp_MinDisc, d) ON l_discount >= d GROUP BY ALL")
def sweep_seq(spark, d):
    """A sequence of discount thresholds."""
    p = plans.sequence("MinDisc", "0", "0.1", "0.02")
    return sweep.sweep_thresholds(t(spark, d, "lineitem"), [p], plans.cross([p]), {"MinDisc": "l_discount"}, {"n_lines": F.lit(1).cast("long")})


LANG = BranchPoint("Lang", {"en": "en", "other": "other"})
MIN_LEN = BranchPoint("MinLen", {"any": 0, "long": 2000})
SOURCE = BranchPoint("Source", {"all": "src", "first": "src1"})


def _documents(spark, d) -> variants.VariantFrame:
    docs = t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    nested = variants.branch_nested(variants.variants(docs), LANG, {"en": lambda v: variants.branch(v, MIN_LEN, into="min_len"), "other": lambda v: variants.branch(v, SOURCE, into="prefix")})
    ok = ((F.col("bp_Lang") == "en") & (F.col("lang") == "en") & (F.col("n_chars") >= F.col("min_len"))) | ((F.col("bp_Lang") == "other") & (F.col("lang") != "en") & F.col("source").startswith(F.col("prefix")))
    return nested.where(ok)


_NESTED = "SELECT 'en' AS bp_Lang, b AS bp_MinLen, NULL AS bp_Source, doc_id, n_chars FROM documents JOIN (VALUES ('any', 0), ('long', 2000)) m(b, v) ON lang = 'en' AND n_chars >= v UNION ALL SELECT 'other', NULL, b, doc_id, n_chars FROM documents JOIN (VALUES ('all', 'src'), ('first', 'src1')) s(b, v) ON lang <> 'en' AND starts_with(source, v)"


@query(f"SELECT bp_Lang, bp_MinLen, bp_Source, count(*) AS n FROM ({_NESTED}) GROUP BY ALL")
def sweep_nested(spark, d):
    """Points that exist under one outer branch only."""
    vf = _documents(spark, d)
    return vf.df.groupBy("bp_Lang", "bp_MinLen", "bp_Source").agg(F.count(F.lit(1)).alias("n"))


_THRESHOLDS = "(VALUES ('any', NULL, 'a', 1000), ('long', NULL, 'a', 3000), (NULL, 'all', 'a', 2000), (NULL, NULL, 'b', 500)) h(m, s, bp_Cut, cut)"


@query(f"SELECT bp_Lang, coalesce(bp_MinLen, m) AS bp_MinLen, coalesce(bp_Source, s) AS bp_Source, bp_Cut, count(*) AS n, sum((n_chars >= cut)::INT)::BIGINT AS n_over FROM ({_NESTED}) v JOIN {_THRESHOLDS} ON (bp_MinLen IS NULL OR m IS NULL OR bp_MinLen = m) AND (bp_Source IS NULL OR s IS NULL OR bp_Source = s) GROUP BY ALL")
def compat_join(spark, d):
    """Nested variants of documents joined with thresholds that have some of their points."""
    rows = [("any", None, "a", 1000), ("long", None, "a", 3000), (None, "all", "a", 2000), (None, None, "b", 500)]
    h = spark.createDataFrame(rows, "bp_MinLen string, bp_Source string, bp_Cut string, cut int")
    cut_point = BranchPoint("Cut", {"a": None, "b": None})
    masks = frozenset(frozenset(x) for x in (["MinLen", "Cut"], ["Source", "Cut"], ["Cut"]))
    right = variants.VariantFrame(h, {"MinLen": MIN_LEN, "Source": SOURCE, "Cut": cut_point}, masks)
    j = variants.vjoin(_documents(spark, d), right).df
    return j.groupBy("bp_Lang", "bp_MinLen", "bp_Source", "bp_Cut").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("n_chars") >= F.col("cut")).cast("long")).alias("n_over"))


SIZE = BranchPoint("WhichSize", {"smaller": 50000, "bigger": 150000})
N_POINT = BranchPoint("N", {"one": "O", "two": "F"})
M_POINT = BranchPoint("M", {str(i): i for i in range(1, 11)})
PLAN_POINTS = [SIZE, N_POINT, M_POINT]
PLANS = {"Basic": [{"WhichSize": "*", "M": "*"}, {"WhichSize": "*", "N": ["two"]}, {"WhichSize": "*", "N": ["two"], "M": ["10"]}]}
_PLAN_GRID = "(SELECT * FROM (VALUES ('smaller', 50000), ('bigger', 150000)) s(bp_WhichSize, vs), (VALUES ('one', 'O'), ('two', 'F')) n(bp_N, vn), (SELECT i::VARCHAR AS bp_M, i AS vm FROM range(1, 11) r(i)))"
_CLAUSES = ["bp_N = 'one'", "bp_N = 'two' AND bp_M = '1'", "bp_N = 'two' AND bp_M = '10'"]


@query(f"SELECT bp_WhichSize, bp_N, bp_M, count(o_orderkey) AS n_orders FROM {_PLAN_GRID} g LEFT JOIN orders ON o_orderstatus = vn AND month(o_orderdate) = vm AND o_totalprice >= vs WHERE {' OR '.join(f'({c})' for c in _CLAUSES)} GROUP BY ALL")
def plan_union(spark, d):
    """Orders per realization of the union of three plan clauses."""
    g = plans.plan_union(plans.grid(spark, PLAN_POINTS, plans.cross(PLAN_POINTS)), PLAN_POINTS, PLANS, ["Basic"])
    o = t(spark, d, "orders")
    cells = o.join(g, (F.col("o_orderstatus") == F.col("val_N")) & (F.month("o_orderdate") == F.col("val_M")) & (F.col("o_totalprice") >= F.col("val_WhichSize")))
    n = cells.groupBy("bp_WhichSize", "bp_N", "bp_M").agg(F.count(F.lit(1)).alias("n_"))
    keys = ["bp_WhichSize", "bp_N", "bp_M"]
    return g.select(*keys).join(n, keys, "left").select(*keys, F.coalesce("n_", F.lit(0)).alias("n_orders"))


_REASON = ["CASE WHEN bp_N <> 'one' THEN 'N.' || bp_N || ' not in plan' END", "CASE WHEN bp_N <> 'two' THEN 'N.' || bp_N || ' not in plan' WHEN bp_M <> '1' THEN 'M.' || bp_M || ' not in plan' END", "CASE WHEN bp_N <> 'two' THEN 'N.' || bp_N || ' not in plan' WHEN bp_M <> '10' THEN 'M.' || bp_M || ' not in plan' END"]


@query(" UNION ALL ".join(f"SELECT {i}::INT AS clause, bp_WhichSize, bp_N, bp_M, {r} IS NULL AS accepted, {r} AS reason, (SELECT count(*) FROM orders WHERE o_orderstatus = vn) AS n_orders FROM {_PLAN_GRID} g" for i, r in enumerate(_REASON)))
def plan_explain(spark, d):
    """Every realization under every clause with the reason it is refused, and the orders it would look at."""
    g = plans.explain_plan(plans.grid(spark, PLAN_POINTS, plans.cross(PLAN_POINTS)), PLAN_POINTS, PLANS)
    n = t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("val_N")).agg(F.count(F.lit(1)).alias("n_orders"))
    return g.join(n, "val_N", "left").select("clause", "bp_WhichSize", "bp_N", "bp_M", "accepted", "reason", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


FLAG = BranchPoint("Flag", {"N": None, "A": None, "R": None})
STATUS = BranchPoint("Status", {"O": None, "F": None})
_RN = "coalesce(nullif(concat_ws('+', CASE WHEN l_returnflag <> 'N' THEN 'Flag.' || l_returnflag END, CASE WHEN l_linestatus <> 'O' THEN 'Status.' || l_linestatus END), ''), 'Baseline.baseline')"


def _shipments(spark, d) -> variants.VariantFrame:
    df = t(spark, d, "lineitem").withColumnsRenamed({"l_returnflag": "bp_Flag", "l_linestatus": "bp_Status"})
    return variants.VariantFrame(df, {"Flag": FLAG, "Status": STATUS}, frozenset([frozenset(["Flag", "Status"])]))


@query(f"SELECT {_RN} AS realization, count(*) AS n FROM lineitem GROUP BY 1")
def realization_name(spark, d):
    return _shipments(spark, d).named().groupBy("realization").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'Flag.' || l_returnflag || '+Status.' || l_linestatus AS realization_full, count(*) AS n FROM lineitem GROUP BY 1")
def realization_full(spark, d):
    return _shipments(spark, d).named(full=True).groupBy("realization_full").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE regexp_full_match(p_name, '(red|small).*') AND regexp_full_match(p_type, '.*O.O.*')")
def glob_match(spark, d):
    return t(spark, d, "part").where(fn.match_name(F.col("p_name"), "{red,small}*") & fn.match_name(F.col("p_type"), "*O?O*")).select("p_partkey", "p_name", "p_type")


@query("SELECT bp_Flag, bp_Status, count(*) AS n FROM (SELECT l_returnflag AS bp_Flag, l_linestatus AS bp_Status FROM lineitem) WHERE regexp_full_match(bp_Flag, '[AR]') AND bp_Status = 'O' GROUP BY ALL")
def realization_glob(spark, d):
    vf = _shipments(spark, d)
    return vf.df.where(plans.match_realization([FLAG, STATUS], "Flag.[AR]")).groupBy("bp_Flag", "bp_Status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT bp_Region, n_suppliers, n_customers FROM (SELECT n_regionkey::VARCHAR AS bp_Region, count(*) AS n_suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) JOIN (SELECT n_regionkey::VARCHAR AS bp_Region, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) USING (bp_Region)")
def shared_point_join(spark, d):
    region = BranchPoint("Region", {str(i): i for i in range(5)})
    nation = t(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("bp_Region"))

    def per_region(name: str, key: str, out: str) -> variants.VariantFrame:
        df = t(spark, d, name).join(nation, F.col(key) == F.col("n_nationkey")).groupBy("bp_Region").agg(F.count(F.lit(1)).alias(out))
        return variants.VariantFrame(df, {"Region": region}, frozenset([frozenset(["Region"])]))

    return variants.vjoin(per_region("supplier", "s_nationkey", "n_suppliers"), per_region("customer", "c_nationkey", "n_customers")).df


@query("SELECT l_linestatus AS bp_Status, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def graft_filter(spark, d):
    return variants.graft(_shipments(spark, d), Flag="A").df.groupBy("bp_Status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT priority, f.n AS n_filled, o.n AS n_open FROM (SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f JOIN (SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) o USING (priority)")
def graft_pair(spark, d):
    point = BranchPoint("Order", {"P": None, "F": None, "O": None})
    df = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("bp_Order")).agg(F.count(F.lit(1)).alias("n"))
    vf = variants.VariantFrame(df, {"Order": point}, frozenset([frozenset(["Order"])]))
    side = lambda b, name: variants.VariantFrame(variants.graft(vf, Order=b).df.withColumnRenamed("n", name), {})
    return variants.vjoin(side("F", "n_filled"), side("O", "n_open"), ["priority"]).df


@query("SELECT l_returnflag AS bp_Flag, string_agg(s || '=' || n, ' ' ORDER BY CASE s WHEN 'O' THEN 1 ELSE 2 END) AS cell FROM (SELECT l_returnflag, l_linestatus AS s, count(*)::VARCHAR AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def glob_gather(spark, d):
    vf = _shipments(spark, d)
    cells = vf.df.groupBy("bp_Flag", "bp_Status").agg(F.concat("bp_Status", F.lit("="), F.count(F.lit(1)).cast("string")).alias("cell"))
    return summary.gather(variants.VariantFrame(cells, vf.points, vf.masks), ["Status"], "cell", " ")


@query("SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def dedupe_after_graft(spark, d):
    vf = variants.graft(_shipments(spark, d), Flag="A")
    slim = variants.VariantFrame(vf.df.select("l_orderkey", "l_partkey", F.col("l_partkey").alias("order_")), {})
    return variants.dedupe(slim, ["l_orderkey"], "order_").df.drop("order_")


_METRICS = "(SELECT l_returnflag AS f, l_linestatus AS s, 'lines' AS label, count(*)::VARCHAR AS v FROM lineitem GROUP BY 1, 2 UNION ALL SELECT l_returnflag, l_linestatus, 'max_qty', max(l_quantity::INT)::VARCHAR FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2)"


def _metrics(spark, d) -> DataFrame:
    df, by = _shipments(spark, d).df, ["bp_Flag", "bp_Status"]
    return summary.metric(df, by, lines=F.count(F.lit(1))).unionByName(summary.metric(df.where("bp_Flag <> 'A'"), by, max_qty=F.max(F.col("l_quantity").cast("int"))))


@query(f"SELECT f AS bp_Flag, s AS bp_Status, coalesce(max(v) FILTER (label = 'lines'), '--') AS lines, coalesce(max(v) FILTER (label = 'max_qty'), '--') AS max_qty FROM {_METRICS} GROUP BY ALL")
def summary_pivot(spark, d):
    return summary.summarize(_metrics(spark, d), ["bp_Flag", "bp_Status"], ["lines", "max_qty"])


@query(f"SELECT f AS bp_Flag, label, count(*) AS writes FROM {_METRICS} GROUP BY ALL HAVING count(*) > 1")
def summary_conflict(spark, d):
    """Cells written twice once the status point is lost."""
    return summary.check_cells(_metrics(spark, d), ["bp_Flag"])


@query("SELECT 'Flag' AS branch_point, count(DISTINCT l_returnflag) AS n_branches, false AS constant FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT 'Status', count(DISTINCT l_linestatus), true FROM lineitem WHERE l_linestatus = 'F'")
def constant_points(spark, d):
    return summary.branch_counts(_shipments(spark, d).df.where("bp_Status = 'F'"), ["bp_Flag", "bp_Status"])


@query(f"SELECT f AS bp_Flag, s AS bp_Status, v, row_number() OVER (ORDER BY f, v::DOUBLE DESC) AS rank FROM {_METRICS} WHERE label = 'lines'")
def tabular_sort(spark, d):
    """A summary sorted by text, then by number, with the place of each row; there is one row per realization."""
    df = _metrics(spark, d).where("label = 'lines'").select("bp_Flag", "bp_Status", F.col("value").alias("v"))
    return summary.ranked(df, [("bp_Flag", "text", False), ("v", "number", True)])


_EDGES = """(SELECT 'region:' || n_regionkey AS parent, 'nation:' || n_nationkey AS child FROM nation
 UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer UNION SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
 UNION SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders UNION SELECT 'order:' || l_orderkey, 'line:' || l_orderkey || '/' || l_linenumber FROM lineitem
 UNION SELECT 'supplier:' || l_suppkey, 'line:' || l_orderkey || '/' || l_linenumber FROM lineitem)"""


def _edge_sql() -> str:
    return _EDGES


def entity_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges region, nation, customer or supplier, order, line of the tables' keys, as often as the tables have them; closures and levels take each once."""
    def edge(name: str, a: str, ac: str, b: str, *bc: str) -> DataFrame:
        ident = lambda kind, *cols: F.concat(F.lit(f"{kind}:"), F.concat_ws("/", *(F.col(c).cast("string") for c in cols)))
        return t(spark, d, name).select(ident(a, ac).alias("parent"), ident(b, *bc).alias("child"))

    parts = [edge("nation", "region", "n_regionkey", "nation", "n_nationkey"), edge("customer", "nation", "c_nationkey", "customer", "c_custkey"), edge("supplier", "nation", "s_nationkey", "supplier", "s_suppkey"), edge("orders", "customer", "o_custkey", "order", "o_orderkey"), edge("lineitem", "order", "l_orderkey", "line", "l_orderkey", "l_linenumber"), edge("lineitem", "supplier", "l_suppkey", "line", "l_orderkey", "l_linenumber")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return sources.stored(out)


@query(f"WITH RECURSIVE e AS {_EDGES}, r AS (SELECT DISTINCT 'line:' || l_orderkey || '/' || l_linenumber AS node FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01' UNION SELECT parent FROM r JOIN e ON child = node) SELECT node FROM r")
def lineage_required(spark, d):
    """Everything that the lines shipped late need."""
    goals = t(spark, d, "lineitem").where("l_shipdate >= timestamp '2001-06-01'").select(F.concat(F.lit("line:"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("node"))
    return lineage.required_for(entity_edges(spark, d), goals)


@query(f"WITH RECURSIVE e AS {_EDGES}, r AS (SELECT 'nation:3' AS node UNION SELECT child FROM r JOIN e ON parent = node) SELECT node FROM r WHERE node NOT LIKE 'supplier:%'")
def lineage_invalidate(spark, d):
    """A nation and all that depends on it, of results that exist; suppliers were never stored."""
    edges = entity_edges(spark, d)
    stored = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct().where("NOT startswith(node, 'supplier:')")
    return lineage.invalidate(edges, stored, F.col("node") == "nation:3")


@query(f"WITH RECURSIVE e AS {_EDGES}, r AS (SELECT DISTINCT 'order:' || l_orderkey AS node, l_returnflag AS branch FROM lineitem UNION SELECT parent, branch FROM r JOIN e ON child = node) SELECT node, branch FROM r")
def graft_relax(spark, d):
    """Flags pinned at orders, allowed on all ancestors."""
    pins = t(spark, d, "lineitem").select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("node"), F.col("l_returnflag").alias("branch")).distinct()
    return lineage.relaxations(entity_edges(spark, d), pins)


@query(f"WITH RECURSIVE e AS {_EDGES}, r AS (SELECT DISTINCT parent AS node, 1 AS level FROM e WHERE parent NOT IN (SELECT child FROM e) UNION SELECT child, level + 1 FROM r JOIN e ON parent = node) SELECT node, max(level)::INT AS level FROM r GROUP BY 1")
def levels(spark, d):
    return lineage.levels(entity_edges(spark, d))


@query("SELECT DISTINCT 'customer:' || o_custkey AS parent, 'line:' || l_orderkey || '/' || l_linenumber AS child FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def collapse_virtual(spark, d):
    """Customers to lines, orders being virtual."""
    o, l = t(spark, d, "orders"), t(spark, d, "lineitem")
    order = lambda c: F.concat(F.lit("order:"), F.col(c).cast("string"))
    up = o.select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("parent"), order("o_orderkey").alias("child"))
    down = l.select(order("l_orderkey").alias("parent"), F.concat(F.lit("line:"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("child"))
    edges = up.union(down)
    out = lineage.collapse(edges, o.select(order("o_orderkey").alias("node")).union(l.select(order("l_orderkey"))))
    return out


@query("SELECT conv_id, turn, (turn + 1)::INT AS depth FROM conversations")
def conversation_chain(spark, d):
    """Depth of each turn in the chain to the turn before; turns are numbered from 0 without gaps."""
    c = t(spark, d, "conversations")
    node = lambda shift: F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") - shift).cast("string"))
    last = F.concat_ws("/", F.col("conv_id").cast("string"), F.lit("start"))
    edges = c.select(F.when(F.col("turn") > 0, node(1)).otherwise(last).alias("parent"), node(0).alias("child"))
    rows = lineage.levels(edges).where("NOT endswith(node, 'start')")
    return rows.select(F.split("node", "/")[0].cast("long").alias("conv_id"), F.split("node", "/")[1].cast("long").alias("turn"), (F.col("level") - 1).alias("depth"))


@query("SELECT DISTINCT l_orderkey AS k, 'undeclared' AS problem, 'warn' AS severity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION SELECT o_orderkey, 'unused', 'warn' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def key_check(spark, d):
    return checks.check_keys(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), t(spark, d, "orders").select(F.col("o_orderkey").alias("k")), "k")


@query("SELECT k AS c_custkey, f AS o_orderstatus FROM (SELECT DISTINCT o_custkey AS k FROM orders), (VALUES ('F'), ('O'), ('P')) v(f) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = k AND o_orderstatus = f)")
def missing_keys(spark, d):
    """Order statuses that a customer's orders lack."""
    facts = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    statuses = plans.dimension(spark, [BranchPoint("Status", {"F": None, "O": None, "P": None})]).select(F.col("branch").alias("o_orderstatus"))
    return checks.missing_keys(facts, statuses, "c_custkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return checks.duplicate_keys(t(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT 'user' || user_id AS task, event_type AS realization, count(*) AS n_inputs, count(*) FILTER (value > 10) AS n_outputs, 1::BIGINT AS n_params FROM events GROUP BY ALL")
def status_report(spark, d):
    """The report of ledger tables as rows, and how many lines of each kind a result has."""
    e = t(spark, d, "events").select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("task"), F.col("event_type").alias("realization"), "event_id", "value")
    tasks = e.select("task", "realization").distinct()
    inputs = e.select("task", "realization", F.col("event_id").cast("string").alias("input_name"))
    outputs = e.where("value > 10").select("task", "realization", F.col("event_id").cast("string").alias("output_name"))
    params = tasks.withColumns({"param_name": F.lit("kind"), "param_value": F.col("realization")})
    lines = sources.status_lines(tasks, inputs, outputs, params)
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    return lines.groupBy("task", "realization").agg(n("inputs"), n("outputs"), n("params"))


def _run_ledger(spark, d) -> DataFrame:
    e = t(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.count(F.lit(1)).alias("n"))
    last = F.col("last")
    return e.select(
        F.col("user_id").cast("string").alias("task"), F.lit(fn.BASELINE).alias("realization"), F.col("n").cast("int").alias("version"), (last != "signup").alias("has_dir"), (last != "view").alias("has_version_file"),
        F.when(last == "error", "1\n").when(last.isin("purchase", "click"), "0\n").alias("exit_code"), F.lit(True).alias("has_stdout"), F.lit(True).alias("has_stderr"), F.lit(False).alias("invalidated"), (last == "purchase").alias("outputs_exist"), (last == "click").alias("locked"),
    )


_STATE = "(SELECT user_id, CASE last WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'locked' WHEN 'view' THEN 'broken' WHEN 'error' THEN 'partial' ELSE 'fresh' END AS state FROM (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY 1))"


@query(f"SELECT user_id::VARCHAR AS task, state FROM {_STATE}")
def classify_runs(spark, d):
    """Each user's last event as the state of a run."""
    led = _run_ledger(spark, d)
    return ledger.classify(led.select("task", "realization"), led).select("task", "state")


@query(f"SELECT CASE state WHEN 'complete' THEN 'reuse' WHEN 'locked' THEN 'wait' WHEN 'broken' THEN 'delete' WHEN 'partial' THEN 'archive' ELSE 'run' END AS action, count(*) AS n FROM {_STATE} GROUP BY 1")
def work_plan(spark, d):
    led = _run_ledger(spark, d)
    return ledger.work_plan(ledger.classify(led.select("task", "realization"), led))


def _planned(spark, d) -> tuple[DataFrame, DataFrame]:
    planned = t(spark, d, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_orderstatus").alias("realization"))
    done = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(F.every(F.col("l_linestatus") == "F").alias("ok")).where("ok")
    return planned, planned.join(done, "task", "left_semi")


_DONE = "(SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_linestatus = 'F'))"


@query(f"SELECT o_orderkey AS task, o_orderstatus AS realization FROM orders WHERE o_orderkey NOT IN {_DONE}")
def todo_anti(spark, d):
    return ledger.todo(*_planned(spark, d))


@query(f"SELECT o_orderkey AS task, o_orderstatus AS realization FROM orders WHERE o_orderkey IN {_DONE}")
def reuse_semi(spark, d):
    return ledger.reused(*_planned(spark, d))


@query("SELECT user_id AS task, event_type AS realization, max(event_id) AS version, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def latest_version(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_type").alias("realization"), F.col("event_id").alias("version"), "value")
    return ledger.latest_version(e)


@query("SELECT l_orderkey AS src_task, l_linenumber, coalesce(v, 99)::INT AS src_version FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) LEFT JOIN (SELECT o_orderkey, 1 AS v FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey")
def bound_versions(spark, d):
    edges = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("src_task"), F.lit("F").alias("src_realization"), "l_linenumber").distinct()
    v = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("task"), F.col("o_orderstatus").alias("realization"), F.lit(1).alias("version"))
    return ledger.bind_versions(edges, v, 99).select("src_task", "l_linenumber", "src_version")


@query("SELECT doc_id AS path, upper(md5(text)) AS digest, CASE WHEN source = 'src3' THEN 'new' ELSE 'changed' END AS change FROM documents WHERE source IN ('src3', 'src5')")
def changed_docs(spark, d):
    """Documents against a snapshot that lacks one source and has other texts for another."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.lit(0).alias("modified"), "text", "source")
    snap = docs.where("source <> 'src3'").select("path", F.when(F.col("source") == "src5", F.col("size") + 1).otherwise(F.col("size")).alias("size"), "modified", F.when(F.col("source") == "src5", F.lit("x")).otherwise(F.upper(F.md5("text"))).alias("digest"))
    return ledger.changed_files(docs, snap, F.upper(fn.digest(F.col("text")))).select("path", "digest", "change")


@query("SELECT upper(md5(text)) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_digest(spark, d):
    return checks.duplicate_keys(t(spark, d, "documents").select(F.upper(F.md5("text")).alias("digest")), "digest")


@query("SELECT count(*) AS n_rows, sum(('0x' || substr(md5(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, (floor(o_totalprice * 100)::BIGINT)::VARCHAR)), 1, 15))::HUGEINT)::DECIMAL(38, 0) AS digest FROM orders")
def table_fingerprint(spark, d):
    return ledger.fingerprint(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.floor(F.col("o_totalprice") * 100).cast("long").alias("cents")))


@query("SELECT DISTINCT l_partkey AS path FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def missing_inputs(spark, d):
    return checks.missing_inputs(t(spark, d, "lineitem").select(F.col("l_partkey").alias("path")).distinct(), t(spark, d, "part").where("p_size < 40").select(F.col("p_partkey").alias("path")))


@query("SELECT o_orderpriority AS branch_point, count(DISTINCT branches) AS n_sets, count(DISTINCT baseline) AS n_baselines FROM (SELECT o_orderpriority, month(o_orderdate) AS m, list_sort(list(DISTINCT (o_custkey % 40)::VARCHAR)) AS branches, arg_min((o_custkey % 40)::VARCHAR, o_orderkey) AS baseline FROM orders GROUP BY 1, 2) GROUP BY 1 HAVING count(DISTINCT branches) > 1 OR count(DISTINCT baseline) > 1")
def branch_set_check(spark, d):
    """Whether the months of a priority see the same sets of customer groups."""
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("branch_point"), F.month("o_orderdate").alias("definition"), (F.col("o_custkey") % 40).cast("string").alias("branch"), F.col("o_orderkey").alias("ord"))
    return checks.check_branch_sets(o)


@query("SELECT k, sum(delta)::BIGINT AS n, sum(delta) < 0 AS error FROM (SELECT l_orderkey AS k, 1 AS delta FROM lineitem UNION ALL SELECT o_orderkey, -4 FROM orders) GROUP BY 1 HAVING sum(delta) <> 0")
def multiset_delta(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit(1).cast("long").alias("delta")).union(t(spark, d, "orders").select("o_orderkey", F.lit(-4).cast("long")))
    return checks.multiset(rows, "k")


@query("SELECT l_orderkey AS k, l_linenumber, found FROM (SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_linenumber = l.l_linenumber) AS found FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l) WHERE found <> 1")
def resolve_refs(spark, d):
    """References by order and line that find more than one definition."""
    l = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("ref"))
    _, bad = checks.resolve_refs(l.distinct(), l.select("ref"), "ref")
    return bad.select(F.col("l_orderkey").alias("k"), "l_linenumber", "found")


@query("SELECT p_brand AS package, v AS version, CASE WHEN EXISTS (SELECT 1 FROM part b WHERE b.p_brand = r.p_brand AND b.p_type = v) THEN 'built' ELSE 'build' END AS status, h AS head FROM (SELECT DISTINCT p_brand FROM part) r, (VALUES ('ECONOMY'), ('NONE')) q(v), LATERAL (SELECT arg_max(p_type, p_partkey) AS h FROM part b WHERE b.p_brand = r.p_brand)")
def stale_versions(spark, d):
    p = t(spark, d, "part")
    required = p.select(F.col("p_brand").alias("package")).distinct().withColumn("version", F.explode(F.array(F.lit("ECONOMY"), F.lit("NONE"))))
    return ledger.stale_versions(required, p.select(F.col("p_brand").alias("package"), F.col("p_type").alias("version"), F.col("p_partkey").alias("built_at")))


@query("SELECT o_orderkey, o_custkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '1998-01-01' OR l_shipdate >= TIMESTAMP '2000-01-01'")
def delta_join(spark, d):
    """Only combinations with a new order or a new line."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    l = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    new_o, new_l = F.col("o_orderdate") >= F.to_timestamp(F.lit("1998-01-01")), F.col("l_shipdate") >= F.to_timestamp(F.lit("2000-01-01"))
    v = variants.variants
    return variants.vjoin_delta(v(o.where(~new_o)), v(o.where(new_o)), v(l.where(~new_l)), v(l.where(new_l)), ["o_orderkey"]).df.select("o_orderkey", "o_custkey", "l_linenumber")


_EVENT = {"signup": "skip", "view": "begin", "click": "begin", "purchase": "succeed", "error": "fail"}


@query("SELECT user_id::VARCHAR AS task, CASE arg_max(event_type, event_id) WHEN 'signup' THEN 'completed' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM events GROUP BY 1")
def live_status(spark, d):
    """The event table read as a stream up to its end; its rows and its state are kept in the shared folder."""
    table = t(spark, d, "events")
    kind = F.create_map(*(F.lit(x) for kv in _EVENT.items() for x in kv))[F.col("event_type")]
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = lambda df: df.select("ts", "event_id", F.col("user_id").cast("string").alias("task"), F.lit("all").alias("realization"), kind.alias("event"))
    path = f"{sources.shared_dir(spark)}/live-status-{uuid.uuid4().hex}"
    out = streaming.live_status(rows(stream))
    last = []

    def write(df, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows-{batch}")
        last[:] = [f"{path}/rows-{batch}"]

    q = out.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(out.schema).parquet(*last) if last else spark.createDataFrame([], out.schema)
    return got.select("task", "status")


@query("SELECT 'order:' || l_orderkey AS child, count(*) AS n_parents FROM (SELECT l_orderkey, l_linenumber, bool_and(l_linestatus = 'F' AND l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING bool_and(ok)")
def ready_gate(spark, d):
    """Orders of which every line is done and none failed."""
    l = t(spark, d, "lineitem").withColumn("parent", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "F", "completed").otherwise("running")
    done = l.groupBy("parent").agg(F.when(F.every(status == "completed"), "completed").otherwise("failed").alias("status"))
    return streaming.ready_batch(done, l.select("parent", F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("child")))


@query("SELECT l_returnflag AS bp_Flag, l_linestatus AS bp_Status, count(*) AS n, max(l_partkey) AS top FROM lineitem GROUP BY ALL")
def per_variant_udf(spark, d):
    """Opaque code on buckets of each realization's parts, and what it gives for them merged."""
    import pandas as pd

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bp_Flag": pdf["bp_Flag"].iloc[:1], "bp_Status": pdf["bp_Status"].iloc[:1], "n": [int(pdf["n"].sum())], "top": [int(pdf["l_partkey"].max())]})

    vf = _shipments(spark, d)
    small = vf.df.groupBy("bp_Flag", "bp_Status", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = variants.per_variant(variants.VariantFrame(small, vf.points, vf.masks), body, "bp_Flag string, bp_Status string, n long, top long", ["l_partkey"], buckets)
    return parts.groupBy("bp_Flag", "bp_Status").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


@query("SELECT trial::VARCHAR AS bp_Trial, sum(CASE WHEN ('0x' || substr(md5(l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR || '/' || trial::VARCHAR), 1, 8))::BIGINT % 10 = 0 THEN 1 ELSE 0 END)::BIGINT AS n FROM lineitem, (SELECT i AS trial FROM range(1, 6) r(i)) GROUP BY 1")
def replicate_trials(spark, d):
    """Five seeded trials that each draw a tenth of the lines."""
    vf = variants.replicate(variants.variants(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber")), 5)
    h = F.conv(F.substring(F.md5(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("trial").cast("string"))), 1, 8), 16, 10).cast("long")
    return vf.df.groupBy("bp_Trial").agg(F.sum((h % 10 == 0).cast("long")).alias("n"))


@query("SELECT doc_id, substr(source, 1, 3) AS head, CASE WHEN 2 * n_chars + 1 < 1024 THEN printf('%.1f B', (2 * n_chars + 1)::DOUBLE) ELSE printf('%.1f KB', (2 * n_chars + 1) / 1024.0) END AS size, n_chars % 2 = 0 AS even FROM documents")
def scalar_functions(spark, d):
    """Sizes, parts of names and boolean words of documents."""
    docs = t(spark, d, "documents")
    word = F.when(F.col("n_chars") % 2 == 0, "enable").otherwise("F")
    return docs.select("doc_id", fn.split_first(F.concat(F.substring("source", 1, 3), F.lit("/"), F.col("source")), "/")[0].alias("head"), fn.human_size(2 * F.col("n_chars") + 1).alias("size"), fn.parse_bool(word).alias("even"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep_one_off(spark, sf_dir)


from varigrid import queries_derived, queries_store  # noqa: E402, F401  register their queries here
