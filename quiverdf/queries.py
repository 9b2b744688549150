"""Registered queries of the graph engine over the star schema's tables, each with the SQL that gives its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import Scope, compile_expression
from .functions.program import fold
from .operators import similarity, vectors
from .plans import mutate, plugins, query
from .plans.graph import Graph
from .sources.shared import folder
from .sources.tables import NOW, star_graph, table
from .streaming import oplog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def take(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return take


def graph(spark, d, *only):
    return star_graph(spark, d, set(only))


PLACED = "FROM customer JOIN orders ON o_custkey = c_custkey"
ARC = "'C' || c_custkey AS anchor, 'O' || o_orderkey AS id, o_totalprice AS val"
LINES = "(SELECT l_orderkey, l_partkey, sum(l_extendedprice) AS price, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY ALL)"
CONTAINS = f"""(SELECT l_orderkey, l_partkey, 'M_FLT' AS mod, price AS val FROM {LINES} UNION ALL SELECT l_orderkey, l_partkey, 'M_INT', quantity FROM {LINES}
    UNION ALL SELECT l_orderkey, l_partkey, 'M_CNT', CAST(n AS DOUBLE) FROM {LINES})"""


@register("neighborhood_topk", f"SELECT {ARC} {PLACED} WHERE c_custkey = 7 AND o_totalprice > 1000 ORDER BY val DESC, id LIMIT 5")
def neighborhood_topk(spark, d):
    out = query.neighborhood(graph(spark, d, "customer", "orders"), "C7", ("placed", "D_OUT", "M_FLT", "V_GT", 1000.0), sortby="S_VAL", hits=5)
    return out.select("anchor", "id", "val")


@register("neighborhood_offset", f"SELECT {ARC} {PLACED} WHERE c_custkey = 10 ORDER BY val, id LIMIT 3 OFFSET 2")
def neighborhood_offset(spark, d):
    return query.neighborhood(graph(spark, d, "customer", "orders"), "C10", "placed", sortby=("S_VAL", "S_ASC"), hits=3, offset=2).select("anchor", "id", "val")


VALUE_CONDITIONS = {
    "lte": (("V_LTE", 50000.0), "o_totalprice <= 50000"), "lt": (("V_LT", 50000.0), "o_totalprice < 50000"), "gte": (("V_GTE", 150000.0), "o_totalprice >= 150000"), "gt": (("V_GT", 150000.0), "o_totalprice > 150000"),
    "range": (("V_RANGE", (20000.0, 80000.0)), "o_totalprice BETWEEN 20000 AND 80000"), "nrange": (("V_NRANGE", (20000.0, 180000.0)), "(o_totalprice < 20000 OR o_totalprice > 180000)"),
    "neq": (("V_NEQ", 0.0), "o_totalprice <> 0"),
}
for _name, (_cond, _where) in VALUE_CONDITIONS.items():

    @register(f"value_{_name}", f"SELECT {ARC} {PLACED} WHERE {_where}")
    def value_condition(spark, d, cond=_cond):
        out = query.neighborhood(graph(spark, d, "customer", "orders"), None, ("placed", "D_OUT", "M_FLT", *cond), condition={"type": "customer"})
        return out.select("anchor", "id", "val")


@register("arc_negated", f"SELECT {ARC} {PLACED} WHERE NOT o_totalprice > 100000")
def arc_negated(spark, d):
    out = query.neighborhood(graph(spark, d, "customer", "orders"), None, (False, ("placed", "D_OUT", "M_FLT", "V_GT", 100000.0)), neighbor={"type": "order"}, condition={"type": "customer"})
    return out.select("anchor", "id", "val")


@register("direction_in", "SELECT 'N' || n_nationkey AS anchor, 'C' || c_custkey AS id FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey = 3")
def direction_in(spark, d):
    return query.neighborhood(graph(spark, d, "nation", "customer"), "N3", ("in_nation", "D_IN")).select("anchor", "id")


@register("direction_any", """SELECT 'N' || n_nationkey AS anchor, 'R' || n_regionkey AS id, 'D_OUT' AS dir FROM nation WHERE n_nationkey = 4
    UNION ALL SELECT 'N4', 'C' || c_custkey, 'D_IN' FROM customer WHERE c_nationkey = 4""")
def direction_any(spark, d):
    return query.neighborhood(graph(spark, d, "nation", "region", "customer"), "N4", ("*", "D_ANY")).select("anchor", "id", "dir")


@register("multiple_arcs", f"SELECT 'O' || l_orderkey AS anchor, 'P' || l_partkey AS id, mod, val FROM {CONTAINS}")
def multiple_arcs(spark, d):
    g = graph(spark, d, "orders", "part", "lineitem")
    out = query.neighborhood(g, None, ("contains", "D_OUT"), condition={"type": "order"})
    return out.select("anchor", "id", "mod", "val")


@register("vertices_condition", "SELECT 'C' || c_custkey AS id, 'customer' AS type FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def vertices_condition(spark, d):
    return query.vertices(graph(spark, d, "customer", "orders"), {"type": "customer", "property": {"segment": "BUILDING", "acctbal": ("V_GT", 5000.0)}})


@register("vertices_prefix", "SELECT 'N' || n_nationkey AS id, 'nation' AS type FROM nation WHERE CAST(n_nationkey AS VARCHAR) LIKE '1%' UNION ALL SELECT 'R0', 'region'")
def vertices_prefix(spark, d):
    return query.vertices(graph(spark, d, "nation", "region"), {"id": ["N1*", "R0"]})


@register("vertices_negated", "SELECT 'N' || n_nationkey AS id, 'nation' AS type FROM nation WHERE n_nationkey % 2 = 1")
def vertices_negated(spark, d):
    return query.vertices(graph(spark, d, "nation"), (False, {"filter": "vertex['nationkey'] % 2 == 0"}))


@register("vertices_abstime", "SELECT 'O' || o_orderkey AS id FROM orders WHERE epoch(o_orderdate) BETWEEN 800000000 AND 810000000")
def vertices_abstime(spark, d):
    return query.vertices(graph(spark, d, "orders"), {"type": "order", "abstime": {"created": ("V_RANGE", (800000000, 810000000))}}).select("id")


@register("vertices_reltime", f"SELECT 'O' || o_orderkey AS id FROM orders WHERE epoch(o_orderdate) - {NOW} > -800000000")
def vertices_reltime(spark, d):
    return query.vertices(graph(spark, d, "orders"), {"type": "order", "reltime": {"modified": ("V_GT", -800000000)}}).select("id")


@register("degree_top", """SELECT 'C' || c_custkey AS id, 'customer' AS type, CAST(count(o_orderkey) AS BIGINT) AS odeg FROM customer LEFT JOIN orders ON o_custkey = c_custkey
    GROUP BY ALL ORDER BY odeg DESC, id LIMIT 20""")
def degree_top(spark, d):
    g = graph(spark, d, "customer", "orders")
    g = g.with_(arcs=g.arcs.filter("rel = 'placed'"))
    return query.vertices(g, {"type": "customer"}, sortby="S_ODEG", hits=20)


@register("degree_condition", "SELECT 'C' || o_custkey AS id FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_totalprice > 100000) >= 8")
def degree_condition(spark, d):
    return query.vertices(graph(spark, d, "customer", "orders"), {"type": "customer", "degree": (("placed", "D_OUT", "M_FLT", "V_GT", 100000.0), ("V_GTE", 8))}).select("id")


@register("degree_stored", "SELECT 'C' || o_custkey AS id FROM orders GROUP BY o_custkey HAVING count(*) + 1 > 12")
def degree_stored(spark, d):
    """Customers with more than 12 outgoing arcs: one to their nation, one to each order."""
    return query.vertices(graph(spark, d, "nation", "customer", "orders"), {"type": "customer", "outdegree": ("V_GT", 12)}).select("id")


@register("adjacent_semi", "SELECT 'C' || c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 180000)")
def adjacent_semi(spark, d):
    g = graph(spark, d, "customer", "orders")
    want = {"type": "customer", "adjacent": {"arc": ("placed", "D_OUT", "M_FLT", "V_GT", 180000.0), "neighbor": {"property": {"status": "F"}}}}
    return query.vertices(g, want).select("id")


@register("adjacent_anti", "SELECT 'C' || c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 190000)")
def adjacent_anti(spark, d):
    g = graph(spark, d, "customer", "orders")
    return query.vertices(g, {"type": "customer", "adjacent": (False, {"arc": ("placed", "D_OUT", "M_FLT", "V_GT", 190000.0)})}).select("id")


@register("two_hops", """SELECT 'N' || n_nationkey AS anchor, 'C' || c_custkey AS id FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey = 5
    AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 190000)""")
def two_hops(spark, d):
    g = graph(spark, d, "nation", "customer", "orders")
    want = {"type": "customer", "adjacent": {"arc": ("placed", "D_OUT", "M_FLT", "V_GT", 190000.0)}}
    return query.neighborhood(g, "N5", ("in_nation", "D_IN"), neighbor=want).select("anchor", "id")


@register("traverse_collect", """SELECT 'N' || c_nationkey AS anchor, 'O' || o_orderkey AS id, 'placed' AS rel, o_totalprice AS val FROM customer JOIN orders ON o_custkey = c_custkey
    WHERE c_nationkey = 6 AND o_totalprice > 150000""")
def traverse_collect(spark, d):
    g = graph(spark, d, "nation", "customer", "orders")
    want = {"traverse": {"arc": ("placed", "D_OUT", "M_FLT", "V_GT", 150000.0), "collect": "C_COLLECT"}}
    return query.neighborhood(g, "N6", ("in_nation", "D_IN"), neighbor=want, collect=False).select("anchor", "id", "rel", "val")


@register("collect_levels", """SELECT 'R' || n_regionkey AS anchor, 'N' || n_nationkey AS id FROM nation WHERE n_regionkey = 1
    UNION ALL SELECT 'R1', 'C' || c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 1""")
def collect_levels(spark, d):
    g = graph(spark, d, "region", "nation", "customer")
    want = {"traverse": {"arc": ("in_nation", "D_IN"), "collect": "C_COLLECT", "assert": True}}
    return query.neighborhood(g, "R1", ("in_region", "D_IN"), neighbor=want).select("anchor", "id")


@register("three_hops", """SELECT 'C' || c_custkey AS id FROM customer WHERE c_nationkey = 2 AND EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    JOIN part ON p_partkey = l_partkey WHERE o_custkey = c_custkey AND p_size > 45)""")
def three_hops(spark, d):
    g = graph(spark, d, "nation", "customer", "orders", "lineitem", "part")
    third = {"adjacent": {"arc": ("contains", "D_OUT", "M_CNT"), "neighbor": {"type": "part", "property": {"size": ("V_GT", 45)}}}}
    return query.neighborhood(g, "N2", ("in_nation", "D_IN"), neighbor={"type": "customer", "adjacent": {"arc": ("placed", "D_OUT"), "neighbor": third}}).select("id")


@register("dynamic_value", f"""SELECT 'O' || a.l_orderkey AS id, a.val AS val FROM {CONTAINS} a WHERE a.mod = 'M_FLT' AND a.l_partkey = 11
    AND EXISTS (SELECT 1 FROM {CONTAINS} b WHERE b.mod = 'M_FLT' AND b.l_orderkey = a.l_orderkey AND b.val > a.val)""")
def dynamic_value(spark, d):
    """Orders of a part that hold another part of greater value: each arc is held against the one before it."""
    g = graph(spark, d, "orders", "part", "lineitem")
    want = {"adjacent": {"arc": ("contains", "D_OUT", "M_FLT", "V_DYN_GT")}}
    return query.neighborhood(g, "P11", ("contains", "D_IN", "M_FLT"), neighbor=want).select("id", "val")


@register("arcs_scan", "SELECT 'N' || n_nationkey AS anchor, 'R' || n_regionkey AS id FROM nation WHERE n_nationkey > 9")
def arcs_scan(spark, d):
    return query.arcs(graph(spark, d, "nation", "region"), {"type": "nation", "filter": "vertex['nationkey'] > 9"}, "in_region").select("anchor", "id")


@register("adjacent_query", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = 7 AND o_totalprice > 150000) AS adjacent")
def adjacent_query(spark, d):
    return query.adjacent(graph(spark, d, "customer", "orders"), "C7", ("placed", "D_OUT", "M_FLT", "V_GT", 150000.0))


@register("degree_query", "SELECT count(*) AS degree FROM orders WHERE o_custkey = 7 AND o_totalprice > 50000")
def degree_query(spark, d):
    return query.degree(graph(spark, d, "customer", "orders"), "C7", ("placed", "D_OUT", "M_FLT", "V_GT", 50000.0))


@register("aggregate_query", """SELECT count(*) AS neighbors, CAST(sum(1) AS BIGINT) AS arcs, round(sum(o_totalprice), 2) AS value, CAST(count(*) AS BIGINT) AS degree, CAST(count(*) AS BIGINT) AS indegree,
    CAST(0 AS BIGINT) AS outdegree FROM orders WHERE o_custkey = 7""")
def aggregate_query(spark, d):
    out = query.aggregate(graph(spark, d, "customer", "orders"), "C7", ("placed", "D_OUT", "M_FLT"))
    return out.withColumn("value", F.round("value", 2))


#: Mode, SQL, and the shape in which both are compared: products by their logarithm, which no float noise moves.
AGGREGATES = {
    "max": ("max(val)", "{}", 2), "min": ("min(val)", "{}", 2), "average": ("avg(val)", "{} / 1000", 3), "sum": ("sum(val)", "{}", 2), "sqsum": ("sum(val * val)", "{} / 1000", 1),
    "count": ("CAST(count(*) AS DOUBLE)", "{}", 2), "product": ("product(val)", "ln({})", 6), "first": ("arg_min(val, l_orderkey_text)", "{}", 2),
}
for _name, (_sql, _shape, _digits) in AGGREGATES.items():

    @register(f"aggregate_{_name}", f"""SELECT 'P' || l_partkey AS id, '{"M_INTAGGR" if _name == "count" else "M_FLTAGGR"}' AS mod, round({_shape.format(_sql)}, {_digits}) AS val
        FROM (SELECT l_partkey, 'O' || l_orderkey AS l_orderkey_text, sum(l_extendedprice) AS val FROM lineitem GROUP BY ALL) GROUP BY l_partkey""")
    def aggregate_mode(spark, d, mode=_name, shape=_shape, digits=_digits):
        g = graph(spark, d, "orders", "part", "lineitem")
        out = query.neighborhood(g, None, ("contains", "D_OUT", "M_FLT"), condition={"type": "order"}, aggregate={"mode": mode})
        return out.select("id", "mod", F.round(F.expr(shape.format("val")), digits).alias("val"))


@register("aggregate_product_clamped", """SELECT 'P' || l_partkey AS id, least(product(n), 2147483647.0) AS val FROM (SELECT l_partkey, l_orderkey, count(*) * 7 AS n FROM lineitem GROUP BY ALL) GROUP BY l_partkey""")
def aggregate_product_clamped(spark, d):
    """Products of whole numbers stay within 32 bits."""
    g = graph(spark, d, "orders", "part", "lineitem")
    g = g.with_(arcs=g.arcs.filter("mod = 'M_CNT'").withColumn("value", F.col("value") * 7))
    return query.neighborhood(g, None, ("contains", "D_OUT", "M_CNT"), condition={"type": "order"}, aggregate={"mode": "product"}).select("id", "val")


@register("aggregate_having", """SELECT 'P' || l_partkey AS id, least(CAST(count(*) AS DOUBLE), 2147483647) AS val FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) GROUP BY l_partkey HAVING count(*) > 35
    ORDER BY val DESC, id LIMIT 10""")
def aggregate_having(spark, d):
    g = graph(spark, d, "orders", "part", "lineitem")
    out = query.neighborhood(g, None, ("contains", "D_OUT", "M_CNT"), condition={"type": "order"}, aggregate={"mode": "count", "arc": ("*", "D_OUT", None, "V_GT", 35.0)}, sortby="S_VAL", hits=10)
    return out.select("id", "val")


@register("rank_expression", """SELECT 'C' || c_custkey AS id, c_acctbal * 2 + c_nationkey AS rank FROM customer WHERE c_acctbal > 0 ORDER BY rank DESC, id LIMIT 15""")
def rank_expression(spark, d):
    return query.vertices(graph(spark, d, "customer"), {"type": "customer", "property": {"acctbal": ("V_GT", 0.0)}}, sortby="S_RANK", rank="next['acctbal'] * 2 + next['nationkey']", hits=15).select("id", "rank")


@register("select_properties", """SELECT 'N' || n_nationkey AS id, n_name AS name, 'none' AS segment, length(n_name) * 1.5 AS score FROM nation""")
def select_properties(spark, d):
    out = query.vertices(graph(spark, d, "nation"), {"type": "nation"}, select="name; segment ? 'none'; score: len(next.property('name')) * 1.5")
    return out.select("id", "name", "segment", "score")


@register("geo_distance", """SELECT 'N' || n_nationkey AS id, round(12742002 * asin(sqrt(least(1, pow(sin(radians((n_nationkey * 7) % 120 - 60 - 10) / 2), 2)
    + cos(radians(10)) * cos(radians((n_nationkey * 7) % 120 - 60)) * pow(sin(radians((n_nationkey * 13) % 300 - 150 - 20) / 2), 2))))) AS metres FROM nation""")
def geo_distance(spark, d):
    out = query.vertices(graph(spark, d, "nation"), {"type": "nation"}, select="metres: geodist(next['lat'], next['lon'], 10, 20)")
    return out.select("id", F.round("metres").alias("metres"))


@register("beam", """SELECT anchor, id, val FROM (SELECT 'C' || o_custkey AS anchor, 'O' || o_orderkey AS id, o_totalprice AS val,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, 'O' || o_orderkey) AS k FROM orders) WHERE k <= 3""")
def beam(spark, d):
    out = query.neighborhood(graph(spark, d, "customer", "orders"), None, ("placed", "D_OUT"), condition={"type": "customer"}, filter="mcull(next.arc.value, 3)")
    return out.select("anchor", "id", "val")


@register("synthetic_arcs", f"""SELECT 'O' || l_orderkey AS anchor, 'P' || l_partkey AS id, quantity * n AS val FROM {LINES} WHERE quantity * n > 40""")
def synthetic_arcs(spark, d):
    g = graph(spark, d, "orders", "part", "lineitem")
    text = "q = synarc.value('contains', M_INT); n = synarc.value('contains', M_CNT); score = q * n; collectif(score > 40, score)"
    out = query.neighborhood(g, None, ("contains", "D_OUT"), condition={"type": "order"}, filter=text, synthetic=True)
    return out.select("anchor", "id", "val")


@register("decayed_arcs", f"""SELECT 'U' || user_id AS anchor, 'E' || event_type AS id, round(total - total * ({NOW} - begun) / (ends - begun), 3) AS val FROM
    (SELECT user_id, event_type, CAST(epoch(min(ts)) AS BIGINT) AS begun, CAST(epoch(max(ts)) AS BIGINT) + 86400000 AS ends, CAST(count(*) AS DOUBLE) AS total FROM events GROUP BY ALL)
    WHERE total - total * ({NOW} - begun) / (ends - begun) > -1e18""")
def decayed_arcs(spark, d):
    g = graph(spark, d, "events")
    g = g.with_(arcs=g.arcs.filter("mod <> 'M_ACC'"))
    out = query.neighborhood(g, None, ("did", "D_OUT"), condition={"type": "user"}, filter="v = synarc.decay('did'); collectif(v > -1e18, v)", synthetic=True)
    return out.select("anchor", "id", F.round("val", 3).alias("val"))


@register("similarity_top", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT 'V' || vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]), 6) AS sim
    FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]) DESC, id LIMIT 10""")
def similarity_top(spark, d):
    g = graph(spark, d, "embeddings")
    probe = g.vertices.filter("id = 'V0'").select("vector").first()[0]
    out = query.vertices(g, {"type": "embedding"}, sortby="S_SIM", hits=10, vector=list(probe))
    return out.select("id", F.round("sim", 6).alias("sim"))


@register("similarity_condition", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT 'V' || vec_id AS id FROM embeddings, q
    WHERE list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]) >= 0.3""")
def similarity_condition(spark, d):
    g = graph(spark, d, "embeddings")
    probe = g.vertices.filter("id = 'V0'").select("vector").first()[0]
    return query.vertices(g, {"similarity": {"vector": list(probe), "score": ("V_GTE", 0.3)}}).select("id")


@register("centroid", """SELECT label, pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos""")
def centroid(spark, d):
    g = graph(spark, d, "embeddings")
    rows = g.vertices.select(F.element_at("num", "label").cast("int").alias("label"), "vector")
    return vectors.centroids(rows, "label", "vector").select("label", F.posexplode("centroid").alias("pos", "x")).select("label", (F.col("pos") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


@register("ann_search")
def ann_search(spark, d):
    """Nearest neighbors of every row whose id is divisible by 100, through fingerprint buckets, reranked exactly."""
    g = graph(spark, d, "embeddings")
    rows = g.vertices.select("id", "vector")
    return vectors.ann(rows, rows.filter("CAST(substring(id, 2) AS BIGINT) % 100 = 0"), k=10)


@register("fingerprints")
def fingerprints(spark, d):
    return vectors.fingerprints(graph(spark, d, "embeddings").vertices.select("id", "vector"))


@register("connect_upsert", f"""SELECT 'C' || o_custkey AS tail, 'O' || o_orderkey AS head, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE o_totalprice END AS value FROM orders""")
def connect_upsert(spark, d):
    """Half of the arcs come again with another value; the later one stays."""
    g = graph(spark, d, "customer", "orders")
    again = g.arcs.filter("rel = 'placed' AND CAST(substring(head, 2) AS BIGINT) % 2 = 0").withColumn("value", F.lit(1.0))
    return mutate.connect(g, again).arcs.filter("rel = 'placed'").select("tail", "head", "value")


@register("count_accumulate", f"SELECT 'O' || l_orderkey AS tail, 'P' || l_partkey AS head, mod, CASE mod WHEN 'M_CNT' THEN val * 2 ELSE val END AS value FROM {CONTAINS}")
def count_accumulate(spark, d):
    g = graph(spark, d, "orders", "part", "lineitem")
    return mutate.connect(g, g.arcs.filter("mod = 'M_CNT'")).arcs.filter("rel = 'contains'").select("tail", "head", "mod", "value")


@register("disconnect", "SELECT 'C' || o_custkey AS tail, 'O' || o_orderkey AS head FROM orders WHERE NOT o_totalprice > 100000")
def disconnect(spark, d):
    g = mutate.disconnect(graph(spark, d, "customer", "orders"), ("placed", "D_OUT", "M_FLT", "V_GT", 100000.0))
    return g.arcs.filter("rel = 'placed'").select("tail", "head")


@register("delete_vertices", """SELECT 'N' || n_nationkey AS id, n_nationkey < 5 AS virtual FROM nation WHERE n_nationkey >= 5 OR EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey)""")
def delete_vertices(spark, d):
    """Deleted vertices with arcs to them stay as virtual ones."""
    g = graph(spark, d, "nation", "region", "customer")
    gone = g.vertices.filter("type = 'nation' AND num['nationkey'] < 5").select("id")
    return mutate.delete_vertices(g, gone).vertices.filter("id LIKE 'N%'").select("id", "virtual")


@register("expire", "SELECT 'U' || user_id AS tail, 'E' || event_type AS head, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY user_id, event_type HAVING CAST(epoch(max(ts)) AS BIGINT) + 86400000 > 1790000000")
def expire(spark, d):
    return graph(spark, d, "events").live(1_790_000_000).arcs.filter("mod = 'M_CNT'").select("tail", "head", "value")


SCALARS = {
    "x / 0.5 + k % 3": "acct / 0.5 + nk % 3", "x ** 2 - 1": "acct ** 2 - 1", "k > 5 && x > 0": "CAST(nk > 5 AND acct > 0 AS BIGINT)", "k in {1, 2, 3} || x < 0": "CAST(nk IN (1, 2, 3) OR acct < 0 AS BIGINT)",
    "k in range(3, 7)": "CAST(nk >= 3 AND nk < 7 AS BIGINT)", "k notin {4, 5}": "CAST(nk NOT IN (4, 5) AS BIGINT)", "x > 0 ? sqrt(x) : -1.0": "CASE WHEN acct > 0 THEN sqrt(acct) ELSE -1.0 END",
    "sqrt(x)": "CASE WHEN acct < 0 THEN 0.0 ELSE sqrt(acct) END", "log(x)": "CASE WHEN acct <= 0 THEN -745.0 ELSE ln(acct) END", "log2(k + 1)": "log2(nk + 1)", "log10(k)": "CASE WHEN nk <= 0 THEN -324.0 ELSE log10(nk) END",
    "exp(k / 10)": "exp(nk / 10.0)", "sin(k) + cos(k) * tan(k)": "sin(nk) + cos(nk) * tan(nk)", "atan2(k, 3) + atan(k)": "atan2(nk, 3) + atan(nk)", "sinh(k / 10) + cosh(k / 10) - tanh(k)": "sinh(nk / 10.0) + cosh(nk / 10.0) - tanh(nk)",
    "rad(k) + deg(k)": "radians(nk) + degrees(nk)", "abs(x) + sign(x)": "abs(acct) + sign(acct)", "ceil(x) - floor(x)": "ceil(acct) - floor(acct)", "inv(k + 1)": "1.0 / (nk + 1)", "popcnt(k)": "bit_count(nk::BIGINT)",
    "(k & 6) | (k ^ 3)": "(nk & 6) | xor(nk, 3)", "k << 2": "nk << 2", "k >> 1": "nk >> 1", "~k": "~nk", "max(x, k) - min(x, k)": "greatest(acct, nk) - least(acct, nk)", "prox(x, k)": "256.0 / (256.0 + abs(acct - nk))",
    "sum(x, k, 1)": "acct + nk + 1", "mean(x, k, 1)": "(acct + nk + 1) / 3", "sumsqr(x, k)": "acct * acct + nk * nk", "prod(k, 2, 3)": "nk * 6.0", "stdev(k, 2)": "abs(nk - 2) / 2.0", "comb(k, 2)": "nk * (nk - 1) // 2",
    "fac(k % 7)": "factorial((nk % 7)::INT)::BIGINT", "int(x)": "trunc(acct)", "intr(x)": "round(acct)", "len(s)": "length(seg)", "startswith(s, 'BU')": "CAST(starts_with(seg, 'BU') AS BIGINT)", "s == 'BUILDING'": "CAST(seg = 'BUILDING' AS BIGINT)",
    "s == 'B*'": "CAST(starts_with(seg, 'B') AS BIGINT)", "hash(s) == hash(s)": "1", "isint(k) + isreal(x) + isstr(s)": "3", "isnan(s)": "1", "approx(x, x, 0.1)": "1", "firstval(null, k)": "nk", "strcmp(s, 'M')": "CASE WHEN seg = 'M' THEN 0 WHEN seg < 'M' THEN -1 ELSE 1 END",
}
_rows = "(SELECT c_custkey, c_acctbal AS acct, c_nationkey AS nk, c_mktsegment AS seg FROM customer)"


@register("scalar_functions", " UNION ALL ".join(f"SELECT c_custkey AS key, {i} AS f, round(CAST({sql} AS DOUBLE), 4) AS y FROM {_rows}" for i, sql in enumerate(SCALARS.values())))
def scalar_functions(spark, d):
    g = graph(spark, d, "customer")
    scope = Scope(property_types=g.property_types)
    names = {"x": "vertex['acctbal']", "k": "vertex['nationkey']", "s": "vertex['segment']"}
    for name, text in names.items():
        g.define(f"{name} := {text}")
    scope.macros = g.macros
    rows = g.vertices.filter("type = 'customer'").withColumn("vertex", F.struct("*"))
    ys = F.array(*[F.struct(F.lit(i).alias("f"), F.round(compile_expression(text, scope).col.cast("double"), 4).alias("y")) for i, text in enumerate(SCALARS)])
    return rows.select(F.expr("CAST(substring(id, 2) AS BIGINT)").alias("key"), F.explode(ys).alias("e")).select("key", "e.f", "e.y")


STRINGS = {
    "join('-', s, str(k))": "concat_ws('-', seg, nk)", "replace(s, 'U', 'oo')": "replace(seg, 'U', 'oo')", "slice(s, 1, 4)": "substr(seg, 2, 3)", "slice(s, -3, null)": "right(seg, 3)", "prefix(s, 2)": "left(seg, 2)",
    "normalize(s + '!')": "lower(seg)", "s + k": "seg || nk", "k > 10 ? s : 'low'": "CASE WHEN nk > 10 THEN seg ELSE 'low' END", "modtostr(M_FLT)": "'M_FLT'", "dirtostr(D_OUT)": "'D_OUT'", "strftime(k * 86400)": "strftime(to_timestamp(nk * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')",
    "lastval(s, null)": "seg", "vertex.id": "'C' || c_custkey", "vertex.type": "'customer'", "vertex.internalid": "md5('C' || c_custkey)",
}


@register("string_functions", " UNION ALL ".join(f"SELECT c_custkey AS key, {i} AS f, {sql} AS y FROM {_rows}" for i, sql in enumerate(STRINGS.values())))
def string_functions(spark, d):
    g = graph(spark, d, "customer")
    scope = Scope(property_types=g.property_types, macros={})
    for name, text in {"k": "vertex['nationkey']", "s": "vertex['segment']"}.items():
        g.define(f"{name} := {text}")
    scope.macros = g.macros
    rows = g.vertices.filter("type = 'customer'").withColumn("vertex", F.struct("*"))
    ys = F.array(*[F.struct(F.lit(i).alias("f"), compile_expression(text, scope).col.cast("string").alias("y")) for i, text in enumerate(STRINGS)])
    return rows.select(F.expr("CAST(substring(id, 2) AS BIGINT)").alias("key"), F.explode(ys).alias("e")).select("key", "e.f", "e.y")


@register("order_size", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS n_vertices, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS n_arcs")
def order_size(spark, d):
    g = graph(spark, d, "nation", "customer")
    return g.vertices.agg(F.count("*").alias("n_vertices")).crossJoin(g.arcs.agg(F.count("*").alias("n_arcs")))


@register("evaluate", "SELECT 2 + 3 * 4 AS y")
def evaluate(spark, d):
    return spark.range(1).select(compile_expression("2 + 3 * 4", Scope()).col.cast("int").alias("y"))


@register("program_running_sum", """SELECT 'C' || o_custkey AS anchor, 'O' || o_orderkey AS id, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, 'O' || o_orderkey
    ROWS UNBOUNDED PRECEDING), 2) AS value FROM orders""")
def program_running_sum(spark, d):
    """A memory program: each order is collected with the sum so far."""
    rows = query.neighborhood(graph(spark, d, "customer", "orders"), None, ("placed", "D_OUT"), condition={"type": "customer"})
    rows = rows.select("anchor", F.col("id").alias("next_id"), F.col("rel").alias("arc_rel"), F.col("val").alias("arc_value"))
    out = fold(rows, "store(R1, load(R1) + next.arc.value); collect(load(R1))", ["arc_value", "next_id"])
    return out.select("anchor", "id", F.round("value", 2).alias("value"))


@register("program_best", """SELECT 'C' || o_custkey AS anchor, max(o_totalprice) AS value FROM orders GROUP BY o_custkey""")
def program_best(spark, d):
    """Staging: an arc replaces the staged one if its value is greater; the last row commits."""
    rows = query.neighborhood(graph(spark, d, "customer", "orders"), None, ("placed", "D_OUT"), condition={"type": "customer"})
    rows = rows.select("anchor", F.col("id").alias("next_id"), F.col("rel").alias("arc_rel"), F.col("val").alias("arc_value"))
    last = rows.groupBy("anchor").agg(F.lit(None).cast("string").alias("next_id"), F.lit("end").alias("arc_rel"), F.lit(1e300).alias("arc_value"))
    text = "next.arc.type == 'end' ? commit() : (next.arc.value > load(R1) ? do(store(R1, next.arc.value), stage()) : 0)"
    rows = rows.unionByName(last).withColumn("arc_type", F.col("arc_rel"))
    return fold(rows, text, ["arc_value", "next_id"]).select("anchor", "value")


@register("oplog_stream", "SELECT 'C' || o_custkey AS tail, 'O' || o_orderkey AS head, o_totalprice AS value FROM orders WHERE o_orderkey % 3 <> 0")
def oplog_stream(spark, d):
    """Arcs go out as operation lines, a third is disconnected by later ones, and a stream applies them to an empty graph."""
    g = graph(spark, d, "customer", "orders")
    g = g.with_(arcs=g.arcs.filter("rel = 'placed'"))
    where = folder(spark, "oplog")
    oplog.arcs_as_operations(g, 1).write.text(f"{where}/lines/a")
    gone = g.arcs.filter("CAST(substring(head, 2) AS BIGINT) % 3 = 0")
    cuts = gone.select(F.concat_ws("\t", F.lit(2), F.monotonically_increasing_id(), F.lit("ard"), "tail", "rel", "mod", "head").alias("value"))
    cuts.write.text(f"{where}/lines/b")
    lines = spark.readStream.schema("value string").option("recursiveFileLookup", "true").text(f"{where}/lines")
    follower = oplog.Follower(spark, f"{where}/state", Graph(spark.createDataFrame([], "id string, type string"), spark.createDataFrame([], "tail string, rel string, mod string, value double, head string")))
    follower.follow(lines, f"{where}/checkpoint").awaitTermination()
    return follower.kept.arcs.select("tail", "head", "value")


@register("snapshot", "SELECT 'N' || n_nationkey AS tail, 'R' || n_regionkey AS head FROM nation")
def snapshot(spark, d):
    where = folder(spark, "snapshot")
    graph(spark, d, "nation", "region").save(where)
    return Graph.load(spark, where).arcs.select("tail", "head")


@register("windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    return oplog.windowed_counts(table(spark, d, "events")).withColumn("value", F.round("value", 4))


@register("properties_set", "SELECT 'N' || n_nationkey AS id, n_nationkey * 2.0 AS twice FROM nation")
def properties_set(spark, d):
    g = graph(spark, d, "nation")
    g = mutate.set_property(g, "twice", g.vertices.select("id", (F.element_at("num", "nationkey") * 2).alias("value")))
    return query.vertices(g, {"type": "nation"}, select="twice: next.property('twice')").select("id", "twice")


@register("direction_both", "SELECT 'A' || n_nationkey AS anchor, 'A' || (n_nationkey + 1) % 25 AS id FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey < 24 UNION ALL SELECT 'A' || (n_nationkey + 1), 'A' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey < 24")
def direction_both(spark, d):
    """A ring of which every other step also goes back."""
    n = table(spark, d, "nation")
    name = lambda e: F.expr(f"'A' || ({e})")
    arc = lambda a, b, df: df.select(name(a).alias("tail"), F.lit("next").alias("rel"), F.lit("M_INT").alias("mod"), F.lit(1.0).alias("value"), name(b).alias("head"))
    there = arc("n_nationkey", "(n_nationkey + 1) % 25", n)
    back = arc("n_nationkey + 1", "n_nationkey", n.filter("n_nationkey % 2 = 0 AND n_nationkey < 24"))
    g = Graph(n.select(name("n_nationkey").alias("id")), there.unionByName(back))
    return query.neighborhood(g, None, ("next", "D_BOTH"), condition={"id": "A*"}).select("anchor", "id")


WORD_MAP = "(SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS ws FROM documents WHERE text IS NOT NULL)"


@register("feature_similarity", f"""WITH d AS {WORD_MAP}, p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.ws, b.ws)) AS n, len(a.ws) AS la, len(b.ws) AS lb FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)
    SELECT a, b, CAST(n AS INT) AS shared, round(n / sqrt(la * lb), 6) AS cosine, round(n / (la + lb - n), 6) AS jaccard FROM p""")
def feature_similarity(spark, d):
    """Neighboring documents as feature vectors of their words with weight 1."""
    words = F.array_distinct(F.split(F.lower("text"), " ", -1))
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.map_from_arrays(words, F.transform(words, lambda w: F.lit(1.0))).alias("v"))
    pairs = docs.select(F.col("doc_id").alias("a"), F.col("v").alias("va")).join(docs.select(F.col("doc_id").alias("b"), F.col("v").alias("vb")), F.col("b") == F.col("a") + 1)
    va, vb = F.col("va"), F.col("vb")
    return pairs.select("a", "b", similarity.intersection(va, vb).alias("shared"), F.round(similarity.feature_cosine(va, vb), 6).alias("cosine"), F.round(similarity.feature_jaccard(va, vb), 6).alias("jaccard"))


@register("quantised_kernels", """WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(x::DOUBLE / (list_max(list_transform(embedding, lambda y: abs(y::DOUBLE))) / 127.0)) AS BIGINT)) AS v FROM embeddings)
    SELECT a.vec_id AS a, CAST(list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[]) AS BIGINT) AS dp, CAST(list_dot_product(a.v::DOUBLE[], a.v::DOUBLE[]) AS BIGINT) AS ssq, round(list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]), 6) AS cos,
    round(list_distance(a.v::DOUBLE[], b.v::DOUBLE[]), 4) AS ecld FROM q a JOIN q b ON b.vec_id = a.vec_id + 1""")
def quantised_kernels(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", similarity.quantised(F.col("embedding")).alias("v"))
    pairs = rows.select(F.col("vec_id").alias("a"), F.col("v").alias("va")).join(rows.select(F.col("vec_id").alias("b"), F.col("v").alias("vb")), F.col("b") == F.col("a") + 1)
    va, vb = F.col("va"), F.col("vb")
    return pairs.select(
        "a", similarity.dp_pi8(va, vb).alias("dp"), similarity.ssq_pi8(va).alias("ssq"), F.round(similarity.cos_pi8(va, vb), 6).alias("cos"), F.round(similarity.ecld_pi8(va, vb), 4).alias("ecld")
    )


@register("plugin_merge", "SELECT 'C' || o_custkey AS anchor, 'O' || o_orderkey AS id, o_totalprice AS val FROM orders WHERE o_totalprice > 180000 ORDER BY val DESC, anchor, id LIMIT 12")
def plugin_merge(spark, d):
    """A plugin's responses from two shards of the arcs, merged by value."""
    g = graph(spark, d, "customer", "orders")
    placed = g.arcs.filter("rel = 'placed'")
    shards = [g.with_(arcs=placed.filter(f"pmod(crc32(CAST(head AS BINARY)), 2) = {k}")) for k in (0, 1)]
    known = plugins.Plugins()

    def dear(graph: Graph, least: float) -> DataFrame:
        return query.neighborhood(graph, None, ("placed", "D_OUT", "M_FLT", "V_GT", least), condition={"type": "customer"}).select("anchor", "id", "val")

    known.add("dear", dear)
    return known.call("dear", shards, sortkey="val", hits=12, least="180000")


@register("truncate_type", "SELECT 'N' || n_nationkey AS id, 'nation' AS type FROM nation")
def truncate_type(spark, d):
    g = mutate.truncate(graph(spark, d, "nation", "customer"), "customer")
    return g.vertices.select("id", "type")


@register("degrees", "SELECT 'N' || n_nationkey AS id, CAST(count(c_custkey) AS BIGINT) AS ideg, CAST(1 AS BIGINT) AS odeg, CAST(1 + count(c_custkey) AS BIGINT) AS deg FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def degrees(spark, d):
    return graph(spark, d, "nation", "customer").degrees().filter("id LIKE 'N%'").select("id", "ideg", "odeg", "deg")


@register("macros", "SELECT 'C' || c_custkey AS id, c_acctbal / 1000 AS wealth FROM customer WHERE c_acctbal / 1000 > 9")
def macros(spark, d):
    g = graph(spark, d, "customer")
    g.define("wealth := vertex['acctbal'] / 1000")
    return query.vertices(g, {"type": "customer", "filter": "wealth > 9"}, select="wealth: next['acctbal'] / 1000").select("id", "wealth")


@register("neighbors_distinct", "SELECT DISTINCT 'P' || l_partkey AS id FROM lineitem WHERE l_orderkey = 3")
def neighbors_distinct(spark, d):
    return query.terminals(graph(spark, d, "orders", "lineitem", "part"), "O3")


@register("arc_value_query", "SELECT o_totalprice AS value FROM orders WHERE o_orderkey = 5")
def arc_value_query(spark, d):
    g = graph(spark, d, "customer", "orders")
    owner = g.arcs.filter("rel = 'placed' AND head = 'O5'").first()["tail"]
    return query.arc_value(g, owner, ("placed", "D_OUT", "M_FLT"), "O5")


from . import token_queries  # noqa: E402, F401  (registers more)
