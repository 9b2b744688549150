"""Graph queries as DataFrame plans.

Matched paths are rows: `prev` and `next` are the vertices of the last hop as structs, `arc` the arc between them and
`prev_arc` the one before. A hop is two equi-joins, of the frontier with arcs and of arcs with vertices. A nested
condition that does not look back at the path is decided for each vertex once, innermost first: arcs are semi-joined
with the vertices that pass, and the rows with those arcs' tails. Only conditions that collect, have a filter of their
own or compare with the hop before extend the paths themselves. Nothing runs before the result is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Scope, Typed, compile_expression, cosine, lit
from ..functions.columns import surrogate as address
from ..functions.syntax import read, tokens
from ..operators.aggregate import aggregate_arcs
from ..operators.vectors import fingerprint, fingerprint_longs, hamming
from .conditions import ArcFilter, ConditionError, Hop, VertexCondition, compare, hop_of, vertex_condition
from .graph import Graph

VERTEX_FIELDS = ("id", "type", "virtual", "tmc", "tmm", "tmx", "c1", "c0", "vector", "num", "text", "ideg", "odeg", "deg")
#: Sort keys with their natural direction.
SORTS = {"S_VAL": ("val", False), "S_ID": ("id", True), "S_OBID": ("obid", True), "S_DEG": ("deg", False), "S_IDEG": ("ideg", False), "S_ODEG": ("odeg", False), "S_SIM": ("sim", False), "S_RANK": ("rank", False), "S_TMC": ("tmc", True), "S_TMM": ("tmm", True), "S_TMX": ("tmx", True), "S_HAM": ("ham", True), "S_ADDR": ("addr", True)}
#: Sort keys without a column: no order of their own, directions of the key before, and chance.
OTHER_SORTS = ("S_NONE", "S_NATIVE", "S_ASC", "S_DESC", "S_RANDOM")
COLLECTS = (True, "C_COLLECT")
#: Result fields in display order, with their bits, the columns they show and combinations of them.
FIELDS = {
    "F_ANCHOR": (1, "anchor"), "F_ANCHOR_OBID": (2, "anchor_obid"), "F_ARCDIR": (256, "dir"), "F_REL": (512, "rel"), "F_MOD": (1024, "mod"), "F_VAL": (2048, "val"), "F_ID": (4, "id"), "F_OBID": (8, "obid"), "F_TYPE": (16, "type"),
    "F_DEG": (32, "deg"), "F_IDEG": (64, "ideg"), "F_ODEG": (128, "odeg"), "F_VEC": (4096, "vector"), "F_PROP": (8192, "properties"), "F_RANK": (65536, "rank"), "F_SIM": (131072, "sim"), "F_HAM": (262144, "ham"),
    "F_TMC": (1048576, "tmc"), "F_TMM": (2097152, "tmm"), "F_TMX": (4194304, "tmx"), "F_ADDR": (33554432, "addr"), "F_HANDLE": (67108864, "handle"),
}
COMBINED = {
    "F_NAMES": ("F_ANCHOR", "F_ANCHOR_OBID", "F_ID", "F_OBID", "F_TYPE"), "F_PRED": ("F_ARCDIR", "F_REL", "F_MOD", "F_VAL"), "F_ARC": ("F_ARCDIR", "F_REL", "F_MOD", "F_VAL", "F_ID"),
    "F_AARC": ("F_ANCHOR", "F_ARCDIR", "F_REL", "F_MOD", "F_VAL", "F_ID"), "F_DEGREES": ("F_DEG", "F_IDEG", "F_ODEG"), "F_PROPS": ("F_VEC", "F_PROP"), "F_RLV": ("F_SIM", "F_HAM"), "F_TSTAMP": ("F_TMC", "F_TMM", "F_TMX"),
    "F_DETAILS": ("F_ADDR", "F_HANDLE"), "F_NONE": (),
}
COMBINED["F_ALL"] = tuple(f for f in FIELDS if f != "F_RANK")
RESULTS = ("R_SIMPLE", "R_STR", "R_LIST", "R_DICT")


def vertex_struct(vertices: DataFrame, name: str) -> DataFrame:
    return vertices.select(F.struct(*VERTEX_FIELDS).alias(name))


def oriented(arcs: DataFrame, direction: str) -> DataFrame:
    """src, dst, arc for one direction; D_BOTH keeps arcs that have one of the same relationship and modifier back."""
    arc = lambda d: F.struct("rel", "mod", "value", F.lit(d).alias("dir")).alias("arc")
    out = arcs.select(F.col("tail").alias("src"), F.col("head").alias("dst"), arc("D_OUT"))
    back = arcs.select(F.col("head").alias("src"), F.col("tail").alias("dst"), arc("D_IN"))
    if direction == "D_OUT":
        return out
    if direction == "D_IN":
        return back
    if direction == "D_ANY":
        return out.unionByName(back)
    mine, theirs = arcs.alias("a"), arcs.alias("b")
    c = F.col
    both = mine.join(theirs, (c("a.tail") == c("b.head")) & (c("a.head") == c("b.tail")) & (c("a.rel") == c("b.rel")) & (c("a.mod") == c("b.mod")))
    ways = F.when(c("a.value").eqNullSafe(c("b.value")), F.array(F.struct(c("a.value").alias("value"), F.lit("D_BOTH").alias("dir")))).otherwise(
        F.array(F.struct(c("a.value").alias("value"), F.lit("D_OUT").alias("dir")), F.struct(c("b.value").alias("value"), F.lit("D_IN").alias("dir")))
    )
    both = both.select(c("a.tail").alias("src"), c("a.head").alias("dst"), c("a.rel").alias("rel"), c("a.mod").alias("mod"), F.explode(ways).alias("w"))
    return both.select("src", "dst", F.struct("rel", "mod", F.col("w.value").alias("value"), F.col("w.dir").alias("dir")).alias("arc"))


class Planner:
    """Plans one query over a graph."""

    def __init__(self, graph: Graph, probe: list[float] | None = None, degrees: bool = False):
        self.graph, self.probe, self.degrees = graph, probe, degrees
        self.vertices = graph.described(degrees)

    def scope(self, **places) -> Scope:
        g = self.graph
        return Scope(property_types=g.property_types, macros=g.macros, probe=self.probe, now=g.now, **places)

    def at(self, id: str) -> DataFrame:
        """The vertex of an id, with degrees where the query needs them."""
        return self.vertices.filter(F.col("id") == id) if self.degrees else self.graph.with_(vertices=self.graph.vertex(id)).described(False)

    # Conditions that are decided for each vertex once

    def independent(self, hop: Hop) -> bool:
        """Whether what a nested block asks of a vertex has nothing to do with the path that led there, nor adds to it."""
        dynamic = hop.arc.value and str(hop.arc.value[0]).startswith("V_DYN_")
        if dynamic or hop.filter or hop.collect in COLLECTS or hop.forced is not None:
            return False
        return self.settled(vertex_condition(hop.neighbor, "next", self.scope(vertex="next"), self.graph.now)) if not self.looks(hop.neighbor) else False

    @staticmethod
    def looks(spec) -> bool:
        """Whether an expression of a condition, at any depth, may look back; only local ones compile without a path."""
        from .conditions import LOOKS_BACK

        if isinstance(spec, dict):
            return any(Planner.looks(v) or k in ("filter", "post") and isinstance(v, str) and bool(LOOKS_BACK.search(v)) for k, v in spec.items())
        return isinstance(spec, (list, tuple)) and any(Planner.looks(x) for x in spec)

    def settled(self, condition: VertexCondition) -> bool:
        return condition.local and all(self.independent(h) for h in condition.hops)

    def holders(self, hop: Hop) -> DataFrame:
        """__id: vertices with an arc that passes to a vertex that passes; an id may come several times."""
        arcs = oriented(self.graph.arcs, hop.arc.dir).filter(hop.arc.column("arc")).select("src", "dst")
        condition = vertex_condition(hop.neighbor, "next", self.scope(vertex="next"), self.graph.now)
        ends_known = hop.arc.rel in self.graph.joined and not hop.arc.negated
        if condition.bare and not condition.negated and ends_known:
            for inner in condition.hops:
                arcs = arcs.join(self.holders(inner), F.col("dst") == F.col("__id"), "left_anti" if inner.negated else "left_semi")
        elif not (condition.trivial and ends_known):
            arcs = arcs.join(self.matching(condition), F.col("dst") == F.col("__id"), "left_semi")
        return arcs.select(F.col("src").alias("__id"))

    def matching(self, condition: VertexCondition) -> DataFrame:
        """__id: vertices that pass a condition without a path."""
        rows = vertex_struct(self.vertices, "next")
        if condition.negated:
            plain = VertexCondition(condition.column, condition.hops, condition.degree_hops, condition.post)
            return rows.join(self.matching(plain), F.col("next.id") == F.col("__id"), "left_anti").select(F.col("next.id").alias("__id"))
        rows = self.with_degrees(rows.filter(condition.column), condition)
        for hop in condition.hops:
            rows = rows.join(self.holders(hop), F.col("next.id") == F.col("__id"), "left_anti" if hop.negated else "left_semi")
        if condition.post is not None:
            rows = rows.filter(condition.post)
        return rows.select(F.col("next.id").alias("__id"))

    def with_degrees(self, rows: DataFrame, condition: VertexCondition) -> DataFrame:
        """Rows whose `next` has the asked numbers of arcs that pass a filter."""
        for arc, want in condition.degree_hops:
            counts = oriented(self.graph.arcs, arc.dir).filter(arc.column("arc")).groupBy("src").agg(F.count("*").alias("__n"))
            rows = rows.join(counts, F.col("next.id") == F.col("src"), "left").filter(compare(F.coalesce("__n", F.lit(0)), want)).drop("src", "__n")
        return rows

    # Paths

    def step(self, paths: DataFrame, hop: Hop, anchor: str | None = None, synthetic: bool = False, depth: int = 1) -> tuple[DataFrame, list[DataFrame]]:
        """One hop from paths (anchor, prev, prev_arc): the rows that match, and the rows that nested blocks collect."""
        arcs = self.arcs_from(hop.arc.dir, anchor)
        test = hop.arc.column("arc", "prev_arc") if hop.arc.value and str(hop.arc.value[0]).startswith("V_DYN_") else None
        if test is None:
            arcs = arcs.filter(hop.arc.column("arc"))
        condition = vertex_condition(hop.neighbor, "next", self.scope(vertex="next", prev="prev", arc="arc", prev_arc="prev_arc", depth=depth), self.graph.now)
        if synthetic:
            # Only arcs that a path and a neighbor have are put together.
            if anchor is None:
                arcs = arcs.join(paths.select(F.col("prev.id").alias("__id")).distinct(), F.col("src") == F.col("__id"), "left_semi")
            if not condition.trivial and condition.local and not condition.negated:
                heads = vertex_struct(self.vertices, "next").filter(condition.column).select(F.col("next.id").alias("__id"))
                arcs = arcs.join(heads, F.col("dst") == F.col("__id"), "left_semi")
            parts = F.sort_array(F.collect_list(F.struct(F.col("arc.rel").alias("rel"), F.col("arc.mod").alias("mod"), F.col("arc.value").alias("value"))))
            arcs = arcs.groupBy("src", "dst").agg(parts.alias("parts"), F.first("arc.dir").alias("dir"))
            arcs = arcs.select("src", "dst", "parts", F.struct(F.lit("__synthetic__").alias("rel"), F.lit("M_FLT").alias("mod"), F.lit(0.0).alias("value"), "dir").alias("arc"))
        rows = paths.join(arcs, F.col("prev.id") == F.col("src")).drop("src")
        if test is not None:
            rows = rows.filter(test)
        head = vertex_struct(self.vertices, "next")
        if not condition.negated and condition.local:
            head = head.filter(condition.column)
        rows = rows.join(head, F.col("dst") == F.col("next.id")).drop("dst")
        if not condition.negated and not condition.local:
            rows = rows.filter(condition.column)
        if hop.filter:
            rows = self.filtered(rows, hop.filter, synthetic, depth)
        return self.satisfied(rows, condition, depth)

    def arcs_from(self, direction: str, anchor: str | None) -> DataFrame:
        """Arcs in one direction, of one vertex or of all."""
        if anchor is None:
            return oriented(self.graph.arcs, direction)
        ends = {"D_OUT": ("tail",), "D_IN": ("head",)}.get(direction, ("tail", "head"))
        own = [self.graph.arcs_of(anchor, e) for e in ends]
        # A loop is an arc of both ends, but one row.
        own = own[0] if len(own) == 1 else own[0].unionByName(own[1].filter(~F.coalesce(F.col("tail") == anchor, F.lit(False))))
        return oriented(own, direction).filter(F.col("src") == anchor)

    def filtered(self, rows: DataFrame, text: str, synthetic: bool = False, depth: int = 1) -> DataFrame:
        """Rows that an expression lets pass; mcull(score, k) keeps the k best of each vertex's neighborhood."""
        scope = self.scope(vertex="prev", prev="prev", next="next", arc="arc", prev_arc="prev_arc", synthetic="parts" if synthetic else None, depth=depth)
        node = read(text)
        if node[0] == "call" and node[1] in ("mcull", "mcullif", "collectif"):
            from ..functions.columns import Compiler

            args = [Compiler(scope).compile(n) for n in node[2]]
            if node[1] == "collectif":
                rows = rows.filter(args[0].truth())
                return rows.withColumn("arc", F.struct("arc.rel", "arc.mod", args[1].number().real().alias("value"), "arc.dir")) if len(args) > 1 else rows
            k = node[2][-1][1]
            score = args[-2].number().real()
            rows = rows.withColumn("__score", score).filter(F.col("__score") > 0)
            if node[1] == "mcullif":
                rows = rows.filter(args[0].truth())
            order = Window.partitionBy("anchor", "prev.id").orderBy(F.col("__score").desc(), F.col("next.id"), F.col("arc.rel"), F.col("arc.mod"))
            return rows.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= k).drop("__place", "__score")
        if node[0] == "seq" and node[1][-1][0] == "call" and node[1][-1][1] == "collectif":
            from ..functions.columns import Compiler

            compiler = Compiler(scope)
            for n in node[1][:-1]:
                compiler.compile(n)
            args = [compiler.compile(n) for n in node[1][-1][2]]
            rows = rows.filter(args[0].truth())
            return rows.withColumn("arc", F.struct("arc.rel", "arc.mod", args[1].number().real().alias("value"), "arc.dir")) if len(args) > 1 else rows
        return rows.filter(compile_expression(text, scope).truth())

    def satisfied(self, rows: DataFrame, condition: VertexCondition, depth: int = 1) -> tuple[DataFrame, list[DataFrame]]:
        """Rows whose nested conditions hold as well."""
        if condition.negated:
            plain = VertexCondition(condition.column, condition.hops, condition.degree_hops, condition.post)
            if self.settled(condition):
                return rows.join(self.matching(plain), F.col("next.id") == F.col("__id"), "left_anti"), []
            hit, _ = self.satisfied(rows.filter(condition.column), plain, depth)
            return rows.join(hit.select(*[F.col(c).alias(f"__{c}") for c in ("anchor", "next", "arc")]), self.same_path(), "left_anti"), []
        gathered: list[DataFrame] = []
        rows = self.with_degrees(rows, condition)
        for hop in condition.hops:
            if self.independent(hop):
                rows = rows.join(self.holders(hop), F.col("next.id") == F.col("__id"), "left_anti" if hop.negated else "left_semi")
                continue
            found, more = self.nested(rows, hop, depth)
            gathered += more
            if hop.collect in COLLECTS:
                gathered.append(found)
            if hop.forced is False:
                rows = rows.filter(F.lit(False))
            if hop.forced is not None:
                continue
            keys = found.select(F.col("anchor").alias("__anchor"), F.col("prev").getField("id").alias("__next"), F.col("prev_arc").alias("__arc")).distinct()
            same = (F.col("anchor") == F.col("__anchor")) & (F.col("next.id") == F.col("__next"))
            for f in ("rel", "mod", "value", "dir"):
                same = same & F.col(f"arc.{f}").eqNullSafe(F.col(f"__arc.{f}"))
            rows = rows.join(keys, same, "left_anti" if hop.negated else "left_semi")
        if condition.post is not None:
            rows = rows.filter(condition.post)
        return rows, gathered

    def nested(self, rows: DataFrame, hop: Hop, depth: int = 1) -> tuple[DataFrame, list[DataFrame]]:
        paths = rows.select("anchor", F.col("next").alias("prev"), F.col("arc").alias("prev_arc"))
        return self.step(paths, hop, depth=depth + 1)

    @staticmethod
    def same_path() -> Column:
        out = (F.col("anchor") == F.col("__anchor")) & (F.col("next.id") == F.col("__next.id"))
        for f in ("rel", "mod", "value", "dir"):
            out = out & F.col(f"arc.{f}").eqNullSafe(F.col(f"__arc.{f}"))
        return out



def start(planner: Planner, test: Column | None, id: str | None = None) -> DataFrame:
    """Paths of no hop at the vertices that pass, or at the one with an id."""
    none = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("rel", "string"), ("mod", "string"), ("value", "double"), ("dir", "string"))])
    rows = vertex_struct(planner.vertices if id is None else planner.at(id), "prev")
    rows = rows if test is None else rows.filter(test)
    return rows.select(F.col("prev.id").alias("anchor"), "prev", none.alias("prev_arc"))


DEGREES = ("deg", "ideg", "odeg")


def needs_degrees(*parts) -> bool:
    """Whether conditions, sort keys or expressions name a degree."""
    for part in parts:
        if isinstance(part, dict):
            plain = lambda v: not (isinstance(v, tuple) and len(v) == 2 and not (isinstance(v[0], str) and v[0].startswith("V_")))
            if any(k in ("degree", "indegree", "outdegree") and plain(v) for k, v in part.items()):
                return True
            if any(needs_degrees(v) if k != "property" else False for k, v in part.items()):
                return True
        elif isinstance(part, (list, tuple)):
            if needs_degrees(*part):
                return True
        elif isinstance(part, str):
            if part in ("S_DEG", "S_IDEG", "S_ODEG", "F_DEG", "F_IDEG", "F_ODEG", "F_DEGREES", "F_ALL"):
                return True
            if "deg" in part and any(kind == "name" and "." in t and t.rsplit(".", 1)[1] in DEGREES for text in part.split(";") for kind, t in tokens(text.replace("?", " ").replace(":", " "))):
                return True
    return False


def fields_of(fields) -> list[str]:
    """Result columns of a bit mask, a name or a list of names, in display order."""
    if isinstance(fields, int):
        known = sum(bit for bit, _ in FIELDS.values())
        if fields & ~known:
            raise ConditionError(f"unknown fields {fields & ~known}")
        return [column for bit, column in FIELDS.values() if fields & bit]
    names: set[str] = set()
    for name in [fields] if isinstance(fields, str) else fields:
        if name not in FIELDS and name not in COMBINED:
            raise ConditionError(f"unknown field {name}")
        names |= set(COMBINED.get(name, (name,)))
    return [column for name, (_, column) in FIELDS.items() if name in names]


def shaped(rows: DataFrame, result: str) -> DataFrame:
    """Rows as they are, or one column `item`: text, a list of texts, or a JSON object."""
    if result not in RESULTS:
        raise ConditionError(f"unknown result form {result}")
    if result == "R_SIMPLE":
        return rows
    if result == "R_DICT":
        return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("item"))
    texts = F.array(*[F.col(c).cast("string") for c in rows.columns])
    return rows.select((F.array_join(texts, " ", "") if result == "R_STR" else texts).alias("item"))


def rendered(rows: DataFrame, planner: Planner, sortby, hits: int, offset: int, rank: str | None, select: str | None, fields=None, drop: tuple[str, ...] = ()) -> DataFrame:
    """The result's columns, sorted and cut. Ties go by id, relationship and modifier."""
    scope = planner.scope(vertex="prev", prev="prev", next="next", arc="arc", prev_arc="prev_arc")
    columns = {
        "anchor": F.col("anchor"), "dir": F.col("arc.dir"), "rel": F.col("arc.rel"), "mod": F.col("arc.mod"), "val": F.col("arc.value"), "id": F.col("next.id"), "type": F.col("next.type"),
    }
    keys = [sortby] if isinstance(sortby, str) else list(sortby or [])
    shown = None if fields is None else fields_of(fields)
    score = compile_expression(rank, scope).number().real() if rank else None
    if score is not None:
        scope.rank = Typed(score, "real")
    for name in [SORTS.get(key, ("", True))[0] for key in keys] + (shown or []):
        if name in ("deg", "ideg", "odeg", "tmc", "tmm", "tmx", "vector"):
            columns[name] = F.col(f"next.{name}")
        elif name in ("obid", "anchor_obid"):
            columns[name] = F.md5((F.col("next.id") if name == "obid" else F.col("anchor")).cast("binary"))
        elif name == "sim":
            columns[name] = cosine(F.col("next.vector"), lit(planner.probe).col) if planner.probe else F.lit(0.0)
        elif name == "ham":
            own = F.lit(fingerprint_longs([planner.probe])[0]).cast("long")
            columns[name] = hamming(fingerprint(F.col("next.vector")), own)
        elif name in ("addr", "handle"):
            columns[name] = address(F.col("next.id"))
        elif name == "properties":
            texts = lambda c: F.coalesce(F.transform_values(c, lambda k, v: v.cast("string")), F.create_map().cast("map<string,string>"))
            columns[name] = F.map_concat(texts(F.col("next.num")), texts(F.col("next.text")))
    if score is not None:
        columns["rank"] = score
    picked = []
    for part in (select or "").split(";"):
        if part.strip():
            label, _, text = part.strip().partition(":")
            name, text = (label.strip(), text) if text else (label.strip().lstrip("."), label)
            text = text.strip()
            key, mark, default = (x.strip() for x in text.partition(" ? "))
            if mark and key.isidentifier() and ":" not in default:
                name, text = (name if ":" in part else key), f"next.property('{key}', {default})"
            elif text.isidentifier() and text in planner.graph.property_types:
                text = f"next.property('{text}')"
            columns[name] = compile_expression(text, scope).col
            picked.append(name)
    rows = rows.select(*[c.alias(n) for n, c in columns.items()])
    out = cut(rows, keys, hits, offset)
    return out.drop(*drop) if shown is None else out.select(*shown, *[n for n in picked if n not in shown])


def cut(rows: DataFrame, keys: list[str], hits: int, offset: int) -> DataFrame:
    order = []
    for k, key in enumerate(keys):
        if key in SORTS:
            name, up = SORTS[key]
            after = keys[k + 1] if k + 1 < len(keys) else ""
            up = True if after == "S_ASC" else False if after == "S_DESC" else up
            order.append(F.col(name).asc_nulls_last() if up else F.col(name).desc_nulls_last())
        elif key == "S_RANDOM":
            order.append(F.rand())
        elif key not in OTHER_SORTS:
            raise ConditionError(f"unknown sort key {key}")
    if order:
        ties = [F.col(c) for c in ("id", "rel", "mod", "anchor") if c in rows.columns]
        rows = rows.orderBy(*order, *ties)
    if offset:
        rows = rows.offset(offset)
    return rows.limit(hits) if hits >= 0 else rows


def neighborhood(
    graph: Graph, id: str | None = None, arc=None, neighbor=None, filter: str | None = None, collect=True, condition=None, sortby=None, hits: int = -1, offset: int = 0,
    rank: str | None = None, select: str | None = None, aggregate: dict | None = None, vector: list[float] | None = None, synthetic: bool = False, fields=None, result: str = "R_SIMPLE",
) -> DataFrame:
    """Arcs around an anchor (or around all vertices that pass `condition`), and what nested blocks collect."""
    planner = Planner(graph, vector, needs_degrees(neighbor, filter, sortby, rank, select, condition, fields))
    anchors = None
    if condition is not None:
        anchors = vertex_condition(condition, "prev", planner.scope(vertex="prev"), graph.now).column
    hop = Hop(ArcFilter.of(arc, "D_OUT"), neighbor, filter)
    rows, gathered = planner.step(start(planner, anchors, id), hop, id, synthetic)
    parts = [*([rows.drop("parts")] if collect in COLLECTS else []), *gathered]
    if not parts:
        parts = [rows.drop("parts").filter(F.lit(False))]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    if aggregate:
        out = aggregate_arcs(every, aggregate.get("mode", "count"), aggregate.get("arc"))
        return cut(out, [sortby] if isinstance(sortby, str) else list(sortby or []), hits, offset)
    return shaped(rendered(every, planner, sortby, hits, offset, rank, select, fields), result)


def vertices(
    graph: Graph, condition=None, sortby=None, hits: int = -1, offset: int = 0, rank: str | None = None, select: str | None = None, vector: list[float] | None = None, fields=None, result: str = "R_SIMPLE"
) -> DataFrame:
    """Vertices that pass a condition: id, type, and columns of rank, select and fields."""
    planner = Planner(graph, vector, needs_degrees(condition, sortby, rank, select, fields))
    scope = planner.scope(vertex="next")
    compiled = vertex_condition(condition, "next", scope, graph.now)
    rows = start(planner, None).select("anchor", F.col("prev").alias("next"), F.col("prev_arc").alias("arc"), F.col("prev"), "prev_arc")
    rows = rows if compiled.negated else rows.filter(compiled.column)
    rows, _ = planner.satisfied(rows, compiled)
    return shaped(rendered(rows, planner, sortby, hits, offset, rank, select, fields, ("anchor", "dir", "rel", "mod", "val")), result)


def arcs(graph: Graph, condition=None, arc=None, sortby=None, hits: int = -1, offset: int = 0) -> DataFrame:
    """Outgoing arcs of all tails that pass a condition."""
    planner = Planner(graph, None, needs_degrees(condition, sortby))
    tails = vertex_condition(condition, "prev", planner.scope(vertex="prev"), graph.now).column if condition is not None else None
    rows, _ = planner.step(start(planner, tails), Hop(ArcFilter.of(arc, "D_OUT")))
    return rendered(rows, planner, sortby, hits, offset, None, None)


def adjacent(graph: Graph, id: str, arc=None, neighbor=None, filter: str | None = None) -> DataFrame:
    """One row: whether the anchor has such a neighbor."""
    planner = Planner(graph, None, needs_degrees(neighbor, filter))
    rows, _ = planner.step(start(planner, None, id), Hop(ArcFilter.of(arc, "D_ANY"), neighbor, filter), id)
    return rows.limit(1).agg((F.count("*") > 0).alias("adjacent"))


def degree(graph: Graph, id: str, arc=None) -> DataFrame:
    """One row: the number of the vertex's arcs that pass a filter."""
    spec = ArcFilter.of(arc, "D_ANY")
    return Planner(graph).arcs_from(spec.dir, id).filter(spec.column("arc")).agg(F.count("*").alias("degree"))


def arc_value(graph: Graph, tail: str, arc, head: str) -> DataFrame:
    spec = ArcFilter.of(arc)
    return Planner(graph).arcs_from(spec.dir, tail).filter((F.col("dst") == head) & spec.column("arc")).select(F.col("arc.value").alias("value"))


def aggregate(graph: Graph, id: str, arc=None, neighbor=None, filter: str | None = None) -> DataFrame:
    """One row: neighbors, arcs, sum of values, and sums of degrees over distinct neighbors."""
    planner = Planner(graph, None, True)
    rows, _ = planner.step(start(planner, None, id), Hop(ArcFilter.of(arc, "D_OUT"), neighbor, filter), id)
    heads = rows.groupBy("next.id").agg(F.count("*").alias("n"), F.sum("arc.value").alias("v"), *[F.first(f"next.{d}").alias(d) for d in ("deg", "ideg", "odeg")])
    return heads.agg(F.count("*").alias("neighbors"), F.sum("n").alias("arcs"), F.sum("v").alias("value"), *[F.sum(d).alias(n) for d, n in (("deg", "degree"), ("ideg", "indegree"), ("odeg", "outdegree"))])


def evaluate(graph: Graph, text: str, tail: str | None = None, arc: tuple = (), head: str | None = None, vector: list[float] | None = None, memory: list | None = None) -> DataFrame:
    """One row, y: the value of an expression for a tail, an arc (relationship, direction, modifier, value) and a head.

    With a memory, a list of numbers that the first slots hold, the expression runs as a program; it then may store.
    """
    spark = graph.spark
    if memory is not None:
        from ..functions.program import Program

        program = Program(text, max(128, len(memory)))
        program.memory.slots[: len(memory)] = memory
        value = program.run({"prev.id": tail, "next.id": head, "vertex.id": tail, **dict(zip(("arc.rel", "arc.dir", "arc.mod", "arc.value"), arc, strict=False))})
        memory[:] = program.memory.slots[: len(memory)]
        return spark.createDataFrame([(value,)], "y string" if isinstance(value, str) else "y double" if isinstance(value, float) else "y long")
    degrees = needs_degrees(text)
    planner = Planner(graph, vector, degrees)
    row = spark.range(1)
    for name, id in (("prev", tail), ("next", head)):
        one = vertex_struct(planner.at(id), name) if id is not None else None
        row = row.join(F.broadcast(one), F.lit(True)) if one is not None else row
    rel, direction, mod, value = (*arc, *[None] * (4 - len(arc)))
    here = F.struct(F.lit(rel).cast("string").alias("rel"), F.lit(mod or "M_STAT").alias("mod"), F.lit(1.0 if value is None else float(value)).alias("value"), F.lit(direction or "D_OUT").alias("dir"))
    scope = planner.scope(vertex="prev" if tail is not None else None, prev="prev" if tail is not None else None, next="next" if head is not None else None, arc="arc")
    return row.withColumn("arc", here).select(compile_expression(text, scope).col.alias("y"))


def inarcs(graph: Graph, id: str, **kw) -> DataFrame:
    return neighborhood(graph, id, ("*", "D_IN"), **kw)


def outarcs(graph: Graph, id: str, **kw) -> DataFrame:
    return neighborhood(graph, id, ("*", "D_OUT"), **kw)


def terminals(graph: Graph, id: str) -> DataFrame:
    return outarcs(graph, id).select("id").distinct()


def initials(graph: Graph, id: str) -> DataFrame:
    return inarcs(graph, id).select("id").distinct()


def neighbors(graph: Graph, id: str) -> DataFrame:
    return neighborhood(graph, id, ("*", "D_ANY")).select("id").distinct()


__all__ = ["Planner", "adjacent", "aggregate", "arc_value", "arcs", "degree", "hop_of", "inarcs", "initials", "neighborhood", "neighbors", "outarcs", "terminals", "vertices"]
