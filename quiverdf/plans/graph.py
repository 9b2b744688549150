"""A directed, typed property graph as two DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERTEX_COLUMNS = {
    "id": "string", "type": "string", "virtual": "boolean", "tmc": "long", "tmm": "long", "tmx": "long", "c1": "double", "c0": "double",
    "vector": "array<double>", "num": "map<string,double>", "text": "map<string,string>",
}
ARC_COLUMNS = {"tail": "string", "rel": "string", "mod": "string", "value": "double", "head": "string"}
#: Modifiers with real values; the others hold integers.
REAL_MODS = ("M_SIM", "M_DIST", "M_FLT", "M_ACC")
NEVER = 4102444800


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with exactly these columns; those that lack are null, but for a few with a neutral value."""
    neutral = {"virtual": False, "tmc": 0, "tmm": 0, "tmx": NEVER, "c1": 1.0, "c0": 0.0, "value": 1.0, "mod": "M_STAT"}
    return df.select(*[(F.col(c) if c in df.columns else F.lit(neutral.get(c))).cast(t).alias(c) for c, t in columns.items()])


@dataclass
class Graph:
    """vertices: one row per id. arcs: one row per (tail, head, rel, mod); parallel rows are a multiple arc.

    property_types says which properties are int, real or str, so that expressions have types before they run.
    vertex_at and arcs_at give the rows of one id without a scan of all: (id) and (id, "tail" or "head"). joined names
    the relationships whose arcs all end in vertices, so that a hop need not look them up.
    """

    vertices: DataFrame
    arcs: DataFrame
    property_types: dict[str, str] = field(default_factory=dict)
    macros: dict[str, tuple] = field(default_factory=dict)
    now: int = 0
    definitions: dict[str, str] = field(default_factory=dict)
    vertex_at: Callable[[str], DataFrame] | None = None
    arcs_at: Callable[[str, str], DataFrame] | None = None
    joined: frozenset[str] = frozenset()

    def __post_init__(self):
        self.vertices, self.arcs = conform(self.vertices, VERTEX_COLUMNS), conform(self.arcs, ARC_COLUMNS)

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    def with_(self, **changes) -> Graph:
        if "vertices" in changes or "arcs" in changes:
            changes = {"vertex_at": None, "arcs_at": None, "joined": frozenset(), **changes}
        return replace(self, **changes)

    def vertex(self, id: str) -> DataFrame:
        rows = self.vertices if self.vertex_at is None else conform(self.vertex_at(id), VERTEX_COLUMNS)
        return rows.filter(F.col("id") == id)

    def arcs_of(self, id: str, end: str) -> DataFrame:
        """Arcs of which the id is the tail or the head."""
        rows = self.arcs if self.arcs_at is None else conform(self.arcs_at(id, end), ARC_COLUMNS)
        return rows.filter(F.col(end) == id)

    def define(self, text: str) -> None:
        """Takes `name := expression`, which later expressions can use by its name."""
        from ..functions.syntax import ExpressionError, read

        node = read(text)
        if node[0] != "define":
            raise ExpressionError("a definition is `name := expression`")
        self.macros[node[1]] = node[2]
        self.definitions[node[1]] = text

    def definition(self, name: str) -> str | None:
        """The text that was given for a name."""
        return self.definitions.get(name)

    def relationships(self) -> DataFrame:
        """name, n: relationships and their arcs."""
        return self.arcs.groupBy(F.col("rel").alias("name")).agg(F.count("*").alias("n"))

    def vertex_types(self) -> DataFrame:
        """name, n: types and their vertices; null is the type of vertices without one."""
        return self.vertices.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n"))

    def property_keys(self) -> DataFrame:
        """name, n: property keys and the vertices that have them."""
        keys = lambda c: F.coalesce(F.map_keys(F.map_filter(c, lambda k, v: v.isNotNull())), F.array().cast("array<string>"))
        return self.vertices.select(F.explode(F.concat(keys("num"), keys("text"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))

    def string_values(self) -> DataFrame:
        """name, n: distinct string values of properties and how often they stand there."""
        values = F.coalesce(F.map_values("text"), F.array().cast("array<string>"))
        return self.vertices.select(F.explode(values).alias("name")).filter("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"))

    def degrees(self) -> DataFrame:
        """id, ideg, odeg, deg: every member of a multiple arc counts."""
        ends = self.arcs.select(F.explode(F.array(F.struct(F.col("tail").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("head").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
        return ends.groupBy("e.id").agg(F.sum("e.i").alias("ideg"), F.sum("e.o").alias("odeg"), F.count("*").alias("deg"))

    def described(self, degrees: bool) -> DataFrame:
        """Vertices, with degrees where a query needs them."""
        if not degrees:
            return self.vertices.withColumns({c: F.lit(None).cast("long") for c in ("ideg", "odeg", "deg")})
        return self.vertices.join(self.degrees(), "id", "left").fillna(0, ["ideg", "odeg", "deg"])

    def order(self, type: str | None = None) -> int:
        return (self.vertices if type is None else self.vertices.filter(F.col("type") == type)).count()

    def size(self) -> int:
        return self.arcs.count()

    def live(self, now: int) -> Graph:
        """Without expired vertices and arcs: an M_TMX arc in the past ends all arcs of its relationship between its ends."""
        kept = self.vertices.filter(F.col("tmx") > now)
        ended = self.arcs.filter((F.col("mod") == "M_TMX") & (F.col("value") <= now)).select("tail", "head", "rel").distinct()
        gone = self.vertices.filter(F.col("tmx") <= now).select("id")
        arcs = self.arcs.join(ended, ["tail", "head", "rel"], "left_anti").join(gone, F.col("tail") == F.col("id"), "left_anti")
        return self.with_(vertices=kept, arcs=arcs.join(gone, F.col("head") == F.col("id"), "left_anti"))

    def save(self, path: str) -> None:
        self.vertices.write.mode("overwrite").partitionBy("type").parquet(f"{path}/vertices")
        self.arcs.write.mode("overwrite").partitionBy("rel").parquet(f"{path}/arcs")

    @staticmethod
    def load(spark: SparkSession, path: str, property_types: dict[str, str] | None = None) -> Graph:
        return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/arcs"), property_types or {})
