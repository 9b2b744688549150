"""Pure expressions as Spark columns, with the types known beforehand.

Arithmetic follows the language, not SQL: division by zero divides by the least normal 32-bit float, logarithms of
numbers that are not positive, roots of negative ones and inverses of zero have fixed values, and a comparison or
logical operator gives 0 or 1. Nothing raises under ANSI mode.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .syntax import ExpressionError, read

# Fixed values.
FLT_MIN, FLT_MAX, DBL_MAX = 1.17549435e-38, 3.4028234663852886e38, 1.7976931348623157e308
T_NEVER, T_MIN, T_MAX = 4102444800, 31536000, 4102444799
LOG_LEAST = {"log": -745.0, "log2": -1074.0, "log10": -324.0}
EARTH_RADIUS = 6371001.0
MODS = {"M_ANY": 0x00, "M_STAT": 0x01, "M_SIM": 0x12, "M_DIST": 0x13, "M_LSH": 0x04, "M_INT": 0x05, "M_UINT": 0x06, "M_FLT": 0x17, "M_CNT": 0x08, "M_ACC": 0x19, "M_TMC": 0x0C, "M_TMM": 0x0D, "M_TMX": 0x0E}
DIRS = {"D_ANY": 0, "D_IN": 1, "D_OUT": 2, "D_BOTH": 3}
CONSTANTS = {
    "true": 1, "false": 0, "pi": math.pi, "e": math.e, "root2": math.sqrt(2), "root3": math.sqrt(3), "root5": math.sqrt(5), "phi": (1 + math.sqrt(5)) / 2,
    "zeta3": 1.2020569031595942, "googol": 1e100, "inf": math.inf, "nan": math.nan, "T_NEVER": T_NEVER, "T_MIN": T_MIN, "T_MAX": T_MAX,
}

INT, REAL, STR, VEC, BITS, NULL = "int", "real", "str", "vector", "bits", "null"


@dataclass
class Typed:
    col: Column
    type: str

    def real(self) -> Column:
        return self.col.cast("double") if self.type != REAL else self.col

    def number(self) -> Typed:
        return self if self.type in (INT, REAL) else Typed(self.col.cast("long"), INT) if self.type == BITS else Typed(F.lit(None).cast("double"), REAL)

    def truth(self) -> Column:
        """A positive match: numbers above zero, strings, vectors and bits that are not empty."""
        if self.type in (INT, REAL):
            hit = self.col > 0
        elif self.type == STR:
            hit = F.length(self.col) > 0
        elif self.type == VEC:
            hit = F.size(self.col) > 0
        elif self.type == BITS:
            hit = self.col != 0
        else:
            return F.lit(False)
        return F.coalesce(hit, F.lit(False))


@dataclass
class Scope:
    """What names stand for: a struct column of each position, the arcs, property types, macros and query constants."""

    vertex: str | None = "vertex"
    prev: str | None = None
    next: str | None = None
    arc: str | None = None
    prev_arc: str | None = None
    synthetic: str | None = None
    property_types: dict[str, str] = field(default_factory=dict)
    macros: dict[str, tuple] = field(default_factory=dict)
    probe: list[float] | None = None
    now: int = 0
    order: int = 0
    size: int = 0
    rank: Typed | None = None
    #: Hops from the anchor to the end of `arc`.
    depth: int = 1


def surrogate(id: Column) -> Column:
    """A number that stands for a vertex wherever one is asked for: the first 60 bits of its internal id."""
    return F.conv(F.substring(F.md5(id.cast("binary")), 1, 15), 16, 10).cast("long")


def lit(x) -> Typed:
    if x is None:
        return Typed(F.lit(None), NULL)
    if isinstance(x, str):
        return Typed(F.lit(x), STR)
    if isinstance(x, (list, tuple)):
        return Typed(F.array(*[F.lit(float(v)) for v in x]), VEC)
    return Typed(F.lit(float(x)), REAL) if isinstance(x, float) else Typed(F.lit(int(x)).cast("long"), INT)


def flag(c: Column) -> Typed:
    return Typed(F.coalesce(c.cast("long"), F.lit(0).cast("long")), INT)


def guard(x: Column, bad: Column, instead: float, fn) -> Column:
    return F.when(bad, F.lit(instead)).otherwise(fn(F.when(~bad, x)))


def wrapping(op: str, a: Column, b: Column) -> Column:
    """Integer arithmetic that gives null instead of an error when it leaves 64 bits."""
    return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)


def dot(a: Column, b: Column) -> Column:
    # As far as the shorter vector goes.
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    length = norm(a) * norm(b)
    return F.when(length > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / length))).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))), F.lit(0.0), lambda s, x: s + x * x))


def geodistance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres by the haversine formula."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


UNARY = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "exp": F.exp, "rad": F.radians, "deg": F.degrees,
    "sinc": lambda x: F.when(x == 0, F.lit(1.0)).otherwise(F.sin(F.lit(math.pi) * x) / (F.lit(math.pi) * F.when(x != 0, x))),
    "inv": lambda x: guard(x, x == 0, FLT_MAX, lambda y: 1.0 / y), "sqrt": lambda x: guard(x, x < 0, 0.0, F.sqrt),
    "log": lambda x: guard(x, x <= 0, LOG_LEAST["log"], F.log), "log2": lambda x: guard(x, x <= 0, LOG_LEAST["log2"], F.log2), "log10": lambda x: guard(x, x <= 0, LOG_LEAST["log10"], F.log10),
}


class Compiler:
    """Trees to typed columns within a scope."""

    def __init__(self, scope: Scope):
        self.scope, self.local = scope, {}

    def compile(self, node) -> Typed:
        if isinstance(node, str):
            node = read(node)
        return getattr(self, f"on_{node[0]}")(*node[1:])

    def on_num(self, x) -> Typed:
        return lit(x)

    def on_str(self, x) -> Typed:
        return lit(x)

    def on_seq(self, nodes) -> Typed:
        return [self.compile(n) for n in nodes][-1]

    def on_label(self, name, node) -> Typed:
        return self.compile(node)

    def on_set(self, name, node) -> Typed:
        self.local[name] = out = self.compile(node)
        return out

    def on_define(self, name, node) -> Typed:
        self.scope.macros[name] = node
        return self.compile(node)

    def on_list(self, nodes) -> Typed:
        raise ExpressionError("a set stands behind in or notin only")

    def on_range(self, a, b) -> Typed:
        raise ExpressionError("a range stands behind in or notin only")

    def on_index(self, name, node) -> Typed:
        if name in ("vertex", "next", "prev") or name == "":
            return self.attribute(name, "property", [node])
        if name in ("rel", "type"):
            return self.compile(node)
        raise ExpressionError(f"{name}[] needs a memory; see Program")

    # Names

    def on_name(self, name) -> Typed:
        s = self.scope
        if name in self.local:
            return self.local[name]
        if name in CONSTANTS:
            return lit(CONSTANTS[name])
        if name in MODS:
            return lit(MODS[name])
        if name in DIRS:
            return lit(DIRS[name])
        if name == "null":
            return lit(None)
        if name == "vector":
            return lit(s.probe) if s.probe is not None else lit(None)
        if name in ("graph.ts", "graph.t0", "graph.order", "graph.size", "graph.age", "graph.op"):
            return lit({"graph.ts": s.now, "graph.t0": s.now, "graph.order": s.order, "graph.size": s.size, "graph.age": 0, "graph.op": 0}[name])
        if name in ("context.rank", ".rank"):
            return s.rank or lit(0.0)
        if name in s.macros:
            return self.compile(s.macros[name])
        if name.startswith(("rel.", "type.")):
            return lit(name.split(".", 1)[1])
        head, _, rest = name.partition(".")
        if head in ("", "vertex", "prev", "next") or name in ("vertex", "prev", "next"):
            return self.attribute(head, rest, [])
        raise ExpressionError(f"unknown name {name}")

    def place(self, head: str) -> str:
        s = self.scope
        found = {"vertex": s.vertex, "prev": s.prev or s.vertex, "next": s.next, "": s.next or s.vertex}[head]
        if found is None:
            raise ExpressionError(f"{head or '.'} is not known here")
        return found

    def attribute(self, head: str, what: str, args: list) -> Typed:
        s = self.scope
        if what.startswith("arc"):
            arc = s.prev_arc if head == "prev" else s.arc
            if arc is None:
                raise ExpressionError("no arc is known here")
            c = lambda f: F.col(f"{arc}.{f}")
            return {
                "arc": lambda: Typed(c("rel"), STR), "arc.value": lambda: Typed(c("value"), REAL), "arc.dist": lambda: lit(s.depth - 1 if head == "prev" else s.depth), "arc.type": lambda: Typed(c("rel"), STR),
                "arc.mod": lambda: Typed(F.coalesce(*[F.when(c("mod") == k, F.lit(v)) for k, v in MODS.items()], F.lit(0)).cast("long"), INT),
                "arc.dir": lambda: Typed(F.coalesce(*[F.when(c("dir") == k, F.lit(v)) for k, v in DIRS.items()], F.lit(0)).cast("long"), INT),
                "arc.isfwd": lambda: flag(c("dir") == "D_OUT"), "arc.issyn": lambda: flag(c("rel") == "__synthetic__"),
            }[what]()
        at = self.place(head)
        c = lambda f: F.col(f"{at}.{f}")
        if what in ("", "id"):
            return Typed(c("id"), STR)
        if what in ("address", "handle", "enum", "index", "bitindex", "bitvector"):
            number = surrogate(c("id"))
            if what == "handle":
                number = number % F.lit(1 << 40) + F.lit(1 << 41)
            elif what == "enum":
                number = number.bitwiseAND(F.lit((1 << 31) - 1).cast("long"))
            elif what == "bitindex":
                number = F.shiftright(number, 6)
            elif what == "bitvector":
                return Typed(F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63).cast("long")).cast("int")), BITS)
            return Typed(number, INT)
        if what == "internalid":
            return Typed(F.md5(c("id").cast("binary")), STR)
        if what == "type":
            return Typed(c("type"), STR)
        if what in ("tmc", "tmm", "tmx", "deg", "ideg", "odeg"):
            return Typed(c(what).cast("long"), INT)
        if what in ("c0", "c1"):
            return Typed(c(what).cast("double"), REAL)
        if what == "virtual":
            return flag(c("virtual"))
        if what == "vector":
            return Typed(c("vector"), VEC)
        if what == "propcount":
            return Typed((F.coalesce(F.size(c("num")), F.lit(0)) + F.coalesce(F.size(c("text")), F.lit(0))).cast("long"), INT)
        if what == "locked":
            return lit(0)  # DataFrames are never locked
        if what in ("op", "refc", "bidx", "oidx"):
            raise ExpressionError(f"{what} tells of the memory of another engine and has no counterpart here")
        if what == "property":
            key = args[0][1] if args and args[0][0] == "str" else None
            if key is None:
                raise ExpressionError("property() takes a literal key")
            kind = s.property_types.get(key, NULL)
            value = F.try_element_at(c("text") if kind == STR else c("num"), F.lit(key))
            own = Typed(value if kind in (STR, REAL) else value.cast("long"), kind if kind != NULL else REAL)
            if len(args) > 1:
                other = self.compile(args[1])
                if other.type == own.type or own.type in (INT, REAL) and other.type in (INT, REAL):
                    own = Typed(F.coalesce(own.col, other.col), REAL if REAL in (own.type, other.type) else own.type)
                elif kind == NULL:
                    own = other
            return own
        raise ExpressionError(f"unknown attribute {head}.{what}")

    # Operators

    def on_un(self, op, node) -> Typed:
        x = self.compile(node)
        if op == "!":
            return flag(~x.truth())
        if op == "~":
            return Typed(F.bitwise_not(x.number().col.cast("long")), INT)
        x = x.number()
        return x if op == "+" else Typed(F.negate(x.col), x.type)

    def on_if(self, c, a, b) -> Typed:
        c, a, b = self.compile(c), self.compile(a), self.compile(b)
        kind = a.type if a.type == b.type or b.type == NULL else b.type if a.type == NULL else REAL if {a.type, b.type} <= {INT, REAL} else STR
        return Typed(F.when(c.truth(), self.cast(a, kind)).otherwise(self.cast(b, kind)), kind)

    def cast(self, x: Typed, kind: str) -> Column:
        return x.col if x.type == kind else x.col.cast({INT: "long", REAL: "double", STR: "string", BITS: "long"}.get(kind, "string"))

    def on_bin(self, op, left, right) -> Typed:
        if op in ("in", "notin"):
            return self.member(self.compile(left), right, op == "notin")
        a, b = self.compile(left), self.compile(right)
        if op == "&&":
            return flag(a.truth() & b.truth())
        if op == "||":
            return flag(a.truth() | b.truth())
        if op in ("==", "!="):
            return flag(self.equal(a, b, right) if op == "==" else ~self.equal(a, b, right))
        if op in ("<", "<=", ">", ">="):
            if {a.type, b.type} != {STR}:
                a, b = a.number(), b.number()
            return flag({"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[op])
        if op in ("&", "|", "^"):
            x, y = a.number().col.cast("long"), b.number().col.cast("long")
            return Typed({"&": x.bitwiseAND, "|": x.bitwiseOR, "^": x.bitwiseXOR}[op](y), INT)
        if op in ("<<", ">>"):
            x, n = a.number().col.cast("long"), b.number().col.cast("int")
            out = F.call_function("shiftleft", x, n) if op == "<<" else F.call_function("shiftrightunsigned", x, n)
            return Typed(F.when((n >= 0) & (n < 64), out).otherwise(F.lit(0).cast("long")), INT)
        if op == "+" and STR in (a.type, b.type):
            return Typed(F.concat(F.coalesce(a.col.cast("string"), F.lit("")), F.coalesce(b.col.cast("string"), F.lit(""))), STR)
        if op == "+" and NULL in (a.type, b.type):
            return b if a.type == NULL else a
        if VEC in (a.type, b.type):
            return self.vectors(op, a, b)
        a, b = a.number(), b.number()
        ints = a.type == b.type == INT
        if op in "+-*":
            return Typed(wrapping(op, a.col, b.col), INT) if ints else Typed({"+": a.real() + b.real(), "-": a.real() - b.real(), "*": a.real() * b.real()}[op], REAL)
        if op == "/":
            y = b.real()
            return Typed(a.real() / F.when(y == 0, F.lit(FLT_MIN)).otherwise(y), REAL)
        if op == "%":
            if ints:
                return Typed(F.when(b.col == 0, F.lit(0).cast("long")).otherwise(F.try_mod(a.col, F.when(b.col != 0, b.col))), INT)
            return Typed(F.when(b.real() == 0, F.lit(0.0)).otherwise(F.try_mod(a.real(), F.when(b.real() != 0, b.real()))), REAL)
        if op == "**":
            x, y = a.real(), b.real()
            base = x if b.type == INT else F.when(x < 0, F.lit(0.0)).otherwise(x)
            out = F.pow(base, y)
            out = F.when(out == math.inf, F.lit(DBL_MAX)).otherwise(out)
            return Typed(out, REAL)
        raise ExpressionError(f"unknown operator {op}")

    def equal(self, a: Typed, b: Typed, right) -> Column:
        if a.type == b.type == STR:
            if right[0] == "str" and right[1].endswith("*") and len(right[1]) > 1:
                return F.coalesce(F.startswith(a.col, F.lit(right[1][:-1])), F.lit(False))
            return F.coalesce(a.col == b.col, F.lit(False))
        if NULL in (a.type, b.type):
            return (b if a.type == NULL else a).col.isNull()
        if STR in (a.type, b.type):
            return F.lit(False)
        return F.coalesce(a.col == b.col, F.lit(False))

    def member(self, a: Typed, node, negated: bool) -> Typed:
        if node[0] == "range":
            lo, hi = self.compile(node[1]), self.compile(node[2])
            found = (a.number().col >= lo.number().col) & (a.number().col < hi.number().col)
        elif node[0] == "list":
            found = F.lit(False)
            for n in node[1]:
                found = found | self.equal(a, self.compile(n), n)
        else:
            found = self.equal(a, self.compile(node), node)
        found = F.coalesce(found, F.lit(False))
        return flag(~found if negated else found)

    def vectors(self, op: str, a: Typed, b: Typed) -> Typed:
        if a.type == b.type == VEC:
            if op == "*":
                return Typed(dot(a.col, b.col), REAL)
            return Typed(F.zip_with(a.col, b.col, (lambda x, y: x + y) if op == "+" else (lambda x, y: x - y)), VEC)
        v, x = (a, b) if a.type == VEC else (b, a)
        k = x.number().real()
        return Typed(F.transform(v.col, (lambda y: y * k) if op == "*" else (lambda y: y / F.when(k == 0, F.lit(FLT_MIN)).otherwise(k))), VEC)

    # Functions

    def on_call(self, name, nodes) -> Typed:
        head, dot_, rest = name.rpartition(".")
        if rest == "property" and dot_:
            return self.attribute(head, "property", nodes)
        if head == "synarc":
            return self.synthetic(rest, nodes)
        if name in UNARY:
            return Typed(UNARY[name](self.compile(nodes[0]).number().real()), REAL)
        fn = getattr(self, f"fn_{name}", None)
        if fn is None:
            if name in self.scope.macros:
                return self.compile(self.scope.macros[name])
            raise ExpressionError(f"{name}() is unknown, or needs a memory; see Program")
        return fn(*[self.compile(n) for n in nodes])

    def synthetic(self, what: str, nodes) -> Typed:
        """Functions of all arcs between two vertices, held in an array of (rel, mod, value) structs."""
        arcs = self.scope.synthetic
        if arcs is None:
            raise ExpressionError("synarc functions need collapsed arcs")
        name = lambda n: n[1].removeprefix("rel.")
        mod = lambda n: name(n)
        pick = lambda test: F.filter(F.col(arcs), test)
        if what == "hasrel":
            return flag(F.lit(True) if not nodes else self.all_of([F.size(pick(self.has("rel", name(n)))) > 0 for n in nodes]))
        if what == "hasmod":
            return flag(self.all_of([F.size(pick(self.has("mod", mod(n)))) > 0 for n in nodes]))
        if what == "hasrelmod":
            pairs = list(zip(nodes[::2], nodes[1::2], strict=True))
            return flag(self.all_of([F.size(self.of_kind(arcs, name(r), mod(m))) > 0 for r, m in pairs]))
        if what == "value":
            r, m = name(nodes[0]), mod(nodes[1])
            found = pick(lambda a: (a["rel"] == r) & (a["mod"] == m))
            return Typed(F.when(F.size(found) > 0, F.element_at(found, 1)["value"]), REAL)
        if what in ("decay", "xdecay"):
            r = name(nodes[0])
            value = F.element_at(F.filter(F.col(arcs), lambda a: (a["rel"] == r) & ~a["mod"].isin("M_TMC", "M_TMM", "M_TMX")), 1)["value"]
            times = {m: F.try_element_at(self.of_kind(arcs, r, m), F.lit(1))["value"] for m in ("M_TMC", "M_TMM", "M_TMX")}
            begun, ends, now = F.coalesce(times["M_TMM"], times["M_TMC"]), times["M_TMX"], F.lit(float(self.scope.now))
            rate = self.compile(nodes[1]).number().real() if len(nodes) > 1 else F.lit(1.0) / F.when(ends > begun, ends - begun)
            age = now - begun
            if what == "decay":
                return Typed(value - rate * value * age, REAL)
            return Typed(value * F.exp(-rate * math.log(1e4) * age), REAL)
        raise ExpressionError(f"unknown synarc.{what}")

    @staticmethod
    def has(field_: str, value: str):
        return lambda a: a[field_] == value

    @staticmethod
    def of_kind(arcs: str, rel: str, mod: str) -> Column:
        return F.filter(F.col(arcs), lambda a: (a["rel"] == rel) & (a["mod"] == mod))

    @staticmethod
    def all_of(tests: list[Column]) -> Column:
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out

    def fn_neg(self, x):
        return Typed(F.negate(x.number().col), x.number().type)

    def fn_int(self, x):
        x = x if x.type != STR else Typed(x.col.try_cast("double"), REAL)
        return Typed(x.number().col.cast("double").cast("long") if x.type == REAL else x.number().col, INT)

    def fn_intr(self, x):
        return Typed(F.round(x.number().real()).cast("long"), INT)

    def fn_real(self, x):
        return Typed(x.col.try_cast("double") if x.type == STR else x.number().real(), REAL)

    def fn_str(self, x):
        return Typed(x.col.cast("string"), STR)

    def fn_asint(self, x):
        return Typed(x.number().col.cast("long"), INT)

    fn_asreal = fn_real

    def fn_bitvector(self, x):
        return Typed(x.number().col.cast("long"), BITS)

    fn_asbits = fn_bitvector

    def fn_hash(self, x):
        return Typed(F.xxhash64(x.col), INT)

    # Strings

    def fn_strcmp(self, a, b):
        return Typed(F.when(a.col == b.col, 0).when(a.col < b.col, -1).otherwise(1).cast("long"), INT)

    def fn_strcasecmp(self, a, b):
        return self.fn_strcmp(Typed(F.lower(a.col), STR), Typed(F.lower(b.col), STR))

    def fn_startswith(self, a, b):
        return flag(F.startswith(a.col, b.col))

    def fn_endswith(self, a, b):
        return flag(F.endswith(a.col, b.col))

    def fn_join(self, sep, *parts):
        return Typed(F.call_function("concat_ws", sep.col, *[p.col.cast("string") for p in parts]), STR)

    def fn_replace(self, s, probe, repl):
        return Typed(F.replace(s.col, probe.col, repl.col), STR)

    def fn_slice(self, s, a, b=None):
        n = F.length(s.col)
        at = lambda x: F.when(x < 0, F.greatest(n + x, F.lit(0))).otherwise(F.least(x, n))
        lo, hi = at(a.col.cast("int")), at(b.col.cast("int")) if b is not None and b.type != NULL else n
        return Typed(F.substring(s.col, lo + 1, F.greatest(hi - lo, F.lit(0))), STR)

    def fn_prefix(self, s, n):
        return Typed(F.substring(s.col, F.lit(1), n.col.cast("int")), STR)

    def fn_normalize(self, s):
        return Typed(F.trim(F.regexp_replace(F.lower(s.col), r"[^\p{L}\p{N}]+", " ")), STR)

    def fn_idx(self, s, i):
        if s.type == VEC:
            return Typed(F.try_element_at(s.col, (i.col + 1).cast("int")), REAL)
        return Typed(F.ascii(F.substring(s.col, (i.col + 1).cast("int"), F.lit(1))).cast("long"), INT)

    def fn_strftime(self, t):
        return Typed(F.date_format(F.timestamp_seconds(t.number().col), "yyyy-MM-dd HH:mm:ss"), STR)

    def fn_strlen(self, s):
        return Typed(F.coalesce(F.octet_length(s.col), F.lit(0)).cast("long") if s.type == STR else F.lit(0).cast("long"), INT)

    def fn_len(self, s):
        out = F.length(s.col) if s.type == STR else F.size(s.col) if s.type == VEC else F.lit(1)
        return Typed(F.coalesce(out, F.lit(0)).cast("long"), INT)

    # Types

    def fn_isnan(self, x):
        """Not a number: true for anything but int and real, too."""
        return flag(F.isnan(x.real()) | x.col.isNull()) if x.type in (INT, REAL) else lit(1)

    def fn_isinf(self, x):
        return flag(F.abs(x.real()) == math.inf) if x.type == REAL else lit(0)

    def of_type(self, x, *kinds):
        return flag(x.col.isNotNull()) if x.type in kinds else lit(0)

    def fn_isint(self, x):
        return self.of_type(x, INT)

    def fn_isreal(self, x):
        return flag(x.col.isNotNull() & ~F.isnan(x.col)) if x.type == REAL else lit(0)

    def fn_isstr(self, x):
        return self.of_type(x, STR)

    fn_isutf8 = fn_isstr

    def fn_isvector(self, x):
        return self.of_type(x, VEC)

    fn_isarray = fn_isvector

    def fn_isbitvector(self, x):
        return self.of_type(x, BITS)

    def fn_iskeyval(self, x):
        return lit(0)

    fn_ismap = fn_isbytes = fn_isbytearray = fn_iskeyval

    def fn_anynan(self, *xs):
        return flag(F.greatest(*[self.fn_isnan(x).col for x in xs], F.lit(0).cast("long")) > 0)

    def fn_allnan(self, *xs):
        return flag(F.least(*[self.fn_isnan(x).col for x in xs], F.lit(1).cast("long")) > 0)

    # Numbers

    def fn_abs(self, x):
        return Typed(F.abs(x.number().col), x.number().type)

    def fn_sign(self, x):
        return Typed(F.signum(x.number().real()).cast("long"), INT) if x.type == INT else Typed(F.signum(x.number().real()), REAL)

    def whole(self, x, fn):
        return x if x.type == INT else Typed(fn(x.number().real()).cast("double"), REAL)

    def fn_ceil(self, x):
        return self.whole(x, F.ceil)

    def fn_floor(self, x):
        return self.whole(x, F.floor)

    def fn_round(self, x):
        return self.whole(x, F.round)

    def fn_fac(self, x):
        return Typed(F.when(x.number().col.between(0, 20), F.factorial(x.number().col.cast("int"))), INT)

    def fn_popcnt(self, x):
        return Typed(F.bit_count(x.number().col.cast("long")).cast("long"), INT)

    def fn_comb(self, n, k):
        i = lambda t: t.number().col.cast("int")
        steps = F.sequence(F.lit(1), F.greatest(F.least(i(k), i(n) - i(k)), F.lit(1)))
        value = F.aggregate(steps, F.lit(1.0), lambda acc, j: acc * (i(n) - j + 1) / j)
        out = F.when((i(k) < 0) | (i(k) > i(n)), F.lit(0.0)).when((i(k) == 0) | (i(k) == i(n)), F.lit(1.0)).otherwise(value)
        return Typed(F.round(out).cast("long"), INT)

    def fn_atan2(self, a, b):
        return Typed(F.atan2(a.number().real(), b.number().real()), REAL)

    def pair(self, fn, *xs):
        xs = [x.number() for x in xs]
        return Typed(fn(*[x.col for x in xs]), INT) if all(x.type == INT for x in xs) else Typed(fn(*[x.real() for x in xs]), REAL)

    def fn_max(self, a, b):
        return self.pair(F.greatest, a, b)

    def fn_min(self, a, b):
        return self.pair(F.least, a, b)

    def fn_prox(self, a, b):
        return Typed(256.0 / (256.0 + F.abs(a.number().real() - b.number().real())), REAL)

    def fn_approx(self, a, t, err):
        x = a.number().real()
        return flag(F.abs((x - t.number().real()) / F.when(x == 0, F.lit(FLT_MIN)).otherwise(x)) < err.number().real())

    def fn_geodist(self, *xs):
        return Typed(geodistance(*[x.number().real() for x in xs]), REAL)

    def fn_geoprox(self, *xs):
        return Typed(1.0 - geodistance(*[x.number().real() for x in xs]) / (EARTH_RADIUS * math.pi), REAL)

    # Vectors and bits

    def fn_hamdist(self, a, b):
        return Typed(F.bit_count(a.number().col.cast("long").bitwiseXOR(b.number().col.cast("long"))).cast("long"), INT)

    def fn_cosine(self, a, b):
        return Typed(cosine(a.col, b.col), REAL) if a.type == b.type == VEC else lit(0.0)

    fn_sim = fn_cosine

    def fn_jaccard(self, a, b):
        return lit(0.0)  # defined for feature vectors; zero for dense ones

    def fn_euclidean(self, a, b):
        return Typed(euclidean(a.col, b.col), REAL) if a.type == b.type == VEC else lit(math.inf)

    # Names of codes

    def fn_modtostr(self, x):
        return Typed(F.coalesce(*[F.when(x.col == v, F.lit(k)) for k, v in MODS.items()], F.lit("?")), STR)

    def fn_dirtostr(self, x):
        return Typed(F.coalesce(*[F.when(x.col == v, F.lit(k)) for k, v in DIRS.items()], F.lit("?")), STR)

    def same(self, x):
        return x

    fn_relenc = fn_reldec = fn_typeenc = fn_typedec = same

    # Any number of arguments

    def numbers(self, xs) -> list[Column]:
        return [x.number().real() for x in xs if x.type in (INT, REAL, BITS)]

    def array(self, xs) -> Column:
        return F.filter(F.array(*self.numbers(xs)), lambda v: v.isNotNull() & ~F.isnan(v))

    def total(self, a: Column, fn=lambda v: v) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, v: s + fn(v))

    def fn_sum(self, *xs):
        return Typed(self.total(self.array(xs)), REAL)

    def fn_sumsqr(self, *xs):
        return Typed(self.total(self.array(xs), lambda v: v * v), REAL)

    def fn_invsum(self, *xs):
        return Typed(self.total(self.array(xs), UNARY["inv"]), REAL)

    def fn_prod(self, *xs):
        return Typed(F.aggregate(self.array(xs), F.lit(1.0), lambda s, v: s * v), REAL)

    def fn_mean(self, *xs):
        a = self.array(xs)
        return Typed(self.total(a) / F.greatest(F.size(a), F.lit(1)), REAL)

    def fn_stdev(self, *xs):
        a = self.array(xs)
        n = F.greatest(F.size(a), F.lit(1))
        mean = self.total(a) / n
        return Typed(F.sqrt(self.total(F.transform(a, lambda v: (v - mean) * (v - mean))) / n), REAL)

    def fn_harmmean(self, *xs):
        a = self.array(xs)
        return Typed(F.size(a) / self.total(a, UNARY["inv"]), REAL)

    def fn_geomean(self, *xs):
        a = self.array(xs)
        return Typed(F.exp(self.total(a, UNARY["log"]) / F.greatest(F.size(a), F.lit(1))), REAL)

    def first_of(self, xs):
        known = [x for x in xs if x.type != NULL]
        if not known:
            return lit(None)
        kind = known[0].type if all(x.type == known[0].type for x in known) else REAL if all(x.type in (INT, REAL) for x in known) else STR
        return Typed(F.coalesce(*[self.cast(x, kind) for x in known]), kind)

    def fn_firstval(self, *xs):
        return self.first_of(xs)

    def fn_lastval(self, *xs):
        return self.first_of(xs[::-1])

    def fn_do(self, *xs):
        return lit(1)

    def fn_void(self, *xs):
        return lit(0)

    def fn_require(self, x):
        return flag(x.truth())

    def fn_return(self, x):
        return x

    def fn_rank(self, *xs):
        """A polynomial of the head's rank coefficients: c1 * (x1 + ... + xn) + c0, as its own attribute order has it."""
        at = self.place("next" if self.scope.next else "vertex")
        return Typed(F.col(f"{at}.c1").cast("double") * self.total(self.array(xs)) + F.col(f"{at}.c0").cast("double"), REAL)

    def fn_georank(self, *xs):
        """Proximity of the head, whose c1 and c0 are latitude and longitude, to a place."""
        at = self.place("next" if self.scope.next else "vertex")
        here = [Typed(F.col(f"{at}.{c}").cast("double"), REAL) for c in ("c1", "c0")]
        return self.fn_geoprox(*here, *xs)

    def fn_random(self):
        return Typed(F.rand(), REAL)

    def fn_randbits(self):
        return Typed(F.xxhash64(F.rand()), BITS)

    def fn_randint(self, a, b):
        lo, hi = a.number().col.cast("long"), b.number().col.cast("long")
        return Typed(lo + F.floor(F.rand() * (hi - lo)).cast("long"), INT)


def compile_expression(text: str, scope: Scope) -> Typed:
    return Compiler(scope).compile(read(text))
