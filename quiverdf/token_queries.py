"""Queries that hold the tokens of the expression language, family by family, against SQL over the same rows.

A family is a table of expressions with the SQL that gives their values; k is a nation's key, from 0 to 24.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.columns import Scope, compile_expression
from .functions.program import evaluate
from .plans import mutate, query
from .plans.graph import Graph
from .queries import LINES, graph, register
from .sources.shared import folder
from .sources.tables import NOW, table
from .streaming import oplog

ROWS = "(SELECT n_nationkey AS k FROM nation)"
DIGITS = 6


def unnested(exprs: list[str]) -> str:
    """SQL with a row for each nation and expression: key, f, y."""
    values = ", ".join(f"round(CAST({e} AS DOUBLE), {DIGITS})" for e in exprs)
    return f"SELECT k AS key, unnest(range({len(exprs)})) AS f, unnest([{values}]) AS y FROM {ROWS}"


def family(name: str, table_: dict[str, str]) -> None:
    """Registers programs, each run with a fresh memory for each nation."""

    @register(name, unnested(list(table_.values())))
    def run(spark, d):
        rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_nationkey").cast("long").alias("k"))
        out = evaluate(rows, list(table_))
        return out.select(F.col("key").cast("int").alias("key"), F.col("f").cast("long").alias("f"), F.round("y", DIGITS).alias("y"))


def column_family(name: str, table_: dict[str, str]) -> None:
    """Registers pure expressions, compiled to columns over the nations' vertices."""

    @register(name, unnested(list(table_.values())))
    def run(spark, d):
        g = graph(spark, d, "nation")
        g.define("k := vertex['nationkey']")
        scope = Scope(property_types=g.property_types, macros=g.macros, now=g.now, order=25, size=25, probe=[1.0, 2.0])
        rows = g.vertices.withColumn("vertex", F.struct("*"))
        ys = F.array(*[F.struct(F.lit(i).cast("long").alias("f"), F.round(compile_expression(t, scope).col.cast("double"), DIGITS).alias("y")) for i, t in enumerate(table_)])
        return rows.select(F.element_at("num", "nationkey").cast("int").alias("key"), F.explode(ys).alias("e")).select("key", "e.f", "e.y")


# Functions of one number, on fractions below 1 and above 1, alone and over ranges of the memory

X, XS = ("(k + 1) / 30", "(k + 2) / 30", "0.5"), ("((k + 1) / 30.0)", "((k + 2) / 30.0)", "0.5")
Y, YS = ("k", "k * 3 + 1", "2"), ("k", "(k * 3 + 1)", "2")
UP, UPS = tuple(f"1 + {x}" for x in X), tuple(f"(1 + {x})" for x in XS)
ONE = {
    "ceil": "ceil({})", "floor": "floor({})", "round": "round({})", "abs": "abs({})", "sign": "sign({})", "log2": "log2({})", "log": "ln({})", "log10": "log10({})", "exp2": "pow(2, {})", "exp": "exp({})", "exp10": "pow(10, {})", "rad": "radians({})",
    "deg": "degrees({})", "sin": "sin({})", "cos": "cos({})", "tan": "tan({})", "asin": "asin({})", "acos": "acos({})", "atan": "atan({})", "sinh": "sinh({})", "cosh": "cosh({})", "tanh": "tanh({})", "asinh": "asinh({})", "acosh": "acosh({})",
    "atanh": "atanh({})", "sinc": "sin(pi() * {0}) / (pi() * {0})", "inv": "1 / {}", "sq": "{0} * {0}", "sqrt": "sqrt({})", "int": "trunc({})", "intr": "round({})", "real": "{}", "bits": "trunc({})", "inc": "{} + 1", "dec": "{} - 1",
}
#: Forms over ranges that the language lacks.
NO_REAL_RANGE = ("int", "intr", "real", "bits")
NOT_PLAIN = ("exp2", "exp10", "sq", "inc", "dec", "bits")


def weighed(fn: str, xs: tuple[str, ...]) -> str:
    return " + ".join(f"{w} * CAST({fn.format(x)} AS DOUBLE)" for w, x in zip((1, 10, 100), xs, strict=True))


SUM = "load(0) + 10 * load(1) + 100 * load(2)"
written = lambda xs: f"write(0, {', '.join(xs)}); "
one: dict[str, str] = {}
for _f, _sql in ONE.items():
    _x, _s = (UP, UPS) if _f == "acosh" else (X, XS)
    one[f"{written(_x)}m{_f}(0, 2); {SUM}"] = weighed(_sql, _s)
    if _f not in NO_REAL_RANGE:
        one[f"{written(_x)}mr{_f}(0, 2); {SUM}"] = weighed(_sql, _s)
    if _f not in NOT_PLAIN:
        one[f"{_f}({_x[0]})"] = _sql.format(_s[0])
one |= {f"{written(Y)}miinc(0, 2); {SUM}": weighed("{} + 1", YS), f"{written(Y)}midec(0, 2); {SUM}": weighed("{} - 1", YS), f"{written(Y)}mpopcnt(0, 2); {SUM}": weighed("bit_count(CAST({} AS BIGINT))", YS)}
family("program_one_number", one)

# Functions of two numbers: one slot, with a condition, a range, typed ranges, slot by slot

TWO = {
    "add": "{0} + {1}", "sub": "{0} - {1}", "mul": "{0} * {1}", "div": "{0} / {1}", "mod": "{0} % {1}", "shr": "CAST({0} AS BIGINT) >> {1}", "shl": "CAST({0} AS BIGINT) << {1}", "and": "CAST({0} AS BIGINT) & {1}", "or": "CAST({0} AS BIGINT) | {1}",
    "xor": "xor(CAST({0} AS BIGINT), {1})", "pow": "pow({0}, {1})",
}
two: dict[str, str] = {}
for _f, _sql in TWO.items():
    _on = lambda x, f=_sql: f.format(x, "3" if "BIGINT" in f else "3.0")
    if _f != "pow":
        two[f"store(4, k + 5); {_f}(4, 3); load(4)"] = _on("(k + 5)")
        two[f"store(4, k + 5); {_f}if(k > 9, 4, 3); load(4)"] = f"CASE WHEN k > 9 THEN {_on('(k + 5)')} ELSE k + 5 END"
        two[f"{written(Y)}write(6, 3, 3, 3); mv{_f}(0, 6, 3); {SUM}"] = " + ".join(f"{w} * ({_on(y)})" for w, y in zip((1, 10, 100), YS, strict=True))
    two[f"{written(Y)}m{_f}(0, 2, 3); {SUM}"] = " + ".join(f"{w} * ({_on(y)})" for w, y in zip((1, 10, 100), YS, strict=True))
    if "BIGINT" not in _sql:
        two[f"{written(Y)}mr{_f}(0, 2, 3); {SUM}"] = " + ".join(f"{w} * ({_on(y)})" for w, y in zip((1, 10, 100), YS, strict=True))
        if _f != "pow":
            _whole = "{0} // 3" if _f == "div" else _sql.format("{0}", 3)
            two[f"{written(Y)}mi{_f}(0, 2, 3); {SUM}"] = weighed(_whole, YS)
family("program_two_numbers", two)

# Functions of many numbers

x0, x1, x2 = XS
LIST = f"[{', '.join(XS)}]"
MEAN, LOG_MEAN = f"(({x0} + {x1} + {x2}) / 3)", f"((ln({x0}) + ln({x1}) + ln({x2})) / 3)"
MANY = {
    "sum": f"list_sum({LIST})", "sumsqr": " + ".join(f"{x} * {x}" for x in XS), "invsum": " + ".join(f"1 / {x}" for x in XS), "prod": " * ".join(XS), "mean": MEAN, "harmmean": f"3 / ({' + '.join(f'1 / {x}' for x in XS)})", "geomean": f"exp({LOG_MEAN})",
    "stdev": f"sqrt(({' + '.join(f'pow({x} - {MEAN}, 2)' for x in XS)}) / 3)", "geostdev": f"exp(sqrt(({' + '.join(f'pow(ln({x}) - {LOG_MEAN}, 2)' for x in XS)}) / 3))",
}
many = {f"{written(X)}m{r}{f}(5, 0, 2); load(5)": sql for f, sql in MANY.items() for r in ("", "r")}
many |= {f"{f}({', '.join(X)})": sql for f, sql in MANY.items() if f != "geostdev"}
family("program_many_numbers", many)

# Single slots: storing, moving, counting, comparing, by address and by reference

flag = lambda e: f"CASE WHEN {e} THEN 1 ELSE 0 END"
slots = {
    "store(1, k); load(1)": "k", "store(1, 4); rstore(1, k); load(4)": "k", "storeif(k > 9, 1, 7); load(1)": "CASE WHEN k > 9 THEN 7 ELSE 0 END", "store(1, 4); rstoreif(k > 9, 1, 7); load(4)": "CASE WHEN k > 9 THEN 7 ELSE 0 END",
    "write(3, k, 2, 1) * 1000 + load(3) + load(5)": "3001 + k", "writeif(k > 9, 3, k, 2); load(3) + load(4)": "CASE WHEN k > 9 THEN k + 2 ELSE 0 END", "store(1, 6); rwrite(1, k, 5); load(6) + load(7) * 100 + load(1) * 1000": "k + 500 + 8000",
    "store(1, 6); rwriteif(k > 9, 1, k, 5); load(6) + load(1) * 1000": "CASE WHEN k > 9 THEN k + 8000 ELSE 6000 END", "store(1, 4); store(4, k); rload(1)": "k", "M[3] + 1": "1", "store(3, k); M[3]": "k",
    "push(k); push(2); pop() * 100 + pop()": "200 + k", "push(1); pushif(k > 9, k); pop()": "CASE WHEN k > 9 THEN k ELSE 1 END", "push(k); push(3); popif(k > 9); pop()": "CASE WHEN k > 9 THEN k ELSE 3 END", "push(k); get() * 100 + pop()": "101 * k",
    "store(1, k); mov(2, 1); load(2)": "k", "store(1, 5); store(2, 6); store(6, k); rmov(1, 2); load(5)": "k", "store(1, k); movif(k > 9, 2, 1); load(2)": "CASE WHEN k > 9 THEN k ELSE 0 END",
    "store(1, 5); store(2, 6); store(6, k); rmovif(k > 9, 1, 2); load(5)": "CASE WHEN k > 9 THEN k ELSE 0 END", "store(1, k); store(2, 7); xchg(1, 2); load(1) * 100 + load(2)": "700 + k",
    "store(1, 5); store(2, 6); store(5, k); store(6, 7); rxchg(1, 2); load(5) * 100 + load(6)": "700 + k", "store(1, k); store(2, 7); xchgif(k > 9, 1, 2); load(1)": "CASE WHEN k > 9 THEN 7 ELSE k END",
    "store(1, 5); store(2, 6); store(5, k); store(6, 7); rxchgif(k > 9, 1, 2); load(5)": "CASE WHEN k > 9 THEN 7 ELSE k END", "store(1, k); inc(1); load(1)": "k + 1", "store(1, 4); store(4, k); rinc(1); load(4)": "k + 1",
    "store(1, k); incif(k > 9, 1); load(1)": f"k + {flag('k > 9')}", "store(1, 4); store(4, k); rincif(k > 9, 1); load(4)": f"k + {flag('k > 9')}", "store(1, k); dec(1); load(1)": "k - 1", "store(1, 4); store(4, k); rdec(1); load(4)": "k - 1",
    "store(1, k); decif(k > 9, 1); load(1)": f"k - {flag('k > 9')}", "store(1, 4); store(4, k); rdecif(k > 9, 1); load(4)": f"k - {flag('k > 9')}", "store(1, k); smooth(1, 10, 0.25); load(1)": "0.75 * k + 2.5", "store(1, k); count(1); count(1)": "k + 2",
    "store(1, k); countif(k > 9, 1); load(1)": f"k + {flag('k > 9')}", "store(1, k); modindex(1, 7) * 100 + load(1)": "k * 100 + (k + 1) % 7", "store(R1, k); r1": "k", "store(R2, k); r2 + r1": "k", "store(R3, k); r3": "k", "store(R4, k); load(-4) + r4": "2 * k",
    "R1 * 1000 + R2 * 100 + R3 * 10 + R4": "-1234", "C1 * 1000 + C2 * 100 + C3 * 10 + C4": "123", "index('x'); indexed('x') * 10 + indexed('y')": "10", "index('x'); unindex('x'); indexed('x')": "0",
}
for _f, _op in (("equ", "="), ("neq", "<>"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    slots[f"store(0, k); store(1, 9); {_f}(0, 1)"] = flag(f"k {_op} 9")
    slots[f"store(0, k); store(1, 9); store(2, 0); store(3, 1); r{_f}(2, 3)"] = flag(f"k {_op} 9")
family("program_slots", slots)

# Ranges of the memory: copies, order, heaps, probes, sets

three = "write(0, k, 7, 3); "
top = lambda n, *xs: f"list_sum(list_reverse_sort([{', '.join(xs)}])[1:{n}])"
low = lambda n, *xs: f"list_sum(list_sort([{', '.join(xs)}])[1:{n}])"
held = "load(0) + load(1) + load(2)"
nth = lambda n: f"list_sort([k, 7, 3])[{n}]"
ranges = {
    "mset(2, 4, k); load(2) + load(4) + load(5)": "2 * k", "store(1, k); mreset(); load(1)": "0", f"{three}mcopy(10, 0, 3); load(10) + load(11)": "k + 7", f"{three}store(20, 10); mpwrite(20, 0, 3); load(10) + load(12)": "k + 3",
    "mcopyobj(4, bytes(k, 2)); load(4) + load(5)": "k + 2", f"{three}mterm(1); mlen(0)": "1", f"{three}mreverse(0, 3); {SUM}": "3 + 70 + 100 * k", f"{three}mvadd(0, 0, 3); load(0)": "2 * k",
    "mrandomize(0, 3); load(0) >= 0 && load(3) < 1 && load(0) != load(1)": "1", "mrandbits(0, 1); load(0) != load(1)": "1", "write(0, k, k); mhash(0, 0); load(0) != k": "1",
    f"{three}mmax(9, 0, 2); load(9)": "greatest(k, 7)", f"{three}mmin(9, 0, 2); load(9)": "least(k, 3)", f"{three}mcontains(0, 2, 9)": flag("k = 9"), f"{three}mcount(0, 2, 7)": f"1 + {flag('k = 7')}", f"{three}mindex(0, 2, 3)": "CASE WHEN k = 3 THEN 0 ELSE 2 END",
    f"{three}write(10, 7, 7, 3); mcmp(0, 10, 3)": "sign(k - 7)", f"{three}write(10, 7.0000001, 7, 3); mcmpa(0, 10, 3)": "sign(k - 7)", f"{three}write(10, 7, 3); msubset(10, 11, 0, 2)": "1", f"{three}write(10, 7, 9); msubset(10, 11, 0, 2)": flag("k = 9"),
    f"{three}msubsetobj(1, 2, bytes(3, 7))": "1", f"{three}msumprodobj(0, 2, bytes(1, 2, 3))": "k + 14 + 9", "mheapinit(0, 3); isnan(load(0))": "1",
}
for _f, _order in (("msort", (1, 2, 3)), ("mrsort", (1, 2, 3)), ("msortrev", (3, 2, 1)), ("mrsortrev", (3, 2, 1))):
    ranges[f"{three}{_f}(0, 3); {SUM}"] = " + ".join(f"{w} * {nth(n)}" for w, n in zip((1, 10, 100), _order, strict=True))
for _side, _sum, _first in (("min", top, "least"), ("max", low, "greatest")):
    ranges |= {
        f"mheapinit(0, 3); mheappush{_side}(0, 3, k); mheappush{_side}(0, 3, 5); mheappush{_side}(0, 3, 9); mheappush{_side}(0, 3, 2); {held}": _sum(3, "k", "5", "9", "2"),
        f"mheapinit(0, 3); mheapwrite{_side}(0, 3, k, 5, 9, 2, 11); {held}": _sum(3, "k", "5", "9", "2", "11"),
        f"{three}mheapify{_side}(0, 3); load(0)": f"{_first}(k, 7, 3)",
        f"write(10, k, 5, 9, 2); mheapinit(0, 3); mheapsift{_side}(0, 3, 10, 13); {held}": _sum(3, "k", "5", "9", "2"),
    }
for _s, _a, _b in (("iset", "k", "9"), ("vset", "k", "9")):
    ranges |= {
        f"{_s}.add({_a}) * 10 + {_s}.add({_a})": "10", f"{_s}.add({_a}); {_s}.add({_b}); {_s}.len()": f"2 - {flag('k = 9')}", f"{_s}.add({_a}); {_s}.has({_b})": flag("k = 9"), f"{_s}.add({_a}); {_s}.del({_b}) * 10 + {_s}.len()": f"CASE WHEN k = 9 THEN 10 ELSE 1 END",
        f"{_s}.add({_a}); {_s}.add({_b}); {_s}.clr() * 10 + {_s}.len()": f"20 - 10 * {flag('k = 9')}", f"{_s}.add({_a}); {_s}.ini(5); {_s}.len()": "0",
    }
family("program_ranges", ranges)

# Control: returning, halting, staging; constants, casts and operators as programs and as columns

family("program_control", {
    "returnif(k > 9, 7); k": "CASE WHEN k > 9 THEN 7 ELSE k END", "return(k); 5": "k", "require(k > 9); 5": "CASE WHEN k > 9 THEN 5 ELSE 0 END", "halted()": "0", "haltif(0); continueif(1); continue(); k": "k", "do(store(1, k), store(2, 3)); load(1) + load(2)": "k + 3",
    "void(store(1, k)) + load(1)": "k", "stage(9.0, C2); unstage(C2) * 10 + unstage(C2)": "10", "stageif(k > 9, 1.0, C1); unstage(C1)": flag("k > 9"), "stage(1.0); unstageif(k > 9); commit()": flag("k <= 9"), "stage(1.0, C3); commitif(k > 9, C3)": flag("k > 9"),
    "len(bytes(k, 1, 2))": "3", "isnan(keyval(1, 2))": "1", "q = k + 1; q * 2": "2 * (k + 1)", "collect(2.0) + collectif(k > 9, 1.0)": f"1 + {flag('k > 9')}", "random() < 1": "1", "k in range(3, 7) || k in {9, 11}": flag("(k >= 3 AND k < 7) OR k IN (9, 11)"),
})

column_family("column_constants", {
    "true": "1", "false": "0", "pi": "pi()", "e": "exp(1)", "root2": "sqrt(2)", "root3": "sqrt(3)", "root5": "sqrt(5)", "phi": "(1 + sqrt(5)) / 2", "zeta3": "1.2020569031595942", "googol / 1e100": "1", "inf > 1e300": "1", "isnan(nan)": "1", "T_NEVER": "4102444800",
    "T_MAX": "4102444799", "T_MIN": "31536000", "D_ANY * 1000 + D_IN * 100 + D_OUT * 10 + D_BOTH": "123", "M_ANY": "0", "M_STAT": "1", "M_SIM": "18", "M_DIST": "19", "M_LSH": "4", "M_INT": "5", "M_UINT": "6", "M_FLT": "23", "M_CNT": "8", "M_ACC": "25",
    "M_TMC": "12", "M_TMM": "13", "M_TMX": "14", "graph.ts": str(NOW), "graph.t0": str(NOW), "graph.age": "0", "graph.order": "25", "graph.size": "25", "len(vector)": "2", "idx(vector, 1)": "2",
})

column_family("column_numbers", {
    "neg(k)": "-k", "asint(k + 0.9)": "k", "asbits(k)": "k", "real(k) / 2": "k / 2.0", "asreal(k) / 2": "k / 2.0", "bitvector(k)": "k", "hamdist(k, 7)": "bit_count(xor(k::BIGINT, 7))", "k != 9": flag("k <> 9"), "k >= 9": flag("k >= 9"), "k <= 9": flag("k <= 9"),
    "asin(k / 30)": "asin(k / 30.0)", "acos(k / 30)": "acos(k / 30.0)", "asinh(k)": "asinh(k)", "acosh(k + 1)": "acosh(k + 1)", "atanh(k / 30)": "atanh(k / 30.0)", "sinc((k + 1) / 30)": "sin(pi() * (k + 1) / 30.0) / (pi() * (k + 1) / 30.0)",
    "isinf(k / 1.0)": "0", "isinf(inf)": "1", "isbitvector(bitvector(k))": "1", "isbitvector(k)": "0", "iskeyval(k)": "0", "isvector(vector)": "1", "isvector(k)": "0", "isbytearray(k)": "0", "isbytes(k)": "0", "isutf8('x')": "1", "isarray(k)": "0", "ismap(k)": "0",
    "anynan(k, nan)": "1", "anynan(k, 1)": "0", "allnan(k, nan)": "0", "allnan(nan, 'x')": "1", "invsum(k + 1, 2)": "1.0 / (k + 1) + 0.5", "harmmean(k + 1, 2)": "2 / (1.0 / (k + 1) + 0.5)", "geomean(k + 1, 4)": "sqrt((k + 1) * 4)", "require(k > 9)": flag("k > 9"),
    "return(k)": "k", "void(k)": "0", "randint(3, 5) in range(3, 5)": "1", "random() in range(0, 1)": "1", "isbitvector(randbits())": "1", "strcasecmp('ABC', 'abc')": "0", "endswith('abc', 'bc')": "1", "idx('abc', 1)": "98", "strlen('é')": "2", "k > 9 ? 1 : 2": "CASE WHEN k > 9 THEN 1 ELSE 2 END",
    "relenc('x') == 'x'": "1", "reldec('x') == 'x'": "1", "typeenc('x') == 'x'": "1", "typedec('x') == 'x'": "1", "rel.x == 'x'": "1", "type.x == 'x'": "1", "geoprox(0, 0, 0, 180)": "0", "geoprox(k, k, k, k)": "1",
})

# Attributes of the vertices and the arc of a hop

ATTRIBUTES = {
    "prev.arc.dist": "0", "next.arc.dist": "1", ".arc.dist": "1", "next.arc.dir": "2", ".arc.dir": "2", "next.arc.mod": "23", ".arc.mod": "23", "next.arc.isfwd": "1", ".arc.isfwd": "1", "next.arc.issyn": "0", ".arc.issyn": "0", "next.arc.value": "o_totalprice", ".arc.value": "o_totalprice",
    "prev.propcount": "4", "vertex.propcount": "4", "next.propcount": "3", ".propcount": "3", "prev.c1": "1", "prev.c0": "0", "vertex.c1": "1", "vertex.c0": "0", "next.c1": "1", "next.c0": "0", ".c1": "1", ".c0": "0", "prev.virtual": "0", "vertex.virtual": "0", "next.virtual": "0",
    ".virtual": "0", "prev.deg": "n", "prev.ideg": "0", "prev.odeg": "n", "vertex.deg": "n", "vertex.ideg": "0", "vertex.odeg": "n", "next.deg": "1", "next.ideg": "1", "next.odeg": "0", ".deg": "1", ".ideg": "1", ".odeg": "0", "prev.tmc": "0", "prev.tmm": "0", "prev.tmx": "4102444800",
    "vertex.tmc": "0", "vertex.tmm": "0", "vertex.tmx": "4102444800", "next.tmc": "epoch(o_orderdate)", "next.tmm": "epoch(o_orderdate)", "next.tmx": "4102444800", ".tmc": "epoch(o_orderdate)", ".tmm": "epoch(o_orderdate)", ".tmx": "4102444800", "len(prev.vector)": "0", "len(vertex.vector)": "0",
    "len(next.vector)": "0", "len(.vector)": "0", "prev == prev.id": "1", "vertex == vertex.id": "1", "next == next.id": "1", "prev.locked": "0", "vertex.locked": "0", "next.locked": "0", ".locked": "0", "rank(2, 3)": "5", "context.rank": "o_totalprice * 2", ".rank": "o_totalprice * 2",
}
SURROGATE = "CAST('0x' || substr(md5('O' || o_orderkey), 1, 15) AS BIGINT)"
OF_ID = {"address": "{}", "index": "{}", "handle": "{} % 1099511627776 + 2199023255552", "enum": "{} & 2147483647", "bitindex": "{} >> 6"}
ATTRIBUTES |= {f"next.{a} % 1000": f"({sql.format(SURROGATE)}) % 1000" for a, sql in OF_ID.items()}
ATTRIBUTES |= {f".{a} % 1000": f"({sql.format(SURROGATE)}) % 1000" for a, sql in OF_ID.items()}
ATTRIBUTES |= {f"{p}.{a} % 1000": f"({sql.format(SURROGATE.replace(chr(39) + 'O' + chr(39) + ' || o_orderkey', chr(39) + 'C' + chr(39) + ' || c_custkey'))}) % 1000" for p in ("prev", "vertex") for a, sql in OF_ID.items()}
ATTRIBUTES |= {"popcnt(next.bitvector)": "1", "popcnt(.bitvector)": "1", "popcnt(prev.bitvector)": "1", "popcnt(vertex.bitvector)": "1"}
_values = ", ".join(f"round(CAST({e} AS DOUBLE), 4)" for e in ATTRIBUTES.values())


@register("hop_attributes", f"""SELECT 'O' || o_orderkey AS id, unnest(range({len(ATTRIBUTES)})) AS f, unnest([{_values}]) AS y FROM customer JOIN orders ON o_custkey = c_custkey
    JOIN (SELECT o_custkey AS owner, count(*) AS n FROM orders GROUP BY o_custkey) ON owner = c_custkey WHERE c_custkey <= 20""")
def hop_attributes(spark, d):
    """Every attribute of the first twenty customers' orders, by all names of a place."""
    g = graph(spark, d, "customer", "orders")
    g = g.with_(arcs=g.arcs.filter("rel = 'placed'"))
    anchors = {"type": "customer", "id": [f"C{k}" for k in range(21)]}
    select = ";".join(f"c{k}: {t}" for k, t in enumerate(ATTRIBUTES))
    out = query.neighborhood(g, None, ("placed", "D_OUT"), condition=anchors, select=select, rank="next.arc.value * 2", filter="1 || .deg")
    ys = F.array(*[F.struct(F.lit(k).cast("long").alias("f"), F.round(F.col(f"c{k}").cast("double"), 4).alias("y")) for k in range(len(ATTRIBUTES))])
    return out.select("id", F.explode(ys).alias("e")).select("id", "e.f", "e.y")


SECOND = ("prev.arc.dist", "next.arc.dist", "prev.arc.dir", "prev.arc.mod", "prev.arc.isfwd", "prev.arc.issyn", "prev.arc.value", "prev.arc == 'in_nation'", "prev.arc.type == 'in_nation'")


@register("second_hop_attributes", """SELECT 'O' || o_orderkey AS id, unnest(range(9)) AS f, unnest([1.0, 2, 1, 1, 0, 0, 1, 1, 1]) AS y FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 6""")
def second_hop_attributes(spark, d):
    """Arcs two hops away know the arc before them and how far they are."""
    g = graph(spark, d, "nation", "customer", "orders")
    tests = " && ".join(f"({t}) == {v}" for t, v in zip(SECOND, (1, 2, 1, 1, 0, 0, 1, 1, 1), strict=True))
    want = {"traverse": {"arc": ("placed", "D_OUT"), "collect": "C_COLLECT", "filter": tests}}
    rows = query.neighborhood(g, "N6", ("in_nation", "D_IN"), neighbor=want, collect=False).select("id")
    ys = F.array(*[F.struct(F.lit(k).cast("long").alias("f"), F.lit(float(v)).alias("y")) for k, v in enumerate((1, 2, 1, 1, 0, 0, 1, 1, 1))])
    return rows.select("id", F.explode(ys).alias("e")).select("id", "e.f", "e.y")


VECTORS = {
    "cosine(.vector, vector)": "list_cosine_similarity(v, q)", "sim(.vector, vector)": "list_cosine_similarity(v, q)", "euclidean(.vector, vector)": "list_distance(v, q)", "jaccard(.vector, vector)": "0", ".vector * vector": "list_dot_product(v, q)", "len(.vector + vector)": "len(v)",
    "idx(.vector + vector, 0)": "v[1] + q[1]", "idx(.vector - vector, 0)": "v[1] - q[1]", "idx(.vector * 2, 1)": "v[2] * 2", "idx(.vector / 4, 1)": "v[2] / 4", "isvector(.vector)": "1", "len(next.vector) == len(vector)": "1",
}
_values = ", ".join(f"round(CAST({e} AS DOUBLE), 5)" for e in VECTORS.values())


@register("vector_functions", f"SELECT 'V' || vec_id AS id, unnest(range({len(VECTORS)})) AS f, unnest([{_values}]) AS y FROM (SELECT vec_id, embedding::DOUBLE[] AS v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS q FROM embeddings)")
def vector_functions(spark, d):
    g = graph(spark, d, "embeddings")
    probe = list(g.vertex("V0").select("vector").first()[0])
    out = query.vertices(g, {"type": "embedding"}, vector=probe, select=";".join(f"c{k}: {t}" for k, t in enumerate(VECTORS)))
    ys = F.array(*[F.struct(F.lit(k).cast("long").alias("f"), F.round(F.col(f"c{k}").cast("double"), 5).alias("y")) for k in range(len(VECTORS))])
    return out.select("id", F.explode(ys).alias("e")).select("id", "e.f", "e.y")


SYNTHETIC = {
    "synarc.hasrel('contains')": "1", "synarc.hasrel('other')": "0", "synarc.hasmod(M_INT, M_CNT)": "1", "synarc.hasmod(M_ACC)": "0", "synarc.hasrelmod('contains', M_FLT, 'contains', M_INT)": "1", "synarc.hasrelmod('other', M_FLT)": "0",
    "synarc.value('contains', M_CNT)": "n", ".arc.issyn": "1",
}


@register("synthetic_tests", f"""SELECT 'O' || l_orderkey AS anchor, 'P' || l_partkey AS id, round(CAST({' + '.join(f'{10**k} * ({e})' for k, e in enumerate(SYNTHETIC.values()))} AS DOUBLE), 2) AS val FROM {LINES}""")
def synthetic_tests(spark, d):
    g = graph(spark, d, "orders", "part", "lineitem")
    total = " + ".join(f"{10**k} * ({t})" for k, t in enumerate(SYNTHETIC))
    out = query.neighborhood(g, None, ("contains", "D_OUT"), condition={"type": "order"}, filter=f"v = {total}; collectif(1, v)", synthetic=True)
    return out.select("anchor", "id", F.round("val", 2).alias("val"))


@register("decayed_arcs_exponential", f"""SELECT 'U' || user_id AS anchor, 'E' || event_type AS id, round(total * exp(-ln(1e4) * ({NOW} - begun) / (ends - begun)), 6) AS val FROM
    (SELECT user_id, event_type, CAST(floor(epoch(min(ts))) AS BIGINT) AS begun, CAST(floor(epoch(max(ts))) AS BIGINT) + 86400000 AS ends, CAST(count(*) AS DOUBLE) AS total FROM events GROUP BY ALL)""")
def decayed_arcs_exponential(spark, d):
    g = graph(spark, d, "events")
    g = g.with_(arcs=g.arcs.filter("mod <> 'M_ACC'"))
    out = query.neighborhood(g, None, ("did", "D_OUT"), condition={"type": "user"}, filter="v = synarc.xdecay('did'); collectif(1, v)", synthetic=True)
    return out.select("anchor", "id", F.round("val", 6).alias("val"))


# Conditions, sort keys, fields, directions

LSH = "((l_partkey * 40503 + l_orderkey * 2654435) & 4294967295)"
PROBE_BITS = 0xFFFF0F33


@register("lsh_arcs", f"""SELECT 'O' || l_orderkey AS anchor, 'P' || l_partkey AS id FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE bit_count(xor({LSH}, {PROBE_BITS})) <= 12""")
def lsh_arcs(spark, d):
    """Arcs whose bits differ from given ones in at most twelve."""
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    arcs = pairs.select(F.expr("'O' || l_orderkey").alias("tail"), F.lit("lsh").alias("rel"), F.lit("M_LSH").alias("mod"), F.expr(LSH).cast("double").alias("value"), F.expr("'P' || l_partkey").alias("head"))
    g = graph(spark, d, "orders", "part").with_(arcs=arcs)
    return query.neighborhood(g, None, ("lsh", "D_OUT", "M_LSH", "V_LTE", (PROBE_BITS, 12)), condition={"type": "order"}).select("anchor", "id")


SORT_KEYS = {
    "S_ID": "id", "S_OBID": "md5(id)", "S_ADDR": "CAST('0x' || substr(md5(id), 1, 15) AS BIGINT)", "S_TMC": "t, id", "S_TMM": "t, id", "S_TMX": "id", "S_DEG": "deg DESC, id", "S_IDEG": "deg DESC, id", "S_ODEG": "id",
}
_sorted = " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS sortby, id FROM o ORDER BY {o} LIMIT 7)" for k, o in SORT_KEYS.items())


@register("sort_keys", f"WITH o AS (SELECT 'O' || o_orderkey AS id, epoch(o_orderdate) AS t, 1 AS deg FROM orders) {_sorted}")
def sort_keys(spark, d):
    g = graph(spark, d, "customer", "orders")
    out = None
    for key in SORT_KEYS:
        part = query.vertices(g, {"type": "order"}, sortby=key, hits=7).select(F.lit(key).alias("sortby"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@register("sort_hamming")
def sort_hamming(spark, d):
    """The vertices whose fingerprints differ least from a probe's; SQL has no random projections, so a test recounts them."""
    g = graph(spark, d, "embeddings")
    probe = list(g.vertex("V0").select("vector").first()[0])
    return query.vertices(g, {"similarity": {"vector": probe, "hamdist": ("V_LTE", 30)}}, sortby="S_HAM", hits=20, vector=probe).select("id", "ham")


@register("result_fields", """SELECT 'C' || c_custkey AS anchor, md5('C' || c_custkey) AS anchor_obid, 'D_OUT' AS dir, 'placed' AS rel, 'M_FLT' AS mod, o_totalprice AS val, 'O' || o_orderkey AS id, md5('O' || o_orderkey) AS obid, 'order' AS type,
    CAST(1 AS BIGINT) AS deg, CAST(1 AS BIGINT) AS ideg, CAST(0 AS BIGINT) AS odeg, CAST(epoch(o_orderdate) AS BIGINT) AS tmc, CAST(epoch(o_orderdate) AS BIGINT) AS tmm, CAST(4102444800 AS BIGINT) AS tmx,
    CAST('0x' || substr(md5('O' || o_orderkey), 1, 15) AS BIGINT) AS addr FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey = 7""")
def result_fields(spark, d):
    g = graph(spark, d, "customer", "orders")
    names = ("F_AARC", "F_NAMES", "F_PRED", "F_DEGREES", "F_TSTAMP", "F_ADDR")
    return query.neighborhood(g, "C7", ("placed", "D_OUT"), fields=names)


@register("result_lists", "SELECT 'N' || n_nationkey || ' nation' AS item FROM nation UNION ALL SELECT '{\"id\":\"N' || n_nationkey || '\",\"type\":\"nation\"}' FROM nation")
def result_lists(spark, d):
    g = graph(spark, d, "nation")
    want = dict(condition={"type": "nation"}, fields="F_NONE")
    rows = [query.vertices(g, want["condition"], fields=["F_ID", "F_TYPE"], result=r) for r in ("R_STR", "R_DICT")]
    return rows[0].unionByName(rows[1])


DYNAMIC = {
    "V_DYN_LTE": (None, "b.val <= a.val"), "V_DYN_LT": (None, "b.val < a.val"), "V_DYN_GTE": (None, "b.val >= a.val"), "V_DYN_EQ": (None, "b.val = a.val"), "V_DYN_NEQ": (None, "b.val <> a.val"), "V_DYN_DELTA": ((-5.0, 2.0), "b.val BETWEEN a.val - 5 AND a.val + 2"),
    "V_DYN_RATIO": ((0.5, 0.9), "b.val BETWEEN a.val * 0.5 AND a.val * 0.9"),
}
_dynamic = " UNION ALL ".join(
    f"SELECT '{k}' AS cond, 'O' || a.l_orderkey AS id FROM q a WHERE a.l_partkey = 11 AND EXISTS (SELECT 1 FROM q b WHERE b.l_orderkey = a.l_orderkey AND {w})" for k, (_, w) in DYNAMIC.items()
)


@register("dynamic_conditions", f"WITH q AS (SELECT l_orderkey, l_partkey, quantity AS val FROM {LINES}) {_dynamic}")
def dynamic_conditions(spark, d):
    g = graph(spark, d, "orders", "part", "lineitem")
    out = None
    for name, (v, _) in DYNAMIC.items():
        arc = ("contains", "D_OUT", "M_INT", name) if v is None else ("contains", "D_OUT", "M_INT", name, v)
        part = query.neighborhood(g, "P11", ("contains", "D_IN", "M_INT"), neighbor={"adjacent": {"arc": arc}}).select(F.lit(name).alias("cond"), "id")
        out = part if out is None else out.unionByName(part)
    return out


ALIASES = {
    "ids": ({"id": ["N1", "N7", "N2*"]}, "n_nationkey IN (1, 7, 2) OR n_nationkey >= 20"), "virtual": ({"type": "nation", "virtual": False}, "true"), "post": ({"type": "nation", "post": "vertex['nationkey'] > 20"}, "n_nationkey > 20"),
    "has_arc": ({"type": "nation", "has_arc": ("in_region", "D_OUT"), "has_neighbor": {"id": "R1"}}, "n_regionkey = 1"), "traverse": ({"type": "nation", "arc": ("in_region", "D_OUT"), "neighbor": {"id": "R2"}}, "n_regionkey = 2"),
    "scan": ({"type": "nation", "traverse": {"arc": ("in_region", "D_OUT"), "neighbor": {"id": "R3"}, "collect": "C_SCAN"}}, "n_regionkey = 3"), "none": ({"type": "nation", "traverse": {"arc": "in_region", "collect": "C_NONE"}}, "true"),
    "never": ({"type": "nation", "adjacent": {"arc": "in_region", "assert": False}}, "false"), "always": ({"type": "nation", "adjacent": {"arc": "nothing", "assert": True}}, "true"), "no_type": ({"type": "*", "id": "N3"}, "n_nationkey = 3"),
    "not_type": ({"type": ("V_NEQ", "region"), "id": "N4"}, "n_nationkey = 4"), "not_ids": ((False, {"type": "nation", "adjacent": {"arc": ("in_region", "D_OUT"), "neighbor": {"id": "R0"}}}), "n_regionkey <> 0"),
    "deep": ({"type": "nation", "adjacent": {"arc": ("in_region", "D_OUT"), "neighbor": {"adjacent": {"arc": ("in_region", "D_IN"), "neighbor": {"id": "N9"}}}}}, "n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 9)"),
}


@register("condition_forms", " UNION ALL ".join(f"SELECT '{k}' AS form, 'N' || n_nationkey AS id FROM nation WHERE {w}" for k, (_, w) in ALIASES.items()))
def condition_forms(spark, d):
    g = graph(spark, d, "nation", "region")
    out = None
    for name, (spec, _) in ALIASES.items():
        part = query.vertices(g, spec).filter("type = 'nation'").select(F.lit(name).alias("form"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@register("hop_distances", """SELECT 'N' || n_nationkey AS id, 1 AS dist FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'C' || c_custkey, 2 FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 1
    UNION ALL SELECT 'O' || o_orderkey, 3 FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 1""")
def hop_distances(spark, d):
    """Three levels, collected together, each with its distance as the arc's value."""
    g = graph(spark, d, "region", "nation", "customer", "orders")
    take = "collectif(1, next.arc.dist)"
    third = {"traverse": {"arc": ("placed", "D_OUT"), "collect": "C_COLLECT", "assert": True, "filter": take}}
    second = {"traverse": {"arc": ("in_nation", "D_IN"), "collect": "C_COLLECT", "assert": True, "filter": take, "neighbor": third}}
    return query.neighborhood(g, "R1", ("in_region", "D_IN"), neighbor=second, filter=take).select("id", F.col("val").cast("int").alias("dist"))


@register("enumerations", """SELECT 'rel' AS kind, 'in_region' AS name, count(*) AS n FROM nation UNION ALL SELECT 'rel', 'in_nation', count(*) FROM customer UNION ALL SELECT 'type', 'nation', count(*) FROM nation UNION ALL SELECT 'type', 'customer', count(*) FROM customer
    UNION ALL SELECT 'key', unnest(['nationkey', 'lat', 'lon']), unnest([(SELECT count(*) FROM nation) + (SELECT count(*) FROM customer), (SELECT count(*) FROM nation), (SELECT count(*) FROM nation)])
    UNION ALL SELECT 'value', c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment""")
def enumerations(spark, d):
    g = graph(spark, d, "nation", "customer")
    named = lambda kind, df: df.select(F.lit(kind).alias("kind"), "name", "n")
    keys = g.property_keys().filter(F.col("name").isin("nationkey", "lat", "lon"))
    values = g.string_values().filter("name NOT LIKE 'Customer#%' AND name NOT LIKE 'NATION%'").join(table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct(), "name", "left_semi")
    return named("rel", g.relationships()).unionByName(named("type", g.vertex_types())).unionByName(named("key", keys)).unionByName(named("value", values))


@register("evaluate_places", "SELECT n_nationkey * 100 + r_regionkey + 7 AS y FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 8")
def evaluate_places(spark, d):
    """An expression of a tail, an arc and a head."""
    g = graph(spark, d, "nation", "region")
    head = table(spark, d, "nation").filter("n_nationkey = 8").first()["n_regionkey"]
    text = "prev['nationkey'] * 100 + int(slice(next.id, 1, null)) + next.arc.value"
    return query.evaluate(g, text, tail="N8", arc=("in_region", "D_OUT", "M_INT", 7), head=f"R{head}").select(F.col("y").cast("int").alias("y"))


# Changes

@register("connect_lifespan", f"""SELECT 'C' || o_custkey AS tail, 'O' || o_orderkey AS head, unnest(['M_INT', 'M_TMC', 'M_TMM', 'M_TMX']) AS mod, unnest([5.0, {NOW}, {NOW}, {NOW} + 60]) AS value FROM orders WHERE o_orderkey % 2 = 0""")
def connect_lifespan(spark, d):
    """Arcs that are to live for a minute, with the times they were made and last set."""
    g = graph(spark, d, "customer", "orders")
    arcs = g.arcs.filter("rel = 'placed' AND CAST(substring(head, 2) AS BIGINT) % 2 = 0").select("tail", F.lit("likes").alias("rel"), F.lit("M_INT").alias("mod"), F.lit(5.0).alias("value"), "head")
    return mutate.connect(g, arcs, lifespan=60, timestamps=True).arcs.filter("rel = 'likes'").select("tail", "head", "mod", "value")


@register("connect_condition", "SELECT 'C' || o_custkey AS tail, 'O' || o_orderkey AS head, CASE WHEN o_totalprice > 100000 THEN -1.0 ELSE o_totalprice END AS value FROM orders")
def connect_condition(spark, d):
    """Arcs are set anew only where the ones that are there pass a filter."""
    g = graph(spark, d, "customer", "orders")
    again = g.arcs.filter("rel = 'placed'").withColumn("value", F.lit(-1.0))
    return mutate.connect(g, again, condition=("placed", "D_OUT", "M_FLT", "V_GT", 100000.0)).arcs.filter("rel = 'placed'").select("tail", "head", "value")


@register("vertex_changes", """SELECT 'N' || n_nationkey AS id, n_nationkey + 10.0 AS more, CAST(n_nationkey < 20 AS BIGINT) AS kept, CASE WHEN n_nationkey % 2 = 0 THEN 2.0 ELSE (n_nationkey * 7) % 120 - 60 END AS c1,
    CAST(CASE WHEN n_nationkey % 2 = 0 THEN 4102444800 ELSE 1800000000 END AS BIGINT) AS tmx FROM nation""")
def vertex_changes(spark, d):
    """Properties added to and removed, ranks set, expiry set and cleared."""
    g = graph(spark, d, "nation")
    ids, even, high = (g.vertices.filter(f).select("id") for f in ("true", "num['nationkey'] % 2 = 0", "num['nationkey'] >= 20"))
    g = mutate.inc_property(mutate.set_property(g, "more", g.vertices.select("id", F.element_at("num", "nationkey").alias("value"))), "more", ids.withColumn("value", F.lit(10.0)))
    g = mutate.remove_property(g, high, "lat")
    g = mutate.set_rank(g, even.select("id", F.lit(2.0).alias("c1"), F.lit(0.0).alias("c0")))
    g = mutate.clear_expiration(mutate.set_expiration(g, ids.withColumn("value", F.lit(1800000000))), even)
    rows = g.vertices
    return rows.select("id", F.element_at("num", "more").alias("more"), F.map_contains_key("num", "lat").cast("long").alias("kept"), "c1", "tmx")


@register("oplog_operations", """SELECT 'N' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey * 2.0 END AS twice, CAST(CASE WHEN n_nationkey % 2 = 1 AND n_nationkey % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS arcs
    FROM nation WHERE n_nationkey % 2 = 1 OR n_nationkey % 4 = 0""")
def oplog_operations(spark, d):
    """Nations made, given a property and an arc; even ones deleted, every fourth made again, arcs of every third deleted."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").alias("r"))
    name = F.concat(F.lit("N"), F.col("k"))
    op = lambda t, code, rows, *args: rows.select(F.lit(t).cast("long").alias("trans"), F.col("k").alias("serial"), F.lit(code).alias("op"), F.array(*[a.cast("string") for a in args]).alias("args"))
    steps = [
        op(1, "vxn", n, name, F.lit("nation")), op(2, "vps", n, name, F.lit("twice"), F.col("k") * 2), op(3, "arc", n, name, F.lit("in"), F.lit("M_INT"), F.lit(1), F.concat(F.lit("R"), F.col("r"))), op(4, "vxd", n.filter("k % 2 = 0"), name),
        op(5, "vxn", n.filter("k % 4 = 0"), name, F.lit("nation")), op(6, "vod", n.filter("k % 3 = 0"), name),
    ]
    ops = steps[0]
    for s in steps[1:]:
        ops = ops.unionByName(s)
    where = folder(spark, "operations")
    ops.write.parquet(f"{where}/ops")
    ops = spark.read.schema(ops.schema).parquet(f"{where}/ops")
    none = Graph(spark.createDataFrame([], "id string, type string"), spark.createDataFrame([], "tail string, rel string, mod string, value double, head string"))
    g = oplog.applied(none, ops)
    counts = g.arcs.groupBy("tail").agg(F.count("*").alias("arcs")).withColumnRenamed("tail", "id")
    rows = g.vertices.filter("id LIKE 'N%'").join(counts, "id", "left")
    return rows.select("id", F.try_element_at("num", F.lit("twice")).alias("twice"), F.coalesce("arcs", F.lit(0).cast("long")).alias("arcs"))
