import math

import pytest

from quiverdf.functions.columns import Scope, compile_expression
from quiverdf.functions.program import Memory, Program
from quiverdf.functions.syntax import ExpressionError, read

# What the language gives.
GOLDEN = {
    "1 + 2 * 3": 7, "(1 + 2) * 3": 9, "2 ** 3 ** 2": 512, "-2 ** 2": -4, "7 % 3": 1, "1 / 4": 0.25, "5 > 3 && 2 > 1": 1, "0 || -1": 0, "1 ? 2 : 3": 2, "0 ? 1 : 0 ? 2 : 3": 3, "6 & 3 | 8": 10, "1 << 4": 16, "~0": -1, "!5": 0, "3 in {1, 2, 3}": 1,
    "3 in range(1, 3)": 0, "4 notin {1, 2}": 1, "log(0)": -745.0, "log2(-1)": -1074.0, "log10(0)": -324.0, "sqrt(-4)": 0.0, "inv(4)": 0.25, "round(2.5)": 3.0, "round(-2.5)": -3.0, "floor(2.7)": 2.0, "prox(1000, 1050)": 256 / 306, "comb(5, 2)": 10,
    "mean(2, 2, 3, 5, 7)": 3.8, "sum(1, 2, 3)": 6.0, "prod(2, 2, 3, 5, 7)": 420.0, "harmmean(2, 2, 3, 5, 7)": 5 / (1 / 2 + 1 / 2 + 1 / 3 + 1 / 5 + 1 / 7), "geomean(2, 8)": 4.0, "stdev(2, 4)": 1.0, "max(2, 3) + min(2, 3)": 5, "popcnt(7)": 3,
    "x = 3; y = x + 1; x * y": 12, "null + 5": 5, "'a' == 'a'": 1, "'abc' == 'ab*'": 1, "'a' + 1 == 'a1'": 1, "1e3 + 0x10": 1016.0, "approx(1.0, 1.01, 0.1)": 1, "deg(pi)": 180.0, "sinc(0)": 1.0, "1 / 0 > 1e37": 1, "geodist(0, 0, 0, 180) / 1000": math.pi * 6371.001,
}


def test_golden_values(spark):
    found = spark.range(1).select(*[compile_expression(t, Scope()).col.cast("double").alias(f"c{k}") for k, t in enumerate(GOLDEN)]).first()
    for value, (text, want) in zip(found, GOLDEN.items()):
        assert value == pytest.approx(want, rel=1e-9), text


SHARED = [t for t in GOLDEN if not any(w in t for w in ("approx", "comb", "popcnt", "round", "floor", "geomean", "harmmean"))]


@pytest.mark.parametrize("text", SHARED)
def test_programs_agree(text):
    assert Program(text).run({}) == pytest.approx(GOLDEN[text], rel=1e-9)


@pytest.mark.parametrize("text", ["1 +", "(1", "foo(", "1 ? 2", "@", "{1, 2"])
def test_what_is_no_expression(text):
    with pytest.raises(ExpressionError):
        read(text)


def test_unknown_names():
    for text in ("nothing", "nothing(1)", "next.nothing"):
        with pytest.raises(ExpressionError):
            compile_expression(text, Scope(next="next"))


def ran(text, slots=32):
    p = Program(text, slots)
    return p.run({"next.id": "a", "arc.value": 2.0, "arc.rel": "r"}), p.memory


def test_slots():
    assert ran("store(3, 5); inc(3); load(3)")[0] == 6
    assert ran("store(1, 4); rstore(1, 9); load(4)")[0] == 9
    assert ran("write(2, 7, 8, 9); mov(0, 3); xchg(2, 4); load(0) * 100 + load(2) * 10 + load(4)")[0] == 897
    assert ran("store(0, 10); add(0, 5); mul(0, 2); sub(0, 3); mod(0, 10)")[0] == 7
    assert ran("store(0, 6); addif(0, 0, 5); addif(1, 0, 1)")[0] == 7
    assert ran("push(1); push(2); pop() * 10 + pop()")[0] == 21
    assert ran("store(R1, 4); r1 + 1")[0] == 5
    assert ran("count(0); count(0); countif(0, 0); countif(1, 0)")[0] == 3
    assert ran("store(0, 2); store(1, 3); lt(0, 1) * 10 + gte(0, 1)")[0] == 10
    assert ran("store(0, 1.0); smooth(0, 3.0, 0.5)")[0] == 2.0


def test_ranges():
    text = "write(0, 3, 1, 2); "
    assert ran(text + "msort(0, 3); load(0) * 100 + load(1) * 10 + load(2)")[0] == 123
    assert ran(text + "msortrev(0, 3); load(0)")[0] == 3
    assert ran(text + "madd(0, 2, 10); msum(5, 0, 2)")[0] == 36
    assert ran(text + "msq(0, 2); mmean(5, 0, 2)")[0] == pytest.approx(14 / 3)
    assert ran(text + "mmax(5, 0, 2); load(5)")[0] == 3
    assert ran(text + "mmin(5, 0, 2)")[0] == 1
    assert ran(text + "mcontains(0, 2, 2) * 10 + mindex(0, 2, 1)")[0] == 11
    assert ran(text + "mcopy(10, 0, 3); mcmp(0, 10, 3)")[0] == 0
    assert ran(text + "mvmul(0, 0, 3); mrsum(5, 0, 2)")[0] == 14.0
    assert ran(text + "mexp2(0, 2); load(0)")[0] == 8.0
    assert ran(text + "mset(0, 2, 4); mstdev(5, 0, 2)")[0] == 0.0
    assert ran(text + "mreverse(0, 3); load(0)")[0] == 2
    assert ran("mheapinit(0, 2); mheappushmin(0, 2, 5); mheappushmin(0, 2, 9); mheappushmin(0, 2, 7); load(0) * 10 + load(1)")[0] == 79
    assert ran(text + "minc(0, 2); mdec(0, 1); load(2)")[0] == 3


def test_sets_and_control():
    assert ran("iset.add(3) * 10 + iset.add(3) + iset.len()")[0] == 11
    assert ran("vset.add(next.id); vset.has(next.id)")[0] == 1
    assert ran("returnif(1, 7); 8")[0] == 7 and ran("require(0); 8")[0] == 0
    value, memory = ran("halt(); 8")
    assert value is None and memory.halted
    assert ran("collect(); collectif(0, 5); stage(9.0); commit()")[1].collected == [("a", "r", 2.0), ("a", "r", 9.0)]
    assert isinstance(Memory().slots, list)


def test_strings(spark):
    x = lambda t: spark.range(1).select(compile_expression(t, Scope()).col.cast("string")).first()[0]
    assert x("slice('hello', 1, 3)") == "el" and x("join('-', 'a', 'b')") == "a-b" and x("replace('aXa', 'X', 'b')") == "aba"
    assert x("isnan('s')") == "1" and x("strlen('é')") == "2" and x("len('é')") == "1"


def test_evaluate_and_definitions(spark):
    from quiverdf.plans import query
    from quiverdf.plans.graph import Graph

    g = Graph(spark.createDataFrame([("a", [1.0, 2.0])], "id string, vector array<double>"), spark.createDataFrame([], "tail string, head string"))
    memory = [1, 2]
    assert query.evaluate(g, "store(1, load(0) + 4); load(1)", memory=memory).first()["y"] == 5 and memory == [1, 5]
    assert query.evaluate(g, "len(vertex.vector) + next.arc.value", tail="a", arc=("r", "D_OUT", "M_INT", 3)).first()["y"] == 5.0
    g.define("twice := 2 * 21")
    assert g.definition("twice") == "twice := 2 * 21" and g.definition("thrice") is None
    assert query.evaluate(g, "twice").first()["y"] == 42


def test_what_has_no_counterpart_raises():
    for text in ("next.refc", "next.op", "prev.bidx", "vertex.oidx"):
        with pytest.raises(ExpressionError):
            compile_expression(text, Scope(next="next", prev="prev"))
