"""Programs with a memory: expressions that store, count, sort or collect while a neighborhood is traversed.

A program sees the rows of one anchor in a declared order and keeps its memory, registers, stack and sets between them.
Spark deals anchors out, each group runs in one Python worker batch by batch, so state never outgrows one neighborhood.
Pure functions have the same results here as in `columns`.
"""

from __future__ import annotations

import math
import statistics
import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .columns import CONSTANTS, DBL_MAX, DIRS, EARTH_RADIUS, FLT_MAX, FLT_MIN, LOG_LEAST, MODS
from .syntax import ExpressionError, read

# Workers take these modules as they are, and need not import the package.
for _module in ("columns", "syntax", "program"):
    cloudpickle.register_pickle_by_value(sys.modules[f"{__package__}.{_module}"])

MASK = (1 << 64) - 1


def signed(x: int) -> int:
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def hashed(x) -> int:
    """As the column function: XXH64 of a string's bytes or a number's eight."""
    import struct

    import xxhash

    raw = x.encode() if isinstance(x, str) else struct.pack("<d", x) if isinstance(x, float) else struct.pack("<q", signed(int(x)))
    return signed(xxhash.xxh64_intdigest(raw, 42))


def number(x):
    return x if isinstance(x, (int, float)) and not isinstance(x, bool) else 0


def positive(x) -> bool:
    """A positive match."""
    if isinstance(x, (int, float)):
        return x > 0
    return bool(x) if isinstance(x, (str, list, tuple, bytes)) else False


def away(x: float) -> float:
    return math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)


def limited(fn: Callable, least: float):
    return lambda x: fn(x) if x > 0 else least


def total(fn: Callable) -> Callable:
    """fn, with nan where mathematics has no result and the largest double where it overflows."""

    def safe(*xs):
        try:
            return fn(*xs)
        except OverflowError:
            return DBL_MAX
        except ValueError:
            return math.nan

    return safe


#: Functions of one number; `m<name>` and `mr<name>` apply them to a range of the memory.
ONE: dict[str, Callable] = {
    "ceil": math.ceil, "floor": math.floor, "round": away, "abs": abs, "sign": lambda x: (x > 0) - (x < 0), "log2": limited(math.log2, LOG_LEAST["log2"]), "log": limited(math.log, LOG_LEAST["log"]), "log10": limited(math.log10, LOG_LEAST["log10"]),
    "exp2": lambda x: 2.0**x, "exp": math.exp, "exp10": lambda x: 10.0**x, "rad": math.radians, "deg": math.degrees, "sin": math.sin, "cos": math.cos, "tan": math.tan, "asin": math.asin, "acos": math.acos, "atan": math.atan,
    "sinh": math.sinh, "cosh": math.cosh, "tanh": math.tanh, "asinh": math.asinh, "acosh": math.acosh, "atanh": math.atanh, "sinc": lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x), "inv": lambda x: 1 / x if x else FLT_MAX,
    "sq": lambda x: x * x, "sqrt": lambda x: math.sqrt(x) if x >= 0 else 0.0, "popcnt": lambda x: (int(x) & MASK).bit_count(), "int": int, "intr": lambda x: int(away(x)), "real": float, "bits": lambda x: signed(int(x)), "inc": lambda x: x + 1, "dec": lambda x: x - 1, "hash": lambda x: hashed(x),
}


def divide(a, b):
    return a / (b or FLT_MIN)


def modulo(a, b):
    return math.fmod(a, b) if isinstance(a, float) or isinstance(b, float) else int(math.fmod(a, b)) if b else 0


def power(a, b):
    return min(total(pow)(float(a if a >= 0 or isinstance(b, int) else 0.0), b), DBL_MAX)


#: Functions of two numbers; `<name>(addr, x)`, `m<name>(m1, mn, x)` and `mv<name>(A, B, k)` apply them to the memory.
TWO: dict[str, Callable] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": divide, "mod": lambda a, b: modulo(a, b) if b else 0, "shr": lambda a, b: signed((int(a) & MASK) >> int(b)), "shl": lambda a, b: signed(int(a) << int(b)),
    "and": lambda a, b: signed(int(a) & int(b)), "or": lambda a, b: signed(int(a) | int(b)), "xor": lambda a, b: signed(int(a) ^ int(b)), "pow": power,
}

#: Functions of many numbers; `m<name>(dest, m1, mn)` applies them to a range of the memory.
MANY: dict[str, Callable] = {
    "sum": math.fsum, "sumsqr": lambda xs: math.fsum(x * x for x in xs), "invsum": lambda xs: math.fsum(ONE["inv"](x) for x in xs), "prod": math.prod, "mean": lambda xs: math.fsum(xs) / max(len(xs), 1), "harmmean": lambda xs: len(xs) / (MANY["invsum"](xs) or FLT_MIN),
    "geomean": lambda xs: math.exp(math.fsum(map(ONE["log"], xs)) / max(len(xs), 1)), "stdev": lambda xs: statistics.pstdev(xs) if xs else 0.0, "geostdev": lambda xs: math.exp(statistics.pstdev([ONE["log"](x) for x in xs])) if xs else 0.0,
}

COMPARE: dict[str, Callable] = {"equ": lambda a, b: a == b, "neq": lambda a, b: a != b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


class Halt(Exception):
    """Ends the query."""


class Return(Exception):
    """Ends the expression with a value."""


class Memory:
    """Slots, a stack above them, integer and vertex sets, staged and collected arcs."""

    def __init__(self, slots: int = 128):
        self.slots, self.stack, self.sets = [0] * slots, [], {"iset": set(), "vset": set()}
        self.staged: dict[int, tuple] = {}
        self.collected: list[tuple] = []
        self.indexed: set = set()
        self.halted = False

    def at(self, address) -> int:
        return int(address) % len(self.slots)

    def span(self, first, last) -> range:
        return range(self.at(first), self.at(last) + 1)


class Program:
    """An expression ready to run over rows: dictionaries of next, prev, arc and properties."""

    def __init__(self, text: str, slots: int = 128, seed: int = 0):
        self.node, self.memory = read(text), Memory(slots)
        self.local: dict = {}
        self.row: dict = {}
        self.random = np.random.default_rng(seed)
        # Registers are the last slots, counted from the end; staging slots count from 0.
        self.registers = {f"R{k}": -k for k in range(1, 5)} | {f"C{k}": k - 1 for k in range(1, 5)}

    def run(self, row: dict):
        """The expression's value for one row; None once halted."""
        if self.memory.halted:
            return None
        self.row = row
        try:
            return self.value(self.node)
        except Return as r:
            return r.args[0]
        except Halt:
            self.memory.halted = True
            return None

    def value(self, node):
        kind = node[0]
        if kind in ("num", "str"):
            return node[1]
        if kind == "seq":
            out = None
            for n in node[1]:
                out = self.value(n)
            return out
        if kind in ("set", "define"):
            self.local[node[1]] = out = self.value(node[2])
            return out
        if kind == "label":
            return self.value(node[2])
        if kind == "name":
            return self.named(node[1])
        if kind == "index":
            if node[1] == "M":
                return self.memory.slots[self.memory.at(self.value(node[2]))]
            return self.row.get(f"{node[1] or 'next'}.{self.value(node[2])}")
        if kind == "un":
            x = self.value(node[2])
            return {"!": lambda: int(not positive(x)), "~": lambda: signed(~int(number(x))), "-": lambda: -number(x), "+": lambda: x}[node[1]]()
        if kind == "if":
            return self.value(node[2] if positive(self.value(node[1])) else node[3])
        if kind == "bin":
            return self.infix(node[1], node[2], node[3])
        if kind == "call":
            return self.call(node[1], node[2])
        raise ExpressionError(f"{kind} has no value of its own")

    def named(self, name):
        if name in self.local:
            return self.local[name]
        if name in self.registers:
            return self.registers[name]
        if name in ("r1", "r2", "r3", "r4"):
            return self.memory.slots[self.registers[name.upper()]]
        if name == "null":
            return None
        for known in (CONSTANTS, MODS, DIRS):
            if name in known:
                return known[name]
        key = f"next{name}" if name.startswith(".") else name
        if key.startswith("next.arc"):
            key = key[5:]
        if key in ("next", "prev", "vertex"):
            key += ".id"
        if name in self.row or key in self.row:
            return self.row.get(key, self.row.get(name))
        raise ExpressionError(f"unknown name {name}")

    def infix(self, op, left, right):
        a = self.value(left)
        if op in ("in", "notin"):
            if right[0] == "range":
                hit = isinstance(a, (int, float)) and self.value(right[1]) <= a < self.value(right[2])
            else:
                hit = any(self.same(a, self.value(n)) for n in (right[1] if right[0] == "list" else [right]))
            return int(hit == (op == "in"))
        b = self.value(right)
        if op in ("&&", "||"):
            return int((positive(a) and positive(b)) if op == "&&" else (positive(a) or positive(b)))
        if op in ("==", "!="):
            return int(self.same(a, b) == (op == "=="))
        if op in ("<", "<=", ">", ">="):
            if isinstance(a, str) != isinstance(b, str) or a is None or b is None:
                return 0
            return int({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])
        if op == "+":
            if isinstance(a, str) or isinstance(b, str):
                return f"{'' if a is None else a}{'' if b is None else b}"
            if a is None or b is None:
                return b if a is None else a
        return {"+": TWO["add"], "-": TWO["sub"], "*": TWO["mul"], "/": divide, "%": TWO["mod"], "**": power, "<<": TWO["shl"], ">>": TWO["shr"], "&": TWO["and"], "|": TWO["or"], "^": TWO["xor"]}[op](number(a), number(b))

    @staticmethod
    def same(a, b) -> bool:
        if isinstance(a, str) and isinstance(b, str) and b.endswith("*") and len(b) > 1:
            return a.startswith(b[:-1])
        return a == b and isinstance(a, str) == isinstance(b, str)

    # Calls: names that look alike are made by rule.

    def call(self, name, nodes):
        special = getattr(self, f"do_{name.replace('.', '_')}", None)
        if special:
            return special(nodes)
        xs = [self.value(n) for n in nodes]
        m = self.memory
        if name in COMPARE or name[1:] in COMPARE and name[0] == "r":
            deref = name not in COMPARE
            a, b = (m.slots[m.at(m.slots[m.at(x)] if deref else x)] for x in xs)
            return int(COMPARE[name[1:] if deref else name](a, b))
        if name in ONE and name not in ("inc", "dec", "sq"):
            x = number(xs[0])
            out = total(ONE[name])(x)
            return out
        if name in ("inc", "dec", "rinc", "rdec") or name in ("incif", "decif", "rincif", "rdecif"):
            if name.endswith("if"):
                if not positive(xs[0]):
                    return m.slots[m.at(xs[1])]
                xs = xs[1:]
            at = m.at(m.slots[m.at(xs[0])] if name[0] == "r" else xs[0])
            m.slots[at] = ONE["inc" if "inc" in name else "dec"](number(m.slots[at]))
            return m.slots[at]
        if name in TWO or name.endswith("if") and name[:-2] in TWO:
            if name not in TWO:
                if not positive(xs[0]):
                    return m.slots[m.at(xs[1])]
                name, xs = name[:-2], xs[1:]
            if name == "pow":
                return power(*xs)
            at = m.at(xs[0])
            m.slots[at] = TWO[name](number(m.slots[at]), number(xs[1]))
            return m.slots[at]
        if name in MANY:
            return MANY[name]([x for x in xs if isinstance(x, (int, float)) and not math.isnan(x)])
        if name[0] == "m":
            return self.array(name, xs)
        raise ExpressionError(f"unknown function {name}()")

    def array(self, name, xs):
        """m...: operations on ranges of the memory. An r or i after the m fixes the type of what is read."""
        m, bare = self.memory, name[1:]
        cast = None
        for prefix, kind in (("r", float), ("i", int)):
            rest = bare[1:]
            if bare[:1] == prefix and bare not in ONE and bare not in MANY and (rest in ONE or rest in TWO or rest in MANY):
                bare, cast = rest, kind
        read_ = lambda k: (cast or (lambda x: x))(number(m.slots[k]))
        if bare in MANY:
            values = [read_(k) for k in m.span(xs[1], xs[2])]
            m.slots[m.at(xs[0])] = out = MANY[bare](values)
            return out
        if bare in ONE and len(xs) == 2:
            for k in m.span(*xs):
                m.slots[k] = total(ONE[bare])(read_(k))
            return len(m.span(*xs))
        if bare in TWO and len(xs) == 3:
            x = (cast or (lambda x: x))(number(xs[2]))
            if cast is int and bare in ("div", "mod") and not x:
                return 0
            fn = (lambda a, b: a // b) if cast is int and bare == "div" else TWO[bare]  # whole numbers stay whole
            for k in m.span(xs[0], xs[1]):
                m.slots[k] = fn(read_(k), x)
            return len(m.span(xs[0], xs[1]))
        if bare[:1] == "v" and bare[1:] in TWO:
            a, b, n = (int(x) for x in xs)
            for k in range(n):
                m.slots[m.at(a + k)] = TWO[bare[1:]](number(m.slots[m.at(a + k)]), number(m.slots[m.at(b + k)]))
            return n
        raise ExpressionError(f"unknown function {name}()")

    def args(self, nodes):
        return [self.value(n) for n in nodes]

    # Single slots

    def put(self, at, x):
        self.memory.slots[self.memory.at(at)] = x
        return x

    def get_(self, at):
        return self.memory.slots[self.memory.at(at)]

    def do_store(self, n):
        return self.put(*self.args(n))

    def do_rstore(self, n):
        p, x = self.args(n)
        return self.put(self.get_(p), x)

    def do_storeif(self, n):
        c, at, x = self.args(n)
        return self.put(at, x) if positive(c) else 0

    def do_rstoreif(self, n):
        c, p, x = self.args(n)
        return self.put(self.get_(p), x) if positive(c) else 0

    def do_load(self, n):
        return self.get_(self.args(n)[0])

    def do_rload(self, n):
        return self.get_(self.get_(self.args(n)[0]))

    def do_write(self, n):
        at, *xs = self.args(n)
        for k, x in enumerate(xs):
            self.put(at + k, x)
        return len(xs)

    def do_writeif(self, n):
        return self.do_write(n[1:]) if positive(self.value(n[0])) else 0

    def do_rwrite(self, n):
        p, *xs = self.args(n)
        for k, x in enumerate(xs):
            self.put(self.get_(p) + k, x)
        self.put(p, self.get_(p) + len(xs))
        return len(xs)

    def do_rwriteif(self, n):
        return self.do_rwrite(n[1:]) if positive(self.value(n[0])) else 0

    def do_push(self, n):
        self.memory.stack.append(self.args(n)[0])
        return self.memory.stack[-1]

    def do_pushif(self, n):
        return self.do_push(n[1:]) if positive(self.value(n[0])) else 0

    def do_pop(self, n):
        return self.memory.stack.pop() if self.memory.stack else None

    def do_popif(self, n):
        return self.do_pop(n) if positive(self.value(n[0])) else None

    def do_get(self, n):
        return self.memory.stack[-1] if self.memory.stack else None

    def do_mov(self, n):
        d, s = self.args(n)
        return self.put(d, self.get_(s))

    def do_rmov(self, n):
        d, s = self.args(n)
        return self.put(self.get_(d), self.get_(self.get_(s)))

    def do_movif(self, n):
        return self.do_mov(n[1:]) if positive(self.value(n[0])) else 0

    def do_rmovif(self, n):
        return self.do_rmov(n[1:]) if positive(self.value(n[0])) else 0

    def do_xchg(self, n):
        a, b = self.args(n)
        x, y = self.get_(a), self.get_(b)
        self.put(a, y)
        self.put(b, x)
        return 1

    def do_rxchg(self, n):
        a, b = (self.get_(x) for x in self.args(n))
        x, y = self.get_(a), self.get_(b)
        self.put(a, y)
        self.put(b, x)
        return 1

    def do_xchgif(self, n):
        return self.do_xchg(n[1:]) if positive(self.value(n[0])) else 0

    def do_rxchgif(self, n):
        return self.do_rxchg(n[1:]) if positive(self.value(n[0])) else 0

    def do_smooth(self, n):
        at, x, share = self.args(n)
        return self.put(at, (1 - share) * number(self.get_(at)) + share * number(x))

    def do_count(self, n):
        at = self.value(n[0])
        self.args(n[1:])
        return self.put(at, number(self.get_(at)) + 1)

    def do_countif(self, n):
        return self.do_count(n[1:]) if positive(self.value(n[0])) else self.get_(self.value(n[1]))

    def do_modindex(self, n):
        at, k = self.args(n)
        old = int(number(self.get_(at)))
        self.put(at, (old + 1) % int(k))
        return old

    def do_index(self, n):
        self.memory.indexed.add(self.args(n)[0])
        return 1

    def do_indexed(self, n):
        return int(self.args(n)[0] in self.memory.indexed)

    def do_unindex(self, n):
        self.memory.indexed.discard(self.args(n)[0])
        return 1

    # Ranges that no rule covers

    def do_mset(self, n):
        a, b, x = self.args(n)
        for k in self.memory.span(a, b):
            self.memory.slots[k] = x
        return len(self.memory.span(a, b))

    def do_mreset(self, n):
        self.memory.slots = [0] * len(self.memory.slots)
        return 1

    def do_mrandomize(self, n):
        for k in self.memory.span(*self.args(n)):
            self.memory.slots[k] = float(self.random.random())
        return 1

    def do_mrandbits(self, n):
        for k in self.memory.span(*self.args(n)):
            self.memory.slots[k] = signed(int(self.random.integers(0, 1 << 63)) * 2)
        return 1

    def do_mcopy(self, n):
        d, s, k = (int(x) for x in self.args(n))
        values = [self.get_(s + j) for j in range(k)]
        for j, x in enumerate(values):
            self.put(d + j, x)
        return k

    def do_mpwrite(self, n):
        p, s, k = (int(x) for x in self.args(n))
        for j in range(k):
            self.put(self.get_(p) + j, self.get_(s + j))
        return k

    def do_mcopyobj(self, n):
        d, obj = self.args(n)
        for j, x in enumerate(obj or []):
            self.put(d + j, x)
        return len(obj or [])

    def do_mterm(self, n):
        return self.put(self.args(n)[0], None)

    def do_mlen(self, n):
        a = self.memory.at(self.args(n)[0])
        return next((k - a for k in range(a, len(self.memory.slots)) if self.memory.slots[k] is None), len(self.memory.slots) - a)

    def sorted_range(self, n, reverse, real=False):
        a, k = (int(x) for x in self.args(n))
        values = sorted((number(self.get_(a + j)) for j in range(k)), key=float if real else None, reverse=reverse)
        for j, x in enumerate(values):
            self.put(a + j, x)
        return k

    def do_msort(self, n):
        return self.sorted_range(n, False)

    def do_msortrev(self, n):
        return self.sorted_range(n, True)

    def do_mrsort(self, n):
        return self.sorted_range(n, False, True)

    def do_mrsortrev(self, n):
        return self.sorted_range(n, True, True)

    def do_mreverse(self, n):
        a, k = (int(x) for x in self.args(n))
        values = [self.get_(a + j) for j in range(k)][::-1]
        for j, x in enumerate(values):
            self.put(a + j, x)
        return k

    # Heaps: a range of k slots with its extreme at the start; null slots are free.

    def heap(self, a, k, xs, largest):
        """Keeps the k largest (or smallest) of the range and xs, the next one to go first."""
        held = [self.get_(a + j) for j in range(k)]
        pushed = 0
        for x in xs:
            if None in held:
                held[held.index(None)] = x
                pushed += 1
                continue
            worst = min(held) if largest else max(held)
            if (x > worst) if largest else (x < worst):
                held[held.index(worst)] = x
                pushed += 1
        known = sorted((x for x in held if x is not None), reverse=not largest)
        for j in range(k):
            self.put(a + j, known[j] if j < len(known) else None)
        return pushed

    def do_mheapinit(self, n):
        a, k = (int(x) for x in self.args(n))
        for j in range(k):
            self.put(a + j, None)
        return k

    def do_mheappushmin(self, n):
        a, k, x = self.args(n)
        return self.heap(int(a), int(k), [x], True)

    def do_mheappushmax(self, n):
        a, k, x = self.args(n)
        return self.heap(int(a), int(k), [x], False)

    def do_mheapwritemin(self, n):
        a, k, *xs = self.args(n)
        return self.heap(int(a), int(k), xs, True)

    def do_mheapwritemax(self, n):
        a, k, *xs = self.args(n)
        return self.heap(int(a), int(k), xs, False)

    def do_mheapifymin(self, n):
        a, k = (int(x) for x in self.args(n))
        self.heap(a, k, [], True)
        return k

    def do_mheapifymax(self, n):
        a, k = (int(x) for x in self.args(n))
        self.heap(a, k, [], False)
        return k

    def do_mheapsiftmin(self, n):
        a, k, first, last = self.args(n)
        return self.heap(int(a), int(k), [self.memory.slots[j] for j in self.memory.span(first, last)], True)

    def do_mheapsiftmax(self, n):
        a, k, first, last = self.args(n)
        return self.heap(int(a), int(k), [self.memory.slots[j] for j in self.memory.span(first, last)], False)

    # Probes

    def extreme(self, n, fn):
        dest, a, b = self.args(n)
        span = self.memory.span(a, b)
        where = fn(span, key=lambda k: number(self.memory.slots[k]))
        self.put(dest, self.memory.slots[where])
        return where

    def do_mmax(self, n):
        return self.extreme(n, max)

    def do_mmin(self, n):
        return self.extreme(n, min)

    def found(self, n):
        a, b, x = self.args(n)
        return [k for k in self.memory.span(a, b) if self.same(self.memory.slots[k], x)]

    def do_mcontains(self, n):
        return int(bool(self.found(n)))

    def do_mcount(self, n):
        return len(self.found(n))

    def do_mindex(self, n):
        return next(iter(self.found(n)), -1)

    def do_mcmp(self, n):
        a, b, k = (int(x) for x in self.args(n))
        for j in range(k):
            x, y = number(self.get_(a + j)), number(self.get_(b + j))
            if x != y:
                return 1 if x > y else -1
        return 0

    def do_mcmpa(self, n):
        a, b, k = (int(x) for x in self.args(n))
        return next((1 if number(self.get_(a + j)) > number(self.get_(b + j)) else -1 for j in range(k) if not math.isclose(number(self.get_(a + j)), number(self.get_(b + j)), rel_tol=1e-6)), 0)

    def do_msubset(self, n):
        p, q, a, b = self.args(n)
        have = [self.memory.slots[k] for k in self.memory.span(a, b)]
        return int(all(self.memory.slots[k] in have for k in self.memory.span(p, q)))

    def do_msubsetobj(self, n):
        p, q, obj = self.args(n)
        return int(all(self.memory.slots[k] in (obj or []) for k in self.memory.span(p, q)))

    def do_msumprodobj(self, n):
        a, b, obj = self.args(n)
        return math.fsum(number(self.memory.slots[k]) * x for k, x in zip(self.memory.span(a, b), obj or [], strict=False))

    # Sets

    def set_call(self, which, what, n):
        s = self.memory.sets[which]
        x = self.args(n)[0] if n else None
        if what == "add":
            new = x not in s
            s.add(x)
            return int(new)
        if what == "del":
            had = x in s
            s.discard(x)
            return int(had)
        if what == "has":
            return int(x in s)
        size = len(s)
        if what in ("clr", "ini"):
            s.clear()
        return size if what in ("clr", "len") else 1

    # Control and collection

    def do_do(self, n):
        self.args(n)
        return 1

    def do_void(self, n):
        self.args(n)
        return 0

    def do_return(self, n):
        raise Return(self.args(n)[0])

    def do_returnif(self, n):
        if positive(self.value(n[0])):
            raise Return(self.value(n[1]))
        return 0

    def do_require(self, n):
        x = self.args(n)[0]
        if not positive(x):
            raise Return(0)
        return x

    def do_halt(self, n):
        raise Halt

    def do_haltif(self, n):
        if positive(self.args(n)[0]):
            raise Halt
        return 0

    def do_halted(self, n):
        return int(self.memory.halted)

    def do_continue(self, n):
        self.memory.halted = False
        return 1

    def do_continueif(self, n):
        return self.do_continue(n) if positive(self.args(n)[0]) else 0

    def here(self, value=None):
        return (self.row.get("next.id"), self.row.get("arc.rel"), self.row.get("arc.value") if value is None else float(number(value)))

    def do_collect(self, n):
        self.memory.collected.append(self.here(*self.args(n)[:1]))
        return 1

    def do_collectif(self, n):
        return self.do_collect(n[1:]) if positive(self.value(n[0])) else 0

    def do_stage(self, n):
        value, slot = [*self.args(n), *[None, 0][len(n) :]] if len(n) < 2 else self.args(n)
        self.memory.staged[int(slot)] = self.here(value)
        return 1

    def do_stageif(self, n):
        return self.do_stage(n[1:]) if positive(self.value(n[0])) else 0

    def do_unstage(self, n):
        return int(self.memory.staged.pop(int(self.args(n)[0]) if n else 0, None) is not None)

    def do_unstageif(self, n):
        return self.do_unstage(n[1:]) if positive(self.value(n[0])) else 0

    def do_commit(self, n):
        got = self.memory.staged.pop(int(self.args(n)[0]) if n else 0, None)
        if got:
            self.memory.collected.append(got)
        return int(got is not None)

    def do_commitif(self, n):
        return self.do_commit(n[1:]) if positive(self.value(n[0])) else 0

    # Plain functions that the tables above lack

    def do_max(self, n):
        return max(map(number, self.args(n)))

    def do_min(self, n):
        return min(map(number, self.args(n)))

    def do_prox(self, n):
        a, b = self.args(n)
        return 256.0 / (256.0 + abs(a - b))

    def do_geodist(self, n):
        a, b, c, d = (math.radians(x) for x in self.args(n))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * EARTH_RADIUS * math.asin(math.sqrt(min(1.0, h)))

    def do_firstval(self, n):
        return next((x for x in self.args(n) if x is not None), None)

    def do_lastval(self, n):
        return next((x for x in self.args(n)[::-1] if x is not None), None)

    def do_keyval(self, n):
        return tuple(self.args(n))

    def do_bytes(self, n):
        return bytes(int(x) & 255 for x in self.args(n))

    def do_len(self, n):
        x = self.args(n)[0]
        return len(x) if isinstance(x, (str, bytes, list, tuple)) else int(x is not None)

    def do_str(self, n):
        return str(self.args(n)[0])

    def do_isnan(self, n):
        x = self.args(n)[0]
        return int(not isinstance(x, (int, float)) or math.isnan(x))

    def do_random(self, n):
        return float(self.random.random())


for _which in ("iset", "vset"):
    for _what in ("add", "del", "clr", "has", "len", "ini"):
        setattr(Program, f"do_{_which}_{_what}", lambda self, n, w=_which, f=_what: self.set_call(w, f, n))


def fold(rows: DataFrame, text: str, order: list[str], slots: int = 128, key: str = "anchor") -> DataFrame:
    """Runs a program over the rows of each key in order; gives what it collects: key, id, rel, value.

    rows: the key and columns named as the program names them, with dots as underscores: next_id, arc_rel, arc_value.
    """
    read(text)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        program = Program(text, slots)
        rows_ = group.sort_values(order, kind="stable") if order else group
        for row in rows_.to_dict("records"):
            program.run({k.replace("_", ".", 1): (None if isinstance(v, float) and math.isnan(v) else v) for k, v in row.items()})
        out = pd.DataFrame(program.memory.collected, columns=["id", "rel", "value"])
        out.insert(0, key, group[key].iloc[0])
        return out

    return rows.groupBy(key).applyInPandas(run, f"{key} string, id string, rel string, value double")


def evaluate(rows: DataFrame, texts: list[str], key: str = "key", slots: int = 128) -> DataFrame:
    """key, f, y: for each row and each program its value as a number, each with a fresh memory.

    rows: the key and columns that programs name, dots as in `fold`. Values that are no number give null.
    """
    for t in texts:
        read(t)

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                named = {k.replace("_", ".", 1): v for k, v in row.items()}
                for f, text in enumerate(texts):
                    y = Program(text, slots).run(named)
                    out.append((row[key], f, float(y) if isinstance(y, (int, float)) else None))
            yield pd.DataFrame(out, columns=["key", "f", "y"])

    return rows.mapInPandas(run, "key long, f int, y double")


__all__ = ["Memory", "Program", "evaluate", "fold"]
