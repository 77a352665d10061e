"""The expression language of filter, derive and validate: parsed here, compiled to Spark columns.

Logic is two-valued: null equals null, an ordering with null is false, `not null` is true;
arithmetic with null is null, a division by zero is null. Numbers and strings never compare equal. An unknown column is null.
Integers that overflow become null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import as_text, strip


class ExprError(ValueError):
    pass


_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<str>'[^']*'|"[^"]*")|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)|(?P<op>==|!=|>=|<=|[-+*/()<>,]))""")
_COL = re.compile(r"""\s*\(\s*(?:'([^']*)'|"([^"]*)"|([^()]*?))\s*\)""")


@dataclass
class Node:
    kind: str  # num, str, bool, col, call, neg, not, and the operators
    value: object = None
    args: list = field(default_factory=list)


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0
        self.tok: tuple[str, str] | None = None
        self.next()

    def next(self) -> None:
        if not self.text[self.at :].strip():
            self.tok = None
            self.at = len(self.text)
            return
        m = _TOKEN.match(self.text, self.at)
        if not m:
            raise ExprError(f"unexpected character at {self.at} in {self.text!r}")
        self.tok = (m.lastgroup, m[m.lastgroup])
        self.at = m.end()

    def take(self, value: str) -> bool:
        if self.tok and self.tok[0] in ("op", "name") and self.tok[1] == value:
            self.next()
            return True
        return False

    def left(self, ops: tuple[str, ...], below) -> Node:
        out = below()
        while self.tok and self.tok[0] in ("op", "name") and self.tok[1] in ops:
            op = self.tok[1]
            self.next()
            out = Node(op, args=[out, below()])
        return out

    def expr(self) -> Node:
        return self.left(("or",), lambda: self.left(("and",), self.negated))

    def negated(self) -> Node:
        if self.take("not"):
            return Node("not", args=[self.negated()])
        out = self.sum()
        if self.tok and self.tok[1] in ("==", "!=", ">", ">=", "<", "<=") and self.tok[0] == "op":
            op = self.tok[1]
            self.next()
            out = Node(op, args=[out, self.sum()])
        return out

    def sum(self) -> Node:
        return self.left(("+", "-"), lambda: self.left(("*", "/"), self.unary))

    def unary(self) -> Node:
        if self.take("-"):
            x = self.unary()
            return Node("num", -x.value) if x.kind == "num" else Node("neg", args=[x])
        return self.atom()

    def atom(self) -> Node:
        if self.tok is None:
            raise ExprError(f"unexpected end of {self.text!r}")
        kind, value = self.tok
        if kind == "name" and value == "col" and (m := _COL.match(self.text, self.at)):
            self.at = m.end()
            self.next()
            return Node("col", next(g for g in m.groups() if g is not None))
        self.next()
        if kind == "num":
            return Node("num", float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "str":
            return Node("str", value[1:-1])
        if kind == "name":
            if value in ("true", "false"):
                return Node("bool", value == "true")
            if self.take("("):
                args = []
                if not self.take(")"):
                    args.append(self.expr())
                    while self.take(","):
                        args.append(self.expr())
                    if not self.take(")"):
                        raise ExprError(f"missing ) in {self.text!r}")
                return Node("call", value, args)
            return Node("col", value)
        if value == "(":
            out = self.expr()
            if not self.take(")"):
                raise ExprError(f"missing ) in {self.text!r}")
            return out
        raise ExprError(f"unexpected {value!r} in {self.text!r}")


def parse(text: str) -> Node:
    p = _Parser(text)
    out = p.expr()
    if p.tok is not None:
        raise ExprError(f"unexpected {p.tok[1]!r} in {text!r}")
    return out


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return "null" if isinstance(t, T.NullType) else "string"


SPARK = {"bool": "boolean", "int": "bigint", "float": "double", "string": "string", "date": "date", "timestamp": "timestamp", "null": "string"}
_NUM = ("int", "float")
Typed = tuple[Column, str]


def _null() -> Typed:
    return F.lit(None), "null"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def truthy(v: Typed) -> Column:
    """A boolean as it is, any other value that isn't null is true."""
    c, kind = v
    if kind == "null":
        return F.lit(False)
    return F.coalesce(c, F.lit(False)) if kind == "bool" else c.isNotNull()


def compile_expr(node: Node | str, schema: T.StructType) -> Typed:
    """(column, kind) of an expression over columns of schema."""
    if isinstance(node, str):
        node = parse(node)
    kinds = {}
    for f in schema.fields:
        kinds.setdefault(f.name, kind_of(f.dataType))
    return _compile(node, kinds)


def _compile(n: Node, kinds: dict[str, str]) -> Typed:
    if n.kind == "num":
        return (F.lit(n.value).cast("bigint"), "int") if isinstance(n.value, int) else (F.lit(n.value), "float")
    if n.kind == "str":
        return F.lit(n.value), "string"
    if n.kind == "bool":
        return F.lit(n.value), "bool"
    if n.kind == "col":
        if n.value not in kinds:
            return _null()
        kind = kinds[n.value]
        c = quoted(n.value)
        return (c.cast(SPARK[kind]) if kind in ("int", "float", "timestamp") else c), kind
    args = [_compile(a, kinds) for a in n.args]
    if n.kind == "call":
        f = _FUNCS.get(n.value)
        if f is None or not f[0] <= len(args) <= f[1]:
            return _null()
        if len(args) > 16:
            raise ExprError(f"{n.value}: more than 16 arguments")
        return f[2](*args)
    if n.kind == "neg":
        c, kind = args[0]
        return (F.try_subtract(F.lit(0).cast("bigint"), c), "int") if kind == "int" else (-c, "float") if kind == "float" else _null()
    if n.kind == "not":
        c, kind = args[0]
        return (~F.coalesce(c, F.lit(False)) if kind == "bool" else F.lit(True) if kind == "null" else c.isNull()), "bool"
    if n.kind in ("and", "or"):
        a, b = (F.coalesce(c, F.lit(False)) if k == "bool" else F.lit(False) for c, k in args)
        return (a & b if n.kind == "and" else a | b), "bool"
    if n.kind in ("==", "!=", "<", ">", "<=", ">="):
        return _compare(n.kind, *args), "bool"
    return _arith(n.kind, *args)


def _compare(op: str, a: Typed, b: Typed) -> Column:
    (x, kx), (y, ky) = a, b
    if kx != ky and not (kx in _NUM and ky in _NUM):
        if {kx, ky} == {"date", "timestamp"}:
            x, y = x.cast("timestamp"), y.cast("timestamp")
        elif kx in ("date", "timestamp") and ky == "string":
            y = y.try_cast(kx)
        elif ky in ("date", "timestamp") and kx == "string":
            x = x.try_cast(ky)
        else:
            both = x.isNull() & y.isNull()
            return both if op == "==" else ~both if op == "!=" else F.lit(False)
    if kx == "null":
        return F.lit(op == "==")
    if op == "==":
        return x.eqNullSafe(y)
    if op == "!=":
        return ~x.eqNullSafe(y)
    out = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
    return F.coalesce(out, F.lit(False))


def _arith(op: str, a: Typed, b: Typed) -> Typed:
    (x, kx), (y, ky) = a, b
    if kx in ("date", "timestamp") or ky in ("date", "timestamp"):
        if op == "-" and kx == ky == "date":
            return F.datediff(x, y).cast("bigint"), "int"
        if op == "-" and kx == ky == "timestamp":
            return F.unix_micros(x) - F.unix_micros(y), "int"
        if op == "+" and kx == "int":
            (x, kx), (y, ky) = (y, ky), (x, kx)
        if ky == "int" and op in "+-":
            y = y if op == "+" else -y
            if kx == "date":
                return F.date_add(x, y.cast("int")), "date"
            return F.timestamp_micros(F.try_add(F.unix_micros(x), y)), "timestamp"
        return _null()
    if kx not in _NUM or ky not in _NUM:
        return _null()
    if op == "/":
        return F.try_divide(x.cast("double"), y.cast("double")), "float"
    if kx == ky == "int":
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y), "int"
    x, y = x.cast("double"), y.cast("double")
    return {"+": x + y, "-": x - y, "*": x * y}[op], "float"


def _text(v: Typed) -> Column:
    return as_text(*v) if v[1] != "null" else F.lit(None).cast("string")


def _only(kind: tuple[str, ...], f, out: str | None = None):
    def call(v: Typed, *rest: Typed) -> Typed:
        if v[1] not in kind:
            return _null()
        return f(v[0], *rest), out or v[1]

    return call


def _int(v: Typed) -> Column:
    return v[0].cast("int") if v[1] in _NUM else F.lit(None).cast("int")


def _side(f):
    return lambda v, n: (F.when(_int(n) <= 0, F.when(_text(v).isNotNull(), F.lit(""))).otherwise(f(_text(v), _int(n))), "string")


def _slice(v: Typed, start: Typed, size: Typed | None = None) -> Typed:
    c, s = _text(v), _int(start)
    begin = F.when(s < 0, F.greatest(F.length(c) + s, F.lit(0))).otherwise(s)
    if size is None:
        return F.substr(c, begin + 1), "string"
    n = _int(size)
    return F.when(n < 0, F.substr(c, begin + 1)).otherwise(F.substr(c, begin + 1, F.greatest(n, F.lit(0)))), "string"


def _pad(f):
    def call(v: Typed, width: Typed, fill: Typed | None = None) -> Typed:
        c, n = _text(v), _int(width)
        char = F.lit(" ") if fill is None else F.when(F.length(_text(fill)) > 0, F.left(_text(fill), F.lit(1))).otherwise(F.lit(" "))
        missing = F.repeat(char, F.greatest(n - F.length(c), F.lit(0)))
        return (F.concat(missing, c) if f == "left" else F.concat(c, missing)), "string"

    return call


def _has(method: str):
    def call(a: Typed, b: Typed) -> Typed:
        if a[1] != "string" or b[1] != "string":
            return F.when(_text(a).isNotNull() & _text(b).isNotNull(), F.lit(False)), "bool"
        return getattr(a[0], method)(b[0]), "bool"

    return call


def _common(vs) -> str:
    kinds = {k for _, k in vs} - {"null"}
    if not kinds:
        return "null"
    if len(kinds) == 1:
        return kinds.pop()
    return "float" if kinds <= set(_NUM) else "timestamp" if kinds <= {"date", "timestamp"} else "string"


def _to(v: Typed, kind: str) -> Column:
    if v[1] == kind:
        return v[0]
    return _text(v) if kind == "string" else v[0].cast(SPARK[kind])


def _if(cond: Typed, a: Typed, b: Typed) -> Typed:
    c, kind = cond
    test = F.coalesce(c, F.lit(False)) if kind == "bool" else F.coalesce(c != 0, F.lit(False)) if kind in _NUM else truthy(cond)
    out = _common((a, b))
    return F.when(test, _to(a, out)).otherwise(_to(b, out)), out


def _coalesce(*vs: Typed) -> Typed:
    out = _common(vs)
    return F.coalesce(*[_to(v, out) for v in vs]), out


def _extreme(f):
    def call(*vs: Typed) -> Typed:
        if any(k not in _NUM for _, k in vs):
            return _null()
        out = _common(vs)
        some = F.lit(False)
        for c, _ in vs:
            some = some | c.isNull()
        return F.when(~some, f(*[c.cast(SPARK[out]) for c, _ in vs])), out

    return call


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _upper(c: Column) -> Column:
    """Letters of ASCII only; others stay as they are."""
    return F.translate(c, _LOW, _UP)


def _lower(c: Column) -> Column:
    return F.translate(c, _UP, _LOW)


def _initcap(v: Typed) -> Typed:
    low = _lower(_text(v))
    parts = F.regexp_extract_all(low, F.lit(r"[^\s_-]+|[\s_-]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(_upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), ""), "string"


def _mod(a: Typed, b: Typed) -> Typed:
    if a[1] not in _NUM or b[1] not in _NUM:
        return _null()
    kind = _common((a, b))
    return F.try_mod(a[0].cast(SPARK[kind]), b[0].cast(SPARK[kind])), kind


def _double(f):
    def call(*vs: Typed) -> Typed:
        return (f(*[c.cast("double") for c, _ in vs]), "float") if all(k in _NUM for _, k in vs) else _null()

    return call


def _replace(v: Typed, a: Typed, b: Typed) -> Typed:
    c, old, new = _text(v), _text(a), _text(b)
    return F.when(old == "", c).otherwise(F.replace(c, old, new)), "string"


_FUNCS = {
    "upper": (1, 1, lambda v: (_upper(_text(v)), "string")),
    "lower": (1, 1, lambda v: (_lower(_text(v)), "string")),
    "initcap": (1, 1, _initcap),
    "len": (1, 1, _only(("string",), lambda c: F.octet_length(c).cast("bigint"), "int")),
    "trim": (1, 1, _only(("string",), strip)),
    "left": (2, 2, _side(lambda c, n: F.left(c, n))),
    "right": (2, 2, _side(lambda c, n: F.right(c, n))),
    "slice": (2, 3, _slice),
    "concat": (1, 16, lambda *vs: (F.concat_ws("", *[_text(v) for v in vs]), "string")),
    "replace": (3, 3, _replace),
    "pad_left": (2, 3, _pad("left")),
    "pad_right": (2, 3, _pad("right")),
    "starts_with": (2, 2, _has("startswith")),
    "ends_with": (2, 2, _has("endswith")),
    "contains": (2, 2, _has("contains")),
    "if": (3, 3, _if),
    "coalesce": (1, 16, _coalesce),
    "nullif": (2, 2, lambda a, b: (F.when(~_compare("==", a, b), a[0]), a[1])),
    "abs": (1, 1, _only(_NUM, F.abs)),
    "round": (1, 1, _only(_NUM, lambda c: F.round(c).cast("bigint"), "int")),
    "floor": (1, 1, _only(_NUM, lambda c: F.floor(c).cast("bigint"), "int")),
    "ceil": (1, 1, _only(_NUM, lambda c: F.ceil(c).cast("bigint"), "int")),
    "sign": (1, 1, _only(_NUM, lambda c: F.signum(c).cast("bigint"), "int")),
    "least": (2, 16, _extreme(F.least)),
    "greatest": (2, 16, _extreme(F.greatest)),
    "pow": (2, 2, _double(F.pow)),
    "sqrt": (1, 1, _double(lambda c: F.when(c >= 0, F.sqrt(c)))),
    "log": (1, 1, _double(lambda c: F.when(c > 0, F.ln(c)))),
    "exp": (1, 1, _double(F.exp)),
    "mod": (2, 2, _mod),
}
for _alias, _name in {"substr": "slice", "length": "len", "lpad": "pad_left", "rpad": "pad_right", "min": "least", "max": "greatest"}.items():
    _FUNCS[_alias] = _FUNCS[_name]
