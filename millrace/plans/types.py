"""Types of expressions: schema strings, promotion, and the way to and from Spark's types.

A type is dimensions and a measure, written like ``var * {name: ?string, amount: int64}``.
``?T`` may be missing.  ``map[K, {...}]`` is a foreign key of type ``K`` into the record.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Scalar:
    name: str
    optional: bool = False

    def __str__(self) -> str:
        return ("?" if self.optional else "") + self.name


@dataclass(frozen=True)
class Record:
    fields: tuple[tuple[str, "Measure"], ...]
    optional: bool = False

    def __str__(self) -> str:
        return ("?" if self.optional else "") + "{" + ", ".join(f"{n}: {t}" for n, t in self.fields) + "}"

    def __getitem__(self, name: str) -> "Measure":
        return dict(self.fields)[name]

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.fields]


@dataclass(frozen=True)
class ForeignKey:
    key: Scalar
    target: Record
    optional: bool = False

    def __str__(self) -> str:
        return f"map[{self.key}, {self.target}]"


@dataclass(frozen=True)
class Nested:
    """A collection inside a field."""

    dims: tuple
    measure: "Measure"
    optional: bool = False

    def __str__(self) -> str:
        return " * ".join([*map(str, self.dims), str(self.measure)])


Measure = Scalar | Record | ForeignKey | Nested

INTS = ("int8", "int16", "int32", "int64")
UNSIGNED = ("uint8", "uint16", "uint32", "uint64")
FLOATS = ("float32", "float64")
#: Other spellings of types.
ALIASES = {"int": "int32", "real": "float64", "float": "float64", "double": "float64", "bigint": "int64", "boolean": "bool", "timestamp": "datetime", "object": "object", "void": "null"}
NAMES = {*INTS, *UNSIGNED, *FLOATS, "bool", "string", "date", "datetime", "time", "timedelta", "object", "null", "json", "bytes", "complex"}

TOKEN = re.compile(r"\s*(?:(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<num>\d+)|(?P<str>'[^']*'|\"[^\"]*\")|(?P<op>[\[\]{}:,*?]))")


class _Parser:
    def __init__(self, text: str):
        self.text, self.items, at = text, [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not a type: {self.text!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0):
        i = self.at + ahead
        return self.items[i] if i < len(self.items) else (None, None)

    def take(self, value=None):
        kind, got = self.peek()
        if kind is None or (value is not None and got != value):
            raise ValueError(f"not a type: {self.text!r}")
        self.at += 1
        return got

    def whole(self):
        out = self.type()
        if self.at != len(self.items):
            raise ValueError(f"not a type: {self.text!r}")
        return out

    def type(self):
        dims = []
        while self.peek(1)[1] == "*" and (self.peek()[0] == "num" or self.peek()[1] == "var"):
            got = self.take()
            dims.append("var" if got == "var" else int(got))
            self.take("*")
        return tuple(dims), self.measure()

    def measure(self) -> Measure:
        if self.peek()[1] == "?":
            self.take()
            return optional(self.measure())
        if self.peek()[1] == "{":
            return self.record()
        name = self.take()
        name = ALIASES.get(name, name)
        args = []
        if name == "map":
            self.take("[")
            key = self.measure()
            self.take(",")
            target = self.measure()
            self.take("]")
            return ForeignKey(key, target)
        if self.peek()[1] == "[":
            self.take()
            while self.peek()[1] != "]":
                got = self.take()
                if got not in (",", ":"):
                    args.append(got)
            self.take("]")
        if name == "decimal":
            return Scalar(f"decimal[{', '.join(args or ['38', '18'])}]")
        if name not in NAMES:
            raise ValueError(f"not a type: {name}")
        return Scalar(name)

    def record(self) -> Record:
        self.take("{")
        fields = []
        while self.peek()[1] != "}":
            name = self.take().strip("'\"")
            self.take(":")
            dims, measure = self.type()
            fields.append((name, Nested(dims, measure) if dims else measure))
            if self.peek()[1] == ",":
                self.take()
        self.take("}")
        return Record(tuple(fields))


def parse(text: str) -> tuple[tuple, Measure]:
    """Dimensions and measure of a schema string."""
    return _Parser(text).whole()


def optional(t: Measure, yes: bool = True) -> Measure:
    if isinstance(t, Nested):
        return t
    return type(t)(*[getattr(t, f) for f in t.__dataclass_fields__ if f != "optional"], yes)


def is_numeric(t: Measure) -> bool:
    return isinstance(t, Scalar) and (t.name in (*INTS, *UNSIGNED, *FLOATS) or t.name.startswith("decimal"))


def is_integral(t: Measure) -> bool:
    return isinstance(t, Scalar) and t.name in (*INTS, *UNSIGNED)


def is_(t: Measure, *names: str) -> bool:
    return isinstance(t, Scalar) and t.name in names


def promote(a: Measure, b: Measure) -> Measure:
    """The type that holds both; TypeError where there is none."""
    if isinstance(a, ForeignKey):
        a = a.key
    if isinstance(b, ForeignKey):
        b = b.key
    if not isinstance(a, Scalar) or not isinstance(b, Scalar):
        if optional(a, False) == optional(b, False):
            return a
        raise TypeError(f"{a} and {b} have no common type")
    either = a.optional or b.optional
    if a.name == b.name:
        return Scalar(a.name, either)
    names = {a.name, b.name}
    if "null" in names:
        return Scalar((names - {"null"}).pop(), True)
    if names <= {*INTS, *UNSIGNED, "bool"}:
        width = max(_bits(n) for n in names)
        mixed = any(n.startswith("u") for n in names) and any(n.startswith("int") for n in names)
        if all(n.startswith("u") or n == "bool" for n in names):
            return Scalar(f"uint{width}", either)
        return Scalar(f"int{min(64, 2 * width if mixed else width)}", either)
    if all(is_numeric(Scalar(n)) or n == "bool" for n in names):
        if any(n.startswith("decimal") for n in names) and not names & set(FLOATS):
            return Scalar(next(n for n in names if n.startswith("decimal")), either)
        small = names <= {"float32", "int8", "int16", "uint8", "uint16", "bool"}
        return Scalar("float32" if small else "float64", either)
    if names == {"date", "datetime"}:
        return Scalar("datetime", either)
    raise TypeError(f"{a} and {b} have no common type")


def _bits(name: str) -> int:
    return 8 if name == "bool" else int(re.sub(r"\D", "", name))


#: Spark types of scalars; unsigned numbers take the next wider type.
SPARK = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType(), "json": T.StringType(), "time": T.StringType(),
    "date": T.DateType(), "datetime": T.TimestampNTZType(), "timedelta": T.DayTimeIntervalType(), "bytes": T.BinaryType(),
    "object": T.StringType(), "null": T.NullType(),
}


def to_spark(t: Measure) -> T.DataType:
    if isinstance(t, Record):
        return T.StructType([T.StructField(n, to_spark(m), getattr(m, "optional", True)) for n, m in t.fields])
    if isinstance(t, ForeignKey):
        return to_spark(t.key)
    if isinstance(t, Nested):
        inner = to_spark(t.measure)
        for _ in t.dims:
            inner = T.ArrayType(inner)
        return inner
    if t.name.startswith("decimal"):
        return T.DecimalType(*map(int, re.findall(r"\d+", t.name)))
    if t.name not in SPARK:
        raise TypeError(f"{t} has no Spark type")
    return SPARK[t.name]


def from_spark(t: T.DataType, nullable: bool = False) -> Measure:
    """The measure for a Spark type."""
    if isinstance(t, T.StructType):
        return Record(tuple((f.name, from_spark(f.dataType, f.nullable)) for f in t.fields), nullable)
    if isinstance(t, T.ArrayType):
        return Nested(("var",), from_spark(t.elementType, t.containsNull))
    if isinstance(t, T.DecimalType):
        return Scalar(f"decimal[{t.precision}, {t.scale}]", nullable)
    names = {
        T.BooleanType: "bool", T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float32",
        T.DoubleType: "float64", T.DateType: "date", T.TimestampType: "datetime", T.TimestampNTZType: "datetime",
        T.DayTimeIntervalType: "timedelta", T.BinaryType: "bytes", T.NullType: "null",
    }
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return Scalar("string", nullable)
    return Scalar(names.get(type(t), "object"), nullable)
