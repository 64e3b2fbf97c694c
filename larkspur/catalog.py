"""Typed schemas: composites with interfaces and inheritance, enums, aliases, defaults and overflow rules.

A catalog is driver-side metadata only; it turns declarations into Spark schemas
and is kept as one JSON document. Rows live in DataFrames.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Primitive types and the Spark types that hold them (fixed values).
PRIMITIVES = {
    "bit": "boolean",
    "boolean": "boolean",
    "character": "string",
    "string": "string",
    "int8": "tinyint",
    "int16": "smallint",
    "int32": "int",
    "int64": "bigint",
    "uint8": "smallint",
    "uint16": "int",
    "uint32": "bigint",
    "uint64": "decimal(20,0)",
    "int128": "string",
    "uint128": "string",
    "uuid": "string",
    "float16": "float",
    "float32": "float",
    "float64": "double",
    "bigint": "string",
    "biguint": "string",
    "fraction": "struct<num:string,den:string>",
    "timestamp": "timestamp",
}


@dataclass
class Field:
    """``type`` is a name, ``T[]``, ``{T}`` or ``{K: V}``; ``policy`` is error, saturating or wrapping."""

    name: str
    type: str
    default: object = None
    policy: str = "error"


@dataclass
class Composite:
    name: str
    fields: list[Field]
    interfaces: list[str] = field(default_factory=list)
    parent: str | None = None


@dataclass
class Interface:
    name: str
    fields: list[Field]
    parents: list[str] = field(default_factory=list)


@dataclass
class Enum:
    """Variants with discriminants, or with payload fields, not both."""

    name: str
    variants: dict[str, object]
    backing: str | None = None


@dataclass
class Alias:
    name: str
    type: str


def _merge(into: list[Field], more: list[Field], where: str) -> list[Field]:
    known = {f.name: f for f in into}
    for f in more:
        if f.name in known and known[f.name].type != f.type:
            raise ValueError(f"{where}: field {f.name} has types {known[f.name].type} and {f.type}")
        if f.name not in known:
            into = [*into, f]
            known[f.name] = f
    return into


class Catalog:
    def __init__(self) -> None:
        self.types: dict[str, Composite | Interface | Enum | Alias] = {}

    def _put(self, t):
        if t.name in self.types and self.types[t.name] is not None:
            raise ValueError(f"type {t.name} exists")
        self.types[t.name] = t
        return t

    def forward(self, name: str) -> None:
        """Announce a type that is declared later."""
        self.types.setdefault(name, None)

    def alias(self, name: str, of: str) -> Alias:
        return self._put(Alias(name, of))

    def interface(self, name: str, fields: list[Field], parents: tuple[str, ...] = ()) -> Interface:
        merged: list[Field] = []
        for p in parents:
            if not isinstance(self.types.get(p), Interface):
                raise ValueError(f"{name}: {p} is not an interface")
            merged = _merge(merged, self.types[p].fields, name)
        return self._put(Interface(name, _merge(merged, fields, name), list(parents)))

    def composite(self, name: str, fields: list[Field], parents: tuple[str, ...] = ()) -> Composite:
        """Any number of interfaces and at most one composite as parents; equal fields merge."""
        if name.startswith("_"):
            raise ValueError("names that start with _ are reserved")
        merged: list[Field] = []
        interfaces: list[str] = []
        concrete = None
        for p in parents:
            t = self.types.get(p)
            if isinstance(t, Composite):
                if concrete:
                    raise ValueError(f"{name}: two composite parents")
                concrete, interfaces = p, [*interfaces, *t.interfaces]
            elif isinstance(t, Interface):
                interfaces.append(p)
            else:
                raise ValueError(f"{name}: unknown parent {p}")
            merged = _merge(merged, t.fields, name)
        return self._put(Composite(name, _merge(merged, fields, name), list(dict.fromkeys(interfaces)), concrete))

    def enum(self, name: str, variants: dict[str, object] | list[str], backing: str | None = None) -> Enum:
        """A list, or variant -> discriminant (None: one more than before) or list of payload fields."""
        given = dict.fromkeys(variants) if isinstance(variants, list) else dict(variants)
        if any(isinstance(v, list) for v in given.values()):
            if any(isinstance(v, int) for v in given.values()):
                raise ValueError(f"{name}: discriminants and payloads do not mix")
            return self._put(Enum(name, {k: v or [] for k, v in given.items()}, backing))
        out, nxt = {}, 0
        for k, v in given.items():
            out[k] = nxt if v is None else v
            nxt = out[k] + 1
        if backing:
            bits, signed = int(backing.lstrip("uint")), not backing.startswith("u")
            lo, hi = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
            if not all(lo <= v <= hi for v in out.values()):
                raise ValueError(f"{name}: a discriminant is out of range for {backing}")
        return self._put(Enum(name, out, backing))

    def base(self, name: str) -> str:
        while isinstance(self.types.get(name), Alias):
            name = self.types[name].type
        return name

    def implementers(self, interface: str) -> list[str]:
        """Composites that implement an interface, by descent too, in order of declaration."""
        wanted, grown = {interface}, True
        while grown:
            more = {n for n, t in self.types.items() if isinstance(t, Interface) and wanted & set(t.parents)} - wanted
            wanted, grown = wanted | more, bool(more)
        return [n for n, t in self.types.items() if isinstance(t, Composite) and wanted & set(t.interfaces)]

    def fields_of(self, name: str) -> list[tuple[str, str]]:
        """(composite, field) of every field of a type, by its name or by what aliases of both stand for."""
        base = self.base(name)
        return [(n, f.name) for n, t in self.types.items() if isinstance(t, Composite) for f in t.fields if f.type == name or self.base(f.type) == base]

    def spark_type(self, name: str) -> T.DataType:
        """Composite fields are references to an index, interface fields a type and an index; arrays hold copies."""
        name = name.strip()
        if name.endswith("[]"):
            return T.ArrayType(self._element(name[:-2]))
        if name.startswith("{"):
            key, colon, value = name[1:-1].partition(":")
            return T.MapType(self._element(key), self._element(value)) if colon else T.ArrayType(self._element(key))
        name = self.base(name)
        if name in PRIMITIVES:
            return T.StructType.fromDDL(f"x {PRIMITIVES[name]}")["x"].dataType
        t = self.types.get(name)
        if isinstance(t, Enum):
            if not any(isinstance(v, list) for v in t.variants.values()):
                return T.StringType()
            payloads = [T.StructField(k, T.StructType([T.StructField(f.name, self.spark_type(f.type)) for f in v])) for k, v in t.variants.items() if v]
            return T.StructType([T.StructField("_variant", T.StringType()), *payloads])
        if isinstance(t, Interface):
            return T.StructType([T.StructField("_type", T.StringType()), T.StructField("_index", T.LongType())])
        if isinstance(t, Composite) or (t is None and name in self.types):
            return T.LongType()
        if name.endswith("[]") or name.startswith("{"):
            return self.spark_type(name)
        raise ValueError(f"unknown type {name}")

    def _element(self, name: str) -> T.DataType:
        t = self.types.get(self.base(name.strip()))
        return self.schema(t.name) if isinstance(t, Composite) else self.spark_type(name)

    def schema(self, name: str) -> T.StructType:
        return T.StructType([T.StructField(f.name, self.spark_type(f.type)) for f in self.types[self.base(name)].fields])

    def show(self, spark: SparkSession, kind: str | None = None) -> DataFrame:
        """name and kind of the declared types; names that start with _ are left out."""
        kinds = {Composite: "composite", Interface: "interface", Enum: "enum", Alias: "alias"}
        rows = [(n, kinds[type(t)]) for n, t in self.types.items() if t is not None and not n.startswith("_")]
        rows += [(n, "primitive") for n in PRIMITIVES] if kind in (None, "primitive") else []
        return spark.createDataFrame([r for r in rows if kind in (None, r[1])], "name string, kind string")

    def describe(self, spark: SparkSession, name: str) -> DataFrame:
        """Fields of a type, variants of an enum, or, for ``Enum.variant``, its payload fields."""
        enum, dot, variant = name.partition(".")
        if dot:  # the payload of one variant
            fields = self.types[self.base(enum)].variants[variant]
            rows = [(f.name, f.type, None) for f in fields] if isinstance(fields, list) else []
            return spark.createDataFrame(rows, "property string, type string, value string")
        t = self.types[self.base(name)]
        if isinstance(t, Enum):
            rows = [(k, "variant" if isinstance(v, int) else ", ".join(f"{f.name}: {f.type}" for f in v), str(v) if isinstance(v, int) else None) for k, v in t.variants.items()]
        else:
            rows = [(f.name, f.type if f.policy == "error" else f"{f.policy} {f.type}", None if f.default is None else str(f.default)) for f in t.fields]
        return spark.createDataFrame(rows, "property string, type string, value string")

    def to_json(self) -> str:
        return json.dumps([None if t is None else {"kind": type(t).__name__} | asdict(t) for t in self.types.values()], indent=1)

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        out = cls()
        make = {c.__name__: c for c in (Composite, Interface, Enum, Alias)}
        for x in filter(None, json.loads(text)):
            kind = x.pop("kind")
            if "fields" in x:
                x["fields"] = [Field(**f) for f in x["fields"]]
            if kind == "Enum":
                x["variants"] = {k: [Field(**f) for f in v] if isinstance(v, list) else v for k, v in x["variants"].items()}
            out.types[x["name"]] = make[kind](**x)
        return out
