"""Parquet footers in plain Python: the Thrift structure, the schema tree, statistics as text.

Names and numbers are those of the public Parquet format.
"""

from __future__ import annotations

import datetime as dt
import decimal
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

#: Fixed values of the format, by their numbers.
TYPES = ("BOOLEAN", "INT32", "INT64", "INT96", "FLOAT", "DOUBLE", "BINARY", "FIXED_LEN_BYTE_ARRAY")
REPETITIONS = ("REQUIRED", "OPTIONAL", "REPEATED")
CODECS = ("UNCOMPRESSED", "SNAPPY", "GZIP", "LZO", "BROTLI", "LZ4", "ZSTD", "LZ4_RAW")
ENCODINGS = {
    0: "PLAIN", 2: "PLAIN_DICTIONARY", 3: "RLE", 4: "BIT_PACKED", 5: "DELTA_BINARY_PACKED", 6: "DELTA_LENGTH_BYTE_ARRAY", 7: "DELTA_BYTE_ARRAY",
    8: "RLE_DICTIONARY", 9: "BYTE_STREAM_SPLIT",
}
#: Converted types and the logical types that they stand for.
CONVERTED = (
    ("UTF8", "STRING"), ("MAP", "MAP"), ("MAP_KEY_VALUE", "MAP_KEY_VALUE"), ("LIST", "LIST"), ("ENUM", "ENUM"), ("DECIMAL", None), ("DATE", "DATE"),
    ("TIME_MILLIS", "TIME(MILLIS,true)"), ("TIME_MICROS", "TIME(MICROS,true)"), ("TIMESTAMP_MILLIS", "TIMESTAMP(MILLIS,true)"),
    ("TIMESTAMP_MICROS", "TIMESTAMP(MICROS,true)"), ("UINT_8", "INTEGER(8,false)"), ("UINT_16", "INTEGER(16,false)"), ("UINT_32", "INTEGER(32,false)"),
    ("UINT_64", "INTEGER(64,false)"), ("INT_8", "INTEGER(8,true)"), ("INT_16", "INTEGER(16,true)"), ("INT_32", "INTEGER(32,true)"),
    ("INT_64", "INTEGER(64,true)"), ("JSON", "JSON"), ("BSON", "BSON"), ("INTERVAL", "INTERVAL"),
)
_LOGICAL = {1: "STRING", 2: "MAP", 3: "LIST", 4: "ENUM", 6: "DATE", 11: "UNKNOWN", 12: "JSON", 13: "BSON", 14: "UUID", 15: "FLOAT16"}
_UNITS = {1: "MILLIS", 2: "MICROS", 3: "NANOS"}


class _Compact:
    """Reads values of the Thrift compact protocol; a struct becomes a dict by field number."""

    def __init__(self, data: bytes) -> None:
        self._data, self._at = data, 0

    def _byte(self) -> int:
        self._at += 1
        return self._data[self._at - 1]

    def _varint(self) -> int:
        out, shift = 0, 0
        while (b := self._byte()) & 0x80:
            out, shift = out | (b & 0x7F) << shift, shift + 7
        return out | b << shift

    def _signed(self) -> int:
        n = self._varint()
        return n >> 1 ^ -(n & 1)

    def _value(self, kind: int):
        match kind:
            case 1 | 2:
                return self._byte() == 1
            case 3:
                return struct.unpack("b", bytes([self._byte()]))[0]
            case 4 | 5 | 6:
                return self._signed()
            case 7 | 8:
                n = 8 if kind == 7 else self._varint()
                self._at += n
                raw = self._data[self._at - n : self._at]
                return struct.unpack("<d", raw)[0] if kind == 7 else raw
            case 9 | 10:
                head = self._byte()
                n = head >> 4 if head < 0xF0 else self._varint()
                return [self._value(head & 15) for _ in range(n)]
            case 11:
                n = self._varint()
                kinds = self._byte() if n else 0
                return {self._value(kinds >> 4): self._value(kinds & 15) for _ in range(n)}
            case 12:
                return self.struct()
        raise ValueError(f"not a Parquet footer: Thrift type {kind}")

    def struct(self) -> dict:
        out, number = {}, 0
        while head := self._byte():
            number = number + (head >> 4) if head >> 4 else self._signed()
            kind = head & 15
            out[number] = kind == 1 if kind in (1, 2) else self._value(kind)
        return out


@dataclass
class Node:
    """A column or group of the schema, below its parents."""

    name: str
    repetition: str | None
    type: str | None = None
    length: int = 0
    original: str | None = None
    logical: str | None = None
    scale: int = 0
    field_id: int | None = None
    children: list[Node] = field(default_factory=list)

    def line(self) -> str:
        """As the text form of a schema has it, without its children."""
        kind = "group" if self.type is None else self.type.lower() + (f"({self.length})" if self.type == TYPES[7] else "")
        return f"{self.repetition.lower()} {kind} {self.name}" + (f" ({self.logical})" if self.logical else "") + (f" = {self.field_id}" if self.field_id is not None else "")

    def text(self, indent: str = "") -> str:
        if self.repetition is None:
            return "".join([f"message {self.name} {{\n", *(c.text("  ") for c in self.children), "}\n"])
        if self.type is None:
            return "".join([f"{indent}{self.line()} {{\n", *(c.text(indent + "  ") for c in self.children), f"{indent}}}\n"])
        return f"{indent}{self.line()};\n"

    @property
    def order(self) -> str:
        return "UNDEFINED" if self.type == "INT96" or self.original == "INTERVAL" else "TYPE_DEFINED_ORDER"


def _logical(e: dict) -> tuple[str | None, str | None]:
    """Original (converted) and logical type."""
    given, converted = e.get(10), e.get(6)
    decimals = f"DECIMAL({e.get(8, 0)},{e.get(7, 0)})"
    if not given:
        if converted is None:
            return None, None
        original, logical = CONVERTED[converted]
        return original, logical or decimals
    number, detail = next(iter(given.items()))
    if number == 5:
        return "DECIMAL", f"DECIMAL({detail.get(2, 0)},{detail.get(1, 0)})"
    if number in (7, 8):
        unit = _UNITS[next(iter(detail[2]))]
        kind = "TIME" if number == 7 else "TIMESTAMP"
        return None if unit == "NANOS" else f"{kind}_{unit}", f"{kind}({unit},{str(detail.get(1, False)).lower()})"
    if number == 10:
        logical = f"INTEGER({detail[1]},{str(detail.get(2, False)).lower()})"
    else:
        logical = _LOGICAL.get(number)
    return next((o for o, known in CONVERTED if known == logical), None), logical


def _tree(elements: Iterator[dict], top: bool = True) -> Node:
    e = next(elements)
    original, logical = _logical(e)
    node = Node(e[4].decode(), None if top else REPETITIONS[e.get(3, 0)], original=original, logical=logical, field_id=e.get(9))
    if e.get(5) or 1 not in e:
        node.children = [_tree(elements, False) for _ in range(e.get(5, 0))]
    else:
        node.type, node.length, node.scale = TYPES[e[1]], e.get(2, 0), e.get(7, 0)
    return node


@dataclass
class Leaf:
    path: list[str]
    node: Node
    max_definition: int
    max_repetition: int


class Footer:
    """What a footer says, by the format's field numbers where no name is given here."""

    def __init__(self, data: bytes) -> None:
        self.fields = _Compact(data).struct()
        self.root = _tree(iter(self.fields[2]))
        self.leaves = list(_leaves(self.root))

    @property
    def groups(self) -> list[dict]:
        return self.fields.get(4, [])

    @property
    def encryption(self) -> str:
        return "PLAINTEXT_FOOTER" if 8 in self.fields else "UNENCRYPTED"

    @property
    def created_by(self) -> str | None:
        return self.fields[6].decode(errors="replace") if 6 in self.fields else None

    @property
    def key_values(self) -> dict[str, str]:
        return {e[1].decode(errors="replace"): e.get(2, b"").decode(errors="replace") for e in self.fields.get(5, [])}


def _leaves(node: Node, path: tuple[str, ...] = (), definition: int = 0, repetition: int = 0) -> Iterator[Leaf]:
    for c in node.children:
        d, r = definition + (c.repetition != "REQUIRED"), repetition + (c.repetition == "REPEATED")
        if c.type is None:
            yield from _leaves(c, (*path, c.name), d, r)
        else:
            yield Leaf([*path, c.name], c, d, r)


def read_tail(read_at: Callable[[int, int], bytes], size: int) -> bytes:
    """The footer's bytes, through ``read_at(position, length)``."""
    end = read_at(max(0, size - 8), min(8, size))
    if end[4:] == b"PARE":
        raise ValueError("the footer is encrypted, and there are no keys")
    if end[4:] != b"PAR1" or (n := int.from_bytes(end[:4], "little")) > size - 12:
        raise ValueError("not a Parquet file")
    return read_at(size - 8 - n, n)


_EPOCH = dt.datetime(1970, 1, 1)


def _moment(value: int, logical: str) -> str:
    unit, utc = logical[logical.index("(") + 1 : -1].split(",")
    per = {"MILLIS": 1000, "MICROS": 10**6, "NANOS": 10**9}[unit]
    seconds, part = divmod(value, per)
    rest = f"{part:0{len(str(per)) - 1}d}"
    if logical.startswith("TIME("):
        return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}.{rest}" + ("+0000" if utc == "true" else "")
    try:
        day = (_EPOCH + dt.timedelta(seconds=seconds)).isoformat()
    except OverflowError:
        return str(value)
    return f"{day}.{rest}" + ("+0000" if utc == "true" else "")


def _real(x: float) -> str:
    """As Java prints it: plain from 0.001 up to ten million, with an exponent elsewhere."""
    if x != x or x in (float("inf"), float("-inf")):
        return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[repr(float(x))]
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        plain = format(decimal.Decimal(repr(x)), "f")
        return plain if "." in plain else plain + ".0"
    sign, digits, exponent = decimal.Decimal(repr(x)).normalize().as_tuple()
    text = "".join(map(str, digits))
    return f"{'-' if sign else ''}{text[0]}.{text[1:] or '0'}E{exponent + len(text) - 1}"


def value_text(raw: bytes, node: Node) -> str:
    """A minimum or maximum as text."""
    match node.type:
        case "BOOLEAN":
            return str(raw[:1] == b"\1").lower()
        case "FLOAT":
            import numpy as np

            return _real(float(str(np.frombuffer(raw, "<f4")[0])))
        case "DOUBLE":
            return _real(struct.unpack("<d", raw)[0])
        case "INT32" | "INT64":
            n = int.from_bytes(raw, "little", signed=not (node.logical or "").endswith(",false)") or not node.logical.startswith("INTEGER"))
            if (node.logical or "").startswith("DECIMAL"):
                return str(decimal.Decimal(n).scaleb(-node.scale))
            if node.logical == "DATE":
                return (_EPOCH + dt.timedelta(days=n)).date().isoformat() if abs(n) < 700_000 else str(n)
            return _moment(n, node.logical) if (node.logical or "").startswith("TIME") else str(n)
    if (node.logical or "").startswith("DECIMAL"):
        return str(decimal.Decimal(int.from_bytes(raw, "big", signed=True)).scaleb(-node.scale))
    if node.logical in ("STRING", "ENUM", "JSON"):
        return raw.decode(errors="replace")
    return "0x" + raw.hex().upper()
