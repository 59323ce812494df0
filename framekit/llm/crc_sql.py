"""CRC-32 of a text's UTF-8 bytes as a DuckDB expression."""

from __future__ import annotations


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def crc32(blob: str) -> str:
    """``blob``: SQL of a BLOB."""
    table = f"[{', '.join(map(str, _table()))}]"
    data = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda x: ('0x' || x)::BIGINT)"
    step = f"xor(c >> 8, {table}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: {step}), 4294967295::BIGINT)"
