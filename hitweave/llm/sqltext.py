"""Pieces of reference SQL that several queries share."""

from __future__ import annotations

# the crc32 of a column's distinct values: a table of 256 entries by the usual rule, then a fold over the UTF-8 bytes
CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS n)))"""


def crc32(text: str) -> str:
    """Expression for a text; ``crc_table`` must be joined."""
    byte = f"('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INT), 2))::BIGINT"
    fold = "lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({text}))), lambda i: {byte})), {fold}), 4294967295)"
