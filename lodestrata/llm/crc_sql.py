"""CRC-32 as a DuckDB expression, for the SQL that queries are checked against."""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of a string expression: byte by byte, bit by bit."""
    data = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    bit = "lambda x, z: xor(x >> 1, (x & 1) * 3988292384)"
    byte = f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {bit})"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), {byte}), CAST(4294967295 AS BIGINT))"
