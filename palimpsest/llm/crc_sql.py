"""CRC-32 in DuckDB SQL, for the SQL of queries that damage their input by it."""

#: A common table `crcs` of one row: t, the remainders of all bytes.
TABLE = """crcs as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c from range(256) as r(i)))"""


def crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text's UTF-8, where `crcs` is joined."""
    h = f"hex(encode({text}))"
    of_bytes = f"list_transform(range(1, length({h}), 2), lambda i: ('0x' || substr({h}, i, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {of_bytes}), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295)"
