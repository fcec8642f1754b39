"""Canonical JSON and HMAC-SHA256 as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLOCK = 64


def _escape(c: Column) -> Column:
    """One character in JSON with ASCII escapes; beyond the basic plane as two escapes."""
    code = F.ascii(c)
    four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    out = F.when(c == '"', '\\"').when(c == "\\", "\\\\")
    for raw, short in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = out.when(c == raw, short)
    rest = code - 0x10000
    return (out.when(code.between(32, 126), c).when(code < 0x10000, four(code))
            .otherwise(F.concat(four(F.shiftright(rest, 10) + 0xD800), four(rest.bitwiseAND(0x3FF) + 0xDC00))))


def json_string(c: Column) -> Column:
    """A JSON string in ASCII; null stays the word null. Plain texts skip the per-character path."""
    plain = F.regexp_like(c, F.lit(r'\A[ !#-\[\]-~]*\z'))
    slow = F.array_join(F.transform(F.split(c, ""), _escape), "")
    body = F.when(plain, c).otherwise(slow)
    return F.when(c.isNull(), "null").otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def json_number(c: Column) -> Column:
    """A float with at least one and at most seven decimals; null stays null."""
    digits = F.rtrim(c.cast("decimal(20,7)").cast("string"), F.lit("0"))
    return F.coalesce(F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits), F.lit("null"))


def json_plain(c: Column) -> Column:
    """Integers and booleans."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def json_object(fields: dict[str, Column]) -> Column:
    """Object with sorted keys and no blanks; values are JSON texts already."""
    parts = []
    for i, k in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "{") + f'"{k}":'), fields[k]]
    return F.concat(*parts, F.lit("}"))


def pads(secret: str) -> tuple[bytes, bytes]:
    """Inner and outer key blocks of HMAC for one secret."""
    import hashlib
    key = secret.encode()
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def key_table(spark: SparkSession, secrets: dict[str, str]) -> DataFrame:
    """Key blocks per agent."""
    return spark.createDataFrame([(a, *map(bytearray, pads(s))) for a, s in sorted(secrets.items())],
                                 "key_agent string, ipad binary, opad binary")


def hmac_sha256(message: Column, ipad: Column, opad: Column) -> Column:
    inner = F.sha2(F.concat(ipad, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(opad, F.unhex(inner)), 256)
