"""Keyed hashes and signed tokens as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_BYTES = "".join(map(chr, range(256)))


def _pad(key: Column, byte: int) -> Column:
    """A binary key of at most 64 bytes, each XORed with ``byte``, filled up with ``byte``."""
    # a translation to NUL would drop the character, so that one takes a detour
    turned = F.translate(F.decode(key, "ISO-8859-1"), _BYTES, "".join(chr(i ^ byte or 0x100) for i in range(256)))
    return F.rpad(F.encode(F.replace(turned, F.lit("\u0100"), F.lit("\0")), "ISO-8859-1"), 64, F.lit(bytes([byte])))


def hmac_sha256(message: Column, key: Column) -> Column:
    """HMAC with SHA-256 in lower-case hex digits, of a text or binary message and key."""
    short = F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key.cast("binary"), 256))).otherwise(key.cast("binary"))
    inner = F.unhex(F.sha2(F.concat(_pad(short, 0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(_pad(short, 0x5C), inner), 256)


def b64url(data: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.replace(F.base64(data.cast("binary")), F.lit("\r\n"), F.lit("")), "+/", "-_"), F.lit("="))


def from_b64url(text: Column) -> Column:
    """The binary behind b64url(); empty if it can't be decoded."""
    plain = F.translate(text, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    return F.coalesce(F.try_to_binary(padded, F.lit("base64")), F.lit("").cast("binary"))


def report_token(secret: Column, fields: dict[str, Column], target: Column | None = None, at: Column | None = None) -> Column:
    """(payload, sig, id) of a report: its fields as JSON in b64url, signed, so that a changed one is told apart.

    id is the first 12 digits of SHA-256 over target, time and secret; these are fields of those names unless given.
    """
    ident = F.upper(F.left(F.sha2(F.concat(fields["target"] if target is None else target, fields["at"] if at is None else at, secret), 256), F.lit(12)))
    payload = b64url(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()], ident.alias("id"))))
    return F.struct(payload.alias("payload"), hmac_sha256(payload, secret).alias("sig"), ident.alias("id"))


def open_token(payload: Column, sig: Column, secret: Column) -> Column:
    """The JSON of a token whose signature is right; null otherwise."""
    return F.when(hmac_sha256(payload, secret) == sig, from_b64url(payload).cast("string"))
