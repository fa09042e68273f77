"""Signed URLs, scopes and grants as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNED_TAG = "archive-fetch-v1"
_RANK = {"read": 1, "write": 2, "admin": 3}


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 under a literal key: nested SHA-256 over pads computed beforehand."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def url_message(archive_hash: Column, start: Column, end: Column, exp: Column, tag: str = SIGNED_TAG) -> Column:
    return F.concat_ws("|", F.lit(tag), archive_hash, start.cast("string"), end.cast("string"), exp.cast("string"))


def sign_url(key: bytes, base: str, archive_hash: Column, start: Column, end: Column, exp: Column, tag: str = SIGNED_TAG) -> Column:
    sig = hmac_sha256(key, url_message(archive_hash, start, end, exp, tag))
    return F.concat(F.lit(f"{base}/archives/"), archive_hash, F.lit("?r="), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("&exp="), exp.cast("string"), F.lit("&sig="), sig)


def verify_url(key: bytes, url: Column, now: Column, want_start: Column, want_end: Column, tag: str = SIGNED_TAG) -> Column:
    """NULL if the URL grants the span, else ``unauthorized`` or ``forbidden``."""
    archive = F.regexp_extract(url, "/archives/([^?]*)", 1)
    number = lambda pattern: F.regexp_extract(url, pattern, 1).try_cast("long")
    start, end, exp = number(r"[?&]r=(\d+)-"), number(r"[?&]r=\d+-(\d+)"), number(r"[?&]exp=(\d+)")
    sig = F.lower(F.regexp_extract(url, "[?&]sig=([0-9a-fA-F]*)", 1))
    good = F.coalesce(sig == hmac_sha256(key, url_message(archive, start, end, exp, tag)), F.lit(False)) & start.isNotNull() & end.isNotNull() & exp.isNotNull()
    return F.when(~good | (now > exp), "unauthorized").when((want_start < start) | (want_end > end), "forbidden")


def scope_rank(scope: Column) -> Column:
    """Order of scopes: admin over write over read, others below all."""
    return F.coalesce(*(F.when(scope == s, F.lit(r)) for s, r in _RANK.items()), F.lit(0))


def satisfies(scope: Column, required: Column) -> Column:
    return scope_rank(scope) >= scope_rank(required)


def grants(claims: Column) -> Column:
    """All scopes and roles of a token's claims, given as JSON text.

    ``scope`` and ``roles`` may be strings split at white space or arrays; realm
    and client roles are nested.
    """

    def strings(path: str) -> Column:
        got = F.get_json_object(claims, path)
        return F.when(got.isNull(), F.array().cast("array<string>")).when(got.startswith("["), F.from_json(got, "array<string>")).otherwise(F.filter(F.split(got, r"\s+"), lambda x: x != ""))

    clients = F.from_json(F.get_json_object(claims, "$.resource_access"), "map<string,struct<roles:array<string>>>")
    nested = F.flatten(F.transform(F.map_values(clients), lambda c: F.coalesce(c["roles"], F.array().cast("array<string>"))))
    return F.concat(strings("$.scope"), strings("$.roles"), strings("$.realm_access.roles"), F.coalesce(nested, F.array().cast("array<string>")))


def scope_of(granted: Column, admin: str, write: str, read: str, default: str | None = None) -> Column:
    """The strongest matching scope, else the default; an empty role name matches nothing."""
    out = F.lit(default)
    for role, scope in ((read, "read"), (write, "write"), (admin, "admin")):
        if role:
            out = F.when(F.array_contains(granted, role), scope).otherwise(out)
    return out
