"""Signed links, with built-in expressions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """HMAC-SHA256 of a text as lowercase hex; the padded keys are computed once, on the driver."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def signed_link(base: Column, action: Column, id_: Column, expires: Column, secret: bytes) -> Column:
    """base?action=..&id=..&exp=..&sig=.., the signature over the first three in base64 for urls."""
    body = F.concat_ws(".", action, id_, expires.cast("string"))
    sig = F.rtrim(F.translate(F.base64(F.unhex(hmac_sha256(body, secret))), "+/", "-_"), F.lit("="))
    return F.concat(base, F.lit("?action="), action, F.lit("&id="), id_, F.lit("&exp="), expires.cast("string"), F.lit("&sig="), sig)
