"""Sealed contents: Fernet tokens, a public format, made and opened by built-in expressions.

A token is, in URL-safe base64: the byte 0x80, the time in seconds (8 bytes, big-endian), a random start vector (16 bytes), the
content under AES-128 in CBC mode, and the HMAC-SHA256 of all of that.

A key travels as a column of a one-row table (`key_table`), not as a constant, so that plans and logs do not show it.
"""

from __future__ import annotations

import base64
import binascii

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import once

#: Bytes around the content: version, time, HMAC. Fixed values of the format.
VERSION, HEAD, BLOCK, MAC = b"\x80", 9, 16, 32
KEY = "__key struct<inner:binary,outer:binary,secret:binary>"


def key_table(spark: SparkSession, key: str) -> DataFrame:
    """The row that sealed and opened take a key from. A key is URL-safe base64 of 32 bytes: 16 to sign, 16 to encrypt; another
    one is an error, which does not repeat it."""
    try:
        raw = base64.b64decode(key.strip().encode("ascii"), b"-_", validate=True)
    except (UnicodeEncodeError, binascii.Error):
        raw = b""
    if len(raw) != 32:
        raise ValueError("a key is URL-safe base64 of 32 bytes")
    sign = raw[:16].ljust(64, b"\0")
    return spark.createDataFrame([((bytes(x ^ 0x36 for x in sign), bytes(x ^ 0x5C for x in sign), raw[16:]),)], KEY)


def _mac(signed: Column, key: Column) -> Column:
    inner = F.unhex(F.sha2(F.concat(key["inner"], signed), 256))
    return F.unhex(F.sha2(F.concat(key["outer"], inner), 256))


def sealed(content: Column, key: Column, stamp: Column, start: Column | None = None) -> Column:
    """The token (as text) of a binary content, null for null. stamp: seconds; start: the start vector, random unless given."""
    cipher = F.aes_encrypt(content, key["secret"], F.lit("CBC"), F.lit("PKCS"), *([] if start is None else [start]))
    head = F.concat(F.lit(VERSION), F.unhex(F.lpad(F.hex(stamp.cast("long")), 16, "0")))
    # the start vector is drawn anew by each evaluation, so the cipher is evaluated once
    whole = once(F.concat(head, cipher), lambda signed: F.concat(signed, _mac(signed, key)))
    return F.translate(F.base64(whole), "+/\r\n", "-_")


def opened(token: Column, key: Column) -> Column:
    """The content of a token (text or bytes), null for null. What is no token, was made with another key or was changed ends the
    job with an error; nothing is decrypted before the HMAC is found right."""
    wrong = F.raise_error(F.lit("not a token of this key")).cast("binary")

    def checked(raw: Column) -> Column:
        size = F.length(raw)
        shaped = (size >= HEAD + 2 * BLOCK + MAC) & ((size - HEAD - MAC) % BLOCK == 0) & (F.substring(raw, 1, 1) == F.lit(VERSION))
        signed = F.substring(raw, F.lit(1), size - MAC)
        right = F.substring(raw, F.lit(-MAC), F.lit(MAC)) == _mac(signed, key)
        held = F.substring(raw, F.lit(HEAD + 1), size - HEAD - MAC)
        return F.when(F.coalesce(shaped & right, F.lit(False)), F.aes_decrypt(held, key["secret"], F.lit("CBC"), F.lit("PKCS"))).otherwise(wrong)

    text = F.translate(F.btrim(token.cast("string"), F.lit(" \t\r\n")), "-_", "+/")
    return F.when(token.isNotNull(), once(F.try_to_binary(text, F.lit("base64")), checked))
