"""Names, keys and passwords (O-146, O-163 to O-165, O-171, O-172).  Envelopes are AES-GCM with a random nonce in
front and the tag behind: 28 bytes more than the content."""

from __future__ import annotations

import base64
import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .payload import AES256, SM4


def quoted(text: Column) -> Column:
    """Single quotes doubled, as literals of SQL need."""
    return F.replace(text, F.lit("'"), F.lit("''"))


def encrypt_name(name: Column, key: bytes) -> Column:
    """The name's envelope in hexadecimal digits; equal names give different ones."""
    return F.lower(F.hex(F.aes_encrypt(F.encode(name, "UTF-8"), F.lit(key))))


def decrypt_name(name: Column, key: bytes) -> Column:
    """The name in an envelope; what is no envelope of the key stays as it is."""
    envelope = F.when(name.rlike("^([0-9a-f]{2}){28,}$"), F.unhex(name))
    return F.coalesce(F.decode(F.try_aes_decrypt(envelope, F.lit(key)), "UTF-8"), name)


def key_error(way: Column, key: Column) -> Column:
    """Why a key does not fit the encryption that the flags name; null if it does."""
    size = F.octet_length(key)
    aes = F.when(size <= 16, "AES256 needs more than 16 bytes")
    sm4 = F.when(size != 16, "SM4 needs 16 bytes")
    return F.when((way == 0), None).when(key == "", "key missing").when(way.bitwiseAND(AES256) != 0, aes).when(way.bitwiseAND(SM4) != 0, sm4)


@F.pandas_udf(T.BinaryType())
def derived(password: pd.Series, salt: pd.Series, rounds: pd.Series) -> pd.Series:
    """16 bytes of PBKDF2 with HMAC-SHA1."""
    return pd.Series([hashlib.pbkdf2_hmac("sha1", p.encode(), bytes(s), int(n), 16) for p, s, n in zip(password, salt, rounds)])


def hash_password(password: Column, salt: Column, rounds: Column) -> Column:
    """rounds:salt:hash, the last two in URL-safe base64; the caller draws salt and rounds."""
    def text(raw: Column) -> Column:
        return F.translate(F.base64(raw), "+/", "-_")

    return F.concat_ws(":", rounds.cast("string"), text(salt), text(derived(password, salt, rounds)))


@F.pandas_udf(T.BooleanType())
def verify_password(password: pd.Series, stored: pd.Series) -> pd.Series:
    def fits(p: str, s: str) -> bool:
        rounds, salt, want = s.split(":")
        return hashlib.pbkdf2_hmac("sha1", p.encode(), base64.urlsafe_b64decode(salt), int(rounds), 16) == base64.urlsafe_b64decode(want)

    return pd.Series([fits(p, s) for p, s in zip(password, stored)], dtype=bool)
