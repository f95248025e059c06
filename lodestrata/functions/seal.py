"""Encryption at rest: AES-256-GCM by Spark's own functions, keys derived on the driver.

A key never stands in a plan as a literal: it is a column of a one-row table that is joined in (``with_keys``).
The key derivation is scrypt from the standard library; its name and cost are part of the stored configuration.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ids import hmac_pads

_CHECK = b"lodestrata verifier"
COST = {"n": 1 << 15, "r": 8, "p": 1}


class WrongPassphrase(ValueError):
    """The passphrase does not open this vault."""


class PassphraseRequired(ValueError):
    """The vault is encrypted and no passphrase was given."""


class NotEncrypted(ValueError):
    """A passphrase was given for a vault that holds plain data."""


def hkdf(secret: bytes, label: str, size: int = 32) -> bytes:
    """HKDF-SHA256 without salt, for one purpose."""
    pseudo = hmac.new(b"\0" * 32, secret, hashlib.sha256).digest()
    out, block, count = b"", b"", 1
    while len(out) < size:
        block = hmac.new(pseudo, block + label.encode() + bytes([count]), hashlib.sha256).digest()
        out, count = out + block, count + 1
    return out[:size]


@dataclass(frozen=True)
class Keys:
    seal: bytes
    name: bytes

    @classmethod
    def of(cls, master: bytes) -> Keys:
        return cls(hkdf(master, "chunk encryption"), hkdf(master, "chunk naming"))

    def verifier(self) -> bytes:
        return hmac.new(self.seal, _CHECK, hashlib.sha256).digest()

    def chunk_id(self, data: bytes) -> str:
        return hmac.new(self.name, data, hashlib.sha256).hexdigest()


def _master(passphrase: bytes, kdf: dict) -> bytes:
    if kdf["algo"] != "scrypt":
        raise ValueError(f"unknown key derivation {kdf['algo']!r}")
    return hashlib.scrypt(passphrase, salt=base64.b64decode(kdf["salt"]), n=kdf["n"], r=kdf["r"], p=kdf["p"], dklen=32, maxmem=256 << 20)


def new_config(passphrase: bytes) -> tuple[dict, Keys]:
    """Configuration to store, and the keys, for a new encrypted vault."""
    kdf = {"algo": "scrypt", "salt": base64.b64encode(os.urandom(16)).decode(), **COST}
    keys = Keys.of(_master(passphrase, kdf))
    return {"version": 1, "kdf": kdf, "verifier": base64.b64encode(keys.verifier()).decode()}, keys


def open_config(config: dict, passphrase: bytes) -> Keys:
    keys = Keys.of(_master(passphrase, config["kdf"]))
    if not hmac.compare_digest(base64.b64decode(config["verifier"]), keys.verifier()):
        raise WrongPassphrase("wrong passphrase")
    return keys


def with_keys(df: DataFrame, keys: Keys) -> DataFrame:
    """``df`` with binary columns seal_key, inner_pad and outer_pad: one row of three short keys, joined to every row."""
    inner, outer = hmac_pads(keys.name)
    row = df.sparkSession.createDataFrame([(bytearray(keys.seal), bytearray(inner), bytearray(outer))], "seal_key binary, inner_pad binary, outer_pad binary")
    return df.crossJoin(F.broadcast(row))


def seal(data: Column, key: Column) -> Column:
    """12 bytes of random nonce, ciphertext, 16 bytes of tag. Random: write the result once, never recompute it."""
    return F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"))


def open_sealed(blob: Column, key: Column) -> Column:
    """Plain bytes; null where the blob is too short or was changed, or the key is another."""
    return F.when(F.octet_length(blob) >= 28, F.try_aes_decrypt(blob, key, F.lit("GCM"), F.lit("DEFAULT")))
