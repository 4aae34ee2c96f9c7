"""Deflate, inflate and the traditional ZIP cipher: plain functions, and Arrow functions over BINARY columns."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: zlib level of each profile: fixed values
LEVELS = {"store": 0, "fast": 1, "balanced": 1, "small": 8, "maximum": 9}


def deflate(data: bytes, level: int, chunk: int = 0) -> bytes:
    """A raw deflate stream; with ``chunk``, made of independently compressed chunks that end on byte boundaries."""
    if not chunk or len(data) <= chunk:
        pack = zlib.compressobj(level, zlib.DEFLATED, -15)
        return pack.compress(data) + pack.flush()
    return b"".join(deflate_chunk(data[k : k + chunk], level, k + chunk >= len(data)) for k in range(0, len(data), chunk))


def deflate_chunk(data: bytes, level: int, last: bool) -> bytes:
    """One chunk of a stream: all but the last end with an empty block on a byte boundary instead of the final one."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    return pack.compress(data) + pack.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH)


def inflate(data: bytes, size: int) -> bytes:
    """The content of a raw stream of exactly ``size`` bytes; never makes more than one byte beyond."""
    unpack = zlib.decompressobj(-15)
    out = unpack.decompress(data, size + 1)
    if len(out) != size or not unpack.eof or unpack.unused_data:
        raise ValueError("size differs")
    return out



def _crc_table() -> np.ndarray:
    """The 256 steps of the reflected polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


#: with so few payloads left, a loop over the bytes of each is faster than steps over all of them
FEW = 32


def _cipher(payloads: list[bytes], password: bytes, decrypt: bool) -> list[bytes]:
    """The traditional cipher over many payloads at once, byte position by byte position, and over the last few one by one."""
    table = _crc_table()
    steps = table.tolist()
    k = (305419896, 591751049, 878082192)
    for b in password:
        k = _cipher_keys(k, b, steps)
    order = sorted(range(len(payloads)), key=lambda k: -len(payloads[k]))
    lengths = np.array([len(payloads[k]) for k in order], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    data = np.frombuffer(b"".join(payloads[k] for k in order), np.uint8)
    out = np.empty(len(data), np.uint8)
    k0, k1, k2 = (np.full(len(order), x, np.uint32) for x in k)
    one, two, low, by8, by24, factor = (np.uint32(x) for x in (1, 2, 255, 8, 24, 134775813))
    at, alive = 0, len(order)
    while True:
        while alive and lengths[alive - 1] <= at:
            alive -= 1
        if alive <= FEW:
            break
        if alive < len(k0):
            k0, k1, k2 = k0[:alive], k1[:alive], k2[:alive]
        here = starts[:alive] + at
        t = k2 | two  # products wrap at 32 bits, of which bits 8 to 15 are used: they depend on the low 16 bits only
        given = data[here]
        made = given ^ ((t * (t ^ one)) >> by8).astype(np.uint8)
        out[here] = made
        k0 = (k0 >> by8) ^ table[k0.astype(np.uint8) ^ (made if decrypt else given)]
        k1 = (k1 + (k0 & low)) * factor + one
        k2 = (k2 >> by8) ^ table[(k2 ^ (k1 >> by24)).astype(np.uint8)]
        at += 1
    for j in range(alive):
        rest = data[starts[j] + at : ends[j]].tobytes()
        out[starts[j] + at : ends[j]] = np.frombuffer(_cipher_rest((int(k0[j]), int(k1[j]), int(k2[j])), rest, decrypt, steps), np.uint8)
    result: list[bytes] = [b""] * len(payloads)
    for k, a, b in zip(order, starts.tolist(), ends.tolist()):
        result[k] = out[a:b].tobytes()
    return result


def _cipher_keys(keys: tuple[int, int, int], plain: int, steps: list[int]) -> tuple[int, int, int]:
    k0, k1, k2 = keys
    k0 = k0 >> 8 ^ steps[(k0 ^ plain) & 255]
    k1 = (k1 + (k0 & 255)) * 134775813 + 1 & 0xFFFFFFFF
    return k0, k1, k2 >> 8 ^ steps[(k2 ^ k1 >> 24) & 255]


def _cipher_rest(keys: tuple[int, int, int], data: bytes, decrypt: bool, steps: list[int]) -> bytearray:
    """One payload from a state of the keys on."""
    k0, k1, k2 = keys
    out = bytearray(data)
    for j, given in enumerate(data):
        t = k2 & 0xFFFF | 2
        out[j] = made = given ^ t * (t ^ 1) >> 8 & 255
        k0 = k0 >> 8 ^ steps[(k0 ^ (made if decrypt else given)) & 255]
        k1 = (k1 + (k0 & 255)) * 134775813 + 1 & 0xFFFFFFFF
        k2 = k2 >> 8 ^ steps[(k2 ^ k1 >> 24) & 255]
    return out


def encrypt_all(payloads: list[bytes], verifiers: list[int], password: bytes, heads: list[bytes]) -> list[bytes]:
    """Each with its 12-byte header: 10 given bytes, and the verifier's low and high byte."""
    return _cipher([h[:10] + v.to_bytes(2, "little") + p for p, v, h in zip(payloads, verifiers, heads)], password, False)


def decrypt_all(payloads: list[bytes], verifiers: list[int], password: bytes, strict: bool = False) -> list[bytes | None]:
    """The data, or None if it is cut short or the password is wrong: the last header byte, or both if ``strict``.

    Headers are decrypted first, and then only what they verify.
    """
    ok = lambda c, v: len(c) >= 12 and c[11] == v >> 8 & 255 and (not strict or c[10] == v & 255)
    heads = _cipher([x[:12] for x in payloads], password, True)
    right = [k for k, (c, v) in enumerate(zip(heads, verifiers)) if ok(c, v)]
    out: list[bytes | None] = [None] * len(payloads)
    for k, c in zip(right, _cipher([payloads[k] for k in right], password, True)):
        out[k] = c[12:]
    return out


def _binary(values) -> pd.Series:
    return pd.Series(values, dtype=object)


@F.pandas_udf(T.BinaryType())
def zip_deflate(data: pd.Series, level: pd.Series, chunk: pd.Series) -> pd.Series:
    return _binary([None if x is None else deflate(x, int(n), int(c)) for x, n, c in zip(data, level, chunk)])


@F.pandas_udf(T.BinaryType())
def zip_deflate_chunk(data: pd.Series, level: pd.Series, last: pd.Series) -> pd.Series:
    return _binary([None if x is None else deflate_chunk(x, int(n), bool(z)) for x, n, z in zip(data, level, last)])


@F.pandas_udf(T.BinaryType())
def zip_inflate(data: pd.Series, size: pd.Series) -> pd.Series:
    """Null where the stream is damaged or not of that size."""
    out = []
    for x, n in zip(data, size):
        try:
            out.append(None if x is None else inflate(x, int(n)))
        except (ValueError, zlib.error):
            out.append(None)
    return _binary(out)


@F.pandas_udf(T.BinaryType())
def _encrypt(data: pd.Series, verifier: pd.Series, password: pd.Series, head: pd.Series) -> pd.Series:
    return _by_password(data, password, lambda some, pw: encrypt_all([data[k] for k in some], [int(verifier[k]) for k in some], pw, [head[k] for k in some]))


@F.pandas_udf(T.BinaryType())
def _decrypt(data: pd.Series, verifier: pd.Series, password: pd.Series) -> pd.Series:
    return _by_password(data, password, lambda some, pw: decrypt_all([data[k] for k in some], [int(verifier[k]) for k in some], pw))


def _by_password(data: pd.Series, password: pd.Series, run) -> pd.Series:
    out = _binary([None] * len(data))
    for pw in password.dropna().unique():
        some = [k for k in range(len(data)) if password[k] == pw and data[k] is not None]
        for k, x in zip(some, run(some, pw.encode())):
            out[k] = x
    return out


def zip_encrypt(data: Column, verifier: Column, password: Column, seed: Column) -> Column:
    """Encrypts; the ten header bytes come from the hash of ``seed``, so that results can be repeated."""
    return _encrypt(data, verifier, password, F.unhex(F.md5(seed.cast("string"))))


def zip_decrypt(data: Column, verifier: Column, password: Column) -> Column:
    """Null where the password is wrong or the payload too short."""
    return _decrypt(data, verifier, password)


def register(spark: SparkSession) -> None:
    """The functions by name, for SQL."""
    for name, f in (("zip_deflate", zip_deflate), ("zip_deflate_chunk", zip_deflate_chunk), ("zip_inflate", zip_inflate), ("zip_encrypt", _encrypt), ("zip_decrypt", _decrypt)):
        spark.udf.register(name, f)
