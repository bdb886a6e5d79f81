"""A vault of tokens, encrypted with a password (needs the ``cryptography`` package), or as a column under a key."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import pathlib

from pyspark.sql import Column
from pyspark.sql import functions as F

ITERATIONS = 600_000


def _fernet(password: str, grain: bytes, rounds: int):
    try:
        from cryptography.fernet import Fernet
    except ImportError as e:
        raise ImportError("an encrypted vault needs the cryptography package") from e
    return Fernet(base64.urlsafe_b64encode(hashlib.pbkdf2_hmac("sha256", password.encode(), grain, rounds, 32)))


def encrypt_vault(tokens: dict, password: str, rounds: int = ITERATIONS) -> bytes:
    if password == "":
        raise ValueError("a vault needs a password")
    grain = os.urandom(16)
    plain = json.dumps(tokens, ensure_ascii=False)
    box = {"kdf": "pbkdf2-sha256", "v": 1, "token": _fernet(password, grain, rounds).encrypt(plain.encode()).decode(), "iterations": rounds}
    return json.dumps(box | {"salt": base64.b64encode(grain).decode()}).encode()


def decrypt_vault(box_bytes: bytes, password: str) -> dict:
    """ValueError if the password is wrong or the blob isn't as it was written."""
    try:
        box = json.loads(box_bytes)
        n, token, grain = int(box["iterations"]), box["token"].encode(), base64.b64decode(box["salt"])
    except (KeyError, TypeError, ValueError) as e:
        raise ValueError("this is no vault") from e
    lock = _fernet(password, grain, n)
    from cryptography.fernet import InvalidToken

    try:
        return json.loads(lock.decrypt(token))
    except InvalidToken as e:
        raise ValueError("wrong password, or the vault was changed") from e


def save_vault(tokens: dict, path: str, password: str, rounds: int = ITERATIONS) -> None:
    """Only the owner can read the file, from its first byte on."""
    blob = encrypt_vault(tokens, password, rounds)
    with os.fdopen(os.open(path, os.O_CREAT | os.O_TRUNC | os.O_WRONLY, 0o600), "wb") as f:
        f.write(blob)


def load_vault(name: str | os.PathLike, password: str) -> dict:
    return decrypt_vault(pathlib.Path(name).read_bytes(), password)


def sealed(vault: Column, key: Column) -> Column:
    """A vault column as AES-GCM bytes (key of 16, 24 or 32 bytes), for tables; ``unsealed`` reads it."""
    return F.aes_encrypt(F.to_json(vault).cast("binary"), key, F.lit("GCM"))


def unsealed(blob: Column, key: Column) -> Column:
    return F.from_json(F.aes_decrypt(blob, key, F.lit("GCM")).cast("string"), "map<string,string>")
