"""AES in cipher block chaining, for encrypted PDF files inside workers: blocks are decrypted side by side. Columns use Spark's own functions."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The substitution of bytes and its inverse, by inversion in the field of 256 elements, and products with the columns' factors."""
    exp, x = [0] * 512, 1
    log = [0] * 256
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF if x < 256 else 0x1FF
    box = []
    for v in range(256):
        inv = exp[255 - log[v]] if v else 0
        y = 0
        for k in range(5):
            y ^= (inv << k | inv >> (8 - k)) & 0xFF
        box.append(y ^ 0x63)
    forward = np.array(box, np.uint8)
    back = np.zeros(256, np.uint8)
    back[forward] = np.arange(256)
    times = {k: np.array([exp[log[v] + log[k]] if v else 0 for v in range(256)], np.uint8) for k in (1, 2, 3, 9, 11, 13, 14)}
    return forward, back, times


@cache
def _round_keys(key: bytes) -> np.ndarray:
    forward = _tables()[0]
    n, words, rcon = len(key) // 4, [key[i : i + 4] for i in range(0, len(key), 4)], 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = bytes(forward[b] for b in w[1:] + w[:1])
            w = bytes([w[0] ^ rcon]) + w[1:]
            rcon = rcon << 1 ^ (0x11B if rcon & 0x80 else 0)
        elif n > 6 and i % n == 4:
            w = bytes(forward[b] for b in w)
        words.append(bytes(a ^ b for a, b in zip(w, words[i - n], strict=True)))
    return np.frombuffer(b"".join(words), np.uint8).reshape(-1, 16)


_BACK = np.array([(i - 4 * (i % 4)) % 16 for i in range(16)])
_AHEAD = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])


def _mixed(s: np.ndarray, factors: tuple[int, int, int, int]) -> np.ndarray:
    times, c = _tables()[2], s.reshape(-1, 4, 4)
    out = [times[factors[0]][c[..., i]] ^ times[factors[1]][c[..., (i + 1) % 4]] ^ times[factors[2]][c[..., (i + 2) % 4]] ^ times[factors[3]][c[..., (i + 3) % 4]] for i in range(4)]
    return np.stack(out, -1).reshape(-1, 16)


def decrypt_blocks(key: bytes, blocks: np.ndarray) -> np.ndarray:
    """Blocks (n, 16) without chaining."""
    keys, back = _round_keys(key), _tables()[1]
    s = blocks ^ keys[-1]
    for i in range(len(keys) - 2, -1, -1):
        s = back[s[:, _BACK]] ^ keys[i]
        if i:
            s = _mixed(s, (14, 11, 13, 9))
    return s


def encrypt_blocks(key: bytes, blocks: np.ndarray) -> np.ndarray:
    keys, forward = _round_keys(key), _tables()[0]
    s = blocks ^ keys[0]
    for i in range(1, len(keys)):
        s = forward[s][:, _AHEAD]
        if i < len(keys) - 1:
            s = _mixed(s, (2, 3, 1, 1))
        s = s ^ keys[i]
    return s


def raw_cbc(key: bytes, start: bytes, data: bytes, decrypt: bool = True) -> bytes:
    """Whole blocks of data chained from `start`, without padding."""
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    if decrypt:
        before = np.concatenate([np.frombuffer(start, np.uint8)[None], blocks[:-1]]) if len(blocks) else blocks
        return (decrypt_blocks(key, blocks) ^ before).tobytes()
    return _chained(key, start, data[: len(data) // 16 * 16])


@cache
def _words() -> tuple[list[int], ...]:
    """For each place in a column, what a byte adds to the mixed column."""
    forward, _, times = _tables()
    two, three = times[2][forward].tolist(), times[3][forward].tolist()
    one = forward.tolist()
    first = [two[v] << 24 | one[v] << 16 | one[v] << 8 | three[v] for v in range(256)]
    turned = lambda n: [(x >> 8 * n | x << 32 - 8 * n) & 0xFFFFFFFF for x in first]
    return first, turned(1), turned(2), turned(3)


def _chained(key: bytes, start: bytes, data: bytes) -> bytes:
    """Encryption, in which each block waits for the one before: by words."""
    t0, t1, t2, t3 = _words()
    box = _tables()[0].tolist()
    keys = [[int.from_bytes(k[i : i + 4].tobytes(), "big") for i in (0, 4, 8, 12)] for k in _round_keys(key)]
    out, s = [], [int.from_bytes(start[i : i + 4], "big") for i in (0, 4, 8, 12)]
    for at in range(0, len(data), 16):
        s = [x ^ int.from_bytes(data[at + i : at + i + 4], "big") ^ k for x, i, k in zip(s, (0, 4, 8, 12), keys[0], strict=True)]
        for k in keys[1:-1]:
            a, b, c, d = s
            s = [
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k[0], t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k[1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k[2], t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k[3],
            ]
        s = [(box[s[i] >> 24] << 24 | box[s[(i + 1) % 4] >> 16 & 255] << 16 | box[s[(i + 2) % 4] >> 8 & 255] << 8 | box[s[(i + 3) % 4] & 255]) ^ keys[-1][i] for i in range(4)]
        out.append(b"".join(x.to_bytes(4, "big") for x in s))
    return b"".join(out)


def unpadded(data: bytes) -> bytes:
    """data without its padding, if that is whole."""
    n = data[-1] if data else 0
    return data[:-n] if 1 <= n <= 16 and data.endswith(bytes([n]) * n) else data


def decrypt_cbc(key: bytes, data: bytes) -> bytes:
    """data begins with its initial vector; the padding goes if it is whole."""
    return unpadded(raw_cbc(key, data[:16], data[16:])) if len(data) >= 32 else b""


def encrypt_cbc(key: bytes, start: bytes, data: bytes) -> bytes:
    """The initial vector, then data with padding."""
    n = 16 - len(data) % 16
    return start + raw_cbc(key, start, data + bytes([n]) * n, False)


def hash_r6(password: bytes, salt: bytes, more: bytes = b"") -> bytes:
    """The hash of revision 6: rounds of SHA-2 over what AES makes of the password and the hash so far."""
    k, i, last = hashlib.sha256(password + salt + more).digest(), 0, 0
    while i < 64 or last > i - 32:
        e = raw_cbc(k[:16], k[16:32], (password + k + more) * 64, False)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        last, i = e[-1], i + 1
    return k[:32]


def file_key(entries: dict, password: bytes, revision: int) -> bytes | None:
    """The key of an encrypted file of revision 5 or 6 by its user's or owner's password; None if it is neither."""
    password = password[:127]
    u, o = entries["U"][:48], entries["O"][:48]
    plain = lambda p, salt, more=b"": hashlib.sha256(p + salt + more).digest()
    for digest in (hash_r6, plain) if revision >= 6 else (plain,):
        for stored, wrapped, more in ((u, entries["UE"], b""), (o, entries["OE"], u)):
            if digest(password, stored[32:40], more) == stored[:32]:
                return raw_cbc(digest(password, stored[40:48], more), bytes(16), wrapped[:32])
    return None
