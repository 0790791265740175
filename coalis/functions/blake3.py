"""BLAKE3 key derivation over batches of messages, vectorised with numpy.

Written from the published BLAKE3 specification.  A batch of messages of up to one chunk
(1,024 bytes) is compressed block by block for all messages at once; longer messages hash
their chunks in the same way and then fold the tree of chaining values.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Initial words, message permutation and domain flags of BLAKE3.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
DERIVE_KEY_CONTEXT, DERIVE_KEY_MATERIAL = 32, 64

_MIXES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(values: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values (8, n) from values (8, n), message words (16, n) and per-message counter, length and flags."""
    n = values.shape[1]
    s = np.empty((16, n), np.uint32)
    s[:8] = values
    s[8:12] = IV[:4, None]
    s[12] = (counter & 0xFFFFFFFF).astype(np.uint32)
    s[13] = (counter >> 32).astype(np.uint32)
    s[14], s[15] = length, flags
    order = list(range(16))
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_MIXES):
            for word, (r1, r2) in ((words[order[2 * k]], (16, 12)), (words[order[2 * k + 1]], (8, 7))):
                s[a] += s[b] + word
                s[d] = _turn(s[d] ^ s[a], r1)
                s[c] += s[d]
                s[b] = _turn(s[b] ^ s[c], r2)
        order = [order[p] for p in PERMUTATION]
    return s[:8] ^ s[8:]


def _chunks(data: list[bytes], counters: np.ndarray, key: np.ndarray, flags: int, root: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) of single chunks; ``root`` marks chunks that are whole messages."""
    n = len(data)
    sizes = np.fromiter(map(len, data), np.int64, n)
    blocks = np.maximum((sizes + 63) // 64, 1)
    values = np.repeat(key[:, None], n, axis=1)
    for block in range(int(blocks.max(initial=0))):
        rows = np.flatnonzero(blocks > block)
        parts = b"".join(data[i][64 * block : 64 * block + 64].ljust(64, b"\0") for i in rows.tolist())
        words = np.frombuffer(parts, "<u4").reshape(len(rows), 16).T.astype(np.uint32)
        last = blocks[rows] == block + 1
        length = np.where(last, sizes[rows] - 64 * block, 64).astype(np.uint32)
        flag = flags | np.where(block == 0, CHUNK_START, 0) | np.where(last, CHUNK_END, 0) | np.where(last & root[rows], ROOT, 0)
        values[:, rows] = compress(values[:, rows], words, counters[rows], length, flag.astype(np.uint32))
    return values


def _fold(values: np.ndarray, key: np.ndarray, flags: int) -> np.ndarray:
    """The root value (8, 1) of one message's chunk values (8, chunks)."""
    while values.shape[1] > 1:
        pairs = values.shape[1] // 2
        left, right, rest = values[:, 0 : 2 * pairs : 2], values[:, 1 : 2 * pairs : 2], values[:, 2 * pairs :]
        top = ROOT if values.shape[1] == 2 else 0
        zero = np.zeros(pairs, np.int64)
        parents = compress(np.repeat(key[:, None], pairs, axis=1), np.concatenate([left, right]), zero, np.full(pairs, 64, np.uint32), np.full(pairs, flags | PARENT | top, np.uint32))
        values = np.concatenate([parents, rest], axis=1)
    return values


def digests(data: list[bytes], key: np.ndarray, flags: int) -> list[bytes]:
    """32-byte digests of whole messages."""
    owner, counters, parts = [], [], []
    for i, message in enumerate(data):
        for c in range(max((len(message) + 1023) // 1024, 1)):
            owner.append(i)
            counters.append(c)
            parts.append(message[1024 * c : 1024 * c + 1024])
    if not parts:
        return []
    owner = np.array(owner)
    many = np.bincount(owner, minlength=len(data)) > 1
    values = _chunks(parts, np.array(counters, np.int64), key, flags, ~many[owner])
    out = np.empty((8, len(data)), np.uint32)
    single = ~many[owner]
    out[:, owner[single]] = values[:, single]
    for i in np.flatnonzero(many).tolist():
        out[:, i : i + 1] = _fold(values[:, owner == i], key, flags)
    raw = out.T.astype("<u4").tobytes()
    return [raw[32 * i : 32 * i + 32] for i in range(len(data))]


@lru_cache(16)
def context_key(context: str) -> bytes:
    return digests([context.encode()], IV, DERIVE_KEY_CONTEXT)[0]


def derive_keys(context: str, messages: list[bytes]) -> list[bytes]:
    """BLAKE3 derive-key digests of ``messages`` under ``context``."""
    return digests(messages, np.frombuffer(context_key(context), "<u4").astype(np.uint32), DERIVE_KEY_MATERIAL)
