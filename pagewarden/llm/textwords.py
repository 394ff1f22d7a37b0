"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = np.frombuffer(bytes(range(65, 91)), np.uint8)
#: The six ASCII white-space characters.
WHITE = b" \t\n\x0b\x0c\r"
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Bytes of text that are worked on at once, if no single text is longer.
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_table(separators: bytes = WHITE) -> np.ndarray:
    """For each byte: a space if it separates words, else the byte with A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[_LETTERS] += 32
    table[np.frombuffer(separators, np.uint8)] = 32
    return table


@dataclass
class Words:
    """raw: all bytes; folded: the same through a byte table; for each word its first byte, the byte behind it, its text and its hash."""

    raw: np.ndarray
    folded: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    counts: np.ndarray
    first_byte: np.ndarray


def lowered(text: bytes) -> bytes:
    """The text in lower case, each character in as many bytes as before (or left as it is)."""
    if text.isascii():
        return text.lower()
    low = text.decode(errors="replace").lower().encode()
    if len(low) == len(text):
        return low
    return "".join(x if len((x := c.lower()).encode()) == len(c.encode()) else c for c in text.decode(errors="surrogateescape")).encode(errors="surrogateescape")


def split_words(texts: list[bytes], table: np.ndarray, fold=None) -> Words:
    """fold, if given, is applied to each text ahead of the byte table; it must keep the number of bytes."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.cumsum(sizes) - sizes
    folded = table[raw if fold is None else np.frombuffer(b"\n".join([*map(fold, texts), b""]), np.uint8)]
    inside = np.concatenate([[False], folded != 32, [False]])
    if len(raw):
        inside[1 + first + sizes - 1] = False  # the byte between two texts
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    text = np.searchsorted(first, start, "right") - 1
    return Words(raw, folded, start, end, text, hash_spans(folded, start, end), np.bincount(text, minlength=len(texts)), first)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], eight bytes at a time; spans of over 256 bytes one by one."""
    size = end - start
    out = mix(size.astype(np.uint64) + _BASE)
    if not len(start):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    left, at, which = size.astype(np.int64), start.astype(np.int64), np.arange(len(start))
    long = np.flatnonzero(size > 256)
    if len(long):
        for k in long.tolist():
            out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
        keep = size <= 256
        left, at, which = left[keep], at[keep], which[keep]
    while len(which):
        value = eight[at]
        part = left < 8
        value[part] &= (np.uint64(1) << (left[part].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[which] = mix(out[which] ^ value)
        more = left > 8
        left, at, which = left[more] - 8, at[more] + 8, which[more]
    return out


def windows(codes: np.ndarray, text: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of each run of width words in a text, or of all its words if it has fewer."""
    n = len(codes) - width + 1
    if n > 0:
        at = np.flatnonzero(text[:n] == text[width - 1 :])
        h = np.zeros(len(at), np.uint64)
        for k in range(width):
            h = h * _BASE + codes[at + k]
        h = mix(h + np.uint64(width))
    else:
        at, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begin = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] = extra[has] * _BASE + codes[begin[short[has]] + k]
        extra = mix(extra + counts[short].astype(np.uint64))
        at, h = np.concatenate([at, begin[short]]), np.concatenate([h, extra])
        order = np.argsort(at, kind="stable")
        at, h = at[order], h[order]
    return h, text[at], at


def chunks(texts: list[bytes], size: int = CHUNK):
    """Consecutive texts as (first index, texts) with about size bytes together."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield begin, texts[begin:i]
            begin, held = i, 0
        held += len(t) + 1
    if begin < len(texts):
        yield begin, texts[begin:]
