"""Whole columns of text as byte arrays, for vectorised work in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in pieces of about so many bytes; a longer text is cut
#: at blanks, so memory does not grow with the length of a text.
PIECE = 1 << 20
# Characters that have no width, the soft hyphen and the byte-order mark.
NO_WIDTH = dict.fromkeys([0x00AD, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF])
_CODE = re.compile(r"\\+(?:u\{?([0-9a-fA-F]{4,6})\}?|x([0-9a-fA-F]{2}))")
_BLANK = re.compile(rb"[ \n\t\r]")


def _decoded(m: re.Match) -> str:
    code = int(m.group(1) or m.group(2), 16)
    return " " if code < 32 or 0xD800 <= code < 0xE000 or code > 0x10FFFF else chr(code)


def readable(raw: bytes) -> str:
    """Text of bytes in any state: bad bytes replaced, character escapes decoded,
    compatibility forms unified and characters without width removed."""
    text = _CODE.sub(_decoded, raw.decode("utf-8", "replace"))
    return unicodedata.normalize("NFKC", text).translate(NO_WIDTH)


def pieces(batch: pa.RecordBatch, text: str, slow: Callable[[bytes], bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield ``(data, starts, ends, rows)`` of about PIECE bytes each.

    ``data`` is a uint8 array that holds the texts of the batch's ``rows``
    between ``starts`` and ``ends``. Texts with bytes beyond ASCII or with
    character escapes are passed through ``slow`` first. A row occurs several
    times in a row, in order, when its text is long; null texts do not occur.
    Escapes of line breaks and tabs are blanked.
    """
    col = batch.column(batch.schema.get_field_index(text))
    col = col.cast(pa.large_binary())
    buffers = col.buffers()
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    offsets = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    lengths = np.diff(offsets)
    i, n = 0, len(col)
    while i < n:
        j, size = i, 0
        while j < n and (j == i or size + lengths[j] <= PIECE):
            size += int(lengths[j])
            j += 1
        base = int(offsets[i])
        if size <= 2 * PIECE:
            chunks = [(data[base : base + size], offsets[i : j + 1] - base, np.arange(i, j))]
        else:  # one long text
            chunks = [(part, np.array([0, len(part)]), np.array([i])) for part in _cut(data[base : base + size])]
        for part, off, rows in chunks:
            yield _prepared(part, off, rows, slow)
        i = j


def _cut(data: np.ndarray) -> Iterator[np.ndarray]:
    raw, at = data.tobytes(), 0
    while at < len(raw):
        m = _BLANK.search(raw, at + PIECE) if at + PIECE < len(raw) else None
        end = m.end() if m else len(raw)
        yield data[at:end]
        at = end


def _prepared(part: np.ndarray, off: np.ndarray, rows: np.ndarray, slow: Callable[[bytes], bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    back = np.flatnonzero(part == 0x5C)
    back = back[back + 1 < len(part)]
    after = part[back + 1]
    odd = np.concatenate([np.flatnonzero(part >= 0x80), back[(after == 0x75) | (after == 0x78)]])
    if len(odd):
        touched = np.unique(np.searchsorted(off, odd, "right") - 1)
        texts, last, raw = [], 0, part.tobytes()
        lengths = np.diff(off).copy()
        for k in touched:
            a, b = int(off[k]), int(off[k + 1])
            new = slow(raw[a:b])
            texts += [raw[last:a], new]
            lengths[k], last = len(new), b
        texts.append(raw[last:])
        part = np.frombuffer(b"".join(texts), np.uint8)
        off = np.concatenate([[0], np.cumsum(lengths)])
        back = np.flatnonzero(part == 0x5C)
        back = back[back + 1 < len(part)]
        after = part[back + 1]
    breaks = back[(after == 0x6E) | (after == 0x72) | (after == 0x74)]
    if len(breaks):
        part = part.copy()
        part[breaks + 1] = 0x20
    return part, off[:-1], off[1:], rows
