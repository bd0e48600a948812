"""Statistics of whole texts that the quality operators share. Empty texts have zeros throughout."""

from __future__ import annotations

import numpy as np

from .common import POWER_BASE, mixed, window_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
_not_letters = bytes(range(65))
_upper = bytes(range(65, 91))
_digits = b"0123456789"
_marks = b"!?"
_stops = b".!?"

#: What base_statistics() counts, in its order.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What more_statistics() adds.
MORE = ("n_chars", "n_lines", "n_upper", "n_digits", "n_marks", "n_stops", "n_pipes", "n_distinct", "n_non_ascii", "n_short", "n_long", "n_caps_words", "n_symbol_words", "n_shouted", "n_top", "n_distinct_bigrams")


def covered_by_repeats(hashes: np.ndarray, width: int) -> int:
    """Words in windows of `width` words that occur twice or more, the first occurrence included."""
    if len(hashes) < width + 1:
        return 0
    windows = window_hashes(hashes, width)
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    if counts.max() < 2:
        return 0
    starts = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def removed(data: bytes, what: bytes) -> int:
    return len(data) - len(data.translate(None, what))


def base_statistics(text: str, data: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    word_bytes = b"".join(words)
    word_chars = len(word_bytes) if len(text) == len(data) else len(word_bytes.decode())
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(words), word_chars, removed(word_bytes, SYMBOLS), len(lines) - len(set(lines)), covered_by_repeats(hashes, 8)


def more_statistics(text: str, data: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, ...]:
    n = len(words)
    if not n:
        return (len(text), *[0] * (len(MORE) - 1))
    lengths = np.fromiter(map(len, words), np.int64, n)
    _, counts = np.unique(hashes, return_counts=True)
    pairs = len(np.unique(mixed(hashes[:-1] * POWER_BASE + hashes[1:]))) if n > 1 else 0
    kinds = set(words)
    capitals = sum([1 for w in words if w[:1].isupper()])
    shouted = sum([1 for w in words if len(w) > 1 and w.isupper()])
    symbolic = {w for w in kinds if w.translate(None, SYMBOLS) != w}
    symbol_words = sum([1 for w in words if w in symbolic]) if symbolic else 0
    return (
        len(text), data.count(b"\n") + 1, removed(data, _upper), removed(data, _digits), removed(data, _marks), removed(data, _stops), data.count(b"|"), len(counts),
        len(data) - len(data.decode(errors="ignore").encode("ascii", "ignore")) if not data.isascii() else 0, int((lengths <= 3).sum()), int((lengths >= 12).sum()), capitals, symbol_words, shouted, int(counts.max()), pairs,
    )


def statistics(text: str | None, more: bool = True) -> tuple[int, ...]:
    """BASE, and MORE if asked for, of one text; null counts as empty."""
    text = text or ""
    data = text.encode()
    words, hashes = data.split(), word_hashes(data, lower=False)
    base = base_statistics(text, data, words, hashes)
    return base + more_statistics(text, data, words, hashes) if more else base
