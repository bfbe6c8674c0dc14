"""Statistics of whole texts, in numpy over batches of documents.

Words are maximal runs without blank, tab, line feed, vertical tab, form feed and carriage return. A null text counts as empty.
"""

from __future__ import annotations

import numpy as np

#: Fixed values.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8

SYMBOL_BYTES, BLANK_BYTES = (np.array([ord(c) for c in s]) for s in (SYMBOLS, BLANKS))

#: What quality() gives for each text, in this order.
QUALITY = ["n_words", "n_chars", "word_len", "symbols", "upper", "digits", "commas", "stops", "shouts", "pipes", "braces", "quotes", "accents", "dup_lines", "repeats", "distinct", "line_words", "title_words", "long_words", "top_word"]


def words_of(text: str | None) -> list[bytes]:
    """The words as UTF-8; bytes.split() cuts at just the six blanks."""
    return (text or "").encode("utf-8").split()


class Codes(dict):
    """Numbers for words, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def coded(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All words as numbers, flat, and the number of words of each list."""
    codes = Codes()
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((codes[w] for ws in lists for w in ws), np.int64, int(counts.sum()))
    return flat, counts


def ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64).reshape(-1)


def repeated_words(flat: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text, its words that lie in a window of this many words found twice or more in the same text.

    window is a power of two: names of windows double from one word up, so equal names are equal words.
    """
    n = len(flat)
    out = np.zeros(len(counts), np.int64)
    if not n:
        return out
    doc = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words from here to the text's end
    name, width = flat, 1
    while width < window:
        fit = np.flatnonzero(left >= 2 * width)
        if not len(fit):
            return out
        key = name[fit] * np.int64(name.max() + 2) + name[fit + width] + 1
        name = np.full(n, -1, np.int64)
        name[fit] = ranks(key)
        width *= 2
    starts = np.flatnonzero(left >= window)
    _, which, times = np.unique(name[starts] * np.int64(len(counts)) + doc[starts], return_inverse=True, return_counts=True)
    starts = starts[times[which.reshape(-1)] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=len(counts))


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines), len(lines) - len(set(lines))


def letters(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256)


def base(texts: list[str | None]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raws = [(t or "").encode("utf-8") for t in texts]
    lists = [r.split() for r in raws]
    flat, counts = coded(lists)
    tally = np.array([letters(r) for r in raws]).reshape(len(raws), 256)
    points = np.array([len(t or "") for t in texts], dtype=np.int64)
    return {
        "n_words": counts,
        "word_chars": points - tally[:, BLANK_BYTES].sum(axis=1),
        "n_symbols": tally[:, SYMBOL_BYTES].sum(axis=1),
        "n_dup_lines": np.array([duplicate_lines(t or "")[1] for t in texts], dtype=np.int64),
        "n_repeat_words": repeated_words(flat, counts),
    }


def quality(texts: list[str | None]) -> np.ndarray:
    """A row of QUALITY for each text: shares of characters, words and lines, and sizes as logarithms."""
    raws = [(t or "").encode("utf-8") for t in texts]
    lists = [r.split() for r in raws]
    flat, counts = coded(lists)
    tally = np.array([letters(r) for r in raws], dtype=np.float64).reshape(len(raws), 256)
    chars = np.maximum(np.array([len(t or "") for t in texts], dtype=np.float64), 1)
    words = np.maximum(counts, 1)
    share = lambda s: tally[:, [ord(c) for c in s]].sum(axis=1) / chars
    lines = np.array([duplicate_lines(t or "") for t in texts], dtype=np.float64).reshape(len(texts), 2)
    many = np.maximum(lines[:, 0], 1)
    distinct = np.array([len(set(w)) for w in lists]) / words
    doc = np.repeat(np.arange(len(counts)), counts)
    size = np.fromiter((len(w) for ws in lists for w in ws), np.int64, int(counts.sum()))
    first = np.fromiter((w[0] for ws in lists for w in ws), np.int64, int(counts.sum()))
    per = lambda flag: np.bincount(doc[flag], minlength=len(counts)) / words
    top = np.zeros(len(counts))
    if len(flat):
        pair, times = np.unique(doc * np.int64(flat.max() + 1) + flat, return_counts=True)
        np.maximum.at(top, pair // np.int64(flat.max() + 1), times)
    return np.column_stack([
        np.log1p(counts), np.log1p(chars), (chars - tally[:, BLANK_BYTES].sum(axis=1)) / words, share(SYMBOLS),
        tally[:, 65:91].sum(axis=1) / chars, tally[:, 48:58].sum(axis=1) / chars, share(",;:"), share("."), share("!?"), share("|"), share("{}[]()<>"), share("\"'"),
        tally[:, 128:].sum(axis=1) / chars, lines[:, 1] / many, repeated_words(flat, counts) / words, distinct, np.log1p(counts / many),
        per((first >= 65) & (first <= 90)), per(size > 12), top / words,
    ]).reshape(len(texts), len(QUALITY))
