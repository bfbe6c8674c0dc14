"""Byte-pair encoding and decoding, and token counts, with merges in batched numpy rounds.

Method. The symbols of many different words lie in one flat array. A round looks up every neighbouring pair by binary
search over the sorted pair keys, takes each word's lowest rank, and applies that pair everywhere in its word at once
(left to right where occurrences overlap). Words without a mergeable pair leave the array. Rounds end when none is left.
A word of more than LONG symbols would need as many rounds as it has ranks, each over all of it: its pairs are kept by
rank instead, and a step takes all places of its lowest rank and looks up only the pairs that change, so that a pasted
run of a million letters costs time nearly in proportion.

Defined results: a null text counts as empty; an empty text has no tokens; special strings inside a text are single
tokens, as in the library's default; an input column named as an output is replaced. Repeated words cost one lookup: a
task keeps the words it has met, up to a bound.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_text_columns

#: The patterns by which the two vocabularies split text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bits that a symbol takes in a pair key, and the words and symbols that a task keeps at most.
SHIFT, KEEP_WORDS, KEEP_SYMBOLS = 20, 250_000, 2_500_000
#: Symbols of a word from which on its pairs are kept by rank.
LONG = 256


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next free code point from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = [], 256
    for b in range(256):
        letters.append(chr(b) if b in printable else chr(free))
        free += b not in printable
    return letters


class Vocabulary:
    """Merge ranks of a tokenizer file as sorted arrays, and how it splits text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = []
        for rank, (a, b) in enumerate(model["merges"]):
            pairs.append((vocab[a] << SHIFT | vocab[b], rank, vocab[a + b]))
        pairs.sort()
        self.keys, self.ranks, self.made = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        self.special = special
        size = max([*vocab.values(), *special.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = t
        self.pattern = WORD_PATTERN if suffix else BYTE_PATTERN
        self.lower = bool(suffix)
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer


class Splitter:
    """Cuts texts into pre-tokens; special strings become their token id, an int.

    Latin-1 texts go through one compiled pattern. For others the library's own normaliser and splitter are asked,
    since their Unicode tables may be older or newer than ours.
    """

    def __init__(self, voc: Vocabulary):
        self.voc = voc
        self.find = regex.compile(voc.pattern).findall
        self.parts = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(voc.special, key=len, reverse=True)) + ")").split if voc.special else None
        self.back = {c: b for b, c in enumerate(byte_letters())}
        self.marks = tuple(voc.special)

    def piece(self, text: str) -> list:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.voc.normalizer is not None:
                text = self.voc.normalizer.normalize_str(text)
            back = self.back
            return [bytes(map(back.__getitem__, w)).decode("utf-8") for w, _ in self.voc.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text.lower() if self.voc.lower else text)

    def __call__(self, text: str | None) -> list:
        if not text:
            return []
        if not any(m in text for m in self.marks):
            return self.piece(text)
        out: list = []
        for part in self.parts(text):
            if part in self.voc.special:
                out.append(self.voc.special[part])
            elif part:
                out += self.piece(part)
        return out


NONE = np.iinfo(np.int64).max


def looked_up(left: np.ndarray, right: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs among the sorted pair keys, and their ranks (NONE for pairs that never merge)."""
    key = left << SHIFT | right
    at = np.minimum(np.searchsorted(voc.keys, key), len(voc.keys) - 1)
    return at, np.where(voc.keys[at] == key, voc.ranks[at], NONE)


def alternate(here: np.ndarray, overlaps: np.ndarray) -> np.ndarray:
    """Of sorted places, every second one of each run of places that overlap the one before, from the run's first."""
    index = np.arange(len(here))
    run = np.maximum.accumulate(np.where(overlaps, 0, index))
    return here[(index - run) % 2 == 0]


def merged_long(symbols: np.ndarray, voc: Vocabulary) -> np.ndarray:
    """The symbols of one long word after all merges."""
    n = len(symbols)
    symbols = symbols.copy()
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # the neighbours of each symbol that is left; n and -1: none
    rank_at, made_at = np.full(n, NONE), np.zeros(n, np.int64)
    places: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def put(at: np.ndarray) -> None:
        at = at[after[at] < n]
        key, rank = looked_up(symbols[at], symbols[after[at]], voc)
        rank_at[at], made_at[at] = rank, voc.made[key]
        at, rank = at[rank != NONE], rank[rank != NONE]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        starts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else np.zeros(0, np.int64)
        for r, group in zip(rank[starts].tolist(), np.split(at, starts[1:]) if len(at) else [], strict=True):
            if r not in places:
                places[r] = []
                heapq.heappush(queue, r)
            places[r].append(group)

    put(np.arange(n - 1))
    while queue:
        r = heapq.heappop(queue)
        here = np.unique(np.concatenate(places.pop(r)))
        here = here[rank_at[here] == r]
        if not len(here):
            continue
        here = alternate(here, np.r_[False, after[here[:-1]] == here[1:]])
        gone = after[here]
        symbols[here] = made_at[here]
        after[here] = after[gone]
        inner = here[after[here] < n]
        before[after[inner]] = inner
        rank_at[gone], after[gone] = NONE, n
        rank_at[here] = NONE
        left = before[here]
        symbols[gone] = -1
        put(np.unique(np.concatenate([here, left[left >= 0]])))
    return symbols[symbols >= 0]


def merged(symbols: np.ndarray, lengths: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of each word after all merges, flat, and their number by word. Every length is 1 or more."""
    if (lengths > LONG).any():
        ends = np.cumsum(lengths)
        long = lengths > LONG
        parts: list[np.ndarray] = [None] * len(lengths)
        for i in np.flatnonzero(long):
            parts[i] = merged_long(symbols[ends[i] - lengths[i] : ends[i]], voc)
        flat, counts = merged(symbols[np.repeat(~long, lengths)], lengths[~long], voc)
        for i, part in zip(np.flatnonzero(~long), np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else [], strict=True):
            parts[i] = part
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
    count = len(lengths)
    word = np.repeat(np.arange(count), lengths)
    done_symbols, done_words = [], []
    at, rank = np.zeros(len(symbols), np.int64), np.full(len(symbols), NONE)  # of the pair that begins at each symbol
    symbols, changed = symbols.copy(), np.flatnonzero(word[1:] == word[:-1])
    while len(symbols):
        at[changed], rank[changed] = looked_up(symbols[changed], symbols[changed + 1], voc)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        per_symbol = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbols)]))
        keep = per_symbol != NONE
        if not keep.all():
            done_symbols.append(symbols[~keep])
            done_words.append(word[~keep])
        here = np.flatnonzero((rank == per_symbol) & keep)
        if not len(here):
            break
        here = alternate(here, np.r_[False, here[1:] == here[:-1] + 1])
        symbols[here] = voc.made[at[here]]
        keep[here + 1] = False
        fresh = np.zeros(len(symbols), bool)  # pairs that have a merged symbol: they are looked up again
        fresh[here] = True
        symbols, word, at, rank, fresh = symbols[keep], word[keep], at[keep], rank[keep], fresh[keep]
        fresh[:-1] |= fresh[1:]
        rank[fresh] = NONE
        changed = np.flatnonzero(fresh[:-1] & (word[1:] == word[:-1]))
    flat = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
    owner = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
    return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=count)


class WordTable(dict):
    """Pre-token -> row; rows hold the symbols of the words met so far."""

    def __init__(self, voc: Vocabulary):
        super().__init__()
        self.voc = voc
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        marks = list(self.voc.special.values())
        for i, m in enumerate(marks):
            self[m] = i
        self.flat = np.array(marks, dtype=np.int64)
        self.lengths = np.ones(len(marks), dtype=np.int64)
        self.starts = np.arange(len(marks), dtype=np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row

    def rows(self, words: list) -> np.ndarray:
        if len(self) > KEEP_WORDS or len(self.flat) > KEEP_SYMBOLS:
            self.reset()
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            coded = [w.encode("utf-8") for w in self.new]
            lengths = np.fromiter(map(len, coded), np.int64, len(coded))
            raw = np.frombuffer(b"".join(coded), np.uint8)
            symbols = self.voc.inner[raw]
            ends = np.cumsum(lengths) - 1
            symbols[ends] = self.voc.last[raw[ends]]
            flat, lengths = merged(symbols, lengths, self.voc)
            self.lengths = np.append(self.lengths, lengths)
            self.flat = np.append(self.flat, flat)
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.new = []
        return out


def split_all(splitter: Splitter, texts: list) -> tuple[list, np.ndarray]:
    words: list = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        got = splitter(t)
        counts[i] = len(got)
        words += got
    return words, counts


def summed(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of counts[i] values."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def decoder(voc: Vocabulary):
    """The text of an array of ids: with word ends the tokens one blank apart (such a vocabulary has no decoder of its own), else their bytes."""
    tokens, spaced = voc.tokens, voc.lower
    back = {c: b for b, c in enumerate(byte_letters())}

    def one(ids: np.ndarray) -> str:
        got = map(tokens.__getitem__, ids.tolist())
        if spaced:
            return " ".join(got)
        return bytes(back[c] for c in "".join(got)).decode("utf-8", errors="replace")

    return one


def encode(df: DataFrame, vocabulary: str, column: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """df (its columns keep) with token_ids (binary: ids as little-endian unsigned 32-bit integers) and n_tokens.

    decoded: also with that column, as decode() gives it, from the same pass, so that no second worker holds a vocabulary.
    """
    voc = Vocabulary(vocabulary)

    def make():
        splitter, words = Splitter(voc), WordTable(voc)
        text_of = decoder(voc) if decoded else None

        def work(texts: list) -> dict:
            found, counts = split_all(splitter, texts)
            rows = words.rows(found)
            lengths = words.lengths[rows]
            shift = np.cumsum(lengths) - lengths
            ids = words.flat[np.repeat(words.starts[rows] - shift, lengths) + np.arange(int(lengths.sum()))].astype("<u4")
            n = summed(lengths, counts)
            each = [ids[e - k : e] for e, k in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)]
            return {"token_ids": [x.tobytes() for x in each], "n_tokens": n} | ({"decoded": list(map(text_of, each))} if decoded else {})

        return work

    fields = [T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())] + [T.StructField("decoded", T.StringType())] * decoded
    return with_text_columns(df, fields, make, column, keep)


def decode(df: DataFrame, vocabulary: str, column: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """df (its columns keep) with decoded: the tokens of its ids, special ones included. Null ids decode to the empty string."""
    voc = Vocabulary(vocabulary)

    def make():
        text_of = decoder(voc)
        return lambda values: {"decoded": [text_of(np.frombuffer(v or b"", "<u4")) for v in values]}

    return with_text_columns(df, [T.StructField("decoded", T.StringType())], make, column, keep)


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 512, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (its columns keep) with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Counts only: the surviving symbols of each different pre-token, summed over the pre-tokens of a text.
    """
    voc = Vocabulary(vocabulary)

    def make():
        splitter, words = Splitter(voc), WordTable(voc)

        def work(texts: list) -> dict:
            found, counts = split_all(splitter, texts)
            rows = words.rows(found)
            n = summed(words.lengths[rows], counts)
            return {"n_bytes": [len((t or "").encode("utf-8")) for t in texts], "n_tokens": n, "over_limit": n > limit}

        return work

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return with_text_columns(df, fields, make, column, keep)
