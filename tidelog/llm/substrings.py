"""Substring dedup: runs of 50 or more words that an earlier document holds are cut, by prefix-partitioned suffix trees.

Method. A suffix tree over all texts has a node of depth 50 or more for every run of 50 words that occurs twice; the
smallest document under the node keeps the run. The tree is built in parts:
  copies    of texts with equal words the smallest doc_id stands for all;
  anchor    a window of 50 words is entered under its smallest 8-word gram (by hash), read from the gram on. Equal windows
            agree in it, so the gram is the first label of the partition, a prefix of 8 words. Entering each window under
            its own first words would ship 50 words for each word; windows in a row with one gram travel as one segment,
            about two words for each window;
  prune     grams that only one document has are no repeats; counts decide before any word is shipped;
  prefixes  equal segments collapse to one with its smallest and largest doc_id. Groups that hold more than GROUP_WORDS
            words get longer prefixes, all others stay: 16 words from the anchor, then 25, then all 50. A window with 25
            words from its anchor on is read forwards, another backwards from the anchor's end, so all of them have a
            prefix of that length. What a longer prefix leaves to a single document is dropped;
  subtrees  a task takes whole groups up to a bounded number of words, sorts their suffixes (ranks of prefixes of 1, 2, 4
            ... 64 words) and takes the longest common prefixes of neighbours. A run of neighbours with 50 or more is an
            internal node of the suffix tree; the least of them is its depth, and its leaves know the smallest doc_id
            that has its words. The nodes below it are the deeper ones; those whose suffixes differ in the word before
            them are the maximal repeats, which repeats() returns. Prefixes of 50 words are such nodes already: a
            grouped minimum serves them.

Defined results: a null text counts as empty; texts under 50 words lose nothing; a null doc_id neither takes nor loses
words; rows with one doc_id are one document, so repeated rows lose nothing to each other; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, spread_join, stored, with_text_columns
from .textstats import coded, ranks

WINDOW, GRAM = 50, 8
#: Words that a group may bring to a subtree, and words that a task sorts at a time.
GROUP_WORDS, STEP = 200_000, 400_000
#: Lengths of the longer prefixes of crowded groups; the last but one is the half that any window has on one side of its anchor.
PREFIXES = (16, 25, WINDOW)
#: Ids that are broadcast at most, to read only the texts that are concerned.
IDS_MOST = 1_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxh64_intdigest(word)
        return h


def shifted(x: np.ndarray, by: int, fill: int) -> np.ndarray:
    out = np.full(len(x), fill, x.dtype)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """For each place, a hash of the GRAM words from there; of use where they fit."""
    gram, width = codes, 1
    while width < GRAM:
        gram = gram * ODD + shifted(gram, width, 0)
        gram ^= gram >> np.uint64(29)
        width *= 2
    return gram


def window_keys(codes: np.ndarray) -> np.ndarray:
    """For each place, the smallest gram hash of the window that starts there; of use where the window fits its text."""
    low, width, span = gram_hashes(codes), 1, WINDOW - GRAM + 1
    while 2 * width <= span:
        low = np.minimum(low, shifted(low, width, -1 % 2**64))
        width *= 2
    return np.minimum(low, shifted(low, span - width, -1 % 2**64))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id with n_words, sha (of the words joined by one blank), and keys, starts, ends of the runs of windows with one key."""

    def make():
        hashes = Hashes()

        def work(texts: list) -> dict:
            lists = [(t or "").encode("utf-8").split() for t in texts]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            total = int(counts.sum())
            codes = np.fromiter((hashes[w] for ws in lists for w in ws), np.uint64, total)
            ends = np.cumsum(counts)
            key = window_keys(codes).view(np.int64)
            keys, starts, stops = [], [], []
            for e, n in zip(ends.tolist(), counts.tolist(), strict=True):
                own = key[e - n : e - WINDOW + 1] if n >= WINDOW else key[:0]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
                keys.append(own[first])
                starts.append(first)
                stops.append(np.r_[first[1:], len(own)][: len(first)])
            return {"n_words": counts, "sha": [hashlib.sha256(b" ".join(w)).hexdigest() for w in lists], "keys": keys, "starts": starts, "ends": stops}

        return work

    longs = T.ArrayType(T.LongType())
    fields = [T.StructField("n_words", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("keys", longs), T.StructField("starts", longs), T.StructField("ends", longs)]
    return with_text_columns(docs, fields, make, keep=["doc_id"])


def suffix_nodes(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of all segments that hold a window: segment and place of each, in the order of their words, the number
    of its topmost node of depth WINDOW or more (those that share no window have one alone), the depths of these nodes, and
    the longest common prefixes of neighbours."""
    flat, counts = coded(lists)
    n = len(flat)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    longest = int(counts.max(initial=1))
    names, width = [flat], 1
    while 2 * width <= longest:  # a suffix that ends within the prefix comes first, as its missing words count as -1
        tail = np.full(n, -1, np.int64)
        fit = np.flatnonzero(left > width)
        tail[fit] = names[-1][fit + width]
        names.append(ranks(names[-1] * np.int64(int(names[-1].max()) + 2) + tail + 1))
        width *= 2
    starts = np.flatnonzero(left >= WINDOW)
    rest = np.full(len(starts), -1, np.int64)
    more = left[starts] > width
    rest[more] = names[-1][starts[more] + width]
    starts = starts[np.lexsort((rest, names[-1][starts]))]
    common = np.zeros(max(len(starts) - 1, 0), np.int64)  # of neighbours
    a, b = starts[:-1], starts[1:]
    for k in range(len(names) - 1, -1, -1):
        for _ in range(2 if k == len(names) - 1 else 1):
            at = np.minimum(left[a], left[b]) - common >= 1 << k
            same = at.copy()
            same[at] = names[k][(a + common)[at]] == names[k][(b + common)[at]]
            common[same] += 1 << k
    node = np.cumsum(np.r_[0, common < WINDOW]) if len(starts) else np.zeros(0, np.int64)
    depth = left[starts[np.flatnonzero(np.r_[True, node[1:] != node[:-1]])]] if len(starts) else node
    inner = node[1:] == node[:-1]
    np.minimum.at(depth, node[1:][inner], common[inner])
    segment = np.repeat(np.arange(len(counts)), counts)
    place = starts - (np.cumsum(counts) - counts)[segment[starts]]
    return segment[starts], place, node, depth, common


def deep_nodes(lists: list[list[bytes]], least: np.ndarray) -> list[np.ndarray]:
    """For each window of each segment, the smallest doc_id of the node of depth 50 or more under which its suffix stands."""
    segment, place, node, depth, _ = suffix_nodes(lists)
    low = np.full(len(depth), np.iinfo(np.int64).max)
    np.minimum.at(low, node, least[segment])
    order = np.lexsort((place, segment))
    return np.split(low[node[order]], np.cumsum(np.bincount(segment, minlength=len(lists)))[:-1])


def lowest(rows: pd.DataFrame) -> pd.DataFrame:
    found = deep_nodes([w.split(b" ") for w in rows["words"]], rows["least"].to_numpy())
    return pd.DataFrame({"seg": rows["seg"].to_numpy(), "at": 0, "lows": [x.tolist() for x in found]})


def internal_nodes(common: np.ndarray, leaves: list[tuple]) -> Iterator[tuple]:
    """(depth, least, most, left, place) of all internal nodes of depth WINDOW or more, from the longest common prefixes of
    neighbouring suffixes. leaves: (least, most, left, place) of each suffix, left being the word before it; a node's left
    is None if its suffixes differ in that. place: where one of them is."""

    def joined(a: tuple, b: tuple) -> tuple:
        return min(a[0], b[0]), max(a[1], b[1]), a[2] if a[2] == b[2] else None, a[3]

    stack: list[tuple[int, tuple]] = []
    for i, leaf in enumerate(leaves):
        depth, child = int(common[i]) if i < len(common) and common[i] >= WINDOW else 0, leaf
        while stack and stack[-1][0] > depth:
            top, node = stack.pop()
            child = joined(node, child)
            yield (top, *child)
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, joined(stack[-1][1], child))
        elif depth:
            stack.append((depth, child))


def maximal(rows: pd.DataFrame) -> pd.DataFrame:
    """The words of the internal nodes that two documents share and that no further word to the left would leave as frequent."""
    lists = [w.split(b" ") for w in rows["words"]]
    segment, place, _, _, common = suffix_nodes(lists)
    least, most = rows["least"].tolist(), rows["most"].tolist()
    # a segment's start is no word, so nothing to its left is common to others
    leaves = [(least[s], most[s], lists[s][p - 1] if p else None, (s, p)) for s, p in zip(segment.tolist(), place.tolist(), strict=True)]
    found = [(lists[s][p : p + depth], depth, a, b) for depth, a, b, left, (s, p) in internal_nodes(common, leaves) if left is None and a < b]
    single = [(w, len(w), a, b) for w, a, b in zip(lists, least, most, strict=True) if a < b]  # several documents hold the whole segment
    every = found + single
    words, sizes, lows, highs = zip(*every, strict=True) if every else ((), (), (), ())
    longs = {name: np.array(x, dtype=np.int64) for name, x in (("n_words", sizes), ("least", lows), ("most", highs))}
    return pd.DataFrame({"words": pd.Series([b" ".join(w) for w in words], dtype=object), **longs})


def by_group(done):
    """done() of whole groups. Rows come sorted by key; the last group of a step waits for the next."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            frame = frame.assign(size=frame["words"].map(lambda w: w.count(b" ") + 1))
            while len(frame):  # a batch may hold more than a step
                ends = frame["size"].cumsum().to_numpy() + size
                cut = int(np.searchsorted(ends, STEP)) + 1
                held.append(frame.iloc[:cut])
                size = int(ends[min(cut, len(frame)) - 1])
                frame = frame.iloc[cut:]
                if size >= STEP:
                    rows = pd.concat(held)
                    whole = (rows["key"] != rows["key"].iloc[-1]).to_numpy()
                    if whole.any():
                        yield done(rows[whole])
                    held = [rows[~whole]]
                    size = int(held[0]["size"].sum())
        if held and size:
            yield done(pd.concat(held))

    return work


def longer(prefix: int):
    """A function that cuts segments (seg, key, words) into pieces whose windows share a longer prefix."""

    def pieces(words: list[bytes], gram: int) -> Iterator[tuple[int, int, list[bytes]]]:
        """(first window, end of the windows, label)."""
        n = len(words) - WINDOW + 1
        if prefix == WINDOW:
            yield from ((i, i + 1, words[i : i + WINDOW]) for i in range(n))
            return
        from xxhash import xxh64_intdigest

        codes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
        spots = np.flatnonzero(gram_hashes(codes)[: len(words) - GRAM + 1].view(np.int64) == gram)
        anchor = spots[np.searchsorted(spots, np.arange(n))]  # the first in each window
        forward = np.arange(n) + WINDOW - anchor >= PREFIXES[-2]
        edges = [0, *(np.flatnonzero((anchor[1:] != anchor[:-1]) | (forward[1:] != forward[:-1])) + 1).tolist(), n]
        for lo, hi in zip(edges, edges[1:], strict=False):
            at = int(anchor[lo])
            yield lo, hi, words[at : at + prefix] if forward[lo] else [b"", *words[at + GRAM - prefix : at + GRAM]]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for f in frames:
            out = []
            for seg, gram, line, least, most in zip(f["seg"], f["gram"], f["words"], f["least"], f["most"], strict=True):
                words = line.split(b" ")
                for lo, hi, label in pieces(words, gram):
                    key = xxh64_intdigest(b" ".join(label), prefix)
                    out.append((seg, lo, gram, key - (1 << 64 if key >> 63 else 0), b" ".join(words[lo : hi - 1 + WINDOW]), hi - lo + WINDOW - 1, least, most))
            yield pd.DataFrame(out, columns=["parent", "place", "gram", "key", "words", "size", "least", "most"])

    return work


def cut_segments(rows: DataFrame) -> DataFrame:
    """(doc_id, sha, key, start, words, size): the words of each run of windows, and their number."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for d, sha, text, runs in zip(f["doc_id"], f["sha"], f["text"], f["runs"], strict=True):
                words = text.encode("utf-8").split()
                if hashlib.sha256(b" ".join(words)).hexdigest() == sha:  # else another text under this doc_id
                    out += [(d, sha, int(r["key"]), int(r["start"]), b" ".join(words[r["start"] : r["end"] + WINDOW - 1]), int(r["end"] - r["start"]) + WINDOW - 1) for r in runs]
            yield pd.DataFrame(out, columns=["doc_id", "sha", "key", "start", "words", "size"])

    return rows.mapInPandas(work, "doc_id long, sha string, key long, start long, words binary, size long")


def cut_texts(rows: DataFrame) -> DataFrame:
    """(doc_id, sha, n_removed, kept): texts without the covered words; kept joins the rest by one blank."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for d, sha, text, spans in zip(f["doc_id"], f["sha"], f["text"], f["spans"], strict=True):
                words = (text or "").encode("utf-8").split()
                if hashlib.sha256(b" ".join(words)).hexdigest() != sha:  # another text under this doc_id
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    np.add.at(edge, np.asarray(s["places"], np.int64) + s["start"], 1)
                    np.add.at(edge, np.asarray(s["places"], np.int64) + s["start"] + WINDOW, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out.append((d, sha, int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode("utf-8")))
            yield pd.DataFrame(out, columns=["doc_id", "sha", "n_removed", "kept"])

    return rows.mapInPandas(work, "doc_id long, sha string, n_removed long, kept string")


def concerned(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """texts joined to rows by doc_id. Few ids are broadcast first, so that the other texts stay where they are; for more, Spark's own runtime filters stand in."""
    ids = rows.select("doc_id").distinct()
    if ids.count() <= IDS_MOST:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    return texts.join(rows, "doc_id")


def partitioned(segments: DataFrame) -> tuple[list[tuple[DataFrame, bool]], list[DataFrame]]:
    """The groups by the length of their prefixes, each with whether its prefix is a whole window, and which piece of the
    next length stands where in which segment (parent, place, seg).

    segments: key, seg, words, size, doc_id, several rows for a segment that several documents have.
    """
    once = [F.first(c).alias(c) for c in ("words", "size")]
    now = stored(segments.groupBy("key", "seg").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), *once).withColumn("gram", F.col("key")))
    groups: list[tuple[DataFrame, bool]] = []
    links: list[DataFrame] = []
    for prefix in PREFIXES:
        full = stored(now.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where((F.col("size") > GROUP_WORDS) & (F.col("n") > 1)).select("key"))
        if full.isEmpty():
            return [*groups, (now, False)], links
        groups.append((now.join(full, "key", "left_anti"), False))
        cut = now.join(full, "key", "left_semi").select("seg", "gram", "words", "least", "most")
        made = cut.mapInPandas(longer(prefix), "parent long, place long, gram long, key long, words binary, size long, least long, most long")
        made = stored(made.withColumn("seg", F.xxhash64("key", F.sha2("words", 256))))
        links.append(made.select("parent", "place", "seg"))
        # Equal pieces collapse where they are before any are brought together.
        different = stored(made.groupBy("key", "seg").agg(F.min("least").alias("least"), F.max("most").alias("most"), *once, F.first("gram").alias("gram")))
        shared = different.groupBy("key").agg(F.min("least").alias("a"), F.max("most").alias("b")).where("a < b").select("key")
        now = stored(different.join(shared, "key", "left_semi"))
    return [*groups, (now, True)], links


def trees(group: DataFrame, done, schema: str) -> DataFrame:
    return group.select("key", "seg", "least", "most", "words").repartition("key").sortWithinPartitions("key").mapInPandas(by_group(done), schema)


def lows(segments: DataFrame) -> DataFrame:
    """(seg, parts): of the windows of each segment the smallest doc_id that has them, in parts (at, lows): from place `at` on. Windows of one document may be missing."""
    groups, links = partitioned(segments)
    found = [g.select("seg", F.lit(0).cast("long").alias("at"), F.array("least").alias("lows")) if leaf else trees(g, lowest, "seg long, at long, lows array<long>") for g, leaf in groups]
    out, together = found.pop(), bool(links)
    while found:
        out = found.pop().unionByName(links.pop().join(out, "seg").select(F.col("parent").alias("seg"), (F.col("place") + F.col("at")).alias("at"), "lows"))
    part = F.struct("at", "lows")
    return out.groupBy("seg").agg(F.collect_list(part).alias("parts")) if together else out.select("seg", F.array(part).alias("parts"))


def shared_segments(texts: DataFrame, seen: DataFrame, first: DataFrame) -> DataFrame:
    """(doc_id, sha, key, start, words, size, seg): the segments of texts (of equal ones the first) whose gram another text has too."""
    own = seen.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW)).join(first.select(F.col("sha"), F.col("least").alias("doc_id")), ["sha", "doc_id"], "left_semi").dropDuplicates(["doc_id", "sha"])
    runs = own.select("doc_id", "sha", F.inline(F.arrays_zip("keys", "starts", "ends"))).withColumnsRenamed({"keys": "key", "starts": "start", "ends": "end"})
    shared = runs.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    by_doc = stored(runs.join(shared, "key", "left_semi").groupBy("doc_id", "sha").agg(F.collect_list(F.struct("key", "start", "end")).alias("runs")))
    held = concerned(texts.where(F.col("text").isNotNull()), by_doc)
    return stored(cut_segments(held).distinct().withColumn("seg", F.xxhash64("key", F.sha2("words", 256))))


def scanned(docs: DataFrame, column: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts, seen (what scan() finds) and first (the smallest doc_id and the number of rows of equal texts)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(column).alias("text"))
    seen = stored(scan(texts))
    return texts, seen, stored(seen.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))


def repeats(docs: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(words, n_words, least, most): the repeats of 50 words or more between different texts, with the smallest and largest
    doc_id that has each. A repeat is maximal within its segment: one that runs on is told in overlapping pieces."""
    groups, _ = partitioned(shared_segments(*scanned(docs, column, key)))
    whole = ["words", F.lit(WINDOW).cast("long").alias("n_words"), "least", "most"]
    found = [g.where("least < most").select(*whole) if leaf else trees(g, maximal, "words binary, n_words long, least long, most long") for g, leaf in groups]
    return reduce(DataFrame.unionByName, found).groupBy(F.col("words").cast("string").alias("words"), "n_words").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def removals(docs: DataFrame, column: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(all, changed). all: doc_id, n_words, sha of all words, n_removed for every row of docs. changed: doc_id, sha,
    n_removed and kept, the text that is left, for documents that lose some words but are no copies."""
    texts, seen, first = scanned(docs, column, key)
    classed = spread_join(seen.select("doc_id", "n_words", "sha"), first, "sha", "rows")
    segments = shared_segments(texts, seen, first)
    found = segments.select("doc_id", "sha", "start", "seg").join(lows(segments), "seg")
    earlier = F.expr("flatten(transform(parts, p -> filter(transform(p.lows, (x, i) -> CASE WHEN x < doc_id THEN p.at + i END), x -> x IS NOT NULL)))")
    covered = found.select("doc_id", "sha", "start", earlier.alias("places")).where(F.size("places") > 0)
    spans = stored(covered.groupBy("doc_id", "sha").agg(F.collect_list(F.struct("start", "places")).alias("spans")))
    changed = stored(cut_texts(concerned(texts, spans)).dropDuplicates(["doc_id", "sha"]))
    lost = changed.select(F.col("doc_id").alias("d"), F.col("sha").alias("s"), F.col("n_removed").alias("some"))
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)) & (F.col("n_words") >= WINDOW)
    every = classed.join(lost, (F.col("doc_id") == F.col("d")) & (F.col("sha") == F.col("s")), "left")
    return every.select("doc_id", "n_words", "sha", F.when(copy, F.col("n_words")).otherwise(F.coalesce("some", F.lit(0))).cast("long").alias("n_removed")), changed
