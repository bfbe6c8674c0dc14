"""Near-duplicates: SimHash fingerprints, linked through tables of distances to reference fingerprints.

Method. Every different fingerprint gets its Hamming distances to PIVOTS reference fingerprints. Two fingerprints within
RADIUS bits differ by RADIUS at most in each of these coordinates (triangle inequality), so a pair is discarded by its
largest coordinate difference; only survivors are compared bit by bit.

Blocks keep this from being a comparison of all pairs, without losing one: the 64 bits form f fields, and of two
fingerprints that differ in at most four bits at least f - 4 fields are equal, so each fingerprint joins a block for each
choice of f - 4 of its fields: 15 of 21 bits with six fields, 35 of 27 with seven, 70 of 32 with eight. f follows from the
number of fingerprints, so that chance alone brings about BLOCK_MEAN or fewer to a block. (Cells of pivot coordinates
cannot stand in for the blocks: two random fingerprints agree in one coordinate up to RADIUS more than half the time.)
In a block, fingerprints go by their first coordinate, and a search from each one that is reached takes the rest of its
component, so a dense block costs about its size, not its square. A block of more than BLOCK_MOST fingerprints is dealt
in parts, and each two parts meet in one task. Only a forest of links leaves a task.

A fingerprint or a component with a large share of all rows is not gathered: rows meet their component in spread_join().

Defined results: a null text counts as empty; texts without a word have fingerprint zero and are linked like any other.
Rows with a null doc_id get the component of their fingerprint and never give it its name (null, if nobody else can).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread_join, stored, with_text_columns
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
PIVOTS, BLOCK_MOST, BLOCK_MEAN, SMALL, STEP = 32, 40_000, 32, 48, 200_000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit i is set if it is in more than half of the XXH64 of all shingles of the words, A-Z as a-z."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(size, len(words))
    starts = np.r_[0, ends[:-1] + 1][: len(words) - k + 1].tolist()
    hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (its columns keep) with fp, the fingerprint as a long of the same bits."""

    def work(texts: list) -> dict:
        return {"fp": np.array([fingerprint(t) for t in texts], dtype="<u8").view("<i8")}

    return with_text_columns(df, [T.StructField("fp", T.LongType())], lambda: work, column, keep)


def references(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints by a rule: multiples of an odd constant, bits mixed."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def distances(fps: np.ndarray) -> np.ndarray:
    """The pivot table: a row for each fingerprint, a column for each reference."""
    return np.bitwise_count(fps[:, None] ^ references()[None, :]).astype(np.int8)


def survivors(fps: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no coordinate discards and that RADIUS bits or fewer tell apart."""
    for lo, hi in ((0, 4), (4, 12), (12, PIVOTS)):
        near = (np.abs(table[left, lo:hi] - table[right, lo:hi]) <= RADIUS).all(axis=1)
        left, right = left[near], right[near]
    near = np.bitwise_count(fps[left] ^ fps[right]) <= RADIUS
    return left[near], right[near]


def dense_links(fps: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links in one block: what a search reaches is not looked at again."""
    rest = np.arange(len(fps))
    a, b = [], []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            _, got = survivors(fps, table, np.full(len(rest), x), rest)
            if len(got):
                a.append(np.full(len(got), x))
                b.append(got)
                rest = np.setdiff1d(rest, got, assume_unique=True)
                front += got.tolist()
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(group: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints within groups: all links of small groups, a forest of those of large ones."""
    table = distances(fps)
    order = np.lexsort((table[:, 0], group))
    group, fps, table = group[order], fps[order], table[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    out = []
    small = np.repeat(sizes <= SMALL, sizes)
    at = np.flatnonzero(small)
    for step in range(1, SMALL):
        at = at[at + step < len(fps)]
        at = at[(group[at] == group[at + step]) & (table[at + step, 0] - table[at, 0] <= RADIUS)]
        if not len(at):
            break
        out.append(survivors(fps, table, at, at + step))
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        a, b = dense_links(fps[s : s + n], table[s : s + n])
        out.append((a + s, b + s))
    if not out:
        return fps[:0], fps[:0]
    return fps[np.concatenate([a for a, _ in out])], fps[np.concatenate([b for _, b in out])]


def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within groups; the rows come sorted by group, and the last group of a step waits for the next."""

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = links(rows["group"].to_numpy(), rows["fp"].to_numpy().view("<u8"))
        return pd.DataFrame({"a": a.view("<i8"), "b": b.view("<i8")}).drop_duplicates()

    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= STEP:
            rows = pd.concat(held)
            whole = (rows["group"] != rows["group"].iloc[-1]).to_numpy()
            if whole.any():
                yield found(rows[whole])
            held = [rows[~whole]]
    if held:
        yield found(pd.concat(held))


def fields_for(n: int) -> list[int]:
    """Bits of the fields, from the lowest, for n fingerprints: the fewest fields whose blocks have BLOCK_MEAN by chance, or eight."""
    count = next((f for f in (6, 7) if n >> (64 * (f - RADIUS) // f) <= BLOCK_MEAN), 8)
    return [64 // count + (i < 64 % count) for i in range(count)]


def near_links(distinct: DataFrame, n: int) -> DataFrame:
    """(a, b): links between n different fingerprints (column fp), enough to connect all that are linked."""
    widths, fields, at = fields_for(n), [], 0
    for width in widths:
        fields.append((F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1), width))
        at += width
    blocks = []
    for i, chosen in enumerate(combinations(fields, len(widths) - RADIUS)):
        packed = F.lit(i).cast("long")
        for value, width in chosen:
            packed = F.shiftleft(packed, width).bitwiseOR(value)
        blocks.append(packed)
    member = distinct.select("fp", F.explode(F.array(*blocks)).alias("block"))
    crowded = member.groupBy("block").count().where(F.col("count") > BLOCK_MOST).withColumn("parts", F.ceil(F.col("count") * 2 / BLOCK_MOST).cast("int")).select("block", "parts")
    few = stored(crowded)  # rare: Spark broadcasts it if it is small
    dealt = member.join(few, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    other = F.expr("array_distinct(transform(sequence(0, parts - 1), o -> CASE WHEN parts > 1 AND o = part THEN (part + 1) % parts ELSE o END))")
    met = dealt.withColumn("other", F.explode(other))
    grouped = met.select("fp", F.when(F.col("parts") == 1, F.col("block")).otherwise(F.xxhash64("block", F.least("part", "other"), F.greatest("part", "other"))).alias("group"))
    return grouped.repartition("group").sortWithinPartitions("group").mapInPandas(linked, "a long, b long").distinct()


def cluster(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each row of df: key, fp and component_id, the smallest key that its links reach."""
    seen = stored(fingerprints(df.select(F.col(key).alias("key"), F.col(column).alias("text")), keep=["key"]))
    distinct = stored(seen.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("rows")))
    roots = stored(components(near_links(distinct, distinct.count())))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    classes = stored(spread_join(named.select("fp", "rows", "root"), names, "root", "members").select("fp", "rows", "component_id"))
    return spread_join(seen, classes, "fp", "rows").select(F.col("key").alias(key), "fp", "component_id")
