"""Benchmark decontamination with DataFrame functions alone: item-sized windows that nearly equal a benchmark item.

Similarity of a window and an item is weighted Jaccard of their five-word shingles, repeats counted: the sum of the
smaller counts over the sum of the larger. Words are cut at blanks, tab to carriage return; A-Z count as a-z. A window
has as many words as the item, or the whole text where that is shorter.

Method.
  gate     A similarity of t needs t / (1 + t) of both sizes in common shingles. Texts that cannot have as many for any
           item go first, then (text, item) pairs, then windows. Nothing that could reach t is lost. A window that has
           them misses few of its places, so of every s-th place of a text at least some are hits: texts without these
           go before their other places are hashed. s follows from the items' sizes.
  SimHash  Each window left gets a 64-bit fingerprint of its shingles, as each item has.
  blocks   The 64 bits form eight bytes. Two fingerprints within RADIUS = 23 bits agree in one byte up to two bits, so
           items are entered under every value within two bits of each of their bytes, and windows look their bytes up.
  verify   The exact similarity decides.

Size. All texts are cut into words once, whatever the items' lengths. The gate tests shingles in a table of GATE_BITS bits
at most, a literal with two bits for each item shingle: the cost of a test does not grow with the benchmark, only the
share of false alarms, which the pairs' exact join ends. Where the items would fill more than 1 / SPARSE of the table,
shingles are joined instead, without the texts' arrays. Items and their blocks are broadcast only if their counted rows
take less than BROADCAST_BYTES; beyond it Spark joins them by shuffle. Texts meet no other texts, so a hot group of
copies costs what its rows cost.

Defined results: null and empty texts and items match nothing; items under five words are one shingle of all their words
(and their windows too); equal rows give equal results, once for each (key, item); null keys are kept as keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SHINGLE, LEAST, RADIUS = 5, 0.8, 23
#: Bytes that a broadcast may take, bytes of one of its rows, and rows that an item's bytes have with all values within two bits.
BROADCAST_BYTES, ROW_BYTES, VARIANTS = 64 << 20, 120, 8 * 37
#: Bits of the gate's table at most, how many of them it has for each item shingle, and the widest step between tested places.
GATE_BITS, SPARSE, STEP_MOST = 1 << 20, 32, 9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; an empty array for null and for texts without any."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def once(expression: Column) -> Column:
    """The expression through a generator: Spark then evaluates it once a row, and copies it into no filter or lambda."""
    return F.explode(F.array(expression))


def shingles(k: int, step: int = 1) -> Column:
    """Hashes of the runs of k words of column `words`, in order, from every step-th place."""
    parts = ", ".join(f"words[i + {j}]" for j in range(k))
    return F.expr(f"CASE WHEN size(words) >= {k} THEN transform(sequence(0, size(words) - {k}, {step}), i -> xxhash64({parts})) ELSE cast(array() AS array<bigint>) END")


def simhash(column: str) -> Column:
    """Bit i is set if it is in more than half of an array column's hashes."""
    return F.expr(f"""aggregate(sequence(0, 63), 0L, (fp, b) -> fp | shiftleft(
        CASE WHEN 2 * aggregate({column}, 0L, (n, h) -> n + (shiftright(h, b) & 1L)) > size({column}) THEN 1L ELSE 0L END, b))""")


def items_of(benchmark: DataFrame, key: str, column: str) -> DataFrame:
    """item, own (names a row of the benchmark; equal rows are one), size (words), k (words of a shingle), counts of its shingles by hash, total and fp."""
    cut = benchmark.select(F.col(key).alias("item"), once(words(F.col(column))).alias("words")).where(F.size("words") > 0)
    sized = cut.withColumns({"k": F.least(F.lit(SHINGLE), F.size("words")), "own": F.xxhash64("item", "words")}).dropDuplicates(["own"])
    by_k = F.when(F.col("k") == SHINGLE, shingles(SHINGLE))
    for k in range(1, SHINGLE):
        by_k = by_k.when(F.col("k") == k, shingles(k))
    hashed = sized.select("item", "own", F.size("words").alias("size"), "k", once(by_k).alias("hashes"))
    counts = F.transform(F.array_distinct("hashes"), lambda h: F.struct(h.alias("h"), F.size(F.filter("hashes", lambda x: x == h)).alias("n")))
    return hashed.select("item", "own", "size", "k", counts.alias("counts"), F.size("hashes").alias("total"), once(simhash("hashes")).alias("fp"))


def needed(a: Column, b: Column, least: float) -> Column:
    """Common shingles without which sizes a and b have no similarity of least."""
    return F.ceil((a + b) * F.lit(least / (1 + least)) - 1e-9)


def sampled_hits(step: int, least: float) -> Column:
    """Hits that every step-th place of a text has at least, if a window of the item of this row has similarity least."""
    widths = F.sequence(F.ceil(F.col("total") * least - 1e-9).cast("int"), F.col("total"))
    return F.array_min(F.transform(widths, lambda w: (F.floor(w / step) - (w - needed(F.col("total"), w, least))).cast("int")))


def bit_table(hashes: DataFrame, rows: int) -> str:
    """SQL of a test of a hash h in a table of hashes (column h): two bits each, GATE_BITS / 64 rows to the driver at most."""
    bits = min(GATE_BITS, max(64, 1 << (2 * rows * SPARSE - 1).bit_length()))
    spots = hashes.select(F.explode(F.array(F.expr(f"h & {bits - 1}L"), F.expr(f"shiftright(h, 32) & {bits - 1}L"))).alias("spot"))
    table = ["0"] * (bits // 64)
    for r in spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 AS int))")).alias("bits")).collect():
        table[r["word"]] = str(r["bits"])
    literal = f"cast(split('{','.join(table)}', ',') AS array<bigint>)"
    test = lambda h: f"(shiftright(get({literal}, cast(shiftright({h} & {bits - 1}L, 6) AS int)), cast({h} & 63 AS int)) & 1L) = 1L"
    return f"{test('h')} AND {test('shiftright(h, 32)')}"


def matches(docs: DataFrame, benchmark: DataFrame, column: str = "text", key: str = "doc_id", item_key: str = "item_id", item_column: str = "text", least: float = LEAST) -> DataFrame:
    """(key, item_id, similarity, start, n_words): each pair's best window of least similarity or more; start counts words from 0."""
    items = stored(items_of(benchmark, item_key, item_column))
    steps = [F.min(sampled_hits(s, least)).alias(f"hits_{s}") for s in range(1, STEP_MOST + 1)]
    fewest = F.min(F.ceil(F.col("total") * least - 1e-9)).alias("fewest")
    shapes = items.groupBy("k").agg(F.sum(F.size("counts")).alias("rows"), F.count("*").alias("n"), fewest, *steps).orderBy("k").collect()  # at most SHINGLE rows
    if not shapes:
        item = F.lit(None).cast(items.schema["item"].dataType)
        return docs.where(F.lit(False)).select(key, item.alias(item_key), F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).alias("n_words"))
    rows, n = sum(r["rows"] for r in shapes), sum(r["n"] for r in shapes)
    near = F.broadcast if max(rows, n * VARIANTS) * ROW_BYTES <= BROADCAST_BYTES else lambda df: df

    cut = docs.select(F.col(key).alias("key"), once(words(F.col(column))).alias("words"))
    if all(2 * r["rows"] * SPARSE <= GATE_BITS for r in shapes):
        tests, sampled = [], []
        for r in shapes:
            k = r["k"]
            held = bit_table(items.where(F.col("k") == k).select(F.explode("counts.h").alias("h")), r["rows"])
            step = max(s for s in range(1, STEP_MOST + 1) if s == 1 or r[f"hits_{s}"] >= 1)
            sampled.append(F.struct(F.lit(k).alias("k"), shingles(k, step).alias("some")))
            hits = lambda column, held=held: F.size(F.expr(f"filter({column}, h -> {held})"))
            tests.append((F.col("k") == k, hits("some") >= max(1, r[f"hits_{step}"]), hits("hashes") >= max(1, r["fewest"])))
        first, second = F.lit(False), F.lit(False)
        every = F.when(F.lit(False), shingles(SHINGLE))
        for r, (own, sampled_enough, enough) in zip(shapes, tests, strict=True):
            first, second, every = first | (own & sampled_enough), second | (own & enough), every.when(own, shingles(r["k"]))
        likely = cut.select("key", "words", F.explode(F.array(*sampled)).alias("x")).select("key", "words", "x.k", "x.some").where(first)
        able = likely.select("key", "k", once(every).alias("hashes")).where(second).withColumn("same", F.xxhash64("hashes"))
    else:
        each = F.array(*[F.struct(F.lit(r["k"]).alias("k"), shingles(r["k"]).alias("hashes")) for r in shapes])
        hashed = cut.select("key", F.explode(each).alias("x")).select("key", "x.k", "x.hashes").where(F.size("hashes") > 0).withColumn("same", F.xxhash64("hashes"))
        met = hashed.select("key", "k", "same", F.explode("hashes").alias("h")).join(items.select("k", F.explode("counts.h").alias("h")).distinct(), ["k", "h"], "left_semi").select(F.col("key").alias("k2"), F.col("k").alias("width2"), F.col("same").alias("s2")).distinct()
        able = hashed.join(met, F.col("key").eqNullSafe(F.col("k2")) & (F.col("k") == F.col("width2")) & (F.col("same") == F.col("s2"))).drop("k2", "width2", "s2")
    # The few texts left, once each, so that arrays need not follow every single hit.
    texts = stored(able.groupBy("key", "k", "same").agg(F.first("hashes").alias("hashes")))
    entries = near(items.select("k", "own", "total", F.explode("counts.h").alias("h")))
    hits = texts.select("key", "k", "same", F.size("hashes").alias("length"), F.posexplode("hashes").alias("pos", "h")).join(entries, ["k", "h"])
    pairs = hits.groupBy("key", "k", "same", "own", "total", "length").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    pairs = pairs.where(F.size("at") >= needed(F.col("total"), F.least("total", "length"), least))
    others = texts.withColumnsRenamed({"key": "k2", "k": "width2", "same": "s2"})
    paired = pairs.join(others, F.col("key").eqNullSafe(F.col("k2")) & (F.col("k") == F.col("width2")) & (F.col("same") == F.col("s2")))
    width = F.least(F.col("total"), F.size("hashes"))
    able = paired.withColumn("width", width).withColumn("need", needed(F.col("total"), F.col("width"), least).cast("int"))
    # Windows with `need` hits at least start from (the last of these hits) - width + 1 to (the first of them).
    starts = F.expr("""array_distinct(flatten(transform(sequence(0, size(at) - need), i ->
        CASE WHEN greatest(at[i + need - 1] - width + 1, 0) <= least(at[i], size(hashes) - width)
             THEN sequence(greatest(at[i + need - 1] - width + 1, 0), least(at[i], size(hashes) - width))
             ELSE cast(array() AS array<int>) END)))""")
    windows = able.select("key", "k", "total", "width", F.explode(starts).alias("start"), "hashes").withColumn("window", F.expr("slice(hashes, start + 1, width)"))
    windows = windows.groupBy("key", "k", "total", "start", F.xxhash64("window").alias("same")).agg(F.first("window").alias("window"))
    marked = windows.withColumn("fp", once(simhash("window")))
    flips = [0, *[1 << i for i in range(8)], *[1 << i | 1 << j for i in range(8) for j in range(i)]]
    block = lambda fp: F.array(*[F.struct(F.lit(i).alias("place"), F.shiftrightunsigned(fp, 8 * i).bitwiseAND(255).cast("int").alias("value")) for i in range(8)])
    index = items.select("k", "own", "total", F.col("fp").alias("item_fp"), F.explode(block(F.col("fp"))).alias("b")).select("k", "own", "total", "item_fp", "b.place", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda f: F.col("b.value").bitwiseXOR(f))).alias("value"))
    looked = marked.select("key", "k", "total", "start", "window", "fp", F.explode(block(F.col("fp"))).alias("b")).select("key", "k", "total", "start", "window", "fp", "b.place", "b.value")
    near_pairs = looked.join(near(index), ["k", "total", "place", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    single = near_pairs.groupBy("key", "k", "own", "start", F.xxhash64("window").alias("same")).agg(F.first("window").alias("window"))
    counted = single.join(near(items.select("own", "item", "counts", "total")), "own")
    common = F.aggregate("counts", F.lit(0), lambda a, c: a + F.least(c["n"], F.size(F.filter("window", lambda h: h == c["h"]))))
    scored = counted.withColumn("common", once(common)).withColumn("similarity", F.col("common") / (F.col("total") + F.size("window") - F.col("common")))
    found = scored.where(F.col("similarity") >= least).select("key", "item", "similarity", "start", (F.size("window") + F.col("k") - 1).alias("n_words"))
    best = found.groupBy("key", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("best"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item_key), F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start"), F.col("best.n_words").alias("n_words"))
