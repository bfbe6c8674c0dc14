"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

Method. Four kinds of evidence meet in one posterior over the known languages and "und", none of them:
  text      likelihood of words and byte runs, hashed, under each language's frequencies ("und": all equal);
  declared  the language that the markup or a column declares, through how often each declaration goes with each
            language of the text alone (a grouped count, smoothed);
  suffix    the last label of the address, as the parent of
  host      the share of each language on the host, by a grouped count, smoothed towards the suffix's share, which is
            smoothed towards the whole corpus.
Counts by declaration, suffix and host cover every row. A hot host is counted before the shuffle and joined salted.

Bound. Word and byte-run frequencies are learned on at most `sample` rows of each declared known language, the first by
the hash of their key and one for each key, so that a rare language has its rows at every size.

Defined results: without a letter in it a text (so also a null or empty one) is "und" with confidence 1; missing
declarations, addresses and hosts are no evidence; ties go to the first language by name; a text is markup if it has an
<html tag: its first one may declare a language, and tags are no words of it; columns other than those named in the
call are left out. Rejected (kept is false) are
texts that are "und" or whose best language has a posterior under KEEP_FROM.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_by_hash, stored, with_text_columns

LANGUAGES, NONE = ("de", "en", "es", "fr"), "und"
BUCKETS, SAMPLE, KEEP_FROM = 8192, 4000, 0.5
#: Evidence of one more word or byte run: they depend on each other, and more than MOST of them say no more.
TEMPER, MOST = 0.15, 400
#: Strength of a parent's share against a child's counts, prior weight of "und", and copies of a host's row in the join.
HOST_PULL, SUFFIX_PULL, NONE_SHARE, SALTS = 20.0, 50.0, 0.01, 16

TAG, DECLARES, MARKS = re.compile(r"<html\b", re.IGNORECASE), re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2})", re.IGNORECASE), re.compile(r"<[^<>]*>")
LETTER, DIGIT = re.compile(r"[^\W\d_]"), re.compile(r"\d")


def buckets(text: str) -> np.ndarray:
    """Hashed words (twice, as they tell most), and hashed runs of two to four bytes; words with a digit are left out."""
    words = [w for w in text.lower().split() if not DIGIT.search(w)]
    w = np.fromiter((zlib.crc32(x.encode("utf-8")) for x in words), np.uint64, len(words)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(51)
    b = np.frombuffer(" ".join(words).encode("utf-8"), np.uint8).astype(np.uint64)
    out, run = [w, w], b
    for n, k in ((2, 0xC2B2AE3D27D4EB4F), (3, 0x165667B19E3779F9), (4, 0x27D4EB2F165667C5)):
        if len(run) < 2:
            break
        run = run[:-1] << np.uint64(8) | b[n - 1 :]
        out.append((run * np.uint64(k)) >> np.uint64(51))
    return np.concatenate(out).astype(np.int64)


def learn(df: DataFrame, column: str = "text", declared: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> np.ndarray:
    """Log frequencies, a row for each of LANGUAGES and an even one for NONE."""
    few = reduce(DataFrame.unionByName, [first_by_hash(df.where((F.col(declared) == c) & F.col(key).isNotNull()).select(key, declared), key, sample) for c in LANGUAGES])
    rows = df.select(key, declared, column).join(F.broadcast(few), [key, declared]).groupBy(key, declared).agg(F.min(column).alias(column)).select(declared, column)

    def tally(batches):
        out = np.zeros((len(LANGUAGES), BUCKETS))
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.bincount(buckets(text or ""), minlength=BUCKETS)
                out[LANGUAGES.index(lang)] += got / max(1, got.sum())
        yield pa.RecordBatch.from_arrays([pa.array([out.astype("<f8").tobytes()])], names=["counts"])

    total = np.zeros((len(LANGUAGES), BUCKETS))
    for r in rows.repartition(8).mapInArrow(tally, "counts binary").collect():
        total += np.frombuffer(r["counts"], "<f8").reshape(total.shape)
    share = (total / np.maximum(total.sum(axis=1, keepdims=True), 1e-9) + 0.05 / BUCKETS) / 1.05
    return np.vstack([np.log(share), np.full((1, BUCKETS), -np.log(BUCKETS))])


def markup(text: str) -> tuple[str | None, str]:
    """The language that a text's first <html tag declares, and the text without tags; a text without that tag stays as it is."""
    if not (tag := TAG.search(text)):
        return None, text
    end = text.find(">", tag.end())
    m = DECLARES.search(text, tag.end(), end if end >= 0 else len(text))
    return m[1].lower() if m else None, MARKS.sub(" ", text)


def evidence(df: DataFrame, model: np.ndarray, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (its columns keep) with text_evidence, a log likelihood for each language and NONE (null where no letter is), markup_language, and text_language."""

    def work(texts: list) -> dict:
        likelihoods, said, best = [], [], []
        for t in texts:
            lang, t = markup(t) if t and "<" in t else (None, t)
            said.append(lang)
            if not t or not LETTER.search(t):
                likelihoods.append(None)
                best.append(NONE)
                continue
            at = buckets(t)
            ll = model[:, at].mean(axis=1) * (TEMPER * min(len(at), MOST)) if len(at) else np.zeros(len(model))
            likelihoods.append(ll.tolist())
            best.append([*LANGUAGES, NONE][int(ll.argmax())] if len(at) else NONE)
        return {"text_evidence": likelihoods, "markup_language": said, "text_language": best}

    fields = [T.StructField("text_evidence", T.ArrayType(T.DoubleType())), T.StructField("markup_language", T.StringType()), T.StructField("text_language", T.StringType())]
    return with_text_columns(df, fields, lambda: work, column, keep)


def host_of(address: Column) -> Column:
    """The host of an address, or of a bare name, in lower case; null if empty."""
    bare = F.lower(F.regexp_replace(address.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    host = F.regexp_extract(bare, r"^(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return F.when(host != "", host)


def suffix_of(host: Column) -> Column:
    """What follows a host's last dot; null without a dot."""
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1))


def shares(counts: list[Column], total: Column, pull: float, parent: list[Column]) -> list[Column]:
    return [(F.coalesce(n, F.lit(0)) + pull * p) / (F.coalesce(total, F.lit(0)) + pull) for n, p in zip(counts, parent, strict=True)]


def identify(df: DataFrame, model: np.ndarray, column: str = "text", declared: str | None = "lang", address: str | None = "source", key: str = "doc_id") -> DataFrame:
    """A row for each row of df: key, language, confidence, text_language and kept.

    Text is read once; what it says goes to a stored table of a few numbers a row, from which all counts come.
    """
    classes = [*LANGUAGES, NONE]
    absent = F.lit(None).cast("string")
    given = df.select(
        F.col(key).alias("key"), F.col(column).alias("text"),
        (F.lower(F.substring(F.col(declared).cast("string"), 1, 2)) if declared else absent).alias("declared_language"),
        (host_of(F.col(address)) if address else absent).alias("host"),
    )
    seen = stored(evidence(given, model, keep=["key", "declared_language", "host"]).withColumn("declared", F.coalesce("markup_language", "declared_language")).drop("markup_language", "declared_language").withColumn("suffix", suffix_of(F.col("host"))))

    said = F.when(F.col("declared").isin(*LANGUAGES), F.col("declared")).when(F.col("declared").isNotNull(), F.lit("other"))
    table = {(r["text_language"], r["said"]): r["count"] for r in seen.withColumn("said", said).groupBy("text_language", "said").count().collect()}  # at most 5 x 6 rows
    rows = sum(n for (t, _), n in table.items() if t != NONE) or 1
    whole = [(sum(n for (t, _), n in table.items() if t == c) + 1) / (rows + len(LANGUAGES)) * (1 - NONE_SHARE) for c in LANGUAGES] + [NONE_SHARE]

    def declaration(c: str) -> Column:
        out, total = F.lit(0.0), sum(n for (t, s), n in table.items() if t == c and s) + 2.0 * (len(LANGUAGES) + 1)
        for s in (*LANGUAGES, "other"):
            out = F.when(F.col("said") == s, F.lit(float(np.log((table.get((c, s), 0) + 2.0) / total)))).otherwise(out)
        return out

    tallies = [F.sum((F.col("text_language") == c).cast("long")).alias(f"n_{i}") for i, c in enumerate(LANGUAGES)]
    hosts = seen.where(F.col("host").isNotNull()).groupBy("host", "suffix").agg(*tallies)
    n = [F.col(f"n_{i}") for i in range(len(LANGUAGES))]
    by_suffix = hosts.where(F.col("suffix").isNotNull()).groupBy("suffix").agg(*[F.sum(x).alias(f"s_{i}") for i, x in enumerate(n)])
    s = [F.col(f"s_{i}") for i in range(len(LANGUAGES))]
    flat = [F.lit(w / (1 - NONE_SHARE)) for w in whole[:-1]]
    parent = shares(s, sum(F.coalesce(x, F.lit(0)) for x in s), SUFFIX_PULL, flat)
    prior = shares(n, sum(n), HOST_PULL, parent)
    priors = hosts.join(by_suffix, "suffix", "left").select("host", *[(p * (1 - NONE_SHARE)).alias(f"p_{i}") for i, p in enumerate(prior)], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # A salt from the row's own bytes spreads a hot host over SALTS tasks; rows without a host are spread alike.
    joined = seen.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).withColumn("said", said).join(priors, ["host", "salt"], "left")

    log = [F.element_at("text_evidence", i + 1) + declaration(c) + F.log(F.coalesce(F.col(f"p_{i}"), F.lit(whole[i])) if c != NONE else F.lit(NONE_SHARE)) for i, c in enumerate(classes)]
    # "und" says nothing on declarations: a declared language must not make it likelier or less so.
    log[-1] = F.element_at("text_evidence", len(classes)) + F.lit(float(np.log(NONE_SHARE))) + F.when(F.col("said").isNull(), 0.0).otherwise(float(np.log(1 / (len(LANGUAGES) + 1))))
    scored = joined.select("key", "text_language", F.array(*log).alias("log"), F.col("text_evidence").isNull().alias("mute"))
    top = F.array_max("log")
    sure = 1 / F.aggregate(F.col("log"), F.lit(0.0), lambda a, x: a + F.exp(x - top))
    best = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("log", top).cast("int"))
    named = scored.select("key", "text_language", F.when(F.col("mute"), F.lit(NONE)).otherwise(best).alias("language"), F.when(F.col("mute"), F.lit(1.0)).otherwise(sure).alias("confidence"))
    return named.select(F.col("key").alias(key), "language", "confidence", "text_language", ((F.col("language") != NONE) & (F.col("confidence") >= KEEP_FROM)).alias("kept"))
