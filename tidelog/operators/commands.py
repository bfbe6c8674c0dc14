"""The command language as column expressions: a line of text becomes an op, its operands, or an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Operands of each verb: least and most; -1: no bound.
ARITY = {"READ": (1, 1), "DELETE": (1, 1), "EXISTS": (1, 1), "WRITE": (2, -1), "TTL": (2, 2), "WRITETTL": (3, -1), "RANGE": (2, 2), "MGET": (1, -1), "MSET": (2, -1), "MWRITETTL": (3, -1), "COMPACT": (0, 0), "STATS": (0, 0), "LIST": (0, 0), "PING": (0, 0), "QUIT": (0, 0)}


def parse(lines: DataFrame, column: str = "line") -> DataFrame:
    """lines with op, key, value, ttl_s, start, end, items and error. Verbs know no case; values keep their blanks."""
    text = F.coalesce(F.col(column), F.lit(""))
    t = lines.withColumn("_w", F.filter(F.split(text, r"\s+"), lambda x: x != "")).withColumn("_op", F.upper(F.coalesce(F.get("_w", F.lit(0)), F.lit(""))))
    n, op = F.size("_w") - 1, F.col("_op")
    bad = F.lit("unknown command")
    for verb, (least, most) in ARITY.items():
        wrong = (n < least) | ((n > most) if most >= 0 else F.lit(False))
        bad = F.when(op == verb, F.when(wrong, F.lit("wrong number of operands"))).otherwise(bad)
    bad = F.when((op == "MSET") & (n % 2 == 1), F.lit("odd number of operands")).when((op == "MWRITETTL") & (n % 2 == 0), F.lit("odd number of operands")).otherwise(bad)
    seconds = F.get("_w", F.when(op == "MWRITETTL", 1).otherwise(2)).try_cast("long")
    timed = op.isin("TTL", "WRITETTL", "MWRITETTL")
    low = F.when(op == "TTL", 0).otherwise(1)
    bad = F.when(bad.isNull() & timed & (seconds.isNull() | (seconds < low) | (seconds > (1 << 32) - 1)), F.lit("bad seconds")).otherwise(bad)
    t = t.withColumn("error", F.when(op == "", F.lit("empty line")).otherwise(bad))
    ok = F.col("error").isNull()
    rest = F.when(op == "WRITE", F.regexp_extract(text, r"^\s*\S+\s+\S+\s(?s)(.*)$", 1)).when(op == "WRITETTL", F.regexp_extract(text, r"^\s*\S+\s+\S+\s+\S+\s(?s)(.*)$", 1))
    operands = F.expr("slice(_w, CASE WHEN _op = 'MWRITETTL' THEN 3 ELSE 2 END, greatest(size(_w), 1))")
    pairs = F.expr("transform(sequence(0, greatest(size(_w) - 2, 0), 2), i -> concat_ws('=', get(_w, i + CASE WHEN _op = 'MWRITETTL' THEN 2 ELSE 1 END), get(_w, i + CASE WHEN _op = 'MWRITETTL' THEN 3 ELSE 2 END)))")
    items = F.when(op == "MGET", operands).when(op == "MSET", pairs).when(op == "MWRITETTL", F.slice(pairs, F.lit(1), ((F.size("_w") - 2) / 2).cast("int")))
    return t.select(
        *[c for c in lines.columns], F.when(ok, op).alias("op"), F.when(ok & op.isin("READ", "DELETE", "EXISTS", "WRITE", "TTL", "WRITETTL"), F.get("_w", F.lit(1))).alias("key"), F.when(ok, rest).alias("value"),
        F.when(ok & timed, seconds).alias("ttl_s"), F.when(ok & (op == "RANGE"), F.get("_w", F.lit(1))).alias("start"), F.when(ok & (op == "RANGE"), F.get("_w", F.lit(2))).alias("end"), F.when(ok, F.array_join(items, ",")).alias("items"), "error",
    )
