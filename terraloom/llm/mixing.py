"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target
over source size. Its whole part is taken outright; the fraction is a copy
probability. Two documents are paired and probability mass, weighed by their
sizes, moves between them in a random direction until one of them is 0 or 1,
so expected copies stay right and the words of the pair do not change. The
last open fraction of a group goes on to the next level of a reduction tree.

Groups are (source, size class, hash slot), whole sources where they are
small: a source with a third of all rows
is spread over many slots, and pairs have like sizes. Draws come from hashes
of the group, so reruns agree.

Defined cases: a null text has size 0; documents of size 0 take 0 words; null
sources are one source, ordered last; repeated rows are documents of their
own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranking import dense_positions
from ..scratch import cut, sized
from .batches import ship

WORD = r"[^\x20\x09-\x0D]+"
SLOT_ROWS = 5_000
FAN_IN = 256


def targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target for every source of (source, source_size).

    Sources in code point order, null last, take the weights in turn and
    share ``share`` of all words; none gets over ``most`` times its size, and
    what it can't take goes to the others by weight.
    """
    ordered = dense_positions(sizes, [F.isnull("source"), F.col("source")], name="_k")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_k") % len(weights) + 1).cast("int"))
    named = cut(ordered.select("source", "source_size", turn.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap")))
    total = named.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    left, level = share * total, 0.0
    # The level is the same for all open sources; each pass closes those whose
    # cap lies below it, so it only rises.
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("w")
        row = named.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("taken"),
                        F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)).alias("w")).first()
        if row["w"] == 0:
            break
        now = (left - row["taken"]) / row["w"]
        if now <= level * (1 + 1e-12):
            break
        level = now
    target = F.least(F.col("cap"), F.lit(level) * F.col("w"))
    return named.select("source", "source_size", target.alias("target"))


def _uniforms(key: tuple, n: int) -> list:
    seed = int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "little")
    return np.random.Generator(np.random.PCG64(seed)).random(n).tolist()


def pivot(sizes: list, fractions: list, draws: list) -> tuple[list, int, float]:
    """Rounded copies (0 or 1; -1 for the open one), its index and fraction.

    ``sizes`` fall; size times fraction summed does not change.
    """
    out = [0] * len(sizes)
    at, p = -1, 0.0
    for k, (size, q) in enumerate(zip(sizes, fractions, strict=True)):
        if q <= 1e-12 or q >= 1 - 1e-12:
            out[k] = round(q)
            continue
        if at < 0:
            at, p = k, q
            continue
        a, b = sizes[at], size
        # Words that can go to the open one, and those that can leave it.
        gain, loss = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
        if draws[k] * (gain + loss) < loss:
            p, q = p + gain / a, q - gain / b
        else:
            p, q = p - loss / a, q + loss / b
        open_p, open_q = 1e-9 < p < 1 - 1e-9, 1e-9 < q < 1 - 1e-9
        if not open_p:
            out[at] = round(p)
            at, p = (k, q) if open_q else (-1, 0.0)
        if not open_q:
            out[k] = round(q)
    if at >= 0:
        out[at] = -1
    return out, at, p


def _level(df: DataFrame, keys: list[str], seed: int, last: bool) -> DataFrame:
    """One level of the tree: copies of the closed rows, the rest still null."""
    schema = df.schema

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "mark"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        key = tuple(repr(pdf[k].iloc[0]) for k in keys)
        draws = _uniforms((seed, *key), len(pdf) + 1)
        out, at, p = pivot(pdf["size"].tolist(), pdf["p"].tolist(), draws)
        if at >= 0 and last:
            # Nothing is left to pair with: one more draw keeps its chance.
            out[at] = int(draws[-1] < p)
        copies = pd.Series(out, dtype="Int64").replace(-1, pd.NA)
        pdf["copies"] = copies
        if at >= 0:
            pdf.loc[at, "p"] = p
        return pdf

    return df.groupBy(*keys).applyInPandas(close, schema)


def mix(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple = (3, 1, 2),
    share: float = 1.5, most: float = 2.0, seed: int = 42, slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """doc_id, source, mark, size, source_size, target, copies, taken.

    ``mark`` hashes the text, which tells documents of one id apart.
    """
    spark = docs.sparkSession
    ship(spark)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"),
                           F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark")))
    per = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    aim = cut(targets(per.select("source", "source_size"), weights, share, most))
    shape = F.floor(F.log2(F.col("size").cast("double"))).cast("int")
    # Slots hold about slot_rows rows; a source that fits into one is not split
    # by size, so that its last open document tends to be a small one.
    full = rows.withColumn("shape", F.when(F.col("size") > 0, shape))
    counts = full.where("size > 0").groupBy("source", "shape").agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(W.partitionBy("source")) <= slot_rows
    classes = counts.select(
        F.col("source").alias("_source"), F.col("shape").alias("_shape"), F.when(whole, F.lit(-1)).otherwise(F.col("shape")).alias("class"),
        F.when(whole, F.lit(1)).otherwise(F.ceil(F.col("n") / slot_rows)).cast("long").alias("slots"))
    plan = cut(classes.join(aim, F.col("_source").eqNullSafe(aim["source"])).drop("source"))
    few = sized(plan, plan.count())
    placed = full.where("size > 0").join(few, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shape") == F.col("_shape")))
    each = F.col("target") / F.col("source_size")
    placed = placed.select(
        "doc_id", "source", "mark", "size", "class", "source_size", "target", F.floor(each).cast("long").alias("base"),
        (each - F.floor(each)).alias("p"), F.pmod(F.xxhash64("doc_id", "mark"), "slots").alias("slot"), F.lit(None).cast("long").alias("copies"))
    deep = (plan.agg(F.coalesce(F.max("slots"), F.lit(1))).first()[0])
    done, now, keys = [], placed, ["source", "class", "slot"]
    while keys:
        last = keys == ["source"]
        after = cut(_level(now, keys, seed, last))
        done.append(after.where("copies is not null"))
        now = after.where("copies is null")
        if deep > 1:
            deep = -(-deep // FAN_IN)
            now = now.withColumn("slot", F.floor(F.col("slot") / FAN_IN).cast("long"))
        else:
            keys = [] if last else ["source"]
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    cols = ["doc_id", "source", "mark", "size", "source_size", "target", "copies"]
    out = out.withColumn("copies", F.col("base") + F.col("copies")).select(*cols)
    bare = full.where("size = 0").join(sized(aim.select(F.col("source").alias("_source"), "source_size", "target"), aim.count()),
                                       F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", F.lit(0).cast("long")).select(*cols)
    return out.unionByName(bare).withColumn("taken", F.col("copies") * F.col("size"))
