"""Repair of conversation structure by Hirschberg's divide and conquer.

A repaired conversation has role initials ``(s?(ua)+)?``. Its rows are kept,
given another role, or deleted, and empty user or assistant turns are inserted,
at least total cost; of equal edits those with the least audit text are taken.
An automaton of four states (start, after the system turn, after a user turn,
after an assistant turn) reads the rows, so a stretch of rows maps a state to a
vector of four costs. A vector also ranks its states by the least audit that
reaches each of them at its cost: all those audits have as many row edits and
end in one, so none is the beginning of another, and comparing two whole audits
is comparing their beginnings. Halfway through, the forward vector from the
first state meets the backward vector from the last; the cheapest crossing of
the best rank is part of the answer, and both halves are solved by themselves.
Only vectors and the answer are held.

A conversation may hold most of the table. Rows are sorted over range slices
and packed into chunks; equal rows of one turn are one row with a count. A
chunk is a matrix of four vectors; the matrices of a conversation with several
chunks are multiplied up a tree, the crossings are chosen from its root down,
and then each chunk is solved by itself. The texts join the edits in one
shuffle. The digest of a conversation is one sequential hash, so that last pass
streams a conversation through one task, which holds its audit and a batch.

Faults of a row, the first counts: blank (nothing but white space), duplicate
(role and text were there earlier), truncated (the last character is none of
``.!?``). Blank and duplicate rows must go.

Defined cases: null roles and texts are one space; null turns come first; rows
of one turn are ordered by role, then by a hash of the text; a null
conversation id is one conversation; a conversation without present rows has
zeros, an empty audit and the digest of nothing; extra columns are left out;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.ranking import dense_positions
from ..scratch import cut, cut_with, sized
from .batches import ship

CHUNK = 4096
FAN = 1024
SPACE = " \t\n\x0b\x0c\r"
KEY = ["_none", "conv_id"]

# States: start, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, REROLE, INSERT, CUT_OFF = 3, 2, 2, 1
# The state that an inserted or reroled turn leads to, and inserts that end it.
NEXT = (USER, USER, ASSISTANT, USER)
TAIL = (0, 2, 1, 0)
# Codes of rows: initial, then whether the text is cut off or the row must go.
INITIALS = "sua"
OTHER, TRUNCATED, GONE = 3, 4, 8
LEGAL = {"su", "ua", "au"}


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of test faults dealt by a checksum;
    a dropped row has 0 copies, a repeated one 2."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key) % 20
    text = F.coalesce("text", space)
    return turns.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


@lru_cache(None)
def moves(code: int) -> tuple[dict[int, tuple[int, str]], ...]:
    """By state before and after a row: the cheapest edits, least text first."""
    table = []
    for before in range(4):
        best: dict[int, tuple[int, str]] = {}
        state, cost, text = before, 0, ""
        # More than two inserts come back to a state that was passed.
        for _ in range(3):
            ways = [(state, DELETE, "D")]
            if not code & GONE:
                extra, initial = (CUT_OFF if code & TRUNCATED else 0), code & 3
                ways.append((NEXT[state], REROLE + extra, "R"))
                if initial == 0 and state == START:
                    ways.append((SYSTEM, extra, "K"))
                elif initial in (1, 2) and NEXT[state] == (USER, ASSISTANT)[initial - 1]:
                    ways.append((NEXT[state], extra, "K"))
            for after, more, letter in ways:
                way = (cost + more, text + letter)
                best[after] = min(best.get(after, way), way)
            state, cost, text = NEXT[state], cost + INSERT, text + "I"
        table.append(best)
    return tuple(table)


Vector = tuple[tuple[int, int] | None, ...]  # (cost, rank) by state


def at(state: int) -> Vector:
    return tuple((0, 0) if s == state else None for s in range(4))


def _ranked(found: dict[int, tuple]) -> tuple[Vector, int]:
    """Vector over states from (cost, order...) and the cost taken off all."""
    least = min(f[0] for f in found.values())
    order = sorted(found, key=lambda s: found[s][1:])
    return tuple((found[s][0] - least, order.index(s)) if s in found else None for s in range(4)), least


@lru_cache(1 << 16)
def forward(vector: Vector, code: int) -> tuple[Vector, int]:
    """The vector after one more row; its costs start at 0, the rest apart."""
    found: dict[int, tuple] = {}
    for state, v in enumerate(vector):
        if v is not None:
            for after, (cost, text) in moves(code)[state].items():
                way = (v[0] + cost, v[1], text)
                found[after] = min(found.get(after, way), way)
    return _ranked(found)


@lru_cache(1 << 16)
def backward(costs: tuple, code: int) -> tuple[tuple, int]:
    """Costs to the end by state before one more row."""
    out = [min((cost + costs[after] for after, (cost, _) in moves(code)[s].items() if costs[after] is not None), default=None) for s in range(4)]
    least = min(c for c in out if c is not None)
    return tuple(None if c is None else c - least for c in out), least


def _run(vector: Vector, codes: bytes, lo: int, hi: int) -> tuple[Vector, int]:
    total = 0
    for k in range(lo, hi):
        vector, more = forward(vector, codes[k])
        total += more
    return vector, total


def crossing(vector: Vector, costs: tuple) -> int:
    """The cheapest state to meet in; of equal ones the least audit before it."""
    return min((v[0] + costs[s], v[1], s) for s, v in enumerate(vector) if v is not None and costs[s] is not None)[2]


def edits(codes: bytes, first: int, last: int) -> list[str]:
    """Cheapest edits of each row from state ``first`` to state ``last``."""
    out = [""] * len(codes)
    work = [(0, len(codes), first, last)]
    while work:
        lo, hi, a, b = work.pop()
        if hi - lo == 1:
            out[lo] = moves(codes[lo])[a][b][1]
            continue
        if hi == lo:
            continue
        mid = (lo + hi) // 2
        costs = tuple(0 if s == b else None for s in range(4))
        for k in range(hi - 1, mid - 1, -1):
            costs, _ = backward(costs, codes[k])
        meet = crossing(_run(at(a), codes, lo, mid)[0], costs)
        work += [(lo, mid, a, meet), (mid, hi, meet, b)]
    return out


def matrix(codes: bytes) -> list[list[int]]:
    """Cost and rank by state before and after all rows, -1 where none."""
    out = []
    for s in range(4):
        vector, total = _run(at(s), codes, 0, len(codes))
        out.append([x for v in vector for x in ((-1, -1) if v is None else (v[0] + total, v[1]))])
    return out


def _vector(flat: list) -> Vector:
    return tuple(None if flat[2 * s] < 0 else (flat[2 * s], flat[2 * s + 1]) for s in range(4))


def _through(vector: Vector, m: list) -> Vector:
    """A vector carried through a stretch given by its matrix."""
    found: dict[int, tuple] = {}
    for state, v in enumerate(vector):
        if v is not None:
            for after, w in enumerate(_vector(m[state])):
                if w is not None:
                    way = (v[0] + w[0], v[1], w[1])
                    found[after] = min(found.get(after, way), way)
    out, least = _ranked(found)
    return tuple(None if v is None else (v[0] + least, v[1]) for v in out)


def last_state(vector: Vector) -> tuple[int, int]:
    """Where all rows are read and the total cost with the last inserts."""
    state = crossing(vector, tuple(INSERT * n for n in TAIL))
    return state, vector[state][0] + INSERT * TAIL[state]


def cross_all(matrices: list, first: int, last: int) -> list[tuple[int, int]]:
    """States before and after each of several stretches, by the same halving."""
    out: list = [None] * len(matrices)
    work = [(0, len(matrices), first, last)]
    while work:
        lo, hi, a, b = work.pop()
        if hi - lo == 1:
            out[lo] = (a, b)
            continue
        mid = (lo + hi) // 2
        costs: tuple = tuple(0 if s == b else None for s in range(4))
        for m in reversed(matrices[mid:hi]):
            costs = tuple(min((w[0] + costs[t] for t, w in enumerate(_vector(m[s])) if w is not None and costs[t] is not None), default=None)
                          for s in range(4))
        vector = at(a)
        for m in matrices[lo:mid]:
            vector = _through(vector, m)
        meet = crossing(vector, costs)
        work += [(lo, mid, a, meet), (mid, hi, meet, b)]
    return out


# What a stretch of rows adds up to; two neighbours add up as well.
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
ENDS = ("first_turn", "last_turn", "low", "high", "first_role", "last_role")


def _joined(a: dict, b: dict) -> dict:
    out = {c: a[c] + b[c] for c in COUNTS}
    out["illegal"] += a["last_role"] + b["first_role"] not in LEGAL
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    out |= {"first_turn": a["first_turn"], "last_turn": b["last_turn"], "first_role": a["first_role"], "last_role": b["last_role"],
            "low": a["low"] if a["low"] is not None else b["low"], "high": b["high"] if b["high"] is not None else a["high"]}
    return out


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """Consecutive rows of a conversation as one row, in order within a slice."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    turn = kinds["turn"]
    names = ["_none", "conv_id", "turn", "role", "mark", "codes", "counts", "first_turn", "last_turn", "low", "high",
             "first_role", "last_role", *COUNTS, "extra", "matrix"]
    schema = (f"_none boolean, conv_id {kinds['conv_id']}, turn {turn}, role string, mark binary, codes binary, counts array<long>, "
              f"first_turn {turn}, last_turn {turn}, low {turn}, high {turn}, first_role string, last_role string, "
              + ", ".join(f"{c} long" for c in COUNTS) + ", extra long, matrix array<array<long>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        done: list = []
        types: list = []

        def close() -> None:
            head = held[0]
            codes, counts = bytearray(), []
            stat = dict.fromkeys(COUNTS, 0)
            last_turn, last_role, low = None, None, None
            for r in held:
                n, initial = r["copies"], r["role"][:1]
                gone = r["blank"] or r["repeat"]
                stat["blank"] += n if r["blank"] else 0
                stat["duplicate"] += 0 if r["blank"] else n if r["repeat"] else n - 1
                stat["truncated"] += bool(not gone and r["cut_off"])
                # Copies stand side by side, and no role may follow itself.
                stat["illegal"] += n - 1 + (last_role is not None and last_role + initial not in LEGAL)
                if r["turn"] is not None:
                    stat["turns"] += r["turn"] != last_turn
                    low = r["turn"] if low is None else low
                last_turn, last_role = r["turn"], initial
                code = INITIALS.find(initial) if initial in INITIALS and initial else OTHER
                codes.append(GONE if gone else code | (TRUNCATED if r["cut_off"] else 0))
                counts.append(n)
            done.append([head["_none"], head["conv_id"], head["turn"], head["role"], head["mark"], bytes(codes), counts,
                         head["turn"], last_turn, low, last_turn, head["role"][:1], last_role, *[int(stat[c]) for c in COUNTS],
                         DELETE * (sum(counts) - len(counts)), matrix(bytes(codes))])
            held.clear()

        def flush() -> pa.RecordBatch:
            conv, when = types
            kind = {"_none": pa.bool_(), "conv_id": conv, "role": pa.string(), "mark": pa.binary(), "codes": pa.binary(), "counts": pa.list_(pa.int64()),
                    "first_role": pa.string(), "last_role": pa.string(), "matrix": pa.list_(pa.list_(pa.int64())), "extra": pa.int64(),
                    **dict.fromkeys(COUNTS, pa.int64())}
            out = pa.RecordBatch.from_arrays([pa.array(c, kind.get(n, when)) for n, c in zip(names, zip(*done, strict=True), strict=True)], names)
            done.clear()
            return out

        for b in batches:
            types = [b.schema.field("conv_id").type, b.schema.field("turn").type]
            for r in b.to_pylist():
                if held and (len(held) >= chunk or held[0]["_none"] != r["_none"] or held[0]["conv_id"] != r["conv_id"]):
                    close()
                held.append(r)
            if len(done) >= 500:
                yield flush()
        if held:
            close()
        if done:
            yield flush()

    return rows.mapInArrow(run, schema)


def _up(nodes: DataFrame, fan: int) -> DataFrame:
    """Neighbouring stretches added up, ``fan`` at a time."""
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        parts = rows.sort_values("idx")["node"].tolist()
        total = {k: (None if pd.isna(v) else v) if k in ENDS else v for k, v in dict(parts[0]).items()}
        for p in parts[1:]:
            p = {k: (None if pd.isna(v) else v) if k in ENDS else v for k, v in dict(p).items()}
            both = _joined(total, p)
            vectors = [_through(_vector(m), p["matrix"]) for m in total["matrix"]]
            both["matrix"] = [[x for v in vec for x in ((-1, -1) if v is None else v)] for vec in vectors]
            both["extra"] = total["extra"] + p["extra"]
            total = both
        head = rows.iloc[0]
        return pd.DataFrame({"_none": [head["_none"]], "conv_id": [head["conv_id"]], "idx": [int(head["idx"]) // fan], "node": [total]})

    up = nodes.withColumn("_up", F.expr(f"idx div {fan}"))
    return up.groupBy(*KEY, "_up").applyInPandas(lambda rows: add(rows.drop(columns="_up")), nodes.schema)


def _down(nodes: DataFrame, above: DataFrame, fan: int) -> DataFrame:
    """States before and after each stretch, from those of the one above."""
    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        states = cross_all([n["matrix"] for n in rows["node"]], int(rows["first"].iloc[0]), int(rows["last"].iloc[0]))
        out = rows[["_none", "conv_id", "idx"]].copy()
        out["first"], out["last"] = [s for s, _ in states], [s for _, s in states]
        return out

    up = above.select(*KEY, F.col("idx").alias("_up"), "first", "last")
    schema = T.StructType([*[nodes.schema[c] for c in (*KEY, "idx")], T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
    met = nodes.withColumn("_up", F.expr(f"idx div {fan}")).join(up, [*KEY, "_up"])
    return met.groupBy(*KEY, "_up").applyInPandas(lambda rows: split(rows.drop(columns="_up")), schema)


ENDED = "last int, cost long"


def _ended(node: Column) -> Column:
    """Last state and total cost of a whole conversation from its matrix."""
    @F.pandas_udf(ENDED)
    def end(first_row: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([last_state(_vector(list(v))) for v in first_row], columns=["last", "cost"])

    return end(node["matrix"][START])


def solve(turns: DataFrame, copies: str | None = None, chunk: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, edits by chunk, totals by conversation) of rows conv_id, turn,
    role, text; the column ``copies`` tells how often a row is present."""
    spark = turns.sparkSession
    ship(spark)
    space = F.lit(" ")
    conv = F.col("conv_id")
    times = F.col(copies) if copies else F.lit(1)
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    bare = F.rtrim(text, F.lit(SPACE))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.select(
        F.isnull(conv).alias("_none"), F.coalesce(conv, F.lit("0").cast(turns.schema["conv_id"].dataType)).alias("conv_id"), "turn",
        role.alias("role"), text.alias("text"), F.substring(F.unhex(digest), 1, 16).alias("mark"), times.cast("long").alias("copies"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut_off"))
    order = [*KEY, "turn", "role", "mark"]
    present = rows.where("copies > 0")
    same = present.groupBy(*order).agg(F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("cut_off").alias("cut_off"))
    when = F.struct(F.isnotnull("turn").alias("given"), F.col("turn").alias("turn"))
    # A mark covers role and text; equal ones of a turn are one row by now.
    firsts = present.groupBy(*KEY, "mark").agg(F.min(when).alias("first"))
    flagged = same.join(firsts, [*KEY, "mark"]).withColumn("repeat", ~when.eqNullSafe(F.col("first"))).drop("first")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = flagged.repartitionByRange(n, *order).sortWithinPartitions(*order)
    chunks = cut(_chunks(sorted_rows, chunk).withColumn("pos", F.monotonically_increasing_id()))

    kept = [*ENDS, *COUNTS, "extra", "matrix"]
    node = F.struct(*kept)
    several, seen = cut_with(chunks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY))
    whole = chunks.join(sized(several, seen["rows"]), KEY, "left_anti")
    totals = whole.select(*KEY, node.alias("node"))
    states = None
    if seen["rows"]:
        parts = chunks.join(sized(several, seen["rows"]), KEY, "left_semi").select(*KEY, "pos", node.alias("node"))
        levels = [cut(dense_positions(parts, [F.col("pos")], KEY, name="idx").withColumn("idx", F.col("idx").cast("long")))]
        places = levels[0].select("pos", *KEY, "idx")
        levels[0] = levels[0].select(*KEY, "idx", "node")
        while levels[-1].agg(F.max("idx")).first()[0]:
            levels.append(cut(_up(levels[-1], fan)))
        totals = totals.unionByName(levels[-1].select(*KEY, "node"))
        states = levels[-1].select(*KEY, "idx", F.lit(START).alias("first"), _ended(F.col("node"))["last"].alias("last"))
        for level in reversed(levels[:-1]):
            states = cut(_down(level, states, fan))
        states = places.join(states, [*KEY, "idx"]).select("pos", "first", "last")
    told = whole.select(*order, "codes", "counts", F.lit(START).alias("first"), _ended(node)["last"].alias("last"))
    if states is not None:
        told = told.unionByName(chunks.join(states, "pos").select(*told.columns))
    solved = told.mapInArrow(_solved, ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in told.select(*order).schema) + ", edits array<string>, counts array<long>")
    ended = totals.withColumn("end", _ended(F.col("node")))
    gaps = F.coalesce(F.col("node.high") - F.col("node.low") + 1 - F.col("node.turns"), F.lit(0)).cast("long")
    totals = ended.select(*KEY, F.struct(
        gaps.alias("gaps"), *[F.col(f"node.{c}").alias(c) for c in COUNTS[:4]], (F.col("end.cost") + F.col("node.extra")).alias("cost")).alias("total"))
    texts = rows.select(*order, F.when(~F.col("blank") & (F.col("copies") > 0), F.col("text")).alias("text"), (F.col("copies") > 0).alias("present"))
    return texts, solved, totals


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [edits(c, a, z) for c, a, z in zip(*[b.column(c).to_pylist() for c in ("codes", "first", "last")], strict=True)]
        base = [b.column(c) for c in (*KEY, "turn", "role", "mark")]
        yield pa.RecordBatch.from_arrays([*base, pa.array(got, pa.list_(pa.string())), b.column("counts")],
                                         [*KEY, "turn", "role", "mark", "edits", "counts"])


class Rebuild:
    """One conversation read in order: edits of a chunk, then its texts."""

    def __init__(self):
        self.state, self.total, self.last = START, None, None
        self.units: Iterator[tuple[str, int]] = iter(())

    def _next(self, state: int) -> str:
        self.state = NEXT[state]
        return ("user", "assistant")[self.state - USER]

    def read(self, r: dict) -> Iterator[tuple[str, str | None, str | None]]:
        """(edit, role, text) of the row; role is None where it goes."""
        if r["total"] is not None:
            self.total = r["total"]
        elif r["edits"] is not None:
            self.units = iter(zip(r["edits"], r["counts"], strict=True))
        elif r["present"]:
            place = (r["turn"], r["role"], r["mark"])
            if place == self.last:
                return
            self.last = place
            letters, copies = next(self.units)
            for _ in letters[:-1]:
                yield "I", self._next(self.state), ""
            if letters[-1] == "K":
                self.state = SYSTEM + INITIALS.index(r["role"][0])
                yield "K", r["role"], r["text"]
            elif letters[-1] == "R":
                yield "R", self._next(self.state), r["text"]
            yield "D" * (copies - (letters[-1] != "D")), None, None

    def end(self) -> Iterator[tuple[str, str, str]]:
        for _ in range(TAIL[self.state]):
            yield "I", self._next(self.state), ""


def _streamed(turns: DataFrame, copies: str | None, chunk: int, fan: int) -> DataFrame:
    """Totals, edits and texts of each conversation side by side, in order."""
    texts, solved, totals = solve(turns, copies, chunk, fan)
    both = texts.withColumn("kind", F.lit(1)).withColumn("body", F.lit(1)).unionByName(
        solved.withColumn("kind", F.lit(0)).withColumn("body", F.lit(1)), allowMissingColumns=True).unionByName(
        totals.withColumn("kind", F.lit(0)).withColumn("body", F.lit(0)), allowMissingColumns=True)
    return both.repartition(*KEY).sortWithinPartitions(*KEY, "body", "turn", "role", "mark", "kind")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Rebuild, tuple | None]]:
    """Every edit with its conversation; None marks the end of one."""
    key, now = None, None
    for b in batches:
        for r in b.to_pylist():
            if now is None or key != (r["_none"], r["conv_id"]):
                if now is not None:
                    yield from ((key, now, e) for e in now.end())
                    yield key, now, None
                key, now = (r["_none"], r["conv_id"]), Rebuild()
            yield from ((key, now, e) for e in now.read(r))
    if now is not None:
        yield from ((key, now, e) for e in now.end())
        yield key, now, None


def _batches(rows: Iterator[list], names: list[str], kinds: list, size: int = 2000, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or weight >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def repaired(turns: DataFrame, copies: str | None = None, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """conv_id, position, edit (K, R or I), role, text of the repaired turns."""
    stream = _streamed(turns, copies, chunk, fan)
    kind = stream.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list]:
            place = 0
            for (none, conv), _, e in _conversations(batches):
                if e is None:
                    place = 0
                elif e[1] is not None:
                    yield [None if none else conv, place, *e]
                    place += 1

        yield from _batches(rows(), ["conv_id", "position", "edit", "role", "text"], [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string()])

    return stream.mapInArrow(run, f"conv_id {kind.simpleString()}, position long, edit string, role string, text string")


def digests(turns: DataFrame, copies: str | None = None, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Faults, cost, audit and digest of the repaired turns by conversation."""
    stream = _streamed(turns, copies, chunk, fan)
    kind = stream.schema["conv_id"].dataType
    figures = ["gaps", *COUNTS[:4], "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list]:
            audit, digest, some = [], hashlib.sha256(), False
            for (none, conv), now, e in _conversations(batches):
                if e is None:
                    total = now.total or dict.fromkeys(figures, 0)
                    yield [None if none else conv, *[total[c] for c in figures], "".join(audit), digest.hexdigest()]
                    audit, digest, some = [], hashlib.sha256(), False
                    continue
                audit.append(e[0])
                if e[1] is not None:
                    digest.update(f"{chr(10) if some else ''}{e[1]}:{e[2]}".encode())
                    some = True

        yield from _batches(rows(), ["conv_id", *figures, "audit", "repaired_sha256"],
                            [to_arrow_type(kind), *[pa.int64()] * len(figures), pa.string(), pa.string()])

    return stream.mapInArrow(run, f"conv_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in figures) + ", audit string, repaired_sha256 string")
