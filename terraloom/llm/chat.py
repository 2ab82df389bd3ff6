"""Chat formatting in budgeted windows with a loss mask.

Prefix sums of turn tokens choose turn-aligned windows: a conversation has
``budget - history - system`` tokens of new turns in each. Every window opens
with the system turn, then repeats up to ``history`` tokens of the turns
before it, then has its new turns; only new assistant turns carry loss, so
each target counts once. Prefix sums are taken per range slice, so one
conversation with a third of all turns spreads over tasks, and a window is a
group of bounded size.

Turns stand between ``<|turn|>role<|says|>`` and ``<|end|>``. Control strings
inside roles and texts are broken by a backslash after their first character,
and backslashes are doubled, so texts read back exactly.

Defined cases: null roles and texts are empty; turns of one number are
ordered by role, then text; null turns come first; a null conv_id is a
conversation of its own; a turn over the budget has a window of its own and
is never cut; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import dense_positions, running_sum
from ..scratch import cut
from .batches import ship

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Control strings of this and of other common templates.
CONTROL = (TURN, SAYS, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
BUDGET, HISTORY = 512, 128
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(c: Column) -> Column:
    """Backslashes doubled, control strings broken after their first character."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for x in CONTROL:
        c = F.replace(c, F.lit(x), F.lit(x[0] + "\\" + x[1:]))
    return c


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def token_count(role: Column, text: Column) -> Column:
    """Tokens of a turn: a quarter of its bytes and four for the marks.

    Give ``windows`` another expression to count with a real tokenizer.
    """
    return (F.ceil((F.octet_length(role) + F.octet_length(text)) / 4) + 4).cast("long")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=token_count) -> DataFrame:
    """conv_id, window, formatted, loss, new_from, n_turns.

    ``loss`` has the bounds start, end, ... (code points) of the new assistant
    texts in ``formatted``; ``new_from`` is how many leading turns are repeats;
    ``n_turns`` how many turns there are.
    """
    conv, empty = F.col("conv_id"), F.lit("")
    filled = F.coalesce(conv, F.lit("0").cast(turns.schema["conv_id"].dataType))
    rows = turns.select(
        F.isnull(conv).alias("_none"), filled.alias("conv_id"), "turn",
        F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    key = ["_none", "conv_id"]
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    numbered = cut(dense_positions(rows, order, key, name="k").withColumn("tokens", tokens(F.col("role"), F.col("text"))))
    is_system = (F.col("k") == 0) & (F.col("role") == "system")
    # Texts stay out of the pass that adds up.
    summed = running_sum(numbered.select(*key, "k", "tokens"), "tokens", [F.col("k")], key).select(*key, "k", "running")
    system = numbered.where(is_system).select(*key, F.col("text").alias("s_text"), F.col("tokens").alias("s_tokens"))
    placed = numbered.join(summed, [*key, "k"]).join(system, key, "left")
    s_tokens = F.coalesce("s_tokens", F.lit(0))
    placed = placed.withColumn("room", F.greatest(F.lit(1), F.lit(budget - history) - s_tokens).cast("long"))
    placed = placed.withColumn("begin", F.greatest(F.lit(0), F.col("running") - F.col("tokens") - s_tokens).cast("long"))
    # A cell holds the turns that begin in it. A turn may be history in later
    # cells whose first turn can begin within ``history`` tokens of its own.
    cell = F.floor(F.col("begin") / F.col("room")).cast("long")
    reach = F.floor((F.col("begin") + F.lit(history)) / F.col("room")).cast("long")
    placed = placed.withColumn("own", cell)
    cells = F.when(is_system, F.array("own")).otherwise(F.sequence("own", reach))
    said = F.struct(
        "k", "begin", (F.col("begin") + F.col("tokens")).alias("end"), (F.col("own") == F.col("cell")).alias("new"),
        escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("target"))
    grouped = placed.withColumn("cell", F.explode(cells)).groupBy(*key, "cell").agg(
        F.sort_array(F.collect_list(said)).alias("said"), F.max("s_text").alias("s_text"), F.max("room").alias("room"))
    fresh = F.filter("said", lambda x: x["new"])
    grouped = grouped.withColumn("fresh", fresh).where(F.size("fresh") > 0)
    # When the last turn runs over the room, it gets a window of its own.
    last = F.element_at("fresh", -1)
    over = (F.size("fresh") > 1) & (last["end"] - F.col("fresh")[0]["begin"] > F.col("room"))
    grouped = grouped.withColumn("last_k", F.when(over, last["k"])).withColumn(
        "part", F.explode(F.when(over, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))

    def mine(x: Column) -> Column:
        return x["new"] & (F.col("last_k").isNull() | ((x["k"] == F.col("last_k")) == (F.col("part") == 1)))

    grouped = grouped.withColumn("from", F.array_min(F.transform(F.filter("said", mine), lambda x: x["k"])))
    first = F.filter("said", lambda x: x["k"] == F.col("from"))[0]["begin"]
    grouped = grouped.withColumn("first", first)
    kept = F.filter("said", lambda x: mine(x) | ((x["k"] < F.col("from")) & (F.col("first") - x["begin"] <= history)))
    turn = F.transform(kept, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), mine(x).alias("new"),
                                                x["target"].alias("target"), x["k"].alias("k")))
    grouped = grouped.withColumn("kept", turn)
    opening = F.array(F.struct(F.lit("system").alias("role"), escape(F.col("s_text")).alias("text"), F.lit(False).alias("new"),
                               F.lit(False).alias("target"), F.lit(-1).cast("long").alias("k")))
    grouped = grouped.withColumn("kept", F.when(F.col("s_text").isNotNull() & (F.col("kept")[0]["k"] > 0), F.concat(opening, "kept")).otherwise(F.col("kept")))
    frame = len(TURN) + len(SAYS) + len(END)
    size = F.transform("kept", lambda x: F.length(x["role"]) + F.length(x["text"]) + frame)
    grouped = grouped.withColumn("size", size)
    # Where each turn's text starts: all turns before it, then its own head.
    starts = F.transform("kept", lambda x, i: F.aggregate(F.slice("size", 1, i), F.lit(0), lambda a, b: a + b) + F.length(x["role"]) + len(TURN + SAYS))
    grouped = grouped.withColumn("at", starts)
    bounds = F.transform("kept", lambda x, i: F.when(x["new"] & x["target"], F.array(F.col("at")[i], F.col("at")[i] + F.length(x["text"]))).otherwise(F.array().cast("array<int>")))
    text = F.transform("kept", lambda x: F.concat(F.lit(TURN), x["role"], F.lit(SAYS), x["text"], F.lit(END)))
    return grouped.select(
        F.when(~F.col("_none"), F.col("conv_id")).alias("conv_id"), (F.col("cell") * 2 + F.col("part")).alias("window"),
        F.array_join(text, "").alias("formatted"), F.flatten(bounds).alias("loss"),
        F.size(F.filter("kept", lambda x: ~x["new"])).cast("long").alias("new_from"), F.size("kept").cast("long").alias("n_turns"))


def read_window(formatted: str, new_from: int) -> list[tuple[str, str]]:
    """(role, text) of the new turns of a window."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)[new_from:]]


def digests(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts read back from windows, per conversation.

    Windows of a conversation stream through one task in order (a digest of
    one long text has to); only the running digests are held.
    """
    ship(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state, key, kind = None, None, pa.int64()

        def close(done: list) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c) for c in cols[1:]]], names)

        done: list = []
        for b in batches:
            kind = b.schema.field("conv_id").type
            for conv, text, loss, new_from in zip(*[b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss", "new_from")], strict=True):
                if state is None or conv != key:
                    if state is not None:
                        done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_window(text, new_from):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for i in range(0, len(loss), 2):
                    target = unescape(text[loss[i] : loss[i + 1]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
            if len(done) >= 1000:
                yield close(done)
                done = []
        if state is not None:
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        if done:
            yield close(done)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
