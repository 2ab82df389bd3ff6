"""Repair of conversations against a search that keeps whole audits."""

import hashlib
import random
import re
import zlib

import pytest

from terraloom.llm import queries, repair

WS = " \t\n\x0b\x0c\r"


def plain(rows):
    """Figures, audit and digest of rows (turn, role, text) in order."""
    seen, classes = set(), []
    for _, role, text in rows:
        bare = text.strip(WS)
        classes.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    # By state "", s, u, a: the least (cost, audit) with the turns it leaves.
    best = {"": (0, "", ())}

    def inserts(ways):
        out = dict(ways)
        for _ in range(2):
            for s, (c, a, said) in list(out.items()):
                new = "a" if s == "u" else "u"
                way = (c + 2, a + "I", (*said, "user:" if new == "u" else "assistant:"))
                if new not in out or way[:2] < out[new][:2]:
                    out[new] = way
        return out

    for (_, role, text), kind in zip(rows, classes, strict=True):
        found = {}

        def offer(state, way, found=found):
            if state not in found or way[:2] < found[state][:2]:
                found[state] = way

        # Inserts may make equal states by dearer ways whose audit is smaller, so all are tried.
        ways = [(s, w) for s, w in best.items()]
        for _ in range(2):
            ways += [("a" if s == "u" else "u", (c + 2, a + "I", (*said, "assistant:" if s == "u" else "user:"))) for s, (c, a, said) in ways]
        for s, (c, a, said) in ways:
            offer(s, (c + 3, a + "D", said))
            if kind in ("blank", "duplicate"):
                continue
            c += kind == "truncated"
            nxt = "a" if s == "u" else "u"
            offer(nxt, (c + 2, a + "R", (*said, ("assistant:" if s == "u" else "user:") + text)))
            if role[:1] == nxt or (role[:1] == "s" and s == ""):
                offer(role[0], (c, a + "K", (*said, f"{role}:{text}")))
        best = found
    cost, audit, said = min(inserts(best)[s] for s in ("", "a") if s in inserts(best))
    count = lambda k: classes.count(k)
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def by_conv(rows, convs):
    mark = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:16]
    out = {}
    for c in convs:
        mine = [(t, " " if r is None else r, " " if x is None else x) for k, t, r, x in rows if k == c]
        out[c] = plain(sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), mark(r[1], r[2]))))
    return out


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_damaged_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_conversation_repair(spark, sf)) == by_conv(damaged(rows), {r[0] for r in rows})


def odd(seed, n):
    rng = random.Random(seed)
    texts = ["ok.", "ok", "", " \n", "why?", "é!", None, "no.\x0b"]
    rows = []
    for conv in (1, 2, None, 4):
        for k in range(n):
            rows.append((conv, rng.choice([k, k, k + 3, None]), rng.choice(["user", "assistant", "system", "tool", None, "", "u2"]),
                         rng.choice(texts) if rng.random() < 0.4 else f"text {rng.randrange(n)}{rng.choice('.x')}"))
    rows += [(5, 1, "user", "one " * 50_000), (6, None, "user", None), (7, 3, "system", "be.")]
    return rows


@pytest.mark.parametrize("chunk,fan,n", [(1, 2, 30), (3, 2, 30), (7, 5, 60), (4096, 1024, 60)])
def test_chunks_and_tree(spark, chunk, fan, n):
    rows = odd(chunk, n)
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, mark string, copies int")
    assert got(repair.digests(df, chunk=chunk, fan=fan)) == by_conv(rows, {r[0] for r in rows})


def test_repaired_turns(spark):
    rows = odd(9, 40)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = by_conv(rows, {r[0] for r in rows})
    out = {}
    for r in sorted(repair.repaired(df, chunk=5).collect(), key=lambda r: (str(r.conv_id), r.position)):
        out.setdefault(r.conv_id, []).append(r)
    for conv, w in want.items():
        mine = out.get(conv, [])
        assert "".join(r.edit for r in mine) == w[6].replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in mine))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == w[7]


@pytest.mark.parametrize("seed", range(20))
def test_halving_gives_the_least_audit(seed):
    rng = random.Random(seed)
    for _ in range(30):
        rows = [(k, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "", f"{k}."])) for k in range(rng.randrange(1, 14))]
        seen, codes = set(), bytearray()
        for _, role, text in rows:
            gone = not text or (role, text) in seen
            seen.add((role, text))
            initial = "sua".find(role[0])
            codes.append(repair.GONE if gone else (initial if initial >= 0 else repair.OTHER) | (0 if text.endswith(".") else repair.TRUNCATED))
        vector, total = repair._run(repair.at(0), bytes(codes), 0, len(codes))
        last, cost = repair.last_state(vector)
        audit = "".join(repair.edits(bytes(codes), 0, last)) + "I" * repair.TAIL[last]
        assert (total + cost, audit) == plain(rows)[5:7]


def test_repeated_rows_and_no_rows(spark):
    rows = [(1, 4, "user", "same.")] * 3000 + [(1, 5, "assistant", "yes.")] + [(2, 1, "user", "")] * 5
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = got(repair.digests(df))
    assert out[1][1:7] == (0, 2999, 0, 2999, 3 * 2999, "K" + "D" * 2999 + "K") and out[2][5:7] == (15, "DDDDD")
    nothing = hashlib.sha256(b"").hexdigest()
    gone = df.selectExpr("*", "0 as times")
    assert got(repair.digests(gone, copies="times")) == {k: (0, 0, 0, 0, 0, 0, "", nothing) for k in (1, 2)}
    assert repair.digests(df.limit(0)).count() == 0
    assert repair.repaired(df.limit(0)).count() == 0
