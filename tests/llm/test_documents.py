"""Operators over documents, against brute force on small tables."""

import datetime as dt
import hashlib
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest

from terraloom.llm import batches, decontaminate, mixing, passages, pii, queries, simhash, toxicity


def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def keep(rows, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in rows}


# --- words ----------------------------------------------------------------------


def test_words_equal_the_patterns():
    texts = ["Ab-c ÄÖ 12_3", None, "", "a", "ß x \x0b\x1f\x7f~", "x" * 70 + " " + "y" * 9, "\x00"]
    data, offsets = batches.text_bytes(pa.array(texts))
    for kind, pattern in ((batches.ALNUM, brute.WORD1), (batches.NON_SPACE, brute.WORD2)):
        w = batches.Words(data, offsets, kind)
        got = [[w.low[a:b].tobytes().decode() for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
        assert got == [pattern.findall(brute.lower(t)) for t in texts]
        joined, begins, ends = w.joined()
        assert [joined[a:b].decode() for a, b in zip(begins, ends, strict=True)] == [x for t in got for x in t]
        assert len(set(w.hashes().tolist())) == len({x for t in got for x in t})


# --- decontamination --------------------------------------------------------------


def test_contamination_equals_brute_force(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = keep(queries.op1_benchmark_decontamination(spark, sf).collect(), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.contamination(docs(spark, sf), items)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contamination_of_odd_rows(spark, block_bytes):
    item = "a b c d e f g h i j k l m n o p"
    rows = [(1, f"x {item.upper()} y"), (2, "b c d e f g h i j k l m"), (3, "short ITEM!"), (4, None), (5, ""), (6, "a b c d e f g h i j k l m " * 2), (7, "short"),
            (8, " ".join(["pad"] * 5000) + " " + item)]
    items = [(1, item), (2, item), (3, "short item"), (4, None), (5, " - "), (10, "single"), (11, "a b c d e f g h i j k l m z")]
    d = spark.createDataFrame([(*r, "clash") for r in rows + [(1, f"x {item.upper()} y")]], "doc_id long, text string, row string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, extra int")
    out = decontaminate.verdict(decontaminate.scan(d, b, block_bytes=block_bytes)).select("_row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest").collect()
    assert keep(out, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.contamination(rows, items)
    assert len(out) == 9 and keep(out, "longest")[1] == (16,) and keep(out, "longest")[3] == (2,)
    kept = decontaminate.decontaminate(d, b, block_bytes=block_bytes)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {2, 4, 5, 7, 8}
    assert decontaminate.decontaminate(d, b.limit(0)).count() == 9 and decontaminate.decontaminate(d.limit(0), b).count() == 0


# --- SimHash ----------------------------------------------------------------------


def test_components_equal_brute_force(spark, sf):
    prints = [(d, brute.fingerprint(t)) for d, t in docs(spark, sf)]
    low = brute.near_components(prints)
    got = keep(queries.op2_simhash_near_dedup(spark, sf).collect(), "fingerprint", "component_id")
    assert got == {d: (f"{x:016x}", low[d]) for d, x in prints}


@pytest.mark.parametrize("bucket", [2, 32])
def test_links_keep_every_component(spark, bucket):
    """Groups of fingerprints a few bits apart, in crowded buckets and not."""
    g = np.random.default_rng(5)
    made = set()
    for _ in range(12):
        x = int(g.integers(0, 1 << 63)) * 2 + 1
        for _ in range(30):
            y = x
            for b in g.choice(64, g.integers(1, 5), replace=False).tolist():
                y ^= 1 << b
            made |= {x, y}
    made = sorted(made)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in made]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 2, bucket=bucket).collect()
    up = {s: s for s in signed}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for e in edges:
        up[top(e.src)] = top(e.dst)
    want = brute.near_components(zip(signed, made, strict=True))
    mine = {}
    for s in signed:
        mine.setdefault(top(s), set()).add(s)
    theirs = {}
    for s in signed:
        theirs.setdefault(want[s], set()).add(s)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_thresholds_add_up():
    cost = [{-1: 0.0, 0: 5.0, 1: 50.0, 2: 500.0}, {-1: 0.0, 0: 100.0, 1: 900.0, 2: 9000.0}, {-1: 0.0, 0: 7.0, 1: 60.0, 2: 600.0}]
    assert simhash.allocate(cost, 0)[1] == [1, -1, 0]
    assert simhash.allocate(cost[:2], 1)[1] == [1, 0]


def test_one_row_of_each_component_stays(spark, odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    # Null, empty and blank texts are one component; the repeated row is there once.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows)[0] == (False, 1)
    assert [r.doc_id for r in rows].count(4) == 1 and not {2, 3} & {r.doc_id for r in rows}
    assert simhash.keep_one(no_docs).count() == 0
    assert simhash.components(odd_docs).count() == 9


# --- toxicity ---------------------------------------------------------------------


def test_misspellings_score_high_on_held_out_rows(spark):
    g = np.random.default_rng(1)
    words = ["".join(g.choice(list("aeinorst"), 5)) for _ in range(300)]
    bad = ["scoundrel", "blockhead", "rascal"]
    rows, labels = [], []
    for i in range(1600):
        text, toxic = g.choice(words, 40).tolist(), int(i % 4 == 0)
        if toxic:
            text[int(g.integers(40))] = str(g.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, lab, toxicity.not_held_out())
    out = {r.doc_id: r.score for r in toxicity.score(d, model, keep=["doc_id"]).select("_row.doc_id", "score").collect()}
    held = [i for i in range(1600) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((out[i] >= 0.3) == (i % 4 == 0) for i in held)
    assert right >= 0.9 * len(held)
    odd = toxicity._scores(pa.array([" ".join(words[:39] + ["scoundrels"]), " ".join(words[:40])]), model)[0].to_pylist()
    assert odd[0] > odd[1]
    # The same rows in another order give the same model.
    again = toxicity.fit(d.orderBy("text"), lab, toxicity.not_held_out())
    assert np.array_equal(model.gain, again.gain)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (5, 0), (1, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    every = toxicity.F.lit(True)
    out = toxicity.score(odd_docs, toxicity.fit(odd_docs, labels, every)).select("_row.*", toxicity.F.col("score").alias("s")).collect()
    assert len(out) == 9 and all(0 <= r.s <= 1 for r in out)
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels, every)).count() == 0
    one = toxicity.fit(odd_docs, labels.where("toxic = 1"), every)
    assert one.gain.any() == np.False_


def test_long_texts_are_learned_from(spark):
    """A class whose texts are all long is learned, and the bytes stay bounded."""
    said = {0: "good calm words here ", 1: "vile nasty slurs shouted "}
    rows = [(k, said[k % 2] * (800 if k % 2 else 3)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    sample, prior = toxicity.training_rows(df, labels, toxicity.F.lit(True))
    assert sample.count() == 60 and prior == 0.5
    model = toxicity.fit(df, labels, toxicity.F.lit(True))
    got = {r.d: r.s for r in toxicity.score(df, model).select(toxicity.F.col("_row.doc_id").alias("d"), toxicity.F.col("score").alias("s")).collect()}
    assert all((got[k] >= 0.5) == (k % 2 == 1) for k in got)
    few, _ = toxicity.training_rows(df, labels, toxicity.F.lit(True), most_bytes=100_000)
    sizes = [(r.toxic, len(r.text)) for r in few.collect()]
    assert sum(n for t, n in sizes if t == 1) <= 50_000 and {t for t, _ in sizes} == {0, 1} and sum(t == 0 for t, _ in sizes) == 30


# --- passages ---------------------------------------------------------------------


def test_repeated_passages_are_covered(spark, sf):
    found = queries.op5_substring_dedup(spark, sf).collect()
    words = {d: brute.WORD1.findall(brute.lower(t)) for d, t in docs(spark, sf)}
    seen, need = {}, {}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            key = tuple(words[d][i : i + 50])
            if seen.setdefault(key, d) != d:
                need.setdefault(d, set()).update(range(i, i + 50))
    covered = {}
    for r in found:
        assert r.other_id < r.doc_id and r.n_equal >= 0.8 * max(r.end - r.start, r.other_end - r.other_start)
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert need and all(p <= covered.get(d, set()) for d, p in need.items())


def test_fuzzy_passage_and_clean_text(spark):
    g = np.random.default_rng(2)
    word = lambda: "".join(g.choice(list("abcdefghijkl"), 6))
    part = [word() for _ in range(120)]
    fuzzy = [w if i % 17 else word() for i, w in enumerate(part)]
    del fuzzy[60]
    pad = lambda n: [word() for _ in range(n)]
    rows = [(1, pad(80) + part + pad(30)), (2, pad(50) + fuzzy + pad(200)), (3, pad(300)), (4, part[:30] + pad(100)), (5, pad(10) + part), (5, pad(10) + part), (6, [])]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(7, None), (None, " ".join(part))], "doc_id long, text string")
    out = passages.passages(d).collect()
    pairs = {(r.doc_id, r.other_id) for r in out}
    assert pairs == {(2, 1), (5, 1)}
    r = next(r for r in out if r.doc_id == 2)
    assert 50 <= r.start <= 55 and 163 <= r.end <= 172 and r.n_equal >= 105
    assert passages.passages(d.limit(0)).count() == 0

def test_fuzzy_passages_down_to_four_in_five(spark):
    """50 words and more with 80 to 95 of 100 equal, spread evenly or at random."""
    g = np.random.default_rng(8)
    word = lambda: "".join(g.choice(list("abcdefghijkl"), 6))
    rows, spans = [], {}
    for size in (50, 80, 200):
        for step in (5, 8, 10, 0, 0, 0):
            part = [word() for _ in range(size)]
            changed = range(step // 2, size, step) if step else g.choice(size - 4, size // int(g.integers(5, 20)), replace=False) + 2
            fuzzy = list(part)
            for i in changed:
                fuzzy[i] = word()
            k = 2 * len(spans)
            rows += [(k, [word() for _ in range(70)] + part + [word() for _ in range(40)]), (k + 1, [word() for _ in range(30)] + fuzzy + [word() for _ in range(90)])]
            spans[k + 1] = set(range(30, 30 + size))
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    covered = {}
    for r in passages.passages(d).collect():
        assert r.other_id == r.doc_id - 1
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert covered.keys() == spans.keys()
    assert all(len(spans[k] & covered[k]) >= 0.9 * len(spans[k]) for k in spans)

def test_chains_alike_as_a_whole_are_found_in_bulk(monkeypatch):
    import pyarrow as pa

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    words = [f"w{i}" for i in range(400)]
    mine = words[50:130] + [f"x{i}" for i in range(30)]
    hashes = passages._word_lists(pa.array([" ".join(mine)]))[0]
    item = [{"doc": 7, "chain": chain, "base": 0, "words": hashes.tobytes()} for chain in ([0, 50, 80], [0, 50, 40, 41, 91, 39], [0, 50, 81], [0, 350, 80])]
    kind = pa.list_(pa.struct([("doc", pa.int64()), ("chain", pa.list_(pa.int32())), ("base", pa.int32()), ("words", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array([3]), pa.array([" ".join(words)]), pa.array([item], kind)], ["rep", "text", "items"])
    slow = []
    real = passages.align
    monkeypatch.setattr(passages, "align", lambda *a: slow.append(a) or real(*a))
    run = passages._align_all(Rows(), passages.MIN_WORDS, passages.SIMILARITY)
    out = [r for b in run(iter([batch])) for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    # Only the chains with a run that is not equal go one by one.
    assert out == [(7, 3, 0, 80, 50, 130, 80)] * 2 and len(slow) <= 2


def test_passages_of_shared_lines(spark):
    """A passage whose lines of under 50 words all occur alone in earlier documents."""
    g = np.random.default_rng(9)
    word = lambda: "".join(g.choice(list("abcdefghijkl"), 6))
    pad = lambda n: [word() for _ in range(n)]
    lines = [pad(30) for _ in range(3)]
    whole = sum(lines, [])
    fuzzy = [w if i % 9 != 4 else word() for i, w in enumerate(whole)]
    rows = [(k + 1, pad(60) + line + pad(60)) for k, line in enumerate(lines)]
    rows += [(11, pad(20) + whole + pad(70)), (12, pad(50) + whole + pad(20)), (13, pad(10) + fuzzy + pad(20))]
    # Later on the lines occur alone again, between two holders of the passage.
    rows += [(20 + k, pad(60) + line + pad(60)) for k, line in enumerate(lines)] + [(31, pad(15) + whole + pad(15))]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    covered = {}
    for r in passages.passages(d).collect():
        assert r.other_id in (11, 12, 13)
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert covered.keys() == {12, 13, 31}
    for k, lo in ((12, 50), (13, 10), (31, 15)):
        assert len(covered[k] & set(range(lo, lo + 90))) >= 85


def test_passage_whose_seeds_lie_in_others_before_and_between(spark):
    """Neither the first document with a seed nor the last one before is its holder."""
    g = np.random.default_rng(21)
    word = lambda: "".join(g.choice(list("abcdefghijkl"), 6))
    pad = lambda n: [word() for _ in range(n)]
    part = pad(60)
    fuzzy = [word() if i % 6 == 5 else w for i, w in enumerate(part)]
    runs = [part[i : i + 5] for i in range(0, 60, 6)]
    rows = [(k, pad(60) + run + pad(60)) for k, run in enumerate(runs)] + [(20, pad(30) + part + pad(40))]
    rows += [(30 + k, pad(60) + run + pad(60)) for k, run in enumerate(runs)] + [(50, pad(25) + fuzzy + pad(25))]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    out = passages.passages(d).collect()
    assert {(r.doc_id, r.other_id) for r in out} == {(50, 20)}
    assert len(set(range(25, 85)) & {w for r in out for w in range(r.start, r.end)}) >= 54


def test_links_are_all_runs_of_all_pairs():
    import pyarrow as pa

    g = np.random.default_rng(22)
    texts = [[f"w{x}" for x in g.integers(0, 4, int(n))] for n in g.integers(3, 40, 12)]
    seeds = list(zip(*passages._seeds(np.arange(12), pa.array([" ".join(t) for t in texts])), strict=True))
    h, *rest = (np.concatenate(c) for c in seeds)
    whole = [np.concatenate(c) for c in zip(*passages._links_of(h, *rest), strict=True)]
    parts = list(passages._links_of(h, *rest, at_once=50))
    assert max(len(p[0]) for p in parts) <= 50 and passages._n_links(h, *rest) == len(whole[0])
    assert sorted(zip(*[np.concatenate(c) for c in zip(*parts, strict=True)], strict=True)) == sorted(zip(*whole, strict=True))
    k, brute_runs = passages.K, set()
    for d, a in enumerate(texts):
        for r, b in enumerate(texts[:d]):
            for x in range(len(a)):
                for y in range(len(b)):
                    if x and y and a[x - 1] == b[y - 1]:
                        continue
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    if n >= k:
                        brute_runs.add((d, r, x, y, n))
    words = {}
    for d, r, *_, n in brute_runs:
        words[d, r] = words.get((d, r), 0) + n
    assert {tuple(r) for r in passages._runs_of(*whole).tolist()} == {r for r in brute_runs if words[r[:2]] >= passages.LEAST_WORDS}


def test_chains_equal_quadratic_search():
    g = np.random.default_rng(3)
    for _ in range(40):
        n = int(g.integers(1, 12))
        seg = np.stack([np.sort(g.choice(200, n, replace=False)), g.choice(200, n, replace=False), g.integers(1, 8, n), np.ones(n, int)], axis=1)
        best = []
        for i in range(n):
            x, y, k = seg[i, :3]
            top = 0.0
            for j in range(i):
                a, b = x - seg[j, 0] - seg[j, 2], y - seg[j, 1] - seg[j, 2]
                if a >= 0 and b >= 0:
                    top = max(top, best[j] - passages.GAP_COST * (a + b))
            best.append(k + top)
        first = passages.chains(seg)[0]
        got = sum(seg[c, 2] for c in first) - sum(passages.GAP_COST * (seg[b, 0] - seg[a, 0] - seg[a, 2] + seg[b, 1] - seg[a, 1] - seg[a, 2]) for a, b in zip(first, first[1:], strict=False))
        # Only chains over gaps of more than MAX_GAP words may score less.
        assert got <= max(best) + 1e-9 and (got >= max(best) - 1e-9 or max(best) > seg[:, 2].max())

def test_chains_find_the_near_run_behind_a_long_one():
    """A long run too far away doesn't hide a short one within the gap."""
    seg = np.array([[0, 0, 500, 1], [545, 545, 30, 1], [585, 585, 30, 1]])
    assert [1, 2] in passages.chains(seg)
    g = np.random.default_rng(6)
    for _ in range(60):
        n = int(g.integers(2, 14))
        seg = np.stack([np.sort(g.choice(300, n, replace=False)), g.choice(300, n, replace=False), g.integers(1, 60, n), np.ones(n, int)], axis=1)
        best = []
        for i in range(n):
            top = 0.0
            for j in range(i):
                a, b = seg[i, :2] - seg[j, :2] - seg[j, 2]
                if 0 <= a <= passages.MAX_GAP and 0 <= b <= passages.MAX_GAP:
                    top = max(top, best[j] - passages.GAP_COST * (a + b))
            best.append(seg[i, 2] + top)
        first = passages.chains(seg)[0]
        gaps = [seg[b, :2] - seg[a, :2] - seg[a, 2] for a, b in zip(first, first[1:], strict=False)]
        assert sum(seg[c, 2] for c in first) - passages.GAP_COST * sum(int(x.sum()) for x in gaps) == pytest.approx(max(best))


def test_chains_of_repetitive_texts():
    """Scores equal the quadratic search; steps grow in proportion to the runs."""
    g = np.random.default_rng(12)
    seg = np.unique(np.stack([g.integers(0, 400, 700), g.integers(0, 400, 700)], axis=1), axis=0)
    seg = np.column_stack([seg, g.integers(1, 12, len(seg))])
    seg = seg[np.lexsort((seg[:, 1], seg[:, 0]))]
    best = np.zeros(len(seg))
    for i, (x, y, k) in enumerate(seg):
        a, b = x - seg[:i, 0] - seg[:i, 2], y - seg[:i, 1] - seg[:i, 2]
        near = (a >= 0) & (b >= 0) & (a <= passages.MAX_GAP) & (b <= passages.MAX_GAP)
        best[i] = k + max(0.0, (best[:i] - passages.GAP_COST * (a + b))[near].max(initial=0.0))
    first = passages.chains(seg)[0]
    gaps = sum(int((seg[b, :2] - seg[a, :2] - seg[a, 2]).sum()) for a, b in zip(first, first[1:], strict=False))
    assert seg[first, 2].sum() - passages.GAP_COST * gaps == pytest.approx(best.max())
    pushed = []
    real = passages.heapq.heappush
    passages.heapq.heappush = lambda heap, x: (pushed.append(1), real(heap, x))
    try:
        for n in (1000, 4000):
            pushed.clear()
            # Every run is near every other one in the second text.
            rows = np.column_stack([np.arange(n) // 8, g.integers(0, 40, n), np.ones(n, int)])
            passages.chains(rows[np.lexsort((rows[:, 1], rows[:, 0]))])
            assert len(pushed) <= 12 * n
    finally:
        passages.heapq.heappush = real


# --- mixing -----------------------------------------------------------------------


def test_mix_meets_targets(spark, sf):
    t = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    size = {d: len(brute.WORD2.findall(x or "")) for d, _, x in t}
    total = {}
    for d, s, _ in t:
        total[s] = total.get(s, 0) + size[d]
    want = brute.waterfill(total)
    out = queries.op9_mixing(spark, sf).collect()
    assert len(out) == len(t)
    got = {}
    for r in out:
        assert r["size"] == size[r.doc_id] and r.source_size == total[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        got[r.source] = got.get(r.source, 0) + r.taken
    for s in want:
        assert abs(got[s] - want[s]) <= max(size[d] for d, x, _ in t if x == s)
    again = {r.doc_id: r.taken for r in queries.op9_mixing(spark, sf).collect()}
    assert again == {r.doc_id: r.taken for r in out}


def test_split_sources_meet_targets(spark):
    """Small slots: several levels of the tree, a source with most rows."""
    g = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(g.integers(1, 200))), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(d, slot_rows=40).collect()
    taken, aim = {}, {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        aim[r.source] = r.target
    assert len(out) == 3000 and all(abs(taken[s] - aim[s]) <= 200 for s in aim)


def test_pivot_keeps_words_and_chances():
    sizes, p = [90, 50, 40, 20, 10, 5, 5], [0.3] * 7
    total, counts = sum(s * q for s, q in zip(sizes, p, strict=True)), np.zeros(7)
    for k in range(4000):
        out, at, rest = mixing.pivot(sizes, p, np.random.default_rng(k).random(7).tolist())
        real = [rest if i == at else c for i, c in enumerate(out)]
        assert sum(s * c for s, c in zip(sizes, real, strict=True)) == pytest.approx(total)
        counts += real
    assert np.allclose(counts / 4000, 0.3, atol=0.04)


def test_mix_keeps_the_chance_of_every_document(spark):
    """Two documents of unlike size in each of many sources, and of one large source."""
    rows = [(2 * s + k, f"s{s:04d}", " ".join(["w"] * n)) for s in range(700) for k, n in enumerate((90, 50))]
    rows += [(10_000 + k, "z", " ".join(["w"] * (90, 50, 7)[k % 3])) for k in range(1500)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), slot_rows=100).collect()
    off = {}
    for r in out:
        each = r.target / r.source_size
        off.setdefault((r.source == "z", r["size"]), []).append(r.copies - each)
    assert len(out) == len(rows) and all(abs(np.mean(v)) < 4 * np.std(v) / len(v) ** 0.5 + 1e-9 for v in off.values())
    assert any(np.std(v) > 0.2 for v in off.values())


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    out = mixing.mix(odd_docs).collect()
    assert len(out) == 9 and sum(r["size"] == 0 and r.taken == 0 for r in out) == 3
    assert mixing.mix(no_docs).count() == 0


# --- personal data ----------------------------------------------------------------

VALUES = [
    "jo.81@mail7.example.com", "4111 1111 1111 1111", "4111111111111111", "+1 (183) 555-1276", "183-555-1276", "84.27.175.186", "2024-02-29", "31/12/1999",
    "078-05-1120", "GB82 WEST 1234 5698 7654 32", "681c09b8e90e7e8c9575180f595f646cf2969054", "DE89370400440532013000", "+49 30 1234567",
]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_one(n):
    p = pii.Permutation(b"key", "kind", n)
    out = [p.apply(x) for x in range(n)]
    assert sorted(out) == list(range(n)) and [p.undo(y) for y in out] == list(range(n))


@pytest.mark.parametrize("value", VALUES)
def test_values_change_within_their_format_and_come_back(value):
    text = f'See "{value}", again $$${value}### end.'
    new, seen = pii.Pseudonyms(b"key").rewrite(text)
    assert sum(seen.values()) == 2 and value not in new
    swapped = new[len('See "') :].split('", again $$$')[0]
    assert new == f'See "{swapped}", again $$${swapped}### end.'
    kind = next(iter(seen))
    if kind != "ipv4":
        assert [c.isdigit() for c in swapped] == [c.isdigit() for c in value] or kind in ("secret", "iban")
    assert pii.Pseudonyms(b"key", undo=True).rewrite(new)[0] == text
    assert pii.Pseudonyms(b"other").rewrite(text)[0] != new
    assert pii.Pseudonyms(b"key").rewrite(new)[1] == seen  # still valid


@pytest.mark.parametrize("value", ["4111111111111112", "2023-02-29", "999.1.1.1", "000-12-1234", "GB82 WEST 1234 5698 7654 33", "1.2.3", "12345"])
def test_invalid_values_stay(value):
    assert pii.Pseudonyms(b"key").rewrite(f"a {value} b") == (f"a {value} b", {})


def test_cards_keep_their_check_digit_and_dates_their_calendar():
    names = pii.Pseudonyms(b"key")
    for k in range(50):
        body = f"4{k:014d}"
        new = names.card(body + str(pii.luhn(body)))
        assert pii.luhn(new[:-1]) == int(new[-1])
        dt.date.fromisoformat(names.date(f"20{k:02d}-03-0{k % 9 + 1}"))
    assert names.phone("+1 (183) 555-1276")[4:7] == names.phone("183-555-1276")[:3]


def test_personal_data_of_odd_rows(spark, odd_docs, no_docs):
    out = pii.replaced(odd_docs, b"key")
    assert out.columns == odd_docs.columns
    assert sorted(hashlib.md5(repr(r).encode()).hexdigest() for r in out.collect()) == sorted(hashlib.md5(repr(r).encode()).hexdigest() for r in odd_docs.collect())
    assert pii.replaced(no_docs, b"key").count() == 0
