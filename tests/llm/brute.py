"""Plain counterparts of the operators, one row or pair at a time."""

import hashlib
import re
from collections import defaultdict

import xxhash

WORD1 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD2 = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {k: k + 32 for k in range(65, 91)}


def lower(text):
    return (text or "").translate(_LOWER)


def contamination(docs, items, window=13):
    """{doc_id: (n_words, n_hit, n_items, digest, contaminated)}."""
    wins = defaultdict(set)
    for item, text in items:
        w = WORD1.findall(lower(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[i : i + window])].add(item)
    sizes = sorted({len(w) for w in wins})
    out = {}
    for doc, text in docs:
        w, hit, found = WORD1.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                who = wins.get(tuple(w[i : i + n]))
                if who:
                    hit.update(range(i, i + n))
                    found |= who
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def fingerprint(text, shingle=3):
    w = WORD2.findall(lower(text))
    if not w:
        return 0
    parts = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(ids_and_prints, distance=2):
    """{id: smallest id reachable} by comparing all pairs."""
    rows = list(ids_and_prints)
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), doc), doc)
    return {doc: low[top(i)] for i, (doc, _) in enumerate(rows)}


def chat(rows):
    """{conv_id: (n_turns, digest, loss_chars, loss digest)} of (conv, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def waterfill(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: target}; sizes is {source: words}."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        room = left - sum(full.values())
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if room * w[s] / total > most * sizes[s]] if total else []
        if not over:
            return full | {s: room * w[s] / total for s in open_}
        full |= {s: most * sizes[s] for s in over}


def top_k(vectors, every=20, k=20, scale=64):
    import math

    q = {}
    for i, v in vectors:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            q[i] = [math.floor(scale * x) for x in v]
    out = []
    for i in sorted(q):
        if i % every == 0:
            best = sorted(((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out
