"""Plain re-statements of what the text operators must return, for small inputs."""

import hashlib
import math
import re
from collections import Counter

import xxhash

SPACE = "[\x20\x09-\x0D]+"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def order(i):
    return (i is None, i or 0)


def exact(rows):
    """rows of (id, text) -> sorted (id, keep_id, group_size, sha); and how many rows are kept per text."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(SPACE, " ", t or ""), []).append(i)
    return [(i, min(ids, key=order), len(ids), sha(t)) for t, ids in groups.items() for i in ids], len(groups)


def repeats(rows, length=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k:k + length]
            least[s] = min(least.get(s, i), i, key=order)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if order(least[b[k:k + length]]) < order(i):
                gone[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def base_rules(text):
    text = text or ""
    w = words(text)
    wins = {}
    for k in range(len(w) - 7):
        wins.setdefault(tuple(w[k:k + 8]), []).append(k)
    covered = {k + d for at in wins.values() if len(at) > 1 for k in at for d in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    n = len(w)
    return n, sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def line_sets(rows):
    """rows of (id, text) -> (id, lines, removed, sha) with Jaccard 0.8 against earlier lines."""
    seen, out = [], []
    for i, t in sorted(rows, key=lambda r: order(r[0])):
        lines = (t or "").split("\n") if t else []
        kept, gone = "", 0
        for k, x in enumerate(lines):
            s = frozenset(words(x))
            hit = bool(s) and any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen)
            if s:
                seen.append(s)
            gone += hit
            if not hit:
                kept += x + ("\n" if k < len(lines) - 1 else "")
        out.append((i, len(lines), gone, sha(kept)))
    return out


def simhash(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_groups(rows):
    f = [simhash(t) for _, t in rows]
    r = components(range(len(f)), ((a, b) for a in range(len(f)) for b in range(a) if (f[a] ^ f[b]).bit_count() <= 2))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[r[k]] = min(least.get(r[k], i), i, key=order)
    return [(i, f"{f[k]:016x}", least[r[k]]) for k, (i, _) in enumerate(rows)]


def llrs(rows, trusted, prior=10.0):
    """Log-likelihood ratio of each row of (id, text), rows that agree in both being one document."""
    of = [Counter(words(t)) + Counter(zip(words(t), words(t)[1:])) for _, t in rows]
    raw = sum(of, Counter())
    good = sum((c for (i, _), c in zip(rows, of) if i in trusted), Counter())
    share = good.total() / raw.total() if raw else 0.0
    own = {}
    for row, c in zip(rows, of):
        own[row] = own.get(row, Counter()) + c
    score = {}
    for row, c in own.items():
        hit = row[0] in trusted
        score[row] = sum(n * math.log((good[g] - n * hit + prior) / ((raw[g] - n) * share + prior)) for g, n in c.items()) / max(c.total(), 1)
    return [score[row] for row in rows]


def mix_taken(rows, target, block):
    """rows (id, source, size, key), target by source -> words taken of each row, block by block.

    A source's rows lie in order of their keys; it is gone through block by
    block, from the start again where it ends, until a further block would
    bring it no nearer to its target.
    """
    out = [0] * len(rows)
    for source, want in target.items():
        line = []
        for k in sorted((k for k, r in enumerate(rows) if r[1] == source), key=lambda k: (rows[k][3] % 2**64, rows[k][0] is not None, rows[k][0] or 0)):
            line += [k] * rows[k][2]
        blocks = [line[a:a + block] for a in range(0, len(line), block)]
        held, turn = 0, 0
        while blocks and abs(held + len(blocks[turn % len(blocks)]) - want) < abs(held - want):
            for k in blocks[turn % len(blocks)]:
                out[k] += 1
            held, turn = held + len(blocks[turn % len(blocks)]), turn + 1
    return out
