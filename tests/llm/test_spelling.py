"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import queries, spelling
from tidewatch.llm.spelling import KdTree, SpellingConfig

SCHEMA = "doc_id long, text string, word string, n string, cell string, part string, root string, best string"


def brute_counts(rows, typo_every=97, least=5):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if typo_every and h % typo_every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least:
                out[w] += 1
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(counts, ratio=2, least=3):
    words = {w: n for w, n in counts.items() if n >= least}
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        top = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = top if top and words[top] >= ratio * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def texts(rng, n_docs=60):
    """Words of few letters with typos, accents, capitals, anagrams, chains of forms; odd and long texts."""
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    base += ["theories", "theorise", "Ärgerlich", "ärgerlich", "x×y÷zzz", "anagram", "margana", "ÀÉÎÕÜ", "abcdefghij" * 4, "q" * 300]

    def typo(w):
        k, c = rng.randrange(len(w)), rng.choice("abcé")
        return rng.choice([w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + c + w[k + 1:], w, w, w.upper(), w.title()])

    rows = [(i, rng.choice([" ", ", ", "\n", "1", "_"]).join(typo(rng.choice(base)) for _ in range(rng.randint(0, 60)))) for i in range(n_docs)]
    rows += [(None, "abaab abaab abaab"), (3, None), (4, ""), (5, "12 !? ..."), (6, "chain " * 9 + "chains " * 3 + "chainsa " * 40)]
    rows += [(7, " ".join(typo(rng.choice(base)) for _ in range(3000))), (7, "abaab"), (7, "abaab"), (-2, "ſſſſſ ﬁﬁﬁﬁﬁ Ωμέγα ŒŒŒŒŒ abaab")]
    return rows


@pytest.mark.parametrize("cfg", [SpellingConfig(), SpellingConfig(sample=300, cell_words=16), SpellingConfig(min_length=4, min_count=1, ratio=1, sample=64, cell_words=8)])
def test_variants_equal_all_pairs(spark, cfg):
    rows = texts(random.Random(5))
    counts = spark.createDataFrame([(*r, *"abcdef") for r in rows], SCHEMA).repartition(3)
    if cfg.ratio == 1:  # two equally common words may be each other's form, so only their numbers are compared
        words = spelling.word_counts(counts, cfg, 97).filter(f"n >= {cfg.min_count}")
        got = {r["word"]: (r["best"], r["n_near"]) for r in spelling.near_words(words, cfg).collect()}
        plain = brute_counts(rows, least=cfg.min_length)
        near = {w: [v for v in plain if v != w and one_edit(w, v)] for w in plain}
        assert got == {w: (min(v, key=lambda x: (-plain[x], x)), len(v)) for w, v in near.items() if v}
        return
    out = spelling.variants(spelling.word_counts(counts, cfg, 97), cfg)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in out.collect()}
    want = brute_variants(brute_counts(rows))
    assert got == want and any(v[0] and v[1] != v[0] for v in want.values())


def test_query(spark, tmp_path):
    rows = texts(random.Random(6), 400)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.BUILDERS["op12_spelling_variants"](spark, str(tmp_path))
    assert sorted(out.columns) == ["form", "form_n", "n", "n_near", "root", "word"]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in out.collect()}
    assert got == brute_variants(brute_counts(rows))


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.variants(spelling.word_counts(empty)).collect() == []


def test_tree_finds_all_points_within_reach():
    rng = np.random.default_rng(3)
    for _ in range(30):
        p, q = rng.integers(0, 4, (int(rng.integers(1, 200)), 5)), rng.integers(0, 4, (50, 5))
        tree = KdTree(p, int(rng.integers(1, 20)))
        assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(len(p)))
        for over, under in ((0, 0), (1, 1), (1, 0), (0, 1)):
            found = {(i, j) for leaf, rows in tree.search(q, over, under) for i in rows for j in tree.leaves[leaf]}
            d = q[:, None] - p[None]
            want = (np.maximum(d, 0).sum(2) <= over) & (np.maximum(-d, 0).sum(2) <= under)
            assert set(zip(*np.nonzero(want), strict=True)) <= found


def test_large_classes_meet_by_hash(monkeypatch):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(n)) for n in (8, 9) for _ in range(400)} | {"c" + "ab" * 4, "abcabab", "aaabbbbbc"})
    for kind in (8, 9):
        own = [w for w in words if len(w) == 8]
        other = [w for w in words if len(w) == kind]
        a, b = spelling.Anagrams(np.array(own, object)), spelling.Anagrams(np.array(other, object))
        ca, cb = np.nonzero(np.abs(a.counts[:, None] - b.counts[None]).sum(2) == (2 if kind == 8 else 1))
        want = {(x, y) for x in own for y in other if one_edit(x, y)}
        for large in (0, 1 << 14):
            monkeypatch.setattr(spelling, "LARGE", large)
            got = [(own[a.order[i]], other[b.order[j]]) for ia, ib in spelling._word_pairs(a, b, ca, cb, kind == 9) for i, j in zip(ia, ib, strict=True)]
            assert len(got) == len(set(got)) and set(got) == want
