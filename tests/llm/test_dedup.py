"""Exact, near, line and substring dedup against brute force; components; suffix sorting."""

import random
import re

import numpy as np
from brute import components as brute_components
from brute import SPACE, exact, line_sets, near_groups, order, repeats, sha
from conftest import prose

from tidewatch.llm import exact_dedup, golay_simhash, line_dedup, repeated_bytes, suffix_sort
from tidewatch.llm.components import components


def got(df):
    return [tuple(r) for r in df.collect()]


def by_key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_exact_groups(awkward, nothing):
    df, rows = awkward
    want, texts = exact(rows)
    out = exact_dedup.exact_groups(df, fan_in=2)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    res = got(out)
    assert by_key((i, k, n, s) for i, k, n, _, s in res) == by_key(want)
    assert sum(kept for *_, kept, _ in res) == texts and all(i == k for i, k, _, kept, _ in res if kept)
    assert got(exact_dedup.exact_groups(nothing)) == []


def test_exact_stage_keeps_columns_and_one_row_per_text(awkward, nothing):
    df, rows = awkward
    known = df.filter("doc_id is not null")
    out = exact_dedup.drop_copies(known)
    assert out.columns == df.columns
    want = {(i, k) for i, k, _, _ in exact([r for r in rows if r[0] is not None])[0]}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, k in want if i == k)
    assert got(exact_dedup.drop_copies(nothing)) == []


def shared_ids(spark):
    """Null ids, one id with several texts, and a copy that shares its id with a text of its own."""
    texts = [(None, "only here with a null id"), (1, "a text that comes twice in all"), (7, "a text that comes twice in all"),
             (7, "the only row of this text"), (7, "the only row of this text"), (7, "and one more of number seven"),
             (None, "and one more of number seven"), (None, None), (None, "")]
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3), texts


def test_stages_keep_a_row_of_every_text_whatever_its_id(spark, awkward):
    for df, rows in (shared_ids(spark), awkward):
        want, _ = exact(rows)
        out = [(r["doc_id"], sha_of(r["text"])) for r in exact_dedup.drop_copies(df).collect()]
        assert by_key(out) == by_key({(k, s) for _, k, _, s in want})
        groups = near_groups(rows)
        f = [g[1] for g in groups]
        root = brute_components(range(len(f)), (
            (a, b) for a in range(len(f)) for b in range(a) if (int(f[a], 16) ^ int(f[b], 16)).bit_count() <= 2))
        least = {root[k]: g[2] for k, g in enumerate(groups)}
        out = got(golay_simhash.drop_near_copies(df).select("doc_id", "text"))
        at = {(i, t or ""): root[k] for k, (i, t) in enumerate(rows)}
        assert by_key((i, at[i, t or ""]) for i, t in out) == by_key((i, r) for r, i in least.items())


def sha_of(text):
    return sha(re.sub(SPACE, " ", text or ""))


def test_digests_need_proof_to_merge():
    assert {"digest", "n_bytes", "proof"} == set(exact_dedup.KEY)
    assert exact_dedup.tree_shape(1, 8) == (1, 8) and exact_dedup.tree_shape(65, 8) == (3, 512)


def test_repeated_bytes(awkward, nothing):
    df, rows = awkward
    for chunk, block in ((4 << 20, 1 << 20), (300, 200)):
        out = repeated_bytes.without_repeats(df, repeated_bytes.RepeatConfig(chunk_bytes=chunk, block_bytes=block))
        assert by_key(got(out)) == by_key(repeats(rows))
    assert got(repeated_bytes.without_repeats(nothing)) == []


def test_suffix_order_and_least_owner():
    rng = random.Random(2)
    for _ in range(150):
        letters = rng.choice([b"ab", b"a", bytes(range(0, 240, 7))])
        strings = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 7))]
        strings += [strings[0], strings[0] + b"a"]
        length = rng.choice([8, 9, 12, 20])
        text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
        order_ = suffix_sort.suffix_array(text, length).tolist()
        assert sorted(order_) == list(range(len(text)))
        heads = [text[i:i + length].tobytes() for i in order_]
        heads = [h for h in heads if b"\xff" not in h]
        assert heads == sorted(heads)
        owner = [rng.randint(0, 4) for _ in strings]
        least = {}
        for s, o in zip(strings, owner):
            for k in range(len(s) - length + 1):
                least[s[k:k + length]] = min(o, least.get(s[k:k + length], 9))
        want = [least[s[k:k + length]] for s in strings for k in range(len(s) - length + 1)]
        assert suffix_sort.least_owner(strings, np.array(owner), length).tolist() == want


def test_line_dedup(awkward, nothing):
    df, rows = awkward
    # rows that share an id share their text here, so their order among themselves is free
    for cfg in (line_dedup.LineConfig(), line_dedup.LineConfig(bits=8, block=2, chunk_bytes=500, pair_limit=20)):
        assert by_key(got(line_dedup.without_repeated_lines(df, cfg))) == by_key(line_sets(rows))
    assert got(line_dedup.without_repeated_lines(nothing)) == []


def test_positional_filter_bounds_what_lines_share(spark):
    """Against every pair of small word sets: no similar pair is dropped, and others are."""
    rng = random.Random(3)
    lines = [sorted(rng.sample(range(14), rng.randint(1, 12))) for _ in range(120)]
    met, dropped = [], 0
    for x, a in enumerate(lines):
        for b in lines[:x]:
            shared = sorted(set(a) & set(b))
            for first, last in [(w, w) for w in shared[:2]] + list(zip(shared, shared[1:], strict=False))[:2]:
                met.append((*[(len(t), 0, 0, t.index(first) << 16 | t.index(last)) for t in (a, b)], 9 * len(shared) >= 4 * (len(a) + len(b))))
    side = "struct<size int, b0 long, b1 long, place int>"
    pairs = spark.createDataFrame(met, f"p {side}, t {side}, similar boolean")
    seen = pairs.select("p", "t", "similar", line_dedup._may_match("p", "t").alias("passes")).collect()
    for r in seen:
        assert r["passes"] or not r["similar"]
        lengths = 5 * min(r["p"]["size"], r["t"]["size"]) >= 4 * max(r["p"]["size"], r["t"]["size"])
        dropped += lengths and not r["passes"]
    assert dropped > 0


def test_line_dedup_many_similar_lines(spark):
    """One rare pair of words in very many lines, some alike and some not."""
    rng = random.Random(5)
    lines = []
    for k in range(60):
        lines.append(f"rarea rareb x{k % 5} " + " ".join(f"w{(k % 5) * 100 + j}" for j in range(8)) + f" v{k}")
        lines.append(f"rarea rareb {prose(rng, 9)}")
    rows = [(k, "\n".join(lines[4 * k:4 * k + 4])) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block in (3, 64):
        out = line_dedup.without_repeated_lines(df, line_dedup.LineConfig(block=block, chunk_bytes=400))
        assert by_key(got(out)) == by_key(line_sets(rows))


def test_near_groups(awkward, nothing):
    df, rows = awkward
    assert by_key(got(golay_simhash.near_groups(df))) == by_key(near_groups(rows))
    assert got(golay_simhash.near_groups(nothing)) == []
    known = [r for r in rows if r[0] is not None]
    out = golay_simhash.drop_near_copies(df.filter("doc_id is not null"))
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({i for i, _, c in near_groups(known) if i == c})


def test_golay_keys_meet_at_two_bits():
    code = golay_simhash.Golay()
    assert sorted(np.unique(code.count)) == [1, 6]
    rng = np.random.default_rng(0)
    f = rng.integers(0, 2**63, 3000)
    one = lambda: np.int64(1) << rng.integers(0, 64, len(f))
    pairs = [golay_simhash.golay_keys(x, code) for x in (f, f ^ one() ^ one())]
    keys = [[set() for _ in f] for _ in pairs]
    for out, (row, key) in zip(keys, pairs):
        for r, k in zip(row.tolist(), key.tolist()):
            out[r].add(k)
    assert all(a & b for a, b in zip(*keys))


def test_links_pairs_and_stars_give_all_components(spark, monkeypatch):
    """A dense cloud of fingerprints and scattered ones, with few and with many per key."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    cloud = {centre}
    while len(cloud) < 150:
        cloud.add(rng.choice(sorted(cloud)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    f = sorted(cloud | {rng.getrandbits(64) for _ in range(100)})
    want = brute_components(f, ((a, b) for a in f for b in f if a < b and (a ^ b).bit_count() <= 2))
    signed = [x - (1 << 64) if x >> 63 else x for x in f]
    df = spark.createDataFrame([(x,) for x in signed], "f long")
    for paired in (64, 2):
        monkeypatch.setattr(golay_simhash, "PAIRED", paired)
        edges = [(a % 2**64, b % 2**64) for a, b in got(golay_simhash.links(df))]
        assert all((a ^ b).bit_count() <= 2 for a, b in edges)
        assert brute_components(f, edges) == want


def test_components_of_chains_stars_and_repeats(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(100, 101), (5, 5), (200, 199), (199, 200)]
    out = dict(got(components(spark.createDataFrame(edges, "a long, b long"))))
    assert out == {n: r for n, r in brute_components({x for e in edges for x in e}, edges).items() if any(n in e and e[0] != e[1] for e in edges)}
    assert got(components(spark.createDataFrame([], "a long, b long"))) == []
    assert order(None) > order(5)
