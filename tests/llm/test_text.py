"""Quality, language, tokens, training order and mixing against brute force and the libraries."""

import dataclasses
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from brute import base_rules, order, sha, words
from conftest import prose

from tidewatch.llm import language_id, merge_rounds, mixing, quality_rules, token_counts, training_order
from tidewatch.llm.pieces import coded_pretokens, model_bytes, pretokens
from tidewatch.session import fresh_path, shared_dir

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CFG = quality_rules.QualityConfig(buckets=64, trusted_rows=50)


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def got(df):
    return [tuple(r) for r in df.collect()]


def by_key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def weights_of(spark, rows, trusted):
    """The log ratios, counted in plain Python from the hashes the engine gives."""
    grams = sorted({w for _, t in rows for w in words(t)})
    frame = spark.createDataFrame([(w,) for w in grams] or [("",)], "w string")
    h = {r[0]: r[1] for r in frame.selectExpr("w", "xxhash64(w)").collect()}
    pairs = sorted({(h[a], h[b]) for _, t in rows for a, b in zip(words(t), words(t)[1:])})
    two = {(r[0], r[1]): r[2] for r in spark.createDataFrame(pairs or [(0, 0)], "a long, b long").selectExpr("a", "b", "xxhash64(a, b)").collect()}
    of = lambda t: [h[w] % CFG.buckets for w in words(t)] + [two[h[a], h[b]] % CFG.buckets for a, b in zip(words(t), words(t)[1:])]
    raw = Counter(b for _, t in rows for b in of(t))
    good = Counter(b for i, t in rows if i in trusted for b in of(t))
    n, g, k = sum(raw.values()), sum(good.values()), CFG.buckets
    return of, [math.log((good[b] + 1) / (g + k)) - math.log((raw[b] + 1) / (n + k)) if g else 0.0 for b in range(k)]


def test_quality(spark, awkward, nothing):
    df, rows = awkward
    trusted = {i for i, _ in rows if i is not None and i % 2}
    marks = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    of, w = weights_of(spark, rows, trusted)
    want = []
    for i, t in rows:
        *counts, failed = base_rules(t)
        g = of(t)
        llr = sum(w[b] for b in g) / len(g) if g else None
        want.append((i, *counts, failed, not failed and (llr or 0.0) >= CFG.threshold, llr))
    res = got(quality_rules.quality(df, marks, CFG))
    strip = lambda r: r[:-1] + (None if r[-1] is None else round(r[-1], 9),)
    assert by_key(map(strip, res)) == by_key(map(strip, want))
    kept = quality_rules.keep_good(df, marks, CFG)
    assert kept.columns == df.columns
    assert sorted((order(r["doc_id"]) for r in kept.collect())) == sorted(order(r[0]) for r in want if r[7])
    assert got(quality_rules.quality(nothing, marks, CFG)) == []


def test_quality_without_trusted_rows_and_their_bound(spark, awkward):
    df, rows = awkward
    none = spark.createDataFrame([], "doc_id long")
    res = quality_rules.quality(df, none, CFG).collect()
    assert all(r["kept"] != r["base_failed"] for r in res)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(None, 1, 0), (3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    ids = [r["doc_id"] for r in quality_rules.trusted_ids(labels, CFG).collect()]
    assert len(ids) == len(set(ids)) == CFG.trusted_rows


def test_junk_is_rejected_and_prose_kept(spark):
    rng = random.Random(4)
    vocab = [prose(rng, 1) for _ in range(20)]
    clean = [(i, " ".join(rng.choice(vocab) for _ in range(80))) for i in range(200)]
    junk = [(1000 + i, " ".join(rng.choice(vocab) + "%%%" + rng.choice(vocab) for _ in range(80))) for i in range(60)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string")
    marks = spark.createDataFrame([(i,) for i in range(0, 200, 2)], "doc_id long")
    kept = {r["doc_id"] for r in quality_rules.quality(df, marks).filter("kept").collect()}
    assert kept == {i for i, _ in clean}


def test_mix_finds_rows_with_null_and_shared_ids_again(spark):
    rows = [(None, "a", "n " * 40), (7, "a", "x " * 30), (7, "a", "y " * 90), (7, "b", "y " * 90), (7, "b", "y " * 90), (3, None, "z " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    cfg = mixing.MixConfig(block=16)
    want = Counter()
    for r in mixing.mixed(df, cfg).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    out = mixing.mix_documents(df, cfg)
    assert out.columns == df.columns
    assert Counter((r["doc_id"], len(r["text"].split())) for r in out.collect()) == +want


def test_labelled_rows_are_told_apart_at_two_sizes(spark):
    for size, bad, clean in (("sf0.01", 0.85, 0.9), ("sf0.1", 0.95, 0.99)):
        docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
        labels = spark.read.parquet(f"/root/testdata/{size}/labels.parquet")
        out = quality_rules.quality(docs, quality_rules.trusted_ids(labels, quality_rules.QualityConfig()))
        seen = out.filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg({"*": "count", "kept": "count_if"})
        kept = {r["quality"]: (r["count_if(kept)"], r["count(1)"]) for r in seen.collect()}
        print(size, kept)
        assert kept[0][0] <= (1 - bad) * kept[0][1] and kept[1][0] >= clean * kept[1][1]


def test_scores_leave_the_own_document_out(spark):
    rows = [(1, "a b c d"), (2, "a b x y"), (3, "a b a z"), (None, "a b q"), (5, ""), (5, "a c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(1,), (2,)], "doc_id long")
    cfg = quality_rules.QualityConfig()
    of = [Counter(words(t)) + Counter(zip(words(t), words(t)[1:])) for _, t in rows]
    raw = sum(of, Counter())
    good = of[0] + of[1]
    share = good.total() / raw.total()
    want = []
    for (i, t), own in zip(rows, of):
        hit = i in (1, 2)
        s = sum(n * math.log((good[g] - n * hit + cfg.prior) / ((raw[g] - n) * share + cfg.prior)) for g, n in own.items())
        want.append((i, len(words(t)), round(s / own.total(), 9) if own else None))
    res = quality_rules.quality(docs, marks).collect()
    assert by_key((r["doc_id"], r["n_words"], None if r["llr"] is None else round(r["llr"], 9)) for r in res) == by_key(want)


def test_token_counts(awkward, nothing, sp):
    df, rows = awkward
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for i, t in rows]
    assert by_key(got(token_counts.token_counts(df, MODEL, 100))) == by_key(want)
    assert got(token_counts.token_counts(nothing, MODEL)) == []


def test_pretokens_cover_the_text():
    for t in ("", "a", " a", "a  b ", "▁", "x▁ y"):
        assert "".join(pretokens(t)) == (" " + t.replace("▁", " ") if t else "")


def test_distinct_pretokens_stand_for_all():
    for texts in ([], [None], ["", None, ""], ["ends in ", " begins", "", "  ", "▁", "x▁ y ends\nin", "é ü\x00 é", " ends"], ["a"] * 3):
        words, each, at = coded_pretokens(texts)
        every = [pretokens(t or "") for t in texts]
        assert len(set(words)) == len(words) and each.tolist() == [len(x) for x in every]
        assert [words[i] for i in at] == [w for x in every for w in x]


def test_round_trip(awkward, nothing, sp):
    df, rows = awkward
    want = []
    for i, t in rows:
        ids = sp.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    assert by_key(got(merge_rounds.round_trip(df, MODEL))) == by_key(want)
    assert got(merge_rounds.round_trip(nothing, MODEL)) == []
    back = merge_rounds.decoded(merge_rounds.encoded(df, MODEL), MODEL)
    assert by_key(got(back)) == by_key((i, sp.decode(sp.encode(t or ""))) for i, t in rows)


def test_merges_equal_the_library(sp, monkeypatch):
    m = merge_rounds.merges(model_bytes(MODEL))
    rng = random.Random(1)
    letters = list("ab é▁ \n\t\x00=-0123의😀中the<s></s>")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(400)]
    texts += ["a" * 5000, " " * 3001, "=" * 2000, "=-" * 3000, "\n" * 3000, "😀" * 2500, "the" * 1500, "0" * 2049, prose(rng, 500)]
    for limit in (2048, 5):
        monkeypatch.setattr(merge_rounds, "LONG_WORD", limit)
        ids = merge_rounds.encode(texts, m)
        for k, t in enumerate(texts):
            own = ids.flat[ids.starts[k]:ids.starts[k + 1]]
            assert own.tolist() == sp.encode(t)
    for _ in range(1500):
        ids = np.array([rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.choice([0, 1, 2, 259, 28705])]) for _ in range(rng.randint(1, 8))])
        assert merge_rounds.decode(ids, m) == sp.decode(ids.tolist())


def test_language(spark, nothing):
    rng = random.Random(9)
    parts = {"xx": "ka ru mi to la", "yy": "sch ung ei ber", "zz": "eau oux que ment"}
    make = lambda x, n: " ".join("".join(rng.choice(parts[x].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, make(x, rng.randint(1, 60)), x) for i, x in enumerate(rng.choices(sorted(parts), k=600))]
    df = spark.createDataFrame(rows + [(900, "no language", None)], "doc_id long, text string, lang string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model = language_id.train(df.filter("crc32(cast(doc_id as string)) % 5 != 0"))
    assert model.langs == ["xx", "yy", "zz"]
    odd = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "123 !? 😀", "s"), (None, "KARUMI TOLA", "s"), (4, "Ж", "s")],
                                "doc_id long, text string, score string")
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(odd, model).collect()}
    assert [out[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and out[None][0] == "xx" and out[4] == (model.default, 0.0)
    pred = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    tested = [(i, x) for i, _, x in rows if held(i)]
    assert sum(pred[i]["lang_pred"] == x for i, x in tested) >= 0.97 * len(tested)
    assert all(0 <= r["score"] <= 1 for r in pred.values())
    empty = language_id.train(nothing)
    assert {r["lang_pred"] for r in language_id.predict(odd, empty).collect()} == {"und"}
    assert got(language_id.predict(nothing, model)) == []


def grams_of(text, orders=(2, 3, 4)):
    low = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    return Counter(f" {w} "[k:k + n] for w in low.split() for n in orders for k in range(len(w) + 3 - n))


def plain_language(learned, asked, cfg):
    """(best languages, score) of each text from plain sets of n-grams in place of filters."""
    counts, rows = {}, Counter()
    for text, lang in learned:
        counts.setdefault(lang, Counter()).update(grams_of(text))
        rows[lang] += 1
    part = {x: {g: n / c.total() for g, n in c.items()} for x, c in counts.items()}
    top = Counter()
    for p in part.values():
        for g, v in p.items():
            top[g] = max(top[g], v)
    members = {x: {g for g, v in p.items() if counts[x][g] >= cfg.min_count and v >= cfg.least_part and v >= cfg.share * top[g]}
               for x, p in part.items()}
    out = []
    for text in asked:
        g = grams_of(text)
        shares = {x: sum(n for k, n in g.items() if k in members[x]) / g.total() for x in sorted(members)} if g else {}
        high, whole = max(shares.values(), default=0.0), sum(shares.values())
        best = {"und"} if not g else {max(sorted(rows), key=rows.get)} if not whole else {x for x, v in shares.items() if v == high}
        out.append((best, high / whole if whole else 0.0))
    return out, max(map(len, members.values()))


def test_language_against_plain_sets(spark, awkward):
    """Filters so large that false hits do not matter give what sets of n-grams give, on any text."""
    rng = random.Random(21)
    parts = {"xx": "ka ru mi to la", "yy": "sch ung mi ber", "zz": "eau to que ment é", "ww": "ka ber ß o"}
    make = lambda x, n: " ".join("".join(rng.choice(parts[x].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))
    learned = [(make(x, rng.randint(0, 40)), x) for x in rng.choices(sorted(parts), k=200)] + [(None, "xx"), ("", "yy"), ("12 34", "zz")]
    learned += learned[:5]
    asked = [t for _, t in awkward[1]] + [make(x, rng.randint(1, 9)) for x in parts for _ in range(20)] + ["KARUMI, tola!", "karumi" * 9_000]
    for cfg in (language_id.LangConfig(false_hits=1e-9), language_id.LangConfig(false_hits=1e-9, least_part=0.002, min_count=8)):
        want, most = plain_language(learned, asked, cfg)
        model = language_id.train(spark.createDataFrame(learned, "text string, lang string"), cfg)
        assert model.bits == language_id.bits_for(most, cfg)
        rows = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
        seen = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(rows, model, cfg).collect()}
        for k, (best, score) in enumerate(want):
            assert seen[k][0] in best and abs(seen[k][1] - score) < 1e-6, (k, asked[k])


def test_filter_size_follows_its_members(spark):
    """False hits stay within the stated rate at any number of members, and the number is bounded."""
    cfg = language_id.LangConfig()
    for members in (1, 50, 5000, 200_000):
        bits, rng = language_id.bits_for(members, cfg), np.random.default_rng(members)
        mask = np.zeros(1 << bits, bool)
        own = dataclasses.replace(cfg, bits=bits)
        for p in language_id._positions(rng.integers(0, 1 << 63, members, np.uint64), own):
            mask[p] = True
        foreign = language_id._positions(rng.integers(0, 1 << 63, 200_000, np.uint64), own)
        assert np.logical_and.reduce([mask[p] for p in foreign]).mean() <= 1.3 * cfg.false_hits
    assert language_id.bits_for(int(1 / cfg.least_part), cfg) == 23
    one = spark.createDataFrame([("".join(chr(0x4E00 + 50 * k + j) for j in range(40)), "xx") for k in range(100)] * 3, "text string, lang string")
    few, many = (language_id.train(one, dataclasses.replace(cfg, least_part=p)) for p in (0.01, 0.00001))
    assert few.bits == 10 and many.bits > few.bits and many.fill.max() ** cfg.hashes <= 1.3 * cfg.false_hits


def test_filter_has_every_member():
    """No false negatives: an n-gram put in is always found, whatever the fill."""
    cfg = language_id.LangConfig(bits=8)
    masks = np.zeros((1, 256), np.uint64)
    h = np.array([zlib.crc32(str(k).encode()) * 2654435761 for k in range(200)], np.uint64)
    for p in language_id._positions(h, cfg):
        masks[0][p] |= np.uint64(4)
    assert all((masks[0][p] & np.uint64(4)).all() for p in language_id._positions(h, cfg))


def test_many_languages_use_more_words(spark):
    rng = random.Random(11)
    rows = [(k, f"{chr(0x4E00 + 40 * (k % 70) + j)}" * 6 + " ", f"l{k % 70:02d}") for k in range(700) for j in [rng.randrange(6)]]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.masks.shape[0] == 2
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert sum(out[i] == x for i, _, x in rows) > 0.95 * len(rows)


def test_permutation_is_a_bijection_with_inverse():
    cfg = training_order.OrderConfig()
    for n in (1, 2, 3, 7, 64, 1000, 65537):
        p = training_order.permuted(np.arange(n), n, cfg)
        assert sorted(p.tolist()) == list(range(n))
        assert (training_order.permuted(p, n, cfg, back=True) == np.arange(n)).all()


def test_training_order(spark, awkward, nothing, sp):
    df, rows = awkward
    cfg = training_order.OrderConfig(seq_len=16, shard_rows=37)
    path = fresh_path(spark, "shards")
    out = training_order.materialise(df, path, MODEL, cfg)
    first = got(out)
    assert by_key(got(out)) == by_key(first)  # complete shards are left alone
    assert sorted(r[2] for r in first) == list(range(len(first)))
    docs, at = {}, {r[2]: r for r in first}
    for slot, (doc, seq, ids) in enumerate(training_order.read_slots(path, 0, 10**9, cfg)):
        assert at[slot][:2] == (doc, seq) and at[slot][6] == sha(ids.tobytes()) and at[slot][5] == len(ids)
        docs.setdefault(doc, []).append((seq, ids.tolist()))
    assert slot == len(first) - 1
    single = [(i, t) for i, t in rows if [x for x, _ in rows].count(i) == 1]
    for i, t in single:
        assert [x for _, ids in sorted(docs[i]) for x in ids] == sp.encode(t or "", add_eos=True)
    middle = list(training_order.read_slots(path, 50, 5, cfg))
    assert [(d, s) for d, s, _ in middle] == [at[k][:2] for k in range(50, 55)]
    assert got(training_order.materialise(nothing, fresh_path(spark, "none"), MODEL, cfg)) == []


def test_kept_and_exchanged_sequences_are_short(spark, sp):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    texts = [" ".join(vocabulary[int(3000 * rng.random() ** 3)] for _ in range(rng.randint(1, 900))) for _ in range(400)]
    cfg = training_order.OrderConfig()
    df = spark.createDataFrame([(None if i % 50 == 0 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    before = set(Path(shared_dir(spark)).glob("sequences-*"))
    out = training_order.materialise(df, fresh_path(spark, "shards"), MODEL, cfg)
    (kept,) = set(Path(shared_dir(spark)).glob("sequences-*")) - before
    assert sum(1 for r in out.collect() if r["doc_id"] is None) >= 8
    ids = [np.array(sp.encode(t, add_eos=True), "<u2") for t in texts]
    whole = np.concatenate(ids)
    assert sum(f.stat().st_size for f in kept.glob("*.parquet")) < 0.6 * whole.nbytes
    code = training_order.id_code(texts[:20], model_bytes(MODEL))
    for some in (whole, np.arange(sp.vocab_size(), dtype="<u2"), whole[:0]):
        lead, tail, _ = code.coded(some)
        assert (code.decoded(lead, tail) == some).all()
    packs = out_packs(spark, kept, cfg)
    assert sum(len(r["pack"]) for r in packs) < 0.6 * whole.nbytes


def out_packs(spark, kept, cfg):
    cut = spark.read.parquet(str(kept)).drop("crc")
    n = cut.count()
    assert {r[0] for r in cut.select("part").distinct().collect()} == {0}
    return cut.mapInArrow(lambda it: training_order._packs(it, {0: 0}, n, 8, 8, cfg), training_order.PACK_SQL).collect()


def reshared_by_steps(sizes, weights, total, cap):
    target = dict.fromkeys(range(len(sizes)))
    while True:
        free = [i for i in target if target[i] is None]
        rest = total - sum(x for x in target.values() if x is not None)
        over = [i for i in free if rest * weights[i] / sum(weights[k] for k in free) > cap * sizes[i]]
        if not over:
            return [rest * weights[i] / sum(weights[k] for k in free) if target[i] is None else target[i] for i in target]
        for i in over:
            target[i] = cap * sizes[i]


def test_mixing(spark, awkward, nothing):
    df, rows = awkward
    cfg = mixing.MixConfig(block=8)
    out = got(mixing.mixed(df, cfg))
    assert len(out) == len(rows) and by_key(out) == by_key(got(mixing.mixed(df.repartition(5), cfg)))
    sizes = Counter()
    for r in df.collect():
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = reshared_by_steps([sizes[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(sizes.values()), 2)
    source = {(r["doc_id"], len(words(r["text"]))): r["source"] for r in df.collect()}
    taken = Counter()
    for doc, size, whole, target, got_words, copies in out:
        s = source[doc, size]
        assert whole == sizes[s] and target == pytest.approx(want[names.index(s)])
        assert 0 <= got_words <= 2 * size and copies == (int((2 * got_words + size) // (2 * size)) if size else 0)
        taken[s] += got_words
    for s, t in zip(names, want):
        assert abs(taken[s] - t) <= 2 * cfg.block
    assert got(mixing.mixed(nothing, cfg)) == []
    known = df.filter("doc_id >= 0").dropDuplicates(["doc_id"])
    times = {r[0]: r[5] for r in got(mixing.mixed(known, cfg))}
    mixed = mixing.mix_documents(known, cfg)
    assert mixed.columns == df.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in times.items() if n})


def test_schedule_is_even_everywhere(spark):
    cfg = mixing.MixConfig(cell_bits=4)
    sources = spark.createDataFrame([(0, 500, 0, 500), (1, 100, 500, 600), (2, 0, 600, 600), (3, 40, 600, 640)],
                                    "source_no int, quota long, low long, high long")
    rows = sorted(got(mixing.schedule(sources, cfg)))
    for no, quota in ((0, 500), (1, 100), (2, 0), (3, 40)):
        assert [r for _, s, r in rows if s == no] == list(range(quota))
    for a in range(0, 512, 64):
        part = Counter(s for slot, s, _ in rows if a <= slot < a + 64)
        assert abs(part[0] - 50) <= 4 and abs(part[1] - 10) <= 4
