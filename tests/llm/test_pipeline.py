"""The pipeline as a whole, and the mix word by word, against plain re-statements."""

import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from brute import base_rules, exact, llrs, mix_taken, near_groups, order, sha, words
from conftest import SCHEMA, awkward_rows, prose

import corpus_pipeline
from tidewatch.llm import mixing


def targets_of(rows, weights=(3, 1, 2), total=1.5, cap=2.0):
    """Target by source of rows (id, source, size, key), stopping those that reach their cap."""
    sizes = Counter()
    for _, source, size, _ in rows:
        sizes[source] += size
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    stopped, left = {}, total * sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if part[s] > cap * sizes[s]]
        if not over:
            return stopped | part
        for s in over:
            stopped[s] = cap * sizes[s]
            left -= stopped[s]


def keyed(df, cfg):
    seen = df.select("doc_id", "source", "text", mixing._key(cfg, "doc_id", "text").alias("key")).collect()
    return [(r["doc_id"], r["source"], len(words(r["text"])), r["key"]) for r in seen]


@pytest.mark.parametrize("block", [3, 8, 128])
def test_words_taken_by_the_mix(spark, awkward, block):
    df, _ = awkward
    cfg = mixing.MixConfig(block=block)
    rows = keyed(df, cfg)
    want = Counter((r[0], r[2], n) for r, n in zip(rows, mix_taken(rows, targets_of(rows), block)))
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mixed(df, cfg).collect()) == want


def plainly(spark, rows, trusted):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every copy, from rows of (id, text, source)."""
    pairs = [r[:2] for r in rows]
    scores = llrs(pairs, trusted)
    good = [r for r, s in zip(rows, scores) if not base_rules(r[1])[-1] and s >= -0.05]
    stays = {(i, sha_) for i, keep, _, sha_ in exact([r[:2] for r in good])[0] if i == keep}
    once = {(r[0], " ".join(words(r[1]))): r for r in good if (r[0], exact([r[:2]])[0][0][3]) in stays}
    single = list(once.values())
    kept = [r for r, (i, _, c) in zip(single, near_groups([r[:2] for r in single])) if i == c]
    sized = keyed(spark.createDataFrame(kept, "doc_id long, text string, source string"), mixing.MixConfig()) if kept else []
    by_id = {r[0]: r for r in kept}
    assert len(by_id) == len(kept)
    sp, out = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), Counter()
    for row, n in zip(sized, mix_taken(sized, targets_of(sized), mixing.MixConfig().block) if sized else []):
        ids = sp.encode(by_id[row[0]][1]) + [sp.eos_id()]
        out[row[0], len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))] += (2 * n + row[2]) // (2 * row[2])
    return +out, len(good), len(single), len(kept)


def stored_as_tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    rows = awkward_rows()
    vocab = prose(rng, 30).split()
    extra = [(1000 + k, " ".join(rng.choices(vocab, k=60)), "en", "ab"[k % 2], 1, "", "", "", "") for k in range(40)]
    junk = [(2000 + k, " ".join(rng.choices(vocab[:3], k=2) + rng.choices([f"{w}%%" for w in vocab], k=60)), None, "b", 1, "", "", "", "") for k in range(40)]
    rows += extra + junk + [(3000, *extra[0][1:]), (3001, *extra[1][1:])]
    long = prose(rng, 4000)
    rows += [(4000 + k, long + " zz" * k, None, "a", 1, "", "", "", "") for k in range(3)]  # near copies
    labels = [(r[0], int(r[0] < 2000), 0) for r in extra + junk] + [(None, 1, 0), (77777, 1, 0)]
    for name, marked in (("labelled", labels), ("unlabelled", [])):
        (tmp_path / name).mkdir()
        sf = stored_as_tables(spark, tmp_path / name, rows, marked)
        want, good, single, kept = plainly(spark, [(r[0], r[1], r[3]) for r in rows], {i for i, q, _ in marked if q and i is not None})
        assert kept < single < good
        out = corpus_pipeline.run(spark, sf)
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert Counter(map(tuple, out.collect())) == want
        ids = {k[0] for k in want}
        assert 3000 not in ids and (name == "unlabelled") == bool(ids & {r[0] for r in junk})


def test_stages_in_order_and_their_columns(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "exact dedup", "simhash near-dedup", "source mixing", "sentencepiece"]
    sf = stored_as_tables(spark, tmp_path, awkward_rows(), [(i, 1, 0) for i in range(0, 60, 2)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = Counter(map(tuple, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        seen = Counter(map(tuple, out.collect()))
        assert out.columns == docs.columns and set(seen) <= set(whole), name
        most = 2 if name == "source mixing" else 1
        assert all(n <= most * whole[r] for r, n in seen.items()), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert sorted((r["doc_id"] for r in last.collect()), key=order) == sorted((r["doc_id"] for r in docs.collect()), key=order)


def test_pipeline_without_documents(spark, tmp_path):
    sf = stored_as_tables(spark, tmp_path, [], [(1, 1, 0)])
    assert corpus_pipeline.run(spark, sf).collect() == []
