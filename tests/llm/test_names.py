"""Stages and operators beside columns of any name; shards of one corpus to a folder."""

import pytest
from test_text import MODEL

from tidewatch.llm import exact_dedup, golay_simhash, mixing, quality_model, quality_rules, spelling, training_order

#: Names that the operators use for columns of their own, now or before.
NAMES = ["hit", "id", "row", "at", "mark", "proof", "list", "copies", "key", "own_id", "digest", "norm", "words", "word", "n", "good", "score",
         "__id", "__mark", "__at", "__list", "__copy", "__norm", "trusted_id", "first_id", "kept_id", "v", "llr", "f", "slot", "gram", "HIT2"]


@pytest.fixture(scope="module")
def crowded(spark):
    from conftest import prose
    import random

    rng = random.Random(3)
    texts = [prose(rng, 40) for _ in range(12)]
    rows = [(i, texts[i % 12] if i % 7 else None, "abc"[i % 3] if i % 5 else None, *[f"{n}{i}" for n in NAMES]) for i in range(30)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, schema).repartition(3)


def test_stages_beside_any_names(spark, crowded):
    marks = spark.createDataFrame([(i,) for i in range(0, 30, 2)], "doc_id long")
    plain = crowded.select("doc_id", "text", "source")
    for stage in (exact_dedup.drop_copies, golay_simhash.drop_near_copies, lambda d: mixing.mix_documents(d, mixing.MixConfig(block=16)),
                  lambda d: quality_rules.keep_good(d, marks)):
        out = stage(crowded)
        assert out.columns == crowded.columns
        got = sorted((r["doc_id"], r["hit"], r["__list"]) for r in out.collect())
        assert got == sorted((r["doc_id"], f"hit{r['doc_id']}", f"__list{r['doc_id']}") for r in stage(plain).collect())


def test_operators_beside_any_names(spark, crowded):
    marks = spark.createDataFrame([(i,) for i in range(0, 30, 2)], "doc_id long")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(30)], "doc_id long, quality int, good string")
    plain = crowded.select("doc_id", "text", "source")
    for op in (lambda d: quality_rules.quality(d, marks), lambda d: spelling.variants(spelling.word_counts(d, typo_every=97)),
               lambda d: quality_model.score(d, quality_model.train(d, labels))):
        rows = lambda d: sorted(map(repr, op(d).collect()))
        assert rows(crowded) == rows(plain)


def test_another_corpus_is_refused_a_folder(spark, tmp_path):
    cfg = training_order.OrderConfig(seq_len=8, shard_rows=4)
    one = spark.createDataFrame([(1, "one text of some words"), (2, "and another one")], "doc_id long, text string")
    two = spark.createDataFrame([(9, "a wholly other text")], "doc_id long, text string")
    path = f"{tmp_path}/shards"
    first = sorted(map(tuple, training_order.materialise(one, path, MODEL, cfg).collect()))
    assert sorted(map(tuple, training_order.materialise(one, path, MODEL, cfg).collect())) == first
    for other, setting in ((two, cfg), (one, training_order.OrderConfig(seq_len=8, shard_rows=4, key=7)), (one, training_order.OrderConfig(seq_len=4, shard_rows=4))):
        with pytest.raises(ValueError, match="other sequences"):
            training_order.materialise(other, path, MODEL, setting)
    assert {d for d, *_ in training_order.read_slots(path, 0, 100, cfg)} == {1, 2}
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / training_order.shard_name(0)).write_bytes(b"x")
    (tmp_path / "foreign" / ".shard-000000000001.bin.lost").write_bytes(b"x")
    with pytest.raises(ValueError, match="without a manifest"):
        training_order.materialise(one, f"{tmp_path}/foreign", MODEL, cfg)
    assert not (tmp_path / "foreign" / ".shard-000000000001.bin.lost").exists()
