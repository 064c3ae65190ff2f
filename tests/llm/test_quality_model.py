"""Quality classifier: features and solver against plain restatements, accuracy on held-out rows, awkward rows."""

import random
import zlib
from dataclasses import replace

import numpy as np
import pytest
from conftest import prose

from tidewatch.llm import quality_model as qm
from tidewatch.llm import queries

CFG = qm.QualityModelConfig()


def brute_positions(text, cfg):
    """Positions of all n-grams, one character and one word at a time."""
    m64 = (1 << 64) - 1

    def gram(values, n, seed):
        h = seed
        for v in values:
            h = (h ^ v) * 0x9E3779B97F4A7C15 & m64
            h ^= h >> 29
        return (h ^ n) % (1 << cfg.bits)

    chars = []
    for c in f" {text} ":
        c = " " if c in "\t\n\x0b\x0c\r " else c
        if c != " " or not chars or chars[-1] != " ":
            chars.append(c)
    words = "".join(chars).split(" ")
    words = [w for w in words if w]

    def kind(c):
        return (2 if c.islower() else 4 if c.isupper() else 8) if c.isalpha() else 16 if c.isdigit() else 32

    shapes = []
    for k, w in enumerate(words):
        bits = 0
        for c in w:
            bits |= kind(c)
        shapes.append(bits << 2 | (kind(w[0]) == 4) << 1 | (k > 0 and words[k - 1] == w))
    codes = [ord(c) for c in chars]
    out = {gram(codes[k:k + n], n, 1) for n in cfg.chars for k in range(len(codes) - n + 1)}
    return out | {gram(shapes[k:k + n], n, 2) for n in cfg.shapes for k in range(len(shapes) - n + 1)}


def test_positions(monkeypatch):
    rng = random.Random(1)
    texts = ["", " ", "a", "\n\n", "Aa aa aa AA 12 x9 !! é É ß 中 😀", "same same same", " x\ty ", prose(rng, 300), "\x00 \x85 　z"]
    indicator = qm.Indicator(CFG)
    for part in (qm.PART, 50):
        monkeypatch.setattr(qm, "PART", part)
        for t in texts:
            at = indicator.positions(t).tolist()
            assert len(at) == len(set(at)) and set(at) == brute_positions(t, CFG)


def test_descent_reaches_the_optimum():
    """The gap between the primal and the dual of the hinge loss closes."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 8)), np.where(rng.random(60) < 0.4, 1.0, -1.0)
    x[:, 0] += y
    bound = np.where(y > 0, 0.7, 1.3)
    rows = [(np.arange(8), v) for v in x]
    w = qm.descend(rows, y, bound, 8, 500)
    primal = w @ w / 2 + (bound * np.maximum(0, 1 - y * (x @ w))).sum()
    better = min(((w + d) @ (w + d) / 2 + (bound * np.maximum(0, 1 - y * (x @ (w + d)))).sum()) for d in rng.normal(size=(4000, 8)) * 0.05)
    assert primal <= better + 1e-3
    # equal rows, rows of zeros and one class do no harm
    assert np.isfinite(qm.descend([(np.arange(2), np.zeros(2))] * 3, np.ones(3), np.ones(3), 2, 5)).all()


def test_sigmoid_fits_probabilities():
    rng = np.random.default_rng(3)
    m = rng.normal(size=20000)
    good = rng.random(20000) < 1 / (1 + np.exp(-(2.5 * m + 0.5)))
    a, b = qm.sigmoid(m, good)
    assert a == pytest.approx(2.5, abs=0.15) and b == pytest.approx(0.5, abs=0.1)


def test_scales_are_log_count_ratios():
    cfg = replace(CFG, bits=3, min_rows=2)
    found = [np.array(x, np.int32) for x in ([1, 2], [1, 2], [2, 3], [2, 4])]
    good = np.array([True, True, False, False])
    s = qm._scales(found, good, cfg)
    # known: 1 (2 good), 2 (2 good, 2 bad); smoothed sums 3 + 3 good, 1 + 3 bad
    assert s[1] == pytest.approx(np.log((3 / 6) / (1 / 4))) and s[2] == pytest.approx(np.log((3 / 6) / (3 / 4)))
    assert not s[[0, 3, 4, 5, 6, 7]].any()


def made(rng, n):
    """Clean prose, and junk of the usual kinds: marks, capitals, fragments, repeats."""
    rows = []
    for i in range(n):
        w = prose(rng, rng.randint(3, 250)).split()
        bad = rng.random() < 0.3
        if bad:
            kind = rng.randrange(4)
            w = [x + "***" for x in w] if kind == 0 else [x.upper() + "!!" for x in w] if kind == 1 else [x for y in w for x in (y, "|")] if kind == 2 \
                else [x for x in w for _ in range(6)]
        rows.append((i, " ".join(w), 0 if bad else 1))
    return rows


def test_held_out_accuracy_and_awkward_rows(spark, awkward, nothing, tmp_path):
    rng = random.Random(4)
    rows = made(rng, 700)
    docs = [(i, t, "xx", "s", 1) for i, t, _ in rows] + [(None, "No id.", None, None, None), (9000, None, "a", "b", 0), (9001, "", None, None, 3), (3, rows[3][1], "", "", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (4, None, 1), (99999, 1, 1), (9001, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.BUILDERS["op13_quality_classifier"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and dict(out.dtypes)["predicted"] == "int"
    got = out.collect()
    assert len(got) == len(docs)
    truth = {i: q for i, _, q in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    again = {r["doc_id"]: r["score"] for r in queries.BUILDERS["op13_quality_classifier"](spark, str(tmp_path)).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in got)
    # held-out labels are never read: turning them all round changes nothing
    turned = [(i, 1 - q if i is not None and q is not None and zlib.crc32(str(i).encode()) % 4 == 2 else q, 0) for i, q, _ in labels]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/x/documents.parquet")
    spark.createDataFrame(turned, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/x/labels.parquet")
    third = {r["doc_id"]: r["score"] for r in queries.BUILDERS["op13_quality_classifier"](spark, f"{tmp_path}/x").collect()}
    assert third == again

    model = qm.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    odd = qm.score(awkward[0], model)
    assert odd.count() == len(awkward[1]) and odd.filter("score is null or not score between 0 and 1").count() == 0
    assert qm.score(nothing, model).collect() == []


def test_without_labels(spark, nothing):
    docs = spark.createDataFrame([(1, "Some text."), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in qm.score(docs, qm.train(docs, none)).collect()] == [0.5, 0.5]
    assert [r["score"] for r in qm.score(docs, qm.train(nothing, none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert [r["score"] for r in qm.score(docs, qm.train(docs, one)).collect()] == [pytest.approx(0.75)] * 2


def test_sample_is_bounded(spark):
    cfg = replace(CFG, fit_rows=20)
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(400)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i % 40, i % 2) for i in range(80)], "doc_id long, quality int")
    assert qm._label_sample(labels, "doc_id", "quality", cfg).count() == 20
    model = qm.train(docs, labels, cfg)
    assert np.isfinite(model.weight).all()
