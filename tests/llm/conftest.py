import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, keep_id string, row string, size string"


def prose(rng, n, base="abcdefghij"):
    return " ".join("".join(rng.choice(base) for _ in range(rng.randint(2, 6))) for _ in range(n))


def awkward_rows():
    """Nulls everywhere, empty and long texts, ties, repeats, white space, byte oddities, near copies."""
    rng = random.Random(7)
    passage = prose(rng, 30)
    near = prose(rng, 200).split()
    texts = [None, "", " ", "\n", "\t\n \x0b", "one", "one two", "one  two", " one two", "ONE two", "x" * 49, "x" * 50, "x" * 5000,
             "é" * 60, "a\x00b c", "▁mark ▁▁ x", "<s> </s> <unk> <0x0A>", "=" * 300 + " " * 40 + "z", "😀中 𝔘 ﬁ", "..",
             passage, passage + "\n" + prose(rng, 25), prose(rng, 10) + " " + passage, passage, "same line here again ok\n" * 12,
             "Lower lower LOWER\n\nlast line\n", "line a b c d e f g h i\nline a b c d e f g h j\nline a b c d e f g h i\n",
             prose(rng, 6000), prose(rng, 40) + "\n" + passage.upper(), "12345 678", "%%% *** <<>> ||", "ab " * 400]
    for k in range(12):  # near copies: one word changed
        w = list(near)
        w[5 * k] = f"z{k}"
        texts.append(" ".join(w))
    texts += [prose(rng, rng.randint(3, 120)) for _ in range(25)]
    langs, sources = ["en", "de", None, "fr"], ["b", "a", None, "Z", "é"]
    rows = [(i, t, langs[i % 4], sources[i % 5], None if i % 3 else i, "no", "7", "r", "s") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[3], rows[3], (None, passage, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None),
             (-5, "one two", "de", "a", 1, "", "", "", "")]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    rows = awkward_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df, [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
