"""What the piece tokenizers share: the model file and exact pre-tokens.

In the vocabulary the space mark stands only at the head of a piece, so no
merge ever crosses from a letter to a mark: a text may be cut before each run
of marks and its parts be tokenised one by one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

MARK = "▁"
PRETOKEN = re.compile(r" +[^ ]*")


def model_bytes(path: str) -> bytes:
    """The model file, read once on the driver; a fixed half megabyte."""
    with open(path, "rb") as f:
        return f.read()


def marked(text: str) -> str:
    """The text as the tokenizer sees it, with plain spaces for marks.

    One space is put in front; a mark in the text itself counts as a space.
    """
    return " " + text.replace(MARK, " ") if text else ""


def pretokens(text: str) -> list[str]:
    return PRETOKEN.findall(marked(text))


def coded_pretokens(texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens of some texts, how many each text has, and the place of each among the distinct ones.

    The same as ``pretokens`` of every text, one after another; only distinct ones become Python objects.
    """
    parts = [marked(t or "").encode() for t in texts]
    whole = b"".join(parts)
    begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    space = np.frombuffer(whole, np.uint8) == 0x20
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[begins[:-1][np.diff(begins) > 0]] = True  # a text begins with a space, whatever stands before it
    starts = np.flatnonzero(head)
    ends = pa.py_buffer(np.append(starts, len(whole)).astype(np.int64))
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, ends, pa.py_buffer(whole)]).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), np.diff(np.searchsorted(starts, begins)), found.indices.to_numpy()


@lru_cache(maxsize=2)
def processor(proto: bytes):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    for i in range(sp.vocab_size()):
        if MARK in sp.id_to_piece(i).lstrip(MARK):
            raise ValueError("a piece holds a space mark after other text; texts cannot be cut at marks")
    return sp
