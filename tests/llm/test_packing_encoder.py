"""Packing's encoder of many texts: the library's ids, from few calls."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from contestlab.llm import packing

ODD = ["", " ", "  ", "\n", "\t", "\r\n", "\u001c", "\u001f", "\u0085", "\u00a0", "\u1680", "\u2003", "\u2009", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\u180e"]
ODD += ["a", "Of", "1234", "'s", "'ll", "don't", ".", ",\n", "\u00e9", "\u00f1and\u00fa", "\u65e5\u672c", "\U0001f600", "-", "<|endoftext|>", "<|endof", "text|>", "x" * 70]


@pytest.fixture
def encode():
    made = packing.byte_bpe(packing.ranks_path())
    made.forget()
    yield made
    made.forget()


def random_texts(rng, n):
    return ["".join(" " * int(rng.random() < 0.6) + ODD[i] for i in rng.integers(0, len(ODD), int(rng.integers(0, 12)))) for _ in range(n)]


@pytest.mark.parametrize("at_once", [None, 3])
def test_ids_are_the_librarys(encode, at_once, monkeypatch):
    if at_once:
        monkeypatch.setattr(packing, "CHUNKS_AT_ONCE", at_once)
        monkeypatch.setattr(packing, "UNITS_AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    plain = [" ".join(f"w{i}.\nThe" for i in rng.integers(0, 50, int(rng.integers(1, 30)))) for _ in range(200)]
    texts = [*ODD, *random_texts(rng, 1500), *plain]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [[*library.encode(x, add_special_tokens=False).ids, 7] for x in texts]
    ids, counts = packing.encoded(pa.array(texts).slice(0), encode, 7)
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    ids, counts = packing.encoded(pa.array(texts).slice(40, 60), encode, 1 << 17)  # an end that 16 bits don't hold
    want = [[*x[:-1], 1 << 17] for x in want[40:100]]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_different_chunks_share_calls(encode, monkeypatch):
    calls, ordinary = [], encode.ordinary

    def counted(text):
        calls.append(len(text))
        return ordinary(text)

    monkeypatch.setattr(encode, "ordinary", counted)
    texts = [" ".join(f"q{i}x{j}" for j in range(100)) for i in range(200)]
    packing.encoded(pa.array(texts), encode, 0)
    assert len(calls) == len(texts) + 1  # a text's head each, and all 20,000 chunks together


def test_slices_hold_all_texts_in_bounded_size():
    sizes = np.array([5, 0, 3, 9, 20, 0, 0, 1, 8, 4])
    assert packing.slices(sizes, 8) == [(0, 3), (3, 1), (4, 1), (5, 3), (8, 1), (9, 1)]
    assert packing.slices(sizes, 100) == [(0, 10)] and packing.slices(sizes[:0], 8) == [] and packing.slices(sizes[5:7], 8) == [(0, 2)]
