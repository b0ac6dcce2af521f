"""Alignment against a brute-force version: whole texts by the libraries, all pairs of overlapping tokens."""

import hashlib
from collections import Counter

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from contestlab.llm import alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def bytes_of_a(token):
    """The byte-level alphabet, told from a single-byte round trip."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = sorted(set(range(256)) - set(shown))
    return bytes(ord(c) if ord(c) < 256 else hidden[ord(c) - 256] for c in token)


def spans(ids, pieces):
    out, at = [], 0
    for i, p in zip(ids, pieces):
        out.append((i, at, at + len(p)))
        at += len(p)
    return out


def tokens(models, text):
    a, b = models
    if not text:
        return [], []
    found = a.encode(" " + text, add_special_tokens=False)
    left = spans(found.ids, map(bytes_of_a, found.tokens))
    ids = b.encode(text)
    pieces = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
    right = spans(ids, pieces)
    if b"".join(pieces) != (" " + text).encode() or b"".join(map(bytes_of_a, found.tokens)) != (" " + text).encode():
        return [], []
    return left, right


def brute(models, rows):
    per, counts = [], Counter()
    for doc_id, text in rows:
        left, right = tokens(models, text)
        links, j = [], 0
        for x, s, e in left:
            while right[j][2] <= s:
                j += 1
            k = j
            while k < len(right) and right[k][1] < e:
                links.append((x, right[k][0]))
                k += 1
        counts.update(links)
        cuts = sorted({e for _, _, e in left} & {e for _, _, e in right})
        ids = lambda side, lo, hi: ",".join(str(x) for x, _, e in side if lo < e <= hi)
        texts = [f"{ids(left, lo, hi)}|{ids(right, lo, hi)}" for lo, hi in zip([0, *cuts], cuts)] if len(left) < 3000 else None
        per.append((doc_id, left, right, cuts, links, texts))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc_id, left, right, cuts, links, texts in per:
        digest = None if texts is None else hashlib.sha256(";".join(texts).encode()).hexdigest() if left else ""
        out.append((doc_id, len(left), len(right), len(cuts), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


def same(got, want):
    got, want = sorted(map(tuple, got), key=repr), sorted(want, key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:7] == w[:7] and w[7] in (None, g[7])


ODD = [
    "a  b", " lead", "trail ", "\ttab\nline\r\n", "▁mark", "x▁y", "<s> <unk> <0x41> <|endoftext|> </s>", "ﬁ ｆｕｌｌ　ｗ", "\x00nul \x1c fs", "﻿bom", "é é 日本語 \U0001f600\U0001f468‍\U0001f469",
    "   ", "\n", "a b   c", "don't I'll 12345 67,890.12", "word" * 500, "ab" * 40_000, "日本語テキスト " * 4000,
]


def test_equals_brute_force_on_odd_texts(spark, odd, models):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("row"), F.lit(1).alias("kind"), F.lit(2).alias("n_a"))
    got = alignment.alignment_counts(docs.repartition(3), A_PATH, B_PATH)
    same(got.collect(), brute(models, rows))


def test_equals_brute_force_on_the_documents(spark, models):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    same(alignment.op11_alignment(spark, "/root/testdata/sf0.001").collect(), brute(models, rows))


def test_pairs_beyond_the_broadcast_bound(spark, odd, models, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_BROADCAST", 0)
    same(alignment.alignment_counts(odd, A_PATH, B_PATH).collect(), brute(models, [(r.doc_id, r.text) for r in odd.collect()]))


def test_no_rows(spark, none):
    assert alignment.alignment_counts(none, A_PATH, B_PATH).count() == 0


def test_groups_and_links_are_the_operators_rows(spark):
    rows = spark.createDataFrame([(0, 7, "tokenizers differ")], "row long, doc_id long, text string")
    got = alignment.align(alignment.end_events(rows, lambda: (alignment.byte_bpe_side(A_PATH), alignment.piece_side(B_PATH)))).collect()
    assert [r.part for r in got] == [0, 1]
    assert sum(got[1].a_sizes) == len(got[1].a_ids) and sum(got[1].b_sizes) == len(got[1].b_ids)
    assert len(got[1].link_a) == len(got[1].a_ids) + len(got[1].b_ids) - len(got[1].a_sizes)
