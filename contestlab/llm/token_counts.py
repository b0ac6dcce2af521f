"""Token counts of a unigram tokenizer without its tokens: Viterbi that carries only scores and counts.

The tokenizer is the unigram model over a public vocabulary: white space other than the space stays text, a space
becomes the mark U+2581, one mark is put before the text if it doesn't begin with one, and the text is cut before every
mark. In each segment an Aho-Corasick automaton enumerates the vocabulary's matches by their ends, the longest first,
and dynamic programming keeps for every position the best score and the number of pieces on the way there. Ties go to
what the tokenizer reaches first: the piece that starts earliest. A character at which no piece of one character
matches may stand for itself at the least score less 10; it counts one piece for each of its UTF-8 bytes (byte
fallback), or, where the vocabulary lacks byte pieces, runs of such characters count one.

The vocabulary file gives an order of pieces by frequency, not their probabilities, so a piece's log-probability is
Zipf's: minus the logarithm of its rank, normalised.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 200_000
CACHED_LENGTH = 64


def unigram_pieces(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(piece, log-probability) of every text piece of a sentencepiece vocabulary file, and whether it has bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1.0 / (r + 1) for r in range(len(ids))))
    pieces = [(model.id_to_piece(i), -math.log(r + 1) - total) for r, i in enumerate(ids)]
    return pieces, sum(map(model.is_byte, range(model.get_piece_size()))) == 256


class Counter:
    """text -> (pieces, of these for unknown characters, log-probability of the best segmentation)."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.known: dict[str, tuple[int, int, float]] = {}

    def segment(self, text: str) -> tuple[int, int, float]:
        size = len(text)
        score, pieces, odd = [0.0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
        at_unknown = [False] * (size + 1)  # the best way here ends with an unknown character
        done = 0  # positions up to here are final

        def close(upto: int, single: bool, reached: bool) -> None:
            """Let the character before `upto` stand for itself, unless it is a piece."""
            if single:
                return
            now = score[upto - 1] + self.unknown
            if not reached or now > score[upto]:
                score[upto], at_unknown[upto] = now, True
                made = len(text[upto - 1].encode("utf-8", "surrogatepass")) if self.byte_fallback else int(not at_unknown[upto - 1])
                pieces[upto], odd[upto] = pieces[upto - 1] + made, odd[upto - 1] + made

        single = reached = False
        for end, (length, value) in self.automaton.iter(text):
            end += 1
            if end != done + 1:
                while done + 1 < end:
                    done += 1
                    close(done, single, reached)
                    single = reached = False
            start = end - length
            now = score[start] + value
            if not reached or now > score[end]:
                score[end], pieces[end], odd[end], at_unknown[end], reached = now, pieces[start] + 1, odd[start], False, True
            if length == 1:
                single = True
        while done < size:
            done += 1
            close(done, single, reached)
            single = reached = False
        return pieces[size], odd[size], score[size]

    def __call__(self, text: str) -> tuple[int, int, float]:
        known, total, odd, score = self.known, 0, 0, 0.0
        if not text:
            return 0, 0, 0.0
        parts = text.replace(" ", MARK).split(MARK)
        # The text's own first mark takes the place of the one put before it.
        for part in parts[1:] if not parts[0] else parts:
            found = known.get(part)
            if found is None:
                found = self.segment(MARK + part)
                if len(part) <= CACHED_LENGTH:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[part] = found
            total += found[0]
            odd += found[1]
            score += found[2]
        return total, odd, score


@cache
def counter(path: str) -> Counter:
    """One automaton and cache for each worker."""
    return Counter(*unigram_pieces(path))


def token_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, n_byte_tokens and log_score in place of text_col.

    Null and empty texts have no tokens and score 0; a text of blanks has the tokens of its marks; texts of any length
    are counted whole, in memory that grows with the longest run without a space. Repeated rows and null ids stay
    rows; other columns are kept, but columns of the three names are replaced. An empty input gives an empty result.
    """
    made = ("n_tokens", "n_byte_tokens", "log_score")
    kept = docs.drop(text_col, *[c for c in docs.columns if c.lower() in made])
    others = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            found = [count(text.as_py() or "") for text in batch.column(len(others))]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *columns], names=[*plain, *made])

    plain = [f"c{i}" for i in range(len(others))]
    rows = docs.select(*[c.alias(name) for c, name in zip(quoted(kept), plain)], F.col(text_col).alias("text"))
    schema = rows.drop("text").schema.add("n_tokens", "long").add("n_byte_tokens", "long").add("log_score", "double")
    return rows.mapInArrow(run, schema).toDF(*others, *made)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole document.

    Null and empty texts have none; repeated rows and null ids stay rows; ties go to what the tokenizer reaches first; an
    empty table gives an empty result; other columns are not read.
    """
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path()).select(
        "doc_id", "n_tokens", "n_byte_tokens", F.col("log_score")
    )
