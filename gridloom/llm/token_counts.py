"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a run of ``[^\\x20\\x09-\\x0D]+`` with the word-start mark in front.  Under a unigram
model its best segmentation is a shortest path, and the best score of a prefix depends on the prefix
alone.  Distinct pre-tokens are visited in sorted order, which is the depth-first order of their trie:
the stack holds the path from the root, one forward score and token count for each node, and a
pre-token recomputes only the nodes below the prefix that it shares with the one before.  The count
at its terminal node is stored, and documents add up stored counts.

Each task keeps its stored counts between batches, up to ``MEMO`` pre-tokens, and then starts anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
MEMO = 400_000
SLICE_BYTES = 4 << 20
#: below the least score of the vocabulary, for a character that no piece covers
UNKNOWN = 10.0
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces and unigram scores of a public vocabulary file; control and byte pieces are left out.

    The file ranks its pieces; by Zipf's law the piece of rank r has a probability in proportion to
    1 / (r + 2), whose logarithm is the score.  The bytes of uncovered characters are tokens.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): -math.log(r + 2) for r, i in enumerate(plain)}


class Trie:
    """Forward scores over the trie of the pre-tokens given to ``count``, in sorted order."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN

    def count(self, words: list[str]) -> Iterator[int]:
        """Tokens of each of ``words``, which are sorted."""
        pieces, longest, unknown = self.pieces, self.longest, self.unknown
        score, tokens, path = [0.0], [0], ""
        for word in words:
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del score[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, n = -math.inf, 0
                # the longest piece comes first, and a later one must be strictly better
                for start in range(max(0, end - longest), end):
                    s = pieces.get(word[start:end])
                    if s is not None and score[start] + s > best:
                        best, n = score[start] + s, tokens[start] + 1
                c = word[end - 1]
                if c not in pieces and score[end - 1] + unknown > best:
                    best, n = score[end - 1] + unknown, tokens[end - 1] + len(c.encode("utf-8", "surrogatepass"))
                score.append(best)
                tokens.append(n)
            path = word
            yield tokens[-1]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, n_words, n_tokens) for each row of ``docs``.

    Null, empty and blank texts have none; repeated rows count alike and null ids are ids.  Very long
    texts are counted whole, a slice of the batch at a time.  Bytes that are no UTF-8 count as the
    replacement character.  Other columns are not read.  The file at ``path`` is read by the driver, and
    its pieces, some 32,000, go to the executors.
    """
    src = docs.select(F.col(id_col), F.col(text_col).alias("__gl_text"))
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(pieces.value)
        memo: dict[bytes, int] = {}
        for b in batches:
            words_of, counts, held = [], [], 0
            n_words: list[int] = []

            def settle() -> None:
                new = {w for ws in words_of for w in ws}.difference(memo)
                if len(memo) + len(new) > MEMO:
                    memo.clear()
                    new = {w for ws in words_of for w in ws}
                order = sorted((w.decode("utf-8", "replace"), w) for w in new)
                memo.update(zip((w for _, w in order), trie.count([MARK + s for s, _ in order])))
                for ws in words_of:
                    counts.append(sum(map(memo.__getitem__, ws)))
                    n_words.append(len(ws))
                words_of.clear()

            for t in b.column(1).cast(pa.binary()):
                data = t.as_py() or b""
                words_of.append(data.split())
                held += len(data)
                if held > SLICE_BYTES:
                    settle()
                    held = 0
            settle()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(counts, pa.int64())], [id_col, "n_words", "n_tokens"])

    schema = docs.select(id_col).schema.add("n_words", "long").add("n_tokens", "long")
    return src.mapInArrow(run, schema)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
