"""Token counts by a unigram model, with forward scores shared along a trie of distinct pre-tokens.

A pre-token is a run of characters other than white space, behind the mark of a word's start. The score of a segmentation is
the sum of its pieces' log probabilities; the forward score of a prefix is that of its best segmentation. As it depends on the
prefix alone, it belongs to the prefix's node in a trie of all pre-tokens. The trie is walked depth first, in sorted order:
each pre-token keeps the scores of the path that it shares with the one before and adds those of its own nodes, so that a
shared prefix is scored once; at its terminal node it gets the number of tokens on the best path.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.common import bounded_batches, text_runs

START = "▁"
#: Distinct pre-tokens whose counts a worker keeps; when more have come, it starts anew.
KEPT = 400_000


class Unigram:
    """Pieces with log probabilities. A character that no piece covers is its UTF-8 bytes, a token each."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 10.0
        self.lengths: dict[str, tuple[int, ...]] = {}
        ends: dict[str, set[int]] = {}
        for piece in scores:
            ends.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {c: tuple(sorted(n)) for c, n in ends.items()}

    @classmethod
    def from_sentencepiece(cls, model_file: str) -> Unigram:
        """The pieces of a SentencePiece file, with probabilities that fall as 1 / rank in the order of its scores."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
        total = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
        return cls({model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(ranked)})

    def counts(self, tokens: list[str]) -> dict[str, int]:
        """The number of tokens of each distinct pre-token. Of equal scores the fewer tokens count."""
        scores, lengths = self.scores, self.lengths
        path, best, number, out = "", [0.0], [0], {}
        for token in sorted(tokens):
            shared, most = 0, min(len(path), len(token))
            while shared < most and path[shared] == token[shared]:
                shared += 1
            del best[shared + 1 :], number[shared + 1 :]
            for i in range(shared + 1, len(token) + 1):
                char = token[i - 1]
                wide = len(char.encode("utf-8", "surrogatepass"))
                score, count = best[i - 1] + self.byte * wide, number[i - 1] + wide
                for n in lengths.get(char, ()):
                    if n > i:
                        break
                    piece = scores.get(token[i - n : i])
                    if piece is not None:
                        new, steps = best[i - n] + piece, number[i - n] + 1
                        if new > score or new == score and steps < count:
                            score, count = new, steps
                best.append(score)
                number.append(count)
            path = token
            out[token] = number[-1]
        return out


def counted(docs: DataFrame, model: Unigram) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of each row of docs (doc_id, text).

    Whole texts are counted; a null or empty text has no tokens; repeated rows get a row each; an empty table gives none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            for a, b in text_runs(texts):
                split = [(x or "").split() for x in texts[a:b].to_pylist()]
                if len(kept) > KEPT:
                    kept.clear()
                new = set().union(*split).difference(kept)
                kept.update((k[1:], n) for k, n in model.counts([START + x for x in new]).items())
                get = kept.__getitem__
                columns = [batch.column(0)[a:b], pa.array([len(x) for x in split], pa.int64()), pa.array([sum(map(get, x)) for x in split], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pretokens", "n_tokens"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")
