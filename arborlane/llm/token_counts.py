"""Token counts by trie-shared dynamic programming.

A document's pre-tokens are its words, each with the space mark before it. The distinct pre-tokens of a batch go into a
trie. A node stands for a prefix and holds the best unigram score of it and the number of tokens of the best segmentation,
computed once from the nodes above it, however many pre-tokens share the prefix; the terminal nodes' counts are what a
document adds up. Nothing is shuffled: a batch of documents is counted where it is read, and the trie is dropped when it
has grown to ``trie_nodes`` nodes, so memory is bounded whatever the vocabulary of the corpus: a known count stands for a
node each. Pre-tokens longer than ``trie_chars`` bytes share little and run the same recurrence over a sliding row, without
nodes; their counts are kept for the rows of one step alone.

The pieces are those of a public SentencePiece model. It gives ranks, not probabilities, so the unigram score of the piece
of rank i is the logarithm of a Zipf law, ``-ln(i + 1)`` less the log of the normaliser. A character that no piece covers
is as many byte tokens as it has UTF-8 bytes, each with the score of the least piece. Of segmentations of equal score the
one with fewer tokens counts.

Defined results: null or empty text has no words and no tokens; words split at ``[\\x20\\x09-\\x0D]``; repeated rows are
counted each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlane.llm.blocks import batch
from arborlane.llm.words import tidy

SPACE = "▁"
TRIE_NODES, TRIE_CHARS = 400_000, 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, float], float, int]:
    """(score of each piece, score of a byte token, longest piece)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    norm = math.log(sum(1 / (k + 1) for k in range(len(plain))))
    scores = {model.id_to_piece(i): -math.log(k + 1) - norm for k, i in enumerate(plain)}
    return scores, -math.log(len(plain)) - norm, max(map(len, scores))


class Trie:
    """Prefixes of pre-tokens with the best score and token count of each; node 0 is the empty prefix."""

    def __init__(self, scores: dict[str, float], byte_score: float, longest: int):
        self.scores, self.byte_score, self.longest = scores, byte_score, longest
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.tokens = [0.0], [0]

    def _extend(self, text: str, end: int, best: list[float], tokens: list[int], base: int) -> tuple[float, int]:
        """Score and count of text[:end] from those of shorter prefixes; best[i - base] is that of text[:i]."""
        width = len(text[end - 1].encode("utf-8", "replace"))
        at = end - 1 - base
        top, count = best[at] + width * self.byte_score, tokens[at] + width
        get = self.scores.get
        for i in range(max(0, end - self.longest), end):
            score = get(text[i:end])
            if score is not None:
                s, k = best[i - base] + score, tokens[i - base] + 1
                if s > top + 1e-12 or (s >= top - 1e-12 and k < count):
                    top, count = s, k
        return top, count

    def insert(self, sorted_words: list[str]) -> list[int]:
        """Token count of each pre-token; they come sorted, so that the walk restarts where neighbours part."""
        out, path, best, tokens, before = [], [0], [0.0], [0], ""
        child = self.child
        for word in sorted_words:
            same = 0
            limit = min(len(word), len(before), len(path) - 1)
            while same < limit and word[same] == before[same]:
                same += 1
            del path[same + 1 :], best[same + 1 :], tokens[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                key = (path[-1], word[end - 1])
                node = child.get(key)
                if node is None:
                    score, count = self._extend(word, end, best, tokens, 0)
                    node = child[key] = len(self.best)
                    self.best.append(score)
                    self.tokens.append(count)
                path.append(node)
                best.append(self.best[node])
                tokens.append(self.tokens[node])
            out.append(tokens[-1])
            before = word
        return out

    def long(self, word: str) -> int:
        """Token count of a long pre-token, over a row of the last ``longest`` prefixes."""
        best, tokens, base = [0.0], [0], 0
        for end in range(1, len(word) + 1):
            score, count = self._extend(word, end, best, tokens, base)
            best.append(score)
            tokens.append(count)
            if len(best) > 4 * self.longest:
                drop = len(best) - self.longest
                del best[:drop], tokens[:drop]
                base += drop
        return tokens[-1]


def _counts(path: str, trie_nodes: int, trie_chars: int, rows_at_once: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*vocabulary(path))
        known: dict[bytes, int] = {}  # terminal counts of this trie, so at most as many as its nodes
        for rows in batches:
            words_of, tokens_of = [], []
            for at in range(0, rows.num_rows, rows_at_once):
                texts = pc.fill_null(rows.column(1).slice(at, rows_at_once), "").cast(pa.large_binary()).to_pylist()
                split = [t.split() for t in texts]
                new = {w for ws in split for w in ws if w not in known}
                short = sorted((SPACE + w.decode("utf-8", "replace"), w) for w in new if len(w) <= trie_chars)
                for (_, w), n in zip(short, trie.insert([s for s, _ in short]), strict=True):
                    known[w] = n
                long = {w: trie.long(SPACE + w.decode("utf-8", "replace")) for w in new if len(w) > trie_chars}
                known.update(long)
                count = known.__getitem__
                words_of += map(len, split)
                tokens_of += [sum(map(count, ws)) for ws in split]
                for w in long:
                    del known[w]
                if len(trie.best) > trie_nodes:
                    trie.clear()
                    known.clear()
            yield batch(id=rows.column(0), n_words=pa.array(words_of, pa.int64()), n_tokens=pa.array(tokens_of, pa.int64()))

    return run


def token_counts(
    docs: DataFrame,
    model: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    trie_nodes: int = TRIE_NODES,
    trie_chars: int = TRIE_CHARS,
) -> DataFrame:
    """One row for each input row: id, n_words, n_tokens."""
    two = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_tokens long"
    return two.mapInArrow(tidy(_counts(model or default_model(), trie_nodes, trie_chars)), kind).withColumnRenamed("id", id_col)
