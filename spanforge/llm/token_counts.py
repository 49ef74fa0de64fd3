"""Token counts: lengths of greedy word pieces by a linear longest-match automaton.

The vocabulary becomes a trie in which every node has a failure link and the number of tokens
that following the link pops. One walk over a word then gives the length of its greedy
longest-match-first segmentation in linear time, and no piece is ever built. The trie has two
roots: one for pieces that begin a word, one for pieces that continue it.

A word is walked with the low line in front that begins it, over the pieces as the vocabulary
has them. A first character without such a piece of its own so leaves the low line alone as one
token, and is counted by the pieces that continue.

A character at which no piece begins is one unknown token; the rest of its word is counted by
pieces. Null and empty texts have no words. Every row of the input gives one row, repeated rows
too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanforge.llm.common import as_bytes, in_worker, small_batches, table

MEMO = 400_000
BEGIN = "▁"
#: Lengths are summed with their unknown tokens above these bits; no text has 2^32 characters.
UNKNOWN = 32
ONE_UNKNOWN = (1 << UNKNOWN) + 1


class Automaton:
    """Greedy longest-match lengths over a vocabulary of first and continuing pieces."""

    def __init__(self, first: Iterable[str], continuing: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}, {}]
        ends = self.ends = [False, False]
        for root, pieces in ((0, first), (1, continuing)):
            for piece in pieces:
                node = root
                for c in piece:
                    following = self.next[node].get(c)
                    if following is None:
                        following = self.next[node][c] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    node = following
                ends[node] = ends[node] or bool(piece)
        # Where a node fails to, and the tokens that it pops then; a character at which no piece
        # begins is popped as an unknown token. Both roots have no link.
        self.link = [1] * len(self.next)
        self.popped = [0] * len(self.next)
        level = [0, 1]
        while level:  # breadth first: a link leads to a node nearer to a root
            below = []
            for parent in level:
                for c, node in self.next[parent].items():
                    below.append(node)
                    if ends[node]:
                        self.popped[node] = 1
                    elif parent < 2:
                        self.popped[node] = ONE_UNKNOWN
                    else:
                        self.link[node], self.popped[node] = self._follow(self.link[parent], c, self.popped[parent])
            level = below

    def _follow(self, at: int, c: str, popped: int) -> tuple[int, int]:
        """The node that ``c`` leads to from ``at``, and the tokens popped on the way."""
        following = self.next[at].get(c)
        while following is None:
            if at < 2:
                return 1, popped + ONE_UNKNOWN
            popped += self.popped[at]
            at = self.link[at]
            following = self.next[at].get(c)
        return following, popped

    def counts(self, word: str) -> int:
        """Tokens of ``word``, with those of them that are unknown above bit ``UNKNOWN``."""
        at, tokens = 0, 0
        for c in word:
            following = self.next[at].get(c)
            if following is None:
                following, tokens = self._follow(at, c, tokens)
            at = following
        while at > 1:  # the end of the word pops what is left
            tokens += self.popped[at]
            at = self.link[at]
        return tokens

    def length(self, word: str) -> int:
        """Number of pieces of ``word``; 0 if the pieces cannot cover it."""
        tokens = self.counts(word)
        return 0 if tokens >> UNKNOWN else tokens


def sentence_pieces(path: str) -> tuple[list[str], list[str]]:
    """First and continuing pieces of a sentencepiece file, unchanged: a leading low line begins a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    return [p for p in plain if p[0] == BEGIN], plain


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` for every row; unknown tokens are in ``n_tokens``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or default_vocabulary()
        automaton = in_worker(f"automaton {path}", lambda: Automaton(*sentence_pieces(path)))
        memo = in_worker(f"lengths {path}", dict)
        for batch in small_batches(batches):
            rows = []
            for text in as_bytes(batch.column("text")):
                words = text.split()
                new = set(words).difference(memo)
                if len(memo) + len(new) > MEMO:
                    memo.clear()
                    new = set(words)
                for word in new:
                    memo[word] = automaton.counts(BEGIN + word.decode("utf-8", "replace"))
                total = sum(map(memo.__getitem__, words))
                rows.append((len(words), total & ((1 << UNKNOWN) - 1), total >> UNKNOWN))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(text AS string) AS text").mapInArrow(
        count, "doc_id long, n_words long, n_tokens long, n_unknown long"
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
