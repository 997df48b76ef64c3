"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that give one token are proven whole
tokens. A text is cut before each run of white-space marks: no piece of the vocabulary goes on from another
character into a mark, so merges never cross such a cut. Newlines are in no multi-character piece, so a text is cut there
too. A cut piece that is a whole token counts one; only the rest is merged by the library.

Null and empty texts have 0 tokens and 0 bytes. Repeated rows are counted each. An empty table
gives an empty table. Very long words are merged but not remembered.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import append_columns

MARK = "▁"
_RUNS = re.compile(" +[^ ]*")


def whole_tokens(model_file: str) -> tuple[frozenset[str], frozenset[str]]:
    """The vocabulary strings that encode alone as one token: after a mark, and after a newline.

    Raises if the vocabulary has a piece that would let a merge cross a cut.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i)]
    if any(MARK in p[1:] and set(p) != {MARK} for p in pieces) or any("\n" in p for p in pieces):
        raise ValueError("the vocabulary has pieces across white space; the shortcut does not hold")
    plain = [p for p in pieces if MARK not in p]
    marked = [p[1:] for p in pieces if p[:1] == MARK and p[1:] and MARK not in p[1:]]
    first = frozenset(p for p, ids in zip(marked, model.encode(marked), strict=True) if len(ids) == 1)
    later = frozenset(p for p, ids in zip(plain, model.encode(["\n" + p for p in plain]), strict=True) if len(ids) == 3)
    return first, later


class _Counts(dict):
    """Pre-token -> number of tokens; whole tokens are known, the rest is merged on first sight."""

    def __init__(self, known, merge, limit):
        super().__init__(dict.fromkeys(known, 1))
        self.known, self.merge, self.limit = known, merge, limit

    def __missing__(self, word: str) -> int:
        if len(self) > len(self.known) + self.limit:
            self.clear()
            self.update(dict.fromkeys(self.known, 1))
        n = self.merge(word)
        if len(word) <= 64:
            self[word] = n
        return n


def token_counts(
    docs: DataFrame, model_file: str, *, text: str = "text", max_tokens: int = 4096, remember: int = 200_000
) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > ``max_tokens``).

    ``model_file`` is a path that every executor can read. Counts equal the library's for the
    whole text, without begin, end or added special tokens; special strings are plain text.
    """
    first, later = whole_tokens(model_file)

    def make():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)

        def merge_first(word: str) -> int:
            if "\n" in word:
                head, *rest = word.split("\n")
                return (firsts[head] if head else 1) + len(rest) + sum(laters[x] for x in rest if x)
            return len(model.encode(word)) if word else 1

        def merge_later(word: str) -> int:
            return len(model.encode("\n" + word)) - 2

        firsts, laters = _Counts(first, merge_first, remember), _Counts(later, merge_later, remember)

        def tokens(value: str) -> int:
            if not value:
                return 0
            value = value.replace(MARK, " ")
            if value[0] == " " or value[-1] == " " or "  " in value:  # runs of marks merge among themselves
                words = [x[1:] for x in _RUNS.findall(" " + value)]
            else:
                words = value.split(" ")
            return sum(map(firsts.__getitem__, words))

        def work(values):
            texts = [v or "" for v in values]
            return [[len(v.encode()) for v in texts], [tokens(v) for v in texts]]

        return work

    counted = append_columns(docs, text, make, "n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)
