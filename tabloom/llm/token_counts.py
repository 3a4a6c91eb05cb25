"""Token counts with a whole-token shortcut (sentencepiece BPE).

A space starts a pre-token. `separable` proves from the vocabulary that no piece crosses
such a boundary or holds a line break, so the count of a text is the sum over its pre-tokens.
`whole_tokens` proves which pre-tokens encode alone as one token; those are counted
directly. Only the rest is merged, once per distinct pre-token and worker.

Null and empty texts have no tokens; the ids pass through unchanged, null or repeated.
"""

import re
from functools import lru_cache

from pyspark.sql import functions as F

SPACE = "▁"
#: Merged pre-tokens a worker remembers, and the longest it remembers.
REMEMBERED, LONGEST = 400_000, 48


def separable(pieces):
    """True if a space can only begin a piece and no piece holds a line break."""
    return not any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in pieces)


def whole_tokens(processor):
    """Pre-tokens, without their space, that encode alone as exactly one token."""
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    if not separable(pieces):
        raise ValueError("pieces of this vocabulary cross spaces; pre-tokens are not independent")
    tails = [p[1:] for p in pieces if p.startswith(SPACE) and len(p) > 1 and SPACE not in p[1:]]
    return {t for t, ids in zip(tails, processor.encode(tails), strict=True) if len(ids) == 1}


class PreTokenCounter:
    """Counts tokens of whole texts."""

    def __init__(self, path):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = dict.fromkeys(whole_tokens(self.processor), 1)
        self.known = dict(self.whole)

    def merged(self, spaces, run):
        """Tokens of a run without spaces and line breaks that follows so many spaces."""
        if not spaces:  # a line break keeps the processor from putting a space before the run
            return len(self.processor.encode("\n" + run)) - 2 if run else 0
        return len(self.processor.encode(" " * (spaces - 1) + run)) if spaces > 1 or run else 1

    def resolved(self, spaces, word):
        first, *lines = word.split("\n")
        return self.merged(spaces, first) + sum(1 + self.merged(0, x) for x in lines)

    def learned(self, word):
        n = self.known.get(word)
        if n is None:
            n = self.resolved(1, word)
            if len(word) <= LONGEST:
                if len(self.known) > REMEMBERED + len(self.whole):
                    self.known = dict(self.whole)
                self.known[word] = n
        return n

    def count(self, text):
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if "" in words:  # runs of spaces belong to the word after them
            total, spaces = 0, 1
            for word in words:
                if word:
                    total += self.learned(word) if spaces == 1 else self.resolved(spaces, word)
                spaces = 1 if word else spaces + 1
            return total + (self.merged(spaces - 1, "") if spaces > 1 else 0)
        found = list(map(self.known.get, words))
        if None in found:
            found = map(self.learned, words)
        return sum(found)


@lru_cache(maxsize=2)
def counter(path):
    return PreTokenCounter(path)


def count_tokens(documents, vocabulary, limit=4096):
    """doc_id, n_bytes, n_tokens, over_limit of every text; other columns are not read."""

    def count(batches):
        import pyarrow as pa

        tokens = counter(vocabulary)
        for batch in batches:
            n = [tokens.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    counted = texts.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
