"""Best-fit-decreasing packing of tokenised documents into sequences.

Documents are tokenised whole, ended by one id, and cut only if longer than a sequence.
The pieces, numbers without texts, are dealt at random to shards of bounded size; each
shard packs its own, longest first, into the open sequence with the least room that still
takes the piece. A segment tree over remaining capacities finds that room in
logarithmic time. A shard leaves about one sequence part-filled.

Null and empty texts are the end id alone. Repeated rows are packed as often as they occur.
"""

import math
import os
import re
import zlib
from array import array
from itertools import filterfalse

from pyspark.sql import functions as F

from tabloom.llm.common import kept, slices, stored

#: Distinct parts a worker remembers, the longest it remembers, and characters encoded together.
REMEMBERED, LONGEST, RUN_CHARACTERS = 800_000, 48, 2_000_000
STOPS = re.compile(rb"([A-Za-z])([.,])(?= )")
#: Pieces packed together by one task.
SHARD_PIECES = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of whole texts, four little-endian bytes each.

    The tokenizer lowers letters, drops white space, never joins across it, and keeps letters apart
    from punctuation. So a text's ids are those of its parts in a row, where A-Z may be lowered
    first and a comma or period between a letter and a blank stands alone. Each distinct
    part is encoded once. Texts that may hold special strings are cut at blanks only.
    """

    def __init__(self, path):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel unit
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}

    def parts(self, text):
        line = (text or "").encode().replace(b"\n", b" ")
        if b"<|" not in line:
            line = STOPS.sub(rb"\1 \2", line.lower())
        return line.split(b" ")

    def ids(self, texts):
        """The ids of each of some texts."""
        every = [self.parts(text) for text in texts]
        new = set()
        for parts in every:
            new.update(filterfalse(self.known.__contains__, parts))
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set().union(*every)
        new = list(new)
        encoded = self.tokenizer.encode_batch([p.decode() for p in new], add_special_tokens=False)
        self.known.update((p, array("I", e.ids).tobytes()) for p, e in zip(new, encoded, strict=True))
        found = [b"".join(map(self.known.__getitem__, parts)) for parts in every]
        for part in new:
            if len(part) > LONGEST:
                del self.known[part]
        return found


def word_ids(path):
    return kept(("packing", path), lambda: WordIds(path))


class RoomTree:
    """Counts of open sequences by room left; finds the least room that is enough."""

    def __init__(self, capacity):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, room, n):
        node = room + self.leaves
        while node:
            self.counts[node] += n
            node >>= 1

    def tightest(self, need):
        """The least room >= need with an open sequence, or None."""
        counts, node = self.counts, need + self.leaves
        if counts[node]:
            return need
        while node > 1:
            if not node & 1 and counts[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if counts[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit(lengths, capacity):
    """(bin, offset) of each length; lengths come in falling order."""
    tree, open_bins, bins, placed = RoomTree(capacity), {}, 0, []
    for need in lengths:
        room = tree.tightest(need)
        if room is None:
            room, at, bins = capacity, bins, bins + 1
        else:
            at = open_bins[room].pop()
            tree.add(room, -1)
        placed.append((at, capacity - room))
        if room > need:
            open_bins.setdefault(room - need, []).append(at)
            tree.add(room - need, 1)
    return placed


def runs(batch, characters):
    """(doc_id, text) of a batch in lists of about so many characters."""
    held, size = [], 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
        held.append((doc_id, text))
        size += len(text or "")
        if size >= characters:
            yield held
            held, size = [], 0
    if held:
        yield held


def tokenised_pieces(documents, vocabulary, capacity=4096, end_id=1):
    """One row per piece, without its ids: doc_id, piece, start, length, ids_crc32."""

    def cut(batches):
        import pyarrow as pa

        tokens, end = word_ids(vocabulary), end_id.to_bytes(4, "little")
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in slices(batches):
            rows = []
            for docs in runs(batch, RUN_CHARACTERS):
                for (doc_id, _), ids in zip(docs, tokens.ids([text for _, text in docs]), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(documents, vocabulary, capacity=4096, end_id=1, shard_pieces=SHARD_PIECES):
    """Pieces with sequence_id and offset, at most `capacity` tokens a sequence."""
    pieces = stored(tokenised_pieces(documents, vocabulary, capacity, end_id), "pieces")
    shards = max(1, math.ceil(pieces.count() / shard_pieces))

    def place(shard):
        shard = shard.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        placed = best_fit(shard["length"].tolist(), capacity)
        shard["sequence_id"] = [(int(s) << 32) + at for s, (at, _) in zip(shard["shard"], placed, strict=True)]
        shard["offset"] = [offset for _, offset in placed]
        return shard.drop(columns="shard")

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(place, f"{PIECES}, sequence_id long, offset long")
