"""Token ids of whole texts in binary files with Elias-Fano encoded document boundaries.

A corpus is a folder of segments. A segment file holds, all little-endian: a header (HEADER), the rising boundaries of its
documents and the rising ids of those that have one, both Elias-Fano encoded, and the token ids of all its documents as one
array of 2 or 4 bytes each. Elias-Fano keeps the low bits of each number as they are and the high bits in unary: about
2 + log2(universe / count) bits a number, with the place of every SAMPLE-th one noted, so that `select` reads single boundaries
without a table of 64-bit offsets.

Texts are dealt to ranges of (doc_id, hash of the text, place) and sorted there, so equal ids and null ones are spread too;
a task tokenises its range and writes a file for each SEGMENT_IDS ids or so. Spark's own text writer puts the bytes into files,
one a record, followed by its line feed: so the commit of its tasks holds for segments too, on any file system. Segments are numbered by
range and place in it; a document's start in the corpus is the sum of all segments before plus its boundary.

Null and empty texts are the end id alone. Rows without doc_id come first. Repeated rows are written as often as they
occur, in order of their texts' hash. Very long texts make a longer segment. An empty table makes no file. Other columns are
not read.
"""

import math
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.llm.common import shared_path, stored
from tabloom.llm.packing import LONGEST, REMEMBERED, RUN_CHARACTERS, runs

SEGMENT_IDS = 1 << 22
#: Rows of a batch that a worker holds as Python objects.
TEXTS = 512
#: Bytes of text in a range, unless that makes more than MOST_PARTS of them.
PART_BYTES, MOST_PARTS = 32 << 20, 20_000
#: Every so many ones of the high bits have their place noted.
SAMPLE = 256
#: Rows of the segment table that may be sent to all tasks; each stands for SEGMENT_IDS ids.
BROADCAST_SEGMENTS = 50_000
#: Segment file: mark, range, place in it, bytes an id, documents, those without doc_id, ids, lengths of both encodings.
HEADER, MARK = struct.Struct("<8sIIIQQQQQ"), b"IDSEGM1\n"
DOCUMENTS = "doc_id long, part int, seq int, begin long, n_tokens long, ids_crc32 long"


class EliasFano:
    """Rising numbers from 0 on in near-minimal space."""

    HEAD = struct.Struct("<QQB")

    def __init__(self, data):
        self.count, self.most, self.low_bits = self.HEAD.unpack_from(data)
        lows, highs, _ = sizes = self.sizes(self.count, self.most, self.low_bits)
        at = self.HEAD.size
        self.lows, self.highs = data[at : at + lows], data[at + lows : at + lows + highs]
        self.samples = np.frombuffer(data[at + lows + highs : at + sum(sizes)], "<u4")

    @staticmethod
    def sizes(count, most, low_bits):
        """Bytes of low bits, high bits and samples."""
        return -(-count * low_bits // 8), -(-(count + (most >> low_bits) + 1) // 8) if count else 0, 4 * -(-count // SAMPLE)

    @classmethod
    def encode(cls, values):
        values = np.asarray(values, np.uint64)
        count, most = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (most // count).bit_length() - 1) if count else 0
        lows, highs, _ = cls.sizes(count, most, low_bits)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(count)
        bits = np.zeros(8 * highs, np.uint8)
        bits[ones] = 1
        return cls.HEAD.pack(count, most, low_bits) + low.tobytes() + np.packbits(bits, bitorder="little").tobytes() + ones[::SAMPLE].astype("<u4").tobytes()

    def values(self):
        """All numbers at once."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.highs, np.uint8), bitorder="little"))
        high = (ones - np.arange(self.count)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(np.frombuffer(self.lows, np.uint8), bitorder="little", count=self.count * self.low_bits)
        shifts = np.arange(self.low_bits, dtype=np.uint64)
        return high | (bits.reshape(self.count, self.low_bits).astype(np.uint64) << shifts).sum(1, dtype=np.uint64)

    def select(self, k):
        """The k-th number, read on its own from the nearest sample on."""
        if not 0 <= k < self.count:
            raise IndexError(k)
        place, rest = int(self.samples[k // SAMPLE]), k % SAMPLE
        byte = place >> 3
        word = int.from_bytes(self.highs[byte : byte + 8], "little") >> (place & 7) << (place & 7)
        while (ones := word.bit_count()) <= rest:
            rest, byte = rest - ones, byte + 8
            word = int.from_bytes(self.highs[byte : byte + 8], "little")
        for _ in range(rest):
            word &= word - 1  # drop the lowest one
        high = 8 * byte + (word & -word).bit_length() - 1 - k
        at = k * self.low_bits
        low = int.from_bytes(self.lows[at >> 3 : (at + self.low_bits + 7) >> 3], "little") >> (at & 7)
        return high << self.low_bits | low & ((1 << self.low_bits) - 1)


class Segment:
    """A segment file: documents by their place in it."""

    def __init__(self, data):
        data = memoryview(data)
        mark, self.part, self.seq, self.width, self.documents, self.nameless, self.tokens, first, second = HEADER.unpack_from(data)
        at = HEADER.size + first + 8 + second
        if mark != MARK or len(data) < at + self.width * self.tokens:
            raise ValueError("no whole segment")
        self.boundaries = EliasFano(data[HEADER.size : HEADER.size + first])
        self.least = struct.unpack_from("<q", data, HEADER.size + first)[0]
        self.names = EliasFano(data[HEADER.size + first + 8 : at])
        self.array = np.frombuffer(data[at : at + self.width * self.tokens], f"<u{self.width}")

    @staticmethod
    def encode(part, seq, width, doc_ids, sizes, ids):
        """The bytes of a segment; doc_ids rise, those that are None come first."""
        named = [i for i in doc_ids if i is not None]
        least = named[0] if named else 0
        bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(sizes, dtype=np.uint64)]))
        names = EliasFano.encode(np.array([i - least for i in named], np.uint64))
        head = HEADER.pack(MARK, part, seq, width, len(doc_ids), len(doc_ids) - len(named), sum(sizes), len(bounds), len(names))
        return b"".join([head, bounds, struct.pack("<q", least), names, *ids])

    def __len__(self):
        return self.documents

    def doc_id(self, k):
        return None if k < self.nameless else self.least + self.names.select(k - self.nameless)

    def ids(self, k):
        """The token ids of one document, its end id included."""
        return self.array[self.boundaries.select(k) : self.boundaries.select(k + 1)]


class ByteIds:
    """Ids of whole texts by a byte-level vocabulary, `width` little-endian bytes each.

    Its pattern starts a pre-token at each space before another character, takes a line break between others alone, and a
    comma or period between a letter and white space too; no merge crosses pre-tokens. So a text's ids are those of its parts in a row,
    and a part is encoded once while it is remembered: those not met among the last REMEMBERED / 2 new ones are forgotten. New parts are
    encoded as lines of one text. Texts with special strings, or other vocabularies, are encoded whole.
    """

    STOPS = re.compile(rb"[.,](?<=[A-Za-z].)(?=[ \n])")
    ODD = re.compile(r"\s(?:\s|\Z)|\0")
    #: ASCII white space other than space and line feed, and what marks the parts.
    RARE = b"\0\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
    SPACES = re.compile(r" (?=\S)")
    #: Parts encoded as one text.
    LINES = 256

    def __init__(self, path, end_id=0):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel unit
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        made = json.loads(self.tokenizer.to_str())
        steps = made["pre_tokenizer"] or {}
        self.apart = made["normalizer"] is None and (steps.get("type"), steps.get("use_regex"), steps.get("add_prefix_space")) == ("ByteLevel", True, False)
        self.special = [t["content"] for t in made["added_tokens"]]
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def parts(self, text):
        if not text:
            return []
        if not self.apart or any(s in text for s in self.special):
            return [text.encode()]
        line = text.encode()
        plain = line.isascii() and len(line.translate(None, self.RARE)) == len(line) and not line.endswith((b" ", b"\n"))
        if self.ODD.search(text) if not plain else b"  " in line or b"\n\n" in line or b" \n" in line or b"\n " in line:
            first, *rest = self.SPACES.split(text)
            return [first.encode(), *[b" " + p.encode() for p in rest]]
        line = self.STOPS.sub(rb"\0\g<0>", line)
        return line.replace(b"\n", b"\0\n\0").replace(b" ", b"\0 ").split(b"\0")

    def line_like(self, part):
        """Whether a part is one word, with a space before it or not, so that a line feed after it is a pre-token of its own."""
        word = part[1:] if part[:1] == b" " else part
        return part.split() == [word] if part.isascii() else part.decode().split() == [word.decode()]

    def encoded(self, parts):
        """Ids of parts, as bytes: those like lines many at once."""
        kind, found, lines, rest = f"<u{self.width}", {}, [], []
        for p in parts:
            (lines if self.apart and len(self.line) == 1 and self.line_like(p) else rest).append(p)
        groups = [lines[k : k + self.LINES] for k in range(0, len(lines), self.LINES)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([b"\n".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, kind)
            ends = (np.flatnonzero(ids == self.line[0]) * self.width).tolist()
            data, starts = ids.tobytes(), [0, *[x + self.width for x in ends]]
            found.update(zip(group, [data[a:b] for a, b in zip(starts, [*ends, len(data)], strict=True)], strict=True))
        found.update(zip(rest, [np.array(e.ids, kind).tobytes() for e in self.tokenizer.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False)]))
        return found

    def ids(self, texts):
        """The ids of each of some texts, as bytes."""
        rows, holes = [], []
        for text in texts:
            parts = self.parts(text)
            ids, at = list(map(self.known.get, parts)), -1
            try:
                while True:
                    at = ids.index(None, at + 1)
                    holes.append((ids, at, parts[at]))
            except ValueError:  # no more
                rows.append(ids)
        new = {part for _, _, part in holes}
        made = {p: x for p in new if (x := self.older.get(p)) is not None}
        made.update(self.encoded([p for p in new if p not in made]))
        for ids, at, part in holes:
            ids[at] = made[part]
        self.known.update((p, x) for p, x in made.items() if len(p) <= LONGEST)
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        return list(map(b"".join, rows))


@lru_cache(maxsize=2)
def byte_ids(path, end_id):
    return ByteIds(path, end_id)


def slices(batches, rows=TEXTS):
    """The batches cut into ones of at most so many rows."""
    return (b.slice(k, rows) for b in batches for k in range(0, len(b), rows))


def write_corpus(documents, vocabulary, path, end_id=0, segment_ids=SEGMENT_IDS, part_bytes=PART_BYTES):
    """Write the ids of all documents below a new path, in rising doc_id order; segments hold `segment_ids` ids or a text more."""
    order = ["doc_id", "hash", "place"]
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"), "text"
    )
    size = documents.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64)).first()[0] or 0
    parts = min(MOST_PARTS, math.ceil(size / part_bytes) or 1)
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def segments(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tokens, part = byte_ids(vocabulary, end_id), TaskContext.get().partitionId()
        end, seq, names, sizes, ids, held = end_id.to_bytes(tokens.width, "little"), 0, [], [], [], 0

        def made():
            return pa.RecordBatch.from_pydict({"value": pa.array([Segment.encode(part, seq, tokens.width, names, sizes, ids)], pa.binary())})

        for batch in slices(batches):
            for docs in runs(batch, RUN_CHARACTERS):
                for (doc_id, _), found in zip(docs, tokens.ids([text for _, text in docs]), strict=True):
                    names.append(doc_id)
                    ids += [found, end]
                    sizes.append(len(found) // tokens.width + 1)
                    held += sizes[-1]
                    if held >= segment_ids:
                        yield made()
                        seq, names, sizes, ids, held = seq + 1, [], [], [], 0
        if names:
            yield made()

    files = dealt.mapInArrow(segments, "value binary")
    files.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_segments(spark, path):
    """One row of DOCUMENTS per document of the files, in no order; `begin` counts ids in its segment."""

    def read(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in DOCUMENTS.split(", ")]
        for batch in batches:
            for data in batch.column(0):
                s = Segment(data.as_buffer())
                bounds = s.boundaries.values().astype(np.int64)
                wide = s.array.astype("<u4")
                crcs = [zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                named = s.names.values().astype(np.int64) + s.least  # wraps as 64-bit numbers do
                ids = pa.concat_arrays([pa.nulls(s.nameless, pa.int64()), pa.array(named, pa.int64())])
                place = [pa.array(np.full(len(s), x, np.int32)) for x in (s.part, s.seq)]
                yield pa.RecordBatch.from_arrays([ids, *place, pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, DOCUMENTS)


def segment_starts(rows):
    """part, seq and base of every segment: the ids of all segments before it."""
    segments = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    parts = segments.groupBy("part").agg(F.sum("n").alias("n"))

    def before(window):
        return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    parts = parts.select("part", before(Window.orderBy("part")).alias("earlier"))
    within = segments.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("base"))
    return within.join(parts, "part").select("part", "seq", (F.col("base") + F.col("earlier")).alias("base"))


def read_corpus(spark, path, broadcast_segments=BROADCAST_SEGMENTS):
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files."""
    rows = stored(read_segments(spark, path), "read")
    starts = stored(segment_starts(rows), "starts")
    few = starts.count() <= broadcast_segments
    joined = rows.join(F.broadcast(starts) if few else starts, ["part", "seq"])
    return joined.select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(documents, vocabulary, end_id=0, segment_ids=SEGMENT_IDS):
    """Write the documents to files in the shared folder and read their boundaries and checksums back."""
    spark = documents.sparkSession
    path = shared_path(spark, "segments")
    write_corpus(documents, vocabulary, path, end_id, segment_ids)
    return read_corpus(spark, path)
