"""Document fingerprints by spot signatures.

A signature is a common word (the anchor) with the next two content words after it. A fingerprint
is the whole set of a text's signatures, as sorted 24-bit hashes in base 64. Likeness is the Jaccard
index of two sets; `likeness` can stop at once when the lengths rule out the least that
counts, and `length_band` deals sets so that likes lie in the same or the next band.

A text without a common word takes every word as anchor; one without words is hashed whole. Null
and empty texts have the empty fingerprint, which is like itself (1) and nothing else (0). Repeated
doc_ids follow each other in the order of their texts; null ones come last.
"""

import base64
import math

from pyspark.sql import functions as F

# Common words of four languages.
ANCHORS = frozenset(
    """
    a an and are as at be been but by for from had has have he her his i in is it its not of on or she
    that the their they this to was we were which will with you
    al con de del el en es la las lo los no para pero por que se su sus un una y
    au aux ce dans des du elle est et il ils je le les mais ne nous ou par pas pour qui sur une vous
    aber als auch auf aus bei das dem den der die ein eine einer er für ich im ist mit nach nicht
    sich sie sind und von war wie wir zu zum zur
    """.encode().split()
)
CHAIN = 2
BLOCK_DOCUMENTS, MAX_BLOCKS = 4000, 10_000
TO_WORDS = bytes(b | 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def signatures(text, anchors=ANCHORS, chain=CHAIN):
    """The set of 24-bit signature hashes of a text."""
    from xxhash import xxh32_intdigest

    if not text:
        return set()
    words = text.encode().translate(TO_WORDS).split()
    if not words:
        return {xxh32_intdigest(text.encode()) >> 8}
    content, found, at = [w for w in words if w not in anchors], set(), 0
    for word in words:
        if word not in anchors:
            at += 1
        elif at < len(content):
            found.add(xxh32_intdigest(b" ".join((word, *content[at : at + chain]))) >> 8)
    if not found:
        found = {xxh32_intdigest(b" ".join(words[k : k + 1 + chain])) >> 8 for k in range(max(1, len(words) - chain))}
    return found


def written(found):
    """A signature set as text; equal sets give equal texts."""
    return base64.b64encode(b"".join([x.to_bytes(3, "big") for x in sorted(found)])).decode()


def read(fingerprint):
    data = base64.b64decode(fingerprint)
    return {int.from_bytes(data[k : k + 3], "big") for k in range(0, len(data), 3)}


def likeness(a, b, least=0.0):
    """Jaccard index of two signature sets; 0 without looking if lengths keep it below `least`."""
    if not a or not b:
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def length_band(size, least=0.8):
    """Band of a set's length: two sets that can be so alike differ by one band at most."""
    return math.floor(math.log(size) / -math.log(least) + 1e-9) if size else -1


def with_next(documents):
    """doc_id, text, dest, guest, place: each block of doc_ids in a row, and the row after it as guest.

    Blocks are cut at approximate quantiles of doc_id. The head of each block also goes to the
    block before it, the head of the first to the last. Texts move once.
    """
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", place.alias("place"))
    ids = rows.select("place")
    blocks = max(1, min(MAX_BLOCKS, math.ceil(ids.count() / BLOCK_DOCUMENTS)))
    cuts = ids.agg(F.percentile_approx("place", [k / blocks for k in range(1, blocks)] or [0.5], 100 * blocks)).first()[0]
    cuts = sorted(set(cuts or []))[: blocks - 1]

    def block_of(low, high):
        """A search tree of conditions: the number of cuts below or at the place."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("place") < cuts[middle], block_of(low, middle)).otherwise(block_of(middle + 1, high))

    rows = rows.withColumn("block", block_of(0, len(cuts)))
    heads = sorted((r["place"], r["block"]) for r in rows.groupBy("block").agg(F.min("place").alias("place")).collect())
    before = [(p, heads[k - 1][1]) for k, (p, _) in enumerate(heads)]  # the first head goes to the last block
    small = documents.sparkSession.createDataFrame(before, "place long, before int")
    own, guest = (F.struct(F.col(c).cast("int").alias("dest"), F.lit(g).alias("guest")) for c, g in (("block", False), ("before", True)))
    sent = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, guest))
    dealt = rows.join(F.broadcast(small), "place", "left").select("doc_id", "text", "place", F.explode(sent).alias("to"))
    dealt = dealt.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "place", "to.dest", "to.guest")
    return dealt.repartition("dest").sortWithinPartitions("dest", "guest", "place", "text")


def fingerprints(documents, anchors=ANCHORS, chain=CHAIN):
    """doc_id and fingerprint of every document, for comparison elsewhere."""

    def prints(batches):
        import pyarrow as pa

        for batch in batches:
            found = [written(signatures(t, anchors, chain)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(prints, "doc_id long, fingerprint string")


def edited_report(documents, anchors=ANCHORS, chain=CHAIN):
    """Fingerprints of every text and of its edit, whose second half is the start of the next text."""
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def compare(batches):
        import hashlib

        import pyarrow as pa

        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = None  # dest, doc_id, text and signatures of the row before
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text", "dest", "guest")]
            for doc_id, text, dest, guest in zip(*columns, strict=True):
                found = signatures(text, anchors, chain)
                if held is not None and held[0] == dest:
                    _, last_id, last, had = held
                    half = len(last) // 2
                    edited = last[: len(last) - half] + text[:half]
                    new = signatures(edited, anchors, chain)
                    rows.append((
                        last_id, len(last), hashlib.sha256(edited.encode()).hexdigest(), written(had), written(new),
                        likeness(had, new), likeness(had, found),
                    ))
                held = None if guest else (dest, doc_id, text, found)
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return with_next(documents).select("doc_id", "text", "dest", "guest").mapInArrow(compare, schema)
