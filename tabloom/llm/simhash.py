"""Near-duplicate groups by SimHash, found with BK-trees.

Fingerprints are linked at `radius` or fewer differing bits. Distinct fingerprints are dealt
to shards that together hold every pair to be linked: of radius + 1 blocks of bits, a
pair agrees on one at least, so a shard is a block and its value. A shard over SHARD_PRINTS
members is split the same way by its free bits, until at most that many are left; the last
splits bound a shard whatever the data. Each shard becomes a BK-tree whose children are
keyed by their integer distance to the parent, and each member follows only edges within
the radius. A tree goes to the one task that holds the members able to match it. A
shard returns one row per linked member, its smallest fellow, never its pairs; the
groups are joined over shards by spreading the smallest label.

A text is bytes with A-Z in lower case. Null, empty and blank texts have fingerprint zero and
are linked like any other. Exact copies meet in one fingerprint before any search.
Rows without doc_id get the smallest doc_id of their group, null if it has none.
"""

from pyspark.sql import functions as F

from tabloom.llm.common import stored, words_of

BITS = 64
#: Most fingerprints in a shard tree.
SHARD_PRINTS = 4096
#: Query-node pairs looked at together.
FRONTIER = 1_000_000


def shingle_hashes(text, width):
    """64-bit hashes of the word shingles of a text, repeats included; a shorter text is one shingle."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return []
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def fingerprint(text, width=3):
    """64-bit SimHash over hashed word shingles, repeats counted; a signed integer."""
    return majority(shingle_hashes(text, width))


def majority(hashes):
    """The bits set in over half of some 64-bit hashes, as a signed integer; zero without any."""
    import numpy as np

    if not len(hashes):
        return 0
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, BITS)
    most = 2 * np.add.reduce(bits, axis=0, dtype=np.int64) > len(hashes)
    return int.from_bytes(np.packbits(most).tobytes(), "big", signed=True)


def fingerprints(documents, width=3):
    """doc_id and fingerprint of every text."""

    def prints(batches):
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(t, width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "print"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(prints, "doc_id long, print long")


class ShardTrees:
    """BK-trees of several shards, built and searched level by level.

    `prints` are unsigned and distinct within a shard; `shard` numbers the shards from 0, in
    order. The first member of a shard is its root.
    """

    def __init__(self, prints, shard):
        import numpy as np

        self.prints, n = prints, len(prints)
        self.root = np.searchsorted(shard, shard).astype(np.int64)
        self.parent, self.edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        waiting = np.flatnonzero(self.root != np.arange(n))
        at = self.root[waiting]
        while len(waiting):  # all at a node: the first of each distance becomes its child, the others go on there
            distance = np.bitwise_count(prints[waiting] ^ prints[at]).astype(np.int64)
            _, first, place = np.unique(at * (BITS + 1) + distance, return_index=True, return_inverse=True)
            child = waiting[first]
            self.parent[child], self.edge[child] = at[first], distance[first]
            left = np.ones(len(waiting), bool)
            left[first] = False
            at, waiting = child[place][left], waiting[left]
        keys = self.parent * (BITS + 1) + self.edge
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def links(self, queries, radius):
        """(query, member) index pairs within the radius, each member after its query left out."""
        import numpy as np

        found, query, node = [], queries, self.root[queries]
        while len(query):
            distance = np.bitwise_count(self.prints[query] ^ self.prints[node]).astype(np.int64)
            near = (distance <= radius) & (node < query)
            found.append((query[near], node[near]))
            low = np.searchsorted(self.keys, node * (BITS + 1) + np.maximum(distance - radius, 1))
            high = np.searchsorted(self.keys, node * (BITS + 1) + np.minimum(distance + radius, BITS), side="right")
            width = high - low
            start = np.repeat(low - np.cumsum(width) + width, width)
            query, node = np.repeat(query, width), self.order[start + np.arange(len(start))]
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def groups(self, radius):
        """Index of the first member of each member's group."""
        import numpy as np

        label = np.arange(len(self.prints))
        sizes = np.bincount(self.root, minlength=len(label))[self.root]
        blocks = np.cumsum(sizes) // FRONTIER
        for queries in np.split(label.copy(), np.flatnonzero(np.diff(blocks)) + 1):
            a, b = self.links(queries, radius)
            while len(a):
                low = np.minimum(label[a], label[b])
                np.minimum.at(label, label[a], low)
                np.minimum.at(label, label[b], low)
                while (jump := label[label]).tolist() != label.tolist():
                    label = jump
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
        return label


def signed(mask):
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def finer(mask, parts):
    """The masks that add one of so many blocks of free bits to a mask."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def shards(prints, radius, shard_prints):
    """print, mask, key, size: members of every shard with two or more, none over the bound."""
    ready, masks, pending = [], [0], prints.select("print", F.lit(0).cast("long").alias("mask"))
    while True:
        children = {m: finer(m, radius + 1) for m in masks}
        table = F.create_map(*[F.lit(x) for m, c in children.items() for x in (signed(m), [signed(y) for y in c])])
        split = pending.select("print", F.explode(table[F.col("mask")]).alias("mask"))
        split = split.withColumn("key", F.col("print").bitwiseAND(F.col("mask")))
        sizes = split.groupBy("mask", "key").agg(F.count("*").alias("size")).filter("size > 1")
        sized = stored(split.join(sizes, ["mask", "key"]).select("print", "mask", "key", "size"), "shards")
        ready.append(sized.filter(F.col("size") <= shard_prints))
        pending = sized.filter(F.col("size") > shard_prints).select("print", "mask")
        masks = sorted({m for c in children.values() for m in c})
        if pending.isEmpty():
            break
    members = ready[0]
    for more in ready[1:]:
        members = members.unionByName(more)
    return members


def shard_links(members, radius):
    """print and the smallest fellow it is linked to in a shard, directly or through others."""
    names = ["print", "fellow"]

    def linked(table):
        import numpy as np
        import pyarrow as pa

        new = (table["mask"][1:] != table["mask"][:-1]) | (table["key"][1:] != table["key"][:-1])
        prints = table["print"]
        label = ShardTrees(prints.view(np.uint64), np.concatenate([[0], np.cumsum(new)])).groups(radius)
        apart = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(prints[apart]), pa.array(prints[label[apart]])], names)

    def search(batches):
        import numpy as np

        held = None
        for batch in batches:
            new = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("print", "mask", "key")}
            held = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in new}
            last = (held["mask"] == held["mask"][-1:]) & (held["key"] == held["key"][-1:])
            whole = int(np.argmax(last)) if len(last) else 0  # the last shard may go on in the next batch
            if whole:
                yield linked({n: v[:whole] for n, v in held.items()})
                held = {n: v[whole:] for n, v in held.items()}
        if held is not None and len(held["print"]):
            yield linked(held)

    dealt = members.repartition("mask", "key").sortWithinPartitions("mask", "key", "print")
    return dealt.select("print", "mask", "key").mapInArrow(search, "print long, fellow long").distinct()


def spread_labels(links):
    """print and the smallest print of its group, for all prints that have a link."""
    ways = stored(links.unionByName(links.select(F.col("fellow").alias("print"), F.col("print").alias("fellow"))).distinct(), "ways")
    labels = stored(ways.groupBy("print").agg(F.least(F.col("print"), F.min("fellow")).alias("label")), "labels")
    while True:
        seen = ways.join(labels.withColumnRenamed("print", "fellow"), "fellow").groupBy("print").agg(F.min("label").alias("seen"))
        lower = labels.join(seen, "print").select("print", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        for _ in range(2):  # go to the label's own label
            far = lower.select(F.col("print").alias("label"), F.col("label").alias("far"))
            lower = lower.join(far, "label").select("print", "was", F.least("label", "far").alias("label"))
        lower = stored(lower, "labels")
        labels = lower.select("print", "label")
        if lower.filter("label < was").isEmpty():
            return labels


def near_groups(documents, radius=2, width=3, shard_prints=SHARD_PRINTS):
    """doc_id, fingerprint (16 hex digits) and component_id, one row per row of documents."""
    every = stored(fingerprints(documents, width), "prints")
    firsts = every.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    labels = spread_labels(shard_links(shards(firsts, radius, shard_prints), radius))
    grouped = firsts.join(labels, "print", "left").withColumn("label", F.coalesce("label", "print"))
    smallest = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"))
    components = grouped.join(smallest, "label").select("print", "component_id")
    return every.join(components, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(documents, radius=2, width=3):
    """The rows whose doc_id is the smallest of its group, each doc_id once, columns unchanged.

    Rows without doc_id stay.
    """
    groups = near_groups(documents, radius, width)
    kept = groups.filter("doc_id = component_id").select("doc_id").distinct()
    first = documents.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return first.unionByName(documents.filter("doc_id IS NULL"))
