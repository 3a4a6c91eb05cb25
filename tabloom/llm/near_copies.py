"""One document of each group of near copies, by exact Jaccard index of word shingles.

Two texts are near copies if their sets of WIDTH-word shingles (as 64-bit hashes) have a Jaccard index of
LEAST or more; a group is what such pairs join. Texts of equal sets are one before any search.
Each set has a SimHash fingerprint, and `simhash` links those RADIUS or fewer bits apart with its sharded BK-trees. Pairs at 0.8 mostly differ in more bits
than trees can prune by, so fingerprints alone would leave them apart: candidates share the group of their fingerprints or one of BANDS
bands of ROWS minimal hashes, of which a pair at 0.8 has none with
probability (1 - 0.8 ** ROWS) ** BANDS, 3 in a million. Both kinds are called bands below. Every candidate that could join two groups is
confirmed on the sets themselves:

* each member of a band is held against one hub of it, so that a large group of copies joins without its pairs;
* in bands of up to SMALL members the pairs still apart follow;
* larger bands still apart, as texts half alike make them, are joined to clusters. Each text is held against its cluster's hub and
  keeps what differs, additions and omissions. Texts x and y are alike if their differences D(x) and D(y) differ in at most
  (|x| + |y|) / 9 places. If one of them is not alike to the hub, both must share differences, so they meet at
  one of their rarest (`prefixes` says how many). Small meetings are confirmed on the differences,
  larger ones are clusters of the next turn, with a hub of their own. After TURNS turns, or one that leaves most texts to the next, all
  meetings are confirmed.

A text under WIDTH words is one shingle. Null, empty and blank texts are copies of each other. The row with the
smallest doc_id stays, rows without one come last; of rows equal in id and text any one stays. Extra columns pass, whatever their names.
"""

from pyspark.sql import functions as F

from tabloom.llm.common import dropped, kept, slices, stored, unused
from tabloom.llm.simhash import SHARD_PRINTS, majority, shard_links, shards, shingle_hashes, spread_labels

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 32, 5
#: Differing bits up to which fingerprints are linked.
RADIUS = 2
#: Members of a band, and texts that meet at a difference, up to which all their pairs are looked at.
SMALL, MEETING = 12, 64
#: Turns of clusters with hubs at most, and the share of texts left to a turn that makes it the last: hubs part them no further.
TURNS, STUCK = 4, 0.8
#: Row numbers, 8 bytes each, that may be sent to all tasks.
BROADCAST_ROWS = 4_000_000
#: Members of a band or cluster beyond which they are dealt to SALTS tasks.
HOT, SALTS = 1_000, 32
#: Shingles hashed together, and texts that a worker holds the sets of.
TOGETHER, TEXTS = 2048, 256


def row_key(documents):
    """128 bits of a row's id and text."""
    doc_id = F.col("doc_id").cast("long")
    return F.struct(F.xxhash64(doc_id, "text").alias("a"), F.xxhash64(F.lit(7), "text", doc_id).alias("b"))


def signatures(documents, width=WIDTH, bands=BANDS, rows=ROWS):
    """doc_id, row key, print (of the whole set), mark (its SimHash), shingles (sorted, as signed numbers) and bands of every text."""
    schema = "doc_id long, a long, b long, print long, mark long, shingles array<long>, bands array<long>"

    def sign(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        rng = np.random.default_rng(11)
        masks, odds, within, of_band = (
            rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (bands * rows, bands * rows, rows, bands)
        )

        def banded(found):
            least = np.full(bands * rows, np.uint64(2**64 - 1))
            for k in range(0, len(found), TOGETHER):
                mixed = (found[None, k : k + TOGETHER] ^ masks[:, None]) * odds[:, None]
                np.minimum(least, mixed.min(1), out=least)
            return ((least.reshape(bands, rows) ^ (least.reshape(bands, rows) >> np.uint64(29))) * within).sum(1, dtype=np.uint64) * of_band + of_band

        kept("near_copies")
        for batch in slices(batches, TEXTS):
            prints, marks, sets, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = np.unique(np.array(shingle_hashes(text, width), np.uint64))
                prints.append(xxh64_intdigest(found.tobytes(), 5))
                marks.append(majority(found))
                sets.append(found)
                keys.append(banded(found) if len(found) else found)
            lists = [
                pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64))
                )
                for x in (sets, keys)
            ]
            prints = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "a", "b")), prints, pa.array(marks, pa.int64()), *lists], [x.split()[0] for x in schema.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(documents).alias("key"), "text").select(
        "doc_id", "key.*", "text"
    ).mapInArrow(sign, schema)


def alike(distance, sizes, least):
    """Whether sets of these sizes together, different in so many places, are alike enough."""
    return distance <= (1 - least) / (1 + least) * sizes + 1e-6


def confirmed(pairs, sets, least):
    """print and fellow of the pairs whose sets are alike enough."""
    both = pairs.join(sets, "print").join(sets.select(F.col("print").alias("fellow"), F.col("shingles").alias("others")), "fellow")
    sizes = F.size("shingles") + F.size("others")
    return both.filter(alike(sizes - 2 * F.size(F.array_intersect("shingles", "others")), sizes, least)).select("print", "fellow")


def labelled(members, links):
    """Members with the label of the group that the links make."""
    return members.drop("label").join(spread_labels(links), "print", "left").withColumn("label", F.coalesce("label", "print"))


def salt(n):
    return F.when(n > HOT, F.pmod("print", F.lit(SALTS))).otherwise(F.lit(0)).cast("int")


def salted(single):
    """A row per band or cluster, repeated for every salt of a hot one."""
    return single.withColumn("salt", F.explode(F.when(F.col("n") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("n")


def sized(least):
    return F.least("size", "fellow_size") >= least * F.greatest("size", "fellow_size") - 1e-6


def hub_pairs(members, least):
    """print and fellow: every member of a band with its hub, the one first by hash."""
    first = F.min(F.struct(F.xxhash64("print").alias("order"), F.col("print").alias("fellow"), F.col("size").alias("fellow_size")))
    hubs = members.groupBy("band", "n").agg(first.alias("hub")).select("band", "n", "hub.fellow", "hub.fellow_size")
    both = members.join(salted(hubs), ["band", "salt"]).filter(F.col("print") != F.col("fellow"))
    return both.filter(sized(least)).select("print", "fellow").distinct()


def apart(members):
    """The members of bands that still hold more than one group."""
    bands = members.groupBy("band", "n").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return members.join(salted(bands.select("band", "n")), ["band", "salt"], "left_semi")


def small_pairs(members, least):
    """print and fellow: the pairs of different groups in small bands."""
    few = members.filter(F.col("n") <= SMALL)
    names = {"print": "fellow", "label": "other", "size": "fellow_size"}
    both = few.join(few.select("band", *[F.col(a).alias(b) for a, b in names.items()]), "band")
    both = both.filter((F.col("print") > F.col("fellow")) & (F.col("label") != F.col("other")) & sized(least))
    return both.select("print", "fellow").distinct()


def clusters_of(keys, sets):
    """print, cluster, n (its size) and hub (see `central`): texts with a key in common, directly or through others."""
    firsts = keys.groupBy("key").agg(F.min("print").alias("fellow"))
    both = stored(keys.join(firsts, "key").select("print", "fellow").distinct(), "firsts")
    least = both.groupBy("print").agg(F.min("fellow").alias("least"))
    # a text and the least first of its keys, and that one with the other firsts: most texts of a cluster share the latter
    star = both.join(least, "print").select(F.explode(F.array(F.struct("print", "least"), F.struct(F.col("fellow").alias("print"), "least"))).alias("e"))
    star = stored(star.select("e.print", F.col("e.least").alias("fellow")).filter("print != fellow").distinct(), "star")
    labels = spread_labels(star).withColumnRenamed("label", "cluster")
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    rows = stored(labels.join(sizes, "cluster").select("print", "cluster", "n", salt(F.col("n")).alias("salt")), "clusters")
    return rows.join(central(rows, sets), "cluster").select("print", "cluster", "n", "hub", "salt")


def central(clusters, sets):
    """cluster and hub: the text nearest to the shingles that over half of the cluster's texts have.

    Edits of the hub's own are differences that all other texts share, so they would all meet there.
    """
    each = clusters.join(sets, "print")
    tokens = each.select("cluster", "n", F.explode("shingles").alias("token")).groupBy("cluster", "n", "token").agg(F.count("*").alias("times"))
    cores = tokens.filter("2 * times > n").groupBy("cluster", "n").agg(F.collect_list("token").alias("core"))
    both = each.join(salted(cores), ["cluster", "salt"], "left").withColumn("core", F.coalesce("core", F.array().cast("array<long>")))
    distance = F.size("shingles") - 2 * F.size(F.array_intersect("shingles", "core"))
    rows = both.select("cluster", F.struct(distance.alias("distance"), F.xxhash64("print").alias("order"), "print").alias("near"))
    return rows.groupBy("cluster").agg(F.min("near").alias("near")).select("cluster", F.col("near.print").alias("hub"))


def differences(clusters, sets, least):
    """print, cluster, hub, n, salt, size, hub_size, delta (what differs from the hub) and linked (alike to it)."""
    hubs = clusters.select("cluster", "n", F.col("hub").alias("print")).distinct().join(sets, "print")
    hubs = salted(hubs.select("cluster", "n", F.col("shingles").alias("others")))
    both = clusters.join(sets, "print").join(hubs, ["cluster", "salt"])
    delta = F.concat(F.array_except("shingles", "others"), F.array_except("others", "shingles"))
    rows = both.select(*clusters.columns, F.size("shingles").alias("size"), F.size("others").alias("hub_size"), delta.alias("delta"))
    return rows.withColumn("linked", alike(F.size("delta"), F.col("size") + F.col("hub_size"), least))


def prefixes(rows, least):
    """The rarest differences of each text in its cluster, where alike texts of different groups must meet.

    Texts x and y share at least (|D(x)| + |D(y)| - (|x| + |y|) / 9) / 2 differences if they are alike. For x and any y that is not
    alike to the hub h this is over t = (|D(x)| + (|h| - |x|) / 9) / 2, so one of them is among the first |D(x)| - t + 1 of D(x) in any
    fixed order (`asks`). For such a y and any x it is over (|D(y)| - (|h| + |y|) / 9) / 2 (`answers`). Differences of one text
    alone come first in the order and meet nothing, so only their number is used. `place` is the place in the order.
    """
    ratio, d = (1 - least) / (1 + least), F.size("delta")
    asks = d - F.greatest(F.lit(1), F.ceil((d + ratio * (F.col("hub_size") - F.col("size"))) / 2 - 1e-6)) + 1
    answers = d - F.greatest(F.lit(1), F.ceil((d - ratio * (F.col("hub_size") + F.col("size"))) / 2 - 1e-6)) + 1
    bounds = rows.select(
        "print", "cluster", "label", "size", d.alias("d"), asks.alias("asks"), F.when(~F.col("linked"), answers).otherwise(0).alias("answers")
    )
    each = rows.select("print", "cluster", F.explode("delta").alias("token"))
    counts = each.groupBy("cluster", "token").agg(F.count("*").alias("times")).filter("times > 1")
    met = each.join(counts, ["cluster", "token"]).groupBy("print").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("met"))
    first = F.col("d") - F.size("met")
    places = bounds.join(met, "print").withColumn("first", first).filter(F.greatest("asks", "answers") > F.col("first"))
    kept = F.slice("met", F.lit(1), (F.greatest("asks", "answers") - F.col("first")).cast("int"))
    each = places.select("*", F.posexplode(kept).alias("at", "difference")).withColumn("place", F.col("first") + F.col("at"))
    return each.select(
        F.xxhash64("cluster", "difference.token").alias("key"), "print", "label", "size", "d", "place",
        (F.col("place") < F.col("asks")).alias("asks"), (F.col("place") < F.col("answers")).alias("answers"),
    )


def meeting_pairs(meetings, least):
    """print and fellow that meet, if sizes and the differences left from there on allow `least`."""
    names = {"print": "fellow", "label": "other", "size": "fellow_size", "d": "fellow_d", "place": "fellow_place"}
    other = meetings.filter("answers").select("key", *[F.col(a).alias(b) for a, b in names.items()])
    both = meetings.filter("asks").join(other, "key").filter((F.col("label") != F.col("other")) & sized(least))
    shared = (F.col("d") + F.col("fellow_d") - (1 - least) / (1 + least) * (F.col("size") + F.col("fellow_size"))) / 2 - 1e-6
    both = both.filter(F.least(F.col("d") - F.col("place"), F.col("fellow_d") - F.col("fellow_place")) >= shared)
    return both.select(F.greatest("print", "fellow").alias("print"), F.least("print", "fellow").alias("fellow")).distinct()


def difference_links(keys, sets, links, least, turns=TURNS):
    """Links between texts with a key in common, by their differences from hubs; `links` are those known."""
    for turn in range(turns):
        clusters = stored(clusters_of(keys, sets), "clusters")
        rows = stored(differences(clusters, sets, least), "differences")
        links = links.unionByName(rows.filter("linked AND print != hub").select("print", F.col("hub").alias("fellow")))
        rows = stored(labelled(rows, links), "differences")
        split = rows.groupBy("cluster", "n").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        meetings = stored(prefixes(rows.join(salted(split.select("cluster", "n")), ["cluster", "salt"], "left_semi"), least), "meetings")
        sizes = meetings.groupBy("key").agg(
            F.count("*").alias("times"), F.min("label").alias("low"), F.max("label").alias("high"), F.bool_or("asks").alias("asked"),
            F.bool_or("answers").alias("answered"),
        ).filter("low < high AND asked AND answered")
        meetings = stored(meetings.join(sizes.select("key", "times"), "key"), "meetings")
        large = F.col("times") > MEETING if turn + 1 < turns else F.lit(False)
        left = meetings.filter(large).select("print").distinct().count()
        if left > STUCK * clusters.count():
            large, left = F.lit(False), 0
        pairs = meeting_pairs(meetings.filter(~large), least)
        sides = rows.select("print", "delta", "size")
        both = pairs.join(sides, "print").join(sides.select(F.col("print").alias("fellow"), F.col("delta").alias("deltas"), F.col("size").alias("others")), "fellow")
        distance = F.size("delta") + F.size("deltas") - 2 * F.size(F.array_intersect("delta", "deltas"))
        found = stored(both.filter(alike(distance, F.col("size") + F.col("others"), least)).select("print", "fellow"), "links")
        links = links.unionByName(found)
        keys = meetings.filter(large).select("key", "print")
        if not left:
            return links


def marked_bands(signed, radius=RADIUS, shard_prints=SHARD_PRINTS):
    """print, size and band of every text whose fingerprint is linked to another's or equal to it: the group of fingerprints is the band."""
    sets = signed.select("print", "mark", F.size("shingles").alias("size")).distinct()
    marks = stored(sets.groupBy(F.col("mark").alias("print")).agg(F.count("*").alias("sets")), "marks")
    labels = spread_labels(shard_links(shards(marks, radius, shard_prints), radius))
    groups = marks.join(labels, "print", "left").filter("label IS NOT NULL OR sets > 1")
    groups = groups.select(F.col("print").alias("mark"), F.xxhash64(F.coalesce("label", "print"), F.lit("mark")).alias("band"))
    return sets.join(groups, "mark").select("print", "size", "band")


def copy_links(signed, firsts, least=LEAST, turns=TURNS):
    """print and fellow: confirmed links that join every group of near copies."""
    banded = signed.select("print", F.size("shingles").alias("size"), F.explode("bands").alias("band")).distinct()
    banded = banded.unionByName(marked_bands(signed))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(banded.join(shared, "band").withColumn("salt", salt(F.col("n"))), "members")
    used = stored(firsts.join(members.select("print").distinct(), "print", "left_semi").select("row"), "used")
    used = F.broadcast(used) if used.count() <= BROADCAST_ROWS else used
    sets = stored(signed.join(used, "row", "left_semi").select("print", "shingles"), "sets")
    dropped(signed.sparkSession, signed)
    links = stored(confirmed(hub_pairs(members, least), sets, least), "links")
    rest = stored(apart(labelled(members, links)), "members")
    dropped(signed.sparkSession, members)
    links = links.unionByName(stored(confirmed(small_pairs(rest, least), sets, least), "links"))
    keys = rest.filter(F.col("n") > SMALL).select(F.col("band").alias("key"), "print")
    return links if keys.isEmpty() else difference_links(keys, sets, links, least, turns)


def one_of_each(documents, least=LEAST, width=WIDTH, bands=BANDS, rows=ROWS, turns=TURNS):
    """One row of each group of near copies, columns unchanged."""
    signed = stored(signatures(documents, width, bands, rows).withColumn("row", F.monotonically_increasing_id()), "signed")
    keep = F.struct(F.col("doc_id").isNull(), "doc_id", "a", "b")
    firsts = stored(signed.groupBy("print").agg(F.min("row").alias("row"), F.min(keep).alias("keep")), "firsts")
    groups = labelled(firsts, copy_links(signed, firsts, least, turns))
    key = unused(documents, "key")
    kept = groups.groupBy("label").agg(F.min("keep").alias("keep")).select(F.struct("keep.a", "keep.b").alias(key))
    chosen = documents.withColumn(key, row_key(documents)).join(kept, key, "left_semi")
    return chosen.dropDuplicates([key]).drop(key)
