"""Runs of periodic words by multi-scale minimizers.

A run is a stretch of words with smallest period q, at least max(LEAST_LENGTH, 2 * q) words long,
that no neighbouring word extends. A task numbers the words of some documents, longest first,
puts a number of its own after each, and works on the whole array at once:

* Periods below SHORT: every lag q is scanned directly for stretches where words q apart agree.
* Periods q in [2k, 4k), one scale per k = 16, 32, ...: hashes of k words come from doubling those of k/2.
  Inside a run the minimum of k neighbouring hashes repeats at distance q, so equal minimizers 2k to 4k
  apart seed an extension on the words themselves.
* A k-gram with a period of at most k/2 would repeat too often to be a seed. It lies in a run that an earlier
  scale has found, so such k-grams rank last and are no seeds. A run all of whose k-grams are of that sort is
  made of two neighbouring runs of one period p; their phases leave only every p-th q, and each that fits is
  a run.

So seeds are few and every run is found, whatever the hashes. Null, empty and blank texts have no words and no runs. A
very long text stays in one task, in arrays of a few numbers a word. Rows with equal ids, or null ones, are judged each
on its own. Other columns are not read.
"""

import hashlib
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import functions as F

from tabloom.llm.packing import runs as batches_of

LEAST_LENGTH = 12
#: Periods found by direct scans; the first scale begins here, with k = SHORT / 2.
SHORT = 32
#: Characters of documents worked on together.
TOGETHER = 1_500_000
MIX = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def stretches(found, need):
    """(first, last) of stretches of at least `need` consecutive numbers in a rising array."""
    if len(found) < need:
        return np.zeros((0, 2), np.int64)
    cuts = np.flatnonzero(np.diff(found) != 1)
    first, last = found[np.concatenate([[0], cuts + 1])], found[np.concatenate([cuts, [len(found) - 1]])]
    long = last - first + 1 >= need
    return np.stack([first[long], last[long]], 1)


def primitive(words, start, end, period):
    """True if no divisor of the period is a period of words[start:end]."""
    rest, factor, factors = period, 2, []
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            factors.append(factor)
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return not any(np.array_equal(words[start : end - period // f], words[start + period // f : end]) for f in factors)


def agreeing(words, a, b, step):
    """How many words agree from a and b on, towards the end (step 1) or the start (step -1)."""
    room = len(words) - b if step > 0 else a + 1
    done, block = 0, 64
    while done < room:
        n = min(block, room - done)
        if step > 0:
            differ = words[a + done : a + done + n] != words[b + done : b + done + n]
        else:
            differ = words[a - done - n + 1 : a - done + 1][::-1] != words[b - done - n + 1 : b - done + 1][::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, block = done + n, 4 * block
    return done


def sliding(values, width, pick):
    """Minimum or maximum (`pick`) of each `width` neighbours, a power of two."""
    span = 1
    while span < width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return values


def minimizers(keys, width):
    """Places that hold the minimum of some window of `width` keys, ties included."""
    if len(keys) < width:
        return np.zeros(0, np.int64)
    least = sliding(keys, width, np.minimum)
    edge = np.zeros(width - 1, keys.dtype)
    return np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum) == keys)


def equal_pairs(places, keys, low, high):
    """(place, distance) of equal keys at a distance in [low, high)."""
    order = np.lexsort((places, keys))
    places, keys = places[order], keys[order]
    pairs, ahead = [], 1
    while ahead < len(places):
        distance = places[ahead:] - places[:-ahead]
        near = (keys[ahead:] == keys[:-ahead]) & (distance < high)
        if not near.any():
            break
        fit = np.flatnonzero(near & (distance >= low))
        pairs.append(np.stack([places[fit], distance[fit]], 1))
        ahead += 1
    return np.concatenate([np.zeros((0, 2), np.int64), *pairs])


def neighbour_pairs(words, found, known):
    """(place, period) of runs made of two neighbouring runs of a shorter period.

    `found` has the (start, end, period) of runs, sorted by period and start; `known` those paired before.
    """
    pairs = []
    for (s, e, p), (t, f, q) in zip(found, found[1:]):
        if p != q or t > e or (s, t, p) in known:
            continue
        known.add((s, t, p))
        unit = words[s : s + p]
        phase = next((o for o in range(p) if words[t + o] == unit[0] and np.array_equal(words[t + o : t + o + p], unit)), None)
        if phase is None:
            continue
        shift = t + phase - s
        for period in range(shift % p or p, min(e - s, f - t) + 1, p):
            first, last = max(s, t - period), min(e, f - period)
            if period >= SHORT and last - first >= period:
                pairs.append((first, period))
    return pairs


def extended(words, seeds, least=LEAST_LENGTH):
    """Runs (start, end, period) around seeds, which come as sorted (period, place)."""
    made, period, end = [], 0, 0
    for q, place in seeds:
        if q == period and place < end:  # in the stretch just looked at
            continue
        start = place - agreeing(words, place - 1, place + q - 1, -1)
        period, end = q, place + agreeing(words, place, place + q, 1)
        if end - start >= q and end + q - start >= least and primitive(words, start, end + q, q):
            made.append((start, end + q, q))
    return made


def all_runs(words, sizes, least=LEAST_LENGTH):
    """(start, end, period) of all runs of an array of documents.

    `sizes` has the places that each document takes, longest first; its last place holds a number that occurs once,
    so that no run crosses it.
    """
    found = set()
    for q in range(1, min(SHORT, len(words))):
        need = max(least - q, q)
        for first, last in stretches(np.flatnonzero(words[q:] == words[:-q]), need):
            if primitive(words, first, last + 1 + q, q):
                found.add((int(first), int(last) + 1 + q, q))
    ends, gram, known = np.cumsum(sizes), None, set()
    joint, k = set(), SHORT // 2
    while (long := int(np.searchsorted(-np.asarray(sizes), -4 * k, side="left"))) > 0:  # documents of two periods or more
        part = words[: ends[long - 1]]
        if gram is None:
            gram, have = part.astype(np.uint64) * MIX, 1
        while have < k:  # hashes of twice as many words
            gram = gram[: len(part) - have + 1]
            left, right = gram[:-have], gram[have:]
            gram = (left ^ (left >> np.uint64(31))) * MIX + (right ^ (right >> np.uint64(27)))
            gram *= np.uint64(0xBF58476D1CE4E5B9)
            have *= 2
        gram = gram[: len(part) - k + 1]
        ordered = sorted(found, key=lambda r: (r[2], r[0]))
        short = [r for r in ordered if r[2] <= k // 2]
        joint.update(neighbour_pairs(words, short, known))
        periodic = np.zeros(len(gram) + 1, np.int64)
        for s, e, _ in short:
            if e - s >= k and s < len(gram):
                periodic[s] += 1
                periodic[min(e - k + 1, len(gram))] -= 1
        periodic = np.cumsum(periodic[:-1]) > 0
        keys = (gram >> np.uint64(1)) | (periodic.astype(np.uint64) << np.uint64(63))
        places = minimizers(keys, k)
        places = places[~periodic[places]]
        seeds = equal_pairs(places, gram[places], 2 * k, 4 * k)
        if len(seeds):  # a run agrees on k/2 words more, on one side at least
            seeds = seeds[beside(words, seeds, k // 2, k)]
        now = {(q, p) for p, q in seeds.tolist()} | {(q, p) for p, q in joint if 2 * k <= q < 4 * k}
        found.update(extended(words, sorted(now), least))
        k *= 2
    return found


def beside(words, seeds, more, k):
    """True for seeds whose words agree right before or after the k-gram too; a first look at the nearest ones."""
    place, period = seeds[:, 0], seeds[:, 1]
    ok_left, ok_right = place >= more, place + period + k + more <= len(words)
    left, right = ok_left.copy(), ok_right.copy()
    for step in (1, more):
        at = np.maximum(place - step, 0)
        left &= words[at] == words[at + period]
        at = np.minimum(place + k - 1 + step, len(words) - 1 - period)
        right &= words[at] == words[at + period]
    return (left & ok_left) | (right & ok_right)


def planted(words, doc_id):
    """The words with every tenth document made periodic from some place on, by the checksum of its id, if any."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def collapsed(words, runs):
    """The words that no run holds after its first period."""
    keep = bytearray(b"\1") * len(words)
    for start, end, period in runs:
        keep[start + period : end] = bytes(end - start - period)
    return [w for w, k in zip(words, keep) if k]


def document_runs(texts, least=LEAST_LENGTH):
    """Runs (start, end, period) of each list of words, sorted by start and period."""
    number = defaultdict(count().__next__)
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    parts, sizes = [], []
    for k in order:
        parts.append(np.fromiter(map(number.__getitem__, texts[k]), np.int32, len(texts[k])))
        parts.append(np.array([-1 - k], np.int32))
        sizes.append(len(texts[k]) + 1)
    made = [[] for _ in texts]
    if texts:
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for s, e, q in all_runs(np.concatenate(parts), sizes, least):
            at = int(np.searchsorted(starts, s, side="right")) - 1
            made[order[at]].append((s - int(starts[at]), e - int(starts[at]), q))
    return [sorted(m, key=lambda r: (r[0], r[2])) for m in made]


def row_of(doc_id, words, runs):
    """One row of SCHEMA."""
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    start = length = period = milli = None
    if runs:
        s, e, period = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]))
        start, length, milli = s, e - s, 1000 * (e - s) // period
    kept = b" ".join(collapsed(words, runs) if runs else words)
    return doc_id, len(runs), start, length, period, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def find_runs(documents, least=LEAST_LENGTH, prepare=None):
    """One row of SCHEMA per document; `prepare` may change a document's words, given them and its id."""

    def judge(batches):
        import pyarrow as pa

        types = [pa.string() if x.endswith("string") else pa.int64() for x in SCHEMA.split(", ")]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for docs in batches_of(batch, TOGETHER):
                words = [t.encode().split() if t else [] for _, t in docs]
                if prepare:
                    words = [prepare(w, i) for (i, _), w in zip(docs, words)]
                rows = [row_of(i, w, r) for (i, _), w, r in zip(docs, words, document_runs(words, least))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, SCHEMA)
