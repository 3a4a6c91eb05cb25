"""The near_dedup stage against brute force over five-word shingles."""

import random

import pytest

import corpus_pipeline
from tabloom.llm import near_copies, simhash

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def groups_of(texts, candidates=None):
    """The label of each text's group, by all pairs or those given."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))

    def top(a):
        while label[a] != a:
            label[a] = a = label[label[a]]
        return a

    for a, b in candidates or ((a, b) for a in range(len(texts)) for b in range(a)):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            label[max(top(a), top(b))] = min(top(a), top(b))
    return [top(a) for a in range(len(texts))]


def least_ids(rows, labels):
    """The smallest id of each group, those without one last."""
    best = {}
    for (doc_id, *_), group in zip(rows, labels):
        best[group] = min(best.get(group, (True, 0)), (doc_id is None, doc_id or 0))
    return sorted(best.values())


def edited(rng, words, edits):
    copy = list(words)
    for at in rng.sample(range(len(copy)), edits):
        copy[at] = f"x{rng.randint(0, 10**6)}"
    return " ".join(copy)


def made():
    rng = random.Random(4)
    rows, k = [(900, ""), (901, None), (902, "  "), (903, "short text"), (904, "Short  TEXT"), (905, "short text here")], 0
    for _ in range(12):
        words = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(60, 200))]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6):
            rows.append((k, edited(rng, words, edits)))
            k += 1
    rows += [(None, rows[10][1]), (None, "no id but alone"), (None, "no id but alone"), (8, "same id, other text")]
    return rows


def half_alike(seed):
    """Texts of one origin, most of them less than 0.8 alike to each other: own edits, shared edits, and cuts."""
    rng = random.Random(seed)
    words = [f"w{rng.randint(0, 900)}" for _ in range(300)]
    texts = [edited(rng, words, rng.choice([2, 4, 6, 7, 8, 9, 11, 14])) for _ in range(60)]
    for _ in range(4):  # versions with copies of their own
        other = edited(rng, words, 14).split()
        texts += [edited(rng, other, rng.choice([0, 2, 5, 7, 9])) for _ in range(12)]
    texts += [" ".join(words[: 300 - 9 * k]) for k in range(20)] + [" ".join(words[11 * k :]) for k in range(15)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def kept(spark, rows, schema="doc_id long, text string"):
    documents = spark.createDataFrame(rows, schema).repartition(3)
    got = corpus_pipeline.near_dedup(spark, documents, None)
    assert got.columns == documents.columns
    return got


def test_near_dedup_keeps_one_of_each_group_of_alike_texts(spark):
    rows = made()
    texts = [t for _, t in rows]
    labels = groups_of(texts)
    # some near copies differ in more than the two bits that op2 allows
    prints = [simhash.fingerprint(t) for t in texts]
    assert any(labels[a] == labels[b] and (prints[a] ^ prints[b]).bit_count() > 2 for a in range(len(rows)) for b in range(a))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept(spark, rows).collect()) == least_ids(rows, labels)


@pytest.mark.parametrize("seed,small,turns", [(1, 2, 3), (3, 12, 1)])
def test_half_alike_texts_meet_at_their_differences(spark, monkeypatch, seed, small, turns):
    rows = half_alike(seed)
    labels = groups_of([t for _, t in rows])
    assert 15 < len(set(labels)) < len(rows) - 40
    for name, value in (("SMALL", small), ("MEETING", small), ("STUCK", 2.0 if turns > 1 else 0.8)):
        monkeypatch.setattr(near_copies, name, value)
    monkeypatch.setattr(near_copies, "HOT", 20)
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_copies.one_of_each(documents, turns=turns).collect()
    assert sorted((False, r.doc_id) for r in got) == least_ids(rows, labels)


def test_the_hub_is_the_text_nearest_to_what_most_share(spark):
    sets = {k: list(range(100 - 5 * k)) + [1000 * k + j for j in range(5 * k)] for k in range(1, 8)}  # 1 differs least from the others
    table = spark.createDataFrame(list(sets.items()), "print long, shingles array<long>")
    keys = [(9, k) for k in sets] + [(key, k) for key in (10, 11, 12) for k in (6, 7)]  # 6 and 7 have the most keys
    found = near_copies.clusters_of(spark.createDataFrame(keys, "key long, print long"), table).collect()
    assert sorted((r.print, r.n, r.hub) for r in found) == [(k, 7, 1) for k in sets]


def test_fingerprints_link_near_copies_that_share_no_band(spark):
    rng = random.Random(5)
    rows, k = [], 0
    for _ in range(6):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(3000)]
        for edits in (0, 1, 1):
            rows.append((k, edited(rng, words, edits)))
            k += 1
    rows += [(100, "one line alone"), (101, "")]
    sets = [shingles(t) for _, t in rows]
    marks = [simhash.majority(sorted(set(simhash.shingle_hashes(t, 5)))) for _, t in rows]
    near = {(a, b) for a in range(len(rows)) for b in range(a) if (marks[a] ^ marks[b]).bit_count() <= near_copies.RADIUS}
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in near) and len(near) >= 6
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_copies.one_of_each(documents, bands=1, rows=4000).collect()  # such a band is shared by equal sets alone
    assert sorted((False, r.doc_id) for r in got) == least_ids(rows, groups_of([t for _, t in rows], near))


def test_the_whole_table_as_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    met = {}
    for at, (_, text) in enumerate(rows):
        for s in shingles(text):
            met.setdefault(s, []).append(at)
    candidates = {(a, b) for ats in met.values() for a in ats for b in ats if b < a}
    want = least_ids(rows, groups_of([t for _, t in rows], candidates))
    assert sorted((False, r.doc_id) for r in corpus_pipeline.near_dedup(spark, documents, SF).collect()) == want


def test_empty_tables_long_texts_and_clashing_names(spark):
    schema = "doc_id long, text string, key string, Key_ string, label int, print int, a string"
    assert kept(spark, [], schema).collect() == []
    long = "many words " * 20000
    rows = [(3, long, "k", "K", 1, 2, "a"), (1, long, "k", "K", 1, 2, "a"), (1, long, "k", "K", 1, 2, "a"), (7, "other", None, None, None, None, None)]
    assert sorted(tuple(r) for r in kept(spark, rows, schema).collect()) == sorted([rows[1], rows[3]], key=lambda r: r[0])
