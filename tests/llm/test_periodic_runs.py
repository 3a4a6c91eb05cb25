"""Runs of periodic words against brute force over all lags."""

import hashlib
import random
import re
import zlib

import pytest

from tabloom.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def brute(words):
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(12, 2 * q) and not any(q % d == 0 and all(words[x] == words[x + d] for x in range(s, e - d)) for d in range(1, q)):
                found.append((s, e, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def odd_words(rng):
    letters, kind = rng.choice([1, 2, 3, 5, 50, 5000]), rng.randint(0, 6)
    some = [rng.randrange(letters) for _ in range(rng.choice([0, 1, 5, 30, 80, 200, 400]))]
    if not kind:
        return some
    out = []
    for _ in range(rng.randint(1, 4)):
        unit = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 7, 20, 33, 60, 90]))]
        if kind >= 3:  # a unit that is itself nearly periodic
            unit = unit[:3] * rng.randint(1, 40) + unit[: rng.randint(0, 3)] + [rng.randrange(letters)] * (kind > 4)
        out += unit * rng.randint(1, 5) + unit[: rng.randint(0, len(unit))]
        out += some[: rng.randint(0, 50)] if rng.random() < 0.4 else []
    return out[:700]


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_of_odd_words(seed):
    rng = random.Random(seed)
    for _ in range(12):
        docs = [odd_words(rng) for _ in range(12)]
        assert periodic_runs.document_runs(docs) == [brute(d) for d in docs]


def test_squares_over_the_seam_of_two_periodic_stretches():
    # both stretches have period 3; every 3 t + 1 is the period of a run over their seam
    words = list("aab" * 60 + "a" + "aab" * 60)
    assert len(brute(words)) > 15
    assert periodic_runs.document_runs([words, words[7:]]) == [brute(words), brute(words[7:])]


def test_fibonacci_and_doubling_words():
    fib, doubled = ["a", "ab"], "a"
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    while len(doubled) < 400:  # a word, a letter, the word again
        doubled = doubled + chr(97 + len(doubled) % 23) + doubled
    docs = [list(fib[-1]), list(doubled), list(fib[-1][::-1] + doubled)]
    assert periodic_runs.document_runs(docs) == [brute(d) for d in docs]


def expected(doc_id, text):
    words, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2])) if runs else None
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    digests = ("".join(f"{s},{e - s},{q}\n" for s, e, q in runs), " ".join(w for i, w in enumerate(words) if i not in dropped))
    return (doc_id, len(runs), *top, *[hashlib.sha256(d.encode()).hexdigest() for d in digests])


def test_query_on_a_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(rows)
    short = [r for r in rows if len(r.text.split()) <= 1500]
    assert len(short) > 150 and any(got[r.doc_id][1] for r in short)
    assert [got[r.doc_id] for r in short] == [expected(r.doc_id, r.text) for r in short]


def test_nulls_empty_long_repeated_and_clashing(spark):
    texts = [None, "", " \t\n", "a", "b " * 5000, "x y " * 40, "x y " * 40, "    é " * 30, "a\x0bb\x0c" * 9, "tail " + "one two three " * 9]
    rows = [(k, t, 1, "s") for k, t in enumerate(texts)] + [(5, texts[5], 1, "s"), (None, texts[5], None, None), (None, None, None, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, start long, runs_sha256 string").repartition(3)
    got = sorted(map(tuple, periodic_runs.find_runs(documents, prepare=periodic_runs.planted).collect()), key=repr)
    assert got == sorted([expected(r[0], r[1]) for r in rows], key=repr)
    assert periodic_runs.find_runs(documents.limit(0)).collect() == []
