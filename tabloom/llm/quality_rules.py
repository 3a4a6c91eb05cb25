"""Quality rules: a learned decision list over text statistics, in Spark expressions only.

Statistics are computed in each row from the whole text. Rejected labels are covered one rule at a
time: a rule grows by the threshold condition with the best gain on two thirds of the labelled
rows and is pruned, and accepted, on the last third. All labelled rows count: they are
reduced to counts per vector of threshold bins, and each step of growth is one
aggregation to a count per feature, bin and label. The list is emitted as one ordered
conditional expression.

Null, empty and blank texts have no words and fail the base rule. Labels that are null are
ignored, contradictory ones of a doc_id count as rejected. Without labels the list is empty.
"""

import math

from pyspark.sql import functions as F

from tabloom.llm.common import stored

BLANK = r"[ \t\n\x0B\f\r]"
WORD = r"[^ \t\n\x0B\f\r]"
SYMBOL = r"#*$%&|<>"
#: Statistics with thresholds, as ratios that do not depend on a text's length.
FEATURES = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "capital_share": ("n_capitals", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")
#: Thresholds per feature, rules, conditions per rule, and what a rule must reach.
BINS, MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_COVERED = 32, 8, 3, 0.9, 5


def only(text, characters):
    """How many code points of a text are in a character class."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def let(value, body):
    """body(value), with the value computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def window_hashes(words):
    hashed = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(F.size(words) >= 3, hashed).otherwise(F.array().cast("array<bigint>"))


def repeated_windows(hashes):
    """Places, in order, of the windows that occur more than once; only texts with a repeat sort theirs."""

    def same(pairs, p, k):
        near = (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"])
        return F.coalesce(near, F.get(pairs, k + 1)["h"] == p["h"], F.get(pairs, k - 1)["h"] == p["h"], F.lit(False))

    def places(pairs):
        return F.sort_array(F.transform(F.filter(pairs, lambda p, k: same(pairs, p, k)), lambda p: p["i"]))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeats, let(pairs, places)).otherwise(F.array().cast("array<int>"))


def covered(places):
    """Words in windows of three that start at these places."""
    return F.aggregate(
        places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"],
    )


def counts_of(text):
    """All counts of a text as one struct.

    A word is in a repeated window if one of the windows of three words over it occurs at least
    twice. Windows are compared by hash.
    """
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, f"{BLANK}+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    parts = F.struct(words.alias("w"), lines.alias("l"))
    return let(parts, lambda p: F.struct(
        F.size(p["w"]).cast("long").alias("n_words"),
        (F.length(t) - F.length(F.regexp_replace(t, f"{WORD}+", ""))).cast("long").alias("word_chars"),
        only(t, SYMBOL).alias("n_symbols"),
        (F.size(p["l"]) - F.size(F.array_distinct(p["l"]))).cast("long").alias("n_dup_lines"),
        let(window_hashes(p["w"]), lambda h: covered(repeated_windows(h))).alias("n_repeat_words"),
        F.size(p["l"]).cast("long").alias("n_lines"),
        only(t, "A-Z").alias("n_capitals"),
        only(t, "!?").alias("n_marks"),
    ))


def base_failed(c=F.col):
    """Too few words, or over half of them in repeated windows; `c` gives a count by name."""
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def statistics(documents):
    """doc_id and the counts of every text."""
    counted = documents.select(F.col("doc_id").cast("long").alias("doc_id"), counts_of(F.col("text")).alias("counts"))
    return counted.select("doc_id", *[F.col(f"counts.{c}") for c in COUNTS])


def feature(name, c=F.col):
    """A statistic from the counts; a text without words or lines has zero."""
    over, under = FEATURES[name]
    return c(over) / F.greatest(c(under), F.lit(1))


def labelled_bins(stats, labels, bins):
    """Thresholds per feature, and the number of labelled rows per vector of bins.

    Bin b of a feature holds the values over b of its thresholds, so `value > thresholds[b]`
    is `bin > b`.
    """
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    rows = stats.join(marks.agg(F.min("quality").alias("quality")), "doc_id").filter(~base_failed())
    rows = stored(rows.select("doc_id", "quality", *[feature(f).alias(f) for f in FEATURES]), "labelled")
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES]).first()
    thresholds = {f: sorted(set(found[f] or [])) for f in FEATURES}

    def bin_of(f):
        return sum((F.when(F.col(f) > x, 1).otherwise(0) for x in thresholds[f]), F.lit(0)).cast("int").alias(f)

    vectors = rows.select(
        (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"), *map(bin_of, FEATURES)
    )
    counted = vectors.groupBy(*vectors.columns).agg(F.count("*").alias("n"))
    return rows, thresholds, stored(counted, "vectors")


def holds(conditions, value):
    """Conjunction of (feature, over, threshold index); `value` gives the compared column."""
    result = F.lit(True)
    for f, over, at in conditions:
        left, right = value(f, at)
        result = result & ((left > right) if over else (left <= right))
    return result


def on_bins(f, at):
    return F.col(f), F.lit(at)


def gain(bad, good, all_bad, all_good):
    """Covered bad rows times the bits by which they became easier to tell."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(all_bad / (all_bad + all_good)))


def best_condition(rows, thresholds):
    """The condition with the best gain, from one count per feature, bin and label."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("bin")) for f in FEATURES])).alias("x")
    counted = rows.select("bad", "n", pairs).groupBy("x.f", "x.bin", "bad").agg(F.sum("n").alias("n")).collect()
    tally = {f: {b: [0, 0] for b in range(len(t) + 1)} for f, t in thresholds.items()}
    for r in counted:
        tally[r["f"]][r["bin"]][r["bad"]] += r["n"]
    best = (0.0, None)
    for f, bins in tally.items():
        good, bad = (sum(v[k] for v in bins.values()) for k in (0, 1))
        low_good = low_bad = 0
        for at in range(len(thresholds[f])):
            low_good, low_bad = low_good + bins[at][0], low_bad + bins[at][1]
            for over, (b, g) in ((False, (low_bad, low_good)), (True, (bad - low_bad, good - low_good))):
                best = max(best, (gain(b, g, bad, good), (f, over, at)), key=lambda x: x[0])
    return best[1]


def centred(rows, rule):
    """The rule with each threshold halfway between the labelled values on its two sides."""
    sides = []
    for k, (f, _, at) in enumerate(rule):
        sides += [F.max(F.when(F.col(f) <= at, F.col(f))).alias(f"low{k}"), F.min(F.when(F.col(f) > at, F.col(f))).alias(f"high{k}")]
    found = rows.agg(*sides).first()
    gaps = [(found[f"low{k}"], found[f"high{k}"], at) for k, (_, _, at) in enumerate(rule)]
    middle = [at if None in (low, high) else (low + high) / 2 for low, high, at in gaps]
    return [(f, over, x) for (f, over, _), x in zip(rule, middle, strict=True)]


def learn(stats, labels, bins=BINS, max_rules=MAX_RULES, max_conditions=MAX_CONDITIONS,
          min_precision=MIN_PRECISION, min_covered=MIN_COVERED):
    """The decision list: conjunctions of (feature, over, threshold), in order."""
    rows, thresholds, left = labelled_bins(stats, labels, bins)
    rules = []
    while len(rules) < max_rules:
        conditions = []
        while len(conditions) < max_conditions:
            condition = best_condition(left.filter(~F.col("prune")).filter(holds(conditions, on_bins)), thresholds)
            if condition is None or condition in conditions:
                break
            conditions.append(condition)
        if not conditions:
            break
        prefixes = [conditions[: k + 1] for k in range(len(conditions))]
        judged = left.filter("prune").agg(*[
            F.sum(F.when(holds(p, on_bins) & (F.col("bad") == bad), F.col("n")).otherwise(0)).alias(f"p{k}{bad}")
            for k, p in enumerate(prefixes) for bad in (True, False)
        ]).first()
        scored = [(judged[f"p{k}True"] or 0, judged[f"p{k}False"] or 0) for k in range(len(prefixes))]
        # of the precise prefixes the one that covers most, the shortest of equals
        fit = [(b, -k) for k, (b, g) in enumerate(scored) if b >= min_covered and b >= min_precision * (b + g)]
        if not fit:
            break
        rule = prefixes[-max(fit)[1]]
        rules.append(centred(rows, [(f, over, thresholds[f][at]) for f, over, at in rule]))
        left = left.filter(~holds(rule, on_bins))
    return rules


def verdict(rules, c=F.col):
    """True for a kept row: base rule first, then the learned rules in their order."""
    kept = F.when(base_failed(c), False)
    for rule in rules:
        kept = kept.when(holds(rule, lambda f, x: (feature(f, c), F.lit(x))), False)
    return kept.otherwise(True)


def judge(documents, labels):
    """doc_id, the counts, base_failed and kept of every document."""
    stats = stored(statistics(documents), "statistics")
    rules = learn(stats, labels)
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), verdict(rules).alias("kept"),
    )


def good_documents(documents, labels):
    """The documents the list keeps, columns unchanged."""
    rules = learn(stored(statistics(documents), "statistics"), labels)
    return documents.filter(let(counts_of(F.col("text")), lambda counts: verdict(rules, lambda name: counts[name])))
