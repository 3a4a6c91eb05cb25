"""URL filter: rules by host and path, and a character language-model ratio for the rest.

URLs that a rule decides train two smoothed variable-order Markov models over characters, one
of accepted and one of rejected URLs (orders 0 to 2, each order interpolated with the
next lower by the number of its distinct followers). A URL's score is the difference of its two
log-likelihoods over its length. The cut is the one with the best balanced accuracy on a
fifth of the decided URLs that the models have not seen.

Both models together are one number per three characters: ALPHABET has 37 signs and a start, so
38**3 = 54,872 numbers whatever the data, which go to the tasks as one literal. Scoring is then
a projection without join, shuffle or Python.

Null URLs and those without :// have empty host and path and meet no rule; without any character the
score is 0. Repeated rows are judged alike.
"""

import math

from pyspark.sql import functions as F

# Fixed values: (verdict, host, path), as the filter lists give them.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABET = SMALL + "0./-?=&#_%~"
SIZE = len(ALPHABET) + 1
HELD_OUT, CUT_BINS = 5, 400


def lowered(c):
    return F.translate(c, CAPITALS, SMALL)


def with_parts(pages):
    """page_id, url, host, path."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    df = pages.select("page_id", "url", rest.alias("rest"))
    df = df.withColumn("rest", F.coalesce("rest", F.lit("")))
    df = df.withColumn("host", F.regexp_extract("rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(rest, length(host) + 1)"), r"^[^?#]*", 0)
    return df.select("page_id", "url", lowered(F.col("host")).alias("host"), path.alias("path"))


def with_rule(parts, rules=RULES):
    """The longest rule that fits, like net/, and its verdict; else nulls."""
    rule = decided = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, decided = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(decided)
    return parts.withColumns({"rule": rule, "decided": decided})


def grams(url):
    """Numbers of all three-character sequences of a URL, one per character.

    The scheme is left out, digits count alike, and so do characters outside the alphabet.
    """
    text = f"coalesce(substring({url}, instr({url}, '://') + if(instr({url}, '://') > 0, 3, 1)), '')"
    folded = F.regexp_replace(F.regexp_replace(lowered(F.expr(text)), "[0-9]", "0"), r"[^a-z0./?=&#_%-]", "~")
    codes = F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.concat(F.array(F.lit(0), F.lit(0)), codes)


def numbers(codes):
    return F.expr(
        f"CASE WHEN size({codes}) > 2 THEN transform(sequence(2, size({codes}) - 1), "
        f"i -> ({codes}[i - 2] * {SIZE} + {codes}[i - 1]) * {SIZE} + {codes}[i]) ELSE array() END"
    )


def probabilities(counts):
    """log P(third | first two) for all SIZE**3 sequences, from the counts of those seen."""
    orders = [{}, {}, {}]  # context to {sign: count}
    for number, n in counts.items():
        a, b, c = number // SIZE**2, number // SIZE % SIZE, number % SIZE
        for order, context in enumerate(((), (b,), (a, b))):
            followers = orders[order].setdefault(context, {})
            followers[c] = followers.get(c, 0) + n

    def smoothed(order, context, lower):
        seen = orders[order].get(context)
        if not seen:
            return lower
        total, kinds = sum(seen.values()), len(seen)
        return [(seen.get(c, 0) + kinds * p) / (total + kinds) for c, p in enumerate(lower)]

    zero = smoothed(0, (), [1 / SIZE] * SIZE)
    one = [smoothed(1, (b,), zero) for b in range(SIZE)]
    return [math.log(p) for a in range(SIZE) for b in range(SIZE) for p in smoothed(2, (a, b), one[b])]


def best_cut(rows):
    """The score between rejected and accepted with the best balanced accuracy; 0 without both."""
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    if low is None or low == high:
        return 0.0
    step = (high - low) / CUT_BINS
    place = F.least(F.floor((F.col("score") - low) / step), F.lit(CUT_BINS - 1)).cast("int")
    tally = [[0, 0] for _ in range(CUT_BINS)]
    for r in rows.groupBy(place.alias("bin"), "decided").count().collect():
        tally[r["bin"]][r["decided"] == "allow"] += r["count"]
    blocked, allowed = (sum(t[k] for t in tally) for k in (0, 1))
    if not blocked or not allowed:
        return 0.0
    best, cut, under = -1.0, [], [0, 0]
    for k in range(CUT_BINS + 1):
        balanced = under[0] / blocked + (allowed - under[1]) / allowed
        if balanced > best + 1e-12:
            best, cut = balanced, []
        if abs(balanced - best) <= 1e-12:
            cut.append(low + k * step)
        if k < CUT_BINS:
            under = [u + t for u, t in zip(under, tally[k], strict=True)]
    return cut[len(cut) // 2]  # the middle of the best cuts


def judge(pages, rules=RULES):
    """page_id, host, path, rule, verdict and score of every page."""
    parts = with_rule(with_parts(pages), rules)
    fold = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT))
    coded = parts.withColumn("codes", grams("url")).withColumn("numbers", numbers("codes")).withColumn("fold", fold)
    taught = coded.filter("decided IS NOT NULL AND fold != 0").select("decided", F.explode("numbers").alias("number"))
    counts = {"allow": {}, "block": {}}
    for r in taught.groupBy("decided", "number").count().collect():  # at most 2 * SIZE**3 rows
        counts[r["decided"]][r["number"]] = r["count"]
    ratio = [a - b for a, b in zip(*(probabilities(counts[k]) for k in ("allow", "block")), strict=True)]
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratio)), ",").cast("array<double>")
    total = F.aggregate("numbers", F.lit(0.0), lambda sum_, i: sum_ + F.get(table, i))
    scored = coded.withColumn("score", total / F.greatest(F.size("numbers"), F.lit(1)))
    cut = best_cut(scored.filter("decided IS NOT NULL AND fold = 0").select("decided", "score"))
    verdict = F.coalesce("decided", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
