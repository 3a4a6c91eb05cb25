"""Mixing sources to target weights by iterative proportional fitting.

Documents fall in cells of source, language and topic. Raking multiplies a cell's factor in turn until the token weights meet the
targets of all three marginals: until the largest relative error of a level is below TOLERANCE, or ROUNDS rounds are over. Targets that
cannot be met together, for want of cells, leave an error; it is returned, and `strict` makes it one of the job.

A document's probability is min(1, c * factor) of its cell, where c is such that KEEP of all tokens are expected in the sample.
So a rare cell that the targets want more of than there is comes whole and does not set the scale. A document is drawn if a number
hashed from its id, or its text if it has none, lies below its probability. The draw needs no state and is the same wherever it runs.

The topic is the form of the text: table, symbols, capitals or prose. Null languages and sources are levels of their own. Documents
without words have no weight and get the factor of their cell. Without targets of its own each level's share is tempered by POWERS.
Up to CELLS cells are raked as one array, with one job for their counts; more are raked by Spark, with one job a round.
An empty table gives no rows. Extra columns pass, whatever their names.
"""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.llm.common import stored, unused

DIMENSIONS = ("source", "lang", "topic")
#: Power on the share of each level that makes its target: 1 keeps it, 0 makes all equal.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
ROUNDS, TOLERANCE = 60, 1e-10
#: Expected share of all tokens in the sample.
KEEP = 0.75
#: Error of a marginal that `strict` allows.
ALLOWED = 1e-3
#: Cells raked as one array, some 100 bytes each; they may be sent to all tasks too.
CELLS = 50_000


def only(text, characters):
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def cell_columns():
    """Expressions of source, lang, topic and tokens of a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")
    topic = (
        F.when(3 * only(text, "|") > tokens, "table").when(2 * only(text, "#$%&*") > tokens, "symbols")
        .when(2 * only(text, "A-Z") > F.length(text), "capitals").otherwise("prose")
    )
    source, lang = (F.coalesce(F.col(c).cast("string"), F.lit("(none)")) for c in ("source", "lang"))
    return {"source": source, "lang": lang, "topic": topic, "tokens": tokens}


def target_shares(levels, power, given=None):
    """Share of all tokens wanted per level of one dimension, in the order of `levels` (level, tokens)."""
    if given is not None:
        missing = [n for n, t in levels if t and n not in given]
        if missing:
            raise ValueError(f"no target for {missing[:5]}")
        shares = np.array([float(given.get(n, 0)) for n, _ in levels])
    else:
        shares = np.array([float(t) ** power if t else 0.0 for _, t in levels])
    return shares / (shares.sum() or 1.0)


def rake(tokens, places, targets, rounds=ROUNDS, tolerance=TOLERANCE):
    """(factor of each cell, largest relative error of a marginal).

    `places` has the level number of each cell in each dimension, `targets` the wanted share of each level.
    """
    factor, total, error = np.ones(len(tokens)), float(tokens.sum()), 0.0
    for _ in range(rounds if total else 0):
        for place, target in zip(places, targets):
            got = np.bincount(place, tokens * factor, len(target))
            factor = factor * np.where(got > 0, target * total / np.where(got > 0, got, 1.0), 1.0)[place]
        error = max(relative(p, t, tokens * factor / total) for p, t in zip(places, targets))
        if error < tolerance:
            break
    return factor, error


def relative(place, target, weights):
    """Largest error of a level's share, relative to its target."""
    got = np.bincount(place, weights, len(target))
    wanted = target > 0
    return float((np.abs(got - target)[wanted] / target[wanted]).max(initial=0.0))


def scale_of(tokens, factor, keep):
    """c such that the cells' min(1, c * factor) keep this share of all tokens."""
    order = np.argsort(-factor, kind="stable")
    tokens, factor = tokens[order].astype(float), factor[order]
    before = np.cumsum(tokens) - tokens
    left = np.cumsum((tokens * factor)[::-1])[::-1]
    able = left > 0
    return float(((keep * tokens.sum() - before)[able] / left[able]).max(initial=0.0))


def raked_array(cells, powers, targets, keep, rounds, tolerance):
    """Rows (source, lang, topic, probability) and the error, of collected cells."""
    tokens = np.array([r.tokens for r in cells], np.int64)
    places, shares = [], []
    for d in DIMENSIONS:
        names = sorted({r[d] for r in cells})
        number = {n: i for i, n in enumerate(names)}
        place = np.array([number[r[d]] for r in cells], np.int64)
        weights = np.bincount(place, tokens, len(names)) if cells else np.zeros(0)
        places.append(place)
        shares.append(target_shares(list(zip(names, weights)), powers[d], (targets or {}).get(d)))
    factor, error = rake(tokens, places, shares, rounds, tolerance)
    chance = np.minimum(1.0, scale_of(tokens, factor, keep) * factor)
    return [(r.source, r.lang, r.topic, float(p)) for r, p in zip(cells, chance)], error


def raked_frame(cells, powers, targets, keep, rounds, tolerance):
    """The same for any number of cells, as a table and the error."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    for d in DIMENSIONS:
        if (given := (targets or {}).get(d)) is not None:
            rows = [(str(k), float(v) * total / sum(given.values())) for k, v in given.items()]
            cells = cells.join(spark.createDataFrame(rows, f"{d} string, want_{d} double"), d, "left")
            cells = cells.withColumn(f"want_{d}", F.when(F.col("tokens") == 0, F.coalesce(f"want_{d}", F.lit(0.0))).otherwise(F.col(f"want_{d}")))
            if missing := cells.filter(F.col(f"want_{d}").isNull()).select(d).limit(5).collect():
                raise ValueError(f"no target for {[r[0] for r in missing]}")
        else:
            share = cells.groupBy(d).agg(F.sum("tokens").alias("t")).select(d, F.when(F.col("t") > 0, F.pow("t", F.lit(powers[d]))).otherwise(0.0).alias("s"))
            share = stored(share, "shares")
            whole = share.agg(F.sum("s")).first()[0] or 1.0
            cells = cells.join(share.select(d, (F.col("s") * F.lit(total / whole)).alias(f"want_{d}")), d)
    cells, error = stored(cells.withColumn("factor", F.lit(1.0)), "cells"), 0.0
    weight = F.col("tokens") * F.col("factor")
    for _ in range(rounds if total else 0):
        for d in DIMENSIONS:
            got = F.sum(weight).over(Window.partitionBy(d))
            step = F.when(got > 0, F.col(f"want_{d}") / got).otherwise(1.0)
            cells = cells.withColumn("step", step).withColumn("factor", F.col("factor") * F.col("step")).drop("step")
        cells = stored(cells, "cells")
        gaps = []
        for d in DIMENSIONS:
            level = cells.groupBy(d).agg(F.sum(weight).alias("got"), F.max(f"want_{d}").alias("want")).filter("want > 0")
            gaps.append(level.select((F.abs(F.col("got") - F.col("want")) / F.col("want")).alias("gap")))
        error = gaps[0].unionByName(gaps[1]).unionByName(gaps[2]).agg(F.max("gap")).first()[0] or 0.0
        if error < tolerance:
            break

    def expected(scales):
        """Tokens kept at each of some scales, in one job."""
        kept = [F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("factor") * float(c))).alias(f"c{i}") for i, c in enumerate(scales)]
        return [x or 0.0 for x in cells.agg(*kept).first()]

    scales = np.concatenate([[0.0], 2.0 ** np.arange(-50, 51)])
    for _ in range(11 if total else 0):  # 20 parts each time: 1e-14 of the scale in the end
        at = int(np.searchsorted(expected(scales), keep * total * (1 - 1e-14)))
        scales = np.linspace(scales[max(at - 1, 0)], scales[min(at, len(scales) - 1)], 21)
    high = scales[-1]
    return cells.select(*DIMENSIONS, F.least(F.lit(1.0), F.col("factor") * high).alias("probability")), error


def probabilities(rows, powers=POWERS, targets=None, keep=KEEP, rounds=ROUNDS, tolerance=TOLERANCE, strict=False, most_cells=CELLS):
    """source, lang, topic and probability of every cell of (source, lang, topic, tokens) rows; the largest error; whether cells are few.

    `targets` gives {level: weight} for some dimensions, with a weight for every level that has tokens.
    """
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    few = cells.count() <= most_cells
    if few:
        found, error = raked_array(cells.collect(), powers, targets, keep, rounds, tolerance)
        found = cells.sparkSession.createDataFrame(found, "source string, lang string, topic string, probability double")
    else:
        found, error = raked_frame(cells, powers, targets, keep, rounds, tolerance)
    if strict and error > ALLOWED:
        raise ValueError(f"the targets cannot be met together: a level is off by {error:.2%}")
    return found, error, few


def drawn(doc_id, text):
    """A number in [0, 1) from a document's id, or its text if it has none."""
    own = F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit(""))))
    key = F.concat(F.coalesce(doc_id.cast("string"), own), F.lit(":mix"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mixed(documents, **options):
    """doc_id, source, lang, topic, tokens, probability, kept and target_error (one value) of every document."""
    cell = cell_columns()
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in cell.items()], drawn(F.col("doc_id"), F.col("text")).alias("draw")
    )
    rows = stored(rows, "weights")
    found, error, few = probabilities(rows, **options)
    return rows.join(F.broadcast(found) if few else found, list(DIMENSIONS)).select(
        "doc_id", *DIMENSIONS, "tokens", F.round("probability", 6).alias("probability"),
        (F.col("draw") < F.col("probability")).alias("kept"), F.round(F.lit(float(error)), 6).alias("target_error"),
    )


def sample(documents, **options):
    """The drawn documents, columns unchanged."""
    cell = cell_columns()
    found, _, few = probabilities(documents.select(*[c.alias(k) for k, c in cell.items()]), **options)
    names = {n: unused(documents, f"mixing_{n}") for n in (*DIMENSIONS, "probability")}
    found = found.withColumnsRenamed(names)
    tagged = documents.withColumns({names[d]: cell[d] for d in DIMENSIONS})
    joined = tagged.join(F.broadcast(found) if few else found, [names[d] for d in DIMENSIONS])
    return joined.filter(drawn(F.col("doc_id"), F.col("text")) < F.col(names["probability"])).select(*[F.col(f"`{c}`") for c in documents.columns])


def mixed_sql():
    """SQL of `mixed`; all rounds run, which changes nothing once the marginals are met."""
    only_sql = "length(regexp_replace(coalesce(text, ''), '[^{}]+', '', 'g'))".format
    targets = ", ".join(
        f"s_{d} AS (SELECT {d}, p / sum(p) OVER () AS share FROM (SELECT {d}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {POWERS[d]}) ELSE 0 END AS p "
        f"FROM c GROUP BY {d}))" for d in DIMENSIONS
    )
    step = f"SELECT n + 1 AS n, * EXCLUDE (n) FROM k WHERE n < {ROUNDS}"
    for d in DIMENSIONS:
        got = f"sum(tokens * factor) OVER (PARTITION BY {d})"
        step = f"SELECT * REPLACE (factor * CASE WHEN {got} > 0 THEN want_{d} / {got} ELSE 1 END AS factor) FROM ({step})"
    errors = " UNION ALL ".join(
        f"SELECT max(abs(got - want) / want) AS e FROM (SELECT sum(tokens * factor) AS got, max(want_{d}) AS want FROM r GROUP BY {d}) WHERE want > 0"
        for d in DIMENSIONS
    )
    return f"""
    WITH RECURSIVE words AS (SELECT doc_id, text, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
        len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS tokens FROM documents),
    w AS MATERIALIZED (SELECT doc_id, text, source, lang, tokens, CASE WHEN 3 * {only_sql('|')} > tokens THEN 'table'
        WHEN 2 * {only_sql('#$%&*')} > tokens THEN 'symbols' WHEN 2 * {only_sql('A-Z')} > length(coalesce(text, '')) THEN 'capitals'
        ELSE 'prose' END AS topic FROM words),
    c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM w GROUP BY ALL),
    {targets},
    k AS (SELECT 0 AS n, c.source, c.lang, c.topic, tokens, 1.0::DOUBLE AS factor,
        {", ".join(f"s_{d}.share * sum(tokens) OVER () AS want_{d}" for d in DIMENSIONS)}
        FROM c {" ".join(f"JOIN s_{d} ON c.{d} = s_{d}.{d}" for d in DIMENSIONS)} UNION ALL {step}),
    r AS MATERIALIZED (SELECT * FROM k WHERE n = {ROUNDS}),
    o AS (SELECT *, sum(tokens) OVER q - tokens AS before, sum(tokens * factor) OVER () - sum(tokens * factor) OVER q + tokens * factor AS rest,
        sum(tokens) OVER () AS total FROM r WINDOW q AS (ORDER BY factor DESC, source, lang, topic ROWS UNBOUNDED PRECEDING)),
    z AS (SELECT greatest(0, max(({KEEP} * total - before) / rest)) AS scale FROM o WHERE tokens > 0),
    e AS (SELECT max(e) AS error FROM ({errors}))
    SELECT doc_id, w.source, w.lang, w.topic, w.tokens, round(least(1.0, scale * factor), 6) AS probability,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) || ':mix'), 1, 8))::BIGINT / 4294967296.0
        < least(1.0, scale * factor) AS kept, round(error, 6) AS target_error
    FROM w JOIN r USING (source, lang, topic), z, e"""
