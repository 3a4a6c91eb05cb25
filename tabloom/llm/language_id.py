"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities over the pieces of one fixed public vocabulary. A word's
likelihood sums the probabilities of all its segmentations into pieces, by a forward pass; a
text's is the product over its words. The prediction is the language of the largest posterior.

Piece counts come from all learning texts: each task counts words per language, cuts each distinct
word once, and sends its piece counts. The model is languages times pieces, at most
MAX_LANGUAGES times the vocabulary, and is the one thing sent to all tasks.

Words are runs of letters in lower case. Null texts and those without a letter are `und` with score 0, and so
is every text if nothing was learned. Rows with a null doc_id are neither held out nor learned from.
"""

from functools import lru_cache

from pyspark.sql import functions as F

#: Labels the model may have; more raise an error.
MAX_LANGUAGES = 1000
#: Added to every piece count; probability of a character outside the vocabulary.
SMOOTHING, OUTSIDE = 0.05, 1e-7
#: Longest piece and longest stretch of a word scored as one.
LONGEST_PIECE, STRETCH = 16, 32
#: Distinct words counted or remembered by a worker, and characters handled together.
REMEMBERED, RUN_CHARACTERS = 500_000, 2_000_000
SPACE = "▁"
TO_WORDS = bytes(b | 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def letter_words(text):
    """Runs of letters as bytes in lower case; None for a text without a letter."""
    if not text:
        return None
    if not text.isascii():
        text = text.lower()
    words = text.encode().translate(TO_WORDS).split()
    return words if words and (text.isascii() or any(map(str.isalpha, text))) else None


@lru_cache(maxsize=2)
def processor(path):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_counts(documents, vocabulary):
    """lang, piece and n over all texts of (lang, text) rows."""
    schema = "lang string, piece string, n long"

    def counts(batches):
        import pyarrow as pa
        from collections import Counter

        sp, words = processor(vocabulary), {}

        def cut():
            rows = []
            for lang, counted in words.items():
                pieces = Counter()
                texts = [w.decode("utf-8", "ignore") for w in counted]
                for cuts, n in zip(sp.encode(texts, out_type=str), counted.values(), strict=True):
                    for piece in cuts:
                        pieces[piece] += n
                rows += [(lang, piece, n) for piece, n in pieces.items()]
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "piece", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(letter_words(text) or ())
            if sum(map(len, words.values())) > REMEMBERED:
                yield cut()
        if any(words.values()):
            yield cut()

    every = documents.select("lang", "text").mapInArrow(counts, schema)
    return every.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Languages:
    """Log-likelihoods of words per language."""

    def __init__(self, counts, vocabulary, priors):
        import numpy as np

        sp = processor(vocabulary)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        pieces = [p for p in pieces if len(p) <= LONGEST_PIECE and SPACE not in p[1:]]
        self.names = sorted(priors)
        self.prior = np.log(np.array([priors[x] for x in self.names], float) / sum(priors.values()))
        self.index = {p: k for k, p in enumerate(pieces)}
        table = np.full((len(pieces), len(self.names)), SMOOTHING)
        for (lang, piece), n in counts.items():
            if piece in self.index:
                table[self.index[piece], self.names.index(lang)] += n
        table /= table.sum(0)
        # two rows more: no piece, and a single character outside the vocabulary
        self.table = np.vstack([table, np.zeros(len(self.names)), np.full(len(self.names), OUTSIDE)])
        self.known, self.scores = {}, np.zeros((0, len(self.names)))

    def forward(self, stretches):
        """Log-likelihood of stretches of one length, summed over all segmentations."""
        import numpy as np

        size, none = len(stretches[0]), len(self.index)
        alpha = [np.ones((len(stretches), len(self.names)))]
        for end in range(1, size + 1):
            total = 0
            for start in range(max(0, end - LONGEST_PIECE), end):
                miss = none + (end - start == 1)
                at = [self.index.get(s[start:end], miss) for s in stretches]
                total = total + alpha[start] * self.table[at]
            alpha.append(total)
        return np.log(alpha[size])

    def learn(self, words):
        """Score words not yet known, all of one length together."""
        import numpy as np

        new = list(words)
        scores, by_length = np.zeros((len(new), len(self.names))), {}
        for k, word in enumerate(new):
            text = SPACE + word.decode("utf-8", "ignore")
            for at in range(0, len(text), STRETCH):
                part = text[at : at + STRETCH]
                by_length.setdefault(len(part), []).append((k, part))
        for parts in by_length.values():
            for at in range(0, len(parts), 50_000):
                some = parts[at : at + 50_000]
                np.add.at(scores, [k for k, _ in some], self.forward([p for _, p in some]))
        if len(self.known) > REMEMBERED:
            self.known, self.scores = {}, self.scores[:0]
        self.known.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
        self.scores = np.vstack([self.scores, scores])

    def predict(self, texts):
        """(language, posterior) of every text."""
        import numpy as np

        every = [letter_words(t) for t in texts]
        new = {w for words in every if words for w in words if w not in self.known}
        if len(self.known) > REMEMBERED:  # start over with what these texts need
            new = {w for words in every if words for w in words}
        if new:
            self.learn(new)
        found = []
        for words in every:
            if words is None:
                found.append(("und", 0.0))
                continue
            total = self.prior + self.scores[list(map(self.known.__getitem__, words))].sum(0)
            best = int(total.argmax())
            found.append((self.names[best], float(1 / np.exp(total - total[best]).sum())))
        return found


def fit(documents, vocabulary):
    """Piece counts and document counts per language of the (lang, text) rows, as one small model."""
    priors = {r["lang"]: r["count"] for r in documents.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(priors) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    counts = {(r["lang"], r["piece"]): r["n"] for r in piece_counts(documents, vocabulary).collect()}
    return counts, priors


def predict(documents, model, vocabulary):
    """The rows of documents (without text) with lang_pred and score."""
    counts, priors = model
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast((counts, priors))
    rest = documents.drop("text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema) + ", lang_pred string, score double"

    def label(batches):
        import pyarrow as pa

        languages = Languages(sent.value[0], vocabulary, sent.value[1]) if sent.value[1] else None
        for batch in batches:
            texts, found, held, size = batch.column("text").to_pylist(), [], [], 0
            for text in texts:
                held.append(text)
                size += len(text or "")
                if size > RUN_CHARACTERS:
                    found += languages.predict(held) if languages else [("und", 0.0)] * len(held)
                    held, size = [], 0
            found += languages.predict(held) if languages else [("und", 0.0)] * len(held)
            columns = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                [*names, "lang_pred", "score"],
            )

    return documents.mapInArrow(label, schema)


def identify(documents, vocabulary):
    """doc_id, held_out, lang_pred and score; learns where crc32(doc_id) mod 4 is not 2."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    learn = documents.filter(fold != 2).filter("text IS NOT NULL AND lang IS NOT NULL").select(F.col("lang").cast("string"), "text")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text"
    )
    return predict(rows, fit(learn, vocabulary), vocabulary)
