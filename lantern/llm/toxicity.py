"""Toxicity of whole texts: a lexicon learned from labels, matched with spelling errors, weighed by its context.

Terms are whole words and stems (beginnings that words share). Words are held in a trie. A word that is neither is read
by a Levenshtein automaton (a bit-parallel one, its states the positions reached with 0 to k errors), which walks the
trie and gives up a branch once no state is left: one error for terms of 5 to 7 letters, where neighbours that change
places are one error too, and two for longer ones. Around each match a window of words tells use from mention:
quotation marks and verbs of saying lower the match's weight, a second person raises it. A logistic curve turns the
summed weights into a probability.

The lexicon and the curve are fitted on a bounded sample of the labelled rows, MAX_SAMPLE by default.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import prepare, read, written

#: Labelled rows that the model is fitted on at most, and terms that its lexicon has at most.
MAX_SAMPLE, MAX_TERMS = 20_000, 20_000
THRESHOLD = 0.7
#: A learned term needs this log odds of its toxic use, and so many toxic texts to itself, or this share of all of them if that is more.
LEAST_WEIGHT, LEAST_SUPPORT, LEAST_SHARE = 2.0, 0.75, 0.005
#: Labelled texts that say enough of a term.
LEAST_TEXTS = 3
#: Shorter terms must be met as they are; terms from the second length on may have two errors.
FUZZY_LENGTH, TWO_ERRORS = 5, 8
#: Lengths of the stems that may be learned, and the different words that must share one.
STEMS, STEM_WORDS = (4, 8), 3
#: Standard errors by which a stem's log odds must be over the least weight: there are many more stems than words.
STEM_ERRORS = 2.0
#: Share of a stem's texts that a word must have to be a term beside it.
MAJOR_WORD = 0.25
FUZZY_FACTOR = 0.8
WINDOW = 6
QUOTED, TOLD, ADDRESSED = 0.4, 0.6, 1.3
REMEMBERED = 600_000

# Verbs that introduce what others said, and words that address a reader.
TELLING = frozenset("said says say wrote writes called calls quoted quote quotes told reported term word phrase insult slur dit écrit sagte schrieb dijo escribió".split())
ADDRESSING = frozenset("you your you're youre u ur tu te vous du dich ihr euch tú usted".split())
OPENING, ENDING = "\"“«„‘'", "\"”»“’'"
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$") + "“”«»„‘’…–—¡¿"
_INNER = re.compile(r"[^\w'’@$-]+")
_PLAIN = str.maketrans("013457@$", "oieastas")


def errors_allowed(term: str) -> int:
    return 0 if len(term) < FUZZY_LENGTH else 1 if len(term) < TWO_ERRORS else 2


class Trie:
    """Terms as nested dicts; None holds the term that ends at a node."""

    def __init__(self, terms: dict[str, float]) -> None:
        self.terms = terms
        self.root: dict = {}
        heads, tails, middles = set(), set(), {}
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[None] = term
            errors = errors_allowed(term)
            cuts = [len(term) * k // (errors + 1) for k in range(errors + 2)]
            if errors:
                heads.add(term[: cuts[1]])
                tails.add(term[cuts[-2] :])
                for lo, hi in zip(cuts[1:-2], cuts[2:-1], strict=True):
                    middles.setdefault((max(lo - errors, 0), lo + errors), set()).add(term[lo:hi])
        one_of = lambda x: "|".join(map(re.escape, sorted(x)))
        parts = [f"^(?:{one_of(heads)})"] + [f"^.{{{lo},{hi}}}(?:{one_of(x)})" for (lo, hi), x in sorted(middles.items())] + [f"(?:{one_of(tails)})$"]
        self.pieces = re.compile("|".join(parts), re.DOTALL) if heads else None

    def may_match(self, word: str) -> bool:
        """Some errors leave one of a term's pieces, one more than they are, as it is and nearly where it was."""
        return self.pieces is not None and self.pieces.search(word) is not None

    def near(self, word: str, errors: int | None = None) -> list[tuple[str, int]]:
        """(term, errors) within so many insertions, deletions and substitutions of the word; by default, as many as the term allows."""
        chars: dict[str, int] = {}
        for i, c in enumerate(word):
            chars[c] = chars.get(c, 0) | 1 << i
        goal, found, most = 1 << len(word), [], 2 if errors is None else errors
        start = tuple((1 << (k + 1)) - 1 for k in range(most + 1))  # k deletions of the word's first characters

        def walk(node: dict, states: tuple[int, ...]) -> None:
            if (term := node.get(None)) is not None:
                needed = next((k for k, state in enumerate(states) if state & goal), most + 1)
                if needed <= (errors_allowed(term) if errors is None else errors):
                    found.append((term, needed))
            for c, child in node.items():
                if c is None:
                    continue
                match = chars.get(c, 0)
                after = [(states[0] & match) << 1]
                for k in range(1, most + 1):
                    # read c from both, or skip it, replace it, or skip a character of the word
                    after.append(((states[k] & match) << 1) | states[k - 1] | (states[k - 1] << 1) | (after[k - 1] << 1))
                if after[-1]:
                    walk(child, tuple(after))

        walk(self.root, start)
        return found


class Matcher:
    """(weight, term) of a raw token, or None; remembered up to a bound. Stems are terms that end in a star."""

    def __init__(self, terms: dict[str, float], innocent: frozenset[str] = frozenset()) -> None:
        self.trie = Trie({t: w for t, w in terms.items() if t[-1] != "*"})
        self.stems = {t[:-1]: w for t, w in terms.items() if t[-1] == "*"}
        self.stem_lengths = sorted({len(t) for t in self.stems})
        # terms of one error at most, with two neighbours that changed places
        near = [(t, w) for t, w in self.trie.terms.items() if errors_allowed(t) == 1]
        self.swapped: dict[str, tuple[float, str]] = {}
        for t, w in near:
            for i in range(len(t) - 1):
                x = t[:i] + t[i + 1] + t[i] + t[i + 2 :]
                self.swapped[x] = max(self.swapped.get(x, (0.0, "")), (FUZZY_FACTOR * w, t))
        self.innocent, self.known = innocent, {}

    def match(self, token: str) -> tuple[float, str] | None:
        """The heaviest term that the token, or a part of it between punctuation, stands for."""
        word = token.strip(_EDGE)
        found = self._word(word)
        if found or word.isalnum():
            return found
        parts = _INNER.split(word)
        return max((f for x in parts if x and (f := self._word(x))), default=None) if len(parts) > 1 else None

    def _word(self, word: str) -> tuple[float, str] | None:
        terms, stems = self.trie.terms, self.stems
        forms = (word,) if word.isalpha() else {word, word.translate(_PLAIN)}
        exact = [(terms[w], w) for w in forms if w in terms]
        for n in self.stem_lengths:
            if n < len(word) and (x := word[:n]) in stems:
                exact.append((stems[x], x + "*"))
        if exact:
            return max(exact)
        if len(word) < FUZZY_LENGTH - 1 or word in self.innocent:
            return None
        found = [self.swapped[w] for w in forms if w in self.swapped]
        found += [(FUZZY_FACTOR**k * terms[t], t) for w in forms if self.trie.may_match(w) for t, k in self.trie.near(w)]
        return max(found, default=None)

    def __call__(self, token: str) -> tuple[float, str] | None:
        try:
            return self.known[token]
        except KeyError:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            value = self.known[token] = self.match(token)
            return value


def context_factor(words: list[str], i: int) -> float:
    """How much a match at word i counts: less in quotation and report, more where it addresses somebody."""
    before, after = words[max(0, i - WINDOW) : i + 1], words[i : i + WINDOW + 1]
    opened = next((True for w in reversed(before) if w[0] in OPENING), False)
    closed = next((True for w in after if w[-1] in ENDING or w.rstrip(".,;:!?")[-1:] in tuple(ENDING)), False)
    bare = {w.strip(_EDGE) for w in (*before[:-1], *after[1:])}
    factor = QUOTED if opened and closed else 1.0
    if not TELLING.isdisjoint(bare):
        factor *= TOLD
    elif factor == 1.0 and not ADDRESSING.isdisjoint(bare):
        factor *= ADDRESSED
    return factor


def evidence(text: str, match: Matcher) -> tuple[float, int]:
    """The summed weights of a text's terms, and its matches. A term's second use counts half, its third a quarter, and so on."""
    words = text.lower().split()
    known, lookup = match.known, match
    best: dict[str, list[float]] = {}
    n = 0
    for i, w in enumerate(words):
        try:
            hit = known[w]
        except KeyError:
            hit = lookup(w)
        if hit:
            n += 1
            best.setdefault(hit[1], []).append(hit[0] * context_factor(words, i))
    return sum(math.ldexp(x, -k) for own in best.values() for k, x in enumerate(sorted(own, reverse=True))), n


class Model:
    def __init__(self, terms: dict[str, float], innocent: frozenset[str], slope: float, offset: float) -> None:
        self.terms, self.innocent, self.slope, self.offset = terms, innocent, slope, offset

    def probability(self, weight: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * math.log1p(weight) + self.offset))))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of the likeliest curve, held back a little from certainty."""
    if not len(x) or y.min() == y.max():
        return 2.0, -2.5
    positive = y.sum()
    goal = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (len(y) - positive + 2))
    a = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.array([1.0, math.log(positive / (len(y) - positive))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (goal - p) - 1e-3 * beta)
        beta = beta + np.clip(step, -2, 2)
    return max(float(beta[0]), 0.1), float(beta[1])


def _weight(terms: dict[str, float], innocent: frozenset[str]):
    """A function of a text column: (weight, n_hits). Only the text goes to Python workers."""

    @F.arrow_udf("struct<weight double, n_hits bigint>")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        match = Matcher(terms, innocent)
        for texts in batches:
            found = [evidence(x.as_py() or "", match) for x in texts]
            yield pa.StructArray.from_arrays([pa.array([w for w, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], ["weight", "n_hits"])

    return weigh


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_sample: int = MAX_SAMPLE) -> Model:
    """Fit on docs joined with labels (0 or 1; null or other labels and null ids teach nothing).

    Of more than max_sample labelled ids, those with the smallest hashes up to about that number are used, so the ids are
    few enough to broadcast and only their texts are shuffled. Of rows that repeat an id one text teaches, so the
    sample and its words are bounded. Without labels of both kinds there are no terms, and every text scores alike.
    """
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label_col).cast("int").alias("y"))
    rows = own.count()
    if rows > max_sample:
        own = own.where(F.xxhash64("__id").bitwiseAND(F.lit((1 << 62) - 1)) < F.lit((1 << 62) * max_sample // rows))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    sample = written(texts.join(F.broadcast(own), "__id").groupBy("__id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y")))
    positive, total = sample.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    prepare(docs.sparkSession)
    terms: dict[str, float] = {}
    innocent: frozenset[str] = frozenset()
    if positive and positive < total:
        counts, terms = lexicon(sample, positive, total)
        innocent = innocents(counts, terms)
    seen = [(r.e.weight, r.y) for r in sample.select(_weight(terms, innocent)("text").alias("e"), "y").collect()]  # at most the bounded sample
    slope, offset = logistic(np.log1p(np.array([w for w, _ in seen], dtype=float)), np.array([y for _, y in seen], dtype=float))
    return Model(terms, innocent, slope, offset)


def _stems(word: Column) -> Column:
    """The beginnings of a word that may be stems."""
    lo, hi = STEMS
    return F.filter(F.array(*(F.when(F.length(word) > n, F.left(word, F.lit(n))) for n in range(lo, hi + 1))), lambda x: x.isNotNull())


def _odds(positive: int, total: int) -> Column:
    """Log odds of toxic texts among the n that have a term, t of them toxic, against those of all texts."""
    return F.log((F.col("t") + 0.5) / (F.col("n") - F.col("t") + 0.5)) - F.lit(math.log((positive + 0.5) / (total - positive + 0.5)))


def lexicon(sample: DataFrame, positive: int, total: int) -> tuple[DataFrame, dict[str, float]]:
    """Counts of texts by word, and the weights of the terms to learn.

    Candidates are words, and stems that several words share (written with a star), with high log odds; a stem's must
    be high beyond chance. A stem
    goes where a shorter one says as much. A toxic text lends each of its candidates an equal part of one vote,
    so the many rare words of one text's copies outweigh nothing, while terms that toxic texts share gather votes.
    Near copies, as a minimum hash of their word triples finds them, speak for a term as one text.
    """
    distinct = sample.dropDuplicates(["text", "y"])
    word = F.btrim(F.col("w"), F.lit(_EDGE))
    words = distinct.select("__id", "y", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("w")).select("__id", "y", word.alias("w")).where("length(w) between 3 and 40")
    words = words.where("w rlike '[a-zA-Z\\\\p{L}]'").distinct()
    counts = written(words.groupBy("w").agg(F.sum("y").alias("t"), F.count("*").alias("n")))
    star = lambda x: F.concat(x, F.lit("*"))
    shared = counts.select("t", "n", F.explode(_stems(F.col("w"))).alias("w")).groupBy("w").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.count("*").alias("words")).where(F.col("words") >= STEM_WORDS)
    covering = counts.select("w", "t", F.explode(_stems(F.col("w"))).alias("stem"))
    forms = counts.select("w", "t", "n").unionByName(shared.select(star(F.col("w")).alias("w"), "t", "n")).where(F.col("t") >= LEAST_TEXTS)
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") - F.col("t") + 0.5))  # of the log odds
    sure = F.col("weight") - F.when(F.endswith("w", F.lit("*")), STEM_ERRORS * error).otherwise(0.0)
    candidates = written(forms.select("w", "t", "n", _odds(positive, total).alias("weight")).where(sure >= LEAST_WEIGHT).select("w", "weight"))
    stems = F.transform(_stems(F.col("w")), star)  # of a stem with its star: the shorter ones and itself
    shorter = candidates.select("w", "weight", F.explode(stems).alias("stem")).where("endswith(w, '*') and stem <> w").join(candidates.select(F.col("w").alias("stem"), F.col("weight").alias("stem_weight")), "stem")
    covered = shorter.where(F.col("stem_weight") >= F.col("weight") - 0.5).select("w").distinct()
    candidates = written(candidates.join(covered, "w", "left_anti"))
    # a word is no term of its own where a stem says as much and is made of many such words
    chosen_stems = candidates.where("endswith(w, '*')").join(shared.select(star(F.col("w")).alias("w"), F.col("t").alias("stem_t")), "w").select(F.col("w").alias("stem"), F.col("weight").alias("stem_weight"), "stem_t")
    under = covering.where(F.col("t") >= LEAST_TEXTS).withColumn("stem", star(F.col("stem"))).join(chosen_stems, "stem").join(candidates, "w")
    minor = under.where((F.col("stem_weight") >= F.col("weight") - 0.5) & (F.col("t") < MAJOR_WORD * F.col("stem_t"))).select("w").distinct()
    candidates = candidates.join(minor, "w", "left_anti")
    said = words.where("y = 1").select("__id", "w").unionByName(words.where("y = 1").select("__id", F.explode(stems).alias("w"))).distinct()
    of_toxic = written(said.join(candidates, "w"))
    shares = of_toxic.groupBy("__id").agg((1 / F.count("*")).alias("share"))
    split = F.split(F.lower("text"), r"\s+")
    triples = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("ws") - 3)), lambda i: F.xxhash64(F.slice("ws", i + 1, 3)))
    prints = distinct.where("y = 1").select("__id", split.alias("ws")).select("__id", F.array_min(triples).alias("print"))
    votes = of_toxic.join(shares, "__id").join(prints, "__id").groupBy("w").agg(F.sum("share").alias("votes"), F.max("weight").alias("weight"), F.countDistinct("print").alias("texts"))
    chosen = votes.where((F.col("votes") >= max(LEAST_SUPPORT, LEAST_SHARE * positive)) & (F.col("texts") >= LEAST_TEXTS)).orderBy(F.desc("votes"), "w").limit(MAX_TERMS)
    return counts, {r.w: float(min(r.weight, 6.0)) for r in chosen.collect()}


def innocents(counts: DataFrame, terms: dict[str, float]) -> frozenset[str]:
    """Words of clean texts of the sample that are a spelling error away from a term but no error themselves."""
    prepare(counts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(terms)
        for b in batches:
            kept = [w for w in b.column(0).to_pylist() if w not in match.trie.terms and match.match(w)]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(kept)], ["w"])

    clean = counts.where("n - t >= 2 and t < 0.5 * n").select("w")
    return frozenset(r.w for r in clean.mapInArrow(run, "w string").collect())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted, n_hits) of each row, from its text alone; null and empty texts have no match.

    Null ids, repeated ids and repeated rows are scored like any other row; extra columns are not read.
    """
    prepare(docs.sparkSession)
    weighed = docs.select(F.col(id_col).cast("long").alias("doc_id"), _weight(model.terms, model.innocent)(F.col(text_col).cast("string")).alias("e")).select("doc_id", "e.weight", "e.n_hits")
    x = F.log1p("weight") * model.slope + F.lit(model.offset)
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))
    return weighed.select("doc_id", p.alias("score"), (p >= threshold).cast("int").alias("predicted"), "n_hits")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that teach nothing: the checksum of the id as text leaves 1 by 3. A null id has no remainder."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, under the model of the labelled rows that are not held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_hits")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns, whatever their names; a null text stays."""
    model = train(docs.where(~held_out(id_col)), labels.where(~held_out(id_col)), id_col, text_col, label_col)
    least = (math.log(threshold / (1 - threshold)) - model.offset) / model.slope
    weight = _weight(model.terms, model.innocent)(docs[text_col].cast("string"))["weight"]
    return docs.where(docs[text_col].isNull() | (F.log1p(weight) < least))
