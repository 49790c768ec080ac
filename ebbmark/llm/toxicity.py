"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding brings characters to their compatible forms (NFKC), lowers letters, maps look-alike letters of other scripts and
digits used as letters to plain ones, drops invisible characters and marks that belong to no letter, and turns punctuation
into spaces; letters that one separator keeps apart come together as one word. Texts are matched with their accents, as
these tell words of many languages apart, and once more without them. Lexicon terms are beginnings of words and whole words; each weighs the log odds of toxic
against other training documents that hold it. Exception phrases are learned too: pairs of words whose one word matches a
term, but which are beyond chance among documents that aren't toxic; others can be passed in. A match inside an exception
phrase doesn't count. A document's score comes from its strongest match and from the sum of its matches divided by the root
of its length.

Training takes labelled rows alone: at most SAMPLE different ones, the first by a hash of the key; near copies count once. The
lexicon learns on four parts of five of them and the two score coefficients on the fifth; then the lexicon learns on all.
Null labels are no labels. With no labelled rows of both classes the lexicon is empty and every score is the prior.
Null and empty texts get the score of a text without matches; repeated rows are scored alike, and texts of any length as a
whole, in time linear in length and matches. Columns that are called as the score are replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import shingles
from .shared import arrays, map_batches, text_of, written

#: Labelled rows to train on, at most.
SAMPLE = 30_000
#: Rows that are in Python at once, and whose terms are counted there before Spark adds them up.
COUNTED = 256
#: Lengths of word beginnings that can be terms.
SHORT, LONG = 4, 8

# Letters that look like Latin ones, digits and signs written for letters, and characters that aren't seen.
ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l", "ſ": "s",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}
UNSEEN = "­​‌‍⁠﻿"
MARKS = "\t\n\v\f\r!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~«»“”‘’„–—…¿¡·•"
_FOLD = {ord(k): v for k, v in ALIKE.items()} | {ord(c): None for c in UNSEEN} | {ord(c): " " for c in MARKS}
_WORD = re.compile(r"[^\W_]+")
_APART = re.compile(r"(?<!\w)\w([ .\-*/+~|])\w(?:\1\w)+(?!\w)")


def _without_marks(text: str) -> str:
    return "".join([c for c in text if not unicodedata.combining(c)])


def fold(text: str, plain: bool = False) -> str:
    """With one space before, behind and between words. plain: without accents."""
    if not text.isascii():
        text = _without_marks(unicodedata.normalize("NFKC", text))
        if plain:
            text = unicodedata.normalize("NFC", _without_marks(unicodedata.normalize("NFD", text)))
    text = _APART.sub(lambda m: m[0].replace(m[1], ""), text.lower())
    return f" {' '.join(text.translate(_FOLD).split())} "


@dataclass
class Lexicon:
    """terms: a term begins with a space; one that ends with a space is a whole word."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    strongest: float = 1.5
    spread: float = 0.5
    bias: float = -4.0

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.terms:
            return None
        a = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            a.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            a.add_word(fold(phrase), (len(fold(phrase)), None))
        a.make_automaton()
        return a


def signals(text: str, automaton: ahocorasick.Automaton | None) -> tuple[float, float]:
    """The largest weight, and the sum of weights over the root of the number of hundred characters. Of the terms that match at one place, the heaviest counts."""
    if automaton is None:
        return 0.0, 0.0
    at: dict[int, float] = {}
    harmless = []
    for folded in (fold(text),) if text.isascii() else (fold(text), fold(text, plain=True)):
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                harmless.append((start, end))
            elif weight > at.get(start, 0.0):
                at[start] = weight
    if harmless:  # both in order of their starts: one pass
        harmless.sort()
        k, reach, kept = 0, -1, {}
        for start in sorted(at):
            while k < len(harmless) and harmless[k][0] <= start:
                reach, k = max(reach, harmless[k][1]), k + 1
            if start >= reach:
                kept[start] = at[start]
        at = kept
    if not at:
        return 0.0, 0.0
    return max(at.values()), sum(at.values()) / math.sqrt(1.0 + len(text) / 100)


def probability(lexicon: Lexicon, strongest: float, spread: float) -> float:
    z = lexicon.bias + lexicon.strongest * strongest + lexicon.spread * spread
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(text: str) -> set[str]:
    words = set(_WORD.findall(fold(text)))
    return {f" {w[:k]}" for w in words for k in range(SHORT, min(LONG, len(w)) + 1)} | {f" {w} " for w in words if len(w) > 1}


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> DataFrame:
    """(part, label, text) of a sample of labelled rows, near copies once. part: 4 for the rows that fit the coefficients."""
    known = labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("__key"), F.col(label).cast("int").alias("label"))
    known = written(known.distinct().orderBy(F.xxhash64("__key"), "__key", "label").limit(sample))
    rows = docs.select(F.col(key).alias("__key"), text_of(text).alias("text")).join(known, "__key").distinct()
    rows = written(rows.withColumn("__text", F.xxhash64("text")))
    if rows.count() > sample:  # keys with several texts
        by = ["__key", "label", "__text"]
        rows = rows.join(rows.select(*by).orderBy(F.xxhash64("__key"), *by).limit(sample), by, "left_semi")
    types = {"mark": pa.int64(), "label": pa.int32(), "text": pa.string()}

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = []
        for x in batch.column("text").to_pylist():
            found = shingles(x)
            marks.append(int(found[0] >> np.uint64(1)) if len(found) else 0)
        return arrays(types, {"mark": marks, "label": batch.column("label").to_pylist(), "text": batch.column("text").to_pylist()})

    marked = map_batches(rows.select("label", "text"), mark, "mark long, label int, text string", COUNTED)
    return written(marked.dropDuplicates(["mark", "label"]).withColumn("part", F.pmod(F.xxhash64("mark"), F.lit(5))))


def _counts(rows: DataFrame) -> DataFrame:
    """(term, a, b, c, d): documents with a term, for all terms of toxic documents: toxic and others outside part 4, toxic and others in it."""
    types = {"term": pa.string(), "fit": pa.bool_(), "label": pa.int32(), "n": pa.int64()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n: Counter = Counter()
        for part, label, x in zip(*(batch.column(c).to_pylist() for c in ("part", "label", "text")), strict=True):
            n.update((t, part == 4, label) for t in _terms(x))
        return arrays(types, {"term": [k[0] for k in n], "fit": [k[1] for k in n], "label": [k[2] for k in n], "n": list(n.values())})

    cell = lambda fit, label: F.sum(F.when((F.col("fit") == fit) & (F.col("label") == label), F.col("n")).otherwise(0))
    found = map_batches(rows.select("part", "label", "text"), run, "term string, fit boolean, label int, n long", COUNTED)
    table = found.groupBy("term").agg(cell(False, 1).alias("a"), cell(False, 0).alias("b"), cell(True, 1).alias("c"), cell(True, 0).alias("d"))
    return written(table.filter("a + c > 0"))


def _floor(held: dict[int, int], toxic: int, prior: float) -> tuple[int, float]:
    """The least number of toxic documents with which a term can be beyond chance, and the log likelihood ratio it needs among the terms that reach it. held: terms by their number of toxic documents."""
    many = sum(held.values())
    for least in range(1, toxic + 1):
        need = math.log(max(2, many)) + 2
        if least * -math.log(prior) >= need:
            return least, need
        many -= held.get(least, 0)
    return toxic + 1, math.inf


def _beyond_chance(table: DataFrame, p: str, n: str, toxic: int, clean: int) -> dict[str, float]:
    """Terms whose share of toxic documents is beyond chance among all that can be, with their log odds. p, n: SQL for a term's toxic and other documents."""
    if not toxic or not clean:
        return {}
    prior, counted = toxic / (toxic + clean), table.selectExpr("term", f"{p} AS p", f"{n} AS n").filter("p > 0")
    least, need = _floor({r["p"]: r["count"] for r in counted.groupBy("p").count().collect()}, toxic, prior)
    if least > toxic:
        return {}
    rate = F.col("p") / (F.col("p") + F.col("n"))
    ratio = F.col("p") * F.log(rate / prior) + F.when(F.col("n") > 0, F.col("n") * F.log((1 - rate) / (1 - prior))).otherwise(0.0)
    weight = F.log((F.col("p") + 0.5) / (toxic + 1)) - F.log((F.col("n") + 0.5) / (clean + 1))
    passed = counted.filter((F.col("p") >= least) & (rate > prior) & (ratio >= need) & (weight > 1))
    return {r["term"]: r["weight"] for r in passed.select("term", weight.alias("weight")).collect()}


def _choose(weights: dict[str, float]) -> dict[str, float]:
    """Of the terms beyond chance, a longer one only where it says more than its beginnings."""
    chosen: dict[str, float] = {}
    for term, weight in sorted(weights.items(), key=lambda x: (len(x[0]), x[0])):
        if not any(chosen.get(term[:k], 0.0) >= weight - 0.7 for k in range(SHORT + 1, len(term))):
            chosen[term] = weight
    return dict(sorted(chosen.items(), key=lambda x: (-x[1], x[0])))


def _pairs(rows: DataFrame, terms: dict[str, float]) -> DataFrame:
    """(phrase, a, b): pairs of neighbouring words of which one matches a term, with the toxic and the other documents that hold them."""
    types = {"phrase": pa.string(), "label": pa.int32(), "n": pa.int64()}
    lexicon = Lexicon(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            for a in range(0, batch.num_rows, COUNTED):
                part, n = batch.slice(a, COUNTED), Counter()
                for label, x in zip(part.column("label").to_pylist(), part.column("text").to_pylist(), strict=True):
                    folded = fold(x)
                    starts = {end - length + 1 for end, (length, _) in automaton.iter(folded)}
                    found = set()
                    for start in starts:
                        before, end = folded.rfind(" ", 0, start), folded.find(" ", start + 1)
                        behind = folded.find(" ", end + 1)
                        if before >= 0:
                            found.add(folded[before : end + 1])
                        if behind >= 0:
                            found.add(folded[start : behind + 1])
                    n.update((phrase, label) for phrase in found)
                yield arrays(types, {"phrase": [k[0] for k in n], "label": [k[1] for k in n], "n": list(n.values())})

    found = rows.select("label", "text").mapInArrow(run, "phrase string, label int, n long")
    cell = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    return found.groupBy("phrase").agg(cell(1).alias("a"), cell(0).alias("b"))


def learned_exceptions(rows: DataFrame, terms: dict[str, float], toxic: int, clean: int) -> tuple[str, ...]:
    """Phrases around a term that clean documents hold beyond chance: their log likelihood ratio against the share of clean documents passes the test of all such phrases. Counted in Spark; only those that pass reach the driver."""
    if not terms or not toxic or not clean:
        return ()
    prior, counted = clean / (toxic + clean), written(_pairs(rows, terms))
    need = math.log(max(2, counted.count())) + 2
    rate = F.col("b") / (F.col("a") + F.col("b"))
    ratio = F.col("b") * F.log(rate / prior) + F.when(F.col("a") > 0, F.col("a") * F.log((1 - rate) / (1 - prior))).otherwise(0.0)
    return tuple(sorted(r["phrase"] for r in counted.filter("b > 0").filter((rate > prior) & (ratio >= need)).select("phrase").collect()))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from labelled rows. labels: key and label (1 toxic, 0 not). exceptions: phrases to add to the learned ones."""
    rows = training_rows(docs, labels, key, text, label, sample)
    n_rows = {(r["fit"], r["label"]): r["n"] for r in rows.groupBy((F.col("part") == 4).alias("fit"), "label").agg(F.count("*").alias("n")).collect()}
    table = _counts(rows)
    fit, rest = (lambda y: n_rows.get((True, y), 0)), (lambda y: n_rows.get((False, y), 0))
    trial = Lexicon(_choose(_beyond_chance(table, "a", "b", rest(1), rest(0))), exceptions)
    final = Lexicon(_choose(_beyond_chance(table, "a + c", "b + d", rest(1) + fit(1), rest(0) + fit(0))), exceptions)
    trial.exceptions = (*exceptions, *learned_exceptions(rows.filter("part <> 4"), trial.terms, rest(1), rest(0)))
    final.exceptions = (*exceptions, *learned_exceptions(rows, final.terms, rest(1) + fit(1), rest(0) + fit(0)))
    if fit(1) >= 5 and fit(0) >= 5:
        points = _points(rows.filter("part = 4"), trial)
        final.bias, final.strongest, final.spread = _logistic(points[:, :2], points[:, 2])
    elif not final.terms and (n := sum(n_rows.values())):
        share = min(max((rest(1) + fit(1)) / n, 1e-3), 1 - 1e-3)
        final.bias = math.log(share / (1 - share))
    return final


def _points(rows: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """The two signals and the label of each row; texts stay with the tasks."""
    types = {"x": pa.float64(), "y": pa.float64(), "label": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [signals(x, automaton) for x in batch.column("text").to_pylist()]
            yield arrays(types, {"x": [p[0] for p in found], "y": [p[1] for p in found], "label": [float(n) for n in batch.column("label").to_pylist()]})

    found = rows.select("label", "text").mapInArrow(run, "x double, y double, label double").collect()  # three numbers for each row of the bounded sample
    return np.array(sorted(tuple(r) for r in found))


def _logistic(x: np.ndarray, y: np.ndarray, strength: float = 0.01) -> tuple[float, float, float]:
    """Bias and two coefficients that aren't negative, by Newton steps with a small penalty."""
    for use in ((0, 1), (0,), ()):
        a = np.column_stack((np.ones(len(y)), *(x[:, k] for k in use)))
        w = np.zeros(a.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + strength * np.eye(len(w)), a.T @ (y - p) - strength * w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        if (w[1:] >= 0).all():
            out = [float(w[0]), 0.0, 0.0]
            for k, v in zip(use, w[1:], strict=True):
                out[1 + k] = float(v)
            return tuple(out)
    return float(w[0]), 0.0, 0.0


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", column: str = "toxicity") -> DataFrame:
    """docs with a score from 0 to 1; a column of that name is replaced."""
    kept = docs.select(*[c for c in docs.columns if c != column])

    def run(batches):
        automaton = lexicon.automaton()
        for whole in batches:
            for a in range(0, whole.num_rows, COUNTED):
                batch = whole.slice(a, COUNTED)
                new = pa.array([probability(lexicon, *signals(x or "", automaton)) for x in batch.column(text).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, column])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{column}` double"])
    return kept.mapInArrow(run, schema)
