"""Toxicity by a weighted lexicon: texts are folded (case, look-alike letters, digits and signs used as letters), matched by one
Aho-Corasick automaton, and the evidence is normalised by length. Exception phrases cancel the matches inside them."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import sliced, text_columns, text_table

THRESHOLD = 0.3
ENTRIES = 4000
CANDIDATES = 60_000
BINS = 400
SAMPLE = 40_000
PREFIXES = range(4, 9)

# Letters of other scripts that look like Latin ones, and signs used as letters.
LOOKALIKES = str.maketrans("авсԁеһіјкӏмпорԛѕтуѵԝхαβεικνορτυχ", "abcdehijklmnopqstyvwxabeiknoptux")
SIGNS = str.maketrans("013457@$!", "oieastasi")
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "sore loser board", "idiot proof", "pond scum")
SIGN = re.compile(r"[013457@$!](?=[013457@$!]*[^\W\d_])")
WORD = re.compile(r"[^\W\d_]+")


def folded(text: str) -> list[str]:
    """Words of a text in plain lower-case letters; signs count as letters only before a letter."""
    text = text.lower().translate(LOOKALIKES)
    text = SIGN.sub(lambda m: m[0].translate(SIGNS), text)
    return WORD.findall(text)


def entries_of(words: Sequence[str]) -> set[str]:
    """Possible lexicon entries: whole words and word beginnings, with a space where a word starts or ends."""
    out = set()
    for w in set(words):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if k < len(w))
    return out


class Lexicon:
    """The automaton of weighted entries and exception phrases."""

    def __init__(self, weights: dict[str, float], exceptions: Sequence[str] = EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            words = f" {' '.join(folded(phrase))} "
            self.automaton.add_word(words, (len(words), None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def evidence(self, text: str) -> float:
        """Sum of the best weight of each matched word, a word counted up to three times, over the damped number of words."""
        words = folded(text)
        if not words or self.empty:
            return 0.0
        line = f" {' '.join(words)} "
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(line):
            start = end - size + 1
            if weight is None:
                excused.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        seen: Counter[str] = Counter()
        total = 0.0
        for start, weight in best.items():
            if any(a <= start < b for a, b in excused):
                continue
            word = line[start + 1:line.index(" ", start + 1)]
            seen[word] += 1
            if seen[word] <= 3:
                total += weight
        return total / (1.0 + math.log1p(len(words) / 100.0))


def _training(docs: DataFrame, labels: DataFrame, train: Column, sample: int) -> DataFrame:
    """(text, toxic) of about ``sample`` labelled rows of the training part, picked by a hash of the id; all of them if there are fewer.

    The picked labels, two numbers a row, have that bound too, so they are broadcast and no text is shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & train)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(picked), "doc_id").select("text", "toxic")


def _counted(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
    """Documents per entry; sums are made per task first, and handed on when they grow."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["entry", "n"])

        counts: Counter[str] = Counter()
        for batch in sliced(batches, 256):
            for text in batch.column("text").to_pylist():
                found = entries_of(folded(text or ""))
                counts.update(found if wanted is None else found & wanted)
                if len(counts) > 200_000:
                    yield out()
                    counts.clear()
        yield out()

    return rows.select("text").mapInArrow(each, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def learn_lexicon(training: DataFrame, entries: int = ENTRIES, candidates: int = CANDIDATES) -> dict[str, float]:
    """Entry to weight: the smoothed log odds of toxic documents, for entries whose tie to the label is beyond chance.

    ``candidates`` bounds the entries weighed (those in most toxic documents) and ``entries`` the lexicon (the
    strongest), so that both fit a driver and a task whatever the corpus.
    """
    totals = {r["toxic"]: r["count"] for r in training.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return {}
    least = max(4, toxic // 2000)
    tops = _counted(training.where("toxic = 1"), None).where(F.col("n") >= least).orderBy(F.desc("n"), "entry").limit(candidates).collect()
    hits = {r["entry"]: r["n"] for r in tops}
    misses = {r["entry"]: r["n"] for r in _counted(training.where("toxic = 0"), set(hits)).collect()}
    scored = []
    for entry, p in hits.items():
        n = misses.get(entry, 0)
        weight = math.log((p + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))
        expected = (p + n) * toxic / (toxic + clean)
        tie = 2 * (p * math.log(p / expected) + (n * math.log(n / (p + n - expected)) if n else 0.0))
        if weight > 1.5 and tie > 16:
            scored.append((tie, entry, weight))
    return {entry: weight for _, entry, weight in sorted(scored, reverse=True)[:entries]}


def _scorer(weights: dict[str, float], exceptions: Sequence[str]):
    def make():
        lexicon = Lexicon(weights, exceptions)
        return lambda text: (lexicon.evidence(text or ""),)

    return make


def calibrate(points: Sequence[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (evidence, toxic, clean) counts, by Newton steps on a slightly ridged likelihood."""
    if not points:
        return 1.0, -2.0
    x, p, n = (np.array(c, dtype=float) for c in zip(*points))
    a, b = 1.0, -2.0
    for _ in range(60):
        s = 1 / (1 + np.exp(-(a * x + b)))
        gap, curve = p - (p + n) * s, (p + n) * s * (1 - s)
        gradient = np.array([gap @ x - 1e-3 * a, gap.sum() - 1e-3 * b])
        h = np.array([[(curve * x * x).sum() + 1e-3, (curve * x).sum()], [(curve * x).sum(), curve.sum() + 1e-3]])
        step = np.linalg.solve(h, gradient)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = max(0.0, a + step[0]), b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: Column, exceptions: Sequence[str] = EXCEPTIONS, threshold: float = THRESHOLD,
                    sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence. Labels of held-out rows are not used.

    The lexicon and its curve are fitted on about ``sample`` labelled rows; every document is scored.

    Null and empty texts have no evidence and get the lowest score; repeated rows give repeated rows; several labels of one id count as
    toxic if one is. Without labels of both kinds every score is the same. Columns other than doc_id and text of the documents, and
    doc_id and toxic of the labels, are not read.
    """
    training = _training(docs, labels, ~held_out, sample)
    weights = learn_lexicon(training)
    scored = text_columns(training, _scorer(weights, exceptions), "e double").select("e", "doc.toxic")
    binned = scored.groupBy(F.least(F.floor(F.col("e") * 20), F.lit(BINS)).alias("bin")).agg(
        F.avg("e").alias("e"), F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).orderBy("bin").collect()
    a, b = calibrate([(r["e"], r["p"], r["n"]) for r in binned])
    rows = text_table(docs, _scorer(weights, exceptions), "evidence double").withColumn("held_out", held_out)
    score = 1 / (1 + F.exp(-(F.lit(a) * F.col("evidence") + F.lit(b))))
    return rows.withColumn("score", score).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
