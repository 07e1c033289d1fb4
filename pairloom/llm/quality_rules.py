"""Weak supervision of text quality: rules vote good or bad or abstain, expectation-maximisation estimates how far each is right, and
a document is kept by its posterior probability of being good."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import text_columns, text_table
from pairloom.session import cut_lineage

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
BANGS = re.compile(r"!!")
RULES = ("symbols", "symbol_words", "plain_words", "letters", "sentences", "dup_lines", "repeats", "capitals", "shouting", "distinct")
PLAIN = re.compile(rb"(?<![^ \t-\r])[A-Za-z\x80-\xff]+[.,;:!?]?(?![^ \t-\r])")
ENDS = re.compile(rb"[.!?](?![^ \t-\r])")
UPPER = bytes(range(65, 91))
NO_LETTER = bytes(b for b in range(128) if not chr(b).isalpha())
SYMBOL_BYTES = SYMBOLS.encode()
KEEP = 0.5
WINDOW = 256


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    size = len(number)
    pairs = ids[:-1] * size + ids[1:]
    if size >= 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * size + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= twice
    return int(covered.sum())


def distinct_share(words: list[bytes], window: int = WINDOW) -> float:
    """Distinct words, counted window by window, as a share of all words, so that a long text is judged like a short one."""
    return sum(len(set(words[i:i + window])) for i in range(0, len(words), window)) / len(words)


def signals(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the rules' votes as text: g, b or -."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup_lines = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    if not n:
        return n, chars, symbols, dup_lines, repeat, "-" * len(RULES)

    letters = len(raw.translate(None, NO_LETTER))
    upper = len(raw) - len(raw.translate(None, UPPER))
    size = sum(map(len, words))
    marked = sum(1 for w in words if w.translate(None, SYMBOL_BYTES) != w) if symbols else 0
    plain = len(PLAIN.findall(raw)) / n
    ends = len(ENDS.findall(raw)) / n
    capitals = upper / max(1, letters)
    votes = (
        "b" if symbols / n >= 0.1 else "-",
        "b" if marked / n >= 0.15 else "-",
        "g" if plain >= 0.9 else "b" if plain <= 0.65 else "-",
        "g" if letters / size >= 0.95 else "b" if letters / size <= 0.9 else "-",
        "g" if 0.01 <= ends <= 0.3 and 0.001 <= capitals <= 0.15 else "-",
        "b" if dup_lines >= 0.3 * len(lines) and dup_lines > 1 else "-",
        "b" if repeat >= 0.4 * n else "g" if repeat <= 0.1 * n and n >= 50 else "-",
        "b" if capitals >= 0.4 else "-",
        "b" if len(BANGS.findall(text)) / n >= 0.1 else "-",
        "b" if distinct_share(words) <= 0.2 else "-",
    )
    return n, chars, symbols, dup_lines, repeat, "".join(votes)


SIGNALS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes string"


def _signals():
    return lambda text: signals(text or "")


def label_model(patterns: list[str], counts: list[int], rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good per vote pattern, accuracy per rule), by expectation-maximisation over all documents.

    A rule that votes is right with its accuracy, whatever the class; an abstention says nothing. Rules are taken as independent given
    the class and as better than a coin (0.55 to 0.98), which keeps good from trading places with bad. Accuracies start at 0.8.
    """
    if not patterns:
        return np.zeros(0), np.full(len(RULES), 0.8)
    good = np.array([[v == "g" for v in p] for p in patterns], dtype=float)
    bad = np.array([[v == "b" for v in p] for p in patterns], dtype=float)
    n = np.array(counts, dtype=float)
    accuracy, prior, posterior = np.full(good.shape[1], 0.8), 0.5, np.zeros(len(n))
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + (good - bad) @ np.log(accuracy / (1 - accuracy))
        share = 1 / (1 + np.exp(-odds))
        moved, posterior = np.abs(share - posterior).max(), share
        right = (n * share) @ good + (n * (1 - share)) @ bad
        votes = n @ (good + bad)
        accuracy = np.clip((right + 0.8) / (votes + 1), 0.55, 0.98)
        prior = float(np.clip(n @ share / n.sum(), 0.05, 0.95))
        if moved < 1e-9:
            break
    return posterior, accuracy


def posteriors(votes: DataFrame) -> DataFrame:
    """(votes, posterior) of a table with a column ``votes``; at most 3 to the number of rules rows, however many documents."""
    rows = votes.groupBy("votes").count().orderBy("votes").collect()
    chance, _ = label_model([r["votes"] for r in rows], [r["count"] for r in rows])
    return votes.sparkSession.createDataFrame([(r["votes"], float(p)) for r, p in zip(rows, chance)], "votes string, posterior double")


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior, votes.

    Null and empty texts have no word and fail; repeated rows give repeated rows and count as often in the estimates; an empty table
    gives an empty table. Columns other than doc_id and text are not read.
    """
    found = cut_lineage(text_table(docs, _signals, SIGNALS), "signals")
    judged = found.join(F.broadcast(posteriors(found.select("votes"))), "votes")
    return judged.withColumn("base_failed", _failed()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("posterior") >= KEEP)).alias("kept"), "posterior", "votes")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass the base rules and whose posterior is at least one half, with all their columns."""
    votes = cut_lineage(text_table(docs, _signals, SIGNALS).select("votes"), "votes")
    judged = text_columns(docs, _signals, SIGNALS).join(F.broadcast(posteriors(votes)), "votes")
    return judged.where(~_failed() & (F.col("posterior") >= KEEP)).select("doc.*")
