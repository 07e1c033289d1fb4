"""Secrets in texts: fixed patterns, and values in a credential context that would cost an attacker many guesses.

The guess cost of a value is the cheapest segmentation into words, dates, repeats, keyboard walks and brute-force characters, found by
dynamic programming over its positions. A value whose cost reaches the bound is reported; a cheap one ("changeme") is not.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import text_columns, text_table
from pairloom.session import cut_lineage

LEAST_GUESSES = 8.0  # log10
CORPUS_WORDS = 50_000
WORD = r"(?<![:=][ \t]|[:=][ \t]?[\"']|[^\s(\"'])[a-z]{3,24}(?![^\s.,;!?)\"'])"
KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
CONTEXT = re.compile(
    r"""(?ai)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|api[_-]?key|access[_-]?key|private[_-]?key|login)"""
    r"""["']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*(?:bearer\x20+|basic\x20+)?["']?([^\s"'<>,;]{6,})""")

# Words that people put in passwords, most common first.
WORDS = """password 123456 qwerty admin welcome letmein login master secret changeme default test user guest root token example
sample dummy monkey dragon sunshine princess football baseball shadow superman batman iloveyou trustno1 abc123 hello freedom whatever
summer winter spring autumn love money company server database access private public account service backup system office school
january february march april june july august september october november december monday friday sunday please change placeholder
your here none null true false the and for you pass word key api my new old""".split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
DATE = re.compile(r"(?a)(?:(?:19|20)\d\d[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)$")
LEET = str.maketrans("013457@$!", "oleastasi")


@lru_cache(maxsize=1)
def _beside() -> set[tuple[str, str]]:
    """Pairs of neighbouring keys."""
    beside = set()
    for r, row in enumerate(ROWS):
        for c, key in enumerate(row):
            for near in (row[c + 1:c + 2], *((ROWS[r + 1][c:c + 1], ROWS[r + 1][c - 1:c] if c else "") if r + 1 < len(ROWS) else ())):
                if near:
                    beside |= {(key, near), (near, key)}
    return beside


class Dictionary:
    """Words by rank: those of ``WORDS`` first, then the given ones, most common first."""

    def __init__(self, more: Sequence[str] = ()):
        self.costs: dict[str, float] = {}
        for word in (*WORDS, *more):
            if word not in self.costs:
                self.costs[word] = math.log10(len(self.costs) + 2)
        self.longest = max(map(len, self.costs))


PLAIN = Dictionary()


def corpus_words(docs: DataFrame, most: int = CORPUS_WORDS) -> list[str]:
    """The words found in the most documents (two or more), most common first, ties in order of the word.

    A word stands between white space, brackets and marks of a sentence; one that follows a colon or an equals sign is a value and doesn't
    count, so a password that many texts repeat stays unknown. Counts cover all documents. Words are taken by classes of counts, 16 to a
    doubling, from the top as long as the classes hold at most ``most`` words together: no more than these come to the driver.
    """
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(WORD), F.lit(0)))
    counts = docs.select(F.explode(found).alias("word")).groupBy("word").count().where("count > 1")
    counts = cut_lineage(counts.withColumn("class", F.floor(16 * F.log2("count")).cast("int")), "words")
    room, least = most, None
    for r in counts.groupBy("class").agg(F.count("*").alias("words")).orderBy(F.desc("class")).collect():  # at most 1,024 rows
        room -= r["words"]
        if room < 0:
            break
        least = r["class"]
    if least is None:
        return []
    taken = counts.where(F.col("class") >= least).select("word", "count").collect()
    return [r["word"] for r in sorted(taken, key=lambda r: (-r["count"], r["word"]))]


def _cheapest(starts: list[int], end: int, best: list[float], unit: float) -> float:
    """Least best[start] + log10(length * unit) over the starts. A start that an earlier one beats is dropped: the earlier one's lead only
    grows with the length, so few starts are left and none that could win is lost."""
    least, kept = math.inf, []
    for start in starts:
        cost = best[start] + math.log10((end - start) * unit)
        if cost < least:
            least = cost
            kept.append(start)
    starts[:] = kept
    return least


def guess_cost(value: str, words: Dictionary = PLAIN) -> float:
    """log10 of the guesses for the cheapest segmentation; every segment but a brute-forced character costs a factor of two on top."""
    beside = _beside()
    low = value.lower()
    plain = low.translate(LEET)
    n = len(low)
    if len(value) != n or len(plain) != n:  # a letter whose lower case is longer
        value = plain = low
    best = [0.0] + [math.inf] * n
    walk, first = [], 0  # starts of the present keyboard walk, and its first key
    runs: dict[int, list[list[int]]] = {unit: [[] for _ in range(unit)] for unit in (1, 2, 3, 4)}
    for end in range(1, n + 1):
        cost = best[end - 1] + 1.0  # brute force: ten guesses a character
        for start in range(max(0, end - words.longest), end):
            for text, extra in ((low, 0.0), (plain, 0.3)):
                rank = words.costs.get(text[start:end])
                if rank is not None:
                    case = 0.0 if value[start:end] == low[start:end] else 0.3
                    cost = min(cost, best[start] + rank + extra + case + 0.3)
        if low[end - 1].isdigit():
            for start in range(max(0, end - 10), end - 3):
                if DATE.match(low, start, end):
                    cost = min(cost, best[start] + (2.0 if end - start == 4 else math.log10(365 * 100)) + 0.3)
        if end > 1 and (low[end - 2], low[end - 1]) not in beside:
            walk, first = [], end - 1
        if end - first >= 3:
            walk.append(end - 3)
            cost = min(cost, _cheapest(walk, end, best, 40.0) + 0.3)
        for unit, by_place in runs.items():
            starts = by_place[end % unit]
            if end >= 2 * unit and low[end - unit:end] == low[end - 2 * unit:end - unit]:
                starts.append(end - 2 * unit)
                cost = min(cost, _cheapest(starts, end, best, 1.0 / unit) + unit + 0.3)
            else:
                starts.clear()
        best[end] = cost
    return best[n]


def find_spans(text: str, least_guesses: float = LEAST_GUESSES, words: Dictionary = PLAIN) -> tuple[list[tuple[int, int, str]], int]:
    """Spans (start, end, kind) by start, then kind; and how many assigned values cost fewer guesses than the bound."""
    found: list[tuple[int, int, int]] = []
    weak = 0
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if LONG_HEX.search(text):
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                found.append((m.start(), m.end(), 0))
                weak += guess_cost(m[2], words) < least_guesses
        covered = sorted(found)
        for m in CONTEXT.finditer(text):
            start, end = m.span(1)
            if not any(a <= start and end <= b for a, b, _ in covered) and guess_cost(m[1], words) >= least_guesses:
                found.append((start, end, 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2], s[1]))], weak


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


FOUND = "n_assign long, n_access long, n_hex long, n_guess long, n_weak long, base_sha256 string, spans string"


def scan(text: str | None, least_guesses: float = LEAST_GUESSES, words: Dictionary = PLAIN) -> tuple:
    """The columns of FOUND for a text; null reads as empty."""
    spans, weak = find_spans(text or "", least_guesses, words)
    counts = [sum(k == kind for _, _, k in spans) for kind in KINDS]
    base = _listed([s for s in spans if s[2] != "guess"])
    return *counts, weak, hashlib.sha256(base.encode()).hexdigest(), _listed(spans)


def secret_spans(docs: DataFrame, least_guesses: float = LEAST_GUESSES) -> DataFrame:
    """One row per document: doc_id and the columns of ``scan``. Positions count code points, ends are exclusive.

    The dictionary is learned from the same documents (``corpus_words``). Null and empty texts have no span; repeated rows give repeated rows; columns other than doc_id and text are not read. A value that
    a base span covers is not reported again; n_weak counts base values that are cheap to guess, which stay reported.
    """
    known = corpus_words(docs)

    def scanner():
        words = Dictionary(known)
        return lambda text: scan(text, least_guesses, words)

    return text_table(docs, scanner, FOUND)


def mask(text: str, spans: list[tuple[int, int, str]], sign: str = "[secret]") -> str:
    """The text with every span replaced; overlapping spans make one."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], sign]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact_secrets(docs: DataFrame, least_guesses: float = LEAST_GUESSES) -> DataFrame:
    """The documents, all of them, with every span of their texts masked; n_chars follows where it is given. Null texts stay null."""
    known = corpus_words(docs)

    def masker():
        words = Dictionary(known)
        return lambda text: (None if text is None else mask(text, find_spans(text, least_guesses, words)[0]),)

    rows = text_columns(docs, masker, "masked string")
    fields = []
    for name, kind in docs.dtypes:
        if name == "text":
            fields.append(F.col("masked").alias(name))
        elif name == "n_chars":
            fields.append(F.coalesce(F.length("masked"), F.col("doc.n_chars")).cast(kind).alias(name))
        else:
            fields.append(F.col("doc").getField(name).alias(name))
    return rows.select(*fields)
