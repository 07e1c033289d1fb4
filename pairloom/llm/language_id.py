"""Language identification in two steps: linear machines between language families, then one-versus-one linear support vector machines
between the languages of the family that won. Features are hashed letter n-grams of the whole text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import sliced
from pairloom.session import cut_lineage

BITS = 12
SAMPLE = 800
UNKNOWN = "und"

# Families of language codes; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl".split(),
    "baltic": "lt lv".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "semitic": "ar he mt am".split(),
    "indic": "hi ur bn pa mr gu ne si".split(),
    "celtic": "ga cy gd br".split(),
    "malayic": "id ms jv su tl".split(),
}


def family_of(lang: str) -> str:
    base = lang.lower().split("-")[0].split("_")[0]
    return next((family for family, codes in FAMILIES.items() if base in codes), f"={base}")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def ngram_counts(text: str, block: int = 1 << 20) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams of lower-case letters with one space between words; None without a letter."""
    total = np.zeros(1 << BITS, dtype=np.int64)
    seen = False
    for start in range(0, len(text), block):
        codes = np.frombuffer(text[start:start + block + 2].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _letters()[codes]
        if not letter.any():
            continue
        seen = True
        codes = np.where(letter, codes, np.uint32(32))
        codes = codes[letter | np.append(True, letter[:-1])].astype(np.uint32)
        grams = codes * np.uint32(0x9E3779B1)
        total += np.bincount(grams >> np.uint32(32 - BITS), minlength=1 << BITS)
        for _ in range(2):
            if len(grams) < 2:
                break
            grams = (grams[:-1] ^ (grams[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[len(codes) - len(grams) + 1:] * np.uint32(0x9E3779B1)
            total += np.bincount(grams >> np.uint32(32 - BITS), minlength=1 << BITS)
    return total.astype(np.float32) if seen else None


def _normal(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


def train_machine(x: np.ndarray, y: np.ndarray, rounds: int = 120, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, both classes of equal weight, by accelerated gradient steps. y: 1 or -1."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    mean = share @ x
    x = x - mean
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    v, c, t = w.copy(), b, 1.0
    step = np.float32(1.0 / (ridge + 4.0))
    scale = np.float32(max(1e-6, float(share @ (x * x).sum(axis=1))))
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v + c)) * share * y
        after, offset = v - step / scale * (ridge * v - 2 * (slack @ x)), c + step * 2 * slack.sum()
        faster = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = after + np.float32((t - 1) / faster) * (after - w), offset + np.float32((t - 1) / faster) * (offset - b)
        w, b, t = after, offset, faster
    return w, float(b - w @ mean)


class Hierarchy:
    """Trained machines by task: (level, one class, the other)."""

    def __init__(self, langs: list[str], machines: dict[tuple[str, str, str], tuple[np.ndarray, float]]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(langs):
            self.families.setdefault(family_of(lang), []).append(lang)
        self.machines = machines

    def tasks(self) -> list[tuple[str, str, str]]:
        return [("family", a, b) for a, b in combinations(sorted(self.families), 2)] + [
            ("language", a, b) for members in self.families.values() for a, b in combinations(members, 2)]

    def _chances(self, x: np.ndarray, level: str, classes: list[str]) -> np.ndarray:
        """Share of the pairwise votes per class, a vote counting by its margin; rows sum to one."""
        if len(classes) == 1:
            return np.ones((len(x), 1))
        votes = np.zeros((len(x), len(classes)))
        for i, j in combinations(range(len(classes)), 2):
            w, b = self.machines[(level, classes[i], classes[j])]
            sure = 1 / (1 + np.exp(-np.clip(4.0 * (x @ w + b), -30, 30)))
            votes[:, i] += sure
            votes[:, j] += 1 - sure
        return votes * 2 / (len(classes) * (len(classes) - 1))

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        x, names = _normal(counts), sorted(self.families)
        chances = self._chances(x, "family", names)
        pick = chances.argmax(axis=1)
        langs, score = np.full(len(x), "", dtype=object), chances.max(axis=1)
        for k, family in enumerate(names):
            mine = np.flatnonzero(pick == k)
            if len(mine):
                inner = self._chances(x[mine], "language", self.families[family])
                langs[mine] = np.array(self.families[family], dtype=object)[inner.argmax(axis=1)]
                score[mine] *= inner.max(axis=1)
        return langs.tolist(), score


def train_hierarchy(docs: DataFrame, train: Column, sample: int = SAMPLE) -> Hierarchy:
    """Machines from the rows of ``train`` with a language: about ``sample`` rows of each language, picked by a hash of the id.

    Each machine is trained in a task of its own; what comes to the driver is one weight vector per machine.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return Hierarchy([], {})
    share = F.create_map(*(F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, sample / n))))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.where(place < share[F.col("lang")])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts = [(lang, ngram_counts(t)) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())]
            counts = [(lang, c.astype("<f4").tobytes()) for lang, c in counts if c is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in counts], pa.string()), pa.array([x[1] for x in counts], pa.binary())], ["lang", "counts"])

    sampled = cut_lineage(picked.select("lang", "text").mapInArrow(features, "lang string, counts binary"), "sample")
    model = Hierarchy([r["lang"] for r in sampled.select("lang").distinct().collect()], {})
    tasks = model.tasks()
    if not tasks:
        return model
    sides = [(k, lang, 1 if (family_of(lang) if level == "family" else lang) == a else -1)
             for k, (level, a, b) in enumerate(tasks) for members in model.families.values() for lang in members
             if (family_of(lang) if level == "family" else lang) in (a, b)]
    table = docs.sparkSession.createDataFrame(sides, "task int, lang string, side int")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["lang", "counts"])
        x = _normal(np.frombuffer(b"".join(frame["counts"]), dtype="<f4").reshape(len(frame), -1))
        w, b = train_machine(x, frame["side"].to_numpy(np.float32))
        return pd.DataFrame({"task": [frame["task"].iloc[0]], "weights": [w.astype("<f4").tobytes()], "offset": [b]})

    fitted = sampled.join(F.broadcast(table), "lang").groupBy("task").applyInPandas(fit, "task int, weights binary, offset double")
    for r in fitted.collect():
        model.machines[tasks[r["task"]]] = np.frombuffer(r["weights"], dtype="<f4"), r["offset"]
    return model


def predict_languages(docs: DataFrame, model: Hierarchy, held_out: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score). Null texts and texts without a letter are ``und`` with score 0."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts = [ngram_counts(t) if t and model.families else None for t in batch.column("text").to_pylist()]
            known = [i for i, c in enumerate(counts) if c is not None]
            langs, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            if known:
                for i, lang, score in zip(known, *model.predict(np.stack([counts[i] for i in known]))):
                    langs[i], scores[i] = lang, float(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(each, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """Train on the rows that aren't held out, predict every row.

    Repeated rows give repeated rows; without any labelled text every row is ``und``; columns other than doc_id, text and lang are not read,
    and lang only where a row is for training.
    """
    return predict_languages(docs, train_hierarchy(docs, ~held_out, sample), held_out)
