"""How text filters interact: what each removes in every order, with exact copies found in tries over ranges of text prefixes."""

from __future__ import annotations

import re
from bisect import bisect_right
from hashlib import blake2b
from itertools import accumulate, permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = re.compile(rb"[#$%&*|]")
ROWS = pa.schema([("trie", pa.int32()), ("text", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])
ROWS_DDL = "trie int, text binary, doc_id long, part string, mask int, n long"


def text_mask(data: bytes) -> int:
    """Failures of the filters that look at one text (UTF-8): A few words, B repeated words, C capitals, D symbols."""
    words = data.split()  # bytes split at exactly space and 9 to 13
    capitals, points = len(data.translate(None, NOT_UPPER)), len(data.translate(None, CONTINUATION))
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * capitals > 10 * points) << 2 | bool(SYMBOLS.search(data)) << 3


class Holders:
    """The smallest id seen of one text, and how many rows by part have it."""

    __slots__ = ("least", "mask", "parts")

    def __init__(self):
        self.least, self.mask, self.parts = None, 0, {}

    def add(self, doc_id: int, part: str, mask: int, n: int, out: list) -> None:
        """Take a row in; rows that are copies of a smaller id by now go to ``out`` with their flag."""
        if self.least is None or doc_id < self.least:
            out.extend((self.least, p, self.mask | COPY, k) for p, k in self.parts.items())
            self.least, self.mask, self.parts = doc_id, mask, {part: n}
        elif doc_id == self.least:
            self.parts[part] = self.parts.get(part, 0) + n
        else:
            out.append((doc_id, part, mask | COPY, n))


class Node:
    """A node of a compressed trie: the bytes on the edge into it, its children by first byte, and its holders if a text ends here."""

    __slots__ = ("edge", "children", "held")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.held = edge, {}, None


class Trie:
    def __init__(self):
        self.root = Node(b"")

    def holders(self, text: bytes) -> Holders:
        """Holders at the text's terminal, which is made if it is new."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
            elif not text.startswith(child.edge, at):
                low, high = 1, min(len(child.edge), len(text) - at)  # longest common part by halving
                while low < high:
                    half = (low + high + 1) // 2
                    low, high = (half, high) if text.startswith(child.edge[:half], at) else (low, half - 1)
                fork = node.children[text[at]] = Node(child.edge[:low])
                fork.children[child.edge[low]] = child
                child.edge, child = child.edge[low:], fork
            node, at = child, at + len(child.edge)
        if node.held is None:
            node.held = Holders()
        return node.held

    def terminals(self):
        below = [self.root]
        while below:
            node = below.pop()
            if node.held is not None:
                yield node.held
            below.extend(node.children.values())


class Ranges:
    """Which trie a text belongs to: a range between adaptive prefixes, and a slice of it by digest where the range is heavy."""

    def __init__(self, prefixes: list[bytes], tries: int, most: int):
        prefixes = sorted(prefixes)
        cuts = []
        for i in range(1, min(tries, most)):
            at = i * len(prefixes) // min(tries, most)
            if at and prefixes[at - 1] < prefixes[at]:
                low, high = prefixes[at - 1], prefixes[at]
                size = next(k for k in range(1, len(high) + 1) if high[:k] > low)  # the shortest prefix that tells them apart
                cuts.append(high[:size])
        self.cuts = sorted(set(cuts))
        weights = [0] * (len(self.cuts) + 1)
        for p in prefixes:
            weights[bisect_right(self.cuts, p)] += 1
        self.slices = [max(1, round(w * tries / max(1, len(prefixes)))) for w in weights]
        self.first = [0, *accumulate(self.slices)]
        self.total = self.first.pop()

    def trie(self, text: bytes, digest: bytes) -> int:
        r = bisect_right(self.cuts, text)
        return self.first[r] + int.from_bytes(digest[:8], "little") % self.slices[r]


def adaptive_ranges(texts: Column, docs: DataFrame, trie_bytes: int = 32 << 20, most: int = 1 << 14, prefix: int = 64) -> Ranges:
    """Ranges of about ``trie_bytes`` of text each, from a sample of distinct texts.

    The sample holds some eight prefixes a range and is taken by hash, so copies count once and a retry gives the same. There are at
    most ``most`` ranges, each cut as short as tells its neighbours apart; what is left too large (many texts with one long beginning)
    is cut into slices by digest, so the broadcast stays below a few megabytes whatever the data. The sample decides where rows go,
    never what comes out.
    """
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(texts)), F.lit(0)).alias("bytes")).first()
    tries = max(1, -(-size["bytes"] // trie_bytes))
    every = max(1, size["n"] // (8 * min(tries, most)))
    h = F.xxhash64(texts)
    sample = docs.where(F.pmod(h, F.lit(every)) == 0).select(h.alias("h"), F.substring(texts, 1, prefix).alias("p")).distinct()
    return Ranges([r["p"].encode() for r in sample.select("p").collect()] if tries > 1 else [], tries, most)


def _batches(rows: list[tuple], size: int = 4096):
    for i in range(0, len(rows), size):
        columns = zip(*rows[i:i + size])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROWS)], schema=ROWS)


def _combined(docs: DataFrame, ranges: Ranges, window: int = 32 << 20) -> DataFrame:
    """Masks of all rows. Copies inside a window of distinct texts are settled here, so of a text one row a window and part is sent on;
    settled rows carry no text and are spread over all tries."""

    def flush(pending: dict) -> list[tuple]:
        return [(ranges.trie(text, digest), text, held.least, part, held.mask, n)
                for digest, (text, held) in pending.items() for part, n in held.parts.items()]

    def each(batches):
        pending, held_bytes, turn = {}, 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                cut, out, done = batch.slice(start, 256), [], []
                for doc_id, part, data in zip(cut.column("doc_id").to_pylist(), cut.column("part").to_pylist(), cut.column("text")):
                    text = data.as_py()
                    digest = blake2b(text, digest_size=16).digest()
                    have = pending.get(digest)
                    mask = have[1].mask if have else text_mask(text)
                    if doc_id is None:
                        done.append((None, part, mask, 1))
                        continue
                    if have is None:
                        have = pending[digest] = (text, Holders())
                        held_bytes += len(text) + 200
                    have[1].add(doc_id, part, mask, 1, done)
                for row in done:
                    turn += 1
                    out.append((turn % ranges.total, None, *row))
                if held_bytes > window:
                    out += flush(pending)
                    pending, held_bytes = {}, 0
                yield from _batches(out, 512)
        yield from _batches(flush(pending), 512)

    return docs.mapInArrow(each, ROWS_DDL)


def _flagged(rows: DataFrame) -> DataFrame:
    """Insert the texts of each range into a trie; rows above a terminal's least id get the copy flag."""

    def each(batches):
        trie = Trie()
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("text", "doc_id", "part", "mask", "n"))):
                if row[0] is None:
                    out.append(row[1:])
                else:
                    trie.holders(row[0]).add(*row[1:], out)
            yield from _batches([(None, None, *r) for r in out])
        rest = []
        for held in trie.terminals():
            rest += [(None, None, held.least, part, held.mask, n) for part, n in held.parts.items()]
            if len(rest) > 4096:
                yield from _batches(rest)
                rest = []
        yield from _batches(rest)

    return rows.mapInArrow(each, ROWS_DDL).select("doc_id", "part", "mask", "n")


def filter_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): which of the filters fail, as bits A=1 to E=16, for ``n`` equal rows.

    A: under 100 words; B: distinct words below 80 %; C: capitals A-Z above 10 % of the code points; D: any of ``#$%&*|``; E: the text of
    a smaller doc_id. Null texts are empty, null langs the empty part. A null id is neither a copy nor the first of copies; repeated rows
    of one id are not copies of each other. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = adaptive_ranges(F.col("text"), rows.select("text"))
    moved = _combined(rows.withColumn("text", F.col("text").cast("binary")), ranges)
    return _flagged(moved.repartitionById(ranges.total, F.col("trie")))


def _orders() -> Column:
    """Every order of the filters and step, with the bits of the filters before it and its own."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for i, letter in enumerate(order):
            own = 1 << FILTERS.index(letter)
            steps.append((before, own, "".join(order), i + 1))
            before |= own
    return F.from_json(F.lit("[" + ",".join(f'{{"before":{b},"own":{o},"filter_order":"{s}","step":{i}}}' for b, o, s, i in steps) + "]"),
                       "array<struct<before:int,own:int,filter_order:string,step:int>>")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of each order, per part; see ``filter_masks`` for the filters and odd rows.

    Masks meet the labels (of repeated label rows any 1 counts) as narrow rows, aggregated by id first; then only counts per part and mask
    are left, and every order is read off the 32 masks of a part.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    masks = filter_masks(docs).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    cells = masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("bad", F.lit(0))).alias("bad"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("cells"))  # at most 32
    before, own = F.col("before"), F.col("own")

    def total(keep, field: str) -> Column:
        return F.aggregate(F.filter("cells", keep), F.lit(0).cast("long"), lambda s, c: s + c.getField(field))

    def fails(c) -> Column:
        return (c.getField("mask").bitwiseAND(own) != 0)

    def gone(c) -> Column:
        return (c.getField("mask").bitwiseAND(before) != 0)

    steps = parts.select("part", "cells", F.explode(_orders()).alias("o")).select("part", "cells", "o.*").select(
        "part", "filter_order", "step", "own",
        total(lambda c: c.getField("mask").bitwiseAND(before.bitwiseOR(own)) == 0, "n").alias("kept"),
        total(lambda c: fails(c) & ~gone(c), "n").alias("removed"),
        total(lambda c: fails(c) & gone(c), "n").alias("redundant"),
        total(lambda c: c.getField("mask") == own, "n").alias("unique_fails"),
        total(lambda c: fails(c) & ~gone(c), "good").alias("good_lost"),
        total(lambda c: fails(c) & ~gone(c), "bad").alias("toxic_lost"))
    shares = steps.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return steps.join(shares, ["part", "own"]).drop("own")
