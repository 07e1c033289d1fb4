"""Packing of tokenized documents into sequences: best-fit decreasing, then a swap-based local search between underfull sequences."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import sliced, texts_of
from pairloom.session import cut_lineage

CAPACITY = 2048
BLOCK_ROWS = 20_000
REMEMBERED = 400_000
MARK = "|"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class WordIds:
    """Token ids of texts by a tokenizers file that drops white space: chunks between white space, and words before ASCII signs other
    than the apostrophe, are encoded once per worker and remembered in two generations of bounded size: when the younger is full it becomes
    the older one, and what is met again moves back, so common chunks stay.

    No pre-token of such a file spans these borders, so the chunks' ids joined are the ids of the text.
    """

    chunks = re.compile(r"[^\W\d_]++(?=[!-&(-/:-@\[-`{-~])|[^ \t-\r]+")

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    def _learn(self, new: list[str]) -> None:
        """Encode chunks, many to a call with a sign between them whose id tells where one ends; where that fails, one by one."""
        alone = new
        if len(self.mark) == 1:
            groups = [new[i:i + 256] for i in range(0, len(new), 256)]
            alone = []
            for group, encoded in zip(groups, self.tokenizer.encode_batch_fast([f" {MARK} ".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(encoded.ids, dtype="<u4")
                ends = np.flatnonzero(ids == self.mark[0])
                if len(ends) != len(group) - 1:  # a chunk that has the sign itself
                    alone += group
                    continue
                body, start = ids.tobytes(), 0
                for c, end in zip(group, [*(4 * ends).tolist(), len(body)]):
                    self.known[c] = body[start:end]
                    start = end + 4
        for c, encoded in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            self.known[c] = np.array(encoded.ids, dtype="<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids per text as little-endian unsigned 32-bit numbers."""
        cut = [self.chunks.findall(t) for t in texts]
        new = []
        for c in {c for chunks in cut for c in chunks}.difference(self.known):
            if c in self.older:
                self.known[c] = self.older[c]
            else:
                new.append(c)
        self._learn(new)
        out = [b"".join(map(self.known.__getitem__, chunks)) for chunks in cut]
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


def document_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and the id 0, cut only where longer than ``capacity``.

    Null and empty texts are the id 0 alone.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer_path)
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_batch(list(texts_of(batch)))):
                ids += b"\0\0\0\0"
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start:start + 4 * capacity]
                    rows.append((doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: members of each bin. Bins are stacked by room left, and a bit per room finds the tightest."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fitting = rooms >> lengths[i]
        if fitting:
            room = lengths[i] + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= lengths[i]
        if not by_room[room]:
            rooms |= 1 << room
        by_room[room].append(b)
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int, tries: int = 5_000, near: int = 256, most: int = 64) -> list[list[int]]:
    """Move documents, or exchange one for one, two for one and one for two, so that the squared fill grows, until bins empty.

    The donor is the emptiest bin that still has an exchange; it takes the one that moves most. ``near`` bounds the bins looked at for
    one exchange (those with the most room), ``most`` the donor's documents, ``tries`` the exchanges of a block: bounds of the search only,
    every document stays placed. It stops early when no packing can have fewer bins.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    alive = sum(1 for f in fill if f)
    stuck: set[int] = set()
    under = {b for b, f in enumerate(fill) if 0 < f < capacity}
    while alive > least and len(under) > 1 and tries > 0:
        donors = [b for b in under if b not in stuck]
        if not donors:
            break
        a = min(donors, key=lambda b: (fill[b], b))
        tries -= 1
        others = sorted((b for b in under if b != a), key=lambda b: (fill[b], b))[:near]
        y = [(i, b) for b in others for i in bins[b]]
        y_len = np.array([lengths[i] for i, _ in y])
        y_fill = np.array([fill[b] for _, b in y])
        pairs_y = [(i, j, b) for b in others for k, i in enumerate(bins[b][:most]) for j in bins[b][k + 1:most]][:20_000]
        mine = sorted(bins[a], key=lambda i: (-lengths[i], i))[:most]
        gives = [(i,) for i in mine] + [(i, j) for k, i in enumerate(mine) for j in mine[k + 1:]][:512]
        best, pick = 0, None
        pair_len = np.array([lengths[i] + lengths[j] for i, j, _ in pairs_y])
        pair_fill = np.array([fill[b] for _, _, b in pairs_y])
        other_fill = np.array([fill[b] for b in others])
        for give in gives:
            x = sum(lengths[i] for i in give)
            takes = [((), other_fill, np.full(len(others), x))] if len(give) == 1 else []
            takes.append((y, y_fill, x - y_len))
            if len(give) == 1 and len(pairs_y):
                takes.append((pairs_y, pair_fill, x - pair_len))
            for what, fills, gain in takes:
                good = np.where((gain > 0) & (fills + gain <= capacity) & (fills + gain > fill[a]), gain, 0)
                k = int(good.argmax())
                if good[k] > best:
                    best = int(good[k])
                    pick = (give, (), others[k]) if what == () else (give, what[k][:-1], what[k][-1])
        if pick is None:
            stuck.add(a)
            continue
        give, take, b = pick
        bins[a] = [i for i in bins[a] if i not in give] + list(take)
        bins[b] = [i for i in bins[b] if i not in take] + list(give)
        fill[a], fill[b] = fill[a] - best, fill[b] + best
        stuck.clear()
        if fill[a] == 0:
            under.discard(a)
            alive -= 1
        if fill[b] == capacity:
            under.discard(b)
    return [b for b in bins if b]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return improve(best_fit(lengths, capacity), lengths, capacity)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The pieces with sequence_id and offset.

    Pieces are dealt by a hash into blocks of about ``block_rows``, each packed in one task; a block leaves about one sequence underfull, so
    the whole takes at most some 0.02 % more sequences than one packing of everything would.
    """
    pieces = cut_lineage(pieces, "pieces")
    blocks = max(1, -(-pieces.count() // block_rows))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", na_position="last").reset_index(drop=True)
        lengths = frame["length"].tolist()
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        for number, members in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = number, at
                at += lengths[i]
        frame["sequence_id"] = (int(frame["block"].iloc[0]) << 32) + sequence
        frame["offset"] = offset
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame.drop(columns="block")

    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).alias("block")
    return pieces.select("*", block).groupBy("block").applyInPandas(pack, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty; repeated rows and null ids are packed like any other row; an empty table gives no row. Columns other
    than doc_id and text are not read.
    """
    return pack_pieces(document_pieces(docs, tokenizer_path, capacity), capacity, block_rows)
