"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by score, then from the left, and merges the first until none is left: a heap
for a long chunk, and for the many short ones of a batch one array of agendas that advance together. No
merge crosses a border that no piece spans: for the usual vocabularies a white-space mark that follows another symbol, the end of a run
of letters, and a line end. Texts are cut there, so equal chunks are merged once per worker and remembered within a bound.
Every chunk that is merged is checked against the sentencepiece library in the same Arrow batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import sliced, texts_of

MARK = "\u2581"
REMEMBERED = 400_000
SHORT = 48
NEVER = np.int64(2**62)


class PieceModel:
    """A vocabulary with its scores, and the chunks already encoded."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size, lib = self.library.get_piece_size(), self.library
        self.ids, self.rank, self.bytes = {}, {}, {}
        for i in range(size):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i)):
                self.ids[piece] = i
                self.rank[piece] = -lib.get_score(i)
        self.unknown, self.remembered = lib.unk_id(), remembered
        longer = [p for p in self.ids if len(p) > 1]
        spanned = any(re.search(f"[^{MARK}]{MARK}", p) for p in longer)
        self.alone = "" if any("\n" in p for p in longer) or "\n" in self.ids else "\n"
        letter, other = r"[^\W\d_]", rf"(?:[^\w{MARK}{self.alone}]|[\d_])"
        if spanned:
            cuts = r"(?s:.+)"
        elif any(re.search(rf"{letter}(?!{letter})(?!$)", p) for p in longer):
            cuts = rf"{MARK}+[^{MARK}{self.alone}]*|[^{MARK}{self.alone}]+"
        else:  # no piece goes on after its letters end, so words part from the signs that follow them
            cuts = rf"{MARK}*{other}*{letter}+|{MARK}*{other}+|{MARK}+"
        self.chunks = re.compile(cuts + ("|\n" if self.alone else ""))
        self.checkable = bool(self.alone) and not spanned
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}
        self._tabulate(longer)

    def _tabulate(self, longer: list[str]) -> None:
        """Pairs of symbols that make a piece, sorted by key, with the order of their merge and the symbol they become."""
        self.symbol = {piece: k for k, piece in enumerate(self.ids)}
        for c in sorted({c for p in longer for c in p} - self.symbol.keys()):
            self.symbol[c] = len(self.symbol)
        order = {score: k for k, score in enumerate(sorted(set(self.rank.values())))}
        pairs = sorted((self.symbol[p[:i]] << 32 | self.symbol[p[i:]], order[self.rank[p]], self.symbol[p])
                       for p in longer for i in range(1, len(p)) if p[:i] in self.symbol and p[i:] in self.symbol)
        self.pair, self.turn, self.made = (np.array(x, dtype=np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3

    def _turns(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """When each pair merges (NEVER if it doesn't), and into which symbol."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.turn[at] << 32, NEVER), self.made[at]

    def merge_many(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """Ids of many short chunks: their agendas advance together, each by its first pair, until all are empty."""
        symbol, names = self.symbol, list(self.ids)
        for c in set("".join(chunks)) - symbol.keys():
            symbol[c] = len(symbol)
        if not len(self.pair):
            return [tuple(self.ids_of(c)) for c in chunks]
        flat = np.array([symbol[c] for chunk in chunks for c in chunk], dtype=np.int64)
        length = np.array([len(c) for c in chunks], dtype=np.int64)
        owner = np.repeat(np.arange(len(chunks)), length)
        turn, made = self._turns(flat, np.append(flat[1:], 0))
        turn[np.append(owner[1:] != owner[:-1], True)] = NEVER
        done_symbols, done_owner = [], []
        while len(flat):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(flat)))
            best = np.minimum.reduceat(turn + np.arange(len(flat)), starts)
            going = best < NEVER
            stay = np.repeat(going, sizes)
            done_symbols.append(flat[~stay])
            done_owner.append(owner[~stay])
            left = best[going] & 0xFFFFFFFF
            flat[left] = made[left]
            stay[left + 1] = False
            place = np.cumsum(stay) - 1
            at = place[left]
            flat, owner, turn, made = flat[stay], owner[stay], turn[stay], made[stay]
            if not len(flat):
                break
            redo = np.unique(np.concatenate((at, np.maximum(at - 1, 0))))
            follow = np.minimum(redo + 1, len(flat) - 1)
            turn[redo], made[redo] = self._turns(flat[redo], flat[follow])
            turn[redo[(owner[redo] != owner[follow]) | (redo == follow)]] = NEVER
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        rank = np.argsort(owner, kind="stable")
        symbols, ends = symbols[rank], np.cumsum(np.bincount(owner, minlength=len(chunks)))
        table = np.full(len(symbol), -1, dtype=np.int64)
        table[:len(names)] = list(self.ids.values())
        ids, plain = table[symbols], np.ones(len(chunks), dtype=bool)
        plain[owner[rank][ids < 0]] = False
        ids, starts = ids.tolist(), (ends - np.bincount(owner, minlength=len(chunks))).tolist()
        return [tuple(ids[a:b]) if ok else tuple(self.ids_of(c)) for c, a, b, ok in zip(chunks, starts, ends.tolist(), plain.tolist())]

    def merge(self, chunk: str) -> list[str]:
        """Final symbols of a chunk."""
        rank, symbols, n = self.rank, list(chunk), len(chunk)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(rank[pair], i, pair) for i, pair in enumerate(map(str.__add__, symbols, symbols[1:])) if pair in rank]
        heapify(agenda)
        while agenda:
            _, left, pair = heappop(agenda)
            right = after[left]
            if symbols[left] is None or right >= n or symbols[left] + symbols[right] != pair:
                continue  # one of the two has changed since
            symbols[left], symbols[right] = pair, None
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                longer = pair + symbols[follow]
                if longer in rank:
                    heappush(agenda, (rank[longer], left, longer))
            ahead = before[left]
            if ahead >= 0:
                longer = symbols[ahead] + pair
                if longer in rank:
                    heappush(agenda, (rank[longer], ahead, longer))
        return [s for s in symbols if s is not None]

    def ids_of(self, chunk: str) -> list[int]:
        out: list[int] = []
        for symbol in self.merge(chunk):
            i = self.ids.get(symbol)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in symbol.encode("utf-8"))
            else:
                out.append(self.unknown)
        return out

    def split(self, text: str) -> list[str]:
        return self.chunks.findall(self.library.normalize(text)) if text else []

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks not met before, and hold them against the library."""
        short = [c for c in chunks if len(c) <= SHORT]
        made = zip(short, self.merge_many(short)) if short else ()
        for chunk, ids in (*made, *((c, tuple(self.ids_of(c))) for c in chunks if len(c) > SHORT)):
            self.known[chunk] = ids, ",".join(map(str, ids))
        if self.checkable and chunks:
            break_id = self.bytes[10]
            own = [i for chunk in chunks for i in (break_id, *self.known[chunk][0])]
            library = self.library.encode("\n" + "\n".join(c.replace(MARK, " ") for c in chunks), num_threads=1)
            start = len(library) - len(own)
            if library[start:] != own or start > 1:
                wrong = next((c for c in chunks if self.library.encode("\n" + c.replace(MARK, " "))[-len(self.known[c][0]):] != list(self.known[c][0])), chunks[0])
                raise ValueError(f"the agenda and the library differ on {wrong!r}")

    def encode_batch(self, texts: list[str]) -> list[list[tuple[tuple[int, ...], str]]]:
        """Per text, its chunks' (ids, ids joined by commas)."""
        cut = [self.split(t) for t in texts]
        met = dict.fromkeys(c for chunks in cut for c in chunks)
        new = [c for c in met if c not in self.known]
        if len(self.known) + len(new) > self.remembered:  # chunks met before go too, so all of the slice are learnt again
            self.known.clear()
            new = list(met)
        self.learn(new)
        known = self.known
        out = [[known[c] for c in chunks] for chunks in cut]
        if not self.checkable:
            for text, encoded in zip(texts, out):
                if self.library.encode(text) != [i for ids, _ in encoded for i in ids]:
                    raise ValueError(f"the agenda and the library differ on {text[:80]!r}")
        return out


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids: array<int>), without begin or end ids; null and empty texts give an empty array."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in sliced(batches):
            ids = [[i for part, _ in encoded for i in part] for encoded in model.encode_batch(list(texts_of(batch)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids) by the library; null ids give an empty text."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = piece_model(model_path).library
        for batch in sliced(batches):
            texts = [library.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(each, "doc_id long, text string")


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded and decoded in one pass.

    Null and empty texts have no ids and decode to the empty text; repeated rows give repeated rows; columns other than doc_id and text
    are not read. A very long text is cut into chunks like any other, so its agenda never holds more than one chunk.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        decode = model.library.decode
        for batch in sliced(batches, 256):
            counts, encoded_sha, decoded_sha = [], [], []
            for encoded in model.encode_batch(list(texts_of(batch))):
                ids = [i for part, _ in encoded for i in part]
                counts.append(len(ids))
                encoded_sha.append(hashlib.sha256(",".join([s for _, s in encoded]).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(encoded_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
