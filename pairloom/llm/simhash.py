"""SimHash fingerprints of word shingles and their near-duplicate groups, searched with BK-trees.

A fingerprint is linked to every other at ``radius`` or fewer differing bits. Pairs are found in shards: by the pigeonhole rule two
fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` blocks of bits, so each is sent to one shard per block, keyed
by that block's value. A shard above ``shard_rows`` is split again, on its remaining bits by the same rule, until every shard
is small or has no bits left to differ in; nothing is dropped on the way. The tree of a shard (children keyed by integer distance to
their parent) is built in the task that holds the shard's fingerprints, and every search follows only the edges within the radius.
A shard gives a star per local group, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import sliced
from pairloom.llm.components import connected_components
from pairloom.llm.line_dedup import BITMAP_BITS, bitmap
from pairloom.session import cut_lineage, write_table

BITS = 64
SEED = 42
SHARD_ROWS = 4096
LEVELS = 3


def simhash64(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of a text: A-Z lower-cased, words split at ASCII white space, repeats included.

    Fewer words than a shingle make one shingle; no word (or null) gives zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return simhash_of(np.fromiter((digest(x, SEED) for x in parts), dtype=np.uint64))


def simhash_of(hashes: np.ndarray) -> int:
    """Unsigned fingerprint of 64-bit hashes; none give zero."""
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 65536):  # bounds the unpacked bits of a very long text
        block = hashes[start:start + 65536].astype("<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_key, fp): text_key is Spark's xxhash64 of the text (null text: of null), fp the fingerprint as a signed long."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            values = np.array([simhash64(t.as_py(), shingle) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(values)], ["doc_id", "text_key", "fp"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(each, "doc_id long, text_key long, fp long")


class BKTree:
    """A Burkhard-Keller tree over distinct 64-bit fingerprints: arrays of children with their edge, the distance to the parent."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.uint64)
        values = [int(x) for x in self.points]
        children: list[dict[int, int]] = [{} for _ in values]
        for i in range(1, len(values)):
            at = 0
            while True:
                edge = (values[i] ^ values[at]).bit_count()
                after = children[at].get(edge)
                if after is None:
                    children[at][edge] = i
                    break
                at = after
        self.size = np.array([len(c) for c in children], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size)[:-1])) if len(values) else np.zeros(0, np.int64)
        self.child = np.array([x for c in children for x in c.values()], dtype=np.int64)
        self.edge = np.array([x for c in children for x in c], dtype=np.int64)

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query index, point index) at ``radius`` or less; all queries descend together, level by level."""
        who, at = np.arange(len(queries), dtype=np.int64), np.zeros(len(queries), dtype=np.int64)
        found_q, found_p = [], []
        while len(who) and len(self.points):
            distance = np.bitwise_count(queries[who] ^ self.points[at]).astype(np.int64)
            hit = distance <= radius
            found_q.append(who[hit])
            found_p.append(at[hit])
            counts = self.size[at]
            slot = np.repeat(self.first[at] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
            near = np.abs(self.edge[slot] - np.repeat(distance, counts)) <= radius
            who, at = np.repeat(who, counts)[near], self.child[slot[near]]
        empty = np.zeros(0, np.int64)
        return (np.concatenate(found_q), np.concatenate(found_p)) if found_q else (empty, empty)


def shard_links(points: np.ndarray, radius: int, block: int = 512) -> np.ndarray:
    """Index of the smallest point of each point's group within one shard of distinct, sorted points."""
    tree, root = BKTree(points), list(range(len(points)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for start in range(0, len(points), block):
        who, found = tree.within(tree.points[start:start + block], radius)
        for a, b in zip((who + start).tolist(), found.tolist()):
            if a > b:
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(len(points))], dtype=np.int64)


def _blocks(fixed: int, parts: int) -> list[int]:
    """Masks that split the bits not yet fixed into ``parts`` runs, as even as they can be."""
    free = [i for i in range(BITS) if not fixed >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _star_edges(routed: DataFrame, radius: int) -> DataFrame:
    """Edges to the smallest member of each local group; ``routed`` holds whole shards (path, key, fp)."""
    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(path: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
            new = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
            us, vs = [], []
            for a, b in zip(np.concatenate(([0], new)), np.concatenate((new, [len(fp)]))):
                if b - a == 2:  # a tree of one edge
                    if (int(fp[a] ^ fp[a + 1]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius:
                        us.append(fp[a + 1:b])
                        vs.append(fp[a:a + 1])
                elif b - a > 2:
                    points = fp[a:b]
                    root = shard_links(points.view(np.uint64), radius)
                    moved = root != np.arange(len(points))
                    us.append(points[moved])
                    vs.append(points[root[moved]])
            return pd.DataFrame({"u": np.concatenate(us) if us else np.zeros(0, np.int64), "v": np.concatenate(vs) if vs else np.zeros(0, np.int64)})

        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for frame in frames:  # sorted by shard; the last shard of a batch may go on in the next
            path, key, fp = (np.concatenate((old, frame[c].to_numpy())) for old, c in zip(held, ("path", "key", "fp")))
            if not len(fp):
                continue
            start = int(np.flatnonzero((path != path[-1]) | (key != key[-1])).max(initial=-1)) + 1
            held = [path[start:], key[start:], fp[start:]]
            if start:
                yield solve(path[:start], key[:start], fp[:start])
        if len(held[2]):
            yield solve(*held)

    return routed.repartition("path", "key").sortWithinPartitions("path", "key", "fp").mapInPandas(each, "u long, v long")


def _chunk_edges(routed: DataFrame, radius: int) -> DataFrame:
    """Edges found by the trees of chunks; ``routed`` holds (path, key, chunk, asks, fp): a chunk's own rows, and those that ask its tree.

    A row that asks gets one edge to each group of the chunk that it touches, so a dense ball gives no list of pairs. Only one chunk is
    held; the rows that ask it pass by in batches.
    """
    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own, tree, root = None, [], None, None
        for frame in frames:
            us, vs = [], []
            where = list(zip(*(frame[c].tolist() for c in ("path", "key", "chunk", "asks"))))
            fp = frame["fp"].to_numpy()
            cuts = [0, *(i for i in range(1, len(where)) if where[i] != where[i - 1]), len(where)] if where else [0]
            for a, b in zip(cuts, cuts[1:]):
                if where[a][:3] != now:
                    now, own, tree = where[a][:3], [], None
                if not where[a][3]:
                    own.append(fp[a:b])
                    continue
                if tree is None:  # rows are sorted, so the chunk is complete once it is asked
                    points = np.concatenate(own) if own else np.zeros(0, np.int64)
                    tree = BKTree(points.view(np.uint64))
                    root = shard_links(points.view(np.uint64), radius)
                who, found = tree.within(fp[a:b].view(np.uint64), radius)
                pairs = np.unique(np.stack([who, root[found]]), axis=1) if len(who) else np.zeros((2, 0), np.int64)
                us.append(fp[a:b][pairs[0]])
                vs.append(points[pairs[1]])
            yield pd.DataFrame({"u": np.concatenate(us) if us else np.zeros(0, np.int64), "v": np.concatenate(vs) if vs else np.zeros(0, np.int64)})

    return routed.repartition("path", "key", "chunk").sortWithinPartitions("path", "key", "chunk", "asks", "fp").mapInPandas(each, "u long, v long")


def _chunked(rows: DataFrame, sizes: DataFrame, shard_rows: int) -> DataFrame:
    """Each row of a large shard in its own chunk, and asking all chunks from its own on."""
    cut = rows.join(sizes.select("path", "key", F.ceil(F.col("count") / shard_rows).cast("int").alias("chunks")), ["path", "key"])
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    asked = F.transform(F.sequence("own", F.col("chunks") - 1), lambda c: F.struct(c.alias("chunk"), F.lit(True).alias("asks")))
    to = F.concat(F.array(F.struct(F.col("own").alias("chunk"), F.lit(False).alias("asks"))), asked)
    return cut.select("path", "key", "fp", F.explode(to).alias("r")).select("path", "key", "r.chunk", "r.asks", "fp")


def fingerprint_links(points: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (u, v) over the distinct fingerprints ``points`` (fp: long) that join all fingerprints within ``radius`` bits of each other.

    They are spanning edges: two fingerprints within the radius are in one component, and no edge joins what isn't linked by a chain.
    Shards of more than ``shard_rows`` rows are split by the next bits while that lowers the work (the sum of squared sizes), at most
    ``LEVELS`` times, so there are (radius + 1) ** LEVELS paths at most. Denser shards are cut into chunks of about ``shard_rows`` rows,
    each with a tree of its own that all rows of the shard from that chunk's predecessors on ask.
    """
    def shards(routed: DataFrame) -> tuple[DataFrame, int]:
        sizes = cut_lineage(routed.groupBy("path", "key").count().where("count > 1"), "shards")
        work = sizes.where(F.col("count") > shard_rows).agg(F.sum(F.col("count").cast("decimal(38,0)") * F.col("count"))).first()[0]
        return sizes, int(work or 0)

    def routes(rows: DataFrame, masks: list[tuple[int, int, int]]) -> DataFrame:
        """``rows`` (fp, path) sent down the paths; (path, child, mask) is a constant of the number of levels."""
        by_path = F.create_map(*(x for p in sorted({m[0] for m in masks}) for x in (
            F.lit(p), F.array(*(F.struct(F.lit(c).alias("path"), F.lit(m).alias("mask")) for q, c, m in masks if q == p)))))
        sent = rows.select("fp", F.explode(F.element_at(by_path, F.col("path"))).alias("r"))
        return sent.select("fp", "r.path", F.col("fp").bitwiseAND(F.col("r.mask")).alias("key"))

    def children(fixed: list[int]) -> list[tuple[int, int, int]]:
        return [(path, path * (radius + 1) + i, _signed(mask | block)) for path, mask in enumerate(fixed) for i, block in enumerate(_blocks(mask, radius + 1))]

    masks = children([0])
    routed = routes(points.select("fp", F.lit(0).alias("path")), masks)
    sizes, work = shards(routed)
    small = routed.join(sizes.where(F.col("count") <= shard_rows).select("path", "key"), ["path", "key"], "left_semi")
    edges = cut_lineage(_star_edges(small, radius), "links")
    for level in range(1, LEVELS + 1):
        if not work:
            return edges
        large = sizes.where(F.col("count") > shard_rows)
        pending = cut_lineage(routed.join(large.select("path", "key"), ["path", "key"], "left_semi").select("fp", "path", "key"), "pending")
        masks = children([m & 0xFFFFFFFFFFFFFFFF for _, _, m in masks])
        deeper = routes(pending, masks)
        below, left = shards(deeper) if level < LEVELS else (None, work)
        if left >= work:
            return edges.unionByName(cut_lineage(_chunk_edges(_chunked(pending, large, shard_rows), radius), "links"))
        small = deeper.join(below.where(F.col("count") <= shard_rows).select("path", "key"), ["path", "key"], "left_semi")
        edges = edges.unionByName(cut_lineage(_star_edges(small, radius), "links"))
        routed, sizes, work = deeper, below, left
    return edges


def components_of(prints: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(fp, component_id) over a table of (doc_id, fp): the smallest doc_id of the fingerprint's group, null if no member has an id."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    nodes = cut_lineage(nodes, "nodes")
    labels = connected_components(fingerprint_links(nodes.select("fp"), radius, shard_rows))
    labelled = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    groups = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    return labelled.join(groups, "label").select("fp", "component_id", "label")


def simhash_groups(docs: DataFrame, radius: int = 3, shingle: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, and text_key, the hash of its text.

    Null or empty text has fingerprint zero and is linked like any other; repeated rows are rows of one group; a null doc_id never
    becomes a component_id unless the whole group has none. An empty table gives an empty table. Columns other than doc_id and text are
    not read.
    """
    prints = cut_lineage(fingerprints(docs, shingle), "fingerprints")
    groups = components_of(prints, radius, shard_rows).select("fp", "component_id")
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key")


def drop_near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The documents with one of each group: the smallest doc_id (null last), then the smallest text hash; of repeated rows one.

    All columns are kept, whatever their names.
    """
    prints = cut_lineage(fingerprints(docs, shingle), "fingerprints")
    groups = components_of(prints, radius, shard_rows).select("fp", "label")
    return keep_first(docs, prints.join(groups, "fp"))


def keep_first(docs: DataFrame, labelled: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """The documents that come first in their group; ``labelled`` has doc_id, text_key and label of every document.

    A bitmap of a fixed size marks the documents that go or come more than once, and a few more; only the marked ones are shuffled.
    """
    first = labelled.groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))).alias("kept"))
    kept, _ = write_table(first.select(F.col("kept.id").alias("id"), F.col("kept.key").alias("key")), "kept")
    per = labelled.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    doubtful = per.join(kept.withColumn("stays", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left").where("n > 1 or stays is null")
    marks, _ = write_table(bitmap(doubtful.select(F.xxhash64("doc_id", "text_key").alias("mark")), "mark", bits), "marks")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("own"), F.xxhash64("text").alias("own_key"))
    place = F.shiftrightunsigned(F.xxhash64("own", "own_key"), 64 - bits)
    found = rows.withColumn("place", place).withColumn("slot", F.shiftrightunsigned("place", 6)).join(F.broadcast(marks), "slot", "left")
    marked = F.coalesce(F.getbit("bits", F.col("place").bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    joined = found.where(marked).select("doc", "own", "own_key").join(kept, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left_semi")
    once = Window.partitionBy("own", "own_key").orderBy(F.lit(0))
    return found.where(~marked).select("doc.*").unionByName(joined.withColumn("nth", F.row_number().over(once)).where("nth = 1").select("doc.*"))
