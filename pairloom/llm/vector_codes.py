"""Product codes of vectors, whose codebooks are fitted by rounds in which members stay where their entry's owner keeps them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.session import cut_lineage

MEMBERS_AN_OWNER = 250_000
RESIDENTS = "position int, entry int, salt int, width int, parts binary, weights binary, sums array<long>, total long"


def _whole(batch: pa.RecordBatch, scale: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept rows, and their vectors as whole numbers floor(scale * x)."""
    column = batch.column("v")
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    rows = np.flatnonzero(lengths == dim)
    table = flat[starts[rows][:, None] + np.arange(dim)]
    finite = np.isfinite(table).all(axis=1)
    whole = np.floor(table[finite] * scale)
    # a squared distance has to fit a long
    if whole.size and dim * (2 * float(np.abs(whole).max())) ** 2 >= 2.0 ** 62:
        raise ValueError("components are too large for squared distances in 64 bits")
    return rows[finite], whole.astype(np.int64)


def _nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry, ties to the lower one, and the squared distance."""
    reach = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)), 1)
    kind = np.float64 if 4 * parts.shape[1] * reach * reach < 2 ** 53 else np.int64  # exact either way
    x, c = parts.astype(kind), book.astype(kind)
    apart = (c * c).sum(axis=1) - 2 * (x @ c.T)
    best = apart.argmin(axis=1)
    return best, (apart[np.arange(len(best)), best] + (x * x).sum(axis=1)).astype(np.int64)


def _block(position: int, entry: int, salts: int, parts: np.ndarray, weights: np.ndarray) -> tuple:
    """Members of one owner as one row."""
    most = int(np.abs(parts).max(initial=0))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    body = parts.astype(f"<i{width}").tobytes()
    return position, entry, zlib.crc32(body) % salts, width, body, weights.astype("<i4").tobytes(), None, None


def _members(row: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(row["parts"], f"<i{row['width']}").astype(np.int64).reshape(-1, size),
            np.frombuffer(row["weights"], "<i4").astype(np.int64))


def _merged(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal parts as one with its weight."""
    raw = np.ascontiguousarray(parts).view(np.dtype((np.void, parts.dtype.itemsize * parts.shape[1]))).ravel()
    _, first, counts = np.unique(raw, return_index=True, return_counts=True)
    return parts[first], counts


def _rows_out(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("salt", pa.int32()), ("width", pa.int32()), ("parts", pa.binary()),
                        ("weights", pa.binary()), ("sums", pa.list_(pa.int64())), ("total", pa.int64())])
    columns = zip(*rows) if rows else ((),) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class Sums:
    """Sums and counts of members by owner entry."""

    def __init__(self):
        self.by = {}

    def add(self, key: tuple[int, int], sums: np.ndarray, total: int) -> None:
        have = self.by.get(key)
        self.by[key] = (sums, total) if have is None else (have[0] + sums, have[1] + total)

    def rows(self) -> list[tuple]:
        return [(p, e, 0, None, None, None, [int(x) for x in sums], int(total)) for (p, e), (sums, total) in sorted(self.by.items())]


def _arrivals(vectors: DataFrame, books: list[np.ndarray], scale: int, salts: int) -> DataFrame:
    """First round: every part moves to the owner of its nearest entry."""
    count, _, size = np.shape(books)

    def each(batches):
        for batch in batches:
            whole = _whole(batch, scale, count * size)[1].reshape(-1, count, size)
            rows = []
            for p in range(count):
                parts, weights = _merged(whole[:, p])
                best = _nearest(parts, books[p])[0]
                rows += [_block(p, int(e), salts, parts[best == e], weights[best == e]) for e in np.unique(best)]
            yield _rows_out(rows)

    return vectors.mapInArrow(each, RESIDENTS)


def _moves(residents: DataFrame, history: list[list[np.ndarray]], salts: int) -> DataFrame:
    """Members that leave, by their new owner, and one row of sums per entry for those that stay.

    ``history`` holds the codebooks since the table's members arrived. A member is still here if each of them but the last gave it this
    entry; the last one says whether it leaves now. So tables are only added, never rewritten.
    """
    size = history[0][0].shape[1]

    def each(batches):
        stay = Sums()
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["parts"] is None:
                    continue
                p, e = row["position"], row["entry"]
                parts, weights = _members(row, size)
                for books in history[:-1]:
                    here = _nearest(parts, books[p])[0] == e
                    parts, weights = parts[here], weights[here]
                best = _nearest(parts, history[-1][p])[0]
                rows += [_block(p, int(to), salts, parts[best == to], weights[best == to]) for to in np.unique(best) if to != e]
                parts, weights = parts[best == e], weights[best == e]
                stay.add((p, e), (parts * weights[:, None]).sum(axis=0), int(weights.sum()))
            yield _rows_out(rows)
        yield _rows_out(stay.rows())

    return residents.mapInArrow(each, RESIDENTS)


def _update(table: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry becomes the floored mean of its members: those that stayed (as sums) and those that came. At most one row per entry
    and component reaches the driver."""
    size = books[0].shape[1]

    def each(batches):
        sums = Sums()
        for batch in batches:
            for row in batch.to_pylist():
                if row["sums"] is not None:
                    sums.add((row["position"], row["entry"]), np.array(row["sums"], dtype=np.int64), row["total"])
                else:
                    parts, weights = _members(row, size)
                    sums.add((row["position"], row["entry"]), (parts * weights[:, None]).sum(axis=0), int(weights.sum()))
        yield _rows_out(sums.rows())

    partial = table.mapInArrow(each, RESIDENTS).select("position", "entry", "total", F.posexplode("sums").alias("at", "value"))
    made = [b.copy() for b in books]
    for r in partial.groupBy("position", "entry", "at").agg(F.sum("value").alias("value"), F.sum("total").alias("total")).collect():
        if r["total"]:
            made[r["position"]][r["entry"], r["at"]] = r["value"] // r["total"]
    return made


def fit_codebooks(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> list[np.ndarray]:
    """Codebooks (one array of entries x components per part position) by member-resident Lloyd rounds.

    ``vectors`` has (vec_id, v). Rows of (position, entry, salt) hold their members in blocks, equal parts of an input batch as one with
    its weight, and are written to the shared folder by one shuffle. In each round the owners sum what they hold and only members whose
    nearest entry changed go through the shuffle to their new owner; a round's table holds just them and the sums of those that stayed.
    Codebooks (parts x entries rows) are all that the driver sees. Salts grow with the rows, so an entry that draws a third of them is
    spread over many owners.

    The first entries are those of the smallest distinct ids (null last); of rows with one id the smallest vector counts. Fewer ids give
    fewer entries, and none an empty list. The vector length is that of the smallest id; it must divide into ``parts``.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable("v"))
    least = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    if least is None:
        return []
    dim = least[0]
    if dim == 0 or dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    kept = kept.where(F.size("v") == dim)
    first = [r[0] for r in kept.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    wanted = F.col("vec_id").isin([i for i in first if i is not None])
    if None in first:
        wanted = F.col("vec_id").isNull() | wanted
    seeds = {r["vec_id"]: r["v"] for r in kept.where(wanted).groupBy("vec_id").agg(F.min("v").alias("v")).collect()}
    start = np.floor(np.array([seeds[i] for i in first], dtype=np.float64) * scale).astype(np.int64)
    size = dim // parts
    books = [[start[:, p * size:(p + 1) * size] for p in range(parts)]]
    salts = -(-vectors.count() // (entries * MEMBERS_AN_OWNER))
    owners, wide = ["position", "entry", "salt"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = [parts * entries * salts] if parts * entries * salts > wide else []
    tables = []
    for r in range(rounds):
        if r == 0:
            moved = _arrivals(vectors, books[0], scale, salts)
        else:
            moved = None
            for s, table in enumerate(tables):
                part = _moves(table, books[s + 1:r + 1], salts)
                moved = part if moved is None else moved.unionByName(part)
        tables.append(cut_lineage(moved.repartition(*width, *owners), "members"))
        books.append(_update(tables[-1], books[-1]))
    return books[-1]


def usable(name: str):
    """The vector and all its components are there and finite."""
    bad = F.exists(name, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(name).isNotNull() & ~bad


def encode(vectors: DataFrame, books: Sequence[np.ndarray], scale: int = 4096) -> DataFrame:
    """``vectors`` (with a column ``v``) without it, and ``code``, ``error``: nearest entries in hex and the sum of their squared distances."""
    others = [c for c in vectors.columns if c != "v"]
    schema = T.StructType([*[vectors.schema[c] for c in others], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    books = list(books)

    def each(batches):
        for batch in batches:
            rows, whole = _whole(batch, scale, sum(b.shape[1] for b in books))
            whole = whole.reshape(len(rows), len(books), -1)
            codes, error = np.zeros((len(rows), len(books)), dtype=np.uint8), np.zeros(len(rows), dtype=np.int64)
            for p, book in enumerate(books):
                codes[:, p], apart = _nearest(whole[:, p], book)
                error += apart
            body = codes.tobytes().hex()
            texts = [body[i:i + 2 * len(books)] for i in range(0, len(body), 2 * len(books))]
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in others], pa.array(texts, pa.string()), pa.array(error)], [*others, "code", "error"])

    return vectors.mapInArrow(each, schema)


def codebooks_digest(books: Sequence[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def vector_codes(embeddings: DataFrame, vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6,
                 scale: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector (``entries`` up to 256).

    Dropped are null vectors, vectors with a null or non-finite component, and vectors of another length than that of the smallest id.
    Repeated rows and null ids are coded as they are and stay rows; null labels are one label. An empty table, or one without usable
    vectors, gives no rows. Other columns are ignored, whatever their names. A vector whose squared distances would not fit a long
    raises, as the error could not be given.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    books = fit_codebooks(rows.select("vec_id", "v"), parts, entries, rounds, scale)
    if not books:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = cut_lineage(encode(rows, books, scale), "codes")
    by_label = cut_lineage(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["label"])).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
