"""Removal of repeated and nearly repeated lines. Only built-in functions are used.

A line repeats an earlier one if their words agree but for at most one insertion, deletion or replacement. All variants of a line with
one word deleted are emitted as hashed keys; equal variants meet in a join, and the edit distance is verified on the words. Before
that, lines that cannot have a partner are set aside without loss: one edit leaves either the first or the last h words of a line
as they are, so a line that shares neither with another line stays out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.sketches import bound_to
from pairloom.session import cut_lineage

LEAST_WORDS = 8
SPANS = (4, 8, 16, 32)
SPACES = " \t\n\x0b\x0c\r"
BITMAP_BITS = 24
HOT_LINES = 100_000
HOT_COUNT = 1000
DOC = ["no_id", "id", "key"]
LINE = ["h1", "h2"]


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    text = F.col("text").cast("string")
    return docs.select(*more, doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(text).alias("key"), text.alias("body"))


def _ends(line: Column, n: Column) -> Column:
    """Hashes of the first and of the last h words for the largest h that fits twice, and for the next smaller one where a line a
    word shorter would use that; none if the line is too short."""
    h = F.when(n < LEAST_WORDS, 0)
    for least in SPANS[1:]:
        h = h.when(n < 2 * least, least // 2)
    h = h.otherwise(SPANS[-1])

    def pair(size: Column) -> list[Column]:
        return [F.xxhash64(count, F.call_function("substring_index", line, F.lit(" "), count)) for count in (size, -size)]

    def both(size: Column) -> Column:
        here = F.array(*pair(size))
        return F.when(size == 0, F.array().cast("array<bigint>")).when(n.isin([2 * x for x in SPANS[1:]]), F.concat(here, F.array(*pair((size / 2).cast("int"))))).otherwise(here)

    return bound_to(h, both)


def _text_lines(docs: DataFrame) -> DataFrame:
    """One row per line that has a word: document, position, two hashes of the line, and the line."""
    exploded = _keyed(docs).select(*DOC, F.posexplode(F.split("body", "\n")).alias("pos", "line")).where(F.trim("line", F.lit(SPACES)) != "")
    return exploded.select(*DOC, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), "line")


def _line_ends() -> Column:
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return bound_to(words, lambda n: _ends(F.col("line"), n))


def bitmap(hashes: DataFrame, column: str, bits: int = BITMAP_BITS) -> DataFrame:
    """(slot, bits): a bitmap of the hashes in a fixed number of 64-bit slots (at most 2 MB), whatever their number."""
    placed = hashes.select(F.shiftrightunsigned(column, 64 - bits).alias("place"))
    return placed.select(F.shiftrightunsigned("place", 6).alias("slot"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))


def _likely(rows: DataFrame, column: str, hashes: DataFrame, name: str, bits: int = BITMAP_BITS) -> DataFrame:
    """The rows whose ``column`` is one of the hashes, and a few more: a filter where the rows are read."""
    place = F.shiftrightunsigned(column, 64 - bits)
    found = rows.withColumn("slot", F.shiftrightunsigned(place, 6)).join(F.broadcast(cut_lineage(bitmap(hashes, column, bits), name)), "slot")
    return found.where(F.getbit("bits", place.bitwiseAND(F.lit(63)).cast("int")) == 1).drop("slot", "bits")


def _words(line: Column) -> Column:
    return F.split(line, " ")


def _pair_hash(words: Column) -> Column:
    """Hash of the set of neighbouring word pairs: exclusive or, so that one pair can be taken out or put in."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(words)), lambda i: F.xxhash64(F.when(i > 0, F.get(words, i - 1)), F.lit("|"), F.get(words, i)))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _variant_keys(words: Column) -> Column:
    """Keys of the line itself (position -1) and of each variant with one word deleted, all from one pass over the word pairs."""
    def pair(a: Column, b: Column) -> Column:
        return F.xxhash64(a, F.lit("|"), b)

    def keys(packed: Column) -> Column:
        ws, whole = packed["ws"], packed["whole"]
        n = F.size(ws)

        def one(i: Column) -> Column:
            before = F.when(i > 0, F.get(ws, i - 1))
            gone = whole.bitwiseXOR(pair(before, F.get(ws, i))).bitwiseXOR(pair(F.get(ws, i), F.get(ws, i + 1))).bitwiseXOR(pair(before, F.get(ws, i + 1)))
            return F.struct(F.when(i < 0, whole).otherwise(gone).alias("v"), i.cast("int").alias("at"))

        return F.transform(F.sequence(F.lit(-1), n - 1), one)

    return bound_to(words, lambda ws: bound_to(F.struct(ws.alias("ws"), _pair_hash(ws).alias("whole")), keys))


def _without(words: Column, at: Column) -> Column:
    return F.concat(F.slice(words, F.lit(1), at), F.slice(words, at + 2, F.greatest(F.size(words) - at - 1, F.lit(0))))


def near_lines(firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """(h1, h2) of the distinct lines that are within one word of an earlier line.

    ``firsts``: h1, h2, the first occurrence ``first`` (no_id, id, key, pos) and ``ends`` of each distinct line.
    """
    ends = firsts.select(*LINE, F.explode("ends").alias("end"))
    shared = cut_lineage(ends.groupBy("end").count().where("count > 1").select("end"), "shared")
    paired = ends.join(shared, "end", "left_semi").select(*LINE).distinct()
    # of the lines without a partner only a few are shuffled with their words
    every = _text_lines(docs).select(*LINE, F.struct(*DOC, "pos").alias("first"), "line", F.explode(_line_ends()).alias("end"))
    # written, since the semi-join below would else be moved under the bitmap
    likely = cut_lineage(_likely(every, "end", shared, "bitmap").select(*LINE, "first", "line"), "likely")
    only = firsts.select(*LINE, "first").join(paired, LINE, "left_semi")
    lines = cut_lineage(likely.join(only, [*LINE, "first"], "left_semi").dropDuplicates(LINE), "lines")
    variants = lines.select("h1", F.explode(_variant_keys(_words(F.col("line")))).alias("x")).select("h1", "x.v", "x.at")
    met = cut_lineage(variants.groupBy("v").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("v"), "met")
    live = cut_lineage(_likely(variants, "v", met, "met-bitmap"), "live").join(met, "v", "left_semi").groupBy("h1").agg(F.collect_set("at").alias("ats"))  # a line's own positions
    words = _words(F.col("line"))
    exact = lines.join(live, "h1").select(*LINE, "first", words.alias("words"), F.explode("ats").alias("at"))
    text = F.array_join(F.when(F.col("at") < 0, F.col("words")).otherwise(_without(F.col("words"), F.greatest(F.col("at"), F.lit(0)))), " ")
    hashed = cut_lineage(exact.select(*LINE, "first", "at", F.xxhash64(text).alias("e1"), F.xxhash64(F.lit("variant"), text).alias("e2")), "variants")
    key = ["e1", "e2"]
    member = F.struct("first", *LINE)
    replaced = hashed.where("at >= 0")
    low = replaced.groupBy(*key, "at").agg(F.min(member).alias("low"))
    pairs = replaced.join(low, [*key, "at"]).where("first > low.first").select(*LINE, F.col("low.h1").alias("o1"), F.col("low.h2").alias("o2"))
    whole = hashed.where("at = -1").select(*key, F.col("first").alias("w_first"), F.col("h1").alias("w1"), F.col("h2").alias("w2"))
    longer = replaced.join(whole, key)
    after = longer.where("first > w_first").select(*LINE, F.col("w1").alias("o1"), F.col("w2").alias("o2"))
    ahead = longer.where("first < w_first").groupBy(F.col("w1").alias("h1"), F.col("w2").alias("h2")).agg(F.min(member).alias("low")).select(*LINE, F.col("low.h1").alias("o1"), F.col("low.h2").alias("o2"))
    linked = pairs.unionByName(after).unionByName(ahead).distinct()
    mine = lines.select(*LINE, words.alias("a"))
    other = lines.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), words.alias("b"))
    return linked.join(mine, LINE).join(other, ["o1", "o2"]).where(one_edit(F.col("a"), F.col("b"))).select(*LINE).distinct()


def one_edit(a: Column, b: Column) -> Column:
    """Whether two word lists are within one insertion, deletion or replacement."""
    def apart(x: Column, y: Column) -> Column:
        return F.size(F.filter(F.zip_with(x, y, lambda p, q: p != q), lambda d: d))

    def one_more(x: Column, y: Column) -> Column:
        """y is x with one word deleted: the first place where they part decides which."""
        parts = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True).cast("int") - 1
        return _without(x, parts) == y

    return F.when(F.size(a) == F.size(b), apart(a, b) <= 1).when(F.size(a) == F.size(b) + 1, one_more(a, b)).when(F.size(b) == F.size(a) + 1, one_more(b, a)).otherwise(False)


def _deduped(docs: DataFrame) -> DataFrame:
    """Each row as ``doc``, its text without the removed lines as ``kept``, and their positions as ``gone`` (null: none)."""
    text = F.col("body")
    kept = F.when(F.col("gone").isNull(), text).otherwise(bound_to(
        F.struct(F.split(text, "\n").alias("all"), F.col("gone").alias("gone")),
        lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["all"]) - 1), s["gone"]), lambda i: F.get(s["all"], i)), "\n")))
    return _keyed(docs, F.struct("*").alias("doc")).join(removed_lines(docs), DOC, "left").select("doc", kept.alias("kept"), "gone")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents, all of them, without the lines that repeat an earlier line: exactly, or within one word if both have at least
    ``LEAST_WORDS`` words. Adds no column; n_chars follows the text where it is given.

    Earlier means a smaller doc_id (null last), then a smaller hash of the text, then a line further up. Lines are parted by \\n, words by a
    single space; lines without a word stay. A document whose lines all go keeps an empty text; null texts stay null. Rows that repeat an
    id and a text are one document and come out alike. A column may have any name.
    """
    joined = _deduped(docs)
    fields = []
    for name, kind in docs.dtypes:
        if name == "text":
            fields.append(F.col("kept").alias(name))
        elif name == "n_chars":
            fields.append(F.when(F.col("kept").isNotNull(), F.length("kept")).otherwise(F.col("doc.n_chars")).cast(kind).alias(name))
        else:
            fields.append(F.col("doc").getField(name).alias(name))
    return joined.select(*fields)


def removed_lines(docs: DataFrame, hot_count: int = HOT_COUNT) -> DataFrame:
    """(no_id, id, key, gone): per document that loses lines, their positions; key is Spark's xxhash64 of the text.

    Lines that occur ``hot_count`` times or more are not shuffled by line."""
    place = F.struct(*DOC, "pos")
    occurrence = F.struct(*DOC, "pos", "ends").alias("f")
    firsts = cut_lineage(_text_lines(docs).withColumn("ends", _line_ends()).select(*LINE, occurrence).groupBy(*LINE).agg(F.min("f").alias("f"), F.count("*").alias("n")).select(
        *LINE, F.struct(*(F.col(f"f.{c}").alias(c) for c in (*DOC, "pos"))).alias("first"), "n", "f.ends"), "firsts")
    near = near_lines(firsts, docs).withColumn("near", F.lit(True))
    marked = cut_lineage(firsts.select(*LINE, "first", "n").join(near, LINE, "left").where("n > 1 or near"), "marked")
    met = cut_lineage(_likely(_text_lines(docs).select(*LINE, *DOC, "pos"), "h1", marked, "marked-bitmap"), "met-lines")
    # lines that occur often are broadcast and their occurrences stay where they are: at most HOT_LINES, since their counts add up to all lines
    total = marked.agg(F.sum("n")).first()[0] or 0
    often = max(hot_count, -(-total // HOT_LINES))
    hot = F.broadcast(marked.where(F.col("n") >= often))
    rest = marked.where(F.col("n") < often)
    held = met.join(hot, LINE).unionByName(met.join(F.broadcast(marked.where(F.col("n") >= often).select(*LINE)), LINE, "left_anti").join(rest, LINE))
    gone = held.where(F.col("near").isNotNull() | (place != F.col("first")))
    return gone.groupBy(*DOC).agg(F.collect_set("pos").alias("gone"))


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, text without its repeated lines, n_lines and n_removed of every document; a null text has no line."""
    n_lines = F.coalesce(F.size(F.split("doc.text", "\n")), F.lit(0))
    return _deduped(docs.select("doc_id", "text")).select(
        "doc.doc_id", F.col("kept").alias("text"), F.when(F.col("kept").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_removed"))
