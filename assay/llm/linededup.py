"""Repeated passages across documents, by content-defined chunks of lines.

A rolling hash over the hashes of each line and the one before it decides where a chunk ends, so the
boundaries move with the content: a passage that was shifted by inserted lines falls into the same
chunks again. Chunks of several lines that occur more than once in the corpus are compared byte by
byte, and all but the first occurrence (smallest document, then position) are removed.

A short passage seldom holds a whole chunk. A second, finer cut therefore takes each two neighbouring
lines with words as a chunk (blank lines between them don't count), and each line of more than
``RUN_WORDS`` words. Lines in repeated fine chunks that stand together form a run, and runs of more than
``RUN_WORDS`` words are removed as well. Fine chunks are as many as lines, so they meet by the numbers
(64-bit hashes) of their lines. Then the bytes of every line of a repeated fine chunk are compared, once
for each task that holds it; a chunk with a line whose number stands for several texts is met again by
its text. So no line goes for a hash alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.storage import free_name, materialize, partitions

from .exprs import WORD, id_or_default, let, md5_number

#: Chunks end at one line in ``DIVISOR`` on average; shorter chunks than ``LEAST`` lines are never removed.
DIVISOR, LEAST, FACTOR = 4, 2, 31
RUN_WORDS = 50
#: Rows of a repeated chunk that are never dealt into parts.
PART_ROWS = 10_000


def chunk_ends(lines, divisor: int = DIVISOR):
    """Positions (from 1) of the lines that end a chunk; the last line always does."""
    hashes = F.transform(lines, lambda line: md5_number(line, 7))

    def ends(h):
        rolling = lambda i: F.get(h, i - 1) + FACTOR * F.coalesce(F.get(h, i - 2), F.lit(0))
        return F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (i == F.size(h)) | (F.pmod(rolling(i), F.lit(divisor)) == 0))

    return let(hashes, ends)


def chunks(lines, divisor: int = DIVISOR, least: int = LEAST):
    """(start, end, text) of the content-defined chunks that may be removed: lines from ``start``, counted from 0, before ``end``."""

    def cut(held):
        def one(e):
            start = lambda j: F.coalesce(F.get(e, j - 1), F.lit(0))
            spans = F.filter(F.transform(e, lambda end, j: F.struct(start(j).cast("int").alias("start"), end.cast("int").alias("end"))), lambda c: c["end"] - c["start"] >= least)
            return F.transform(spans, lambda c: F.struct(c["start"], c["end"], F.array_join(F.slice(held, c["start"] + 1, c["end"] - c["start"]), "\n").alias("text")))

        return F.filter(let(chunk_ends(held, divisor), one), lambda c: c["text"].rlike(WORD))

    return let(lines, cut)


def line_number(line):
    """What lines meet by until their bytes are compared."""
    return F.xxhash64(line)


def fine_chunks(lines):
    """(start, end, d1, d2, alone) of the chunks of the finer cut: the numbers of the first and the last line, and whether they are one."""
    worded = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line"), line_number(line).alias("d"))), lambda x: x["line"].rlike(WORD))

    def found(w):
        both = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: F.struct(a["i"].alias("start"), (b["i"] + 1).alias("end"), a["d"].alias("d1"), b["d"].alias("d2"), F.lit(False).alias("alone")))
        long = F.filter(w, lambda x: (F.length(x["line"]) > 2 * RUN_WORDS) & (F.regexp_count(x["line"], F.lit(WORD)) > RUN_WORDS))
        alone = F.transform(long, lambda x: F.struct(x["i"].alias("start"), (x["i"] + 1).alias("end"), x["d"].alias("d1"), x["d"].alias("d2"), F.lit(True).alias("alone")))
        return F.concat(both, alone)

    return let(worded, found)


def _gone(lines, coarse, fine):
    """Numbers (from 0) of the lines to remove: those of coarse chunks, and of runs of fine ones with more than ``RUN_WORDS`` words."""
    spread = lambda spans: F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1)))))

    def runs(covered):
        placed = F.transform(covered, lambda i, k: F.struct(i.alias("i"), k.alias("k")))
        heads = F.filter(placed, lambda x: (x["k"] == 0) | (x["i"] != F.get(covered, x["k"] - 1) + 1))
        ends = lambda h: F.transform(h, lambda a, j: F.struct(a["i"].alias("start"), F.coalesce(F.get(covered, F.get(h, j + 1)["k"] - 1), F.element_at(covered, -1)).alias("end")))
        return let(heads, ends)

    long = lambda held: lambda r: F.regexp_count(F.array_join(F.slice(held, r["start"] + 1, r["end"] - r["start"] + 1), "\n"), F.lit(WORD)) > RUN_WORDS
    kept = let(lines, lambda held: F.filter(let(spread(fine), runs), long(held)))
    whole = F.flatten(F.transform(kept, lambda r: F.sequence(r["start"], r["end"])))
    return F.array_distinct(F.concat(spread(coarse), whole))


def _meet(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the values of their groups (one row for each ``on``, with their number ``n``); rows without a group go.

    A group of more than a quarter of an even partition's rows is dealt into parts, with a copy of its
    values for each. Such groups are fewer than four for each partition, and only they are broadcast; all
    others meet their rows once.
    """
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    most = max(PART_ROWS, total // (4 * partitions(rows.sparkSession)))
    sized = groups.withColumn("parts", F.ceil(F.col("n") / most).cast("int")).drop("n")
    hot = F.broadcast(sized.filter("parts > 1").select(*on, "parts"))
    dealt = rows.join(hot, on, "left").withColumn("part", F.pmod(F.xxhash64("place"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return dealt.join(sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), [*on, "part"])


def _several_texts(spans: DataFrame, text_col: str, gone: str) -> DataFrame:
    """Line numbers (``d``) that stand for more than one text among the lines of fine spans."""
    at = F.array_distinct(F.flatten(F.transform(F.filter(gone, lambda s: s["fine"]), lambda s: F.array(s["start"], s["end"] - 1))))
    lines = spans.select(F.explode(let(F.split(text_col, "\n"), lambda held: F.transform(at, lambda i: F.get(held, i)))).alias("line"))
    return lines.select(line_number(F.col("line")).alias("d"), "line").distinct().groupBy("d").agg(F.count("*").alias("n")).filter("n > 1").select("d")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR, least: int = LEAST) -> DataFrame:
    """``docs`` with the repeated chunks cut out of the text, and ``n_chunks``, ``n_removed_chunks``, ``n_removed_lines``.

    The first two count content-defined chunks, the last one lines of either cut. A content-defined
    chunk is removable if it has ``least`` lines or more and at least one word. A null text stays null
    with no chunks, an empty one is one chunk that stays. Rows that repeat both id and text are one
    document: they get the same decision and both come back. Ties in the order fall to the text's hash.
    Very long texts are cut as others are; an empty table gives an empty result. Columns of ``docs`` stay
    as they are; where a new name is taken, it gets underscores.
    """
    key, none, h, out, gone, n_all, n_gone, n_lines, held, back = free_name(docs, "key", "none", "h", "chunks", "gone", "n_chunks", "n_removed_chunks", "n_removed_lines", "held", "back")
    keyed = docs.withColumns({key: id_or_default(docs, id_col), none: F.isnull(id_col), h: F.xxhash64(text_col)})
    own = F.struct(F.col(none).alias("none"), F.col(key).alias("key"), F.col(h).alias("h"))
    place = lambda c: F.struct("doc.none", "doc.key", "doc.h", f"{c}.start", f"{c}.end")
    spans_of = lambda df, fine: df.select(F.col("place.key").alias(key), F.col("place.none").alias(none), F.col("place.h").alias(h), F.struct("place.start", "place.end", F.lit(fine).alias("fine"), "first").alias("span"))

    every = keyed.select(own.alias("doc"), F.explode(chunks(F.split(text_col, "\n"), divisor, least)).alias("chunk"))
    every = every.select(place("chunk").alias("place"), F.xxhash64("chunk.text").alias("digest"), F.col("chunk.text").alias("text"))
    # many documents share a digest: the first look counts places, with nothing but numbers in the shuffle
    narrow = every.groupBy("digest").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"))
    repeated = materialize(narrow.filter("first < last").select("digest", "n"), "digests")
    rows = materialize(_meet(every, repeated, ["digest"]), "repeated")
    firsts = rows.groupBy("digest", "text").agg(F.min("place").alias("first"), F.first("parts").alias("parts"))
    # a chunk that very many documents share is compared in parts
    firsts = firsts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    coarse = rows.join(firsts, ["digest", "text", "part"]).filter("place <> first").withColumn("first", F.lit(False))

    numbers = ["d1", "d2", "alone"]
    small = keyed.select(own.alias("doc"), F.explode(fine_chunks(F.split(text_col, "\n"))).alias("c")).select(place("c").alias("place"), *[f"c.{c}" for c in numbers])
    small = materialize(small, "lines")
    shared = small.groupBy(*numbers).agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n")).filter("first < last")
    shared = materialize(shared.select(*numbers, "first", "n"), "shared")
    fine = _meet(small, shared, numbers).withColumn("first", F.expr("place = first"))

    by_doc = spans_of(coarse, False).unionByName(spans_of(fine, True)).groupBy(key, none, h).agg(F.collect_set("span").alias(gone))
    by_doc = materialize(by_doc, "removed").hint("merge")
    several = materialize(_several_texts(keyed.select(key, none, h, text_col).join(by_doc, [key, none, h]), text_col, gone), "several")
    # chunks that met by such a number: the first of each text stays
    unsure = small.join(several.withColumnRenamed("d", "d1"), "d1", "left_semi").unionByName(small.join(several.withColumnRenamed("d", "d2"), "d2", "left_semi")).select("place", "alone").distinct()
    unsure = unsure.groupBy(F.col("place.key").alias(key), F.col("place.none").alias(none), F.col("place.h").alias(h)).agg(F.collect_list(F.struct("place", "alone")).alias(gone))
    unsure = materialize(unsure, "unsure")
    ends = lambda x: F.transform(gone, lambda c: F.struct(c["place"].alias("place"), c["alone"].alias("alone"), F.get(x, c["place"]["start"]).alias("a"), F.get(x, c["place"]["end"] - 1).alias("b")))
    told = keyed.select(key, none, h, text_col).join(unsure, [key, none, h]).select(F.explode(let(F.split(text_col, "\n"), ends)).alias("c"))
    told = told.groupBy("c.alone", "c.a", "c.b").agg(F.min("c.place").alias("place")).select(F.col("place.key").alias(key), F.col("place.none").alias(none), F.col("place.h").alias(h), F.struct("place.start", "place.end").alias("span"))
    kept = materialize(told.groupBy(key, none, h).agg(F.collect_set("span").alias(back)), "kept")

    found = keyed.join(by_doc, [key, none, h], "left").join(kept, [key, none, h], "left")
    stays = lambda s: F.coalesce(F.array_contains(back, F.struct(s["start"], s["end"])), F.lit(False))
    spans = lambda fine: F.filter(gone, lambda s: (s["fine"] & ~s["first"] & ~stays(s)) if fine else ~s["fine"])
    lines = F.split(text_col, "\n")
    found = found.withColumn(held, F.when(F.isnull(gone), F.array().cast("array<int>")).otherwise(_gone(lines, spans(False), spans(True))))
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(held))
    rest = let(lines, lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x, i)), "\n"))
    found = found.withColumn(out, F.when(F.size(held) > 0, rest).otherwise(F.col(text_col).cast("string")))
    n_of = F.coalesce(F.size(chunk_ends(F.split(text_col, "\n"), divisor)), F.lit(0)).cast("bigint")
    columns = [F.col(out).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    counted = F.when(F.isnull(gone), 0).otherwise(F.size(spans(False))).cast("bigint")
    return found.select(*columns, F.when(F.isnull(text_col), 0).otherwise(n_of).cast("bigint").alias(n_all), counted.alias(n_gone), F.size(held).cast("bigint").alias(n_lines))
