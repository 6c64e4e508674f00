"""A reserved test from several sources: declared label orders, quotas in seeded order, no text that a reference or the test itself holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import prob, text
from assay.storage import bounded_batches, materialize

KEPT = "source string, id string, state string, label int, place long, extra string, content string"


@dataclass(frozen=True)
class Source:
    """``rows`` as ``training.scanned`` makes them; the first ``count`` that pass are taken, of labels below ``width``."""

    name: str
    rows: DataFrame
    width: int
    count: int


def check_labels(rows: DataFrame, index: str, name: str, expected: list[str]) -> None:
    """Fails unless the source's own names of its labels (index, name) are the ``expected`` ones, in their order.

    Nulls count as a name of their own. No more names than expected, and one, reach the driver.
    """
    found = rows.select(F.col(index).cast("int").alias("i"), F.col(name).alias("name")).distinct().limit(len(expected) + 1).collect()
    if sorted((r["i"], r["name"] or "") for r in found if r["i"] is not None) != list(enumerate(expected)) or any(r["i"] is None or r["name"] is None for r in found):
        raise ValueError(f"the order of labels is not {expected}")


def _marked(rows: DataFrame, reference: DataFrame, taken: DataFrame) -> DataFrame:
    """``rows`` with ``content``, ``leaked`` and ``duplicate``; a row is a duplicate of one taken before, or of an earlier place."""
    keyed = rows.withColumn("content", text.content_key(text.json_string(F.col("state"))))
    own = F.array("content", F.concat(F.lit("example:"), "source", F.lit(":"), F.col("place").cast("string")), F.concat(F.lit("group:"), "source", F.lit(":"), F.col("place").cast("string")))
    keyed = materialize(keyed.withColumn("keys", own), "reserved")
    leaks = keyed.select("place", F.explode("keys").alias("key")).join(reference, "key", "left_semi").select("place").distinct().withColumn("leaked", F.lit(True))
    held = keyed.drop("keys").join(leaks, "place", "left").withColumn("leaked", F.coalesce("leaked", F.lit(False)))
    held = held.join(taken.select("content", F.lit(True).alias("seen")), "content", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    firsts = held.filter("not leaked and not seen").groupBy("content").agg(F.min("place").alias("first"))
    return held.join(firsts, "content", "left").withColumn("duplicate", ~F.col("leaked") & (F.col("seen") | (F.col("place") != F.col("first")))).drop("seen", "first")


def reserve(sources: list[Source], reference: DataFrame, prefix: str = "reserved") -> tuple[DataFrame, DataFrame]:
    """(examples, dropped): examples of each source in turn, and (source, leaked, duplicate) counts of rows passed over.

    ``reference`` is a table of leakage keys. A source is read in the order of its places until its count is
    full; rows after that are neither taken nor counted. A row is leaked where the reference holds one of its
    keys, and a duplicate where its content has been taken, from this source or an earlier one. A source that
    runs out, and a label outside its options, is an error. There are few sources, each with a count of its
    own, so the loop over them is short; their rows are never gathered.
    """
    if len({s.name for s in sources}) < len(sources) or not sources:
        raise ValueError("sources are named once each")
    spark = sources[0].rows.sparkSession
    bounded_batches(spark)
    reference = materialize(reference.select("key").distinct(), "reference")  # hashed once for all sources
    taken, counts = spark.createDataFrame([], KEPT), []
    for s in sources:
        rows = s.rows.withColumn("source", F.concat(F.lit(f"{prefix}:"), F.lit(s.name)))
        marked = materialize(_marked(rows, reference, taken), "marked")
        kept = materialize(marked.filter("not leaked and not duplicate").orderBy("place").limit(s.count), "kept")
        n = kept.agg(F.count("*").alias("n"), F.max("place").alias("last")).first()
        if n["n"] < s.count:
            raise ValueError(f"{s.name}: only {n['n']} of {s.count} rows are left")
        outside = ~F.coalesce(F.col("label").between(0, s.width - 1), F.lit(False))
        seen = marked.filter(F.col("place") <= (-1 if n["last"] is None else n["last"])).agg(F.count_if("leaked").alias("leaked"), F.count_if("duplicate").alias("duplicate"), F.count_if(outside).alias("outside")).first()
        if seen["outside"]:
            raise ValueError(f"{s.name}: {seen['outside']} labels outside {s.width} answers")
        counts.append((s.name, seen["leaked"], seen["duplicate"]))
        taken = taken.unionByName(kept.select(taken.columns))
    widths = F.create_map(*[F.lit(x) for s in sources for x in (f"{prefix}:{s.name}", s.width)])
    name = F.concat("source", F.lit(":"), F.col("place").cast("string"))
    examples = taken.withColumns({"row_id": F.col("id"), "id": name, "group_id": name, "target": prob.one_hot(F.col("label"), F.element_at(widths, F.col("source"))), "target_origin": F.lit("gold")})
    return examples, spark.createDataFrame(counts, "source string, leaked long, duplicate long")
