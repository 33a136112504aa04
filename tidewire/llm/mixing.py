"""Mixing sources to target weights by hash thresholds.

Every document gets a 60-bit hash. Sizes are summed by source and leading hash digits; the
running sum over those buckets tells which of them fit the source's budget whole, and which one
the budget's edge lies in. Only that bucket is looked at again, by the next digits, until it
holds one document or no digits are left. A document is taken when its hash lies before the
edge. Budgets are nested: a larger one keeps all that a smaller one took. No documents are
sorted, and the sums are combined before they are shuffled, so a large source is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Bits a level: so many buckets a source at most are summed at each level.
BITS = 12
LEVELS = 5
#: No document is taken more often.
MOST = 3
#: Per-source tables of up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size) with weight and target. Weights 1, 2, 3 repeat by code point, null last.

    A source is full when its share of what the others leave reaches its cap. Shares fill up in
    the order of cap over weight: in that order, the running sums tell for each source whether
    it is full when all before it are. One row a source is all that the windows see.
    """
    everything = Window.partitionBy(F.lit(1))
    by_name = everything.orderBy(F.col("source").isNull(), F.col("source"))
    s = sources.withColumn("weight", (1 + (F.row_number().over(by_name) - 1) % 3).cast("double"))
    s = s.withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double")).withColumn("total", F.sum("source_size").over(everything).cast("double"))
    fill = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    since = fill.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(since))
    s = s.withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    # the first source that is not full has the largest such level, and all later ones share it
    s = s.withColumn("edge", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    return s.select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("edge")).alias("target"))


def _with(rows: DataFrame, per_source: DataFrame, n: int, how: str = "left") -> DataFrame:
    """rows joined with a table that has one row a source, in column ``s``; broadcast only if that many rows are few."""
    return rows.join(F.broadcast(per_source) if n <= BROADCAST_ROWS else per_source, F.col("source").eqNullSafe(F.col("s")), how)


def _digits(level: int) -> Column:
    """The leading digits of the hash; past its last, those of the tie-breaking hash."""
    return F.shiftright("h", 60 - BITS * level) if level <= LEVELS else F.shiftright("h2", 60 - BITS * (level - LEVELS))


def _hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, text, ...) with size, h and h2. Only rows alike in id, source and text share h; h2 tells them apart by row number."""
    row = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in ("doc_id", "source", "text")))
    return docs.withColumns({"size": size(F.col("text")), "h": _hash(row), "h2": _hash(F.monotonically_increasing_id().cast("string"))})


def thresholds(sized: DataFrame, most: int = MOST) -> tuple[DataFrame, int, int]:
    """Per source s: source_size, target, rounds, rest, and the edge of the rest at the returned level; and the number of sources.

    sized has source, size, h and h2, and is read once a level; give a written table.
    """
    rates = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most), "targets")
    n = rates.count()
    ratio = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    rates = rates.select(F.col("source").alias("s"), "source_size", "target", F.floor(ratio + 1e-12).cast("long").alias("rounds"))
    rates = rates.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("rounds") * F.col("source_size")))
    open_, parts = rates.filter("rest > 0").select("s", F.col("rest").alias("budget")), sized.select("source", "size", "h", "h2")
    for level in range(1, 2 * LEVELS + 1):
        sums = parts.groupBy("source", _digits(level).alias("b")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.max("h").alias("eh"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("b"))
        over = _with(sums, open_, n, "inner").withColumn("run", run).filter("run > budget")
        first = F.min_by(F.struct("b", "eh", "rows", (F.col("budget") - F.col("run") + F.col("words")).alias("budget")), "b")
        edge = materialize(over.groupBy("source").agg(first.alias("x")).select(F.col("source").alias("s"), "x.*"), f"edge{level}")
        crowd = edge.agg(F.max("rows")).first()[0]
        if crowd is None or crowd == 1 or level == 2 * LEVELS:
            break
        open_ = edge.select("s", "budget")
        parts = _with(parts, edge.select("s", "b"), n, "inner").filter(_digits(level) == F.col("b")).drop("s", "b")
    return materialize(rates.join(edge.select(F.col("s").alias("s_"), "b", "eh"), F.col("s").eqNullSafe(F.col("s_")), "left").drop("s_"), "thresholds"), level, n


def copies(level: int, most: int = MOST) -> Column:
    """How often a row is taken, given its source's thresholds."""
    before = _digits(level) < F.col("b")
    if level > LEVELS:
        before = (F.col("h") < F.col("eh")) | ((F.col("h") == F.col("eh")) & before)
    extra = (F.col("rest") > 0) & (F.col("b").isNull() | before)
    return F.least(F.col("rounds") + extra.cast("long"), F.lit(most).cast("long"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", most: int = MOST) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, copies (times that it is taken).

    A source's taken words are whole rounds of it, then its documents before the edge; they
    fall short of the target by less than the size of its next document. Null sources are one
    source; null and empty texts have size 0. Rows alike in id, text and source are taken
    one by one; which of them makes no difference. An empty table gives no rows.
    """
    d = keyed(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))).drop("text")
    d = materialize(d, "sizes")
    per_source, level, n = thresholds(d, most)
    return _with(d, per_source, n).withColumn("copies", copies(level, most)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, most: int = MOST) -> DataFrame:
    """docs as mixed: each row as often as the mix takes it, with docs' own columns only."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("row", *(F.col(f"row.{c}").alias(c) for c in ("doc_id", "source", "text")))
    # written once with the rows, so that the thresholds and the filter see the same hashes whatever the plan
    sized = materialize(keyed(rows).drop("doc_id", "text"), "sizes")
    per_source, level, n = thresholds(sized.drop("row"), most)
    taken = _with(sized, per_source, n).withColumn("copies", copies(level, most)).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
