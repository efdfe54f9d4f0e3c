"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import WORD, keep, unused


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): sizes has one row (source, source_size) for each source, of which null is one.

    Sources in code point order, null last, get the weights in turn. target is least(level x weight, most x size),
    with the level at which the targets sum to share x all sizes: sources reach their bound in the order of
    bound / weight, and the level is the first at which no further source is above its bound. The windows run over
    one row for each source."""
    by_name = W.Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    s = sizes.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), k.cast("int")).alias("w"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("at", F.col("cap") / F.col("w"))
    order = W.Window.orderBy("at", F.col("source").asc_nulls_last())
    upto = order.rowsBetween(W.Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.Window.unboundedFollowing)
    total = F.sum("source_size").over(W.Window.partitionBy()) * F.lit(float(share))
    s = s.withColumn("level", F.greatest(total - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)), F.lit(0.0)) / F.sum("w").over(rest))
    level = F.max(F.when(F.col("level") <= F.col("at"), F.col("level"))).over(W.Window.partitionBy())
    return s.select("source", "source_size", F.least(F.coalesce(level, F.lit(float("inf"))) * F.col("w"), F.col("cap")).alias("target"))


#: One step of the rounding: the unit at hand (res) meets the next (x); words move between them, in the direction drawn, until one has 0 or 1 copies.
_UNIT = "struct<size: bigint, unit: bigint, copy: int, part: double>"
_FOLD = f"""
aggregate(
  slice(units, 2, size(units)),
  struct(units[0] AS res, cast(array() AS array<{_UNIT}>) AS done),
  (acc, x) -> CASE
    WHEN (cast(pmod(xxhash64(acc.res.unit, acc.res.copy, x.unit, x.copy, {{seed}}L), 9007199254740992) AS double) + 0.5) / 9007199254740992
         * (least((1 - acc.res.part) * acc.res.size, x.part * x.size) + least(acc.res.part * acc.res.size, (1 - x.part) * x.size))
         <= least(acc.res.part * acc.res.size, (1 - x.part) * x.size)
    THEN CASE
      WHEN (1 - acc.res.part) * acc.res.size <= x.part * x.size
      THEN struct(named_struct('size', x.size, 'unit', x.unit, 'copy', x.copy, 'part', greatest(0D, x.part - (1 - acc.res.part) * acc.res.size / x.size)) AS res,
                  concat(acc.done, array(named_struct('size', acc.res.size, 'unit', acc.res.unit, 'copy', acc.res.copy, 'part', 1D))) AS done)
      ELSE struct(named_struct('size', acc.res.size, 'unit', acc.res.unit, 'copy', acc.res.copy, 'part', least(1D, acc.res.part + x.part * x.size / acc.res.size)) AS res,
                  concat(acc.done, array(named_struct('size', x.size, 'unit', x.unit, 'copy', x.copy, 'part', 0D))) AS done) END
    ELSE CASE
      WHEN acc.res.part * acc.res.size <= (1 - x.part) * x.size
      THEN struct(named_struct('size', x.size, 'unit', x.unit, 'copy', x.copy, 'part', least(1D, x.part + acc.res.part * acc.res.size / x.size)) AS res,
                  concat(acc.done, array(named_struct('size', acc.res.size, 'unit', acc.res.unit, 'copy', acc.res.copy, 'part', 0D))) AS done)
      ELSE struct(named_struct('size', acc.res.size, 'unit', acc.res.unit, 'copy', acc.res.copy, 'part', greatest(0D, acc.res.part - (1 - x.part) * x.size / acc.res.size)) AS res,
                  concat(acc.done, array(named_struct('size', x.size, 'unit', x.unit, 'copy', x.copy, 'part', 1D))) AS done) END
  END)"""


def _meet(open_units: DataFrame, group: list, seed: int) -> DataFrame:
    """Folds each group of units: (sid, done array, res) with one unit left open in each."""
    units = F.sort_array(F.collect_list(F.struct("size", "unit", "copy", "part")), asc=False).alias("units")
    folded = open_units.groupBy("sid", *group).agg(units)
    return folded.select("sid", F.expr(_FOLD.format(seed=seed)).alias("f")).select("sid", "f.res", "f.done")


def pivotal_rounding(units: DataFrame, arity: int = 64, seed: int = 7) -> DataFrame:
    """(sid, unit, copy, size, up 0 or 1): rounds the fractions of units (sid, unit, copy, size, part) source by source.

    (unit, copy, size) tells the units of a source apart.

    Units of one source and one size class (log2) are dealt by a hash into groups of about ``arity``. In a group two
    units at a time are paired and words move between them, at random but with each part's mean kept, until one has a
    whole number; the source's words stay the same. Each group leaves one open unit, and these meet again in the next
    level of the tree, class by class, then across classes; a level has 1 / arity of the rows of the one before, and
    no group outgrows a few arities however frequent the source. The last open unit of a source goes to the nearer
    whole number. Then units are turned over where that brings the source's words nearer to their sum, from the largest
    size on, and at last one up and one down; the largest unit of each quarter of a class is a candidate, at most some
    200 of a source."""
    size_class = F.floor(F.log2(F.col("size"))).cast("int")
    start = units.select("sid", "unit", "copy", "size", "part", size_class.alias("class"))
    level, left, done = 0, start, []
    while True:
        counts = left.groupBy("sid", "class").agg(F.count("*").alias("n"))
        groups = F.greatest(F.lit(1), F.ceil(F.col("n") / arity)).cast("int")
        deal = keep(counts.select("sid", "class", groups.alias("groups")), "counts")
        most = deal.agg(F.max("groups"), F.count("*")).first()
        if most[1] == 0:
            break
        grouped = left.join(deal, ["sid", "class"]).withColumn("grp", F.pmod(F.xxhash64("unit", "copy", F.lit(level)), F.col("groups").cast("long")))
        met = keep(_meet(grouped, ["class", "grp"], seed + level), f"level{level}")
        done.append(met.select("sid", F.explode("done").alias("d")))
        left = met.select("sid", "res.unit", "res.copy", "res.size", "res.part").withColumn("class", size_class)
        level += 1
        if most[0] == 1:
            break
    # One open unit for each class is left: at most 64 of a source.
    met = keep(_meet(left, [], seed + level), "roots")
    done.append(met.select("sid", F.explode("done").alias("d")))
    last = met.select("sid", F.struct("res.size", "res.unit", "res.copy", F.when(F.col("res.part") >= 0.5, 1.0).otherwise(0.0).alias("part")).alias("d"))
    done.append(last)
    rounded = done[0]
    for x in done[1:]:
        rounded = rounded.unionByName(x)
    rounded = keep(rounded.select("sid", "d.unit", "d.copy", "d.size", F.col("d.part").cast("int").alias("up")), "rounded")
    want = units.groupBy("sid").agg(F.sum(F.col("part") * F.col("size")).alias("want"))
    have = rounded.groupBy("sid").agg(F.sum(F.col("up") * F.col("size")).alias("have"))
    pick = F.max_by(F.struct("size", "unit", "copy", "up"), F.struct("size", F.xxhash64("unit", "copy"), "unit", "copy"))
    choice = rounded.groupBy("sid", "up", F.floor(4 * F.log2("size")).alias("class")).agg(pick.alias("c"))
    choice = choice.groupBy("sid").agg(F.sort_array(F.collect_list("c"), asc=False).alias("cs"))
    greedy = """aggregate(cs, struct(gap AS gap, cast(array() AS array<struct<size: bigint, unit: bigint, copy: int, up: int>>) AS turned),
      (acc, c) -> CASE WHEN abs(acc.gap - (1 - 2 * c.up) * c.size) < abs(acc.gap)
        THEN struct(acc.gap - (1 - 2 * c.up) * c.size AS gap, concat(acc.turned, array(c)) AS turned) ELSE acc END)"""
    none = "array(named_struct('size', 0L, 'unit', 0L, 'copy', 0, 'up', -1))"
    pair = f"""array_min(flatten(transform(concat({none}, filter(rest, c -> c.up = 0)),
      x -> transform(concat({none}, filter(rest, c -> c.up = 1)), y -> named_struct('off', abs(g.gap - x.size + y.size), 'x', x, 'y', y)))))"""
    gaps = choice.join(want.join(have, "sid").select("sid", (F.col("want") - F.col("have")).alias("gap")), "sid")
    gaps = gaps.select("sid", "cs", F.expr(greedy).alias("g")).withColumn("rest", F.array_except("cs", "g.turned"))
    best = gaps.select("sid", "g.turned", F.expr(pair).alias("b"))
    best = best.select("sid", F.explode(F.concat("turned", F.array("b.x", "b.y"))).alias("t")).where("t.up >= 0")
    turned = best.select("sid", "t.unit", "t.copy", "t.size", F.lit(True).alias("turn"))
    out = rounded.join(turned, ["sid", "unit", "copy", "size"], "left")
    return out.select("sid", "unit", "copy", "size", F.when(F.col("turn"), 1 - F.col("up")).otherwise(F.col("up")).alias("up"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row: how often the mix takes each document.

    A document of a source with target / source_size = e gets floor(e) or floor(e) + 1 copies, by pivotal_rounding();
    taken is copies x size. The draw depends on ids and the seed alone, so reruns agree.

    A null text has size 0, a null source is a source of its own. Rows of size 0 and sources of size 0 are taken 0
    times. Rows with equal id, source and size are told apart by a number, whichever is which; null ids too. An empty
    table gives an empty one; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = keep(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    # A source is known below by a 64-bit hash of its name with a mark for null.
    sid = F.xxhash64(F.col("source").isNull(), "source")
    targets = keep(targets.withColumn("sid", sid).withColumn("e", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "targets")
    each = rows.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    # Rows without an id have negative numbers, so that no id is mistaken for theirs.
    known = F.col("doc_id").isNotNull()
    each = each.select("doc_id", "source", "size", sid.alias("sid"), F.when(known, F.col("doc_id")).otherwise(0).cast("long").alias("unit"), F.when(known, F.col("copy")).otherwise(-F.col("copy")).alias("copy"))
    units = each.join(targets.select("sid", (F.col("e") - F.floor("e")).alias("part")), "sid").where("size > 0")
    rounded = pivotal_rounding(units.select("sid", "unit", "copy", "size", "part"), seed=seed)
    out = each.join(targets.select("sid", "source_size", "target", "e"), "sid").join(rounded, ["sid", "unit", "copy", "size"], "left")
    copies = F.when(F.col("size") > 0, F.floor("e") + F.coalesce("up", F.lit(0))).otherwise(0).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with each row as often as mix_sources() takes it, 0 to 2 times; all columns stay as they are, whatever their names.

    Rows of one id, source and size, null ids too, are taken as often in all as their draws say, in an order of their
    texts' hashes. Rows of size 0, so null and empty texts, go; a null source is one of its own; an empty table gives
    an empty one. The copies grow with the documents, so they are never broadcast: both sides are shuffled, at every
    size, very long texts too."""
    mix = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    c_id, c_source, c_size, c_words, c_rows, c_copies, c_rank = unused(docs, "id", "source_", "size", "words", "rows", "copies", "rank")
    copies = mix.groupBy(F.col("doc_id").alias(c_id), F.col("source").alias(c_source), F.col("size").alias(c_size)).agg(F.count(F.lit(1)).alias(c_rows), F.sum("copies").alias(c_copies))
    copies = keep(copies.where(F.col(c_copies) > 0), "copies")
    same = F.col(id_col).eqNullSafe(F.col(c_id)) & F.col(source_col).eqNullSafe(F.col(c_source)) & (F.col(c_words) == F.col(c_size))
    out = docs.withColumn(c_words, word_count(F.col(text_col))).join(copies.hint("merge"), same)
    times = F.col(c_copies)
    if copies.where(F.col(c_rows) > 1).limit(1).count():
        alike = W.Window.partitionBy(c_id, c_source, c_size).orderBy(F.xxhash64(F.col(text_col)))
        many = out.where(F.col(c_rows) > 1).withColumn(c_rank, F.row_number().over(alike))
        out = out.where(F.col(c_rows) == 1).withColumn(c_rank, F.lit(1)).unionByName(many)
        times = F.floor(times / F.col(c_rows)) + F.when(F.col(c_rank) <= times % F.col(c_rows), 1).otherwise(0)
    out = out.withColumn(c_copies, times.cast("int")).where(F.col(c_copies) > 0)
    return out.withColumn(c_rank, F.explode(F.sequence(F.lit(1), F.col(c_copies)))).select(docs.columns)
