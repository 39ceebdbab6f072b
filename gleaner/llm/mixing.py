"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target words over its size give every document the same number of copies;
the whole part is taken and the fraction is rounded so that the source's words stay
near the target.  Rounding pairs two open documents and moves mass between them (one
gains what the other loses, in words) until one is taken or left, with probabilities
that keep each document's expected copies.  Documents are dealt by hash into blocks of
about BLOCK; a block is one fold that ends with at most one open document, and open
documents of many blocks are blocks of the next level, until a source is one block.
The last open document of a source goes to its nearer side, so a source misses its
target by at most half a document.

Rows alike in id, size and source are one item with a count: together they take the whole
part of their mass, in rows, and only the fraction that is left is rounded, so however
many rows have one id or none, blocks stay small.  Draws are hashes of the two documents
and a seed, so reruns agree.

Defined results: null text has size 0 and takes 0; null source is the last source; a
source without words has target 0; repeated rows count each; of rows alike in id, size
and source the first in order of the text's hash are taken first; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating; the mix's words in percent of all; copies at most.
WEIGHTS, SHARE, MOST = (3, 1, 2), 150, 2
#: Documents that one fold rounds, about.
BLOCK = 256
SEED = 7
#: An item of more than one in so many rows is hot.
HOT = 1000
#: Rows of one item that are listed at once.
LISTED = 65_536


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", sized_text())


def sized_text():
    return F.coalesce(F.expr(f"regexp_count(text, r'{WORD}')"), F.lit(0)).cast("long")


def source_targets(rows: DataFrame) -> DataFrame:
    """Rows (source, n, source_size, target) from rows (source, size, m), n items each: shares by weight, filled up to MOST times a source's size.

    A source stays below its cap only if the common level (words a weight) is below its
    cap over its weight, so with sources in order of that ratio the level is that of the
    first source which it doesn't fill.
    """
    sums = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("m")).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # a row a source
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")).cast("double")
    sums = sums.withColumn("w", weight).withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
    sums = sums.withColumn("ratio", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("total", F.sum("source_size").over(everything) * F.lit(SHARE / 100))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    sums = sums.withColumn("level", level).withColumn("at", F.row_number().over(order))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(everything)
    sums = sums.withColumn("level", first["level"])
    return sums.select("source", "n", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


#: Id, size, open fraction, whether the id is null, rows of the item, and rows that are settled as taken.
ITEM = "struct<d:bigint,z:bigint,f:double,u:bigint,m:bigint,s:bigint>"


def _fold(items: str, last: str) -> str:
    """SQL: round the open items of a block; struct(out: settled items with copies, open: what is still open)."""
    eps = "1e-9"
    # x is the open item, y the next; both in words: room is what may move without leaving [0, 1]
    up = "least((1 - a.open.f) * a.open.z, y.f * y.z)"  # from y to x
    down = "least(a.open.f * a.open.z, (1 - y.f) * y.z)"  # from x to y
    draw = f"(pmod(xxhash64(a.open.d, a.open.u, y.d, y.u, {SEED}), 1000003) + 0.5D) / 1000003"
    gain = f"if({draw} * ({up} + {down}) < {down}, {up}, -({down}))"  # in words, to x
    x_f, y_f = f"(a.open.f + ({gain}) / a.open.z)", f"(y.f - ({gain}) / y.z)"
    item = lambda d, f: f"named_struct('d', {d}.d, 'z', {d}.z, 'f', cast({f} as double), 'u', {d}.u, 'm', {d}.m, 's', {d}.s)"
    whole = lambda f: f"({f} < {eps} or {f} > 1 - {eps})"
    none = f"cast(null as {ITEM})"
    step = f"""case
        when y.z = 0 or {whole('y.f')} then named_struct('out', array_append(a.out, {item('y', 'round(y.f)')}), 'open', a.open)
        when a.open is null then named_struct('out', a.out, 'open', y)
        else transform(array(named_struct('x', {item('a.open', x_f)}, 'y', {item('y', y_f)})), p -> case
            when {whole('p.x.f')} and {whole('p.y.f')} then named_struct('out', array_append(array_append(a.out, {item('p.x', 'round(p.x.f)')}), {item('p.y', 'round(p.y.f)')}), 'open', {none})
            when {whole('p.x.f')} then named_struct('out', array_append(a.out, {item('p.x', 'round(p.x.f)')}), 'open', p.y)
            else named_struct('out', array_append(a.out, {item('p.y', 'round(p.y.f)')}), 'open', p.x) end)[0] end"""
    start = f"named_struct('out', cast(array() as array<{ITEM}>), 'open', {none})"
    alone = "s.open.f >= 0.5D"
    finish = f"""s -> case when {last} and s.open is not null
        then named_struct('out', array_append(s.out, {item('s.open', f'if({alone}, 1, 0)')}), 'open', {none}) else s end"""
    return f"aggregate({items}, {start}, (a, y) -> {step}, {finish})"


def keys() -> dict[str, Column]:
    """Non-null columns that say which rows are alike."""
    null = lambda c: F.when(F.col(c).isNull(), 1).otherwise(0).cast("long")
    return {"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "u": null("doc_id"), "k": F.coalesce("source", F.lit("")), "v": null("source"), "z": F.col("size")}


def decided(docs: DataFrame) -> DataFrame:
    """Items (d, u, k, v, z, m, source_size, target, whole, s, f): each of the m rows takes whole copies, the first s one more, the next f."""
    rows = cut(sized(docs.select("doc_id", "source", "text")).drop("text").withColumns(keys()).groupBy("source", *keys()).agg(F.count("*").alias("m")))
    targets = cut(source_targets(rows.withColumn("size", F.col("z"))))
    most = targets.agg(F.max("n")).first()[0] or 0
    copies = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0))
    targets = targets.withColumnRenamed("source", "of").withColumn("whole", F.floor(copies + 1e-9)).withColumn("part", F.greatest(copies - F.col("whole"), F.lit(0.0)))
    level = rows.join(targets, rows["source"].eqNullSafe(targets["of"])).withColumn("mass", F.col("part") * F.col("m"))
    level = level.withColumn("s", F.floor(F.col("mass") + 1e-9)).withColumn("f", F.greatest(F.col("mass") - F.col("s"), F.lit(0.0)))
    group, done, blocks = ["k", "v", "n", "source_size", "target", "whole", "part"], [], most
    depth = 0
    while True:
        blocks = -(-blocks // BLOCK)
        parts = F.greatest(F.ceil(F.col("n") / float(BLOCK ** (depth + 1))), F.lit(1))
        level = level.withColumn("part", F.pmod(F.xxhash64("d", "z", "u", F.lit(SEED + depth)), parts))
        folded = level.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("z", "d", "u", "f", "m", "s")), asc=False).alias("i"))
        folded = folded.withColumn("i", F.expr("transform(i, x -> named_struct('d', x.d, 'z', x.z, 'f', x.f, 'u', x.u, 'm', x.m, 's', x.s))"))
        folded = cut(folded.select(*group, F.expr(_fold("i", str(blocks <= 1).lower())).alias("r")))
        done.append(folded.select(*group, F.explode("r.out").alias("x")))
        if blocks <= 1:
            break
        level = folded.where("r.open is not null").select(*group[:-1], "r.open.*")
        depth += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("x.d", "x.u", "k", "v", "x.z", "x.m", "source_size", "target", "whole", "x.s", F.round("x.f").cast("long").alias("f"))


#: Copies that the row i of an item takes.
COPIES = "whole + if(i <= s, 1, if(i = s + 1, f, 0))"


def mix(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one for each row of docs."""
    # an item's rows are listed in runs, so that none is an array of them all
    each = decided(docs).withColumn("j", F.expr(f"explode(sequence(0, (m - 1) div {LISTED}))"))
    each = each.withColumn("i", F.expr(f"explode(sequence(j * {LISTED} + 1, least(m, (j + 1) * {LISTED})))"))
    return each.selectExpr("if(u = 0, d, null) doc_id", "z size", "source_size", "target", f"cast(({COPIES}) * z as long) taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it, with their columns.

    Rows without words are taken as often as the rounded copies of their source say at
    least.
    """
    names = docs.columns
    key = F.struct(*((sized_text() if k == "z" else c).alias(k) for k, c in keys().items()))
    rows = docs.withColumns({"__key": key, "__h": F.xxhash64("text")})
    items = decided(docs).select(F.struct(*keys()).alias("__key"), "m", F.struct("whole", "s", "f", "source_size").alias("__x"))
    total = items.agg(F.sum("m")).first()[0] or 0
    hot = items.where((F.col("m") > 1) & (F.col("m") * HOT > total)).drop("m")  # fewer than HOT items
    rows = rows.join(F.broadcast(hot.select("__key", F.lit(0).alias("__hot"))), "__key", "left")
    # a hot item's rows are dealt to 256 parts by the upper bits of their hash, so parts are in order of the hash
    rows = rows.withColumn("__p", F.coalesce(F.shiftright("__h", 56).cast("int") + F.col("__hot"), F.lit(0))).drop("__hot")
    counts = rows.join(F.broadcast(hot.select("__key")), "__key", "left_semi").groupBy("__key", "__p").count()
    before = Window.partitionBy("__key").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__key", "__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__o"))
    cold = items.drop("m").join(F.broadcast(hot.select("__key")), "__key", "left_anti").withColumns({"__p": F.lit(0), "__o": F.lit(0).cast("long")})
    joined = rows.join(cold.unionByName(offsets.join(F.broadcast(hot), "__key")).hint("merge"), ["__key", "__p"])
    number = F.row_number().over(Window.partitionBy("__key", "__p").orderBy("__h"))
    joined = joined.withColumn("__i", number + F.col("__o"))
    n = F.expr("if(__key.z = 0, if(__x.source_size = 0, 1, __x.whole), __x.whole + if(__i <= __x.s, 1, if(__i = __x.s + 1, __x.f, 0)))").cast("int")
    return joined.withColumn("__n", n).where("__n > 0").withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*names)
