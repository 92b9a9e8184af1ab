"""Mixing sources to target weights by pivotal dependent rounding, on built-in functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchlens.llm.common import WORD, free_name, let
from pitchlens.staging import stage

#: Units that one step of the reduction tree pairs with one another.
FAN_IN = 64
UNIT = "struct<size:bigint,doc_id:bigint,copy:int,p:double>"
DONE = "array<struct<doc_id:bigint,copy:int,size:bigint,take:int>>"


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """``source``, ``n``, ``source_size``, ``target`` from rows of ``source``, ``size``, ``rows``.

    Sources in code point order, null last, take the weights in turn and share ``share`` of all
    sizes by them. A target stops at ``most`` times its source's size; the excess goes to the others
    by weight until none is above. Only sums over sources reach the driver.
    """
    per = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.sum(F.when(F.col("size") > 0, F.col("rows")).otherwise(0)).alias("n"),
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))) + 1)
    per = stage(per.withColumn("weight", weight.cast("double")), "mix-sources")
    cap = F.col("source_size") * F.lit(float(most))
    wanted = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, None
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        now = per.agg(
            F.count(F.when(full, 1)).alias("n"),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("words"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if now.n == stopped or not now.weight:
            break
        stopped, level = now.n, max(level, (wanted - now.words) / now.weight)
    return per.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def _chance(seed: int, *parts: Column) -> Column:
    """A number from [0, 1) that depends on the values alone, so reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(1 << 53))


def _pair(seed: int):
    """One pivotal step: the open unit meets the next; words move until one is decided.

    The words that the two are expected to give stay the same, and so does each chance.
    """

    def decided(u: Column, take) -> Column:
        return F.array(
            F.struct(u["doc_id"].alias("doc_id"), u["copy"].alias("copy"), u["size"].alias("size"),
                     F.lit(take).cast("int").alias("take"))
        )

    def open_(u: Column, p: Column) -> Column:
        return F.struct(
            u["size"].alias("size"), u["doc_id"].alias("doc_id"), u["copy"].alias("copy"), p.alias("p")
        )

    def step(acc: Column, x: Column) -> Column:
        o = acc["open"]

        def result(done: Column, rest: Column) -> Column:
            return F.struct(F.concat(acc["done"], done).cast(DONE).alias("done"), rest.cast(UNIT).alias("open"))

        def move(m: Column) -> Column:
            """m: words to raise ``o`` and lower ``x`` by, at most; and the other way round."""
            up = _chance(seed, o["doc_id"], o["copy"], x["doc_id"], x["copy"]) * (m["a"] + m["b"]) < m["b"]
            o_full, x_room = (1 - o["p"]) * o["size"], x["p"] * x["size"]
            o_room, x_full = o["p"] * o["size"], (1 - x["p"]) * x["size"]
            none = F.lit(None).cast(UNIT)
            return (
                F.when(up & (o_full == x_room), result(F.concat(decided(o, 1), decided(x, 0)), none))
                .when(up & (o_full < x_room), result(decided(o, 1), open_(x, x["p"] - m["a"] / x["size"])))
                .when(up, result(decided(x, 0), open_(o, o["p"] + m["a"] / o["size"])))
                .when(o_room == x_full, result(F.concat(decided(o, 0), decided(x, 1)), none))
                .when(o_room < x_full, result(decided(o, 0), open_(x, x["p"] + m["b"] / x["size"])))
                .otherwise(result(decided(x, 1), open_(o, o["p"] - m["b"] / o["size"])))
            )

        moved = let(
            F.struct(
                F.least((1 - o["p"]) * o["size"], x["p"] * x["size"]).alias("a"),
                F.least(o["p"] * o["size"], (1 - x["p"]) * x["size"]).alias("b"),
            ),
            move,
        )
        nothing = F.lit(None).cast(DONE)
        return F.when(o.isNull(), result(F.coalesce(nothing, F.array().cast(DONE)), open_(x, x["p"]))).otherwise(moved)

    return step


def _round(units: DataFrame, largest: int, seed: int) -> DataFrame:
    """Decide all units: blocks of about ``FAN_IN`` per source, then their residuals, and so on.

    A block goes through its units from the largest down, which leaves small residuals. The last
    residual of a source is rounded to the nearer side. ``units``: source, blocks (of its level), unit. ``largest``: units of the largest source.
    """
    decided = []
    level = 0
    while True:
        level += 1
        block = F.pmod(
            F.xxhash64(F.lit(seed + level), F.col("unit.doc_id"), F.col("unit.copy")), F.col("blocks")
        )
        grouped = units.withColumn("block", block).groupBy("source", "blocks", "block").agg(
            F.sort_array(F.collect_list("unit"), asc=False).alias("units")
        )
        start = F.struct(F.array().cast(DONE).alias("done"), F.lit(None).cast(UNIT).alias("open"))
        paired = grouped.select(
            "source", "blocks", F.aggregate("units", start, _pair(seed + level)).alias("r")
        )
        paired = stage(paired.select("source", "blocks", "r.done", "r.open"), f"mix-level-{level}")
        decided.append(paired.select("source", F.explode("done").alias("d")).select("source", "d.*"))
        rest = paired.filter(F.col("open").isNotNull()).select("source", "blocks", F.col("open").alias("unit"))
        largest = math.ceil(largest / FAN_IN)
        if largest <= 1:
            last = F.col("unit.p") >= 0.5
            decided.append(
                rest.select("source", "unit.doc_id", "unit.copy", "unit.size", last.cast("int").alias("take"))
            )
            return reduce(DataFrame.unionByName, decided)
        units = rest.withColumn("blocks", F.ceil(F.col("blocks") / FAN_IN))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often the mix takes each row of ``docs``.

    Returns a row per row of ``docs``: ``doc_id``, ``source``, ``size`` (words of the text, 0 if
    null), ``source_size``, ``target``, ``copies`` and ``taken`` (words, repeats counted). A row of
    a source with target/size ratio r is taken floor(r) times or once more, with the fraction of r
    as its chance; the chances of a source are rounded dependently, so its taken words miss the
    target by half a document at most. Rows without words are taken floor(r) times, which is no
    words. A null source is a source of its own, rows without an id or repeated rows are told apart
    by a running number, an empty table gives no rows. Chances come from hashes of ids, so reruns
    and retried tasks agree. Further columns of ``docs`` are not read.
    """
    words = F.regexp_count(F.col(text_col), F.lit(WORD))
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(words, F.lit(0)).cast("long").alias("size"),
    )
    sized = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    sized = stage(sized, "mix-sizes")
    sources = source_targets(
        sized.select("source", (F.col("size") * F.col("rows")).alias("size"), "rows"), weights, share, most
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio"))
    sources = stage(sources.withColumn("p", F.col("ratio") - F.col("whole")), "mix-targets")
    rows = sized.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows")
    joined = rows.join(
        sources.select(F.col("source").alias("_s"), "source_size", "target", "whole", "p", "n"),
        F.col("source").eqNullSafe(F.col("_s")),
        "left",
    ).drop("_s")
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    units = joined.filter(open_).select(
        "source",
        F.ceil(F.col("n") / FAN_IN).alias("blocks"),
        F.struct("size", "doc_id", "copy", "p").alias("unit"),
    )
    largest = sources.agg(F.max("n")).first()[0] or 0
    drawn = _round(units, largest, seed).join(
        sources.select(F.col("source").alias("_s"), "source_size", "target", "whole"),
        F.col("source").eqNullSafe(F.col("_s")),
        "left",
    ).drop("_s", "copy")
    fixed = joined.filter(~open_).select(
        "source", "doc_id", "size", F.lit(0).alias("take"), "source_size", "target", "whole"
    )
    copies = (F.col("whole") + F.col("take")).cast("int")
    return drawn.unionByName(fixed).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, source_col: str = "source", **more) -> DataFrame:
    """The rows of ``docs`` that the mix takes, whole, with how often it does.

    Adds ``size``, ``source_size``, ``target``, ``copies`` (1 or more) and ``taken``, with underscores
    before a name that ``docs`` already has. Rows are told apart by a hash of all their columns, missing ones
    included, by source and by size, so ids may be missing or repeated. Rows equal in all columns stay as many
    rows as the mix takes. An empty table gives no rows.
    """
    columns = docs.columns
    row, source, size = (free_name(n, columns) for n in ("_row", "_source", "_size"))
    values = [F.col(f"`{c}`") for c in columns]
    words = F.coalesce(F.regexp_count(F.col(more.get("text_col", "text")), F.lit(WORD)), F.lit(0))
    hashed = docs.withColumns({
        row: F.xxhash64(*values, *(v.isNull() for v in values)),
        source: F.col(source_col).cast("string"),
        size: words.cast("long"),
    })
    drawn = mix(hashed, id_col=row, source_col=source, **more)
    # Of equal rows some may be taken once more than the others.
    plan = drawn.groupBy("doc_id", "source", "size", "source_size", "target").agg(
        F.count(F.lit(1)).alias("rows"), F.min("copies").alias("least"), F.sum("copies").alias("all")
    )
    plan = stage(plan.filter("all > 0"), "mix-plan").select(F.struct("*").alias("p"))
    same = (
        (F.col(row) == F.col("p.doc_id")) & F.col(source).eqNullSafe(F.col("p.source")) & (F.col(size) == F.col("p.size"))
    )
    single = hashed.join(plan.filter("p.rows = 1"), same).withColumn("copies_", F.col("p.least"))
    many = plan.filter("p.rows > 1")
    once = hashed.join(many, same, "left_semi").dropDuplicates([row, source, size]).join(many, same)
    more_of = F.col("p.all") - F.col("p.rows") * F.col("p.least")
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("p.rows")))
    repeated = once.withColumn("n_", number).withColumn(
        "copies_", F.col("p.least") + F.when(F.col("n_") <= more_of, 1).otherwise(0)
    )
    taken = single.unionByName(repeated.drop("n_")).filter("copies_ > 0")
    added = {
        "size": F.col("p.size"), "source_size": F.col("p.source_size"), "target": F.col("p.target"),
        "copies": F.col("copies_").cast("int"), "taken": (F.col("copies_") * F.col("p.size")).cast("long"),
    }
    return taken.select(*values, *(value.alias(free_name(name, columns)) for name, value in added.items()))


def mixing_query(spark, folder: str) -> DataFrame:
    """op7: the contract's columns, and the copies."""
    return mix(spark.read.parquet(f"{folder}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )
