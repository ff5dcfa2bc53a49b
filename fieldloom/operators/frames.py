"""Figures over a stretch of time before each row, and islands of rows that follow each other closely.

Keys of any size: what is too large for one task is cut by time, and the cuts don't show in the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from .timelines import HOT, PIECE_ROWS, _cut, position
from .validate import free


def _known(keys: Sequence[str], t: str) -> Column:
    """Whether a row has a place on a line: keys, and a time that is a finite number."""
    held = [F.col(k).isNotNull() for k in keys]
    return reduce(Column.__and__, held, F.coalesce(F.abs(t) < float("inf"), F.lit(False)))


def _framed(line: DataFrame, columns: Sequence[Column], keys: Sequence[str], back: int, figures: Mapping[str, Column], limit: int) -> DataFrame:
    """line's columns and figures by Spark's own frames, hot keys cut into stretches."""
    counts = line.groupBy(*keys).agg(F.count("*").alias("n"))
    most = max(limit, (counts.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = counts.where(F.col("n") > most).drop("n")
    found = hot.collect()  # fewer than HOT
    copy = F.struct(F.lit(None).cast("bigint").alias("part"), F.lit(True).alias("own"))
    if found:
        marked = line.sparkSession.createDataFrame(found, hot.schema).withColumn("__fl_hot", F.lit(True))
        line = line.join(F.broadcast(marked), keys, "left")
        line = line.withColumn("__fl_copy", F.explode(F.when(F.col("__fl_hot"), _ways(back)).otherwise(F.array(copy))))
    else:
        line = line.withColumn("__fl_copy", copy)
    frame = W.partitionBy(*keys, "__fl_copy.part").orderBy("__fl_t").rangeBetween(-back, 0)
    return line.select(*columns, "__fl_copy", *(c.over(frame).alias(name) for name, c in figures.items())).where("__fl_copy.own").drop("__fl_copy")


def _ways(back: int) -> Column:
    """A row's own stretch of time and the next, where it is seen."""
    part = F.floor(F.col("__fl_t") / back).cast("bigint")
    return F.array(F.struct(part.alias("part"), F.lit(True).alias("own")), F.struct((part + 1).alias("part"), F.lit(False).alias("own")))


def _stretched(line: DataFrame, columns: Sequence[Column], keys: Sequence[str], back: int, figures: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """line's columns and figures, at a cost in proportion to the rows, however many rows a frame has.

    Time is cut into stretches as long as the frame, so a frame is the end of one stretch and the beginning of the
    next. A row goes to its own stretch and to the next; there one running aggregate from either side gives both parts.
    """
    line = line.withColumn("__fl_copy", F.explode(_ways(back))).select("*", F.col("__fl_copy.part").alias("__fl_part"), F.col("__fl_copy.own").alias("__fl_own"))
    group = [*keys, "__fl_part"]
    line = line.repartition(*group)  # the one shuffle: what follows is grouped by these columns or by more
    up = W.partitionBy(*group).orderBy("__fl_t").rangeBetween(W.unboundedPreceding, W.currentRow)
    down = W.partitionBy(*group).orderBy(F.desc("__fl_t")).rangeBetween(W.unboundedPreceding, back)
    firsts = {}
    for i, column in enumerate(dict.fromkeys(c for how, c in figures.values() if how == "distinct")):
        # a value is in sight from a row of it until `back` after; starts and ends of such times, over all its rows
        of = W.partitionBy(*group, f"`{column}`").orderBy("__fl_t")
        value, t = F.col(f"`{column}`").isNotNull(), F.col("__fl_t")
        before, after = F.lag("__fl_t").over(of), F.lead("__fl_t").over(of)
        line = line.withColumns({f"__fl_start{i}": (value & F.coalesce(before < t - back, F.lit(True))).cast("int"), f"__fl_end{i}": (value & F.coalesce(t < after - back, F.lit(True))).cast("int")})
        firsts[column] = i

    ahead, behind, out = {}, {}, {}
    for n, (name, (how, column)) in enumerate(figures.items()):
        a, b = f"__fl_a{n}", f"__fl_b{n}"
        if how == "distinct":
            i = firsts[column]
            everything = F.sum(f"__fl_end{i}").over(W.partitionBy(*group))
            ahead[a], behind[b] = F.sum(f"__fl_start{i}").over(up), everything - F.sum(f"__fl_end{i}").over(down)
            out[name] = F.col(a) - F.col(b)
            continue
        value = F.lit(1) if column is None else F.col(f"`{column}`")
        ahead[a], behind[b] = (getattr(F, how)(F.when(own, value)).over(w) for own, w in ((F.col("__fl_own"), up), (~F.col("__fl_own"), down)))
        if how == "count":
            out[name] = F.col(a) + F.col(b)
        elif how == "sum":
            out[name] = F.coalesce(F.col(a) + F.col(b), a, b)
        else:
            out[name] = (F.least if how == "min" else F.greatest)(a, b)
    return line.withColumns(ahead).withColumns(behind).where("__fl_own").select(*columns, *(c.alias(name) for name, c in out.items()))


def frame_figures(df: DataFrame, at: str, back: int, figures: Mapping[str, Column | tuple[str, str | None]], by: Sequence[str] = (), limit: int = PIECE_ROWS) -> DataFrame:
    """df with figures over the rows of its key from `back` before its time up to its time, both included.

    figures: new name -> ("sum", "min", "max", "count" or "distinct", column), the last the number of different values
    that are not NULL; ("count", None) counts rows. Or new name -> any aggregate of df's columns, such as F.sum("value").
    back: microseconds, days or units, above 0. Rows of one time see each other, so ties need no order; a row always
    sees itself and repeated rows count each. A row without a key, or whose time is NULL, NaN or infinite, stays and is
    in no frame: its figures are NULL. A name that df has raises. An empty table gives no rows.

    With named figures each row is handled a fixed number of times: all keys are cut into stretches as long
    as the frame, and rows go to their own stretch and to the next, in one shuffle of twice the rows.

    Spark reads a whole frame again for other aggregates, at each time anew: that is for frames of few rows. One shuffle
    by key. A key of over `limit` rows (or 1/HOT of all, if that is more) is cut into such stretches: twice
    the rows, for those keys alone. Those keys, fewer than HOT, are found by counting and broadcast.

    In both ways a task can hold the rows of two frames.
    """
    if back <= 0:
        raise ValueError("a frame reaches back by more than 0")
    named = [x for x in figures.values() if isinstance(x, tuple)]
    if named and len(named) < len(figures):
        raise ValueError("figures are named ones or aggregates, not both")
    if wrong := {how for how, _ in named} - {"sum", "min", "max", "count", "distinct"}:
        raise ValueError(f"{', '.join(sorted(wrong))} is no figure of a frame")
    if any(column is None and how != "count" for how, column in named):
        raise ValueError("only rows can be counted without a column")
    keys = [f"__fl_k{i}" for i in range(len(by) or 1)]
    own = [*keys, "__fl_t", "__fl_hot", "__fl_copy"]
    if named:
        own += ["__fl_part", "__fl_own", *(f"__fl_{x}{i}" for x in ("start", "end", "a", "b") for i in range(len(figures)))]
    free(df, *figures, *own)
    if taken := {x.lower() for x in figures} & set(own):
        raise ValueError(f"{', '.join(sorted(taken))} is a name of its own use")
    values = [F.col(f"`{c}`") for c in by] or [F.lit(0)]
    rows = df.withColumns({**dict(zip(keys, values)), "__fl_t": position(F.col(f"`{at}`"), df.schema[at].dataType)})
    known = _known(keys, "__fl_t")
    line = rows.where(known)
    mine = [F.col(f"`{c}`") for c in df.columns]

    seen = _stretched(line, mine, keys, back, figures) if named else _framed(line, mine, keys, back, figures, limit)
    none = [F.lit(None).cast(seen.schema[name].dataType).alias(name) for name in figures]
    return seen.unionByName(rows.where(~known).select(*mine, *none))


def islands(df: DataFrame, at: str, gap: int, figures: Mapping[str, tuple[str, str]] = {}, by: Sequence[str] = (), limit: int = PIECE_ROWS) -> DataFrame:
    """(by..., start, end, n, figures...) for each longest run of a key's rows of which each is at most `gap` after the one before.

    figures: new name -> ("sum", "min" or "max", column). gap: microseconds, days or units. Rows of one time are in one
    island, repeated rows count each. Rows without a key, or whose time is NULL, NaN or infinite, are in none. Names of
    by and results that are the same raise. An empty table gives no rows.

    One shuffle by key. A key of over `limit` rows is cut by time into pieces, each a group of its own. Only
    a piece's first and last island may go on in its neighbours, so of a cut key two rows a piece meet in one
    task, however many rows and islands it has.
    """
    if wrong := {how for how, _ in figures.values()} - {"sum", "min", "max"}:
        raise ValueError(f"{', '.join(sorted(wrong))} of islands cannot be merged")
    names = [*by, "start", "end", "n", *figures]
    if len({x.lower() for x in names}) < len(names):
        raise ValueError(f"names must differ: {', '.join(names)}")
    keys = [f"k{i}" for i in range(len(by) or 1)]
    values = [F.col(f"`{c}`") for c in by] or [F.lit(0)]
    inputs = [F.col(f"`{c}`").alias(f"v{i}") for i, (_, c) in enumerate(figures.values())]
    rows = df.select(*(v.alias(k) for k, v in zip(keys, values)), F.col(f"`{at}`").alias("at"), position(F.col(f"`{at}`"), df.schema[at].dataType).alias("t"), *inputs)
    line, cut = _cut(rows.where(_known(keys, "t")), keys, limit)

    def summed(grouped, start: str, end: str, low: str, high: str, n: Column) -> DataFrame:
        merged = [getattr(F, how)(f"v{i}").alias(f"v{i}") for i, (how, _) in enumerate(figures.values())]
        return grouped.agg(F.min(start).alias("start"), F.max(end).alias("end"), F.min(low).alias("low"), F.max(high).alias("high"), n.alias("n"), *merged)

    order = W.partitionBy(*keys, "piece").orderBy("t")
    fresh = F.when(F.col("t") - F.lag("t").over(order) <= gap, 0).otherwise(1)
    numbered = line.withColumn("fresh", fresh).withColumn("no", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    found = summed(numbered.groupBy(*keys, "piece", "no"), "at", "at", "t", "t", F.count("*"))
    if cut:
        found = found.withColumn("last", F.max("no").over(W.partitionBy(*keys, "piece")))
        edge = (F.size("piece") > 0) & ((F.col("no") == 1) | (F.col("no") == F.col("last")))
        along = W.partitionBy(*keys).orderBy("piece", "no")
        goes_on = (F.col("piece") != F.lag("piece").over(along)) & (F.col("low") - F.lag("high").over(along) <= gap)
        edges = found.where(edge).withColumn("fresh", F.when(goes_on, 0).otherwise(1))
        edges = edges.withColumn("run", F.sum("fresh").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
        whole = summed(edges.groupBy(*keys, "run"), "start", "end", "low", "high", F.sum("n"))
        found = found.where(~edge).select(*whole.columns[: len(keys)], *whole.columns[len(keys) + 1 :]).unionByName(whole.drop("run"))
    return found.select(*(F.col(k).alias(c) for k, c in zip(keys, by)), "start", "end", "n", *(F.col(f"v{i}").alias(name) for i, name in enumerate(figures)))
