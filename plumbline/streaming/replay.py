"""Batch replay of folds over whole tables."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.operators.ordered import running_sums
from plumbline.session import written


def numbered(df: DataFrame, keys: Sequence[str], ts: str, tie: str, width: int = 60, name: str = "seen") -> DataFrame:
    """Number the rows of a key from 1 in time order, block by block."""
    d = df.withColumn("_hr", F.floor(F.col(ts) / width))
    return running_sums(d, keys, "_hr", [ts, tie], {name: F.lit(1).cast("long")}).drop("_hr")


def _schema(df: DataFrame, keys: Sequence[str], tail: str) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + tail


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold) -> DataFrame:
    """Secondary sort: a task walks its keys in order, batch by batch, and holds one state only.

    For rules that never forget (a baseline can last for ever). A key is walked by one task but never
    held there; callers shrink the rows of a key first where the rule allows it.
    """
    keys, order = list(keys), list(order)

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in parts:
            # rows are sorted: a key is one stretch, which may go on in the next batch
            same = (pdf[keys].shift() == pdf[keys]) | (pdf[keys].shift().isna() & pdf[keys].isna())
            for _, part in pdf.groupby((~same.all(axis=1)).cumsum(), sort=False):
                key = tuple(part[keys].iloc[0].where(part[keys].iloc[0].notna(), None))
                if key != now:
                    now, state = key, fold.init()
                state, out = fold.run(state, part)
                if len(out):
                    for i, k in enumerate(keys):
                        out.insert(i, k, key[i])
                    yield out

    sorted_ = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_.mapInPandas(walk, _schema(df, keys, fold.out))


def in_blocks(df: DataFrame, block: int, seq: str, lead: int = 0) -> DataFrame:
    """Rows with their block ``_b``; each block also has copies of the ``lead`` rows before it, marked ``_lead``."""
    own = F.floor((F.col(seq) - 1) / block)
    if not lead:
        return df.withColumns({"_b": own, "_lead": F.lit(False)})
    reach = F.sequence(own, F.floor((F.col(seq) - 1 + lead) / block))
    return df.withColumn("_b", F.explode(reach)).withColumn("_lead", F.col("_b") != own)


def _outputs(d: DataFrame, entries: DataFrame, keys: list[str], order: list[str], fold) -> DataFrame:
    """Run every block from its entry state."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, out = fold.run(json.loads(pdf["_entry"].iloc[0]), pdf.sort_values(order))
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out

    cols = [*keys, "_b"]
    return d.join(entries.select(*cols, F.col("entry").alias("_entry")), cols).groupBy(*cols).applyInPandas(run, _schema(d, keys, fold.out))


def by_restarts(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold, block: int = 4096, seq: str = "seen") -> DataFrame:
    """Exact replay in parallel inside a key, for folds that now and then start over and forget what was before.

    All blocks run at once, as if a fresh start stood at their beginning. Where the block before ends in another state, a block
    runs again from that one; once two runs start over at the same row they are the same from there on, so most
    blocks settle in a round or two. A run that goes on for long is followed from the block that it enters over the next
    1, 2, 4, ... blocks at once: what a block does to a run that does not start over in it is a few numbers
    (``fold.crossing``), which one pass over the blocks' numbers links up (``fold.crossed``). The first unsettled block of a key is
    right after every round, so the result is that of one walk in order.
    """
    keys, order, spark = list(keys), list(order), df.sparkSession
    d = written(spark, in_blocks(df, block, seq, fold.lead), "blocks")
    own, cols = d.filter("NOT _lead"), [*keys, "_b"]
    start, names = json.dumps(fold.init()), [*cols, "entry", "exit", "since"]
    kind = _schema(d, cols, "entry string, exit string, since long")
    before = W.partitionBy(*keys).orderBy("_b")

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        entry = pdf["_entry"].iloc[0]
        state, _ = fold.run(json.loads(entry), pdf.sort_values(order))
        out = pd.DataFrame([(*key, entry, json.dumps(state), fold.since(state))], columns=names)
        return out.astype({"since": "Int64"})

    def crossing(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        run = pdf["_run"].iloc[0]
        return pd.DataFrame([(*key, run, json.dumps(fold.crossing(json.loads(run), pdf)))], columns=[*cols, "_head", "run", "effect"])

    def crossed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at, state, out = key[-1], json.loads(pdf["run"].iloc[0]), []
        entry = pdf["run"].iloc[0]
        for b, effect in sorted(zip(pdf["_b"], pdf["effect"])):
            state = fold.crossed(state, json.loads(effect)) if b == at else None
            if state is None:
                break
            out.append((*key[:-1], b, entry, json.dumps(state), fold.since(state)))
            entry, at = out[-1][-2], at + 1
        return pd.DataFrame(out, columns=names)

    def unsettled(known: DataFrame) -> DataFrame:
        w = known.withColumns({"want": F.coalesce(F.lag("exit").over(before), F.lit(start)), "run": F.lag("since").over(before)})
        return w.withColumn("off", F.col("want") != F.col("entry"))

    def replaced(known: DataFrame, new: DataFrame) -> DataFrame:
        return known.join(new.select(*cols), cols, "left_anti").select(*names).unionByName(new)

    known, width = written(spark, own.withColumn("_entry", F.lit(start)).groupBy(*cols).applyInPandas(walk, kind), "exits"), 1
    # A run counts as real when it began behind a row that started over, not at the fresh start a block was given.
    real = F.col("run").isNull() | (F.col("run") == fold.fresh) | ((F.col("run") - fold.fresh) % block != 0)
    first = F.count_if("off").over(before) == 1
    while not (open_ := unsettled(known)).filter("off").isEmpty():
        # Followed are the runs that enter a key's first unsettled block, and real ones from the first block that they enter.
        new = ~F.col("run").eqNullSafe(F.lag("run").over(before))
        head = F.col("off") & (F.col("_b") * block - F.col("run") >= fold.lead) & (first | (real & new))
        near = F.last(F.when(head, F.struct(F.col("_b").alias("b"), F.col("want").alias("run"))), ignorenulls=True).over(before)
        ahead = open_.withColumn("_h", near).filter(F.col("_b") - F.col("_h.b") < width).select(*cols, F.col("_h.b").alias("_head"), F.col("_h.run").alias("_run"))
        effects = d.join(ahead, cols).groupBy(*cols, "_head").applyInPandas(crossing, _schema(d, cols, "_head long, run string, effect string"))
        known = written(spark, replaced(known, written(spark, effects.groupBy(*keys, "_head").applyInPandas(crossed, kind), "crossed")), "exits")
        late = unsettled(known).withColumn("_first", first).filter(F.col("off") & (F.col("_first") | real)).select(*cols, F.col("want").alias("_entry"))
        known = written(spark, replaced(known, written(spark, own.join(late, cols).groupBy(*cols).applyInPandas(walk, kind), "walked")), "exits")
        width *= 2
    return _outputs(own, known, keys, order, fold)


FAN = 256


def by_maps(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold, block: int = 4096, seq: str = "seen") -> DataFrame:
    """Exact replay in parallel inside a key, for folds whose blocks have an effect that is short to write down.

    A block's effect says which state it leaves for every state it may enter with (``fold.effect``). Effects chain up
    (``fold.chain``): ``FAN`` blocks have one effect, ``FAN`` of those the next, until a key has ``FAN`` at most; then the entry
    states are handed down again (``fold.after``). No task sees more than ``FAN`` effects, and the number of levels is the
    logarithm of a key's rows.
    """
    keys, order, spark = list(keys), list(order), df.sparkSession
    d = written(spark, in_blocks(df, block, seq, fold.lead), "blocks")
    cols = [*keys, "_b"]

    def effect(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [] if pdf["_lead"].all() else [(*key, fold.effect(pdf.sort_values(order)))]
        return pd.DataFrame(rows, columns=[*cols, "map"])

    def chained(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, fold.chain(pdf.sort_values("_b")["map"].tolist()))], columns=[*cols, "map"])

    def entries(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b")
        now, out = json.loads(pdf["entry"].iloc[0]), []
        for raw in pdf["map"]:
            out.append(json.dumps(now))
            now = fold.after(raw, now)
        return pd.DataFrame({**{k: key[i] for i, k in enumerate(keys)}, "_b": pdf["_b"], "entry": out})

    kind, up = _schema(d, cols, "map binary"), (F.floor(F.col("_b") / FAN)).alias("_u")
    levels = [written(spark, d.groupBy(*cols).applyInPandas(effect, kind), "maps")]
    most = levels[0].agg(F.max("_b")).first()[0] or 0
    while most >= FAN:
        top = levels[-1].select(*keys, up, "_b", "map")
        levels.append(written(spark, top.groupBy(*keys, "_u").applyInPandas(chained, kind), "maps"))
        most //= FAN
    known = levels[-1].select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("_u"), F.lit(json.dumps(fold.init())).alias("entry"))
    for level in reversed(levels):
        below = level.select(*keys, up, "_b", "map").join(known, [*keys, "_u"])
        known = written(spark, below.groupBy(*keys, "_u").applyInPandas(lambda key, pdf: entries(key, pdf), _schema(d, cols, "entry string")), "entries")
        known = known.withColumnRenamed("_b", "_u")
    return _outputs(d, known.withColumnRenamed("_u", "_b"), keys, order, fold)
