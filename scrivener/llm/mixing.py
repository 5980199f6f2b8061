"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.llm.common import materialize, n_words


def highest_quotients(votes: DataFrame, within: Sequence[str], vote: str, seats: str, tie: Sequence[str], out: str) -> DataFrame:
    """Add integer column ``out``: the seats of each row by Sainte-Laguë within the groups of columns ``within``.

    ``votes`` has a row per party: votes >= 0 and the group's number of seats in each.  The quotients are
    votes / (2j - 1); equal ones go by columns ``tie``.  With n parties, rounding votes * x for
    x = (seats - n) / total gives too few seats and for x = (seats + n) / total enough, so only the few
    quotients in between, about 3n, are ranked.  A group without votes gets no seats.
    """
    by = Window.partitionBy(*within)
    v = F.col(vote).cast("double")
    total, n = F.sum(v).over(by), F.count("*").over(by)
    at = lambda shift: F.when(F.col("_all") > 0, F.floor(v * F.greatest(F.col(seats) + shift, F.lit(0)) / F.col("_all") + 0.5)).otherwise(0).cast("long")
    sized = votes.withColumn("_all", total).withColumn("_n", n).withColumn("_low", at(-F.col("_n"))).withColumn("_high", at(F.col("_n")))
    sized = sized.withColumn("_open", F.col(seats) - F.sum("_low").over(by))
    wanted = sized.select(*within, *tie, v.alias("_v"), "_open", F.explode(F.expr("case when _high > _low then sequence(_low + 1, _high) else array() end")).alias("_j"))
    ranked = wanted.withColumn("_rank", F.row_number().over(by.orderBy((F.col("_v") / (2 * F.col("_j") - 1)).desc(), *tie, "_j")))
    won = ranked.where(F.col("_rank") <= F.col("_open")).groupBy(*within, *tie).agg(F.count("*").alias("_won"))
    key = [*within, *tie]
    joined = sized.join(won.select(*[F.col(c).alias(f"_{i}_") for i, c in enumerate(key)], "_won"), [F.col(c) == F.col(f"_{i}_") for i, c in enumerate(key)], "left")
    return joined.select(*[F.col(c) for c in votes.columns], (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long").alias(out))


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Targets of sources.  ``sizes``: one row per source with source (null allowed) and source_size.

    Sources in code-point order, null last, weigh ``weights``, repeating.  They share the sum of all sizes;
    a target stops at ``cap`` times its source's size, and the excess is shared by weight by the others:
    the water level at which the targets sum to everything.  One row a source, so windows over all are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("number", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") - 1) % len(weights) + 1))
    most = cap * F.col("source_size").cast("double")
    everything = Window.partitionBy()
    filled = Window.orderBy("ratio", "number").rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.withColumn("most", most).withColumn("ratio", F.col("most") / F.col("weight")).withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("all_weight", F.sum("weight").over(everything))
    level = level.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(filled), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))))
    # the first source, by ratio, that the level does not reach sets it; without one all sources are full
    level = level.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "number", "level"))).over(everything)["level"])
    return level.select("source", "source_size", "number", "total", F.least("most", F.col("weight") * F.coalesce("level", F.lit(float("inf")))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), cap: int = 3, block: int = 1024, shard_rows: int = 10_000, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    The sum of all sizes is cut into blocks of equal tokens: ``block`` of them, or a 256th of the smallest shard if
    that is less, so that rounding to blocks moves no shard or source by a percent at any size of the corpus.
    Sainte-Laguë gives blocks to sources by their targets and, within a source, to its shards of about
    ``shard_rows`` documents by their sizes; only quotients in doubt are ranked, so many blocks cost nothing.  What a
    shard can't take without passing ``cap`` times its size goes to the source's other shards.
    A shard's documents stand in seeded order on a line of words; its quota takes the line as often as it
    fits and then the line's first blocks, never more than ``cap`` times.  Everything follows from seed,
    doc_id (or the text of rows without one) and sizes, so reruns agree.  Null text has size 0, and so has the empty one;
    null is a source of its own; repeated rows each count.  Where all sizes are 0, nothing is taken.  No rows give none.
    Other columns, whatever their names, are not read; a long text counts in whole.
    """
    text = F.col(text_col).cast("string")
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")))))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), key)).alias("order"))
    # null sources join by a name and a flag
    rows = rows.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("nameless", F.col("source").isNull())
    rows = materialize(rows)  # the texts are read once
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / float(shard_rows))).cast("long")
    sizes = rows.groupBy("source", "name", "nameless").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    names = sizes.select("name", "nameless", "source_rows", shards.alias("shards"))

    dealt = rows.join(names, ["name", "nameless"]).select("doc_id", "name", "nameless", "size", "order", (F.conv(F.substring("order", 1, 12), 16, 10).cast("long") % F.col("shards")).alias("shard"))
    # one column for the three: rows dealt by source alone must not count as dealt by source and shard
    dealt = dealt.withColumn("cell", F.struct("name", "nameless", "shard"))
    line = Window.partitionBy("cell").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("end", F.sum("size").over(line))
    shard_sizes = materialize(dealt.groupBy("cell").agg(F.sum("size").alias("shard_size")).select("cell.*", "shard_size"))

    fit = shard_sizes.where("shard_size > 0").agg(F.greatest(F.lit(1), F.coalesce(F.least(F.lit(block), F.floor(F.min("shard_size") / 256)), F.lit(1))).cast("long").alias("block"))
    targets = source_targets(sizes.select("source", "source_size"), weights, cap).crossJoin(F.broadcast(fit))
    targets = targets.withColumn("blocks", F.floor(F.col("total") / F.col("block")).cast("long"))
    targets = highest_quotients(targets.withColumn("one", F.lit(1)), ["one"], "target", "blocks", ["number"], "source_blocks")
    targets = targets.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("nameless"), "source_size", "target", "block", "source_blocks")

    quotas = highest_quotients(shard_sizes.join(targets, ["name", "nameless"]), ["name", "nameless"], "shard_size", "source_blocks", ["shard"], "quota")
    own = Window.partitionBy("name", "nameless")
    most, asked = F.col("shard_size") * cap, F.col("quota") * F.col("block")
    quotas = quotas.withColumn("held", F.least(asked, most)).withColumn("cut", F.sum(asked - F.col("held")).over(own)).withColumn("room", most - F.col("held"))
    before = F.coalesce(F.sum("room").over(own.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quotas = quotas.withColumn("tokens", F.col("held") + F.greatest(F.lit(0).cast("long"), F.least(F.col("room"), F.col("cut") - before)))
    quotas = quotas.select(F.struct("name", "nameless", "shard").alias("cell"), "source_size", "target", F.expr("case when shard_size > 0 then tokens div shard_size else 0 end").alias("passes"), F.expr("case when shard_size > 0 then tokens % shard_size else 0 end").alias("rest"))
    taken: Column = F.col("passes") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("end"), F.col("rest")) - (F.col("end") - F.col("size")))
    return placed.join(quotas, "cell").select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


ORACLE = r"""
with r as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5('0:' || coalesce(cast(doc_id as varchar), 't' || md5(coalesce(text, '')))) as ord from documents),
s as (select source, cast(sum(size) as bigint) as source_size, count(*) as source_rows, row_number() over (order by source nulls last) as number from r group by source),
w as (select *, [5.0, 2.0, 1.0][(number - 1) % 3 + 1]::double as weight, 3.0::double * source_size as most, sum(source_size) over ()::double as total from s),
l as (select *, most / weight as ratio from w),
v as (select *, (total - coalesce(sum(most) over f, 0)) / (sum(weight) over () - coalesce(sum(weight) over f, 0)) as lev from l window f as (order by ratio, number rows between unbounded preceding and 1 preceding)),
t as (select *, least(most, weight * coalesce((select lev from v where ratio >= lev order by ratio, number limit 1), 'inf'::double)) as target from v),
c as (select r.*, t.number, ('0x' || substr(ord, 1, 12))::bigint % greatest(1, ceil(t.source_rows / 10000))::bigint as shard from r join t on t.source is not distinct from r.source),
m as (select number, shard, sum(size)::bigint as shard_size from c group by number, shard),
z as (select greatest(1, coalesce(least(1024, floor(min(shard_size) / 256)), 1))::bigint as block from m where shard_size > 0),
b as (select t.*, z.block, floor(total / z.block)::bigint as blocks, sum(target) over () as everything, count(*) over () as n from t cross join z),
q as (select *, case when everything > 0 then floor(target * greatest(blocks - n, 0) / everything + 0.5) else 0 end::bigint as low, case when everything > 0 then floor(target * (blocks + n) / everything + 0.5) else 0 end::bigint as high from b),
k as (select number, row_number() over (order by target / (2 * j - 1) desc, number, j) as place, places from (select number, target, unnest(range(low + 1, high + 1)) as j, places from (select *, blocks - sum(low) over () as places from q))),
a as (select q.*, low + coalesce((select count(*) from k where k.number = q.number and place <= places), 0) as source_blocks from q),
d as (select c.*, a.source_size, a.target from c join a on a.number = c.number),
h as (select m.number, m.shard, m.shard_size, a.block, a.source_blocks as seats from m join a on a.number = m.number),
e as (select *, sum(shard_size) over (partition by number)::double as everything, count(*) over (partition by number) as n from h),
g as (select *, case when everything > 0 then floor(shard_size * greatest(seats - n, 0) / everything + 0.5) else 0 end::bigint as low, case when everything > 0 then floor(shard_size * (seats + n) / everything + 0.5) else 0 end::bigint as high from e),
y as (select number, shard, row_number() over (partition by number order by shard_size / (2 * j - 1) desc, shard, j) as place, places from (select number, shard, shard_size, unnest(range(low + 1, high + 1)) as j, places from (select *, seats - sum(low) over (partition by number) as places from g))),
x as (select g.number, g.shard, shard_size, shard_size * 3 as most, (low + coalesce((select count(*) from y where y.number = g.number and y.shard = g.shard and place <= places), 0)) * block as asked from g),
f as (select *, least(asked, most) as held, most - least(asked, most) as room, sum(asked - least(asked, most)) over (partition by number) as cut, coalesce(sum(most - least(asked, most)) over (partition by number order by shard rows between unbounded preceding and 1 preceding), 0) as before from x),
o as (select number, shard, shard_size, (held + greatest(0, least(room, cut - before)))::bigint as tokens from f),
p as (select *, sum(size) over (partition by number, shard order by ord, doc_id, size rows unbounded preceding)::bigint as stop from d)
select doc_id, size, source_size, target, (case when shard_size > 0 then tokens // shard_size else 0 end * size + greatest(0, least(stop, case when shard_size > 0 then tokens % shard_size else 0 end) - (stop - size)))::bigint as taken
from p join o on o.number = p.number and o.shard = p.shard"""
