"""Quotation linking: conversations in reply order, without quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.llm.common import materialize

#: A quote mark at the start of a line, once for each level.
MARKS = r"^([ \t]*>)+"


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later projections can't repeat inside their lambdas."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def passages(messages: DataFrame) -> DataFrame:
    """Add ``passages`` to messages with a column text: structs of idx, level, text, key, in order.

    A passage is a run of lines of one quote level without empty lines between; its level is the number of
    marks at the line's start.  ``key`` is the passage in lower case with each run of white space as one blank.
    A passage begins where a line differs in level from the one before it or follows an empty one, and ends likewise,
    so both ends are found in one pass and each line is copied once.
    """
    level = lambda x: (F.length(F.regexp_extract(x, MARKS, 0)) - F.length(F.replace(F.regexp_extract(x, MARKS, 0), F.lit(">"), F.lit("")))).alias("level")
    body = lambda x: F.regexp_replace(F.regexp_replace(x, MARKS, ""), r"^[ \t]+|[ \t\r]+$", "").alias("line")
    df = _once(messages, "lines", F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.struct(level(x), body(x))))
    # an empty line has no level, so that it parts what is around it
    df = _once(df, "levels", F.transform("lines", lambda x: F.when(x["line"] == "", -1).otherwise(x["level"])))
    n, edge = F.size("levels"), F.array(F.lit(-1))
    df = _once(df, "marks", F.arrays_zip(F.col("levels").alias("now"), F.concat(edge, F.slice("levels", F.lit(1), n - 1)).alias("before"), F.concat(F.slice("levels", F.lit(2), n), edge).alias("after")))
    at = lambda side: F.filter(F.transform("marks", lambda m, i: F.when((m["now"] >= 0) & (m["now"] != m[side]), i)), lambda i: i.isNotNull())
    df = _once(df, "spans", F.arrays_zip(at("before").alias("s"), at("after").alias("e")))
    text = lambda z: F.array_join(F.transform(F.slice("lines", z["s"] + 1, z["e"] - z["s"] + 1), lambda x: x["line"]), "\n")
    df = _once(df, "found", F.transform("spans", lambda z: F.struct(F.get("levels", z["s"]).alias("level"), text(z).alias("text"))))
    key = lambda t: F.trim(F.regexp_replace(F.lower(t), r"[\x20\x09-\x0D]+", " "))
    return df.select(*messages.columns, F.transform("found", lambda p, i: F.struct(i.alias("idx"), p["level"].alias("level"), p["text"].alias("text"), key(p["text"]).alias("key"))).alias("passages"))


def _previous(nodes: DataFrame, block: int = 1024) -> DataFrame:
    """(conv, turn, before): the turn that comes before each one in its conversation, by blocks of turns, so that no
    conversation is one task; a block's first turn follows the last one of the nearest block before it."""
    placed = nodes.withColumn("block", F.floor(F.col("turn") / block))
    within = placed.withColumn("near", F.lag("turn").over(Window.partitionBy("conv", "block").orderBy("turn")))
    lasts = placed.groupBy("conv", "block").agg(F.max("turn").alias("last"))
    far = lasts.select("conv", "block", F.lag("last").over(Window.partitionBy("conv").orderBy("block")).alias("far"))
    return within.join(far, ["conv", "block"]).select("conv", "turn", F.coalesce("near", "far").alias("before"))


def _place(number: Column) -> Column:
    """16 hexadecimal digits that sort as the numbers do."""
    return F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def _ancestors(parents: DataFrame, rounds: int = 64) -> DataFrame:
    """(conv, turn, root, depth, path) from (conv, turn, up, hop), up the parent's struct or the message's own at a root.

    Each round doubles the distance of the messages that have not reached their root; parents come before
    their replies, so there are no circles.  ``path`` joins the hops from the root on.
    """
    node = F.struct("conv", "turn")
    at_root = F.col("up") == node
    done = parents.where(at_root).select(node.alias("node"), F.col("up"), F.lit(0).cast("long").alias("depth"), F.lit("").alias("path"), F.lit(True).alias("done"))
    left = parents.where(~at_root).select(node.alias("node"), "up", F.lit(1).cast("long").alias("depth"), F.col("hop").alias("path"), F.lit(False).alias("done"))
    for _ in range(rounds):
        if left.isEmpty():
            return done.select(F.col("node.conv").alias("conv"), F.col("node.turn").alias("turn"), F.col("up").alias("root"), "depth", "path")
        above = done.union(left).select(F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("path").alias("p2"), F.col("done").alias("done2"))
        moved = materialize(left.join(above, F.col("up") == F.col("n2")).select("node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), F.concat("p2", "path").alias("path"), F.col("done2").alias("done")))
        done, left = done.union(moved.where("done")), moved.where("not done")
    raise RuntimeError(f"reply chains are longer than 2**{rounds}")


def reply_order(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, n_quoted, n_linked, parent_conv, parent_turn, root_conv,
    root_turn, depth, thread_path, own_text.

    Quoted passages are joined by a 128-bit hash of their normalised text to the unquoted passages of earlier
    messages: the earliest of the same conversation, or else the earliest of any.  A message answers the
    original of its first linked passage of the lowest level; without a link, the message before it in its
    conversation; else it is a root.
    Sorted by root and ``thread_path``, messages stand in reply order, thread by thread: after a message come those
    that quote it from elsewhere, each with all its replies, then the one that follows it.  A path grows by the hops
    to other threads only, not by the depth; a chain of n such hops takes n * n / 2 of them.
    ``own_text`` is the unquoted passages, one empty line between.  Originals are grouped by hash and written before the
    join, so frequent passages make no pairs and Spark may divide the quotes of one.  Null and empty text have no
    passages; messages without conv_id or turn are roots that nothing links to; rows that share conv_id and turn share
    their place.  No rows give none.  Other columns, whatever their names, are not read; long texts are parsed in whole.
    """
    msgs = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    split = passages(msgs)
    named = split.where("conv is not null and turn is not null")
    flat = materialize(named.select("conv", "turn", F.explode("passages").alias("p")).where("p.key != ''").select("conv", "turn", "p.level", "p.idx", F.unhex(F.md5("p.key")).alias("hash")))
    originals, quotes = flat.where("level = 0"), flat.where("level > 0")
    near = materialize(originals.groupBy("conv", "hash").agg(F.min("turn").alias("near")))
    far = materialize(originals.groupBy("hash").agg(F.min(F.struct("conv", "turn")).alias("far")))
    linked = quotes.join(near, ["conv", "hash"], "left").join(far, "hash", "left")
    me = F.struct("conv", "turn")
    source = F.when(F.col("near") < F.col("turn"), F.struct(F.col("conv"), F.col("near").alias("turn"))).when(F.col("far") < me, F.col("far"))
    by_message = linked.withColumn("source", source).groupBy("conv", "turn").agg(F.min(F.when(F.col("source").isNotNull(), F.struct("level", "idx", "source")))["source"].alias("source"), F.count_if(F.col("source").isNotNull()).alias("n_linked"))

    nodes = msgs.where("conv is not null and turn is not null").select("conv", "turn").distinct()
    parents = _previous(nodes).join(by_message, ["conv", "turn"], "left")
    follows = F.when(F.col("before").isNotNull(), F.struct("conv", F.col("before").alias("turn")))
    parents = parents.withColumn("parent", F.coalesce("source", follows))
    # the message before is answered in the same thread; any other is left for a new one
    hop = F.when(F.col("parent") == follows, "").otherwise(F.concat(_place(F.col("parent.turn")), F.lit(">"), _place(F.col("conv")), F.lit(":")))
    parents = materialize(parents.select("conv", "turn", "parent", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("parent", me).alias("up"), hop.alias("hop")))
    placed = parents.join(_ancestors(parents), ["conv", "turn"]).select("conv", "turn", "parent", "n_linked", "root", "depth", F.concat("path", _place(F.col("turn"))).alias("thread_path"))

    own = F.array_join(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["text"]), "\n\n")
    quoted = F.size(F.filter("passages", lambda p: (p["level"] > 0) & (p["key"] != ""))).cast("long")
    out = split.select("conv", "turn", "role", quoted.alias("n_quoted"), own.alias("own_text")).join(placed, ["conv", "turn"], "left")
    path = F.coalesce("thread_path", _place(F.coalesce("turn", F.lit(0).cast("long"))))
    return out.select(F.col("conv").alias("conv_id"), "turn", "role", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("parent.conv").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"), F.coalesce("root.conv", "conv").alias("root_conv"), F.coalesce("root.turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), path.alias("thread_path"), "own_text")


ORACLE = r"""
with recursive l as (select conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from conversations),
m as (select *, regexp_extract(line, '^([ \t]*>)+') as marks, regexp_replace(regexp_replace(line, '^([ \t]*>)+', ''), '^[ \t]+|[ \t\r]+$', '', 'g') as body from l),
v as (select *, length(marks) - length(replace(marks, '>', '')) as level from m),
b as (select *, case when body <> '' and (lag(body) over w is null or lag(body) over w = '' or lag(level) over w <> level) then 1 else 0 end as starts from v window w as (partition by conv_id, turn order by i)),
r as (select *, sum(starts) over (partition by conv_id, turn order by i rows unbounded preceding) as idx from b),
p as (select conv_id, turn, idx, any_value(level) as level, string_agg(body, chr(10) order by i) as txt from r where body <> '' group by conv_id, turn, idx),
k as (select *, trim(regexp_replace(lower(txt), '[\x20\x09-\x0D]+', ' ', 'g')) as key from p),
near as (select conv_id, key, min(turn) as near from k where level = 0 group by conv_id, key),
far as (select key, min((conv_id, turn)) as far from k where level = 0 group by key),
q as (select k.*, case when near.near < k.turn then (k.conv_id, near.near) when far.far < (k.conv_id, k.turn) then far.far end as source from k left join near on near.conv_id = k.conv_id and near.key = k.key left join far on far.key = k.key where k.level > 0),
g as (select conv_id, turn, count(*) as n_quoted, count(source) as n_linked, arg_min(source, (level, idx)) filter (where source is not null) as source from q group by conv_id, turn),
nodes as (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as before from (select distinct conv_id, turn from conversations)),
par as (select n.conv_id, n.turn, coalesce(g.n_quoted, 0) as n_quoted, coalesce(g.n_linked, 0) as n_linked, coalesce(g.source, case when n.before is not null then (n.conv_id, n.before) end) as parent, n.before
  from nodes n left join g on g.conv_id = n.conv_id and g.turn = n.turn),
flat as (select conv_id, turn, n_quoted, n_linked, before, parent[1] as parent_conv, parent[2] as parent_turn from par),
tree as (select conv_id, turn, conv_id as root_conv, turn as root_turn, 0 as depth, '' as path from flat where parent_conv is null
  union all select f.conv_id, f.turn, t.root_conv, t.root_turn, t.depth + 1, t.path || case when f.parent_conv = f.conv_id and f.parent_turn = f.before then '' else lpad(to_hex(cast(f.parent_turn::hugeint + 9223372036854775808 as ubigint)), 16, '0') || '>' || lpad(to_hex(cast(f.conv_id::hugeint + 9223372036854775808 as ubigint)), 16, '0') || ':' end from flat f join tree t on f.parent_conv = t.conv_id and f.parent_turn = t.turn),
own as (select conv_id, turn, string_agg(txt, chr(10) || chr(10) order by idx) as own_text from k where level = 0 group by conv_id, turn)
select c.conv_id, c.turn, c.role, cast(f.n_quoted as bigint) as n_quoted, cast(f.n_linked as bigint) as n_linked, f.parent_conv, f.parent_turn, t.root_conv, t.root_turn, cast(t.depth as bigint) as depth, t.path || lpad(to_hex(cast(c.turn::hugeint + 9223372036854775808 as ubigint)), 16, '0') as thread_path, sha256(coalesce(o.own_text, '')) as own_sha256
from conversations c join flat f on f.conv_id = c.conv_id and f.turn = c.turn join tree t on t.conv_id = c.conv_id and t.turn = c.turn left join own o on o.conv_id = c.conv_id and o.turn = c.turn"""
