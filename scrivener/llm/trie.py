"""Trie of conversation prefixes: vertical bitmaps within ranges of conversations, merged by prefix."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivener.llm.common import discard, materialize, n_words

#: Ids that a shard spans, so the bits of its bitmaps at most; fewer make more tasks, and more rows of what shards share.
SPAN = 512
ROOT = b"\0" * 16
_PIECES = "node binary, parent binary, depth long, least long, n long, words long, shard long, ends string"


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, token, words) of every turn: its place from 1, 128 bits of role and text, and its text's words.

    Turns are ordered by number, null first; those that share one by role and then token.  Null role and text are empty.
    Repeated rows are as many turns; rows without conv_id are left out.  Other columns, whatever their names, are not read,
    and texts leave their rows as hashes, so only these are shuffled.
    """
    role, text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col)]
    # the length keeps role and text apart
    token = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), token.alias("token"), n_words(text).alias("words"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "token"))
    return rows.select("conv_id", place.cast("long").alias("pos"), "token", "words")


def shared_starts(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations c as if branched off: (turns, their conv_ids, for those left without turns).

    c begins with the first h turns of conversation c - c % ``group``, as many as there are, and goes on after its own
    first h; h = CRC-32 of c in decimals % ``most``.  Of each group's first conversation only most - 1 turns are sent on.
    """
    turns = materialize(turns)
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("long")
    convs = materialize(turns.select("conv_id").distinct())
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), "pos", "token", "words")
    branched = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h")).where("h > 0")
    start = heads.join(branched, "base").where("pos <= h").select("conv_id", "pos", "token", "words")
    # own turns stay behind all that may come before them; only the order counts
    own = turns.where(F.col("pos") > h).select("conv_id", (F.col("pos") + most).alias("pos"), "token", "words")
    return start.union(own), convs


def _prefix(parent: bytes, token: bytes) -> bytes:
    return hashlib.md5(parent + token).digest()


def shard_nodes(turns: list[tuple[int, bytes, int]], convs: list[int]) -> Iterator[tuple[bytes, bytes | None, int, int, int, int, str | None]]:
    """The nodes of a shard: (node, parent, depth, least conv_id, conversations, words of the last turn, its end list).

    ``convs``: the shard's conv_ids, ascending; ``turns``: (index of the conversation, token, words) in order.
    Bit i of a bitmap is conversation i.  There is one for each (position, turn), the conversations with that turn
    there, and one for each length; a node's children are its bitmap's intersections with those of the next position.
    """
    paths: list[list[tuple[bytes, int]]] = [[] for _ in convs]
    postings: dict[tuple[int, bytes], int] = defaultdict(int)
    for i, token, words in turns:
        paths[i].append((token, words))
        postings[len(paths[i]), token] |= 1 << i
    lengths: dict[int, int] = defaultdict(int)
    for i, path in enumerate(paths):
        lengths[len(path)] |= 1 << i
    todo: list[tuple[int, int, bytes, bytes | None, int]] = [((1 << len(convs)) - 1, 0, ROOT, None, 0)]
    while todo:
        members, depth, node, parent, words = todo.pop()
        ended, ends = members & lengths.get(depth, 0), None
        if ended:
            ends, left = [], ended
            while left:
                low = left & -left
                ends.append(str(convs[low.bit_length() - 1]))
                left ^= low
        yield node, parent, depth, convs[(members & -members).bit_length() - 1], members.bit_count(), words, ",".join(ends) if ends else None
        rest = members ^ ended
        while rest:  # the turn of the first conversation left names a child, and its bitmap the child's members
            token, count = paths[(rest & -rest).bit_length() - 1][depth]
            child = rest & postings[depth + 1, token]
            todo.append((child, depth + 1, _prefix(node, token), node, count))
            rest ^= child


def _shard(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("conv_id", "ascending"), ("pos", "ascending")])
    ids = rows.column("conv_id").to_pylist()
    convs = sorted(set(ids))
    at = {c: i for i, c in enumerate(convs)}
    turns = [(at[c], t, w) for c, t, w in zip(ids, rows.column("token").to_pylist(), rows.column("words").to_pylist()) if t is not None]
    found = list(zip(*shard_nodes(turns, convs)))
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    shard = pa.array([key[0].as_py()] * len(found[0]), pa.int64())
    return pa.table([*[pa.array(c, k) for c, k in zip(found, kinds)], shard, pa.array(found[6], pa.string())], names=["node", "parent", "depth", "least", "n", "words", "shard", "ends"])


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's end list, piece after piece: a list of any length goes through without being held."""
    node, running, done = None, None, []

    def batch(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["node", "ends_sha256"])

    for b in batches:
        for at, ends in zip(b.column("node").to_pylist(), b.column("ends").to_pylist()):
            if at != node:
                if running:
                    done.append((node, running.hexdigest()))
                node, running = at, hashlib.sha256(ends.encode())
            else:
                running.update(b"," + ends.encode())
        if len(done) > 10_000:
            yield batch(done)
            done = []
    if running:
        done.append((node, running.hexdigest()))
    yield batch(done)


def _subtree_sums(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Replace the columns by their sums over each node's subtree.

    After round i a node has the sum of its descendants less than 2**i below it, and every node that deep knows its
    ancestor 2**i above, so a trie of depth d takes log2(d) rounds, each a join and a grouping on node.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    jumps = materialize(nodes.where("depth >= 1").select("node", F.col("parent").alias("up"), "depth"))
    reach, sums = 1, nodes
    while reach <= deepest:
        more = jumps.select("node", "up").join(sums.select("node", *columns), "node").groupBy("up").agg(*[F.sum(c).alias(f"{c}_") for c in columns])
        past, sums = sums, materialize(sums.join(materialize(more), F.col("node") == F.col("up"), "left").select(*[c for c in nodes.columns if c not in columns], *[(F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c) for c in columns]))
        reach *= 2
        further = jumps.select(F.col("node").alias("up"), F.col("up").alias("next"))
        old, jumps = jumps, materialize(jumps.where(F.col("depth") >= reach).join(further, "up").select("node", F.col("next").alias("up"), "depth"))
        discard(past, old)
    return sums


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None, span: int = SPAN) -> DataFrame:
    """A row for each different sequence of first d turns, from the root (d = 0), to whole conversations.

    Columns: node (128 bits of the sequence), parent, conv_id (smallest member), depth, parent_conv_id (smallest member of
    the parent), n_convs (members), n_children, n_leaves (childless nodes in its subtree), saved_tokens (over its
    subtree, each node's other members times the words of its last turn: what a shared prefix needn't compute again),
    ends_sha256 (of the conv_ids that end there, ascending, comma-joined).

    ``turns``: (conv_id, pos, token, words), as of ``turns_of``; ``convs``: conv_ids that may have no turn.  Of two turns with
    one place in a conversation either may come first.  Equal conversations are members of the same nodes.  No rows give
    none, not even a root.

    1. A shard is a range of ``span`` ids, so its end lists are stretches of the whole ones.  It is one task's work: the turns
       of at most ``span`` conversations, as hashes, and where one conversation is very long, that one's.
    2. Nodes of all shards are merged by prefix; a node that very many conversations share has one row a shard.
    3. Sums over subtrees are found by pointer doubling, so no path is ever written out.
    """
    ids = turns.select("conv_id") if convs is None else turns.select("conv_id").union(convs.select("conv_id"))
    there = ids.distinct().select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("token"), F.lit(0).cast("long").alias("words"))
    dealt = turns.select("conv_id", F.col("pos").cast("long").alias("pos"), "token", F.col("words").cast("long").alias("words")).union(there)
    shard = F.expr(f"(conv_id - pmod(conv_id, {span})) div {span}")
    pieces = materialize(dealt.withColumn("shard", shard).groupBy("shard").applyInArrow(_shard, _PIECES))
    ends = pieces.where("ends is not null").select("node", "shard", "ends").repartition("node").sortWithinPartitions("node", "shard")
    ends = materialize(ends.select("node", "ends").mapInArrow(_end_hashes, "node binary, ends_sha256 string"))
    nodes = materialize(pieces.groupBy("node", "parent", "depth", "words").agg(F.min("least").alias("conv_id"), F.sum("n").alias("n_convs")))
    children = materialize(nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "parent_"))
    discard(pieces)
    counted = nodes.join(children, F.col("node") == F.col("parent_"), "left").select("node", "parent", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    summed = _subtree_sums(materialize(counted.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))), ["n_leaves", "saved_tokens"])
    discard(children)
    above = nodes.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    ending = ends.select(F.col("node").alias("ending"), "ends_sha256")
    out = summed.join(above, F.col("parent") == F.col("above"), "left").join(ending, F.col("node") == F.col("ending"), "left")
    return out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def with_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Add the token and words of each node's last turn; the root has none.  ``turns`` counts places from 1 without gaps."""
    last = turns.select(F.col("conv_id").alias("conv_"), F.col("pos").alias("pos_"), "token", "words")
    return nodes.join(last, (F.col("conv_id") == F.col("conv_")) & (F.col("depth") == F.col("pos_")), "left").drop("conv_", "pos_")


ORACLE = r"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos,
  md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as token, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 20 as base, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, e: case when e >= 0 then xor(a, e) when a % 2 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end), 4294967295::bigint) % 4 as h from (select distinct conv_id from t)),
r as (select c.conv_id, 0 as part, t.pos, t.token, t.words from c join t on t.conv_id = c.base and t.pos <= c.h union all select c.conv_id, 1, t.pos, t.token, t.words from c join t on t.conv_id = c.conv_id and t.pos > c.h),
o as (select conv_id, list(token order by part, pos) as path, list(words order by part, pos) as w from r group by conv_id),
m as (select c.conv_id, coalesce(o.path, []) as path, coalesce(o.w, []) as w from c left join o on o.conv_id = c.conv_id),
p as (select conv_id, len(path) as n, d, array_to_string(path[1:d], '/') as node, case when d > 0 then array_to_string(path[1:d - 1], '/') end as parent, case when d > 0 then w[d] else 0 end as words from (select *, unnest(range(0, len(path) + 1)) as d from m)),
n as (select node, any_value(parent) as parent, d, any_value(words) as words, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '')) as ends_sha256 from p group by node, d),
k as (select n.*, (select count(*) from n x where x.parent = n.node and x.d = n.d + 1) as n_children from n),
s as (select u.node, u.d, sum(case when v.n_children = 0 then 1 else 0 end) as n_leaves, sum((v.n_convs - 1) * v.words) as saved_tokens
  from k v join p q on q.conv_id = v.conv_id and q.d <= v.d join k u on u.node = q.node and u.d = q.d group by u.node, u.d)
select k.conv_id, k.d as depth, b.conv_id as parent_conv_id, k.n_convs, k.n_children, cast(s.n_leaves as bigint) as n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, k.ends_sha256
from k join s on s.node = k.node and s.d = k.d left join k b on b.node = k.parent and b.d = k.d - 1"""
