"""Near copies by MinHash bands, with candidates judged by odd sketches before their sets are compared."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.llm.common import connected_components, discard, materialize, mix, small_batches
from scrivener.llm.simhash import shingle_hashes

#: A pair of similarity .8 agrees in the ROWS samples of one of TABLES bands but once in 14,000.
TABLES, ROWS = 24, 5
#: Samples of a set, of which the bands take the first, and bits of the sketch that they are folded into.
SAMPLES, BITS = 256, 512
WORDS = BITS // 64
#: How many standard deviations of its estimate a pair may lie under the similarity before it is left out.
DEVIATIONS = 4.5
#: Sets in buckets over this size are first compared with one of them, so that a group of copies is one soon.
BUCKET = 8
#: Changes that over one in so many of a pivot's outer sets have are listed for it: fewer than COMMON times a set's changes.
COMMON = 64
_FACTORS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
_NO_GRAMS = np.empty(0, np.uint64)


def samples(grams: np.ndarray) -> np.ndarray:
    """The least of a set of hashes in each of SAMPLES orders."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), 256):
            np.minimum(least, (_FACTORS[:, None] * grams[None, at : at + 256]).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A number for each table, from its ROWS samples."""
    out = np.zeros(TABLES, np.uint64)
    with np.errstate(over="ignore"):
        for row in least[: TABLES * ROWS].reshape(TABLES, ROWS).T:
            out = mix(out + row)
    return out


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Bits that an odd number of the samples fall on, as WORDS numbers; samples that two sets share cancel in an XOR."""
    with np.errstate(over="ignore"):
        at = (mix(least ^ _FACTORS) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def similarity(differing: float) -> float:
    """The Jaccard similarity that ``differing`` bits between two sketches speak for."""
    return 1 + BITS / (4 * SAMPLES) * math.log(max(1 - 2 * differing / BITS, 1e-9))


def most_differing(percent: int) -> int:
    """Bits that sketches of a pair with the similarity differ in at most, but for DEVIATIONS of their spread.

    The spread is that of SAMPLES draws and of the XOR of two sketches, whose bits are parities of the differing samples.
    """
    j = percent / 100
    thrown = 2 * SAMPLES * (1 - j)
    even = math.exp(-2 * thrown / BITS)
    mean = BITS / 2 * (1 - even)
    parity = max(BITS / 4 * (1 - even * even) - thrown * even * even, 0)
    drawn = SAMPLES * j * (1 - j) * (2 * even) ** 2
    return math.floor(mean + DEVIATIONS * math.sqrt(parity + drawn))


@dataclass(frozen=True)
class Method:
    """How sets meet and how they are judged before they are compared in whole."""

    #: The numbers that tables are keyed by, and a sketch of BITS bits as WORDS numbers, of a set of hashes.
    of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    #: An array with a key for each table, from the column of those numbers.
    keys: Callable[[Column], Column]
    #: Bits in which sketches of a pair with a similarity in percent differ at most.
    most: Callable[[int], int]
    #: How many of the tables come first, to find the families of crowded buckets, and whether there are more.
    first: int = 1 << 20
    more: bool = False


def _least(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    least = samples(grams)
    return bands(least), odd_sketch(least)


MINHASH = Method(_least, lambda b: b, most_differing)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([_NO_GRAMS, *arrays]).view(np.int64)))


def _set(text: bytes | None, width: int) -> np.ndarray:
    return np.unique(np.concatenate([_NO_GRAMS, *shingle_hashes(text or b"", width)]))


def _node(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


SKETCH = [f"s{i}" for i in range(WORDS)]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.coalesce(text, F.lit(""))).alias("part"), text.alias("text"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, method: Method = MINHASH) -> DataFrame:
    """(doc_id, part, node, n, bands, s0, s1, ...) of every row: the text's MD5, 128 bits that stand for its set of
    shingles, the set's size, and the set's bands and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [_set(x.as_py(), width) for x in b.column(2).cast(pa.binary())]
            made = [method.of(g) for g in grams]
            sketches = np.array([x for _, x in made], np.uint64).reshape(len(made), WORDS)
            found = _lists([x if len(g) else _NO_GRAMS for (x, _), g in zip(made, grams)])
            sizes = pa.array(np.array([len(g) for g in grams], np.int64))
            columns = [b.column(0), b.column(1), pa.array([_node(g) for g in grams], pa.binary()), sizes, found]
            columns += [pa.array(np.ascontiguousarray(sketches[:, i]).view(np.int64)) for i in range(WORDS)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "node", "n", "bands", *SKETCH])

    kinds = "doc_id long, part string, node binary, n long, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH)
    return _keyed(docs, id_col, text_col).mapInArrow(run, kinds)


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, grams) of the rows (doc_id, part) in ``wanted``, once a set, however often a row is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [_set(x.as_py(), width) for x in b.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([_node(g) for g in grams], pa.binary()), _lists(grams)], names=["node", "grams"])

    here = wanted.select(F.col("doc_id").alias("id_"), F.col("part").alias("part_"))
    # one plan at every size: a broadcast of short lists would only hold for small corpora
    texts = _keyed(docs, id_col, text_col).join(here.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("part") == F.col("part_")), "left_semi").select("text")
    return texts.mapInArrow(run, "node binary, grams array<long>").groupBy("node").agg(F.first("grams").alias("grams"))


def _fits(percent: int, method: Method, first: str, second: str) -> Column:
    """Whether sizes and sketches of two sets (columns with these endings) allow for the similarity."""
    differing = " + ".join(f"bit_count({s}{first} ^ {s}{second})" for s in SKETCH)
    return F.expr(f"100 * least(n{first}, n{second}) >= {percent} * greatest(n{first}, n{second}) and {differing} <= {method.most(percent)}")


def _changed_alike(reach: DataFrame, sets: DataFrame, percent: int, method: Method) -> DataFrame:
    """Pairs (node, node2) of different roots that are near a common pivot and may have the similarity; loses none.

    ``reach``: (pivot, node, n, root, out, sketch); of sets that are not ``out`` all have the same root.  Let d be the shingles in
    which a set differs from the pivot's.  Two sets of n and n2 shingles with the similarity differ in
    t = (n + n2) * (100 - percent) / (100 + percent) at most, so their d and d2 differences share (d + d2 - t) / 2 or more;
    that is over 0, or both would be linked with the pivot.  With differences in order from rare to frequent, two sets share
    one at places up to (d - d2 + t) / 2 and (d2 - d + t) / 2: of the set with fewer differences only the first t / 2 count, of
    the other t.  Copies that each have changes of their own share none, and those that many have, such as the pivot's own, are
    mostly past these places: they are cut off as arrays, and no rows are made of them.
    """
    whole = [sets.select(F.col("node").alias(a), F.col("grams").alias(b)) for a, b in (("pivot", "y"), ("node", "x"))]
    both = reach.select("pivot", "node", "out").join(whole[1], "node").join(whole[0], "pivot")
    apart = materialize(both.select("pivot", "node", "out", F.explode(F.array(F.concat(F.array_except("x", "y"), F.array_except("y", "x")))).alias("apart")).select("pivot", "node", "out", F.size("apart").alias("d"), "apart"))
    # a difference that none that is out has makes no pair, so frequency is counted among those, and what they lack comes first
    often = materialize(apart.where("out").select("pivot", F.explode("apart").alias("g")).groupBy("pivot", "g").agg(F.count("*").alias("f")))
    # what many have comes last and is listed: its places are known before rows are made of it; where that is all, no rest is looked at
    count = apart.where("out").groupBy("pivot").agg(F.count("*").alias("sets"))
    sorted_ = F.array_sort(F.collect_list(F.when(F.expr(f"{COMMON} * f > sets"), F.struct("f", "g"))))
    listed = materialize(often.join(count, "pivot").groupBy("pivot").agg(F.transform(sorted_, lambda x: x["g"]).alias("listed"), F.max(F.expr(f"{COMMON} * f <= sets")).alias("more")))
    parts = apart.join(listed, "pivot").select("pivot", "node", "d", "more", F.array_except("apart", "listed").alias("rare"), F.array_intersect("listed", "apart").alias("common"))
    parts = materialize(parts.join(reach.select("pivot", "node", "n", "root", "out", *SKETCH), ["pivot", "node"]))
    # of sets in the similarity the larger has 100 / percent times the shingles of the other at most
    most = f"(n + n * 100 / {percent}) * {100 - percent} / {100 + percent}"
    shared = parts.where("more").select("pivot", "node", (F.col("d") - F.size("common")).alias("last"), F.explode("rare").alias("g")).join(often, ["pivot", "g"])
    own = Window.partitionBy("pivot", "node")
    shared = shared.select("pivot", "node", "g", (F.col("last") - F.count("*").over(own) + F.row_number().over(own.orderBy("f", "g")) - 1).alias("at"))
    kept = ["pivot", "node", "n", "root", "out", "d", *SKETCH]
    early = shared.join(parts.select(*kept), ["pivot", "node"]).where(f"at <= {most}").select(*kept, "g", "at")
    late = parts.select(*kept, F.size("common").alias("c"), F.posexplode(F.expr(f"slice(common, 1, greatest(0, cast(floor({most}) as int) + 1 - d + size(common)))")).alias("i", "g"))
    placed = materialize(early.union(late.select(*kept, "g", (F.col("d") - F.col("c") + F.col("i")).alias("at"))))
    names = ["node", "n", "root", "out", "d", "at", *SKETCH]
    fewer = placed.where(f"2 * at <= {most}")
    more = placed.select("pivot", "g", *[F.col(c).alias(f"{c}2") for c in names])
    t = f"(n + n2) * {100 - percent} / {100 + percent}"
    meet = f"root != root2 and (d < d2 or d = d2 and node < node2) and 2 * at <= d - d2 + {t} and 2 * at2 <= d2 - d + {t}"
    found = [fewer.where("out").join(more, ["pivot", "g"]), fewer.where("not out").join(more.where("out2"), ["pivot", "g"])]
    out = materialize(found[0].union(found[1]).where(meet).where(_fits(percent, method, "", "2")).select("node", "node2").distinct())
    discard(apart, often, listed, parts, placed)
    return out


def _family(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(lead, pivot) of each lead in ``edges`` (lead, weight, node): the lead with the most weight that it meets, which that
    one meets in turn, and so on.  Leads with a common pivot have their sets compared at once, and not once a bucket."""
    leads = edges.select(F.col("lead").alias("node"), F.lit(True).alias("leads")).distinct()
    up = materialize(edges.join(leads, "node").groupBy(F.col("node").alias("lead")).agg(F.max_by("lead", F.struct("weight", "lead")).alias("pivot")))
    for _ in range(rounds):
        # weights rise on the way, so it ends; where it is longer than these doublings, more pivots stay
        past, up = up, materialize(up.join(up.select(F.col("lead").alias("pivot"), F.col("pivot").alias("next")), "pivot").select("lead", F.col("next").alias("pivot")))
        discard(past)
    return up


def _met(entries: DataFrame) -> DataFrame:
    """The rows of ``entries`` (id, family, t, k) whose key others have too, with m, their number, and ``to``, the least family
    among them, and ``one``, a set that has one.  Of over BUCKET sets one is enough to stand for those of the least family, and sets that
    are all of one family are left out."""
    # tables, so that Spark's skew join can divide a bucket that very many share; one plan at every size
    known = [F.min("family").alias("to"), F.max("family").alias("last"), F.count("family").alias("in"), F.min(F.expr("if(family is null, null, id)")).alias("one")]
    shared = materialize(entries.groupBy("t", "k").agg(F.count("*").alias("m"), *known).where("m > 1 and (`in` < m or to < last)").drop("last", "in"))
    other = shared.withColumnsRenamed({"t": "t_", "k": "k_"}).hint("merge")
    met = materialize(entries.join(other, F.expr(f"t = t_ and k = k_ and (m <= {BUCKET} or family is null or family != to or id = one)")).drop("t_", "k_"))
    discard(shared)
    return met


def _compared(met: DataFrame, nodes: DataFrame, percent: int, method: Method) -> tuple[DataFrame, DataFrame]:
    """Of sets that met: pairs (node, node2) that pass, from buckets of up to BUCKET sets, and (lead, weight, node, fits) from others."""
    info = nodes.select("id", "node", "n", *SKETCH).join(met.groupBy("id").agg(F.sum("m").alias("weight")), "id")
    held = materialize(met.select("t", "k", "id", "m").join(materialize(info), "id").drop("id"))
    few, crowded = held.where(F.col("m") <= BUCKET), held.where(F.col("m") > BUCKET)
    both = ["node", "n", *SKETCH]
    other = few.select("t", "k", *[F.col(c).alias(f"{c}2") for c in both])
    near = materialize(few.join(other, ["t", "k"]).where("node < node2").where(_fits(percent, method, "", "2")).select("node", "node2").distinct())
    lead = materialize(crowded.groupBy("t", "k").agg(F.max_by(F.struct(*both, "weight"), F.struct("weight", "node")).alias("f")).select("t", "k", "f.weight", *[F.col(f"f.{c}").alias(f"{c}2") for c in both]))
    edges = materialize(crowded.drop("weight").join(lead, ["t", "k"]).select(F.col("node2").alias("lead"), "weight", "node", _fits(percent, method, "", "2").alias("fits")).distinct())
    discard(held, lead)
    return near, edges


def _members(edges: DataFrame) -> DataFrame:
    family = _family(edges)
    out = materialize(edges.join(family, "lead").select("pivot", "node").distinct())
    discard(family)
    return out


def _second_round(nodes: DataFrame, members: DataFrame, percent: int, method: Method) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``_compared`` gives of the tables after the first ones, and all members (pivot, node), those of the first round among them.

    All sets of a family are compared with each other (``_changed_alike``), so buckets of these alone have nothing new, and in
    a crowded bucket one of them stands for all: others in it join its family, and families that meet there are one from then on.
    """
    own = members.groupBy("node").agg(F.min("pivot").alias("pivot")).select("node", F.xxhash64("pivot").alias("family"))
    held = materialize(nodes.select("id", "node", "bands").join(own, "node", "left").drop("node"))
    met = _met(held.select("id", "family", F.posexplode(F.slice(method.keys(F.col("bands")), method.first + 1, 1 << 20)).alias("t", "k")))
    near, edges = _compared(met.where(f"m <= {BUCKET} or to is null"), nodes, percent, method)
    crowded = met.where(f"m > {BUCKET} and to is not null")
    joined = materialize(crowded.where("family is null").select("id", "to", "one").distinct())
    led = members.select(F.xxhash64("pivot").alias("to"), "pivot").distinct()
    more = nodes.select("id", "node").join(joined.select("id", "to").distinct(), "id").join(led, "to").select("pivot", "node")
    both = ["node", "n", *SKETCH]
    ones = joined.join(nodes.select("id", *both), "id").join(nodes.select(F.col("id").alias("one"), *[F.col(c).alias(f"{c}2") for c in both]), "one")
    ones = materialize(ones.where(_fits(percent, method, "", "2")).select("node2", "node", F.lit(True).alias("fits")).distinct())
    meet = materialize(crowded.where("family != to").select(F.col("family").alias("a"), F.col("to").alias("b")).distinct())
    every = materialize(members.unionByName(more).unionByName(_members(edges)).distinct())
    if not meet.isEmpty():
        roots = connected_components(meet).select(F.col("node").alias("from"), F.col("root").alias("to")).join(led, "to").select("from", F.col("pivot").alias("first"))
        past, every = every, materialize(every.withColumn("from", F.xxhash64("pivot")).join(materialize(roots), "from", "left").select(F.coalesce("first", "pivot").alias("pivot"), "node").distinct())
        discard(past)
    discard(held, met, joined, meet)
    return near, edges.drop("weight").union(ones), every


def links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, method: Method = MINHASH) -> DataFrame:
    """Pairs (a, b) of nodes with the similarity, enough of them to connect all that such pairs connect.

    ``nodes`` has a row for each set: node, n, bands, sketch, and the doc_id and part of a row with that set, from which
    ``sets_of`` makes (node, grams).  In a bucket of up to BUCKET sets each meets all.  In others they are compared with the one
    that meets most others, which copies with changes have in their midst, and what is in different groups then meets where
    changes agree (``_changed_alike``).  The families found so in the first tables save entries in the others
    (``_second_round``).  Pairs pass by sizes and sketches inside the joins, so few rows leave them, and then by their whole
    sets, which are made for these only.
    """
    # 64 bits of a node keep entries short; sets that have them in common would only meet more sets
    short = nodes.withColumn("id", F.xxhash64("node"))
    firsts = short.select("id", F.lit(None).cast("long").alias("family"), F.posexplode(F.slice(method.keys(F.col("bands")), 1, method.first)).alias("t", "k"))
    met = _met(firsts)
    near, edges = _compared(met, short, percent, method)
    members = _members(edges)
    if method.more:
        near2, edges2, members = _second_round(short, members, percent, method)
        near, edges = materialize(near.union(near2).distinct()), materialize(edges.drop("weight").union(edges2).distinct())
    discard(met)
    wanted = materialize(near.select("node").union(near.select("node2")).union(edges.select("node")).union(members.select("node")).distinct())
    info = materialize(nodes.select("node", "n", *SKETCH).join(wanted, "node"))
    sets = materialize(sets_of(nodes.select("node", "doc_id", "part").join(wanted, "node")))
    discard(wanted)

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct())
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
        counted = both.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.explode(F.array(F.size(F.array_intersect("x", "y")))).alias("common"))
        out = materialize(counted.where(f"100L * common >= {percent}L * (total - common)").select("a", "b"))
        discard(pairs)
        return out

    if edges.isEmpty():
        found = confirmed(near)
        discard(edges, near, info, sets, members)
        return found
    # with the pivot, too: of two that are alike and share no change from it, each is alike with it
    pivots = info.select(F.col("node").alias("pivot"), *[F.col(c).alias(f"{c}2") for c in ("n", *SKETCH)])
    central = members.where("pivot != node").join(info, "node").join(pivots, "pivot").where(_fits(percent, method, "", "2")).select("node", F.col("pivot").alias("node2"))
    first = confirmed(edges.where("fits and lead != node").select("node", F.col("lead").alias("node2")).union(central))
    roots = connected_components(first)
    # a star of each group says as much as its links, is smaller and settles sooner
    made = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    rooted = materialize(info.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    reach = materialize(members.join(rooted, "node"))
    most = reach.groupBy("pivot", "root").agg(F.count("*").alias("c")).groupBy("pivot").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    reach = materialize(reach.join(materialize(most), "pivot").withColumn("out", F.col("root") != F.col("main")).drop("main", "roots"))
    pairs = near.union(_changed_alike(reach, sets, percent, method))
    root = [rooted.select(F.col("node").alias(n), F.col("root").alias(r)) for n, r in (("node", "root"), ("node2", "root2"))]
    rest = confirmed(pairs.join(root[0], "node").join(root[1], "node2").where("root != root2"))
    discard(edges, near, info, sets, first, rooted, members, reach)
    return made.union(rest)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, percent: int = 80, method: Method = MINHASH) -> DataFrame:
    """One row per row of ``docs``: doc_id, part (the text's MD5), n (its number of different shingles), root.

    Rows whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` or more are linked, and rows that links
    connect share a root.  Equal sets are one before the search.  Null texts and texts without words have the empty set
    and one root of their own.  Repeated rows give equal rows, rows without doc_id take part like any other, no rows
    give none, other columns, whatever their names, are not read, and long texts are hashed block by block, in whole.
    """
    small_batches(docs.sparkSession)
    found = materialize(signatures(docs, id_col, text_col, width, method))
    # the least row of a set stands for it: one of its texts is read again if the set is compared
    place = F.struct("doc_id", "part")
    same = ["n", "bands", *SKETCH]
    nodes = materialize(found.where("n > 0").groupBy("node").agg(F.min(place).alias("p"), F.first(F.struct(*same)).alias("f")).select("node", "p.doc_id", "p.part", "f.*"))
    roots = connected_components(links(nodes, lambda wanted: _sets(docs, wanted, id_col, text_col, width), percent, method)).withColumnRenamed("node", "node_")
    out = materialize(found.join(roots, F.col("node") == F.col("node_"), "left").select("doc_id", "part", "n", F.coalesce("root", "node").alias("root")))
    discard(found, nodes, roots)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, percent: int = 80) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (smallest doc_id reachable, itself included), kept.

    Links are those of ``groups``, but texts without words are linked with nothing and keep their own doc_id.
    A row without doc_id takes the smallest one reachable and isn't kept; if there is none, component_id is null and it
    stays.  Rows that share a doc_id are kept alike.
    """
    found = groups(docs, id_col, text_col, width, percent)
    named = materialize(found.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least")).select(F.col("root").alias("root_"), "least"))
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    out = found.join(named, F.col("root") == F.col("root_"), "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct doc_id, unnest(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as g from d),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.c >= 80 * (x.n + y.n - p.c)),
r as (select doc_id, doc_id as root from d union select r.doc_id, l.b from r join l on l.a = r.root),
o as (select doc_id, min(root) as component_id from r group by doc_id)
select o.doc_id, coalesce(n.n, 0) as n_shingles, o.component_id, o.doc_id = o.component_id as kept from o left join n on n.doc_id = o.doc_id"""
