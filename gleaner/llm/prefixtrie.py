"""Conversation prefix trie by distributed MSD radix partitioning and multikey quicksort.

Conversations are rebuilt: conversation c starts with the first h turns of conversation
c - c % SHARED, where h is crc32(decimal c) % STARTS, and goes on with its own turns after its
first h.  Each distinct turn (role, text) gets an integer from a dictionary table, so a
conversation is a row of integers and of word counts.

All conversations with the same first turns are a bucket, which is a node of the trie.  A round takes
the next DIGITS turns of the buckets of more than LOCAL turns as digits: partial counts
by prefix give the nodes of these levels, and each last prefix is a bucket of the next
round.  Buckets of at most LOCAL turns are finished in tasks that see one
bucket at a time: multikey quicksort splits its members by the turn at a depth into less,
equal and greater, and every equal part is a node.  The rounds end when no bucket is
large, so there are as many as long prefixes of many conversations need.

A small bucket's task knows its nodes' subtrees; the leaves and saved tokens of bucket and
upper nodes are summed up over each one's ancestors.  The digest of the conversations that end at an upper
node is taken over a sorted stream, so many copies of one conversation need no memory.

Defined results: turns come in order of turn (null first), role, text; null role or text
is empty; rows without conv_id are left out; a conversation without turns is a member of the
root alone; repeated rows are turns each; other columns are ignored; an empty table has no
node.  A conversation's integers, 16 bytes a turn, have to fit in a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.skew import meet

from .shared import cut

SHARED, STARTS = 20, 4
#: Turns of a round; members and turns left of a bucket that one task finishes, at most.
DIGITS, LOCAL = 8, 8192
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, ids, words): the rebuilt conversations as dictionary numbers and word counts of their turns."""
    rows = rows.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    label = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    turns = cut(rows.withColumn("pos", F.row_number().over(order) - 1).select("conv_id", "pos", label.alias("label"), F.expr(f"regexp_count(text, r'{WORD}')").cast("long").alias("words")))
    numbers = cut(turns.groupBy("label").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    numbered = cut(meet(turns, numbers, "label").select("conv_id", "pos", "id", "words"))
    start = F.crc32(F.col("conv_id").cast("string")) % STARTS
    own = numbered.where(F.col("pos") >= start)
    # of each SHARED conversations one lends at most STARTS turns
    heads = numbered.where(F.col("pos") < STARTS).select(F.col("conv_id").alias("from"), "pos", "id", "words")
    convs = numbered.select("conv_id").distinct()
    lent = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % SHARED).alias("from"), start.alias("h")).join(heads, "from").where("pos < h")
    none = convs.select("conv_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("words"))
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", "id", "words"))
    whole = own.unionByName(lent.select(*own.columns)).unionByName(none).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return whole.select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


def trie(seqs: DataFrame) -> DataFrame:
    """The nodes of the trie over rows (conv_id, ids, words)."""
    spark = seqs.sparkSession
    seqs = cut(seqs)
    all_ = seqs.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.sum(F.size("ids")).alias("turns")).first()
    if not all_["n"]:
        return spark.createDataFrame([], NODE)
    root = spark.createDataFrame([("", 0, 0, all_["conv_id"], all_["n"])], "node string, depth long, words long, conv_id long, n long").withColumn("path", F.array().cast("array<string>"))
    uppers, small = [root], []
    ends = [seqs.where("size(ids) = 0").select(F.lit("").alias("node"), "conv_id")]
    # node and path: the bucket and the nodes above it; top: the bucket's least member; size: its members and turns left
    rows = seqs.select("conv_id", "ids", "words", F.lit("").alias("node"), F.array().cast("array<string>").alias("path"), F.lit(all_["conv_id"]).alias("top"), F.lit(all_["n"] + all_["turns"]).alias("size"))
    depth = 0
    while True:
        small.append(rows.where((F.col("size") <= LOCAL) & (F.size("ids") > depth)).select("node", "top", F.lit(depth).cast("long").alias("depth"), "conv_id", F.slice("ids", depth + 1, F.size("ids")).alias("ids"), F.slice("words", depth + 1, F.size("words")).alias("words")))
        large = rows.where(F.col("size") > LOCAL)
        if large.isEmpty():
            break
        digits = F.slice("ids", depth + 1, DIGITS)
        named = F.aggregate(digits, F.array("node"), lambda names, i: F.concat(names, F.array(F.md5(F.concat_ws(":", F.element_at(names, -1), i.cast("string"))))))
        step = large.withColumn("names", named)
        level = step.select("conv_id", "path", "names", "words", F.size("ids").alias("len"), F.posexplode(F.expr("slice(names, 2, size(names))")).alias("k", "at"))
        level = level.select("conv_id", F.col("at").alias("node"), F.concat("path", F.expr("slice(names, 1, k + 1)")).alias("path"), (F.col("k") + depth + 1).cast("long").alias("depth"), F.expr(f"words[k + {depth}]").alias("words"), "len")
        upper = cut(level.groupBy("node", "path", "depth", "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")))
        uppers.append(upper)
        ends.append(cut(level.where("len = depth").select("node", "conv_id")))
        depth += DIGITS
        on = step.where(F.size("ids") > depth).select("conv_id", "ids", "words", F.element_at("names", -1).alias("node"), F.concat("path", F.expr("slice(names, 1, size(names) - 1)")).alias("path"))
        sizes = on.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.size("ids") - depth + 1).alias("size"))
        facts = cut(sizes.join(upper.select("node", F.col("conv_id").alias("top")), "node"))
        rows = cut(meet(on, facts, "node"))
    lower = cut(_union(small).repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_finished, f"node string, {NODE}"))
    return _assembled(cut(_union(uppers)), _union(ends), lower)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _assembled(uppers: DataFrame, ends: DataFrame, lower: DataFrame) -> DataFrame:
    """All nodes, from the upper ones, the ends at them, and the nodes and totals of small buckets."""
    digest = ends.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_digests, "node string, ends string")
    totals = lower.where("node is not null").select("node", "n_children", "n_leaves", "saved_tokens")  # one for each small bucket
    parents = cut(uppers.where("depth > 0").groupBy(F.element_at("path", -1).alias("node")).agg(F.count("*").alias("n_children")))
    children = parents.unionByName(totals.select("node", "n_children")).groupBy("node").agg(F.sum("n_children").alias("n_children"))
    known = cut(uppers.join(children, "node", "left").join(digest, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    own = known.select("node", "path", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved_tokens"))
    below = totals.select("node", "n_leaves", "saved_tokens").join(known.select("node", "path"), "node")
    summed = own.unionByName(below.select(*own.columns)).select(F.explode(F.concat("path", F.array("node"))).alias("node"), "n_leaves", "saved_tokens")
    summed = summed.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    above = cut(parents.join(known, "node").select(F.col("node").alias("up"), parents["n_children"].alias("n"), F.col("conv_id").alias("parent_conv_id")))
    under = meet(known.where("depth > 0").withColumn("up", F.element_at("path", -1)), above, "up").drop("up")
    tops = under.unionByName(known.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))).join(summed, "node")
    tops = tops.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
    return tops.unionByName(lower.where("node is null").drop("node"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's conversations, from rows in order of node, then conv_id."""
    now, digest = None, None
    for batch in batches:
        out = []
        for node, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if node != now:
                if digest:
                    out.append((now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], ["node", "ends"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["node", "ends"])


class Nodes:
    """Nodes as columns, in an order in which parents come first."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.ends: list[str] = []
        self.totals: list[tuple] = []
        self.size = 0

    def add(self, columns: tuple[np.ndarray, ...], ends: list[str]) -> None:
        self.parts.append(columns)
        self.ends += ends
        self.size += len(ends)

    def batch(self) -> pa.RecordBatch:
        """The nodes, and a row with the bucket's name and the totals of its subtree for each finished bucket."""
        n, m = self.size, len(self.totals)
        whole = [np.concatenate(c) for c in zip(*self.parts, strict=True)] if self.parts else [np.zeros(0, np.int64)] * 7
        node = pa.array([None] * n + [t[0] for t in self.totals], pa.string())
        total = [np.array([t[i] for t in self.totals], np.int64) for i in (1, 2, 3)]
        lead = [pa.concat_arrays([pa.array(whole[i].astype(np.int64)), pa.nulls(m, pa.int64())]) for i in range(4)]
        rest = [pa.array(np.concatenate([whole[4 + i].astype(np.int64), total[i]])) for i in range(3)]
        ends = pa.concat_arrays([pa.array(self.ends, pa.string()), pa.nulls(m, pa.string())])
        self.__init__()
        return pa.RecordBatch.from_arrays([node, *lead, *rest, ends], ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes below each small bucket, from rows in order of bucket, then conv_id."""
    out, bucket, members = Nodes(), None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("node").to_pylist()
        rest = [batch.column(c).to_pylist() for c in ("top", "depth", "conv_id")]
        lists = [batch.column(c) for c in ("ids", "words")]
        values, bounds = [c.flatten().to_numpy(zero_copy_only=False) for c in lists], [c.offsets.to_numpy() - c.offsets[0].as_py() for c in lists]
        for i, name in enumerate(names):
            if name != bucket:
                if members:
                    quicksort(out, bucket, members)
                bucket, members = name, []
            members.append((rest[0][i], rest[1][i], rest[2][i], values[0][bounds[0][i] : bounds[0][i + 1]], values[1][bounds[1][i] : bounds[1][i + 1]]))
        if out.size:
            yield out.batch()
    if members:
        quicksort(out, bucket, members)
    if out.size:
        yield out.batch()


def _sha(conv) -> str:
    return hashlib.sha256(str(conv).encode()).hexdigest()


def _chain(conv: int, start: int, length: int, parent: int) -> tuple[tuple[np.ndarray, ...], list[str]]:
    """The nodes of one conversation alone."""
    one = np.ones(length, np.int64)
    up = np.full(length, conv)
    up[0] = parent
    children = one.copy()
    children[-1] = 0
    return (np.full(length, conv), start + 1 + np.arange(length), up, one, children, one, np.zeros(length, np.int64)), [*[EMPTY] * (length - 1), _sha(conv)]


def quicksort(out: Nodes, bucket: str, members: list[tuple]) -> None:
    """Add the nodes below a bucket, whose members (top, depth, conv_id, ids, words) have turns left and come in order of conv_id."""
    top, base = members[0][0], members[0][1]
    convs = [m[2] for m in members]
    if len(members) == 1:
        out.add(*_chain(convs[0], base, len(members[0][3]), top))
        out.totals.append((bucket, 1, 1, 0))
        return
    ids, words = [m[3].tolist() for m in members], [m[4] for m in members]
    #: node -> conv_id, depth, parent, members, children, leaves, saved; and the place of its parent
    nodes: list[list] = []
    above: list[int] = []
    ends: list[str] = []
    chains: list[tuple] = []
    # members that agree on all turns before depth and have one more, with the place of their node
    stack = [(list(range(len(members))), 0, -1)]
    children = leaves = saved = 0
    while stack:
        rows, depth, at = stack.pop()
        if len(rows) == 1:
            conv = convs[rows[0]]
            chains.append(_chain(conv, base + depth, len(ids[rows[0]]) - depth, nodes[at][0] if at >= 0 else top))
            if at >= 0:
                nodes[at][4] += 1
                nodes[at][5] += 1
            else:
                children, leaves = children + 1, leaves + 1
            continue
        keys = [ids[r][depth] for r in rows]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less, equal, more = [], [], []
        for r, k in zip(rows, keys, strict=True):
            (less if k < pivot else equal if k == pivot else more).append(r)
        for part in (less, more):
            if part:
                stack.append((part, depth, at))
        if len(equal) == 1:
            stack.append((equal, depth, at))
            continue
        here = len(nodes)
        nodes.append([convs[equal[0]], base + depth + 1, nodes[at][0] if at >= 0 else top, len(equal), 0, 0, (len(equal) - 1) * int(words[equal[0]][depth])])
        above.append(at)
        if at >= 0:
            nodes[at][4] += 1
        else:
            children += 1
        done = [convs[r] for r in equal if len(ids[r]) == depth + 1]
        ends.append(hashlib.sha256(",".join(map(str, done)).encode()).hexdigest() if done else EMPTY)
        if rest := [r for r in equal if len(ids[r]) > depth + 1]:
            stack.append((rest, depth + 1, here))
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
        node = nodes[i]
        if not node[4]:
            node[5] = 1
        if above[i] >= 0:
            nodes[above[i]][5] += node[5]
            nodes[above[i]][6] += node[6]
        else:
            leaves, saved = leaves + node[5], saved + node[6]
    if nodes:
        out.add(tuple(np.array(c, np.int64) for c in zip(*nodes, strict=True)), ends)
    for chain in chains:
        out.add(*chain)
    out.totals.append((bucket, children, leaves, saved))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie over the rebuilt conversations."""
    return trie(sequences(conversations))


ORACLE = rf"""
with t as materialized (
    select conv_id::bigint as conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos,
        dense_rank() over (order by coalesce(role, ''), coalesce(text, '')) as id, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as words
    from conversations where conv_id is not null
), h as materialized (
    select conv_id, xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint), lambda s, b:
        list_reduce(range(8), lambda r, i: case when r % 2 = 1 then xor(r // 2, 3988292384::bigint) else r // 2 end, xor(s, b)), 4294967295::bigint), 4294967295::bigint) % {STARTS} as h
    from (select distinct conv_id from t)
), r as (
    select t.* from t join h using (conv_id) where pos >= h
    union all select h.conv_id, pos, id, words from h join t on t.conv_id = h.conv_id - h.conv_id % {SHARED} where pos < h
), c as materialized (
    select h.conv_id, coalesce(ids, []) as ids, coalesce(words, []) as words
    from h left join (select conv_id, list(id order by pos) as ids, list(words order by pos) as words from r group by 1) using (conv_id)
), p as (select conv_id, d, ids[1:d] as node, case when d > 0 then words[d] else 0 end as words, case when len(ids) = d then conv_id end as ended from c, unnest(range(len(ids) + 1)) t(d)),
n as materialized (
    select node, d as depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(words) as saved, sha256(coalesce(string_agg(ended::varchar, ',' order by ended), '')) as ends_sha256 from p group by 1, 2
), k as (select node[1:depth - 1] as node, count(*) as n_children from n where depth > 0 group by 1),
m as materialized (select n.*, coalesce(n_children, 0) as n_children from n left join k using (node)),
u as (select node[1:j] as node, count(*) filter (where n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens from m, unnest(range(depth + 1)) t(j) group by 1)
select m.conv_id, m.depth, a.conv_id as parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
from m join u using (node) left join n a on m.depth > 0 and a.node = m.node[1:m.depth - 1] and a.depth = m.depth - 1
"""
