"""Trie of conversation prefixes from padded matrices of turn ids.

A turn is a 120-bit digest of its role and text and a number of words; texts are read once and
never shuffled (unless turns of one number repeat, see below). Conversations become rows of at most
``width`` turn ids, one per block of depths: a row knows its block, a digest of all that comes
before it and whether the conversation ends in it (in a further row without turns where it ends
with a full block). So neither a long conversation nor a frequent one makes a large row or group.

The rows are dealt out by ranges of (block, digest before, ids, conv_id). A range is one padded
matrix: sorted by ``numpy.lexsort``, compared with the row above, the change masks accumulated by
OR from left to right mark where the nodes of a depth begin, and ``reduceat`` over these places
aggregates every depth. All figures of a node are sums over its rows:

* the words of a turn that a row shares with the row above are those saved by it,
* a row whose conversation ends and that the next row does not go on from is a leaf,
* a row that begins a node of the next depth is a child.

Nodes on the path of the first or last row of a range, and those where blocks meet, are handed
on in part and recombined by key; two neighbouring ranges then correct what both counted, from their
bordering rows (two per range). Savings and leaves of later blocks are carried to earlier
ones by a running sum along the conversation.

Defined results: rows without conv_id take no part; null roles and texts are empty; null turns come
first; turns of equal number go by role, then text; repeated rows are turns of their own; an empty table
gives no nodes; other columns are not read. The digest of all ids that end in one node is
computed by one task that reads them in order, holding one batch: SHA-256 has no other way.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import materialize
from shelfspark.llm.text_stats import with_words
from shelfspark.operators.scan import running
from shelfspark.session import small_side

#: Turns of a row of the matrix; rows of a range aimed at.
WIDTH = 16
RANGE_ROWS = 131_072
_BITS = 60
_EMPTY = hashlib.sha256(b"").hexdigest()


def _digest(*parts: Column) -> tuple[Column, Column]:
    """120 bits of the MD5 of parts of known lengths, as two numbers."""
    sized = [x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]
    h = F.md5(F.concat(*sized).cast("binary"))
    return tuple(F.conv(F.substring(h, at, 15), 16, 10).cast("long") for at in (1, 16))


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, n, hi, lo, words): the turns of a conversation counted from 0, and how many it has."""
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Only where turns repeat do their texts decide the order and travel along.
    ties = [] if rows.groupBy("conv_id", "turn").count().filter("count > 1").isEmpty() else ["role", "told"]
    hi, lo = _digest(F.col("role"), F.col("text"))
    slim = with_words(rows.select("conv_id", "turn", hi.alias("hi"), lo.alias("lo"), *([F.col("role"), F.col("text").alias("told")] if ties else []), "text"))
    slim = materialize(slim, "digests")  # dealing out by ranges reads its input twice
    out = running(slim, ["conv_id"], [F.col("turn").asc_nulls_first(), *[F.col(c) for c in ties]], {"rank": F.lit(1)}, totals=True)
    return out.select("conv_id", (F.col("rank") - 1).alias("rank"), F.col("rank_total").alias("n"), "hi", "lo", "words")


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: the first h turns of conversation c - c % ``group``,
    then the own ones after the first h, where h = crc32(c) % ``heads``.

    (conv_id, pos, hi, lo, words) of all turns, and (conv_id, n) of all conversations.
    """
    turns = materialize(turns, "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.col("conv_id") % group
    first = turns.filter((F.col("conv_id") == base) & (F.col("rank") < heads - 1)).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "hi", "lo", "words"))).alias("head"))
    convs = turns.filter("rank = 0").select("conv_id", base.alias("base"), h.alias("h"), F.greatest(F.col("n") - h, F.lit(0)).alias("own"))
    none = F.array().cast(first.schema["head"].dataType)
    convs = materialize(convs.join(first, "base", "left").withColumn("head", F.slice(F.coalesce("head", none), F.lit(1), F.col("h").cast("int")))
                        .select("conv_id", "h", "own", "head", F.size("head").cast("long").alias("m")), "conversations")
    begin = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.rank").alias("pos"), "t.hi", "t.lo", "t.words")
    # Own turns keep their rank unless the base is shorter than h.
    moved = convs.filter("m < h").select("conv_id", (F.col("h") - F.col("m")).alias("short"))
    rest = turns.filter(F.col("rank") >= h).join(small_side(moved, moved.count(), 48), "conv_id", "left")
    rest = rest.select("conv_id", (F.col("rank") - F.coalesce("short", F.lit(0))).alias("pos"), "hi", "lo", "words")
    return begin.unionByName(rest), convs.select("conv_id", (F.col("m") + F.col("own")).alias("n"))


# ------------------------------------------------------------------ rows of the matrix
def _rows(turns: DataFrame, sizes: DataFrame, width: int) -> DataFrame:
    """conv_id, block, p1, p2 (all before), d1, d2 (the block itself), ids, words, last, multi."""
    ends = sizes.select("conv_id", F.col("n").alias("pos"), F.lit(None).cast("long").alias("hi"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("words"))
    both = turns.select("conv_id", "pos", "hi", "lo", "words").unionByName(ends).withColumn("block", F.floor(F.col("pos") / F.lit(width)))
    held = both.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.when(F.col("hi").isNotNull(), F.struct("pos", "hi", "lo", "words")))).alias("t"),
                                                F.max(F.col("hi").isNull()).alias("last"))
    ids = F.flatten(F.transform("t", lambda t: F.array(t["hi"], t["lo"])))
    blocks = held.select("conv_id", "block", "last", ids.alias("ids"), F.col("t.words").alias("words"), (~((F.col("block") == 0) & F.col("last"))).alias("multi"))
    d1, d2 = _digest(F.concat_ws(",", F.col("block").cast("string"), F.col("ids").cast("array<string>")))
    return materialize(blocks.withColumns({"d1": d1, "d2": d2}), "rows")


def _with_before(rows: DataFrame) -> DataFrame:
    """Adds p1 and p2: sums of the block digests before."""
    zero = F.lit(0).cast("long")
    alone, many = rows.filter("NOT multi"), rows.filter("multi")
    alone = alone.withColumns({"p1": zero, "p2": zero})
    if many.isEmpty():
        return alone
    dec = {f"p{i}": F.col(f"d{i}").cast("decimal(38,0)") for i in (1, 2)}
    summed = running(many, ["conv_id"], [F.col("block")], dec)
    return alone.unionByName(summed.withColumns({f"p{i}": F.pmod(F.col(f"p{i}") - F.col(f"d{i}"), F.lit(1 << _BITS).cast("decimal(38,0)")).cast("long") for i in (1, 2)}))


_FIELDS = "block long, p1 long, p2 long, d1 long, d2 long, ids array<long>, words array<long>, last boolean, conv_id long"
_NODE = ("kind int, conv_id long, depth long, parent_conv_id long, q1 long, q2 long, k1 long, k2 long, n_convs long, n_children long, n_leaves long, saved long, "
         "ends_sha256 string, ends string")
_COLUMNS = [c.split(" ")[0] for c in _NODE.split(", ")]


def _key(width: int, block: int, p: tuple, full: tuple, ids, d: int) -> tuple[int, int]:
    """Key of the node of depth ``d`` of a block: known from either side where blocks meet."""
    if d == 0:
        return p
    if d == width:
        return tuple((int(a) + int(b)) % (1 << _BITS) for a, b in zip(p, full))
    h = hashlib.md5(np.array([block, *p, *ids[:2 * d]], np.int64).tobytes()).digest()
    return int.from_bytes(h[:8], "big") >> 4, int.from_bytes(h[8:], "big") >> 4


class _Shard:
    """One range as a sorted, padded matrix."""

    def __init__(self, table: pa.Table, width: int):
        get = lambda name: table.column(name).to_numpy().astype(np.int64)
        ids, words = table.column("ids").combine_chunks(), table.column("words").combine_chunks()
        many = np.diff(words.offsets.to_numpy())
        self.cols = cols = int(many.max())
        m = len(table)
        cell = np.repeat(np.arange(m) * cols - (np.cumsum(many) - many), many) + np.arange(many.sum())
        wide = np.full((m * cols, 2), -1, np.int64)  # -1 comes before every digest
        wide[cell] = ids.flatten().to_numpy().reshape(-1, 2)
        told = np.zeros(m * cols, np.int64)
        told[cell] = words.flatten().to_numpy()
        head = np.stack([get("block"), get("p1"), get("p2")], 1)
        conv, matrix = get("conv_id"), wide.reshape(m, 2 * cols)
        order = np.lexsort((conv, *matrix.T[::-1], *head.T[::-1]))
        self.width, self.m = width, m
        self.head, self.matrix, self.n, self.conv = head[order], matrix[order], many[order].astype(np.int64), conv[order]
        self.words = told.reshape(m, cols)[order]
        self.last = table.column("last").to_numpy(zero_copy_only=False).astype(bool)[order]
        self.full = np.stack([get("d1"), get("d2")], 1)[order]
        self.after = np.stack([get("after_saved"), get("after_leaves")], 1)[order]
        self.multi = table.column("multi").to_numpy(zero_copy_only=False).astype(bool)[order]
        # new[i, d]: row i begins a node of depth d (of the block).
        new = np.ones((m, cols + 1), bool)
        new[1:, 0] = (self.head[1:] != self.head[:-1]).any(1)
        if cols:
            new[1:, 1:] = (self.matrix[1:] != self.matrix[:-1]).reshape(m - 1, cols, 2).any(2)
        self.new = np.logical_or.accumulate(new, axis=1)
        goes_on = np.zeros(m, bool)
        goes_on[:-1] = ~self.new[np.arange(1, m), self.n[:-1]]
        self.leaf = self.last & ~goes_on
        inside = np.arange(1, cols + 1) <= self.n[:, None]
        reused = np.where(inside & ~self.new[:, 1:], self.words, 0)
        self.reuse = np.concatenate([reused[:, ::-1].cumsum(1)[:, ::-1], np.zeros((m, 1), np.int64)], 1)  # from depth d + 1 on

    def key(self, i: int, d: int) -> tuple[int, int]:
        return _key(self.width, int(self.head[i, 0]), tuple(int(x) for x in self.head[i, 1:]), tuple(self.full[i]), self.matrix[i], d)

    def nodes(self):
        """Rows of _NODE, depth by depth."""
        m, width = self.m, self.width
        leaves = np.where(self.last, self.leaf, self.after[:, 1])
        above = None
        for d in range(self.cols + 1):
            start = np.flatnonzero(self.new[:, d])
            stop = np.r_[start[1:], m]
            real = self.n[start] >= d
            open_ = (start == 0) | (stop == m) | (d == 0) | (d == width)
            root = (d == 0) & (self.head[start, 0] > 0)  # the depth of a full block before
            conv = np.minimum.reduceat(self.conv, start)
            child = (self.new[:, d + 1] & (self.n > d)).astype(np.int64) if d < self.cols else np.zeros(m, np.int64)
            saved = self.reuse[:, max(d - 1, 0)] + self.after[:, 0]
            out = {"n_convs": np.where(root, 0, stop - start), "n_children": np.add.reduceat(child, start), "n_leaves": np.where(root, 0, np.add.reduceat(leaves, start)),
                   "saved": np.where(root, 0, np.add.reduceat(saved, start))}
            ends = self.last & (self.n == d)
            n_ends = np.add.reduceat(ends.astype(np.int64), start)
            if above is not None:  # the node of the depth before that holds a node
                place = np.searchsorted(above["start"], start, "right") - 1
                p_conv, p_open, p_at = above["conv"][place], above["open"][place], above["start"][place]
            above = {"start": start, "conv": conv, "open": open_}
            pick = np.flatnonzero(real)
            frame = {name: [] for name in _COLUMNS}
            for j in pick:
                i, own = int(start[j]), bool(open_[j])
                text = ",".join(map(str, self.conv[i:i + n_ends[j]].tolist())) if n_ends[j] else ""
                k = self.key(i, d) if own else (None, None)
                q, parent = (None, None), None
                if d and p_open[j]:
                    q = self.key(int(p_at[j]), d - 1)
                elif d:
                    parent = int(p_conv[j])
                frame["kind"].append(int(own))
                frame["conv_id"].append(int(conv[j]))
                frame["depth"].append(int(self.head[i, 0]) * width + d)
                frame["parent_conv_id"].append(parent)
                for name, v in zip(("q1", "q2", "k1", "k2"), (*q, *k)):
                    frame[name].append(v)
                frame["ends_sha256"].append(None if own else hashlib.sha256(text.encode()).hexdigest() if text else _EMPTY)
                frame["ends"].append(text if own and text else None)
            for name, v in out.items():
                frame[name] = v[pick]
            yield frame

    def border(self, i: int) -> str:
        """Row ``i`` for the comparison with the neighbouring range."""
        n = int(self.n[i])
        return json.dumps({"head": self.head[i].tolist(), "full": self.full[i].tolist(), "ids": self.matrix[i, :2 * n].tolist(), "words": self.words[i, :n].tolist(),
                           "last": bool(self.last[i]), "conv": int(self.conv[i]), "multi": bool(self.multi[i])})


_ROW = "kind int, conv_id long, block long, saved long, leaves long, shard int, side int, border string"


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def _ranges(rows: DataFrame, width: int, range_rows: int) -> DataFrame:
    """The rows of a range in one partition, with its number."""
    n = rows.count()
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-n // range_rows), min(spread, n // 1024))
    cols = [c.split(" ")[0] for c in _FIELDS.split(", ")]
    dealt = rows.select(*cols, "multi", "after_saved", "after_leaves").repartitionByRange(parts, "block", "p1", "p2", "ids", "conv_id")
    return dealt.withColumn("shard", F.spark_partition_id())


def _over_ranges(rows: DataFrame, width: int, range_rows: int, ddl: str, emit) -> DataFrame:
    """``emit(shard)`` of every range, and its bordering rows (kind 2), written once."""
    schema = _arrow_schema(f"{ddl}, shard int, side int, border string")

    def run(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        shard, number = _Shard(table, width), table.column("shard")[0].as_py()
        for frame in emit(shard):
            size = len(next(iter(frame.values())))
            for at in range(0, size, 8192):
                yield pa.RecordBatch.from_arrays([pa.array(frame[f.name][at:at + 8192], f.type) if f.name in frame else pa.nulls(min(8192, size - at), f.type) for f in schema], schema=schema)
        ends = {"kind": [2, 2], "shard": [number] * 2, "side": [0, 1], "border": [shard.border(0), shard.border(shard.m - 1)]}
        yield pa.RecordBatch.from_arrays([pa.array(ends[f.name], f.type) if f.name in ends else pa.nulls(2, f.type) for f in schema], schema=schema)
    return materialize(_ranges(rows, width, range_rows).mapInArrow(run, f"{ddl}, shard int, side int, border string"), "ranges")


def _corrections(written: DataFrame, ddl: str, correct) -> DataFrame:
    """``correct(row above, first row of a range, turns that both share)`` where ranges meet; two
    rows per range, so the window over them is bounded by the number of ranges."""
    schema = _arrow_schema(ddl)
    pairs = (written.filter("kind = 2").select("shard", "side", "border").withColumn("above", F.lag("border").over(Window.orderBy("shard", "side")))
             .filter("side = 0 AND above IS NOT NULL").select("above", "border"))

    def run(batches):
        for b in batches:
            out = []
            for above, first in zip(b.column("above"), b.column("border")):
                x, y = json.loads(above.as_py()), json.loads(first.as_py())
                if x["head"] == y["head"]:
                    shared = 0
                    while shared < min(len(x["words"]), len(y["words"])) and x["ids"][2 * shared:2 * shared + 2] == y["ids"][2 * shared:2 * shared + 2]:
                        shared += 1
                    out += correct(x, y, shared)
            yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in out], schema=schema)
    return pairs.mapInArrow(run, ddl)


def _with_after(rows: DataFrame, width: int, range_rows: int) -> DataFrame:
    """Adds after_saved and after_leaves: what the later blocks of a conversation save and whether it is a leaf there."""
    zero = F.lit(0).cast("long")
    bare = rows.withColumns({"after_saved": zero, "after_leaves": zero})
    if rows.filter("multi").isEmpty():
        return bare
    ddl = "kind int, conv_id long, block long, saved long, leaves long"

    def emit(s: _Shard):
        at = np.flatnonzero(s.multi)
        yield {"kind": np.zeros(len(at), np.int64), "conv_id": s.conv[at], "block": s.head[at, 0], "saved": s.reuse[at, 0], "leaves": s.leaf[at].astype(np.int64)}

    def correct(x: dict, y: dict, shared: int):
        if y["multi"]:
            yield {"conv_id": y["conv"], "block": y["head"][0], "saved": sum(y["words"][:shared]), "leaves": 0}
        if x["multi"] and x["last"] and shared == len(x["words"]):
            yield {"conv_id": x["conv"], "block": x["head"][0], "saved": 0, "leaves": -1}
    written = _over_ranges(bare, width, range_rows, ddl, emit)
    own = written.filter("kind = 0").unionByName(_corrections(written, ddl, correct), allowMissingColumns=True)
    own = own.groupBy("conv_id", "block").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    later = running(own, ["conv_id"], [F.col("block").desc()], {"after_saved": F.col("saved"), "after_leaves": F.col("leaves")})
    later = later.select("conv_id", "block", (F.col("after_saved") - F.col("saved")).alias("after_saved"), (F.col("after_leaves") - F.col("leaves")).alias("after_leaves"))
    many = rows.filter("multi").join(later, ["conv_id", "block"])
    return materialize(bare.filter("NOT multi").unionByName(many), "rows")


def _ends_digests(parts: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): the digest of all ids that end in a node, read in order."""
    def run(batches):
        node = state = None
        for b in batches:
            out = []
            for d, k1, k2, ends in zip(*(b.column(c).to_pylist() for c in ("depth", "k1", "k2", "ends"))):
                if (d, k1, k2) != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (d, k1, k2), hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            yield rows(out)
        if node:
            yield rows([(*node, state.hexdigest())])

    def rows(out):
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["depth", "k1", "k2", "ends_sha256"])
    held = parts.filter("ends IS NOT NULL").select("depth", "k1", "k2", "ends", F.substring_index("ends", ",", 1).cast("long").alias("at"))
    return held.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "at").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, sizes: DataFrame, *, width: int = WIDTH, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per node over ``turns(conv_id, pos, hi, lo, words)`` and ``sizes(conv_id, n)``: conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = _with_after(_with_before(_rows(turns, sizes, width)), width, range_rows)

    def correct(x: dict, y: dict, shared: int):
        """The first row of a range began no node down to ``shared``; the row above is no leaf if it is all shared."""
        def at(r: dict, d: int, **figures):
            k = _key(width, r["head"][0], tuple(r["head"][1:]), tuple(r["full"]), r["ids"], d)
            zero = {"n_convs": 0, "n_children": 0, "n_leaves": 0, "saved": 0}
            return {"kind": 1, "depth": r["head"][0] * width + d, "k1": k[0], "k2": k[1], **zero, **figures}
        whole = lambda d: d > 0 or y["head"][0] == 0  # noqa: E731 (the root of a later block counts its children only)
        for d in range(shared + 1):
            yield at(y, d, saved=sum(y["words"][max(d - 1, 0):shared]) if whole(d) else 0, n_children=-1 if d < shared else 0)
        if x["last"] and shared == len(x["words"]):
            for d in range(shared + 1):
                if whole(d):
                    yield at(x, d, n_leaves=-1)
    written = _over_ranges(rows, width, range_rows, _NODE, _Shard.nodes)
    part = written.filter("kind = 1").unionByName(_corrections(written, _NODE, correct), allowMissingColumns=True)
    key = ["depth", "k1", "k2"]
    figures = ["n_convs", "n_children", "n_leaves", "saved"]
    whole = part.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
                                   *[F.sum(c).alias(c) for c in figures])
    whole = materialize(whole.join(_ends_digests(part), key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY))), "shared")
    names = small_side(whole.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("_parent")), whole.count(), 64)
    columns = ["conv_id", "depth", "parent_conv_id", "q1", "q2", *figures, "ends_sha256"]
    nodes = written.filter("kind = 0").select(*columns).unionByName(whole.select(*columns))
    return nodes.join(names, ["depth", "q1", "q2"], "left").select(
        "conv_id", "depth", F.coalesce("_parent", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def prefix_trie(conversations: DataFrame, **options) -> DataFrame:
    """The trie of the conversations as they are; see :func:`trie`."""
    turns = materialize(ranked_turns(conversations), "turns")
    return trie(turns.withColumnRenamed("rank", "pos").drop("n"), turns.filter("rank = 0").select("conv_id", "n"), **options)


def rebuilt_trie(conversations: DataFrame, group: int = 20, heads: int = 4, **options) -> DataFrame:
    """The trie of the conversations with shared beginnings; see :func:`rebuilt`."""
    return trie(*rebuilt(ranked_turns(conversations), group, heads), **options)
