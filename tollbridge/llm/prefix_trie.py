"""Prefix trie of conversations, with totals of subtrees rolled up in bands of depths.

A turn is known by a digest of role and text, a prefix by the sums of its turns' hashes with their
places; so prefixes are found by one ordered scan over ranges of rows, however long a conversation is.
Equal prefixes are one node. Totals of subtrees: the depths are cut into bands of fixed height. From the
deepest band up, each node of a band adds its own values to its ancestors inside the band only, and the
completed totals of a band's uppermost nodes are added to their parents before the next band goes. So a
node is repeated at most as often as a band is high, and there is a round per band.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tollbridge.llm.base import join_small, slices, space_words
from tollbridge.operators.attach import attach
from tollbridge.operators.ordered import range_pieces
from tollbridge.session import cut_lineage

#: Conversations of one group begin with the first turns of the first of them; how many, depends on the id.
GROUP = 20
SHARED_TURNS = 4
BAND = 64
#: Bytes of member ids that one row of the ids' digest holds.
BLOB_BYTES = 64 << 10
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
HASH = "decimal(20,0)"
SUM = "decimal(38,0)"


def _hashes(depth: Column, key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a turn at a depth; their exact sums tell prefixes apart."""
    return tuple(F.xxhash64(F.lit(seed), depth.cast("bigint"), key).cast(HASH) for seed in (1, 2))


def _node_id(depth: Column, a: Column, b: Column) -> Column:
    return F.md5(F.concat_ws(":", depth.cast("string"), a.cast(SUM).cast("string"), b.cast(SUM).cast("string")).cast("binary"))


def _total(heads: Column, part: str) -> Column:
    return F.aggregate(heads, F.lit(0).cast(SUM), lambda s, x: (s + x[part]).cast(SUM))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, the digest ``key`` of role and text, and the text's words; null role or text is empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), key.alias("key"),
        F.size(space_words(text)).cast("bigint").alias("words"),
    )


def _shared(rows: DataFrame) -> DataFrame:
    """base, and the first turns of each conversation that others begin with, as an array ``heads``."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    first = rows.where(F.col("conv_id") % GROUP == 0).withColumn("pos", F.row_number().over(order)).where(F.col("pos") < SHARED_TURNS)
    fa, fb = _hashes(F.col("pos"), F.col("key"))
    part = F.struct("pos", fa.alias("fa"), fb.alias("fb"), "words")
    return first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(part)).alias("heads"))


def _with_base(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows with ``h``, how many turns their conversation gives up, and the ``heads`` it gets for them."""
    based = rows.withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % GROUP,
        "h": (F.crc32(F.col("conv_id").cast("string")) % SHARED_TURNS).cast("int"),
    })
    joined = join_small(based, shared, "base")
    heads = F.slice(F.coalesce("heads", F.array().cast(shared.schema["heads"].dataType)), F.lit(1), F.col("h"))
    return joined.withColumn("heads", heads).drop("base")


def _carried(pieces: DataFrame, *values: Column) -> DataFrame:
    """What earlier pieces hold of the conversation that a piece begins with: at most a row per piece."""
    names = [f"before_{i}" for i in range(len(values))]
    groups = pieces.groupBy("_piece", "conv_id").agg(*[v.alias(n) for n, v in zip(names, values)])
    earlier = Window.partitionBy("conv_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = groups.select("_piece", "conv_id", *[F.sum(n).over(earlier).alias(n) for n in names])
    return sums.where(f"{names[0]} IS NOT NULL")


def _spread(pieces: DataFrame) -> DataFrame:
    """The conversations that lie in several pieces: fewer than pieces."""
    return pieces.groupBy("conv_id").agg(F.min("_piece").alias("low"), F.max("_piece").alias("high")).where("low < high").select("conv_id")


def paths(conversations: DataFrame) -> DataFrame:
    """A row per rebuilt conversation and depth: conv_id, depth, the node's id, its parent's and the turn's words."""
    rows = cut_lineage(turns(conversations), "turns")
    shared = cut_lineage(_shared(rows), "shared-turns")
    own = _with_base(rows, shared).select(
        "conv_id", "turn", "key", "words", "h", F.size("heads").alias("n_heads"),
        *[_total(F.col("heads"), c).alias(f"head_{c}") for c in ("fa", "fb")],
    )
    pieces = range_pieces(own, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")])
    spread = cut_lineage(_spread(pieces), "spread-turns")
    within = Window.partitionBy("_piece", "conv_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def placed(part: DataFrame, before: DataFrame) -> DataFrame:
        pos = F.row_number().over(Window.partitionBy("_piece", "conv_id").orderBy("_at")) + F.coalesce("before_0", F.lit(0))
        at = part.join(F.broadcast(before), ["_piece", "conv_id"], "left").withColumn("pos", pos).drop("before_0")
        at = at.withColumn("depth", F.col("pos") - F.col("h") + F.col("n_heads"))
        fa, fb = _hashes(F.col("depth"), F.col("key"))
        zero = F.lit(0).cast(HASH)
        given = F.col("pos") > F.col("h")
        return at.withColumns({"fa": F.when(given, fa).otherwise(zero), "fb": F.when(given, fb).otherwise(zero)})

    parted = pieces.join(F.broadcast(spread), "conv_id", "left_semi")
    counted = cut_lineage(_carried(parted, F.count(F.lit(1))), "turns-before")
    sums = _carried(placed(parted, counted), F.sum("fa").cast(SUM), F.sum("fb").cast(SUM))
    sums = cut_lineage(sums.select("_piece", "conv_id", F.col("before_0").alias("sum_a"), F.col("before_1").alias("sum_b")), "sums-before")
    zero = F.lit(0).cast(SUM)
    scanned = placed(pieces, counted).join(F.broadcast(sums), ["_piece", "conv_id"], "left").select(
        "conv_id", "depth", "pos", "h", "words", "fa", "fb",
        *[
            (F.sum(f).over(within).cast(SUM) + F.coalesce(f"sum_{f[1]}", zero) + F.col(f"head_{f}")).cast(SUM).alias(f[1])
            for f in ("fa", "fb")
        ],
    ).where("pos > h")
    heads = _with_base(rows.select("conv_id").distinct(), shared).select("conv_id", F.posexplode("heads").alias("i", "head"), "heads")

    taken = heads.select(
        "conv_id", (F.col("i") + 1).alias("depth"), F.col("head.words").alias("words"), F.col("head.fa").alias("fa"), F.col("head.fb").alias("fb"),
        _total(F.slice("heads", F.lit(1), F.col("i") + 1), "fa").alias("a"), _total(F.slice("heads", F.lit(1), F.col("i") + 1), "fb").alias("b"),
    )
    columns = ["conv_id", "depth", "words", "fa", "fb", "a", "b"]
    below = scanned.select(*columns).union(taken.select(*columns)).select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), _node_id(F.col("depth"), F.col("a"), F.col("b")).alias("id"),
        _node_id(F.col("depth") - 1, F.col("a") - F.col("fa"), F.col("b") - F.col("fb")).alias("parent"), "words",
    )
    root = rows.select("conv_id").distinct().select(
        "conv_id", F.lit(0).cast("bigint"), _node_id(F.lit(0), zero, zero), F.lit(None).cast("string"), F.lit(0).cast("bigint")
    )
    return cut_lineage(below.union(root), "trie-paths")


def end_digests(ends: DataFrame) -> DataFrame:
    """id and the digest of its conv_ids, ascending and joined by commas, for ``ends`` (id, conv_id).

    The ids are first put into long texts, range by range; a node's digest is then made of few rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, None, [], 0
        out: list[tuple] = []
        for batch in slices(batches, 1_000):
            for own, conv in zip(batch.column("id").to_pylist(), batch.column("conv_id").to_pylist()):
                if held and (own != node or size > BLOB_BYTES):
                    out.append((node, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    node, first = own, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            if sum(len(t) for _, _, t in out) > 1 << 20 or len(out) > 1_000:
                yield _table(out, ("id", "first", "ids"), (pa.string(), pa.int64(), pa.string()))
                out = []
        if held:
            out.append((node, first, ",".join(held)))
        yield _table(out, ("id", "first", "ids"), (pa.string(), pa.int64(), pa.string()))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for batch in slices(batches, 1_000):
            for own, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
                if own == node:
                    sha.update(b"," + ids.encode())
                    continue
                if sha is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = own, hashlib.sha256(ids.encode())
            if len(out) > 1_000:
                yield _table(out, ("id", "ends_sha256"), (pa.string(), pa.string()))
                out = []
        if sha is not None:
            out.append((node, sha.hexdigest()))
        yield _table(out, ("id", "ends_sha256"), (pa.string(), pa.string()))

    dealt = ends.select("id", "conv_id").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
    packed = dealt.mapInArrow(pack, "id string, first bigint, ids string")
    return packed.repartition("id").sortWithinPartitions("id", "first").mapInArrow(digest, "id string, ends_sha256 string")


def _table(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def roll_up(nodes: DataFrame, on_path: DataFrame, values: list[str], band: int = BAND) -> DataFrame:
    """id and the sums of ``values`` over each node's subtree, band by band from the deepest.

    ``nodes`` has id, parent, depth, conv_id (a conversation through the node) and the values; ``on_path``
    has the id at each conv_id and depth.
    """
    deepest = nodes.agg(F.max("depth")).first()[0]
    done, added = [], None
    for k in range((deepest or 0) // band, -1, -1):
        inside = F.col("depth").between(k * band, (k + 1) * band - 1)
        own = nodes.where(inside).select("id", "conv_id", F.col("depth").alias("low"), *values)
        if added is not None:
            own = attach(own, added, ["id"])
            own = own.select("id", "conv_id", "low", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values])
        above = on_path.where(inside).select(F.col("conv_id").alias("_conv"), "depth", F.col("id").alias("above"))
        met = own.join(above, (F.col("conv_id") == F.col("_conv")) & (F.col("depth") <= F.col("low")))
        total = met.groupBy(F.col("above").alias("id")).agg(*[F.sum(v).cast("bigint").alias(v) for v in values])
        total = cut_lineage(total, "trie-band")
        done.append(total)
        if k:
            tops = nodes.where(F.col("depth") == k * band).select("id", "parent").join(total, "id")
            added = tops.groupBy(F.col("parent").alias("id")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
            added = cut_lineage(added, "trie-carry")
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def prefix_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """A row per node of the trie of the rebuilt conversations (conv_id, turn, role, text and any more).

    Columns: node_id, parent_id, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Turns are in the order of ``turn``, null first; those with equal
    numbers follow the digest of role and text, so that repeated rows are turns of their own and any order
    of the table gives one result. A null role or text is empty. Rows without a conv_id belong to no
    conversation. An empty table has no conversation and so no node. Prefixes are told apart by 128 bits
    of hash. Texts of any length count as a whole; further columns are ignored.
    """
    on_path = paths(conversations)
    nodes = on_path.groupBy("id").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
    )
    nodes = cut_lineage(nodes, "trie-nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = attach(nodes, children, ["id"]).withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint"))
    nodes = cut_lineage(nodes.withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words"),
    }), "trie-nodes")
    totals = roll_up(nodes, on_path, ["n_leaves", "saved_tokens"], band)
    ends = on_path.groupBy("conv_id").agg(F.max_by("id", "depth").alias("id"))
    digests = end_digests(cut_lineage(ends, "trie-ends"))
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.select("id", "parent", "conv_id", "depth", "n_convs", "n_children").join(totals, "id").join(digests, "id", "left")
    return attach(out, cut_lineage(parents, "trie-parents"), ["parent"]).select(
        F.col("id").alias("node_id"), F.col("parent").alias("parent_id"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"),
    )
