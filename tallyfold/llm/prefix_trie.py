"""The trie of conversation prefixes, built from a skeleton of splitter paths and sorted shards.

A conversation is the path of its turns' digests (SHA-256 of role and text, cut to 128 bits). Paths are sorted with their
ids and cut into shards by splitters taken from a bounded sample. A node whose members lie in more than one shard is a prefix
of a splitter's path; those prefixes are the skeleton, which every task has. A shard is read once, in order: nodes that are not
in the skeleton are whole in it and are finished there; for skeleton nodes it returns partial aggregates, which are reduced
by node and then summed over the skeleton's subtrees. The ids that end at a skeleton node come as sorted pieces and are
hashed in one stream for each node, as the digest of a list asks for.

No conversation is held whole: turns are ranked over a global sort whose boundaries carry their counts over, and a
path of more than ``SEGMENT`` turns is cut into segments, each of which starts a trie of its own at the node where the
one before ends. Segments are worked from the deepest up, and their roots' totals join the paths above. Splitters hold at most
``SEGMENT`` turns of 16 bytes, of at most ``SHARDS`` shards.

Rows without a conversation id take no part. ``c - c % every`` is truncated towards zero, as in SQL. Turns are ordered by ``turn``, null first, and by digest where that is equal;
repeated rows are turns of their own. Null roles and texts are empty. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.keys import join_on_keys
from tallyfold.session import settle

SEGMENT = 512
SHARDS = 1024
SHARD_BYTES = 64 << 20
#: Sampled paths for each shard, and bytes of one piece of a list of ids.
SAMPLED = 8
PIECE_BYTES = 8 << 10
DIGEST = 16
WORD = r"[^\x20\x09-\x0D]+"
FOUND = pa.schema([
    ("kind", pa.string()), ("sk", pa.int64()), ("parent_sk", pa.int64()), ("above", pa.list_(pa.int64())),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ("words", pa.int64()), ("x_children", pa.int64()), ("x_leaves", pa.int64()), ("x_saved", pa.int64()),
    ("root", pa.binary()), ("next_root", pa.binary()), ("piece", pa.string())])
FOUND_DDL = (
    "kind string, sk long, parent_sk long, above array<long>, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, words long, x_children long, x_leaves long, "
    "x_saved long, root binary, next_root binary, piece string")
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_digest(role: Column, text: Column) -> Column:
    """Hexadecimal digest of a turn; the role's length keeps the two apart."""
    return F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)


def ranked_turns(turns: DataFrame) -> DataFrame:
    """``c``, ``r`` (from 1), ``d`` and ``w`` of every turn; ``turns``: ``c``, ``turn``, ``d``, ``w``.

    The turns are sorted over all tasks, so that one conversation may span many; each task's last count is
    carried over to the tasks in which that conversation goes on.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = None, 0
        for batch in batches:
            out = []
            for c in batch.column("c").to_pylist():
                rank = rank + 1 if c == last else 1
                last = c
                out.append(rank)
            yield pa.RecordBatch.from_arrays(
                [batch.column("c"), batch.column("d"), batch.column("w"), pa.array(out, pa.int64())], names=["c", "d", "w", "r"])

    order = ["c", F.col("turn").asc_nulls_first(), "d", "salt"]
    # Equal rows may be dealt to several tasks.
    laid = turns.withColumn("salt", F.monotonically_increasing_id() % 4096).repartitionByRange(*order).sortWithinPartitions(*order)
    ranks = laid.select("c", "d", "w").mapInArrow(local, "c long, d string, w int, r long")
    ranks = settle(ranks.withColumn("shard", F.spark_partition_id()), "trie-turns")
    ends = ranks.groupBy("shard").agg(F.min("c").alias("first"), F.max(F.struct("c", "r")).alias("last")).orderBy("shard").collect()
    carried, held, before = [], 0, None  # one entry for each task that goes on with a conversation
    for row in ends:
        if before is not None and row["first"] == before:
            carried.append((row["shard"], before, held))
        held = row["last"]["r"] + (held if row["last"]["c"] == before else 0)
        before = row["last"]["c"]
    if not carried:
        return ranks.drop("shard")
    offsets = ranks.sparkSession.createDataFrame(carried, "shard int, c long, held long")
    joined = join_on_keys(ranks, offsets, ["shard", "c"], how="left", small_right=True)
    return joined.select("c", "d", "w", (F.col("r") + F.coalesce("held", F.lit(0))).alias("r"))


def _joined(turns: Column) -> list[Column]:
    """A path's bytes and words, from an array of structs ``d``, ``w``."""
    path = F.unhex(F.array_join(F.transform(turns, lambda t: t["d"]), ""))
    return [path.alias("path"), F.transform(turns, lambda t: t["w"]).alias("words")]


def _sorted_turns() -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("r", "d", "w"))), lambda t: F.struct(t["d"].alias("d"), t["w"].alias("w")))


def rebuilt_paths(ranks: DataFrame, every: int, heads: int) -> DataFrame:
    """``seg``, ``root``, ``path``, ``words``, ``c``, ``next_root`` (null where the conversation ends) of all segments.

    A conversation starts with the first ``crc32(c) % heads`` turns of conversation ``c - c % every`` in place of
    as many turns of its own.
    """
    own = (F.crc32(F.col("c").cast("string").cast("binary")) % heads).cast("int")
    base = F.col("c") - F.col("c") % every
    convs = ranks.where("r = 1").select("c", own.alias("h"), base.alias("b"))
    tops = ranks.where((F.col("c") % every == 0) & (F.col("r") < heads)).groupBy("c").agg(_sorted_turns().alias("top"))
    tops = tops.select(F.col("c").alias("b"), "top")
    nothing = F.array().cast("array<struct<d: string, w: int>>")
    heads_of = join_on_keys(convs, tops, ["b"], how="left").select(
        "c", "h", F.when(F.col("h") > 0, F.slice(F.coalesce("top", nothing), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(nothing).alias("head"))
    heads_of = settle(heads_of, "trie-heads")
    rest = ranks.withColumn("h", own).where("r > h")
    most = SEGMENT - heads  # turns of its own that fit one segment with any head
    long = settle(rest.where(F.col("r") == F.col("h") + most + 1).select("c"), "trie-long")
    any_long = not long.isEmpty()
    short = rest.where(F.col("r") <= F.col("h") + most).groupBy("c").agg(_sorted_turns().alias("own"))
    whole = join_on_keys(heads_of, short, ["c"], how="left")
    whole = whole.select("c", F.concat("head", F.coalesce("own", nothing)).alias("turns"))
    if any_long:
        whole = join_on_keys(whole, long, ["c"], how="left_anti")
    none = F.lit(None).cast("binary")
    paths = whole.select(F.lit(0).cast("long").alias("seg"), F.lit(b"").alias("root"), *_joined(F.col("turns")), "c", none.alias("next_root"))
    if not any_long:
        return paths
    head = join_on_keys(heads_of, long, ["c"], how="left_semi")
    at_top = head.select("c", F.posexplode("head").alias("at", "t")).select("c", F.col("at").cast("long").alias("at"), "t.d", "t.w")
    below = join_on_keys(rest, head.select("c", F.size("head").alias("n")), ["c"])
    below = below.select("c", (F.col("r") - F.col("h") + F.col("n") - 1).alias("at"), "d", "w")
    cut = at_top.union(below).withColumn("r", F.col("at")).groupBy("c", F.floor(F.col("at") / SEGMENT).alias("seg")).agg(_sorted_turns().alias("turns"))
    cut = settle(cut.select("c", "seg", *_joined(F.col("turns"))), "trie-segments")
    # A segment's root is named by the digests of all segments before it; the list has one entry a segment.
    parts = F.sort_array(F.collect_list(F.struct("seg", F.sha2("path", 256).alias("x"))))
    def step(acc: Column, part: Column) -> Column:
        name = F.sha2(F.concat(acc["name"], part["x"]), 256)
        return F.struct(name.alias("name"), F.concat(acc["names"], F.array(name)).alias("names"))
    start = F.struct(F.lit("").alias("name"), F.array(F.lit("")).alias("names"))
    names = cut.groupBy("c").agg(F.aggregate(parts, start, step)["names"].alias("names"))
    named = names.select("c", F.posexplode("names").alias("seg", "name"), (F.size("names") - 2).alias("last"))
    root = F.unhex(F.substring("name", 1, 2 * DIGEST))
    named = named.select("c", F.col("seg").cast("long").alias("seg"), root.alias("root"), "last")
    after = named.select("c", (F.col("seg") - 1).alias("seg"), F.when(F.col("seg") <= F.col("last"), F.col("root")).alias("next_root"))
    segments = join_on_keys(join_on_keys(cut, named.drop("last"), ["c", "seg"]), after, ["c", "seg"])
    return paths.unionByName(segments.select("seg", "root", "path", "words", "c", "next_root"))


class _Open:
    """A node on the path that is being read."""

    __slots__ = ("depth", "words", "n", "least", "children", "leaves", "saved", "ends", "sk", "waiting", "x", "next_root", "ids")

    def __init__(self, depth: int, words: int, sk: int | None):
        self.depth, self.words, self.sk = depth, words, sk
        self.n, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends, self.waiting, self.x, self.next_root, self.ids = None, [], None, None, []


def skeleton_of(splitters: list[tuple]) -> dict[bytes, tuple[int, int | None, list[int]]]:
    """Number, parent's number and numbers from the top down to itself, of every prefix of the splitters' paths."""
    found: dict[bytes, tuple] = {}
    for root, path, _ in splitters:
        above: list[int] = []
        for end in range(0, len(path) + 1, DIGEST):
            key = _key(root, path[:end])
            if key not in found:
                found[key] = (len(found), above[-1] if above else None, [*above, len(found)])
            above = found[key][2]
    return found


def _key(root: bytes, path: bytes) -> bytes:
    return bytes([len(root)]) + root + path


def _reading(splitters, base_depth: int) -> Callable:
    """The task: reads a sorted shard once; ``splitters`` is a broadcast list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton = skeleton_of([(b"", b"", 0), *splitters.value])
        rows: list[dict] = []
        stack: list[_Open] = []
        root, path = None, b""

        def flushed(node: _Open) -> None:
            if node.ids:
                rows.append({"kind": "piece", "sk": node.sk, "conv_id": node.ids[0], "piece": ",".join(map(str, node.ids))})
                node.ids = []

        def released(node: _Open) -> None:
            """Finished children whose parent's least id is known, or is left to the reduction."""
            for child in node.waiting:
                child["parent_sk" if node.sk is not None else "parent_conv_id"] = node.sk if node.sk is not None else node.least
                if node.depth == 0 and base_depth:
                    child["parent_sk"] = child["parent_conv_id"] = None
                    child["root"] = root
                rows.append(child)
            node.waiting = []

        def close() -> None:
            node = stack.pop()
            above = stack[-1] if stack else None
            x = node.x or (0, 0, 0)
            if above is not None:
                above.n += node.n
                above.least = node.least if above.least is None else min(above.least, node.least)
            found = {"conv_id": node.least, "depth": base_depth + node.depth, "n_convs": node.n, "words": node.words, "next_root": node.next_root}
            if node.sk is not None:
                flushed(node)
                released(node)
                number, parent, line = skeleton[_key(root, path[:node.depth * DIGEST])]
                rows.append(found | {
                    "kind": "part", "sk": number, "parent_sk": parent, "above": line, "n_children": node.children, "n_leaves": node.leaves,
                    "saved_tokens": node.saved, "x_children": x[0], "x_leaves": x[1], "x_saved": x[2], "root": root})
                return
            children = node.children + x[0]
            leaves = node.leaves + x[1] if children else 1
            saved = node.saved + x[2] + (node.n - 1) * node.words
            if node.depth == 0:  # the root of a later segment: its totals go to the node above
                released(node)
                rows.append({"kind": "root", "root": root, "n_children": children, "n_leaves": leaves, "saved_tokens": node.saved + x[2]})
                return
            ends = (node.ends or hashlib.sha256()).hexdigest()
            released(node)
            above.waiting.append(found | {"kind": "node", "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends})
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
            if above.sk is not None:
                released(above)

        def part() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in FOUND], schema=FOUND)
            rows.clear()
            return out

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("root", "path", "words", "c", "next_root", "x_children", "x_leaves", "x_saved")]
            for r, p, words, c, next_root, *x in zip(*columns):
                if r != root:
                    while stack:
                        close()
                    root, path = r, b""
                    stack.append(_Open(0, 0, skeleton.get(_key(r, b""), [None])[0]))
                shared = 0
                while shared < len(stack) - 1 and p[shared * DIGEST: (shared + 1) * DIGEST] == path[shared * DIGEST: (shared + 1) * DIGEST]:
                    shared += 1
                while len(stack) > shared + 1:
                    close()
                path = p
                for depth in range(shared + 1, len(p) // DIGEST + 1):
                    known = skeleton.get(_key(r, p[:depth * DIGEST])) if stack[-1].sk is not None else None
                    stack.append(_Open(depth, words[depth - 1], known[0] if known else None))
                node = stack[-1]
                node.n += 1
                node.least = c if node.least is None else min(node.least, c)
                if next_root is not None:
                    node.next_root, node.x = next_root, tuple(x)
                elif node.sk is not None:
                    node.ids.append(c)
                    if len(node.ids) * 20 > PIECE_BYTES:
                        flushed(node)
                elif node.ends is None:
                    node.ends = hashlib.sha256(str(c).encode())
                else:
                    node.ends.update(f",{c}".encode())
                if len(rows) >= 5000:
                    yield part()
        while stack:
            close()
        yield part()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order."""
    at, digest = None, None
    for batch in batches:
        out = []
        for sk, piece in zip(batch.column("sk").to_pylist(), batch.column("piece").to_pylist()):
            if sk != at:
                if at is not None:
                    out.append((at, digest.hexdigest()))
                at, digest = sk, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string()))], names=["sk", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([digest.hexdigest()])], names=["sk", "ends_sha256"])


def _read_shards(paths: DataFrame, base_depth: int) -> DataFrame:
    """What the shards of one segment return; the table is written."""
    spark = paths.sparkSession
    total = paths.agg(F.sum(F.octet_length("path") + 64)).first()[0] or 0
    shards = min(SHARDS, max(spark.sparkContext.defaultParallelism, -(-total // SHARD_BYTES)))
    picked = paths.select("root", "path", "c", F.xxhash64("c", "root").alias("x")).orderBy("x", "c", "root").limit(shards * SAMPLED)
    picked = sorted((bytes(r["root"]), bytes(r["path"]), r["c"]) for r in picked.toArrow().to_pylist())
    step = max(1, len(picked) // shards)
    splitters = picked[step::step][:shards - 1]
    sent = spark.sparkContext.broadcast(splitters)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(n).to_pylist() for n in ("root", "path", "c")))
            yield batch.append_column("shard", pa.array([bisect.bisect_right(sent.value, k) for k in keys], pa.int32()))

    names = ["root", "path", "words", "c", "next_root", "x_children", "x_leaves", "x_saved"]
    kinds = "root binary, path binary, words array<int>, c long, next_root binary, x_children long, x_leaves long, x_saved long, shard int"
    laid = paths.select(*names).mapInArrow(dealt, kinds).repartitionById(len(splitters) + 1, "shard").sortWithinPartitions("root", "path", "c")
    found = settle(laid.select(*names).mapInArrow(_reading(sent, base_depth), FOUND_DDL), "trie-found")
    sent.destroy()
    return found


def _reduced(found: DataFrame) -> DataFrame:
    """Whole aggregates of the skeleton's nodes (``sk``), from the shards' parts."""
    parts = found.where("kind = 'part'").groupBy("sk").agg(
        F.min("parent_sk").alias("parent_sk"), F.first("above").alias("above"), F.min("depth").alias("depth"), F.min("root").alias("root"),
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("words").alias("words"), F.max("next_root").alias("next_root"),
        (F.sum("n_children") + F.max("x_children")).alias("n_children"), (F.sum("n_leaves") + F.max("x_leaves")).alias("n_leaves"),
        (F.sum("saved_tokens") + F.max("x_saved")).alias("saved_tokens"))
    parts = settle(parts, "trie-parts")
    inner = parts.where("parent_sk IS NOT NULL").groupBy(F.col("parent_sk").alias("sk")).agg(F.count(F.lit(1)).alias("inner"))
    parts = join_on_keys(parts, inner, ["sk"], how="left").withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0)))
    own = parts.select(
        F.explode("above").alias("sk"), (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("l"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("s"))
    sums = own.groupBy("sk").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    pieces = found.where("kind = 'piece'").select("sk", "conv_id", "piece")
    ends = pieces.repartition("sk").sortWithinPartitions("sk", "conv_id").select("sk", "piece").mapInArrow(_hashed, "sk long, ends_sha256 string")
    out = join_on_keys(join_on_keys(parts.drop("n_leaves", "saved_tokens", "inner"), sums, ["sk"]), ends, ["sk"], how="left")
    return settle(out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))), "trie-skeleton")


def _segment_nodes(paths: DataFrame, seg: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of one segment and the totals of its roots. Nodes right under a root have its name in ``root``, and nodes
    in which a path goes on in a further segment that one's root in ``next_root``."""
    base_depth = seg * SEGMENT
    found = _read_shards(paths, base_depth)
    skeleton = _reduced(found)
    names = [*NODE, "root", "next_root"]
    whole = found.where("kind = 'node'")
    parent = skeleton.select(F.col("sk").alias("parent_sk"), F.col("conv_id").alias("p"))
    least = F.coalesce("parent_conv_id", "p").alias("parent_conv_id")
    nodes = join_on_keys(whole, parent, ["parent_sk"], how="left").select(*[least if n == "parent_conv_id" else n for n in names])
    upper = join_on_keys(skeleton, parent, ["parent_sk"], how="left").withColumn("parent_conv_id", F.col("p"))
    if not base_depth:
        return nodes.unionByName(upper.withColumn("root", F.lit(None).cast("binary")).select(*names)), None
    # The roots of later segments are nodes of the segment before.
    tops = upper.where("parent_sk IS NULL")
    top_ids = tops.select(F.col("sk").alias("parent_sk"), F.lit(True).alias("under"))
    inside = join_on_keys(upper.where("parent_sk IS NOT NULL"), top_ids, ["parent_sk"], how="left")
    inside = inside.withColumn("root", F.when(F.col("under"), F.col("root"))).withColumn("parent_conv_id", F.when(F.col("under").isNull(), F.col("p")))
    totals = ["root", "n_children", "n_leaves", "saved_tokens"]
    roots = found.where("kind = 'root'").select(*totals).unionByName(tops.where("octet_length(root) > 0").select(*totals))
    return nodes.unionByName(inside.select(*names)), roots


def prefix_trie(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", every: int = 20, heads: int = 4,
) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations; see the module for the order of turns."""
    role_, text_ = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text))
    plain = turns.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("c"), F.col(turn).alias("turn"), turn_digest(role_, text_).alias("d"),
        F.regexp_count(text_, F.lit(WORD)).alias("w"))
    paths = settle(rebuilt_paths(ranked_turns(plain), every, heads), "trie-paths")
    last = paths.agg(F.max("seg")).first()[0]
    nothing = [F.lit(0).cast("long").alias(n) for n in ("x_children", "x_leaves", "x_saved")]
    if last is None:
        last = 0
    tables, roots = [], None
    for seg in range(last, -1, -1):
        own = paths.where(F.col("seg") == seg)
        if roots is None:
            own = own.select("*", *nothing)
        else:
            below = roots.select(F.col("root").alias("next_root"), F.col("n_children").alias("x_children"), F.col("n_leaves").alias("x_leaves"), F.col("saved_tokens").alias("x_saved"))
            own = join_on_keys(own, below, ["next_root"], how="left")
        nodes, roots = _segment_nodes(own, seg)
        tables.append((seg, settle(nodes, "trie-nodes") if last else nodes))
    out = None
    for i, (seg, nodes) in enumerate(tables):
        if seg:  # parents right above a segment are nodes of the one before
            ends = tables[i + 1][1].where("next_root IS NOT NULL").select(F.col("next_root").alias("root"), F.col("conv_id").alias("q"))
            nodes = join_on_keys(nodes, ends, ["root"], how="left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "q"))
        nodes = nodes.select(*NODE)
        out = nodes if out is None else out.unionByName(nodes)
    return out
