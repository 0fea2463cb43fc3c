"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; the leaves of a source, ascending by ``doc_id``, make a
tree of runs of ``arity``; the roots of the sources make the top tree. A node's
label is (end of the leaves below it, level), so children come before their
parent. A sweep in label order sends each digest as a message to the parent's
label through a priority queue: when a label's time comes, its messages are
all at the head of the queue. The reversed sweep sends every node's proof
suffix (the siblings from there to the root) down to its children.

The queue is external: between passes it is a table of messages that Spark
shuffles by block (``arity`` ** ``depth`` neighbouring nodes of a tree) and
sorts by label, spilling as needed; inside a block the sweep needs only the
open runs. A pass lifts a block to one node, so a tree of n leaves takes
log(n) / (``depth`` log(``arity``)) passes, and a source with a third of all
rows is as many blocks as its rows make. Proofs are never shuffled with the
documents: one suffix goes to a block, its rows' proofs are made in the task.

Defined results: a null field counts as ``-``; a null ``source`` is a source of
its own, before all others; null ids come first in their source, equal ids by
leaf (equal rows are interchangeable); a null id tests as the empty text (crc
0); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizspark.llm.common import shared_table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DEPTH = 5
OUT_ROWS = 2_000


def H(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf_digest(**changed: Column) -> Column:
    """Digest of a row, with some fields replaced by other columns."""
    def field(name: str) -> Column:
        s = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*[field(f) for f in FIELDS]).cast("binary"), 256)


# --- sweeps over one block -----------------------------------------------------

def levels_of(n: int, arity: int, most: int) -> int:
    """Levels that a tree still has above ``n`` nodes, at most ``most``."""
    j = 0
    while n > 1 and j < most:
        n, j = -(-n // arity), j + 1
    return j


def forward(digests: list[str], arity: int, levels: int) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of every node above the given ones, in label order."""
    m, queue = len(digests), []

    def send(level: int, index: int, digest: str) -> None:
        if level < levels:  # to the parent's label
            up = index // arity
            heappush(queue, (min((up + 1) * arity ** (level + 1), m), level + 1, index, digest))
    for i, digest in enumerate(digests):
        send(0, i, digest)
        while queue and queue[0][0] <= i + 1:
            end, level = queue[0][:2]
            got = []
            while queue and queue[0][:2] == (end, level):
                got.append(heappop(queue)[2:])
            index, digest = got[0][0] // arity, H(*[d for _, d in got])
            yield level, index, digest
            send(level, index, digest)


def backward(digests: list[str], arity: int, levels: int, suffix: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(index, path) of every given node, last first. A path lists what stands
    left and right of the node in its run, level by level up to the root."""
    m = len(digests)
    at = {(0, i): d for i, d in enumerate(digests)} | {(j, i): d for j, i, d in forward(digests, arity, levels)}
    queue = [(-m, -levels, 0, tuple(suffix))]
    while queue:
        _, level, index, path = heappop(queue)
        if not level:
            yield index, path
            continue
        down = -level - 1
        run = []
        while len(run) < arity and (down, index * arity + len(run)) in at:
            run.append(at[down, index * arity + len(run)])
        for k in range(len(run)):
            child = index * arity + k
            heappush(queue, (-min((child + 1) * arity ** down, m), -down, child, ("".join(run[:k]), "".join(run[k + 1:]), *path)))


def fold(leaf: str, path) -> str:
    for i in range(0, len(path), 2):
        leaf = H(path[i], leaf, path[i + 1])
    return leaf


# --- tables ----------------------------------------------------------------------

def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx`` (position in their ``tree`` by the columns of
    ``order``) and ``n`` (the tree's size). Ranges of the sort key hold the rows;
    a tree's offsets come from one row per (tree, range)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order]
    t = shared_table(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                     .withColumn("pid", F.spark_partition_id()).withColumn("rid", F.monotonically_increasing_id()))
    per = t.groupBy("tree", "pid").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("k"))
    tree = Window.partitionBy("tree")  # at most a row per range
    before = tree.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("tree", "pid", (F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("k").over(tree).alias("n"))
    return t.join(per, ["tree", "pid"]).withColumn("idx", F.col("rid") + F.col("shift")).drop("pid", "rid", "shift")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of each (tree, block) of a sorted stream."""
    key, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            k = (r["tree"], r["block"])
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append(r)
    if rows:
        yield key, rows


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _in_order(messages: DataFrame) -> DataFrame:
    """Messages by block, sorted by label inside (a block's suffix first)."""
    return messages.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "idx")


def _block(size: int) -> Column:
    return F.floor(F.col("idx") / size).cast("long").alias("block")


def lift(nodes: DataFrame, arity: int = 3, depth: int = DEPTH) -> DataFrame:
    """(tree, idx, n, digest) -> the same ``depth`` levels higher, or at the root."""
    size = arity ** depth
    schema = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def run(batches):
        def found():
            for (tree, block), rows in _blocks(batches):
                n, digest = rows[0]["n"], rows[0]["digest"]
                for _, _, digest in forward([r["digest"] for r in rows], arity, levels_of(n, arity, depth)):
                    pass
                yield tree, block, -(-n // size), digest
        return _batches(found(), schema)
    m = nodes.select("tree", _block(size), F.lit(0).alias("kind"), "idx", "n", "digest")
    return _in_order(m).mapInArrow(run, "tree string, idx long, n long, digest string")


def _lower(nodes: DataFrame, suffixes: DataFrame, arity: int, depth: int, schema: pa.Schema, returns: str, each) -> DataFrame:
    """Reversed sweep: ``suffixes`` (tree, idx, path, subroot) of the blocks of
    ``nodes`` become ``each(node, path, subroot)``, a row per node."""
    size = arity ** depth
    extra = [c for c in nodes.columns if c not in ("tree", "idx")]

    def run(batches):
        def found():
            for _, rows in _blocks(batches):
                head, rows = rows[0], rows[1:]
                levels = levels_of(rows[0]["n"], arity, depth)
                for i, path in backward([r["digest"] for r in rows], arity, levels, head["path"]):
                    yield each(rows[i], path, head["subroot"])
        return _batches(found(), schema)
    down = nodes.select("tree", _block(size), F.lit(1).alias("kind"), "idx", *extra)
    head = suffixes.select("tree", F.col("idx").alias("block"), F.lit(0).alias("kind"), F.col("idx"), "path", "subroot")
    return _in_order(head.unionByName(down, allowMissingColumns=True)).mapInArrow(run, returns)


_SUFFIX = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("path", pa.list_(pa.string())), ("subroot", pa.string())])
_SUFFIX_SQL = "tree string, idx long, path array<string>, subroot string"


def lower(nodes: DataFrame, suffixes: DataFrame, arity: int = 3, depth: int = DEPTH) -> DataFrame:
    """Suffixes of ``nodes`` from those of the nodes ``depth`` levels higher."""
    return _lower(nodes.select("tree", "idx", "n", "digest"), suffixes, arity, depth, _SUFFIX, _SUFFIX_SQL,
                  lambda r, path, subroot: (r["tree"], r["idx"], path, subroot))


def _climb(nodes: DataFrame, arity: int, depth: int) -> list[DataFrame]:
    """Node tables from the leaves to the roots, each written once."""
    tables, most = [nodes], nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        tables.append(shared_table(lift(tables[-1].select("tree", "idx", "n", "digest"), arity, depth)))
        most = -(-most // arity ** depth)
    return tables


def manifest(docs: DataFrame, tampered_text: Column, tampers: Column, arity: int = 3, depth: int = DEPTH) -> DataFrame:
    """A row per document: doc_id, leaf, subroot, root, proof_sha256 (of the
    siblings to the root), folded_root (from the leaf of the text as it now is,
    ``tampered_text`` where ``tampers``, and the original siblings), verified."""
    spark = docs.sparkSession
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"), "doc_id",
                         leaf_digest().alias("digest"), F.when(tampers, leaf_digest(text=tampered_text)).alias("now"))
    source_tables = _climb(shared_table(numbered(leaves, ["doc_id", "digest"])), arity, depth)
    subroots = source_tables[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    top_tables = _climb(shared_table(numbered(subroots, ["source"])), arity, depth)
    top = top_tables[-1].select("digest").first()  # one row
    root = top["digest"] if top else ""
    paths = spark.createDataFrame([("", 0, [], None)] if top else [], _SUFFIX_SQL)
    for nodes in reversed(top_tables[:-1]):
        paths = lower(nodes, paths, arity, depth)
    paths = (top_tables[0].select("tree", "idx", "source", F.col("digest").alias("top"))
             .join(paths, ["tree", "idx"]).select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", F.col("top").alias("subroot")))
    for nodes in reversed(source_tables[1:-1]):
        paths = lower(nodes, paths, arity, depth)

    def judged(r, path, subroot):
        now = fold(r["now"] or r["digest"], path)
        return r["doc_id"], r["digest"], subroot, root, H(*path), now, now == root
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), *[(c, pa.string()) for c in names[1:-1]], ("verified", pa.bool_())])
    returns = f"doc_id {id_type.simpleString()}, " + ", ".join(f"{c} string" for c in names[1:-1]) + ", verified boolean"
    return _lower(source_tables[0], paths, arity, depth, schema, returns, judged)


def line_breaks_lost(docs: DataFrame, arity: int = 3) -> DataFrame:
    """The manifest checked against a copy of the table in which texts of every
    document whose crc32(doc_id as text) is even have lost their line breaks."""
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    return manifest(docs, F.translate(F.col("text"), "\n", ""), even, arity)
