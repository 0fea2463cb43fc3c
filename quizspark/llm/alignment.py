"""Cross-tokenizer alignment: which tokens of one vocabulary stand for which of
another, and in how many documents.

A text is encoded by a byte-level BPE (A) and a sentence-piece model (B). Where
tokens of both end at the same byte, the text is cut; tokens of one group are
linked, each of A with each of B. A pair of ids counts once per document.

Texts are encoded once, into a shared table of ids (two bytes a token). Then:

1. First pass: documents are aligned, each task combines the pairs of its
   documents and writes (pair, documents) rows.
2. The distinct pairs are dealt into shards of about ``SHARD_KEYS``; each shard
   gets a minimal perfect hash, with its keys in hash order (``perfect_hash``).
3. The written rows of ``FAN`` tasks become one dense vector of counts a shard,
   indexed by the hash (keys are verified); vectors are summed as a tree, ``FAN``
   at a time, until each shard has one.
4. Second pass: documents are aligned again, from the written ids, and their links looked up. Hashes,
   keys and counts are broadcast in slabs of at most ``SLAB_KEYS`` keys, 17 bytes
   each; with more pairs than that there is a pass per slab, whose sums are added.

Documents are aligned some hundred thousand tokens at a time (a longer one by
itself); links are expanded at most ``MAX_LINKS`` at a time, and a group with more
is reduced to its distinct ids first, so memory does not grow with the links.

Defined results: null and empty texts, and texts that either tokenizer does not
give back byte by byte (with the space before them), have zeros and an empty
``groups_sha256``; strings of special tokens are ordinary text; repeated rows
count each; an empty table gives an empty result. Only ``doc_id`` and ``text``
are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizspark.llm import perfect_hash
from quizspark.llm.common import bounded_batches, shared_table

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: the splitting pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_KEYS = 1 << 15
SLAB_KEYS = 1 << 22
FAN = 64
MAX_LINKS = 1 << 22
CHUNK_CHARS = 250
BATCH_BYTES = 800_000
FLUSH_PAIRS = 1 << 21
_LOADED: dict = {}
_INNER_SPACE = re.compile("[^▁]▁")


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes a byte as a letter: printable bytes of Latin-1 as
    themselves, the others as the letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers with the bytes of each token."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        import tiktoken
        spec = json.loads(a_json)
        letters, special = _byte_letters(), {t["content"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        merges = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merges != sorted(merges):
            raise ValueError("the merges of vocabulary A are not in the order of their ids")
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.n_a, self.n_b = max(vocab.values()) + 1, self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i in range(self.n_b) for p in [self.b.id_to_piece(i)]]
        self.a_len, self.b_len = np.zeros(self.n_a, np.int64), np.array([len(x) for x in self.b_bytes], np.int64)
        for t, i in ranks.items():
            self.a_len[i] = len(t)
        #: "id," and "id|" for A, "id," and "id;" for B, eight bytes each
        self.written = np.array([b"%d%c" % (i, c) for n, ends in ((self.n_a, b",|"), (self.n_b, b",;")) for i in range(n) for c in ends], "S8")
        self.kind = np.dtype("<u2" if max(self.n_a, self.n_b) <= 1 << 16 else "<u4")
        # where no piece goes on past a word's end and spaces are kept, the pieces of
        # a text are those of its parts, cut after words; short ones are encoded faster
        whole = any(_INNER_SPACE.search(self.b.id_to_piece(i)) for i in range(self.n_b)) or self.b.normalize("  a  b ") != "▁▁▁a▁▁b▁"
        self.parts = (lambda spaced: [spaced]) if whole else re.compile("(?s).{1,%d}[^ ]*(?:(?<= ) *[^ ]*)?" % CHUNK_CHARS).findall
        self.space = self.b.piece_to_id("▁")

    def encode_b(self, spaced: str) -> list[int]:
        ids: list[int] = []
        for part in self.parts(spaced):
            ids += self.b.encode(part[1:], num_threads=1) if part != " " else [self.space]
        return ids

    def encode(self, text: str | None) -> tuple[bytes, bytes] | None:
        """Ids of A and B as bytes; None where there are none."""
        if not text or "▁" in text:  # that letter would come back as a space
            return None
        spaced = " " + text
        raw, a, b = spaced.encode(), self.a.encode_ordinary(spaced), self.encode_b(spaced)
        if self.a.decode_bytes(a) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, self.kind).tobytes(), np.array(b, self.kind).tobytes()


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], ends[:-1] + 1))


class Aligned:
    """Documents with tokens, aligned together: their ids joined end to end."""

    def __init__(self, tok: Tokenizers, coded: list[tuple[bytes, bytes]]):
        self.tok = tok
        (self.n_a, self.a), (self.n_b, self.b) = (
            (np.array([len(x) for x in ids], np.int64) // tok.kind.itemsize, np.frombuffer(b"".join(ids), tok.kind).astype(np.int64))
            for ids in zip(*coded))
        a_end, b_end = np.cumsum(tok.a_len[self.a]), np.cumsum(tok.b_len[self.b])
        at = np.searchsorted(b_end, a_end)
        both = b_end[at] == a_end  # a document's last tokens always
        self.last_a, self.last_b = np.flatnonzero(both), at[both]
        self.a0, self.b0 = _starts(self.last_a), _starts(self.last_b)
        self.k_a, self.k_b = self.last_a - self.a0 + 1, self.last_b - self.b0 + 1
        upto = np.searchsorted(self.last_a, np.cumsum(self.n_a) - 1) + 1
        self.n_groups = np.diff(upto, prepend=0)
        self.doc = np.repeat(np.arange(len(coded)), self.n_groups)
        self.n_links = np.add.reduceat(self.k_a * self.k_b, upto - self.n_groups)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times) of the distinct links, by document."""
        space, size, found = self.tok.n_a * self.tok.n_b, self.k_a * self.k_b, []
        few = np.flatnonzero(size <= MAX_LINKS)
        total = np.cumsum(size[few])
        for g in np.split(few, np.searchsorted(total, np.arange(MAX_LINKS, total[-1] if len(few) else 0, MAX_LINKS))):
            if not len(g):
                continue
            n, of = size[g], np.repeat(np.arange(len(g)), size[g])
            off = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            i, j = np.divmod(off, self.k_b[g][of])
            pair = self.a[self.a0[g][of] + i] * self.tok.n_b + self.b[self.b0[g][of] + j]
            found.append(np.unique(self.doc[g][of] * space + pair, return_counts=True))
        for g in np.flatnonzero(size > MAX_LINKS):
            a, ka = np.unique(self.a[self.a0[g]:self.last_a[g] + 1], return_counts=True)
            b, kb = np.unique(self.b[self.b0[g]:self.last_b[g] + 1], return_counts=True)
            step = max(1, MAX_LINKS // len(b))
            for s in range(0, len(a), step):
                pair = (a[s:s + step, None] * self.tok.n_b + b[None, :]).ravel()
                found.append((self.doc[g] * space + pair, (ka[s:s + step, None] * kb[None, :]).ravel()))
        key, times = found[0] if len(found) == 1 else _summed(found)
        doc = key // space
        return doc, key - doc * space, times

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups as text."""
        g_a, g_b = np.repeat(np.arange(len(self.a0)), self.k_a), np.repeat(np.arange(len(self.b0)), self.k_b)
        out = np.empty(len(self.a) + len(self.b), np.int64)
        what_a, what_b = self.a * 2, (self.tok.n_a + self.b) * 2
        what_a[self.last_a] += 1
        what_b[self.last_b] += 1
        out[np.arange(len(self.a)) + self.b0[g_a]] = what_a
        out[np.arange(len(self.b)) + self.last_a[g_b] + 1] = what_b
        words = self.tok.written[out].view(np.uint8).reshape(-1, 8)
        used = words != 0
        raw = words[used].tobytes()
        ends = np.cumsum(used.sum(axis=1))[np.cumsum(self.n_a + self.n_b) - 1].tolist()
        return [hashlib.sha256(raw[s:e - 1]).hexdigest() for s, e in zip([0, *ends], ends)]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts, with the sums of their numbers."""
    key, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    return key[first], np.add.reduceat(n, first)


def _tokenizers(files) -> Tokenizers:
    a, b = files.value
    key = hash((a, b))
    if key not in _LOADED:
        _LOADED[key] = Tokenizers(a, b)
    return _LOADED[key]


def _send_files(spark: SparkSession, vocabulary_a: str, vocabulary_b: str):
    """The two vocabulary files (a few megabytes), read by the driver."""
    files = []
    for path in (vocabulary_a, vocabulary_b):
        with open(path, "rb") as f:
            files.append(f.read())
    if sum(map(len, files)) > 64 << 20:
        raise ValueError("vocabulary files over 64 MB: too large to broadcast")
    return spark.sparkContext.broadcast(tuple(files))


def encoded(docs: DataFrame, files) -> DataFrame:
    """doc_id and the ids of both tokenizers (null: no tokens)."""
    schema = pa.schema([("doc_id", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        tok = _tokenizers(files)
        for batch in batches:
            found = [tok.encode(t.as_py()) or (None, None) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in zip(*found))], schema=schema)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, a binary, b binary")


def _runs(tok: Tokenizers, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[int], Aligned | None]]:
    """(ids, places of the documents with tokens, their alignment), some hundred
    thousand tokens at a time."""
    for batch in batches:
        ids, coded, size = [], [], 0
        for doc_id, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            ids.append(doc_id)
            coded.append((a.as_py(), b.as_py()) if a.is_valid else None)
            size += len(coded[-1][0]) if coded[-1] else 0
            if size >= BATCH_BYTES:
                yield _run(tok, ids, coded)
                ids, coded, size = [], [], 0
        if ids:
            yield _run(tok, ids, coded)


def _run(tok, ids, coded):
    having = [i for i, c in enumerate(coded) if c]
    return ids, having, Aligned(tok, [coded[i] for i in having]) if having else None


# --- first pass, hash, counts ------------------------------------------------------

def shard_of(pair, shards: int):
    """Shard of a pair; the same numbers for a Column as for numpy."""
    return pair % 4294967291 * 1640531527 % 4294967291 % shards


def pair_counts(coded: DataFrame, files) -> DataFrame:
    """(task, pair, n): how many of a task's documents hold a pair, a few rows for
    a pair where a task has too many pairs to hold."""
    schema = pa.schema([("task", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])

    def run(batches):
        from pyspark import TaskContext
        task, tok = TaskContext.get().partitionId(), _tokenizers(files)
        kept, fresh = None, []

        def out(pairs, n):
            for s in range(0, len(pairs), 1 << 16):
                p = pairs[s:s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), task, np.int32)), pa.array(p), pa.array(n[s:s + (1 << 16)])], schema=schema)

        def combined():
            return _summed(([kept] if kept else []) + [np.unique(np.concatenate(fresh), return_counts=True)])
        for _, _, aligned in _runs(tok, batches):
            if aligned is None:
                continue
            fresh.append(aligned.links()[1])
            if sum(map(len, fresh)) > FLUSH_PAIRS:
                kept, fresh = combined(), []
                if len(kept[0]) > FLUSH_PAIRS:
                    yield from out(*kept)
                    kept = None
        if fresh:
            kept = combined()
        if kept:
            yield from out(*kept)
    return coded.mapInArrow(run, "task int, pair long, n long")


_PARTS = "shard int, sizes binary, bits binary, keys binary"


def hashes(pairs: DataFrame, shards: int) -> DataFrame:
    """Minimal perfect hash of each shard of the distinct ``pairs``."""
    schema = pa.schema([("shard", pa.int32()), ("sizes", pa.binary()), ("bits", pa.binary()), ("keys", pa.binary())])

    def run(batches):
        for shard, keys in _grouped(batches, 1):
            made = perfect_hash.build(np.concatenate([k["pair"] for k in keys]))
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard[0], *(m.tobytes() for m in made)), schema)], schema=schema)
    dealt = pairs.select(shard_of(F.col("pair"), shards).cast("int").alias("shard"), "pair")
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, _PARTS)


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Groups of a stream sorted by its first ``n_keys`` integer columns, each as
    an iterator of its pieces (arrays by column name)."""
    def pieces():
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            arrays = {c: v.to_numpy(zero_copy_only=False) if pa.types.is_integer(v.type) and not v.null_count else v for c, v in cols.items()}
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                yield tuple(int(k) for k in keys[:, s]), {c: v[s:e] if isinstance(v, np.ndarray) else v.slice(s, e - s) for c, v in arrays.items()}
    stream = pieces()
    held = next(stream, None)
    while held:
        key = held[0]

        def group():
            nonlocal held
            while held and held[0] == key:
                piece = held[1]
                held = next(stream, None)
                yield piece
        own = group()
        yield key, own
        for _ in own:  # what the reader left
            pass


_VECTOR = pa.schema([("shard", pa.int32()), ("slice", pa.int32()), ("counts", pa.binary())])


def _vector(key, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, counts.tobytes()), _VECTOR)], schema=_VECTOR)


def dense_counts(rows: DataFrame, parts: DataFrame, shards: int, tasks: int) -> DataFrame:
    """(shard, counts): documents of each pair, in hash order; a tree of sums."""
    def first(batches):
        for key, pieces in _grouped(batches, 2):
            head = next(pieces)  # kind 0 comes first
            table = perfect_hash.Table([tuple(np.frombuffer(head[c][0].as_py(), t) for c, t in (("sizes", np.int64), ("bits", np.uint8), ("keys", np.int64)))])
            counts = np.zeros(len(table.keys), np.int64)
            start = 1
            while head is not None:
                pair, n = (np.asarray(head[c].slice(start) if isinstance(head[c], pa.Array) else head[c][start:], dtype=np.int64) for c in ("pair", "n"))
                at = table.number(pair, np.zeros(len(pair), np.int64))
                if (at < 0).any():
                    raise RuntimeError("a counted pair is not among the hashed pairs")
                counts += np.bincount(at, weights=None, minlength=len(counts)) if (n == 1).all() else _added(at, n, len(counts))
                head, start = next(pieces, None), 0
            yield _vector(key, counts)

    def more(batches):
        for key, pieces in _grouped(batches, 2):
            total = 0
            for piece in pieces:
                for v in piece["counts"]:
                    total = total + np.frombuffer(v.as_py(), np.int64)
            yield _vector(key, total)
    slices = -(-tasks // FAN)
    counted = rows.select(shard_of(F.col("pair"), shards).cast("int").alias("shard"), F.floor(F.col("task") / FAN).cast("int").alias("slice"),
                          F.lit(1).alias("kind"), "pair", "n")
    heads = parts.select("shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, slices - 1)))).alias("slice"), F.lit(0).alias("kind"), "sizes", "bits", "keys")
    returns = "shard int, slice int, counts binary"
    sums = (heads.unionByName(counted, allowMissingColumns=True).repartition("shard", "slice")
            .sortWithinPartitions("shard", "slice", "kind").mapInArrow(first, returns))
    while slices > 1:
        slices = -(-slices // FAN)
        sums = (sums.withColumn("slice", F.floor(F.col("slice") / FAN).cast("int")).repartition("shard", "slice")
                .sortWithinPartitions("shard", "slice").mapInArrow(more, returns))
    return sums.drop("slice")


def _added(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, at, n)
    return out


def best_counts(table: DataFrame, n_a: int, n_b: int) -> np.ndarray:
    """The highest count of each id of A (zero: no link); as many numbers as the
    vocabulary has ids."""
    schema = pa.schema([("a", pa.int64()), ("best", pa.int64())])

    def run(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1)):
                a, n = np.frombuffer(keys.as_py(), np.int64) // n_b, np.frombuffer(counts.as_py(), np.int64)
                most = np.zeros(n_a, np.int64)
                np.maximum.at(most, a, n)
                held = np.flatnonzero(most)
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(most[held])], schema=schema)
    best = np.zeros(n_a, np.int64)
    for r in table.select("keys", "counts").mapInArrow(run, "a long, best long").groupBy("a").agg(F.max("best").alias("best")).collect():
        best[r["a"]] = r["best"]
    return best


# --- second pass ---------------------------------------------------------------------

_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _look_up(coded: DataFrame, files, slab, best, shards: int) -> DataFrame:
    """A row per document with the sums over the links of one slab of shards."""
    kinds = [pa.int64()] * 7 + [pa.string()]
    schema = pa.schema(list(zip([c.split()[0] for c in _RESULT.split(", ")], kinds)))

    def run(batches):
        tok = _tokenizers(files)
        first, parts, counts = slab.value
        table, most = perfect_hash.Table([tuple(np.frombuffer(x, t) for x, t in zip(p, (np.int64, np.uint8, np.int64))) for p in parts]), best.value
        count = np.frombuffer(counts, np.int64)
        for ids, having, al in _runs(tok, batches):
            cols = np.zeros((6, len(ids)), np.int64)
            sha = [""] * len(ids)
            if al is not None:
                doc, pair, times = al.links()
                shard = shard_of(pair, shards) - first
                here = (shard >= 0) & (shard < len(parts))
                if not here.all():
                    doc, pair, times, shard = doc[here], pair[here], times[here], shard[here]
                at = table.number(pair, shard)
                if (at < 0).any():
                    raise RuntimeError("a linked pair is not among the hashed pairs")
                n = count[at]
                top = np.where(n == most[pair // tok.n_b], times, 0)
                sums = np.zeros((2, len(having)), np.int64)
                if len(doc):
                    at = np.flatnonzero(np.diff(doc, prepend=-1))
                    sums[:, doc[at]] = np.add.reduceat(top, at), np.add.reduceat(times * n, at)
                cols[:, having] = np.stack([al.n_a, al.n_b, al.n_groups, al.n_links, *sums])
                for i, s in zip(having, al.digests()):
                    sha[i] = s
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c) for c in cols], pa.array(sha)], schema=schema)
    return coded.mapInArrow(run, _RESULT)


def align(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the
    highest count of its A id), count_sum (over links) and groups_sha256."""
    spark = docs.sparkSession
    bounded_batches(spark)
    files = _send_files(spark, vocabulary_a, vocabulary_b)
    tok = _tokenizers(files)
    coded = shared_table(encoded(docs, files), compression="zstd")
    rows = shared_table(pair_counts(coded, files))
    pairs = shared_table(rows.select("pair").distinct())
    facts = rows.agg(F.max("task")).first()[0], pairs.count()
    shards, tasks = max(1, -(-facts[1] // SHARD_KEYS)), (facts[0] or 0) + 1
    parts = shared_table(hashes(pairs, shards))
    table = shared_table(parts.join(dense_counts(rows, parts, shards, tasks), "shard"))
    best = spark.sparkContext.broadcast(best_counts(table, tok.n_a, tok.n_b))
    width = max(1, SLAB_KEYS // SHARD_KEYS)
    results = []
    for first in range(0, shards, width):
        got = {r["shard"]: r for r in table.where((F.col("shard") >= first) & (F.col("shard") < first + width)).collect()}
        none = {"sizes": b"", "bits": b"", "keys": b"", "counts": b""}  # a shard that no pair hashes to
        slab = [got.get(s, none) for s in range(first, min(first + width, shards))]
        sent = spark.sparkContext.broadcast((first, [tuple(r[c] for c in ("sizes", "bits", "keys")) for r in slab], b"".join(r["counts"] for r in slab)))
        results.append(_look_up(coded, files, sent, best, shards))
    if len(results) == 1:
        return results[0]
    # equal documents have equal sums, so they are added up together and dealt out again
    whole = results[0]
    for r in results[1:]:
        whole = whole.unionByName(r)
    same = [c for c in whole.columns if c not in ("n_best", "count_sum")]
    k = F.count(F.lit(1)) / len(results)
    whole = whole.groupBy(*same).agg(k.cast("long").alias("k"), *[(F.sum(c) / k).cast("long").alias(c) for c in ("n_best", "count_sum")])
    return whole.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "k"))).select(*results[0].columns)
