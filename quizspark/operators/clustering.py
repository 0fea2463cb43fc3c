"""Question categories by semantic clustering (re-aimed for Spark).

The reference embeds distinct prompts with a sentence encoder, reduces them
with UMAP and clusters with HDBSCAN inside a Bayesian search. Those are
single-machine libraries; here the same user-level steps are Spark jobs:

* embed: MLlib tokenizer + HashingTF + IDF + L2 normaliser (or a stored
  embedding column, or a user encoder through ``mapInPandas``);
* reduce: L2 normalise + MLlib PCA (components are nested, so one fit with
  the largest ``k`` serves every smaller ``k``), or coordinates of the
  neighbour graph (``operators.spectral``);
* neighbours: exact k-nearest-neighbour graph by hash blocks — a cogroup of
  (query block, candidate block) pairs computes distances with numpy inside
  each task and emits only the k best per row (never all pairs) — or, for
  large tables, from cells and neighbours of neighbours
  (``operators.neighbours``);
* density clusters: core distance = distance to the k-th neighbour, mutual
  reachability max(core_a, core_b, d) on the kNN edges, condensed hierarchy and
  clusters chosen from it (``operators.hierarchy``), or one flat cut;
* membership: lambda in the cluster / greatest lambda (flat cut: min core
  distance in the cluster / own core distance);
* search: rounds of trials, each evaluated in the same distributed pass (the
  trial id is part of the key), drawn where earlier losses were low.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark import StorageLevel
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizspark.operators.hierarchy import FOREST, MAX_EDGES, PART_EDGES, forest_table, hierarchical_clusters, least_forest, whole_tree
from quizspark.operators.neighbours import GRAPH_ROWS, approximate_knn, descent_lists, distances, nearest, nested_lists
from quizspark.operators.position import global_position, join_small
from quizspark.operators.search import minimise
from quizspark.session import UNION_TASKS, checkpoint_dir, saved, settings


# --- embeddings ------------------------------------------------------------

def embed_prompts(df: DataFrame, text_col: str = "prompt", out_col: str = "embedding",
                  num_features: int = 1 << 9, encoder=None, batch_size: int = 32) -> DataFrame:
    """Vector per row. Default: TF-IDF (word tokens hashed to 512 features)
    L2-normalised; the dimension stays small because PCA decomposes a d x d
    covariance on the driver.
    ``encoder(list[str]) -> np.ndarray`` plugs a user model in through
    ``mapInPandas`` in batches of ``batch_size`` texts."""
    if encoder is not None:
        schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

        def run(batches):
            for pdf in batches:
                out = []
                texts = pdf[text_col].fillna("").tolist()
                for i in range(0, len(texts), batch_size):
                    out.extend(np.asarray(encoder(texts[i:i + batch_size]), dtype=np.float32).tolist())
                pdf[out_col] = out
                yield pdf
        return df.mapInPandas(run, schema).withColumn(out_col, array_to_vector(out_col))
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"(?U)\W+", minTokenLength=1)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)
    tokens = tf.transform(tok.transform(df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))))
    idf = IDF(inputCol="_tf", outputCol="_tfidf").fit(tokens)
    out = Normalizer(inputCol="_tfidf", outputCol=out_col, p=2.0).transform(idf.transform(tokens))
    return out.drop("_tok", "_tf", "_tfidf")


def vectors_from_array(df: DataFrame, col: str = "embedding", out_col: str = "features") -> DataFrame:
    return df.withColumn(out_col, array_to_vector(F.col(col)))


def reduce_dims(df: DataFrame, k: int, features_col: str = "features", out_col: str = "reduced") -> DataFrame:
    """L2-normalise (cosine geometry) and project on the top ``k`` principal
    components (MLlib PCA: one pass for the covariance, eigen-decomposition
    of a d x d matrix on the driver)."""
    unit = Normalizer(inputCol=features_col, outputCol="_unit", p=2.0).transform(df)
    model = PCA(k=k, inputCol="_unit", outputCol=out_col).fit(unit)
    return model.transform(unit).drop("_unit")


# --- exact k-nearest neighbours ---------------------------------------------

#: Blocks up to a size, bytes of a block's vectors as doubles, side of a tile of distances.
MANY_BLOCKS, BLOCK_BYTES, TILE = 16, 1 << 25, 2048


def _arrays(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): vectors as arrays of floats, if they are that, or doubles."""
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    if not isinstance(v.schema["v"].dataType, T.ArrayType):
        v = v.withColumn("v", vector_to_array("v"))
    if v.schema["v"].dataType.elementType != T.FloatType():
        v = v.withColumn("v", F.col("v").cast("array<double>"))
    return v


def knn_graph(df: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", metric: str = "cosine",
              block_size: int = 2048, prefix_dims=None) -> DataFrame:
    """Exact k nearest neighbours of every row (self excluded; ties to the
    lower id): (id, nbr, dist, rank). ``vec_col`` is array<double|float> or
    an MLlib vector. Rows are hashed into B blocks, at least ``block_size`` rows
    each: at most ``MANY_BLOCKS``, until a block has ``BLOCK_BYTES``, so that
    what is shuffled grows as the rows do. Each unordered block pair (i <= j) is
    one cogroup group holding two blocks, answering both from tiles of the
    distance matrix (each vector is shipped to B + 1 groups, as it is stored); a
    final top-k merges the B partial lists of each row (B * k candidates per row,
    a bounded group).

    ``prefix_dims`` (list of ints) computes, in the same pass, one graph per
    leading-dimension count (nested PCA coordinates) and adds a ``dims``
    column; Euclidean ones come from ``neighbours.nested_lists``."""
    if prefix_dims and metric == "euclidean":
        return _graph_rows(nested_lists(_arrays(df, id_col, vec_col), k, prefix_dims))
    v = _arrays(df, id_col, vec_col)
    n, dim = v.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    most = max(block_size, BLOCK_BYTES // (8 * max(1, dim or 1)))
    nb = max(1, -(-n // most), min(MANY_BLOCKS, -(-n // block_size)))
    v = v.withColumn("blk", (F.xxhash64("id") % nb + nb) % nb)
    # each unordered block pair (qb <= cb) once
    left = v.select("id", "v", F.col("blk").alias("qb"),
                    F.explode(F.sequence(F.col("blk"), F.lit(nb - 1))).alias("cb"))
    right = v.select("id", "v", F.col("blk").alias("cb"),
                     F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("qb"))
    prefixes = list(prefix_dims) if prefix_dims else [None]
    out_schema = "dims int, id long, nbr long, dist double"

    def rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        at = t.column("v").combine_chunks()
        values = at.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if at.null_count or len(values) % len(at):
            raise ValueError("knn_graph: vectors must be there and of one length")
        return t.column("id").to_numpy(), values.reshape(len(at), -1)

    def tile_topk(qid, q, cid, c, same) -> list:
        d = distances(q, c, metric)
        return [nearest(qid, cid, d, k, not same), *([] if same else [nearest(cid, qid, d, k, True, axis=0)])]

    def block_topk(key, q: pa.Table, c: pa.Table) -> pa.Table:
        parts = []
        if q.num_rows and c.num_rows:
            (qid, qa), (cid, ca) = rows(q), rows(c)
            same = key[0].as_py() == key[1].as_py()
            for p in prefixes:
                found = [part for i in range(0, len(qid), TILE) for j in range(0, len(cid), TILE)
                         for part in tile_topk(qid[i:i + TILE], qa[i:i + TILE, :p], cid[j:j + TILE], ca[j:j + TILE, :p], same)]
                i, nbr, d = (np.concatenate(x) for x in zip(*found))
                if len(found) > 2:  # lists of several tiles: the best of each row
                    order = np.lexsort((nbr, d, i))
                    i = i[order]
                    first = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, nbr, d = i[first], nbr[order][first], d[order][first]
                parts.append((np.full(len(i), -1 if p is None else p, np.int32), i, nbr, d))
        cols = [np.concatenate(x) for x in zip(*parts)] or [[]] * 4
        return pa.table({"dims": pa.array(cols[0], pa.int32()), "id": pa.array(cols[1], pa.int64()),
                         "nbr": pa.array(cols[2], pa.int64()), "dist": pa.array(cols[3], pa.float64())})

    partial = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(block_topk, out_schema)
    best = partial.groupBy("dims", "id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("dist", "nbr"))), 1, k).alias("b"))
    out = best.select("dims", "id", F.posexplode("b").alias("rank", "e")).select(
        "dims", "id", F.col("e.nbr").alias("nbr"), F.col("e.dist").alias("dist"), (F.col("rank") + 1).alias("rank"))
    return out if prefix_dims else out.drop("dims")


def neighbour_graph(df: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", metric: str = "cosine", prefix_dims=None,
                    exact_rows: int = 20_000, as_lists: bool = False) -> DataFrame:
    """kNN graph like :func:`knn_graph`: exact up to ``exact_rows`` rows, beyond
    that from cells and neighbours of neighbours (``operators.neighbours``), whose
    work is near linear. For nested graphs that is ``exact_rows`` for each of them:
    the exact way makes them all in one pass, the other has rounds for every one, in
    one task for each up to ``GRAPH_ROWS`` rows. With ``as_lists`` a row has all
    neighbours of an id (dims, id, nbrs, dists), nearest first."""
    nested, n = bool(prefix_dims) and metric == "euclidean", df.count()
    if n <= exact_rows * (len(prefix_dims) if nested else 1):
        if nested and as_lists:
            return nested_lists(_arrays(df, id_col, vec_col), k, prefix_dims)
        graph = knn_graph(df, k, id_col, vec_col, metric, prefix_dims=prefix_dims)
    elif nested and n <= GRAPH_ROWS:
        lists = descent_lists(_arrays(df, id_col, vec_col), k, prefix_dims)
        return lists if as_lists else _graph_rows(lists)
    else:
        graph = approximate_knn(df, k, id_col, vec_col, metric, prefix_dims=prefix_dims)
    return neighbour_lists(graph, ["dims"] if prefix_dims else []) if as_lists else graph


def _graph_rows(lists: DataFrame) -> DataFrame:
    """(dims, id, nbr, dist, rank) of neighbour lists."""
    return lists.select("dims", "id", F.posexplode(F.arrays_zip("nbrs", "dists")).alias("rank", "e")).select(
        "dims", "id", F.col("e.nbrs").alias("nbr"), F.col("e.dists").alias("dist"), (F.col("rank") + 1).alias("rank"))


# --- density clusters --------------------------------------------------------

def connected_components(edges: DataFrame, vertices: DataFrame, key_cols=(), max_iter: int = 100,
                         checkpoint_every: int = 3) -> DataFrame:
    """Min-label connected components of an undirected edge list
    (src, dst [+ key_cols]) over ``vertices`` (id [+ key_cols]).

    Each round propagates the smaller label over every edge (a join and a
    partial aggregate), then pointer-jumps (label := label of label), which
    shortens long chains. Labels only decrease, so the round changed nothing
    exactly when the sum of labels is unchanged: convergence is one scalar
    aggregate, no join with the previous round. Lineage is cut with a
    reliable checkpoint (spark.checkpoint.dir)."""
    checkpoint_dir(edges.sparkSession)
    keys = list(key_cols)
    und = edges.select(*keys, "src", "dst").unionByName(
        edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().checkpoint(eager=True)
    labels = vertices.select(*keys, "id", F.col("id").alias("label")).distinct().checkpoint(eager=True)
    total, cached = None, None
    for it in range(max_iter):
        lab_src = labels.select(*keys, F.col("id").alias("src"), F.col("label").alias("l_src"))
        cand = und.join(lab_src, keys + ["src"]).select(*keys, F.col("dst").alias("id"), F.col("l_src").alias("label"))
        new = labels.unionByName(cand).groupBy(*keys, "id").agg(F.min("label").alias("label"))
        parent = new.select(*keys, F.col("id").alias("label"), F.col("label").alias("p_label"))
        jump = new.join(parent, keys + ["label"], "left").select(
            *keys, "id", F.least(F.col("label"), F.coalesce(F.col("p_label"), F.col("label"))).alias("label"))
        # the convergence sum materialises the persisted round; every
        # ``checkpoint_every`` rounds the lineage is cut on reliable storage
        jump = jump.persist(StorageLevel.MEMORY_AND_DISK)
        new_total = jump.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if (it + 1) % checkpoint_every == 0:
            jump = jump.checkpoint(eager=True)
        if cached is not None:
            cached.unpersist()
        cached = jump
        labels = jump
        if total is not None and new_total == total:
            break
        total = new_total
    else:
        raise RuntimeError(f"connected_components: labels still change after {max_iter} rounds; give a larger max_iter")
    return labels


def _mutual_reachability(knn: DataFrame, keys: list, k_core, n_edges) -> tuple[DataFrame, DataFrame]:
    """(edges with mutual reachability ``mr``, vertices with ``core``)."""
    core = knn.where(F.col("rank") == k_core).select(*keys, "id", F.col("dist").alias("core"))
    verts = knn.select(*keys, "id").distinct().join(core, keys + ["id"], "left") \
        .withColumn("core", F.coalesce("core", F.lit(float("inf"))))
    e = knn.where(F.col("rank") <= n_edges).select(*keys, F.col("id").alias("src"), F.col("nbr").alias("dst"), "dist")
    e = e.join(verts.select(*keys, F.col("id").alias("src"), F.col("core").alias("cs")), keys + ["src"]) \
        .join(verts.select(*keys, F.col("id").alias("dst"), F.col("core").alias("cd")), keys + ["dst"]) \
        .withColumn("mr", F.greatest("dist", "cs", "cd"))
    return e, verts


def _flat_cut(e: DataFrame, verts: DataFrame, eps: float, min_size: int) -> DataFrame:
    """Keep edges and vertices within eps, label components, mark small
    components as noise, number clusters 0.. by smallest member id."""
    kept = e.where(F.col("mr") <= F.lit(eps))
    v_ok = verts.where(F.col("core") <= F.lit(eps))
    comps = connected_components(kept.select("src", "dst"), v_ok.select("id"))
    sizes = comps.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    lab = comps.join(sizes, "label").select("id", F.col("label").alias("cluster_raw"))
    out = verts.join(lab, "id", "left")
    # one row per cluster: a small table
    firsts = out.where(F.col("cluster_raw").isNotNull()).groupBy("cluster_raw").agg(
        F.min("id").alias("_first"), F.min("core").alias("_mincore"))
    firsts = global_position(firsts, ["_first"], "_gpos").select("cluster_raw", F.col("_gpos").cast("int").alias("cluster"), "_mincore")
    # noise has no key: broadcast where small, else split by the skew join
    out = join_small(out, firsts, ["cluster_raw"], "left")
    prob = F.when(F.col("cluster").isNotNull(), F.coalesce(F.try_divide("_mincore", "core"), F.lit(1.0))).otherwise(F.lit(0.0))
    return out.select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), prob.alias("probability"))


def density_clusters(knn: DataFrame, min_samples: int = 5, min_cluster_size: int = 25, eps: float | None = None,
                     eps_quantile: float | None = None, allow_single: bool = False, max_edges: int = MAX_EDGES) -> DataFrame:
    """Cluster label (-1 = noise) and membership probability per id from a
    kNN graph (id, nbr, dist, rank): the clusters that last longest in the
    hierarchy of mutual reachability (``operators.hierarchy``), which may have
    different densities. With ``eps``, or ``eps_quantile`` of the core distances,
    one flat cut instead. An empty graph gives an empty result."""
    checkpoint_dir(knn.sparkSession)
    knn = knn.checkpoint(eager=True)  # read by three branches below
    e, verts = _mutual_reachability(knn, [], min_samples, min_samples)
    if eps is None and eps_quantile is None:
        return hierarchical_clusters(e, verts, int(min_cluster_size), allow_single=allow_single, max_edges=max_edges)
    if eps is None:
        eps = verts.where(F.col("core") < float("inf")).select(F.percentile_approx("core", float(eps_quantile))).first()[0] or 0.0
    return _flat_cut(e, verts, float(eps), int(min_cluster_size))


# --- scoring of a clustering -------------------------------------------------

def cluster_score(clusters: DataFrame, prob_threshold: float = 0.05, key_cols=(),
                  count_noise: bool = True) -> DataFrame:
    """label_count (distinct labels; noise -1 counted like the reference
    unless ``count_noise`` is False) and cost = share of rows with
    membership probability below the threshold."""
    lbl = F.col("cluster") if count_noise else F.when(F.col("cluster") != -1, F.col("cluster"))
    return clusters.groupBy(*key_cols).agg(
        F.count_distinct(lbl).alias("label_count"),
        F.try_divide(F.count(F.when(F.col("probability") < prob_threshold, 1)), F.count(F.lit(1))).alias("cost"))


def cluster_objective(scores: DataFrame, label_lower: int = 6, label_upper: int = 20,
                      penalty: float = 0.20) -> DataFrame:
    """loss = cost + penalty when the label count is outside [lower, upper]
    (the reference's comment says 15 %, its code adds 0.20)."""
    out = (F.col("label_count") < label_lower) | (F.col("label_count") > label_upper)
    return scores.withColumn("loss", F.col("cost") + F.when(out, F.lit(penalty)).otherwise(F.lit(0.0)))


# --- parameter search ----------------------------------------------------------

# The reference's search ranges (inclusive lower, exclusive upper).
N_NEIGHBORS = range(5, 20)
N_COMPONENTS = range(3, 15)
MIN_CLUSTER_SIZE = range(25, 35)


SPACES = (N_NEIGHBORS, N_COMPONENTS, MIN_CLUSTER_SIZE)


def neighbour_lists(graph: DataFrame, keys: list) -> DataFrame:
    """(keys, id, nbrs array<long>, dists array<double>) of a kNN graph, nearest first."""
    lists = graph.groupBy(*keys, "id").agg(F.sort_array(F.collect_list(F.struct("rank", "nbr", "dist"))).alias("b"))
    return lists.select(*keys, "id", F.col("b.nbr").alias("nbrs"), F.col("b.dist").alias("dists"))


def _trial_forests(trial_lists: DataFrame, parts: int) -> DataFrame:
    """(trial, src, dst, mr, longest): the least spanning forests of mutual
    reachability of each trial's graph, from its neighbour lists (trial,
    n_neighbors, id, nbrs, dists). An edge goes, with the core distance of its one
    end, to the part of its other end, which has that end's core distance."""
    dealt = F.pmod(F.xxhash64("dst"), F.lit(parts)).cast("int")
    core = F.coalesce(F.get("dists", F.col("n_neighbors") - 1), F.lit(float("inf")))
    e = trial_lists.select("trial", core.alias("core"), F.col("id").alias("src"), F.explode(F.slice(F.arrays_zip("nbrs", "dists"), 1, F.col("n_neighbors"))).alias("e"))
    e = e.select("trial", "src", F.col("e.nbrs").alias("dst"), F.greatest("e.dists", "core").alias("mr")).withColumn("part", dealt)
    cores = trial_lists.select(F.col("trial").alias("of_trial"), F.col("id").alias("dst"), core.alias("core")).withColumn("of_part", dealt)

    def run(key, e: pa.Table, c: pa.Table) -> pa.Table:
        src, dst, mr = (e[x].to_numpy() for x in ("src", "dst", "mr"))
        order = np.argsort(c["dst"].to_numpy())
        ids, core = c["dst"].to_numpy()[order], c["core"].to_numpy()[order]
        at = np.searchsorted(ids, dst)
        known = np.append(ids, -1)[at] == dst  # a neighbour without a list has no core distance
        known &= at < len(ids)
        src, dst, mr = src[known], dst[known], np.maximum(mr[known], core[at[known]])
        return forest_table({"trial": key[0]}, src, dst, mr, mr.max(initial=0.0))
    return e.groupBy("trial", "part").cogroup(cores.groupBy("of_trial", "of_part")).applyInArrow(run, "trial int, " + FOREST)


def _whole_trial(lists: DataFrame, trial: tuple[int, ...]) -> DataFrame:
    """:func:`evaluate_trials` of one trial by one task, which reads the lists (id,
    nbrs, dists) of its component count. A list's last distance is its core distance
    and no less than its others, so an edge is as long as the greater core distance
    of its ends. Edges are read in parts, of which only the spanning forest stays."""
    number, k, _, min_size = trial
    core = F.coalesce(F.get("dists", F.lit(k - 1)), F.lit(float("inf")))
    own = lists.select("id", F.slice("nbrs", 1, k).alias("nbrs"), core.alias("core"))

    def run(batches):
        parts = [(b["id"].to_numpy(), b["core"].to_numpy(), np.diff(b["nbrs"].offsets.to_numpy()), b["nbrs"].flatten().to_numpy())
                 for b in batches if b.num_rows]
        if not parts:
            return
        ids, core, count, nbrs = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.argsort(ids)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        ids, core, ends = ids[order], core[order], np.concatenate([[0], np.cumsum(count)])
        u, v, w, longest = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), 0.0
        step = max(1, PART_EDGES // k)
        for i in range(0, len(count), step):
            src, dst = np.repeat(place[i:i + step], count[i:i + step]), nbrs[ends[i]:ends[min(i + step, len(count))]]
            at = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
            known = ids[at] == dst  # a neighbour without a list has no core distance
            src, at = src[known], at[known]
            mr = np.maximum(core[src], core[at])
            longest = max(longest, mr.max(initial=0.0))
            u, v, w = np.concatenate([u, np.minimum(src, at)]), np.concatenate([v, np.maximum(src, at)]), np.concatenate([w, mr])
            kept = least_forest(u, v, w)
            u, v, w = u[kept], v[kept], w[kept]
        del nbrs, place
        cluster, probability = whole_tree(ids, u, v, w, longest, min_size)
        for i in range(0, len(ids), step := 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids[i:i + step]), number, np.int32)), *(pa.array(x[i:i + step]) for x in (ids, cluster, probability))],
                                             ["trial", "id", "cluster", "probability"])
    return own.coalesce(1).mapInArrow(run, "trial int, id long, cluster int, probability double")


def evaluate_trials(lists: DataFrame, trials: list[tuple[int, ...]], first: int = 0) -> DataFrame:
    """(trial, id, cluster, probability) of each (n_neighbors, n_components,
    min_cluster_size) on its part of ``lists`` (n_components, id, nbrs, dists);
    the trials run side by side, numbered from ``first``, each in a task of its own
    if its forest has at most ``MAX_EDGES`` edges."""
    rows = lists.groupBy("n_components").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    numbered = [(first + i, *map(int, t)) for i, t in enumerate(trials)]
    if rows <= MAX_EDGES:
        return reduce(DataFrame.union, [_whole_trial(lists.where(F.col("n_components") == t[2]), t) for t in numbered])
    tdf = lists.sparkSession.createDataFrame(numbered, _TRIAL)
    per_trial = lists.join(F.broadcast(tdf), "n_components")  # a row per trial
    # core distance at the last neighbour of the trial's graph, which has
    # fewer neighbours than the smallest cluster
    forests = _trial_forests(per_trial, max(1, -(-rows * max(t[0] for t in trials) // PART_EDGES)))
    return hierarchical_clusters(forests.transform(saved), per_trial.select("trial", "id"), tdf.select("trial", "min_cluster_size"), ["trial"])


_TRIAL = "trial int, n_neighbors int, n_components int, min_cluster_size int"


def cluster_search(df: DataFrame, id_col: str = "id", features_col: str = "features", n_trials: int = 100,
                   seed: int = 42, label_lower: int = 6, label_upper: int = 20, penalty: float = 0.20,
                   rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Search the trials with the least loss; returns (trials with loss, best
    clustering). PCA is fitted once (k = max components) and the kNN graph is
    built once per component count with the largest neighbour count; the trials
    of a round are clustered together, keyed by trial id, and the next round is
    drawn where earlier losses were low (``operators.search``)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    # saved, as PCA passes over the vectors several times and they may come from whole texts
    vectors = df.select(F.col(id_col).alias("id"), F.col(features_col).alias("features")).transform(saved)
    red = reduce_dims(vectors, max(N_COMPONENTS), "features", "reduced").select("id", vector_to_array("reduced").alias("r")).transform(saved)
    # one pass computes the graph for every component count (nested coordinates)
    graph = neighbour_graph(red.select("id", F.col("r").alias("v")), max(N_NEIGHBORS), "id", "v", metric="euclidean",
                            prefix_dims=list(N_COMPONENTS), as_lists=True).withColumnRenamed("dims", "n_components")
    lists = saved(graph, by="n_components")
    done = []

    def evaluate(trials):
        clusters = evaluate_trials(lists, trials, len(done))
        scores = cluster_objective(cluster_score(clusters, key_cols=("trial",)), label_lower, label_upper, penalty)
        with settings(spark, UNION_TASKS):
            rows = {r["trial"]: r for r in scores.collect()}  # a row per trial
        start = len(done)
        done.extend((start + i, *map(int, t), *(rows[start + i][c] for c in ("label_count", "cost", "loss"))) for i, t in enumerate(trials))
        return [r[-1] for r in done[start:]]
    if lists.isEmpty():
        none = spark.createDataFrame([], "trial int, id long, cluster int, probability double")
        return spark.createDataFrame([], _TRIAL + ", label_count long, cost double, loss double"), none.drop("trial")
    minimise(SPACES, evaluate, n_trials, seed, rounds)
    best = min(done, key=lambda r: (r[-1], r[0]))
    # made again, so that not every trial's clustering need be kept
    clusters = evaluate_trials(lists, [best[1:4]], best[0]).transform(saved)
    return spark.createDataFrame(done, _TRIAL + ", label_count long, cost double, loss double"), clusters.drop("trial")


# --- top TF-IDF words per cluster ---------------------------------------------

TOKEN_PATTERN = r"[\pL\pN_]{2,}"  # runs of two or more word characters


def top_k_per_group(df: DataFrame, group_cols, order_cols, k: int, tie_col: str, salt_buckets: int = 64) -> DataFrame:
    """Exact top-k rows per group without one task per group: rank inside
    (group, hash(tie_col) % salt_buckets) first, keep k per bucket, then rank
    the at most k * salt_buckets survivors per group."""
    groups = list(group_cols)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(tie_col), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*groups, "_salt").orderBy(*order_cols)
    local = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(*groups).orderBy(*order_cols)
    return local.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)


#: Characters of text in a chunk of documents, whose terms are weighed together.
CHUNK_CHARS = 6_000_000


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two columns of hashes, in this order (the last step of SplitMix64)."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Chunk:
    """Terms of a chunk's texts (cluster, n, doc, tok) by number. An entry is a
    cluster's term: ``key`` and ``check`` are 80 bits of its hash, by which entries are
    ordered and chunks tell each other of them, ``docs`` and ``no_id`` say how many ids
    have it and whether a text without id does. A count (``at``, ``doc``, ``tf``) is
    how often an id has an entry."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        group = t["cluster"].combine_chunks().dictionary_encode(null_encoding="encode")
        cluster, self.names = group.indices.to_numpy().astype(np.int64), group.dictionary
        ids = t["doc"].combine_chunks().dictionary_encode(null_encoding="encode")
        doc, self.size = ids.indices.to_numpy().astype(np.int64), max(1, len(ids.dictionary))
        no_id = ids.dictionary.is_null().to_numpy(zero_copy_only=False)
        self.n = np.zeros(len(self.names))
        self.n[cluster] = t["n"].to_numpy()
        tok = t["tok"].combine_chunks()
        row = np.repeat(np.arange(t.num_rows), np.diff(tok.offsets.to_numpy()))
        word = tok.flatten().dictionary_encode()
        code, self.words = word.indices.to_numpy().astype(np.int64), word.dictionary
        v = self.v = max(1, len(self.words))
        pair = row[1:] == row[:-1]
        term = np.concatenate([code, v + (code[:-1] * v + code[1:])[pair]])
        row = np.concatenate([row, row[1:][pair]])
        self.terms, term = np.unique(term, return_inverse=True)
        m = max(1, len(self.terms))
        entries, at = np.unique(cluster[row] * m + term, return_inverse=True)
        self.cluster, self.term = np.divmod(entries, m)
        counts = np.sort(at * self.size + doc[row])
        first = np.flatnonzero(np.append(True, counts[1:] != counts[:-1])[:len(counts)])
        self.tf = np.diff(first, append=len(counts))
        self.at, self.doc = np.divmod(counts[first], self.size)
        known = ~no_id[self.doc] if len(no_id) else np.zeros(0, bool)
        self.no_id = np.zeros(len(entries), np.uint8)
        self.no_id[self.at[~known]] = 1
        self.at, self.doc, self.tf = self.at[known], self.doc[known], self.tf[known]  # a null id names no document
        self.docs = np.bincount(self.at, minlength=len(entries)).astype(np.uint32)
        keys = [self._hashed(k) for k in ("quizspark-terms-", "terms-quizspark-")]
        self.order = np.argsort(keys[0], kind="stable")
        self.key, self.check = keys[0][self.order], (keys[1][self.order] & np.uint64(0xFFFF)).astype(np.uint16)

    def _hashed(self, key: str) -> np.ndarray:
        def of(values) -> np.ndarray:
            return hash_array(np.array(values, object), hash_key=key, categorize=False) if len(values) else np.empty(0, np.uint64)
        word, name = of(self.words.to_pylist()), of([repr(x) for x in self.names.to_pylist()])
        first, second = np.divmod(np.maximum(self.terms - self.v, 0), self.v)
        two = self.terms >= self.v
        one = _mixed(word[np.where(two, first, self.terms)], np.uint64(1) + two) if len(word) else word
        term = np.where(two, _mixed(one, word[second]), one) if len(word) else word
        return _mixed(name[self.cluster], term[self.term])

    def texts(self, entries: np.ndarray) -> list[str]:
        term = self.terms[self.term[entries]]
        first, second = np.divmod(np.maximum(term - self.v, 0), self.v)
        return [self.words[int(t)].as_py() if t < self.v else f"{self.words[int(a)].as_py()} {self.words[int(b)].as_py()}" for t, a, b in zip(term, first, second)]


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the highest first, so that those alike lie together when they are compressed."""
    return np.ascontiguousarray(x[:, None].view(np.uint8)[:, ::-1].T).tobytes()


def _numbers(b: bytes, kind) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(wide, -1)[::-1].T).view(kind).ravel()


def _bucket_starts(key: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2^bits ranges of the ascending keys starts, and the end."""
    ends = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(key, ends), [len(key)]])


_TOLD = "chunk int, bucket int, keys binary, checks binary, docs binary, no_id binary"


def _tell(chunk: int, t: pa.Table, bits: int) -> pa.Table:
    """A chunk's entries, by ranges of their keys."""
    c = _Chunk(t)
    at, parts = _bucket_starts(c.key, bits), []
    for i in np.flatnonzero(np.diff(at)):
        own = slice(at[i], at[i + 1])
        parts.append((chunk, int(i), *map(_planes, (c.key[own], c.check[own], c.docs[c.order[own]], c.no_id[c.order[own]]))))
    return pa.table([pa.array(x, k) for x, k in zip(zip(*parts) if parts else [[]] * 6, [pa.int32()] * 2 + [pa.binary()] * 4)], names=[x.split()[0] for x in _TOLD.split(", ")])


def _reply(t: pa.Table) -> pa.Table:
    """To each chunk of a range of keys: which of its entries other chunks have too (as bits), and their document frequency."""
    sizes = [len(x) // 8 for x in t["keys"].to_pylist()]
    key, check, docs, no_id = (np.concatenate([_numbers(x, kind) for x in t[c].to_pylist()]) for c, kind in
                               (("keys", np.uint64), ("checks", np.uint16), ("docs", np.uint32), ("no_id", np.uint8)))
    order = np.lexsort((check, key))
    first = np.flatnonzero(np.append(True, (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])))
    chunks = np.diff(first, append=len(order))
    df = np.add.reduceat(docs[order].astype(np.int64), first) + np.maximum.reduceat(no_id[order], first)
    shared, all_df = np.empty(len(order), bool), np.empty(len(order), np.uint32)
    shared[order], all_df[order] = np.repeat(chunks > 1, chunks), np.repeat(df, chunks)
    ends = np.cumsum(sizes)
    parts = [(chunk, bucket, np.packbits(shared[e - n:e]).tobytes(), _planes(all_df[e - n:e][shared[e - n:e]]))
             for chunk, bucket, n, e in zip(t["chunk"].to_pylist(), t["bucket"].to_pylist(), sizes, ends) if shared[e - n:e].any()]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*parts) if parts else [[]] * 4, [pa.int32()] * 2 + [pa.binary()] * 2)], names=["to_chunk", "bucket", "shared", "df"])


def _chunk_scores(t: pa.Table, replies: pa.Table, bits: int, n_top: int, slack: float, least: dict | None) -> pa.Table:
    """Summed weights (cluster, term, score, least) of a chunk's entries. A term of df
    documents scores df at most, so those below ``least`` of their cluster are left
    out: given, or half of what the chunk's ``n_top``-th best lets expect of all chunks.
    Of the entries found here only, those that may be among the ``n_top`` best are returned."""
    c = _Chunk(t)
    df, shared = (c.docs + c.no_id).astype(np.float64), np.zeros(len(c.docs), bool)
    start = _bucket_starts(c.key, bits)
    for bucket, mask, dfs in zip(*(replies[x].to_pylist() for x in ("bucket", "shared", "df"))):
        entries = c.order[start[bucket]:start[bucket + 1]]
        entries = entries[np.unpackbits(np.frombuffer(mask, np.uint8), count=len(entries)).astype(bool)]
        shared[entries], df[entries] = True, _numbers(dfs, np.uint32)
    w = c.tf * (np.log((c.n[c.cluster] + 1) / (df + 1)) + 1)[c.at]
    norm = np.sqrt(np.bincount(c.doc, w * w, minlength=c.size))
    score = np.bincount(c.at, w / norm[c.doc], minlength=len(df))
    own_docs = np.bincount(np.unique(c.cluster[c.at] * c.size + c.doc) // c.size, minlength=len(c.names))
    kept, bound = score > 0, np.zeros(len(c.names))
    for k, name in enumerate(c.names.to_pylist()):
        mine = np.flatnonzero((c.cluster == k) & kept)
        if least is not None:
            bound[k] = least.get(name, 0.0)
        elif len(mine) >= n_top and own_docs[k]:
            bound[k] = 0.5 * np.partition(score[mine], -n_top)[-n_top] * c.n[k] / own_docs[k]
        kept[mine[df[mine] < bound[k] - slack]] = False
        alone = mine[kept[mine] & ~shared[mine]]
        if len(alone) > n_top:
            kept[alone[score[alone] < np.partition(score[alone], -n_top)[-n_top] - slack]] = False
    own = np.flatnonzero(kept)
    return pa.table({"cluster": c.names.take(pa.array(c.cluster[own])), "term": pa.array(c.texts(own), pa.string()),
                     "score": pa.array(score[own], pa.float64()), "least": pa.array(bound[c.cluster[own]], pa.float64())})


def cluster_top_words(df: DataFrame, text_col: str = "prompt", cluster_col: str = "cluster", doc_col: str = "id",
                      n_top: int = 10, stop_words=None, digits: int | None = 9, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Top ``n_top`` unigrams + bigrams of each cluster by summed TF-IDF:
    lower-cased tokens of 2+ word characters, English stop words removed
    (Spark's default list) before bigrams are formed, IDF fitted inside the
    cluster (smooth: ln((1+n)/(1+df)) + 1), each text's TF-IDF row
    L2-normalised, scores summed over the cluster's texts. Clusters with at
    most one text get no rows. Ties: lower term first (after rounding the
    score to ``digits``).

    Documents are dealt by id into chunks of about ``chunk_chars`` characters.
    A text moves once, to its chunk, and its term counts stay there. A chunk tells
    the document frequency of each of its different terms by 80 bits of their hash
    (among 10^9 terms two are alike with a chance below 10^-6); it is told that of the
    terms which other chunks have too, and returns its part of the scores of those
    that are frequent enough to be among the best."""
    from pyspark.ml.feature import StopWordsRemover
    stop = stop_words or StopWordsRemover.loadDefaultStopWords("english")
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    df = df.select(F.col(doc_col).alias("doc"), F.col(cluster_col).alias("cluster"), text.alias("text"))
    n_docs = df.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).transform(saved)
    chunks = max(1, -(-(n_docs.agg(F.sum("chars")).first()[0] or 0) // chunk_chars))
    dealt = F.when(F.col("doc").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc"))
    docs = (join_small(df, n_docs.where(F.col("n") > 1).select("cluster", "n"), ["cluster"])
            .withColumn("chunk", F.pmod(dealt, F.lit(chunks)).cast("int")).repartition(chunks, "chunk"))
    docs = docs.withColumn("_raw", F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), 0)).drop("text")
    docs = StopWordsRemover(inputCol="_raw", outputCol="tok", stopWords=stop, caseSensitive=True).transform(docs).drop("_raw")
    bits = min(16, max(0, (chunks // 8).bit_length()))
    told = docs.groupBy("chunk").applyInArrow(lambda key, t: _tell(key[0].as_py(), t, bits), _TOLD)
    # saved, so that what was told is freed before the scores are made
    replies = told.groupBy("bucket").applyInArrow(_reply, "to_chunk int, bucket int, shared binary, df binary").transform(saved)
    slack = 0.0 if digits is None else 10.0 ** -digits  # rounding makes ties
    kind = df.schema["cluster"].dataType.simpleString()

    def summed(least: dict | None) -> DataFrame:
        def run(t: pa.Table, r: pa.Table) -> pa.Table:
            return _chunk_scores(t, r, bits, n_top, slack, least)
        parts = docs.groupBy("chunk").cogroup(replies.groupBy("to_chunk")).applyInArrow(run, f"cluster {kind}, term string, score double, least double")
        return parts.groupBy("cluster", "term").agg(F.sum("score").alias("score"), F.max("least").alias("least")).transform(saved)
    scores = summed(None)
    found = {}
    for r in top_k_per_group(scores.drop("least"), ["cluster"], [F.col("score").desc(), F.col("term").asc()], n_top, "term").collect():
        found.setdefault(r["cluster"], []).append(r["score"])  # n_top rows a cluster
    least = {c: min(x) if len(x) == n_top else 0.0 for c, x in found.items()}
    # what was left out scores less than the bound it was held against; else once more with a bound that holds
    if any(r["least"] > least[r["cluster"]] for r in scores.groupBy("cluster").agg(F.max("least").alias("least")).collect()):
        scores = summed(least)
    scores = scores.drop("least")
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    top = top_k_per_group(scores, ["cluster"], [F.col("score").desc(), F.col("term").asc()], n_top, "term")
    return top.select("cluster", F.col("rank").cast("int").alias("rank"), "term", "score")
