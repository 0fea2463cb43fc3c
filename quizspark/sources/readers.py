"""Readers: model response documents, master question CSVs, nested / flat
MCQ sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizspark.functions.prompts import hash_shuffle
from quizspark.operators.filters import limit_questions, normalise_flat, normalise_nested
from quizspark.operators.position import global_position
from quizspark.schema import LETTERS, RESPONSE_FILE_SCHEMA

_FILE = r"([^/]*)\.json$"


def file_stem() -> Column:
    """Name of the row's ``.json`` file without folder and ending."""
    return F.url_decode(F.regexp_extract(F.input_file_name(), _FILE, 1))


def model_and_dataset(name: Column, datasets: tuple[str, ...]) -> tuple[Column, Column]:
    """From ``<model>_<dataset>`` or ``<model>``: a listed dataset name is taken
    whole (the longest that fits), else what follows the last underscore."""
    model = F.when(name.contains("_"), F.regexp_extract(name, r"^(.*)_[^_]+$", 1)).otherwise(name)
    dataset = F.when(name.contains("_"), F.regexp_extract(name, r"^.*_([^_]+)$", 1)).otherwise("")
    for d in sorted(datasets, key=len):
        hit = name.endswith("_" + d)
        model = F.when(hit, F.substr(name, F.lit(1), F.length(name) - len(d) - 1)).otherwise(model)
        dataset = F.when(hit, F.lit(d)).otherwise(dataset)
    return model, dataset


def read_responses(spark: SparkSession, paths, datasets: tuple[str, ...] = ()) -> DataFrame:
    """One JSON document per (model, dataset) with the responses under
    ``questions``; returns one row per response with ``pos`` (its position
    in the file), ``model`` and ``dataset`` (from the file name:
    ``<model>_<dataset>.json`` or ``<model>.json``; ``datasets`` lists names
    that hold underscores themselves).

    A multi-line JSON file is a single task: convert once to Parquet with
    :func:`quizspark.sources.writers.write_responses` for volume."""
    raw = (spark.read.schema(RESPONSE_FILE_SCHEMA).option("multiLine", True)
           .option("allowNonNumericNumbers", True).json(paths))
    model, dataset = model_and_dataset(file_stem(), datasets)
    rows = raw.select(model.alias("model"), dataset.alias("dataset"),
                      F.posexplode("questions").alias("pos", "q"))
    return rows.select("model", "dataset", "pos", "q.*")


def read_questions(spark: SparkSession, path: str, index_col: str = "question_index") -> DataFrame:
    """Master questions CSV (pandas ``to_csv`` layout: first column is the
    unnamed index). Quoted fields may span lines; quotes are doubled."""
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .option("mode", "FAILFAST").csv(path))
    first = df.columns[0]
    if first in ("_c0", "", "Unnamed: 0"):
        df = df.withColumnRenamed(first, index_col).withColumn(index_col, F.col(index_col).cast("long"))
    elif index_col in df.columns:
        df = df.withColumn(index_col, F.col(index_col).cast("long"))
    else:  # no index: the row's place in the file is its key
        df = global_position(df.withColumn("_row", F.monotonically_increasing_id()), ["_row"], index_col).drop("_row")
    numeric = [c for c in df.columns if c in ("IOD", "MD", "llm_difficulty") or c.startswith("%")]
    return df.withColumns({c: F.col(f"`{c}`").cast("double") for c in numeric})


def read_difficulty(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    if fmt != "csv":
        return spark.read.parquet(path)
    df = spark.read.option("header", True).csv(path)
    return df.withColumns({c: F.col(c).cast("double" if c == "llm_difficulty" else "long") for c in df.columns})


def load_questions(spark: SparkSession, source: str, kind: str = "csv", limit: int | None = None,
                   n_options: int = 5, split: str | None = None, shuffle_seed: int | None = None) -> DataFrame:
    """Questions from a named layout: ``csv`` (master CSV), ``nested``
    (question / answer_idx / options[{key, value}], JSON or Parquet),
    ``flat`` (question, opa..opd, cop). Rows keep their source index, or get
    their position in the source, and the first ``limit`` by index are kept if a
    limit is given. ``split`` picks one of several files where ``source`` holds
    ``{split}``, else the rows whose column ``split`` is that. ``shuffle_seed``
    adds ``shuffle``, the order in which a prompt shows the options."""
    by_file = split is not None and "{split}" in source
    path = source.replace("{split}", split) if by_file else source
    if kind == "csv":
        df = read_questions(spark, path)
    else:
        df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path)
        if "question_index" not in df.columns:
            df = global_position(df.withColumn("_row", F.monotonically_increasing_id()), ["_row"], "question_index").drop("_row")
    if split is not None and not by_file:
        if "split" not in df.columns:
            raise ValueError("the source has neither {split} in its path nor a column split")
        df = df.where(F.col("split") == split).drop("split")
    if kind != "csv":
        df = normalise_nested(df, n_options) if kind == "nested" else normalise_flat(df)
    cols = ["question_index", "prompt"] + [x for x in LETTERS if x in df.columns] + ["Answer"]
    df = df.select(*cols, *[c for c in df.columns if c not in cols])
    if shuffle_seed is not None:
        letters = [x for x in LETTERS if x in df.columns]
        df = df.withColumn("shuffle", hash_shuffle("question_index", shuffle_seed, len(letters)))
    return limit_questions(df, limit) if limit else df
