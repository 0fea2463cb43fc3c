"""Command line for the end-to-end plans.

  python -m quizspark difficulty --responses DIR --out DIR [--dataset medqa] [--models a,b]
  python -m quizspark order --train CSV --out DIR --dataset NAME [--orderings a,b]
  python -m quizspark evaluate --test CSV --logprobs PARQUET --out DIR
  python -m quizspark cluster --prompts CSV --out DIR [--trials 100]

Reads ``spark.checkpoint.dir`` and the master from the environment's Spark
configuration (spark-submit); without one it runs on local[*].
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    """The cluster's session under spark-submit (spark.master is set);
    local[*] otherwise."""
    from pyspark import SparkConf
    if SparkConf().contains("spark.master"):
        return SparkSession.builder.appName("quizspark").getOrCreate()
    from quizspark.session import get_session
    return get_session(master="local[*]")


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="quizspark")
    sub = ap.add_subparsers(dest="cmd", required=True)
    d = sub.add_parser("difficulty", help="responses -> Index,llm_difficulty")
    d.add_argument("--responses", required=True, help="folder of <model>_<dataset>.json or a Parquet table")
    d.add_argument("--out", required=True)
    d.add_argument("--dataset")
    d.add_argument("--models")
    d.add_argument("--require-all-models", action="store_true")
    o = sub.add_parser("order", help="training CSV (with cluster_label, llm_difficulty) -> ordered sets")
    o.add_argument("--train", required=True)
    o.add_argument("--out", required=True)
    o.add_argument("--dataset", required=True)
    o.add_argument("--orderings")
    o.add_argument("--easy", type=float, default=0.66)
    o.add_argument("--med", type=float, default=0.80)
    e = sub.add_parser("evaluate", help="test CSV + option token log-probs -> predictions, metrics")
    e.add_argument("--test", required=True)
    e.add_argument("--logprobs", required=True, help="Parquet: question_index, option, tok, logprob")
    e.add_argument("--out", required=True)
    c = sub.add_parser("cluster", help="prompts CSV -> prompt, cluster_label")
    c.add_argument("--prompts", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--trials", type=int, default=100)
    args = ap.parse_args(argv)

    from quizspark.operators.ordering import OrderingSpec
    from quizspark.plans import lifecycles as L
    from quizspark.session import checkpoint_dir, ship_package
    from quizspark.sources import readers as R

    spark = _session()
    checkpoint_dir(spark)
    ship_package(spark)
    if args.cmd == "difficulty":
        r = (spark.read.parquet(args.responses) if args.responses.endswith(".parquet")
             else R.read_responses(spark, args.responses))
        models = args.models.split(",") if args.models else None
        L.difficulty_from_responses(r, args.dataset, models, require_all_models=args.require_all_models,
                                    out_path=args.out)
    elif args.cmd == "order":
        t = R.read_questions(spark, args.train)
        # labels of any type: whole numbers sort as numbers, others as text
        if "cluster_label" in t.columns and t.where("cluster_label is not null and try_cast(cluster_label as int) is null").isEmpty():
            t = t.withColumn("cluster_label", t["cluster_label"].cast("int"))
        spec = OrderingSpec(easy_threshold=args.easy, med_threshold=args.med)
        names = args.orderings.split(",") if args.orderings else None
        L.write_curriculum(t, args.out, args.dataset, spec, names)
    elif args.cmd == "evaluate":
        test = R.read_questions(spark, args.test)
        L.evaluate(test, spark.read.parquet(args.logprobs), os.path.join(args.out, "results"),
                   os.path.join(args.out, "metrics"))
    elif args.cmd == "cluster":
        q = R.read_questions(spark, args.prompts)
        labels, trials = L.prompt_categories(spark, q, n_trials=args.trials)
        labels.write.mode("overwrite").parquet(os.path.join(args.out, "labels"))
        trials.write.mode("overwrite").parquet(os.path.join(args.out, "trials"))


if __name__ == "__main__":
    main()
