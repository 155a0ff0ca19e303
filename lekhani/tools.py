"""Command lines: ``python -m lekhani.tools TOOL ...``. Each gives the data frames it shows, by name.

Models and lexicons are snapshots in a folder (``sources/artifacts.py``). Paths are anything Spark reads; ``--spark``
passes a setting to the session.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import decode, em, evaluate, summary
from .operators.suggest import suggest
from .plans.queries import GRIDS, language_model
from .plans.runtime import cut
from .sources import artifacts
from .sources import corpus as src

Shown = dict[str, DataFrame]


def _splits(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """All pairs of the training file and the extra ones, and the counts of their lines."""
    lines = spark.read.text([a.train, *a.extra])
    return src.parse_jsonl(lines).select("roman", "dev"), src.line_counts(lines)


def train_model(spark: SparkSession, a: argparse.Namespace) -> Shown:
    """Train on pairs and keep the model. The limit is on the pairs of EM; the language model reads all."""
    pairs, lines = _splits(spark, a)
    pairs = cut(pairs.where("roman <> '' AND dev <> ''"))
    emission = cut(em.train(pairs, iterations=a.iterations, seeded=not a.no_seed, limit=a.limit))
    artifacts.save_model(spark, a.out, emission, language_model(spark, pairs))
    return {"lines": lines, "model": summary.model_summary(emission, src.segs_of(pairs)), "widest": summary.widest(emission, a.sample), "emissions": summary.top_emissions(emission.join(summary.widest(emission, a.sample), "a", "left_semi"))}


def build_lexicon(spark: SparkSession, a: argparse.Namespace) -> Shown:
    """Keep the clean pairs as a lexicon."""
    pairs, lines = _splits(spark, a)
    artifacts.save_lexicon(spark, a.out, pairs)
    return {"lines": lines, "lexicon": artifacts.load_lexicon(spark, a.out).agg(F.count("*").alias("pairs"), F.count_distinct("roman").alias("romans"))}


def _model(spark: SparkSession, path: str, queries: DataFrame, config: decode.Config = decode.Config()) -> decode.Model:
    model = artifacts.load_model(spark, path, config, queries)
    if model is None:
        raise SystemExit(f"no model that can be used in {path}")
    return model


def train_reranker(spark: SparkSession, a: argparse.Namespace) -> Shown:
    """Search weights on the 50 best at beam 128 of a development set and keep them."""
    config = decode.Config(beam=128)
    cases = cut(src.read_sourced(spark, a.dev))
    lexicon = artifacts.load_lexicon(spark, a.lexicon) if a.lexicon else None
    lexicon = lexicon if lexicon is not None else spark.createDataFrame([], "roman string, dev string")
    best = decode.decode_all(cases, _model(spark, a.model, cases, config), 50, config)
    dev = decode.featured(best, lexicon).join(cases.select("case_id", "roman", F.col("targets")[0].alias("target")), "roman")
    dev = cut(dev.select("case_id", F.col("rank").alias("pos"), "f", (F.col("dev") == F.col("target")).alias("is_target")))
    weights, hits = evaluate.tune(dev, GRIDS)
    src.write_weights(a.out, tuple(weights))
    rows = [(n, float(w)) for n, w in zip(src.FEATURES, weights, strict=True)]
    recall = dev.agg(F.count_distinct("case_id").alias("decoded"), F.count_if("is_target").alias("in_50"), F.lit(hits).alias("hits"))
    return {"recall": recall, "weights": spark.createDataFrame(rows, "feature string, weight double")}


def _top(cases: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Outcomes with ``hit``: whether a target is among the ``k`` best."""
    out = evaluate.case_outcomes(cases, ranked.where(F.col("rank") <= k))
    return cut(out.withColumn("hit", (F.col("rr") > 0).cast("int")))


def _by_source(out: DataFrame, grand: bool = True) -> DataFrame:
    by = out.rollup("source") if grand else out.groupBy("source")
    x = by.agg(F.grouping_id().alias("g") if grand else F.lit(0).alias("g"), F.count(F.lit(1)).alias("total"), F.sum("top1").alias("top1"), F.sum("hit").alias("topk"))
    return x.orderBy("g", "source").select(F.when(F.col("g") == 1, "all").otherwise(F.coalesce("source", F.lit("unknown"))).alias("source"), "total", "top1", "topk")


def evaluate_model(spark: SparkSession, a: argparse.Namespace) -> Shown:
    """Hits of the decoder alone, by source and in all."""
    config = decode.Config(beam=a.beam, per_chunk=a.per_chunk, lm_weight=a.lm_weight)
    cases = cut(src.read_sourced(spark, a.dataset))
    ranked = decode.decode_all(cases, _model(spark, a.model, cases, config), a.topk, config)
    out = _top(cases, ranked, a.topk)
    return {"hits": _by_source(out), "misses": evaluate.misses(out, a.show_misses, flag="hit")}


def _ranked(spark: SparkSession, a: argparse.Namespace, cases: DataFrame, count: int) -> DataFrame:
    """What an engine without learned words suggests."""
    lexicon = artifacts.load_lexicon(spark, a.lexicon) if a.lexicon else None
    none = lambda s: spark.createDataFrame([], s)
    model = artifacts.load_model(spark, a.model, queries=cases) if a.model else None
    weights = src.read_weights(a.weights) if a.weights else src.WEIGHTS
    return suggest(cases.select("roman").distinct(), lexicon=lexicon if lexicon is not None else none("roman string, dev string"), learned=none("variant string, dev string"), learned_prefixes=none("prefix string, dev string, frequency long"), model=model, count=count, weights=weights)


def evaluate_pairs(spark: SparkSession, a: argparse.Namespace) -> Shown:
    """Hits of suggestions for JSON lines with a source, by source."""
    cases = cut(src.read_sourced(spark, a.dataset))
    out = _top(cases, _ranked(spark, a, cases, a.topk), a.topk)
    return {"hits": _by_source(out, grand=False), "misses": evaluate.misses(out, a.show_misses, flag="hit")}


def evaluate_engine(spark: SparkSession, a: argparse.Namespace) -> Shown:
    """Means of suggestions with intervals by resampling."""
    cases = cut(src.read_cases(spark, a.dataset, a.limit))
    out = cut(evaluate.case_outcomes(cases, _ranked(spark, a, cases, max(10, a.topk))))
    means = out.agg(F.count(F.lit(1)).alias("total"), *[F.avg(c).alias(c) for c in ("top1", "top5", "top10")], F.avg("rr").alias("mrr"))
    ends = evaluate.bootstrap(out, resamples=a.resamples, seed=a.seed, order="case_id")
    return {"means": means, "intervals": ends, "misses": evaluate.misses(out, a.show_misses)}


def evaluate_targets(spark: SparkSession, a: argparse.Namespace) -> Shown:
    """Hits of suggestions for tab-separated cases with several targets."""
    cases = cut(src.read_cases(spark, a.dataset))
    out = _top(cases, _ranked(spark, a, cases, a.topk), a.topk)
    share = lambda c: (100 * F.avg(c)).alias(f"{c}_percent")
    return {"hits": out.agg(F.count(F.lit(1)).alias("total"), F.sum("top1").alias("top1"), F.sum("hit").alias("topk"), share("top1"), share("hit")), "misses": evaluate.misses(out, a.show_misses, flag="hit")}


def probe_model(spark: SparkSession, a: argparse.Namespace) -> Shown:
    """The edges of a word's chunks of up to four letters, and its best words."""
    word = spark.createDataFrame([(a.word,)], "roman string")
    found = artifacts.load_tables(spark, a.model)
    if found is None:
        raise SystemExit(f"no model that can be used in {a.model}")
    edges = decode.lattice(word, decode.reverse_index(found[0])).where("len <= 4").orderBy("pos", "len", "w", "a")
    return {"edges": edges, "words": decode.decode_all(word, decode.load(spark, *found, queries=word)).orderBy("rank")}


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lekhani.tools", description=__doc__)
    top.add_argument("--spark", action="append", default=[], metavar="KEY=VALUE")
    tools = top.add_subparsers(required=True, metavar="TOOL")

    def tool(run, *required: str) -> argparse.ArgumentParser:
        p = tools.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        p.set_defaults(run=run)
        for name in required:
            p.add_argument(f"--{name}", required=True)
        return p

    for run in (train_model, build_lexicon):
        p = tool(run, "train", "out")
        p.add_argument("--extra", action="append", default=[])
        if run is train_model:
            p.add_argument("--limit", type=int)
            p.add_argument("--iterations", type=int, default=12)
            p.add_argument("--no-seed", action="store_true")
            p.add_argument("--sample", type=int, default=10)
    tool(train_reranker, "model", "dev", "out").add_argument("--lexicon")
    p = tool(evaluate_model, "model", "dataset")
    p.add_argument("--lm-weight", type=float, default=1.0)
    p.add_argument("--beam", type=int, default=64)
    p.add_argument("--per-chunk", type=int, default=16)
    engines = [tool(run, "dataset") for run in (evaluate_pairs, evaluate_engine, evaluate_targets)]
    for e in engines:
        for name in ("--lexicon", "--model", "--weights"):
            e.add_argument(name)
    for e in (p, *engines):
        e.add_argument("--topk", type=int, default=10)
        e.add_argument("--show-misses", type=int, default=20)
    engines[1].add_argument("--resamples", type=int, default=1000)
    engines[1].add_argument("--seed", type=int, default=42)
    engines[1].add_argument("--limit", type=int)
    tool(probe_model, "model", "word")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> Shown:
    """Run a tool and show what it found."""
    a = _parser().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder.appName("lekhani")
        for setting in a.spark:
            builder = builder.config(*setting.split("=", 1))
        spark = builder.getOrCreate()
    shown = a.run(spark, a)
    for name, df in shown.items():
        print(name)
        df.show(100, truncate=False)
    return shown


if __name__ == "__main__":
    main()
