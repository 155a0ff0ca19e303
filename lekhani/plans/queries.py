"""All queries of the engine by name, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bounded_distance, deletes
from ..operators import align, decode, em, evaluate, fuzzy, summary, variants
from ..operators import suggest as ranking
from ..sources import artifacts
from ..sources import corpus as src
from ..sources.corpus import SOURCE_SQL, SOURCES
from .catalogue import CATALOGUE, COUNTS
from .oracles import ALIGN_ORACLES, DELETES, FUZZY, OUTCOME_SQL, SQUASH, bootstrap_sql, search_sql
from .runtime import cut, numbered


def _sources(spark: SparkSession, sf_dir: str, uses: list[str]) -> dict[str, DataFrame]:
    """The named inputs. Syllables of words that several of them need are derived once, and counts are made once."""
    counted = [u for u in uses if u in COUNTS]
    segs = cut(SOURCES["segs"](spark, sf_dir)) if counted else None
    found = {u: cut(spark.sql(COUNTS[u], segs=segs)) for u in counted}
    return found | {u: segs if u == "segs" and segs is not None else SOURCES[u](spark, sf_dir) for u in uses if u not in COUNTS}


def _stated(uses: list[str], sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.sql(sql, **_sources(spark, sf_dir, uses))


def _checked(uses: list[str], sql: str) -> str:
    named = ["segs", *uses] if any(u in COUNTS for u in uses) and "segs" not in uses else uses
    tables = ",\n".join(f"{u} AS ({COUNTS[u].format(segs='segs') if u in COUNTS else SOURCE_SQL[u]})" for u in named)
    body = sql.format(**{u: u for u in uses})
    return f"WITH {tables}\nSELECT * FROM ({body})"


QUERIES = {name: _stated(uses, sql) for name, (uses, sql, *_) in CATALOGUE.items()}
ORACLES = {name: _checked(uses, other[0] if other else sql) for name, (uses, sql, *other) in CATALOGUE.items()}

_LM = {"start": "word_start", "unigram": "kn_unigram", "backoff": "kn_backoff", "bigram": "kn_bigram", "trigram": "kn_trigram", "trigram_backoff": "kn_trigram_backoff"}


def _emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return em.train(src.corpus(spark, sf_dir))


def language_model(spark: SparkSession, pairs: DataFrame) -> dict[str, DataFrame]:
    """The six tables that the decoder reads, from word pairs (roman, dev)."""
    found: dict[str, DataFrame] = {"segs": cut(src.segs_of(pairs))}
    found |= {u: cut(spark.sql(sql, segs=found["segs"])) for u, sql in COUNTS.items()}
    return {k: cut(spark.sql(CATALOGUE[v][1], **{u: found[u] for u in CATALOGUE[v][0]})) for k, v in _LM.items()}


def _model(spark: SparkSession, sf_dir: str) -> decode.Model:
    pairs = cut(src.corpus(spark, sf_dir))
    return decode.load(spark, em.train(pairs), language_model(spark, pairs), queries=src.query(spark, sf_dir))


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that the corpus has, with their word, and the first language that has it as source."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("roman"))
    lang = words.groupBy("roman").agg(F.min("lang").alias("source"))
    return src.query(spark, sf_dir).join(src.corpus(spark, sf_dir), "roman").join(lang, "roman")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.outcomes(_cases(spark, sf_dir), QUERIES["lexicon_prefix_topk"](spark, sf_dir))


def _suggest(spark: SparkSession, sf_dir: str, count: int = 8, context: DataFrame | None = None) -> DataFrame:
    learned = src.confirm(spark, sf_dir).select(F.col("roman").alias("variant"), "dev").distinct()
    return ranking.suggest(src.query(spark, sf_dir), lexicon=src.corpus(spark, sf_dir), learned=learned, learned_prefixes=src.learned_prefixes(spark, sf_dir), model=_model(spark, sf_dir), count=count, context=context)


def _boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the word confirmed last adds to words that have followed it: dev, boost."""
    last = src.confirm(spark, sf_dir).agg(F.max_by("dev", F.struct("uid", "turn", "pos")).alias("prev"))
    return QUERIES["context_boost"](spark, sf_dir).join(F.broadcast(last), "prev").select("dev", "boost")  # one row


def _suggest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the ranker's 10 best."""
    return cut(evaluate.outcomes(_cases(spark, sf_dir), _suggest(spark, sf_dir, 10)))


def _stream(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from ..streaming.learn import learn

    events = cut(src.confirm(spark, sf_dir))
    folder = f"{spark.sparkContext.getCheckpointDir()}/learn-{uuid.uuid4().hex}"
    events.select(F.col("uid").cast("long"), F.col("turn").cast("long"), F.col("pos").cast("int"), "roman", "dev").write.parquet(f"{folder}/events")
    return learn(spark, f"{folder}/events", f"{folder}/state")


def _stream_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.learn import word_counts

    return word_counts(_stream(spark, sf_dir)["words"]).select("dev", "frequency", F.size("variants").cast("long").alias("variants"), F.col("variants")[0].alias("first_variant"))


def _fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = src.confirm(spark, sf_dir).select(F.col("roman").alias("variant"), "dev").distinct()
    return fuzzy.match(src.query(spark, sf_dir), learned)


def _stream_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.learn import learn_context

    events = cut(src.confirm(spark, sf_dir).select(F.col("uid").cast("long"), F.col("turn").cast("long"), F.col("pos").cast("int"), "roman", "dev"))
    folder = f"{spark.sparkContext.getCheckpointDir()}/context-{uuid.uuid4().hex}"
    events.write.parquet(f"{folder}/events")
    return learn_context(spark, f"{folder}/events", f"{folder}/state", f"{folder}/out")


def _seed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.seed_emissions(align.seeds(src.corpus(spark, sf_dir)))


def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.clean(src.corpus(spark, sf_dir))


def _m_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = align.seeds(src.corpus(spark, sf_dir))
    old = align.seed_emissions(counts)
    return em.maximise(em.expected(_ready(spark, sf_dir), old), em.priors(counts), old)


def _lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The corpus written as lines of a text format, with comments, blank lines and lines that don't parse among them."""
    c = src.corpus(spark, sf_dir)
    if kind == "tsv":
        line = F.concat(F.lit(" "), "roman", F.lit("\t"), "dev", F.lit(" || "), F.reverse("dev"), F.lit(" "))
        return c.select(F.explode(F.array(line, F.concat(F.lit("# "), "roman"), F.lit("  "))).alias("value"))
    pair = F.to_json(F.struct(F.col("roman").alias("english word"), F.col("dev").alias("native word"), F.lit(1).alias("more")))
    return c.select(F.when(F.length("roman") % 7 == 0, F.concat(F.lit("{"), pair)).otherwise(pair).alias("value"))


def _dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of known queries with features: count, -length, -rank, whole match."""
    ranked = QUERIES["lexicon_prefix_topk"](spark, sf_dir)
    cases = src.query(spark, sf_dir).join(src.corpus(spark, sf_dir).withColumnRenamed("dev", "target"), "roman")
    x = ranked.join(cases, "roman")
    features = F.array(F.col("n").cast("double"), -F.length("dev").cast("double"), -F.col("rank").cast("double"), (F.length("dev") == F.length("target")).cast("double"))
    return x.select(F.col("roman").alias("case_id"), F.col("rank").alias("pos"), features.alias("f"), (F.col("dev") == F.col("target")).alias("is_target"))


_TRIED = [(1.0, 1.0, 1.0, 1.0), (0.0, 1.0, 0.0, 0.0), (1.0, 0.0, 0.5, 0.0), (0.0, 0.0, 1.0, 2.0), (0.5, 2.0, 0.0, 1.0)]
# Weights tried of emission, lm, length and lexicon.
GRIDS = [
    [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0],
    [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0],
    [-1.0, -0.5, -0.25, -0.1, 0.0, 0.1, 0.25, 0.5, 1.0],
    [0.0, 2.0, 5.0, 10.0, 20.0, 40.0, 80.0, 160.0],
]


def _decoded_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoder's 50 best of known queries at beam 128, with the reranker's features."""
    words = src.corpus(spark, sf_dir)
    cases = src.query(spark, sf_dir).join(words.withColumnRenamed("dev", "target"), "roman")
    x = decode.featured(decode.decode_all(cases, _model(spark, sf_dir), 50, decode.Config(beam=128)), words).join(cases, "roman")
    return x.select(F.col("roman").alias("case_id"), F.col("rank").alias("pos"), "f", (F.col("dev") == F.col("target")).alias("is_target"))


def _tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, hits = evaluate.tune(cut(_decoded_dev(spark, sf_dir)), GRIDS)
    return spark.createDataFrame([(*weights, hits)], "w0 double, w1 double, w2 double, w3 double, hits long")


def _recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cases have their word among the decoder's 1, 5, 10 and 50 best."""
    cases = src.query(spark, sf_dir).join(src.corpus(spark, sf_dir).select("roman"), "roman").agg(F.count(F.lit(1)).alias("total"))
    found = _decoded_dev(spark, sf_dir).where("is_target").agg(*[F.count(F.when(F.col("pos") <= k, 1)).alias(f"in_{k}") for k in (1, 5, 10, 50)])
    return cases.crossJoin(found)  # one row by one row


def _several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known queries in order as cases, each with its word and that of the next known query with the same first letter."""
    known = src.query(spark, sf_dir).join(src.corpus(spark, sf_dir), "roman")
    after = Window.partitionBy(F.substring("roman", 1, 1)).orderBy("roman")
    x = known.select("roman", F.array_compact(F.array("dev", F.lead("dev").over(after))).alias("targets"), F.substring("roman", 1, 1).alias("source"))
    return evaluate.numbered_cases(x, "roman")


def _several_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.case_outcomes(_several(spark, sf_dir), QUERIES["lexicon_prefix_topk"](spark, sf_dir))


def _suggest_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 cases whose word is not the ranker's best: none of sf0.01 is missing from its 10 best."""
    cases = _cases(spark, sf_dir).select("roman", F.array("dev").alias("targets"), "source")
    out = evaluate.case_outcomes(evaluate.numbered_cases(cases, "roman"), _suggest(spark, sf_dir, 10))
    return evaluate.misses(out, 20, flag="top1")


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the corpus and confirmations as one lexicon, with how often each stands in them."""
    both = src.corpus(spark, sf_dir).select("roman", "dev").unionByName(src.confirm(spark, sf_dir).select("roman", "dev"))
    return artifacts.lexicon_of(both).join(both.groupBy("roman", "dev").agg(F.count(F.lit(1)).alias("n")), ["roman", "dev"])


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and share that the seeds give each syllable of the corpus for the letters m and its first spelling."""
    model = cut(_seed_model(spark, sf_dir))
    wanted = model.groupBy("a").agg(F.min("chunk").alias("c")).select("a", F.explode(F.array_distinct(F.array("c", F.lit("m")))).alias("chunk"))
    return _rounded(summary.probability(wanted, model), "w", "p")


def _means(out: DataFrame) -> DataFrame:
    return out.agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("top1"), 6).alias("top1"), F.round(F.avg("top5"), 6).alias("top5"), F.round(F.avg("top10"), 6).alias("top10"), F.round(F.avg("rr"), 6).alias("mrr"))


def _intervals(out: DataFrame) -> DataFrame:
    p = out.groupBy("source").agg(F.percentile("rr", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("p"))
    return p.select("source", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("low", "middle", "high"))])


def _distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.confirm(spark, sf_dir).select("roman").distinct()


QUERIES |= {
    "delete_neighbourhood": lambda s, d: _distinct_words(s, d).select("roman", F.explode(deletes(F.col("roman"))).alias("del")),
    "fuzzy_match": _fuzzy,
    "roman_variants": lambda s, d: variants.expand(src.query(s, d)),
    "align_pairs": lambda s, d: align.aligned(align.clean(src.corpus(s, d)).select("roman", "dev")).select("roman", "dev", F.array_join("parts", "|").alias("parts")),
    "seed_counts": lambda s, d: align.seeds(src.corpus(s, d)),
    "seed_emissions": lambda s, d: _rounded(align.seed_emissions(align.seeds(src.corpus(s, d))), "p"),
    "em_train": lambda s, d: _rounded(_emission(s, d), "p"),
    "reverse_index": lambda s, d: _rounded(decode.reverse_index(align.seed_emissions(align.seeds(src.corpus(s, d)))), "w"),
    "lattice_edges": lambda s, d: _rounded(decode.lattice(src.query(s, d), decode.reverse_index(align.seed_emissions(align.seeds(src.corpus(s, d))))), "w"),
    "beam_decode": lambda s, d: _rounded(decode.decode_all(src.query(s, d), _model(s, d)), "emit", "lm"),
    "rerank_kbest": lambda s, d: _rounded(decode.rerank(decode.decode_all(src.query(s, d), _model(s, d), 32), src.corpus(s, d)), "rscore"),
    "suggest": _suggest,
    "suggest_context": lambda s, d: _suggest(s, d, context=_boosts(s, d)),
    "em_limited": lambda s, d: _rounded(em.train(src.corpus(s, d), iterations=4, limit=5000), "p"),
    "suggest_json": lambda s, d: ranking.as_json(_suggest(s, d)),
    "eval_hits": lambda s, d: _rounded(_outcomes(s, d), "rr"),
    "eval_rollup": lambda s, d: evaluate.rollup(_outcomes(s, d)),
    "bootstrap_ci": lambda s, d: evaluate.bootstrap(_outcomes(s, d)),
    "stream_learn": _stream_words,
    "stream_index": lambda s, d: _stream(s, d)["index"],
    "stream_context": _stream_context,
    "align_cost": lambda s, d: _rounded(align.aligned(_ready(s, d).select("roman", "dev")).select("roman", "dev", "cost"), "cost"),
    "top_emissions": lambda s, d: _rounded(summary.top_emissions(_seed_model(s, d)), "w"),
    "model_summary": lambda s, d: summary.model_summary(_seed_model(s, d), src.segs(s, d)),
    "chunk_codes": lambda s, d: align.seeds(src.corpus(s, d)).select("chunk").distinct().select("chunk", summary.pack_chunk(F.col("chunk")).cast("long").alias("code")),
    "em_forward_z": lambda s, d: _rounded(em.likelihoods(_ready(s, d), _seed_model(s, d)), "log_z"),
    "em_expected_counts": lambda s, d: _rounded(em.expected(_ready(s, d), _seed_model(s, d)), "c"),
    "em_m_step": lambda s, d: _rounded(_m_step(s, d), "p"),
    "bounded_edit": lambda s, d: QUERIES["vowel_collapse"](s, d).select("roman", "collapsed", bounded_distance(F.col("roman"), F.col("collapsed"), 2).alias("distance")),
    "tsv_parse": lambda s, d: src.parse_tsv(_lines(s, d, "tsv")).select("roman", F.array_join("targets", "|").alias("targets")),
    "jsonl_parse": lambda s, d: src.parse_jsonl(_lines(s, d, "jsonl")).select("roman", "dev"),
    "eval_mrr": lambda s, d: _means(_outcomes(s, d)),
    "percentile_ci": lambda s, d: _intervals(_outcomes(s, d)),
    "suggest_hits": lambda s, d: _rounded(_suggest_outcomes(s, d), "rr"),
    "suggest_rollup": lambda s, d: evaluate.rollup(_suggest_outcomes(s, d)),
    "suggest_mrr": lambda s, d: _means(_suggest_outcomes(s, d)),
    "suggest_percentile_ci": lambda s, d: _intervals(_suggest_outcomes(s, d)),
    "suggest_bootstrap_ci": lambda s, d: evaluate.bootstrap(_suggest_outcomes(s, d)),
    "mert_objective": lambda s, d: evaluate.objective(_dev(s, d), _TRIED),
    "mert_grid": _tuned,
    "kbest_recall": _recall,
    "eval_targets": lambda s, d: _rounded(_several_outcomes(s, d), "rr"),
    "eval_misses": lambda s, d: evaluate.misses(_several_outcomes(s, d), 20, flag="top1"),
    "eval_head": lambda s, d: evaluate.numbered_cases(_several(s, d).drop("case_id"), "roman", 50).select("case_id", "roman", F.array_join("targets", "|").alias("targets")),
    "suggest_misses": _suggest_misses,
    "lexicon_sorted": lambda s, d: numbered(artifacts.lexicon_of(src.corpus(s, d)), "roman", "place"),
    "union_splits": _union,
    "emission_prob": _probed,
    "widest_syllables": lambda s, d: summary.widest(_seed_model(s, d), 10),
    "jsonl_skipped": lambda s, d: src.line_counts(_lines(s, d, "jsonl")),
}
_ = lambda *names: ",\n".join(f"{u} AS ({SOURCE_SQL[u]})" for u in names)
_HITS = f"""WITH {_("corpus", "query", "prefixes")},
ranked AS ({CATALOGUE["lexicon_prefix_topk"][1].format(query="query", prefixes="prefixes")}),
words AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS roman, lang FROM documents),
lang AS (SELECT roman, min(lang) AS source FROM words GROUP BY roman),
cases AS (SELECT q.roman, c.dev, l.source FROM query q JOIN corpus c ON q.roman = c.roman JOIN lang l ON q.roman = l.roman),
hits AS (SELECT c.roman, c.source, min(r.rank) AS r FROM cases c LEFT JOIN ranked r ON c.roman = r.roman AND c.dev = r.dev GROUP BY c.roman, c.source),
o AS (SELECT roman, source, coalesce((r <= 1)::INT, 0) AS top1, coalesce((r <= 5)::INT, 0) AS top5, coalesce((r <= 10)::INT, 0) AS top10, coalesce(1.0e0 / r, 0e0) AS rr FROM hits)
"""
ORACLES |= {
    "delete_neighbourhood": f"WITH {_('confirm')} SELECT roman, unnest({DELETES}) AS del FROM (SELECT DISTINCT roman FROM confirm)",
    "fuzzy_match": f"WITH {_('confirm', 'query')}, {FUZZY} SELECT roman, dev, distance FROM near",
    "stream_learn": ORACLES["learned_words"],
    "stream_index": f"WITH {_('confirm', 'query')}, {FUZZY} SELECT del, dev FROM near_ix",
    "stream_context": ORACLES["context_bigrams"],
    **{{"hits": "eval_hits", "rollup": "eval_rollup", "mrr": "eval_mrr"}.get(k, k): _HITS + v for k, v in OUTCOME_SQL.items()},
    "bootstrap_ci": bootstrap_sql(_HITS.rstrip()),
    "bounded_edit": f"WITH {_('corpus')} SELECT roman, collapsed, CASE WHEN d <= 2 THEN d END AS distance FROM (SELECT roman, collapsed, levenshtein(roman, collapsed) AS d FROM (SELECT roman, {SQUASH} AS collapsed FROM corpus))",
    "tsv_parse": f"WITH {_('corpus')} SELECT roman, dev || '|' || array_to_string(list_reverse(regexp_extract_all(dev, '[\\s\\S]')), '') AS targets FROM corpus",
    "jsonl_parse": f"WITH {_('corpus')} SELECT roman, dev FROM corpus WHERE length(roman) % 7 <> 0",
    "mert_objective": f"""WITH {_("corpus", "query", "prefixes")},
ranked AS ({CATALOGUE["lexicon_prefix_topk"][1].format(query="query", prefixes="prefixes")}),
dev AS (SELECT r.roman, r.rank, r.n, r.dev, c.dev AS target FROM ranked r JOIN corpus c ON r.roman = c.roman),
tried(i, a, b, c, d) AS (VALUES {", ".join(str((i, *w)) for i, w in enumerate(_TRIED))}),
scored AS (SELECT i, roman, dev = target AS hit, row_number() OVER (PARTITION BY i, roman ORDER BY a * n - b * length(dev) - c * rank + d * (length(dev) = length(target))::INT DESC, rank) AS place FROM dev, tried)
SELECT i, sum(hit::INT) AS hits FROM scored WHERE place = 1 GROUP BY i""",
}
ORACLES |= ALIGN_ORACLES | search_sql(GRIDS)
_SEVERAL = f"""WITH {_("corpus", "query", "prefixes")},
ranked AS ({CATALOGUE["lexicon_prefix_topk"][1].format(query="query", prefixes="prefixes")}),
known AS (SELECT q.roman, c.dev, q.roman[1:1] AS source, row_number() OVER (ORDER BY q.roman) AS case_id FROM query q JOIN corpus c ON q.roman = c.roman),
cases AS (SELECT *, lead(dev) OVER (PARTITION BY source ORDER BY roman) AS other FROM known),
o AS (SELECT c.case_id, c.roman, c.source, (SELECT min(r.rank) FROM ranked r WHERE r.roman = c.roman AND r.dev IN (c.dev, coalesce(c.other, c.dev))) AS r FROM cases c)
"""
ORACLES |= {
    "eval_targets": _SEVERAL + "SELECT case_id, roman, source, coalesce((r <= 1)::INT, 0) AS top1, coalesce((r <= 5)::INT, 0) AS top5, coalesce((r <= 10)::INT, 0) AS top10, round(coalesce(1e0 / r, 0e0), 6) AS rr FROM o",
    "eval_misses": _SEVERAL + "SELECT case_id, roman, source FROM o WHERE coalesce(r, 9) > 1 ORDER BY case_id LIMIT 20",
    "eval_head": _SEVERAL + "SELECT case_id, roman, concat_ws('|', dev, other) AS targets FROM cases WHERE case_id <= 50",
    "lexicon_sorted": f"WITH {_('corpus')} SELECT roman, dev, row_number() OVER (ORDER BY roman) - 1 AS place FROM corpus WHERE regexp_full_match(roman, '[a-z]+') AND strlen(dev) <= 65535",
    "union_splits": f"WITH {_('corpus', 'confirm')} SELECT roman, dev, sum(n)::BIGINT AS n FROM (SELECT roman, dev, 1 AS n FROM corpus UNION ALL SELECT roman, dev, count(*) FROM confirm GROUP BY roman, dev) x WHERE strlen(dev) <= 65535 GROUP BY roman, dev",
    "jsonl_skipped": f"WITH {_('corpus')} SELECT count(*) FILTER (length(roman) % 7 <> 0) AS good, count(*) FILTER (length(roman) % 7 = 0) AS skipped FROM corpus",
}
ORACLES["chunk_codes"] = ALIGN_ORACLES["seed_counts"].replace("SELECT a, chunk, n FROM seed", "SELECT chunk, (length(chunk) * (1 << 26) + list_sum(list_transform(generate_series(1, length(chunk)), lambda k: (ascii(chunk[k]) - 97) * (32 ** (k - 1)))))::BIGINT AS code FROM (SELECT DISTINCT chunk FROM seed) x")
