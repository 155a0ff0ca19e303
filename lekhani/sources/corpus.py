"""Inputs: word pairs, confirmations and queries derived from the tables, and readers of the text formats."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SYLLABLE, ascii_lower, derived, syllables, trim_all
from ..plans.runtime import numbered, spread

PAIR = "`english word` STRING, `native word` STRING, source STRING"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokens(text: str = "text"):
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (roman, dev) of all words of ``documents``."""
    words = _table(spark, sf_dir, "documents").select(F.explode(_tokens()).alias("roman")).distinct()
    # A generated column: filters on a derived word would otherwise be copied below the exchange with all its functions.
    return spread(words, "roman").select("roman", F.explode(F.array(F.expr(derived("roman")))).alias("dev"))


def corpus_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(_tokens()).alias("pos", "roman"))
    return words.select("doc_id", "pos", "roman", F.expr(derived("roman")).alias("dev"))


def segs_of(pairs: DataFrame) -> DataFrame:
    """Each syllable of each pair's word with the next two: roman, pos, n, a, b, c."""
    aks = pairs.select("roman", syllables(F.col("dev")).alias("s"))
    at = aks.select("roman", F.size("s").alias("n"), "s", F.posexplode("s").alias("pos", "a"))
    return at.select("roman", "pos", "n", "a", F.get("s", F.col("pos") + 1).alias("b"), F.get("s", F.col("pos") + 2).alias("c"))


def segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``segs_of`` all distinct words."""
    return segs_of(corpus(spark, sf_dir))


def confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmations in order: uid, turn, pos, roman, dev."""
    t = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("uid"), "turn", F.posexplode(_tokens()).alias("pos", "roman"))
    return t.select("uid", "turn", "pos", "roman", F.expr(derived("roman")).alias("dev"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of ``benchmark`` as queries."""
    return _table(spark, sf_dir, "benchmark").select(F.explode(_tokens()).alias("roman")).distinct()


def qsegs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllables of distinct confirmed words, as ``segs``."""
    at = confirm(spark, sf_dir).select("dev").distinct().select(syllables(F.col("dev")).alias("s")).select("s", F.posexplode("s").alias("pos", "a"))
    return at.select("pos", "a", F.get("s", F.col("pos") + 1).alias("b"), F.get("s", F.col("pos") + 2).alias("c"))


def prefixes_of(df: DataFrame, *cols: str) -> DataFrame:
    """All prefixes of ``roman``, so that prefix joins are joins on equality."""
    return df.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("roman")), lambda i: F.substring("roman", F.lit(1), i))).alias("prefix"), "roman", *cols)


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes_of(corpus(spark, sf_dir), "dev")


def last_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One word per roman key, the last confirmed, with the word's frequency: roman, dev, frequency."""
    c = confirm(spark, sf_dir)
    last = c.groupBy("roman").agg(F.max_by("dev", F.struct("uid", "turn", "pos")).alias("dev"))
    return last.join(c.groupBy("dev").agg(F.count(F.lit(1)).alias("frequency")), "dev")


def learned_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes_of(last_writes(spark, sf_dir), "dev", "frequency")


SOURCES = {f.__name__: f for f in (corpus, corpus_raw, segs, confirm, query, qsegs, prefixes, learned_prefixes)}

_DUCK = derived("roman", group="\\", flag=", 'g'")
_LIST = "regexp_extract_all(lower({}), '[a-z]+')"
#: The same inputs as SQL of the checking engine.
SOURCE_SQL = {
    "corpus": f"SELECT roman, {_DUCK} AS dev FROM (SELECT DISTINCT unnest({_LIST.format('text')}) AS roman FROM documents)",
    "corpus_raw": f"SELECT doc_id, pos - 1 AS pos, roman, {_DUCK} AS dev FROM (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS roman FROM (SELECT doc_id, {_LIST.format('text')} AS l FROM documents))",
    "segs": f"SELECT roman, pos - 1 AS pos, len(s) AS n, s[pos] AS a, s[pos + 1] AS b, s[pos + 2] AS c FROM (SELECT roman, s, generate_subscripts(s, 1) AS pos FROM (SELECT roman, regexp_extract_all({_DUCK}, '{SYLLABLE}') AS s FROM (SELECT DISTINCT unnest({_LIST.format('text')}) AS roman FROM documents)))",
    "confirm": f"SELECT uid, turn, pos - 1 AS pos, roman, {_DUCK} AS dev FROM (SELECT conv_id AS uid, turn, generate_subscripts(l, 1) AS pos, unnest(l) AS roman FROM (SELECT conv_id, turn, {_LIST.format('text')} AS l FROM conversations))",
    "qsegs": f"SELECT pos - 1 AS pos, s[pos] AS a, s[pos + 1] AS b, s[pos + 2] AS c FROM (SELECT s, generate_subscripts(s, 1) AS pos FROM (SELECT regexp_extract_all(dev, '{SYLLABLE}') AS s FROM (SELECT DISTINCT {_DUCK} AS dev FROM (SELECT unnest({_LIST.format('text')}) AS roman FROM conversations))))",
    "prefixes": f"SELECT roman[1:i] AS prefix, roman, {_DUCK} AS dev FROM (SELECT roman, unnest(generate_series(1, length(roman))) AS i FROM (SELECT DISTINCT unnest({_LIST.format('text')}) AS roman FROM documents))",
    "query": f"SELECT DISTINCT unnest({_LIST.format('text')}) AS roman FROM benchmark",
}

SOURCE_SQL["learned_prefixes"] = f"SELECT roman[1:i] AS prefix, roman, dev, frequency FROM (SELECT l.roman, l.dev, frequency, unnest(generate_series(1, length(l.roman))) AS i FROM (SELECT roman, arg_max(dev, row(uid, turn, pos)) AS dev FROM ({SOURCE_SQL['confirm']}) GROUP BY roman) l JOIN (SELECT dev, count(*) AS frequency FROM ({SOURCE_SQL['confirm']}) GROUP BY dev) w ON l.dev = w.dev)"


def parse_jsonl(lines: DataFrame, *, strict: bool = False) -> DataFrame:
    """Lines (value) of JSON word pairs -> roman, dev, source. Blank lines are skipped; others that don't parse are
    dropped, or raise if ``strict``, with their number if ``lines`` has it as ``line``."""
    number = [F.col("line")] if "line" in lines.columns else []
    x = lines.select(trim_all(F.col("value")).alias("value"), *number).where("value <> ''")
    x = x.withColumn("r", F.from_json("value", PAIR))
    bad = F.col("r.english word").isNull() | F.col("r.native word").isNull()
    if strict:
        x = x.withColumn("r", F.when((F.col("value") != "") & bad, F.raise_error(_malformed(lines, "value")).cast(x.schema["r"].dataType)).otherwise(F.col("r")))
    else:
        x = x.where(~bad)
    return x.select(F.col("r.english word").alias("roman"), F.col("r.native word").alias("dev"), F.col("r.source").alias("source"), *number)


def _malformed(lines: DataFrame, value: str) -> Column:
    head = F.concat(F.lit("malformed line "), F.col("line").cast("string"), F.lit(": ")) if "line" in lines.columns else F.lit("malformed line: ")
    return F.concat(head, value)


def line_counts(lines: DataFrame) -> DataFrame:
    """One row: how many lines of JSON word pairs are good, and how many are skipped; blank ones are neither."""
    x = lines.select(trim_all(F.col("value")).alias("value")).where("value <> ''").select(F.from_json("value", PAIR).alias("r"))
    good = F.col("r.english word").isNotNull() & F.col("r.native word").isNotNull()
    return x.agg(F.count_if(good).alias("good"), F.count_if(~good).alias("skipped"))


def parse_tsv(lines: DataFrame) -> DataFrame:
    """Lines ``roman<TAB>target|target`` -> roman, targets. Blank lines and comments are skipped; no key or no target
    raises."""
    number = [F.col("line")] if "line" in lines.columns else []
    x = lines.select(trim_all(F.col("value")).alias("v"), *number).where("v <> '' AND v NOT LIKE '#%'")
    at = F.instr("v", "\t")
    roman = trim_all(F.substring("v", F.lit(1), F.greatest(at - 1, F.lit(0))))
    targets = F.filter(F.transform(F.split(F.substring("v", at + 1, F.length("v")), "\\|"), trim_all), lambda t: t != "")
    x = x.select("v", *number, roman.alias("roman"), targets.alias("targets"), at.alias("at"))
    skipped = (F.col("v") == "") | F.col("v").startswith("#")  # again, as filters on results may be applied first
    ok = skipped | ((F.col("at") > 0) & (F.col("roman") != "") & (F.size("targets") > 0))
    return x.select(F.when(ok, F.col("roman")).otherwise(F.raise_error(_malformed(lines, "v")).cast("string")).alias("roman"), "targets", *number)


def read_pairs(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """By extension: .json and .jsonl hold JSON lines, anything else tab-separated targets."""
    lines = spark.read.text(path)
    return parse_jsonl(lines, strict=strict) if path.lower().endswith((".json", ".jsonl")) else parse_tsv(lines)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, line: the lines of a file with their numbers from 1."""
    return numbered(spark.read.text(path).withColumn("_id", F.monotonically_increasing_id()), "_id", "line").select("value", (F.col("line") + 1).alias("line"))


def read_cases(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Evaluation cases of a file, the first ``most`` if given: case_id (number of the line), roman, targets, source.

    .json and .jsonl hold one target a line, trimmed, and may name a source; other files are tab-separated. Pairs with
    an empty side are left out of the former; a line that doesn't parse raises with its number.
    """
    lines = numbered_lines(spark, path)
    if path.lower().endswith((".json", ".jsonl")):
        x = parse_jsonl(lines, strict=True).select(F.col("line").alias("case_id"), trim_all(F.col("roman")).alias("roman"), F.array(trim_all(F.col("dev"))).alias("targets"), "source")
        x = x.where("roman <> '' AND targets[0] <> ''")
    else:
        x = parse_tsv(lines).select(F.col("line").alias("case_id"), "roman", "targets", F.lit(None).cast("string").alias("source"))
    return x if most is None else x.orderBy("case_id").limit(most)


def read_sourced(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_cases`` of JSON lines, but bad lines are dropped and romans lower-cased."""
    x = parse_jsonl(numbered_lines(spark, path))
    return x.select(F.col("line").alias("case_id"), ascii_lower(trim_all(F.col("roman"))).alias("roman"), F.array(trim_all(F.col("dev"))).alias("targets"), "source").where("roman <> '' AND targets[0] <> ''")


FEATURES = ("emission", "lm", "length", "lexicon")
WEIGHTS = (1.0, 1.0, 0.0, 0.0)


def read_weights(path: str) -> tuple[float, ...]:
    """Reranker weights by name; names that are missing, or a missing file, keep the defaults."""
    try:
        found = json.loads(Path(path).read_text()).get("weights", {})
    except (OSError, ValueError):
        found = {}
    return tuple(float(found.get(n, w)) for n, w in zip(FEATURES, WEIGHTS, strict=True))


def write_weights(path: str, weights: tuple[float, ...]) -> None:
    Path(path).write_text(json.dumps({"weights": dict(zip(FEATURES, weights, strict=True))}, indent=2))
