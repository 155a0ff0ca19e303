"""Queries that Spark SQL and the checking engine state alike: name -> (sources, SQL, SQL of the checking engine if other).

Sources are put in as ``{name}``: data frames for Spark, common table expressions for the other.
"""

from __future__ import annotations

from ..functions.text import SYLLABLE

_SYLLABLE = SYLLABLE.replace("\\", "\\\\")  # as a string of Spark SQL
_BIGRAM = "SELECT a, b, count(*) AS n FROM {segs} WHERE b IS NOT NULL GROUP BY a, b"
_TRIGRAM = "SELECT a, b, c, count(*) AS n FROM {segs} WHERE c IS NOT NULL GROUP BY a, b, c"
_VOCAB = "SELECT DISTINCT a FROM {segs}"
#: Counts that language models read several times, so they are made once: name -> SQL over ``segs``.
COUNTS = {"bi": _BIGRAM, "tri": _TRIGRAM, "v": _VOCAB}
_COUNTED = list(COUNTS)
#: The smoothed models, from the counts bi, tri and v.
LM_TABLES = """tot AS (SELECT count(*) AS d FROM bi), nv AS (SELECT count(*) AS k FROM v),
cont AS (SELECT b AS a, count(*) AS n FROM bi GROUP BY b),
uni AS (SELECT v.a, -ln((coalesce(cont.n, 0) + 0.5e0) / (tot.d + 0.5e0 * nv.k)) AS w FROM v LEFT JOIN cont ON v.a = cont.a CROSS JOIN tot CROSS JOIN nv),
ctx AS (SELECT a, sum(n) AS total, count(*) AS kinds FROM bi GROUP BY a),
big AS (SELECT bi.a, bi.b, -ln(greatest(bi.n - 0.75e0, 0e0) / ctx.total + 0.75e0 * ctx.kinds / ctx.total * exp(-uni.w)) AS w
        FROM bi JOIN ctx ON bi.a = ctx.a JOIN uni ON bi.b = uni.a),
back AS (SELECT v.a, coalesce(-ln(0.75e0 * ctx.kinds / ctx.total), 0e0) AS w FROM v LEFT JOIN ctx ON v.a = ctx.a),
tctx AS (SELECT a, b, count(*) AS kinds FROM tri GROUP BY a, b),
trig AS (SELECT tri.a, tri.b, tri.c, -ln(greatest(tri.n - 0.75e0, 0e0) / bi.n + 0.75e0 * tctx.kinds / bi.n * exp(-big.w)) AS w
         FROM tri JOIN tctx ON tri.a = tctx.a AND tri.b = tctx.b JOIN bi ON tri.a = bi.a AND tri.b = bi.b JOIN big ON tri.b = big.a AND tri.c = big.b),
tback AS (SELECT tctx.a, tctx.b, -ln(0.75e0 * tctx.kinds / bi.n) AS w FROM tctx JOIN bi ON tctx.a = bi.a AND tctx.b = bi.b)"""
_LM = "WITH bi AS (SELECT * FROM {bi}), tri AS (SELECT * FROM {tri}), v AS (SELECT * FROM {v}),\n" + LM_TABLES + "\n"
_LEARN = """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY turn, pos) AS seq FROM {confirm})
"""
CATALOGUE: dict[str, tuple] = {
    "corpus_clean_pairs": (["corpus"], f"SELECT roman, dev FROM {{corpus}} WHERE regexp_like(roman, '^[a-z]+$') AND length(roman) <= 24 AND size(regexp_extract_all(dev, '{_SYLLABLE}', 0)) BETWEEN 1 AND 12", f"SELECT roman, dev FROM {{corpus}} WHERE regexp_matches(roman, '^[a-z]+$') AND length(roman) <= 24 AND len(regexp_extract_all(dev, '{SYLLABLE}')) BETWEEN 1 AND 12"),
    "lexicon_distinct": (["corpus_raw"], "SELECT roman, dev, count(*) AS n FROM {corpus_raw} WHERE octet_length(dev) <= 65535 GROUP BY roman, dev", "SELECT roman, dev, count(*) AS n FROM {corpus_raw} WHERE strlen(dev) <= 65535 GROUP BY roman, dev"),
    "akshara_segments": (["segs"], "SELECT roman, pos, a FROM {segs}"),
    "akshara_unigrams": (["segs"], "SELECT a, count(*) AS n FROM {segs} GROUP BY a"),
    "word_initials": (["segs"], "SELECT a, count(*) AS n FROM {segs} WHERE pos = 0 GROUP BY a"),
    "akshara_bigrams": (["segs"], _BIGRAM),
    "akshara_trigrams": (["segs"], _TRIGRAM),
    "continuation_counts": (["segs"], "SELECT b AS a, count(DISTINCT a) AS contexts FROM {segs} WHERE b IS NOT NULL GROUP BY b"),
    "trigram_successors": (["segs"], "SELECT a, b, count(DISTINCT c) AS successors, count(*) AS n FROM {segs} WHERE c IS NOT NULL GROUP BY a, b"),
    "vocab_ids": (["segs"], "SELECT a, row_number() OVER (ORDER BY r, p) - 1 AS id FROM (SELECT a, r, min(pos) AS p FROM (SELECT a, pos, roman, min(roman) OVER (PARTITION BY a) AS r FROM {segs}) x WHERE roman = r GROUP BY a, r) y"),
    "kn_unigram": (_COUNTED, _LM + "SELECT a, round(w, 6) AS w FROM uni"),
    "kn_bigram": (_COUNTED, _LM + "SELECT a, b, round(w, 6) AS w FROM big"),
    "kn_backoff": (_COUNTED, _LM + "SELECT a, round(w, 6) AS w FROM back"),
    "kn_trigram": (_COUNTED, _LM + "SELECT a, b, c, round(w, 6) AS w FROM trig"),
    "kn_trigram_backoff": (_COUNTED, _LM + "SELECT a, b, round(w, 6) AS w FROM tback"),
    "word_start": (["segs", "v"], "WITH v AS (SELECT * FROM {v}), s AS (SELECT a, count(*) AS n FROM {segs} WHERE pos = 0 GROUP BY a), t AS (SELECT count(*) AS k, (SELECT sum(n) FROM s) AS total FROM v) SELECT v.a, round(-ln((coalesce(s.n, 0) + 0.5e0) / (t.total + 0.5e0 * t.k)), 6) AS w FROM v LEFT JOIN s ON v.a = s.a CROSS JOIN t"),
    "lm_backoff_lookup": ([*_COUNTED, "qsegs"], _LM + "SELECT q.a, q.b, q.c, round(least(coalesce(trig.w, coalesce(tback.w, 0e0) + coalesce(big.w, back.w + uni.w)), 30e0), 6) AS w FROM (SELECT DISTINCT a, b, c FROM {qsegs} WHERE c IS NOT NULL) q LEFT JOIN trig ON q.a = trig.a AND q.b = trig.b AND q.c = trig.c LEFT JOIN tback ON q.a = tback.a AND q.b = tback.b LEFT JOIN big ON q.b = big.a AND q.c = big.b LEFT JOIN back ON q.b = back.a LEFT JOIN uni ON q.c = uni.a"),
    "lexicon_exact": (["corpus", "query"], "SELECT q.roman, l.dev FROM {query} q JOIN {corpus} l ON q.roman = l.roman"),
    "lexicon_semi": (["corpus", "confirm"], "SELECT c.roman, c.dev, max(CASE WHEN l.roman IS NULL THEN 0 ELSE 1 END) AS in_lexicon, count(*) AS n FROM {confirm} c LEFT JOIN {corpus} l ON c.roman = l.roman AND c.dev = l.dev GROUP BY c.roman, c.dev"),
    "lexicon_prefix_topk": (["prefixes", "query"], "SELECT roman, dev, n, rank FROM (SELECT roman, dev, n, row_number() OVER (PARTITION BY roman ORDER BY n DESC, dev) AS rank FROM (SELECT q.roman, p.dev, count(*) AS n FROM {query} q JOIN {prefixes} p ON q.roman = p.prefix GROUP BY q.roman, p.dev) x) y WHERE rank <= 8"),
    "learned_words": (["confirm"], "SELECT dev, count(*) AS frequency, count(DISTINCT roman) AS variants, min(roman) AS first_variant FROM {confirm} GROUP BY dev"),
    "pair_counts": (["confirm"], "SELECT roman, dev, count(*) AS n FROM {confirm} GROUP BY roman, dev"),
    "trie_last_write": (["confirm"], "SELECT roman, max_by(dev, struct(uid, turn, pos)) AS dev FROM {confirm} GROUP BY roman", "SELECT roman, arg_max(dev, row(uid, turn, pos)) AS dev FROM {confirm} GROUP BY roman"),
    "trie_prefix_topk": (["learned_prefixes", "query"], "SELECT roman, dev, frequency, rank FROM (SELECT q.roman, p.dev, p.frequency, row_number() OVER (PARTITION BY q.roman ORDER BY p.frequency DESC, p.dev) AS rank FROM {query} q JOIN (SELECT DISTINCT prefix, dev, frequency FROM {learned_prefixes}) p ON q.roman = p.prefix) x WHERE rank <= 24"),
    "context_bigrams": (["confirm"], _LEARN + "SELECT prev, dev, count(*) AS n FROM (SELECT dev, lag(dev) OVER (PARTITION BY uid ORDER BY seq) AS prev FROM o) x WHERE prev IS NOT NULL GROUP BY prev, dev"),
    "context_boost": (["confirm"], _LEARN + "SELECT prev, dev, n, CAST(floor(log2(n) * 10) AS BIGINT) AS boost FROM (SELECT prev, dev, count(*) AS n FROM (SELECT dev, lag(dev) OVER (PARTITION BY uid ORDER BY seq) AS prev FROM o) x WHERE prev IS NOT NULL GROUP BY prev, dev) y"),
    "history_window": (["confirm"], _LEARN + "SELECT uid, seq, concat_ws(' ', lag(dev, 2) OVER w, lag(dev, 1) OVER w, dev) AS history FROM o WINDOW w AS (PARTITION BY uid ORDER BY seq)"),
    "vowel_collapse": (["corpus"], "SELECT roman, regexp_replace(roman, '([aeiouAEIOU])\\\\1+', '$1') AS collapsed FROM {corpus}", "SELECT roman, " + "".join("regexp_replace(" for _ in "aeiouAEIOU") + "roman" + "".join(f", '{v}+', '{v}', 'g')" for v in "aeiouAEIOU") + " AS collapsed FROM {corpus}"),
}
