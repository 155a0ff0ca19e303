"""SQL of the checking engine for alignment, training, lattices, variants and resampling. Each works the result out anew."""

from __future__ import annotations

import re

from ..functions.text import BARE, SYLLABLE
from ..operators.variants import NOT_SHORT, RULES
from ..sources.corpus import SOURCE_SQL
from .catalogue import COUNTS, LM_TABLES

#: Least costs cell by cell (k = j * 25 + i for i letters and j code points), then each pair of lengths traced back.
_ALIGN = """
dp AS (
  SELECT 1 AS k, [0e0] AS c, [0] AS o
  UNION ALL
  SELECT k + 1, list_append(c, least(s, d, i, g)), list_append(o, CASE WHEN s <= least(d, i, g) THEN 1 WHEN d <= least(i, g) THEN 2 WHEN i <= g THEN 3 ELSE 4 END)
  FROM (SELECT k, c, o,
    CASE WHEN k % 25 > 0 AND k >= 25 THEN c[k - 25] + 1.0e0 ELSE 1e9 END AS s, CASE WHEN k % 25 > 0 THEN c[k] + 1.5e0 ELSE 1e9 END AS d,
    CASE WHEN k >= 25 THEN c[k - 24] + 1.5e0 ELSE 1e9 END AS i, CASE WHEN k % 25 > 1 AND k >= 25 THEN c[k - 26] + 1.3e0 ELSE 1e9 END AS g
    FROM dp WHERE k < 25 * 65) x),
whole AS (SELECT c, o FROM dp WHERE k = 25 * 65),
bt AS (
  SELECT m, n, m AS i, n AS j, []::INT[] AS offs, []::INT[] AS lens FROM (SELECT unnest(range(1, 25))::INT AS m) a, (SELECT unnest(range(1, 65))::INT AS n) b
  UNION ALL
  SELECT m, n, i - CASE w WHEN 3 THEN 0 WHEN 4 THEN 2 ELSE 1 END, j - CASE w WHEN 2 THEN 0 ELSE 1 END,
    CASE w WHEN 2 THEN offs ELSE list_prepend(i - CASE w WHEN 1 THEN 1 WHEN 4 THEN 2 ELSE 0 END, offs) END,
    CASE w WHEN 2 THEN lens ELSE list_prepend(CASE w WHEN 1 THEN 1 WHEN 4 THEN 2 ELSE 0 END, lens) END
  FROM (SELECT bt.*, whole.o[j * 25 + i + 1] AS w FROM bt, whole WHERE i > 0 OR j > 0) x),
al AS (SELECT m, n, offs, lens FROM bt WHERE i = 0 AND j = 0)"""
_CLEAN = f"clean AS (SELECT roman, dev, regexp_extract_all(dev, '{SYLLABLE}') AS aks FROM corpus WHERE regexp_matches(roman, '^[a-z]+$') AND length(roman) <= 24 AND len(regexp_extract_all(dev, '{SYLLABLE}')) BETWEEN 1 AND 12)"
_PARTS = "parts AS (SELECT roman, dev, aks, list_transform(generate_series(1, n), lambda k: roman[offs[k] + 1 : offs[k] + lens[k]]) AS parts FROM clean JOIN al ON length(roman) = m AND length(dev) = n)"
_SEEDS = f"""
dealt AS (SELECT list_filter(parts, lambda p: p <> '') AS p, aks, generate_subscripts(aks, 1) AS k FROM parts),
each AS (SELECT aks[k] AS a, array_to_string(p[before + 1 : before + length(aks[k])], '') AS c
         FROM (SELECT p, aks, k, coalesce(list_sum(list_transform(aks[1 : k - 1], lambda x: length(x))), 0)::INT AS before FROM dealt) x),
fit AS (SELECT a, c, regexp_matches(a, '[{BARE}]$') AS bare FROM each WHERE length(c) BETWEEN 1 AND 5),
forms AS (SELECT a, c AS chunk FROM fit UNION ALL SELECT a, c || 'a' FROM fit WHERE bare AND length(c) < 5
          UNION ALL SELECT a, left(c, length(c) - 1) FROM fit WHERE bare AND c LIKE '%a' AND length(c) > 1),
seed AS (SELECT a, chunk, count(*) AS n FROM forms GROUP BY a, chunk),
emission AS (SELECT a, chunk, greatest(n / sum(n) OVER (PARTITION BY a), 1e-4) AS p FROM seed)"""
_REVERSE = "rev AS (SELECT chunk, a, w, row_number() OVER (PARTITION BY chunk ORDER BY w, a) AS rank FROM (SELECT chunk, a, -ln(p) AS w FROM emission) x WHERE w < 8 QUALIFY rank <= 16)"
#: Sums over all ways to cut the letters: forwards f and backwards b, a syllable a step.
_PASSES = """
fwd AS (
  SELECT roman, dev, aks, 0 AS j, 0 AS i, 1e0 AS f FROM clean
  UNION ALL
  SELECT x.roman, x.dev, x.aks, x.j + 1, x.i + x.l, sum(x.f * e.p) FROM (SELECT *, unnest(range(1, 6))::INT AS l FROM fwd WHERE j < len(aks)) x
  JOIN emission e ON e.a = x.aks[x.j + 1] AND e.chunk = x.roman[x.i + 1 : x.i + x.l] WHERE x.i + x.l <= length(x.roman)
  GROUP BY x.roman, x.dev, x.aks, x.j, x.i + x.l),
total AS (SELECT roman, dev, f AS z FROM fwd WHERE j = len(aks) AND i = length(roman) AND f > 0)"""
_COUNTS = """
bwd AS (
  SELECT roman, dev, aks, len(aks) AS j, length(roman) AS i, 1e0 AS b FROM clean
  UNION ALL
  SELECT x.roman, x.dev, x.aks, x.j - 1, x.i - x.l, sum(x.b * e.p) FROM (SELECT *, unnest(range(1, 6))::INT AS l FROM bwd WHERE j > 0) x
  JOIN emission e ON e.a = x.aks[x.j] AND e.chunk = x.roman[x.i - x.l + 1 : x.i] WHERE x.i - x.l >= 0
  GROUP BY x.roman, x.dev, x.aks, x.j, x.i - x.l),
used AS (SELECT e.a, e.chunk, sum(f.f * e.p * b.b / t.z) AS c FROM fwd f JOIN bwd b ON f.roman = b.roman AND f.dev = b.dev AND b.j = f.j + 1
  JOIN total t ON t.roman = f.roman AND t.dev = f.dev
  JOIN emission e ON e.a = f.aks[f.j + 1] AND e.chunk = f.roman[f.i + 1 : b.i] WHERE b.i - f.i BETWEEN 1 AND 5 GROUP BY e.a, e.chunk)"""


#: New shares from a round's counts; syllables without counts keep theirs.
_SHARES = """(SELECT u.a, u.chunk, (u.c + 0.05e0 * pr.q) / (t.t + 0.05e0) AS p FROM used u JOIN (SELECT a, sum(c) AS t FROM used GROUP BY a) t ON u.a = t.a JOIN prior pr ON pr.chunk = u.chunk
  UNION ALL SELECT a, chunk, p FROM emission WHERE a NOT IN (SELECT a FROM used))"""
_PRIOR = "prior AS (SELECT chunk, sum(n) / (SELECT sum(n)::DOUBLE FROM seed) AS q FROM seed GROUP BY chunk)"


def rounds(n: int) -> list[str]:
    """The parts of ``n`` rounds of training: each works out its sums anew from the shares of the one before."""
    parts = [_PRIOR]
    for k in range(1, n + 1):
        old = "emission" if k == 1 else f"emission{k - 1}"
        body = ",\n".join([_PASSES, _COUNTS, f"emission{k} AS MATERIALIZED {_SHARES}"])
        for name in ("fwd", "bwd", "total", "used"):
            body = re.sub(rf"\b{name}\b", f"{name}{k}", body)
        body = re.sub(r"\bemission\b", old, body)
        for name in ("total", "used"):
            body = body.replace(f"{name}{k} AS (", f"{name}{k} AS MATERIALIZED (")
        parts.append(body)
    return parts


def _with(sources: list[str], *parts: str) -> str:
    tables = [f"{s} AS ({SOURCE_SQL[s]})" for s in sources]
    return "WITH RECURSIVE " + ",\n".join([*tables, *parts]) + "\n"


_SEEDED = (_CLEAN, _ALIGN, _PARTS, _SEEDS)
_LESS_ONE = "list_transform(generate_series(1, length(roman)), lambda i: roman[1:i - 1] || roman[i + 1:])"
_LESS_TWO = "list_transform(generate_series(1, length(x)), lambda j: x[1:j - 1] || x[j + 1:])"
#: ``roman`` and what is left of it without one or two of its characters.
DELETES = f"list_distinct(list_concat([roman], {_LESS_ONE}, flatten(list_transform({_LESS_ONE}, lambda x: {_LESS_TWO}))))"
SQUASH = "regexp_replace(" * 10 + "roman" + "".join(f", '{v}+', '{v}', 'g')" for v in "aeiouAEIOU")


def _near(query: str, name: str) -> str:
    """Words of ``confirm`` within two edits of the strings (roman) of ``query``, as the last of some tables."""
    return f"""
{name}_v AS (SELECT DISTINCT roman AS variant, dev FROM confirm),
{name}_ix AS (SELECT DISTINCT unnest({DELETES}) AS del, dev FROM (SELECT variant AS roman, dev FROM {name}_v UNION SELECT dev AS roman, dev FROM {name}_v) x),
{name}_as AS (SELECT roman, unnest({DELETES}) AS del FROM (SELECT DISTINCT roman FROM {query}) x),
{name}_in AS (SELECT DISTINCT a.roman, i.dev FROM {name}_as a JOIN {name}_ix i ON a.del = i.del),
{name}_sq AS (SELECT variant, {SQUASH.replace('roman', 'variant')} AS short FROM (SELECT DISTINCT variant FROM {name}_v) x),
{name}_qs AS (SELECT roman, {SQUASH} AS short FROM (SELECT DISTINCT roman FROM {query}) x),
{name} AS (SELECT f.roman, f.dev, min(least(levenshtein(f.roman, v.variant), levenshtein(q.short, s.short))) AS distance
  FROM {name}_in f JOIN {name}_v v ON f.dev = v.dev JOIN {name}_sq s ON s.variant = v.variant JOIN {name}_qs q ON q.roman = f.roman
  GROUP BY f.roman, f.dev HAVING distance <= 2)"""


FUZZY = _near("query", "near")
_VALUES = ", ".join(f"('{a.replace(chr(39), chr(39) * 2)}', '{b}', {c}, {str(a in NOT_SHORT).lower()})" for a, b, c in RULES)
_REWRITES = f"""
rules(frm, too, c, long) AS (VALUES {_VALUES}),
v0(roman, spot, written, cost) AS (
  SELECT roman, 0, '', 0 FROM query
  UNION
  SELECT roman, spot + s.n, written || s.w, cost + s.c FROM (
    SELECT v0.*, unnest(list_append(coalesce((SELECT list({{'n': length(frm)::INT, 'w': too, 'c': c}}) FROM rules WHERE substr(roman, spot + 1, length(frm)) = frm AND (NOT long OR length(roman) > 2)), []),
      {{'n': 1, 'w': substr(roman, spot + 1, 1), 'c': 0}})) AS s FROM v0 WHERE spot < length(roman)) x),
spelt AS (SELECT roman, written AS variant, cost AS penalty, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY roman ORDER BY cost, strlen(written) DESC, written) AS rank
  FROM (SELECT roman, written, min(cost) AS cost FROM v0 WHERE spot = length(roman) GROUP BY roman, written) x) y WHERE rank <= 6)"""
#: The language model as the decoder reads it, to 6 places.
_COUNTED = ",\n".join(f"{k} AS ({v.format(segs='segs')})" for k, v in COUNTS.items())
_LM = _COUNTED + ",\n" + LM_TABLES + """,
wstart AS (SELECT v.a, round(-ln((coalesce(s.n, 0) + 0.5e0) / (t.total + 0.5e0 * t.k)), 6) AS w FROM v LEFT JOIN (SELECT a, count(*) AS n FROM segs WHERE pos = 0 GROUP BY a) s ON v.a = s.a
  CROSS JOIN (SELECT count(*) AS k, (SELECT count(*) FROM segs WHERE pos = 0) AS total FROM v) t),
w1 AS MATERIALIZED (SELECT uni.a, round(uni.w, 6) AS u, round(back.w, 6) AS b FROM uni JOIN back ON uni.a = back.a),
w2 AS MATERIALIZED (SELECT a, b, round(w, 6) AS w FROM big),
w3 AS MATERIALIZED (SELECT a, b, c, round(w, 6) AS w FROM trig),
w4 AS MATERIALIZED (SELECT a, b, round(w, 6) AS w FROM tback)"""


def _beam(emission: str, beam: int, keep: int) -> str:
    """Tables up to found (roman, dev, emit, lm, n, rank): the ``keep`` best of each query, a syllable a step."""
    return f"""
rev AS MATERIALIZED (SELECT chunk, a, round(w, 6) AS w FROM (SELECT chunk, a, -ln(p) AS w FROM {emission}) x WHERE w < 8 QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY w, a) <= 16),
edges AS MATERIALIZED (SELECT x.roman, x.pos, x.pos + x.len AS upto, r.a, r.w FROM (SELECT roman, pos, unnest(range(1, least(5, length(roman) - pos) + 1)) AS len FROM (SELECT roman, unnest(range(0, length(roman))) AS pos FROM query) q) x
  JOIN rev r ON r.chunk = substr(x.roman, (x.pos + 1)::INT, x.len::INT)),
beam(roman, spot, path, emit, lm, score, n) AS (
  SELECT roman, 0::BIGINT, []::VARCHAR[], 0e0, 0e0, 0e0, 0 FROM query
  UNION ALL
  SELECT roman, spot, path, emit, lm, score, n FROM (
    SELECT *, row_number() OVER (PARTITION BY roman ORDER BY score, path, spot, emit, lm) AS place FROM (
      SELECT *, emit + lm AS score FROM (
        SELECT s.roman, e.upto AS spot, list_append(s.path, e.a) AS path, s.emit + e.w AS emit, s.n + 1 AS n,
          s.lm + CASE WHEN s.n = 0 THEN coalesce(st.w, 12e0) WHEN u.u IS NULL OR b.b IS NULL THEN 15e0
            WHEN s.n = 1 THEN least(coalesce(two.w, b.b + u.u), 25e0)
            ELSE least(coalesce(three.w, coalesce(tb.w, 0e0) + coalesce(two.w, b.b + u.u)), 30e0) END AS lm
        FROM beam s JOIN edges e ON e.roman = s.roman AND e.pos = s.spot LEFT JOIN wstart st ON st.a = e.a LEFT JOIN w1 u ON u.a = e.a
        LEFT JOIN w1 b ON b.a = s.path[s.n] LEFT JOIN w2 two ON two.a = s.path[s.n] AND two.b = e.a
        LEFT JOIN w4 tb ON tb.a = s.path[s.n - 1] AND tb.b = s.path[s.n] LEFT JOIN w3 three ON three.a = s.path[s.n - 1] AND three.b = s.path[s.n] AND three.c = e.a
        WHERE s.n < 31) x
      QUALIFY row_number() OVER (PARTITION BY roman, path, spot ORDER BY score) = 1) y) z WHERE place <= {beam}),
ended AS (SELECT roman, array_to_string(path, '') AS dev, path, emit, lm, score, n FROM beam WHERE n > 0 AND spot = length(roman)),
found AS MATERIALIZED (SELECT roman, dev, emit, lm, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY roman ORDER BY score, dev, emit, lm, n) AS rank
  FROM (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY roman, dev ORDER BY score, n, path) = 1) x) y WHERE rank <= {keep})"""


_TRAINED = (*_SEEDED, *rounds(12), _LM)
_RERANKED = "ranked AS (SELECT roman, dev, 0e0 - emit - lm AS rscore, rank FROM found)"


def _suggested(count: int, boost: str = "") -> list[str]:
    """Tables up to suggested (roman, rank, dev, score)."""
    add = f" + coalesce((SELECT max(boost) FROM {boost} b WHERE b.dev = e.dev), 0)" if boost else ""
    return [
        _beam("emission12", 64, 4 * count),
        _RERANKED,
        _REWRITES,
        _near("(SELECT variant AS roman FROM spelt) x", "typo"),
        f"""
starts AS (SELECT roman, dev, 180 + frequency AS score FROM (
  SELECT f.roman, f.variant, l.dev, l.frequency, row_number() OVER (PARTITION BY f.roman, f.variant ORDER BY l.frequency DESC, l.dev) AS r
  FROM spelt f JOIN (SELECT DISTINCT prefix, dev, frequency FROM learned_prefixes) l ON l.prefix = f.variant) x WHERE r <= {3 * count}),
evidence AS (SELECT roman, dev, greatest(1, round(800 / (1 + greatest(0e0, -rscore))))::BIGINT AS score FROM ranked
  UNION ALL SELECT f.roman, c.dev, greatest(0, 300 - penalty) FROM spelt f JOIN corpus c ON c.roman = lower(f.variant)
  UNION ALL SELECT roman, dev, score FROM starts
  UNION ALL SELECT f.roman, t.dev, greatest(0, 50 - 12 * t.distance) FROM spelt f JOIN typo t ON t.roman = f.variant),
fused AS (SELECT roman, dev, max(score) AS score FROM evidence GROUP BY roman, dev),
suggested AS (SELECT roman, rank, dev, score FROM (SELECT *, row_number() OVER (PARTITION BY roman ORDER BY score DESC, dev) AS rank FROM (SELECT roman, dev, score{add} AS score FROM fused e) x) y WHERE rank <= {count})""",
    ]


#: Cases: queries that the corpus has, with their word and the first language that has them.
_CASES = """
spoken AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS roman, lang FROM documents),
langs AS (SELECT roman, min(lang) AS source FROM spoken GROUP BY roman),
cases AS (SELECT q.roman, c.dev, l.source FROM query q JOIN corpus c ON q.roman = c.roman JOIN langs l ON q.roman = l.roman)"""
_OUTCOMES = """
hits AS (SELECT c.roman, c.source, min(r.rank) AS r FROM cases c LEFT JOIN suggested r ON c.roman = r.roman AND c.dev = r.dev GROUP BY c.roman, c.source),
o AS (SELECT roman, source, coalesce((r <= 1)::INT, 0) AS top1, coalesce((r <= 5)::INT, 0) AS top5, coalesce((r <= 10)::INT, 0) AS top10, coalesce(1.0e0 / r, 0e0) AS rr FROM hits)"""
#: What is asked of outcomes o.
OUTCOME_SQL = {
    "hits": "SELECT roman, source, top1, top5, top10, round(rr, 6) AS rr FROM o",
    "rollup": "SELECT source, count(*) AS total, sum(top1) AS top1, sum(top5) AS top5, sum(top10) AS top10, round(avg(rr), 6) AS mrr FROM o GROUP BY ROLLUP (source)",
    "mrr": "SELECT count(*) AS total, round(avg(top1), 6) AS top1, round(avg(top5), 6) AS top5, round(avg(top10), 6) AS top10, round(avg(rr), 6) AS mrr FROM o",
    "percentile_ci": "SELECT source, round(quantile_cont(rr, 0.025), 6) AS low, round(quantile_cont(rr, 0.5), 6) AS middle, round(quantile_cont(rr, 0.975), 6) AS high FROM o GROUP BY source",
}
_KNOWN = "judged AS (SELECT f.roman, f.dev = c.dev AS hit, f.rank, -f.emit AS f1, -f.lm AS f2, -f.n::DOUBLE AS f3, (f.dev = c.dev)::INT::DOUBLE AS f4 FROM found f JOIN corpus c ON c.roman = f.roman)"


def _ascent(grids: list[list[float]], passes: int = 6) -> list[str]:
    """Tables best0, best1, ...: weights and their hits after each coordinate of each pass, from all ones."""
    names = ["a", "b", "c", "d"]
    score = "0e0 + a * f1 + b * f2 + c * f3 + d * f4"
    best = f"SELECT i, sum(hit::INT) AS h FROM (SELECT i, hit, row_number() OVER (PARTITION BY i, roman ORDER BY {score} DESC, rank) AS place FROM judged, {{tried}} t) x WHERE place = 1 GROUP BY i"
    parts = ["best0 AS MATERIALIZED (SELECT 1e0 AS a, 1e0 AS b, 1e0 AS c, 1e0 AS d, (SELECT h FROM (" + best.format(tried="(SELECT 0 AS i, 1e0 AS a, 1e0 AS b, 1e0 AS c, 1e0 AS d)") + ") y) AS hits)"]
    for step in range(passes * len(grids)):
        k = step % len(grids)
        values = ", ".join(f"({i}, {x}e0)" for i, x in enumerate(grids[k]))
        new = ", ".join("g.x AS " + n if j == k else "w." + n for j, n in enumerate(names))
        parts.append(f"t{step} AS MATERIALIZED (SELECT g.i, {new}, w.hits FROM best{step} w, (VALUES {values}) g(i, x))")
        parts.append(f"h{step} AS MATERIALIZED ({best.format(tried=f't{step}')})")
        won = f"(SELECT min(i) FROM h{step} WHERE h = (SELECT max(h) FROM h{step}) AND h > (SELECT hits FROM best{step}))"
        parts.append(f"best{step + 1} AS MATERIALIZED (SELECT a, b, c, d, (SELECT h FROM h{step} WHERE h{step}.i = t.i) AS hits FROM t{step} t WHERE i = {won} UNION ALL SELECT a, b, c, d, hits FROM best{step} WHERE {won} IS NULL)")
    return parts


_ENGINE = ["corpus", "segs", "query", "confirm", "learned_prefixes"]
_BOOST = """
said AS (SELECT dev, lag(dev) OVER (PARTITION BY uid ORDER BY turn, pos) AS prev FROM confirm),
boosted AS (SELECT dev, floor(log2(count(*)) * 10)::BIGINT AS boost FROM said WHERE prev = (SELECT arg_max(dev, row(uid, turn, pos)) FROM confirm) GROUP BY dev)"""

ALIGN_ORACLES = {
    "align_cost": _with(["corpus"], _CLEAN) + "SELECT roman, dev, round(CASE WHEN m <= n THEN m + 1.5e0 * (n - m) WHEN m <= 2 * n THEN n + 0.3e0 * (m - n) ELSE 1.3e0 * n + 1.5e0 * (m - 2 * n) END, 6) AS cost FROM (SELECT roman, dev, length(roman) AS m, length(dev) AS n FROM clean) x",
    "align_pairs": _with(["corpus"], _CLEAN, _ALIGN, _PARTS) + "SELECT roman, dev, array_to_string(parts, '|') AS parts FROM parts",
    "seed_counts": _with(["corpus"], *_SEEDED) + "SELECT a, chunk, n FROM seed",
    "seed_emissions": _with(["corpus"], *_SEEDED) + "SELECT a, chunk, round(p, 6) AS p FROM emission",
    "top_emissions": _with(["corpus"], *_SEEDED) + "SELECT a, chunk, round(-ln(p), 6) AS w, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY p DESC, chunk) AS rank FROM emission) x WHERE rank <= 5",
    "reverse_index": _with(["corpus"], *_SEEDED, _REVERSE) + "SELECT chunk, a, round(w, 6) AS w, rank FROM rev",
    "lattice_edges": _with(["corpus", "query"], *_SEEDED, _REVERSE) + """SELECT x.roman, x.pos, x.len, r.a, round(r.w, 6) AS w FROM (
  SELECT roman, pos, unnest(range(1, least(5, length(roman) - pos) + 1)) AS len FROM (SELECT roman, unnest(range(0, length(roman))) AS pos FROM query) q) x
  JOIN rev r ON r.chunk = substr(x.roman, (x.pos + 1)::INT, x.len::INT)""",
    "em_forward_z": _with(["corpus"], *_SEEDED, _PASSES) + "SELECT roman, dev, round(ln(z), 6) AS log_z FROM total",
    "em_expected_counts": _with(["corpus"], *_SEEDED, _PASSES, _COUNTS) + "SELECT a, chunk, round(c, 6) AS c FROM used",
    "em_m_step": _with(["corpus"], *_SEEDED, _PASSES, _COUNTS) + """SELECT u.a, u.chunk, round((u.c + 0.05e0 * pr.q) / (t.t + 0.05e0), 6) AS p FROM used u JOIN (SELECT a, sum(c) AS t FROM used GROUP BY a) t ON u.a = t.a
  JOIN (SELECT chunk, sum(n) / (SELECT sum(n)::DOUBLE FROM seed) AS q FROM seed GROUP BY chunk) pr ON pr.chunk = u.chunk
UNION ALL SELECT a, chunk, round(p, 6) FROM emission WHERE a NOT IN (SELECT a FROM used)""",
    "em_train": _with(["corpus"], *_SEEDED, *rounds(12)) + "SELECT a, chunk, round(p, 6) AS p FROM emission12",
    "em_limited": _with(["corpus"], _CLEAN.replace("clean AS (", "taken AS (") + ",\nclean AS (SELECT * FROM taken ORDER BY roman, dev LIMIT 5000)", _ALIGN, _PARTS, _SEEDS, *rounds(4)) + "SELECT a, chunk, round(p, 6) AS p FROM emission4",
    "roman_variants": _with(["query"], _REWRITES) + "SELECT roman, variant, penalty, rank FROM spelt",
    "beam_decode": _with(["corpus", "segs", "query"], *_TRAINED, _beam("emission12", 64, 8)) + "SELECT roman, dev, round(emit, 6) AS emit, round(lm, 6) AS lm, n AS syllables, rank FROM found",
    "rerank_kbest": _with(["corpus", "segs", "query"], *_TRAINED, _beam("emission12", 64, 32), _RERANKED) + "SELECT roman, dev, round(rscore, 6) AS rscore, row_number() OVER (PARTITION BY roman ORDER BY rscore DESC, rank) AS rank FROM ranked",
    "suggest": _with(_ENGINE, *_TRAINED, *_suggested(8)) + "SELECT roman, rank, dev, score FROM suggested",
    "suggest_context": _with(_ENGINE, *_TRAINED, _BOOST, *_suggested(8, "boosted")) + "SELECT roman, rank, dev, score FROM suggested",
    "suggest_json": _with(_ENGINE, *_TRAINED, *_suggested(8)) + "SELECT roman, to_json(list(dev ORDER BY rank))::VARCHAR AS suggestions FROM suggested GROUP BY roman",
    "model_summary": _with(["corpus", "segs"], *_SEEDED) + """SELECT 'syllables' AS name, count(DISTINCT a) AS value FROM segs UNION ALL SELECT 'emissions', count(*) FROM seed
UNION ALL SELECT 'most_emissions', max(n) FROM (SELECT count(*) AS n FROM seed GROUP BY a) x
UNION ALL SELECT 'bigrams', count(*) FROM (SELECT DISTINCT a, b FROM segs WHERE b IS NOT NULL) x
UNION ALL SELECT 'trigrams', count(*) FROM (SELECT DISTINCT a, b, c FROM segs WHERE c IS NOT NULL) x
UNION ALL SELECT 'trigram_contexts', count(*) FROM (SELECT DISTINCT a, b FROM segs WHERE c IS NOT NULL) x""",
}


def bootstrap_sql(outcomes: str, resamples: int = 1000, seed: int = 42) -> str:
    """``outcomes``: SQL up to a table expression o (roman, top1, top5, top10, rr)."""
    top = "18446744073709551616::UHUGEINT"
    x = f"(({seed}::UHUGEINT + (i + 2)::UHUGEINT * 11400714819323198485::UHUGEINT) % {top})"
    for shift, by in ((30, 13787848793156543929), (27, 10723151780598845931)):
        x = f"((xor({x}, {x} // {1 << shift}::UHUGEINT) * {by}::UHUGEINT) % {top})"
    metrics = "UNION ALL ".join(f"SELECT '{m}' AS metric, round(quantile_cont({m}, 0.025), 6) AS low, round(quantile_cont({m}, 0.975), 6) AS high FROM means " for m in ("top1", "top5", "top10", "rr"))
    return outcomes + f""", placed AS (SELECT *, row_number() OVER (ORDER BY roman) - 1 AS place FROM o), size AS (SELECT count(*) AS n FROM o),
drawn AS (SELECT i // n AS r, (xor(x, x // {1 << 31}::UHUGEINT) % n::UHUGEINT)::BIGINT AS place FROM (SELECT i, n, {x} AS x FROM (SELECT unnest(range(0, {resamples} * n)) AS i, n FROM size) a) b),
means AS (SELECT r, avg(top1) AS top1, avg(top5) AS top5, avg(top10) AS top10, avg(rr) AS rr FROM drawn JOIN placed USING (place) GROUP BY r)
{metrics}"""

#: The ranker's 10 best as outcomes, and each question about them.
_RANKED = _with(_ENGINE, *_TRAINED, *_suggested(10), _CASES, _OUTCOMES)
ALIGN_ORACLES |= {f"suggest_{k}": _RANKED + v for k, v in OUTCOME_SQL.items()}
ALIGN_ORACLES["suggest_misses"] = _RANKED + "SELECT case_id, roman, source FROM (SELECT *, row_number() OVER (ORDER BY roman) AS case_id FROM o) x WHERE top1 = 0 ORDER BY case_id LIMIT 20"
ALIGN_ORACLES["emission_prob"] = _with(["corpus"], *_SEEDED) + """SELECT w.a, w.chunk, round(0e0 - ln(e.p), 6) AS w, round(coalesce(e.p, 0e0), 6) AS p
FROM (SELECT a, min(chunk) AS chunk FROM emission GROUP BY a UNION SELECT a, 'm' FROM emission) w LEFT JOIN emission e ON w.a = e.a AND w.chunk = e.chunk"""
ALIGN_ORACLES["widest_syllables"] = _with(["corpus"], *_SEEDED) + "SELECT a, count(*) AS n FROM emission GROUP BY a ORDER BY n DESC, a LIMIT 10"
ALIGN_ORACLES["suggest_bootstrap_ci"] = bootstrap_sql(_RANKED.rstrip())
_SEARCHED = (["corpus", "segs", "query"], *_TRAINED, _beam("emission12", 128, 50), _KNOWN)


def search_sql(grids: list[list[float]]) -> dict[str, str]:
    """Of the decoder's 50 best: the weights that coordinate ascent finds, and how often the target is among the best."""
    recall = ", ".join(f"(SELECT count(*) FROM judged WHERE hit AND rank <= {k}) AS in_{k}" for k in (1, 5, 10, 50))
    last = 6 * len(grids)
    return {
        "mert_grid": _with(*_SEARCHED, *_ascent(grids)) + f"SELECT a AS w0, b AS w1, c AS w2, d AS w3, hits FROM best{last}",
        "kbest_recall": _with(*_SEARCHED) + f"SELECT (SELECT count(*) FROM query q JOIN corpus c ON q.roman = c.roman) AS total, {recall}",
    }
