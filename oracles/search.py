"""Check SQL for populations, their evaluation and one step of each search method.

Everything is in long form: one row per run, fold, candidate and dimension, with joins
between candidates.
"""

from __future__ import annotations

import math

from .base import TFIDF
from .scores import BY_FOLD, FOLD_ENTRIES, FOLDS
from .text import kfold

SQL: dict[str, str] = {}
NP, SEED = 6, 123


def u(*parts: str) -> str:
    """Uniform number keyed by SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


def nrm(*parts: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {u(*parts, q1)})) * cos(2.0 * pi() * {u(*parts, q2)}))"


q1, q2 = "'n1'", "'n2'"
CIDS = f"cids AS (SELECT unnest(range({NP})) AS cid)"


def population(runs: int) -> str:
    return f"""dims AS (SELECT idx AS dim, term FROM vocab UNION ALL SELECT count(*), NULL FROM vocab),
{CIDS},
pop AS MATERIALIZED (SELECT r.run, f.fold, c.cid, d.dim, d.term, {u(f'r.run + {SEED + 1}', 'c.cid', 'd.dim')} AS x
  FROM dims d, cids c, (SELECT unnest(range({runs})) AS run) r, (SELECT unnest(range(2)) AS fold) f)"""


LONG = "run::INT AS run, fold::INT AS fold, cid::INT AS cid, dim::INT AS dim"
INIT = ["WITH " + TFIDF]


def masks(pop: str, name: str) -> str:
    # The few threshold rows are picked first: a join of the population with itself is filtered too late without an optimizer.
    return f"""{name}_cut AS MATERIALIZED (SELECT run, fold, cid, x AS cut FROM {pop} WHERE term IS NULL),
{name} AS (SELECT g.run, g.fold, g.cid, g.dim, g.term, g.x >= t.cut AS keep
  FROM {pop} g JOIN {name}_cut t USING (run, fold, cid) WHERE g.term IS NOT NULL)"""


BASE = "WITH " + TFIDF + ",\n"
SQL["init_population"] = BASE + population(2) + f"\nSELECT {LONG}, round(x, 6) AS x FROM pop"
SQL["decode_mask"] = BASE + population(1) + ",\n" + masks("pop", "m") + \
    "\nSELECT p.run::INT AS run, p.fold::INT AS fold, p.cid::INT AS cid, p.dim::INT AS dim, (p.x >= 0.7)::INT AS keep07, coalesce(m.keep::INT, -1) AS keep FROM pop p LEFT JOIN m USING (run, fold, cid, dim)"
SQL["digitize_genes"] = BASE + population(1) + f"\nSELECT {LONG}, (x >= 0.5)::INT AS bit FROM pop"
SQL["mask_to_indices"] = BASE + population(1) + f"\nSELECT {LONG} FROM pop WHERE x >= 0.5"

# ---------------------------------------------------------------- evaluation
INNER = BASE + ",\n".join([
    kfold(2, SEED), "folds AS (SELECT doc_id, label, fold FROM docs JOIN inner_folds USING (doc_id))", FOLDS,
    BY_FOLD.replace("count(*) AS n FROM weights", "sum(w * w) AS q FROM weights"), FOLD_ENTRIES, population(1)])


def f1_of(preds: str, mask: str, fit: str) -> str:
    return f"""{fit}_seen AS (SELECT run, fold, cid, y AS label FROM {preds} UNION SELECT run, fold, cid, p FROM {preds}),
{fit}_lab AS (SELECT l.run, l.fold, l.cid, l.label, count(*) FILTER (WHERE y = l.label) AS support,
  2 * count(*) FILTER (WHERE y = l.label AND p = l.label) / count(*) FILTER (WHERE y = l.label OR p = l.label
    )::DOUBLE AS jac, count(*) FILTER (WHERE y = l.label AND p = l.label) AS tp, count(*) FILTER (WHERE p = l.label) AS predicted
  FROM {fit}_seen l JOIN {preds} USING (run, fold, cid) GROUP BY ALL),
{fit}_used AS (SELECT run, fold, cid, count(*) FILTER (WHERE keep) AS n FROM {mask} GROUP BY ALL),
{fit} AS (SELECT run, fold, cid, CASE WHEN any_value(n) = 0 THEN 'inf'::DOUBLE
  ELSE 1 - sum(2 * tp / (support + predicted) * support) / sum(support) END AS fitness
  FROM {fit}_lab JOIN {fit}_used USING (run, fold, cid) GROUP BY run, fold, cid)"""


def evaluate(pop: str, fit: str) -> str:
    """`fit`(run, fold, cid, fitness) of a population by multinomial models."""
    m = f"{fit}_m"
    return f"""{masks(pop, m)},
{fit}_v AS (SELECT run, fold, cid, count(*) FILTER (WHERE keep) AS v FROM {m} GROUP BY ALL),
{fit}_tot AS (SELECT m.run, m.fold, m.cid, o.label, sum(o.o) AS s FROM {m} m JOIN observed o ON o.fold = m.fold AND o.term = m.term
  WHERE m.keep GROUP BY ALL),
{fit}_cls AS (SELECT v.run, v.fold, v.cid, c.label, ln(c.n_label / c.n_docs::DOUBLE) AS prior, coalesce(t.s, 0) + v.v AS denom
  FROM {fit}_v v JOIN classes c ON c.fold = v.fold
  LEFT JOIN {fit}_tot t ON t.run = v.run AND t.fold = v.fold AND t.cid = v.cid AND t.label = c.label),
{fit}_w AS (SELECT m.run, m.fold, m.cid, e.doc_id, sum(e.w) AS w FROM {m} m JOIN fold_entries e ON e.fold = m.fold AND e.term = m.term
  WHERE m.keep GROUP BY ALL),
{fit}_a AS (SELECT m.run, m.fold, m.cid, e.doc_id, o.label, sum(e.w * ln(o.o + 1)) AS a FROM {m} m
  JOIN fold_entries e ON e.fold = m.fold AND e.term = m.term JOIN observed o ON o.fold = m.fold AND o.term = m.term
  WHERE m.keep GROUP BY ALL),
{fit}_p AS (SELECT c.run, c.fold, c.cid, d.doc_id, d.label AS y,
  arg_min(c.label, (-round(c.prior + coalesce(a.a, 0) - coalesce(w.w * ln(c.denom), 0), 6), c.label)) AS p
  FROM {fit}_cls c JOIN folds d ON d.fold = c.fold
  LEFT JOIN {fit}_w w ON w.run = c.run AND w.fold = c.fold AND w.cid = c.cid AND w.doc_id = d.doc_id
  LEFT JOIN {fit}_a a ON a.run = c.run AND a.fold = c.fold AND a.cid = c.cid AND a.doc_id = d.doc_id AND a.label = c.label
  GROUP BY ALL),
{f1_of(f'{fit}_p', m, fit)}"""


EVAL = INNER + ",\n" + evaluate("pop", "fit")
FIT = "run::INT AS run, fold::INT AS fold, cid::INT AS cid, round(fitness, 6) AS fitness"
SQL["evaluate_population"] = EVAL + f"\nSELECT {FIT} FROM fit"
SQL["evaluate_population_gaussian"] = INNER + ",\n" + masks("pop", "m") + """,
kept AS (SELECT * FROM m WHERE keep),
term_var AS (SELECT o.fold, o.term, sum(o.q) / any_value(c.n) - (sum(o.o) / any_value(c.n)) * (sum(o.o) / any_value(c.n)) AS v
  FROM observed o JOIN (SELECT fold, sum(n_label)::DOUBLE AS n FROM classes GROUP BY fold) c USING (fold) GROUP BY o.fold, o.term),
eps AS (SELECT k.run, k.fold, k.cid, 1e-9 * max(t.v) AS eps FROM kept k JOIN term_var t ON t.fold = k.fold AND t.term = k.term GROUP BY ALL),
stats AS (SELECT k.run, k.fold, k.cid, k.term, c.label, coalesce(o.o, 0) / c.n_label AS mu,
  greatest(coalesce(o.q, 0) / c.n_label - (coalesce(o.o, 0) / c.n_label) * (coalesce(o.o, 0) / c.n_label), 0) + e.eps AS var
  FROM kept k JOIN eps e USING (run, fold, cid) JOIN classes c ON c.fold = k.fold
  LEFT JOIN observed o ON o.fold = k.fold AND o.term = k.term AND o.label = c.label),
bases AS (SELECT run, fold, cid, label, sum(-0.5 * ln(2 * pi() * var) - mu * mu / (2 * var)) AS base FROM stats GROUP BY ALL),
shifts AS (SELECT s.run, s.fold, s.cid, e.doc_id, s.label, sum((2 * e.w * s.mu - e.w * e.w) / (2 * s.var)) AS a
  FROM fold_entries e JOIN stats s ON s.fold = e.fold AND s.term = e.term GROUP BY ALL),
preds AS (SELECT b.run, b.fold, b.cid, d.doc_id, d.label AS y,
  arg_min(c.label, (-round(ln(c.n_label / c.n_docs::DOUBLE) + b.base + coalesce(a.a, 0), 6), c.label)) AS p
  FROM bases b JOIN classes c ON c.fold = b.fold AND c.label = b.label JOIN folds d ON d.fold = b.fold
  LEFT JOIN shifts a ON a.run = b.run AND a.fold = b.fold AND a.cid = b.cid AND a.doc_id = d.doc_id AND a.label = b.label GROUP BY ALL),
""" + f1_of("preds", "m", "fit") + f"\nSELECT {FIT} FROM fit"
SQL["evaluate_regression"] = """WITH m AS (SELECT lang, avg(n_chars) AS yhat FROM documents GROUP BY lang)
SELECT source AS fold, 0 AS cid, round(avg((n_chars - yhat) * (n_chars - yhat)), 3) AS fitness
FROM documents JOIN m USING (lang) GROUP BY source"""
# Three runs; the best candidate of each run and fold is its result.
RUNS = EVAL.replace(population(1), population(3)) + """,
won AS (SELECT run, fold, cid, fitness FROM fit QUALIFY row_number() OVER (PARTITION BY run, fold ORDER BY round(fitness, 9), cid) = 1)"""
SQL["fan_out_runs"] = RUNS + "\nSELECT run::INT AS run, fold::INT AS fold, round(fitness, 6) AS fitness FROM won"
TOP = "best AS (SELECT fold, run, cid, fitness FROM won QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(fitness, 9), run) = 1)"
SQL["best_per_fold"] = RUNS + f",\n{TOP}\nSELECT run::INT AS run, fold::INT AS fold, round(fitness, 6) AS fitness FROM best"
VOTES = RUNS + f",\n{TOP},\nvotes AS (SELECT dim::INT AS dim, term, min(keep::INT) AS score FROM fit_m JOIN best USING (run, fold, cid) GROUP BY ALL)"
SQL["vote_features"] = VOTES + "\nSELECT dim, term, score FROM votes"
SQL["ensure_nonempty"] = VOTES + """
SELECT dim, term, CASE WHEN (SELECT sum(score) FROM votes) = 0 AND dim = 0 THEN 1 ELSE score END::INT AS score,
  CASE WHEN dim = 0 THEN 1 ELSE 0 END::INT AS score_if_empty FROM votes"""
SQL["support_mask"] = VOTES + "\nSELECT dim, term FROM votes WHERE score = 1"

# A grey wolf search evaluates its population once per generation, a bee colony twice.
SQL["search"] = EVAL + """,
first AS (SELECT run, fold, min(fitness) AS f FROM fit GROUP BY run, fold)
SELECT method, generation::INT AS generation, run::INT AS run, fold::INT AS fold, round(f, 6) AS first_best, true AS no_worse
FROM first, (VALUES ('gwo', 0), ('gwo', 1), ('gwo', 2), ('abc', 0), ('abc', 1)) t(method, generation)"""

# ---------------------------------------------------------------- steps
RANKS = "ranks AS (SELECT run, fold, cid, fitness, row_number() OVER (PARTITION BY run, fold ORDER BY round(fitness, 9), cid) AS rank FROM fit)"
STEP = EVAL + ",\n" + RANKS + ",\n"
S = f"g.run + {SEED + 1}"


def d(*tag: str, gen: int = 1) -> str:
    """Draw keyed by candidate."""
    return u(S, f"{gen}", "g.cid", *tag)


def dd(*tag: str, gen: int = 1) -> str:
    """Draw keyed by candidate and dimension."""
    return u(S, f"{gen}", "g.cid", "g.dim", *tag)


def t(tag: str) -> str:
    return f"'{tag}'"


def clip(x: str) -> str:
    return f"least(greatest({x}, 0.0), 1.0)"


def out(source: str, x: str = "x", extra: str = "") -> str:
    return f"\nSELECT {LONG}, round({x}, 6) AS x{extra} FROM {source}"


BEST = "lead AS (SELECT p.run, p.fold, p.dim, p.x, r.rank, r.cid FROM pop p JOIN ranks r USING (run, fold, cid))"
_SELF = "pop g"


def _tournament(tag: str) -> str:
    draws = " UNION ALL ".join(
        f"SELECT g.run, g.fold, g.cid, floor({u(S, '1', 'g.cid', t(f'{tag}{i}'))} * {NP})::INT AS pick FROM ranks g" for i in range(4))
    return f"""par_{tag} AS (SELECT x.run, x.fold, x.cid, arg_min(x.pick, r.rank) AS par FROM ({draws}) x
  JOIN ranks r ON r.run = x.run AND r.fold = x.fold AND r.cid = x.pick GROUP BY ALL)"""


SQL["step_ga"] = STEP + f"""{_tournament('a')}, {_tournament('b')},
moved AS (SELECT g.run, g.fold, g.cid, g.dim, CASE WHEN k.rank = 1 THEN g.x WHEN {dd(t('m'))} < 0.25 THEN {dd(t('v'))}
  WHEN {dd(t('c'))} < 0.25 THEN xb.x ELSE xa.x END AS x
  FROM pop g JOIN ranks k USING (run, fold, cid) JOIN par_a a USING (run, fold, cid) JOIN par_b b USING (run, fold, cid)
  JOIN pop xa ON xa.run = g.run AND xa.fold = g.fold AND xa.dim = g.dim AND xa.cid = a.par
  JOIN pop xb ON xb.run = g.run AND xb.fold = g.fold AND xb.dim = g.dim AND xb.cid = b.par)""" + out("moved")
SQL["step_gwo"] = STEP + f"""{BEST}, moved AS (SELECT g.run, g.fold, g.cid, g.dim, {clip(f'''avg(l.x - (2.0 * 1.95::DOUBLE *
  {u(S, '1', 'g.cid', 'g.dim', "'a' || (l.rank - 1)")} - 1.95) * abs(2.0 * {u(S, '1', 'g.cid', 'g.dim', "'c' || (l.rank - 1)")} * l.x - g.x))''')} AS x
  FROM pop g JOIN lead l ON l.run = g.run AND l.fold = g.fold AND l.dim = g.dim AND l.rank <= 3
  GROUP BY g.run, g.fold, g.cid, g.dim)""" + out("moved")
_R1 = 3.0 - 3.0 / 40
SQL["step_sca"] = STEP + f"""{BEST}, moved AS (SELECT g.run, g.fold, g.cid, g.dim, {clip(f'''g.x + {_R1}::DOUBLE *
  CASE WHEN {dd(t('r4'))} < 0.5 THEN sin(2 * pi() * {dd(t('r2'))}) ELSE cos(2 * pi() * {dd(t('r2'))}) END
  * abs(2.0 * {dd(t('r3'))} * l.x - g.x)''')} AS x
  FROM pop g JOIN lead l ON l.run = g.run AND l.fold = g.fold AND l.dim = g.dim AND l.rank = 1)""" + out("moved")

_N = "(SELECT count(*) FROM dims)"


def _bees(phase: str, source: str) -> str:
    p = phase[0]
    return f"""{phase}_plan AS (SELECT g.run, g.fold, g.cid, {source} AS src, floor({d(t(p + 'j'))} * {_N}) AS j,
  2.0 * {d(t(p + 'phi'))} - 1.0 AS phi, floor({d(t(p + 'k'))} * {NP - 1}) AS off FROM ranks g),
{phase} AS (SELECT b.run, b.fold, b.cid, s.dim, CASE WHEN b.j = s.dim THEN {clip('s.x + b.phi * (s.x - o.x)')} ELSE s.x END AS x
  FROM {phase}_plan b JOIN pop s ON s.run = b.run AND s.fold = b.fold AND s.cid = b.src
  JOIN pop o ON o.run = b.run AND o.fold = b.fold AND o.dim = s.dim AND o.cid = (b.src + 1 + b.off) % {NP})"""


SQL["step_abc"] = STEP + f"""shares AS (SELECT run, fold, cid, sum(1 / (1 + fitness)) OVER (PARTITION BY run, fold ORDER BY cid) AS hi,
  sum(1 / (1 + fitness)) OVER (PARTITION BY run, fold) AS total FROM ranks),
{_bees('employed', 'g.cid')},
{_bees('onlooker', f"(SELECT count(*) FROM shares h WHERE h.run = g.run AND h.fold = g.fold AND h.hi < {d(t('os'))} * h.total)")},
scout AS (SELECT g.run, g.fold, g.cid, g.dim, CASE WHEN k.rank = {NP} THEN {dd(t('new'))} ELSE g.x END AS x
  FROM pop g JOIN ranks k USING (run, fold, cid)),
moved AS (SELECT *, 'employed' AS phase FROM employed UNION ALL SELECT *, 'onlooker' FROM onlooker UNION ALL SELECT *, 'scout' FROM scout)""" + \
    out("moved", extra=", phase")


def _greedy(moved: str, allowed: str = "true", forced: str = "false") -> str:
    """Evaluate trial genes and keep the better of both."""
    return STEP + moved + f""",
trial AS (SELECT m.*, p.term FROM moved m JOIN (SELECT DISTINCT dim, term FROM dims) p USING (dim)),
{evaluate('trial', 'tfit')},
won AS (SELECT g.run, g.fold, g.cid, (({allowed}) AND round(n.fitness, 9) <= round(g.fitness, 9)) OR ({forced}) AS won
  FROM ranks g JOIN tfit n USING (run, fold, cid)),
kept AS (SELECT g.run, g.fold, g.cid, g.dim, CASE WHEN w.won THEN m.x ELSE g.x END AS x
  FROM pop g JOIN moved m USING (run, fold, cid, dim) JOIN won w USING (run, fold, cid))""" + out("kept")


SQL["step_bat"] = _greedy(f"""{BEST}, moved AS (SELECT g.run, g.fold, g.cid, g.dim,
  CASE WHEN {d(t('r'))} > 0.5 THEN {clip(f"l.x + 0.001::DOUBLE * {nrm(S, '1', 'g.cid', 'g.dim')}")}
  ELSE {clip(f"g.x + (g.x - l.x) * 2.0 * {d(t('q'))}")} END AS x
  FROM pop g JOIN lead l ON l.run = g.run AND l.fold = g.fold AND l.dim = g.dim AND l.rank = 1)""", f"{d(t('A'))} < 0.5")


def _levy() -> float:
    b = 1.5
    return (math.gamma(1 + b) * math.sin(math.pi * b / 2) / (math.gamma((1 + b) / 2) * b * 2 ** ((b - 1) / 2))) ** (1 / b)


SQL["step_cuckoo"] = _greedy(f"""{BEST}, moved AS (SELECT g.run, g.fold, g.cid, g.dim,
  CASE WHEN k.rank > {NP - int(0.2 * NP)} THEN {dd(t('new'))} ELSE {clip(f'''g.x + 0.01::DOUBLE * {_levy()!r}::DOUBLE *
  {nrm(S, '1', 'g.cid', 'g.dim', t('u'))} / pow(abs({nrm(S, '1', 'g.cid', 'g.dim', t('v'))}), {1 / 1.5!r}::DOUBLE) * (g.x - l.x)''')} END AS x
  FROM pop g JOIN ranks k USING (run, fold, cid)
  JOIN lead l ON l.run = g.run AND l.fold = g.fold AND l.dim = g.dim AND l.rank = 1)""", forced=f"g.rank > {NP - int(0.2 * NP)}")
# Offsets without replacement: the n-th number among those not drawn yet.
SQL["step_de"] = _greedy(f"""draws AS (SELECT g.run, g.fold, g.cid, floor({d(t('a'))} * {NP - 1})::INT AS da,
  floor({d(t('b'))} * {NP - 2})::INT AS db, floor({d(t('c'))} * {NP - 3})::INT AS dc, floor({d(t('j'))} * {_N}) AS j FROM ranks g),
o1 AS (SELECT *, da + 1 AS a FROM draws),
o2 AS (SELECT *, (list_filter(range(1, {NP}), lambda v: v <> a))[db + 1] AS b FROM o1),
o3 AS (SELECT *, (list_filter(range(1, {NP}), lambda v: v <> a AND v <> b))[dc + 1] AS c FROM o2),
moved AS (SELECT g.run, g.fold, g.cid, g.dim, CASE WHEN {dd(t('cr'))} < 0.8 OR o.j = g.dim
  THEN {clip('xa.x + 0.5 * (xb.x - xc.x)')} ELSE g.x END AS x
  FROM pop g JOIN o3 o USING (run, fold, cid)
  JOIN pop xa ON xa.run = g.run AND xa.fold = g.fold AND xa.dim = g.dim AND xa.cid = (g.cid + o.a) % {NP}
  JOIN pop xb ON xb.run = g.run AND xb.fold = g.fold AND xb.dim = g.dim AND xb.cid = (g.cid + o.b) % {NP}
  JOIN pop xc ON xc.run = g.run AND xc.fold = g.fold AND xc.dim = g.dim AND xc.cid = (g.cid + o.c) % {NP})""")
SQL["step_harmony"] = STEP + f"""moved AS (SELECT g.run, g.fold, g.cid, g.dim, CASE WHEN {dd(t('h'))} >= 0.7 THEN {dd(t('new'))}
  WHEN {dd(t('p'))} < 0.35 THEN {clip(f"o.x + 0.1::DOUBLE * (2.0 * {dd(t('w'))} - 1.0)")} ELSE o.x END AS x
  FROM pop g JOIN pop o ON o.run = g.run AND o.fold = g.fold AND o.dim = g.dim AND o.cid = floor({dd(t('i'))} * {NP})),
trial AS (SELECT m.*, p.term FROM moved m JOIN (SELECT DISTINCT dim, term FROM dims) p USING (dim)),
{evaluate('trial', 'tfit')},
everyone AS (SELECT run, fold, cid, fitness FROM fit UNION ALL SELECT run, fold, cid + {NP}, fitness FROM tfit),
kept AS (SELECT run, fold, cid AS old, row_number() OVER (PARTITION BY run, fold ORDER BY round(fitness, 9), cid) - 1 AS cid FROM everyone),
genes AS (SELECT run, fold, cid, dim, x FROM pop UNION ALL SELECT run, fold, cid + {NP}, dim, x FROM moved),
memory AS (SELECT k.run, k.fold, k.cid, g.dim, g.x FROM kept k JOIN genes g ON g.run = k.run AND g.fold = k.fold AND g.cid = k.old WHERE k.cid < {NP})""" + out("memory")


def _velocity(v: str, x: str, own: str, best: str, gen: int) -> str:
    raw = f"0.7 * {v} + 2.0 * {dd(t('r1'), gen=gen)} * ({own} - {x}) + 2.0 * {dd(t('r2'), gen=gen)} * ({best} - {x})"
    return f"least(greatest({raw}, -1.5), 1.5)"


SQL["step_pso"] = STEP + f"""{BEST}, one AS (SELECT g.run, g.fold, g.cid, g.dim, g.x AS old, {_velocity('0.0::DOUBLE', 'g.x', 'g.x', 'l.x', 1)} AS v
  FROM pop g JOIN lead l ON l.run = g.run AND l.fold = g.fold AND l.dim = g.dim AND l.rank = 1),
moved AS (SELECT run, fold, cid, dim, {clip('old + v')} AS x FROM one),
trial AS (SELECT m.*, p.term FROM moved m JOIN (SELECT DISTINCT dim, term FROM dims) p USING (dim)),
{evaluate('trial', 'tfit')},
own AS (SELECT g.run, g.fold, g.cid, round(n.fitness, 9) < round(g.fitness, 9) AS won, least(round(n.fitness, 9), round(g.fitness, 9)) AS f
  FROM ranks g JOIN tfit n USING (run, fold, cid)),
leader AS (SELECT run, fold, cid FROM own QUALIFY row_number() OVER (PARTITION BY run, fold ORDER BY f, cid) = 1),
state AS (SELECT m.run, m.fold, m.cid, m.dim, m.x, one.v, CASE WHEN w.won THEN m.x ELSE one.old END AS p
  FROM moved m JOIN one USING (run, fold, cid, dim) JOIN own w USING (run, fold, cid)),
two AS (SELECT g.run, g.fold, g.cid, g.dim, {clip('g.x + ' + _velocity('g.v', 'g.x', 'g.p', 'b.p', 2))} AS x
  FROM state g JOIN leader l ON l.run = g.run AND l.fold = g.fold
  JOIN state b ON b.run = g.run AND b.fold = g.fold AND b.dim = g.dim AND b.cid = l.cid)""" + out("two")
SQL["step_firefly"] = STEP + f"""pairs AS (SELECT a.run, a.fold, a.cid AS i, b.cid AS j, sum((a.x - b.x) * (a.x - b.x)) AS r2
  FROM pop a JOIN pop b ON a.run = b.run AND a.fold = b.fold AND a.dim = b.dim GROUP BY ALL),
pull AS (SELECT p.run, p.fold, p.i, p.j, 0.2::DOUBLE + 0.8::DOUBLE * exp(-p.r2) AS beta FROM pairs p
  JOIN ranks ri ON ri.run = p.run AND ri.fold = p.fold AND ri.cid = p.i
  JOIN ranks rj ON rj.run = p.run AND rj.fold = p.fold AND rj.cid = p.j WHERE rj.rank < ri.rank),
toward AS (SELECT g.run, g.fold, g.cid, g.dim, sum(p.beta * (o.x - g.x)) AS m FROM pop g
  JOIN pull p ON p.run = g.run AND p.fold = g.fold AND p.i = g.cid
  JOIN pop o ON o.run = g.run AND o.fold = g.fold AND o.dim = g.dim AND o.cid = p.j GROUP BY ALL),
moved AS (SELECT g.run, g.fold, g.cid, g.dim, {clip(f"g.x + coalesce(m.m, 0) + 0.5 * ({dd(t('e'))} - 0.5)")} AS x
  FROM pop g LEFT JOIN toward m ON m.run = g.run AND m.fold = g.fold AND m.cid = g.cid AND m.dim = g.dim)""" + out("moved")
