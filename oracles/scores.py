"""Check SQL for filter scores, selection, Naive Bayes and metrics.

Scores are computed over full term-by-class grids with explicit zeros.
"""

from __future__ import annotations

from .base import DOCS, SPLIT_DOCS, TFIDF, WEIGHTS, WORDS, vocabulary, with_
from .text import GRAM_COUNTS, GRAMS, HOLDOUT, LING, PLAIN, SHUFFLED, folds

SQL: dict[str, str] = {}

CLASSES = """classes AS (SELECT label, count(*) AS n_label, sum(count(*)) OVER () AS n_docs FROM docs GROUP BY label)"""
CHI2 = """observed AS (SELECT term, label, sum(w) AS o FROM weights GROUP BY ALL),
totals AS (SELECT term, sum(o) AS t FROM observed GROUP BY term),
grid AS (SELECT t.term, c.label, coalesce(o.o, 0) AS o, t.t * c.n_label / c.n_docs AS e
  FROM totals t CROSS JOIN classes c LEFT JOIN observed o ON o.term = t.term AND o.label = c.label),
scores AS (SELECT term, sum((o - e) * (o - e) / e) AS score FROM grid GROUP BY term)"""
SQL["chi2_scores"] = "WITH " + ",\n".join([TFIDF, CLASSES, CHI2]) + "\nSELECT term, round(score, 6) AS score FROM scores"

# Training sets by fold: every document belongs to the training set of each other fold.
FOLDS = "fold_ids AS (SELECT DISTINCT fold FROM folds)"
BY_FOLD = """trainset AS (SELECT f.fold, d.doc_id, d.label FROM folds d JOIN fold_ids f ON d.fold <> f.fold),
classes AS (SELECT fold, label, count(*) AS n_label, sum(count(*)) OVER (PARTITION BY fold) AS n_docs FROM trainset GROUP BY fold, label),
observed AS (SELECT t.fold, term, w.label, sum(w) AS o, count(*) AS n FROM weights w JOIN trainset t USING (doc_id) GROUP BY ALL)"""
FOLD_CHI2 = """totals AS (SELECT fold, term, sum(o) AS t FROM observed GROUP BY ALL),
grid AS (SELECT t.fold, t.term, c.label, coalesce(o.o, 0) AS o, t.t * c.n_label / c.n_docs AS e
  FROM totals t JOIN classes c ON c.fold = t.fold LEFT JOIN observed o ON o.fold = t.fold AND o.term = t.term AND o.label = c.label),
scores AS (SELECT fold, term, sum((o - e) * (o - e) / e) AS score FROM grid GROUP BY ALL)"""
FOLD_CORPUS = [TFIDF, folds(5, PLAIN), FOLDS, BY_FOLD]
SQL["chi2_scores_by_fold"] = "WITH " + ",\n".join([*FOLD_CORPUS, FOLD_CHI2]) + \
    "\nSELECT fold, term, round(score, 6) AS score FROM scores"

MI = """cells AS (SELECT v.term, c.label, c.n_label, c.n_docs::DOUBLE AS n, v.df, count(k.doc_id) AS hit
  FROM vocab v CROSS JOIN classes c LEFT JOIN counts k ON k.term = v.term AND k.label = c.label GROUP BY ALL),
parts AS (SELECT term,
  CASE WHEN hit > 0 THEN hit / n * ln(hit * n / (n_label * df::DOUBLE)) ELSE 0 END +
  CASE WHEN n_label > hit THEN (n_label - hit) / n * ln((n_label - hit) * n / (n_label * (n - df))) ELSE 0 END AS part
  FROM cells)"""
SQL["mutual_info_presence"] = with_(DOCS, WORDS, vocabulary(3), CLASSES, MI) + \
    "SELECT term, round(sum(part), 6) AS score FROM parts GROUP BY term"
SQL["mutual_info_binned"] = "WITH " + ",\n".join([TFIDF, CLASSES, """
binned AS (SELECT term, label, ntile(4) OVER (PARTITION BY term ORDER BY round(w, 9), doc_id) AS bin FROM weights),
present AS (SELECT term, label, bin, count(*) AS n FROM binned GROUP BY ALL),
absent AS (SELECT v.term, c.label, 0 AS bin, c.n_label - count(k.doc_id) AS n
  FROM vocab v CROSS JOIN classes c LEFT JOIN weights k ON k.term = v.term AND k.label = c.label GROUP BY v.term, c.label, c.n_label),
cells AS (SELECT * FROM present UNION ALL SELECT * FROM absent WHERE n > 0),
parts AS (SELECT term, x.n / c.n_docs::DOUBLE * ln(x.n * c.n_docs::DOUBLE /
  (c.n_label * (sum(x.n) OVER (PARTITION BY term, bin))::DOUBLE)) AS part FROM cells x JOIN classes c USING (label))"""]) + \
    "\nSELECT term, round(sum(part), 6) AS score FROM parts GROUP BY term"

# Every pair of points of a class, every pair of a term: third nearest by rank, points within counted one by one.
SQL["mutual_info_neighbors"] = "WITH " + ",\n".join([TFIDF, CLASSES, """
kept AS (SELECT label, n_label, (sum(n_label) OVER ())::BIGINT AS n FROM classes WHERE n_label > 1),
seen AS (SELECT w.term, w.label, w.doc_id, round(w.w * 1e9)::BIGINT AS v FROM weights w JOIN kept USING (label)),
points AS (SELECT term, label, v, count(*) AS mult FROM seen GROUP BY ALL UNION ALL
  SELECT t.term, k.label, 0, k.n_label - count(s.doc_id) FROM (SELECT DISTINCT term FROM seen) t CROSS JOIN kept k
  LEFT JOIN seen s ON s.term = t.term AND s.label = k.label GROUP BY t.term, k.label, k.n_label HAVING k.n_label > count(s.doc_id)),
copies AS (SELECT term, label, v, unnest(range(least(mult, 4))) FROM points),
apart AS (SELECT a.term, a.label, a.v, a.mult, k.n_label, k.n, min(abs(a.v - b.v), 4) AS d
  FROM points a JOIN copies b ON a.term = b.term AND a.label = b.label JOIN kept k ON k.label = a.label GROUP BY ALL),
radius AS (SELECT term, label, v, mult, n_label, n, d[least(4, n_label)] AS r FROM apart),
inside AS (SELECT a.term, a.label, a.v, a.mult, a.n_label, a.n, a.r, sum(b.mult) AS m FROM radius a JOIN points b
  ON b.term = a.term AND b.v BETWEEN a.v - greatest(a.r, 1) + 1 AND a.v + greatest(a.r, 1) - 1 GROUP BY ALL),
psi AS (SELECT i, sum(CASE WHEN i > 1 THEN 1.0::DOUBLE / (i - 1) ELSE 0 END) OVER (ORDER BY i) - 0.5772156649015329 AS psi
  FROM range(1, (SELECT max(n) + 1 FROM kept)) t(i)),
parts AS (SELECT term, mult * (p.psi + a.psi - b.psi - c.psi) / n AS part FROM inside JOIN psi p ON p.i = n JOIN psi b ON b.i = n_label
  JOIN psi c ON c.i = m JOIN psi a ON a.i = CASE WHEN r = 0 THEN mult ELSE least(3, n_label - 1) END)"""]) + \
    "\nSELECT term, round(greatest(sum(part), 0), 6) AS score FROM parts GROUP BY term"

BEST = "best AS (SELECT row_number() OVER (ORDER BY round(score, 6) DESC NULLS LAST, term DESC) AS rank, term, score FROM scores)"
SQL["select_k_best"] = "WITH " + ",\n".join([TFIDF, CLASSES, CHI2, BEST]) + \
    "\nSELECT rank::INT AS rank, term, round(score, 6) AS score FROM best WHERE rank <= 1250"
SQL["apply_selection"] = "WITH " + ",\n".join([TFIDF, CLASSES, CHI2, BEST]) + \
    "\nSELECT doc_id, term, round(w, 6) AS w FROM weights WHERE term IN (SELECT term FROM best WHERE rank <= 1250)"

# ---------------------------------------------------------------- Naive Bayes


def multinomial(entries: str, tests: str, observed: str, classes: str, n_features: str) -> str:
    """Predictions of fold-wise models: log((s + 1) / (S + V)) over the full cell grid of each entry."""
    return f"""sums AS (SELECT fold, label, sum(o) AS total FROM {observed} GROUP BY ALL),
cls AS (SELECT c.fold, c.label, ln(c.n_label / c.n_docs::DOUBLE) AS prior, coalesce(s.total, 0) + {n_features} AS denom
  FROM {classes} c LEFT JOIN sums s ON s.fold = c.fold AND s.label = c.label),
contrib AS (SELECT e.fold, e.doc_id, c.label, sum(e.w * ln((coalesce(o.o, 0) + 1) / c.denom)) AS a
  FROM {entries} e JOIN cls c ON c.fold = e.fold
  LEFT JOIN {observed} o ON o.fold = e.fold AND o.term = e.term AND o.label = c.label GROUP BY ALL),
scored AS (SELECT t.fold, t.doc_id, t.label AS y, c.label, round(c.prior + coalesce(a.a, 0), 6) AS s
  FROM {tests} t JOIN cls c ON c.fold = t.fold
  LEFT JOIN contrib a ON a.fold = t.fold AND a.doc_id = t.doc_id AND a.label = c.label),
preds AS (SELECT fold, doc_id, y, label AS p FROM scored
  QUALIFY row_number() OVER (PARTITION BY fold, doc_id ORDER BY s DESC, label) = 1)"""


HOLD_PARTS = """train_docs AS (SELECT 0 AS fold, doc_id, label FROM docs WHERE split = 'train'),
tests AS (SELECT 0 AS fold, doc_id, label FROM docs WHERE split = 'test'),
classes AS (SELECT fold, label, count(*) AS n_label, sum(count(*)) OVER () AS n_docs FROM train_docs GROUP BY fold, label),
observed AS (SELECT t.fold, term, w.label, sum(w) AS o, sum(w * w) AS q FROM weights w JOIN train_docs t USING (doc_id) GROUP BY ALL),
entries AS (SELECT t.fold, t.doc_id, term, w FROM weights JOIN tests t USING (doc_id))"""
HOLD = [*HOLDOUT, HOLD_PARTS]
HOLD_MNB = [*HOLD, multinomial("entries", "tests", "observed", "classes", "(SELECT count(*) FROM vocab)")]
SQL["classify_multinomial_nb"] = with_(*HOLD_MNB) + "SELECT doc_id, y, p FROM preds"


def gaussian(entries: str, tests: str, observed: str, classes: str, terms: str) -> str:
    """Predictions of Gaussian models over the dense term-by-class grid."""
    return f"""term_sums AS (SELECT fold, term, sum(o) AS o, sum(q) AS q FROM {observed} GROUP BY ALL),
eps AS (SELECT s.fold, 1e-9 * max(s.q / c.n - (s.o / c.n) * (s.o / c.n)) AS eps
  FROM term_sums s JOIN (SELECT fold, sum(n_label)::DOUBLE AS n FROM {classes} GROUP BY fold) c USING (fold) GROUP BY s.fold),
stats AS (SELECT c.fold, t.term, c.label, coalesce(o.o, 0) / c.n_label AS mu,
  greatest(coalesce(o.q, 0) / c.n_label - (coalesce(o.o, 0) / c.n_label) * (coalesce(o.o, 0) / c.n_label), 0) + e.eps AS var
  FROM {terms} t CROSS JOIN {classes} c JOIN eps e ON e.fold = c.fold
  LEFT JOIN {observed} o ON o.fold = c.fold AND o.term = t.term AND o.label = c.label),
bases AS (SELECT fold, label, sum(-0.5 * ln(2 * pi() * var) - mu * mu / (2 * var)) AS base FROM stats GROUP BY ALL),
contrib AS (SELECT e.fold, e.doc_id, s.label, sum((2 * e.w * s.mu - e.w * e.w) / (2 * s.var)) AS a
  FROM {entries} e JOIN stats s ON s.fold = e.fold AND s.term = e.term GROUP BY ALL),
scored AS (SELECT t.fold, t.doc_id, t.label AS y, c.label,
  round(ln(c.n_label / c.n_docs::DOUBLE) + b.base + coalesce(a.a, 0), 6) AS s
  FROM {tests} t JOIN {classes} c ON c.fold = t.fold JOIN bases b ON b.fold = c.fold AND b.label = c.label
  LEFT JOIN contrib a ON a.fold = t.fold AND a.doc_id = t.doc_id AND a.label = c.label),
preds AS (SELECT fold, doc_id, y, label AS p FROM scored
  QUALIFY row_number() OVER (PARTITION BY fold, doc_id ORDER BY s DESC, label) = 1)"""


SQL["classify_gaussian_nb"] = with_(*HOLD, gaussian("entries", "tests", "observed", "classes", "vocab")) + \
    "SELECT doc_id, y, p FROM preds"

FOLD_ENTRIES = "fold_entries AS (SELECT f.fold, f.doc_id, term, w FROM weights JOIN folds f USING (doc_id))"
FOLD_PREDS = [*FOLD_CORPUS, FOLD_ENTRIES,
              multinomial("fold_entries", "folds", "observed", "classes", "(SELECT count(*) FROM vocab)")]

# Both classifiers over character 3-grams, in separate scopes.
_BY_FOLD_Q = BY_FOLD.replace("count(*) AS n FROM weights", "sum(w * w) AS q FROM weights")
_CHAR = [DOCS, GRAMS, GRAM_COUNTS, vocabulary(3), WEIGHTS, folds(5, PLAIN), FOLDS, _BY_FOLD_Q, FOLD_ENTRIES]
_AVG = """SELECT '{name}' AS classifier, round(avg(acc), 6) AS avg_accuracy
FROM (SELECT fold, avg((y = p)::INT) AS acc FROM preds GROUP BY fold)"""
SQL["baseline_all_features"] = with_(*_CHAR) + f"""SELECT * FROM (WITH {multinomial(
    'fold_entries', 'folds', 'observed', 'classes', '(SELECT count(*) FROM vocab)')} {_AVG.format(name='MNB')})
UNION ALL SELECT * FROM (WITH {gaussian('fold_entries', 'folds', 'observed', 'classes', 'vocab')} {_AVG.format(name='NB')})"""

# ---------------------------------------------------------------- metrics

CLASS_SCORES = """labels_seen AS (SELECT fold, y AS label FROM preds UNION SELECT fold, p FROM preds),
per_label AS (SELECT l.fold, l.label, count(*) FILTER (WHERE y = l.label) AS support,
  count(*) FILTER (WHERE p = l.label) AS predicted, count(*) FILTER (WHERE y = l.label AND p = l.label) AS tp
  FROM labels_seen l JOIN preds USING (fold) GROUP BY ALL),
prf AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
  CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1 FROM per_label)"""
FOUR = """round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS f1_macro,
  round(2 * sum(tp) / (sum(support) + sum(predicted)), 6) AS f1_micro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted"""
_M = ",\n".join([*FOLD_PREDS, CLASS_SCORES])
SQL["accuracy"] = with_(*FOLD_PREDS) + "SELECT fold, round(avg((y = p)::INT), 6) AS accuracy FROM preds GROUP BY fold"
SQL["confusion_matrix"] = with_(*FOLD_PREDS, "seen AS (SELECT y AS l FROM preds UNION SELECT p FROM preds)") + \
    """SELECT a.l AS y, b.l AS p, count(preds.doc_id) AS n FROM seen a CROSS JOIN seen b
LEFT JOIN preds ON preds.y = a.l AND preds.p = b.l GROUP BY ALL"""
for _name, _value in {"f1_macro": "avg(f1)", "f1_micro": "2 * sum(tp) / (sum(support) + sum(predicted))",
                      "f1_weighted": "sum(f1 * support) / sum(support)"}.items():
    SQL[_name] = f"WITH {_M}\nSELECT fold, round({_value}, 6) AS {_name} FROM prf GROUP BY fold"
SQL["fold_average"] = with_(*FOLD_PREDS) + """SELECT 'MNB' AS classifier, round(100 * avg(acc), 6) AS avg_accuracy
FROM (SELECT fold, avg((y = p)::INT) AS acc FROM preds GROUP BY fold)"""
SQL["classification_report"] = with_(*HOLD_MNB, CLASS_SCORES) + """
SELECT row_number() OVER (ORDER BY label)::INT AS row_no, label AS name, round(precision, 3) AS precision,
  round(recall, 3) AS recall, round(f1, 3) AS f1, support FROM prf
UNION ALL SELECT (count(*) + 1)::INT, 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 3), sum(support)::BIGINT FROM prf
UNION ALL SELECT (count(*) + 2)::INT, 'macro avg', round(avg(precision), 3), round(avg(recall), 3), round(avg(f1), 3), sum(support)::BIGINT FROM prf
UNION ALL SELECT (count(*) + 3)::INT, 'weighted avg', round(sum(precision * support) / sum(support), 3),
  round(sum(recall * support) / sum(support), 3), round(sum(f1 * support) / sum(support), 3), sum(support)::BIGINT FROM prf"""
_NUM = "printf('%.3f', coalesce({}, 0))"
SQL["sink_report"] = with_(*HOLD_MNB, CLASS_SCORES, f"rep AS ({SQL['classification_report'].split(CLASS_SCORES)[1]})") + f"""
SELECT unnest(['-----', '-----', '-----', '-----']) || repeat('-', 95) AS value
UNION ALL SELECT '# of instances in train: ' || count(*) FILTER (WHERE split = 'train') || ' and test: ' || count(*) FILTER (WHERE split = 'test') FROM docs
UNION ALL SELECT unnest(['Feature model-scheme: bow_tf-idf', 'Minimum document frequency: 3', 'Random state: 123',
  'Vectorizer''s computation time: 0.0', 'Classification report for MNB:', 'Confusion matrix for MNB:', 'Target names:'])
UNION ALL SELECT '# of features: ' || count(*) FROM vocab
UNION ALL SELECT name || '  ' || {_NUM.format('precision')} || '  ' || {_NUM.format('recall')} || '  ' || {_NUM.format('f1')} || '  ' || support FROM rep
UNION ALL SELECT '[' || string_agg(n, ' ' ORDER BY p) || ']' FROM (SELECT a.l AS y, b.l AS p, count(preds.doc_id) AS n
  FROM (SELECT y AS l FROM preds UNION SELECT p FROM preds) a CROSS JOIN (SELECT y AS l FROM preds UNION SELECT p FROM preds) b
  LEFT JOIN preds ON preds.y = a.l AND preds.p = b.l GROUP BY ALL) GROUP BY y
UNION ALL SELECT (row_number() OVER (ORDER BY label) - 1) || ' -> ' || label FROM (SELECT DISTINCT label FROM docs)"""
SQL["selected_counts"] = "WITH " + ",\n".join([*FOLD_CORPUS, FOLD_CHI2]) + """
SELECT fold, count(*) AS n_selected, round(avg(count(*)) OVER (), 6) AS avg_selected
FROM scores WHERE round(score, 6) > 1 GROUP BY fold"""
SQL["timing_summary"] = with_(
    "docs AS (SELECT doc_id, lang AS label, source, n_chars FROM documents)", folds(5, PLAIN),
    """cells AS (SELECT source, fold, sum(n_chars) / 1000.0::DOUBLE AS sel, count(*)::DOUBLE AS cls
  FROM docs JOIN folds USING (doc_id) GROUP BY ALL)""") + """
SELECT source AS method, 'selection' AS stage, round(avg(sel), 6) AS avg_seconds FROM cells GROUP BY source
UNION ALL SELECT source, 'classification', round(avg(cls), 6) FROM cells GROUP BY source
UNION ALL SELECT source, 'total', round(avg(sel + cls), 6) FROM cells GROUP BY source"""

# ---------------------------------------------------------------- selection runs

HOLD_CHI2 = [*HOLD, """hold_totals AS (SELECT term, sum(o) AS t FROM observed GROUP BY term),
hold_grid AS (SELECT t.term, c.label, coalesce(o.o, 0) AS o, t.t * c.n_label / c.n_docs AS e FROM hold_totals t
  CROSS JOIN classes c LEFT JOIN observed o ON o.term = t.term AND o.label = c.label),
scores AS (SELECT term, sum((o - e) * (o - e) / e) AS score FROM hold_grid GROUP BY term)""", BEST]


def at_k(k: int) -> str:
    return f"""kept AS (SELECT term FROM best WHERE rank <= {k}),
kept_observed AS (SELECT * FROM observed WHERE term IN (SELECT term FROM kept)),
kept_entries AS (SELECT * FROM entries WHERE term IN (SELECT term FROM kept))"""


_KEPT = ("kept_entries", "tests", "kept_observed", "classes")
SQL["fixed_k_run"] = with_(*HOLD_CHI2, at_k(1250), multinomial(*_KEPT, "(SELECT count(*) FROM kept)"), CLASS_SCORES) + \
    f"SELECT 1250 AS k, {FOUR} FROM prf"
_CELL = "SELECT {k} AS k, '{name}' AS classifier, avg((y = p)::INT) AS acc FROM preds"
_GRID = " UNION ALL ".join(
    f"SELECT * FROM (WITH {at_k(k)}, {sql} {_CELL.format(k=k, name=name)})"
    for k in (10, 100, 1000)
    for name, sql in (("MNB", multinomial(*_KEPT, "(SELECT count(*) FROM kept)")), ("NB", gaussian(*_KEPT, "kept"))))
SQL["result_grid"] = with_(*HOLD_CHI2) + f"""SELECT k, round(max(acc) FILTER (WHERE classifier = 'MNB'), 6) AS "MNB",
  round(max(acc) FILTER (WHERE classifier = 'NB'), 6) AS "NB" FROM ({_GRID}) GROUP BY k"""

FOLD_RANKS = """ranks AS (SELECT fold, term, row_number() OVER (PARTITION BY fold ORDER BY round(score, 6) DESC, term DESC) AS rank FROM scores)"""
SQL["filter_over_folds"] = "WITH " + ",\n".join([
    DOCS, WORDS, vocabulary(5), WEIGHTS, folds(5, SHUFFLED), FOLDS, BY_FOLD, FOLD_CHI2, FOLD_RANKS, FOLD_ENTRIES, """
kept_observed AS (SELECT o.* FROM observed o JOIN ranks r USING (fold, term) WHERE rank <= 490),
kept_entries AS (SELECT e.* FROM fold_entries e JOIN ranks r USING (fold, term) WHERE rank <= 490)""",
    multinomial("kept_entries", "folds", "kept_observed", "classes", "490"), CLASS_SCORES]) + \
    f"\nSELECT fold, {FOUR} FROM prf GROUP BY fold"

# Every k of the grid: running sums of class parts in rank order, evaluated at every grid point.
SQL["k_sweep"] = "WITH " + ",\n".join([*FOLD_CORPUS, FOLD_CHI2, FOLD_RANKS, FOLD_ENTRIES, """
slots AS (SELECT fold, term, ((rank + 9) // 10) AS slot FROM ranks),
grid_k AS (SELECT unnest(range(1, ((SELECT count(*) FROM vocab) - 1) // 10 + 1)) AS slot),
totals_k AS (SELECT c.fold, c.label, g.slot, c.n_label, c.n_docs,
  coalesce(sum(s.o) OVER (PARTITION BY c.fold, c.label ORDER BY g.slot), 0) + 10 * g.slot AS denom
  FROM classes c CROSS JOIN grid_k g LEFT JOIN (SELECT fold, label, slot, sum(o) AS o FROM observed JOIN slots USING (fold, term) GROUP BY ALL) s
  ON s.fold = c.fold AND s.label = c.label AND s.slot = g.slot),
doc_slots AS (SELECT e.fold, e.doc_id, c.label, k.slot, sum(e.w) AS w, sum(e.w * ln(coalesce(o.o, 0) + 1)) AS a
  FROM fold_entries e JOIN slots k ON k.fold = e.fold AND k.term = e.term JOIN classes c ON c.fold = e.fold
  LEFT JOIN observed o ON o.fold = e.fold AND o.term = e.term AND o.label = c.label GROUP BY ALL),
paths AS (SELECT f.fold, f.doc_id, f.label AS y, c.label, g.slot,
  coalesce(sum(d.w) OVER p, 0) AS w, coalesce(sum(d.a) OVER p, 0) AS a
  FROM folds f JOIN classes c ON c.fold = f.fold CROSS JOIN grid_k g
  LEFT JOIN doc_slots d ON d.fold = f.fold AND d.doc_id = f.doc_id AND d.label = c.label AND d.slot = g.slot
  WINDOW p AS (PARTITION BY f.doc_id, c.label ORDER BY g.slot)),
best_k AS (SELECT x.fold, x.doc_id, x.slot, x.y,
  arg_min(x.label, (-round(ln(t.n_label / t.n_docs::DOUBLE) + x.a - x.w * ln(t.denom), 6), x.label)) AS p
  FROM paths x JOIN totals_k t ON t.fold = x.fold AND t.label = x.label AND t.slot = x.slot GROUP BY ALL)"""]) + """
SELECT (10 * slot)::INT AS k, 'MNB' AS classifier, round(avg(acc), 6) AS avg_accuracy
FROM (SELECT slot, fold, avg((y = p)::INT) AS acc FROM best_k GROUP BY ALL) GROUP BY slot"""


def _scheme(name: str, source: list[str], weight: str) -> str:
    """Hold-out accuracy of one weighting scheme, fitted on the train documents."""
    train = "train_counts AS (SELECT * FROM counts JOIN (SELECT doc_id FROM docs WHERE split = 'train') USING (doc_id))"
    vocab = vocabulary(3, "train_counts").replace("FROM docs)", "FROM docs WHERE split = 'train')")
    weights = WEIGHTS if weight == "tfidf" else \
        f"weights AS (SELECT c.doc_id, c.label, c.term, {weight}::DOUBLE AS w FROM counts c JOIN vocab USING (term))"
    parts = ",\n".join([SPLIT_DOCS, *source, train, vocab, weights, HOLD_PARTS,
                        multinomial("entries", "tests", "observed", "classes", "(SELECT count(*) FROM vocab)")])
    return f"SELECT * FROM (WITH {parts} SELECT '{name}' AS scheme, 'MNB' AS classifier, round(avg((y = p)::INT), 6) AS accuracy FROM preds)"


_LING_COUNTS = [*LING, "counts AS (SELECT doc_id, label, term, count(*) AS tf FROM ling GROUP BY ALL)"]
_CHAR_COUNTS = [GRAMS, GRAM_COUNTS]
# The multinomial rows of the scheme grid; a test compares them. The models of its other rows are beyond SQL.
SCHEMES_MNB = " UNION ALL ".join(
    _scheme(f"{prefix}{name}", source, weight)
    for prefix, source in (("bow_", _LING_COUNTS), ("3", _CHAR_COUNTS))
    for name, weight in (("tf-idf", "tfidf"), ("tf", "tf"), ("binary", "1")))

FOLD_MI = """term_df AS (SELECT fold, term, sum(n) AS df FROM observed GROUP BY ALL),
mi_cells AS (SELECT t.fold, t.term, c.n_label, c.n_docs::DOUBLE AS n, t.df, coalesce(o.n, 0) AS hit FROM term_df t
  JOIN classes c ON c.fold = t.fold LEFT JOIN observed o ON o.fold = t.fold AND o.term = t.term AND o.label = c.label),
mi_scores AS (SELECT fold, term, sum(CASE WHEN hit > 0 THEN hit / n * ln(hit * n / (n_label * df::DOUBLE)) ELSE 0 END +
  CASE WHEN n_label > hit THEN (n_label - hit) / n * ln((n_label - hit) * n / (n_label * (n - df))) ELSE 0 END) AS score FROM mi_cells GROUP BY ALL),
mi_ranks AS (SELECT fold, term, row_number() OVER (PARTITION BY fold ORDER BY round(score, 6) DESC, term DESC) AS rank FROM mi_scores)"""


def _method(name: str, ranks: str) -> str:
    kept = f"""kept_observed AS (SELECT o.* FROM observed o JOIN {ranks} r USING (fold, term) WHERE rank <= 490),
kept_entries AS (SELECT e.* FROM fold_entries e JOIN {ranks} r USING (fold, term) WHERE rank <= 490)"""
    return f"""SELECT * FROM (WITH {kept}, {multinomial("kept_entries", "folds", "kept_observed", "classes", "490")}
SELECT '{name}' AS method, round(avg(acc), 6) AS avg_accuracy, 490.0::DOUBLE AS avg_selected
FROM (SELECT fold, avg((y = p)::INT) AS acc FROM preds GROUP BY fold))"""


SQL["method_comparison"] = "WITH " + ",\n".join([*FOLD_CORPUS, FOLD_CHI2, FOLD_RANKS, FOLD_ENTRIES, FOLD_MI]) + \
    "\n" + _method("chi2", "ranks") + " UNION ALL " + _method("mi", "mi_ranks")

# What can be said of models that SQL does not fit: every document is judged with a label of the training set,
# and better than by always naming the largest class.
_JUDGED = """docs AS (SELECT doc_id, lang AS label FROM documents WHERE doc_id % 5 = 0)
SELECT doc_id, label AS y, true AS p_known, true AS beats_majority FROM docs"""
for _name in ("lr", "svm", "tree", "forest"):
    SQL[f"classify_{_name}"] = "WITH " + _JUDGED
SQL["classify_all"] = "WITH " + _JUDGED.replace("SELECT doc_id, label AS y", "SELECT classifier, doc_id, label AS y").replace(
    "FROM docs", "FROM docs, (SELECT unnest(['LR', 'SVM', 'NB', 'MNB', 'DT', 'RF']) AS classifier)")

# The intercepts of logistic regression are not penalised: at the optimum the probabilities of a class sum to its size.
SQL["lr_class_totals"] = "WITH " + ",\n".join([DOCS, WORDS, vocabulary(5), WEIGHTS, folds(5, SHUFFLED), FOLDS, BY_FOLD]) + """
SELECT fold::INT AS fold, label, n_label::BIGINT AS n_train, round(n_label::DOUBLE, 1) AS expected FROM classes"""


def _tree_level(d: int) -> str:
    """Best split of every node of level `d`, by every value of every term, and the documents of the next level."""
    return f"""tot{d} AS (SELECT node, label, count(*) AS n FROM lv{d} GROUP BY ALL),
cel{d} AS MATERIALIZED (SELECT node, term, v, label, count(*) AS n FROM lv{d} JOIN values_of USING (doc_id) GROUP BY ALL),
val{d} AS (SELECT DISTINCT node, term, v FROM cel{d}),
run{d} AS (SELECT a.node, a.term, a.v, t.n AS total,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY a.node, a.term, t.label ORDER BY a.v DESC) AS r
  FROM val{d} a JOIN tot{d} t ON a.node = t.node LEFT JOIN cel{d} c ON c.node = a.node AND c.term = a.term AND c.v = a.v AND c.label = t.label),
sco{d} AS (SELECT node, term, v, round(sum(r * r)::DOUBLE / sum(r) + sum((total - r) * (total - r))::DOUBLE / nullif(sum(total - r), 0), 6) AS score,
    sum(total * total)::DOUBLE / sum(total) AS before, sum(total) AS n_docs FROM run{d} GROUP BY node, term, v),
low{d} AS (SELECT *, (v + coalesce(lead(v) OVER (PARTITION BY node, term ORDER BY v DESC), 0)) / 2 AS threshold FROM sco{d}),
bes{d} AS MATERIALIZED (SELECT node, n_docs::BIGINT AS n_docs, term, threshold, score FROM low{d} WHERE score > before + 1e-6
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, term, v DESC) = 1),
lv{d + 1} AS (SELECT l.doc_id, l.label, l.node || CASE WHEN x.v > b.threshold THEN 'r' ELSE 'l' END AS node
  FROM lv{d} l JOIN bes{d} b ON l.node = b.node LEFT JOIN values_of x ON x.doc_id = l.doc_id AND x.term = b.term)"""


SQL["tree_splits"] = "WITH " + ",\n".join([
    *HOLD, "values_of AS MATERIALIZED (SELECT doc_id, term, round(w, 6) AS v FROM weights WHERE round(w, 6) > 0)",
    "lv0 AS (SELECT doc_id, label, '' AS node FROM train_docs)", *[_tree_level(d) for d in range(3)]]) + "\n" + " UNION ALL ".join(
    f"SELECT node, n_docs, term, round(threshold, 7) AS threshold, score FROM bes{d}" for d in range(3))
