"""Check SQL for scans, cleaning, class shaping, the term relation and splits."""

from __future__ import annotations

from functools import reduce

from termsieve.functions import fixed

from .base import DOCS, SPACE, SPLIT_DOCS, TFIDF, WEIGHTS, WORD, WORDS, digit_class, q, vocabulary, with_

SQL: dict[str, str] = {}

# ---------------------------------------------------------------- cleaning


def squash(x: str, dots: bool = False) -> str:
    x = f"replace({x}, '.', ' ')" if dots else x
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


def no_digits(x: str) -> str:
    return f"regexp_replace({x}, {q(digit_class())}, '', 'g')"


def emoticons(x: str) -> str:
    return reduce(lambda c, kv: f"replace({c}, {q(kv[0])}, ' {kv[1]} ')", fixed.EMOTICONS, x)


def no_punctuation(x: str) -> str:
    return f"translate({x}, {q(fixed.PUNCTUATION)}, {q(' ' * len(fixed.PUNCTUATION))})"


def lower_trim(x: str) -> str:
    return f"lower(regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def regex_clean(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[^{WORD}{SPACE}]', ' ', 'g'), ' +', ' ', 'g')"


def words(x: str) -> str:
    cases = " ".join(f"WHEN '{a}{b}' THEN ['{a}', '{b}']" for a, b in fixed.CONTRACTIONS)
    tokens = f"regexp_extract_all(lower({regex_clean(x)}), '[^{SPACE}]+')"
    return f"flatten(list_transform({tokens}, lambda t: CASE t {cases} ELSE [t] END))"


STOP = "[" + ", ".join(q(w) for w in fixed.STOPWORDS) + "]"


def no_stopwords(x: str) -> str:
    return f"list_filter({x}, lambda t: NOT list_contains({STOP}, t))"


def kept(x: str) -> str:
    return f"list_filter({x}, lambda t: regexp_matches(t, '^[a-zA-Z]') AND length(t) >= 2)"


def over_docs(value: str) -> str:
    return with_(DOCS) + f"SELECT doc_id, {value} AS value FROM docs"


SQL["squash_whitespace"] = over_docs(squash("text", True))
SQL["drop_digits"] = over_docs(no_digits("text"))
SQL["replace_emoticons"] = over_docs(emoticons("text"))
SQL["strip_punctuation"] = over_docs(no_punctuation("text"))
SQL["lower_trim"] = over_docs(lower_trim("text"))
SQL["regex_clean"] = over_docs(regex_clean("text"))
SQL["basic_text"] = over_docs(f"array_to_string({kept(words('text'))}, ' ')")
SQL["clean_short_text"] = over_docs(
    lower_trim(squash(no_punctuation(no_digits(emoticons(squash("text", True)))))))
SQL["clean_plain_text"] = over_docs(lower_trim(squash(no_digits(strip("text")))))
SQL["clean_news_text"] = over_docs(lower_trim(squash(no_digits(squash("text", True)))))

for _name, _expr in {"tokenize_words": words("text"), "remove_stopwords": no_stopwords(words("text")),
                     "filter_tokens": kept(words("text"))}.items():
    SQL[_name] = with_(DOCS, f"t AS (SELECT doc_id, {_expr} AS t FROM docs)") + \
        "SELECT doc_id, len(t)::INT AS n, array_to_string(t, ' ') AS value FROM t"

_QUOTE = r"writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>"
_BLANK = SPACE.replace(r"\t-\r", r"\t\x0B-\r")
_FOOT = rf"(?s)^(.+)\n[{_BLANK}]*-*[{_BLANK}]*(?:\n.*)?$"


def _noise(x: str) -> str:
    foot = f"coalesce(nullif(regexp_extract({strip(x)}, {q(_FOOT)}, 1), ''), {x})"
    return (f"array_to_string(list_filter(string_split({foot}, chr(10)), "
            f"lambda l: NOT regexp_matches(l, {q(_QUOTE)})), chr(10))")


SQL["strip_message_noise"] = with_(
    DOCS, "cut AS (SELECT doc_id, text, CASE WHEN position(chr(10) || chr(10) IN text) > 0 "
          "THEN substr(text, position(chr(10) || chr(10) IN text) + 2) ELSE '' END AS rest FROM docs)") + \
    f"SELECT doc_id, {_noise('rest')} AS stripped, {_noise('text')} AS body FROM cut"

# ---------------------------------------------------------------- stemming
# One column per step; `s` is the word before the suffix, tested against the stem shapes.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0 = f"^({_C})?{_V}[^aeiou]"                      # measure above 0
_M1 = f"^({_C})?{_V}{_C}{_V}[^aeiou]"              # measure above 1
_EQ1 = f"^({_C})?{_V}{_C}({_V})?$"                 # measure 1
_HASV = f"^({_C})?[aeiouy]"
_SHORT = f"^({_C}[aeiouy][^aeiouwxy]|[aeiou][^aeiou])$"


def _cut(w: str, suffix: str) -> str:
    return f"left({w}, length({w}) - {len(suffix)})"


def _rules(w: str, rules: list[tuple[str, str]], shape: str, extra: dict[str, str] | None = None) -> str:
    """CASE: the longest suffix decides; it is replaced if the rest has the shape."""
    cases = []
    for suffix, to in sorted(rules, key=lambda r: -len(r[0])):
        s = _cut(w, suffix)
        more = f" AND {extra[suffix].format(s=s)}" if extra and suffix in extra else ""
        cases.append(f"WHEN suffix({w}, '{suffix}') THEN CASE WHEN regexp_matches({s}, '{shape}'){more} "
                     f"THEN {s} || '{to}' ELSE {w} END")
    return "CASE " + " ".join(cases) + f" ELSE {w} END"


def stem_ctes(source: str) -> str:
    """CTEs turning `source(term)` into `stems(term, stem)`."""
    irregular = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.IRREGULAR_STEMS.items())
    step2 = [(s, r) for s, r in fixed.PORTER_STEP2 if s != "abli"] + [("bli", "ble"), ("fulli", "ful")]
    two = _rules("w2", step2, _M0)
    logi = f"WHEN suffix(w2, 'logi') THEN CASE WHEN regexp_matches({_cut('w2', 'ogi')}, '{_M0}') THEN {_cut('w2', 'ogi')} || 'og' ELSE w2 END "
    two = two.replace("CASE ", "CASE " + logi, 1)
    step4 = [(s, "") for s in fixed.PORTER_STEP4]
    return f"""words AS (SELECT DISTINCT term FROM {source}),
p0 AS (SELECT term, CASE WHEN term[1] = 'y' THEN 'Y' || term[2:] ELSE term END AS w FROM words),
p1 AS (SELECT term, CASE WHEN regexp_matches(w, '^(?s:.)ies$') THEN left(w, 3) WHEN suffix(w, 'sses') THEN left(w, length(w) - 2)
  WHEN suffix(w, 'ies') THEN left(w, length(w) - 2) WHEN suffix(w, 'ss') THEN w
  WHEN suffix(w, 's') THEN left(w, length(w) - 1) ELSE w END AS w FROM p0),
p2 AS (SELECT term, w, CASE WHEN suffix(w, 'ed') THEN {_cut('w', 'ed')} WHEN suffix(w, 'ing') THEN {_cut('w', 'ing')} END AS b FROM p1),
p3 AS (SELECT term, CASE WHEN suffix(w, 'ied') THEN CASE WHEN length(w) = 4 THEN left(w, 3) ELSE left(w, length(w) - 2) END
  WHEN suffix(w, 'eed') THEN CASE WHEN regexp_matches({_cut('w', 'eed')}, '{_M0}') THEN left(w, length(w) - 1) ELSE w END
  WHEN b IS NULL OR NOT regexp_matches(b, '{_HASV}') THEN w
  WHEN suffix(b, 'at') OR suffix(b, 'bl') OR suffix(b, 'iz') THEN b || 'e'
  WHEN length(b) >= 2 AND b[-1] = b[-2] AND NOT regexp_matches(b, '[aeiouy]$')
    THEN CASE WHEN b[-1] IN ('l', 's', 'z') THEN b ELSE left(b, length(b) - 1) END
  WHEN regexp_matches(b, '{_SHORT}') THEN b || 'e' ELSE b END AS w FROM p2),
p4 AS (SELECT term, CASE WHEN suffix(w, 'y') AND length(w) > 2 AND NOT regexp_matches({_cut('w', 'y')}, '[aeiouy]$')
  THEN {_cut('w', 'y')} || 'i' ELSE w END AS w FROM p3),
p5 AS (SELECT term, CASE WHEN suffix(w, 'alli') AND regexp_matches({_cut('w', 'alli')}, '{_M0}')
  THEN {_cut('w', 'alli')} || 'al' ELSE w END AS w2 FROM p4),
p6 AS (SELECT term, {two} AS w FROM p5),
p7 AS (SELECT term, {_rules('w', fixed.PORTER_STEP3, _M0)} AS w FROM p6),
p8 AS (SELECT term, {_rules('w', step4, _M1, {'ion': "({s})[-1] IN ('s', 't')"})} AS w FROM p7),
p9 AS (SELECT term, CASE WHEN suffix(w, 'e') AND (regexp_matches({_cut('w', 'e')}, '{_M1}') OR
  (regexp_matches({_cut('w', 'e')}, '{_EQ1}') AND NOT regexp_matches({_cut('w', 'e')}, '{_SHORT}')))
  THEN {_cut('w', 'e')} ELSE w END AS w FROM p8),
p10 AS (SELECT term, CASE WHEN suffix(w, 'll') AND regexp_matches({_cut('w', 'l')}, '{_M1}')
  THEN {_cut('w', 'l')} ELSE w END AS w FROM p9),
stems AS (SELECT term, CASE WHEN length(term) <= 2 THEN term ELSE CASE term {irregular} ELSE lower(w) END END AS stem FROM p10)"""


_ALL_WORDS = f"all_words AS (SELECT doc_id, label, unnest({words('text')}) AS term FROM docs)"
LING = [_ALL_WORDS.replace(words("text"), no_stopwords(words("text"))), stem_ctes("all_words"),
         """ling AS (SELECT doc_id, label, stem AS term FROM all_words JOIN stems USING (term)
  WHERE regexp_matches(stem, '^[a-zA-Z]') AND length(stem) >= 2)"""]
SQL["conflate_tokens"] = with_(DOCS, _ALL_WORDS, stem_ctes("all_words")) + \
    "SELECT stem AS term, count(*) AS n FROM all_words JOIN stems USING (term) GROUP BY stem"
SQL["linguistic_terms"] = with_(DOCS, *LING) + "SELECT label, term, count(*) AS n FROM ling GROUP BY ALL"
SQL["linguistic_tokens"] = with_(
    DOCS, f"lists AS (SELECT doc_id, {no_stopwords(words('text'))} AS ts FROM docs)",
    "all_words AS (SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM lists)",
    stem_ctes("all_words"),
    """joined AS (SELECT doc_id, string_agg(stem, ' ' ORDER BY pos) AS value FROM all_words JOIN stems USING (term)
  WHERE regexp_matches(stem, '^[a-zA-Z]') AND length(stem) >= 2 GROUP BY doc_id)""") + \
    "SELECT doc_id, coalesce(value, '') AS value FROM docs LEFT JOIN joined USING (doc_id)"

# ---------------------------------------------------------------- scans

SQL["scan_text_tree"] = with_(DOCS) + \
    "SELECT label, count(*) AS n_files, sum(length(text))::BIGINT AS n_chars FROM docs GROUP BY label"
SQL["scan_csv"] = with_(DOCS) + \
    "SELECT label AS category, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM docs GROUP BY label"
SQL["scan_labelled_table"] = "SELECT doc_id, text, lang AS label FROM documents"
LISTED = """listed AS (SELECT doc_id, label, split FROM docs
  UNION ALL SELECT doc_id, 'lowq', split FROM docs JOIN labels USING (doc_id) WHERE quality = 0
  UNION ALL SELECT doc_id, 'toxic', split FROM docs JOIN labels USING (doc_id) WHERE toxic = 1)"""
SQL["scan_by_category"] = with_(SPLIT_DOCS, LISTED) + "SELECT doc_id, label, split FROM listed"
SQL["scan_subset"] = """SELECT doc_id, source AS label, 'train' AS split FROM documents
WHERE doc_id % 5 <> 0 AND source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7')"""
SQL["sink_table"] = "SELECT lang AS label, count(*) AS n_label FROM documents GROUP BY lang"

# ---------------------------------------------------------------- labels and class shaping

SQL["map_label"] = "SELECT doc_id, CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 END AS label_idx FROM documents"
SQL["derive_binary_labels"] = "SELECT doc_id, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS gender, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS cyberbully FROM labels"
SQL["class_distribution"] = with_(
    SPLIT_DOCS, LISTED, "names AS (SELECT lang AS label FROM documents UNION SELECT source FROM documents)",
    "targets AS (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS target_no FROM names)") + \
    """SELECT target_no, t.label, count(l.doc_id) AS n FROM targets t
LEFT JOIN (SELECT * FROM listed WHERE split = 'test') l ON t.label = l.label GROUP BY ALL"""
_RN = "row_number() OVER (PARTITION BY label, split ORDER BY doc_id)"
SQL["cap_per_class"] = with_(SPLIT_DOCS) + f"SELECT doc_id, label, split FROM docs QUALIFY {_RN} <= 80"
SQL["half_per_class"] = with_(SPLIT_DOCS) + \
    f"SELECT doc_id, label, split FROM docs QUALIFY {_RN} <= floor(count(*) OVER (PARTITION BY label, split) / 2)"
SQL["filter_class_size"] = with_(SPLIT_DOCS, LISTED) + """SELECT doc_id, label FROM listed
WHERE label IN (SELECT label FROM listed GROUP BY label HAVING count(*) BETWEEN 20 AND 100)"""
SQL["split_by_prefix"] = with_(SPLIT_DOCS) + "SELECT doc_id, label, split FROM docs"
SQL["holdout"] = SQL["split_by_prefix"]
SQL["encode_labels"] = with_(
    SPLIT_DOCS, "codes AS (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS label_idx "
                "FROM (SELECT DISTINCT label FROM docs WHERE split = 'train'))") + \
    "SELECT doc_id, label, label_idx FROM docs JOIN codes USING (label) WHERE split = 'test'"
SQL["pool_splits"] = with_(
    SPLIT_DOCS, "numbered AS (SELECT *, CASE split WHEN 'train' THEN 0 ELSE 1 END AS split_no FROM docs)",
    "firsts AS (SELECT label, min((split_no, doc_id)) AS first_at FROM numbered GROUP BY label)",
    "classes AS (SELECT label, (row_number() OVER (ORDER BY first_at) - 1)::INT AS class_no FROM firsts)") + \
    "SELECT doc_id, label, split_no, class_no FROM numbered JOIN classes USING (label)"

# ---------------------------------------------------------------- term relation

GRAMS = f"""squashed AS (SELECT doc_id, label, regexp_replace(lower(text), '[{SPACE}]{{2,}}', ' ', 'g') AS x FROM docs),
grams AS (SELECT doc_id, label, unnest(list_transform(range(1, length(x) - 1), lambda i: substring(x, i, 3))) AS term FROM squashed)"""
GRAM_COUNTS = "counts AS (SELECT doc_id, label, term, count(*) AS tf FROM grams GROUP BY ALL)"
SQL["char_ngrams"] = with_(DOCS, GRAMS) + "SELECT label, term, count(*) AS n FROM grams GROUP BY ALL"
SQL["word_terms"] = with_(DOCS, WORDS) + "SELECT label, term, sum(tf)::BIGINT AS n FROM counts GROUP BY ALL"
SQL["term_counts"] = with_(DOCS, WORDS) + "SELECT doc_id, label, term, tf FROM counts"
SQL["binary_terms"] = with_(DOCS, WORDS) + "SELECT doc_id, label, term, 1::BIGINT AS tf FROM counts"
SQL["min_df_vocabulary"] = with_(DOCS, WORDS, vocabulary(3)) + "SELECT term, df, idx::INT AS idx FROM vocab"
SQL["corpus_shape"] = with_(DOCS, GRAMS, GRAM_COUNTS, vocabulary(3)) + \
    "SELECT (SELECT count(*) FROM docs) AS n_samples, (SELECT count(*) FROM vocab) AS n_features"
SQL["tfidf_l2"] = "WITH " + TFIDF + "\nSELECT doc_id, term, round(w, 6) AS w FROM weights"
SQL["tfidf_l2_char3"] = with_(DOCS, GRAMS, GRAM_COUNTS, vocabulary(3), WEIGHTS) + \
    "SELECT term, round(sum(w), 6) AS w, count(*) AS df FROM weights GROUP BY term"
_TRAIN_COUNTS = "train_counts AS (SELECT * FROM counts JOIN (SELECT doc_id FROM docs WHERE split = 'train') USING (doc_id))"
HOLDOUT = [SPLIT_DOCS, WORDS, _TRAIN_COUNTS,
           vocabulary(3, "train_counts").replace("FROM docs)", "FROM docs WHERE split = 'train')"), WEIGHTS]
SQL["transform_with_vocabulary"] = with_(*HOLDOUT) + \
    "SELECT doc_id, term, round(w, 6) AS w FROM weights JOIN docs USING (doc_id) WHERE split = 'test'"
SQL["to_vectors"] = "WITH " + TFIDF + """
SELECT doc_id, (SELECT count(*) FROM vocab)::INT AS size, count(w)::INT AS nnz,
  coalesce(sum(idx), 0)::BIGINT AS index_sum, round(coalesce(sum((idx + 1) * w), 0), 3) AS moment
FROM docs LEFT JOIN weights USING (doc_id) GROUP BY doc_id"""

# ---------------------------------------------------------------- splits


def folds(k: int, order: str) -> str:
    """Explicit allocation: list the sorted class positions, deal them over the folds."""
    return f"""firsts AS (SELECT label, min(doc_id) AS first, count(*) AS n FROM docs GROUP BY label),
positions AS (SELECT label, row_number() OVER (ORDER BY first, i) - 1 AS p
  FROM (SELECT label, first, unnest(range(n)) AS i FROM firsts)),
deal AS (SELECT label, p % {k} AS fold, row_number() OVER (PARTITION BY label ORDER BY p % {k}, p) AS slot FROM positions),
places AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {order}) AS slot FROM docs),
folds AS (SELECT doc_id, label, fold::INT AS fold FROM places JOIN deal USING (label, slot))"""


PLAIN, SHUFFLED = "doc_id", "md5(concat_ws('-', '123', doc_id)), doc_id"
SQL["stratified_folds"] = with_(DOCS, folds(5, PLAIN)) + "SELECT doc_id, label, fold FROM folds"
SQL["stratified_folds_shuffled"] = with_(DOCS, folds(5, SHUFFLED)) + "SELECT doc_id, label, fold FROM folds"


def kfold(k: int, seed: int, source: str = "docs") -> str:
    return f"""sizes AS (SELECT i, count(*) // {k} + CASE WHEN i < count(*) % {k} THEN 1 ELSE 0 END AS size
  FROM {source}, (SELECT unnest(range({k})) AS i) GROUP BY i),
ends AS (SELECT i, sum(size) OVER (ORDER BY i) AS hi, sum(size) OVER (ORDER BY i) - size AS lo FROM sizes),
shuffled AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('-', '{seed}', doc_id)), doc_id) - 1 AS pos FROM {source}),
inner_folds AS (SELECT doc_id, i::INT AS fold FROM shuffled JOIN ends ON pos >= lo AND pos < hi)"""


SQL["kfold_shuffled"] = with_(DOCS, kfold(2, 123)) + "SELECT doc_id, fold FROM inner_folds"
