"""Common parts of the check queries: plain SQL over the given tables."""

from __future__ import annotations

import unicodedata

from termsieve.functions import fixed

SPACE, WORD = fixed.SPACE, fixed.WORD


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text, lang AS label FROM documents)"
SPLIT_DOCS = """docs AS (SELECT doc_id, coalesce(text, '') AS text, lang AS label,
  CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents)"""
WORDS = f"""toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[{WORD}]{{2,}}')) AS term FROM docs),
counts AS (SELECT doc_id, label, term, count(*) AS tf FROM toks JOIN docs USING (doc_id) GROUP BY ALL)"""


def vocabulary(min_df: int = 3, counts: str = "counts") -> str:
    return f"""dfs AS (SELECT term, count(*) AS df FROM {counts} GROUP BY term HAVING count(*) >= {min_df}),
vocab AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS idx FROM dfs),
n AS (SELECT count(*)::DOUBLE AS n FROM docs)"""


WEIGHTS = """raw AS (SELECT c.doc_id, c.label, c.term, v.idx, c.tf, c.tf * (ln((1 + n.n) / (1 + v.df)) + 1) AS r
  FROM counts c JOIN vocab v USING (term), n),
norms AS (SELECT doc_id, sqrt(sum(r * r)) AS norm FROM raw GROUP BY doc_id),
weights AS (SELECT raw.doc_id, label, term, idx, tf, r / norm AS w FROM raw JOIN norms USING (doc_id))"""

TFIDF = ",\n".join([DOCS, WORDS, vocabulary(3), WEIGHTS])


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def digit_class() -> str:
    odd = "".join(chr(c) for c in range(0x110000)
                  if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd")
    return r"[\p{Nd}" + odd + "]"
