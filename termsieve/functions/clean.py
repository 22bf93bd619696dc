"""Text cleaning and tokenizing as Column expressions; only the stems of whole texts leave the JVM."""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from .fixed import (BREAKS, CONTRACTIONS, EMOTICONS, IRREGULAR_STEMS, PORTER_STEP2, PORTER_STEP3, PORTER_STEP4, PUNCTUATION,
                    SPACE, STOPWORDS, WORD)


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def squash_whitespace(col: Column, blank_dots: bool = False) -> Column:
    """Trim, and turn each run of Unicode whitespace into one blank."""
    text = _text(col)
    if blank_dots:
        text = F.replace(text, F.lit("."), F.lit(" "))
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


@lru_cache(maxsize=1)
def all_digits() -> str:
    """Every digit character: decimal ones plus super-, subscript and circled forms."""
    return "".join(c for c in map(chr, range(0x110000)) if c.isdigit())


def drop_digits(col: Column) -> Column:
    return F.translate(_text(col), all_digits(), "")


def replace_emoticons(col: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(f" {kv[1]} ")), EMOTICONS, _text(col))


def strip_punctuation(col: Column) -> Column:
    return F.translate(_text(col), PUNCTUATION, " " * len(PUNCTUATION))


def _strip(col: Column) -> Column:
    return F.regexp_replace(_text(col), f"^[{SPACE}]+|[{SPACE}]+$", "")


def lower_trim(col: Column) -> Column:
    return F.lower(_strip(col))


def clean_short_text(col: Column) -> Column:
    """Short messages: dots, emoticons, digits and punctuation out, then lower case."""
    text = replace_emoticons(squash_whitespace(col, blank_dots=True))
    return lower_trim(squash_whitespace(strip_punctuation(drop_digits(text))))


def clean_plain_text(col: Column) -> Column:
    return lower_trim(squash_whitespace(drop_digits(_strip(col))))


def clean_news_text(col: Column) -> Column:
    return lower_trim(squash_whitespace(drop_digits(squash_whitespace(col, blank_dots=True))))


def derive_binary_labels(code: Column) -> tuple[Column, Column]:
    """(gender, cyberbully) from a folder code: gender in EV/EY, insult in EV/BV."""
    gender = F.when(code.isin("EV", "EY"), 1).otherwise(0)
    insult = F.when(code.isin("EV", "BV"), 1).otherwise(0)
    return gender.alias("gender"), insult.alias("cyberbully")


def regex_clean(col: Column) -> Column:
    """Blank everything that is neither a word character nor whitespace; merge blanks."""
    return F.regexp_replace(_text(col), f"[^{WORD}{BREAKS}]+", " ")


def tokenize_words(col: Column) -> Column:
    """Lower-cased words of already cleaned text; contractions such as `cannot` split in two."""
    text = F.lower(_text(col))
    pairs = "|".join(f"{a}(?={b}(?![{WORD}]))" for a, b in CONTRACTIONS)
    first = "".join(sorted({a[0] for a, _ in CONTRACTIONS}))
    text = F.regexp_replace(text, f"(?=[{first}])(?<![{WORD}])({pairs})", "$1 ")
    # The same as all but SPACE, without comparing each character with its members one by one.
    return F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def remove_stopwords(tokens: Column, words: list[str] = STOPWORDS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(words))


def filter_tokens(tokens: Column, min_length: int = 2) -> Column:
    """Tokens that begin with an ASCII letter and have at least `min_length` characters."""
    return F.filter(tokens, lambda t: F.left(t, F.lit(1)).isin(list(ascii_letters)) & (F.length(t) >= min_length))


def basic_text(col: Column) -> Column:
    return F.array_join(filter_tokens(tokenize_words(regex_clean(col))), " ")


def stem_tokens(tokens: Column) -> Column:
    """`porter_stem` of each token; a task stems a word once, however often it occurs."""
    return F.arrow_udf(_stemmed, T.ArrayType(T.StringType()))(tokens)


def linguistic_tokens(col: Column, words: list[str] = STOPWORDS) -> Column:
    """Clean, split, drop stopwords, stem, keep words of two or more characters."""
    return filter_tokens(stem_tokens(remove_stopwords(tokenize_words(regex_clean(col)), words)))


def strip_message_noise(col: Column, headers: bool = True, footers: bool = True,
                        quotes: bool = True) -> Column:
    """Text of a mail-like message without header block, signature and quoted lines.

    headers: keep only what follows the first blank line (nothing if there is none).
    footers: cut from the last line that is blank or made of dashes, if text precedes it.
    quotes: drop lines that are quoted or announce a quotation.
    """
    text = _text(col)
    if headers:
        text = F.regexp_extract(text, r"(?s)^.*?\n\n(.*)$", 1)
    if footers:
        blank = SPACE.replace(r"\t-\r", r"\t\x0B-\r")
        kept = F.regexp_extract(
            _strip(text), rf"(?s)^(.+)\n[{blank}]*-*[{blank}]*(?:\n.*)?$", 1)
        text = F.coalesce(F.nullif(kept, F.lit("")), text)
    if quotes:
        marks = r"writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>"
        text = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(marks)), "\n")
    return text


# ---------------------------------------------------------------- stemming (Porter 1980)
# A stem is a run of consonants and vowels; `y` counts as a vowel after a consonant.
_CONS = "[^aeiou][^aeiouy]*"
_VOWS = "[aeiouy][aeiou]*"
_HAS_VOWEL = f"(?:{_CONS})?[aeiouy].*"
_M1 = f"(?:{_CONS})?{_VOWS}"                # at the start of the first vowel run
_M2 = f"{_M1}{_CONS}{_VOWS}"                # at the start of the second vowel run
_SHORT = f"{_CONS}[aeiouy][^aeiouwxy]|[aeiou][^aeiou]"
# A rule that fired (or that forbids later ones) ends the word with a mark.
_DONE, _FIX = "\x01", "\x02"


def _steps() -> list[tuple[list[str], list[tuple[str, str]]]]:
    """Per step, the endings that it looks for and its rules, tried in turn on the whole word."""
    some, more = f"{_M1}[^aeiou].*", f"{_M2}[^aeiou].*"
    before = {"ment": "(?<!e)", "ent": "(?<!m)", "ion": "(?<=[st])", "tional": "(?<!a)", "ation": "(?<!iz)"}
    return [
        (["s"], [("(.)ies", "$1ie" + _DONE), ("(.*)sses", "$1ss" + _DONE),
                 ("(.*)ies", "$1i" + _DONE), ("(.*ss)", "$1" + _DONE), ("(.*)s", "$1")]),
        (["ed", "ing"], [("(.)ied", "$1ie" + _DONE), ("(.*)ied", "$1i" + _DONE),
                         (f"({_M1}[^aeiou].*)eed", "$1ee" + _DONE), ("(.*eed)", "$1" + _DONE),
                         (f"({_HAS_VOWEL})(?:ed|ing)", "$1" + _FIX),
                         (f"(.*(?:at|bl|iz)){_FIX}", "$1e"),
                         (f"(.*)([^aeiouylsz])\\2{_FIX}", "$1$2"),
                         (f"({_SHORT}){_FIX}", "$1e")]),
        (["y"], [("(.+[^aeiouy])y", "$1i")]),
        ([s for s, _ in PORTER_STEP2] + ["bli", "fulli", "logi"], [(f"({some})alli", "$1al")] + [
            (f"({some}){before.get(s, '')}{s}", "$1" + r + _DONE) for s, r in PORTER_STEP2 if s not in ("abli", "alli")] + [
            (f"({some})bli", "$1ble" + _DONE), (f"({some})fulli", "$1ful" + _DONE),
            (f"({_M1}(?:[^aeiou].*)?l)ogi", "$1og" + _DONE)]),
        ([s for s, _ in PORTER_STEP3], [(f"({some}){s}", "$1" + r + _DONE) for s, r in PORTER_STEP3]),
        (PORTER_STEP4, [(f"({more}){before.get(s, '')}{s}", "$1" + _DONE) for s in PORTER_STEP4]),
        (["e"], [(f"({more})e", "$1" + _DONE), (f"((?:{_SHORT})e)", "$1" + _DONE),
                 (f"({_M1}{_CONS}(?:{_VOWS})?)e", "$1")]),
        (["ll"], [(f"({_M2}(?:[^aeiou].*)?l)l", "$1")]),
    ]


def _step(word: Column, endings: list[str], rules: list[tuple[str, str]]) -> Column:
    """Apply `rules` to words with one of `endings`; most words have none and pass by."""
    def fire(w: Column) -> Column:
        fired = reduce(lambda c, r: F.regexp_replace(c, f"^{r[0]}$", r[1]), rules, w)
        return F.when(w.rlike(f"(?:{'|'.join(endings)})$"), F.translate(fired, _DONE + _FIX, "")).otherwise(w)
    # A one-element array names the word, which is then read twice but computed once.
    return F.transform(F.array(word), fire)[0]


def porter_stem(word: Column) -> Column:
    """Porter stem of a lower-cased word, with the usual irregular forms.

    Each rule is one anchored replacement, so the expression reads the word once per rule.
    """
    w = reduce(lambda c, step: _step(c, *step), _steps(), F.regexp_replace(word, "^y", "Y"))
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR_STEMS.items() for x in pair])
    return F.when(F.length(word) <= 2, word) \
        .when(word.isin(list(IRREGULAR_STEMS)), F.try_element_at(irregular, word)) \
        .otherwise(F.lower(w))


@lru_cache(maxsize=1)
def _compiled() -> list[tuple[tuple[str, ...], list[tuple[re.Pattern, str]]]]:
    return [(tuple(endings), [(re.compile(f"(?:{r})\\Z"), re.sub(r"\$(\d)", r"\\g<\1>", new)) for r, new in rules]) for endings, rules in _steps()]


@lru_cache(maxsize=1 << 18)
def stem_word(word: str) -> str:
    """`porter_stem` of a string, by the same rules."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR_STEMS:
        return IRREGULAR_STEMS[word]
    w = "Y" + word[1:] if word[0] == "y" else word
    for endings, rules in _compiled():
        if w.endswith(endings):
            for rule, new in rules:
                found = rule.match(w)
                if found:
                    w = found.expand(new)
            w = w.replace(_DONE, "").replace(_FIX, "")
    return w.lower()


def _stemmed(rows: pa.Array) -> pa.Array:
    words = rows.flatten().dictionary_encode()
    stems = pa.array([None if w is None else stem_word(w) for w in words.dictionary.to_pylist()], pa.string())
    ends = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), stems.take(words.indices), mask=rows.is_null())
