"""Quality, licences, personal data, packing, chat and mixing on small tables with odd rows."""

import hashlib
import re
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from termsieve.llm import canonical_license, chat, mixing, packing, pii, quality, workers_import

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def importable(spark):
    workers_import(spark)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).coalesce(2)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# ---------------------------------------------------------------- quality

QUALITY_TEXTS = [None, "", "  \n ", "a b c d e a b c d e", "x\ny\nx\n \n \nx", "#* $%& <|> word", "é ü " * 30,
                 " ".join(f"w{i % 7}" for i in range(200)), "a a a a a a a", "one two three four five six seven eight nine ten",
                 "tab\tand\x0bvertical\x0cfeed\rend", "plain clean words that are all different here and there now",
                 "long " * 4000]


def base_counts(text):
    w = words_of(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    seen, inside = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            inside |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), failed)


def test_quality_counts_and_scores(spark):
    import xxhash
    rows = [(i, t, "_place", "x", None) for i, t in enumerate(QUALITY_TEXTS)] + [(3, QUALITY_TEXTS[3], None, None, 1), (None, "a b", None, None, 2)]
    docs = table(spark, rows, DOCS.replace("lang", "kept"))
    labels = table(spark, [(9, 1, 0), (11, 1, None), (7, 0, 0), (10, 1, 1), (None, 1, 0), (99, 1, 0), (8, None, None)],
                   "doc_id long, quality int, toxic int")
    n_buckets = 64
    got = quality.judge(docs, labels, threshold=0.0, n_buckets=n_buckets).select("doc.doc_id", "doc.text", "n_words", "word_chars", "n_symbols",
                        "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score").collect()
    assert len(got) == len(rows)

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def hashes(text):
        return [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words_of(text)]

    def chained(a, b):
        second = xxhash.xxh64_intdigest((b % (1 << 64)).to_bytes(8, "little"), xxhash.xxh64_intdigest((a % (1 << 64)).to_bytes(8, "little"), 42))
        return signed(second)

    def buckets(text):
        h = hashes(text)
        return [x % n_buckets for x in h] + [chained(a, b) % n_buckets for a, b in zip(h, h[1:])]

    raw, good = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(buckets(t))
        good.update(buckets(t) if i in (9, 11) else [])
    ratio = [np.log((good[b] + 1) / (good.total() + n_buckets)) - np.log((raw[b] + 1) / (raw.total() + n_buckets)) for b in range(n_buckets)]
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(r.text), r.text
        b = buckets(r.text)
        if b:
            assert r.score == pytest.approx(np.mean([ratio[x] for x in b]))
        assert r.kept == (not r.base_failed and (not b or r.score >= 0))
    kept = quality.keep_good(docs, labels, threshold=0.0, n_buckets=n_buckets)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_quality_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = table(spark, [(1, "one two three four five six seven eight nine ten", "", "", 0)], DOCS)
    assert [(r.kept, r.score) for r in quality.judge(docs, none).collect()] == [(True, None)]
    assert quality.judge(docs.limit(0), none).count() == 0


# ---------------------------------------------------------------- licences

def test_licenses(spark):
    mit = next(t for n, t in canonical_license.KNOWN_TEXTS if n == "MIT")
    wild = "COPYRIGHT (c) 2020 Somebody\n" + mit.upper().replace(",", " ,\n") + "\n(c) 2021 Else"
    docs = table(spark, [(1, mit, "x"), (2, wild.replace("SUBLICENSE", "sub-licence"), "x"), (3, None, "x"), (4, "", None), (5, mit + " more", ""),
                         (6, "text\nReleased under the  MIT licence!\nAll rights reserved", ""), (6, "text\nAll Rights Reserved.", ""),
                         (None, "All rights reserved.", ""), (7, "... !!", "")], "doc_id long, text string, license string")
    got = sorted(((r.doc_id or 0, r.license, r.n_notices, tuple(r.notices)) for r in canonical_license.scan_licenses(docs).collect()), key=str)
    both = ("All rights reserved", "MIT notice")
    assert got == sorted([(1, "MIT", 0, ()), (2, "MIT", 0, ()), (3, None, 0, ()), (4, None, 0, ()), (5, None, 0, ()), (6, None, 3, both),
                          (6, None, 3, both), (0, "All rights reserved", 1, ("All rights reserved",)), (7, None, 0, ())], key=str)
    assert canonical_license.scan_licenses(docs.limit(0)).count() == 0
    assert canonical_license.scan_licenses(docs, []).where("license IS NOT NULL").count() == 0


def known_text(name):
    return next(t for n, t in canonical_license.KNOWN_TEXTS if n == name)


def test_licenses_as_they_are_found(spark):
    """Wrapped at any width, commented, titled, under notices of several styles; lines of the text that begin with "copyright" stay."""
    wrapped = {width: "\n".join(textwrap.wrap(known_text("ISC"), width)) for width in range(40, 100, 3)}
    assert any(line.startswith("copyright notice") for t in wrapped.values() for line in t.split("\n"))
    cases = [(t, "ISC") for t in wrapped.values()]
    bsd = "\n".join(f" * {line}" for line in textwrap.wrap(known_text("BSD-3-Clause"), 70))
    cases += [("/*\n * Copyright (c) 1998, 2001 The Authors.\n * All rights reserved.\n *\n" + bsd + "\n */", "BSD-3-Clause"),
              ("BSD 2-Clause License\n\nCopyright 2011-2013 A, B\n\n" + known_text("BSD-2-Clause"), "BSD-2-Clause"),
              (known_text("BSD-2-Clause").replace("1. ", "- ").replace("2. ", "- "), "BSD-2-Clause"),
              ("The MIT License (MIT)\n\nCopyright © Jane Doe\nCopyright Jane Doe and others\n(C) 2003 Else\ncopyright [yyyy] [name]\n" + known_text("MIT"), "MIT"),
              ("Copyright by Me\n" + known_text("Zlib"), "Zlib"), (known_text("AGPL-3.0-or-later notice").replace("https", "http"), "AGPL-3.0-or-later notice"),
              ("copyright law protects this book\nAll rights reserved.", None), ("(c) You must retain notices.\nAll rights reserved.", None),
              ("Copyright holders\n" + known_text("MIT"), None), ("Copyright 2020 Me\nAll rights reserved.", None),
              (known_text("MIT") * 400, None)]
    docs = table(spark, [(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in canonical_license.scan_licenses(docs).collect()}
    assert [got[i].license for i in range(len(cases))] == [want for _, want in cases]
    assert got[len(cases) - 2].digest is None  # nothing but a copyright notice


def test_licenses_from_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("My Licence\n\nDo as you like,\nalways.")
    (tmp_path / "Empty.txt").write_text("")
    docs = table(spark, [(1, "Copyright 2020 X\nMY LICENSE: do as you like; always"), (2, known_text("MIT"))], "doc_id long, text string")
    known = canonical_license.license_folder(spark, str(tmp_path))
    assert {r.doc_id: r.license for r in canonical_license.scan_licenses(docs, known).collect()} == {1: "Own-1.0", 2: None}


# ---------------------------------------------------------------- personal data

@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 7919])
def test_permutation(size):
    assert sorted(pii.permute(i, size, b"k", "t") for i in range(size)) == list(range(size))


def test_formats():
    key = b"k"
    cards = {f"4{i:014d}" for i in range(300)}
    cards = {c + pii.luhn_digit(c) for c in cards}
    new = {pii.pseudonymized(c, key)[0] for c in cards}
    assert len(new) == 300 and all(pii.luhn_digit(c[:-1]) == c[-1] and c[0] == "4" and len(c) == 16 for c in new)
    card = "4111111111111111"
    spaced = pii.pseudonymized("card 4111 1111-1111 1111.", key)[0]
    assert re.sub(r"\D", "", spaced) == pii.pseudonymized(card, key)[0] and re.fullmatch(r"card \d{4} \d{4}-\d{4} \d{4}\.", spaced)
    for text, shape in {"+1 (988) 555-2485": r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", "10.0.0.255": r"\d+\.\d+\.\d+\.\d+", "2020-02-29": r"\d{4}-\d\d-\d\d",
                        "29.02.2020": r"\d\d\.\d\d\.\d{4}", "2/29/2020": r"\d+/\d+/\d{4}", "123-45-6789": r"\d{3}-\d{2}-\d{4}",
                        "DE89 3704 0044 0532 0130 00": r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", "Jo.e42@mail.example.com": r"[A-Z][a-z]\.[a-z]\d\d@mail\.example\.com",
                        "+49 30 1234567": r"\+49 \d\d \d{7}"}.items():
        out, spans = pii.pseudonymized(f"see {text}, ok", key)
        assert len(spans) == 1 and re.fullmatch(rf"see {shape}, ok", out) and text not in out, (text, out)
        assert out[spans[0][1]:spans[0][2]] == out[4:-4]
    iban = pii.pseudonymized("DE89370400440532013000", key)[0]
    assert iban == pii.pseudonymized("DE89 3704 0044 0532 0130 00", key)[0].replace(" ", "") and pii._iban_check("DE", iban[4:]) == iban[2:4]
    assert re.sub(r"\D", "", pii.pseudonymized("29.02.2020", key)[0])[-4:] == pii.pseudonymized("2020-02-29", key)[0][:4]
    for clean in ("4111111111111112", "2020-02-30", "300.1.1.1", "000-12-3456", "version 2.0.1", "12345", "a@b", "1.2.3", "DE88370400440532013000", "0" * 16):
        assert pii.pseudonymized(clean, key) == (clean, [])


def test_pseudonymize_rows(spark):
    docs = table(spark, [(1, "ip 1.2.3.4", "a"), (2, None, "b"), (3, "", None), (None, "1.2.3.4", "d"), (1, "ip 1.2.3.4", "a"), (5, "x" * 200_000 + " 1.2.3.4", "e")],
                 "doc_id long, text string, pii_spans string")
    got = pii.pseudonymize(docs).collect()
    new = pii.pseudonymized("1.2.3.4", pii.KEY)[0]
    assert Counter((r.doc_id, len(r.pii_spans)) for r in got) == Counter({(1, 1): 2, (2, 0): 1, (3, 0): 1, (None, 1): 1, (5, 1): 1})
    assert {r.text for r in got} == {"ip " + new, None, "", new, "x" * 200_000 + " " + new}
    assert pii.pseudonymize(docs.limit(0), spans=False).count() == 0
    assert pii.pseudonymize(docs.drop("pii_spans"), spans=False).columns == ["doc_id", "text"]


# ---------------------------------------------------------------- packing

def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "a", "hello <|endoftext|> world  x\n\n\ty", "don't  we'll 😀 é　x \x85 y", "many words " * 3000, "Zz" * 5000] + [f"word{i} " * (i % 300) for i in range(400)]
    docs = spark.createDataFrame([(i if i != 3 else None, t, 5) for i, t in enumerate(texts)] + [(2, "a", 5)], "doc_id long, text string, start int").coalesce(3)
    got = packing.pack(docs).toPandas()
    by_ids = Counter()
    for (_, _), g in got[got.doc_id.notna() & (got.doc_id != 2)].groupby(["doc_id", "doc_tokens"]):
        g = g.sort_values("start")
        assert list(g.start) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == g.doc_tokens.iloc[0]
        ids = [int(x) for p in g.ids for x in p]
        assert ids == reference.encode(texts[int(g.doc_id.iloc[0])] or "", add_special_tokens=False).ids + [0]
        by_ids[len(g)] += 1
    assert (got.doc_id == 2).sum() == 2 and got.doc_id.isna().sum() == 1 and max(by_ids) > 1
    import zlib
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got.itertuples())
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    n = got.sequence_id.nunique()
    assert n <= got.length.sum() / 1024 + 3
    assert packing.pack(docs.limit(0)).count() == 0


def test_sum_of_squares_takes_the_best_level():
    levels, counts = packing.Levels(16), Counter()
    rng = np.random.default_rng(3)
    for size in rng.integers(1, 16, 3000).tolist():
        def cost(level):
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + size < 16:
                after[level + size] += 1
            return sum(v * v for v in after.values())
        best = min([0, *(h for h, v in counts.items() if v and h + size <= 16)], key=cost)
        _, at = levels.place(size)
        assert cost(at) == cost(best)
        if at:
            counts[at] -= 1
        if at + size < 16:
            counts[at + size] += 1


# ---------------------------------------------------------------- chat

def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind", 1), (1, 1, "ann", "hi", 1), (1, 2, "bob", None, 1), (1, 2, "bob", None, 2), (1, 3, "ann", "", 1), (2, 0, "system", "alone", 1),
            (3, 70, None, "late", 1), (3, 1, "ann", "early", 1), (3, None, "ann", "when", 1), (None, 1, "ann", "x", 1), (4, 1, "ann", "é" * 100_000, 1)]
    got = chat.rotate(table(spark, rows, "conv_id long, turn long, role string, text string, speaker int")).collect()
    shown = {(r.conv_id, r.part, r.speaker): r for r in got}
    assert set(shown) == {(1, 0, "ann"), (1, 0, "bob"), (3, 0, "ann"), (3, 0, "unknown"), (None, 0, "ann"), (4, 0, "ann")}
    assert shown[3, 0, "ann"].n_messages == 3 and shown[3, 0, "ann"].rendered.startswith("<|assistant|>\nwhen")
    r = shown[1, 0, "bob"]
    assert r.rendered == "<|system|>\nbe kind<|end|>\n<|user name=ann|>\nhi<|end|>\n" + "<|assistant|>\n<|end|>\n" * 2 + "<|user name=ann|>\n<|end|>\n" and r.n_messages == 5
    assert [r.rendered[m.start:m.end] for m in r.masks] == ["<|end|>\n"] * 2
    r = shown[1, 0, "ann"]
    assert [r.rendered[m.start:m.end] for m in r.masks] == ["hi<|end|>\n", "<|end|>\n"]
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("window_rows", [None, 0])
def test_long_dialogue(spark, window_rows):
    """A speaker of the first messages gets every part, and each part opens with the system message."""
    talk = [(7, 0, "system", "be kind"), (7, 1, "ann", "hello")] + [(7, 2 + i, ("bob", "eve")[i % 2], f"m{i}") for i in range(600)] + [(7, 300, "bob", "m298")] * 2
    other = [(None, t, "zoe", f"z{t}") for t in range(70)]
    got = chat.rotate(table(spark, talk + other, "conv_id long, turn long, role string, text string"), 64, window_rows).collect()
    for conv, rows in ((7, talk), (None, other)):
        ordered = sorted(rows, key=lambda r: r[1:])
        people, opening = {r[2] for r in rows} - {"system"}, [r for r in ordered[:64] if r[2] == "system"]
        want = set()
        for at in range(0, len(ordered), 64):
            for who in people:
                own = ordered[at:at + 64]
                text, masks = "", []
                for _, _, role, said in (opening if at else []) + own:
                    text += "<|" + {"system": "system", who: "assistant"}.get(role, "user name=" + role) + "|>\n"
                    if role == who:
                        masks.append((len(text), len(text + said + "<|end|>\n")))
                    text += said + "<|end|>\n"
                want.add((at // 64, who, len(own), text, tuple(masks)))
        shown = [(r.part, r.speaker, r.n_messages, r.rendered, tuple((m.start, m.end) for m in r.masks)) for r in got if r.conv_id == conv]
        assert len(shown) == len(want) and set(shown) == want


# ---------------------------------------------------------------- mixing

def test_poisson_cdf(spark):
    for rate in (0.01, 0.7, 3.0, 60.0, 900.0):
        cdf = np.array(spark.range(1).select(mixing.poisson_cdf(F.lit(rate)).alias("c")).first().c)
        p, want, logp = [], 0.0, -rate
        for k in range(len(cdf)):
            logp += np.log(rate / k) if k else 0
            want += np.exp(logp)
            p.append(want)
        assert np.allclose(cdf, p, atol=1e-9) and cdf[-1] == pytest.approx(1, abs=1e-9)


def test_mixing(spark):
    rows = [(i, f"t{i}", "a" if i % 3 else "b", 7) for i in range(3000)] + [(None, "n", None, 7), (5, "t5", "a", 7), (9001, None, "c", 7)]
    docs = table(spark, rows, "doc_id long, text string, source string, copy_no int")
    got = mixing.replicate(docs, {"b": 3.0, "c": 0.0}).toPandas()
    assert list(got.columns) == ["doc_id", "text", "source", "copy_no", "shuffle_key"]
    assert (got.source == "c").sum() == 0
    total, weights = len(rows), {"a": 1.0, "b": 3.0, None: 1.0}
    for s in ("a", "b"):
        want = total * weights[s] / sum(weights.values())
        assert abs((got.source == s).sum() - want) < 5 * want ** 0.5
    for i in got.doc_id.dropna().unique()[:50]:
        d = got[got.doc_id == i]
        u = int(hashlib.md5(f"draw-{mixing.SEED}-{int(i)}".encode()).hexdigest()[:15], 16) / 2 ** 60
        s = d.source.iloc[0]
        rate = total * weights[s] / sum(weights.values()) / sum(r[2] == s for r in rows)
        k, term, low = 0, np.exp(-rate), 0.0
        while low + term < u:
            low, k = low + term, k + 1
            term *= rate / k
        assert len(d) == k * (2 if i == 5 else 1) and set(d.copy_no) == set(range(1, k + 1))
    assert (np.diff(got.shuffle_key) >= 0).all()
    assert mixing.replicate(docs.limit(0), {}).count() == 0
