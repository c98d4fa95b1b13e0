"""License scan, personal data, decontamination, quality, rules and shards on small fixtures."""

import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, license_scan, pii, quality, rules, shards

from .conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def against_duckdb(out, sql, rows):
    documents = pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})  # noqa: F841  read by DuckDB
    cursor = duckdb.execute(sql)
    names = [c[0] for c in cursor.description]
    expected = sorted(tuple(repr(v) for v in r) for r in cursor.fetchall())
    assert sorted(tuple(repr(r[n]) for n in names) for r in out.collect()) == expected


LICENSES = [
    (100, 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. CC-BY CC BY'),
    (101, "This work is licensed under the terms of the GNU General Public License, version 3; under the MIT License"),
    (102, "neither the name of Foo Bar inc nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (103, "neither the name of " + "x " * 13 + "nor the names of its contributors may be used to endorse"),
    (104, "mit mit license licensed under the mit licence"),
]


def test_license_scan_is_its_sql(spark, frame):
    rows = LICENSES + ODD
    out = license_scan.scan(frame(rows)).drop("matches")
    against_duckdb(out, license_scan.oracle_sql(), rows)
    labels = {r.doc_id: r.labels for r in out.collect()}
    assert labels[100] == "apache,apache-2.0-notice,cc-by" and labels[102] == "bsd-3-clause-condition" and labels[103] == "" and labels[104] == "mit"
    assert license_scan.scan(frame([])).count() == 0


def test_whole_licenses_need_every_word(spark, frame):
    """A text is accepted with its variable parts filled in, and not with one mandatory word changed."""
    rows, expected = [], {}
    for k, (label, template) in enumerate(license_scan.TEMPLATES):
        for option in (True, False):
            words = license_scan.MARK.sub(lambda m: "|" if m[1] == "beginOptional" else "^" if m[1] == "endOptional" else " ".join(["foo"] * max(int(m[2]), 1)), template)
            whole = words.replace("|", "").replace("^", "") if option else re.sub(r"\|[^|^]*\^", "", re.sub(r"\|[^|^]*\^", "", words)).replace("|", "").replace("^", "")
            changed = whole.split()
            changed[changed.index(max(license_scan.Automaton.of(label, template).mandatory, key=len))] = "changed"
            rows += [(10 * k + option, whole.title()), (10 * k + 5 + option, " ".join(changed))]
            expected[10 * k + option] = label
    out = {r.doc_id: r.labels.split(",") for r in license_scan.scan(frame(rows)).collect()}
    for doc_id, label in expected.items():
        assert label in out[doc_id]
        same = [x for x, _ in license_scan.TEMPLATES].count(label) > 1
        assert same or label not in out[doc_id + 5], (label, rows[doc_id])
    against_duckdb(license_scan.scan(frame(rows)).drop("matches"), license_scan.oracle_sql(), rows)


def test_template_markup():
    a = license_scan.Automaton.of("x", "a <<beginOptional>>b <<beginOptional>>c <<endOptional>><<endOptional>>d <<var;name=v;words=0..2>> e")
    accepts = {t: bool(a.matches(t.split())) for t in ("a d e", "a b d e", "a b c d x y e", "a c d e", "a d x y z e")}
    assert accepts == {"a d e": True, "a b d e": True, "a b c d x y e": True, "a c d e": False, "a d x y z e": False}
    for bad in ("<<beginOptional>>a", "a <<endOptional>>", "<<var;name=v;words=0..2>>"):
        with pytest.raises(ValueError):
            license_scan.Automaton.of("x", bad)


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            good = [True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15][kind]
            out += [(m.start(), kind, m.end())] if good else []
    return sorted(out)


def test_base_spans_are_the_patterns(spark, frame):
    r = random.Random(3)
    parts = [*"0123456789+-. @()a%_é", "12", "255", "256", "1.2.3.4", "0" * 25, "000", "+1", "@a.b", "4785380592391139", "a@b", "  "]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for i in range(5000)] + [(d and d + 9000, t) for d, t in ODD]
    assert all(pii.base_spans(t or "") == base_spans(t or "") for _, t in rows)
    for row, (_, text) in zip(sorted(pii.report(frame(rows[:300])).collect()), rows):
        base = base_spans(text)
        assert row.n_card == sum(k == 2 for _, k, _ in base) and row.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert not base or set(pii.written(base).split(",")) <= set(row.spans.split(","))
    assert pii.report(frame([])).count() == 0


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000, "1." * 100_000, "a@" * 100_000, "+1 " * 100_000])
def test_base_spans_take_linear_time(text):
    began = time.perf_counter()
    pii.base_spans(text)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("text, seconds", [("x" * 1_000_000 + " a@b.co", 20), ("x" * 1_000_000 + "@b.co", 20), ("1234567 " * 125_000, 120), ("1" * 1_000_000 + " a@b.co", 20), ("a.b@c.org " * 100_000, 20)])
def test_field_takes_linear_time(text, seconds):
    began = time.perf_counter()
    base, spans = pii.find([text], pii.fitted())
    assert time.perf_counter() - began < seconds
    assert set(base[0]) <= set(spans[0])


def plain_features(text, a, b, cue):
    """What a segment looks like as a whole, one feature after the other."""
    span = text[a:b]
    digits = "".join(c for c in span if c in "0123456789")
    n, rest, before, after = len(digits), set(span) - set("0123456789"), text[a - 1 : a], text[b : b + 1]
    quad = bool(pii._QUAD.fullmatch(span))
    f = np.zeros(pii.N_FEATURES)
    f[0] = f[1 + (n > 0) + (n > 6) + (n > 9) + (n > 13) + (n > 19)] = 1
    f[7] = 14 <= n <= 19 and pii.luhn(digits)
    f[8], f[9] = bool(pii._EMAIL.fullmatch(span)), bool(pii._HIDDEN.fullmatch(span))
    f[10] = quad and all(int(p) <= 255 for p in span.split("."))
    f[11] = quad and not f[10]
    f[12] = span[:1] == "+" and rest <= set("+ ().-")
    f[13], f[14], f[15] = (bool(p.fullmatch(span)) for p in (pii._LOCAL_PHONE, pii._GROUPS, pii._DATE))
    f[16], f[17] = not rest, rest <= {" "} or rest <= {"-"}
    f[18], f[19] = any(c.isalpha() for c in rest), "@" in rest
    f[21] = "(" in rest and span.count("(") != span.count(")")
    f[22:27] = [cue in words for words in pii._CUES]
    f[27], f[28] = before in ("", *' \n\t("'), before in tuple(".-@_/=:")
    f[29] = after in ("", *' \n\t)",.;!?#$%&*')
    f[30] = after in tuple("-@_/=") or after == "." and text[b + 1 : b + 2].isdigit()
    f[31] = "  " in span or "\n" in span
    return f


def test_segments_and_their_features():
    examples = [t for t, _ in pii._examples(120, 5)] + ["", "é٣4 4785-3805 9239 1139@x.org  12\n3456789 (at) x", "1.2.3.4.5 +1 (743) 555-3824 [AT] b.c"]
    x = pii.lattice(examples)
    for (w, i, j), row in zip(x.segments.tolist(), x.inside):
        text, first = examples[w], x.first[w]
        a, b = x.spans[first + i][0], x.spans[first + j - 1][1]
        words = re.findall(r"[^\W\d_]+", text[max(0, a - pii.CONTEXT) : a])
        assert (row == plain_features(text, a, b, words[-1].lower() if words else "")).all(), text[a:b]
    for w, text in enumerate(examples):
        assert "".join(text[s:e] for s, e in x.spans[x.first[w] : x.first[w + 1] - 1]) == text


def splits(n, ends):
    """All splits of n tokens into segments (numbers of `ends`: (i, j)) and single tokens (None)."""
    if n == 0:
        yield []
        return
    for rest in splits(n - 1, ends):
        yield [*rest, None]
    for k, (i, j) in ends.items():
        if j == n:
            for rest in splits(i, ends):
                yield [*rest, k]


def test_best_split_is_that_of_enumeration():
    r, checked = np.random.default_rng(1), 0
    weights = r.normal(size=(pii.N_FEATURES, 5))
    for text in ["4785-3805 9239", "a@b.co 1.2.3.4", "+1 (743) 555-3824", "12 34567 89 01", "x@y z@w 1234567", "no spans at all"]:
        x = pii.lattice([text])
        ends = {k: (i, j) for k, (_, i, j) in enumerate(x.segments.tolist())}
        kinds, alone = x.inside @ weights[:, 1:], x.outside @ weights[:, 0]
        best = -np.inf
        for split in splits(len(x.spans) - 1, ends):
            at, score, spans = 0, 0.0, []
            for k in split:
                if k is None:
                    score, at = score + alone[at], at + 1
                else:
                    i, j = ends[k]
                    score, at = score + kinds[k].max(), j
                    spans.append((x.spans[i][0], int(kinds[k].argmax()), x.spans[j - 1][1]))
            checked += 1
            if score > best:
                best, expected = score, spans
        assert pii.best_spans([text], weights) == [expected]
    assert checked > 50


def test_gradient_of_the_field():
    training, r = pii.Training(pii._examples(40, 3)), np.random.default_rng(0)
    weights = r.normal(size=(pii.N_FEATURES, 5)) / 10
    _, gradient = training.likelihood(weights)
    for _ in range(5):
        d = r.normal(size=weights.shape)
        numeric = (training.likelihood(weights + 1e-5 * d)[0] - training.likelihood(weights - 1e-5 * d)[0]) / 2e-5
        assert abs(numeric - (gradient * d).sum()) < 1e-5


def test_windows_of_a_long_run_find_what_short_texts_have():
    """Cutting a run into windows loses no span at a cut."""
    weights = pii.fitted()
    for shift in range(0, 260, 37):
        text = "7" * shift + " " + "(743) 555-3824 or 12:30 1234 " * 200
        _, spans = pii.find([text], weights)
        assert sum(k == 3 for _, k, _ in spans[0]) == 200


def test_field_on_held_out_windows():
    """Windows of the same grammar, which the field was not fitted on."""
    weights, hit, made, gold = pii.fitted(), 0, 0, 0
    examples = pii._examples(300, 99)
    for found, (_, spans) in zip(pii.best_spans([t for t, _ in examples], weights), examples):
        hit, made, gold = hit + len(set(found) & set(spans)), made + len(found), gold + len(spans)
    assert hit / made > 0.95 and hit / gold > 0.95


#: Sentences that the grammar doesn't make, with their spans in braces.
SENTENCES = """Please reach Dr. Hale at {email:m.hale@clinic-north.org} before the 14th.
Our switchboard is {phone:+44 20 7946 0958}, weekdays 9-17.
The intruder used {ip:203.0.113.77} and later {ip:198.51.100.4} to log in.
She paid with {card:4111 1111 1111 1111} on 3 May 2021.
Card {card:5500-0000-0000-0004} was declined twice.
Write to {email:jane_doe [at] example [dot] net} if the form fails.
Fax the papers to {phone:(212) 555-0187} or drop them off.
Room 101, 2nd floor, building 12, opened 1998-07-23.
Version 10.4.2 fixes bug 48213 and replaces 9.8.7.
ISBN 978-3-16-148410-0 costs 24.99 in most shops.
The population grew from 1,203,445 to 1,398,002 in 2010.
My old number, {phone:415-555-0132}, no longer works.
Server {ip:10.20.30.40} answers on port 8080.
Contact: {email:support+billing@shop.example.co.uk}; ask for Tom.
Order 7783920011 ships from warehouse 12 on 04/11/2023.
commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b breaks the build
Meet at 10:30 at platform 4, train 1123 leaves 10:52.
Call {phone:+1 (617) 555-0166} and leave a message for Ann.
The parcel weighs 12.5 kg and measures 30 x 20 x 15 cm.
Amex {card:378282246310005} is on file; so is Visa {card:4012888888881881}.
Follow @nightowl_77 or mail {email:nightowl77@mail.example}.
Pi is 3.14159265358979 and e is 2.71828182845905.
Her extension is 4471; the main line is {phone:303.555.0119}.
From {ip:192.0.2.146} 404 errors came every 5 minutes.
Tel. {phone:+49 30 901820} gilt nur werktags.
Kurs 1.0825, Stand 12.03.2024, Konto 0532013000.
{email:a.person(at)university.edu} handles admissions for 2025.
Invoice 2024-000431, due 2024-12-31, total 1.250,00."""


def test_field_on_sentences_from_elsewhere():
    hit = made = gold = 0
    for line in SENTENCES.split("\n"):
        text, spans = "", []
        for part in re.split(r"(\{\w+:[^}]*\})", line):
            if m := re.fullmatch(r"\{(\w+):(.*)\}", part):
                spans.append((len(text), pii.KINDS.index(m[1]), len(text) + len(m[2])))
                part = m[2]
            text += part
        found = pii.find([text], pii.fitted())[1][0]
        hit, made, gold = hit + len(set(found) & set(spans)), made + len(found), gold + len(spans)
    print(f"precision {hit}/{made}, recall {hit}/{gold}")
    assert hit / made > 0.8 and hit / gold > 0.8


def test_redaction(spark, frame):
    rows = [(1, "Mail a.b@c.org or +1 (743) 555-3824, from 10.0.0.1."), (2, None), (3, "nothing here 1.2.3")]
    out = {r.doc_id: r.text for r in pii.redacted(frame(rows)).collect()}
    assert out == {1: "Mail [EMAIL] or [PHONE], from [IP].", 2: None, 3: "nothing here 1.2.3"}


def windows(items, size=13):
    out = {}
    for item, text in items:
        w = WORD.findall(low(text))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            out.setdefault(tuple(w[k : k + n]), set()).add(item)
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination(spark, frame, block_bytes):
    r = random.Random(5)
    word = lambda: r.choice(["Alpha", "beta", "gamma", "é", "delta5", "eps"])
    items = [(i, " ".join(word() for _ in range(r.choice([0, 1, 3, 13, 14, 30])))) for i in range(40)] + [(3, "repeated id"), (50, None)]
    rows = [(i, ", ".join([word() for _ in range(r.randint(0, 200))]) + r.choice(["", " " + (r.choice(items)[1] or "")]) if i % 7 else r.choice([t for _, t in items if t])) for i in range(120)] + [(d and d + 9000, t) for d, t in ODD]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    known = windows(items)
    out = decontaminate.contamination(frame(rows), benchmark, block_bytes=block_bytes).collect()
    expected = []
    for doc_id, text in rows:
        w, hit, found = WORD.findall(low(text)), set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in known:
                    hit |= set(range(k, k + n))
                    found |= known[tuple(w[k : k + n])]
        expected.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, expected))
    docs = frame(rows).selectExpr("*", "1 AS __id", "'a' AS __text", "array(1) AS __spans", "2 AS row", "3 AS `a.b`")
    kept = decontaminate.decontaminated(docs, benchmark, block_bytes=block_bytes)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(repr(r) for r, e in zip(rows, expected) if not e[-1]) and kept.columns == docs.columns
    cut = decontaminate.decontaminated(docs, benchmark, mode="spans")
    assert cut.count() == len(rows) and cut.columns == docs.columns
    assert decontaminate.decontaminated(frame([]), benchmark).count() == 0


def test_repeated_windows_are_compared_once():
    text = "haha " * 100_000
    began = time.perf_counter()
    known = decontaminate.Windows([("1", text), ("2", text + "end"), ("3", "of its own " * 13), (None, text)])
    places, found = known.hits(decontaminate.Words(decontaminate.Block(pa.array([text, "no", text])), decontaminate.ALNUM))
    assert time.perf_counter() - began < 2
    assert len(places) == 2 * (100_000 - 12) and found == {(k, i) for k in (0, 2) for i in (0, 1, 3)}
    assert len(known.by_size[13][0]) == 2 + 3


def test_huge_items_are_cut_between_words(spark):
    r = random.Random(8)
    items = [(1, " ".join(f"w{r.randint(0, 400)}é" for _ in range(900))), (2, "x" * 5000), (3, "a b " + "y" * 3000), (None, "null " * 700), (4, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    parts = decontaminate.cut(benchmark, "item_id", "text", 13, 400).collect()
    assert max(len(p.text.encode()) for p in parts if p.item == "1") <= 400 and len(parts) > 20
    whole, cut = windows([(str(i or None), t) for i, t in items if t]), windows([(str(p.item), p.text) for p in parts])
    assert whole == cut


def test_contamination_without_benchmark(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(frame(ODD), none).filter("n_hit > 0 OR contaminated").count() == 0


def test_quality_on_held_out_documents(spark, frame):
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeinorst") for _ in range(r.randint(2, 7)))
    rows, grades = [], []
    for i in range(900):
        words, grade = [word() for _ in range(r.randint(30, 150))], r.choice([0, 1, 2, 2, 2])
        if grade == 0:
            words = [w + r.choice(["###", "$$$", "&&&"]) for w in words]
        if grade == 1:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["idiot", "moron", "clown", "loser"])
        rows.append((i, " ".join(words)))
        grades.append((i, grade))
    docs, rated = frame(rows), spark.createDataFrame(grades[:600], "doc_id long, grade int")
    model = quality.trained(docs, rated)
    assert list(model.thresholds) == sorted(model.thresholds)
    out = {x.doc_id: x for x in quality.graded(docs, model).collect()}
    held = grades[600:]
    assert np.mean([out[i].kept == (g == 2) for i, g in held]) > 0.97
    means = [np.mean([out[i].expected_grade for i, g in held if g == k]) for k in range(3)]
    assert means == sorted(means)
    assert quality.selected(docs, model).count() == sum(x.kept for x in out.values())
    odd = quality.graded(frame(ODD), model)
    assert odd.count() == len(ODD) and odd.filter("expected_grade IS NULL").count() == 0
    assert quality.graded(frame([]), model).count() == 0 and quality.selected(frame([]), model).count() == 0
    assert quality.selected(frame(ODD), model).columns == frame(ODD).columns and quality.trained(frame([]), rated) is None


def test_toxic_recall_by_language_in_stage_1(spark):
    """Half of the labels is held out: fitted on the other half, stage 1 rejects toxic documents of every language."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    rated = quality.ratings(labels)
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    model = quality.trained(docs, rated.filter(half == 0))
    held = docs.join(rated.filter(half == 1), "doc_id")
    kept = quality.selected(held, model).groupBy("lang", "grade").count().collect()
    every, kept = {(r.lang, r.grade): r["count"] for r in held.groupBy("lang", "grade").count().collect()}, {(r.lang, r.grade): r["count"] for r in kept}
    gone = {k: 1 - kept.get(k, 0) / n for k, n in every.items()}
    share = lambda grade, langs: sum(gone[x, grade] * every[x, grade] for x in langs) / sum(every[x, grade] for x in langs)
    assert share(1, ["en"]) > 0.85 and share(1, ["fr", "de", "es"]) > 0.7
    assert share(0, ["en", "fr", "de", "es"]) > 0.97 and share(2, ["en", "fr", "de", "es"]) < 0.03


def test_likelihood_and_gradient_are_those_by_hand():
    """The loss is the plain sum over documents, and its gradient that of differences."""
    r = np.random.default_rng(2)
    index, value, first = quality.features(pa.array(["some words here", "### more $$$ words", "words words words here", "other", "the last one of all"]))
    grades = np.array([0, 1, 2, 2, 1])
    params = np.zeros((1 << quality.BITS) + quality._SHAPES + 2)
    used = np.unique(index)
    params[used], params[-2:] = r.normal(size=len(used)) / 3, [-0.4, 0.2]
    got, gradient = quality.loss(params, index, value, first, grades, 3)
    cuts, expected = [-np.inf, -0.4, -0.4 + np.exp(0.2), np.inf], 0.0
    for k, g in enumerate(grades):
        s = sum(params[i] * v for i, v in zip(index[first[k] : first[k + 1]], value[first[k] : first[k + 1]]))
        expected -= np.log(1 / (1 + np.exp(s - cuts[g + 1])) - 1 / (1 + np.exp(s - cuts[g]))) / len(grades)
    assert np.isclose(got, expected + quality._DECAY / 2 * (params[: 1 << quality.BITS] ** 2).sum())
    for _ in range(5):
        d = np.zeros_like(params)
        d[used], d[-2:] = r.normal(size=len(used)), r.normal(size=2)
        ahead, behind = (quality.loss(params + e * d, index, value, first, grades, 3)[0] for e in (1e-5, -1e-5))
        assert abs((ahead - behind) / 2e-5 - gradient @ d) < 1e-6


def test_sample_is_of_the_rated_documents_at_hand(spark, frame):
    """Ratings of other documents take no place in the sample, and the features are bounded."""
    rows = [(i, ("good words here " if i % 2 else "### $$$ bad ") * 5 + str(i)) for i in range(200)]
    ratings = spark.createDataFrame([(i, 2 if i % 2 else 0) for i in range(5000)], "doc_id long, grade int")
    docs = frame(rows + rows[:20])
    seen = []
    fit = quality.fit_with_cut
    try:
        quality.fit_with_cut = lambda index, value, first, grades, n: seen.append((len(grades), len(index))) or fit(index, value, first, grades, n)
        assert quality.trained(docs, ratings, sample=150) is not None
        assert quality.trained(docs, ratings, most_features=1000) is not None
    finally:
        quality.fit_with_cut = fit
    assert seen[0][0] == 150 and 10 < seen[1][0] < 150 and seen[1][1] <= 1000


def test_beginnings_are_counted_in_characters_up_to_the_cap():
    a, _, f = quality.features(pa.array(["ééé1 ééé2", "ééé1 ééé2 ééé3", "ééé1 ééé2 ééé3 ééé4"]))
    one, two, four = (set(a[f[i] : f[i + 1]].tolist()) for i in range(3))
    assert len(one) == 7 + 2 + 2 and len(two - one) == 2 and len(four - two) == 1


def test_cut_on_held_out_documents():
    tops = np.linspace(0.6, 1, 200)
    assert np.mean(tops >= quality.least_top(tops)) >= quality.CLEAN and quality.least_top(tops) > 0.6
    assert quality.least_top(tops - 0.5) == quality.LEAST and quality.least_top(tops[: quality.FEWEST - 1]) == quality.LEAST


def test_quality_without_ratings(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.trained(frame(ODD), quality.ratings(labels))
    assert model is None and quality.graded(frame(ODD), model).filter("kept").count() == len(ODD) and quality.selected(frame(ODD), model).count() == len(ODD)
    some = spark.createDataFrame([(1, 0, None), (1, 1, 0), (2, None, 1), (None, 1, 0), (3, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, quality.ratings(some).collect())) == [(1, 0), (3, 1), (4, 2)]


def test_features_of_a_text_stand_alone():
    a, b, f = quality.features(pa.array(["some words here", None, "### more words"]))
    alone = quality.features(pa.array(["### more words"]))
    assert (a[f[2] : f[3]] == alone[0]).all() and np.allclose(b[f[2] : f[3]], alone[1])


def test_rules_are_their_sql(spark, frame):
    rows = [(10, "a b c d e f g h i a b c d e f g h j"), (11, "x " * 40), (12, "\n\n a\n a\nb\n a"), (13, "a b c d e f g h a b c d e f g h"), (14, "é ü #*$ \x0b ñ　z"), (15, "a b c d e f g h " * 6 + "q " * 9), *[(d and d + 100 * k, t) for k, (d, t) in enumerate(ODD)]]
    against_duckdb(rules.judged(frame(rows)), rules.ORACLE_SQL, rows)
    assert rules.judged(frame(ODD)).count() == len(ODD) and rules.judged(frame([])).count() == 0


def test_cascade_asks_in_order_and_keeps_the_verdict(spark):
    docs = spark.range(100).toDF("x")
    a, b, never = rules.Rule("a", F.col("x") < 50), rules.Rule("b", F.col("x") % 2 == 0), rules.Rule("null", F.lit(None).cast("boolean"))
    for order in ([a, b, never], [never, b, a]):
        assert rules.cascade(docs, order).filter(rules.inner("rejected_by").isNull()).count() == 25
    seen = Observation()
    assert rules.cascade(docs, [a, b], seen=seen).filter(rules.inner("rejected_by") == "b").count() == 25
    assert seen.get == {"rows": 100, "a": 50, "b": 25}


def test_rejected_rows_are_not_measured_further(spark):
    """The measure of a later rule fails for the rows that an earlier rule rejects, and is null for them."""
    docs = spark.range(100).toDF("x")
    measures = [rules.Measure("costly", F.when(F.col("x") < 50, F.raise_error(F.lit("a rejected row was measured"))).otherwise(F.col("x")).cast("long"))]
    cheap, costly = rules.Rule("cheap", F.col("x") < 50), rules.Rule("costly", rules.inner("costly") >= 90, ("costly",))
    out = rules.cascade(docs, [cheap, costly], measures)
    assert out.filter(rules.inner("rejected_by").isNull()).count() == 40 and out.filter(rules.inner("costly").isNotNull()).count() == 50
    with pytest.raises(Exception, match="a rejected row was measured"):
        rules.cascade(docs, [costly, cheap], measures).collect()


def test_order_is_by_rejections_and_cost(spark, frame):
    r = random.Random(6)
    docs = frame([(i, " ".join(r.choice(["alpha", "beta", "###", "a", "!!!"]) for _ in range(r.choice([5, 200, 2000])))) for i in range(300)])
    times = rules.timed(docs, rules.standard_rules(), rules.standard_measures())
    rows = {x["rule"]: x for x in rules.report(times)}
    rate = [t.rejected / t.seconds for t in times]
    assert len(rows) == 6 and rate == sorted(rate, reverse=True) and all(x["sampled"] == 300 for x in rows.values())
    assert rows["too short"]["rejected"] == docs.filter("size(split(text, ' ')) < 20").count()
    kept = rules.judged(docs).filter("kept").select("doc_id")
    left = rules.filtered(docs, sample=50)
    assert sorted(x.doc_id for x in left.collect()) == sorted(x.doc_id for x in kept.collect()) and left.columns == docs.columns
    assert rules.filtered(frame(ODD)).count() == rules.judged(frame(ODD)).filter("kept").count() and rules.filtered(frame([])).count() == 0
    assert rules.sampled(docs, "doc_id", "text", 20).count() == 20


@pytest.mark.parametrize("part_rows, copies", [(1_000_000, 100_000), (5, 3)])
def test_shards(spark, frame, monkeypatch, part_rows, copies):
    """With small parts, hot slots and equal rows are numbered and dealt in pieces."""
    monkeypatch.setattr(shards, "PART_ROWS", part_rows)
    monkeypatch.setattr(shards, "COPIES", copies)
    r = random.Random(2)
    rows = [(i, "x" * r.choice([1, 10, 100, 3000])) for i in range(2000)] + [(d and d + 9000, t) for d, t in ODD] + [(None, None)] * 50 + [(77, f"text {i}") for i in range(60)]
    out = shards.assigned(frame(rows), 24).toPandas()
    assert len(out) == len(rows) and set(out.law) == {"bytes"} and out.grown_shard.isna().all() and set(out.version) == {2}
    by = out.groupby("shard")
    assert len(by) == 24 and all(sorted(g.slot) == list(range(len(g))) for _, g in by)
    expected = sorted((repr(d), 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((repr(None if x != x else int(x)), int(a), int(b)) for x, a, b in zip(out.doc_id, out["size"], out.text_crc32)) == expected
    loads = sorted(by["size"].sum())
    assert loads[-3] - loads[0] < 3300
    assert shards.assigned(frame([]), 24).count() == 0


@pytest.mark.parametrize("hot", [(None, "x" * 1000), (5, "x" * 1000), (5, None)])
def test_equal_rows_and_ids_spread_over_the_shards(spark, hot):
    doc_id, text = hot
    rows = [(doc_id, text or f"{i}" * 200) for i in range(6000)] + [(100 + i, f"{i % 9}" * 1000) for i in range(6000)]
    out = shards.assigned(spark.createDataFrame(rows, "doc_id long, text string"), 24)
    loads = [r.b for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 24 and max(loads) < 1.1 * sum(loads) / 24
    assert out.groupBy("shard").agg(F.countDistinct("slot").alias("n"), F.max("slot").alias("m"), F.count("*").alias("c")).filter("n <> c OR m <> c - 1").isEmpty()


def test_stored_maps(spark, frame, tmp_path):
    folder, rows = str(tmp_path / "map"), [(i, "x" * (i % 50)) for i in range(3000)]
    shards.append_version(shards.first_map(spark, 4), folder)
    first = {r.doc_id: (r.shard, r.vslot, r.version) for r in shards.assigned(frame(rows), 4, folder).collect()}
    assert {v for _, _, v in first.values()} == {1}
    size = shards.records(frame(rows)).groupBy("vslot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"))
    assert shards.rebalance(folder, size, 5).first().version == 2
    after = {r.doc_id: (r.shard, r.vslot, r.version) for r in shards.assigned(frame(rows), 5, folder).collect()}
    assert {v for _, _, v in after.values()} == {2} and {s for s, _, _ in after.values()} == set(range(5))
    assert all(after[i][1] == first[i][1] for i in first) and 0.1 < np.mean([after[i][0] != first[i][0] for i in first]) < 0.35
    assert shards.stored_map(spark, folder, 1).filter("shard = 4").count() == 0


def test_rebalancing_moves_few_slots(spark):
    slots = shards.first_map(spark, 4, 64)
    size = spark.range(64).selectExpr("id AS vslot", "CASE WHEN id < 16 THEN 200L ELSE 100L END AS bytes")
    after = shards.rebalanced(slots, size, 4)
    moved = slots.alias("a").join(after.alias("b"), "vslot").filter("a.shard <> b.shard").count()
    loads = [r[0] for r in after.join(size, "vslot").groupBy("shard").sum("bytes").select("sum(bytes)").collect()]
    assert after.first().version == 2 and max(loads) - min(loads) <= 200 and 0 < moved <= 16
    assert shards.rebalanced(after, size, 5).select("shard").distinct().count() == 5
