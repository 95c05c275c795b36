"""Line quality, line dedup and license scans: SQL, brute force and odd inputs."""

import random
import re

import pytest
from compare import connect, difference

from llm_cases import CLASHES, ODD, SMALL, make_docs  # noqa: F401  a fixture

from pagoscope.llm import license_scan, line_dedup, quality_rules
from pagoscope.llm.queries import ORACLE, QUERIES

@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, name):
    assert difference(QUERIES[name](spark, SMALL), connect(SMALL), ORACLE[name]) is None

def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))

def test_quality_against_brute_force(make_docs):
    texts = [t for t in ODD if t is None or len(t) < 6000] + [
        "a b c d e f a b c d e x a b c d e", "tab\tvt\x0bff\x0c nbsp x # $$ |", "l\nl\r\nl\n\nl",
    ]
    rows = {r.doc_id: r for r in quality_rules.clean_lines(make_docs(*texts, clash=CLASHES)).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text), text
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)

def test_line_rules(make_docs):
    prose = "This sentence has quite enough words to stand as prose of its own."
    menu = "Home | About | Contact | Login"
    docs = make_docs(f"{prose}\n{menu}\nAll rights reserved.\nfragment", f"{menu}\n" * 3 + "Home | About | Shop | Help")
    first, second = quality_rules.clean_lines(docs).orderBy("doc_id").collect()
    assert first.clean_text == prose and first.kept
    assert first.lines_removed == {"punctuation": 1, "navigation": 1, "boilerplate": 1}
    assert second.clean_text == "" and not second.kept

def test_empty_tables(make_docs, spark):
    empty = make_docs("x").limit(0)
    assert quality_rules.clean_lines(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert license_scan.scan(empty).count() == 0

def test_line_dedup_cases(make_docs):
    # long enough that chunks of two lines and more fall into it wherever it stands
    passage = "\n".join(f"line {i} of the passage that many texts share" for i in range(40))
    docs = make_docs((1, passage), (2, f"own start\n{passage}\nown end"), (3, passage), (3, passage), (4, None), (5, ""),
                     (None, passage), (6, "same\nother"), (7, "same"), clash=CLASHES)
    rows = line_dedup.dedup_lines(docs).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 9 and by_id[1].n_lines_removed == 0 and by_id[1].clean_text == passage
    assert by_id[2].n_lines_removed > 25
    assert by_id[2].clean_text.startswith("own start") and by_id[2].clean_text.endswith("own end")
    assert [r.n_lines_removed for r in rows if r.doc_id == 3] == [by_id[3].n_lines_removed] * 2
    assert by_id[3].n_lines_removed == by_id[None].n_lines_removed > 25
    assert by_id[4].clean_text is None and by_id[4].n_lines == 0 and by_id[5].clean_text == ""
    assert by_id[7].clean_text == "same"  # single lines stay

def test_chunks_are_told_apart_without_their_text(make_docs, monkeypatch):
    shared = "\n".join(f"line {i} of the passage that many texts share" for i in range(40))
    docs = make_docs(*((i, f"own start {i}\n{shared}\nown end {i}") for i in range(20)), (20, "one\ntwo"), (20, "two\none"))
    tables, real = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda frame, name: tables.append(frame) or real(frame, name))
    repeated = line_dedup.repeated_chunks(docs).collect()
    assert tables and not any("string" in t.schema.simpleString() for t in tables)
    where = {}
    for row in line_dedup.chunked(docs).collect():
        for start, n in row.chunks:
            if n >= line_dedup.MIN_LINES:
                where.setdefault("\n".join(row.lines[start:start + n]), []).append((row.key.doc_id, start, n))
    wanted = sorted(place for places in where.values() for place in sorted(places)[1:])
    assert wanted and sorted((r.key.doc_id, r.start, r.n_lines) for r in repeated) == wanted

@pytest.mark.parametrize("n_lines", [1, 2, 3, 5, 10])
def test_passages_between_foreign_lines(make_docs, n_lines):
    # 54 words or more: 60, 30, 20 words a line and so on, a blank line in between
    def passage(p):
        lines = [" ".join(f"p{p}l{i}w{k}" for k in range(-(-60 // n_lines))) for i in range(n_lines)]
        return "\n".join([*lines[:1], *([""] if n_lines > 1 else []), *lines[1:]])

    def foreign(p, side):
        return f"own {side} line of text {p}\nand one more {side} line of text {p}"

    texts = [(p, passage(p)) for p in range(8)]
    texts += [(100 + p, f"{foreign(p, 'head')}\n{passage(p)}\n{foreign(p, 'tail')}") for p in range(8)]
    texts += [(None, passage(0)), (300, " ".join(f"n{i}" for i in range(49))), (301, " ".join(f"n{i}" for i in range(49)))]
    docs = make_docs(*texts, clash=CLASHES)
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs, passages=True).collect()}
    for p in range(8):
        assert rows[p].n_lines_removed == 0 and rows[p].clean_text == passage(p)
        assert rows[100 + p].clean_text == f"{foreign(p, 'head')}\n{foreign(p, 'tail')}"
        assert rows[100 + p].n_lines_removed == passage(p).count("\n") + 1
    assert rows[None].clean_text == "" and rows[301].n_lines_removed == 0  # below MIN_WORDS

def removed_by_brute_force(texts):
    """Lines that lie in a run of 50 words or more that stands at an earlier place too."""
    lines = [[(i, x, len(x.split())) for i, x in enumerate(t.split("\n")) if x.split()] for t in texts]
    seen, gone = set(), [set() for _ in texts]
    for d, own in enumerate(lines):
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                if sum(n for _, _, n in own[a:b]) >= 50:
                    run = tuple(x for _, x, _ in own[a:b])
                    if run in seen:
                        gone[d] |= {i for i, _, _ in own[a:b]}
                    seen.add(run)
    return gone

def test_passages_against_brute_force(make_docs):
    r = random.Random(11)
    pool = [" ".join(r.choice("abcdef") + str(i) for _ in range(r.choice([1, 2, 4, 9, 20, 70]))) for i in range(40)]
    texts = []
    for _ in range(30):
        own = [x for at in [r.randrange(40) for _ in range(4)] for x in pool[at:at + r.randint(1, 12)]]
        texts.append("\n".join(x for line in own for x in ([line, ""] if r.random() < 0.1 else [line])))
    docs = make_docs(*texts)
    got = {}
    for row in line_dedup.repeated_passages(docs).collect():
        got.setdefault(row.key.doc_id, set()).update(range(row.start, row.start + row.n_lines))
    # lines without a word are no matter
    worded = [{i for i, x in enumerate(t.split("\n")) if x} for t in texts]
    assert [got.get(i, set()) & worded[i] for i in range(30)] == removed_by_brute_force(texts)
    assert "Python" not in line_dedup.dedup_lines(docs, True, True)._jdf.queryExecution().executedPlan().toString()

def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    places = [i for i, _ in found]
    return (len(words), len(found), min(places, default=None), max(places, default=None),
            ",".join(sorted({x for _, x in found})))

LICENSE_TEXTS = [
    *ODD, "Released under the MIT License.", "UNDER--the mit\nlicense, under the MIT license",
    "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "cc by nc cc by nc",
    "die mit der license", "This work is licensed under the GNU General Public License, version 3.",
    "permission is hereby granted to nobody", "Kelvin under the mit license İ", "under the mit licenses",
]

def test_license_scan_against_brute_force(make_docs):
    rows = {r.doc_id: r for r in license_scan.scan(make_docs(*LICENSE_TEXTS, clash=CLASHES)).collect()}
    for i, text in enumerate(LICENSE_TEXTS):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    by_text = {LICENSE_TEXTS[i]: r for i, r in rows.items()}
    assert by_text["This work is licensed under the GNU General Public License, version 3."].labels == "gpl-3"
    assert by_text["permission is hereby granted to nobody"].labels == ""
    assert by_text["die mit der license"].labels == ""

def test_license_titles_at_the_start(make_docs):
    texts = [phrase for _, _, phrase in license_scan.TEMPLATES]
    texts += [f"The {phrase}" for _, _, phrase in license_scan.TEMPLATES]
    titles = {
        "GNU General Public License Version 3, 29 June 2007": "gpl-3", "GNU Lesser General Public License": "lgpl",
        "GNU Affero General Public License": "agpl-3", "CC0 1.0 Universal": "cc0", "CC BY-SA 4.0": "cc-by-sa",
        "Creative Commons Attribution 4.0 International": "cc-by", "General Public License version 3": "",
    }
    rows = {r.doc_id: r for r in license_scan.scan(make_docs(*texts, *titles)).collect()}
    for i, (label, _, _) in enumerate(license_scan.TEMPLATES * 2):
        assert label in rows[i].labels.split(","), texts[i]
    assert [rows[len(texts) + i].labels for i in range(len(titles))] == list(titles.values())
    assert all(0 <= r.score <= 1 for r in rows.values())

def test_license_of_full_notices(make_docs):
    # more lexicon words than any fixed number of a file's rarest ones
    templates = [t for _, t, _ in license_scan.TEMPLATES]
    notices = " ".join([*templates[1:2], *(t for t in templates if t.startswith("redistribution"))])
    two = "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-SA 4.0"
    docs = make_docs(f"{notices} {two}", ". ".join(templates), *[two] * 20)
    rows = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert rows[0].labels == "bsd,cc-by-sa,gpl-3,mit"
    assert rows[1].labels == ",".join(sorted({label for label, _, _ in license_scan.TEMPLATES}))
    assert sorted(f.label for f in rows[1].found) == sorted(label for label, _, _ in license_scan.TEMPLATES)

def test_license_query_covers_the_table(spark):
    rows = QUERIES["op4_license_scan"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(texts[r.doc_id])

@pytest.mark.parametrize("build", [quality_rules.clean_lines, line_dedup.dedup_lines])
def test_no_python_in_native_plans(make_docs, build):
    plan = build(make_docs("a b c"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
