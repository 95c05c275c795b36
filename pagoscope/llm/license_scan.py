"""License scans over a positional index of rare licence words.

The words of all licence templates form one small lexicon. Its words' document frequencies
come from all documents. Each template is indexed by the ``KEY_WORDS`` words of highest IDF
of its mandatory key phrase, and a file is looked up by all of those that it holds: every
place of such a word votes, per template posting, for the place where the template would
start. So no template crowds out another, and a key phrase that stands in full always has
its votes. Where two postings or more agree on a start, the key phrase must stand at its own
offset; the share of the template's words that stand in place is the score. A start is
negative where a text begins with the key phrase, without the words before it.

Besides, the base phrases are found exactly, at every place.

Defined cases: a null text is an empty text; texts without words have zero counts, null
places, empty labels and score 0; equal rows give equal rows; an empty table gives an empty
table (no document frequency is needed then); other columns are ignored.

At scale: one pass counts lexicon words (a row per word and task), at most a few hundred
numbers reach the driver, whose number the templates fix; the second pass works inside rows
and shuffles nothing. Long files cost in proportion to their words.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from pagoscope.llm.common import documents

# Base phrases and their labels, then the anchor word (its offset) of each.
BASE = (
    (("under", "the", "mit", "license"), "mit", 2),
    (("apache", "license", "version", "2"), "apache-2", 0),
    (("cc", "by", "nc"), "cc-by-nc", 0),
)

# Label, template, mandatory key phrase (a part of the template).
TEMPLATES = (
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this"
            " software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license",
     "creative commons attribution 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0 universal"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3",
     "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2",
     "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3",
     "gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are"
            " permitted provided that the following conditions are met",
     "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or"
            " without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
)
# Every key phrase and base phrase holds one of these; a text without them is not looked up.
HINTS = ("licen", "cc", "permission", "redistribution", "unencumbered", "creative", "distribute")

KEY_WORDS = 2  # indexed words of each key phrase; fewer could never agree on a start
WORD = r"[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
LEXICON = tuple(sorted({w for _, t, _ in TEMPLATES for w in t.split()}))


def _list(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _tokens(docs: DataFrame) -> DataFrame:
    # lower() also maps a few non-ASCII letters; the one that would turn into an ASCII
    # letter alone (the Kelvin sign) is put out of its way first
    return documents(docs).selectExpr(
        "doc_id", "lower(replace(coalesce(text, ''), '\\u212A', '\\u0137')) as low"
    ).selectExpr("doc_id", "low", f"regexp_extract_all(low, '{WORD}', 0) as words")


def lexicon_by_idf(docs: DataFrame) -> list[tuple[str, float]]:
    """The lexicon's words with their IDF over all documents, rarest first.

    At most as many rows as the lexicon has words reach the driver.
    """
    counts = (
        _tokens(docs)
        .select(F.explode(F.concat(
            F.array(F.lit("")),  # counts the documents themselves
            F.expr(f"array_intersect({_list(LEXICON)}, words)"),
        )).alias("word"))
        .groupBy("word").count().collect()
    )
    df = {row["word"]: row["count"] for row in counts}
    total = df.get("", 0)
    idf = [(w, math.log((total + 1) / (df.get(w, 0) + 1))) for w in LEXICON]
    return sorted(idf, key=lambda x: (-x[1], x[0]))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, found: array of (label, start, share) of the verified templates."""
    rank = {w: i for i, (w, _) in enumerate(lexicon_by_idf(docs))}
    rows = []
    for number, (_, template, phrase) in enumerate(TEMPLATES):
        words, key = template.split(), phrase.split()
        chosen = sorted(set(key), key=rank.__getitem__)[:KEY_WORDS]
        offset = _offset(words, key)
        rows += [(w, number, offset + place) for place, w in enumerate(key) if w in chosen]
    postings = {w: [(n, p) for x, n, p in rows if x == w] for w in sorted({w for w, _, _ in rows})}
    index = "map(" + ", ".join(
        f"'{w}', array({', '.join(f'struct({n} as t, {p} as p)' for n, p in places)})"
        for w, places in postings.items()
    ) + ")"
    templates = "array(" + ", ".join(_list(t.split()) for _, t, _ in TEMPLATES) + ")"
    phrases, offsets = [], []
    for _, template, phrase in TEMPLATES:
        words, key = template.split(), phrase.split()
        offsets.append(_offset(words, key))
        phrases.append(_list(key))
    key_phrases = f"array({', '.join(phrases)})"
    key_places = f"array({', '.join(map(str, offsets))})"
    labels = _list(label for label, _, _ in TEMPLATES)
    hint = " or ".join(f"contains(low, '{h}')" for h in HINTS)

    words = _tokens(docs).selectExpr("doc_id", "words", f"({hint}) as hinted")
    looked_up = words.selectExpr(
        "doc_id", "words",
        "case when hinted then "
        f"array_intersect({_list(postings)}, words) else array() end as keys",
        "case when hinted then filter(transform(words, (w, i) -> "
        "case when w in ('mit', 'apache', 'cc') then i end), i -> i is not null) else array() end as anchors",
    )
    hits = looked_up.selectExpr(
        "doc_id", "words", "anchors",
        "case when size(keys) > 1 then filter(transform(words, (w, i) -> struct(w, i)), "
        "x -> array_contains(keys, x.w)) else array() end as hits",
    )
    votes = hits.selectExpr(
        "doc_id", "words", "anchors",
        f"sort_array(flatten(transform(hits, x -> transform(element_at({index}, x.w), "
        "q -> struct(q.t as t, x.i - q.p as start))))) as votes",
    )
    starts = votes.selectExpr(
        "doc_id", "words", "anchors",
        # the words before the key phrase may be cut off by the text's start; of the equal
        # votes side by side the second stands for all
        f"filter(votes, (v, k) -> v.start + {_at(key_places, 'v.t')} >= 0 and v = get(votes, k - 1) "
        "and not coalesce(v = get(votes, k - 2), false)) as starts",
    )
    verified = starts.selectExpr(
        "doc_id", "words", "anchors",
        "filter(starts, s -> size(filter("
        f"{_at(key_phrases, 's.t')}, (w, k) -> not coalesce("
        f"get(words, s.start + {_at(key_places, 's.t')} + k) = w, false))) = 0) as verified",
    )
    found = verified.selectExpr(
        "doc_id", "words", "anchors",
        f"transform(verified, s -> struct({_at(labels, 's.t')} as label, s.start as start, "
        f"size(filter({_at(templates, 's.t')}, (w, k) -> coalesce(get(words, s.start + k) = w, false))) "
        f"/ cast(size({_at(templates, 's.t')}) as double) as share)) as found",
    )
    base = found.selectExpr(
        "doc_id", "words", "found",
        "sort_array(flatten(array("
        + ", ".join(
            f"transform(filter(anchors, i -> "
            + " and ".join(
                f"coalesce(get(words, i + {k - anchor}) = '{w}', false)" for k, w in enumerate(phrase)
            )
            + f"), i -> struct(i - {anchor} as place, '{label}' as label))"
            for phrase, label, anchor in BASE
        )
        + "))) as base",
    )
    return base.selectExpr(
        "doc_id", "cast(size(words) as long) as n_words", "cast(size(base) as long) as n_base",
        "cast(array_min(transform(base, b -> b.place)) as long) as first_word",
        "cast(array_max(transform(base, b -> b.place)) as long) as last_word",
        "array_join(array_sort(array_distinct(transform(base, b -> b.label))), ',') as base_labels",
        "array_join(array_sort(array_distinct(concat(transform(base, b -> b.label), "
        "transform(found, f -> f.label)))), ',') as labels",
        "round(greatest(case when size(base) > 0 then 1D else 0D end, "
        "coalesce(array_max(transform(found, f -> f.share)), 0D)), 6) as score",
        "found",
    )


def _offset(words: list[str], key: list[str]) -> int:
    """Where the key phrase stands in its template."""
    return next(i for i in range(len(words)) if words[i:i + len(key)] == key)


def _at(items: str, place: str) -> str:
    return f"get({items}, {place})"
