"""License phrases against a plain search, and labels of the method."""

import random
import re

from pagewright.llm import licenses

PARTS = ["under", "the", "mit", "MIT", "license", "License,", "apache", "Apache", "version", "2", "2.0", "cc", "CC", "BY-NC", "by", "nc", "é", "\n", "日本", "under the mit license", "cc by nc", "apache license version 2"]


def _plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_base_phrases(spark):
    pick = random.Random(4)
    rows = [(i, pick.choice([" ", ".", "--"]).join(pick.choices(PARTS, k=pick.randint(0, 25))), 1) for i in range(800)]
    rows += [(None, None, 1), (7000, "", 1), (7001, "cc by nc " * 20_000, 1), (7002, "cc by nc by nc", 1), (7002, "cc by nc by nc", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _plain(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.score == 1 or not r.n_base
    assert licenses.scan(docs.limit(0)).count() == 0


def test_method_labels(spark):
    rows = [
        (1, "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met:"),
        (2, "this work is licensed under the GNU General Public License, version 3."), (3, "the work of a license and the public domain of versions"),
        (4, "Permission is hereby granted, free of charge, to any natural person obtaining a copy of this software and the associated documentation files (the Software), to deal in the Software without restriction"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4)] == ["bsd", "gpl-3", "", "mit"]
    assert 0.6 <= got[1].score < 1 and got[2].score == 1 and got[3].score == 0 and not got[4].n_base


def _labels(text):
    """Labels and score by trying each place of each template in the text."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    runs = {}
    for i in range(len(words) - 2):
        runs.setdefault(tuple(words[i : i + 3]), []).append(i)
    labels, score = set(), 0.0
    for phrase, label in licenses.PHRASES:
        n = len(phrase.split())
        if any(words[i : i + n] == phrase.split() for i in range(len(words))):
            labels.add(label)
            score = 1.0
    for template, label in licenses.TEMPLATES:
        t = template.split()
        places = [(i - at, at) for at in range(len(t) - 2) for i in runs.get(tuple(t[at : at + 3]), [])]
        for d in {d for d, _ in places}:
            found = {at for e, at in places if abs(e - d) <= licenses.LEAP}
            said = {at + j for at in found for j in range(3)}
            if len(found) / (len(t) - 2) >= licenses.COVER and len(said) / len(t) >= licenses.WORDS:
                labels.add(label)
                score = max(score, len(found) / (len(t) - 2))
    return ",".join(sorted(labels)), score


def test_labels_equal_a_search_of_all_places(spark):
    pick = random.Random(8)
    rows = []
    for i in range(600):
        words = " ".join(pick.choice(licenses.TEMPLATES)[0] for _ in range(pick.randint(1, 3))).split()
        for _ in range(pick.randint(0, 8)):
            at = pick.randrange(len(words) + 1)
            pick.choice([lambda: words.insert(at, "other"), lambda: words.__delitem__(slice(at, at + pick.randint(1, 6))), lambda: words.insert(at, words[at - 1] if words else "x")])()
        rows.append((i, " ".join(words)))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len({r.labels for r in got}) > 10
    for r in got:
        assert (r.labels, r.score) == _labels(rows[r.doc_id][1])


def test_a_run_counts_once(spark):
    rows = [(1, "under the mit roof under the mit"), (2, "gnu general public " * 5_000), (3, "of the gnu of the gnu of the gnu general public"), (4, "under the mit " * 40_000)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [(r.labels, r.score) for r in got] == [("", 0.0)] * 4


def test_places_of_a_template(spark):
    said = "this work is licensed under the gnu general public license version 3"
    docs = spark.createDataFrame([(7, 1, f"{said} and {said}")], "row_key bigint, doc_id bigint, text string")
    got = sorted((r.start, r.stop) for r in licenses.spans(docs).filter("label = 'gpl-3'").collect())
    assert got == [(0, 12), (13, 25)]


def test_hits_are_moved_once(spark):
    docs = spark.createDataFrame([(1, "cc by nc")], "doc_id bigint, text string")
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastHashJoin") == 1
