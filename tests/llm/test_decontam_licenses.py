"""Greedy string tiling and license scans against brute force and planted cases."""

import os
import random
import re
import subprocess
import sys
import textwrap

import numpy as np
from pyspark.sql import functions as F

from shelfwise.llm import decontam, licenses
from shelfwise.llm.common import table
from shelfwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, item_id int, coverage string"


def brute_tiles(doc, item, least):
    """Greedy string tiling by trying every pair of positions, longest match first."""
    used_d, used_i, covered, tiles = set(), set(), 0, 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in used_d and j + n not in used_i:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered, tiles
        used_d.update(range(i, i + n)), used_i.update(range(j, j + n))
        covered, tiles = covered + n, tiles + 1


def test_tiles_equal_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        words = [f"w{k}" for k in range(rng.choice([4, 30]))]
        item = [rng.choice(words) for _ in range(rng.randint(5, 25))]
        doc = [rng.choice(words) for _ in range(20)]
        for _ in range(3):
            s = rng.randrange(len(item))
            doc[rng.randrange(len(doc)):][:0] = []
            at = rng.randrange(len(doc))
            doc[at:at] = item[s:s + rng.randint(3, 12)]
        table_ = decontam.SeedTable([(1, " ".join(item))], 3)
        found = list(table_.contaminations([" ".join(doc)], 0.01))
        covered, tiles = brute_tiles(doc, item, 3)
        if not covered:
            assert not found
        else:
            assert found[0][3] == covered


def test_tiles_of_repetitive_texts_equal_brute_force_in_small_steps(monkeypatch):
    monkeypatch.setattr(decontam, "ENDS_AT_ONCE", 7)
    monkeypatch.setattr(decontam, "PIECE", 11)
    rng = random.Random(9)
    for _ in range(60):
        words = ["a", "b", "c"][:rng.randint(1, 3)]
        item = [rng.choice(words) for _ in range(rng.randint(3, 9))]
        doc = [rng.choice([*words, "zz"]) for _ in range(rng.randint(0, 60))]
        texts = ["zz " * rng.randint(0, 9), " ".join(doc), None]
        found = list(decontam.SeedTable([(1, " ".join(item)), (2, "c c c a b")], 3).contaminations(texts, 0.01))
        covered, tiles = brute_tiles(doc, item, 3)
        assert [(f[0], f[3]) for f in found if f[1] == 1] == ([(1, covered)] if covered else [])


def test_only_matches_that_no_tile_needs_are_left_out():
    rng = random.Random(3)
    for _ in range(40):
        item_words = rng.randint(6, 14)
        matches = sorted({(rng.randrange(4000), t, rng.randint(3, item_words - t)) for t in [rng.randrange(item_words - 3) for _ in range(600)]})
        every = np.array(matches, np.int64).T
        assert decontam.greedy_tiles(decontam.first_matches(every, item_words, 3), item_words, 3) == decontam.greedy_tiles(every, item_words, 3)


def test_five_million_equal_words_stay_small():
    code = ("import resource, sys; sys.path.insert(0, '.')\n"
            "from shelfwise.llm import decontam\n"
            "table = decontam.SeedTable([(1, 'word ' * 60), (2, 'word ' * 40 + 'other ' * 40)])\n"
            "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
            "found = list(table.contaminations(['word ' * 5_000_000]))\n"
            "assert [f[:2] + f[3:] for f in found] == [(0, 1, 60, 60, 1, 60)], found\n"
            "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert int(out.stdout) < 500_000  # kB


def test_query_finds_every_whole_item_and_no_fragment(spark):
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op3_greedy_tiling_decontamination"](spark, SF).collect()}
    items = {r.item_id: b" ".join(decontam.words_of(r.text)) for r in table(spark, SF, "benchmark").collect()}
    docs = {r.doc_id: b" ".join(decontam.words_of(r.text)) for r in table(spark, SF, "documents").collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert whole <= set(got) and len(whole) > 10
    for (d, i), r in got.items():
        words, held = items[i].split(), docs[d].split()
        assert brute_tiles(held, words, 5)[0] == r.covered_words if len(held) < 400 else True
        assert r.coverage >= decontam.COVERAGE


def test_reordered_passages_chunks_and_edge_cases(spark):
    rng = random.Random(6)
    words = [f"word{k}" for k in range(40)]
    halves = [" ".join(words[:20]), " ".join(words[20:])]
    item = ", ".join(halves) + "."
    filler = " ".join(f"x{rng.randrange(900)}" for _ in range(300))
    rows = [(1, filler + " " + halves[1].upper() + " between " + halves[0] + " " + filler, 1, ""), (2, filler, 1, ""), (3, None, 1, ""), (4, "", None, None),
            (5, " ".join(words[:12]), 1, ""), (6, item, 1, ""), (6, item, 1, ""), (None, item, 1, ""), (7, "word1 " * 3000, 1, "")]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([(10, item), (10, item), (11, "too short"), (12, None), (13, "word1 " * 30), (None, "a b c d e f g")], "item_id bigint, text string")
    for chunk in (1 << 20, 60):
        got = sorted(((r.doc_id, r.item_id, r.tiles) for r in decontam.contaminated_pairs(docs, bench, chunk_bytes=chunk).collect()), key=str)
        assert got == sorted([(1, 10, 2), (6, 10, 1), (6, 10, 1), (None, 10, 1), (7, 13, 1)], key=str)
        kept = decontam.keep_clean(docs, bench, chunk_bytes=chunk)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert decontam.contaminated_pairs(docs.where("false"), bench).count() == 0
    assert decontam.contaminated_pairs(docs, bench.where("false")).count() == 0


#: notices that the given tables hold, with their family
NOTICES = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.": "GPL",
           "Licensed under the Apache License, Version 2.0.": "Apache", "Released under the MIT License.": "MIT"}


def test_license_query_finds_all_notices(spark):
    got = {(r.doc_id, r.paragraph_no): r for r in QUERIES["op4_license_paragraphs"](spark, SF).collect()}
    expected = {}
    for r in table(spark, SF, "documents").select("doc_id", "text").collect():
        for k, line in enumerate((r.text or "").split("\n")):
            for notice, family in NOTICES.items():
                if notice in line:
                    expected[r.doc_id, k] = family
    assert len(expected) > 20
    assert {k: r.family for k, r in got.items() if r.confirmed} == expected


def test_license_families_unknowns_and_edge_cases(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = licenses.fit(docs)
    prose = docs.select("text").first().text.replace("\n", " ")
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts]
    families = [f for f, ts in licenses.TEMPLATES.items() for _ in ts]
    rows = [(i, f"some heading\n\n{t}\n{prose[:300]}", 1, "") for i, t in enumerate(texts)]
    rows += [(900 + i, t, 1, "") for i, t in enumerate(licenses.LOOK_ALIKES)] + [(990, None, 1, ""), (991, "", None, None), (992, " \n\t\n", 1, ""), (993, prose * 3, 1, "")]
    got = licenses.scan(spark.createDataFrame(rows, DOCS), model).collect()
    right = {r.doc_id: r.family for r in got if r.confirmed}
    assert all(r.paragraph_no == 2 for r in got if r.doc_id < 900)
    assert sum(right.get(i) == f for i, f in enumerate(families)) >= len(families) - 1
    assert all(right[i] == families[i] for i in right if i < 900)
    assert not [r for r in got if r.doc_id >= 900 and r.confirmed]
    assert licenses.scan(docs.where("false"), model).count() == 0


def test_wrapped_license_notices(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = licenses.fit(docs)
    prose = docs.select("text").first().text.replace("\n", " ")[:200]
    texts = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    rows, expected = [], {}
    for i, (family, t) in enumerate(texts):
        for k, (width, lead, mark) in enumerate([(72, "", ""), (72, "", "# "), (40, "", " * "), (72, "Copyright 2020 by the authors of this small library, all. ", "")]):
            lines = textwrap.wrap(lead + t, width, break_long_words=False, break_on_hyphens=False)
            if len(lines) > 1:
                rows.append((10 * i + k, "\n".join(["some heading", "", *(mark + x for x in lines), "", prose]), 1, ""))
                expected[10 * i + k] = family
    assert len(expected) > 30
    got = [r for r in licenses.scan(spark.createDataFrame(rows, DOCS), model).collect() if r.confirmed]
    by_doc = {d: {(r.family, r.paragraph_no) for r in got if r.doc_id == d} for d in expected}
    missed = [d for d in expected if expected[d] not in {f for f, _ in by_doc[d]}]
    assert not missed, missed
    assert all(n in (2, 3) for places in by_doc.values() for _, n in places)
    # a blank line ends a paragraph
    cut = "Permission is hereby granted, free of charge, to any person\n\nobtaining a copy of this software and associated documentation files"
    assert not [r for r in licenses.scan(spark.createDataFrame([(1, cut, 1, "")], DOCS), model).collect() if r.confirmed]


def brute_windows(text, containment=licenses.CONTAINMENT):
    """Every window of every template, and of those that overlap the largest: (first line, last line, template)."""
    tokens = [(w, n) for n, line in enumerate(text.split("\n")) for w in ([""] if not line.strip(" \t\r") else re.findall(licenses.WORD, line.lower()))]
    held = []
    for w in licenses.wordings(containment):
        for s in range(len(tokens)):
            run = tokens[s:s + w.window]
            run = run[:next((i for i, t in enumerate(run) if t[0] == ""), len(run))]
            at = [i for i in range(len(run) - 1) if f"{run[i][0]} {run[i + 1][0]}" in w.pairs]
            matched = len({f"{run[i][0]} {run[i + 1][0]}" for i in at})
            if at and at[0] == 0 and matched / len(w.pairs) >= containment:
                end = s + at[-1] + 1
                held.append(((matched, matched / len(w.pairs), s - end, -s, -w.number), s, end, run[0][1], tokens[end][1], w.template))
    return sorted((first, last, template) for o, s, e, first, last, template in held if not any(a <= e and b >= s and p > o for p, a, b, *_ in held))


def test_windows_equal_brute_force(spark):
    rng = random.Random(9)
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts]
    rows = []
    for i in range(200):
        words = []
        for _ in range(rng.randint(1, 4)):
            notice = rng.choice(texts).split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):  # words lost, put in or changed
                k = rng.randrange(len(notice) + 1)
                notice[k:k + rng.randint(0, 1)] = rng.choice([[], ["extra"], [rng.choice(rng.choice(texts).split())]])
            words += rng.choice([[], ["Copyright", "2020", "-", "*"], notice[: len(notice) // 2]]) + notice
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\n", "\n# ", "\r\n"] + ["\n\n"] * (rng.random() < 0.1)) for w in words), 1, ""))
    found = licenses.windows(spark.createDataFrame(rows, DOCS)).collect()
    got = {i: sorted((r.paragraph_no, r.last_no, r.template) for r in found if r.doc_id == i) for i in range(200)}
    want = {i: brute_windows(text) for i, text, *_ in rows}
    assert got == want and sum(map(len, want.values())) > 200


def test_wrapped_notices_have_one_family_each(spark):
    """The family is the largest template's and the probability its own; line breaks may stand anywhere."""
    model = licenses.fit(table(spark, SF, "documents"))
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    nc = "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International\nLicense."
    long = "word " * 5000
    cases = {1: ("This work is licensed under a Creative Commons Attribution 4.0\nInternational License.", {"CC-BY"}),
             2: ("This work is licensed under a Creative Commons Attribution 4.0 International\nLicense.", {"CC-BY"}),
             3: (nc + "\nThis work is licensed under the GNU General Public License, version 3.", {"CC-BY-NC", "GPL"}),
             4: ("\n".join(bsd.split()), {"BSD"}), 5: (long + bsd.replace(" and ", "\nand ") + " " + long, {"BSD"}),
             6: ("Permission is\ngranted to enter the general\npublic library", set())}
    docs = spark.createDataFrame([(i, t, 1, "") for i, (t, _) in cases.items()] + [(4, cases[4][0], 1, ""), (None, cases[1][0], None, None)], DOCS)
    clash = docs.selectExpr("*", "'x' as family", "0.5 as probability", "'y' as __grams", "text as paragraph")
    got = [r for r in licenses.scan(clash, model).collect() if r.confirmed]
    for i, (_, families) in cases.items():
        mine = [r for r in got if r.doc_id == i]
        assert {r.family for r in mine} == families and len(mine) == len(families) * (2 if i == 4 else 1), (i, mine)
    assert [r.family for r in got if r.doc_id is None] == ["CC-BY"]
    assert all(r.probability >= model.threshold for r in got)
    assert licenses.scan(docs, licenses.fit(docs.where("false"))).where("confirmed").count() >= 6


def test_license_scan_runs_no_python(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    plan = licenses.scan(docs, licenses.fit(docs))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_rolling_hash_is_position_free():
    ids = np.array([1, 2, 3, 4, 1, 2, 3, 4, 9])
    h = decontam.rolling(ids, 3)
    assert h[0] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 5


def test_license_model_learns_from_every_paragraph(spark):
    """All distinct paragraphs of any length count, in either half, and the threshold is that of all of them."""
    known = set(licenses.vocabulary(spark))
    texts = [f"license number{i} of the work" for i in range(2500)] + ["filler " * 1000 + "permission is hereby granted", "no such gram"]
    docs = spark.createDataFrame([(i, f"{t}\n\n{texts[0]}", 1, "") for i, t in enumerate(texts)] + [(9000, None, 1, "")], DOCS)
    got = {}
    for r in licenses.gram_sets(docs).collect():
        got[tuple(r["__grams"])] = got.get(tuple(r["__grams"]), 0) + r.n
    want = {}
    for t in texts:
        tokens = re.findall(licenses.WORD, t)
        held = tuple(sorted(known & {*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:]))}))
        want[held] = want.get(held, 0) + 1
    assert got == want and max(want.values()) == 2500
    scored = spark.createDataFrame([(0.99, 2), (0.8, 3), (0.6, 7), (0.1, 988)], "probability double, n long")
    assert licenses.threshold_of(scored, 0.0) > 0.99
    for rate, reach in ((0.002, 2), (0.0049, 2), (0.005, 5), (0.5, 12)):
        t = licenses.threshold_of(scored, rate)
        assert sum(n for p, n in ((0.99, 2), (0.8, 3), (0.6, 7), (0.1, 988)) if p >= t) == reach, rate
    assert licenses.threshold_of(scored.where("false"), 0.001) == licenses.LEAST_PROBABILITY


def test_held_grams_are_the_known_grams_of_a_text(spark):
    known = licenses.vocabulary(spark)
    some = [t for ts in licenses.TEMPLATES.values() for t in ts]
    texts = [*some, *licenses.LOOK_ALIKES, "", "zzz", "The MIT\tlicense, the MIT License", " ".join(t[::-1] for t in some), " ".join(some).upper(), "x license x version 3", "license"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: sorted(r.g) for r in df.select("i", licenses.held_grams(F.col("t"), known).alias("g")).collect()}
    for i, t in enumerate(texts):
        w = re.findall(licenses.WORD, t.lower())
        assert got[i] == sorted(g for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))] if g in set(known)), t
