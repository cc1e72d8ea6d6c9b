"""SimHash components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from shelfwise.llm import simhash
from shelfwise.llm.common import table
from shelfwise.llm.components import components, spanning_stars
from shelfwise.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, fp string, member int"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, bits=4):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fp = np.array(prints, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= bits):
            parent[root(i)] = root(int(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(ids))]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = table(spark, path, "documents").select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    expected = {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_components([r.doc_id for r in rows], prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_pigeonring_simhash"](spark, path).collect()}
    assert got == expected


def test_fingerprints_edge_cases():
    texts = [None, "", " \t\n", "one", "A b\x0bC", "x " * 2000, "Ärger ÄRGER a b c\xa0d e", "w1 w2 w3 w4"]
    got = simhash.fingerprints_of([t.encode() if t is not None else None for t in texts])
    assert got.tolist() == [brute_fingerprint(t) for t in texts]


def clusters(rng, n):
    """Fingerprints with dense clusters, chains of near ones and far ones."""
    out = []
    for _ in range(n):
        kind = rng.random()
        base = rng.getrandbits(64) if not out or kind < 0.4 else rng.choice(out)
        for _ in range(rng.randint(0, 6)):
            base ^= 1 << rng.randrange(64)
        out.append(base)
    return out


def test_links_join_what_brute_force_joins(spark):
    rng = random.Random(8)
    prints = list(dict.fromkeys(clusters(rng, 1500) + [0xABCDEF0123456789 ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(30, 45)]))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    labels = {r.node: r.label for r in components(simhash.fingerprint_links(df)).collect()}
    expected = brute_components(signed, prints)
    groups = {}
    for v, e in zip(signed, expected):
        groups.setdefault(e, set()).add(labels.get(v, v))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_pigeonring_never_prunes_a_link():
    rng = random.Random(5)
    segments = simhash.ring()
    for _ in range(2000):
        x = 0
        for b in rng.sample(range(64), rng.randint(0, 4)):
            x |= 1 << b
        assert any(simhash.within(np.array([x], np.uint64), s, segments, 4)[0] for s in range(5))


def test_small_and_large_keys_agree(monkeypatch):
    rng = random.Random(9)
    fp = np.array(list(dict.fromkeys(clusters(rng, 400))), np.uint64)
    segments = simhash.ring()
    parts = list(simhash.chain_keys(fp, segments))
    keys, values = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    out = []
    for limit in (64, 1):
        monkeypatch.setattr(simhash, "SMALL_KEY", limit)
        a, b = simhash.links_of_sorted(keys[order], values[order], segments, 4)
        out.append(dict(zip(*[x.tolist() for x in spanning_stars(a.view(np.int64), b.view(np.int64))])))
    assert out[0] == out[1] and out[0]


def test_components_of_chain_star_and_empty(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    df = spark.createDataFrame(chain + star + [(5000, 5000)], "a bigint, b bigint").repartition(6)
    got = {r.node: r.label for r in components(df).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[1000 + i] for i in range(200)}) == 1
    assert got[0] != got[1000] and 5000 not in got
    assert components(df.where("false")).count() == 0


def test_keep_one_each(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(3000)) + " "
    rows = [(5, long, "x", 1), (3, long, "x", 1), (3, long, "x", 1), (9, long + "end", None, None), (4, "quite another text of its own", "x", 1),
            (None, "no id here at all my friend", "x", 1), (None, "no id here at all my friend", "y", 1), (7, None, "x", 1), (8, "", "x", 1), (6, " ", "x", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(3, long), (4, rows[4][1]), (None, rows[5][1]), (6, " ")], key=str)
    assert simhash.near_duplicates(docs).count() == len(rows)
    assert simhash.keep_one_each(docs.where("false")).count() == 0
