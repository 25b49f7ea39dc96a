"""Substring dedup, lexical search and the Merkle manifest against brute force and SQL."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from tabwarden.llm import lexical, merkle, substring_dedup
from tabwarden.llm.queries import OP11_SQL, OP12_SQL, OP13_SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, place int, spans string, anchor long, score long"


def _docs(spark, rows):
    """Rows of doc_id, text and source, with columns whose names the operators use."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7, "x", 1, 2) for i, t, s in rows], DOCS)


def _sql(con_tables, sql):
    con = duckdb.connect()
    for name, frame in con_tables.items():
        con.register(name, frame)
    return con.execute(sql).fetchall()


# Substring dedup ---------------------------------------------------------------


def _left(rows):
    """Words left of each row, by comparing all windows of all documents."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    least = {}
    for (i, _, _), w in zip(rows, words):
        for k in range(len(w) - 12) if i is not None else []:
            key = tuple(w[k : k + 13])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, _, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - 12) if i is not None else []:
            if least[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def _passages(rng, documents, vocabulary):
    """Documents that share passages of 8 to 60 words, some cut, some with a word changed."""
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(rng.choice([8, 12, 13, 14, 20, 60]))] for _ in range(12)]
    rows = []
    for i in range(documents):
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += [word() for _ in range(rng.randrange(0, 15))]
            passage = list(rng.choice(shared))
            if rng.random() < 0.4:
                passage[rng.randrange(len(passage))] = word()
            if rng.random() < 0.3:
                passage = passage[rng.randrange(len(passage)) :]
            text += passage
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(text), "s"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("vocabulary", [3, 40, 5000])
def test_substring_dedup_equals_brute_force(spark, vocabulary):
    rows = _passages(random.Random(vocabulary), 60, vocabulary)
    docs = _docs(spark, rows)
    out = substring_dedup.without_repeats(docs, substring_dedup.repeats(docs)).collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out)
    assert got == sorted((i, n, gone, sha256(left.encode()).hexdigest()) for i, n, gone, left in _left(rows))
    assert any(gone for _, _, gone, _ in got)
    texts = {r.doc_id: r for r in out}
    for i, t, _ in rows:
        if not texts[i].n_removed:
            assert texts[i].text == t
        assert (texts[i].place, texts[i].spans, texts[i].anchor) == (7, "x", 1)


def test_substring_dedup_of_odd_rows(spark):
    long = " ".join(f"v{k}" for k in range(30_000))
    said = " ".join(f"u{k}" for k in range(20))
    rows = [
        (5, said, "a"), (5, said, "a"), (5, "x " + said, "a"), (9, said + " new", "a"), (None, said, "a"), (1, None, None),
        (2, "", "a"), (3, " \n\t", "a"), (20, long, "b"), (21, "intro " + long + " end", "b"), (22, "a" * 100_000, "b"),
        (23, "\x1c".join(said.split()), "b"), (24, said.replace(" ", " "), "b"), (30, "ha " * 50, "c"), (31, "ha " * 40, "c"),
    ]
    docs = _docs(spark, rows)
    out = substring_dedup.without_repeats(docs, substring_dedup.repeats(docs)).collect()
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out)
    assert got == Counter((i, n, gone, sha256(left.encode()).hexdigest()) for i, n, gone, left in _left(rows))
    empty = docs.limit(0)
    assert substring_dedup.without_repeats(empty, substring_dedup.repeats(empty)).count() == 0


def test_substring_dedup_equals_sql(spark):
    rows = _passages(random.Random(4), 40, 300) + [(1, None, None), (2, "", None)]
    docs = _docs(spark, rows).select("doc_id", "text")
    out = substring_dedup.without_repeats(docs, substring_dedup.repeats(docs)).drop("text").collect()
    want = _sql({"documents": docs.toPandas()}, OP11_SQL)
    assert sorted(map(tuple, out)) == sorted(want)


def test_every_window_has_an_anchor_at_the_same_place():
    rng = random.Random(2)
    shared = [f"w{rng.randrange(9)}" for _ in range(13)]
    one = substring_dedup.Words([" ".join(["a"] * 30 + shared + ["b"] * 9).encode(), b"", "x".encode()])
    two = substring_dedup.Words(["lone words".encode(), " ".join(["c", "d"] + shared).encode()])
    places = lambda w, start: {int(p) - start for p in w.anchors() if w.windows(np.array([p]))[0][p - start :][:1].any() and start <= p <= start + 6}
    assert places(one, 30) & places(two, 4)
    # The hash of a word does not depend on what is around it.
    assert set(one.hashes) & set(two.hashes)
    long = b"y" * 70
    a, b = substring_dedup.Words([long + b" k"]), substring_dedup.Words([b"k " + long, long])
    assert a.hashes[0] == b.hashes[1] == b.hashes[2] and a.hashes[1] == b.hashes[0]


# Lexical search ----------------------------------------------------------------


def _ranked(docs, items, k):
    """Scores of all documents for all items, straight from the formula."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    held = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(split(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for n, (i, c) in enumerate(held):
            m = 100 - 50 + (50 * sum(c.values()) * total) // length
            w = lambda t: math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))  # noqa: B023, E731
            score = sum(w(t) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return out


def _search(spark, docs, items, k):
    documents = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, item string")
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    return [tuple(r) for r in lexical.ranked(documents, asked, k).collect()]


@pytest.mark.parametrize("k", [1, 4, 1000])
def test_search_equals_all_scores(spark, monkeypatch, k):
    rng = random.Random(k)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(150)]
    docs += [(400, "Ünder_Straße 12x"), (401, "ÜNDER straße; 12X 12x"), (402, None), (403, ""), (404, "... --"), (None, "w1 w2 w3"), (400, "w1 w2")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(20)]
    items += [(50, "Ünder 12X nowhere"), (51, None), (52, "?!"), (53, "w1"), (53, "w2 w3"), (None, "w4 w5")]
    assert sorted(_search(spark, docs, items, k), key=str) == sorted(_ranked(docs, items, k), key=str)
    monkeypatch.setattr(lexical, "BATCH_BYTES", 200)  # many batches of items
    assert sorted(_search(spark, docs, items, k), key=str) == sorted(_ranked(docs, items, k), key=str)


def test_search_of_nothing_and_of_long_texts(spark, monkeypatch):
    assert _search(spark, [], [(1, "a")], 3) == [] and _search(spark, [(1, "a")], [], 3) == []
    assert _search(spark, [(1, None)], [(1, "a")], 3) == []
    docs = [(1, "needle " + "hay " * 50_000), (2, "needle hay"), (3, "z" * 300_000), (4, "hay")]
    monkeypatch.setattr(lexical, "PIECE", 1000)
    assert _search(spark, docs, [(7, "needle")], 9) == _ranked(docs, [(7, "needle")], 9)


def test_accumulators_stop_yet_scores_are_whole():
    rng = np.random.default_rng(5)
    for _ in range(200):
        size, k = int(rng.integers(1, 60)), int(rng.integers(1, 6))
        postings = []
        for _ in range(int(rng.integers(1, 7))):
            at = np.flatnonzero(rng.random(size) < rng.random())
            postings.append((at, rng.integers(0, 2 ** int(rng.integers(1, 12)), len(at))))
        postings = [p for p in postings if len(p[0])]
        if not postings:
            continue
        order = rng.permutation(size)
        places, points = lexical.best(postings, [int(p[1].max()) for p in postings], order, size, k)
        full = np.zeros(size, np.int64)
        for at, adds in postings:
            full[at] += adds
        want = [d for d in np.lexsort((order, -full)) if full[d] > 0][:k]
        assert places.tolist() == want and points.tolist() == full[want].tolist()


def test_search_equals_sql(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(1))}" for _ in range(rng.randrange(40)))) for i in range(80)] + [(90, None)]
    items = [(i, " ".join(f"w{int(rng.paretovariate(1))}" for _ in range(8))) for i in range(9)]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = _sql({"documents": documents.toPandas(), "benchmark": asked.toPandas()}, OP12_SQL)
    assert sorted(_search(spark, docs, items, 50)) == sorted(want)


# Merkle manifest -----------------------------------------------------------------


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def _climb(levels, at, node):
    """The siblings on the way up, and the top as it is with another leaf."""
    proof = []
    for nodes in levels[:-1]:
        run = list(nodes[at // 16 * 16 : at // 16 * 16 + 16])
        proof += run[: at % 16] + run[at % 16 + 1 :]
        run[at % 16] = node
        node, at = _h(*run), at // 16
    return proof, node


def _manifest(rows):
    fields = lambda i, t, s: "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, "en", None if t is None else len(t), t))
    by_source = defaultdict(list)
    for i, t, s in rows:
        leaf = _h(fields(i, t, s))
        lowered = None if t is None else re.sub("[A-Z]", lambda m: m.group().lower(), t)
        forged = _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, "en", None if t is None else len(t), lowered)))
        tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        by_source[s].append((i is not None, i or 0, leaf, i, forged if tampered else leaf))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by_source[s])) for s in sources}
    levels = {s: _tree([x[2] for x in trees[s]]) for s in sources}
    top = _tree([levels[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (_, _, leaf, i, other) in enumerate(trees[s]):
            proof, sub = _climb(levels[s], at, other)
            more, root = _climb(top, k, sub)
            out.append((i, leaf, levels[s][-1][0], top[-1][0], _h(*proof, *more), root, root == top[-1][0]))
    return out


def _found(spark, rows):
    out = merkle.manifest(_docs(spark, rows)).collect()
    return Counter(tuple(r)[:7] for r in out), out


def test_manifest_equals_naive_trees(spark):
    rng = random.Random(8)
    rows = [(i, f"Text {rng.random()}" if i % 7 else "no capitals", "hot") for i in range(700)]
    rows += [(10_000 + i, "Abc É", f"s{i % 40}") for i in range(90)]
    rows += [(20_000, "One", None), (20_001, None, None), (None, "Null Id", "hot"), (None, "Null Id", "hot"), (3, "Text", "hot"), (5, "", "s1"), (5, "", "s1"), (20_005, "x" * 50_000 + "Y", "é")]
    rng.shuffle(rows)
    got, out = _found(spark, rows)
    assert got == Counter(_manifest(rows))
    tampered = [r for r in out if not r.verified]
    # A version copies the leaf and its ancestors, and shares all other nodes.
    assert tampered and all(r.copied > 0 for r in tampered) and all(r.copied == 0 for r in out if r.verified)
    assert max(r.copied for r in tampered) == 1 + 3 + 2 and Counter(r.verified for r in out)[True] > 500


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, f"Leaf {i}", "only") for i in range(n)]
    assert _found(spark, rows)[0] == Counter(_manifest(rows))


def test_manifest_of_nothing_and_by_sql(spark):
    assert merkle.manifest(_docs(spark, [])).count() == 0
    rows = [(i, f"Leaf {i}" if i % 5 else None, None if i % 11 == 0 else f"s{i % 3}") for i in range(300)] + [(1000 + i, "Aa", f"q{i}") for i in range(20)]
    docs = _docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    want = _sql({"documents": docs.toArrow()}, OP13_SQL)
    assert Counter(want) == Counter((r[0], *r[1:7]) for r in map(tuple, merkle.manifest(docs).collect()))


def test_copied_path_shares_all_other_nodes():
    tree = merkle.grown([_h(str(k)) for k in range(100)], 2)
    path = merkle.copied_path(_h("other"), merkle.steps(tree, 37))
    changed = merkle.grown([_h("other") if k == 37 else x for k, x in enumerate(tree[0])], 2)
    assert path == [changed[0][37], changed[1][2], changed[2][0]]
    assert sum(a != b for x, y in zip(tree, changed) for a, b in zip(x, y)) == len(path)
