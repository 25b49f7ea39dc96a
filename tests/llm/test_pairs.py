"""Line dedup, near-duplicates, decontamination, sharding and neighbours against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwarden.llm import decontamination, line_dedup, near_dedup, neighbours, sharding
from tabwarden.llm.queries import OP2_SQL

DOCS = "doc_id long, text string, source string, mark long, pos int, gone string"


def _docs(spark, texts, sources=None):
    rows = [(i, t, (sources or {}).get(i, f"s{(i or 0) % 3}"), 7, 1, "x") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def _words(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# Near-duplicates ---------------------------------------------------------------


def _set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


def _components(texts, width, percent=80):
    sets = {i: _set(t, width) for i, t in texts}
    root = {i: i for i, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [i for i in root if sets[i]]
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in root}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        base = _words(rng, rng.choice([3, 8, 40, 200])).split()
        for _ in range(rng.choice([1, 2, 6])):
            copy = [w if rng.random() > rng.choice([0, 0.02, 0.06]) else f"x{rng.random()}" for w in base]
            texts.append((len(texts), " ".join(copy)))
    texts += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "Éa b"), (906, "éa b")]
    found = near_dedup.near_duplicates(_docs(spark, texts), width=width).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found}
    assert got == _components(texts, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_components_of_chains_stars_and_strays(spark):
    chain = [(n, n + 1) for n in range(100)]
    star = [(500, n) for n in range(501, 600)]
    pairs = [(1000, 1001), (1003, 1002), (1002, 1001), (1000, 1001), (7000, 7000)]
    found = near_dedup.components(spark.createDataFrame(chain + star + pairs, "a long, b long")).collect()
    want = {n: 0 for n in range(101)} | {n: 500 for n in range(500, 600)} | {n: 1000 for n in range(1000, 1004)}
    assert {r.rep: r.root for r in found} == want and len(found) == len(want)
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_one_large_group(spark, monkeypatch):
    """More members than a bucket gives all pairs of, some far from the leader."""
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(8)
    base = _words(rng, 150).split()
    texts = [(i, " ".join(w if rng.random() > 0.055 else f"x{rng.random()}" for w in base)) for i in range(120)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(_docs(spark, texts), width=2).collect()}
    want = _components(texts, 2)
    assert got == want
    assert 1 < len({c for _, c in want.values()}) or len(set(want.values())) > 1


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "x"), (3, "a b c d e f")]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.near_duplicates(_docs(spark, rows)).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 3, True)]
    assert near_dedup.near_duplicates(_docs(spark, [])).count() == 0


def test_estimates_and_recall():
    rng = np.random.default_rng(1)
    left = rng.integers(0, 2**63, 400, dtype=np.uint64)
    for shared in (200, 320, 380):
        right = np.concatenate([left[:shared], rng.integers(0, 2**63, 400 - shared, dtype=np.uint64)])
        a, b = near_dedup.minima(np.unique(left)), near_dedup.minima(np.unique(right))
        signatures = [np.frombuffer(near_dedup.signature(x), np.uint8) for x in (a, b)]
        assert len(signatures[0]) == near_dedup.VALUES * near_dedup.BITS // 8
        true = shared / (800 - shared)
        assert abs(float(near_dedup.estimates(*signatures)) - true) < 0.15
    missed = 0
    for _ in range(300):
        left = rng.integers(0, 2**63, 90, dtype=np.uint64)
        right = np.concatenate([left[:80], rng.integers(0, 2**63, 10, dtype=np.uint64)])
        keys = [near_dedup.band_keys(near_dedup.minima(np.unique(x))) for x in (left, right)]
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


# Line dedup --------------------------------------------------------------------


def _removed(spark, texts):
    docs = _docs(spark, texts)
    out = line_dedup.without_lines(docs, line_dedup.repeated_lines(docs), removed="removed")
    assert out.columns == [*docs.columns, "removed"]
    return {r.doc_id: (r.text, r.removed) for r in out.collect()}


def test_lines_of_planted_passages(spark):
    rng = random.Random(5)
    passage = [_words(rng, n) for n in (12, 30, 9)]
    single = _words(rng, 60)
    short = _words(rng, 9)
    texts = []
    for i in range(30):
        lines = [_words(rng, rng.randint(1, 40)) for _ in range(rng.randint(0, 6))]
        at = rng.randint(0, len(lines))
        if i % 3 == 0:
            lines[at:at] = passage
        if i % 5 == 0:
            lines.insert(at, single)
        if i % 2 == 0:
            lines.append(short)
        texts.append((i, "\n".join(lines)))
    got = _removed(spark, texts)
    for i, text in texts:
        want = text.split("\n")
        if i % 3 == 0 and i:
            want = [x for x in want if x not in passage]
        if i % 5 == 0 and i:
            want = [x for x in want if x != single]
        # The short line goes only where it stands in a repeated run.
        kept = got[i][0].split("\n") if got[i][0] else []
        assert [x for x in kept if x != short] == [x for x in want if x and x != short], i
        assert got[i][1] == (len(text.split("\n")) - len(kept) if text else 0)
    assert got[0] == (texts[0][1], 0)


def test_deleted_lines_have_an_earlier_equal(spark):
    rng = random.Random(6)
    pool = [_words(rng, rng.randint(1, 45)) for _ in range(30)]
    texts = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    got = _removed(spark, texts)
    seen: Counter = Counter()
    for i, text in texts:
        before, after = Counter(text.split("\n")), Counter(got[i][0].split("\n") if got[i][0] else [])
        assert not after - before
        for line in before - after:
            assert seen[line] or before[line] > 1
        seen += before
    # Every long line that repeats is left once.
    left = Counter(line for t, _ in got.values() for line in t.split("\n"))
    assert all(left[line] == 1 for line in pool if len(line.split()) >= line_dedup.GRAM and seen[line])


def test_lines_of_odd_rows(spark):
    rng = random.Random(7)
    line = _words(rng, 50)
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, line), (4, line), (5, f"  {line}\r\n\nx"), (None, "y"), (6, "\n".join([line] * 40))]
    docs = _docs(spark, rows)
    got = sorted((r.doc_id or -1, r.text or "") for r in line_dedup.dedup_lines(docs).collect())
    assert got == [(-1, "y"), (1, ""), (2, ""), (3, "\n\n"), (4, line), (4, line), (5, "\nx"), (6, "")]
    assert line_dedup.dedup_lines(_docs(spark, [])).count() == 0


# Decontamination ---------------------------------------------------------------


def _leaked(docs, items, width=5):
    sets = lambda rows: {k: {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for k, t in rows for w in [re.findall(r"[^\W_]+", (t or "").lower())]}
    items = {k: s for k, s in sets(items).items() if s}
    return {(d, k): len(s & q) for d, s in sets(docs).items() for k, q in items.items() if len(s & q) >= 0.8 * len(q)}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(i, _words(rng, rng.choice([5, 6, 11, 30, 90])).capitalize() + ".") for i in range(40)] + [(90, None), (91, "a b"), (92, "")]
    docs = []
    for i in range(60):
        words = _words(rng, rng.choice([0, 20, 400, 3000])).split()
        for _ in range(rng.choice([0, 1, 4])):
            leak = items[rng.randrange(40)][1].upper().split()
            if rng.random() < 0.3:
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = leak
        docs.append((i, ", ".join(words)))
    docs += [(100, None), (101, ""), (102, " ".join(t for _, t in items if t))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, shingle int")
    found = decontamination.leaks(_docs(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id): r.shared for r in found} == _leaked(docs, items)
    clean = {r.doc_id for r in decontamination.without_leaks(_docs(spark, docs), bench).select("doc_id").collect()}
    assert clean == {i for i, _ in docs} - {r.doc_id for r in found}
    assert decontamination.leaks(_docs(spark, docs), bench.limit(0)).count() == 0
    assert decontamination.leaks(_docs(spark, []), bench).count() == 0


@pytest.mark.parametrize("doc_id", [7, None])
def test_leaks_in_pieces_of_a_document_of_many_leaks(spark, doc_id):
    rng = random.Random(8)
    items = {i: [f"i{i}w{k}" for k in range(21)] for i in range(300)}
    text = [w for i in range(12, 300) for w in items[i]]
    for i in range(12):
        # All 17 shingles, or 13 of them, one too few, in pieces far apart.
        for at in range(0, 17 if i < 10 else 13, 4):
            text += [f"filler{rng.random()}" for _ in range(150)] + items[i][at : min(at + 8, 21 if i < 10 else 17)]
    docs = spark.createDataFrame([(doc_id, " ".join(text)), (8, " ".join(items[3]))], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.shared, r.item_shingles) for r in decontamination.leaks(docs, bench).collect()}
    assert got == {(doc_id, i): (17, 17) for i in items if not 10 <= i < 12} | {(8, 3): (17, 17)}


def test_leaks_by_shuffled_joins_are_the_same(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, _words(rng, 20)) for i in range(10)]
    docs = [(i, items[i % 10][1] + " " + _words(rng, 50)) for i in range(30)] + [(None, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((r.doc_id or -1, r.item_id) for r in decontamination.leaks(_docs(spark, docs), bench).collect())
    assert len(want) == 31
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 3)
    assert sorted((r.doc_id or -1, r.item_id) for r in decontamination.leaks(_docs(spark, docs), bench).collect()) == want
    assert "HAVING" in OP2_SQL


# Sharding ----------------------------------------------------------------------


@pytest.mark.parametrize("bucket_rows", [7, 20_000])
def test_shards_hold_the_mixture(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket_rows)
    import zlib

    texts = [(i, "x" * (i % 9) if i % 11 else None) for i in range(501)] + [(5, "x" * 5), (5, "x" * 5), (None, "é")]
    sources = {i: "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"s{i % 17}") for i in range(501)} | {None: "s1"}
    rows = sharding.shard(_docs(spark, texts, sources), shards=8).collect()
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    by_source = defaultdict(Counter)
    for r in rows:
        slots[r.shard].append(r.slot)
        by_source[r.source][r.shard] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for source, count in by_source.items():
        share = sum(count.values()) / 8
        assert all(abs(count[k] - share) <= 2 for k in range(8)), source
    size = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts}
    assert all((r.size, r.text_crc32) == size[r.doc_id] for r in rows)
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)


def test_shards_of_few_rows(spark):
    assert sharding.shard(_docs(spark, [])).count() == 0
    rows = sharding.shard(_docs(spark, [(1, "a"), (2, None)])).collect()
    assert sorted(r.slot for r in rows) == [0, 0] and len({r.shard for r in rows}) == 2


# Neighbours --------------------------------------------------------------------


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, rank int")


def test_neighbours_of_odd_rows_and_ties(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0])]
    rows += [(6, [None, 1.0]), (7, [float("inf"), 0.0]), (40, [0.0, 0.0]), (60, None), (None, [1.0, 0.0]), (8, [-1.0, 0.0]), (1, [1.0, 0.0])]
    found = neighbours.nearest(_vectors(spark, rows), k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [
        (0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 2, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 0.5),
    ]
    assert neighbours.nearest(_vectors(spark, [])).count() == 0
    assert neighbours.nearest(_vectors(spark, [(0, [1.0])])).count() == 0


def test_neighbours_reach_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 256)
    rng = np.random.default_rng(2)
    points = rng.standard_normal((1500, 24)).astype(np.float32)
    points[300:700] = points[299]  # a vector that many rows have
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    found = defaultdict(list)
    for r in neighbours.nearest(_vectors(spark, rows), k=20).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    wide = points.astype(float)
    hits = total = 0
    for q in range(0, 1500, 20):
        score = wide @ wide[q]
        order = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(score[i], 9), i))[:20]
        assert len(found[q]) == 20 and all(abs(s - score[i]) < 1e-9 for i, s in found[q])
        hits += len({i for i, _ in found[q]} & set(order))
        total += 20
    assert hits / total >= 0.9


def test_repeated_lines_of_tabs_and_of_ideographs_go(spark):
    tabs, spaces = "\t".join(f"t{n}" for n in range(60)), "\u3000".join(f"s{n}" for n in range(60))
    ideographs = "".join(chr(0x4E00 + n) for n in range(200))
    texts = [(1, tabs), (2, f"own\n{tabs}"), (3, spaces), (4, spaces), (5, ideographs), (6, f"{ideographs}\nown"), (7, "short\tline"), (8, "short\tline")]
    docs = _docs(spark, texts)
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert left == {1: tabs, 2: "own", 3: spaces, 4: "", 5: ideographs, 6: "own", 7: "short\tline", 8: "short\tline"}
