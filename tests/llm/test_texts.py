"""Classifiers, tokens, chat formatting, extraction and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tabwarden.llm import bpe, chat, common, quality, site_style, toxicity
from tabwarden.llm.queries import BYTE_BPE, QUERIES

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
REFERENCE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
DOCS = "doc_id long, text string, score string, predicted string"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "p") for i, t in rows], DOCS)


# Classifiers -------------------------------------------------------------------

TOXIC = ["idiot", "moron", "scum"]


def _labelled(n, rng):
    out = []
    for _ in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 120))]
        label = rng.random() < 0.4
        if label:
            words[rng.randrange(len(words))] = rng.choice(TOXIC)
        out.append((" ".join(words), int(label)))
    return out


def test_toxicity_finds_one_word_in_a_text_and_its_misspellings():
    rng = random.Random(1)
    model = toxicity.train(_labelled(500, rng), epochs=15)
    held = _labelled(200, rng)
    right = sum((s >= 0.5) == bool(y) for s, (_, y) in zip(model.score([t for t, _ in held]), held, strict=True))
    assert right / len(held) > 0.95
    clean = "abc dei fgh " * 30
    scores = model.score([clean, clean + "idiotic " + clean, clean + "morons " + clean, "", "..."])
    assert scores[0] < 0.5 and scores[0] < min(scores[1:3]) and scores[3] == scores[4]


def test_toxicity_of_long_texts_is_that_of_all_pieces(monkeypatch):
    model = toxicity.train(_labelled(300, random.Random(2)))
    text = "abc dei " * 400 + "idiot " + "fgh abc " * 400
    whole = model.odds([text])[0]
    monkeypatch.setattr(toxicity, "PIECE", 500)
    assert abs(model.odds([text])[0] - whole) < 0.2


def test_quality_learns_noise_and_reads_whole_texts(monkeypatch):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7))) for _ in range(n))
    spoil = lambda t: "$$$ ".join(t.split())
    rows = [(say(rng.randint(2, 300)), 1) for _ in range(150)] + [(spoil(say(rng.randint(5, 300))), 0) for _ in range(100)]
    model = quality.train(rows, epochs=6)
    held = [(say(100), 1) for _ in range(40)] + [(spoil(say(100)), 0) for _ in range(40)]
    scores = model.score([t for t, _ in held])
    assert sum((s >= 0.5) == bool(y) for s, (_, y) in zip(scores, held, strict=True)) >= 76
    long = say(3000)
    want = model.score([long, "", "é"])
    monkeypatch.setattr(quality, "BLOCK", 3000)
    assert abs(model.score([long, "", "é"]) - want).max() < 1e-6
    assert model.score([long + spoil(say(2000))])[0] < want[0]


def test_long_texts_score_alike_in_any_blocks_and_in_little_memory(monkeypatch):
    import tracemalloc

    rng = random.Random(4)
    model = quality.train([("a b c", 1), ("$$$ x", 0)], epochs=1)
    texts = ["".join(rng.choice("abcdefgh $") for _ in range(n)) for n in (1_200_000, 30_000, 3)]
    tracemalloc.start()
    want = model.score(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000
    for block in (2000, 10_000_000):
        monkeypatch.setattr(quality, "BLOCK", block)
        assert abs(model.score(texts) - want).max() < 1e-12


def test_chunks_cover_all_spans():
    for size in (0, 1, 1023, 1024, 1025, 5000):
        starts = quality.chunk_starts(size)
        covered = {s for c in starts for s in range(c, min(c + quality.CHUNK, size) - quality.SPAN + 1)}
        assert covered >= set(range(max(0, size - quality.SPAN + 1)))


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_odd_rows(spark, module):
    empty = module.train([])
    score = module.score_toxicity if module is toxicity else module.score_quality
    rows = [(1, None), (2, ""), (None, "x"), (3, "y " * 50_000), (3, "y " * 50_000)]
    got = score(_docs(spark, rows), empty).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert score(_docs(spark, []), empty).count() == 0


def test_samples_are_bounded_and_do_not_depend_on_order(spark):
    docs = _docs(spark, [(i, "t" * 10) for i in range(50)] + [(60, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    some = common.labelled_sample(docs, labels, "toxic", F.col("doc_id") < 40, 20, 10_000)
    assert 0 < len(some) <= 20
    assert some == common.labelled_sample(docs.orderBy(F.desc("doc_id")), labels, "toxic", F.col("doc_id") < 40, 20, 10_000)
    assert len(common.labelled_sample(docs, labels, "toxic", F.lit(True), 60, 95)) == 9


def test_long_texts_and_labels_of_no_document_do_not_end_a_sample(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, toxic int")
    ids = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id")).collect() if r.doc_id < 20]
    texts = {i: "t" * 10 for i in range(20)} | {ids[0]: "x" * 2_000, ids[1]: "y" * 900, ids[2]: "z" * 500}
    docs = _docs(spark, [*texts.items(), (ids[3], texts[ids[3]])])
    some = common.labelled_sample(docs, labels, "toxic", F.lit(True), 25, 1_000)
    assert sorted(t for t, _ in some) == ["t" * 10] * 17 + ["z" * 500]
    assert len(common.labelled_sample(docs, labels, "toxic", F.lit(True), 17, 1_000)) == 17


# Tokens ------------------------------------------------------------------------

VOCABULARY = bpe.Vocabulary(BYTE_BPE)


def _ids(text):
    return [i for run in bpe.encode(text, VOCABULARY) for i in run.ids]


@given(st.text(max_size=200) | st.text("ab \n'st<|endoftext>é", max_size=300))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_library_s(text):
    ids = _ids(text)
    assert ids == REFERENCE.encode(text, add_special_tokens=False).ids
    decoder = bpe.Decoder(VOCABULARY)
    assert "".join([decoder.feed([i]) for i in ids]) + decoder.end() == text


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 20_000 + "x", "ab" * 9_000, "ñ" * 4_000, "the" * 20_000, "-" * 30_001, "=-" * 9_000, "x " * 90_000, "<|endoftext|>" * 3])
def test_long_words_stream_with_bounded_lookahead(text):
    assert _ids(text) == REFERENCE.encode(text, add_special_tokens=False).ids


def test_memory_is_one_window():
    reader, longest = bpe.Transducer(VOCABULARY), 0
    for _ in range(200):
        list(reader.feed(b"thequickbrownfox" * 16))
        longest = max(longest, len(reader.pending))
    assert longest < 2 * VOCABULARY.lookahead + 512


def test_lookahead_is_needed_and_enough():
    """On a short merge list every text is tried: settled tokens never change."""
    merges = [(b"a", b"b"), (b"b", b"c"), (b"c", b"ab"), (b"bc", b"a")]
    reach = bpe.lookahead(merges)
    import itertools

    ranks = {m: k for k, m in enumerate(merges)}

    def tokens(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            best = min((ranks.get(p, 99), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))) if len(parts) > 1 else (99, 0)
            if best[0] == 99:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for word in itertools.product(b"abc", repeat=9):
        word = bytes(word)
        full = tokens(word)
        cut = tokens(word[: reach + 1])
        assert full[0] == cut[0]


def test_lossy_decoding_is_the_library_s():
    rng = random.Random(4)
    for _ in range(200):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(1, 12))]
        decoder = bpe.Decoder(VOCABULARY)
        assert decoder.feed(ids) + decoder.end() == REFERENCE.decode(ids, skip_special_tokens=False)


def test_encode_decode_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a <|endoftext|>"), (3, "b"), (3, "b")]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(_docs(spark, rows), BYTE_BPE).collect()}
    say = lambda i, t: (i, len(e := REFERENCE.encode(t, add_special_tokens=False).ids), _sha(",".join(map(str, e))), _sha(t))
    assert got == {say(1, ""), say(2, ""), say(None, "a <|endoftext|>"), say(3, "b")}
    assert bpe.encode_decode(_docs(spark, []), BYTE_BPE).count() == 0


def test_a_task_leaves_no_words_in_its_worker(spark):
    texts = spark.range(4000).selectExpr("id AS doc_id", "concat('word', id, ' of', id * 7) AS text")
    assert bpe.encode_decode(texts, BYTE_BPE).count() == 4000

    @F.udf("string")
    def held(_):
        import gc

        words = bpe.vocabulary_of(BYTE_BPE)
        return f"{len(words.young) + len(words.old)} {gc.isenabled()}"

    assert {r.held for r in spark.range(64).select(held("id").alias("held")).distinct().collect()} == {"0 True"}


# Chat --------------------------------------------------------------------------

QUOTES = st.text("\\# </>turn:AssistantUserRole\n", max_size=40) | st.sampled_from(["### Assistant: ", "\\", " </turn>\n", "\\### User:", " ###: ", "<|endoftext|>"])


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a: b", "### User: "]) | QUOTES, QUOTES), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_written_turns_parse_back(turns):
    template = chat.template_of(BYTE_BPE)
    written = ""
    for (role, text), (ids, begin, end) in zip(turns, template.turns(*map(list, zip(*turns, strict=True))), strict=True):
        written += template.decode(ids)
        assert chat.unescape(template.decode(ids[begin:end])) == (text if role == "assistant" else "")
    assert chat.parse(written) == turns


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 0, "assistant", "ü" * 9)]
    rows += [(3, i, "user" if i % 2 else "assistant", f"\\### Assistant: {i} </turn>") for i in range(300)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(table, BYTE_BPE), BYTE_BPE).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv in got:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == _sha("".join(f"{role}\n{text}\n" for _, role, text in own))
        learnt = "".join(text for _, role, text in own if role == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learnt), _sha(learnt))
    assert chat.read_back(chat.format_turns(table.limit(0), BYTE_BPE), BYTE_BPE).count() == 0


# Pages -------------------------------------------------------------------------


def _text(html):
    return site_style.main_text(site_style.parse(html)[0], lambda path: False)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain &lt;b&gt;  text", "plain <b> text"),
        ("<p>a<p>b &amp; <i>c</i>d<br>e", "a\nb & cd\ne"),
        ("<nav>x</nav><article><header><h1>T</h1></header><p>y<div class='ad'>z</div></article><footer>f</footer>", "T\ny"),
        ("<article>a<section class='comments'><p>c</p></section><form>f</form>b</article>", "a\nb"),
        ("<script>var t='</p>';</script><style>p{}</style><p>k", "k"),
        ("<p>a <!-- no > --> b</p><![CDATA[c]]>", "a b\nc"),
        ("<ul><li>one<li>two</ul><p hidden>no</p>", "one\ntwo"),
        ("<div id=sidebar>no</div><div>a &nbsp; b</div>", "a b"),
        ("<p>x < y > z</p></b></unknown>", "x < y > z"),
        ("<p>cut <b", "cut"),
    ],
)
def test_texts_of_pages(html, text):
    assert _text(html) == text


@given(st.text("<>/ap div='\"!-&;x", max_size=120))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_read(html):
    site_style.parse(html)


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, element string")


def test_headings_of_all_pages_stay_with_what_they_head(spark):
    heads, want = ("Introduction", "Methods", "Notes"), {}
    rows = []
    for n in range(12):
        parts = "".join(f"<h2>{h}</h2><p>{h} of page {n} says {n * 7}</p>" for h in heads)
        rows.append((n, f"http://h.org/{n}", f"<article>{parts}<div class='end'>Printed on paper</div></article>"))
        want[n] = "\n".join(f"{h}\n{h} of page {n} says {n * 7}" for h in heads)
    for limit in (site_style.BROADCAST_ROWS, 0):
        assert {r.page_id: r.text for r in site_style.extract(_pages(spark, rows), broadcast_rows=limit).collect()} == want


def test_style_tree_removes_what_all_pages_have(spark):
    page = "<div class='top'><p>Our site</p></div><div class='body'><p>{}</p><p>{}</p></div><div class='end'><p>All about us</p></div>"
    rows = [(i, f"http://h.org/{i}", page.format(f"first {i}", f"second {i}")) for i in range(12)]
    rows += [(20, "http://small.org/", page.format("a", "b")), (21, None, None), (22, "x", ""), (0, *rows[0][1:])]
    want = {i: f"first {i}\nsecond {i}" for i in range(12)} | {20: "Our site\na\nb\nAll about us", 21: "", 22: ""}
    got = site_style.extract(_pages(spark, rows)).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
    again = site_style.extract(_pages(spark, rows), broadcast_rows=0).collect()
    assert sorted((r.page_id, r.text) for r in again) == sorted((r.page_id, r.text) for r in got)
    assert site_style.extract(_pages(spark, [])).count() == 0


def test_style_tree_decides_inside_and_outside_articles(spark):
    page = (
        "<main><p>{0}</p><div class='legal'>All rights are ours</div></main>"
        "<div role=\"main\"><p>more {0}</p><div class='legal'>Call us</div></div>"
        "<div class='body'><p>{1}</p></div><div class='end'><p>All about us</p></div>"
    )
    cards = "<div class='body'><p>{0}</p></div><article><p>Our best offer</p></article>"
    rows = [(i, f"http://h.org/{i}", page.format(f"first {i}", f"second {i}")) for i in range(8)]
    rows += [(20 + i, f"http://cards.org/{i}", cards.format(f"body {i}")) for i in range(8)]
    rows += [(40 + i, f"http://copies.org/{i}", "<p>Our site</p><article>the same</article>") for i in range(8)]
    want = {i: f"first {i}\nmore first {i}\nsecond {i}" for i in range(8)}
    want |= {20 + i: f"body {i}" for i in range(8)} | {40 + i: "the same" for i in range(8)}
    for limit in (site_style.BROADCAST_ROWS, 0):
        assert {r.page_id: r.text for r in site_style.extract(_pages(spark, rows), broadcast_rows=limit).collect()} == want
    assert _text("<article>card</article><div>body</div>") == "card\nbody"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div class='content has-sidebar'>a</div>", "a"),
        ("<main class='no-comments'>a</main>", "a"),
        ("<article class='post share-enabled'>a</article>", "a"),
        ("<article class='post share'>a<div class='share'>b</div></article>", "a"),
        ("<div style='overflow:hidden'>a</div><p><a href='/hidden-gems'>b</a></p>", "a\nb"),
        ("<p data-hidden='false'>a<p title='x class=ad'>b<p data-class=ad>c<p hidden>d<p aria-hidden=true>e", "a\nb\nc"),
        ("<div class='widget'><div class=ad>x</div><main><p>a</main></div><article>b</article>", "a\nb"),
        ("<div class='promo'><article>a</article></div>", "a"),
        ("<article>a</article><div class='comments'><article class='comment'>b</article></div>", "a"),
        ("<p>a <b>b <span class=ad>x</b> c", "a b\nc"),
        ("<p>a <span class='ad'>x<i>y</i></span> c", "a\nc"),
        ("<body class='sidebar'><div role=navigation>x</div>a", "a"),
    ],
)
def test_names_are_whole_tokens_and_spare_the_article(html, text):
    assert _text(html) == text


def test_style_tree_confirms_names(spark):
    parts = ["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</ul>"]
    rows = []
    for i in range(9):
        body = "".join(parts[(i // 3**k + k) % 3].format(f"text {i} {k}") for k in range(3))
        rows.append((i, f"http://h.org/{i}", f"<div class='share'>{body}</div><div class='ad'>ad {i}</div><div class='related'><p>x</div>"))
    want = {i: "\n".join(f"text {i} {k}" for k in range(3)) for i in range(9)} | {20: ""}
    rows.append((20, "http://small.org/", rows[0][2]))
    for limit in (site_style.BROADCAST_ROWS, 0):
        assert {r.page_id: r.text for r in site_style.extract(_pages(spark, rows), broadcast_rows=limit).collect()} == want


def _naive_importances(rows):
    """The tree of each host as a dict, by the definitions of ``site_style``."""
    holds, shows, looks, parent_of, article = {}, {}, {}, {}, set()
    for page, (_, url, html) in enumerate(rows):
        host = site_style.host_of(url)
        blocks, styles = site_style.parse(html or "")
        for k, b in enumerate(blocks):
            for path in b.marks or (b.path,):
                key = (host, path)
                holds.setdefault(key, set()).add(page)
                for feature in site_style._shown(blocks, k):
                    shows.setdefault(key, {}).setdefault(feature, set()).add(page)
                if not b.marks:
                    parent_of[key] = (host, b.parent)
                    article |= {key} if b.article else set()
        for path, style in styles:
            for lead in ("", site_style.NAMED, site_style.TAGGED):
                key = (host, lead + path)
                if not lead or any(lead + path in b.marks for b in blocks):
                    holds.setdefault(key, set()).add(page)
                    looks.setdefault(key, {}).setdefault(style, set()).add(page)

    def look(key):
        m = len(holds[key])
        return sum(-len(p) / m * math.log(len(p) / m, m) for p in looks[key].values()) if m >= 5 and key in looks else None

    told = {}
    for key, features in shows.items():
        m, sizes = len(holds[key]), [len(p) for p in features.values()]
        if m < 5:
            continue
        if key[1].startswith((site_style.NAMED, site_style.TAGGED)):
            content = 1 - sum(n * math.log(n, m) for n in sizes) / sum(sizes)
            told[key] = 0.5 * content + 0.5 * (look(key) or 0), -0.6 if key[1].startswith(site_style.TAGGED) else -0.45
        else:
            up = parent_of[key]
            around = look(up) if up in holds else None
            content = 1 - sum(math.log(n, m) for n in sizes) / len(sizes)
            told[key] = 0.9 * content + 0.1 * (1 if around is None else around), 0.1 if key in article else 0
    return {site_style._hash(*key): (t, t + add) for key, (t, add) in told.items()}


def _random_pages(seed):
    """Pages of three hosts, of parts that repeat more or less, in and out of marks."""
    pick = random.Random(seed)
    say = lambda: " ".join(pick.choice("one two three four five. six, seven".split()) for _ in range(pick.randint(1, 4)))
    parts = [
        lambda: f"<p>{say()}</p>", lambda: f"<article><h2>Intro</h2><p>{say()}<p>{say()}</article>", lambda: f"<div class=ad>{say()}</div>",
        lambda: f"<nav><ul><li><a href='/{pick.randint(0, 3)}'>{say()}</a></ul></nav>", lambda: f"<div class='end'><p>All ours. {say()}</p></div>",
        lambda: f"<aside><div class=share><p>{say()}</p><ul><li>x</ul></div></aside>", lambda: f"<footer>We. {say()}</footer>",
    ]
    return [
        (i, f"http://{pick.choice('aab')}.org/{i}", "".join(pick.choice(parts)() for _ in range(pick.randint(0, 8))))
        for i in range(30)
    ] + [(90, None, None), (91, "http://few.org", "<p>x</p><nav>y</nav>")]


@pytest.mark.parametrize("seed", [1, 2])
def test_importances_are_those_of_a_naive_tree(spark, seed):
    rows = _random_pages(seed)
    pages = _pages(spark, rows)
    found, want = {r.element: (r.told, r.importance) for r in site_style.importances(pages).collect()}, _naive_importances(rows)
    assert found.keys() == want.keys() and len(want) > 5
    assert all(found[k] == pytest.approx(want[k]) for k in want)

    def stays(host, block):
        if block.marks:
            return all(want.get(site_style._hash(host, m), (0, 0))[1] >= 0.3 for m in block.marks)
        return want.get(site_style._hash(host, block.path), (1, 1))[1] >= 0.3

    texts, blocks_kept, blocks_all = {}, 0, 0
    for page, url, html in rows:
        blocks = site_style.parse(html or "")[0]
        kept = [b for b in blocks if stays(site_style.host_of(url), b)]
        blocks_kept, blocks_all = blocks_kept + len(kept), blocks_all + len(blocks)
        texts[page] = "\n".join(b.text for b in kept or [b for b in blocks if b.article and not b.marks])
    for limit in (site_style.BROADCAST_ROWS, 0):
        assert {r.page_id: r.text for r in site_style.extract(pages, broadcast_rows=limit).collect()} == texts
    counted = site_style.decisions(pages).collect()
    assert sum(r.blocks for r in counted) == blocks_all and sum(r.blocks for r in counted if not r.removed) == blocks_kept


def test_tree_overrules_tags_and_names_by_what_pages_show(spark):
    """An aside stays where it differs from page to page in text and make, a menu does not."""
    make = ["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</ul>"]
    rows, want = [], {}
    for i in range(9):
        texts = [f"remark {i} {k}" for k in range(3)]
        body = "".join(make[(i // 3**k + k) % 3].format(x) for k, x in enumerate(texts))
        menu = "".join(f"<li><a href='/{x}'>{x}</a>" for x in ("home", "news", f"p{i % 4}"))
        rows.append((i, f"http://h.org/{i}", f"<nav><ul>{menu}</ul></nav><article><p>body {i}</p></article><aside>{body}</aside>"))
        want[i] = "\n".join([f"body {i}", *texts])
    pages = _pages(spark, rows)
    assert {r.page_id: r.text for r in site_style.extract(pages).collect()} == want
    counted = {(r.decided, r.removed): r.blocks for r in site_style.decisions(pages).collect()}
    assert counted == {("leaf", False): 9, ("branch", False): 27, ("branch", True): 27}


def test_pages_hold_their_documents(spark):
    texts = {" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()}
    pages = QUERIES["op8_html_extraction"](spark, SF).collect()
    # The first block is the heading, which the document does not repeat.
    assert all(" ".join(r.text.split("\n", 1)[1].split()) in texts for r in pages)
    assert all(r.n_chars == len(r.text) for r in pages)


# Registered queries --------------------------------------------------------------


@pytest.mark.parametrize(("name", "label", "share"), [("op1_toxicity", "toxic", 0.9), ("op6_quality", "quality", 0.9)])
def test_held_out_accuracy(spark, name, label, share):
    import zlib

    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES[name](spark, SF).collect()
    n, r = (5, 0) if label == "toxic" else (3, 1)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % n == r) for x in rows)
    held = [x for x in rows if x.held_out and x.doc_id in labels]
    assert sum(x.predicted == labels[x.doc_id] for x in held) / len(held) >= share


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        after = common.staged(stage(spark, docs, SMALL), f"test-{name}")
        if name != "bpe":
            assert after.columns == docs.columns
            assert after.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        else:
            assert after.count() == docs.count()
        docs = after
    assert sorted(docs.collect()) == sorted(corpus_pipeline.run(spark, SMALL).collect())
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_dedup_stage_knows_rows_by_id_and_text(spark):
    text, other = " ".join(f"w{n}" for n in range(30)), " ".join(f"x{n}" for n in range(30))
    rows = [(0, text, "a", 1), (1, text, "a", 1), (1, other, "a", 1), (2, "y " + other, "b", 1), (3, "z", "b", 1), (3, "z", "b", 1), (4, None, "b", 1), (5, "", None, 1), (None, text, "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copy string, mark long")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, SMALL)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(0, text), (1, other), (3, "z"), (4, None), (5, ""), (None, text)], key=str)
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), SMALL).count() == 0


ODD = [(1, None, "a"), (2, "", "a"), (None, "null id", "a"), (3, "w " * 200_000, "b"), (4, "twice", "b"), (4, "twice", "b")]


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame([(*row, 7, "x") for row in ODD], "doc_id long, text string, source string, score int, removed_lines string")
    for stage in (corpus_pipeline.line_dedup_stage, corpus_pipeline.decontamination_stage, corpus_pipeline.bpe_stage):
        out = stage(spark, docs, SMALL)
        assert out.count() == len(ODD), stage
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    kept = corpus_pipeline.quality_stage(spark, docs, SMALL)
    assert kept.columns == docs.columns and kept.count() <= len(ODD)
