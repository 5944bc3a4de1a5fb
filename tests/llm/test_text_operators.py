import collections
import html
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimweir.llm.decontaminate import find_leaks, leak_indexes, without_leaks
from claimweir.llm.kd_shards import kd_shards
from claimweir.llm.lm import score_texts
from claimweir.llm.packing import Schedule, WordTokens, pack
from claimweir.llm.pages import COPY, few_lines, page_lines, page_text, shared_lines
from claimweir.llm.queries import op9_leaks, tokenizer_path
from claimweir.llm.shared import fold, table
from tests.llm.helpers import EDGES, documents, shingles, words


def test_leaks_equal_brute_force(spark, sf):
    docs = [(r.doc_id, shingles(r.text, 5)) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, shingles(r.text, 5)) for r in table(spark, sf, "benchmark").collect()]
    want = {(d, i, len(x & y), len(y)) for d, x in docs for i, y in items if y and 10 * len(x & y) >= 8 * len(y)}
    assert want and {tuple(r)[:4] for r in op9_leaks(spark, sf).collect()} == want


def test_leaks_edges(spark, monkeypatch):
    docs = documents(spark, [*EDGES, (20, "x y ONE two three four y x", "en", "a"), (21, "a b c d e f g h i j k l m", "en", "a")])
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "a b c d e f g h i Q k l"), (5, "one two three"), (None, "a b c"), (6, "a b c d e f X h i j k l m")]
    items = spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 AS id")
    found = {(r.doc_id, r.item_id) for r in find_leaks(docs, leak_indexes(items)).collect()}
    assert found == {(d, i) for d in (4, 5, None, 20) for i in (1, 5)}
    monkeypatch.setattr("claimweir.llm.decontaminate.INDEX_SHINGLES", 8)
    indexes = leak_indexes(items)
    assert len(indexes) > 3 and {(r.doc_id, r.item_id) for r in find_leaks(docs, indexes).collect()} == found
    assert {r.doc_id for r in without_leaks(docs, indexes).collect()} == {1, 2, 3, 6, 7, 8, 21}
    assert find_leaks(docs, leak_indexes(items.filter("false"))).collect() == []
    assert find_leaks(docs.filter("false"), indexes).collect() == []


def test_schedule_places_every_token_once_and_holds_shares():
    draw = random.Random(1)
    for _ in range(150):
        n, window = draw.randint(1, 6), draw.choice([1, 4, 8, 16])
        amounts = [draw.randint(0, 60) for _ in range(n)]
        targets = draw.choice([amounts, [draw.randint(0, 3) for _ in range(n)], [draw.random() for _ in range(n)]])
        schedule, got = Schedule(amounts, targets, window), {}
        for k, amount in enumerate(amounts):
            a = following = 0
            while a < amount:
                b = min(amount, a + draw.randint(1, 20))
                for at, length, sequence, offset in schedule.pieces(k, a, b):
                    assert at == following and length > 0
                    following = at + length
                    for j in range(length):
                        assert got.setdefault((sequence, offset + j), k) == k and offset + j < window
                a = b
            assert following == amount
        assert sorted(got) == [(i // window, i % window) for i in range(sum(amounts))]
    schedule = Schedule([3000, 1000, 500], [3000, 1000, 500], 90)
    for k, share in enumerate((60, 20, 10)):
        lengths = collections.Counter()
        for _, length, sequence, _ in schedule.pieces(k, 0, [3000, 1000, 500][k]):
            lengths[sequence] += length
        assert all(abs(n - share) <= 1 for n in lengths.values())


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aB'sé ÉΣß́\n\t\xa0 　\x1c.,!?7<|endofx>中"), max_size=40))
def test_words_are_encoded_as_whole_texts_are(text):
    encoder = _encoder()
    whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode_all([text])[0], encoder.kind).tolist() == whole


def _encoder(known=[]):  # noqa: B006
    if not known:
        known.append(WordTokens(tokenizer_path()))
    return known[0]


def check_packing(docs, found, window=2048):
    """Every id of every document lies in exactly one piece, sequences have no gaps, only the last is short."""
    encoder = _encoder()
    ids = {}
    for r in docs:
        own = np.frombuffer(encoder.encode_all([r.text])[0], encoder.kind)
        ids.setdefault(r.doc_id, []).append(np.append(own, 1).astype("<u4").tobytes())
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        own = ids[r.doc_id][0]
        assert r.doc_tokens == len(own) // 4
        assert r.ids_crc32 == zlib.crc32(own[4 * r.start : 4 * (r.start + r.length)])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, own in ids.items():
        if len(own) == 1:
            at = 0
            for start, length in sorted(pieces[doc]):
                assert start == at
                at += length
            assert at == len(own[0]) // 4
        assert sum(n for _, n in pieces[doc]) == sum(len(x) for x in own) // 4
    for number, own in sequences.items():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == window or number == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))


def test_packing_round_trip(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    monkeypatch.setattr("claimweir.llm.packing.BUCKET_BYTES", 100_000)
    check_packing(docs.collect(), pack(docs, tokenizer_path()).collect())
    targets = {"src0": 1, "src1": 3}
    found = pack(docs, tokenizer_path(), window=512, targets=targets).collect()
    check_packing(docs.collect(), found, 512)
    first = collections.Counter()
    for r in found:
        if r.sequence_id == 0:
            first[r.source] += r.length
    assert first == {"src0": 128, "src1": 384}


def test_packing_edges(spark):
    docs = documents(spark, EDGES)
    found = pack(docs, tokenizer_path(), window=64).collect()
    check_packing([r for r in docs.collect()], found, 64)
    assert {r.doc_id for r in found} == {r[0] for r in EDGES}
    assert pack(docs.filter("false"), tokenizer_path()).collect() == []


def test_pages_without_an_article_lose_lines_of_their_neighbour(spark):
    page = "<html><body><div>Site &amp; name</div><p>{}</p><p>more {}</p><div>All rights</div></body></html>"
    rows = [(i, f"http://h/a/{i}", page.format(f"story {i}", f"text {i}")) for i in range(4)]
    rows += [(10, "http://h/a/0", rows[0][2]), (11, "http://other/", page.format("x", "y")), (12, None, None), (13, "u", "")]
    rows += [(14, "http://h/a/2b", "<article><h1>T</h1><p>Site &amp; name</p></article><nav>menu</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS mark")
    found = {r.page_id: (r.text, r.n_chars) for r in page_text(pages).collect()}
    want = {i: f"story {i} more text {i}" for i in range(4)} | {10: "story 0 more text 0", 11: "Site & name x more y All rights", 12: "", 13: "", 14: "T Site & name"}
    assert found == {i: (t, len(t)) for i, t in want.items()}
    assert page_text(pages.filter("false")).collect() == []


def test_markup():
    assert page_lines("a<!-- x -->b<script>if (a < b) '</p>'</script> c") == (["ab c"], False, -1)
    text = "<main><aside>s</aside><header>Head</header><p>A<b>b</b>&eacute;&#33;\n c<br>d<p class='ad-box'>buy</p><div id=comments><p>nice</p></div></main>tail"
    assert page_lines(text) == (["Head", "Abé! c", "d"], True, -1)
    assert page_lines("<div hidden>x</div><p title=\"a>b\">y <i>z</p></i>w<form>f") == (["y z", "w"], False, -1)
    assert page_lines("<p class='adventure'>kept</p>")[0] == ["kept"]
    assert page_lines("1 < 2 <")[0] == ["1 < 2 <"]


def test_markup_inside_an_article_is_text_unless_it_is_an_advert():
    page = '<article><h1>T</h1><p>Keep one.</p><section class="search"><p>How search works.</p></section><div class="share-text">A share fell.</div><div class="ad-box">buy</div><aside>x</aside></article>'
    assert page_lines(page) == (["T", "Keep one.", "How search works.", "A share fell."], True, 0)
    assert page_lines('<p a=">">x</p><p a=\'"\'>y</p><p b="unclosed>z</p><p>w</p>')[0][:2] == ["x", "y"]


@pytest.mark.parametrize(
    "text",
    ["<a " * 350_000, "<p a='" * 180_000 + ">", "<p a='" * 180_000, "<a b=\"'>" * 120_000, "<div>" * 100_000 + "</p>" * 100_000, "<div>" * 30_000 + "<article>x</article>" * 30_000,
     "<div>" * 100_000 + "</div>" * 100_000, "<!-- " * 200_000, "<script>" * 100_000, "<" * 1_000_000, "&" * 500_000, "</" * 300_000, "<main>" * 100_000, "word " * 200_000, "<p>x" * 200_000],
)
def test_long_and_broken_pages_take_linear_time(text):
    began = time.perf_counter()
    page_lines(text)
    assert time.perf_counter() - began < 6


def test_mirrored_articles_keep_headline_and_lead(spark):
    page = "<body><article><h1>{0}</h1><p><b>Lead of {0}</b></p><p>Les.</p><p>own {1}</p><p>Les.</p><p>Follow us</p></article></body>"
    rows = [(i, f"http://h/{i}", page.format("Same head", i)) for i in range(4)] + [(10 + i, f"http://h/x{i}", page.format(f"Head {i}", f"text {i}")) for i in range(4)]
    found = _texts(spark, rows)
    # with other headlines the shared end goes; versions of one article at the end of a host know nothing of its template
    assert {i: found[10 + i] for i in (1, 2)} == {i: f"Head {i} Lead of Head {i} Les. own text {i}" for i in (1, 2)}
    assert all(found[i].startswith(f"Same head Lead of Same head Les. own {i}") for i in range(4))


def plain_page_texts(spark, rows):
    """The rules of page_text, one page at a time."""
    parsed = {i: page_lines(text) for i, _, text in rows}
    marks = {r.i: r.m for r in spark.createDataFrame([(i, "\n".join(p[0])) for i, p in parsed.items()], "i long, t string").selectExpr("i", "xxhash64(t) AS m").collect()}

    def split(url):
        m = re.match(r"(?:([A-Za-z][\w+.-]*)://([^/?#]*))?([^?#]*)", url or "")
        return (m[2] or "").lower(), m[3]

    groups = {}
    for i, url, _ in rows:
        if parsed[i][0]:
            host, path = split(url)
            groups.setdefault((host, parsed[i][1]), {})[path, marks[i]] = parsed[i]

    def weight(a, b):
        return sum(len(line) for line, s in zip(a, shared_lines(a, b), strict=True) if s)

    def copy(a, b, explicit):
        same = explicit and a[2] >= 0 <= b[2] and a[0][a[2]] == b[0][b[2]]
        return same or weight(a[0], b[0]) >= COPY * max(sum(map(len, a[0])), sum(map(len, b[0])))

    out = {}
    for (host, explicit), pages in groups.items():
        order = sorted(pages)
        for k, key in enumerate(order):
            mine, sides = pages[key], []
            for step in (-1, 1):
                chain, j = [], k
                while len(chain) < 2 and 0 <= j + step < len(order):
                    if not copy(pages[order[j]] if step > 0 else pages[order[j + step]], pages[order[j + step]] if step > 0 else pages[order[j]], explicit):
                        chain.append(order[j + step])
                    j += step
                sides.append(chain)
            before, after = sides
            if explicit and (not before or not after):
                near = (before or after)[:2]
                near = near if before else near[::-1]
            else:
                near = [*before[:1], *after[:1]]
            near.sort(key=lambda o: -len(os.path.commonprefix([key[0], o[0]])))
            near = [pages[o] for o in near if not copy(mine, pages[o], explicit)][: 1 + explicit]
            gone = set()
            if len(near) == 1 + explicit and not explicit:
                gone = {n for n, s in enumerate(shared_lines(mine[0], near[0][0])) if s}
            elif len(near) == 2:
                body, others = mine[0][mine[2] + 1 :], [o[0][o[2] + 1 :] for o in near]
                edges = [{n for n in range(len(body)) if body[: n + 1] == o[: n + 1] or body[n:] == o[len(o) - len(body) + n :] and len(o) >= len(body) - n} for o in others]
                gone = {n + mine[2] + 1 for n in edges[0] & edges[1]} if len(edges[0] & edges[1]) < len(body) else set()
            out[host, explicit, key] = " ".join(line for n, line in enumerate(mine[0]) if n not in gone)
    return {i: out.get((split(url)[0], parsed[i][1], (split(url)[1], marks[i])), "") for i, url, _ in rows}


def test_page_text_equals_brute_force(spark, sf):
    known = [(r.page_id, r.url, r.html) for r in table(spark, sf, "pages").select("page_id", "url", "html").collect()]
    draw = random.Random(4)
    some = []
    for i in range(160):
        article = draw.random() < 0.5
        body = [draw.choice(["Menu", "About us"])] * (draw.random() < 0.8) + [f"story {draw.randrange(6)}" for _ in range(draw.randint(0, 4))] + ["Les."] * draw.randrange(2) + ["All rights"] * (draw.random() < 0.7)
        inside = f"<h1>Head {draw.randrange(5)}</h1>" * (draw.random() < 0.7) + "".join(f"<p>{x}</p>" for x in body)
        some.append((100_000 + i, draw.choice([f"http://h{draw.randrange(3)}/{draw.choice('ab')}/{draw.randrange(40)}", f"https://H1/b?x={i}", None, "p/q"]), f"<article>{inside}</article>" if article else f"<body>{inside}</body>"))
    rows = known + some
    assert _texts(spark, rows) == plain_page_texts(spark, rows)


def test_given_articles_come_whole(spark):
    """In the given pages the article is the main text, and all of it is."""
    pages = table(spark, "/root/testdata/sf0.01", "pages").collect()
    found = _texts(spark, [(r.page_id, r.url, r.html) for r in pages])
    for r in pages:
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        assert found[r.page_id] == plain_article(inside)


def plain_article(inside):
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inside))).split())


def test_shared_lines_are_a_longest_common_subsequence():
    def length(a, b):
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        return m[-1][-1]

    draw = random.Random(2)
    for _ in range(200):
        a, b = ([draw.choice(letters) for _ in range(draw.randint(0, 12))] for letters in ("abcde", "abcdef"))
        shared = shared_lines(a, b)
        rest = iter(b)
        assert shared.sum() == length(a, b) and all(x in rest for x, s in zip(a, shared, strict=True) if s)


def test_articles_of_the_given_pages(spark, sf):
    for r in page_text(table(spark, sf, "pages")).join(table(spark, sf, "pages").select("page_id", "html"), "page_id").collect():
        inside = r.html[r.html.index("<article>") : r.html.index("</article>")]
        assert r.text and "<" not in r.text and r.n_chars == len(r.text) and "  " not in r.text
        assert r.text.split()[0] in inside and "&copy;" not in r.text


def test_shards_have_nearly_equal_bytes(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    found = kd_shards(docs).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    groups = collections.defaultdict(set)
    for r in found:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[texts[r.doc_id]].add(r.shard)
    assert len(found) == len(texts) and set(sizes) == set(range(8))
    assert max(sizes.values()) < 1.03 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    copies = collections.Counter(texts[r.doc_id] for r in found)
    assert all(len(g) == 1 or copies[t] * (len(t.encode()) + 1) > sum(sizes.values()) / 800 for t, g in groups.items())


def test_shards_of_edges_and_hot_groups(spark):
    docs = documents(spark, EDGES)
    found = kd_shards(docs).collect()
    assert sorted((r.doc_id or 0, r.size) for r in found) == sorted((r[0] or 0, len((r[1] or "").encode()) + 1) for r in EDGES)
    assert kd_shards(docs.filter("false")).collect() == []
    hot = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}", "en", "a") for i in range(6000)], "doc_id long, text string, lang string, source string")
    sizes = collections.Counter()
    for r in kd_shards(hot).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.04 * min(sizes.values())


@pytest.mark.parametrize("shards", [8, 21])
def test_shards_are_the_leaves_of_a_k_d_tree(spark, sf, shards):
    """Every node is cut on its widest dimension, as near to its share of the weight as one group allows."""
    docs = table(spark, sf, "documents")
    found = {r.doc_id: r.shard for r in kd_shards(docs, shards, dimensions=("size", "doc_id")).collect()}
    groups = {}
    for r in docs.collect():
        size = len((r.text or "").encode()) + 1
        at = groups.setdefault((r.text or "", found[r.doc_id]), [0, math.inf, math.inf])
        groups[r.text or "", found[r.doc_id]] = [at[0] + size, min(at[1], math.log2(size)), min(at[2], r.doc_id)]
    ends = [(math.log2(len((t or "").encode()) + 1), i) for t, i in ((r.text, r.doc_id) for r in docs.collect())]
    lows, highs = ([f(e[i] for e in ends) for i in (0, 1)] for f in (min, max))
    points = [(k[1], g[0], [(g[i + 1] - lows[i]) / (highs[i] - lows[i]) for i in (0, 1)]) for k, g in groups.items()]
    heaviest = max(p[1] for p in points)

    def check(first, leaves, own):
        if leaves == 1:
            assert {p[0] for p in own} == {first}
            return
        half = leaves // 2
        parts = [[p for p in own if p[0] < first + half], [p for p in own if p[0] >= first + half]]
        spans = [max(p[2][i] for p in own) - min(p[2][i] for p in own) for i in (0, 1)]
        widest = spans.index(max(spans))
        assert max(p[2][widest] for p in parts[0]) <= min(p[2][widest] for p in parts[1])
        weight = sum(p[1] for p in own)
        assert abs(sum(p[1] for p in parts[0]) - weight * half / leaves) <= max(heaviest, weight / leaves / 512)
        check(first, half, parts[0])
        check(first + half, leaves - half, parts[1])

    check(0, shards, points)


def test_shards_by_target_bytes(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = kd_shards(docs, target_bytes=40_000).collect()
    sizes = collections.Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert len(sizes) == -(-sum(sizes.values()) // 40_000) > 60 and max(sizes.values()) < 1.5 * 40_000
    assert len(kd_shards(docs, target_bytes=1 << 40).select("shard").distinct().collect()) == 1


def test_automaton_equals_direct_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out"))
    share, strength = 1e-4, 50.0
    found = {r.doc_id: r for r in score_texts(docs, docs.filter("NOT held_out"), share, strength, keep=("held_out",)).collect()}
    rows = [(r.doc_id, words(r.text), r.held_out) for r in docs.collect()]
    count, arcs, history = collections.Counter(), collections.Counter(), collections.Counter()
    for _, w, held in rows:
        if not held:
            count.update([*w, None])
    total, distinct = sum(count.values()), len(count)
    often = {w for w, n in count.items() if w is not None and n >= total * share}
    for _, w, held in rows:
        if not held:
            for h, x in zip([0, *w], [*w, None], strict=True):
                if h == 0 or h in often:
                    arcs[h, x if x in often or x is None else 1] += 1
                    history[h] += 1
    chances = lambda h, x: (
        ((arcs[h, x] if x in often or x is None else 0) + (strength + arcs[h, 1]) * (count[x] + 1) / (total + distinct + 1)) / (history[h] + strength)
        if h in history
        else (count[x] + 1) / (total + distinct + 1)
    )
    for i, w, held in rows:
        r = found[i]
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (held, len(w) + 1, total, sum(x in count for x in [*w, None]))
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in [*w, None]), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(chances(h, x)) for h, x in zip([0, *w], [*w, None], strict=True)), rel_tol=1e-9)
    for h in [0, *list(often)[:20]]:  # chances of all known tokens and of the unknown one
        assert math.isclose(sum(chances(h, x) for x in count) + chances(h, "never seen"), 1, rel_tol=1e-9)
    assert sum(r.score for r in found.values() if r.held_out) > sum(r.base_score for r in found.values() if r.held_out)


def test_automaton_edges(spark):
    docs = documents(spark, EDGES)
    found = score_texts(docs, docs).collect()
    assert len(found) == len(EDGES) and {r.n_tokens for r in found if r.doc_id in (1, 2, 6)} == {1}
    empty = score_texts(docs, docs.filter("false")).collect()
    assert {(r.train_tokens, r.n_known, r.score) for r in empty} == {(0, 0, 0.0)}
    assert score_texts(docs.filter("false"), docs).collect() == []


def test_every_pair_of_words_is_an_arc_at_any_size(spark, monkeypatch):
    monkeypatch.setattr("claimweir.llm.lm.RANGE_BYTES", 100_000)
    monkeypatch.setattr("claimweir.llm.lm.CHUNK_BYTES", 200_000)
    draw = random.Random(4)
    texts = [" ".join("w%d" % int(draw.paretovariate(0.5)) for _ in range(400)) + " seldom pair" * (i % 80 == 0) for i in range(400)]
    rows = [(i, text, None, None) for i, text in enumerate(texts)] + [(1000, "seldom pair never w1", None, None), (1001, None, None, None)]
    docs = documents(spark, rows)
    found = {r.doc_id: r for r in score_texts(docs, docs.filter("doc_id < 400")).collect()}
    count, arcs = collections.Counter(), collections.Counter()
    for text in texts:
        w = words(text)
        count.update([*w, None])
        arcs.update(zip([0, *w], [*w, None], strict=True))
    count[0] = count[None]  # starts
    total, distinct = sum(count.values()) - count[0], len(count) - 1
    assert total > 150_000
    for i, text, _, _ in rows:
        w, score = words(text), 0.0
        for h, x in zip([0, *w], [*w, None], strict=True):
            p = (count[x] + 1) / (total + distinct + 1)
            score += math.log10((arcs[h, x] + 100 * p) / (count[h] + 100))
        assert math.isclose(found[i].score, score, rel_tol=1e-9)
        assert (found[i].n_tokens, found[i].n_known, found[i].train_tokens) == (len(w) + 1, sum(x in count for x in [*w, None]), total)


def _texts(spark, rows):
    return {r.page_id: r.text for r in page_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_lines_that_articles_of_a_host_repeat_go(spark):
    page = "<main><p>Read our notice</p><p>story {0}</p>{1}<p>tale {0}</p><div>Subscribe today</div></main>"
    rows = [(i, f"http://h/a/{i}", page.format(i, "<p>a quote</p>" if i in (1, 2) else "")) for i in range(5)]
    mirror = "<article><p>a long article that many paths hold</p></article>"
    rows += [(10 + i, f"http://mirror/{i}", mirror) for i in range(3)] + [(20 + i, f"http://two/{i}", page.format(i, "")) for i in range(2)]
    found = _texts(spark, rows)
    want = {i: f"story {i} a quote tale {i}" if i in (1, 2) else f"story {i} tale {i}" for i in range(5)}
    want |= {10 + i: "a long article that many paths hold" for i in range(3)}
    assert found == want | {20 + i: f"Read our notice story {i} tale {i} Subscribe today" for i in range(2)}


def test_copies_beside_a_page_are_passed_over(spark):
    page = "<p>Menu of the site</p><p>{}</p><p>All rights reserved</p>"
    mirrored = "a story of some length, told at one path and again at the next, and so for long " * 2
    rows = [(i, f"http://h/b/{i}", page.format(mirrored + f"({i})") if i % 2 else page.format(mirrored)) for i in range(9)]
    rows = [(i, url, html.replace("</p><p>All", f"</p><p>{i}</p><p>All")) for i, url, html in rows]
    rows = [(i, url, html.replace(f"({i})", "")) for i, url, html in rows]
    rows += [(20, "http://h/a", page.format("short")), (21, "http://h/c", page.format("a page of its own " * 9))]
    found = _texts(spark, rows)
    assert found == {i: f"{mirrored.strip()} {i}" for i in range(9)} | {20: "short", 21: ("a page of its own " * 9).strip()}


def test_classes_that_only_contain_the_name_of_a_part_are_kept():
    page = '<body><nav>menu</nav><div class="site-content has-sidebar"><article><p>A</p>{}</article></div><div class="sidebar-left">side</div></body>'
    inside = '<section class="related-work"><p>earlier work</p></section><p>at <span class="share-price">9</span> and <b class="notice">more</b></p><div class="share-buttons">Share</div>'
    assert page_lines(page.format(inside)) == (["A", "earlier work", "at 9 and more"], True, -1)
    assert page_lines('<form id="form"><div class="widget-area sidebar"><main>text</main></div></form>') == (["text"], True, -1)
    teasers = '<article><p>text</p></article><div class="related-posts"><article>teaser</article></div><div class="comments"><article class="comment">c</article></div>'
    assert page_lines(teasers) == (["text"], True, -1)
    assert page_lines('<p>text</p><div class="comments"><article class="comment">c</article></div><div class="main-menu">m</div>') == (["text"], False, -1)


def test_pages_are_compared_few_lines_at_a_time():
    page = pa.struct([("own", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("headline", pa.int32())])
    made = [{"own": list(range(n)), "sizes": [1] * n, "headline": -1} for n in (4, 0, 3, 30, 2, 2, 1)]
    beside = [None, {"path": "/x", "page": made[2]}, None, {"path": "/y", "page": None}, {"path": "/z", "page": made[0]}, None, {"path": None, "page": made[1]}]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(made, page), pa.array(beside, pa.struct([("path", pa.string()), ("page", page)]))], names=["at", "page", "before_page"])
    for whole in (batch, pa.RecordBatch.from_arrays([pa.concat_arrays([c[:3], c]) for c in batch.columns], names=batch.schema.names).slice(3)):
        cut = list(few_lines([whole], ["page"], ["before_page", "page"], most=8))
        assert [b.column(0).to_pylist() for b in cut] == [[0, 1], [2], [3], [4, 5], [6]]
        assert pa.Table.from_batches(cut).to_pylist() == batch.to_pylist()
