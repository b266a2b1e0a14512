"""Near duplicates, benchmark passages, page text and vectors against brute force."""

import itertools
import pickle
import random
import re
from collections import Counter

import numpy as np
import pytest

from eventloom.llm import ann, decontaminate, jaccard, page_text
from eventloom.llm.words import hash_words, shingles


def words_of(text):
    return re.sub(r"\W+", " ", (text or "").lower()).split()


def shingle_set(text, width=5):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def family(rng, size, words=120, changes=6):
    base = [f"t{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randrange(changes)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(9999)}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = [t for size in (40, 3, 2, 2, 5) for t in family(rng, size)] + [t for _ in range(30) for t in family(rng, 1)]
    texts += ["", None, "!!", "only three words", "Only three WORDS!", "other three words", texts[0], texts[0], texts[41].upper()]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(None, texts[1]), (7, texts[60]), (7, texts[60])]


def brute(rows):
    sets = [frozenset(shingle_set(t)) for _, t in rows]
    different = list({s for s in sets if s})
    links = {s: set() for s in different}
    for a, b in itertools.combinations(different, 2):
        if len(a & b) / len(a | b) >= jaccard.THRESHOLD:
            links[a].add(b)
            links[b].add(a)
    return sets, links


@pytest.mark.parametrize("block", [7, 1000])
def test_join_equals_brute_force(spark, corpus, block):
    sets, links = brute(corpus)
    table = spark.createDataFrame([(i, t, 1, "k", 0) for i, t in corpus], "doc_id bigint, text string, id int, key string, band int")
    rows = jaccard.link_classes(table, block=block).collect()
    assert len(rows) == len(corpus)
    by_text = {(r.doc_id, r.text): r for r in rows}
    for (i, t), s in zip(corpus, sets, strict=True):
        row = by_text[i, t]
        assert row["__links"] == len(links.get(s, ()))
        assert row["__copies"] == (sets.count(s) if s else 1)
    root_of = {}
    for (i, t), s in zip(corpus, sets, strict=True):
        if s:
            assert root_of.setdefault(s, by_text[i, t]["__root"]) == by_text[i, t]["__root"]
    for a in links:
        reached, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - reached:
                reached.add(b)
                todo.append(b)
        assert {s for s in root_of if root_of[s] == root_of[a]} == reached
    got = jaccard.jaccard_join(table.select("doc_id", "text"), block=block).collect()
    assert {r.class_id for r in got if r.n_links == 0 and r.n_copies == 1 and r.doc_id} <= {r.doc_id for r in got}


def test_one_of_each_group_stays(spark, corpus):
    table = spark.createDataFrame([(i, t, "x") for i, t in corpus], "doc_id bigint, text string, root string")
    kept = jaccard.keep_one(table)
    assert kept.schema == table.schema
    got, rows = kept.collect(), jaccard.jaccard_join(table.select("doc_id", "text")).collect()
    groups = {r.class_id for r in rows if r.n_links or r.n_copies > 1}
    alone = sum(1 for r in rows if not r.n_links and r.n_copies == 1)
    assert len(got) == len(groups) + alone and groups <= {r.doc_id for r in got}
    assert jaccard.keep_one(table.limit(0)).collect() == []


def test_pruning_bound():
    for n in (16, 64, 128):
        m = jaccard.least_matches(0.8, 1e-6, n)
        assert 0 < m < 0.8 * n
        assert jaccard.least_matches(0.8, 1e-2, n) > m


def test_components(spark):
    edges = [(b, a) for a, b in zip(range(1, 40), range(2, 41), strict=True)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(jaccard.components(spark.createDataFrame(edges, "id bigint, root bigint")).collect())
    assert all(got[i] == 1 for i in range(1, 41)) and got[100] == got[95] == got[90] == 90


def test_benchmark_passages(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(500)}"
    items = [" ".join(word() for _ in range(n)) for n in [*range(1, 12), *range(14, 60, 3), 400]]
    bench = [(i, t) for i, t in enumerate(items)] + [(900, None), (901, "?!"), (None, "no id here at all")]
    rows, planted = [], set()
    for i in range(240):
        text = [word() for _ in range(rng.randrange(0, 150))]
        if i % 2:
            item = rng.randrange(len(items))
            at = rng.randrange(len(text) + 1)
            text[at:at] = items[item].upper().split()
        rows.append((i, ", ".join(text)))
    rows += [(500, None), (501, ""), (None, items[20]), (None, "clean"), (502, items[15]), (502, items[15])]
    for i, t in rows:
        padded = f" {' '.join(words_of(t))} "
        planted |= {(i, n) for n, item in enumerate(items) if f" {item} " in padded}
    table = spark.createDataFrame([(i, t, 5, 0) for i, t in rows], "doc_id bigint, text string, item_id int, block int")
    found = decontaminate.contaminated(table, spark.createDataFrame(bench, "item_id bigint, text string")).collect()
    exact = {(r.doc_id, r.item_id) for r in found if r.similarity > 0.999}
    assert exact == planted
    for r in found:
        assert r.similarity >= decontaminate.THRESHOLD
    assert sum((r.doc_id, r.item_id) == (502, 15) for r in found) == 2
    kept = decontaminate.without_contaminated(table, spark.createDataFrame(bench, "item_id bigint, text string"))
    assert kept.schema == table.schema
    bad = {r.doc_id for r in found}
    assert sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for i, t in rows if i not in bad or t == "clean")
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(table, nothing).collect() == []
    assert decontaminate.contaminated(table.limit(0), nothing).collect() == []


def test_near_passages_reach_the_threshold_and_others_do_not():
    rng = random.Random(4)
    item = [f"w{rng.randrange(500)}" for _ in range(60)]
    items = decontaminate.Items([(1, " ".join(item))], {}, 1)
    noise = [f"x{rng.randrange(500)}" for _ in range(200)]
    one, three = list(item), list(item)
    one[30] = "changed"
    three[10] = three[30] = three[50] = "changed"
    texts = [" ".join(noise[:k] + x + noise[k:]) for k in (0, 3, 50, 200) for x in (item, one, three)]
    found = decontaminate.find(items, texts)
    for n in range(len(texts)):
        expected = [1.0, 51 / 61, 41 / 71][n % 3]
        assert ((n, 1) in found) == (expected >= 0.8)
        if (n, 1) in found:
            assert abs(found[n, 1][0] - expected) < 1e-9


def test_short_texts_and_edited_copies_are_judged_by_weights():
    words = [f"c{k}" for k in range(65)] + [f"own{k}" for k in range(39)]
    common = shingles(hash_words([" ".join(words[:65])]))[0].tolist()
    items = decontaminate.Items([(1, " ".join(words))], dict.fromkeys(common, 200), 200)
    held = items.sizes[0].shingles[0]
    noise = [f"n{k}" for k in range(80)]
    edited = list(words)
    for k in (5, 15, 25, 35, 45, 55):
        edited[k] = "changed"
    texts = [" ".join(x) for x in (words[-43:], words[-40:], noise + words[-43:] + noise, noise + edited + noise, noise)]
    want = {}
    for n, text in enumerate(texts):
        own = shingles(hash_words([text]))[0]
        values = [decontaminate.weighted_similarity(own[k : k + 100], held, items.weigh) for k in range(max(0, len(own) - 100) + 1)]
        if max(values) >= decontaminate.THRESHOLD:
            want[n, 1] = (max(values), values.index(max(values)))
    assert {k: v[:2] for k, v in decontaminate.find(items, texts).items()} == want
    assert {(0, 1), (3, 1)} >= set(want) and (0, 1) in want


def test_recall_of_edited_copies_by_fingerprints_alone():
    """Edited copies whose best window has a similarity of 0.8 or more, by brute force over all windows around the copy."""
    rng = random.Random(6)
    phrase = [f"c{k}" for k in range(50)]
    items = [[f"w{rng.randrange(900)}" for _ in range(rng.randrange(20, 150))] for _ in range(40)]
    items += [phrase[: rng.randrange(10, 50)] + [f"o{rng.randrange(4000)}" for _ in range(rng.randrange(20, 60))] for _ in range(40)]
    texts = [" ".join(i) for i in items]
    holders = Counter(h for t in texts for h in set(shingles(hash_words([t]))[0].tolist()))
    made = decontaminate.Items(list(enumerate(texts)), {h: n for h, n in holders.items() if n > 1}, len(texts))
    found = Counter()
    for n, item in enumerate(items):
        for _ in range(6):
            own = list(item)
            for _ in range(rng.randrange(1, len(item) // 25 + 2)):
                at, kind = rng.randrange(len(own)), rng.randrange(3)
                own[at : at + (kind < 2)] = [] if kind == 1 else [f"z{rng.randrange(9999)}"]
            before = [f"x{rng.randrange(500)}" for _ in range(rng.randrange(150))]
            text = " ".join(before + own + [f"x{rng.randrange(500)}" for _ in range(rng.randrange(150))])
            hashes = shingles(hash_words([text]))[0]
            size = next(s for s in made.sizes if n in s.items)
            i = size.items.index(n)
            starts = range(max(0, len(before) - 12), max(1, min(len(before) + 12, len(hashes) - size.counts[i] + 1)))
            best = max((decontaminate.weighted_similarity(hashes[s : s + size.counts[i]], size.shingles[i], made.weigh) for s in starts), default=0)
            if best >= decontaminate.THRESHOLD:
                found[best >= 0.9, (0, n) in decontaminate.find(made, [text])] += 1
    assert found[False, True] >= 0.95 * (found[False, True] + found[False, False]) > 90
    assert found[True, True] >= 0.99 * (found[True, True] + found[True, False])


def test_items_travel_small():
    rng = random.Random(1)
    rows = [(i, " ".join(f"v{rng.randrange(8000)}" for _ in range(rng.randrange(20, 90)))) for i in range(2000)]
    items = decontaminate.Items(rows, {}, len(rows))
    items.sizes[0].index()
    assert len(pickle.dumps(items)) < 2000 * 2500


def test_all_fingerprints_within_the_radius_are_found():
    rng = np.random.default_rng(2)
    size = decontaminate.Size(5, counts=[30] * 20, items=list(range(20)), prints=[int(x) for x in rng.integers(0, 1 << 63, 20)])
    own = np.array(size.prints, np.uint64)
    prints = np.concatenate([rng.integers(0, 1 << 63, 300, dtype=np.uint64), own])
    for n in range(300):
        for bit in rng.choice(64, rng.integers(0, 20), replace=False):
            prints[n] = own[n % 20] ^ np.uint64(1 << int(bit)) if bit == 0 else prints[n]
        flips = np.uint64(0)
        for bit in rng.choice(64, rng.integers(0, 20), replace=False):
            flips |= np.uint64(1) << np.uint64(bit)
        prints[n] = own[n % 20] ^ flips
    window, item, _ = decontaminate.near(size, prints)
    distance = np.bitwise_count(prints[:, None] ^ own[None, :])
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == set(zip(*map(list, np.nonzero(distance <= decontaminate.RADIUS)), strict=True))


def test_vectors(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(1500, 16))
    data[100:700] = data[100]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [1.0, None] + [0.0] * 14), (5060, [float("nan")] * 16), (5080, [float("inf")] * 16), (None, data[3].tolist()), (5100, [1.0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, one int, block int")
    got = ann.search(table, block=200, query_block=30).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(range(0, 1500, 20))
    recall = []
    for q, found in by.items():
        scores = (data * data[q]).sum(axis=1)
        scores[q] = -np.inf
        order = np.lexsort((np.arange(1500), -scores))[:20]
        recall.append(len(set(order.tolist()) & {v for v, _ in found}) / 20)
        assert [x for x in found] == sorted(found, key=lambda x: (-x[1], x[0])) and len(found) == 20
        assert all(abs(s - data[v] @ data[q]) < 1e-9 for v, s in found)
    assert np.mean(recall) > 0.9
    assert [v for v, _ in by[100]] == list(range(101, 121))  # ties go to the smaller id
    assert ann.search(table.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in ann.search(table.filter("vec_id IN (0, 1)")).collect()] == [(0, 1, 1)]


def test_traversal_is_in_order_of_the_sum():
    rng = np.random.default_rng(6)
    one, two = rng.normal(size=9), rng.normal(size=7)
    sizes = rng.integers(0, 3, (9, 7))
    for wanted in (1, 10, 1000):
        got = {(i, j) for i, js in ann.traverse(one, two, sizes, wanted).items() for j in js}
        order = sorted(itertools.product(range(9), range(7)), key=lambda c: one[c[0]] + two[c[1]])
        held, want = 0, set()
        for i, j in order:
            if held >= wanted:
                break
            held += sizes[i, j]
            if sizes[i, j]:
                want.add((i, j))
        assert got == want


PAGE = (
    '<html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header><div>Site</div></header>'
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice">We use cookies &amp; more.</div>'
    "<article><h1>A   title</h1><p>First &lt;b&gt; paragraph,<br>with <a href='#'>a link</a> &amp; more text, and on it goes.<p><b>Second one,\nwhich is"
    " not closed, and goes on.<div class='ad'>Buy this now</div><p>Third paragraph of the text, also rather long, as they are.</p></article>"
    '<aside class="sidebar"><h3>Related</h3><p>Other articles that you may like to read today.</p></aside>'
    '<section id="comments"><div class="comment"><p>I do not agree with the article, it is wrong.</p></div></section>'
    "<form><label>Name</label><input name=n><p>Send us your message.</p></form><footer>&copy; 2024 Site</footer></body></html>"
)
TEXT = "A title\nFirst <b> paragraph, with a link & more text, and on it goes.\nSecond one, which is not closed, and goes on.\nThird paragraph of the text, also rather long, as they are."


def test_page_text(spark):
    pages = [(i, f"u{i}", PAGE.replace("First", f"First{i}")) for i in range(12)] + [(50, None, None), (51, "u", ""), (None, "u", PAGE), (None, "u", PAGE)]
    table = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id bigint, url string, html string, text string, n_chars int")
    got = page_text.extract(table).collect()
    assert len(got) == len(pages)
    for row in got:
        want = "" if row.page_id in (50, 51) else TEXT if row.page_id is None else TEXT.replace("First", f"First{row.page_id}")
        assert (row.text, row.n_chars) == (want, len(want))
    assert page_text.extract(table.limit(0)).collect() == []


def test_parser_and_decoding():
    tree = page_text.parse("<p>a<p>b<b>c</p><ul><li>x<li>y</ul>tail &amp <3 <div>in<p>p</div><!-- no --><textarea>no</textarea>end")
    order, rows = page_text.describe(tree)
    assert [p for n in order for p in n.parts] == ["a", "bc", "x", "y", "tail & <3", "in", "p", "end"]
    assert rows.shape == (len(order) - 1, page_text.FEATURES)
    assert page_text.parse("<head><title>t</title><meta x><body><p>text").children[0].parts == ["text"]
    inner = {id(n): i for i, n in enumerate(order[1:])}
    odds = np.full(len(order) - 1, -1.0)
    items = [n for n in order if n.tag == "li"]
    odds[[inner[id(n)] for n in items]] = 0.4  # together not worth their list
    assert page_text.decode(order, odds) == []
    odds[inner[id(items[0])]] = 2.0
    assert page_text.decode(order, odds) == ["x", "y"]
    deep = page_text.parse("<div>" * 3000 + "text")
    assert page_text.decode(*[x if i == 0 else np.ones(len(x)) for i, x in enumerate(page_text.describe(deep))]) == ["text"]


def test_places_among_many_siblings():
    order, rows = page_text.describe(page_text.parse("".join(f"<p>{'a' * (k + 1)}</p>" for k in range(60)) + "".join(f"<div>{'b' * (k + 1)}</div>" for k in range(40))))
    assert len(rows) == 100 and [n.tag for n in order[1:]] == ["p"] * 60 + ["div"] * 40
    assert np.allclose(rows[:, 15], np.arange(100) / 100)
    assert np.allclose(rows[:, 16], [0.6] * 60 + [0.4] * 40)
    assert np.isclose(rows[70, 34], 12 / 11) and np.isclose(rows[70, 35], 10 / 11)


def test_pages_to_learn_from_are_different(spark):
    hot = "<p>a page of very many rows</p>"
    rows = [(hot,)] * 400 + [(f"<p>page {k}</p>",) for k in range(60)] * 2 + [(None,), ("",)]
    table = spark.createDataFrame(rows, "html string")
    for sample, most in ((20, 20), (1000, 61)):
        listed = [page for r in page_text.sample_pages(table, sample=sample).collect() for page in r.html]
        assert len(listed) == len(set(listed)) == most
    assert page_text.sample_pages(table.limit(0)).collect() == []
