"""Ranked search, HyperMinHash near duplicates and whitening against brute force, with odd input."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from eventloom.llm import graph, hyperminhash, treap, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, top=20):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    length, df = sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, counts in held:
            m = 75 + (25 * sum(counts.values()) * len(held)) // length
            score = 0
            for term, times in Counter(terms_of(text)).items():
                if term in counts:
                    weight = math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[term] + 1)))
                    score += times * weight * ((10**9 * counts[term]) // (1000 * counts[term] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, n + 1, i, -s) for n, (s, _, i) in enumerate(found[:top])]
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 20, 200])))) for i in range(400)]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (None, docs[8][1]), (500, None), (501, ""), (502, " .,;"), (503, "Ünïcode É w1 w2"), (504, "W1 W2 w3 " * 30_000)]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(15)] + [(3, "w1 w1 w1, W2"), (20, None), (21, "!"), (22, "absent"), (None, "é É ünïcode w1")]
    return docs, items


@pytest.mark.parametrize("shards", [{}, {"shard_documents": 9}, {"shard_postings": 50}])
def test_search_equals_brute_force(spark, library, shards):
    docs, items = library
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, shard string, item int").repartition(3)
    index = treap.build(table, **shards)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, rank int")
    want = ordered(ranked(docs, items))
    assert ordered(treap.search(index, asked, first_shards=2).collect()) == want
    if not shards:
        assert ordered(treap.search(index, asked, item_block=4).collect()) == want


def test_search_of_nothing(spark, library):
    docs = spark.createDataFrame(library[0], "doc_id bigint, text string")
    items = spark.createDataFrame(library[1], "item_id bigint, text string")
    assert treap.rank(docs.limit(0), items).isEmpty()
    assert treap.rank(docs, items.limit(0)).isEmpty()
    assert treap.rank(docs.filter("text IS NULL"), items).isEmpty()


def test_index_is_stored_in_small_row_groups(spark, library, monkeypatch):
    monkeypatch.setattr(treap, "ROW_GROUP_BYTES", 20_000)
    monkeypatch.setattr(treap, "ROWS_AT_ONCE", 5)
    table = spark.createDataFrame(library[0][:300], "doc_id bigint, text string").coalesce(1)
    index = treap.build(table, shard_documents=5)
    (file,) = index.shards.inputFiles()
    stored = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert stored.num_rows == index.shards.count() == 60
    assert max(stored.row_group(i).num_rows for i in range(stored.num_row_groups)) <= 20


def test_quadtree_holds_every_cell():
    rng = np.random.default_rng(2)
    cells = np.unique(rng.integers(0, 50, (300, 2)), axis=0)
    values = rng.integers(0, 1000, len(cells))
    masks, largest = treap.quadtree(cells[:, 0], cells[:, 1], values)
    found = {(0, 0): 0}
    for level, mask in enumerate(masks):
        first, below = np.cumsum(treap._BITS[mask]) - treap._BITS[mask], {}
        for (r, c), at in found.items():
            child = int(first[at])
            for q in range(4):
                if mask[at] >> q & 1:
                    below[2 * r + (q >> 1), 2 * c + (q & 1)] = child
                    assert largest[level + 1][child] <= largest[level][at]
                    child += 1
        found = below
    assert {k: int(largest[-1][v]) for k, v in found.items()} == {(int(r), int(c)): int(v) for (r, c), v in zip(cells, values, strict=True)}


def shingle_set(text, width=3):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def deduplicated(rows):
    held = defaultdict(list)
    for n, (_, t) in enumerate(rows):
        held[shingle_set(t)].append(n)
    sets = [s for s in held if s]
    parent, seen = list(range(len(sets))), defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, own in enumerate(sets):
        common = Counter(b for s in own for b in seen[s])
        for s in own:
            seen[s].append(a)
        for b, n in common.items():
            if 100 * n >= 85 * (len(own) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    groups = defaultdict(list)
    for a, s in enumerate(sets):
        groups[find(a)] += [rows[n][0] for n in held[s] if rows[n][0] is not None]
    out = []
    for a, s in enumerate(sets):
        least = min(groups[find(a)], default=None)
        out += [(rows[n][0], len(s), least, rows[n][0] == least) for n in held[s]]
    return out + [(rows[n][0], 0, rows[n][0], True) for n in held[frozenset()]]


@pytest.fixture(scope="module")
def copies():
    rng, rows = random.Random(11), []
    for length in (5, 8, 12, 20, 35, 60, 100, 300):
        for size in (1, 2, 3, 9, 25):
            base = [f"W{rng.randrange(3000)}" for _ in range(length)]
            for _ in range(size):
                own = list(base)
                for _ in range(rng.randrange(1 + length // 12)):
                    own[rng.randrange(length)] = f"n{rng.randrange(9999)}"
                rows.append(" ".join(own))
    rows += ["", None, " \t\n", "one", "One", "two words", "TWO\twords", rows[3].upper(), rows[9], rows[9], "a b c d", "A b c d", "É b c", "é b c"]
    rows += [" ".join(f"long{i % 7000}" for i in range(60_000))] * 2
    rows = [(None if n % 31 == 4 else n // 2 if n % 17 == 0 else n, t) for n, t in enumerate(rows)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks", [{}, {"block": 4, "block_chars": 3000}])
def test_near_duplicates_equal_brute_force(spark, copies, blocks):
    table = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in copies], "doc_id bigint, text string, id int, `set` string, n int")
    assert ordered(hyperminhash.near_duplicates(table, **blocks).collect()) == ordered(deduplicated(copies))


def test_no_texts_no_duplicates(spark):
    nothing = spark.createDataFrame([], "doc_id bigint, text string")
    assert hyperminhash.near_duplicates(nothing).isEmpty()
    empty = spark.createDataFrame([(1, None), (1, ""), (None, " ")], "doc_id bigint, text string")
    assert ordered(hyperminhash.near_duplicates(empty).collect()) == ordered([(1, 0, 1, True), (1, 0, 1, True), (None, 0, None, True)])


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    for size, share in ((40, 0.9), (500, 0.85), (5000, 0.5), (5000, 0.0)):
        errors = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, int(2 * size * share / (1 + share)), dtype=np.uint64) * np.uint64(2)
            own = [np.unique(np.concatenate([both, rng.integers(0, 1 << 63, size - len(both), dtype=np.uint64) * np.uint64(2) + np.uint64(1)])) for _ in range(2)]
            one, two = (hyperminhash.registers(s, np.array([0, len(s)]))[0] for s in own)
            used = (one | two) != 0
            chance = hyperminhash.collision(*hyperminhash.size_class(np.array([size, size])).tolist())
            errors.append((((one == two) & used).sum() / used.sum() - chance) / (1 - chance) - len(both) / (2 * size - len(both)))
        assert abs(np.mean(errors)) < 0.025


def test_register_values():
    top = np.uint64(1) << np.uint64(57)
    values = np.array([0, 1, int(top) - 1, int(top) // 2, int(top) // 2 + (int(top) >> 11)], np.uint64)
    made = [int(hyperminhash.registers(np.array([v], np.uint64), np.array([0, 1]))[0, 0]) for v in values]
    assert [m >> 10 for m in made] == [54, 54, 1, 1, 1]
    assert [m & 1023 for m in made[2:]] == [1023, 0, 1]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(400, 400)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    rng.shuffle(edges)
    found = graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert sorted(r.id for r in found) == sorted(parent)
    assert len({(find(r.id), r.root) for r in found}) == len({r.root for r in found}) == len({find(x) for x in parent})
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


def check_whitening(rows, found, components=8):
    width = Counter(len(v) for _, v in rows if v).most_common(1)[0][0]
    kept = [(i, v) for i, v in rows if v and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    deviations = Counter((i, sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))) for (i, _), row in zip(kept, x, strict=True))
    z = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    covariance = z.T @ z / n
    values = np.linalg.eigvalsh(covariance)[::-1][:components]
    assert len(found) == n * len(values)
    for k, value in enumerate(values):
        own = [r for r in found if r.component == k + 1]
        assert Counter((r.vec_id, r.deviation) for r in own) == deviations
        assert {r.n for r in own} == {n}
        assert own[0].explained == pytest.approx(value / np.trace(covariance), abs=1e-12)
        assert all(r.identity_error < 1e-4 for r in own)
    return z, covariance


@pytest.mark.parametrize("blocks", [None, (4, 3)])
def test_whitening_equals_numpy(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(whitening, "BLOCK_ROWS", blocks[0])
        monkeypatch.setattr(whitening, "MOST_BLOCKS", blocks[1])
    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(90, 10)) @ rng.normal(size=(10, 10))).tolist())]
    rows += [(200, None), (201, []), (202, [None] * 10), (203, [math.nan] + [0.0] * 9), (204, [math.inf] * 10), (205, [1.0]), (3, rows[3][1]), (None, rows[4][1])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, index int, y int").repartition(3)
    found = whitening.whiten(table).collect()
    z, covariance = check_whitening(rows, found)
    values, vectors = np.linalg.eigh(covariance)
    ids = [i for i, v in rows if v and len(v) == 10 and all(c is not None and math.isfinite(c) for c in v)]
    for k in range(8):
        want = z @ vectors[:, -1 - k] / math.sqrt(values[-1 - k])
        got = {r.vec_id: r.whitened for r in found if r.component == k + 1}
        sign = np.sign(got[0] * want[0])
        assert max(abs(sign * got[i] - w) for i, w in zip(ids, want, strict=True)) < 1e-9


def test_whitening_without_variance(spark):
    flat = spark.createDataFrame([(i, [float(i % 3), 1.0, 2.0 * (i % 3)]) for i in range(30)], "vec_id bigint, embedding array<double>")
    rows = whitening.whiten(flat).collect()
    assert {r.component for r in rows if r.whitened is not None} == {1}
    assert all(r.explained == pytest.approx(1.0 if r.component == 1 else 0.0, abs=1e-12) for r in rows)
    one = whitening.whiten(flat.limit(1)).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.n, r.deviation) for r in one] == [(None, 0.0, None, 1, 0)] * 3
    assert whitening.whiten(flat.limit(0)).isEmpty()
    assert whitening.whiten(flat.withColumn("embedding", flat.embedding.cast("array<float>"))).count() == 90


def test_large_numbers_stay_exact(spark):
    rows = [(1, [2.0**41, 1.0]), (2, [-(2.0**41), 3.0]), (3, [5.0, 2.0**20]), (4, [1e300, 0.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {(r.vec_id, r.n) for r in found} == {(1, 3), (2, 3), (3, 3)}
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows[:3]], object)
    exact = {i: int(((3 * own - x.sum(axis=0)) ** 2).sum()) for (i, _), own in zip(rows, x, strict=False)}
    assert {(r.vec_id, r.deviation) for r in found} == {(i, d if d < 1 << 63 else None) for i, d in exact.items()}
