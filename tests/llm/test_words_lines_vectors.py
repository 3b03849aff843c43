"""Spelling variants, hard negatives and line dedup against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ondula.llm import linededup, negatives, spelling
from ondula.llm.covertree import augmented, build
from ondula.llm.cuckoo import Cuckoo

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, n long, word string, key long, shard string, _drops string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute_variants(rows, min_length=5, min_count=3):
    counts = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    forms, out = {}, []
    for w, n in counts.items():
        links = [v for v in counts if near(w, v)]
        best = min(links, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= 2 * n else None
        out.append([w, forms[w], None, n, len(links), counts[best] if forms[w] else None])
    for row in out:
        root = row[0]
        while forms[root]:
            root = forms[root]
        row[2] = root
    return sorted(map(tuple, out))


def misspelled(rng, word):
    at = rng.randrange(len(word))
    c = rng.choice("abcdeéÿ")
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + c + word[at:], word[:at] + c + word[at + 1 :]])


@pytest.fixture
def prose():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    base += ["aaaaa", "aaaaaa", "bbbbbbb", "ababab", "straße", "ÉCOLE", "école", "×÷×÷×"]
    rows = []
    for i in range(220):
        words = [rng.choice(base) for _ in range(rng.randint(1, 60))]
        words = [misspelled(rng, w) if rng.random() < 0.2 else w for w in words]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    rows += [(None, "aaaaa ababab"), (None, None), (500, ""), (501, "12 # ."), rows[3], rows[3]]
    return rows


def with_columns(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w", 2, "s", "d") for i, t in rows], DOCS)


def test_variants_equal_brute_force(spark, prose):
    got = sorted(map(tuple, spelling.spelling_variants(with_columns(spark, prose)).collect()))
    want = brute_variants(prose)
    assert got == want
    assert sum(r[1] is not None for r in want) > 20


def test_variants_of_shorter_words_and_chains(spark):
    text = " ".join(["abcd"] * 3 + ["abcde"] * 6 + ["abcdef"] * 12 + ["abcdefg"] * 24 + ["xxxx"] * 3)
    got = spelling.spelling_variants(with_columns(spark, [(1, text)]), min_length=4)
    rows = [(1, text)]
    assert sorted(map(tuple, got.collect())) == brute_variants(rows, 4)
    with pytest.raises(ValueError):
        spelling.spelling_variants(with_columns(spark, rows), min_length=3)


def test_variants_of_a_long_text_and_of_nothing(spark):
    rng = random.Random(1)
    words = [rng.choice(["hello", "hallo", "hullo", "helloo", "world"]) for _ in range(300_000)]
    rows = [(7, " ".join(words)), (8, "hello world " * 50_000)]
    got = sorted(map(tuple, spelling.spelling_variants(with_columns(spark, rows)).collect()))
    assert got == brute_variants(rows)
    assert spelling.spelling_variants(with_columns(spark, [])).count() == 0
    assert spelling.spelling_variants(with_columns(spark, [(1, None)])).count() == 0


def test_pivots_are_the_lightest_disjoint_pair():
    rng = random.Random(2)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 8)))
        grams = [(p, [rng.randint(1, 9), rng.randint(1, 9)]) for p in places]
        pairs = [(x[0] + y[1], (p, r)) for p, x in grams for r, y in grams if r >= p + 2]
        assert tuple(spelling.pivots(grams)) == min(pairs)[1]


# -- lines --------------------------------------------------------------------


def brute_lines(rows, min_docs=3):
    def key(line):
        k = line.strip(SPACE).translate(LOW)
        return k if len(k) >= 20 else None

    held, first = {}, -(1 << 63)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if key(line):
                held.setdefault(key(line), set()).add(first if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = first if i is None else i
        kept = [
            x for x in lines
            if not (key(x) and len(held[key(x)]) >= min_docs and max(held[key(x)]) != own)
        ]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.fixture
def pages():
    rng = random.Random(9)
    common = [f"This line number {i} stands in many documents" for i in range(30)]
    common += ["ü" * 20, "ü" * 19, "x" * 20, " \t" + "Y" * 25 + "\r", "y" * 25, "z" * 19 + "  "]
    rows = []
    for i in range(150):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"own line {rng.random()} of it" for _ in range(rng.randint(1, 12))]
        rows.append((i * 7 % 151, "\n".join(lines) + rng.choice(["", "\n", "\n\n"])))
    rows += [(None, common[0] + "\n" + common[1]), (None, common[2]), (900, None), (901, ""), (902, "\n")]
    return rows + [rows[4], rows[4]]


def cleaned(docs, index=None):
    out = linededup.dedup_lines(docs) if index is None else linededup.clean(docs, index)
    return sorted(map(tuple, out.collect()), key=repr)


def test_lines_equal_brute_force(spark, pages):
    docs = with_columns(spark, pages)
    want = brute_lines(pages)
    assert cleaned(docs) == want and sum(r[2] for r in want) > 100
    digests = linededup.dedup_lines(docs, digest=True).collect()
    assert sorted(r["kept_sha256"] for r in digests) == sorted(
        hashlib.sha256(r[3].encode()).hexdigest() for r in want
    )


def test_line_index_is_reversible(spark, pages):
    one, two = pages[:90], pages[90:150]
    whole = linededup.LineIndex.empty(spark, shards=4).insert(with_columns(spark, one))
    both = whole.insert(with_columns(spark, two))
    assert cleaned(with_columns(spark, one + two), both) == brute_lines(one + two)
    gone = with_columns(spark, two).select("doc_id")
    back = both.delete(gone)
    assert cleaned(with_columns(spark, one), back) == brute_lines(one)
    for table in ("refs", "counts"):
        a, b = getattr(whole, table), getattr(back, table).select(getattr(whole, table).columns)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    sizes = {r["shard"]: r["size"] for r in whole.filters.collect()}
    assert {r["shard"]: r["size"] for r in back.filters.collect() if r["size"]} == {
        k: v for k, v in sizes.items() if v
    }
    assert cleaned(with_columns(spark, one), both.insert(with_columns(spark, two)).delete(gone)) == brute_lines(one)


def test_hot_and_long_lines(spark, monkeypatch):
    monkeypatch.setattr(linededup, "GROUP_ROWS", 50)
    monkeypatch.setattr(linededup, "HEAVY_KEYS", 10)
    rows = [(i, f"a line that every document holds\nand one of {i % 40}, held by some") for i in range(400)]
    rows.append((400, "\n".join(f"line {i} of a very long document" for i in range(120_000))))
    rows.append((401, "w" * 3_000_000))
    rows += [(402, rows[401][1]), (403, rows[401][1] + "\n")]
    assert cleaned(with_columns(spark, rows)) == brute_lines(rows)
    assert cleaned(with_columns(spark, [])) == []


def test_cuckoo_filter():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 63, 30_000, dtype=np.uint64) * np.uint64(2)
    cuckoo = Cuckoo.of_size(20_000)
    cuckoo.insert(keys[:10_000])
    cuckoo.insert(keys[10_000:20_000])
    assert cuckoo.contains(keys[:20_000]).all()
    assert cuckoo.contains(keys[20_000:]).mean() < 0.01
    cuckoo.delete(keys[:10_000])
    again = Cuckoo.of_bytes(*cuckoo.to_bytes())
    assert again.contains(keys[10_000:20_000]).all() and again.contains(keys[:10_000]).mean() < 0.01
    small = Cuckoo.of_size(4)
    small.insert(keys[:200])  # far too many: the stash takes the rest
    assert small.contains(keys[:200]).all() and len(small.stash)
    small.delete(keys[:150])
    assert small.contains(keys[150:200]).all()


# -- vectors ------------------------------------------------------------------


def brute_negatives(rows, every=50):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        row = (label, [math.floor(256.0 * x) for x in v])
        kept[i] = min(kept.get(i, row), row)
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, (label, v) in kept.items():
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, other) for j, (other, w) in kept.items() if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            hits = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k, _) in enumerate(hits)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, v string, cell int, part long"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "v", 1, 2) for r in rows], SCHEMA)


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "GROUP", 7)
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(12, 6))
    rows = []
    for i in range(900):
        v = middles[i % 12] + rng.normal(size=6) * 0.15
        rows.append((i, [float(x) for x in np.float32(v)], int(rng.integers(0, 4))))
    rows += [(900 + i, rows[100][1], i % 5) for i in range(300)]  # a third are copies
    rows += [(1300, [0.0] * 6, 1), (1350, [1.0, 2.0], 2), (1400, [], 3), (1450, [-1.0] * 6, None)]
    rows += [(1500, None, 1), (1550, [float("nan")] * 6, 1), (1600, [float("inf")] + [0.0] * 5, 1)]
    rows += [(1650, [1.0, None, 2.0], 1), (None, [1.0] * 6, 1), rows[50], rows[50], (50, [1.0] * 6, 9)]
    got = negatives.hard_negatives(vectors(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    assert got.count() > 100


def test_negatives_of_large_numbers_and_of_nothing(spark):
    rows = [(i * 25, [float(1 << 17) * (1 + i % 3), float(i)], i % 2) for i in range(40)]
    got = negatives.hard_negatives(vectors(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    assert negatives.hard_negatives(vectors(spark, [])).count() == 0
    assert negatives.hard_negatives(vectors(spark, [(50, None, 1)])).count() == 0


def test_cover_tree_covers():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(30, 3)) * 9, np.repeat(rng.normal(size=(20, 3)), 40, axis=0)])
    x = np.concatenate([x, rng.normal(size=(3000, 3))])
    points = augmented(x, float(np.sqrt(np.square(x).sum(axis=1).max())))
    assert np.allclose(np.square(points).sum(axis=1), np.square(points).sum(axis=1)[0])
    tree = build(points)
    assert sorted(tree.order.tolist()) == list(range(len(x))) and len(tree.centre) > 20
    for i in range(len(tree.centre)):
        rows = tree.order[tree.lo[i] : tree.hi[i]]
        away = np.sqrt(np.square(points[rows] - points[tree.centre[i]]).sum(axis=1))
        assert tree.centre[i] in rows and away.max() <= tree.radius[i] + 1e-9
        for c in range(tree.child[i], tree.child[i] + tree.kids[i]):
            assert tree.lo[i] <= tree.lo[c] and tree.hi[c] <= tree.hi[i]
