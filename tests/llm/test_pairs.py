"""Repeats, similar documents, components and pages against brute force."""

import html as entities
import random
import re
from collections import Counter, defaultdict

import hashlib
import numpy as np
import pyarrow as pa
import pytest

from ondula.llm import common, html, packed, repeats, similar
from ondula.llm import components as graph
from ondula.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n long, _tag string, sig string"


def corpus(seed=3):
    """Texts with shared passages, copies and edits; short, empty and null ones."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    base = [[word() for _ in range(rng.randint(5, 200))] for _ in range(40)]
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(160):
        w = list(rng.choice(base)) if i % 2 else [word() for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        if i % 5 == 0:
            at = rng.randint(0, len(w))
            lo, hi = sorted(rng.sample(range(60), 2))
            w[at:at] = passage[lo:hi]
        texts.append(rng.choice([" ", "\n", " \t"]).join(w))
    texts += [None, "", " ", "a", "A", "a b", "A  b", "the " * 400, "the " * 390, "x y z", "X y\nz"]
    texts += [texts[3]] * 25 + [texts[5].upper()]
    rng.shuffle(texts)
    return texts


@pytest.fixture
def docs(spark):
    rows = [(i * 3 % 199, t, 1, "t", "s") for i, t in enumerate(corpus())]
    rows.sort(key=lambda r: r[0])
    return spark.createDataFrame(rows, SCHEMA)


def brute_repeats(rows):
    first = {}
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(words):
        for s in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][s : s + 13]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - 12):
            if first[tuple(w[s : s + 13])] < i:
                gone.update(range(s, s + 13))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("bound", [300_000, -1])
def test_repeats(spark, docs, bound, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", bound)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = repeats.remove_repeats(docs, digest=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_repeats(
        rows.items()
    )
    for r in got:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_repeats_with_repeated_and_null_ids(spark):
    p = " ".join(f"p{i}" for i in range(30))
    rows = [(5, p), (5, "lead " + p), (5, p), (None, p + " end"), (None, p), (7, "x " + p), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in repeats.remove_repeats(docs).collect())
    assert got == Counter(
        [(5, 30, 30), (5, 30, 30), (5, 31, 30), (None, 31, 0), (None, 30, 0), (7, 31, 30), (1, 0, 0)]
    )
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def brute_similar(rows, k, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k,percent,group", [(3, 90, 16), (5, 80, 16), (2, 60, 2), (1, 80, 3)])
def test_similar(spark, docs, k, percent, group, monkeypatch):
    """A small GROUP makes most tokens frequent and most signatures large."""
    monkeypatch.setattr(similar, "GROUP", group)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute_similar(rows.items(), k, percent)
    got = similar.similar(docs, k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    if k == 5:
        kept = similar.first_of_each(docs, k, percent)
        assert kept.dtypes == docs.dtypes
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in want if want[i][1] == i)


@pytest.mark.parametrize("k,percent,group", [(2, 60, 2), (1, 80, 3)])
def test_similar_in_blocks(spark, docs, k, percent, group, monkeypatch):
    """Members of a signature are compared in pairs of bounded blocks."""
    monkeypatch.setattr(similar, "GROUP", group)
    monkeypatch.setattr(similar, "BLOCK", 4)
    sizes = []
    paired = similar._Join._paired

    def measured(join, apart):
        out = paired(join, apart)
        sizes.extend(r["count"] for r in out.groupBy("pair").count().collect())
        return out

    monkeypatch.setattr(similar._Join, "_paired", measured)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = similar.similar(docs, k, percent).collect()
    want = brute_similar(rows.items(), k, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert 10 < len(sizes) and max(sizes) <= 32


def test_similar_with_repeated_and_null_ids(spark):
    p, q = (" ".join(f"{c}{i}" for i in range(30)) for c in "pq")
    rows = [(5, p), (5, p), (5, q), (None, q), (7, p), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in similar.similar(docs, 3, 90).collect())
    assert got == Counter(
        [(5, 28, 5), (5, 28, 5), (5, 28, None), (None, 28, None), (7, 28, 5), (None, 0, None), (9, 0, 9), (9, 0, 9)]
    )
    kept = similar.first_of_each(docs, 3, 90).collect()
    assert Counter(tuple(r) for r in kept) == Counter([(5, p), (None, q), (None, None), (9, "")])
    assert similar.similar(docs.limit(0), 3, 90).count() == 0


def test_similar_keeps_the_least_long_apart_from_null(spark):
    least = -(1 << 63)
    p, q = (" ".join(f"{c}{i}" for i in range(30)) for c in "pq")
    rows = [(least, p), (3, p), (least + 1, q), (8, q)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in similar.similar(docs, 3, 90).collect())
    assert got == Counter(
        [(least, 28, least), (3, 28, least), (least + 1, 28, least + 1), (8, 28, least + 1)]
    )
    docs = spark.createDataFrame([(least, q), (None, p)], docs.schema)
    got = Counter(tuple(r) for r in similar.similar(docs, 3, 90).collect())
    assert got == Counter([(least, 28, least), (None, 28, None)])


def test_similar_tells_long_words_apart():
    """Thue-Morse words of 1024 letters, which a polynomial can't tell apart."""
    other = str.maketrans("ab", "ba")
    word = "a"
    for _ in range(10):
        word += word.translate(other)
    turned = word.translate(other)
    texts = pa.array([f"{word} x y", f"{turned} x y", f"{word} x y {turned} x y", f"{word.upper()} x y"])
    sets = similar.Sets(pa.RecordBatch.from_arrays([texts], ["text"]), 3)
    assert sets.sizes.tolist() == [1, 1, 4, 1]
    assert len(set(sets.ids.tolist())) == 3 and sets.ids[0] == sets.ids[3]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (5, 55)])
def test_prefix_pairs_survive_losses(k, percent):
    """Dropping any need - 1 tokens of a prefix leaves one of its pairs."""
    rng = random.Random(k)
    for n in (41, 60, 200):
        tokens = np.array(sorted(rng.sample(range(1 << 40), n)), dtype=np.uint64)
        need = int(similar._misses(np.array([n]), percent)[0]) + 1
        whole = set(similar._prefix_pairs(tokens, need))
        for _ in range(30):
            left = np.delete(tokens, rng.sample(range(n), need - 1))
            assert whole & set(similar._prefix_pairs(left, need + 10**6))


def test_few_links_take_no_rounds(spark, monkeypatch):
    """Every round over so few links costs a dozen stages."""
    links = [(i, i + 1) for i in range(900)] + [(2000, 1500), (1500, 2000), (3, 3)]
    frame = spark.createDataFrame(links, "a long, b long")
    want = {i: 0 for i in range(901)} | {1500: 1500, 2000: 1500}
    written = []

    def stored(df, name):
        written.append(name)
        return common.stored(df, name)

    monkeypatch.setattr(graph, "stored", stored)
    found = components(frame).collect()
    assert {r["node"]: r["root"] for r in found} == want and len(found) == len(want)
    assert len(written) <= 2
    # more links than a task connects at a time: rounds between the tasks
    monkeypatch.setattr(graph, "LOCAL_EDGES", 100)
    found = components(frame.repartition(12)).collect()
    assert {r["node"]: r["root"] for r in found} == want and len(found) == len(want)
    assert len(written) > 4


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)]
    links += [(rng.randint(300, 500), rng.randint(300, 500)) for _ in range(150)] + [(7, 7), (3, 2)]
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b), near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    frame = spark.createDataFrame(links, "a long, b long")
    assert {r["node"]: r["root"] for r in components(frame).collect()} == want
    assert components(frame.limit(0)).count() == 0


def test_squeeze():
    for kind in ("<u4", "<i8"):
        for values in ([], [5], [9, 3, 3, 2**31 - 1, 0]):
            a = np.array(values, dtype=kind)
            assert packed.unsqueeze(packed.squeeze(a), kind).tolist() == values


PAGE = (
    "<html><head><title>t</title><style>p{{}}</style></head><body class='home has-sidebar'>"
    "<div id=top-menu><a href=/>Home</a></div><div class='cookie-notice'>We use cookies</div>"
    "<div class='wrap post-{n}'><div class='content c{n}'><h1>Head &amp; {n}</h1>{body}"
    "<div class=share>Share</div></div><div class='comments'><p>{noise}</p></div></div>"
    "<aside>{noise}</aside><footer>&copy; {n}</footer><script>var a = '<p>no</p>';</script></body></html>"
)
LONG = "A sentence that is long enough to count as text, and then some more of it. "


def test_pages(spark):
    rows = []
    for n in range(20):
        body = f"<p>{LONG * 4}<b>bo</b>ld&#33;<br>line\n two<p>Last &lt;p&gt; of {n}"
        rows.append((n, f"http://a.example/{n}", PAGE.format(n=n, body=body, noise="x " * 20)))
    short = PAGE.format(n=99, body="<p>Short.</p>", noise=LONG * 9)
    rows += [(20, "http://a.example/s", short), (21, None, None), (22, "nowhere", ""), (23, "http://b.example", "plain <b>te</b>xt")]
    rows += [rows[0], (None, "http://c.example/x", "<article><p>One</p><p>Two <!-- c --> three</article> tail")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, paths string")
    got = html.main_text(pages).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    for n in range(20):
        head = entities.unescape(f"Head & {n} {(LONG * 4)}bold! line two Last <p> of {n}")
        assert text[n] == head
    assert text[20] == "Head & 99 Short."
    assert (text[21], text[22], text[23], text[None]) == ("", "", "plain text", "One Two three")
    assert html.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "source,blocks",
    [
        ("<p>a<p>b", ["a", "b"]),
        ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("a<script>if (1<2) '</p>'</script>b", ["ab"]),
        ("<div title='x>y'>a</div>", ["a"]),
        ("<DIV>a<BR/>b</DIV>", ["a", "b"]),
        ("a < b <i>c</i>", ["a < b c"]),
        ("<p hidden>x</p><p style='display: none'>y</p>z", ["z"]),
        ("<!-- <p>x --><![CDATA[x]]>a<!doctype x>", ["a"]),
        ("</p></div>a&nbsp;&eacute;", ["a é"]),
        ("<b>" * 3000 + "deep", ["deep"]),
        ("<a href='x" * 500, []),
    ],
)
def test_parse(source, blocks):
    got = html.parse(source).blocks
    assert got == blocks or not blocks


def page_text(source, winners=()):
    return html.parse(source).extract(list(winners))


def test_pages_keep_text_outside_a_container(spark):
    intro, body = "An introduction. " * 5, LONG * 5
    whole = f"Title {intro}{body}".strip()
    post = f"<div class=post><h1><a href=/t>Title</a></h1><div class=intro>{intro}</div><div class=body>{body}</div></div>"
    menu = "<div class=top><a href=/a>First link</a> <a href=/b>Second link</a></div>"
    assert page_text(f"<body>{menu}{post}</body>") == whole
    assert page_text(f"<h1>Title</h1>{intro}<div>{body}</div>") == whole
    # an article that is a teaser doesn't replace the story
    card, story = LONG * 3, LONG * 6
    both = page_text(f"<body><article>{card}</article><div class=story>{story}</div></body>")
    assert both == f"{card}{story}".strip()
    # most pages of the host are one <pre>; one has 15% there
    code = "let x = 1; " * 20
    rows = [(n, f"http://code.example/{n}", f"<body><div><pre>{code}</pre></div></body>") for n in range(9)]
    rows.append((9, "http://code.example/9", f"<body><div><pre>let y = 2;</pre><p>{LONG * 2}</div></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
    assert got[0] == code.strip() and got[9] == f"let y = 2; {LONG * 2}".strip()
    path = "body>div>pre"
    assert page_text(rows[9][2], [path]) == got[9]


@pytest.mark.parametrize(
    "name",
    "has-sidebar with-sidebar no-sidebar content-sidebar no-comments has-ads nav-open search-results".split(),
)
def test_named_wrappers(name):
    menu, notes = "<div class=main-menu>Menu text</div>", "<div class=comments><p>Noise.</div>"
    story = f"<h1>Title</h1><p>{LONG}</p>"
    whole = f"Title {LONG}".strip()
    for inner in (f"<article>{story}</article>", f"<main>{story}</main>", f"<div>{story}</div>"):
        for kind in ("class", "id"):
            assert page_text(f"<body><div {kind}='site {name}'>{menu}{inner}{notes}</div></body>") == whole
    # short texts in an article or main count as well; other articles don't
    assert page_text(f"<body><div class='{name}'><main>Short.</main></div><p>{LONG}</body>") == f"Short. {LONG}".strip()
    card = "<div class=related><article>A card</article></div>"
    assert page_text(f"<body><article>{story}{card}</article>{card}</body>") == whole


@pytest.mark.parametrize(
    "source,text",
    [
        ("a <svg class=i viewBox='0 0 1 1'/> b <svg><text>x</text></svg> c", "a b c"),
        ("a <math/> b", "a b"),
        ("a <svg><path d=''> b", "a b"),
        ("a <svg><path d=''><p>b</p><svg><g/></svg> c", "a b c"),
        ("a <svg><foreignObject><p>x</p></foreignObject></svg> b", "a b"),
        ("for <math><mi>x</mi><mo>=</mo><mspace/><mn>1</mn></math> b", "for x=1 b"),
        ("<math><semantics><mi>x</mi><annotation>\\x</annotation></semantics></math> b", "x b"),
        ("a <input list=l><datalist id=l><option value=a><option value=b>x</datalist> b", "a b"),
        ("a <select><optgroup><option>x<hr><option>y</select> b", "a b"),
        ("a <select><option>x<p>b</p>c", "a b c"),
        ("a <option>x<p>b</p>c", "a b c"),
        ("a <select><option>x</option><div>b</div><select><option>y</select> c", "a b c"),
        ("<head><title>x</head><p>a</p><iframe src=x><p>b</p><noscript><p>c", "a b c"),
        ("a<script>x</script foo>b", "ab"),
        ("a<textarea>x <p>y", "a"),
    ],
)
def test_elements_without_end_tags(source, text):
    assert page_text(source) == text
    assert page_text(f"<body><article><p>{source}</p></article></body>") == text


def test_small_slices_are_packed_together():
    pieces = [(np.array([0, 1, 1]), [np.array([i, 5, 6], dtype=np.uint64)]) for i in range(6)]
    batches = list(packed.pack_together(iter(pieces), 6))
    assert [b.num_rows for b in batches] == [2, 2, 2]  # a row for each bucket of two pieces
    cells = [np.frombuffer(b.column(1)[0].as_py(), "<u8").tolist() for b in batches]
    assert cells == [[0, 1], [2, 3], [4, 5]]


def test_a_task_gives_memory_back():
    given = []

    def run(batches):
        for batch in batches:
            held = pa.allocate_buffer(32 << 20)
            given.append(held.size)
            yield batch

    task = common.released(run)
    batch = pa.record_batch({"a": [1, 2]})
    assert list(task(iter([batch, batch]))) == [batch, batch] and len(given) == 2
    assert pa.total_allocated_bytes() < 32 << 20
