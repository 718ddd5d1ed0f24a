"""PPM against a dictionary model, wrapper induction, and the pipeline."""

import math
import os
import random
import shutil
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import decontaminate, ppm, simhash, wrapper

TRAIN = ["abracadabra", "Abab", "cab rab\tcab", "", None, "über über"]


def grams(texts):
    counts = [Counter() for _ in range(ppm.ORDER + 1)]
    for text in texts:
        data = bytes(ppm.ORDER) + ppm.plain(text) + b"\0"
        for at in range(ppm.ORDER, len(data)):
            for k in range(ppm.ORDER + 1):
                counts[k][data[at - k : at + 1]] += 1
    return counts


def ppm_by_hand(counts, context, byte):
    """log10 probability by the definition, with sets of excluded bytes."""
    follow = defaultdict(dict)
    for k in range(ppm.ORDER + 1):
        for g, n in counts[k].items():
            follow[g[:-1]][g[-1:]] = n
    excluded, p = set(), 1.0
    for k in range(ppm.ORDER, -1, -1):
        own = follow.get(context[len(context) - k :], {})
        if not own:
            continue
        rest = {b: n for b, n in own.items() if b not in excluded}
        pruned = max(0, counts[k - 1][context[len(context) - k :]] - sum(own.values())) if k else 0
        escapes = len(rest) + pruned
        if not k:
            escapes = 0 if len(own) == 256 else max(escapes, 1)
        total = sum(rest.values()) + escapes
        if byte in rest:
            return math.log10(p * rest[byte] / total)
        if total:
            p *= escapes / total
        excluded |= set(own)
    return math.log10(p / (256 - len(excluded)))


@pytest.mark.parametrize("least", [1, 2])
def test_trie_follows_the_definition_and_adds_up_to_one(least):
    counts = grams(TRAIN)
    counts = [c if k < 2 else Counter({g: n for g, n in c.items() if n >= least}) for k, c in enumerate(counts)]
    tables = []
    for c in counts:
        rows = sorted((int.from_bytes(g, "big"), n) for g, n in c.items())
        tables.append((np.array([g for g, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64)))
    trie = ppm.Trie(tables)
    for context in (bytes(4), b"abra", b"zzab", b"zzzz", b"cada", b"xrab", b"\0\0\0a"):
        codes = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        scores = trie.scores(codes)
        assert abs((10**scores).sum() - 1) < 1e-9
        for b in (0, 9, 32, 97, 98, 100, 114, 122, 195, 255):
            assert abs(scores[b] - ppm_by_hand(counts, context, bytes([b]))) < 1e-9


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 0) for i, t in rows], "doc_id long, text string, n int, word string, score int")


def test_scores_of_documents(spark, monkeypatch):
    monkeypatch.setattr(ppm, "STRETCH", 7)  # texts in stretches
    monkeypatch.setattr(ppm, "COMMON", 4)  # most words through the join
    rows = list(enumerate(TRAIN)) + [(50, "abra cab zebra"), (51, None), (51, None), (None, "cab"), (52, "x" * 3000)]
    trains = F.col("doc_id") < 50
    got = ppm.score(docs_of(spark, rows), trains).collect()
    words = Counter(w for t in TRAIN for w in [*ppm.plain(t).split(), "end"])
    total, below = words.total(), words.total() + 0.1 * (len(words) + 1)
    counts, want = grams(TRAIN), []
    for i, t in rows:
        own = [*ppm.plain(t).split(), "end"]
        data = bytes(4) + ppm.plain(t) + b"\0"
        model = sum(ppm_by_hand(counts, data[k - 4 : k], data[k : k + 1]) for k in range(4, len(data)))
        base = sum(math.log10((words[w] + 0.1) / below) for w in own)
        want.append((str(i), len(own), sum(w in words for w in own), total, round(base, 6), round(model, 6)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)
    blank = ppm.score(docs_of(spark, rows), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and abs(r.base_score) < 1e-9 for r in blank)
    assert {round(r.score, 6) for r in blank if r.doc_id == 51} == {round(-math.log10(256), 6)}
    assert ppm.score(docs_of(spark, []), trains).collect() == []


@pytest.mark.parametrize("rarest", [1, 8, 1 << 22])
def test_no_count_is_left_out_of_the_scores(spark, monkeypatch, rarest):
    monkeypatch.setattr(ppm, "RAREST", rarest)  # before, it cut the trie
    monkeypatch.setattr(ppm, "PART", 16, raising=False)
    texts = [*TRAIN, "a\0b", "ra", "the cab that ran", "abracadabra abracadabra"]
    rows = list(enumerate(texts)) + [(50, "abra cab zebra than"), (51, "\0a\0c"), (52, "über zabra" * 40), (53, None)]
    counts = grams(texts)
    for r in ppm.score(docs_of(spark, rows), F.col("doc_id") < 50).collect():
        data = bytes(4) + ppm.plain(dict(rows)[r.doc_id]) + b"\0"
        assert abs(r.score - sum(ppm_by_hand(counts, data[k - 4 : k], data[k : k + 1]) for k in range(4, len(data)))) < 1e-6, r


PAGE = """<html><head><title>T{0}</title><style>p{{}}</style></head><body><div class="top">Our site</div><ul class=menu><li><a href=/>Home</a></ul>
<div id="wrap"><div class="teaser">Always the same line</div><div class="text"><h1>Head {0}</h1><p>First&nbsp;<b>bold</b> of {0} &amp; more<br>here
<p>Second <i>{1}<div>third {1}</div></div><div class="ad-box ads">Buy {0}</div><div id=comments><p>Comment {1}</div></div>
<form>name {0}</form><script>var x="<p>no</p>{0}";</script><footer>Foot {0}</footer></body>"""


def test_template_and_slots_without_an_article():
    rare = "a much longer sentence that fills the slot number"
    pages = [PAGE.format(f"{rare} {i}", f"{rare} {i * 7}") for i in range(5)]
    constants, region = wrapper.induce(pages)
    text = wrapper.extract(pages[2], frozenset(constants), (region,))
    assert text.split("\n") == [f"Head {rare} 2", f"First bold of {rare} 2 & more here", f"Second {rare} 14", f"third {rare} 14"]


def test_broken_and_odd_pages():
    empty = frozenset()
    assert wrapper.extract("just text &lt;x&gt; &#233;", empty) == "just text <x> é"
    assert wrapper.extract("<p>one<p>two</div></p>three<!-- open <p>x", empty) == "one\ntwo\nthree"
    assert wrapper.extract("<article><p>a < b</p><nav>no</nav><p class='x>y'>c</article><p>after", empty) == "a < b\nc"
    assert wrapper.extract("<div>" * 30_000 + "deep", empty) == "deep"
    assert wrapper.extract("<article><header><h1>Title</h1></header><p>x <a href='/'>y</a>, z</p></article>", empty) == "Title\nx y, z"
    assert wrapper.extract("<p>cut &am", empty) == "cut &am" and wrapper.extract("<p", empty) == ""
    assert wrapper.extract("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", empty) == "a\nb\nc\nd"


def test_pages_table(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(f"long enough {i} text", f"other {i} words"), "t", 1) for i in range(12)]
    rows += [(20, None, "<p>x</p>", "t", 1), (21, "http://b.example", None, "t", 1), (22, "x", "", "t", 1), (3, *rows[3][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, region int")
    got = wrapper.main_text(pages).collect()
    assert len(got) == len(rows) and {r.text for r in got if r.page_id in (21, 22)} == {""}
    assert all(r.text.startswith(f"Head long enough {r.page_id} text\nFirst bold") for r in got if r.page_id < 12)
    assert wrapper.main_text(pages.limit(0)).collect() == []


def test_pipeline_keeps_what_it_should(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == docs.columns and 0 < after.count() <= before.count(), name
        if name == "simhash_dedup":
            groups = simhash.groups(before).where("doc_id = component_id").select("doc_id")
            assert sorted(r.doc_id for r in groups.collect()) == sorted(r.doc_id for r in after.collect())
        if name == "decontaminate":
            bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            bad = {r.doc_id for r in decontaminate.matches(before, bench).collect()}
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
        before = after
    last = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in before.collect()) and all(r.exact for r in last)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == []


def test_the_rest_stands_without_this_part(tmp_path):
    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(os.path.join(top, "tracewright"), tmp_path / "tracewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(top, "__spark_entry__.py"), tmp_path)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"],
        cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120, check=True,
    )
    assert said.stdout.split()[-1] == "False" and zlib.crc32(b"0") >= 0


def test_every_page_of_a_host_votes(spark, monkeypatch):
    row = "<html><body><div class={0}><b>Template {0}</b></div><div class=text><p>{1}</p>{2}</div></body></html>"

    def long(i):
        return f"words that are only on page {i} and nowhere else, {i * 31} of them"

    two = [(i, f"http://two.example/{i}", row.format("ab"[i % 2], long(i), "")) for i in range(40)]
    copies = [(100 + i, "http://two.example/copy", row.format("a", long(7), "")) for i in range(30)]
    deep = "<div>" * 200 + "x" * 5
    over = [(200 + i, f"http://over.example/{i}", row.format("a", long(i), deep)) for i in range(4)]
    pages = spark.createDataFrame(two + copies + over, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.main_text(pages).collect()}
    assert all(got[i] == long(i) for i in range(40)) and all(got[100 + i] == long(7) for i in range(30))
    assert all("Template" not in got[200 + i] and long(i) in got[200 + i] for i in range(4))


NEUTRAL = """<html><body><div class=qa><a href=/>Start</a><a href=/x>{0} of the day</a></div><div class=qb><div class=qc><h2>Title {0}</h2>
<div>{1}</div><div>{1} once more</div></div><div class=qd>Note {0}</div><div class=qe>By the same hand</div></div></body></html>"""


def prose(i):
    return " ".join(f"sentence {i} word {i * k % 97}" for k in range(12))


def test_templates_decide_without_words_and_tags(spark, monkeypatch):
    """No tag and no class name tells anything; only what varies between pages, and where most of it stands."""
    rows = [(i, f"http://n.example/{i}", NEUTRAL.format(f"item {i}", prose(i))) for i in range(9)]
    # a second layout, beyond the references of the first one
    other = "<html><body><section class=z>Same head</section><section class=y><div>{0}</div><div>Same foot</div></section></body></html>"
    rows += [(50 + i, f"http://n.example/o{i}", other.format(prose(50 + i))) for i in range(7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Title item {i}\n{prose(i)}\n{prose(i)} once more" for i in range(9)} | {50 + i: prose(50 + i) for i in range(7)}
    assert {r.page_id: r.text for r in wrapper.main_text(pages).collect()} == want
    alone = {i: wrapper.extract(html, frozenset()) for i, _, html in rows}
    assert all(alone[i] != want[i] for i in want)
    monkeypatch.setattr(wrapper, "MARKS", frozenset())
    monkeypatch.setattr(wrapper, "MOST_SHARED", 0)  # references through a shuffle
    assert {r.page_id: r.text for r in wrapper.main_text(pages).collect()} == want


def tree(html):
    return wrapper.parse(html, words=False)[0][0]


def test_long_sibling_lists(monkeypatch):
    import time

    rng = random.Random(8)
    for _ in range(60):  # the cut lists match as many nodes where texts tell them apart, and no pair crosses
        words = [f"<p>t{i}</p>" for i in rng.sample(range(99), 25)]
        other = [w for w in words if rng.random() < 0.8]
        for k in range(5):
            other.insert(rng.randrange(len(other) + 1), f"<h2>n{k}</h2>")
        a, b = tree("<div>" + "".join(words) + "</div>"), tree("<div>" + "".join(other) + "</div>")
        full = wrapper.alignment(a, b)
        with monkeypatch.context() as patched:
            patched.setattr(wrapper, "CELLS", 10)
            cut = wrapper.alignment(a, b)
        assert len(cut) == len(full)
        equal = [(x, y) for x, y in cut if x.runs and x.text() == y.text()]
        assert len(equal) == sum(w in other for w in words)
        places = sorted((a.children[0].children.index(x), b.children[0].children.index(y)) for x, y in cut if x.tag in ("p", "h2"))
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(places, places[1:], strict=False))
    a, b = (tree("<div>" + "".join(f"<p>{'same' if i % 3 else f'own {k} {i}'}</p>" for i in range(20_000)) + "</div>") for k in (1, 7))
    start = time.time()
    assert len(wrapper.alignment(a, b)) > 19_000
    assert time.time() - start < 20


def test_alignment_does_not_depend_on_the_size_of_its_table(monkeypatch):
    rng = random.Random(3)

    def page():
        inner = ["<p>x</p>", "<p>y</p>", "<h2>z</h2>", "<ul><li>a</li><li>b</li></ul>", "<ul><li>a</li></ul>", "<ul><li>c</li><p>d</p></ul>"]
        return tree("<div>" + "".join(rng.choices(inner, k=rng.randint(0, 30))) + "</div>")

    for _ in range(80):
        a, b = page(), page()
        want = [(id(x), id(y)) for x, y in wrapper.alignment(a, b)]
        with monkeypatch.context() as patched:
            patched.setattr(wrapper, "CELLS", rng.choice([0, 3, 40]))
            patched.setattr(wrapper, "SEEN", rng.choice([1, 64]), raising=False)
            assert [(id(x), id(y)) for x, y in wrapper.alignment(a, b)] == want


def test_what_two_shapes_match_is_worked_out_once(monkeypatch):
    """Equal siblings around what differs take no table, and later pages none for shapes that were met; the pairs stay the same."""
    rows = []
    real = wrapper.next_row
    monkeypatch.setattr(wrapper, "next_row", lambda *a: rows.append(1) or real(*a))
    same = "".join(f"<p>t{i}</p>" for i in range(200))
    a, b = tree(f"<div>{same}<h2>x</h2>{same}</div>"), tree(f"<div>{same}<p>y</p><h2>z</h2>{same}</div>")
    assert len(wrapper.alignment(a, b)) == 403 and len(rows) < 10

    rng = random.Random(4)
    inner = ["<p>x</p>", "<p>y</p>", "<h2>z</h2>", "<ul><li>a</li><li>b</li></ul>", "<ul><li>a</li></ul>", "<ul><li>c</li><p>d</p></ul>"]
    pages = [tree("<div>" + "".join(rng.choices(inner, k=rng.randint(0, 30))) + "</div>") for _ in range(40)]
    for most in (0, 20_000):  # with what pages add dropped at once, and kept
        monkeypatch.setattr(wrapper, "MOST_SHAPES", most)
        shapes = wrapper.Shapes(pages[:2])
        for page in pages[2:]:
            for other in pages[:2]:
                want = [(id(x), id(y)) for x, y in wrapper.alignment(page, other)]
                shapes.clear()
                shapes.number(page)
                assert [(id(x), id(y)) for x, y in wrapper.alignment(page, other, shapes)] == want
