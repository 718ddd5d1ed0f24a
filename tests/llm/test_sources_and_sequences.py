"""Divergence of sources, best-fit packing, fill-in-middle: against plain models, with edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewright.llm import bestfit, divergence, infill
from tracewright.llm.queries import BYTE_PIECES

NASTY = [
    None, "", " ", "\n\n", "a", "Ab cd", "naïve café über", "日本語 テキスト。", "😀😀 a😀b", "don't WON'T it's", "tab\tand\r\nline  two   three",
    "nbsp  x   y", "sep\x1c!\x1c\x1d z", "x  y　z", "aж bя Zß", "é combining áb", "<|endoftext|> in text", "a×b÷c",
    "<P> marked", "almost <P <S M> <M", "<", "S>", "12345 67.8e9", "==!! ??", "a" * 300 + " " + "é" * 300, "x y " * 400, "tail  ", "\ta",
]


def docs(spark, texts, more="extra string"):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {more}").repartition(3)


# --- divergence ---


def plain_audit(rows, least, top):
    find = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, held, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        terms = find.findall((r.text or "").translate(fold))
        sources[lang].add(source)
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang, names in sources.items():
        kept = {t for t, n in held[lang].items() if n >= least}

        def share(count, total, size=len(kept)):
            return 1 + 10**9 * (count + 5) // (total + 5 * size)

        whole = Counter()
        for s in names:
            whole.update({t: n for t, n in counts[lang, s].items() if t in kept})
        own = {s: {t: counts[lang, s][t] for t in kept} for s in names}
        p = {s: {t: share(n, sum(own[s].values())) for t, n in own[s].items()} for s in names}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s in names:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in names if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def audited(df, **kw):
    return sorted(tuple(r) for r in divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("least", [1, 3])
def test_audit_against_a_plain_one(spark, least):
    rng = random.Random(5)
    words = [w for t in NASTY if t for w in t.split()] + ["w" * n for n in (7, 8, 9, 15, 16, 17, 40)] + ["Ω" * n for n in (3, 4, 5, 8, 9)]
    texts = NASTY + [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(200)]
    df = docs(spark, texts + texts[:40], "term string")
    assert audited(df, least_docs=least, top=7) == plain_audit(df.collect(), least, 7)


def test_portions_do_not_show(spark):
    df = docs(spark, [" ".join(f"w{i}x{'y' * (i % 30)}" for i in range(n)) for n in (0, 1, 50, 400)] + ["z" * 3000, None])
    want = divergence.partial_counts(df).groupBy("lang", "source", "term").sum("count", "docs").collect()
    for portion in (1, 16, 700):
        got = divergence.partial_counts(df, portion).groupBy("lang", "source", "term").sum("count", "docs").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_portion_is_counted_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    data = rng.integers(0x61, 0x7B, divergence.PORTION, dtype=np.uint8)
    data[::5] = 0x20
    bounds, group = np.array([0, len(data) // 2, len(data)]), np.zeros(2, np.int64)
    tracemalloc.start()
    try:
        rows = sum(int(counts.sum()) for _, _, counts, _ in divergence.count_terms(data, bounds, group))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > len(data) // 6
    assert peak < 150_000_000, peak


def test_nothing_kept_and_nothing_there(spark):
    df = docs(spark, ["a b", "", None, "c", "d", "e"])
    got = audited(df, least_docs=99)
    assert got == plain_audit(df.collect(), 99, 50) and {r[4] for r in got} == {0}
    assert audited(df.limit(0)) == []


def test_radix_order():
    rng = np.random.default_rng(1)
    high, low = rng.integers(0, 3, 5000).astype(np.uint64) << np.uint64(60), rng.integers(0, 2**63, 5000).astype(np.uint64) % np.uint64(50)
    assert (divergence.radix_order([low, high]) == np.lexsort([low, high])).all()


# --- best fit ---


def whole_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_PIECES)
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_parts_give_the_ids_of_whole_texts(spark):
    rng = random.Random(2)
    alphabet = list("ab Zé.,'s0\n\t \x1c　ж́×日😀-") + [" the", "\n\n", "  ", "'ll", "ing "]
    texts = NASTY + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(3000)]
    encoder = bestfit.Encoder(BYTE_PIECES)
    assert [np.frombuffer(encoder.encode(t or ""), "<u4").tolist() for t in texts] == whole_ids(texts)


def test_memory_of_parts_is_bounded(monkeypatch):
    monkeypatch.setattr(bestfit, "REMEMBERED", 10)
    texts = ["".join(f" w{chr(97 + (i * k) % 26)}" for k in range(30)) for i in range(40)]
    encoder = bestfit.Encoder(BYTE_PIECES)
    assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == whole_ids(texts)


def plain_best_fit(sizes, limit, most):
    """(bin, offset) by a list of all open bins."""
    free, found, count = {}, [], 0
    for size in sizes:
        fits = sorted((f, -b) for b, f in free.items() if f >= size)
        if fits:
            at = min(b for b, f in free.items() if f == fits[0][0])
        else:
            if len(free) >= most and size < limit:
                del free[min(free, key=lambda b: (free[b], b))]
            at, count = count, count + 1
            free[at] = limit
        found.append((limit - free[at], free[at] - size))
        free[at] -= size
        if not free[at]:
            del free[at]
    return count, found


def test_bins_against_a_plain_list():
    rng = random.Random(3)
    for most in (1, 3, 1000):
        sizes = [rng.randint(1, 64) for _ in range(2000)]
        bins = bestfit.Bins(64, most)
        places = [bins.place(s) for s in sizes]
        count, found = plain_best_fit(sizes, 64, most)
        assert bins.count == count and [p[1] for p in places] == [f[0] for f in found]
        assert bins.open <= most
        loads = Counter()
        for (at, offset), size in zip(places, sizes, strict=True):
            assert loads[at] == offset
            loads[at] += size
        assert max(loads.values()) <= 64


@pytest.mark.parametrize("limit", [16, 2048])
def test_pieces_and_sequences(spark, limit, monkeypatch):
    monkeypatch.setattr(bestfit, "PACK_ROWS", 40)
    texts = NASTY * 3 + ["word " * n for n in (14, 15, 16, 17, 31, 32, 4095, 9000)]
    df = docs(spark, texts, "row string").unionByName(docs(spark, [None, "same", "same"], "row string").selectExpr("cast(null as long) doc_id", "text", "lang", "source", "row"))
    rows = bestfit.tokens(df, BYTE_PIECES, limit=limit)
    placed = bestfit.pack(rows, limit, most=5, window=7)
    got = bestfit.pieces(placed, limit).collect()
    want = {i: [*ids, 0] for i, ids in enumerate(whole_ids(texts))}
    of_row = defaultdict(list)
    for r in got:
        of_row[r.row].append(r)
    assert len(of_row) == len(texts) + 3 and sum(r[0].doc_id is None for r in of_row.values()) == 3
    for parts in of_row.values():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        if parts[0].doc_id is None:
            continue
        ids = want[parts[0].doc_id]
        assert sum(r.length for r in parts) == len(ids) and all(r.length == limit for r in parts[1:]) and 0 < parts[0].length <= limit
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= limit
    packed = {r.sequence_id: r.ids for r in bestfit.sequences(rows, placed, limit).collect()}
    assert {k: len(v) for k, v in packed.items()} == {k: sum(n for _, n in v) for k, v in places.items()}
    sample = next(r for r in got if r.doc_id is not None and r.offset > 0)
    assert packed[sample.sequence_id][sample.offset : sample.offset + sample.length] == want[sample.doc_id][sample.start : sample.start + sample.length]


def test_few_sequences(spark):
    rng = random.Random(4)
    df = docs(spark, ["word " * rng.randint(1, 3000) for _ in range(1500)])
    got = bestfit.pieces(bestfit.pack(bestfit.tokens(df, BYTE_PIECES))).agg({"length": "sum", "sequence_id": "max"})
    tokens = got.first()["sum(length)"]
    used = bestfit.pieces(bestfit.pack(bestfit.tokens(df, BYTE_PIECES))).select("sequence_id").distinct().count()
    assert used <= 1.03 * tokens / 2048


def test_no_documents_no_sequences(spark):
    rows = bestfit.tokens(docs(spark, ["a"]).limit(0), BYTE_PIECES)
    assert bestfit.pieces(bestfit.pack(rows)).count() == 0


# --- fill in the middle ---


def plain_infill(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h[3] % 100 < 20:
        return len(text), "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(text), "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infill_against_slices(spark):
    rng = random.Random(6)
    texts = NASTY * 4 + ["".join(rng.choices("ab\n<>PSM$\\1😀é\r ", k=rng.randint(0, 2500))) for _ in range(200)] + ["é😀x" * 100_000]
    df = docs(spark, texts, "digest string")
    df = df.unionByName(df.limit(3)).unionByName(df.limit(9).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "digest"))
    cut = infill.transform(df)
    got = cut.select("*", infill.restore(cut["output"], cut["form"]).alias("restored")).collect()
    assert len(got) == len(texts) + 12
    for r in got:
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == plain_infill(r.doc_id, r.text)
        assert r.restored == r.text
    assert infill.transform(df.limit(0)).count() == 0


def test_infill_by_words(spark):
    """Other units: words with what follows them. A text that begins with a blank is no sequence of these."""
    texts = ["one two  three\nfour " * k for k in range(1, 60)] + [" in front"] * 8 + ["w " * 30_000]
    cut = infill.transform(docs(spark, texts), unit=r"\S++\s*+", plain=0)
    for r in cut.select("*", infill.restore(cut["output"], cut["form"]).alias("restored")).collect():
        assert r.restored == r.text and r.n == len(r.text.split())
        if r.form == "plain":
            assert r.text[0] == " " and r.prefix_units is None and r.output == r.text
        else:
            pieces = re.split("<[PSM]>", r.output)[1:]
            order = ("prefix", "suffix", "middle") if r.form == "psm" else ("suffix", "prefix", "middle")
            found = dict(zip(order, pieces, strict=True))
            assert len(found["prefix"].split()) == r.prefix_units and len(found["middle"].split()) == r.middle_units
