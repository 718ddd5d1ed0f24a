"""Secrets, toxicity, languages and pieces on awkward rows, against plain models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracewright.llm import language, pieces, secrets, toxicity
from tracewright.llm.queries import PIECES

DOCS = "doc_id long, text string, lang string, findings int, blob string, score string, __text int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "b", "s", 2) for i, t, lang in rows], DOCS)


LONG = "word " * 60_000
SECRET = 'x Password: "hunter2abc" é token=short token : abcdef AKIA' + "Q" * 16 + " " + "0a" * 15 + " api_key=token=abcdefgh"


def plain(text):
    rules = (
        ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    )
    found = []
    for k, (kind, pattern, group, least) in enumerate(rules):
        found += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def test_secrets_match_a_plain_scan(spark):
    rng = random.Random(5)
    bits = ["password", "token", "API_KEY", "secret", "=", ": ", '"', "abc", "abcdef12", "AKIA" + "Z" * 17, "f0" * 13, "é", "\n", "tokeN ="]
    rows = [(i, "".join(rng.choice(bits) for _ in range(12)), "en") for i in range(300)]
    rows += [(300, None, None), (301, "", "en"), (None, SECRET, "en"), (302, SECRET, "en"), (302, SECRET, "en"), (303, LONG + SECRET, "en")]
    got = secrets.scan(frame(spark, rows), secrets.empty_ledger(spark)).collect()
    assert sorted((str(r.doc_id), [tuple(f) for f in r.findings]) for r in got) == sorted((str(i), plain(t)) for i, t, _ in rows)


def test_ledger_reads_only_what_is_new(spark):
    ledger = secrets.empty_ledger(spark)
    first, second = [(1, SECRET, "en"), (2, "b", "en")], [(1, SECRET, "en"), (1, "c", "en"), (3, "b", "en")]

    def size():
        return spark.read.schema(secrets.LEDGER).parquet(ledger).count()

    secrets.scan(frame(spark, first), ledger).collect()
    assert size() == 2 * len(secrets.RULES)
    got = secrets.scan(frame(spark, second), ledger).collect()
    assert size() == 3 * len(secrets.RULES)
    assert sorted((r.doc_id, len(r.findings)) for r in got) == [(1, 0), (1, len(plain(SECRET))), (3, 0)]
    changed = (*secrets.RULES[:2], secrets.Rule("hex", r"[0-9a-f]+", 0, 12, version=2))
    secrets.scan(frame(spark, second), ledger, changed).collect()
    assert size() == 3 * len(secrets.RULES) + 3  # three texts, one rule
    assert secrets.scan(frame(spark, []), ledger).collect() == []


def test_versions_of_one_path_do_not_meet(spark):
    """Ten thousand versions of one path, half of them one blob: each blob is read once."""
    rows = spark.range(10_000).selectExpr("1L as doc_id", "if(id % 2 = 0, 'password=hunter2x', concat('version ', id)) as text", "'en' as lang")
    ledger = secrets.empty_ledger(spark)
    found = secrets.scan(rows, ledger)
    assert found.selectExpr("sum(size(findings))", "count(1)").first() == (5_000, 10_000)
    assert spark.read.schema(secrets.LEDGER).parquet(ledger).count() == 5_001 * len(secrets.RULES)


def test_redaction_blanks_findings_and_nothing_else(spark):
    rows = [(1, SECRET, "en"), (2, "clean é", "en"), (3, None, None), (None, SECRET, "de"), (4, "", "en")]
    docs = frame(spark, rows)
    got = secrets.redact(docs, secrets.empty_ledger(spark), mark="#")
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    want, at = "", 0
    for _, start, end in plain(SECRET):
        if start >= at:
            want += SECRET[at:start] + "#"
        at = max(at, end)
    assert texts[1] == texts[None] == want + SECRET[at:]
    assert (texts[2], texts[3], texts[4]) == ("clean é", None, "")


def test_toxicity_finds_documents_and_their_sentences(spark):
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in ("lo", "ma", "ti") for b in ("ra", "ne", "su", "ki") for c in ("", "n", "l", "st")]
    rows, labels = [], []
    for i in range(600):
        parts = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(6)]
        toxic = i % 4 == 0
        if toxic:
            parts[rng.randrange(6)] += " " + rng.choice(["vileen", "vileor", "vileus"])
        rows.append((i, ". ".join(parts) + ".", "en"))
        labels.append((i, 0, int(toxic)))
    rows += [(900, None, None), (901, "", "en"), (None, "lora nevi", "en"), (902, "Lora. That is VILEUS, mane! Kira", "en"), (3, rows[3][1], "en")]
    labels += [(5, 0, None), (None, 0, 1), (7777, 0, 1)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, marks, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held_out = [i for i in range(0, 600, 5)]
    assert sum((got[i].score >= 0.5) == (i % 4 == 0) for i in held_out) >= 0.98 * len(held_out)
    assert got[902].score >= 0.5 and [(s.start, s.end) for s in got[902].offending] == [(5, 26)]
    assert got[900].score == got[901].score < 0.5 and not got[901].offending
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5}
    empty = toxicity.learn(docs.limit(0), marks, F.lit(True))
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_toxicity_sample_holds_different_texts(spark):
    rows = [(i, "copied text", "en") for i in range(50)] + [(50 + i, f"text number {i}", "en") for i in range(8)] + [(60 + i, None, "en") for i in range(20)]
    labels = spark.createDataFrame([(i, 0, int(i % 2)) for i, *_ in rows], "doc_id long, quality int, toxic int")
    for per_label, want in ((4, 4), (100, 6)):
        got = toxicity.sample(frame(spark, rows), labels, F.lit(True), toxicity.Bounds(per_label=per_label))
        assert len(got) == len(set(got)) == 2 * want and [y for _, y in got].count(1) == want


def test_clean_documents_are_not_toxic_by_their_length(spark):
    model = toxicity.Model(-8.1, {"vileus": 12.0})
    clean = "mane lora kira. " * 20_000
    got = {r.doc_id: r for r in toxicity.score(frame(spark, [(1, clean, "en"), (2, clean + "vileus.", "en")]), model).collect()}
    assert got[1].score < 0.5 <= got[2].score and not got[1].offending and len(got[2].offending) == 1


def test_language_on_held_out_rows_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.col("doc_id") % 4 == 0
    model = language.learn(docs, ~held_out)
    got = language.classify(docs.where(held_out), model, keep=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    sure = [r for r in got if not r.rejected]
    assert sum(r.lang == r.lang_pred for r in sure) >= 0.97 * len(sure)
    assert all(0 <= r.score <= 1 for r in got)
    rows = [(1, None, "en"), (2, "", None), (3, "123 !?", "en"), (None, "the thing with that", None), (4, LONG, "en")]
    odd = {r.doc_id: r.lang_pred for r in language.classify(frame(spark, rows), model).collect()}
    assert odd[1] == odd[2] == odd[3] == "und" and odd[None] in dict(model)
    nothing = language.learn(frame(spark, rows[:3]), F.lit(True))
    assert nothing == [] and {r.lang_pred for r in language.classify(frame(spark, rows), nothing).collect()} == {"und"}


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(PIECES)


def test_pieces_are_the_best_path_of_the_library(model, tmp_path):
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(open(PIECES, "rb").read())
    proto.trainer_spec.model_type = 1  # search for the best path
    for p in proto.pieces:
        if p.type == 1:
            p.score = max(p.score, -40_000.0) / 1000 - 1
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    library, own = SentencePieceProcessor(model_file=str(path)), pieces.Codec(pieces.read_model(str(path)))
    rng = random.Random(2)
    words = ["the", "Thing", "naïve", "x", "ability,", "(and)", "e.g.", "12345", "größe", "日本", "don't", "  ", "\n", "zzzq"]
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(12)))
        a, b = library.encode(text), list(own.encode(text))
        total = [sum(library.get_score(i) for i in ids if not library.is_byte(i)) for ids in (a, b)]
        assert a == b or abs(total[0] - total[1]) < 1e-3
        assert library.decode(b) == own.decode(b) == text


def test_pieces_round_trip_everything(spark, model):
    rows = [(1, None, None), (2, "", "en"), (3, " ", "en"), (4, "a▁b ▁", "en"), (5, "\x00\t\r\n", "en"), (6, "😀é", "en"), (None, "x", "x"), (7, LONG, "en"), (8, "n" * 50_000, "en"), (8, "twice", "en")]
    encoded = pieces.encode(frame(spark, rows), model, keep=("doc_id", "score"))
    got = encoded.collect()
    assert all(r.exact for r in got if r.ids is not None) and sum(r.ids is None for r in got) == 1
    assert all(r.n_tokens == len(r.ids) for r in got if r.ids is not None)
    back = {(r.doc_id, r.text) for r in pieces.decode(encoded, model).collect()}
    assert back == {(i, t) for i, t, _ in rows}
    assert pieces.encode(frame(spark, []), model).collect() == []


def test_cutting_into_parts_changes_no_path(model):
    cut, whole = pieces.Codec(model), pieces.Codec(model)
    whole.parts = re.compile(".+", re.DOTALL).findall
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("ab cde.,\n\t(é日😀²0 the-'") for _ in range(rng.randrange(40)))
        a, b = list(cut.encode(text)), list(whole.encode(text))
        assert a == b or abs(sum(model.scores[i] for i in a) - sum(model.scores[i] for i in b)) < 1e-6
