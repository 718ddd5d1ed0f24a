"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces reads the text once. At each position its output links name every piece that
ends there, longest first; each relaxes the best score of the position, so one pass is a whole Viterbi search (highest
sum of piece scores, ties to the longer last piece). A character that no single-character piece covers costs ten less
than the worst piece and becomes byte pieces, or the unknown id where the model has none.

Blanks turn into the mark U+2581 and the text gets one in front, as the model says. Pieces that shorter ones spell at a
higher score are on no best path and stay out of the automaton. A text is cut where no other piece reaches over (before
marks, after runs of Latin letters, around line ends; checked for each model); the paths of the parts together are the best
path of the text. Parts recur, so a worker remembers a bounded number of them.
A U+2581 that stands in the text itself is written as bytes, so decoding gives back every text exactly.

Null texts give null ids, empty texts none; texts of any length cost time in proportion. Repeated rows and rows without
an id are encoded each for themselves; other columns are not looked at. Empty tables give empty tables.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracewright.llm.common import unused

MARK = "▁"
UNKNOWN_COST = 10.0  # fixed by the published model: below the worst score
REMEMBERED = 80_000  # parts in each of two generations
ROWS = 256  # documents that are turned into one Arrow batch


@dataclass(frozen=True)
class Model:
    pieces: tuple[str, ...]  # by id; empty where the id is no plain piece
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]  # id of each byte, or empty
    unknown: int
    prefix: bool


def read_model(path: str) -> Model:
    """Pieces and scores of a model file. Only models without normalisation rules, which round-trip, are taken."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    rules = proto.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
        raise ValueError(f"{path}: normalises texts; decoding could not give them back")
    if proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: blanks as suffixes are not supported")
    model = SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(size)]
    names = [model.id_to_piece(i) for i in range(size)]
    byte_of = {names[i]: i for i in range(size) if model.is_byte(i)}
    byte_ids = tuple(byte_of[f"<0x{b:02X}>"] for b in range(256)) if len(byte_of) == 256 else ()
    return Model(
        tuple(n if p else "" for n, p in zip(names, plain, strict=True)),
        tuple(model.get_score(i) for i in range(size)),
        byte_ids,
        model.unk_id(),
        bool(rules.add_dummy_prefix),
    )


def outdone(piece: str, scores: dict[str, float]) -> bool:
    """Whether shorter pieces spell this one at a higher score, so that no best path ever takes it."""
    best = [0.0] + [-math.inf] * len(piece)
    for end in range(1, len(piece) + 1):
        for start in range(end):
            if end - start < len(piece):
                best[end] = max(best[end], best[start] + scores.get(piece[start:end], -math.inf))
    return best[-1] > scores[piece]


def cuts(kept: list[str]) -> str:
    """A pattern that cuts a text where no piece reaches over: before a mark, at the end of a run of letters, around a
    line end. What some piece reaches over is not cut at."""
    letters = "A-Za-zÀ-ɏ"
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in kept):
        return ".+"
    alone = "".join(c for c in "\n\r\t" if not any(c in p for p in kept))
    if any(re.search(f"[{letters}][^{letters}]", p) for p in kept):
        return f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else "")
    rest = f"[^{letters}{MARK}{alone}]"
    return f"{MARK}*[{letters}]+|{MARK}*{rest}+[{letters}]*|{MARK}+" + (f"|[{alone}]" if alone else "")


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.model = model
        scores = {p: s for p, s in zip(model.pieces, model.scores, strict=True) if p}
        kept = [p for p in scores if not outdone(p, scores)]
        number = {p: i for i, p in enumerate(model.pieces)}
        self.automaton = ahocorasick.Automaton()
        for piece in kept:
            self.automaton.add_word(piece, (number[piece], len(piece), scores[piece]))
        self.automaton.make_automaton()
        self.unknown_score = min((s for p, s in zip(model.pieces, model.scores, strict=True) if p), default=0.0) - UNKNOWN_COST
        self.parts = re.compile(cuts(kept), re.DOTALL).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.lengths = [len(p) for p in model.pieces]
        self.covered = {p for p in model.pieces if len(p) == 1}
        self.byte_of = {i: b for b, i in enumerate(model.byte_ids)}
        self.texts = [p.replace(MARK, " ") for p in model.pieces]
        self.high = np.zeros(len(model.pieces), bool)  # bytes that are part of a character
        for b, i in enumerate(model.byte_ids):
            self.texts[i] = chr(b) if b < 128 else ""
            self.high[i] = b >= 128

    def spell(self, text: str) -> list[int]:
        """A text that no piece covers."""
        return [self.model.byte_ids[b] for b in text.encode()] if self.model.byte_ids else [self.model.unknown]

    def search(self, part: str) -> bytes:
        size, worst = len(part), -math.inf
        best, last = [worst] * (size + 1), [-1] * (size + 1)  # score, and the piece that ends here (-1: unknown)
        best[0] = 0.0
        if self.covered.issuperset(part):
            for end, (piece, length, cost) in self.automaton.iter(part):
                end += 1
                score = best[end - length] + cost
                if score > best[end]:
                    best[end], last[end] = score, piece
        else:
            self.settle(part, best, last)
        path, at, lengths = [], size, self.lengths
        while at:
            piece = last[at]
            if piece >= 0:
                path.append(piece)
                at -= lengths[piece]
            else:
                path.extend(reversed(self.spell(part[at - 1])))
                at -= 1
        path.reverse()
        return array("i", path).tobytes()

    def settle(self, part: str, best: list[float], last: list[int]) -> None:
        """The same, with characters that no piece of their own covers."""
        done, covered, unknown = 0, self.covered, self.unknown_score

        def upto(end: int) -> None:
            nonlocal done
            while done < end:
                done += 1
                if part[done - 1] not in covered and best[done - 1] + unknown > best[done]:
                    best[done], last[done] = best[done - 1] + unknown, -1

        for end, (piece, length, cost) in self.automaton.iter(part):
            upto(end)
            score = best[end + 1 - length] + cost
            if score > best[end + 1]:
                best[end + 1], last[end + 1] = score, piece
        upto(len(part))

    def part(self, part: str) -> bytes:
        """The ids of a part that is not among the latest."""
        found = self.older.get(part) or self.search(part)
        if len(part) < 64:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[part] = found
        return found

    def encode(self, text: str) -> array:
        ids = array("i")
        for k, run in enumerate(text.split(MARK) if text else ()):
            if k:
                ids.extend(self.spell(MARK))
            run = run.replace(" ", MARK)
            parts = self.parts(MARK + run if self.model.prefix and k == 0 else run)
            get, slow = self.known.get, self.part
            ids.frombytes(b"".join([get(p) or slow(p) for p in parts]))
        return ids

    def decode(self, ids: array | list[int]) -> str:
        if not len(ids):
            return ""
        texts, byte_of = self.texts, self.byte_of
        if self.high[np.asarray(ids, np.int32)].any():
            run, out = bytearray(), []
            for i in ids:
                if i in byte_of:
                    run.append(byte_of[i])
                    continue
                if run:
                    out.append(run.decode(errors="replace"))
                    run.clear()
                out.append(texts[i])
            out.append(run.decode(errors="replace"))
            text = "".join(out)
        else:
            text = "".join([texts[i] for i in ids])
        return text[1:] if self.model.prefix and text[:1] == " " else text


def encode(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` with ids (null for a null text), n_tokens, and whether decoding the ids gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast({"model": astuple(model)})
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType(
        [*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("exact", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = shared.value  # a worker keeps it from task to task, and with it the automaton and the latest parts
        codec = box.get("codec") or box.setdefault("codec", Codec(Model(*box["model"])))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                flat, ends, sizes, exact = array("i"), [0], [], []
                for value in rows.column(len(keep)).to_pylist():
                    ids = array("i") if value is None else codec.encode(value)
                    flat.extend(ids)
                    ends.append(len(flat))
                    sizes.append(None if value is None else len(ids))
                    exact.append(None if value is None else codec.decode(ids) == value)
                lists = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([s is None for s in sizes])
                )
                columns = [rows.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, lists, pa.array(sizes, pa.int64()), pa.array(exact, pa.bool_())], names=schema.names
                )

    return docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias(unused(docs, "__text"))).mapInArrow(run, schema)


def decode(rows: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The columns ``keep`` with the text of the ids; null for null ids. Ids of control pieces stand for nothing."""
    shared = rows.sparkSession.sparkContext.broadcast(astuple(model))
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Model(*shared.value))
        for batch in batches:
            texts = [None if v is None else codec.decode(v) for v in batch.column(len(keep)).to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.select(*[rows[c] for c in keep], rows[ids].alias(unused(rows, "__ids"))).mapInArrow(run, schema)
