"""SentencePiece encoding and decoding (operator 7): merge-type pieces through a table of prefixes.

Merging pieces greedily gives every prefix of a text one last piece, and a split of a text is the right one exactly if
each two neighbours are compatible: merged anew from their joint letters, they come out as the same two pieces. So the
encoder walks the text once. An automaton over the vocabulary names the pieces that end at each letter; the one that is
compatible with the last piece of the prefix before it is stored; the ids are then read off backwards. Time is linear in
the text whatever its words look like, since a piece has a largest length.

Places that no piece spans (after a word, before a space; around letters that stand alone in the vocabulary) cut a text
into parts that are encoded on their own, and frequent short parts are remembered in a table of bounded size. Letters
outside the vocabulary become their UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

SPACE = "▁"
MODEL = "piece_bpe_32k.model"


class PieceEncoder:
    """Encodes like the library's encode() for merge-type models that keep their text as it is (identity rules)."""

    PARTS, PAIRS, PART = 300_000, 400_000, 48

    def __init__(self, path: str) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [sp.piece_to_id(f"<0x{i:02X}>") for i in range(256)]
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece = {i: sp.id_to_piece(i) for i in plain}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        joined = {c for p in self.piece.values() if len(p) > 1 for c in p}
        self.alone = "".join(c for c in "\n\t\r" if c not in joined)
        inner = any(SPACE in p.lstrip(SPACE) for p in self.piece.values())
        lone = re.escape(self.alone)
        self.cut = None if inner else re.compile(f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + (f"|[{lone}]+" if lone else "")).findall
        self.parts: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.number = sp.vocab_size()

    def merged(self, text: str) -> list[str]:
        """Greedy merging from single letters: best score first, leftmost among equals. For pairs of pieces only."""
        s = list(text)
        while True:
            best, at = None, -1
            for i in range(len(s) - 1):
                x = self.score.get(s[i] + s[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if best is None:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a; a of -1: whether b may stand first."""
        want = [self.piece[b]] if a < 0 else [self.piece[a], self.piece[b]]
        if len(self.pairs) >= self.PAIRS:
            self.pairs.clear()
        known = self.pairs[a * self.number + b] = self.merged("".join(want)) == want
        return known

    def known_letters(self, text: str) -> list[int]:
        """Ids of a text whose letters are all in the vocabulary, by the table of prefixes."""
        last: list[int | None] = [None] * (len(text) + 1)
        last[0] = -1
        size = [0] * (len(text) + 1)
        known, compatible, number = self.pairs.get, self.compatible, self.number
        for end, (length, piece) in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                before = last[end - length]
                if before is not None:
                    fits = known(before * number + piece)
                    if compatible(before, piece) if fits is None else fits:
                        last[end], size[end] = piece, length
        ids, at = [], len(text)
        while at:
            if not size[at]:
                raise ValueError("a prefix has no last piece: not a merge-type vocabulary")
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def part(self, text: str) -> tuple[int, ...]:
        ids: list[int] = []
        start = 0
        for at, letter in enumerate(text):
            if letter not in self.id:
                if at > start:
                    ids += self.known_letters(text[start:at])
                ids += [self.bytes[b] for b in letter.encode("utf-8", "surrogatepass")]
                start = at + 1
        if start < len(text):
            ids += self.known_letters(text[start:] if start else text)
        out = tuple(ids)
        if len(text) <= self.PART:
            if len(self.parts) >= self.PARTS:
                self.parts.clear()
            self.parts[text] = out
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        known, part = self.parts.get, self.part
        return list(chain.from_iterable([known(p) or part(p) for p in (self.cut(text) if self.cut else [text])]))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _run(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path or public_tokenizers.path(MODEL))
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                ids = [e.encode(t) for t in part.column(0).to_pylist()]
                yield pa.record_batch([part.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array([e.decode(x) for x in ids], pa.string())], ["rec", "ids", "decoded"])

    return run


def encoded(docs: DataFrame, text_col: str = "text", path: str | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Every row of ``docs`` as ``rec`` (a struct of the columns in ``keep``, by default all), its ``ids`` and ``decoded``.

    A null text counts as empty and has no ids. No begin or end ids. ``path``: the model's file, the same on every
    executor; by default the installed package's.
    """
    packed = docs.select(F.col(text_col).alias("text"), F.struct(*(keep or ["*"])).alias("rec"))
    return packed.mapInArrow(_run(path), packed.select("rec", F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("string").alias("decoded")).schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = encoded(load(spark, sf_dir, "documents"), keep=("doc_id",))
    return digests(out.select("rec.doc_id", "ids", "decoded"))


def digests(encoded_rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of rows with doc_id, ids and decoded."""
    return encoded_rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
