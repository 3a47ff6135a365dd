"""SentencePiece BPE encoding and decoding by a table of each prefix's last token."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.llm.common import give_back, small_batches

SPACE = "▁"
#: Bytes of parts (words) with their ids that a Python worker remembers while it works on a partition, if a caller sets no bound; what was not asked for of late is
#: forgotten. Half as many bytes go to compatible pairs, of about 128 each.
REMEMBERED = 16 << 20
#: Bytes that a remembered part takes beside its characters.
ENTRY = 200


class PieceBPE:
    """Encoder and decoder of a SentencePiece BPE model with byte fallback, identity normalisation and a dummy prefix.

    In BPE each prefix of a text has one last token, and two neighbours are compatible if the two pieces' text encodes to just them.
    So the last token of prefix i is the one piece that an automaton finds to end at i, and that is compatible with the last token of
    the prefix before it. Going back from the end by the lengths of last tokens gives the ids.
    """

    def __init__(self, model_file: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(model_file, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.precompiled_charsmap or not proto.normalizer_spec.add_dummy_prefix or proto.normalizer_spec.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback, identity normalisation and a dummy prefix is needed")
        if any(p.type == 4 for p in proto.pieces) or len(proto.pieces) > 1 << 16:
            raise ValueError("user-defined pieces or over 65,536 pieces are not supported")
        self.piece = [p.piece for p in proto.pieces]
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece holds a space after other characters; words could not be encoded one by one")
        self.score = [p.score for p in proto.pieces]
        self.length = [len(p.piece) for p in proto.pieces]
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        surface = {1: lambda p: p.piece.replace(SPACE, " ").encode(), 2: lambda p: proto.trainer_spec.unk_surface.encode(), 6: lambda p: bytes([int(p.piece[1:-1], 16)])}
        self.surface = [surface.get(p.type, lambda p: b"")(p) for p in proto.pieces]
        self.found = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.found.add_word(p, (len(p), i))
        self.found.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.alone: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held, self.remembered = 0, REMEMBERED
        self.breaks = "\n" not in "".join(self.id)
        # Marks that no piece has just after a letter: a word's letters and what follows can be encoded apart.
        self.marks = "".join(c for c in punctuation if not any(re.search(rf"[^\W\d_]{re.escape(c)}", p) for p in self.id))
        self.border = re.compile(rf"[{re.escape(self.marks)}](?<=[^\W\d_].)" if self.marks else r"(?!)", re.S)

    def halves(self, i: int) -> tuple[int, int] | None:
        """The two pieces that the last merge of a piece's own text joins; none of a single character, or if its text does not become that piece.

        Neighbours of best score merge, leftmost first: the definition of BPE, which a piece's few characters go through once in a worker.
        """
        if i not in self.split:
            parts, last = list(self.piece[i]), None
            while len(parts) > 1:
                pairs = [self.id.get(x + y) for x, y in zip(parts, parts[1:], strict=False)]
                known = [k for k, p in enumerate(pairs) if p is not None]
                if not known:
                    break
                at = max(known, key=lambda k: (self.score[pairs[k]], -k))
                last = self.id.get(parts[at], -1), self.id.get(parts[at + 1], -1)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.split[i] = last if len(parts) == 1 else None
        return self.split[i]

    def starts(self, i: int) -> bool:
        """Does a piece's own text become that piece, so that it can follow the start or a character without a piece?"""
        if (ok := self.alone.get(i)) is None:
            ok = self.alone[i] = len(self.piece[i]) == 1 or self.halves(i) is not None
        return ok

    def compatible(self, a: int, b: int) -> bool:
        """Do the texts of a and b, side by side, stay a and b?

        Seen backwards in time, the pieces at the border are a and b, then the half at the border of the one that was merged later, and so on down to characters.
        A merge over the border happens just if two of them that lie there together form a piece of better score than the merge that then
        takes one of them in; of equal scores the left one goes first.
        """
        if len(self.pairs) > self.remembered >> 8:
            self.pairs.clear()
        ok = self.pairs[a << 16 | b] = self.starts(b) and self.apart(a, b)
        return ok

    def apart(self, a: int, b: int) -> bool:
        piece, score, known = self.piece, self.score, self.id
        limit, right = -float("inf"), False
        while True:
            i = known.get(piece[a] + piece[b])
            if i is not None and (score[i] > limit or right and score[i] == limit):
                return False
            x, y = self.halves(a), self.halves(b)
            if x is None and y is None:
                return True
            if y is None or x is not None and score[a] < score[b]:
                limit, right, a = score[a], False, x[1]
            else:
                limit, right, b = score[b], True, y[0]
            if a < 0 or b < 0:
                return True

    def part(self, text: str) -> bytes:
        """Ids of a part, as 16-bit integers."""
        n = len(text)
        last = [-1] * n
        pairs, alone, length_of = self.pairs, self.alone, self.length
        for end, (length, i) in self.found.iter(text):
            if last[end] >= 0:
                continue  # the one compatible piece was found
            if end < length or (a := last[end - length]) < 0:
                if alone.get(i) or i not in alone and self.starts(i):
                    last[end] = i
            elif (ok := pairs.get(a << 16 | i)) or ok is None and self.compatible(a, i):
                last[end] = i
        out, at = [], n - 1
        while at >= 0:
            if (i := last[at]) >= 0:
                out.append(i)
                at -= length_of[i]
            else:
                out += [self.byte[b] for b in reversed(text[at].encode())]
                at -= 1
        return array("H", out[::-1]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text, as 16-bit integers, part by part: a part is a word with the spaces before it, or what follows its letters from a mark on. No piece reaches
        over two parts."""
        if not text:
            return b""
        if "  " in text or text[0] == " " or SPACE in text or not self.breaks:
            units = re.findall(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if self.breaks else f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text.replace(" ", SPACE))
            parts = self.border.sub(r" \g<0>", " ".join(units)).split(" ")
        else:
            parts = self.border.sub(r" \g<0>", SPACE + text.replace(" ", f" {SPACE}").replace("\n", " \n ")).split(" ")
        known, before = self.known, self.before
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            for p in parts:
                if p not in known:
                    if (ids := before.get(p)) is None:
                        ids = self.part(p)
                    known[p] = ids
                    self.held += ENTRY + 4 * len(p)
            out = b"".join(map(known.__getitem__, parts))
            # Two generations: what was not asked for since the last change is forgotten.
            if 2 * self.held > self.remembered:
                self.known, self.before, self.held = {}, known, 0
            return out

    def forget(self) -> None:
        self.known, self.before, self.held = {}, {}, 0

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.surface.__getitem__, ids))
        if ids and self.piece[ids[0]].startswith(SPACE):
            out = out[1:]
        return out.decode("utf-8", "replace")


MODELS: dict[str, PieceBPE] = {}


def model(model_file: str) -> PieceBPE:
    if model_file not in MODELS:
        MODELS[model_file] = PieceBPE(model_file)
    return MODELS[model_file]


def encoded(batches: Iterator[pa.RecordBatch], model_file: str, text_col: str, remembered: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[str]]]:
    """Each batch with the ids and the decoded text of its rows."""
    bpe = model(model_file)
    bpe.remembered = remembered
    for batch in give_back(batches):
        texts = batch.column(text_col)
        for i in range(0, max(1, len(texts)), 512):
            part = batch.slice(i, 512)
            ids = [np.frombuffer(bpe.encode(t.as_py() or ""), np.uint16) for t in part.column(text_col)]
            yield part, ids, [bpe.decode(x.tolist()) for x in ids]
    bpe.forget()
    bpe.pairs.clear()


def encode(docs: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", remembered: int = REMEMBERED) -> DataFrame:
    """All columns of docs with the ids of the whole text, without begin or end ids, and their decoded text.

    Null and empty text give no ids and empty decoded text. Rows stay in their partitions and nothing is shuffled; a row's size is
    bounded by its own text. remembered: bytes that a worker may hold of parts it met; more of them save time. Columns named ids_col or decoded_col are replaced. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    schema = docs.select(*kept).schema.add(ids_col, T.ArrayType(T.IntegerType())).add(decoded_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, texts in encoded(batches, model_file, text_col, remembered):
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, flat), pa.array(texts, pa.string())], [*kept, ids_col, decoded_col])

    return small_batches(docs.select(*kept)).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, model_file: str, keys: list[str], text_col: str = "text", remembered: int = 4 * REMEMBERED) -> DataFrame:
    """The outputs of encode() as digests, taken in the same tasks: keys, n_tokens, ids_sha256, decoded_sha256. A job of its own may remember more."""
    number: list[bytes] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not number:
            number.extend(str(i).encode() for i in range(1 << 16))
        for part, ids, texts in encoded(batches, model_file, text_col, remembered):
            ids_sha = [hashlib.sha256(b",".join(map(number.__getitem__, x.tolist()))).hexdigest() for x in ids]
            text_sha = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            counts = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), counts, pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [*keys, "n_tokens", "ids_sha256", "decoded_sha256"])

    columns: Callable = docs.select(*keys).schema.add
    schema = columns("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return small_batches(docs.select(*keys, text_col)).mapInArrow(run, schema)
