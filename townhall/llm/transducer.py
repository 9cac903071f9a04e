"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines come from a model file: the normaliser (the model's automaton of character replacements, the
longest first; blanks to marks, extra ones dropped where the model says so, a mark before the text), the pieces
(an arc for each, with its weight), and byte fallback (an arc of byte pieces for a character that no piece has).
The normaliser has one path for a text, so it is run, not searched; composed with its output the other two are a
lattice over places, and the shortest path in the tropical semiring (weights add along a path, the least path
wins) is the encoding.

A unigram model's weights are its negated scores. A merge model (BPE) has no such weights; its machine
carries a state for the last piece, and an arc has infinite weight where the library would not leave
the two pieces side by side: where merging their characters gives anything else. Exactly one path of
finite weight is left then, the library's. Where no piece joins two characters, every path passes
between them, so the lattice falls apart there and equal parts are solved once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from townhall.llm.common import hold, slices

MARK = "▁"
#: What a worker remembers at most: solved parts, their characters, and pairs of pieces.
REMEMBERED_PARTS, REMEMBERED_CHARACTERS, REMEMBERED_PAIRS = 400_000, 4_000_000, 300_000
INFINITE = float("inf")
#: Text bytes that a worker encodes at a time.
SLICE = 1 << 20


class Replacements:
    """The automaton of a model's character replacements: a double array of bytes whose ends point into a list of texts."""

    def __init__(self, table: bytes):
        size = int.from_bytes(table[:4], "little") if table else 0
        self.units = np.frombuffer(table[4 : 4 + size], "<u4").tolist() if size else []
        self.texts = table[4 + size :]
        self.begins: dict[str, bool] = {}  # whether a replaced run begins with a character

    def walk(self, text: str, start: int = 0) -> Iterator[tuple[int, str | None]]:
        """Ends of the runs from start on that some replaced run begins with, and what replaces each; None if nothing does."""
        at = self.units[0] >> 10 << ((self.units[0] & 512) >> 6)
        for end in range(start + 1, len(text) + 1):
            value = None
            for b in text[end - 1].encode(errors="replace"):
                if at ^ b >= len(self.units) or (unit := self.units[at ^ b]) & 0x800000FF != b:
                    return
                at ^= b ^ (unit >> 10 << ((unit & 512) >> 6))
                value = self.units[at] & 0x7FFFFFFF if unit >> 8 & 1 else None
            yield end, None if value is None else self.texts[value : self.texts.index(b"\0", value)].decode()

    def applied(self, text: str) -> str:
        if not self.units:
            return text
        for c in set(text) - self.begins.keys():
            self.begins[c] = any(True for _ in self.walk(c))
        first = "".join(re.escape(c) for c in set(text) if self.begins[c])
        if not first:
            return text
        out, at = [], 0
        for m in re.finditer(f"[{first}]", text):
            if m.start() < at:
                continue
            found = [(end, t) for end, t in self.walk(text, m.start()) if t is not None]
            if found:
                out += [text[at : m.start()], found[-1][1]]
                at = found[-1][0]
        return "".join([*out, text[at:]])


class Transducer:
    """The compiled machines of one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        if any(p.type == spec.SentencePiece.USER_DEFINED for p in spec.pieces):
            raise ValueError("models with pieces of the user's own, which go before all others, aren't supported")
        self.replacements = Replacements(spec.normalizer_spec.precompiled_charsmap)
        self.merges = spec.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        self.prefix, self.squeeze = spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces
        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = spec.SentencePiece
        self.pieces = [p.piece for p in spec.pieces]
        self.unknown = processor.unk_id()
        self.arcs = {p.piece: (i, -p.score) for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(MARK, " ").encode() if p.type == kinds.NORMAL else b"" for p in spec.pieces]
        self.surface[self.unknown] = " ⁇ ".encode()
        #: The pieces' trie: a character leads to (children, piece or -1, weight).
        self.trie: dict[str, tuple] = {}
        for piece, (number, weight) in sorted(self.arcs.items()):
            node = self.trie
            for c in piece[:-1]:
                node = node.setdefault(c, ({}, -1, INFINITE))[0]
            node[piece[-1]] = (node.get(piece[-1], ({},))[0], number, weight)
        worst = max(w for _, w in self.arcs.values())
        self.fallback = max(10.0, worst + 10.0)  # dearer than any piece
        self.pairs: dict[int, bool] = {}
        self.part = re.compile(self.parting())

    def parting(self) -> str:
        """A pattern of parts that no piece crosses: marks begin one, and so does each run of signs (and each
        run of others after it) if no piece has a sign beside anything else."""
        joined = {p[i : i + 2] for p in self.arcs for i in range(len(p) - 1)}
        if any(x[1] == MARK != x[0] for x in joined):
            return "(?s).+"
        alone = {c for c in map(chr, range(128)) if not c.isalnum()}
        signs = "".join(sorted(c for c in alone if all(x[0] in alone and x[1] in alone for x in joined if c in x)))
        if not signs:
            return f"{MARK}+[^{MARK}]*|[^{MARK}]+"
        s = re.escape(signs)
        return f"{MARK}*[^{MARK}{s}]+|{MARK}+|[{s}]+"

    def normalised(self, text: str) -> str:
        text = self.replacements.applied(text)
        if self.squeeze:  # blanks at the ends and beside blanks go; at the end marks do, too
            text = re.sub(" +", " ", text.lstrip(" "))
            text = text.rstrip(f" {MARK}")
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def merged(self, text: str) -> list[str]:
        """What merging the characters of a short text gives: the best pair first, the left one of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = INFINITE, -1
            for i in range(len(parts) - 1):
                arc = self.arcs.get(parts[i] + parts[i + 1])
                if arc is not None and arc[1] < best:
                    best, at = arc[1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def beside(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a."""
        ok = self.pairs.get(a << 32 | b)
        if ok is None:
            if len(self.pairs) > REMEMBERED_PAIRS:
                self.pairs.clear()
            x, y = self.pieces[a], self.pieces[b]
            ok = self.pairs[a << 32 | b] = self.merged(x + y) == [x, y]
        return ok

    def shortest(self, part: str) -> list[int]:
        """The piece ids of the shortest path through the lattice of one part of a normalised text."""
        n, root, pairs, merges, beside = len(part), self.trie, self.pairs, self.merges, self.beside
        distance, back, last = [0.0] + [INFINITE] * n, [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            here, before = distance[i], last[i]
            if here == INFINITE:
                continue
            free, kids, j = before < 0 or not merges, root, i
            while j < n:
                node = kids.get(part[j])
                if node is None:  # no piece goes on like this
                    break
                j += 1
                kids, piece, weight = node
                # of a merge model one path of finite weight leads to a place, so a second arc needn't be tried
                if piece >= 0 and (distance[j] == INFINITE if merges else here + weight < distance[j]):
                    ok = free or pairs.get(before << 32 | piece)
                    if ok or (ok is None and beside(before, piece)):
                        distance[j], back[j], last[j] = here + weight, i, piece
            if part[i] not in self.arcs and here + self.fallback < distance[i + 1]:
                distance[i + 1], back[i + 1], last[i + 1] = here + self.fallback, i, -1
        out, at = [], n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(part[back[at] : at].encode(errors="replace"))]
            else:
                out.append(self.unknown)
            at = back[at]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        return [i for part in self.part.findall(self.normalised(text)) for i in self.shortest(part)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; without the mark that encoding put before it. Bytes that are no character become U+FFFD."""
        data = b"".join(map(self.surface.__getitem__, ids))
        if self.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode(errors="replace")


class _Parts(dict):
    """Parts of texts by number, each solved once; ids of all parts one after the other."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine, self.new, self.characters = machine, [], 0
        self.ids, self.start = np.zeros(1 << 20, np.int32), np.zeros(1 << 16, np.int64)

    def __missing__(self, part: str) -> int:
        n = self[part] = len(self)
        self.new.append(part)
        return n

    def solve(self) -> None:
        parts, self.new = self.new, []
        self.characters += sum(map(len, parts))
        n = len(self) - len(parts)
        found = [self.machine.shortest(p) for p in parts]
        flat = np.fromiter(chain.from_iterable(found), np.int32)
        to = int(self.start[n])
        while to + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.ids[to : to + len(flat)] = flat
        self.start[n + 1 : n + 1 + len(parts)] = to + np.cumsum([len(x) for x in found])


_machines: dict[str, Transducer] = {}
_solved: dict[str, _Parts] = {}


def _forget() -> None:
    _solved.clear()
    _machines.clear()


def _machine(path: str) -> Transducer:
    hold("transducer", _forget)
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


def _parts(path: str) -> _Parts:
    known = _solved.get(path)
    if known is None or len(known) > REMEMBERED_PARTS or known.characters > REMEMBERED_CHARACTERS:
        _solved[path] = _Parts(_machine(path))
    return _solved[path]


def _ids_of(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, and where each text's begin and the last one's end."""
    machine, known = _machine(path), _parts(path)
    parts = [machine.part.findall(machine.normalised(t)) for t in texts]
    n = np.array([len(p) for p in parts])
    at = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.int64, int(n.sum()))
    del parts
    known.solve()
    begin = known.start[at]
    size = known.start[at + 1] - begin
    before = np.cumsum(size) - size
    ids = known.ids[np.repeat(begin - before, size) + np.arange(int(size.sum()))]
    return ids, np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            ids, ends = _ids_of(path, [t or "" for t in b.column("text").to_pylist()])
            column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*b.columns, column], [*b.schema.names, "piece_ids"])

    return encode


def _checked(path: str, with_ids: bool):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(path)
        for b in slices(batches, "text", SLICE):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids, ends = _ids_of(path, texts)
            little, flat = ids.astype("<u4", copy=False), ids.tolist()
            runs = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            same = [machine.decode(flat[s:e]) == t.replace(MARK, " ") for (s, e), t in zip(runs, texts, strict=True)]
            crc = [zlib.crc32(memoryview(little[s:e])) for s, e in runs]
            keep = [c for c in b.schema.names if c != "text"]
            columns = [*(b.column(c) for c in keep), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(same)]
            names = [*keep, "n_pieces", "ids_crc32", "same"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)))
                names.append("piece_ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return check


def _decode(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(path)
        for b in batches:
            ids = b.column("piece_ids")
            out = []
            for k in range(len(ids)):
                x = ids[k].values
                out.append(None if x is None else machine.decode(x.to_numpy(zero_copy_only=False).tolist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "decoded"])

    return decode


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """docs (any columns, among them text) with piece_ids: the ids of every whole text, as the library gives them.

    A null or empty text has none. Null ids and repeated rows keep their rows; a column of the name
    piece_ids is replaced. Empty tables give none."""
    rows = docs.drop("piece_ids")
    return rows.mapInArrow(_encode(model), T.StructType([*rows.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))]))


def decode_pieces(ids: DataFrame, model: str) -> DataFrame:
    """ids (any columns, among them piece_ids) with decoded: the texts; null for null. What encode_pieces made
    of a text gives the text again, except that U+2581 comes back as a blank, as in the library."""
    rows = ids.drop("decoded")
    return rows.mapInArrow(_decode(model), T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def checked_pieces(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """docs (any columns, among them text) without text, and with n_pieces, ids_crc32 (of the ids, little-endian, 32
    bits), same (whether decoding the ids gives the text again) and, if asked for, piece_ids; all in one pass."""
    made = [T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("same", T.BooleanType())]
    made += [T.StructField("piece_ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    rows = docs.drop(*(f.name for f in made))
    return rows.mapInArrow(_checked(model, with_ids), T.StructType([*(f for f in rows.schema.fields if f.name != "text"), *made]))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, same: every text encoded and decoded again; same: the text came back."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return checked_pieces(rows, model, with_ids=False)
