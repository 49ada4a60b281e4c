"""SentencePiece BPE by a table of each prefix's last piece, and its decoding.

Greedy merging (best score first, then leftmost) has two properties: the pieces of a
text's prefix up to a piece's end are the pieces that this prefix has alone, and a row
of pieces is a text's encoding exactly if every two neighbours are what their two
strings together give. So the last piece of each prefix is the only piece that ends
there, keeps whole alone and is compatible with the last piece of the prefix before
it. An Aho-Corasick automaton names the pieces that end at each place, the pair test
merges two neighbours' strings and stops at the first merge across their border, and
the pieces are read off backwards. That is linear in the text, with no heap of merges.

Where no piece of the model has a white space after another character, no merge
crosses the start of a run of white space: a text is then cut there, and the
encodings of short segments are remembered, as are pair tests (bounded tables that are
emptied when full: speed only).

Null text counts as empty (begin and end ids alone, empty text back); repeated rows
stay; any doc_id is passed on; very long texts and segments are encoded whole; extra
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2

SPACE = "▁"
_LOADED: dict[str, PieceTable] = {}


class _Remembered(dict):
    """Encodings of segments as id bytes, made on demand."""

    def __init__(self, table: PieceTable, most: int = 500_000, longest: int = 64):
        super().__init__()
        self.table, self.most, self.longest = table, most, longest

    def __missing__(self, segment: str) -> bytes:
        ids = array("I", self.table.encode_segment(segment)).tobytes()
        if len(segment) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[segment] = ids
        return ids


class PieceTable:
    """Pieces of a SentencePiece BPE model with byte fallback, and what encoding and decoding need of them."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind, normal, trainer = model.SentencePiece, model.normalizer_spec, model.trainer_spec
        types = {p.type for p in model.pieces}
        if (trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or normal.precompiled_charsmap
                or normal.remove_extra_whitespaces or not normal.escape_whitespaces or types & {kind.USER_DEFINED, kind.UNUSED}
                or model.denormalizer_spec.precompiled_charsmap):
            raise ValueError("only BPE models with byte fallback, an identity normalizer and no user-defined or unused pieces")
        self.prefix = SPACE if normal.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.bytes = [byte[b] for b in range(256)]
        control = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.CONTROL}
        self.begin, self.end = control[trainer.bos_piece], control[trainer.eos_piece]
        self.control = sorted(control.values())
        value = {i: bytes([b]) for b, i in byte.items()} | {i: b"" for i in self.control}
        self.surface = [value[i] if i in value else trainer.unk_surface.encode() if p.type == kind.UNKNOWN else p.piece.replace(SPACE, " ").encode()
                        for i, p in enumerate(model.pieces)]
        self.starts_blank = {i for p, i in self.ids.items() if self.prefix and p.startswith(SPACE)}
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.segments = (lambda t: [t]) if crossing else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.automaton = ahocorasick.Automaton()
        self._edges: dict[str, tuple] = {}
        for p in self.ids:
            if self._keeps(p, 0):
                self.automaton.add_word(p, (len(p), self.ids[p]))
        self.automaton.make_automaton()
        self.pieces = [p.piece for p in model.pieces]
        self._pairs: dict[int, bool] = {}
        self.remembered = _Remembered(self)

    def _merges(self, text: str):
        """Start and middle of each merge of ``text``, in their order."""
        at = list(range(len(text) + 1))
        score = [self.scores.get(text[i:i + 2]) for i in range(len(text) - 1)]
        while True:
            best = max((s for s in score if s is not None), default=None)
            if best is None:
                return
            i = score.index(best)
            yield at[i], at[i + 1]
            del at[i + 1], score[i]
            if i:
                score[i - 1] = self.scores.get(text[at[i - 1]:at[i + 1]])
            if i < len(score):
                score[i] = self.scores.get(text[at[i]:at[i + 2]])

    def _keeps(self, text: str, border: int) -> bool:
        """Merging ``text`` ends in one piece (border 0) or in exactly the two pieces that meet at ``border``."""
        done = 0
        for _, middle in self._merges(text):
            if middle == border:
                return False
            done += 1
        return len(text) - done == (2 if border else 1)

    def _growth(self, piece: str) -> tuple[list[str], list[str], bool]:
        """How a piece's first and last part grow to the whole piece, and whether its merges go from better scores to worse ones."""
        got = self._edges.get(piece)
        if got is None:
            ends, heads, tails, scores = {i: i + 1 for i in range(len(piece))}, [piece[0]], [piece[-1]], []
            for start, middle in self._merges(piece):
                ends[start] = end = ends.pop(middle)
                scores.append(self.scores[piece[start:end]])
                if start == 0:
                    heads.append(piece[:end])
                if end == len(piece):
                    tails.append(piece[start:])
            got = heads, tails, all(a >= b for a, b in zip(scores, scores[1:]))
            if piece in self.ids:  # as many as the model has pieces
                self._edges[piece] = got
        return got

    def _meets(self, left: str, right: str) -> bool:
        """Two pieces stay as they are beside each other: no merge across their border comes before one that ends a part at it.

        Their own merges go from better scores to worse ones, so the parts at the border are replayed by score;
        of equal scores the leftmost merge is first. Other pieces' strings are merged step by step.
        """
        (_, tails, fair), (heads, _, also) = self._growth(left), self._growth(right)
        if not (fair and also):
            return self._keeps(left + right, len(left))
        scores, i, k = self.scores, 0, 0
        while True:
            across = scores.get(tails[i] + heads[k])
            before = scores[tails[i + 1]] if i + 1 < len(tails) else None
            after = scores[heads[k + 1]] if k + 1 < len(heads) else None
            if across is not None and (before is None or across > before) and (after is None or across >= after):
                return False
            if before is not None and (after is None or before >= after):
                i += 1
            elif after is not None:
                k += 1
            else:
                return True

    def _string(self, last: int) -> str:
        return self.pieces[last] if last < len(self.pieces) else chr(last - len(self.pieces))

    def compatible(self, left: int, right: int) -> bool:
        if len(self._pairs) >= 500_000:
            self._pairs.clear()
        got = self._pairs[left << 21 | right] = self._meets(self._string(left), self._string(right))
        return got

    def last_pieces(self, text: str) -> list[int]:
        """The last piece's id for each prefix of ``text`` (-1 for the empty one); a character without a piece has its code after the ids."""
        last, known, size = [-1], self._pairs.get, 1
        for end, (n, piece) in self.automaton.iter(text):  # by end
            if end + 1 < size:
                continue
            while size <= end:
                last.append(len(self.pieces) + ord(text[size - 1]))
                size += 1
            before = last[size - n]
            if before >= 0:
                fits = known(before << 21 | piece)
                if not (self.compatible(before, piece) if fits is None else fits):
                    continue
            last.append(piece)
            size += 1
        last += [len(self.pieces) + ord(c) for c in text[size - 1:]]
        return last

    def encode_segment(self, text: str) -> list[int]:
        last, out, i, pieces = self.last_pieces(text), [], len(text), self.pieces
        while i:
            piece = last[i]
            if piece < len(pieces):
                out.append(piece)
                i -= len(pieces[piece])
            else:
                out += [self.bytes[b] for b in reversed(text[i - 1].encode())]
                i -= 1
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` between begin and end id, as native unsigned 32-bit integers."""
        body = (self.prefix + text.replace(" ", SPACE)) if text else ""
        return b"".join((array("I", [self.begin]).tobytes(), *map(self.remembered.__getitem__, self.segments(body)), array("I", [self.end]).tobytes()))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ``ids``: the blank put before a text is taken off, bytes outside UTF-8 become U+FFFD one by one.

        A control id ends a run of bytes: they make no character with those after it.
        """
        out, parts = [], np.split(ids, np.flatnonzero(np.isin(ids, self.control)))
        for flat in (p.tolist() for p in parts):
            flat = flat[1:] if flat and flat[0] in self.control else flat
            raw = b"".join(map(self.surface.__getitem__, flat))
            if not out and flat and flat[0] in self.starts_blank:
                raw = raw[1:]
            if flat:
                out.append(_text(raw))
        return "".join(out)


def _text(raw: bytes) -> str:
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[:e.start].decode(), "�"]
            raw = raw[e.start + 1:]
    return "".join(out)


def piece_table(path: str) -> PieceTable:
    if path not in _LOADED:
        _LOADED[path] = PieceTable(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, model: str | None = None, batch_chars: int = 4_000_000) -> DataFrame:
    """doc_id, ids (begin and end id included, little-endian unsigned 32-bit) and decoded (their text) of each row."""
    model = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        table = piece_table(model)
        for b in batches:
            texts, i = b.column("text").to_pylist(), 0
            while i < len(texts):  # small answers, however many rows a batch has
                k, size, ids = i, 0, []
                while k < len(texts) and size < batch_chars:
                    ids.append(np.frombuffer(table.encode(texts[k]), np.uintc))
                    size, k = size + len(texts[k]), k + 1
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, k - i), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                     pa.array([table.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])
                i = k
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = body.schema["doc_id"].dataType.simpleString()
    return body.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def op12_sentencepiece(spark, sf_dir: str) -> DataFrame:
    got = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op12_sentencepiece": op12_sentencepiece}
