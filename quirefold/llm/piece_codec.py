"""Exact encoding and decoding with a merge-type sentencepiece model, by backtracking over longest matches.

An encoding is the one that merging makes if and only if each pair of adjacent tokens is one that merging their joined
text makes again. So tokens are taken greedily: an Aho-Corasick automaton gives the longest token at each position, a
pair is checked by merging it anew (remembered), a token that fails gives way to its longest proper prefix, and a
position at which nothing fits is marked in a bitfield and never tried again.

Texts: null counts as empty; an empty text has the end id only. Model files: BPE with or without byte fallback and
without user-defined pieces. The model's bytes are read on the driver and go to the tasks with the code (at most
MAX_MODEL_BYTES).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quirefold.llm.common import append_by_arrow

SPACE = "▁"
MAX_MODEL_BYTES = 64 << 20
#: Entries of the caches of chunks and of pairs in a task. A pair's key is one number, so more of them fit.
CACHE, PAIRS = 200_000, 400_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Letters of words; texts are cut between these and other characters where no piece spans the cut.
LETTER = "A-Za-zÀ-ɏ"


class PieceCodec:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or any(p.type == USER_DEFINED for p in proto.pieces):
            raise ValueError("only merge-type models without user-defined pieces")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that leave texts as they are but for spaces")
        self.dummy = norm.add_dummy_prefix
        self.unk = proto.trainer_spec.unk_id
        self.eos = proto.trainer_spec.eos_id
        self.unk_surface = proto.trainer_spec.unk_surface.encode()
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.chars = {p for p in self.id_of if len(p) == 1}
        self._matcher()
        self._cutter()
        self.pairs: dict[int, bool] = {}
        self.cache = _Chunks(self)
        self.controls = [i for i, kind in enumerate(self.types) if kind == CONTROL]
        self.surface = [self._surface(i) for i in range(len(self.pieces))]
        self.surfaces = pa.array(self.surface, pa.large_binary())
        self.is_control, self.is_byte = (np.array([t == kind for t in self.types]) for kind in (CONTROL, BYTE))

    # -- building ---------------------------------------------------------------------------------------------------

    def _matcher(self) -> None:
        """The automaton of all pieces that merging can make, and each one's longest proper prefix of the kind."""
        import ahocorasick

        whole = [p for p in self.id_of if set(p) <= self.chars and self._merged(p) == [p]]
        known = set(whole)
        self.automaton = ahocorasick.Automaton()
        self.length, self.shorter = {}, {}
        for p in whole:
            i = self.id_of[p]
            self.automaton.add_word(p, i)
            self.length[i] = len(p)
            self.shorter[i] = next((self.id_of[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in known), -1)
        self.automaton.make_automaton()

    def _cutter(self) -> None:
        """How texts are cut into chunks that no merge spans: before each run of spaces, and between letters and others."""
        inside = [p for p in self.id_of if SPACE in p.lstrip(SPACE)]
        letter = regex.compile(f"[{LETTER}]")
        spans = any(a != SPACE and bool(letter.match(a)) != bool(letter.match(b)) for p in self.id_of for a, b in pairwise(p))
        if inside:
            self.chunks = lambda text: [text]
        elif spans:
            self.chunks = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        else:
            self.chunks = regex.compile(f"{SPACE}*[{LETTER}]+|{SPACE}*[^{LETTER}{SPACE}]+|{SPACE}+").findall

    def _merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the pair of the highest score first, of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    # -- encoding ---------------------------------------------------------------------------------------------------

    def _fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            a, b = self.pieces[left], self.pieces[right]
            found = self._merged(a + b) == [a, b]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def _backtrack(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        if (whole := self.id_of.get(text)) is not None and whole in self.length:
            return [whole]
        n, length, shorter, fits = len(text), self.length, self.shorter, self._fits
        longest = [-1] * n
        for end, i in self.automaton.iter(text):
            start = end + 1 - length[i]
            if longest[start] < 0 or length[i] > length[longest[start]]:
                longest[start] = i
        open_ = bytearray(b"\x01") * (n + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = ids[-1] if ids else -1
            while token >= 0:
                end = at + length[token]
                if open_[end] and (last < 0 or fits(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                open_[at] = 0
                ids.pop()
                at -= length[last]
                token = last
        return ids

    def chunk_ids(self, chunk: str) -> list[int]:
        if self.chars.issuperset(chunk):
            return self._backtrack(chunk)
        ids: list[int] = []
        start = 0
        unknown = False
        for i, c in enumerate(chunk):
            if c not in self.chars:
                if start < i:
                    ids += self._backtrack(chunk[start:i])
                    unknown = False
                start = i + 1
                if self.byte_ids:
                    ids += [self.byte_ids[b] for b in c.encode()]
                elif not unknown:
                    ids.append(self.unk)
                unknown = True
        return ids + (self._backtrack(chunk[start:]) if start < len(chunk) else [])

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids, the end id last."""
        text = (text or "").replace(" ", SPACE)
        if text and self.dummy:
            text = SPACE + text
        return b"".join(map(self.cache.__getitem__, self.chunks(text))) + self.eos.to_bytes(4, "little")

    # -- decoding ---------------------------------------------------------------------------------------------------

    def _surface(self, i: int) -> bytes:
        kind = self.types[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return b"" if kind == CONTROL else self.unk_surface if kind == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()

    def decode(self, ids: list[int]) -> str:
        """The text; a byte that belongs to no character becomes U+FFFD."""
        parts = list(map(self.surface.__getitem__, ids))
        if self.dummy:  # the first text that isn't empty loses the space before it
            for k, i in enumerate(ids):
                if self.types[i] == NORMAL and parts[k][:1] == b" ":
                    parts[k] = parts[k][1:]
                    break
                if parts[k]:
                    break
        if not any(i in ids[:-1] for i in self.controls):  # these end a run of bytes
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        out, run = [], bytearray()
        for i, part in zip(ids, parts, strict=True):
            if self.types[i] == BYTE:
                run += part
            else:
                out += [_bytewise(run), part.decode()]
                run = bytearray()
        return "".join([*out, _bytewise(run)])

    def decode_all(self, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """decode() of many texts, whose ids lie one behind another: text i's from starts[i] to starts[i + 1]. What all ids stand
        for is taken at once, and only a text with control ids before its last one, or with bytes that are no text, is
        decoded by itself."""
        taken = self.surfaces.take(pa.array(ids))
        data = memoryview(taken.buffers()[2] or b"")
        at = np.frombuffer(taken.buffers()[1], "<i8")[taken.offset : taken.offset + len(ids) + 1]
        controls, single = (np.concatenate([[0], np.cumsum(kind[ids])]) for kind in (self.is_control, self.is_byte))
        out = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b == a:
                out.append(b"")
                continue
            found = bytes(data[at[a] : at[b]])
            alone = controls[b - 1] > controls[a]
            if not alone and single[b] > single[a]:
                try:
                    found.decode()
                except UnicodeDecodeError:
                    alone = True
            if alone:
                found = self.decode(ids[a:b].tolist()).encode()
            elif self.dummy and found[:1] == b" " and self.types[ids[a]] == NORMAL:
                found = found[1:]
            out.append(found)
        return pa.array(out, pa.large_binary()).cast(pa.large_string())


def _bytewise(run: bytearray) -> str:
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        at += n
    return "".join(out)


class _Chunks(dict):
    """Ids of chunks as bytes; words repeat, so most lookups end here."""

    def __init__(self, codec: PieceCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.codec.chunk_ids(chunk), "<i4").tobytes()
        if len(chunk) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = ids
        return ids


@lru_cache(maxsize=2)
def _codec(model: bytes) -> PieceCodec:
    """One a process: what a task remembers serves the next one."""
    return PieceCodec(model)


def _model(path: str) -> bytes:
    model = Path(path).read_bytes()
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} has more than {MAX_MODEL_BYTES} bytes")
    return model


def _encoded(codec: PieceCodec, texts: pa.Array) -> pa.Array:
    coded = [codec.encode(x.as_py()) for x in texts]
    offsets = np.zeros(len(coded) + 1, "i4")
    np.cumsum([len(x) // 4 for x in coded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))


def encode(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """df's columns `keep` (all, if None) and ids_col, array<int>: the ids of text_col and the end id."""
    model = _model(model_path)

    def build():
        codec = _codec(model)
        return lambda columns: [_encoded(codec, columns[0])]

    return append_by_arrow(df, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], build, [text_col], keep)


def encode_and_decode(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """encode(), and decode() of its ids, in one pass: ids cross to Spark once and never back."""
    model = _model(model_path)

    def build():
        codec = _codec(model)

        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            ids = _encoded(codec, columns[0])
            return [ids, codec.decode_all(ids.values.to_numpy(), ids.offsets.to_numpy())]

        return compute

    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())]
    return append_by_arrow(df, fields, build, [text_col], keep)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """df's columns `keep` (all, if None) and text_col: the text of ids_col (null or empty ids: empty)."""
    model = _model(model_path)

    def build():
        codec = _codec(model)

        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            lists = columns[0].fill_null([])
            return [codec.decode_all(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]))]

        return compute

    return append_by_arrow(df, [T.StructField(text_col, T.StringType())], build, [ids_col], keep)
