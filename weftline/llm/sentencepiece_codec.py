"""SentencePiece encoding and decoding that keeps every piece's place in the source.

A text is normalised through the model's compiled character map by longest prefixes; beside every normalised byte stands the
source offset it came from. The normalised text is cut where white space begins, because no piece of such a model has white
space after another character; distinct cuts are merged once, and the lengths of the pieces, summed up and looked up in the
alignment, give each piece's bytes in the source.
"""

from __future__ import annotations

import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.frames import lists, map_arrow, pick
from weftline.llm.tokens import slices

SPACE = "▁"
SPACE_BYTES = SPACE.encode()
REPLACEMENT = b"\xef\xbf\xbd"
# Kinds of pieces in the public model format.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Bytes of a task's table of words already merged, about 200 for an entry beside its own; it is emptied when full. Longer words
#: than LONG are merged anew each time.
WORDS_BYTES, LONG = 60_000_000, 1000


class CharacterMap:
    """The compiled map: a double array of prefixes, and the replacements they point to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size :]
        self.known: dict[bytes, tuple[int, bytes] | None] = {}

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of text[at:] that the map has, and its replacement."""
        key = text[at : at + 32]
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = self._search(text, at)
        return self.known[key]

    def _search(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        units, found = self.units, None
        if not units:
            return None
        place = self._child(units[0])
        for i in range(at, len(text)):
            place ^= text[i]
            unit = units[place]
            if unit & 0x800000FF != text[i]:
                break
            place ^= self._child(unit)
            if unit >> 8 & 1:
                start = units[place] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return found

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class PieceModel:
    """A BPE model with byte fallback, read from its file's bytes. Merging is left to the library, on text that is already
    normalised: ``merger`` is the same model without its own normalisation."""

    def __init__(self, blob: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or trainer.treat_whitespace_as_suffix or not trainer.byte_fallback:
            raise ValueError("only BPE models with byte fallback and white space before words are encoded here")
        self.characters = CharacterMap(spec.precompiled_charsmap)
        self.dummy_prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        pieces, self.kinds = [p.piece for p in proto.pieces], [p.type for p in proto.pieces]
        by_words = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.cuts = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if by_words else "(?s).+")
        self.out = [b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(pieces, self.kinds, strict=True)]
        self.sizes = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(pieces, self.kinds, strict=True)], np.int32)
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.words: dict[str, bytes] = {}
        self.held = 0

    # Normalisation

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the offset in the source."""
        if not text:
            return b"", np.zeros(1, np.int32)
        if not self.characters.units and self.escape and not self.squeeze:
            return self._escaped(text)
        out, where, at, n = bytearray(), [], 0, len(text)
        mark = SPACE_BYTES if self.escape else b" "
        chunk = lambda i: self._step(text, i)
        if self.squeeze:
            while at < n and (step := chunk(at))[1] == b" ":
                at += step[0]
            if at == n:
                return b"", np.array([n], np.int32)
        if self.dummy_prefix:
            out += mark
            where += [at] * len(mark)
        spaced = self.squeeze
        while at < n:
            length, new = chunk(at)
            while spaced and new.startswith(b" "):
                new = new[1:]
            if new:
                shown = new.replace(b" ", mark)
                out += shown
                where += [at] * len(shown)
                spaced = new.endswith(b" ")
            at += length
            if not self.squeeze:
                spaced = False
        end = n
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :]
                end = where[-len(mark)]
                del where[-len(mark) :]
        return bytes(out), np.array([*where, end], np.int32)

    def _step(self, text: bytes, at: int) -> tuple[int, bytes]:
        if found := self.characters.longest(text, at):
            return found
        first = text[at]
        length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return length, text[at : at + length]

    def _escaped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The same for an empty character map, without a loop over characters."""
        wide = np.ones(len(text), np.int64)
        wide[np.frombuffer(text, np.uint8) == 0x20] = len(SPACE_BYTES)
        lead = len(SPACE_BYTES) if self.dummy_prefix else 0
        where = np.zeros(lead + int(wide.sum()) + 1, np.int32)
        where[lead:-1] = np.repeat(np.arange(len(text), dtype=np.int32), wide)
        where[-1] = len(text)
        return (SPACE_BYTES if lead else b"") + text.replace(b" ", SPACE_BYTES), where

    # Merging

    def learn(self, words: set[str]) -> None:
        """Merges the words that the table does not have yet. Those in use stay until they are used."""
        if new := [w for w in words if w not in self.words]:
            ids = self.merger.encode(new, num_threads=1)
            raw = np.fromiter(chain.from_iterable(ids), np.int32).tobytes()
            at = 0
            for w, x in zip(new, ids, strict=True):
                self.words[w] = raw[at : (at := at + 4 * len(x))]
                self.held += 200 + 4 * len(w) + 4 * len(x)

    def forget(self, words: set[str]) -> None:
        """Drops the long ones of words, and all words once they take more than WORDS_BYTES."""
        for w in words:
            if len(w) > LONG and w in self.words:
                self.held -= 200 + 4 * len(w) + len(self.words.pop(w))
        if self.held > WORDS_BYTES:
            self.words.clear()
            self.held = 0

    def encode(self, texts: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """How many pieces each text has, and of all pieces the ids, first bytes and ends in their sources."""
        shown = [self.normalise(t) for t in texts]
        cuts = [self.cuts.findall(s.decode()) for s, _ in shown]
        distinct = set().union(*cuts)
        self.learn(distinct)
        known = self.words
        ids = np.frombuffer(b"".join([known[w] for words in cuts for w in words]), np.int32)
        self.forget(distinct)
        ends = np.cumsum(self.sizes[ids], dtype=np.int64)
        bounds = np.cumsum([0, *(len(s) for s, _ in shown)])
        last = np.searchsorted(ends, bounds[1:], "right")  # pieces up to the end of each text
        counts = np.diff(last, prepend=0)
        # The alignments have one place more than bytes, for the end.
        where = np.concatenate([w for _, w in shown]) if shown else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(texts)), counts)
        return counts.tolist(), ids, where[ends - self.sizes[ids] + row], where[ends + row]

    # Decoding

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as UTF-8: control pieces vanish, the space before the first piece goes, byte pieces join into
        characters, and bytes that form none become U+FFFD."""
        ids = ids.tolist()
        raw = b"".join(map(self.out.__getitem__, ids))
        lead = next((i for i in ids if self.kinds[i] != CONTROL), None)
        strip = (self.dummy_prefix or self.squeeze) and lead is not None and self.kinds[lead] == NORMAL and self.out[lead][:1] == b" "
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = self._repaired(ids)
        return raw[1:] if strip else raw

    def _repaired(self, ids: list[int]) -> bytes:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                run += self.out[i]
                continue
            while run:
                size = next((k for k in (1, 2, 3, 4) if _is_character(run[:k])), 0)
                out.append(bytes(run[:size]) if size else REPLACEMENT)
                del run[: size or 1]
            if i is not None:
                out.append(self.out[i])
        return b"".join(out)


def _is_character(raw: bytearray) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes text_col of every row with the SentencePiece BPE model at path model.

    Returns (doc_id, ids array<int>, starts array<int>, ends array<int>, decoded string): for each piece its id and its bytes
    [start, end) in the UTF-8 text; decoded is what the ids decode to. Rows are handled alone, so repeated rows come out
    repeated, an empty table gives none, and other columns are not read. A null text counts as empty: no ids, decoded ''.
    A null id stays null. A byte of the dummy prefix has the width 0 in the source. A very long text takes memory in
    proportion to its own length. Only the model's bytes, a file of fixed size, go to the executors."""
    with open(model, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch):
        if _loaded.get("blob") is not blob.value:
            _loaded.update(m=PieceModel(blob.value), blob=blob.value)
        m = _loaded["m"]
        for lo, hi, data, offsets in slices(batch.column(1)):
            raw, cuts = data.tobytes(), offsets.tolist()
            sizes, ids, starts, ends = m.encode([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            each = np.split(ids, np.cumsum(sizes)[:-1])
            yield {"doc_id": batch.column(0).slice(lo, hi - lo), "ids": lists(ids, sizes), "starts": lists(starts, sizes), "ends": lists(ends, sizes), "decoded": pa.array([m.decode(x) for x in each], pa.binary()).cast(pa.string())}

    return map_arrow(pick(docs, doc_id=id_col, text=text_col), run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, starts array<int>, ends array<int>, decoded string")


_loaded: dict = {}


def digest(coded: DataFrame, *more: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of encode_decode's rows, and the columns more."""
    sha: Column = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), *more)
