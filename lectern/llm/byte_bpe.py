"""Byte-level BPE: a sentencepiece model written straight from a rank file; encoding and its inverse."""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Pre-tokens whose ids a worker remembers before it starts anew, and their characters: about 40 MB at most.
CACHE, CACHED_CHARS = 200_000, 32


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token and rank on each line), in the order of their ranks."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    return [tokens[i] for i in range(len(tokens))]


def byte_chars() -> list[str]:
    """A printable character for each byte, none of them white space or one that the model treats apart."""
    return [chr(0x4E00 + b) for b in range(256)]


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(tag: int, value: bytes | int | float | str) -> bytes:
    """One protocol-buffer field: numbers as varints, floats as 32 bits, the rest with its length."""
    if isinstance(value, float):
        return _number(tag << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _number(tag << 3) + _number(value)
    value = value.encode() if isinstance(value, str) else value
    return _number(tag << 3 | 2) + _number(len(value)) + value


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model over byte characters: piece i is token i, its score -i, then <unk>.

    The normaliser is the identity: nothing is added, removed or escaped.
    """
    chars = byte_chars()
    pieces = [_field(1, _field(1, "".join(chars[b] for b in t)) + _field(2, -float(i)) + _field(3, 1)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    n = len(tokens)
    minus_one = (1 << 64) - 1
    trainer = b"".join([
        _field(3, 2),  # model_type BPE
        _field(4, n + 1),  # vocab_size
        _field(40, n), _field(41, minus_one), _field(42, minus_one), _field(43, minus_one),  # ids of unk, bos, eos, pad
    ])
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes whole texts by the ranks; pre-tokens are the matches of the pattern.

    A pre-token that is a token as a whole takes its rank; any other is merged by the sentencepiece
    model, best rank first. Text between matches, if the pattern leaves any, has no ids.
    """

    def __init__(self, tokens: list[bytes], pattern: str, model: bytes | None = None, cache: int = CACHE):
        import regex
        import sentencepiece

        self.merges = sentencepiece.SentencePieceProcessor(model_proto=model or serialise(tokens))
        self.most = cache
        # the inverse mapping: each piece of the model back to the bytes its characters stand for
        back = {c: bytes([b]) for b, c in enumerate(byte_chars())}
        unknown = self.merges.unk_id()
        self.pieces = [b"" if i == unknown else b"".join(map(back.__getitem__, self.merges.id_to_piece(i))) for i in range(self.merges.get_piece_size())]
        self.find = regex.compile(pattern).findall
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.table = {b: c for b, c in enumerate(byte_chars())}
        self.known: dict[str, bytes] = {}

    def _ids(self, pieces: list[str]) -> dict[str, bytes]:
        rest, out = [], {}
        for p in pieces:
            raw = p.encode("utf-8", "replace")
            rank = self.whole.get(raw)
            if rank is None:
                rest.append((p, raw.decode("latin-1").translate(self.table)))
            else:
                out[p] = struct.pack("<I", rank)
        if rest:
            for (p, _), ids in zip(rest, self.merges.encode([m for _, m in rest], num_threads=1)):
                out[p] = np.array(ids, "<u4").tobytes()
        return out

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers; none for null or empty texts."""
        found = self.find(text or "")
        known = self.known
        try:
            return b"".join(map(known.__getitem__, found))
        except KeyError:
            pass
        own = self._ids([p for p in dict.fromkeys(found) if p not in known])
        out = b"".join([own[p] if p in own else known[p] for p in found])
        if len(known) + len(own) > self.most:
            known.clear()
        known.update((p, ids) for p, ids in own.items() if len(p) <= CACHED_CHARS)
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for: the inverse of the byte mapping over their pieces."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def encode(
    docs: DataFrame, vocab_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id",
    with_ids: bool = True, with_digests: bool = False,
) -> DataFrame:
    """(doc_id, n_tokens[, ids][, ids_sha256, decoded, ...]) for every row of docs, whole texts.

    ids is the list of ranks. With with_digests the ids are decoded again and ids_sha256 and
    decoded_sha256 digest the ids and the decoded bytes. Null texts count as empty: no ids, digests of
    nothing. Repeated rows and null doc_ids are rows like any other; other columns are not read. The
    vocabulary is a file on the driver; its tokens, bounded by that file, travel with the tasks.
    """
    small_batches(docs.sparkSession)
    tokens = read_ranks(vocab_path)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, pattern, serialise(tokens)))
    work = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = work.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string" * with_digests

    def run(batches):
        codec = None
        for b in batches:
            codec = codec or Codec(*shared.value)
            coded = [codec.encode_bytes(t.as_py()) for t in b.column(1)]
            out = [b.column(0), pa.array([len(c) // 4 for c in coded], pa.int64())]
            if with_ids:
                out.append(pa.array([np.frombuffer(c, "<i4") for c in coded], pa.list_(pa.int32())))
            if with_digests:
                out.append(pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()))
                out.append(pa.array([hashlib.sha256(codec.decode_bytes(c)).hexdigest() for c in coded], pa.string()))
            names = ["doc_id", "n_tokens", *["ids"] * with_ids, *["ids_sha256", "decoded_sha256"] * with_digests]
            yield pa.RecordBatch.from_arrays(out, names)

    return work.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocab_path: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) from lists of ids, by the pieces of the model; bytes that are no UTF-8 become replacement
    characters, null ids null, ids that are no piece an error."""
    tokens = read_ranks(vocab_path)
    shared = encoded.sparkSession.sparkContext.broadcast((tokens, "", serialise(tokens)))
    work = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    kind = work.schema["doc_id"].dataType.simpleString()

    def run(batches):
        codec = Codec(*shared.value)
        for b in batches:
            found = [None if x is None else codec.decode(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["doc_id", "text"])

    return work.mapInArrow(run, f"doc_id {kind}, text string")
