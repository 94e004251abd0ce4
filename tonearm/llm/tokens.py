"""Token ids of whole texts by a public byte-level BPE vocabulary.

Method. A pair of neighbouring bytes that occurs inside no vocabulary token can
never end up in one token, so the encoding has a boundary there: a forced cut.
Texts are cut at the forced boundaries that also leave the pre-tokenizer's
pattern undisturbed, the fragments are encoded independently (each distinct one
once per worker) and their ids are concatenated. Everything is linear in the
text, and no text is truncated.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.session import spread

#: Default vocabulary; every function takes another path.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fragments remembered per worker; more are encoded afresh, with equal results.
CACHE_SIZE = 300_000
#: The published pre-tokenization pattern of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SPACE, APOSTROPHE = 0x20, 0x27
WHITE = frozenset(b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def forced_pairs(tokens: list[bytes]) -> np.ndarray:
    """256 x 256 flags, flattened: byte pairs inside no token."""
    joined = np.frombuffer(b"".join(tokens), np.uint8).astype(np.int64)
    inner = np.ones(len(joined), bool)
    inner[np.cumsum([len(t) for t in tokens]) - 1] = False  # a token's last byte begins no inner pair
    at = np.flatnonzero(inner)
    forced = np.ones(65536, bool)
    forced[joined[at] * 256 + joined[at + 1]] = False
    return forced


def safe_cuts(forced: np.ndarray) -> np.ndarray:
    """Forced pairs at which the pre-tokenizer pattern may be cut too.

    The only context the pattern looks at is white space ahead and contractions.
    A cut before a space that follows no white space keeps both; so does a cut
    between two printable ASCII bytes unless the second is an apostrophe.
    """
    cuts = forced.reshape(256, 256).copy()
    left_white = np.zeros(256, bool)
    left_white[list(WHITE)] = True
    printable = np.zeros(256, bool)
    printable[0x21:0x7F] = True
    allowed = np.zeros((256, 256), bool)
    allowed[:, SPACE] = True
    allowed |= printable[:, None] & printable[None, :]
    allowed[:, APOSTROPHE] = False
    allowed[left_white, :] = False
    return (cuts & allowed).reshape(-1)


class FragmentEncoder:
    """Encodes byte strings by cutting them at forced boundaries."""

    def __init__(self, path: str = DEFAULT_VOCABULARY) -> None:
        import tiktoken

        ranks = read_ranks(path)
        self._plain = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cuts = safe_cuts(forced_pairs(list(ranks)))
        self.known: dict[bytes, bytes] = {}

    def whole(self, text: str) -> list[int]:
        """The encoding without any cut, for comparison."""
        return self._plain.encode_ordinary(text)

    def _fragment(self, piece: bytes) -> bytes:
        ids = np.array(self._plain.encode_ordinary(piece.decode("utf-8", "replace")), "<i4").tobytes()
        if len(self.known) < CACHE_SIZE:
            self.known[piece] = ids
        return ids

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text begins (n + 1 offsets)."""
        encoded = [t.encode("utf-8", "replace") if t else b"" for t in texts]
        data = b"".join(encoded)
        ends = np.cumsum([len(e) for e in encoded], dtype=np.int64) if encoded else np.zeros(0, np.int64)
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        raw = np.frombuffer(data, np.uint8)
        starts = np.zeros(len(raw) + 1, bool)
        if len(raw):
            starts[1:-1] = self.cuts[raw[:-1].astype(np.int32) * 256 + raw[1:]]
            starts[begins] = True
        starts[len(raw)] = True
        marks = np.flatnonzero(starts)
        known, fragment = self.known, self._fragment
        spans = marks.tolist()
        parts = [known.get(p) or fragment(p) for p in (data[s:e] for s, e in zip(spans, spans[1:]))]
        sizes = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) // 4 for p in parts], out=sizes[1:])
        flat = np.frombuffer(b"".join(parts), "<i4")
        offsets = np.concatenate([[0], sizes[np.searchsorted(marks, ends)]]) if len(ends) else np.zeros(1, np.int64)
        return flat, offsets


_encoders: dict[str, FragmentEncoder] = {}


def encoder(path: str) -> FragmentEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = FragmentEncoder(path)
    return _encoders[path]


def _encode_batches(path: str, lengths_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            flat, offsets = enc.encode(batch.column("__text").to_pylist())
            if lengths_only:
                out, name = pa.array(np.diff(offsets)), "tokens"
            else:
                out, name = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())), "ids"
            kept = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), out], names=[*kept, name])

    return run


def token_ids(df: DataFrame, ident: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(ident, ids)``: the token ids of every text, no special tokens.

    Null and empty texts give an empty list, as defined by this project. Every
    row gives one row, repeated and null identifiers included; an empty table
    gives none. Other columns are not read.
    """
    slim = df.select(F.col(ident), F.col(text).cast("string").alias("__text"))
    schema = f"`{ident}` {df.schema[ident].dataType.simpleString()}, ids array<int>"
    return spread(slim).mapInArrow(_encode_batches(vocabulary, False), schema)


def _decode_batches(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {rank: token for token, rank in read_ranks(path).items()}
        for batch in batches:
            texts = [b"".join(pieces[i] for i in ids or ()).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            kept = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    return run


def texts_of(ids: DataFrame, ident: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(ident, text)``: what the ids of ``token_ids`` say; null and empty lists are empty texts."""
    schema = f"`{ident}` {ids.schema[ident].dataType.simpleString()}, text string"
    return ids.select(ident, "ids").mapInArrow(_decode_batches(vocabulary), schema)


def token_counts(df: DataFrame, keep: list[str], text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` of ``df`` and ``tokens``, the number of ids of ``text``."""
    slim = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return spread(slim).mapInArrow(_encode_batches(vocabulary, True), ", ".join([*fields, "tokens bigint"]))
