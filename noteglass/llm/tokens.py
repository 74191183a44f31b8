"""Encoding with a public tokenizer, over Arrow batches.

A text is first cut into the tokenizer's own pre-tokens; each distinct pre-token is
encoded once by the tokenizers library and kept, so the library sees the vocabulary of
a corpus instead of its length. No merge ever crosses a pre-token, so the ids are those
of the whole text. A vocabulary file that normalises texts, or cuts them in another way
than byte-level BPE does, gets whole texts instead: its ids are the library's as well, and
only the byte table, for decoding and offsets, isn't there.

Defined cases: null and empty text have the empty list; text that spells a special token
is ordinary text; repeated doc_ids (a document delivered twice) give one row; columns
other than the two named ones are ignored, whatever they are called.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = "byte_bpe_50k.json"
FOLDER = "/opt/tokenizers"

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for text of ASCII only, for the faster engine.
ASCII = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
KEEP, LONGEST = 400_000, 64


def vocabulary(path: str | None = None) -> str:
    """Path of the vocabulary file; a bare name is looked up among the public tokenizers."""
    path = path or NAME
    if os.path.dirname(path):
        return path
    try:
        import public_tokenizers

        return public_tokenizers.path(path)
    except ImportError:
        return os.path.join(FOLDER, path)


def byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others are moved above 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids, offsets and text of a byte-level BPE vocabulary."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as fh:
            told = json.load(fh)
        #: Does the file cut texts by the pattern above, and nothing else?
        self.cuts = told.get("normalizer") is None and {**(told.get("pre_tokenizer") or {}), "trim_offsets": None} == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": None, "use_regex": True}
        self.split, self.split_ascii = regex.compile(PATTERN).findall, re.compile(ASCII, re.ASCII).findall
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        return self.split_ascii(text) if text.isascii() and not _FOREIGN_SPACE.search(text) else self.split(text)

    def _learn(self, new: list[str]) -> None:
        for k in range(0, len(new), 8192):
            part = new[k : k + 8192]
            for piece, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[piece] = np.array(got.ids, dtype="<i4").tobytes()

    def encode_pieces(self, lists: list[list[str]]) -> list[list[bytes]]:
        """Ids of every pre-token, as little-endian bytes."""
        new = list(set().union(*lists).difference(self.known)) if lists else []
        self._learn(new)
        get = self.known.__getitem__
        out = [list(map(get, pieces)) for pieces in lists]
        for piece in new:
            if len(piece) > LONGEST:
                del self.known[piece]
        if len(self.known) > KEEP:
            self.known.clear()
        return out

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        return [b"".join(x) for x in self.encode_pieces([self.pieces(t) if t else [] for t in texts])]

    @cached_property
    def token_bytes(self) -> list[bytes]:
        """Bytes of every id, by the reversed byte table; special tokens spell themselves."""
        if not self.cuts:
            raise ValueError("the vocabulary isn't byte-level BPE: it has no byte table")
        table, size = byte_of_character(), self.tokenizer.get_vocab_size(with_added_tokens=True)
        special = {i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        return [(s.encode() if i in special else bytes(table[c] for c in s)) for i in range(size) if (s := self.tokenizer.id_to_token(i)) is not None]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids. A character that the ids hold only in part becomes U+FFFD."""
        names = self.token_bytes
        return b"".join(names[i] for i in ids).decode("utf-8", errors="replace")

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end character of every token; tokens that share a character both cover it."""
        lengths = np.array([len(b) for b in self.token_bytes], dtype=np.int64)[ids]
        ends = np.cumsum(lengths)
        at = np.cumsum((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80) - 1  # byte to character
        if not len(ids):
            return ends, ends
        return at[ends - lengths], at[ends - 1] + 1


_FOREIGN_SPACE = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about that many bytes of text each."""
    start, size = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    for k, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _lists(ids: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))


def one_each(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each key: a record that was delivered twice has the same content."""
    return docs.select(F.col(key), F.col(text)).dropDuplicates([key])


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of every document."""
    path, kind = vocabulary(path), docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in slices(whole, text):
                yield pa.RecordBatch.from_arrays([batch.column(key), _lists(enc.encode(batch.column(text).to_pylist()))], names=[key, "ids"])

    return one_each(docs, key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def count(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, n_tokens) of every document, null and empty texts with 0."""
    path, names = vocabulary(path), [key, *carry]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", n_tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in slices(whole, text):
                sizes = [len(x) // 4 for x in enc.encode(batch.column(text).to_pylist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sizes, type=pa.int32())], names=[*names, "n_tokens"])

    return docs.select(*names, text).mapInArrow(run, schema)


def check(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens, exact, covers, n_split): does decoding give the text again, do the
    offsets cover it, and how many tokens start inside a character."""
    path, kind = vocabulary(path), docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in slices(whole, text):
                rows = []
                texts = batch.column(text).to_pylist()
                for t, raw in zip(texts, enc.encode(texts), strict=True):
                    t, ids = t or "", np.frombuffer(raw, dtype="<i4")
                    start, end = enc.spans(t, ids)
                    covers = (len(ids) == 0 and not t) or bool(start[0] == 0 and end[-1] == len(t) and (start[1:] <= end[:-1]).all())
                    rows.append((len(ids), enc.decode(ids) == t, covers, int((start[1:] < end[:-1]).sum())))
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                kinds = [pa.int32(), pa.bool_(), pa.bool_(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(list(c), type=k) for c, k in zip(cols, kinds, strict=True))], names=[key, "n_tokens", "exact", "covers", "n_split"])

    return one_each(docs, key, text).mapInArrow(run, f"{key} {kind}, n_tokens int, exact boolean, covers boolean, n_split int")
