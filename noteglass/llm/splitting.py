"""Cutting oversized texts at natural boundaries, with an overlap.

Boundaries are the places between tokens that don't break a character, each with the pause
that the text makes there: paragraph, line, sentence, clause, word, or none. From every
boundary, the piece that starts there ends at the farthest boundary within the limit, of
the strongest pause that comes after half of the limit; its legal successor is the start
of the next piece, ``overlap`` tokens before that end (rounded down to a whole pre-token
where one starts nearby). Pointer doubling then derives all cuts at once: the successor
table of all boundaries, of all texts of a batch together, is squared again and again, and
the set of starts doubles with it.

A text within the limit isn't cut. Every piece has at most ``limit`` tokens, the pieces
cover the text, and each repeats at least ``overlap`` tokens of the one before.

Defined cases: null and empty texts give no rows; a text without any pause is cut between
tokens; a document that was delivered twice is cut once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteglass.llm.tokens import Encoder, encoder, one_each, slices, vocabulary

LIMIT, OVERLAP, NEAR = 512, 64, 16
PAUSES = ["paragraph", "line", "sentence", "clause", "word", "none"]


def _codes(text: str) -> np.ndarray:
    return np.array([ord(c) for c in text], dtype=np.uint32)


ENDERS, WIDE_ENDERS = _codes(".!?…"), _codes("。！？")
CLOSERS, SEPARATORS, WIDE_SEPARATORS = _codes("\"'”’)]`"), _codes(",;:"), _codes("，、；：")
SPACES = _codes(" \t\n\r\x0b\x0c\xa0　​")


def pauses(codes: np.ndarray) -> np.ndarray:
    """Strength of the pause before every character and at the end: 0 paragraph to 5 none."""
    padded = np.concatenate([np.zeros(3, np.uint32), codes, np.array([10], np.uint32)])
    before, before2, before3, after = padded[2:-1], padded[1:-2], padded[:-3], padded[3:]
    space, newline = np.isin(after, SPACES), np.uint32(10)
    ender, closer = np.isin(before, ENDERS), np.isin(before, CLOSERS)
    out = np.full(len(codes) + 1, 5, dtype=np.int8)
    out[space | np.isin(before, SPACES)] = 4
    out[(np.isin(before, SEPARATORS) & space) | np.isin(before, WIDE_SEPARATORS)] = 3
    out[(ender & space) | (closer & np.isin(before2, ENDERS) & space) | np.isin(before, WIDE_ENDERS)] = 2
    out[before == newline] = 1
    out[(before == newline) & ((before2 == newline) | ((before2 == 13) & (before3 == newline)))] = 0
    return out


def farthest(starts: np.ndarray, last: np.ndarray, places: list[np.ndarray], limit: int) -> np.ndarray:
    """End of the piece that starts at each boundary. last: the end of its text."""
    reach, ends = np.minimum(starts + limit, last), np.where(last <= starts + limit, last, -1)
    for place in places:
        k = np.searchsorted(place, reach, side="right") - 1
        found = np.where(k >= 0, place[np.maximum(k, 0)] if len(place) else -1, -1)
        ends = np.where((ends < 0) & (found > starts + limit // 2), found, ends)
    return ends


def reached(first: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """All boundaries that are starts, by squaring the successor table."""
    marked, n = np.zeros(len(successor), dtype=bool), -1
    marked[first] = True
    jump = successor
    while n != (n := int(marked.sum())):
        marked[jump[np.flatnonzero(marked)]] = True
        jump = jump[jump]
    return np.flatnonzero(marked)


def cut(texts: list[str], pieces: list[list[bytes]], enc: Encoder, limit: int, overlap: int) -> list[tuple]:
    """(text number, piece, start, end, tokens, pause) of all texts together. pieces: the ids of their pre-tokens."""
    sizes = np.array([sum(map(len, p)) // 4 for p in pieces])
    width = np.array([len(b) for b in enc.token_bytes], dtype=np.int64)
    ids = np.frombuffer(b"".join(b"".join(p) for p in pieces), dtype="<i4")
    raw = [t.encode() for t in texts]
    head = (np.frombuffer(b"".join(raw), dtype=np.uint8) & 0xC0) != 0x80
    chars_before = np.concatenate([[0], np.cumsum(head)])
    starts_char = np.append(head, True)
    pause = np.concatenate([pauses(np.frombuffer(t.encode("utf-32-le"), dtype="<u4")) for t in texts])

    # boundary b of text d has the global number base[d] + b; char c of it the number char_base[d] + c
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    token_before = np.arange(base[-1]) - owner
    byte_at = np.concatenate([[0], np.cumsum(width[ids])])[token_before]
    char_at = chars_before[byte_at]
    whole = starts_char[byte_at]
    strength = np.where(whole, pause[char_at + owner], 9)
    piece_sizes = np.array([len(x) // 4 for p in pieces for x in p], dtype=np.int64)
    piece_owner = np.repeat(np.arange(len(texts)), [len(p) for p in pieces])
    opens = np.zeros(base[-1], dtype=bool)
    opens[np.cumsum(piece_sizes) - piece_sizes + piece_owner] = True

    number = np.arange(base[-1])
    last = (base[1:] - 1)[owner]
    ends = farthest(number, last, [np.flatnonzero(strength <= s) for s in range(6)], limit)
    back = np.maximum.accumulate(np.where(whole, number, 0))
    back_opens = np.maximum.accumulate(np.where(opens & whole, number, 0))
    target = np.maximum(ends - overlap, 0)
    start = np.where(target - back_opens[target] <= NEAR, back_opens[target], back[target])
    successor = np.where((ends == last) | (start <= number), last, start)
    picked = reached(base[:-1], successor)
    picked = picked[picked != last[picked]]
    first_char = char_at[base[:-1]]
    d = owner[picked]
    stop = ends[picked]
    order = np.arange(len(picked)) - np.searchsorted(d, d)
    kind = np.where(stop == last[picked], -1, np.minimum(strength[stop], 5))
    return list(zip(d.tolist(), order.tolist(), (char_at[picked] - first_char[d]).tolist(), (char_at[stop] - first_char[d]).tolist(), (stop - picked).tolist(), kind.tolist(), strict=True))


def split(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, path: str | None = None) -> DataFrame:
    """(key, piece, start_char, end_char, n_tokens, pause, text) of every document above the limit.

    pause: what the piece ends at; ``end`` for the last one.
    """
    if not 0 <= overlap + 2 * NEAR < limit // 2:
        raise ValueError("the overlap must be well under half of the limit")
    path, kind = vocabulary(path), docs.schema[key].dataType.simpleString()
    names = [*PAUSES, "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in slices(whole, text, 2_000_000):
                keys, texts = batch.column(key).to_pylist(), batch.column(text).to_pylist()
                pieces = enc.encode_pieces([enc.pieces(t) for t in texts])
                large = [k for k, p in enumerate(pieces) if sum(map(len, p)) // 4 > limit]
                if large:
                    rows = cut([texts[k] for k in large], [pieces[k] for k in large], enc, limit, overlap)
                    d, n, a, b, size, pause = map(list, zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([keys[large[x]] for x in d], type=batch.schema.field(key).type), pa.array(n, type=pa.int32()), pa.array(a, type=pa.int32()), pa.array(b, type=pa.int32()), pa.array(size, type=pa.int32()), pa.array([names[x] for x in pause]), pa.array([texts[large[x]][i:j] for x, i, j in zip(d, a, b, strict=True)])],
                        names=[key, "piece", "start_char", "end_char", "n_tokens", "pause", "text"],
                    )

    # a token has at least one byte
    rows = one_each(docs.where(F.octet_length(text) > limit), key, text)
    return rows.mapInArrow(run, f"{key} {kind}, piece int, start_char int, end_char int, n_tokens int, pause string, text string")
