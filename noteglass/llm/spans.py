"""Long exact spans shared between records, by relative Lempel-Ziv parsing.

Every distinct text is a document and a reference block at once. A block is indexed by its
anchors: of all grams of ``GRAM`` characters, the least hash of each window, chosen so that
a common span of ``least`` characters always holds one common anchor. An anchor that no
other text has can't be in a common span, so only the surroundings of the others (the
regions of a text) travel any further.

Blocks are dealt to chunks of bounded size. A document is sent once to every chunk whose
index holds one of its anchors, and factored there against each block: from left to right,
the longest match with the block at the next indexed place is the next factor, and what no
factor takes is literal. A greedy factor may end inside a common span, so each factor is
checked at its boundaries: matches are carried over its left end, and the indexed places
near both ends are tried with all their places in the block. What has ``least`` characters
or more is a duplicate span. Indexed places deep inside a factor need no trial: whatever
span holds one of them lies in the factor.

An anchor in more than ``CROWD`` texts (a common phrase) would send them all to all chunks.
There, equal surroundings are one class first, and the windows of ``least`` characters
around the anchor are hashed and grouped: texts meet only if they share the whole window.
That is exact, and a hot anchor's rows are counted before they are shuffled.

Exact copies are one text from the first step on; only at the end pairs of texts are
spelled out for the records, by a table of classes (text, records).

Defined cases: null, empty and shorter texts share nothing; characters are code points,
compared as they are; a record never pairs with itself, so a record that was delivered
twice doesn't either; repeated passages inside one record are none.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteglass.llm.tokens import slices
from noteglass.session import materialise

LEAST, GRAM, CROWD = 200, 64, 48
CHUNK = 4_000_000  # characters of the reference blocks of one chunk
_WHERE = 28  # bits of a batch's positions; the rest are hash
PIECE = 1 << 26  # longer texts are indexed in overlapping pieces


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every gram, by doubling; size is a power of two."""
    with np.errstate(over="ignore"):
        h, base, n = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15), 1
        while n < size:
            h = h[:-n] * base + h[n:]
            base, n = base * base, 2 * n
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of every window, in two passes over blocks of the window's width."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[str], least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of the anchors of all texts; each has at least ``least`` characters."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    starts = np.cumsum([0, *map(len, parts)])
    h = gram_hashes(np.concatenate(parts), gram)
    crossing = (starts[1:-1, None] - np.arange(1, gram)).ravel()
    where = np.arange(len(h), dtype=np.uint64)
    keys = (h >> np.uint64(_WHERE) << np.uint64(_WHERE)) | where
    keys[crossing] = np.uint64(np.iinfo(np.uint64).max) >> np.uint64(_WHERE) << np.uint64(_WHERE) | where[crossing]
    picked = np.unique(window_minima(keys, least - gram + 1) & np.uint64((1 << _WHERE) - 1)).astype(np.int64)
    picked = picked[~np.isin(picked, crossing)] if len(crossing) else picked
    owner = np.searchsorted(starts, picked, side="right") - 1
    return owner, picked - starts[owner], h[picked].view(np.int64)


def cut(text: str, least: int, piece: int = PIECE) -> Iterator[tuple[int, str]]:
    """(offset, piece) of a text, overlapping so that every window of ``least`` characters is in one piece."""
    step = piece - least + 1
    for at in range(0, max(1, len(text) - least + 1), step):
        yield at, text[at : at + piece]


def index(records: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(h, block, pos, rec): anchors of every distinct text; rec is one record that holds it."""
    rows = records.where(F.length("text") >= least).select("rec", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("block"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for batch in slices(whole, "text"):
                recs, blocks, offsets, texts = [], [], [], []
                for rec, block, t in zip(batch.column("rec").to_pylist(), batch.column("block").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if block not in seen:
                        seen.add(block)
                        for at, piece in cut(t, least):
                            recs.append(rec), blocks.append(block), offsets.append(at), texts.append(piece)
                if texts:
                    owner, pos, h = anchors(texts, least, gram)
                    pos = pos + np.array(offsets)[owner]
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(blocks, type=pa.binary()).take(pa.array(owner)), pa.array(pos.astype(np.int32)), pa.array(recs).take(pa.array(owner))], names=["h", "block", "pos", "rec"])

    return rows.mapInArrow(run, "h bigint, block binary, pos int, rec string")


def survivors(anchor_rows: DataFrame) -> DataFrame:
    """Anchors in at least two texts, once for each text and position, with the number of texts (or a little more).

    They are counted with map-side aggregation before any row is shuffled by its anchor.
    """
    counted = anchor_rows.groupBy("h").agg(F.min("block").alias("low"), F.max("block").alias("high"), F.count("*").alias("n")).where("low != high").select("h", "n")
    return anchor_rows.join(counted, "h").groupBy("h", "block", "pos", "n").agg(F.min("rec").alias("rec"))


def regions(records: DataFrame, kept: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(block, size, h, pos, start, text): of each text its anchors, in order, and all that a span around one can reach."""
    reach = least - gram
    own = kept.groupBy("block").agg(F.min("rec").alias("rec"), F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("a"))
    rows = own.join(records.where(F.length("text") >= least).select("rec", "text"), "rec").select("block", F.col("a.h").alias("h"), F.col("a.pos").alias("pos"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                starts, texts, sizes = [], [], []
                for pos, text in zip(batch.column("pos").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    spans: list[list[int]] = []
                    for p in pos:
                        low, high = max(0, p - reach), min(len(text), p + least)
                        if spans and low <= spans[-1][1]:
                            spans[-1][1] = high
                        else:
                            spans.append([low, high])
                    starts.append([a for a, _ in spans])
                    texts.append([text[a:b] for a, b in spans])
                    sizes.append(sum(b - a for a, b in spans))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block"), pa.array(sizes, type=pa.int64()), batch.column("h"), batch.column("pos"), pa.array(starts, type=pa.list_(pa.int32())), pa.array(texts, type=pa.list_(pa.string()))], names=["block", "size", "h", "pos", "start", "text"]
                )

    return rows.mapInArrow(run, "block binary, size bigint, h array<bigint>, pos array<int>, start array<int>, text array<string>")


def agree(a: str, i: int, b: str, j: int) -> int:
    """Length of the common start of a from i and b from j."""
    n, low, step = min(len(a) - i, len(b) - j), 0, 64
    while low < n:
        high = min(n, low + step)
        if a[i + low : i + high] != b[j + low : j + high]:
            break
        low, step = high, 2 * step
    else:
        return n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[i + low : i + mid] == b[j + low : j + mid] else (low, mid)
    return low


def agree_before(a: str, i: int, b: str, j: int) -> int:
    """Length of the common end of a up to i and b up to j."""
    n, low, step = min(i, j), 0, 64
    while low < n:
        high = min(n, low + step)
        if a[i - high : i - low] != b[j - high : j - low]:
            break
        low, step = high, 2 * step
    else:
        return n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[i - mid : i - low] == b[j - mid : j - low] else (low, mid)
    return low


class Block:
    """The regions of a text; a place in it is a region and an offset."""

    def __init__(self, start: list[int], text: list[str]):
        self.start, self.text = start, text

    def place(self, pos: int) -> tuple[str, int]:
        k = bisect_right(self.start, pos) - 1
        return self.text[k], pos - self.start[k]


def factors(doc: Block, block: Block, shared: list[tuple[int, list[int]]], least: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(start in the document, start in the block, size) of the long factors of a document, carried over their boundaries.

    shared: the document's indexed places, in order, each with all its places in the block.
    """
    reach, begin, end = least - gram, 0, 0  # the last factor
    reached: dict[int, int] = {}  # where the match of each alignment ends
    for pos, places in shared:
        if begin + reach <= pos <= end - least:
            continue
        text, i = doc.place(pos)
        longest = None
        for other in places:
            if pos < reached.get(pos - other, 0):
                continue
            held, j = block.place(other)
            after = agree(text, i, held, j)
            if after < gram:
                continue  # only the hashes are equal
            before = agree_before(text, i, held, j)
            reached[pos - other] = pos + after
            if before + after >= least:
                yield pos - before, other - before, before + after
            if longest is None or after > longest[1]:
                longest = before, after
        if longest and pos >= end:
            begin, end = pos - longest[0], pos + longest[1]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint (start, end) that cover the same."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def parse(known: DataFrame, covers: bool, least: int = LEAST, gram: int = GRAM, chunk: int = CHUNK) -> DataFrame:
    """Factor every document of known (as ``regions`` gives it) against the blocks of the chunks that hold its anchors.

    (a, b), a > b, of texts that share a span; or, covers, (block, start, size) of what
    each text shares with others, disjoint for each chunk.
    """
    chunks = max(1, -(-(known.agg(F.sum("size")).first()[0] or 0) // chunk))
    own = F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")
    places = known.select("block", own.alias("chunk"), F.explode("h").alias("h"))
    held = places.groupBy("h", "chunk").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    partner = F.col("low") < F.col("block") if not covers else (F.col("low") != F.col("block")) | (F.col("high") != F.col("block"))
    sent = places.select("h", "block").join(held, "h").where(partner).select("block", "chunk").distinct()
    columns = ["chunk", "part", "block", "h", "pos", "start", "text"]
    blocks = known.withColumn("chunk", own).withColumn("part", F.lit(0)).select(*columns)
    docs = known.join(sent, "block").withColumn("part", F.lit(1)).select(*columns)
    schema = "block binary, start int, size int" if covers else "a binary, b binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, {}, {}
        for batch in batches:
            out: list[tuple] = []
            for number, part, name, h, pos, start, text in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if number != at:
                    at, held, index = number, {}, {}
                if part == 0:
                    if name not in held:
                        held[name] = Block(start, text)
                        for k, p in zip(h, pos, strict=True):
                            index.setdefault(k, []).append((name, p))
                    continue
                shared: dict[bytes, list[tuple[int, list[int]]]] = {}
                for k, p in zip(h, pos, strict=True):
                    for other, q in index.get(k, ()):
                        if other < name or covers and other != name:
                            mine = shared.setdefault(other, [])
                            if mine and mine[-1][0] == p:
                                mine[-1][1].append(q)
                            else:
                                mine.append((p, [q]))
                doc = Block(start, text)
                if covers:
                    spans = [(a, a + n) for other, mine in shared.items() for a, _, n in factors(doc, held[other], mine, least, gram)]
                    out += [(name, a, b - a) for a, b in merged(spans)]
                else:
                    out += [(name, other) for other, mine in shared.items() if next(factors(doc, held[other], mine, least, gram), None)]
            cols = list(zip(*out, strict=True)) or [()] * (3 if covers else 2)
            kinds = [pa.binary(), pa.int32(), pa.int32()] if covers else [pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(cols, kinds, strict=True)], names=["block", "start", "size"] if covers else ["a", "b"])

    return blocks.unionByName(docs).repartitionById(chunks, F.col("chunk")).sortWithinPartitions("chunk", "part").mapInArrow(run, schema)


def contexts(records: DataFrame, kept: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """Survivors with the text around them: as much as a span of ``least`` characters can reach."""
    reach = least - gram
    texts = records.where(F.length("text") >= least).select("rec", "text")
    joined = kept.join(texts, "rec")
    lead = F.least(F.col("pos"), F.lit(reach))
    return joined.select("block", "pos", lead.alias("lead"), F.substring("text", F.col("pos") - lead + 1, lead + gram + reach).alias("around"))


def crowds(crowded: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Spans (block, start, size) and pairs (a, b), a > b, of texts at crowded anchors, by whole windows.

    Equal surroundings are one class before windows are made of them; sets of texts that
    share a window count once before pairs are made.
    """
    classed = crowded.select("block", (F.col("pos") - F.col("lead")).alias("at"), F.unhex(F.md5(F.encode("around", "UTF-8"))).alias("class"), "around").distinct()
    last = F.length("around") - least
    windows = classed.groupBy("class").agg(F.any_value("around").alias("around")).where(last >= 0).select("class", "around", F.explode(F.sequence(F.lit(0), last)).alias("o"))
    key = F.unhex(F.md5(F.encode(F.substring("around", F.col("o") + 1, F.lit(least)), "UTF-8")))
    held = windows.select("class", "o", key.alias("w"))
    texts = classed.groupBy("class").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    common = held.join(texts, "class").groupBy("w").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("w")
    shared = held.join(common, "w").join(classed.select("class", "block", "at"), "class").select("w", "block", (F.col("at") + F.col("o")).alias("start")).distinct()
    sets = shared.select("w", "block").distinct().groupBy("w").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("block")).alias("x"), F.sum(F.xxhash64("block").cast("decimal(30,0)")).alias("s"))
    first = sets.groupBy("n", "x", "s").agg(F.min("w").alias("w")).select("w")
    few = shared.select("w", "block").distinct().join(first, "w")
    pairs = few.withColumnRenamed("block", "a").join(few.withColumnRenamed("block", "b"), "w").where("a > b").select("a", "b")
    return shared.select("block", "start", F.lit(least).alias("size")), pairs


def shared(records: DataFrame, covers: bool, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD, chunk: int = CHUNK) -> DataFrame:
    """Pairs (a, b) of texts that share at least ``least`` characters; or, covers, the spans (block, start, size)."""
    kept = materialise(survivors(materialise(index(records, least, gram), "anchors")), "survivors")
    few = kept.where(F.col("n") <= crowd)
    found = parse(materialise(regions(records, few, least, gram), "regions"), covers, least, gram, chunk)
    many = kept.where(F.col("n") > crowd)
    if many.isEmpty():
        return found
    spans, pairs = crowds(contexts(records, many, least, gram), least)
    return found.unionByName(spans if covers else pairs)


def members(records: DataFrame, least: int = LEAST) -> DataFrame:
    """(block, rec) of every record, once."""
    return records.where(F.length("text") >= least).select(F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("block"), "rec").distinct()


def pairs(records: DataFrame, least: int = LEAST) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b, of all records that share a span, copies included."""
    between = shared(records, False, least)
    own = members(records, least)
    across = between.distinct().join(own.select(F.col("block").alias("a"), F.col("rec").alias("x")), "a").join(own.select(F.col("block").alias("b"), F.col("rec").alias("y")), "b").select("x", "y")
    copies = own.select("block", F.col("rec").alias("x")).join(own.select("block", F.col("rec").alias("y")), "block").where("x < y").select("x", "y")
    return across.unionByName(copies).select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b")).where("rec_a < rec_b").distinct()


def coverage(records: DataFrame, least: int = LEAST) -> DataFrame:
    """(rec, n_chars, shared_chars, share): how much of each record occurs in another one; records that share nothing have 0."""
    spans = shared(records, True, least)
    own = members(records, least)
    copied = own.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block", F.lit(True).alias("copied"))
    reach = F.max(F.col("start") + F.col("size"))
    order = Window.partitionBy("block").orderBy("start", "end")
    ends = spans.groupBy("block", "start").agg(reach.alias("end"))
    open_at = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = ends.select("block", F.greatest(F.col("end") - F.greatest("start", open_at), F.lit(0)).alias("fresh"))
    total = fresh.groupBy("block").agg(F.sum("fresh").alias("part"))
    sizes = records.where("length(text) > 0").select("rec", F.length("text").cast("bigint").alias("n_chars"), F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("block")).distinct()
    joined = sizes.join(total, "block", "left").join(copied, "block", "left")
    amount: Column = F.when(F.coalesce("copied", F.lit(False)), F.col("n_chars")).otherwise(F.coalesce("part", F.lit(0)))
    return joined.select("rec", "n_chars", amount.cast("bigint").alias("shared_chars"), F.round(amount / F.col("n_chars"), 6).alias("share"))
