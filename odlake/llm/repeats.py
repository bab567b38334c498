"""Repeated passages over all documents, whichever two documents they are in.

A passage is a window of `Kind.window` units (bytes or words). A window is routed by its anchor, the
least hash of the short strings in it, so equal windows meet and one window's neighbours mostly share
its anchor: a segment is a run of windows of one anchor, and few rows stand for a whole text.

1. Every document's segments are found (in numpy, a few MB at a time). Equal segments of one part are
   combined at once; only the first goes on, the others' spans are already known to be repeated.
2. Per bucket of anchors, equal segments leave their first; anchors left with one segment, in which no
   window can come twice, are done.
3. What is left fetches its text from the documents, dealt by document.
4. Per bucket of anchors, a matcher finds the windows that also start earlier in another segment.
5. Spans join their documents and are cut out.

An anchor that very many windows share would fill one task. A sample of documents tells which anchors
are that frequent, by a table of `CELLS` bits that anchors are hashed to (so what is sent to tasks has
one size, and an anchor that shares a frequent one's cell is only taken for frequent, too); windows under
them take the least hash of longer strings in their place, up to whole windows, which are combined like
equal segments. The sample only routes: any choice of frequent anchors gives the same result, as equal
windows are always routed alike. Rows travel packed, as arrays of a batch and bucket.

The order of documents is by doc_id, then (of one id with different texts) by text hash; a null doc_id
comes last. Texts are dealt by id and text hash, so those of one id, or of none, are spread. Rows repeated
whole are worked on once, and repeated in the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odlake.session import ship

from .common import buckets, cut, frugal, frugal_groups, frugal_pairs, parts_of, utf8

#: Bytes of text whose equal segments are combined before they are shuffled.
TOGETHER = 8_000_000
#: Units whose windows are hashed at a time: some thirty arrays of as many 64-bit numbers are held.
AT_ONCE = 1 << 17
#: Windows in a segment at most; only bounds its size.
RUN = 256
#: Estimated segments under an anchor from which its windows are routed by longer strings; documents in this part of the sample.
FREQUENT, SAMPLED = 4096, 32
#: log2 of the bits of the table of frequent anchors.
CELLS = 22
#: Equal rows that one row of the result is repeated to at a time.
COPIES = 1000
NULL_ID = (1 << 63) - 1
PACKED = "kind int, bucket int, n long, units long, payload binary"
SEGMENT, SPAN, NEED, PIECE = range(4)
FIELDS = {SEGMENT: ("<i8", "<i8", "<i8", "<i8", "<i4", "<i4", "<i1"), SPAN: ("<i8", "<i8", "<i4", "<i4"), NEED: ("<i8", "<i8", "<i8", "<i4", "<i4"), PIECE: ("<i8", "<i8", "<i4", "<i4")}
ODD = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Kind:
    """What the units of texts are: units(texts) gives an array for each; match(text, remaining) flags the repeated windows' starts."""

    window: int
    levels: tuple[int, ...]  # lengths of the strings that route a window, up to the window itself
    units: Callable[[list[bytes]], list[np.ndarray]]
    dtype: str
    match: Callable[[np.ndarray, np.ndarray], np.ndarray]
    keep: Callable[[bytes, np.ndarray, np.ndarray], tuple[int, bytes]]  # text, spans' starts and ends: number of units, what is left


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def strings(codes: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length, the hash of the string that begins at each place: by doubling, then by the bits of the length."""
    power, doubled = 1, {1: codes}
    while power * 2 <= max(lengths):
        h = doubled[power]
        doubled[power * 2] = h[:-power] * np.uint64(pow(ODD, power, 1 << 64)) + h[power:] if len(h) > power else h[:0]
        power *= 2
    made = []
    for n in lengths:
        h, done = None, 0
        for p in sorted((p for p in doubled if n & p), reverse=True):
            if h is None:
                h = doubled[p]
            else:
                m = max(0, len(codes) - done - p + 1)
                h = h[:m] * np.uint64(pow(ODD, p, 1 << 64)) + doubled[p][done : done + m]
            done += p
        made.append(mixed(h))
    return made


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n = 1
    while n * 2 <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if n < width else h


def cells(anchors: np.ndarray) -> np.ndarray:
    return (anchors * np.uint64(ODD) >> np.uint64(64 - CELLS)).astype(np.int64)


def segments(kind: Kind, codes: np.ndarray, ends: np.ndarray, frequent: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """anchor, content hash, start, windows, and whether the anchor may stand in it twice, of each segment of joined documents; ends: of its document, for each unit."""
    n = len(codes) - kind.window + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    used = kind.levels[: 1 + max([0, *(k + 1 for k, f in enumerate(frequent) if len(f))])]
    anchor = deep = None
    for level, (length, h) in enumerate(zip(used, strings(codes, used))):
        found = least(h, kind.window - length + 1) + np.uint64(level)
        if anchor is None:
            anchor, shortest = found, h
        else:
            anchor = np.where(again, found, anchor)
        if level < len(frequent):
            again = frequent[level][cells(anchor)]
            deep = again if level == 0 else deep
            if not again.any():
                break
    place = np.arange(n)
    valid = ends[:n] - place >= kind.window
    fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (ends[1:n] != ends[: n - 1])]
    first = np.flatnonzero(fresh)
    size = np.diff(np.r_[first, n])
    start = np.flatnonzero((place - np.repeat(first, size)) % RUN == 0)
    windows = np.diff(np.r_[start, n])
    last = np.minimum(windows, ends[start] - kind.window - start + 1)  # of the run, those inside the document
    ok = valid[start]
    start, windows = start[ok], last[ok]
    # places that are the least of some window: those equal to the greatest of the windows' least values over them
    width = kind.window - used[0] + 1
    none = np.full(width - 1, ~np.uint64(0))
    tops = np.flatnonzero(least(np.r_[none, ~(anchor if deep is None or not deep.any() else least(shortest, width)), none], width) == ~shortest)
    same = np.cumsum(np.r_[0, shortest[tops[1:]] == shortest[tops[:-1]]])
    low = np.minimum(np.searchsorted(tops, start), len(tops) - 1)
    twice = same[np.maximum(low, np.searchsorted(tops, start + windows + width - 1) - 1)] > same[low]
    if deep is not None:
        twice |= deep[start] & (windows > 1)  # they need not share the shortest string
    powers, inverse = ladder(len(codes) + 1)
    total = np.r_[np.uint64(0), np.cumsum(mixed(codes) * powers[: len(codes)])]
    stop = start + windows + kind.window - 1
    content = mixed((total[stop] - total[start]) * inverse[start] + windows.astype(np.uint64) * np.uint64(ODD))
    return mixed(anchor[start]).view(np.int64), content.view(np.int64), start, windows, twice


_LADDER: list[np.ndarray] = []


def ladder(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if not _LADDER or len(_LADDER[0]) < n:
        base = 0xD6E8FEB86659FD93
        _LADDER[:] = [np.cumprod(np.r_[np.uint64(1), np.full(max(n, 2 * AT_ONCE), b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64))]
    return _LADDER[0], _LADDER[1]


def chunks(kind: Kind, units: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined documents of about AT_ONCE units: units, each unit's document's end, and each part's document and offset. A long document comes in parts that overlap by a window less one."""
    parts, total = [], 0
    table = codes_of_bytes() if kind.dtype == "<u1" else None

    def joined():
        data = np.concatenate([units[d][a:b] for d, a, b in parts])
        sizes = np.array([b - a for _, a, b in parts])
        stops = np.cumsum(sizes)
        return (table[data] if table is not None else data), np.repeat(stops, sizes), np.array([d for d, _, _ in parts]), np.array([a for _, a, _ in parts]), stops - sizes

    for d, u in enumerate(units):
        for a in range(0, max(1, len(u) - kind.window + 1), AT_ONCE):
            b = min(len(u), a + AT_ONCE + kind.window - 1)
            if b - a < kind.window:
                continue
            parts.append((d, a, b))
            total += b - a
            if total >= AT_ONCE:
                yield joined()
                parts, total = [], 0
    if parts:
        yield joined()


def codes_of_bytes() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def packed(kind: int, bucket: np.ndarray, columns: list[np.ndarray], units: np.ndarray | None = None) -> list[tuple]:
    """A row for each bucket, with its part of the columns as one payload."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order].astype(t) for c, t in zip(columns, FIELDS[kind], strict=True)]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    weight = np.add.reduceat(units[order], at) if units is not None else np.zeros(len(at), np.int64)
    return [(kind, int(bucket[a]), int(b - a), int(w), b"".join(c[a:b].tobytes() for c in columns)) for a, b, w in zip(at, np.r_[at[1:], len(bucket)], weight)]


def unpacked(rows: pa.Table, kind: int) -> list[np.ndarray]:
    """The columns of all payloads of a kind."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in FIELDS[kind]]
    for k, n, data in zip(rows["kind"].to_pylist(), rows["n"].to_pylist(), rows["payload"]):
        if k == kind:
            buffer, at = data.as_buffer(), 0
            for column, t in zip(parts, FIELDS[kind]):
                column.append(np.frombuffer(buffer, t, n, at))
                at += n * np.dtype(t).itemsize
    return [np.concatenate(c) for c in parts]


def as_rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["kind", "bucket", "n", "units", "payload"])


def of_batch(kind: Kind, ids: np.ndarray, subs: np.ndarray, texts: list[bytes], frequent: list[np.ndarray]) -> list[np.ndarray]:
    """anchor, content, doc_id, sub, start, windows, twice of a batch's segments, by document and start."""
    order = np.lexsort((subs, ids))
    units = kind.units([texts[k] for k in order])
    found: list[list[np.ndarray]] = [[] for _ in range(7)]
    for codes, ends, docs, offsets, starts in chunks(kind, units):
        anchor, content, start, windows, twice = segments(kind, codes, ends, frequent)
        part = np.searchsorted(starts, start, "right") - 1
        doc = order[docs[part]]
        for column, x in zip(found, (anchor, content, ids[doc], subs[doc], start - starts[part] + offsets[part], windows, twice)):
            column.append(x)
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in found]


def firsts(columns: list[np.ndarray], by_document: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Segments by anchor and content, once a place; whether each is the first of its content, and of its anchor."""
    anchor, content, doc, sub, start, *_ = columns
    order = np.lexsort((content, anchor)) if by_document else np.lexsort((start, sub, doc, content, anchor))
    columns = [c[order] for c in columns]
    anchor, content, doc, sub, start, *_ = columns
    differs = [np.r_[True, c[1:] != c[:-1]] if len(c) else np.zeros(0, bool) for c in (anchor, content, doc, sub, start)]
    keep = np.logical_or.reduce(differs)
    new_anchor = differs[0][keep]
    return [c[keep] for c in columns], new_anchor | differs[1][keep], new_anchor


def spans_of(kind: Kind, columns: list[np.ndarray], which: np.ndarray) -> list[np.ndarray]:
    _, _, doc, sub, start, windows, _ = (c[which] for c in columns)
    return [doc, sub, start, windows + kind.window - 1]


def keyed(docs: DataFrame, text: str) -> tuple[DataFrame, int, bool]:
    """doc_id, key (never null), sub (tells the texts of one id apart, and orders them), text as bytes, n (rows that are alike); the bytes of all texts; and whether an id is repeated."""
    keys = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"), utf8(text).alias("text"))
    each = keys.select("key", F.octet_length("text").alias("size")).groupBy("key").agg(F.count("*").alias("rows"), F.sum("size").alias("size"))
    total, most = each.agg(F.sum("size"), F.max("rows")).first()
    if (most or 1) == 1:
        return keys.withColumn("sub", F.lit(0).cast("long")).withColumn("n", F.lit(1).cast("long")), total or 0, False
    subs = keys.withColumn("sub", F.xxhash64("text"))
    return subs.groupBy("key", "sub").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("n")).select("doc_id", "key", "text", "sub", "n"), total, True


def dealt_to(key: np.ndarray, sub: np.ndarray, parts: int) -> np.ndarray:
    return (key ^ sub ^ sub >> 17) % parts


def frequent_anchors(docs: DataFrame, kind: Kind) -> list[np.ndarray]:
    """For each level but the last, the bits (packed) of the anchors under which a sample of documents has very many segments."""
    sample = docs.where(F.pmod(F.xxhash64("key", "sub"), F.lit(SAMPLED)) == 0).select("key", "sub", "text")
    found: list[np.ndarray] = []
    for _ in kind.levels[:-1]:

        def run(batches, known=tuple(found)):
            bits = [np.unpackbits(f).astype(bool) for f in known]
            for batch in batches:
                seen = []
                for part in parts_of(batch, 2, TOGETHER):
                    for codes, ends, *_ in chunks(kind, kind.units(part.column(2).to_pylist())):
                        seen.append(cells(raw_anchors(kind, codes, ends, bits)))
                cell, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n, pa.int64())], ["cell", "n"])

        counts = cut(sample.mapInArrow(frugal(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")))
        mean = (counts.agg(F.sum("n")).first()[0] or 0) >> CELLS
        bits = np.zeros(1 << CELLS, bool)
        for (cell,) in counts.where(F.col("n") >= max(2, FREQUENT // SAMPLED, 8 * mean)).select("cell").toLocalIterator():  # of at most 2**CELLS rows
            bits[cell] = True
        if not bits.any():
            break
        found.append(np.packbits(bits))
    return found


def raw_anchors(kind: Kind, codes: np.ndarray, ends: np.ndarray, frequent: list[np.ndarray]) -> np.ndarray:
    """The anchors of the segments at the level after `frequent`, of windows that are frequent at all levels before."""
    n, level = len(codes) - kind.window + 1, len(frequent)
    again, found = ends[:n] - np.arange(n) >= kind.window, None
    for k, h in enumerate(strings(codes, kind.levels[: level + 1])):
        found = least(h, kind.window - kind.levels[k] + 1) + np.uint64(k)
        if k < level:
            again &= frequent[k][cells(found)]
    fresh = np.r_[True, (found[1:] != found[:-1]) | (ends[1:n] != ends[: n - 1])]
    return found[again & fresh]


def without_repeats(docs: DataFrame, kind: Kind, text: str = "text") -> DataFrame:
    """doc_id, n_units, n_removed, n_spans (maximal removed runs), kept (what is left of the text, as bytes), spans (start and end of each)."""
    spark = docs.sparkSession
    ship(spark)
    docs, size, repeated = keyed(docs, text)
    unit = 1 if kind.dtype == "<u1" else 6
    by_anchor = buckets(spark, size // unit // (kind.window // 3), 200_000)
    by_doc = buckets(spark, size, 8_000_000) | 1
    while any(by_doc % k == 0 for k in range(3, int(math.isqrt(by_doc)) + 1, 2)):
        by_doc += 2
    frequent = frequent_anchors(docs, kind)

    def find(batches):
        bits = [np.unpackbits(f).astype(bool) for f in frequent]
        for batch in batches:
            for part in parts_of(batch, 2, TOGETHER):
                columns = of_batch(kind, part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_pylist(), bits)
                columns, first, _ = firsts(columns, True)
                rows = packed(SEGMENT, columns[0][first] % by_anchor, [c[first] for c in columns])
                known = spans_of(kind, columns, ~first)
                yield from as_rows(rows + packed(SPAN, known[0] % by_anchor, known)).to_batches()

    def settle(rows: pa.Table) -> pa.Table:
        columns, first, new_anchor = firsts(unpacked(rows, SEGMENT), False)
        anchor = np.cumsum(new_anchor) - 1
        several = np.bincount(anchor[first], minlength=1)[anchor] > 1 if len(anchor) else first
        spans = [np.concatenate(x) for x in zip(spans_of(kind, columns, ~first), unpacked(rows, SPAN))]
        left = first & (several | (columns[6] > 0))
        need = [columns[k][left] for k in (0, 2, 3, 4, 5)]
        return as_rows(packed(SPAN, dealt_to(spans[0], spans[1], by_doc), spans) + packed(NEED, dealt_to(need[1], need[2], by_doc), need, need[4] + kind.window - 1))

    found = docs.select("key", "sub", "text").mapInArrow(frugal(find), PACKED)
    settled = cut(found.groupBy("bucket").applyInArrow(frugal_groups(settle), PACKED))
    needed = settled.where(F.col("kind") == NEED).agg(F.sum("units")).first()[0] or 0
    by_piece = buckets(spark, needed, 1_000_000 if kind.dtype == "<u1" else 150_000)

    def fetch(texts: pa.Table, rows: pa.Table) -> pa.Table:
        anchor, doc, sub, start, windows = unpacked(rows, NEED)
        if not len(doc):
            return as_rows([])
        order = np.lexsort((start, sub, doc))
        anchor, doc, sub, start, windows = (c[order] for c in (anchor, doc, sub, start, windows))
        wanted, ids, subs = set(zip(doc.tolist(), sub.tolist())), texts["key"].to_pylist(), texts["sub"].to_pylist()
        at = {key: k for k, key in enumerate(zip(ids, subs)) if key in wanted}
        units = dict(zip(at, kind.units([texts["text"][k].as_py() for k in at.values()])))
        length = windows + kind.window - 1
        data = [units[d, s][a : a + n] for d, s, a, n in zip(doc.tolist(), sub.tolist(), start.tolist(), length.tolist())]
        rows, bucket = [], anchor % by_piece
        for b in np.unique(bucket):
            which = np.flatnonzero(bucket == b)
            (row,) = packed(PIECE, bucket[which], [doc[which], sub[which], start[which], length[which]], length[which])
            rows.append((*row[:4], row[4] + np.concatenate([data[k] for k in which]).astype(kind.dtype).tobytes()))
        return as_rows(rows)

    def compare(rows: pa.Table) -> pa.Table:
        doc, sub, start, length = unpacked(rows, PIECE)
        data = []
        for n, payload in zip(rows["n"].to_pylist(), rows["payload"]):
            data.append(np.frombuffer(payload.as_buffer(), kind.dtype, offset=n * sum(np.dtype(t).itemsize for t in FIELDS[PIECE])))
        data, before = np.concatenate(data), np.cumsum(length) - length
        order = np.lexsort((start, sub, doc))  # so that places are in the order of documents
        doc, sub, start, length, before = (c[order] for c in (doc, sub, start, length, before))
        stop = np.cumsum(length)
        place = np.arange(stop[-1]) - np.repeat(stop - length, length) + np.repeat(before, length)
        remaining = np.repeat(stop, length) - np.arange(stop[-1])
        flagged = kind.match(data[place], remaining)
        begins = np.flatnonzero(flagged & ~np.r_[False, flagged[:-1] & (remaining[:-1] > 1)])
        ends = np.flatnonzero(flagged & ~np.r_[flagged[1:] & (remaining[:-1] > 1), False]) + 1
        of = np.searchsorted(stop, begins, "right")
        spans = [doc[of], sub[of], start[of] + begins - (stop - length)[of], ends - begins + kind.window - 1]
        return as_rows(packed(SPAN, dealt_to(spans[0], spans[1], by_doc), spans))

    def remove(texts: pa.Table, rows: pa.Table) -> pa.Table:
        doc, sub, start, length = unpacked(rows, SPAN)
        order = np.lexsort((start, sub, doc))
        doc, sub, start, stop = doc[order], sub[order], start[order].astype(np.int64), (start + length)[order].astype(np.int64)
        head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])]) if len(doc) else np.zeros(0, np.int64)
        at = {key: (a, b) for key, a, b in zip(zip(doc[head].tolist(), sub[head].tolist()), head.tolist(), [*head[1:].tolist(), len(doc)])}
        made = []
        for d, s, value in zip(texts["key"].to_pylist(), texts["sub"].to_pylist(), texts["text"]):
            a, b = at.get((d, s), (0, 0))
            begins, ends = start[a:b], np.maximum.accumulate(stop[a:b])
            apart = np.r_[True, begins[1:] > ends[:-1]] if a < b else np.zeros(0, bool)
            begins, ends = begins[apart], ends[np.r_[apart[1:], True]] if a < b else ends
            n, kept = kind.keep(value.as_py(), begins, ends)
            made.append((n, int((ends - begins).sum()), len(begins), kept, np.stack([begins, ends], 1).tolist()))
        columns = list(zip(*made)) if made else [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64())))
        return pa.table([texts["doc_id"], *(pa.array(c, t) for c, t in zip(columns, types)), texts["n"]], names=["doc_id", "n_units", "n_removed", "n_spans", "kept", "spans", "n"])

    deal = F.col("key").bitwiseXOR(F.col("sub")).bitwiseXOR(F.shiftright("sub", 17))  # as dealt_to
    dealt = docs.select(F.pmod(deal, F.lit(by_doc)).cast("int").alias("bucket"), "doc_id", "key", "sub", "n", "text")
    needs, spans = settled.where(F.col("kind") == NEED), settled.where(F.col("kind") == SPAN)
    pieces = dealt.groupBy("bucket").cogroup(needs.groupBy("bucket")).applyInArrow(frugal_pairs(fetch), PACKED)
    spans = spans.union(pieces.groupBy("bucket").applyInArrow(frugal_groups(compare), PACKED))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = dealt.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(frugal_pairs(remove), f"doc_id {id_type}, n_units long, n_removed long, n_spans long, kept binary, spans array<array<long>>, n long")
    if not repeated:
        return made.drop("n")
    columns = [c for c in made.columns if c != "n"]
    some = made.select(*columns, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))).alias("part")).repartition(by_doc)
    return some.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES))).alias("part")).drop("part")
