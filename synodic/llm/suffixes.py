"""Suffix-array dedup: remove bytes of 50-byte strings that start in a document with a smaller id too.

Method: suffixes are sorted by a mergesort whose comparisons find the common extension of two suffixes
by binary search over prefix polynomial hashes; neighbours that agree over the whole length, checked
byte for byte, form a class, and a class belongs to its smallest document.

Only what could repeat is sorted. A string of 50 bytes is keyed by the smallest hash of the 20-byte
grams in it, so equal strings have equal keys; strings that follow each other with one key are a run.
Runs meet by key in one exchange, after each task has merged its equal ones. Runs equal as a whole
(two independent hashes of all their bytes, 96 bits, beside the 64 bits of the key) are one class, that
the smallest document represents; all others of the class are covered. Where a key has several classes
of several documents, the bytes of the representatives are fetched and their suffixes sorted.

A key with very many classes in one task of the first exchange is crowded: its runs meet by class
instead, and its representatives are sorted in pieces of four strings, keyed by the 47 bytes these have
in common, so that no key gathers a crowd in one task. The result is the same for any ``crowd``.

Null texts count as empty; texts may be of any length (one text is in memory at a time, about 40 bytes
for each of its own). Rows with a null id keep all bytes and cover nothing. Rows with one id are one
document and do not cover each other; ids are cast to long. Ties do not arise: a class goes to the
smallest id. Matches never cross documents; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, RADIX, byte_slices, record, released, splitmix, written

GRAM = 20
PIECE = 4
PLACE = (1 << 36) - 1
OTHER_VALUES = splitmix(BYTE_VALUES ^ np.uint64(0x5851F42D4C957F2D))
OTHER_RADIX = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class SuffixConfig:
    """``crowd`` classes of a key in one task make it crowded; ``buffer`` runs are merged at once; a bucket holds about ``bucket_bytes`` of text."""

    length: int = 50
    crowd: int = 32
    buffer: int = 600_000
    bucket_bytes: int = 4 << 20


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(RADIX), n, 1 << 64))


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of the ``size`` values from each place on, put together from powers of two."""
    parts, have, at = [], values, 1
    out, done = None, 0
    while True:
        if size & at:
            parts.append((at, have))
        at *= 2
        if at > size:
            break
        half = at // 2
        have = have[: len(have) - half] * power(half) + have[half:]
    n = len(values) - size + 1
    for length, h in reversed(parts):
        piece = h[done : done + n]
        out = piece.copy() if out is None else out * power(length) + piece
        done += length
    return out


class Prefixes:
    """Prefix polynomial hashes of bytes: the hash of any stretch in one step."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES, radix: np.uint64 = RADIX):
        n = len(data)
        self.up = np.full(n + 1, radix, dtype=np.uint64)
        self.up[0] = 1
        self.up = np.multiply.accumulate(self.up)
        # hash of data[i:j] times up[n - i] is the same wherever the stretch stands in arrays of one size
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[data] * self.up[:n], dtype=np.uint64)))

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.prefix[j] - self.prefix[i]) * self.up[len(self.up) - 1 - i]


INVERSES: dict = {}


def inverse_powers(n: int, radix: np.uint64) -> np.ndarray:
    """Powers of the inverse of an odd radix; the longest so far is kept."""
    got = INVERSES.get(int(radix))
    if got is None or len(got) < n + 1:
        got = np.full(max(n + 1, 1 << 17), pow(int(radix), -1, 1 << 64), dtype=np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if len(got) <= 1 << 21:
            INVERSES[int(radix)] = got
    return got


def stretch_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, values: np.ndarray, radix: np.uint64) -> np.ndarray:
    """Hashes of stretches of bytes that do not depend on where they stand."""
    n = len(data)
    up = np.full(n + 1, radix, dtype=np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[:n], out=prefix[1:])
    return splitmix((prefix[end] - prefix[begin]) * inverse_powers(n, radix)[begin] + (end - begin).astype(np.uint64))


@dataclass
class Runs:
    """Runs of a slice: key, document row, first string (in the document), number of strings, two hashes of all bytes."""

    key: np.ndarray
    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    whole: np.ndarray
    check: np.ndarray


def runs_of(raw: list[bytes], length: int) -> Runs | None:
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.cumsum(sizes)
    if not len(sizes) or sizes.max() < length:
        return None
    grams = splitmix(gram_hashes(BYTE_VALUES[data], GRAM))
    # smallest gram of each string by doubling
    span, low, at = length - GRAM + 1, grams, 1
    while 2 * at <= span:
        low = np.minimum(low[: len(low) - at], low[at:])
        at *= 2
    n = len(grams) - span + 1
    low = np.minimum(low[:n], low[span - at :][:n])
    ok = np.ones(n, dtype=bool)
    for e in ends[:-1].tolist():
        ok[max(0, e - length + 1) : e] = False
    place = np.flatnonzero(ok)
    if not len(place):
        return None
    key = low[place]
    first = np.concatenate(([True], (key[1:] != key[:-1]) | (np.diff(place) != 1)))
    at = place[first]
    count = np.diff(np.append(np.flatnonzero(first), len(place)))
    row = np.searchsorted(ends, at, side="right")
    end = at + count + length - 1
    whole = stretch_hashes(data, at, end, BYTE_VALUES, RADIX)
    check = stretch_hashes(data, at, end, OTHER_VALUES, OTHER_RADIX).astype(np.uint32)
    return Runs(key[first], row, at - (ends - sizes)[row], count, whole, check)


def mark_of(raw: bytes) -> int:
    """What a place carries above its 36 bits, so that rows with one id are told apart."""
    return (zlib.crc32(raw) & 0x7FFFFFF) << 36


COLUMNS = (("doc", np.int64), ("place", np.int64), ("count", np.int32), ("flag", np.int8), ("check", np.uint32), ("key", np.uint64), ("whole", np.uint64))


def blob_of(t: dict[str, np.ndarray]) -> bytes:
    """Rows as bytes, column by column, bytes of like weight together so that they compress."""
    return b"".join(np.ascontiguousarray(t[c].astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes() for c, kind in COLUMNS)


def from_blob(raw: bytes) -> dict[str, np.ndarray]:
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for _, k in COLUMNS), 0, {}
    for c, kind in COLUMNS:
        size = np.dtype(kind).itemsize
        out[c] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()
        at += n * size
    return out


def taken(t: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {c: v[at] for c, v in t.items()}


def together(parts: list[dict]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def repeated(key: np.ndarray) -> np.ndarray:
    """Places of rows whose key another row has, in order of the key."""
    by = np.argsort(key, kind="stable")
    k = key[by]
    same = np.concatenate(([False], k[1:] == k[:-1], [False]))
    return by[same[1:] | same[:-1]]


def classes(t: dict[str, np.ndarray]) -> tuple[dict, np.ndarray, np.ndarray]:
    """The rows by key and class, the smallest document and place first; where a class begins; the first row of each row's class."""
    t = taken(t, np.lexsort((t["place"], t["doc"], t["check"], t["whole"], t["key"])))
    new = np.ones(len(t["key"]), dtype=bool)
    new[1:] = (t["key"][1:] != t["key"][:-1]) | (t["whole"][1:] != t["whole"][:-1]) | (t["check"][1:] != t["check"][:-1]) | (t["count"][1:] != t["count"][:-1])
    return t, new, np.flatnonzero(new)[np.cumsum(new) - 1]


# What happens to a document: COVER strings place to place+count; FOLLOW: strings from ``more`` on fare as those from ``place`` on;
# FETCH: the bytes of a run of the key ``more`` are asked for, CROWDED: in pieces.
COVER, FOLLOW, FETCH, CROWDED, TEXT = range(5)
EVENT = "kind int, doc long, place long, count int, more long"


def events(kind: int, doc, place, count, more=None) -> pa.RecordBatch:
    n = len(doc)
    return record(kind=np.full(n, kind, np.int32), doc=doc.astype(np.int64), place=place.astype(np.int64), count=count.astype(np.int32), more=np.zeros(n, np.int64) if more is None else more.astype(np.int64))


def merged(doc: np.ndarray, place: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of strings that touch made one."""
    by = np.lexsort((place, doc))
    doc, place, end = doc[by], place[by], (place + count)[by]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] > end[:-1])
    at = np.flatnonzero(new)
    return doc[at], place[at], (np.maximum.reduceat(end, at) - place[at]) if len(at) else end


def settled(t: dict, new: np.ndarray, first: np.ndarray) -> tuple[pa.RecordBatch | None, pa.RecordBatch | None]:
    """Covered and following runs of classes."""
    over, own = t["doc"] > t["doc"][first], ~new & (t["doc"] == t["doc"][first])
    cover = events(COVER, *merged(t["doc"][over], t["place"][over], t["count"][over].astype(np.int64))) if over.any() else None
    return cover, events(FOLLOW, t["doc"][own], t["place"][first[own]], t["count"][own], t["place"][own]) if own.any() else None


def dealt_runs(docs: DataFrame, bits: int, config: SuffixConfig) -> DataFrame:
    """(bucket, blob, event columns): the distinct runs of each task by bucket of the key, and the events that the task itself can tell."""

    def sent(held: list):
        t = together(held)
        some = repeated(t["key"])
        alone = np.ones(len(t["key"]), dtype=bool)
        alone[some] = False
        parts = [taken(t, np.flatnonzero(alone))]
        route = [parts[0]["key"]]
        if len(some):
            t, new, first = classes(taken(t, some))
            for told in settled(t, new, first):
                if told is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(told.num_rows, dtype=np.int32) % (1 << bits)), pa.nulls(told.num_rows, pa.binary()), *told.columns], names=["bucket", "blob", *told.schema.names])
            t = taken(t, np.flatnonzero(new))
            begin = np.flatnonzero(np.concatenate(([True], t["key"][1:] != t["key"][:-1])))
            size = np.diff(np.append(begin, len(t["key"])))
            crowded = np.repeat(size >= config.crowd, size)
            t["flag"] = crowded.astype(np.int8)
            parts.append(t)
            route.append(np.where(crowded, t["whole"], t["key"]))
            if crowded.any():
                mark = taken(t, begin[size >= config.crowd])
                mark["flag"] = np.full(len(mark["key"]), 2, np.int8)
                parts.append(mark)
                route.append(mark["key"])
        # keys are smallest hashes and so not even
        t, bucket = together(parts), (splitmix(np.concatenate(route)) >> np.uint64(64 - bits)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        t, bucket = taken(t, by), bucket[by]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        blobs = [blob_of({c: v[a:b] for c, v in t.items()}) for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]
        nothing = pa.nulls(len(cuts))
        yield record(bucket=bucket[cuts], blob=pa.array(blobs, pa.binary()), kind=nothing.cast(pa.int32()), doc=nothing.cast(pa.int64()), place=nothing.cast(pa.int64()), count=nothing.cast(pa.int32()), more=nothing.cast(pa.int64()))

    def rows(batches):
        held, n = [], 0
        for batch in batches:
            for part in byte_slices(batch, "text", 1 << 16):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
                runs = runs_of(raw, config.length)
                if runs is None:
                    continue
                mark = np.array([mark_of(r) for r in raw])
                held.append({"doc": part.column("doc_id").to_numpy()[runs.row], "place": runs.start + mark[runs.row], "count": runs.count.astype(np.int32), "flag": np.zeros(len(runs.key), np.int8), "check": runs.check, "key": runs.key, "whole": runs.whole})
                n += len(runs.key)
                if n >= config.buffer:
                    yield from sent(held)
                    held, n = [], 0
        if held:
            yield from sent(held)
        released()

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(rows, f"bucket int, blob binary, {EVENT}")


def met_runs(dealt: DataFrame, config: SuffixConfig) -> DataFrame:
    """Events of all runs, bucket by bucket; what the tasks told passes through."""

    def judged(blobs: list):
        t = together([from_blob(b) for b in blobs])
        keep = t["flag"] == 1
        keep[repeated(t["key"])] = True
        if not keep.any():
            return
        t = taken(t, np.flatnonzero(keep))
        crowded = np.isin(t["key"], t["key"][t["flag"] == 2])
        t["flag"] = np.where(crowded & (t["flag"] == 0), 3, t["flag"])
        t = taken(t, np.flatnonzero(t["flag"] != 2))
        if not len(t["key"]):
            return
        t, new, first = classes(t)
        yield from (told for told in settled(t, new, first) if told is not None)
        t = taken(t, np.flatnonzero(new))
        begin = np.flatnonzero(np.concatenate(([True], t["key"][1:] != t["key"][:-1])))
        size = np.diff(np.append(begin, len(t["key"])))
        several = np.minimum.reduceat(t["doc"], begin) != np.maximum.reduceat(t["doc"], begin)
        many = np.repeat(several & (size >= 16 * config.crowd), size) | (t["flag"] != 0)
        for kind, at in ((FETCH, np.repeat(several, size) & ~many), (CROWDED, many)):
            if at.any():
                yield events(kind, t["doc"][at], t["place"][at], t["count"][at], t["key"][at].view(np.int64))

    def rows(batches):
        held, last = [], None
        for batch in batches:
            told = batch.column("blob").is_null()
            if (passing := batch.filter(told)).num_rows:
                yield passing.select(["kind", "doc", "place", "count", "more"])
            own = batch.filter(pa.array(~told.to_numpy(zero_copy_only=False)))
            for bucket, blob in zip(own.column("bucket").to_pylist(), own.column("blob").to_pylist(), strict=True):
                if bucket != last and held:
                    yield from judged(held)
                    held = []
                last = bucket
                held.append(blob)
        if held:
            yield from judged(held)
        released()

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(rows, EVENT)


def with_texts(docs: DataFrame, told: DataFrame, fn, schema: str) -> DataFrame:
    """fn(ids, raw texts, events of each text) over tasks in which the texts and events of a document meet."""
    nothing = F.lit(None)
    texts = docs.select(F.lit(TEXT).alias("kind"), F.col("doc_id").alias("doc"), nothing.cast("long").alias("place"), nothing.cast("int").alias("count"), nothing.cast("long").alias("more"), "text")
    every = told.select("kind", "doc", "place", "count", "more", nothing.cast("string").alias("text")).unionByName(texts)
    dealt = every.repartition(F.coalesce("doc", F.xxhash64("text"))).sortWithinPartitions("doc", "kind")
    columns = ("kind", "doc", "place", "count", "more")

    def rows(batches):
        carry = None
        for batch in batches:
            for part in byte_slices(batch, "text", 1 << 18):
                kind = part.column("kind").to_numpy()
                ids = part.column("doc")
                some = np.flatnonzero(kind != TEXT)
                t = {c: part.column(c).take(pa.array(some)).to_numpy(zero_copy_only=False) for c in columns}
                t = together([carry, t]) if carry is not None else t
                at = np.flatnonzero(kind == TEXT)
                own = ids.take(pa.array(at))
                raw = [(x or "").encode("utf-8", "surrogatepass") for x in part.column("text").take(pa.array(at)).to_pylist()]
                known = own.is_valid().to_numpy(zero_copy_only=False)
                numbers = own.fill_null(0).to_numpy()
                low, high = np.searchsorted(t["doc"], numbers, "left"), np.searchsorted(t["doc"], numbers, "right")
                mine = []
                for r, ok, a, b in zip(raw, known.tolist(), low.tolist(), high.tolist(), strict=True):
                    mine.append({c: v[a:b] for c, v in t.items()} if ok and b > a else None)
                if len(raw):
                    yield from fn(own, raw, mine)
                last = ids[part.num_rows - 1].as_py()
                carry = {c: v[np.searchsorted(t["doc"], last, "left") :] if last is not None else v[:0] for c, v in t.items()}
        released()

    return dealt.mapInArrow(rows, schema)


def parts_of(data: np.ndarray, begin: np.ndarray, count: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of runs that begin at these places of ``data``: (run, first string, last string, anchor) of their parts, and whether a run has several."""
    size = count + length - 1
    owner = np.repeat(np.arange(len(size)), size)
    off = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    cat = data[begin[owner] + off]
    if len(cat) < GRAM:
        return (np.empty(0, np.int64),) * 5
    grams = splitmix(gram_hashes(BYTE_VALUES[cat], GRAM))
    owner, off = owner[: len(grams)], off[: len(grams)]
    hit = np.flatnonzero((grams == key[owner]) & (off <= (size - GRAM)[owner]))
    run, p = owner[hit], off[hit]
    last = np.minimum(p, count[run] - 1)
    again = np.concatenate(([False], run[1:] == run[:-1])) if len(run) else np.zeros(0, bool)
    first = np.where(again, np.concatenate(([0], last[:-1])) + 1, 0) if len(run) else p
    ok = last >= first
    several = np.bincount(run, minlength=len(size))[run] > 1
    return run[ok], first[ok], last[ok], p[ok], several[ok]


def pieces(key: int, place: int, anchor: int, raw: bytes, length: int):
    """A part by fours of strings: those that begin 4j to 4j+3 before the anchor have 47 bytes in common."""
    for j in range((length - GRAM) // PIECE + 1):
        a, b = max(0, anchor - PIECE * j - PIECE + 1), min(len(raw) - length, anchor - PIECE * j)
        if a <= b:
            common = raw[anchor - PIECE * j : anchor - PIECE * j - PIECE + 1 + length]
            digest = hashlib.blake2b(common, digest_size=8, key=key.to_bytes(8, "little"), salt=bytes((j,))).digest()
            yield int.from_bytes(digest, "little"), place + a, anchor - a, raw[a : b + length]


def run_texts(docs: DataFrame, told: DataFrame, config: SuffixConfig) -> DataFrame:
    """Parts of the runs that were asked for: (kind null, doc, place, anchor as count, key as more, bytes); and events.

    The anchor is where the key's gram stands in the bytes; a run with several such places falls into
    one part for each, of the strings whose first place it is. A part that a document repeats follows the first.
    """
    length = config.length

    def rows(ids, raw, mine):
        some = [k for k, t in enumerate(mine) if t is not None]
        if not some:
            return
        t = together([mine[k] for k in some])
        text = np.repeat(some, [len(mine[k]["kind"]) for k in some])
        marks = np.array([mark_of(r) for r in raw])
        own = (t["kind"] >= FETCH) & (t["place"] & ~PLACE == marks[text])
        t, text = taken(t, np.flatnonzero(own)), text[own]
        if not len(text):
            return
        sizes = np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        begin = (np.cumsum(sizes) - sizes)[text] + (t["place"] & PLACE)
        key = np.ascontiguousarray(t["more"]).view(np.uint64)
        run, first, last, anchor, several = parts_of(data, begin, t["count"].astype(np.int64), key, length)
        doc = ids.to_numpy(zero_copy_only=False)[text[run]]
        crowded = t["kind"][run] == CROWDED
        plain = np.flatnonzero(~crowded & ~several)
        low, size = begin[run[plain]] + first[plain], last[plain] - first[plain] + length
        offsets = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(low - offsets[:-1], size) + np.arange(offsets[-1])
        packed = pa.Array.from_buffers(pa.binary(), len(plain), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes())])
        if len(plain):
            yield record(kind=pa.nulls(len(plain), pa.int32()), doc=doc[plain], place=t["place"][run[plain]] + first[plain], count=(anchor - first)[plain].astype(np.int32), more=key[run[plain]].view(np.int64), bytes=packed)
        out, follow, seen = [], [], {}
        for k in np.flatnonzero(crowded | several).tolist():
            r = int(run[k])
            stretch = data[begin[r] + first[k] : begin[r] + last[k] + length].tobytes()
            part = (int(key[r]), int(t["place"][r] + first[k]), int(anchor[k] - first[k]), stretch)
            for ident, place, pin, b in pieces(*part, length) if crowded[k] else (part,):
                before = seen.setdefault((int(text[r]), ident, pin, b), place)
                if before == place:
                    out.append((int(doc[k]), place, pin, ident, b))
                else:
                    follow.append((int(doc[k]), before, len(b) - length + 1, place))
        if out:
            own_doc, place, pin, ident, b = zip(*out, strict=True)
            yield record(kind=pa.nulls(len(out), pa.int32()), doc=np.array(own_doc), place=np.array(place), count=np.array(pin, np.int32), more=np.array(ident, np.uint64).view(np.int64), bytes=pa.array(b, pa.binary()))
        if follow:
            told = events(FOLLOW, *(np.array(c) for c in zip(*follow, strict=True)))
            yield pa.RecordBatch.from_arrays([*told.columns, pa.nulls(len(follow), pa.binary())], names=[*told.schema.names, "bytes"])

    return with_texts(docs, told, rows, f"{EVENT}, bytes binary")


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str], least: int = 200_000) -> Iterator[dict]:
    """Columns of sorted batches in stretches that hold whole groups of the first column."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.select(columns))
        n += batch.num_rows
        if n >= least:
            table = pa.Table.from_batches(held)
            key = table.column(columns[0]).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield table.slice(0, cut)
                held, n = table.slice(cut).to_batches(), len(key) - cut
    if n:
        yield pa.Table.from_batches(held)


class HashedText:
    """Strings of one size, one after the other, with prefix polynomial hashes: any stretch's hash in one step, common extensions by binary search."""

    def __init__(self, data: np.ndarray, size: int):
        self.data = data
        self.head = np.ascontiguousarray(data.reshape(-1, size)[:, :8]).view(">u8").ravel().astype(np.uint64)
        self.prefixes = Prefixes(data)

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.prefixes.between(i, i + length) == self.prefixes.between(j, j + length)

    def extension(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """Length of the common beginning of the suffixes at i and j, up to ``most``."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), most)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.same(i, j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, most: int, ties: np.ndarray) -> np.ndarray:
        n = self.extension(i, j, most)
        end = n >= most
        k = np.minimum(n, most - 1)
        return np.where(end, ties, self.data[i + k] < self.data[j + k])

    def quick_less(self, i: np.ndarray, j: np.ndarray, most: int, ties: np.ndarray) -> np.ndarray:
        """less() for suffixes at multiples of ``most``: first by eight bytes, then by the whole, then by the common extension."""
        a, b = self.head[i // most], self.head[j // most]
        out = a < b
        rest = np.flatnonzero(a == b)
        if len(rest):
            whole = self.same(i[rest], j[rest], np.int64(most))
            out[rest[whole]] = ties[rest[whole]]
            rest = rest[~whole]
            out[rest] = self.less(i[rest], j[rest], most, ties[rest])
        return out

    def sort(self, at: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
        """Order of suffixes within their groups (which stand together), compared over ``most`` bytes: mergesort, all merges of a level at once."""
        order = np.arange(len(at))
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(first, len(at)))
        base, size = np.repeat(first, size), np.repeat(size, size)
        width = 1
        while (active := np.flatnonzero(size > width)).size:
            own = active - base[active]
            run = own // width
            left = run % 2 == 0
            other = base[active] + np.where(left, run + 1, run - 1) * width
            limit = base[active] + size[active]
            low, high = np.minimum(other, limit), np.minimum(other + width, limit)
            begin = low.copy()
            me = at[order[active]]
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                them = at[order[mid]]
                # a left element goes before equal ones of the right run
                ahead = self.quick_less(them, me[open_], most, ~left[open_])
                low[open_] = np.where(ahead, mid + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], mid)
            target = base[active] + run // 2 * 2 * width + own % width + (low - begin)
            new = order.copy()
            new[target] = order[active]
            order, width = new, 2 * width
        return order


def segments(slots: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``slots`` within their groups by suffix sort, and the common beginning of each with the one before (-1: new group)."""
    n, most = slots.shape
    text = HashedText(slots.ravel(), most)
    at = np.arange(n) * most
    order = text.sort(at, group, most)
    common = np.full(n, -1)
    within = group[order][1:] == group[order][:-1]
    common[1:][within] = text.extension(at[order][1:][within], at[order][:-1][within], most)
    # collision check: what the hashes say must hold byte for byte
    for a in range(1, n, 50_000):
        b = min(n, a + 50_000)
        equal = slots[order[a:b]] == slots[order[a - 1 : b - 1]]
        true = np.where(equal.all(1), most, equal.argmin(1))
        common[a:b] = np.minimum(common[a:b], true)
    return order, common


def sorted_runs(texts: DataFrame, config: SuffixConfig) -> DataFrame:
    """Events of strings of the parts that a smaller document has too.

    Runs of a key are aligned at their anchors. The suffixes from the anchors on, and those that go
    back from them, are sorted; the strings that begin o bytes before the anchors are equal where
    o bytes back and the rest ahead are in common, which cuts both orders into segments.
    """
    length = config.length
    back = length - GRAM + 1

    def rows(batches):
        for table in whole_groups(batches, ["more", "doc", "place", "count", "bytes"], 20_000):
            raw = table.column("bytes").combine_chunks()
            raw = raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw
            key, doc, start, anchor = (table.column(c).to_numpy() for c in ("more", "doc", "place", "count"))
            if len(key) < 2:
                continue
            anchor = anchor.astype(np.int64)
            offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
            data, sizes, begin = np.frombuffer(raw.buffers()[2], np.uint8), np.diff(offsets), offsets[:-1]
            pin, end = begin + anchor, begin + sizes
            ahead = pin[:, None] + np.arange(length)
            behind = pin[:, None] - 1 - np.arange(back - 1)
            right = np.where(ahead < end[:, None], data[np.minimum(ahead, len(data) - 1)], 0).astype(np.uint8)
            left = np.where(behind >= begin[:, None], data[np.maximum(behind, 0)], 0).astype(np.uint8)
            right_order, right_common = segments(right, key)
            left_order, left_common = segments(left, key)
            n = len(key)
            covered = np.zeros((n, back + 2), dtype=np.int8)  # by window: the first begins furthest back
            low, high = anchor - (sizes - length), anchor
            left_class, right_class = np.empty(n, np.int64), np.empty(n, np.int64)
            for o in range(back):
                some = np.flatnonzero((low <= o) & (o <= high))
                if not len(some):
                    continue
                left_class[left_order] = np.cumsum(left_common < o)
                right_class[right_order] = np.cumsum(right_common < length - o)
                _, inverse = np.unique(left_class[some] * (n + 1) + right_class[some], return_inverse=True)
                least = np.full(inverse.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, inverse, doc[some])
                covered[some, back - o] = doc[some] > least[inverse]
            edge = np.diff(covered, axis=1)
            own, first = np.nonzero(edge == 1)
            _, last = np.nonzero(edge == -1)
            # column c + 1 is the window that begins back - c - 1 bytes before the anchor
            if len(own):
                yield events(COVER, doc[own], start[own] + anchor[own] - (back - 1 - first), last - first)
        released()

    return texts.repartition("more").sortWithinPartitions("more").mapInArrow(rows, EVENT)


def buckets_of(docs: DataFrame, config: SuffixConfig) -> int:
    """Bits of the bucket numbers, by the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return min(28, max(4, int(np.ceil(np.log2(total / config.bucket_bytes + 1)))))


def covered(docs: DataFrame, config: SuffixConfig) -> DataFrame:
    """Events COVER and FOLLOW of docs (doc_id, text)."""
    met = written(met_runs(dealt_runs(docs, buckets_of(docs, config), config), config))
    known = docs.filter("doc_id is not null")
    fetched = written(run_texts(known, met.filter(f"kind >= {FETCH}"), config))
    found = written(sorted_runs(fetched.filter("kind is null").select("more", "doc", "place", "count", "bytes"), config))
    return met.filter(f"kind < {FETCH}").unionByName(fetched.filter("kind is not null").drop("bytes")).unionByName(found)


def removed(raw: bytes, t: dict | None, length: int) -> np.ndarray:
    """Which bytes of a text go, by the events of its id."""
    gone = np.zeros(len(raw) + 1, dtype=np.int64)
    if t is None or len(raw) < length:
        return gone[:-1] > 0
    mark, strings = mark_of(raw), {}
    cover, follow = t["kind"] == COVER, np.flatnonzero(t["kind"] == FOLLOW)

    def of(other: int) -> np.ndarray:
        """Covered strings of the row of this id with this mark."""
        if other not in strings:
            own = cover & (t["place"] & ~PLACE == other)
            place = t["place"][own] & PLACE
            end = place + t["count"][own]
            most = max(((t[c][follow] & PLACE) + t["count"][follow]).max(initial=0) for c in ("place", "more"))
            edge = np.zeros(max(len(raw), int(end.max(initial=0)), int(most)) + 2, dtype=np.int64)
            np.add.at(edge, place, 1)
            np.add.at(edge, end, -1)
            strings[other] = np.cumsum(edge) > 0
        return strings[other]

    own = of(mark)
    # what is followed may follow in turn
    todo, changed = list(zip(*(t[c][follow].tolist() for c in ("place", "count", "more")), strict=True)), bool(len(follow))
    while changed:
        changed = False
        for source, n, to in todo:
            stretch = of(source & ~PLACE)[source & PLACE : (source & PLACE) + n]
            target = of(to & ~PLACE)[to & PLACE : (to & PLACE) + n]
            if (stretch & ~target).any():
                target |= stretch
                changed = True
    at = np.flatnonzero(own[: len(raw) - length + 1])
    np.add.at(gone, at, 1)
    np.add.at(gone, at + length, -1)
    return np.cumsum(gone)[:-1] > 0


def dedup(docs: DataFrame, config: SuffixConfig = SuffixConfig(), doc_id="doc_id", text="text", digest: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, and kept_sha256 or the kept text (bytes, as UTF-8 may be cut)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    what = "kept_sha256 string" if digest else "kept binary"
    length = config.length

    def rows(ids, raw, mine):
        gone = [removed(r, t, length) for r, t in zip(raw, mine, strict=True)]
        kept = [np.frombuffer(r, np.uint8)[~g].tobytes() if g.any() else r for r, g in zip(raw, gone, strict=True)]
        last = {"kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]} if digest else {"kept": pa.array(kept, pa.binary())}
        yield record(doc_id=ids, n_bytes=[len(r) for r in raw], n_removed=[int(g.sum()) for g in gone], n_spans=[int((np.diff(g.astype(np.int8), prepend=0) == 1).sum()) for g in gone], **last)

    return with_texts(docs, covered(docs, config), rows, f"doc_id long, n_bytes long, n_removed long, n_spans long, {what}")
