"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte is removed if a string of ``WIDTH`` bytes covers it that also starts in a document with a
smaller id.  Strings are judged on the input; they don't cross documents.

1. *Anchors.*  Every string of ``WIDTH`` bytes holds the lowest hash of its ``GRAM``-byte grams.
   These minimisers (one in 14 bytes) meet in one shuffle of packed hashes and ids; only those
   that stand in two documents or more go on.  This loses no repeated string.
2. *Segments.*  Around a shared minimiser, the bytes that its strings can cover form a segment.
   Equal segments are kept once, with their smallest document; the other documents that hold
   the same segment in the same task are settled there, so a passage with thousands of copies
   sends one segment a task.
3. *Merging.*  Segments of one bucket of hashes that share a minimiser with a different segment
   are split into shards.  Each shard gets its Burrows-Wheeler transform by sorting.  The
   transforms are merged by interleave refinement: the interleave that is right for the first k
   symbols gives, by one stable distribution on the preceding symbols, the one for k + 1; no
   suffix is compared again.  The boundaries that a round adds lie where common prefixes end
   after that many symbols, so after ``WIDTH`` rounds the blocks without a boundary are the
   intervals of suffixes with a common prefix of ``WIDTH`` symbols or more.
4. *Cover.*  The smallest document of each interval decides, for every start, what is removed.

Null texts count as empty.  Rows with a null id neither lose bytes nor make others lose any;
rows that share an id are one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.shared import bound_batches

U64 = np.uint64
WIDTH, GRAM = 50, 24
REACH = WIDTH - GRAM  # bytes that a string can stand out beyond its minimiser, to either side
#: Symbols of one merge (whole groups of segments with one minimiser), and of one shard.
MERGED, SHARD = 1 << 17, 1 << 21
_NONE = U64(2**64 - 1)
#: Bytes of text of one bucket of documents, about.
BUCKET_BYTES = 64 << 20


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = f(x[:-size], x[size:]), size * 2
    return f(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the lowest in some string of WIDTH bytes in a text."""
    n, span = len(data), REACH + 1
    if n < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(n)
    at = np.arange(n - GRAM + 1)
    h = tk.span_hash(tk.prefix_hash(data), at, at + GRAM) >> U64(1)
    h[left[: len(h)] < GRAM] = _NONE
    low = _slide(h, span, np.minimum)
    low[left[: len(low)] < WIDTH] = 0
    edge = np.zeros(span - 1, U64)
    best = _slide(np.concatenate((edge, low, edge)), span, np.maximum)
    place = np.flatnonzero(best == h)
    return place, h[place]


# Stage 1: (bucket, kind, keys, ids) rows; kind 0 is to be met with others, kind 1 is settled,
# kind 2 names a whole copy.  Keys of anchors are sent as the upper 48 bits of their hashes.
_PACKED = "bucket long, kind int, keys binary, ids binary"


def _packed(bucket, kind, keys, ids) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(kind, pa.int32()), pa.array(keys, pa.binary()), pa.array(ids, pa.binary())], names=["bucket", "kind", "keys", "ids"])


def _deal(where: np.ndarray, kind: int, keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket."""
    order = np.argsort(where, kind="stable")
    where, keys, ids = where[order], keys[order], ids[order]
    cut = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1]))) if len(where) else np.zeros(0, np.int64)
    ends = np.concatenate((cut[1:], [len(where)])) if len(cut) else cut
    return _packed(where[cut], np.full(len(cut), kind), [keys[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], [ids[i:j].tobytes() for i, j in zip(cut, ends, strict=True)])


def _pairs(keys: np.ndarray, ids: np.ndarray):
    """Distinct (key, id) pairs in order, where each key starts, and whether it has several ids."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))) if len(keys) else np.zeros(0, bool)
    keys, ids = keys[new], ids[new]
    first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    return keys, ids, first, np.bincount(group)[group] > 1 if len(keys) else first


def _ids(table: pa.Table, kind: int) -> np.ndarray:
    """Ids as Spark's hexadecimal digits give them: big-endian longs."""
    return np.frombuffer(b"".join(x.as_py() for x, k in zip(table.column("ids"), table.column("kind").to_pylist(), strict=True) if k == kind), dtype=">i8").astype(np.int64)


def _collect(buckets: int):
    """The anchors of a bucket of documents that aren't whole copies."""

    def run(key, docs, copies):
        ids = docs.column("id").to_numpy(zero_copy_only=False)
        skip = np.isin(ids, _ids(copies, 2)) if copies.num_rows else np.zeros(len(ids), bool)
        data, offs = tk.utf8(docs.column("text"))
        held = [(np.zeros(0, U64), np.zeros(0, np.int64))]
        for at, to in tk.chunks(offs):
            o = offs[at : to + 1] - offs[at]
            place, h = anchors(data[offs[at] : offs[to]], o)
            row = at + np.searchsorted(o, place, side="right") - 1
            held.append((h[~skip[row]], ids[row[~skip[row]]]))
        keys, ids, first, several = _pairs(np.concatenate([k for k, _ in held]), np.concatenate([i for _, i in held]))
        out = [_deal((keys[first] % U64(buckets)).astype(np.int64), 0, tk.short(keys[first]), ids[first])]
        if several.any():  # known to be shared already; any bucket will do
            out.append(_deal(np.full(int(several.sum()), key[0].as_py(), np.int64), 1, tk.short(keys[several]), ids[several]))
        return pa.Table.from_batches(out)

    return run


def _read(table: pa.Table, column: str, kind: np.ndarray, want: int, dtype) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), dtype=dtype) for x, k in zip(table.column(column), kind, strict=True) if k == want]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _shared(buckets: int):
    """Shared anchors, dealt by the documents' buckets."""

    def run(key, table):
        kind = table.column("kind").to_numpy()
        keys, ids, _, several = _pairs(tk.unshort(_read(table, "keys", kind, 0, np.uint8)), _read(table, "ids", kind, 0, np.int64))
        keys = np.concatenate((keys[several], tk.unshort(_read(table, "keys", kind, 1, np.uint8))))
        ids = np.concatenate((ids[several], _read(table, "ids", kind, 1, np.int64)))
        return pa.Table.from_batches([_deal(ids % buckets, 0, tk.short(keys << U64(16)), ids)])

    return run


# Stage 2: segments.  A packed place is base << 27 | mask: the starts base + s with bit s set.
_SEGMENTS = "bucket long, kind int, keys binary, ids binary, base binary, left binary, size binary, bytes binary"
_NAMES = [x.split()[0] for x in _SEGMENTS.split(", ")]


def _starts(left: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many strings of a segment hold its minimiser: they start at 0, 1, ..."""
    return np.maximum(0, np.minimum(left, size - WIDTH) + 1)


def _cut(buckets: int):
    def run(key, docs, shared):
        ids = docs.column("id").to_numpy(zero_copy_only=False)
        data, offs = tk.utf8(docs.column("text"))
        kind = shared.column("kind").to_numpy() if shared.num_rows else np.zeros(0)
        want_key, want_id = (tk.unshort(_read(shared, "keys", kind, 0, np.uint8)), _read(shared, "ids", kind, 0, np.int64)) if shared.num_rows else (np.zeros(0, U64), np.zeros(0, np.int64))
        empty = pa.table({n: pa.array([], t) for n, t in zip(_NAMES, (pa.int64(), pa.int32(), *[pa.binary()] * 6), strict=True)})
        if not len(want_key) or not len(data):
            return empty
        want = np.unique(tk.mix(want_key + tk.mix(want_id.view(U64))))
        places, hashes = [], []
        for at, to in tk.chunks(offs):
            o = offs[at : to + 1] - offs[at]
            place, h = anchors(data[offs[at] : offs[to]], o)
            owner = ids[at + np.searchsorted(o, place, side="right") - 1]
            mark = tk.mix((h >> U64(16)) + tk.mix(owner.view(U64)))
            row = np.minimum(np.searchsorted(want, mark), len(want) - 1)
            good = want[row] == mark
            places.append(place[good] + offs[at])
            hashes.append(h[good])
        place, h = np.concatenate(places), np.concatenate(hashes)
        if not len(place):
            return empty
        row = np.searchsorted(offs, place, side="right") - 1
        low, high = np.maximum(place - REACH, offs[row]), np.minimum(place + GRAM + REACH, offs[row + 1])
        left, size = place - low, high - low
        own = tk.mix(tk.hash_spans(data, low, high) + h + left.astype(U64) * U64(0x9E3779B97F4A7C15))
        order = np.lexsort((place, ids[row], own))
        own, row, low, left, size, h = own[order], row[order], low[order], left[order], size[order], h[order]
        owner, base = ids[row], low - offs[row]
        first = np.concatenate(([True], own[1:] != own[:-1]))
        lead = owner[np.flatnonzero(first)][np.cumsum(first) - 1]
        settled = owner > lead  # the same segment stands in a smaller document of this task
        full = (U64(1) << _starts(left, size).astype(U64)) - U64(1)
        done = (base[settled].astype(U64) << U64(27)) | full[settled]
        out = [pa.array([int(key[0].as_py())], pa.int64()), pa.array([1], pa.int32()), pa.array([done.tobytes()]), pa.array([owner[settled].tobytes()]), *[pa.nulls(1, pa.binary())] * 4]
        tables = [pa.Table.from_arrays(out, names=_NAMES)] if len(done) else []
        rest = np.flatnonzero(~settled)
        where = (h[rest] % U64(buckets)).astype(np.int64)
        rest = rest[np.argsort(where, kind="stable")]
        where = np.sort(where, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1]))) if len(where) else []
        cols: list[list] = [[] for _ in range(8)]
        for i, j in zip(cut, [*cut[1:], len(where)], strict=False):
            r = rest[i:j]
            flat = np.repeat(low[r], size[r]) + np.arange(size[r].sum()) - np.repeat(np.cumsum(size[r]) - size[r], size[r])
            for c, x in zip(cols, (where[i], 0, h[r].tobytes(), owner[r].tobytes(), base[r].tobytes(), left[r].astype(np.uint8).tobytes(), size[r].astype(np.uint8).tobytes(), data[flat].tobytes()), strict=True):
                c.append(x)
        tables.append(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), *[pa.binary()] * 6), strict=True)], names=_NAMES))
        return pa.concat_tables(tables)

    return run


def suffix_order(text: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a shard in the order of their first symbols, ``depth`` of them at least.

    Symbols are above 0; each string ends in a 0 that differs from all others, and stands in the
    order of the strings.  ``ends`` is, for each place, where its string's 0 is.
    """
    n = len(text)
    key = np.zeros(n, U64)
    for i in range(min(8, n)):
        symbol = np.zeros(n, U64)
        symbol[: n - i] = text[i:]
        symbol[np.arange(n) + i > ends] = 0
        key |= symbol << U64(8 * (7 - i))
    done, place = 8, np.arange(n)
    rank = np.zeros(n, np.int64)
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank[order] = np.cumsum(np.concatenate(([False], sorted_key[1:] != sorted_key[:-1])))
        if done >= depth:
            break
        ahead = min(done, depth - done)
        other = np.minimum(place + ahead, n - 1)
        second = np.where(place + ahead > ends, 0, rank[other] + 1)
        key = (rank.astype(U64) << U64(32)) | second.astype(U64)
        done += ahead
    return np.argsort((rank.astype(U64) << U64(32)) | place.astype(U64))


def transform(text: np.ndarray, ends: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's suffix order and its Burrows-Wheeler transform, two symbols deep.

    Before a string's start stands its end, and before that its last symbol.
    """
    order = suffix_order(text, ends, depth)
    place = np.arange(len(text))
    back = np.where(place == starts_of(ends, starts), ends, place - 1)
    one = text[back].astype(np.uint16)
    two = one[back]
    return order, ((two << np.uint16(8)) | one)[order]


def starts_of(ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.repeat(starts, np.diff(np.concatenate((starts, [len(ends)]))))


def merge(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' transforms, and the length of the common prefix ahead of each place.

    A shard's transform has, for each suffix in order, the two symbols before it (the string's
    end stands before its start), the further one in the upper byte; so a round of refinement
    adds two symbols, and common prefixes are known to even lengths, ``depth`` at most.
    """
    sizes = [len(x) for x in shards]
    total = sum(sizes)
    kind = np.uint8 if len(shards) < 256 else np.uint16
    which = np.arange(len(shards), dtype=kind)
    z = np.repeat(which, sizes)
    flat = np.concatenate(shards)
    # Suffixes that start with a string's end, or a symbol and the end, have a fixed order: that
    # of the strings, so the shards stand one after the other, and none equals another.
    ends = [np.bincount(x >> 8, minlength=1)[0] for x in shards]
    dollars = int(sum(ends))
    fixed = [(0, np.repeat(which, ends))]
    codes, where = np.unique(np.sort(flat), return_index=True)
    for code, at in zip(codes.tolist(), where.tolist(), strict=True):
        if code > 255 and not code & 255:
            fixed.append((at, np.repeat(which, [int((x == code).sum()) for x in shards])))
    lone = np.zeros(total, bool)
    for at, run in fixed:
        lone[at : at + len(run)] = True
        lone[min(at + len(run), total - 1)] = True
    block = np.zeros(total, np.int32)
    prefix = np.full(total, depth, np.int16)
    symbol = np.empty(total, np.uint16)
    known = np.zeros(total, bool)
    for k in range(0, depth, 2):
        if len(shards) == 2:
            second = z.view(bool)
            symbol[~second], symbol[second] = flat[: sizes[0]], flat[sizes[0] :]
        else:
            symbol[np.argsort(z, kind="stable")] = flat
        order = np.argsort(symbol, kind="stable")
        s, b = symbol[order], block[order]
        change = lone.copy()
        change[0] = True
        change[1:] |= (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        z = z[order]
        for at, run in fixed:
            z[at : at + len(run)] = run
        prefix[change & ~known] = k
        known |= change
        np.cumsum(change, out=block)
        if dollars == total or change.all():
            break
    return z, prefix


def repeated(strings: np.ndarray, size: np.ndarray, shard: int = SHARD, depth: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes of some strings (joined, each with a 0 behind it) and their intervals.

    Suffixes with the same interval number have the first ``depth`` symbols in common.
    """
    whole = size + 1
    first = np.concatenate(([0], np.cumsum(whole)))
    text = np.zeros(first[-1], np.uint8)
    text[np.arange(len(strings)) + np.repeat(np.arange(len(size)), size)] = strings
    code = np.zeros(256, np.uint8)
    used = np.unique(strings)
    code[used] = np.arange(1, len(used) + 1)  # UTF-8 uses fewer than 255 byte values
    text = np.where(text > 0, code[text], 0).astype(np.uint8) if not (strings == 0).any() else _recode(text, first, code)
    parts = max(2, -(-int(first[-1]) // shard)) if len(size) > 1 else 1
    bounds = np.unique(np.searchsorted(first, np.linspace(0, first[-1], parts + 1)))
    bounds[0], bounds[-1] = 0, len(size)
    places, transforms = [], []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        own = text[first[lo] : first[hi]]
        starts = first[lo:hi] - first[lo]
        ends = np.repeat(first[lo + 1 : hi + 1] - first[lo] - 1, whole[lo:hi])
        order, bwt = transform(own, ends, starts, depth + 1)
        places.append(order + first[lo])
        transforms.append(bwt)
    z, prefix = merge(transforms, depth)
    out = np.empty(len(text), np.int64)
    out[np.argsort(z, kind="stable")] = np.concatenate(places)
    return out, np.cumsum(prefix < depth)


def _recode(text: np.ndarray, first: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Symbols where a byte 0 stands inside a string: only the strings' own ends stay 0."""
    out = code[text]
    out[first[1:] - 1] = 0
    return out


def _share(some, raw, text_at, text_size, count, begin, smallest, cover) -> None:
    """Lower ``cover`` to the smallest document of each interval of equal strings of some segments."""
    if len(some) < 2:
        return
    lens = text_size[some]
    flat = np.repeat(text_at[some], lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    place, interval = repeated(raw[flat], lens)
    first = np.concatenate(([0], np.cumsum(lens + 1)))
    string = np.searchsorted(first, place, side="right") - 1
    inner = place - first[string]
    use = inner < count[some[string]]
    seg, inner, interval = some[string[use]], inner[use], interval[use]
    if not len(interval):
        return
    low = np.full(int(interval.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, interval, smallest[seg])
    slot = begin[seg] + inner
    cover[slot] = np.minimum(cover[slot], low[interval])


def _settle(buckets: int):
    """The starts that smaller documents cover, dealt by the documents' buckets."""

    def run(key, table):
        kind = table.column("kind").to_numpy()
        get = lambda c, t, want=0: _read(table, c, kind, want, t)
        found_id, found = get("ids", np.int64, 1), get("keys", U64, 1)
        h, owner, base = get("keys", U64), get("ids", np.int64), get("base", np.int64)
        left, size, raw = get("left", np.uint8).astype(np.int64), get("size", np.uint8).astype(np.int64), get("bytes", np.uint8)
        if len(h):
            at = np.concatenate(([0], np.cumsum(size)))
            own = tk.mix(tk.hash_spans(raw, at[:-1], at[1:]) + h + left.astype(U64) * U64(0x9E3779B97F4A7C15))
            # Distinct segments with their smallest document.
            _, pick, of = np.unique(own, return_index=True, return_inverse=True)
            smallest = np.full(len(pick), np.iinfo(np.int64).max)
            np.minimum.at(smallest, of, owner)
            count = _starts(left, size)[pick]
            begin = np.concatenate(([0], np.cumsum(count)))
            cover = np.repeat(smallest, count)  # for each string of each segment, its smallest document
            _, group, members = np.unique(h[pick], return_inverse=True, return_counts=True)
            # A string that two segments share goes REACH / 2 bytes or more beyond the minimiser to
            # the left or to the right: without a partner on either side there is nothing to share.
            text_at, text_left, text_size = at[pick], left[pick], size[pick]
            half, middle = REACH // 2, text_at + text_left
            partner = np.zeros(len(pick), bool)
            for low, high in ((middle - half, middle + GRAM), (middle, middle + GRAM + half)):
                fits = (low >= text_at) & (high <= text_at + text_size)
                rows = np.flatnonzero(fits)
                rows = rows[np.argsort(low[rows], kind="stable")]
                side = tk.hash_spans(raw, low[rows], high[rows])
                _, inv, n = np.unique(side, return_inverse=True, return_counts=True)
                partner[rows] |= n[inv] > 1
            mixed = np.flatnonzero((members[group] > 1) & partner)
            mixed = mixed[np.argsort(group[mixed], kind="stable")]
            # One merge takes whole groups, MERGED symbols or one group.
            lens = text_size[mixed] + 1
            last = np.concatenate((group[mixed][1:] != group[mixed][:-1], [True])) if len(mixed) else np.zeros(0, bool)
            total, at_group = np.cumsum(lens), np.flatnonzero(last)
            begin_at = 0
            while begin_at < len(mixed):
                done = total[begin_at] - lens[begin_at]
                j = int(np.searchsorted(total[at_group], done + MERGED, side="right"))
                stop = int(at_group[max(j - 1, int(np.searchsorted(at_group, begin_at)))]) + 1
                _share(mixed[begin_at:stop], raw, text_at, text_size, count, begin, smallest, cover)
                begin_at = stop
            # Each segment's place in each document: the starts that a smaller document covers.
            bits = np.zeros(len(h), U64)
            for s in range(REACH + 1):
                there = s < count[of]
                less = np.zeros(len(h), bool)
                less[there] = cover[begin[of[there]] + s] < owner[there]
                bits |= less.astype(U64) << U64(s)
            hit = bits > 0
            found_id = np.concatenate((found_id, owner[hit]))
            found = np.concatenate((found, (base[hit].astype(U64) << U64(27)) | bits[hit]))
        return pa.Table.from_batches([_deal(found_id % buckets, 0, found, found_id)])

    return run


def _remove(with_text: bool):
    def run(key, docs, found):
        ids = docs.column("id").to_pylist()
        data, offs = tk.utf8(docs.column("text"))
        kind = found.column("kind").to_numpy() if found.num_rows else np.zeros(0)
        packed, owner = (_read(found, "keys", kind, 0, U64), _read(found, "ids", kind, 0, np.int64)) if found.num_rows else (np.zeros(0, U64), np.zeros(0, np.int64))
        step = np.zeros(len(data) + 1, np.int32)
        if len(packed):
            order = np.argsort(owner, kind="stable")
            packed, owner = packed[order], owner[order]
            number = np.array([-1 if i is None else i for i in ids], dtype=np.int64)
            lo, hi = np.searchsorted(owner, number), np.searchsorted(owner, number, side="right")
            lo = np.where([i is None for i in ids], hi, lo)
            take = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            at = np.repeat(offs[:-1], hi - lo) + (packed[take] >> U64(27)).astype(np.int64)
            limit = np.repeat(offs[1:], hi - lo)
            for i in range(0, len(take), 1 << 16):
                part = slice(i, i + (1 << 16))
                which, bit = np.nonzero((packed[take[part]][:, None] >> np.arange(REACH + 1, dtype=U64)) & U64(1))
                starts = at[part][which] + bit
                starts = starts[starts + WIDTH <= limit[part][which]]
                np.add.at(step, starts, 1)
                np.subtract.at(step, starts + WIDTH, 1)
        gone = np.cumsum(step[:-1]) > 0
        if found.num_rows and len(whole := _ids(found, 2)):
            gone |= np.repeat(np.isin(np.array([-1 if i is None else i for i in ids], dtype=np.int64), whole), np.diff(offs))
        stay = ~gone
        run_start = gone.copy()
        run_start[1:] &= ~gone[:-1]
        heads = offs[:-1][offs[:-1] < offs[1:]]
        run_start[heads] = gone[heads]
        sums = lambda x: np.concatenate(([0], np.cumsum(x)))
        g, r = sums(gone), sums(run_start)
        n = len(ids)
        parts = [data[offs[i] : offs[i + 1]][stay[offs[i] : offs[i + 1]]].tobytes() for i in range(n)]
        cols = {
            "id": docs.column("id"),
            "n_bytes": pa.array(np.diff(offs)),
            "n_removed": pa.array(g[offs[1:]] - g[offs[:-1]]),
            "n_spans": pa.array(r[offs[1:]] - r[offs[:-1]]),
            "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()),
        }
        if with_text:
            cols["kept"] = pa.array(parts, pa.binary())
        return pa.table(cols)

    return run


def _prime(n: int) -> int:
    """The least prime from n on: ids in equal steps spread over a prime number of buckets."""
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row, and the kept bytes on request."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = _prime(max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
    known = rows.where("id is not null and octet_length(text) >= 50").select("id", F.xxhash64(F.lit(1), "text").alias("h1"), F.xxhash64(F.lit(2), "text").alias("h2"))
    firsts = known.groupBy("h1", "h2").agg(F.min("id").alias("least"))
    copies = known.join(firsts, ["h1", "h2"]).where("id > least")
    copies = copies.select(F.pmod("id", F.lit(buckets).cast("long")).alias("bucket"), F.lit(2).alias("kind"), F.lit(None).cast("binary").alias("keys"), F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("ids"))
    placed = rows.withColumn("bucket", F.coalesce(F.pmod("id", F.lit(buckets).cast("long")), F.pmod(F.xxhash64("text"), F.lit(buckets).cast("long"))))
    by_doc = placed.groupBy("bucket")  # one exchange of the texts serves all three steps
    anchored = by_doc.cogroup(copies.groupBy("bucket")).applyInArrow(_tidy(_known_only(_collect(buckets))), _PACKED)
    shared = anchored.groupBy("bucket").applyInArrow(_tidy(_shared(buckets)), _PACKED)
    segments = by_doc.cogroup(shared.groupBy("bucket")).applyInArrow(_tidy(_known_only(_cut(buckets))), _SEGMENTS)
    found = segments.groupBy("bucket").applyInArrow(_tidy(_settle(buckets)), _PACKED)
    out = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    found = found.unionByName(copies)
    return by_doc.cogroup(found.groupBy("bucket")).applyInArrow(_tidy(_remove(with_text)), out).withColumnRenamed("id", id_col)


def _known_only(f):
    def run(key, docs, shared):
        return f(key, docs.filter(docs.column("id").is_valid()), shared)

    return run


def _tidy(f):
    """f, and then freed memory goes back."""

    def one(key, table):
        out = f(key, table)
        tk.release()
        return out

    def two(key, left, right):
        out = f(key, left, right)
        tk.release()
        return out

    return one if f.__code__.co_argcount == 2 else two


def query(spark, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes or more that repeat across documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS (SELECT doc_id, s, b[s + 1:s + 50] AS w FROM (SELECT doc_id, b, unnest(range(0, n - 49)) AS s FROM bytes)),
firsts AS (SELECT w, min(doc_id) AS f FROM strings GROUP BY w),
hits AS (SELECT doc_id, s FROM strings JOIN firsts USING (w) WHERE f < doc_id),
marked AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER o + 50 THEN 0 ELSE 1 END AS new FROM hits WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
numbered AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS e FROM numbered GROUP BY doc_id, run),
ends AS (SELECT doc_id, a, e, true AS real FROM runs UNION ALL SELECT doc_id, n, n, false FROM bytes),
pieces AS (SELECT doc_id, a, e, real, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a, e), 0) AS since FROM ends)
SELECT p.doc_id, any_value(n)::BIGINT AS n_bytes, coalesce(sum(e - a) FILTER (WHERE real), 0)::BIGINT AS n_removed, count(*) FILTER (WHERE real)::BIGINT AS n_spans,
       sha256(unhex(string_agg(CASE WHEN a > since THEN hex(b[since + 1:a]) ELSE '' END, '' ORDER BY a, e))) AS kept_sha256
FROM pieces p JOIN bytes d ON d.doc_id = p.doc_id GROUP BY p.doc_id
"""
