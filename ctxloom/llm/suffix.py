"""Removal of long byte strings that already occur in an earlier document, by suffix arrays.

Every string of LENGTH bytes has a minimizer: the least hash among its GRAM-byte grams. Neighbouring
strings with the same minimizer form a cell; equal strings always lie in cells of the same minimizer
gram, so cells are dealt out by it and no comparison needs two partitions.

1. Texts go into blocks, which are files in the shared folder, with their cells. A block sends the hash of
   each of its grams once. A gram that only one document has is closed: no string of its cells can occur
   elsewhere. Hashes decide nothing else.
2. The bytes of all other cells meet by gram; equal cells of a block are compared byte by byte and sent
   once. Each part compares equal cells of different blocks byte by byte, sorts the suffixes of the
   different ones by the difference-cover algorithm modulo 3 (sampled triples are sorted and named, names
   are recursed on, the remaining suffixes are merged in) and compares the LENGTH-byte prefixes of
   neighbours, which yields for each string the least document that has it. Cells of a gram that has very
   many different ones are cut into single strings, combined in each block and dealt out by content, so that
   a gram's group is no larger than the number of blocks.
3. Each block marks the strings that an earlier document has and writes what stays.

A part's size follows PART, a block's BLOCK, and a block sends one row at most for each gram or part,
whichever are fewer.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_shuffles, new_path, partitions, path_prefix, read_slice, spill, trim

LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1
#: Bytes of text in a block, for each part of the strings and of the grams, for each task, and in one step of numpy work; different cells of a gram from which it is cut up.
BLOCK, PART, GRAM_PART, SPREAD, STEP, HOT = 4 << 20, 2 << 20, 32 << 20, 64 << 20, 1 << 18, 4096

_rng = np.random.default_rng(2024)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        with np.errstate(over="ignore"):
            out = np.full(max(n, STEP * 2), np.uint64(base))
            out[0] = 1
            _powers[base] = np.cumprod(out)
    return _powers[base][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(29))


def cells(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of concatenated documents (ends: where each ends): first start, number of starts, gram hash, content hash, document."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    up, down = _power(_MUL, n), _power(_INV, n + 1)
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=pre[1:])
    m = n - GRAM + 1
    gram = _mix((pre[GRAM:] - pre[:m]) * down[:m])
    v = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    size = 1
    while size * 2 <= WINDOW:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if size < WINDOW:
        v = np.minimum(v[: size - WINDOW], v[WINDOW - size :])
    least = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)  # position of the minimizer of the string at each start
    doc = np.searchsorted(ends, np.arange(len(least)), "right")
    fits = np.arange(LENGTH, n + 1)[: len(least)] <= ends[doc]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (fits[1:] != fits[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(least)))
    keep = fits[first]
    first, count = first[keep], count[keep]
    to = first + count + LENGTH - 1
    whole = _mix((pre[to] - pre[first]) * down[first] + count.astype(np.uint64) * np.uint64(0x8BB84B93962EACC9))
    return first, count, gram[least[first]], whole, doc[first]


def _steps(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of about STEP bytes."""
    at = 0
    total = np.cumsum(sizes)
    while at < len(sizes):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + STEP, "right")))
        yield at, to
        at = to


def _windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on; positions within eight bytes of the end may be read to the end."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)


def same_bytes(words: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes (8 at least) at a are those at b, by the eight-byte windows of the data."""
    same = np.ones(len(a), bool)
    for off in range(0, int(size.max()) if len(size) else 0, 8):
        at = np.minimum(off, size - 8)
        same &= (words[a + at].view(np.uint64) == words[b + at].view(np.uint64)).ravel()
    return same


def _ramp(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after another."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions of runs, one after another."""
    return np.repeat(first, count) + _ramp(count)


def _names(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, names) of non-negative keys of so many bits: equal keys have one name, names ascend with keys."""
    n = len(key)
    low = max(1, int(n - 1).bit_length())
    if bits + low <= 63:  # the position rides in the low bits, so that one sort of plain numbers does
        packed = (key.astype(np.int64) << low) | np.arange(n)
        packed.sort()
        order, key = packed & ((1 << low) - 1), packed >> low
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    name = np.empty(n, np.int32)
    name[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])[:n], dtype=np.int32)
    return order, name


def dc3(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int32) + np.int32(1), np.zeros(3, np.int32)])
    bits = int(t.max()).bit_length()
    # names of the sampled triples; when n % 3 == 1 one empty triple closes the first run
    at = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    two_of = lambda first, second, width: (first.astype(np.int64) << width) | second
    key, used = two_of(t[at], t[at + 1], bits), 2 * bits
    if used + bits > 62:
        _, key = _names(key, used)
        used = int(key.max()).bit_length()
    order, name = _names(two_of(key, t[at + 2], bits), used + bits)
    del key
    if int(name.max()) + 1 < len(at):
        order = dc3(name)
    order = at[order]
    del name
    rank = np.zeros(n + 4, np.int32)
    rank[order] = np.arange(1, len(order) + 1)
    order = order[order < n]
    # the remaining suffixes, by their first letter and the rank of the next
    rest = np.arange(0, n, 3)
    wide = int(rank.max()).bit_length()
    key0 = two_of(t[rest], rank[rest + 1], wide)
    rest = rest[_names(key0, bits + wide)[0]]
    key0 = two_of(t[rest], rank[rest + 1], wide)
    # merge: how many sampled suffixes precede each of the rest, for either residue
    a = order[order % 3 == 1]
    b = order[order % 3 == 2]
    before = np.searchsorted(two_of(t[a], rank[a + 1], wide), key0)
    both = np.concatenate([b, rest])
    pair = two_of(t[both], t[both + 1], bits)
    if 2 * bits + wide > 62:
        _, pair = _names(pair, 2 * bits)
    before = before + np.searchsorted(two_of(pair[: len(b)], rank[b + 2], wide), two_of(pair[len(b) :], rank[rest + 2], wide))
    out = np.empty(n, np.int64)
    place = before + np.arange(len(rest))
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = order
    return out


def least_owner(data: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each start, the least owner among all starts whose LENGTH-byte strings are the same."""
    wanted = np.full(len(data), -1, np.int32)
    wanted[starts] = np.arange(len(starts))
    picked = wanted[dc3(data)]
    picked = picked[picked >= 0]
    p = starts[picked]
    words = _windows(data)
    same = np.ones(max(0, len(p) - 1), bool)
    for off in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        w = words[p + off].view(np.uint64).ravel()
        same &= w[1:] == w[:-1]
    head = np.flatnonzero(np.concatenate([[True], ~same]))[: len(p)]
    low = np.minimum.reduceat(owner[picked], head) if len(p) else np.zeros(0, np.int64)
    out = np.empty(len(starts), np.int64)
    out[picked] = np.repeat(low, np.diff(np.append(head, len(p))))
    return out


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes(), *(a.tobytes() for a in arrays)])


def _unblob(raw, *kinds) -> list[np.ndarray]:
    raw = memoryview(raw)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    at, out = 8 + 8 * n, []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


_zstd = pa.Codec("zstd", 1)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """As _blob, compressed."""
    raw = _blob(*arrays)
    return len(raw).to_bytes(8, "little") + _zstd.compress(raw, asbytes=True)


def _loosen(raw: pa.Buffer, *kinds) -> list[np.ndarray]:
    return _unblob(_zstd.decompress(raw.slice(8), int.from_bytes(raw.slice(0, 8).to_pybytes(), "little")), *kinds)


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_all().combine_chunks().to_batches()[0]


#: Rows between the steps: what a block and a part tell each other, and in rows of negative parts what a block keeps.
ROWS = "block long, part int, blob binary, path string, at array<long>"
_ROWS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("blob", pa.binary()), ("path", pa.string()), ("at", pa.list_(pa.int64()))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), _ROWS)], schema=_ROWS)


def runs(parts: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, from, to) of ascending part numbers: as many as parts that occur."""
    edge = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else np.zeros(0, np.int64)
    return list(zip(parts[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(parts)]))


class Docs:
    """The documents of a block."""

    def __init__(self, batch: pa.RecordBatch, id_at: int, text_at: int):
        self.batch = batch
        self.texts = [(t.as_py() or "").encode() for t in batch.column(text_at)]
        self.ids = batch.column(id_at).cast(pa.int64())
        self.null, self.id = np.asarray(self.ids.is_null()), np.asarray(self.ids.fill_null(0))
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.start = self.ends - self.sizes

    def cells(self) -> list[np.ndarray]:
        """As cells, of documents with an id."""
        out: list = [[], [], [], [], []]
        for a, b in _steps(self.sizes):
            base = self.start[a]
            got = cells(self.data[base : self.ends[b - 1]], self.ends[a:b] - base)
            for x, y in zip(out, (got[0] + base, got[1], got[2], got[3], got[4] + a)):
                x.append(y)
        out = [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, (np.int64, np.int64, np.uint64, np.uint64, np.int64))]
        live = ~self.null[out[4]]
        return [x[live] for x in out]


def contents(docs: Docs) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A block's cells (gap to the end of the cell before, number of starts, 0 for a new content or else its number from
    1 on) with each content's gram; the grams in ascending order; and for each twice its contents, and one more if several documents have it."""
    first, count, gram, whole, doc = docs.cells()
    n = len(first)
    if not n:
        none = np.zeros(0, np.uint32)
        return [none, none.astype(np.uint8), none, none], none.astype(np.uint64), none
    _, rank = np.unique(docs.id, return_inverse=True)
    rank = rank[doc]
    key = _mix(gram * np.uint64(0x9DDFEA08EB382D69) ^ whole)
    order = np.argsort(key)
    head = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    seen = np.argsort(np.minimum.reduceat(order, head))  # contents in the order of their first cell
    number = np.empty(len(head), np.uint32)
    number[seen] = np.arange(len(head))
    content = np.empty(n, np.uint32)
    content[order] = np.repeat(number, np.diff(np.append(head, n)))
    low, high = np.minimum.reduceat(rank[order], head)[seen], np.maximum.reduceat(rank[order], head)[seen]
    opening = np.minimum.reduceat(order, head)[seen]
    del key, order, whole
    grams, of = np.unique(gram[opening], return_inverse=True)
    by = np.argsort(of)
    edge = np.searchsorted(of[by], np.arange(len(grams)))
    several = np.minimum.reduceat(low[by], edge) < np.maximum.reduceat(high[by], edge)
    load = 2 * np.bincount(of, minlength=len(grams)) + several
    gap = first.copy()
    gap[1:] -= first[:-1] + count[:-1]
    content += np.uint32(1)
    content[opening] = 0
    return [gap.astype(np.uint32), count.astype(np.uint8), content, of.astype(np.uint32)], grams, load.astype(np.uint32)


def deal(grams: np.ndarray, parts: int) -> np.ndarray:
    """The part of each gram; parts are ranges of the hash, so that they ascend with it."""
    return (((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def write_blocks(docs: DataFrame, folder: str, id_col: str, text_col: str, parts: int, block: int) -> DataFrame:
    """Step 1, blocks: writes them; ROWS with a block's grams for each part, and where the block is."""
    id_at, text_at, prefix, tasks = docs.columns.index(id_col), docs.columns.index(text_col), path_prefix(folder), partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, at, no = f"{root}/{uuid.uuid4().hex}.blocks", None, 0, TaskContext.get().partitionId() << 32
        for b in batches:
            sizes = np.nan_to_num(np.asarray(pc.binary_length(b.column(text_at)).to_numpy(zero_copy_only=False), float))
            total, lo = np.cumsum(sizes), 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + block, "right")))
                part = pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in b.columns], [str(i) for i in range(b.num_columns)])
                table, grams, load = contents(Docs(part, id_at, text_at))
                raw = [_pack(part), _pack(pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in table], ["gap", "count", "content", "gram"]))]
                out = out or store.open_output_stream(name, compression=None)
                out.write(raw[0])
                out.write(raw[1])
                rows = [(no, -1 - no % tasks, None, prefix + name, [at, len(raw[0]), at + len(raw[0]), len(raw[1])])]
                where, tail = deal(grams, parts), grams.astype(np.uint32)
                rows += [(no, p, _blob(tail[x:y], load[x:y]), None, None) for p, x, y in runs(where)]
                at, no, lo = at + len(raw[0]) + len(raw[1]), no + 1, hi
                yield _rows(rows)
                del part, table, grams, load, raw, rows
                trim()
        if out:
            out.close()

    return docs.mapInArrow(run, ROWS)


def _open_grams(t: pa.Table, hot: int, parts: int) -> pa.Table:
    """Step 1, in one part: for each gram of each block -1 if one document alone has it, else the part where its cells meet, or -2 if they are cut up."""
    part = t.column("part")[0].as_py()
    if part < 0:
        return t
    got = [_unblob(x.as_buffer(), np.uint32, np.uint32) for x in t.column("blob")]
    tail, load = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]).astype(np.int64)
    order = np.argsort(tail)
    head = np.flatnonzero(np.concatenate([[True], tail[order][1:] != tail[order][:-1]]))
    size = np.diff(np.append(head, len(tail)))
    several = (size > 1) | (np.bitwise_or.reduceat(load[order], head) & 1 > 0)
    many = np.add.reduceat(load[order] >> 1, head)
    meet = (_mix(tail[order[head]].astype(np.uint64) << np.uint64(20) ^ np.uint64(part)) % np.uint64(parts)).astype(np.int32)
    code = np.empty(len(tail), np.int32)
    code[order] = np.repeat(np.where(~several, -1, np.where(many > hot, -2, meet)), size)
    cut = np.cumsum([len(g[0]) for g in got])[:-1]
    out = _rows([(b, part, c.tobytes(), None, None) for b, c in zip(t.column("block").to_pylist(), np.split(code, cut))])
    trim()
    return pa.Table.from_batches([out])


def _strings(t: pa.Table, id_at: int, text_at: int, parts: int) -> pa.Table:
    """Step 2, blocks: ROWS with the bytes of the open cells for each part, and what the block needs to read the answers."""
    t = t.sort_by("part")
    block, keeper, at = t.column("block")[0].as_py(), t.column("part")[0].as_py(), t.column("at")[0].as_py()
    path = t.column("path")[0].as_py()
    codes = np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(x.as_buffer(), np.int32) for x in t.column("blob").slice(1)]])
    rows = []
    if (codes != -1).any():
        docs = Docs(_unpack(read_slice(path, *at[:2])), id_at, text_at)
        gap, count, content, of = (np.frombuffer(c[0].as_buffer(), k) for c, k in zip(_unpack(read_slice(path, *at[2:])).columns, (np.uint32, np.uint8, np.uint32, np.uint32)))
        count = count.astype(np.int64)
        first = np.cumsum(gap.astype(np.int64) + count) - count
        content = np.where(content == 0, np.cumsum(content == 0), content) - 1
        own = docs.id[np.searchsorted(docs.ends, first, "right")]
        code = codes[of]
        # cells that meet others, each held against one of its content of the least document
        mine = np.flatnonzero(code[content] >= 0)
        words = _windows(docs.data)
        order = mine[np.lexsort((own[mine], content[mine]))]
        head = np.concatenate([[True], content[order][1:] != content[order][:-1]])[: len(order)]
        lead = np.zeros(len(code), np.int64)
        lead[content[order[head]]] = order[head]
        like = lead[content[mine]]
        same = (count[mine] == count[like]) & same_bytes(words, first[mine], first[like], count[mine] + LENGTH - 1)
        head = np.where(same, like, mine)
        heads, slot = np.unique(head, return_inverse=True)
        meet = code[content[heads]]
        order = np.argsort(meet, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        heads, meet, slot = heads[order], meet[order], place[slot]
        size = count + LENGTH - 1
        for p, x, y in runs(meet):
            h = heads[x:y]
            rows.append((block, p, _squeeze(own[h], count[h].astype(np.uint8), docs.data[_spans(first[h], size[h])]), None, None))
        side = [first[mine].astype(np.uint32), count[mine].astype(np.uint8), slot.astype(np.uint32), (own[mine] > own[heads[slot]]).astype(np.uint8)]
        # cells that are cut up into their strings
        cut = np.flatnonzero(code[content] == -2)
        starts = _spans(first[cut], count[cut])
        owner = np.repeat(own[cut], count[cut])
        strings = np.lib.stride_tricks.sliding_window_view(docs.data, LENGTH)[starts] if len(starts) else np.zeros((0, LENGTH), np.uint8)
        # numpy's S type drops trailing zero bytes, which no two strings of one length can differ in unseen
        _, where, slot = np.unique(np.ascontiguousarray(strings).view(f"S{LENGTH}").ravel(), return_index=True, return_inverse=True)
        least = np.full(len(where), np.iinfo(np.int64).max)
        np.minimum.at(least, slot, owner)
        h = np.zeros(len(where), np.uint64)
        for off in (*range(0, LENGTH - 7, 8), LENGTH - 8):
            h = _mix(h ^ words[starts[where] + off].view(np.uint64).ravel())
        meet = (h % np.uint64(parts)).astype(np.int64)
        order = np.argsort(meet, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        for p, x, y in runs(meet[order]):
            h = order[x:y]
            rows.append((block, parts + p, _squeeze(least[h], np.ones(len(h), np.uint8), np.ascontiguousarray(strings[where[h]]).ravel()), None, None))
        side += [starts.astype(np.uint32), place[slot].astype(np.uint32), (owner > least[slot]).astype(np.uint8)]
        rows.append((block, keeper, _squeeze(*side), path, at[:2]))
        del docs, words, strings
    else:
        rows.append((block, keeper, None, path, at[:2]))
    trim()
    return pa.Table.from_batches([_rows(rows)])


def _compare(t: pa.Table) -> pa.Table:
    """Step 2, in one part: for each string that the blocks sent, whether a document before its own has it."""
    part = t.column("part")[0].as_py()
    if part < 0:
        return t
    got = [_loosen(x.as_buffer(), np.int64, np.uint8, np.uint8) for x in t.column("blob")]
    owner, count, data = (np.concatenate([g[i] for g in got]) for i in range(3))
    count = count.astype(np.int64)
    size = count + LENGTH - 1
    first = np.cumsum(size) - size
    # equal cells of different blocks: by hash, and then byte by byte against one of them
    up, down = _power(_MUL, len(data)), _power(_INV, len(data) + 1)
    with np.errstate(over="ignore"):
        pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up)])
        key = _mix((pre[first + size] - pre[first]) * down[first] + size.astype(np.uint64) * np.uint64(0x8BB84B93962EACC9))
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    like = np.empty(len(order), np.int64)
    like[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    other = np.flatnonzero(like != np.arange(len(like)))
    same = (size[other] == size[like[other]]) & same_bytes(_windows(data), first[other], first[like[other]], size[other])
    like[other[~same]] = other[~same]
    del pre, key, order, new
    heads, kind = np.unique(like, return_inverse=True)
    least = np.full(len(heads), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, owner)
    own_data, own_count = data[_spans(first[heads], size[heads])], count[heads]
    own_first = np.cumsum(size[heads]) - size[heads]
    low = least_owner(own_data, _spans(own_first, own_count), np.repeat(least, own_count))
    base = np.cumsum(own_count) - own_count
    earlier = low[_spans(base[kind], count)] < np.repeat(owner, count)
    del own_data, low, data
    cut = np.cumsum([int(g[1].sum(dtype=np.int64)) for g in got])[:-1]
    out = _rows([(b, part, x.tobytes(), None, None) for b, x in zip(t.column("block").to_pylist(), np.split(earlier, cut))])
    trim()
    return pa.Table.from_batches([out])


def _removed(t: pa.Table, docs: Docs, parts: int) -> np.ndarray:
    """Step 3: the bytes of a block that go."""
    side = t.column("blob")[0]
    gone = np.zeros(len(docs.data) + 1, np.int32)
    if side.is_valid:
        first, count, slot, sure, starts, at, sure_at = _loosen(side.as_buffer(), np.uint32, np.uint8, np.uint32, np.uint8, np.uint32, np.uint32, np.uint8)
        first, count, starts = first.astype(np.int64), count.astype(np.int64), starts.astype(np.int64)
        answers = [(p, np.frombuffer(x.as_buffer(), np.bool_)) for p, x in zip(t.column("part").to_pylist()[1:], t.column("blob").slice(1))]
        hit = []
        if len(first):
            earlier = np.concatenate([x for p, x in answers if p < parts])
            sent = np.zeros(int(slot.max()) + 1, np.int64)  # strings of each cell that was sent
            sent[slot] = count
            base = np.cumsum(sent) - sent
            hit.append(_spans(first, count)[earlier[_spans(base[slot], count)] | np.repeat(sure.astype(bool), count)])
        if len(starts):
            earlier = np.concatenate([x for p, x in answers if p >= parts])
            hit.append(starts[earlier[at] | sure_at.astype(bool)])
        every = np.concatenate(hit) if hit else np.zeros(0, np.int64)
        gone[every] += 1  # no start is in two cells
        gone[every + LENGTH] -= 1
    return np.cumsum(gone[:-1]) > 0


def _run(docs: DataFrame, id_col: str, text_col: str, emit: Callable, schema, hot: int, block: int, part: int) -> DataFrame:
    """The steps; emit turns a block's documents and removed bytes into record batches of schema."""
    spark = docs.sparkSession
    tasks = partitions(spark)
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    gram_parts, parts = max(tasks, -(-size // (part * (GRAM_PART // PART)))), max(tasks, -(-size // part))
    grams = write_blocks(docs, new_path(spark, "suffix"), id_col, text_col, gram_parts, block)
    spread = max(tasks, -(-size // SPREAD))  # tasks follow the data, whatever the number of shuffle partitions
    codes = spill(grams.repartition(spread, "part").groupBy("part").applyInArrow(lambda t: _open_grams(t, hot, parts), ROWS), "suffix-grams")
    del grams
    forget_shuffles(spark)
    strings = codes.repartition(spread, "block").groupBy("block").applyInArrow(lambda t: _strings(t, id_at, text_at, parts), ROWS)
    found = spill(strings.repartition(spread, "part").groupBy("part").applyInArrow(_compare, ROWS), "suffix-strings")
    del strings
    forget_shuffles(spark)

    def finish(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        mine = Docs(_unpack(read_slice(t.column("path")[0].as_py(), *t.column("at")[0].as_py())), id_at, text_at)
        out = emit(mine, _removed(t, mine, parts))
        del mine
        trim()
        return pa.Table.from_batches([out])

    return found.repartition(spread, "block").groupBy("block").applyInArrow(finish, schema)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, block: int = BLOCK, part: int = PART) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of LENGTH bytes that covers it also starts in a document of a smaller id.
    Matches never cross documents; rows that repeat an id are not smaller than each other; rows with a null
    id lose nothing and take nothing from others; null and short texts lose nothing; a text longer than
    block is a block by itself. An empty table gives an empty result. Other columns are not read.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def emit(docs: Docs, gone: np.ndarray) -> pa.RecordBatch:
        upto = np.concatenate([[0], np.cumsum(gone)])
        starts = np.concatenate([[0], np.cumsum(gone & ~np.concatenate([[False], gone[:-1]]))])
        removed, spans = upto[docs.ends] - upto[docs.start], starts[docs.ends] - starts[docs.start]
        # a run that goes on over the border of two documents starts anew in the second
        border = np.flatnonzero((docs.sizes > 0) & (docs.start > 0))
        border = border[gone[docs.start[border]] & gone[docs.start[border] - 1]]
        spans[border] += 1
        sha = [hashlib.sha256(docs.data[s:e][~gone[s:e]].tobytes() if k else t).hexdigest() for s, e, k, t in zip(docs.start.tolist(), docs.ends.tolist(), removed.tolist(), docs.texts)]
        return pa.RecordBatch.from_arrays([docs.ids, pa.array(docs.sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _run(rows, "doc_id", "text", emit, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", hot, block, part)


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The rows of docs with the text that stays (bytes of a broken character at a cut go too); n_chars
    follows the text. Columns, their order and types are those of docs, whatever their names. Rows with a
    null id, null texts and texts that lose nothing stay as they are; no row goes, rows that repeat neither.
    An empty table gives an empty result."""
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    names = docs.columns

    def emit(mine: Docs, gone: np.ndarray) -> pa.RecordBatch:
        cols = list(mine.batch.columns)
        old = cols[at].to_pylist()
        text = [o if o is None else mine.data[s:e][~gone[s:e]].tobytes().decode(errors="ignore") for o, s, e in zip(old, mine.start.tolist(), mine.ends.tolist())]
        cols[at] = pa.array(text, pa.string())
        if chars is not None:
            cols[chars] = pa.array([n if o is None or len(o) == len(t) else len(t) for o, t, n in zip(old, text, cols[chars].to_pylist())], cols[chars].type)
        return pa.RecordBatch.from_arrays(cols, names)

    return _run(docs, "doc_id", "text", emit, docs.schema, hot, BLOCK, PART)


ORACLE = r"""
with d as (select doc_id, encode(coalesce(text, '')) as b, strlen(coalesce(text, ''))::bigint as n from documents),
w as (select doc_id, i, b[i:i + 49] as g from (select doc_id, b, unnest(range(1, greatest(n - 48, 1))) as i from d)),
f as (select g, min(doc_id) as first from w group by g),
hit as (select doc_id, i from w join f using (g) where first < doc_id),
s as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as fresh from hit),
t as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as span from s),
spans as (select doc_id, span, min(i) as a, max(i) + 49 as z from t group by all),
cut as (select doc_id, span, coalesce(lag(z) over (partition by doc_id order by span), 0) as before, a, z from spans),
pieces as (select c.doc_id, span, hex(b[before + 1:a - 1]) as h from cut c join d using (doc_id) where a - 1 > before
  union all select doc_id, 1000000000, hex(b[z + 1:n]) from (select doc_id, max(z) as z from spans group by doc_id) join d using (doc_id) where z < n),
kept as (select doc_id, string_agg(h, '' order by span) as h from pieces group by doc_id),
sums as (select doc_id, sum(z - a + 1)::bigint as n_removed, count(*)::bigint as n_spans from spans group by doc_id)
select d.doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  case when n_removed is null then sha256(b) else sha256(unhex(coalesce(k.h, ''))) end as kept_sha256
from d left join sums using (doc_id) left join kept k using (doc_id)
"""
