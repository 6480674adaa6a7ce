"""Token-ID files coded by a static range asymmetric numeral system.

Documents are put in ascending id order, encoded, and cut into blocks of whole documents. One frequency
table, counted over all tokens, is shared by all blocks and stands in a file beside them. A block is coded by itself in interleaved lanes
and carries a checksum; the manifest holds a checkpoint for every block (file, offset, first token), so
that any block can be decoded alone, and all of them in parallel.

Table: magic "RNT1", the number of symbols as little-endian uint32, uint32 crc32 of the rest; uint32 frequencies.
Block: magic "RNB1"; n_docs, n_tokens, n_lanes, n_words as little-endian uint32; uint32 crc32 of the rest;
n_docs int64 ids, n_docs bytes (1: the id is null), n_docs uint32 token counts; n_lanes uint64 states;
n_words uint32 code words.
"""
from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, partitions, path_prefix, read_all, read_slice, spill, trim

MAGIC, HEAD = b"RNB1", struct.Struct("<4sIIIII")
TABLE_MAGIC, TABLE_HEAD = b"RNT1", struct.Struct("<4sII")
BITS, LANES, BLOCK = 20, 2048, 1 << 17
#: Bytes of text that are encoded together, and in one range of ids.
PIECE, RANGE = 6 << 20, 64 << 20
#: How blocks are spilled: in row groups of 8 MB or 32 rows of a quarter of a MB, as the size is that of compressed pages;
#: sizes are looked at from the first row on, not from the hundredth. What writes or reads blocks holds a row group.
SPILL = {"parquet.block.size": str(8 << 20), "parquet.block.row.count.limit": "32", "parquet.page.size.row.check.min": "1"}
LOW = np.uint64(1 << 31)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**BITS; what occurs keeps 1 at least, so that more symbols than that are an error."""
    counts = counts.astype(np.float64)
    if not counts.any():
        return np.zeros(len(counts), np.int64)
    room = 1 << BITS
    if np.count_nonzero(counts) > room:
        raise ValueError(f"more than {room} different symbols")
    f = np.where(counts > 0, np.maximum(1, np.floor(counts * (room / counts.sum()))), 0).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    off, i = room - int(f.sum()), 0
    while off:  # the most frequent symbols give or take what rounding left
        s = order[i % len(order)]
        step = int(np.clip(off, -(f[s] - 1) // 2 if f[s] > 1 else 0, off)) if off < 0 else off
        f[s] += step
        off -= step
        i += 1
    return f


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
        """(states, code words)"""
        lanes = max(1, min(lanes, len(ids)))
        x, out = np.full(lanes, LOW, np.uint64), []
        shift, low32 = np.uint64(63 - BITS), np.uint64(0xFFFFFFFF)
        for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
            s = ids[at : at + lanes]
            f, y = self.freq[s], x[: len(s)]
            full = y >= f << shift
            out.append((y[full] & low32).astype(np.uint32))
            y = np.where(full, y >> np.uint64(32), y)
            q = y // f
            x[: len(s)] = (q << np.uint64(BITS)) + (y - q * f) + self.start[s]
        return x, np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)

    def decode(self, n: int, x: np.ndarray, words: np.ndarray) -> np.ndarray:
        x, out, used, lanes = x.copy(), np.empty(n, np.uint32), 0, len(x)
        mask, words = np.uint64((1 << BITS) - 1), words.astype(np.uint64)
        for at in range(0, n, lanes):
            y = x[: n - at]
            low = y & mask
            s = self.slot[low]
            out[at : at + lanes] = s
            y = self.freq[s] * (y >> np.uint64(BITS)) + low - self.start[s]
            short = np.flatnonzero(y < LOW)
            y[short] = (y[short] << np.uint64(32)) | words[used : used + len(short)]
            used += len(short)
            x[: len(y)] = y
        if used != len(words) or (x != LOW).any():
            raise ValueError("a block does not decode to its end")
        return out


def pack_block(coder: Coder, ids: np.ndarray, doc_ids: np.ndarray, null: np.ndarray, sizes: np.ndarray) -> bytes:
    x, words = coder.encode(ids)
    body = b"".join((doc_ids.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), sizes.astype("<u4").tobytes(), x.astype("<u8").tobytes(), words.astype("<u4").tobytes()))
    return HEAD.pack(MAGIC, len(sizes), len(ids), len(x), len(words), zlib.crc32(body)) + body


def unpack_block(coder: Coder, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, doc_ids, null, sizes)"""
    magic, docs, n, lanes, n_words, crc = HEAD.unpack_from(raw)
    body = memoryview(raw)[HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("a block is damaged")
    at, parts = 0, []
    for kind, k in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u8", lanes), ("<u4", n_words)):
        parts.append(np.frombuffer(body, kind, k, at))
        at += parts[-1].nbytes
    return coder.decode(n, parts[3], parts[4]), parts[0], parts[1], parts[2]


def ragged_take(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs flat[starts[i] : starts[i] + sizes[i]] for i in which, one after another."""
    n = sizes[which]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class BatchEncoder:
    """The tokenizers library over a byte-level BPE file, asked for the distinct words of a batch of texts but those
    that recent batches had.

    By the pattern of such files no pre-token reaches over a lone space or line end between other
    characters, or over a full stop or comma that ends a word after a letter. So a text is the join of its
    words' encodings, but for texts with neighbouring white space or special tokens, which are encoded
    whole. Words are handed over many at a time, with a line end or a special token between them to tell
    their ids apart.
    """

    def __init__(self, path: str, most_held: int = 800_000):
        from tokenizers import Tokenizer

        self.most = most_held
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        self.by_word = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and bool(spec["added_tokens"])
        self.lib = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.dtype = np.uint16 if self.lib.get_vocab_size() <= 1 << 16 else np.uint32
        self.held = (pa.array([], pa.string()), np.zeros(0, self.dtype), np.zeros(0, np.int64))
        if self.by_word:
            self.mark, self.mark_id = next(iter(self.special.items()))
            self.stop, self.comma, self.line = self._one("."), self._one(","), self._one("\n")

    def _one(self, text: str) -> int:
        (out,) = self.lib.encode(text, add_special_tokens=False).ids
        return out

    def _ask(self, texts: list[str], spaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, numbers of ids); no text holds a special token, and spaced ones, which begin with a space, no line end."""
        mark, mark_id = ("\n", self.line) if spaced else (self.mark, self.mark_id)
        flat, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), 5000):
            ids = np.array(self.lib.encode_batch_fast([mark.join(texts[at : at + 5000])], add_special_tokens=False)[0].ids, self.dtype)
            cut = np.flatnonzero(ids == mark_id)
            sizes.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
            flat.append(ids[ids != mark_id])
        return np.concatenate(flat), np.concatenate(sizes)

    def _recall(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of runs, numbers of ids, the run of each text) of distinct texts that begin with a space."""
        held, flat, sizes = self.held
        # the hash table is of texts, not of all that is held: it takes memory and time by the batch
        at = pc.index_in(held, value_set=texts)
        met = np.flatnonzero(np.asarray(at.is_valid()))
        which = np.full(len(texts), -1, np.int64)
        which[np.asarray(at.take(pa.array(met)))] = met
        new = which < 0
        fresh = texts.filter(pa.array(new))
        more, more_sizes = self._ask(fresh.to_pylist(), spaced=True)
        which[new] = len(sizes) + np.arange(len(more_sizes))
        flat, sizes = np.concatenate([flat, more]), np.concatenate([sizes, more_sizes])
        if len(sizes) <= self.most:
            self.held = (pa.concat_arrays([held, fresh]), flat, sizes)
        else:
            self.held = (texts, ragged_take(flat, np.cumsum(sizes) - sizes, sizes, which), sizes[which])
        return flat, sizes, which

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, self.dtype) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, self.dtype), *ids]), np.array([len(x) for x in ids], np.int64)

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, numbers of ids, sound) of distinct words that follow a space, which is left out, or begin with a line end."""
        flag = lambda x: np.asarray(x, bool)
        starts_line = flag(pc.starts_with(words, "\n"))
        inner = pc.if_else(pa.array(starts_line), pc.utf8_slice_codeunits(words, 1), words)
        sound = flag(pc.equal(inner, pc.utf8_trim_whitespace(inner))) & flag(pc.not_equal(inner, ""))
        comma = flag(pc.ends_with(words, ","))
        ended = np.flatnonzero((comma | flag(pc.ends_with(words, "."))) & sound)
        ended = ended[flag(pc.utf8_is_alpha(pc.utf8_slice_codeunits(inner.take(pa.array(ended)), -2, -1)))]
        ended = np.bincount(ended, minlength=len(words)).astype(bool)
        base = pc.if_else(pa.array(ended), pc.utf8_slice_codeunits(words, 0, -1), words)
        base = pc.if_else(pa.array(starts_line), base, pc.binary_join_element_wise(" ", base, ""))
        coded = base.filter(pa.array(sound)).dictionary_encode()
        bases = coded.dictionary
        at_line = flag(pc.starts_with(bases, "\n"))
        flat, sizes, runs = self._recall(bases.filter(pa.array(~at_line)))
        line_flat, line_sizes = self._ask(bases.filter(pa.array(at_line)).to_pylist())
        flat, own_sizes = np.concatenate([flat, line_flat]), np.concatenate([sizes, line_sizes])
        number = np.empty(len(bases), np.int64)
        number[~at_line] = runs
        number[at_line] = len(sizes) + np.arange(len(line_sizes))
        which = number[np.asarray(coded.indices, np.int64)]
        total = ended.astype(np.int64)
        total[sound] += own_sizes[which]
        to = np.cumsum(total)
        out = np.empty(int(to[-1]) if len(to) else 0, self.dtype)
        body = np.ones(len(out), bool)
        body[to[ended] - 1] = False
        out[~body] = np.where(comma[ended], self.comma, self.stop)
        out[body] = ragged_take(flat, np.cumsum(own_sizes) - own_sizes, own_sizes, which)
        return out, total, sound

    def compile(self, texts: pa.Array) -> Batch:
        n = len(texts)
        plain = np.full(n, bool(self.by_word))
        for s in self.special:
            plain &= ~np.asarray(pc.match_substring(texts, s))
        rows = np.flatnonzero(plain)
        # a line end becomes the first character of the word after it
        lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(rows)), "\n", " \n"), " ")
        offsets = np.asarray(lists.offsets)
        offsets = offsets - offsets[0]
        words = lists.flatten()
        leads = np.zeros(len(words), bool)
        leads[offsets[:-1]] = True
        firsts = words.filter(pa.array(leads)).to_pylist()
        coded = words.filter(pa.array(~leads)).dictionary_encode()
        index = np.asarray(coded.indices)
        flat, sizes, sound = self._distinct(coded.dictionary)
        unsound = np.zeros(len(words), bool)
        unsound[~leads] = ~sound[index]
        bad = np.zeros(len(rows), bool)
        if len(words):
            bad = np.logical_or.reduceat(unsound, offsets[:-1])
        bad |= np.array([bool(f) and (f[-1].isspace() or f[0].isspace()) for f in firsts], bool) if firsts else bad
        first_flat, first_sizes = self._ask([f if not x else "" for f, x in zip(firsts, bad)]) if firsts else self._whole([])
        alone = np.concatenate([np.flatnonzero(~plain), rows[bad]])
        whole_flat, whole_sizes = self._whole(texts.take(pa.array(alone)).to_pylist())
        # entries: distinct words, then first words, then whole texts; each text's entries in order
        seq = np.empty(len(words), np.int32)
        seq[~leads] = index
        seq[leads] = len(sizes) + np.arange(len(rows))
        counts = np.ones(n, np.int64)
        counts[rows[~bad]] = np.diff(offsets)[~bad]
        starts = np.concatenate([[0], np.cumsum(counts)])
        if len(alone):
            alone_at = np.zeros(starts[-1], bool)
            alone_at[starts[np.sort(alone)]] = True
            mixed = np.empty(starts[-1], np.int32)
            mixed[~alone_at] = seq[np.repeat(~bad, np.diff(offsets))]
            mixed[alone_at] = len(sizes) + len(first_sizes) + np.argsort(alone, kind="stable")
            seq = mixed
        return Batch(np.concatenate([flat, first_flat, whole_flat]), np.concatenate([sizes, first_sizes, whole_sizes]), seq, starts)

    def encode(self, texts: list[str]) -> list[list[int]]:
        batch = self.compile(pa.array(texts, pa.string()))
        ends = np.cumsum(batch.counts)
        return [x.tolist() for x in np.split(batch.tokens(0, len(texts)), ends[:-1])] if texts else []


class Batch:
    """Texts as runs of entries: entries' ids one after another, their numbers, and each text's entries."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, seq: np.ndarray, offsets: np.ndarray):
        self.flat, self.sizes, self.seq, self.offsets = flat, sizes, seq, offsets
        self.starts = np.cumsum(sizes) - sizes
        upto = np.concatenate([[0], np.cumsum(sizes[seq])])
        self.counts = upto[offsets[1:]] - upto[offsets[:-1]]

    def tokens(self, a: int, b: int) -> np.ndarray:
        return ragged_take(self.flat, self.starts, self.sizes, self.seq[self.offsets[a] : self.offsets[b]])


_loaded: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """The worker's own for path. A nested function that a task runs comes with copies of the globals it names, so one
    that named _loaded would load the file again in every task; this one is found in the module."""
    if path not in _loaded:
        _loaded[path] = BatchEncoder(path)
    return _loaded[path]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    upto, lo = np.cumsum(np.asarray(pc.binary_length(batch.column(1)), np.int64)), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PIECE, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def token_blocks(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """(part, block, n, doc_ids, nulls, sizes, tokens, hist, width): blocks of whole documents in ascending id order over (part, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, no = encoder(path), TaskContext.get().partitionId(), 0
        for b in (piece for batch in batches for piece in _pieces(batch)):
            ids = b.column(0)
            null, ids = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
            got = enc.compile(b.column(1))
            upto, at, hist = np.cumsum(got.counts + 1), 0, np.zeros(0, np.int64)
            while at < b.num_rows:
                base = upto[at - 1] if at else 0
                to = min(b.num_rows, max(at + 1, int(np.searchsorted(upto, base + block, "left")) + 1))
                sizes = got.counts[at:to] + 1
                ends = np.cumsum(sizes)
                toks = np.insert(got.tokens(at, to), ends - 1 - np.arange(len(ends)), enc.dtype(end_id))
                n = np.bincount(toks, minlength=len(hist))
                n[: len(hist)] += hist
                hist = n
                seen = np.flatnonzero(hist) if to == b.num_rows else []  # a batch's counts go with its last block
                cols = [ids[at:to], null[at:to].astype(np.uint8), sizes.astype(np.uint32), toks, np.array([seen, hist[seen]], np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([no], pa.int64()), pa.array([len(toks)], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cols), pa.array([enc.dtype().itemsize], pa.int32())], names)
                at, no = to, no + 1
            del got
            trim()

    names = ["part", "block", "n", "doc_ids", "nulls", "sizes", "tokens", "hist", "width"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # ranges of about RANGE bytes: the more a task encodes, the fewer words of it are new
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    rows = rows.repartitionByRange(max(1, -(-size // RANGE)), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return rows.mapInArrow(run, "part long, block long, n long, doc_ids binary, nulls binary, sizes binary, tokens binary, hist binary, width int")


def _kind(width: int):
    return np.uint16 if width == 2 else np.uint32


def count_tokens(blocks: DataFrame) -> np.ndarray:
    """Counts of all token ids; their number is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                token, n = np.frombuffer(raw.as_buffer(), np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], ["token", "n"])

    rows = blocks.select("hist").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.token for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.token] = r.n
    return out


def write_files(blocks: DataFrame, freq: np.ndarray, folder: str) -> DataFrame:
    """Codes the blocks into one file a task; the manifest (path, offset, bytes, part, block, n)."""
    shared = blocks.sparkSession.sparkContext.broadcast(freq)
    prefix = path_prefix(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        coder, out, at, rows = Coder(shared.value), None, 0, []
        name = f"{root}/{uuid.uuid4().hex}.rans"
        for b in batches:
            for r in range(b.num_rows):
                part, no, n, ids, null, sizes, toks, _, width = (c[r] for c in b.columns)
                raw = pack_block(coder, np.frombuffer(toks.as_buffer(), _kind(width.as_py())), np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(null.as_buffer(), np.uint8), np.frombuffer(sizes.as_buffer(), np.uint32))
                out = out or store.open_output_stream(name, compression=None)
                out.write(raw)
                rows.append((prefix + name, at, len(raw), part.as_py(), no.as_py(), n.as_py()))
                at += len(raw)
            trim()
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "offset", "bytes", "part", "block", "n"])

    return blocks.withColumn("hist", F.lit(None).cast("binary")).mapInArrow(run, "path string, offset long, bytes long, part long, block long, n long")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds first: tokens before the block in id order, by a sum over parts and one within each part."""
    parts = manifest.groupBy("part").agg(F.sum("n").alias("pn"))
    parts = parts.withColumn("before", F.coalesce(F.sum("pn").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("inner", inner).join(parts.select("part", "before"), "part").withColumn("first", F.col("before") + F.col("inner")).drop("inner", "before")


def write_table(freq: np.ndarray, folder: str) -> str:
    """The frequency table as a file; its path."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    body = freq.astype("<u4").tobytes()
    with store.open_output_stream(f"{root}/table.freq", compression=None) as f:
        f.write(TABLE_HEAD.pack(TABLE_MAGIC, len(freq), zlib.crc32(body)) + body)
    return f"{path_prefix(folder)}{root}/table.freq"


def read_table(path: str) -> np.ndarray:
    raw = read_all(path)
    magic, n, crc = TABLE_HEAD.unpack_from(raw)
    body = raw[TABLE_HEAD.size :]
    if magic != TABLE_MAGIC or len(body) != 4 * n or zlib.crc32(body) != crc:
        raise ValueError("the frequency table is damaged")
    return np.frombuffer(body, "<u4").astype(np.int64)


def read_files(manifest: DataFrame, table: str, with_ids: bool = False) -> DataFrame:
    """Decodes blocks at their checkpoints by the table beside them: doc_id, start, n_tokens, ids_crc32 and with with_ids the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(read_table(table))
        for b in batches:
            for path, offset, size, first in zip(*(c.to_pylist() for c in b.columns)):
                ids, docs, null, sizes = unpack_block(coder, read_slice(path, offset, size))
                ends = np.cumsum(sizes, dtype=np.int64)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                cols = [pa.array(docs, pa.int64(), mask=null.astype(bool)), pa.array(first + ends - sizes, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    spread = manifest.select("path", "offset", "bytes", "first").repartition(partitions(manifest.sparkSession))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def round_trip(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes each text, appends end_id, writes the files and reads them back.

    Null text is empty and has the end id alone; null ids come first in order and come back null; rows that
    repeat an id follow each other, ordered by a hash of the text. A block has whole documents: one of any
    length is a block by itself. An empty table gives an empty result. Other columns are not read. path must name the tokenizer's file on the executors.
    """
    blocks = spill(token_blocks(docs, path, end_id, id_col, text_col), "rans-tokens", "lz4", SPILL)
    freq = frequencies(count_tokens(blocks))
    folder = new_path(docs.sparkSession, "rans")
    table = write_table(freq, folder)
    manifest = spill(write_files(blocks, freq, folder), "rans-manifest")
    return read_files(with_starts(manifest), table, with_ids)
