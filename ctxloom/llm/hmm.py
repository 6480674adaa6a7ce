"""Language-model scores by a hidden Markov model.

Every training word is a symbol with emissions of its own, and so is the end of a text. Texts are coded once
into blocks, which are files in the shared folder: the block's words in the order of their crc32, and the
texts as numbers of those words. Words are dealt to parts by ranges of that crc32. In each Baum-Welch pass a
block sends every part, in one row, how the expected counts of its words are shared among the states; a part
sums what the blocks sent, word by word, and answers each block with the count and the shares of its words.
Shares are rounded to 16 bits, and the normalising totals are those of the rounded shares, so that the
emissions of a state sum to one. No task and no driver holds the vocabulary. A text's probability is exact,
by the scaled forward recursion over the whole text.
"""
from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, forget_shuffles, new_path, partitions, path_prefix, read_slice, remove, spill, spill_to, trim

#: Hidden states; passes; cells of a training batch held at once; bytes of text in a block; words of blocks in a part.
STATES, PASSES, CELLS, BLOCK, PAIRS = 8, 5, 1 << 20, 48 << 20, 250_000
#: Added to each count in the base model, and the count of an unknown word; weight of the unigram share in each state's emissions.
ADD, PRIOR = 0.1, 50.0
#: What a share of one is rounded to.
SCALE = (1 << 16) - 1


def words_of(text: str | None) -> list[bytes]:
    """Words in ASCII lower case."""
    return (text or "").encode().lower().split()


@dataclass
class Hmm:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states

    @staticmethod
    def begin(unigram: np.ndarray, states: int) -> Hmm:
        """Sticky moves, and emissions disturbed by a fixed seed."""
        noise = np.exp(np.random.default_rng(7).standard_normal((len(unigram), states)))
        emit = unigram[:, None] * noise
        return Hmm(np.full(states, 1 / states), np.full((states, states), 0.05 / max(1, states - 1)) * (1 - np.eye(states)) + (0.95 if states > 1 else 1) * np.eye(states), emit / emit.sum(0))

    @staticmethod
    def of(start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Hmm:
        """From expected counts."""
        emit = emit + PRIOR * unigram[:, None]
        move, start = move + 0.1, start + 0.1
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each sequence: scaled forward recursion, longest sequences first."""
        out = np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        order = [i for i in order if len(texts[i])]
        if not order:
            return out
        flat = np.concatenate([texts[i] for i in order])
        sizes = np.array([len(texts[i]) for i in order])
        at = np.cumsum(sizes) - sizes
        live, total = len(order), np.zeros(len(order))
        a = np.tile(self.start, (live, 1))
        ones = np.ones(len(self.start))
        for t in range(sizes[0]):
            while sizes[live - 1] <= t:
                live -= 1
            a = (a[:live] @ self.move if t else a) * self.emit[flat[at[:live] + t]]
            c = a @ ones
            total[:live] += np.log(c)
            a /= c[:, None]
        out[order] = total
        return out

    def _forward(self, e: np.ndarray, live: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward messages of some steps (e: their emissions) and their scales; before: the message of the step before."""
        a, c = np.zeros_like(e), np.ones(e.shape[:2], e.dtype)
        ones, move = np.ones(e.shape[2], e.dtype), self.move.astype(e.dtype)
        for t, n in enumerate(live.tolist()):
            last = a[t - 1] if t else before
            x = (np.tile(self.start.astype(e.dtype), (n, 1)) if last is None else last[:n] @ move) * e[t, :n]
            c[t, :n] = np.maximum(x @ ones, 1e-30)
            a[t, :n] = x / c[t, :n, None]
        return a, c

    def expect(self, obs: np.ndarray, sizes: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts (start, move, emit) of a batch of texts; obs is time x texts, longest first. Messages of about
        cells tokens are held at once: those of the steps before are worked out again from kept ones on the way back."""
        steps, lanes = obs.shape
        s = len(self.start)
        live = np.array([int(np.searchsorted(-sizes, -t, "left")) for t in range(steps)])  # texts longer than t
        kind = np.float32
        emit, span = self.emit.astype(kind, copy=False), max(1, cells // lanes)
        marks, kept = [None], None
        for at in range(0, steps, span):
            e = emit[obs[at : at + span]]
            kept = (e, *self._forward(e, live[at : at + span], marks[-1]))
            marks.append(kept[1][-1].copy())
        start, trans, counts = np.zeros(s), np.zeros((s, s)), np.zeros((len(self.emit), s))
        b = np.ones((lanes, s), kind)
        back = np.ascontiguousarray(self.move.T.astype(kind))
        for no in range(len(marks) - 2, -1, -1):
            at = no * span
            if kept is None:
                e = emit[obs[at : at + span]]
                kept = (e, *self._forward(e, live[at : at + span], marks[no]))
            e, a, c = kept
            for t in range(len(e) - 1, -1, -1):
                n = live[at + t]
                g = a[t, :n] * b[:n]
                if at + t:
                    w = e[t, :n] * b[:n] / c[t, :n, None]
                    trans += (a[t - 1, :n] if t else marks[no][:n]).T @ w
                    b[:n] = w @ back
                else:
                    start += g.sum(0)
                a[t, :n] = g  # from here on a holds the posteriors
            here = np.arange(lanes) < live[at : at + len(e), None]
            flat, post = obs[at : at + len(e)][here], a[here]
            for k in range(s):
                counts[:, k] += np.bincount(flat, weights=post[:, k], minlength=len(counts))
            kept = None
        return start, trans * self.move, counts


def batches_of(texts: list[np.ndarray], cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(time x texts, sizes) of whole texts, longest first."""
    texts = sorted(texts, key=len, reverse=True)
    at = 0
    while at < len(texts):
        some = texts[at : at + max(1, cells // len(texts[at]))]
        obs = np.zeros((len(some[0]), len(some)), np.uint32)
        for k, x in enumerate(some):
            obs[: len(x), k] = x
        yield obs, np.array([len(x) for x in some])
        at += len(some)


def noise(seeds: np.ndarray, states: int) -> np.ndarray:
    """exp of a standard normal number for each (seed, state), the same wherever it is computed."""
    with np.errstate(over="ignore"):
        x = seeds.view(np.uint64)[:, None] + np.arange(1, 2 * states + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.exp(np.sqrt(-2 * np.log1p(-u[:, :states])) * np.cos(2 * np.pi * u[:, states:]))


def _round(weights: np.ndarray) -> np.ndarray:
    """Rows as shares of their sum, rounded; rows without a weight stay zero."""
    total = weights.sum(1, keepdims=True)
    return np.rint(weights * (SCALE / np.where(total > 0, total, 1))).astype(np.uint16)


def emissions(n: np.ndarray, shares: np.ndarray, totals: np.ndarray, whole: float) -> np.ndarray:
    """Words x states: n times the shares and PRIOR times the unigram share, normalised by state."""
    return (n[:, None] * (shares / SCALE) + (PRIOR / whole) * np.where(n > 0, n, ADD)[:, None]) / (totals + PRIOR)


_COLUMNS = ["ids", "sizes", "doc_ids", "null", "held", "words", "crc", "n"]
_KINDS = {"ids": np.uint32, "sizes": np.int64, "doc_ids": np.int64, "null": np.uint8, "held": np.uint8, "crc": np.uint32, "n": np.int64}


def _code(texts: list[str | None], doc_ids: pa.Array, held: np.ndarray) -> tuple[bytes, int]:
    """A block and its number of words: word numbers of each text with the end (the empty word) after them; words by crc32; their counts in training texts."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    end = np.array([number[b""]], np.uint32)
    runs, sizes = [], []
    for t in texts:
        ws = words_of(t)
        runs += [np.fromiter(map(number.__getitem__, ws), np.uint32, len(ws)), end]
        sizes.append(len(ws) + 1)
    words = list(number)
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    order = np.argsort(crc, kind="stable")
    place = np.empty(len(words), np.uint32)
    place[order] = np.arange(len(words))
    ids, sizes = place[np.concatenate(runs)], np.array(sizes, np.int64)
    n = np.bincount(ids[np.repeat(held == 0, sizes)], minlength=len(words))
    cols = [ids, sizes, np.asarray(doc_ids.fill_null(0)), np.asarray(doc_ids.is_null()).astype(np.uint8), held, b" ".join([words[i] for i in order.tolist()]), crc[order], n]
    batch = pa.RecordBatch.from_arrays([pa.array([c if isinstance(c, bytes) else c.tobytes()], pa.binary()) for c in cols], _COLUMNS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes(), len(words)


def _open(at: tuple[str, int, int], *names: str) -> list:
    """Columns of a block."""
    table = pa.ipc.open_stream(read_slice(*at), options=pa.ipc.IpcReadOptions(included_fields=[_COLUMNS.index(n) for n in names])).read_all()
    raw = {n: table.column(n)[0].as_buffer() for n in names}
    return [raw[n].to_pybytes() if n == "words" else np.frombuffer(raw[n], _KINDS[n]) for n in names]


def write_blocks(rows: DataFrame, folder: str, block: int) -> DataFrame:
    """The manifest (block, path, offset, bytes, words) of rows (doc_id, held_out, text) coded into blocks of about block bytes of text."""
    prefix = path_prefix(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, made, at = f"{root}/{uuid.uuid4().hex}.blocks", None, [], 0
        no = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            nonlocal out, at, no
            part = pa.Table.from_batches(held).combine_chunks()
            raw, words = _code(part.column(2).to_pylist(), part.column(0).combine_chunks(), np.asarray(part.column(1).combine_chunks()).astype(np.uint8))
            out = out or store.open_output_stream(name, compression=None)
            out.write(raw)
            made.append((no, prefix + name, at, len(raw), words))
            at, no = at + len(raw), no + 1
            held.clear()
            trim()

        size = 0
        for b in batches:
            sizes = np.nan_to_num(np.asarray(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False), float))
            upto, lo = np.cumsum(sizes), 0
            while lo < b.num_rows:
                base = upto[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(upto, base + block - size, "right")))
                held.append(b.slice(lo, hi - lo))
                size += upto[hi - 1] - base
                lo = hi
                if size >= block or lo < b.num_rows:
                    flush()
                    size = 0
        if held:
            flush()
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], ["block", "path", "offset", "bytes", "words"])

    return rows.mapInArrow(run, "block long, path string, offset long, bytes long, words long")


#: What a part answers: for a block, its words' counts and shares; with a null block, the part's sums (totals of the
#: states, tokens, types, starts, moves) and the path of what it keeps.
STATE = "block long, part int, n binary, shares binary, sums array<double>, path string"


def _answers(part: int, blocks: list[int], where: list[np.ndarray], n: np.ndarray, shares: np.ndarray, other: np.ndarray, path: str) -> pa.Table:
    totals = (n[:, None] * (shares / SCALE)).sum(0)
    sums = np.concatenate([totals, [n.sum(), (n > 0).sum()], other])
    cols = [[*blocks, None], [part] * (len(blocks) + 1), [*(n[w].tobytes() for w in where), None], [*(shares[w].tobytes() for w in where), None], [*([None] * len(blocks)), sums.tolist()], [*([None] * len(blocks)), path]]
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.string())
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["block", "part", "n", "shares", "sums", "path"])


def first_state(manifest: DataFrame, folder: str, parts: int, states: int, spread: int) -> DataFrame:
    """STATE rows before the first pass: counts over all blocks and shares from noise. Each part keeps a file that says
    which of its words each block's words are."""
    prefix = path_prefix(folder)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, *at in zip(*(c.to_pylist() for c in b.columns)):
                words, crc, n = _open(at, "words", "crc", "n")
                words, p = words.split(b" "), ((crc.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
                edge = [*np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])).tolist(), len(p)]
                rows = [(block, int(p[x]), b" ".join(words[x:y]), n[x:y].tobytes()) for x, y in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "part", "words", "n"])
                del words, rows
                trim()

    def count(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        part, blocks = t.column("part")[0].as_py(), t.column("block").to_pylist()
        cut = [w.as_py().split(b" ") for w in t.column("words")]
        mine = [np.frombuffer(x.as_buffer(), np.int64) for x in t.column("n")]
        coded = pa.array([w for ws in cut for w in ws], pa.binary()).dictionary_encode()
        index, words = np.asarray(coded.indices), coded.dictionary.to_pylist()
        where = np.split(index, np.cumsum([len(ws) for ws in cut])[:-1])
        n = np.bincount(index, weights=np.concatenate(mine)).astype(np.int64)
        shares = _round(noise(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), states) * (n > 0)[:, None])
        del cut, coded, words
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}.part"
        with store.open_output_stream(name, compression=None) as f, pa.ipc.new_stream(f, _KEPT, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([x.astype(np.int32).tobytes() for x in where], pa.binary()), pa.array([x.tobytes() for x in mine], pa.binary())], schema=_KEPT))
        out = _answers(part, blocks, where, n, shares, np.zeros(states + states**2), prefix + name)
        trim()
        return out

    dealt = manifest.select("block", "path", "offset", "bytes").repartition(partitions(manifest.sparkSession)).mapInArrow(deal, "block long, part int, words binary, n binary")
    return dealt.repartition(spread, "part").groupBy("part").applyInArrow(count, STATE)


_KEPT = pa.schema([("block", pa.int64()), ("where", pa.binary()), ("n", pa.binary())])


def _by_block(state: DataFrame, manifest: DataFrame, spread: int):
    """What the parts answered, grouped by block, with a further row of part -1 that says where the block is."""
    at = manifest.select("block", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("n"), F.lit(None).cast("binary").alias("shares"), F.struct("path", "offset", "bytes").alias("at"))
    return state.filter("block is not null").select("block", "part", "n", "shares", F.lit(None).cast("struct<path:string,offset:bigint,bytes:bigint>").alias("at")).unionByName(at).repartition(spread, "block").groupBy("block")


def _gather(t: pa.Table, states: int) -> tuple[tuple[str, int, int], list[int], list[int], np.ndarray, np.ndarray]:
    """Of a block: where it is, its parts, its number of words in each, and all its words' counts and shares in order."""
    t = t.sort_by("part")
    at = tuple(t.column("at")[0].as_py().values())
    t = t.slice(1)
    n = [np.frombuffer(x.as_buffer(), np.int64) for x in t.column("n")]
    shares = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in t.column("shares")]).reshape(-1, states)
    return at, t.column("part").to_pylist(), [len(x) for x in n], np.concatenate(n), shares


def next_state(state: DataFrame, manifest: DataFrame, start: np.ndarray, move: np.ndarray, totals: np.ndarray, whole: float, cells: int, spread: int) -> DataFrame:
    """STATE rows after a Baum-Welch pass over the training texts of all blocks."""
    states = len(start)

    def expect(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        at, parts, many, n, shares = _gather(t, states)
        ids, sizes, held, mine = _open(at, "ids", "sizes", "held", "n")
        model = Hmm(start, move, emissions(n, shares, totals, whole).astype(np.float32))
        sums, counts = np.zeros(states + states**2), np.zeros((len(n), states))
        texts = [x for x, h in zip(np.split(ids, np.cumsum(sizes)[:-1]), held.tolist()) if not h]
        for obs, lengths in batches_of(texts, cells):
            a, b, c = model.expect(obs, lengths, cells)
            sums += np.concatenate([a, b.ravel()])
            counts += c
        counts[mine == 0] = 0
        out = _round(counts)
        cut = np.cumsum([0, *many])
        cols = [parts, [block] * len(parts), [out[x:y].tobytes() for x, y in zip(cut, cut[1:])], [sums.tolist(), *([None] * (len(parts) - 1))], [None] * len(parts)]
        del model, counts, out, texts, ids
        trim()
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.float64()), pa.string()))], names=["part", "block", "shares", "sums", "path"])

    def add(t: pa.Table) -> pa.Table:
        path = next(p for p in t.column("path").to_pylist() if p is not None)
        store, name = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        with store.open_input_stream(name, compression=None) as f:
            kept = pa.ipc.open_stream(f).read_all()
        where = [np.frombuffer(x.as_buffer(), np.int32) for x in kept.column("where")]
        mine = [np.frombuffer(x.as_buffer(), np.int64) for x in kept.column("n")]
        blocks = kept.column("block").to_pylist()
        sent = {b: np.frombuffer(x.as_buffer(), np.uint16).reshape(-1, states) for b, x in zip(t.column("block").to_pylist(), t.column("shares")) if x.is_valid}
        n = np.zeros(1 + max(int(w.max()) for w in where), np.int64)
        counts = np.zeros((len(n), states))
        for b, w, m in zip(blocks, where, mine):  # a block has a word once
            n[w] += m
            counts[w] += m[:, None] * (sent[b] / SCALE)
        other = sum((np.array(x) for x in t.column("sums").to_pylist() if x is not None), np.zeros(states + states**2))
        out = _answers(t.column("part")[0].as_py(), blocks, where, n, _round(counts), other, path)
        del sent, counts
        trim()
        return out

    sent = _by_block(state, manifest, spread).applyInArrow(expect, "part int, block long, shares binary, sums array<double>, path string")
    kept = state.filter("block is null").select("part", F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("shares"), F.lit(None).cast("array<double>").alias("sums"), "path")
    return sent.unionByName(kept).repartition(spread, "part").groupBy("part").applyInArrow(add, STATE)


def _sums(state: DataFrame, states: int) -> tuple[np.ndarray, int, int, np.ndarray, np.ndarray]:
    """Over all parts: totals of the states, tokens, types, starts and moves."""
    rows = state.filter("block is null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()  # as many as a state row has
    x = np.zeros(2 * states + 2 + states**2)
    for r in rows:
        x[r["at"]] = r["x"]
    return x[:states], int(x[states]), int(x[states + 1]), x[states + 2 : 2 * states + 2], x[2 * states + 2 :].reshape(states, states)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held: int = 0, states: int = STATES, passes: int = PASSES, block: int = BLOCK, pairs: int = PAIRS, cells: int = CELLS) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id) modulo folds is not held (a null id counts as empty text). Null and
    empty texts are the end token alone; a text of any length is trained on and scored whole, with messages of
    about cells of its words held at once; repeated rows each get their row and count each time, and rows with
    equal texts have equal scores. With no training row every token is unknown. An empty table gives an empty
    result. Other columns are not read.
    """
    spark = docs.sparkSession
    mod = crc_mod(F.col(id_col), folds)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (mod == held).alias("held_out"), F.col(text_col).alias("text"))
    folder = new_path(spark, "hmm")
    manifest = spill(write_blocks(rows, folder, block), "hmm-manifest")
    blocks, many = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
    parts = max(1, -(-many // pairs))
    spread = max(partitions(spark), blocks, parts)  # tasks follow the data, whatever the number of shuffle partitions
    at = new_path(spark, "hmm-state")
    state = spill_to(first_state(manifest, folder, parts, states, spread), at)
    totals, n, v, _, _ = _sums(state, states)
    whole = n + ADD + (0 if n else ADD)  # with an unknown word
    base_all = float(np.log10(n + ADD * (v + 1)))
    start = np.full(states, 1 / states)
    move = np.full((states, states), 0.05 / max(1, states - 1)) * (1 - np.eye(states)) + (0.95 if states > 1 else 1) * np.eye(states)
    for _ in range(passes if n else 0):
        last, at = at, new_path(spark, "hmm-state")
        state = spill_to(next_state(state, manifest, start, move, totals, whole, cells, spread), at)
        totals, _, _, start, move = _sums(state, states)
        start, move = start + 0.1, move + 0.1
        start, move = start / start.sum(), move / move.sum(1, keepdims=True)
        # what the pass has read and exchanged is no longer needed: let Spark drop its shuffle files too
        remove(spark, last)
        forget_shuffles(spark)

    def forward(t: pa.Table) -> pa.Table:
        at, _, _, n, shares = _gather(t, states)
        ids, sizes, doc_ids, null, held = _open(at, "ids", "sizes", "doc_ids", "null", "held")
        texts = np.split(ids, np.cumsum(sizes)[:-1])
        score = Hmm(start, move, emissions(n, shares, totals, whole)).score(texts) / np.log(10)
        first = np.cumsum(sizes) - sizes
        known = np.add.reduceat((n > 0)[ids].astype(np.int64), first)
        base = np.add.reduceat((np.log10(n + ADD) - base_all)[ids], first)
        out = pa.table([pa.array(doc_ids, pa.int64(), mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        del texts, ids
        trim()
        return out

    scored = _by_block(state, manifest, spread).applyInArrow(forward, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
