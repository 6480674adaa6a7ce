"""BPE encoding and decoding by a pair occurrence index.

Texts are cut at ASCII white space, which no token crosses. Pieces that a worker has met are looked up. The
words of all new pieces of a group of texts are laid out as one array of symbols with links to their
neighbours; an index maps each mergeable pair to all its positions in that array, active ranks are applied
in ascending order, each to all its positions, and every merge updates the lists of the pairs it makes.
Where a merge makes a pair of a lower rank than its own, that word is done again by itself in the order of
the single-word algorithm, so that results are the library's in every case. A partition is read in groups
so that memory stays bounded; one index covers the new words of a group (group_chars of text), or of
MOST_SYMBOLS where a group has more.

The library's own normalizer and pre-tokenizer treat pieces, but for plain Latin ones, where a pattern of
the same meaning does.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts whose normal form is certain: ASCII and precomposed Latin letters.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-į]*")
#: Symbols of the new words that one index covers.
MOST_SYMBOLS = 1 << 21
_NO_IDS = np.zeros(0, np.int32)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else from 256 upwards."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class PairIndexBpe:
    """A word-end BPE of the tokenizers library's file format: Split by a pattern, bytes, merges."""

    def __init__(self, path: str, most_cached: int = 500_000):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("not a BPE file of the kind this operator reads")
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.merge_of = {r: (pair, new) for pair, (r, new) in self.pairs.items()}
        packed = sorted(((a << 32) | b, r) for (a, b), (r, _) in self.pairs.items()) or [(-1, -1)]
        self.keys, self.key_rank = np.array(packed, np.int64).T.copy()
        letters = byte_symbols()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int32)
        self.final = np.array([vocab.get(c + end, -1) for c in letters], np.int32)
        self.bytes_of = {ord(c): b for b, c in enumerate(letters)}
        self.token = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.id_text, self.token_text = {i: f" {i}" for i in self.token}, {i: f" {t}" for i, t in self.token.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        # what is known: pieces between white space, and words; and what was known before the last time it was too much
        self.most, self.with_ids = most_cached, True
        self.known, self.old_known = {}, {}
        self.words, self.old_words = self._start(), {}

    # -- merges
    def _symbols(self, word: bytes) -> list[int]:
        got = self.inner[np.frombuffer(word, np.uint8)].tolist()
        got[-1:] = [int(self.final[word[-1]])]
        return [x for x in got if x >= 0]

    def _alone(self, word: bytes) -> list[int]:
        """One word, least rank first and leftmost first."""
        sym = self._symbols(word)
        n = len(sym)
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(self.pairs[p][0], i) for i in range(n - 1) if (p := (sym[i], sym[i + 1])) in self.pairs]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            pair, new = self.merge_of[rank]
            j = nxt[i]
            if sym[i] != pair[0] or j < 0 or sym[j] != pair[1]:
                continue
            sym[i], sym[j], k = new, -1, nxt[j]
            nxt[i] = k
            if k >= 0:
                prv[k] = i
            for at, p in ((prv[i], (sym[prv[i]], new) if prv[i] >= 0 else None), (i, (new, sym[k]) if k >= 0 else None)):
                if p in self.pairs:
                    heapq.heappush(heap, (self.pairs[p][0], at))
        return [x for x in sym if x >= 0]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word, through one pair occurrence index over all of them."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(words), np.uint8)
        if not len(flat):
            return [[] for _ in words]
        first = self.inner[flat]
        first[ends - 1] = self.final[flat[ends - 1]]
        if (first < 0).any():  # a byte that the vocabulary lacks has no symbol
            return [self._alone(w) for w in words]
        n = len(first)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1], prv[ends - sizes] = -1, -1
        # the index: the positions of each pair that merges, by rank
        at = np.flatnonzero(nxt > 0)
        key = (first[at].astype(np.int64) << 32) | first[at + 1]
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        real = self.keys[spot] == key
        at, rank = at[real], self.key_rank[spot[real]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        edge = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(rank) else []
        index = {int(rank[e]): x.tolist() for e, x in zip(edge, np.split(at, edge[1:]))}
        sym, nxt, prv = first.tolist(), nxt.tolist(), prv.tolist()
        pairs, again = self.pairs, set()
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            at = index.pop(rank, None)
            if at is None:
                continue
            (left, right), new = self.merge_of[rank]
            at.sort()
            for i in at:
                j = nxt[i]
                if sym[i] != left or j < 0 or sym[j] != right:
                    continue
                k, h = nxt[j], prv[i]
                sym[i], sym[j], nxt[i] = new, -1, k
                if k >= 0:
                    prv[k] = i
                    if p := pairs.get((new, sym[k])):
                        if p[0] <= rank:
                            again.add(i)
                        elif p[0] in index:
                            index[p[0]].append(i)
                        else:
                            index[p[0]] = [i]
                            heapq.heappush(active, p[0])
                if h >= 0 and (p := pairs.get((sym[h], new))):
                    if p[0] <= rank:
                        again.add(i)
                    elif p[0] in index:
                        index[p[0]].append(h)
                    else:
                        index[p[0]] = [h]
                        heapq.heappush(active, p[0])
        done = np.array(sym)
        stay = done >= 0
        cut = np.concatenate([[0], np.cumsum(stay)[ends - 1]]).tolist()
        tokens = done[stay].tolist()
        out = [tokens[a:b] for a, b in zip(cut, cut[1:])]
        for w in {int(np.searchsorted(ends, i, "right")) for i in again}:
            out[w] = self._alone(words[w])
        return out

    # -- text
    def _words(self, part: str) -> list[str]:
        """The pre-tokens of a piece without white space or special tokens."""
        if _PLAIN.fullmatch(part):
            return self.pattern.findall(part.lower())
        got = self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(part))
        return [w.translate(self.bytes_of).encode("latin-1").decode() for w, _ in got]

    def _parts(self, part: str) -> list[str]:
        """Pre-tokens of a piece; the special tokens' strings, marked by a leading space, are parts of their own."""
        if part.isascii() and part.isalpha():
            return [part.lower()]
        if self.cut and "<|" in part and self.cut.search(part):
            out: list[str] = []
            for i, x in enumerate(self.cut.split(part)):
                out += [" " + x] if i % 2 else self._words(x) if x else []
            return out
        return self._words(part)

    def decode(self, ids: list[int]) -> str:
        """As the library's decode without a decoder: tokens joined by a space."""
        return " ".join([self.token[i] for i in ids])

    def _start(self) -> dict[str, tuple[str, str, int]]:
        return {" " + t: (f" {i}", f" {t}", 1) for t, i in self.special.items()}

    def learn(self, pieces: list[str]) -> None:
        """Adds pieces, and words that are new in them, to what is known, each as (ids as text, tokens as text,
        number of tokens) with a space before every token. Where that would be too many words, only those used
        since it was last too many stay."""
        cut = [self._parts(p) for p in pieces]
        used = set(chain.from_iterable(cut))
        if len(self.words) + len(used) > self.most:
            self.old_words, self.words = self.words, self._start()
        words, old = self.words, self.old_words
        missing = used.difference(words)
        words.update((w, old[w]) for w in missing.intersection(old))
        fresh = list(missing.difference(old))
        raw = [w.encode() for w in fresh]
        size = np.cumsum([len(w) for w in raw])
        at = 0
        ids, tokens = self.id_text.__getitem__, self.token_text.__getitem__
        while at < len(fresh):  # as many words in one index as have MOST_SYMBOLS
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + MOST_SYMBOLS, "right")))
            words.update((w, ("".join(map(ids, x)), "".join(map(tokens, x)), len(x))) for w, x in zip(fresh[at:to], self.merge(raw[at:to])))
            at = to
        known = self.known
        for p, parts in zip(pieces, cut):
            if len(parts) == 1:
                known[p] = words[parts[0]]
            else:
                got = [words[w] for w in parts]
                known[p] = "".join([g[0] for g in got]), "".join([g[1] for g in got]), sum([g[2] for g in got])

    def encode_texts(self, texts: list[str | None] | pa.Array) -> Iterator[tuple[int, str, str, np.ndarray]]:
        """(number of tokens, ids as text, decoded text, ids) of each text."""
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(col):
            return
        cut = pc.ascii_split_whitespace(pc.fill_null(col.cast(pa.large_string()), ""))
        offsets = np.asarray(cut.offsets)
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.known) + len(pieces) > self.most:
            self.old_known, self.known = self.known, {}
        known, old = self.known, self.old_known
        missing = [p for p in pieces if p not in known]
        known.update((p, old[p]) for p in missing if p in old)
        self.learn([p for p in missing if p not in old])
        ids, text, n = zip(*[known[p] for p in pieces])
        index, offsets = coded.indices, pa.array(offsets - offsets[0], pa.int32())
        count = np.concatenate([[0], np.cumsum(np.array(n)[np.asarray(index)])])
        count = np.diff(count[np.asarray(offsets)])
        empty = pa.scalar("", pa.large_string())
        whole = lambda x: pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array(x, pa.large_string()).take(index)), empty)
        for k, i, t in zip(count.tolist(), whole(ids), whole(text)):
            i = i.as_py()[1:]
            yield k, i, t.as_py()[1:], np.fromstring(i, np.int32, sep=" ") if self.with_ids and k else _NO_IDS


_loaded: dict[str, PairIndexBpe] = {}


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, group_chars: int = 4 << 20) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 and with with_ids the ids.

    Null and empty texts have no tokens; rows with null or repeated ids each get their row; a text of any
    length is encoded whole. An empty table gives an empty result. Other columns are not read. path must
    name the tokenizer's file on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = PairIndexBpe(path)
        bpe = _loaded[path]
        bpe.with_ids = with_ids
        for b in batches:
            col, at = b.column(1), 0
            sizes = np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), float)).cumsum()
            while at < b.num_rows:
                base = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, base + group_chars, "right")))
                n, ids_sha, text_sha, ids = [], [], [], []
                for k, i, t, numbers in bpe.encode_texts(col.slice(at, to - at)):
                    n.append(k)
                    ids_sha.append(hashlib.sha256(i.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(t.encode()).hexdigest())
                    if with_ids:
                        ids.append(numbers)
                out = [b.column(0).slice(at, to - at), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])
                at = to

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
