"""Language-model scores from an Elias-Fano n-gram trie.

The model is an interpolated n-gram model (order `ORDER`) of the training texts. The lowest
order is the base of the contract, (c + 0.5) / (N + 0.5 (V + 1)). A longer context h that
training has seen mixes its own frequencies with the shorter context's probabilities
(Jelinek and Mercer): (1 - l) c(h, w) / c(h) + l P(w | shorter h), with a fixed share l for
each order in `SHORTER`; an unseen context passes the shorter one's on. Every order sums to
one.

No model is held whole anywhere. Documents are dealt by a hash into blocks of about
`BLOCK_BYTES` bytes of text. Each block lists its distinct n-grams of every order as sorted
hashes with their counts in its own training texts, cut by hash range into buckets and
Elias-Fano coded. A bucket meets all blocks' lists of its range, adds up, and sends each block
the totals of the n-grams that it asked for, in the order of its list. The block then builds
the part of the trie that its texts can reach: per level, monotone pointers from contexts to
their successors, successors relative to the context as one monotone Elias-Fano sequence, and
16-bit quantised log probabilities, in a memory-mapped file of the task. Its texts are scored
by successor search within the context's range, from the longest context down; the search
works on the coded levels, by select on their high bits.

What crosses the network grows with the corpus: its words once by block, and some four
bytes for each distinct n-gram of a block. A frequent word or n-gram is one entry per block,
so no key is hot. Nor is a row that repeats: where the copies of one (doc_id, text) would fill
a quarter of a block, they are one row that counts as often as it stands, scored once, and its
score is repeated from a written table by parts of `COPIES` rows. There is a row for each block and bucket that share an n-gram, each of some
hundred bytes beside what it holds: at 30 GB it holds some 400 n-grams, at 1 TB about ten,
from where on blocks should be larger. Hashes of n-grams above order 1 have log2(tokens) + 18
bits.

Defined cases: a null text is as an empty one, which is the end token alone; without
training texts every count is 0 and the base is log10(0.5 / 0.5) = 0 a token; repeated rows
count each; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold, shipped, stored, table
from .words import BLANKS, blocks, mix64

ORDER = 3
#: The shorter context's share at orders 2 and 3.
SHORTER = (0.9, 0.75)
#: Bytes of text in a block, and n-grams in a bucket, on average.
BLOCK_BYTES = 7 << 20
BUCKET_GRAMS = 2_000_000
#: Quantised log10 probabilities: steps of 1/2048 from 0 down to -31.99.
QUANTUM, FLOOR = 2048.0, 65535
EXTRA_BITS = 18
#: What a row weighs beside its text, in bytes; copies of a row that one task gives at a time.
ROW_BYTES = 64
COPIES = 1 << 16
_END = np.uint64(0xD1B54A32D192ED03)
_STEP = np.uint64(0xA0761D6478BD642F)


def _select_table() -> np.ndarray:
    """Place of the k-th one in each byte."""
    out = np.zeros((256, 8), np.uint8)
    for byte in range(256):
        ones = [i for i in range(8) if byte >> i & 1]
        out[byte, : len(ones)] = ones
    return out


_SELECT = _select_table()


class EliasFano:
    """A monotone sequence of n integers under `universe`, in about 2 + log2(universe / n) bits each.

    It is read in its coded form: `access` selects a one of the high bits, `find` selects the
    zeros around a value's high part and halves the low parts between them. The directory that
    both need has a count for each 64 high bits.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._ready = False

    def _prepare(self) -> None:
        if not self._ready:
            pad = np.zeros(-len(self.high) % 8 + 8, np.uint8)
            self._words = np.concatenate([self.high, pad]).view(np.uint64)
            ones = np.bitwise_count(self._words)
            self._ones = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])
            self._zeros = np.arange(len(self._ones)) * 64 - self._ones
            self._low = np.concatenate([self.low, np.zeros(8, np.uint8)])
            self._ready = True

    def _select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        """The place among the high bits of the rank-th one or zero."""
        counts = self._ones if ones else self._zeros
        word = np.searchsorted(counts, rank, "right") - 1
        rest = (rank - counts[word]).astype(np.uint8)
        bits = self._words[word]
        if not ones:
            bits = ~bits
        place = word * 64
        for width in (32, 16, 8):  # which half, quarter, byte
            half = bits & np.uint64((1 << width) - 1)
            count = np.bitwise_count(half)
            over = rest >= count
            rest = rest - count * over
            bits = np.where(over, bits >> np.uint64(width), half)
            place = place + width * over
        return place + _SELECT[bits.astype(np.uint8), rest]

    def _lows(self, at: np.ndarray) -> np.ndarray:
        """Low parts of the values at these indexes."""
        begin = at * self.low_bits
        byte, out = begin >> 3, np.zeros(len(at), np.uint64)  # all zero where there are no low bits
        for k in range((self.low_bits + 14) // 8):
            out |= self._low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return (out >> (begin & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at these indexes."""
        self._prepare()
        high = self._select(at, True) - at
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(at) if self.low_bits else high.astype(np.uint64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Where each value stands, -1 where it doesn't."""
        self._prepare()
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        values = values.astype(np.uint64)
        high, low = (values >> np.uint64(self.low_bits)).astype(np.int64), values & np.uint64((1 << self.low_bits) - 1)
        # after the last one come zeros of the padding only
        who = np.flatnonzero(high <= self._zeros[-1] - 64)
        high, low = high[who], low[who]
        # the values with this high part stand between two zeros
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1 - high, 0)
        end = self._select(high, False) - high
        at, stop = begin.copy(), end.copy()
        live = np.flatnonzero(at < stop)
        while len(live):
            middle = (at[live] + stop[live]) >> 1
            less = self._lows(middle) < low[live]
            at[live[less]], stop[live[~less]] = middle[less] + 1, middle[~less]
            live = live[at[live] < stop[live]]
        some = np.flatnonzero(at < end)
        same = some[self._lows(at[some]) == low[some]]
        out[who[same]] = at[same]
        return out

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.packbits(((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"))

    def values(self) -> np.ndarray:
        """The whole sequence."""
        high = np.flatnonzero(np.unpackbits(np.asarray(self.high), bitorder="little"))[: self.n] - np.arange(self.n)
        out = high.astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(np.asarray(self.low), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            # bytes of each value's low part, padded to eight
            padded = np.zeros((self.n, 64), np.uint8)
            padded[:, : self.low_bits] = bits
            out |= np.packbits(padded, axis=1, bitorder="little").view(np.uint64).ravel()
        return out

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.low_bits, len(self.low), len(self.high)], np.int64).tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        n, low_bits, a, b = np.frombuffer(data[:32], np.int64).tolist()
        return cls(n, low_bits, np.frombuffer(data[32 : 32 + a], np.uint8), np.frombuffer(data[32 + a : 32 + a + b], np.uint8)), 32 + a + b


def _packed(counts: np.ndarray) -> bytes:
    """Counts as planes of bytes, of eight bytes a count where one needs more than four."""
    kind = np.uint64 if len(counts) and counts.max() >= 1 << 32 else np.uint32
    raw = counts.astype(kind).view(np.uint8).reshape(len(counts), -1 if len(counts) else 4).T.tobytes()
    small = pa.compress(raw, codec="zstd", asbytes=True)
    return np.array([len(counts), len(small) * 2 + (kind is np.uint64)], np.int64).tobytes() + small


def _unpacked(data: memoryview) -> tuple[np.ndarray, int]:
    n, size = np.frombuffer(data[:16], np.int64).tolist()
    kind, size = (np.uint64, size >> 1) if size & 1 else (np.uint32, size >> 1)
    width = np.dtype(kind).itemsize
    raw = pa.decompress(bytes(data[16 : 16 + size]), decompressed_size=width * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel(), 16 + size


class Tokens:
    """The tokens of a block's texts end to end, an end token after each, and its n-grams by order.

    Of each order: the sorted distinct hashes (`keys`), each position's place among them (`ids`, -1 where a
    text has too few tokens before), a position of each (`at`), and their counts (`counts`), where a text
    counts as often as `times` says.
    """

    def __init__(self, texts: pa.Array, times: np.ndarray, bits: int, order: int = ORDER):
        hashes, sizes = [], []
        for block in blocks(texts):
            starts, ends, offsets = block.words(BLANKS)
            n, docs = len(starts), len(offsets) - 1
            out = np.full(n + docs, _END, np.uint64)
            out[np.arange(n) + np.repeat(np.arange(docs), np.diff(offsets))] = block.hashes(starts, ends)
            hashes.append(out)
            sizes.append(np.diff(offsets) + 1)
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        n = len(self.words)
        first = np.cumsum(self.sizes) - self.sizes
        depth = np.arange(n) - np.repeat(first, self.sizes)
        train = np.repeat(times, self.sizes)
        self.levels = []
        gram = self.words
        for k in range(1, order + 1):
            if k > 1:
                gram = gram.copy()
                gram[1:] = mix64(previous[:-1] * _STEP + self.words[1:])  # noqa: F821
            previous = gram
            here = np.flatnonzero(depth >= k - 1)
            keys, at, ids = np.unique(gram[here] >> np.uint64(64 - bits if k > 1 else 0), return_index=True, return_inverse=True)
            place = np.full(n, -1, np.int64)
            place[here] = ids.ravel()
            counts = np.bincount(ids.ravel(), weights=train[here], minlength=len(keys)).astype(np.int64)
            self.levels.append((keys, place, here[at], counts))


def _bucket_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Each key's bucket: equal ranges of the hashes, of so many bits."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)


def _bits(k: int, bits: int) -> int:
    return 64 if k == 0 else bits


def listed(bits: int, buckets: int):
    """For a block's documents: its n-gram lists, a row for each bucket in which it has any."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        held = group.column("held").to_numpy(zero_copy_only=False)
        tokens = Tokens(group.column("text"), np.where(held, 0, group.column("copies").to_numpy()), bits)
        placed = [_bucket_of(keys, _bits(k, bits), buckets) for k, (keys, *_) in enumerate(tokens.levels)]
        filled = np.unique(np.concatenate(placed))
        cuts = [(np.searchsorted(p, filled), np.searchsorted(p, filled, "right")) for p in placed]
        rows = []
        for i, b in enumerate(filled.tolist()):
            parts = []
            for k, (keys, _, _, counts) in enumerate(tokens.levels):
                lo, hi = cuts[k][0][i], cuts[k][1][i]
                # keys relative to the bucket's least
                least = np.uint64(-((-b << 32) // buckets)) << np.uint64(_bits(k, bits) - 32)
                parts.append(EliasFano.of(keys[lo:hi] - least, 1 + (1 << _bits(k, bits)) // buckets).to_bytes())
                parts.append(_packed(counts[lo:hi]))
            rows.append(b"".join(parts))
        block = group.column("block")[0].as_py()
        return pa.table({"bucket": pa.array(filled.astype(np.int32)), "block": pa.array([block] * len(rows), pa.int64()), "grams": pa.array(rows, pa.binary())})

    return run


def summed(group: pa.Table) -> pa.Table:
    """For a bucket's lists from all blocks: each list's totals over the blocks."""
    rows = group.column("grams").to_pylist()
    lists: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for data in rows:
        view, at, levels = memoryview(data), 0, []
        while at < len(data):
            keys, used = EliasFano.from_bytes(view[at:])
            at += used
            counts, used = _unpacked(view[at:])
            at += used
            levels.append((keys.values(), counts))
        lists.append(levels)
    out: list[list[bytes]] = [[] for _ in rows]
    for k in range(len(lists[0])):
        keys = np.concatenate([x[k][0] for x in lists])
        counts = np.concatenate([x[k][1] for x in lists])
        _, ids = np.unique(keys, return_inverse=True)
        totals = np.bincount(ids.ravel(), weights=counts)[ids.ravel()] if len(keys) else counts
        ends = np.cumsum([len(x[k][0]) for x in lists])
        for i, part in enumerate(np.split(totals, ends[:-1])):
            out[i].append(_packed(part))
    return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "totals": pa.array([b"".join(x) for x in out], pa.binary())})


class Trie:
    """The n-grams that a block's texts can reach, level by level, in one memory-mapped file."""

    def __init__(self, tokens: Tokens, totals: list[np.ndarray], n_train: int, n_words: int, folder: str):
        self.vocabulary = len(tokens.levels[0][0])
        base = (totals[0] + 0.5) / (n_train + 0.5 * (n_words + 1))
        probs: list[np.ndarray] = [base]
        parts: list[np.ndarray] = [self.quantised(base)]
        self.meta: list[tuple] = []
        # a gram's place in its level of the trie; -1 where it is unseen in training
        node = np.where(totals[0] > 0, np.arange(self.vocabulary), -1)
        self.nodes = [node]
        contexts = self.vocabulary
        words_of = tokens.levels[0][1]
        for k in range(1, len(totals)):
            _, place, at, _ = tokens.levels[k]
            upper = tokens.levels[k - 1][1]
            context, suffix, word = upper[at - 1], upper[at], words_of[at]
            # a gram whose context is unseen shares its hash with another, and isn't taken for it
            seen = np.flatnonzero((totals[k] > 0) & (self.nodes[k - 1][context] >= 0))
            c, h = totals[k].astype(np.float64), totals[k - 1][context].astype(np.float64)
            share, shorter = SHORTER[k - 1], probs[k - 1][suffix]
            p = np.where(h > 0, (1 - share) * c / np.maximum(h, 1) + share * shorter, shorter)
            probs.append(p)
            order = seen[np.lexsort((word[seen], self.nodes[k - 1][context[seen]]))]
            parents = self.nodes[k - 1][context[order]]
            pointers = np.searchsorted(parents, np.arange(contexts + 1))
            place_of = np.full(len(totals[k]), -1, np.int64)
            place_of[order] = np.arange(len(order))
            self.nodes.append(place_of)
            ef_pointers = EliasFano.of(pointers, len(order) + 1)
            ef_next = EliasFano.of(parents * self.vocabulary + word[order], contexts * self.vocabulary + 1)
            self.meta.append(tuple((e.n, e.low_bits, len(e.low), len(e.high)) for e in (ef_pointers, ef_next)))
            parts += [ef_pointers.low, ef_pointers.high, ef_next.low, ef_next.high, self.quantised(p[order])]
            contexts = max(1, len(order))
        raw = [p.view(np.uint8) for p in parts]
        self.offsets = np.concatenate([[0], np.cumsum([len(r) + (-len(r)) % 8 for r in raw])])
        self.sizes = [len(r) for r in raw]
        self.map = np.memmap(f"{folder}/trie", np.uint8, "w+", shape=(max(8, int(self.offsets[-1])),))
        for o, r in zip(self.offsets, raw, strict=False):
            self.map[o : o + len(r)] = r
        coded = [[EliasFano(m[0], m[1], self.part(5 * k + 1 + 2 * j), self.part(5 * k + 2 + 2 * j)) for j, m in enumerate(pair)] for k, pair in enumerate(self.meta)]
        self.pointers, self.following = [c[0] for c in coded], [c[1] for c in coded]

    @staticmethod
    def quantised(p: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(-np.log10(p) * QUANTUM), 0, FLOOR).astype(np.uint16)

    def part(self, i: int) -> np.ndarray:
        return self.map[self.offsets[i] : self.offsets[i] + self.sizes[i]]

    def logs(self, level: int) -> np.ndarray:
        return self.part(0 if level == 0 else 5 * level).view(np.uint16) / -QUANTUM

    def successors(self, level: int, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Places in the level of (context's place, word), -1 where there is none.

        Successors are coded relative to their context, so that one search finds the word among them; its
        place must lie where the context's pointers say.
        """
        # each pair once, and in order, so that neighbours in the code are looked at together
        wanted, which = np.unique(contexts * self.vocabulary + words, return_inverse=True)
        at = self.following[level - 1].find(wanted)
        hit = np.flatnonzero(at >= 0)
        parents, of = np.unique(wanted[hit] // self.vocabulary, return_inverse=True)
        begin = self.pointers[level - 1].access(parents).astype(np.int64)
        end = self.pointers[level - 1].access(parents + 1).astype(np.int64)
        if ((at[hit] < begin[of]) | (at[hit] >= end[of])).any():
            raise ValueError("a successor stands outside its context's range")
        return at[which]


def block_scores(tokens: Tokens, totals: list[np.ndarray], n_train: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's exact base and quantised model log10 probability."""
    words = tokens.levels[0][1]
    base = np.log10((totals[0] + 0.5) / (n_train + 0.5 * (n_words + 1)))[words]
    with tempfile.TemporaryDirectory() as folder:
        trie = Trie(tokens, totals, n_train, n_words, folder)
        node = np.where(totals[0][words] > 0, words, -1)
        log = trie.logs(0)[words]
        for level in range(1, len(totals)):
            # the longest context of each token one level up: the node of the token before
            context = np.append(-1, node[:-1])
            can = (tokens.levels[level][1] >= 0) & (context >= 0)
            here = np.flatnonzero(can)
            found = np.full(len(words), -1, np.int64)
            if len(here):
                found[here] = trie.successors(level, context[here], words[here])
                hit = here[found[here] >= 0]
                miss = here[found[here] < 0]
                log[hit] = trie.logs(level)[found[hit]]
                # the context is seen, the word isn't after it: a share of the shorter context's probability
                log[miss] += np.log10(SHORTER[level - 1])
            node = found
        del trie
    return base, log


def scorer(bits: int, n_train: int, n_words: int):
    def run(docs: pa.Table, counted: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        tokens = Tokens(docs.column("text"), np.zeros(docs.num_rows, np.int64), bits)
        rows = dict(zip(counted.column("bucket").to_pylist(), counted.column("totals").to_pylist(), strict=True))
        parts: list[list[np.ndarray]] = [[] for _ in tokens.levels]
        for b in sorted(rows):
            view, at = memoryview(rows[b]), 0
            for k in range(len(parts)):
                counts, used = _unpacked(view[at:])
                at += used
                parts[k].append(counts)
        totals = [np.concatenate(p).astype(np.int64) for p in parts]
        base, log = block_scores(tokens, totals, n_train, n_words)
        known = totals[0][tokens.levels[0][1]] > 0
        begins = np.cumsum(tokens.sizes) - tokens.sizes
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held"),
                "n_tokens": pa.array(tokens.sizes.astype(np.int64)),
                "n_known": pa.array(np.add.reduceat(known.astype(np.int64), begins)),
                "train_tokens": pa.array(np.full(len(begins), n_train, np.int64)),
                "base_score": pa.array(np.add.reduceat(base, begins)),
                "score": pa.array(np.add.reduceat(log, begins)),
                "copies": docs.column("copies"),
            }
        )

    return run


def training_size(docs: DataFrame) -> tuple[int, int]:
    """Tokens and distinct tokens of the rows that aren't held out."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words of some batches at a time; all their tokens stand beside the first."""
        held: list[np.ndarray] = []
        total = kept = 0

        def out() -> pa.RecordBatch:
            keys = np.unique(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.append(total, np.zeros(len(keys) - 1, np.int64)))], ["word", "tokens"])

        for batch in batches:
            for block in blocks(batch.column(0)):
                starts, ends, offsets = block.words(BLANKS)
                total += len(starts) + len(offsets) - 1
                held.append(np.unique(np.append(block.hashes(starts, ends), _END)))
                kept += len(held[-1])
                if kept > BUCKET_GRAMS:
                    yield out()
                    held, kept, total = [], 0, 0
        if held:
            yield out()

    parts = docs.where(~F.col("held")).select("text").mapInArrow(words, "word bigint, tokens bigint")
    row = parts.groupBy("word").agg(F.sum("tokens").alias("tokens")).agg(F.sum("tokens"), F.count(F.lit(1))).first()
    return int(row[0] or 0), int(row[1] or 0)


def folded(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int, bool]:
    """docs with copies, 1 but for rows that repeat so often that they are one; their bytes; whether there are such.

    At most four of them have room in a block's bytes, and their keys are written, so that Spark
    broadcasts them by their measured size or joins them by shuffle.
    """
    keyed = docs.select("doc_id", "text", "held", F.xxhash64("doc_id", "text").alias("key"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES
    keys = keyed.groupBy("key").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"))
    hot = (F.col("n") > 1) & (4 * F.col("bytes") > block_bytes)
    total, many = keys.agg(F.sum("bytes"), F.count_if(hot)).first()
    if not many:
        return keyed.withColumn("copies", F.lit(1).cast("long")), int(total or 0), False
    hot_keys = stored(keys.where(hot).select("key"), "lm-copies")
    once = keyed.join(hot_keys, "key", "left_anti").select("doc_id", "text", "held", "key", F.lit(1).cast("long").alias("copies"))
    more = keyed.join(hot_keys, "key", "left_semi").groupBy("doc_id", "text", "held", "key").agg(F.count(F.lit(1)).alias("copies"))
    return once.unionByName(more), int(total), True


def unfolded(scores: DataFrame) -> DataFrame:
    """A row for each copy: a repeated row's are dealt out in parts before they are made."""
    held = stored(scores, "lm-scores")
    columns = [c for c in held.columns if c != "copies"]
    parts = held.where("copies > 1").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("part"))
    here = F.least(F.col("copies") - F.col("part"), F.lit(COPIES).cast("long"))
    more = parts.repartition("doc_id", "part").select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), here)).alias("copy"))
    return held.where("copies = 1").select(*columns).unionByName(more.select(*columns))


def score_documents(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """docs(doc_id, text, held) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    shipped(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_train, n_words = training_size(docs)
    rows, held_bytes, repeated = folded(docs, block_bytes)
    bits = min(64, max(40, n_train.bit_length() + EXTRA_BITS))
    count = max(1, -(-held_bytes // block_bytes))
    buckets = max(4, -(-(ORDER * n_train) // bucket_grams))
    dealt = rows.select("doc_id", "text", "held", "copies", F.pmod("key", F.lit(count)).alias("block"))
    lists = dealt.groupBy("block").applyInArrow(listed(bits, buckets), "bucket int, block bigint, grams binary")
    totals = lists.groupBy("bucket").applyInArrow(summed, "block bigint, bucket int, totals binary")
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, copies bigint"
    scores = dealt.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(scorer(bits, n_train, n_words), schema)
    return unfolded(scores) if repeated else scores.drop("copies")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(5) == 1).alias("held"))
    return score_documents(docs)
