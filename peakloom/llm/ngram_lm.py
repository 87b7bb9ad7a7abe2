"""Language-model scoring with an Elias-Fano n-gram trie.

Words are 62-bit hashes; their ids are their ranks, over hash-range shards. The trie has a level of words (their hashes in
Elias-Fano code, with exact counts, which the base score needs) and a level of successors. Successor ids of a context, shifted by the context's base, form one monotone sequence in
Elias-Fano code; pointers (where a context's successors begin) and bases are two more. A pair is found by decoding
its context's pointers and base and searching for the successor of base + id in the sequence, which must fall between the
pointers. Probabilities (interpolated absolute discounting over add-one unigrams) and back-off weights are
quantised. Each shard's level is one file in the shared folder, written whole under its final name by one task and
mapped into memory by every task that scores.

Defined results: a null or empty text is the end token alone; training and scoring read whole texts of all rows;
with no training rows every probability is that of the one unknown word; repeated rows are scored each; other columns
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, crc_bucket, executor_task, map_arrays, read_table, scratch_path, segments, ship, text_batches, text_bytes, write_arrays

DISCOUNT = 0.75
#: Quantisation of log10 values: 16 bits over this range.
LOWEST = -16.0

#: Bits of a word's hash; two are left free for the code of the first level.
HASH_BITS = 62
#: Ids of words travel as 32-bit numbers, the beginning of a text among them.
MOST_WORDS = (1 << 32) - 2
SHARD_TOKENS = 5_000_000
#: Shards beyond this number are larger.
MOST_BITS = 17
BYTES_PER_TOKEN = 6
_HASHES = WordHashes("tokens", 120_000_000)


# --- bit sequences and Elias-Fano code -------------------------------------------------------------------------


def _select(words: np.ndarray, ranks: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
    """Position of the k-th (from 0) one or zero. ``ranks``: ones before each word."""
    if ones:
        w = np.searchsorted(ranks, k, side="right") - 1
        left = k - ranks[w].astype(np.int64)
    else:
        # zeros before word w are 64 w - ranks[w]: a binary search over words
        lo, hi = np.zeros(len(k), dtype=np.int64), np.full(len(k), len(ranks) - 1, dtype=np.int64)
        for _ in range(max(1, int(len(ranks)).bit_length())):
            mid = (lo + hi + 1) >> 1
            ok = 64 * mid - ranks[mid].astype(np.int64) <= k
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        w = lo
        left = k - (64 * w - ranks[w].astype(np.int64))
    word = words[np.minimum(w, len(words) - 1)]
    if not ones:
        word = ~word
    at = np.zeros(len(k), dtype=np.int64)
    for size in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(word & np.uint64((1 << size) - 1)).astype(np.int64)
        up = left >= low
        left = np.where(up, left - low, left)
        at += np.where(up, size, 0)
        word = np.where(up, word >> np.uint64(size), word)
    return w * 64 + at


@dataclass
class EliasFano:
    """A monotone sequence: ``low`` bits of each value packed, the rest in unary with a directory of ones."""

    n: int
    bits: int
    low: np.ndarray
    high: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        pos = np.arange(n, dtype=np.int64) * bits
        low = np.zeros((n * bits >> 6) + 2, dtype=np.uint64)
        if bits and n:
            x = v & np.uint64((1 << bits) - 1)
            word, off = pos >> 6, (pos & 63).astype(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low[word[first]] |= np.bitwise_or.reduceat(x << off, first)
            over = np.flatnonzero(off + np.uint64(bits) > np.uint64(64))
            np.bitwise_or.at(low, word[over] + 1, x[over] >> (np.uint64(64) - off[over]))
        h = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        n_bits = (int(h[-1]) if n else 0) + 2
        high = np.zeros((n_bits >> 6) + 1, dtype=np.uint64)
        if n:
            word = h >> 6
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            high[word[first]] = np.bitwise_or.reduceat(np.uint64(1) << (h & 63).astype(np.uint64), first)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])[:-1].astype(np.uint32)
        return cls(n, bits, low, high, ranks)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.int64)
        pos = i * self.bits
        w, off = pos >> 6, (pos & 63).astype(np.uint64)
        x = self.low[w] >> off
        x |= np.where(off > 0, self.low[w + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (x & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((_select(self.high, self.ranks, i, True) - i) << self.bits) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the least value >= x, whether it equals x); index n where there is none."""
        h, low = x >> self.bits, x & ((1 << self.bits) - 1)
        zeros = 64 * len(self.high) - int(self.ranks[-1]) - int(np.bitwise_count(self.high[-1])) if len(self.high) else 0
        # values with high part h lie between the h-th zero and the next
        at = lambda k: np.where(k <= 0, 0, np.where(k > zeros, self.n, _select(self.high, self.ranks, np.clip(k - 1, 0, max(zeros - 1, 0)), False) - (k - 1)))
        lo, end = np.minimum(at(h), self.n), np.minimum(at(h + 1), self.n)
        hi = end.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = np.zeros(len(x), dtype=bool)
            less[open_] = self._low(mid[open_]) < low[open_]
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        equal = np.zeros(len(x), dtype=bool)
        inside = lo < end
        equal[inside] = self._low(lo[inside]) == low[inside]
        return lo, equal


def _packed(sequences: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """Arrays and numbers of monotone sequences, for a file."""
    arrays, numbers = {}, {}
    for k, v in sequences.items():
        ef = EliasFano.of(v)
        arrays |= {f"{k}.low": ef.low, f"{k}.high": ef.high, f"{k}.ranks": ef.ranks}
        numbers |= {f"{k}.n": ef.n, f"{k}.bits": ef.bits}
    return arrays, numbers


def _sequence(arrays: dict[str, np.ndarray], numbers: dict[str, int], name: str) -> EliasFano:
    return EliasFano(numbers[f"{name}.n"], numbers[f"{name}.bits"], *(arrays[f"{name}.{x}"] for x in ("low", "high", "ranks")))


# --- levels ----------------------------------------------------------------------------------------------------


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(log10 / LOWEST, 0, 1) * 65535).astype(np.uint16)


def dequantise(q: np.ndarray) -> np.ndarray:
    return q.astype(np.float64) * (LOWEST / 65535)


@dataclass
class Model:
    """Where the levels are, and what fits in a message: one number for each shard."""

    folder: str
    bits: int
    tokens: int
    vocabulary: int
    #: First word id of each shard, and which shards have successors.
    first: list[int] = field(default_factory=list)
    paired: list[bool] = field(default_factory=list)

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, training count) of each distinct hash; id -1 and count 0 if unknown. ``hashes`` ascend."""
        ids, counts = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        shard = (hashes >> np.uint64(HASH_BITS - self.bits)).astype(np.int64)
        cut = np.searchsorted(shard, np.arange((1 << self.bits) + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            if self.first[s + 1] == self.first[s]:
                continue
            arrays, num = map_arrays(f"{self.folder}/words-{s}")
            level = _sequence(arrays, num, "hash")
            mine = slice(cut[s], cut[s + 1])
            at, hit = level.successor((hashes[mine] & np.uint64((1 << (HASH_BITS - self.bits)) - 1)).astype(np.int64))
            ids[mine] = np.where(hit, at + self.first[s], -1)
            counts[mine] = np.where(hit, arrays["count"][np.minimum(at, level.n - 1)], 0)
        return ids, counts

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.vocabulary + 1))

    def shard_of(self, contexts: np.ndarray) -> np.ndarray:
        """Of context ids; the beginning of a text, id ``vocabulary``, belongs to the last shard."""
        return np.minimum(np.searchsorted(self.first, contexts, side="right") - 1, (1 << self.bits) - 1)

    def pairs(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability if the pair is known, else nan; log10 back-off weight) for ascending contexts >= 0; word -1 is unknown."""
        found, back = np.full(len(context), np.nan), np.zeros(len(context))
        shard = self.shard_of(context)
        cut = np.searchsorted(shard, np.arange((1 << self.bits) + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            if not self.paired[s]:
                continue
            a, num = map_arrays(f"{self.folder}/pairs-{s}")
            seq = {k: _sequence(a, num, k) for k in ("next", "pointer", "base")}
            c, w = context[cut[s] : cut[s + 1]] - self.first[s], word[cut[s] : cut[s + 1]]
            begin, end, base = seq["pointer"].get(c), seq["pointer"].get(c + 1), seq["base"].get(c)
            i, equal = seq["next"].successor(base + np.maximum(w, 0))
            hit = equal & (w >= 0) & (i >= begin) & (i < end)
            out = np.full(len(c), np.nan)
            out[hit] = dequantise(a["probability"][i[hit]])
            found[cut[s] : cut[s + 1]] = out
            back[cut[s] : cut[s + 1]] = dequantise(a["backoff"][c])
        return found, back

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, add-one unigram score, model score) of each text."""
        words, n = token_hashes(texts)
        distinct, back = np.unique(words, return_inverse=True)
        ids, counts = self.lookup(distinct)
        word, count = ids[back], counts[back]
        at = segments(n)
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[at[:-1]] = self.vocabulary
        uni = self.unigram(count)
        key = np.where(context >= 0, (context << 32) | (word + 1), -1)
        keys, inverse = np.unique(key, return_inverse=True)
        known = np.flatnonzero(keys >= 0)
        pair, weight = np.full(len(keys), np.nan), np.zeros(len(keys))
        pair[known], weight[known] = self.pairs(keys[known] >> 32, (keys[known] & 0xFFFFFFFF) - 1)
        p, b = pair[inverse], weight[inverse]
        model = np.where(np.isnan(p), b + uni, p)
        return n, np.add.reduceat((count > 0).astype(np.int64), at[:-1]), np.add.reduceat(uni, at[:-1]), np.add.reduceat(model, at[:-1])


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, each text with its end; number for each text)."""
    every: list[bytes] = []
    n = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        w = text_bytes(t).lower().split()
        n[i] = len(w) + 1
        every += w
        every.append(b" end")
    return _HASHES.of(every) >> np.uint64(64 - HASH_BITS), n


_TABLE = pa.schema([("s", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_TABLE_SCHEMA = "s int, a binary, b binary, c binary, d binary"


def _by_shard(key: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    cut = np.searchsorted(key, np.arange((1 << bits) + 1))
    for s in np.flatnonzero(np.diff(cut)).tolist():
        yield s, slice(cut[s], cut[s + 1])


def _word_counts(docs: DataFrame, bits: int) -> DataFrame:
    """Each task's distinct words with counts, by shard of the hash."""

    @executor_task("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x for x, _ in held])
            u, at = np.unique(h, return_inverse=True)
            c = np.bincount(at, weights=np.concatenate([x for _, x in held])).astype("<u8")
            shard = (u >> np.uint64(HASH_BITS - bits)).astype(np.int64)
            rows = [(s, u[x].astype("<u8").tobytes(), c[x].astype("<u4").tobytes(), b"", b"") for s, x in _by_shard(shard, bits)]
            return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _TABLE.types, strict=True)], schema=_TABLE)

        for _, texts in text_batches(batches):
            u, c = np.unique(token_hashes(texts)[0], return_counts=True)
            held.append((u, c))
            size += len(u)
            if size > 1_500_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, _TABLE_SCHEMA)


def _join(t: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), dtype=kind) for x in t.column(name)])


def _write_words(folder: str, bits: int):
    @executor_task("tokens")
    def run(t: pa.Table) -> pa.Table:
        s = t.column("s")[0].as_py()
        u, at = np.unique(_join(t, "a", "<u8"), return_inverse=True)
        c = np.bincount(at, weights=_join(t, "b", "<u4")).astype(np.uint64)
        arrays, numbers = _packed({"hash": u & np.uint64((1 << (HASH_BITS - bits)) - 1)})
        write_arrays(f"{folder}/words-{s}", arrays | {"count": c.astype(np.uint32) if c.max(initial=0) < 1 << 32 else c}, numbers)
        return pa.table({"s": pa.array([s], pa.int32()), "words": pa.array([len(u)], pa.int64()), "tokens": pa.array([int(c.sum())], pa.int64())})

    return run


def _pair_counts(docs: DataFrame, model: Model) -> DataFrame:
    """Distinct (context, word) id pairs of each batch with counts, by shard of the context."""

    @executor_task("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches, 4_000_000):
            words, n = token_hashes(texts)
            distinct, back = np.unique(words, return_inverse=True)
            word = model.lookup(distinct)[0][back]
            context = np.empty_like(word)
            context[1:] = word[:-1]
            context[segments(n)[:-1]] = model.vocabulary
            keys, counts = np.unique((context << 32) | word, return_counts=True)
            ctx, nxt = keys >> 32, (keys & 0xFFFFFFFF).astype("<u4")
            rows = []
            for s, x in _by_shard(model.shard_of(ctx), model.bits):
                own, runs = np.unique(ctx[x], return_counts=True)
                more = np.flatnonzero(counts[x] > 1)
                rows.append((s, np.stack([own, runs], axis=1).astype("<u4").tobytes(), nxt[x].tobytes(), more.astype("<u4").tobytes(), counts[x][more].astype("<u4").tobytes()))
            if rows:
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _TABLE.types, strict=True)], schema=_TABLE)

    return docs.select("doc_id", "text").mapInArrow(run, _TABLE_SCHEMA)


def _write_pairs(model: Model):
    @executor_task("tokens")
    def run(t: pa.Table) -> pa.Table:
        s = t.column("s")[0].as_py()
        keys, counts = [], []
        for a, b, c, d in zip(*(t.column(x).to_pylist() for x in "abcd"), strict=True):
            own = np.frombuffer(a, dtype="<u4").reshape(-1, 2).astype(np.int64)
            keys.append((np.repeat(own[:, 0], own[:, 1]) << 32) | np.frombuffer(b, dtype="<u4"))
            n = np.ones(len(keys[-1]), dtype=np.int64)
            n[np.frombuffer(c, dtype="<u4")] = np.frombuffer(d, dtype="<u4")
            counts.append(n)
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.add.reduceat(np.concatenate(counts)[order], new)
        key = key[new]
        first = model.first[s]
        last = s == (1 << model.bits) - 1
        n_contexts = model.first[s + 1] - first + last
        context, word = (key >> 32) - first, key & 0xFFFFFFFF
        kinds = np.bincount(context, minlength=n_contexts)
        total = np.bincount(context, weights=n, minlength=n_contexts)
        pointer = segments(kinds)
        greatest = np.zeros(n_contexts, dtype=np.int64)
        have = kinds > 0
        greatest[have] = word[pointer[1:][have] - 1] + 1
        base = segments(greatest)
        word_counts = np.zeros(len(word), dtype=np.int64)
        distinct, back = np.unique(word, return_inverse=True)
        word_counts = _counts_of_ids(model, distinct)[back]
        weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        p = (n - DISCOUNT) / total[context] + weight[context] * 10 ** model.unigram(word_counts)
        arrays, numbers = _packed({"next": base[context] + word, "pointer": pointer, "base": base})
        arrays |= {"probability": quantise(np.log10(p)), "backoff": quantise(np.log10(weight))}
        write_arrays(f"{model.folder}/pairs-{s}", arrays, numbers)
        return pa.table({"s": pa.array([s], pa.int32()), "pairs": pa.array([len(key)], pa.int64()), "bytes": pa.array([sum(v.nbytes for v in arrays.values())], pa.int64())})

    return run


def _counts_of_ids(model: Model, ids: np.ndarray) -> np.ndarray:
    """Training counts of ascending word ids."""
    out = np.zeros(len(ids), dtype=np.int64)
    shard = model.shard_of(ids)
    for s, x in _by_shard(shard, model.bits):
        out[x] = map_arrays(f"{model.folder}/words-{s}")[0]["count"][ids[x] - model.first[s]]
    return out


def train(docs: DataFrame, folder: str) -> Model:
    """Count the words and pairs of all rows and write the trie's levels to ``folder``."""
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, (size // BYTES_PER_TOKEN // SHARD_TOKENS).bit_length())
    shards = 1 << bits
    words = _word_counts(docs, bits).repartition(shards, "s").groupBy("s").applyInArrow(_write_words(folder, bits), "s int, words long, tokens long").collect()
    n = {r["s"]: r["words"] for r in words}
    first = [0]
    for s in range(shards):
        first.append(first[-1] + n.get(s, 0))
    model = Model(folder, bits, sum(r["tokens"] for r in words), first[-1], first, [False] * shards)
    if model.vocabulary > MOST_WORDS:
        raise ValueError(f"{model.vocabulary} different words; at most {MOST_WORDS}")
    for r in _pair_counts(docs, model).repartition(shards, "s").groupBy("s").applyInArrow(_write_pairs(model), "s int, pairs long, bytes long").collect():
        model.paired[r["s"]] = True
    return model


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    ship(docs.sparkSession)

    @executor_task("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            yield pa.record_batch([pa.array(c, t) for c, t in zip((ids, *model.score(texts)), _SCORED.types, strict=True)], schema=_SCORED)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op10_elias_fano_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), 7) == 2
    model = train(docs.where(~held_out), scratch_path(spark, "lm"))
    return score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
