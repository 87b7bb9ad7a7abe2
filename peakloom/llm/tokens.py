"""Exact token ids of public tokenizers, with a memo of the ids of each white-space chunk.

Both pre-tokenizers used here cut at white space in a way that depends on the white space alone, so the ids of a
text are the ids of its chunks in order. Arrow cuts a batch into words and numbers the different ones; each of those
is looked up once in the worker's memo and encoded only if it is new there. Chunks are keyed by the word. In style "byte", which keeps white space in tokens, a key is a word after a single
space, or a word with a mark for its place: after a line feed, or first in the text. Texts with other white space
than single spaces and single line feeds between words are then encoded whole, and so are texts that hold a string which
the tokenizer keeps for a special token.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ranges, register_memo, segments

AFTER_LINE, FIRST = "\n", "\r"
#: \x1c-\x1f are white space to Python alone.
_REGULAR = re.compile("[\n\r]?[^\\s\x1c-\x1f]+\\Z").match
_WITHOUT_SEPARATOR = re.compile("[^\x01]*\\Z").match


class ChunkEncoder(dict):
    """key of a chunk -> index into arrays of start and length of its ids; -1 for keys that need the whole text."""

    #: Bytes of the memo; a slice of texts adds its own words at most. An entry has a slot of the table, a number and the head of its key.
    LIMIT = 180_000_000
    ENTRY = 190

    def __init__(self, path: str, style: str, limit: int = LIMIT):
        super().__init__()
        self.LIMIT = limit
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # strings that the tokenizer knows as tokens of their own, in any case: texts with them are encoded whole
        known = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(known) or r"(?!)", re.IGNORECASE).search
        self.byte = style == "byte"
        # between chunks encoded together; one token by itself: a line feed is a pre-token, and \x01 between spaces is
        self.sep = "\n" if self.byte else " \x01 "
        self.sep_id, *more = self.tok.encode(self.sep, add_special_tokens=False).ids
        if more:
            raise ValueError("the separator must be one token")
        self.plain = _REGULAR if self.byte else _WITHOUT_SEPARATOR
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.key_bytes = 0
        self[FIRST] = 0  # an empty text
        self.n = 1
        self.pending: list[str] = []
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 12, dtype=np.int32)
        self.length = np.zeros(1 << 12, dtype=np.int32)
        self.batches = np.zeros(1 << 12, dtype=np.uint8)

    def size(self) -> int:
        """Bytes in use, about."""
        return len(self) * self.ENTRY + self.key_bytes + self.flat.nbytes + self.start.nbytes + self.length.nbytes + self.batches.nbytes

    def _prune(self) -> None:
        """Keep the chunks that more than one batch had: those that come once are most of the memo and no use to it."""
        items = [(k, i) for k, i in self.items() if i > 0 and self.batches[i] > 1]
        old = np.array([0, *(i for _, i in items)], dtype=np.int64)
        start, length, flat = self.start[old], self.length[old], self.flat
        batches = self.batches[old]
        self._reset()
        if len(items) * self.ENTRY > self.LIMIT // 2:
            return
        for k, _ in items:
            self[k] = self.n
            self.n += 1
            self.key_bytes += len(k)
        self._store(0, flat[ranges(start, length)], length)
        self.batches[: self.n] = np.minimum(batches, 1)

    def __missing__(self, key: str) -> int:
        self.key_bytes += len(key)
        if not self.plain(key) or self.special(key):
            self[key] = -1
            return -1
        i = self.n
        self[key] = i
        self.n += 1
        self.pending.append(key)
        return i

    def _encode_pending(self) -> None:
        at = self.n - len(self.pending)
        for lo in range(0, len(self.pending), 40_000):
            keys = self.pending[lo : lo + 40_000]
            some = [k[1:] if k[0] in "\n\r" else " " + k for k in keys] if self.byte else keys
            joined = [self.sep.join(some[i : i + 200]) for i in range(0, len(some), 200)]
            parts = []
            for e in self.tok.encode_batch_fast(joined, add_special_tokens=False):
                parts += e.ids
                parts.append(self.sep_id)
            ids = np.array(parts, dtype=np.uint32)
            ends = np.flatnonzero(ids == self.sep_id)
            if len(ends) != len(some):
                raise ValueError("a chunk holds the separator")
            lens = np.diff(ends, prepend=-1) - 1
            ids = np.delete(ids, ends)
            if self.byte:
                after = np.fromiter((k[0] == AFTER_LINE for k in keys), dtype=bool, count=len(keys))
                ids = np.insert(ids, (segments(lens)[:-1])[after], self.sep_id)
                lens = lens + after
            self._store(at, ids, lens)
            at += len(keys)
        self.pending = []

    def _store(self, at: int, ids: np.ndarray, lens: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + len(lens) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            self.batches = np.concatenate([self.batches, np.zeros_like(self.batches)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[at : at + len(lens)] = self.used + segments(lens)[:-1]
        self.length[at : at + len(lens)] = lens
        self.used += len(ids)

    def keys_of(self, texts: pa.Array) -> pa.Array:
        """The words of each text, marked."""
        if self.byte:
            # a text's own carriage returns are doubled: no word can then look like the first of a text
            own = pc.replace_substring(pc.replace_substring(texts, "\r", "\r\r"), "\n", " \n")
            marked = pc.binary_join_element_wise(FIRST, own, "")
            return pc.split_pattern(marked, " ")
        # lower-casing A-Z only makes fewer keys; the tokenizer lower-cases the rest
        return pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text); a null text is empty."""
        if self.size() > self.LIMIT:
            self._prune()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        keys = self.keys_of(texts)
        counts = pc.list_value_length(keys).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = keys.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)  # far faster than a list of scalars
        found = np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))
        if self.pending:
            self._encode_pending()
        mine = found[found >= 0]
        self.batches[mine] = np.minimum(self.batches[mine], 200) + 1
        index = found.take(coded.indices.to_numpy(zero_copy_only=False))
        if len(found) and found.min() < 0:
            return self._encode_some_whole(texts, index, counts)
        lens = self.length[index]
        ends = np.cumsum(lens, dtype=np.int64)
        total = int(ends[-1])
        small = np.int32 if total < 1 << 31 and self.used < 1 << 31 else np.int64
        at = np.repeat((self.start[index] - (ends - lens)).astype(small), lens)
        at += np.arange(total, dtype=small)
        ends = np.concatenate([[0], ends])
        cut = segments(counts)
        return self.flat.take(at), ends[cut[1:]] - ends[cut[:-1]]

    def _encode_some_whole(self, texts: pa.Array, index: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = segments(counts)
        out, n = [], []
        for i in range(len(texts)):
            own = index[cut[i] : cut[i + 1]]
            if len(own) and own.min() < 0:
                ids = np.array(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
            else:
                ids = self.flat[ranges(self.start[own], self.length[own])]
            out.append(ids)
            n.append(len(ids))
        return np.concatenate(out), np.array(n, dtype=np.int64)


_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}
#: The memo of token ids, one for a worker's tokenizers.
MEMO = "token ids"


def _empty() -> None:
    for e in _ENCODERS.values():
        e._reset()


register_memo(MEMO, _empty)


def encoder(path: str, style: str, limit: int = ChunkEncoder.LIMIT) -> ChunkEncoder:
    """This worker's encoder, kept from task to task."""
    if (path, style) not in _ENCODERS:
        _empty()
        _ENCODERS[path, style] = ChunkEncoder(path, style, limit)
    return _ENCODERS[path, style]
