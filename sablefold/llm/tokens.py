"""Encoding whole texts with a byte-level BPE tokenizer file.

Byte-level BPE works on pieces that its pattern cuts: a word takes one leading
space, other white space stands alone, and letters with marks behind them are
two pieces.  In a text whose words are parted by single spaces and line feeds,
a word's ids therefore depend on the word and on what parts it from the one
before, no more.  Words are found and hashed (64 bits) by array operations, each
distinct one is encoded once and kept in a table of bounded size per worker, and
a text's ids are gathered from the table.  Other texts are encoded whole.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import U, mix, slabs, word_hashes, word_spans

VOCABULARY = "byte_bpe_50k.json"
KEEP = 1_500_000  # words that a worker's table keeps
_MARK = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_CASED = mix(np.arange(1, 257, dtype=U), 13)
_PARTS = np.zeros(256, bool)
_PARTS[[10, 32]] = True
#: Bytes of which a text is looked at more closely: other white space, and first bytes of wide white space.
_LOOK = np.zeros(256, bool)
_LOOK[[9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, ord("<")]] = True
START, SPACED, FED = range(3)  # what stands before a word


def default_vocabulary() -> str:
    """Path of the vocabulary file, where the public tokenizers are installed."""
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def _apart(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of letters with marks behind them as two words; letters are those of ASCII and Latin-1."""
    if not len(starts):
        return starts, ends, lead, counts
    here = np.arange(len(data), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    body = np.maximum.accumulate(np.where(_MARK[data], here.dtype.type(-1), here))[ends - 1] + 1  # where the marks at the end begin
    letter = _LETTER[data]
    wide = np.flatnonzero(data[:-1] == 0xC3)
    wide = wide[(data[wide + 1] != 0x97) & (data[wide + 1] != 0xB7)]  # these two are signs
    letter[wide] = letter[wide + 1] = True
    others = np.zeros(len(data) + 1, here.dtype)
    np.cumsum(~letter, out=others[1:])
    body = np.maximum(body, starts)
    two = (body > starts) & (body < ends) & (others[body] == others[starts])
    size = 1 + two
    spot = np.cumsum(size) - size
    out = [np.repeat(a, size) for a in (starts, ends, lead)]
    out[1][spot[two]] = body[two]
    out[0][spot[two] + 1] = body[two]
    out[2][spot[two] + 1] = START
    total = np.concatenate([[0], np.cumsum(size)])
    edges = np.concatenate([[0], np.cumsum(counts)])
    return *out, total[edges[1:]] - total[edges[:-1]]


class Encoder:
    """Ids of texts as the tokenizer gives them without special tokens; null is an empty text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.feed,) = self._encode(["\n"])[0]
        self.keys, self.at, self.n = np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    @staticmethod
    def shared(path: str | None = None) -> Encoder:
        """One encoder per worker process: it outlives a task where workers are reused."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        store = sys.modules.setdefault("_sablefold_tokens", types.ModuleType("_sablefold_tokens")).__dict__
        path = str(path or default_vocabulary())
        if path not in store:
            store[path] = Encoder(path)
        return store[path]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, lead: str, words: list[str]) -> list[bytes]:
        """Ids of ``lead + word``: many words are encoded in one text, each on a line of its own."""
        out: list[bytes] = []
        for i in range(0, len(words), 500):
            some = words[i : i + 500]
            ids = np.array(self._encode(["\n".join([lead + w for w in some])])[0], np.uint32)
            ends = np.append(np.flatnonzero(ids == self.feed), len(ids))
            if len(ends) == len(some):
                raw = ids.tobytes()
                out += [raw[4 * a : 4 * b] for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist())]
            else:
                out += [np.array(x, np.uint32).tobytes() for x in self._encode([lead + w for w in some])]
        return out

    def column(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For texts ``lo:hi`` of the column: all their ids, and where each text's begin and end in them."""
        for slab in slabs(texts):
            n = slab.hi - slab.lo
            starts, ends, counts = word_spans(slab, _PARTS)
            whole = self._whole(slab)
            if whole:
                odd = np.zeros(n, bool)
                odd[list(whole)] = True
                fast = ~np.repeat(odd, counts)
                starts, ends, counts = starts[fast], ends[fast], np.where(odd, 0, counts)
            lead = np.where(slab.data[np.maximum(starts - 1, 0)] == 32, SPACED, FED)
            lead[starts == np.repeat(slab.offsets[:-1], counts)] = START
            starts, ends, lead, counts = _apart(slab.data, starts, ends, lead, counts)
            at, size, flat = self._lookup(slab.data, mix(word_hashes(slab, starts, ends, _CASED) + lead.astype(U), 5), starts, ends, lead)
            last = np.concatenate([[0], np.cumsum(size)])
            ids = flat[np.repeat(at - last[:-1], size) + np.arange(last[-1])]
            edges = last[np.concatenate([[0], np.cumsum(counts)])]
            if whole:
                parts = [whole[i] if i in whole else ids[edges[i] : edges[i + 1]] for i in range(n)]
                ids, edges = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            yield slab.lo, slab.hi, ids, edges

    def _whole(self, slab) -> dict[int, np.ndarray]:
        """Ids of the texts whose words aren't parted by single spaces and line feeds."""
        data, offsets = slab.data, slab.offsets
        if not len(data):
            return {}
        parts = _PARTS[data]
        twice = np.flatnonzero(parts[1:] & parts[:-1])
        of = lambda i: np.searchsorted(offsets, i, "right") - 1
        some = of(twice)
        odd = set(some[of(twice + 1) == some].tolist())
        full = np.flatnonzero(np.diff(offsets) > 0)
        odd.update(full[parts[offsets[1:][full] - 1]].tolist())
        look = set(of(np.flatnonzero(_LOOK[data])).tolist()) - odd
        text = {i: data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in odd | look}
        odd.update(i for i in look if "<|" in text[i] or len(text[i].split()) != text[i].count(" ") + text[i].count("\n") + 1 - (text[i][0] in " \n"))
        order = sorted(odd)
        return {i: np.array(ids, np.uint32) for i, ids in zip(order, self._encode([text[i] for i in order]))}

    def _lookup(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every word, where its ids begin in the third array, and how many they are."""
        uniq, first, back = np.unique(keys, return_index=True, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.keys, uniq), max(0, len(self.keys) - 1))
        have = self.keys[spot] == uniq if len(self.keys) else np.zeros(len(uniq), bool)
        new = np.flatnonzero(~have)
        at, size = np.empty(len(uniq), np.int64), np.empty(len(uniq), np.int64)
        at[have], size[have] = (self.at[spot[have]], self.n[spot[have]]) if len(self.keys) else (0, 0)
        flat = self.flat
        if len(new):
            some = first[new]
            raw = data.tobytes()
            word = [raw[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist())]
            ids = [b""] * len(new)
            feed = np.array([self.feed], np.uint32).tobytes()
            for kind in (START, SPACED, FED):
                mine = np.flatnonzero(lead[some] == kind).tolist()
                for i, x in zip(mine, self._words(" " if kind == SPACED else "", [word[i] for i in mine])):
                    ids[i] = feed + x if kind == FED else x
            n = np.array([len(x) // 4 for x in ids], np.int64)
            size[new], at[new] = n, len(flat) + np.cumsum(n) - n
            flat = np.concatenate([flat, np.frombuffer(b"".join(ids), np.uint32)])
            if len(self.keys) + len(new) <= KEEP:  # a full table stays as it is; frequent words came early
                where = np.searchsorted(self.keys, uniq[new])
                self.keys, self.at, self.n = (np.insert(x, where, y) for x, y in ((self.keys, uniq[new]), (self.at, at[new]), (self.n, size[new])))
                self.flat = flat
        return at[back], size[back], flat

