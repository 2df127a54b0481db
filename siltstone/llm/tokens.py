"""Exact tokenisation of whole texts with the ``tokenizers`` library, each distinct piece encoded once.

Both supported vocabularies split a text at white space, and between letters
and punctuation, before merging bytes.  So a text may be cut wherever an ASCII
space follows a character that is no space, or punctuation follows an ASCII
letter: the ids of the parts, side by side, are the ids of the whole.  No cut
is made after a character that Unicode calls white space, since the splitter
treats a run of spaces as one, nor at an apostrophe or a character of special
tokens.  Each distinct part is encoded by the library and remembered.

A special token's characters in a text are that token, as the library has it by
default; so special tokens must hold no white space and take none from beside
them, which is checked.  They are found by their exact bytes, so a part that
holds one is remembered by its exact bytes too.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa

from siltstone.llm.words import _IS_SPACE, Slab, slabs, span_digests

#: Parts remembered by a worker; beyond that it keeps those seen more than once, or none. Bounds memory, never the result.
MEMO_PARTS = 800_000

#: Bytes of texts worked on at once, and parts given to the library at once, which keeps much beside the ids of each.
TEXT_AT_ONCE, ENCODE_AT_ONCE = 1 << 20, 4096

#: Sets the keys of parts that hold a special token apart from those of folded ones.
_EXACT_KEY = np.uint64(0x9E3779B97F4A7C15)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!#$%&*+,-./:;=?@"]] = True


def vocabulary_path(name: str) -> str:
    """Where an installed public vocabulary file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def part_bounds(slab: Slab) -> np.ndarray:
    """Starts of the parts of a slab, and its end; every text's start is one."""
    data = slab.data
    if not len(data):
        return np.zeros(1, np.int64)
    space = _IS_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = space[1:] & ~space[:-1]
    at = np.flatnonzero(cut)
    z = data[at - 1].astype(np.int64)
    y = np.where(at > 1, data[at - 2], 0).astype(np.int64)
    x = np.where(at > 2, data[at - 3], 0).astype(np.int64)
    # Unicode white space beyond ASCII, in UTF-8, and the separators 1C-1F.
    wide = (z >= 0x1C) & (z <= 0x1F)
    wide |= (y == 0xC2) & ((z == 0x85) | (z == 0xA0))
    wide |= (x == 0xE1) & (y == 0x9A) & (z == 0x80)
    wide |= (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
    wide |= (x == 0xE2) & (y == 0x81) & (z == 0x9F)
    wide |= (x == 0xE3) & (y == 0x80) & (z == 0x80)
    cut[at[wide]] = False
    cut[1:-1] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    cut[slab.bounds] = True
    return np.flatnonzero(cut)


@dataclass
class Encoded:
    """Ids of the texts of a slab; those of text i are ``ids[first[i]:first[i + 1]]``."""

    ids: np.ndarray
    first: np.ndarray


class Encoder:
    """A tokenizer with a memo of parts, kept as arrays sorted by the parts' hashes."""

    def __init__(self, path: str, memo_parts: int = MEMO_PARTS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip or any(c.isspace() or c in "!#$%&*+,-./:;=?@" for c in t.content) for t in added):
            raise ValueError(f"{path}: an added token that parts cannot keep whole")
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in added)) if added else None
        normalizer = self.tokenizer.normalizer
        #: Whether the vocabulary itself lower-cases and drops white space, so that parts may differ in both.
        self.folds = normalizer is not None and normalizer.normalize_str("  Ab").strip() == "ab"
        self.memo_parts = memo_parts
        self._keep(np.zeros(0, bool), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _keep(self, kept: np.ndarray, keys: np.ndarray, checks: np.ndarray, start: np.ndarray, length: np.ndarray, flat: np.ndarray) -> None:
        n = length[kept]
        at = np.concatenate(([0], np.cumsum(n)))
        self.flat, self.used = flat[np.repeat(start[kept] - at[:-1], n) + np.arange(at[-1])], int(at[-1])
        self.keys, self.checks, self.start, self.length, self.again = keys[kept], checks[kept], at[:-1], n, np.zeros(len(n), bool)

    def _learn(self, new: np.ndarray, checks: np.ndarray, parts: list[str]) -> None:
        rows = [e.ids for at in range(0, len(parts), ENCODE_AT_ONCE) for e in self.tokenizer.encode_batch_fast(parts[at : at + ENCODE_AT_ONCE], add_special_tokens=False)]
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        end = self.used + int(n.sum())
        if end > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(max(1 << 16, end - self.used, self.used // 2), np.uint32)))
        self.flat[self.used : end] = np.fromiter(chain.from_iterable(rows), np.uint32, int(n.sum()))
        at = np.searchsorted(self.keys, new)
        self.start = np.insert(self.start, at, self.used + np.cumsum(n) - n)
        self.length, self.again = np.insert(self.length, at, n), np.insert(self.again, at, False)
        self.keys, self.checks, self.used = np.insert(self.keys, at, new), np.insert(self.checks, at, checks), end

    def _whole(self, slab: Slab) -> Encoded:
        """The library's ids of whole texts."""
        raw, bounds = slab.data.tobytes(), slab.bounds.tolist()
        rows = [self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        first = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        return Encoded(np.fromiter(chain.from_iterable(rows), np.uint32, int(first[-1])), first.astype(np.int64))

    def encode_slab(self, slab: Slab) -> Encoded:
        cuts = part_bounds(slab)
        starts, ends = cuts[:-1], cuts[1:]
        if not len(starts):
            return Encoded(np.zeros(0, np.uint32), np.zeros(len(slab) + 1, np.int64))
        begin = starts
        if self.folds:
            # White space at the front of a part has no ids of its own.
            spaces = np.concatenate(([0], np.cumsum(_IS_SPACE[slab.data])))
            text = np.flatnonzero(~_IS_SPACE[slab.data])
            begin = np.minimum(np.append(text, len(slab.data))[starts - spaces[starts]], ends)
        names, checks = span_digests(slab.data, begin, ends, fold_case=self.folds)
        if self.folds and self.special:
            held = np.unique(np.searchsorted(starts, [m.start() for m in self.special.finditer(slab.data.tobytes())], "right") - 1)
            names[held], checks[held] = span_digests(slab.data, begin[held], ends[held], fold_case=False)
            names[held] ^= _EXACT_KEY
            checks[held] ^= _EXACT_KEY
        keys, where, inverse = np.unique(names, return_index=True, return_inverse=True)
        if (checks[where][inverse] != checks).any():
            return self._whole(slab)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if (self.checks[at[known]] != checks[where[known]]).any():
            return self._whole(slab)
        self.again[at[known]] = True
        if not known.all():
            raw, pick = slab.data.tobytes(), where[~known]
            missing = len(keys) - int(known.sum())
            if len(self.keys) + missing > self.memo_parts:
                # Parts may be forgotten now, so all of this slab's are learnt.
                self._keep(np.zeros(len(self.keys), bool) if self.again.sum() + missing > self.memo_parts else self.again, self.keys, self.checks, self.start, self.length, self.flat)
                at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
                known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
                pick = where[~known]
            self._learn(keys[~known], checks[pick], [raw[a:b].decode() for a, b in zip(begin[pick].tolist(), ends[pick].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        row = at[inverse]
        n = self.length[row]
        out = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.repeat(self.start[row] - out[:-1], n) + np.arange(out[-1])]
        return Encoded(ids, out[np.searchsorted(starts, slab.bounds)])

    def encode(self, column: pa.Array) -> Iterator[tuple[Slab, Encoded]]:
        for slab in slabs(column, TEXT_AT_ONCE):
            yield slab, self.encode_slab(slab)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    return Encoder(path)
