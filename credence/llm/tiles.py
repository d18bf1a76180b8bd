"""Token ids of many texts by looking their tiles up, as vectors.

A tile is a space with what follows up to the next space. Where no white space follows a space, a tokenizer whose pieces
never run from a non-space into a space gives the ids of a text as those of its tiles, one after another. Tiles are hashed
by prefix sums and looked up in an open-addressing table; new ones alone are encoded by the library, many in one string,
whose ids are dealt back to the tiles by the lengths of the tokens. What the found tiles spell is compared with the texts
byte by byte, so equal hashes of different tiles can't go unnoticed: such a block is encoded the plain way, and so are
texts with white space behind a space or with the string of an added token, which the library takes out before it splits.
Tokenizers of another kind are used the plain way throughout.

Nulls count as empty texts. Empty texts have no ids; texts of any length, ties and repeated texts are no special case; an
empty column gives an empty list. Columns other than the one given are never seen.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from .shared import offsets, values
from .tokens import _INVERSE, _P, _power, mix

#: Bytes behind a space that may begin white space: the ASCII ones, and first bytes of the others in UTF-8.
_RISKY = np.zeros(256, bool)
_RISKY[[9, 10, 11, 12, 13, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED2701))
#: Bytes of new tiles that the library gets as one string.
JOINED = 1 << 14


class Library:
    """A tokenizer of the tokenizers library: texts -> ids, without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split, vocab = made.get("pre_tokenizer") or {}, own.get_vocab(with_added_tokens=True)
        self.own, self.n_ids = own, max(vocab.values(), default=0) + 1
        #: Strings that are taken out of a text before it is split.
        self.added = [x["content"].encode() for x in made.get("added_tokens") or ()]
        #: Whether pieces end before every space, and every character of a token stands for one byte.
        self.by_tiles = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not made.get("normalizer") and not (made.get("model") or {}).get("continuing_subword_prefix")
        self.n_bytes = np.zeros(self.n_ids, np.int64)
        self.n_bytes[list(vocab.values())] = [len(t) for t in vocab]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]


class Flat:
    """Sequences laid out one after another in a growing array."""

    def __init__(self, kind: type):
        self.data, self.starts, self.size, self.n = np.zeros(1 << 16, kind), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), 0

    def extend(self, data: np.ndarray, size: np.ndarray) -> None:
        at = int(self.starts[self.n - 1] + self.size[self.n - 1]) if self.n else 0
        while at + len(data) > len(self.data):
            self.data = twice(self.data)
        while self.n + len(size) > len(self.starts):
            self.starts, self.size = twice(self.starts), twice(self.size)
        self.data[at : at + len(data)] = data
        self.size[self.n : self.n + len(size)] = size
        self.starts[self.n : self.n + len(size)] = at + np.cumsum(size) - size
        self.n += len(size)

    def gather(self, which: np.ndarray) -> np.ndarray:
        return pick(self.data, self.starts[which], self.size[which])


def twice(x: np.ndarray) -> np.ndarray:
    """x with as much room again, which takes no memory until it is written."""
    out = np.empty(2 * len(x), x.dtype)
    out[: len(x)] = x
    return out


def pick(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start : start + size] of each, one after another."""
    at = np.repeat(starts - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return data[at]


class Tiles:
    """texts -> ids (little-endian unsigned 32-bit integers) of each. library: encodes new tiles, and what has no tiles."""

    def __init__(self, library: Library, bits: int = 22):
        self.library, self.bits = library, bits
        self.reset()

    def reset(self) -> None:
        self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.ids, self.bytes = Flat(np.uint32), Flat(np.uint8)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the tile of each hash, or -1."""
        out, mask = np.full(len(h), -1, np.int64), np.int64((1 << self.bits) - 1)
        rest, at = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(rest):
            key = self.keys[at]
            hit = key == h[rest]
            out[rest[hit]] = self.slots[at[hit]]
            on = ~hit & (key != 0)
            rest, at = rest[on], (at[on] + 1) & mask
        return out

    def insert(self, h: np.ndarray) -> None:
        """Enter distinct new hashes, numbered from the tiles known so far on."""
        mask = np.int64((1 << self.bits) - 1)
        number, at = np.arange(len(h)) + self.ids.n, (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            _, first = np.unique(at[free], return_index=True)  # one to a slot
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.slots[at[won]] = h[won], number[won]
            left = np.ones(len(h), bool)
            left[won] = False
            h, number, at = h[left], number[left], (at[left] + 1) & mask

    def learn(self, data: np.ndarray, a: np.ndarray, b: np.ndarray, h: np.ndarray) -> None:
        """Encode and enter the new tiles data[a:b] with distinct hashes h."""
        inner = data[a] == 32  # such tiles may follow any other; those that begin a text stand alone
        order = np.concatenate([np.flatnonzero(~inner), np.flatnonzero(inner)])
        a, b, h = a[order], b[order], h[order]
        size, alone = b - a, len(order) - int(inner.sum())
        spelt = pick(data, a, size)
        ends = np.cumsum(size)
        before = int(ends[alone - 1]) if alone else 0
        group = np.concatenate([np.arange(alone), alone + (ends[alone:] - size[alone:] - before) // JOINED])
        last = np.flatnonzero(np.diff(group, append=-1))
        raw, cuts = spelt.tobytes(), ends[last].tolist()
        found = self.library([raw[i:j].decode() for i, j in zip([0, *cuts], cuts, strict=False)])
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        reach = np.cumsum(self.library.n_bytes[ids])
        n = np.searchsorted(reach, ends, "right")
        if not np.array_equal(reach[n - 1], ends):  # a token that runs from one tile into the next
            found = self.library([raw[i:j].decode() for i, j in zip((ends - size).tolist(), ends.tolist(), strict=True)])
            ids, n = np.concatenate(found), np.cumsum([len(x) for x in found])
        self.insert(h)
        self.ids.extend(ids, np.diff(n, prepend=0))
        self.bytes.extend(spelt, size)

    def __call__(self, column: pa.Array) -> list[bytes]:
        if not self.library.by_tiles:
            return [x.astype("<u4", copy=False).tobytes() for x in self.library([t or "" for t in column.to_pylist()])]
        column = column.fill_null("") if column.null_count else column
        starts = offsets(column)
        data = values(column)[starts[0] : starts[-1]]
        starts = starts - starts[0]
        if 2 * self.ids.n > 1 << self.bits:
            self.reset()
        space = np.flatnonzero(data == 32)
        end = np.zeros(len(data) + 1, bool)
        end[starts] = True
        risky = space[end[space + 1] | _RISKY[data[np.minimum(space + 1, len(data) - 1)]]]
        risky = np.concatenate([risky, *(places(data, x) for x in self.library.added)])
        bad = np.zeros(len(starts), bool)
        bad[np.searchsorted(starts, risky, "right") - 1] = True
        cut = end.copy()
        cut[space] = True
        cuts = np.flatnonzero(cut[:-1])
        ids, at = self.block(data, np.append(cuts, len(data)), bad[np.searchsorted(starts, cuts, "right") - 1])
        if ids is None:
            return [x.astype("<u4", copy=False).tobytes() for x in self.library(column.to_pylist())]
        bounds = at[np.searchsorted(cuts, starts)].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        slow = np.flatnonzero(bad[:-1]).tolist()
        for i, x in zip(slow, self.library([column[i].as_py() for i in slow]) if slow else [], strict=True):
            out[i] = x.astype("<u4", copy=False).tobytes()
        return out

    def block(self, data: np.ndarray, edges: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
        """ids of the tiles between the edges and where each begins among them; tiles to skip have none. None: hashes have met."""
        total, x = np.zeros(len(data) + 1, np.uint64), _BYTES[data]
        x *= _power(_P, len(data))
        np.cumsum(x, out=total[1:])
        del x
        a, b = edges[:-1][~skip], edges[1:][~skip]
        h = mix((total[b] - total[a]) * _power(_INVERSE, len(data))[a] ^ (b - a).astype(np.uint64)) | np.uint64(1)
        del total
        which = self.find(h)
        if len(missed := np.flatnonzero(which < 0)):
            new, first = np.unique(h[missed], return_index=True)
            self.learn(data, a[missed[first]], b[missed[first]], new)
            which[missed] = self.find(h[missed])
        inside = np.repeat(~skip, np.diff(edges))
        if not ((self.bytes.size[which] == b - a).all() and (self.bytes.gather(which) == data[inside]).all()):
            return None, edges
        size = np.zeros(len(skip), np.int64)
        size[~skip] = self.ids.size[which]
        return self.ids.gather(which), np.concatenate([[0], np.cumsum(size)])


def places(data: np.ndarray, wanted: bytes) -> np.ndarray:
    """Where a byte string begins in data."""
    raw, out, at = data.tobytes() if wanted else b"", [], -1
    while wanted and (at := raw.find(wanted, at + 1)) >= 0:
        out.append(at)
    return np.array(out, np.int64)
