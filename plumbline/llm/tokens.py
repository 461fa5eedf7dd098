"""Token ids by the tokenizers library, unit by unit with a bounded cache."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from plumbline.llm.core import hash_spans, mix64, text_bytes, worker_cache

_U = np.uint64
#: Units that are kept in a process; when full, the cache starts anew. 1 M units take some 80 MB.
CACHE_UNITS = 1_000_000
_SLOTS = 1 << 21
#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 1 << 20


class UnitCache:
    """Ids of units by two hashes (64 bits each): a table with open addressing over numpy arrays, so that lookups take whole batches."""

    def __init__(self):
        self.keys, self.checks, self.at = np.zeros(_SLOTS, _U), np.zeros(_SLOTS, _U), np.full(_SLOTS, -1, np.int32)
        self.starts, self.sizes, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The number of each unit, or -1."""
        out = np.full(len(h), -1, np.int64)
        open_, slot = np.arange(len(h)), (h & _U(_SLOTS - 1)).astype(np.int64)
        while len(open_):
            found = self.at[slot]
            good = (found >= 0) & (self.keys[slot] == h[open_]) & (self.checks[slot] == check[open_])
            out[open_[good]] = found[good]
            go = (found >= 0) & ~good
            open_, slot = open_[go], (slot[go] + 1) & (_SLOTS - 1)
        return out

    def add(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Units that are not there yet, each once; ids one after another."""
        n = len(h)
        while self.n + n > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[self.n : self.n + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + n] = sizes
        left, slot = np.arange(n), (h & _U(_SLOTS - 1)).astype(np.int64)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = self.n + left[free]  # of those that want one slot the last gets it
            won = free & (self.at[slot] == self.n + left)
            self.keys[slot[won]], self.checks[slot[won]] = h[left[won]], check[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (_SLOTS - 1)
        self.n += n
        self.used += len(ids)


class Encoder:
    """ids of texts for one tokenizer file. Strings of special tokens in a text are ordinary text.

    A unit is white space and what follows up to the next, without a stop or comma at its end, which is a unit of its own behind a letter or digit.
    The split of a byte-level BPE never joins two units, so the ids of a text are the ids of its units, one after another; each different unit goes
    through the library once. Texts with white space other than spaces and line breaks, and all texts for other kinds of tokenizers, go through it
    whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        kind = str(self.tokenizer.pre_tokenizer)
        self.by_unit = kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind and self.tokenizer.normalizer is None
        (self.line_break,) = self.tokenizer.encode("\n", add_special_tokens=False).ids if self.by_unit else (None,)
        self.cache = UnitCache()
        codes = np.arange(256, dtype=_U)
        self.tables = mix64(codes + _U(0x5EED)), mix64(codes + _U(0xC0FFEE))
        self.space, self.other, self.letter = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
        self.space[[32, 10]] = True
        self.other[[9, 11, 12, 13, 28, 29, 30, 31]] = True
        self.letter[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True

    @classmethod
    def of(cls, path: str) -> Encoder:
        kept = worker_cache()
        if ("encoder", path) not in kept:
            kept["encoder", path] = cls(path)
        return kept["encoder", path]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _library(self, units: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of the units, their ids in it, one unit after another, and how many each has. Units of one space and a word go as one text with a
        line break before each, which is a piece of its own there; the others go apart."""
        spaced = [i for i, u in enumerate(units) if u[0] == " " and u[1:2] not in ("", " ", "\n")]
        alone = set(range(len(units))).difference(spaced)
        ids, sizes = [], []
        for k in range(0, len(spaced), 20_000):
            part = spaced[k : k + 20_000]
            got = self.whole(["\n" + "\n".join([units[i] for i in part])])[0]
            breaks = got == self.line_break
            at = np.flatnonzero(breaks)
            assert len(at) == len(part), "units and ids do not agree"
            ids.append(got[~breaks])
            sizes.append(np.diff(at, append=len(got)) - 1)
        rest = self.whole([units[i] for i in alone])
        ids += rest
        sizes.append(np.array([len(x) for x in rest], np.int64))
        return [*spaced, *alone], np.concatenate(ids), np.concatenate(sizes)

    def _odd_space(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether a text has white space other than spaces and line breaks."""
        odd = self.other[data]
        if len(data) > 1 and (data >= 0xC2).any():
            a, b = data[:-1], data[1:]
            c = np.append(data[2:], 0)
            odd[:-1] |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        at = np.flatnonzero(odd)
        return np.searchsorted(at, offsets[1:]) > np.searchsorted(at, offsets[:-1])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the bounds by text. Null counts as empty."""
        data, offsets = text_bytes(texts)
        n = len(texts)
        odd = self._odd_space(data, offsets) if self.by_unit else np.ones(n, bool)
        inside = ~self.space[data]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        stop = np.flatnonzero(last & ((data == 46) | (data == 44)))
        stop = stop[(stop > 0) & self.letter[data[stop - 1]]] if len(stop) else stop
        cuts = np.zeros(len(data) + 1, bool)
        cuts[np.flatnonzero(last) + 1] = True
        cuts[stop] = True
        cuts[offsets] = True
        at = np.flatnonzero(cuts)
        starts, ends = at[:-1], at[1:]
        bounds = np.searchsorted(starts, offsets)
        bounds[-1] = len(starts)
        h, check = (hash_spans(data, starts, ends, t) for t in self.tables)
        plain = ~np.repeat(odd, np.diff(bounds))
        if not plain.all():
            starts, ends, h, check = starts[plain], ends[plain], h[plain], check[plain]
            bounds = np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(bounds)))])
        unit = self.cache.find(h, check)
        missing = np.flatnonzero(unit < 0)
        if len(missing):
            first = missing[np.unique(h[missing], return_index=True)[1]]
            if self.cache.n + len(first) > CACHE_UNITS:
                self.cache = UnitCache()
                missing = np.arange(len(h))
                first = np.unique(h, return_index=True)[1]
            raw = data.tobytes()
            order, ids, sizes = self._library([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            first = first[order]
            self.cache.add(h[first], check[first], ids, sizes)
            unit[missing] = self.cache.find(h[missing], check[missing])
            assert (unit >= 0).all(), "two units have one hash"
        sizes = self.cache.sizes[unit].astype(np.int64)
        run = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.cache.ids[np.repeat(self.cache.starts[unit] - run[:-1], sizes) + np.arange(run[-1])]
        bounds = run[bounds]
        if not odd.any():
            return ids, bounds
        raw = data.tobytes()
        rest = iter(self.whole([raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace") for i in np.flatnonzero(odd)]))
        each = [next(rest) if o else ids[bounds[i] : bounds[i + 1]] for i, o in enumerate(odd.tolist())]
        return np.concatenate([*each, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])

    def encode_ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with end_id behind each text."""
        ids, bounds = self.encode(texts)
        return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))
