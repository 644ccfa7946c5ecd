"""Encoding whole texts with a public tokenizer, each distinct word once."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BATCH = 512  # texts that callers hand over at a time
PART_BYTES = 1 << 18  # of text that is looked up together; a longer text is encoded whole
#: Words that a worker holds; beyond that the store starts anew.
HELD_WORDS = 400_000
CELL_BITS = 20
CELLS = 1 << CELL_BITS
LONGEST = 512  # bytes of a word that is looked up; texts with longer ones are encoded whole
FIRST = 0xFF  # stands before a text; no UTF-8 has it
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, equal to ``Tokenizer.encode``.

    A byte-level vocabulary of this kind always cuts before a lone space or line
    feed between other characters, and before a comma or full stop that ends a
    word behind an ASCII letter or digit.  Texts are cut there; each distinct
    word, with what leads it, is encoded once and found again by a 64-bit hash
    in an open-addressed table.  Texts with white space of another shape are
    encoded whole, as are all texts where the file's settings are of another kind.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        cutter, added = made["pre_tokenizer"] or {}, [t["content"] for t in made["added_tokens"]]
        self.cuts = not made["normalizer"] and (cutter.get("type"), cutter.get("add_prefix_space"), cutter.get("use_regex", True)) == ("ByteLevel", False, True) and not any(set(t) & set(" \n,.") for t in added)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values(), default=0) + 1
        # Ids whose bytes begin with a space or a line feed, as the vocabulary spells them.
        self.starts = {b" ": np.zeros(size, bool), b"\n": np.zeros(size, bool)}
        for token, i in vocabulary.items():
            if token[:1] in ("Ġ", "Ċ"):
                self.starts[b" " if token[0] == "Ġ" else b"\n"][i] = True
        self.power, self.inverse = _powers(_BASE, PART_BYTES + 2), _powers(pow(_BASE, -1, 1 << 64), PART_BYTES + 2)
        self.edge, self.alnum = np.zeros(256, bool), np.zeros(256, bool)
        self.edge[[32, 10, FIRST]] = True
        self.alnum[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
        self._clear()

    def _clear(self) -> None:
        """An empty store.  Slot 0 is that of words that make a text one to encode whole."""
        self.keys, self.slots = np.zeros(CELLS, np.uint64), np.zeros(CELLS, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.n = np.zeros(HELD_WORDS + PART_BYTES + 2, np.int32), 1

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1."""
        at = (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        out, left = np.full(len(hashes), -1, np.int32), np.arange(len(hashes))
        while len(left):
            key = self.keys[at]
            same = key == hashes[left]
            out[left[same]] = self.slots[at[same]]
            on = ~same & (key != 0)
            left, at = left[on], (at[on] + 1) & (CELLS - 1)
        return out

    def _insert(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        at = (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        while len(at):
            cells, first = np.unique(at, return_index=True)
            first = first[self.keys[cells] == 0]
            self.keys[at[first]], self.slots[at[first]] = hashes[first], slots[first]
            on = np.ones(len(at), bool)
            on[first] = False
            hashes, slots, at = hashes[on], slots[on], (at[on] + 1) & (CELLS - 1)

    def _store(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """New slots for words whose ids stand one after the other."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        n = len(begins)
        self.begin[self.n : self.n + n] = self.used + begins
        self.used += len(ids)
        self.begin[self.n + n] = self.used
        self.n += n
        return np.arange(self.n - n, self.n, dtype=np.int32)

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Slots of new words, each with the byte that leads it."""
        out = np.zeros(len(words), np.int32)
        kinds: dict[bytes, list[int]] = {b" ": [], b"\n": [], b"": []}
        for i, w in enumerate(words):
            lead = w[:1]
            if lead not in kinds:
                kinds[b""].append(i)  # a text's first word, or a mark
            elif len(w) > 1 and (w[1] < 128 or not w[1:5].decode("utf-8", "ignore")[:1].isspace()) and not w[1:2].isspace() and not 28 <= w[1] <= 31:
                kinds[lead].append(i)
        for lead, which in kinds.items():
            for k in range(0, len(which), 512):
                part = [words[i] for i in which[k : k + 512]]
                if lead:
                    ids = np.array(self.tokenizer.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
                    begins = np.flatnonzero(self.starts[lead][ids])
                if not lead or len(begins) != len(part) or begins[0]:
                    each = [np.frombuffer(x, "<u4") for x in self.whole([w.removeprefix(b"\xff").decode() for w in part])]
                    ids, sizes = np.concatenate(each), np.array([len(x) for x in each])
                    begins = np.cumsum(sizes) - sizes
                out[which[k : k + 512]] = self._store(ids, begins)
        return out

    def _part(self, texts: list[bytes]) -> Iterator[bytes | None]:
        """Ids of texts, each led by the byte FIRST; None for one that is to be encoded whole."""
        raw = b"".join(texts)
        b = np.frombuffer(raw, np.uint8)
        edge = self.edge[b]
        mark = ((b == 44) | (b == 46)) & np.append(edge[1:], True)
        mark[1:] &= self.alnum[b[:-1]]
        cut = np.flatnonzero(edge | mark)
        end = np.append(cut[1:], len(b))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.inverse[: len(b)], out=sums[1:])
        size = end - cut
        h = (sums[end] - sums[cut]) * self.power[cut] + size.astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h[h == 0] = 1
        slot = self._find(h)
        slot[size > LONGEST] = 0
        if (slot < 0).any():
            if self.n + int((slot < 0).sum()) > HELD_WORDS:
                self._clear()
                slot = np.where(size > LONGEST, 0, -1).astype(np.int32)
            miss = np.flatnonzero(slot < 0)
            new, where, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            first = miss[where]
            made = self._learn([raw[x:y] for x, y in zip(cut[first].tolist(), end[first].tolist(), strict=True)])
            self._insert(new, made)
            slot[miss] = made[inverse]
        begin = self.begin[slot]
        n = np.where(slot > 0, self.begin[slot + 1] - begin, 0)
        ends = np.cumsum(n, dtype=np.int64)
        place = np.repeat(begin - (ends - n).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        ids = self.ids[place].astype("<u4").tobytes()
        of = np.flatnonzero(b[cut] == FIRST)
        bounds = [0, *ends[of[1:] - 1].tolist(), int(ends[-1])]
        odd = np.add.reduceat(slot == 0, of)
        for i, bad in enumerate(odd.tolist()):
            yield None if bad else ids[4 * bounds[i] : 4 * bounds[i + 1]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.cuts:
            return self.whole([t or "" for t in texts])
        out: list[bytes] = []
        held: list[bytes] = []
        n = begin = 0

        def flush() -> None:
            for i, ids in enumerate(self._part(held) if held else ()):
                out.append(self.whole([texts[begin + i] or ""])[0] if ids is None else ids)
            held.clear()

        for i, t in enumerate(texts):
            raw = b"\xff" + (t or "").encode()
            if held and n + len(raw) > PART_BYTES:
                flush()
            if not held:
                begin, n = i, 0
            if len(raw) > PART_BYTES:
                out.append(self.whole([t or ""])[0])
                continue
            held.append(raw)
            n += len(raw)
        flush()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker and vocabulary."""
    return Encoder(path)
