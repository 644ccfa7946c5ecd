"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton has every word sequence of every item.  A document's words stream
through it, which tracks the longest match that ends at each word; where that
reaches a window, the words of the window are hit.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GATHERED_BYTES, TEXT_BYTES, forget, map_texts

WINDOW = 10
#: Words of items in one automaton; more items make more automata, which a text passes in turns.
MAX_WORDS = 1_000_000
#: ASCII digits, and letters in lower case, stay; all other ASCII is a space.  Bytes of other characters stay.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised over items (key, words).

    Words are numbers.  Most states have one way on, which two arrays hold; the
    ways of the others are in small dictionaries.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.words: dict[bytes, int] = {}
        self.word, self.to, self.more = array("i", [-1]), array("i", [0]), {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        paths: list[array] = []
        for _, words in items:
            last, path = 0, array("i")
            for w in words:
                last = self._extend(last, self.words.setdefault(w, len(self.words)))
                path.append(last)
            paths.append(path)
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        #: For each state whose strings hold a window, the state of their last window.
        self.hold = array("i", [-1]) * len(self.link)
        for s in order:
            if self.length[s] >= window:
                self.hold[s] = s if self.length[self.link[s]] < window else self.hold[self.link[s]]
        #: Items by the states of their windows; whole items shorter than a window, by state: (words, items).
        whole: dict[int, set[str]] = {}
        short: dict[int, dict[int, set[str]]] = {}
        for (key, words), path in zip(items, paths, strict=True):
            size = len(words)
            if size >= window:
                for state in path[window - 1 :]:
                    whole.setdefault(self.hold[state], set()).add(key)
            elif size:
                state = path[-1]
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                short.setdefault(state, {}).setdefault(size, set()).add(key)
        self.whole = {s: tuple(sorted(k)) for s, k in whole.items()}
        self.short = {s: [(n, tuple(sorted(k))) for n, k in of.items()] for s, of in short.items()}
        # Nearest state at or above each one that ends a whole short item.
        self.above = array("i", [-1]) * len(self.link)
        for s in order:
            self.above[s] = s if s in self.short else (self.above[self.link[s]] if s else -1)

    def _next(self, p: int, w: int) -> int:
        """Where a word leads, or -1."""
        if self.word[p] == w:
            return self.to[p]
        more = self.more.get(p)
        return more.get(w, -1) if more else -1

    def _lead(self, p: int, w: int, q: int) -> None:
        if self.word[p] in (-1, w):
            self.word[p], self.to[p] = w, q
        else:
            self.more.setdefault(p, {})[w] = q

    def _new(self, length: int, link: int) -> int:
        self.word.append(-1)
        self.to.append(0)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of the strings of q that p, one word longer, spells: q itself or a part taken from it."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._new(self.length[p] + 1, self.link[q])
        self.word[part], self.to[part] = self.word[q], self.to[q]
        if q in self.more:
            self.more[part] = dict(self.more[q])
        self.link[q] = part
        while p >= 0 and self._next(p, w) == q:
            self._lead(p, w, part)
            p = self.link[p]
        return part

    def _extend(self, last: int, w: int) -> int:
        to = self._next(last, w)
        if to >= 0:
            return self._split(last, w, to)
        new = self._new(self.length[last] + 1, 0)
        p = last
        while p >= 0 and (to := self._next(p, w)) < 0:
            self._lead(p, w, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, to)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans [start, end), in order and apart, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state, n, window = 0, 0, self.window
        word, way, more, link, length, hold, above, short = self.word, self.to, self.more, self.link, self.length, self.hold, self.above, self.short
        number = self.words.get
        for i, w in enumerate([number(w, -2) for w in words], 1):
            if w == -2:
                state = n = 0
                continue
            if word[state] == w:
                state = way[state]
                n += 1
            else:
                while (to := more[state].get(w, -1) if state in more else -1) < 0 and state:
                    state = link[state]
                    n = length[state]
                    if word[state] == w:
                        to = way[state]
                        break
                if to < 0:
                    n = 0
                    continue
                state = to
                n += 1
            if n < window and above[state] < 0:
                continue
            reach = 0
            if n >= window:
                reach = window
                items.update(self.whole.get(hold[state], ()))
            s = above[state]
            while s >= 0:
                for size, keys in short[s]:
                    if size <= n:
                        reach = max(reach, size)
                        items.update(keys)
                s = above[link[s]] if s else -1
            if reach:
                start = i - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        return spans, items


def _groups(items: DataFrame, id: str, text: str, max_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in groups of at most ``max_words`` words; one group at a time is on the driver."""
    group, held = [], 0
    for r in items.select(F.col(f"`{id}`").cast("string").alias("k"), F.col(f"`{text}`").alias("t")).toLocalIterator():
        words = words_of(r["t"])
        if not words:
            continue
        if held and held + len(words) > max_words:
            yield group
            group, held = [], 0
        group.append((r["k"] or "", words))
        held += len(words)
    if group:
        yield group


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, spans (array of start and end, in words), items (sorted array of ids as strings) and longest.

    A window is ``window`` consecutive words of an item, or a whole item of
    fewer.  Null and empty texts have no words; items without words have no
    windows; the id of an item without one is "".  Repeated items count once by
    id, and ties (one window in several items) name them all.  Texts are read
    whole at any length, in time linear in it.  Each row is judged by itself, so
    repeated rows get the same; empty tables of documents or items are no
    special case.  Other columns pass through; those with the names above, in
    any case, are replaced.
    """
    spark, added = docs.sparkSession, "n_words long, n_hit long, spans array<array<int>>, items array<string>, longest long"
    held = [spark.sparkContext.broadcast(SuffixAutomaton(group, window)) for group in _groups(items, item_id, item_text, max_words)]

    def each(batch: pa.RecordBatch) -> list:
        texts = [words_of(t) for t in batch.column(0).to_pylist()]
        found: list[tuple[list, set]] = [([], set()) for _ in texts]
        for automaton in held:
            scan = automaton.value.scan
            for words, (spans, names) in zip(texts, found, strict=True):
                more, keys = scan(words)
                spans += more
                names |= keys
            if len(held) > 1:
                forget(automaton)
        spans = [_union(x) if len(held) > 1 else x for x, _ in found]
        return [[len(w) for w in texts], [sum(b - a for a, b in x) for x in spans], [[list(s) for s in x] for x in spans], [sorted(k) for _, k in found], [max((b - a for a, b in x), default=0) for x in spans]]

    return map_texts(docs, [text], added, each, text_bytes=GATHERED_BYTES if len(held) > 1 else TEXT_BYTES, gather=len(held) > 1)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", max_span: int = 0, max_coverage: float = 0.0, window: int = WINDOW) -> DataFrame:
    """``docs`` with the spans of more than ``max_span`` words cut out, and without documents of more than ``max_coverage``.

    Coverage is the share of a document's words that are hit.  With the default
    limits every document with a hit goes, which is the strict form.  With a
    coverage limit of 1.0 no document goes, and spans are cut.  What is cut is
    replaced by one space; other text is left as it was, a null one null.  Nulls,
    ties, repeats and empty tables are as in :func:`find_hits`; documents with
    columns of the names that it adds keep their own.
    """
    # The documents' own columns travel in a struct, out of the way of what is added.
    whole = docs.select(F.col(f"`{text}`").alias("text"), F.struct("*").alias("__row"))
    found = find_hits(whole, items, "text", window=window)
    kept = found.where(F.col("n_hit") <= F.col("n_words") * F.lit(max_coverage))

    def cut(batch: pa.RecordBatch) -> list:
        out = []
        for t, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            long = [s for s in spans if s[1] - s[0] > max_span]
            out.append(_cut(t, long) if long else t)
        return [out]

    done = map_texts(kept, ["text", "spans"], T.StructType([T.StructField("text", T.StringType())]), cut)
    return done.select([F.col("text").alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def _cut(text: str, spans: list[list[int]]) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.translate(_FOLD)
    places, i, n = [], 0, len(folded)
    for word in folded.split():
        i = folded.index(word, i)
        places.append((i, i + len(word)))
        i += len(word)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    out.append(raw[at:n])
    return b" ".join(x.strip(b" ") for x in out).decode("utf-8", "surrogatepass")
