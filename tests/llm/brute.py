"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text or "") if w]


def crc(ids: list[int]) -> int:
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def pieces(docs, encode, size=2048):
    """(doc_id, piece, start, length, crc)"""
    out = []
    for d, text in docs:
        ids = [*encode(text), 0]
        cuts = [0, *range(len(ids) % size or size, len(ids), size)] if len(ids) > size else [0]
        for k, a in enumerate(cuts):
            b = cuts[k + 1] if k + 1 < len(cuts) else len(ids)
            out.append((d, k, a, b - a, crc(ids[a:b])))
    return out


def line_dedup(docs, threshold=10):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(strip).translate(LOWER)
    held = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or held[key(x)] < threshold]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def token_starts(docs, encode):
    out, n = [], 0
    for d, t in docs:
        ids = [*encode(t), 2]
        out.append((d, n, len(ids), crc(ids)))
        n += len(ids)
    return out


def substring_dedup(docs, width=35):
    seen = Counter()
    for _, t in docs:
        w = words(t)
        seen.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def decontamination(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for k, t in items:
        w = split(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(str(k))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = split(t)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[x]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def decontaminated(docs, items, max_span, max_coverage, window=10):
    """{doc_id: sha256 of its text without long hit spans}, for documents whose coverage is within the limit."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    windows = {tuple(w[i : i + window]) for _, t in items for w in [split(t)] if w for i in range(max(1, len(w) - window + 1))}
    out = {}
    for d, t in docs:
        places, w = [m.span() for m in word.finditer((t or "").translate(LOWER))], split(t)
        hit = sorted({j for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)})
        if len(hit) > max_coverage * len(w):
            continue
        spans = []
        for j in hit:
            if spans and spans[-1][1] == j:
                spans[-1][1] = j + 1
            else:
                spans.append([j, j + 1])
        text, at = [], 0
        for a, b in spans:
            if b - a > max_span:
                text.append(t[at : places[a][0]])
                at = places[b - 1][1]
        out[d] = sha(" ".join(x.strip(" ") for x in [*text, t[at:]]) if text else t or "")
    return out


def secrets(docs):
    """(doc_id, n_assign, n_access, n_hex, base_sha256)"""
    kinds = [
        (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
        (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
        (re.compile(r"[0-9a-f]+"), 0, 32),
    ]
    names, out = ["assign", "access", "hex"], []
    for d, t in docs:
        spans = [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(kinds) for m in p.finditer(t or "") if len(m[g]) >= n]
        counts = [sum(s[1] == k for s in spans) for k in range(3)]
        out.append((d, *counts, sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans)))))
    return out


def quality(docs):
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    out = []
    for d, t in docs:
        w, seen, again = words(t), set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                again += line in seen
                seen.add(line)
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        out.append((d, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), again, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)))
    return out


def fingerprint(text, width=3):
    import xxhash

    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def clusters(prints, budget=2):
    """component id of each (doc_id, fingerprint)."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= budget:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        r = find(i)
        if d is not None and (r not in least or least[r] is None or d < least[r]):
            least[r] = d
        least.setdefault(r, d)
    return [(d, f, least[find(i)]) for i, (d, f) in enumerate(prints)]


class KneserNey:
    """Interpolated Kneser-Ney over characters in dictionaries, one model a label; orders below ``shared_below`` are counted over all labels."""

    def __init__(self, texts, order, shared_below=0):
        from loam.llm import kneser_ney as kn

        self.order, self.slots = order, kn.fold_table(60 // order)
        self.labels = sorted({k for _, k in texts})
        top = {k: Counter() for k in self.labels}
        for t, k in texts:
            top[k].update(self.grams(t))
        every = sum(top.values(), Counter())
        levels = {k: self.levels(c) for k, c in [*top.items(), (None, every)]}
        self.levels_of = {k: {n: levels[None if n < shared_below else k][n] for n in range(1, order + 1)} for k in self.labels}
        self.alphabet = len(levels[None][1]) + 1
        self.shapes = {k: {n: self.shape(c) for n, c in of.items()} for k, of in self.levels_of.items()}

    def folded(self, text):
        slots = [int(self.slots[ord(c)]) for c in (text or "").replace("\x02", " ").lower()]
        out = [32]
        for x in [*slots, 32]:
            if x != 32 or out[-1] != 32:
                out.append(x)
        return out

    def grams(self, text):
        """Each character of a text with the ``order - 1`` before it."""
        padded = [2] * (self.order - 1) + self.folded(text)
        return [tuple(padded[i : i + self.order]) for i in range(len(padded) - self.order + 1)]

    def levels(self, counts):
        out = {self.order: dict(counts)}
        for n in range(self.order - 1, 0, -1):
            out[n] = Counter(g[1:] for g in out[n + 1])
        return out

    @staticmethod
    def shape(counts):
        once, twice = (sum(v == i for v in counts.values()) for i in (1, 2))
        total, kinds = Counter(), Counter()
        for g, v in counts.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        return once / (once + 2 * twice) if once and twice else 0.5, total, kinds

    def p(self, label, gram):
        if not gram:
            return 1 / self.alphabet
        below = self.p(label, gram[1:])
        d, total, kinds = self.shapes[label][len(gram)]
        n = total[gram[:-1]]
        return (max(self.levels_of[label][len(gram)].get(gram, 0) - d, 0) + d * kinds[gram[:-1]] * below) / n if n else below

    def logs(self, text):
        """Per label the log probability of each character."""
        import math

        return {k: [math.log(self.p(k, g)) for g in self.grams(text)] for k in self.labels}


def language(model, text):
    """(lang_pred, score, cross_entropy)"""
    import math

    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, None
    loss = {k: -sum(x) / len(x) for k, x in model.logs(text).items()}
    best = min(sorted(loss), key=loss.get)
    n = len(model.grams(text))
    return best, 1 / sum(math.exp((loss[best] - x) * math.sqrt(n)) for x in loss.values()), loss[best]


def margin(model, text, prior=5):
    """The largest difference of toxic and ordinary log-likelihoods per character among a text's words, 0 at least."""
    logs, grams, at = model.logs(text), model.grams(text), []
    for i, g in enumerate(grams):
        at += [i] if g[-1] == 32 else []
    return max([0.0, *((sum(logs["1"][a:b]) - sum(logs["0"][a:b])) / (b - a + prior) for a, b in zip(at, [*at[1:], len(grams)]))])
