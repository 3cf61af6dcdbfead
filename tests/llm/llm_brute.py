"""Plain single-machine versions of the corpus operators, straight from their definitions."""

import collections
import hashlib
import re
import struct
import zlib
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

SPACE = " \t\n\x0b\x0c\r"


@lru_cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(struct.pack(f"<{len(values)}I", *values))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), failed


def edit_distance(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def allowed_edits(n):
    return n // 20 if n >= 100 else 2 if n >= 40 else 1 if n >= 20 else 0


def could_be(a, b, edits):
    """An edit adds at most one character that the other string lacks."""
    x, y = collections.Counter(a), collections.Counter(b)
    return max((x - y).total(), (y - x).total()) <= edits


def line_removals(docs):
    """{doc_id: (numbers of removed lines, how many are near lines)} of (doc_id, text) rows."""
    first, places = {}, []
    for doc, text in sorted(docs):
        for number, line in enumerate((text or "").split("\n")):
            if words(line):
                line = line.strip(SPACE)
                places.append((doc, number, line))
                first.setdefault(line, (doc, number))
    by_length, near = collections.defaultdict(list), set()
    for line in sorted(first, key=first.get):
        reach = max(2, len(line) // 19)
        for n in range(len(line) - reach, len(line) + reach + 1):
            edits = allowed_edits(min(n, len(line)))
            if edits and any(could_be(line, o, edits) and edit_distance(line, o) <= edits for o in by_length[n]):
                near.add(line)
                break
        by_length[len(line)].append(line)
    out = {doc: ([], 0) for doc, _ in docs}
    for doc, number, line in places:
        removed, n_near = out[doc]
        if line in near or first[line] != (doc, number):
            out[doc] = (removed + [number], n_near + (line in near))
    return out


def without_lines(text, removed):
    return "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in set(removed))


def components(docs):
    """(doc_id, n_shingles, component_id) per row, by comparing all rows that share a shingle."""
    sets, holders = [], collections.defaultdict(list)
    for at, (_, text) in enumerate(docs):
        w = words(lower(text))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
        for shingle in sets[-1]:
            holders[shingle].append(at)
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for at, mine in enumerate(sets):
        shared = collections.Counter(o for shingle in mine for o in holders[shingle] if o > at)
        for other, n in shared.items():
            if 100 * n >= 80 * (len(mine) + len(sets[other]) - n):
                parent[root(other)] = root(at)
    least = {}
    for at, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(at)] = min(doc, least.get(root(at), doc))
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)]


def benchmark_hits(docs, items):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row."""

    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

    windows = collections.defaultdict(set)
    for item, text in items:
        w = split(text)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(item)
    out = []
    for doc, text in docs:
        w = split(text)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= {str(i) for i in windows[key] if i is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def repeats_removed(texts, length=200):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text among ``texts`` (bytes)."""
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        spans = len(re.findall(rb"\x01+", bytes(covered)))
        out.append((len(t), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def pieces(docs, end=1, size=4096):
    """(doc_id, piece, start, length, ids_crc32) rows."""
    out = []
    for doc, text in docs:
        x = ids(text) + [end]
        out += [(doc, k, a, len(x[a : a + size]), crc(x[a : a + size])) for k, a in enumerate(range(0, len(x), size))]
    return out


def smallest_capacity(sizes, shards):
    def fits(capacity):
        used, at = 1, 0
        for size in sizes:
            if size > capacity:
                return False
            if at + size > capacity:
                used, at = used + 1, 0
            at += size
        return used <= shards

    low, high = 1, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def by_key(rows):
    """Rows in an order that allows null."""
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, str(type(x)), x or 0) for x in r])
