"""Evaluation texts leaking into training text: a generalised suffix automaton over normalised test items.

All items are read into one suffix automaton over words. Training texts stream through it once; the state's length is the
longest suffix read so far that occurs in some item. Its suffix links lead to the items that share only a shorter one, so
the maximal matches of every item of at least ``SEED`` words are found, also those inside another's. Matches of one document and item are chained into stretches: every
matched word scores one, every word skipped or replaced on either side costs ``GAP``, and a stretch ends where the
score would fall by more than ``DROP``. So a few retyped words are bridged, but a text of the same manner with other
facts, in which every other word differs, never adds up. The best one or two stretches, in the item's order, must cover
``SHARE`` of the item's words.

Items are a stated set; they are read in blocks of at most ``BLOCK`` words, so the automaton sent to the executors is
bounded however many items there are, and every document meets every block.

Defined results: null, empty and blank texts and items, and those without an id, give no rows; items shorter than ``LEAST`` words count only where
wholly repeated; items of equal text are all reported; whole documents are read, whatever their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.functions.frames import frame_of

SEED, GAP, DROP, DENSE, SHARE, LEAST, BLOCK = 3, 1.6, 6.0, 0.6, 0.3, 6, 200_000
#: Runs of letters of any script, single characters of scripts written without blanks, runs of digits.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_WORDS = re.compile(rf"[{_UNSPACED}]|[^\W\d_{_UNSPACED}]+|\d+")
_MARKS = re.compile("[\u0300-\u036f]+")


def words(text: str | None) -> list[str]:
    """Words and numbers of any script, without case, accents and marks."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORDS.findall(text)


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers; each state knows the items and end places of its strings."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.own: list[list[tuple[int, int]]] = [[]]
        self.sizes = {i: len(w) for i, w in items}
        self.texts: dict[int, list[int]] = {}
        for item, text in items:
            last = 0
            self.texts[item] = [self.ids.setdefault(w, len(self.ids)) for w in text]
            for place, c in enumerate(self.texts[item]):
                last = self._extend(last, c)
                self.own[last].append((item, place))
        # a state's occurrences are its own and those of every state that links to it: a stretch of the list in the order of the link tree
        below: list[list[int]] = [[] for _ in self.link]
        for s, up in enumerate(self.link):
            if up >= 0:
                below[up].append(s)
        self.found: list[tuple[int, int]] = []
        self.first, self.last = [0] * len(self.link), [0] * len(self.link)
        todo = [(0, True)]
        while todo:
            s, entering = todo.pop()
            if entering:
                self.first[s] = len(self.found)
                self.found.extend(self.own[s])
                todo.append((s, False))
                todo.extend((x, True) for x in below[s])
            else:
                self.last[s] = len(self.found)

    @property
    def ends(self) -> list[list[tuple[int, int]]]:
        """(item, end place) of the strings of each state, written out."""
        return [self.found[a:b] for a, b in zip(self.first, self.last)]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        now = self._state(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = now
            p = link[p]
        if p == -1:
            link[now] = 0
        else:
            q = nxt[p][c]
            link[now] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return now

    def _state(self, size: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(size)
        self.own.append([])
        return len(self.length) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def matches(self, text: list[str], seed: int = SEED) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of every maximal match of at least ``seed`` words."""
        ids, nxt, link, length = self.ids, self.next, self.link, self.length
        state = size = 0
        for i, w in enumerate(text):
            c = ids.get(w)
            if c is None:
                if size >= seed:
                    yield i - 1, size, state
                state = size = 0
                continue
            if c in nxt[state]:
                state, size = nxt[state][c], size + 1
                continue
            if size >= seed:
                yield i - 1, size, state
            while state and c not in nxt[state]:
                state = link[state]
            size = length[state]
            if c in nxt[state]:
                state, size = nxt[state][c], size + 1
        if size >= seed:
            yield len(text) - 1, size, state

    def blocks(self, text: list[str], seed: int = SEED) -> Iterator[tuple[int, int, int, int]]:
        """(item, start in it, start in the text, length) of every run of at least ``seed`` words that item and text share and that neither side's next words prolong."""
        numbers = [self.ids.get(w) for w in text]
        nxt, link, length, texts, found, first, last = self.next, self.link, self.length, self.texts, self.found, self.first, self.last
        state = size = 0
        for i, c in enumerate(numbers):
            if c is None:
                state = size = 0
                continue
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state, size = nxt[state][c], size + 1
            if size < seed:
                continue
            after = numbers[i + 1] if i + 1 < len(numbers) else None
            at, shared, low, high = state, size, -1, -1
            while shared >= seed:
                a, b = first[at], last[at]
                # an ancestor holds what its descendants hold, and more on either side
                for k in range(a, b) if low < 0 else (*range(a, low), *range(high, b)):
                    item, place = found[k]
                    its = texts[item]
                    if after is None or place + 1 == len(its) or its[place + 1] != after:
                        yield item, place - shared + 1, i - shared + 1, shared
                low, high = a, b
                at = link[at]
                shared = length[at]


def stretches(blocks: list[tuple[int, int, int]]) -> list[tuple[float, int, int, int, int]]:
    """Chains matched blocks (item start, text start, size) into stretches (score, item start, item end, text start, text end)."""
    blocks.sort(key=lambda b: (b[1], b[0]))
    best: list[list[float]] = []  # score, item start, item end, text start, text end, peak
    live: list[list[float]] = []  # those that end near enough in the text for a block to be chained to
    for at, place, size in blocks:
        new = [float(size), at, at + size, place, place + size]
        live = [chain for chain in live if GAP * (place - chain[4]) <= DROP]
        for chain in live:
            gap_item, gap_text = at - chain[2], place - chain[4]
            if gap_item < 0 or gap_text < 0:  # overlap: take what lies beyond
                cut = max(-gap_item, -gap_text)
                if cut >= size:
                    continue
                gap_item, gap_text, own = gap_item + cut, gap_text + cut, size - cut
            else:
                own = size
            cost = GAP * max(gap_item, gap_text)
            if cost <= DROP and (score := chain[0] - cost + own) > new[0]:
                new = [score, chain[1], at + size, chain[3], place + size]
        best.append(new)
        live.append(new)
    taken: list[tuple[float, int, int, int, int]] = []
    for score, a, b, c, d in sorted(best, key=lambda x: -x[0]):
        if all(d <= t[3] or c >= t[4] for t in taken):
            taken.append((score, int(a), int(b), int(c), int(d)))
    return taken


def leaks(text: list[str], automaton: SuffixAutomaton, share: float = SHARE) -> list[tuple[int, float, int, int]]:
    """(item, share of its words, first and last word in the text) of items the text gives away."""
    by_item: dict[int, set[tuple[int, int, int]]] = {}
    seeds: dict[int, int] = {}
    for item, at, place, size in automaton.blocks(text):
        by_item.setdefault(item, set()).add((at, place, size))
        seeds[item] = seeds.get(item, 0) + size
    out = []
    for item, blocks in by_item.items():
        total = automaton.sizes[item]
        need = share if total >= LEAST else 0.99
        if seeds[item] < 0.5 * need * total:
            continue
        runs = [s for s in stretches(list(blocks)) if s[0] >= min(6, 0.6 * need * total) and s[0] >= DENSE * (s[2] - s[1])]
        best, where = 0.0, (0, 0)
        for i, (_, a, b, c, d) in enumerate(runs):
            covered = (b - a) / total
            if covered > best:
                best, where = covered, (c, d)
            for _, a2, b2, c2, d2 in runs[i + 1 :]:
                if (b <= a2 and d <= c2) or (b2 <= a and d2 <= c):  # one after the other in both
                    both = (b - a + b2 - a2) / total
                    if both > best:
                        best, where = both, (min(c, c2), max(d, d2))
        if best >= need:
            out.append((item, min(1.0, best), where[0], where[1]))
    return out


def find_leaks(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, share, first_word, last_word) of documents that give items away."""
    sized = items.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).dropDuplicates(["item_id"])
    blocks: list[list[tuple[int, list[str]]]] = [[]]
    held = 0
    for r in sized.orderBy("item_id").toLocalIterator():
        w = words(r.text)
        if not w:
            continue
        if held + len(w) > BLOCK and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append((r.item_id, w))
        held += len(w)
    out = None
    for block in blocks:

        def stream(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            automaton = SuffixAutomaton(block)
            for batch in batches:
                rows = []
                for doc, text in zip(batch["doc_id"], batch["text"]):
                    rows += [(doc, *x) for x in leaks(words(text), automaton, share)]
                yield frame_of(rows, ["doc_id", "item_id", "share", "first_word", "last_word"])

        one = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != "")).mapInPandas(stream, "doc_id long, item_id long, share double, first_word int, last_word int")
        out = one if out is None else out.unionByName(one)
    return out


def remove_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, words_removed, clean): documents without their leaked spans; untouched ones keep their text."""
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("first_word", "last_word")).alias("spans"))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, own in zip(batch["doc_id"], batch["text"], batch["spans"]):
                folded, back = [], []
                for i, c in enumerate(text):
                    for x in unicodedata.normalize("NFKD", c.lower()):
                        if not unicodedata.combining(x):
                            folded.append(x)
                            back.append(i)
                places = [(back[m.start()], back[m.end() - 1] + 1) for m in _WORDS.finditer("".join(folded))]
                gone, removed = bytearray(len(text)), 0
                for s in own:
                    a, b = s["first_word"], min(s["last_word"], len(places))
                    if a < b:
                        gone[places[a][0] : places[b - 1][1]] = b"\1" * (places[b - 1][1] - places[a][0])
                removed = sum(1 for a, _ in places if gone[a])
                rows.append((doc, removed, "".join(c for c, g in zip(text, gone) if not g)))
            yield frame_of(rows, ["doc_id", "words_removed", "clean"])

    documents = documents.select("doc_id", "text")
    touched = documents.where(F.col("text").isNotNull()).join(spans, "doc_id").mapInPandas(clean, "doc_id long, words_removed int, clean string")
    rest = documents.join(spans, "doc_id", "left_anti").select("doc_id", F.lit(0).alias("words_removed"), F.col("text").alias("clean"))
    return touched.unionByName(rest)
