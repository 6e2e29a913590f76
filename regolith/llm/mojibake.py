"""Text decoded with the wrong character encoding: noisy-channel restoration.

Each word with a character outside ASCII is turned back, for every pair of (true encoding, wrong encoding), into the
bytes that were read wrongly. The bytes span a lattice: an edge decodes one character of the true encoding, a lost byte
(U+FFFD) is a wildcard for every character of the corpus' repertoire, and any character may also be kept as it stands
(for words damaged only in part). A Viterbi search over the lattice finds the likeliest reading under character
statistics weighted by corpus word frequencies; whole-word frequencies then decide between the best reading and the
text as it stands. Twice-damaged text is decoded again until nothing changes.

Size of what is sent to the executors: words and trigrams enter the model when they make up at least ``share`` of all
counted tokens, so at most 1/``share`` words and 6/``share`` trigrams qualify at any corpus size.

Defined results: null, empty and pure-ASCII values are no cases; a value with U+FFFD or a C1 control character is always
a case, its lost characters restored to the likeliest ones (left as U+FFFD where the model knows none); HTML entities,
typing errors and dropped accents are no cases; repeated rows give repeated results; rows without a key give none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regolith.functions.frames import frame_of
from regolith.session import cut

LOST = "�"
WRONG = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859_2", "iso8859_15", "koi8_r", "cp866")
RIGHT = ("utf-8", "cp1252", "mac_roman", "cp850")
TOKEN = r"""[ \t\r\n;,/|"()\[\]+#*&<>=:]+"""
_SPLIT = re.compile(r"""([ \t\r\n;,/|"()\[\]+#*&<>=:]+)""")
_PLAIN = re.compile(r"^[\x00-\x7f]*$")


def _shape(token: str) -> str:
    return re.sub(r"[0-9]", "0", token.lower())


def _tables() -> tuple[dict[str, dict[str, int]], dict[str, list[str | None]]]:
    """Byte of each character in the wrong encodings; character of each byte in the true single-byte ones."""
    to_byte: dict[str, dict[str, int]] = {}
    for w in WRONG:
        own: dict[str, int] = {}
        for b in range(128, 256):
            try:
                own[bytes([b]).decode(w)] = b
            except UnicodeDecodeError:
                if w == "cp1252":
                    own[chr(b)] = b  # undefined bytes come through as C1 controls
        to_byte[w] = own
    to_char: dict[str, list[str | None]] = {}
    for r in RIGHT:
        if r != "utf-8":
            to_char[r] = [None] * 256
            for b in range(128, 256):
                try:
                    to_char[r][b] = bytes([b]).decode(r)
                except UnicodeDecodeError:
                    pass
    return to_byte, to_char


class Channel:
    """The language model and the search; built once per Python worker."""

    #: Nats by which a reading must beat the text as it stands; nats a kept character outside ASCII costs.
    MARGIN, KEEP = 1.2, 0.7
    #: States a first search follows at each place.
    STATES = 60

    def __init__(self, words: dict[str, int], grams: dict[str, int], done: dict[str, tuple[str, bool]] | None = None):
        self.words, self.grams = words, grams
        self.to_byte, self.to_char = _tables()
        self.total = max(1, sum(words.values()))
        context: dict[str, int] = {}
        letters: dict[str, int] = {}
        pairs: dict[str, int] = {}
        for g, n in grams.items():
            context[g[:2]] = context.get(g[:2], 0) + n
            if len(g) == 3:
                pairs[g[1:]] = pairs.get(g[1:], 0) + n
                letters[g[2]] = letters.get(g[2], 0) + n
        self.context, self.pairs, self.letters = context, pairs, letters
        self.all = max(1, sum(letters.values()))
        self.logs: dict[str, float] = {}
        self.repertoire = [c for c, n in sorted(letters.items(), key=lambda x: -x[1]) if ord(c) > 127 and c != LOST and not 0x80 <= ord(c) < 0xA0]
        self.peaks = self._peaks()
        self.done = dict(done or {})

    def gram(self, a: str, b: str, c: str) -> float:
        """log P(c | a b): trigram, bigram and single-character frequencies, interpolated."""
        g = a + b + c
        if (known := self.logs.get(g)) is None:
            n = self.context.get(a + b, 0)
            weight = n / (n + 3.0)
            second = self.pairs.get(b + c, 0) / (self.letters.get(b, 0) + 3.0)
            single = (self.letters.get(c, 0) + 0.05) / (self.all + 20.0)
            known = self.logs[g] = math.log(weight * 0.8 * (self.grams.get(g, 0) / n if n else 0.0) + (1 - weight * 0.8) * (0.8 * second + 0.2 * single))
        return known

    def score(self, token: str) -> float:
        """Log-likelihood of the trigrams that touch a character outside ASCII, each seen from left to right."""
        s = "^^" + _shape(token) + "$$"
        return sum(self.gram(s[i - 2], s[i - 1], s[i]) for i in range(2, len(s)))

    def _edges(self, token: str, right: str, wrong: str) -> list[list[tuple[int, str, bool]]]:
        """For each character, what may be read there: (next position, character, decoded)."""
        byte_of, edges = self.to_byte[wrong], []
        raised = [c.upper() if len(c.upper()) == 1 and ord(c) > 127 else c for c in token]
        n = len(token)

        def bytes_at(i: int) -> list[int | None]:
            if i >= n or ord(token[i]) < 128:
                return []
            if token[i] == LOST:
                return [None]
            return [b for b in dict.fromkeys((byte_of.get(token[i]), byte_of.get(raised[i]))) if b is not None]

        for i, c in enumerate(token):
            own = [(i + 1, c, False)]
            if ord(c) > 127:
                if c == LOST:
                    own = [(i + 1, x, True) for x in self.repertoire] + own
                if right == "utf-8":
                    for b in bytes_at(i):
                        if b is None:
                            size = range(2, 4)
                        elif 0xC2 <= b < 0xE0:
                            size = (2,)
                        elif 0xE0 <= b < 0xF0:
                            size = (3,)
                        else:
                            continue
                        for k in size:
                            self._utf8(token, i, k, b, bytes_at, own)
                else:
                    for b in bytes_at(i):
                        if b is not None and (x := self.to_char[right][b]) and x.lower() != c.lower():
                            own.append((i + 1, x, True))
            edges.append(own)
        return edges

    def _utf8(self, token, i, size, first, bytes_at, own) -> None:
        """Adds the characters whose UTF-8 bytes fit the next ``size`` characters, lost bytes fitting any."""
        rest = [bytes_at(i + k) for k in range(1, size)]
        if not all(rest):
            return
        if first is not None and all(b is not None for r in rest for b in r):
            for a in rest[0]:
                for z in rest[1] if size == 3 else [None]:
                    raw = bytes([first, a] if z is None else [first, a, z])
                    try:
                        own.append((i + size, raw.decode("utf-8"), True))
                    except UnicodeDecodeError:
                        pass
            return
        for x in self.repertoire:  # some byte is lost
            raw = x.encode("utf-8")
            if len(raw) == size and (first is None or raw[0] == first) and all(None in r or raw[k + 1] in r for k, r in enumerate(rest)):
                own.append((i + size, x, True))

    def _peaks(self) -> dict[str, float]:
        """For each character, no less than what ``gram`` gives for it after any two others."""
        tri: dict[str, float] = {}
        for g, n in self.grams.items():
            if len(g) == 3 and (p := n / self.context[g[:2]]) > tri.get(g[2], 0.0):
                tri[g[2]] = p
        two: dict[str, float] = {}
        for g, n in self.pairs.items():
            two[g[1]] = max(two.get(g[1], 0.0), n / (self.letters.get(g[0], 0) + 3.0))
        return {c: math.log(0.8 * tri.get(c, 0.0) + 0.8 * two.get(c, 0.0) + 0.2 * (n + 0.05) / (self.all + 20.0)) for c, n in self.letters.items()}

    def _viterbi(self, token: str, edges: list[list[tuple[int, str, bool]]]) -> tuple[float, str, bool]:
        """The likeliest path; the state is the last two characters read.

        A search among the likeliest states of each place finds a path; a second one then drops only states that cannot
        lead to a better one, as the most any rest of the word can add is known. Words without many wildcards need but the first.
        """
        best, whole = self._search(token, edges, None)
        if whole:
            return best
        rest = [-math.inf] * len(token) + [2 * max(0.0, self.peaks.get("$", 0.0))]  # the most the rest of the word can add
        for i in range(len(token) - 1, -1, -1):
            rest[i] = max((rest[j] + self.peaks.get("0" if c in "0123456789" else c.lower(), 0.0) for j, c, _ in edges[i]), default=-math.inf)
        return self._search(token, edges, [best[0] - r for r in rest])[0]

    def _search(self, token: str, edges: list[list[tuple[int, str, bool]]], least: list[float] | None) -> tuple[tuple[float, str, bool], bool]:
        """(likeliest path, whether all states were followed): those that reach ``least`` at their place, or ``STATES`` of a place where that is not given."""
        at: list[dict[tuple[str, str], tuple[float, str, bool]]] = [{} for _ in range(len(token) + 1)]
        at[0]["^", "^"] = (0.0, "", False)
        whole = True
        for i, own in enumerate(edges):
            states = at[i]
            if least is not None:
                states = {k: v for k, v in states.items() if v[0] >= least[i] - 1e-9}
            elif len(states) > self.STATES:
                whole = False
                states = dict(sorted(states.items(), key=lambda x: -x[1][0])[: self.STATES])
            for (a, b), (p, text, changed) in states.items():
                for j, c, decoded in own:
                    low = "0" if c in "0123456789" else c.lower()
                    low = low if len(low) == 1 else c
                    odd = decoded and c != low and b.islower() and text[-1:].islower()  # a capital inside a word
                    q = p + self.gram(a, b, low) - (0.4 * odd if decoded or ord(c) < 128 else self.KEEP)
                    key = (b, low)
                    if key not in at[j] or at[j][key][0] < q:
                        at[j][key] = (q, text + c, changed or decoded)
        best = (-math.inf, token, False)
        for (a, b), (p, text, changed) in at[-1].items():
            q = p + self.gram(a, b, "$") + self.gram(b, "$", "$")
            if q > best[0]:
                best = (q, text, changed)
        return best, whole

    def weight(self, token: str) -> float:
        """How much whole-word counts speak for the token."""
        return math.log(self.words.get(_shape(token), 0) + 0.5)

    def once(self, token: str) -> tuple[str, float]:
        """The best reading by any one channel, and its lead over the token as it stands."""
        stands = self.score(token) - self.KEEP * sum(ord(c) > 127 for c in token)
        known = self.weight(token)
        best, lead = token, 0.0
        seen = set()
        odd = [c for c in token if ord(c) > 127]
        for right in RIGHT:
            for wrong in WRONG:
                if wrong == right:
                    continue
                own = self.to_byte[wrong]
                read = (right, *[(own.get(c), own.get(c.upper())) for c in odd])
                if read in seen or (LOST not in token and not any(a or b for a, b in read[1:])):
                    continue  # the same bytes, or none, as by a channel before
                seen.add(read)
                edges = self._edges(token, right, wrong)
                if all(len(e) == 1 for e in edges):
                    continue
                key = tuple(tuple(e) for e in edges)
                if key in seen:
                    continue
                seen.add(key)
                p, text, changed = self._viterbi(token, edges)
                if changed and text.lower() != token.lower():
                    # words the corpus knows decide; elsewhere the character statistics alone do
                    w = self.weight(text) - known
                    gain = p - stands + (w if self.words.get(_shape(text), 0) else min(w, 0.0))
                    if gain > lead:
                        best, lead = text, gain
        return best, lead

    def restore(self, token: str) -> tuple[str, bool]:
        """(restored token, whether it is damaged)."""
        if (known := self.done.get(token)) is not None:
            return known
        damaged = LOST in token or any(0x80 <= ord(c) < 0xA0 for c in token)
        text, at, total = token, token, 0.0
        seen = {text}
        while True:  # text damaged twice gains little by the first step alone
            better, lead = self.once(at)
            if better in seen:
                break
            seen.add(better)
            total += lead
            at = better
            if total >= self.MARGIN or LOST in text:
                text, damaged = at, True
            if _PLAIN.match(at):
                break
        if len(self.done) < 200_000:
            self.done[token] = (text, damaged)
        return text, damaged


def corpus_tokens(df: DataFrame, fields: Sequence[str], times: str | None = None) -> DataFrame:
    """(w, n): the words outside ASCII as they are written, over all rows; a row stands for as many as ``times`` says."""
    tokens = df.select((F.col(times) if times else F.lit(1)).alias("n"), F.explode(F.array(*[F.col(f).cast("string") for f in fields])).alias("v")).where(F.col("v").rlike(r"[^\x00-\x7F]"))
    tokens = tokens.select("n", F.explode(F.split("v", TOKEN)).alias("w")).where(F.col("w").rlike(r"[^\x00-\x7F]"))
    return cut(tokens.groupBy("w").agg(F.sum("n").alias("n")))


def corpus_model(df: DataFrame, fields: Sequence[str], share: float = 1e-5) -> tuple[dict[str, int], dict[str, int]]:
    """Frequencies of words outside ASCII and of their trigrams, over all rows; both bounded by ``share``."""
    return tokens_model(corpus_tokens(df, fields), share)


def tokens_model(tokens: DataFrame, share: float = 1e-5) -> tuple[dict[str, int], dict[str, int]]:
    """The same from (w, n)."""
    shapes = cut(tokens.select(F.regexp_replace(F.lower("w"), r"\d", "0").alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n")))
    total = shapes.agg(F.sum("n")).first()[0] or 0
    words = {r.w: r.n for r in shapes.where((F.col("n") >= share * total) & (F.col("n") > 1)).collect()}
    padded = shapes.select(F.concat(F.lit("^^"), "w", F.lit("$$")).alias("s"), "n")
    grams = padded.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 2), lambda i: F.col("s").substr(i, F.lit(3)))).alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n"))
    return words, {r.g: r.n for r in grams.where(F.col("n") >= share * total).collect()}


def restored_tokens(tokens: DataFrame, model: Broadcast, share: float = 1e-5) -> dict[str, tuple[str, bool]]:
    """What ``Channel.restore`` gives for the words that make up at least ``share`` of all, at most 1/``share`` of them, each restored once.

    Workers that start from it need not each restore what stands in many names; rarer words they restore as they come.
    """
    total = tokens.agg(F.sum("n")).first()[0] or 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel = Channel(*model.value)
        for batch in batches:
            yield frame_of([(w, *channel.restore(w)) for w in batch["w"]], ("w", "text", "damaged"))

    often = tokens.where(F.col("n") >= share * total).select("w").repartition(2 * tokens.sparkSession.sparkContext.defaultParallelism, "w")
    return {r.w: (r.text, r.damaged) for r in often.mapInPandas(run, "w string, text string, damaged boolean").collect()}


def restore_text(df: DataFrame, key: str = "ord", fields: Sequence[str] = ("company_raw", "product_name"), share: float = 1e-5) -> DataFrame:
    """Damaged values: (key, field_name, value, restored, fully_restored)."""
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(corpus_model(df, fields, share))
    long = df.select(F.col(key).alias("_key"), F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields]))).where(F.col("_key").isNotNull() & F.col("value").rlike(r"[^\x00-\x7F]"))
    out = T.StructType([T.StructField("_key", df.schema[key].dataType), *[T.StructField(c, T.StringType()) for c in ("field_name", "value", "restored")], T.StructField("fully_restored", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel = Channel(*model.value)
        for batch in batches:
            rows = []
            for k, f, v in zip(batch["_key"], batch["field_name"], batch["value"]):
                hit, parts = False, _SPLIT.split(v)
                for i, part in enumerate(parts):
                    if i % 2 == 0 and not _PLAIN.match(part):
                        parts[i], damaged = channel.restore(part)
                        hit |= damaged
                if hit:
                    text = "".join(parts)
                    rows.append((k, f, v, text, LOST not in text and not any(0x80 <= ord(c) < 0xA0 for c in text)))
            yield frame_of(rows, ["_key", "field_name", "value", "restored", "fully_restored"])

    return long.mapInPandas(run, out).withColumnRenamed("_key", key)
