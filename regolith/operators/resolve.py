"""Company and product verdicts, leader clustering, and products held across countries."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import inf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.functions import similarity, text
from regolith.functions.frames import frame
from regolith.session import cut


def discriminator(tokens: Column) -> Column:
    """The word two names must share: the first, or the first two where the first has under three letters."""
    first, second = F.try_element_at(tokens, F.lit(1)), F.try_element_at(tokens, F.lit(2))
    return F.when((F.length(first) < 3) & second.isNotNull(), F.concat_ws(" ", first, second)).otherwise(first)


def with_verdict(pairs: DataFrame, left: Column, right: Column, name: str = "verdict") -> DataFrame:
    """The pairs with struct(score, first_token_match, verdict, reason) of two company names; tokens are made once."""
    staged = pairs.withColumns({"_a": text.company_tokens(left), "_b": text.company_tokens(right)})
    staged = staged.withColumns({"_score": similarity.token_set_ratio(F.col("_a"), F.col("_b"))})
    return staged.withColumn(name, company_verdict(F.col("_a"), F.col("_b"), F.col("_score"))).drop("_a", "_b", "_score")


def company_verdict(a: Column, b: Column, score: Column) -> Column:
    """struct(score, first_token_match, verdict, reason) from two token arrays and their likeness."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    same = F.coalesce(discriminator(a) == discriminator(b), F.lit(False))
    verdict = F.when(empty | ~same, "no-match").when(score >= 80, "match").when(score >= 60, "review").otherwise("no-match")
    shown = F.format_string("%.0f", score)
    reason = (
        F.when(empty, F.lit("one or both names are empty after normalisation"))
        .when(~same, F.concat(F.lit("first tokens differ ('"), discriminator(a), F.lit("' vs '"), discriminator(b), F.lit("')")))
        .when(score >= 80, F.concat(F.lit("first token '"), F.element_at(a, 1), F.lit("', similarity "), shown))
        .otherwise(F.concat(F.lit("first token matches but similarity only "), shown))
    )
    return F.struct(F.when(empty, F.lit(0.0)).otherwise(score).alias("score"), (same & ~empty).alias("first_token_match"), verdict.alias("verdict"), reason.alias("reason"))


def tokens_ratio(a: list[str], b: list[str]) -> float:
    """``token_set_ratio`` of two token lists, in Python."""
    x, y = set(a), set(b)
    if not x or not y:
        return 0.0
    both, ea, eb = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not ea or not eb):
        return 100.0
    li, la, lb = len(both), len(ea), len(eb)
    gap = 1 if li else 0
    ia, ib = li + (gap if la else 0) + la, li + (gap if lb else 0) + lb
    ratio = lambda d, n: 100.0 if n == 0 else 100.0 - 100.0 * d / n
    best = ratio(la + lb - 2 * similarity.lcs(ea, eb), ia + ib)
    return max(best, ratio(1 + la, li + ia), ratio(1 + lb, li + ib)) if li else best


def group_companies(names: DataFrame, column: str = "company_raw") -> DataFrame:
    """(name, representative): each distinct name joins the first representative it matches, shortest names first.

    A match needs equal discriminators, so blocks by discriminator lose nothing; a block holds distinct names only.
    Names without tokens stand for themselves; null and empty names are dropped.
    """
    distinct = names.select(F.col(column).alias("name")).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct().withColumn("tokens", text.company_tokens("name"))
    keyed = distinct.withColumn("block", discriminator(F.col("tokens")))

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["name"], pdf["tokens"]), key=lambda r: (len(r[0]), r[0]))
        leaders: list[tuple[str, list[str]]] = []
        out = []
        for name, tokens in rows:
            own = list(tokens)
            for leader, its in leaders:
                if tokens_ratio(its, own) >= 80:
                    out.append(leader)
                    break
            else:
                leaders.append((name, own))
                out.append(name)
        return frame(name=[r[0] for r in rows], representative=out)

    blocked = keyed.where(F.col("block").isNotNull()).groupBy("block").applyInPandas(lead, "name string, representative string")
    return blocked.unionByName(keyed.where(F.col("block").isNull()).select("name", F.col("name").alias("representative")))


def group_records(records: DataFrame, query: str) -> DataFrame:
    """Records of every group of which some member matches the query, with their representative."""
    groups = cut(group_companies(records))
    hit = with_verdict(groups, F.lit(query), F.col("name")).where("verdict.verdict = 'match'").select("representative").distinct()
    members = groups.join(hit, "representative", "left_semi").select(F.col("name").alias("company_raw"), "representative")
    return records.join(members, "company_raw")


def usable(prefix: str = "") -> Column:
    """Ingredient known, and strength or form known."""
    return (F.size(prefix + "inn") > 0) & ((F.size(prefix + "strength") > 0) | F.col(prefix + "form").isNotNull())


def product_verdict(left: str = "l_", right: str = "r_") -> Column:
    """struct(verdict, score, matched_on) of two records whose inn, strength and form have these prefixes."""
    li, ri = F.array_join(left + "inn", " "), F.array_join(right + "inn", " ")
    score = similarity.token_sort_ratio(li, ri)
    both = lambda x: (F.size(left + x) > 0) & (F.size(right + x) > 0)
    strong, form = both("strength"), F.col(left + "form").isNotNull() & F.col(right + "form").isNotNull()
    differs = (strong & (F.col(left + "strength") != F.col(right + "strength"))) | (form & (F.col(left + "form") != F.col(right + "form")))
    n = F.lit(1) + strong.cast("int") + form.cast("int")
    unusable = ~usable(left) | ~usable(right)
    verdict = F.when(unusable | (score < 85) | differs, "no-match").when(n == 1, "review").otherwise("match")
    value = F.when(unusable, F.lit(0.0)).when((verdict == "match") & (n < 3), score * 0.9).otherwise(score)
    matched = F.when(unusable | (score < 85), F.lit("")).otherwise(F.concat_ws(",", F.lit("inn"), F.when(strong & (F.col(left + "strength") == F.col(right + "strength")), F.lit("strength")), F.when(form & (F.col(left + "form") == F.col(right + "form")), F.lit("form"))))
    return F.struct(verdict.alias("verdict"), value.alias("score"), matched.alias("matched_on"))


def _alike(x: str, y: str) -> bool:
    """Whether two texts of sorted words reach 85; lengths alone settle most pairs."""
    if x == y:
        return bool(x)
    total = len(x) + len(y)
    return bool(x) and bool(y) and 200.0 * min(len(x), len(y)) >= 85.0 * total and 200.0 * similarity.lcs(x, y) / total >= 85


class _Letters:
    """A text's letters in 32 classes, the first four of each as bits, those beyond counted: what two texts share of them bounds their common subsequence."""

    __slots__ = ("bits", "over", "size", "text")

    def __init__(self, text: str) -> None:
        self.text, self.size, self.over = text, len(text), 0
        low = high = 0
        for letter, n in Counter(ord(x) & 31 for x in text).items():
            first = min(n, 4)
            low |= ((1 << min(first, 2)) - 1) << 2 * letter
            high |= ((1 << max(first - 2, 0)) - 1) << 2 * letter
            self.over += n - first
        self.bits = (np.uint64(low), np.uint64(high))


class _Heads:
    """Products of one kind in the order they were found; finds the first alike in the letters without comparing each."""

    __slots__ = ("at", "texts", "exact", "low", "high", "over", "size")

    def __init__(self) -> None:
        self.at: list[int] = []
        self.texts: list[str] = []
        self.exact: dict[str, int] = {}
        self.low, self.high = np.empty(8, np.uint64), np.empty(8, np.uint64)
        self.over, self.size = np.empty(8, np.int64), np.empty(8, np.int64)

    def add(self, at: int, x: _Letters) -> None:
        n = len(self.at)
        if n == len(self.low):
            for name in ("low", "high", "over", "size"):
                held = getattr(self, name)
                setattr(self, name, np.concatenate([held, np.empty_like(held)]))
        self.low[n], self.high[n] = x.bits
        self.over[n], self.size[n] = x.over, x.size
        self.exact.setdefault(x.text, n)
        self.at.append(at)
        self.texts.append(x.text)

    def first(self, x: _Letters, before: float, alike: Callable[[str, str], bool]) -> float:
        """The first product alike, if there is one before a given one; else that."""
        n = min(self.exact.get(x.text, len(self.at)), bisect_left(self.at, before))
        if n:
            shared = np.bitwise_count(self.low[:n] & x.bits[0]).astype(np.int64) + np.bitwise_count(self.high[:n] & x.bits[1]) + np.minimum(self.over[:n], x.over)
            for i in np.flatnonzero(200 * shared >= 85 * (self.size[:n] + x.size)).tolist():
                if alike(self.texts[i], x.text):
                    return self.at[i]
        i = self.exact.get(x.text)
        return before if i is None or not x.text else min(before, self.at[i])


class _Products:
    """The products of one company, found in record order."""

    def __init__(self) -> None:
        self.heads: list[tuple] = []
        self.placed: dict[tuple, int] = {}
        self.letters: dict[str, _Letters] = {}
        # by strength and form where both are to be compared or one is unknown; by strength, and by form, whatever the other is
        self.both: dict[tuple, _Heads] = defaultdict(_Heads)
        self.strong: dict[tuple[str, ...], _Heads] = defaultdict(_Heads)
        self.shaped: dict[str, _Heads] = defaultdict(_Heads)
        self.alike = lru_cache(1 << 18)(_alike)

    def place(self, inn: list[str], strength: list[str], form: str | None) -> int:
        """The first product an identity agrees with, else a new one: strengths and forms known on both sides are equal, one of them is, ingredients are alike."""
        identity = (tuple(inn), tuple(strength), form)
        if (known := self.placed.get(identity)) is not None:
            return known
        words = " ".join(sorted(" ".join(inn).split()))
        if (x := self.letters.get(words)) is None:
            x = self.letters[words] = _Letters(words)
        s, f = tuple(strength), form or None
        if s and f:
            asked = [self.both.get(k) for k in ((s, f), (s, None), ((), f))]
        else:
            asked = [self.strong.get(s) if s else self.shaped.get(f) if f else None]
        found: float = inf
        for heads in asked:
            if heads is not None:
                found = heads.first(x, found, self.alike)
        if found == inf:
            found = len(self.heads)
            self.heads.append((inn, strength, form))
            self.both[s, f].add(found, x)
            if s:
                self.strong[s].add(found, x)
            if f:
                self.shaped[f].add(found, x)
        self.placed[identity] = int(found)
        return int(found)


def presences(records: DataFrame, group: str = "company") -> DataFrame:
    """(group, presence, inn, strength, form, country, ord): products of each group and the first record per country.

    ``records`` has ord, country, inn, strength, form; approval_date where it has that too. The first presence, in record order, that matches takes a record; a
    presence keeps the identity of its first record. Only distinct identities are compared, since equal
    identities always meet the same presence; records too thin to identify are left out. A task reads its groups one after
    the other in record order and keeps one group's presences and identities; a product's first row in a country is its
    first record there.
    """
    fields = ["inn", "strength", "form"]
    dated = [F.min_by("approval_date", "ord").alias("approval_date")] if "approval_date" in records.columns else []
    rows = records.where(usable()).groupBy(group, *fields, "country").agg(F.min("ord").alias("ord"), *dated)
    kinds, passed = dict(rows.dtypes), rows.columns[5:]

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: object = _Products  # of no group yet
        products = _Products()
        seen: set[tuple[int, str | None]] = set()
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in (group, *fields, "country", *passed)}
            first, at, heads = [], [], []
            for i, (owner, country, *identity) in enumerate(zip(*[columns[c].to_pylist() for c in (group, "country", *fields)])):
                if owner != own:
                    own, products, seen = owner, _Products(), set()
                presence = products.place(*identity)
                if (presence, country) not in seen:
                    seen.add((presence, country))
                    first.append(i)
                    at.append(presence)
                    heads.append(products.heads[presence])
            if first:
                shown = [pa.array(x, columns[c].type) for c, x in zip(fields, zip(*heads))]
                kept = pa.array(first, pa.int64())
                yield pa.RecordBatch.from_arrays([columns[group].take(kept), pa.array(at, pa.int32()), *shown, *[columns[c].take(kept) for c in ("country", *passed)]], [group, "presence", *fields, "country", *passed])

    schema = ", ".join(f"`{c}` {'int' if c == 'presence' else kinds[c]}" for c in (group, "presence", *fields, "country", *passed))
    return rows.repartition(group).sortWithinPartitions(group, "ord").mapInArrow(greedy, schema)
