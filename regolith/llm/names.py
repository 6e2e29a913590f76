"""Variant spellings of company names: metric-space partitioning with exact radius joins.

A spelling is parsed into its distinctive core, further words, its trade words and its place. The metric is the
Damerau-Levenshtein distance (unrestricted, a true metric) between cores, together with the discrete metric on
places, so a cell never spans two cities of one country. In every place pivots are drawn from the cores; a core's home
is its nearest pivot, and it is replicated to every pivot p with d(core, p) <= R(p) + r, R(p) being the radius of p's
home cell: by the triangle inequality no pair within r is lost. Each cell joins its home cores with all its cores,
pruned by the lower bound |d(x, p) - d(y, p)| over all pivots before the exact metric is computed.

What is distinctive about a name the corpus tells: a word that stands beside many different others is one that companies add to
their names. Only legal forms, places and words of the trade are a fixed list. Cities are written in full, shortened or with a
typing error; the rarer writing of a country is mapped to the more frequent one it stands for.

Spellings without a city are one more place of their country, where they meet all its cores, and join the one cluster that fits best.

Defined results: null or blank names, and names of generic words only, link to nothing but their exact equals in the
same place; repeated rows (same spelling, other name_id) are linked like any others; a name_id listed twice counts once, a null one not at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.functions.frames import frame
from regolith.llm.canonical import fold
from regolith.operators.graph import components
from regolith.operators.packed import osa
from regolith.session import cut

RADIUS = 3
TYPOS = 2
#: Legal forms and address words.
LEGAL = frozenset("ltd limited plc inc incorporated corp corporation co company gmbh ag sa s a srl spa bv nv pvt pte private llc lp llp kg sas sarl ltda cia cie e et and the of und do da de la le les m ms c o dept import head office attn".split())
#: Countries in the registers' languages.
PLACES = frozenset("nigeria kenya tanzania brasil brazil mocambique mozambique senegal ghana uganda africa india international global overseas export".split())
#: Trade words and the group each stands for.
TRADES = {
    "pharmaceuticals": "pharma", "pharmaceutical": "pharma", "pharma": "pharma", "pharms": "pharma", "pharm": "pharma", "phcals": "pharma", "ph": "pharma", "phar": "pharma", "industries": "industries", "inds": "industries", "ind": "industries", "industry": "industries",
    "lifesciences": "life", "life": "life", "sciences": "life", "lifesci": "life", "sci": "life", "laboratories": "lab", "laboratory": "lab", "labs": "lab", "lab": "lab", "labor": "lab", "laboratorio": "lab", "laboratorios": "lab",
    "healthcare": "health", "health": "health", "care": "health", "hcare": "health", "h": "health", "remedies": "remedies", "remedy": "remedies", "rem": "remedies", "biotech": "biotech", "biotechnology": "biotech", "biot": "biotech", "bio": "biotech",
    "saude": "saude", "sde": "saude", "sante": "sante", "hygiene": "hygiene", "hyg": "hygiene", "farmaceutica": "farmaceutica", "farmac": "farmaceutica", "farm": "farmaceutica", "distribuicao": "distribuicao", "distr": "distribuicao", "dist": "distribuicao",
    "industria": "industria", "quimica": "industria", "quim": "industria", "produtos": "produtos", "prod": "produtos", "medicos": "produtos", "med": "produtos", "biologicos": "produtos", "biol": "produtos", "comercio": "", "medicaments": "medicaments", "generique": "generique", "therapeutique": "generique", "gen": "generique", "ther": "generique",
    "societe": "societe", "ste": "societe", "generale": "societe", "praparate": "praparate", "arzneimittel": "arznei", "heilmittel": "heil", "tech": "biotech",
}
def _deletions(word: str, most: int) -> set[str]:
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class Lexicon:
    """The words that do not tell companies apart: legal forms, places, trade words, and the words a corpus adds to its names."""

    def __init__(self, added: Iterable[str] = ()):
        added = {w for w in added if w not in LEGAL and w not in PLACES and w not in TRADES}
        self.added = frozenset(added)
        self.groups = {**{w: "x:" + w for w in added}, **{w: "" for w in LEGAL | PLACES}, **{w: "t:" + g if g else "" for w, g in TRADES.items()}}
        # those that companies add to their names first, as an abbreviation stands for them before legal forms
        self.long = sorted((w for w in self.groups if len(w) >= 5 or w in added), key=lambda w: (w not in added, w not in TRADES, w))
        #: The long words by what is left of them after up to two deletions: two words within two edits share such a rest.
        self.rests: dict[str, list[str]] = {}
        for w in self.long:
            for rest in _deletions(w, 2) if len(w) >= 5 else ():
                self.rests.setdefault(rest, []).append(w)
        self.seen: dict[tuple[str, bool], str | None] = {}

    def group(self, word: str, short: bool) -> str | None:
        """The group of a generic word ('' for legal forms and places), by spelling, abbreviation or a near miss; else None."""
        key = (word, short)
        if key not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[key] = self._group(word, short)
        return self.seen[key]

    def _group(self, word: str, short: bool) -> str | None:
        if word in self.groups:
            return self.groups[word]
        if short and len(word) >= 2:
            for w in self.long:
                if w.startswith(word):
                    return self.groups[w]
        if len(word) >= 5:
            most = 1 if len(word) <= 6 else 2
            near = {w for rest in _deletions(word, most) for w in self.rests.get(rest, ()) if abs(len(w) - len(word)) <= most}
            found = [(d, w) for w in near if (d := osa(word, w, most)) <= most]
            if found:
                return self.groups[min(found)[1]]
        return None


FIXED = Lexicon()


def damerau(a: str, b: str, most: int | None = None) -> int:
    """Unrestricted Damerau-Levenshtein distance; where ``most`` is given, ``most`` + 1 when larger."""
    if a == b:
        return 0
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    big = len(a) + len(b)
    last: dict[str, int] = {}
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        seen = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            cost = 1
            if x == y:
                cost, seen = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1] if most is None else min(d[-1][-1], most + 1)


_PARENTHESES, _OFFICE = re.compile(r"\([^)]*\)?"), re.compile(r"\bc/o\b.*$|\s-\s*head office.*$")
_SHORTS, _ANONYMOUS = re.compile(r"\bm/s\s*|\bh/care\b"), re.compile(r"\bs\s*/\s*a\b|\bs\.\s*a\.(?:\s*s\.)?")
_WORD = re.compile(r"([^\W_]+)(\.?)")


def _words(name: str | None) -> list[tuple[str, bool]]:
    """(word, whether a point follows) of a name in any script, without what stands in parentheses or names an office."""
    text = fold(name or "").replace("ß", "ss")
    text = _PARENTHESES.sub(" ", text) if "(" in text else text
    text = _OFFICE.sub(" ", text)
    text = _SHORTS.sub(lambda m: "healthcare " if m[0].startswith("h") else " ", text)
    text = _ANONYMOUS.sub(" ", text)
    return [(m[1], bool(m[2])) for m in _WORD.finditer(text.replace("/", " ").replace("'", ""))]


def parse(name: str | None, lexicon: Lexicon = FIXED) -> tuple[str, str, str]:
    """(core, extra words, trade groups) of a company name."""
    cores, extras, trades = [], set(), set()
    for word, short in _words(name):
        group = lexicon.group(word, short)
        if group is None:
            cores.append(word)
        elif group.startswith("x:"):
            extras.add(group[2:])
        elif group:
            trades.add(group[2:])
    return " ".join(cores), " ".join(sorted(extras)), " ".join(sorted(trades))


def added_words(names: DataFrame, column: str = "company_raw", least: float = 5.0, share: float = 2e-4) -> list[str]:
    """Words that companies add to their names, told by what they stand beside.

    A company's own word has, in nearly all its spellings, the same company; an added one has as many as there are companies
    that add it. So a word counts where the beginnings of the other words beside it (nothing is one too) are as varied as ``least``
    equally frequent ones would be, (sum n)^2 / sum n^2, which damaged or mistyped neighbours hardly change, and where it
    stands in at least ``share`` of all distinct names: at most a few / ``share`` at any size of the corpus. A word that only begins another
    one is its abbreviation.
    """

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch[column]:
                own = {w for w, short in _words(name) if len(w) >= 3 and FIXED.group(w, short) is None}
                for w in own:
                    rows += [(w, other[:3]) for other in own if other != w] or [(w, "")]
            yield frame(word=[w for w, _ in rows], other=[o for _, o in rows])

    distinct = names.select(column).where(F.col(column).isNotNull()).distinct()
    pairs = distinct.mapInPandas(beside, "word string, other string").groupBy("word", "other").agg(F.count("*").cast("double").alias("n"))
    found = pairs.groupBy("word").agg(F.sum("n").alias("n"), (F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("variety")).where(F.col("variety") >= least)
    ranked = [r.word for r in found.where(F.col("n") >= share * distinct.count()).orderBy(F.desc("n"), "word").select("word").collect()]
    kept: list[str] = []
    for w in ranked:  # a rarer writing of a word goes by the more frequent one
        if not any(osa(w, k, 2) <= (2 if len(w) >= 9 else 1 if len(w) >= 6 else 0) for k in kept):
            kept.append(w)
    words = sorted(kept)
    return [w for w, after in zip(words, [*words[1:], ""]) if not after.startswith(w)]


def parsed_names(names: DataFrame, column: str = "company_raw", added: Iterable[str] = ()) -> DataFrame:
    """(column, core, extra, trade) for each distinct name."""
    added = list(added)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(added)
        for batch in batches:
            got = [parse(v, lexicon) for v in batch[column]]
            yield frame(**{column: batch[column]}, core=[g[0] for g in got], extra=[g[1] for g in got], trade=[g[2] for g in got])

    return names.select(column).where(F.col(column).isNotNull()).distinct().mapInPandas(run, f"{column} string, core string, extra string, trade string")


def _near(cores: list[str], homes: np.ndarray, home: np.ndarray, firm: np.ndarray, table: np.ndarray, radius: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, distance) of a home core i and a core j: within ``TYPOS`` of each other, or one the other's beginning and within the radius.

    Pruned by the pivots' lower bound and by letter counts, then exact. Only firm cores look for others, so a pair without one
    never comes; a pair of two firm homes comes once.
    """
    signs = np.zeros((len(cores), 27), dtype=np.int8)
    for i, c in enumerate(cores):
        for x in c:
            signs[i, min(26, max(0, ord(x) - 97))] += 1
    size = signs.sum(1).astype(np.int16)
    for i in homes[firm[homes]]:
        keep = np.abs(size - size[i]) <= radius
        keep &= np.abs(table - table[i]).max(axis=1) <= radius
        keep &= ~(home & firm) | (np.arange(len(cores)) > i)
        at = np.nonzero(keep)[0]
        gap = signs[at] - signs[i]
        over, under = np.where(gap > 0, gap, 0).sum(1), np.where(gap < 0, -gap, 0).sum(1)
        for j in at[np.maximum(over, under) <= TYPOS]:
            if j != i and (d := damerau(cores[i], cores[j], TYPOS)) <= TYPOS:
                yield int(i), int(j), d
        short = (over == 0) | (under == 0)
        for j in at[short & (np.maximum(over, under) > TYPOS)]:
            if cores[i].startswith(cores[j]) or cores[j].startswith(cores[i]):
                yield int(i), int(j), abs(len(cores[i]) - len(cores[j]))


def radius_join(items: DataFrame, radius: int = RADIUS, cell: int = 64) -> DataFrame:
    """(place, core_a, core_b, d): pairs of different cores of one place, see ``_near``; each pair once or more, in both orders.

    ``items`` is (place, core, firm), distinct by place and core. Of the n cores of a place about one in ``cell``, or in
    n^(3/4) where that is more, is a pivot, chosen by hash, and the one with the least hash always.
    """
    spread = 4 * items.sparkSession.sparkContext.defaultParallelism
    hashed = F.xxhash64("core")
    sizes = items.groupBy("place").agg(F.count("*").alias("n"), F.min(hashed).alias("least"))
    drawn = (hashed == F.col("least")) | (F.pmod(hashed, F.greatest(F.lit(cell), F.pow("n", F.lit(0.75)).cast("int")).cast("long")) == 0)
    pivots = items.join(sizes, "place").where(drawn).groupBy("place").agg(F.sort_array(F.collect_set("core")).alias("pivots"))

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tables = [[damerau(c, p) for p in ps] for c, ps in zip(batch["core"], batch["pivots"])]
            yield frame(place=batch["place"], core=batch["core"], firm=batch["firm"], table=tables, home=[int(np.argmin(t)) for t in tables])

    # few bytes, much work: spread by row, as one place may hold a third of all cores
    placed = cut(items.join(pivots, "place").select("place", "core", "firm", "pivots").repartition(spread, "place", "core").mapInPandas(distances, "place string, core string, firm boolean, table array<int>, home int"))
    radii = placed.groupBy("place", "home").agg(F.max(F.element_at("table", F.col("home") + 1)).alias("reach"))
    reach = radii.groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("home", "reach"))).alias("reach"))
    cells = F.filter(F.sequence(F.lit(0), F.size("table") - 1), lambda i: F.element_at("table", i + 1) <= F.coalesce(F.try_element_at("reach", i), F.lit(-radius - 1)) + radius)
    copies = placed.join(reach, "place").select("place", "core", "firm", "table", "home", F.explode(cells).alias("cell")).repartition(spread, "place", "cell")

    def join_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        cores = pdf["core"].tolist()
        own = pdf["cell"].iloc[0]
        home = (pdf["home"] == own).to_numpy(dtype=bool)
        tables = [list(t) for t in pdf["table"]]
        table = np.array(tables, dtype=np.int32).reshape(len(cores), -1)
        found = list(_near(cores, np.nonzero(home)[0], home, pdf["firm"].to_numpy(dtype=bool), table, radius))
        found += [(j, i, d) for i, j, d in found]
        return frame(place=[pdf["place"].iloc[0]] * len(found), core_a=[cores[i] for i, _, _ in found], core_b=[cores[j] for _, j, _ in found], d=[d for _, _, d in found])

    return copies.groupBy("place", "cell").applyInPandas(join_cell, "place string, core_a string, core_b string, d int")


def same_core(a: str = "core_a", b: str = "core_b"):
    """Whether two cores may be one name: few edits for their length, or one cut short."""
    least = F.least(F.length(a), F.length(b))
    prefix = F.startswith(F.col(a), F.col(b)) | F.startswith(F.col(b), F.col(a))
    return ((F.col("d") <= 2) & (least >= 6)) | ((F.col("d") <= 1) & (least >= 4)) | (prefix & (least >= 5))


def _fits(a: str, b: str):
    """1 where two word sets share a word, 0 where one is empty, -1 where they differ."""
    x, y = F.col(a), F.col(b)
    return F.when((x == "") | (y == ""), F.lit(0)).when(F.arrays_overlap(F.split(x, " "), F.split(y, " ")), F.lit(1)).otherwise(F.lit(-1))


def whole_cities(rows: DataFrame) -> DataFrame:
    """(country, city, whole): rarer writings of a city with the more frequent one of the country they shorten or mistype; '' where they may shorten several."""
    cities = rows.where("city <> ''").groupBy("country", "city").agg(F.count("*").alias("n"))
    key = F.explode(F.array_distinct(F.array(F.concat(F.lit("<"), F.left("city", F.lit(3))), F.concat(F.lit(">"), F.right("city", F.lit(3))))))
    short, full = cities.withColumn("key", key), cities.select("country", F.col("city").alias("other"), F.col("n").alias("other_n")).withColumn("key", F.explode(F.array_distinct(F.array(F.concat(F.lit("<"), F.left("other", F.lit(3))), F.concat(F.lit(">"), F.right("other", F.lit(3)))))))
    met = short.join(full, ["country", "key"]).where((F.col("other") != F.col("city")) & ((F.col("other_n") > F.col("n")) | ((F.col("other_n") == F.col("n")) & (F.length("other") > F.length("city")))))
    cut_off = F.startswith(F.col("other"), F.col("city")) & (F.length("city") >= 3)
    typed = (F.col("other_n") > F.col("n")) & (F.length("city") >= 5) & (F.levenshtein("city", "other") <= F.when(F.length("city") >= 8, 2).otherwise(1))
    best = met.where(cut_off | typed).groupBy("country", "city").agg(F.max_by("other", F.struct(typed.cast("int"), "other_n", "other")).alias("whole"), F.count_distinct(F.when(cut_off & ~typed & (F.col("other_n") > 1), F.col("other"))).alias("n"), F.bool_or(typed).alias("typed"))
    return best.select("country", "city", F.when(F.col("typed") | (F.col("n") <= 1), F.col("whole")).otherwise("").alias("whole"))


def link_names(names: DataFrame) -> DataFrame:
    """(name_id, cluster): spellings of one company share a cluster. ``names`` is (name_id, company_raw, country, city, source_id)."""
    rows = names.select("name_id", "company_raw", "country", "city", "source_id").where(F.col("name_id").isNotNull()).dropDuplicates(["name_id"])
    home = rows.where(F.col("country").isNotNull() & (F.col("country") != "")).groupBy("source_id", "country").agg(F.count("*").alias("n")).groupBy("source_id").agg(F.max_by("country", F.struct("n", "country")).alias("home"))
    city = F.regexp_replace(F.translate(F.lower(F.coalesce("city", F.lit(""))), "áàâãäåéèêëíìîïóòôõöúùûüçñß", "aaaaaaeeeeiiiiooooouuuucns"), r"[^\p{L}]", "")
    rows = rows.join(home, "source_id", "left").select("name_id", "company_raw", F.upper(F.coalesce(F.nullif(F.trim("country"), F.lit("")), "home", F.lit("?"))).alias("country"), city.alias("city"))
    rows = rows.join(whole_cities(rows), ["country", "city"], "left").withColumn("city", F.coalesce("whole", "city")).drop("whole")
    parsed = parsed_names(rows, added=added_words(rows))
    rows = rows.join(parsed, "company_raw", "left")
    bare = F.coalesce("core", F.lit("")) == ""
    rows = rows.withColumn("core", F.when(bare, F.concat(F.lit("#"), F.lower(F.coalesce("company_raw", F.col("name_id").cast("string"))))).otherwise(F.col("core"))).na.fill("", ["extra", "trade"])
    rows = cut(rows.withColumn("node", F.xxhash64("country", "city", "core", "extra", "trade")))
    kinds = rows.select("country", "city", "core", "extra", "trade", "node").distinct()
    known, open_ = kinds.where("city <> ''"), kinds.where("city = ''")
    place, everywhere = F.concat_ws("|", "country", "city"), F.concat(F.col("country"), F.lit("|"))
    # cores without a city look for others in one more place, which holds all cores of their country
    in_places = known.select(place.alias("place"), "core", F.lit(True).alias("firm")).unionByName(open_.select(everywhere.alias("place"), "core", F.lit(True).alias("firm")))
    in_places = in_places.unionByName(known.join(open_.select("country").distinct(), "country", "left_semi").select(everywhere.alias("place"), "core", F.lit(False).alias("firm"))).groupBy("place", "core").agg(F.max("firm").alias("firm"))
    in_places = cut(in_places)
    near = radius_join(in_places).where(same_core()).distinct()
    near = cut(near.unionByName(in_places.select("place", F.col("core").alias("core_a"), F.col("core").alias("core_b"), F.lit(0).alias("d"))))
    side = lambda df, s: df.select(F.col("node").alias(f"node_{s}"), F.col("core").alias(f"core_{s}"), F.col("extra").alias(f"extra_{s}"), F.col("trade").alias(f"trade_{s}"), place.alias(f"place_{s}"))
    extra, trade = _fits("extra_a", "extra_b"), _fits("trade_a", "trade_b")
    edge = (F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    # 1. spellings of one city
    pairs = near.withColumnRenamed("place", "place_a").join(side(known, "a"), ["place_a", "core_a"]).join(side(known, "b").withColumnRenamed("place_b", "place_a"), ["place_a", "core_b"]).where("node_a < node_b")
    score = extra + trade - 0.75 * F.col("d")
    same_city = pairs.where((F.col("d") == 0) | (score >= -1.5) & ~((extra == -1) & (trade == -1))).select(*edge)
    # 2. a spelling without a city joins the best spelling of its country that has one, and with it one city's cluster
    in_country = near.where(F.col("place").endswith("|")).withColumnRenamed("place", "place_a")
    offers = in_country.join(side(open_, "a"), ["place_a", "core_a"]).join(side(known, "b").select("node_b", "core_b", "extra_b", "trade_b", F.concat(F.substring_index("place_b", "|", 1), F.lit("|")).alias("place_a")), ["place_a", "core_b"])
    offers = offers.where((extra >= 0) & (trade >= 0)).withColumn("score", 2 * extra + 2 * trade + F.when(F.col("extra_a") == F.col("extra_b"), 1.5).otherwise(0) + F.when(F.col("trade_a") == F.col("trade_b"), 0.5).otherwise(0) - F.col("d"))
    clear = cut(offers.groupBy("node_a").agg(F.max_by("node_b", F.struct("score", "node_b")).alias("node_b"), F.max("score").alias("score")).where("score >= -2").select(*edge))
    # 3. those that fit none link among themselves
    lone = open_.join(clear.select(F.col("a").alias("node")), "node", "left_anti")
    among = in_country.join(side(lone, "a"), ["place_a", "core_a"]).join(side(lone, "b").withColumnRenamed("place_b", "place_a"), ["place_a", "core_b"]).where("node_a < node_b").where((extra >= 0) & (trade >= 0)).select(*edge)
    found = components(same_city.unionByName(clear).unionByName(among))
    return rows.select("name_id", "node").join(found, "node", "left").select("name_id", F.coalesce("component", "node").alias("cluster"))


def name_pairs(linked: DataFrame) -> DataFrame:
    """(name_id_a, name_id_b): all pairs of one cluster."""
    a, b = linked.select(F.col("name_id").alias("name_id_a"), "cluster"), linked.select(F.col("name_id").alias("name_id_b"), "cluster")
    return a.join(b, "cluster").where("name_id_a < name_id_b").select("name_id_a", "name_id_b")
