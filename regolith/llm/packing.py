"""Filling fixed-capacity containers: bounded-space online best-fit.

Texts are measured in tokens of a public tokenizer whose file is a parameter. A text longer than the capacity is cut into
full spans, each a container of its own, and a rest; nothing else is cut. Items are hashed into shards of about
``BINS`` containers, so a shard is of bounded size and shards run in parallel. In a shard at most ``OPEN`` bins are open.
Their free spaces are bits of one integer: the best fit for an item of s tokens is the lowest set bit at or above s, the
bin to close first, when all are open and none fits, is the lowest set bit of all, the fullest. What is open at the end of
a shard is packed once more, as items, together with the open bins of neighbouring shards, by the same method and bound.

Defined results: null, empty and tokenless texts, and those without an id, have no container; a text of exactly the capacity fills one; equal texts
are packed each; a capacity below one token is an error; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.functions.frames import frame, frame_of
from regolith.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level vocabularies of this kind cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OPEN, BINS, NEIGHBOURS, ITEMS = 128, 2000, 32, 200_000


def best_fit(sizes: Iterable[int], capacity: int, most_open: int = OPEN) -> tuple[list[int], dict[int, int]]:
    """(bin of each item, free space of the bins still open at the end)."""
    bits = 0
    by_free: dict[int, list[int]] = {}
    bins, opened, count = [], 0, 0
    for s in sizes:
        fitting = bits >> s
        if fitting:
            free = s + (fitting & -fitting).bit_length() - 1
            own = by_free[free]
            b = own.pop()
            if not own:
                bits &= ~(1 << free)
            count -= 1
        else:
            if count >= most_open:  # close the fullest
                least = (bits & -bits).bit_length() - 1
                own = by_free[least]
                own.pop()
                if not own:
                    bits &= ~(1 << least)
                count -= 1
            free, b = capacity, opened
            opened += 1
        bins.append(b)
        if rest := free - s:
            by_free.setdefault(rest, []).append(b)
            bits |= 1 << rest
            count += 1
    return bins, {b: free for free, own in by_free.items() for b in own}


def counter(tokenizer: str, pattern: str = PATTERN) -> Callable[[str], int]:
    """The number of tokens of a text, special tokens' strings being ordinary text; the file's kind is told by its ending."""
    if tokenizer.endswith(".tiktoken"):
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(own.encode_ordinary(text))
    if tokenizer.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        return lambda text: len(piece.encode(text))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of documents with at least one token."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = counter(tokenizer)
        for batch in batches:
            yield frame(doc_id=batch["doc_id"], n_tokens=[size(t) for t in batch["text"]])

    return documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text").mapInPandas(count, "doc_id long, n_tokens int").where("n_tokens > 0")


def pack(documents: DataFrame, runs: DataFrame, tokenizer: str = TOKENIZER, most_open: int = OPEN) -> DataFrame:
    """(run_id, container, doc_id, span_start, span_end): token spans of each document by run. ``runs`` is a short list of capacities."""
    plans = [(r.run_id, r.capacity_tokens) for r in runs.select("run_id", "capacity_tokens").distinct().orderBy("run_id").collect()]
    if any(c is None or c < 1 for _, c in plans):
        raise ValueError("a container must hold at least one token")
    sized = cut(token_counts(documents, tokenizer))
    total = sized.agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).first()
    tokens, n = total.tokens or 0, total.n or 0
    shards = {run: max(1, tokens // (c * BINS), n // ITEMS) for run, c in plans}
    each = sized.select("doc_id", "n_tokens", F.explode(F.array(*[F.struct(F.lit(run).alias("run_id"), F.lit(c).alias("cap"), F.lit(int(shards[run])).alias("shards")) for run, c in plans]) if plans else F.array().cast("array<struct<run_id:int,cap:int,shards:int>>")).alias("r")).select("doc_id", "n_tokens", "r.*")
    # full spans of long texts are containers of their own
    whole = each.where("n_tokens > cap").select("run_id", "doc_id", "cap", F.explode(F.sequence(F.lit(0), (F.col("n_tokens") / F.col("cap")).cast("int") - 1)).alias("k"))
    whole = whole.select("run_id", F.concat_ws("-", F.lit("f"), "run_id", "doc_id", "k").alias("container"), "doc_id", (F.col("k") * F.col("cap")).alias("span_start"), ((F.col("k") + 1) * F.col("cap")).alias("span_end"))
    start = F.when(F.col("n_tokens") > F.col("cap"), F.col("n_tokens") - F.col("n_tokens") % F.col("cap")).otherwise(0)
    rests = each.select("run_id", "cap", "doc_id", start.alias("span_start"), F.col("n_tokens").alias("span_end"), F.pmod(F.xxhash64("doc_id"), F.col("shards")).cast("int").alias("shard")).where("span_end > span_start")

    def pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "span_start", "span_end"], kind="stable")
        cap = int(pdf["cap"].iloc[0])
        starts, ends = pdf["span_start"].astype(int).tolist(), pdf["span_end"].astype(int).tolist()
        bins, still = best_fit((b - a for a, b in zip(starts, ends)), cap, most_open)
        return frame(run_id=pdf["run_id"], shard=pdf["shard"], bin=bins, open_free=[still.get(b, -1) for b in bins], cap=pdf["cap"], doc_id=pdf["doc_id"], span_start=starts, span_end=ends)

    packed = cut(rests.groupBy("run_id", "shard").applyInPandas(pack_shard, "run_id int, shard int, bin int, open_free int, cap int, doc_id long, span_start int, span_end int"))

    def pack_open(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["used", "shard", "bin"], ascending=[False, True, True], kind="stable")
        bins, _ = best_fit(pdf["used"].astype(int).tolist(), int(pdf["cap"].iloc[0]), most_open)
        return frame(run_id=pdf["run_id"], shard=pdf["shard"], bin=pdf["bin"], joint=[f"o-{pdf['run_id'].iloc[0]}-{pdf['hood'].iloc[0]}-{b}" for b in bins])

    open_bins = packed.where("open_free >= 0").groupBy("run_id", "shard", "bin", "cap").agg((F.col("cap") - F.max("open_free")).alias("used")).withColumn("hood", (F.col("shard") / NEIGHBOURS).cast("int"))
    joint = open_bins.groupBy("run_id", "hood").applyInPandas(pack_open, "run_id int, shard int, bin int, joint string")
    own = packed.join(joint, ["run_id", "shard", "bin"], "left").select("run_id", F.coalesce("joint", F.concat_ws("-", F.lit("b"), "run_id", "shard", "bin")).alias("container"), "doc_id", "span_start", "span_end")
    return own.unionByName(whole.select(own.columns))


def fill_rates(packed: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, capacity_tokens, containers, tokens, fill, fullest): how well each run's containers are filled."""
    bins = packed.groupBy("run_id", "container").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("used"))
    by_run = bins.groupBy("run_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    caps = runs.select("run_id", "capacity_tokens").distinct()
    return by_run.join(F.broadcast(caps), "run_id").select("run_id", "capacity_tokens", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"), "fullest")
