import random

import pytest

from regolith.llm.packing import TOKENIZER, best_fit, counter, fill_rates, pack, token_counts


def test_best_fit_equals_a_plain_search():
    rng = random.Random(2)
    for most in (1, 3, 8):
        sizes = [rng.randrange(1, 21) for _ in range(400)]
        got, still = best_fit(sizes, 20, most)
        load: dict[int, int] = {}
        for b, s in zip(got, sizes):
            load[b] = load.get(b, 0) + s
        assert max(load.values()) <= 20 and len(still) <= most and all(20 - load[b] == f for b, f in still.items())
        open_, n = {}, 0
        for b, s in zip(got, sizes):  # the bin taken is the fullest that fits
            fits = [f for f in open_.values() if f >= s]
            if fits:
                assert b in open_ and open_[b] == min(fits)
            else:
                if len(open_) >= most:
                    least = min(open_.values())
                    open_.pop(next(k for k in reversed(open_) if open_[k] == least))
                assert b == n
                n += 1
                open_[b] = 20
            f = open_.pop(b) - s
            if f:
                open_[b] = f


SCHEMA = "doc_id long, text string, n_tokens int, bin int"


def test_pack(spark):
    texts = ["a b c", "", None, "word " * 3000, "x", "x", "a b c", " "]
    docs = spark.createDataFrame([(i, t, -1, -1) for i, t in enumerate(texts)] + [(None, "a", 0, 0)], SCHEMA)
    runs = spark.createDataFrame([(1, "s", 8), (2, "m", 1000)], "run_id int, run_name string, capacity_tokens int")
    sizes = {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}
    assert 1 not in sizes and 2 not in sizes and None not in sizes
    got = pack(docs, runs).collect()
    for run, cap in ((1, 8), (2, 1000)):
        own = [r for r in got if r.run_id == run]
        used: dict[str, int] = {}
        for r in own:
            used[r.container] = used.get(r.container, 0) + r.span_end - r.span_start
        assert max(used.values()) <= cap
        for doc, n in sizes.items():
            spans = sorted((r.span_start, r.span_end) for r in own if r.doc_id == doc)
            assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            assert len(spans) == (1 if n <= cap else -(-n // cap))
    assert fill_rates(pack(docs, runs), runs).count() == 2
    assert pack(docs.limit(0), runs).count() == 0 and pack(docs, runs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack(docs, spark.createDataFrame([(1, 0)], "run_id int, capacity_tokens int"))


def test_tokenizers_agree():
    a, b, c = counter(TOKENIZER), counter(TOKENIZER.replace(".tiktoken", ".json")), counter(TOKENIZER.replace("byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
    for text in ("", " ", "Crème 5 mg <|endoftext|>\n\nx", "é" * 500, "a b  c"):
        assert a(text) == b(text) and (c(text) > 0) == bool(text)
