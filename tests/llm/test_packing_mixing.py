from collections import Counter
from itertools import product
from pathlib import Path

import numpy as np
import pytest

from voxtree.llm.mixing import mixture, mixture_shares
from voxtree.llm.packing import Packer, container_fill, pack_documents
from voxtree.llm.tokens import TOKENIZER, encoder, hilbert_key, token_sizes

pytestmark = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no tokenizer files here")
S = "doc_id bigint, text string, source string, place bigint, n_tokens bigint, target_weight double"
C = "capacity_name string, capacity_tokens int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, 3.0) for i, t, s in rows], S)


def test_curve():
    """Each step along the curve goes to a neighbour, and every cell is met once."""
    points = np.array(list(product(range(8), repeat=3)))
    order = points[np.argsort(hilbert_key(points, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all() and len(set(hilbert_key(points, 3).tolist())) == 512


def test_sizes(spark):
    encode = encoder(TOKENIZER).encode_ordinary
    texts = ["", None, "a", "int main() { return 0; }", "<|endoftext|>", "計測値\r\n", "x" * 20000]
    got = token_sizes(documents(spark, list(zip(range(7), texts, "aaaaaaa", strict=True))), TOKENIZER, True, "doc_id").collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(encode(t or "")) for i, t in enumerate(texts)}
    assert {r.doc_id for r in got if r.place is None} == {0, 1}


def test_packer():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 3000, 5000)
    p = Packer(1000, 0, 32, 4)
    rows = [r for k in range(0, 5000, 512) for r in p.pack((i, int(sizes[i]), i) for i in range(k, min(k + 512, 5000)))] + list(p.flush())
    spread = Counter()
    for container, *_, position in rows:
        spread[container] = max(spread[container], position)
    for container, *_, position in rows:
        assert spread[container] - position < 600
    rows = [r[:4] for r in rows]
    load, pieces = Counter(), {}
    for container, doc, at, n in rows:
        load[container] += n
        pieces.setdefault(doc, []).append((at, n))
    assert max(load.values()) <= 1000 and sizes.sum() / (len(load) * 1000) > 0.97
    for doc, own in pieces.items():
        own.sort()
        assert [a for a, _ in own] == [1000 * i for i in range(len(own))] and sum(n for _, n in own) == sizes[doc]


def test_pack(spark):
    rows = [(i, "word " * (1 + i * 7 % 90), "s") for i in range(300)] + [(900, None, "s"), (901, "", "s"), (902, "word " * 950, "s"), (903, "same " * 50, "s"), (903, "same " * 50, "s"), (None, "no id", "s")]
    caps = spark.createDataFrame([("a", 100), ("b", 1000), ("b", 2000), ("none", None), ("zero", 0), (None, 5)], C)
    docs = documents(spark, rows)
    packed = pack_documents(docs, caps, window=8).collect()
    total = docs_total = sum(r.n_tokens for r in token_sizes(docs, TOKENIZER, False, "doc_id").collect())
    for name, size in (("a", 100), ("b", 1000)):
        own = [r for r in packed if r.capacity_name == name]
        load = Counter()
        for r in own:
            if r.container_id is not None:
                load[r.container_id] += r.n_tokens
        assert sum(load.values()) == total and max(load.values()) <= size
        counts = Counter(r.doc_id for r in own)
        assert set(counts) == {i for i, *_ in rows} and counts[903] == 2 and {r.doc_id for r in own if r.container_id is None} == {900, 901}
        whole = {i for i, t, _ in rows if t and len(t.split()) <= size - 2 and i != 903}
        assert all(counts[i] == 1 for i in whole)
    fill = {r.capacity_name: r for r in container_fill(pack_documents(docs, caps), caps).collect()}
    assert fill["a"].n_tokens == docs_total and 0.8 < fill["a"].fill <= 1
    assert pack_documents(documents(spark, []), caps).count() == 0 and pack_documents(docs, caps.limit(0)).count() == 0


def test_mixture(spark):
    sources = [("a", 400), ("b", 250), ("c", 60), ("extra", 50), (None, 20)]
    rows = [(k * 10000 + i, "word " * (5 + i % 40), s) for k, (s, n) in enumerate(sources) for i in range(n)] + [(99999, None, "a"), (99998, "", "b")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.2, 3), ("missing", 0.4, 2), ("none", None, 2), ("off", 0.0, 1), (None, 0.5, 1)], "source_name string, target_weight double, max_repeats int")
    docs = documents(spark, rows)
    shares = {r.source: r for r in mixture_shares(docs, targets).collect()}
    assert set(shares) == {"a", "b", "c", "missing", "none", "off"}
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert shares[s].reached_share == pytest.approx(w, abs=0.01) and abs(shares[s].reached_tokens - shares[s].budget_tokens) < 60
        assert shares[s].most_repeats <= shares[s].max_repeats
    assert shares["c"].most_repeats == 3 and shares["missing"].reached_share == 0
    big = {r.doc_id: r.repeats for r in mixture(docs, targets).collect()}
    small = {r.doc_id: r.repeats for r in mixture(docs, targets, 2000).collect()}
    assert set(small) < set(big) and all(n <= big[i] for i, n in small.items()) and not {99998, 99999} & set(big)
    over = {r.source: r for r in mixture_shares(docs, targets, 10.0**9).collect()}
    assert all(over[s].reached_tokens == over[s].available_tokens * over[s].max_repeats for s in "abc")
    assert mixture(documents(spark, []), targets).count() == 0 and mixture(docs, targets.limit(0)).count() == 0
    assert mixture_shares(documents(spark, []), targets).where("reached_tokens > 0").count() == 0


def test_repeated_ids(spark):
    rows = [(1, "word " * 10, "a")] * 30 + [(2, "word " * 10, "a")]
    targets = spark.createDataFrame([("a", 1.0, 2)], "source_name string, target_weight double, max_repeats int")
    got = Counter(r.doc_id for r in mixture(documents(spark, rows), targets).collect())
    assert got == {1: 30, 2: 1}
