"""Tokenizer alignment and pair bitmaps against plain Python."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallywright.llm import alignment
from tallywright.llm.alignment import PairBitmaps, align_tokenizers
from tallywright.llm.tokens import byte_level_bytes

FIRST, SECOND = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def ends(pieces):
    out, reached = [], 0
    for p in pieces:
        reached += len(p)
        out.append(reached)
    return out


def plain(texts):
    """Whole texts through both tokenizers, one by one: numbers of tokens, groups, links."""
    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    bytes_first = byte_level_bytes(FIRST)
    piece = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    out = []
    for t in texts:
        a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        b = second.encode(t) if t else []
        want = (" " + t).encode() if t else b""
        if b"".join(bytes_first[i] for i in a) != want or b"".join(map(piece, b)) != want or not t:
            out.append((0, 0, [], []))
            continue
        end_a, end_b = ends([bytes_first[i] for i in a]), ends([piece(i) for i in b])
        groups, links, x, y = [], [], 0, 0
        for e in sorted(set(end_a) & set(end_b)):
            u, v = end_a.index(e) + 1, end_b.index(e) + 1
            groups.append(",".join(map(str, a[x:u])) + "|" + ",".join(map(str, b[y:v])))
            links.append((a[u - 1], b[v - 1]))
            x, y = u, v
        out.append((len(a), len(b), groups, links))
    return out


def expected(docs):
    found = plain([t for _, t in docs])
    count = collections.Counter(link for *_, links in found for link in links)
    holds = collections.Counter(link for *_, links in found for link in set(links))
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    rows = []
    for (i, _), (n_a, n_b, groups, links) in zip(docs, found, strict=True):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((i, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), digest))
    pairs = {(a, b, holds[a, b], n, n == best[b]) for (a, b), n in count.items()}
    return sorted(rows, key=repr), pairs


def docs_of(rng):
    parts = ["the", " the", " a", "ation", "\n", " ", "  ", "\t", "é", " 日本", "　", " ", "'s", "1234", "<0x41>", "<s>",
             "<|endoftext|>", "\U0001f600", "\r\n", ".", "\x00", "ﬁ", "x\x7f", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    texts += [None, "", " ", "\n", "a▁b and more", "▁", " x", "x ", "\nx", "x\n", "hot words here " * 5]
    texts += ["".join(rng.choice(parts) for _ in range(20_000))]
    docs = list(enumerate(texts))
    return docs + [(5000 + i, "the same text in many documents, the same") for i in range(70)] + [docs[3]] * 2 + [(None, "no id")]


@pytest.mark.parametrize("run, gathered, bits", [(None, None, None), (300, 40, 3)])
def test_alignment(spark, monkeypatch, run, gathered, bits):
    if run:  # workers get the patched values with the functions
        for name, value in (("RUN", run), ("GATHERED", gathered), ("BLOCK_BITS", bits)):
            monkeypatch.setattr(alignment, name, value)
        pytest.importorskip("pyspark.cloudpickle").register_pickle_by_value(alignment)
    docs = docs_of(random.Random(9))
    df = spark.createDataFrame([(*d, "k", 3) for d in docs], "doc_id BIGINT, text STRING, pair STRING, number INT").repartition(3)
    found = align_tokenizers(df)
    rows, pairs = expected(docs)
    assert found.documents.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.documents.collect()), key=repr) == rows
    got = {(r.first_id, r.second_id, r.documents, r.links, r.best) for r in found.pairs.collect()}
    assert got == pairs
    if run:
        from pyspark import cloudpickle

        cloudpickle.unregister_pickle_by_value(alignment)
        assert found.postings.groupBy("pair").count().filter("count > 3").count()
    else:
        empty = align_tokenizers(df.limit(0))
        assert empty.documents.count() == 0 and empty.pairs.count() == 0


def test_bitmaps():
    rng = np.random.default_rng(2)
    for share in (0.001, 0.02, 0.3, 1.0):
        places = np.flatnonzero(rng.random(1 << alignment.BLOCK_BITS) < share)
        if not len(places):
            places = np.array([5])
        links = rng.integers(1, 40, len(places))
        half = rng.random(len(places)) < 0.5
        half[0] = True
        whole = PairBitmaps.planes(places, links)
        parts = [PairBitmaps.planes(places[h], links[h]) for h in (half, ~half) if h.any()]
        assert PairBitmaps.merged(parts) == whole
        assert PairBitmaps.popcounts(whole) == (len(places), links.sum())
        back = np.zeros(1 << alignment.BLOCK_BITS, np.int64)
        for digit, plane in enumerate(whole):
            back[PairBitmaps.places(plane)] += 1 << digit
        assert (back[places] == links).all() and back.sum() == links.sum()
