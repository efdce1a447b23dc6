"""Interning and importance resampling against plain Python."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tallywright.llm import interning
from tallywright.llm.resampling import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def features(text, longest):
    found = WORD.findall((text or "").translate(LOWER))
    return found, [" ".join(found[i : i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]


def expected(docs, target, percent=10, longest=1, buckets=10_000, seed=2024, least=20):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = collections.Counter(), collections.Counter()
    for rows, into in ((docs, s), (target, t)):
        for _, text in rows:
            into.update(map(bucket, features(text, longest)[1]))
    all_s, all_t = s.total() + buckets, t.total() + buckets
    rows = []
    for i, text in docs:
        words, own = features(text, longest)
        gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in map(bucket, own)]
        weight = sum(gain) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append((i, len(own), weight, score, len(words) >= least))
    ranked = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = len(ranked) * percent // 100
    left = collections.Counter({})
    out = []
    for n, r in enumerate(ranked):
        out.append((*r[:4], n + 1 if n < drawn else None))
    out += [(*r[:4], None) for r in rows if not r[4]]
    return sorted(out, key=repr), left


def test_hashes_are_those_of_the_library():
    rng = random.Random(1)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in range(32) for _ in range(8)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    length = np.array([len(t) for t in texts])
    start = np.cumsum(length) - length
    got = interning.xxh64(interning.lanes(data, start, length), length)
    assert got.tolist() == [xxhash.xxh64_intdigest(t) for t in texts]


def test_equal_hashes_do_not_make_equal_grams(monkeypatch):
    monkeypatch.setattr(interning, "xxh64", lambda parts, length: np.zeros(len(length), np.uint64))
    long_ = ["q" * 40, "q" * 39 + "r", "q" * 41]
    monkeypatch.setattr(interning.xxhash, "xxh64_intdigest", lambda _: 0)
    words = ["a", "b", "ab", "a", "abcdefghij", "abcdefghik", "b", *long_, long_[0]]
    found = interning.grams(pa.array([" ".join(words)]), 1)
    table = interning.intern(found)
    slots = collections.defaultdict(set)
    for n in range(len(words)):
        assert found.bytes_of(n).decode() == words[n]
        slots[words[n]].add(int(table.slot[n]))
    assert all(len(s) == 1 for s in slots.values()) and len({min(s) for s in slots.values()}) == len(slots)
    assert sorted(table.count[table.used()].tolist()) == sorted(collections.Counter(words).values())


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (3, 97)])
def test_resampling(spark, longest, buckets):
    rng = random.Random(3)
    word = lambda: rng.choice(["Alpha", "beta", "b2", "é", "日本", "straße", "x" * 33, "y" * 70]) + str(rng.randrange(9))
    join = lambda n: "".join(word() + rng.choice([" ", "\n", ", ", "_", " ", "\x7f"]) for _ in range(n))
    docs = [(i, join(rng.randrange(60))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, " ,.-"), (1003, "one"), (1004, join(30_000)), (None, join(40))]
    docs += [docs[7]] * 3 + [(7, join(50)), (2000, "hot " * 25), *((3000 + i, "copy of a text " * 9) for i in range(90))]
    target = [(0, join(400)), (1, None), (2, "copy of")]
    df = spark.createDataFrame([(*r, "k", 1) for r in docs], "doc_id BIGINT, text STRING, id STRING, rank INT").repartition(5)
    aim = spark.createDataFrame(target, "item_id INT, text STRING")
    for rows in (aim, aim.limit(0)):
        got = sorted(map(tuple, resample(df, rows, longest=longest, buckets=buckets).collect()), key=repr)
        want, _ = expected(docs, target if rows is aim else [], longest=longest, buckets=buckets)
        assert got == want
    assert sum(r[4] is not None for r in got) == sum(len(features(t, 1)[0]) >= 20 for _, t in docs) // 10
    assert resample(df.limit(0), aim).count() == 0


def test_sample_resembles_the_target(spark):
    rng = random.Random(4)
    kinds = (["plain", "common", "usual", "daily"], ["quark", "boson", "lepton", "gluon"])
    docs = [(i, " ".join(rng.choice(kinds[i % 10 == 0]) for _ in range(40))) for i in range(2000)]
    aim = [(0, " ".join(rng.choice(kinds[1]) for _ in range(500)))]
    got = resample(spark.createDataFrame(docs, "doc_id INT, text STRING"), spark.createDataFrame(aim, "i INT, text STRING"))
    drawn = {r.doc_id for r in got.collect() if r.rank}
    assert len(drawn) == 200 and sum(i % 10 == 0 for i in drawn) > 150
