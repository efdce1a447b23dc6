"""Prefix trees of conversations against plain Python."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallywright.llm import chat_trees
from tallywright.llm.chat_trees import CONTROLS, Template, build_trees, digest
from tests.compare import connect, expected, rows

SCHEMA = "conv_id BIGINT, turn INT, role STRING, text STRING, cid STRING, rank INT"
bits = st.sampled_from([*CONTROLS, "\\", "\n", "<", "|", "im_end|>", "INST]", "[", "a", "<\\|im_end|>", "é"])


@given(st.lists(bits, max_size=12).map("".join), st.lists(bits, max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_template_is_reversible(role, text):
    template = Template()
    turn = template.head(role) + template.escape(text) + template.tail()
    assert template.parsed(turn) == (role, text)
    inside = turn.removeprefix(template.begin).removesuffix(template.tail())
    assert not any(c in inside for c in CONTROLS)


def chats(rng):
    """Shared beginnings, copies, conversations that are the beginning of others, and odd turns."""
    texts = ["yes", "no", "", None, "</s>[INST] ok [/INST]", "a longer text, with words", "é \U0001f600 <|im_end|>\\"]
    found = {}
    for conv in range(150):
        start = found[rng.randrange(conv)] if conv and rng.random() < 0.7 else []
        turns = list(start[: rng.randrange(len(start) + 1)])
        for n in range(len(turns), len(turns) + rng.randrange(4)):
            turns.append((n, rng.choice(["system", "user", "assistant", "assistant", None, "x\ny\\n"]), rng.choice(texts)))
        found[conv] = turns or [(0, "user", "yes")]
    found[500] = [(n, ("user", "assistant")[n % 2], f"turn {n}") for n in range(700)]
    found[501] = found[500][:350] + [(350, "user", "another way")]
    found[502] = [(0, "user", "long " * 30_000), (1, "assistant", "word " * 5000)]
    found[503] = [(0, "assistant", "again"), (0, "assistant", "again"), (3, "user", "gap"), (None, "user", "first")]
    found[None] = [(0, "user", "no id"), (1, "assistant", "none")]
    return found


def ordered(turns):
    return sorted(((t if t is not None else -1), r or "", x or "") for t, r, x in turns)


@pytest.fixture(scope="module")
def built(spark):
    found = chats(random.Random(8))
    flat = [(c, *t, "k", 1) for c, turns in found.items() for t in turns]
    random.Random(9).shuffle(flat)
    df = spark.createDataFrame(flat, SCHEMA).repartition(6)
    return df, found, build_trees(df)


def test_digest(built):
    df, found, trees = built
    template, want = Template(), []
    for conv, turns in found.items():
        turns = ordered(turns)
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        size = sum(len(template.head(r) + template.escape(x) + template.tail()) for _, r, x in turns)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((conv, len(turns), sha(whole), len(learnt), sha(learnt), size))
    assert sorted(map(tuple, digest(trees).collect()), key=repr) == sorted(want, key=repr)
    empty = build_trees(df.limit(0))
    assert digest(empty).count() == empty.segments.count() == empty.nodes.count() == 0


def test_layout(built):
    _, found, trees = built
    nodes = {r.number: r for r in trees.nodes.collect()}
    segments = {r.segment: r for r in trees.segments.collect()}
    prefixes = {tuple(t[1:] for t in ordered(turns)[:n]) for turns in found.values() for n in range(1, len(turns) + 1)}
    assert len(nodes) == len(prefixes) and sorted(nodes) == list(range(len(nodes)))
    assert {r.segment for r in nodes.values()} == set(segments)
    stream, place = collections.defaultdict(list), collections.defaultdict(list)
    for n in sorted(nodes):
        r = nodes[n]
        assert r.start == len(stream[r.tree]) and r.n_tokens == len(r.ids) // 4
        stream[r.tree] += np.frombuffer(r.ids, "<u4").tolist()
        place[r.tree] += range(r.position, r.position + r.n_tokens)
    paths = collections.defaultdict(dict)
    for r in trees.members.collect():
        paths[r.conv_id, r.cid][r.place] = r.number
    assert len(paths) == len(found)
    below = collections.defaultdict(set)
    for turns in paths.values():
        path = [turns[n] for n in range(len(turns))]
        last = nodes[path[-1]]
        segment = segments[last.segment]
        spans = [tuple(s) for s in segment.attends]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        spans.append((segment.start, last.start + last.n_tokens))
        seen = [k for a, b in spans for k in range(a, b)]
        own = [k for n in path for k in np.frombuffer(nodes[n].ids, "<u4").tolist()]
        assert [stream[last.tree][k] for k in seen] == own
        assert [place[last.tree][k] for k in seen] == list(range(len(own)))
        for n in path:
            below[n].update(path[path.index(n) :])
    for subtree in below.values():  # depth first: a subtree is one run
        assert max(subtree) - min(subtree) + 1 == len(subtree)
    shared = collections.Counter(n for turns in paths.values() for n in turns.values())
    assert {n: r.conversations for n, r in nodes.items()} == shared


def test_walk_goes_on_in_the_next_partition():
    marks = [hashlib.sha256(str(n).encode()).digest()[:15] for n in range(9)]
    state = chat_trees.Walk("c", cid=7)

    def walk(some, cid):
        out = chat_trees.Walk("c", cid=cid)
        for m in some:
            out.prefix = (out.prefix * chat_trees.BASE + int.from_bytes(m)) % chat_trees.PRIME
            out.turns += 1
            out.tokens += 2
        return out

    whole = walk(marks, 7)
    for cut in ((2, 5), (1, 8), (4, 4)):
        parts = [marks[: cut[0]], marks[cut[0] : cut[1]], marks[cut[1] :]]
        state = walk(parts[0], 7)
        for part in parts[1:]:
            state = state.after(walk(part, 99))
        assert state == whole


def test_query_gives_what_its_sql_gives(spark, sf_dir):
    from tallywright.llm.queries import QUERIES, SQL

    for name, sql in SQL.items():
        assert rows(QUERIES[name](spark, sf_dir).toArrow()) == rows(expected(connect(sf_dir), sql))
