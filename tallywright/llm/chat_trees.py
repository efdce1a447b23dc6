"""Conversations formatted as prefix trees: shared turns are emitted once, depth first."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.positions import with_positions
from tallywright.llm.storage import stored, written
from tallywright.llm.text import runs, text_bytes
from tallywright.llm.tokens import Memory, decoder, encode

#: Strings that formats use to steer a model; fixed values.
CONTROLS = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
#: Bytes of text worked on at once.
RUN = 2 << 20


@dataclass(frozen=True)
class Template:
    """``begin role \\n text end \\n``. A control string inside a text or role gets a backslash after
    its first character, one more than it has there already; that is taken off again on reading, so
    every text comes back as it was, and no control string remains inside. In a role, backslashes
    and line feeds are written as ``\\\\`` and ``\\n`` before that."""

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"
    controls: tuple[str, ...] = CONTROLS
    learnt: tuple[str, ...] = ("assistant",)

    @cached_property
    def _inside(self) -> re.Pattern:
        known = sorted({self.begin, self.end, *self.controls}, key=len, reverse=True)
        return re.compile("|".join(rf"(?<={re.escape(c[0])})\\*(?={re.escape(c[1:])})" for c in known))

    @cached_property
    def _escaped(self) -> re.Pattern:
        return re.compile(self._inside.pattern.replace(r"\\*", r"\\+"))

    @cached_property
    def _rests(self) -> list[str]:
        return sorted({c[1:] for c in (self.begin, self.end, *self.controls)})

    def escape(self, text: str) -> str:
        if not any(rest in text for rest in self._rests):
            return text
        return self._inside.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        if not any(rest in text for rest in self._rests):
            return text
        return self._escaped.sub(lambda m: m[0][1:], text)

    def head(self, role: str) -> str:
        return self.begin + self.escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"

    def tail(self) -> str:
        return self.end + "\n"

    def parsed(self, turn: str) -> tuple[str, str]:
        """Role and text of a formatted turn."""
        inner = turn.removeprefix(self.begin).removesuffix(self.tail())
        if turn != self.begin + inner + self.tail():
            raise ValueError("not a formatted turn")
        role, text = inner.split("\n", 1)
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role))
        return role, self.unescape(text)


#: Prefixes of turns are polynomials of the turns' digests over the integers modulo this prime, so
#: that the parts of a conversation in several partitions combine.
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix of turns").digest()[:15])


@dataclass
class Walk:
    """Where a conversation stands after some turns."""

    conv: object = None
    turns: int = 0
    prefix: int = 0
    tokens: int = 0
    cid: int | None = None
    root: int = 0

    def after(self, later: Walk) -> Walk:
        """The state after the turns of ``later``, counted from nothing, have followed."""
        prefix = (self.prefix * pow(BASE, later.turns, PRIME) + later.prefix) % PRIME
        return Walk(self.conv, self.turns + later.turns, prefix, self.tokens + later.tokens, self.cid, self.root)


def _walked(batches: Iterator[pa.RecordBatch], state: Walk | None) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """The rows' (turns before, prefix, prefix before, tokens before, cid, root), and after each
    batch the state; rows come in the order of conversations and turns."""
    for batch in batches:
        rows = []
        columns = (batch.column(n).to_pylist() for n in ("conv", "mark", "n_tokens", "uid"))
        for conv, mark, size, uid in zip(*columns, strict=True):
            if state is None or conv != state.conv:
                state = Walk(conv, cid=uid)
            before = state.prefix
            state.prefix = (before * BASE + int.from_bytes(mark)) % PRIME
            if not state.turns:
                state.root = state.prefix
            rows.append((state.turns, state.prefix, before, state.tokens, state.cid, state.root))
            state.turns += 1
            state.tokens += size
        yield batch, rows, state


def _encoded(conversations: DataFrame, template: Template, tokenizer: str, names: tuple[str, str, str, str]) -> DataFrame:
    """Each turn formatted and tokenized: ids, and which of them are learnt."""
    conv, turn, role, text = names

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in runs(batches, size=RUN):
            roles = [r or "" for r in batch.column("role").to_pylist()]
            texts = [template.escape(t or "") for t in batch.column("text").to_pylist()]
            parts = [p for r, t in zip(roles, texts, strict=True) for p in (template.head(r), t, template.tail())]
            flat, at = encode(pa.array(parts, pa.large_string()), tokenizer, memory, plain=True)
            begin, inner, outer, end = at[:-1:3], at[1::3], at[2::3], at[3::3]
            raw = flat.astype("<u4").tobytes()
            marks = [
                hashlib.blake2b(f"{h}{t}".encode(), digest_size=15).digest()
                for h, t in zip(parts[::3], texts, strict=True)
            ]
            learnt = np.isin(np.array(roles, object), template.learnt)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv"), batch.column("turn"), batch.column("role"), batch.column("uid"),
                    pa.array(marks, pa.binary()),
                    pa.array([raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary()),
                    pa.array(end - begin),
                    pa.array(np.where(learnt, inner - begin, 0)), pa.array(np.where(learnt, outer - begin, 0)),
                ],
                ["conv", "turn", "role", "uid", "mark", "ids", "n_tokens", "loss_begin", "loss_end"],
            )

    slim = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("uid"),
    )
    kind = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    return slim.mapInArrow(
        encoded,
        f"conv {kind['conv']}, turn {kind['turn']}, role string, uid long, mark binary, ids binary, "
        "n_tokens long, loss_begin long, loss_end long",
    )


def _prefixes(turns: DataFrame) -> DataFrame:
    """Add to each turn: place (from 0), key and parent (its prefix with and without it), depth
    (tokens before it in its conversation), cid (a number for the conversation), root (the key of
    its first turn).

    The turns are range-sorted by conversation and turn, so that a long conversation lies in many
    partitions. Each partition walks its rows; of its last conversation one state goes to the driver,
    from which the next partition goes on.
    """
    keys = ["conv", "turn", "role", "mark", "uid"]
    ranged = stored(turns.select(*keys, "n_tokens").repartitionByRange(*keys).sortWithinPartitions(*keys))
    ranged = ranged.withColumn("part", F.spark_partition_id())
    kind = ranged.schema["conv"].dataType.simpleString()

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, state = None, None
        for batch, _, state in _walked(batches, None):
            if first is None and batch.num_rows:
                first = (batch.column("part")[0].as_py(), batch.column("conv")[0].as_py())
        if state is not None:
            one = state.conv == first[1]
            values = [first[0], state.conv, one, state.turns, state.prefix.to_bytes(16), state.tokens, state.cid, state.root.to_bytes(16)]
            names = ["part", "conv", "one", "turns", "prefix", "tokens", "cid", "root"]
            types = [pa.int32(), batch.column("conv").type, pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    found = ranged.mapInArrow(
        last, f"part int, conv {kind}, one boolean, turns long, prefix binary, tokens long, cid long, root binary"
    )
    begins: dict[int, Walk | None] = {}
    state: Walk | None = None
    for r in sorted(found.collect(), key=lambda r: r["part"]):
        begins[r["part"]] = state
        own = Walk(r["conv"], r["turns"], int.from_bytes(r["prefix"]), r["tokens"], r["cid"], int.from_bytes(r["root"]))
        state = state.after(own) if state is not None and r["one"] and r["conv"] == state.conv else own

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def begun() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        state = begins[first.column("part")[0].as_py()]
        state = Walk(**vars(state)) if state is not None else None
        for batch, rows, _ in _walked(begun(), state):
            if not rows:
                continue
            place, key, parent, depth, cid, root = zip(*rows, strict=True)
            binary = lambda values: pa.array([int(v).to_bytes(16) for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("uid"), batch.column("n_tokens"), pa.array(place, pa.int64()),
                 binary(key), binary(parent), pa.array(depth, pa.int64()), pa.array(cid, pa.int64()), binary(root)],
                ["conv", "uid", "n_tokens", "place", "key", "parent", "depth", "cid", "root"],
            )

    return ranged.mapInArrow(
        number,
        f"conv {kind}, uid long, n_tokens long, place long, key binary, parent binary, depth long, cid long, root binary",
    )


@dataclass
class Trees:
    """``nodes``: a turn of a tree each, in the order in which a tree's tokens are emitted; with its
    ids, where they start in the tree, the position id of the first of them, and which are learnt.
    ``segments``: runs of nodes without a branch, with the intervals of the tree's tokens that their
    tokens attend to besides the earlier ones of the segment itself. ``members``: the node of each
    turn of each conversation."""

    nodes: DataFrame
    segments: DataFrame
    members: DataFrame


def _joined(intervals: Column) -> Column:
    """Neighbouring intervals as one: where one begins that does not go on, and where one ends."""
    begins = F.filter(
        intervals, lambda x, i: (i == 0) | (F.coalesce(F.get(intervals, i - 1)["end"], F.lit(-1)) != x["begin"])
    )
    ends = F.filter(intervals, lambda x, i: F.coalesce(F.get(intervals, i + 1)["begin"], F.lit(-1)) != x["end"])
    return F.zip_with(begins, ends, lambda b, e: F.struct(b["begin"].alias("begin"), e["end"].alias("end")))


def build_trees(
    conversations: DataFrame,
    template: Template = Template(),
    tokenizer: str | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> Trees:
    """Merge conversations that share their first turns into trees and lay their tokens out.

    A node is a turn after given turns; nodes with the same prefix are one, and its tokens are
    emitted once. Prefixes are compared by 127-bit polynomials of the turns' digests. Trees, and
    the branches of each, follow one another depth first. A token's position id counts the tokens
    before it in its conversation. It attends to its ancestors only: the intervals of its segment
    and what stands before it in the segment.

    Depth-first order needs no recursion: it is the order of the conversations by the prefixes at
    which their paths branch off, each node standing with the first conversation that has it. A path
    with b branches needs other conversations that share its turns up to each, b * b / 2 turns in
    all, so the list of a path's branches is bounded by the root of twice the number of turns. All
    else are joins, sums and range sorts over rows of numbers; ids are moved once.

    The turns of a conversation are ordered by ``turn_col``, null first, equal ones by role and
    digest; each row is a turn, repeated rows too. Null roles and texts are empty; rows without a
    conversation's id are one conversation. Texts of the roles in ``template.learnt`` are under the
    loss mask. An empty table gives no rows. Other columns are not read. A turn's text is worked on
    as a whole.
    """
    path_of = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    turns = written(_encoded(conversations, template, path_of, (conv_col, turn_col, role_col, text_col)), "turns")
    rows = written(_prefixes(turns), "prefixes")
    later = rows.filter("place > 0")
    forks = later.groupBy("parent").agg(F.min("key").alias("lowest"), F.max("key").alias("highest"))
    # Stored, so that the join has a shuffle of its own, which Spark can split at a hot turn.
    forks = written(forks.filter("lowest != highest").select(F.col("parent").alias("fork")), "forks")
    branched = later.join(forks, F.col("parent") == F.col("fork"), "left")
    marked = written(
        rows.filter("place = 0")
        .withColumn("flag", F.lit(1).cast("long"))
        .unionByName(branched.withColumn("flag", F.col("fork").isNotNull().cast("long")).drop("fork"))
        .drop("parent", "root"),
        "branches",
    )
    branches = F.sort_array(F.collect_list(F.when(F.col("flag") == 1, F.struct("place", "key"))))
    paths = marked.groupBy("cid").agg(
        F.count("*").alias("turns"), F.array_join(F.transform(branches, lambda b: F.hex(b["key"])), "").alias("path")
    )
    ranks = with_positions(paths, ["path", "turns", "cid"], []).select("cid", F.col("position").alias("rank"))
    ranked = marked.join(ranks, "cid")
    nodes = ranked.groupBy("key").agg(
        *(F.min(n).alias(n) for n in ("rank", "place", "depth", "n_tokens", "uid", "flag")),
        F.count("*").alias("conversations"),
    )
    nodes = nodes.withColumn("first", (F.col("place") == 0).cast("long"))
    laid = with_positions(nodes, ["rank", "place"], ["n_tokens", "flag", "first"]).select(
        "key", "rank", "place", "uid", "n_tokens", "conversations",
        F.col("depth").alias("position"),
        F.col("position").alias("number"),
        F.col("before_n_tokens").alias("at"),
        (F.col("before_flag") + F.col("flag") - 1).alias("segment"),
        (F.col("before_first") + F.col("first") - 1).alias("tree"),
    )
    laid = written(laid, "nodes")
    begins = laid.filter("place = 0").select("tree", F.col("at").alias("begin"))
    placed = laid.join(begins, "tree").join(
        turns.select("uid", "role", "ids", "loss_begin", "loss_end"), "uid"
    )
    places = laid.select(
        "key", "number", "at", "segment", "tree", F.col("rank").alias("owner")
    )
    chosen = ranked.filter("flag = 1").select("rank", "place", "depth", "key").join(places, "key")
    along = chosen.groupBy("rank").agg(
        F.sort_array(F.collect_list(F.struct("place", "depth", "at", "segment", "tree", "owner"))).alias("path")
    )
    begin = F.get("path", F.lit(0))["at"]
    before = F.transform(
        F.slice("path", 1, F.col("step")),
        lambda e, i: F.struct(
            (e["at"] - begin).alias("begin"),
            (e["at"] - begin + F.get("path", i + 1)["depth"] - e["depth"]).alias("end"),
        ),
    )
    segments = (
        along.select("rank", "path", F.posexplode("path").alias("step", "own"))
        .filter("own.owner = rank")
        .select("own.tree", "own.segment", (F.col("own.at") - begin).alias("start"),
                F.col("own.depth").alias("position"), before.alias("before"))
        .select("tree", "segment", "start", "position", _joined(F.col("before")).alias("attends"))
    )
    return Trees(
        placed.select(
            "tree", "segment", "number", "role", (F.col("at") - F.col("begin")).alias("start"), "position",
            "n_tokens", "loss_begin", "loss_end", "conversations", "ids",
        ),
        segments,
        marked.select(F.col("conv").alias(conv_col), "cid", "place", "key").join(places.select("key", "number"), "key").drop("key"),
    )


def digest(
    trees: Trees, template: Template = Template(), tokenizer: str | None = None, conv_col: str = "conv_id"
) -> DataFrame:
    """Read every conversation back from the tokens of its nodes.

    Returns ``conv_col``, n_turns, turns_sha256 (of role, line feed, text, line feed per turn),
    loss_chars, loss_sha256 (of the texts under the loss mask), formatted_chars. A digest runs
    through a conversation in order, so one task reads it, a turn at a time.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = decoder(path)
        current, kind, facts = None, None, []

        def rows(done: list[list]) -> pa.RecordBatch:
            out = [(c, n, t.hexdigest(), k, h.hexdigest(), f) for _, c, n, t, k, h, f in done]
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for batch in runs(batches, text="ids", most=2000):
            kind, done = batch.column("conv").type, []
            raw, at = text_bytes(batch.column("ids"))
            ids = raw.view("<u4").astype(np.int64)
            spelled, reached = spell(ids), np.append(0, np.cumsum(spell.length[ids]))
            at = at // 4
            learnt_from, learnt_to = (batch.column(n).to_numpy() + at[:-1] for n in ("loss_begin", "loss_end"))
            places = (reached[p].tolist() for p in (at[:-1], at[1:], learnt_from, learnt_to))
            columns = (batch.column(n).to_pylist() for n in ("cid", "conv"))
            for cid, conv, begin, end, first, last in zip(*columns, *places, strict=True):
                if cid != current:
                    if facts:
                        done.append(facts)
                    current, facts = cid, [cid, conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turn = spelled[begin:end].decode()
                role, text = template.parsed(turn)
                facts[2] += 1
                facts[3].update(f"{role}\n{text}\n".encode())
                if last > first:
                    learnt = template.unescape(spelled[first:last].decode())
                    facts[4] += len(learnt)
                    facts[5].update(learnt.encode())
                facts[6] += len(turn)
            if done:
                yield rows(done)
        if facts:
            yield rows([facts])

    joined = trees.members.withColumnRenamed(conv_col, "conv").join(
        trees.nodes.select("number", "ids", "loss_begin", "loss_end"), "number"
    )
    kind = joined.schema["conv"].dataType.simpleString()
    ordered = joined.repartition("cid").sortWithinPartitions("cid", "place")
    return ordered.select("cid", "conv", "ids", "loss_begin", "loss_end").mapInArrow(
        read,
        f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
