"""The prefix trie against a trie built turn by turn."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from lodestone.llm import prefix_trie, queries

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(turns):
    own = defaultdict(list)
    for c, turn, role, text, *_ in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(rows)] for c, rows in own.items()}
    out = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + rows[h:]
    return out


def trie(paths):
    """The contract's rows, by walking every subtree."""
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        found = [below(k) for k in children[node]]
        return own + sum(s for s, _ in found), sum(n for _, n in found) if found else 1

    rows = []
    for node, own in members.items():
        saved, leaves = below(node)
        ends = ",".join(str(c) for c in own if len(paths[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        rows.append((own[0], len(node), parent, len(own), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def found(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def run(spark, turns, schema=TURNS):
    numbered = prefix_trie.number_turns(spark.createDataFrame(turns, schema).repartition(5))
    return found(prefix_trie.prefix_trie(*prefix_trie.with_shared_beginnings(numbered)))


def test_whole_table(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert found(queries.op12_conversation_prefix_trie(spark, "/root/testdata/sf0.001")) == trie(rebuilt(turns))


def test_awkward_turns(spark):
    turns = [
        (100, 0, "user", "hello"), (100, 1, None, None), (100, None, "system", "before"), (100, 2, "user", "x" * 5000), (100, 3, "", ""), (100, 4, "a", "b"),
        (101, 0, "user", "hello"), (102, 7, "user", "late"), (103, 0, "user", "hello"), (103, 0, "user", "hello"), (104, 1, "us", "erhello"),
        (None, 0, "user", "hello"), (205, 0, "user", "no beginning"), (206, 0, None, ""), (207, 0, "", None), (7, 0, "é", "日本\U0001f600"),
    ]
    assert run(spark, turns) == trie(rebuilt(turns))


def test_clashing_columns(spark):
    turns = [(c, t, "user", f"text {t % 3}", 1, 2, "p") for c in range(95, 130) for t in range(c % 7)]
    schema = TURNS + ", position int, part int, h1 string"
    assert run(spark, turns, schema) == trie(rebuilt(turns))


def test_empty_and_turnless(spark):
    assert run(spark, []) == []
    nothing = prefix_trie.number_turns(spark.createDataFrame([], TURNS))
    members = spark.createDataFrame([(3,), (1,), (None,)], "conv_id long")
    assert found(prefix_trie.prefix_trie(nothing, members)) == trie({1: [], 3: []})


@pytest.mark.parametrize("partitions", [1, 7])
def test_hot_prefixes_and_a_hot_conversation_span_ranges(spark, partitions):
    """A third of all turns is one conversation, a third of the conversations is the same."""
    turns = [(1, t, "user", f"w{t % 5}") for t in range(300)]
    turns += [(c, t, "user", f"same {t}") for c in range(1000, 1100) for t in range(3)]
    turns += [(c, t, "user", f"{c % 9} {t}") for c in range(2001, 2100) for t in range(c % 5)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert run(spark, turns) == trie(rebuilt(turns))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
