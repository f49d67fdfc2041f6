"""The prefix trie against brute force."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from millrace.llm import prefixtrie
from millrace.llm.prefixtrie import Ended, balanced

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rebuilt(rows):
    """conv_id -> [(role, text)]."""
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, role, sha(f"{len(role)}:{role}{text}"), text))
    own = {c: [(role, text) for _, _, role, _, text in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))  # the remainder has the sign of c, as in SQL
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(sequences):
    """The eight columns of every node; ``sequences`` is conv_id -> list of (role, text)."""
    members, ends = {}, {}
    for c, turns in sequences.items():
        for depth in range(len(turns) + 1):
            members.setdefault(tuple(turns[:depth]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {node: 0 for node in members}
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, held in members.items():
        own = (len(held) - 1) * len(node[-1][1].encode().split()) if node else 0
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += not children[node]
            saved[node[:depth]] += own
    return sorted(
        (min(held), len(node), min(members[node[:-1]]) if node else -1, len(held), children[node], leaves[node], saved[node],
         sha(",".join(map(str, sorted(ends.get(node, []))))))
        for node, held in members.items()
    )


def run(spark, rows, **settings):
    table = spark.createDataFrame([(*row, "x", 1.0) for row in rows], f"{SCHEMA}, ids string, words double")
    found = prefixtrie.prefix_trie(prefixtrie.shared_openings(prefixtrie.turn_sequences(table)), **settings)
    assert found.columns == list(prefixtrie._RESULT)
    return sorted(tuple(-1 if value is None else value for value in row) for row in found.collect())


def conversations(seed, count, turns=6, texts=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(count):
        for turn in range(int(rng.integers(1, turns + 1))):
            text = " ".join(["word"] * int(rng.integers(0, texts)))
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", text))
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("shard_turns", [20, 10_000])
def test_against_brute_force(spark, shard_turns):
    """With few turns to a shard nearly all nodes are in several."""
    rows = conversations(shard_turns, 250)
    assert run(spark, rows, shard_turns=shard_turns) == brute(rebuilt(rows))


def test_hot_conversation_and_first_turn(spark, monkeypatch):
    """One sequence of a third of all conversations goes through many pieces and shards."""
    monkeypatch.setattr(prefixtrie, "PIECE", 20)
    rows = [(c, t, "user", f"same {t}") for c in range(0, 600, 20) for t in range(4)]
    rows += [(c + 1, t, "user", "same 0" if t == 0 else f"own {c} {t}") for c in range(0, 600, 20) for t in range(5)]
    rows += [(c + 2, t, "user", f"same {t}") for c in range(0, 600, 20) for t in range(5)]
    assert run(spark, rows, shard_turns=50) == brute(rebuilt(rows))


def test_long_conversation(spark):
    rows = [(20, t, "user", f"turn {t} of many") for t in range(150)] + [(25, t, "user", f"turn {t} of many") for t in range(120)]
    found = run(spark, rows, shard_turns=50)
    assert found == brute(rebuilt(rows))
    assert max(row[1] for row in found) == 150


def test_nulls_ties_repeats(spark):
    rows = [(0, 0, None, None), (0, None, "user", "before all"), (0, 1, "b", "x"), (0, 1, "a", "y y"), (0, 1, "a", "y y"), (None, 0, "user", "nobody")]
    rows += [(1, 0, "", ""), (2, None, None, None), (2, None, None, None), (-5, 0, "user", "below zero"), (4, 0, "ab", "c"), (5, 0, "a", "bc"), (6, 0, "user", "\x0b   ")]
    assert run(spark, rows) == brute(rebuilt(rows))


def test_turnless_conversations_are_members_of_the_root(spark):
    """Without a conversation to open with, one that is shorter than its opening has no turns."""
    ids = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3]
    found = run(spark, [(c, 0, "user", "gone") for c in ids])
    assert found == [(min(ids), 0, -1, len(ids), 0, 1, 0, sha(",".join(map(str, ids))))]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_medians_keep_the_tree_flat():
    tree = balanced([Ended([i, 7], [1, 1], 1, i, "") for i in range(1_023)])

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.low[node]), height(tree.high[node]))

    assert height(tree.equal[0]) == 10
    assert sorted(tree.order()) == list(range(len(tree.turn)))
    assert [tree.turn[node] for node in tree.path([500, 7])[1:]] == [500, 7]


def test_only_edge_paths_are_merged():
    """Of a shard with many nodes, those on two paths alone are left to the merge."""
    rows = list(prefixtrie.shard_nodes([Ended([i // 10, i, 1], [1, 1, 1], 1, i, "") for i in range(500)], 0))
    kinds = [row["kind"] for row in rows]
    assert kinds.count(prefixtrie.EDGE) == 7 and kinds.count(prefixtrie.STEP) == 8
    assert kinds.count(prefixtrie.INNER) == 1 + 50 + 500 + 500 - 7
