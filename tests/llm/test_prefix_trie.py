"""The prefix trie against a trie of nested dictionaries in plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from accordis.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, piece int, words string, _row string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(11)
    out = []
    for c in range(-25, 130):
        if c % 37 == 5:
            continue
        opening = rng.choice(["Hello there", "hello there", "Bonjour é", ""])
        out += [(c, t, "user" if t % 2 == 0 else "assistant", opening if t == 0 else f"turn {t} {rng.randint(0, 1)}") for t in range(rng.randint(1, 5))]
    out += [(40, t, "user", "long " * (t % 3)) for t in range(10, 60)]  # longer than several pieces
    out += [(c, t, "user", f"the same {t}") for c in range(200, 260) for t in range(4)]  # copies
    out += [(300, 0, "a", "b c"), (301, 0, "ab", " c"), (302, 0, None, None), (303, None, "user", "null first"), (303, 0, "user", "then"), (304, 1, "user", "tie a"), (304, 1, "user", "tie b")]
    out += [(305, 0, "user", "repeated row")] * 9 + [(None, 0, "user", "no conversation"), (321, 7, "user", "one turn only")]
    rng.shuffle(out)
    return [(*r, "clash", 1, None, "row") for r in out]


def ordered(raw):
    sha = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()
    turns = defaultdict(list)
    for r in sorted((r for r in raw if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, sha(r))):
        turns[r[0]].append((r[2] or "", r[3] or ""))
    return turns


def rebuilt(turns):
    out = {}
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + turns[c][h:]
    return out


def brute(convs):
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)

    def below(k):
        found = [below(x) for x in children[k]]
        saved = (len(members[k]) - 1) * len(WORDS.findall(k[-1][1])) if k else 0
        return (sum(f[0] for f in found) if found else 1), saved + sum(f[1] for f in found)

    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(children[k]), *below(k), sha(k)) for k, m in members.items())


def found(nodes):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in nodes.collect())


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(7)


def test_rebuilt_conversations(conversations, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    monkeypatch.setattr(prefix_trie, "BLOCK", 5)  # ids of a node in several blocks
    turns, convs = prefix_trie.rebuilt(prefix_trie.numbered(conversations))
    assert found(prefix_trie.trie(turns, convs, piece=4)) == brute(rebuilt(ordered(rows())))


def test_plain_conversations_with_texts(conversations, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARE", 40)  # some prefixes are frequent, the others go through windows
    turns = prefix_trie.numbered(conversations)
    nodes = prefix_trie.trie(turns, turns.select("conv_id").distinct())
    want = ordered(rows())
    assert found(nodes) == brute(want)
    for r in prefix_trie.with_turns(nodes, conversations, turns).collect():
        assert (r.role, r.text) == ((None, None) if not r.depth else want[r.conv_id][r.depth - 1])


def test_equal_rows_are_dealt_to_several_tasks(spark):
    same = spark.range(40_000).selectExpr("1L AS conv_id", "0L AS turn", "'user' AS role", "'x' AS text").repartition(8)
    turns = prefix_trie.numbered(same)
    assert turns.selectExpr("count(DISTINCT depth)", "min(depth)", "max(depth)").first()[:] == (40_000, 1, 40_000)
    nodes = prefix_trie.trie(turns, turns.select("conv_id").distinct(), piece=512)
    assert nodes.selectExpr("count(*)", "sum(n_children)", "sum(n_leaves)", "sum(saved_tokens)").first()[:] == (40_001, 40_000, 40_001, 0)


def test_empty(spark):
    turns, convs = prefix_trie.rebuilt(prefix_trie.numbered(spark.createDataFrame([], SCHEMA)))
    assert prefix_trie.trie(turns, convs).collect() == []
