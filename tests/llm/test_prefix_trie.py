import hashlib
import zlib
from collections import defaultdict

import pytest

from wordloom.llm import prefix_trie, queries


def rebuild(rows):
    """{conversation: [(role, text)]} of the rebuilt conversations."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            named = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, named, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(seqs):
    members = defaultdict(set)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].add(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[:len(q)] == q for x in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in cs if len(seqs[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs),
                    sum(len(q) == len(p) + 1 for q in below), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, c int, d string, name string, n_convs int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "own", "own", 2) for r in rows], SCHEMA)


def found(df):
    return sorted([tuple(r[c] for c in COLUMNS) for r in df.collect()], key=str)


def test_odd_input(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{'hi' if c % 3 else 'Grüße'} {t if t < 2 else c % 4}")
            for c in range(-7, 23) for t in range(abs(c) % 6)]
    rows += [(40, None, None, None), (40, 0, "user", ""), (40, 0, "user", ""), (40, 0, "", "user"), (41, 3, None, "x" * 40_000),
             (None, 0, "user", "nobody"), (44, 0, "user", "hi"), (44, 0, "user", "hi")]
    assert found(prefix_trie.conversation_trie(frame(spark, rows))) == brute(rebuild(rows))


@pytest.mark.parametrize("lengths", [[0, 0], [1, 1, 0], [21, 20, 3, 16, 8]])
def test_heights(spark, lengths):
    """Plain sequences of all heights, one path inside the other."""
    seqs = {c: [("u", str(i)) for i in range(n)] for c, n in enumerate(lengths)}
    turns = [(c, d + 1, hashlib.sha256(t.encode()).digest(), len(t)) for c, s in seqs.items() for d, (_r, t) in enumerate(s)]
    got = prefix_trie.trie(spark.createDataFrame(turns, "c long, d long, t binary, bytes long"),
                           spark.createDataFrame(list(enumerate(lengths)), "c long, len long"))
    assert found(got) == brute(seqs)


def test_hot_node_and_long_conversation(spark, monkeypatch):
    """A third of the conversations are alike; one has a third of all turns."""
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 50)
    rows = [(c, t, "user", str(t) if c % 3 == 0 else f"{c} {t}") for c in range(100) for t in range(4)]
    rows += [(1000, t, "user", str(t % 5)) for t in range(150)]
    assert found(prefix_trie.conversation_trie(frame(spark, rows))) == brute(rebuild(rows))


def test_empty_table(spark):
    assert prefix_trie.conversation_trie(frame(spark, [])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op13_prefix_trie(spark, sf)) == brute(rebuild(rows))
