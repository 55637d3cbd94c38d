"""The trie against a dictionary of prefixes, its merge against a plain sort, and the query against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from fairgrid.llm import prefix_trie
from fairgrid.llm.prefix_trie import MARK, common_turns, merged, sorted_run

SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, kind string, base long, run int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "kind", 2, 3) for r in rows], SCHEMA)


def plain(rows, rebuild):
    """All nodes, from a dictionary of prefixes."""
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[: 2 * MARK], text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    convs = own
    if rebuild:
        convs = {}
        for c, turns in own.items():
            h, base = zlib.crc32(str(c).encode()) % 9, c - int(c / 5) * 5
            convs[c] = own.get(c - base, [])[:h] + turns[h:]
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        own_saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        sums[node] = (sum(sums[x][0] for x in below) or 1, own_saved + sum(sums[x][1] for x in below))
    out = []
    for node, own_members in members.items():
        ends = ",".join(str(c) for c in sorted(own_members) if len(convs[c]) == len(node))
        out.append((min(own_members), len(node), min(members[node[:-1]]) if node else None, len(own_members), len(children.get(node, [])), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(n, seed):
    """Conversations that share long stems, some equal, some prefixes of others."""
    rng = random.Random(seed)
    stems = [[("user", f"stem {k} {j}") for j in range(rng.randint(1, 12))] for k in range(4)]
    rows = []
    for c in range(n):
        stem = rng.choice(stems)
        turns = stem[: rng.randint(0, len(stem))] + [("assistant", f"é {rng.randint(0, 3)}") for _ in range(rng.randint(0, 3))]
        turns = turns or [("user", "lone")]
        if rng.random() < 0.3:
            turns = [("user", "hot"), ("assistant", "same")]
        rows += [(c * 3 - 40, t, *turn) for t, turn in enumerate(turns)]
    rng.shuffle(rows)
    return rows


def nodes(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("settings", [{}, {"part_bytes": 2000, "run_rows": 23, "block_rows": 4}, {"part_bytes": 300, "run_rows": 7, "block_rows": 3}])
def test_equals_a_dictionary_of_prefixes(spark, monkeypatch, settings):
    if settings:
        monkeypatch.setattr(prefix_trie, "END_IDS", 5)
        monkeypatch.setattr(prefix_trie, "WAITING", 6)
        monkeypatch.setattr(prefix_trie, "BROADCAST_NODES", 3)
    rows = made(300, 1)
    got = prefix_trie.trie(prefix_trie.sequences(table(spark, rows).repartition(3)), **settings)
    assert nodes(got) == plain(rows, False)
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, rows))), **settings)
    assert nodes(got) == plain(rows, True)


def test_awkward_conversations(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (2, 0, "user", None), (2, 0, "user", None), (None, 0, "user", "x"), (3, 5, "a", "bc"), (3, 5, "a", "bc"), (4, 5, "ab", "c"), (5, 2, "user", "y" * 100_000), (6, 1, "user", "y" * 100_000), (6, 3, "", ""), (12, 0, "user", "own"), (-3, 1, "user", "x"), (-8, 1, "user", "x")]
    rows += [(700, t, "user", str(t % 3)) for t in range(3000)] + [(701, t, "user", str(t % 3)) for t in range(2900)]
    for rebuild in (False, True):
        shaped = prefix_trie.sequences(table(spark, rows))
        got = nodes(prefix_trie.trie(prefix_trie.rebuilt(shaped) if rebuild else shaped, part_bytes=20_000))
        assert got == plain(rows, rebuild)
    assert nodes(prefix_trie.trie(prefix_trie.sequences(table(spark, [])))) == []
    assert nodes(prefix_trie.trie(prefix_trie.sequences(table(spark, [(None, 1, "user", "x")])))) == []


def test_common_turns():
    a, b, c = bytes([1] * MARK), bytes([1] * (MARK - 1) + [2]), bytes(MARK)
    assert [common_turns(*x) for x in ((b"", a), (a, a), (a, b), (a + b, a + c), (c + a, c), (a + a + b, a + a + b + c, 2))] == [0, 1, 0, 1, 1, 3]


@pytest.mark.parametrize("runs", [1, 2, 3, 5, 8, 13])
def test_merge_of_runs_carries_lcps(monkeypatch, runs):
    rng = random.Random(runs)
    pool = [hashlib.sha256(bytes([k])).digest()[:MARK] for k in range(3)]
    rows = [(b"".join(marks), i, list(range(len(marks)))) for i, marks in enumerate([rng.choices(pool, k=rng.randint(0, 6)) for _ in range(400)])]
    names = [f.name for f in prefix_trie._arrow(prefix_trie.BLOCKS)]
    blocks = [dict(zip(names, b, strict=True)) for k in range(runs) for b in sorted_run(rows[k::runs], k, [], 7)]
    blocks.sort(key=lambda b: (b["need_key"] is not None, b["need_key"] or b"", b["need_id"] or 0))
    compared = []
    plain_common = common_turns
    monkeypatch.setattr(prefix_trie, "common_turns", lambda a, b, since=0: compared.append(since) or plain_common(a, b, since))
    got = list(merged(iter(blocks)))
    want = sorted(rows, key=lambda r: r[:2])
    assert [(k, i, s) for k, i, s, _ in got] == [(k, i, s) for k, i, s in want]
    assert [lcp for *_, lcp in got] == [plain_common(a[0], b[0]) for a, b in zip([(b"",), *want], want, strict=False)]
    if runs > 1:
        assert sum(x > 0 for x in compared) > len(compared) / 4  # shared turns aren't compared again


def test_ties_are_in_one_order(spark):
    rows = [(c, 1, "user", f"tie {k}") for c in (10, 11, 15) for k in range(4)] + [(c, None, None, f"first {k}") for c in (10, 16) for k in range(2)]
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = nodes(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, rows)))))
    assert got == plain(rows, True) == sorted(con.sql(prefix_trie.OP12_SQL).fetchall(), key=str)


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_query_equals_sql(spark, folder):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '/root/testdata/{folder}/conversations.parquet'")
    want = con.sql(prefix_trie.OP12_SQL)
    got = prefix_trie.op12_prefix_trie(spark, f"/root/testdata/{folder}")
    assert got.columns == want.columns
    assert nodes(got) == sorted(want.fetchall(), key=str)
