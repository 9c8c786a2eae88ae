"""Sharding, prefix trie and conversation repair against SQL, brute force and their laws."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF, docs_frame, with_clashes
from trellis.llm import conversation_repair, prefix_trie, queries, shard_tree
from trellis.llm.tree_sums import subtree_sums

CONV = "conv_id long, turn long, role string, text string"


def _duck(folder, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    cur = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def _same(spark, folder, name):
    df = queries.QUERIES[name](spark, str(folder))
    cols, rows = _duck(folder, name)
    assert sorted(df.columns) == sorted(cols)
    want = sorted((tuple(r[cols.index(c)] for c in df.columns) for r in rows), key=str)
    assert sorted((tuple(r) for r in df.collect()), key=str) == want


# ------------------------------------------------------------------ sharding

def edge_documents(spark):
    return docs_frame(spark, [(i, f"text {i}") for i in range(300)] + [(None, None), (None, "a"), (None, ""), (7, "text 7"),
                              (7, "text 7"), (-5, "é" * 3000), (2**62, "日本語")] + [(9, "copy")] * 40)


def test_shards_equal_sql_on_edges(spark, tmp_path):
    with_clashes(edge_documents(spark)).write.parquet(f"{tmp_path}/documents.parquet")
    _same(spark, tmp_path, "op11_hash_tree_shards")


def test_shards_empty(spark):
    assert shard_tree.digest(docs_frame(spark, [(1, "x")]).where("false"), 40, 41).count() == 0


def test_growth_takes_rows_only_into_the_new_shard(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    placed = ids
    for n in (5, 6, 20, 21, 47, 48):
        placed = shard_tree.place(placed, "doc_id", shard_tree.tree(n), f"s{n}")
    rows = placed.toPandas()
    for n in (5, 20, 47):
        moved = rows[rows[f"s{n}"] != rows[f"s{n + 1}"]]
        assert (moved[f"s{n + 1}"] == n).all()
        assert abs(len(moved) - 20_000 / (n + 1)) < 6 * (20_000 / (n + 1)) ** 0.5
    sizes = rows.s20.value_counts()
    assert len(sizes) == 20 and abs(sizes - 1000).max() < 6 * 1000 ** 0.5


def test_weights_share_rows_and_confine_movement(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    light, heavy = [1.0] * 48, [1.0] * 48
    heavy[5] = 4.0        # region 1, rack 1
    before, after = shard_tree.tree(48, weights=light), shard_tree.tree(48, weights=heavy)
    rows = shard_tree.place(shard_tree.place(ids, "doc_id", before, "a"), "doc_id", after, "b").toPandas()
    region, rack = (np.array([getattr(p, f) for p in before]) for f in ("region", "rack"))
    moved = rows[rows.a != rows.b]
    assert (region[moved.b] == region[5]).all()                      # into the heavier region only
    inside = moved[region[moved.a] == region[5]]
    assert (rack[inside.b] == rack[5]).all()                         # there into the heavier rack only
    assert (inside[rack[inside.a] == rack[5]].b == 5).all()          # and there into the heavier shard
    assert abs((rows.b == 5).sum() - 20_000 * 4 / 51) < 6 * (20_000 * 4 / 51) ** 0.5


def test_slots_of_a_row_repeated_many_times(spark, monkeypatch):
    monkeypatch.setattr(shard_tree, "COPIES_A_TASK", 100)
    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(3).alias("shard"))
    slots = sorted(r.slot for r in shard_tree.slots(df, 4).collect())
    assert slots == list(range(2000))


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = edge_documents(spark)
    back = shard_tree.write_shards(docs, "doc_id", shard_tree.tree(6), f"{tmp_path}/out", files=2)
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert len(os.listdir(f"{tmp_path}/out/shard=0")) >= 2


# ------------------------------------------------------------------ trie

def edge_conversations(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 14), 100, 101, 102, 200, 203, 305, 306, -7, -100]:
        n = rng.choice([1, 1, 2, 3, 5, 8])
        for t in range(n):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "", "ccc é."])))
    for c in range(400, 440):   # many equal conversations
        rows += [(c, 0, "user", "hello."), (c, 1, "assistant", "yes!")]
    rows += [(500, None, "system", None), (500, 0, None, "x"), (500, 3, "user", " \t"), (500, 3, "user", " \t"),
             (None, 0, "user", "lost."), (None, None, None, None), (501, -4, "tool", "?"), (502, None, "", "")]
    rows += [(600, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(150)]
    return spark.createDataFrame(rows, CONV).repartition(3)


def test_trie_equals_sql_on_edges(spark, tmp_path):
    with_clashes(edge_conversations(spark)).write.parquet(f"{tmp_path}/conversations.parquet")
    _same(spark, tmp_path, "op12_prefix_trie")


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPAN", 16)
    monkeypatch.setattr(prefix_trie, "POSITIONS", 4)
    monkeypatch.setattr(prefix_trie, "HOT_SHARE", 10)
    df = edge_conversations(spark)
    convs: dict = {}
    for r in df.collect():
        if r.conv_id is not None:
            convs.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()))
    rebuilt = {}
    for c, turns in convs.items():
        base = c - int(np.fmod(c, 100))
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = [t[1:] for t in convs.get(base, [])[:h] + turns[h:]]
    members: dict = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids: dict = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    want = []
    for p, cs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(rebuilt[c]) == len(p)))
        want.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])),
                     sum(q not in kids for q in below), sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q),
                     hashlib.sha256(ends.encode()).hexdigest()))
    got = [tuple(r) for r in prefix_trie.trie(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], CONV)).count() == 0


def test_subtree_sums_of_chains_stars_and_random_trees(spark):
    rng = random.Random(2)
    parent: dict = {}
    for i in range(1, 200):
        parent[f"chain{i}"] = f"chain{i - 1}" if i > 1 else "root"
    for i in range(150):
        parent[f"star{i}"] = "root"
    for i in range(200):
        parent[f"any{i}"] = f"any{rng.randrange(i)}" if i else "chain100"
    parent["other"] = None
    parent["root"] = None
    depth = {}

    def at(x):
        if x not in depth:
            depth[x] = 0 if parent[x] is None else at(parent[x]) + 1
        return depth[x]
    weight = {x: rng.randrange(100) for x in parent}
    want = dict.fromkeys(parent, 0)
    for x in parent:
        up = x
        while up is not None:
            want[up] += weight[x]
            up = parent[up]
    nodes = spark.createDataFrame([(x, p, at(x), weight[x]) for x, p in parent.items()], "node string, parent string, depth long, w long")
    assert {r.node: r.w for r in subtree_sums(nodes, ["w"]).collect()} == want


# ------------------------------------------------------------------ repair

def test_repair_equals_sql_on_edges(spark, tmp_path):
    with_clashes(edge_conversations(spark)).write.parquet(f"{tmp_path}/conversations.parquet")
    _same(spark, tmp_path, "op13_conversation_repair")


def noisy_conversations(spark, sizes):
    rng = random.Random(11)
    rows = []
    for c, n in enumerate(sizes):
        for t in range(n):
            rows.append((c, t if rng.random() > 0.1 else rng.randrange(n), rng.choice(["system", "user", "user", "assistant", "assistant", "tool"]),
                         rng.choice(["a.", "b", "", " ", f"long {t} text!"])))
    return spark.createDataFrame(rows, CONV).repartition(3)


def test_repair_of_long_conversations_equals_sql(spark, tmp_path):
    noisy_conversations(spark, [0, 1, 2, 63, 64, 65, 130, 400]).write.parquet(f"{tmp_path}/conversations.parquet")
    _same(spark, tmp_path, "op13_conversation_repair")


def test_blocks_of_any_length_and_texts_in_pieces_agree(spark, monkeypatch):
    df = noisy_conversations(spark, [5, 40, 90])
    want = sorted(map(str, conversation_repair.repair(df).collect()))
    monkeypatch.setattr(conversation_repair, "BLOCK_ROWS", 3)
    monkeypatch.setattr(conversation_repair, "PIECE", 2)
    assert sorted(map(str, conversation_repair.repair(df).collect())) == want


def _cheapest(kinds):
    """All edits of a few rows, tried out: the least (cost, letters)."""
    best = None
    for ops in itertools.product("KRD", repeat=len(kinds)):
        for gaps in itertools.product(range(3), repeat=len(kinds) + 1):
            cost, letters, roles, ok = 5 * sum(gaps), "", "", True
            for i, op in enumerate((*ops, None)):
                for _ in range(gaps[i]):
                    roles += "a" if roles[-1:] == "u" else "u"
                    letters += "I"
                if op is None:
                    break
                role, fault = "sua?"[kinds[i] // 3], kinds[i] % 3
                letters += op
                if op == "D":
                    cost += 2
                    continue
                ok = ok and fault != 1
                cost += 5 * (fault == 2) + (op == "R")
                roles += role if op == "K" else ("a" if roles[-1:] == "u" else "u")
            import re
            if ok and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, letters) < best):
                best = (cost, letters)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_edits_are_the_cheapest_and_least(seed):
    import pandas as pd
    rng = random.Random(seed)
    kinds = [rng.randrange(12) for _ in range(rng.randrange(1, 5))]
    text = "".join(chr(65 + k) for k in kinds)
    step = rng.randrange(1, 3)
    parts = [text[i:i + step] for i in range(0, len(text), step)]
    blocks = pd.DataFrame({"c": "x", "block": range(len(parts)), "blocks": len(parts), "kinds": parts, "blank": 0, "duplicate": 0,
                           "truncated": 0, "place": None})
    back = pd.concat(conversation_repair._multiplied([blocks])).iloc[::-1].reset_index(drop=True)
    ends = pd.concat(conversation_repair._checkpointed([back])).iloc[::-1].reset_index(drop=True)
    out = pd.concat(conversation_repair._chained(conversation_repair._walked([ends])))
    assert (int(out.cost.sum()), "".join(out.edits)) == _cheapest(kinds)


def test_repair_of_nothing(spark):
    assert conversation_repair.repair(spark.createDataFrame([], CONV)).count() == 0


@pytest.mark.parametrize("name", ["op11_hash_tree_shards", "op12_prefix_trie", "op13_conversation_repair"])
def test_new_queries_equal_sql_on_the_small_tables(spark, name):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    from tests.oracle_compare import compare
    assert compare(spark, SF, name)["status"] == "ok"


def test_a_forgotten_table_is_gone(spark):
    from trellis.llm.common import forget, shared_table
    kept, gone = (shared_table(spark.range(10), n) for n in ("kept", "gone"))
    folder = gone.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    assert os.path.isdir(folder)
    forget(gone)
    assert not os.path.exists(folder) and kept.count() == 10
