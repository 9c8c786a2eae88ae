"""Queries of the subpackage, by name, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import (conversation_repair, decontaminate, fingerprint, lm_score, minhash_join, packing, prefix_trie, quality_pu, repeats, secrets_crf,
                         shard_tree, toxicity, url_filter)
from trellis.llm.common import id_remainder, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.match(table(spark, sf_dir, "documents"),
                                                    table(spark, sf_dir, "benchmark"))).drop("longest")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), id_remainder(F.col("_id"), 5) != 0)
    return _judged(toxicity.score(docs, model), id_remainder(F.col("doc_id"), 5) == 0)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_crf.report(secrets_crf.scan(table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_pu.train(docs, table(spark, sf_dir, "labels"), id_remainder(F.col("_id"), 3) != 1)
    return _judged(quality_pu.score(docs, model), id_remainder(F.col("doc_id"), 3) == 1)


def _judged(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

# The rules of the contract (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score_documents(table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 10) != 0)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op9_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)



SHARDS = 40


def op11_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.digest(table(spark, sf_dir, "documents"), SHARDS, SHARDS + 1)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_repeats": op7_repeats,
    "op8_lm_scores": op8_lm_scores,
    "op9_weighted_fingerprints": op9_weighted_fingerprints,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_hash_tree_shards": op11_hash_tree_shards,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_conversation_repair": op13_conversation_repair,
}

_RULE_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

# one window of each distinct length for short items; the words of a text as a list
_BENCH_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

# CRC-32 in SQL: the table of the reflected polynomial by its rule, then one step a byte
_CRC_TABLE = """crc_t AS (SELECT list(list_reduce([b] || range(8), lambda t, k: xor(t >> 1, 3988292384 * (t & 1)))
    ORDER BY b) AS crc_table FROM range(256) r(b))"""


def _crc(text: str) -> str:
    return f"""xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode({text})), '..'),
    lambda x: ('0x' || x)::BIGINT), lambda s, b: xor(crc_table[(xor(s, b) & 255) + 1], s >> 8)), 4294967295)"""


def _shard_sql(shards: int, out: str) -> str:
    """A row's shard: the draws of every attempt by level, the smallest wins; the first attempt on a live place counts."""
    places = shard_tree.tree(shards)
    rows = ", ".join(f"('{p.region}', '{p.rack}', '{p.name}', {'NULL' if p.shard is None else p.shard})" for p in places)
    def draw(node: str, weight: str) -> str:
        return f"""-ln((('0x' || substr(md5(concat_ws('|', key, attempt, {node})), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
            / {weight}"""
    def level(name: str, node: str, up: str, parent: str) -> str:
        return f"""{out}_{name} AS (SELECT key, attempt, arg_min(node, draw) AS node FROM (SELECT u.key, u.attempt, n.node,
            {draw('n.node', 'n.weight')} AS draw FROM {up} u JOIN (SELECT {node} AS node, {parent} AS parent,
            count(*)::DOUBLE AS weight FROM {out}_places GROUP BY 1, 2) n ON n.parent = u.node) GROUP BY 1, 2)"""
    return f"""{out}_places(region, rack, place, shard) AS (VALUES {rows}),
{out}_try AS (SELECT key, attempt, '' AS node FROM keys, range({shard_tree.ATTEMPTS}) a(attempt)),
{level('region', 'region', f'{out}_try', "''")}, {level('rack', 'rack', f'{out}_region', 'region')},
{level('place', 'place', f'{out}_rack', 'rack')},
{out}_found AS (SELECT key, arg_min(p.shard, l.attempt) AS shard FROM {out}_place l JOIN {out}_places p ON p.place = l.node
    WHERE p.shard IS NOT NULL GROUP BY key),
{out}_last AS (SELECT key, arg_min(shard, draw) AS shard FROM (SELECT k.key, p.shard, {draw('p.place', '1.0').replace('attempt', '-1')} AS draw
    FROM keys k, {out}_places p WHERE p.shard IS NOT NULL) GROUP BY key),
{out} AS (SELECT key, coalesce(f.shard, l.shard) AS shard FROM {out}_last l LEFT JOIN {out}_found f USING (key))"""


def _edit(letter: str, cost: str, rest: str) -> str:
    """An edit before the rest: nine digits of cost, then the letters, so that texts compare as wanted."""
    return f"printf('%09d', {cost} + CAST(substr({rest}, 1, 9) AS INT)) || '{letter}' || substr({rest}, 10)"


def _repair_step(state: int) -> str:
    """The best without inserts from a state: delete, keep where the role fits, or a new role."""
    fits = {0: "role_no IN (0, 1)", 1: "role_no = 1", 2: "role_no = 2", 3: "role_no = 1"}[state]
    then = {0: "CASE role_no WHEN 0 THEN b1 ELSE b2 END", 1: "b2", 2: "b3", 3: "b2"}[state]
    given = {0: "b2", 1: "b2", 2: "b3", 3: "b2"}[state]
    return f"""least({_edit('D', '2', f'b{state}')}, CASE WHEN NOT lost THEN {_edit('R', '1 + extra', given)} ELSE '~' END,
        CASE WHEN NOT lost AND {fits} THEN {_edit('K', 'extra', f'({then})')} ELSE '~' END) AS x{state}"""


ORACLE = {
    "op13_conversation_repair": f"""
WITH RECURSIVE {_CRC_TABLE},
z AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS harm
      FROM conversations, crc_t),
d AS (SELECT c, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
      CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
      unnest(range(CASE harm WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM z WHERE harm <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos,
      rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
f AS (SELECT *, body = '' AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 AS again,
      right(body, 1) NOT IN ('.', '!', '?') AS cut, substr(role, 1, 1) AS initial,
      lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY pos) AS earlier FROM o),
r AS (SELECT *, blank OR again AS lost, CASE WHEN NOT blank AND NOT again AND cut THEN 5 ELSE 0 END AS extra,
      CASE initial WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS role_no FROM f),
sums AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank,
         sum((again AND NOT blank)::INT) AS duplicate, sum((extra > 0)::INT) AS truncated,
         sum((pos > 1 AND earlier || initial NOT IN ('su', 'ua', 'au'))::INT) AS illegal, count(*) AS n FROM r GROUP BY c),
dp AS (SELECT c, n + 1 AS pos, '000000000' AS b0, '000000010II' AS b1, '000000005I' AS b2, '000000000' AS b3 FROM sums
       UNION ALL
       SELECT c, pos, least(x0, {_edit('I', '5', 'x2')}, {_edit('II', '10', 'x3')}), least(x1, {_edit('I', '5', 'x2')}, {_edit('II', '10', 'x3')}),
              least(x2, {_edit('I', '5', 'x3')}), least(x3, {_edit('I', '5', 'x2')})
       FROM (SELECT dp.c, r.pos, {_repair_step(0)}, {_repair_step(1)}, {_repair_step(2)}, {_repair_step(3)}
             FROM dp JOIN r ON r.c = dp.c AND r.pos = dp.pos - 1)),
best AS (SELECT c, CAST(substr(b0, 1, 9) AS BIGINT) AS cost, substr(b0, 10) AS audit FROM dp WHERE pos = 1),
walk AS (SELECT c, audit, 1 AS i, 1::BIGINT AS pos, 0 AS q, [] :: VARCHAR[] AS lines FROM best
         UNION ALL
         SELECT c, audit, i + 1, pos + (e <> 'I')::INT, CASE e WHEN 'D' THEN q WHEN 'K' THEN role_no + 1 WHEN 'I' THEN given ELSE given END,
                CASE e WHEN 'D' THEN lines WHEN 'K' THEN lines || [role || ':' || text]
                ELSE lines || [CASE given WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || CASE e WHEN 'R' THEN text ELSE '' END] END
         FROM (SELECT w.*, substr(w.audit, w.i, 1) AS e, CASE w.q WHEN 2 THEN 3 ELSE 2 END AS given, r.role, r.text, r.role_no
               FROM walk w LEFT JOIN r ON r.c = w.c AND r.pos = w.pos WHERE w.i <= length(w.audit))),
done AS (SELECT c, sha256(array_to_string(lines, chr(10))) AS h FROM walk WHERE i = length(audit) + 1)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM z) a LEFT JOIN sums USING (c) LEFT JOIN best USING (c) LEFT JOIN done USING (c)""",
    "op12_prefix_trie": f"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS e,
      CAST(length(coalesce(text, '')) AS BIGINT) AS points FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, e, points, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(e)) AS pos FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc('CAST(conv_id AS VARCHAR)')} % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM t), crc_t),
n AS (SELECT conv_id AS base, count(*) AS n FROM own GROUP BY 1),
r AS (SELECT c.conv_id, o.pos, o.e, o.points FROM c JOIN own o ON o.conv_id = c.base AND o.pos <= h
      UNION ALL SELECT o.conv_id, o.pos - h + least(h, coalesce(n.n, 0)), o.e, o.points
      FROM own o JOIN c USING (conv_id) LEFT JOIN n ON n.base = c.base WHERE o.pos > h),
m AS (SELECT conv_id, pos AS depth, points, list(e) OVER (PARTITION BY conv_id ORDER BY pos) AS path,
             pos = max(pos) OVER (PARTITION BY conv_id) AS ends FROM r
      UNION ALL SELECT conv_id, 0, 0, [], conv_id NOT IN (SELECT conv_id FROM r) FROM c),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(points) AS points,
          sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
          FROM m GROUP BY path, depth),
kids AS (SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k, 0) AS k, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN kids USING (path)
      LEFT JOIN nodes p ON n.depth > 0 AND p.path = list_slice(n.path, 1, n.depth - 1)),
totals AS (SELECT list_slice(path, 1, a) AS path, sum((k = 0)::INT) AS n_leaves, sum((n_convs - 1) * points) AS saved
      FROM (SELECT *, unnest(range(depth + 1)) AS a FROM full_nodes) GROUP BY 1)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, CAST(k AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM full_nodes JOIN totals USING (path)""",
    "op11_hash_tree_shards": f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size,
      CAST({_crc("coalesce(text, '')")} AS BIGINT) AS text_crc32 FROM documents, crc_t),
keys AS (SELECT DISTINCT key FROM d),
{_shard_sql(SHARDS, 'now')},
{_shard_sql(SHARDS + 1, 'later')},
p AS (SELECT d.*, n.shard, g.shard AS grown_shard FROM d JOIN now n USING (key) JOIN later g USING (key))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard
    ORDER BY md5(concat_ws(':', key, size, text_crc32, grown_shard)), doc_id NULLS FIRST) - 1 AS slot, grown_shard FROM p""",
    "op2_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {_BENCH_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_BENCH_WORDS} AS w FROM benchmark),
b2 AS (SELECT item, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
       FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b2)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rn, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
       FROM (SELECT rn, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT rn, i, dw.k, item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
hit AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + k)) AS p FROM m) GROUP BY rn),
its AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT rn, item FROM m) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rn) LEFT JOIN its USING (rn)""",
    "op5_url_filter": f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_RULE_VALUES}),
rest AS (SELECT row_number() OVER () AS rn, page_id,
                CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT rn, page_id,
             translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hits AS (SELECT rn, r_host || r_path AS rule, r_verdict,
                row_number() OVER (PARTITION BY rn ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS k
         FROM p JOIN rules ON (p.host = r_host OR ends_with(p.host, '.' || r_host)) AND starts_with(p.path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM hits WHERE k = 1) h ON p.rn = h.rn""",
}
