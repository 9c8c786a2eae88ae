"""Packing, decontamination, secrets, URLs, toxicity, quality and LM scores."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs_frame, remainder, with_clashes, word_soup
from trellis.llm import decontaminate, lm_score, packing, quality_pu, secrets_crf, toxicity, url_filter
from trellis.llm.common import id_remainder
from trellis.llm.queries import tokenizer_path

ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "Ünïcödé ΣΑΣ ß İ x's <|endoftext|> y"), (904, "word"), (904, "word"),
       (None, "no id here"), (905, word_soup(20000, 5))]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    rows = [(k, word_soup(30 + 7 * k, k), f"s{k % 3}" if k % 11 else None) for k in range(80)] + ODD
    got = packing.pack(with_clashes(docs_frame(spark, rows)), tokenizer_path()).toPandas()
    expect = Counter(tuple([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows)
    # pieces of a document, joined by place (ids repeat, so by content)
    seq = defaultdict(list)
    for r in got.itertuples():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
        seq[r.sequence_id].append((r.offset, r.length))
    total = sum(len(k) * v for k, v in expect.items())
    for k, parts in seq.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 4096 or (k == max(seq) and at == total % 4096)
    once = got[got.doc_id.notna() & (got.doc_id != 904)]
    whole = Counter()
    for _, g in once.groupby("doc_id"):
        g = g.sort_values("start")
        assert (g.start == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all()
        whole[tuple(np.frombuffer(b"".join(g.ids), "<u4").tolist())] += 1
    rest = [r for r in rows if r[0] is None or r[0] == 904]
    assert whole == expect - Counter(tuple([*tok.encode(r[1], add_special_tokens=False).ids, 2]) for r in rest)


@pytest.mark.parametrize("targets", [None, {"a": 1.0, "b": 1.0, "c": 2.0}])
def test_windows_hold_the_mixture(spark, targets):
    rows = [(k, word_soup(300, k), "abc"[k % 3]) for k in range(120)]
    got = packing.pack(docs_frame(spark, rows), tokenizer_path(), targets).toPandas()
    share = got.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum").fillna(0) / 4096
    goal = {s: (targets[s] / 4 if targets else got[got.source == s].length.sum() / got.length.sum()) for s in "abc"}
    full = share.iloc[: len(share) // 2]  # with targets a queue runs dry later
    for s in "abc":
        assert (full[s] - goal[s]).abs().max() <= 2.5 * packing.GRAIN / 4096


def test_schedule_of_a_rare_source():
    s = packing.Schedule(np.array([1, 10_000_000, 500]), None)
    places = []
    for q, t in enumerate([1, 10_000_000, 500]):
        a = np.arange(0, t, 1 << 20)
        n = np.minimum(1 << 20, t - a)
        doc, begin, place = s.pieces(np.full(len(a), q), a, n)
        order = np.lexsort((begin, doc))
        doc, begin, place = doc[order], begin[order], place[order]
        end = np.append(begin[1:], 0)
        last = np.append(doc[1:] != doc[:-1], True)
        end[last] = n[doc[last]]
        places += list(zip(place.tolist(), (end - begin).tolist()))
    places.sort()
    assert places[0][0] == 0 and all(p + n == q for (p, n), (q, _) in zip(places, places[1:]))


def brute_hits(docs, items, window=10):
    def words(t):
        return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = defaultdict(set)
    for i, t in items:
        ws = words(t)
        k = min(window, len(ws))
        for a in range(len(ws) - k + 1 if k else 0):
            wins[tuple(ws[a:a + k])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        ws, hit, found = words(t), set(), set()
        for k in {len(w) for w in wins}:
            for a in range(len(ws) - k + 1):
                if tuple(ws[a:a + k]) in wins:
                    hit.update(range(a, a + k))
                    found |= wins[tuple(ws[a:a + k])]
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_decontamination_equals_brute_force(spark):
    items = [(k, word_soup(25, 300 + k, 60)) for k in range(12)]
    items += [(50, items[3][1]), (51, "Tiny item"), (52, ""), (53, None), (None, word_soup(14, 7, 60)), (54, "ä b ä b ä b ä b ä b ä b")]
    docs = [(k, word_soup(150, k, 60)) for k in range(30)]
    docs += [(100 + k, word_soup(40, k) + " " + items[k % 12][1].upper()[: 60 + 11 * k] + ", " + word_soup(9, k)) for k in range(12)]
    docs += [(200, "a tiny ITEM here"), (201, "ä b " * 30), *ODD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.match(with_clashes(docs_frame(spark, docs)), with_clashes(bench)))
    assert Counter(tuple(r)[:6] for r in got.collect()) == brute_hits(docs, items)
    clean = decontaminate.clean(docs_frame(spark, docs), bench)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(
        k[0] for k in brute_hits(docs, items).elements() if not k[5])
    assert decontaminate.match(docs_frame(spark, docs), bench.where("false")).where("size(hits) > 0").count() == 0


def test_blocks_of_the_benchmark_agree(spark, monkeypatch):
    items = [(k, word_soup(25, 300 + k, 60)) for k in range(12)]
    docs = [(k, word_soup(100, k, 60) + " " + items[k][1]) for k in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    got = decontaminate.digest(decontaminate.match(docs_frame(spark, docs), bench))
    assert Counter(tuple(r)[:6] for r in got.collect()) == brute_hits(docs, items)


def test_longest_match_is_found(spark):
    bench = spark.createDataFrame([(1, word_soup(40, 1))], "item_id long, text string")
    doc = "x y " + " ".join(word_soup(40, 1).split()[5:30]) + " z"
    r = decontaminate.match(docs_frame(spark, [(1, doc)]), bench).first()
    assert r.longest == 25 and r.hits == [2, 27]


def secret_rows():
    rows = [(k, word_soup(60, k) + f' password = "{hashlib.md5(str(k).encode()).hexdigest()[:20]}" ' + word_soup(40, k))
            for k in range(30)]
    rows += [(100 + k, word_soup(50, k) + f" AKIA{hashlib.md5(str(k).encode()).hexdigest().upper()[:16]} x") for k in range(30)]
    rows += [(200 + k, word_soup(50, k) + f" call 555-0{k}, mail a{k}@b.example or 10.0.0.{k}") for k in range(30)]
    return rows + [(300, "AKIASHORT token:abc TOKEN:'abcdef secret==x password:password=longvalue1 " + "f" * 24 + "g" + "0" * 23),
                   (301, "ſecret=abcdefgh API_KEY=ABC123xyz api-key=abcdefg"), *ODD]


def test_base_spans_equal_the_contract(spark):
    rows = secret_rows()
    got = secrets_crf.report(secrets_crf.scan(with_clashes(docs_frame(spark, rows)))).collect()
    expect = Counter()
    kw = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    for d, t in ((r[0], r[1] or "") for r in rows):
        spans = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({kw})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t)
                 if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        n = Counter(k for _, k, _ in spans)
        expect[d, n[0], n[1], n[2], hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == expect
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[200 + k].spans == "" for k in range(30))  # clean documents stay clean


def test_model_finds_what_it_was_not_told(spark):
    rows = secret_rows()
    model = secrets_crf.train(docs_frame(spark, rows))
    decoder, classes = model.decoder(), secrets_crf.TokenClasses()
    text = 'some words and key "9f3b2c7d1e8a4f60b5c2" follow'  # 20 characters, no keyword in reach of the patterns
    assert any(k == 3 for _, k, _ in secrets_crf.all_spans(text, decoder, classes))


def test_pruned_viterbi_equals_the_whole_one():
    rng = np.random.default_rng(0)
    for seed in range(60):
        crf = secrets_crf.Crf(rng.normal(0, 1, (4, 3, secrets_crf.FEATURES)), rng.normal(-1, 1, (3, 3)), rng.normal(0, 1, (3, 3)))
        crf.w[:, 0] = 0
        crf.f[0] = 0
        crf.t[0, 2] = -30
        classes = rng.integers(0, 1 << secrets_crf.FEATURES, 40)
        file = np.array([1.0, 0.0, 0.3])
        d = crf.decoder()
        tags = d.tags(classes, file)
        got = [tags.get(k, 0) for k in range(40)]
        bits = secrets_crf._bits(classes)
        e = np.zeros((40, 3)) + crf.f @ file
        for o, off in enumerate(secrets_crf.OFFSETS):
            for k in range(40):
                if 0 <= k + off < 40:
                    e[k] += crf.w[o] @ bits[k + off]
        assert got == d._viterbi(e), seed


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/x?y=/es/", "https://www.example.com/en/", "http://example.com/en", "http://x.net/fr/1#a",
            "http://x.net/de/", "http://com/", "http://xcom/", "nothing", None, "", "http://", "http://example.com",
            "a://b.net/es/q://c", "http://example.com:80/en/", "http://x.net/fr/1#a", "http://a..com/", "ftp://net/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"), (None, "/", "block"), ("net", "/fr/", "allow")]
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(with_clashes(pages.withColumn("host", F.lit(1))), frame).collect()}
    for k, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host):])[0]
            host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in rules[:5]
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert got[k] == (host, path, best[1], best[2]), u
    assert url_filter.filter_urls(pages, frame.where("false")).where("verdict = 'allow'").count() == len(urls)
    assert url_filter.filter_urls(pages.where("false"), frame).count() == 0


def test_clause_grammar():
    g = toxicity.Grammar({b"scum": 2.0})
    mark = lambda t: [m for c in toxicity.clauses(t) for m in g.clause_marks(c)]
    assert mark("what scum here") == [(0, 2.0)]
    assert mark("not scum") == [(4, 2.0)]
    assert mark("he said scum") == [(3, 2.0)]  # "he" is a target, and the clause reports
    assert mark("never you scum") == [(5, 2.0)]
    assert mark("not, scum") == [(0, 2.0)]  # a clause ends at the comma
    assert mark("i will kill") == [(8, 1.0)]
    assert mark("not a b c d scum") == [(0, 2.0)]  # out of scope
    assert mark(None) == []


def labelled(spark, n, bad, good, label):
    """Documents of two kinds and labels for most of them, with nulls and repeated ids."""
    rows = [(k, bad(k) if k % 4 == 0 else good(k)) for k in range(n)]
    labels = [(k, int(k % 4 != 0) if label == "quality" else int(k % 4 == 0)) for k in range(n) if k % 7]
    labels += [(None, 1), (3, None), labels[5]]
    return rows, spark.createDataFrame(labels, f"doc_id long, {label} int")


def test_toxicity_held_out(spark):
    rows, labels = labelled(spark, 240, lambda k: word_soup(40, k) + f" {'scum trash fool'.split()[k % 3]} " + word_soup(9, k + 1),
                            lambda k: word_soup(50, k), "toxic")
    docs = docs_frame(spark, rows + ODD)
    model = toxicity.train(with_clashes(docs), labels, id_remainder(F.col("_id"), 5) != 0)
    got = {r.doc_id: r.score for r in toxicity.score(with_clashes(docs), model).collect()}
    held = [k for k in range(240) if remainder(k, 5) == 0]
    assert len(held) > 20 and all((got[k] >= 0.5) == (k % 4 == 0) for k in held)
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901] == got[902]
    flat = toxicity.train(docs, labels.where("toxic = 0"), F.lit(True))
    assert {round(r.score, 6) for r in toxicity.score(docs, flat).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), flat).count() == 0


def test_quality_held_out(spark):
    rows, labels = labelled(spark, 400, lambda k: " ".join([f"w{k}!!"] * 60), lambda k: word_soup(70, k) + ".", "quality")
    docs = docs_frame(spark, rows + ODD)
    model = quality_pu.train(with_clashes(docs), labels, id_remainder(F.col("_id"), 3) != 1)
    got = {r.doc_id: r.score for r in quality_pu.score(with_clashes(docs), model).collect()}
    held = [k for k in range(400) if remainder(k, 3) == 1]
    assert sum((got[k] >= 0.5) == (k % 4 != 0) for k in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values())
    assert set(quality_pu.keep_good(with_clashes(docs), model).columns) == set(with_clashes(docs).columns)
    assert quality_pu.train(docs, labels.where("false"), F.lit(True)) is None
    assert quality_pu.keep_good(docs, None).count() == docs.count()


def test_class_prior_from_positives_alone():
    rng = np.random.default_rng(1)
    pos = rng.normal(1.5, 1, (3000, 5))
    unl = np.concatenate([rng.normal(1.5, 1, (1800, 5)), rng.normal(-1.5, 1, (1200, 5))])
    assert abs(quality_pu.estimate_prior(pos, unl) - 0.6) < 0.06


def test_lm_counts_and_base_score(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_CHARS", 4000)
    rows = [(k, word_soup(80, k, 300)) for k in range(60)] + ODD
    train = id_remainder(F.col("doc_id"), 10) != 0
    got = lm_score.score_documents(with_clashes(docs_frame(spark, rows)), train).collect()
    learnt = Counter()
    for d, t in rows:
        if remainder(d, 10):
            learnt.update([*(t or "").encode().lower().split(), None])
    n, v = sum(learnt.values()), len(learnt)
    expect = Counter()
    for d, t in rows:
        ws = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((learnt[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        expect[d, remainder(d, 10) != 0, len(ws), sum(learnt[w] > 0 for w in ws), n, round(base, 5)] += 1
    assert Counter((r.doc_id, r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expect
    assert all(r.score < 0 for r in got)


def test_lm_table_is_normalised_and_learns():
    k = lm_score.CLASSES
    rng = np.random.default_rng(2)
    h2 = rng.integers(0, 20, 5000)
    codes = (rng.integers(0, 20, 5000) * k + h2) * k + (h2 + 1) % 20  # the next class follows from the last
    codes, n = np.unique(codes, return_counts=True)
    table = lm_score.LogBilinear().train(codes, n).log_table().astype(float)
    assert np.allclose((10 ** table).sum(2), 1.0, atol=1e-4)
    assert np.mean([table[3, h, (h + 1) % 20] for h in range(20)]) > math.log10(0.3)


def test_lm_learns_from_every_counted_trigram():
    """One context holds 3 of 10 ** 8 tokens, too few to be among a fixed number of draws."""
    k = lm_score.CLASSES
    codes = np.array([(h * k + h) * k + (h + 1) % 20 for h in range(20)] + [(99 * k + 99) * k + 98])
    n = np.array([5_000_000] * 20 + [3])
    table = lm_score.LogBilinear().train(codes, n).log_table()
    assert table[99, 99, 98] > -1.0


def test_lm_without_training_rows_or_documents(spark):
    docs = docs_frame(spark, [(1, "a b"), (2, None)])
    got = {r.doc_id: r for r in lm_score.score_documents(docs, F.lit(False)).collect()}
    assert got[1].train_tokens == 0 and got[1].n_known == 0 and got[1].base_score == 0.0
    assert lm_score.score_documents(docs.where("false"), F.lit(True)).count() == 0
