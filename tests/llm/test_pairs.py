"""Near-duplicate components, repeated strings and fingerprints against brute force."""

import hashlib
import random
from collections import Counter

from tests.llm.helpers import docs_frame, with_clashes, word_soup
from trellis.llm import fingerprint, minhash_join, repeats


def edited(text: str, share: float, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"e{rng.randrange(9999)}" if rng.random() < share else w for w in text.split())


def near_rows():
    base = [word_soup(120, k) for k in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, edited(base[k % 6], 0.01 * (k % 5), 50 + k)) for k in range(40)]
    rows += [(200, base[0]), (201, base[0]), (None, base[1]), (202, None), (203, ""), (204, "one two"), (205, "ONE two"),
             (206, "one"), (202, None), (207, " \t\n"), (208, "één twee drie vier"), (209, word_soup(6000, 77)),
             (210, word_soup(6000, 77) + " tail")]
    return rows


def brute_components(rows, size, percent):
    def shingles(t):
        ws = (t or "").encode().lower().split()
        w = min(size, len(ws))
        return frozenset(tuple(ws[i:i + w]) for i in range(len(ws) - w + 1)) if ws else frozenset()
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return Counter((d, len(s), least.get(find(k)), d == least.get(find(k)))
                   for k, ((d, _), s) in enumerate(zip(rows, sets)))


def test_components_equal_brute_force(spark):
    rows = near_rows()
    got = minhash_join.near_duplicates(with_clashes(docs_frame(spark, rows)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect())
    assert got == brute_components(rows, 3, 85)


def test_a_large_family_is_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_join, "LEAF", 8)
    base = word_soup(200, 1)
    rows = [(k, edited(base, 0.012, k)) for k in range(60)] + [(100 + k, word_soup(50, 900 + k)) for k in range(10)]
    got = minhash_join.near_duplicates(docs_frame(spark, rows))
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect())
    assert got == brute_components(rows, 3, 85)


def test_one_document_of_each_group_stays(spark):
    rows = near_rows()
    kept = minhash_join.keep_one(docs_frame(spark, rows), 5, 80)
    ids = Counter(r.doc_id for r in kept.collect())
    expect = Counter(d for d, n, _, k in brute_components(rows, 5, 80).elements() if k or n == 0)
    assert ids == expect
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_tables(spark):
    empty = docs_frame(spark, [(1, "x")]).where("false")
    assert minhash_join.near_duplicates(empty).count() == 0
    assert minhash_join.keep_one(empty).count() == 0
    assert repeats.remove_repeats(empty).count() == 0
    assert fingerprint.fingerprint_documents(empty).count() == 0


def brute_removed(texts, length=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        mask = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                mask[i:i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(r, mask) if not m)
        spans = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
        out.append((len(r), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark):
    a, b, c = (word_soup(400, k) for k in (1, 2, 3))
    texts = [a, a, b, "x " + b[300:1100] + " y", c[:399], c[:400], "pre " + c[:400], c[1:420] + a[50:449],
             a[77:600] + a[77:600], "z" * 900, "ab" * 500, "q" + "ab" * 450, "ü" * 450 + b[100:900], None, "", "short",
             "Thhaen " * 200, "x" + "Thhaen " * 90, word_soup(9000, 8), "k" + word_soup(9000, 8)[5000:9000]]
    rows = list(enumerate(texts)) + [(7, word_soup(300, 55)), (None, word_soup(300, 55))]
    expect = brute_removed([t for _, t in rows])
    got = repeats.remove_repeats(with_clashes(docs_frame(spark, rows)))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())
    assert got == Counter((d, *e) for (d, _), e in zip(rows, expect))


def test_repeats_of_edited_copies(spark):
    rng = random.Random(4)
    base = word_soup(900, 11)
    rows = []
    for k in range(25):
        t = list(base)
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = rng.choice("XYZ")
        lo = rng.randrange(500)
        rows.append((k, word_soup(20, k) + "".join(t)[lo:lo + rng.randrange(300, 4000)]))
    expect = brute_removed([t for _, t in rows])
    got = sorted(repeats.remove_repeats(docs_frame(spark, rows)).collect())
    assert [tuple(r)[1:5] for r in got] == expect


def generalised_jaccard(a: str, b: str) -> float:
    def bag(t):
        ws = ["", *(t or "").lower().split()]
        return Counter(zip(ws, ws[1:]))
    x, y = bag(a), bag(b)
    return sum((x & y).values()) / sum((x | y).values())


def test_fingerprints(spark):
    rows = [(k, word_soup(60 + 10 * k, k // 2, 90)) for k in range(40)]
    rows += [(None, "null id"), (900, None), (901, ""), (902, "abc"), (903, "abc"), (903, "abc"), (904, word_soup(5000, 3))]
    got = fingerprint.fingerprint_documents(with_clashes(docs_frame(spark, rows)), samples=64).collect()
    assert len(got) == len(rows)
    order = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    text_of = {(i if ok else None): t for ok, i, t in order}
    ids = [i if ok else None for ok, i, _ in order]
    nxt = {d: text_of[ids[(k + 1) % len(ids)]] for k, d in enumerate(ids)}
    error = []
    for r in got:
        t, q = text_of[r.doc_id], len(text_of[r.doc_id]) // 4
        e = t[:len(t) - q] + nxt[r.doc_id][:q]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        if t.split() and e.split():
            error.append(r.near_edited - generalised_jaccard(t, e))
        if t.split() and nxt[r.doc_id].split():
            error.append(r.near_next - generalised_jaccard(t, nxt[r.doc_id]))
        if t == e:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1.0
    assert abs(sum(error) / len(error)) < 0.02
    assert (sum(x * x for x in error) / len(error)) ** 0.5 < 0.08
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[902] == same[903] and same[900] == same[901] == ""
