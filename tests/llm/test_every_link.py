"""All links of each document, in a family of more than two."""

from tests.llm.helpers import docs_frame, word_soup
from tests.llm.test_pairs import brute_components, near_rows
from trellis.llm import minhash_join


def shingles(text):
    ws = (text or "").encode().lower().split()
    w = min(3, len(ws))
    return frozenset(tuple(ws[i:i + w]) for i in range(len(ws) - w + 1)) if ws else frozenset()


def test_links_equal_brute_force(spark):
    base = word_soup(300, 5)
    rows = [(900, base + " a"), (901, base + " b"), (902, base + " c"), (903, word_soup(90, 6)),
            *[r for r in near_rows() if r[0] not in (None, 202)]]
    sets = {d: shingles(t) for d, t in rows}
    got = minhash_join.near_duplicates(docs_frame(spark, rows), every_link=True).collect()
    links = {r.doc_id: r.n_links for r in got}
    assert [links[k] for k in (900, 901, 902, 903)] == [2, 2, 2, 0]
    assert links == {d: sum(d != o and bool(s) and 100 * len(s & t) >= 85 * len(s | t) for o, t in sets.items())
                     for d, s in sets.items()}
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == set(brute_components(rows, 3, 85))
