"""The shingle join on rows without an id and on ids with several texts, against brute force."""

from slicewright.llm import jaccard_join
from tests.llm.test_operators import near_copies, plain_join, table

FAR = " ".join(f"far{i}" for i in range(60))
NEAR = near_copies(12)
ROWS = (
    [(None, t) for _, t in NEAR[:6]] + NEAR[6:] + [(None, NEAR[7][1])]
    + [(None, FAR), (None, FAR + " more"), (None, FAR), (None, "alone"), (None, None)]
    + [(7, "seven " + FAR.replace("far", "x")), (7, NEAR[8][1]), (7, FAR.replace("far", "x") + " end"), (7, "")]
)


def test_links_and_what_stays(spark):
    docs = table(spark, ROWS)
    plain = lambda rows: sorted((tuple((x is None, x or 0) for x in r) for r in rows))
    assert plain(tuple(r) for r in jaccard_join.join(docs).collect()) == plain(plain_join(ROWS))
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.keep_first(docs).collect()]
    parts = {}
    for k, _, c, _ in plain_join([(k, t) for k, (_, t) in enumerate(ROWS)]):
        parts.setdefault(c, []).append(ROWS[k][0])
    smallest = [min((i for i in ids if i is not None), default=None) for ids in parts.values()]
    assert sorted((i for i, _ in kept), key=str) == sorted(smallest, key=str)
    assert not any(n for _, _, _, n in plain_join(kept))
