"""The packing query's own output: capacity, conflicts, whole pieces, and ids beyond what a double holds."""

from slicewright.llm import packing

WIDE = 1 << 60


def test_bins(spark):
    rows = [(WIDE + k, " ".join(["w"] * (k % 23)) + f" text {k // 3}", f"s{k % 7}" if k % 11 else None) for k in range(300)] + [(None, "no id", "s1"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(docs, capacity=40, shard_rows=60).collect()
    assert {r["doc_id"] for r in got} == {i for i, _, _ in rows}
    known = {i: ((t or "").lower(), s) for i, t, s in rows if i is not None}
    size, bins = {}, {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append(r)
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["n_tokens"]
    assert all(size[i] == len(t.split()) for i, (t, _) in known.items())
    for inside in bins.values():
        spans = sorted((r["bin_start"], r["n_tokens"]) for r in inside)
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert spans[-1][0] + spans[-1][1] <= 40
        for k in (0, 1):
            values = [known[r["doc_id"]][k] for r in inside if r["doc_id"] is not None]
            assert len(set(values)) == len(values)
