"""Suffix dedup on repeated ids: a document is an id with its text."""

import hashlib

from slicewright.llm import suffix_dedup

T, U, V = (" ".join(f"{c}{i * i}" for i in range(150)) for c in "tuv")


def plain(rows):
    """Documents ascend by id, nulls first, and by the digest of their texts."""
    seen, cut = set(), {}
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    for i, t in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, digest(x[1]))):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        cut[i, t] = (i, len(b), sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return sorted((cut[x] for x in rows), key=str)


def check(spark, rows):
    got = suffix_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got.collect()), key=str) == plain(rows)


def test_a_repeated_row_keeps_its_unique_text(spark):
    check(spark, [(1, T), (1, T), (2, U + T[50:400]), (2, U + T[50:400]), (3, V), (3, V), (3, V)])


def test_ids_with_several_texts_and_null_ids(spark):
    check(spark, [(1, T), (2, T), (2, U), (4, V + U[30:300]), (4, V)])
    check(spark, [(None, T), (None, U), (None, V + T[100:500]), (None, V), (None, U), (5, U), (5, "x" + V[3:400])])
