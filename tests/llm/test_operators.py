"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and columns with clashing names, against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewright.llm import components, exact_dedup, html_wrapper, jaccard_join, mixing, packing, quality_model, quality_rules, suffix_dedup, token_store, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, root int, shard int, score double"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
BASE = " ".join(f"t{i}" for i in range(60))
TEXTS = [
    (1, "Hello World of texts"), (2, "hello world OF texts"), (3, "HELLO É"), (4, "hello é"), (5, None), (6, ""), (7, "  \n\t "), (8, LONG),
    (9, BASE), (10, BASE + " more"), (11, BASE.replace("t5 ", "u5 ", 1)), (12, BASE), (12, BASE), (13, "one two"), (14, "ONE two"), (15, "a b c d e " * 9),
    (16, "x" * 250 + "some other words here " * 6 + "x" * 250), (17, "### $$$ buy &&& now %%% " * 5), (18, "a line\nanother line\na line\n\na line"), (None, "no id here at all"),
]


def table(spark, rows):
    made = [(i, t, [None, "en", "de"][k % 3], [None, "s1", "s1", "s2"][k % 4], None if t is None else len(t), "clash", k, k, 0.5) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def first(x):
    return (x[0] is None, x[0] or 0)


# ---- exact dedup ----


def test_exact_dedup(docs, empty):
    got = exact_dedup.decide(docs).collect()
    assert len(got) == len(TEXTS)
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(lower(t), []).append(i)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    kept = {}
    for r in got:
        ids = by_hash[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
    assert set(kept.values()) == {1}
    rows = exact_dedup.dedup(docs)
    assert rows.columns == docs.columns
    assert rows.count() == len(groups)
    assert exact_dedup.decide(empty).count() == exact_dedup.dedup(empty).count() == 0


# ---- quality rules ----


def test_quality_rules(docs, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.judge(docs).collect()}
    for i, t in TEXTS:
        w = words(t)
        r = got[(i, len(w))]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        twice = {g for g in set(grams) if grams.count(g) > 1} if len(grams) < 1000 else set()
        covered = {k + j for k, g in enumerate(grams) if g in twice for j in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert r["word_chars"] == sum(map(len, w))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(empty).count() == 0


# ---- shingle join ----


def plain_join(rows, size=jaccard_join.WORDS, threshold=jaccard_join.THRESHOLD):
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    link = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= threshold * len(a | b)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if label[a] != label[b] and link(sets[a], sets[b]):
                    low = min(label[a], label[b])
                    label = [low if x in (label[a], label[b]) else x for x in label]
                    changed = True
    ids = {x: min((rows[k][0] for k in range(len(rows)) if label[k] == x and rows[k][0] is not None), default=None) for x in label}
    return sorted(((rows[k][0], len(sets[k]), ids[label[k]], sum(link(sets[k], sets[j]) for j in range(len(rows)) if j != k)) for k in range(len(rows))), key=first)


def near_copies(n=40):
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    out = []
    for k in range(n):
        w = list(base)
        for at in r.choice(120, int(r.integers(0, 5)), replace=False):
            w[at] = f"e{r.integers(0, 6)}"
        out.append((100 + k, " ".join(w)))
    return out


def test_shingle_join(spark, docs, empty, monkeypatch):
    assert sorted((tuple(r) for r in jaccard_join.join(docs).collect()), key=first) == plain_join(TEXTS)
    rows = near_copies()
    assert sorted((tuple(r) for r in jaccard_join.join(table(spark, rows)).collect()), key=first) == plain_join(rows)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)  # many tiles
    assert sorted((tuple(r) for r in jaccard_join.join(table(spark, rows)).collect()), key=first) == plain_join(rows)
    assert jaccard_join.join(empty).count() == 0
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, c, _ in plain_join(TEXTS) if i == c}
    assert kept.where("doc_id = 9").count() == 1


@pytest.mark.parametrize(("size", "threshold"), [(3, 90), (2, 60)])
def test_shingle_join_of_other_sizes(spark, docs, size, threshold):
    assert sorted((tuple(r) for r in jaccard_join.join(docs, words=size, threshold=threshold).collect()), key=first) == plain_join(TEXTS, size, threshold)
    rows = near_copies()
    assert sorted((tuple(r) for r in jaccard_join.join(table(spark, rows), words=size, threshold=threshold).collect()), key=first) == plain_join(rows, size, threshold)
    with pytest.raises(ValueError, match="threshold"):
        jaccard_join.join(docs, threshold=100)


@pytest.mark.parametrize(("threshold", "gone", "new"), [(90, 0.04, 20), (80, 0.1, 10), (60, 0.2, 4)])
def test_linked_sets_share_a_list(threshold, gone, new):
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(1, 200))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.append(a[r.random(len(a)) > gone], r.integers(0, 1 << 63, int(r.integers(0, 1 + n // new))).astype(np.uint64)))
        inter = len(np.intersect1d(a, b))
        if len(b) and not np.array_equal(a, b) and 100 * inter >= threshold * (len(a) + len(b) - inter):
            x, y = jaccard_join.signatures(a, threshold), jaccard_join.signatures(b, threshold)
            both = np.intersect1d(x[0], y[0])
            assert all(len(both) >= need for _, need in (x, y))
            assert abs(jaccard_join.size_block(len(a), threshold) - jaccard_join.size_block(len(b), threshold)) <= 1
            x, y = jaccard_join.part_lists(a, threshold), jaccard_join.part_lists(b, threshold)
            both = np.intersect1d(x[0], y[0])
            for lists, own, need_own, need_next in (x, y):
                own_hits = len(np.intersect1d(lists[:own], both))
                assert own_hits >= need_own or len(both) - own_hits >= need_next


def test_components(spark):
    r = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    label = {x: x for p in pairs for x in p}
    for _ in range(80):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: y for x, y in label.items() if any(x in p and p[0] != p[1] for p in pairs)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- suffix dedup ----


def plain_cut(rows):
    seen, out = set(), []
    for i, t in sorted(dict.fromkeys(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out += [(i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] * rows.count((i, t))
    return sorted(out, key=first)


def test_suffix_dedup(spark, docs, empty):
    rows = [x for x in TEXTS if x[0] != 8] + [(30, "é" * 80 + BASE[40:300] + "tail"), (31, "zz " + BASE[20:250]), (32, "ab" * 300), (33, "q" + "ab" * 80 + "r")]
    assert sorted((tuple(r) for r in suffix_dedup.remove(table(spark, rows)).collect()), key=first) == plain_cut(rows)
    assert suffix_dedup.remove(empty).count() == 0


def test_two_stage_sorting():
    r = np.random.default_rng(2)
    for k in range(60):
        t = r.integers(97, 97 + int(r.integers(1, 4)), int(r.integers(2, 300))).astype(np.uint8)
        if k % 2:
            t = np.concatenate([t, t[: len(t) // 2], t])
        order, data = suffix_dedup.suffix_array(t), t.tobytes()
        key = [(data[i : i + 100] + bytes(100))[:100] for i in order]
        assert sorted(order.tolist()) == list(range(len(t)))
        assert key == sorted(key)
        common = suffix_dedup.common_prefixes(t, order)
        assert all(common[i] == next((m for m in range(100) if key[i][m] != key[i - 1][m]), 100) for i in range(1, len(key)))


# ---- mixing and packing ----


def test_mixing(docs, empty):
    got = mixing.mix(docs, mixing.Plan(max_epochs=2)).collect()
    sizes = {}
    for (_, t), r in zip(TEXTS, docs.collect(), strict=True):
        sizes.setdefault((r["lang"] or "", r["source"] or ""), []).append(len(words(t)))
    assert all((r["lang"], r["source"]) in sizes and r["epoch"] < 2 for r in got)
    assert mixing.mix(empty).count() == mixing.mix_documents(empty).count() == 0
    whole = mixing.mix_documents(docs, mixing.Plan(max_epochs=2))
    assert whole.columns == docs.columns
    assert whole.count() == len(got)


def test_shortage_goes_to_siblings_first(spark):
    rows = [(k, "w " * 10, "en", s) for k, s in enumerate(["a"] * 2 + ["b"] * 40)] + [(100 + k, "w " * 10, "de", "c") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plan = mixing.Plan(weights={}, budget=400, max_epochs=1, domains=1)
    n = {r["source"]: r["n"] for r in mixing.mix(docs, plan).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert n == {"a": 20, "b": 180, "c": 200}


def check_bins(rows, sizes, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r[2], []).append(r)
    for inside in bins.values():
        assert sum(r[4] for r in inside) <= capacity
        for x in ("source", "cluster"):
            values = [sizes[r[0]][x] for r in inside]
            assert len(set(values)) == len(values)


def test_best_fit():
    r = np.random.default_rng(4)
    sizes, sources, clusters = r.integers(0, 90, 200).tolist(), r.integers(0, 9, 200).tolist(), r.integers(0, 150, 200).tolist()
    placed = packing.best_fit(sizes, sources, clusters, 60)
    check_bins(placed, [{"source": s, "cluster": c} for s, c in zip(sources, clusters, strict=True)], 60)
    total = {}
    for i, _, _, _, n in placed:
        total[i] = total.get(i, 0) + n
    assert total == dict(enumerate(sizes))
    open_bins = {}  # the plain version: of all bins that fit and agree, the tightest
    for size, i in sorted(((s % 60, k) for k, s in enumerate(sizes) if s % 60 or not s), key=lambda x: (-x[0], x[1])):
        fits = [(left, b) for b, (left, inside) in open_bins.items() if left >= size and all(sources[j] != sources[i] and clusters[j] != clusters[i] for j in inside)]
        b = min(fits)[1] if fits else len(open_bins)
        left, inside = open_bins.get(b, (60, []))
        open_bins[b] = (left - size, [*inside, i])
    assert sorted(sorted(x) for _, x in open_bins.values()) == sorted(sorted(i for i, p, q, _, n in placed if q == b and n == sizes[i] % 60) for b in {q for _, _, q, _, _ in placed} if any(q == b and n == sizes[i] % 60 for i, p, q, _, n in placed))


def test_packing(docs, empty):
    got = packing.pack(docs, capacity=50, shard_rows=5).collect()
    n = {}
    for r in got:
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + r["n_tokens"]
    assert n[8] == 30_000
    assert n[5] == n[6] == 0
    assert n[12] == 120
    assert packing.pack(empty).count() == 0


# ---- models ----


def test_trees_learn_and_handle_little_data():
    r = np.random.default_rng(0)
    x = r.random((600, 4))
    y = ((x[:, 1] > 0.4) & (x[:, 2] < 0.8)).astype(float)
    model = quality_model.fit(x, y, trees=20)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    assert quality_model.fit(x[:0], y[:0]).score(x).tolist() == [1.0] * 600
    assert quality_model.fit(x[:5], np.ones(5)).score(x[:1]).tolist() == [1.0]


def test_classifiers_on_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i not in (15, 17)), int(i == 17)) for i in range(1, 19)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    for got, fold, mod in ((quality_model.classify(docs, labels).collect(), 2, 4), (toxicity.score(docs, labels).collect(), 0, 5)):
        assert len(got) == len(TEXTS)
        for r in got:
            assert 0 <= r["score"] <= 1
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % mod == fold)
    assert quality_model.classify(empty, labels).count() == toxicity.score(empty, labels).count() == 0
    assert toxicity.score(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_toxic_words_are_learnt_and_windows_cover_all():
    r = np.random.default_rng(0)
    vocabulary = [f"word{i}" for i in range(200)]
    make = lambda bad: " ".join(["nasty" if bad and k in (20, 70) else vocabulary[r.integers(200)] for k in range(90)])
    net = toxicity.fit([(make(k % 3 == 0), int(k % 3 == 0)) for k in range(300)])
    reader = toxicity.Reader(net)
    assert reader.score([make(False) + " nasty"])[0] > 0.5 > reader.score([make(False)])[0]
    _, mask, owner = toxicity.windows([np.arange(n) for n in (0, 1, 40, 41, 500)])
    assert np.bincount(owner).tolist() == [1, 1, 1, 2, 15]
    assert mask.sum() >= 582


def test_gradients():
    net = toxicity.Network(1)
    r = np.random.default_rng(1)
    e = r.standard_normal((6, toxicity.WORD_DIM + toxicity.CHAR_DIM)).astype(np.float32)
    rows, mask, y = r.integers(0, 6, (5, 3)), np.ones((5, 3), np.float32), np.array([1, 0, 1], np.float32)
    mask[3:, 1] = 0
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}

    def loss():
        z = net.run(net.gates(e), rows, mask)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    g, _ = net.gradients(e, rows, mask, y, np.ones(3, np.float32))
    for name in ("xf", "hb", "attend", "out", "cb"):
        flat, grad = net.w[name].reshape(-1), g[name].reshape(-1)
        k = int(np.abs(grad).argmax())
        flat[k] += 1e-3
        up = loss()
        flat[k] -= 2e-3
        down = loss()
        flat[k] += 1e-3
        assert abs((up - down) / 2e-3 - grad[k]) < 2e-2 * max(abs(grad[k]), 0.02)


# ---- token store ----


def test_token_store(docs, empty):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    store = token_store.write(docs, path)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in token_store.read(store).collect()), key=lambda r: r[1])
    at, wanted = 0, {}
    for i, t in TEXTS:
        wanted.setdefault(i, []).append(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    for i, start, n, crc, ids in got:
        assert start == at
        assert ids in wanted[i]
        assert (n, crc) == (len(ids) // 4, zlib.crc32(ids))
        at += n
    assert [r[0] for r in got] == [None, *sorted(i for i, _ in TEXTS if i is not None)]
    chunks = store.recipes.sparkSession.table(store.name).where("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    plainer = token_store.read(store, ids=False)
    assert sorted(tuple(r) for r in plainer.select("start", "n_tokens", "ids_crc32").collect()) == [r[1:4] for r in got]
    store.root = "0" * 64
    with pytest.raises(ValueError, match="manifest"):
        token_store.read(store)
    store.drop()
    nothing = token_store.write(empty, path)
    assert token_store.read(nothing).count() == 0
    nothing.drop()


def test_encoder_cuts_as_the_tokenizer_does(monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    encoder = token_store.Encoder(tokenizers.path("byte_bpe_50k.json"))
    texts = ["a  b", "x\ty z \n q", " lead", "tail ", "é  x", "Ġ Ġa b", "it's don't 12 3,4", "", "one\nline two", " x y", "nul\0 x", "so, so: (so) é! naïve.\nThe end.. don't, x,'s y'", "a \u0378. b ǿ; \U0001e900, \ua7da. z", "p <|endoftext|>. q"]
    wanted = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == wanted
    assert encoder.encode([]) == []
    monkeypatch.setattr(token_store, "GROUP_CHARS", 9)
    assert encoder.encode(texts) == wanted
    monkeypatch.setattr(token_store, "CACHE_WORDS", 4)  # halves go at every call
    for _ in range(3):
        assert [encoder.encode([t])[0] for t in texts] == wanted
        assert encoder.encode(texts) == wanted


# ---- html ----


def page(title, paragraphs, extra=""):
    body = "".join(f"<p>{p}" for p in paragraphs)
    return f"<html><head><title>x</title><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav><div class='sidebar'>side</div><article><h1>{title}</h1>{body}{extra}</article><div id=comments><p>nice</p></div><footer>f</footer></body></html>"


def test_html(spark, empty):
    rows = [(k, "http://h/x", page(f"T {k}", [f"one &amp; {k}", f"two <b>bold</b> {k}"][: 1 + k % 2], "<p>Share this page</p>")) for k in range(8)]
    rows += [(20, None, None), (21, "http://h/y", ""), (22, "http://other/", "<div><p>just  a\n page"), (23, "http://h/z", "plain text &lt; here"), (24, "http://h/x", page("A", ["q"], "<form>f</form><aside>s</aside>"))]
    rows += [(25, "http://deep/", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_wrapper.main_text(docs).collect()}
    for k in range(8):
        assert got[k]["text"] == "\n".join([f"T {k}", f"one & {k}", f"two bold {k}"][: 2 + k % 2]) + ("" if "Share" not in got[k]["text"] else "\nShare this page")
        assert got[k]["n_chars"] == len(got[k]["text"])
    assert got[20]["text"] == got[21]["text"] == ""
    assert got[22]["text"] == "just a page"
    assert got[23]["text"] == "plain text < here"
    assert got[24]["text"] == "A\nq"
    assert got[25]["text"] == "deep"
    assert html_wrapper.main_text(docs.limit(0)).count() == 0


def test_wrapper_expression():
    trees = [html_wrapper.generalise(html_wrapper.parse(page(t, p))) for t, p in (("a", ["x", "y"]), ("b", ["z"]))]
    text = html_wrapper.expression(html_wrapper.merge(*trees))
    assert "(<p>#PCDATA</p>)+" in text
    assert "<h1>#PCDATA</h1>" in text


# ---- pipeline ----


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(k, f"clean {k} " + " ".join(f"w{k}x{j}" for j in range(40)) + ".") for k in range(40)] + [(50, "CLEAN 3 " + " ".join(f"w3x{j}" for j in range(40)) + "."), (51, "### &&& " * 40)]
    table(spark, rows).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    bad = [(1000 + k, 1, 0) for k in range(3)]
    spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(51, 0, 0)] + bad, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert 3 not in ids
    assert len(ids) >= 38
    assert len({r["bin_id"] for r in got}) == len(got)
