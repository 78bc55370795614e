"""Small facts about operators that have no SQL form."""

import datetime as dt
import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.operators import chunking as C
from corpusmill.operators import graph as G
from corpusmill.operators import retrieval as R
from corpusmill.operators.components import connected_components
from corpusmill.plans import QUERIES
from corpusmill.sources.files import scan_folders
from corpusmill.streaming.keyed import Breaker, TokenBucket, batch_audit


def slow_runs(lengths, joint, limit):
    out, a, total = [], 0, 0
    for i, n in enumerate(lengths):
        if i > a and total + joint + n > limit:
            out.append((a, i))
            a, total = i, n
        else:
            total += n + (joint if i > a else 0)
    return out + ([(a, len(lengths))] if lengths else [])


@settings(deadline=None)
@given(st.lists(st.integers(0, 40)), st.integers(0, 3), st.integers(1, 60))
def test_greedy_runs(lengths, joint, limit):
    assert C.greedy_runs(lengths, joint, limit) == slow_runs(lengths, joint, limit)


@settings(deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(3, 30))
def test_recursive_splits_keep_all_letters_and_fit(text, size):
    parts = C.recursive_splits(text, ("\n\n", "\n", " ", ""), size)
    assert "".join(parts).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
    assert all(len(p) <= size for p in parts)


def plain_recursive(text, separators, size):
    """Split by the first separator the text has; a piece of ``size`` or more is split by those after it, runs of smaller ones are joined one by one."""
    cut = next((s for s in separators if s == "" or s in text), separators[-1])
    later = separators[separators.index(cut) + 1 :] if cut and cut in text else ()
    out, room = [], 0
    for piece in text.split(cut) if cut else text:
        if len(piece) >= size:
            out += plain_recursive(piece, later, size) if later else [piece]
            room = 0
        elif room and len(out[-1]) + len(piece) <= size:
            out[-1] += piece
        else:
            out.append(piece)
            room = 1
    return out


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(2, 30))
def test_recursive_splits_against_a_plain_loop(text, size):
    assert C.recursive_splits(text, ("\n\n", "\n", " ", ""), size) == plain_recursive(text, ("\n\n", "\n", " ", ""), size)


def plain_semantic(sentences, size, overlap, short=20):
    """Sentences of a text, joined by one space each; the short join the next; a chunk opens with the last ones of the chunk before that fit the overlap."""
    joined = []
    for s in sentences:
        if joined and len(joined[-1]) < short:
            joined[-1] += " " + s
        else:
            joined.append(s)
    chunks, now = [], []
    for s in joined:
        if now and len(" ".join([*now, s])) > size:
            chunks.append(now)
            kept, room = [], overlap
            for x in reversed(now):
                if overlap <= 0 or len(x) > room:
                    break
                kept.insert(0, x)
                room -= len(x) + 1
            now = [*kept, s]
        else:
            now = [*now, s]
    return [(" ".join(c), len(c)) for c in chunks + ([now] if now else [])]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from(["One two three four five six.", "Is it?", "No!", "Some sentences are a good deal longer than the others are here.", "Ok."]), min_size=1, max_size=25), st.integers(30, 120), st.integers(0, 60))
def test_semantic_chunks_against_a_plain_loop(sentences, size, overlap):
    assert [(c, n) for c, _, _, n in C.semantic_chunks(" ".join(sentences), size, overlap)] == plain_semantic(sentences, size, overlap)


def events_of(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_type") != "error").alias("ok")).collect()
    return sorted((str(r["user_id"]), r["us"] / 1e6, r["event_id"], r["ok"]) for r in rows)


@pytest.mark.parametrize("name", ["n1_throttle_audit", "n1_throttle_audit_batch"])
def test_throttle_audit_against_a_plain_loop(spark, sf, name):
    want, left, seen = {}, {}, {}
    for key, at, event, _ in events_of(spark, sf):
        tokens = min(3.0, left.get(key, 3.0) + (at - seen.get(key, at)) * 0.0001)
        want[event] = "allowed" if tokens >= 1 else "throttled"
        left[key], seen[key] = tokens - (tokens >= 1), at
    got = {r["event_id"]: r["verdict"] for r in QUERIES[name](spark, sf).collect()}
    assert got == want and set(want.values()) == {"allowed", "throttled"}


@pytest.mark.parametrize("name", ["n2_breaker_timeline", "n2_breaker_timeline_batch"])
def test_breaker_timeline_against_a_plain_loop(spark, sf, name):
    want, keys = {}, {}
    for key, at, event, ok in events_of(spark, sf):
        k = keys.setdefault(key, {"since": None, "failures": []})
        if k["since"] is not None and at - k["since"] < 7200:
            want[event] = "rejected"
            continue
        probe = k["since"] is not None
        k["failures"] = [] if ok else [f for f in k["failures"] if at - f < 86400] + [at]
        trips = not ok and (probe or len(k["failures"]) >= 2)
        k["since"] = at if trips else None
        k["failures"] = [] if trips else k["failures"]
        want[event] = "open" if trips else "closed"
    got = {r["event_id"]: r["verdict"] for r in QUERIES[name](spark, sf).collect()}
    assert got == want


def plain_hard_split(text, most):
    """Words gathered one by one; each counts one more, but the first of a later part."""
    parts, now, n = [], [], 0
    for w in text.split():
        if now and n + len(w) + 1 > most:
            parts.append(" ".join(now))
            now, n = [w], len(w)
        else:
            now.append(w)
            n += len(w) + 1
    return parts + ([" ".join(now)] if now else [])


@settings(deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=9), min_size=1, max_size=30), st.integers(3, 25))
def test_late_spans_cut_long_spans_at_words(words, size):
    text = " ".join(words)
    got = [s for s, *_ in C.late_spans(text, size)]
    assert got == (plain_hard_split(text, size) if len(text) > size else [text])


def test_late_spans_of_one_example():
    assert [s for s, *_ in C.late_spans("aaa bbb ccc ddd", 7)] == ["aaa", "bbb ccc", "ddd"]


def plain_leaves(text, size):
    """Pieces joined one by one; a part begins at a piece that is not empty."""
    if len(text) <= size:
        return [text] if text.strip() else []
    cut = next((s for s in ("\n\n", "\n", ". ", " ") if s in text), None)
    if cut is None:
        return [text[i : i + size] for i in range(0, len(text), size)]
    parts, now = [], ""
    for piece in text.split(cut):
        wider = f"{now}{cut}{piece}" if now else piece
        if len(wider) > size:
            parts += [now] if now else []
            wider = piece
        now = wider
    return parts + ([now] if now else [])


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="ab. \n", max_size=120), st.integers(1, 30))
def test_raptor_leaves_against_a_plain_loop(text, size):
    assert [c for c, *_ in C.raptor_leaves(text, size)] == [p.strip() for p in plain_leaves(text, size)]


def kmeans_clusters(vectors: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Cluster of each row, from the first k rows; ties go to the lowest cluster, an empty one keeps its centre."""
    n = len(vectors)
    if k >= n:
        return np.arange(n)
    centres, own = vectors[:k].astype("f8"), np.full(n, -1)
    for _ in range(rounds):
        new = ((vectors[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        if (new == own).all():
            break
        own = new
        for c in range(k):
            if (own == c).any():
                centres[c] = vectors[own == c].mean(0)
    return own


def test_raptor_levels_by_vectors(spark):
    rows = [(1, i, 0, f"chunk {i}", [float(i % 2 * 10), float(i)]) for i in range(12)] + [(2, i, 0, f"few {i}", [0.0, 0.0]) for i in range(3)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, tree_level int, content string, vec array<double>")
    got = {(r["doc_id"], r["chunk_index"]): r for r in C.raptor_parents(chunks, "doc_id", vec_col="vec").collect()}
    own = kmeans_clusters(np.array([r[4] for r in rows[:12]]), 2).tolist()
    order = list(dict.fromkeys(own))
    for nth, c in enumerate(order):
        assert got[(1, nth)]["content"] == "\n\n---\n\n".join(f"chunk {i}" for i in range(12) if own[i] == c)
    assert got[(2, 0)]["children"] == 3 and len(got) == len(order) + 1
    tree = C.raptor_tree(chunks.drop("vec"), "doc_id", embed=lambda d: d.withColumn("vec", F.array(F.length("content").cast("double"), F.col("chunk_index").cast("double"))))
    assert {(r["doc_id"], r["tree_level"]) for r in tree.collect()} >= {(1, 0), (1, 1), (2, 0), (2, 1)}


@settings(deadline=None)
@given(st.lists(st.sampled_from(["One two three four five six.", "Is it?", "No!", "Längere Sätze gehen auch."]), min_size=1, max_size=12))
def test_semantic_chunks_cover_sentences(sentences):
    chunks = C.semantic_chunks(" ".join(sentences), 80, 30)
    assert chunks[0][1] == 0 and chunks[-1][2] == len(" ".join(sentences))
    assert all(c[3] >= 1 for c in chunks)


def test_raptor_leaves_and_kmeans():
    assert [c for c, *_ in C.raptor_leaves("aa. bb. cc", 6)] == ["aa. bb", "cc"]
    assert C.raptor_leaves("x" * 25, 10) == [("x" * 10, 0, 10), ("x" * 10, 10, 20), ("x" * 5, 20, 25)]
    assert list(kmeans_clusters(np.array([[0.0, 0], [0, 1], [9, 9], [9, 8]]), 2)) in ([0, 1, 1, 1], [0, 0, 1, 1])
    assert list(kmeans_clusters(np.zeros((2, 2)), 5)) == [0, 1]


def test_raptor_tree_and_clusters(spark):
    docs = spark.createDataFrame([(1, "w " * 700), (2, "short")], "doc_id long, text string")
    tree = C.raptor_tree(C.raptor(docs, "doc_id", "text", size=50), "doc_id").groupBy("doc_id", "tree_level").count().collect()
    levels = {(r[0], r[1]): r[2] for r in tree}
    assert levels[(2, 0)] == 1 and (2, 1) not in levels
    assert levels[(1, 1)] == -(-levels[(1, 0)] // 5)
    vec = spark.createDataFrame([(1, i, [float(i // 5), 0.0]) for i in range(10)], "doc_id long, chunk_index int, v array<double>")
    assert C.cluster_chunks(vec, "doc_id", "v").count() == 10


def plain_components(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def test_communities_of_the_whole_table(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect()
    want = plain_components([(f"s{r[0]}", f"p{r[1]}") for r in li])
    got = {r["key"]: r["community"] for r in QUERIES["i13_communities"](spark, sf).collect()}
    assert {k: got[k] for k in want} == want and all(got[k] == k for k in set(got) - set(want))


def test_label_communities_and_modularity(spark):
    import xxhash

    edges = [(a, b, 1.0) for g in (0, 10, 20) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(4, 10, 1.0), (14, 20, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    labels = {r["node"]: r["label"] for r in G.label_communities(df).collect()}
    around = {}
    for a, b, w in edges:
        around.setdefault(a, []).append((b, w))
        around.setdefault(b, []).append((a, w))
    want = {n: n for n in around}
    parity = {n: xxhash.xxh64_intdigest(int(n).to_bytes(8, "little"), 42) % 2 for n in around}
    for i in range(10):
        new = {}
        for n, near in around.items():
            heard = {}
            for v, w in near:
                heard[want[v]] = heard.get(want[v], 0) + w
            most = max(heard.values())
            new[n] = min(x for x, w in heard.items() if w == most) if parity[n] == i % 2 else want[n]
        moved, want = new != want, new
        if not moved and i:
            break
    assert labels == want
    m = sum(w for *_, w in edges)
    for gamma in (1.0, 0.5, 2.0):
        inside = sum(w for a, b, w in edges if want[a] == want[b]) / m
        degree = {}
        for a, b, w in edges:
            for x in (a, b):
                degree[want[x]] = degree.get(want[x], 0) + w
        q = inside - gamma * sum(d * d for d in degree.values()) / (4 * m * m)
        got = G.modularity(df, spark.createDataFrame(list(want.items()), "node long, label long"), gamma).first()["q"]
        assert abs(got - q) < 1e-12


def test_unknown_strategy(spark):
    docs = spark.createDataFrame([(1, "some words " * 300)], "doc_id long, text string")
    assert C.chunk(docs, "nonsense", "doc_id", "text").count() == C.chunk(docs, "recursive", "doc_id", "text").count() > 1
    with pytest.raises(ValueError):
        C.chunk(docs, "nonsense", "doc_id", "text", strict=True)


def test_fusion_examples(spark):
    lists = spark.createDataFrame([(0, "vector", 0, "1", 1, 0.9), (0, "vector", 0, "2", 2, 0.8), (0, "keyword", 1, "2", 1, 0.95), (0, "keyword", 1, "3", 2, 0.7)], "query_id int, source string, ordinal int, chunk_id string, rank int, score double")
    assert R.rrf(lists).orderBy("rank").first()["chunk_id"] == "2"
    assert {r["chunk_id"]: round(r["score"], 6) for r in R.max_fusion(lists).collect()}["2"] == 0.95
    assert {r["chunk_id"]: round(r["score"], 6) for r in R.sum_fusion(lists).collect()}["2"] == 1.75


def test_exact_top_k_edges(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, q array<float>")
    got = [(r["chunk_id"], round(r["score"], 6)) for r in R.exact_top_k(chunks, q, 6).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 0.0), (4, 0.0), (5, 0.0), (6, 0.0), (3, -1.0)]
    assert R.exact_top_k(chunks, q.limit(0), 3).count() == 0


def test_ann_recall(spark, sf):
    exact, near = QUERIES["f2_exact_top_k"](spark, sf).collect(), QUERIES["f3_ann_top_k"](spark, sf).collect()
    a, b = {(r["query_id"], r["chunk_id"]) for r in exact}, {(r["query_id"], r["chunk_id"]) for r in near}
    assert len(a & b) >= 0.9 * len(a)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(edges=st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components_equal_union_find(spark, edges):
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in up}


def test_audits(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("k", i, t0 + dt.timedelta(seconds=s), ok) for i, (s, ok) in enumerate([(0, True), (0, True), (0, True), (1, True)])]
    events = spark.createDataFrame(rows, "key string, event_id long, ts timestamp, ok boolean")
    got = [r["verdict"] for r in batch_audit(events, TokenBucket(1, 2)).orderBy("event_id").collect()]
    assert got == ["allowed", "allowed", "throttled", "allowed"]
    rows = [("k", i, t0 + dt.timedelta(seconds=s), ok) for i, (s, ok) in enumerate([(0, False), (1, False), (2, True), (70, False), (71, True), (200, True)])]
    events = spark.createDataFrame(rows, "key string, event_id long, ts timestamp, ok boolean")
    got = [r["verdict"] for r in batch_audit(events, Breaker(2, 30, 60)).orderBy("event_id").collect()]
    assert got == ["closed", "open", "rejected", "open", "rejected", "closed"]


@pytest.mark.parametrize("name", ["n1_throttle_audit", "n2_breaker_timeline"])
def test_streams_equal_their_batch_twins(spark, sf, name):
    key = lambda df: sorted((r["event_id"], r["verdict"]) for r in df.collect())
    assert key(QUERIES[name](spark, sf)) == key(QUERIES[f"{name}_batch"](spark, sf))


def test_shuffled_files_over_five_batches(spark, tmp_path):
    from corpusmill.streaming.keyed import audit_to_end

    rng, t0 = np.random.default_rng(8), dt.datetime(2024, 1, 1)
    rows = [(f"k{i % 3}", i, t0 + dt.timedelta(seconds=float(i // 4 * 7)), bool(rng.random() < 0.5)) for i in range(160)]
    schema = "key string, event_id long, ts timestamp, ok boolean"
    events = spark.createDataFrame(rows, schema)
    order = rng.permutation(len(rows))
    for n, part in enumerate(np.array_split(order, 5)):
        spark.createDataFrame([rows[i] for i in part] + [(None, 999, t0, True)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for name, machine in (("bucket", TokenBucket(0.05, 2)), ("breaker", Breaker(2, 30, 60))):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        audit_to_end(stream, machine, *(str(tmp_path / f"{name}-{x}") for x in ("out", "checkpoint", "closing")), late="1 day")
        got = [tuple(r) for r in spark.read.parquet(str(tmp_path / f"{name}-out")).orderBy("event_id").collect()]
        assert got == [tuple(r) for r in batch_audit(events, machine).orderBy("event_id").collect()] and len({r[3] for r in got}) > 1
        assert len({f.name for f in (tmp_path / f"{name}-checkpoint" / "offsets").iterdir() if f.name.isdigit()}) >= 6


@pytest.mark.parametrize("splitters", [2, 7, 256])
def test_exact_quantiles(spark, splitters):
    from corpusmill.operators.stats import exact_quantiles

    rng = np.random.default_rng(9)
    of = {"hot": rng.normal(size=3000).round(3).tolist(), "same": [4.0] * 500, "skew": [1.0] * 900 + rng.exponential(size=100).tolist(), "one": [7.5], "two": [1.0, 2.0], None: [3.0, 1.0, 9.0]}
    rows = [(k, v) for k, vs in of.items() for v in vs] + [("hot", None), ("none", None)]
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r["k"]: r for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", shares, splitters).collect()}
    assert set(got) == {*of, "none"} and got["none"]["p50"] is None
    for k, vs in of.items():
        assert [got[k][n] for n in shares] == pytest.approx(np.quantile(vs, list(shares.values())).tolist(), abs=1e-12)


def test_keyword_top_k_equals_the_whole_product(spark):
    rng = np.random.default_rng(10)
    words = [f"w{i}" for i in range(300)]
    weight = 1 / np.arange(1, 301)
    text = lambda n: " ".join(rng.choice(words, n, p=weight / weight.sum()))
    chunks = spark.createDataFrame([(i, text(int(rng.integers(1, 60)))) for i in range(800)], "chunk_id long, content string").cache()
    queries = spark.createDataFrame([(i, text(int(rng.integers(1, 25)))) for i in range(40)] + [(90, ""), (91, "absent"), (92, "w0"), (93, "w299 w298")], "query_id long, query string").cache()
    wanted = R.query_terms(queries)
    want = R.top_k(R.bm25(chunks, wanted).withColumn("score", F.round("score", 9)), 5)
    for options in ({}, {"rare": 0.1, "tail": 0.9}, {"rare": 1.0, "tail": 0.2}):
        got = R.bm25_top_k(chunks, wanted, 5, **options)
        assert sorted(map(tuple, got.select("query_id", "chunk_id", "rank", "score").collect())) == sorted(map(tuple, want.select("query_id", "chunk_id", "rank", "score").collect()))


def test_hybrid_with_a_failing_source(spark):
    found = spark.createDataFrame([(0, "a", 0.9), (0, "b", 0.8)], "query_id int, chunk_id string, score double")
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, content string")
    rows = R.hybrid_retrieval({"vector": found, "keyword": None, "graph": found.filter("score > 0.85")}, chunks).orderBy("rank").collect()
    assert [(r["chunk_id"], r["content"], r["found_by"]) for r in rows] == [("a", "x", {"vector": 2, "graph": 1}), ("b", "y", {"vector": 2, "graph": 1})]


def test_scan_folders(spark, tmp_path):
    for name in ("a.txt", "b.pdf", "c.xyz", "sub/d.md", "node_modules/e.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    scan = lambda deep: sorted(r["path"].rsplit("/", 1)[1] for r in scan_folders(spark, [(str(tmp_path), deep)], ("node_modules",)).collect())
    assert scan(True) == ["a.txt", "b.pdf", "d.md"]
    assert scan(False) == ["a.txt", "b.pdf"]


def test_embedder_errors_become_rows(spark):
    from corpusmill.operators.embedding import embed

    def make():
        def fn(texts):
            raise RuntimeError("down")

        return fn

    rows = embed(spark.createDataFrame([(1, "a")], "id long, t string"), "id", "t", make, "m").collect()
    assert rows[0]["embedding"] is None and "down" in rows[0]["error"] and rows[0]["dimensions"] is None


def test_hashed_terms_are_unit(spark):
    from corpusmill.operators.embedding import hashed_terms

    v = spark.createDataFrame([("alpha beta",), ("",)], "t string").select(hashed_terms(F.col("t"), 16).alias("v")).collect()
    assert abs(sum(x * x for x in v[0]["v"]) - 1) < 1e-9 and set(v[1]["v"]) == {0.0}


def test_file_metadata_equal_what_the_system_says(spark, tmp_path):
    from corpusmill.sources.files import file_metadata, scan_folders

    sizes = {"a.TXT": 0, "deep/b.tar.md": 1023, "deep/er/c.md": 1024, "d e.pdf": 5 * 1024 * 1024 // 2}
    for name, size in sizes.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    got = {r["file_name"]: r for r in file_metadata(scan_folders(spark, [(str(tmp_path), True)])).collect()}
    assert len(got) == len(sizes)
    for name in sizes:
        path = tmp_path / name
        r = got[path.name]
        assert r["file_size_bytes"] == os.stat(path).st_size
        assert r["file_type"] == path.suffix.lower()
        assert r["folder"].endswith(str(path.parent)) and r["path"].endswith(str(path))
        assert r["file_size"] == {0: "0.00 B", 1023: "1023.00 B", 1024: "1.00 KB", 2621440: "2.50 MB"}[sizes[name]]
