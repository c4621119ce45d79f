"""Formulas by hand, invariants of what SQL cannot express, edge cases."""

import math

import pytest
from pyspark.sql import Row, functions as F

from strata.functions import scores as S, text as T
from strata.operators import chunking as C, context as X, graph as G, lexical as L, memory as M, parsing as P, vectors as V
from strata.config import Model
from strata.plans import chain, ingest, rag, tools
from strata.sources import connectors, store


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_terms_and_estimates(spark):
    assert one(spark, T.terms(F.lit("Ab1 中文x, é"))) == ["ab1", "中", "文", "x", "é"]
    assert L.query_terms("Ab1 中文x, é") == ["ab1", "中", "文", "x", "é"]
    assert one(spark, T.chunk_tokens(F.lit("中a b"))) == C.estimate("中a b") == 3
    assert one(spark, T.chunk_tokens(F.lit(""))) == 1
    assert one(spark, T.context_tokens(F.lit("中文abcd"))) == 5
    assert one(spark, T.context_tokens(F.lit("\U0002f800"))) == 2
    assert one(spark, T.tidy_markdown(F.lit("\n a\n\n\n\nb "))) == "a\n\nb"
    assert one(spark, T.split_tags(F.lit(" , "))) == ["Concept"]
    assert one(spark, T.clean_variant(F.lit("2) 、which?"))) == "which?"


def test_scores(spark):
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert one(spark, S.memory_recency(ts, "2024-01-01 10:00:00")) == pytest.approx(math.exp(-0.5))
    assert one(spark, S.memory_recency(ts, "2023-01-01 10:00:00")) == 1
    assert one(spark, S.context_recency(F.lit(None).cast("timestamp"), "2024-01-01 00:00:00")) == 0.1
    assert one(spark, S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(math.sqrt(0.5))
    assert one(spark, S.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0)))) == 0
    assert one(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert one(spark, S.jaccard(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0


def test_bm25_of_three(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, "d"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in L.bm25(docs, "a A").collect()}
    idf, avg = math.log((4 - 2 + 0.5) / 2.5 + 1), 6 / 4
    for d, tf, n in ((1, 1, 2), (2, 2, 3)):
        assert got[d] == pytest.approx(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg)))
    assert set(got) == {1, 2}
    assert L.bm25(docs, "...").count() == 0
    assert L.tfidf_match(docs, "zz").count() == 0


def test_store(spark):
    df = spark.createDataFrame([(1, "Ab"), (2, "c")], "id long, name string")
    assert store.Query([store.Condition("id", "IN", [])]).run(df).count() == 0
    assert store.Query([store.Condition("name", "LIKE", "a%")]).run(df).count() == 1
    assert store.Query((), [("id", True)], 0, 1).run(df).collect() == [Row(id=1, name="Ab")]
    with pytest.raises(ValueError):
        store.Condition("x; drop", "=", 1).column()
    with pytest.raises(ValueError):
        V.payload_filter("id", "~", 1)


def test_table_directory(spark, tmp_path):
    t = store.Tables(spark, f"file://{tmp_path}")
    t.create("a", "id long")
    t.create("a", "id long")
    assert t.read("a").count() == 0
    t.write("a", spark.range(3), "append")
    assert t.read("a").count() == 3


def test_graph_merge(spark):
    edges = spark.createDataFrame([(1, 2, "x"), (2, 9, "x"), (1, 2, "bad type")], "source_id long, target_id long, relation_type string")
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    assert G.merge_edges(edges.limit(0), edges, nodes).collect() == [Row(source_id=1, target_id=2, relation_type="x")]
    assert {r.id: r.score for r in G.overlap(edges.limit(2), nodes).collect()} == {1: 1.0, 2: 1.0}
    assert {r.id: r.score for r in G.overlap(edges.limit(2), nodes, True).collect()} == {1: 1.0, 2: 0.5}


def test_greedy_skips_and_goes_on(spark):
    df = spark.createDataFrame([("g", "a", 0.9, 6), ("g", "b", 0.8, 5), ("g", "c", 0.7, 4)], "g string, k string, score double, token_count long")
    assert [r.k for r in X.greedy_fit(df, "g", 10, "k").orderBy("rank").collect()] == ["a", "c"]


def test_semantic_add_keeps_first(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0], 0.2), (2, 0, [1.0, 0.01], 0.9), (3, 0, [0.0, 1.0], 0.1)], "id long, b int, embedding array<double>, importance double")
    assert {r.id: (r.kept_id, r.importance) for r in M.semantic_add(df, "b").collect()} == {1: (1, 0.9), 2: (1, 0.9), 3: (3, 0.1)}


MD = "# A\nintro words here\n\n## B\n" + "one two three four. " * 30 + "\n\n## C\n" + "\n".join(f"line {i} of many" for i in range(40)) + "\n\ntail"


@pytest.mark.parametrize("text", [MD, "word " * 500, "中文。" * 300, "a\r\n\r\nb", "### only", "para one\n\n" * 50])
@pytest.mark.parametrize("overlap", [0, 5])
def test_chunks(spark, text, overlap):
    got = one(spark, C.chunk_recursive(F.lit(text), 30, overlap))
    clean = text.replace("\r\n", "\n")
    assert got or clean.strip().startswith("###")
    assert [c["index"] for c in got] == list(range(len(got)))
    if not overlap:
        assert all(clean[c["start_pos"] : c["end_pos"]].strip() in c["content"] for c in got)
    assert one(spark, C.chunk_recursive(F.lit("  \n"), 30, 0)) == []


def test_chunks_follow_the_least_heading_level(spark):
    body = "word " * 30
    text = f"## A\n{body}\n### A1\n{body}\n## B\n{body}"
    got = one(spark, C.chunk_recursive(F.lit(text), 120, 0))
    assert [c["content"].split("\n\n")[0] for c in got][-1] == "## B" and all(c["content"].startswith("## ") for c in got)
    assert any(c["content"].startswith("## A\n### A1\n\n") for c in one(spark, C.chunk_recursive(F.lit(text), 80, 0)))
    whole = one(spark, C.chunk_recursive(F.lit("# T\nx\n## U\ny"), 100, 0))
    assert [c["content"] for c in whole] == ["# T\nx\n## U\ny"]


def test_query_terms_are_index_terms(spark):
    from strata.functions.text import terms
    from strata.operators.lexical import query_terms

    text = "A b_c \u4e00\u4e8cx \U0002ceb0\U0002f800 \uac00\uac01 9"
    assert query_terms(text) == one(spark, terms(F.lit(text)))


def test_sentences():
    text = "One. Two is 3.5 long! 三。四；End"
    spans = C.sentence_spans(text)
    assert [text[a:b] for a, b in spans] == ["One.", " Two is 3.5 long! 三。", "四；", "End"]
    assert all(a < b for a, b in spans)


def test_parsers():
    assert P.parse_csv('a,b\n1\n"x\ny",2,3') == "| a | b |  |\n|---|---|---|\n| 1 |  |  |\n| x<br>y | 2 | 3 |"
    assert P.parse_json('{"b": {"c": 1}, "a": true, "l": []}') == "- **a**: true\n\n## b\n\n- **c**: 1\n- **l**: (empty)"
    assert P.tidy(P.parse_json('{"a": [1.0, null, {"k": [2, [3]]}], "e": {}}')) == "## a\n\n1. 1\n2. <nil>\n\n### k\n\n1. 2\n2. 1. 3\n- **e**: (empty)"
    assert P.parse_json("{}") == "" and P.parse_json("3") == "3"
    assert "- **x**: 1" in P.parse_toml("x = 1")
    assert "- **x**: 1" in P.parse_yaml("x: 1")
    xml = P.parse_xml('<r><n k="v">t</n><i><a>1</a><b>2</b></i><i><a>3</a><b>4</b></i></r>')
    assert "- **n (k=v)**: t" in xml and "| 3 | 4 |" in xml
    html = P.tidy(P.parse_html("<head><title>x</title></head><h2>T</h2><p>a <b>b</b></p><ol><li>1</li><li>2</li></ol><table><tr><th>h</th></tr><tr><td>d</td></tr></table><pre>x\n y</pre><blockquote>q</blockquote><img src='s' alt='t'>"))
    assert "## T" in html and "1. 1\n2. 2" in html and "| h |" in html and "> q" in html and "![t](s)" in html and "title" not in html


def test_parse_errors(spark):
    rows = [("a.txt", "txt", b"ok"), ("b.exe", "exe", b"x"), ("c.json", "json", b"{"), ("d.md", "md", b""), ("e.txt", "txt", b"\xff\xfe"), ("f", "", b"fine"), ("g.txt", "txt", None)]
    files = spark.createDataFrame([(a, b, None if c is None else bytearray(c)) for a, b, c in rows], "name string, ext string, content binary")
    got = {r.name: r.parse_error for r in P.parse_documents(files).collect()}
    assert got == {"a.txt": None, "b.exe": P.UNSUPPORTED, "c.json": P.FAILED, "d.md": P.EMPTY, "e.txt": P.FAILED, "f": None, "g.txt": P.EMPTY}
    docs, chunks = ingest.ingest(files.union(files.limit(1).withColumn("name", F.lit("z.txt"))))
    assert sorted(r.status for r in docs.collect()).count("duplicate") == 1
    assert chunks.count() == 2 and len(chunks.first()["vector"]) == 64


def test_chain_checks(spark):
    r = chain.Registry()
    r.register(chain.Tool("n", lambda n: spark.range(n), (chain.Parameter("n", "integer", True),)))
    assert chain.Chain(r, [chain.Step("a", "n", {"n": "$input.k"})]).run(k=3.0).count() == 3
    with pytest.raises(ValueError):
        chain.Chain(r, [chain.Step("a", "n", {"n": "$steps.b"})])
    with pytest.raises(ValueError):
        chain.Chain(r, [chain.Step("a", "n", {"n": 1}, True), chain.Step("b", "n", {"n": "$steps.a"}, True)])
    with pytest.raises(ValueError):
        r.get("n").check({"n": "x"})
    assert r.get("n").schema()["function"]["parameters"]["required"] == ["n"]
    with pytest.raises(ValueError):
        connectors.build("vector", "none")
    assert connectors.expand_queries("q", ["1. a", "q", " "]) == ["q", "a"]


def test_stream_over_batches(spark, tmp_path):
    from strata.streaming.working import buffer

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "session_id string, id long, created_at timestamp"
    src, out = str(tmp_path / "src"), []
    for lo in (0, 5):
        spark.range(lo, lo + 5).selectExpr("'s' AS session_id", "id", "timestamp_seconds(id) AS created_at").coalesce(1).write.mode("append").parquet(src)
        q = buffer(spark.readStream.schema(schema).parquet(src), 3).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, i: out.append(sorted((r.id, r.evicted) for r in df.collect()))).trigger(availableNow=True).start()
        q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert [i for i, _ in [x for x in out if x][-1]] == [7, 8, 9]


def test_semantic_near_duplicate_searches_the_whole_collection(spark, tmp_path, monkeypatch):
    import numpy as np

    from strata import queries as Q

    monkeypatch.setattr(M, "ADDED", 7)
    monkeypatch.setattr(M, "COMPARED", 5)
    rng = np.random.RandomState(3)
    v = rng.normal(size=(90, 16))
    v[70:80] = v[3:13] + 0.01 * rng.normal(size=(10, 16))  # far apart in id
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    every, kept, want = np.concatenate([v, v + 0.01]), [], {}
    for i, x in enumerate(every):
        sim = [x @ every[k] / np.linalg.norm(x) / np.linalg.norm(every[k]) for k in kept]
        want[i] = kept[int(np.argmax(sim))] if sim and max(sim) > 0.9 else i
        kept += [i] * (want[i] == i)
    weight = {k: max(i % 11 / 10 for i in want if want[i] == k) for k in kept}
    assert [want[i] for i in range(70, 80)] == list(range(3, 13))
    got = {r.id: (r.kept_id, r.importance) for r in Q.semantic_near_duplicate(spark, str(tmp_path)).collect()}
    assert got == {i: (k, weight[k]) for i, k in want.items()}


def test_tables_are_replaced_and_changed(spark, tmp_path):
    tables = store.Tables(spark, str(tmp_path))
    tables.write("a", spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string"))
    tables.replace("a", store.delete(tables.read("a"), spark.createDataFrame([(1,)], "id long"), "id"))
    assert tables.read("a").collect() == [Row(id=2, v="y")]
    tables.execute(f"CREATE OR REPLACE TEMPORARY VIEW executed AS SELECT id + 1 AS id FROM parquet.`{tables.path('a')}`")
    assert spark.table("executed").collect() == [Row(id=3)]
    with pytest.raises(ValueError):
        tables.replace("../a", spark.range(1))


def test_collection_holds_its_width(spark, tmp_path):
    tables = store.Tables(spark, str(tmp_path))
    c = store.Collection(tables, "c", 2, "label int")
    kind = "id string, vector array<double>, label int"
    c.upsert(spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 2)], kind))
    c.upsert(spark.createDataFrame([("b", [0.0, 2.0], 3)], kind))
    for bad in ([1.0], None):
        with pytest.raises(Exception, match="has not 2 numbers"):
            c.upsert(spark.createDataFrame([("z", bad, 1)], kind))
    again = store.Collection(tables, "c", 2)
    assert sorted(map(tuple, again.points().collect())) == [("a", [1.0, 0.0], 1), ("b", [0.0, 2.0], 3)]
    with pytest.raises(ValueError):
        store.Collection(tables, "c", 3)
    again.delete(spark.createDataFrame([("a",)], "id string"))
    assert [r.id for r in V.vector_search(again.points(), [0.0, 1.0], 5, column="vector", key="id").collect()] == ["b"]


def test_derived_is_made_after_changes_only(spark):
    made = []
    d = store.Derived(lambda df: made.append(1) or df.filter("id > 1"), spark.range(3))
    assert d.get().count() == 1 and d.get() is d.get() and len(made) == 1
    d.change(spark.range(5))
    assert d.get().count() == 3 and len(made) == 2


def test_retries():
    calls = []

    def fails(message, times):
        def call(batch):
            calls.append(message)
            if len(calls) <= times:
                raise RuntimeError(message)
            return batch

        return call

    assert connectors.retried(fails("status 429", 2), [1], wait=0) == [1] and len(calls) == 3
    calls.clear()
    with pytest.raises(RuntimeError, match="after 3 attempts"):
        connectors.retried(fails("status 500", 9), [1], wait=0)
    assert len(calls) == 3
    calls.clear()
    with pytest.raises(RuntimeError, match="status 401"):
        connectors.retried(fails("status 401", 9), [1], wait=0)
    assert len(calls) == 1
    assert connectors.by_index([{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}], 2) == [[1], [2]]
    with pytest.raises(ValueError):
        connectors.by_index([{"index": 1, "embedding": [2]}], 2)


def test_batched_embedding_sends_small_batches(spark):
    embed = connectors.batched(lambda texts: [[len(texts), len(t)] for t in texts], 32)
    out = spark.createDataFrame([("ab",)] * 40 + [(None,)], "t string").coalesce(1).select(embed(F.col("t")).alias("v")).collect()
    assert [r.v for r in out] == [[32.0, 2.0]] * 32 + [[9.0, 2.0]] * 8 + [[9.0, 0.0]]


def test_query_vectors():
    got = rag.query_vectors("q", lambda t: [t], lambda q: ["1. a", "", "q"], lambda told, q: " passage\n")
    assert got == {0: ["q"], 1: ["a"], 2: ["passage"]}
    with pytest.raises(ValueError):
        rag.query_vectors("q", lambda t: [t], passage=lambda told, q: " ")
    with pytest.raises(ValueError):
        rag.query_vectors("q", lambda t: [t], lambda q: ["q"])


def test_item_codecs(spark):
    rows = spark.createDataFrame([(None, None, "c", None, "x", "task", "today")], "id string, session_id string, content string, summary string, importance string, event_type string, created_at string")
    e = M.rows_as_episodes(rows)
    assert tuple(e.first()) == ("", "", "c", "", "task", 0.0, None)
    e = e.withColumn("metadata", F.expr("map('summary', 'old', 'k', 'v')")).withColumn("relations", F.array(F.struct(F.lit("b").alias("target_id"), F.lit("next").alias("relation_type"))))
    assert M.episodes_as_items(e).first().metadata == {"summary": "", "event_type": "task", "k": "v", "relations": '[{"target_id":"b","relation_type":"next"}]'}
    n = M.nodes_as_semantics(spark.createDataFrame([("a", [], {"importance": "0.5"})], "id string, tags array<string>, properties map<string,string>"))
    i = M.semantics_as_items(n).first()
    assert (i.content, i.importance, i.metadata) == ("", 0.5, {"summary": ""})


def test_sessions(spark):
    s = M.Sessions()
    with pytest.raises(KeyError):
        s.resolve()
    s.add("a")
    s.add("b")
    assert s.resolve() == "a" and s.resolve("b") == "b"
    for bad in ("", "a"):
        with pytest.raises(ValueError):
            s.add(bad)
    s.remove("a")
    with pytest.raises(KeyError):
        s.resolve()
    s.use("b")
    assert s.of(spark.createDataFrame([("a",), ("b",)], "session_id string")).collect() == [Row(session_id="b")]
    with pytest.raises(KeyError):
        s.use("a")


def test_memory_packets(spark):
    items = spark.createDataFrame([("a", {"score": "0.5"}), ("b", {"score": ""}), ("c", None)], "content string, metadata map<string,string>")
    items = items.selectExpr("*", "timestamp'2024-01-01' AS created_at", "0.25D AS importance", "'semantic' AS type")
    assert [r.relevance for r in X.memory_packets(items).orderBy("content").collect()] == [0.5, 0.25, 0.25]


def test_note_actions(spark):
    kind = "id string, title string, type string, tags array<string>, created_at timestamp, updated_at timestamp, content string"
    notes = spark.createDataFrame([("n", "One", "general", ["x"], None, None, "first")], kind)
    tool = tools.note_tool(notes)
    run = lambda **a: tool.run(**tool.check(a))
    assert run(action="create", title="t", content="c").count() == 2
    assert run(action="update", note_id="n", title="Two").first().title == "Two"
    assert run(action="read", note_id="n").first().content == "first"
    assert run(action="delete", note_id="n").count() == 0
    assert run(action="list").count() == run(action="search", query="ONE").count() == run(action="summary").count() == 1
    with pytest.raises(Exception, match="not found"):
        run(action="read", note_id="m").collect()
    with pytest.raises(ValueError, match="unknown action: burn"):
        run(action="burn")
    memory = tools.memory_tool(lambda content, importance: (content, importance), lambda query, limit: (query, limit))
    assert memory.run(**memory.check({"action": "add", "content": "x"})) == ("x", 0.0)
    assert memory.run(**memory.check({"action": "search", "query": "x"})) == ("x", 10)
    with pytest.raises(ValueError, match="query is required"):
        memory.run(**memory.check({"action": "search"}))


def test_settings_fall_back_to_the_environment(monkeypatch):
    monkeypatch.setenv("MODEL_ID", "m")
    monkeypatch.setenv("MODEL_API_KEY", "secret")
    got = Model(api_key="own").from_environment()
    assert (got.model_id, got.api_key, got.base_url) == ("m", "own", "") and "own" not in repr(got)
