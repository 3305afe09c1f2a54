"""Core operators on small fixtures: brute-force comparisons, edge cases, and the reference semantics."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestream.functions import frontmatter as fm
from lodestream.operators import chunking, compaction, drift, extraction, graph, ingest, nested, ordered, provider, reconcile, records, retrieval
from lodestream.session import table
from lodestream.sources import files, sinks
from lodestream.streaming import ingest as stream_ingest


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_event_time_notations(spark):
    same = ["2024-09-02T06:32:51.030-05:00", "2024-09-02T11:32:51.030Z", "2024-09-02 11:32:51.030000+00:00", "1725276771030", " 1725276771030 "]
    df = spark.createDataFrame([(x,) for x in same], "t string").select(F.unix_millis(records.event_time(F.col("t"))).alias("m"))
    assert {r.m for r in df.collect()} == {1725276771030}
    bad = spark.createDataFrame([(None,), ("",), ("soon",)], "t string").select(records.event_time(F.col("t")).alias("m"))
    assert all(r.m is None for r in bad.collect())


def test_holding_takes_the_version_loaded_last(transcript):
    day = dt.datetime(2024, 9, 3)
    df = transcript([{"uuid": "a", "msg_content": '"old"'}, {"uuid": "a", "msg_content": '"new"', "loaded_at": day}, {"uuid": "a", "msg_content": '"tie"', "loaded_at": day}, {"uuid": None}])
    assert [r.msg_content for r in records.holding(df).collect()] == ['"tie"']


def test_prefix_sums_match_a_plain_scan(spark):
    r = random.Random(1)
    data = [("hot" if r.random() < 0.6 else r.choice(["a", None]), i // 10, i, r.choice([None, 1, 5])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, b int, o int, v int")
    got = {(x.k, x.o): x.s for x in ordered.prefix_sums(df, ["k"], F.col("b"), [F.col("o")], {"s": F.col("v")}).collect()}
    sums = {}
    for k, _, o, v in data:
        sums[k] = sums.get(k, 0) + (v or 0)
        assert got[k, o] == sums[k]


def brute_objects(doc, path="", parent=""):
    out = []
    items = doc.items() if isinstance(doc, dict) else enumerate(doc) if isinstance(doc, list) else ()
    for k, v in items:
        p = f"{path}.{k}" if path else str(k)
        here = parent
        if isinstance(v, dict) and isinstance(doc, list):
            out.append((p, parent))
            here = p
        out += brute_objects(v, p, here)
    return out


def test_nested_labels_and_parents_match_recursion(transcript):
    r, docs = random.Random(3), []

    def make(d):
        k = r.random()
        if d == 0 or k < 0.2:
            return r.choice([1, "x", None, True, 2.5])
        return [make(d - 1) for _ in range(r.randint(0, 4))] if k < 0.6 else {f"k{i}": make(d - 1) for i in range(r.randint(0, 3))}

    for _ in range(200):
        doc = make(5)
        nodes = nested.label(doc)
        assert [n[0] for n in nodes] == list(range(len(nodes))) and sorted(n[1] for n in nodes) == list(range(len(nodes)))
        docs.append(doc)
    got = {(r.uuid, r.obj_path, r.parent_path) for r in nested.objects(transcript([{"msg_content": json.dumps(d)} for d in docs])).collect()}
    assert got == {(f"u{i:03d}", p, q) for i, d in enumerate(docs) for p, q in brute_objects(d)}


def test_nested_objects_edges(transcript):
    use = json.dumps([{"type": "tool_use", "id": "t1", "name": "x", "input": {"items": [{"a": 1}]}}])
    res = json.dumps([{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "y"}]}])
    df = transcript(
        [
            {"uuid": "c", "msg_content": use}, {"uuid": "r", "msg_content": res}, {"uuid": "other", "session_id": "s2", "msg_content": res}, {"uuid": "cut", "msg_content": res[:20]}, {"uuid": "nil"},
            {"uuid": "held", "msg_content": res}, {"uuid": "held", "msg_content": '"a string now"', "loaded_at": dt.datetime(2025, 1, 1)}, {"uuid": "none", "session_id": None, "msg_content": res},
        ]
    ).withColumn("kind", F.lit("clash")).withColumn("pre", F.lit(1))
    got = rows(nested.objects(df))
    assert got == sorted(
        [("c", "0", "", ""), ("c", "0.input.items.0", "0", ""), ("r", "0", "", "c"), ("r", "0.content.0", "0", ""), ("other", "0", "", ""), ("other", "0.content.0", "0", ""), ("none", "0", "", ""), ("none", "0.content.0", "0", "")]
    )
    assert nested.objects(df.limit(0)).count() == 0
    deep = "[" * 30_000 + "]" * 30_000
    assert nested.objects(transcript([{"msg_content": deep}])).count() == 0
    nodes = nested.shred(df.where("uuid = 'r'"))
    linked = nested.contain(nodes.where("kind = 'object'"), nodes.where("kind = 'string'"))
    assert {r.ancestor_path for r in linked.collect()} == {"0", "0.content.0"}
    assert rows(nested.typed_nodes(df, "text").select("uuid", "obj_path", "parent_pre", "parent_path", "fields").where("uuid = 'r'")) == [("r", "0.content.0", 1, "0", '{"type": "text", "text": "y"}')]
    assert rows(nested.typed_nodes(df, None).select("uuid", "obj_path", "parent_path", "fields")) == [("c", "0.input.items.0", "0", '{"a": 1}')]
    assert rows(nested.typed_nodes(df, "tool_result").select("uuid", "parent_pre")) == [("none", None), ("other", None), ("r", None)]


def manifest_lines(spark, files_):
    data = [(f, "h", i, n, line if isinstance(line, str) else json.dumps(line)) for i, (f, ls) in enumerate(files_) for n, line in enumerate(ls)]
    return spark.createDataFrame(data, "file_name string, host string, file_seq int, line_no int, raw_line string")


def test_drift_changes(spark):
    df = manifest_lines(
        spark,
        [
            ("f0", [{"session_id": "a", "cwd": "/x", "thread_id": "t"}]),
            ("f1", [{"session_id": "a", "workingDir": ["x"], "thread_id": None}, '{"cut', "[]", None or "null"]),
            ("f2", [{"session_id": "a", "cwd": "/x", "thread": {"id": 7}, "git_branch": {"label": "main", "dirty": True}}]),
            ("f3", [{"session_id": "a", "cwd": "/x", "threadId": 7, "git": {"branch": "main"}, "session": {"start": 1725272247000}}]),
        ],
    )
    seen = drift.ingest(df)
    got = rows(drift.changes(seen))
    assert got == sorted(
        [
            ("f1", "cwd", "renamed"), ("f1", "cwd", "retyped"), ("f1", "thread_id", "removed"), ("f2", "cwd", "renamed"), ("f2", "cwd", "retyped"), ("f2", "thread_id", "added"), ("f2", "git_branch", "added"),
            ("f3", "thread_id", "renamed"), ("f3", "git_branch", "renamed"), ("f3", "git_branch", "retyped"), ("f3", "session_started_at", "added"),
        ],
        key=repr,
    )
    full = {r.file_name: r for r in drift.replay(seen).collect()}
    assert full["f1"].cwd == "/x" and full["f2"].git_branch == "main" and full["f2"].thread_id == "7" and full["f3"].session_started_at == "2024-09-02T10:17:27Z"
    assert full["f2"].rescued == {"git_branch": '{"dirty":true}'} and full["f1"].rescued == {}
    assert drift.changes(drift.ingest(df.limit(0))).count() == 0 and drift.replay(drift.ingest(df.limit(0))).count() == 0


def test_drift_of_names_never_seen_before(spark):
    a, b = {"session_id": "a", "cwd": "/home/x/one", "git_branch": "main"}, {"session_id": "b", "cwd": "/home/x/two", "git_branch": "dev"}
    df = manifest_lines(
        spark,
        [
            ("f0", [a, b]),
            ("f1", [{"session_id": "a", "zz": ["home", "x", "one"], "head_ref": {"dirty": False, "v": "main"}, "log_dir": 3}, {"session_id": "b", "zz": ["home", "x", "two"], "head_ref": {"dirty": False, "v": "dev"}}]),
            ("f2", [{"session_id": "a", "start_dir": "/home/x/one", "branch_of_work": 4}]), ("f3", [a | {"log_dir": "/tmp", "base_branch": "trunk"}, b | {"log_dir": "/tmp", "base_branch": "trunk"}]),
        ],
    ).withColumn("rescued", F.lit("clash"))
    seen = drift.ingest(df)
    assert rows(drift.approve(drift.propose(seen)).where("path NOT IN ('start_dir', 'branch_of_work')")) == [("cwd", "zz"), ("git_branch", "head_ref")]  # what stands beside the field is another one
    got = rows(drift.changes(seen).where("field_name IN ('cwd', 'git_branch')"))
    assert {x for x in got if x[0] == "f1"} == {("f1", f, k) for f in ("cwd", "git_branch") for k in ("renamed", "retyped")} and ("f2", "git_branch", "retyped") in got
    table = {(r.file_name, r.line_no): r for r in drift.replay(seen).collect()}
    one = min(k for k in table if k[0] == "f1")
    assert table[one].cwd == "/home/x/one" and table[one].git_branch == "main" and table[one].rescued == {"head_ref": '{"dirty":false}', "log_dir": "3"}
    none = spark.createDataFrame([], "field_name string, path string")
    assert rows(drift.changes(seen, none).where("file_name = 'f1' AND field_name = 'cwd'")) == [("f1", "cwd", "removed")]  # what a reviewer does not approve stays rescued


def test_chunk_plan_examples(transcript):
    turns = [{"rec_type": "user", "msg_content": "x" * 59_999} for _ in range(12)]
    plan = rows(chunking.chunk_plan(transcript(turns), 250_000))
    assert [(p[1], p[5]) for p in plan] == [(1, 240_000), (2, 240_000), (3, 240_000)]
    one = rows(chunking.chunk_plan(transcript([{"rec_type": "assistant", "msg_role": "assistant", "msg_content": "x" * 400_000}]), 100_000))
    assert [(p[1], p[2], p[5]) for p in one] == [(1, 1, 400_001)]
    assert chunking.chunk_plan(transcript([{"session_id": None}])).count() == 0


def test_chunk_plan_without_groups_equals_the_fold(transcript):
    r = random.Random(11)
    made = []
    for session, n, big in (("a", 160, 90), ("b", 40, 4_000), ("c", 3, 10), ("d", 1, 5_000), ("e", 90, 1)):
        made += [{"session_id": session, "rec_type": r.choice(["user", "assistant"]), "msg_content": "x" * r.choice([0, 1, big, r.randrange(big)])} for _ in range(n)]
    for soft, bound in ((400, 0), (7_000, 30)):
        folded = rows(chunking.chunk_plan(transcript(made), soft))
        assert folded == rows(chunking.chunk_plan(transcript(made), soft, fold_turns=bound))


def test_size_buckets_are_strict(spark):
    df = spark.createDataFrame([(None,), (9_999,), (10_000,), (250_000,), (250_001,), (1_000_000_001,)], "n long")
    assert [r.b for r in df.select(ingest.size_bucket(F.col("n")).alias("b")).collect()] == ["unknown", "short", "whole", "whole", "chunk", "skipped-large"]


def test_cutoff_admits_the_day(spark):
    df = spark.createDataFrame([("2026-04-27T23:59:59Z",), ("2026-04-28T00:00:00Z",), ("",), (None,)], "t string")
    assert [r.a for r in df.select(ingest.admitted(F.col("t")).alias("a")).collect()] == [False, True, True, True]


def test_components_against_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    nodes = spark.createDataFrame([(i,) for i in range(142)], "id long")
    e = spark.createDataFrame([*edges, (3, 3), edges[0]], "src long, dst long")
    parent = list(range(142))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert rows(graph.components(nodes, e)) == sorted(((i, find(i)) for i in range(142)), key=repr)
    assert rows(graph.components(nodes.limit(2), e.limit(0))) == [(0, 0), (1, 1)]


def test_thread_word_null_makes_no_group(spark):
    df = spark.createDataFrame([(1, "t"), (2, "null"), (3, "null"), (4, "t"), (5, None)], "n long, thread string")
    assert rows(graph.stars(df, "thread", "n")) == [(1, 4)]


def test_similar_texts_against_brute_force(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(60)]
        texts.append(base)
        if r.random() < 0.6:
            near = list(base)
            near[r.randrange(60)] = "changed"
            texts.append(near)
    texts += [["a"] * 3, ["b"] * 80, ["b"] * 90]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    sh = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = sorted((i, j) for i in range(len(sh)) for j in range(i + 1, len(sh)) if sh[i] and sh[j] and len(sh[i] & sh[j]) / len(sh[i] | sh[j]) >= 0.8)
    assert sorted((x.src, x.dst) for x in retrieval.similar(df).collect()) == want


def test_frontmatter(spark):
    text = "---\nid: a\ntopics: [x, 'y', ]\nthread_id: null\nid: b\n---\n\n\nbody\n---\nmore"
    df = spark.createDataFrame([(1, text), (2, "no"), (3, "---\nid: z"), (4, None), (5, "")], "n int, t string")
    got = {r.n: r for r in df.select("n", fm.pairs(F.col("t")).alias("kv"), fm.body(F.col("t")).alias("body")).collect()}
    assert got[1].kv["id"] == "b" and got[1].body == "body\n---\nmore" and got[2].kv is None and got[3].kv is None and got[3].body == "---\nid: z" and got[4].body is None
    one = df.where("n = 1").select(fm.items(fm.pairs(F.col("t"))["topics"]).alias("i"), fm.scalar(fm.pairs(F.col("t"))["thread_id"]).alias("s"), fm.rewrite(F.col("t"), "new", F.lit("1")).alias("r")).first()
    assert one.i == ["x", "y"] and one.s is None and "new: 1\n---\n\nbody" in one.r


def test_proposals(spark):
    good = {"cluster_id": "c1", "action": "duplicate", "primary": "a", "others": ["b"], "rationale": "r"}
    lines = [json.dumps(good), json.dumps(good | {"action": "merge"}), json.dumps({k: v for k, v in good.items() if k != "others"}), "narration", "{cut", ""]
    got = reconcile.parse_proposals(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [r.is_valid for r in got] == [True, False, False]


def test_judge_and_merge(spark):
    m = spark.createDataFrame([(1, 1, "t", "en", "s2"), (1, 2, "t", "de", "s1"), (3, 3, "t", "en", "x"), (3, 4, "u", "de", "x"), (5, 5, "v", None, None)], "cluster long, id long, text string, label string, origin string")
    p = reconcile.judge(m)
    assert {r.cluster: (r.action, r.primary_id) for r in p.collect()} == {1: ("duplicate", 1), 3: ("contradiction", 4), 5: ("unrelated", 5)}
    assert rows(reconcile.merged(p, m)) == [(1, 1, 2, "de|en", "s2|s1")]
    assert rows(reconcile.retired(p, m).select("id", "superseded_by")) == [(2, 1), (3, 4)]


def test_provider_outcomes(spark):
    def fake(prompt):
        return {"ok": (0, "fine", ""), "limit": (1, "", "HTTP 429"), "silent": (2, "", ""), "bad": (1, "", "no such file")}.get(prompt, (0, "empty", ""))

    df = spark.createDataFrame([(x, x) for x in ("ok", "limit", "silent", "bad")] + [("nil", None)], "id string, prompt string")
    got = {r.id: (r.outcome, r.text) for r in provider.complete(df, fake, 2, 0.0).collect()}
    assert got == {"ok": ("ok", "fine"), "limit": ("quota", None), "silent": ("quota", None), "bad": ("fatal", None), "nil": ("ok", "empty")}


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "root" / "-Users-x-src-proj"
    (p / "s1" / "subagents").mkdir(parents=True)
    (p / "s1.jsonl").write_text('{"type":"user"}\n\nbroken\n')
    (p / "s1" / "subagents" / "agent-7.jsonl").write_text("{}\n")
    (p / "s1" / "subagents" / "agent-7.meta.json").write_text('{"agentType":"qa"}')
    found = {r.session_id: r for r in files.sessions(spark, str(tmp_path / "root")).collect()}
    assert found["s1"].project_hash == found["agent-7"].project_hash == "-Users-x-src-proj" and found["agent-7"].parent_session == "s1"
    lines = files.records(spark, str(p / "s1.jsonl")).collect()
    assert [(r.line_no, r.rec is None) for r in lines] == [(0, False), (2, True)]
    assert [r.agent for r in ingest.subagent_meta(files.subagent_meta(spark, str(tmp_path / "root")).withColumn("parent_session_id", F.lit(None).cast("string"))).collect()] == ["qa"]
    assert files.manifest(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "m.jsonl").write_text('{"session_id":"a"}\n{broken\n')
    with pytest.raises(Exception):
        files.manifest(spark, str(tmp_path / "m.jsonl")).collect()
    root = tmp_path / "snap"
    root.mkdir()
    sinks.publish(spark.createDataFrame([("a", "bronze", None), ("b", "bronze", "x")], "session_id string, status string, error string"), str(root))
    up = spark.createDataFrame([("a", "silver")], "session_id string, status string")
    sinks.upsert(up, str(root), "session_id", dry_run=True)
    assert {r.status for r in sinks.current(spark, str(root)).collect()} == {"bronze"}
    sinks.upsert(up, str(root), "session_id")
    assert {r.session_id: r.status for r in sinks.current(spark, str(root)).collect()} == {"a": "silver", "b": "bronze"}
    with pytest.raises(KeyError):
        sinks.upsert(spark.createDataFrame([("z", "gold")], "session_id string, status string"), str(root), "session_id")
    docs = spark.createDataFrame([("d", 2, "two\n"), ("d", 1, "one"), ("d", 3, "three\n\n"), ("d", 4, "four")], "silver_path string, part_index int, section string")
    assert sinks.silver_documents(docs).first().text == "one\n\ntwo\n\nthree\n\nfour"


def test_stream_ingest_is_idempotent(spark, transcript, tmp_path):
    src, man = str(tmp_path / "t"), str(tmp_path / "m")
    transcript([{"msg_content": '"x"'}, {"session_id": "s2"}]).write.parquet(src)
    stream_ingest.run(spark, src, man, str(tmp_path / "c1"))
    stream_ingest.run(spark, src, man, str(tmp_path / "c1"))
    stream_ingest.run(spark, src, man, str(tmp_path / "c2"))
    assert sorted(r.session_id for r in spark.read.parquet(man).collect()) == ["s", "s2"]


def test_predecessor(spark):
    df = spark.createDataFrame([("a_part_01", 1, "silver"), ("a_part_02", 2, "bronze"), ("a_part_04", 4, "bronze"), ("w", None, "bronze")], "session_id string, part_index int, status string")
    assert {r.session_id: r.ready for r in compaction.predecessor_ready(df).collect()} == {"a_part_01": True, "a_part_02": True, "a_part_04": False, "w": True}


def test_vector_topk_empty_and_zero(spark, small):
    v = table(spark, small, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    assert retrieval.cosine_topk(v, v.limit(0)).count() == 0


def test_vector_topk_in_blocks_against_brute_force(spark):
    r = random.Random(5)
    data = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(90, None), (91, [0.0] * 4)]
    df = spark.createDataFrame(data, "id long, vec array<float>")
    got = {(x.query_id, x.rank): (x.id, x.score) for x in retrieval.cosine_topk(df, df.where("id % 10 = 0"), 3, 0.5, block=7).collect()}
    vs = {i: v for i, v in data if v and any(v)}
    import numpy as np

    v32 = {i: np.array(v, dtype=np.float32).astype(float) for i, v in vs.items()}
    want = {}
    for q in range(0, 60, 10):
        s = sorted((-round(float(v32[q] @ v / np.linalg.norm(v32[q]) / np.linalg.norm(v)), 4), i) for i, v in v32.items() if i != q)
        want |= {(q, k + 1): (i, -c) for k, (c, i) in enumerate(s[:3]) if -c >= 0.5}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 2e-4 for k in want)


def test_posting_index_grows_and_equals_the_search_without_it(spark, tmp_path):
    docs = spark.createDataFrame([(1, "cold cache queue"), (2, "queue of the stale cache"), (3, None), (4, "nothing here"), (5, "Cache, cache!")], "id long, text string")
    asked = spark.createDataFrame([(5, "stale cache"), (9, "absent words")], "id long, text string")
    index = retrieval.PostingIndex(spark, str(tmp_path / "i"), buckets=4)
    assert index.refresh(docs.where("id < 3")) and index.refresh(docs) and not index.refresh(docs)
    assert rows(index.search(asked)) == rows(retrieval.bm25(docs, asked)) and index.search(asked).count() == 2


def test_cluster_members_take_the_reverse_score(spark):
    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)], "id long, cluster long")
    new = spark.createDataFrame([(2,), (5,), (2,)], "id long")
    scores = spark.createDataFrame([(2, 1, 0.0), (1, 2, 0.81239), (3, 2, 0.9)], "src long, dst long, score double")
    assert rows(graph.members(comp, new, scores)) == sorted([(1, 1, False, 0.812), (1, 2, True, None), (1, 3, False, 0.9), (5, 5, True, None)], key=repr)
    rec = graph.records(comp, new)
    assert rows(rec.select("cluster_id", "size", "n_triggers")) == [("c001", 3, 1), ("c003", 1, 1)]
    names = spark.createDataFrame([(1, "one", "text"), (2, "two", "more")], "id long, name string, text string")
    block = [r.line for r in reconcile.cluster_blocks(rec, graph.members(comp, new, scores), names).where("cluster_id = 'c001'").orderBy("line_no").collect()]
    assert "\n".join(block) == "=== CLUSTER c001 ===\n--- ENTRY: one (score 0.812) ---\ntext\n\n--- ENTRY: two ---\nmore\n\n--- ENTRY: 3 (score 0.900) ---\n(entry file not found: 3.md)\n"


def test_merged_and_retired_documents(spark):
    m = spark.createDataFrame([(1, 1, "same", "en", "s"), (1, 2, "same", "de", "t"), (1, 3, "same", None, None)], "cluster long, id long, text string, label string, origin string")
    p = reconcile.judge(m)
    doc = "---\nid: {}\ntopics: [{}]\nsource_sessions: [{}]\n---\n\n# T\n\nbody \n\n"
    e = [(1, "a", doc.format("a", "x", "s1"), ["x"], ["s1"]), (2, "b", doc.format("b", "w, x", "s3"), ["w", "x"], ["s3", "s1"]), (3, "c", doc.format("c", "", ""), [], [])]
    entries = spark.createDataFrame(e, "id long, name string, text string, topics array<string>, sessions array<string>")
    [r] = reconcile.merged_documents(p, m, entries).collect()
    assert r.document == (
        "---\nid: a\ntopics: [w, x]\nsource_sessions: [s1, s3]\n---\n\n# T\n\nbody\n\n## Evidence (merged from)\n\n### From `b` (sessions: [s3, s1])\n\n_Merged into `a` by reconcile._"
        "\n\n### From `c` (sessions: [])\n\n_Merged into `a` by reconcile._\n"
    )
    out = {x.id: x.document for x in reconcile.retired_documents(reconcile.retired(p, m), entries, entries, "now").collect()}
    assert set(out) == {2, 3} and out[3] == "---\nid: c\ntopics: []\nsource_sessions: []\nsuperseded_by: a\nretired_reason: duplicate: 3 members of cluster 1\nretired_at: now\n---\n\n# T\n\nbody \n\n"
    again = spark.createDataFrame([(1, i, t, "x", "") for i, t in enumerate(["k", "k", "z", "y"], 1)] + [(9, i, t, "x", "") for i, t in enumerate("abcd", 9)], m.schema)
    assert {(x.cluster, x.action) for x in reconcile.second_pass(reconcile.judge(again), again).collect()} == {(1, "duplicate"), (9, "related")}
    assert {x.action for x in reconcile.second_pass(reconcile.judge(again), again.limit(0)).collect()} == {"subagent-needed"}


def test_records_keep_line_numbers_over_splits(spark, tmp_path):
    lines = [json.dumps({"n": i, "pad": "x" * (i % 50)}) + ("\r" if i % 9 == 0 else "") if i % 7 else "" for i in range(3_000)]
    (tmp_path / "a.jsonl").write_bytes("\n".join(lines).encode())
    (tmp_path / "b.jsonl").write_bytes(b"{}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = files.records(spark, str(tmp_path))
        a = {r.line_no: r.raw for r in got.where("path LIKE '%a.jsonl'").collect()}
        assert got.rdd.getNumPartitions() >= 1 and a == {i: x for i, x in enumerate(lines) if x} and got.where("path LIKE '%b.jsonl'").count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_document_sinks(spark, tmp_path):
    entries, gone = str(tmp_path / "e"), str(tmp_path / "r")
    docs = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3")], "name string, text string")
    sinks.put_documents(docs, entries, dry_run=True)
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, entries)
    sinks.put_documents(docs, entries)
    assert rows(sinks.put_documents(spark.createDataFrame([("a", "9"), ("c", "4")], docs.schema), entries)) == [("a", "9"), ("b", "3"), ("c", "4")]
    assert rows(sinks.retire(docs.where("text = '3'"), entries, gone)) == [("a", "9"), ("c", "4")] and rows(sinks.current(spark, gone)) == [("b", "3")]
    with pytest.raises(KeyError):
        sinks.retire(docs.where("text = '3'"), entries, gone)
    silver = str(tmp_path / "s")
    part = lambda *x: spark.createDataFrame([x], "silver_path string, part_index int, section string")
    assert rows(sinks.append_silver(part("d", 1, "one é"), silver)) == [("d", "one é", 0)]
    sinks.append_silver(part("other", 1, "x"), silver)
    assert rows(sinks.append_silver(part("d", 2, "two\n"), silver)) == [("d", "one é\n\ntwo\n", 6)] and sinks.current(spark, silver).count() == 2
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "s1.jsonl").write_bytes(b'{"a":1}\r\nx')
    found = files.sessions(spark, str(tmp_path / "p"))
    sinks.copy_bronze(spark, str(tmp_path / "p"), found, str(tmp_path / "bronze"), "cli")
    assert [(r.session_id, bytes(r.content), r.harness) for r in spark.read.parquet(str(tmp_path / "bronze")).collect()] == [("s1", b'{"a":1}\r\nx', "cli")]
    cut = spark.createDataFrame([("s", 1, 1, "b"), ("s", 1, 0, "a"), ("s", 2, 2, "c")], "session_id string, part_index int, line_no int, raw string")
    assert rows(sinks.write_parts(cut, str(tmp_path / "parts"))) == [("s_part_01", 1, "a\nb\n"), ("s_part_02", 2, "c\n")]
    sinks.write_lines(cut, str(tmp_path / "c"))
    assert files.clusters(spark, str(tmp_path / "c")).count() == 3
    (tmp_path / "bad.jsonl").write_text("{}\n{cut\n")
    with pytest.raises(ValueError, match="cut"):
        files.clusters(spark, str(tmp_path / "bad.jsonl"))
    with pytest.raises(FileNotFoundError):
        files.clusters(spark, str(tmp_path / "none"))


def test_outcomes_and_siblings(spark, transcript):
    t = transcript([{"session_id": "new"}, {"session_id": "known"}, {"session_id": "big", "msg_content": "x" * 50}, {"session_id": "odd", "rec_type": None}, {"session_id": None}])
    m = spark.createDataFrame([("known_part_01", 1, "silver", "d"), ("known_part_02", 2, "silver", "d"), ("z", None, "silver", None)], "session_id string, part_index int, status string, silver_path string")
    assert rows(ingest.outcomes(t, m, 20)) == [("big", "skipped_large"), ("known", "skipped_known"), ("new", "ingested"), ("odd", "errors")]
    done = spark.createDataFrame([("d", ["g1"])], "silver_path string, gold_paths array<string>")
    assert rows(extraction.propagate(m, done, "now")) == [("known_part_01", "gold", "now", ["g1"], None), ("known_part_02", "gold", "now", ["g1"], None)]


def shuffled(spark, act):
    """(result, records written to shuffles) of an action."""
    sc = spark.sparkContext

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    out = act()
    return out, written() - before


def test_similar_shuffles_only_what_partners_must_share(spark):
    r = random.Random(4)
    common = [f"c{i}" for i in range(30)]
    texts = [common + [f"w{r.randrange(10**9)}" for _ in range(90)] for _ in range(150)]
    texts += [[*t[:60], "changed", *t[61:]] for t in texts[:20]] + [t[:-30] for t in texts[20:30]]
    sh = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = sorted((i, j) for i in range(len(sh)) for j in range(i + 1, len(sh)) if len(sh[i] & sh[j]) / len(sh[i] | sh[j]) >= 0.8)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    got, n = shuffled(spark, lambda: sorted((x.src, x.dst) for x in retrieval.similar(df).collect()))
    assert got == want and len(want) == 20 and n < sum(map(len, sh)) / 4


def test_bm25_shuffles_no_pairs_and_ranks_as_brute_force(spark):
    import math

    r = random.Random(6)
    words = [f"w{i}" for i in range(25)]
    texts = {i: " ".join(r.choice(words) for _ in range(r.randrange(1, 40))) for i in range(1, 401)} | {401: "", 402: "w1 w1 w2"}
    docs, asked = spark.createDataFrame(list(texts.items()), "id long, text string"), spark.createDataFrame([(i, " ".join(words[i % 7 :])) for i in range(1, 41)], "id long, text string")
    got, n = shuffled(spark, lambda: {(x.query_id, x.rank): (x.id, x.score) for x in retrieval.bm25(docs, asked, 3).collect()})
    split, size = {i: t.split() for i, t in texts.items()}, len(texts)
    avg, df = sum(map(len, split.values())) / size, {w: sum(w in t for t in split.values()) for w in words}
    want = {}
    for q in range(1, 41):
        part = lambda w, t: math.log((size - df[w] + 0.5) / (df[w] + 0.5) + 1) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg))
        best = sorted((-round(sum(part(w, t) for w in words[q % 7 :] if w in t), 4), i) for i, t in split.items() if i != q and set(t) & set(words[q % 7 :]))
        want |= {(q, k + 1): (i, -x) for k, (x, i) in enumerate(best[:3])}
    assert got == want and n < 5_000


def test_best_keeps_ties_in_order_of_the_id_over_many_blocks():
    import numpy as np

    r = np.random.default_rng(3)
    score, ids = np.round(r.random((3, 3_000)), 2) * (r.random((3, 3_000)) < 0.5) + 1e-6, r.permutation(3_000)
    best = retrieval.Best(3, 4)
    for i in range(0, 3_000, 100):
        best.add(score[:, i : i + 100].copy(), ids[i : i + 100])
    q, i, s = best.rows()
    assert [(a, b, c) for a, b, c in zip(q, i, s)] == [(a, b, -c) for a in range(3) for c, b in sorted(zip(-np.round(score[a], 4), ids))[:4]]


def test_bodies_and_queries_are_found_without_a_shuffle_of_texts(spark, small):
    from lodestream.plans import knowledge

    for df in (knowledge._bodies(spark, small), knowledge._asked(spark, small)):
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_refresh_of_the_index_shuffles_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"cold cache number {i}") for i in range(50)], "id long, text string").repartition(3).localCheckpoint()
    index = retrieval.PostingIndex(spark, str(tmp_path / "i"), buckets=4)
    new, n = shuffled(spark, lambda: index.refresh(docs))
    assert new and n <= 10 and spark.read.parquet(str(tmp_path / "i/postings")).count() == 200


def test_judging_needs_digests_and_lengths_only(spark, small):
    from lodestream.plans import knowledge

    assert "text" not in knowledge._members(spark, small).columns
    m = spark.createDataFrame([(1, 1, "aaaa", "en"), (1, 2, "aaaa", "de"), (4, 4, "b" * 11, None), (4, 5, "c", "x"), (6, 6, None, "x")], "cluster long, id long, text string, label string")
    lean = m.select("cluster", "id", F.md5("text").alias("digest"), F.char_length("text").alias("text_chars"), "label")
    assert rows(reconcile.judge(lean)) == rows(reconcile.judge(m)) and rows(reconcile.prompt_tokens(lean)) == rows(reconcile.prompt_tokens(m))


def test_counters_of_shingles_are_sent_as_gaps(spark):
    import numpy as np

    own = np.zeros(1 << 21, np.uint8)
    own[[0, 5, 260, 70_000, (1 << 21) - 1]] = [1, 255, 2, 3, 1]
    at, n = retrieval._of_gaps(retrieval.pa.py_buffer(retrieval._gaps(own)), 5)
    assert at.tolist() == [0, 5, 260, 70_000, (1 << 21) - 1] and n.tolist() == [1, 255, 2, 3, 1]
    at, n = retrieval._of_gaps(retrieval.pa.py_buffer(retrieval._gaps(own[-1:])), 1)
    assert at.tolist() == [0] and n.tolist() == [1]

    def written():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(104)) for _ in range(400)]
    lists = spark.createDataFrame(list(enumerate(texts + texts[:50])), "id long, text string").select("id", retrieval._word_hashes(F.col("text")).alias("t"))
    many, one = lists.repartition(16).localCheckpoint(), lists.coalesce(1).localCheckpoint()
    before = written()
    got = retrieval._levels(many, 5, 16)
    sent = written() - before
    unpacked = lambda parts: {k: retrieval.pa.decompress(c, 1 << 16, "zstd").to_pybytes() for k, c in parts.items()}
    assert unpacked(got) == unpacked(retrieval._levels(one, 5, 16)) and got and sent < 1.2 * 450 * 100
