"""Queries of extraction, retrieval, clustering and reconciling over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..operators import compaction, extraction, graph, ingest, provider, reconcile, retrieval
from ..session import hinted, materialize, shared_path, table
from . import pipeline


def _t(name):
    return lambda spark, d: table(spark, d, name)


M, G, D, SC = _t("manifest"), _t("gold_entries"), _t("documents"), _t("sidecar")
NOW, TODAY = "2024-09-04 12:00:00", "2024-10-01"
#: The given vectors are far apart: at the default of 0.5 none would be found.
VECTOR_SCORE = 0.3


def _latest(s, d):
    return ingest.manifest_latest(M(s, d))


def _similar(docs):
    """Similar pairs of distinct texts, and each copy with the least row of its text."""
    docs = docs.where(r"text RLIKE '\\S'")
    copies = materialize(graph.stars(docs.select("id", F.md5("text").alias("digest")), "digest", "id"), "copies")
    firsts = docs.join(hinted(copies.select(F.col("dst").alias("id"))), "id", "left_anti")
    return retrieval.similar(firsts).unionByName(copies.withColumn("score", F.lit(1.0)))


def _edges(s, d):
    return _similar(D(s, d).select(F.col("doc_id").alias("id"), "text"))


def _components(s, d):
    nodes = D(s, d).where(r"text RLIKE '\\S'").select(F.col("doc_id").alias("id"))
    return materialize(graph.components(nodes, _edges(s, d).select("src", "dst")), "components")


def _members(s, d):
    """The documents of each cluster, with digest and length in place of their text."""
    docs = D(s, d).select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"), F.char_length("text").alias("text_chars"), F.col("lang").alias("label"), F.col("source").alias("origin"))
    return _components(s, d).join(docs, "id")


def _gold_edges(s, d):
    """Similar summaries of the entries, written once."""
    return materialize(_similar(extraction.first_rows(G(s, d)).select(F.col("entry_no").alias("id"), F.col("summary").alias("text"))), "gold-edges")


def _gold_components(s, d, edges):
    """Clusters by similar summaries and by threads together."""
    g = extraction.first_rows(G(s, d))
    both = edges.select("src", "dst").unionByName(graph.stars(g, "thread_id", "entry_no"))
    return materialize(graph.components(g.select(F.col("entry_no").alias("id")), both), "gold-components")


def _mark(s, d):
    """The batch that the last run ended with: the three newest are new."""
    return F.broadcast(G(s, d).agg((F.max("batch_no") - 3).alias("_mark")))  # one row


def _new(s, d):
    return G(s, d).join(_mark(s, d), F.col("batch_no") > F.col("_mark")).drop("_mark")


def _triggers(s, d):
    return _new(s, d).select(F.col("entry_no").alias("id"))


def _names(s, d):
    return extraction.entry_documents(extraction.first_rows(G(s, d))).withColumnRenamed("entry_no", "id")


def _clusters(f):
    """A query over the gold clusters: their members, with what the similarity says, and their records."""

    def q(s, d):
        edges = _gold_edges(s, d)
        comp = _gold_components(s, d, edges)
        return f(s, d, graph.records(comp, _triggers(s, d)), graph.members(comp, _triggers(s, d), edges))

    return q


def _gold_judged(s, d):
    """Judged clusters of entries with equal or similar summaries: (proposals, members)."""
    g = extraction.first_rows(G(s, d))
    comp = materialize(graph.components(g.select(F.col("entry_no").alias("id")), _gold_edges(s, d).select("src", "dst")), "gold-similar")
    m = comp.join(g.select(F.col("entry_no").alias("id"), F.col("summary").alias("text"), F.col("entry_type").alias("label"), F.lit("").alias("origin")), "id")
    dup = F.when((F.col("n_members") > 1) & (F.col("action") != "duplicate"), "duplicate").otherwise(F.col("action"))
    return reconcile.judge(m).withColumn("primary_id", F.col("cluster")).withColumn("action", dup), m


def _merged_documents(s, d):
    proposals, m = _gold_judged(s, d)
    lists = extraction.first_rows(G(s, d)).select(F.col("entry_no").alias("id"), "topics", F.col("source_sessions").alias("sessions"))
    return reconcile.merged_documents(proposals, m, _names(s, d).join(lists, "id")).select("primary_id", F.md5("document").alias("digest"), F.char_length("document").cast("long").alias("n_chars"))


def _retired_documents(s, d):
    proposals, m = _gold_judged(s, d)
    names = _names(s, d)
    return reconcile.retired_documents(reconcile.retired(proposals, m), names, names, NOW).select("id", F.md5("document").alias("digest"))


def _project_members(s, d):
    """The entries of each first project as one cluster: groups large enough that the judge wants a second look."""
    g = extraction.first_rows(G(s, d)).withColumn("project", F.get("projects", F.lit(0)))
    least = g.where("coalesce(project, '') <> ''").groupBy("project").agg(F.min("entry_no").alias("_least"))
    m = g.join(least, "project", "left").select(F.coalesce("_least", "entry_no").alias("cluster"), F.col("entry_no").alias("id"), F.col("summary").alias("text"), F.lit("x").alias("label"), F.lit("").alias("origin"))
    return materialize(m, "project-members")


def _second_pass(s, d):
    m = _project_members(s, d)
    return reconcile.second_pass(reconcile.judge(m), m).select("cluster", "action", "primary_id", "n_members")


def _rejudge(s, d):
    m = _project_members(s, d)
    return reconcile.rejudge(reconcile.judge(m), m.where("id % 9 > 0"))


def _proposal_lines(s, d):
    """A judge's answer about each project, a line each; by the cluster's number some lines are cut off, lack a key, name no known action, or are plain talk."""
    p = reconcile.judge(_project_members(s, d))
    keys = [F.col("cluster").cast("string").alias("cluster_id"), F.when(F.col("cluster") % 7 == 0, "merge").otherwise(F.col("action")).alias("action"), F.col("primary_id").cast("string").alias("primary"), F.array().cast("array<string>").alias("others")]
    short, full = F.to_json(F.struct(*keys)), F.to_json(F.struct(*keys, F.lit("seen").alias("rationale")))
    line = F.when(F.col("cluster") % 11 == 0, F.expr("left(l, 20)")).when(F.col("cluster") % 13 == 0, F.lit("Here are the proposals:")).when(F.col("cluster") % 5 == 0, short).otherwise(full)
    return p.withColumn("l", full).select(line.alias("line"))


def _thread_components(s, d):
    g = extraction.first_rows(G(s, d))
    return materialize(graph.components(g.select(F.col("entry_no").alias("id")), graph.stars(g, "thread_id", "entry_no")), "threads")


def _judged(f):
    def q(s, d):
        m = materialize(_members(s, d), "members")
        return f(reconcile.judge(m), m)

    return q


def _kept(s, d, keys):
    """The entries of some (entry_no), found by their keys alone."""
    return G(s, d).join(hinted(materialize(keys.select("entry_no"), "entries")), "entry_no", "left_semi")


def _asked(s, d):
    """What the entries whose number is divisible by 100 would search with."""
    keys = extraction.first_rows(G(s, d).select("entry_no", "id")).where("entry_no % 100 = 0")
    return extraction.query_text(_kept(s, d, keys)).select(F.col("entry_no").alias("id"), F.col("query_text").alias("text"))


def _bodies(s, d):
    """What a search may return: entries that are not superseded."""
    keys = extraction.visible(G(s, d).select("entry_no", "id", "supersedes"))
    return _kept(s, d, keys).select(F.col("entry_no").alias("id"), F.col("body").alias("text"))


def _bm25(s, d, k=5):
    return retrieval.bm25(_bodies(s, d), _asked(s, d), k)


def _indexed(s, d):
    """The same search over a persisted index that is filled in two runs: what was there before the last mark, then all."""
    index, old = retrieval.PostingIndex(s, shared_path(s, "postings")), _new(s, d).select(F.col("entry_no").alias("id"))
    bodies = _bodies(s, d)
    index.refresh(bodies.join(hinted(materialize(old, "new-entries")), "id", "left_anti"))
    index.refresh(bodies)
    return index.search(_asked(s, d))


def _hybrid(s, d):
    """Documents by their words and by their vectors; the query is the first line of every document whose id is divisible by 100 (vectors carry document ids)."""
    docs = D(s, d).where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    asked = docs.where("id % 100 = 0").select("id", F.substring_index("text", "\n", 1).alias("text"))
    v = _vectors(s, d)
    words = retrieval.bm25(docs, asked, 20).select("query_id", "id", "rank")
    near = retrieval.cosine_topk(v, v.where("id % 100 = 0"), 20, threshold=VECTOR_SCORE).select("query_id", "id", "rank")
    return retrieval.fuse(words, near)


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _answers(s, d):
    """Answers as a model gives them: some are cut off before the end mark, lack the id, or talk before the block."""
    a = F.col("answer")
    cut = F.when(F.col("entry_no") % 17 == 0, F.regexp_replace(a, extraction.END, "")).when(F.col("entry_no") % 19 == 0, F.regexp_replace(a, r"(?m)^id: .*$", "note: x")).when(F.col("entry_no") % 3 == 0, F.concat(F.lit("Here it is:\n"), a)).otherwise(a)
    return extraction.as_block(G(s, d)).withColumn("answer", cut)


def _parsed(s, d):
    p = extraction.parse_entries(_names(s, d)).withColumnRenamed("name", "file_name")
    return p.select("file_name", "id", "title", "entry_type", F.array_join("topics", "|").alias("topics"), F.array_join("agents", "|").alias("agents"), "thread_id")


def _read_path(s, d):
    top = _bm25(s, d, 1)
    g = extraction.first_rows(G(s, d)).select(F.col("entry_no").alias("id"), "confidence", "summary", "staleness_policy", "last_validated")
    days = F.expr("try_cast(regexp_extract(staleness_policy, '^([0-9]+)d$', 1) AS INT)")
    q = _asked(s, d).select(F.col("id").alias("query_id"))
    hit = q.join(top, "query_id", "left").join(g, "id", "left")
    stale = F.coalesce(F.date_add("last_validated", days) < F.lit(TODAY).cast("date"), F.lit(False))
    return hit.select("query_id", F.when(F.col("id").isNull(), "No relevant entries found").otherwise(F.coalesce("summary", F.lit(""))).alias("answer"), "confidence", F.date_format("last_validated", "yyyy-MM-dd").alias("last_validated"), stale.alias("stale"))


def _compacted(s, d):
    """Each silver row's prompt, completed by the default provider."""
    meta = extraction.prompt_meta(_latest(s, d)).select(F.col("session_id").alias("id"), F.col("meta").alias("prompt"))
    return provider.complete(meta)


def _continuations(s, d):
    """The silver text so far is the document's frontmatter; the bronze text is where it lies (the tables hold neither document)."""
    m = _latest(s, d)
    front = compaction.frontmatter(m).withColumnRenamed("manifest_id", "session_id").join(m.select("session_id", "silver_path", "part_index"), "session_id")
    silver = front.where("silver_path IS NOT NULL").groupBy("silver_path").agg(F.min_by("frontmatter", F.struct(F.coalesce("part_index", F.lit(0)), "session_id")).alias("text"))
    return compaction.continuation(m, silver, m.select("session_id", F.col("bronze_path").alias("text")))


QUERIES = {
    "llm_outcomes": _compacted,
    "continuation_input": _continuations,
    "sibling_gold": lambda s, d: extraction.propagate(_latest(s, d), extraction.extract_groups(_latest(s, d)).select("silver_path", F.array(F.concat(F.lit("gold/"), "canonical")).alias("gold_paths")), NOW).withColumn("gold_paths", F.array_join("gold_paths", "|")),
    "extract_groups": lambda s, d: extraction.extract_groups(_latest(s, d)),
    "recoverable": lambda s, d: _latest(s, d).where(extraction.recoverable()).select("session_id"),
    "stuck_monitor": lambda s, d: extraction.stuck(_latest(s, d), NOW),
    "status_counts": lambda s, d: _latest(s, d).groupBy("status").agg(F.count("*").alias("n")),
    "retry_failed": lambda s, d: _latest(s, d).where("status = 'failed'").select("session_id", F.when(F.coalesce("silver_path", F.lit("")) != "", "silver").otherwise("bronze").alias("new_status")),
    "run_counters": lambda s, d: ingest.outcomes(table(s, d, "transcripts"), M(s, d), 100_000).groupBy("outcome").agg(F.count("*").alias("n")),
    "error_classes": lambda s, d: M(s, d).where("error IS NOT NULL").groupBy(F.when(F.lower("error").rlike("429|rate limit"), "quota").otherwise("fatal").alias("class")).agg(F.count("*").alias("n")),
    "gold_paths_count": lambda s, d: _latest(s, d).select(F.explode("gold_paths").alias("p")).agg(F.count_distinct("p").alias("n_files")),
    "completeness_check": lambda s, d: extraction.completeness(D(s, d)),
    "frontmatter_parse": lambda s, d: extraction.entries_of(D(s, d)).select("doc_id", fm.scalar(F.element_at("kv", "id")).alias("id"), fm.scalar(F.element_at("kv", "type")).alias("entry_type"), F.array_join(fm.items(F.element_at("kv", "topics")), "|").alias("topics"), F.char_length("body").cast("long").alias("body_chars")),
    "frontmatter_render": lambda s, d: G(s, d).select("entry_no", F.concat(F.lit("id: "), fm.render(F.col("id")), F.lit("\ntopics: "), fm.render_list(F.col("topics")), F.lit("\nthread_id: "), fm.render(F.col("thread_id"))).alias("rendered")),
    "frontmatter_rewrite": lambda s, d: extraction.entries_of(D(s, d)).select("doc_id", F.md5(fm.rewrite(fm.rewrite(F.col("text"), "query_count", F.lit("0")), "confidence", F.lit("medium"))).alias("digest")),
    "entry_title": lambda s, d: G(s, d).select("entry_no", fm.title(F.col("body"), F.col("id")).alias("title")),
    "query_text": lambda s, d: extraction.query_text(G(s, d)),
    "thread_ids": lambda s, d: SC(s, d).select("session_id", F.when(F.col("project_id").isNull() | F.col("branch").isNull() | F.col("branch").startswith("DETACHED@"), None).otherwise(F.substring(F.sha1(F.concat_ws(":", "project_id", "branch")), 1, 16)).alias("thread_id")),
    "id_collision": lambda s, d: extraction.id_collisions(G(s, d)),
    "llm_output_split": lambda s, d: extraction.split_answer(_answers(s, d)),
    "owned_fields": lambda s, d: extraction.owned_fields(G(s, d), TODAY),
    "extract_prompt_meta": lambda s, d: extraction.prompt_meta(_latest(s, d)),
    "incremental_new": lambda s, d: _new(s, d).select("entry_no", "id"),
    "index_visible": lambda s, d: extraction.visible(G(s, d)).select("entry_no", "id"),
    "entry_documents": lambda s, d: _names(s, d).select("id", "name", F.md5("text").alias("digest")),
    "entry_parse": _parsed,
    "vector_topk": lambda s, d: retrieval.cosine_topk(_vectors(s, d), _vectors(s, d).where("id % 100 = 0"), threshold=VECTOR_SCORE),
    "bm25_topk": _bm25,
    "bm25_index": _indexed,
    "hybrid_rrf": _hybrid,
    "read_path": _read_path,
    "similarity_edges": _edges,
    "clusters_cc": _components,
    "clusters_thread": _thread_components,
    "clusters_gold": lambda s, d: _gold_components(s, d, _gold_edges(s, d)),
    "cluster_records": _clusters(lambda s, d, r, m: r),
    "cluster_members": _clusters(lambda s, d, r, m: m),
    "cluster_blocks": _clusters(lambda s, d, r, m: reconcile.cluster_blocks(r, m, _names(s, d)).select("cluster_id", "line_no", F.md5("line").alias("digest"))),
    "merged_documents": _merged_documents,
    "retired_documents": _retired_documents,
    "second_pass": _second_pass,
    "rejudge_lookup": _rejudge,
    "proposals_parsed": lambda s, d: reconcile.parse_proposals(_proposal_lines(s, d)).select("cluster_id", "action", "is_valid"),
    "proposals_valid": _judged(lambda p, m: p.where(reconcile.valid(F.col("action")))),
    "approved_actions": _judged(lambda p, m: reconcile.approved(p)),
    "noop_actions": _judged(lambda p, m: p.where("action IN ('related', 'unrelated')").groupBy("action").agg(F.count("*").alias("n"))),
    "merge_duplicates": _judged(reconcile.merged),
    "retired_entries": _judged(reconcile.retired),
    "apply_all_exist": _judged(lambda p, m: reconcile.existing(reconcile.approved(p), m, m.where("label IS NOT NULL"))),
    "judge_prompt_size": _judged(lambda p, m: reconcile.prompt_tokens(m)),
}

LATEST = """latest AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY greatest(coalesce(ingested_at, ''), coalesce(compacted_at, ''), coalesce(extracted_at, '')) DESC, status DESC, coalesce(bronze_size_bytes, -1) DESC) AS _rn FROM manifest) WHERE _rn = 1)"""
FIRST = "first AS (SELECT * FROM gold_entries WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY entry_no) = 1)"
TITLE = r"coalesce(nullif(trim(regexp_extract(body, '(?m)^#[ \t]+(.+)$', 1)), ''), id)"
QTEXT = rf"regexp_replace(concat_ws(' ', nullif({TITLE}, ''), nullif(array_to_string(topics, ' '), ''), nullif(entry_type, ''), nullif(array_to_string(agents, ' '), ''), nullif(coalesce(nullif(trim(summary), ''), trim(regexp_replace(substr(body, 1, 3000), '\s+', ' ', 'g'))), '')), '\s+', ' ', 'g')"
TOK = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
FM = r"""e AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE starts_with(text, '---' || chr(10))), f AS (SELECT doc_id, text, l, list_position(l[2:], '---') AS e FROM e), h AS (SELECT doc_id, text, l[2:e] AS h, ltrim(array_to_string(l[e + 2:], chr(10)), chr(10)) AS body FROM f WHERE e > 0),
kv AS (SELECT doc_id, trim(split_part(x, ':', 1)) AS k, trim(regexp_replace(x, '^[^:]*:', '')) AS v, i FROM (SELECT doc_id, unnest(h) AS x, generate_subscripts(h, 1) AS i FROM h) WHERE contains(x, ':'))"""


VISIBLE = "vis AS (SELECT * FROM first WHERE id NOT IN (SELECT x FROM (SELECT unnest(supersedes) AS x FROM gold_entries) WHERE x IS NOT NULL AND x <> ''))"


def _bm(corpus: str, k: int, docs: str = "vis", key: str = "entry_no", query: str = QTEXT, asked: str = "first") -> str:
    return f"""(WITH c AS (SELECT {key} AS id, {TOK.format(corpus)} AS t FROM {docs}), post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM c) GROUP BY 1, 2),
len AS (SELECT id, sum(tf) AS len FROM post GROUP BY 1), st AS (SELECT (SELECT count(*) FROM {docs}) AS n, sum(len) AS al FROM len), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
q AS (SELECT DISTINCT query_id, term FROM (SELECT {key} AS query_id, unnest({TOK.format(query)}) AS term FROM {asked} WHERE {key} % 100 = 0)),
s AS (SELECT query_id, post.id, round(sum(ln((n::DOUBLE - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / (al::DOUBLE / n)))), 4) AS score FROM q JOIN df USING (term) JOIN post USING (term) JOIN len USING (id), st WHERE post.id <> query_id GROUP BY 1, 2)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= {k})"""


EDGES = rf"""docs AS (SELECT * FROM documents WHERE regexp_matches(text, '\S')), {{}}"""
_SIM = rf"""d AS (SELECT text, min(doc_id) AS id FROM docs GROUP BY 1), tk AS (SELECT id, {TOK.format('text')} AS t FROM d),
sh AS (SELECT DISTINCT id, array_to_string(t[i:i + 4], ' ') AS sh FROM (SELECT id, t, unnest(range(1, len(t) - 3)) AS i FROM tk WHERE len(t) >= 5)), n AS (SELECT id, count(*) AS n FROM sh GROUP BY 1),
c AS (SELECT a.id AS src, b.id AS dst, count(*) AS c FROM sh a JOIN sh b ON a.sh = b.sh AND a.id < b.id GROUP BY 1, 2),
edges AS (SELECT src, dst, round(c::DOUBLE / (x.n + y.n - c), 4) AS score FROM c JOIN n x ON x.id = src JOIN n y ON y.id = dst WHERE c >= 0.8 * (x.n + y.n - c)
UNION ALL SELECT m, doc_id, 1.0::DOUBLE FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS m FROM docs) WHERE m <> doc_id)"""
EDGES = EDGES.format(_SIM)
#: The same over the summaries of the entries.
GEDGES = f"{FIRST}, docs AS (SELECT entry_no AS doc_id, summary AS text FROM first WHERE regexp_matches(summary, '\\S')), {_SIM}"
NEW = "(SELECT entry_no FROM gold_entries WHERE batch_no > (SELECT max(batch_no) - 3 FROM gold_entries))"
STARS = "SELECT min(entry_no) OVER (PARTITION BY thread_id) AS src, entry_no AS dst FROM first WHERE thread_id NOT IN ('', 'null')"


def _gold_cc(edges: str) -> str:
    return f"""{GEDGES}, ge AS ({edges}), u AS (SELECT src AS a, dst AS b FROM ge UNION SELECT dst, src FROM ge), reach AS (SELECT entry_no AS id, entry_no AS r FROM first UNION SELECT reach.id, u.b FROM reach JOIN u ON u.a = reach.r), comp AS (SELECT id, min(r) AS cluster FROM reach GROUP BY 1)"""


GCC = _gold_cc(f"SELECT src, dst FROM edges UNION ALL {STARS}")
GREC = f"""{GCC}, cn AS (SELECT cluster, count(*) AS size, count(*) FILTER (id IN {NEW}) AS n_triggers FROM comp GROUP BY 1), rec AS (SELECT cluster, printf('c%03d', rn) AS cluster_id, size, n_triggers FROM (SELECT *, row_number() OVER (ORDER BY size DESC, cluster) AS rn FROM cn) WHERE n_triggers > 0),
pair AS (SELECT src AS t, dst AS id, score AS s FROM edges UNION ALL SELECT dst, src, score FROM edges),
best AS (SELECT id, round(max(s), 3) AS best_score FROM pair WHERE t IN {NEW} GROUP BY 1),
gm AS (SELECT comp.cluster, comp.id, comp.id IN {NEW} AS is_trigger, best_score FROM comp JOIN rec USING (cluster) LEFT JOIN best ON best.id = comp.id)"""
_LIST = "'[' || array_to_string(coalesce({0}, []), ', ') || ']'"
DOCUMENT = (
    "concat('---', chr(10), 'id: ', coalesce(id, 'null'), chr(10), 'type: ', coalesce(entry_type, 'null'), chr(10), "
    + ", ".join(f"'{c}: ', {_LIST.format(c)}, chr(10)" for c in ("topics", "projects", "agents")) + ", 'staleness_policy: ', coalesce(staleness_policy, 'null'), chr(10), "
    + f"'source_sessions: ', {_LIST.format('source_sessions')}, chr(10), " + ", ".join(f"'{c}: ', coalesce({c}::VARCHAR, 'null'), chr(10)" for c in ("created", "last_validated", "last_queried", "query_count", "confidence"))
    + f", 'supersedes: ', {_LIST.format('supersedes')}, chr(10), 'thread_id: ', coalesce(thread_id, 'null'), chr(10), '---', chr(10), chr(10), regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g'), chr(10))"
)
GSIM = f"""{_gold_cc("SELECT src, dst FROM edges")}, dc AS (SELECT entry_no, id AS name, topics, source_sessions, {DOCUMENT} AS text FROM first),
pm AS (SELECT cluster AS primary_id, comp.id, dc.*, count(*) OVER (PARTITION BY cluster) AS n FROM comp JOIN dc ON dc.entry_no = comp.id), mm AS (SELECT * FROM pm WHERE n > 1)"""
TMEM = f"{FIRST}, tm AS (SELECT entry_no AS id, summary AS text, CASE WHEN coalesce(projects[1], '') = '' THEN entry_no ELSE min(entry_no) OVER (PARTITION BY projects[1]) END AS cluster FROM first), tp AS (SELECT cluster, min(id) AS lo, count(*) AS n, count(DISTINCT text) AS nt, count(text) AS nn FROM tm GROUP BY 1), tj AS (SELECT *, CASE WHEN n > 1 AND nt = 1 THEN 'duplicate' WHEN n >= 4 THEN 'subagent-needed' WHEN n = 1 THEN 'unrelated' ELSE 'related' END AS action FROM tp)"
CC = f"""{EDGES}, u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), reach AS (SELECT doc_id AS id, doc_id AS r FROM docs UNION SELECT reach.id, u.b FROM reach JOIN u ON u.a = reach.r), comp AS (SELECT id, min(r) AS cluster FROM reach GROUP BY 1),
mem AS (SELECT comp.*, text, lang AS label, source AS origin FROM comp JOIN documents ON doc_id = id),
g AS (SELECT cluster, count(*) AS n_members, min(id) AS lo, max(id) AS hi, count(DISTINCT text) AS nt, count(DISTINCT coalesce(label, '')) AS nl FROM mem GROUP BY 1),
pa AS (SELECT *, CASE WHEN n_members > 1 AND nt = 1 THEN 'duplicate' WHEN n_members > 1 AND nl > 1 THEN 'contradiction' WHEN n_members >= 4 THEN 'subagent-needed' WHEN n_members = 1 THEN 'unrelated' ELSE 'related' END AS action FROM g),
p AS (SELECT cluster, action, CASE WHEN action = 'contradiction' THEN hi ELSE lo END AS primary_id, n_members FROM pa)"""
THREAD = f"{FIRST}, tc AS (SELECT entry_no AS id, CASE WHEN thread_id IS NULL OR thread_id IN ('', 'null') THEN entry_no ELSE min(entry_no) OVER (PARTITION BY thread_id) END AS cluster FROM first)"

ORACLE = {
    "continuation_input": f"""WITH {LATEST}, fr AS (SELECT silver_path, arg_min(frontmatter, printf('%08d', coalesce(part_index, 0)) || session_id) AS t FROM (SELECT latest.*, frontmatter FROM ({pipeline.ORACLE["silver_document"]}) f JOIN latest ON f.manifest_id = latest.session_id) GROUP BY 1)
SELECT session_id, concat('<prior-silver>', chr(10), coalesce(t, ''), chr(10), '</prior-silver>', chr(10), chr(10), printf('<part-info>part_index=%d total_parts=%d</part-info>', part_index, coalesce(total_parts, part_index)), chr(10), chr(10), '<bronze-part>', chr(10), coalesce(bronze_path, ''), chr(10), '</bronze-part>') AS input FROM latest LEFT JOIN fr USING (silver_path) WHERE coalesce(part_index, 1) > 1""",
    "sibling_gold": f"WITH {LATEST}, g AS (SELECT silver_path, arg_max(session_id, printf('%06d', coalesce(part_index, 0)) || session_id) AS canonical FROM latest WHERE status = 'silver' AND coalesce(silver_path, '') <> '' GROUP BY 1) SELECT session_id, 'gold' AS status, '{NOW}' AS extracted_at, 'gold/' || canonical AS gold_paths, CAST(NULL AS VARCHAR) AS error FROM latest JOIN g USING (silver_path) WHERE status = 'silver'",
    "entry_documents": f"WITH {FIRST} SELECT entry_no AS id, id AS name, md5({DOCUMENT}) AS digest FROM first",
    "entry_parse": f"WITH {FIRST} SELECT id AS file_name, trim(id) AS id, {TITLE} AS title, nullif(nullif(entry_type, ''), 'null') AS entry_type, array_to_string(list_filter(list_transform(topics, lambda x: trim(x)), lambda x: x <> ''), '|') AS topics, array_to_string(list_filter(list_transform(agents, lambda x: trim(x)), lambda x: x <> ''), '|') AS agents, nullif(nullif(thread_id, 'null'), '') AS thread_id FROM first",
    "clusters_gold": f"WITH RECURSIVE {GCC} SELECT * FROM comp",
    "cluster_records": f"WITH RECURSIVE {GREC} SELECT * FROM rec",
    "cluster_members": f"WITH RECURSIVE {GREC} SELECT * FROM gm",
    "cluster_blocks": f"""WITH RECURSIVE {GREC}, bl AS (SELECT cluster_id, 0 AS line_no, '=== CLUSTER ' || cluster_id || ' ===' AS line FROM rec UNION ALL SELECT cluster_id, row_number() OVER (PARTITION BY cluster ORDER BY gm.id), concat('--- ENTRY: ', coalesce(name, gm.id::VARCHAR), CASE WHEN best_score IS NOT NULL THEN printf(' (score %.3f)', best_score) ELSE '' END, ' ---', chr(10), text, chr(10)) FROM gm JOIN rec USING (cluster) JOIN (SELECT entry_no, id AS name, {DOCUMENT} AS text FROM first) dd ON dd.entry_no = gm.id)
SELECT cluster_id, CAST(line_no AS INTEGER) AS line_no, md5(line) AS digest FROM bl""",
    "merged_documents": f"""WITH RECURSIVE {GSIM}, tt AS (SELECT primary_id, list_sort(list_distinct(flatten(list(topics)))) AS topics, list(source_sessions ORDER BY id) AS ss, string_agg(CASE WHEN id <> primary_id THEN concat('### From `', name, '` (sessions: [', array_to_string(source_sessions, ', '), '])', chr(10), chr(10), '_Merged into `', pn, '` by reconcile._') END, chr(10) || chr(10) ORDER BY id) AS blocks FROM mm JOIN (SELECT primary_id AS pp, name AS pn FROM mm WHERE id = primary_id) ON pp = primary_id GROUP BY 1),
fl AS (SELECT primary_id, topics, blocks, list_transform(list_filter(generate_series(1, len(flatten(ss))), lambda i: list_position(flatten(ss), flatten(ss)[i]) = i), lambda i: flatten(ss)[i]) AS ss FROM tt),
lines AS (SELECT primary_id, list_transform(string_split(text, chr(10)), lambda x: x) AS l, fl.topics AS tp, ss, blocks FROM fl JOIN mm USING (primary_id) WHERE mm.id = primary_id),
ends AS (SELECT *, list_position(l[2:], '---') AS e FROM lines),
docs2 AS (SELECT primary_id, concat('---', chr(10), array_to_string(list_transform(l[2:e], lambda x: CASE WHEN starts_with(x, 'topics:') AND len(tp) > 0 THEN 'topics: [' || array_to_string(tp, ', ') || ']' WHEN starts_with(x, 'source_sessions:') AND len(ss) > 0 THEN 'source_sessions: [' || array_to_string(ss, ', ') || ']' ELSE x END), chr(10)), chr(10), '---', chr(10), chr(10), ltrim(array_to_string(l[e + 2:], chr(10)), chr(10))) AS t, blocks FROM ends)
SELECT primary_id, md5(x) AS digest, length(x) AS n_chars FROM (SELECT primary_id, concat(regexp_replace(t, '\\s+$', ''), chr(10), chr(10), '## Evidence (merged from)', chr(10), chr(10), blocks, chr(10)) AS x FROM docs2)""",
    "retired_documents": f"""WITH RECURSIVE {GSIM}, r AS (SELECT id, primary_id, n, string_split(text, chr(10)) AS l, (SELECT name FROM dc WHERE entry_no = primary_id) AS pn FROM mm WHERE id <> primary_id), e AS (SELECT *, list_position(l[2:], '---') AS e FROM r)
SELECT id, md5(concat('---', chr(10), array_to_string(l[2:e], chr(10)), chr(10), 'superseded_by: ', pn, chr(10), 'retired_reason: duplicate: ', printf('%d members of cluster %d', n, primary_id), chr(10), 'retired_at: {NOW}', chr(10), '---', chr(10), chr(10), ltrim(array_to_string(l[e + 2:], chr(10)), chr(10)))) AS digest FROM e""",
    "second_pass": f"WITH {TMEM}, q AS (SELECT tj.cluster, count(*) FILTER (tm.text = (SELECT x.text FROM tm x WHERE x.id = tj.lo) AND tm.id <> tj.lo) AS ne FROM tj JOIN tm USING (cluster) WHERE action = 'subagent-needed' GROUP BY 1) SELECT tj.cluster, CASE WHEN ne > 0 THEN 'duplicate' WHEN ne = 0 THEN 'related' ELSE action END AS action, lo AS primary_id, n AS n_members FROM tj LEFT JOIN q USING (cluster)",
    "proposals_parsed": f"WITH {TMEM} SELECT cluster::VARCHAR AS cluster_id, CASE WHEN cluster % 7 = 0 THEN 'merge' ELSE action END AS action, NOT (cluster % 7 = 0 OR cluster % 5 = 0) AS is_valid FROM tj WHERE cluster % 11 <> 0 AND cluster % 13 <> 0",
    "extract_groups": f"WITH {LATEST} SELECT silver_path, arg_max(session_id, printf('%06d', coalesce(part_index, 0)) || session_id) AS canonical, count(*) AS n_parts, max(coalesce(part_index, 0)) AS last_part FROM latest WHERE status = 'silver' AND coalesce(silver_path, '') <> '' GROUP BY 1",
    "recoverable": f"WITH {LATEST} SELECT session_id FROM latest WHERE status = 'gold' AND len(gold_paths) = 0",
    "stuck_monitor": f"WITH {LATEST} SELECT count(*) AS n_stuck FROM latest WHERE status = 'gold' AND len(gold_paths) = 0 AND try_cast(replace(extracted_at, 'Z', '') AS TIMESTAMP) > TIMESTAMP '{NOW}' - INTERVAL 24 HOURS",
    "status_counts": f"WITH {LATEST} SELECT status, count(*) AS n FROM latest GROUP BY 1",
    "retry_failed": f"WITH {LATEST} SELECT session_id, CASE WHEN coalesce(silver_path, '') <> '' THEN 'silver' ELSE 'bronze' END AS new_status FROM latest WHERE status = 'failed'",
    "run_counters": f"WITH s AS (SELECT session_id, sum(coalesce(strlen(msg_content), 0)) AS n, count(*) FILTER (coalesce(rec_type, '') <> '') AS t FROM transcripts WHERE session_id IS NOT NULL GROUP BY 1) SELECT CASE WHEN session_id IN (SELECT {pipeline.LOGICAL} FROM manifest) THEN 'skipped_known' WHEN n > 100000 THEN 'skipped_large' WHEN t = 0 THEN 'errors' ELSE 'ingested' END AS outcome, count(*) AS n FROM s GROUP BY 1",
    "error_classes": "SELECT CASE WHEN regexp_matches(lower(error), '429|rate limit') THEN 'quota' ELSE 'fatal' END AS class, count(*) AS n FROM manifest WHERE error IS NOT NULL GROUP BY 1",
    "gold_paths_count": f"WITH {LATEST} SELECT count(DISTINCT p) AS n_files FROM (SELECT unnest(gold_paths) AS p FROM latest)",
    "completeness_check": f"WITH {FM}, r AS (SELECT doc_id, unnest(['id', 'type', 'topics', 'projects', 'agents', 'staleness_policy']) AS k FROM h), m AS (SELECT r.doc_id, string_agg(r.k, ',' ORDER BY r.k) FILTER (kv.k IS NULL) AS missing FROM r LEFT JOIN (SELECT DISTINCT doc_id, k FROM kv) kv ON kv.doc_id = r.doc_id AND kv.k = r.k GROUP BY 1) SELECT doc_id, coalesce(missing, '') AS missing, missing IS NULL AS complete FROM m",
    "frontmatter_parse": f"""WITH {FM}, w AS (SELECT doc_id, arg_max(v, i) FILTER (k = 'id') AS id, arg_max(v, i) FILTER (k = 'type') AS ty, arg_max(v, i) FILTER (k = 'topics') AS topics FROM kv GROUP BY 1)
SELECT h.doc_id, nullif(nullif(id, 'null'), '') AS id, nullif(nullif(ty, 'null'), '') AS entry_type, CASE WHEN topics IS NOT NULL THEN array_to_string(list_filter(list_transform(string_split(regexp_extract(topics, '^\\[(.*)\\]$', 1), ','), lambda x: trim(x)), lambda x: x <> ''), '|') END AS topics, length(body) AS body_chars FROM h LEFT JOIN w USING (doc_id)""",
    "frontmatter_render": "SELECT entry_no, 'id: ' || coalesce(id, 'null') || chr(10) || 'topics: [' || array_to_string(topics, ', ') || ']' || chr(10) || 'thread_id: ' || coalesce(thread_id, 'null') AS rendered FROM gold_entries",
    "frontmatter_rewrite": f"""WITH {FM}, a AS (SELECT doc_id, body, CASE WHEN len(list_filter(h, lambda x: starts_with(x, 'query_count:'))) > 0 THEN list_transform(h, lambda x: CASE WHEN starts_with(x, 'query_count:') THEN 'query_count: 0' ELSE x END) ELSE list_append(h, 'query_count: 0') END AS h FROM h),
b AS (SELECT doc_id, body, CASE WHEN len(list_filter(h, lambda x: starts_with(x, 'confidence:'))) > 0 THEN list_transform(h, lambda x: CASE WHEN starts_with(x, 'confidence:') THEN 'confidence: medium' ELSE x END) ELSE list_append(h, 'confidence: medium') END AS h FROM a)
SELECT doc_id, md5('---' || chr(10) || array_to_string(h, chr(10)) || chr(10) || '---' || chr(10) || chr(10) || body) AS digest FROM b""",
    "entry_title": f"SELECT entry_no, {TITLE} AS title FROM gold_entries",
    "query_text": f"SELECT entry_no, {QTEXT} AS query_text FROM gold_entries",
    "thread_ids": "SELECT session_id, CASE WHEN project_id IS NULL OR branch IS NULL OR starts_with(branch, 'DETACHED@') THEN NULL ELSE substr(sha1(project_id || ':' || branch), 1, 16) END AS thread_id FROM sidecar",
    "id_collision": "SELECT entry_no, id, first_no FROM (SELECT entry_no, id, min(entry_no) OVER (PARTITION BY id) AS first_no FROM gold_entries WHERE id IS NOT NULL) WHERE entry_no > first_no",
    "llm_output_split": "SELECT entry_no, trim(id) AS id, entry_type, array_to_string(list_filter(list_transform(topics, lambda x: trim(x)), lambda x: x <> ''), '|') AS topics, CAST(query_count AS BIGINT) AS query_count, trim(summary) AS body FROM gold_entries WHERE summary IS NOT NULL AND coalesce(trim(id), '') <> '' AND coalesce(entry_type, '') <> '' AND entry_no % 17 <> 0 AND entry_no % 19 <> 0",
    "owned_fields": f"SELECT entry_no, array_to_string(source_sessions[1:1], '|') AS source_sessions, CASE WHEN len(projects) > 0 AND projects[1] <> 'unknown' THEN projects[1] ELSE array_to_string(projects, '|') END AS projects, '{TODAY}' AS created, '{TODAY}' AS last_validated, CAST(0 AS BIGINT) AS query_count, 'medium' AS confidence, array_to_string(coalesce(supersedes, []), '|') AS supersedes, nullif(thread_id, 'null') AS thread_id FROM gold_entries",
    "extract_prompt_meta": f"WITH {LATEST} SELECT session_id, concat_ws(chr(10), "
    + ", ".join(f"CASE WHEN coalesce({c}, '') NOT IN ('', 'null') THEN '{k}: ' || {c} END" for k, c in (("session_id", "session_id"), ("project", "coalesce(project, project_hash)"), ("agent", "agent"), ("cwd", "cwd"), ("git_branch", "git_branch"), ("thread_id", "thread_id")))
    + ") AS meta FROM latest WHERE status = 'silver'",
    "incremental_new": f"SELECT entry_no, id FROM gold_entries WHERE entry_no IN {NEW}",
    "index_visible": f"WITH {FIRST}, {VISIBLE} SELECT entry_no, id FROM vis",
    "vector_topk": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.e, v.e), 4) AS score FROM v q, v WHERE q.id % 100 = 0 AND q.id <> v.id)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s WHERE score >= 0.3 QUALIFY rank <= 5""",
    "bm25_topk": f"WITH {FIRST}, {VISIBLE} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM {_bm('body', 5)}",
    "hybrid_rrf": f"""WITH td AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), vs AS (SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.e, v.e), 4) AS score FROM v q, v WHERE q.id % 100 = 0 AND q.id <> v.id),
vk AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs WHERE score >= {VECTOR_SCORE} QUALIFY rank <= 20), f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, id, rank FROM {_bm('text', 20, 'td', 'doc_id', "split_part(text, chr(10), 1)", 'td')} UNION ALL SELECT * FROM vk) GROUP BY 1, 2) SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 5""",
    "read_path": f"""WITH {FIRST}, {VISIBLE}, t AS (SELECT * FROM {_bm('body', 1)}) SELECT q.entry_no AS query_id, CASE WHEN t.id IS NULL THEN 'No relevant entries found' ELSE coalesce(a.summary, '') END AS answer, a.confidence, strftime(a.last_validated, '%Y-%m-%d') AS last_validated,
coalesce(a.last_validated + try_cast(nullif(regexp_extract(a.staleness_policy, '^([0-9]+)d$', 1), '') AS INTEGER) < DATE '{TODAY}', false) AS stale FROM (SELECT entry_no FROM first WHERE entry_no % 100 = 0) q LEFT JOIN t ON t.query_id = q.entry_no LEFT JOIN first a ON a.entry_no = t.id""",
    "similarity_edges": f"WITH {EDGES} SELECT * FROM edges",
    "clusters_cc": f"WITH RECURSIVE {CC} SELECT id, cluster FROM comp",
    "clusters_thread": f"WITH {THREAD} SELECT * FROM tc",
    "proposals_valid": f"WITH RECURSIVE {CC} SELECT * FROM p",
    "approved_actions": f"WITH RECURSIVE {CC} SELECT * FROM p WHERE action IN ('duplicate', 'contradiction')",
    "noop_actions": f"WITH RECURSIVE {CC} SELECT action, count(*) AS n FROM p WHERE action IN ('related', 'unrelated') GROUP BY 1",
    "merge_duplicates": f"""WITH RECURSIVE {CC}, m AS (SELECT * FROM p JOIN mem USING (cluster) WHERE action = 'duplicate'), b AS (SELECT cluster, min(primary_id) AS primary_id, count(*) AS n_merged, coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (label IS NOT NULL))), '|'), '') AS topics FROM m GROUP BY 1),
o AS (SELECT cluster, string_agg(origin, '|' ORDER BY a0) AS sources FROM (SELECT cluster, origin, min(id) AS a0 FROM m WHERE origin IS NOT NULL GROUP BY 1, 2) GROUP BY 1) SELECT cluster, primary_id, n_merged, topics, coalesce(sources, '') AS sources FROM b LEFT JOIN o USING (cluster)""",
    "retired_entries": f"WITH RECURSIVE {CC} SELECT id, primary_id AS superseded_by, action || ': ' || substr(printf('%d members of cluster %d', n_members, cluster), 1, 200) AS retired_reason FROM p JOIN comp USING (cluster) WHERE action IN ('duplicate', 'contradiction') AND id <> primary_id",
    "rejudge_lookup": f"WITH {TMEM} SELECT cluster, (SELECT count(*) FROM tm WHERE tm.cluster = tj.cluster AND id % 9 > 0) AS found FROM tj WHERE action = 'subagent-needed'",
    "apply_all_exist": f"WITH RECURSIVE {CC} SELECT cluster, action, bool_and(label IS NOT NULL) AS all_exist FROM p JOIN mem USING (cluster) WHERE action IN ('duplicate', 'contradiction') GROUP BY 1, 2",
    "judge_prompt_size": f"WITH RECURSIVE {CC} SELECT cluster, CAST(sum(length(text) // 4) AS BIGINT) AS prompt_tokens FROM mem GROUP BY 1",
}
ORACLE["bm25_index"] = ORACLE["bm25_topk"]
