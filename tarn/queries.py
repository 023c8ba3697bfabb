"""One query for each operator over the test tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.engine import Engine
from tarn.functions import text as tx
from tarn.functions.snippets import snippet
from tarn.functions.vectors import HashEmbedder, chunk_column, dot, embed_chunks, normalize
from tarn.operators import catalog, metrics, vector
from tarn.operators.lexical import LexicalPlane, phrase
from tarn.operators.vector import VectorPlane
from tarn.plans.compiler import compile_expr, plan_label, row_bind
from tarn.plans.rql import parse
from tarn.plans.scope import Scope, effective
from tarn.schema import HYBRID_DEPTH
from tarn.sources import content as caes
from tarn.sources import extract, filesystem
from tarn.sources import testdata as td
from tarn.streaming import coalesce, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW_NS = td.EPOCH_NS + 500 * td.HOUR_NS

_CAT = """cat AS (
  SELECT d.doc_id AS oid, '/corpus/' || d.source || '/' || d.lang || '/doc' || d.doc_id || '.txt' AS path,
    CAST(strlen(d.text) AS BIGINT) AS size, 1704067200000000000 + d.doc_id * 3600000000000 AS mtime_ns,
    CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'quarantined' WHEN l.quality = 1 THEN 'complete' ELSE 'partial' END AS index_state,
    sha256(d.text) AS content_hash, d.text AS text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_TOK = """tok AS (SELECT oid, path, lower(t) AS term FROM (
    SELECT oid, path, unnest(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+')) AS t FROM cat) WHERE t <> '' AND strlen(t) < 40)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    rows = td.corpus(spark, sf_dir)
    content = td.content(rows)
    chunks = td.chunks(spark, sf_dir)
    return Engine(td.entries(rows), td.objects(rows), content, LexicalPlane.build(content), VectorPlane(chunks))


def probe_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return td.table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


# ---------------------------------------------------------------- predicates


def _rql(name: str, rql: str, where: str, onlyin: str | None = None, scope: Scope = Scope(), scope_sql: str = "true") -> None:
    @query(name, f"WITH {_CAT}, {_TOK} SELECT oid, path FROM cat WHERE ({where}) AND ({scope_sql})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir).query(rql, onlyin, scope, limit=None, now_ns=NOW_NS)


_has = lambda *terms: " AND ".join(f"oid IN (SELECT oid FROM tok WHERE term = '{t}')" for t in terms)
_src = lambda s: f"(path = '/corpus/{s}' OR path LIKE '/corpus/{s}/%')"

_rql("attr_cmp", "kMDItemFSSize > 1000", "CAST(size AS DOUBLE) > 1000")
_rql("attr_cmp_string_mismatch", 'kMDItemFSSize != "x" && kMDItemFSSize <= 400', "size <= 400")
_rql("attr_in_range", "InRange(kMDItemFSSize, 500, 2000)", "size BETWEEN 500 AND 2000")
_rql("attr_time", "kMDItemFSContentChangeDate >= $time.now(-36000)", f"CAST(mtime_ns AS DOUBLE) >= CAST({NOW_NS - 36_000_000_000_000} AS DOUBLE)")
_rql("name_glob", 'kMDItemFSName == "doc1*.txt"', "path LIKE '%/doc1%.txt'")
_rql("name_glob_ci", 'kMDItemDisplayName == "DOC2*.TXT"c', "lower(path) LIKE '%/doc2%.txt'")
_rql("name_glob_not", 'kMDItemFSName != "*7.txt"', "path NOT LIKE '%7.txt'")
_rql("state_glob", 'kRSDIndexState == "*t*e*"', "coalesce(index_state, '') LIKE '%t%e%'")
_rql("state_null", 'kRSDIndexState == ""', "index_state IS NULL")
_rql(
    "bool_mix",
    'kMDItemFSSize > 1000 && kMDItemFSName == "doc1*.txt" && !(kRSDIndexState == "quarantined")',
    "size > 1000 AND path LIKE '%/doc1%.txt' AND coalesce(index_state, '') <> 'quarantined'",
    "/corpus/src1", scope_sql=_src("src1"),
)
_rql("precedence", 'kMDItemFSSize < 200 || kMDItemFSSize > 5000 && !kRSDIndexState == "complete"', "size < 200 OR (size > 5000 AND coalesce(index_state, '') <> 'complete')")
_rql("onlyin_scope", "kMDItemFSSize >= 0", "true", "/corpus/src1", scope_sql=_src("src1"))
_rql("grant_intersection", "kMDItemFSSize >= 0", "true", "/corpus", Scope.of("/corpus/src2/en", "/corpus/src3"), "path LIKE '/corpus/src2/en/%' OR path LIKE '/corpus/src3/%'")
_rql("deny_all", "kMDItemFSSize >= 0", "false", "/corpus/src1", Scope.of("/corpus/src10"))
_rql("text_and", '"that with" && kMDItemFSSize >= 0', _has("that", "with"))
_rql("text_merge", '"that" && "from" && kMDItemFSSize < 3000', _has("that", "from") + " AND size < 3000")
_rql("text_not", '!"that" && kMDItemFSSize >= 0', "NOT (" + _has("that") + ")")
_rql("text_or_attr", '"idiot" || kMDItemFSSize < 200', "(" + _has("idiot") + ") OR size < 200")
_rql("text_attribute", 'kMDItemTextContent != "that" && kMDItemFSSize >= 0', _has("that"))
_rql("text_empty", '"..." && kMDItemFSSize >= 0', "false")
_rql("symbol_match", 'kRSDSymbols == "EN*" && kMDItemFSSize < 2000', "split_part(path, '/', 4) = 'en' AND size < 2000 OR lower(regexp_extract(text, '[A-Za-z]+')) = 'en' AND size < 2000")


@query("scan_order_limit", f"WITH {_CAT} SELECT oid, path FROM cat WHERE size > 1000 ORDER BY path LIMIT 25")
def scan_order_limit(spark, sf_dir):
    return engine(spark, sf_dir).query("kMDItemFSSize > 1000", limit=25)


@query("text_count", f"WITH {_CAT}, {_TOK} SELECT count(DISTINCT oid) AS n FROM tok WHERE term = 'that' AND {_src('src1')}")
def text_count(spark, sf_dir):
    return engine(spark, sf_dir).count('"that"', "/corpus/src1")


@query("scan_count", f"WITH {_CAT} SELECT count(*) AS n FROM cat WHERE size > 1000")
def scan_count(spark, sf_dir):
    return engine(spark, sf_dir).count("kMDItemFSSize > 1000")


@query("plan_labels", "SELECT * FROM (VALUES ('\"a\"', 'LexicalDirect'), ('semantic(\"a\")', 'VectorDirect'), ('\"a\" || \"b\"', 'CatalogScan(text_sets=2)')) AS t(query, plan)")
def plan_labels(spark, sf_dir):
    asked = ['"a"', 'semantic("a")', '"a" || "b"']
    return spark.createDataFrame([(q, plan_label(parse(q))) for q in asked], "query string, plan string")


@query("live_row_match", f"WITH {_CAT}, {_TOK} SELECT oid FROM cat WHERE ({_has('that', 'with')}) AND size > 1000")
def live_row_match(spark, sf_dir):
    rows = td.corpus(spark, sf_dir)
    return rows.where(compile_expr(parse('"that with" && kMDItemFSSize > 1000'), row_bind("text"))).select("oid")


# ---------------------------------------------------------------- scans


@query("catalog_listing", f"WITH {_CAT} SELECT path, oid, size FROM cat")
def catalog_listing(spark, sf_dir):
    rows = td.corpus(spark, sf_dir)
    return catalog.listing(td.entries(rows), td.objects(rows)).select("path", "oid", "size")


@query("subtree_scan", f"WITH {_CAT} SELECT path, oid FROM cat WHERE {_src('src1')}")
def subtree_scan(spark, sf_dir):
    return catalog.subtree(td.entries(td.corpus(spark, sf_dir)), "/corpus/src1").select("path", "oid")


@query("children_scan", f"WITH {_CAT} SELECT path, oid FROM cat WHERE path LIKE '/corpus/src1/en/%'")
def children_scan(spark, sf_dir):
    return catalog.children(td.entries(td.corpus(spark, sf_dir)), "/corpus/src1/en").select("path", "oid")


@query("point_lookups", f"WITH {_CAT} SELECT 'oid' AS by, oid FROM cat WHERE oid = 42 UNION ALL SELECT 'file', oid FROM cat WHERE oid = 7 UNION ALL SELECT 'path', oid FROM cat WHERE oid = (SELECT min(oid) FROM cat WHERE path LIKE '%/doc5.txt')")
def point_lookups(spark, sf_dir):
    rows = td.corpus(spark, sf_dir)
    o, e = td.objects(rows), td.entries(rows)
    lang = td.table(spark, sf_dir, "documents").where("doc_id = 5").select("source", "lang").first()
    found = [
        ("oid", catalog.by_oid(o, 42)),
        ("file", catalog.by_file_id(o, 1, 7)),
        ("path", catalog.by_path(e, f"/corpus/{lang['source']}/{lang['lang']}/doc5.txt")),
    ]
    out = None
    for by, df in found:
        part = df.select(F.lit(by).alias("by"), "oid")
        out = part if out is None else out.unionByName(part)
    return out


@query("content_bindings", f"WITH {_CAT} SELECT oid, content_hash, sha256('txt') AS hints_hash FROM cat")
def content_bindings(spark, sf_dir):
    return catalog.content_bindings(td.objects(td.corpus(spark, sf_dir)))


@query("table_counts", f"WITH {_CAT} SELECT count(*) AS entry_count, count(*) AS object_count FROM cat")
def table_counts(spark, sf_dir):
    rows = td.corpus(spark, sf_dir)
    return catalog.counts(td.entries(rows), td.objects(rows))


@query("status_counts", f"WITH {_CAT} SELECT count(path) AS entries, count(DISTINCT oid) AS objects FROM cat WHERE {_src('src1')}")
def status_counts(spark, sf_dir):
    return engine(spark, sf_dir).status(Scope.of("/corpus/src1"))


@query("effective_scopes", "SELECT * FROM (VALUES ('/a/b', '/a/b'), ('/a', '/a/b,/a/c'), ('/x', ''), ('/a/bb', '')) AS t(asked, scopes)")
def effective_scopes(spark, sf_dir):
    grants = Scope.of("/a/b", "/a/c")
    asked = ["/a/b", "/a", "/x", "/a/bb"]
    return spark.createDataFrame([(a, ",".join(sorted(effective(a, grants).prefixes))) for a in asked], "asked string, scopes string")


# ---------------------------------------------------------------- ranked retrieval

_BM25 = """post AS (SELECT oid, term, count(*) AS tf FROM tok GROUP BY oid, term),
len AS (SELECT c.oid, coalesce(n, 0) AS dl FROM cat c LEFT JOIN (SELECT oid, count(*) AS n FROM tok GROUP BY oid) t ON c.oid = t.oid),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""


def _bm25_sql(terms: list[str], k: int, tf: str = "1.0", where: str = "true") -> str:
    names = ", ".join(f"'{t}'" for t in terms)
    return f"""SELECT p.oid, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len.dl / st.avgdl))), 6) AS score
  FROM post p JOIN df ON p.term = df.term JOIN len ON p.oid = len.oid, st WHERE p.term IN ({names}) AND p.oid IN (SELECT oid FROM cat WHERE {where})
  GROUP BY p.oid HAVING count(*) = {len(terms)} ORDER BY score DESC, p.oid LIMIT {k}"""


@query("bm25_topk", f"WITH {_CAT}, {_TOK}, {_BM25} {_bm25_sql(['that', 'with'], 20)}")
def bm25_topk(spark, sf_dir):
    return engine(spark, sf_dir).search_text("that with", 20).select("oid", "score")


@query("bm25_topk_freq", f"WITH {_CAT}, {_TOK}, {_BM25} {_bm25_sql(['that', 'this'], 20, 'CAST(p.tf AS DOUBLE)')}")
def bm25_topk_freq(spark, sf_dir):
    return engine(spark, sf_dir).search_text("this that", 20, tf_mode="freq").select("oid", "score")


@query("bm25_scoped", f"WITH {_CAT}, {_TOK}, {_BM25} {_bm25_sql(['that'], 10, where=_src('src1'))}")
def bm25_scoped(spark, sf_dir):
    return engine(spark, sf_dir).search_text("that", 10, Scope.of("/corpus/src1")).select("oid", "score")


_BATCH = {"a": ["that"], "b": ["that", "with"], "c": ["from", "this"], "d": ["nowhereatall"]}


@query("bm25_batch", f"WITH {_CAT}, {_TOK}, {_BM25} " + " UNION ALL ".join(f"SELECT '{q}' AS query, * FROM ({_bm25_sql(t, 100)})" for q, t in _BATCH.items()))
def bm25_batch(spark, sf_dir):
    asked = spark.createDataFrame([(q, t) for q, terms in _BATCH.items() for t in terms], "query string, term string")
    return engine(spark, sf_dir).lexical.top_each(asked, 100)


@query("postings", f"WITH {_CAT}, {_TOK} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT oid, term, count(*) AS tf FROM tok GROUP BY oid, term) GROUP BY term")
def postings(spark, sf_dir):
    plane = LexicalPlane.build(td.corpus(spark, sf_dir).select("oid", "text"))
    return plane.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("phrase_match", f"WITH {_CAT}, {_TOK}, o AS (SELECT oid, term, row_number() OVER (PARTITION BY oid ORDER BY i) AS i FROM (SELECT oid, lower(t) AS term, i FROM (SELECT oid, unnest(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+')) AS t, unnest(range(len(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+')))) AS i FROM cat) WHERE t <> '' AND strlen(t) < 40)) SELECT DISTINCT a.oid FROM o a JOIN o b ON a.oid = b.oid AND b.i = a.i + 1 WHERE a.term = 'of' AND b.term = 'the'")
def phrase_match(spark, sf_dir):
    return phrase(td.corpus(spark, sf_dir), "Of the")


_VEC = """q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
sim AS (SELECT vec_id AS oid, round(list_dot_product(embedding::DOUBLE[], q.v), 6) AS score FROM embeddings, q)"""


@query("semantic_topk", f"WITH {_VEC} SELECT oid, score FROM sim ORDER BY score DESC, oid LIMIT 20")
def semantic_topk(spark, sf_dir):
    return VectorPlane(td.chunks(spark, sf_dir)).top(probe_vector(spark, sf_dir), 20).select("oid", "score")


@query("semantic_scoped", f"WITH {_CAT}, {_VEC} SELECT sim.oid, score FROM sim JOIN cat ON sim.oid = cat.oid WHERE {_src('src1')} ORDER BY score DESC, sim.oid LIMIT 10")
def semantic_scoped(spark, sf_dir):
    return engine(spark, sf_dir).semantic(probe_vector(spark, sf_dir), 10, Scope.of("/corpus/src1")).select("oid", "score")


@query("semantic_nested_not", f"WITH {_CAT}, {_VEC}, near AS (SELECT sim.oid FROM sim ORDER BY score DESC, oid LIMIT 256) SELECT oid, path FROM cat WHERE oid NOT IN (SELECT oid FROM near) AND size < 1000")
def semantic_nested_not(spark, sf_dir):
    e = engine(spark, sf_dir)
    vec = probe_vector(spark, sf_dir)

    class Given:
        id, version, dim = "given", 1, len(vec)

        def embed(self, text):
            return vec

    e.vectors = VectorPlane(td.chunks(spark, sf_dir), Given())
    return e.query('!semantic("probe") && kMDItemFSSize < 1000', limit=None)


@query("alert_threshold", f"WITH {_VEC} SELECT oid, score FROM sim WHERE greatest(score, 0) >= 0.35")
def alert_threshold(spark, sf_dir):
    return VectorPlane(td.chunks(spark, sf_dir)).alike(probe_vector(spark, sf_dir), 0.35)


@query("hybrid_rrf_tagged", f"""WITH {_CAT}, {_TOK}, {_BM25}, {_VEC},
lx AS (SELECT oid, row_number() OVER (ORDER BY score DESC, oid) - 1 AS r FROM ({_bm25_sql(['that'], 50)})),
sx AS (SELECT oid, row_number() OVER (ORDER BY score DESC, oid) - 1 AS r FROM (SELECT * FROM sim ORDER BY score DESC, oid LIMIT 50))
SELECT coalesce(lx.oid, sx.oid) AS oid, round(coalesce(1.0::DOUBLE / (60 + lx.r), 0) + coalesce(1.0::DOUBLE / (60 + sx.r), 0), 9) AS score,
  CASE WHEN lx.oid IS NOT NULL AND sx.oid IS NOT NULL THEN 'both' WHEN lx.oid IS NOT NULL THEN 'exact' ELSE 'meaning' END AS provenance
FROM lx FULL JOIN sx ON lx.oid = sx.oid ORDER BY score DESC, oid LIMIT 20""")
def hybrid_rrf_tagged(spark, sf_dir):
    e = engine(spark, sf_dir)
    return vector.fuse(e.lexical.top("that", 50), e.vectors.top(probe_vector(spark, sf_dir), 50), 20)


@query("hybrid_engine", f"""WITH {_CAT}, {_TOK}, {_BM25}, {_VEC},
lx AS (SELECT oid, row_number() OVER (ORDER BY score DESC, oid) - 1 AS r FROM ({_bm25_sql(['that', 'with'], HYBRID_DEPTH, where=_src('src1'))})),
sx AS (SELECT oid, row_number() OVER (ORDER BY score DESC, oid) - 1 AS r FROM (SELECT sim.oid, score FROM sim JOIN cat ON sim.oid = cat.oid WHERE {_src('src1')} ORDER BY score DESC, sim.oid LIMIT {HYBRID_DEPTH})),
f AS (SELECT coalesce(lx.oid, sx.oid) AS oid, round(coalesce(1.0::DOUBLE / (60 + lx.r), 0) + coalesce(1.0::DOUBLE / (60 + sx.r), 0), 9) AS score,
  CASE WHEN lx.oid IS NOT NULL AND sx.oid IS NOT NULL THEN 'both' WHEN lx.oid IS NOT NULL THEN 'exact' ELSE 'meaning' END AS provenance
  FROM lx FULL JOIN sx ON lx.oid = sx.oid ORDER BY score DESC, oid LIMIT 20)
SELECT f.oid, score, provenance, path FROM f JOIN cat ON f.oid = cat.oid""")
def hybrid_engine(spark, sf_dir):
    found = engine(spark, sf_dir).hybrid("that with", 20, "/corpus/src1", vector_query=probe_vector(spark, sf_dir))
    return found.select("oid", "score", "provenance", "path")


@query("search_modes", f"""WITH {_CAT}, {_TOK}, {_BM25} SELECT t.oid, path, 'lexical' AS mode FROM ({_bm25_sql(['that', 'with'], 5)}) t JOIN cat ON t.oid = cat.oid
UNION ALL SELECT * FROM (SELECT oid, path, 'rql' AS mode FROM cat WHERE size > 1500 ORDER BY path LIMIT 5)""")
def search_modes(spark, sf_dir):
    e = engine(spark, sf_dir)
    lexical = e.search('"that" with', "lexical", 5).withColumn("mode", F.lit("lexical"))
    return lexical.unionByName(e.search("kMDItemFSSize > 1500", "rql", 5).withColumn("mode", F.lit("rql")))


@query("snippets", rf"""WITH {_CAT}, f AS (SELECT oid, text, strpos(text, 'that') AS p, strpos(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'that') AS q FROM cat),
h AS (SELECT oid, text, CASE WHEN p > 0 THEN p WHEN q > 0 THEN q ELSE 1 END - 1 AS c FROM f),
b AS (SELECT *, strlen(substr(text, 1, c)) AS off, strlen(text) AS n FROM h),
w AS (SELECT *, greatest(0, off - 60) AS lo, least(n, off + 140) AS hi FROM b),
e AS (SELECT oid, text, list_max(list_filter(range(greatest(0, c - 61), c + 1), lambda i: strlen(substr(text, 1, CAST(i AS INTEGER))) <= lo)) AS s0,
  list_max(list_filter(range(c, c + 142), lambda i: strlen(substr(text, 1, CAST(i AS INTEGER))) <= hi)) AS e0 FROM w)
SELECT oid, CAST(strlen(substr(text, 1, CAST(s0 AS INTEGER))) AS INTEGER) AS start, CAST(strlen(substr(text, 1, CAST(e0 AS INTEGER))) AS INTEGER) AS "end",
  trim(regexp_replace(substr(text, CAST(s0 + 1 AS INTEGER), CAST(e0 - s0 AS INTEGER)), '[\s\x0B\x1C-\x1F\x85\xA0\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')) AS text FROM e""")
def snippets(spark, sf_dir):
    return td.corpus(spark, sf_dir).select("oid", snippet("text", "that it").alias("s")).select("oid", "s.start", "s.end", "s.text")


@query("other_scripts", rf"""WITH {_CAT}, t AS (SELECT oid, 'किताब ' || (oid % 7) || ' ภาษาไทย_कि' || (oid % 3) || ' كِتاب ' AS text FROM cat)
SELECT oid, 5 + 0 * oid AS n_tokens, (oid % 7 = 3) AS hit FROM t""")
def other_scripts(spark, sf_dir):
    """Tokens of texts in scripts with combining vowels, and a search for two of them."""
    n = lambda k: (F.col("oid") % k).cast("string")
    docs = td.corpus(spark, sf_dir).select("oid", F.concat(F.lit("किताब "), n(7), F.lit(" ภาษาไทย_कि"), n(3), F.lit(" كِتاب ")).alias("text"))
    found = LexicalPlane.build(docs).matching(tx.query_tokens("3 *किताब")).withColumn("hit", F.lit(True))
    rows = docs.select("oid", F.size(tx.tokens("text")).cast("long").alias("n_tokens")).join(found, "oid", "left")
    return rows.select("oid", "n_tokens", F.coalesce("hit", F.lit(False)).alias("hit"))


# ---------------------------------------------------------------- the fold

_JOURNAL = """j AS (SELECT event_id + 1 AS lsn, epoch_us(ts) * 1000 AS wall, '/ev/u' || user_id || '.dat' AS path,
  CASE event_type WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'content' ELSE 'upsert' END AS op,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS ino, CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END AS birth,
  CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS mtime, 'h' || event_id AS h FROM events),
u0 AS (SELECT *, lag(birth) OVER w IS DISTINCT FROM birth AS fresh, lag(mtime) OVER w IS DISTINCT FROM mtime AS changed FROM j WHERE op = 'upsert' WINDOW w AS (PARTITION BY ino ORDER BY lsn)),
u1 AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY ino ORDER BY lsn) AS gen FROM u0),
isl AS (SELECT ino, gen, min(lsn) AS oid FROM u1 GROUP BY ino, gen),
isl2 AS (SELECT *, lead(oid) OVER (PARTITION BY ino ORDER BY gen) AS ends FROM isl),
u AS (SELECT u1.*, oid, ends FROM u1 JOIN isl2 USING (ino, gen)),
pe AS (SELECT lsn, wall, path, oid, ends FROM u UNION ALL SELECT lsn, wall, path, NULL, NULL FROM j WHERE op = 'remove'),
pb AS (SELECT *, lead(lsn) OVER w AS nxt, lead(wall) OVER w AS nxt_wall,
   CASE WHEN row_number() OVER w = 1 OR lag(oid) OVER w IS DISTINCT FROM oid THEN lsn END AS start FROM pe WINDOW w AS (PARTITION BY path ORDER BY lsn)),
pc AS (SELECT *, max(start) OVER (PARTITION BY path ORDER BY lsn) AS attach FROM pb),
ent AS (SELECT path, oid, attach FROM pc WHERE nxt IS NULL AND oid IS NOT NULL AND ends IS NULL),
att AS (SELECT oid, arg_max(ino, lsn) AS ino, arg_max(mtime, lsn) AS mtime, max(lsn) FILTER (fresh OR changed) AS cleared FROM u WHERE ends IS NULL GROUP BY oid),
cs AS (SELECT j.lsn, j.h, p.oid FROM j ASOF JOIN pe p ON j.path = p.path AND j.lsn >= p.lsn WHERE j.op = 'content' AND p.oid IS NOT NULL AND (p.ends IS NULL OR p.ends > j.lsn)),
cl AS (SELECT oid, arg_max(h, lsn) AS h, max(lsn) AS at_lsn FROM cs GROUP BY oid)"""


@query("journal_fold_entries", f"WITH {_JOURNAL} SELECT path, oid, attach AS attach_lsn FROM ent")
def journal_fold_entries(spark, sf_dir):
    return catalog.entries(td.journal(spark, sf_dir))


@query("journal_fold_objects", f"""WITH {_JOURNAL} SELECT att.oid, att.ino, att.ino + 100 AS size, CAST(att.mtime AS BIGINT) AS mtime_ns,
  CASE WHEN cl.at_lsn > cleared THEN cl.h END AS content_hash,
  coalesce((SELECT string_agg(path, ',' ORDER BY attach) FROM ent WHERE ent.oid = att.oid), '') AS paths,
  CASE WHEN NOT EXISTS (SELECT 1 FROM ent WHERE ent.oid = att.oid) THEN (SELECT max(nxt_wall) FROM pc WHERE pc.oid = att.oid) END AS orphaned_at_ns
FROM att LEFT JOIN cl ON att.oid = cl.oid""")
def journal_fold_objects(spark, sf_dir):
    rows = catalog.objects(td.journal(spark, sf_dir))
    return rows.select("oid", "ino", "size", "mtime_ns", "content_hash", F.array_join("entry_paths", ",").alias("paths"), "orphaned_at_ns")


_DELTA = """b AS (SELECT lsn, path, oid AS new_oid, CASE WHEN lag(ends) OVER w IS NULL OR lag(ends) OVER w > lsn THEN lag(oid) OVER w END AS old_oid FROM pe WINDOW w AS (PARTITION BY path ORDER BY lsn))"""


@query("journal_deltas", f"WITH {_JOURNAL}, {_DELTA} SELECT b.lsn, b.path, old_oid, new_oid, u.ino + 100 AS size FROM b LEFT JOIN u ON b.lsn = u.lsn WHERE b.lsn > 500")
def journal_deltas(spark, sf_dir):
    return catalog.deltas(td.journal(spark, sf_dir), 500).select("lsn", "path", "old_oid", "new_oid", "size")


_EARLIER = _JOURNAL.replace("FROM events)", "FROM events WHERE event_id < 600)")


@query("journal_invariants", f"""WITH now AS (WITH {_JOURNAL} SELECT oid, path FROM ent), old AS (WITH {_EARLIER} SELECT oid, path FROM ent)
SELECT * FROM (SELECT 'listed path maps elsewhere' AS rule, count(*) AS n FROM (FROM now EXCEPT FROM old) UNION ALL SELECT 'entry not listed', count(*) FROM (FROM old EXCEPT FROM now)) WHERE n > 0""")
def journal_invariants(spark, sf_dir):
    """None broken by the fold itself; and those that entries of an earlier state break beside the present objects."""
    j = td.journal(spark, sf_dir)
    now = catalog.objects(j)
    sound = catalog.invariant_violations(now, catalog.entries(j))
    return sound.unionByName(catalog.invariant_violations(now, catalog.entries(catalog.as_of(j, 600))))


@query("orphan_scan", f"WITH {_JOURNAL} SELECT att.oid FROM att WHERE NOT EXISTS (SELECT 1 FROM ent WHERE ent.oid = att.oid) AND (SELECT max(nxt_wall) FROM pc WHERE pc.oid = att.oid) <= 1706572800000000000 - 10000000000")
def orphan_scan(spark, sf_dir):
    return catalog.orphans(catalog.objects(td.journal(spark, sf_dir)), 1_706_572_800_000_000_000, 10_000_000_000)


@query("orphan_sweep", f"WITH {_JOURNAL} SELECT att.oid FROM att WHERE EXISTS (SELECT 1 FROM ent WHERE ent.oid = att.oid) OR (SELECT max(nxt_wall) FROM pc WHERE pc.oid = att.oid) > 1706572800000000000 - 10000000000")
def orphan_sweep(spark, sf_dir):
    return catalog.sweep(catalog.objects(td.journal(spark, sf_dir)), 1_706_572_800_000_000_000, 10_000_000_000).select("oid")


@query("as_of", f"WITH {_EARLIER} SELECT path, oid, attach AS attach_lsn FROM ent")
def as_of(spark, sf_dir):
    return catalog.entries(catalog.as_of(td.journal(spark, sf_dir), 600))


@query("changed_since", f"WITH {_JOURNAL}, {_DELTA} SELECT path, max(lsn) AS lsn FROM b WHERE lsn > 600 AND old_oid IS DISTINCT FROM new_oid GROUP BY path")
def changed_since(spark, sf_dir):
    return catalog.changed_since(td.journal(spark, sf_dir), 600)


@query("projection_plan", f"WITH {_JOURNAL}, {_DELTA}, t AS (SELECT DISTINCT o AS oid FROM (SELECT unnest([old_oid, new_oid]) AS o FROM b WHERE lsn > 500) WHERE o IS NOT NULL) SELECT t.oid, CASE WHEN cl.at_lsn > att.cleared THEN 'refresh' ELSE 'remove' END AS action FROM t LEFT JOIN att ON t.oid = att.oid LEFT JOIN cl ON t.oid = cl.oid")
def projection_plan(spark, sf_dir):
    j = td.journal(spark, sf_dir)
    return catalog.touched_oids(catalog.deltas(j, 500), catalog.objects(j))


@query("journal_replay", f"WITH {_JOURNAL} SELECT lsn, op, path FROM j WHERE lsn >= 900")
def journal_replay(spark, sf_dir):
    return td.journal(spark, sf_dir).where("lsn >= 900").orderBy("lsn").select("lsn", "op", "path")


# ---------------------------------------------------------------- standing queries


@query("live_enter_leave", f"""WITH {_JOURNAL}, {_DELTA}, obs AS (SELECT b.lsn, b.path, coalesce(new_oid, old_oid) AS oid, new_oid IS NOT NULL AND u.ino + 100 >= 150 AS m
  FROM b LEFT JOIN u ON b.lsn = u.lsn WHERE coalesce(new_oid, old_oid) IS NOT NULL),
w AS (SELECT *, lag(m, 1, false) OVER (PARTITION BY oid ORDER BY lsn) AS was FROM obs)
SELECT 'big' AS view_id, oid, lsn, path, CASE WHEN m THEN 'enter' ELSE 'leave' END AS event FROM w WHERE m <> was""")
def live_enter_leave(spark, sf_dir):
    deltas = _view_rows(catalog.deltas(td.journal(spark, sf_dir)))
    return live.events(live.observations(deltas, [live.View.of("big", "kMDItemFSSize >= 150")]))


@query("live_membership", f"""WITH {_JOURNAL}, {_DELTA}, obs AS (SELECT b.lsn, coalesce(new_oid, old_oid) AS oid, new_oid IS NOT NULL AND u.ino + 100 >= 150 AS m
  FROM b LEFT JOIN u ON b.lsn = u.lsn WHERE coalesce(new_oid, old_oid) IS NOT NULL)
SELECT 'big' AS view_id, oid FROM (SELECT oid, arg_max(m, lsn) AS m FROM obs GROUP BY oid) WHERE m""")
def live_membership(spark, sf_dir):
    deltas = _view_rows(catalog.deltas(td.journal(spark, sf_dir)))
    return live.membership(live.observations(deltas, [live.View.of("big", "kMDItemFSSize >= 150")]))


@query("live_scoped_views", f"""WITH {_JOURNAL}, {_DELTA}, obs AS (SELECT v, b.lsn, b.path, coalesce(new_oid, old_oid) AS oid, new_oid IS NOT NULL AND CASE v WHEN 'odd' THEN u.mtime = 2 ELSE u.ino + 100 < 120 END AS m
  FROM b LEFT JOIN u ON b.lsn = u.lsn, (VALUES ('odd'), ('small')) AS t(v) WHERE coalesce(new_oid, old_oid) IS NOT NULL AND (v = 'small' OR b.path = '/ev/u1.dat')),
w AS (SELECT *, lag(m, 1, false) OVER (PARTITION BY v, oid ORDER BY lsn) AS was FROM obs)
SELECT v AS view_id, oid, lsn, CASE WHEN m THEN 'enter' ELSE 'leave' END AS event FROM w WHERE m <> was""")
def live_scoped_views(spark, sf_dir):
    views = [
        live.View.of("odd", "kMDItemFSContentChangeDate == 2", Scope.of("/ev/u1.dat")),
        live.View.of("small", "kMDItemFSSize < 120"),
    ]
    deltas = _view_rows(catalog.deltas(td.journal(spark, sf_dir)))
    return live.events(live.observations(deltas, views)).select("view_id", "oid", "lsn", "event")


def _view_rows(deltas: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return deltas.withColumns({"index_state": none, "text": none, "symbols": F.lit(None).cast("array<struct<name:string,kind:string,line:int>>")})


@query("live_resync", f"""WITH {_JOURNAL}, {_DELTA}, obs AS (SELECT v, b.lsn, b.path, coalesce(new_oid, old_oid) AS oid, new_oid IS NOT NULL AND u.ino + 100 >= 150 AS m
  FROM b LEFT JOIN u ON b.lsn = u.lsn, (VALUES ('all'), ('one'), ('two')) AS t(v) WHERE coalesce(new_oid, old_oid) IS NOT NULL AND (v = 'all' OR (v = 'one' AND b.path = '/ev/u1.dat') OR (v = 'two' AND b.path IN ('/ev/u2.dat', '/ev/u3.dat')))),
w AS (SELECT *, lag(m, 1, false) OVER (PARTITION BY v, oid ORDER BY lsn) AS was FROM obs),
c AS (SELECT v, oid, lsn, CASE WHEN m THEN 'enter' ELSE 'leave' END AS event, count(*) OVER (PARTITION BY v) AS n FROM w WHERE m <> was)
SELECT v AS view_id, oid, lsn, event FROM c WHERE n <= 16 UNION ALL SELECT DISTINCT v, NULL::BIGINT, NULL::BIGINT, 'resync' FROM c WHERE n > 16""")
def live_resync(spark, sf_dir):
    of = lambda id, *scopes: live.View.of(id, "kMDItemFSSize >= 150", *([Scope.of(*scopes)] if scopes else []))
    views = [of("all"), of("one", "/ev/u1.dat"), of("two", "/ev/u2.dat", "/ev/u3.dat")]
    deltas = _view_rows(catalog.deltas(td.journal(spark, sf_dir)))
    return live.deliver(live.events(live.observations(deltas, views)), 16).select("view_id", "oid", "lsn", "event")


# ---------------------------------------------------------------- ingest


def _bursts(spark, sf_dir) -> DataFrame:
    events = td.table(spark, sf_dir, "events")
    path = F.concat(F.lit("/ev/u"), (F.col("user_id") % 20).cast("string"), F.lit(".dat"))
    return events.select(path.alias("path"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "signup").alias("rescan_recursive"))


@query("coalesce_sessions", """WITH e AS (SELECT '/ev/u' || (user_id % 20) || '.dat' AS path, ts, CASE WHEN event_type = 'signup' THEN 2 ELSE 0 END AS kind FROM events),
f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS fresh FROM e),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts) AS grp FROM f)
SELECT path, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, CAST(max(kind) AS INTEGER) AS kind, count(*) AS n FROM g GROUP BY path, grp""")
def coalesce_sessions(spark, sf_dir):
    out = coalesce.sessions(_bursts(spark, sf_dir), quiet_ms=600_000)
    return out.select("path", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "kind", "n")


@query("coalesce_capped", """WITH RECURSIVE e AS (SELECT '/ev/u' || (user_id % 20) || '.dat' AS path, CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS ms, CASE WHEN event_type = 'signup' THEN 2 ELSE 0 END AS kind,
    row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts) AS i FROM events),
w AS (SELECT path, ms, i, ms AS first_ms FROM e WHERE i = 1
  UNION ALL SELECT e.path, e.ms, e.i, CASE WHEN e.ms - w.ms >= 600000 OR e.ms - w.first_ms >= 900000 THEN e.ms ELSE w.first_ms END FROM w JOIN e ON e.path = w.path AND e.i = w.i + 1)
SELECT w.path, w.first_ms, max(w.ms) AS last_ms, CAST(max(kind) AS INTEGER) AS kind, count(*) AS n FROM w JOIN e ON w.path = e.path AND w.i = e.i GROUP BY w.path, w.first_ms""")
def coalesce_capped(spark, sf_dir):
    return coalesce.work_items(_bursts(spark, sf_dir), 600_000, 900_000).drop("due_ms")


@query("overflow_collapse", """WITH w AS (SELECT '/ev/u' || (user_id % 20) || '/' || (event_id % 50) || '.dat' AS path, '/ev/u' || (user_id % 20) AS folder,
  CASE WHEN event_type = 'signup' THEN 2 ELSE 0 END AS kind, user_id % 20 = 3 AS known FROM events),
k AS (SELECT DISTINCT path FROM w WHERE NOT known ORDER BY path LIMIT 40),
o AS (SELECT CASE WHEN over THEN folder ELSE path END AS path, CASE WHEN over THEN greatest(kind, 1) ELSE kind END AS kind
  FROM (SELECT *, NOT known AND path NOT IN (FROM k) AS over FROM w))
SELECT path, CAST(max(kind) AS INTEGER) AS kind FROM o GROUP BY path""")
def overflow_collapse(spark, sf_dir):
    events = td.table(spark, sf_dir, "events")
    user, file = (F.col("user_id") % 20).cast("string"), (F.col("event_id") % 50).cast("string")
    kind = F.when(F.col("event_type") == "signup", 2).otherwise(0)
    work = events.select(F.concat(F.lit("/ev/u"), user, F.lit("/"), file, F.lit(".dat")).alias("path"), kind.alias("kind"), (user == "3").alias("known"))
    return coalesce.collapse(work, 10, 50)


@query("path_exclusion", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/w/.git/x' WHEN 1 THEN '/w/gitlab/x' WHEN 2 THEN '/w/a/Library' ELSE '/w/b/c' END AS path FROM pages WHERE page_id % 4 IN (1, 3)")
def path_exclusion(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, ["/w/.git/x", "/w/gitlab/x", "/w/a/Library", "/w/b/c"])), (F.col("page_id") % 4 + 1).cast("int"))
    return td.table(spark, sf_dir, "pages").select("page_id", path.alias("path")).where(~filesystem.excluded("path"))


@query("event_flags", "SELECT event_id, (event_id & 1) <> 0 OR ((event_id & 2048) <> 0 AND (event_id & 4096) <> 0) OR (event_id & 6) <> 0 AS recursive FROM events")
def event_flags(spark, sf_dir):
    # bits 2048 (renamed) and 4096 stand in for the folder bit, which is beyond small ids
    flags = F.col("event_id").bitwiseAND(4095) + F.when(F.col("event_id").bitwiseAND(4096) != 0, filesystem.FLAGS["is_dir"]).otherwise(0)
    flags = flags - F.when(flags.bitwiseAND(256) != 0, 256).otherwise(0)
    rows = td.table(spark, sf_dir, "events").select(F.lit("/a").alias("path"), "event_id", flags.alias("flags"))
    return filesystem.ingest_events(rows).select("event_id", F.col("rescan_recursive").alias("recursive"))


@query("reconcile_diff", f"WITH {_CAT} SELECT CASE WHEN oid % 5 = 0 THEN 'remove' ELSE 'upsert' END AS op, path FROM cat WHERE path LIKE '/corpus/src1/en/%'")
def reconcile_diff(spark, sf_dir):
    rows = td.corpus(spark, sf_dir)
    folder = spark.createDataFrame([("/corpus/src1/en",)], "path string")
    stat = rows.where("path LIKE '/corpus/src1/en/%' AND oid % 5 <> 0")
    listed = stat.select("path", "kind", F.lit(1).cast("long").alias("dev"), F.col("oid").alias("ino"), "size", "mtime_ns", F.lit(0).cast("long").alias("birthtime_ns"), F.lit(1).cast("long").alias("nlink"))
    return filesystem.reconcile(listed, folder, td.entries(rows), td.objects(rows)).select("op", "path")


@query("subtree_removal", f"WITH {_CAT} SELECT path FROM cat WHERE path LIKE '/corpus/src2/%'")
def subtree_removal(spark, sf_dir):
    rows = td.corpus(spark, sf_dir)
    folder = spark.createDataFrame([(-1, "/corpus/src2", "dir")], "oid long, path string, kind string")
    objects = rows.select("oid", "kind").unionByName(folder.select("oid", "kind"))
    entries = rows.select("path", "oid").unionByName(folder.select("path", "oid"))
    return filesystem.removals(folder.select("path"), entries, objects).where("path <> '/corpus/src2'")


@query("content_gates", f"WITH {_CAT} SELECT oid, CASE WHEN index_state IS NOT NULL AND oid % 3 <> 0 THEN 'skip' ELSE 'index' END AS action FROM cat")
def content_gates(spark, sf_dir):
    rows = td.corpus(spark, sf_dir)
    files = rows.select("oid", "path", (F.col("size") + F.when(F.col("oid") % 3 == 0, 1).otherwise(0)).alias("size"), "mtime_ns")
    return caes.gate(files, rows).select("oid", "action")


@query("caes_dedup", f"WITH {_CAT}, w AS (SELECT content_hash FROM cat GROUP BY content_hash) SELECT content_hash FROM w WHERE content_hash NOT IN (SELECT content_hash FROM cat WHERE oid % 2 = 0)")
def caes_dedup(spark, sf_dir):
    rows = td.corpus(spark, sf_dir)
    keys = [F.lit(extract.EXTRACTOR_ID).alias("extractor_id"), F.lit(1).alias("extractor_version"), F.lit("h").alias("hints_hash"), F.lit(1).alias("abi_version")]
    wanted = rows.select("content_hash", *keys)
    return caes.misses(wanted, rows.where("oid % 2 = 0").select("content_hash", *keys)).select("content_hash")


@query("quarantine_rule", f"WITH {_CAT} SELECT content_hash, CASE WHEN min(oid) % 4 >= 3 THEN 'quarantined' ELSE 'corrupt' END AS status FROM cat GROUP BY content_hash")
def quarantine_rule(spark, sf_dir):
    rows = td.corpus(spark, sf_dir).groupBy("content_hash").agg(F.min("oid").alias("oid"))
    records = rows.select("content_hash", F.lit("corrupt").alias("status"))
    return caes.quarantine(records, rows.select("content_hash", (F.col("oid") % 4).alias("n")))


@query("html_extraction", "SELECT page_id, 'complete' AS status, sha256(html) AS text_hash FROM pages")
def html_extraction(spark, sf_dir):
    pages = td.table(spark, sf_dir, "pages")
    path = F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html"))
    files = pages.select("page_id", path.alias("path"), F.col("html").cast("binary").alias("content"), F.octet_length("html").cast("long").alias("length"))
    return extract.extract_files(files, keys=("page_id",)).select("page_id", "status", F.sha2("text", 256).alias("text_hash"))


# ---------------------------------------------------------------- functions


@query("analyzer_tokens", f"WITH {_CAT}, {_TOK} SELECT oid, count(*) AS n, count(DISTINCT term) AS n_distinct FROM tok GROUP BY oid")
def analyzer_tokens(spark, sf_dir):
    rows = td.corpus(spark, sf_dir).select("oid", tx.tokens("text").alias("t")).where("size(t) > 0")
    return rows.select("oid", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("path_functions", f"WITH {_CAT} SELECT oid, 'doc' || oid || '.txt' AS name, 'txt' AS ext, regexp_replace(path, '/[^/]*$', '') AS folder, '/corpus,' || '/corpus/' || split_part(path, '/', 3) AS above FROM cat")
def path_functions(spark, sf_dir):
    above = F.array_join(F.slice(tx.ancestors("path"), 1, 2), ",")
    return td.corpus(spark, sf_dir).select("oid", tx.basename("path").alias("name"), tx.extension("path").alias("ext"), tx.parent("path").alias("folder"), above.alias("above"))


@query("subtitle_strip", r"SELECT page_id, 'Hello ' || page_id || chr(10) || 'second line' AS text FROM pages")
def subtitle_strip(spark, sf_dir):
    n = F.col("page_id").cast("string")
    srt = F.concat(F.lit("WEBVTT\n\n1\n00:00:01,000 --> 00:00:02,000\nHello "), n, F.lit("\r\n\n2\n00:00:03,000 --> 00:00:04,000\n  second line \nNOTE done\n"))
    return td.table(spark, sf_dir, "pages").select("page_id", tx.strip_subtitles(srt).alias("text"))


@query("percent_decode", f"WITH {_CAT} SELECT oid, sha256(text || ' %ZZ%4') AS text_hash FROM cat")
def percent_decode(spark, sf_dir):
    """Whole texts, percent-encoded and back, with broken escapes behind them."""
    encoded = F.concat(F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20")), F.lit("+%ZZ%4"))
    return td.corpus(spark, sf_dir).select("oid", F.sha2(tx.percent_decode(encoded), 256).alias("text_hash"))


@query("truncate_bytes", rf"""WITH {_CAT} SELECT oid, substr(text, 1, CAST(list_max(list_filter(range(0, 102), lambda i: strlen(substr(text, 1, CAST(i AS INTEGER))) <= 101)) AS INTEGER)) AS text FROM cat""")
def truncate_bytes(spark, sf_dir):
    return td.corpus(spark, sf_dir).select("oid", tx.truncate_bytes("text", 101).alias("text"))


@query("chunking", f"WITH {_CAT} SELECT oid, 0 AS \"offset\", text FROM cat WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def chunking(spark, sf_dir):
    parts = td.corpus(spark, sf_dir).select("oid", F.explode(chunk_column("text")).alias("c"))
    return parts.select("oid", "c.offset", "c.text")


@query("hash_embedding")
def hash_embedding(spark, sf_dir):
    chunks = embed_chunks(td.corpus(spark, sf_dir), HashEmbedder())
    return chunks.select("oid", "chunk_offset", F.round(dot("vec", F.col("vec")), 4).alias("norm"))


@query("vector_normalize", "SELECT vec_id AS oid, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 3) + 0.0 AS first, round(embedding[64]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 3) + 0.0 AS last FROM embeddings")
def vector_normalize(spark, sf_dir):
    vec = normalize(F.transform("vec", lambda x: x * 3))
    return td.chunks(spark, sf_dir).select("oid", (F.round(vec[0].cast("double"), 3) + 0.0).alias("first"), (F.round(vec[63].cast("double"), 3) + 0.0).alias("last"))


# ---------------------------------------------------------------- metrics

_BOUNDS = ", ".join(map(str, metrics.BOUNDS_MS))
_HIST = f"""h AS (SELECT event_type AS metric, coalesce(list_position(list_transform([{_BOUNDS}], lambda b: value <= b), true), 19) - 1 AS bucket, count(*) AS n, CAST(sum(CAST(trunc(value * 1000) AS BIGINT)) AS BIGINT) AS sum_us
  FROM events GROUP BY ALL)"""


@query("latency_histogram", f"WITH {_HIST} SELECT metric, CAST(bucket AS INTEGER) AS bucket, n, sum_us FROM h")
def latency_histogram(spark, sf_dir):
    return metrics.histogram(td.table(spark, sf_dir, "events").withColumnRenamed("event_type", "metric"), "value", ["metric"])


@query("histogram_percentile", f"""WITH {_HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY metric ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY metric) AS total FROM h),
m AS (SELECT *, ([0.0, {_BOUNDS}, 60000.0][CAST(bucket + 1 AS INTEGER)] + [0.0, {_BOUNDS}, 60000.0][CAST(bucket + 2 AS INTEGER)])::DOUBLE / 2 AS mid FROM c)
SELECT metric, CAST(sum(n) AS BIGINT) AS count, arg_min(mid, bucket) FILTER (cum >= ceil(0.5 * total)) AS p50_ms, arg_min(mid, bucket) FILTER (cum >= ceil(0.9 * total)) AS p90_ms,
  arg_min(mid, bucket) FILTER (cum >= ceil(0.99 * total)) AS p99_ms FROM m GROUP BY metric""")
def histogram_percentile(spark, sf_dir):
    return metrics.histogram_report(latency_histogram(spark, sf_dir), ["metric"]).drop("mean_ms")


@query("failure_status_counts", f"WITH {_CAT} SELECT 'quarantined' AS failure, count(*) AS n FROM cat WHERE index_state = 'quarantined' HAVING count(*) > 0")
def failure_status_counts(spark, sf_dir):
    return metrics.failure_counts(td.corpus(spark, sf_dir), "index_state")


@query("counters_gauges", "SELECT event_type AS metric, round(sum(value), 2) AS total, arg_max(value, event_id) AS last FROM events GROUP BY event_type")
def counters_gauges(spark, sf_dir):
    rows = td.table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value", F.col("event_id").alias("at"))
    last = metrics.gauges(rows).withColumnRenamed("value", "last")
    return metrics.counters(rows).withColumn("total", F.round("total", 2)).join(last, "metric")


@query("metrics_snapshot")
def metrics_snapshot(spark, sf_dir):
    rows = td.table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value", F.col("event_id").alias("at"))
    return metrics.snapshot(metrics.counters(rows), metrics.gauges(rows), latency_histogram(spark, sf_dir), failure_status_counts(spark, sf_dir))
