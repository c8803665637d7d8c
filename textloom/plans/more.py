"""Further registered queries: stores, sets, mining, records and browsing, each over whole tables with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.database import join_through
from textloom.functions import documents as D
from textloom.functions import records as R
from textloom.functions import tokens as T
from textloom.operators import graph as G
from textloom.operators import index as I
from textloom.operators import mining as M
from textloom.operators import stores as S
from textloom.operators.search import Index, search
from textloom.plans.catalogue import INDEXES, _POST, _TOK, _docs, _rounded, _stored, _table
from textloom.sources import records as P
from textloom.storage import shared_dir

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return register


def _fresh(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


# search and browsing


@_query(f"SELECT doc_id FROM documents WHERE (list_contains({_W}, 'the') OR list_contains({_W}, 'der')) AND NOT list_contains({_W}, 'of') AND n_chars > 500")
def scan_access(spark, sf_dir):
    """A query over the rows themselves, without an index."""
    return search(_docs(spark, sf_dir), 'text any "the der" not text any "of" and n_chars > 500', INDEXES, "text")


@_query(f"WITH {_POST} SELECT term, row_number() OVER (ORDER BY term) - 1 AS place FROM df")
def term_ids(spark, sf_dir):
    terms = _stored(spark, sf_dir).terms("text")
    first = terms.agg(F.min("term_id").alias("first__"))
    return terms.crossJoin(F.broadcast(first)).select("term", (F.col("term_id") - F.col("first__")).alias("place"))


@_query(f"SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents WHERE list_contains({_W}, 'the')")
def sorted_result_set(spark, sf_dir):
    """A query's hits in the order of its sort keys, saved as a set and fetched again."""
    sets = S.ResultSetStore(spark, _fresh(spark, "sets"))
    stored = _stored(spark, sf_dir)
    hits = stored.search('text any "the"').join(stored.fetch_sort_value("n_chars"), "doc_id", "left")
    sets.save("s", hits, [F.desc_nulls_last("value__"), F.asc("doc_id")])
    return sets.fetch("s").select("doc_id", "place")


@_query(f"""WITH {_POST}, st AS (SELECT count(*) AS n FROM tok), a AS (SELECT tf.doc_id, tf.occs * ln(n / df.df) AS wt FROM tf JOIN df USING (term), st WHERE term = 'the')
    SELECT d.doc_id, round(coalesce(wt, 0) + CASE WHEN lang = 'de' THEN 0.5 ELSE 0 END, 6) AS weight FROM documents d LEFT JOIN a USING (doc_id) WHERE wt IS NOT NULL OR lang = 'de'""")
def ranked_union(spark, sf_dir):
    return _rounded(_stored(spark, sf_dir).search('text any/rel.algorithm=tfidf "the" or/rel.combine=sum lang = "de"'))


@_query("SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 1000")
def result_set_in_query(spark, sf_dir):
    sets = S.ResultSetStore(spark, _fresh(spark, "sets"))
    stored = _stored(spark, sf_dir)
    sets.save("english", stored.search('lang = "en"'))
    return stored.search("cql.resultSetId = english and n_chars > 1000", sets=sets)


@_query(f"WITH {_POST}, r AS (SELECT term FROM df WHERE term < 'the' ORDER BY term DESC LIMIT 9), s AS (SELECT term FROM df WHERE term >= 'the' ORDER BY term LIMIT 11) SELECT term FROM r UNION ALL SELECT term FROM s")
def scan_around(spark, sf_dir):
    stored = _stored(spark, sf_dir)
    return stored.scan("text", "the", "<", 9).unionByName(stored.scan("text", "the", ">=", 11)).select("term")


@_query(f"WITH {_TOK} SELECT doc_id, md5(array_to_string(w, ' ')) AS digest FROM tok WHERE len(w) > 0")
def prox_vectors(spark, sf_dir):
    """Each document's terms by place, out of the postings."""
    stored = _stored(spark, sf_dir)
    rows = stored.postings("text").select("doc_id", "term", F.explode("positions").alias("word"))
    each = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word", "term"))).alias("x"))
    return each.select("doc_id", F.md5(F.array_join(F.transform("x", lambda x: x["term"]), " ")).alias("digest"))


@_query(f"""WITH {_POST}, v AS (SELECT doc_id, sqrt(sum(occs * occs)) AS s FROM tf GROUP BY doc_id),
    d AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.occs * b.occs) AS dot FROM tf a JOIN tf b ON a.term = b.term AND b.doc_id = a.doc_id + 1 GROUP BY 1, 2)
    SELECT x.doc_id AS a, y.doc_id AS b, round(coalesce(dot, 0) / (x.s * y.s), 6) AS similarity FROM v x JOIN v y ON y.doc_id = x.doc_id + 1 LEFT JOIN d ON d.a = x.doc_id AND d.b = y.doc_id""")
def document_similarity(spark, sf_dir):
    """The cosine of each document and the next one."""
    pairs = _docs(spark, sf_dir).select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return _stored(spark, sf_dir).similarity("text", pairs).select("a", "b", F.round("similarity", 6).alias("similarity"))


@_query("SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def pass_through(spark, sf_dir):
    """Documents from the sources of toxic ones, through the postings of the source."""
    remote = _docs(spark, sf_dir).join(_table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return join_through(_stored(spark, sf_dir), "source", remote, F.col("source"))


@_query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, (CASE WHEN a.doc_id IS NULL THEN 0 ELSE 1.0 END + CASE WHEN b.doc_id IS NULL THEN 0 ELSE 0.5 END) / 2 AS weight
    FROM (SELECT doc_id FROM documents WHERE lang = 'en') a FULL JOIN (SELECT doc_id FROM documents WHERE n_chars > 1000) b ON a.doc_id = b.doc_id""")
def combined_sets(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", F.lit(1).alias("occs"), "lang", "n_chars")
    first = docs.where("lang = 'en'").select("doc_id", "occs", F.lit(1.0).alias("weight"))
    other = docs.where("n_chars > 1000").select("doc_id", "occs", F.lit(0.5).alias("weight"))
    return S.combined([first, other], "any", ["doc_id"]).select("doc_id", "weight")


@_query("SELECT (SELECT count(*) FROM documents WHERE lang = 'en') AS n_en, (SELECT count(*) FROM documents WHERE lang IN ('en', 'de')) AS n_union")
def bitmap_index(spark, sf_dir):
    """Sets of ids as bitmaps, one for each bucket of ids."""
    maps = S.bitmaps(_docs(spark, sf_dir), "lang", "doc_id")
    union = S.bitmap_union(maps, ["en", "de"]).agg(F.sum(F.bitmap_count("bits")).alias("n_union"))
    return S.bitmap_counts(maps).where("term = 'en'").select(F.col("n").alias("n_en")).crossJoin(F.broadcast(union))


# stores


@_query(r"""SELECT count(*) AS total_items, sum(w)::BIGINT AS total_words, max(w) AS max_words, sum(b)::BIGINT AS total_bytes, max(b) AS max_bytes, (sum(b) // count(*))::BIGINT AS mean_bytes
    FROM (SELECT len(regexp_extract_all(text, '\S+')) AS w, strlen(text) AS b FROM documents)""")
def store_summary(spark, sf_dir):
    """The documents table as a store of records."""
    store = S.Store(spark, _fresh(spark, "store"))
    store.store(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("data")), "keep")
    return store.summary().select("total_items", "total_words", "max_words", "total_bytes", "max_bytes", "mean_bytes")


@_query("SELECT count(DISTINCT md5(text)) AS n FROM documents")
def store_without_duplicates(spark, sf_dir):
    store = S.Store(spark, _fresh(spark, "store"), digest="md5")
    store.store(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("data")), "skip")
    return store.current().agg(F.count("*").alias("n"))


@_query(f"WITH {_TOK}, t AS (SELECT doc_id, unnest(w) AS term FROM tok), f AS (SELECT term, doc_id, count(*) AS occs FROM t GROUP BY ALL) SELECT term, count(*) AS n_recs, sum(occs)::BIGINT AS n_occs FROM f WHERE doc_id % 10 <> 3 GROUP BY term")
def unindexed(spark, sf_dir):
    """The terms of the index after some documents were taken out of it."""
    gone = _docs(spark, sf_dir).where("doc_id % 10 = 3").select("doc_id")
    return _stored(spark, sf_dir).without(gone, _fresh(spark, "index")).terms("text").select("term", "n_recs", "n_occs")


# records and documents


@_query("SELECT page_id, md5(html) AS md5, sha256(html) AS sha256, to_base64(encode(html)) AS base64, 'text/html' AS mime FROM pages")
def document_transforms(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", D.checksum("html").alias("md5"), D.checksum("html", "sha256").alias("sha256"), F.regexp_replace(D.to_base64("html"), r"\s", "").alias("base64"), D.mime_type("html").alias("mime"))


@_query("SELECT p_partkey, p_name, p_brand, p_name || ' by ' || p_brand AS line FROM part")
def records_as_xml(spark, sf_dir):
    """Rows to elements, and paths back to values."""
    parts = _table(spark, sf_dir, "part").select("p_partkey", P.to_xml("part", name=F.col("p_name"), brand=F.col("p_brand")).alias("x"))
    each = parts.select("p_partkey", F.element_at(R.texts("x", "name"), 1).alias("p_name"), F.element_at(R.texts("x", "//brand"), 1).alias("p_brand"))
    return each.select("*", R.templated("{n} by {b}", n=F.col("p_name"), b=F.col("p_brand")).alias("line"))


@_query("SELECT page_id, length(html) AS n FROM pages")
def compressed_documents(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", F.length(D.decoded(D.gunzipped(D.gzipped("html")))).cast("bigint").alias("n"))


@_query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS digest FROM conversations GROUP BY conv_id")
def accumulated_documents(spark, sf_dir):
    return P.accumulated(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", F.md5("document").alias("digest"))


@_query("SELECT n_regionkey AS key, '<cluster><key>' || n_regionkey || '</key>' || string_agg('<nation>' || n_name || '</nation>', '' ORDER BY n_name) || '</cluster>' AS cluster FROM nation GROUP BY n_regionkey")
def cluster_documents(spark, sf_dir):
    return P.clusters(_table(spark, sf_dir, "nation"), F.col("n_regionkey"), nation=F.col("n_name"))


@_query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def graph_patterns(spark, sf_dir):
    """Triples and a pattern over them."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    at = lambda kind, c: F.concat(F.lit(f"<{kind}"), F.col(c).cast("string"), F.lit(">"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    triples = nation.select(at("n", "n_nationkey").alias("s"), F.lit("<in>").alias("p"), at("r", "n_regionkey").alias("o"))
    triples = triples.unionByName(nation.select(at("n", "n_nationkey").alias("s"), F.lit("<name>").alias("p"), quoted("n_name").alias("o")))
    triples = triples.unionByName(region.select(at("r", "r_regionkey").alias("s"), F.lit("<name>").alias("p"), quoted("r_name").alias("o")))
    found = G.matches(G.triples(G.lines(triples).withColumnRenamed("line", "value")), [("?n", "<in>", "?r"), ("?n", "<name>", "?nation"), ("?r", "<name>", "?region")], ["?nation", "?region"])
    return found.select(G.literal("nation").alias("nation"), G.literal("region").alias("region")).where("region <> 'ASIA'")


@_query("SELECT n_name AS term, r_name AS above FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT n_name, 'WORLD' FROM nation UNION SELECT r_name, 'WORLD' FROM region")
def terms_above(spark, sf_dir):
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    direct = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("term"), F.col("r_name").alias("above"))
    return T.hypernyms(direct.unionByName(region.select(F.col("r_name").alias("term"), F.lit("WORLD").alias("above"))))


@_query("SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS written, o_orderkey || '.xml' AS file FROM orders")
def dates_and_names(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", T.date_string("o_orderdate").alias("written"))
    return orders.select("o_orderkey", T.date_year("written").alias("year"), "written", T.to_file_name(T.from_file_name(F.concat(F.col("o_orderkey").cast("string"), F.lit(".txt"))), "xml").alias("file"))


# mining

_WORDS = f"c AS (SELECT conv_id * 1000 + turn AS k, {_W} AS w FROM conversations), e AS (SELECT k, unnest(w) AS term, unnest(range(len(w))) AS word FROM c)"


def _conversation_words(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return I.tokens_of(rows, "text", "k").select("k", F.posexplode("tokens").alias("word", "term"))


@_query(f"WITH {_WORDS}, b AS (SELECT k, term, unnest(range(greatest(ceil((word - 9) / 5), 0)::BIGINT, word // 5 + 1)) AS basket FROM e) SELECT k, basket, count(DISTINCT term) AS n FROM b GROUP BY ALL")
def window_baskets(spark, sf_dir):
    return M.window_baskets(_conversation_words(spark, sf_dir), "k", 10, 5).select("k", "basket", F.size("items").cast("bigint").alias("n"))


@_query(f"WITH {_WORDS}, n AS (SELECT k, term, sum((term IN ('the', 'a'))::INT) OVER (PARTITION BY k ORDER BY word) AS basket FROM e) SELECT k, basket::BIGINT AS basket, count(DISTINCT term) AS n FROM n WHERE term NOT IN ('the', 'a') GROUP BY ALL")
def split_baskets(spark, sf_dir):
    return M.split_baskets(_conversation_words(spark, sf_dir), "k", ["the", "a"]).select("k", "basket", F.size("items").cast("bigint").alias("n"))


_PAIRS = """WITH b AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS i FROM lineitem), c AS (SELECT i, count(*) AS n FROM b GROUP BY i), t AS (SELECT count(DISTINCT o) AS n FROM b),
    p AS (SELECT x.i AS a, y.i AS b, count(*) AS s FROM b x JOIN b y ON x.o = y.o AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 3),
    q AS (SELECT p.*, ca.n / t.n AS x, cb.n / t.n AS y, t.n AS n FROM p JOIN c ca ON ca.i = p.a JOIN c cb ON cb.i = p.b, t), r AS (SELECT *, x * y * n AS e, (x * y * n + s) / 2 AS m FROM q)"""


@_query(_PAIRS + """ SELECT a, b, round((CASE WHEN s < e THEN -1 ELSE 1 END) * 2 * (e * log10(e / m) + s * log10(s / m)), 5) AS log_likelihood, round(n / e * s, 4) AS surprise, round(-x * log2(x) - y * log2(y), 6) AS entropy, round(1 - x * x - y * y, 6) AS gini FROM r""")
def itemset_rankings(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    sets = M.pair_support(rows, "l_orderkey", "l_suppkey", 3).select(F.array("a", "b").alias("items"), "support")
    n = rows.select("l_orderkey").distinct().count()
    found = M.itemset_rankings(sets, rows.groupBy(F.col("l_suppkey").alias("item")).agg(F.count("*").alias("n")), n)
    return found.select(F.col("items")[0].alias("a"), F.col("items")[1].alias("b"), F.round("log_likelihood", 5).alias("log_likelihood"), F.round("surprise", 4).alias("surprise"), F.round("entropy", 6).alias("entropy"), F.round("gini", 6).alias("gini"))


@_query(f"WITH {_POST} SELECT tf.doc_id, tf.term, tf.occs FROM tf JOIN df USING (term) WHERE df.df BETWEEN 5 AND 100 AND tf.occs >= 2")
def limited_vectors(spark, sf_dir):
    stored = _stored(spark, sf_dir)
    vectors = stored.table("vectors").where("index_id = 'text'").select("doc_id", "term", F.col("occs").cast("bigint").alias("occs"))
    return M.limited_vectors(vectors, "doc_id", stored.terms("text"), local=(2, None), recs=(5, 100))


@_query(f"""WITH {_POST}, v AS (SELECT tf.doc_id, tf.term, tf.occs FROM tf JOIN df USING (term) WHERE df.df BETWEEN 5 AND 100), r AS (SELECT *, dense_rank() OVER (ORDER BY term) AS num FROM v)
    SELECT doc_id, any_value(quality) || ' ' || string_agg(num || ':' || occs, ' ' ORDER BY num) AS line FROM r JOIN labels USING (doc_id) GROUP BY doc_id""")
def libsvm_lines(spark, sf_dir):
    stored = _stored(spark, sf_dir)
    vectors = stored.table("vectors").where("index_id = 'text'").select("doc_id", "term", "occs")
    numbered, _ = M.renumbered(M.limited_vectors(vectors, "doc_id", stored.terms("text"), recs=(5, 100)), "term")
    return M.libsvm_lines(numbered, "doc_id", _table(spark, sf_dir, "labels").withColumnRenamed("quality", "label"))


# ranges through the query language


def _range_query(relation: str, test: str) -> None:
    low, high = "1996-01-01T00:00:00", "1996-02-01T00:00:00"

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        written = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        ships = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("e"))
        spans = _table(spark, sf_dir, "orders").join(ships, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", written("o_orderdate").alias("s"), written("e").alias("e"))
        return search(spans, f'span {relation} "{low}/{high}"', {"span": Index("s", "range", high="e")}, "span", "o_orderkey")

    name = f"range_index_{ {'encloses': 'encloses', 'within': 'within', '>=<': 'overlaps', '<=': 'before', '>=': 'after'}[relation]}"
    _QUERIES[name] = query
    _SQL[name] = f"WITH sp AS (SELECT o_orderkey, o_orderdate AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT o_orderkey FROM sp WHERE {test.format(l='timestamp ' + repr(low), h='timestamp ' + repr(high))}"


for _relation, _test in (("encloses", "s < {l} AND e > {h}"), ("within", "s > {l} AND e < {h}"), (">=<", "s < {h} AND e >= {l}"), ("<=", "s < {l} AND e <= {h}"), (">=", "s >= {h}")):
    _range_query(_relation, _test)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
