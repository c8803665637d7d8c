"""The registered queries and their SQL counterparts, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import analysis as A
from textloom.operators import index as I
from textloom.operators import mining as M
from textloom.operators.search import Index, ranked, scaled, search
from textloom.operators.stored import StoredIndex, stored_index
from textloom.storage import placed
from textloom.streaming.incremental import windowed_counts

INDEXES = {"text": Index("text"), "lang": Index("lang", "exact"), "source": Index("source", "exact"), "n_chars": Index("n_chars", "number")}

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_TOK = f"tok AS (SELECT doc_id, coalesce({_W}, []) AS w FROM documents)"
_POST = f"{_TOK}, tf AS (SELECT doc_id, t AS term, count(*) AS occs FROM (SELECT doc_id, unnest(w) AS t FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df, sum(occs) AS occs FROM tf GROUP BY term)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def _stored(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The index of the documents table, written once a session."""
    return stored_index(spark, _docs(spark, sf_dir), INDEXES, f"documents of {sf_dir}")


def _cql(name: str, query: str, sql: str, shape: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """A query of the stored index."""
    _add(name, lambda s, d: shape(_stored(s, d).search(query)), sql)


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", F.round("weight", 6).alias("weight"))


def _weights_sql(terms: list[str], weight: str, combine: str, n: int | None = None) -> str:
    """SQL of a clause's weights: that of each term that a document holds, combined."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""WITH {_POST}, st AS (SELECT count(*) AS n, sum(len(w)) // count(*) AS mean FROM tok),
        per AS (SELECT tf.doc_id, {weight} AS wt FROM tf JOIN df USING (term) JOIN tok USING (doc_id), st WHERE term IN ({listed}))
        SELECT doc_id, round({combine}, 6) AS weight FROM per GROUP BY doc_id"""


_TFIDF = "tf.occs * ln(n / df.df)"
_CORI = "0.4 + 0.6 * (tf.occs / (tf.occs + 50 + 150 * len(w) / mean)) * (ln((n + 0.5) / df.df) / ln(n + 1))"
_BM25 = "ln(n / df.df) * (2.5 * tf.occs) / (1.5 * (0.25 + 0.75 * len(w) / mean) + tf.occs)"

# index building and statistics
_add("term_stats", lambda s, d: I.term_stats(_docs(s, d)), f"WITH {_POST} SELECT term, df::BIGINT AS n_recs, occs::BIGINT AS n_occs FROM df")
_add("postings", lambda s, d: I.postings(_docs(s, d)).select("term", "doc_id", "occs", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions")),
     f"WITH {_TOK}, e AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM tok) SELECT term, doc_id, count(*) AS occs, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM e GROUP BY ALL")
_add("index_metadata", lambda s, d: I.index_metadata(I.term_stats(_docs(s, d))), f"WITH {_POST} SELECT count(*) AS n_terms, sum(df)::BIGINT AS n_postings, sum(occs)::BIGINT AS n_occurrences FROM df")
_add("collection_stats", lambda s, d: I.collection_stats(_docs(s, d)),
     f"SELECT count(*) AS total_items, sum(n)::BIGINT AS total_words, min(n) AS min_words, max(n) AS max_words, (sum(n) // count(*))::BIGINT AS mean_words, sum(b)::BIGINT AS total_bytes, min(b)::BIGINT AS min_bytes, max(b)::BIGINT AS max_bytes FROM (SELECT len({_W}) AS n, strlen(text) AS b FROM documents)")
_add("min_support", lambda s, d: _stored(s, d).terms("text").where("n_recs >= 5").select("term", "n_recs", "n_occs"), f"WITH {_POST} SELECT term, df::BIGINT AS n_recs, occs::BIGINT AS n_occs FROM df WHERE df >= 5")

# boolean search
_cql("search_any", 'text any "the der"', f"SELECT doc_id FROM documents WHERE list_has_any({_W}, ['the', 'der'])")
_cql("search_all", 'text all "the of"', f"SELECT doc_id FROM documents WHERE list_has_all({_W}, ['the', 'of'])")
_cql("search_exact", 'lang exact "de"', "SELECT doc_id FROM documents WHERE lang = 'de'")
_cql("search_not", 'text any "the" not text any "of"', f"SELECT doc_id FROM documents WHERE list_contains({_W}, 'the') AND NOT list_contains({_W}, 'of')")
_cql("bool_mixed", 'text = "the" or text = "der" and lang = "en" not text = "of"', f"SELECT doc_id FROM documents WHERE (list_contains({_W}, 'the') OR list_contains({_W}, 'der')) AND lang = 'en' AND NOT list_contains({_W}, 'of')")
_cql("mask_prefix", 'text any "tha*"', f"SELECT doc_id FROM documents WHERE len(list_filter({_W}, lambda x: x LIKE 'tha%')) > 0")
_cql("mask_infix", 'text any "t?e*n"', f"SELECT doc_id FROM documents WHERE len(list_filter({_W}, lambda x: regexp_full_match(x, 't.e.*n'))) > 0")
_cql("mask_left", 'text any "*tion"', f"SELECT doc_id FROM documents WHERE len(list_filter({_W}, lambda x: x LIKE '%tion')) > 0")
_cql("range_lt", 'text < "aa"', f"SELECT doc_id FROM documents WHERE len(list_filter({_W}, lambda x: x < 'aa')) > 0")
_cql("range_within", 'text within "tha thb"', f"SELECT doc_id FROM documents WHERE len(list_filter({_W}, lambda x: x > 'tha' AND x < 'thb')) > 0")
_cql("range_number", "n_chars >= 1000 and n_chars < 5000", "SELECT doc_id FROM documents WHERE n_chars >= 1000 AND n_chars < 5000")
_add("range_dates", lambda s, d: _table(s, d, "orders").where((F.col("o_orderdate") > "1995-01-01") & (F.col("o_orderdate") < "1995-07-01")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderdate > '1995-01-01' AND o_orderdate < '1995-07-01'")

# proximity
_POS = f"{_TOK}, e AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM tok)"
_cql("phrase", 'text = "of the"', f"WITH {_POS} SELECT DISTINCT a.doc_id FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'")
_cql("prox_unordered", "text = the prox/distance<=3 text = of", f"WITH {_POS} SELECT DISTINCT a.doc_id FROM e a JOIN e b ON a.doc_id = b.doc_id AND abs(b.pos - a.pos) <= 3 WHERE a.term = 'the' AND b.term = 'of'")
_cql("prox_ordered", "text = the prox/distance<=3/ordered text = of", f"WITH {_POS} SELECT DISTINCT a.doc_id FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.pos - a.pos <= 3 WHERE a.term = 'the' AND b.term = 'of'")
_cql("window", 'text window/distance<=5 "the of to"',
     f"WITH {_POS} SELECT DISTINCT a.doc_id FROM e a JOIN e b ON a.doc_id = b.doc_id AND abs(b.pos - a.pos) <= 5 JOIN e c ON a.doc_id = c.doc_id AND abs(c.pos - a.pos) <= 5 AND abs(c.pos - b.pos) <= 5 WHERE a.term = 'the' AND b.term = 'of' AND c.term = 'to'")

# ranking
_cql("rank_tfidf", 'text any/rel.algorithm=tfidf "the of to"', _weights_sql(["the", "of", "to"], _TFIDF, "sum(wt) / 3"), _rounded)
_cql("rank_cori", 'text any/rel.algorithm=cori "the of to"', _weights_sql(["the", "of", "to"], _CORI, "sum(wt) / 3"), _rounded)
_cql("rank_bm25", 'text any/rel.algorithm=okapi "the of to"', _weights_sql(["the", "of", "to"], _BM25, "sum(wt) / 3"), _rounded)
_cql("rank_bm25_top", 'text any/rel.algorithm=okapi "the of to"', _weights_sql(["the", "of", "to"], _BM25, "sum(wt) / 3") + " ORDER BY weight DESC, doc_id DESC LIMIT 10", lambda h: ranked(h, 10))
_cql("rank_lr", 'text any/rel.algorithm=lr "the of to"',
     f"""WITH {_POST}, st AS (SELECT count(*) AS n FROM tok),
        per AS (SELECT tf.doc_id, count(*) AS m, avg(ln(tf.occs)) AS daf, avg(ln(n / df.df)) AS idf, any_value(len(w)) AS length FROM tf JOIN df USING (term) JOIN tok USING (doc_id), st WHERE term IN ('the', 'of', 'to') GROUP BY tf.doc_id)
        SELECT doc_id, round(1 / (1 + exp(-(-3.7 - 0.31 * sqrt(3) + 0.679 * daf - 0.021 * sqrt(length) + 0.223 * idf + 4.01 * ln(m)))), 6) AS weight FROM per""", _rounded)
_cql("combine_sum", 'text any/rel.algorithm=tfidf/rel.combine=sum "the of"', _weights_sql(["the", "of"], _TFIDF, "sum(wt)"), _rounded)
_cql("combine_norm", 'text any/rel.algorithm=tfidf/rel.combine=norm "the of"', _weights_sql(["the", "of"], _TFIDF, "avg(wt)"), _rounded)
_cql("scaled_weights", 'text any/rel.algorithm=tfidf/rel.combine=sum "the of"',
     f"WITH r AS ({_weights_sql(['the', 'of'], _TFIDF, 'sum(wt)')}) SELECT doc_id, round((weight - min(weight) OVER ()) / (max(weight) OVER () - min(weight) OVER ()), 4) AS scaled_weight FROM r",
     lambda h: scaled(_rounded(h)).select("doc_id", F.round("scaled_weight", 4).alias("scaled_weight")))

# ordering, browsing, facets
_add("sort_missing", lambda s, d: placed(_docs(s, d).select("doc_id").join(_table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left"), F.asc_nulls_last("quality"), "doc_id").select("doc_id", "place"),
     "SELECT doc_id, row_number() OVER (ORDER BY quality ASC NULLS LAST, doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id)")
_add("sort_multi", lambda s, d: _docs(s, d).select("doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")).cast("bigint").alias("place")), "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents")
for _name, _direction, _where, _order in (("scan_ge", ">=", ">= 'the'", "ASC"), ("scan_le", "<=", "<= 'the'", "DESC"), ("scan_prefix", "=", "LIKE 'the%'", "ASC")):
    _add(_name, lambda s, d, x=_direction: _stored(s, d).scan("text", "the", x, 25).select("term", "n_recs", "n_occs"), f"WITH {_POST} SELECT term, df::BIGINT AS n_recs, occs::BIGINT AS n_occs FROM df WHERE term {_where} ORDER BY term {_order} LIMIT 25")
_add("facets_lang", lambda s, d: _stored(s, d).facets("lang", _stored(s, d).search('text any "the"')).select(F.col("term").alias("facet"), "n_recs"), f"SELECT lang AS facet, count(*) AS n_recs FROM documents WHERE list_contains({_W}, 'the') GROUP BY 1")
_add("facets_terms", lambda s, d: _stored(s, d).facets("text", _stored(s, d).search('text all "the of"'), 50).select("term", "n_recs", "n_occs"),
     f"WITH {_TOK}, h AS (SELECT * FROM tok WHERE list_has_all(w, ['the', 'of'])), t AS (SELECT doc_id, unnest(w) AS term FROM h) SELECT term, count(DISTINCT doc_id) AS n_recs, count(*) AS n_occs FROM t GROUP BY term ORDER BY n_recs DESC, term LIMIT 50")
_add("freq_list", lambda s, d: _stored(s, d).frequencies("text", n=100).select("term", "n_occs", "rank"), f"WITH {_POST} SELECT term, occs::BIGINT AS n_occs, row_number() OVER (ORDER BY occs DESC, term) AS rank FROM df ORDER BY rank LIMIT 100")
_add("feedback_terms", lambda s, d: _stored(s, d).telling_terms("text", _stored(s, d).search('lang = "de"')),
     f"WITH {_POST}, st AS (SELECT count(*) AS n FROM tok), h AS (SELECT term, sum(tf.occs) AS here FROM tf JOIN documents USING (doc_id) WHERE lang = 'de' GROUP BY term) SELECT term, round(here * ln(n / df.df), 6) AS weight FROM h JOIN df USING (term), st ORDER BY weight DESC, term LIMIT 20")

# vectors
_add("doc_vector", lambda s, d: I.postings(_docs(s, d)).select("doc_id", "term", "occs"), f"WITH {_POST} SELECT doc_id, term, occs FROM tf")
_add("cosine_similarity", lambda s, d: _table(s, d, "embeddings").select("vec_id", "embedding", "label").join(_table(s, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first")), "label").select("vec_id", F.round(M.cosine("embedding", "first"), 4).alias("similarity")),
     "WITH f AS (SELECT label, arg_min(embedding, vec_id) AS first FROM embeddings GROUP BY label) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], first::DOUBLE[]), 4) AS similarity FROM embeddings JOIN f USING (label)")
_add("centroids", lambda s, d: M.centroids(_table(s, d, "embeddings"), "label", "embedding").select("label", F.col("pos").cast("bigint").alias("pos"), F.round("mean", 5).alias("mean")),
     "SELECT label, pos, round(avg(x::DOUBLE), 5) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL")

# analysis
_add("ngrams", lambda s, d: I.tokens_of(_docs(s, d)).select(F.explode(A.ngrams(F.col("tokens"), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), f"WITH {_TOK} SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM tok) GROUP BY gram")
_add("stoplist", lambda s, d: I.tokens_of(_docs(s, d)).select("doc_id", F.size(A.without_stops(F.col("tokens"), ["the", "of", "der", "de"])).cast("bigint").alias("n")), f"WITH {_TOK} SELECT doc_id, len(list_filter(w, lambda x: x NOT IN ('the', 'of', 'der', 'de'))) AS n FROM tok")
_add("normalizers", lambda s, d: _table(s, d, "part").select("p_partkey", A.reverse("p_name").alias("reversed"), A.spaces("p_name").alias("spaced"), A.article(F.concat(F.lit("The "), "p_name")).alias("no_article"), A.possessive(F.concat("p_name", F.lit("'s"))).alias("no_possessive"), A.zero_pad(F.col("p_partkey").cast("string")).alias("padded"), A.exists("p_name").alias("filled")),
     "SELECT p_partkey, reverse(p_name) AS reversed, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS spaced, p_name AS no_article, p_name AS no_possessive, lpad(p_partkey::VARCHAR, 12, '0') AS padded, CASE WHEN p_name <> '' THEN '1' ELSE '0' END AS filled FROM part")
_add("diacritic", lambda s, d: _docs(s, d).select("doc_id", F.md5(A.without_accents("text")).alias("digest")),
     "SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(translate(text, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY'), 'Æ', 'AE'), 'æ', 'ae'), 'Œ', 'OE'), 'œ', 'oe'), 'ß', 'ss'), '§', 'Section')) AS digest FROM documents")
_PHONE = "regexp_replace(lower(c_name), '[^a-z]', '', 'g')"
_CODE = f"substring({_PHONE}, 2)"
for _p, _q in A._SOUNDS:
    _CODE = f"regexp_replace({_CODE}, '{_p}', '{_q}', 'g')"
for _digit in "0123456":
    _CODE = f"regexp_replace({_CODE}, '{_digit}{_digit}+', '{_digit}', 'g')"
_add("phonetic", lambda s, d: _table(s, d, "customer").select("c_custkey", A.phonetic("c_name").alias("code")), f"SELECT c_custkey, substring({_PHONE}, 1, 1) || replace({_CODE}, '0', '') AS code FROM customer")
_SMASH = "html"
for _p in ("<!--.*?-->", "<script.*?</script>", "<style.*?</style>", "<head.*?</head>", "<[^>]*>"):
    _SMASH = f"regexp_replace({_SMASH}, '(?is){_p}', ' ', 'g')"
_add("html_smash", lambda s, d: _table(s, d, "pages").select("page_id", A.smash_html("html").alias("text")), f"SELECT page_id, regexp_replace(regexp_replace({_SMASH}, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM pages")
_add("html_title", lambda s, d: _table(s, d, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title")), "SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages")
_add("checksum_dups", lambda s, d: _docs(s, d).groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1"), "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")


# intervals: from order to shipment
def _spans(s: SparkSession, d: str) -> DataFrame:
    ships = _table(s, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("e"))
    return _table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("s")).join(ships, F.col("o_orderkey") == F.col("l_orderkey"))


_SPAN = "sp AS (SELECT o_orderkey, o_orderdate AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"
_LOW, _HIGH = "1996-01-01", "1996-02-01"
for _name, _test in (("interval_overlap", "s < timestamp '{h}' and e >= timestamp '{l}'"), ("interval_encloses", "s < timestamp '{l}' and e > timestamp '{h}'"), ("interval_within", "s > timestamp '{l}' and e < timestamp '{h}'")):
    _add(_name, lambda s, d, t=_test.format(l=_LOW, h=_HIGH): _spans(s, d).where(t).select("o_orderkey"), f"WITH {_SPAN} SELECT o_orderkey FROM sp WHERE {_test.format(l=_LOW, h=_HIGH)}")

# joins between indexes, clusters, components, deletion
_add("passthrough_semijoin", lambda s, d: _docs(s, d).join(_table(s, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
_add("cluster_docs", lambda s, d: _docs(s, d).groupBy("source").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",")).alias("members")), "SELECT source, count(*) AS n, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS members FROM documents GROUP BY source")
_add("component_split", lambda s, d: _docs(s, d).select("doc_id", F.posexplode(A.lines("text")).alias("part", "line")).select("doc_id", F.col("part").cast("bigint").alias("part"), "line"), "SELECT doc_id, unnest(range(len(l))) AS part, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
_add("delete_reindex", lambda s, d: I.term_stats(_docs(s, d).join(_table(s, d, "labels").where("toxic = 1"), "doc_id", "left_anti")), f"WITH {_TOK}, k AS (SELECT * FROM tok WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), t AS (SELECT doc_id, unnest(w) AS term FROM k) SELECT term, count(DISTINCT doc_id) AS n_recs, count(*) AS n_occs FROM t GROUP BY term")
_add("bitmap_ops", lambda s, d: _docs(s, d).agg(F.count_if(F.array_contains(A.words("text"), "the") & (F.col("lang") == "en")).alias("n_and"), F.count_if(F.array_contains(A.words("text"), "the") | (F.col("lang") == "en")).alias("n_or"), F.count_if(F.array_contains(A.words("text"), "the") & (F.col("lang") != "en")).alias("n_minus")),
     f"SELECT count(*) FILTER (a AND b) AS n_and, count(*) FILTER (a OR b) AS n_or, count(*) FILTER (a AND NOT b) AS n_minus FROM (SELECT list_contains({_W}, 'the') AS a, lang = 'en' AS b FROM documents)")

# data mining
_add("itemsets_pairs", lambda s, d: M.pair_support(_table(s, d, "lineitem"), "l_orderkey", "l_suppkey", 3), "WITH b AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS i FROM lineitem) SELECT x.i AS a, y.i AS b, count(*) AS support FROM b x JOIN b y ON x.o = y.o AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 3")


def _measures(s: SparkSession, d: str) -> DataFrame:
    rows = _table(s, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    pairs = M.pair_support(rows, "l_orderkey", "l_suppkey", 3).crossJoin(F.broadcast(rows.agg(F.count_distinct("l_orderkey").alias("n__"))))
    return M.pair_measures(pairs, rows.groupBy(F.col("l_suppkey").alias("item")).agg(F.count("*").alias("n")))


_add("itemset_measures", _measures,
     """WITH b AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS i FROM lineitem), c AS (SELECT i, count(*) AS n FROM b GROUP BY i), t AS (SELECT count(DISTINCT o) AS n FROM b),
        p AS (SELECT x.i AS a, y.i AS b, count(*) AS support FROM b x JOIN b y ON x.o = y.o AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 3),
        q AS (SELECT p.*, support / ca.n AS r, support / ca.n * t.n / cb.n AS l FROM p JOIN c ca ON ca.i = p.a JOIN c cb ON cb.i = p.b, t)
        SELECT a, b, support, round(r, 6) AS confidence, round(l, 6) AS lift, round(CASE WHEN r >= 1 THEN 0 ELSE -r * log2(r) - (1 - r) * log2(1 - r) END, 6) AS entropy, round(1 - r * r - (1 - r) * (1 - r), 6) AS gini FROM q""")
_add("classify", lambda s, d: M.classified(_docs(s, d), _table(s, d, "labels"), "quality", "bayes", 1 << 14))
_add("incremental_counts", lambda s, d: windowed_counts(_table(s, d, "events")), "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
