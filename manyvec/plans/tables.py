"""Selection, joins, dataset preparation, splits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from manyvec.operators import datasets as D
from manyvec.operators import selection as X
from manyvec.operators.prefix import running_sum
from manyvec.plans.fixtures import qrels, queries_and_docs, query, sql, table
from manyvec.operators import scoring as S

CORPUS = """corpus AS (SELECT doc_id AS corpus_id, source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_number_in_doc FROM documents),
queries AS (SELECT item_id AS query_id, text AS query, 'en' AS language, item_id % 8 AS raw_answers FROM benchmark),
rels AS (SELECT doc_id % 40 AS query_id, doc_id AS corpus_id FROM labels WHERE quality = 1),
pages AS (SELECT rels.*, doc_id, page_number_in_doc FROM rels LEFT JOIN corpus USING (corpus_id))"""


def with_corpus(select: str, *more: str) -> str:
    return "WITH " + ", ".join([CORPUS, *more]) + " " + select


def corpus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    page = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    return docs.select(F.col("doc_id").alias("corpus_id"), F.col("source").alias("doc_id"), page.cast("long").alias("page_number_in_doc"))


def queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").selectExpr("item_id AS query_id", "text AS query", "'en' AS language", "item_id % 8 AS raw_answers")


def rels(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("quality = 1").selectExpr("doc_id % 40 AS query_id", "doc_id AS corpus_id")


def pages(spark, sf_dir):
    return X.with_pages(rels(spark, sf_dir), corpus(spark, sf_dir))


@query(with_corpus("SELECT query_id, corpus_id, doc_id, page_number_in_doc FROM pages"))
def qrels_with_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("query_id", "corpus_id", "doc_id", "page_number_in_doc")


#: Queries whose relevant pages lie in one source only exist for rare queries; folding sources makes them common.
FOLD = "SELECT query_id, corpus_id, CASE WHEN query_id < 10 THEN 'src0' ELSE doc_id END AS doc_id, page_number_in_doc FROM pages"


def folded(spark, sf_dir):
    return pages(spark, sf_dir).withColumn("doc_id", F.when(F.col("query_id") < 10, "src0").otherwise(F.col("doc_id")))


@query(with_corpus("SELECT query_id FROM f WHERE doc_id IS NOT NULL GROUP BY query_id HAVING count(DISTINCT doc_id) = 1 AND max(doc_id) = 'src0'", f"f AS ({FOLD})"))
def single_document_queries(spark, sf_dir):
    return X.single_document_queries(folded(spark, sf_dir), "src0")


@query(with_corpus("SELECT query_id, list(DISTINCT page_number_in_doc ORDER BY page_number_in_doc) FILTER (page_number_in_doc < 30) AS pages FROM f WHERE doc_id = 'src0' AND query_id IN (SELECT query_id FROM f GROUP BY query_id HAVING count(DISTINCT doc_id) = 1 AND max(doc_id) = 'src0') GROUP BY query_id HAVING count(*) > 0", f"f AS ({FOLD})"))
def relevant_pages(spark, sf_dir):
    rows = folded(spark, sf_dir)
    return X.prune_pages(X.relevance(rows, X.single_document_queries(rows, "src0"), "src0"), 30)


@query(with_corpus("SELECT count(*) FILTER (here > 0) AS focus, count(*) FILTER (here > 0 AND n = 1) AS single_doc, count(*) FILTER (here > 0 AND n <> 1) AS cross_doc, coalesce(sum(here) FILTER (here > 0 AND n = 1), 0)::BIGINT AS qrels FROM (SELECT query_id, count(DISTINCT doc_id) AS n, count(*) FILTER (doc_id = 'src0') AS here FROM f GROUP BY query_id)", f"f AS ({FOLD})"))
def selection_summary(spark, sf_dir):
    return X.selection_counts(folded(spark, sf_dir), "src0")


@query(with_corpus("SELECT query_id, query, place FROM queries JOIN (VALUES (7, 0), (3, 1), (21, 2)) v(query_id, place) USING (query_id)"))
def ordered_lookup(spark, sf_dir):
    return X.in_given_order(queries(spark, sf_dir), "query_id", [7, 3, 21]).select("query_id", "query", F.col("place").cast("int").alias("place"))


@query("SELECT q.item_id AS id, [a.source, b.source] AS docs FROM benchmark q JOIN documents a ON a.doc_id = q.item_id JOIN documents b ON b.doc_id = q.item_id + 7")
def corpus_lookup(spark, sf_dir):
    samples = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.array(F.col("item_id"), F.col("item_id") + 7).alias("pos"))
    return X.lookup(samples, table(spark, sf_dir, "documents"), "pos", "doc_id", "source", "docs")


@query("SELECT source AS name, min(doc_id) AS idx FROM documents GROUP BY source")
def first_name_index(spark, sf_dir):
    return X.first_index(table(spark, sf_dir, "documents").selectExpr("source AS name", "doc_id AS idx"))


@query("SELECT i AS page FROM range(1, 112) t(i) WHERE i NOT IN (SELECT doc_id FROM labels)")
def missing_page_numbers(spark, sf_dir):
    return X.missing_pages(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page")).distinct())


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, sf_dir):
    return X.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de') AND doc_id IN (SELECT doc_id FROM labels)")
def labelled_in_languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("lang").isin("fr", "de"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


VARIANTS = """pages AS (SELECT doc_id, array_to_string(list_filter([CASE WHEN i & 1 > 0 THEN 'PD' END, CASE WHEN i & 2 > 0 THEN 'MB' END, CASE WHEN i & 4 > 0 THEN 'GN' END, CASE WHEN i & 8 > 0 THEN 'JC' END, CASE WHEN i & 16 > 0 THEN 'LR' END, CASE WHEN i & 32 > 0 THEN 'CS' END], lambda x: x IS NOT NULL), '_') AS variant FROM (SELECT doc_id, 1 + doc_id % 63 AS i FROM documents)),
v AS (SELECT variant, len(string_split(variant, '_')) AS n_components, count(*) AS n_pages FROM pages GROUP BY ALL)"""


def degraded_pages(spark, sf_dir):
    """Every document as a page of one of the variants, by its number."""
    return table(spark, sf_dir, "documents").select("doc_id", X.variant_of(1 + F.col("doc_id") % 63).alias("variant"))


@query(f"WITH {VARIANTS} SELECT variant, n_components, n_pages FROM v")
def degradation_variants(spark, sf_dir):
    return X.with_components(degraded_pages(spark, sf_dir).groupBy("variant").agg(F.count("*").alias("n_pages"))).select("variant", "n_components", "n_pages")


@query(f"WITH {VARIANTS} SELECT variant FROM v ORDER BY n_components DESC, variant LIMIT 7")
def hard_variants(spark, sf_dir):
    """The hardest seven of the pages' variants; the limit is the feature."""
    return X.hard_variants(X.with_components(degraded_pages(spark, sf_dir).select("variant").distinct()), 7).select("variant")


@query(f"""WITH {VARIANTS}, r AS (SELECT *, row_number() OVER (PARTITION BY n_components ORDER BY sha1('13:' || variant), variant) AS r FROM v WHERE n_components < 6),
splits AS (SELECT variant, CASE WHEN n_components <= 2 OR n_components = 3 AND r <= 9 THEN 'train' WHEN n_components = 3 OR n_components = 4 AND r <= 5 THEN 'val' ELSE 'test' END AS split FROM r WHERE n_components <= 3 OR r <= 5 UNION ALL SELECT 'PD_MB_GN_JC_LR_CS', 'test')
SELECT doc_id, variant, split FROM pages JOIN splits USING (variant)""")
def variant_splits(spark, sf_dir):
    """The split of each page whose variant is in one."""
    pages = degraded_pages(spark, sf_dir)
    return pages.join(X.split_variants(X.with_components(pages.select("variant").distinct())), "variant").select("doc_id", "variant", "split")


GROUPS = "g AS (SELECT raw_answers::VARCHAR AS group_key, list(query_id ORDER BY query_id) AS query_ids FROM queries GROUP BY raw_answers), p AS (SELECT *, sha1('13:' || group_key) AS group_hash, row_number() OVER (ORDER BY sha1('13:' || group_key), group_key) AS place FROM g)"


@query(with_corpus("SELECT group_key, query_ids, group_hash, CASE WHEN place <= 4 THEN 'train' WHEN place <= 5 THEN 'val' ELSE 'test' END AS split, (place - 1) // 3 AS batch FROM p", GROUPS))
def query_group_splits(spark, sf_dir):
    groups = X.query_groups(queries(spark, sf_dir))
    return X.batches(X.split_groups(groups), 3).select("group_key", "query_ids", "group_hash", "split", "batch")


@query(with_corpus("SELECT CASE WHEN place <= 4 THEN 'train' WHEN place <= 5 THEN 'val' ELSE 'test' END AS split, count(*) AS n_groups, sum(len(query_ids))::BIGINT AS n_queries FROM p GROUP BY 1", GROUPS))
def split_counts(spark, sf_dir):
    rows = X.split_groups(X.query_groups(queries(spark, sf_dir)))
    return rows.groupBy("split").agg(F.count("*").alias("n_groups"), F.sum(F.size("query_ids")).alias("n_queries"))


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id, lang AS dataset FROM documents WHERE lang IN ('en', 'fr')")
def union_of_datasets(spark, sf_dir):
    d = docs(spark, sf_dir)
    return D.union({n: d.where(F.col("lang") == n).select("doc_id") for n in ("en", "fr")})


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha1('42:' || doc_id), doc_id) AS r FROM documents), c AS (SELECT doc_id, source FROM r WHERE source <> 'src0' OR r <= 20)
SELECT doc_id, source, CASE WHEN row_number() OVER (ORDER BY sha1('42:' || doc_id), doc_id) <= 50 THEN 'test' ELSE 'train' END AS split FROM c""")
def capped_union_split(spark, sf_dir):
    """One source capped, then a shuffled head split, as the loaders do it."""
    held = D.cap_sources(docs(spark, sf_dir).select("doc_id", "source"), "source", {"src0": 20}, "doc_id")
    return D.head_split(held, "doc_id", 50, seed=42)


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 100 THEN 'test' ELSE 'train' END AS split FROM documents")
def plain_head_split(spark, sf_dir):
    return D.head_split(docs(spark, sf_dir).select("doc_id"), "doc_id", 100)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE r > 30 AND r <= 70")
def positional_range(spark, sf_dir):
    return D.take_range(docs(spark, sf_dir).select("doc_id"), "doc_id", 30, 70)


@query("SELECT source, lang, min(doc_id) AS doc_id FROM (SELECT source, arg_min(lang, doc_id) AS lang, min(doc_id) AS doc_id FROM documents GROUP BY source) GROUP BY ALL")
def first_by_key(spark, sf_dir):
    return D.first_by_key(docs(spark, sf_dir).select("source", "lang", "doc_id"), "source", "doc_id")


MINED = "gold AS (SELECT qid, min(pid) AS gold FROM qrels GROUP BY qid), top AS (SELECT qid, list(pid ORDER BY rank) AS t FROM ranked WHERE rank <= 100 GROUP BY qid), mined AS (SELECT qid, gold, list_contains(t, gold) AS gold_in_top, list_filter(t, lambda x: x <> gold) AS negatives FROM top JOIN gold USING (qid))"


def mined(spark, sf_dir):
    scores = S.score_multi_vector(*queries_and_docs(spark, sf_dir), best=100)
    return D.mine_negatives(scores, qrels(spark, sf_dir).groupBy("qid").agg(F.min("pid").alias("pid")), 100)


@query(sql("SELECT qid, gold, gold_in_top, negatives FROM mined", MINED))
def hard_negatives(spark, sf_dir):
    return mined(spark, sf_dir)


@query(sql("SELECT qid, gold, gold_in_top, negatives[1:3] AS negatives FROM mined WHERE gold_in_top", MINED))
def training_samples(spark, sf_dir):
    return D.training_set(mined(spark, sf_dir))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r <= n // 8 * 8")
def whole_batches(spark, sf_dir):
    return D.whole_batches(docs(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", 8)


@query("""WITH r AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY sha1('43:' || doc_id), doc_id) - 1) // 8 AS own, count(*) OVER (PARTITION BY source) AS n FROM documents),
k AS (SELECT *, source || '/' || own AS tag FROM r WHERE own < n // 8), b AS (SELECT tag, row_number() OVER (ORDER BY sha1('43:' || tag)[1:13], tag) - 1 AS batch FROM (SELECT DISTINCT tag FROM k)) SELECT doc_id, source, batch FROM k JOIN b USING (tag)""")
def single_dataset_batches(spark, sf_dir):
    return D.single_dataset_batches(docs(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", 8, seed=42, epoch=1)


@query("SELECT source, n, sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto FROM (SELECT source, replace(source, 'src', '')::INT AS k, count(*) AS n FROM documents GROUP BY ALL)")
def dataset_offsets(spark, sf_dir):
    sizes = docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")).withColumn("k", F.substring("source", 4, 9).cast("int"))
    return running_sum(sizes, "k", F.col("n"), "upto").select("source", "n", "upto")


@query("""SELECT doc_id, list_transform(list_sort(list_transform([doc_id, doc_id + 1, doc_id + 2, doc_id + 3], lambda x: {'h': sha1('42:' || doc_id || ':' || x), 'x': x}))[1:3], lambda t: t.x) AS sampled,
[doc_id, doc_id + 1, doc_id + 2, doc_id + 3][(('0x' || sha1('42:' || doc_id)[1:8])::BIGINT % 4) + 1] AS one FROM documents""")
def sampled_negatives(spark, sf_dir):
    items, key = F.array(*[F.col("doc_id") + i for i in range(4)]), F.col("doc_id")
    return docs(spark, sf_dir).select("doc_id", D.sampled_list(items, key).alias("sampled"), D.chosen(items, key).alias("one"))


@query("SELECT doc_id AS id, i AS place, doc_id * 10 + i AS value FROM documents, range(0, 3) t(i)")
def flattened_negatives(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.array(*[F.col("doc_id") * 10 + i for i in range(3)]).alias("neg"))
    return D.flattened(rows, "neg", "id").select("id", F.col("place").cast("long").alias("place"), "value")


@query("SELECT doc_id AS id, [doc_id * 10, doc_id * 10 + 1, doc_id * 10 + 2] AS neg FROM documents")
def regrouped_negatives(spark, sf_dir):
    return D.regrouped(flattened_negatives(spark, sf_dir), "id", "neg")


@query("SELECT doc_id AS query_id, lang AS query_lang FROM documents")
def prefixed_columns(spark, sf_dir):
    return D.prefixed(docs(spark, sf_dir).selectExpr("doc_id AS id", "lang"), "query_")


@query("SELECT doc_id::VARCHAR AS id, lang AS language, 'vqa' AS dataset FROM documents")
def vqa_columns(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.lit(None).cast("string").alias("ucsf_id"), "doc_id", "lang")
    return D.vqa_reshaped(rows, {"lang": "language"}, ["ucsf_id", "doc_id"], "vqa")


@query(with_corpus("SELECT d.doc_id AS query_id, d.lang AS query, language, coalesce(raw_answers, -1) AS raw_answers FROM documents d LEFT JOIN queries q ON q.query_id = d.doc_id"))
def selected_queries_with_answers(spark, sf_dir):
    chosen = docs(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.col("lang").alias("query"))
    return X.with_answers(chosen, queries(spark, sf_dir)).withColumn("raw_answers", F.coalesce("raw_answers", F.lit(-1).cast("long")))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def split_overlap(spark, sf_dir):
    return X.overlap(docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id, row_number() OVER (ORDER BY sha1('7:' || doc_id)[1:13], doc_id) AS place FROM documents")
def shuffled_places(spark, sf_dir):
    """A seeded shuffle: every row's place in it."""
    return D.shuffled_places(docs(spark, sf_dir).select("doc_id"), "doc_id", 7)


@query("SELECT doc_id, 'T_single_singleview_' || lang || '.json' AS result, 'T_restoration_analysis_' || lang || '.json' AS analysis FROM documents")
def result_names(spark, sf_dir):
    from manyvec.functions import texts as T

    return docs(spark, sf_dir).select("doc_id", T.result_name(F.lit("T"), F.lit("single"), F.col("lang")).alias("result"), T.analysis_name(F.lit("T"), F.col("lang")).alias("analysis"))


@query("SELECT doc_id, len(list_filter([doc_id % 5, doc_id % 3 + 100, 2], lambda x: x NOT IN (0, 1, 2))) AS n FROM documents")
def special_tokens_dropped(spark, sf_dir):
    from manyvec.functions import texts as T

    ids = F.array(F.col("doc_id") % 5, F.col("doc_id") % 3 + 100, F.lit(2).cast("long"))
    return docs(spark, sf_dir).select("doc_id", F.size(T.without_special(ids, [0, 1, 2])).cast("long").alias("n"))
