"""Registered queries: each reads the given tables whole and returns one DataFrame.

Queries on topics use a deterministic stand-in for a fitted model, so that SQL can
check them: the topics of a slice are the empirical word distributions of its
languages (or sources), numbered so that the order rotates from slice to slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicflow.operators import alignment as al
from topicflow.operators import clustering as cl
from topicflow.operators import lda as ld
from topicflow.operators import metrics as me
from topicflow.operators import slicing as sl
from topicflow.operators import topics as tp
from topicflow.operators import transport as tr
from topicflow.operators import vocabulary as vo
from topicflow.plans.evolution import Config, run
from topicflow.scratch import Scratch
from topicflow.sources import corpus as co

SLICES = 5
VOCABULARY = 500
TOP_N = 10

# fixed values: the languages of the test corpus, numbered in this order
LANGUAGES = ("de", "en", "es", "fr")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column: str | Column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def docs(spark: SparkSession, sf_dir: str, keep=()) -> DataFrame:
    return co.read_corpus(spark, f"{sf_dir}/documents.parquet", keep=keep)


class Prepared:
    """The stand-in model: sliced and packed documents, and their labelled topics."""

    def __init__(self, spark: SparkSession, sf_dir: str, label: str = "lang", stop_words=()):
        self.scratch = Scratch(spark, "check")
        corpus = self.scratch.save(vo.count_documents(docs(spark, sf_dir, keep=("lang", "source"))), "counted")
        sliced = sl.slice_by_position(corpus, SLICES, scratch=self.scratch)
        self.vocab = self.scratch.save(vo.fit_vocabulary(corpus, VOCABULARY, stop_words), "vocab")
        packed = vo.pack_documents(sliced, self.vocab)
        if label == "lang":
            index = F.array_position(F.array(*[F.lit(x) for x in LANGUAGES]), F.col("lang")) - 1
            number = ((index + F.col("slice_id")) % len(LANGUAGES)).cast("int")
            packed = packed.withColumn("topic", number)
        else:
            names = sliced.select("source").distinct()
            number = (F.dense_rank().over(Window.orderBy("source")) - 1).cast("int")
            packed = packed.join(names.select("source", number.alias("topic")), "source")
        self.packed = self.scratch.save(packed, "packed")
        self.sizes = sl.slice_sizes(self.packed)

    def topic_word(self) -> DataFrame:
        return self.scratch.save(tp.labelled_topics(self.packed, "topic"), "topic-word")

    def top(self, topic_word: DataFrame | None = None) -> DataFrame:
        topic_word = self.topic_word() if topic_word is None else topic_word
        top = self.scratch.save(tp.top_words(topic_word, TOP_N), "top")
        tp.check_top_n(top, TOP_N)
        return top

    def cosine(self, topic_word: DataFrame) -> DataFrame:
        return self.scratch.save(al.topic_cosine(topic_word), "cosine")

    def tracks(self, cosine: DataFrame, topic_word: DataFrame) -> DataFrame:
        match = al.topic_assignment(al.topic_cost(cosine))
        first = topic_word.filter("slice_id = 0").select("topic_id").distinct()
        return self.scratch.save(al.topic_tracks(match, first, self.scratch), "tracks")

    def aligned(self, topic_word: DataFrame | None = None) -> DataFrame:
        topic_word = self.topic_word() if topic_word is None else topic_word
        tracks = self.tracks(self.cosine(topic_word), topic_word)
        return self.scratch.save(al.aligned_topic_word(topic_word, tracks), "aligned")


# --- sources and text --------------------------------------------------------


def corpus_scan(spark, sf):
    return sl.with_position(docs(spark, sf), ["doc_id"]).select("doc_id", "pos", "text")


def conversation_scan(spark, sf):
    df = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return sl.with_position(df, ["conv_id", "turn"]).select("conv_id", "turn", "pos", "text")


def corpus_in_file_order(spark, sf):
    """The corpus without its ids: numbered as its rows stand in the file."""
    df = co.read_corpus(spark, f"{sf}/documents.parquet", id_col=None, keep=("lang",))
    return df.select(F.col("doc_id").alias("pos"), "text", "lang")


def strip_mail(spark, sf):
    df = docs(spark, sf, keep=("lang", "source"))
    mail = F.concat(
        F.lit("From: x\nSubject: y\n\n"), "text", F.lit("\n> "), "source", F.lit("\n\n--\n"), "lang"
    )
    return co.strip_mail(df.select("doc_id", mail.alias("text")))


def tokens(spark, sf):
    return vo.token_table(docs(spark, sf))


def tokens_nostop(spark, sf):
    return vo.remove_stop_words(vo.token_table(docs(spark, sf)))


def doc_term_counts(spark, sf):
    return vo.doc_term_counts(docs(spark, sf))


def vocabulary(spark, sf):
    return vo.fit_vocabulary(docs(spark, sf), VOCABULARY)


def dtm(spark, sf):
    p = Prepared(spark, sf, stop_words=vo.ENGLISH_STOP_WORDS)
    return vo.doc_term_matrix(p.packed.select("slice_id", "doc_id", "terms", "cnts"))


def presence(spark, sf):
    p = Prepared(spark, sf, stop_words=vo.ENGLISH_STOP_WORDS)
    return vo.presence(p.packed.select("slice_id", "doc_id", "terms"))


def dtm_transform(spark, sf):
    vocab = Scratch(spark, "vocab").save(vo.fit_vocabulary(docs(spark, sf), VOCABULARY), "vocab")
    new = co.read_corpus(spark, f"{sf}/benchmark.parquet", id_col="item_id")
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100000 + F.col("turn") + 1000000000).alias("doc_id"), "text"
    )
    return vo.doc_term_matrix(vo.pack_documents(new.unionByName(turns), vocab))


def dtm_large_vocabulary(spark, sf):
    """Cells under a vocabulary of up to 100,000 terms."""
    scratch = Scratch(spark, "large-vocabulary")
    corpus = scratch.save(vo.count_documents(docs(spark, sf)), "counted")
    vocab = scratch.save(vo.fit_vocabulary(corpus, 100_000), "vocab")
    return vo.doc_term_matrix(scratch.save(vo.pack_documents(corpus, vocab), "packed"))


# --- slices ------------------------------------------------------------------


def slice_by_position(spark, sf):
    return sl.slice_by_position(docs(spark, sf).select("doc_id"), SLICES)


def slice_sizes(spark, sf):
    # seven slices, so that the division leaves a remainder for the last one
    return sl.slice_sizes(sl.slice_by_position(docs(spark, sf).select("doc_id"), 7))


def time_sliced_corpus(spark, sf):
    df = table(spark, sf, "events").select(
        F.col("event_id").alias("doc_id"), "ts", F.concat_ws(" ", "event_type", "props").alias("text")
    )
    sliced = sl.slice_by_time(df, "ts", "7 days").drop("ts")
    vocab = Scratch(spark, "vocab").save(vo.fit_vocabulary(df, VOCABULARY), "vocab")
    cells = vo.doc_term_matrix(vo.pack_documents(sliced, vocab))
    return cells.groupBy("slice_id", "term_id").agg(
        F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("n_docs")
    )


# --- topics and metrics ------------------------------------------------------


def topic_word(spark, sf):
    p = Prepared(spark, sf)
    cells = p.packed.select(
        "slice_id", F.col("topic").alias("topic_id"), F.explode_outer(F.arrays_zip("terms", "cnts")).alias("e")
    ).filter(F.col("e").isNotNull())
    counts = cells.groupBy("slice_id", "topic_id", F.col("e.terms").alias("term_id")).agg(F.sum("e.cnts").alias("n"))
    # every term of every topic, met or not: a row per topic unfolds the vocabulary's ids
    terms = F.expr(f"sequence(0, {p.vocab.count() - 1})")
    grid = counts.select("slice_id", "topic_id").distinct().select("*", F.explode(terms).alias("term_id"))
    full = grid.join(counts, ["slice_id", "topic_id", "term_id"], "left")
    weights = p.scratch.save(full.select("slice_id", "topic_id", "term_id", (F.coalesce("n", F.lit(0.0)) + 0.25).alias("lam")), "lambda")
    return tp.normalise_rows(weights).withColumn("p", r6("p"))


def doc_freq(spark, sf):
    return me.doc_freq(Prepared(spark, sf).packed)


def top_words(spark, sf):
    return Prepared(spark, sf).top().withColumn("p", r6("p")).withColumn("rank", F.col("rank").cast("long"))


def top_words_ties(spark, sf):
    p = Prepared(spark, sf, label="source")
    top = tp.top_words(p.topic_word(), TOP_N)
    return top.withColumn("p", r6("p")).withColumn("rank", F.col("rank").cast("long"))


def topic_word_pairs(spark, sf):
    return me.word_pairs(Prepared(spark, sf).top())


def cooccurrence(spark, sf):
    p = Prepared(spark, sf)
    return me.cooccurrence(me.top_word_patterns(p.packed, p.top()))


def _npmi(p: Prepared, topic_word: DataFrame | None = None) -> DataFrame:
    top = p.top(topic_word)
    patterns = p.scratch.save(me.top_word_patterns(p.packed, top), "patterns")
    return me.npmi(top, patterns, p.sizes)


def npmi(spark, sf):
    return _npmi(Prepared(spark, sf)).withColumn("npmi", r6("npmi"))


def topic_coherence(spark, sf):
    p = Prepared(spark, sf)
    return me.topic_coherence(_npmi(p), p.sizes).withColumn("coherence", r6("coherence"))


def topic_diversity(spark, sf):
    return me.topic_diversity(Prepared(spark, sf).top()).withColumn("diversity", r6("diversity"))


def topic_cosine(spark, sf):
    p = Prepared(spark, sf)
    return al.topic_cosine(p.topic_word()).withColumn("similarity", r6("similarity"))


def topic_cost(spark, sf):
    p = Prepared(spark, sf)
    return al.topic_cost(al.topic_cosine(p.topic_word())).withColumn("cost", r6("cost"))


def topic_assignment(spark, sf):
    p = Prepared(spark, sf)
    return al.topic_assignment(al.topic_cost(al.topic_cosine(p.topic_word())))


def topic_tracks(spark, sf):
    p = Prepared(spark, sf)
    tw = p.topic_word()
    tracks = p.tracks(p.cosine(tw), tw)
    log = al.assignment_log(tracks).select(
        "slice_id", F.array_join(F.transform("assignment", lambda x: x.cast("string")), " ").alias("assignment")
    )
    return tracks.join(log, "slice_id")


def aligned_topic_word(spark, sf):
    return Prepared(spark, sf).aligned().withColumn("p", r6("p"))


def topic_drift(spark, sf):
    return me.topic_drift(Prepared(spark, sf).aligned()).withColumn("js_distance", r6("js_distance"))


def evolution_smoothness(spark, sf):
    drift = me.topic_drift(Prepared(spark, sf).aligned())
    return me.evolution_smoothness(drift).select(r6("evolution_smoothness").alias("evolution_smoothness"))


def topic_alignment(spark, sf):
    p = Prepared(spark, sf)
    out = me.topic_alignment(al.topic_cosine(p.topic_word()))
    return out.withColumn("alignment", r6("alignment"))


def metric_averages(spark, sf):
    """The result row over the stand-in topics; perplexity needs a fitted model and is NULL."""
    p = Prepared(spark, sf)
    tw = p.topic_word()
    cosine = p.cosine(tw)
    aligned = p.scratch.save(al.aligned_topic_word(tw, p.tracks(cosine, tw)), "aligned")
    coherence = me.topic_coherence(_npmi(p, tw), p.sizes).agg(F.avg("coherence").alias("v"))
    diversity = me.topic_diversity(p.top(tw)).agg(F.avg("diversity").alias("v"))
    alignment = me.topic_alignment(cosine).agg(F.avg("alignment").alias("v"))
    smoothness = me.evolution_smoothness(me.topic_drift(aligned))
    return spark.range(1).select(
        F.lit(SLICES).alias("n_slices"),
        F.lit(len(LANGUAGES)).alias("n_topics"),
        F.lit(VOCABULARY).alias("max_features"),
        r6(coherence.scalar()).alias("avg_coherence"),
        r6(diversity.scalar()).alias("avg_diversity"),
        r6(smoothness.scalar()).alias("evolution_smoothness"),
        r6(alignment.scalar()).alias("avg_alignment"),
        F.lit(None).cast("double").alias("avg_perplexity"),
    )


def metrics_csv(spark, sf):
    row = metric_averages(spark, sf)
    path = Scratch(spark, "csv").subpath("metrics")
    co.write_result_csv(row, path)
    return spark.read.schema(row.schema).option("header", True).csv(path)


# --- fitted topic models -------------------------------------------------------


def _fitted(spark, sf):
    """Packed documents and the model of the default experiment."""
    cfg = Config()
    scratch = Scratch(spark, "fit")
    corpus = scratch.save(vo.count_documents(docs(spark, sf)), "counted")
    vocab = scratch.save(vo.fit_vocabulary(corpus, cfg.max_features), "vocab")
    sliced = sl.slice_by_position(corpus, cfg.n_slices, scratch=scratch)
    packed = scratch.save(vo.pack_documents(sliced, vocab), "packed")
    return packed, ld.fit_lda(packed, vocab.count(), cfg.n_topics, cfg.max_iter, cfg.random_state, scratch=scratch)


def lda_fit(spark, sf):
    return _fitted(spark, sf)[1].long()


def lda_fit_ml(spark, sf):
    """The library's estimator over the default experiment."""
    cfg = Config()
    corpus = docs(spark, sf)
    vocab = Scratch(spark, "vocab").save(vo.fit_vocabulary(corpus, cfg.max_features), "vocab")
    sliced = sl.slice_by_position(corpus, cfg.n_slices)
    return ld.fit_lda_mllib(sliced, vocab, cfg.n_topics, cfg.max_iter, cfg.random_state)


def _given(spark, sf):
    """Packed documents and a model that SQL can say: the stand-in topics' counts plus the prior."""
    p = Prepared(spark, sf)
    cells = p.packed.select(
        "slice_id", F.col("topic").alias("topic_id"), F.explode_outer(F.arrays_zip("terms", "cnts")).alias("e")
    ).filter(F.col("e").isNotNull())
    counts = cells.groupBy("slice_id", F.col("e.terms").alias("term_id")).pivot("topic_id", list(range(len(LANGUAGES)))).agg(F.sum("e.cnts"))
    n_terms = p.vocab.count()
    grid = spark.range(SLICES).select(F.col("id").cast("int").alias("slice_id"), F.explode(F.expr(f"sequence(0, {n_terms - 1})")).alias("term_id"))
    lam = F.array(*[F.coalesce(F.col(str(k)), F.lit(0.0)) + 1 / len(LANGUAGES) for k in range(len(LANGUAGES))])
    table = grid.join(counts, ["slice_id", "term_id"], "left").select("slice_id", "term_id", lam.alias("lam"))
    packed = p.packed.select("slice_id", "doc_id", "terms", "cnts")
    return packed, ld.LdaModel(p.scratch.save(table, "given"), len(LANGUAGES), n_terms, SLICES), p.scratch


def lda_fit_given(spark, sf):
    """Two passes from a given model, every document starting from ones."""
    packed, model, scratch = _given(spark, sf)
    fitted = ld.fit_lda(packed, model.n_terms, model.n_topics, 2, None, model.n_slices, scratch, model)
    return fitted.long().withColumn("lam", r6("lam"))


def doc_topic_given(spark, sf):
    packed, model, _ = _given(spark, sf)
    return ld.doc_topic(packed, model).withColumn("p", r6("p"))


def perplexity_given(spark, sf):
    packed, model, _ = _given(spark, sf)
    return ld.perplexity(packed, model).withColumn("perplexity", r6("perplexity"))


def doc_topic(spark, sf):
    return ld.doc_topic(*_fitted(spark, sf))


def perplexity(spark, sf):
    return ld.perplexity(*_fitted(spark, sf))


def evolution_report(spark, sf):
    result = run(spark, docs(spark, sf), Config()).result
    shown = {"avg_coherence": 4, "avg_diversity": 4, "evolution_smoothness": 4, "avg_alignment": 4, "avg_perplexity": 2}
    return result.select("*", *[F.format_number(c, d).alias(f"{c}_text") for c, d in shown.items()])


# --- optimal transport ---------------------------------------------------------


def _transport(spark, sf):
    """One problem per slice pair: topic cost, and token shares as marginals."""
    p = Prepared(spark, sf)
    cost = al.topic_cost(al.topic_cosine(p.topic_word()))
    cost = p.scratch.save(cost.toDF("problem", "i", "j", "c"), "cost")
    mass = p.packed.groupBy("slice_id", "topic").agg(
        F.sum(F.aggregate("cnts", F.lit(0.0), lambda a, x: a + x)).alias("w")
    )
    mass = p.scratch.save(mass, "mass")
    a = mass.filter(F.col("slice_id") < SLICES - 1).toDF("problem", "i", "w")
    b = mass.filter("slice_id > 0").select(
        (F.col("slice_id") - 1).alias("problem"), F.col("topic").alias("j"), "w"
    )
    return a, b, cost


def ot_kernel(spark, sf):
    return tr.gibbs_kernel(_transport(spark, sf)[2]).withColumn("c", r6("c")).withColumn("k", r6("k"))


def sinkhorn_plan(spark, sf):
    plan = tr.sinkhorn(*_transport(spark, sf))
    return plan.withColumn("c", r6("c")).withColumn("gamma", r6("gamma"))


def ot_distance(spark, sf):
    plan = tr.sinkhorn(*_transport(spark, sf))
    return tr.ot_distance(plan).withColumn("distance", r6("distance"))


def embedding_transport(spark, sf):
    """Even to odd vectors of a label, by distance; every problem is cut into strips of 16 rows."""
    vectors = table(spark, sf, "embeddings").select(
        F.col("label").alias("problem"), "vec_id", F.col("embedding").cast("array<double>").alias("e")
    )
    even = vectors.filter("vec_id % 2 = 0").select("problem", F.col("vec_id").alias("i"), F.col("e").alias("x"))
    odd = vectors.filter("vec_id % 2 = 1").select("problem", F.col("vec_id").alias("j"), F.col("e").alias("y"))
    cost = tr.distance_cost(even, odd)
    plan = tr.sinkhorn(*tr.uniform_marginals(cost), cost, reg=0.5, dense_cells=0, block=16)
    return plan.withColumn("c", r6("c")).withColumn("gamma", F.round("gamma", 9))


def topic_ot_alignment(spark, sf):
    cost = _transport(spark, sf)[2]
    plan = tr.sinkhorn(*tr.uniform_marginals(cost), cost)
    return tr.soft_alignment(plan).withColumn("gamma", r6("gamma"))


# --- clustering ------------------------------------------------------------------

CLUSTERS = 10
THRESHOLD = 1.15


def points(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features")
    )


def nearest_neighbours(spark, sf):
    return cl.nearest_neighbours(points(spark, sf)).withColumn("distance", r6("distance"))


def _merges(linkage):
    def query(spark, sf):
        merges = cl.agglomerate(points(spark, sf), linkage)
        return merges.select("a", "b", r6("height").alias("height"), "size")

    query.__name__ = f"hclust_{linkage}"
    return query


def hclust_single(spark, sf):
    merges = cl.agglomerate(points(spark, sf), "single")
    return merges.select("a", "b", r6("height").alias("height"))


def cut_n_clusters(spark, sf):
    return cl.hierarchical_clustering(points(spark, sf), n_clusters=CLUSTERS, linkage="single")


def cut_threshold(spark, sf):
    return cl.hierarchical_clustering(points(spark, sf), distance_threshold=THRESHOLD, linkage="single")


def cluster_sizes(spark, sf):
    return cl.cluster_sizes(cut_threshold(spark, sf))


def ward_labels(spark, sf):
    return cl.hierarchical_clustering(points(spark, sf), n_clusters=CLUSTERS, linkage="ward")


COPIED = 60


def copied_points(spark, sf):
    """Every point at the place of one of the first few, so that many points are equal."""
    own = points(spark, sf)
    first = own.filter(F.col("id") < COPIED).select(F.col("id").alias("place"), "features")
    return own.select("id", (F.col("id") % COPIED).alias("place")).join(F.broadcast(first), "place").select("id", "features")


def ward_summaries(spark, sf):
    return cl.hierarchical_clustering(copied_points(spark, sf), n_clusters=CLUSTERS, linkage="ward", summaries=100)


QUERIES = {
    f.__name__: f
    for f in (
        corpus_scan, conversation_scan, corpus_in_file_order, strip_mail, tokens, tokens_nostop, doc_term_counts,
        vocabulary, dtm, presence, dtm_transform, dtm_large_vocabulary, slice_by_position, slice_sizes,
        time_sliced_corpus, topic_word, doc_freq, top_words, top_words_ties, topic_word_pairs,
        cooccurrence, npmi, topic_coherence, topic_diversity, topic_cosine, topic_cost,
        topic_assignment, topic_tracks, aligned_topic_word, topic_drift, evolution_smoothness,
        topic_alignment, metric_averages, metrics_csv, lda_fit, lda_fit_ml, doc_topic, perplexity,
        lda_fit_given, doc_topic_given, perplexity_given,
        evolution_report, ot_kernel, sinkhorn_plan, ot_distance, topic_ot_alignment, embedding_transport,
        nearest_neighbours, _merges("ward"), _merges("complete"), _merges("average"),
        hclust_single, cut_n_clusters, cut_threshold, cluster_sizes, ward_labels, ward_summaries,
    )
}
