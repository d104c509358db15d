"""TF-IDF weights and nearest texts.

No term is left out unless ``max_terms`` says so. With all terms, blocks of texts ask once for each of their
terms in how many texts it is (``term_blocks``). With ``max_terms`` words are counted inside each row, and term
statistics and weights are met by shuffle joins, which Spark splits for frequent terms, or by broadcast.

``similar`` looks up each different text once. Queries and texts are dealt to cells, a block of queries
and a block of texts with about the same largest weight each, and scored there: pairs are never shuffled or
stored, only each cell's first ``k``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.functions.text import term_frequencies, tokens, unigrams_bigrams
from tickframe.operators import term_blocks
from tickframe.session import stored

MIN_SIMILARITY = 0.05
#: Scores are rounded to nine digits, so bounds leave a little more room.
SLACK = 1e-6
#: What skipped terms may add to a score, as a share of the least score: more skips more terms and keeps more pairs.
SKIPPED = 0.5
#: Terms of a query that choose the texts which set its least score.
SEED_TERMS = 8
#: Weights that a cell holds of its texts, and half of those of its queries, on average.
CELL = 4_000_000
#: Texts of a cell that share their bounds, pairs and weights that are met at once.
TOGETHER = 4_000
PAIRS = 1_000_000
ENTRIES = 2_000_000
#: In a cell terms are skipped that one in so many texts has at least, as they are looked up in a dense table, and up to this share of the least score.
COMMON = 16
LATE = 0.75


def term_counts(texts: DataFrame, key: str, text: str, accents: bool = True) -> DataFrame:
    """(key, term, tf) for unigrams and bigrams; ``key`` is unique, one row is one text."""
    found = term_frequencies(unigrams_bigrams(tokens(text, accents)))
    # The outer form spares the size test that inline adds, which would split every
    # text a second time.
    return (texts.select(key, text).select(key, F.inline_outer(found)).where("term IS NOT NULL"))


def vocabulary(counts: DataFrame, n_texts: DataFrame, max_terms: int | None = None, min_df: int = 1) -> DataFrame:
    """Terms with their smoothed inverse document frequency; all, or the most frequent ``max_terms``."""
    terms = (counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
             .where(F.col("df") >= min_df))
    if max_terms is not None:
        terms = terms.orderBy(F.desc("total"), "term").limit(max_terms)
    return terms.select("term", "df", inverse_frequency(n_texts).alias("idf"))


def inverse_frequency(n_texts: DataFrame) -> Column:
    """Smoothed, from the column ``df``."""
    n = n_texts.agg(F.count("*").alias("n")).scalar()
    return F.log((1 + n) / (1 + F.col("df")).cast("double")) + 1.0


def tf_idf(idf: Column) -> Column:
    return (1.0 + F.log(F.col("tf").cast("double"))) * idf


def unit_length(raw: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, term, weight) from the column ``v``."""
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return raw.select(key, "term", *keep, (F.col("v") / norm).alias("weight"))


def weights(counts: DataFrame, vocab: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, term, weight): sublinear tf times idf, unit length per text."""
    return unit_length(counts.join(vocab, "term").select(key, "term", *keep, tf_idf(F.col("idf")).alias("v")), key, keep)


def text_features(texts: DataFrame, key: str, text: str, max_terms: int | None = None,
                  min_df: int = 2, accents: bool = False) -> DataFrame:
    """TF-IDF features in long form; accents are stripped unless ``accents``."""
    if max_terms is not None:
        counts = term_counts(texts, key, text, accents)
        return weights(counts, vocabulary(counts, texts, max_terms, min_df), key)
    found = term_blocks.features(term_blocks.text_blocks(texts, key, tokens(text, accents)), min_df)
    return (found.select(F.col("key").alias(key), "square", F.inline("found"))
            .select(key, "term", (F.col("v") / F.sqrt("square")).alias("weight")))


def least_scores(asked: DataFrame, doc: DataFrame, ckey: str, k: int, min_score: float) -> DataFrame:
    """(_q, least): a score that the k-th best text of each query reaches at any rate.

    The texts that share a query's rarest terms are scored by those terms alone, and the best
    ``2 k`` of them in full; the k-th of these scores is a bound, however they were chosen.
    """
    rare = Window.partitionBy("_q").orderBy("df", "term")
    seeds = asked.withColumn("_rn", F.row_number().over(rare)).where(F.col("_rn") <= SEED_TERMS).drop("_rn")
    part = seeds.join(doc, "term").groupBy("_q", ckey).agg(F.sum(F.col("qw") * F.col("dw")).alias("part"))
    best = Window.partitionBy("_q").orderBy(F.desc("part"), ckey)
    first = part.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= 2 * k).select("_q", ckey)
    place = Window.partitionBy("_q").orderBy(F.desc("score"), ckey)
    kth = (full_scores(first, asked, doc, ckey).withColumn("_rn", F.row_number().over(place))
           .where(F.col("_rn") == k).select("_q", "score"))
    return (asked.select("_q").distinct().join(kth, "_q", "left")
            .select("_q", F.greatest(F.col("score"), F.lit(min_score)).alias("least")))


def full_scores(pairs: DataFrame, asked: DataFrame, doc: DataFrame, ckey: str) -> DataFrame:
    """(_q, ckey, score) of the given pairs."""
    return (pairs.join(doc.select(ckey, "term", "dw"), ckey).join(asked.select("_q", "term", "qw"), ["_q", "term"])
            .groupBy("_q", ckey).agg(F.round(F.sum(F.col("qw") * F.col("dw")), 9).alias("score")))


def candidates(asked: DataFrame, doc: DataFrame, ckey: str, least: DataFrame) -> DataFrame:
    """(_q, ckey) of all pairs that can reach the query's least score, and few that do not.

    Texts are told apart by the size of their largest weight. What a query's term can add to
    a score in such a class is bounded by the class's largest weight of the term; terms whose
    bounds together stay below a share of the least score cannot make a pair by themselves and are skipped,
    the commonest terms as a rule. The others are matched and their parts of the score added up; a pair
    stays if its part and all that the skipped terms could add reach the least score.
    """
    tops = doc.groupBy("term", "size").agg(F.max("dw").alias("top"))
    bound = F.col("qw") * F.col("top")
    w = Window.partitionBy("_q", "size").orderBy(bound, "term").rowsBetween(Window.unboundedPreceding, 0)
    reach = (asked.join(tops, "term").withColumn("reach", F.sum(bound).over(w)).join(least, "_q")
             .withColumn("skipped", F.col("reach") < SKIPPED * F.col("least")))
    rest = F.coalesce(F.max(F.when(F.col("skipped"), F.col("reach"))).over(Window.partitionBy("_q", "size")), F.lit(0.0))
    needed = (reach.withColumn("short", F.col("least") - SLACK - rest).where(~F.col("skipped"))
              .select("_q", "term", "size", "qw", "short"))
    return (needed.join(doc, ["term", "size"]).groupBy("_q", ckey)
            .agg(F.sum(F.col("qw") * F.col("dw")).alias("part"), F.max("short").alias("short"))
            .where(F.col("part") >= F.col("short")).select("_q", ckey))


def representatives(texts: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Each different text once, and who has it: (key, text, copies) and (key, of).

    ``of`` is the smallest key with the same text. Rows that share a key, or have none, stand for themselves.
    """
    rows = texts.select(key, F.coalesce(text, F.lit("")).alias(text))
    digest = F.unhex(F.sha2(text, 256))
    own = (rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.min(digest).alias("_text"))
           .withColumn("_own", F.when(F.col("_n") > 1, F.col(key).cast("string")).otherwise("")))
    alike = own.groupBy("_text", "_own").agg(F.min(key).alias("of"), F.count("*").alias("copies"))
    members = stored(own.join(alike, ["_text", "_own"]).select(key, "of", "copies"), "members")
    # Shuffled by key in any case: a small file is one task, but its texts multiply into their terms.
    once = rows.join(members.where(F.col(key) == F.col("of")).select(key, "copies").hint("merge"), key)
    nameless = rows.where(F.col(key).isNull()).withColumn("copies", F.lit(1).cast("long"))
    return once.select(key, text, "copies").unionByName(nameless), members.select(key, "of")


def _cells(once: DataFrame, key: str, text: str) -> DataFrame:
    """(key, copies, term, tf) of ``representatives``."""
    found = term_frequencies(unigrams_bigrams(tokens(text)))
    return once.select(key, "copies", F.inline_outer(found)).where("term IS NOT NULL")


def _vectors(queries: DataFrame, corpus: DataFrame, n: int, qkey: str, ckey: str, text: str, max_terms: int | None) -> tuple[DataFrame, DataFrame]:
    """Unit vectors of the queries and, over terms that are asked for, of the texts: (key, at, w), stored."""
    if max_terms is not None:
        return _limited_vectors(queries, corpus, n, qkey, ckey, text, max_terms)
    blocks = [term_blocks.text_blocks(df, key, tokens(text), F.col("copies"))
              for df, key in ((corpus, ckey), (queries.where(F.col(qkey).isNotNull()), qkey))]
    docs, asked = (df.where(F.size("at") > 0).select(F.col("key").alias(as_key), "at", F.transform("v", lambda x: x / F.col("norm")).alias("w"))
                   for df, as_key in zip(term_blocks.numbered(*blocks, n), ("_c", "_q"), strict=True))
    return stored(asked, "queries"), stored(docs, "texts")


def _limited_vectors(queries: DataFrame, corpus: DataFrame, n: int, qkey: str, ckey: str, text: str, max_terms: int) -> tuple[DataFrame, DataFrame]:
    """``_vectors`` over the most frequent terms.

    The terms of all texts are shuffled once. Beside each lies then in how many texts it occurs, so lengths and
    the weights that are asked for are put together by text from the same rows.
    """
    words = stored(_cells(queries, qkey, text).where(F.col(qkey).isNotNull()), "asked")
    terms = stored(words.select("term").distinct().withColumn("_at", F.monotonically_increasing_id()), "terms")
    counts = _cells(corpus, ckey, text)
    totals = counts.groupBy("term").agg(F.sum(F.col("tf") * F.col("copies")).alias("total"))
    counts = counts.join(totals.orderBy(F.desc("total"), "term").limit(max_terms).select("term"), "term", "left_semi")
    idf = F.log((1 + n) / (1 + F.col("df")).cast("double")) + 1.0
    v = (1.0 + F.log(F.col("tf").cast("double"))) * idf
    met = counts.withColumn("df", F.sum("copies").over(Window.partitionBy("term"))).join(terms, "term", "left")
    docs = stored(met.where(F.col(ckey).isNotNull()).withColumn("v", v).groupBy(ckey).agg(
        F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"),
        F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "v", "df"))).alias("found"))
        .where(F.size("found") > 0)
        .select(F.col(ckey).alias("_c"), F.col("found._at").alias("at"), F.col("found.df").alias("df"),
                F.transform("found.v", lambda x: x / F.col("norm")).alias("w")), "texts")
    known = docs.select(F.inline(F.arrays_zip("at", "df"))).groupBy("at").agg(F.min("df").alias("df"))
    asked = words.join(terms, "term").join(known, F.col("_at") == F.col("at")).withColumn("v", v)
    asked = stored(asked.groupBy(F.col(qkey).alias("_q")).agg(
        F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.collect_list(F.struct("_at", "v")).alias("found"))
        .select("_q", F.col("found._at").alias("at"), F.transform("found.v", lambda x: x / F.col("norm")).alias("w")), "queries")
    return asked, docs.select("_c", "at", "w")


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term numbers, weights and where each row's begin (and the last ends)."""
    at, w = (rows[c].combine_chunks() for c in ("at", "w"))
    at, w = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (at, w))
    starts = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return at.flatten().to_numpy(zero_copy_only=False), w.flatten().to_numpy(zero_copy_only=False), starts


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which range, and the place: the places of all ranges one after another, about ``ENTRIES`` at a time."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at] - sizes[at]
        to = max(int(np.searchsorted(ends, before + ENTRIES, side="right")), at + 1)
        size = sizes[at:to]
        yield np.repeat(np.arange(at, to), size), np.arange(ends[to - 1] - before) + np.repeat(begins[at:to] - (ends[at:to] - size - before), size)
        at = to


class _Part:
    """Texts of a cell by terms: ``terms`` that occur, where the postings of each begin, their number and largest weight."""

    def __init__(self, rows: np.ndarray, term: np.ndarray, w: np.ndarray, starts: np.ndarray) -> None:
        self.rows = rows
        which, place = (np.concatenate(x) for x in zip(*_ranges(starts[rows], starts[rows + 1] - starts[rows])))
        order = np.argsort(term[place], kind="stable")
        term, self.text, self.w = term[place[order]], which[order], w[place[order]]
        own = np.concatenate([[True], (np.diff(term) != 0) | (np.diff(self.text) != 0)])
        if not own.all():  # rows that share a key: their weights of a term add up
            own = np.flatnonzero(own)
            term, self.text, self.w = term[own], self.text[own], np.add.reduceat(self.w, own)
        self.terms, self.begins, self.sizes = np.unique(term, return_index=True, return_counts=True)
        self.tops = np.maximum.reduceat(self.w, self.begins)
        common = np.flatnonzero(self.sizes * COMMON >= len(rows))
        self.dense, self.place = np.zeros((len(common), len(rows))), np.full(len(self.terms), -1)
        self.place[common] = np.arange(len(common))
        for i, at in zip(common, (slice(b, b + n) for b, n in zip(self.begins[common], self.sizes[common]))):
            self.dense[self.place[i], self.text[at]] = self.w[at]

    def scored(self, query: np.ndarray, term: np.ndarray, w: np.ndarray, least: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, text, score) of all pairs that reach the query's least score.

        Queries are given by their terms, ordered by query. Common terms that together cannot lift a text to a share of
        the least score are skipped at first, and added where the others and all that these could add reach it.
        """
        m, n = len(least), len(self.rows)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        at, query, w = at[hit], query[hit], w[hit]
        alive = asks & (np.bincount(query, w * self.tops[at], m) >= least - SLACK)
        use = alive[query]
        at, query, w = at[use], query[use], w[use]
        order = np.lexsort((at, -self.sizes[at], query))
        at, query, w = at[order], query[order], w[order]
        bound = w * self.tops[at]
        sums = np.cumsum(bound)
        reach = sums - np.concatenate([[0.0], sums])[np.searchsorted(query, np.arange(m))][query]
        skip = (reach < LATE * least[query]) & (self.place[at] >= 0)
        rest = np.bincount(query[skip], bound[skip], m)
        score = np.zeros(m * n)
        met = np.flatnonzero(~skip)
        for which, place in _ranges(self.begins[at[met]], self.sizes[at[met]]):
            score += np.bincount(query[met][which] * n + self.text[place], self.w[place] * w[met][which], m * n)
        score = score.reshape(m, n)
        q, d = np.nonzero(score >= np.where(alive, least - SLACK - rest, np.inf)[:, None])
        score = score[q, d]
        late, by = self.place[at[skip]], w[skip]
        begins = np.searchsorted(query[skip], np.arange(m + 1))
        for which, place in _ranges(begins[q], begins[q + 1] - begins[q]):
            score += np.bincount(which, self.dense[late[place], d[which]] * by[place], len(q))
        score = np.round(score, 9)
        good = score >= least[q]
        return q[good], self.rows[d[good]], score[good]


def nearest(docs: pa.Table, asked: pa.Table, k: int, min_score: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of ``asked`` the rows of ``docs`` with the ``k`` best scores, best first, ties by row; and the scores.

    Texts are taken in parts with about the same largest weight, as then what a term adds to a score has a
    close bound; the score that a query's k-th best text has so far is its least score in the next part.
    """
    at, w, starts = _flat(docs)
    terms, term = np.unique(at, return_inverse=True)
    some = np.flatnonzero(np.diff(starts))
    if not len(some):
        return
    some = some[np.argsort(np.maximum.reduceat(w, starts[some]), kind="stable")]
    parts = [_Part(some[i: i + TOGETHER], term, w, starts) for i in range(0, len(some), TOGETHER)]
    q_at, q_w, q_starts = _flat(asked)
    step = max(PAIRS // min(TOGETHER, len(some)), 1)
    for first in range(0, asked.num_rows, step):
        m = min(step, asked.num_rows - first)
        own = slice(q_starts[first], q_starts[first + m])
        query = np.repeat(np.arange(m), np.diff(q_starts[first: first + m + 1]))
        found = np.minimum(np.searchsorted(terms, q_at[own]), len(terms) - 1)
        hit = terms[found] == q_at[own]
        query, found, by = query[hit], found[hit], q_w[own][hit]
        least, asks = np.full(m, float(min_score)), np.bincount(query, minlength=m) > 0
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for part in parts:
            new = part.scored(query, found, by, least, asks)
            if not len(new[0]):
                continue
            best = [np.concatenate(x) for x in zip(best, new)]
            order = np.lexsort((best[1], -best[2], best[0]))
            order = order[np.arange(len(order)) - np.searchsorted(best[0][order], best[0][order]) < k]
            best = [x[order] for x in best]
            kth = np.arange(len(order)) - np.searchsorted(best[0], best[0]) == k - 1
            least[best[0][kth]] = best[2][kth]
        for q, one in zip(np.unique(best[0]), np.split(np.arange(len(best[0])), np.flatnonzero(np.diff(best[0])) + 1)):
            yield first + int(q), best[1][one], best[2][one]


def _dealt_by_size(docs: DataFrame, least: int) -> tuple[DataFrame, int]:
    """``docs`` with their cell ``_cb``, ``least`` cells at least: texts with about the same largest weight, ``CELL`` weights on average."""
    kind = F.least(F.greatest(F.floor(-4 * F.log2(F.array_max("w"))), F.lit(0)), F.lit(60)).cast("int")
    sizes = sorted(tuple(r) for r in docs.groupBy(kind.alias("kind")).agg(F.sum(F.size("at"))).collect())
    most = max(min(CELL, sum(n for _, n in sizes) // max(least, 1)), 1)
    begins, held, cells, size = {}, [], 0, 0
    for i, (x, n) in enumerate(sizes):
        held, size = [*held, x], size + n
        if 2 * size >= most or i == len(sizes) - 1:
            own = -(-size // most)
            begins |= {y: (cells, own) for y in held}
            held, cells, size = [], cells + own, 0
    if not begins:
        return docs.withColumn("_cb", F.lit(0)), 1
    of = lambda j: F.element_at(F.create_map(*[F.lit(x) for y, z in begins.items() for x in (y, z[j])]), kind)
    return docs.withColumn("_cb", (of(0) + F.pmod(F.xxhash64("_c"), of(1))).cast("int")), cells


def _best(asked: DataFrame, docs: DataFrame, k: int, min_score: float) -> DataFrame:
    """(_q, _c, score): at least the ``k`` best texts of each query, from cells of a block of queries and one of texts."""
    spark = asked.sparkSession
    q_blocks = -(-int(asked.agg(F.sum(F.size("at"))).first()[0] or 0) // (2 * CELL)) or 1
    docs, c_blocks = _dealt_by_size(docs, -(-spark.sparkContext.defaultParallelism // q_blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = docs.select("_cb", every(q_blocks).alias("_qb"), "_c", "at", "w")
    right = asked.select(every(c_blocks).alias("_cb"), F.pmod(F.xxhash64("_q"), F.lit(q_blocks)).cast("int").alias("_qb"), "_q", "at", "w")
    schema = T.StructType([asked.schema["_q"], docs.schema["_c"], T.StructField("score", T.DoubleType())])

    def search(texts: pa.Table, queries: pa.Table) -> pa.Table:
        texts = texts.take(pc.sort_indices(texts, [("_c", "ascending")]))
        which, rows, scores = [], [], []
        for q, found, score in nearest(texts, queries, k, min_score) if texts.num_rows and queries.num_rows else ():
            which.append(np.full(len(found), q))
            rows.append(found)
            scores.append(score)
        joined = lambda x, kind: np.concatenate([np.zeros(0, kind), *x]).astype(kind)
        return pa.table([queries["_q"].take(pa.array(joined(which, np.int64))), texts["_c"].take(pa.array(joined(rows, np.int64))),
                         pa.array(joined(scores, np.float64))], names=["_q", "_c", "score"])

    return left.groupBy("_cb", "_qb").cogroup(right.groupBy("_cb", "_qb")).applyInArrow(search, schema)


def similar(queries: DataFrame, corpus: DataFrame, qkey: str, ckey: str, text: str = "text",
            k: int = 5, min_score: float = MIN_SIMILARITY, max_terms: int | None = None) -> DataFrame:
    """The k most similar corpus texts per query by cosine: (qkey, ckey, score, rank).

    Exact. Equal texts are looked up once: the first ``k`` of all keys are among the first ``k`` keys
    of each of the ``k`` best different texts, ordered by score and their smallest key.
    """
    asked, askers = representatives(queries, qkey, text)
    once, members = representatives(corpus, ckey, text)
    found = _best(*_vectors(asked, once, corpus.count(), qkey, ckey, text, max_terms), k, min_score)
    first = lambda df, by, key: df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*key))).where(F.col("rank") <= k)
    texts = first(found, "_q", [F.desc("score"), F.col("_c")]).drop("rank")
    named = first(members, "of", [F.col(ckey)]).select(F.col("of").alias("_c"), ckey)
    best = first(texts.join(named, "_c"), "_q", [F.desc("score"), F.col(ckey)])
    return best.join(askers.select(F.col("of").alias("_q"), qkey), "_q").select(qkey, ckey, "score", "rank")


def _weighted(queries: DataFrame, corpus: DataFrame, qkey: str, ckey: str, text: str, max_terms: int | None) -> tuple[DataFrame, DataFrame]:
    """Stored weights of the queries (_q, term, df, qw) and, of their terms, of the corpus (ckey, term, size, dw)."""
    counts = stored(term_counts(corpus, ckey, text), "terms")
    vocab = stored(vocabulary(counts, corpus, max_terms), "vocabulary")
    asked = stored(weights(term_counts(queries, qkey, text), vocab, qkey, keep=("df", "idf")).select(
        F.col(qkey).alias("_q"), "term", "df", "idf", F.col("weight").alias("qw")), "asked")
    # Terms that no query has matter for a text's length only. Lengths are added up before they are
    # shuffled, so that all terms move once, to meet their frequencies, and only those asked for again.
    v = (1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf")
    # The vocabulary has each term once, so a hash of it is even over the tasks; sorting all terms would cost more.
    lengths = (counts.join(vocab.select("term", "idf").hint("shuffle_hash"), "term").groupBy(ckey)
               .agg(F.sqrt(F.sum(v * v)).alias("norm"), F.max(v).alias("top")))
    size = F.floor(-2 * F.log2(F.col("top") / F.col("norm"))).cast("int")
    doc = stored(counts.join(asked.select("term", "idf").distinct(), "term").join(lengths, ckey)
                 .select(ckey, "term", size.alias("size"), (v / F.col("norm")).alias("dw")), "postings")
    return asked, doc


def similar_incidents(queries: DataFrame, corpus: DataFrame, qkey: str, ckey: str,
                      text: str = "text", k: int = 5, show: tuple[str, ...] = (),
                      description: str | None = None) -> DataFrame:
    """``similar`` with the found texts' columns; long texts are cut for display only."""
    hits = similar(queries, corpus, qkey, ckey, text, k)
    shown = corpus.select(F.col(ckey).alias("_found"), *show, F.substring(description or text, 1, 120).alias("description"))
    return (hits.join(shown, F.col(ckey) == F.col("_found")).drop("_found")
            .withColumn("similarity", F.bround("score", 3)).drop("score"))
