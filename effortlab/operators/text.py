"""Text vectorisation: tokens, term statistics, vocabulary, TF-IDF and LSA.

Data layout: documents stay rows; term weights are a long table
``(doc, term_idx, weight)``.  Texts are tokenised where they are read; the
per-document counts and the L2 norm move (doc, term, number) rows only.  The
vocabulary (<= max_features
rows) and the SVD basis (max_features x k doubles) are the only broadcast
tables; both have a size bound fixed by parameters.
"""

from __future__ import annotations

import os
import sys
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows projected together: bounds the weighted rows of the basis that a task holds.
EMBED_ROWS = 256
#: Tokens of the lists that are looked up together (or one list): a batch of long texts holds millions.
EMBED_TOKENS = 1 << 18

#: Vocabularies of this size and more are decomposed with blocks of vectors.
BLOCK_TERMS = 1_000
#: Vectors multiplied in one job, vectors of the basis at most (size x 256 doubles on the driver), rounds at most.
BLOCK, BLOCK_BASIS, BLOCK_ROUNDS = 12, 256, 1_000
#: Partitions whose products (size x 12 doubles each) are added up on the driver at once; more are along a tree.
FEW_PARTS = 32
#: Residual of an eigenvalue, relative to it (as in ``RowMatrix.computeSVD``).
SVD_TOLERANCE = 1e-10
#: Weights multiplied together by a task: bounds its memory (two dense rows of a block each).
GRAM_WEIGHTS = 1 << 18
#: Vectors of a block multiplied together by a task, likewise.
GRAM_VECTORS = 4

# Fixed value: a token is a maximal run of >= 2 word characters (letters,
# digits, underscore) of the lower-cased text.
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"


def tokens(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN_RE), 0)


def term_counts(docs: DataFrame, doc: str = "ticket_id", text: str = "text", carry: tuple = ()) -> DataFrame:
    """(doc, term, tf) for every term of every document.

    Terms are exploded and counted where the texts are read; only the partial
    counts move, never a text.  ``carry`` columns are per-document attributes kept
    in the key (free: they are functions of the document)."""
    ex = docs.select(doc, *carry, F.explode(tokens(text)).alias("term"))
    return ex.groupBy(doc, *carry, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary_stats(tc: DataFrame, doc: str = "ticket_id") -> DataFrame:
    """Per term: document frequency and corpus frequency (combined map-side,
    so very frequent terms do not skew a task)."""
    return tc.groupBy("term").agg(F.count(F.col(doc)).alias("df"), F.sum("tf").alias("cf"))


def vocabulary(stats: DataFrame, min_df: int = 2, max_features: int | None = 25_000) -> DataFrame:
    """Terms with df >= min_df; the ``max_features`` most frequent by corpus
    frequency (ties by term).  ``term_idx`` is the alphabetical position.

    The vocabulary is broadcast and indexed in one task, so it must have a
    size bound: ``max_features`` is required."""
    if not max_features:
        raise ValueError("max_features must bound the vocabulary size")
    v = stats.filter(F.col("df") >= min_df)
    v = v.orderBy(F.col("cf").desc(), F.col("term").asc()).limit(max_features)
    # <= max_features rows: a single-partition window is bounded.
    return v.withColumn("term_idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))


@dataclass
class TfidfModel:
    """Fitted vocabulary with smooth idf: ln((1 + n) / (1 + df)) + 1."""
    vocab: DataFrame          # term, term_idx, df, cf, idf
    n_docs: int
    size: int

    def transform(self, docs: DataFrame, doc: str = "ticket_id", text: str = "text") -> DataFrame:
        return tfidf_transform(docs, self, doc, text)

    def terms(self) -> tuple[list[str], np.ndarray]:
        """Terms in the order of their index, and their idf (``max_features`` at most)."""
        rows = self.vocab.select("term_idx", "term", "idf").orderBy("term_idx").collect()
        return [r["term"] for r in rows], np.array([r["idf"] for r in rows], float)


def fit_tfidf_counts(train_tc: DataFrame, n_docs: int, doc: str = "ticket_id", min_df: int = 2,
                     max_features: int | None = 25_000) -> TfidfModel:
    """Fit from term counts of the training documents (n = training
    documents, including those without tokens).  The vocabulary is written
    once to the checkpoint folder; its size is then known exactly."""
    from ..session import materialize
    vocab = vocabulary(vocabulary_stats(train_tc, doc), min_df, max_features)
    vocab = vocab.withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)
    vocab = materialize(vocab, "vocab")
    return TfidfModel(vocab, n_docs, vocab.count())


def fit_tfidf(train: DataFrame, doc: str = "ticket_id", text: str = "text", min_df: int = 2,
              max_features: int | None = 25_000) -> TfidfModel:
    """Fit on the training documents only (n and df come from train)."""
    return fit_tfidf_counts(term_counts(train, doc, text), train.select(doc).count(), doc, min_df, max_features)


def fit_transform_tfidf(docs: DataFrame, is_train, doc: str = "ticket_id", text: str = "text",
                        min_df: int = 2, max_features: int | None = 25_000) -> tuple[TfidfModel, DataFrame]:
    """Fit on the rows where ``is_train`` holds and transform all rows with a
    single tokenisation pass: term counts are written once (with the train
    flag) and both the fit and the transform read them."""
    model, tc = _fit_on_counts(docs, is_train, doc, text, min_df, max_features)
    return model, tfidf_from_counts(tc, model, doc)


def fit_transform_rows(docs: DataFrame, is_train, doc: str = "ticket_id", text: str = "text",
                       min_df: int = 2, max_features: int | None = 25_000) -> tuple[TfidfModel, DataFrame]:
    """As :func:`fit_transform_tfidf`, with the weights as one row per document,
    written once: what reads them again and again moves no term."""
    from ..session import materialize
    model, tc = _fit_on_counts(docs, is_train, doc, text, min_df, max_features)
    return model, materialize(document_rows(tc, model, doc), "tfidf-rows")


def _fit_on_counts(docs: DataFrame, is_train, doc: str, text: str, min_df: int,
                   max_features: int | None) -> tuple[TfidfModel, DataFrame]:
    from ..session import materialize
    flagged = docs.select(doc, text, F.coalesce(is_train, F.lit(False)).alias("_train"))
    tc = materialize(term_counts(flagged, doc, text, carry=("_train",)), "term-counts")
    n = flagged.filter("_train").count()
    return fit_tfidf_counts(tc.filter("_train").drop("_train"), n, doc, min_df, max_features), tc.drop("_train")


def tfidf_transform(docs: DataFrame, model: TfidfModel, doc: str = "ticket_id", text: str = "text") -> DataFrame:
    """(doc, term_idx, weight) with weight = (1 + ln tf) * idf, L2-normalised
    per document.  Documents without a known term have no rows (a zero
    vector)."""
    return tfidf_from_counts(term_counts(docs, doc, text), model, doc)


def tfidf_from_counts(tc: DataFrame, model: TfidfModel, doc: str = "ticket_id") -> DataFrame:
    w = _unnormed(tc, model, doc)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return w.select(doc, "term_idx", (F.col("w") / norm).alias("weight"))


def _unnormed(tc: DataFrame, model: TfidfModel, doc: str) -> DataFrame:
    v = F.broadcast(model.vocab.select("term", "term_idx", "idf"))     # <= max_features rows
    return tc.join(v, "term").select(doc, "term_idx", ((1.0 + F.log(F.col("tf"))) * F.col("idf")).alias("w"))


def document_rows(tc: DataFrame, model: TfidfModel, doc: str = "ticket_id") -> DataFrame:
    """(doc, weights): the weights of :func:`tfidf_from_counts`, one row per
    document with its (term_idx, weight) pairs by term."""
    e = _unnormed(tc, model, doc).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("term_idx", "w"))).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    # Handed over in a list, the norm is computed once a document and not at each of its terms.
    normed = F.transform(F.array(norm), lambda n: F.transform("e", lambda x: F.struct(
        x["term_idx"].alias("term_idx"), (x["w"] / n).alias("weight"))))
    return e.select(doc, normed[0].alias("weights"))


def long_weights(rows: DataFrame, doc: str = "ticket_id") -> DataFrame:
    """(doc, term_idx, weight) of one row per document."""
    return rows.select(doc, F.inline("weights"))


# ---------------------------------------------------------------- LSA
def sparse_rows(tfidf: DataFrame, size: int, doc: str = "ticket_id") -> DataFrame:
    """One sparse vector struct per document (indices ascending), in the
    storage layout of the vector type."""
    if "weights" in tfidf.columns:
        g = tfidf.select(doc, F.col("weights").alias("e"))
    else:
        g = tfidf.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("term_idx", "weight"))).alias("e"))
    return g.select(doc, F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(size).cast("int").alias("size"),
        F.col("e.term_idx").alias("indices"), F.col("e.weight").alias("values")).alias("v"))


def _vector_frame(tfidf: DataFrame, size: int, doc: str) -> DataFrame:
    """Write the sparse rows to the checkpoint folder and read them back as
    a vector column, so the SVD iterations run in the JVM only."""
    from pyspark.mllib.linalg import VectorUDT
    spark = tfidf.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", f"lsa-rows-{uuid.uuid4().hex}")
    sparse_rows(tfidf, size, doc).select("v").write.parquet(path)
    return spark.read.schema(T.StructType([T.StructField("v", VectorUDT())])).parquet(path)


@dataclass
class LsaModel:
    components: np.ndarray    # size x k, columns = right singular vectors
    singular_values: np.ndarray
    basis: DataFrame          # term_idx, comp array<double>

    def transform(self, tfidf: DataFrame, doc: str = "ticket_id", docs: DataFrame | None = None) -> DataFrame:
        return lsa_transform(tfidf, self, doc, docs)


def fit_lsa(tfidf: DataFrame, size: int, k: int = 32, doc: str = "ticket_id") -> LsaModel:
    """Truncated SVD (no centring) of the training TF-IDF matrix (long, or one
    row per document); each component's largest-magnitude entry is made positive.

    Small vocabularies go to the distributed ``RowMatrix.computeSVD``, whose every job
    multiplies by one vector; large ones to :func:`block_svd`, to the same tolerance
    in fewer jobs.  A job sends ``size`` numbers a vector for each partition, so there
    are no more partitions than cores."""
    spark = tfidf.sparkSession
    if size >= BLOCK_TERMS and k <= BLOCK_BASIS // 4:
        s, V = block_svd(tfidf, size, k, doc)
    else:
        s, V = _matrix_svd(tfidf, size, k, doc)
    big = np.abs(V).argmax(axis=0)
    signs = np.sign(V[big, np.arange(V.shape[1])])
    signs[signs == 0] = 1.0
    V = V * signs
    basis = spark.createDataFrame([(int(i), V[i].tolist()) for i in range(V.shape[0])],
                                  "term_idx int, comp array<double>")
    return LsaModel(V, s, basis)


def _matrix_svd(tfidf: DataFrame, size: int, k: int, doc: str) -> tuple[np.ndarray, np.ndarray]:
    from pyspark import StorageLevel
    from pyspark.mllib.linalg.distributed import RowMatrix
    spark = tfidf.sparkSession
    rows = _vector_frame(tfidf, size, doc).coalesce(max(1, spark.sparkContext.defaultParallelism)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        svd = RowMatrix(rows).computeSVD(k, computeU=False)
        return svd.s.toArray(), svd.V.toArray()
    finally:
        rows.unpersist()


def gram_product(begins: np.ndarray, terms: np.ndarray, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A'A x for sparse rows that begin at ``begins`` (none is empty)."""
    out = np.zeros_like(x)
    ends = np.append(begins[1:], len(terms))
    lo = 0
    while lo < len(begins):                                          # as many rows as hold GRAM_WEIGHTS weights
        hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + GRAM_WEIGHTS, "right")))
        a, b = begins[lo], ends[hi - 1]
        t, w = terms[a:b], weights[a:b, None]
        order = np.argsort(t, kind="stable")
        first = np.flatnonzero(np.diff(t[order], prepend=-1))
        row = np.repeat(np.arange(hi - lo), ends[lo:hi] - begins[lo:hi])
        for c in range(0, x.shape[1], GRAM_VECTORS):
            some = slice(c, c + GRAM_VECTORS)
            y = np.add.reduceat(w * x[t, some], begins[lo:hi] - a)
            out[t[order[first]], some] += np.add.reduceat((w * y[row])[order], first)
        lo = hi
    return out


def _row_arrays(batches):
    """Rows of an Arrow batch as packed arrays: where they begin, terms, weights."""
    for batch in batches:
        lists = batch.column(0)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        pairs, sizes = lists.flatten(), sizes[sizes > 0].astype(np.int64)
        if len(sizes):
            arrays = (np.cumsum(sizes) - sizes, pairs.field(0).to_numpy(zero_copy_only=False).astype(np.int32),
                      pairs.field(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], ["begins", "terms", "weights"])


def block_svd(tfidf: DataFrame, size: int, k: int, doc: str = "ticket_id", tol: float = SVD_TOLERANCE,
              block: int = BLOCK, most: int = BLOCK_BASIS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest singular values and their right vectors by block Lanczos
    on A'A with restarts: a job multiplies by ``block`` vectors where the rows are (cached,
    packed) and adds up the products, of few partitions without a shuffle.  The basis (``size`` x ``most`` at most)
    stays orthogonal by itself; done when every residual is below ``tol`` of its eigenvalue,
    or when nothing is left of the products and another random block changes no value.
    As in ``computeSVD``, singular values under 1e-9 of the largest are left out."""
    from pyspark import StorageLevel
    spark = tfidf.sparkSession
    cores = max(1, spark.sparkContext.defaultParallelism)
    long = tfidf if "weights" in tfidf.columns else tfidf.groupBy(doc).agg(
        F.array_sort(F.collect_list(F.struct("term_idx", "weight"))).alias("weights"))
    packed = (long.select("weights").coalesce(cores).mapInArrow(_row_arrays, "begins binary, terms binary, weights binary").rdd
              .map(lambda r: (np.frombuffer(r[0], np.int64), np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float64)))
              .persist(StorageLevel.MEMORY_AND_DISK))

    def product(x: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(x)

        def of_part(parts):
            total = None
            for part in parts:
                p = gram_product(*part, shared.value)
                total = p if total is None else total + p
            return [] if total is None else [total]

        try:
            parts = packed.mapPartitions(of_part)
            return parts.reduce(np.add) if cores <= FEW_PARTS else parts.treeReduce(np.add)
        finally:
            shared.destroy()

    try:
        if packed.isEmpty():
            raise ValueError("no document has a known term")
        rng, settled = np.random.default_rng(seed), np.zeros(0)
        x = np.linalg.qr(rng.standard_normal((size, min(block, size))))[0]
        v, h = np.zeros((size, 0)), np.zeros((0, 0))                 # the basis, and the products within it
        for _ in range(BLOCK_ROUNDS):
            gx = product(x)
            v = np.hstack([v, x])
            within = v.T @ gx
            h = np.block([[h, within[:len(h)]], [within[:len(h)].T, (within[len(h):] + within[len(h):].T) / 2]])
            values, y = np.linalg.eigh(h)
            values, y = np.maximum(values[::-1], 0.0), y[:, ::-1]
            rest = gx - v @ within
            rest -= v @ (v.T @ rest)
            left, sizes, right = np.linalg.svd(rest, full_matrices=False)
            missed = np.linalg.norm((sizes[:, None] * right) @ y[-x.shape[1]:], axis=0)
            held = sizes > values[0] * 1e-12
            if held.any():
                if not len(settled) and len(values) >= k and (missed[:k] <= tol * np.maximum(values[:k], values[0] * 1e-16)).all():
                    break
                x = left[:, held]
            else:                                                    # closed: another start may find more copies of a value
                new = rng.standard_normal((size, min(block, size - v.shape[1])))
                if not new.shape[1] or len(settled) == len(values[:k]) and np.allclose(settled, values[:k], rtol=tol, atol=values[0] * 1e-12):
                    break
                x, settled = np.linalg.qr(new - v @ (v.T @ new))[0], values[:k].copy()
            if v.shape[1] + block > most:
                keep = most // 2
                v, h = v @ y[:, :keep], np.diag(values[:keep])
            x = np.linalg.qr(x - v @ (v.T @ x))[0]
        else:
            raise RuntimeError(f"the decomposition did not converge in {BLOCK_ROUNDS} rounds")
        s = np.sqrt(values[:k])
        kept = s >= 1e-9 * s[0]
        return s[kept], (v @ y[:, :len(s)])[:, kept]
    finally:
        packed.unpersist()


def embed_token_lists(lists: pa.Array, terms: pa.Array, idf: np.ndarray, basis: np.ndarray) -> pa.Array:
    """Embedding of every token list: known terms counted, weighted, normalised
    and projected, for some lists at once.  A null list counts as empty."""
    rows, k = len(lists), basis.shape[1]
    out = np.zeros((rows, k))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < rows and k:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + EMBED_TOKENS, "right")))
        _embed_into(out[lo:hi], lists.slice(lo, hi - lo), terms, idf, basis)
        lo = hi
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * k, pa.int32()), pa.array(out.ravel()))


def _embed_into(out: np.ndarray, lists: pa.Array, terms: pa.Array, idf: np.ndarray, basis: np.ndarray) -> None:
    rows, tokens = len(lists), lists.flatten()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    term = pc.fill_null(pc.index_in(tokens, value_set=terms), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(rows), sizes)[term >= 0]
    key, tf = np.unique(row * len(idf) + term[term >= 0], return_counts=True)
    row, term = np.divmod(key, len(idf)) if len(key) else (key, key)
    weight = (1.0 + np.log(tf)) * idf[term]
    weight /= np.sqrt(np.bincount(row, weight * weight, rows))[row]
    first = np.flatnonzero(np.diff(row, prepend=-1))                 # of every row that has a known term
    for at, end in zip(range(0, len(first), EMBED_ROWS), [*range(EMBED_ROWS, len(first), EMBED_ROWS), len(first)]):
        lo, hi = first[at], first[end] if end < len(first) else len(row)
        out[row[first[at:end]]] = np.add.reduceat(weight[lo:hi, None] * basis[term[lo:hi]], first[at:end] - lo)


def embed_texts(df: DataFrame, tfidf: "TfidfModel", lsa: "LsaModel", text: str = "text", out: str = "embedding") -> DataFrame:
    """``df`` with the embedding of each row's text, computed where the row is:
    nothing is shuffled or joined, rows need no id and may repeat one.  The text
    is tokenised in the JVM; its tokens meet the vocabulary and the basis, both
    bounded by ``max_features`` and broadcast, in Arrow batches.  A null text
    counts as empty, and a text without a known term is a zero vector."""
    shared = df.sparkSession.sparkContext.broadcast(tfidf.terms() + (np.ascontiguousarray(lsa.components),))

    @F.arrow_udf("array<double>")
    def embed(lists: pa.Array) -> pa.Array:
        terms, idf, basis = shared.value
        return embed_token_lists(lists, pa.array(terms, pa.string()), idf, basis)

    return df.withColumn(out, embed(tokens(F.coalesce(F.col(text), F.lit("")))))


def lsa_transform(tfidf: DataFrame, model: LsaModel, doc: str = "ticket_id",
                  docs: DataFrame | None = None, out: str = "embedding") -> DataFrame:
    """Project documents on the basis: sum of weight x component row per
    document (one aggregate with k sums; input is already partitioned by
    document).  One row per document is projected where it is.  With ``docs``
    given, documents without terms get zeros."""
    k = model.components.shape[1]
    if "weights" in tfidf.columns:
        emb = _project(tfidf, model, doc, out)
        return emb if docs is None else _with_zeros(emb, docs, doc, k, out)
    j = tfidf.join(F.broadcast(model.basis), "term_idx")          # size x k doubles
    sums = [F.sum(F.col("weight") * F.col("comp")[i]).alias(f"e{i}") for i in range(k)]
    emb = j.groupBy(doc).agg(*sums).select(doc, F.array(*[F.col(f"e{i}") for i in range(k)]).alias(out))
    return emb if docs is None else _with_zeros(emb, docs, doc, k, out)


def _with_zeros(emb: DataFrame, docs: DataFrame, doc: str, k: int, out: str) -> DataFrame:
    zeros = F.array(*[F.lit(0.0) for _ in range(k)])
    return docs.select(doc).join(emb, doc, "left").withColumn(out, F.coalesce(F.col(out), zeros))


def project_weights(lists: pa.Array, basis: np.ndarray) -> pa.Array:
    """Embedding of every list of (term_idx, weight) pairs, ``EMBED_ROWS`` lists
    at a time."""
    k, pairs = basis.shape[1], lists.flatten()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    term, weight = (pairs.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    out = np.zeros((len(lists), k))
    full = np.flatnonzero(ends > begins)
    for at in range(0, len(full), EMBED_ROWS):
        part = full[at:at + EMBED_ROWS]
        lo, hi = begins[part[0]], ends[part[-1]]
        out[part] = np.add.reduceat(weight[lo:hi, None] * basis[term[lo:hi]], begins[part] - lo)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * k, pa.int32()), pa.array(out.ravel()))


def _project(rows: DataFrame, model: LsaModel, doc: str, out: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.components))    # size x k doubles

    @F.arrow_udf("array<double>")
    def embed(lists: pa.Array) -> pa.Array:
        return project_weights(lists, shared.value)

    return rows.select(doc, embed("weights").alias(out))


def explained_variance(tfidf: DataFrame, emb: DataFrame, n_docs: int, k: int, out: str = "embedding") -> DataFrame:
    """Share of the total (per-term, zeros included) variance captured by the
    components: sum_j var(emb_j) / sum_t var(x_t), population variances over
    all ``n_docs`` documents."""
    n = float(n_docs)
    term_var = tfidf.groupBy("term_idx").agg(F.sum("weight").alias("s1"), F.sum(F.col("weight") ** 2).alias("s2"))
    total = term_var.agg(F.sum(F.col("s2") / n - (F.col("s1") / n) ** 2).alias("total"))
    comp = emb.agg(*[F.sum(F.col(out)[i]).alias(f"a{i}") for i in range(k)],
                   *[F.sum(F.col(out)[i] ** 2).alias(f"b{i}") for i in range(k)])
    ev = sum((F.col(f"b{i}") / n - (F.col(f"a{i}") / n) ** 2) for i in range(k))
    return comp.select(ev.alias("explained")).select(
        (F.col("explained") / total.scalar()).alias("explained_variance_ratio"))
