"""Text vectors: a randomised truncated SVD of the documents' weighted terms, made by block products in Spark.

The matrix has a row per document and a column per term, and stays in long form. A term's random numbers are
hash draws, so they are sent nowhere and a lost task makes them again. Each product with the matrix is a sum per
document or per term; between them rows of a few numbers are kept per document or term, and only their
width x width inner products reach the driver.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shelfrank.functions.draws import uniform
from shelfrank.functions.lookup import small_side
from shelfrank.session import materialize

# Columns beyond the wanted ones, which make the random start more exact.
OVERSAMPLE = 10
# Directions with less than this share of the largest one's square are taken for rounding.
LEAST_SHARE = 1e-9


def _times(matrix: DataFrame, rows: DataFrame, along: str, out: str, width: int) -> DataFrame:
    """(out, row): the matrix, or its transpose, times a table of one row per ``along``.

    Sums are begun where the joined rows are, so a term found in every document sends one row a task.
    """
    met = matrix.join(small_side(rows), along)
    sums = met.groupBy(out).agg(*[F.sum(F.col("weight") * F.get("row", F.lit(j))).alias(f"_{j}") for j in range(width)])
    return sums.select(out, F.array(*[F.col(f"_{j}") for j in range(width)]).alias("row"))


def gram(rows: DataFrame, width: int) -> np.ndarray:
    """Inner products of the columns: width x width sums over all rows."""

    def sums(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                block = np.stack(batch["row"])
                total += block.T @ block
        yield pd.DataFrame({"cell": np.arange(width * width), "total": total.ravel()})

    # A batch holds some thousand short rows; a task sends width x width sums.
    found = rows.select("row").mapInPandas(sums, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(width * width)
    for r in found:
        out[r.cell] = r.total
    return out.reshape(width, width)


def _rotated(rows: DataFrame, key: str, turn: np.ndarray) -> DataFrame:
    """Every row times a small matrix."""
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, row array<double>"

    def run(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({key: batch[key], "row": list(np.stack(batch["row"]) @ turn)})

    return rows.select(key, "row").mapInPandas(run, schema)


def _orthogonal(rows: DataFrame, key: str, width: int) -> tuple[DataFrame, int]:
    """The table with orthonormal columns that span the same space, and how many there are."""
    values, directions = np.linalg.eigh(gram(rows, width))
    held = values > max(values.max(), 0.0) * LEAST_SHARE
    if not held.any():
        return rows.limit(0), 0
    return _rotated(rows, key, directions[:, held] / np.sqrt(values[held])), int(held.sum())


def text_svd(weights: DataFrame, dimension: int, rounds: int = 4, seed: int = 42, key: str = "product_id") -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(documents, terms, singular values) of the ``dimension`` largest directions of (key, term, weight).

    ``documents`` has (key, vector): left vectors times singular values, so inner products of documents are those of their weighted
    terms, as far as ``dimension`` directions hold them. ``terms`` has (term, vector): right vectors; a text that is not in the
    table becomes a vector by ``fold_in``. ``rounds`` passes with the matrix and its transpose sharpen the random start. The sign of a direction
    is chosen so that the sum of its terms' cubed entries is not negative. Fewer directions come back where the matrix has fewer;
    equal (key, term) rows add up; rows with a null or non-finite weight count as absent. An empty table gives empty tables.
    """
    if dimension < 1 or rounds < 1:
        raise ValueError("dimension and rounds are 1 or more")
    given = weights.filter("weight IS NOT NULL AND NOT isnan(weight) AND abs(weight) <> double('infinity') AND term IS NOT NULL").filter(F.col(key).isNotNull())
    matrix = materialize(given.groupBy(key, "term").agg(F.sum(F.col("weight").cast("double")).alias("weight")))
    width = dimension + OVERSAMPLE
    start = F.array(*[uniform(seed, f"direction{j}", "term") - 0.5 for j in range(width)])
    terms = materialize(matrix.select("term").distinct().select("term", start.alias("row")))
    for at in range(rounds):
        basis, width = _orthogonal(materialize(_times(matrix, terms, "term", key, width)), key, width)
        basis = materialize(basis)
        # A basis of the documents times the matrix: after the last round its own decomposition finishes the work.
        terms = materialize(_times(matrix, basis, key, "term", width)) if width else terms.limit(0)
        if width and at < rounds - 1:
            terms, width = _orthogonal(terms, "term", width)
            terms = materialize(terms)
        if not width:
            return basis.limit(0).withColumnRenamed("row", "vector"), terms.limit(0).withColumnRenamed("row", "vector"), np.zeros(0)
    values, turn = np.linalg.eigh(gram(terms, width))
    order = np.argsort(-values, kind="stable")[:dimension]
    order = order[values[order] > max(values.max(), 0.0) * LEAST_SHARE]
    singular, turn = np.sqrt(values[order]), turn[:, order]
    right = materialize(_rotated(terms, "term", turn / singular))
    cubes = right.select(*[F.sum(F.pow(F.get("row", F.lit(j)), 3)).alias(f"_{j}") for j in range(len(order))]).first()
    signs = np.array([-1.0 if c < 0 else 1.0 for c in cubes])
    turned = _rotated(right, "term", np.diag(signs)).withColumnRenamed("row", "vector")
    left = _rotated(basis, key, turn * singular * signs).withColumnRenamed("row", "vector")
    return materialize(left), materialize(turned), singular


def fold_in(weights: DataFrame, terms: DataFrame, dimension: int, key: str = "query_id") -> DataFrame:
    """(key, vector) of texts outside the table, from their (key, term, weight) rows and the directions of ``terms``.

    Words the table has not seen count nothing; a text without any known word has no row.
    """
    known = terms.withColumnRenamed("vector", "row")
    return _times(weights.select(key, "term", F.col("weight").cast("double").alias("weight")), known, "term", key, dimension).withColumnRenamed("row", "vector")
