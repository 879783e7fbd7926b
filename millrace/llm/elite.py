"""How distinctive a term is of a record: two-Poisson mixtures beside tf-idf."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import PY_TERM, clean_id, has_text
from millrace.plans.store import dense_codes, materialize, small

#: Rounds of expectation-maximisation.
ROUNDS = 40
#: Rate below which a component counts as absent.
FLOOR = 1e-12
#: Terms that a worker keeps at hand, and uses counted at a time.
KEPT_TERMS, STEP = 500_000, 1_000_000


class _Terms(dict):
    """Numbers of terms, and which of them aren't of digits only."""

    def __init__(self):
        super().__init__()
        self.names: list[str] = []
        self.counts: list[bool] = []

    def __missing__(self, term: str) -> int:
        k = self[term] = len(self.names)
        self.names.append(term)
        self.counts.append(not term.isdecimal())
        return k


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Uses of each term by record, counted over some texts at a time."""
    find, known = re.compile(PY_TERM).findall, _Terms()

    def out(flat: list[int], records: np.ndarray, sizes: list[int]) -> pa.RecordBatch:
        rec, of = np.unique(records, return_inverse=True)
        keys = np.sort(np.repeat(of, sizes) * len(known.names) + np.array(flat, np.int64))
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        tf, keys = np.diff(np.append(first, len(keys))), keys[first]
        term = keys % len(known.names)
        on = np.array(known.counts)[term]
        used, place = np.unique(term[on], return_inverse=True)
        names = pa.array([known.names[k] for k in used.tolist()], pa.string()).take(pa.array(place))
        return pa.RecordBatch.from_arrays([pa.array(rec[(keys // len(known.names))[on]]), names, pa.array(tf[on])], names=["r", "term", "tf"])

    for batch in batches:
        records, begin = batch.column(0).to_numpy(), 0
        flat: list[int] = []
        sizes: list[int] = []
        for k, text in enumerate(batch.column(1).to_pylist()):
            found = find(text.lower())
            flat.extend(map(known.__getitem__, found))
            sizes.append(len(found))
            if len(flat) >= STEP or k == batch.num_rows - 1:
                if flat:
                    yield out(flat, records[begin : k + 1], sizes)
                flat, sizes, begin = [], [], k + 1
        if len(known) > KEPT_TERMS:
            known = _Terms()


def fit_two_poisson(tf: np.ndarray, count: np.ndarray, term: np.ndarray, n_terms: int, n_records: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Background rate, elite rate and elite share of each term, from its histogram cells (tf >= 1, number of records);
    the records without the term are the cell of 0. Starts with the records that hold the term as the elite ones."""
    total = np.bincount(term, tf * count, n_terms)
    df = np.bincount(term, count, n_terms)
    zero = np.maximum(n_records - df, 0.0)
    share = np.clip(df / n_records, 1e-12, 1 - 1e-9)
    high = total / df
    low = np.maximum(0.1 * total / n_records, FLOOR)
    for _ in range(rounds):
        base = np.log(share) - np.log1p(-share) - (high - low)
        slope = np.log(high) - np.log(low)
        p = 1 / (1 + np.exp(-np.clip(base[term] + tf * slope[term], -700, 700)))
        p0 = 1 / (1 + np.exp(-np.clip(base, -700, 700)))
        elite = np.bincount(term, p * count, n_terms) + p0 * zero
        uses = np.bincount(term, p * tf * count, n_terms)
        share = np.clip(elite / n_records, 1e-12, 1 - 1e-9)
        high = np.maximum(uses / np.maximum(elite, FLOOR), FLOOR)
        low = np.maximum((total - uses) / np.maximum(n_records - elite, FLOOR), FLOOR)
    return low, high, share


def _fit(n_records: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column(1)
            sizes = np.diff(cells.offsets.to_numpy())
            flat = cells.flatten()
            tf, count = (flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1))
            of = np.repeat(np.arange(batch.num_rows), sizes)
            low, high, share = fit_two_poisson(tf, count, of, batch.num_rows, n_records, rounds)
            df = np.bincount(of, count, batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (df, low, high, share))], names=["term", "df", "background_rate", "elite_rate", "elite_share"])

    return run


def distinctive_terms(df: DataFrame, record: str, text: str, stopwords: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Scores every term of every record (all texts of one value of `record` together).

    Returns record, term, tf (uses in the record), df (records with the term), n (records with any term), elite (the
    posterior probability that the record is about the term), elite_rate, background_rate, and score = tf * log2(n / df)
    rounded to 9 places.

    Per term a mixture of two Poisson distributions is fitted by expectation-maximisation on the histogram of its counts
    (number of records by tf, the records without it included), many terms at a time. The histogram has at most as many
    cells as there are distinct counts, so a term held by every record is no larger a group than another; rows meet the
    parameters in one join by term, and the posterior of each count is a closed expression. Records travel as dense numbers.

    Terms of digits only and those of `stopwords` (column `word`, trimmed and lower-cased) don't count. Null and blank
    records and texts are left out; a record without terms has no row; repeated rows are counted as they come; other
    columns are ignored; an empty table gives no rows.
    """
    words = df.select(clean_id(record).alias("record"), F.col(text).alias("_t")).where(F.col("record").isNotNull() & has_text("_t"))
    words = materialize(words)
    codes = small(materialize(dense_codes(words.select("record").distinct(), "record", "r")))
    uses = words.join(codes, "record").select("r", "_t").mapInArrow(_uses, "r long, term string, tf long")
    tf = uses.groupBy("r", "term").agg(F.sum("tf").alias("tf"))
    if stopwords is not None:
        listed = stopwords.select(F.lower(F.trim("word")).alias("term")).where("term <> ''").distinct()
        tf = tf.join(small(listed), "term", "left_anti")
    tf = materialize(tf)
    n = tf.select("r").distinct().count()
    cells = tf.groupBy("term", "tf").agg(F.count("*").alias("c")).groupBy("term").agg(F.collect_list(F.struct("tf", "c")).alias("cells"))
    fitted = cells.mapInArrow(_fit(max(n, 1), rounds), "term string, df long, background_rate double, elite_rate double, elite_share double")
    odds = F.ln(F.col("elite_share") / (1 - F.col("elite_share"))) - (F.col("elite_rate") - F.col("background_rate")) + F.col("tf") * (F.ln("elite_rate") - F.ln("background_rate"))
    elite = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), odds))))
    score = F.round(F.col("tf") * F.log2(F.lit(float(n)) / F.col("df")), 9)
    return tf.join(fitted, "term").join(codes, "r").select("record", "term", "tf", "df", F.lit(n).cast("long").alias("n"), elite.alias("elite"), "elite_rate", "background_rate", score.alias("score"))


def most_distinctive(scored: DataFrame) -> DataFrame:
    """The row of the highest score of each record; equal scores: the first term in word order. Combines before the exchange."""
    best = F.min(F.struct((-F.col("score")).alias("o"), "term", "tf", "df", "n", "elite", "score"))
    return scored.groupBy("record").agg(best.alias("b")).select("record", "b.term", "b.tf", "b.df", "b.n", "b.elite", "b.score")
