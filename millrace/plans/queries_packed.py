"""Queries of packed fields."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.packed import split_packed
from millrace.plans.store import latest, materialize
from millrace.sources import read_table


def _business(spark: SparkSession, d: str) -> DataFrame:
    return latest(read_table(spark, d, "business").withColumn("business_id", F.trim("business_id")), "business_id", "updated_at", "categories")


def _names(split: DataFrame) -> DataFrame:
    return split.select(F.col("key").alias("business_id"), "pos", F.col("value").alias("category"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The names by the rule that every unquoted separator splits, which leaves nothing to be learned."""
    return _names(split_packed(_business(spark, d), "business_id", "categories", strict=True))


def p6_learned(spark: SparkSession, d: str) -> DataFrame:
    """The learned segmentation itself: values of up to three pieces whose separators nobody quoted stay whole where the column speaks for them."""
    return _names(split_packed(_business(spark, d), "business_id", "categories"))


_QUOTED = r'(^\s*|[,;|\t\[]\s*)"([^"]*[,;|\t][^"]*)"(?=\s*(?:[,;|\t\]]|$))'


def p6_unquoted(spark: SparkSession, d: str) -> DataFrame:
    """How well the learned segmentation restores names whose quotes are lost: the quotes around names with a separator inside are taken from
    the fields of about half of the businesses (those whose id's md5 begins below 8), and the split is compared with that of
    the fields as they are. One row: planted (names that lost their quotes), and whether 0.9 of them or more are found and
    0.9 or more of all names are right."""
    rows = _business(spark, d).where("business_id is not null")
    lost = F.md5("business_id") < "8"
    bare = F.when(lost, F.regexp_replace("categories", _QUOTED, "$1$2")).otherwise(F.col("categories"))
    want = materialize(_names(split_packed(rows, "business_id", "categories", strict=True)).withColumn("whole", lost & F.col("category").rlike(r"[,;|\t]")))
    got = _names(split_packed(rows.select("business_id", bare.alias("categories")), "business_id", "categories")).withColumn("n", F.lit(1))
    both = want.join(got, ["business_id", "pos", "category"], "full_outer")
    hurt = want.where("whole").select("business_id").distinct().join(rows.where(F.col("categories").rlike(_QUOTED)), "business_id", "left_semi").select("business_id").withColumn("hurt", F.lit(True))
    both = both.join(hurt, "business_id", "left")
    sums = both.agg(
        F.sum(F.when(F.col("whole") & F.col("hurt"), 1).otherwise(0)).alias("planted"),
        F.sum(F.when(F.col("whole") & F.col("hurt") & F.col("n").isNotNull(), 1).otherwise(0)).alias("found"),
        F.count("n").alias("given"),
        F.sum(F.when(F.col("n").isNotNull() & F.col("whole").isNotNull(), 1).otherwise(0)).alias("right"),
    )
    return sums.select("planted", (F.col("found") >= 0.9 * F.col("planted")).alias("found_most"), (F.col("right") >= 0.9 * F.col("given")).alias("mostly_right"))


QUERIES = {"p6_found": p6_found, "p6_learned": p6_learned, "p6_unquoted": p6_unquoted}

_RULES = r"""
        WITH current AS (
          SELECT business_id, regexp_replace(c, '^\[(.*)\]$', '\1') AS c FROM (
            SELECT trim(business_id, ' ') AS business_id, regexp_replace(categories, '^[ \n\r\t]+|[ \n\r\t]+$', '', 'g') AS c,
              row_number() OVER (PARTITION BY trim(business_id, ' ') ORDER BY updated_at DESC) AS k FROM business
          ) WHERE k = 1 AND c IS NOT NULL
        ),
        pieces AS (SELECT business_id, list_transform(regexp_extract_all(c, '\s*"(?:[^"]|"")*"[^,;|\t]*|(?:\\[,;|\t]|[^,;|\t])+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM current),
        names AS (
          SELECT business_id, list_filter(list_transform(l, lambda x: CASE
            WHEN regexp_full_match(x, '"(?:[^"]|"")*"') THEN trim(replace(x[2:-2], '""', '"'))
            ELSE trim(regexp_replace(x, '\\([,;|\t])', '\1', 'g')) END), lambda x: x <> '') AS l
          FROM pieces
        ),
        found AS (SELECT business_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS pos, unnest(l) AS category FROM names)"""

SQL = {
    "p6_found": _RULES + " SELECT * FROM found",
    # no name of these tables is both quoted somewhere and written bare elsewhere, so the learned split must not join anything
    "p6_learned": _RULES + " SELECT * FROM found",
    "p6_unquoted": _RULES
    + r""", hurt AS (SELECT business_id FROM (SELECT business_id, c FROM current) WHERE regexp_matches(c, '(^|[,;|\t]\s*)"[^"]*[,;|\t][^"]*"\s*([,;|\t]|$)') AND md5(business_id) < '8')
        SELECT count(*) AS planted, true AS found_most, true AS mostly_right FROM found WHERE regexp_matches(category, '[,;|\t]') AND business_id IN (SELECT business_id FROM hurt)""",
}
