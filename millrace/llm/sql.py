"""The SQL of the queries, for DuckDB over the same tables."""

_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')"
_BASKET = """
baskets AS (
  SELECT DISTINCT trim(user_id, ' ') AS u, trim(business_id, ' ') AS b FROM user_business
  WHERE trim(user_id) <> '' AND trim(business_id) <> '' AND trim(user_id) <> 'user_id' AND trim(business_id) <> 'business_id'
),
total AS (SELECT count(DISTINCT u) AS n FROM baskets),
items AS (SELECT b, count(*) AS n FROM baskets GROUP BY b),
pairs AS (
  SELECT x.b AS a, y.b AS b, count(*) AS n_ab FROM baskets x JOIN baskets y ON x.u = y.u AND x.b < y.b
  GROUP BY 1, 2 HAVING count(*) >= 6
)"""
_ODDS = "((n_ab + 0.5::double) / (p.n - n_ab + 0.5::double)) * ((t.n - p.n - q.n + n_ab + 0.5::double) / (q.n - n_ab + 0.5::double))"
_CURRENT = "current AS (SELECT trim(review_id, ' ') AS review_id, arg_max({0}, loaded_at) AS {0} FROM review GROUP BY 1)"
_CURRENT_NULLS = """current AS (
  SELECT {0} FROM (SELECT {0}, row_number() OVER (PARTITION BY trim(review_id, ' ') ORDER BY loaded_at DESC) AS k FROM review) WHERE k = 1
)"""
_TERM_COUNTS = rf"""
{_CURRENT_NULLS.format("text")},
texts AS (SELECT {_TERMS} AS w FROM current WHERE regexp_matches(text, '[^\s]')),
total AS (SELECT count(*) AS n FROM texts),
used AS (SELECT term, count(*) AS uses FROM (SELECT unnest(w) AS term FROM texts) GROUP BY 1),
held AS (SELECT term, count(*) AS records FROM (SELECT unnest(list_distinct(w)) AS term FROM texts) GROUP BY 1),
terms AS (
  SELECT term, uses, records, n, CASE WHEN records <= 2 THEN 'rare' WHEN records * 100 > 32 * n THEN 'common' END AS mark
  FROM used JOIN held USING (term), total
)"""
_SETS = """
rows AS (
  SELECT DISTINCT trim(business_id, ' ') AS b, trim(user_id, ' ') AS u FROM train_review
  WHERE trim(business_id) <> '' AND trim(user_id) <> ''
),
sizes AS (SELECT b, count(*) AS n, list(u ORDER BY u) AS us FROM rows GROUP BY b HAVING count(*) >= 3),
pairs AS (
  SELECT p.a, p.b FROM (SELECT x.b AS a, y.b AS b, count(*) AS c FROM rows x JOIN rows y ON x.u = y.u AND x.b < y.b GROUP BY 1, 2) p
  JOIN sizes s ON s.b = p.a JOIN sizes t ON t.b = p.b WHERE 2 * c >= s.n + t.n - c
)"""

_TF = rf"""
rows AS (SELECT DISTINCT trim(user_id, ' ') AS u, trim(business_id, ' ') AS b, stars, text FROM train_review),
stop AS (SELECT lower(trim(word)) AS w FROM stopwords),
words AS (SELECT b, unnest({_TERMS}) AS term FROM rows WHERE trim(b) <> ''),
tf AS (
  SELECT b, term, count(*) AS tf FROM words
  WHERE NOT regexp_full_match(term, '\p{{Nd}}+') AND term NOT IN (SELECT w FROM stop) GROUP BY 1, 2
),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT count(DISTINCT b) AS n FROM tf)"""


def _two_poisson(rounds: int) -> str:
    """Expectation-maximisation, a common table expression a round: term, df, total, n, low, high, share."""
    clip = lambda x: f"least(greatest({x}, 1e-12), 1 - 1e-9)"
    chance = lambda x: f"1 / (1 + exp(-least(700, greatest(-700, {x}))))"
    parts = [
        "cells AS MATERIALIZED (SELECT term, tf, count(*)::double AS c FROM tf GROUP BY 1, 2)",
        f"""fit0 AS MATERIALIZED (SELECT term, sum(c) AS df, sum(tf * c) AS total, any_value(n)::double AS n, greatest(0.1::double * sum(tf * c) / any_value(n), 1e-12) AS low,
          sum(tf * c) / sum(c) AS high, {clip("sum(c) / any_value(n)")} AS share FROM cells, n GROUP BY 1)""",
    ]
    for k in range(rounds):
        base = "ln(share) - ln(1 - share) - (high - low)"
        parts.append(f"""step{k} AS MATERIALIZED (SELECT term, f.df, f.total, f.n, sum(p * c) + any_value({chance(base)} * greatest(f.n - f.df, 0)) AS elite, sum(p * tf * c) AS uses
          FROM (SELECT f.*, tf, c, {chance(base + " + tf * (ln(high) - ln(low))")} AS p FROM fit{k} f JOIN cells USING (term)) f GROUP BY 1, 2, 3, 4)""")
        parts.append(f"""fit{k + 1} AS MATERIALIZED (SELECT term, df, total, n, greatest((total - uses) / greatest(n - elite, 1e-12), 1e-12) AS low,
          greatest(uses / greatest(elite, 1e-12), 1e-12) AS high, {clip("elite / n")} AS share FROM step{k})""")
    parts.append(f"""scored AS (SELECT b, term, tf, CAST(f.df AS BIGINT) AS df, {chance("ln(share) - ln(1 - share) - (high - low) + tf * (ln(high) - ln(low))")} AS elite FROM tf JOIN fit{rounds} f USING (term))""")
    return ", ".join(parts)


_MIX = rf"""
sized AS (SELECT doc_id, lower(trim(source, ' ')) AS source, len({_TERMS}) AS n FROM documents WHERE text IS NOT NULL AND trim(source) <> ''),
every AS (SELECT sum(n) AS t FROM sized),
have AS (SELECT source, sum(n) AS have FROM sized GROUP BY 1),
goals AS (
  SELECT lower(trim(m.source, ' ')) AS source, max_repeats AS r, coalesce(have, 0) AS have, CAST(ceil(CAST(weight AS DECIMAL(18, 6)) * CAST(t AS DECIMAL(18, 0))) AS BIGINT) AS goal
  FROM mix_targets m LEFT JOIN have h ON h.source = lower(trim(m.source, ' ')), every
),
placed AS (
  SELECT s.*, g.r, g.have, least(goal, have * r) AS take,
    coalesce(sum(n) OVER (PARTITION BY s.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN goals g USING (source)
),
used AS (SELECT *, CAST(least(r, (take - start - 1) // greatest(have, 1) + 1) AS BIGINT) AS uses FROM placed WHERE start < take)"""

_READING = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(lower(text), '\p{{L}}+') AS w,
    len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?]+)(\s|$)', chr(10), 'g'), '[\n\r]+'), lambda p: regexp_matches(p, '\p{{L}}'))) AS s
  FROM documents WHERE {0}
),
sized AS (
  SELECT doc_id, len(w) AS n, CASE WHEN len(w) > 0 THEN s ELSE 0 END AS s, list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+'))))) AS y FROM docs
)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_BASKET} SELECT a AS business_a, p.b AS business_b FROM pairs p JOIN items i ON i.b = a JOIN items j ON j.b = p.b, total t WHERE n_ab * t.n >= 4 * i.n * j.n",
        "p1_odds": f"""WITH {_BASKET}
            SELECT a AS item_a, pairs.b AS item_b, p.n AS n_a, q.n AS n_b, n_ab, t.n AS n, round({_ODDS}, 4) AS odds_ratio, round(ln({_ODDS}), 6) AS log_odds
            FROM pairs JOIN items p ON p.b = a JOIN items q ON q.b = pairs.b, total t""",
        "p1_pairs": f"""WITH {_BASKET.replace(" HAVING count(*) >= 6", "")}
            SELECT a AS item_a, pairs.b AS item_b, p.n AS n_a, q.n AS n_b, n_ab, t.n AS n, round({_ODDS}, 4) AS odds_ratio, round(ln({_ODDS}), 6) AS log_odds
            FROM pairs JOIN items p ON p.b = a JOIN items q ON q.b = pairs.b, total t""",
        "p2_found": f"WITH {_TERM_COUNTS} SELECT term, mark FROM terms WHERE mark IS NOT NULL",
        "p2_terms": f"WITH {_TERM_COUNTS} SELECT term, uses, records, n, mark FROM terms",
        "p3_found": f"""
            WITH {_TF},
            ranked AS (
              SELECT b, term, tf, df, row_number() OVER (PARTITION BY b ORDER BY round(tf * log2(n::double / df), 9) DESC, term) AS k
              FROM tf JOIN df USING (term), n
            )
            SELECT b AS business_id, term FROM ranked WHERE k = 1 AND tf >= 4 AND df <= 5""",
        "p3_elite": f"WITH {_TF}, {_two_poisson(40)} SELECT b AS business_id, term, tf, df, round(elite, 6) AS elite FROM scored WHERE elite >= 0.99",
        "p4_found": f"WITH {_SETS} SELECT a AS business_a, b AS business_b FROM pairs",
        "p4_links": f"""WITH {_SETS},
            classes AS (SELECT us, min(b) AS class, count(*) AS c FROM sizes GROUP BY us),
            linked AS (SELECT b, count(*) AS links FROM (SELECT a AS b FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY b)
            SELECT s.b AS business_id, class, n AS size, c - 1 AS copies, coalesce(links, 0) AS links
            FROM sizes s JOIN classes USING (us) LEFT JOIN linked l ON l.b = s.b""",
        "p5_found": f"""WITH {_CURRENT_NULLS.format("user_id")}
            SELECT trim(user_id, ' ') AS user_id FROM current WHERE trim(user_id) <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 25""",
        "p7_found": """
            WITH best AS (
              SELECT trim(b1, ' ') AS b1, trim(b2, ' ') AS b2, max(sim) AS sim FROM task3item_model
              WHERE sim IS NOT NULL AND NOT isnan(sim) AND trim(b1, ' ') <> trim(b2, ' ') AND trim(b1) <> '' AND trim(b2) <> '' GROUP BY 1, 2
            )
            SELECT b1, CAST(row_number() OVER (PARTITION BY b1 ORDER BY sim DESC, b2) AS INTEGER) AS pos, b2 FROM best
            QUALIFY pos <= 5""",
        "p8_found": rf"""
            WITH items AS (SELECT item_id, {_TERMS} AS w FROM eval_items WHERE text IS NOT NULL),
            docs AS (SELECT doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
            sizes AS (SELECT DISTINCT least(13, len(w)) AS m FROM items WHERE len(w) > 0),
            pieces AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS p FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
            windows AS (SELECT doc_id, m, array_to_string(w[i : i + m - 1], ' ') AS p FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, sizes WHERE len(w) >= m))
            SELECT DISTINCT doc_id, CAST(item_id AS INTEGER) AS item_id FROM windows JOIN pieces USING (m, p)""",
        "p8_recall": "SELECT count(*) AS planted, true AS found_most FROM documents WHERE text IS NOT NULL",
        "p9_found": rf"""
            WITH sized AS (SELECT lower(trim(source)) AS s, len({_TERMS}) AS n FROM documents WHERE text IS NOT NULL AND trim(source) <> ''),
            have AS (SELECT s, sum(n) AS n FROM sized GROUP BY s)
            SELECT t.source FROM mix_targets t LEFT JOIN have h ON h.s = lower(trim(t.source))
            WHERE t.weight * (SELECT sum(n) FROM sized) > t.max_repeats * coalesce(h.n, 0)""",
        "p9_uses": f"""WITH {_MIX}
            SELECT doc_id, source, n AS tokens, uses, array_to_string(list_transform(range(0, uses), lambda i: CAST(start + i * have AS BIGINT)), ' ') AS starts FROM used""",
        "p9_shares": f"""WITH {_MIX},
            reached AS (SELECT source, CAST(sum(n * uses) AS BIGINT) AS used FROM used GROUP BY 1),
            blocks AS (SELECT CAST(greatest(1, least(65536, t // 10000)) AS BIGINT) AS b FROM every),
            sums AS (
              SELECT g.source, r AS max_repeats, CAST(have AS BIGINT) AS available, coalesce(used, 0) AS used, CAST(ceil(goal / b) AS BIGINT) AS blocks,
                CAST(CASE WHEN coalesce(used, 0) >= goal THEN ceil(goal / b) ELSE coalesce(used, 0) // b END AS BIGINT) AS filled
              FROM goals g LEFT JOIN reached USING (source), blocks
            )
            SELECT source, max_repeats, available, used, round(used / sum(used) OVER (), 6) AS share, blocks, filled, blocks - filled AS missed, filled < blocks AS short FROM sums""",
        "p9_deviation": f"WITH {_MIX} SELECT source, CAST(sum(uses) AS BIGINT) AS uses, true AS fair FROM used GROUP BY 1",
        "p10_found": _READING.format("lower(lang) = 'en' AND text IS NOT NULL")
        + " SELECT doc_id FROM sized WHERE n >= 30 AND 0.39::double * n / s + 11.8::double * y / n - 15.59::double >= 12",
        "p10_features": _READING.format("text IS NOT NULL") + " SELECT doc_id, n AS words, s AS sentences, coalesce(y, 0)::BIGINT AS syllables FROM sized",
        "p10_skill": """
            SELECT count(*) AS labelled, true AS better FROM (SELECT DISTINCT doc_id FROM reading_labels WHERE school_year IS NOT NULL)
            JOIN (SELECT doc_id FROM documents WHERE text IS NOT NULL) USING (doc_id)""",
    }
