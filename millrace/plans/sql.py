"""The SQL of the core's queries, for DuckDB over the same tables."""

from millrace.operators.explore import WORD_PUNCTUATION
from millrace.operators.recommend import PUNCTUATION
from millrace.operators.similarity import coefficients
from millrace.operators.sketch import bloom_multipliers, fm_coefficients

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _str(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _id(c: str) -> str:
    return f"CASE WHEN trim({c}) <> '' THEN trim({c}, ' ') END"


REVIEWS = f"""reviews AS (SELECT * EXCLUDE (k) FROM (SELECT {_id('review_id')} AS review_id, {_id('user_id')} AS user_id, {_id('business_id')} AS business_id, stars, date, text,
  row_number() OVER (PARTITION BY {_id('review_id')} ORDER BY loaded_at DESC NULLS LAST) AS k FROM review) WHERE k = 1)"""
BUSINESSES = f"""businesses AS (SELECT * EXCLUDE (k) FROM (SELECT {_id("business_id")} AS business_id, categories, state, city,
  row_number() OVER (PARTITION BY {_id("business_id")} ORDER BY updated_at DESC) AS k FROM business) WHERE k = 1)"""
STOP = "stop AS (SELECT lower(trim(word)) AS word FROM stopwords)"
WORDS = f"words AS (SELECT unnest(string_split(translate(translate(text, {_str(WORD_PUNCTUATION)}, '          '), '{UPPER}', '{LOWER}'), ' ')) AS word FROM reviews)"
CATEGORIES = f"""WITH {REVIEWS}, {BUSINESSES},
  names AS (SELECT business_id, trim(unnest(string_split(coalesce(categories, 'None'), ',')), ' ') AS category FROM businesses)
  SELECT category, round(avg(stars), 6) AS stars FROM names JOIN reviews USING (business_id) WHERE stars BETWEEN 1 AND 5 GROUP BY 1"""


def _baskets(case: int) -> str:
    a, b = ("user_id", "business_id") if case == 1 else ("business_id", "user_id")
    return f"""baskets AS (SELECT DISTINCT trim({a}, ' ') AS basket, trim({b}, ' ') AS item FROM user_business
      WHERE trim({a}) <> '' AND trim({b}) <> '' AND trim({a}) <> '{a}' AND trim({b}) <> '{b}')"""


def _itemsets(case: int, support: int, more_than: int = 0, depth: int = 6) -> str:
    parts = [
        _baskets(case),
        f"rows AS (SELECT * FROM baskets WHERE basket IN (SELECT basket FROM baskets GROUP BY 1 HAVING count(*) > {more_than}))",
        f"c1 AS (SELECT [item] AS s, count(*) AS n FROM rows GROUP BY item HAVING count(*) >= {support})",
        "o1 AS (SELECT basket, [item] AS s FROM rows WHERE [item] IN (SELECT s FROM c1))",
    ]
    for k in range(2, depth + 1):
        parts.append(f"g{k} AS (SELECT o.basket, list_concat(o.s, r.s) AS s FROM o{k - 1} o JOIN o1 r ON r.basket = o.basket AND r.s[1] > o.s[-1])")
        parts.append(f"c{k} AS (SELECT s, count(*) AS n FROM g{k} GROUP BY s HAVING count(*) >= {support})")
        parts.append(f"o{k} AS (SELECT * FROM g{k} WHERE s IN (SELECT s FROM c{k}))")
    every = " UNION ALL ".join(f"SELECT s AS itemset, CAST({k} AS INTEGER) AS size, n AS count FROM c{k}" for k in range(1, depth + 1))
    return f"WITH {', '.join(p.replace(' AS (', ' AS MATERIALIZED (', 1) for p in parts)} {every}"


SETS = f"sets AS (SELECT DISTINCT {_id('business_id')} AS id, {_id('user_id')} AS member FROM train_review WHERE {_id('business_id')} IS NOT NULL AND {_id('user_id')} IS NOT NULL)"
JACCARD = """sizes AS (SELECT id, count(*) AS n FROM sets GROUP BY id),
  common AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM sets x JOIN sets y ON x.member = y.member AND x.id < y.id GROUP BY 1, 2),
  near AS (SELECT a, b, c / (x.n + y.n - c) AS sim FROM common JOIN sizes x ON x.id = a JOIN sizes y ON y.id = common.b)"""


def _signatures(n: int, b: int, p: int, seed: int) -> str:
    mins = ", ".join(f"min((({a}::bigint * x + {b}) % {p}) % m)" for a in coefficients(n, seed))
    return f"""coded AS (SELECT member, dense_rank() OVER (ORDER BY member) - 1 AS x FROM (SELECT DISTINCT member FROM sets)),
      m AS (SELECT count(DISTINCT id) AS m FROM sets),
      signatures AS (SELECT id, [{mins}] AS signature FROM sets JOIN coded USING (member), m GROUP BY id)"""


def _met(bands: int, rows: int) -> str:
    return f"""banded AS (SELECT id, k, signature[k * {rows} + 1 : k * {rows} + {rows}] AS part FROM signatures, range({bands}) t(k)),
      met AS (SELECT DISTINCT x.id AS a, y.id AS b FROM banded x JOIN banded y ON x.k = y.k AND x.part = y.part AND x.id < y.id)"""


RATED = f"rated AS (SELECT {_id('user_id')} AS \"user\", {_id('business_id')} AS item, avg(stars) AS stars FROM train_review WHERE {_id('user_id')} IS NOT NULL AND {_id('business_id')} IS NOT NULL AND stars IS NOT NULL GROUP BY 1, 2)"
TO_RATE = f"pairs AS (SELECT DISTINCT {_id('user_id')} AS \"user\", {_id('business_id')} AS item FROM test_review WHERE {_id('user_id')} IS NOT NULL AND {_id('business_id')} IS NOT NULL)"


def _pearson(of: str, by: str, candidates: str = "") -> str:
    near = f"WHERE (x.{of}, y.{of}) IN (SELECT (a, b) FROM {candidates})" if candidates else ""
    return f"""sums AS (SELECT x.{of} AS a, y.{of} AS b, count(*) AS n, sum(x.stars) AS sx, sum(y.stars) AS sy, sum(x.stars * y.stars) AS sxy,
        sum(x.stars * x.stars) AS sxx, sum(y.stars * y.stars) AS syy
        FROM rated x JOIN rated y ON x.{by} = y.{by} AND x.{of} < y.{of} {near} GROUP BY 1, 2 HAVING count(*) >= 3),
      spread AS (SELECT *, round(sxx - sx * sx / n, 9) * round(syy - sy * sy / n, 9) AS v FROM sums),
      model AS (SELECT a, b, round((sxy - sx * sy / n) / sqrt(v), 6) AS sim FROM spread WHERE v > 0 AND round((sxy - sx * sy / n) / sqrt(v), 9) > 0)"""


NEIGHBOURS = "neighbours AS (SELECT a AS id, b AS other, sim FROM model UNION ALL SELECT b, a, sim FROM model)"
BY_ITEMS = """met AS (SELECT p."user", p.item, n.sim, r.stars FROM pairs p JOIN rated r ON r."user" = p."user" JOIN neighbours n ON n.id = p.item AND n.other = r.item
      QUALIFY row_number() OVER (PARTITION BY p."user", p.item ORDER BY n.sim DESC, n.other DESC) <= 3),
    forecast AS (SELECT "user", item, round(least(5.0::double, sum(sim * stars) / sum(abs(sim))), 6) AS stars FROM met GROUP BY 1, 2)
    SELECT * FROM forecast WHERE stars > 0"""
BY_USERS = """means AS (SELECT "user", sum(stars) AS s, count(*) AS c FROM rated GROUP BY 1),
    met AS (SELECT p."user", p.item, n.sim, r.stars, CASE WHEN m.c > 1 THEN (m.s - r.stars) / (m.c - 1) ELSE r.stars END AS rest
      FROM pairs p JOIN rated r ON r.item = p.item JOIN neighbours n ON n.id = p."user" AND n.other = r."user" JOIN means m ON m."user" = r."user"
      QUALIFY row_number() OVER (PARTITION BY p."user", p.item ORDER BY n.sim DESC, n.other DESC) <= 3),
    forecast AS (SELECT "user", item, round(least(5.0::double, any_value(s) / any_value(c) + sum(sim * (stars - rest)) / sum(abs(sim))), 6) AS stars
      FROM met JOIN means USING ("user") GROUP BY 1, 2)
    SELECT * FROM forecast WHERE stars > 0"""

CONTENT = f"""{STOP},
  uses AS (SELECT {_id("business_id")} AS item, unnest(string_split(translate(translate(text, chr(10) || {_str(PUNCTUATION)}, ''), '{UPPER}', '{LOWER}'), ' ')) AS word FROM train_review),
  words AS (SELECT * FROM uses WHERE item IS NOT NULL AND word <> '' AND NOT regexp_full_match(word, '\\p{{Nd}}+') AND word NOT IN (SELECT word FROM stop)),
  counts AS (SELECT item, word, count(*) AS c FROM words GROUP BY 1, 2),
  kept AS (SELECT word, count(*) AS df FROM counts GROUP BY 1 HAVING sum(c) >= (SELECT sum(c) FROM counts) * 1e-6::double),
  scored AS (SELECT item, word, round(c / max(c) OVER (PARTITION BY item) * log2((SELECT count(DISTINCT item) FROM counts)::double / df), 9) AS score FROM counts JOIN kept USING (word)),
  profiles AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, word DESC) <= 200)"""
USER_WORDS = 'user_words AS (SELECT DISTINCT "user", word FROM rated JOIN profiles USING (item))'


def _graph(shared: int) -> str:
    return f"""{_baskets(1)},
      edges AS (SELECT x.basket AS a, y.basket AS b, count(*) AS shared FROM baskets x JOIN baskets y ON x.item = y.item AND x.basket < y.basket GROUP BY 1, 2 HAVING count(*) >= {shared}),
      near AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges)"""


COMPONENTS = """reach(v, r) AS (SELECT DISTINCT a, a FROM near UNION SELECT reach.v, near.b FROM reach JOIN near ON near.a = reach.r),
  labels AS (SELECT v, min(r) AS component FROM reach GROUP BY v)"""


def _propagation(rounds: int) -> str:
    parts = ["l0 AS (SELECT DISTINCT a AS v, a AS label FROM near)"]
    for k in range(1, rounds + 1):
        votes = f"SELECT a AS v, label, count(*) AS c FROM near JOIN l{k - 1} ON v = b GROUP BY 1, 2"
        parts.append(f"l{k} AS MATERIALIZED (SELECT v, label FROM ({votes}) QUALIFY row_number() OVER (PARTITION BY v ORDER BY c DESC, label) = 1)")
    return ", ".join(parts)


def _bytes_mod(c: str, q: int) -> str:
    digits = f"list_transform(range(0, CAST(length(hex({c})) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex({c}), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"list_reduce(list_prepend(0::bigint, {digits}), lambda acc, d: (acc * 256 + d) % {q})"


def _zeros(groups: int, per_group: int, n: int, seed: int, x: str) -> tuple[str, str]:
    """Select list of the maxima, and the estimate over them."""
    maxima = []
    for k, (a, b) in enumerate(fm_coefficients(groups * per_group, seed)):
        y = f"(({a} * {x} + {b}) % {n})"
        maxima.append(f"max(CASE WHEN {y} = 0 THEN 8 ELSE bit_count(({y} & -{y}) - 1) END) AS z{k}")
    means = ", ".join("(" + " + ".join(f"pow(2.0::double, z{g * per_group + k})" for k in range(per_group)) + f") / {per_group}" for g in range(groups))
    return ", ".join(maxima), f"list_sort([{means}])[{groups // 2 + 1}]"


def _betweenness(levels: int) -> str:
    """Breadth-first searches from all vertices and the flow back, a common table expression a level."""
    parts = ["l0 AS MATERIALIZED (SELECT DISTINCT a AS s, a AS v, 1.0::double AS paths FROM near)"]
    for k in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT s, v FROM l{j}" for j in (k - 1, k - 2) if j >= 0)
        parts.append(f"l{k} AS MATERIALIZED (SELECT s, v, sum(paths) AS paths FROM (SELECT l.s, n.b AS v, paths FROM l{k - 1} l JOIN near n ON n.a = l.v) g ANTI JOIN ({seen}) o USING (s, v) GROUP BY 1, 2)")
    parts.append(f"c{levels + 1} AS (SELECT s, v AS p, v AS w, 0.0::double AS f FROM l0 WHERE false)")
    for k in range(levels, 0, -1):
        credit = f"SELECT l.s, l.v, any_value(l.paths) AS paths, 1 + coalesce(sum(f), 0) AS credit FROM l{k} l LEFT JOIN c{k + 1} c ON c.s = l.s AND c.p = l.v GROUP BY 1, 2"
        parts.append(f"c{k} AS MATERIALIZED (SELECT d.s, u.v AS p, d.v AS w, d.credit * u.paths / d.paths AS f FROM ({credit}) d JOIN near n ON n.b = d.v JOIN l{k - 1} u ON u.s = d.s AND u.v = n.a)")
    every = " UNION ALL ".join(f"SELECT p, w, f FROM c{k}" for k in range(1, levels + 1))
    return ", ".join(parts) + f" SELECT least(p, w) AS a, greatest(p, w) AS b, round(sum(f) / 2, 6) AS betweenness FROM ({every}) GROUP BY 1, 2"


def _kmeans(k: int, rounds: int) -> str:
    """Farthest-first seeds and Lloyd's rounds, a common table expression each; the clusters are in `clusters` (id, cluster)."""
    parts = ["m1 AS MATERIALIZED (SELECT id, f, 1e300::double AS d, f AS c FROM pts)", "c1 AS MATERIALIZED (SELECT 0 AS c, f AS m FROM pts ORDER BY id LIMIT 1)"]
    for j in range(2, k + 1):
        parts.append(f"m{j} AS MATERIALIZED (SELECT m.id, m.f, least(m.d, list_distance(m.f, c.m)) AS d FROM m{j - 1} m, c{j - 1} c)")
        parts.append(f"c{j} AS MATERIALIZED (SELECT {j - 1} AS c, f AS m FROM m{j} WHERE d > 0 ORDER BY d DESC, id LIMIT 1)")
    parts.append("r0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM c{j}" for j in range(1, k + 1)) + ")")
    near = lambda r: f"SELECT p.id, any_value(p.f) AS f, arg_min(r.c, [list_distance(p.f, r.m), r.c]) AS c FROM pts p, r{r} r GROUP BY p.id"
    for r in range(1, rounds + 1):
        mean = f"SELECT c, list(x ORDER BY i) AS m FROM (SELECT c, i, avg(x) AS x FROM (SELECT c, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM ({near(r - 1)})) GROUP BY 1, 2) GROUP BY 1"
        parts.append(f"r{r} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM r{r - 1} o LEFT JOIN ({mean}) n USING (c))")
    parts.append(f"clusters AS MATERIALIZED (SELECT id, CAST(c AS INTEGER) AS cluster FROM ({near(rounds)}))")
    return ", ".join(parts)


_MAXIMA, _ESTIMATE = _zeros(9, 5, 450, 15, "x")
CITIES = "cities AS (SELECT DISTINCT coalesce(trim(city, ' '), '') AS city, coalesce(upper(trim(state, ' ')) = 'NV', false) AS there FROM business)"
WINDOWED = f"""
  seen AS (SELECT ts, CAST(user_id AS VARCHAR) AS u, unnest([0, 1, 2]) AS k FROM events),
  placed AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - k * INTERVAL 10 MINUTE AS window_start, u, {_bytes_mod("u", 450)} AS x FROM seen WHERE u <> ''),
  sums AS (SELECT window_start, count(DISTINCT u) AS truth, {_MAXIMA} FROM placed GROUP BY 1)
  SELECT window_start, truth, round({_ESTIMATE}, 6) AS estimate FROM sums"""
_POINTS = "pts AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS f FROM embeddings WHERE embedding IS NOT NULL)"

SHARED, SUPPORT = 4, 12
SQL = {
    "distinct_reviews": f"WITH {REVIEWS} SELECT count(DISTINCT review_id) AS n FROM reviews",
    "distinct_users": f"WITH {REVIEWS} SELECT count(DISTINCT user_id) AS n FROM reviews",
    "reviews_in_year": f"WITH {REVIEWS} SELECT count(DISTINCT review_id) AS n FROM reviews WHERE split_part(date, '-', 1) = '2016'",
    "top_users": f"WITH {REVIEWS} SELECT user_id, count(*) AS count FROM reviews WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "top_words": f"WITH {REVIEWS}, {STOP}, {WORDS} SELECT word, count(*) AS count FROM words WHERE word <> '' AND word NOT IN (SELECT word FROM stop) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "review_summary": f"""WITH {REVIEWS}, {STOP}, {WORDS},
        d AS (SELECT user_id AS k, count(*) AS n FROM reviews WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20),
        e AS (SELECT word AS k, count(*) AS n FROM words WHERE word <> '' AND word NOT IN (SELECT word FROM stop) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
        SELECT (SELECT count(DISTINCT review_id) FROM reviews) AS a, (SELECT count(DISTINCT review_id) FROM reviews WHERE split_part(date, '-', 1) = '2016') AS b,
          (SELECT count(DISTINCT user_id) FROM reviews) AS c, (SELECT string_agg(k || ':' || n, ' ' ORDER BY n DESC, k) FROM d) AS d, (SELECT string_agg(k || ':' || n, ' ' ORDER BY n DESC, k) FROM e) AS e""",
    "category_avg_stars": CATEGORIES,
    "top_categories": CATEGORIES + " ORDER BY 2 DESC, 1 LIMIT 20",
    "popular_businesses": f"WITH {REVIEWS} SELECT business_id, count(*) AS count FROM reviews WHERE business_id IS NOT NULL GROUP BY 1 HAVING count(*) > 25",
    "partition_profile": f"""WITH {REVIEWS}, placed AS (SELECT ascii(business_id) % 16 AS p, count(*) AS n FROM reviews WHERE business_id IS NOT NULL GROUP BY 1)
        SELECT CAST(k AS INTEGER) AS partition, coalesce(n, 0) AS rows FROM range(16) t(k) LEFT JOIN placed ON p = k""",
    "partition_profile_hash": f"WITH {REVIEWS} SELECT CAST(count(*) AS BIGINT) AS rows, CAST(16 AS BIGINT) AS partitions, CAST(0 AS BIGINT) AS split_keys FROM reviews",
    "state_baskets": f"WITH {REVIEWS}, {BUSINESSES} SELECT DISTINCT r.user_id, r.business_id FROM reviews r WHERE user_id IS NOT NULL AND business_id IN (SELECT business_id FROM businesses WHERE state = 'NV')",
    "frequent_itemsets_users": _itemsets(1, SUPPORT),
    "frequent_itemsets_businesses": _itemsets(2, SUPPORT),
    "frequent_itemsets_large": _itemsets(1, SUPPORT, 10),
    "fp_growth": _itemsets(1, SUPPORT),
    "candidate_itemsets": f"""WITH f AS MATERIALIZED ({_itemsets(1, SUPPORT)}),
        joined AS (SELECT list_concat(x.itemset, [y.itemset[-1]]) AS itemset, x.size + 1 AS size FROM f x JOIN f y ON x.size = y.size AND x.itemset[1:-2] = y.itemset[1:-2] AND x.itemset[-1] < y.itemset[-1]),
        subs AS (SELECT itemset, list_concat(itemset[1 : k], itemset[k + 2 :]) AS sub FROM joined, range(8) t(k) WHERE k < size)
        SELECT itemset, size FROM joined WHERE itemset NOT IN (SELECT itemset FROM subs WHERE sub NOT IN (SELECT itemset FROM f))""",
    "jaccard_pairs": f"WITH {SETS}, {JACCARD} SELECT a, b, round(sim, 6) AS sim FROM near WHERE sim >= 0.05::double",
    "minhash_signatures": f"WITH {SETS}, {_signatures(1000, 1301, 24593, 1301)} SELECT id, array_to_string(signature, ' ') AS signature FROM signatures",
    "lsh_pairs": f"WITH {SETS}, {_signatures(1000, 1301, 24593, 1301)}, {_met(500, 2)}, {JACCARD} SELECT a, b, round(sim, 6) AS sim FROM near JOIN met USING (a, b) WHERE sim >= 0.05::double",
    "lsh_recall": f"WITH {SETS}, {JACCARD} SELECT at_least::double AS at_least, count(*) AS pairs, true AS found_most FROM near, (VALUES (0.1), (0.2)) t(at_least) WHERE sim >= 0.1::double AND round(sim, 6) >= at_least::double GROUP BY 1",
    "item_model": f"WITH {RATED}, {_pearson('item', '\"user\"')} SELECT * FROM model",
    "user_model": f"WITH {RATED}, {_pearson('\"user\"', 'item')} SELECT * FROM model",
    "user_model_lsh": f"""WITH {RATED}, sets AS (SELECT "user" AS id, item AS member FROM rated), {_signatures(20, 15, 29, 15)}, {_met(5, 4)}, {JACCARD},
        kept AS (SELECT a, b FROM near JOIN met USING (a, b) WHERE sim >= 0.01::double), {_pearson('"user"', "item", "kept")} SELECT * FROM model""",
    "item_predict": f"WITH {RATED}, {TO_RATE}, {_pearson('item', '\"user\"')}, {NEIGHBOURS}, {BY_ITEMS}",
    "user_predict": f"WITH {RATED}, {TO_RATE}, {_pearson('\"user\"', 'item')}, {NEIGHBOURS}, {BY_USERS}",
    "stored_model_predict": f"""WITH {RATED}, {TO_RATE},
        model AS (SELECT least(x, y) AS a, greatest(x, y) AS b, max(sim) AS sim FROM (SELECT {_id("b1")} AS x, {_id("b2")} AS y, sim FROM task3item_model) WHERE x <> y AND sim > 0 AND NOT isnan(sim) GROUP BY 1, 2),
        {NEIGHBOURS}, {BY_ITEMS}""",
    "tfidf_profile": f"WITH {CONTENT} SELECT item, word, score FROM profiles",
    "tfidf_indexed": f"""WITH {CONTENT}, coded AS (SELECT word, dense_rank() OVER (ORDER BY word) - 1 AS i FROM (SELECT DISTINCT word FROM profiles))
        SELECT item, array_to_string(list(i ORDER BY i), ' ') AS words FROM profiles JOIN coded USING (word) GROUP BY 1""",
    "user_profile": f'WITH {RATED}, {CONTENT}, {USER_WORDS} SELECT "user", count(*) AS words, min(word) AS first, max(word) AS last, CAST(sum(length(word)) AS BIGINT) AS letters FROM user_words GROUP BY 1',
    "content_predict": f"""WITH {RATED}, {TO_RATE}, {CONTENT}, {USER_WORDS},
        nu AS (SELECT "user", count(*) AS nu FROM user_words GROUP BY 1), ni AS (SELECT item, count(*) AS ni FROM profiles GROUP BY 1),
        common AS (SELECT p."user", p.item, count(*) AS c FROM pairs p JOIN profiles f ON f.item = p.item JOIN user_words u ON u."user" = p."user" AND u.word = f.word GROUP BY 1, 2)
        SELECT "user", item, round(c / sqrt(nu * ni), 6) AS sim FROM common JOIN nu USING ("user") JOIN ni USING (item) WHERE round(c / sqrt(nu * ni), 6) >= 0.01::double""",
    "cooccur_graph": f"WITH {_graph(SHARED)} SELECT a, b, shared FROM edges",
    "graph_components": f"WITH RECURSIVE {_graph(SHARED)}, {COMPONENTS} SELECT v, component FROM labels",
    "label_propagation": f"WITH {_graph(SHARED)}, {_propagation(5)} SELECT v, label FROM l5",
    "graph_communities": f"WITH {_graph(SHARED)}, {_propagation(5)} SELECT CAST(count(*) AS INTEGER) AS size, array_to_string(list(v ORDER BY v), ' ') AS members FROM l5 GROUP BY label",
    "graph_modularity": f"""WITH RECURSIVE {_graph(SHARED)}, {COMPONENTS},
        d AS (SELECT component, count(*) AS d FROM near JOIN labels ON v = a GROUP BY 1), m AS (SELECT count(*) AS m FROM edges)
        SELECT round(coalesce(sum(d / 2.0::double / m - (d / (2.0::double * m)) ** 2), 0), 9) AS q FROM d, m""",
    "mahalanobis": f"""WITH {_POINTS},
        long AS (SELECT id, label, unnest(f) AS x, generate_subscripts(f, 1) AS k FROM pts),
        stats AS (SELECT label, k, avg(x) AS m, greatest(sum(x * x) / count(*) - avg(x) * avg(x), 0) AS v FROM long GROUP BY 1, 2)
        SELECT id, label, round(sqrt(sum((x - m) * (x - m) / CASE WHEN v > 0 THEN v ELSE 1 END)), 6) AS distance FROM long JOIN stats USING (label, k) GROUP BY 1, 2""",
    "squared_distances": f"WITH {_POINTS} SELECT p.id, round(list_sum(list_transform(list_zip(p.f, q.f), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS distance FROM pts p JOIN pts q ON q.id = p.id + 1",
    "points_round_trip": f"WITH {_POINTS} SELECT id, CAST(len(f) AS INTEGER) AS dimensions, round(list_sum(f), 6) AS total FROM pts",
    "source_round_trip": f"""WITH {_baskets(1)} SELECT 'json' AS source, count(*) AS rows, count(DISTINCT {_id("review_id")}) AS keys FROM review
        UNION ALL SELECT 'csv', count(*), count(DISTINCT item) FROM baskets UNION ALL SELECT 'text', count(*), count(DISTINCT lower(trim(coalesce(word, ''), ' '))) FROM stopwords""",
    "edge_betweenness": f"WITH {_graph(SHARED)}, {_betweenness(14)}",
    "girvan_newman_score": f"WITH {_graph(7)} SELECT count(DISTINCT a) AS vertices, true AS same, true AS gain FROM near",
    "kmeans_assign": f"WITH {_POINTS}, {_kmeans(10, 40)} SELECT id, cluster FROM clusters",
    "chunked_labels": f"WITH {_POINTS} SELECT id, true AS labelled FROM pts",
    "chunked_rounds": f"""WITH {_POINTS}, chunks AS (SELECT k, (SELECT count(*) FROM pts WHERE ((id % 5) + 5) % 5 <= k) AS n FROM range(5) t(k)) SELECT CAST(k + 1 AS INTEGER) AS round_id, n AS points, true AS fits FROM chunks""",
    "nmi": f"""WITH {_POINTS}, {_kmeans(10, 40)}, rows AS (SELECT label AS b, cluster AS a FROM clusters JOIN pts USING (id)), n AS (SELECT count(*)::double AS n FROM rows),
        c AS (SELECT a, b, count(*) AS c FROM rows GROUP BY 1, 2), ca AS (SELECT a, count(*) AS ca FROM rows GROUP BY 1), cb AS (SELECT b, count(*) AS cb FROM rows GROUP BY 1),
        i AS (SELECT sum(c / n * ln(c * n / (ca * cb))) AS i FROM c JOIN ca USING (a) JOIN cb USING (b), n),
        ha AS (SELECT -sum(ca / n * ln(ca / n)) AS h FROM ca, n), hb AS (SELECT -sum(cb / n * ln(cb / n)) AS h FROM cb, n)
        SELECT round(i / ((ha.h + hb.h) / 2), 6) AS nmi FROM i, ha, hb""",
    "bloom_probe": f"""WITH {CITIES},
        hashed AS (SELECT city, there, [{", ".join(f"((({a}::bigint * x + 1301) % 24593) % 10000)" for a in bloom_multipliers())}] AS h FROM (SELECT city, there, {_bytes_mod("city", 24593)} AS x FROM cities)),
        bits AS (SELECT list_distinct(flatten(list(h))) AS b FROM hashed WHERE there AND city <> '')
        SELECT city, CAST(city <> '' AND list_has_all(b, h) AS INTEGER) AS seen FROM hashed, bits WHERE NOT there""",
    "fm_estimate": f"""WITH places AS (SELECT upper(trim(state, ' ')) AS state, trim(city, ' ') AS city, {_bytes_mod("trim(city, ' ')", 450)} AS x FROM business WHERE trim(city, ' ') <> ''),
        sums AS (SELECT state, count(DISTINCT city) AS truth, {_MAXIMA} FROM places GROUP BY 1)
        SELECT state, truth, round({_ESTIMATE}, 6) AS estimate FROM sums""",
    "top_tags": """WITH c AS (SELECT event_type AS tag, count(*) AS count FROM events WHERE regexp_full_match(event_type, '[A-Za-z]+') GROUP BY 1)
        SELECT tag, count FROM c QUALIFY dense_rank() OVER (ORDER BY count DESC) <= 3""",
    "hll_estimate": "SELECT upper(trim(state, ' ')) AS state, count(DISTINCT trim(city, ' ')) AS truth, true AS close FROM business WHERE trim(city, ' ') <> '' GROUP BY 1",
    "tag_changes": "SELECT event_type AS tag, CAST(sum(CASE WHEN value < 0.3 THEN -1 ELSE 1 END) AS BIGINT) AS count FROM events GROUP BY 1 HAVING sum(CASE WHEN value < 0.3 THEN -1 ELSE 1 END) > 0",
    "busiest_minutes": """WITH c AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1),
        w AS (SELECT *, lag(n, 1, 0) OVER o AS b, lead(n, 1, 0) OVER o AS f, max(n) OVER () AS m FROM c WINDOW o AS (ORDER BY minute)) SELECT minute, n FROM w WHERE n = m AND n >= b AND n > f""",
    "reservoir_sample": "SELECT event_id, md5(event_id || ':0') AS priority FROM events ORDER BY 2, 1 LIMIT 100",
    "stream_reservoir": "SELECT event_id FROM events ORDER BY md5(event_id || ':0'), 1 LIMIT 100",
    "windowed_distinct": f"WITH {WINDOWED}",
    "stream_windowed_distinct": f"WITH {WINDOWED}",
    "stream_bloom_probe": f"""WITH {CITIES},
        hashed AS (SELECT city, there, [{", ".join(f"((({a}::bigint * x + 1301) % 24593) % 10000)" for a in bloom_multipliers())}] AS h FROM (SELECT city, there, {_bytes_mod("city", 24593)} AS x FROM cities)),
        bits AS (SELECT list_distinct(flatten(list(h))) AS b FROM hashed WHERE there AND city <> ''),
        probed AS (SELECT DISTINCT city, CAST(city <> '' AND list_has_all(b, h) AS INTEGER) AS seen FROM hashed, bits)
        SELECT trim(business.city, ' ') AS city, seen, count(*) AS n FROM business JOIN probed ON probed.city = coalesce(trim(business.city, ' '), '') GROUP BY 1, 2""",
}
