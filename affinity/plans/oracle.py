"""For each query its equivalent in ANSI SQL over the given tables."""

_BASE = """
ev AS (SELECT 's1' AS site, CAST(user_id AS VARCHAR) AS "user",
         CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS item,
         event_type AS event, ts, event_id FROM events),
wt AS (SELECT * FROM (VALUES ('view', 1), ('click', 2), ('signup', 3), ('purchase', 5)) t(event, weight)),
raw AS (SELECT site, "user", item, sum(weight) AS raw FROM ev JOIN wt USING (event) GROUP BY ALL),
npref AS (SELECT site, "user", item,
         5.0::DOUBLE * raw / max(raw) OVER (PARTITION BY site, "user") AS score FROM raw),
epref AS (SELECT event_id, site, "user", CAST(item AS VARCHAR) AS item, event,
         CAST(isodow(ts) - 1 AS INTEGER) AS "dayOfweek", CAST(hour(ts) AS INTEGER) AS "hourOfday",
         lag(CAST(item AS VARCHAR)) OVER (PARTITION BY site, "user" ORDER BY ts, event_id) AS related,
         CAST(weight AS DOUBLE) AS score FROM ev JOIN wt USING (event)),
rated AS (SELECT site, "user", item,
         1.0::DOUBLE / count(*) OVER (PARTITION BY site, "user") AS value
         FROM (SELECT DISTINCT site, "user", item FROM epref))
"""


def _dictionary(source: str, col: str) -> str:
    return (f'(SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx '
            f'FROM (SELECT DISTINCT CAST({col} AS VARCHAR) AS term FROM {source}))')


def _layout(source: str) -> str:
    """CTEs ud, idt, ed and lay for the events of ``source``."""
    return f"""
ud AS {_dictionary(source, '"user"')},
idt AS {_dictionary(source, 'item')},
ed AS {_dictionary(source, 'event')},
n AS (SELECT (SELECT count(*) FROM ud) AS u, (SELECT count(*) FROM idt) AS i, (SELECT count(*) FROM ed) AS e),
lay AS (
  SELECT CAST(idx AS INTEGER) AS col, 'user' AS block, term FROM ud
  UNION ALL SELECT CAST(idx + u AS INTEGER), 'item', term FROM idt, n
  UNION ALL SELECT CAST(idx + u + i AS INTEGER), 'rated', term FROM idt, n
  UNION ALL SELECT CAST(d + u + 2 * i AS INTEGER), 'day', CAST(d AS VARCHAR) FROM range(7) t(d), n
  UNION ALL SELECT CAST(h + u + 2 * i + 7 AS INTEGER), 'hour', CAST(h AS VARCHAR) FROM range(24) t(h), n
  UNION ALL SELECT CAST(idx + u + 2 * i + 31 AS INTEGER), 'event', term FROM ed, n
  UNION ALL SELECT CAST(idx + u + 2 * i + 31 + e AS INTEGER), 'related', term FROM idt, n)
"""


_CELLS = """
cells AS (
  SELECT event_id AS row_id, col, 1.0::DOUBLE AS val FROM epref JOIN lay ON
    (block = 'user' AND term = "user") OR (block = 'item' AND term = item)
    OR (block = 'day' AND term = CAST("dayOfweek" AS VARCHAR))
    OR (block = 'hour' AND term = CAST("hourOfday" AS VARCHAR))
    OR (block = 'event' AND term = event) OR (block = 'related' AND term = related)
  UNION ALL
  SELECT event_id, col, value FROM epref p JOIN rated r ON p.site = r.site AND p."user" = r."user"
    JOIN lay ON block = 'rated' AND term = r.item)
"""

_POSITIONS = """
pos AS (
  SELECT event_id, p.score AS target, CAST(u + 3 * i + 31 + e AS INTEGER) AS width,
    CAST(ud.idx AS INTEGER) AS user_col, CAST(it.idx + u AS INTEGER) AS item_col,
    CAST("dayOfweek" + u + 2 * i AS INTEGER) AS day_col,
    CAST("hourOfday" + u + 2 * i + 7 AS INTEGER) AS hour_col,
    CAST(ed.idx + u + 2 * i + 31 AS INTEGER) AS event_col,
    CAST(rt.idx + u + 2 * i + 31 + e AS INTEGER) AS related_col,
    CAST(r.n_rated AS INTEGER) AS n_rated
  FROM epref p CROSS JOIN n JOIN ud ON ud.term = p."user" JOIN idt it ON it.term = p.item
    JOIN ed ON ed.term = p.event LEFT JOIN idt rt ON rt.term = p.related
    JOIN (SELECT site, "user", count(*) AS n_rated FROM rated GROUP BY ALL) r
      ON r.site = p.site AND r."user" = p."user")
"""

_EPREF_LAYOUT = f"WITH {_BASE}, {_layout('epref')}"
_POINTS = f"{_EPREF_LAYOUT}, {_POSITIONS}"
_POINT_COLUMNS = ("target, width, user_col, item_col, day_col, hour_col, event_col, related_col, n_rated")


def _asked(given: str) -> str:
    return f"""
asked AS (
  SELECT {given} || ':' || c AS request_id, site, {given}, event, d, h
  FROM (SELECT DISTINCT site, {given} FROM who),
    (VALUES ('a', 'view', NULL::INT, NULL::INT), ('b', NULL, 2, 10), ('c', NULL, NULL, NULL)) t(c, event, d, h))
"""


def _active(given: str, found: str, who: str) -> str:
    return f"""
who AS (SELECT site, CAST({given} AS VARCHAR) AS {given} FROM {who}),
{_asked(given)},
active AS (
  SELECT DISTINCT request_id, q.site, p.{found} AS {found} FROM epref p JOIN asked q
    ON p.site = q.site AND p.{given} = q.{given}
  WHERE (q.event IS NOT NULL OR q.d IS NOT NULL OR q.h IS NOT NULL)
    AND (q.event IS NULL OR q.event = p.event) AND (q.d IS NULL OR q.d = p."dayOfweek")
    AND (q.h IS NULL OR q.h = p."hourOfday"))
"""


_VEC = "vec AS (SELECT CAST(vec_id AS INTEGER) AS id, embedding::DOUBLE[] AS x FROM embeddings)"
_DOT = "list_inner_product(a.x, b.x)"
_PAIRS = f"""WITH {_BASE}, {_VEC}
SELECT p.site, p."user", p.item, round({_DOT}, 6) AS score{{extra}}
FROM (SELECT DISTINCT site, "user", item FROM ev) p
JOIN vec a ON CAST(a.id AS VARCHAR) = p."user" JOIN vec b ON b.id = p.item"""

_FACTORS = 64
_PARAMS = f"""
params AS (SELECT col, block, term, label / 10.0::DOUBLE AS w,
  list_slice(embedding, 1, {_FACTORS})::DOUBLE[] AS v FROM lay JOIN embeddings ON vec_id = col)
"""
_SCORES = f"""
sums AS (SELECT row_id, sum(w * val) AS linear FROM cells JOIN params USING (col) GROUP BY row_id),
parts AS (
  SELECT row_id, f, sum(v[f] * val) AS s, sum(v[f] * v[f] * val * val) AS q
  FROM cells JOIN params USING (col), range(1, {_FACTORS + 1}) t(f) GROUP BY row_id, f),
scores AS (
  SELECT row_id, round(0.5 + any_value(linear) + sum(s * s - q) / 2, 6) AS prediction
  FROM sums JOIN parts USING (row_id) GROUP BY row_id)
"""


def _matrix(source: str, top_n: int, where: str = "TRUE") -> str:
    """CTE matrix(col, sim_col, score) of cosines within (col, x) of ``source``."""
    return f"""
matrix AS (
  SELECT col, sim_col, score FROM (
    SELECT a.col, b.col AS sim_col,
      list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) AS score
    FROM {source} a JOIN {source} b ON a.col <> b.col WHERE {where})
  QUALIFY row_number() OVER (PARTITION BY col ORDER BY score DESC, sim_col) <= {top_n})
"""


def _car(topic: str, given: str) -> str:
    return f"""{_EPREF_LAYOUT}, {_PARAMS},
blk AS (SELECT col, v AS x FROM params WHERE block = '{topic}'), {_matrix('blk', 5)},
{_active(given, topic, 'epref')},
best AS (
  SELECT request_id, site, sim_col, score
  FROM active JOIN lay ON lay.block = '{topic}' AND lay.term = active.{topic} JOIN matrix USING (col)
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, sim_col) <= 10)
SELECT request_id, site, term AS {topic}, round(score, 6) AS score
FROM best JOIN lay ON lay.col = best.sim_col"""


def _similar(topic: str) -> str:
    return f"""{_EPREF_LAYOUT}, {_PARAMS},
blk AS (SELECT term AS col, v AS x FROM params WHERE block = '{topic}'), {_matrix('blk', 5)}
SELECT col AS name, CAST(row_number() OVER (PARTITION BY col ORDER BY score DESC, sim_col) - 1 AS INTEGER) AS place,
  sim_col AS other, round(score, 6) AS score FROM matrix"""


_RULES = """RECURSIVE
bi AS (SELECT DISTINCT 's' || CAST(o_custkey % 3 + 1 AS VARCHAR) AS site, l_orderkey AS g,
         CAST(CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) * 100 + s_nationkey AS INTEGER) AS i
       FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
         JOIN orders ON o_orderkey = l_orderkey),
sub AS (SELECT site, g, [i] AS s FROM bi
        UNION ALL SELECT sub.site, sub.g, list_append(s, bi.i) FROM sub JOIN bi ON bi.g = sub.g AND bi.i > s[-1]),
freq AS (SELECT site, s, count(*) AS c FROM sub GROUP BY ALL),
parts AS (SELECT site, s, c, list_filter(s, lambda x: x <> y) AS p FROM (SELECT *, unnest(s) AS y FROM freq WHERE len(s) > 1)),
equal AS (SELECT p.site, p.s, p.p FROM parts p JOIN freq f ON f.site = p.site AND f.s = p.p AND f.c = p.c),
closed AS (SELECT site, s, c FROM freq WHERE len(s) > 1 AND (site, s) NOT IN (SELECT site, p FROM equal)),
gens AS (SELECT site, s, c FROM freq WHERE (site, s) NOT IN (SELECT site, s FROM equal)),
split AS (SELECT site, s, c, unnest(range(1, CAST(pow(2, len(s)) AS BIGINT) - 1)) AS m FROM closed),
cand AS (SELECT site, c AS sup, list_filter(s, lambda v, i: (m >> (i - 1)) % 2 = 1) AS x,
           list_filter(s, lambda v, i: (m >> (i - 1)) % 2 = 0) AS y FROM split),
rules AS (
  SELECT cand.site, x AS antecedent, y AS consequent, CAST(sup AS INTEGER) AS support, sup / gens.c AS confidence
  FROM cand JOIN gens ON gens.site = cand.site AND gens.s = x WHERE sup / gens.c >= 0.15
  QUALIFY row_number() OVER (PARTITION BY cand.site ORDER BY support DESC, confidence DESC, antecedent, consequent) <= 2000)
"""
_MATCHED = f"""{_RULES},
tx AS (SELECT site, CAST(o_custkey AS VARCHAR) AS "user", o_orderkey AS g, o_orderdate AS ts, i
       FROM bi JOIN orders ON o_orderkey = g),
last AS (SELECT site, "user", i FROM tx
  QUALIFY rank() OVER (PARTITION BY site, "user" ORDER BY ts DESC, g DESC) = 1),
hits AS (SELECT site, "user", antecedent, consequent, support, confidence, count(*) AS h
  FROM (SELECT *, unnest(antecedent) AS i FROM rules) JOIN last USING (site, i) GROUP BY ALL),
matched AS (SELECT site, "user", antecedent, consequent, support, confidence,
  h / len(antecedent) AS weight FROM hits WHERE h / len(antecedent) >= 0.5)
"""
_RULE_TEXT = """array_to_string(antecedent, ',') AS antecedent, array_to_string(consequent, ',') AS consequent,
  support, confidence"""
_EVENT_STORE = f"""WITH {_BASE}
SELECT event_id, "user", item, event, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM ev"""


def oracle_sql() -> dict[str, str]:
    epref_columns = 'event_id, site, "user", item, event, "dayOfweek", "hourOfday", related, score'
    return {
        "preferences_npref": f"WITH {_BASE} SELECT * FROM npref",
        "preferences_json": f"WITH {_BASE} SELECT * FROM npref",
        "preferences_store_roundtrip": f"""WITH {_BASE}
SELECT lpad(CAST(item % 9 AS VARCHAR), 3, '0') AS site, "user", item, score FROM npref""",
        "preferences_epref": f"WITH {_BASE} SELECT {epref_columns} FROM epref",
        "preferences_weight_table": f"""WITH {_BASE},
r2 AS (SELECT site, "user", item, sum(length(event)) AS raw FROM ev GROUP BY ALL)
SELECT site, "user", item, 5.0::DOUBLE * raw / max(raw) OVER (PARTITION BY site, "user") AS score FROM r2""",
        "related_item_split": f"""WITH {_BASE}
SELECT event_id, "user", item, lag(item) OVER (PARTITION BY site, "user" ORDER BY ts, event_id) AS related FROM ev""",
        "rated_items": f'WITH {_BASE} SELECT site, "user", item, value FROM rated',
        "last_transaction": """
WITH tx AS (SELECT 's1' AS site, CAST(o_custkey AS VARCHAR) AS "user", o_orderkey AS "group", o_orderdate AS ts FROM orders),
last AS (SELECT * FROM tx QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, "group" DESC) = 1)
SELECT DISTINCT site, "user", "group", ts, CAST(l_partkey AS INTEGER) AS item FROM last JOIN lineitem ON l_orderkey = "group\"""",
        "user_dictionary": f"WITH {_BASE} SELECT * FROM {_dictionary('ev', '\"user\"')}",
        "item_dictionary": f"WITH {_BASE} SELECT * FROM {_dictionary('ev', 'item')}",
        "part_dictionary": f"SELECT * FROM {_dictionary('lineitem', 'l_partkey')}",
        "feature_layout": f"WITH {_BASE}, {_layout('ev')} SELECT col, block, term FROM lay",
        "block_widths": f"""WITH {_BASE}, {_layout('ev')}
SELECT block, count(*) AS n, min(col) AS first_col, max(col) AS last_col FROM lay GROUP BY block""",
        "encode_decode_roundtrip": f"""WITH {_BASE}, {_layout('npref')}
SELECT site, "user", item, u.idx AS ux, i.idx AS ix, score FROM npref
JOIN ud u ON u.term = "user" JOIN idt i ON i.term = CAST(item AS VARCHAR)""",
        "one_hot_blocks": """
SELECT event_id,
  array_to_string([CASE WHEN i = isodow(ts) - 1 THEN 1 ELSE 0 END FOR i IN range(7)], ' ') || ' ' ||
  array_to_string([CASE WHEN i = hour(ts) THEN 1 ELSE 0 END FOR i IN range(24)], ' ') AS cells,
  CAST(isodow(ts) - 1 AS INTEGER) AS day_position, CAST(hour(ts) + 7 AS INTEGER) AS hour_position,
  CAST(NULL AS INTEGER) AS no_position FROM events""",
        "multi_hot_block": f"""WITH {_BASE}, idt AS {_dictionary('ev', 'item')},
mine AS (SELECT "user", list(DISTINCT idx) AS items FROM ev JOIN idt ON term = CAST(item AS VARCHAR) GROUP BY ALL)
SELECT "user", array_to_string([CASE WHEN list_contains(items, i) THEN 1 ELSE 0 END FOR i IN range(n)], '') AS cells
FROM mine, (SELECT count(*) AS n FROM idt)""",
        "feature_points_long": f"{_EPREF_LAYOUT}, {_CELLS} SELECT row_id, col, val FROM cells",
        "feature_points_sparse": f"""{_EPREF_LAYOUT}, {_CELLS}
SELECT row_id, score AS target, col, val FROM cells JOIN epref ON event_id = row_id""",
        "points_text_roundtrip": f"{_POINTS} SELECT {_POINT_COLUMNS} FROM pos",
        "points_parquet_roundtrip": f"{_POINTS} SELECT {_POINT_COLUMNS} FROM pos",
        "points_of_user": f"{_POINTS} SELECT {_POINT_COLUMNS} FROM pos WHERE user_col = 7",
        "active_item_columns": f"{_POINTS} SELECT DISTINCT item_col AS col FROM pos, n WHERE user_col = 7 AND day_col = u + 2 * i",
        "active_user_columns": f"{_POINTS} SELECT DISTINCT user_col AS col FROM pos, n WHERE item_col = u AND day_col = u + 2 * i",
        "rated_items_block": f"""{_EPREF_LAYOUT}
SELECT ud.idx AS user_col, it.idx AS item_idx, value FROM rated JOIN ud ON ud.term = "user" JOIN idt it ON it.term = item""",
        "filter_context": f"""WITH {_BASE} SELECT {epref_columns} FROM epref WHERE "user" = '7' AND event = 'view'""",
        "filter_context_item": f"""WITH {_BASE} SELECT {epref_columns} FROM epref
WHERE item = '42' AND event = 'click' AND "dayOfweek" = 2""",
        "context_columns": f'WITH {_BASE} SELECT event_id, event, "dayOfweek", related FROM epref',
        "active_items": f"WITH {_BASE}, {_active('\"user\"', 'item', 'ev')} SELECT request_id, site, item FROM active",
        "active_users": f"""WITH {_BASE}, {_active('item', '"user"', 'ev')} SELECT request_id, site, "user" FROM active""",
        "mf_predict_pairs": _PAIRS.format(extra=""),
        "model_save_load": _PAIRS.format(extra=", 64 AS rank"),
        "mf_predict_zipped": f"""
WITH p AS (SELECT l_orderkey, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem),
s AS (SELECT l_orderkey, l_suppkey AS supplier, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS r
      FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)), {_VEC}
SELECT l_orderkey, part, supplier, round({_DOT}, 6) AS score FROM p JOIN s USING (l_orderkey, r)
JOIN vec a ON a.id = part JOIN vec b ON b.id = supplier""",
        "mf_predict_one": f"""WITH {_VEC}
SELECT 's1' AS site, '3' AS "user", 4 AS item, round({_DOT}, 6) AS score FROM vec a, vec b WHERE a.id = 3 AND b.id = 4""",
        "factor_lookup": """SELECT CAST(vec_id AS INTEGER) AS id, CAST(i - 1 AS INTEGER) AS pos, embedding[i] AS value
FROM embeddings, range(1, 65) t(i) WHERE vec_id = 7""",
        "mf_top_items": f"""WITH {_VEC}
SELECT 's1' AS site, CAST(a.id AS VARCHAR) AS "user", b.id AS item, round({_DOT}, 6) AS score FROM vec a, vec b
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_DOT} DESC, b.id) <= 10""",
        "mf_top_users": f"""WITH {_BASE}, {_VEC}
SELECT 's1' AS site, CAST(b.id AS VARCHAR) AS "user", a.id AS item, round({_DOT}, 6) AS score
FROM vec a JOIN (SELECT DISTINCT item FROM ev) ON item = a.id, vec b
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_DOT} DESC, CAST(b.id AS VARCHAR)) <= 5""",
        "rmse_fixed": f"""WITH {_BASE}, {_VEC}
SELECT round(sqrt(avg((score - {_DOT}) * (score - {_DOT}))), 6) AS rmse
FROM npref JOIN vec a ON CAST(a.id AS VARCHAR) = "user" JOIN vec b ON b.id = item""",
        "vector_functions": f"""WITH {_VEC}
SELECT a.id, round({_DOT}, 6) AS dot, round(sqrt(list_inner_product(a.x, a.x)), 6) AS magnitude,
  round({_DOT} / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))), 6) AS cosine,
  CAST(NULL AS DOUBLE) AS cosine_zero FROM vec a JOIN vec b ON b.id = a.id + 1""",
        "als_recommend": f"""WITH {_BASE}
SELECT DISTINCT site, "user", least(10, (SELECT count(DISTINCT item) FROM npref)) AS n, TRUE AS as_product,
  TRUE AS in_order FROM npref""",
        "fm_train_predict": f"WITH {_BASE} SELECT count(*) AS n, TRUE AS beats_mean FROM epref WHERE related IS NOT NULL",
        "fm_block_step": f"""{_EPREF_LAYOUT}, {_CELLS}, {_PARAMS},
held AS (SELECT row_id, sum(w * val) AS l, sum(v[1] * val) AS s, sum(v[1] * v[1] * val * val) AS q
  FROM cells JOIN params USING (col) WHERE block <> 'hour' GROUP BY row_id),
rest AS (SELECT CAST("hourOfday" AS VARCHAR) AS term, s, score - 0.5 - l - (s * s - q) / 2 AS y
  FROM epref JOIN held ON row_id = event_id),
eq AS (SELECT term, 1.05 * count(*) AS a, sum(s) AS b, sum(s * s) + 0.05 * count(*) AS d, sum(y) AS e, sum(s * y) AS f
  FROM rest GROUP BY term)
SELECT term, round((e * d - b * f) / (a * d - b * b), 5) AS w, round((a * f - b * e) / (a * d - b * b), 5) AS v FROM eq""",
        "als_training_error": f"WITH {_BASE} SELECT count(*) AS ratings, TRUE AS as_reported, TRUE AS beats_mean FROM npref",
        "fm_training_error": f"WITH {_BASE} SELECT count(*) AS n, TRUE AS beats_mean FROM epref",
        "fm_train_blocks": f"WITH {_BASE} SELECT count(*) AS n, TRUE AS beats_mean FROM epref",
        "top_k_rules": f"WITH {_RULES} SELECT site, {_RULE_TEXT} FROM rules",
        "match_rules": f'WITH {_MATCHED} SELECT site, "user", {_RULE_TEXT}, weight FROM matched',
        "user_rules_json": f'WITH {_MATCHED} SELECT site, "user", {_RULE_TEXT}, weight FROM matched',
        "rules_of_users": f"""WITH {_MATCHED} SELECT site, "user", {_RULE_TEXT}, weight FROM matched
WHERE "user" IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')""",
        "rule_recommendations": f"""WITH {_MATCHED},
ranked AS (SELECT *, row_number() OVER w AS n,
  coalesce(sum(len(consequent)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM matched WINDOW w AS (PARTITION BY site, "user" ORDER BY weight DESC, confidence DESC, support DESC, antecedent, consequent))
SELECT site, "user", unnest(consequent) AS item, round(weight * confidence * support, 6) AS score
FROM ranked WHERE n = 1 OR before < 3""",
        "fm_score_points": f"{_EPREF_LAYOUT}, {_CELLS}, {_PARAMS}, {_SCORES} SELECT row_id, prediction FROM scores",
        "fm_score_context": f"""{_EPREF_LAYOUT}, {_CELLS}, {_PARAMS}, {_SCORES}
SELECT event_id, "user", item, prediction AS score FROM epref JOIN scores ON row_id = event_id WHERE related IS NOT NULL""",
        "cosine_similar": f"""WITH all_rows AS (SELECT CAST(vec_id AS INTEGER) AS col, embedding::DOUBLE[] AS x FROM embeddings),
{_matrix('all_rows', 5)} SELECT col, sim_col, round(score, 6) AS score FROM matrix""",
        "car_recommend_items": _car("item", '"user"'),
        "car_recommend_users": _car("user", "item").replace("AS user,", 'AS "user",').replace(
            "active.user ", 'active."user" ').replace("p.user AS user", 'p."user" AS "user"'),
        "similar_users": _similar("user"),
        "similar_items": _similar("item"),
        "track_batch": _EVENT_STORE,
        "track_stream": _EVENT_STORE,
    }
