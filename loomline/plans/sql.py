"""Equivalent SQL: named sub-queries, of which a statement gets those that it refers to."""

from __future__ import annotations

import re

from loomline.operators import ranking, recall


def category(x: str) -> str:
    s = f"trim(CAST({x} AS VARCHAR))"
    token = f"trim(regexp_replace(regexp_replace({s}, '[\\s/\\\\]+', '_', 'g'), '_+', '_', 'g'), '_')"
    return f"CASE WHEN {x} IS NULL OR lower({s}) IN ('', 'nan', '<na>', 'none') OR {token} = '' THEN 'unknown' ELSE {token} END"


def tier(n: str) -> str:
    return f"CASE WHEN {n} <= 0 THEN 'cold_start' WHEN {n} <= 2 THEN 'low' WHEN {n} <= 9 THEN 'medium' ELSE 'high' END"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


WEIGHTS = values((t, c, w) for t, by in ranking.WEIGHTS.items() for c, w in by.items())
WINDOWS = values((n, w) for n, w in zip(recall.WINDOW_WEEKS, recall.WINDOW_WEIGHTS, strict=True))


def popularity(source: str, by: str = "") -> str:
    """(by, item_id, score) of a sub-query with (by, item_id, date)."""
    cols = f"{by}, " if by else ""
    part = f"PARTITION BY {cols}w"
    last = f"SELECT {cols}max(date) AS m FROM {source}" + (f" GROUP BY {by}" if by else "")
    on = f"USING ({by})" if by else "ON true"
    return f"""SELECT {cols}item_id, round(sum(w * (n - rk + 1) / n), 9) AS score FROM (
  SELECT {cols}item_id, w, row_number() OVER ({part} ORDER BY c DESC, item_id) AS rk, count(*) OVER ({part}) AS n FROM (
    SELECT {cols}item_id, w, count(*) AS c FROM {source} JOIN ({last}) AS la {on} JOIN (VALUES {WINDOWS}) AS k(wk, w) ON date >= m - CAST(7 * wk - 1 AS INTEGER)
    GROUP BY ALL)) GROUP BY ALL"""


def top(source: str, by: str, k: int) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"SELECT * FROM (SELECT *, row_number() OVER ({part}ORDER BY score DESC, item_id) AS rank FROM ({source})) WHERE rank <= {k}"


def neighbours(mode: str) -> str:
    key = "x.item_id AS item_a, y.item_id AS item_id"
    pairs = "seq x JOIN seq y ON x.user_id = y.user_id AND x.pos <> y.pos"
    if mode == "sequential":
        body = f"SELECT {key}, CAST(count(*) AS DOUBLE) AS score FROM seq x JOIN seq y ON x.user_id = y.user_id AND y.pos = x.pos + 1 GROUP BY ALL"
    elif mode == "raw_cooccur":
        body = f"SELECT {key}, CAST(count(*) AS DOUBLE) AS score FROM {pairs} GROUP BY ALL"
    elif mode == "time_decay":
        d = lambda t: f"exp(-ln(2.0) * greatest(0, {t}.last - {t}.date) / 14.0)"
        body = f"SELECT {key}, round(sum(({d('x')} + {d('y')}) / 2), 9) AS score FROM {pairs} GROUP BY ALL"
    elif mode == "cosine_iuf":
        body = f"SELECT item_a, item_id, round(w / sqrt(a.s * b.s), 9) AS score FROM (SELECT {key}, sum(1 / ln(1.0 + x.n)) AS w FROM {pairs} GROUP BY ALL) JOIN strength a ON a.item = item_a JOIN strength b ON b.item = item_id"
    else:
        body = f"""SELECT {key}, round(sum(1 / (1.0 + overlap)), 9) AS score FROM
  (SELECT x.user_id AS u, y.user_id AS v, count(*) AS overlap FROM seq x JOIN seq y ON x.item_id = y.item_id AND x.user_id < y.user_id GROUP BY ALL HAVING count(*) > 1)
  JOIN seq x ON x.user_id = u JOIN seq y ON y.user_id = u AND y.item_id <> x.item_id JOIN seq p ON p.user_id = v AND p.item_id = x.item_id JOIN seq q ON q.user_id = v AND q.item_id = y.item_id GROUP BY ALL"""
    return top(body, "item_a", 20)


def melted(source: str, fields: tuple[str, ...]) -> str:
    parts = " UNION ALL ".join(f"SELECT item_id, '{f}' AS field, {category(f)} AS value FROM art" for f in fields)
    return f"SELECT s.*, field, value FROM {source} s JOIN ({parts}) m ON m.item_id = s.item_id WHERE value <> 'unknown'"


CTE: dict[str, str] = {
    "tx": """SELECT CAST(o_custkey AS VARCHAR) AS user_id, lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS item_id, CAST(o_orderdate AS DATE) AS date,
  l_extendedprice / nullif(l_quantity, 0) AS price, CAST(1 + l_linenumber % 2 AS INTEGER) AS channel FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "act": """SELECT CAST(user_id AS VARCHAR) AS user_id, lpad(json_extract_string(props, '$.k'), 10, '0') AS item_id, CAST(ts AS DATE) AS date, value AS price,
  CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 2 END AS channel FROM events""",
    "b": "SELECT max(date) AS test_end, max(date) - 27 AS test_start, max(date) - 28 AS valid_end, max(date) - 55 AS valid_start, max(date) - 56 AS train_end, max(date) - 783 AS window_start FROM tx",
    "ev": """SELECT user_id, item_id, date, CAST(sum(n) AS BIGINT) AS quantity, sum(s) / nullif(sum(k), 0) AS mean_price, min(lo) AS min_price, max(hi) AS max_price,
  (list(channel ORDER BY n DESC, channel))[1] AS sales_channel_mode, count(*) AS n_channels FROM
  (SELECT user_id, item_id, date, channel, count(*) AS n, sum(price) AS s, count(price) AS k, min(price) AS lo, max(price) AS hi FROM tx GROUP BY ALL) GROUP BY ALL""",
    "inter": "SELECT DISTINCT user_id, item_id, date FROM tx, b WHERE date BETWEEN window_start AND test_end",
    "past": "SELECT inter.* FROM inter, b WHERE date <= train_end",
    "valid": "SELECT inter.* FROM inter, b WHERE date BETWEEN valid_start AND valid_end",
    "targets": "SELECT DISTINCT user_id, item_id FROM valid",
    "users": "SELECT DISTINCT user_id FROM targets",
    "art": """SELECT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS item_id, p_brand || '_' || p_type AS product_code, split_part(p_name, ' ', 1) AS colour_group_name, split_part(p_name, ' ', 2) AS product_type_name,
  p_brand AS department_name, p_type AS garment_group_name, 'S' || (p_size % 10) AS section_name, p_name AS prod_name, p_name || ' ' || p_brand || ' ' || p_type AS detail_desc, CAST(p_size AS VARCHAR) AS department_no FROM part""",
    "cust": """SELECT CAST(c_custkey AS VARCHAR) AS user_id, CASE WHEN c_custkey % 17 <> 0 THEN 18 + c_custkey % 60 END AS age, c_mktsegment AS club_member_status,
  CASE WHEN c_custkey % 5 = 0 THEN 'NONE' ELSE 'Regularly' END AS fashion_news_frequency, 'P' || c_nationkey AS postal_code, CASE WHEN c_custkey % 3 = 0 THEN '1' END AS fn, CASE WHEN c_acctbal > 0 THEN '1' ELSE '0' END AS active FROM customer""",
    "cohorts": "SELECT user_id, CASE WHEN age <= 17 THEN 'under_18' WHEN age <= 24 THEN '18_24' WHEN age <= 34 THEN '25_34' WHEN age <= 44 THEN '35_44' WHEN age <= 54 THEN '45_54' WHEN age <= 64 THEN '55_64' ELSE '65_plus' END AS cohort FROM cust WHERE age IS NOT NULL",
    "specs": """SELECT as_of_date, split, as_of_date + 1 AS label_start, as_of_date + 7 AS label_end FROM (
  SELECT CAST(train_end - 7 - CAST(7 * k AS INTEGER) AS DATE) AS as_of_date, 'train' AS split FROM b, generate_series(0, 102) AS g(k)
  UNION ALL SELECT train_end, 'valid' FROM b UNION ALL SELECT valid_end, 'test' FROM b)""",
    "lab": """SELECT l.user_id, l.item_id, as_of_date, split, true AS label_purchase, coalesce(f.d <= as_of_date, false) AS label_repeat, NOT coalesce(f.d <= as_of_date, false) AS label_new_to_user,
  NOT coalesce(f.d <= as_of_date, false) AND coalesce(g.d <= as_of_date, false) AS label_same_style_new_color, label_quantity FROM
  (SELECT user_id, item_id, as_of_date, split, CAST(sum(quantity) AS BIGINT) AS label_quantity FROM ev JOIN specs ON date BETWEEN label_start AND label_end GROUP BY ALL) l
  LEFT JOIN (SELECT user_id, item_id, min(date) AS d FROM ev GROUP BY ALL) f ON f.user_id = l.user_id AND f.item_id = l.item_id
  LEFT JOIN art a ON a.item_id = l.item_id
  LEFT JOIN (SELECT user_id, product_code, min(date) AS d FROM ev JOIN art USING (item_id) GROUP BY ALL) g ON g.user_id = l.user_id AND g.product_code = a.product_code""",
    "hist": "SELECT user_id, list(item_id ORDER BY date, item_id) AS items FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, item_id DESC) AS n FROM past) WHERE n <= 200 GROUP BY user_id",
    "seen": "SELECT user_id, unnest(items) AS item_id FROM hist",
    "seeds": "SELECT user_id, unnest(items[-10:]) AS item_id FROM hist",
    "tiers": f"SELECT user_id, coalesce(len(items), 0) AS history_len, {tier('coalesce(len(items), 0)')} AS tier FROM users LEFT JOIN hist USING (user_id)",
    "pop": popularity("past"),
    "poplist": top("SELECT * FROM pop", "", 50),
    "past_cohort": "SELECT past.*, cohort FROM past JOIN cohorts USING (user_id)",
    "cohort_list": top(popularity("past_cohort", "cohort"), "cohort", 50),
    "past_cat": melted("past", recall.CATEGORY_FIELDS),
    "bucket": top(popularity("past_cat", "field, value"), "field, value", 100),
    "seq": """SELECT user_id, item_id, date, last, row_number() OVER (PARTITION BY user_id ORDER BY date, item_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM
  (SELECT user_id, item_id, min(date) AS date, max(m) AS last FROM past, (SELECT max(date) AS m FROM past) WHERE date >= m - 55 GROUP BY ALL)""",
    "strength": "SELECT item_id AS item, sum(1 / ln(1.0 + n)) AS s FROM seq GROUP BY 1",
    "near": neighbours("cosine_iuf"),
    "follows": neighbours("sequential"),
    "sib": "SELECT product_code AS code, a.item_id, CASE WHEN score IS NULL THEN 0.0 ELSE greatest(score, 1e-9) END AS score FROM art a LEFT JOIN pop USING (item_id)",
    "vec": """SELECT item_id, token, c / total * (ln((1.0 + n_docs) / (1.0 + df)) + 1) AS w FROM
  (SELECT *, count(*) OVER (PARTITION BY token) AS df FROM (SELECT item_id, token, count(*) AS c, any_value(total) AS total FROM (
    SELECT item_id, len(t) AS total, unnest(t) AS token FROM (SELECT item_id, list_concat(
      list_transform(regexp_extract_all(lower(prod_name), '[a-z0-9]+'), lambda x: 'txt:' || x), list_transform(regexp_extract_all(lower(detail_desc), '[a-z0-9]+'), lambda x: 'txt:' || x),
      list_filter(["""
    + ", ".join(f"'cat:{f}:' || nullif({category(f)}, 'unknown')" for f in recall.CONTENT_FIELDS)
    + """], lambda x: x IS NOT NULL)) AS t FROM art)) GROUP BY item_id, token)), (SELECT count(*) AS n_docs FROM art)""",
    "used": "SELECT user_id, count(*) AS used FROM seeds WHERE item_id IN (SELECT item_id FROM vec) GROUP BY user_id",
    "profile": "SELECT user_id, token, sum(w) / any_value(used) AS pw FROM seeds JOIN vec USING (item_id) JOIN used USING (user_id) GROUP BY ALL",
    "r_popular": """SELECT user_id, item_id, score, rank FROM users JOIN hist USING (user_id), poplist
  UNION ALL SELECT user_id, item_id, score, rank FROM users u JOIN cohorts USING (user_id) JOIN cohort_list USING (cohort) WHERE user_id NOT IN (SELECT user_id FROM hist)
  UNION ALL SELECT user_id, item_id, score, rank FROM users, poplist WHERE user_id NOT IN (SELECT user_id FROM hist) AND user_id NOT IN (SELECT user_id FROM cohorts WHERE cohort IN (SELECT cohort FROM cohort_list))""",
    "r_category": top("SELECT user_id, item_id, round(sum(score), 9) AS score FROM (SELECT DISTINCT user_id, field, value FROM (" + melted("seeds", recall.CATEGORY_FIELDS) + ") WHERE user_id IN (FROM users)) JOIN bucket USING (field, value) GROUP BY ALL", "user_id", 50),
    "r_item": top("SELECT user_id, n.item_id, round(sum(score), 9) AS score FROM seeds s JOIN near n ON n.item_a = s.item_id WHERE user_id IN (FROM users) GROUP BY ALL", "user_id", 50),
    "r_sequence": top("SELECT user_id, n.item_id, round(sum(score), 9) AS score FROM seeds s JOIN follows n ON n.item_a = s.item_id WHERE user_id IN (FROM users) GROUP BY ALL", "user_id", 50),
    "r_repurchase": top("SELECT user_id, item_id, round(count(DISTINCT date) * exp(-ln(2.0) * greatest(0, any_value(train_end) - max(date)) / 28.0), 9) AS score FROM past, b WHERE user_id IN (FROM users) GROUP BY ALL", "user_id", 50),
    "r_style": top("SELECT user_id, sib.item_id, score FROM (SELECT DISTINCT user_id, code FROM seeds JOIN sib USING (item_id) WHERE user_id IN (FROM users)) JOIN sib USING (code) ANTI JOIN seen USING (user_id, item_id)", "user_id", 50),
    "r_content": top(
        """SELECT user_id, item_id, score FROM (SELECT user_id, item_id, round(sum(pw * w) / (any_value(ul) * any_value(il)), 9) AS score FROM profile JOIN vec USING (token)
  JOIN (SELECT user_id, sqrt(sum(pw * pw)) AS ul FROM profile GROUP BY 1) USING (user_id) JOIN (SELECT item_id, sqrt(sum(w * w)) AS il FROM vec GROUP BY 1) USING (item_id)
  WHERE user_id IN (FROM users) GROUP BY ALL) ANTI JOIN seen USING (user_id, item_id) WHERE score > 0""",
        "user_id",
        50,
    )
    + " UNION ALL SELECT user_id, item_id, score, rank FROM users, poplist WHERE user_id NOT IN (SELECT user_id FROM used)",
    "cand": " UNION ALL ".join(
        f"SELECT user_id, item_id, '{c}' AS channel, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank, 'valid' AS split FROM {t}"
        for c, t in {"sequence": "r_sequence", "popular": "r_popular", "category_popular": "r_category", "item2item": "r_item", "repurchase": "r_repurchase", "style": "r_style", "content": "r_content"}.items()
    ),
    "items": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, split ORDER BY channel_count DESC, best_rank, max_score DESC, item_id) AS n FROM
  (SELECT user_id, item_id, split, count(*) AS channel_count, min(rank) AS best_rank, max(score) AS max_score FROM cand GROUP BY ALL)) WHERE n <= 500""",
    "un": "SELECT cand.* FROM cand SEMI JOIN items USING (user_id, item_id, split)",
    "wt": f"SELECT * FROM (VALUES {WEIGHTS}) AS t(tier, channel, weight)",
    "fused": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT user_id, item_id, round(sum(weight / rank), 9) AS score FROM un JOIN tiers USING (user_id) JOIN wt USING (tier, channel) WHERE weight > 0 GROUP BY ALL)) WHERE rank <= 12",
    "nact": "SELECT user_id, count(*) AS n_actual FROM targets GROUP BY 1",
    "per_user": "",
    "strata": """SELECT user_id, tier, CASE WHEN history_len <= 0 THEN 'cold' ELSE 'warm' END AS warm_cold, CASE WHEN k = n THEN 'repeat_only' WHEN k = 0 THEN 'new_only' ELSE 'mixed' END AS stratum FROM
  (SELECT user_id, count(*) AS n, count(DISTINCT s.item_id) AS k FROM targets t LEFT JOIN (SELECT DISTINCT user_id, item_id FROM seen) s USING (user_id, item_id) GROUP BY user_id) JOIN tiers USING (user_id)""",
    "rich": f"""SELECT e.*, coalesce(product_code, '') AS style, {category('department_name')} AS department, {category('colour_group_name')} AS colour, {category('product_type_name')} AS product_type,
  CASE WHEN mean_price IS NULL THEN 'unknown' WHEN mean_price < 1200 THEN 'low' WHEN mean_price < 1600 THEN 'mid' ELSE 'high' END AS price_band,
  date > min(date) OVER (PARTITION BY user_id, item_id) AS is_repeat, date > min(date) OVER (PARTITION BY user_id, product_code) AS is_style_repeat FROM ev e LEFT JOIN art USING (item_id)""",
}


def metrics(source: str, keys: str = "user_id", k: int = 12, base: str = "nact") -> str:
    """(keys, n_actual, ap, recall, ndcg, hit) of a sub-query with (keys, item_id, rank) whose items are distinct."""
    return f"""SELECT {', '.join('n.' + x for x in keys.split(', '))}, n_actual, coalesce(p / least(n_actual, {k}), 0.0) AS ap, coalesce(h / n_actual, 0.0) AS recall,
  coalesce(g / list_sum(list_transform(range(1, CAST(least(n_actual, {k}) AS BIGINT) + 1), lambda i: 1 / log2(i + 1.0))), 0.0) AS ndcg, CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit FROM {base} n LEFT JOIN
  (SELECT {keys}, sum(c / rank) AS p, count(*) AS h, sum(1 / log2(rank + 1.0)) AS g FROM (SELECT s.*, count(*) OVER (PARTITION BY {keys} ORDER BY rank) AS c FROM {source} s JOIN targets USING (user_id, item_id) WHERE rank <= {k}) GROUP BY {keys}) USING ({keys})"""


CTE["per_user"] = metrics("fused")


def references(text: str, names) -> list[str]:
    """Sub-queries that a text reads: after FROM or JOIN, or after a comma those that are single tables of a product."""
    found = re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text) + re.findall(r",\s*(b|poplist)\b(?!\.)", text)
    return [x for x in dict.fromkeys(found) if x in names]


def statement(body: str, **extra: str) -> str:
    """body with the sub-queries that it needs, directly or through others, in order. extra: further sub-queries."""
    all_ = {**CTE, **extra}
    order: list[str] = []

    def place(text: str) -> None:
        for name in references(text, all_):
            if name not in order:
                place(all_[name])
                order.append(name)

    place(body)
    return ("WITH " + ",\n".join(f"{n} AS ({all_[n]})" for n in order) + "\n" if order else "") + body
