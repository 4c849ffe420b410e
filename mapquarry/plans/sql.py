"""SQL of the registered queries, for an independent engine over the same tables."""

from __future__ import annotations

GRAPH = """
dataset AS (SELECT o_orderkey AS id, 'order ' || o_orderkey || ' ' || o_orderpriority AS title, o_orderstatus AS notes FROM orders),
space AS (SELECT dataset_id, west, south, least(180.0::DOUBLE, west + 1 + dataset_id % 40) AS east, least(90.0::DOUBLE, south + 1 + dataset_id % 20) AS north
  FROM (SELECT o_orderkey AS dataset_id, ((o_custkey * 37) % 340 - 170)::DOUBLE AS west, ((o_custkey * 53) % 160 - 80)::DOUBLE AS south FROM orders)),
time_ AS (SELECT l_orderkey AS dataset_id, strftime(min(l_shipdate), '%Y%m%d %H:%M:%S') AS begin_, strftime(max(l_shipdate), '%Y%m%d %H:%M:%S') AS end_ FROM lineitem GROUP BY 1),
parts AS (SELECT l_orderkey AS dataset_id, p_name, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
topic AS (SELECT DISTINCT p_name AS id, p_name AS name FROM part),
has_topic AS (SELECT DISTINCT dataset_id, p_name AS entity_id FROM parts),
keyword AS (SELECT DISTINCT p_brand AS id, p_brand AS name FROM part),
has_keyword AS (SELECT DISTINCT dataset_id, p_brand AS entity_id FROM parts),
organization AS (SELECT s_suppkey::VARCHAR AS id, s_name AS name FROM supplier),
published_by AS (SELECT DISTINCT l_orderkey AS dataset_id, l_suppkey::VARCHAR AS entity_id FROM lineitem),
resource AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_orderkey AS dataset_id, lower(l_returnflag || '-' || l_linestatus) AS format_id FROM lineitem),
has_resource AS (SELECT DISTINCT dataset_id, id AS resource_id FROM resource),
has_format AS (SELECT DISTINCT id AS resource_id, format_id AS entity_id FROM resource),
format_ AS (SELECT DISTINCT format_id AS id, format_id AS name FROM resource),
license AS (SELECT DISTINCT o_orderpriority AS id, o_orderpriority AS name FROM orders),
has_license AS (SELECT o_orderkey AS dataset_id, o_orderpriority AS entity_id FROM orders),
provides AS (SELECT o_orderkey AS dataset_id, r_name AS entity_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
pending AS (SELECT DISTINCT dataset_id, trim(regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9]+', ' ', 'g')) AS canonical FROM parts)
"""
BOXED = "west <= 40.0 AND east >= -80.0 AND south <= 60.0 AND north >= 20.0"
SPANNED = "begin_ <= '19981231 23:59:59' AND end_ >= '19970101 00:00:00'"
HARD = f"(SELECT dataset_id FROM space WHERE {BOXED} AND dataset_id IN (SELECT dataset_id FROM time_ WHERE {SPANNED}))"


def score(name: str, q: str) -> str:
    q = q.lower()
    n = f"length(lower({name}))"
    return (
        f"(CASE WHEN lower({name}) = '{q}' THEN 1.0 WHEN starts_with(lower({name}), '{q}') THEN 0.8 WHEN ends_with(lower({name}), '{q}') THEN 0.6 ELSE 0.4 END::DOUBLE * 0.7::DOUBLE"
        f" + (1.0::DOUBLE - abs({n} - {len(q)}) / greatest({n}, {len(q)})::DOUBLE) * 0.3::DOUBLE)"
    )


def found(table: str, q: str, threshold: float = 0.0) -> str:
    return f"(SELECT id, round({score('name', q)}, 6) AS score FROM {table} WHERE contains(lower(name), '{q.lower()}') AND round({score('name', q)}, 6) > {threshold})"


F1 = (
    "CASE WHEN least(east, 40.0) > greatest(west, -80.0) AND least(north, 60.0) > greatest(south, 20.0) AND (east - west) * (north - south) > 0"
    " THEN least(1.0::DOUBLE, 2.0::DOUBLE * (least(east, 40.0) - greatest(west, -80.0)) * (least(north, 60.0) - greatest(south, 20.0)) / ((east - west) * (north - south) + 4800.0)) ELSE 0.0 END::DOUBLE"
)


def minutes(c: str) -> str:
    return f"(datediff('day', DATE '1970-01-01', strptime(substr({c}, 1, 8), '%Y%m%d')::DATE) * 1440 + substr({c}, 10, 2)::BIGINT * 60 + substr({c}, 13, 2)::BIGINT)"


S, E = minutes("'19970101 00:00:00'"), minutes("'19981231 23:59:59'")
TF1 = (
    f"CASE WHEN least({minutes('end_')}, {E}) > greatest({minutes('begin_')}, {S}) AND end_ > begin_ AND {minutes('end_')} > {minutes('begin_')}"
    f" THEN least(1.0::DOUBLE, 2.0::DOUBLE * (least({minutes('end_')}, {E}) - greatest({minutes('begin_')}, {S})) / (({minutes('end_')} - {minutes('begin_')}) + greatest(1, {E} - {S}))) ELSE 0.0 END::DOUBLE"
)
LINKS = f"(SELECT dataset_id, score FROM has_topic JOIN {found('topic', 'red')} f ON f.id = entity_id UNION ALL SELECT dataset_id, score FROM has_keyword JOIN {found('keyword', 'brand#1')} f ON f.id = entity_id)"
FREQ = "(SELECT canonical, count(DISTINCT dataset_id) AS freq FROM pending GROUP BY 1)"
MERGES = "(SELECT src, dst FROM (SELECT id AS src, lead(id) OVER (PARTITION BY string_split(id, ' ')[-1] ORDER BY id) AS dst FROM topic) WHERE dst IS NOT NULL)"
SIMILAR = """alike AS (SELECT *, len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE AS jaccard FROM
  (SELECT canonical, string_split(canonical, ' ') AS a FROM (SELECT DISTINCT canonical FROM pending)) JOIN (SELECT id AS topic, string_split(id, ' ') AS b FROM topic) ON len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE >= 0.6::DOUBLE)"""
# Jaro-Winkler letter by letter: transpositions are halves here, which the engine's own function rounds down.
JARO = """letters AS (SELECT canonical AS a, topic AS b, greatest(0, greatest(length(canonical), length(topic)) // 2 - 1) AS reach, 1 AS i, []::BIGINT[] AS used, '' AS mine FROM hit
  UNION ALL SELECT a, b, reach, i + 1, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END, CASE WHEN j IS NULL THEN mine ELSE mine || substr(a, i, 1) END FROM
  (SELECT *, list_filter(range(greatest(1, i - reach), least(length(b), i + reach) + 1), lambda x: substr(b, x, 1) = substr(a, i, 1) AND NOT list_contains(used, x))[1] AS j FROM letters WHERE i <= length(a))),
jaro AS (SELECT a, b, CASE WHEN m = 0 THEN 0.0 ELSE (m / length(a) + m / length(b) + (m - t) / m) / 3.0::DOUBLE END AS jaro, CASE WHEN substr(a, 1, 4) = substr(b, 1, 4) THEN 4 WHEN substr(a, 1, 3) = substr(b, 1, 3) THEN 3 WHEN substr(a, 1, 2) = substr(b, 1, 2) THEN 2 WHEN substr(a, 1, 1) = substr(b, 1, 1) THEN 1 ELSE 0 END AS front
  FROM (SELECT a, b, len(used)::DOUBLE AS m, len(list_filter(range(1, len(used) + 1), lambda k: substr(mine, k, 1) <> substr(b, list_sort(used)[k], 1))) / 2.0::DOUBLE AS t FROM letters WHERE i = length(a) + 1))"""
RESOLVED = f"""hit AS (SELECT canonical, arg_min(topic, (-jaccard, topic)) AS topic FROM alike GROUP BY 1),
{JARO},
resolved AS (SELECT canonical, freq, CASE WHEN canonical IN (SELECT id FROM topic) THEN canonical WHEN ok THEN topic END AS topic, CASE WHEN canonical IN (SELECT id FROM topic) THEN 'existing' WHEN ok THEN 'decide' ELSE 'create' END AS action
  FROM (SELECT f.canonical, f.freq, hit.topic, coalesce(freq >= 5 AND jaro + front * 0.1::DOUBLE * (1 - jaro) >= 0.9::DOUBLE, false) AS ok FROM {FREQ} f LEFT JOIN hit USING (canonical) LEFT JOIN jaro ON a = canonical AND b = topic))"""
FINAL = f"""walk AS (SELECT src, dst, 1 AS d FROM {MERGES} UNION ALL SELECT w.src, m.dst, d + 1 FROM walk w JOIN {MERGES} m ON w.dst = m.src WHERE d < 40),
final AS (SELECT src, arg_max(dst, d) AS dst FROM walk GROUP BY src)"""
NEAR = """near AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
  (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id) QUALIFY rank <= 5)"""
NEAR20 = NEAR.replace("rank <= 5", "rank <= 20")
JUDGED = NEAR20 + """, judged AS (SELECT query_id, rank, (e.label = q.label)::INT AS rel FROM near JOIN embeddings e ON e.vec_id = near.vec_id JOIN embeddings q ON q.vec_id = query_id),
pool AS (SELECT q.vec_id AS query_id, (e.label = q.label)::INT AS rel, row_number() OVER (PARTITION BY q.vec_id ORDER BY (e.label = q.label)::INT DESC) AS ideal FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
best AS (SELECT query_id, sum((pow(2.0, rel) - 1) / log2(ideal + 1)) AS best FROM pool WHERE ideal <= 10 GROUP BY 1),
ndcg AS (SELECT query_id, CASE WHEN best > 0 THEN coalesce((SELECT sum((pow(2.0, rel) - 1) / log2(rank + 1)) FROM judged j WHERE j.query_id = best.query_id AND rank <= 10), 0.0) / best ELSE 0.0 END AS ndcg FROM best)"""
FEED = """feed AS (SELECT user_id AS session, (props->>'$.k')::BIGINT % 8 AS stage, CASE event_type WHEN 'view' THEN 'active' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'skipped' END AS status, epoch_us(ts) AS at_, event_id
  FROM events WHERE event_type IN ('view', 'purchase', 'error')),
isle AS (SELECT *, coalesce(sum((status <> 'active')::INT) OVER (PARTITION BY session, stage ORDER BY at_, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM feed),
dur AS (SELECT session, stage, status, stop - start_ AS micros, stop FROM (SELECT session, stage, island, min(at_) FILTER (status = 'active') AS start_, max(at_) FILTER (status <> 'active') AS stop, max(status) FILTER (status <> 'active') AS status FROM isle GROUP BY ALL)
  WHERE start_ IS NOT NULL AND stop IS NOT NULL)"""
EDGES = """edges AS (SELECT sha1(src || '|' || type || '|' || dst) AS edge_id, src, type, dst FROM (
  SELECT 'Dataset:' || dataset_id AS src, 'HAS_TOPIC' AS type, 'Topic:' || entity_id AS dst FROM has_topic
  UNION SELECT 'Dataset:' || dataset_id, 'HAS_LICENSE', 'License:' || entity_id FROM has_license
  UNION SELECT 'Dataset:' || dataset_id, 'PROVIDES', 'Source:' || entity_id FROM provides
  UNION SELECT 'Dataset:' || dataset_id, 'HAS_RESOURCE', 'Resource:' || resource_id FROM has_resource
  UNION SELECT 'Resource:' || resource_id, 'HAS_FORMAT', 'Format:' || entity_id FROM has_format JOIN has_resource USING (resource_id)))"""


def graph(body: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([GRAPH, *more])} {body}"


#: Space and time of the hard set; ranks of sums.
PLACED = f"SELECT dataset_id, {F1} * 0.2::DOUBLE AS c FROM space WHERE dataset_id IN {HARD} AND {F1} > 0 UNION ALL SELECT dataset_id, {TF1} * 0.2::DOUBLE FROM time_ WHERE dataset_id IN {HARD} AND {TF1} > 0"
RANKED = "SELECT dataset_id, score, rank FROM (SELECT *, rank() OVER (ORDER BY score DESC) AS rank FROM (SELECT dataset_id, round(total / (SELECT max(total) FROM sums), 6) AS score FROM sums)) WHERE rank <= 20"
def fulltext(fields: str, asked: str) -> str:
    """Scores of all rows for all queries: weighted sums of each field's BM25."""
    words = "list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""word AS (SELECT id, field, weight, len({words}) AS n, unnest({words}) AS term FROM ({fields})),
      tf AS (SELECT id, field, weight, n, term, count(*) AS tf FROM word GROUP BY ALL),
      field_ AS (SELECT field, count(*) AS docs, avg(n) AS mean FROM (SELECT DISTINCT id, field, n FROM word) GROUP BY 1),
      df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
      asked AS (SELECT DISTINCT query_id, unnest({words}) AS term FROM ({asked})),
      ranked AS (SELECT query_id, id, round(sum(weight * ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score
        FROM asked JOIN tf USING (term) JOIN df USING (field, term) JOIN field_ USING (field) GROUP BY 1, 2)"""


MESSAGES = """message AS (SELECT user_id AS conv_id, epoch_us(ts) AS at_, event_id AS seq, 'dim' || k % 5 AS name, 'v' || event_id AS value, CASE event_type WHEN 'view' THEN 'status' WHEN 'click' THEN 'turn' WHEN 'purchase' THEN 'intent'
  WHEN 'error' THEN ['subscribe', 'unsubscribe', 'question'][(k % 3 + 1)::INT] ELSE CASE WHEN k % 4 = 0 THEN 'reset' ELSE 'answer' END END AS kind FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)),
paused AS (SELECT *, coalesce(at_ - lag(at_) OVER (PARTITION BY conv_id ORDER BY at_, seq) > 86400000000, false) AS pause FROM message),
counted AS (SELECT *, sum(pause::BIGINT) OVER w AS visit, sum((pause OR kind = 'reset')::BIGINT) OVER w AS epoch, sum((kind = 'reset')::BIGINT) OVER w AS question FROM paused WINDOW w AS (PARTITION BY conv_id ORDER BY at_, seq))"""
STATES = """SELECT conv_id, max(at_) AS "at", arg_max(seq, (at_, seq)) AS seq, max(question)::BIGINT AS question, coalesce((SELECT string_agg(name || '=' || value, ';' ORDER BY name) FROM (SELECT name, arg_max(value, (at_, seq)) AS value FROM now_ n WHERE n.conv_id = c.conv_id AND kind = 'intent' GROUP BY 1)), '') AS intent,
  (SELECT CASE WHEN arg_max(kind, (at_, seq)) = 'question' THEN arg_max(value, (at_, seq)) END FROM now_ n WHERE n.conv_id = c.conv_id AND kind IN ('question', 'answer')) AS pending,
  (SELECT count(*) FROM now_ n WHERE n.conv_id = c.conv_id AND kind = 'turn') AS turns, (SELECT arg_max(value, (at_, seq)) FROM now_ n WHERE n.conv_id = c.conv_id AND kind = 'turn') AS last_turn,
  coalesce((SELECT arg_max(kind, (at_, seq)) = 'subscribe' FROM here_ n WHERE n.conv_id = c.conv_id AND kind IN ('subscribe', 'unsubscribe')), false) AS subscribed FROM counted c GROUP BY conv_id"""
NOW = "now_ AS (SELECT * FROM counted QUALIFY epoch = max(epoch) OVER (PARTITION BY conv_id)), here_ AS (SELECT * FROM counted QUALIFY visit = max(visit) OVER (PARTITION BY conv_id))"


HOP = "list_reduce([{x}] || list_transform(range(20), lambda i: ''), lambda c, x: coalesce(m[c], c))"
#: Decisions in turn; m maps merged topics to their targets.
TURNS = f"""decision AS (SELECT seq, CASE WHEN seq % 2 = 1 THEN b ELSE a END AS src, CASE WHEN seq % 2 = 1 THEN a ELSE b END AS dst, (seq * 7919 % 1000) / 1000 AS confidence
  FROM (SELECT dataset_id AS seq, min(entity_id) AS a, max(entity_id) AS b FROM has_topic GROUP BY 1) WHERE a < b),
turn AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq) AS k, seq, src, dst FROM decision WHERE confidence >= 0.85),
taken AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS source, NULL::VARCHAR AS target, MAP {{'': ''}} AS m
  UNION ALL SELECT k, seq, source, target, CASE WHEN source = target THEN m ELSE map_concat(m, MAP {{source: target}}) END FROM
    (SELECT turn.k, turn.seq, m, {HOP.format(x="src")} AS source, {HOP.format(x="dst")} AS target FROM taken JOIN turn ON turn.k = taken.k + 1))"""



def gathered(table: str, name: str) -> str:
    return f"(SELECT dataset_id AS id, array_to_string(list_sort(list(DISTINCT entity_id)), ',') AS {name} FROM {table} GROUP BY 1) {name}_ USING (id)"


RAW = "('  ' || upper(p_type) || '--' || p_name || '/' || p_brand)"
ORDER_RAW = (
    "CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d')"
    " WHEN 3 THEN '-' WHEN 4 THEN '9' ELSE '' END"
)
TERMS = "SELECT {k}, unnest(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) AS term FROM {t}"

FLAG = (
    f"cand AS (SELECT 'Topic' AS k, id, score FROM {found('topic', 'widget', 0.5)} UNION ALL SELECT 'Keyword', id, score FROM {found('keyword', 'widget', 0.5)})",
    f"links AS (SELECT dataset_id, entity_id FROM has_topic WHERE entity_id IN (SELECT id FROM cand WHERE k = 'Topic') AND dataset_id IN {HARD} UNION ALL SELECT dataset_id, entity_id FROM has_keyword WHERE entity_id IN (SELECT id FROM cand WHERE k = 'Keyword') AND dataset_id IN {HARD})",
    f"""parts_ AS (SELECT dataset_id, 'Topic' AS dim, max(score) * (0.3::DOUBLE / 1.0::DOUBLE) AS c, 0.3::DOUBLE AS w FROM links JOIN cand ON id = entity_id GROUP BY 1
      UNION ALL SELECT dataset_id, 'Space', {F1} * 0.2::DOUBLE, 0.2::DOUBLE FROM space WHERE dataset_id IN {HARD} AND {F1} > 0
      UNION ALL SELECT dataset_id, 'Time', {TF1} * 0.2::DOUBLE, 0.2::DOUBLE FROM time_ WHERE dataset_id IN {HARD} AND {TF1} > 0)""",
)
SQL: dict[str, str] = {
    "discover_flagship": graph(
        """SELECT dataset_id, score, rank FROM (SELECT dataset_id, score, rank() OVER (ORDER BY score DESC) AS rank FROM (
        SELECT dataset_id, round(total / (SELECT max(total) FROM sums), 6) AS score FROM sums WHERE dataset_id IN (SELECT dataset_id FROM links))) WHERE rank <= 20""",
        f"cand AS (SELECT 'Topic' AS k, id, score FROM {found('topic', 'widget', 0.5)} UNION ALL SELECT 'Keyword', id, score FROM {found('keyword', 'widget', 0.5)})",
        f"links AS (SELECT dataset_id, entity_id FROM has_topic WHERE entity_id IN (SELECT id FROM cand WHERE k = 'Topic') AND dataset_id IN {HARD} UNION ALL SELECT dataset_id, entity_id FROM has_keyword WHERE entity_id IN (SELECT id FROM cand WHERE k = 'Keyword') AND dataset_id IN {HARD})",
        f"""sums AS (SELECT dataset_id, sum(least(1.0, c)) AS total FROM (
          SELECT dataset_id, max(score) * (0.3::DOUBLE / 1.0::DOUBLE) AS c FROM links JOIN cand ON id = entity_id GROUP BY 1
          UNION ALL SELECT dataset_id, {F1} * 0.2::DOUBLE FROM space WHERE dataset_id IN {HARD} AND {F1} > 0
          UNION ALL SELECT dataset_id, {TF1} * 0.2::DOUBLE FROM time_ WHERE dataset_id IN {HARD} AND {TF1} > 0) GROUP BY 1)""",
    ),
    "raw_scores": graph("SELECT dataset_id, dim, round(c, 6) AS contribution, round(least(1.0::DOUBLE, c / w), 6) AS raw FROM parts_", *FLAG),
    "discover_fallback": graph("SELECT id AS dataset_id, 1.0::DOUBLE AS score, 1 AS rank FROM dataset WHERE contains(lower(title), 'not specified') OR contains(lower(notes), 'not specified') OR id IN (SELECT dataset_id FROM has_keyword WHERE contains(lower(entity_id), 'not specified')) ORDER BY id LIMIT 150"),
    "discover_rescue_with_box": graph(
        RANKED, f"""hits AS (SELECT id AS dataset_id FROM dataset WHERE contains(lower(title), 'not specified') OR contains(lower(notes), 'not specified')
          OR id IN (SELECT dataset_id FROM has_keyword WHERE contains(lower(entity_id), 'not specified')) ORDER BY id LIMIT 150)""",
        f"sums AS (SELECT dataset_id, sum(c) AS total FROM ({PLACED} UNION ALL SELECT dataset_id, 0.1::DOUBLE FROM hits WHERE dataset_id IN {HARD}) GROUP BY 1)",
    ),
    "discover_unknown_topic_with_box": graph(RANKED, f"sums AS (SELECT dataset_id, sum(c) AS total FROM ({PLACED}) GROUP BY 1)"),
    "discover_hard_only": graph("SELECT dataset_id, 1.0::DOUBLE AS score, 1 AS rank FROM provides WHERE entity_id = 'ASIA'"),
    "discover_portals": graph(
        f"""SELECT dataset_id, score, rank FROM (SELECT *, rank() OVER (ORDER BY score DESC) AS rank FROM (SELECT dataset_id, round(s / max(s) OVER (), 6) AS score FROM
        (SELECT dataset_id, max(score) * (0.3::DOUBLE / 1.0::DOUBLE) AS s FROM has_topic JOIN {found('topic', 'widget', 0.5)} f ON f.id = entity_id WHERE dataset_id IN (SELECT dataset_id FROM provides WHERE entity_id IN ('ASIA', 'EUROPE')) GROUP BY 1))) WHERE rank <= 20"""
    ),
    "bundle_full": graph(
        """SELECT id, title, coalesce(topics, '') AS topics, coalesce(keywords, '') AS keywords, coalesce(organizations, '') AS organizations, coalesce(licenses, '') AS licenses, coalesce(sources, '') AS sources,
        coalesce(spaces, '') AS spaces, coalesce(times, '') AS times, coalesce(resources, '') AS resources, coalesce(formats, '') AS formats,
        title || '.' || CASE WHEN coalesce(sources, '') <> '' THEN ' ' || sources || '.' ELSE '' END || CASE WHEN coalesce(times, '') <> '' THEN ' ' || times || '.' ELSE '' END AS citation FROM dataset d LEFT JOIN """
        + " LEFT JOIN ".join(gathered(t, n) for t, n in (
            ("has_topic", "topics"), ("has_keyword", "keywords"), ("published_by", "organizations"), ("has_license", "licenses"), ("provides", "sources"),
            ("(SELECT dataset_id, concat_ws(' ', west::BIGINT, south::BIGINT, east::BIGINT, north::BIGINT) AS entity_id FROM space)", "spaces"), ("(SELECT dataset_id, begin_ || '/' || end_ AS entity_id FROM time_)", "times"),
            ("(SELECT dataset_id, resource_id AS entity_id FROM has_resource)", "resources"), ("(SELECT dataset_id, entity_id FROM has_resource JOIN has_format USING (resource_id))", "formats"),
        ))
    ),
    "bbox_filter": graph(f"SELECT dataset_id FROM space WHERE {BOXED}"),
    "bbox_clustered": graph(f"SELECT dataset_id FROM space WHERE {BOXED}"),
    "time_overlap_filter": graph(f"SELECT dataset_id FROM time_ WHERE {SPANNED}"),
    "bbox_time_filter": graph(f"SELECT dataset_id FROM {HARD}"),
    "source_filter": graph("SELECT dataset_id FROM provides WHERE entity_id IN ('ASIA', 'EUROPE')"),
    "hard_intersect": graph(f"SELECT dataset_id FROM {HARD} WHERE dataset_id IN (SELECT dataset_id FROM provides WHERE entity_id = 'ASIA')"),
    "bbox_range_join": graph("SELECT q.dataset_id AS query_id, count(*) AS hits, sum(s.dataset_id)::BIGINT AS sum_id FROM space q JOIN space s ON q.dataset_id % 100 = 0 AND s.west <= q.east AND s.east >= q.west AND s.south <= q.north AND s.north >= q.south GROUP BY 1"),
    "wgs84_validity": graph("SELECT dataset_id, west BETWEEN -180 AND 180 AND east BETWEEN -180 AND 180 AND south BETWEEN -90 AND 90 AND north BETWEEN -90 AND 90 AS valid, west * 1.2::DOUBLE BETWEEN -180 AND 180 AND east BETWEEN -180 AND 180 AND south BETWEEN -90 AND 90 AND north BETWEEN -90 AND 90 AND west * 1.2::DOUBLE <= east AND south <= north AS valid_strict FROM space"),
    "expand_topic": graph(f"SELECT dataset_id, entity_id FROM has_topic WHERE contains(lower(entity_id), 'widget') AND dataset_id IN (SELECT dataset_id FROM space WHERE {BOXED})"),
    "expand_keyword": graph("SELECT dataset_id, entity_id FROM has_keyword WHERE contains(lower(entity_id), '#2')"),
    "expand_format": graph("SELECT DISTINCT dataset_id, entity_id FROM has_resource JOIN has_format USING (resource_id) WHERE contains(entity_id, 'r-')"),
    "expand_license": graph("SELECT dataset_id, entity_id FROM has_license WHERE contains(lower(entity_id), 'urgent')"),
    "expand_org": graph("SELECT dataset_id, entity_id FROM published_by JOIN organization ON id = entity_id WHERE contains(lower(name), '0001')"),
    "expand_source": graph("SELECT dataset_id, entity_id FROM provides WHERE entity_id IN ('AFRICA', 'AMERICA')"),
    "space_time_outer": graph('SELECT d.id AS dataset_id, west, south, east, north, begin_ AS "begin", end_ AS "end" FROM dataset d LEFT JOIN space s ON s.dataset_id = d.id LEFT JOIN time_ t ON t.dataset_id = d.id'),
    "name_contains_score": graph(f"SELECT id, score FROM {found('topic', 'Red')}"),
    "lexical_score": graph("""SELECT id, round(least(1.0::DOUBLE, len(list_intersect(q, c)) / len(list_distinct(q || c))::DOUBLE + CASE WHEN starts_with(name, 'red widget new') OR starts_with('red widget new', name) THEN 0.2 WHEN contains(name, 'red widget new') OR contains('red widget new', name) THEN 0.15 ELSE 0.0 END::DOUBLE), 6) AS score
        FROM (SELECT id, name, string_split(name, ' ') AS c, ['red', 'widget', 'new'] AS q FROM topic)"""),
    "token_jaccard": graph("SELECT canonical, round(len(list_intersect(string_split(canonical, ' '), ['economy', 'red', 'widget'])) / len(list_distinct(string_split(canonical, ' ') || ['economy', 'red', 'widget']))::DOUBLE, 6) AS score FROM (SELECT DISTINCT canonical FROM pending)"),
    "pending_names_alike": graph(
        "SELECT a, b, round(jaro + front * 0.1::DOUBLE * (1 - jaro), 6) AS score FROM jaro WHERE round(jaro + front * 0.1::DOUBLE * (1 - jaro), 6) >= 0.8::DOUBLE",
        "hit AS (SELECT DISTINCT canonical, topic.id AS topic FROM pending, topic)", JARO, recursive=True,
    ),
    "jaro_winkler_gate": graph("SELECT a.name AS a, b.name AS b, round(jaro_winkler_similarity(a.name, b.name), 6) AS score FROM topic a JOIN topic b ON a.name < b.name WHERE round(jaro_winkler_similarity(a.name, b.name), 6) >= 0.9"),
    "cosine_topk": "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10",
    "cosine_topk_per_query": f"WITH {NEAR} SELECT query_id, vec_id, score, rank::INT AS rank FROM near",
    "bm25_topk": f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM ({TERMS.format(k='doc_id', t='documents')}) WHERE term <> '' GROUP BY ALL),
        asked AS (SELECT DISTINCT item_id AS query_id, term FROM ({TERMS.format(k='item_id', t='benchmark')}) WHERE term <> ''),
        len_ AS (SELECT doc_id, sum(tf)::DOUBLE AS n FROM tf GROUP BY 1), stat AS (SELECT count(*) AS n_docs, avg(n) AS mean FROM len_),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score
          FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN len_ USING (doc_id), stat GROUP BY 1, 2)
        SELECT query_id, doc_id, score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5""",
    "topic_fulltext": graph(
        "SELECT query_id, id AS topic, score FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 8",
        fulltext("SELECT id, name AS text, 'name' AS field, 2.0::DOUBLE AS weight FROM topic UNION ALL SELECT id, name, 'canonical', 1.5 FROM topic UNION ALL SELECT id, array_to_string(list_reverse(string_split(name, ' ')), ' '), 'aliases', 1.0 FROM topic",
                 "SELECT DISTINCT canonical AS query_id, canonical AS text FROM pending"),
    ),
    "dataset_fulltext": graph(
        "SELECT query_id, id, score FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10",
        "kw AS (SELECT dataset_id AS id, array_to_string(list_sort(list(DISTINCT entity_id)), ' ') AS keywords FROM has_keyword GROUP BY 1)",
        fulltext("SELECT id, title AS text, 'title' AS field, 2.0::DOUBLE AS weight FROM dataset UNION ALL SELECT id, notes, 'notes', 1.0 FROM dataset UNION ALL SELECT id, keywords, 'keywords', 1.5 FROM kw",
                 "SELECT id AS query_id, concat_ws(' ', string_split(title, '-')[-1], coalesce(keywords, '')) AS text FROM dataset LEFT JOIN kw USING (id) WHERE id % 100 = 0"),
    ),
    "dataset_text_search": graph("SELECT id, title FROM dataset WHERE contains(lower(title), 'urgent') AND id IN (SELECT dataset_id FROM has_keyword WHERE contains(lower(entity_id), 'brand#11')) OR contains(lower(notes), 'zz') ORDER BY id LIMIT 150"),
    "bbox_f1": graph(f"SELECT dataset_id, round({F1}, 6) AS f1 FROM space"),
    "time_f1": graph(f"SELECT dataset_id, round({TF1}, 6) AS f1 FROM time_"),
    "dim_max_contrib": graph(f"SELECT dataset_id, 'Topic' AS dim, round(max(score) * 0.3::DOUBLE, 6) AS contribution FROM {LINKS} GROUP BY 1"),
    "capped_sum_norm": graph(
        "SELECT dataset_id, round(total, 6) AS total, round(total / (SELECT max(total) FROM sums), 6) AS score FROM sums",
        f"sums AS (SELECT dataset_id, sum(least(1.0::DOUBLE, c)) AS total FROM (SELECT dataset_id, max(score) * 3.0::DOUBLE AS c FROM {LINKS} GROUP BY 1 UNION ALL SELECT dataset_id, max(score) * 0.5::DOUBLE FROM has_license JOIN {found('license', 'low')} f ON f.id = entity_id GROUP BY 1) GROUP BY 1)",
    ),
    "missing_similarity_default": graph(f"SELECT dataset_id, 'Topic' AS dim, round(max(coalesce(score, 0.5::DOUBLE)) * 0.3::DOUBLE, 6) AS contribution FROM has_topic LEFT JOIN {found('topic', 'red', 0.5)} f ON f.id = entity_id GROUP BY 1"),
    "union_dim_filter": graph("SELECT dataset_id FROM has_topic WHERE contains(entity_id, 'hot widget') UNION SELECT dataset_id FROM has_license WHERE contains(lower(entity_id), 'urgent')"),
    "fallback_lexical": graph("SELECT id AS dataset_id, 'Topic' AS dim, 0.1::DOUBLE AS contribution FROM dataset WHERE contains(lower(title), 'not specified') ORDER BY id LIMIT 150"),
    "hardfilter_only": graph(f"SELECT dataset_id, 1.0::DOUBLE AS score FROM {HARD}"),
    "top20_ties": "SELECT o_orderkey AS id, round(o_totalprice, -4) AS score FROM orders QUALIFY rank() OVER (ORDER BY round(o_totalprice, -4) DESC) <= 20",
    "topk_unique_ties": "SELECT id, score FROM (SELECT l_suppkey AS id, max(round(l_extendedprice, -3)) AS score FROM lineitem GROUP BY 1) QUALIFY rank() OVER (ORDER BY score DESC) <= 10",
    "topk_per_group": "SELECT o_orderstatus, o_orderkey, o_totalprice, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey))::INT AS rank FROM orders QUALIFY rank <= 3",
    "candidate_top10": graph(f"SELECT id, max(score) AS score FROM (SELECT * FROM {found('topic', 'red')} UNION ALL SELECT * FROM {found('topic', 'widget')}) WHERE score > 0.3 GROUP BY 1 ORDER BY score DESC, id LIMIT 10"),
    "candidate_union": graph(f"SELECT id, 'Topic' AS label, score FROM {found('topic', 'red')} UNION ALL SELECT id, 'Keyword', score FROM {found('keyword', 'brand#1')}"),
    "group_chunks": graph("""SELECT id, grp AS "group", prefix, ((row_number() OVER (PARTITION BY grp, prefix ORDER BY id) - 1) // 24)::INT AS chunk FROM (SELECT id, grp, CASE WHEN count(*) OVER (PARTITION BY grp) > 24 THEN substr(id, 1, 6) ELSE '' END AS prefix FROM (SELECT DISTINCT canonical AS id, substr(canonical, 1, 3) AS grp FROM pending))"""),
    "pending_freq": graph(f"SELECT canonical, freq FROM {FREQ}"),
    "seed_topics": graph(f"SELECT canonical, freq FROM {FREQ} ORDER BY freq DESC, canonical LIMIT 2000"),
    "resolve_exact": graph("SELECT canonical, freq, id AS topic FROM (SELECT canonical, count(DISTINCT dataset_id) AS freq FROM (SELECT entity_id AS canonical, dataset_id FROM has_topic UNION ALL SELECT canonical, dataset_id FROM pending) GROUP BY 1) JOIN topic ON id = canonical"),
    "similar_topics": graph("SELECT canonical, topic, round(jaccard, 6) AS jaccard FROM alike", SIMILAR),
    "resolve_actions": graph("SELECT canonical, freq, topic, action FROM resolved", SIMILAR, RESOLVED, recursive=True),
    "resolves_to": graph("SELECT canonical, coalesce(topic, canonical) AS topic FROM resolved", SIMILAR, RESOLVED, recursive=True),
    "materialize_has_topic": graph("SELECT DISTINCT dataset_id, coalesce(topic, canonical) AS topic_id FROM pending JOIN resolved USING (canonical)", SIMILAR, RESOLVED, recursive=True),
    "topic_merge_states": graph(
        """SELECT k.id, coalesce(g.canonical, k.canonical) AS canonical, status, merged_into FROM kept k LEFT JOIN
        (SELECT canonical, min(id) AS id FROM (SELECT id, string_split(canonical, ' ')[1] AS canonical FROM kept WHERE status = 'ACTIVE') WHERE canonical NOT IN (SELECT canonical FROM kept) GROUP BY 1) g USING (id)""",
        FINAL, "kept AS (SELECT id, id AS canonical, CASE WHEN dst IS NULL THEN 'ACTIVE' ELSE 'DEPRECATED' END AS status, dst AS merged_into FROM topic LEFT JOIN (SELECT * FROM final WHERE src <> dst) f ON src = id)", recursive=True,
    ),
    "topic_components": graph(
        """SELECT id, grp AS "group", size FROM grouped JOIN (SELECT grp, count(*) AS size FROM grouped GROUP BY 1) USING (grp) WHERE size >= 2""",
        """c AS (SELECT DISTINCT canonical AS id, string_split(canonical, ' ') AS w FROM pending)""",
        """keyed AS (SELECT id, 'canon|' || id AS key FROM c UNION SELECT id, 'name|' || array_to_string(w[:-3], ' ') FROM c WHERE len(w) > 2 UNION SELECT id, 'alias|' || array_to_string(w[-2:], ' ') FROM c
        UNION SELECT id, 'p3|' || substr(id, 1, 3) FROM c UNION SELECT id, 'p6|' || substr(id, 1, 6) FROM c UNION SELECT id, 'sig|' || array_to_string(list_sort(w), '_') FROM c WHERE len(w) BETWEEN 2 AND 8)""",
        """beside AS (SELECT DISTINCT a.id, b.id AS other FROM keyed a JOIN keyed b USING (key))""",
        "reach AS (SELECT id, other FROM beside UNION SELECT r.id, b.other FROM reach r JOIN beside b ON b.id = r.other)",
        "grouped AS (SELECT id, min(other) AS grp FROM reach GROUP BY 1)",
        recursive=True,
    ),
    "topic_merges_ordered": graph(
        """SELECT seq, 'low' AS outcome, NULL AS source, NULL AS target FROM decision WHERE confidence < 0.85 UNION ALL
        SELECT seq, CASE WHEN source = target THEN 'same' ELSE 'merged' END, CASE WHEN source <> target THEN source END, CASE WHEN source <> target THEN target END FROM taken WHERE k > 0""",
        TURNS, recursive=True,
    ),
    "conversation_states": f"WITH {MESSAGES}, {NOW} {STATES}",
    "conversation_states_stream": f"WITH {MESSAGES}, {NOW} {STATES}",
    "statuses_delivered": f"""WITH {MESSAGES} SELECT conv_id, at_ AS "at", seq, name, value FROM (SELECT *, last_value(CASE WHEN kind IN ('subscribe', 'unsubscribe') THEN kind END IGNORE NULLS)
      OVER (PARTITION BY conv_id, visit ORDER BY at_, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS feed FROM counted) WHERE kind = 'status' AND feed = 'subscribe'""",
    "conversation_turns_sink": "SELECT conv_id AS conversation_id, (turn // 4 + 1)::INT AS question_index, turn::INT AS turn_index, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE turn >= 1",
    "merge_redirects": graph("SELECT src, dst FROM final WHERE src <> dst", FINAL, recursive=True),
    "apply_merge_redirect": graph("SELECT DISTINCT dataset_id, coalesce(dst, entity_id) AS entity_id FROM has_topic LEFT JOIN final ON src = entity_id", FINAL, recursive=True),
    "alias_union": graph("SELECT id, array_to_string(list_sort(list(DISTINCT a)), ',') AS aliases FROM (SELECT coalesce(dst, id) AS id, upper(name) AS a FROM topic LEFT JOIN final ON src = id UNION SELECT dst, name FROM topic JOIN final ON src = id) GROUP BY 1", FINAL, recursive=True),
    "upsert_last_wins": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1",
    "upsert_keep_old": graph("SELECT id, CASE WHEN id < '3' AND id <> '1-URGENT' THEN lower(name) ELSE name END AS title FROM license"),
    "bundle_join": graph("SELECT id, title, coalesce(topics, '') AS topics, coalesce(keywords, '') AS keywords, coalesce(organizations, '') AS organizations, coalesce(licenses, '') AS licenses, coalesce(sources, '') AS sources FROM dataset d LEFT JOIN " + " LEFT JOIN ".join(gathered(t, n) for t, n in (("has_topic", "topics"), ("has_keyword", "keywords"), ("published_by", "organizations"), ("has_license", "licenses"), ("provides", "sources")))),
    "subgraph_edges": graph("SELECT edge_id, src, type, dst FROM edges", EDGES),
    "subgraph_nodes": graph("SELECT node, string_split(node, ':')[1] AS label FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)", EDGES),
    "subgraph_filter": graph(
        """SELECT e.edge_id, e.src, e.type, e.dst FROM edges e SEMI JOIN kept ON kept.node = e.src
        UNION SELECT e.edge_id, e.src, e.type, e.dst FROM edges e SEMI JOIN (SELECT r.dst FROM edges r SEMI JOIN kept ON kept.node = r.src WHERE r.type = 'HAS_RESOURCE') h ON h.dst = e.src WHERE e.type = 'HAS_FORMAT'""",
        EDGES.replace("edges AS (", "edges AS MATERIALIZED (", 1), f"kept AS (SELECT 'Dataset:' || dataset_id AS node FROM {HARD})",
    ),
    "resource_formats": graph("SELECT resource_id, array_to_string(list_sort(list(DISTINCT entity_id)), ',') AS formats FROM has_format GROUP BY 1"),
    "canonicalize_topic": f"SELECT p_partkey, trim(regexp_replace(lower({RAW}), '[^a-z0-9]+', ' ', 'g')) AS topic, trim(regexp_replace(lower({RAW}), '[^a-z0-9_/-]+', ' ', 'g')) AS keyword, trim(regexp_replace(lower({RAW}), '[ \\t\\n]+', ' ', 'g')) AS format FROM part",
    "url_normalize": "SELECT page_id, regexp_replace(url || '//', '/+$', '') AS url, CASE WHEN contains(lower(url), 'fullmetadatadisplay.aspx') THEN 'metadata' WHEN contains(lower(url), 'download') THEN 'download' WHEN contains(lower(url), 'preview') THEN 'preview' WHEN regexp_matches(lower(url), 'mapserver|featureserver|imageserver') THEN 'service' ELSE 'link' END AS type FROM pages",
    "format_from_url": "SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'ZIP' WHEN 1 THEN 'CSV' WHEN 2 THEN 'GeoJSON' WHEN 3 THEN 'GeoTIFF' WHEN 4 THEN 'WMS' WHEN 5 THEN 'ArcGIS REST' ELSE 'UNKNOWN' END AS format FROM pages",
    "html_to_text": """SELECT page_id, length(t) AS n, sha1(t) AS sha1 FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<(?:br|hr)\\s*/?>|</(?:p|div|dt|dd|li|h[1-6]|pre)>|<pre[^>]*>', chr(10), 'gi'), '<[^>]+>', '', 'gs'),
        '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '[\\t\\x0B\\f\\r\\n]+', chr(10), 'g'), ' ' || chr(10)) AS t FROM pages)""",
    "extract_links": """SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']*)["'']', 1), lambda x: replace(trim(x), '&amp;', '&')), lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(lower(x), 'javascript:')), ' ') AS links FROM pages""",
    "temporal_normalize": f"""SELECT id, CASE WHEN length(r) = 4 THEN r || '0101 00:00:00' WHEN length(r) = 7 THEN replace(r, '-', '') || '01 00:00:00' WHEN length(r) = 8 THEN r || ' 00:00:00' WHEN r = '9' THEN '99991231 00:00:00' ELSE '00010101 00:00:00' END AS "begin",
        CASE WHEN length(r) = 4 THEN r || '1231 00:00:00' WHEN length(r) = 7 THEN strftime(last_day((r || '-01')::DATE), '%Y%m%d') || ' 00:00:00' WHEN length(r) = 8 THEN r || ' 00:00:00' ELSE '99991231 00:00:00' END AS "end" FROM (SELECT o_orderkey AS id, {ORDER_RAW} AS r FROM orders)""",
    "bbox_wkt_centroid": graph("SELECT dataset_id, 'POLYGON((' || w || ' ' || s || ', ' || e || ' ' || s || ', ' || e || ' ' || n || ', ' || w || ' ' || n || ', ' || w || ' ' || s || '))' AS wkt, round((west + east) / 2, 6) AS lon, round((south + north) / 2, 6) AS lat FROM (SELECT *, west::BIGINT AS w, south::BIGINT AS s, east::BIGINT AS e, north::BIGINT AS n FROM space)"),
    "parse_box_text": graph("SELECT dataset_id, west, south, east, north FROM space"),
    "stable_ids_sha1": graph("SELECT id, 'lic:' || sha1(lower(name)) AS license_id, 'kw:' || sha1(lower(name) || '|' || id) AS keyword_id FROM license"),
    "kv_to_map": """SELECT l_orderkey, max(v) FILTER (k = 'A') AS a, max(v) FILTER (k = 'N') AS n, max(v) FILTER (k = 'R') AS r FROM (SELECT l_orderkey, l_returnflag AS k, l_linestatus AS v FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey DESC, l_suppkey DESC, l_linestatus DESC) = 1) GROUP BY 1""",
    "token_signatures": graph("SELECT canonical, CASE WHEN len(string_split(canonical, ' ')) BETWEEN 2 AND 8 THEN array_to_string(list_sort(string_split(canonical, ' ')), '_') ELSE '' END AS sig FROM (SELECT DISTINCT canonical FROM pending)"),
    "turn_index_next": "SELECT conv_id, (max(turn) + 1)::BIGINT AS next_turn FROM conversations GROUP BY 1",
    "conversation_preview": "SELECT conv_id, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS preview FROM (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1)",
    "recent_turns": "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS recent FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2) GROUP BY 1",
    "last_assistant_turn": "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1",
    "question_completed": "SELECT conv_id, bool_or(role = 'assistant' AND conv_id % 5 <> 0 AND (turn % 2 = 1 OR turn = 4)) AS completed FROM conversations GROUP BY 1",
    "stage_durations": f"WITH {FEED} SELECT session, stage, status, micros, stop FROM dur",
    "stage_durations_total": f"WITH {FEED} SELECT session, sum(micros)::BIGINT AS micros, count(*) AS n FROM dur WHERE micros > 0 GROUP BY 1",
    "pipeline_states": f"""WITH {FEED}, names AS (SELECT unnest(['intent', 'normalise', 'match', 'filter', 'score', 'evidence', 'select', 'answer']) AS name, unnest(range(8)) AS stage),
        closed AS (SELECT session, stage, arg_max(status, (at_, event_id)) AS status FROM feed WHERE status <> 'active' GROUP BY 1, 2), took AS (SELECT session, stage, arg_max(micros, stop) AS micros FROM dur GROUP BY 1, 2)
        SELECT session, stage, name, coalesce(status, 'pending') AS status, micros FROM (SELECT DISTINCT session FROM feed) CROSS JOIN names LEFT JOIN closed USING (session, stage) LEFT JOIN took USING (session, stage)""",
    "session_state_latest": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    "status_counts": "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS done FROM events",
    "ndcg_at_10": f"WITH {JUDGED} SELECT query_id, round(ndcg, 6) AS ndcg FROM ndcg",
    "recall_at_20": f"WITH {JUDGED} SELECT q.vec_id AS query_id, round(coalesce(hits, 0) / total::DOUBLE, 6) AS recall FROM embeddings q JOIN (SELECT label, count(*) - 1 AS total FROM embeddings GROUP BY 1) USING (label) LEFT JOIN (SELECT query_id, count(*) AS hits FROM judged WHERE rel > 0 GROUP BY 1) j ON j.query_id = q.vec_id WHERE q.vec_id % 100 = 0",
    "mean_by_level": f"WITH {JUDGED} SELECT 'Level ' || (query_id // 100 % 4 + 1) AS level, round(avg(ndcg), 6) AS ndcg FROM ndcg GROUP BY 1",
}
SQL["stage_durations_stream"] = SQL["stage_durations"]
