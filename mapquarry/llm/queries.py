"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, embdedup, exactdup, html, langid, mixing, packing, pii, quality, simhash, turns, urlrep

TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def residue(n: int):
    """CRC-32 of the doc_id's decimal text modulo ``n``; held-out folds are named by it. Null for a null id, which trains nothing."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"))


def op2_block_rules_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op3_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs, residue(4) != 2)
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (residue(4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        F.col("lang_ambiguous").alias("ambiguous"),
    )


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.select("doc_id", "quality"), residue(5) != 0)
    return quality.score(docs, model).select("doc_id", (residue(5) == 0).alias("held_out"), "score", "predicted")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcome of each page whose document (the number in its path) is labelled: bad if of low quality or toxic."""
    bad = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    number = F.regexp_extract(urlrep.path_of(F.col("url")), r"/([0-9]{1,18})(?:[./]|$)", 1)
    numbered = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id"))
    return numbered.join(bad, "doc_id").select("url", "bad")


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels")
    return urlrep.filter_urls(pages, page_outcomes(pages, labels)).select("page_id", "host", "path", "rule", "verdict")


def op8_extendible_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_suffix_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_viterbi_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damage(_table(spark, sf_dir, "conversations")))


def op13_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_feistel_pseudonyms, op2_block_rules_text, op3_simhash_pigeonhole, op4_pca_tiles, op5_ecoc_language, op6_pu_quality,
        op7_host_reputation, op8_extendible_hash, op9_mix_sources, op10_window_packing, op11_suffix_collocations, op12_viterbi_turns, op13_merge_replay,
    )
}

# ---- SQL of the operators that it can express ---------------------------------------------------

_ADDRESS = r"regexp_matches(key, '^(?:[0-9]+(?:\.[0-9]+){3}|\[.*)$')"
_TWO = rf"regexp_matches(key, '(?:^|\.)(?:{'|'.join(urlrep.SECOND_LEVEL)})\.[a-z][a-z]$')"


def _last(n: int) -> str:
    return f"array_to_string(string_split(key, '.')[-{n}:], '.')"


_DOMAIN = f"CASE WHEN {_ADDRESS} THEN key WHEN {_TWO} THEN {_last(3)} ELSE {_last(2)} END"
_SUFFIX = f"CASE WHEN {_ADDRESS} THEN '' WHEN {_TWO} THEN {_last(2)} ELSE {_last(1)} END"
#: Share of a beta distribution with mean and strength below x: the series of the incomplete beta function.
_BELOW = """list_sum(list_transform(range(0, 4000), lambda i: exp(lgamma(strength + i) - lgamma(mean * strength + 1 + i)
      - lgamma((1 - mean) * strength) + (mean * strength + i) * ln(x) + (1 - mean) * strength * ln(1 - x))))"""


def _strength(level: str) -> str:
    """Method of moments over a level's rows with n, bad and prior mean m."""
    return f"""(SELECT CASE WHEN x IS NULL OR x <= 0 THEN {urlrep.DEFAULT} WHEN d - v <= 0 THEN {urlrep.STRONGEST}
      ELSE greatest({urlrep.WEAKEST}, least({urlrep.STRONGEST}, x / (d - v) - 1)) END::DOUBLE FROM
      (SELECT sum(n * (bad / n - m) * (bad / n - m)) AS d, sum(m * (1 - m)) AS v, sum(m * (1 - m) * (n - 1)) AS x FROM {level} WHERE n > 1))"""


def _rule(case: str) -> str:
    ordered = sorted(urlrep.RULES, key=lambda r: (-len(r[0]) - len(r[1]), r))
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    return "CASE " + " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{h + p if case == 'rule' else a}'" for h, p, a in ordered) + " END"


SQL: dict[str, str] = {
    "op4_pca_tiles": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
      links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {embdedup.COSINE}),
      reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
      SELECT a AS vec_id, (SELECT count(*) FROM links l WHERE l.a = r.a) AS n_links, min(b) AS component_id, a = min(b) AS kept FROM reach r GROUP BY a""",
    "op7_host_reputation": rf"""WITH u AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(?::[0-9]*)?$', '') AS key FROM
        (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)),
      bad AS (SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY 1),
      h AS (SELECT key, count(*) AS n, sum(bad) AS bad FROM (SELECT key, try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[./]|$)', 1) AS BIGINT) AS doc_id FROM u) JOIN bad USING (doc_id) WHERE bad IS NOT NULL GROUP BY 1),
      o AS (SELECT *, {_DOMAIN} AS domain, {_SUFFIX} AS suffix FROM h),
      root AS (SELECT ((sum(bad) + 1) / (sum(n) + 2))::DOUBLE AS m FROM o),
      s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT m FROM root) AS m FROM o GROUP BY 1),
      s1 AS (SELECT *, (bad + s * m) / (n + s) AS mean FROM (SELECT *, {_strength('s0')} AS s FROM s0)),
      d0 AS (SELECT domain, sum(o.n) AS n, sum(o.bad) AS bad, s1.mean AS m FROM o JOIN s1 USING (suffix) GROUP BY domain, suffix, s1.mean),
      d1 AS (SELECT *, (bad + s * m) / (n + s) AS mean FROM (SELECT *, {_strength('d0')} AS s FROM d0)),
      h0 AS (SELECT key, o.n, o.bad, d1.mean AS m FROM o JOIN d1 USING (domain)),
      h1 AS (SELECT key, (bad + s * m) / (n + s) AS mean, n + s AS strength FROM (SELECT *, {_strength('h0')} AS s FROM h0)),
      b0 AS (SELECT DISTINCT key FROM u WHERE key NOT IN (SELECT key FROM h)),
      b1 AS (SELECT key, {_DOMAIN} AS domain, {_SUFFIX} AS suffix FROM b0),
      b2 AS (SELECT key, coalesce(d1.mean, s1.mean, root.m) AS mean,
        1 / ({_strength('h0')} + 1) + CASE WHEN d1.mean IS NULL THEN 1 / ({_strength('d0')} + 1) ELSE 0 END + CASE WHEN d1.mean IS NULL AND s1.mean IS NULL THEN 1 / ({_strength('s0')} + 1) ELSE 0 END AS unsure
        FROM b1 LEFT JOIN d1 USING (domain) LEFT JOIN s1 USING (suffix), root),
      p AS (SELECT key, mean::DOUBLE AS mean, strength::DOUBLE AS strength FROM h1 UNION ALL SELECT key, mean, 1 / unsure - 1 FROM b2),
      z AS (SELECT key, {_BELOW} AS below FROM p, (SELECT {urlrep.WORSE}::DOUBLE * m / (1 - m + {urlrep.WORSE}::DOUBLE * m) AS x FROM root))
      SELECT page_id, host, path, {_rule('rule')} AS rule, coalesce({_rule('action')}, CASE WHEN below < {urlrep.TAIL}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
      FROM u LEFT JOIN z USING (key)""",
    "op8_extendible_hash": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
      SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size, row_number() OVER w = 1 AS kept, sha256(n) AS text_sha256
      FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)""",
    "op9_mix_sources": r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
      s AS (SELECT *, CASE (at_ - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS at_ FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1))),
      l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM s
        WINDOW b AS (ORDER BY source_size / weight, at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      z AS (SELECT arg_min(level, (source_size / weight, at_)) FILTER (level * weight <= 2.0::DOUBLE * source_size) AS level FROM l),
      t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(z.level * weight, 2.0::DOUBLE * source_size)) AS target FROM l, z),
      r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
      SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate))::BIGINT) AS taken FROM r""",
    "op11_suffix_collocations": rf"""WITH p AS (SELECT coalesce(lang, '{collocations.UNKNOWN}') AS lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
      w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda x: x <> '') AS t FROM p),
      g AS (SELECT lang, k, unnest(list_transform(range(1, len(t) - k + 2), lambda i: array_to_string(t[i : i + k - 1], ' '))) AS phrase FROM w, range(1, {collocations.MOST + 1}) AS r(k) WHERE len(t) >= k),
      f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
      n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
      often AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS t FROM f WHERE f >= {collocations.LEAST}),
      cuts AS (SELECT lang, k, phrase, f AS a, c, array_to_string(t[: c], ' ') AS head, array_to_string(t[c + 1 :], ' ') AS rest FROM often, range(1, {collocations.MOST}) AS r(c) WHERE c < k),
      z AS (SELECT cuts.*, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM cuts JOIN often x ON x.lang = cuts.lang AND x.phrase = head
        JOIN often y ON y.lang = cuts.lang AND y.phrase = rest JOIN n ON n.lang = cuts.lang),
      best AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
      inner_ AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, unnest(list_transform(range(1, k - v + 2), lambda i: array_to_string(t[i : i + v - 1], ' '))) AS phrase FROM often, range(2, {collocations.MOST}) AS r(v) WHERE v < k) GROUP BY ALL),
      kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE coalesce(100 * longer < 100 * a, true))
      SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= {collocations.TOP}""",
}
