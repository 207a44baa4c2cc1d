"""The contract queries of the operators and their SQL; each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from traceloom.llm import exact_recipes, feature_digest, language, mixing, near_dup, packing, page_diff, suffix_dedup, token_files, url_reputation
from traceloom.llm.common import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_reputation.judge(pages, url_reputation.labelled_outcomes(pages, table(spark, sf_dir, "labels")))


def op2_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract(table(spark, sf_dir, "pages"))


def op4_exact_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_recipes.exact_groups(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_documents(token_files.write_blocks(table(spark, sf_dir, "documents"), Scratch(spark, "tokens")))


def op6_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(table(spark, sf_dir, "documents"), size=3, percent=85)


def op8_feature_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_digest.fingerprints(table(spark, sf_dir, "documents"))


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest_rows(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    "op1_url_reputation": op1_url_reputation,
    "op2_language_families": op2_language_families,
    "op3_page_diff": op3_page_diff,
    "op4_exact_recipes": op4_exact_recipes,
    "op5_token_files": op5_token_files,
    "op6_temperature_mix": op6_temperature_mix,
    "op7_near_groups": op7_near_groups,
    "op8_feature_digest": op8_feature_digest,
    "op9_pattern_packing": op9_pattern_packing,
    "op10_suffix_dedup": op10_suffix_dedup,
}


def _op1_sql() -> str:
    u = url_reputation
    lower = f"'{u.UPPER}', '{u.LOWER}'"

    def rho(level: str) -> str:
        spread = "(P - K / N * K) / nullif(K / N * (1 - K / N), 0) - (J - 1)"
        rho = f"least(greatest(coalesce(({spread}) / nullif(N - S / N - (J - 1), 0), CASE WHEN N IS NULL THEN {u.MAX_RHO} ELSE {u.MIN_RHO} END), {u.MIN_RHO}), {u.MAX_RHO})"
        sums = "sum(n)::DOUBLE N, sum(k)::DOUBLE K, count(*)::DOUBLE J, sum(n::DOUBLE * n) S, sum(k::DOUBLE * k / n) P"
        return f"SELECT (1 - r) / r AS m, mu FROM (SELECT {rho} AS r, coalesce((K + 0.5) / (N + 1), 0.5) AS mu FROM (SELECT {sums} FROM {level}))"

    fits = lambda rule: f"(host = '{rule.split('/', 1)[0]}' OR ends_with(host, '.{rule.split('/', 1)[0]}')) AND starts_with(path, '/{rule.split('/', 1)[1]}')"
    ordered = sorted(u.RULES, key=lambda r: (-len(r[0]), r[0]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in ordered) + " ELSE own END"
    name = f"regexp_extract(host, '{u.NAME_RE}', 1)"
    address = f"regexp_matches({name}, '{u.ADDRESS_RE}')"
    domain = f"CASE WHEN regexp_extract({name}, '{u.DOMAIN_RE}', 1) = '' OR {address} THEN {name} ELSE regexp_extract({name}, '{u.DOMAIN_RE}', 1) END"
    suffix = f"CASE WHEN {address} THEN '' ELSE regexp_extract({name}, '{u.SUFFIX_RE}', 1) END"
    return f"""
WITH urls AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{u.HOST_RE}', 1), {lower}) AS host,
                     regexp_extract(coalesce(url, ''), '{u.PATH_RE}', 1) AS path FROM pages),
marks AS (SELECT doc_id, max(coalesce(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END, 0)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, {domain} AS domain, {suffix} AS suffix, count(*) AS n, sum(bad) AS k
          FROM urls JOIN marks ON try_cast(regexp_extract(path, '^/[^/]+/([0-9]+)', 1) AS BIGINT) = doc_id GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
mh AS ({rho("hosts")}), md AS ({rho("domains")}), ms AS ({rho("suffixes")}),
sm AS (SELECT suffix, (k + m * mu) / (n + m) AS s_mean FROM suffixes, ms),
dm AS (SELECT domain, (k + m * s_mean) / (n + m) AS d_mean FROM domains JOIN sm USING (suffix), md),
seen AS (SELECT DISTINCT host, {domain} AS domain, {suffix} AS suffix FROM urls),
post AS (SELECT seen.host, coalesce(k, 0) + m * coalesce(d_mean, s_mean, mu) AS a, coalesce(n, 0) - coalesce(k, 0) + m * (1 - coalesce(d_mean, s_mean, mu)) AS b
         FROM seen LEFT JOIN hosts ON seen.host = hosts.host LEFT JOIN dm ON seen.domain = dm.domain LEFT JOIN sm ON seen.suffix = sm.suffix, mh),
own AS (SELECT host, CASE WHEN a / (a + b) - {u.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {u.MAX_BAD_RATE} THEN 'block' ELSE 'allow' END AS own FROM post),
ruled AS (SELECT page_id, urls.host, path, {rule.replace("(host", "(urls.host").replace("with(host", "with(urls.host")} AS rule, own FROM urls JOIN own ON urls.host = own.host)
SELECT page_id, host, path, rule, {verdict} AS verdict FROM ruled"""


def _op6_sql() -> str:
    m = mixing
    z, zl = "list_sum(list_transform(qs, lambda x: pow(x, {t})))", "list_sum(list_transform(qs, lambda x: pow(x, {t}) * ln(x)))"
    ok = f"ln(z) - t * zl / z - {m.ENTROPY_SHARE} * ln(n) <= 1e-12 AND budget * pow(least / most, t) / z / least - {m.MAX_REPEATS} <= 1e-12"
    often = f"budget / z / most - {m.MAX_REPEATS} > 1e-12"
    h = lambda *parts: f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15))::BIGINT"

    def bisect(name: str, low: str, high: str, test: str) -> str:
        """The least point in (low, high] from which on the test holds, for a test that holds at high."""
        return f"""{name}(low, high, i) AS (
  SELECT {low}::DOUBLE, {high}::DOUBLE, 0
  UNION ALL
  SELECT CASE WHEN good THEN low ELSE t END, CASE WHEN good THEN t ELSE high END, i + 1
  FROM (SELECT low, high, i, t, {test} AS good
        FROM (SELECT *, {z.format(t="t")} AS z, {zl.format(t="t")} AS zl FROM (SELECT low, high, i, (low + high) / 2 AS t, qs.* FROM {name}, qs WHERE i < 52))))"""

    at = lambda t, test: f"(SELECT {test} FROM (SELECT *, {z.format(t='t')} AS z, {zl.format(t='t')} AS zl FROM (SELECT {t} AS t, qs.* FROM qs)))"
    end = lambda name: f"round((SELECT high FROM {name} WHERE i = 52), {m.TAU_DIGITS})"
    return f"""
WITH RECURSIVE counted AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{m.WORDS}')), 0)::BIGINT AS n_tokens FROM documents),
sources AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS docs FROM counted GROUP BY source),
tot AS (SELECT sum(tokens)::BIGINT AS total, max(tokens)::DOUBLE AS most, round(sum(tokens) * {m.BUDGET_SHARE})::DOUBLE AS budget FROM sources),
qs AS (SELECT list(tokens / most) AS qs, min(tokens)::DOUBLE AS least, any_value(most) AS most, count(*) AS n, any_value(budget) AS budget FROM sources, tot WHERE tokens > 0),
{bisect("flatter", "0.0", "1.0", ok)},
{bisect("sharper", "1.0", f"{m.MOST}", ok)},
found AS (SELECT CASE WHEN {at("0.0::DOUBLE", ok)} THEN 0.0 WHEN {at("1.0::DOUBLE", ok)} THEN {end("flatter")} WHEN {at(f"{m.MOST}::DOUBLE", ok)} THEN {end("sharper")} ELSE 1.0 END AS t),
{bisect("rarer", "1.0", f"{m.MOST}", often)},
tau AS (SELECT CASE WHEN t > 1 AND {at("(SELECT t FROM found)", f"budget / z / most - {m.MAX_REPEATS} > 1e-9")} THEN greatest(1.0, round({end("rarer")} - 1e-{m.TAU_DIGITS}, {m.TAU_DIGITS})) ELSE t END AS tau FROM found),
powers AS (SELECT source, tokens, docs, CASE WHEN tokens > 0 THEN pow(tokens / most, tau) ELSE 0 END AS w, budget FROM sources, tot, tau),
weights AS (SELECT source, tokens, docs, w / sum(w) OVER () AS weight, floor(budget * (w / sum(w) OVER ()) + 1e-6)::BIGINT AS target FROM powers),
plan AS (SELECT source, weight, CASE WHEN tokens > 0 THEN target // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN target % tokens ELSE 0 END AS rest,
                ceil(docs / {m.BLOCK_DOCS}.0)::BIGINT AS blocks FROM weights),
dealt AS (SELECT doc_id, counted.source, n_tokens, weight, epochs, rest, ord, ord % blocks AS block
          FROM (SELECT *, {h("'7'", "coalesce(source, '(null)')", "coalesce(doc_id::VARCHAR, '')")} AS ord FROM counted) counted
          JOIN plan ON counted.source IS NOT DISTINCT FROM plan.source),
heads AS (SELECT source, block, sum(n_tokens)::BIGINT AS s, {h("'7b'", "coalesce(source, '(null)')", "block::VARCHAR")} AS turn FROM dealt GROUP BY source, block),
placed AS (SELECT source, block, s, row_number() OVER (PARTITION BY source ORDER BY turn, block) AS place,
                  sum(s) OVER (PARTITION BY source ORDER BY turn, block ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM heads)
SELECT doc_id, d.source, n_tokens, round(weight, {m.TAU_DIGITS}) AS weight, d.block, place,
       (epochs + CASE WHEN upto <= rest THEN 1 WHEN upto - s < rest
        AND sum(n_tokens) OVER (PARTITION BY d.source, d.block ORDER BY ord, doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING) <= rest - (upto - s) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM dealt d JOIN placed h ON d.source IS NOT DISTINCT FROM h.source AND d.block = h.block"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_reputation": _op1_sql(),
        "op4_exact_recipes": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op6_temperature_mix": _op6_sql(),
    }
