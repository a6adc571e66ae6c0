"""The registered queries of this package, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import LOWER, ORACLE, QUERIES, UPPER, fold, query, table  # noqa: F401
from tidegrid.llm.conversation_repair import conversation_digests, repair_conversations
from tidegrid.llm.decontaminate import find_leaks
from tidegrid.llm.html_blocks import extract_pages
from tidegrid.llm.importance import importance_resample
from tidegrid.llm.language_id import fit_language_model, identify
from tidegrid.llm.line_runs import drop_repeated_lines
from tidegrid.llm.lz_fingerprint import neighbour_likeness
from tidegrid.llm.ngram_join import near_components
from tidegrid.llm.packing import pack_documents
from tidegrid.llm.preferences import every_turn, preference_rows
from tidegrid.llm import secrets
from tidegrid.llm.secrets import KINDS as SECRET_KINDS
from tidegrid.llm.secrets import PATTERNS as SECRET_PATTERNS
from tidegrid.llm.secrets import REACH, scan_secrets
from tidegrid.llm.toxicity import ToxicityModel, fit_toxicity, score_toxicity
from tidegrid.llm.url_reputation import TWO_LABEL_SUFFIXES, host_of, judge_urls, path_of

LINES_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), hot AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (hot.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot ON keyed.key = hot.key
GROUP BY doc_id
"""


@query("op2_line_dedup", LINES_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go from every document."""
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BAD_SHARE = 0.5


Z = 1.645


def _strength_sql(name: str, keys: str) -> str:
    """Groups of one level and the strength of its prior, as ``url_reputation`` defines it."""
    return f"""{name} AS (SELECT {keys}, sum(n) AS n, sum(bad) AS bad FROM every GROUP BY {keys}),
    {name}_t AS (SELECT sum(n) AS N, count(*) AS K, sum(n * n) AS Q, sum(bad * bad / n) AS E, sum(bad) / sum(n) AS p0 FROM {name} WHERE n > 0),
    {name}_k AS (SELECT p0, 1 / least(greatest(coalesce(((E - N * p0 * p0) / nullif(p0 * (1 - p0), 0) - (K - 1)) / nullif(N - Q / N - (K - 1), 0), 0.5), 0.001), 0.95) - 1 AS k
      FROM {name}_t)"""


_TWO = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{start}') THEN '{h + start}:{verdict}'"
    for verdict, h, start in sorted(RULES, key=lambda x: -len(x[1] + x[2]))
)
REPUTATION_SQL = rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), counted AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad
  FROM parts LEFT JOIN marks ON try_cast(nullif(regexp_extract(path, '^/[a-z]+/(\d{{1,18}})', 1), '') AS BIGINT) = doc_id GROUP BY host
), every AS (
  SELECT *, array_to_string(string_split(host, '.')[(CASE WHEN two THEN -3 ELSE -2 END):], '.') AS domain,
         array_to_string(string_split(host, '.')[(CASE WHEN two THEN -2 ELSE -1 END):], '.') AS suffix
  FROM (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') IN ({_TWO}) AS two FROM counted)
), {_strength_sql('s', 'suffix')}, {_strength_sql('d', 'domain, suffix')}, {_strength_sql('h', 'host')}, shrunk AS (
  SELECT host, e.n, e.bad, hk.k, (d.bad + dk.k * (s.bad + sk.k * coalesce(sk.p0, 0.5)) / (s.n + sk.k)) / (d.n + dk.k) AS m
  FROM every e JOIN s USING (suffix) JOIN d USING (domain, suffix), s_k sk, d_k dk, h_k hk
), beta AS (
  SELECT host, bad + k * m AS a, n - bad + k * (1 - m) AS b FROM shrunk
), fame AS (
  SELECT host, a / (a + b) AS mean, greatest(a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0) AS low FROM beta
), judged AS (
  SELECT page_id, host, path, CASE {_FITS} END AS hit, mean, low FROM parts JOIN fame USING (host)
)
SELECT page_id, host, path, string_split(hit, ':')[1] AS rule,
       coalesce(string_split(hit, ':')[2], CASE WHEN low > {BAD_SHARE} THEN 'block' ELSE 'allow' END) AS verdict,
       round(mean, 6) AS bad_mean, round(low, 6) AS bad_lower
FROM judged
"""


@query("op7_url_filter", REPUTATION_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host reputation for every page; a page's outcome is the label of the document its url names."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    named = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract(path_of(F.col("url")), r"^/[a-z]+/(\d{1,18})", 1).try_cast("long").alias("doc_id"))
    outcomes = named.join(labels, "doc_id", "left").select("host", "bad")
    out = judge_urls(pages, outcomes, RULES, BAD_SHARE, Z)
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("bad_mean", 6).alias("bad_mean"), F.round("bad_lower", 6).alias("bad_lower"))


@query("op8_ngram_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of three-word shingle sets with a Jaccard similarity of 0.9 or more."""
    return near_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> ToxicityModel:
    return fit_toxicity(docs, table(spark, sf_dir, "labels"), use=fold(F.col("doc_id"), 5) != 0)


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, toxicity_model(spark, sf_dir, docs))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op3_benchmark_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a document that holds a benchmark text with at most 5 % edits."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4,096 words."""
    return pack_documents(table(spark, sf_dir, "documents"))


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_model(docs, use=fold(F.col("doc_id"), 4) != 2)
    out = identify(docs.drop("lang"), model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op10_lz_fingerprint")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase fingerprints of all documents, of their edited texts, and of their neighbours."""
    return neighbour_likeness(table(spark, sf_dir, "documents"))


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    """The pairs of ``conversations`` with spans as text."""

    def shown(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")

    return rows.select(
        F.col("pair_id").alias("conv_id"), "status", "n_common", "prompt", "chosen", "rejected",
        shown("chosen_spans").alias("chosen_spans"), shown("rejected_spans").alias("rejected_spans"), *more,
    )


# The rule of every_turn: each conversation, NULL too, comes back, and each turn is in chosen or in after.
EVERY_TURN_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), last AS (
  SELECT conv_id, max(turn) AS at FROM t WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY conv_id
), reply AS (
  SELECT t.conv_id, max(t.text) AS text FROM t JOIN last ON t.conv_id = last.conv_id AND t.turn = last.at WHERE t.role = 'assistant' GROUP BY t.conv_id
), sided AS (
  SELECT t.*, t.turn IS NOT NULL AND (last.at IS NULL OR t.turn <= last.at) AS inside,
         last.at IS NOT NULL AND reply.conv_id IS NOT NULL AS has,
         CASE WHEN t.turn = last.at AND t.role = 'assistant' THEN reply.text ELSE t.text END AS other
  FROM t LEFT JOIN last ON t.conv_id IS NOT DISTINCT FROM last.conv_id
  LEFT JOIN reply ON reply.conv_id = xor(t.conv_id, 1)
), rendered AS (
  SELECT *, '<|' || role || '|>' || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS a,
         '<|' || role || '|>' || chr(10) || regexp_replace(other, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS b
  FROM sided
), marked AS (
  SELECT *, min(CASE WHEN inside AND text <> other THEN turn END) OVER (PARTITION BY conv_id) AS differs FROM rendered
), placed AS (
  SELECT *, inside AND NOT common AS tail,
         coalesce(sum(length(a)) FILTER (inside AND NOT common) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS ea,
         coalesce(sum(length(b)) FILTER (inside AND NOT common) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS eb
  FROM (SELECT *, inside AND has AND (differs IS NULL OR turn < differs) AS common FROM marked)
)
SELECT conv_id, CASE WHEN NOT bool_or(inside AND has) THEN 'unpaired' WHEN bool_or(tail) THEN 'pair' ELSE 'same' END AS status,
       count(*) FILTER (common) AS n_common,
       coalesce(string_agg(a, '' ORDER BY turn) FILTER (common), '') AS prompt,
       CASE WHEN bool_or(inside) THEN coalesce(string_agg(a, '' ORDER BY turn) FILTER (tail), '') END AS chosen,
       CASE WHEN bool_or(inside AND has) THEN coalesce(string_agg(b, '' ORDER BY turn) FILTER (tail), '') END AS rejected,
       CASE WHEN bool_or(inside) THEN coalesce(string_agg((ea - length(a) + 14) || '-' || (ea - 1), ',' ORDER BY turn)
         FILTER (tail AND role = 'assistant'), '') END AS chosen_spans,
       CASE WHEN bool_or(inside AND has) THEN coalesce(string_agg((eb - length(b) + 14) || '-' || (eb - 1), ',' ORDER BY turn)
         FILTER (tail AND role = 'assistant'), '') END AS rejected_spans,
       count(*) FILTER (NOT inside) AS n_after,
       coalesce(string_agg(a, '' ORDER BY turn NULLS LAST, role, text) FILTER (NOT inside), '') AS after
FROM placed GROUP BY conv_id
"""


def _all_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(preference_rows(*every_turn(table(spark, sf_dir, "conversations"))), "n_after", "after")


@query("op4_preference_format", EVERY_TURN_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, with all its turns, against itself with its neighbour's last reply, as prompt and masked completions."""
    return _all_preferences(spark, sf_dir)


@query("op4_preference_all", EVERY_TURN_SQL)
def op4_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its earlier name."""
    return _all_preferences(spark, sf_dir)


# crc32 of a text: the table of all bytes by rule, and one table step per byte.
_CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS p"""


def _crc_sql(text: str) -> str:
    bytes_ = f"list_transform(range(length(hex({text})) // 2), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: xor(c // 256, p[xor(c % 256, b) + 1])), 4294967295)"


IMPORTANCE_SQL = rf"""
WITH crc AS ({_CRC_TABLE}), texts AS (
  SELECT 0 AS side, doc_id AS id, row_number() OVER () AS row, text FROM documents
  UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark
), worded AS (
  SELECT side, id, row, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), featured AS (
  SELECT side, id, row, len(w) AS words, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded
), named AS (
  SELECT f, {_crc_sql('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM featured), crc
), placed AS (
  SELECT featured.*, bucket FROM featured JOIN named USING (f)
), gains AS (
  SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (coalesce(sum(s) OVER (), 0)::DOUBLE + 10000)
           / ((coalesce(s, 0) + 1.0::DOUBLE) * (coalesce(sum(t) OVER (), 0)::DOUBLE + 10000)))) AS BIGINT) AS gain
  FROM range(10000) b(bucket)
  LEFT JOIN (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM placed GROUP BY bucket) c USING (bucket)
), weighed AS (
  SELECT row, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM placed JOIN gains USING (bucket) WHERE side = 0 GROUP BY row
), scored AS (
  SELECT id AS doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM worded LEFT JOIN weighed USING (row) WHERE side = 0
), ranked AS (
  SELECT *, CASE WHEN able THEN row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (able) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM ranked
"""


@query("op11_importance_resampling", IMPORTANCE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn by their likeness to the benchmark; every document with its weight."""
    out = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def _secret_matches_sql(kind: str) -> str:
    """All matches of one pattern, with the running end of each."""
    p = SECRET_PATTERNS[kind].replace("'", "''")
    value = f", regexp_extract_all(text, '{p}', {2 if kind == 'assign' else 0}) AS v"
    n = "length(value)"
    as_kind = {
        "assign": f"CASE WHEN {n} >= {secrets.ASSIGN_LEAST} THEN 'assign' WHEN {n} >= {secrets.PASS_LEAST} THEN 'pass' END",
        "access": f"CASE WHEN {n} >= {secrets.ACCESS_LEAST} THEN 'access' WHEN {n} >= {secrets.IDENT_LEAST} THEN 'ident' END",
        "key": "CASE WHEN regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]') THEN 'key' END",
    }.get(kind, f"'{kind}'")
    return f"""SELECT row, {as_kind} AS kind, CAST(sum(length(gap) + length(x)) OVER (PARTITION BY row ORDER BY i) AS BIGINT) AS stop, length(x) AS n FROM (
    SELECT row, unnest(range(len(w))) AS i, unnest(w) AS x, unnest(v) AS value, unnest(string_split_regex(text, '{p}')[1:len(w)]) AS gap
    FROM (SELECT row, text, regexp_extract_all(text, '{p}') AS w{value} FROM texts))"""


def _any_sql(kinds: tuple[str, ...]) -> str:
    return "kind IN (" + ", ".join(f"'{k}'" for k in kinds) + ")"


def _covered_sql(kinds: tuple[str, ...]) -> str:
    k = _any_sql(kinds)
    return f"(coalesce(max(stop) FILTER ({k}) OVER ahead > start, false) OR coalesce(min(start) FILTER ({k}) OVER behind < stop, false))"


def _nearest_sql(name: str) -> str:
    """The nearer one of the last part before and the first part behind, where that is near enough."""
    left, right = f"greatest(start - {name}_b.stop, 0)", f"greatest({name}_a.start - stop, 0)"
    return f"""CASE WHEN {name}_b IS NOT NULL AND {left} <= {REACH} AND ({name}_a IS NULL OR {left} <= {right}) THEN {name}_b
      WHEN {name}_a IS NOT NULL AND {right} <= {REACH} THEN {name}_a END AS {name}"""


def _sides_sql(name: str, kinds: tuple[str, ...]) -> str:
    of = f"CASE WHEN {_any_sql(kinds)} THEN {{'start': start, 'rank': rank, 'kind': kind, 'stop': stop}} END"
    return f"last_value({of} IGNORE NULLS) OVER ahead AS {name}_b, last_value({of} IGNORE NULLS) OVER behind AS {name}_a"


def _sweep_sql(keys: str) -> str:
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"WINDOW ahead AS (PARTITION BY {keys} ORDER BY start, rank {frame}), behind AS (PARTITION BY {keys} ORDER BY start DESC, rank DESC {frame})"


SECRETS_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), parts AS (
  SELECT row, kind, stop - n AS start, stop, list_position([{', '.join(f"'{k}'" for k in SECRET_KINDS)}], kind) AS rank FROM (
    {' UNION ALL '.join(f'({_secret_matches_sql(k)})' for k in SECRET_PATTERNS)}
  ) WHERE kind IS NOT NULL
), marked AS (
  SELECT *, count(*) FILTER (kind = 'break') OVER ahead AS scope, {_covered_sql(secrets.BASE)} AS in_base,
         {_covered_sql(tuple(k for k in SECRET_KINDS if k != 'key'))} AS in_any
  FROM parts {_sweep_sql('row')}
), left_over AS (
  SELECT * FROM marked WHERE kind <> 'break' AND NOT (in_base AND kind IN ('key', 'pass', 'ident')) AND NOT (in_any AND kind = 'key')
), sided AS (
  SELECT *, {_sides_sql('ident', ('access', 'ident'))}, {_sides_sql('endpoint', ('endpoint',))} FROM left_over {_sweep_sql('row, scope')}
), near AS (
  SELECT *, {_any_sql(secrets.SECRET)} AND ident IS NOT NULL AND (ident.kind = 'access' OR endpoint IS NOT NULL) AS complete
  FROM (SELECT row, kind, start, stop, rank, {_nearest_sql('ident')}, {_nearest_sql('endpoint')} FROM sided)
), told AS (
  SELECT row, start, rank, kind, stop FROM near WHERE {_any_sql(secrets.BASE)} OR complete
  UNION SELECT row, ident.start, ident.rank, ident.kind, ident.stop FROM near WHERE complete
  UNION SELECT row, endpoint.start, endpoint.rank, endpoint.kind, endpoint.stop FROM near WHERE complete AND endpoint IS NOT NULL
), listed AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER ({_any_sql(secrets.BASE)}) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM told GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(c.n, 0) AS n_credentials
FROM texts LEFT JOIN listed USING (row) LEFT JOIN (SELECT row, count(*) AS n FROM near WHERE complete GROUP BY row) c USING (row)
"""


@query("op13_secret_scan", SECRETS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: single patterns and complete credentials."""
    out = scan_secrets(table(spark, sf_dir, "documents"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return out.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.col("credentials").alias("n_credentials"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with planted faults, by a checksum of conversation and turn; NULLs become one space."""
    space = F.lit(" ")
    shown = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20)
    rows = rows.toDF("conv_id", "turn", "role", "text", "hit").filter("hit != 0")
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _edited_sql(value: str, cost: int, edit: str, piece: str = "''") -> str:
    """A state's [cost and audit, text] after one more edit."""
    return f"CASE WHEN {value} IS NOT NULL THEN [lpad(CAST(CAST(substr({value}[1], 1, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || substr({value}[1], 7) || '{edit}', {value}[2] || {piece}] END"


def _least_sql(*values: str) -> str:
    return f"list_min(list_filter([{', '.join(values)}], lambda v: v IS NOT NULL))"


def _inserted_sql(name: str, source: str) -> str:
    """Costs of all states after one insert at most."""
    u, a = [_edited_sql(f"{source}.e", 2, "I", r"'user:' || chr(10)"), _edited_sql(f"{source}.s", 2, "I", r"'user:' || chr(10)"), _edited_sql(f"{source}.a", 2, "I", r"'user:' || chr(10)")], [
        _edited_sql(f"{source}.u", 2, "I", r"'assistant:' || chr(10)")]
    return f"SELECT {source}.* REPLACE ({_least_sql(f'{source}.u', *u)} AS u, {_least_sql(f'{source}.a', *a)} AS a) FROM {name} {source}"


def _turn_sql() -> str:
    """Costs after the next turn, from costs with the inserts before it (i) and the turn (t)."""
    cut = "CASE WHEN t.fault = 'truncated' THEN 1 ELSE 0 END"
    may, own = "t.fault IS DISTINCT FROM 'blank' AND t.fault IS DISTINCT FROM 'duplicate'", "t.role || ':' || t.text || chr(10)"

    def gone(q):
        return _edited_sql(f"i.{q}", 3, "D")

    def kept(q, letter):
        return f"CASE WHEN {may} AND t.letter = '{letter}' THEN {_edited_sql(f'i.{q}', cut, 'K', own)} END"

    def relabelled(q, role):
        return f"CASE WHEN {may} THEN {_edited_sql(f'i.{q}', f'2 + {cut}', 'R', f"'{role}:' || t.text || chr(10)")} END"

    to_user = [x for q in "esa" for x in (kept(q, "u"), relabelled(q, "user"))]
    return f"""SELECT i.conv_id, i.p + 1 AS p, {gone('e')} AS e, {_least_sql(gone('s'), kept('e', 's'))} AS s, {_least_sql(gone('u'), *to_user)} AS u,
      {_least_sql(gone('a'), kept('u', 'a'), relabelled('u', 'assistant'))} AS a"""


BLANK_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
REPAIR_SQL = rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), hit AS (
  SELECT * EXCLUDE (name, p), {_crc_sql('name')} % 20 AS hit FROM named, crc
), damaged AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE hit WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hit
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS p,
         rtrim(text, {BLANK_SQL}) AS body, substr(role, 1, 1) AS letter FROM damaged
), turns AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate'
         WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         lag(letter) OVER (PARTITION BY conv_id ORDER BY p) AS letter_before FROM placed
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (letter_before IS NOT NULL AND letter_before || letter NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id
), ways AS (
  SELECT conv_id, 0::BIGINT AS p, ['000000', ''] AS e, NULL::VARCHAR[] AS s, NULL::VARCHAR[] AS u, NULL::VARCHAR[] AS a FROM facts
  UNION ALL
  {_turn_sql()}
  FROM ({_inserted_sql('(' + _inserted_sql('ways', 'w') + ')', 'x')}) i JOIN turns t ON t.conv_id IS NOT DISTINCT FROM i.conv_id AND t.p = i.p + 1
), closed AS (
  SELECT conv_id, p, {_least_sql('e', 'a')} AS best FROM ({_inserted_sql('(' + _inserted_sql('ways', 'w') + ')', 'x')})
), chosen AS (
  SELECT facts.*, best FROM facts JOIN closed ON facts.conv_id IS NOT DISTINCT FROM closed.conv_id AND facts.n = closed.p
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(CAST(substr(best[1], 1, 6) AS BIGINT), 0) AS cost, coalesce(substr(best[1], 7), '') AS audit,
       sha256(coalesce(left(best[2], length(best[2]) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN chosen ON ids.conv_id IS NOT DISTINCT FROM chosen.conv_id
"""


@query("op12_conversation_repair", REPAIR_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and then repaired by the cheapest edits."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, repaired = repair_conversations(damaged(turns))
    digests = conversation_digests(repaired, dict(turns.dtypes)["conv_id"]).withColumnRenamed("conv_id", "d_id")
    found = report.withColumnRenamed("conv_id", "r_id")
    out = turns.select("conv_id").distinct()
    out = out.join(found, F.col("conv_id").eqNullSafe(F.col("r_id")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("d_id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
