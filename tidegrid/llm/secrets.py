"""Secret scan: spans of single patterns, and weak candidates that the other parts of a credential near them confirm.

Written with DataFrame and SQL functions only. The patterns name both cases of a letter where either is meant, so that
they mean the same in every regular expression engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch


def either_case(words: str) -> str:
    """The same alternatives with each letter in both cases."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_IS = r"""["']?\x20*[:=]\x20*["']?"""
# Kinds in the order in which spans of equal start are listed, with their patterns.
PATTERNS = {
    "assign": "(" + either_case("password|passwd|secret|token|api_?key") + ")" + _IS + "([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{16,}",  # runs are matched whole, so shorter ones never matter
    "key": "[A-Za-z0-9+/_=-]{20,}",
    "endpoint": "(?:" + either_case("https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp") + r""")://[^\x00-\x20"'<>]+|(?:"""
    + either_case("hostname|host|server|endpoint") + ")" + _IS + "[A-Za-z0-9_.:/-]{4,}",
    "ident": "(?:" + either_case("username|user|login|account|client_?id|access_?key_?id|access_?key") + ")" + _IS + "[A-Za-z0-9_.@-]{3,}",
    "break": r"\n[\x20\t\r]*\n",
}
BASE = ("assign", "access", "hex")
KINDS = ("assign", "access", "hex", "key", "pass", "endpoint", "ident")
SECRET = ("assign", "hex", "key", "pass")
ASSIGN_LEAST, PASS_LEAST, ACCESS_LEAST, IDENT_LEAST = 12, 6, 18, 12
REACH = 300  # code points between the parts of a credential


def _matches(text: Column, kind: str) -> Column:
    """Of each match in order: kind, number, code points since the match before, its length; matches of no use are ``skip``."""
    p = PATTERNS[kind]
    whole, value = F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.regexp_extract_all(text, F.lit(p), F.lit(2 if kind == "assign" else 0))
    zipped = F.arrays_zip(F.split(text, p, -1).alias("gap"), whole.alias("whole"), value.alias("value"))

    def used(value: Column) -> Column:
        n = F.char_length(value)
        if kind == "assign":
            return F.when(n >= ASSIGN_LEAST, "assign").when(n >= PASS_LEAST, "pass").otherwise("skip")
        if kind == "access":
            return F.when(n >= ACCESS_LEAST, "access").when(n >= IDENT_LEAST, "ident").otherwise("skip")
        if kind == "key":
            return F.when(value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]"), "key").otherwise("skip")
        return F.lit(kind)

    def row(z: Column, i: Column) -> Column:
        gap, match, value = (z[k] for k in ("gap", "whole", "value"))
        return F.struct(F.lit(kind).alias("pattern"), used(value).alias("kind"), i.alias("i"), F.char_length(gap).alias("gap"), F.char_length(match).alias("n"))

    rows = F.filter(F.transform(zipped, row), lambda x: x["n"].isNotNull())  # behind the last match there is one more gap
    return F.when(text.rlike(p), rows).otherwise(F.array().cast("array<struct<pattern:string,kind:string,i:int,gap:int,n:int>>"))


def scan_secrets(docs: DataFrame, reach: int = REACH, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, spans, credentials) for every row of ``docs`` (doc_id, text).

    ``spans`` are (start, rank, kind, end) in code points, end exclusive, by start and then by kind as in ``KINDS``. Of
    kinds assign, access and hex every match counts. Other kinds are parts of a credential that mean little alone: *key* (20
    characters or more with capitals, small letters and digits), *pass* (a short assigned value), *ident* (an assigned user or
    client name, a short access identifier) and *endpoint* (a url of a service, an assigned host). A part of these is
    reported only in a complete credential: a secret (assign, hex, key, pass), its nearest identifier (access, ident) and,
    unless that is an access identifier, its nearest endpoint; all in one paragraph and at most ``reach`` code points from the
    secret (the one before it if equally near). ``credentials`` counts the complete ones. Keys that overlap any other
    part, and short values and identifiers that overlap an assign, access or hex span, are no parts.

    NULL and empty texts have no spans. Rows are judged one by one, whatever their doc_id, so repeated and NULL ids keep
    all their rows. An empty table gives no rows; other columns of ``docs`` are not read.

    Texts are read once and never move: lengths of matches and gaps are written, and positions are running sums over them.
    The interval join is a sweep over the parts of one text, each looking up the nearest part on either side, so no
    pairs are formed however many parts a text has.
    """
    scratch = scratch or Scratch(docs.sparkSession, "secrets")
    text = F.coalesce("text", F.lit(""))
    parts = F.concat(*(_matches(text, kind) for kind in PATTERNS if kind != "break"))
    scanned = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"), parts.alias("parts"))
    useful = F.exists("parts", lambda x: x["kind"] != "skip")
    scanned = scanned.select("row", "doc_id", F.when(useful, F.concat("parts", _matches(F.col("text"), "break"))).alias("parts"))
    scanned = scratch.keep(scanned, "matches")
    found = scanned.select("row", "doc_id", F.inline("parts")).repartition("row")  # all windows below use this partitioning
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("row", "pattern").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    placed = found.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.col("n"))).filter("kind != 'skip'")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    linked = _linked(placed.select("row", "doc_id", "start", rank.alias("rank"), "kind", "end"), reach)
    part = F.struct("start", "rank", "kind", "end")
    own = F.when(F.col("kind").isin(*BASE) | F.col("complete"), part)
    told = F.filter(F.array(own, F.when(F.col("complete"), F.col("ident")), F.when(F.col("complete"), F.col("endpoint"))), lambda x: x.isNotNull())
    told = linked.select("row", "doc_id", F.col("complete").cast("long").alias("complete"), F.explode(told).alias("span"))
    # a part that several secrets point to is told once; the count is of secrets, whose own span comes first
    told = told.groupBy("row", "doc_id", "span").agg(F.max(F.when((F.col("span.rank").isin(*[KINDS.index(k) + 1 for k in SECRET])), F.col("complete"))).alias("complete"))
    every = told.unionByName(scanned.select("row", "doc_id"), allowMissingColumns=True)
    out = every.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list("span")).alias("spans"), F.coalesce(F.sum("complete"), F.lit(0)).alias("credentials"))
    return out.select("doc_id", "spans", "credentials")


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """``parts`` of all texts with, for each secret, the nearest ``ident`` and ``endpoint`` and whether it is ``complete``."""
    span = F.struct("start", "rank", "kind", "end")
    weak = F.col("kind").isin("key", "pass", "ident")

    def sides(*keys: str) -> tuple:
        ahead = Window.partitionBy(*keys).orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
        behind = Window.partitionBy(*keys).orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
        return ahead, behind

    ahead, behind = sides("row")

    def covered(kinds: tuple[str, ...]) -> Column:
        of = F.col("kind").isin(*kinds)
        before, after = F.max(F.when(of, F.col("end"))).over(ahead), F.min(F.when(of, F.col("start"))).over(behind)
        return F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))

    scope = F.coalesce(F.sum((F.col("kind") == "break").cast("int")).over(ahead), F.lit(0))
    marked = parts.select(
        "*", scope.alias("scope"), covered(BASE).alias("in_base"), covered(tuple(k for k in KINDS if k != "key")).alias("in_any")
    ).filter(~((F.col("kind") == "break") | (weak & F.col("in_base")) | ((F.col("kind") == "key") & F.col("in_any"))))
    ahead, behind = sides("row", "scope")

    def nearest(*kinds: str) -> Column:
        of = F.when(F.col("kind").isin(*kinds), span)
        before, after = F.last(of, ignorenulls=True).over(ahead), F.last(of, ignorenulls=True).over(behind)
        left, right = F.greatest(F.col("start") - before["end"], F.lit(0)), F.greatest(after["start"] - F.col("end"), F.lit(0))
        # greatest() skips NULLs, so a missing side has to be told from a touching one
        left, right = F.when(before.isNotNull(), left), F.when(after.isNotNull(), right)
        return F.when((left <= reach) & (right.isNull() | (left <= right)), before).when(right <= reach, after)

    near = marked.select("row", "doc_id", "start", "rank", "kind", "end", nearest("access", "ident").alias("ident"), nearest("endpoint").alias("endpoint"))
    complete = F.col("kind").isin(*SECRET) & F.col("ident").isNotNull() & ((F.col("ident.kind") == "access") | F.col("endpoint").isNotNull())
    return near.withColumn("complete", F.coalesce(complete, F.lit(False)))
