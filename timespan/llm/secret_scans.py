r"""Secret scans (operator 5): a trigram inverted index over the texts, built-in functions only.

From each rule's regular expression a Boolean trigram query is derived: a conjunction of clauses, each a choice of
sets of trigrams of which one must be wholly in a matching text. The index has the posting lists of the trigrams that
the queries name, over lower-cased texts: a row for each trigram and range of documents, written to the shared folder.
A rule's candidates are the documents in the intersection, over its clauses, of the union of its alternatives'
intersected lists; only they are verified with the expression. Rules from which no trigram follows (runs of hex digits)
scan every text. Ranges hold a bounded number of documents, so a frequent trigram is never gathered in one task.

Spans are code points, end exclusive. Defined results: a null text is empty and has no spans; repeated rows each get
their own result; null doc_ids are kept; only doc_id and text are read.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timespan.llm.common import shared_dir, small, stored, table
from timespan.llm.warc import remove

#: Strings that a part of an expression can stand for, up to which they are listed.
MAX_STRINGS, MAX_CLASS = 64, 4
#: Documents of a range of the index, about.
RANGE_DOCS = 4096


@dataclass(frozen=True)
class Rule:
    """group `group` of a match must have `least` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed by contract. Runs of fewer than 32 hex digits, and of fewer than 16 characters with AKIA, can't pass and no part of them can.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: The method's own rules, from the public documentation of the services that give out such keys.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("google_client", r"GOCSPX-[A-Za-z0-9_-]{28}"),
    Rule("google_oauth", r"ya29\.[A-Za-z0-9_-]{20,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("github_fine", r"github_pat_[A-Za-z0-9_]{60,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-AgEI[A-Za-z0-9_-]{50,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("shopify", r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}"),
    Rule("digitalocean", r"do[opr]_v1_[0-9a-f]{64}"),
    Rule("model_hub", r"hf_[A-Za-z]{34}"),
    Rule("stripe_restricted", r"rk_live_[A-Za-z0-9]{16,}"),
    Rule("square", r"sq0csp-[A-Za-z0-9_-]{43}"),
    Rule("mailgun", r"key-[0-9a-f]{32}"),
    Rule("telegram", r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}"),
    Rule("slack_hook", r"hooks\.slack\.com/services/T[A-Za-z0-9_]+/B[A-Za-z0-9_]+/[A-Za-z0-9_]+"),
    Rule("discord_hook", r"discord(?:app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+"),
    Rule("azure_storage", r"AccountKey=[A-Za-z0-9+/]{86}=="),
    Rule("url_password", r"[a-z]{2,12}://[A-Za-z0-9._%-]+:([A-Za-z0-9._%!$&*+=-]+)@[A-Za-z0-9.-]+", 1, 3),
    Rule("bearer", r"Bearer [A-Za-z0-9._~+/-]{20,}"),
    Rule("age", r"AGE-SECRET-KEY-1[A-Z0-9]{58}"),
    Rule("putty", r"PuTTY-User-Key-File-[23]"),
    Rule("docker", r"dckr_pat_[A-Za-z0-9_-]{27,}"),
    Rule("postman", r"PMAK-[0-9a-f]{24}-[0-9a-f]{34}"),
    Rule("databricks", r"dapi[0-9a-f]{32}"),
    Rule("linear", r"lin_api_[A-Za-z0-9]{40}"),
)
#: Those of the most common services, for jobs with little memory beside other stages.
COMMON_RULES = MORE_RULES[:6]

Clause = tuple[frozenset[str], ...]


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _clause(strings: set[str]) -> Clause | None:
    """One of these strings is in the text. None if that asks for no trigram."""
    sets = {_trigrams(x.lower()) for x in strings}
    if not sets or frozenset() in sets:
        return None
    return tuple(sorted((x for x in sets if not any(y < x for y in sets)), key=sorted))


def trigram_query(pattern: str) -> list[Clause]:
    """The clauses that every text with a match meets; empty if there are none, so that the rule scans fully."""
    parser = re._parser  # the standard library's own syntax tree
    clauses: set[Clause] = set()

    def strings(node) -> set[str] | None:
        """All strings that the node can stand for, or None."""
        op, value = str(node[0]), node[1]
        if op == "LITERAL":
            return {chr(value)}
        if op == "IN":
            found: set[str] = set()
            for kind, x in value:
                if str(kind) == "LITERAL":
                    found.add(chr(x))
                elif str(kind) == "RANGE" and x[1] - x[0] < MAX_CLASS:
                    found |= {chr(c) for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return found if len(found) <= 2 * MAX_CLASS else None
        if op == "SUBPATTERN":
            return sequence(value[-1])
        if op == "BRANCH":
            each = [sequence(x) for x in value[1]]
            return None if None in each else set().union(*each)
        if op == "MAX_REPEAT" and value[1] != parser.MAXREPEAT and int(value[1]) <= 5:
            own = sequence(value[2])
            if own is None:
                return None
            out, power = (set() if value[0] else {""}), {""}
            for n in range(1, int(value[1]) + 1):
                power = {a + b for a in power for b in own}
                if len(power) > MAX_STRINGS:
                    return None
                out |= power if n >= value[0] else set()
            return out
        return None

    def sequence(nodes) -> set[str] | None:
        whole: set[str] | None = {""}
        for node in nodes:
            own = strings(node) if whole is not None else None
            whole = {a + b for a in whole for b in own} if own is not None else None
            if whole is not None and len(whole) > MAX_STRINGS:
                return None
        return whole

    def walk(nodes) -> None:
        """Adds a clause for each stretch whose strings can be listed."""
        run: set[str] = {""}

        def flush() -> None:
            if (clause := _clause(run)) is not None:
                clauses.add(clause)

        for node in nodes:
            own = strings(node)
            if own is not None and len(run) * len(own) <= MAX_STRINGS:
                run = {a + b for a in run for b in own}
                continue
            flush()
            run = {""}
            if own is not None:
                run = own
            elif str(node[0]) == "SUBPATTERN":
                walk(node[1][-1])
            elif str(node[0]) == "MAX_REPEAT" and node[1][0] >= 1:
                walk(node[1][2])
        flush()

    walk(parser.parse(pattern))
    return sorted(clauses, key=lambda c: [sorted(x) for x in c])


def _read(docs: DataFrame) -> DataFrame:
    """doc (all columns), doc_id, text, and a key of the row's content: rows that share it have the same spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("key"))


def write_postings(docs: DataFrame, trigrams: list[str], folder: str) -> DataFrame:
    """The inverted index, written to folder: trigram, range, keys (of the range's documents whose lower-cased text has the trigram).

    A range is a share of the documents by the hash of their keys, RANGE_DOCS of them about, so no posting list grows with the corpus.
    """
    ranges = max(1, -(-docs.count() // RANGE_DOCS))
    named = F.array(*[F.lit(x) for x in trigrams])
    # the lower-cased text is a lambda's variable, so that it is made once and not for each trigram
    found = F.transform(F.array(F.lower("text")), lambda low: F.filter(named, lambda t: F.contains(low, t)))[0]
    hits = _read(docs).select("key", F.pmod("key", F.lit(ranges)).alias("range"), F.explode(found).alias("trigram"))
    hits.groupBy("trigram", "range").agg(F.collect_set("key").alias("keys")).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """key, kinds: the rules with a trigram query that each document meets, by the posting lists of each range."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for query in queries.values() for clause in query for alternative in clause for t in alternative})
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/trigrams-{uuid.uuid4().hex}"
    lists = write_postings(docs, trigrams, folder).groupBy("range").pivot("trigram", trigrams).agg(F.first("keys"))
    none = F.expr("cast(array() AS array<bigint>)")

    def postings(t: str) -> Column:
        return F.coalesce(F.col(f"`{t}`"), none)

    def meeting(query: list[Clause]) -> Column:
        each = [reduce(F.array_union, [reduce(F.array_intersect, map(postings, sorted(ts))) for ts in clause]) for clause in query]
        return reduce(F.array_intersect, each)

    met = lists.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), meeting(query).alias("keys")) for kind, query in queries.items()])).alias("m"))
    found = stored(met.select("m.kind", F.explode("m.keys").alias("key")).groupBy("key").agg(F.collect_set("kind").alias("kinds")))
    remove(spark, folder)
    return found


def _spans(rule: Rule, order: int) -> Column:
    """Spans of a rule in text: matches stand between the pieces that the same expression splits the text into."""
    pieces, matches = F.split("text", rule.pattern, -1), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))
    each = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("piece"), matches.alias("match"), groups.alias("part"))
    none = F.expr("struct(0 AS at, cast(array() AS array<struct<start:int,n:int,kind:string,end:int>>) AS found)")

    def take(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        own = F.array(F.struct(start.alias("start"), F.lit(order).alias("n"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(state["found"], own)).otherwise(state["found"]).alias("found"))

    return F.aggregate(each, none, take)["found"]


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """doc (all columns), doc_id, text, spans of every row: structs of start, n (the rule's place), kind and end, in order."""
    indexed = {r.kind for r in rules if trigram_query(r.pattern)}
    found = small(candidates(docs, rules).withColumnRenamed("key", "met"))
    rows = _read(docs)
    rows = rows.join(found, F.col("key") == F.col("met"), "left")
    none = F.expr("cast(array() AS array<struct<start:int,n:int,kind:string,end:int>>)")
    parts = []
    for n, rule in enumerate(rules):
        asked = F.array_contains("kinds", rule.kind) if rule.kind in indexed else F.regexp_like("text", F.lit(rule.pattern))
        rows = rows.withColumn(f"spans_{n}", F.when(asked, _spans(rule, n)).otherwise(none))
        parts.append(f"spans_{n}")
    return rows.withColumn("spans", F.array_sort(F.concat(*parts))).select("doc", "doc_id", "text", "spans")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_more, base_sha256, spans."""
    found = secret_spans(docs).select("doc_id", "spans")

    def of(k: int) -> Column:
        return F.filter("spans", lambda x: x["n"] == k)

    base = F.filter("spans", lambda x: x["n"] < len(BASE_RULES))
    return found.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)), (F.size("spans") - F.size(base)).cast("long").alias("n_more"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """The documents with every span of the rules masked where it is found; columns (whatever their names) and rows stay, and n_chars, if there, follows the text."""
    found = secret_spans(docs, rules).withColumn("hit", F.size("spans") > 0).withColumn("masked", F.when(F.col("hit"), _masked(mask)))
    new = {c: F.col("doc").getField(c) for c in docs.columns}
    new["text"] = F.coalesce("masked", new["text"])
    if "n_chars" in new:
        new["n_chars"] = F.when(F.col("hit"), F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(new["n_chars"])
    return found.select(*(x.alias(c) for c, x in new.items()))


def _masked(mask: str) -> Column:
    def step(state: Column, x: Column) -> Column:
        start = F.greatest(x["start"], state["at"])
        put = F.concat(state["out"], F.substr(F.col("text"), state["at"] + 1, start - state["at"]), F.lit(mask))
        ends_before = x["end"] <= state["at"]
        return F.struct(F.greatest(x["end"], state["at"]).alias("at"), F.when(ends_before, state["out"]).otherwise(put).alias("out"))

    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.concat(done["out"], F.substr(F.col("text"), done["at"] + 1))


def op5_secret_scans(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def _sql(n: int, rule: Rule) -> str:
    """Spans of a rule. Pieces between matches give a match its place; DuckDB's expressions have no positions either."""
    pattern = rule.pattern.replace("'", "''")
    return f"""m{n} AS (SELECT doc_id, i, m[i] AS hit, g[i] AS part, p[i] AS piece FROM (SELECT doc_id, regexp_extract_all(body, '{pattern}') AS m, regexp_extract_all(body, '{pattern}', {rule.group}) AS g,
        string_split_regex(body, '{pattern}') AS p FROM d WHERE regexp_matches(body, '{pattern}')) t, range(1, len(m) + 1) r(i)),
    s{n} AS (SELECT doc_id, '{rule.kind}' AS kind, {n} AS n, (sum(length(piece) + length(hit)) OVER w - length(hit))::BIGINT AS s, (sum(length(piece) + length(hit)) OVER w)::BIGINT AS e, length(part) >= {rule.least} AS good
        FROM m{n} WINDOW w AS (PARTITION BY doc_id ORDER BY i)),"""


_ALL = BASE_RULES + MORE_RULES
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), {" ".join(_sql(n, r) for n, r in enumerate(_ALL))}
     every AS ({" UNION ALL ".join(f"SELECT * FROM s{n} WHERE good" for n in range(len(_ALL)))}),
     a AS (SELECT doc_id, count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access, count(*) FILTER (n = 2) AS n_hex, count(*) FILTER (n > 2) AS n_more,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n) AS j, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n) FILTER (n <= 2) AS b FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_more, 0) AS n_more, sha256(coalesce(b, '')) AS base_sha256, coalesce(j, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""
