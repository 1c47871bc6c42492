"""Planted secrets of every rule beyond the base ones, and their SQL twin on the same rows."""

import random
import re
import string

import duckdb
import pytest

from timespan.llm import secret_scans as ss

ALNUM, HEX = string.ascii_letters + string.digits, "0123456789abcdef"


def some(rng, chars, n):
    return "".join(rng.choice(chars) for _ in range(n))


PLANTED = {
    "pem": lambda r: "-----BEGIN RSA PRIVATE KEY-----", "jwt": lambda r: "eyJ" + ".".join(some(r, ALNUM, 12) for _ in range(3)), "github": lambda r: f"gh{r.choice('pousr')}_" + some(r, ALNUM, 36),
    "slack": lambda r: f"xox{r.choice('abprs')}-" + some(r, string.digits, 12), "stripe": lambda r: "sk_" + "live_" + some(r, ALNUM, 24), "google": lambda r: "AIza" + some(r, ALNUM, 35),
    "google_client": lambda r: "GOCSPX-" + some(r, ALNUM, 28), "google_oauth": lambda r: "ya29." + some(r, ALNUM, 30), "gitlab": lambda r: "glpat-" + some(r, ALNUM, 20),
    "github_fine": lambda r: "github_pat_" + some(r, ALNUM, 70), "npm": lambda r: "npm_" + some(r, ALNUM, 36), "pypi": lambda r: "pypi-AgEI" + some(r, ALNUM, 60),
    "sendgrid": lambda r: "SG." + some(r, ALNUM, 22) + "." + some(r, ALNUM, 43), "shopify": lambda r: "shpat_" + some(r, HEX.upper(), 32), "digitalocean": lambda r: "dop_v1_" + some(r, HEX, 64),
    "model_hub": lambda r: "hf_" + some(r, string.ascii_letters, 34), "stripe_restricted": lambda r: "rk_" + "live_" + some(r, ALNUM, 20), "square": lambda r: "sq0csp-" + some(r, ALNUM, 43),
    "mailgun": lambda r: "key-" + some(r, HEX, 32), "telegram": lambda r: some(r, "123456789", 9) + ":AA" + some(r, ALNUM, 33), "slack_hook": lambda r: "hooks.slack.com/services/T1A/B2C/" + some(r, ALNUM, 20),
    "discord_hook": lambda r: "discord.com/api/webhooks/123/" + some(r, ALNUM, 20), "azure_storage": lambda r: "AccountKey=" + some(r, ALNUM, 86) + "==", "url_password": lambda r: "https://user:pa55wd@host.example",
    "bearer": lambda r: "Bearer " + some(r, ALNUM, 30), "age": lambda r: "AGE-SECRET-KEY-1" + some(r, string.ascii_uppercase, 58), "putty": lambda r: "PuTTY-User-Key-File-2",
    "docker": lambda r: "dckr_pat_" + some(r, ALNUM, 27), "postman": lambda r: "PMAK-" + some(r, HEX, 24) + "-" + some(r, HEX, 34), "databricks": lambda r: "dapi" + some(r, HEX, 32), "linear": lambda r: "lin_api_" + some(r, ALNUM, 40),
}


def brute(text):
    """All spans, each rule by itself over the text."""
    found = []
    for n, rule in enumerate(ss.BASE_RULES + ss.MORE_RULES):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), n, rule.kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    words = "the plan was key- to sk_test and https://host.example/a:b@ hf_short gh_ of xoxo eyJ. AIza".split()
    rows = []
    for kind in [*PLANTED, *PLANTED]:
        secret = PLANTED[kind](rng)
        rows.append(f"{' '.join(rng.choices(words, k=9))} {secret} é {rng.choice(words)}\n{secret[:-1] if rng.random() < 0.3 else ''}")
    return [*rows, " ".join(words), "", None, "é" * 50 + PLANTED["npm"](rng)]


def test_every_rule_is_planted_and_found(spark, texts):
    assert set(PLANTED) == {r.kind for r in ss.MORE_RULES} and len(PLANTED) >= 25
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ss.scan_secrets(df).collect()}
    assert [got[k].spans for k in range(len(texts))] == [brute(t) for t in texts]
    for k, kind in enumerate([*PLANTED, *PLANTED]):
        assert any(x.startswith(kind + ":") for x in got[k].spans.split(",")), kind
    masked = {r.doc_id: r.text for r in ss.redact_secrets(df).collect()}
    assert all("[SECRET]" in masked[k] for k in range(2 * len(PLANTED))) and masked[len(PLANTED) * 2] == texts[len(PLANTED) * 2]


def test_sql_twin_has_the_rules_too(spark, texts, tmp_path):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = con.sql(ss.ORACLE_SQL).df().sort_values("doc_id").reset_index(drop=True)
    mine = ss.scan_secrets(df).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert theirs.astype(str).equals(mine[theirs.columns].astype(str)) and mine.n_more.sum() >= 2 * len(PLANTED)


def test_rules_have_trigram_queries():
    """All but runs of digits, which scan fully."""
    assert {r.kind for r in ss.BASE_RULES + ss.MORE_RULES if not ss.trigram_query(r.pattern)} == {"hex"}
