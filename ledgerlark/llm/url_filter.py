"""URL filter: longest matching rule, else gradient-boosted trees over lexical features.

All of the main path is SQL: host, path and features are built-in expressions, and the fitted trees
are nested ``CASE`` terms, so scans of URLs stay in generated code. The trees are fitted on the
driver from a bounded list of labelled URLs.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import gbdt
from ledgerlark.llm.common import materialise, table

#: (verdict, host and path): fits the host and all its subdomains if the path starts so.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Rules in one expression; more are joined as a table.
MOST_RULES = 200
#: Labelled URLs of the built-in training list.
TRAINING_URLS = 4000
SEED = 8

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _count_sql(text: str, char: str) -> str:
    return f"CAST(length({text}) - length(replace({text}, '{char}', '')) AS DOUBLE)"


def _only_sql(text: str, kept: str, dialect: str) -> str:
    flags = ", 'g'" if dialect == "duckdb" else ""
    return f"CAST(length(regexp_replace({text}, '[^{kept}]', ''{flags})) AS DOUBLE)"


def parts_sql(url: str, dialect: str = "spark") -> dict[str, str]:
    """Host and path of a column; both empty without ``://``."""
    rest = f"(CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END)"
    return {
        "host": f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{_UP}', '{_LOW}')",
        "path": f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)",
    }


def rule_sql(rules=RULES, host: str = "host", path: str = "path") -> tuple[str, str]:
    """SQL of the longest rule that fits (else null), and of the verdict of column ``rule``."""
    if not rules:
        return "CAST(NULL AS STRING)", "CAST(NULL AS STRING)"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cases = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits = f"({host} = {quoted(h)} OR right({host}, {len(h) + 1}) = {quoted('.' + h)})"
        cases.append(f"WHEN {fits} AND left({path}, {len(slash + p)}) = {quoted(slash + p)} THEN {quoted(rule)}")
    verdicts = " ".join(f"WHEN {quoted(rule)} THEN {quoted(verdict)}" for verdict, rule in rules)
    return f"CASE {' '.join(cases)} END", f"CASE rule {verdicts} END"


FEATURES = [
    "f_length", "f_host_length", "f_depth", "f_digits", "f_host_digits", "f_entropy", "f_params",
    "f_query", "f_hyphens", "f_labels", "f_escapes", "f_at", "f_longest", "f_suffix",
]


def feature_sql(rates: dict[str, float], default: float, dialect: str = "spark") -> dict[str, str]:
    """Lexical features over the columns url, host and path. ``rates``: how often a last host label
    was blocked among the labelled URLs."""
    n = "greatest(length(host), 1)"
    chars = "regexp_extract_all(host, '(?s).', 0)"
    if dialect == "spark":
        share = f"((length(host) - length(replace(host, c, ''))) / CAST({n} AS DOUBLE))"
        entropy = f"aggregate(array_distinct({chars}), CAST(0 AS DOUBLE), (a, c) -> a - {share} * ln({share}))"
        longest = "array_max(transform(split(host, '[.]'), x -> length(x)))"
    else:
        share = f"((length(host) - length(replace(host, c, ''))) / CAST({n} AS DOUBLE))"
        entropy = f"list_sum(list_transform(list_distinct({chars}), lambda c: -{share} * ln({share})))"
        longest = "list_max(list_transform(string_split(host, '.'), lambda x: length(x)))"
    suffixes = " ".join(f"WHEN '{s}' THEN {gbdt._literal(r)}" for s, r in sorted(rates.items()))
    suffix = "regexp_extract(host, '([^.]*)$', 1)"
    query = "regexp_extract(url, '[?]([^#]*)', 1)"
    return {
        "f_length": "CAST(length(url) AS DOUBLE)",
        "f_host_length": "CAST(length(host) AS DOUBLE)",
        "f_depth": _count_sql("path", "/"),
        "f_digits": f"({_only_sql('url', '0-9', dialect)} / greatest(length(url), 1))",
        "f_host_digits": f"({_only_sql('host', '0-9', dialect)} / {n})",
        "f_entropy": f"coalesce(round({entropy}, 6), CAST(0 AS DOUBLE))",
        "f_params": f"({_count_sql(query, '&')} + CASE WHEN {query} = '' THEN 0 ELSE 1 END)",
        "f_query": f"CAST(length({query}) AS DOUBLE)",
        "f_hyphens": _count_sql("host", "-"),
        "f_labels": _count_sql("host", "."),
        "f_escapes": _count_sql("url", "%"),
        "f_at": _count_sql("url", "@"),
        "f_longest": f"CAST(coalesce({longest}, 0) AS DOUBLE)",
        "f_suffix": f"CASE {suffix} {suffixes} ELSE {gbdt._literal(default)} END" if rates else gbdt._literal(default),
    }


def measured(url: str, rates: dict[str, float], default: float) -> list[float]:
    """The features of one URL, in the order of FEATURES."""
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    n = max(len(low), 1)
    query = m[1] if (m := re.search(r"[?]([^#]*)", url)) else ""
    shares = [c / n for c in Counter(low).values()]
    digits = lambda s: len(re.sub("[^0-9]", "", s))
    labels = low.split(".")
    return [
        len(url), len(low), path.count("/"), digits(url) / max(len(url), 1), digits(low) / n, round(-sum(p * math.log(p) for p in shares), 6), query.count("&") + bool(query),
        len(query), low.count("-"), low.count("."), url.count("%"), url.count("@"), max(map(len, labels)), rates.get(labels[-1], default),
    ]


def training_urls(n: int = TRAINING_URLS, seed: int = SEED) -> list[tuple[str, int]]:
    """Labelled URLs made by rule: ordinary sites (0), and the shapes that link farms, tracking
    chains and throw-away hosts have (1)."""
    r = random.Random(seed)
    syllables = [c + v + e for c in "bdfghklmnprstvw" for v in "aeiou" for e in ("", "n", "r", "s")]
    word = lambda a=1, b=3: "".join(r.choice(syllables) for _ in range(r.randint(a, b)))
    junk = lambda a, b: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(a, b)))
    good_suffix, any_suffix = ["com", "org", "net", "edu", "de", "fr", "es", "io"], ["com", "net", "org", "info", "biz", "top", "xyz", "click"]
    out = []
    for i in range(n):
        if i % 2 == 0:
            host = ".".join([*([r.choice(["www", "m", "blog", "docs", word()])] if r.random() < 0.6 else []), word(2, 4), *(["example"] if r.random() < 0.3 else []), r.choice(good_suffix)])
            path = "/" + "/".join(r.choice([word(), str(r.randint(1, 9999)), "en", "de", "fr", "es"]) for _ in range(r.randint(0, 3)))
            tail = r.choice(["", "", "", "/", ".html", "?page=2&ref=x", "?id=7", "#top", "?utm_source=feed"])
            shape = r.random()
            if shape < 0.15:
                # Hyphens in the host, of projects and places; dated pages with words in their names.
                host = ".".join([*r.choice([["www"], ["blog"], ["docs"], []]), "-".join(word(1, 2) for _ in range(r.randint(2, 3))), r.choice(["org", "de", "fr", "net", "io", "edu"])])
                path = f"/{r.randint(1998, 2026)}/{r.randint(1, 12):02d}/{r.randint(1, 28):02d}/" + "-".join(word().capitalize() for _ in range(r.randint(1, 6))) + r.choice(["", f"-{r.randint(0, 9)}.{r.randint(0, 99)}.0"])
                tail = r.choice(["", "/", ".html"])
            elif shape < 0.25:
                # Numbers in names of schools, cities and products, under the domains of countries.
                host = ".".join([r.choice(["www", "intranet", word()]), r.choice([f"{word(1, 2)}-{word(1, 2)}{r.randint(1, 99)}", f"{word(1, 3)}{r.randint(1, 99)}", f"{r.randint(1, 99)}{word(1, 2)}"]), r.choice(["fr", "de", "es", "uk", "it", "pl", "jp", "edu", "com"])])
        else:
            shape = r.randint(0, 3)
            if shape == 0:
                host = "-".join(word(1, 2) for _ in range(r.randint(2, 4))) + r.choice(["", ".example"]) + "." + r.choice(any_suffix)
            elif shape == 1:
                host = f"{junk(12, 28)}.{r.choice(any_suffix)}"
            elif shape == 2:
                host = ".".join(str(r.randint(1, 255)) for _ in range(4))
            else:
                host = ".".join([*(word() for _ in range(r.randint(3, 5))), word() + str(r.randint(10, 9999)), r.choice(any_suffix)])
            if shape == 0 and r.random() < 0.6:
                host = r.choice(["www.", "m."]) + host
            path = "/" + "/".join(r.choice([word(), str(r.randint(1, 9999)), "en", junk(6, 16)]) for _ in range(r.randint(0, 6)))
            tail = r.choice(["", "", ".html", "?utm_source=feed", "?page=2&ref=x", "?" + "&".join(f"{word()}={junk(3, 20)}" for _ in range(r.randint(2, 8))), "%20%3D" + junk(3, 9)])
        out.append((f"{r.choice(['http', 'https'])}://{host}{path}{tail}", i % 2))
    return out


class UrlModel:
    """Trees and suffix rates fitted from (url, label) pairs, label 1 for what is to be blocked."""

    def __init__(self, labelled: list[tuple[str, int]], precision: float = 0.995) -> None:
        self.default = (sum(y for _, y in labelled) + 1) / (len(labelled) + 2)
        hosts = [u.partition("://")[2].split("/")[0].split("?")[0].split("#")[0].lower() for u, _ in labelled]
        by: dict[str, list[int]] = {}
        for host, (_, y) in zip(hosts, labelled, strict=True):
            if (suffix := host.rpartition(".")[2]).isalpha() and suffix.isascii():
                by.setdefault(suffix, []).append(y)
        self.rates = {s: round((sum(v) + 10 * self.default) / (len(v) + 10), 6) for s, v in by.items() if len(v) >= 20}
        x = self._measure([u for u, _ in labelled])
        y = np.array([y for _, y in labelled], dtype=float)
        held = np.arange(len(y)) % 5 == 4
        self.trees = gbdt.fit(x[~held], y[~held])
        raw = self.trees.raw(x[held])
        self.threshold = round(gbdt.threshold_for(raw, y[held], precision), 6)
        self.accuracy = float(np.mean((raw >= self.threshold) == y[held])) if held.any() else 0.0

    def _measure(self, urls: list[str]) -> np.ndarray:
        """Features of the training list, as ``feature_sql`` has them."""
        return np.array([measured(u, self.rates, self.default) for u in urls], dtype=float).reshape(-1, len(FEATURES))


@cache
def default_model() -> UrlModel:
    return UrlModel(training_urls())


def _with_rules(rows: DataFrame, rules) -> DataFrame:
    """Add rule and its verdict to rows with host and path, by a table of rules: each pair of host and
    path is taken once, its suffixes of whole labels and its prefixes of the lengths that rules have are
    looked up, and of the rules found the longest is kept."""
    spark = rows.sparkSession
    parts = [(*rule.partition("/"), rule, verdict) for verdict, rule in rules]
    told = json.dumps([{"rule_host": h, "rule_path": slash + p, "rule": rule, "verdict": verdict, "size": len(rule)} for h, slash, p, rule, verdict in parts])
    listed = spark.range(1).select(F.inline(F.from_json(F.lit(told), "array<struct<rule_host:string,rule_path:string,rule:string,verdict:string,size:int>>")))
    lengths = sorted({len(slash + p) for _, slash, p, _, _ in parts})
    pairs = rows.select("host", "path").distinct()
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = pairs.withColumn("rule_host", F.explode(suffixes)).withColumn("length", F.explode(F.array(*[F.lit(n) for n in lengths])))
    keyed = keyed.where(F.length("path") >= F.col("length")).withColumn("rule_path", F.expr("left(path, length)"))
    best = keyed.join(listed, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max(F.struct("size", "rule", "verdict")).alias("best"))
    # Written first, so that the join has two plain sides and can split a pair that very many rows have.
    best = materialise(best.select("host", "path", "best.rule", "best.verdict"))
    return rows.join(best, ["host", "path"], "left")


def judge(pages: DataFrame, model: UrlModel, *, url: str = "url", rules=RULES, to: str = "url_verdict") -> DataFrame:
    """Add ``to`` (struct host, path, rule, score, verdict) to every row.

    A null url, and one without ``://``, has empty host and path; no rule fits them, and the trees
    judge them as they stand. Of two rules of one length and text the first counts. Repeated rows are
    judged one by one; other columns stay, but a column ``to`` is replaced. No rules, or an empty table,
    are no error.
    """
    rules = list({rule: (verdict, rule) for verdict, rule in reversed(rules)}.values())
    features = feature_sql(model.rates, model.default)
    # Every step is a struct of its own, so no column of ``pages`` can clash with a feature.
    inner = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_in"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    inner = inner.withColumns({k: F.expr(v) for k, v in parts_sql("url").items()})
    if len(rules) > MOST_RULES:
        inner = _with_rules(inner, rules)
    else:
        rule, verdict = rule_sql(rules)
        inner = inner.withColumn("rule", F.expr(rule)).withColumn("verdict", F.expr(verdict))
    inner = inner.withColumns({k: F.expr(v) for k, v in features.items()})
    inner = inner.withColumn("score", F.expr(f"1 / (1 + exp(-({model.trees.sql(FEATURES)})))"))
    cut = 1 / (1 + np.exp(-model.threshold))
    judged = F.struct("host", "path", "rule", "score", F.coalesce("verdict", F.when(F.col("score") >= float(cut), "block").otherwise("allow")).alias("verdict"))
    return inner.select(*[F.col(f"_in.`{c}`") for c in pages.columns if c != to], judged.alias(to))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"), default_model())
    return judged.select("page_id", *[F.col(f"url_verdict.{c}").alias(c) for c in ("host", "path", "rule", "verdict")])


def op8_sql() -> str:
    """Hosts, paths and rules in a wording of their own; what the trees say, by the fitted trees."""
    model = default_model()
    features = feature_sql(model.rates, model.default, "duckdb")
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
r AS (SELECT page_id, url, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, url, split_part(split_part(split_part(rest, '/', 1), '?', 1), '#', 1) AS raw, rest FROM r),
p AS (SELECT page_id, url, translate(raw, '{_UP}', '{_LOW}') AS host, split_part(split_part(substr(rest, length(raw) + 1), '?', 1), '#', 1) AS path FROM h),
t AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
      ('block', 'net', '/es/'), ('block', 'net', '/fr/')) v(verdict, rule_host, rule_path)),
m AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS said
      FROM p JOIN t ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path) GROUP BY page_id),
f AS (SELECT page_id, host, path, {", ".join(f"{features[k]} AS {k}" for k in FEATURES)} FROM p)
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN {model.trees.sql(FEATURES)} >= {model.threshold}e0 THEN 'block' ELSE 'allow' END) AS verdict
FROM f LEFT JOIN m USING (page_id)
"""
