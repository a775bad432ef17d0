"""Secrets, told apart by who owns them.

Patterns propose candidates: the base kinds (assignments, access keys, long hexadecimal strings), and
looser ones (key blocks, passwords in addresses, bearer tokens, tokens with a known prefix, signed
tokens, opaque strings). The hash of every candidate's value is counted over the whole corpus by
distinct owners and repositories. A value that many of them hold is an example that was copied; one
that looks made up is a placeholder; one that looks random and belongs to few is live. Base spans
always stay, and of the looser candidates the live ones are added.

Texts are read once. What is shuffled are hashes and offsets, never values or texts.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import bound_batches, documents_of, fresh, materialise

BASE = ("assign", "access", "hex")
MORE = ("pem", "userinfo", "bearer", "github", "gitlab", "slack", "stripe", "google", "jwt", "opaque")
KINDS = BASE + MORE
#: A value of more owners or repositories than these is a copied example.
MOST_OWNERS = 2
MOST_REPOSITORIES = 5
LEAST_ENTROPY = 3.0
#: Values with at least one in so many candidates are joined by broadcast; there are no more of them than that.
HOT = 512


def _any_case(words: str) -> str:
    """The pattern, with its ASCII letters in either case and no other letters that fold to them."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


#: Patterns are written for linear scans, and so that an engine without look-around reads them alike.
ASSIGN = f"({_any_case('password')}|{_any_case('passwd')}|{_any_case('secret')}|{_any_case('token')}|{_any_case('api')}_?{_any_case('key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"
PEM = "-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\\x20\\x09-\\x0D]{64,}-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----"
USERINFO = "://[^\\x00-\\x20:/@]{1,64}:([^\\x00-\\x20:/@]{3,128})@"
BEARER = "[Bb]earer\\x20+([A-Za-z0-9_.+/~-]{16,}={0,2})"
#: Maximal strings that the kinds below are looked for in, whole but for full stops and hyphens at the end.
TOKEN = "[A-Za-z0-9_.+/~-]{16,}={0,2}"
FORMATS = {
    "github": "gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}",
    "gitlab": "glpat-[A-Za-z0-9_-]{20,}",
    "slack": "xox[abeoprs]-[A-Za-z0-9-]{10,}",
    "stripe": "[rs]k_live_[A-Za-z0-9]{16,}",
    "google": "AIza[A-Za-z0-9_-]{35}",
    "jwt": "eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}",
}
#: Opaque strings hold digits and letters of both cases, nothing of a name or path, and no words.
OPAQUE = "[A-Za-z0-9_+/-]{20,}={0,2}"
OPAQUE_HAS = ("[0-9]", "[a-z]", "[A-Z]")
OPAQUE_LACKS = "[a-z]{8}|[A-Z]{8}|(?:[A-Z][a-z]{3,}){2}|[a-z]{4}_|_[a-z]{4}|//|/[a-z]{4}|[0-9]{12}"
#: What a made-up value holds, in lower case.
MADE_UP = ("example", "sample", "dummy", "placeholder", "changeme", "redacted", "your", "xxxx", "12345678", "abcdefgh", "00000000", "ffffffff")

_ASSIGN, _ACCESS, _HEX, _PEM, _USERINFO, _BEARER, _TOKEN = map(re.compile, (ASSIGN, ACCESS, HEX, PEM, USERINFO, BEARER, TOKEN))
_FORMATS = {kind: re.compile(x) for kind, x in FORMATS.items()}
_OPAQUE, _HAS, _LACKS = re.compile(OPAQUE), [re.compile(x) for x in OPAQUE_HAS], re.compile(OPAQUE_LACKS)

Found = tuple[str, int, int, str]


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    """Whether a value looks random: no word of made-up values, and as much entropy as its length allows."""
    low = value.lower()
    return not any(w in low for w in MADE_UP) and round(entropy(value), 9) >= min(LEAST_ENTROPY, 0.7 * math.log2(len(value)))


def token_kind(token: str) -> str | None:
    """The kind of a token: that of its format, opaque, or none."""
    for kind, pattern in _FORMATS.items():
        if pattern.fullmatch(token):
            return kind
    if _OPAQUE.fullmatch(token) and all(p.search(token) for p in _HAS) and not _LACKS.search(token):
        return "opaque"
    return None


def candidates(text: str) -> list[Found]:
    """(kind, start, end, value) of all candidates, by start and kind. Base kinds are all there; of the
    others, those that overlap no base span and no candidate of an earlier group: key blocks, passwords in
    addresses, bearer tokens, tokens."""
    groups: list[list[Found]] = [
        [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8],
        [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16] if "AKIA" in text else [],
        [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)],
        [("pem", m.start(), m.end(), m[0]) for m in _PEM.finditer(text)] if "PRIVATE KEY" in text else [],
        [("userinfo", m.start(), m.end(), m[1]) for m in _USERINFO.finditer(text)] if "://" in text else [],
        [("bearer", m.start(), m.end(), m[1]) for m in _BEARER.finditer(text)] if "earer" in text else [],
        [],
    ]
    for m in _TOKEN.finditer(text):
        token = m[0].rstrip(".-")
        if kind := token_kind(token):
            groups[-1].append((kind, m.start(), m.start() + len(token), token))
    starts = [[x[1] for x in group] for group in groups]

    def overlaps(first: int, past: int, before: int) -> bool:
        """Spans of one group don't overlap, so the last that begins before ``past`` ends last."""
        return any((i := bisect_left(starts[g], past)) and groups[g][i - 1][2] > first for g in range(before))

    out = [x for group in groups[:3] for x in group]
    out += [x for g in range(3, len(groups)) for x in groups[g] if not overlaps(x[1], x[2], g)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


_FIELDS = [("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("key", pa.string()), ("random", pa.bool_())]
_KIND = "array<struct<start:bigint,rank:int,end:bigint,key:string,random:boolean>>"


def _scanner():
    arrow = pa.list_(pa.struct(_FIELDS))

    @F.arrow_udf(_KIND)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for scalar in batch:
                found = candidates(scalar.as_py() or "")
                rows.append([(a, KINDS.index(kind), b, blake2b(value.encode(), digest_size=16).hexdigest(), looks_live(value)) for kind, a, b, value in found])
            yield pa.array(rows, arrow)

    return scanned


def frequencies(found: DataFrame, key: str, owner: str, repository: str) -> DataFrame:
    """Rows, distinct owners and distinct repositories (of an owner each) of every key; a null owner or
    repository counts as one more. Each step adds up what the one before has left of a key, so that a key
    with a third of all rows is counted where its rows are."""
    by_repository = found.groupBy(key, owner, repository).agg(F.count("*").alias("n_rows"))
    by_owner = by_repository.groupBy(key, owner).agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_repositories"))
    return by_owner.groupBy(key).agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_owners"), F.sum("n_repositories").alias("n_repositories"))


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(documents: DataFrame, *, owner: str, repository: str, text: str = "text", to: str = "secrets", keep_text: bool = False, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Add ``to`` to every row: ``found`` (all candidates with kind, offsets, the hash of the value, how
    many owners and repositories have it, and the verdict: live, copied or placeholder), and the lists
    ``base`` and ``spans`` (base spans and live ones) as text.

    The text goes, unless ``keep_text``; other columns stay, but a column ``to`` is replaced. A null text
    is empty and holds nothing; offsets count code points. Null owners, and null repositories, count as one
    more each. Repeated rows are found one by one, and count once as owners and repositories. An empty
    table stays empty.
    """
    bound_batches(documents)
    got, row = fresh(documents, "_got", "_row")
    scanned = documents.withColumn(got, _scanner()(F.col(text))).withColumn(row, F.monotonically_increasing_id())
    # Written once: row numbers hold from here on, and texts aren't read again.
    scanned = materialise(scanned if keep_text else scanned.drop(text))
    each = scanned.select(F.col(row).alias("row"), F.col(owner).alias("owner"), F.col(repository).alias("repository"), F.inline(got))
    counts = materialise(frequencies(each, "key", "owner", "repository"))
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    # At most HOT keys have at least one in HOT of all candidates each.
    hot = F.broadcast(counts.where(F.col("n_rows") * HOT >= total))
    each = each.drop("owner", "repository")
    judged = each.join(hot, "key").unionByName(each.join(hot, "key", "left_anti").join(counts.where(F.col("n_rows") * HOT < total), "key"))
    copied = (F.col("n_owners") > most_owners) | (F.col("n_repositories") > most_repositories)
    verdict = F.when(~F.col("random"), "placeholder").when(copied, "copied").otherwise("live")
    span = F.struct("start", "rank", "end", "key", "n_owners", "n_repositories", verdict.alias("verdict"))
    # A row's own candidates come together, never those of a key.
    by_row = judged.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(span)).alias(got))
    out = scanned.drop(got).join(by_row, row, "left")
    found = F.coalesce(F.col(got), F.array().cast(by_row.schema[got].dataType))
    base = F.filter(found, lambda s: s["rank"] < len(BASE))
    spans = F.filter(found, lambda s: (s["rank"] < len(BASE)) | (s["verdict"] == "live"))
    kinds = F.array(*map(F.lit, KINDS))
    named = F.transform(found, lambda s: F.struct(F.get(kinds, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["key"].alias("key"), s["n_owners"].alias("n_owners"), s["n_repositories"].alias("n_repositories"), s["verdict"].alias("verdict")))
    return out.withColumn(to, F.struct(named.alias("found"), _listed(base).alias("base"), _listed(spans).alias("spans"))).drop(*{row, got} - {to})


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document. A source is an owner, and its documents of one language are a repository."""
    documents = documents_of(spark, sf_dir, "doc_id", "text", F.col("source").alias("owner"), F.concat_ws("/", "source", F.coalesce("lang", F.lit("?"))).alias("repository"))
    found = find_secrets(documents, owner="owner", repository="repository")
    each = F.col("secrets.found")
    count = lambda field, value: F.size(F.filter(each, lambda s: s[field] == value)).cast("bigint")
    return found.select(
        "doc_id",
        *[count("kind", kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(F.col("secrets.base"), 256).alias("base_sha256"),
        F.col("secrets.spans").alias("spans"),
        *[count("verdict", v).alias(f"n_{v}") for v in ("live", "copied", "placeholder")],
    )


def _op12_sql() -> str:
    """Matches are marked, and their places are the lengths of what stands before them."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def spans(group: int, pattern: str) -> str:
        return f"""SELECT r, {group} AS grp, first, split_part(piece, chr(57345), 1) AS match FROM (
    SELECT r, k, piece, coalesce(sum(length(replace(piece, chr(57345), ''))) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM (
      SELECT r, generate_subscripts(pieces, 1) AS k, unnest(pieces) AS piece FROM (
        SELECT r, string_split(regexp_replace(t, {quoted(pattern)}, concat(chr(57344), '\\0', chr(57345)), 'g'), chr(57344)) AS pieces FROM d WHERE regexp_matches(t, {quoted(pattern)})))) WHERE k > 1"""

    patterns = (ASSIGN, ACCESS, HEX, PEM, USERINFO, BEARER, TOKEN)
    matches = "\n  UNION ALL ".join(spans(g, p) for g, p in enumerate(patterns))
    formats = " ".join(f"WHEN regexp_full_match(value, {quoted(x)}) THEN {KINDS.index(k)}" for k, x in FORMATS.items())
    has = " AND ".join(f"regexp_matches(value, {quoted(x)})" for x in OPAQUE_HAS)
    made_up = " OR ".join(f"contains(lower(value), {quoted(x)})" for x in MADE_UP)
    names = "[" + ", ".join(map(quoted, KINDS)) + "]"
    listed = f"concat({names}[rank + 1], ':', first, ':', past)"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source AS owner, concat_ws('/', source, coalesce(lang, '?')) AS repository, coalesce(text, '') AS t FROM documents),
m AS (
  {matches}
),
v AS (SELECT r, grp, CAST(first AS BIGINT) AS first, match,
  CASE grp WHEN 0 THEN regexp_extract(match, {quoted(ASSIGN)}, 2) WHEN 4 THEN regexp_extract(match, {quoted(USERINFO)}, 1) WHEN 5 THEN regexp_extract(match, {quoted(BEARER)}, 1)
    WHEN 6 THEN rtrim(match, '.-') ELSE match END AS value FROM m),
k AS MATERIALIZED (SELECT r, grp, first, first + length(CASE WHEN grp = 6 THEN value ELSE match END) AS past, value,
  CASE WHEN grp < 6 THEN grp {formats}
    WHEN regexp_full_match(value, {quoted(OPAQUE)}) AND {has} AND NOT regexp_matches(value, {quoted(OPAQUE_LACKS)}) THEN {KINDS.index("opaque")} END AS rank
  FROM v WHERE NOT (grp = 0 AND length(value) < 8) AND NOT (grp = 1 AND length(value) < 16)),
c AS MATERIALIZED (SELECT *, NOT ({made_up}) AND round(list_aggregate(string_split(value, ''), 'entropy'), 9) >= least({LEAST_ENTROPY}, 0.7 * log2(length(value))) AS random FROM k x
  WHERE rank IS NOT NULL AND NOT (grp > 2 AND EXISTS (SELECT 1 FROM k y WHERE y.rank IS NOT NULL AND y.r = x.r AND y.grp < x.grp AND y.first < x.past AND y.past > x.first))),
f AS (SELECT value, count(DISTINCT {{'o': owner}}) AS n_owners, count(DISTINCT {{'o': owner, 'p': repository}}) AS n_repositories FROM c JOIN d USING (r) GROUP BY value),
j AS (SELECT r, rank, first, past, CASE WHEN NOT random THEN 'placeholder' WHEN n_owners > {MOST_OWNERS} OR n_repositories > {MOST_REPOSITORIES} THEN 'copied' ELSE 'live' END AS verdict FROM c JOIN f USING (value)),
s AS (SELECT r, {", ".join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, k in enumerate(BASE))},
  {", ".join(f"count(*) FILTER (verdict = '{x}') AS n_{x}" for x in ("live", "copied", "placeholder"))},
  string_agg({listed}, ',' ORDER BY first, rank) FILTER (rank < {len(BASE)}) AS base,
  string_agg({listed}, ',' ORDER BY first, rank) FILTER (rank < {len(BASE)} OR verdict = 'live') AS spans FROM j GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in (*BASE, "live", "copied", "placeholder"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (r)"""


OP12_SQL = _op12_sql()
