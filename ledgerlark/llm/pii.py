"""Personal data: overlapping candidate spans, boosted trees, calibrated thresholds.

Generators propose spans with high recall and may overlap: the four base patterns, and looser ones
for addresses written out, phone numbers without a plus sign, keys and tokens, IPv6 addresses,
account numbers and social security numbers. Boosted trees score every candidate of a loose
generator from its format (length, digits, entropy, separators, checksums) and its context (words
around it); a candidate above its kind's calibrated threshold becomes a span. Spans of the base
patterns always stay. Trees and thresholds are fitted on the driver from a seeded, bounded list of
made-up examples in context, positive and negative.

Every pattern runs in linear time, so very long texts are read whole.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import gbdt
from ledgerlark.llm.common import bound_batches, documents_of

BASE = ("email", "ip", "card", "phone")
MORE = ("email_text", "phone_local", "secret", "ipv6", "iban", "ssn")
KINDS = BASE + MORE
_RANK = {k: i for i, k in enumerate(KINDS)}
#: Made-up examples per loose kind and class.
EXAMPLES = 1_200
PRECISION = 0.97
SEED = 7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

_EMAIL_TEXT = re.compile(r"(?<![\w.+-])[A-Za-z0-9._+-]{1,64}+(?: ?[\[({] ?at ?[\])}] ?| at )[A-Za-z0-9-]{1,63}+(?:(?: ?[\[({] ?dot ?[\])}] ?| dot )[A-Za-z0-9-]{1,63}+)+", re.IGNORECASE)
_PHONE_LOCAL = re.compile(r"(?<![\w+.-])(?:\(?[0-9]{2,5}\)?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,5}){1,4}|[0-9]{3}-[0-9]{4})(?![\w-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{16,}+(?![A-Za-z0-9_])")
_IPV6 = re.compile(r"(?<![\w:])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
#: Characters of account numbers by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21,
    "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24,
    "SI": 19, "SK": 24,
}
#: Countries whose account numbers begin with letters for the bank.
_LETTERS = {"BG": 4, "GB": 4, "IE": 4, "LV": 4, "MT": 4, "NL": 4, "RO": 4}
_SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_LOOSE = {"email_text": _EMAIL_TEXT, "phone_local": _PHONE_LOCAL, "secret": _SECRET, "ipv6": _IPV6, "iban": _IBAN, "ssn": _SSN}
_CUES = {
    "email_text": ("mail", "contact", "write", "reach"),
    "phone_local": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "bearer", "auth", "credential"),
    "ipv6": ("ip", "host", "address", "server", "client"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security", "number", "tax"),
}
#: Words that speak against personal data, whatever the kind.
_AGAINST = ("sha1", "sha2", "sha5", "md5", "digest", "hash", "blob", "revision", "order", "case", "part", "ref", "isbn", "version", "invoice", "page", "serial", "model", "build", "commit", "checksum", "sample", "chapter", "table")
_WORD = re.compile(r"[^\W_]+")
_LOWER_RUN = re.compile(r"[a-z]+")
#: How keys of well-known services begin, and how common domains end.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "sk_live_", "rk_live_", "pk_live_", "AIza", "xoxb", "xoxp", "glpat", "npm_", "hf_")
DOMAINS = frozenset("com org net edu gov io co info biz dev app ai me eu uk us ca au de fr es it nl be ch at pl pt se no dk fi ie jp cn in br mx ru".split())
#: Hyphened as a social security number: area, group and serial that are given out.
_GIVEN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")


def iban_holds(bare: str) -> bool:
    """Whether an account number without blanks has the length of its country and the right check digits."""
    if len(bare) != IBAN_LENGTHS.get(bare[:2], 0) or not (bare.isalnum() and bare.isascii()):
        return False
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def ipv6_holds(span: str) -> bool:
    """Eight groups, or fewer with one gap."""
    groups = span.split(":")
    if "::" not in span:
        return len(groups) == 8 and all(groups)
    ends = span.startswith(":") and not span.startswith("::") or span.endswith(":") and not span.endswith("::")
    return span.count("::") == 1 and ":::" not in span and not ends and sum(map(bool, groups)) <= 7


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from each at sign back over local characters not yet taken, then the domain."""
    at, taken = text.find("@"), 0
    while at >= 0:
        first = at
        while first > taken and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at)):
            yield first, m.end()
            taken = m.end()
        else:
            taken = at + 1
        at = text.find("@", max(taken, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, leftmost and not overlapping within a kind, by start and kind."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NO_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    out.sort(key=lambda s: (s[1], _RANK[s[0]]))
    return out


FEATURE_NAMES = ("length", "digits", "letters", "upper", "entropy", "separators", "groups", "switches", "hex", "vowels", "cue", "quoted", "assigned", "checksum", "distinct", "ending", "against", "prefix", "run")


def features(kind: str, text: str, first: int, past: int) -> list[float]:
    """Format of a candidate, and its context: a cue word within the eight words or 80 characters
    before it, quotes around it, an assignment before it."""
    span = text[first:past]
    n = len(span)
    counts, groups = Counter(span), _WORD.findall(span)
    digits = sum(map(str.isdigit, span))
    letters = sum(map(str.isalpha, span))
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    before = text[max(0, first - 80) : first]
    words = [w.lower() for w in _WORD.findall(before)[-8:]]
    near = before.rstrip()[-3:]
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in span]
    checksum = kind == "iban" and iban_holds(span.replace(" ", "")) or kind == "ipv6" and ipv6_holds(span) or kind == "email_text" and groups[-1].lower() in DOMAINS or kind == "ssn" and _GIVEN.fullmatch(span) is not None
    return [
        float(n),
        digits / n,
        letters / n,
        sum(map(str.isupper, span)) / n,
        entropy,
        float(n - digits - letters),
        float(len(groups)),
        sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / n,
        sum(c in "0123456789abcdefABCDEF" for c in span) / n,
        sum(c in "aeiouAEIOU" for c in span) / n,
        float(any(w.startswith(c) for w in words for c in _CUES[kind])),
        float(before[-1:] in "\"'`" and text[past : past + 1] in "\"'`" and bool(before)),
        float(any(c in "=:" for c in near)),
        float(checksum),
        len(counts) / n,
        float(len(groups[-1]) if groups else 0),
        float(any(w.startswith(c) for w in words for c in _AGAINST)),
        float(span.startswith(PREFIXES)),
        float(max(map(len, _LOWER_RUN.findall(span)), default=0)),
    ]


def _examples(kind: str, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of made-up candidates: half personal data, half look-alikes."""
    r = random.Random(f"{seed}:{kind}")
    syllables = [c + v for c in "bdfghklmnprstw" for v in "aeiou"]
    word = lambda a=1, b=4: "".join(r.choice(syllables) for _ in range(r.randint(a, b)))
    pick = lambda alphabet, a, b: "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))
    num = lambda k: pick("0123456789", k, k)
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    piece = lambda: pick("bcdfghjklmnprstvwxz", 1, 3) + pick("aeiouy", 1, 2) + pick("chlnrst", 0, 2)

    def hard_words() -> list[str]:
        """Compounds and names with as many consonants as a key may have: in lower case, with one capital, with several, with a number."""
        many = [piece() for _ in range(r.randint(5, 9))]
        plain = "".join(many)
        return [plain, plain.capitalize(), plain.upper(), "".join("".join(many[k : k + 2]).capitalize() for k in range(0, len(many), 2)), plain + num(r.randint(1, 4))]

    rows, labels = [], []
    while len(rows) < 2 * n:
        y = len(rows) % 2
        # Neither a cue nor its lack decides: some personal data have none, and some look-alikes have one,
        # though few of those that look just like personal data.
        ending = r.choice([": ", " = ", " ", "=", " is "])
        chance = r.random()
        if chance < (0.75 if y else 0.03 if kind in ("ssn", "phone_local") else 0.2):
            lead = f"{word()} {r.choice(_CUES[kind])}{ending}"
        elif chance < (0.78 if y else 0.6):
            lead = f"{word()} {r.choice(_AGAINST)}{ending}"
        else:
            lead = f"{word()} {word()}{r.choice([' ', ending])}"
        if kind == "email_text":
            at, dot = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), ("at", "dot"), ("{at}", "{dot}")])
            local = word() + r.choice(["", ".", "_"]) + r.choice(["", word(), num(2)])
            end = r.choice(sorted(DOMAINS)) if y else word(1, 6)
            if not y and end in DOMAINS:
                continue
            span = f"{local} {at} {word()} {dot} {end}"
        elif kind == "phone_local":
            if y:
                span = r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{num(2)} {num(3)} {num(4)}", f"0{num(3)} {num(3)} {num(3)}", f"{num(3)}-{num(4)}"])
                if len(span) == 8 and chance >= 0.75:
                    continue  # seven digits without a cue may be anything
            else:
                span = r.choice([f"{num(4)}-{num(2)}-{num(4)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(2)} {num(2)} {num(3)}", f"{num(3)}-{num(4)}", f"{num(2)} {num(3)} {num(3)} {num(3)}", f"{num(4)} {num(4)} {num(4)} {num(4)}"])
                if len(span) == 8 and chance < 0.03:
                    continue
        elif kind == "secret":
            quote = r.choice(['"', "'", ""])
            if y:
                span = r.choice([pick(hexa, 32, 64), pick(alnum, 20, 64), r.choice([*PREFIXES, "", "", ""]) + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" if r.random() < 0.5 else alnum, 16, 36), r.choice(PREFIXES) + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 14, 30) + num(r.randint(0, 2))])
                lead = lead if any(w.startswith(a) for w in map(str.lower, _WORD.findall(lead)) for a in _CUES[kind]) or r.random() < 0.6 else f"{word()} "
                if any(w.startswith(a) for w in map(str.lower, _WORD.findall(lead)) for a in _AGAINST):
                    lead = f"{word()} "
                lead += quote
            elif r.random() < 0.35:
                # Digests look just like keys; what names them speaks against these.
                lead = f"{word()} {r.choice(['commit', 'sha256', 'sha1', 'md5', 'checksum', 'digest', 'build', 'revision', 'hash', 'blob'])}{r.choice([' ', ': ', '=', ' = '])}"
                span = pick(hexa, 32, 64)
            else:
                span = r.choice([word(9, 30), "_".join(word(2, 4) for _ in range(r.randint(4, 8))), r.choice("ab0x_") * r.randint(17, 80), word(6, 9) + word(8, 12).upper() + num(2), num(r.randint(16, 20)), "".join(word(1, 3).capitalize() for _ in range(r.randint(4, 7))), *hard_words()])[:180]
        elif kind == "ipv6":
            groups = [pick(hexa, 1, 4) for _ in range(8)]
            gap = r.randint(0, 5)
            short = ":".join(groups[:gap]) + "::" + ":".join(groups[gap + 2 :])
            span = r.choice([":".join(groups), short, "::1" if r.random() < 0.1 else "fe80::" + ":".join(groups[:4]), "2001:db8::" + groups[0]]) if y else r.choice([":".join(num(2) for _ in range(r.choice([3, 3, 4, 6, 8]))), ":".join(pick(hexa, 2, 2) for _ in range(6)), f"{num(1)}:{num(2)}:{num(2)}", "::".join(word(1, 1)[:1] for _ in range(3)), ":" * 3])
        elif kind == "iban":
            country = r.choice(sorted(IBAN_LENGTHS))
            letters = _LETTERS.get(country, 0)
            bban = pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", letters, letters) + num(IBAN_LENGTHS[country] - 4 - letters)
            check = 98 - int("".join(str(int(c, 36)) for c in f"{bban}{country}00")) % 97
            span = f"{country}{check:02d}{bban}" if y else r.choice([f"{country}{(check + r.randint(1, 90)) % 97:02d}{bban}", f"{pick('ABCDEFG', 2, 2)}{num(2)}{pick('ABCDEFGH0123456789', 16, 16)}"])
            if r.random() < 0.5:
                span = " ".join(span[k : k + 4] for k in range(0, len(span), 4))
        else:
            span = f"{num(3)}-{num(2)}-{num(4)}"
            if bool(_GIVEN.fullmatch(span)) != bool(y) and (y or r.random() < 0.5):
                span = f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}" if y else f"{r.choice(['000', '666', '9' + num(2)])}-{num(2)}-{num(4)}"
        tail = (lead[-1:] if lead[-1:] in "\"'" else "") + " " + word()
        if not (m := _LOOSE[kind].search(text := lead + span + tail)):
            continue
        rows.append(features(kind, text, m.start(), m.end()))
        labels.append(y)
    return np.array(rows), np.array(labels, dtype=float)


@cache
def default_models() -> dict[str, tuple[gbdt.Boosted, float]]:
    """Trees and threshold (log-odds) of each loose kind. Thresholds are the least that reach PRECISION
    on examples that the trees have not seen; a kind that can't reach it proposes nothing."""
    out = {}
    for kind in MORE:
        x, y = _examples(kind, EXAMPLES, SEED)
        held = np.arange(len(y)) // 2 % 3 == 2
        model = gbdt.fit(x[~held], y[~held], trees=25, depth=3)
        out[kind] = (model, gbdt.threshold_for(model.raw(x[held]), y[held], PRECISION))
    return out


def _apart(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Loose spans without those that lie within a longer one of another kind, as a part of an account
    number may look like a phone number."""
    out: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0] == "secret", _RANK[s[0]])):
        if not out or b > out[-1][2] or kind == out[-1][0]:
            out.append((kind, a, b))
    return out


def find(text: str, models: dict[str, tuple[gbdt.Boosted, float]]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans. A loose candidate that overlaps a base span adds nothing."""
    base = base_spans(text)
    more: list[tuple[str, int, int]] = []
    for kind, pattern in _LOOSE.items():
        if kind == "email_text" and "at" not in text and "AT" not in text and "At" not in text:
            continue
        if kind == "ipv6" and ":" not in text:
            continue
        model, threshold = models[kind]
        for m in pattern.finditer(text):
            if model.raw_one(features(kind, text, m.start(), m.end())) >= threshold:
                more.append((kind, m.start(), m.end()))
    if more:
        taken, i, past = sorted((a, b) for _, a, b in base), 0, -1
        kept = []
        for kind, a, b in sorted(_apart(more), key=lambda s: s[1]):
            while i < len(taken) and taken[i][0] < b:
                past = max(past, taken[i][1])
                i += 1
            if past <= a:
                kept.append((kind, a, b))
        more = kept
    return base, sorted(base + more, key=lambda s: (s[1], _RANK[s[0]]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


_COUNTS = [f"n_{k}" for k in BASE]


def _finder(redact: bool):
    models = default_models()
    kind = "struct<" + ",".join(f"{c}:bigint" for c in _COUNTS) + ",base:string,spans:string" + ",redacted:string" * redact + ">"
    arrow = pa.struct([(c, pa.int64()) for c in _COUNTS] + [("base", pa.string()), ("spans", pa.string())] + [("redacted", pa.string())] * redact)

    @F.arrow_udf(kind)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for scalar in batch:
                value = scalar.as_py()
                base, spans = find(value or "", models)
                counts = Counter(k for k, _, _ in base)
                row = {f"n_{k}": counts[k] for k in BASE} | {"base": listed(base), "spans": listed(spans)}
                if redact:
                    row["redacted"] = redacted(value, spans) if spans else value
                out.append(row)
            yield pa.array(out, arrow)

    return found


def find_personal_data(documents: DataFrame, *, text: str = "text", redact: bool = False, to: str = "personal") -> DataFrame:
    """Add ``to`` (counts and lists of spans and, with ``redact``, the redacted text) to every row.

    A null text is searched as the empty text, holds nothing and stays null when redacted. Offsets
    count code points. Repeated rows are searched one by one; other columns stay, but a column
    ``to`` is replaced. An empty table stays empty.
    """
    bound_batches(documents)
    return documents.withColumn(to, _finder(redact)(F.col(text)))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents_of(spark, sf_dir, "doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.col(f"personal.{c}").alias(c) for c in _COUNTS],
        F.sha2(F.col("personal.base"), 256).alias("base_sha256"),
        F.col("personal.spans").alias("spans"),
    )
