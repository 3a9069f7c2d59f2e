"""Personal data: fixed patterns, and further spans that a boosted classifier picks from overlapping candidates.

The base patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers, always. Generators of high recall
then propose spans of any digit run, long mixed token, spelled-out address, run of hexadecimal groups, word behind a cue such
as "password" or private-key header, overlapping as they may; boosted trees score each by its format and its context;
thresholds calibrated on held-out candidates for a set precision decide; of overlapping choices the likelier stays, and none
may touch a base span. The trees are fitted on candidates cut from made-up sentences, whose kind is known because they were
made for it: no text of the corpus and no label enters. Time and memory grow with the length of a text, not with its square.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, calibrated_threshold, fit
from .common import no_cache, slices, table, trim

# The base patterns, as :func:`base_spans` finds them.
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#: ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What follows the @ of an address, and runs of dotted numbers: each stretch of text is read once.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
KINDS = ("email", "ip", "card", "phone", "address", "secret", "number", "groups", "cued", "header")
_DIGIT = re.compile(r"[0-9]")
#: Generators of candidates, by the kind that their spans get.
GENERATORS = (
    ("address", re.compile(r"[A-Za-z0-9._%+-]+(?: ?[(\[{] ?(?:at|AT) ?[)\]}] ?| (?:at|AT) )[A-Za-z0-9-]+(?:(?: ?[(\[{] ?(?:dot|DOT) ?[)\]}] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]+)+")),
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+={0,2}")),
    ("number", re.compile(r"(?<![0-9])\(?[0-9][0-9 ().:/-]{5,}[0-9]")),
    ("groups", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    ("cued", re.compile(r"(?i:\b(?:password|passwd|pwd|passphrase|secret|token|api[_ -]?key|auth|bearer))(?: is)?[ =:\"']{1,4}([^\s\"',;]{5,200})")),
    ("header", re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]{0,8000}-----END [A-Z ]{0,30}PRIVATE KEY-----)?")),
)
_CUED = re.compile(r"(?i:passw|pwd|passphrase|secret|token|api[_ -]?key|auth|bearer)")
#: Where a spelled-out "at" of the address generator begins, and the characters before it that belong to the address.
_SPELLED = re.compile(r"(?= ?[(\[{] ?(?:at|AT) ?[)\]}]| (?:at|AT) )")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CUES = {
    "secret": "token key secret password passwd pwd api apikey auth bearer credential access",
    "phone": "phone tel telephone call mobile fax cell telefon tél móvil",
    "identity": "ssn passport iban account license licence id social tax insurance konto cuenta compte",
    "neutral": "page version vol isbn order chapter year line section item build release model price",
}
_CUE = {w: k for k, line in enumerate(CUES.values()) for w in line.split()}
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Before each @ stands a run of local characters, which begins behind the last match; without a domain it is no address."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """In a run of dotted numbers each four are a match, from the left; one whose parts are not all at most 255 is dropped."""
    for m in DOTTED.finditer(text):
        at = m.start()
        parts = m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_byte, four)):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, each kind from left to right; a match that fails its test is dropped."""
    out = [(0, *span) for span in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [(1, *span) for span in _ips(text)] if "." in text else []
    for m in CARD.finditer(text):
        if len(m[0]) <= 37:  # 19 digits and a sign between each two
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(m[0].count, "0123456789")) <= 15]
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """The spans that the address generator's ``finditer`` gives, tried only where a spelled "at" follows."""
    out, done = [], 0
    for m in _SPELLED.finditer(text) if "at" in text or "AT" in text else ():
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = GENERATORS[0][1].match(text, start) if done <= start < m.start() else None
        if found:
            out.append(found.span())
            done = found.end()
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all generators; they may overlap each other and base spans."""
    out = [(4, a, b) for a, b in addresses(text)]
    if _DIGIT.search(text):
        for kind in (5, 6):
            out += [(kind, *m.span()) for m in GENERATORS[kind - 4][1].finditer(text)]
    if text.count(":") > 1:
        out += [(7, *m.span()) for m in GENERATORS[3][1].finditer(text)]
    if _CUED.search(text):
        secrets = {x[1:] for x in out if x[0] == 5}
        out += [(8, *m.span(1)) for m in GENERATORS[4][1].finditer(text) if m.span(1) not in secrets]
    if "-----BEGIN" in text:
        out += [(9, *m.span()) for m in GENERATORS[5][1].finditer(text)]
    return out


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of the span and context around it."""
    s = text[start:end]
    n = len(s)
    chars = Counter(s)
    digits = sum(chars[c] for c in "0123456789")
    letters = sum(k for c, k in chars.items() if c.isalpha())
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    entropy = -sum(k / n * math.log2(k / n) for k in chars.values())
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    cues = [0] * len(CUES)
    for w in _WORD.findall(before.lower())[-4:]:
        if w in _CUE:
            cues[_CUE[w]] += 1
    hexa = sum(chars[c] for c in "0123456789abcdefABCDEF")
    cases = any(c.islower() for c in chars) + 2 * any(c.isupper() for c in chars)
    return [
        kind, n, digits, digits / n, letters / n, hexa / n, entropy, len(groups), max(groups, default=0), min(groups, default=0),
        chars["-"], chars[" "], chars["."], chars["/"], chars[":"], chars["("], chars["["] + chars["{"], chars["@"] > 0, bool(re.search(r"\bat\b|\bAT\b", s)), len(re.findall(r"dot|DOT", s)),
        luhn("".join(c for c in s if "0" <= c <= "9")) if 12 <= digits <= 19 and n < 60 else 0, cases, before[-1:] in ('"', "'"), after[:1] in ('"', "'"), bool(re.search(r"[=:]\s*[\"']?$", before)),
        before[-1:].isalnum(), after[:1].isalnum(), *cues,
    ]


def _sentences(rng: random.Random) -> tuple[str, int, int, int]:
    """A made-up sentence with one thing in it: text, start and end of the thing, 1 if it is personal or secret."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    pick = rng.choice
    hexes = "".join(pick("0123456789abcdef") for _ in range(pick((20, 24, 32, 40, 64))))
    mixed = "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(20, 48)))
    capital = lambda n: "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    access = capital(4) + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(15)) + pick("234567")
    once = capital(rng.randint(6, 18)) + d(1) + capital(rng.randint(2, 10))
    once = pick((access, once, capital(max(0, 19 - len(once))) + once))
    short = "".join(pick("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!$%&*#") for _ in range(rng.randint(6, 14))) + pick("23456789!$%")
    h4 = lambda: "".join(pick("0123456789abcdef") for _ in range(rng.randint(1, 4)))
    secret_cue = pick(("password", "Password", "passwd", "pwd", "passphrase", "secret"))
    cue = lambda k: pick(CUES[k].split())
    made = [
        (f'{cue("secret")}{pick((" = ", "=", ": ", ":"))}"', pick((hexes, mixed, hexes.upper())), '"', 1),
        (f"{w()} {cue('secret')} {pick(('is ', '= ', ''))}", pick((hexes, mixed)), " ", 1),
        (f'{w()} = "', pick((hexes, mixed)), '"', 1),
        (f"{w()} {pick(('', 'key ', 'id ', 'access key '))}", pick((access, once if len(once) > 15 else access, "AKIA" + access[4:])), "", 1),
        (f"{secret_cue}{pick((': ', '=', ' = ', ' is '))}", pick((short, w() + d(3), w().capitalize() + d(2) + pick("!$%"))), "", 1),
        (f"{w()} {secret_cue}{pick((' ', ' is ', ': '))}", w(), "", 0),
        (f"{w()} ", ":".join([h4() for _ in range(8)]), "", 1),
        (f"{w()} ", f"{pick(('2001', 'fe80', 'fd' + d(2)))}:{h4()}::{h4()}{pick(('', ':' + h4()))}", "", 1),
        (f"{w()} ", f"-----BEGIN {pick(('', 'RSA ', 'EC ', 'OPENSSH '))}PRIVATE KEY-----", f" {mixed}", 1),
        ("", f"{w()}{pick((' at ', ' [at] ', ' (at) ', ' AT ', ' {at} ', '(at)', '[at]', '(AT)', '[AT]'))}{w()}{pick((' dot ', ' [dot] ', ' (dot) ', ' DOT ', ' {dot} ', '(dot)', '[dot]', '{dot}', '(DOT)', '[DOT]'))}{pick(('com', 'org', 'net'))}", "", 1),
        ("", f"{w()}{pick((' [at] ', ' (at) ', ' {at} ', '(at)', '[at]', '{at}', '(AT)', '[AT]'))}{w()}.{pick(('com', 'org', 'net'))}", "", 1),
        (f"{cue('phone')} ", pick((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(6)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}")), "", 1),
        (f"{cue('identity')} ", pick((f"{d(3)}-{d(2)}-{d(4)}", f"{d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", d(9))), "", 1),
        (f"{w()} ", pick((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}")), "", 1),
        (f"{cue('neutral')} ", pick((d(7), d(8), f"{d(4)}-{d(4)}", f"{d(2)}.{d(2)}.{d(3)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}")), "", 0),
        (f"{w()} ", pick((f"{pick(('19', '20'))}{d(2)}-0{pick('123456789')}-1{d(1)}", f"1{d(1)}/0{d(1)}/20{d(2)}", f"1{d(1)}:{d(2)}:{d(2)}")), "", 0),
        (f"{w()} ", pick((d(7), d(8), d(10), f"{d(3)} {d(3)} {d(3)}", d(12), d(16), d(20))), "", 0),
        (f"{w()} {w()} ", f"{w()} at {w()}.{w()}", "", 0),
        (f"{w()} ", "-".join([w() for _ in range(4)] + [d(1)]), "", 0),
        (f"{w()} ", f"{d(2)}:{d(2)}:{d(2)}{pick(('', ':' + d(2)))}", "", 0),
        (f"{w()} ", f"{w()}_{w()}_{w()}{d(1)}", "", 0),
        (f"{w()} ", f"{w()}{w()}{w()}{w()}{d(pick((1, 2, 4)))}", "", 0),
        (f"{w()} ", f"{w()}/{w()}/{w()}/{w()}{d(2)}", "", 0),
        (f"{w()} ", f"{w()}{w()}{w()}{d(1)}", "", 0),
    ]
    before, thing, after, label = pick(made)
    lead = " ".join(w() for _ in range(rng.randint(0, 5)))
    text = f"{lead} {before}"
    return f"{text}{thing}{after} {w()} {w()}", len(text), len(text) + len(thing), label


@lru_cache(1)
def model(seed: int = 5, sentences: int = 8000, precision: float = 0.95) -> tuple[Boosted, tuple[float, ...]]:
    """Trees fitted on three quarters of the made-up candidates; thresholds by kind calibrated on the rest.

    A candidate is positive if it covers four fifths of a personal thing and is not much longer.
    """
    rng, rows, labels = random.Random(seed), [], []
    for _ in range(sentences):
        text, start, end, label = _sentences(rng)
        for kind, a, b in candidates(text):
            shared = min(b, end) - max(a, start)
            rows.append(features(text, kind, a, b))
            labels.append(bool(label) and shared >= 0.8 * max(end - start, b - a))
    x, y = np.array(rows, float), np.array(labels, float)
    last = np.arange(len(y)) % 4 == 3
    trees = fit(x[~last], y[~last], trees=80, depth=4)
    p = trees.probability(x[last])
    return trees, tuple(max(0.5, calibrated_threshold(p[x[last, 0] == k], y[last][x[last, 0] == k], precision)) for k in range(4, len(KINDS)))


def find(texts: list[str], fitted: tuple[Boosted, tuple[float, ...]]) -> list[tuple[list, list]]:
    """For each text its base spans and its added spans, both by kind and then start."""
    trees, thresholds = fitted
    bases, rows, where = [], [], []
    for k, text in enumerate(texts):
        bases.append(sorted(base_spans(text)))
        for c in candidates(text):
            rows.append(features(text, *c))
            where.append((k, *c))
    added: list[list] = [[] for _ in texts]
    if rows:
        p = trees.probability(np.array(rows, float))
        taken: dict[int, bytearray] = {}  # for texts with a choice, which characters lie in a span
        for k in np.argsort(-p, kind="stable"):
            doc, kind, a, b = where[k]
            if p[k] >= thresholds[kind - 4]:
                if doc not in taken:
                    taken[doc] = bytearray(len(texts[doc]))
                    for _, x, y in bases[doc]:
                        taken[doc][x:y] = b"\1" * (y - x)
                if taken[doc].find(1, a, b) < 0:
                    taken[doc][a:b] = b"\1" * (b - a)
                    added[doc].append((kind, a, b))
    return [(b, sorted(a)) for b, a in zip(bases, added, strict=True)]


def _told(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list) -> str:
    """Each span, or run of overlapping spans, becomes the upper-case name of its first kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


FOUND = "struct<n_email:long,n_ip:long,n_card:long,n_phone:long,n_added:long,n_spans:long,base_sha256:string,spans:string,redacted:string>"


def pii(text: Column) -> Column:
    """A struct of counts, digests, spans and the redacted text (null where nothing was found) for a column of texts.

    ``n_added`` counts the spans that the method adds, ``n_spans`` all. Defined results: a null or empty text has no spans;
    texts of any length are searched whole, in time that grows with their length; rows are independent of each other, so
    that repeated ones get equal results; an empty table stays empty.
    """
    fitted = model()

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        no_cache()
        kinds = [pa.int64()] * 6 + [pa.string()] * 3
        names = ["n_email", "n_ip", "n_card", "n_phone", "n_added", "n_spans", "base_sha256", "spans", "redacted"]
        try:
            for column in batches:
                rows = []
                for part in slices(column):
                    values = [t.decode() for t in part]
                    for t, (base, added) in zip(values, find(values, fitted), strict=True):
                        n = Counter(k for k, _, _ in base)
                        spans = sorted(base + added)
                        rows.append((n[0], n[1], n[2], n[3], len(added), len(spans), hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans), redact(t, spans) if spans else None))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        finally:
            trim()

    return run(text)


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced; all rows, other columns and null texts stay.

    Defined results: repeated rows are treated alike; an empty table stays empty; columns of any name are carried along, but
    for ``__pii``, which is reserved.
    """
    found = docs.withColumn("__pii", pii(F.col(text_col)))
    new = F.coalesce(F.col("__pii.redacted"), F.col(text_col)).alias(text_col)
    return found.select(*[new if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", pii(F.col("text")).alias("p")).select("doc_id", "p.*").drop("redacted")
