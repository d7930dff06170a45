"""Personal data by weak supervision.

1. Candidates: spans that look like an e-mail address, IP address (version 4 or 6), social-security number, IBAN, card
   or account number, phone number (7 to 15 digits, with or without separators), street address, or a person's name
   (capitalised words after a form of address or a given name of the gazetteer). Texts without a digit, an at sign, a
   colon as in an address or two capitalised words in a row are passed over in the JVM.
2. Labelers vote on each span yes, no or not at all: the strict expression of its kind, a gazetteer (mail domains,
   number ranges, reserved addresses, given names), a checksum or structure test, and the words around it.
3. Expectation-maximisation estimates, for each kind by itself, each labeler's hit and false-alarm rate and the share of
   true spans, from the counts of all vote patterns over all documents. These counts are a small table, whatever the input.
4. A logistic regression on features of the span and its surroundings, none of them a vote, is trained on at most
   SAMPLE spans with the estimated probabilities as targets. It gives each span its score; SCORE and more is PII.

Defined results. Null and empty texts have no spans. Places count Unicode code points. Spans don't overlap: the one
that begins first is taken, and of two kinds the first in the order above; a name gives way to any other kind. Repeated rows are each reported, and equal
surroundings give equal scores. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import PATTERNS
from .exchange import materialise, small_batches

KINDS = ("email", "ip", "ipv6", "ssn", "iban", "account", "phone", "street", "name")
_H = "[0-9A-Fa-f]{1,4}"
CANDIDATE = re.compile(
    r"(?P<email>(?<![^\s@<>()\[\],;:\"'])[^\s@<>()\[\],;:\"']+@[^\s@<>()\[\],;:\"']+\.[^\W\d_]{2,})"
    r"|(?<![\w.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\.?\w)"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    rf"|(?<![\w:.])(?P<ipv6>::(?:{_H}:){{0,5}}\d{{1,3}}(?:\.\d{{1,3}}){{3}}|(?:{_H}:){{2,7}}{_H}|(?:{_H}:){{1,7}}:(?:{_H}(?::{_H}){{0,6}})?|::{_H}(?::{_H}){{0,6}})(?![\w:])"
    r"|(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?<![\w.])(?P<account>\d(?:[ -]*\d){12,18})(?![\w]|\.\d)"
    r"|(?<!\w)(?<!\d\.)(?P<phone>(?=(?:[\s.()+-]{0,3}\d){7})(?:\+?\d{1,3}[\s.-]?(?:\(0\)[\s.-]?)?(?:\d[\s.-])?)?(?:\(?\d{2,4}\)?[\s.-]?){2,4}\d{2,4})(?!\w|\.\d)"
    rf"|(?P<street>(?i:{PATTERNS['street_address'][1]}))"
)
#: What each candidate but a name has.
_MARKS = re.compile(r"[@\d]|[A-Fa-f]:|::")
SAMPLE = 50_000
FEATURES = 1 << 12
SCORE = 0.5
EPOCHS = 5
LABELERS = ("expression", "gazetteer", "structure", "context")

_ADDRESSED = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sr|Sra|Don|Doña)"
_UPPER = "A-ZÀ-ÖØ-Þ"
#: Capitalised words in a row.
_NAMES = re.compile(rf"(?<!\w)[{_UPPER}][^\W\d_]*\.?(?:[ \t\n]+[{_UPPER}](?:\.|[^\W\d_]*(?:['-][^\W\d_]+)*))+")
_TITLE = re.compile(rf"{_ADDRESSED}\.?")


def plain(name: str) -> str:
    """In small letters, without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c))


_GIVEN = set(
    plain(
        "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua kenneth "
        "kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel "
        "gregory frank alexander raymond patrick jack dennis jerry tyler aaron jose henry adam douglas nathan peter zachary kyle walter ethan jeremy harold "
        "keith christian roger noah gerald carl terry sean austin arthur lawrence jesse dylan bryan mary patricia jennifer linda elizabeth barbara susan "
        "jessica sarah karen nancy lisa betty margaret sandra ashley kimberly emily donna michelle dorothy carol amanda melissa deborah stephanie rebecca "
        "sharon laura cynthia kathleen amy shirley angela helen anna brenda pamela nicole emma samantha katherine christine debra rachel catherine carolyn "
        "janet ruth maria heather diane virginia julie joyce victoria olivia kelly christina lauren joan evelyn judith megan cheryl andrea hannah martha "
        "jacqueline frances gloria teresa kathryn sara janice jean alice madison doris abigail julia judy grace denise amber marilyn beverly danielle theresa "
        "sophia marie diana brittany natalie isabella charlotte rose jane hans peter klaus jürgen wolfgang günter heinz uwe bernd dieter horst manfred stefan "
        "andreas matthias sebastian tobias florian lukas jonas felix maximilian moritz ursula monika petra sabine renate helga karin brigitte ingrid claudia "
        "susanne katharina johanna lena leonie friedrich wilhelm gerhard jean pierre michel philippe alain jacques bernard rené andré françois louis nicolas "
        "julien olivier guillaume antoine camille chloé léa manon marie nathalie isabelle sylvie catherine françoise valérie sandrine véronique céline élodie "
        "aurélie hélène antonio manuel francisco juan javier carlos miguel alejandro rafael pedro ángel luis jorge sergio pablo diego fernando alberto álvaro "
        "carmen josefa isabel dolores pilar cristina lucía mercedes rosario raquel elena silvia beatriz rocío sofía mohammed ahmed ali fatima omar hassan yusuf "
        "aisha wei li ming hiroshi yuki kenji priya raj amit anjali ivan olga natasha dmitri sergei giovanni luca marco giulia francesca "
    ).split()
)
_NO_NAME = set("january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday street avenue road city county beach river lake island university college school church company inc ltd corp license public general north south east west new the and of in".split())

_STRICT = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"),
    "ip": re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"),
    "ssn": re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"),
    "ipv6": re.compile(rf"(?:{_H}:){{7}}{_H}|(?=.*\d)(?:{_H}:){{2,6}}(?::{_H}){{1,5}}|(?=.*\d)(?:{_H}:){{1,6}}(?::{_H}){{2,5}}|::(?:{_H}:){{0,5}}\d{{1,3}}(?:\.\d{{1,3}}){{3}}"),
    "iban": re.compile(r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"),
    "account": re.compile(r"\d{13,19}|\d{4}(?:(?:[ -]| - )\d{4}){2,3}(?:[ -]| - )\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}"),
    "phone": re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){2,4}|(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\+\d{1,3}[\s.-]?(?:\(0\)[\s.-]?)?\(?\d{1,4}\)?(?:[\s.-]?\d{2,4}){1,4}|\(\d{2,4}\)[\s.-]?\d{5,8}|0\d{1,4}[\s.-]\d{5,8}|(?:\+?1[\s.-]?)?[2-9]\d{2}[\s.-]?\d{3}[\s.-]?\d{4}"),
    "name": re.compile(rf"(?:{_ADDRESSED}\.?\s+)?[^\W\d_a-z][^\W\d_]+(?:\s+[^\W\d_a-z](?:\.|[^\W\d_]*[a-zà-ÿ][^\W\d_]*(?:['-][^\W\d_]+)*))+|{_ADDRESSED}\.?\s+[^\W\d_a-z][^\W\d_]+"),
    "street": re.compile(r"[1-9]\d{0,5}(?:\s+(?:[NSEW]\.?|[A-Z][A-Za-z.'-]*|\d{1,3}(?:st|nd|rd|th))){1,5}"),
}
_DOMAINS = {"gmail", "yahoo", "hotmail", "outlook", "icloud", "aol", "gmx", "web", "mail", "proton", "protonmail", "live", "msn", "orange", "yandex"}
_NO_TLD = {"png", "jpg", "jpeg", "gif", "svg", "webp", "js", "css", "html", "php"}
_FOR = {
    "email": {"email", "mail", "contact", "write", "reply", "correo", "courriel", "kontakt"},
    "ip": {"ip", "address", "host", "client", "login", "from", "logged"},
    "ipv6": {"ip", "ipv6", "address", "host", "client", "login", "from", "logged"},
    "iban": {"iban", "account", "bank", "bic", "swift", "transfer", "konto", "compte", "cuenta"},
    "street": {"address", "live", "lives", "living", "at", "home", "street", "ship", "mail", "deliver", "visit", "resides"},
    "ssn": {"ssn", "social", "security"},
    "name": {"name", "named", "called", "signed", "sincerely", "regards", "dear", "by", "author", "contact", "mr", "mrs", "ms", "dr", "born", "says", "said", "wrote", "met", "patient", "employee", "student", "nombre", "nom", "heißt"},
    "account": {"card", "visa", "mastercard", "amex", "account", "iban", "credit", "debit", "karte", "carte", "tarjeta", "konto"},
    "phone": {"phone", "tel", "telephone", "call", "fax", "mobile", "cell", "dial", "telefon", "téléphone", "teléfono"},
}
_AGAINST = {"version", "v", "release", "isbn", "issn", "doi", "page", "pages", "pp", "vol", "rfc", "iso", "section", "figure", "table", "order", "sku", "build", "commit", "sha", "token", "hash", "id", "uuid", "between", "years"}
_COMMON = {"a", "an", "and", "are", "as", "at", "by", "for", "from", "he", "in", "is", "it", "no", "not", "of", "on", "or", "out", "she", "that", "the", "they", "this", "to", "was", "we", "were", "with", "you"}
_WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_ok(span: str) -> bool:
    """The remainder by 97 of the number that an IBAN stands for is 1."""
    code = span.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def surroundings(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The last three words before, the first two after, within 40 characters, in lower case."""
    return _WORD.findall(text[max(0, start - 40) : start].lower())[-3:], _WORD.findall(text[end : end + 40].lower())[:2]


def votes(kind: str, span: str, before: list[str], after: list[str]) -> tuple[int, ...]:
    """1 yes, 0 no, -1 none, in the order of LABELERS."""
    digits = re.sub(r"\D", "", span)
    strict = int(bool(_STRICT[kind].fullmatch(span)))
    known, built = -1, -1
    if kind == "email":
        host = span.rpartition("@")[2].lower().split(".")
        known = 0 if host[-1] in _NO_TLD else 1 if any(h.rstrip("0123456789") in _DOMAINS for h in host) else -1
        built = 0 if ".." in span or len(host[-1]) > 12 else 1
    elif kind == "ip":
        parts = [int(p) for p in span.split(".")]
        known = 0 if parts[0] in (0, 127) or parts == [255] * 4 or parts[:2] == [192, 0] else -1
        built = int(max(parts) <= 255 and not (parts[0] < 4 and max(parts) < 20))
    elif kind == "ipv6":
        try:
            address = ipaddress.IPv6Address(span)
            known = 0 if address.is_loopback or address.is_unspecified or span.lower().startswith("2001:db8:") else 1 if address.is_global else -1
            built = int(any(c.isdigit() for c in span) or span.count(":") == 7)
        except ValueError:
            built = 0
    elif kind == "iban":
        built = int(iban_ok(span))
    elif kind == "street":
        known = 0 if set(_WORD.findall(span.lower())) & _COMMON else -1
        built = int(all(w[:1].isupper() or w[:1].isdigit() for w in span.split()))
    elif kind == "name":
        said = _WORD.findall(span.lower())
        known = 0 if set(said) & _NO_NAME else 1 if re.match(rf"{_ADDRESSED}\b", span) or plain(said[0]) in _GIVEN else -1
        built = int(len(said) >= 2 and len(set(said)) == len(said) and not span.isupper())
    elif kind == "ssn":
        known = 0 if digits in ("078051120", "219099999", "123456789") else -1
        built = int(len(set(digits)) > 2)
    elif kind == "account":
        known = 1 if digits[0] in "3456" else -1
        built = 0 if len(set(digits)) < 3 else 1 if luhn(digits) else -1
    else:
        known = 1 if span.startswith("+") or re.match(r"\(\d{3}\)", span) else 0 if re.fullmatch(r"(?:1[5-9]|20)\d\d[ .-](?:1[5-9]|20)?\d\d|\d{4}-\d\d-\d\d|\d\d[.-]\d\d[.-]\d{4}|\d+\.\d+|(?:19|20)\d{6}(?:\d{6})?", span) else -1
        built = int(7 <= len(digits) <= 15)
    near = set(before) | set(after)
    context = 1 if near & _FOR[kind] else 0 if near & _AGAINST else -1
    return strict, known, built, context


def features(kind: str, span: str, before: list[str], after: list[str]) -> list[int]:
    """Hashed features, kind first."""
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "9", span))
    said = [f"k={kind}", f"{kind} s={shape}", f"{kind} n={len(span) // 4}", f"{kind} d={len(set(re.sub(r'\D', '', span)))}", f"{kind} p={span[:1]}", f"{kind} l={span[-3:] if kind == 'email' else ''}"]
    said += [f"{kind} b={w}" for w in before[-2:]] + [f"{kind} a={w}" for w in after[:1]]
    return sorted({zlib.crc32(s.encode()) % FEATURES for s in said})


def person_names(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of capitalised words that begin with a form of address or a given name, four at most."""
    for run in _NAMES.finditer(text):
        words = [(run.start() + m.start(), run.start() + m.end()) for m in re.finditer(r"\S+", run[0])]
        k = 0
        while k < len(words) - 1:
            first = text[words[k][0] : words[k][1]]
            if _TITLE.fullmatch(first) or plain(first) in _GIVEN:
                last = min(len(words), k + 4) - 1
                yield words[k][0], words[last][1]
                k = last + 1
            else:
                k += 1


def spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of each candidate, in order."""
    held = [m for m in (CANDIDATE.finditer(text) if _MARKS.search(text) else ()) if m.lastgroup != "phone" or 7 <= sum(c.isdigit() for c in m[0]) <= 15]
    names = list(person_names(text))
    if not names:
        for m in held:
            yield m.lastgroup, m.start(), m.end()
        return
    begun, i = [(m.start(), m.end(), m.lastgroup) for m in held], 0
    for start, end in names:
        while i < len(held) and held[i].end() <= start:
            i += 1
        if i == len(held) or held[i].start() >= end:
            begun.append((start, end, "name"))
    for start, end, kind in sorted(begun):
        yield kind, start, end


def reliabilities(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 200) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """For each kind the share of true spans, each labeler's hit rate, its false-alarm rate; by EM under weak Beta priors."""
    out = {}
    for kind in sorted({k for k, _ in counts}):
        held = sorted((p, c) for (k, p), c in counts.items() if k == kind)
        v, n = np.array([p for p, _ in held]), np.array([c for _, c in held], float)
        share, hit, alarm = 0.7, np.full(v.shape[1], 0.9), np.full(v.shape[1], 0.2)
        for _ in range(rounds):
            q = _posterior(v, share, hit, alarm)
            share = ((n * q).sum() + 7) / (n.sum() + 10)
            said, yes = n[:, None] * (v >= 0), n[:, None] * (v == 1)
            hit = ((yes * q[:, None]).sum(0) + 9) / ((said * q[:, None]).sum(0) + 10)
            alarm = ((yes * (1 - q[:, None])).sum(0) + 2) / ((said * (1 - q[:, None])).sum(0) + 10)
        out[kind] = share, hit, alarm
    return out


def _posterior(v: np.ndarray, share: np.ndarray | float, hit: np.ndarray, alarm: np.ndarray) -> np.ndarray:
    yes = np.log(share) + np.where(v == 1, np.log(hit), np.where(v == 0, np.log(1 - hit), 0)).sum(axis=1)
    no = np.log(1 - share) + np.where(v == 1, np.log(alarm), np.where(v == 0, np.log(1 - alarm), 0)).sum(axis=1)
    return 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))


def fit_spans(rows: list[list[int]], targets: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a logistic regression on soft targets, by AdaGrad with a small ridge."""
    w, g2 = np.zeros(FEATURES), np.full(FEATURES, 1e-2)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            g = 1 / (1 + np.exp(-w[at].sum())) - targets[i] + 1e-4 * w[at]
            g2[at] += g * g
            w[at] -= 0.3 * g / np.sqrt(g2[at])
    return w


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, kind, start, end, votes, features of each span."""
    schema = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for kind, start, end in spans(text):
                    around = surroundings(text, start, end)
                    span = text[start:end]
                    out.append((doc, kind, start, end, votes(kind, span, *around), features(kind, span, *around)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema)], schema=schema)

    some = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.rlike("text", F.lit(r"(?U)[@\d]|[A-Fa-f]:|::|[A-ZÀ-ÖØ-Þ]\p{L}*\.?[ \t\n]+[A-ZÀ-ÖØ-Þ]")))
    return some.mapInArrow(run, "doc_id long, kind string, start long, end long, votes array<int>, features array<int>")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kind, start, end, score of every span that scores SCORE or more; see the module's text for edge cases."""
    found = materialise(candidates(docs, id_col, text_col), "spans")
    counts = {(k, tuple(v)): n for k, v, n in found.groupBy("kind", "votes").count().collect()}
    known = reliabilities(counts)

    total = sum(counts.values())
    cut = min(1 << 30, int((1 << 30) * SAMPLE * 1.1 / max(1, total)) + 1)
    drawn = found.where(F.shiftrightunsigned(F.xxhash64("doc_id", "start", F.lit(3)), 34) < cut).orderBy(F.xxhash64("doc_id", "start", F.lit(3)), "doc_id", "start", "features").limit(SAMPLE).select("kind", "votes", "features").repartition(1)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(zip(*(sum((b.column(i).to_pylist() for b in held), []) for i in range(3)))) if (held := list(batches)) else []
        if rows:
            share, hit, alarm = (np.array(x) for x in zip(*(known[k] for k, _, _ in rows)))
            q = _posterior(np.array([v for _, v, _ in rows]), share, hit, alarm)
            yield pa.RecordBatch.from_pydict({"w": [fit_spans([f for _, _, f in rows], q).tobytes()]})

    got = drawn.mapInArrow(train, "w binary").collect() if total else []
    shared = docs.sparkSession.sparkContext.broadcast(np.frombuffer(got[0]["w"]) if got else np.zeros(FEATURES))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            p = 1 / (1 + np.exp(-np.array([w[f].sum() for f in b.column(4).to_pylist()], float)))
            out = pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(p)], ["doc_id", "kind", "start", "end", "score"])
            yield out.filter(pa.array(p >= SCORE))

    return found.select("doc_id", "kind", "start", "end", "features").mapInArrow(score, "doc_id long, kind string, start long, end long, score double")
