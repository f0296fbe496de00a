"""Personal data: regex, gazetteer and context labelers vote, EM weighs them and trains a span classifier."""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, pieces, small_batches

KINDS = ("email", "ip", "card", "phone", "name", "secret")
#: A candidate that no base pattern found is added from this probability on.
THRESHOLD = 0.8

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin at the first digit of a run and always takes whole runs, hence the look-behind and `++`.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Wider forms, from which only voting makes spans.
AT = re.compile(r"(?<![\w.%+-])([A-Za-z0-9._%+-]{1,64}) ?(?:\[at\]|\(at\)| at ) ?([A-Za-z0-9-]{1,63}(?:(?:\.| dot |\[dot\]|\(dot\))[A-Za-z0-9-]{1,63}){1,6})(?!\w)")
V6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![\w:])")
LOOSE_PHONE = re.compile(r"(?<![\w+.-])\(?0?[0-9]{2,5}\)?[\x20./-][0-9]{2,5}(?:[\x20./-][0-9]{2,5}){1,3}(?![\w.-])")
SECRET = re.compile(r"(?<![\w+/=.-])[A-Za-z0-9+/_=-]{20,}+(?!\w)")
NAME = re.compile(r"(?<!\w)([A-Z][a-z]{2,14}) ([A-Z][a-z]{2,20})(?!\w)")

#: Gazetteers: common top-level domains, given names, card issuer prefixes, calling codes, beginnings of issued keys.
TLDS = frozenset(
    "com org net edu gov mil int info biz io ai app dev xyz online site shop club eu uk us ca mx ar br cl co pe ve de at ch li fr be lu nl es pt it gr mt ie is no se dk fi ee lv lt pl cz sk hu si hr rs ba me mk al bg ro md ua by ru ge am az kz uz tr il ae sa qa kw ir iq in pk bd lk np cn hk tw jp kr th vn my sg id ph au nz za ng ke gh eg ma tn dz".split()
)
GIVEN = frozenset(
    "Anna Maria Peter Paul John James Mary Robert Michael William David Richard Joseph Thomas Charles Linda Susan Jessica Sarah Karen Nancy Lisa Daniel Matthew Anthony Mark Andrew Steven Kevin Brian George Edward Ronald Jason Jennifer Elizabeth Barbara Patricia Margaret Sandra Ashley Emily Laura Emma Olivia Sophia Hannah Jacob Ethan Noah Liam Lucas Henry Oliver Jack Harry Alice Grace Hans Klaus Jürgen Stefan Wolfgang Ursula Monika Petra Sabine Heike Birgit Katrin Julia Lena Leon Felix Jonas Lukas Jan Tim Uwe Dieter Helmut Jean Pierre Michel Philippe Marie Nathalie Isabelle Sophie Camille Julien Nicolas Antoine Chantal Hélène Claire Élodie Luc Louis Hugo José Antonio Manuel Carmen Josefa Dolores Pilar Juan Carlos Luis Javier Miguel Rafael Sofía Lucía Elena Pablo Diego Fernando Marta Ana Teresa Alberto Sergio Jorge Raquel".split()
)
KEY_STARTS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "eyJ", "ssh-")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "22", "23", "24", "25", "26", "27")
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 81 86 90 91".split())
#: Words before a span that speak for its kind, and such as speak against any.
FOR = {
    "email": re.compile(r"(?i)e-?mail|contact|kontakt|write to|correo|courriel|address"),
    "ip": re.compile(r"(?i)\bip\b|host|server|address|adresse|client|remote"),
    "card": re.compile(r"(?i)card|visa|master|karte|tarjeta|carte|cc\b"),
    "phone": re.compile(r"(?i)tel|phone|call|fax|mobil|anruf|appel|llam"),
    "secret": re.compile(r"(?i)(token|secret|passw|pwd|api.?key|bearer|auth|credential|private|access|clave|schlüssel|jeton)\w*\W{0,6}$"),
    "name": re.compile(r"(?i)\bmr|mrs|ms\b|\bdr\b|herr|frau|señor|monsieur|madame|name|dear"),
}
AGAINST = re.compile(r"(?i)token|hash|version|isbn|order|invoice|sku|serial|sha|id\s*[=:]|[=#/_]\s*$")
#: Words right before a long string by which it is no secret.
PUBLIC = re.compile(r"(?i)(sha-?\d*|md5|hash|checksum|digest|commit|revision|uuid|version|etag|href|src|url)\W{0,6}$")
#: Buckets of the word before a span, which the classifier sees by a hash.
WORDS = 32
#: What each place of a vote string stands for.
LABELERS = ("base pattern", "format", "gazetteer", "context for", "context against", "edges")
SPAN = "struct<kind:int,start:int,end:int,votes:string,shape:string>"


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards, so that long runs of letters cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns by kind and start; matches that fail their test are dropped."""
    out = [(0, s, e) for s, e in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def wide_spans(text: str) -> list[tuple[int, int, int]]:
    """Further candidates of every kind."""
    out = [(0, *m.span()) for m in AT.finditer(text)] if "at" in text else []
    if ":" in text:
        out += [(1, *m.span()) for m in V6.finditer(text)]
    for m in CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and not (len(d) >= 16 and luhn(d)):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in LOOSE_PHONE.finditer(text)]
    out += [(4, *m.span()) for m in NAME.finditer(text) if m[1] in GIVEN]
    out += [(5, *m.span()) for m in SECRET.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    return out


def votes(text: str, kind: int, start: int, end: int, base: bool) -> str:
    """A vote of each labeler: + for personal data, - against, 0 for none."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    digits = _digits(span)
    name = KINDS[kind]
    if name == "email":
        form = "+" if base or re.search(r"dot|\.", span) else "-"
        listed = "+" if re.split(r"\.|dot|[^A-Za-z]", span)[-1].lower() in TLDS else "-"
    elif name == "ip":
        form = "+" if base or span.count(":") == 7 or "::" in span else "-"
        listed = "0" if base else "+" if span[:4].lower() in ("2001", "fe80", "2a00", "2a01", "2a02", "2600", "2400") else "-"
    elif name == "card":
        form = "+" if luhn(digits) else "-"
        listed = "+" if digits.startswith(ISSUERS) else "-"
    elif name == "phone":
        form = "+" if 8 <= len(digits) <= 15 else "-"
        listed = "+" if base and any(digits.startswith(c) for c in CALLING) or not base and digits.startswith("0") else "0" if base else "-"
    elif name == "secret":
        classes = sum(bool(re.search(c, span)) for c in ("[a-z]", "[A-Z]", "[0-9]"))
        form = "+" if re.fullmatch("(?i)[0-9a-f]{32,}", span) or classes == 3 and not re.search("[/_-]{1}[a-z]+[/_-]", span) else "-"
        listed = "+" if span.startswith(KEY_STARTS) else "0"
    else:
        form, listed = "0", "+"
    near = "+" if FOR[name].search(before) else "0" if base else "-"
    bad = "-" if (PUBLIC.search(before) if name == "secret" else AGAINST.search(before[-16:])) else "0"
    inside = (start > 0 and (text[start - 1].isalnum() or text[start - 1] == "_")) or (end < len(text) and (text[end].isalnum() or text[end] == "_"))
    return "".join(("+" if base else "0", form, listed, near, bad, "-" if inside else "+"))


def shape(text: str, start: int, end: int) -> str:
    """What the classifier sees of the span and its context besides the votes: digits, separators and length in a few
    steps, the kinds of letters, and the bucket of the word before."""
    span = text[start:end]
    seps = (" " in span) + 2 * ("-" in span or "." in span or "/" in span)
    letters = any(c.islower() for c in span) + 2 * any(c.isupper() for c in span)
    word = re.findall(r"[^\W\d_]+", text[max(0, start - 24) : start].lower())[-1:]
    return f"{min(5, sum(c.isdigit() for c in span) // 4)}{seps}{min(5, (end - start) // 6)}{letters}{chr(65 + zlib.crc32(word[0].encode()) % WORDS) if word else '-'}"


def candidates(text: str) -> tuple[list[tuple], list[tuple]]:
    """Base spans and further candidates that overlap none of them, each (kind, start, end, votes, shape)."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    ends, top = [], 0
    for _, e in taken:
        top = max(top, e)
        ends.append(top)
    begins = np.array([s for s, _ in taken], np.int64)

    def free(s: int, e: int) -> bool:
        k = int(np.searchsorted(begins, e))
        return k == 0 or ends[k - 1] <= s

    row = lambda k, s, e, own: (k, s, e, votes(text, k, s, e, own), shape(text, s, e))
    return [row(*x, True) for x in base], [row(*x, False) for x in wide_spans(text) if free(*x[1:])]


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("shape", pa.string())]))
    names = ("kind", "start", "end", "votes", "shape")
    for b in pieces(batches):
        found = [candidates(t or "") for t in b.column(1).to_pylist()]
        cols = [pa.array([[dict(zip(names, x, strict=True)) for x in f[i]] for f in found], kind) for i in range(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "base", "wide"])


def estimate(patterns: list[tuple[int, str, int]], rounds: int = 60) -> dict[tuple[int, str], float]:
    """The probability of personal data for each (kind, votes), by expectation-maximisation over counted patterns.

    Labelers vote independently given the truth; each has its own chances of +, 0 and - for either truth and kind.
    The first guess is the majority of the votes.
    """
    out: dict[tuple[int, str], float] = {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = [(v, n) for k, v, n in patterns if k == kind]
        x = np.array([["+0-".index(c) for c in v] for v, _ in own])
        n = np.array([c for _, c in own], float)
        one = np.eye(3)[x]  # pattern, labeler, vote
        lean = (x == 0).sum(axis=1) - (x == 2).sum(axis=1)
        q = 1 / (1 + np.exp(-1.5 * lean))
        for _ in range(rounds):
            w = np.stack([n * (1 - q), n * q])
            chance = np.einsum("cp,plv->clv", w, one) + np.array([[[0.5, 1, 1.5]], [[1.5, 1, 0.5]]])
            chance /= chance.sum(axis=2, keepdims=True)
            prior = (w.sum(axis=1) + 1) / (n.sum() + 2)
            logs = np.log(prior)[:, None] + np.einsum("plv,clv->cp", one, np.log(chance))
            new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -40, 40)))
            if np.abs(new - q).max() < 1e-9:
                break
            q = new
        out |= {(kind, v): float(p) for (v, _), p in zip(own, q, strict=True)}
    return out


def _features(kind: int, vote: str, form: str) -> list[str]:
    return [f"{kind}", *(f"{kind}:{i}{c}" for i, c in enumerate(vote)), *(f"{kind}/{i}{c}" for i, c in enumerate(form))]


class SpanClassifier:
    """Logistic regression on votes and shape by kind."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def probability(self, kind: int, vote: str, form: str) -> float:
        z = sum(self.weights.get(f, 0.0) for f in _features(kind, vote, form))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(patterns: list[tuple[int, str, str, int]], votes: list[tuple[int, str, int]] | None = None, steps: int = 400) -> SpanClassifier:
    """Fit the classifier to the labelers' weighed votes. patterns: (kind, votes, shape, count); votes: (kind, votes,
    count) over all candidates, those of patterns unless given."""
    if not patterns:
        return SpanClassifier({})
    patterns = sorted(patterns)
    merged: dict[tuple[int, str], int] = {}
    for k, v, n in votes or [(k, v, n) for k, v, _, n in patterns]:
        merged[k, v] = merged.get((k, v), 0) + n
    truth = estimate([(k, v, n) for (k, v), n in sorted(merged.items())])
    rows = [_features(k, v, s) for k, v, s, _ in patterns]
    index = {f: i for i, f in enumerate(sorted({f for r in rows for f in r}))}
    flat, owner = np.array([index[f] for r in rows for f in r]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    y = np.array([truth[k, v] for k, v, _, _ in patterns])
    weight = np.sqrt(np.array([n for *_, n in patterns], float))
    weight /= weight.sum()
    w, m, s = (np.zeros(len(index)) for _ in range(3))
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[flat], len(rows)), -40, 40)))
        g = np.bincount(flat, (weight * (p - y))[owner], len(index)) + 1e-5 * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
    return SpanClassifier({f: float(w[i]) for f, i in index.items()})


def apart(spans: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of those spans (start, end, kind) that overlap none taken before them. What is taken is kept
    in order, so that each is compared with its neighbours alone."""
    starts: list[int] = []
    taken: list[tuple[int, int, int]] = []
    for s, e, k in spans:
        i = bisect.bisect_left(starts, s)
        if (i == 0 or taken[i - 1][2] <= s) and (i == len(starts) or starts[i] >= e):
            starts.insert(i, s)
            taken.insert(i, (k, s, e))
    return taken


#: Patterns of votes and shape that the classifier is fitted on at most, the most frequent ones.
PATTERNS = 20_000


def find_spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, base, added) per row of docs: arrays of spans (kind, start, end), code points, end exclusive.

    Base spans are those of the fixed patterns and always stay. Wider patterns give further candidates; labelers vote
    on all of them, the votes are counted over the whole table, EM weighs the labelers on those counts (at most 216 votes
    a kind), and a classifier, fitted on the PATTERNS most frequent pairs of votes and shape, which also sees the word
    before the span, adds candidates of at least `threshold`; of overlapping ones the likelier, then the earlier.
    A very long text is searched whole, in one task; its spans are held there at once. Null and empty texts have no spans. Repeated rows
    are searched each, an empty table gives an empty result, and other columns are ignored. One pass over the texts,
    no shuffle of them.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = cut_lineage(own.mapInArrow(_extract, f"doc_id long, base array<{SPAN}>, wide array<{SPAN}>"))
    counted = found.select(F.explode(F.concat("base", "wide")).alias("x")).groupBy("x.kind", "x.votes", "x.shape").agg(F.count("*").alias("n"))
    votes = [tuple(r) for r in counted.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()]
    model = train([tuple(r) for r in counted.orderBy(F.desc("n"), "kind", "votes", "shape").limit(PATTERNS).collect()], votes)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, float] = {}
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            base, wide = b.column(1).to_pylist(), b.column(2).to_pylist()
            added = []
            for spans in wide:
                good = []
                for x in spans:
                    key = (x["kind"], x["votes"], x["shape"])
                    if key not in known:
                        known[key] = model.probability(*key)
                    if known[key] >= threshold:
                        good.append((-known[key], x["start"], x["end"], x["kind"]))
                added.append([{"kind": k, "start": s, "end": e} for k, s, e in sorted(apart((s, e, k) for _, s, e, k in sorted(good)))])
            plain = [[{k: x[k] for k in ("kind", "start", "end")} for x in spans] for spans in base]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(plain, kind), pa.array(added, kind)], names=["doc_id", "base", "added"])

    span = "array<struct<kind:int,start:int,end:int>>"
    return found.mapInArrow(judge, f"doc_id long, base {span}, added {span}")


def redact(text: str, spans: Iterable[tuple[int, int, int]]) -> str:
    """The text with each span (kind, start, end) replaced by its kind in angle brackets; the first of overlapping ones wins."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
            at = e
    return "".join([*out, text[at:]])


def listed(spans) -> str:
    """kind:start:end joined by commas, by kind as listed and then start."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for base, added in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            own = [(x["kind"], x["start"], x["end"]) for x in base]
            more = [(x["kind"], x["start"], x["end"]) for x in added]
            rows.append((*(sum(k == i for k, _, _ in own) for i in range(4)), hashlib.sha256(listed(own).encode()).hexdigest(), listed(own + more), len(more), len(own) + len(more)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])


def op10_pii(spark, sf_dir):
    """Base spans by count and digest, all spans, and how many were added and are there in all, per row of `documents`."""
    from .common import spread, table

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    return find_spans(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).mapInArrow(_digest, schema)
