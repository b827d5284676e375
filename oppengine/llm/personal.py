"""Personal data by weak supervision (operator 11).

Fixed patterns give the base spans (e-mail, IP address, payment card, telephone number), which always stay. Wider
patterns give candidates: addresses that are spelled out, other separators, numbers that fail a check. Labelers vote on
every candidate and base span, for, against or not at all: some by form, some by word lists, some by what stands
around it. Expectation-maximisation over the histogram of all votes of the corpus estimates how reliable each labeler
is, and so how likely each pattern of votes means personal data; a logistic span classifier is trained on that, from
features of the span and its neighbours. Candidates that it is sure of become spans where they touch no other span.

The corpus is read once. What a task finds is written in a row beside the document's columns; the histogram has at most
kinds x 2 x 3 ** labelers rows; the classifier learns from at most ``TRAIN_SPANS`` expected spans of each kind, base and
not. All patterns take time in proportion to the text, whatever it is.

Defined cases: null text is empty; texts without a span have an empty list; repeated rows get equal spans; where a
kind has no candidate, only base spans come; other columns can be kept, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, read_table, stage, unstage

KINDS = ("email", "ip", "card", "phone")
#: Expected bound on the spans of a kind, base and others, that the classifier is trained on.
TRAIN_SPANS = 20_000
#: Least probability of a span that is added.
ADD_AT = 0.9
#: Each labeler is taken to be right so often, with the weight of so many spans, before the corpus speaks.
TRUST, TRUST_SPANS, ROUNDS = 0.75, 20.0, 60
#: Of personal data, so much may fail the check of its kind (a checksum, a range): not estimated, as a bad number in
#: good form outvotes its check otherwise.
FAILED_CHECK = 0.01
#: A base span, which stays whatever the votes, counts as personal data with this probability at least; without such an
#: anchor the two classes can change places where bad numbers are frequent.
BASE_LEAST = 0.95
HASH_BITS = 12
#: Characters before and after a span that labelers and features see.
BEFORE, AFTER = 48, 24

# --- base spans
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")  # from a number's first digit only
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-1::-2]]
    even = [2 * int(d) for d in digits[-2::-2]]
    return sum(odd + [d - 9 if d > 9 else d for d in even]) % 10 == 0


def octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            yield start, done
        at = text.find("@", done if host else at + 1)


def base_and_failed(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans (kind, start, end) of the fixed patterns, and matches of them that fail their check."""
    good = [(0, *s) for s in emails(text)]
    failed = []
    for kind, pattern, check in ((1, _IP, octets), (2, _CARD, _card), (3, _PHONE, lambda s: 9 <= len(digits_of(s)) <= 15)):
        for m in pattern.finditer(text):
            (good if check(m.group()) else failed).append((kind, m.start(), m.end()))
    return good, failed


def _card(s: str) -> bool:
    d = digits_of(s)
    return 13 <= len(d) <= 19 and luhn(d)


# --- candidates
_DOT = r"(?:\s?[\[({<]\s?(?:dot|DOT|Dot|punkt|point|punto|\.)\s?[\])}>]\s?|\s(?:dot|DOT|punkt|punto)\s|\.)"
_AT = re.compile(r"(?:\s?[\[({<]\s?(?:at|AT|At|ät|@)\s?[\])}>]\s?|\s(?:at|AT)\s|\s?@\s?)([A-Za-z0-9-]{1,63}(?:" + _DOT + r"[A-Za-z0-9-]{1,63}){1,5})")
_IP6 = re.compile(r":[0-9a-fA-F]{0,4}:[0-9a-fA-F:]*")
_SPELLED_IP = re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)[0-9]{1,3}){3}")
_GROUPS = re.compile(r"[0-9]{4}(?:[ ./_\u00a0\u2010-\u2013-]{1,2}[0-9]{4}){2}[ ./_\u00a0\u2010-\u2013-]{1,2}[0-9]{1,7}")
_NUMBER = re.compile(r"[(0-9][0-9]{1,5}\)?(?:[ ./\u00a0-]{1,2}\(?[0-9]{2,5}\)?){1,5}|00[0-9]{8,13}")


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) of all base spans, and of candidates that touch none and each other nowhere, by start."""
    good, failed = base_and_failed(text)
    more = [(k, s, e) for k, s, e in failed if k == 1 or 7 <= len(digits_of(text[s:e])) <= 19]
    for m in _AT.finditer(text):
        start = m.start()
        while start > m.start() - 64 and start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            more.append((0, start, m.end()))
    for m in _IP6.finditer(text):
        start = m.start()
        while start > m.start() - 4 and start > 0 and text[start - 1] in "0123456789abcdefABCDEF":
            start -= 1
        if 3 <= text.count(":", start, m.end()) + 1 <= 9:
            more.append((1, start, m.end()))
    more += [(1, m.start(), m.end()) for m in _SPELLED_IP.finditer(text)]
    more += [(2, m.start(), m.end()) for m in _GROUPS.finditer(text) if 13 <= len(digits_of(m.group())) <= 19]
    more += [(3, m.start(), m.end()) for m in _NUMBER.finditer(text) if 7 <= len(digits_of(m.group())) <= 15]
    if not more:
        return sorted((k, s, e, True) for k, s, e in good)
    taken = sorted((s, e) for _, s, e in good)
    out = [(k, s, e, True) for k, s, e in good]
    at, last = 0, 0
    for s, e, k in sorted((s, -e, k) for k, s, e in more):
        e = -e
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if s >= last and (at == len(taken) or taken[at][0] >= e):
            out.append((k, s, e, False))
            last = e
    return sorted(out)


# --- labelers
#: Word lists of the labelers.
NEAR = (
    {"mail", "email", "e-mail", "contact", "write", "correo", "courriel", "mailto", "reply", "schreiben", "address"},
    {"ip", "ipv4", "ipv6", "host", "server", "addr", "address", "ping", "client", "gateway", "login", "servidor", "serveur"},
    {"card", "visa", "mastercard", "amex", "credit", "debit", "karte", "kreditkarte", "carte", "tarjeta", "payment", "cc"},
    {"tel", "phone", "telephone", "call", "fax", "mobile", "cell", "whatsapp", "telefon", "handy", "anruf", "téléphone", "portable", "teléfono", "móvil", "llame"},
)
FAR = {"version", "release", "isbn", "issn", "order", "invoice", "sku", "id", "no", "page", "pages", "part", "model", "serial", "token", "key", "hash", "doi", "section", "chapter", "table", "figure", "score", "price", "usd", "eur"}
TLDS = {"com", "net", "org", "edu", "gov", "info", "io", "co", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "be", "us", "ca", "mx", "ar", "jp", "cn", "in", "br", "au", "biz", "me", "app", "dev"}
FILES = {"png", "jpg", "jpeg", "gif", "svg", "css", "js", "html", "htm", "pdf", "txt", "csv", "zip", "py", "md", "php"}
_WORD = re.compile(r"[^\W_][\w-]*")
LABELERS = ("check", "layout", "edges", "list for", "list against", "words near", "words against")


def _last(host: str) -> str:
    return re.split(r"[^A-Za-z0-9-]+", host.rstrip(")]}> "))[-1].lower()


def votes(text: str, kind: int, start: int, end: int, base: bool) -> list[int]:
    """A vote of each labeler: 1 for personal data, -1 against, 0 none."""
    s, d = text[start:end], digits_of(text[start:end])
    left, right = text[start - 1 : start], text[end : end + 1]
    before, after = text[max(0, start - BEFORE) : start].lower(), text[end : end + AFTER].lower()
    near, around = set(_WORD.findall(before)[-5:]), set(_WORD.findall(before)[-2:]) | set(_WORD.findall(after)[:1])
    glued = (left.isalnum() or left in "_./@#=-" and left != "") or (right.isalnum() or right in "_@/=" and right != "")
    out = [0, 0, -1 if glued else 1, 0, 0, 1 if near & NEAR[kind] else 0, -1 if around & FAR or left in ("$", "€", "£") and left else 0]
    if kind == 0:
        local, tld = re.split(r"[\s@\[({<]", s, maxsplit=1)[0], _last(s)
        out[0] = 1 if base else 0
        out[1] = 1 if local[:1].isalnum() and local[-1:].isalnum() and ("@" in s or s.count("[") + s.count("(") + s.count("{") + s.count("<")) else -1
        out[3] = 1 if tld in TLDS else 0
        out[4] = -1 if tld in FILES or tld.isdigit() or len(local) < 2 else 0
    elif kind == 1:
        six = ":" in s
        parts = s.split(":") if six else re.findall("[0-9]+", s)
        out[0] = (1 if len(parts) == 8 and all(parts) or s.count("::") == 1 and len(d) > 1 else -1) if six else 1 if len(parts) == 4 and all(int(p) <= 255 for p in parts if len(p) < 5) and max(map(len, parts)) <= 3 else -1
        out[1] = -1 if not six and any(len(p) > 1 and p[0] == "0" for p in parts) else 1
        out[3] = 1 if not six and len(parts) == 4 and len(parts[0]) > 1 else 0
        out[4] = -1 if not six and all(len(p) == 1 for p in parts) or s in ("0.0.0.0", "127.0.0.1", "255.255.255.255") else 0
    elif kind == 2:
        out[0] = 1 if 13 <= len(d) <= 19 and luhn(d) else -1
        out[1] = 1 if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}(?:([ ./_\u00a0\u2010-\u2013-])[0-9]{4}){3}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}", s) else -1
        out[3] = 1 if len(d) == 16 and (d[0] == "4" or "51" <= d[:2] <= "55" or "2221" <= d[:4] <= "2720" or d[:4] == "6011" or d[:2] == "65") or len(d) == 15 and d[:2] in ("34", "37") or len(d) == 13 and d[0] == "4" else 0
        out[4] = -1 if len(set(d)) < 4 or d in "01234567890123456789" or len(d) in (13, 14, 17, 18) else 0
    else:
        date = re.fullmatch(r"(?:19|20)[0-9]{2}[./-][01]?[0-9][./-][0-3]?[0-9]|[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}|(?:1[0-9]|20)[0-9]{2} ?- ?(?:1[0-9]|20)[0-9]{2}", s)
        national = re.fullmatch(r"\(?[2-9][0-9]{2}\)?[ .-]{1,2}[2-9][0-9]{2}[ .-][0-9]{4}", s)
        out[0] = 1 if base or national else -1 if not 9 <= len(d) <= 12 else 0
        out[1] = 1 if s[0] in "+(0" or national else -1
        out[3] = 1 if s[:1] == "+" or d[:2] == "00" else 0
        out[4] = -1 if date or d[:3] in ("978", "979") or "." in s and "-" in s else 0
    return out


# --- features
def shape(s: str) -> str:
    """Runs of digits by their length, runs of letters as one, the rest as it is."""
    return re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", lambda m: f"{min(len(m.group()), 20)}", s[:120]))


def features(text: str, kind: int, start: int, end: int) -> list[int]:
    s, d = text[start:end], digits_of(text[start:end])
    before, after = _WORD.findall(text[max(0, start - BEFORE) : start].lower()), _WORD.findall(text[end : end + AFTER].lower())
    names = [f"b{kind}", f"s{shape(s) if kind else shape(re.sub('[^A-Za-z0-9]*[A-Za-z0-9]+$', '', s)[-12:])}", f"n{len(d)}", f"l{_class(text[start - 1 : start])}", f"r{_class(text[end : end + 1])}"]
    names += [f"w{w}" for w in before[-1:]] + [f"W{w}" for w in before[-4:]] + [f"a{w}" for w in after[:1]]
    names.append(f"c{luhn(d)}" if kind == 2 and d else f"t{_last(s)}" if kind == 0 else f"o{octets(s) if re.fullmatch('[0-9.]+', s) else 0}" if kind == 1 else f"p{s[0]}")
    return [xxhash.xxh3_64_intdigest(f"{kind} {n}") & ((1 << HASH_BITS) - 1) for n in names]


def _class(c: str) -> str:
    return "" if not c else "9" if c.isdigit() else "a" if c.isalpha() else " " if c.isspace() else c


_FOUND = T.ArrayType(T.StructType().add("kind", "integer").add("start", "integer").add("end", "integer").add("base", "boolean").add("votes", "integer").add("drawn", "long").add("features", T.ArrayType(T.IntegerType())))
_FOUND_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("drawn", pa.int64()), ("features", pa.list_(pa.int32()))]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in b.column(1).to_pylist():
            own = []
            for k, s, e, base in candidates(text):
                v = 0
                for x in votes(text, k, s, e, base):
                    v = 3 * v + x + 1
                own.append({"kind": k, "start": s, "end": e, "base": base, "votes": v, "drawn": xxhash.xxh3_64_intdigest(text[max(0, s - BEFORE) : e + AFTER]) >> 1, "features": features(text, k, s, e)})
            rows.append(own)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, _FOUND_ARROW)], names=["_keep", "_found"])


def unpack_votes(v: int) -> list[int]:
    """The votes as 0 (against), 1 (none), 2 (for)."""
    out = []
    for _ in LABELERS:
        v, x = divmod(v, 3)
        out.append(x)
    return out[::-1]


@dataclass
class Reliability:
    prior: float
    table: np.ndarray  # labeler x class x vote: probabilities

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(personal data) of rows of votes."""
        at = np.arange(patterns.shape[1])
        one, zero = (np.log(self.table[at, c, patterns]).sum(1) for c in (1, 0))
        return 1 / (1 + np.exp(np.clip(np.log1p(-self.prior) + zero - np.log(self.prior) - one, -500, 500)))


def estimate(patterns: np.ndarray, n: np.ndarray, base: np.ndarray, rounds: int = ROUNDS) -> Reliability:
    """Expectation-maximisation over a histogram of vote patterns (rows of 0, 1, 2), ``n`` times each, of base spans or not."""
    labelers = patterns.shape[1]
    believed = np.empty((labelers, 2, 3))
    believed[:, 1] = np.array([(1 - TRUST) / 2, 0.5, TRUST / 2]) * TRUST_SPANS
    believed[:, 0] = believed[:, 1, ::-1]

    def shares(table: np.ndarray) -> np.ndarray:
        t = table / table.sum(2, keepdims=True)
        if t[0, 1, 0] > FAILED_CHECK:
            t[0, 1] *= [FAILED_CHECK / t[0, 1, 0], *[(1 - FAILED_CHECK) / (1 - t[0, 1, 0])] * 2]
        return t

    r = Reliability(0.5, shares(believed))
    for _ in range(rounds):
        p = np.maximum(r.posterior(patterns), BASE_LEAST * base)
        table = believed.copy()
        for v in range(3):
            here = patterns == v
            table[:, 1, v] += (here * (n * p)[:, None]).sum(0)
            table[:, 0, v] += (here * (n * (1 - p))[:, None]).sum(0)
        r = Reliability(float((1 + (n * p).sum()) / (2 + n.sum())), shares(table))
    return r


def train(rows: list[list[int]], p: np.ndarray, weight: np.ndarray, rounds: int = 300, l2: float = 1e-4) -> np.ndarray:
    """Weights of hashed features by logistic regression on soft labels ``p`` (Adagrad over all rows)."""
    w, g2 = np.zeros(1 << HASH_BITS), np.full(1 << HASH_BITS, 1e-8)
    if not rows:
        return w
    feats = np.concatenate([np.asarray(r) for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = weight / weight.sum()
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[feats], len(rows)), -30, 30)))
        g = np.bincount(feats, (share * (p - q))[of], 1 << HASH_BITS) - l2 * w
        g2 += g * g
        w += 0.5 * g / np.sqrt(g2)
    return w


def learn(found: DataFrame) -> tuple[dict[int, Reliability], np.ndarray]:
    """Reliabilities by kind and the classifier's weights, from rows with ``_found``."""
    each = found.select(F.explode("_found").alias("f")).select("f.*")
    seen = each.groupBy("kind", "base", "votes").agg(F.count("*").alias("n")).collect()  # at most kinds x 2 x 3 ** labelers rows
    reliable, sizes = {}, Counter()
    for r in seen:
        sizes[r["kind"], r["base"]] += r["n"]
    for k in sorted({r["kind"] for r in seen}):
        own = sorted((r["votes"], r["base"], r["n"]) for r in seen if r["kind"] == k)
        reliable[k] = estimate(np.array([unpack_votes(v) for v, _, _ in own]), np.array([n for _, _, n in own], float), np.array([b for _, b, _ in own]))
    if not sizes:
        return {}, np.zeros(1 << HASH_BITS)
    rate = F.lit(0.0)
    for (k, base), n in sizes.items():
        rate = F.when((F.col("kind") == k) & (F.col("base") == base), min(1.0, TRAIN_SPANS / n)).otherwise(rate)
    drawn = each.where(F.col("drawn") < rate * float(1 << 63)).select("kind", "base", "votes", "features").toArrow().to_pylist()
    drawn.sort(key=lambda r: (r["kind"], r["base"], r["votes"], r["features"]))
    p = np.array([max(reliable[r["kind"]].posterior(np.array([unpack_votes(r["votes"])]))[0], BASE_LEAST * r["base"]) for r in drawn])
    weight = np.array([1 / max(min(1.0, TRAIN_SPANS / sizes[r["kind"], r["base"]]), 1e-300) for r in drawn])
    return reliable, train([r["features"] for r in drawn], p, np.minimum(weight, 10.0))


def find_personal_data(docs: DataFrame, keep: list[str] | None = None, add_at: float = ADD_AT) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``spans``: (kind, start, end, base, score), by kind and start.

    Offsets count code points, the end is exclusive; ``score`` is the classifier's probability.
    """
    own = beside(docs, keep or ["doc_id"], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    found = stage(own.mapInArrow(_found, own.drop("_text").schema.add("_found", _FOUND)), "personal-data")
    _, weights = learn(found)
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** HASH_BITS numbers
    spans = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("base", "boolean").add("score", "double"))
    spans_arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for own in b.column(1).to_pylist():
                p = [1 / (1 + np.exp(-np.clip(sent.value[c["features"]].sum(), -30, 30))) for c in own]
                rows.append([{"kind": KINDS[c["kind"]], "start": c["start"], "end": c["end"], "base": c["base"], "score": float(q)} for c, q in zip(own, p, strict=True) if c["base"] or q >= add_at])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, spans_arrow)], names=["_keep", "spans"])

    return found.mapInArrow(judged, found.drop("_found").schema.add("spans", spans)).select("_keep.*", "spans")


def op11_personal(spark, sf_dir: str) -> DataFrame:
    out = find_personal_data(read_table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(of_kind, KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
