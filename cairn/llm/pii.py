"""Personal data by weak supervision.

Base spans come from fixed patterns and always stay. Looser patterns propose further candidates of the same kinds;
labelers (shape by regex, gazetteer, context words, boundaries) vote on every candidate, base spans included, for or
against or not at all. Expectation-maximisation over the counts of vote patterns of all documents estimates how
reliable each labeler is; its posteriors are the soft labels on which the final span classifier, a logistic
regression over kind, votes and the span's own form (how many digits, what stands between them), is trained. Candidates
that it accepts and that overlap no span so far are added.

The text is read once: each document's base spans and candidates with their votes and forms go to the shared folder, the
counts of patterns (of a fixed number) to the driver.

Defined cases: a null text is empty and has no spans; offsets are code points, ends exclusive; repeated rows and null
doc_ids are handled row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import bounded_batches, materialize

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
#: The ip pattern's matches begin and end at the ends of digit runs; so said, a long run is read once, not from each digit.
IP_RUNS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
#: Looser patterns that propose candidates.
LOOSE = {
    "email": re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.%+-]{0,63} ?(?:\(at\)|\[at\]|\{at\}|＠| at ) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]+)+", re.A | re.I),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|(?<![0-9])[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{9,15}(?![0-9])"),
}
#: Gazetteers and context words of the labelers.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io co de fr es it nl uk us ca au jp cn in br ru ch at be se no fi dk pl eu".split())
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "22", "23", "24", "25", "26", "27", "35", "36")
CONTEXT = {
    "email": re.compile(r"mail|contact|write|reach|schreib|correo|courriel|kontakt", re.I),
    "ip": re.compile(r"\bip\b|server|host|address|login|adresse|servidor|serveur", re.I),
    "card": re.compile(r"card|visa|credit|pay|karte|tarjeta|carte|zahl", re.I),
    "phone": re.compile(r"call|phone|tel|fax|mobile|ruf|llam|appel|contact", re.I),
}
AGAINST = re.compile(r"version|isbn|issn|serial|build|invoice|order|release|revision|v\.?$|token|password|key", re.I)
#: Where digits stand; the looser patterns of digits are tried only here.
ZONE = re.compile(r"[+(]?[0-9][0-9\x20().+-]*")
LABELERS = ("shape", "gazetteer", "context", "boundary", "length")
#: A span's form: the number of its digits, up to each of these or more, and what stands between its parts.
DIGITS = (3, 9, 12, 16)
MARKS = 4
FORMS = (len(DIGITS) + 1) * MARKS
WINDOW = 32
THRESHOLD = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def passes(kind: str, found: str) -> bool:
    """Whether a base pattern's match counts."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    n = digits_of(found)
    return 13 <= len(n) <= 19 and luhn(n) if kind == "card" else 9 <= len(n) <= 15


def emails(text: str):
    """The email pattern's matches, looked for around each ``@``: where the first part of a match must begin is the
    start of the run before the sign, unless an earlier match ends inside that run."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        m = BASE["email"].match(text, start) if start < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


class Taken:
    """Stretches of one text that are taken; each question and addition is a binary search."""

    def __init__(self, stretches: list[tuple[int, int]]) -> None:
        ordered = sorted(stretches)
        self.starts = [s for s, _ in ordered]
        self.reach = list(accumulate((e for _, e in ordered), max))
        self.added: list[tuple[int, int]] = []  # these don't overlap one another

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        if i and self.reach[i - 1] > start:
            return False
        i = bisect_left(self.added, (end,))
        return not i or self.added[i - 1][1] <= start

    def add(self, start: int, end: int) -> None:
        insort(self.added, (start, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end), by kind and start."""
    out = []
    for k, kind in enumerate(KINDS):
        if kind == "email":
            matches = emails(text)
        elif kind == "phone" and "+" not in text:
            continue
        else:
            matches = (IP_RUNS if kind == "ip" else BASE[kind]).finditer(text)
        out += [(k, m.start(), m.end()) for m in matches if passes(kind, m.group())]
    return out


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """One vote of each labeler: 1 for, -1 against, 0 abstains."""
    found = text[start:end]
    n = digits_of(found)
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    if kind == "email":
        shape = 1 if BASE["email"].fullmatch(found) or re.search(r"[(\[{](at|dot)[)\]}]", found, re.I) else -1
        gazetteer = 1 if re.split(r"[^A-Za-z0-9-]+", found)[-1].lower() in TOP_LEVEL else -1
        length = 1 if len(found) <= 80 else -1
    elif kind == "ip":
        parts = found.split(".")
        shape = 1 if passes("ip", found) and all(p == "0" or p[0] != "0" for p in parts) else -1
        gazetteer = -1 if parts[0] in ("0", "00", "000") or len(found) <= 7 and found.count("0") > 2 else 1
        length = 1 if max(map(len, parts)) > 1 else -1
    elif kind == "card":
        shape = 1 if luhn(n) else -1
        gazetteer = 1 if n.startswith(CARD_STARTS) else -1
        length = 1 if len(n) in (15, 16) else 0 if len(n) in (13, 14, 19) else -1
    else:
        shape = 1 if re.fullmatch(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}", found) else 0 if "(" in found else -1
        gazetteer = -1 if len(n) >= 10 and n[-10] in "01" else 1
        length = 1 if 10 <= len(n) <= 13 else -1
    context = 1 if CONTEXT[kind].search(before) else -1 if AGAINST.search(before) else 0
    joined = bool(before and (before[-1].isalnum() or before[-1] in "_=\"#/\\")) or bool(after and (after[0].isalnum() or after[0] in "_=\"/\\"))
    return shape, gazetteer, context, -1 if joined else 1, length


def form(kind: str, found: str) -> int:
    """The span's form as one number below FORMS."""
    n = len(digits_of(found))
    if kind == "email":
        mark = 0 if "@" in found else 1 if "\uff20" in found else 2 if re.search(r"[(\[{]", found) else 3
    else:
        mark = 1 if " " in found else 2 if "-" in found or "(" in found else 3 if "." in found else 0
    return sum(n > d for d in DIGITS) * MARKS + mark


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans; and (kind, start, end, votes and form as a number) of all candidates, base spans first."""
    base = base_spans(text)
    taken = [Taken([(s, e) for k, s, e in base if k == kind]) for kind in range(len(KINDS))]
    proposed = list(base)
    low = text.lower()
    if "\uff20" in low or "(at)" in low or "[at]" in low or "{at}" in low or " at " in low and " dot " in low:
        proposed += [(0, m.start(), m.end()) for m in LOOSE["email"].finditer(text)]
    for zone in ZONE.finditer(text):
        if len(digits_of(zone.group())) >= 4:
            for k in (1, 2, 3):
                proposed += [(k, m.start(), m.end()) for m in LOOSE[KINDS[k]].finditer(text, zone.start(), zone.end())]
    own = set(base)
    proposed[len(base) :] = [(k, s, e) for k, s, e in proposed[len(base) :] if (k, s, e) not in own and taken[k].free(s, e)]
    out = []
    for k, s, e in proposed:
        code = 0
        for v in votes(KINDS[k], text, s, e):
            code = 3 * code + v + 1
        out.append((k, s, e, code * FORMS + form(KINDS[k], text[s:e])))
    return base, out


@dataclass
class Classifier:
    weights: np.ndarray  # by kind, by labeler's vote, by number of digits and by mark

    def probability(self, kind: int, code: int) -> float:
        return float(1 / (1 + np.exp(-(features(kind, code) @ self.weights))))


WIDTH = len(KINDS) + 3 * len(LABELERS) + len(DIGITS) + 1 + MARKS


def vote_row(code: int) -> list[int]:
    code //= FORMS
    out = []
    for _ in LABELERS:
        out.append(code % 3)
        code //= 3
    return out[::-1]


def features(kind: int, code: int) -> np.ndarray:
    x = np.zeros(WIDTH)
    x[kind] = 1
    for i, v in enumerate(vote_row(code)):
        x[len(KINDS) + 3 * i + v] = 1
    at = len(KINDS) + 3 * len(LABELERS)
    digits, mark = divmod(code % FORMS, MARKS)
    x[at + digits] = x[at + len(DIGITS) + 1 + mark] = 1
    return x


def learn(counts: dict[tuple[int, int], int], rounds: int = 50) -> Classifier:
    """counts: how often each (kind, pattern) occurs. EM over the votes for the labelers' reliabilities, then the classifier."""
    if not counts:
        return Classifier(np.full(WIDTH, -1.0))
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    kind = np.array([k[0] for k in keys])
    rows = np.array([vote_row(k[1]) for k in keys])
    share = 1 / (1 + np.exp(-(rows - 1).sum(axis=1)))  # the start: a soft majority
    for _ in range(rounds):
        prior = np.array([((n * share)[kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])
        log_odds = np.log(prior / (1 - prior))[kind]
        for i in range(len(LABELERS)):
            # A labeler's votes given the truth, with counts of a labeler that is right three times of four as prior.
            good = np.array([(n * share)[rows[:, i] == v].sum() for v in range(3)]) + [1, 2, 3]
            bad = np.array([(n * (1 - share))[rows[:, i] == v].sum() for v in range(3)]) + [3, 2, 1]
            log_odds = log_odds + np.log(good / good.sum() / (bad / bad.sum()))[rows[:, i]]
        share = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    x = np.stack([features(k, c) for k, c in keys])
    w = np.zeros(WIDTH)
    scale = n / n.sum()
    for _ in range(50):  # Newton steps of the ridge-penalised logistic regression on the soft labels
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (scale * (p - share)) + 1e-4 * w
        curve = (x * (scale * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(WIDTH)
        w = w - np.linalg.solve(curve, gradient)
    return Classifier(w)


def scanned(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., base, found): spans as flat lists of 3 and candidates as flat lists of 4 numbers for each row."""
    bounded_batches(docs.sparkSession)
    own = docs.select(*keep, F.col("text").cast("string").alias("cairn_text"))
    kept = docs.select(*keep).schema

    def run(batches):
        for b in batches:
            base, found = [], []
            for t in b.column(b.num_columns - 1):
                x, y = candidates(t.as_py() or "")
                base.append([v for s in x for v in s])
                found.append([v for s in y for v in s])
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(base, ints), pa.array(found, ints)], [*b.schema.names[:-1], "cairn_base", "cairn_found"])

    return own.mapInArrow(run, kept.add("cairn_base", T.ArrayType(T.LongType())).add("cairn_found", T.ArrayType(T.LongType())))


def pattern_counts(scan: DataFrame) -> dict[tuple[int, int], int]:
    """Over all candidates; there are at most kinds x 3^labelers x FORMS patterns."""
    number = F.sequence(F.lit(0), (F.size("cairn_found") / 4).cast("int") - 1)
    pair = F.transform(number, lambda i: F.struct(F.get("cairn_found", 4 * i).alias("kind"), F.get("cairn_found", 4 * i + 3).alias("code")))
    each = scan.where(F.size("cairn_found") > 0).select(F.explode(pair).alias("c"))
    return {(r["kind"], r["code"]): r["n"] for r in each.groupBy("c.kind", "c.code").agg(F.count("*").alias("n")).collect()}


def decide(base: list[int], found: list[int], model: Classifier, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """All spans by kind and start: base ones, and accepted candidates that overlap no other span of their kind.

    A candidate inside a base span of another kind is no span of its own.
    """
    spans = [tuple(base[i : i + 3]) for i in range(0, len(base), 3)]
    fixed = set(spans)
    more = []
    for i in range(0, len(found), 4):
        k, s, e, code = found[i : i + 4]
        if (k, s, e) not in fixed and (p := model.probability(k, code)) >= threshold:
            more.append((-p, s, e, k))
    taken = Taken([(s, e) for _, s, e in spans])
    for _, s, e, k in sorted(more):
        if taken.free(s, e):
            taken.add(s, e)
            spans.append((k, s, e))
    return sorted(spans)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_pii(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row of docs.

    The counts and the digest are of the base spans; ``spans`` lists all.
    """
    scan = materialize(scanned(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id"), "pii-scan")
    model = learn(pattern_counts(scan))

    def run(batches):
        for b in batches:
            out = []
            for doc, base, found in zip(*(c.to_pylist() for c in b.columns)):
                own = [tuple(base[i : i + 3]) for i in range(0, len(base), 3)]
                spans = decide(base, found, model, threshold)
                counts = [sum(s[0] == k for s in own) for k in range(len(KINDS))]
                out.append((doc, *counts, hashlib.sha256(listed(own).encode()).hexdigest(), listed(spans), len(spans) - len(own)))
            columns = list(zip(*out)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return scan.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with each span of its texts replaced by its kind in brackets; n_chars, if there, follows the new text.

    The texts are searched once and kept beside what was found until the classifier is trained. Where spans of two kinds
    overlap, the stretch they cover is replaced by the first one's mark.
    """
    columns, schema = docs.columns, docs.schema
    scan = materialize(scanned(docs, *columns), "pii-texts")
    model = learn(pattern_counts(scan.select("cairn_found")))
    at = columns.index("text")
    counted = columns.index("n_chars") if "n_chars" in columns else None

    def run(batches):
        for b in batches:
            texts = []
            for t, base, found in zip(b.column(at).to_pylist(), b.column(len(columns)).to_pylist(), b.column(len(columns) + 1).to_pylist()):
                if t is not None and found:
                    done, parts = 0, []
                    for s, e, k in sorted((s, e, k) for k, s, e in decide(base, found, model, threshold)):
                        if s >= done:
                            parts += [t[done:s], f"[{KINDS[k].upper()}]"]
                        done = max(done, e)
                    t = "".join([*parts, t[done:]])
                texts.append(t)
            out = list(b.columns[: len(columns)])
            out[at] = pa.array(texts, b.schema.field(at).type)
            if counted is not None:
                out[counted] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(out, columns)

    return scan.mapInArrow(run, schema)
