"""Personal data: base patterns, and a semi-Markov conditional random field for what they miss.

Base spans (email, ip, card, phone) are fixed patterns with checks. Around digits and at-signs a segmentation
lattice is laid over the text's atoms (words, digit runs, single marks): every span of at most
``MAX_ATOMS`` atoms that can be an entity is a candidate segment of each kind, scored by features of the
whole span; all else is outside. Dynamic programming over the lattice picks boundaries and kinds jointly.
Base spans are fixed segments of the lattice, so the model only adds spans between them.

The weights are fitted here, by exact gradients (forward and backward sums over all segmentations), to
generated sentences with entities in plain and disguised forms and with numbers that are none.

Edge cases: null text counts as empty; offsets are code points, end exclusive; spans of one kind never
overlap; texts of any length are scanned whole, in linear time; equal scores keep the text outside; repeated
rows give repeated results; other columns are ignored, except that ``redact`` returns them as they are.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from manyvec.llm.common import map_rows, narrow

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS = 25

# fixed values: the base patterns; a run of digits or local characters is entered at its start only
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, end, number of the kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), 0))
            last = m.end()
            at = text.find("@", last)
        else:
            last = max(last, at + 1)  # no match can cross a sign that failed
            at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[Span]:
    found = emails(text) if "@" in text else []
    if re.search("[0-9]", text):
        found += [(*m.span(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        found += [(*m.span(), 2) for m in CARD.finditer(text) if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [(*m.span(), 3) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


ATOM = re.compile(r"[0-9]+|[^\W\d_]+|[^\S\n]+|.|\n", re.S)
BRACKETED = r"\s?[\[({<]\s?(?:at|AT)\s?[\])}>]\s?", r"\s?[\[({<]\s?(?:dot|DOT)\s?[\])}>]\s?"
AT, DOT = rf"(?:\s?@\s?|{BRACKETED[0]}|\s(?:at|AT)\s)", rf"(?:\.|{BRACKETED[1]}|\s(?:dot|DOT)\s)"
HOST = "[A-Za-z0-9-]{1,63}"
HOSTED = rf"[A-Za-z0-9._%+-]{{0,63}}(?:(?:\s?@\s?|{BRACKETED[0]}){HOST}(?:{DOT}{HOST}){{1,6}}|\s(?:at|AT)\s{HOST}(?:\s(?:dot|DOT)\s{HOST}){{1,6}})"
#: Where lattices are laid: words around an at-sign in any disguise, and whole chains of digit runs, with the address
#: that the last run may begin.
ZONE = re.compile(rf"(?<![A-Za-z0-9])[A-Za-z0-9]{HOSTED}|(?<![0-9])[(+]{{0,2}}[0-9]{{1,19}}(?:[\x20().\-/]{{1,3}}[0-9]{{1,19}})*+(?P<tail>{HOSTED})?")
#: What a span may be where a chain runs into an address: numbers alone, or an address from the start of its name.
PLAIN = re.compile(rf"[0-9\x20().\-/+]+\Z|[A-Za-z0-9._%+-]{{1,64}}{AT}")
TRIGGER = re.compile(r"[0-9@]|[\[({<]\s?(?:at|AT)\s?[\])}>]|\s(?:dot|DOT)\s")
CUES = {  # fixed values: words that announce a kind
    "email": 0, "mail": 0, "contact": 0, "ip": 1, "host": 1, "server": 1, "card": 2, "visa": 2, "payment": 2,
    "phone": 3, "tel": 3, "call": 3, "fax": 3, "mobile": 3,
}


def features(text: str, start: int, end: int) -> list[str]:
    """Features of the whole span, the same for each kind."""
    span, d = text[start:end], digits_of(text[start:end])
    groups = re.findall("[0-9]+", span)
    found = ["bias"]
    letters = any(c.isalpha() for c in span)
    if letters:
        found.append("letters")
        signs = len(re.findall(AT, span))
        found.append(f"at{min(signs, 2)}")
        if signs == 1:
            host = re.split(AT, span)[1]
            parts = [p.strip() for p in re.split(DOT, host)]
            found.append("host" if len(parts) > 1 and all(re.fullmatch("[A-Za-z0-9-]+", p) for p in parts) else "nohost")
            found.append("top" if re.fullmatch("[A-Za-z]{2,6}", parts[-1]) else "notop")
            if re.match(DOT + "[A-Za-z0-9]", text[end : end + 12]):
                found.append("cut")
            found.append("joined" if "@" in span else "bracketed" if re.search(r"[\[({<]", span) else "spelled")
    else:
        found += [f"digits{min(len(d), 20)}", f"groups{min(len(groups), 6)}"]
        shape = "-".join(str(len(g)) for g in groups)
        if len(groups) <= 5:
            found.append(f"shape{shape}")
        marks = "".join(sorted(set(re.sub("[0-9+]", "", span))))
        found.append(f"marks{marks}")
        found.append("plus" if span.startswith("+") else "noplus")
        found.append("paren" if span.startswith("(") or span.startswith("+") and "(" in span else "noparen")
        if span.count("(") != span.count(")"):
            found.append("unbalanced")
        if len(groups) == 4 and marks == "." and all(len(g) <= 3 and int(g) <= 255 for g in groups):
            found.append("quad")
        if 12 <= len(d) <= 19:
            found.append("luhn" if luhn(d) else "noluhn")
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    found.append("glued" if before.isalnum() or after.isalnum() else "free")
    if before and before in "-./=_#\"'$" or after and after in "-/=_\"'%" and not letters:
        found.append("edged")
    if re.match(r"[ ().\-/]{0,3}[0-9]", text[end : end + 4]) or re.search(r"[0-9][ ().\-/]{0,3}$", text[max(0, start - 4) : start]):
        found.append("more")
    if (cue := re.findall(r"[A-Za-z]+", text[max(0, start - 16) : start].lower())) and (k := CUES.get(cue[-1])) is not None:
        found.append(f"cue{KINDS[k]}")
    return found


def lattices(text: str, fixed: list[Span]):
    """For each zone: (boundaries, segments), a segment as (i, j, start, end) by boundary numbers."""
    taken: list[list[int]] = []  # the fixed spans, overlapping ones as one
    for start, end, _ in sorted(fixed):
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    first = 0
    for m in ZONE.finditer(text):
        lo, hi = m.span()
        while first < len(taken) and taken[first][1] <= lo:
            first += 1
        if first < len(taken) and taken[first][0] <= lo and taken[first][1] >= hi:
            continue  # all of it is taken
        cuts = [lo] + [a.end() for a in ATOM.finditer(text, lo, hi)]
        segments, at = [], first
        for i, start in enumerate(cuts[:-1]):
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if not (text[start].isalnum() or text[start] in "(+"):
                continue
            free = taken[at][0] if at < len(taken) else hi
            for j in range(i + 1, min(i + MAX_ATOMS, len(cuts) - 1) + 1):
                end = cuts[j]
                if end > free:
                    break
                if text[end - 1].isalnum() and (not m["tail"] or PLAIN.match(text[start:end])) and (len(digits_of(text[start:end])) >= 6 or re.search(AT, text[start:end]) or text.count(".", start, end) == 3):
                    segments.append((i, j, start, end))
        if segments:
            yield cuts, segments


class SemiCRF:
    def __init__(self, weights: list[dict[str, float]]):
        self.weights = weights

    def added(self, text: str, fixed: list[Span]) -> list[Span]:
        """Spans of the best segmentation, beside the fixed ones."""
        found = []
        for cuts, segments in lattices(text, fixed):
            by_end: dict[int, list] = {}
            for i, j, start, end in segments:
                f = features(text, start, end)
                score, kind = max((sum(map(lambda x: w.get(x, 0.0), f)), -k) for k, w in enumerate(self.weights))
                by_end.setdefault(j, []).append((score, i, -kind))
            best, back = [0.0] * len(cuts), [None] * len(cuts)
            for j in range(1, len(cuts)):
                best[j] = best[j - 1]
                for score, i, kind in by_end.get(j, ()):
                    if best[i] + score > best[j]:
                        best[j], back[j] = best[i] + score, (i, kind)
            j = len(cuts) - 1
            while j > 0:
                if back[j] is None:
                    j -= 1
                else:
                    found.append((cuts[back[j][0]], cuts[j], back[j][1]))
                    j = back[j][0]
        return found

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), each by start, then kind."""
        if not TRIGGER.search(text):
            return [], []
        base = base_spans(text)
        return base, sorted(base + self.added(text, base), key=lambda s: (s[0], s[2], s[1]))


def examples(count: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Generated sentences with gold spans: entities plain and disguised, and numbers that are none."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9)))

    def card() -> str:
        body = num(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def entity() -> tuple[str, int]:
        kind = r.randrange(4)
        if kind == 0:
            at, dot = r.choice([("@", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" @ ", "."), ("[at]", ".")])
            return word() + r.choice(["", "." + word(), num(2)]) + at + word() + r.choice(["", num(1)]) + r.choice(["", dot + word()]) + dot + r.choice(["com", "org", "net", "de", "info"]), 0
        if kind == 1:
            return ".".join(str(r.randint(0, 255)) for _ in range(4)), 1
        if kind == 2:
            c = card()
            sep = r.choice(["", " ", "-", ".", "/"])
            return sep.join(c[i : i + 4] for i in range(0, 16, 4)), 2
        a, b, c = num(3), num(3), num(4)
        return r.choice([f"+{num(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {a} {b} {c}", f"+{num(2)}-{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"{a} {b} {c}"]), 3

    def other() -> str:
        plain = num(16)
        while luhn(plain):
            plain = num(16)
        return r.choice([
            plain, plain, plain, " ".join(plain[i : i + 4] for i in range(0, 16, 4)), f"{num(1)}.{num(1)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", num(r.randint(1, 10)), num(r.randint(6, 14)), f"{num(3)} {num(3)}",
            f"{num(1)}.{num(2)}.{num(1)}", f"{num(3)}.{num(3)}.{num(3)}.{num(4)}", f'token = "{hashlib.sha1(num(5).encode()).hexdigest()}"', f"{word()} at {word()}", f"{word()} at {word()}. {word()} dot {word()}", f"@{word()}", f"{num(3)}-{num(4)}", f"{num(4)} {num(4)}", f"v{num(1)}.{num(1)}.{num(1)}.{num(2)}", f"{num(1)},{num(3)},{num(3)}", f"{num(4)}-{num(4)}", f"{num(2)}:{num(2)}:{num(2)} {num(4)}-{num(2)}-{num(2)}", f"{num(3)}.{num(3)}.{num(3)}", f"{num(2)}.{num(3)}",
        ])

    made = []
    for _ in range(count):
        text, gold = " ".join(word() for _ in range(3)) + " ", []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.5:
                e, kind = entity()
                if r.random() < 0.3:
                    text += r.choice([w for w, k in CUES.items() if k == kind]) + r.choice([" ", ": "])
                gold.append((len(text), len(text) + len(e), kind))
                text += e
            else:
                text += other()
            text += r.choice([" ", ", ", ". ", "\n"]) + word() + " "
        made.append((text, gold))
    return made


def logsum(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


@lru_cache(maxsize=2)
def fitted(count: int = 500, steps: int = 60, seed: int = 11, penalty: float = 0.02) -> SemiCRF:
    """Weights of the largest penalised likelihood, by exact gradients with adaptive steps; a few seconds."""
    names: dict[tuple[int, str], int] = {}
    flat, owner, zones, gold_at = [], [], [], []
    for text, gold in examples(count, seed):
        for cuts, segments in lattices(text, []):
            rows = []
            for i, j, start, end in segments:
                f = features(text, start, end)
                for kind in range(len(KINDS)):
                    n = len(gold_at)
                    for x in f:
                        flat.append(names.setdefault((kind, x), len(names)))
                        owner.append(n)
                    gold_at.append((start, end, kind) in gold)
                    rows.append((i, j, n))
            zones.append((len(cuts), rows))
    flat_a, owner_a, truth = np.array(flat), np.array(owner), np.array(gold_at, float)
    w, squares = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(steps):
        scores = np.bincount(owner_a, w[flat_a], len(truth)).tolist()
        chance = np.zeros(len(truth))
        for n, rows in zones:
            ending: list[list] = [[] for _ in range(n)]
            starting: list[list] = [[] for _ in range(n)]
            for i, j, s in rows:
                ending[j].append((i, s))
                starting[i].append((j, s))
            alpha, beta = [0.0] * n, [0.0] * n
            for j in range(1, n):
                alpha[j] = logsum([alpha[j - 1], *(alpha[i] + scores[s] for i, s in ending[j])]) if ending[j] else alpha[j - 1]
            for i in range(n - 2, -1, -1):
                beta[i] = logsum([beta[i + 1], *(beta[j] + scores[s] for j, s in starting[i])]) if starting[i] else beta[i + 1]
            for i, j, s in rows:
                chance[s] = math.exp(min(0.0, alpha[i] + scores[s] + beta[j] - alpha[-1]))
        grad = np.bincount(flat_a, (chance - truth)[owner_a], len(names)) / len(zones) * 100 + penalty * w
        squares += grad * grad
        w -= 1.0 * grad / np.sqrt(squares)
    weights: list[dict[str, float]] = [{} for _ in KINDS]
    for (kind, x), i in names.items():
        weights[kind][x] = float(w[i])
    return SemiCRF(weights)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, model: SemiCRF) -> DataFrame:
    """(doc_id, base counts, base_sha256, spans): one scan with the broadcast weights, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def row(d, text):
            base, spans = m.spans(text or "")
            return d, *(sum(s[2] == k for s in base) for k in range(len(KINDS))), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

        return row

    return map_rows(narrow(docs, "doc_id", "text"), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or each run of overlapping spans, replaced by its (first) kind in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: SemiCRF, column: str = "text") -> DataFrame:
    """The same rows and columns, personal data in ``column`` replaced by its kind; nulls stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index(column)
    schema = docs.schema

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = [None if t is None else redacted(t, m.spans(t)[1]) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, f.type) if i == at else c for i, (c, f) in enumerate(zip(batch.columns, batch.schema))], schema=batch.schema)

    return docs.mapInArrow(run, schema)
