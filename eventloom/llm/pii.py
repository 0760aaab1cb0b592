"""PII by fixed patterns and a semi-Markov conditional random field.

Base spans (email, ip, card, phone) are found by fixed patterns, leftmost and without
overlaps per kind.  The semi-Markov CRF adds spans that the patterns don't reach, such as
secrets in assignments and phone numbers written without a plus sign.  Its features are
those of whole candidate spans (shape, digits, checksums, the words before), a span has
at most ``MAX_TOKENS`` tokens, and dynamic programming picks boundaries and types of all
spans of a stretch of text together.  Tokens far from any digit, @ or = can be in no span,
so only the stretches around those are decoded, which gives the same result as decoding
all of the text.  A stretch has any length: spans are bounded, so candidates are scored
``CHUNK`` tokens at a time while the program moves on, and only the best way into each
token is kept.

The weights are learnt by conditional likelihood on examples drawn from a generator in
this module with a fixed seed, so they are the same whatever the corpus.

Base spans stay whatever the CRF says; CRF spans that overlap one are dropped.

Defined results: a null text counts as empty; repeated rows give repeated results;
offsets are in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from functools import lru_cache
from itertools import takewhile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventloom.llm import vectext as vt
from eventloom.llm.common import map_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
NONE = len(KINDS)
MAX_TOKENS = 14
#: Tokens whose candidates are scored at once.
CHUNK = 512

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@=]")
_BLANK = re.compile(r"\s")
_TOKEN = re.compile(r"[^\W_]+|[^\s]|_", re.A)
_HAS_TRIGGER = np.zeros(256, bool)
_HAS_TRIGGER[[*range(48, 58), 64, 61]] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed patterns, by kind and then start."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# Features of a candidate span.

_CUES = frozenset("password passwd pwd secret token key apikey api auth credential access bearer phone tel call fax mobile email mail ip host addr address card visa version v no item page".split())
_SHAPES = (
    ("mail", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")),
    ("dotted", re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")),
    ("national", re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")),
    ("plus", re.compile(r"\+[0-9][ ().0-9-]+[0-9]")),
    ("grouped", re.compile(r"[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}")),
    ("hex", re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]{12,64}")),
    ("upper_id", re.compile(r"(?=.*[0-9])[A-Z]{4}[A-Z0-9]{12,36}")),
    ("mixed", re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]{8,64}")),
    ("prefixed", re.compile(r"[a-z]{2,4}[_-](?=.*[0-9])[A-Za-z0-9_-]{12,64}")),
    ("number", re.compile(r"[0-9]+(?:[.,:/-][0-9]+)*")),
)


def span_features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Names of the features of the span of tokens i to j, the last included."""
    a, b = tokens[i][0], tokens[j][1]
    s = text[a:b]
    shapes = [name for name, rx in _SHAPES if rx.fullmatch(s)]
    digits = sum("0" <= c <= "9" for c in s)
    out = ["bias", f"n{min(j - i + 1, 8)}", f"d{min(digits, 20)}", *shapes]
    if not shapes:
        out.append("shapeless")
    if digits >= 13 and luhn(_digits(s)):
        out.append("luhn")
    if "dotted" in shapes and all(map(_octet, s.split("."))):
        out.append("octets")
    before = [text[x:y].lower() for x, y in tokens[max(0, i - 3) : i]]
    cues = [w for w in before if w in _CUES]
    out += [f"cue={w}" for w in cues]
    assigned = bool(before) and any(w in "=:" for w in before[-2:])
    if assigned:
        out.append("assigned")
    if cues and assigned:
        out += [f"cue+assigned:{x}" for x in (shapes or ["shapeless"])]
    glued = a > 0 and (text[a - 1].isalnum() or text[a - 1] in "._%+-@"), b < len(text) and text[b].isalnum()
    out += [name for name, is_so in zip(("glued_left", "glued_right"), glued, strict=True) if is_so]
    if b + 1 < len(text) and text[b] in ".@-" and text[b + 1].isalnum():
        out.append("goes_on")
    if any(c.isspace() for c in s):
        out.append("blank")
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as ranges in order that don't overlap."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def untaken(tokens: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[bool]:
    """Whether each token (in order) overlaps none of ``taken``."""
    ranges, out, k = merged(taken), [], 0
    for a, b in tokens:
        while k < len(ranges) and ranges[k][1] <= a:
            k += 1
        out.append(k == len(ranges) or b <= ranges[k][0])
    return out


def candidates(text: str, tokens: list[tuple[int, int]], free: list[bool], lo: int = 0, hi: int | None = None) -> list[tuple[int, int]]:
    """Token ranges that may be a span and start from ``lo`` to before ``hi``: they hold a digit or @, and ``free`` tokens only."""
    hi = len(tokens) if hi is None else hi
    last = [text[b - 1].isalnum() for _, b in tokens[lo : hi + MAX_TOKENS]]
    sign = [any("0" <= c <= "9" or c == "@" for c in text[a:b]) for a, b in tokens[lo : hi + MAX_TOKENS]]
    out = []
    for i in range(lo, hi):
        start = text[tokens[i][0]]
        if not (start.isalnum() or start in "+("):
            continue
        seen = False
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            if not free[j] or j > i and tokens[j][0] - tokens[j - 1][1] > 1:
                break
            seen = seen or sign[j - lo]
            if seen and last[j - lo]:
                out.append((i, j))
    return out


class SemiMarkov:
    """Weights of span features by type; spans of no type are single tokens of score 0."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS)))

    def _ids(self, names: list[str], grow: bool) -> list[int]:
        if grow:
            for x in names:
                self.index.setdefault(x, len(self.index))
        return [self.index[x] for x in names if x in self.index]

    def scores(self, text: str, tokens, spans) -> np.ndarray:
        return np.array([self.weights[self._ids(span_features(text, tokens, i, j), False)].sum(axis=0) for i, j in spans]).reshape(-1, len(KINDS))

    def decode(self, text: str, tokens, taken, chunk: int = CHUNK) -> list[tuple[str, int, int]]:
        """The best segmentation's spans, by dynamic programming over token positions."""
        free, n = untaken(tokens, taken), len(tokens)
        best, back = [0.0], [None]
        ways: dict[int, list[tuple[int, float, int]]] = {}  # by last token: first token, score, kind
        for s in range(0, n, chunk):
            e = min(s + chunk, n)
            spans = candidates(text, tokens, free, s, e)
            if spans:
                scores = self.scores(text, tokens, spans)
                kind, value = scores.argmax(axis=1), scores.max(axis=1)
                for k in np.flatnonzero(value > 0).tolist():
                    i, j = spans[k]
                    ways.setdefault(j, []).append((i, float(value[k]), int(kind[k])))
            for j in range(s, e):  # every candidate that ends here has been scored
                top, way = best[j], None
                for i, v, k in ways.pop(j, ()):
                    if best[i] + v > top:
                        top, way = best[i] + v, (i, k)
                best.append(top)
                back.append(way)
        out, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
                continue
            i, k = back[j]
            out.append((KINDS[k], tokens[i][0], tokens[j - 1][1]))
            j = i
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 6, rate: float = 0.25) -> SemiMarkov:
        """Ascend the conditional log likelihood of the examples' segmentations."""
        prepared = []
        for text, gold in examples:
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            spans = candidates(text, tokens, [True] * len(tokens))
            ids = [self._ids(span_features(text, tokens, i, j), True) for i, j in spans]
            wanted = {(a, b): KINDS.index(kind) for kind, a, b in gold}
            target = [wanted.get((tokens[i][0], tokens[j][1]), NONE) for i, j in spans]
            prepared.append((len(tokens), spans, ids, target))
        self.weights = np.zeros((len(self.index), len(KINDS)))
        for epoch in range(epochs):
            for n, spans, ids, target in prepared:
                p = self._marginals(n, spans, np.array([self.weights[x].sum(axis=0) for x in ids]).reshape(-1, len(KINDS)))
                for x, t, row in zip(ids, target, p, strict=True):
                    step = -row
                    if t != NONE:
                        step[t] += 1
                    if np.abs(step).max() > 1e-4:
                        self.weights[x] += rate / (1 + epoch) * step
            self.weights *= 0.999
        return self

    @staticmethod
    def _marginals(n: int, spans, scores: np.ndarray) -> np.ndarray:
        """Probability of each span and type, by forward and backward sums."""
        total = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(spans):
            ends[j + 1].append(k)
            starts[i].append(k)
        forward, backward = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[spans[k][0]] + total[k] for k in ends[j])])
        for i in range(n - 1, -1, -1):
            backward[i] = np.logaddexp.reduce([backward[i + 1], *(total[k] + backward[spans[k][1] + 1] for k in starts[i])])
        if not spans:
            return np.zeros((0, len(KINDS)))
        outside = np.array([forward[i] + backward[j + 1] for i, j in spans]) - forward[n]
        return np.exp(np.minimum(scores + outside[:, None], 0))


def examples(n: int = 500, seed: int = 13) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with marked spans, drawn from templates: what the CRF learns from."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(1, 9)))
    number = lambda k: "".join(r.choice(string.digits) for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + number(r.choice((13, 14, 14, 14)))
        body = next(body + d for d in string.digits if luhn(body + d))
        return r.choice((body, " ".join(re.findall(".{1,4}", body)), "-".join(re.findall(".{1,4}", body))))

    def secret() -> str:
        return r.choice(
            (
                lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((16, 18, 24, 32, 40, 64)))),
                lambda: r.choice(("AKIA", "ASIA", "AGPA")) + "".join(r.choice(string.ascii_uppercase + "234567") for _ in range(16)),
                lambda: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(12, 40))) + number(1),
                lambda: r.choice(("sk", "ghp", "key")) + r.choice("_-") + "".join(r.choice(string.ascii_letters + string.digits) for _ in range(24)) + number(2),
            )
        )()

    def entity() -> list[tuple[str, str | None]]:
        kind = r.choice(("email", "ip", "card", "phone", "phone", "secret", "secret", "secret", "none", "none", "none"))
        if kind == "email":
            return [(f"{word()}.{number(2)}@{word()}.{r.choice(('com', 'example.org', 'net'))}", kind)]
        if kind == "ip":
            return [(".".join(str(r.randint(1, 255)) for _ in range(4)), kind)]
        if kind == "card":
            return [(card(), kind)]
        if kind == "phone":
            area, mid, end = number(3), number(3), number(4)
            lead = [(r.choice(("call ", "tel: ", "phone: ", "")), None)]
            return [*lead, (r.choice((f"+1 ({area}) {mid}-{end}", f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"+44 {area} {mid} {end}", f"{area}.{mid}.{end}")), kind)]
        if kind == "secret":
            s = secret()
            cue = r.choice(("password", "token", "secret", "api_key", "pwd", "access key", "auth token"))
            lead = r.choice((f"{cue}=", f"{cue} = ", f'{cue} = "', f"{cue}: ", ""))
            if not lead and not s.startswith(("AKIA", "ASIA", "AGPA")):
                lead = f"{cue}="
            return [(lead, None), (s, kind), ('"' if lead.endswith('"') else "", None)]
        return [(r.choice((f"version {number(1)}.{number(1)}", f"{number(1)}.{number(1)}.", f"{number(4)}", f"page {number(2)}", f"x = {number(2)}", f"{number(2)}:{number(2)}", f"{number(1)},{number(3)}", f"{number(8)}", f"v{number(1)}.{number(1)}.{number(1)}", f"2024-{number(2)}-{number(2)}", f"{word()}{number(1)}", f"width = {number(3)}", f"{word()} = {word()}", f"no {number(6)}", "B2B", f"{number(3)}.{number(3)}.{number(4)}.9.1")), None)]

    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            for piece, kind in entity():
                if kind:
                    gold.append((kind, len(text), len(text) + len(piece)))
                text += piece
            text += r.choice((" ", ". ", ", ", "\n"))
        out.append((text + word(), gold))
    return out


@lru_cache(1)
def trained() -> SemiMarkov:
    return SemiMarkov().fit(examples())


def stretches(text: str) -> list[tuple[int, int]]:
    """Ranges around digits, @ and =, with the words near them; apart from each other."""
    out: list[list[int]] = []
    at = 0
    while m := _TRIGGER.search(text, at):
        lo = max(m.start() - 48, 0)
        while lo > 0 and not text[lo - 1].isspace() and m.start() - lo < 96:
            lo -= 1
        blank = _BLANK.search(text, m.end())
        hi = blank.start() if blank else len(text)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
        at = hi
    return [(a, min(b + 12, len(text))) for a, b in out]


def all_spans(text: str, model: SemiMarkov) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those that the CRF adds."""
    base = base_spans(text)
    taken, k = merged([(a, b) for _, a, b in base]), 0
    added: list[tuple[str, int, int]] = []
    for lo, hi in stretches(text):
        while k < len(taken) and taken[k][1] <= lo:
            k += 1
        mine = list(takewhile(lambda r: r[0] < hi, taken[k:k + hi - lo]))
        mine += takewhile(lambda r: r[1] > lo, ((a, b) for _, a, b in reversed(added)))
        added += model.decode(text, [m.span() for m in _TOKEN.finditer(text, lo, hi)], mine)
    return base, added


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1:])))


FIELDS = [
    *(T.StructField(f"n_{k}", T.LongType()) for k in BASE),
    T.StructField("base_spans", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("n_added", T.LongType()),
]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(keep, n_email, n_ip, n_card, n_phone, base_spans, spans, n_added) for each row.

    The counts are those of base spans; ``spans`` has all spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def start():
        model = shared.value

        def make(buf, off):
            marked = vt.range_sums(_HAS_TRIGGER[buf], off[:-1], off[1:]) > 0
            n = len(off) - 1
            counts, base_text, text, more = np.zeros((4, n), np.int64), [""] * n, [""] * n, np.zeros(n, np.int64)
            for i in np.flatnonzero(marked).tolist():
                base, added = all_spans(buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"), model)
                for kind, _, _ in base:
                    counts[BASE.index(kind), i] += 1
                base_text[i], text[i], more[i] = joined(base), joined(base + added), len(added)
            return [*counts, base_text, text, more]

        return make

    return map_texts(docs, text_col, [id_col] if keep is None else keep, FIELDS, start)


def redacted(text: str, model: SemiMarkov | None = None) -> str:
    """``text`` with every span replaced by its kind in brackets; overlaps go to the first."""
    base, added = all_spans(text, model or trained())
    out, at = [], 0
    for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])


def sha256(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
