"""Private data found by a semi-Markov conditional random field.

A text is cut into tokens (runs of letters and digits, single other characters)
and the tokens into segments: single tokens outside any entity, or entities of at
most ``MAX_TOKENS`` tokens and one of ``TYPES``.  A segment's score is a weighted
sum of features of the whole span (its shape, digit counts, checksum, the words
before it, what stands at its edges) and of whether it follows another entity
directly.  The dynamic programme over bounded entities picks the segmentation of
greatest score, boundaries and types at once.

Weights are trained here, by maximum likelihood, on sentences made of words from
a bounded sample of the corpus (``background_rows`` texts, ``background_words``
words), generated private data and generated look-alikes (versions, amounts,
dates, short numbers).

Only spans with an ASCII digit or ``@``, and spans that start right after a cue and
its sign (``password = "``), can be entities; this is part of the model.  Everywhere
else each token stands outside, so the programme runs over the windows that these
can reach and its result is that of the whole text.

Defined results:

* Null and empty texts have no entity; an empty table gives an empty result.
* Very long texts are searched whole, window by window.
* Offsets count characters; each row gives its own entities, so repeated rows
  repeat them; a null ``doc_id`` stays null.
* Of segmentations with equal score the one with fewer and later-starting
  entities is taken.
* Other columns are not looked at.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, ship

TYPES = ("EMAIL", "PHONE", "CARD", "IP", "SECRET")
MAX_TOKENS = 24
_TOKEN = re.compile(r"[^\W_]+|.", re.S)
_TRIGGER = re.compile(r"[0-9@]")
_EMAIL = re.compile(r"[^\W_](?:[\w.+-]*\w)?@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")
_HEX = re.compile(r"[0-9a-fA-F]+")
_CUES = r"(?:token|secret|password|passwd|pwd|api[_-]?key|key|auth|bearer)"
_CUE = re.compile(rf"(?i){_CUES}['\"]?\s*([=:]?)\s*['\"]?$")
_SIGN = r"['\"]?[ \t]{0,3}[=:]"
_ASSIGNED = re.compile(rf"(?i){_CUES}{_SIGN}[ \t]{{0,3}}['\"]?(?=[^\W_])")
_CARD_GROUPS = re.compile(r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}")
_SEPARATED = re.compile(r"[0-9]+(?:[ -][0-9]+)+")
_KEY_CHARS = re.compile(r"[A-Za-z0-9_.+/=-]+")
#: Texts that can hold an entity, for Spark.
_WORTH = rf"[0-9@]|(?iu:{_CUES}){_SIGN}"
_PHONE_CHARS = re.compile(r"[0-9()+\-. ]+")
FEATURES = (
    "bias", "email", "ip", "octets", "digits13-19", "digits16", "luhn", "plus", "paren", "phone chars", "phone digits", "phone groups",
    "one token", "hex", "long", "very long", "mixed", "upper mixed", "cue", "space inside", "odd start", "odd end", "letter beside",
    "digit beside", "joined before", "joined after", "at sign", "digits only", "dots only", "tokens",
    "card groups", "key", "mixed key", "assigned", "no digit", "key goes on",
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


@functools.lru_cache(1 << 14)
def _cue(before: str) -> tuple[bool, bool]:
    """Whether a cue ends the text before a span, and whether with a sign of assignment."""
    m = _CUE.search(before)
    return m is not None, m is not None and bool(m[1])


def _cued(text: str, a: int, b: int) -> set[int]:
    """Where values start that follow a cue and its sign, within text[a:b]."""
    return {m.end() for m in _ASSIGNED.finditer(text, max(0, a - 32), b)}


def span_features(text: str, a: int, b: int, tokens: int) -> list[int]:
    """Indices of the features that hold for text[a:b]."""
    span = text[a:b]
    digits = sum("0" <= c <= "9" for c in span)
    f = [0]
    plain = digits == len(span)
    if "@" in span:
        f.append(26)
        if _EMAIL.fullmatch(span):
            f.append(1)
    parts = span.split(".")
    if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts):
        f.append(2)
        if all(int(p) <= 255 for p in parts):
            f.append(3)
    if plain:
        f.append(27)
    if plain or _SEPARATED.fullmatch(span):
        if 13 <= digits <= 19:
            f.append(4)
            if luhn(span if plain else re.sub("[ -]", "", span)):
                f.append(6)
        if digits == 16:
            f.append(5)
        if not plain and _CARD_GROUPS.fullmatch(span):
            f.append(30)
    if span[0] == "+":
        f.append(7)
    if "(" in span and ")" in span:
        f.append(8)
    if not plain and _PHONE_CHARS.fullmatch(span):
        f.append(9)
        if 10 <= digits <= 15:
            f.append(10)
        if len(re.findall(r"\d+", span)) >= 3 and ("-" in span or "(" in span or " " in span):
            f.append(11)
        if set(span) <= set("0123456789."):
            f.append(28)
    if tokens == 1:
        f.append(12)
        if len(span) >= 16:
            f.append(14)
            if len(span) >= 32:
                f.append(15)
        if 0 < digits < len(span):
            f.append(16)
            if _HEX.fullmatch(span):
                f.append(13)
            if span.upper() == span and span.isascii():
                f.append(17)
    else:
        f.append(29)
        if _KEY_CHARS.fullmatch(span):
            f.append(31)
            if digits and any(c.isalpha() for c in span):
                f.append(32)
                if len(span) >= 16:
                    f.append(14)
                    if len(span) >= 32:
                        f.append(15)
        if any(c.isspace() for c in span):
            f.append(19)
    cue, sign = _cue(text[max(0, a - 24) : a])
    if cue:
        f.append(18)
        if sign:
            f.append(33)
    if not digits:
        f.append(34)
    if not (span[0].isalnum() or span[0] in "+("):
        f.append(20)
    if not span[-1].isalnum():
        f.append(21)
    before, after = text[a - 1 : a], text[b : b + 1]
    if before.isalpha() or after.isalpha():
        f.append(22)
    if before.isdigit() or after.isdigit():
        f.append(23)
    if before and before in "+(@-." and text[max(0, a - 2) : a - 1].isalnum() or before in ("+", "("):
        f.append(24)
    if after and after in "@-." and text[b + 1 : b + 2].isalnum():
        f.append(25)
    if before and before in "_-./+" and text[max(0, a - 2) : a - 1].isalnum() or after and after in "_-./+" and text[b + 1 : b + 2].isalnum():
        f.append(35)
    return f


def tokenize(text: str, a: int = 0, b: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, a, len(text) if b is None else b)]


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Token bounds of the stretches in which an entity can lie, apart from each other."""
    out: list[list[tuple[int, int]]] = []
    reach = MAX_TOKENS - 1
    at = 0
    cued = _cued(text, 0, len(text))
    starts = sorted(cued)
    while True:
        m = _TRIGGER.search(text, at)
        k = bisect.bisect_left(starts, at)
        first = min(([m.start()] if m else []) + starts[k : k + 1], default=None)
        if first is None:
            break
        width = 160
        while True:  # enough tokens to the left, none cut
            lo = max(0, first - width)
            left = tokenize(text, lo, first + 1)
            if lo > 0:
                left = left[1:]
            if lo == 0 or len(left) > reach + 1:
                break
            width *= 2
        # the token of the trigger may go on to the right
        left = left[-(reach + 1) :]
        floor = out[-1][-1][1] if out else 0
        line = [t for t in left if t[0] >= floor]
        start = line[-1][0] if line else first
        line = line[:-1]
        rest, last, end = 0, 0, start
        for t in _TOKEN.finditer(text, start):
            line.append(t.span())
            end = t.end()
            rest += 1
            if t.start() in cued or _TRIGGER.search(text, *t.span()):
                last = rest
            if rest - last >= reach:
                break
        if out and line and out[-1][-1][1] == line[0][0]:
            out[-1] += line
        elif line:
            out.append(line)
        at = end
    return out


def candidates(text: str, line: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first token, end token) of the spans that may be entities, by end."""
    hot = [bool(_TRIGGER.search(text, *t)) for t in line]
    blank = [text[a:b].isspace() for a, b in line]
    cued = _cued(text, line[0][0], line[-1][1] + 1) if line else set()
    total = [0]
    for x in hot:
        total.append(total[-1] + x)
    return [
        (i, j)
        for j in range(1, len(line) + 1)
        if not blank[j - 1]
        for i in range(max(0, j - MAX_TOKENS), j)
        if not blank[i] and (total[j] > total[i] or line[i][0] in cued)
    ]


class Model:
    """Weights by type and feature, and the weight of an entity right after another."""

    def __init__(self, weights: np.ndarray, adjoining: float):
        self.weights, self.adjoining = weights, adjoining
        self._rows = None

    def score(self, features: list[int]) -> tuple[float, int]:
        """The best type's score and the type."""
        if self._rows is None:
            self._rows = [tuple(r) for r in self.weights.T.tolist()]  # by feature
        rows = self._rows
        by_type = [sum(x) for x in zip(*(rows[f] for f in features))]
        best = max(by_type)
        return best, by_type.index(best)

    def decode(self, text: str, line: list[tuple[int, int]]) -> list[tuple[int, int, str, float]]:
        """The best segmentation's entities: (start, end, type, score)."""
        n = len(line)
        by_end: dict[int, list[tuple[float, int, int]]] = {}
        for i, j in candidates(text, line):
            s, t = self.score(span_features(text, line[i][0], line[j - 1][1], j - i))
            if s > 0 or s + self.adjoining > 0:
                by_end.setdefault(j, []).append((s, i, t))
        out_best, in_best = [0.0] * (n + 1), [-math.inf] * (n + 1)  # the last token outside, or in an entity
        back: list = [None] * (n + 1)
        for j in range(1, n + 1):
            out_best[j] = max(out_best[j - 1], in_best[j - 1])
            for s, i, t in by_end.get(j, ()):
                from_in = in_best[i] + self.adjoining
                total = s + max(out_best[i], from_in)
                if total > in_best[j]:
                    in_best[j] = total
                    back[j] = (i, t, s, from_in > out_best[i])
        found, j, inside = [], n, in_best[n] > out_best[n]
        while j > 0:
            if inside:
                i, t, s, inside = back[j]
                found.append((line[i][0], line[j - 1][1], TYPES[t], s))
                j = i
            else:
                inside = in_best[j - 1] > out_best[j - 1]
                j -= 1
        return found[::-1]

    def entities(self, text: str | None) -> list[tuple[int, int, str, float]]:
        return [e for line in windows(text) for e in self.decode(text, line)] if text else []


# -------------------------------------------------------------------- training


def _private(rng: random.Random, kind: str, word) -> str:
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    if kind == "EMAIL":
        name = word() + rng.choice(["", ".", "_", "-", "+"]).join(["", rng.choice([d(2), word(), d(1)])])
        return f"{name}@{rng.choice(['mail' + d(1), word(), 'post'])}.{rng.choice(['example.', word() + '.', ''])}{rng.choice(['com', 'org', 'net', 'de', 'co'])}"
    if kind == "PHONE":
        return rng.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}"])
    if kind == "CARD":
        sizes = rng.choice([(4, 4, 4, 4)] * 4 + [(4, 6, 5)])
        body = rng.choice("3456") + d(sum(sizes) - 2)
        body = next(body + c for c in "0123456789" if luhn(body + c)) if rng.random() < 0.5 else body + d(1)
        if sum(sizes) == 16 and rng.random() < 0.5:
            return body
        ends = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
        return rng.choice(" -").join(body[x:y] for x, y in zip(ends, ends[1:]))
    if kind == "IP":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    h = "".join(rng.choices("0123456789abcdef", k=rng.choice([16, 18, 20, 32, 40, 40, 64])))
    if rng.random() < 0.3:
        return rng.choice(["AKIA", "GHP", "SK"]) + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16)) + d(1)
    some = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=n))
    x = rng.random()
    if x < 0.2:
        return rng.choice(["sk_live_", "sk_test_", "pk_live_", "ghp_", "sk-", "xoxb-" + d(11) + "-", "glpat-"]) + some(rng.randint(18, 32)) + d(1)
    if x < 0.35:
        return "-".join("".join(rng.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 11)) + d(1)
    if x < 0.5:
        return ".".join(["eyJ" + some(rng.randint(15, 30)), "eyJ" + "".join(some(rng.randint(8, 20)) + c for c in rng.choice(["", "_", "-", "_-"])) + some(12), some(20) + rng.choice("_-") + some(12)])
    return h[:-2] + "a" + d(1)


def _password(rng: random.Random, word) -> str:
    """A secret without a digit, which only its cue tells."""
    return rng.choice([word() + word(), "-".join([word(), word(), word()]), "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=rng.randint(8, 20)))])


def _alike(rng: random.Random, word) -> str:
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    return rng.choice([
        d(1), d(2), d(4), d(6), d(8), d(10), f"{d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", f"{d(1)}.{d(1)}.", f"{d(2)}:{d(2)}", f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}",
        f"${d(3)}.{d(2)}", f"{d(2)}%", f"v{d(1)}.{d(1)}", f"{d(1)},{d(3)},{d(3)}", f"@{word()}", f"{word()}{d(2)}", f"({d(1)})", f"[{d(2)}]", f"{d(1)}-{d(2)}", f"{d(3)}.{d(3)}", f"{d(3)}.{d(3)}.{d(3)}", f"a@{d(1)}",
        f"{300 + rng.randint(0, 699)}.{d(3)}.{d(3)}.{d(3)}", f"{word()}-{d(2)}", f"{word()}_{word()}{d(1)}.txt", f"www.{word()}.com/{word()}/{d(4)}", f"{d(4)} {d(4)}", f"20{d(2)}-{d(2)}-{d(2)}T{d(2)}:{d(2)}",
    ])


def training_set(words: list[str], sentences: int = 100, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences of the words with generated entities whose places are known."""
    rng = random.Random(seed)
    pure = [w for w in words if w.isalpha()] or ["word", "line", "other"]
    word = lambda: rng.choice(pure)
    out = []
    for _ in range(sentences):
        text, gold = "", []
        for k in range(rng.randint(3, 8)):
            text += " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
            x = rng.random()
            if x < 0.55:
                kind = rng.choice(TYPES)
                lead = rng.choice([" ", " ", " ", "\n", " | ", ": "])
                tail = rng.choice(["", "", "", ".", ",", "!!", "###", "&&&", ";", ")"])
                if kind == "SECRET" and rng.random() < 0.8:
                    cue = rng.choice(["token", "password", "secret", "api_key", "Token"])
                    form = rng.choice([' {} = "', " {}=", ' {}: "'])
                    lead, quoted = form.format(cue), '"' in form
                    tail = '"' + tail if quoted else tail
                    body = _password(rng, word) if rng.random() < 0.25 else _private(rng, kind, word)
                else:
                    body = _private(rng, kind, word)
                text += lead
                gold.append((len(text), len(text) + len(body), kind))
                text += body + tail + " "
            elif x < 0.95:
                text += " " + _alike(rng, word) + rng.choice(["", "", ".", ",", "###"]) + " "
            else:
                text += ". "
        out.append((text, gold))
    return out


def _prepare(text: str, gold) -> list[tuple]:
    """For each window: tokens, spans (i, j), feature lists, gold (span row, type, adjoining)."""
    out = []
    for line in windows(text):
        at_start = {a: k for k, (a, _) in enumerate(line)}
        at_end = {b: k + 1 for k, (_, b) in enumerate(line)}
        spans = candidates(text, line)
        row = {s: k for k, s in enumerate(spans)}
        true, last = [], -1
        for a, b, kind in gold:
            if a in at_start and b in at_end and (at_start[a], at_end[b]) in row:
                i, j = at_start[a], at_end[b]
                true.append((row[i, j], TYPES.index(kind), i == last))
                last = j
        out.append((len(line), spans, [span_features(text, line[i][0], line[j - 1][1], j - i) for i, j in spans], true))
    return out


def _lse(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def train(samples, steps: int = 40, rate: float = 0.3, ridge: float = 2e-3) -> Model:
    """Maximum likelihood by Adam; forward and backward sums over all bounded segmentations."""
    data = [w for text, gold in samples for w in _prepare(text, gold) if w[1]]
    sizes = [len(w[1]) for w in data]
    first = np.r_[0, np.cumsum(sizes)].astype(int)
    x = np.zeros((first[-1], len(FEATURES)))
    for w, at in zip(data, first):
        for k, f in enumerate(w[2]):
            x[at + k, f] = 1
    gold_w, gold_adj = np.zeros((len(TYPES), len(FEATURES))), 0
    for w, at in zip(data, first):
        for k, t, adj in w[3]:
            gold_w[t] += x[at + k]
            gold_adj += adj
    w, adj = np.zeros((len(TYPES), len(FEATURES))), 0.0
    w[:, 0] = -2.0
    m, v = np.zeros(w.size + 1), np.zeros(w.size + 1)
    for step in range(1, steps + 1):
        by_type = x @ w.T
        top = by_type.max(1, keepdims=True)
        mass = np.exp(by_type - top)
        whole = (top[:, 0] + np.log(mass.sum(1))).tolist()
        share = np.zeros(first[-1])
        adj_mass = 0.0
        for (n, spans, _, _), at in zip(data, first):
            fo, fi = [0.0] * (n + 1), [-math.inf] * (n + 1)
            bo, bi = [0.0] * (n + 1), [-math.inf] * (n + 1)  # what follows after position j, given the last segment's kind
            pos = 0
            for j in range(1, n + 1):
                fo[j] = _lse(fo[j - 1], fi[j - 1])
                while pos < len(spans) and spans[pos][1] == j:
                    i = spans[pos][0]
                    fi[j] = _lse(fi[j], whole[at + pos] + _lse(fo[i], fi[i] + adj))
                    pos += 1
            z = _lse(fo[n], fi[n])
            after_o, after_i = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
            after_o[n] = after_i[n] = 0.0
            starts: dict[int, list[int]] = {}
            for k, (i, _) in enumerate(spans):
                starts.setdefault(i, []).append(k)
            for i in range(n - 1, -1, -1):
                enter = -math.inf
                for k in starts.get(i, ()):
                    enter = _lse(enter, whole[at + k] + after_i[spans[k][1]])
                after_o[i] = _lse(after_o[i + 1], enter)
                after_i[i] = _lse(after_o[i + 1], enter + adj)
            for k, (i, j) in enumerate(spans):
                base = whole[at + k] + after_i[j] - z
                o, e = math.exp(min(0.0, fo[i] + base)), math.exp(min(0.0, fi[i] + adj + base))
                share[at + k] = o + e
                adj_mass += e
        expected = (mass / mass.sum(1, keepdims=True) * share[:, None]).T @ x
        grad = np.r_[((gold_w - expected) / len(data) - ridge * w).ravel(), (gold_adj - adj_mass) / len(data) - ridge * adj]
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w += move[:-1].reshape(w.shape)
        adj += float(move[-1])
    return Model(w, adj)


def fit(docs: DataFrame, background_rows: int = 64, background_words: int = 20_000, word_chars: int = 64, sentences: int = 100) -> Model:
    """Train with words of the ``background_rows`` texts of least hash of doc_id, whatever their length.

    Of their words without trigger and of at most ``word_chars`` characters the
    ``background_words`` of least hash are taken, so the driver gets no more than
    that; where there are under 50, seven plain words are added.
    """
    named = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text")
    # background_rows ids at most, and of the rows of one id one text, before anything is shuffled
    chosen = named.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(background_rows).distinct()
    texts = named.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    words = texts.select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("at", "word"))
    words = words.where((F.col("word") != "") & (F.char_length("word") <= word_chars) & ~F.col("word").rlike(_TRIGGER.pattern))
    taken = words.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(background_words)
    found = [r["word"] for r in taken.select("word").collect()]
    return train(training_set(found if len(found) >= 50 else [*found, "some", "plain", "words", "of", "text,", "and", "more."], sentences))


def find(docs: DataFrame, model: Model | None = None, **params) -> DataFrame:
    """(doc_id, start, end, entity, score): each entity found, with character offsets, end exclusive."""
    ship(docs.sparkSession)
    model = model or fit(docs, **params)

    def run(batches):
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch["text"]):
                got = model.entities(text.as_py())
                rows += [k] * len(got)
                found += got
            cols = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()),
                 pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64())],
                names=["doc_id", "start", "end", "entity", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where(F.col("text").rlike(_WORTH)).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start int, end int, entity string, score double")


def masked(text: str, entities: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for a, b, kind, _ in entities:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]


def mask(docs: DataFrame, model: Model | None = None, **params) -> DataFrame:
    """``docs`` with each entity in ``text`` replaced by its type in brackets; ``n_chars`` counted anew where text changes."""
    ship(docs.sparkSession)
    model = model or fit(docs, **params)

    def clean(text: pa.Array) -> pa.Array:
        out = []
        for t in text:
            t = t.as_py()
            got = model.entities(t)
            out.append(masked(t, got) if got else None)
        return pa.array(out, pa.string())

    name = free_name(docs, "_masked")
    got = docs.withColumn(name, F.arrow_udf(clean, "string")(F.when(F.col("text").rlike(_WORTH), F.col("text"))))
    out = []
    for f in docs.schema.fields:
        if f.name == "text":
            out.append(F.coalesce(F.col(name), F.col("text")).alias("text"))
        elif f.name == "n_chars":
            out.append(F.when(F.col(name).isNotNull(), F.char_length(name)).otherwise(F.col("n_chars")).cast(f.dataType).alias("n_chars"))
        else:
            out.append(F.col(f.name))
    return got.select(*out)
