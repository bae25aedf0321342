"""Personal data: fixed patterns, and further spans by a semi-Markov conditional random field.

The patterns give the base spans, which always stay. Around them, tokens form runs: marked ones (with a digit or @), and
capitalised, street and number words that follow a marked token or a cue (a greeting, a word like "account", a street's first
word). The model scores every segment of up to MOST_TOKENS tokens of a run as a whole, by features of its full string and
of what stands before it, plus transitions between types, and a dynamic program picks boundaries and
types together. Its weights maximise the conditional likelihood of two sets of runs: those of a bounded sample of documents,
whose segments are known from the patterns and from quoted long hexadecimal values after an equals sign; and those of PLANTED
sentences with names, street addresses and spoken account numbers, whose segments are known because they were put there,
beside sentences of the same words and shapes that hold none. No single feature tells these kinds.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import json
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, unused

ship(__name__)

BASE = ("email", "ip", "card", "phone")
TYPES = ("none", *BASE, "secret", "person", "street", "account")
MOST_TOKENS = 4
#: Segments of more characters, or without letters, have no features of words.
LONGEST = 200
#: Documents of the training sample, about, and different runs kept of it.
SAMPLE_DOCS, SAMPLE_RUNS = 4000, 400
#: Planted training sentences.
PLANTED = 600

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
#: A match starts where a run of digits starts: from a later digit it fails just as from the first.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
REST = re.compile(r"[^\s=\"'<>]*")
EDGES = "=\"'<>"
CORE = re.compile(r"[A-Za-z0-9+(](?:.*[A-Za-z0-9)])?", re.S)
SECRET = re.compile(r"[0-9A-Fa-f]{32,}")
HINT = re.compile(r"[=:]\s*[\"'][^\"']*$")
#: Words that may stand before a name, before an account number, first in a street's name, anywhere in one, in
#: place of a name after a greeting; number words; ends of German street names.
GREETINGS = "Dear Hello Hi Mr Mrs Ms Dr Regards Sincerely Hallo Liebe Lieber Herr Frau Bonjour Cher Chère Monsieur Madame Hola Querido Querida Señor Señora".split()
ACCOUNTS = "account Account number Konto Kontonummer compte cuenta".split()
STARTERS = "Calle Plaza Avenida Paseo Rue".split()
STREETS = {*STARTERS, *"Street Road Avenue Lane Drive Court Square St Rd Ave rue avenue boulevard place".split()}
GENERIC = set("Customer Customers Sir Madam All Team Everyone World There Friend Friends Colleagues Again Kunde Kunden Alle Zusammen Welt Client Tous Monde Cliente Clientes Todos Mundo".split())
NUMBER_WORDS = "zero one two three four five six seven eight nine null eins zwei drei vier fünf sechs sieben acht neun".split()
STREET_END = re.compile(r"(?:stra(?:ss|ß)e|weg|gasse|platz)$")
CUES = re.compile("(?:" + "|".join(sorted({*GREETINGS, *ACCOUNTS, *STARTERS}, reverse=True)) + r")\b")
GREETED = re.compile(r"\b(?:" + "|".join(GREETINGS) + r")\.?,? $")
COUNTED = re.compile(r"\b(?:" + "|".join(ACCOUNTS) + r")(?: is| ist| est| es)?:? $")
AFTER_CUE = re.compile(r"(?:\.|,)?(?: is| ist| est| es)?:?")
NUMBERS = re.compile("(?:" + "|".join(NUMBER_WORDS) + ")(?:[ -](?:" + "|".join(NUMBER_WORDS) + r"))*(?!\w)")
WORD = re.compile(r"[^\W\d_]{1,40}(?:['’-][^\W\d_]{1,40}){0,3}")
STOP = re.compile(r"(?:[,.;:!?)]+(?=\s|$)|(?=[\s=\"'<>])|$)")
LAST_WORD = re.compile(r"(?<![^\s])([^\W\d_]{4,40}) $")
NAME_FULL = re.compile(r"[^\W\d_]+(?:[ '’-][^\W\d_]+)*")
NUMBER_FIRST = re.compile(r"[0-9]{1,4}[A-Za-z]?,? ")
NUMBER_LAST = re.compile(r" [0-9]{1,4}[A-Za-z]?$")
EMAIL_FULL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the run of its characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL_END.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind as in BASE, then start; ends are exclusive."""
    out = [(0, *s) for s in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def marked(text: str) -> Iterator[tuple[int, int]]:
    """Tokens between white space or EDGES that hold a mark, in one pass: from each mark outward, then on from the token's end."""
    done = 0
    while m := MARK.search(text, done):
        start = m.start()
        while start > done and not text[start - 1].isspace() and text[start - 1] not in EDGES:
            start -= 1
        done = REST.match(text, m.end()).end()
        yield start, done


def cued(text: str) -> Iterator[int]:
    """Where the words begin that a cue may announce: after it, or at it if it is a street's first word."""
    for m in CUES.finditer(text):
        s = m.start()
        if not s or not (text[s - 1].isalnum() or text[s - 1] == "_"):
            yield s if m[0] in STARTERS else AFTER_CUE.match(text, m.end()).end()


def following(text: str, at: int) -> Iterator[tuple[int, int, int]]:
    """Start, end and raw end of the fewer than MOST_TOKENS words of runs from a place on: up to a mark, punctuation or another word."""
    for _ in range(MOST_TOKENS - 1):
        s = at + (text[at : at + 1] == " ")
        numbers = NUMBERS.match(text, s)
        word = numbers or WORD.match(text, s)
        stop = STOP.match(text, word.end()) if word else None
        if not stop or not (numbers or word[0][0].isupper() or word[0] in STREETS):
            return
        at = stop.end()
        yield s, word.end(), at
        if at > word.end():
            return


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Neighbouring tokens, as spans without outer punctuation: marked ones and words that follow them or a cue."""
    out: list[list[tuple[int, int]]] = []
    end = -9
    for a, b in heapq.merge(marked(text), ((p, p) for p in cued(text))):
        if b > a:
            if not (core := CORE.search(text[a:b])):
                continue
            if a - end > 2 or not out:
                before = LAST_WORD.search(text, max(0, a - 42), a)
                out.append([before.span(1)] if before and before.start() >= end and STREET_END.search(before[1]) else [])
            out[-1].append((a + core.start(), a + core.end()))
            end = b
            if core.end() < b - a:
                continue
        elif a < end:
            continue
        words = list(following(text, b))
        if words:
            if b == a:
                out.append([])
            out[-1] += [(s, e) for s, e, _ in words]
            end = words[-1][2]
    return out


def span_features(s: str, tokens: int, before: str) -> tuple[int, ...]:
    """Numbers of the features that a whole segment has."""
    digits = "".join(c for c in s if "0" <= c <= "9")
    plain = not s.strip("0123456789 -")
    dots = s.split(".")
    four = len(dots) == 4 and all(d.isdigit() and d.isascii() for d in dots)
    on = [0, tokens, 5 + min(len(digits), 20)]
    tests = (
        "@" in s, bool(EMAIL_FULL.fullmatch(s)), four, four and all(len(d) < 4 and int(d) < 256 for d in dots), s[0] == "+", bool(PHONE.fullmatch(s)), plain,
        plain and 13 <= len(digits) <= 19, plain and 13 <= len(digits) <= 19 and luhn(digits), bool(SECRET.fullmatch(s)), any(c.isalpha() for c in s), bool(HINT.search(before)), "(" in s,
        bool(SECRET.fullmatch(s)) and bool(HINT.search(before)), bool(PHONE.fullmatch(s)) and 9 <= len(digits) <= 15,
    )
    if len(s) <= LONGEST and any(c.isalpha() for c in s):
        words = s.split()
        spoken = len(re.split("[ -]", s)) if NUMBERS.fullmatch(s) else 0
        tests += (
            bool(GREETED.search(before)), bool(COUNTED.search(before)), bool(NAME_FULL.fullmatch(s)), all(w[0].isupper() for w in words), not GENERIC.isdisjoint(words),
            not STREETS.isdisjoint(words), bool(STREET_END.search(words[0])), bool(NUMBER_FIRST.match(s)), bool(NUMBER_LAST.search(s)), words[-1] in STREETS, spoken == 1, 2 <= spoken <= 3, spoken > 3,
        )
    return (*on, *(26 + i for i, t in enumerate(tests) if t))


FEATURES = 26 + 15 + 13


def named(draw: random.Random) -> str:
    """A made-up capitalised word."""
    return "".join(draw.choice("b c d f g h j k l m n p r s t v w br st tr kl".split()) + draw.choice("a e i o u ai ou".split()) for _ in range(draw.randint(2, 3))).title() + draw.choice(["", "n", "r", "s", "l"])


def planted(n: int, seed: int = 0) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """n sentences and their spans (kind number, start, end) of made-up names, addresses and spoken account numbers, four in ten without any."""
    draw = random.Random(seed)
    kinds = {k: i - 1 for i, k in enumerate(TYPES)}
    plain = lambda: "".join(draw.choice(["ing", "the", "an", "re", "on", "ed"]) for _ in range(draw.randint(1, 3)))
    for _ in range(n):
        own, number = named(draw), str(draw.randint(1, 9999)) + draw.choice(["", "", "", "b"])
        names = " ".join(named(draw) for _ in range(draw.randint(1, 2)))
        digits = " ".join(draw.choice(NUMBER_WORDS) for _ in range(draw.randint(4, 12)))
        few = " ".join(draw.choice(NUMBER_WORDS) for _ in range(draw.randint(1, 2)))
        end = draw.choice([", ", ". ", " ", "; "])
        greeting, account = draw.choice(GREETINGS), draw.choice(ACCOUNTS) + draw.choice(["", " is", ":", " is:"])
        kind, before, span = draw.choice([
            ("person", f"{greeting} ", names), ("person", f"{greeting}, ", names), ("account", f"{account} ", digits),
            ("street", "", f"{number} {names} {draw.choice(['Street', 'Road', 'Avenue', 'Lane', 'Drive', 'Court', 'Square', 'St', 'Rd', 'Ave'])}"),
            ("street", "", f"{number} {draw.choice(['rue', 'avenue', 'boulevard', 'place'])} {names}"),
            ("street", "", f"{draw.choice(STARTERS)} {own} {number}"), ("street", "", f"{own}{draw.choice(['strasse', 'straße', 'weg', 'gasse', 'platz'])} {number}"),
            ("none", f"{greeting} ", draw.choice(sorted(GENERIC))), ("none", "", f"{number} {names}"), ("none", f"{account} ", few),
            ("none", "", f"{number} {few}"), ("none", f"{draw.choice(STARTERS)} ", plain()),
        ])
        lead = plain() + " " + draw.choice(["", plain() + ". "])
        at = len(lead) + len(before)
        yield lead + before + span + end + plain(), [] if kind == "none" else [(kinds[kind], at, at + len(span))]


def segments(text: str, run: list[tuple[int, int]]) -> list[tuple[int, int, tuple[int, ...]]]:
    """(first token, tokens, features) of every candidate segment."""
    out = []
    for i in range(len(run)):
        before = text[max(0, run[i][0] - 16) : run[i][0]]
        for n in range(1, min(MOST_TOKENS, len(run) - i) + 1):
            out.append((i, n, span_features(text[run[i][0] : run[i + n - 1][1]], n, before)))
    return out


def known(text: str, run: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]] | None:
    """The run's true segments (first token, tokens, type); None where a base span doesn't end with tokens."""
    first, last = {s: i for i, (s, _) in enumerate(run)}, {e: i for i, (_, e) in enumerate(run)}
    out, used = [], set()
    for kind, s, e in base:
        if s < run[-1][1] and e > run[0][0]:
            if s not in first or e not in last or last[e] - first[s] >= MOST_TOKENS or used & {*range(first[s], last[e] + 1)}:
                return None
            out.append((first[s], last[e] - first[s] + 1, kind + 1))
            used |= {*range(first[s], last[e] + 1)}
    for i, (s, e) in enumerate(run):
        if i not in used:
            secret = SECRET.fullmatch(text[s:e]) and HINT.search(text[max(0, s - 16) : s])
            out.append((i, 1, TYPES.index("secret") if secret else 0))
    return sorted(out)


def announced(text: str, run: list[tuple[int, int]]) -> bool:
    """Whether a run has a cue before it or a street or number word in it."""
    before = text[max(0, run[0][0] - 16) : run[0][0]]
    words = [text[s : min(e, s + LONGEST)] for s, e in run]
    return bool(GREETED.search(before) or COUNTED.search(before)) or any(w in STREETS or STREET_END.search(w) or NUMBERS.fullmatch(w) for w in words)


class Model:
    """Weights of features and transitions by type."""

    def __init__(self):
        self.w = np.zeros((FEATURES, len(TYPES)))
        self.t = np.zeros((len(TYPES) + 1, len(TYPES)))  # the last row starts a run

    def scores(self, segs: list[tuple[int, int, tuple[int, ...]]]) -> list[np.ndarray]:
        """Scores by type; segments of the same features, of which a long run has few kinds, share them."""
        known: dict[tuple[int, ...], np.ndarray] = {}
        out = []
        for _, n, f in segs:
            if (s := known.get(f)) is None:
                s = self.w[list(f)].sum(axis=0)
                if n > 1:  # n is among the features
                    s = np.r_[-np.inf, s[1:]]  # nothing is a segment of one token
                known[f] = s
            out.append(s)
        return out

    def best(self, length: int, segs: list[tuple[int, int, tuple[int, ...]]]) -> list[tuple[int, int, int]]:
        """The best segmentation (first token, tokens, type)."""
        k = len(TYPES)
        top = np.full((length + 1, k + 1), -np.inf)
        top[0, k] = 0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        at = -1
        for (i, n, _), s in zip(segs, self.scores(segs)):
            if i != at:  # all segments that end here have been seen: the best way on to each type, once
                at, ways = i, top[i][:, None] + self.t
                reach, whence = ways.max(axis=0), ways.argmax(axis=0).tolist()
            into, best = (reach + s).tolist(), top[i + n]
            for y, v in enumerate(into):
                if v > best[y]:
                    best[y] = v
                    back[i + n, y] = (i, whence[y])
        out, at, y = [], length, int(top[length, :k].argmax())
        while at > 0:
            i, p = back[at, y]
            out.append((i, at - i, y))
            at, y = i, p
        return out[::-1]

    def fit(self, data: list[tuple[int, list, list, float]], rounds: int = 15, rate: float = 0.5) -> Model:
        """Gradient ascent on the conditional log-likelihood of (length, segments, truth, weight)."""
        gw2, gt2 = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6)
        k = len(TYPES)
        lse = lambda a: np.logaddexp.reduce(a, axis=0)
        for _ in range(rounds):
            for length, segs, truth, weight in data:
                s = self.scores(segs)
                fore = np.full((length + 1, k + 1), -1e30)
                fore[0, k] = 0
                for (i, n, _), v in zip(segs, s):
                    fore[i + n, :k] = np.logaddexp(fore[i + n, :k], lse(fore[i][:, None] + self.t) + v)
                rear = np.full((length + 1, k + 1), -1e30)
                rear[length] = 0
                for (i, n, _), v in zip(reversed(segs), reversed(s)):
                    rear[i] = np.logaddexp(rear[i], lse((self.t + (v + rear[i + n, :k])[None, :]).T))
                z = lse(fore[length, :k])
                gw, gt = -0.01 * self.w / len(data), -0.01 * self.t / len(data)
                for (i, n, f), v in zip(segs, s):
                    p = np.exp(np.minimum(fore[i][:, None] + self.t + (v + rear[i + n, :k])[None, :] - z, 0))
                    gt -= weight * p
                    gw[list(f)] -= weight * p.sum(axis=0)
                prev, feats = k, {(i, n): f for i, n, f in segs}
                for i, n, y in truth:
                    gw[list(feats[i, n]), y] += weight
                    gt[prev, y] += weight
                    prev = y
                gw2 += gw**2
                gt2 += gt**2
                self.w += rate * gw / np.sqrt(gw2)
                self.t += rate * gt / np.sqrt(gt2)
        return self


def trained(df: DataFrame, text: str, key: str, sample: int = SAMPLE_DOCS) -> Model:
    """A model fitted on planted sentences and about sample documents, chosen by the hash of their key; only SAMPLE_RUNS kinds of runs reach the driver.

    Runs of over ten tokens are left out of training, as are a document's runs with a cue or street word, whose truth isn't known.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(0):
                t = x.as_py() or ""
                base = base_spans(t)
                for run in runs(t):
                    if len(run) <= 10 and not announced(t, run) and (truth := known(t, run, base)) is not None:
                        out.append(json.dumps([len(run), segments(t, run), truth]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["run"])

    n = df.count()
    part = df.where(F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(max(1, n // max(1, sample)))) == 0)
    rows = part.select(F.col(f"`{text}`").cast("string")).mapInArrow(told, "run string").groupBy("run").count().orderBy(F.desc("count"), "run").limit(SAMPLE_RUNS).collect()
    data = []
    for r in rows:
        length, segs, truth = json.loads(r["run"])
        data.append((length, [(i, m, tuple(f)) for i, m, f in segs], [tuple(x) for x in truth], 1.0))
    for t, spans in planted(PLANTED):
        data += [(len(run), segments(t, run), truth, 1.0) for run in runs(t) if (truth := known(t, run, spans)) is not None]
    return Model().fit(data)


def all_spans(text: str, base: list[tuple[int, int, int]], model: Model, cache: dict) -> list[tuple[int, int, int]]:
    """Base spans and the model's further ones that don't overlap them, as (kind number, start, end), sorted."""
    more = []
    taken = sorted((s, e) for _, s, e in base)
    upto = list(itertools.accumulate((e for _, e in taken), max))  # the last end of the first spans
    for run in runs(text):
        segs = segments(text, run)
        sign = tuple(f for _, _, f in segs) if len(run) <= 8 else None
        path = cache.get(sign) if sign else None
        if path is None:
            path = model.best(len(run), segs)
            if sign and len(cache) < 50_000:
                cache[sign] = path
        for i, n, y in path:
            if y:
                s, e = run[i][0], run[i + n - 1][1]
                before = bisect.bisect_left(taken, (e,))  # the base spans that start before e
                if not before or upto[before - 1] <= s:
                    more.append((y - 1, s, e))
    return sorted([*base, *more])


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{TYPES[k + 1]}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{TYPES[k + 1].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def found(df: DataFrame, text: str = "text", key: str = "doc_id", model: Model | None = None, replace: bool = False) -> DataFrame:
    """df with n_email, n_ip, n_card, n_phone, base (text of the base spans) and spans (text of all spans).

    The text column goes, or is redacted with replace, which adds no other column. Texts are read whole and in time
    linear in their length, tokens of any length included. Null texts count as empty and stay null. Repeated rows repeat; an empty table gives an empty result. Columns of df that are called like a new one are replaced.
    """
    model = model or trained(df, text, key)
    new = () if replace else ("n_email", "n_ip", "n_card", "n_phone", "base", "spans")
    keep = [c for c in df.columns if c not in (text, *new)]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(unused(df, "_text")))
    names = [text] if replace else list(new)
    kinds = {n: "long" if n.startswith("n_") and not replace else "string" for n in names}
    schema = T.StructType([*[df.schema[c] for c in keep], *T.StructType.fromDDL(", ".join(f"`{n}` {kinds[n]}" for n in names)).fields])
    plain = np.abs(model.w).sum() == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                rows = []
                for x in part.column(len(keep)):
                    t = x.as_py()
                    base = base_spans(t) if t else []
                    spans = all_spans(t, base, model, cache) if t and not plain else base
                    if replace:
                        rows.append((redacted(t, spans) if t and spans else t,))
                    else:
                        rows.append((*[sum(k == i for k, _, _ in base) for i in range(4)], as_text(base), as_text(spans)))
                cols = [pa.array(c, pa.int64() if kinds[n] == "long" else pa.string()) for n, c in zip(names, zip(*rows))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], [*keep, *names])

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"`{c}`") for c in df.columns]) if replace else out
