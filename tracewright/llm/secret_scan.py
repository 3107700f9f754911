"""Secret scans: three base patterns, and a linear-chain conditional random field that adds spans.

Base kinds (code points, end exclusive, leftmost and non-overlapping for each kind): ``assign``, a named
value of six or more characters; ``access``, an access key id of 20 or more; ``hex``, a run of 24 or more.
The field tags every word of the whole text as beginning, inside or outside a secret from its shape, the words
beside it and the file's share of words with digits, and is decoded by Viterbi.

It learns from windows of words of a bounded sample (``SAMPLE`` documents by a hash of the id, ``WINDOWS`` of their
distinct windows by a hash of the window; equal windows count once): plain ones, ones about the values of base
spans, with their cues and without, and ones into which ``made`` puts a written secret of a form that no base
pattern reads, or something that only looks like a secret. Which is which is known there, so the field learns more
than the patterns find; real long words that aren't plain ones, of which it isn't known, are left out of windows, and ``measured`` holds it against windows of documents that it didn't learn from.
Spans it finds are reported as kind ``crf`` where they touch no base span.

Null texts are empty and hold nothing; repeated rows are scanned alike, null ids as any; an empty table gives no
rows, and a table without words a field that adds no spans. A very long text is one sequence, never cut. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
import uuid
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import texts, tuned
from tracewright.llm.crf import LinearChainCRF

SAMPLE = 6000
#: Windows at most that the driver gathers and learns from.
WINDOWS = 24_000
EPOCHS = 60
#: Features of fewer words are left out: they would only repeat the sample.
LEAST_SEEN = 8
#: Words on either side of a value in a training window, and words whose weights a worker holds.
NEAR = 6
WORDS = 400_000
KINDS = ("assign", "access", "hex", "crf")
# The base patterns.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_IS_HEX = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_RUN = b"x" * LEAST["hex"]
_DIGITS = frozenset("0123456789")
# Beginnings that issuers give to their keys.
_ISSUED = ("sk_live_", "rk_live_", "ghp_", "gho_", "xoxb-", "xoxp-", "glpat-", "SG.", "npm_", "dop_v1_", "shpat_", "hf_", "AIza", "ya29.")
_HEADS = frozenset(x[:4] for x in (*_ISSUED, "eyJh", "eyJ0")) - {"SG.", "hf_"}
_VALUE = re.compile(r"[A-Za-z0-9+/_.-][A-Za-z0-9+/_.=-]*\Z")
_WORD = re.compile(r"\S+")
_ABOUT = "\"'.,;()!?"
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CORE = re.compile(r"[A-Za-z0-9+/_=-](?:[A-Za-z0-9+/_.=-]*[A-Za-z0-9+/_=-])?")
#: This worker's tagger of the last query; a worker runs many tasks of it.
_HERE: dict[str, Tagger] = {}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by start, then kind."""
    out = []
    lower = text.lower()
    if any(n in lower for n in _NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if _RUN in text.encode("utf-8", "surrogatepass").translate(_IS_HEX):
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return in_order(out)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _core(word: str) -> str:
    """A word without the signs about it."""
    return max(_CORE.findall(word), key=len, default=word)


def _entropy(core: str) -> float:
    n = len(core)
    return log2(n) - sum(k * log2(k) for c in {*core} if (k := core.count(c)) > 1) / n if n else 0.0


def _shape(word: str) -> list[str]:
    core = _core(word)
    n, kinds = len(core), "".join(sorted({"d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else c for c in {*core}}))
    turns = 0 if "d" not in kinds else sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:]))  # noqa: B905
    cased = 0 if "u" not in kinds or "l" not in kinds else sum(a.islower() and b.isupper() for a, b in zip(core, core[1:]))  # noqa: B905
    length, entropy = min(n, 48) // 6, int(_entropy(core) * 2)
    return [f"kinds={kinds}", f"length={length}", f"entropy={entropy}", f"turns={min(turns, 12) // 2}", f"cased={min(cased, 8) // 2}", f"head={core[:4] if core[:4] in _HEADS else ''}", f"marks={''.join(sorted({c for c in word if c in '@:/{}'}))}", f"parts={min(len(re.split('[-_./]', core)), 6)}/{entropy}"]


def _before(word: str) -> list[str]:
    """What a word says of the one after it."""
    near = word[-24:].lower().strip("\"'.,;()")
    end = word[-1:] if word[-1:] in (":", "=") else ""
    return [f"before={near.strip(':=') if near.strip(':=').isalpha() or near in ('=', ':', '->', '=>', '|') else '?'}", f"named={near in ('=', ':')}", f"end={end}"]


def _after(word: str) -> list[str]:
    near = word[:24].lower().strip("\"'.,;()")
    return [f"after={near[:3] if near in ('=', ':') else '?'}"]


def _share(words: list[str]) -> str:
    return _digits(sum(not _DIGITS.isdisjoint(w) for w in words), len(words))


def _digits(with_one: int, words: int) -> str:
    return f"digits={min(20 * with_one // max(1, words), 5)}"


def describe(words: list[str], share: str) -> list[list[str]]:
    """Features of each word of a window."""
    near = ["", *words, ""]
    return [["bias", *_shape(w), *_before(near[i]), *_after(near[i + 2]), share] for i, w in enumerate(words)]


def value_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans, named ones without the name."""
    return [(k, a, b) if k != "assign" else (k, b - len(_VALUE.search(text, a, b)[0]), b) for k, a, b in base]


def weak_labels(run: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    """0 outside, 1 begin, 2 inside, from the base spans."""
    out, last = [], None
    for start, end in run:
        hit = next((s for s in spans if s[1] < end and s[2] > start), None)
        out.append(0 if hit is None else 2 if hit is last else 1)
        last = hit
    return out


class Tagger:
    """A field's weights by word, so that a known word costs one lookup."""

    def __init__(self, model: LinearChainCRF):
        self.model = model
        self.weight = {name: tuple(model.weights[i].tolist()) for name, i in model.index.items()}
        self.numbers: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 10))
        self.plain: dict[tuple[int, int, bool], tuple] = {}
        self.cues = {name[7:] for name in model.index if name.startswith("before=")}
        self.before, self.after = self.sum(["named=False", "end="]), self.sum(_after("a"))

    def sum(self, names: list[str]) -> tuple[float, float, float]:
        get, a, b, c = self.weight.get, 0.0, 0.0, 0.0
        for name in names:
            if found := get(name):
                a, b, c = a + found[0], b + found[1], c + found[2]
        return a, b, c

    def weigh(self, word: str) -> tuple[float, ...]:
        """Of a word: its own weights, those it gives to the word after it and to the word before it, whether it has a digit."""
        body = word.strip(_ABOUT)
        if body.isalpha():
            core = body if body.isascii() else _core(body)
            lower = core.islower()
            if core.isascii() and (lower or core[1:].islower()):  # all that is told of these is their length, entropy and first letter
                key = len(core), int(_entropy(core) * 2), lower
                if key not in self.plain:
                    self.plain[key] = self.sum(_shape(core))
                known = len(body) > 24 or body.lower() in self.cues or word[-1] in "!?"
                return *self.plain[key], *(self.sum(_before(word)) if known else self.before), *self.after, 0.0
        return *self.sum(_shape(word)), *self.sum(_before(word)), *self.sum(_after(word)), float(not _DIGITS.isdisjoint(word))

    def learn(self, words: set[str]) -> None:
        if len(self.numbers) + len(words) > WORDS:
            self.numbers = {}
        at = len(self.numbers)
        while at + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at : at + len(words)] = [self.weigh(w) for w in words]
        self.numbers |= zip(words, range(at, at + len(words)), strict=True)

    def tag(self, words: list[str]) -> dict[int, int]:
        """Labels of the words that aren't outside."""
        number = list(map(self.numbers.get, words))
        if None in number:
            self.learn({w for w, i in zip(words, number, strict=True) if i is None})
            number = list(map(self.numbers.get, words))
            if None in number:  # the table was begun anew
                self.learn({w for w, i in zip(words, number, strict=True) if i is None})
                number = list(map(self.numbers.get, words))
        w = self.table[number]
        edge = np.array([self.sum(["bias", _digits(int(w[:, 9].sum()), len(words))]), self.sum(_before("")), self.sum(_after(""))])
        e = w[:, :3] + edge[0]
        e[1:] += w[:-1, 3:6]
        e[0] += edge[1]
        e[:-1] += w[1:, 6:9]
        e[-1] += edge[2]
        return self.model.other_than_first(e)


def found_spans(model: LinearChainCRF | Tagger, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The field's spans that touch no base span."""
    tagger = model if isinstance(model, Tagger) else Tagger(model)
    words = text.split()
    if not words or not tagger.model.index:
        return []
    labels = tagger.tag(words)
    if not labels:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    out, k = [], -1
    for first in labels:
        if first <= k:
            continue
        k = first + 1
        while labels.get(k) == 2:
            k += 1
        k -= 1
        (a, b), (c, d) = at[first], at[k]
        start, end = a + text[a:b].index(_core(text[a:b])), c + text[c:d].index(_core(text[c:d])) + len(_core(text[c:d]))
        if not any(s[1] < end and s[2] > start for s in base):
            out.append(("crf", start, end))
    return out


# Alphabets.
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_ALNUM = _LOWER + _LOWER.upper() + "0123456789"
_CUES = (("token", "->"), ("key", "=>"), ("credential", "is"), ("Authorization:", "Bearer"), ("Authorization:", "Basic"), ("bearer",), ("password", "is"), ("pwd:",), ("private", "key:"), ("auth", "|"), ("login", "with"), ("signing", "key"))


def made(r: random.Random, hidden: bool = False) -> tuple[list[str], list[str], list[str]]:
    """A written secret of a form that no base pattern reads: words before, its own words, words after.

    ``hidden``: of a form that is only written to measure what the field makes of unseen ones.
    """
    some = lambda alphabet, least, most: "".join(r.choice(alphabet) for _ in range(r.randint(least, most)))
    if hidden:
        return r.choice([
            ([], ["pk_test_" + some(_ALNUM, 24, 32)], []), ([], ["EAAC" + some(_ALNUM, 60, 120)], []), (["sas"], ["sv" + some(_ALNUM + "%", 40, 60)], []),
            (["cookie"], [some(_ALNUM + "-_", 43, 43)], []), ([], [f"ftp://{some(_LOWER, 4, 8)}:{some(_ALNUM, 8, 16)}@{some(_LOWER, 5, 9)}.net"], []),
        ])
    cue = list(r.choice(_CUES)) if r.random() < 0.7 else []
    form = r.randrange(8)
    if form == 0:
        return (cue if r.random() < 0.5 else []), [r.choice(_ISSUED) + some(_ALNUM, 20, 40)], []
    if form == 1:
        return cue, ["eyJ" + some(_ALNUM, 16, 40) + ".eyJ" + some(_ALNUM, 20, 90) + "." + some(_ALNUM + "-_", 30, 43)], []
    if form == 2:
        host = f"{some(_LOWER, 4, 9)}.{r.choice(['com', 'net', 'local'])}"
        return [], [f"{r.choice(['postgres', 'mysql', 'mongodb', 'redis', 'https', 'amqp'])}://{some(_LOWER, 4, 9)}:{some(_ALNUM, 8, 20)}@{host}:{r.randint(80, 9999)}/{some(_LOWER, 2, 8)}"], []
    if form == 3:
        return ["-----BEGIN", "RSA", "PRIVATE", "KEY-----"], [some(_ALNUM + "+/", 64, 64) for _ in range(r.randint(1, 4))], ["-----END"]
    if form == 4:
        return cue, [some(_LOWER + _LOWER.upper(), 24, 44)], []
    if form == 5:
        return cue, [some("0123456789ABCDEF", 32, 64)], []
    if form == 6:
        return cue, [some(_ALNUM + "+/", 27, 60) + r.choice(["=", "==", ""])], []
    return cue, [some(_ALNUM, 20, 44)], []


def alike(r: random.Random) -> list[str]:
    """Words that look like a secret and aren't."""
    some = lambda alphabet, least, most: "".join(r.choice(alphabet) for _ in range(r.randint(least, most)))
    h, word = "0123456789abcdef", lambda: some(_LOWER, 2, 9)
    form = r.randrange(14)
    if form == 0:
        return [r.choice(["id", "uuid:", "request", ""]) or word(), "-".join(some(h, n, n) for n in (8, 4, 4, 4, 12))]
    if form == 1:
        return ["commit", some(h, 7, 12)]
    if form == 2:
        return [r.choice(["version", "v", "release"]), f"{r.randint(0, 20)}.{r.randint(0, 40)}.{r.randint(0, 99)}-{word()}.{r.randint(0, 9)}"]
    if form == 3:
        return ["/" + "/".join(word() for _ in range(r.randint(3, 7))) + f"/{word()}_{r.randint(0, 99)}.{word()[:3]}"]
    if form == 4:
        return [f"https://{word()}.{word()}.com/{word()}/{r.randint(1, 10**7)}/{word()}-{word()}-{word()}?{word()}={r.randint(1, 999)}&{word()}={word()}"]
    if form == 5:
        return [f"{word()}.{word()}{r.randint(0, 99)}@{word()}.org"]
    if form == 6:
        return [f"20{r.randint(10, 30)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}.{r.randint(0, 999)}Z"]
    if form == 7:
        return [".".join(str(r.randint(0, 255)) for _ in range(4)), ":".join(some(h, 2, 2) for _ in range(6))]
    if form == 8:
        return [word() + "".join(word().capitalize() for _ in range(r.randint(2, 5)))]
    if form == 9:
        return ["_".join(word().upper() for _ in range(r.randint(2, 5)))]
    if form == 10:
        return ["-".join(word() for _ in range(r.randint(3, 6)))]
    if form == 11:
        return [r.choice(["call", "tel", "isbn", "order"]), some("0123456789", 9, 16)]
    if form == 12:
        return [f"+{r.randint(1, 99)}", *(some("0123456789", 3, 4) for _ in range(3))]
    return ["token", r.choice(["is", "->"]), word(), r.choice(["password", "key"]), r.choice(["is", "of"]), word()]


def _unknown(word: str) -> bool:
    """Whether a real word that no base span touches may be a secret all the same, so that it can't be an example."""
    core = _core(word)
    return len(core) >= 16 and not (core.isalpha() and core[1:].islower())


def windows(text: str) -> list[tuple[list[str], list[int], str]]:
    """Training windows of a text, their words, labels and the share of words with digits: about its base values, with
    made secrets and look-alikes, and plain ones. Some are taken for a short text of their own."""
    words, spans = [m.span() for m in _WORD.finditer(text)], value_spans(text, base_spans(text))
    labels = weak_labels(words, spans)
    kept = [i for i, (a, b) in enumerate(words) if labels[i] or not _unknown(text[a:b])]
    words, labels = [words[i] for i in kept], [labels[i] for i in kept]
    if not words:
        return []
    parts = [text[a:b] for a, b in words]
    r = random.Random(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
    plain = [w for w, y in zip(parts, labels, strict=True) if not y] or [""]
    out = []
    for i in (i for i, y in enumerate(labels) if y == 1):
        lo, hi = max(0, i - NEAR), i + 1
        while hi < len(labels) and labels[hi] == 2:
            hi += 1
        end = min(len(labels), hi + NEAR)
        out.append((parts[lo:end], labels[lo:end]))
        start, stop = next(s[1:] for s in spans if s[1] < words[i][1] and s[2] > words[i][0])
        value = text[max(start, words[i][0]) : min(stop, words[i][1])]
        for digits in (True, False):  # without the name: digits as they are, or as letters
            masked = value if digits else "".join(r.choice(_LETTERS) if c in _DIGITS or r.random() < 0.5 else c for c in value)
            cut = max(lo, i - 2)  # the name and its sign become words of the text, or a sign that no pattern reads
            cue = [r.choice(plain) for _ in range(i - cut)]
            if cue and r.random() < 0.3:
                cue[-1] = r.choice(["->", "=>", "is", "|"])
            out.append(([*parts[lo:cut], *cue, _dressed(masked, r), *parts[hi:end]], [*labels[lo:cut], *([0] * len(cue)), 1, *labels[hi:end]]))

    def place(words: list[str], marks: list[int]) -> None:
        i = r.randrange(len(plain))
        before, after = plain[max(0, i - NEAR) : i], plain[i : i + NEAR]
        out.append(([*before, *words, *after], [*([0] * len(before)), *marks, *([0] * len(after))]))

    for _ in range(2):
        cue, own, after = made(r)
        own = own if len(own) > 1 else [_dressed(own[0], r)]
        place([*cue, *own, *after], [*([0] * len(cue)), 1, *([2] * (len(own) - 1)), *([0] * len(after))])
        other = alike(r)
        place([*other[:-1], _dressed(other[-1], r)], [0] * len(other))
    for _ in range(2):
        i = r.randrange(len(words))
        if not any(labels[i : i + 2 * NEAR]):
            out.append((parts[i : i + 2 * NEAR], labels[i : i + 2 * NEAR]))
    share = _share(parts)
    return [(words, y, _share(words) if r.random() < 0.3 else share) for words, y in out]


def _dressed(word: str, r: random.Random) -> str:
    return r.choice(["%s", "%s", "%s", '"%s"', "'%s'", "(%s)", "%s,", "%s."]).replace("%s", word)


def planted(text: str, hidden: bool = False) -> tuple[str, tuple[int, int]]:
    """A text with a made secret and something that only looks like one among its words, and the secret's place."""
    r = random.Random(hashlib.sha256(("held out" + text).encode("utf-8", "surrogatepass")).digest())
    words = text.split()
    cue, own, after = made(r, hidden)
    first, second = sorted(r.randrange(len(words) + 1) for _ in range(2))
    like, secret = alike(r), [*cue, *own, *after]
    one, two = (like, secret) if r.random() < 0.5 else (secret, like)
    whole = " ".join([*words[:first], *one, *words[first:second], *two, *words[second:]])
    start = whole.index(" ".join(own))
    return whole, (start, start + len(" ".join(own)))


def measured(model: LinearChainCRF, found: list[str], hidden: bool = False) -> dict[str, float]:
    """Precision and recall of the field's spans on whole texts that it hasn't learned from, a secret put into each."""
    tagger, right, said, there = Tagger(model), 0, 0, 0
    for text in found:
        whole, (start, end) = planted(text, hidden)
        base = base_spans(whole)
        spans = found_spans(tagger, whole, base)
        said += len(spans)
        if not any(s[1] < end and s[2] > start for s in base):  # else it isn't the field's to find
            there += 1
            right += any(s[1] < end and s[2] > start for s in spans)
    return {"precision": right / max(1, said), "recall": right / max(1, there), "secrets": float(there)}


def fit(docs: DataFrame, sample: int = SAMPLE, most: int = WINDOWS) -> LinearChainCRF:
    """Learn from windows of about ``sample`` documents, ``most`` windows at most."""
    total = docs.count()
    part = docs if total <= sample else docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < int(1_000_000 * sample / total) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for text in texts(batch, "text") for x in windows(text)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.list_(pa.string())), pa.array([x[1] for x in out], pa.list_(pa.int32())), pa.array([x[2] for x in out], pa.string())], names=["words", "labels", "share"])

    seen = part.selectExpr("cast(text as string) as text").mapInArrow(run, "words array<string>, labels array<int>, share string").distinct()
    rows = seen.orderBy(F.xxhash64("words", "share"), "words", "share", "labels").limit(most).collect()
    model = LinearChainCRF(3)
    return model.fit([describe(r.words, r.share) for r in rows], [list(r.labels) for r in rows], epochs=EPOCHS, ridge=1e-5, least=LEAST_SEEN) if rows else model


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans(kind, start, end)`` of every document."""
    tuned(docs.sparkSession)
    docs = docs.selectExpr("doc_id", "cast(text as string) as text")
    model, name = fit(docs), uuid.uuid4().hex
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _HERE:
            _HERE.clear()
            _HERE[name] = Tagger(model)
        for batch in batches:
            out = []
            for text in texts(batch, "text"):
                base = base_spans(text)
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in in_order(base + found_spans(_HERE[name], text, base))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], names=["doc_id", "spans"])

    return docs.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``'s rows."""
    joined = "array_join(transform(%s, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = "filter(spans, s -> s.kind <> 'crf')"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.expr(f"sha2({joined % base}, 256)").alias("base_sha256"), F.expr(joined % "spans").alias("spans"))
